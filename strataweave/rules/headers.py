"""What column headers say, as data. Lists are read from the top; the first entry that fits decides."""

from __future__ import annotations

# Header patterns with the type, role and confidence they give a column of a first reading.
PROPOSED = (
    (r"\b(qty|quantity|count|amount|x|#)\b", "Quantity", "quantity", 0.95),
    (r"\b(cost|price|gold|karma|currency|spirit shard|coin|buy)\b", "Currency", "cost", 0.9),
    (r"\b(discipline|crafting|prof|profession|rating|level)\b", "CraftingDiscipline", "discipline", 0.9),
    (r"\b(weapon)\b", "Weapon", "reward", 0.75),
    (r"\b(armor)\b", "Armor", "reward", 0.75),
    (r"\b(output|reward|product|result|crafted item|target)\b", "Item", "reward", 0.85),
    (r"\b(requirement|requirements|material|materials|ingredient|ingredients|component|components|input)\b", "CraftingMaterial", "ingredient", 0.9),
)
# The pattern of a plain name column, which is the subject where it comes first.
PLAIN_NAME = r"\b(item|name|component name)\b"

# Words in a header that make its cells an attribute of their row; the second list holds numbers.
ATTRIBUTES = (
    ("quantity", ("qty", "quant", "cost", "count", "amount")),
    ("discipline", ("discipline", "craft", "prof")),
    ("min_rating", ("rating", "minrating", "level")),
    ("vendor", ("vendor", "source", "npc", "who")),
    ("zone", ("zone", "loc", "place", "where")),
    ("tier", ("tier",)),
)
NUMERIC_ATTRIBUTES = ("quantity", "min_rating", "tier")

# Words in a header with the type and confidence that the statistical baseline gives.
BASELINE = (
    (("qty", "quant", "cost", "count", "amount", "rating", "minrating"), "Number", 0.70),
    (("item", "thing", "output", "mat", "precursor", "component", "sub_ingredient"), "GenericItem", 0.65),
    (("craft", "disc", "discipline", "profession"), "TextCategory", 0.60),
    (("vendor", "source", "npc", "who"), "Person", 0.60),
    (("zone", "loc", "place", "where"), "Location", 0.60),
)
BASELINE_ELSE = ("String", 0.50)
BASELINE_PAIR = ("relatesTo", 0.45)

# Words in a header that settle a column's class in a mesh.
MESH_TYPES = (
    (("tier",), "CollectionTier", 0.95),
    (("step", "journey", "stepname", "collection"), "CollectionStep", 0.95),
    (("qty", "quant", "cost", "count", "amount", "mass", "weight"), "IngredientQuantity", 0.95),
    (("rating", "level", "skill", "minrating", "purity", "grade"), "DisciplineRating", 0.95),
    (("slot", "forgeslot", "forge_slot"), "MysticForgeRecipe", 0.95),
    (("discipline", "craft", "prof"), "CraftingDiscipline", 0.95),
    (("zone", "loc", "place", "where", "zn"), "Zone", 0.95),
    (("vendor", "source", "npc", "who", "supplier", "merchant"), "NPCVendor", 0.95),
    (("hope", "bifrost", "nevermore", "astralaria", "precursor"), "PrecursorWeapon", 0.95),
    (("prototype", "experimental", "component", "ingredient", "sub_ingredient"), "ComponentItem", 0.90),
    (("currency", "token"), "Currency", 0.95),
    (("attribute", "stat", "prefix"), "AttributeCombination", 0.95),
)
# Headers of numbers, which name no entity; words of a header and of a candidate's type that agree.
NUMBERS = ("qty", "quant", "cost", "count", "amount", "rating", "minrating", "level", "mass", "weight")
AGREEING = (
    (("vendor", "npc", "merchant", "source"), ("vendor", "npc")),
    (("discipline", "craft", "prof"), ("discipline",)),
    (("zone", "loc", "place", "where", "zn"), ("zone",)),
    (("precursor", "weapon"), ("precursor",)),
    (("currency", "token", "coin", "karma"), ("currency",)),
    (("attribute", "stat", "prefix"), ("attribute", "combination")),
)
# Words of a header with the type a cell gets that no entity matches.
MINTED = (
    (("zone", "loc", "place"), "Zone"),
    (("vendor", "merchant", "npc", "source"), "NPCVendor"),
    (("discipline", "craft", "prof"), "CraftingDiscipline"),
    (("currency", "coin", "token", "cost"), "Currency"),
)
MINTED_ELSE = "Item"

# Words in an item's name that tell its discipline.
DISCIPLINE_WORDS = (
    ("artificer", ("staff", "scepter", "focus", "trident", "ravenswood", "nevermore", "bifrost", "meteorlogicus", "minstrel")),
    ("weaponsmith", ("sword", "axe", "mace", "hammer", "greatsword", "dagger", "shield", "spear", "rodgort", "twilight", "sunrise", "bolt", "frostfang")),
    ("huntsman", ("bow", "pistol", "rifle", "torch", "warhorn", "hope", "predator", "kudzu", "chuka", "howler")),
)
