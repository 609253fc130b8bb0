"""Cues of guide prose, as data: modality, clause ends, relations, amounts, anchors and the columns of a synthesised grid."""

from __future__ import annotations

# Cue patterns of each modality and the words that override fluff; marks that end a clause.
CUES = {
    "BOULETIC_FLUFF": (
        r"\b(i (was mulling|realized|realised|wanted|feel|think|believe|prefer|hope|wish|suggest|recommend|find|mean|guess|suppose|suspect|doubt|reckon|myself don't|don't own))\b",
        r"\b(in my opinion|in my experience|imo|imho|fwiw|tbh|to be honest|honestly|personally|for me|my advice|my goal|my recommendation)\b",
        r"\b(super long post|long post|can't be bothered|feel free to|let me know|thank you|thanks for reading|welcome to my guide|alright squad|dirty guide|bam!)\b",
        r"\b(note from author|author's note|just for fun|i hope this|please let me know)\b",
    ),
    "HYPOTHETICAL": (
        r"\b(if you (are|want|choose|have|need|plan|intend|own|decide|do not|don't)|if you're|if you've)\b",
        r"\b(when (crafting|making|creating|gearing|levelling|leveling|starting|doing)|when you (craft|make|create|reach|level))\b",
        r"\b(unless|assuming|provided that|in case|whenever|upon (crafting|completing|reaching|finishing|acquiring))\b",
        r"\b(whether|as long as|should you|supposing)\b",
    ),
    "EPISTEMIC_ESTIMATE": (
        r"\b(likely|unlikely|around|approx|approximately|drop rate|chance|estimated|probably|roughly|maybe|seems to)\b",
        r"\b(about\s+\d+|~\s*\d+|\d+\s*-\s*\d+\s*(gold|g|silver|s|copper|c|%|percent|infusions|planks|relics))\b",
        r"\b(frequently|rarely|sometimes|uncertain|optimal circumstances|price difference|relative to the price)\b",
        r"\b(cost (around|about|somewhere|typically)|will cost around|typically around)\b",
    ),
    "DEONTIC_RULE": (
        r"\b(must|requires?|requiring|required|cannot|can't|always|unlocked by|prerequisite|needed for|mandatory|essential|strictly)\b",
        r"\b(has to|have to|only|requires level|requires rating|bound|account-bound|soulbound|never|impossible)\b",
        r"\b(recipe is sold|obtained from|crafted at|crafted by|throw .* into|combine .* with|talk to .* at|grab .* from)\b",
        r"\b(you (gotta|need to|have to|must|will need)|you get the actual|throw everything into)\b",
    ),
}
STRONG_RULE = r"\bmust\b|\brequires?\b|\bcrafted by\b|\bobtained from\b|\bprecursor\b"
CONFIDENCE = {"BOULETIC_FLUFF": 0.95, "HYPOTHETICAL": 0.90, "EPISTEMIC_ESTIMATE": 0.88, "DEONTIC_RULE": 0.92}
CLAUSE_END = r";\s*|—\s*|--\s*|\s+-\s+|,\s*(?=(?:and|but|while|however|because|whereas|whereafter|once|so|as well as|or you can't|or you cannot)\b)"

# Types by how likely they anchor a clause; every other type counts as 1.
ANCHOR_RANK = {"PrecursorWeapon": 5, "LegendaryWeapon": 4, "Item": 3, "ComponentItem": 2, "TrophyItem": 2, "CraftingMaterial": 2, "NPCVendor": 1, "Zone": 0, "CraftingDiscipline": 0}
# Cues of a clause's relation, the first that is found decides; amounts of money; ratings.
RELATION_CUES = (
    ("precursorTo", r"(?i)\b(precursor to|upgrades to|crafted into|tier \d+ is)\b"),
    ("requiresIngredient", r"(?i)\b(requires?|need|combine|add|throw .* into)\b"),
    ("obtainedFromVendor", r"(?i)\b(talk to|bought from|vendor|sold by|from)\b"),
    ("locatedInZone", r"(?i)\b(located in|in|at)\b"),
)
COST = r"(?i)(\d+(?:\s*-\s*\d+)?\s*(?:gold|silver|copper|laurels?|badges of honor|unbound magic|volatile magic|winterberries|fractal relics|pristine fractal relics|magnetite shards|spirit shards?|ectoplasm|coins?|g|s|c))\b"
RATING = r"(?i)\b(?:rating|level|crafting)\s*(\d{3})\b|\b(\d{3})\s*maxed out\b"
QUANTITY = r"\b(\d+)\s+([A-Za-z][A-Za-z\s'\-]{2,30})\b"

# Columns of a synthesised grid in order, with their titles.
DIMENSIONS = (("entity", "Required Component"), ("quantity", "Quantity"), ("discipline", "Crafting Discipline"), ("min_rating", "Min Rating"), ("vendor", "NPC Vendor"), ("zone", "Zone / Location"), ("cost", "Cost / Currency"))
