"""Vocabulary of a domain, as data: operators take a ``Rules`` and hold no words of their own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    #: (pattern, replacement) in order; names whose own spelling wins; names that are currencies.
    rewrites: tuple[tuple[str, str], ...] = ()
    known_names: tuple[str, ...] = ()
    currencies: tuple[str, ...] = ()
    #: Words after a number that make it money; lower-case currency names; hints that a phrase is one; (hint, name it gets).
    currency_words: tuple[str, ...] = ("g", "s", "c", "gold", "silver", "copper")
    currency_names: tuple[str, ...] = ()
    currency_hints: tuple[str, ...] = ()
    currency_canonical: tuple[tuple[str, str], ...] = ()
    disciplines: tuple[str, ...] = ()


# The vocabulary of the crafting tables that the tests use.
DEFAULT = Rules(
    currency_words=("g", "s", "c", "gold", "silver", "copper", "karma", "badges?", "laurels?", "unbound magic", "volatile magic"),
    currencies=("Karma", "Gold", "Spirit Shards", "Laurel"),
    currency_names=("karma", "gold", "silver", "copper", "laurel", "spirit shard"),
    currency_hints=("karma", "spirit shard", "gold", "silver", "laurel", "relic", "badge", "astral", "favor"),
    currency_canonical=(("Karma", "Karma"), ("Spirit Shard", "Spirit Shards"), ("Fractal Relic", "Fractal Relics"), ("Badge", "Badge of Honor"), ("Laurel", "Laurel")),
    disciplines=("artificer", "weaponsmith", "huntsman", "armorsmith", "tailor", "leatherworker", "chef", "jeweler", "scribe"),
)
