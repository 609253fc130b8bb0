"""Text normalisers and tokenizers as Column expressions. Four of them look alike and differ on purpose."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spellings of a missing cell; with NA_MISSING also those that many CSV readers drop.
MISSING = ("", "nan", "none", "null")
NA_MISSING = (*MISSING, "na", "n/a")


def missing_to_null(cell: Column, na: bool = False) -> Column:
    """A trimmed cell, or null where it spells a missing value."""
    value = F.trim(cell.cast("string"))
    return F.when(~F.lower(value).isin(*(NA_MISSING if na else MISSING)), value)


def normalize_string(c: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def tokenize_string(c: Column) -> Column:
    """Tokens of camelCase, snake_case, kebab-case and spaced text, digits apart from letters."""
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([0-9])([A-Za-z])", "$1 $2")
    c = F.regexp_replace(c, "([a-zA-Z])([0-9])", "$1 $2")
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_leet(c: Column) -> Column:
    """Search normaliser: symbols to spaces, then 0 o, 1 i, 3 e, 4 a, 5 s, then q without u to g."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"[@#$%^&*_+=\[\]{};:<>?/\\|~]", " ")
    return _squeeze(F.regexp_replace(F.translate(c, "01345", "oieas"), "q(?!u)", "g"))


def normalize_leet_mesh(c: Column) -> Column:
    """Mesh normaliser: @ is a letter, s1ot and siot are slot before symbols go and before 1 is i."""
    c = F.translate(F.lower(F.trim(c)), "@0345", "aoeas")
    c = F.replace(F.replace(c, F.lit("s1ot"), F.lit("slot")), F.lit("siot"), F.lit("slot"))
    c = F.translate(F.regexp_replace(c, r"[#$%^&*_+=\[\]{};:<>?/\\|~]", " "), "1", "i")
    return _squeeze(F.regexp_replace(c, "q(?!u)", "g"))


def tokens(c: Column) -> Column:
    """Unicode word tokens, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of ^text$; a text shorter than n is its own only one."""
    s = F.concat(F.lit("^"), F.lower(F.trim(c)), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, n))
    return F.when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(grams))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.element_at(F.split(iri, "[#/]"), -1)


def normalize_identifier(c: Column) -> Column:
    """Identifier for scoring: the fragment or last path part (with a typed parent), lower case, alphanumeric only."""
    s = F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.split(s, "/"), lambda p: p != "")
    typed = F.element_at(parts, -2).isin("item", "vendor", "zone", "discipline", "recipe", "currency", "step")
    path = F.when((F.size(parts) >= 2) & typed, F.concat_ws("_", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))
    name = F.when(s.contains("#"), F.element_at(F.split(s, "#"), -1)).when(s.contains("/"), path).otherwise(s)
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[\W_]+", ""))


def normalize_entity_iri(c: Column) -> Column:
    """Entity slug for scoring; IRIs that say unknown keep that word in front."""
    s = F.trim(F.coalesce(c, F.lit("")))
    slug = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"(?U)[\W_]+", "_"), "^_+|_+$", ""))
    last = F.element_at(F.split(s, "/"), -1)
    name = F.when(s.contains("#"), F.element_at(F.split(s, "#"), -1)).otherwise(last)
    return F.when(F.lower(s).contains("unknown"), F.concat(F.lit("unknown_"), slug(last))).otherwise(slug(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_")))


def to_curie(iri: Column, prefixes: dict[str, str]) -> Column:
    """The short form of an IRI under one of the namespaces (the longest that fits), else the IRI itself."""
    out = iri
    for prefix, ns in sorted(prefixes.items(), key=lambda x: (len(x[1]), x)):
        out = F.when(iri.startswith(ns), F.concat(F.lit(f"{prefix}:"), F.substring(iri, F.lit(len(ns) + 1), F.length(iri)))).otherwise(out)
    return out


def to_iri(term: Column, prefixes: dict[str, str], base: str = "") -> Column:
    """The IRI of a term: angle brackets off, a known prefix replaced, a full IRI as it is, anything else under ``base``."""
    bare = F.regexp_replace(F.trim(term), "^<(.*)>$", "$1")
    out = F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).otherwise(F.concat(F.lit(base), bare))
    for prefix, ns in prefixes.items():
        out = F.when(bare.startswith(f"{prefix}:") & ~bare.startswith(f"{prefix}://"), F.concat(F.lit(ns), F.substring(bare, F.lit(len(prefix) + 2), F.length(bare)))).otherwise(out)
    return out


def clean_id(text: Column) -> Column:
    """A slug for minted IRIs: lower case, apostrophes out, every other run of signs one underscore, none at the ends."""
    low = F.regexp_replace(F.lower(F.trim(text)), "['’]", "")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
