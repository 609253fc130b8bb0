"""String and vector similarities: Column expressions where Spark can say them, Arrow-batched UDFs where it cannot."""

from __future__ import annotations

import difflib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from strataweave.functions.normalize import char_ngrams, normalize_leet, tokens


def levenshtein_similarity(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / longest))


def _jaccard(x: Column, y: Column, blank: Column) -> Column:
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), F.when(blank, 1.0).otherwise(0.0))
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


def token_jaccard(a: Column, b: Column) -> Column:
    return _jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)), (F.trim(a) == "") & (F.trim(b) == ""))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return _jaccard(char_ngrams(a, n), char_ngrams(b, n), (F.trim(a) == "") & (F.trim(b) == ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, clipped to [-1, 1]; 0 for null, unequal lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norms > 1e-12)
    return F.when(usable, value).otherwise(0.0)


def jaro(a: str, b: str, floored: bool = False) -> float:
    """Jaro similarity of trimmed lower-case strings. ``floored`` halves transpositions to a whole number."""
    a, b = a.strip().lower(), b.strip().lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = dict(enumerate(b))
    left = []
    for i, c in enumerate(a):
        hit = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free.get(j) == c), None)
        if hit is not None:
            del free[hit]
            left.append(c)
    if not left:
        return 0.0
    right = [c for j, c in enumerate(b) if j not in free]
    swaps = sum(x != y for x, y in zip(left, right, strict=True))
    half = swaps // 2 if floored else swaps / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str, floored: bool = False, gate: float = 0.0) -> float:
    """Jaro raised by a tenth of the rest for each of up to four leading characters in common, from ``gate`` on."""
    base = jaro(a, b, floored)
    if base in (0.0, 1.0) or base <= gate:
        return base
    a, b = a.strip().lower(), b.strip().lower()
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return min(1.0, base + 0.1 * same * (1 - base))


def _pairwise(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        cached = lru_cache(200_000)(f)
        return pd.Series([None if x is None or y is None else cached(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


jaro_udf = _pairwise(jaro)
jaro_winkler_udf = _pairwise(jaro_winkler)
jaro_std_udf = _pairwise(lambda a, b: jaro(a, b, True))
jaro_winkler_std_udf = _pairwise(lambda a, b: jaro_winkler(a, b, True, 0.7))
#: Ratcliff-Obershelp ratio; not symmetric, the query comes first.
seq_ratio_udf = _pairwise(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())


def lexical_score(query: Column, target: Column) -> Column:
    """Mean of token and 3-gram Jaccard, Levenshtein and Jaro-Winkler on normalised text, 0.15 more for containment, 1 at most."""
    q, t = normalize_leet(query), normalize_leet(target)
    mean = 0.25 * token_jaccard(q, t) + 0.25 * ngram_jaccard(q, t) + 0.25 * levenshtein_similarity(q, t) + 0.25 * jaro_winkler_udf(q, t)
    within = F.when(q.contains(t) | t.contains(q), 0.15).otherwise(0.0)
    return F.when((q == "") | (t == ""), 0.0).when(q == t, 1.0).otherwise(F.least(F.lit(1.0), mean + within))


def hash_embed(text: str, dim: int = 128) -> np.ndarray:
    """CRC-32 feature hashing of normalised text: tokens 2, bigrams 1.5, 3- and 4-grams 1, leading characters 0.5; unit length."""
    import re

    out = np.zeros(dim, np.float32)
    s = re.sub(r"[@#$%^&*_+=\[\]{};:<>?/\\|~]", " ", (text or "").lower().strip())
    s = re.sub(r"q(?!u)", "g", s.translate(str.maketrans("01345", "oieas")))
    s = re.sub(r"\s+", " ", s).strip()
    if not s:
        return out
    words = re.findall(r"\b\w+\b", s)
    marked = f"^{s}$"
    grams = [g for n in (3, 4) for g in {marked[i : i + n] for i in range(max(1, len(marked) - n + 1))}]
    weighted = [(w, 2.0) for w in words] + [("_".join(p), 1.5) for p in zip(words, words[1:], strict=False)] + [(g, 1.0) for g in grams]
    for feature, weight in weighted:
        out[zlib.crc32(feature.encode()) % dim] += weight
    for i, c in enumerate(s[:32]):
        out[(zlib.crc32(c.encode()) % dim + 31 * i) % dim] += 0.5
    norm = float(np.linalg.norm(out))
    return out / norm if norm > 1e-9 else out


@F.pandas_udf(ArrayType(FloatType()))
def hash_embed_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: hash_embed(x or "").tolist())


def hashed_tfidf_features(text: str) -> list[str]:
    """Tokens and 3-grams of the squeezed text, as the 512-d summary embedder hashes them."""
    import re

    s = re.sub(r"([a-z])([A-Z])", r"\1 \2", text or "")
    s = re.sub(r"([0-9])([A-Za-z])", r"\1 \2", s)
    s = re.sub(r"([a-zA-Z])([0-9])", r"\1 \2", s)
    squeezed = re.sub("[^a-z0-9]", "", (text or "").lower())
    return re.findall("[a-z0-9]+", s.lower()) + [f"3g:{squeezed[i : i + 3]}" for i in range(len(squeezed) - 2)]


class HashedTfidf:
    """512-d hashed TF-IDF over a small dimension table (class or property summaries), with CRC-32 for the hash."""

    def __init__(self, texts: list[str], dim: int = 512):
        self.dim = dim
        seen = np.zeros(dim)
        for t in texts:
            seen[list({self._slot(f) for f in hashed_tfidf_features(t)})] += 1
        self.idf = np.where(seen > 0, np.log((1 + max(len(texts), 1)) / (1 + seen)) + 1, 1.0)
        self.rows = np.stack([self.encode(t) for t in texts]) if texts else np.zeros((0, dim))

    def _slot(self, feature: str) -> int:
        return zlib.crc32(feature.encode()) % self.dim

    def encode(self, text: str) -> np.ndarray:
        out = np.zeros(self.dim)
        for f in hashed_tfidf_features(text):
            out[self._slot(f)] += 1
        out *= self.idf
        norm = np.linalg.norm(out)
        return out / norm if norm > 1e-8 else out


def noisy_or(table: Column, text: Column, axioms_hold: Column, alpha: float = 0.05) -> Column:
    """Fused confidence: 1 - (1 - t)(1 - x), one side alone as it is, none 0.5; alpha more if the axioms hold; within [0, 1]."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    t, x = clip(table), clip(text)
    base = F.when((t > 0) & (x > 0), 1 - (1 - t) * (1 - x)).when(t > 0, t).when(x > 0, x).otherwise(0.5)
    return clip(base + F.when(axioms_hold, alpha).otherwise(0.0))
