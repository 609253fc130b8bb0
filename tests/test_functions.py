"""Scalar functions against stated values and plain Python."""

import difflib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.functions import cells as C
from strataweave.functions import normalize as N
from strataweave.functions import similarity as S


def test_jaro_keeps_half_transpositions():
    assert S.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-5)
    assert S.jaro("abc", "abc") == 1.0 and S.jaro("", "x") == 0.0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-5)
    assert S.jaro("abcdef", "acbdfe") == pytest.approx(S.jaro("abcdef", "acbdfe", floored=True))


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=8), st.text("abcd ", max_size=8))
def test_jaro_is_a_similarity(a, b):
    value = S.jaro(a, b)
    assert 0.0 <= value <= 1.0
    assert value <= S.jaro_winkler(a, b) + 1e-12


def test_hash_embed_uses_crc32_and_unit_length():
    v = S.hash_embed("Plank")
    assert np.linalg.norm(v) == pytest.approx(1.0, abs=1e-5)
    assert v[zlib.crc32(b"plank") % 128] > 0
    assert not S.hash_embed("  ").any()


def test_normalisers_differ(spark):
    rows = spark.createDataFrame([("Forge_S1ot",), ("Ingred_N@me",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(N.normalize_string("t"), N.normalize_leet(F.col("t")), N.normalize_leet_mesh(F.col("t"))).collect()]
    assert got[0] == ("forges1ot", "forge siot", "forge slot")
    assert got[1] == ("ingrednme", "ingred n me", "ingred name")
    assert got[2] == (None, None, None)


def test_tokenizer(spark):
    got = spark.createDataFrame([("totalPrice_2ndItem",)], "t string").select(N.tokenize_string(F.col("t"))).first()[0]
    assert got == ["total", "price", "2", "nd", "item"]


def test_noisy_or(spark):
    rows = spark.createDataFrame([(0.90, 0.85, True), (0.80, 0.0, True), (0.0, 0.75, False), (0.70, 0.60, True)], "t double, x double, ok boolean")
    got = [r[0] for r in rows.select(S.noisy_or(F.col("t"), F.col("x"), F.col("ok"))).collect()]
    assert got == pytest.approx([1.0, 0.85, 0.75, 0.93])


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_seq_ratio_keeps_argument_order(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in (("tide", "diet"), ("diet", "tide"))]
    assert [r[0] for r in rows.select(S.seq_ratio_udf("a", "b")).collect()] == pytest.approx(want)


def test_chat_link(spark):
    rows = spark.createDataFrame([("[&AgHhdwAA]",), ("plain",)], "c string")
    assert [r[0] for r in rows.select(C.chat_link_id(F.col("c"))).collect()] == [30689, None]


def test_sentences_mask_abbreviations(spark):
    got = spark.createDataFrame([("See Vol. 2 now. It costs approx. 5g! Done",)], "t string").select(C.split_sentences(F.col("t"))).first()[0]
    assert got == ["See Vol. 2 now.", "It costs approx. 5g!", "Done"]
    assert re.match("See", got[0])
