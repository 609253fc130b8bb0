"""The pipeline's stages on a small table: each works on all its predecessor kept, and its decisions take effect."""

import re

import corpus_pipeline
from strataweave.llm import mixing, near_dedup, quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.materialize(stage(spark, frames[-1], SF), "test"))
    raw, good, unique, lone, mixed, packed = frames
    assert all(f.columns == names for f in frames[:-1])
    scores = {r.doc_id: r.predicted for r in quality_classifier.score_quality(raw, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in unique.collect()} == set(first.values())
    assert {r.doc_id for r in lone.collect()} == {r.doc_id for r in near_dedup.near_dedup(unique).collect() if r.kept}
    taken = {r.doc_id: r.taken for r in mixing.mix_totals(lone).collect() if r.taken}
    got: dict[int, int] = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").encode().split())
    assert got == taken
    assert {r.doc_id for r in packed.collect()} == set(taken)


def test_stages_on_empty_tables_and_odd_rows(spark):
    """Columns of clashing names, nulls, repeated rows, blank texts; and no rows at all."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, n int, sha string, rep int, slot long, words string, size int, keep_id long"
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [rows[0], rows[0], (900, rows[1][1] + " ", "en", None, 1), (None, rows[2][1], None, "s", 2), (901, None, "en", "s", 0), (902, "", "en", "s", 0), (903, " \t", None, None, 2)]
    odd = spark.createDataFrame([(*r, "x", 1, 2, "y", 3, 4, "z", 5, 6) for r in rows], shape)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
            if name != "pack":
                assert out.columns == docs.columns
                docs = out
        texts = [" ".join(r.text.split()) for r in docs.collect()]
        taken = mixing.mix_totals(docs).count()
        assert taken == len(texts) and (out.count() > 0) == bool(texts)
    unique = corpus_pipeline.exact(spark, odd, SF).collect()
    one_space = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(one_space(r.text) for r in unique) == sorted({one_space(r[1]) for r in rows})
