"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import common, exact_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, suffix_dedup, token_output, tokens, warc
from strataweave.llm.common import join_group_facts, null_safe_key, running_start
from strataweave.llm.words import Words, shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, grp int, _r int"


def docs(spark, rows):
    """rows of (doc_id, text[, lang[, source]]); other columns clash with names the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", 0, "x", 1, 2) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (5, base), (6, base.replace(" ", "\n")), (7, base + " tail"), (8, words(rng, 4000)), (9, base.upper()), (10, words(rng, 3), None, None), (11, words(rng, 200), "de", "s2"), (12, words(rng, 90), None, "s2")]
    return docs(spark, rows)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.near_dedup(none).count() == 0
    assert mixing.mix_totals(none).count() == 0
    assert packing.pack(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert token_output.token_ids(none).count() == 0
    assert suffix_dedup.repeated_passages(none).count() == 0
    assert quality_classifier.score_quality(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_exact_dedup(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(rows)
    by = collections.Counter((r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in got)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, hashlib.sha256(text.encode()).hexdigest(), keep, len(ids), i == keep)] += 1
    assert by == want


def test_grace_spills_and_compares_contents(tmp_path):
    rng = random.Random(1)
    texts = [words(rng, 30).encode() for _ in range(300)]
    same = hashlib.sha256(b"one hash for all").digest()  # every content collides
    rows = [(same if i % 2 else hashlib.sha256(t).digest(), t, [i * 1000 + k // 2, 1, 1]) for i, t in enumerate(texts) for k in range(4)]
    rng.shuffle(rows)
    got = sorted((c, tuple(v)) for _, c, v in exact_dedup.grace_groups(iter(rows), 2000, str(tmp_path)))
    assert got == sorted((t, (i * 1000, 4, 2)) for i, t in enumerate(texts))


def test_drop_copies_leaves_one(spark, odd):
    kept = exact_dedup.drop_copies(odd)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd.collect()})
    assert kept.columns == odd.columns


def test_drop_copies_takes_one_of_repeated_rows(spark):
    rows = [(1, "a  b"), (1, "a b"), (2, "a b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (4, None), (None, "")]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, sha string, n int, _turn int")
    got = exact_dedup.drop_copies(d).collect()
    assert sorted(str((r.doc_id, (r.text or "").split())) for r in got) == sorted(["(1, ['a', 'b'])", "(3, ['c'])", "(None, ['d'])", "(4, [])"])


def test_a_shared_digest_is_refused(spark):
    groups = spark.createDataFrame([(bytearray(b"x"), 1, 2, 1), (bytearray(b"x"), 5, 1, 1), (bytearray(b"y"), 6, 1, 1)], "sha binary, keep_id long, n long, same long")
    with pytest.raises(ValueError):
        exact_dedup._copied(groups)
    assert exact_dedup._copied(groups.filter("keep_id <> 5"))[1] == 3


def test_group_facts_leave_no_hot_task(spark):
    for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"):
        spark.conf.set(name, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.get(name, "16"))
    try:
        rows = spark.range(60_000).select("id", F.when(F.col("id") < 20_000, F.lit(7)).when(F.col("id") >= 40_000, F.col("id")).alias("k"))
        facts = spark.createDataFrame([(7, 20_000, 14), *((i, 1, 2 * i) for i in range(40_000, 50_000))], "k long, n long, fact long")
        out = join_group_facts(rows.withColumn("k", F.col("k").cast("long")), facts, "k", "n", 60_000, limit=0)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 60_000 and max(tasks) < 2 * 60_000 / 16
        wrong = out.filter("not (fact <=> case when k = 7 then 14 when k < 50000 then 2 * k end)").count()
        assert wrong == 0
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_starts(spark):
    rng = random.Random(3)
    rows = [(of, at, rng.randint(0, 9)) for of in (None, "a", "b") for at in rng.sample(range(20_000), 900)]
    got = {(r.of, r.at): r.start for r in running_start(spark.createDataFrame(rows, "of string, at long, v long"), "of", "at", "v", "start").collect()}
    for of in (None, "a", "b"):
        total = 0
        for _, at, v in sorted(r for r in rows if r[0] == of):
            assert got[of, at] == total
            total += v


def test_null_safe_keys_are_one_to_one(spark):
    rows = [("a|vb", "c"), ("a", "b|vc"), (None, "n"), ("n", None), (None, None), ("", None), ("1:a", ""), ("", "1:a"), ("", "")]
    got = spark.createDataFrame(rows, "x string, y string").select(null_safe_key(F.col("x"), F.col("y")).alias("k")).collect()
    assert len({r.k for r in got}) == len(rows)


def _sets(rows):
    out = []
    for t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    return out


def _components(ids, sets, percent):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(ids[a]), top(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_rows():
    rng = random.Random(11)
    rows = []
    for g in range(6):  # families whose members drift: chains, misses just under the threshold, subsets
        w = words(rng, rng.choice([60, 150, 400])).split()
        for k in range(14):
            v = list(w)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                v[rng.randrange(len(v))] = words(rng, 1)
            if rng.random() < 0.3:
                v = v[: -rng.randint(1, len(v) // 8)]
            rows.append((g * 100 + k, " ".join(v)))
            if k % 4 == 0:
                w = v
    return rows + [(900, "a b"), (901, "A  B"), (902, None), (903, ""), (904, " "), (905, "a b c")]


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_near_dedup_matches_all_pairs(spark, threshold):
    rows = near_rows()
    ids = [i for i, _ in rows]
    sets = _sets([t for _, t in rows])
    want = _components(ids, sets, round(100 * threshold))
    got = near_dedup.near_dedup(docs(spark, rows), threshold).collect()
    assert {r.doc_id: r.n_shingles for r in got} == dict(zip(ids, map(len, sets), strict=True))
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(ids) - 20


@pytest.mark.parametrize("base_too", [True, False])
def test_near_dedup_of_a_large_family(spark, base_too):
    """3,000 rows, 1,000 of them edits of one text that mostly miss the threshold pair by pair."""
    rng = random.Random(17)
    base = words(rng, 150).split()
    rows = [(5000, " ".join(base))] if base_too else []
    for i in range(1000):
        v = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 14])):
            v[at] = words(rng, 1)
        rows.append((i, " ".join(v)))
        if i % 50 == 0:  # a second text drifts off one member
            v[rng.randrange(150)] = "other"
            rows.append((10_000 + i, " ".join(v)))
    rows += [(20_000 + i, words(rng, rng.randint(5, 60))) for i in range(2000)]
    ids = [i for i, _ in rows]
    sets = _sets([t for _, t in rows])
    want = _components(ids[: len(rows) - 2000], sets, 85)
    got = near_dedup.near_dedup(docs(spark, rows), 0.85).collect()
    assert {r.doc_id: r.component_id for r in got} == want | {i: i for i in ids[len(rows) - 2000 :]}
    assert len(set(want.values())) > 100


def test_near_dedup_blocks_of_cells(spark, monkeypatch):
    rng = random.Random(23)
    base, rows = words(rng, 100).split(), []
    for i in range(120):
        v = list(base)
        for at in rng.sample(range(100), rng.randint(3, 6)):
            v[at] = words(rng, 1)
        rows.append((i, " ".join(v)))
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "CHUNK", 5)
    got = near_dedup.near_dedup(docs(spark, rows), 0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == _components([i for i, _ in rows], _sets([t for _, t in rows]), 80)


def test_near_dedup_of_one_id_with_two_texts(spark):
    rng = random.Random(29)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(3, a + " tail"), (5, a), (5, b), (9, b + " tail"), (5, a)]
    got = near_dedup.near_dedup(docs(spark, rows)).collect()
    keys = {r.text: r.key for r in docs(spark, rows).select("text", F.xxhash64("text").alias("key")).collect()}
    by = {(r.doc_id, r.text_key): (r.component_id, r.kept) for r in got}
    assert by == {(3, keys[a + " tail"]): (3, True), (5, keys[a]): (3, False), (5, keys[b]): (5, True), (9, keys[b + " tail"]): (5, False)}
    odd = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, text_key int, row int")
    assert sorted((r.doc_id, r.text == b) for r in near_dedup.drop_near_copies(odd).collect()) == [(3, False), (5, True)]


def test_near_dedup_odd_rows(spark, odd):
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[None] == {(None, True)} and by[4] == {(4, True)}
    assert by[6] == by[7] == by[9] == {(5, False)} and by[5] == {(5, True)}


def test_components_by_joins_and_by_one_task_agree(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    links = spark.createDataFrame([(min(p), max(p)) for p in pairs if p[0] != p[1]], "a long, b long")
    one = {tuple(r) for r in near_dedup.components(links).collect()}
    assert one == {tuple(r) for r in near_dedup.components(links, one_task=0).collect()}


def test_sketch_estimate(spark):
    rng = np.random.default_rng(2)
    for n, share in ((400, 0.9), (2000, 0.6), (60, 0.85), (3, 1.0)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: int(n * share)], rng.integers(0, 2**63, n - int(n * share), dtype=np.uint64)])
        x, y = near_dedup.sketch(np.unique(a)), near_dedup.sketch(np.unique(b))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        guess = near_dedup.joint_estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([n]), np.array([n]))[0]
        assert abs(guess - true) < 0.15
        both = near_dedup.sketch(np.union1d(a, b))
        assert (both == np.maximum(x, y)).all()  # registers merge


def test_word_hashes_follow_rows():
    import pyarrow as pa

    got = Words(pa.array(["a b", None, "", " b\x0ba ", "Ab ab"]))
    assert np.diff(got.first).tolist() == [2, 0, 0, 2, 2]
    assert got.hashes[0] == got.hashes[3] and got.hashes[1] == got.hashes[2] and got.hashes[4] != got.hashes[5]
    low = Words(pa.array(["Ab ab"]), lower=True)
    assert low.hashes[0] == low.hashes[1]
    assert len(shingle_set(low.of(0))) == 1


def _mix_truth(rows, weights=(5, 2, 1), share=1.5):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for _, t, _, s in rows:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(total.values())
    while free:
        each = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if each[s] > 2 * total[s]]
        if not over:
            target |= each
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.discard(s)
    return total, target


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(0, 400)), "en", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(150)] + [(200, None, "en", "a"), (201, "", "en", "z"), (5, "x y", "en", "b"), (5, "x y", "en", "b")]
    total, target = _mix_truth(rows)
    got = mixing.mix_totals(docs(spark, rows), block_words=64).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    taken = collections.Counter()
    for r in got:
        source = by_id[r.doc_id][3] if r.doc_id != 5 else "b" if r.size == 2 else by_id[5][3]
        assert r.source_size == total[source] or r.doc_id == 5
        assert r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 3)] += r.taken
    for s in total:
        assert any(abs(t - target[s]) < 1e-6 * max(1, target[s]) for (size, t) in [(r.source_size, r.target) for r in got if r.source_size == total[s]])
    for (_, t), n in taken.items():
        assert abs(n - t) <= 1
    again = mixing.mix_totals(docs(spark, rows), block_words=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_interleaves_and_takes_each_block_once(spark):
    sources = spark.createDataFrame([(1, 40), (2, 10), (3, 0), (4, 3)], "source_no int, n_blocks long")
    got = mixing.slot_schedule(sources).collect()
    assert sorted((r.source_no, r.block) for r in got) == sorted((s, b) for s, n in ((1, 40), (2, 10), (4, 3)) for b in range(n))
    line = [r.source_no for r in sorted(got)]
    assert len({r.slot for r in got}) == 53
    for half in (line[:26], line[26:]):
        assert abs(half.count(2) - 5) <= 2
    for s in (1, 2, 4):  # blocks come in the order of slots
        blocks = [r.block for r in sorted(got) if r.source_no == s]
        assert blocks == sorted(blocks)


def test_mix_documents_follows_totals(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(1, 300)), "en", rng.choice("abc")) for i in range(60)] + [(7, "q r s", "en", "a"), (7, "q r s", "en", "a")]
    d = docs(spark, rows)
    totals = mixing.mix_totals(d, 64)
    want, got = collections.Counter(), collections.Counter()
    for r in totals.collect():
        want[r.doc_id] += r.taken
    mixed = mixing.mix_documents(d, 64)
    assert mixed.columns == d.columns
    texts = collections.defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t)
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert any(t.startswith(r.text) for t in texts[r.doc_id]) and r.n_chars == len(r.text)
    assert got == +want


def test_mix_documents_of_equal_rows_at_the_cut(spark):
    """Of equal rows one may get words and the other none; equal rows in two sources keep their own shares."""
    rng = random.Random(2)
    for seed in range(4):
        rows = [(i, words(rng, 40), "en", "a") for i in range(6)] + [(7, "q r s", "en", "a")] * 9 + [(7, "q r s", "en", "b")] * 2 + [(8, words(rng, 30 + seed), "en", "b"), (9, None, "en", None), (10, "", "en", "c")]
        d = docs(spark, rows).withColumn("row", F.lit(1)).withColumn("size", F.lit("x")).withColumn("key", F.lit(None))
        want, got = collections.Counter(), collections.Counter()
        for r in mixing.mix_totals(d, 16).collect():
            want[r.doc_id] += r.taken
        mixed = mixing.mix_documents(d, 16)
        assert mixed.columns == d.columns
        for r in mixed.collect():
            got[r.doc_id] += len(r.text.split())
        assert got == +want
        by_source = collections.Counter()
        for r in mixed.collect():
            by_source[r.source] += len(r.text.split())
        _, target = _mix_truth(rows)
        assert all(abs(by_source[s] - t) <= 1 for s, t in target.items())


def test_the_mix_comes_in_the_order_of_slots(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, 20), "en", "abc"[i % 3]) for i in range(600)]
    mixed = mixing.mix_documents(docs(spark, rows), 40)
    line = [r.source for r in mixed.collect()]
    _, target = _mix_truth(rows)
    for tenth in range(10):  # every tenth of the output holds each source by its weight
        part = line[tenth * len(line) // 10 : (tenth + 1) * len(line) // 10]
        for s, t in target.items():
            assert abs(part.count(s) / len(part) - t / sum(target.values())) < 0.12


def test_packing(spark, odd):
    enc = tokens.encoder(tokens.default_path()).library
    ids = lambda t: [*enc.encode(t or "", add_special_tokens=False).ids, 2]
    rows = [r for r in odd.collect() if r.doc_id != 4 and r.doc_id is not None]
    d = docs(spark, [(r.doc_id, r.text) for r in rows])
    got = packing.pack(d, group_docs=4).collect()
    full = {r.doc_id: ids(r.text) for r in rows}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(full[r.doc_id])
        part = np.array(full[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in pieces.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(full[i])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_packing_balances_cost():
    rng = random.Random(8)
    lengths = [rng.randint(1, 3000) for _ in range(400)]
    cost = collections.Counter()
    size = collections.Counter()
    for _, _, n, s, _ in packing.plan_group(lengths):
        cost[s] += n + n * n / 2048
        size[s] += n
    full = [cost[s] for s in cost if size[s] == 4096]
    assert max(full) / min(full) < 2.2 and sum(size.values()) == sum(lengths)


def test_token_output(spark, odd, tmp_path):
    enc = tokens.encoder(tokens.default_path()).library
    d = odd.filter("doc_id is not null")
    got = sorted(token_output.token_ids(d).collect(), key=lambda r: r.start)
    want = sorted((r.doc_id, tuple([*enc.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in d.collect())
    at = 0
    assert [r.doc_id for r in got] == [i for i, _ in want]
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
        if r.doc_id != 4:
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    path = str(tmp_path / "orc")
    token_output.write_token_ids(d, path)
    assert {r.doc_id for r in token_output.read_token_ids(spark, path, [5, 9]).collect()} == {5, 9}


def test_token_files_are_pruned_by_id(spark, tmp_path):
    """A read of one id looks at the row groups that may hold it, not at the file."""
    rng = random.Random(3)
    rows = [(i, words(rng, 4)) for i in rng.sample(range(10**9), 12_000)]
    path = str(tmp_path / "orc")
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, place int")
    token_output.write_token_ids(d.coalesce(1), path)

    def scanned(found):
        assert len(found.collect()) == 1
        plan, names = found._jdf.queryExecution().executedPlan(), []
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            names.append(leaves.apply(i).metrics().get("numOutputRows").get().value())
        return sum(names)

    files = len(list((tmp_path / "orc").glob("*.orc")))
    assert scanned(token_output.read_token_ids(spark, path, [rows[77][0]])) <= 2 * token_output.INDEX_STRIDE
    assert token_output.read_token_ids(spark, path).count() == 12_000 and files >= 1
    missing = next(i for i in range(10**9) if i not in {r[0] for r in rows})
    assert token_output.read_token_ids(spark, path, [missing]).count() == 0


def test_token_starts_follow_ranges_and_places(spark, tmp_path):
    """Ranges are ordered as numbers, and rows of one id by where they stand."""
    path = str(tmp_path / "orc")
    rows = [(part * 10 + place // 3, part, place, list(range(place % 5 + 1))) for part in (0, 9, 10, 99_999, 100_000) for place in range(0, 9)]
    rng = random.Random(1)
    spark.createDataFrame(rng.sample(rows, len(rows)), token_output.STORED).repartition(6).write.orc(path)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output.token_summary(spark, path).collect())
    at = 0
    for (start, doc_id, n), (want_id, _, _, ids) in zip(got, rows, strict=True):
        assert (start, doc_id, n) == (at, want_id, len(ids))
        at += n


def test_encoder_is_exact():
    e = tokens.encoder(tokens.default_path())
    rng = random.Random(0)
    alphabet = "abcDEF ,.'!?0123éÜß <|>\n\t ́Σςİ漢字🙂-_@#"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>", "don't I'LL", "x" * 300]
    for t in texts:
        assert e.ids(t).tolist() == [*e.library.encode(t, add_special_tokens=False).ids, 2]


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>x</p>\r\n\r\nWARC/1.1\r\n"), (2, "http://b c", "<p>x</p>\r\n\r\nWARC/1.1\r\n"), (3, None, None), (4, "u", ""), (5, "u", "é" * 1000), (6, "u", "\n\n2 0 x\n")]
    d = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, copies string")
    got = {r.page_id: r for r in warc.archive_pages(d).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(i, got[i].record_type, got[i].refers_to) for i in range(1, 7)] == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None)]


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions(version):
    records = [("http://x/?q=a b", "text/html", b"HTTP/1.1 200 OK\r\n\r\n\nbody\n\n"), ("u", "t", b"")]
    back = list(warc.parse_arc(warc.write_arc(records, version)))
    assert back[0][0]["version"] == version and back[0][0]["url"].startswith("filedesc:") and back.pop(0)
    assert [b for _, b in back] == [r[2] for r in records] and back[0][0]["url"] == "http://x/?q=a%20b"
    assert ("checksum" in back[0][0]) == (version == "2")
    for bad in (b"no version\n", warc.write_arc(records, version)[:-9], b"filedesc://x 0 0 t 2\n7 \n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def test_blocks_are_carried_as_they_are(spark, tmp_path):
    import gzip

    page = b"<p>\xff\xfe not UTF-8</p>"
    records = [
        ("dns:x.org", "text/dns", b"20240101 x.org. 3600 IN A 192.0.2.1\n"),
        ("http://x.org/gone", "text/html", b"HTTP/1.0 404 Not Found\r\nServer: s\r\n\r\ngone"),
        ("http://x.org/lf", "text/html", b"HTTP/1.1 200 OK\nContent-Type: text/html\n\nlines\r\n\r\nend"),
        ("http://x.org/raw", "text/html", b"HTTP/1.1 200 OK\r\nContent-Length: 999\r\n\r\n" + page),
        ("http://x.org/same", "text/html", b"HTTP/1.1 203 Other\r\nX-Own: 1\r\n\r\n" + page),
        ("http://x.org/none", "text/html", b"HTTP/1.1 204 No Content\r\nA: b"),
    ]
    arc = warc.write_arc(records, "1").replace(b"http://x.org/gone 0.0.0.0", b"http://x.org/gone 192.0.2.7")
    path = str(tmp_path / "out")
    warc.convert(spark.createDataFrame([(bytearray(arc),)], "content binary"), path)
    found = {}
    for file in (tmp_path / "out").rglob("*.gz"):
        for fields, block in warc.parse_warc(gzip.decompress(file.read_bytes())):
            found[fields.get("warc-target-uri", fields["warc-type"])] = (fields, block)
    assert len(found) == 7 and found["warcinfo"][1].startswith(b"software:")
    for url, mime, block in records[:4] + records[5:]:
        fields, got = found[url]
        revisit = fields["warc-type"] == "revisit"
        assert got == (block[: len(block) - len(page)] if revisit else block)
        assert fields["warc-date"] == "2024-01-01T00:00:00Z"
    assert found["dns:x.org"][0]["warc-type"] == "resource" and found["dns:x.org"][0]["content-type"] == "text/dns"
    assert found["http://x.org/gone"][0]["warc-ip-address"] == "192.0.2.7" and "warc-ip-address" not in found["dns:x.org"][0]
    raw, same = found["http://x.org/raw"], found["http://x.org/same"]
    assert {raw[0]["warc-type"], same[0]["warc-type"]} == {"response", "revisit"}
    assert {raw[0].get("warc-refers-to"), same[0].get("warc-refers-to")} == {None, (raw if raw[0]["warc-type"] == "response" else same)[0]["warc-record-id"]}
    back = warc.read_warc(spark, path).collect()
    assert sorted(r.payload_bytes for r in back) == sorted([len(records[0][2]), 4, len(b"lines\r\n\r\nend"), len(page), len(page), 0])


def test_warc_of_repeated_and_null_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rows = [(1, "u", "x" * 900), (1, "u", "x" * 900), (None, "v", "x" * 900), (None, None, None), (7, "w", "y" * 90_000), (8, "w", "")]
    rows += [(100 + i, "u", f"page {i} " * 40) for i in range(40)]
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[1, 900, "response", None] == 2 and got[None, 900, "revisit", 1] == 1
    assert got[None, 0, "revisit", 8] == 1 and got[8, 0, "response", None] == 1 and got[7, 90_000, "response", None] == 1
    assert sum(got.values()) == len(rows)


def test_arc_files_as_rows_give_the_same_archive(spark, tmp_path):
    pages = [(i, f"http://x/{i}", f"<p>{i // 2}</p>" * 50) for i in range(30)] + [(None, None, None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.convert(warc.pages_to_arc(d), str(tmp_path / "out"))
    told = lambda rows: sorted(map(str, rows.collect()))
    assert told(warc.read_warc(spark, str(tmp_path / "out"))) == told(warc.archive_pages(d))


def test_long_blocks_are_batched_by_bytes():
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 300_000
    arc = warc._one(warc.write_arc([(f"u{i}", "text/html", block) for i in range(40)], "1"))
    most = warc.BATCH_BYTES + len(block) + 4000
    read = list(warc._from_arc(iter([arc])))
    assert sum(b.num_rows for b in read) == 41 and max(b.nbytes for b in read) <= most
    facts = {"copies": None, "to_page": None, "to_url": None, "to_date": None, "revisit": False}
    records = pa.RecordBatch.from_pylist([r | facts for b in read for r in b.to_pylist()])
    written = list(warc._to_warc(iter([records])))
    assert sum(b.num_rows for b in written) == 41 and max(b.nbytes for b in written) <= most
    assert {n for b in written for n in b.column("part").to_pylist()} == {0, 1}


def test_long_pages_are_read_few_at_a_time(spark, monkeypatch):
    import pyarrow.parquet as pq

    key, seen, paths = "spark.sql.parquet.columnarReaderBatchSize", {}, {}
    before, materialize, new_path = spark.conf.get(key), warc.materialize, common.new_path
    monkeypatch.setattr(warc, "materialize", lambda df, tag, *a, **b: seen.update({tag: int(spark.conf.get(key))}) or materialize(df, tag, *a, **b))
    monkeypatch.setattr(common, "new_path", lambda s, tag: paths.update({tag: new_path(s, tag)}) or paths[tag])
    rng = random.Random(4)
    pages = [(i, "u", rng.randbytes(1 << 20).hex()) for i in range(24)]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(i, 2 << 20, "response") for i in range(24)]
    assert seen["warc-rows"] <= 16 and seen["warc-heads"] <= 16 and spark.conf.get(key) == before
    files = [pq.ParquetFile(f).metadata for f in Path(paths["warc-rows"].removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert max(sum(g.column(i).total_compressed_size for i in range(g.num_columns)) for g in groups) <= 20 << 20


def _base_by_scan(text):
    """The contract's expressions as they stand."""
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base_against_a_plain_scan():
    rng, hit = random.Random(1), collections.Counter()
    parts = ["a", "b.c", "_", "@", "1", "12", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "%", "\n", ".0", "x@y.z", "\u0663", "+49 (30) 1", "10.0.0.1"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = _base_by_scan(text)
        assert sorted(pii.find_base(text)) == want, text
        hit.update(k for k, _, _ in want)
    assert min(hit[k] for k in range(4)) > 50


@pytest.mark.parametrize("text", ["1" * 10**6, " " * 10**6 + "[at]", "a" * 10**6 + " @", "a." * 500_000 + " at x dot y", "+1" * 300_000, "one" + "," * 10**6 + "[at]", " at" * 300_000 + " dot com", "[ " * 400_000, "a at b dot com " * 30_000])
def test_pii_scans_are_linear(text):
    began = time.time()
    pii.find_all(text)
    assert time.time() - began < 10


def test_pii_zeros_before_a_part():
    text = "1." + "0" * 5000 + ".1.1"
    assert pii.find_base(text) == [(1, 0, len(text))] and pii.find_base("1." + "0" * 5000 + "256.1.1") == []


def test_pii_maps_back():
    text = "Write to john [at] ex-ample (dot) org, bob at site dot net or jоhn＠mail.com; call plus. 10.0.0.1 and 999.1.1.1, 4111 1111 1111 1111"
    base, spans = pii.find_all(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in base] == [("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111")]
    assert [text[a:b] for k, a, b in spans if k == 0] == ["john [at] ex-ample (dot) org", "bob at site dot net", "jоhn＠mail.com"]
    card = "four one one one " + "one " * 11 + "one"
    assert [(pii.KINDS[k], card[a:b]) for k, a, b in pii.find_all(card)[1]] == [("card", card)]
    for plain in ("one of the two, three or four at the dot", "look at this dot here", "", "e-mail@"):
        assert pii.find_all(plain) == ([], [])


@pytest.mark.parametrize("gap", [",", ".", "-", "... ", " - ", ",\n", " , ", ".,-", "\u00a0"])
def test_pii_spelled_digits_with_any_separator(gap):
    said = "+" + gap.join("four nine one five one two three four five six".split())
    for text in (said, f"Call ({said})!", said.upper(), said.replace("six", "\u017f\u0131x")):
        base, spans = pii.find_all(text)
        assert base == [] and [(pii.KINDS[k], text[a:b]) for k, a, b in spans] == [("phone", text.strip("Cal ()!"))]
    assert pii.find_all(gap.join(["one"] * 6)) == ([], [])


def test_pii_filter_is_no_narrower_than_the_transducers():
    rng = random.Random(9)
    parts = [*pii.SPELLED, "\u017fix", "\u0130L", "+", "x", "at", "dot", "[", "]", "a@b", "com", "DOT", "(at)", "＠"]
    hidden = 0
    for _ in range(3000):
        likely = rng.choice([parts, list(pii.SPELLED)])
        text = "".join(rng.choice(likely) + rng.choice([" ", ",", ".", "-", "... ", "\t", "\u2003", ""][: rng.choice([1, 7, 8])]) for _ in range(rng.randint(1, 14)))
        if pii.deobfuscate(text).text != text:
            hidden += 1
            assert pii._may_hide(text), text
    assert hidden > 500


def test_pii_rows(spark, odd):
    got = pii.find_pii(odd).collect()
    assert len(got) == odd.count() and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)


def _repeat_words(w):
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_rule_counts(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "dd*", "$ ", "\t", "e\n\n", "é "]) for _ in range(rng.randint(0, 200)))) for i in range(60)] + [(100, None), (101, ""), (102, "a a a a a a")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = _repeat_words(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_outliers_by_minimum_covariance_determinant(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(60, 200)), "en", "s1") for i in range(160)]
    rows += [(1000 + i, " ".join(w + "###" for w in words(rng, 100).split()), "en", "s1") for i in range(12)]
    rows += [(2000 + i, words(rng, 100), "en", "rare") for i in range(3)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert all(not got[i].kept for i in got if 1000 <= i < 2000)
    assert sum(got[i].kept for i in got if i < 1000) >= 158
    assert all(got[i].kept for i in got if i >= 2000)  # three alike


def _mcd(x):
    """Minimum covariance determinant of rows x by concentration steps from many random starts, in plain numpy."""
    q = quality_rules
    rng, n = np.random.default_rng(0), len(x)
    h, best = int(np.ceil(n * q.KEPT_SHARE)), (np.inf, None)
    moments = lambda rows, factor: (rows.mean(0), np.cov(rows.T, bias=True) * factor + q.FLOOR * np.eye(5))
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(60):
        m, c = moments(x[rng.choice(n, 12, replace=False)], 1.0)
        for _ in range(40):
            m, c = moments(x[np.argsort(distance(m, c), kind="stable")[:h]], q.CONSISTENCY)
        best = min(best, (np.linalg.slogdet(c)[1], rng.random(), m, c), key=lambda b: b[0])
    m, c = moments(x[distance(*best[2:]) <= q.NEAR], q.NEAR_FACTOR)
    return distance(m, c)


def test_estimates_against_numpy(spark):
    """Distances come near those of a search from sixty random starts, and so do the verdicts."""
    rng = np.random.default_rng(4)
    rows = []
    for grp, n in (("g", 400), ("h", 90)):
        x = rng.normal(size=(n, 5)) @ (np.tril(rng.normal(size=(5, 5))) * 0.5) + 2.0
        x[: n // 8] += rng.normal(size=5) * 8.0
        rows += [(grp, *map(int, np.round(r * quality_rules.SCALE))) for r in x]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, grp string, x0 long, x1 long, x2 long, x3 long, x4 long")
    estimates = quality_rules.robust_estimates(d)
    got = {r.id: r.d2 for r in quality_rules._with_distance(d, estimates, ["grp"]).collect()}
    for grp in "gh":
        own = [i for i, r in enumerate(rows) if r[0] == grp]
        want = _mcd(np.array([rows[i][1:] for i in own]) / quality_rules.SCALE)
        here = np.array([got[i] for i in own])
        assert ((here <= quality_rules.CUTOFF) == (want <= quality_rules.CUTOFF)).mean() >= 0.99
        assert np.median(np.abs(here - want) / (1 + want)) < 0.15
    assert sum(got[i] > quality_rules.CUTOFF for i in range(50)) >= 48


def test_classifier_learns_and_ignores_held_out(spark):
    rng = random.Random(10)
    rows, marks = [], []
    for i in range(240):
        good = i % 3 > 0
        t = words(rng, 80) if good else " ".join(w + "***" for w in words(rng, 80).split())
        rows.append((i, t))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        marks.append((i, int(good) if not held else int(not good), 0))  # held-out labels lie: they must not be read
    d = docs(spark, [*rows, (900, None), (901, ""), (None, "x")])
    got = {r.doc_id: r for r in quality_classifier.score_quality(d, spark.createDataFrame([*marks, (5, None, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    right = sum(got[i].predicted == int(i % 3 > 0) for i in range(240))
    assert right >= 235
    assert got[900].score == got[901].score
    no_labels = quality_classifier.score_quality(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in no_labels.collect()} == {0.5}


def test_one_long_labelled_text_leaves_the_others(spark):
    rng = random.Random(10)
    good = lambda: words(rng, 80)
    bad = lambda: " ".join(w + "***" for w in words(rng, 80).split())
    rows = [(i, good() if i % 2 else bad()) for i in range(120)]
    rows = [(i, t * (12_000 if i % 10 < 2 else 1)) if i < 10 else (i, t) for i, t in rows]
    marks = [(i, i % 2, 0) for i in range(120)]
    got = {r.doc_id: r for r in quality_classifier.score_quality(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(120)) >= 115


def test_scores_are_calibrated_to_uneven_classes():
    """Of texts scored alike, about that share is good, whatever share of the labels the samples were."""
    rng = random.Random(20)
    vocabulary = [words(rng, 1) for _ in range(400)]

    def text(good):
        return " ".join(rng.choice(vocabulary[:250] if good and rng.random() < 0.62 or not good and rng.random() < 0.38 else vocabulary[150:]) for _ in range(30)).encode()

    model = quality_classifier.CompressionModel([text(True) for _ in range(800)], [text(False) for _ in range(800)], share=0.9)
    marks = [rng.random() < 0.9 for _ in range(3000)]
    scores = model.scores([text(m) for m in marks])
    assert abs(scores.mean() - 0.9) < 0.03
    order = np.argsort(scores)
    for part in np.array_split(order, 5):
        assert abs(scores[part].mean() - np.mean([marks[i] for i in part])) < 0.08


def test_repeated_passages_of_one_id_with_two_texts(spark):
    rng = random.Random(31)
    long = words(rng, 100).split()
    rows = [(1, " ".join(long[:60])), (1, words(rng, 40) + " " + " ".join(long[40:])), (2, " ".join(long[:60])), (3, words(rng, 40) + " " + " ".join(long[40:]))]
    got = sorted((r.doc_id, r.first_word, r.n_words) for r in suffix_dedup.repeated_passages(docs(spark, rows)).collect())
    assert got == [(1, 0, 60), (1, 40, 60), (2, 0, 60), (3, 40, 60)]


@pytest.mark.parametrize("least", [50, 60, 89, 120])
def test_repeated_passages_against_all_matches(spark, least):
    """Every word of a match of two texts that share one long passage is found, and no other."""
    rng = random.Random(least)
    rows, want = [], collections.defaultdict(set)
    for g in range(60):
        n = rng.choice([least - 1, least, least + 1, least + 30, 3 * least])
        passage = words(rng, n)
        for i in (2 * g, 2 * g + 1):
            before = rng.randint(0, 120)
            rows.append((i, f"{words(rng, before)} a{i} {passage} z{i} {words(rng, rng.randint(0, 120))}"))
            at = len(rows[-1][1].split(f" {passage} ")[0].split())
            if n >= least:
                want[i] |= set(range(at, at + n))
    found = collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs(spark, rows), least).collect():
        found[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    assert found == want


def test_repeated_passages(spark):
    rng = random.Random(12)
    passage = words(rng, 70).split()
    rows = []
    for i in range(12):
        before, after = words(rng, rng.randint(0, 90)).split(), words(rng, rng.randint(0, 90)).split()
        rows.append((i, " ".join(before + (passage if i % 2 else []) + after)))
    rows += [(50, "again " * 200), (51, None), (52, ""), (1, rows[1][1]), (53, " ".join(passage[:49]) + " " + words(rng, 30))]
    found = collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs(spark, rows)).collect():
        found[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    assert sorted(found) == [1, 3, 5, 7, 9, 11, 50]
    for i in (1, 3, 5, 7, 9, 11):
        w = rows[i][1].split()
        at = next(k for k in range(len(w)) if w[k : k + 70] == passage)
        assert found[i] >= set(range(at, at + 70)) and len(found[i]) <= 74
    assert len(found[50]) >= 190
