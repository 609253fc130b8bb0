"""Near-duplicate detection with SetSketch registers.

Each document's set of word shingles becomes ``REGISTERS`` registers: the minimum over the set of exponentially spaced,
truncated values, kept as the whole number 1 - log_b(minimum). Registers of two sets merge by maximum, and equal ones
are the likelier the more alike the sets are. Bands of register values name buckets; documents of one bucket may be
linked. Candidates get a joint estimate of their similarity by maximum likelihood from how many registers are larger,
smaller and equal; those not clearly below the threshold are verified on their full shingle sets.

No bucket is expanded into all its pairs. Documents with equal sets are one class from the start. First every bucket's
smallest member meets the others; links are verified and components joined. Buckets that still hold more than one
component go on: overlapping ones form a group, and the group's *core* is the set of shingles that most of a few of its
members hold. Sets are then told by how they deviate from the core. With w deviations and n shingles, two sets that share
d deviations are linked exactly where slack(x) + slack(y) <= 2 (100 + p) d, slack = (100 + p) w - (100 - p) n and p the
threshold in percent. So

* a member whose slack and the least slack of the group add up to 0 or less is linked with that member outright, by its
  own count of deviations: one link per member joins all that stand near the core;
* a member cannot share more deviations than the s of its own that any other member has, which bounds the slack of
  whatever it could be linked with by reach = 2 (100 + p) s - slack. Members outside every other's reach are done.

Members that the core cannot decide are compared by their deviations, in cells of two blocks of bounded size; a cell puts
out only links between what it has not joined yet. All bucket mates are so linked or ruled out exactly. Any core gives
the same links; a good one leaves less to the cells, whose work alone grows with the square of what is undecided.

Sets are compared by 64-bit hashes of their shingles throughout, and equal sets are known by 192 bits made of those.

Memory: sketches live one document at a time, a core is made of at most ``CORE_SAMPLE`` sets, a cell holds two blocks of
deviations; what crosses the cluster per document is its registers and its band keys, and the text of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import bounded_batches, join_group_facts, materialize, pick, smaller, whole_rows
from strataweave.llm.words import Words, mix64, shingle_set

SHINGLE_WORDS = 5
#: A prime, so that (offset + j * stride) mod REGISTERS visits every register once.
REGISTERS = 131
BANDS, BAND_ROWS = 32, 4
RATE, BASE, TOP = 20.0, 1.001, 65534
#: Candidates whose likelihood estimate is this far below the threshold are not verified: about five standard errors.
SLACK = 0.15
#: Members of a group that its core is made of. They change how much the core decides, never which links are found.
CORE_SAMPLE = 48
#: Undecided members of a block, and bytes of their deviations.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Texts that are compared with one copy of a centre's text, or of a core.
CHUNK = 256
THRESHOLD = 0.8
#: Links up to this many are joined to components by one task (about 16 MB, as much as a broadcast may hold); more by joins.
ONE_TASK_LINKS = 500_000

_j = np.arange(REGISTERS + 1, dtype=np.float64)
with np.errstate(divide="ignore"):
    #: Interval j of the spaced values ends at _GAMMA[j]; the last one is open.
    _GAMMA = np.where(_j < REGISTERS, np.log1p(_j / np.maximum(REGISTERS - _j, 1e-300)), np.inf) / RATE
#: 1 - e^(-rate * width) of each interval.
_MASS = np.append(-np.expm1(-RATE * np.diff(_GAMMA[:-1])), 1.0)
_SALT = np.random.default_rng(7).integers(1, 2**63, REGISTERS, dtype=np.uint64)


def sketch(items: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a non-empty set of 64-bit hashes."""
    n = len(items)
    least = np.full(REGISTERS, np.inf)
    spread = mix64(items ^ np.uint64(0x5851F42D4C957F2D))
    stride = (spread % np.uint64(REGISTERS - 1) + np.uint64(1)).astype(np.int64)
    offset = ((spread >> np.uint64(32)) % np.uint64(REGISTERS)).astype(np.int64)
    step = min(REGISTERS, max(1, math.ceil(1.6 * REGISTERS * math.log(REGISTERS) / n)))
    at = 0
    while at < REGISTERS:
        j = np.arange(at, min(at + step, REGISTERS))
        uniform = (mix64(items[:, None] ^ _SALT[None, j]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        values = _GAMMA[j][None, :] - np.log1p(-uniform * _MASS[j][None, :]) / RATE
        slots = (offset[:, None] + j[None, :] * stride[:, None]) % REGISTERS
        np.minimum.at(least, slots.ravel(), values.ravel())
        at += step
        if at < REGISTERS and least.max() <= _GAMMA[at]:
            break  # later values all exceed every register's minimum
        step = max(1, step // 2)
    return np.clip(np.floor(1.0 - np.log(least) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def joint_estimate(larger: np.ndarray, smaller_: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likelihood estimate of the Jaccard similarity from the registers that are larger and smaller in a, and both set sizes."""
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    equal = REGISTERS - larger - smaller_
    log_b = math.log(BASE)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b

    def likelihood(jac):
        a, b = p(u - v * jac), p(v - u * jac)
        tiny = 1e-12
        return larger * np.log(a + tiny) + smaller_ * np.log(b + tiny) + equal * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    gold = (math.sqrt(5) - 1) / 2
    for _ in range(30):  # the likelihood is concave in jac
        c, d = hi - gold * (hi - lo), lo + gold * (hi - lo)
        left = likelihood(c) > likelihood(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


_SKETCHED = "doc_id long, text_key long, n_shingles long, print binary, registers binary, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band_salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        ids, n, prints, registers, bands = b.column("doc_id"), [], [], [], []
        for at in range(0, len(b), 200):
            part = Words(b.column("text").slice(at, 200), lower=True)
            for i in range(len(part)):
                s = shingle_set(part.of(i), SHINGLE_WORDS)
                n.append(len(s))
                if len(s) == 0:
                    for column in (prints, registers, bands):
                        column.append(None)
                    continue
                k = sketch(s)
                keys = band_salt.copy()
                for r in range(BAND_ROWS):
                    keys = mix64(keys ^ k[r * BANDS : (r + 1) * BANDS].astype(np.uint64))
                prints.append(np.array([np.add.reduce(mix64(s ^ np.uint64(99))), np.bitwise_xor.reduce(s), np.uint64(len(s))]).tobytes())
                registers.append(k.tobytes())
                bands.append(keys.astype(np.int64))
        yield pa.RecordBatch.from_arrays([ids, b.column("text_key"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "print", "registers", "bands"])


def _estimates(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("ra", "rb"))
            guess = joint_estimate((a > c).sum(1), (a < c).sum(1), b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
            yield b.select(["a", "b"]).filter(pa.array(guess >= floor))

    return run


def _verified(percent: int):
    """Rows sorted by centre and part, the centre's own text first: a link for each other row whose set is like enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for b in batches:
            found = []
            firsts, parts, seconds, reps = (b.column(c).to_pylist() for c in ("a", "part", "second", "rep"))
            words = Words(b.column("text"), lower=True)
            for i, key in enumerate(zip(firsts, parts, strict=True)):
                s = shingle_set(words.of(i), SHINGLE_WORDS)
                if not seconds[i]:
                    at, centre = key, s
                elif key == at:
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(s) - both):
                        found.append((key[0], reps[i]))
            if found:
                a, c = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in list(up)], pa.int64())], ["node", "comp"])


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """links(a, b), materialised -> (node, comp): smallest node reachable, for nodes with a link."""
    if links.count() <= one_task:
        return materialize(links.coalesce(1).mapInArrow(_union, "node long, comp long"), "cc-task")
    # Each pass hooks every node to its smallest neighbour, shortens the hooks, and keeps the links between different ends.
    edges, hooks = links.select("a", "b"), None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp"))
        up = materialize(up, "cc-hooks")
        while True:
            above = up.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
            up = up.join(above, F.col("comp") == F.col("_n")).select("node", F.col("_c").alias("comp"), (F.col("_c") < F.col("comp")).alias("moved"))
            up = materialize(up, "cc-hooks")
            if not up.filter("moved").limit(1).count():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        if hooks is None:
            hooks = up
        else:
            step = up.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
            hooks = materialize(hooks.join(step, F.col("comp") == F.col("_n"), "left").select("node", F.coalesce("_c", "comp").alias("comp")), "cc-all")
        for x in ("a", "b"):
            own = up.select(F.col("node").alias(x), F.col("comp").alias(f"_{x}"))
            edges = edges.join(own, x).select(*(F.col(f"_{x}").alias(x) if c == x else c for c in ("a", "b")))
        edges = materialize(edges.filter("a <> b").distinct(), "cc-edges")
    return hooks if hooks is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)


def _texts_of(wanted: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted (with a column rep), with each class's text: that of its smallest doc_id. Rows equal in both come once per row."""
    named = materialize(wanted.join(reps.select("rep", "doc", "doc_key"), "rep"), "near-wanted")
    once = texts.filter("doc_id is not null")
    return once.join(smaller(named, 60), (F.col("doc_id") == F.col("doc")) & (F.col("text_key") == F.col("doc_key"))).select(*wanted.columns, "text")


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are like enough: first by their registers, then by their texts."""
    for x in ("a", "b"):
        own = reps.select(F.col("rep").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
        pairs = pairs.join(own, x)
    likely = materialize(pairs.mapInArrow(_estimates(percent / 100 - SLACK), "a long, b long"), "near-likely")
    # Each centre's partners are dealt in parts; a part gets one copy of the centre's text.
    dealt = likely.join(likely.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts")), "a")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    seconds = dealt.select("a", "part", F.lit(True).alias("second"), F.col("b").alias("rep"))
    firsts = dealt.select("a", "part", F.lit(False).alias("second"), F.col("a").alias("rep")).distinct()
    rows = _texts_of(firsts.unionByName(seconds), reps, texts).repartition("a", "part").sortWithinPartitions("a", "part", "second")
    return materialize(rows.mapInArrow(_verified(percent), "a long, b long").distinct(), "near-links")


def _core_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the shingles that more than half of a group's rows hold."""
    grp, sets = None, []

    def made() -> pa.RecordBatch:
        items, counts = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([items[2 * counts > len(sets)].tobytes()], pa.binary())], ["grp", "core"])

    for b in batches:
        groups, words = b.column("grp").to_pylist(), Words(b.column("text"), lower=True)
        for i, g in enumerate(groups):
            if g != grp and sets:
                yield made()
                sets = []
            grp = g
            sets.append(shingle_set(words.of(i), SHINGLE_WORDS))
    if sets:
        yield made()


_DEVIATING = "grp long, rep long, w long, deviations array<long>"


def _deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and part, the core first: of each other row the shingles that it or the core has alone."""
    core, last = np.zeros(0, np.uint64), None
    for b in batches:
        out, cores = [], b.column("core")
        groups, reps = b.column("grp").to_pylist(), b.column("rep").to_pylist()
        words = Words(b.column("text"), lower=True)
        for i, rep in enumerate(reps):
            if rep is None:
                core, last = np.frombuffer(cores[i].as_py(), np.uint64), None
            elif rep != last:  # a repeated row has the same text
                own = np.setxor1d(core, shingle_set(words.of(i), SHINGLE_WORDS), assume_unique=True)
                out.append((groups[i], rep, len(own), own.astype(np.int64)))
                last = rep
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "rep", "w", "deviations"])


def _grouped(live: DataFrame) -> DataFrame:
    """live(bucket, rep, ..) -> also ``grp``: buckets that share members fall into one group, two steps far."""
    low = live.groupBy("bucket").agg(F.min("rep").alias("low"))
    own = live.select("bucket", "rep").join(low, "bucket").groupBy("rep").agg(F.min("low").alias("own"))
    grp = live.select("bucket", "rep").join(own, "rep").groupBy("bucket").agg(F.min("own").alias("grp"))
    return live.join(grp, "bucket")


def _faced(inside: DataFrame, held: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """inside(grp, rep, n, comp) -> the same with ``slack`` and ``reach`` towards its group's core; (grp, rep, w, deviations)."""
    held = materialize(held, "near-held")
    sampled = inside.groupBy("grp", F.pmod(F.xxhash64("rep"), F.lit(CORE_SAMPLE)).alias("_p")).agg(F.min("rep").alias("rep")).select("grp", "rep")
    rows = held.join(smaller(materialize(sampled, "near-sampled"), 24), "rep").select("grp", "text")
    cores = materialize(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_core_of, "grp long, core binary"), "near-cores")
    parts = inside.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = inside.join(parts, "grp").select("grp", F.pmod(F.xxhash64("rep"), "parts").alias("part"), "rep")
    members = held.join(smaller(materialize(dealt, "near-dealt"), 32), "rep").select("grp", "part", "rep", "text", F.lit(None).cast("binary").alias("core"))
    copies = cores.join(parts, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("rep"), F.lit(None).cast("string").alias("text"), "core")
    rows = members.unionByName(copies).repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("rep").asc_nulls_first())
    deviating = materialize(rows.mapInArrow(_deviations, _DEVIATING), "near-deviating")
    seen = deviating.select("grp", "rep", F.explode("deviations").alias("e")).groupBy("grp", "e").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    own = seen.filter("rep = other").groupBy("grp", "rep").agg(F.count("*").alias("own"))
    slack = (100 + percent) * F.col("w") - (100 - percent) * F.col("n")
    out = inside.join(deviating.drop("deviations"), ["grp", "rep"]).join(own, ["grp", "rep"], "left").withColumn("slack", slack)
    reach = 2 * (100 + percent) * (F.col("w") - F.coalesce("own", F.lit(0))) - F.col("slack")
    return materialize(out.select("grp", "rep", "comp", "slack", reach.alias("reach")), "near-faced"), deviating


def _undecided(faced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, rest): outright links with each group's member of least slack, and members that could have others.

    Near members are those linked outright or in that member's component already. A far one must be within mutual reach of
    a near or of another far one, a near one of a far one; reach and slack are compared with the groups' extremes.
    """
    total = faced.count()
    heads = faced.groupBy("grp").agg(F.min(F.struct("slack", "rep", "comp")).alias("h"), F.count("*").alias("n_in"))
    heads = materialize(heads.select("grp", F.col("h.rep").alias("head"), F.col("h.slack").alias("least"), F.col("h.comp").alias("head_comp"), "n_in"), "near-heads")
    rows = join_group_facts(faced, heads, "grp", "n_in", total)
    near = (F.col("slack") + F.col("least") <= 0) | (F.col("comp") == F.col("head_comp"))
    rows = materialize(rows.withColumn("near", near), "near-sides")
    links = rows.filter("slack + least <= 0 and rep <> head and comp <> head_comp").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))
    side = lambda x, is_near: F.when(F.col("near") if is_near else ~F.col("near"), F.col(x))
    bounds = rows.groupBy("grp").agg(
        F.max(side("reach", True)).alias("near_reach"), F.max(side("reach", False)).alias("far_reach"), F.min(side("slack", False)).alias("far_slack"), F.count("*").alias("n_in")
    )
    bounds = materialize(bounds.filter("far_slack is not null"), "near-bounds")
    rows = join_group_facts(rows.select("grp", "rep", "comp", "slack", "reach", "near", "least"), bounds, "grp", "n_in", total).filter("far_slack is not null")
    among_far = (F.col("slack") <= F.col("far_reach")) & (F.col("reach") >= F.col("far_slack"))
    with_near = ~F.col("near") & (F.col("slack") <= F.col("near_reach")) & (F.col("reach") >= F.col("least"))
    rest = rows.filter(among_far | F.coalesce(with_near, F.lit(False))).withColumn("comp", F.when(F.col("near"), F.lit(-1)).otherwise(F.col("comp")))
    return links, rest.select("grp", "rep", "comp", "slack")


def _cells(rest: DataFrame, deviating: DataFrame, percent: int) -> DataFrame:
    """Links between undecided members of a group: each of its blocks meets each, and itself."""
    rest = materialize(rest.join(deviating, ["grp", "rep"]), "near-rest")
    sizes = rest.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("w") * 8 / BLOCK_BYTES)).alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sizes = smaller(materialize(sizes.filter("lo < hi").select("grp", "blocks"), "near-blocks"), 24)
    dealt = rest.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "comp", "slack", "deviations")
    rows = dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    return rows.mapInArrow(_compared(2 * (100 + percent)), "a long, b long")


def _compared(unit: int):
    """Rows sorted by cell: links that join what is not joined yet."""

    def of_cell(rows: list[tuple]) -> list[tuple[int, int]]:
        block, reps, comps, slack, deviations = zip(*rows, strict=True)
        block, slack, reps = np.array(block), np.array(slack), np.array(reps)
        elements, owner = np.concatenate(deviations), np.repeat(np.arange(len(rows)), [len(d) for d in deviations])
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], owner[order]
        names = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([names[c] for c in comps])
        alone, found = (block == block[0]).all(), []
        for i in np.argsort(slack, kind="stable"):
            lo, hi = np.searchsorted(elements, deviations[i], "left"), np.searchsorted(elements, deviations[i], "right")
            sharing = owner[_ranges(lo, hi)]
            shared = np.bincount(sharing, minlength=len(rows))
            linked = (slack[i] + slack <= unit * shared) & (comp != comp[i])
            if not alone:
                linked &= block != block[i]
            for j in np.flatnonzero(linked):
                if comp[j] != comp[i]:
                    found.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
                    comp[comp == comp[j]] = comp[i]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def made() -> Iterator[pa.RecordBatch]:
            if found := of_cell(held):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            lists = b.column("deviations")
            cells = zip(*(b.column(c).to_pylist() for c in ("grp", "x", "y")), strict=True)
            facts = zip(*(b.column(c).to_pylist() for c in ("block", "rep", "comp", "slack")), strict=True)
            for i, (cell, row) in enumerate(zip(cells, facts, strict=True)):
                if cell != at and held:
                    yield from made()
                    held = []
                at = cell
                held.append((*row, lists[i].values.to_numpy()))
        if held:
            yield from made()

    return run


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers in each lo[i] .. hi[i] - 1."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())


def near_components(documents: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, reps, labels): rows with their sketch, classes of equal sets (rep: a number; doc: their smallest doc_id), and rep -> component."""
    bounded_batches(documents.sparkSession)
    percent = round(threshold * 100)
    texts = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    docs = materialize(texts.mapInArrow(_sketches, _SKETCHED), "near-sketches")
    # A class: all documents of one set. Its registers are those of any of them; its number says nothing about its ids.
    reps = docs.filter("print is not null and doc_id is not null").groupBy("print").agg(
        F.min(F.struct("doc_id", "text_key")).alias("head"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands")
    )
    reps = reps.select(F.monotonically_increasing_id().alias("rep"), F.col("head.doc_id").alias("doc"), F.col("head.text_key").alias("doc_key"), "print", "n", "n_docs", "registers", "bands")
    reps = materialize(reps, "near-classes")
    members = reps.select("rep", "n", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "rep", "n")
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n_in")).filter("n_in > 1").select("bucket")
    members = materialize(members.join(crowded, "bucket"), "near-members")
    # Round 0: the smallest member of each bucket meets the others.
    first = members.groupBy("bucket").agg(F.min(F.struct(F.col("rep").alias("a"), F.col("n").alias("_n"))).alias("c")).select("bucket", "c.*")
    alike = F.expr(f"100 * least(n, _n) >= {percent} * greatest(n, _n)")
    pairs = members.join(first, "bucket").filter("rep > a").filter(alike).select("a", F.col("rep").alias("b"))
    pairs = materialize(pairs.distinct(), "near-pairs")
    links = _links(pairs, reps, texts, percent)
    labels = components(links)
    own = labels.select(F.col("node").alias("rep"), "comp")
    live = members.join(first.select("bucket", F.col("a").alias("rep")), ["bucket", "rep"], "left_anti").join(own, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    live = materialize(live, "near-live")
    open_ = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    inside = materialize(_grouped(materialize(live.join(open_, "bucket"), "near-open")).select("grp", "rep", "n", "comp").distinct(), "near-inside")
    faced, deviating = _faced(inside, _texts_of(inside.select("rep").distinct(), reps, texts), percent)
    outright, rest = _undecided(faced)
    links = materialize(links.unionByName(outright.distinct()).unionByName(_cells(rest, deviating, percent)), "near-links-all")
    return docs, reps, components(links)


def near_dedup(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text).

    A null, empty or blank text has an empty set and is linked with nothing. Ties: the smallest doc_id names a
    component and is the one kept. Rows with a null doc_id are linked with nothing and kept (component_id null). Each
    row stands for its text's set: rows of one doc_id with different texts get the component of their own text.
    Repeated rows are alike. An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    docs, reps, labels = near_components(documents, threshold)
    total = docs.count()
    named = materialize(labels.join(reps.select(F.col("rep").alias("node"), "doc"), "node"), "near-named")
    ids = materialize(named.groupBy("comp").agg(F.min("doc").alias("component"), F.count("*").alias("n_in")), "near-ids")
    own = join_group_facts(named.select(F.col("node").alias("rep"), "comp"), ids, "comp", "n_in", total).select("rep", "component")
    facts = reps.select("print", "rep", "doc", "n_docs").join(smaller(materialize(own, "near-own"), 32), "rep", "left").withColumn("component", F.coalesce("component", "doc"))
    facts = facts.filter((F.col("n_docs") > 1) | (F.col("component") < F.col("doc")))  # all others are alone
    facts = materialize(facts.select("print", "component", "n_docs"), "near-facts")
    rows = docs.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    out = join_group_facts(rows, facts, "print", "n_docs", total)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


def drop_near_copies(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, less all but the smallest doc_id of each component.

    Rows with a null doc_id or without a word stay; of rows with one doc_id and different texts each stays or goes by its
    own text. Repeated rows stay or go together. An empty table gives an empty one. Columns of any name may stand beside
    doc_id and text.
    """
    gone = near_dedup(documents, threshold).filter("not kept").select("doc_id", "text_key").distinct()
    gone = smaller(materialize(gone, "near-gone"), 32)
    rows = whole_rows(documents).withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("text_key", F.xxhash64("row.text"))
    return rows.join(gone, ["doc_id", "text_key"], "left_anti").select("row.*")
