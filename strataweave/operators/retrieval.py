"""Search over a small dimension (entities, classes, properties) and over stored vectors. Distinct queries are scored once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.normalize import char_ngrams, normalize_leet, tokens
from strataweave.functions.similarity import cosine, hash_embed_udf, lexical_score, seq_ratio_udf

ALPHA, BETA = 0.6, 0.4


def hybrid_search(queries: DataFrame, entities: DataFrame, top_k: int = 10, type_filter: str | None = None, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """queries(query) x entities(iri, label, aliases, types) -> (query, rank, iri, label, types, score, dense_score, lexical_score).

    Equal normalised spelling gives 0.95 at least. Every distinct query is scored against every entity: entities are a
    dimension, broadcast if their counted rows allow it. The best ``top_k`` of a query are picked by a ranked window that prunes before its shuffle.
    """
    if type_filter is not None:
        entities = entities.filter(F.exists("types", lambda t: F.lower(t).contains(type_filter.lower())))
    asked = queries.select("query").distinct().filter(F.trim("query") != "").withColumn("q_vec", hash_embed_udf("query"))
    known = entities.select("iri", "label", "aliases", "types").withColumn("e_vec", hash_embed_udf("label")).withColumn("target", F.explode(F.array_distinct(F.concat(F.array("label"), "aliases"))))
    pairs = asked.crossJoin(dimension(known)).withColumn("lex", lexical_score(F.col("query"), F.col("target")))
    same = normalize_leet(F.col("query")) == normalize_leet(F.col("target"))
    best = pairs.groupBy("query", "iri", "label", "types", "q_vec", "e_vec").agg(F.max("lex").alias("lexical_score"), F.max(same).alias("same"))
    near = cosine(F.col("q_vec"), F.col("e_vec"))
    best = best.withColumn("dense_score", F.when(near < 0, (near + 1) / 2).otherwise(near))
    score = alpha * F.col("dense_score") + beta * F.col("lexical_score")
    best = best.withColumn("score", F.when(F.col("same"), F.greatest(score, F.lit(0.95))).otherwise(score))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "iri")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return best.select("query", "rank", "iri", "label", "types", "score", "dense_score", "lexical_score")


#: Queries whose vectors a task holds at once, and rows of a dimension that may be broadcast.
QUERY_BLOCK, DIMENSION = 4096, 2_000_000
#: Queries and vectors of one product: 4 MB of scores.
TILE = 512, 1024


def dimension(df: DataFrame) -> DataFrame:
    """A dimension marked for broadcast if its counted rows allow it; a larger one is left to a shuffled product."""
    return F.broadcast(df) if df.count() <= DIMENSION else df


def knn(vectors: DataFrame, queries: DataFrame, top_k: int = 10, where: str | None = None) -> DataFrame:
    """Exact k nearest by cosine: vectors(id, vec), queries(qid, qvec) -> (qid, rank, id, score), ties by id.

    The filter runs before scoring. Queries go out in blocks of about QUERY_BLOCK, each with a scan of its own: a task
    multiplies tiles of vectors with tiles of one block and keeps its best ``top_k`` per query; only those are shuffled
    and ranked. What the driver and a task hold does not grow with the number of queries or vectors. Scores equal to
    nine places tie.
    """
    if where is not None:
        vectors = vectors.filter(where)
    vectors, queries = vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).filter("vec is not null"), queries.select("qid", "qvec")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    own = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    best = None
    for i in range(blocks):
        found = vectors.mapInArrow(_nearest_of(queries.filter(own == i).orderBy("qid").collect(), top_k), "qid long, id long, score double")
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("qid", "rank", "id", "score")


def _nearest_of(asked: list, top_k: int):
    qids = [r.qid for r in asked]
    block = np.array([r.qvec for r in asked], np.float64).reshape(len(asked), -1)
    norms = np.linalg.norm(block, axis=1, keepdims=True)
    block = block / np.where(norms > 1e-12, norms, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per query the best so far; places not yet taken come last.
        ids, best = np.full((len(qids), top_k), np.iinfo(np.int64).max), np.full((len(qids), top_k), -np.inf)
        for whole in batches:
            for start in range(0, whole.num_rows if qids else 0, TILE[1]):
                b = whole.slice(start, TILE[1])
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = (x / np.where(n > 1e-12, n, 1.0)).T
                own = b.column("id").to_numpy()
                for at in range(0, len(qids), TILE[0]):
                    part = slice(at, at + TILE[0])
                    scores = np.clip(block[part] @ x, -1.0, 1.0)
                    rounded = np.round(scores, 9)
                    # Only rows that have a vector as good as their last one so far are ranked anew.
                    for i in np.flatnonzero(rounded.max(axis=1) >= np.round(best[part, -1], 9)):
                        near = np.flatnonzero(rounded[i] >= np.round(best[at + i, -1], 9))
                        all_ids, all_scores = np.concatenate([ids[at + i], own[near]]), np.concatenate([best[at + i], scores[i][near]])
                        keep = np.lexsort((all_ids, -np.round(all_scores, 9)))[:top_k]
                        ids[at + i], best[at + i] = all_ids[keep], all_scores[keep]
        for at in range(0, len(qids), TILE[0]):
            part = slice(at, at + TILE[0])
            i, k = np.nonzero(np.isfinite(best[part]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(qids[part], np.int64)[i]), pa.array(ids[part][i, k]), pa.array(best[part][i, k])], names=["qid", "id", "score"])

    return run


def tfidf_weights(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """docs(id, text) -> (id, token, w): unit-length TF-IDF with smoothed idf over ``corpus`` (default: docs themselves)."""
    base = docs if corpus is None else corpus
    n_docs = base.agg(F.count("*").alias("n"))
    df = base.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    tf = docs.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    w = tf.join(df, "token", "left").join(F.broadcast(n_docs)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("w"))


def tfidf_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, cosine) of rows that share a token; left and right as from tfidf_weights."""
    l, r = left.select(F.col("id").alias("a"), "token", F.col("w").alias("wa")), right.select(F.col("id").alias("b"), "token", F.col("w").alias("wb"))
    return l.join(r, "token").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def statistical_match(mentions: DataFrame, vocabulary: DataFrame, least: float = 0.55) -> DataFrame:
    """Baseline linking: mentions(text) x vocabulary(id, text, uri) -> (text, uri, score): 0.40 TF-IDF + 0.35 3-gram Jaccard
    + 0.25 sequence ratio; under ``least`` a minted unknown IRI."""
    skip = F.lower(F.trim("text")).isin("false", "true", "n", "y", "-", "n/a", "none", "null", "") | F.trim("text").rlike("^[0-9]+$") | (F.length(F.trim("text")) > 80)
    asked = mentions.select(F.trim("text").alias("text")).distinct().filter(~skip).withColumn("id", F.xxhash64("text"))
    cos = tfidf_cosine(tfidf_weights(asked, vocabulary), tfidf_weights(vocabulary.select("id", "text")))
    pairs = asked.crossJoin(dimension(vocabulary.select(F.col("id").alias("b"), F.col("text").alias("label"), "uri")))
    pairs = pairs.join(cos.withColumnRenamed("a", "id"), ["id", "b"], "left")
    x, y = char_ngrams(F.col("text")), char_ngrams(F.col("label"))
    jac = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    score = 0.40 * F.coalesce("cosine", F.lit(0.0)) + 0.35 * jac + 0.25 * seq_ratio_udf(F.lower("text"), F.lower("label"))
    best = pairs.withColumn("score", score).groupBy("text").agg(F.max_by(F.struct("uri", "score"), F.struct("score", "label")).alias("b"))
    slug = F.lower(F.regexp_replace(F.regexp_replace("text", r"(?U)\W+", "_"), "^_+|_+$", ""))
    return best.select("text", F.when(F.col("b.score") >= least, F.col("b.uri")).otherwise(F.concat(F.lit("urn:strataweave:unknown/"), slug)).alias("uri"), F.col("b.score").alias("score"))
