"""The incremental path gives what the batch path gives."""

from pyspark.sql import functions as F

from strataweave.operators.profile import column_stats
from strataweave.streaming import triples as T


def test_windowed_activity(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 3.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = T.windowed_activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n, r.total) for r in spark.sql("select * from activity").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_profile_batches(spark, tmp_path):
    spark.range(5).selectExpr("cast(id as string) as a").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string").parquet(str(tmp_path / "in"))
    seen = []
    q = T.profile_batches(stream, lambda stats, i: seen.extend(stats.select("column_name", "cardinality").collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [(r.column_name, r.cardinality) for r in seen] == [("a", 5)]
    assert column_stats(spark.range(5).selectExpr("cast(id as string) as a")).first().cardinality == 5


def test_emitted_stream_equals_the_batch(spark, tmp_path):
    """Columns of disjoint domains clash in a row; the stream needs no join with itself to tell."""
    from strataweave.operators import emit as E
    from strataweave.plans.interpret import Context

    rows = [(i, f"r{i}", None if i % 3 else "x", "F" if i % 2 else "O") for i in range(20)]
    spark.createDataFrame(rows, "_row long, id string, a string, b string").write.parquet(str(tmp_path / "in"))
    columns = spark.createDataFrame([(0, "id", "Entity ID"), (1, "a", "Text"), (2, "b", "Categorical")], "ordinal int, column_name string, role string")
    facts = [(c, r, f"urn:{c}", c, 0.9, "Stage0-Exact", False, d, []) for c, r, d in (("id", "Entity ID", []), ("a", "Text", ["urn:A"]), ("b", "Categorical", ["urn:B"]))]
    predicates = spark.createDataFrame(facts, "column_name string, role string, uri string, label string, confidence double, method string, review_flag boolean, domains array<string>, ranges array<string>")
    context = Context(columns, predicates, "id", None, spark.createDataFrame([], "sibling string, anchor string"), [("b", "urn:link")])
    concepts = spark.createDataFrame([("F", "urn:Filled", 0.98, "Concept-StringMatch")], "value string, uri string, confidence double, method string")
    disjoint = spark.createDataFrame([("urn:A", "urn:B"), ("urn:B", "urn:A")], "a string, b string")
    batch = E.emit(spark.read.parquet(str(tmp_path / "in")), "_row", columns, predicates, "id", context.sibling, concepts, disjoint).unionByName(E.links(spark.read.parquet(str(tmp_path / "in")), "_row", "id", context.links))
    want = sorted(map(str, batch.collect()))
    stream = spark.readStream.schema("_row long, id string, a string, b string").parquet(str(tmp_path / "in"))
    q = T.emit_stream(stream, "_row", context, concepts, disjoint).writeStream.outputMode("append").format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("select * from emitted").collect())) == want
    assert sum("Row_Type_Conflict" in x for x in want) == 2 * 7
