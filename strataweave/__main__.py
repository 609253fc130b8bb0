"""python -m strataweave interpret TABLE ONTOLOGY OUT | clauses TEXT | profile TABLE"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str]) -> int:
    if not args or args[0] not in ("interpret", "clauses", "profile"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("strataweave").getOrCreate()
    from strataweave.operators import text as T
    from strataweave.operators.emit import coverage
    from strataweave.operators.profile import column_roles, column_stats
    from strataweave.plans.interpret import table_to_triples
    from strataweave.sources import exports, rdf, tables

    if args[0] == "clauses":
        docs = tables.read_text(spark, args[1]).select(F.col("path").alias("doc_id"), "text")
        T.clauses(docs).select("clause", T.modality(F.col("clause")).alias("m")).select("m.modality", "clause").show(1000, False)
        return 0
    table = tables.read_csv(spark, args[1])
    if args[0] == "profile":
        column_roles(column_stats(table)).orderBy("ordinal").show(1000, False)
        return 0
    # A CSV file has no row key of its own: its place in the file is one, taken before anything is shuffled.
    numbered = table.withColumn(tables.ROW_ID, F.monotonically_increasing_id())
    found = table_to_triples(numbered, tables.ROW_ID, rdf.read_turtle(spark, args[2]))
    found.write.mode("overwrite").parquet(f"{args[3]}/triples")
    done = spark.read.parquet(f"{args[3]}/triples")
    rdf.write_ntriples(rdf.emitted_to_rdf(done), f"{args[3]}/ntriples")
    print(exports.coverage_markdown(coverage(done)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
