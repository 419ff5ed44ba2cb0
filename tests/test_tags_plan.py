from pyspark.sql import functions as F

from textlake.operators import tags as G


def test_documents_are_not_dealt_by_question(spark):
    """Questions are few: rows of documents meet them by broadcast, whatever size Spark takes them for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select((F.col("id") % 4).cast("string").alias("query_id"), F.col("id").alias("doc_id"), *[F.col("id").cast("double").alias(c) for c in ("dense", "sparse", "tag")])
        plan = G.fused(rows)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
