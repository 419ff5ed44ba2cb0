import pytest
from pyspark.sql import functions as F

from textlake.sources.dual import DualTable

STEPS = ["begun", "primary written", "primary", "derived written", "done"]


def made(spark, path):
    return DualTable(spark, str(path), lambda rows: rows.select("id", F.upper("text").alias("upper")))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def fails_after(name):
    def step(at):
        if at == name:
            raise OSError(name)

    return step


@pytest.mark.parametrize("broken", STEPS)
def test_a_failure_between_the_writes_leaves_one_copy_after_a_rerun(spark, tmp_path, broken):
    table = made(spark, tmp_path / "t")
    one = spark.createDataFrame([("b",), ("a",), ("c",)], "text string").repartition(3)
    two = spark.createDataFrame([("e",), ("d",)], "text string").repartition(2)
    table.write(one, 0, F.col("text"))
    with pytest.raises(OSError, match=broken):
        table.write(two, 1, F.col("text"), step=fails_after(broken))
    assert rows_of(table.derived())[:3] == [(0, "A"), (1, "B"), (2, "C")]
    assert table.derived().count() == (5 if broken == "done" else 3)
    for _ in range(2):
        table.write(two, 1, F.col("text"))
    table.write(one, 2, F.col("text"))
    assert rows_of(table.primary().select("id", "text")) == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (5, "a"), (6, "b"), (7, "c")]
    assert rows_of(table.derived()) == [(i, t.upper()) for i, t in rows_of(table.primary().select("id", "text"))]


def test_pending_rows_are_replayed_and_everything_can_be_rebuilt(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.write(spark.createDataFrame([("a",)], "text string"), 0)
    table.write(spark.createDataFrame([], "text string"), 1)
    with pytest.raises(OSError):
        table.write(spark.createDataFrame([("b",)], "text string"), 2, step=fails_after("primary"))
    assert rows_of(table.derived()) == [(0, "A")]
    assert table.replay() == 1 and table.replay() == 0
    assert rows_of(table.derived()) == [(0, "A"), (1, "B")]
    table.derive = lambda rows: rows.select("id", F.concat("text", F.lit("!")).alias("upper"))
    table.rebuild()
    assert rows_of(table.derived()) == [(0, "a!"), (1, "b!")]
    assert made(spark, tmp_path / "none").primary() is None
    with pytest.raises(ValueError, match="id"):
        table.write(spark.createDataFrame([(1,)], "id long"), 3)


def test_a_stream_that_is_restarted_writes_each_row_once(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    for i in range(3):
        spark.createDataFrame([(f"{i}{j}",) for j in range(4)], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def batch(rows, number, broken):
        seen.append(number)
        table.write(rows, number, F.col("text"), fails_after("primary") if broken and number == 1 else lambda _: None)

    for broken in (True, False):
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(lambda rows, n, b=broken: batch(rows, n, b)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        if broken:
            with pytest.raises(Exception, match="primary"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert seen.count(1) == 2
    assert [i for i, _ in rows_of(table.derived())] == list(range(12))
    assert {t for _, t in rows_of(table.primary().select("id", "text"))} == {f"{i}{j}" for i in range(3) for j in range(4)}
