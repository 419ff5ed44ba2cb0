import random
import shutil

import pytest
from pyspark.sql import functions as F

from textlake.streaming import keyed as K


def written(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/tmp{i}")
        (own,) = [f for f in (path / f"tmp{i}").iterdir() if f.name.endswith(".parquet")]
        (path / "in").mkdir(exist_ok=True)
        shutil.move(str(own), path / "in" / f"{i:03}.parquet")


def ran(spark, path, schema, build, checkpoint="cp"):
    """One file a batch, to the end of what there is."""
    rows = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in")))
    query = rows.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.read.schema(rows.schema).parquet(str(path / "out")).collect()]


EVENTS = "user_id long, at long, event_id long"


def bucket(rows):
    rows = rows.withColumn("micros", F.col("at") * 1_000_000)
    return K.keyed(rows, "user_id", F.timestamp_seconds("at"), F.col("event_id"), ["event_id", "micros"], K.TokenBucket(0.1, 2.0), "50 seconds", 10_000)


def allowed(events, rate=0.1, burst=2.0):
    level, last, out = {}, {}, set()
    for u, t, e in sorted(events, key=lambda x: (x[0], x[1], x[2])):
        own = min(burst, level.get(u, burst) + (t - last.get(u, t)) * rate)
        out.add((u, e, own >= 1.0))
        level[u], last[u] = own - 1.0 if own >= 1.0 else own, t
    return out


@pytest.mark.parametrize("cuts", [1, 4])
def test_buckets_do_not_depend_on_batches(spark, tmp_path, cuts):
    r = random.Random(3)
    events = [(r.randrange(3), t + r.randrange(40), i) for i, t in enumerate(range(5, 605, 9))]
    size = -(-len(events) // cuts)
    batches = [events[i : i + size] for i in range(0, len(events), size)] + [[(9, 5000, 999)]]  # a last row moves the watermark on
    written(spark, tmp_path, batches, EVENTS)
    got = {(u, e, a) for u, e, a, _ in ran(spark, tmp_path, EVENTS, bucket)}
    assert got - {(9, 999, True)} == allowed(events)


def test_a_restarted_query_goes_on_from_its_checkpoint(spark, tmp_path):
    events = [(1, 10 * i + 5, i) for i in range(20)] + [(2, 7 * i + 5, 100 + i) for i in range(20)]
    events.sort(key=lambda e: e[1])
    written(spark, tmp_path, [events[:15]], EVENTS)
    first = ran(spark, tmp_path, EVENTS, bucket)
    written(spark, tmp_path / "more", [], EVENTS)
    spark.createDataFrame([*events[15:], (9, 9000, 999)], EVENTS).coalesce(1).write.parquet(str(tmp_path / "rest"))
    (own,) = [f for f in (tmp_path / "rest").iterdir() if f.name.endswith(".parquet")]
    shutil.move(str(own), tmp_path / "in" / "900.parquet")
    both = ran(spark, tmp_path, EVENTS, bucket)
    assert len(first) < len(both)
    assert sorted((u, e, a) for u, e, a, _ in both if u != 9) == sorted(allowed(events))


def test_idle_keys_are_closed_and_forgotten(spark, tmp_path):
    schema = "conv_id long, at long, piece string"
    batches = [[(1, 4, "Hello，wor"), (1, 5, "ld"), (2, 4, "x" * 130)], [(1, 6, "！ tail"), (2, 7, "end")], [(3, 500, "a。"), (1, 600, "new")], [(4, 9000, "z")]]
    written(spark, tmp_path, batches, schema)
    build = lambda rows: K.keyed(rows, "conv_id", F.timestamp_seconds("at"), F.lit(0), ["piece"], K.Clauses(clean=str.strip), "10 seconds", 100)
    got = sorted(ran(spark, tmp_path, schema, build))
    assert got == [(1, 0, "Hello，"), (1, 0, "new"), (1, 1, "world！"), (1, 2, "tail"), (2, 0, "x" * 130), (2, 1, "end"), (3, 0, "a。")]


def test_evictions_move_the_cursor(spark):
    fold = K.Evictions(10, cursor=2)
    state, out = fold.start(), []
    for turn, tokens in enumerate([4, 4, 4, 20, 1]):
        out += fold.step(state, turn, {"turn": turn, "tokens": tokens})
    assert out == [(0, 4, 8, 1), (1, 4, 24, 0), (2, 4, 20, 0), (3, 20, 1, 0)]


def test_a_key_has_one_timer_for_the_rows_that_wait():
    """Not one for each time: a timer takes what is due and sets the next for what is not."""
    import pandas as pd

    from textlake.streaming.keyed import TokenBucket, _Ordered

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    class List(Value):
        def appendList(self, rows):
            self.held = (self.held or []) + rows

    timers, waiting, now = [], List(), [0]

    class Handle:
        def getListState(self, *_):
            return waiting

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            timers.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return now[0]

    own = _Ordered(TokenBucket(1.0, 2.0), 10**9, ["k", "event_id", "allowed", "level"])
    own.init(Handle())
    rows = pd.DataFrame({"at_ms": [3000, 1000, 2000], "place": [3, 1, 2], "payload": [f'{{"event_id": {i}, "micros": {i}000000}}' for i in (3, 1, 2)]})
    list(own.handleInputRows(("x",), iter([rows]), Times()))
    assert timers == [1000]
    now[0] = 2000
    out = [tuple(r) for f in own.handleExpiredTimer(("x",), Times(), None) for r in f.itertuples(index=False)]
    assert [r[1] for r in out] == [1, 2] and sorted(timers) == [1000, 3000, 2000 + 10**9]
    now[0] = 3000
    out = [tuple(r) for f in own.handleExpiredTimer(("x",), Times(), None) for r in f.itertuples(index=False)]
    assert [r[1] for r in out] == [3] and waiting.held is None
