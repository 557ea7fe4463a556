"""First rows by order over several batches, equal to the batch operator; timers; order texts."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentika.operators.selection import dedup_keep_first
from sentika.streaming import arrivals as Y
from sentika.streaming.streams import run_available

SCHEMA = "id string, feed_rank int, at timestamp, text string, batch string"
ORDER = [("feed_rank", False), ("at", True), ("text", False)]


def write_batches(spark, path, batches):
    for i, rows in enumerate(batches):
        # files are read in the order of their times
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return path


def drained(spark, path, horizon, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    renamed = stream.withColumnRenamed("batch", "note")
    out = run_available(Y.stream_first(renamed, horizon, "id", "at", ORDER, **more), "first", "update", timeout=120)
    return out, Y.last_updates(spark, out, "id")


def test_equal_to_the_batch_operator(spark, tmp_path):
    rnd = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [
        (rnd.choice(["a", "b", "c", "hot", "hot", "hot", None, ""]), rnd.choice([None, 0, 1, -3]),
         start + timedelta(hours=rnd.randrange(40), microseconds=rnd.randrange(3)), rnd.choice([None, "", "x", "é", '"q"\n']), "n")
        for _ in range(90)
    ]
    path = write_batches(spark, str(tmp_path / "in"), [rows[i : i + 30] for i in (0, 30, 60)])
    out, got = drained(spark, path, timedelta(days=3))
    assert spark.read.parquet(out).select("batch").distinct().count() > 1
    renamed = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("batch", "note")
    want = dedup_keep_first(renamed, "id", [F.col("feed_rank"), F.desc("at"), F.col("text")])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_key_ends_with_its_timer(spark, tmp_path):
    start = datetime(2024, 1, 1)
    days = [start, start + timedelta(days=10), start + timedelta(days=20), start + timedelta(days=21)]
    batches = [
        [("a", 0, days[0], "old", "n")],
        [("b", 0, days[1], "b", "n")],
        [("c", 0, days[2], "c", "n")],
        [("a", 9, days[3], "new", "n")],  # worse, but the first one was forgotten
    ]
    _, got = drained(spark, write_batches(spark, str(tmp_path / "in"), batches), timedelta(days=2))
    assert {r.id: r.text for r in got.collect()} == {"a": "new", "b": "b", "c": "c"}


def test_late_rows_and_rows_without_a_time_are_dropped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [
        [("a", 0, start + timedelta(days=30), "a", "n"), ("none", 0, None, "x", "n")],
        [("b", 0, start + timedelta(days=40), "b", "n")],
        [("late", 0, start, "late", "n"), ("c", 0, start + timedelta(days=40), "c", "n")],
    ]
    _, got = drained(spark, write_batches(spark, str(tmp_path / "in"), batches), timedelta(days=90), lateness="1 day")
    assert {r.id for r in got.collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("down", [False, True])
def test_numbers_sort_as_texts(spark, down):
    values = [None, 0, 1, -1, 9, 10, -10, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    made = rows.select("v", Y.sortable(F.col("v"), T.LongType(), down).alias("s"))
    by_value = [r.v for r in made.orderBy(F.desc("v") if down else F.col("v")).collect()]
    assert [r.v for r in sorted(made.collect(), key=lambda r: r.s)] == by_value


def test_orders_without_a_text_form(spark):
    for kind, down in ((T.StringType(), True), (T.DoubleType(), False)):
        with pytest.raises(ValueError):
            Y.sortable(F.lit("x"), kind, down)


class State:
    """What the processor sees of Spark's state."""

    def __init__(self):
        self.value, self.timer, self.now, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)
    getCurrentWatermarkMs = lambda self: self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.timer = None

    def setTimeoutTimestamp(self, timer):
        assert timer >= self.now
        self.timer = timer


def frame(rows):
    return pd.DataFrame(rows, columns=["__key", "__order", "__row", "__ms"])


def test_keys_of_a_group_share_a_call_and_keep_their_own_timers():
    """Against one plain state a key: the best row, the end set by the first arrival, the timer."""
    rnd = random.Random(8)
    run, state, plain, calls, updates = Y._keep_best(50), State(), {}, 0, 0
    long = ["1" + "x" * 40 + c for c in "abc"]
    for _ in range(400):
        state.now += rnd.choice([0, 0, 10, 30])
        rows = []
        for _ in range(rnd.choice([0, 0, 1, 2, 9])):
            rank = [rnd.choice(["0", "1007"]), rnd.choice([*long, "1", "1x", "0"])]
            rows.append((rnd.choice(["a", "b", "c", "", None]), json.dumps(rank), rnd.choice('"é'), state.now + rnd.randrange(30)))
        want = {}
        for key, order, row, time in rows:
            own = plain.setdefault(key, {"best": None, "until": time + 50})
            if own["best"] is None or (json.loads(order), row) < own["best"]:
                own["best"], want[key] = (json.loads(order), row), row
        for key in list(plain):
            if key in {r[0] for r in rows}:
                plain[key]["timer"] = max(plain[key]["until"], state.now + 1)
            elif plain[key]["timer"] < state.now:
                del plain[key]
        state.hasTimedOut = not rows and state.timer is not None and state.timer < state.now
        if rows or state.hasTimedOut:
            cut = rnd.randrange(len(rows) + 1)
            got = [r for out in run((0,), iter([frame(rows[:cut]), frame(rows[cut:])]), state) for r in out["row"]]
            assert sorted(got) == sorted(want.values())
            calls, updates = calls + 1, updates + len(got)
        held = dict(zip(state.value[0], state.value[3:][0])) if state.exists else {}
        assert held == {k: v["until"] for k, v in plain.items()}
    assert updates > calls > 100


def test_kept_rows_are_compressed():
    state, row = State(), json.dumps({"text": "a text of some words " * 200})
    list(Y._keep_best(50)((0,), iter([frame([(str(k), json.dumps(["0", "1" + row]), row, 0) for k in range(64)])]), state))
    assert len(state.value[0]) == 64 and sum(map(len, state.value[2])) < 64 * len(row) / 4
