"""The stream's conflicts equal the batch's on a shuffled replay."""

import random
from datetime import date, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from tallywood.operators import conflicts
from tallywood.streaming import conflicts as streaming
from tallywood.streaming.conflicts import OUTPUT, streaming_conflicts

SCHEMA = "subject string, concept string, fact_id long, obs_date date, value double, unit string, document_id long, confidence double"


def test_a_shuffled_replay_equals_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["hb", "mcv", "other"]), i, date(2026, 1, 1) + timedelta(days=rng.randint(0, 120)), rng.choice([9.0, 9.2, 9.6, 12.0, 12.5, 30.0, None]), "u", rng.choice([1, 2, 3, None]), 0.9) for i in range(240)]
    rules = spark.createDataFrame([("hb", 0.5, None, 2), ("mcv", None, 0.1, 4)], "concept string, abs_limit double, rel_limit double, window_days int")
    batch = conflicts.numeric_conflicts(spark.createDataFrame(rows, SCHEMA), rules)
    names = [x.split(" ")[0] for x in OUTPUT.split(", ")]
    want = sorted((tuple(r) for r in batch.select(*names).collect()), key=str)
    assert len(want) > 20
    rng.shuffle(rows)
    flush = [("end", "end", 900 + k, date(2040 + k, 1, 1), 1.0, "u", 1, 0.9) for k in range(2)]
    for k, part in enumerate([rows[:90], rows[90:170], rows[170:], flush[:1], flush[1:]]):
        spark.createDataFrame(part, SCHEMA).withColumn("obs_time", F.to_timestamp("obs_date")).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "part=0")).schema
    (tmp_path / "stream").mkdir()
    for k in range(5):  # a replay that stops and goes on from its checkpoint
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))
        for file in (tmp_path / "in" / f"part={k}").glob("*.parquet"):
            file.rename(tmp_path / "stream" / f"{k}-{file.name}")
        query = streaming_conflicts(source, rules, "4000 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*names).collect()), key=str)
    assert got == want


class Store:
    """A handle of one key whose every call is counted: each is a message to Spark."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Times:
    def __init__(self, passed):
        self.passed = passed

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_a_key_of_many_facts_takes_few_calls_of_the_store(monkeypatch):
    monkeypatch.setattr(streaming, "CHUNK", 300)
    store, made = Store(), streaming.EpisodeConflicts({"hb": (0.5, None, 2)})
    made.init(store)
    fact = Row("fact_id", "day", "value", "document_id")
    rows = [fact(i, 10 + i % 3, float("nan") if i % 100 == 0 else float(i % 7), i % 5) for i in range(1000)] + [fact(2000 + i, 30, 1.0 + i, i) for i in range(2)]
    assert list(made.handleInputRows(("p", "hb"), iter(rows[::2]), Times(0))) == [] == list(made.handleInputRows(("p", "hb"), iter(rows[1::2]), Times(0)))
    assert store.calls <= 8 and min(store.timers) == 13 * streaming.DAY_MS
    assert list(made.handleExpiredTimer(("p", "hb"), Times(14 * streaming.DAY_MS), None)) == [] and 15 * streaming.DAY_MS in store.timers
    got = list(made.handleExpiredTimer(("p", "hb"), Times(20 * streaming.DAY_MS), None))
    assert len(got) == 8 * 7 // 2 and {r.episode for r in got} == {1} and sum(1 for r in got if r.left_value != r.left_value or r.right_value != r.right_value) == 7
    last = list(made.handleExpiredTimer(("p", "hb"), Times(40 * streaming.DAY_MS), None))
    assert [(r.episode, r.left_id, r.right_id) for r in last] == [(2, 2000, 2001)] and not any(store.rows[0][0])
    assert store.calls <= 20
