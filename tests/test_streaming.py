"""Streams over the events, replayed from files, against their batch twins."""

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import review as R
from lorecraft.streaming import streams as S

SF = "/root/testdata/sf0.001"


def replayed(spark, tmp_path, parts=3):
    rv = B.review_events(spark, SF).withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    for k in range(parts):
        lo, hi = 1000 * k // parts, 1000 * (k + 1) // parts
        rv.filter((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rv, spark.readStream.schema(rv.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(spark, df, tmp_path, mode):
    name = f"out_{tmp_path.name.replace('-', '_')}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_running_mastery_equals_the_batch_in_any_order(spark, tmp_path):
    rv = B.review_events(spark, SF).withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    # the newest answers come first, and some files come twice
    for k in (3, 0, 2, 1, 3):
        rv.filter(F.floor(F.col("id") / 250) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rv.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(spark, S.running_mastery(stream), tmp_path, "update")
    names = ["review_count", "correct_count", "incorrect_count", "no_hint_correct_count", "hint_used_count", "consecutive_no_hint_correct", "exercise_count", "last_correct", "last_reviewed_ms"]
    last = got.groupBy("learner", "unit").agg(F.max_by(F.struct(*names, "due_ms"), F.struct("review_count", "last_reviewed_ms")).alias("s"), F.max("late").alias("late")).select("learner", "unit", "late", "s.*").collect()
    due = {(r.learner, r.unit): r.due for r in R.schedule(rv).groupBy("learner", "unit").agg(F.max_by("due_ms", F.struct("ms", "id")).alias("due")).collect()}
    want = {(r.learner, r.unit): (*[r[n] for n in names], due[r.learner, r.unit], 0) for r in R.mastery(rv).collect()}
    assert {(r.learner, r.unit): (*[r[n] for n in names], r.due_ms, r.late) for r in last} == want


def test_answers_beyond_the_horizon_are_counted_late(spark, tmp_path):
    rv = B.review_events(spark, SF).withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    one = rv.limit(1).withColumn("learner", F.lit(1).cast("long")).withColumn("unit", F.lit(1))
    for i, day in ((1, 10), (2, 0), (3, 20), (4, 8), (5, 15), (6, 1)):
        one.withColumn("id", F.lit(i).cast("long")).withColumn("ms", F.lit(day * R.DAY_MS)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rv.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = collected(spark, S.running_mastery(stream, 7 * R.DAY_MS), tmp_path, "update").orderBy(F.col("review_count").desc(), F.col("late").desc()).first()
    # day 0 is older than nothing that was folded; 8 and 1 come after 10 was folded
    assert (last.review_count, last.late, last.last_reviewed_ms) == (4, 2, 20 * R.DAY_MS)


def test_ingest_drops_repeats(spark, tmp_path):
    rv, stream = replayed(spark, tmp_path)
    rv.limit(100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert collected(spark, S.ingested(stream, ["learner", "id"]), tmp_path, "append").count() == 1000


def test_daily_goals(spark, tmp_path):
    rv, stream = replayed(spark, tmp_path)
    got = collected(spark, S.daily_goals(stream), tmp_path, "complete")
    want = {(r.learner, r.day): r.answered for r in R.day_state(rv).collect()}
    assert {(r.learner, str(r.day)): r.answered for r in got.collect()} == want


def test_learners_of_one_group_and_without_a_unit_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 2)
    rv = B.review_events(spark, SF).withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    odd = rv.withColumn("unit", F.when(F.col("id") % 5 != 0, F.col("unit"))).withColumn("correct", F.when(F.col("id") % 7 != 0, F.col("correct")))
    for k in range(3):
        odd.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rv.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(spark, S.running_mastery(stream), tmp_path, "update")
    names = ["review_count", "correct_count", "no_hint_correct_count", "consecutive_no_hint_correct", "exercise_count", "last_reviewed_ms"]
    last = got.groupBy("learner", "unit").agg(F.max_by(F.struct(*names), F.struct("review_count", "last_reviewed_ms")).alias("s")).select("learner", "unit", "s.*").collect()
    assert {tuple(r) for r in last} == {(r.learner, r.unit, *[r[n] for n in names]) for r in R.mastery(odd).collect()}


def test_a_call_serves_a_group_of_learners():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    rows = [(n % 40, n % 3, n, n % 4, n % 2 == 0, False, n * R.DAY_MS) for n in range(400)]
    frame = pd.DataFrame(rows, columns=["learner", "unit", "id", "exercise", "correct", "hint_used", "ms"])
    advance, state = S._advanced(5 * R.DAY_MS), State()
    parts = [next(advance((0,), iter([frame[frame["id"] % 2 == k]]), state)) for k in (0, 1)]
    assert sum(len(p) for p in parts) == len({(n % 2, n % 40, n % 3) for n in range(400)})
