"""Streams over the append-only logs, as Structured Streaming queries.

Each takes a streaming DataFrame of answers (learner, unit, id, exercise, correct, hint_used,
answered_at) and returns one; the caller chooses the sink and the trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorecraft.operators import review as R

HORIZON = "30 days"
HORIZON_MS = 30 * R.DAY_MS
#: Learners are dealt to so many groups: a call into Python serves all of a group in a micro-batch.
GROUPS = 2048
#: Of each learner and unit of a group, side by side: TOTALS numbers about the answers before the horizon, the exercises of
#: those, and the answers within it.
TOTALS = 11
STATE = "learners array<long>, units array<int>, totals array<long>, exercises array<int>, ids array<long>, ms array<long>, own_exercises array<int>, flags array<int>"
OUTPUT = (
    "learner long, unit int, review_count long, correct_count long, incorrect_count long, no_hint_correct_count long, hint_used_count long, consecutive_no_hint_correct long, exercise_count long, last_correct boolean, "
    "last_reviewed_ms long, interval_days int, due_ms long, late long"
)


def ingested(events: DataFrame, key: list[str], horizon: str = HORIZON) -> DataFrame:
    """Each id once within the horizon; later and expired copies are dropped with the watermark."""
    return events.withWatermark("answered_at", horizon).dropDuplicatesWithinWatermark(key)


def daily_goals(events: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """(learner, day, answered): running counts of each day, in update mode."""
    days = events.withWatermark("answered_at", horizon).groupBy("learner", F.window("answered_at", "1 day")).agg(F.count("*").alias("answered"))
    return days.select("learner", F.col("window.start").cast("date").alias("day"), "answered")


def run_metrics(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """(hour, status, runs, duration) of each hour."""
    hours = events.withWatermark("answered_at", horizon).groupBy(F.window("answered_at", "1 hour"), "event_type").agg(F.count("*").alias("runs"), F.round(F.sum("duration"), 2).alias("duration"))
    return hours.select(F.col("window.start").alias("hour"), F.col("event_type").alias("status"), "runs", "duration")


def _told(totals: tuple, answers: list[tuple]) -> tuple:
    """Totals with more answers (ms, id, exercise, flags), in order of time; flags are 1 for correct and 2 for a hint."""
    reviews, correct, unhinted, hinted, streak, prior, last, last_correct, exercises = totals
    seen = set(exercises)
    for ms, _, exercise, flags in sorted(answers):
        good = flags == 1
        reviews, correct, unhinted, hinted = reviews + 1, correct + (flags & 1), unhinted + good, hinted + (flags >> 1)
        prior, streak, last, last_correct = streak, streak + 1 if good else 0, ms, bool(flags & 1)
        seen.add(exercise)
    return reviews, correct, unhinted, hinted, streak, prior, last, last_correct, sorted(seen)


def _unpacked(saved: tuple) -> dict:
    """{(learner, unit): (totals as in _told, late, answers (ms, id, exercise, flags))} of a group's state."""
    learners, units, totals, exercises, ids, ms, own, flags = saved
    out, x, a = {}, 0, 0
    for k, key in enumerate(zip(learners, units)):
        *base, last_correct, seen, late, kept = totals[k * TOTALS : (k + 1) * TOTALS]
        out[key] = (*base, bool(last_correct), exercises[x : x + seen]), late, list(zip(ms[a : a + kept], ids[a : a + kept], own[a : a + kept], flags[a : a + kept]))
        x, a = x + seen, a + kept
    return out


def _packed(held: dict) -> tuple:
    totals: list[int] = []
    exercises: list[int] = []
    answers: list[tuple] = []
    for base, late, kept in held.values():
        totals += [*base[:7], int(base[7]), len(base[8]), late, len(kept)]
        exercises += base[8]
        answers += kept
    return [k[0] for k in held], [k[1] for k in held], totals, exercises, *[[a[i] for a in answers] for i in (1, 0, 2, 3)]


def _advanced(horizon_ms: int):
    number = lambda v: None if v != v or v is None else int(v)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get) if state.exists else {}
        fresh: dict = {}
        for pdf in batches:
            for learner, unit, i, x, good, hint, ms in zip(*[pdf[c].tolist() for c in ("learner", "unit", "id", "exercise", "correct", "hint_used", "ms")]):
                fresh.setdefault((number(learner), number(unit)), []).append((int(ms), int(i), int(x), int(bool(good)) + 2 * (hint is not None and hint == True)))  # noqa: E712
        rows = []
        for own, answers in fresh.items():
            base, late, kept = held.get(own, ((0, 0, 0, 0, 0, 0, -1, False, []), 0, []))
            recent = {a[1]: a for a in kept}
            for a in answers:
                if a[0] < base[6]:
                    late += 1  # older than what is folded: told, not woven in
                else:
                    recent.setdefault(a[1], a)
            edge = max((a[0] for a in recent.values()), default=0) - horizon_ms
            base, kept = _told(base, [a for a in recent.values() if a[0] < edge]), sorted(a for a in recent.values() if a[0] >= edge)
            held[own] = base, late, kept
            reviews, correct, unhinted, hinted, streak, prior, last, last_correct, seen = _told(base, kept)
            days = R.INTERVALS[min(prior, len(R.INTERVALS) - 1)] if streak else R.INTERVALS[0]
            if reviews:
                rows.append((*own, reviews, correct, reviews - correct, unhinted, hinted, streak, len(seen), last_correct, last, days, last + days * R.DAY_MS, late))
        if fresh:
            state.update(_packed(held))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return advance


def running_mastery(events: DataFrame, horizon_ms: int = HORIZON_MS) -> DataFrame:
    """Mastery counts, streak and schedule of each learner and unit after every micro-batch that touches them.

    State holds the answers of the horizon before a unit's newest answer, and totals of older
    ones. An answer that comes late is put where it belongs in time, so files may be replayed in
    any order within the horizon; one that is older than a folded answer is counted as late. An
    id counts once within the horizon; answers that are neither right nor wrong don't count.
    Learners share GROUPS groups, as each call into Python costs more than many answers do.
    """
    # rows without a learner or unit have groups of their own: beside a null, pandas holds numbers as floats
    some = F.col("learner").isNotNull() & F.col("unit").isNotNull()
    group = F.when(some, F.pmod(F.xxhash64("learner"), F.lit(GROUPS))).otherwise(-1).alias("group")
    known = events.filter(F.col("correct").isNotNull() & F.col("ms").isNotNull() & F.col("id").isNotNull())
    own = known.select(group, "learner", "unit", "id", "exercise", "correct", "hint_used", "ms")
    return own.groupBy("group").applyInPandasWithState(_advanced(horizon_ms), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def recent_only(events: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Events no older than so many days, to the millisecond; older ones are dropped as they are written."""
    return events.filter(F.col("ms") >= now_ms - days * 86_400_000)
