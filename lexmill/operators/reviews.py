"""Spaced repetition: a recurrence over each item's reviews, in order of time.

An item's first review creates it; every later one changes its status, stability and difficulty, and sets
when it is due next. The recurrence can't be split within an item, so it is a fold over the item's sorted
reviews: `history` and `current` in Spark's own functions, `step` the same in Python for streams.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights that the review screen uses: fixed values.
WEIGHTS = (0.4, 0.6, 2.4, 5.8, 4.93, 0.94, 0.86, 0.01, 1.49, 0.14, 0.94, 2.18, 0.05, 0.34, 1.26, 0.29, 2.61)
FACTOR = {"Fail": -2.0, "Hard": -1.0, "Okay": 0.0, "Easy": 1.0}
DAY = 86400


@dataclass(frozen=True)
class Params:
    weights: Sequence[float] = WEIGHTS
    round_to_days: bool = False
    target_retention: float = 0.9
    first_interval: int = 60
    second_interval: int = 300
    third_interval: int = 600
    interval_step: int = DAY
    min_initial_stability: float = 0.1
    min_difficulty: float = 1.0
    max_difficulty: float = 10.0
    max_interval: int = 36500


DEFAULT = Params()


@dataclass
class Item:
    """State after a review; times in microseconds."""

    grade: str
    status: str
    due_at: int
    reviewed_at: int
    difficulty: float
    stability: float
    next_due: int
    extra: dict = field(default_factory=dict)


def interval(p: Params, stability: float) -> int:
    """Seconds until recall falls to the target."""
    days = 9.0 * stability * (-1.0 + 1.0 / p.target_retention)
    if p.round_to_days:
        return DAY * min(max(math.floor(days + 0.5), 1), p.max_interval)
    return math.floor(DAY * min(max(days, 1.0), float(p.max_interval)) + 0.5)


def create(p: Params, grade: str, now: int) -> Item:
    w = p.weights
    difficulty = min(max(w[4] - w[5] * FACTOR[grade], p.min_difficulty), p.max_difficulty)
    stability = max(dict(zip(FACTOR, w))[grade], p.min_initial_stability)
    wait = {"Fail": p.first_interval, "Hard": p.second_interval, "Okay": p.third_interval, "Easy": interval(p, stability)}[grade]
    return Item(grade, "Reviewing" if grade == "Easy" else "Learning", now, now, difficulty, stability, now + wait * 1_000_000)


def step(p: Params, item: Item, grade: str, now: int) -> Item:
    """The item after one more review."""
    w, s, d = p.weights, item.stability, item.difficulty
    days = int((now - item.reviewed_at) / 1_000_000 / DAY)
    recall = 1.0 / (1.0 + days / (9.0 * s))
    gain = math.exp(w[8]) * s ** -w[9] * math.expm1(w[10] * (1.0 - recall)) * (1.0 + p.max_difficulty - d)
    after = {
        "Fail": w[11] * d ** -w[12] * math.exp(w[14] * (1.0 - recall)) * ((1.0 + s) ** w[13] - 1.0),
        "Hard": s * (1.0 + gain * w[15]),
        "Okay": s * (1.0 + gain),
        "Easy": s * (1.0 + gain * w[16]),
    }
    hard, okay, easy = (interval(p, after[g]) for g in ("Hard", "Okay", "Easy"))
    if item.status == "Reviewing":
        hard = min(hard, okay)
        okay = max(okay, p.interval_step + hard)
        wait = {"Fail": p.second_interval, "Hard": hard, "Okay": okay, "Easy": max(easy, p.interval_step + okay)}[grade]
        s, d = after[grade], min(max(w[7] * w[4] + (1.0 - w[7]) * (d - w[6] * FACTOR[grade]), p.min_difficulty), p.max_difficulty)
    else:
        wait = {"Fail": p.second_interval, "Hard": p.third_interval, "Okay": okay, "Easy": max(easy, p.interval_step + okay)}[grade]
    status = item.status
    if status == "Reviewing" and grade == "Fail":
        status = "Relearning"
    elif status != "Reviewing" and grade in ("Okay", "Easy"):
        status = "Reviewing"
    return Item(grade, status, item.next_due, now, d, s, now + wait * 1_000_000)


def _interval_sql(p: Params, stability: str) -> str:
    days = f"9.0D * ({stability}) * (-1.0D + 1.0D / {p.target_retention!r}D)"
    if p.round_to_days:
        return f"{DAY}L * least(greatest(bigint(round({days})), 1L), {p.max_interval}L)"
    return f"bigint(round({DAY}.0D * least(greatest({days}, 1.0D), {float(p.max_interval)!r}D)))"


def _by_grade(grade: str, **values: str) -> str:
    return f"case {grade} " + " ".join(f"when '{g}' then {v}" for g, v in values.items()) + " end"


def _let(names: dict[str, str], body: str, variable: str) -> str:
    """body with {variable}.name standing for values that are computed once."""
    pairs = ", ".join(f"'{n}', {e}" for n, e in names.items())
    return f"transform(array(named_struct({pairs})), {variable} -> {body})[0]"


def _state(grade: str, status: str, due: str, now: str, difficulty: str, stability: str, wait: str) -> str:
    return f"named_struct('grade', {grade}, 'status', {status}, 'due_at', {due}, 'reviewed_at', {now}, 'difficulty', {difficulty}, 'stability', {stability}, 'next_due', {now} + 1000000L * ({wait}))"


def _factor(grade: str) -> str:
    return _by_grade(grade, **{g: f"{f!r}D" for g, f in FACTOR.items()})


def create_sql(p: Params, r: str) -> str:
    w = [f"{x!r}D" for x in p.weights]
    stability = f"greatest({_by_grade(f'{r}.grade', Fail=w[0], Hard=w[1], Okay=w[2], Easy=w[3])}, {p.min_initial_stability!r}D)"
    difficulty = f"least(greatest({w[4]} - {w[5]} * {_factor(f'{r}.grade')}, {p.min_difficulty!r}D), {p.max_difficulty!r}D)"
    wait = _by_grade(f"{r}.grade", Fail=f"{p.first_interval}L", Hard=f"{p.second_interval}L", Okay=f"{p.third_interval}L", Easy=_interval_sql(p, stability))
    return _state(f"{r}.grade", f"if({r}.grade = 'Easy', 'Reviewing', 'Learning')", f"{r}.at", f"{r}.at", difficulty, stability, wait)


def step_sql(p: Params, a: str, r: str) -> str:
    w = [f"{x!r}D" for x in p.weights]
    first = {"recall": f"1.0D / (1.0D + double(({r}.at - {a}.reviewed_at) div {DAY * 1_000_000}L) / (9.0D * {a}.stability))"}
    gain = {"gain": f"exp({w[8]}) * pow({a}.stability, -{w[9]}) * expm1({w[10]} * (1.0D - v1.recall)) * (1.0D + {p.max_difficulty!r}D - {a}.difficulty)", "recall": "v1.recall"}
    after = {
        "fail": f"{w[11]} * pow({a}.difficulty, -{w[12]}) * exp({w[14]} * (1.0D - v2.recall)) * (pow(1.0D + {a}.stability, {w[13]}) - 1.0D)",
        "hard": f"{a}.stability * (1.0D + v2.gain * {w[15]})",
        "okay": f"{a}.stability * (1.0D + v2.gain)",
        "easy": f"{a}.stability * (1.0D + v2.gain * {w[16]})",
    }
    waits = {"hard": _interval_sql(p, "v3.hard"), "okay": _interval_sql(p, "v3.okay"), "easy": _interval_sql(p, "v3.easy"), "s": _by_grade(f"{r}.grade", Fail="v3.fail", Hard="v3.hard", Okay="v3.okay", Easy="v3.easy")}
    step_ = f"{p.interval_step}L"
    streak = {"hard": "least(v4.hard, v4.okay)", "okay": f"greatest(v4.okay, {step_} + least(v4.hard, v4.okay))", "easy": f"greatest(v4.easy, {step_} + greatest(v4.okay, {step_} + least(v4.hard, v4.okay)))", "first_okay": "v4.okay", "first_easy": f"greatest(v4.easy, {step_} + v4.okay)", "s": "v4.s"}
    reviewing = f"{a}.status = 'Reviewing'"
    wait = f"if({reviewing}, {_by_grade(f'{r}.grade', Fail=f'{p.second_interval}L', Hard='v5.hard', Okay='v5.okay', Easy='v5.easy')}, {_by_grade(f'{r}.grade', Fail=f'{p.second_interval}L', Hard=f'{p.third_interval}L', Okay='v5.first_okay', Easy='v5.first_easy')})"
    difficulty = f"if({reviewing}, least(greatest({w[7]} * {w[4]} + (1.0D - {w[7]}) * ({a}.difficulty - {w[6]} * {_factor(f'{r}.grade')}), {p.min_difficulty!r}D), {p.max_difficulty!r}D), {a}.difficulty)"
    status = f"case when {reviewing} and {r}.grade = 'Fail' then 'Relearning' when {a}.status <> 'Reviewing' and {r}.grade in ('Okay', 'Easy') then 'Reviewing' else {a}.status end"
    state = _state(f"{r}.grade", status, f"{a}.next_due", f"{r}.at", difficulty, f"if({reviewing}, v5.s, {a}.stability)", wait)
    return _let(first, _let(gain, _let(after, _let(waits, _let(streak, state, "v5"), "v4"), "v3"), "v2"), "v1")


_STATE = "struct<grade:string,status:string,due_at:bigint,reviewed_at:bigint,difficulty:double,stability:double,next_due:bigint>"


def _sorted(reviews: DataFrame) -> DataFrame:
    known = reviews.where(F.col("grade").isin(*FACTOR) & F.col("item_id").isNotNull() & F.col("reviewed_at").isNotNull())
    return known.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("reviewed_at").cast("timestamp")).alias("at"), "review_id", "grade"))).alias("r"))


def history(reviews: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The state after each review: (item_id, review_number, grade, status, due_at, reviewed_at, difficulty, stability, next_due).

    reviews: (item_id, review_id, reviewed_at, grade); ties in time go by review_id. Rows with a null item, time
    or unknown grade are left out; repeated rows count as reviews each.
    """
    fold = f"""aggregate(slice(r, 2, size(r)), array(cast({create_sql(p, 'r[0]')} as {_STATE})),
        (h, x) -> array_append(h, cast({step_sql(p, 'element_at(h, -1)', 'x')} as {_STATE})))"""
    rows = _sorted(reviews).select("item_id", F.posexplode(F.expr(fold)).alias("review_number", "s"))
    return rows.select("item_id", "review_number", *_columns("s"))


def current(reviews: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The state of each item after its last review, and when it was created."""
    fold = f"aggregate(slice(r, 2, size(r)), cast({create_sql(p, 'r[0]')} as {_STATE}), (h, x) -> cast({step_sql(p, 'h', 'x')} as {_STATE}))"
    rows = _sorted(reviews).select("item_id", F.expr("timestamp_micros(r[0].at)").alias("created_at"), F.expr(fold).alias("s"))
    return rows.select("item_id", "created_at", *_columns("s"))


def _columns(s: str) -> list:
    time = lambda c: F.timestamp_micros(F.col(f"{s}.{c}")).alias(c)
    return [F.col(f"{s}.grade").alias("grade"), F.col(f"{s}.status").alias("status"), time("due_at"), time("reviewed_at"), F.col(f"{s}.difficulty").alias("difficulty"), F.col(f"{s}.stability").alias("stability"), time("next_due")]


def intervals(states: DataFrame) -> DataFrame:
    """Whole days between a state's review and the time that was then set for the next: per item, in order."""
    days = F.floor((F.unix_seconds("next_due") - F.unix_seconds("reviewed_at")) / DAY).cast("long")
    return states.select("item_id", "review_number", days.alias("interval_days"))


def interval_history(states: DataFrame) -> DataFrame:
    """(item_id, review_number, days): whole days from the review before to the time a review was due; the first of an item has none."""
    order = Window.partitionBy("item_id").orderBy("review_number")
    rows = states.select("item_id", "review_number", "due_at", F.lag("reviewed_at").over(order).alias("before")).where("before is not null")
    return rows.select("item_id", "review_number", F.expr(f"(unix_seconds(due_at) - unix_seconds(before)) div {DAY}").alias("days"))
