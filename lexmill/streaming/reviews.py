"""Reviews as a stream: the state of each item is kept, and every review gives its new one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.operators.reviews import DEFAULT, FACTOR, Item, Params, create, step

STATE = "grade string, status string, due_at long, reviewed_at long, difficulty double, stability double, next_due long, review_number int"
OUTPUT = "item_id long, review_number int, grade string, status string, due_at timestamp, reviewed_at timestamp, difficulty double, stability double, next_due timestamp"


def review_states(reviews: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The rows of operators.reviews.history(), as reviews (item_id, review_id, reviewed_at, grade) arrive.

    Within a batch an item's reviews are taken by time, then review_id. A review from before the item's
    last one comes too late for a recurrence and is dropped. An item's state has a fixed size.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, item = 0, None
        if state.exists:
            *fields, number = state.get
            item = Item(*fields)
        arrived = pd.concat(list(batches)).sort_values(["at", "review_id"], kind="stable")
        out = []
        for now, grade in zip(arrived["at"].tolist(), arrived["grade"].tolist()):
            if item is not None and now < item.reviewed_at:
                continue
            item = create(p, grade, now) if item is None else step(p, item, grade, now)
            out.append((key[0], number, item.grade, item.status, item.due_at, item.reviewed_at, item.difficulty, item.stability, item.next_due))
            number += 1
        if item is not None:
            state.update((item.grade, item.status, item.due_at, item.reviewed_at, item.difficulty, item.stability, item.next_due, number))
        frame = pd.DataFrame(out, columns=["item_id", "review_number", "grade", "status", "due_at", "reviewed_at", "difficulty", "stability", "next_due"])
        for c in ("due_at", "reviewed_at", "next_due"):
            frame[c] = pd.to_datetime(frame[c], unit="us")
        yield frame

    known = reviews.where(F.col("grade").isin(*FACTOR) & F.col("item_id").isNotNull() & F.col("reviewed_at").isNotNull())
    rows = known.select("item_id", "review_id", F.unix_micros(F.col("reviewed_at").cast("timestamp")).alias("at"), "grade")
    return rows.groupBy("item_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
