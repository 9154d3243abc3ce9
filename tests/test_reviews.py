from datetime import datetime, timedelta

import pytest

from lexmill.operators import reviews as R

WEIGHTS = (1.14, 1.01, 5.44, 14.67, 5.3024, 1.5662, 1.2503, 0.0028, 1.5489, 0.1763, 0.9953, 2.7473, 0.0179, 0.3105, 0.3976, 0.0, 2.0902)
GRADES = ["Okay"] * 5 + ["Fail"] * 2 + ["Okay"] * 5
EPOCH = datetime(1970, 1, 1)
CASES = [
    (True, 0, [0, 5, 16, 43, 106, 236, 0, 0, 12, 25, 47, 85, 147], 146.5098645561389, datetime(1971, 12, 24, 0, 20)),
    (False, 0, [0, 5, 15, 41, 101, 227, 0, 0, 12, 24, 46, 83, 143], 143.62094976824096, datetime(1971, 12, 3, 0, 40, 8)),
    (False, 1, [0, 7, 21, 57, 137, 299, 0, 0, 14, 28, 53, 96, 166], 165.0309763046746, datetime(1972, 6, 12, 18, 38, 39)),
]


def at(us):
    return EPOCH + timedelta(microseconds=us)


@pytest.mark.parametrize("rounded,delay,expected,stability,next_due", CASES)
def test_series(spark, rounded, delay, expected, stability, next_due):
    p = R.Params(WEIGHTS, round_to_days=rounded)
    item = R.create(p, "Okay", 0)
    states, rows = [item], [(1, 0, EPOCH, "Okay")]
    for n, grade in enumerate(GRADES):
        now = item.next_due + delay * 86_400_000_000
        rows.append((1, n + 1, at(now), grade))
        item = R.step(p, item, grade, now)
        states.append(item)
    days = [(b.due_at - a.reviewed_at) // 86_400_000_000 for a, b in zip(states, states[1:])][:-1]
    days += [(states[-1].due_at - states[-2].reviewed_at) // 86_400_000_000, (item.next_due - item.due_at) // 86_400_000_000]
    assert days == expected
    assert item.stability == pytest.approx(stability, rel=1e-12)
    assert item.difficulty == pytest.approx(7.768187098876362)
    assert at(item.next_due) == next_due
    df = spark.createDataFrame(rows, "item_id long, review_id long, reviewed_at timestamp, grade string")
    got = R.history(df, p).orderBy("review_number").collect()
    assert [(g.grade, g.status, g.due_at, g.reviewed_at, g.next_due) for g in got] == [(s.grade, s.status, at(s.due_at), at(s.reviewed_at), at(s.next_due)) for s in states]
    assert [g.stability for g in got] == pytest.approx([s.stability for s in states])
    last = R.current(df, p).first()
    assert (last.next_due, last.status, last.created_at) == (next_due, "Reviewing", EPOCH)


def test_all_grades_agree_with_python(spark):
    import itertools

    rows, expected = [], {}
    for k, grades in enumerate(itertools.product(R.FACTOR, repeat=4)):
        now, item = 0, None
        for n, g in enumerate(grades):
            item = R.create(R.DEFAULT, g, now) if item is None else R.step(R.DEFAULT, item, g, now)
            rows.append((k, n, at(now), g))
            now += 86_400_000_000 * (2 + n) + 1
        expected[k] = item
    df = spark.createDataFrame(rows, "item_id long, review_id long, reviewed_at timestamp, grade string")
    got = R.current(df).collect()
    assert len(got) == len(expected)
    for g in got:
        e = expected[g.item_id]
        assert (g.status, g.grade, g.next_due, g.due_at) == (e.status, e.grade, at(e.next_due), at(e.due_at))
        assert (g.stability, g.difficulty) == pytest.approx((e.stability, e.difficulty))


def test_odd_rows(spark):
    rows = [(None, 1, EPOCH, "Okay"), (1, 1, None, "Okay"), (1, 2, EPOCH, "What"), (1, 3, EPOCH, None), (2, 1, EPOCH, "Easy"), (2, 1, EPOCH, "Easy")]
    df = spark.createDataFrame(rows, "item_id long, review_id long, reviewed_at timestamp, grade string")
    assert [(r.item_id, r.review_number, r.status) for r in R.history(df).orderBy("review_number").collect()] == [(2, 0, "Reviewing"), (2, 1, "Reviewing")]
    assert R.history(df.limit(0)).count() == 0 and R.current(df.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from lexmill.streaming.reviews import review_states

    rows = [(i % 3, n, EPOCH + timedelta(days=n, hours=i % 3), ["Okay", "Fail", "Easy", "Hard"][(n + i) % 4]) for n in range(6) for i in range(3)]
    schema = "item_id long, review_id long, reviewed_at timestamp, grade string"
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = review_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda r: (r.item_id, r.review_number)
    got = sorted(spark.table("states").collect(), key=key)
    want = sorted(R.history(spark.createDataFrame(rows, schema)).collect(), key=key)
    assert [(key(g), g.status, g.next_due) for g in got] == [(key(w), w.status, w.next_due) for w in want]
