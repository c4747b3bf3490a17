"""Trip operators against small state machines on random sequences, with and without hot keys."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from urbanflow.operators import od, trips

START = datetime(2024, 1, 1)


def metro_machine(events):
    out, opened = [], None
    for ts, place, enters in events:
        if enters and opened is None:
            opened = (ts, place)
        elif not enters and opened is not None:
            out.append((*opened, ts, place))
            opened = None
    return out


def taxi_machine(events):
    out, first, last = [], None, None
    for ts, place, status in events:
        if status == "0":
            if first is None:
                first = (ts, place)
            else:
                last = (ts, place)
        elif status == "1" and first and last:
            out.append((*first, *last))
            first = last = None
    if first and last:
        out.append((*first, *last))
    return out


def sequence(rng, length, states):
    at, rows = START, []
    for n in range(length):
        at += timedelta(seconds=rng.choice([0, 7, 40, 200]))
        rows.append((at, n, rng.choice(states)))
    return rows


@pytest.mark.parametrize("hot_rows,chunk", [(10**9, 60), (40, 60), (1, 17), (1, 600)])
def test_metro_trips_match_state_machine(spark, hot_rows, chunk):
    rng = random.Random(5)
    rows, want = [], []
    for uid in range(60):
        events = sequence(rng, rng.choice([1, 5, 30, 80]), [True, False])
        want += [(uid, *t) for t in metro_machine(events)]
        rows += [(uid, ts, n, place, Decimal("0.00") if enters else Decimal("3.00"))
                 for n, (ts, place, enters) in enumerate(events)]
    rng.shuffle(rows)
    taps = spark.createDataFrame(rows, "uid int, ts timestamp_ntz, event_id int, location int, amount decimal(10,2)")
    got = trips.metro_trips(taps, hot_rows, chunk).select("uid", "ts0", "location0", "ts1", "location1").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("hot_rows,chunk", [(10**9, 60), (40, 60), (1, 17), (1, 600)])
def test_taxi_trips_match_state_machine(spark, hot_rows, chunk):
    rng = random.Random(6)
    rows, want = [], []
    for tid in range(80):
        states = rng.choice([["0", "1"], ["0", "1", "1", "1"], ["0", "0", "0", "1", "x"]])
        events = sequence(rng, rng.choice([1, 6, 30, 90]), states)
        want += [(tid, *t) for t in taxi_machine(events)]
        rows += [(tid, ts, n, s, 121.0 + place / 1000, 31.0) for n, (ts, place, s) in enumerate(events)]
    rng.shuffle(rows)
    pings = spark.createDataFrame(rows, "tid int, ts timestamp_ntz, event_id int, status string, lng double, lat double")
    got = trips.taxi_trips(pings, hot_rows, chunk).collect()
    place = lambda lng: round((lng - 121.0) * 1000)
    assert sorted((r.tid, r.ts0, place(r.lng0), r.ts1, place(r.lng1)) for r in got) == sorted(want)
    assert all(r.secs == (r.ts1 - r.ts0).total_seconds() for r in got)


def test_null_keys_are_kept(spark):
    rows = [(None, START, 1, 1, Decimal("0.00")), (None, START + timedelta(hours=1), 2, 2, Decimal("2.00"))]
    taps = spark.createDataFrame(rows, "uid int, ts timestamp_ntz, event_id int, location int, amount decimal(10,2)")
    for hot in (10**9, 1):
        assert trips.metro_trips(taps, hot).count() == 1


def test_taxi_trips_without_place_are_left_out(spark):
    rows = [(1, START, 1, "0", None, 31.0), (1, START + timedelta(seconds=9), 2, "0", 121.4, 31.0),
            (1, START + timedelta(seconds=20), 3, "1", 121.4, 31.0), (1, START + timedelta(seconds=30), 4, "0", 121.4, 31.0),
            (1, START + timedelta(seconds=45), 5, "0", 121.5, 31.0)]
    pings = spark.createDataFrame(rows, "tid int, ts timestamp_ntz, event_id int, status string, lng double, lat double")
    got = trips.taxi_trips(pings).collect()
    assert [(r.secs, r.lng1) for r in got] == [(15.0, 121.5)]


def test_variability_rounding(spark):
    counts = spark.createDataFrame([(1, 8, "a", "b", 3), (2, 8, "a", "b", 4), (3, 8, "a", "b", 4), (4, 8, "a", "b", 10)],
                                   "day int, hour int, src string, dst string, cnt bigint")
    rows = {r.day_type: r for r in od.variability(counts).collect()}
    work, holiday = rows["workdays"], rows["holidays"]
    assert (work.n, work["mean"], work.mae, work.err) == (3, 3.67, 0.44, 0.1199)
    assert work.devs == [0.67, 0.33, 0.33]
    assert (holiday.n, holiday["mean"], holiday.mae, holiday.err) == (1, 10.0, 0.0, 0.0)


def test_plan_has_one_shuffle_of_the_events(spark):
    """Without hot keys the events are shuffled once, by card, and no cross join appears."""
    import io
    from contextlib import redirect_stdout
    taps = spark.range(1000).selectExpr("id % 9 as uid", "timestampadd(SECOND, cast(id as int), timestamp_ntz'2024-01-01') as ts",
                                        "id as event_id", "id as location", "cast(id % 2 as decimal(10,2)) as amount")
    out = io.StringIO()
    with redirect_stdout(out):
        trips.metro_trips(taps).explain()
    plan = out.getvalue()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
