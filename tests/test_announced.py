"""Announcements by neighbours and stays, against the fold over each rider's fixes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from spokeline.operators import navigation
from spokeline.streaming import navigation as live

SCHEMA = "rider_id long, event_id long, ts timestamp, idx int, next_text string, to_turn_m double, remaining_m double, off_route boolean"
START = datetime(2024, 5, 1, 7, 59, 30)


def compared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = (sorted(map(repr, map(tuple, f(df).collect()))) for f in (navigation.announced, live.replay))
    assert got == want
    return got


@pytest.mark.parametrize("block", [3_600_000, 700])
def test_announced_equals_the_fold(spark, monkeypatch, block):
    monkeypatch.setattr(navigation, "BLOCK_MS", block)
    rng, rows, n = random.Random(block), [], 0
    for rider in range(24):
        at, idx, away = 0.0, 0, 200.0
        for _ in range(60):
            n += 1
            at += rng.choice([0.0, 0.0004, 0.9, 1.0, 4.0, 8.0, 8.001, 30.0])
            if rng.random() < 0.1:
                idx, away = max(0, idx + rng.choice([-1, 1, 1])), 200.0
            away = rng.choice([away, 150.0, 79.9, 80.0, 50.0, 20.0, 19.0, 5.0, 0.0])
            text = None if idx == 3 else f"turn {idx}"
            remaining = 29.0 if rider % 3 == 0 and rng.random() < 0.02 else 500.0
            rows.append((rider, n, START + timedelta(seconds=at), idx, text, away, remaining, rng.random() < 0.2))
    got = compared(spark, rows)
    assert sum("'In " in g for g in got) > 50 and sum("'turn " in g for g in got) > 20 and sum("arrived" in g for g in got) > 1


def test_one_rider_who_waits_at_a_turn(spark, monkeypatch):
    monkeypatch.setattr(navigation, "BLOCK_MS", 5000)
    rows = [(7, i, START + timedelta(milliseconds=350 * i), 1, "left", 12.0 if i % 9 else 95.0, 900.0, False) for i in range(400)]
    got = compared(spark, rows + rows[100:110])  # some rows twice
    assert sum("'left'" in g for g in got) in (16, 17)


def test_empty_and_null_riders(spark):
    assert navigation.announced(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, START, 0, "left", 50.0, 900.0, True), (None, 2, START + timedelta(seconds=9), 0, "left", 5.0, 900.0, False), (None, 3, START + timedelta(seconds=10), 1, "x", 5.0, 10.0, False)]
    out = navigation.announced(spark.createDataFrame(rows, SCHEMA)).orderBy("event_id").select("said").collect()
    assert [r[0] for r in out] == ["In 160 feet, left", "left", navigation.ARRIVED]
    plan = navigation.announced(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1]
