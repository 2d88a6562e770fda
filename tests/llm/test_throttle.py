"""Click throttling against a plain simulation, click by click."""

import random
import zlib
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import queries, throttle

SF = "/root/testdata/sf0.001"
EPOCH = datetime(1970, 1, 1)
HOUR = 3_600_000_000


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def plain(rows, batches=8):
    rows = [r for r in {tuple(r): r for r in rows}.values() if r["ts"] is not None and r["client_id"] is not None]
    hours = [us(r["arrived_at"]) // HOUR for r in rows if r["arrived_at"] is not None]
    low, high = min(hours, default=0), max(hours, default=0)
    of = [[] for _ in range(batches)]
    for r in rows:
        b = 0 if r["arrived_at"] is None else (us(r["arrived_at"]) // HOUR - low) * batches // (high - low + 1)
        b += r["click_id"] is not None and zlib.crc32(str(r["click_id"]).encode()) % 7 == 0
        of[min(b, batches - 1)].append(r)
    out, waiting, latest, clients = [], [], None, {}
    for k in range(batches):
        mark = None if latest is None else latest - 168 * HOUR
        for r in of[k]:
            if mark is not None and us(r["ts"]) < mark:
                out.append((r["click_id"], "late", k, None, None, None))
            else:
                waiting.append(r)
        due = [r for r in waiting if k == batches - 1 or (mark is not None and us(r["ts"]) < mark and r not in of[k])]
        waiting = [r for r in waiting if not any(r is d for d in due)]
        for r in sorted(due, key=lambda r: (us(r["ts"]), r["click_id"] is not None, r["click_id"] or 0)):
            credit, last, penalty = clients.get(r["client_id"], (5 * 900_000_000, None, None))
            t = us(r["ts"])
            if last is not None:
                credit = min(5 * 900_000_000, credit + t - last)
            if credit >= 900_000_000:
                credit, penalty, row = credit - 900_000_000, None, ("admitted",)
                out.append((r["click_id"], *row, k, credit, None, None))
            else:
                penalty = t if penalty is None else penalty
                out.append((r["click_id"], "throttled", k, credit, penalty, t + 900_000_000 - credit))
            clients[r["client_id"]] = (credit, t, penalty)
        latest = max([x for x in [latest, *[us(r["ts"]) for r in of[k]]] if x is not None], default=None)
    return sorted(out, key=str)


def test_query_against_simulation(spark, monkeypatch):
    monkeypatch.setattr(throttle, "SEGMENT_ROWS", 64)  # many segments
    got = queries.QUERIES["op12_throttle"](spark, SF)
    assert got.columns == ["click_id", "outcome", "batch", "credit_after", "penalty_start_us", "penalty_end_us"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(spark.read.parquet(f"{SF}/clicks.parquet").collect())


def test_lockstep_and_summaries():
    """Settling, and the function of a segment's credit, against one click after another."""
    r = random.Random(7)
    for scale in (60, 600, 2000, 9000):
        ts = np.cumsum([int(r.expovariate(1 / scale) * 1_000_000) for _ in range(120)]).astype(np.int64)
        pieces = throttle.summary(ts.tolist())
        assert pieces[0][0] == 0 and pieces[-1][1] == throttle.CAP + 1 and len(pieces) < 20
        starts = sorted({0, throttle.CAP, *[r.randrange(throttle.CAP + 1) for _ in range(60)], *[p[0] for p in pieces], *[p[0] - 1 for p in pieces[1:]]})
        many = len(starts)
        credit, settled = np.array(starts, np.int64), np.full(many, ts[0])
        admitted, after = throttle.settle(np.arange(many + 1) * len(ts), np.tile(ts, many), credit, settled)
        for i, c in enumerate(starts):
            assert throttle.apply_summary(pieces, c) == int(credit[i])
            for j, t in enumerate(ts.tolist()):
                c = min(throttle.CAP, c + (t - int(ts[j - 1]) if j else 0))
                ok = c >= throttle.COST
                c = c - throttle.COST if ok else c
                assert (bool(admitted[i * len(ts) + j]), int(after[i * len(ts) + j])) == (ok, c)


def test_hot_client_nulls_ties_and_empty_batches(spark):
    r = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(900):  # one client has half of the clicks; nothing arrives in the middle third
        ts = start + timedelta(days=r.choice([0, 1, 30, 51, 57]), seconds=r.randrange(9000), microseconds=r.randrange(1_000_000))
        arrived = start + timedelta(days=r.choice([0, 1, 2, 58, 59]), seconds=r.randrange(86400))
        rows.append((r.choice([i, i, None]), r.choice([ts, start + timedelta(hours=r.randrange(1400))]), arrived, r.choice([7, 7, 7, r.randrange(20)]), "x"))
    rows += rows[:50] + [(1, None, start, 3, "x"), (2, start, start, None, "x"), (3, start, None, 3, "x"), (3, start, None, 3, "y")]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, batch string")
    clicks = clicks.withColumns({c: F.lit(None).cast("string") for c in ("bucket", "mark", "late", "seg", "state", "credit", "penalty", "outcome", "watermark")})
    got = sorted(map(tuple, throttle.throttle(clicks).collect()), key=str)
    assert got == plain(clicks.collect())
    assert {x[1] for x in got} == {"admitted", "throttled", "late"}
    assert throttle.throttle(clicks.limit(0)).isEmpty()


def test_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        from pyspark.sql import types as T

        day = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS t, TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS u")
        assert tuple(day.select(throttle.micros("t", T.TimestampNTZType()), throttle.micros("u", T.TimestampNTZType())).first()) == (1711852200000001, -500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
