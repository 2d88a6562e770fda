"""Token-bucket throttling of clicks: a hash-bucket stateful streaming operator and a lockstep settler.

Clicks arrive in batches.  Each batch is appended to a folder that a Structured Streaming query reads;
the query is started anew for every batch on one checkpoint.

* Waiting.  The stateful operator's keys are hash buckets of clicks (not of clients, so that a client
  with a third of all clicks spreads over all buckets).  A bucket's state holds its waiting clicks, packed.
  Every batch carries a mark for every bucket with the batch's watermark, so also a batch without
  clicks settles what is due.
* Settling, in ``foreachBatch``.  The due clicks and the clients' credits from the batch before go to
  ranges of (client, ts, click), so that a long client is cut into several segments.  A segment of an
  unknown start is summed up as a function of the credit it starts with: piecewise a shift or a constant,
  with a handful of pieces however many clicks it has (credits in [0, C) are only rotated).  The functions
  of the segments of one client are applied one after another, which gives every segment its start.
* Lockstep.  Inside a segment the due clicks are ranked per client, and every client's k-th click is settled
  simultaneously on the vector of credits; the few clients that are still left go on one by one.
* Penalties.  The instant at which the credit reaches C follows from any throttled click, is the same for all
  clicks of a penalty and later for each later penalty, so it is the penalty's key: its start is the least ts of the key.

Batches, due clicks, credits and outcomes are tables in the checkpoint folder, one folder a batch that a
repeated batch overwrites, so a query that dies is started again and nothing counts twice.

Memory: a state bucket holds about ``BUCKET_ROWS`` waiting clicks at most, a segment ``SEGMENT_ROWS``.  Only
the batches' eight largest timestamps and two numbers go to the driver; nothing is broadcast.

Defined results: equal rows count once; clicks without ts or client are left out; a click without arrival is
in batch 0; a null click_id moves to no later batch and sorts first; rows of one client, ts and click_id
settle one after the other (they can't be told apart in the result); timestamps without a zone are UTC; an empty
table gives an empty result; other columns only tell rows apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import textcore
from .staging import shared_folder, staged

BATCHES = 8
COST = 900 * 1_000_000
CAP = 5 * COST
LATENESS = 168 * 3600 * 1_000_000
BUCKET_ROWS = 1 << 16
SEGMENT_ROWS = 1 << 16
SCALAR = 24  # so many clients are faster one by one

NEVER = -(1 << 62)  # no watermark yet; no settled click yet

FEED = "bucket int, click_id long, has_id boolean, client_id long, ts long, batch int, mark boolean, watermark long, last boolean"
DUE = "click_id long, has_id boolean, client_id long, ts long, batch int, late boolean"
_FIELDS = ["click_id", "has_id", "client_id", "ts"]
#: Rows of a settled batch: outcomes, and (``state``) the credit of each client with a click in it.
SETTLED = "state boolean, click_id long, has_id boolean, client_id long, ts long, outcome string, credit long, ends long"


def micros(ts: str, kind: T.DataType) -> Column:
    """Epoch microseconds; a timestamp without a zone is UTC whatever the session's zone is."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    since = f"(`{ts}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    part = lambda unit: F.expr(f"extract({unit} FROM {since})")
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")).cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def numbered(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Distinct clicks (click_id, has_id, client_id, ts, batch)."""
    fields = {f.name: f.dataType for f in clicks.schema.fields}
    known = clicks.where(F.col("ts").isNotNull() & F.col("client_id").isNotNull())
    hour = F.floor(micros("arrived_at", fields["arrived_at"]) / 3_600_000_000)
    low, high = known.agg(F.min(hour), F.max(hour)).first()
    low, high = low or 0, high or 0
    first = F.coalesce(F.floor((hour - low) * batches / (high - low + 1)), F.lit(0)).cast("int")
    later = F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)).cast("int")
    batch = F.least(first + later, F.lit(batches - 1))
    return known.dropDuplicates().select(F.coalesce(F.col("click_id"), F.lit(0)).cast("long").alias("click_id"), F.col("click_id").isNotNull().alias("has_id"), F.col("client_id").cast("long").alias("client_id"), micros("ts", fields["ts"]).alias("ts"), batch.alias("batch"))


# The stateful operator


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    return b"".join(rows[f].astype(np.int64).tobytes() for f in _FIELDS)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    return dict(zip(_FIELDS, np.frombuffer(raw, np.int64).reshape(len(_FIELDS), -1), strict=True))


def _wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket in one batch: what comes late, what waits and what is due."""
    held = _unpack(state.get[0]) if state.exists else {f: np.zeros(0, np.int64) for f in _FIELDS}
    new: list[dict[str, np.ndarray]] = []
    watermark, last, batch = NEVER, False, 0
    for frame in frames:
        mark = frame["mark"].to_numpy(bool)
        if mark.any():
            row = frame[mark].iloc[0]
            watermark, last, batch = int(row["watermark"]), bool(row["last"]), int(row["batch"])
        new.append({f: frame[f].to_numpy()[~mark].astype(np.int64) for f in _FIELDS})
    own = {f: np.concatenate([x[f] for x in new]) for f in _FIELDS}
    late = own["ts"] < watermark
    waiting = {f: np.concatenate([held[f], own[f][~late]]) for f in _FIELDS}
    due = np.ones(len(waiting["ts"]), bool) if last else waiting["ts"] < watermark
    state.update((_pack({f: x[~due] for f, x in waiting.items()}),))
    for rows, on, is_late in ((own, late, True), (waiting, due, False)):
        if on.any():
            found = {f: x[on] for f, x in rows.items()}
            found["has_id"] = found["has_id"].astype(bool)
            yield pd.DataFrame(found | {"batch": np.int32(batch), "late": is_late})


# Settling


def _step(pieces: list[tuple], gain: int) -> list[tuple]:
    """A click after ``gain`` microseconds.  A piece (low, high, moves, value) says for starting credits in [low, high)
    that the credit is start + value (``moves``) or value."""
    out: list[tuple] = []

    def add(low, high, moves, value):
        if low < high:
            if out and out[-1][2:] == (moves, value):
                out[-1] = (out[-1][0], high, moves, value)
            else:
                out.append((low, high, moves, value))

    for low, high, moves, value in pieces:
        value += gain
        if not moves:
            value = min(CAP, value)
            add(low, high, False, value - COST if value >= COST else value)
            continue
        one, two = min(max(low, COST - value), high), min(max(low, CAP - value), high)
        add(low, one, True, value)
        add(one, two, True, value - COST)
        add(two, high, False, CAP - COST)
    return out


def summary(ts: list[int]) -> list[tuple]:
    """What a segment's clicks make of a credit, counted at its first click."""
    pieces, before = [(0, CAP + 1, True, 0)], ts[0]
    for t in ts:
        pieces = _step(pieces, t - before)
        before = t
    return pieces


def apply_summary(pieces: list[tuple], credit: int) -> int:
    """The credit after a segment that begins with ``credit``."""
    return next(credit + value if moves else value for low, high, moves, value in pieces if low <= credit < high)


def gained(credit: int, settled: int, ts: int) -> int:
    return CAP if settled == NEVER else min(CAP, credit + ts - settled)


def settle(starts: np.ndarray, ts: np.ndarray, credit: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Settle the clicks ``ts`` of many clients; client i has those from ``starts[i]`` to ``starts[i + 1]`` in order.
    ``credit`` and ``settled`` are changed in place.  Per click: whether it is admitted, and the credit after it."""
    n = np.diff(starts)
    admitted, after = np.zeros(len(ts), bool), np.zeros(len(ts), np.int64)
    active, k = np.argsort(-n, kind="stable"), 0
    while True:
        active = active[: int(np.searchsorted(-n[active], -k, side="left"))]  # those with more than k clicks
        if len(active) <= SCALAR:
            break
        at = starts[active] + k
        t = ts[at]
        c = np.where(settled[active] == NEVER, CAP, np.minimum(CAP, credit[active] + (t - settled[active])))
        ok = c >= COST
        c = np.where(ok, c - COST, c)
        admitted[at], after[at] = ok, c
        credit[active], settled[active] = c, t
        k += 1
    for i in active.tolist():
        c, last = int(credit[i]), int(settled[i])
        a, b = int(starts[i]) + k, int(starts[i + 1])
        oks, credits = [], []
        for t in ts[a:b].tolist():
            c = CAP if last == NEVER else min(CAP, c + t - last)
            ok = c >= COST
            if ok:
                c -= COST
            last = t
            oks.append(ok)
            credits.append(c)
        admitted[a:b], after[a:b] = oks, credits
        credit[i], settled[i] = c, last
    return admitted, after


#: A segment: its rows, packed; ``client`` rows say what it makes of its first and its last client.
SEGMENTS = "seg long, rows binary, client long, head boolean, credit long, settled long, first long, final long, pieces array<struct<low:long,high:long,moves:boolean,value:long>>"
_ROW = ["client_id", "is_click", "ts", "click_id", "has_id", "credit"]
_PIECE = ("low", "high", "moves", "value")


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a range, sorted by client and time, into segments."""
    schema = pa.schema([("seg", pa.int64()), ("rows", pa.binary()), ("client", pa.int64()), ("head", pa.bool_()), ("credit", pa.int64()), ("settled", pa.int64()), ("first", pa.int64()), ("final", pa.int64()), ("pieces", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("moves", pa.bool_()), ("value", pa.int64())])))])
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        out = [dict.fromkeys(schema.names) | {"seg": number, "rows": rows.tobytes()}]
        clients = rows[0]
        for client in dict.fromkeys([int(clients[0]), int(clients[-1])]):
            a, b = np.searchsorted(clients, client), np.searchsorted(clients, client, side="right")
            own = rows[:, a:b]
            head, ts = not own[1, 0], own[2, int(not own[1, 0]) :]
            row = dict.fromkeys(schema.names) | {"seg": number, "client": client, "head": head}
            if head:
                row |= {"credit": int(own[5, 0]), "settled": int(own[2, 0])}
            if len(ts):
                pieces = [dict(zip(_PIECE, p, strict=True)) for p in summary(ts.tolist())]
                row |= {"first": int(ts[0]), "final": int(ts[-1]), "pieces": pieces}
            out.append(row)
        number += 1
        return pa.RecordBatch.from_pylist(out, schema)

    for batch in batches:
        held.append(np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns]))
        while sum(x.shape[1] for x in held) >= SEGMENT_ROWS:
            rows = np.concatenate(held, axis=1)
            yield flush(rows[:, :SEGMENT_ROWS])
            held = [rows[:, SEGMENT_ROWS:]]
    rows = np.concatenate(held, axis=1) if held else np.zeros((len(_ROW), 0), np.int64)
    if rows.shape[1]:
        yield flush(rows)


STARTS = "seg long, client long, credit long, settled long, ends boolean"


def _chain(table: pa.Table) -> pa.Table:
    """One client's segments, a row each: apply their functions one after another."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    credit, settled, out = CAP, NEVER, []
    for r in rows:
        if r["head"]:
            credit, settled = r["credit"], r["settled"]
        out.append({"seg": r["seg"], "client": r["client"], "credit": credit, "settled": settled, "ends": r is rows[-1]})
        if r["pieces"]:
            credit = apply_summary([tuple(p[k] for k in _PIECE) for p in r["pieces"]], gained(credit, settled, r["first"]))
            settled = r["final"]
    return pa.Table.from_pylist(out, pa.schema([("seg", pa.int64()), ("client", pa.int64()), ("credit", pa.int64()), ("settled", pa.int64()), ("ends", pa.bool_())]))


def _settle_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, starts_ in zip(batch.column("rows"), batch.column("starts").to_pylist(), strict=True):
            rows = np.frombuffer(raw.as_buffer(), np.int64).reshape(len(_ROW), -1)
            click = rows[1] == 1
            clients, inverse = np.unique(rows[0], return_inverse=True)
            credit, settled, ends = np.full(len(clients), CAP), np.full(len(clients), NEVER), np.ones(len(clients), bool)
            known = inverse[~click]
            credit[known], settled[known] = rows[5][~click], rows[2][~click]
            for s in starts_:
                i = int(np.searchsorted(clients, s["client"]))
                credit[i], settled[i], ends[i] = s["credit"], s["settled"], s["ends"]
            ts = np.ascontiguousarray(rows[2][click])
            cut = np.searchsorted(rows[0][click], clients)
            admitted, after = settle(np.append(cut, len(ts)), ts, credit, settled)
            n, m = len(ts), int(ends.sum())
            over = ts + (COST - after)  # when the credit reaches the cost
            nothing = lambda kind: pa.nulls(m, kind)  # noqa: B023, E731
            columns = [
                pa.array(np.repeat([False, True], [n, m])),
                pa.concat_arrays([pa.array(rows[3][click]), nothing(pa.int64())]),
                pa.concat_arrays([pa.array(rows[4][click] == 1), nothing(pa.bool_())]),
                pa.array(np.concatenate([rows[0][click], clients[ends]])),
                pa.array(np.concatenate([ts, settled[ends]])),
                pa.concat_arrays([pa.array(np.where(admitted, "admitted", "throttled")).cast(pa.string()), nothing(pa.string())]),
                pa.array(np.concatenate([after, credit[ends]])),
                pa.concat_arrays([pa.array(over, mask=admitted), nothing(pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SETTLED.split(", ")])


def _settled(due: DataFrame, before: DataFrame | None) -> DataFrame:
    """Outcomes of the due clicks, and the clients' credits after them."""
    spark = due.sparkSession
    clicks = due.where("NOT late").select("client_id", F.lit(1).cast("long").alias("is_click"), "ts", "click_id", F.col("has_id").cast("long").alias("has_id"), F.lit(0).cast("long").alias("credit"))
    rows = clicks
    if before is not None:
        rows = rows.unionByName(before.where("state").select("client_id", F.lit(0).cast("long").alias("is_click"), "ts", F.lit(0).cast("long").alias("click_id"), F.lit(0).cast("long").alias("has_id"), "credit"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SEGMENT_ROWS))
    keys = ["client_id", "is_click", "ts", "has_id", "click_id"]
    dealt = rows.select(*_ROW).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    found = staged(dealt.mapInArrow(textcore.tidy(_segment), SEGMENTS), "segments")
    ends = found.where("client IS NOT NULL").drop("rows")
    starts = staged(ends.groupBy("client").applyInArrow(_chain, STARTS), "starts")
    by_segment = starts.groupBy("seg").agg(F.collect_list(F.struct("client", "credit", "settled", "ends")).alias("starts"))  # two at most
    whole = found.where("rows IS NOT NULL").select("seg", "rows").join(by_segment.hint("merge"), "seg")
    return whole.select("rows", "starts").mapInArrow(textcore.tidy(_settle_segments), SETTLED)


def throttle(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per distinct click: click_id, outcome (admitted, throttled or late), batch, credit_after, penalty_start_us, penalty_end_us."""
    spark: SparkSession = clicks.sparkSession
    root = f"{shared_folder(spark)}/strandline/throttle-{uuid.uuid4().hex}"
    numbered(clicks, batches).write.partitionBy("batch").parquet(f"{root}/clicks")
    feed = T.StructType.fromDDL(FEED)
    stored = spark.read.schema(T.StructType([f for f in feed.fields if f.name in (*_FIELDS, "batch")])).parquet(f"{root}/clicks")
    sizes = {r["batch"]: (r["latest"], r["n"]) for r in stored.groupBy("batch").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n for _, n in sizes.values()) // BUCKET_ROWS))
    at = lambda kind, k: f"{root}/{kind}/{k}"
    due_schema, settled_schema = T.StructType.fromDDL(DUE), T.StructType.fromDDL(SETTLED)

    def sink(due: DataFrame, k: int) -> None:
        session = due.sparkSession
        due.write.mode("overwrite").parquet(at("due", k))
        before = session.read.schema(settled_schema).parquet(at("settled", k - 1)) if k else None
        _settled(session.read.schema(due_schema).parquet(at("due", k)), before).write.mode("overwrite").parquet(at("settled", k))

    latest = NEVER
    for k in range(batches):
        watermark = latest - LATENESS if latest != NEVER else NEVER
        common = {"batch": F.lit(k), "watermark": F.lit(watermark), "last": F.lit(k == batches - 1)}
        own = stored.where(F.col("batch") == k).withColumns({"bucket": F.pmod(F.xxhash64("client_id", "ts", "click_id"), F.lit(buckets)).cast("int"), "mark": F.lit(False), **common})
        marks = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(True).alias("mark"), *[F.lit(0).cast("long").alias(c) for c in ("click_id", "client_id", "ts")], F.lit(False).alias("has_id")).withColumns(common)
        own.unionByName(marks).select(*feed.names).write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(feed).parquet(f"{root}/feed")
        due = stream.groupBy("bucket").applyInPandasWithState(_wait, DUE, "waiting binary", "append", GroupStateTimeout.NoTimeout)
        query = due.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        latest = max(latest, sizes.get(k, (NEVER, 0))[0])

    known = lambda kind, schema, where: reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(at(kind, k)).where(where).withColumn("batch", F.lit(k)) for k in range(batches)])
    settled = known("settled", settled_schema, "NOT state")
    throttled = settled.where("outcome = 'throttled'")
    since = throttled.groupBy("client_id", "ends").agg(F.min("ts").alias("since"))
    id_, none = F.when(F.col("has_id"), F.col("click_id")).alias("click_id"), F.lit(None).cast("long")
    out = throttled.join(since, ["client_id", "ends"]).select(id_, "outcome", "batch", F.col("credit").alias("credit_after"), F.col("since").alias("penalty_start_us"), F.col("ends").alias("penalty_end_us"))
    out = out.union(settled.where("outcome = 'admitted'").select(id_, "outcome", "batch", "credit", none, none))
    return out.union(known("due", due_schema, "late").select(id_, F.lit("late"), "batch", none, none, none))
