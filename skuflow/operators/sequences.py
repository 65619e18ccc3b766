"""Skew-safe running change counts per key (a parallel segmented scan).

``version = 1 + number of attribute changes so far`` within a key, in order,
is a running sum over a lag - normally a window partitioned by the key, which
puts every row of a hot key into one task. Here:

1. rows are range-partitioned on (key, order), so a hot key spans many
   partitions, sorted within partitions, and checkpointed so both passes see
   identical partitions (reliable checkpoint in the shared folder);
2. pass A computes, per partition, the local running change count of each key
   segment and emits one boundary summary row (first / last key and
   attributes, counts) - at most one row per partition;
3. the driver folds those few rows into a starting version for the first
   segment of every partition (only a partition's first segment can continue
   a key from earlier partitions);
4. pass B recomputes the local counts and adds the carries.

Keys and attributes are compared as JSON strings of their structs, which
gives null-safe equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from skuflow.session import checkpoint_dir

_SENTINEL = "\x00<none>"


def ranged(df: DataFrame, cols: list, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted on ``cols``, with the stored partition's number as ``_pid``. A
    reliable checkpoint keeps rows and partitions as they are for all passes that follow."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_pid", F.spark_partition_id())
            .checkpoint(eager=True))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(stored partition id, rows): a task may hold several stored partitions, one after the other."""
    for pdf in batches:
        if pdf.empty:
            continue
        pid = pdf["_pid"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(pid[a]), pdf.iloc[a:b]


def _local(batches: Iterator[pd.DataFrame]):
    """Yield (partition id, rows, psi, local_cum) with state carried across batches.

    psi: 1-based segment index within the stored partition; local_cum: running
    change count within the segment (0 at a segment's first row).
    """
    prev_k, prev_a, prev_cum, segs, prev_pid = _SENTINEL, _SENTINEL, 0, 0, None
    for pid, pdf in _runs(batches):
        if pid != prev_pid:
            prev_k, prev_a, prev_cum, segs, prev_pid = _SENTINEL, _SENTINEL, 0, 0, pid
        k = pdf["_k"].to_numpy(dtype=object)
        a = pdf["_a"].to_numpy(dtype=object)
        pk = np.empty(len(k), dtype=object)
        pa = np.empty(len(a), dtype=object)
        pk[0], pa[0] = prev_k, prev_a
        pk[1:], pa[1:] = k[:-1], a[:-1]
        new_seg = k != pk
        flag = ((~new_seg) & (a != pa)).astype(np.int64)
        seg_id = np.cumsum(new_seg)  # 0 = continues the previous batch's segment
        cs = np.cumsum(flag)
        before = cs - flag
        first_idx = np.flatnonzero(np.r_[True, seg_id[1:] != seg_id[:-1]])
        start = np.repeat(before[first_idx], np.diff(np.r_[first_idx, len(k)]))
        local = cs - start + np.where(seg_id == 0, prev_cum, 0)
        psi = segs + seg_id
        yield pid, pdf, psi, local
        prev_k, prev_a, prev_cum, segs = k[-1], a[-1], int(local[-1]), int(psi[-1])


_SUMMARY = ("pid int, first_k string, first_a string, last_k string, last_a string, "
            "first_seg_cum long, last_seg_cum long, segments long")


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One boundary row per stored partition."""
    now: dict | None = None
    for pid, pdf, psi, local in _local(batches):
        if now is None or now["pid"] != pid:
            if now is not None:
                yield pd.DataFrame([now])
            now = {"pid": pid, "first_k": pdf["_k"].iloc[0], "first_a": pdf["_a"].iloc[0], "first_seg_cum": 0}
        in_first = psi == 1
        if in_first.any():
            now["first_seg_cum"] = int(local[in_first][-1])
        now |= {"last_k": pdf["_k"].iloc[-1], "last_a": pdf["_a"].iloc[-1],
                "last_seg_cum": int(local[-1]), "segments": int(psi[-1])}
    if now is not None:
        yield pd.DataFrame([now])


def running_change_versions(df: DataFrame, key_cols: list[str], order_cols: list[str], attr_cols: list[str],
                            out: str = "version", partitions: int | None = None) -> DataFrame:
    """``out`` = 1 + number of attribute changes up to each row within its key."""
    spark = df.sparkSession
    prepared = df.withColumn("_k", F.to_json(F.struct(*key_cols))).withColumn("_a", F.to_json(F.struct(*attr_cols)))
    layout = ranged(prepared, [*key_cols, *order_cols], partitions)
    rows = sorted(layout.select("_pid", "_k", "_a").mapInPandas(_summaries, _SUMMARY).collect(), key=lambda r: r.pid)
    carry: dict[int, int] = {}
    prev = None  # (last_k, last_a, version of the partition's last row)
    for r in rows:
        base = 1
        if prev is not None and r.first_k == prev[0]:
            base = prev[2] + (1 if r.first_a != prev[1] else 0)
        carry[r.pid] = base
        last_version = base + r.first_seg_cum if r.segments == 1 else 1 + r.last_seg_cum
        prev = (r.last_k, r.last_a, last_version)
    bc = spark.sparkContext.broadcast(carry)
    schema = StructType([*layout.schema.fields, StructField(out, IntegerType())])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pid, pdf, psi, local in _local(batches):
            base = bc.value.get(pid, 1)
            yield pdf.assign(**{out: np.where(psi == 1, base + local, 1 + local).astype(np.int32)})

    return layout.mapInPandas(apply, schema).drop("_k", "_a", "_pid")


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each stored partition."""
    last = None
    for pid, pdf in _runs(batches):
        if pid != last:
            yield pd.DataFrame({"pid": [pid], "k": [pdf["_k"].iloc[0]], "v": [pdf["_v"].iloc[0]]})
            last = pid


def next_in_key(df: DataFrame, key_cols: list[str], order_cols: list[str], value_col: str, out: str,
                partitions: int | None = None) -> DataFrame:
    """``out`` = ``value_col`` (a timestamp) of the next row of the same key, NULL at its end.

    The same layout as ``running_change_versions``: a hot key spans many range
    partitions; a partition's last row takes its successor from the first row
    of the next partition that has rows (one row per partition on the driver).
    """
    spark = df.sparkSession
    prepared = df.withColumn("_k", F.to_json(F.struct(*key_cols))).withColumn("_v", F.unix_micros(value_col))
    layout = ranged(prepared, [*key_cols, *order_cols], partitions)
    heads = sorted(layout.select("_pid", "_k", "_v").mapInPandas(_heads, "pid int, k string, v long").collect(),
                   key=lambda r: r.pid)
    follows = spark.sparkContext.broadcast({a.pid: (b.k, b.v) for a, b in zip(heads[:-1], heads[1:], strict=True)})
    schema = StructType([*layout.schema.fields, StructField("_next", LongType())])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the run's last row, until its successor is known
        for pid, pdf in _runs(batches):
            if held is not None:
                if int(held["_pid"].iloc[0]) == pid:
                    pdf = pd.concat([held, pdf])
                else:
                    yield _with_next(held, follows.value.get(int(held["_pid"].iloc[0])))
            if len(pdf) > 1:
                yield _with_next(pdf.iloc[:-1], (pdf["_k"].iloc[-1], pdf["_v"].iloc[-1]))
            held = pdf.iloc[-1:]
        if held is not None:
            yield _with_next(held, follows.value.get(int(held["_pid"].iloc[0])))

    found = layout.mapInPandas(apply, schema)
    return found.withColumn(out, F.timestamp_micros("_next")).drop("_k", "_v", "_pid", "_next")


def _with_next(pdf: pd.DataFrame, after: tuple | None) -> pd.DataFrame:
    k, v = pdf["_k"].to_numpy(dtype=object), pdf["_v"].to_numpy(dtype=object)
    next_k, next_v = np.append(k[1:], None), np.append(v[1:], None)
    if after is not None:
        next_k[-1], next_v[-1] = after
    return pdf.assign(_next=pd.array(np.where(next_k == k, next_v, None), dtype="Int64"))


def _last_given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stored partition: first and last key, and the last given value if it belongs to the last key."""
    pid = first = last = value = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, values = batch.column("_k"), batch.column("_v")
        if pid is None:
            pid, first = batch.column("_pid")[0].as_py(), keys[0].as_py()
        end = keys[batch.num_rows - 1].as_py()
        value, last = (value if end == last else None), end
        given = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        if len(given) and keys[int(given[-1])].as_py() == end:
            value = values[int(given[-1])].as_py()
    if pid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), *(pa.array([x], pa.string()) for x in (first, last, value))],
                                         names=["pid", "first", "last", "value"])


def carry_forward(df: DataFrame, key_cols: list[str], order_cols: list[str], value_col: str,
                  partitions: int | None = None) -> DataFrame:
    """``value_col`` (a string) of each row, or of the last row before it in its key that has one.

    The same layout again: a value is filled forward within a stored partition, and the one at a
    partition's end (one row per partition on the driver) goes on into the next while its key does.
    """
    spark = df.sparkSession
    prepared = df.withColumn("_k", F.to_json(F.struct(*key_cols))).withColumn("_v", F.col(value_col))
    layout = ranged(prepared, [*key_cols, *order_cols], partitions)
    ends = sorted(layout.select("_pid", "_k", "_v").mapInArrow(_last_given, "pid int, first string, last string, value string")
                  .collect(), key=lambda r: r.pid)
    carry: dict[int, str | None] = {}
    key = value = None
    for e in ends:
        carry[e.pid] = value if e.first == key else None
        value = e.value if e.value is not None or e.last != e.first else carry[e.pid]
        key = e.last
    shared = spark.sparkContext.broadcast(carry)
    place = layout.columns.index(value_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = value = None
        started = False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, values = batch.column("_k"), batch.column("_v")
            if not started:
                started, key, value = True, keys[0].as_py(), shared.value.get(batch.column("_pid")[0].as_py())
            elif keys[0].as_py() != key:
                value = None
            code = keys.dictionary_encode().indices.to_numpy()
            begin = np.maximum.accumulate(np.where(np.r_[True, code[1:] != code[:-1]], np.arange(n), 0))
            at = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
            # Places in the batch's own values, or n for the value carried into it, n + 1 for none.
            at = np.where(at >= begin, at, np.where(begin == 0, n, n + 1))
            filled = pa.concat_arrays([values, pa.array([value, None], values.type)]).take(pa.array(at))
            key, value = keys[n - 1].as_py(), filled[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([filled if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return layout.mapInArrow(apply, layout.schema).drop("_k", "_v", "_pid")
