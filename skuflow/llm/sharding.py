"""Sharding by extendible hashing.

A directory entry is a prefix of a record's 60-bit hash. The whole table is one
bucket of depth 0; only a bucket above the byte limit splits on its next bit.
As a bucket's bytes are the sum over all longer prefixes, ``step`` bits are
decided at once: one aggregate over ``step``-bit cells, their sums for every
prefix length, and per cell the shortest prefix that fits. Cells that do not
fit even at full length go on with the next ``step`` bits, and only their
records are looked at again.

A bucket with a single key cannot split: a record above the limit is a shard of
its own, and repeats of one and the same record (equal id and text) are cut
into numbered overflow shards, each within the limit or holding one record.

Records with equal id and text are one row with a count, so repeats cannot make
a hot key. Every shuffle carries sums per cell or narrow rows; shards and
directory stay DataFrames.

Defined cases: a null text has 0 bytes and is told apart from the empty text;
null ids are hashed as null; repeated rows all get a shard; further columns
are dropped by ``assign_shards`` and kept by ``write_shards``, which refuses a
column named ``shard``; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.llm.common import staged

HASH_BITS = 60
STEP = 12
SHARD_BYTES = 8 << 20


def key_hash(id_col: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text."""
    text_key = F.coalesce(F.md5(text.cast("binary")), F.lit("null"))
    key = F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("null")), text_key).cast("binary"))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def _prefix(depth: Column) -> Column:
    return F.call_function("shiftright", F.col("h"), F.lit(HASH_BITS) - depth)


def _directory(records: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """For each ``high``-bit cell of the records: depth, bytes and keys of its bucket; depth is null if none fits."""
    cells = records.groupBy(_prefix(F.lit(high)).alias("cell")).agg(
        F.sum(F.col("n_bytes") * F.col("copies")).alias("b"), F.sum("copies").alias("c"),
        F.min("h").alias("lo"), F.max("h").alias("hi"))
    longer = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "prefix", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
    buckets = longer.groupBy("depth", "prefix").agg(
        F.sum("b").alias("shard_bytes"), F.sum("c").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
    best = longer.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("bucket"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "bucket.*")


def _placed(df: DataFrame, id_col: str, text_col: str, limit: int, step: int) -> DataFrame:
    """Distinct records with their number of copies and their bucket."""
    rows = df.select(F.col(id_col).alias("id"),
                     F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                     key_hash(F.col(id_col), F.col(text_col)).alias("h"))
    open_records = staged(rows.groupBy("id", "n_bytes", "h").agg(F.count("*").alias("copies")), "shard-keys")
    done, low = [], 0
    while True:
        high = min(low + step, HASH_BITS)
        directory = staged(_directory(open_records, limit, low, high), "shard-directory")
        placed = open_records.join(directory, _prefix(F.lit(high)) == F.col("cell"))
        done.append(placed.where(F.col("depth").isNotNull()))
        if high == HASH_BITS or directory.where(F.col("depth").isNull()).isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_records = staged(placed.where(F.col("depth").isNull()).select(open_records.columns), "shard-keys")
        low = high + 1


def _overflows(limit: int) -> Column:
    return (F.col("copies") > 1) & (F.col("shard_bytes") > limit)


def _shard(limit: int) -> Column:
    """Hash prefix in bits, with the overflow shard's number from the row's ``copy`` where the bucket is above the limit."""
    per_shard = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    number = F.concat(F.lit("."), F.floor(F.col("copy") / per_shard).cast("string"))
    return F.concat(_bits(F.col("prefix"), F.col("depth")), F.when(_overflows(limit), number).otherwise(""))


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES,
                  step: int = STEP) -> DataFrame:
    """``(id, n_bytes, shard, depth, shard_bytes, shard_docs)`` for each row; ``shard`` is the hash prefix in bits.

    ``shard_bytes`` and ``shard_docs`` are the bucket's; an overflow shard holds at most ``limit`` of them.
    """
    numbered = _placed(df, id_col, text_col, limit, step).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return numbered.select(
        F.col("id").alias(id_col), "n_bytes", _shard(limit).alias("shard"),
        F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = SHARD_BYTES, step: int = STEP) -> None:
    """Write all rows with all columns as one folder ``shard=p<shard>`` per shard of ``assign_shards`` below ``path``.

    Rows of a record that overflows are numbered within the task that read them and moved on by the rows of earlier
    tasks, so a record with very many rows is never one task's work.
    """
    if "shard" in df.columns:
        raise ValueError("the column name 'shard' is taken by the folders")
    # Written once, so that tasks and row numbers are the same whenever they are read.
    rows = staged(df.select(F.struct("*").alias("row"), key_hash(F.col(id_col), F.col(text_col)).alias("h"),
                            F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    places = staged(_placed(rows.select("row.*"), id_col, text_col, limit, step).drop("id", "cell"), "shard-places")
    over = places.where(_overflows(limit)).select("h")
    counts = rows.join(over, "h").groupBy("h", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("h", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    in_task = F.row_number().over(Window.partitionBy("h", "task").orderBy("at")) - 1
    numbered = (rows.join(over, "h").withColumn("number", in_task).join(starts, ["h", "task"])
                .select("row", "h", (F.col("number") + F.col("start")).alias("copy")))
    single = rows.join(over, "h", "left_anti").select("row", "h", F.lit(0).cast("long").alias("copy"))
    (numbered.unionByName(single).join(places, "h")
     .select("row.*", F.concat(F.lit("p"), _shard(limit)).alias("shard"))
     .repartition("shard").write.mode("errorifexists").partitionBy("shard").parquet(path))


ORACLE = f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h
  FROM documents
), p AS (
  SELECT r.*, d::INTEGER AS depth, h >> (60 - d) AS prefix FROM r, range(0, 61) t(d)
), b AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) AS lo, max(h) AS hi
  FROM p GROUP BY depth, prefix
), f AS (
  SELECT p.doc_id, p.n_bytes, p.h, min(p.depth) AS depth FROM p JOIN b USING (depth, prefix)
  WHERE b.shard_bytes <= {SHARD_BYTES} OR b.lo = b.hi GROUP BY ALL
)
SELECT f.doc_id, f.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(b.prefix), f.depth, '0') END AS shard,
       f.depth, b.shard_bytes, b.shard_docs
FROM f JOIN b ON b.depth = f.depth AND b.prefix = (f.h >> (60 - f.depth))
"""
