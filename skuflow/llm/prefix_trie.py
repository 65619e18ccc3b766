"""Conversation prefix trie: rebuilt conversations, their shared prefixes, and figures per prefix.

A conversation's turns (role, text) are digested to 16 bytes each and joined, in
the order of turns, to a path; ``rebuilt`` puts the head's first turns in front
(see there). The paths are range-partitioned and sorted on (path, conversation),
so that all conversations below a node of the trie are neighbours and a very
common first turn, or a conversation copied very often, spreads over many
partitions. Each partition is cut into prefix shards of at most
``SHARD_TURNS`` turns (or one conversation).

A shard numbers its distinct turns densely, packs its trie into BASE and CHECK
arrays and lets all its conversations traverse them at once, turn by turn; the
figures of the nodes are counted at the cells that they pass. A node that also
occurs in a neighbouring shard lies on the path that the two rows at the
border have in common. Shards report such upper nodes with a digest of their
path and with figures that only have to be added: members, the children and
texts that occur here first, the leaves that end here. Spark merges those rows
by digest; all other nodes are complete as they leave their shard.

The driver sees the first and the last path of each partition, as much as range
partitioning itself looks at, and a broadcast of two numbers per partition.

Defined cases: rows without a conv_id take no part; a null turn comes first,
rows of equal turns follow the digests of (role, text); null role or text is
empty; repeated rows are turns of their own; conversations without any turn
end at the root; a negative conv_id has the head ``c - c % 100`` with SQL's
remainder, which has the sign of c; further columns are ignored, whatever their
names; an empty table has no nodes, not even a root. A conversation's path is
one value, 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches, staged
from skuflow.llm.double_array import pack
from skuflow.session import checkpoint_dir

SHARD_TURNS = 200_000
BROADCAST_ROWS = 200_000
EMPTY = hashlib.sha256(b"").hexdigest()
WIDTH = 16

_NODE = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string, ends string, first_end long")


def conversations(df: DataFrame) -> DataFrame:
    """``(head, conv_id, path, sizes)``: digests of a conversation's turns in order, and their code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = df.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % 100).cast("long").alias("head"), F.col("conv_id").cast("long"),
        F.struct(F.col("turn").alias("t"), digest.alias("d"), F.char_length(text).alias("n")).alias("turn"))
    # One shuffle, by head: conversations and the heads they take turns from meet in place.
    grouped = turns.repartition("head").groupBy("head", "conv_id").agg(F.array_sort(F.collect_list("turn"), _by_turn).alias("ts"))
    return grouped.select("head", "conv_id", F.unhex(F.array_join("ts.d", "")).alias("path"), F.col("ts.n").alias("sizes"))


def _by_turn(a, b):
    less = (a["t"].isNull() & b["t"].isNotNull()) | (a["t"] < b["t"])
    more = (b["t"].isNull() & a["t"].isNotNull()) | (b["t"] < a["t"])
    tie = F.when(a["d"] < b["d"], -1).when(a["d"] > b["d"], 1).otherwise(0)
    return F.when(less, -1).when(more, 1).otherwise(tie)


def rebuilt(df: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)``: the first h turns of conversation ``c - c % 100``, then c's own after its
    first h; h is the CRC-32 of c in decimal, modulo 6."""
    own = conversations(df).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))
    heads = own.where("conv_id = head").select(
        F.col("head").alias("of"), F.substring("path", 1, 5 * WIDTH).alias("head_path"), F.slice("sizes", 1, 5).alias("head_sizes"))
    both = own.join(heads, F.col("head") == F.col("of"), "left")
    before = F.coalesce(F.expr(f"substring(head_path, 1, h * {WIDTH})"), F.lit(b""))
    sizes = F.coalesce(F.expr("slice(head_sizes, 1, h)"), F.array().cast("array<int>"))
    return both.select("conv_id", F.concat(before, F.expr(f"substring(path, h * {WIDTH} + 1)")).alias("path"),
                       F.concat(sizes, F.expr("slice(sizes, h + 1, greatest(size(sizes) - h, 0))")).alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(np.argmax(x)) // WIDTH


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last path of each partition."""
    pid = first = last = None
    for batch in batches:
        if batch.num_rows:
            pid = batch.column("pid")[0].as_py()
            first = batch.column("path")[0].as_py() if first is None else first
            last = batch.column("path")[batch.num_rows - 1].as_py()
    if pid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())],
                                         names=["pid", "first", "last"])


def _keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the path's first 0, 1, ... ``depth`` turns."""
    md5 = hashlib.md5()
    out = [md5.digest()]
    for d in range(depth):
        md5.update(path[d * WIDTH:(d + 1) * WIDTH])
        out.append(md5.copy().digest())
    return out


def _dense(paths: list[bytes]) -> np.ndarray:
    """A number from 1 for each turn of the joined paths, equal for equal turns."""
    halves = np.frombuffer(b"".join(paths), dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ranked = halves[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def shard_nodes(ids: list[int], paths: list[bytes], sizes: list[np.ndarray], before: int, after: int) -> pa.RecordBatch:
    """Node rows of one shard; ``before`` / ``after``: turns in common with the neighbouring rows, -1 without any."""
    rows = len(ids)
    length = np.array([len(p) // WIDTH for p in paths], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(length)])
    code, size = _dense(paths), np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)
    deepest = int(length.max(initial=0))

    # Rows are sorted, so those of a node are neighbours: a node begins where parent or turn changes.
    parent, turn, depth, chars = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([0])]
    active, node, count = np.arange(rows), np.zeros(rows, dtype=np.int64), 1
    for d in range(deepest):
        active = active[length[active] > d]
        at = offset[active] + d
        new = np.ones(len(active), dtype=bool)
        new[1:] = (node[active[1:]] != node[active[:-1]]) | (code[at[1:]] != code[at[:-1]])
        parent.append(node[active[new]])
        turn.append(code[at[new]])
        depth.append(np.full(int(new.sum()), d + 1))
        chars.append(size[at[new]])
        node[active] = count + np.cumsum(new) - 1
        count += int(new.sum())
    first_of = np.cumsum([0, *(len(p) for p in parent)])
    parent, turn, depth, chars = map(np.concatenate, (parent, turn, depth, chars))

    trie = pack(parent, turn)
    node_at = np.zeros(len(trie.check), dtype=np.int64)
    node_at[trie.cell] = np.arange(count)

    conv = np.array(ids, dtype=np.int64)
    members, least = np.zeros(count, dtype=np.int64), np.full(count, np.iinfo(np.int64).max)
    members[0], least[0] = rows, conv.min()
    state, end, left, right = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), [0], [0]
    active = np.arange(rows)
    for d in range(deepest):
        active = active[length[active] > d]
        state[active] = trie.step(state[active], code[offset[active] + d])
        passed = node_at[state[active]]
        np.add.at(members, passed, 1)
        np.minimum.at(least, passed, conv[active])
        end[active] = passed
        if active[0] == 0:
            left.append(int(passed[0]))
        if active[-1] == rows - 1:
            right.append(int(passed[-1]))

    owned = np.ones(count, dtype=np.int64)
    owned[left[:before + 1]] = 0
    shared = np.zeros(count, dtype=bool)
    shared[left[:before + 1]] = True
    shared[right[:after + 1]] = True
    children = np.zeros(count, dtype=np.int64)
    np.add.at(children, parent[1:], owned[1:])
    leaves, saved = np.zeros(count, dtype=np.int64), (members - owned) * chars
    extended = np.array([paths[i + 1].startswith(paths[i]) for i in range(rows - 1)] + [after >= length[-1]], dtype=bool)
    np.add.at(leaves, end[~extended], 1)
    for d in range(len(first_of) - 2, 0, -1):
        level = slice(first_of[d], first_of[d + 1])
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])

    keys: list[bytes | None] = [None] * count
    for path, nodes, upto in ((paths[0], left, before), (paths[-1], right, after)):
        for n, key in zip(nodes, _keys(path, min(upto, len(path) // WIDTH)) if upto >= 0 else [], strict=False):
            keys[n] = key
    whole: list[str | None] = [None if s else EMPTY for s in shared.tolist()]
    text: list[str | None] = [None] * count
    first_end: list[int | None] = [None] * count
    order = np.argsort(end, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(end[order]) != 0, True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n, joined = int(end[order[a]]), ",".join(str(ids[i]) for i in order[a:b])
        if shared[n]:
            text[n], first_end[n] = joined, ids[order[a]]
        else:
            whole[n] = hashlib.sha256(joined.encode()).hexdigest()
    above = [keys[p] if p >= 0 else None for p in parent.tolist()]
    from_shared = np.where(parent >= 0, shared[parent], True)
    return pa.RecordBatch.from_arrays([
        pa.array(keys, pa.binary()), pa.array(above, pa.binary()), pa.array(least), pa.array(depth),
        pa.array(least[parent], mask=from_shared), pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved),
        pa.array(whole, pa.string()), pa.array(text, pa.string()), pa.array(first_end, pa.int64())],
        names=[c.split()[0] for c in _NODE.split(", ")])


def _shards(borders: dict[int, tuple[int, int]], limit: int):
    """Node rows of a sorted partition, shard by shard, with one row of outlook."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, np.ndarray]] = []
        weight, before, after = 0, -1, -1
        started = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not started:
                started = True
                before, after = borders[batch.column("pid")[0].as_py()]
            sizes = batch.column("sizes")
            for i, (c, p) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                if weight >= limit:
                    shares = common(held[-1][1], p)
                    yield shard_nodes(*map(list, zip(*held, strict=True)), before, shares)
                    held, weight, before = [], 0, shares
                held.append((c, p, np.asarray(sizes[i].values, dtype=np.int64)))
                weight += 1 + len(p) // WIDTH
        if held:
            yield shard_nodes(*map(list, zip(*held, strict=True)), before, after)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, which come in order, joined by commas."""
    key, sha = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                sha.update(b",")
            else:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(text.encode())
        yield _hashed(done)
    if key is not None:
        yield _hashed([(key, sha.hexdigest())])


def _hashed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())],
                                      names=["key", "ends_sha256"])


def nodes(paths: DataFrame, partitions: int | None = None, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``(conv_id, path, sizes)``; see ``prefix_trie``."""
    spark = paths.sparkSession
    bound_batches(spark)
    checkpoint_dir(spark)
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = staged(paths, "rebuilt")
    # A checkpoint keeps partitions as they are, so that neighbours stay neighbours.
    ranged = (kept.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
              .withColumn("pid", F.spark_partition_id()).checkpoint(eager=True))
    edges = sorted(ranged.select("pid", "path").mapInArrow(_edges, "pid int, first binary, last binary").collect(), key=lambda r: r.pid)
    shares = [-1, *(common(bytes(a.last), bytes(b.first)) for a, b in zip(edges[:-1], edges[1:], strict=True)), -1]
    borders = {r.pid: (shares[i], shares[i + 1]) for i, r in enumerate(edges)}
    made = staged(ranged.mapInArrow(_shards(borders, shard_turns), _NODE), "trie-nodes")

    upper = made.where("key IS NOT NULL")
    ends = (upper.where("ends IS NOT NULL").select("key", "ends", "first_end").repartition("key")
            .sortWithinPartitions("key", "first_end").select("key", "ends").mapInArrow(_hash_ends, "key binary, ends_sha256 string"))
    merged = upper.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    merged = staged(merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie-upper")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    if merged.count() <= BROADCAST_ROWS:
        parents = F.broadcast(parents)
    lower = made.where("key IS NULL")
    below = lower.where("parent_key IS NOT NULL").drop("parent_conv_id").join(parents, "parent_key")
    inner = merged.where("parent_key IS NOT NULL").join(parents, "parent_key")
    root = merged.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = [x.select(*columns) for x in (lower.where("parent_key IS NULL"), below, inner, root)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def prefix_trie(df: DataFrame) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations of ``(conv_id, turn, role, text)``: smallest member,
    depth, the parent's smallest member, members, children, leaves below, tokens saved below, digest of
    the conversations that end there."""
    return nodes(rebuilt(df))


# CRC-32 of a decimal number's digits (reflected polynomial 0xEDB88320), bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({c}) + 1), lambda i: ascii(substr({c}, i, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""

ORACLE = f"""
WITH own AS (
  SELECT conv_id, list(sha256(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts,
         list(len(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
numbered AS (SELECT *, {_CRC32.format(c="CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, coalesce(o.ts[1:c.h], []) || c.ts[c.h + 1:] AS ts, coalesce(o.ns[1:c.h], []) || c.ns[c.h + 1:] AS ns
  FROM numbered c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100),
passed AS (SELECT conv_id, unnest(range(0, len(ts) + 1)) AS depth, ts, ns FROM rebuilt),
keyed AS (SELECT conv_id, depth, ts[1:depth] AS path, ts[1:depth - 1] AS above, len(ts) = depth AS ends,
                 CASE WHEN depth > 0 THEN ns[depth] ELSE 0 END AS chars, ts FROM passed),
nodes AS (
  SELECT path, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM keyed GROUP BY path, depth),
kids AS (SELECT above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.above = n.path),
steps AS (SELECT path, unnest(range(0, depth + 1)) AS d, n_children, (n_convs - 1) * chars AS saved FROM full_nodes),
upwards AS (SELECT path[1:d] AS top, n_children, saved FROM steps),
below AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM upwards GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.top = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.above
"""
