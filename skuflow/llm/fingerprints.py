"""Document fingerprints as invertible Bloom lookup sketches (native expressions only).

A text's paragraphs (lines, long ones cut every ``BLOCK_WORDS`` words) are
digested to 64 bits. The sketch adds each distinct digest to three cells; a cell
holds a count, the xor of its digests and the xor of their check hashes. Two
sketches of the same shape subtract cell by cell: what both texts have cancels,
and what is left is recovered by peeling - a cell with count 1 or -1 whose check
fits holds one digest, which is taken out of its three cells, and so on.

So that the work stays linear in the text, a sketch is a row of bins of
``CELLS`` cells and a digest's bin depends on its hash; the number of bins
follows the number of digests over ``LOADS[attempt]``, so a smaller load is a
larger sketch. Where peeling gets stuck, the digests of that bin are tried again
in the next, larger sketch. Likeness is ``1 - differing / (digests of both)``, 1 for two
texts without a word.

**Next document.** The ids are cut into ranges by a range partitioning of the id
column alone, and quantiles within each partition; the driver gets one id per
range, at most ``RANGES_PER_TASK * MAX_TASKS`` of them. The texts are shuffled once, by range, and the first document of each range also goes to
the range before, so that every document finds its successor in its own window,
which holds about ``RANGE_ROWS`` documents.

Defined cases: a null text counts as empty; ids ascend, rows with equal ids in
the order of a hash of their text; rows with a null id have no successor (their
edited text only loses its second half, and they are compared with the empty
text); a single document follows itself; further columns are dropped; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WORDS = 32
CELLS = 33
LOADS = (8, 4, 2, 1)
PEEL_ROUNDS = 10
RANGE_ROWS = 256
RANGES_PER_TASK = 64
MAX_TASKS = 2000

CHECK = 1000
_DIGESTS = "array<struct<d:bigint,sign:int>>"


def paragraph_digests(text: Column, block_words: int = BLOCK_WORDS) -> Column:
    """Distinct digests of a text's paragraphs."""
    word = r"\S{1,200}+"
    blocks = F.regexp_extract_all(text, F.lit(rf"({word}(?:[^\S\n]*+{word}){{0,{block_words - 1}}}+)"), F.lit(1))
    return F.array_distinct(F.transform(blocks, lambda b: F.xxhash64(b)))


def _item(d: Column, attempt: int) -> Column:
    third = CELLS // 3
    cells = [(F.pmod(F.xxhash64(d, F.lit(10 * attempt + j)), F.lit(third)).cast("int") + j * third).alias("abc"[j])
             for j in range(3)]
    return F.struct(d.alias("d"), F.xxhash64(d, F.lit(CHECK)).alias("check"), *cells)


def _holds(item: Column, i: Column) -> Column:
    return (item["a"] == i) | (item["b"] == i) | (item["c"] == i)


def _add(cell: Column, item: Column, sign: Column) -> Column:
    return F.struct((cell["n"] + sign).alias("n"), cell["key"].bitwiseXOR(item["d"]).alias("key"),
                    cell["check"].bitwiseXOR(item["check"]).alias("check"))


def bins_for(digests: Column, load: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(digests) / F.lit(load))).cast("int")


def _bin(d: Column, bins: Column, attempt: int) -> Column:
    return F.pmod(F.xxhash64(d, F.lit(CHECK + 1 + attempt)), bins).cast("int")


def sketch(digests: Column, bins: Column, attempt: int = 0) -> Column:
    """The sketch: an array of bins, each an array of cells ``(n, key, check)``."""
    items = F.transform(digests, lambda d: F.struct(
        _bin(d, bins, attempt).alias("bin"), _item(d, attempt).alias("item")))
    empty = F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"),
                                    F.lit(0).cast("long").alias("check")), CELLS)

    def fill(members: Column) -> Column:
        return F.aggregate(members, empty, lambda cells, m: F.transform(
            cells, lambda cell, i: F.when(_holds(m["item"], i), _add(cell, m["item"], F.lit(1))).otherwise(cell)))

    return F.transform(F.array(items), lambda all_items: F.transform(
        F.sequence(F.lit(0), bins - 1),
        lambda b: fill(F.filter(all_items, lambda m: m["bin"] == b))))[0]


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: F.struct(
        (p["n"] - q["n"]).alias("n"), p["key"].bitwiseXOR(q["key"]).alias("key"),
        p["check"].bitwiseXOR(q["check"]).alias("check"))))


def _peel_bin(cells: Column, attempt: int) -> Column:
    """``(d, sign)`` of every digest left in a bin; null if peeling gets stuck."""
    def one_round(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (F.xxhash64(x["key"], F.lit(CHECK)) == x["check"]))
        pure = F.array_distinct(F.transform(single, lambda x: F.struct(x["n"].alias("sign"), _item(x["key"], attempt).alias("item"))))
        return F.transform(F.array(pure), lambda found: F.struct(
            F.when(F.size(found) == 0, state["cells"]).otherwise(F.transform(state["cells"], lambda cell, i: F.aggregate(
                F.filter(found, lambda p: _holds(p["item"], i)), cell, lambda c, p: _add(c, p["item"], -p["sign"])))).alias("cells"),
            F.concat(state["found"], F.transform(found, lambda p: F.struct(
                p["item"]["d"].alias("d"), p["sign"].alias("sign")))).alias("found")))[0]

    start = F.struct(cells.alias("cells"), F.array().cast(_DIGESTS).alias("found"))
    clear = lambda s: F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["key"] == 0) & (x["check"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEEL_ROUNDS)), start, one_round,
                       lambda s: F.when(clear(s), s["found"]))


def _attempt(state: Column, number: int, load: int) -> Column:
    """The state ``(a, b, found)`` after one more attempt: what is found, and the digests of stuck bins."""
    bins = F.greatest(bins_for(state["a"], load), bins_for(state["b"], load))
    left = F.transform(subtract(sketch(state["a"], bins, number), sketch(state["b"], bins, number)),
                       lambda x: _peel_bin(x, number))

    def after(peeled: Column) -> Column:
        stuck = lambda d: F.get(peeled, _bin(d, bins, number)).isNull()
        return F.struct(
            F.filter(state["a"], stuck).alias("a"), F.filter(state["b"], stuck).alias("b"),
            F.concat(state["found"], F.flatten(F.filter(peeled, lambda x: x.isNotNull()))).alias("found"))

    done = F.size(state["a"]) + F.size(state["b"]) == 0
    return F.when(done, state).otherwise(F.transform(F.array(left), after)[0])


def with_difference(df: DataFrame, a: str, b: str, out: str, loads: tuple[int, ...] = LOADS) -> DataFrame:
    """``out``: ``(d, sign)`` of the digests that only column ``a`` (1) or only ``b`` (-1) has, by subtracting and
    peeling sketches.

    Each attempt holds the digests of the bins in which the one before got stuck, in a sketch that is larger for their
    number. Null if digests are left after the last of ``loads``.
    """
    steps = [f"_{out}_{i}" for i in range(len(loads) + 1)]
    df = df.withColumn(steps[0], F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.array().cast(_DIGESTS).alias("found")))
    for i, load in enumerate(loads):
        df = df.withColumn(steps[i + 1], _attempt(F.col(steps[i]), i, load))
    last = F.col(steps[-1])
    return df.withColumn(out, F.when(F.size(last["a"]) + F.size(last["b"]) == 0, last["found"])).drop(*steps)


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """1 for equal sets of digests, 0 for sets without a common one, from their recovered difference.

    Null differences (after all attempts, about one in a thousand million) count by plain set difference.
    """
    total = F.size(a) + F.size(b)
    plain = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    n = F.when(differing.isNull(), plain).otherwise(F.size(differing))
    return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - n / total)


def fingerprint(digests: Column) -> Column:
    """The sketch of one text as a string: number of bins, then its used cells."""
    bins = bins_for(digests, LOADS[0])
    cells = F.transform(sketch(digests, bins), lambda cells, b: F.transform(cells, lambda c, i: F.when(
        c["n"] != 0, F.concat_ws(".", F.hex(b * CELLS + i), F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"])))))
    return F.concat(bins.cast("string"), F.lit(":"), F.array_join(F.flatten(cells), ","))


def _range_starts(ids: DataFrame, rows_per_range: int) -> list:
    """The first id of each range of ids, ascending: a range partitioning into few tasks, and quantiles within each."""
    rows = ids.count()
    tasks = max(1, min(MAX_TASKS, -(-rows // (RANGES_PER_TASK * rows_per_range))))
    pieces = max(1, min(RANGES_PER_TASK, -(-rows // (tasks * rows_per_range))))
    cuts = F.array(*[F.lit(k / pieces) for k in range(1, pieces)]) if pieces > 1 else F.array(F.lit(0.0))
    found = (ids.repartitionByRange(tasks, "id").groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min("id").alias("first"), F.percentile_approx("id", cuts, 10_000).alias("cuts")).collect())
    return sorted({x for r in found for x in (r.first, *r.cuts)})


def _ids(values: list) -> Column:
    """Integer ids as one array literal."""
    return F.expr(f"array({', '.join(f'{int(v)}L' for v in values)})")


def _range_of(value: Column, starts: list) -> Column:
    """Number of the last range start not above the value, by binary search."""
    table, steps = _ids(starts), [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at)) - 1


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """``(range, id, text, digests, next_text, next_digests)``: each document with its successor by id."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    starts = _range_starts(docs.where(F.col("id").isNotNull()).select("id"), rows_per_range)
    if starts:
        at = _range_of(F.col("id"), starts)
        before = F.when(F.get(_ids(starts), F.col("at")) == F.col("id"),
                        F.array(F.struct(F.pmod(F.col("at") - 1, F.lit(len(starts))).cast("int").alias("range"),
                                         F.lit(True).alias("copy"))))
    else:
        at, before = F.lit(0), F.lit(None).cast("array<struct<range:int,copy:boolean>>")
    loose = (-1 - F.pmod(F.xxhash64("text"), F.lit(max(1, len(starts))))).cast("int")
    placed = (docs.withColumn("at", F.when(F.col("id").isNull(), loose).otherwise(at).cast("int"))
              .withColumn("to", F.concat(F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("copy"))),
                                         F.coalesce(before, F.array().cast("array<struct<range:int,copy:boolean>>"))))
              .select("id", "text", F.explode("to").alias("to")).select("id", "text", "to.range", "to.copy"))
    wide = placed.repartition("range").withColumn("digests", paragraph_digests(F.col("text")))
    order = Window.partitionBy("range").orderBy("copy", "id", F.xxhash64("text"))
    follows = F.lead(F.struct("text", "digests")).over(order)
    nothing = F.struct(F.lit("").alias("text"), F.array().cast("array<bigint>").alias("digests"))
    return (wide.withColumn("follows", follows).where(~F.col("copy"))
            .withColumn("follows", F.when(F.col("id").isNull() | F.col("follows").isNull(), nothing).otherwise(F.col("follows")))
            .select("id", "text", "digests", F.col("follows.text").alias("next_text"),
                    F.col("follows.digests").alias("next_digests")))


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many from the start of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def compare_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    both = (with_next(df, id_col, text_col).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
            .withColumn("edited_digests", paragraph_digests(F.col("edited"))))
    both = with_difference(both, "digests", "edited_digests", "edit")
    both = with_difference(both, "digests", "next_digests", "step")
    return both.select(
        F.col("id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("digests")).alias("fingerprint"), fingerprint(F.col("edited_digests")).alias("edited_fingerprint"),
        likeness(F.col("digests"), F.col("edited_digests"), F.col("edit")).alias("near_edited"),
        likeness(F.col("digests"), F.col("next_digests"), F.col("step")).alias("near_next"))
