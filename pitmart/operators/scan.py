"""Scans over one long ordered series in many tasks.

A key's line is cut into segments by a function of the order column alone, so rows of equal order stay together and no
sampling is needed: a date is cut every `width` days, a number every `width`.  A first pass works inside (key, segment);
one row a segment then carries totals from segment to segment; a second pass adds them.  The windows of the first pass and
the join of the carries share one partitioning by (key, segment), so rows shuffle once; only the segments of a key, not
its rows, meet in one task.  A scan reads its input twice, so a chain of scans is cut by written tables in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 64
SIZE = 4096
SEGMENT = _SEGMENT = "_segment"
_KEY = "_scan_key"


def _place(df: DataFrame, order: str) -> Column:
    kind = dict(df.dtypes)[order]
    return F.unix_date(order) if kind == "date" else F.unix_seconds(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else F.col(order)


def segmented(df: DataFrame, order: str, width: float | None = WIDTH) -> DataFrame:
    """df with the segment of its line that a row is in; without a width by the leading bits of the order's number."""
    place = _place(df, order)
    return df.withColumn(_SEGMENT, leading_bits(place) if width is None else F.floor(place / width).cast("long"))


def _carried(rows: DataFrame, key: list[str], totals: dict[str, Column], carries: Callable[[Window], dict[str, Column]]) -> DataFrame:
    """rows joined with what the segments before theirs add up to.  Rows without a key are lines of no key: each of their
    segments stands alone."""
    by_segment = rows.groupBy(*key, _SEGMENT).agg(*(c.alias(name) for name, c in totals.items()))
    before = Window.partitionBy(*key).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carry = by_segment.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(_SEGMENT).alias("_carried"), *(c.alias(name) for name, c in carries(before).items()))
    same = F.col(_SEGMENT) == F.col("_carried")
    for i, k in enumerate(key):
        same &= F.col(k) == F.col(f"_k{i}")
    return rows.join(carry, same, "left").drop("_carried", *(f"_k{i}" for i in range(len(key))))


def running(df: DataFrame, key: str | list[str], order: str, sums: dict[str, Column] | None = None, peaks: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, counts: str | None = None, products: dict[str, Column] | None = None, width: float | None = WIDTH) -> DataFrame:
    """df with, of all rows of its key up to each row: sums, products, maxima and the last known value of expressions, and
    the row's number from 1 on.  What a window over the whole key gives, with rows of a key in many tasks.  Order is total in a key.
    Rows that are segmented already, by the same order and width, stay where they are."""
    keys = [key] if isinstance(key, str) else key
    sums, peaks, lasts, products = sums or {}, peaks or {}, lasts or {}, products or {}
    numbered = {counts: F.lit(1).cast("long")} if counts else {}
    rows = df if _SEGMENT in df.columns else segmented(df, order, width)
    value = {n: f"_v_{n}" for n in (*sums, *peaks, *lasts, *products, *numbered)}
    rows = rows.withColumns({value[n]: c for n, c in (sums | peaks | lasts | products | numbered).items()})
    totals = {f"_t_{n}": F.sum(value[n]) for n in (*sums, *numbered)} | {f"_t_{n}": F.max(value[n]) for n in peaks} | {f"_t_{n}": F.product(value[n]) for n in products}
    totals |= {f"_t_{n}": F.max_by(value[n], F.when(F.col(value[n]).isNotNull(), F.col(order))) for n in lasts}
    joined = _carried(rows, keys, totals, lambda w: (
        {f"_c_{n}": F.sum(f"_t_{n}").over(w) for n in (*sums, *numbered)} | {f"_c_{n}": F.max(f"_t_{n}").over(w) for n in peaks} | {f"_c_{n}": F.product(f"_t_{n}").over(w) for n in products} | {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True).over(w) for n in lasts}
    ))
    w = Window.partitionBy(*keys, _SEGMENT).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def plus(a: Column, b: Column) -> Column:
        return F.coalesce(a + b, a, b)

    found = {n: plus(F.sum(value[n]).over(w), F.col(f"_c_{n}")) for n in (*sums, *numbered)}
    found |= {n: F.coalesce(F.col(f"_c_{n}") * F.product(value[n]).over(w), F.product(value[n]).over(w), F.col(f"_c_{n}")) for n in products}
    found |= {n: F.greatest(F.max(value[n]).over(w), F.col(f"_c_{n}")) for n in peaks}
    found |= {n: F.coalesce(F.last(value[n], ignorenulls=True).over(w), F.col(f"_c_{n}")) for n in lasts}
    made = [*value.values(), *(f"_c_{n}" for n in value)]
    return joined.withColumns(found).drop(_SEGMENT, *made)


def run_lengths(df: DataFrame, key: str | list[str], order: str, flag: Column, name: str = "run", width: float | None = WIDTH) -> DataFrame:
    """df with the rows since `flag` last changed: a run that crosses segments goes on from the run that ended the one
    before.  Two scans: where runs begin, then the number of a run's first row."""
    keys = [key] if isinstance(key, str) else key
    rows = neighbours(df.withColumn("_flag", flag), keys, order, {"_before": F.col("_flag"), "_any": F.lit(True)}, width)
    starts = F.col("_any").isNull() | ~F.col("_flag").eqNullSafe(F.col("_before"))
    numbered = running(rows.withColumn("_starts", starts), keys, order, counts="_number", width=width)
    since = running(numbered, keys, order, peaks={"_since": F.when(F.col("_starts"), F.col("_number"))}, width=width)
    return since.withColumn(name, (F.col("_number") - F.col("_since") + 1).cast("int")).drop("_flag", "_before", "_any", "_starts", "_number", "_since")


def neighbours(df: DataFrame, key: list[str], order: str, values: dict[str, Column], width: float | None = WIDTH) -> DataFrame:
    """df with the values of the row before, null for a key's first row."""
    rows = segmented(df, order, width).withColumns({f"_v{n}": c for n, c in values.items()})
    last = F.max_by(F.struct(*(F.col(f"_v{n}").alias(n) for n in values)), order)
    joined = _carried(rows, key, {"_t": last}, lambda w: {"_c": F.last("_t").over(w)})
    w = Window.partitionBy(*key, _SEGMENT).orderBy(order)
    first = F.row_number().over(w) == 1
    return joined.withColumns({n: F.when(first, F.col("_c")[n]).otherwise(F.lag(f"_v{n}").over(w)) for n in values}).drop(_SEGMENT, "_c", *(f"_v{n}" for n in values))


def in_pieces(df: DataFrame, key: str, order: str, back: int, operator: Callable[[DataFrame, str], DataFrame], ahead: int = 0, size: int = SIZE, width: float | None = WIDTH) -> DataFrame:
    """operator(df, key), whose windows reach `back` rows before a row and `ahead` after it, over pieces of `size` rows of a
    key's line.  Pieces carry the rows that their windows reach; the operator is given the piece as its key and has to keep
    it and the order column; the rows that were carried along are left out of its result."""
    numbered = running(df, key, order, counts="_number", width=width)
    zero = F.col("_number") - 1
    pieces = F.sequence(F.greatest(F.lit(0), F.floor((zero - ahead) / size)), F.floor((zero + back) / size))
    dealt = numbered.withColumn("_own", F.floor(zero / size)).withColumn("_piece", F.explode(pieces))
    bounds = numbered.groupBy(F.col(key).alias("_k"), F.floor(zero / size).alias("_p")).agg(F.min(order).alias("_since"), F.max(order).alias("_until"))
    whole = dealt.join(bounds, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_piece") == F.col("_p")))  # a piece without own rows is none
    named = F.struct(F.col(key).alias("key"), F.col("_piece").alias("piece"), F.col("_since").alias("since"), F.col("_until").alias("until"))
    rows = whole.withColumn(_KEY, named).select(_KEY, *(c for c in df.columns if c != key)).withColumnRenamed(_KEY, key)
    out = operator(rows, key)
    own = (F.col(order) >= F.col(key)["since"]) & (F.col(order) <= F.col(key)["until"])
    return out.where(own).withColumn(key, F.col(key)["key"])


def asof(left: DataFrame, right: DataFrame, key: list[str], order: str, values: list[str], strict: bool = False, width: float | None = WIDTH) -> DataFrame:
    """left with the values of the last right row of its key at or before its order, strictly before it on demand.  Both are
    one ordered table cut into segments; a segment is told the last right row before it.  Of right rows of one key and
    order the greatest counts."""
    held = F.struct(*(F.col(c).alias(c) for c in values))
    ranked = right.groupBy(*key, order).agg(F.max(held).alias("_held"))
    tie = 1 if strict else -1  # right rows stand after, or before, left ones of the same order
    two = ranked.select(*key, F.col(order), "_held", F.lit(0).alias("_left"))
    rows = left.withColumn("_left", F.lit(tie)).withColumn("_held", F.lit(None).cast(two.schema["_held"].dataType))
    both = segmented(rows.unionByName(two, allowMissingColumns=True), order, width)
    joined = _carried(both, key, {"_t": F.max_by("_held", F.when(F.col("_held").isNotNull(), F.col(order)))}, lambda w: {"_c": F.last("_t", ignorenulls=True).over(w)})
    w = Window.partitionBy(*key, _SEGMENT).orderBy(F.asc(order), F.desc("_left") if not strict else F.asc(F.col("_left") == 0)).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_held", ignorenulls=True).over(w), F.col("_c"))
    return joined.withColumn("_found", found).where(F.col("_left") != 0).select(*left.columns, *(F.col("_found")[c].alias(c) for c in values))


def leading_bits(value: Column, fraction: int = 8) -> Column:
    """A number that never decreases with a known value: its sign, exponent and the leading bits of its fraction.  It cuts
    every range of values at a constant relative width, whatever they are."""
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(F.when(size > 0, size)))
    place = (exponent + 1100) * (1 << fraction) + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << fraction)) + 1
    place = F.when((size == float("inf")) | F.isnan(size), 1 << 40).otherwise(F.coalesce(place, F.lit(0)))
    return F.when(value < 0, -place).otherwise(place).cast("long")


def _matching(group: list[str], other: str) -> Column:
    same = F.lit(True)
    for i, k in enumerate(group):
        same &= F.col(k).eqNullSafe(F.col(f"{other}{i}"))
    return same


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(g0, g1, ...: the group, value, equal: its rows with the value, below: those with a lesser one, known: those with any) of
    the known values of each group.  Rows meet as partial counts by value, so neither a group nor a value that very many
    rows share is one task; a group's values stand in segments, and a segment is told what those before it hold."""
    keys = [f"g{i}" for i in range(len(group))]
    counted = df.where(F.col(value).isNotNull()).groupBy(*(F.col(k).alias(g) for k, g in zip(group, keys, strict=True)), F.col(value).alias("value")).agg(F.count("*").alias("equal"))
    # a key of a scan is never null
    line = F.struct(F.lit(0).alias("z"), *(F.struct(F.col(k).isNull().alias("a"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("b")).alias(k) for k in keys))
    summed = running(counted.withColumn("_line", line), ["_line"], "value", sums={"_upto": F.col("equal")}, width=None)
    known = counted.groupBy(*(F.col(k).alias(f"t{i}") for i, k in enumerate(keys))).agg(F.sum("equal").alias("known"))
    return summed.join(known, _matching(keys, "t")).select(*keys, "value", "equal", (F.col("_upto") - F.col("equal")).alias("below"), "known")


def ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """df with below, equal and known: how many rows of its group have a lesser value, its own, and any; null without one."""
    counts = value_counts(df, group, value).withColumnRenamed("value", "_value")
    return df.join(counts, _matching(group, "g") & (F.col(value) == F.col("_value")), "left").drop("_value", *(f"g{i}" for i in range(len(group))))


def percentiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group, n, and by name the percentiles between 0 and 1 of the known values) by linear interpolation: of each one the
    values at the places before and after it are picked from the counted values, so no group's values meet."""
    counts = value_counts(df, group, value)
    found = {}
    for i, p in enumerate(at.values()):
        place = (F.col("known") - 1) * F.lit(float(p))
        for name, k in ((f"_lo{i}", F.floor(place)), (f"_hi{i}", F.ceil(place))):
            found[name] = F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("equal")), F.col("value").cast("double")))
        found[f"_of{i}"] = F.max(place - F.floor(place))
    rows = counts.groupBy(*(f"g{i}" for i in range(len(group)))).agg(F.max("known").alias("n"), *(c.alias(name) for name, c in found.items()))
    between = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_of{i}")).alias(name) for i, name in enumerate(at)]
    return rows.select(*(F.col(f"g{i}").alias(k) for i, k in enumerate(group)), "n", *between)


def prefix_counts(points: DataFrame, asked: DataFrame, key: str, value: str, until: str) -> DataFrame:
    """asked with below and equal: of the first `until` points of its key (numbered 0, 1, ... by _t) how many have a lesser
    value than it, and its own.  A prefix is a union of dyadic blocks, one for each bit of its length: a point is counted in
    the blocks it stands in that can be such a part, a question asks the blocks of its prefix, and all blocks are one
    distributed scan in order of value.  Work grows as n log n, and no task has a whole key."""
    last = points.agg(F.max("_t")).first()[0]
    levels = F.array(*(F.lit(x) for x in range(int(last or 0).bit_length() + 1)))
    block = lambda of: F.expr(f"shiftright({of}, _level)")
    stands = points.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), "_t", F.explode(levels).alias("_level"))
    stands = stands.where(block("_t") % 2 == 0).select("_k", "_level", block("_t").alias("_block"), "_v", F.lit(1).cast("long").alias("_w"))
    asks = asked.where((F.col(until) > 0) & F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(until).cast("long").alias("_u")).distinct().withColumn("_level", F.explode(levels))
    asks = asks.where(block("_u") % 2 == 1).withColumn("_block", block("_u") - 1)
    cell = ["_k", "_level", "_block", "_v"]
    cells = stands.unionByName(asks.select(*cell, F.lit(0).cast("long").alias("_w"))).groupBy(*cell).agg(F.sum("_w").alias("_w"))
    summed = running(cells, cell[:3], "_v", sums={"_upto": F.col("_w")}, width=None)
    found = asks.join(summed, cell).groupBy("_k", "_u", "_v").agg(F.sum(F.col("_upto") - F.col("_w")).alias("below"), F.sum("_w").alias("equal"))
    same = (F.col(key) == F.col("_k")) & (F.col(until) == F.col("_u")) & (F.col(value) == F.col("_v"))
    zero = lambda c: F.when(F.col(value).isNotNull(), F.coalesce(c, F.lit(0))).alias(c)
    return asked.join(found, same, "left").select(*asked.columns, zero("below"), zero("equal"))
