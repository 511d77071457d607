"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / source_size times.  The whole part of that is taken as it is; the
fractional parts are rounded in pairs: mass in words moves from one document to the other until one of the two
copy counts is whole, which keeps the words of the pair as they were.  Blocks of bounded expected size are rounded
side by side, each leaves at most one fractional document, and these residuals meet in the blocks of the next level
of a reduction tree until one per source is left, which is rounded to the nearer count.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
are taken 0 words; rows that agree in doc_id, source and size are rounded as one unit and so get the same count; an
empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitmart.llm.common import materialize, n_words, table, tidy, uniform

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Expected fractional documents of one block.
BLOCK = 128


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): weights by code-point order of the source, targets capped at most times
    the source, the excess reshared by weight.  The fixed point of resharing is min(cap, weight * level): with sources
    in order of cap / weight, the level is the first at which the next source stays below its cap."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - before) / left
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("level", level)
        .withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(every))
        .select("source", "source_size", "n_docs", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))
    )


def _struct(x: Column, p: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["mass"].alias("mass"), p.cast("double").alias("p"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Rounds an array of (doc_id, size, mass, p) in order: (rest: the fractional unit left or null, done: the others)."""
    kind = "struct<doc_id:bigint,size:bigint,mass:double,p:double>"
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        c = state["rest"]
        ratio = x["mass"] / c["mass"]
        up = F.least(1 - c["p"], x["p"] * ratio)  # c may gain so much, x pays
        down = F.least(c["p"], (1 - x["p"]) * ratio)  # c may lose so much, x gains
        rises = uniform(c["doc_id"], x["doc_id"], c["size"], x["size"], F.lit(level), F.lit(seed)) * (up + down) < down
        c_full, x_empty = 1 - c["p"] <= x["p"] * ratio, 1 - c["p"] >= x["p"] * ratio
        c_empty, x_full = c["p"] <= (1 - x["p"]) * ratio, c["p"] >= (1 - x["p"]) * ratio
        keep = lambda rest, done: F.struct(rest.alias("rest"), F.concat(state["done"], done).alias("done"))
        none = F.lit(None).cast(kind)
        both = lambda a, b: keep(none, F.array(_struct(c, F.lit(a)), _struct(x, F.lit(b))))
        rise = (
            F.when(c_full & x_empty, both(1, 0))
            .when(c_full, keep(_struct(x, x["p"] - up / ratio), F.array(_struct(c, F.lit(1)))))
            .otherwise(keep(_struct(c, c["p"] + up), F.array(_struct(x, F.lit(0)))))
        )
        fall = (
            F.when(c_empty & x_full, both(0, 1))
            .when(c_empty, keep(_struct(x, x["p"] + down / ratio), F.array(_struct(c, F.lit(0)))))
            .otherwise(keep(_struct(c, c["p"] - down), F.array(_struct(x, F.lit(1)))))
        )
        return F.when(c.isNull(), keep(_struct(x, x["p"]), F.array().cast(f"array<{kind}>"))).when(rises, rise).otherwise(fall)

    return F.aggregate(units, start, step)


def pivotal_round(units: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """units (source, doc_id, size, mass, p in (0, 1), n: units of the source) -> (source, doc_id, size, p 0 or 1)."""
    most = units.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(2, most), block)))
    rounded, rest = [], units
    for level in range(levels):
        parts = F.ceil(F.col("n") / F.lit(float(block) ** (level + 1)))
        # the last level has one block for each source
        part = F.lit(0).cast("long") if level == levels - 1 else F.pmod(F.xxhash64("doc_id", "size", F.lit(level), F.lit(seed)), parts)
        unit = F.struct(F.xxhash64("doc_id", "size", F.lit(-1 - level), F.lit(seed)).alias("h"), "doc_id", "size", "mass", "p")
        folded = rest.groupBy("source", "n", part.alias("part")).agg(F.array_sort(F.collect_list(unit)).alias("units"))
        out = materialize(folded.select("source", "n", _fold(F.col("units"), level, seed).alias("r")).select("source", "n", "r.rest", "r.done"))
        rounded.append(out.select("source", F.explode("done").alias("u")).select("source", "u.doc_id", "u.size", "u.p"))
        rest = out.where("rest is not null").select("source", "n", "rest.doc_id", "rest.size", "rest.mass", "rest.p")
    rounded.append(rest.select("source", "doc_id", "size", F.round("p").alias("p")))
    whole = rounded[0]
    for more in rounded[1:]:
        whole = whole.unionByName(more)
    return whole


@tidy
def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs (doc_id, text, source)."""
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size")))
    targets = materialize(source_targets(sizes, weights, share, most)).withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sizes.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    units = (
        rated.where("p > 0 and size > 0")
        .groupBy("source", "doc_id", "size", "p", F.col("n_docs").alias("n"))
        .agg(F.count("*").alias("m"))
        .select("source", "n", "doc_id", "size", (F.col("size") * F.col("m")).cast("double").alias("mass"), "p")
    )
    extra = pivotal_round(units, seed).select(F.col("source").alias("r_source"), F.col("doc_id").alias("r_doc_id"), F.col("size").alias("r_size"), F.col("p").cast("long").alias("bit"))
    copies = F.col("whole") + F.coalesce("bit", F.lit(0))
    return (
        rated.join(extra, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("size") == F.col("r_size")) & F.col("source").eqNullSafe(F.col("r_source")), "left")
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
