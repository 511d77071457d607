"""Normalisation of raw vendor frames [B1-B25]: typed facts beside the rows that were refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exchange of a bare six-digit code by its leading digits, two-digit ones first.
SUFFIX_BY_TWO = {"92": "BJ", "90": "SH"}
SUFFIX_BY_ONE = {"5": "SH", "6": "SH", "0": "SZ", "1": "SZ", "2": "SZ", "3": "SZ", "4": "BJ", "8": "BJ"}
EXCHANGES = ("SH", "SZ", "BJ", "HK")
#: Words of an index name that tell nothing of the index.
DECORATIONS = ("收益率", "全收益", "净收益", "价格指数", "人民币", "美元", "港元")


def security_id(text: Column) -> Column:
    """[B1] ticker.SUFFIX of free text: with a suffix the ticker is padded to six digits, five for HK; without one the
    exchange follows from the length and the leading digits; anything else is null, never a guess."""
    t = F.upper(F.trim(text))
    ticker, suffix = F.split_part(t, F.lit("."), F.lit(1)), F.split_part(t, F.lit("."), F.lit(2))
    width = F.when(suffix == "HK", 5).otherwise(6)
    dotted = t.rlike(rf"^[0-9]+\.({'|'.join(EXCHANGES)})$") & (F.length(ticker) <= width)
    lead = F.lit(None).cast("string")
    for digit, exchange in SUFFIX_BY_ONE.items():
        lead = F.when(ticker.startswith(digit), exchange).otherwise(lead)
    for digits, exchange in SUFFIX_BY_TWO.items():
        lead = F.when(ticker.startswith(digits), exchange).otherwise(lead)
    return (
        F.when(dotted, F.concat(F.lpad(ticker, 6, "0").substr(F.lit(7) - width, width), F.lit("."), suffix))
        .when(t.rlike("^[0-9]{5}$"), F.concat(t, F.lit(".HK")))
        .when(t.rlike("^[0-9]{6}$") & lead.isNotNull(), F.concat(t, F.lit("."), lead))
    )


def premium(close: Column, indicative: Column) -> Column:
    """[B21] (close - indicative) / indicative, positive for a premium; null without a positive indicative value."""
    return F.when(indicative > 0, (close - indicative) / indicative)


def index_name(name: Column) -> Column:
    """[B22] Upper case without decorations, brackets, blanks and separators."""
    for word in DECORATIONS:
        name = F.replace(name, F.lit(word), F.lit(""))
    return F.upper(F.regexp_replace(name, r"[\s,，、;；/·（）()\[\]【】]+", ""))


def wide_to_long(df: DataFrame, key: str, pattern: str = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})-nav$") -> tuple[DataFrame, DataFrame]:
    """[B2, B3] Columns named <date>-<label> become rows; a null is skipped, a value of 0 or less or one that is no
    number is refused."""
    import re

    dated = [c for c in df.columns if re.match(pattern, c)]
    long = df.select(key, *(F.col(f"`{c}`").cast("string").alias(c) for c in dated)).unpivot([key], [f"`{c}`" for c in dated], "name", "raw").where("raw is not null")
    long = long.select(key, F.to_date(F.regexp_extract("name", pattern, 1)).alias("nav_date"), F.col("raw").try_cast("double").alias("unit_nav"))
    good = F.coalesce(F.col("unit_nav") > 0, F.lit(False))
    return long.where(good), long.where(~good).withColumn("rule", F.when(F.col("unit_nav").isNull(), "nav_not_a_number").otherwise("nav_not_positive"))


def key_value_pivot(df: DataFrame, key: str, item: str, value: str, items: dict[str, tuple[str, float]]) -> DataFrame:
    """[B8] One row for each key of rows (item, value): items maps a label to its column and unit factor."""
    return df.groupBy(key).agg(*(F.first(F.when(F.col(item) == label, F.col(value) * factor), ignorenulls=True).alias(name) for label, (name, factor) in items.items()))


def pick_preferred(df: DataFrame, key: str, preference: list[Column]) -> DataFrame:
    """[B7, B16] One row of each key, the first by preference."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*preference))).where("_rn = 1").drop("_rn")


def estimated_aum(shares: Column, nav: Column) -> tuple[Column, Column]:
    """[B24] Shares times NAV; estimated only if the NAV is known."""
    return shares * nav, nav.isNotNull()


def unique_containment(texts: DataFrame, catalog: DataFrame, key: str, text: str, name: str, least: int = 4) -> DataFrame:
    """[B23] The one catalog entry whose name a text contains: none or several give no match.  Names meet the text by
    its substrings of their lengths, so the catalog is joined by equality."""
    names = catalog.where(F.length(name) >= least).select(F.col(name).alias("_name"), F.col("index_id").alias("_id"), F.length(name).alias("_n"))
    lengths = [r[0] for r in names.select("_n").distinct().collect()]  # lengths of names: a few dozen at most
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def pieces_of(n: int) -> Column:
        return F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))

    parts = [pieces_of(n) for n in lengths]
    pieces = texts.select(key, F.explode(F.array_distinct(F.concat(*parts))).alias("_piece")) if parts else texts.select(key, F.lit(None).cast("string").alias("_piece"))
    hits = pieces.join(names, F.col("_piece") == F.col("_name"))
    return hits.groupBy(key).agg(F.countDistinct("_id").alias("_k"), F.max_by("_id", F.struct("_n", "_id")).alias("index_id")).where("_k = 1").select(key, "index_id")


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """[B17-B19] Text of the cells of an HTML fragment with their position."""
    cells = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return df.select(key, F.posexplode(cells).alias("cell", "raw")).select(key, "cell", F.trim(F.regexp_replace("raw", r"<[^>]*>", "")).alias("value"))


def split_ratio(text: Column) -> tuple[Column, Column]:
    """[B17] Factors of a ratio a:b - shares b / a, NAV a / b; null for anything else."""
    a, b = (F.regexp_extract(text, r"^\s*([0-9.]+)\s*[:：]\s*([0-9.]+)\s*$", i).try_cast("double") for i in (1, 2))
    return F.when((a > 0) & (b > 0), b / a), F.when((a > 0) & (b > 0), a / b)


def outer_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """[B20] List a, enriched by b field by field; keys of b alone are added."""
    other = b.withColumnsRenamed({c: f"_b_{c}" for c in b.columns if c != key})
    both = a.join(other, key, "full_outer")
    return both.select(key, *(F.coalesce(c, f"_b_{c}").alias(c) if f"_b_{c}" in other.columns else F.col(c) for c in a.columns if c != key))
