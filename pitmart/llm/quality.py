"""Quality rules by hashed n-gram log-likelihood ratio, in DataFrame functions only.

Single words and word pairs are hashed to BUCKETS buckets.  One multinomial over the buckets is estimated from trusted
target documents (all labels with quality 1, joined by id and never broadcast), one from all documents.
The target estimate is shrunk to the raw one by PRIOR counts.  A document's score is the sum of log ratios over its
n-grams divided by their number; documents that pass the fixed rules are kept if their score reaches the threshold:
the lowest score of the trusted documents themselves but for the share SPARE, less MARGIN.  Scores and rules are made
of one array of word hashes a text.

Defined results: a null or empty text has no words, fails the rules and scores 0; without trusted documents the rules
alone decide; repeated rows are judged alike; an empty table gives no rows; other columns are not read, and `keep` gives
them back whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import WORD, discard, materialize, table, text_or_empty, tidy
from pitmart.operators import scan

BUCKETS = 1 << 14
PRIOR = 1_000.0
SPARE = 0.002
MARGIN = 0.05
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words


@dataclass(frozen=True)
class Model:
    ratios: tuple[float, ...]
    threshold: float


def word_hashes(text: str | Column = "text") -> Column:
    """The hash of each word, from which all else is made but the lengths."""
    return F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _hashed(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs, text, h: hashes of its words, n), so that no column of docs can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_or_empty("text").alias("text")).withColumn("h", word_hashes("text")).withColumn("n", F.size("h"))


def _pairs(n: Column) -> Column:
    return F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))


def _single(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _double(h: Column, i: Column) -> Column:
    return F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(BUCKETS)).cast("int")


def ngram_buckets(h: Column, n: Column) -> Column:
    """Buckets of all words and word pairs."""
    return F.concat(F.transform(h, _single), F.transform(_pairs(n), lambda i: _double(h, i)))


def _with_repeated_words(hashed: DataFrame) -> DataFrame:
    """hashed with n_repeat_words: words in 3-word windows found twice, by the hashes of windows and, where some repeat,
    the positions of those in order."""
    h, windows, placed = F.col("h"), F.col("windows"), F.col("placed")
    out = hashed.withColumn("windows", F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    order = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(F.size(F.array_distinct(windows)) < F.size(windows), order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.coalesce(F.get(placed, j)["h"] == x["h"], F.lit(False))
    out = out.withColumn("repeated", F.array_sort(F.transform(F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate("repeated", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", covered).drop("windows", "placed", "repeated")


def measured(docs: DataFrame) -> DataFrame:
    """_hashed(docs) with the counts of the fixed rules."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    out = _with_repeated_words(_hashed(docs)).withColumn("lines", lines)
    return out.withColumns({
        "word_chars": F.length(F.translate("text", "\x20\x09\x0A\x0B\x0C\x0D", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }).drop("lines")


def ratio_score(ratios: tuple[float, ...], h: Column, n: Column) -> Column:
    """Mean log ratio over the n-grams.  The table is a constant of BUCKETS numbers."""
    constant = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")
    single = F.aggregate(h, F.lit(0.0), lambda s, x: s + F.get(constant, _single(x)))
    double = F.aggregate(_pairs(n), F.lit(0.0), lambda s, i: s + F.get(constant, _double(h, i)))
    return F.when(n > 0, (single + double) / (2 * n - 1)).otherwise(0.0)


def _trusted(labels: DataFrame) -> DataFrame:
    """Ids of the target documents, each once, for a join by id: at every size they are dealt out, never broadcast."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_target")).distinct().hint("shuffle_hash")


def estimate(docs: DataFrame, labels: DataFrame) -> tuple[float, ...] | None:
    """Log ratios of the buckets: raw counts come from every document, target counts from every trusted one."""
    plain = docs.select("doc_id", "text").join(_trusted(labels), F.col("doc_id") == F.col("_target"), "left")
    flagged = plain.withColumn("h", word_hashes("text")).withColumn("n", F.size("h"))
    grams = flagged.select(F.col("_target").isNotNull().cast("long").alias("t"), F.explode(ngram_buckets(F.col("h"), F.col("n"))).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # at most BUCKETS rows
    raw, wanted = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    if not wanted:
        return None
    ratios = [0.0] * BUCKETS
    for r in rows:
        p = r["raw"] / raw
        ratios[r["bucket"]] = math.log((r["target"] + PRIOR * p) / (wanted + PRIOR) / p)
    return tuple(ratios)


def threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The least score to keep, from (doc_id, n_words, score) of all documents: the exact quantile over every trusted one
    that has enough words, by counted values, so that their scores never meet in one task."""
    own = scores.where(F.col("n_words") >= LEAST_WORDS).join(_trusted(labels), F.col("doc_id") == F.col("_target")).select("score")
    own = materialize(own)  # a scan reads its input twice
    least = scan.percentiles(own, [], "score", {"least": SPARE}).first()["least"]
    discard(own)
    return (least if least is not None else 0.0) - MARGIN


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all documents and labels."""
    if (ratios := estimate(docs, labels)) is None:
        return None
    hashed = docs.select("doc_id", "text").withColumn("h", word_hashes("text")).withColumn("n", F.size("h"))
    scores = materialize(hashed.select("doc_id", F.col("n").alias("n_words"), ratio_score(ratios, F.col("h"), F.col("n")).alias("score")))
    model = Model(ratios, threshold(scores, labels))
    discard(scores)
    return model


def _scored(docs: DataFrame, ratios: tuple[float, ...] | None) -> DataFrame:
    """(row, n_words, the rules' counts, base_failed, score)."""
    n_words = F.col("n").cast("long")
    failed = (n_words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n_words)
    out = measured(docs).withColumn("score", ratio_score(ratios, F.col("h"), F.col("n")) if ratios else F.lit(0.0))
    return out.select("row", n_words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score")


def _passed(least: float) -> Column:
    return ~F.col("base_failed") & (F.col("score") >= F.lit(least))


def _judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, n_words, the rules' counts, base_failed, score, kept)."""
    out = _scored(docs, model.ratios if model else None)
    return out.withColumn("kept", _passed(model.threshold) if model else ~F.col("base_failed"))


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with n_words, the rules' counts, base_failed, score and kept, which replace columns of these names."""
    out = _judged(docs, model)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in out.columns), *out.columns[1:])


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are kept, with all of their columns as they are.  A row number in the filter holds it above
    the projection: pushed below, the verdict would be computed anew for each of its parts."""
    judged = _judged(docs, model).withColumn("number", F.monotonically_increasing_id())
    return judged.where("kept and number >= 0").select("row.*")


def keep_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """keep(docs, fit(docs, labels)), each text scored once: the rows are written with their scores."""
    if (ratios := estimate(docs, labels)) is None:
        return keep(docs, None)
    scored = materialize(_scored(docs, ratios).select("row", "n_words", "base_failed", "score"))
    least = threshold(scored.select("row.doc_id", "n_words", "score"), labels)
    return scored.where(_passed(least)).select("row.*")


@tidy
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge(docs, fit(docs, labels)) without the texts, each scored once: the threshold comes from the written scores."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    if (ratios := estimate(docs, labels)) is None:
        return judge(docs, None).drop("text")
    scored = materialize(_scored(docs, ratios).select("row.doc_id", "*").drop("row"))
    return scored.withColumn("kept", _passed(threshold(scored, labels)))
