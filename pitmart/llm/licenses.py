"""License scans in DataFrame functions only.

Texts are cut into shingles of five words, A-Z lower-cased, and shingles into overlapping windows of each of SIZES
shingles, one every so many.  A window has band keys of one MinHash sample each: the least and the greatest of its hashes
in each of two hash orders (a window of one shingle, whose samples are all the shingle itself, has one).  A template
takes the largest windows of which a verbatim run of the template's length holds one at every offset, and has the keys
of all of them.  So every template is retrieved by its bands: a text that holds it verbatim for certain, a window that
agrees with a template's in the share J of its shingles with probability 1 - (1 - J)^BANDS; and one window out of all
will do.  Retrieved templates are verified by exact containment: of the template's shingles at least CONTAINED must stand
in the text.  The templates are a list that the caller has in hand and constants of the plan; a text is never shuffled.

Defined results: null, empty and short texts match nothing; templates of fewer than five words are refused; a template
matches a text once, however often it stands there; repeated rows match alike; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import LOWER, UPPER, WORD, table, text_or_empty
from pitmart.llm.license_texts import NOTICES, TEXTS

WIDTH = 5
#: Shingles in a window -> windows begin at every so manieth shingle.
SIZES = {1: 1, 4: 2, 8: 4}
BANDS = 4
CONTAINED = 0.8


def lowered_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _runs(words: Column, make) -> Column:  # noqa: ANN001
    n = F.size(words) - (WIDTH - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make))


def shingle_hashes(words: Column) -> Column:
    return F.coalesce(_runs(words, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH)))), F.array().cast("array<bigint>"))


def shingles(words: Column) -> Column:
    return F.coalesce(_runs(words, lambda i: F.array_join(F.slice(words, i + 1, F.lit(WIDTH)), " ")), F.array().cast("array<string>"))


def band_keys(size: int, stride: int) -> Column:
    """Keys of all windows of `size` hashes h, one every `stride`; h2: the hashes in a second order."""
    h, again, n = F.col("h"), F.col("h2"), F.size("h") - size
    if size == 1 == stride:
        return F.transform(h, lambda x: F.xxhash64(F.lit(size), x))

    def keys(i: Column) -> Column:
        one, two = F.slice(h, i + 1, F.lit(size)), F.slice(again, i + 1, F.lit(size))
        return F.array(*(F.xxhash64(F.lit(size * BANDS + b), x) for b, x in enumerate((F.array_min(one), F.array_max(one), F.array_min(two), F.array_max(two)))))

    return F.when(n >= 0, F.flatten(F.transform(F.sequence(F.lit(0), n, F.lit(stride)), keys))).otherwise(F.array().cast("array<bigint>"))


def _shingled(texts: DataFrame) -> DataFrame:
    """texts (.., text) with words, h and h2."""
    return texts.withColumn("words", lowered_words(text_or_empty("text"))).withColumn("h", shingle_hashes(F.col("words"))).withColumn("h2", F.transform("h", lambda x: F.xxhash64(x)))


def window_of(n_shingles: int) -> int:
    """The largest window of which a run of so many shingles holds one wherever the windows begin."""
    return max(size for size, stride in SIZES.items() if size + stride - 1 <= max(n_shingles, 1))


def _constant(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def retrieve(docs: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """(doc_id, template_id, s: the template's distinct shingles, own: the text's words) for each text and template of
    which a window has a common band key."""
    known = _shingled(docs.sparkSession.createDataFrame(sorted(templates.items()), "template_id string, text string"))
    known = known.select("template_id", F.array_distinct(shingles(F.col("words"))).alias("s"), F.size("h").alias("n"), *(F.array_distinct(band_keys(size, 1)).alias(f"k{size}") for size in SIZES)).collect()
    if short := [r["template_id"] for r in known if not r["s"]]:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    sizes = sorted({window_of(r["n"]) for r in known})
    chosen = [{"template_id": r["template_id"], "s": r["s"], "k": r[f"k{window_of(r['n'])}"]} for r in known]
    every = _constant(sorted({k for t in chosen for k in t["k"]}))
    table_of = F.from_json(F.lit(json.dumps(chosen)), "array<struct<template_id:string,s:array<string>,k:array<bigint>>>")
    found = _shingled(docs.select("doc_id", "text")).withColumn("keys", F.concat(*(F.array_intersect(band_keys(size, SIZES[size]), every) for size in sizes)))
    # a row number in the filter holds it above the projection, whose parts would be computed anew below it
    found = found.withColumn("number", F.monotonically_increasing_id()).where("size(keys) > 0 and number >= 0")
    hits = found.select("doc_id", "words", F.explode(F.filter(table_of, lambda t: F.arrays_overlap(t["k"], F.col("keys")))).alias("t"))
    return hits.select("doc_id", "t.template_id", "t.s", "words")


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, template_id, n_shingles, n_found, containment) for each text and template it holds."""
    found = retrieve(docs, NOTICES | TEXTS if templates is None else templates)
    both = F.size(F.array_intersect(shingles(F.col("words")), F.col("s"))).cast("long")
    out = found.select("doc_id", "template_id", F.size("s").cast("long").alias("n_shingles"), both.alias("n_found"))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= contained)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH templates(template_id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in (NOTICES | TEXTS).items())}),
w AS (
  SELECT 't' AS kind, template_id AS key, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM templates
  UNION ALL
  SELECT 'd', CAST(doc_id AS VARCHAR), regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') FROM documents),
s AS (SELECT DISTINCT kind, key, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS s
      FROM (SELECT kind, key, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
size AS (SELECT key AS template_id, count(*) AS n FROM s WHERE kind = 't' GROUP BY key)
SELECT CAST(d.key AS BIGINT) AS doc_id, t.key AS template_id, max(size.n) AS n_shingles, count(*) AS n_found, count(*) / max(size.n) AS containment
FROM s d JOIN s t ON d.s = t.s AND d.kind = 'd' AND t.kind = 't' JOIN size ON size.template_id = t.key
GROUP BY d.key, t.key HAVING count(*) >= {CONTAINED} * max(size.n)
"""
