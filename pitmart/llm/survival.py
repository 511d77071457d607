"""Filter interaction audit by truth-table survival words.

Five filters fail a document or not.  Each document becomes a 32-bit word: bit S is set where the document survives the
subset S of the filters (filter k is bit 1 << k of S).  Carry-save adders fold the words of a part and label three by
three into bit planes of rising weight, so that 32 positional counts cost a few operations a word.  The summed counts
say of every subset how many documents survive it; the report of any filter order is differences of them.

Filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * letters A-Z > 10 * code points; D holds one of
SYMBOLS; E identical to the text of a smaller doc_id anywhere in the table, removed or not.

Defined results: a null text is empty, and all such are identical; a null lang is the part ''; a row with a null doc_id
has no smaller or larger id, so it never fails E, and has no label; each repeated row counts, rows that share a doc_id
are not smaller than each other; a document is good or toxic where any of its labels says so, null labels say nothing;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import materialize, table, tidy

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALL_BUT_CAPITALS, _ALL_BUT_SYMBOLS = (bytes(b for b in range(256) if b not in kept) for kept in (_CAPITALS, SYMBOLS))
#: The survival word of each set of failed filters.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32)
LABELS = ("all", "good", "toxic")


def failures(text: str) -> int:
    """Bits of the filters A to D that fail a text."""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at space and \t to \r alone
    n = len(words)
    return (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * len(raw.translate(None, _ALL_BUT_CAPITALS)) > MOST_CAPITALS * len(text)) << 2 | (len(raw.translate(None, _ALL_BUT_SYMBOLS)) > 0) << 3


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set, by carry-save addition: three planes of a weight become one of that
    weight and one of twice the weight, until two at most are left of each."""
    totals, planes, weight = np.zeros(SUBSETS, dtype=np.int64), words.astype(np.uint32), 1
    while len(planes):
        carried = []
        while len(planes) > 2:
            a, b, c = planes[: len(planes) // 3 * 3].reshape(3, -1)
            half = a ^ b
            carried.append(a & b | half & c)
            planes = np.concatenate((half ^ c, planes[len(planes) // 3 * 3 :]))
        for plane in planes:
            totals += weight * (plane >> np.arange(SUBSETS, dtype=np.uint32) & np.uint32(1)).astype(np.int64)
        planes, weight = np.concatenate(carried) if carried else planes[:0], 2 * weight
    return totals


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed): the filters that look at a document alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                texts = [t or "" for t in part.column(2).to_pylist()]
                digests = [hashlib.sha256(t.encode()).digest()[:16] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array([failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "failed"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, part string, digest binary, failed int")


def survivors(marked: DataFrame) -> DataFrame:
    """(part, label, subset, n) of documents (part, failed, good, toxic): how many survive each subset of the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            words = WORDS[batch.column(1).to_numpy()]
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
            of_label = [np.ones(len(code), dtype=bool), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
            rows = [[], [], [], []]
            for name, a, z in zip(names, cuts[:-1], cuts[1:], strict=True):
                for label, has in zip(LABELS, of_label, strict=True):
                    own = order[a:z]
                    counts = positional_counts(words[own[has[own]]])
                    for column, values in zip(rows, ([name] * SUBSETS, [label] * SUBSETS, range(SUBSETS), counts.tolist()), strict=True):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["part", "label", "subset", "n"])

    counted = marked.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, label string, subset int, n long")
    return counted.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def _steps() -> list[tuple[str, int, int, int, int]]:
    """(filter_order, step, subset before, subset after, the step's filter alone) of all orders."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            found.append(("".join(FILTERS[i] for i in order), step, before, before | 1 << k, 1 << k))
            before |= 1 << k
    return found


def report(counts: DataFrame) -> DataFrame:
    """The report of all orders from survivors()."""
    by_part = counts.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("label") == name, F.struct("subset", "n")))).alias(name) for name in LABELS))  # 32 entries each
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(k).alias("own")) for o, s, b, a, k in _steps()))
    rows = by_part.withColumn("_s", F.explode(steps)).select("part", *LABELS, "_s.*")
    at = lambda label, subset: F.element_at(label, subset)
    everything = F.lit(SUBSETS - 1)
    kept, removed = at("all", F.col("after")), at("all", F.col("before")) - at("all", F.col("after"))
    out = rows.select(
        "part", "filter_order", "step", "own", kept.alias("kept"), removed.alias("removed"),
        (at("all", F.lit(0)) - at("all", F.col("own")) - removed).alias("redundant"),
        (at("all", everything.bitwiseXOR(F.col("own"))) - at("all", everything)).alias("unique_fails"),
        *((at(label, F.col("before")) - at(label, F.col("after"))).alias(f"{label}_lost") for label in LABELS[1:]),
    )
    shapley = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley")).withColumnsRenamed({"part": "_part", "own": "_own"})
    return out.join(shapley, (F.col("part") == F.col("_part")) & (F.col("own") == F.col("_own"))).drop("_part", "_own", "own")


@tidy
def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    seen = materialize(judged(docs))
    # copies of a text meet as partial minima; texts that stand under several ids are a table of their own, to which Spark
    # can join the parts of a hot text in several tasks
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("digest").alias("_digest"), "least")
    first = materialize(first)
    copied = seen.join(first, F.col("digest") == F.col("_digest"), "left").select("doc_id", "part", (F.col("failed") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("failed"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(says("quality"), says("toxic"))
    marked = copied.where("doc_id is not null").join(named, F.col("doc_id") == F.col("_id"), "left").select("part", "failed", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    loose = copied.where("doc_id is null").select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return report(materialize(survivors(marked.unionByName(loose))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), fails AS (
  SELECT doc_id, part, len(ws) < 100 AS fa, 100 * len(list_distinct(ws)) < 80 * len(ws) AS fb,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS fe
  FROM docs
), lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), cells AS (
  SELECT part, list_value(fa, fb, fc, fd, fe) AS f, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE lab.toxic) AS n_toxic
  FROM fails LEFT JOIN lab USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT o, s.k AS step, o[s.k] AS own, list_slice(o, 1, s.k - 1) AS earlier,
    array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order
  FROM orders, letters s
), told AS (
  SELECT part, filter_order, step, own, n, n_good, n_toxic, f[own] AS failing,
    len([x FOR x IN earlier IF f[x]]) > 0 AS gone, len([x FOR x IN [1, 2, 3, 4, 5] IF f[x]]) AS n_failing
  FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing AND n_failing = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failing THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND failing THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
