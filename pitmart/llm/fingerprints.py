"""Quartile bucket digests: counts of hashed byte triplets, coded by quartile, with the length.

The triplets of a text's UTF-8 bytes are hashed to 256 buckets.  Each bucket is coded 0 to 3 by the quartile of the
text's bucket counts that it falls in, and the digest carries the length on a logarithmic scale.  Two digests are
compared by a bounded score: buckets that differ by 1, 2, 3 quartiles cost 1, 2, 6, unlike lengths cost 12 for each
step of the scale; from `FAR` on the likeness is 0.

Defined results: a null text is empty; an empty text (or one under three bytes) has all-zero buckets; equal texts have
equal digests; two empty texts are alike (1.0); documents are in order of doc_id, nulls first, equal ids in the order
of their text; a table of one document is its own next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import materialize, table, text_or_empty, tidy

BUCKETS = 256
#: Score from which two digests have nothing in common.
FAR = 320.0
LENGTH_COST = 12
_COST = np.array([0, 1, 2, 6], dtype=np.int64)
_BYTES_AT_ONCE = 4 << 20


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes (texts x 256) and length codes."""
    codes = np.zeros((len(texts), BUCKETS), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    lengths = np.round(8 * np.log2(sizes + 1)).astype(np.int64).clip(0, 255)
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + sizes[to] <= _BYTES_AT_ONCE):
            total += sizes[to]
            to += 1
        own = sizes[at:to]
        b = np.frombuffer(b"".join(texts[at:to]), dtype=np.uint8).astype(np.uint32)
        if len(b) >= 3:
            h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h >>= np.uint32(24)
            of = np.repeat(np.arange(to - at, dtype=np.int64), own)
            inside = of[:-2] == of[2:]
            counts = np.bincount((of[:-2] * BUCKETS + h)[inside], minlength=(to - at) * BUCKETS).reshape(-1, BUCKETS)
            ordered = np.sort(counts, axis=1)
            for q in (BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4):
                codes[at:to] += counts > ordered[:, q - 1 : q]
        at = to
    return codes, lengths


def encode(codes: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Length code as two hex digits, then the quartiles, two bits each."""
    c = codes.reshape(len(codes), -1, 4)
    packed = (c[..., 0] << 6 | c[..., 1] << 4 | c[..., 2] << 2 | c[..., 3]).astype(np.uint8)
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(lengths, packed, strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    steps = np.abs(a[0].astype(np.int8) - b[0].astype(np.int8))
    score = _COST[steps].sum(axis=1) + LENGTH_COST * np.minimum(np.abs(a[1] - b[1]), 8)
    return 1 - np.minimum(score, FAR) / FAR


_KINDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(ids: list, texts: list[str], following: list[str]) -> list[list]:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    raw = [t.encode() for t in edited]
    own, new, after = digests([t.encode() for t in texts]), digests(raw), digests([t.encode() for t in following])
    return [ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in raw], encode(*own), encode(*new), likeness(own, new).tolist(), likeness(own, after).tolist()]


@tidy
def neighbours(docs: DataFrame) -> DataFrame:
    """Digests of each text and of its edited text, compared with each other and the next document's.

    Texts are shuffled once, by range of doc_id.  A partition gives the rows of all its documents but the last; the
    first and the last document of each partition, two rows a partition, are matched in a second, small job.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    names = [n for n, _ in _KINDS] + ["first_text", "last_text"]
    kinds = [k for _, k in _KINDS] + [pa.string()] * 2

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                if held is None:
                    first = texts[0]
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    rows = _with_next(ids[:-1], texts[:-1], texts[1:])
                    yield batch([*rows, *[[None] * (len(ids) - 1)] * 2])
        if held is not None:
            yield batch([[held[0]], *[[None]] * 6, [first], [held[1]]])

    partly = materialize(ordered.mapInArrow(within, f"{_SCHEMA}, first_text string, last_text string"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [r for b in batches for r in b.to_pylist()]
        for r, after in zip(edges, [*edges[1:], *edges[:1]], strict=True):
            rows = _with_next([r["doc_id"]], [r["last_text"]], [after["first_text"]])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(rows, _KINDS, strict=True)], [n for n, _ in _KINDS])

    # one row for each partition, whatever their size: every task of the scan hands its own to the one that compares them
    edges = partly.where("last_text is not null").select("doc_id", "first_text", "last_text").repartition(1).sortWithinPartitions(F.asc_nulls_first("doc_id"), "first_text").mapInArrow(across, _SCHEMA)
    return partly.where("last_text is null").drop("first_text", "last_text").unionByName(edges)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
