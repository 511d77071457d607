"""Repeated byte strings by bucket-pointer refinement.

A start is a position whose LENGTH bytes also stand anywhere else.  Of the starts of a text each points to one q-gram:
the least by hash among the q-grams inside its first WINDOW bytes.  Equal strings point to equal q-grams at equal
offsets, so the buckets of pointed-at q-grams, a small part of all positions, hold every repeat.  Equal texts are one
text with a count from here on, and only buckets with two pointers go on.  A pointer stands for a run of starts, and is
refined on the identifiers of strings at further offsets: if the string that covers the whole run stands elsewhere, all
of the run is repeated; if the bytes behind the q-gram that all of its starts share stand nowhere else, none is.  What
neither settles is cut into runs of STEP starts, refined by the same two tests, and then into single starts.  Each level
reads only what the one before left open, and settled pointers of equal strings take part with one of them.
Identifiers are 128 bits of content hashes: bucket and refinement.

Shorter passages are reported, not removed: `n_anchors` counts the pointers of a text whose BEHIND bytes from the q-gram
on, or whose bytes from BEFORE before it to its end, stand elsewhere too.  A string of WINDOW bytes that stands elsewhere
has at least one such pointer; a string shorter than both neighbourhoods never has.

Defined results: a null text is empty; texts under LENGTH bytes keep everything; repeated rows, even under one doc_id,
repeat each other; strings never reach over the end of a text; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import discard, materialize, table, text_or_empty, tidy
from pitmart.llm.shingles import content_sums, mix

LENGTH = 400
WINDOW = 300
Q = 64
STEP = 16


class _Text:
    """Content hashes of any strings of one text."""

    def __init__(self, raw: bytes) -> None:
        self.n = len(raw)
        self.sums, self.inverse = content_sums(np.frombuffer(raw, dtype=np.uint8))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of the width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def pointers(raw: bytes, length: int, window: int, q: int) -> tuple[np.ndarray, ...]:
    """(pos, lo, hi, core, outer, behind, before, sided): each q-gram pointed at by the starts pos - hi to pos - lo, none
    where lo > hi; its hash; the hash of the string that covers all of the starts' strings; those of its two
    neighbourhoods; and whether the text has (1) all bytes behind, (2) all before."""
    if len(raw) < window:
        return tuple(np.zeros(0, dtype=k) for k in (np.int64,) * 3 + (np.uint64,) * 4 + (np.int64,))
    text = _Text(raw)
    at = np.arange(text.n - q + 1)
    grams = text.hash(at, at + q)
    bits = np.uint64(int(len(grams)).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = (grams >> bits << bits) | (mask - at.astype(np.uint64))  # of equal q-grams the last
    to = (mask - (_least(keys, window - q + 1) & mask)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    last = np.minimum(np.concatenate((first[1:], [len(to)])) - 1, text.n - length)
    pos = to[first]
    lo, hi = np.where(last >= first, pos - last, 1), np.where(last >= first, pos - first, 0)
    outer = mix(text.hash(pos - hi, np.minimum(pos - lo + length, text.n)) ^ mix((lo * 4096 + hi).astype(np.uint64)))
    wide, ahead = length - (window - q), window - (length - (window - q))
    behind = text.hash(pos, np.minimum(pos + wide, text.n))
    before = text.hash(np.maximum(pos - ahead, 0), pos + q)
    return pos, lo, hi, grams[pos], outer, behind, before, (pos + wide <= text.n) + 2 * (pos >= ahead)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def described(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, q: int = Q) -> DataFrame:
    """(doc_id, tkey: SHA-256, n_bytes, cores: distinct hashes of the q-grams pointed at, twice: those pointed at from
    two places) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                found = [np.unique(pointers(t, length, window, q)[3], return_counts=True) for t in texts]
                lists = []
                for kept in ([c for c, _ in found], [c[n > 1] for c, n in found]):
                    ends = np.concatenate(([0], np.cumsum([len(c) for c in kept])))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(kept))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), *lists], ["doc_id", "tkey", "n_bytes", "cores", "twice"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tkey binary, n_bytes long, cores array<bigint>, twice array<bigint>")


def _refined(texts: DataFrame, length: int, window: int, q: int) -> DataFrame:
    """texts (tkey, text, copies, cores: those in buckets) -> a row for each distinct pointer of a text into a bucket, with
    its identifiers; several: whether its covering string stands twice in the text; spans: its starts then."""
    names = ["tkey", "pos", "lo", "hi", "core", "outer", "behind", "before", "several", "spans"]
    span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = pointers(row["text"].encode(), length, window, q)
                wanted = np.isin(found[3], np.array(row["cores"], dtype=np.int64).view(np.uint64))
                pos, lo, hi, core, outer, behind, before, sided = (x[wanted] for x in found)
                _, one, group, n = np.unique(np.where(lo > hi, mix(core + pos.astype(np.uint64)), mix(core) ^ outer), return_index=True, return_inverse=True, return_counts=True)
                spans: list[list[dict]] = [[] for _ in one]
                if row["copies"] == 1:
                    for g, a, z in zip(*(x[n[group] > 1].tolist() for x in (group, pos - hi, pos - lo)), strict=True):
                        spans[g].append({"lo": a, "hi": z})
                columns = [pa.array(x[one]) for x in (pos, lo, hi)] + [_signed(x[one]) for x in (core, outer)]
                columns += [pa.array(np.ascontiguousarray(x[one]).view(np.int64), pa.int64(), mask=sided[one] & bit == 0) for x, bit in ((behind, 1), (before, 2))]
                yield pa.RecordBatch.from_arrays([pa.array([row["tkey"]] * len(one), pa.binary()), *columns, pa.array((n > 1) & (lo <= hi)[one]), pa.array(spans, pa.list_(span))], names)

    return texts.mapInArrow(run, "tkey binary, " + ", ".join(f"{c} long" for c in names[1:8]) + ", several boolean, spans array<struct<lo:bigint,hi:bigint>>")


def _hash_runs(texts: DataFrame, length: int) -> DataFrame:
    """texts (tkey, text, at: open pointers) -> a row for each run of STEP starts, with the identifier of what its starts
    share and of what covers those of them that the pointer stands for."""
    names = ["tkey", "pos", "k", "lo", "hi", "core", "shared", "cover"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                text = _Text(row["text"].encode())
                parts = []
                for p in row["at"]:
                    k = np.arange(p["lo"] // STEP, p["hi"] // STEP + 1)
                    parts.append(np.stack([np.full(len(k), p["pos"]), k, np.maximum(k * STEP, p["lo"]), np.minimum(k * STEP + STEP - 1, p["hi"]), np.full(len(k), p["core"])]))
                pos, k, lo, hi, core = np.concatenate(parts, axis=1)
                shared = mix(text.hash(pos - k * STEP, pos - k * STEP - STEP + 1 + length) ^ mix(k.astype(np.uint64)))
                cover = mix(text.hash(pos - hi, pos - lo + length) ^ mix((lo * 4096 + hi).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array([row["tkey"]] * len(pos), pa.binary()), pa.array(pos), pa.array(k), pa.array(lo), pa.array(hi), pa.array(core), _signed(shared), _signed(cover)], names)

    return texts.mapInArrow(run, "tkey binary, " + ", ".join(f"{c} long" for c in names[1:]))


def _hash_starts(texts: DataFrame, length: int) -> DataFrame:
    """texts (tkey, text, at: open runs) -> a row for each single start."""
    names = ["tkey", "start", "core", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                text = _Text(row["text"].encode())
                d = [np.arange(r["lo"], r["hi"] + 1) for r in row["at"]]
                sizes = [len(x) for x in d]
                d = np.concatenate(d)
                pos, core = (np.repeat([r[c] for r in row["at"]], sizes) for c in ("pos", "core"))
                own = mix(text.hash(pos - d, pos - d + length) ^ mix(d.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array([row["tkey"]] * len(d), pa.binary()), pa.array(pos - d), pa.array(core), _signed(own)], names)

    return texts.mapInArrow(run, "tkey binary, start long, core long, own long")


def _cut(texts: DataFrame, length: int, with_text: bool) -> DataFrame:
    """texts (tkey, text, spans of starts) -> what is left of each."""
    names = ["tkey", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                rows = []
                for r in whole.slice(k, 256).to_pylist():
                    raw, kept, at, end, runs = r["text"].encode(), [], 0, -1, 0
                    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in r["spans"]):
                        if lo > end:
                            runs += 1
                            kept.append(raw[at:lo])
                        end = max(end, hi)
                        at = end
                    left = b"".join([*kept, raw[at:]])
                    rows.append((r["tkey"], len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), left if with_text else None))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts.mapInArrow(run, "tkey binary, n_removed long, n_spans long, kept_sha256 string, kept_text binary")


def _shared(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    """rows whose `by` columns, none of them null, agree with another row's."""
    twice = rows.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(c).alias(f"_{c}") for c in by))
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    return rows.join(twice, on, "left").withColumn(flag, F.col(f"_{by[0]}").isNotNull()).drop(*(f"_{c}" for c in by))


@tidy
def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, q: int = Q, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_anchors, kept_text: null where nothing is removed) for each
    row; q < window <= length."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    whole = materialize(described(plain, length, window, q))

    # equal texts are one; level 0: buckets of q-grams that are pointed at twice
    distinct = materialize(whole.groupBy("tkey").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.any_value("cores").alias("cores"), F.any_value("twice").alias("twice")))
    every = distinct.select("tkey", "copies", "first", F.explode("cores").alias("core"))
    again = every.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1").select("core").unionByName(distinct.select(F.explode("twice").alias("core"))).distinct()
    touched = every.join(again, "core").groupBy("tkey").agg(F.collect_list("core").alias("cores"), F.first("copies").alias("copies"), F.first("first").alias("first"))
    named = touched.withColumnsRenamed({"tkey": "_tkey", "first": "_first"})
    keyed = plain.withColumn("tkey", F.unhex(F.sha2("text", 256)))
    texts = materialize(keyed.join(named, (F.col("tkey") == F.col("_tkey")) & F.col("doc_id").eqNullSafe(F.col("_first"))).select("tkey", "text", "copies", "cores").dropDuplicates(["tkey"]))

    # runs whose covering string is repeated
    rows = materialize(_refined(texts, length, window, q).join(texts.select("tkey", (F.col("copies") > 1).alias("copied")), "tkey"))
    spoken = _shared(_shared(_shared(rows, ["core", "outer"], "covered"), ["core", "behind"], "followed"), ["core", "before"], "led")
    pointed = materialize(spoken.withColumn("full", (F.col("covered") | F.col("several") | F.col("copied")) & (F.col("lo") <= F.col("hi"))))
    opened = pointed.where("lo <= hi and not full and followed").select("tkey", "pos", "lo", "hi", "core", "behind")
    sought = opened.select("core", "behind").distinct()
    settled = pointed.where("full").groupBy("core", "outer").agg(F.min(F.struct("tkey", "pos", "lo", "hi", "behind")).alias("p")).select("core", "p.*")
    speakers = settled.join(sought, ["core", "behind"], "left_semi").select(opened.columns)
    at = opened.unionByName(speakers).groupBy("tkey").agg(F.collect_set(F.struct("pos", "lo", "hi", "core")).alias("at"))
    # level 1: runs of STEP starts
    hashed = materialize(_hash_runs(texts.select("tkey", "text").join(at, "tkey"), length))
    runs = materialize(_shared(hashed, ["core", "cover"], "full"))
    discard(hashed)
    unsettled = runs.groupBy("core", "shared").agg(F.count("*").alias("_n"), F.count_if(~F.col("full")).alias("_open")).where("_n > 1 and _open > 0").select("core", "shared")
    left = runs.join(unsettled, ["core", "shared"], "left_semi").groupBy("tkey").agg(F.collect_set(F.struct("pos", "lo", "hi", "core")).alias("at"))
    # level 2: single starts
    singles = materialize(_hash_starts(texts.select("tkey", "text").join(left, "tkey"), length))
    starts = _shared(singles, ["core", "own"], "full").where("full")

    found = [
        pointed.where("full and not copied and not several").select("tkey", (F.col("pos") - F.col("hi")).alias("lo"), (F.col("pos") - F.col("lo")).alias("hi")),
        pointed.where("several and not copied").select("tkey", F.inline("spans")),
        runs.where("full").select("tkey", (F.col("pos") - F.col("hi")).alias("lo"), (F.col("pos") - F.col("lo")).alias("hi")),
        starts.select("tkey", F.col("start").alias("lo"), F.col("start").alias("hi")),
    ]
    spans = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).groupBy("tkey").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = _cut(texts.where("copies = 1").select("tkey", "text").join(spans, "tkey"), length, with_text)
    anchors = pointed.groupBy("tkey").agg(F.count_if(F.col("full") | F.col("followed") | F.col("led")).alias("_anchors"))
    made = distinct.select("tkey", "copies", F.size("cores").cast("long").alias("_cores")).join(cut, "tkey", "left").join(anchors, "tkey", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = whole.select("doc_id", "tkey", "n_bytes").join(made, "tkey")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("tkey")))).alias("kept_sha256"),
        F.when(F.col("copies") > 1, F.col("_cores")).otherwise(F.coalesce("_anchors", F.lit(0))).cast("long").alias("n_anchors"),
        *([F.when(gone, F.lit("").cast("binary")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
