"""Near-duplicates by banded MinHash, odd sketches and exact verification.

Documents with equal shingle sets are one node.  A node's MinHash samples give band keys and are folded into an odd
sketch: one parity bit for each hashed (position, sample).  The population count of the XOR of two sketches estimates
how many samples differ, precisely so when few do; candidates from the bands that are far off by it are dropped, all
others are verified on full shingle sets.  With 24 bands of 4 a pair at the threshold is missed with a probability of
about 2e-8.

Within a bucket nodes are first compared with the least node only.  The nodes of buckets that then still hold several
components are compared across components by an exact prefix join on their rarest shingles, so no bucket is expanded
into all its pairs and no link between components is lost.

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are in one component, rows that share a doc_id are one document, linked through
any of its texts; a null doc_id is linked with nothing, has a null component and is kept; an empty table gives no
rows; other columns are not read (drop_duplicates keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitmart.llm.common import materialize, table, tidy
from pitmart.llm.components import components
from pitmart.llm.shingles import mix, shingle_sets

ROWS, BANDS = 4, 24
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
WORDS = SKETCH_BITS // 64
PERCENT = 85
#: Pairs verified beside one copy of the text they share.
TOGETHER = 64

_RNG = np.random.Generator(np.random.PCG64(77))
_MULTIPLIERS = _RNG.integers(1, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SKETCH = [f"s{i}" for i in range(WORDS)]


def most_differing_bits(percent: int = PERCENT, deviations: float = 6.0) -> int:
    """XOR bits that a pair at the threshold exceeds with negligible probability: the mean over differing samples and
    parity folding, with so many standard deviations of both."""
    differ = SAMPLES * (1 - percent / 100)
    differ += deviations * math.sqrt(differ * percent / 100)
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
    return math.ceil(bits + deviations * math.sqrt(SKETCH_BITS / 4 * (1 - (1 - 2 / SKETCH_BITS) ** (4 * differ))) / 2)


def signature(shingles: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096, None] * _MULTIPLIERS).min(axis=0))
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k0, k1: identity of the shingle set, bands, s0..): a row for each document."""
    names = ["doc_id", "n", "k0", "k1", "bands", *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                sets = shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()])
                sig = np.stack([signature(s) for s in sets])
                keyed = mix(sig.astype(np.uint64) ^ _SALTS)
                bands = keyed.reshape(len(sets), BANDS, ROWS)
                mixed = bands[..., 0].copy()
                for r in range(1, ROWS):
                    mixed = mix(mixed * np.uint64(3) + bands[..., r])
                bits = np.zeros((len(sets), SKETCH_BITS), dtype=np.uint8)
                np.add.at(bits, (np.arange(len(sets))[:, None], (keyed % np.uint64(SKETCH_BITS)).astype(np.int64)), 1)
                sketch = np.packbits(bits & 1, axis=1, bitorder="little").view("<i8")
                k0 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                k1 = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS), pa.int32()), pa.array(mixed.view(np.int64).ravel()))
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k0), pa.array(k1), lists]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(WORDS))], names)

    schema = "doc_id long, n long, k0 long, k1 long, bands array<long>, " + ", ".join(f"{c} long" for c in _SKETCH)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _differing(a: str, b: str) -> Column:
    total = F.lit(0)
    for c in _SKETCH:
        total = total + F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
    return total


def _side(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in _SKETCH))


def _near(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) whose sketches are near enough to be verified."""
    both = pairs.join(_side(sketches, "a"), "a").join(_side(sketches, "b"), "b")
    return both.where(_differing("a_", "b_") <= most).select("a", "b").distinct()


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of which percent * |union| <= 100 * |intersection| holds on full shingle sets.  texts: node, text.
    Each text travels once to those of a pair's second side, which is copied for every TOGETHER first sides."""
    shares = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / TOGETHER))
    dealt = pairs.join(shares.select("b", "shares"), "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")))
    firsts = dealt.join(texts, F.col("a") == F.col("node")).select("b", "share", F.col("a"), "text")
    seconds = shares.join(texts, F.col("b") == F.col("node")).select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("a"), "text")
    together = seconds.unionByName(firsts).repartition("b", "share").sortWithinPartitions("b", "share", F.asc_nulls_first("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                rows = list(zip(*(part.column(i).to_pylist() for i in range(3)), shingle_sets([t.encode() for t in part.column(3).to_pylist()]), strict=True))
                found = []
                for b, share, a, own in rows:
                    if (b, share) != at:
                        at, held = (b, share), []
                    if a is None:
                        held.append(own)  # one, but for texts that share an id
                        continue
                    for other in held:
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * common >= percent * (len(own) + len(other) - common):
                            found.append((a, b))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def across_components(nodes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a > b, of nodes (node, c) of unlike components c that may be links: no link is left out.

    Shingles in order from the rarest on: a linked pair has a first common shingle among the first (100 - percent)
    percent of both, and as many shingles from there on as the link needs.  Copies with many edits of their own begin
    with more rare shingles than a link allows and so meet nobody, however large their group is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                sets = shingle_sets([t.encode() for t in part.column(2).to_pylist()])
                size = np.array([len(x) for x in sets])
                node, c = (np.repeat(part.column(i).to_numpy(), size) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(c), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "c", "size", "shingle"])

    rows = texts.withColumnRenamed("node", "_node").join(nodes, F.col("_node") == F.col("node")).select("node", "c", "text").mapInArrow(run, "node long, c long, size long, shingle long")
    rows = materialize(rows)
    often = rows.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1").select(F.col("shingle").alias("_shingle"), "often")
    ranked = rows.join(often, F.col("shingle") == F.col("_shingle"), "left").drop("_shingle").withColumn("often", F.coalesce("often", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")) - 1
    first = ranked.withColumn("place", place).where((F.col("often") > 1) & (100 * F.col("place") <= (100 - percent) * F.col("size"))).drop("often")
    first = materialize(first)
    sizes = nodes.groupBy("c").agg(F.count("*").alias("n"))
    # of two unlike components at least one is not the largest of the shingle
    largest = first.join(sizes, "c").groupBy("shingle").agg(F.max(F.struct("n", "c")).alias("top"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("shingle", F.col("top.c").alias("top"))
    sided = materialize(first.join(largest, "shingle"))
    left = sided.where("c <> top").select("shingle", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("size").alias("sa"), F.col("place").alias("pa"))
    right = sided.select("shingle", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("size").alias("sb"), F.col("place").alias("pb"), (F.col("c") == F.col("top")).alias("settled"))
    enough = (100 + percent) * F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= percent * (F.col("sa") + F.col("sb"))
    pairs = left.join(right, (left["shingle"] == right["shingle"]) & (F.col("ca") != F.col("cb")) & (F.col("settled") | (F.col("a") > F.col("b"))) & enough)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


@tidy
def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    most = most_differing_bits(percent)
    signed = materialize(signatures(docs))
    linked = signed.where("n > 0 and doc_id is not null")
    nodes = materialize(linked.groupBy("k0", "k1").agg(F.min("doc_id").alias("node")))
    sketches = linked.join(nodes.select(F.col("k0").alias("x0"), F.col("k1").alias("x1"), F.col("node")), (F.col("k0") == F.col("x0")) & (F.col("k1") == F.col("x1")) & (F.col("doc_id") == F.col("node")))
    sketches = sketches.dropDuplicates(["node", "k0", "k1"]).select("node", "bands", *_SKETCH)
    sketches = materialize(sketches)

    banded = sketches.select(F.explode("bands").alias("bucket"), "node")
    shared = materialize(banded.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")).where("least < most").select("bucket", "least", "size"))
    members = materialize(banded.join(shared, "bucket"))
    # of all pairs of a node with the least of one of its buckets
    stars = materialize(_near(members.where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), sketches, most))
    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    # texts of all nodes that may be verified: those of stars and of buckets that hold more than one pair
    held = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).unionByName(members.where("size > 2").select("node")).distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = materialize(plain.join(held, F.col("doc_id") == F.col("node")).select("node", "text"))
    links = materialize(verify(first, texts, percent))
    labels = components(links)

    def labelled(df: DataFrame, node: str, to: str) -> DataFrame:
        at = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return df.join(at, F.col(node) == F.col("_node"), "left").withColumn(to, F.coalesce("_component", node)).drop("_node", "_component")

    rest = labelled(labelled(stars.join(first, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    links = materialize(links.unionByName(verify(rest, texts, percent)))
    labels = components(links)

    # buckets of three and more that still hold several components: their nodes are compared across components
    of = labelled(labelled(members.where("size > 2"), "node", "c"), "least", "cl")
    mixed = materialize(of.where("c <> cl").select("bucket").distinct())
    open_nodes = materialize(of.join(mixed, "bucket", "left_semi").select("node", "c").distinct())
    if not open_nodes.isEmpty():
        across = materialize(across_components(open_nodes, texts, percent).join(stars, ["a", "b"], "left_anti"))
        links = materialize(links.unionByName(verify(across, texts, percent)))
        labels = components(links)

    named = nodes.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(F.col("k0").alias("x0"), F.col("k1").alias("x1"), F.coalesce("component", "node").alias("c"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "k0", "k1").join(named, (F.col("k0") == F.col("x0")) & (F.col("k1") == F.col("x1")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs, with all its columns as they are, for each component of near-duplicates: of rows under one doc_id
    that with the least text, a null text last, and of those the least by the hash of all columns."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("id", F.col("row")["doc_id"].cast("long"))
    # dealt by id at every size: what goes grows with the corpus and is never broadcast
    left = rows.join(gone.hint("merge"), F.col("id") == F.col("gone"), "left_anti")
    repeated = materialize(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("gone")).agg(F.count("*").alias("n")).where("n > 1").select("gone"))
    if repeated.isEmpty():
        return left.select("row.*")
    order = F.struct(F.col("row")["text"].isNull(), F.col("row")["text"], F.xxhash64(*(F.col("row")[c] for c in docs.columns)))
    least = left.join(repeated, F.col("id") == F.col("gone"), "left_semi").groupBy("id").agg(F.min_by("row", order).alias("row")).select("row")
    return left.join(repeated, F.col("id") == F.col("gone"), "left_anti").select("row").unionByName(least).select("row.*")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
