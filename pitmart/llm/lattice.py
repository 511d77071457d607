"""Near-duplicate embeddings by E8 lattice hashing.

Equal vectors of a label are one node with a weight.  In each table a node's direction is projected to eight numbers by
a random orthonormal map and decoded to the nearest point of the lattice E8; the node stands in that cell and in the
PROBES - 1 neighbouring cells (of the 240 around it) that it is nearest to.  Two nodes meet where they share a cell of a
table.  At the threshold of 0.98 they share one in a table with probability 0.7, so TABLES = 12 miss such a pair with
about 5e-7; at a cosine of 0.5 they share one with 4e-4.

1. Every node is compared with the least node of each of its cells; cosines verified in double precision give links and
   components.
2. Cells that then still hold several components are compared whole, in pairs of blocks of BLOCK nodes; a block pair
   gives edges of a spanning forest of its links, never the pairs.
3. Links are counted within components, block by block, so that a link counts once however many cells it shares and also
   if it shares none.  Nodes stand in blocks by their angle to the component's pivot; by the triangle inequality block
   pairs that are surely linked add their weights and those that surely are not are left out, both without meeting.  A
   group whose pairs lie close to the threshold has to compare them: that work grows with its square, in tasks of one
   block pair.

Defined results: a vector that is null, zero, or holds null or non-finite numbers, or whose label is null, is linked with
nothing; vectors of unlike length are not compared; each row is a vector, also of rows that share a vec_id or repeat; a
vector with a null vec_id is one like others whose id is never the smallest, a component without any id is null and kept;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitmart.llm.common import materialize, table, tidy
from pitmart.llm.components import components
from pitmart.llm.shingles import mix

COSINE = 0.98
TABLES, PROBES = 12, 3
#: Size of a lattice cell against that of a random unit projection.
WIDTH = 0.8
BLOCK = 1024
#: Bins of the angle to a pivot.
BINS = 4096
_DIM = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.bincount([i, j], weights=s, minlength=_DIM) for i, j in itertools.combinations(range(_DIM), 2) for s in itertools.product((1, -1), repeat=2)]
    half = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=_DIM) if math.prod(s) > 0]
    return np.array(whole + half)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: the worst rounded coordinate goes the other way where the sum is odd."""
    y = np.rint(x)
    off = x - y
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(y.sum(axis=1) % 2 != 0)
    y[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return y


def nearest_points(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of the even integer points and those moved by a half, the nearer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.lru_cache(maxsize=64)
def _projections(dim: int) -> np.ndarray:
    """TABLES maps from `dim` numbers to eight, orthonormal where there are as many, scaled as a unit normal one is."""
    rng = np.random.Generator(np.random.PCG64(8_240 + dim))
    maps = rng.normal(size=(TABLES, max(dim, _DIM), _DIM))
    return np.stack([np.linalg.qr(m)[0][:dim] for m in maps]) * math.sqrt(dim) / WIDTH


def cells(units: np.ndarray) -> np.ndarray:
    """(vectors x TABLES x PROBES) names of lattice cells; doubled coordinates of a point, a byte each, are its name."""
    out = np.empty((len(units), TABLES, PROBES), dtype=np.int64)
    for t, projection in enumerate(_projections(units.shape[1])):
        x = units @ projection
        home = nearest_points(x)
        near = np.argpartition(-((x - home) @ ROOTS.T), PROBES - 1, axis=1)[:, : PROBES - 1]
        for p, point in enumerate([home, *(home + ROOTS[near[:, k]] for k in range(PROBES - 1))]):
            out[:, t, p] = mix(np.ascontiguousarray(np.rint(2 * point).astype(np.int8)).view(np.uint64).ravel() * np.uint64(TABLES) + np.uint64(t)).view(np.int64)
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column without nulls."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def _celled(nodes: DataFrame) -> DataFrame:
    """(node, cells) of nodes (node, kind, vector, norm); unlike kinds share no cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                vectors, kind, norm = _vectors(part.column(2)), part.column(1).to_numpy(), part.column(3).to_numpy()
                size = np.array([len(v) for v in vectors])
                named = np.empty((len(size), TABLES * PROBES), dtype=np.int64)
                for dim in np.unique(size):
                    own = np.flatnonzero(size == dim)
                    named[own] = cells(np.stack([vectors[i] for i in own]) / norm[own, None]).reshape(len(own), -1)
                named = mix(named.view(np.uint64) ^ mix(kind.view(np.uint64))[:, None]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, named.size + 1, TABLES * PROBES), pa.int32()), pa.array(named.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "cells"])

    return nodes.select("node", "kind", "vector", "norm").mapInArrow(run, "node long, cells array<long>")


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.col("kind").alias(f"kind_{name}"), F.col("vector").alias(f"vector_{name}"), F.col("norm").alias(f"norm_{name}"))


def _cosine() -> Column:
    dot = F.aggregate(F.zip_with("vector_a", "vector_b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)
    return dot / (F.col("norm_a") * F.col("norm_b"))


def verify(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of one kind whose cosine is `least` or more."""
    both = pairs.join(_side(nodes, "a").hint("merge"), "a").join(_side(nodes, "b").hint("merge"), "b").where("kind_a = kind_b")
    return both.where(_cosine() >= least).select("a", "b")


def _dealt(members: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, x, y, side, node, w, kind, vector, norm): the nodes of both blocks of each block pair (group, x, y) in one
    place.  members: (group, block, node)."""
    sides = pairs.select("group", "x", "y", F.lit(0).alias("side"), F.col("x").alias("block")).unionByName(pairs.where("x <> y").select("group", "x", "y", F.lit(1).alias("side"), F.col("y").alias("block")))
    rows = members.join(sides.hint("merge"), ["group", "block"]).select("group", "x", "y", "side", F.col("node").alias("_node"))
    return rows.join(nodes.hint("merge"), F.col("_node") == F.col("node")).select("group", "x", "y", "side", "node", "w", "kind", "vector", "norm").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "side", "node")


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(group, x, y) and, of all rows of that block pair, side, node, w, kind, units and norms."""
    at, held = None, []
    for batch in itertools.chain(batches, (None,)):
        keys = [] if batch is None else list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (batch is None or z > a and keys[a] != at):
                columns = list(zip(*held, strict=True))
                yield at, [np.concatenate(c) for c in columns[:4]] + [[v for c in columns[4] for v in c], np.concatenate(columns[5])]
                held = []
            if batch is not None and z > a:
                part = batch.slice(a, z - a)
                at = keys[a]
                held.append((*(part.column(i).to_numpy() for i in range(3, 7)), _vectors(part.column(7)), part.column(8).to_numpy()))


def _linked(side: np.ndarray, kind: np.ndarray, vectors: list[np.ndarray], norm: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of first rows to second rows, first rows, second rows) of a block pair, or of a block with itself."""
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1) if side.any() else first
    found = np.zeros((len(first), len(second)), dtype=bool)
    for k in np.unique(kind[first]):  # one length each
        a, b = np.flatnonzero(kind[first] == k), np.flatnonzero(kind[second] == k)
        if len(b):
            left, right = (np.stack([vectors[i] for i in rows]) for rows in (first[a], second[b]))
            found[np.ix_(a, b)] = left @ right.T / (norm[first[a], None] * norm[second[b]]) >= least
    if second is first:
        np.fill_diagonal(found, False)
    return found, first, second


def _forest(blocks: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that span the links within each block pair: each node with the least node of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, node, _, kind, vectors, norm) in _each_pair(batches):
            found, first, second = _linked(side, kind, vectors, norm, least)
            label, moved = node.copy(), True
            while moved:
                before = label.copy()
                for rows, others, links in ((first, second, found), (second, first, found.T)):
                    own = np.where(links, label[others][None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
                    label[rows] = np.minimum(label[rows], own)
                moved = (label != before).any()
            edges = np.flatnonzero(label != node)
            yield pa.RecordBatch.from_arrays([pa.array(node[edges]), pa.array(label[edges])], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _counts(blocks: DataFrame, least: float) -> DataFrame:
    """(node, n): weights of the nodes that a node is linked with, by block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, node, w, kind, vectors, norm) in _each_pair(batches):
            found, first, second = _linked(side, kind, vectors, norm, least)
            n = np.zeros(len(node), dtype=np.int64)
            n[first] += found @ w[second]
            if second is not first:
                n[second] += w[first] @ found
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], ["node", "n"])

    return blocks.mapInArrow(run, "node long, n long")


def _block_pairs(sizes: DataFrame) -> DataFrame:
    """All (group, x, y), x <= y, of groups (group, blocks)."""
    rows = sizes.select("group", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    return rows.select("group", "x", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1)).alias("y"))


def count_links(nodes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(node, n): the weights of all other nodes of its component that a node is linked with.  labels: (node, component)
    of all nodes with links but the least of each component."""
    theta, margin = math.acos(least), 1e-9
    placed = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    placed = placed.unionByName(placed.select(F.col("b").alias("a"), "b").distinct())
    both = placed.join(_side(nodes, "a").hint("merge"), "a").join(_side(nodes, "b").hint("merge"), "b")
    width = math.pi / BINS
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine())))
    binned = materialize(both.select(F.col("b").alias("group"), F.col("a").alias("node"), F.least(F.lit(BINS - 1), F.floor(angle / width)).cast("int").alias("bin")))
    # blocks of neighbouring bins; a bin above BLOCK is cut into blocks of its own by hash.  At most BINS rows a group
    bins = Window.partitionBy("group").orderBy("bin")
    counted = binned.groupBy("group", "bin").agg(F.count("*").alias("n"))
    from_0 = F.sum("n").over(bins.rowsBetween(Window.unboundedPreceding, -1))
    large = F.col("n") > BLOCK
    runs = counted.withColumn("before", F.coalesce(from_0, F.lit(0)))
    runs = runs.withColumn("run", F.when(large, -1).otherwise(F.floor(F.col("before") / BLOCK))).withColumn("cuts", F.when(large, F.ceil(2 * F.col("n") / BLOCK)).otherwise(1))
    opens = (large | (F.lag("run").over(bins) != F.col("run")) | F.lag("run").over(bins).isNull()).cast("int")
    runs = runs.withColumn("opens", opens).withColumn("block", F.coalesce(F.sum(F.col("opens") * F.col("cuts")).over(bins), F.lit(0)) - F.col("cuts"))
    runs = materialize(runs.select("group", "bin", F.col("block").cast("int").alias("block"), F.col("cuts").cast("int").alias("cuts")))
    member = binned.join(runs.hint("merge"), ["group", "bin"]).select("group", "bin", "node", (F.col("block") + F.pmod(F.xxhash64("node"), F.col("cuts"))).cast("int").alias("block"))
    members = materialize(member)
    blocks = members.join(nodes.select("node", "w").hint("merge"), "node").groupBy("group", "block").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.sum("w").alias("w"))
    blocks = materialize(blocks)
    other = blocks.select("group", F.col("block").alias("y"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("w").alias("w_y"))
    # pairs of blocks, not of nodes: a group of n nodes has (n / BLOCK) ** 2 / 2
    facing = blocks.withColumnRenamed("block", "x").join(other.hint("merge"), "group").where("x <= y")
    surely = ((F.col("high") + F.col("high_y") + 2) * width < theta - margin).alias("surely")
    never = ((F.col("low_y") - F.col("high") - 1) * width > theta + margin) | ((F.col("low") - F.col("high_y") - 1) * width > theta + margin)
    facing = materialize(facing.where(~never).select("group", "x", "y", "w", "w_y", surely))
    met = _counts(_dealt(members.select("group", "block", "node"), facing.where("not surely").select("group", "x", "y"), nodes), least)
    whole = facing.where("surely").select("group", F.col("x").alias("block"), F.col("w_y").alias("w")).unionByName(facing.where("surely and x <> y").select("group", F.col("y").alias("block"), "w"))
    itself = facing.where("surely and x = y").select("group", F.col("x").alias("block"), F.lit(1).alias("itself"))
    added = whole.groupBy("group", "block").agg(F.sum("w").alias("n")).join(itself, ["group", "block"], "left")
    added = members.join(added.hint("merge"), ["group", "block"]).join(nodes.select("node", "w").hint("merge"), "node").select("node", (F.col("n") - F.when(F.col("itself") == 1, F.col("w")).otherwise(0)).alias("n"))
    return met.unionByName(added).groupBy("node").agg(F.sum("n").alias("n"))


@tidy
def near_vectors(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings (vec_id, embedding, label)."""
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad)
    content = F.sha2(F.concat_ws(",", F.octet_length("label").cast("string"), "label", F.to_json("vector")), 256)
    named = plain.withColumn("norm", F.when(sound, norm)).withColumn("key", F.when(sound & (F.col("norm") > 0) & (F.col("norm") < float("inf")), F.unhex(F.substring(content, 1, 32))))
    rows = materialize(named.select("vec_id", "key"))
    classes = named.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.any_value("vector").alias("vector"), F.any_value("norm").alias("norm"), F.any_value("label").alias("label"))
    nodes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "key", "least", "w", F.xxhash64("label", F.size("vector")).alias("kind"), "vector", "norm"))

    stood = materialize(_celled(nodes).select("node", F.explode(F.array_distinct("cells")).alias("cell")))
    # a table, to which Spark can join a hot cell in several tasks
    shared = materialize(stood.groupBy("cell").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1").withColumnRenamed("cell", "_cell"))
    members = materialize(stood.join(shared.hint("merge"), F.col("cell") == F.col("_cell")).drop("_cell"))
    stars = members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    links = materialize(verify(stars, nodes, least))
    labels = components(links)

    def labelled(df: DataFrame, node: str, to: str) -> DataFrame:
        at = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return df.join(at.hint("merge"), F.col(node) == F.col("_node"), "left").withColumn(to, F.coalesce("_component", node)).drop("_node", "_component")

    # cells that hold several components; a pair with the least node is settled, so cells of two nodes are done
    of = labelled(labelled(members.where("size > 2"), "node", "c"), "least", "cl")
    mixed = materialize(of.where("c <> cl").select(F.col("cell").alias("_cell")).distinct())
    open_cells = materialize(of.join(mixed.hint("merge"), F.col("cell") == F.col("_cell"), "left_semi").select(F.col("cell").alias("group"), "node", "size"))
    if not open_cells.isEmpty():
        cut = F.ceil(2 * F.col("size") / BLOCK)
        cut = F.when(F.col("size") <= BLOCK, 1).otherwise(cut).cast("int")
        dealt = open_cells.select("group", F.pmod(F.xxhash64("node"), cut).cast("int").alias("block"), "node")
        pairs = _block_pairs(open_cells.select("group", cut.alias("blocks")).distinct())
        links = materialize(links.unionByName(_forest(_dealt(dealt, pairs, nodes), least)))
        labels = components(links)

    linked = materialize(count_links(nodes, materialize(labels), least)).withColumnsRenamed({"node": "_linked"})
    smallest = labelled(nodes.select("node", "least"), "node", "c").groupBy("c").agg(F.min("least").alias("component_id"))
    found = labelled(nodes.select("node", "key", "w"), "node", "c").join(smallest.withColumnRenamed("c", "_c").hint("merge"), F.col("c") == F.col("_c"))
    found = found.join(linked.hint("merge"), F.col("node") == F.col("_linked"), "left").select(F.col("key").alias("_key"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.join(found.hint("merge"), F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op13_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
