"""Prefix trie of conversations by van Emde Boas recursion.

A turn is named by 128 bits of the SHA-256 of its role and text; a conversation is one row with the names of its turns,
24 bytes a turn.  Equal conversations are one row with a count.

Down: a forest whose tries have 2h levels is cut at half depth.  The distinct cut prefixes of h turns below a root are
named by their smallest conversation; they, with summed counts, are the sequences of the upper trie, and what follows a
prefix becomes a sequence of the lower trie rooted at its name.  Upper tries and lower forests are one table, so that
all are cut at once; after log2(depth) rounds every row is a node.  Only sequences that reach the cut take part in a
round, and a prefix that many conversations share goes on as one row.

Up: the totals below a node reach h levels at first one.  Roots at odd multiples of h are the grafts of the tries with
2h levels: their totals are added to each node on their path within the upper trie and to its root, paths of grafts are
joined to those of the nodes below them, and h doubles.

Rebuilding: conversation c has the first h turns of conversation c - c % 5 (h = crc32(decimal c) % 9), then its own after
its first h.

Defined results: turns are in order of turn (null first), then role, then text's digest; a null role or text is empty;
rows with a null conv_id belong to no conversation and are left out; repeated rows are turns of their own; a rebuilt
conversation without turns ends at the root; the root has no text and a null parent; a long text is a digest and a
length; a conversation must fit in a row, which at 24 bytes a turn is one of 80 million turns; without conversations there
are no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import discard, materialize, table, tidy

HEADS = 9  # a rebuilt conversation begins with fewer turns of another
FAMILY = 5
_NAME, _SIZE = 16, 8
_TURN = _NAME + _SIZE
#: Ids that one row carries of those which end at a node that very many share.
IDS_A_ROW = 50_000
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _head(sequence: str | Column, turns: int | Column) -> Column:
    return F.substring(sequence, F.lit(1), F.lit(turns) * _TURN)


def _rest(sequence: str | Column, turns: int | Column) -> Column:
    return F.substring(sequence, F.lit(turns) * _TURN + 1, F.octet_length(sequence))


def _n_turns(sequence: str | Column) -> Column:
    return (F.octet_length(sequence) / _TURN).cast("int")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv, seq): the turns of each conversation in order, each as a name and the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    key = F.concat(F.unhex(F.substring(digest, 1, 2 * _NAME)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 2 * _SIZE, "0")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "key")))  # null turns first
    return turns.groupBy("conv").agg(ordered.alias("turns")).select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("seq"))


def rebuild(convs: DataFrame) -> DataFrame:
    """(conv, seq) with the first turns of the family's conversation before the own ones that follow as many."""
    h = (F.crc32(F.col("conv").cast("string")) % HEADS).cast("int")
    heads = convs.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("_family"), _head("seq", HEADS - 1).alias("_head"))
    own = convs.withColumn("h", h).withColumn("family", F.col("conv") - F.col("conv") % FAMILY)
    joined = own.join(heads, F.col("family") == F.col("_family"), "left")
    return joined.select("conv", F.concat(_head(F.coalesce("_head", F.lit(b"")), F.col("h")), _rest("seq", F.col("h"))).alias("seq"))


def _cut(forest: DataFrame, half: int) -> DataFrame:
    """One round down: tries of 2 * half levels to tries of half as many.  Rows (root, depth: of the root, seq, conv, n,
    ended: the conversation that ends with seq, as it is named) are distinct by root and seq."""
    reach = F.octet_length("seq") >= half * _TURN
    above = forest.where(~reach)
    cut = forest.where(reach).select("root", "depth", _head("seq", half).alias("first"), _rest("seq", half).alias("rest"), "conv", "n", "ended")
    upper = cut.groupBy("root", "depth", "first").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max(F.when(F.octet_length("rest") == 0, F.col("ended"))).alias("ended"))
    upper = materialize(upper)  # to a table Spark can join the sequences behind a hot prefix in several tasks
    names = upper.select(F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("first").alias("_first"), F.col("conv").alias("name"))
    same = (F.col("root") == F.col("_root")) & (F.col("depth") == F.col("_depth")) & (F.col("first") == F.col("_first"))
    lower = cut.where(F.octet_length("rest") > 0).join(names, same).select(F.col("name").alias("root"), (F.col("depth") + half).cast("int").alias("depth"), F.col("rest").alias("seq"), "conv", "n", "ended")
    return above.unionByName(upper.withColumnRenamed("first", "seq")).unionByName(lower)


def _below(nodes: DataFrame) -> DataFrame:
    """Nodes with children: (conv, depth, root: their parent, path: the node alone, leaves and saved: of the children)."""
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("_conv"), (F.col("depth") - 1).alias("_depth")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.join(children.hint("merge"), (F.col("conv") == F.col("_conv")) & (F.col("depth") == F.col("_depth"))).select("conv", "depth", F.col("parent").alias("root"), F.array("conv").alias("path"), "leaves", children["saved"])


def _graft(below: DataFrame, h: int) -> tuple[DataFrame, DataFrame]:
    """One round up: (totals that nodes inside the upper tries get from their grafts, the roots of tries of 2h levels)."""
    odd, even = below.where(F.col("depth") % (2 * h) == h), below.where(F.col("depth") % (2 * h) == 0)
    held = odd.where("leaves > 0 or saved > 0")
    added = held.select(F.posexplode("path").alias("place", "conv"), "depth", "leaves", "saved").select("conv", (F.col("depth") - h + 1 + F.col("place")).cast("int").alias("depth"), "leaves", "saved")
    added = added.groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = held.groupBy(F.col("root").alias("_up"), (F.col("depth") - h).alias("_up_depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    paths = odd.select(F.col("conv").alias("_graft"), F.col("depth").alias("_graft_depth"), F.col("root").alias("_root"), F.col("path").alias("_path"))
    roots = even.join(up.hint("merge"), (F.col("conv") == F.col("_up")) & (F.col("depth") == F.col("_up_depth")), "left")
    roots = roots.join(paths.hint("merge"), (F.col("root") == F.col("_graft")) & (F.col("depth") - h == F.col("_graft_depth")), "left")
    plus = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    return added, roots.select("conv", "depth", F.col("_root").alias("root"), F.concat("_path", "path").alias("path"), plus("leaves"), plus("saved"))


def _ends(convs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(ended, ends_sha256) of each distinct sequence.  Ids that share one are sorted across tasks and packed in runs; the
    digest itself, which has to see them in order, reads the runs one by one."""
    alone = distinct.where("n = 1").select("ended", F.sha2(F.col("ended").cast("string").cast("binary"), 256).alias("ends_sha256"))
    shared = distinct.where("n > 1").select(F.col("key").alias("_key"), "ended")
    ids = convs.join(shared.hint("merge"), F.col("key") == F.col("_key")).select("ended", "conv").repartitionByRange("ended", "conv").sortWithinPartitions("ended", "conv")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ended, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *((ended[1:] != ended[:-1]).nonzero()[0] + 1).tolist(), len(ended)] if len(ended) else []
            starts = [k for a, z in zip(cuts[:-1], cuts[1:], strict=True) for k in range(a, z, IDS_A_ROW)] if cuts else []
            own = [conv[a:z].tolist() for a, z in zip(starts, [*starts[1:], len(ended)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ended[starts] if starts else [], pa.int64()), pa.array([o[0] for o in own], pa.int64()), pa.array([",".join(map(str, o)) for o in own], pa.string())], ["ended", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for ended, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ended != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = ended, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["ended", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], ["ended", "ends_sha256"])

    packed = ids.mapInArrow(runs, "ended long, first long, ids string").repartition("ended").sortWithinPartitions("ended", "first").select("ended", "ids")
    return alone.unionByName(packed.mapInArrow(digests, "ended long, ends_sha256 string"))


@tidy
def trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie
    of the sequences convs (conv, seq)."""
    convs = materialize(convs.withColumn("key", F.sha2("seq", 256)))
    distinct = materialize(convs.groupBy("key").agg(F.min("conv").alias("ended"), F.count("*").alias("n"), F.any_value("seq").alias("seq")))
    top, everyone, longest = distinct.agg(F.min("ended"), F.sum("n"), F.max(_n_turns("seq"))).first()
    empty = distinct.where(F.octet_length("seq") == 0).select("ended").first()
    forest = distinct.where(F.octet_length("seq") > 0).select(F.lit(top).cast("long").alias("root"), F.lit(0).alias("depth"), "seq", F.col("ended").alias("conv"), "n", "ended")
    height = 1
    while height < (longest or 0):
        height *= 2
    half = height // 2
    while half:
        forest, cut = materialize(_cut(forest, half)), forest
        if half < height // 2:
            discard(cut)
        half //= 2

    size = F.conv(F.hex(F.substring("seq", _NAME + 1, _SIZE)), 16, 10).cast("long")
    nodes = forest.select("conv", (F.col("depth") + 1).cast("int").alias("depth"), F.col("root").alias("parent"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * size).alias("saved"), "ended")
    root = distinct.limit(1).select(F.lit(top).cast("long").alias("conv"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(everyone).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"), F.lit(empty["ended"] if empty else None).cast("long").alias("ended"))
    nodes = nodes.unionByName(root)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("_conv"), (F.col("depth") - 1).alias("_depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.hint("merge"), (F.col("conv") == F.col("_conv")) & (F.col("depth") == F.col("_depth")), "left").drop("_conv", "_depth").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = materialize(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    below, h, parts = materialize(_below(nodes)), 1, []
    while h < height:
        added, roots = _graft(below, h)
        parts.append(materialize(added))
        done, below, h = below, materialize(roots), 2 * h
        discard(done)
    totals = below.select("conv", "depth", "leaves", "saved")  # of the root, all below it
    for part in parts:
        totals = totals.unionByName(part)
    totals = totals.groupBy(F.col("conv").alias("_conv"), F.col("depth").alias("_depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    out = nodes.join(totals.hint("merge"), (F.col("conv") == F.col("_conv")) & (F.col("depth") == F.col("_depth")), "left")
    ends = _ends(convs, distinct).withColumnRenamed("ended", "_ended")
    out = out.join(ends.hint("merge"), F.col("ended") == F.col("_ended"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        plus("leaf", "_leaves").alias("n_leaves"), plus("saved", "_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuild(sequences(table(spark, sf_dir, "conversations"))))
