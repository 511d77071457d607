"""A hashed maximum-entropy language model with a class-factored softmax.

A text is its words, A-Z lower-cased, and one end.  P(word | before) = P(class | before) * P(word | class).  The class
softmax has hashed features: the word before, the word two before (a skip), and the pair of classes before.
All words seen LEAST times in the training texts are dealt to classes by the texts they stand in (random
indexing, then k-means) and by frequency; inside a class the maximum-entropy solution with word features is the
relative frequency.  All other words are one class.  Of it the share that falls to words seen once
is 2 n2 / (2 n2 + n1), with n1 and n2 words seen once and twice (the counts that they would have been left with), dealt
evenly to the n1 words; the rest is spelt by an interpolated model of four bytes, so that every text has a probability.

Texts are dealt to batches.  The counts of all words are a table by hash; the distinct words of a batch are joined to
their count, class and feature row and meet the texts of the batch, which become classes and feature rows.  Only the
feature rows, of which there is one for about WORDS_A_ROW words, and the counted runs of four bytes are broadcast; no
count is capped.

Training: each partition runs minibatch gradient steps (Adagrad) over its texts; the weight rows meet in a shuffle,
averaged by how often a partition saw the feature.

Defined results: null and empty texts are the end alone; without training texts all counts are 0; a null doc_id is not
held out; repeated rows are scored each on their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitmart.llm.common import discard, materialize, table, tidy, uniform
from pitmart.llm.shingles import word_hashes

LEAST = 2  # occurrences from which a word has a class; words seen once stand for the unseen
CLASSES = 32
OTHER, END = 0, 1
CLUSTERS = 8
SLOTS = 4096  # hashed feature rows of one position, at least; half of them for the most frequent words
WORDS_A_ROW = 256
CONTEXT = 8  # numbers of a word's context vector, a byte each
BATCH = 2048
RATE = 0.4
END_HASH = np.uint64(0x0E2D0E2D0E2D0E2D)
_COUNTED_AT_ONCE = 16 << 20  # bytes
_INDEX = np.random.Generator(np.random.PCG64(5)).normal(size=(4096, CONTEXT)).astype(np.float32)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@dataclass
class Tokens:
    """Tokens of several texts: hashes, where each text begins, and the bytes of each word (an end has none)."""

    hashes: np.ndarray
    bounds: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    """An end follows the words of each text."""
    whole = b" ".join(texts).lower() + b" "
    hashes, bounds = word_hashes(texts)
    b = np.frombuffer(whole, dtype=np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([1], space.astype(np.int8))))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    at = bounds[1:]
    return Tokens(np.insert(hashes, at, END_HASH), bounds + np.arange(len(bounds)), b, np.insert(starts, at, 0), np.insert(ends, at, 0))


def _byte_codes(t: Tokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte, and of the blank after it, with three bytes before; index into which) of the chosen words."""
    size = (t.ends[which] - t.starts[which] + 1).astype(np.int64)
    of = np.repeat(np.arange(len(which)), size)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    at = t.starts[which][of] + offset
    c = np.where(offset == size[of] - 1, 32, t.raw[at]).astype(np.int64)
    one = np.where(offset >= 1, t.raw[at - 1], 0).astype(np.int64)
    two = np.where(offset >= 2, t.raw[at - 2], 0).astype(np.int64)
    three = np.where(offset >= 3, t.raw[at - 3], 0).astype(np.int64)
    return three << 24 | two << 16 | one << 8 | c, of


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of at most `most` bytes, or one text."""
    ids, texts, total = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (t or "").encode()
            if texts and total + len(raw) > most:
                yield ids, texts
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(raw)
            total += len(raw)
    if texts:
        yield ids, texts


class _Held:
    """Tokens of texts that are counted together; the bytes of a text are let go once it is added."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.texts: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.trained: list[np.ndarray] = []
        self.n = 0

    def add(self, texts: list[bytes], trained: bool) -> None:
        t = tokens(texts)
        if trained:
            keys, first = np.unique(t.hashes, return_index=True)
            codes, _ = _byte_codes(t, first[keys != END_HASH])
            self.grams.append(np.unique(codes, return_counts=True))
        self.trained.append(np.full(len(texts), trained))
        # of each text the normed sum of its words' random vectors; of each word the sum of its texts'
        of_text = np.add.reduceat(_INDEX[t.hashes % np.uint64(len(_INDEX))], t.bounds[:-1], axis=0)
        self.vectors.append(of_text / (np.linalg.norm(of_text, axis=1, keepdims=True) + 1e-9))
        self.hashes.append(t.hashes)
        self.texts.append(np.repeat(np.arange(self.n, self.n + len(texts), dtype=np.int32), np.diff(t.bounds)))
        self.n += len(texts)

    def counted(self, batch: int) -> Iterator[pa.RecordBatch]:
        keys, inverse, n = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        text, of_text = np.concatenate(self.texts), np.concatenate(self.vectors)
        # the mean of the texts' vectors, each number between -1 and 1 in one byte
        mean = np.stack([np.bincount(inverse, weights=of_text[text, d], minlength=len(keys)) for d in range(CONTEXT)], axis=1) / n[:, None]
        context = np.ascontiguousarray(np.rint(mean * 127).astype(np.int8)).view("<i8").ravel()
        trained = np.bincount(inverse, weights=np.concatenate(self.trained)[text], minlength=len(keys)).astype(np.int64)
        codes, times = (np.concatenate([g[i] for g in self.grams]) for i in (0, 1)) if self.grams else (np.zeros(0, dtype=np.int64),) * 2
        grams, of = np.unique(codes, return_inverse=True)
        gram_n = np.bincount(of, weights=times, minlength=len(grams)).astype(np.int64)
        kind = np.repeat(np.array([0, 1], dtype=np.int8), [len(keys), len(grams)])
        key = np.concatenate((keys.view(np.int64), grams.astype(np.int64)))
        out = np.concatenate((trained < n, np.zeros(len(grams), dtype=bool)))
        times = np.concatenate((trained, gram_n))
        context = np.concatenate((context, np.zeros(len(grams), dtype=np.int64)))
        for at in range(0, len(key), 100_000):
            z = min(len(key), at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(z - at, batch)), *(pa.array(x[at:z]) for x in (kind, key, times, context, out))], ["batch", "kind", "key", "n", "context", "out"])


def dealt(docs: DataFrame) -> DataFrame:
    """docs with the number of the batch, of about _COUNTED_AT_ONCE bytes, that a text is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        for ids, texts in _groups(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], ["batch", "doc_id", "text"])
            size += sum(map(len, texts))
            if size >= _COUNTED_AT_ONCE:
                number, size = number + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, "batch long, doc_id long, text string")


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows that have the same batch as their first column, without it."""
    for whole in batches:
        number = whole.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True) if cuts else ():
            part = whole.slice(a, z - a)
            yield int(number[a]), pa.RecordBatch.from_arrays(part.columns[1:], names=part.schema.names[1:])


def count_tokens(texts: DataFrame) -> DataFrame:
    """(batch, kind, key, n, context, out: whether a held-out text has it): kind 0 words of a batch by hash with their count in training texts (0 for words
    of held-out texts alone) and mean context vector, 1 runs of four bytes of distinct training words; summed by the
    caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, _Held()
        for number, part in _by_batch(batches):
            if number != at and held.hashes:
                yield from held.counted(at)
                held = _Held()
            at = number
            for ids, some in _groups([part], 2 << 20):
                out = np.array([held_out(i) for i in ids])
                for trained in (True, False):
                    chosen = [t for t, o in zip(some, out, strict=True) if o != trained]
                    if chosen:
                        held.add(chosen, trained)
        if held.hashes:
            yield from held.counted(at)

    return texts.select("batch", "doc_id", "text").mapInArrow(run, "batch long, kind tinyint, key long, n long, context long, out boolean")


@dataclass
class Vocabulary:
    words: DataFrame  # batch, h, c, class, logp: log10 P(word | class), slot; of each batch, but for words seen once and in its training texts alone
    occurring: DataFrame  # the table behind words
    spelling: "Spelling"
    total: int
    distinct: int
    slots: int
    once: int  # words seen once
    twice: int


def _at(keys: np.ndarray, values: np.ndarray, sought: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
    """Values by sorted keys."""
    if not len(keys):
        return np.broadcast_to(otherwise, sought.shape).astype(float)
    k = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return np.where(keys[k] == sought, values[k], otherwise)


class Spelling:
    """P(byte | three bytes before), each order smoothed by MU times the next shorter one."""

    MU = 3.0

    def __init__(self, codes: np.ndarray, n: np.ndarray) -> None:
        n = n.astype(float)
        single = np.bincount(codes & 255, weights=n, minlength=256)
        pairs = np.bincount(codes & 0xFFFF, weights=n, minlength=65536).reshape(256, 256)
        self.p2 = ((pairs + self.MU * (single + 1) / (single.sum() + 256)) / (pairs.sum(axis=1, keepdims=True) + self.MU)).ravel()
        self.keys3, of3 = np.unique(codes & 0xFFFFFF, return_inverse=True)
        n3 = np.bincount(of3, weights=n, minlength=len(self.keys3))
        self.begin3 = np.bincount(self.keys3 >> 8, weights=n3, minlength=65536)
        self.p3 = (n3 + self.MU * self.p2[self.keys3 & 0xFFFF]) / (self.begin3[self.keys3 >> 8] + self.MU)
        self.contexts, of4 = np.unique(codes >> 8, return_inverse=True)
        self.begin4 = np.bincount(of4, weights=n, minlength=len(self.contexts))
        self.keys4 = codes
        self.p4 = (n + self.MU * self._three(codes)) / (self.begin4[of4] + self.MU)

    def _three(self, codes: np.ndarray) -> np.ndarray:
        back = self.MU * self.p2[codes & 0xFFFF] / (self.begin3[codes >> 8 & 0xFFFF] + self.MU)
        return _at(self.keys3, self.p3, codes & 0xFFFFFF, back)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        back = self.MU * self._three(codes) / (_at(self.contexts, self.begin4, codes >> 8, 0.0) + self.MU)
        return np.log10(_at(self.keys4, self.p4, codes, back))


def _nearest(centres: np.ndarray) -> Column:
    """Index of the centre that is nearest to the vector x by angle."""
    dots = F.array(*(sum((F.col("x")[d] * F.lit(float(c[d])) for d in range(1, CONTEXT)), F.col("x")[0] * F.lit(float(c[0]))) for c in centres))
    return (F.array_position(dots, F.array_max(dots)) - 1).cast("int")


def _centres(words: DataFrame) -> np.ndarray | None:
    """k-means by angle over all words (h, c, x), a word weighing the root of its count."""
    far = np.array([r["x"] for r in words.orderBy(F.desc("c"), "h").limit(4096).select("x").collect()])  # where to begin
    if len(far) < CLUSTERS:
        return None
    centres = far[:1]
    for _ in range(CLUSTERS - 1):  # the frequent word farthest from all centres so far
        centres = np.concatenate((centres, far[[np.argmin((far @ centres.T).max(axis=1))]]))
    for _ in range(20):
        rows = words.groupBy(_nearest(centres).alias("k")).agg(*(F.sum(F.col("x")[d] * F.sqrt("c")).alias(f"x{d}") for d in range(CONTEXT))).collect()
        moved = centres.copy()
        for r in rows:
            v = np.array([r[f"x{d}"] for d in range(CONTEXT)])
            if np.abs(v).sum() > 0:
                moved[r["k"]] = v / (np.linalg.norm(v) + 1e-9)
        settled = np.abs(moved - centres).max() < 1e-3
        centres = moved
        if settled:
            break
    return centres


def build_vocabulary(counted: DataFrame) -> Vocabulary:
    spark = counted.sparkSession
    # one shuffle by word; words seen once are of class OTHER and are joined to nothing more
    rows = counted.where("kind = 0").select("batch", F.col("key").alias("h"), "n", "context", "out").withColumn("c", F.sum("n").over(Window.partitionBy("h")))
    occurring = materialize(rows.where("c > 0").withColumn("context", F.when(F.col("c") >= LEAST, F.col("context"))))
    grams = counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")  # distinct runs of four bytes
    del rows
    _let_go(spark, counted)
    numbers = [F.sum(F.col("n") * F.shiftright(F.shiftleft("context", 56 - 8 * d), 56)).cast("double").alias(f"x{d}") for d in range(CONTEXT)]
    norm = F.sqrt(sum((F.col(f"x{d}") * F.col(f"x{d}") for d in range(1, CONTEXT)), F.col("x0") * F.col("x0"))) + 1e-9
    often = occurring.where((F.col("c") >= LEAST) & (F.col("h") != F.lit(int(END_HASH))))
    words = materialize(often.groupBy("h", "c").agg(*numbers).select("h", "c", F.array(*((F.col(f"x{d}") / norm).cast("float") for d in range(CONTEXT))).alias("x")))
    known = words.count()
    end = F.col("h") == F.lit(int(END_HASH))
    total, single, ended = occurring.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(~end & (F.col("c") == 1) & (F.col("n") == 1)), F.count_if(end)).first()
    distinct = known + single + (ended > 0)
    twice = words.where("c = 2").count()
    spelling = Spelling(grams["key"].to_numpy(dtype=np.int64), grams["n"].to_numpy(dtype=np.int64))

    slots = SLOTS
    while slots * WORDS_A_ROW < known:
        slots *= 2
    own = slots // 2
    centres = _centres(words)
    words = words.select("h", "c", (F.lit(CLUSTERS) if centres is None else _nearest(centres)).cast("int").alias("cluster"))
    # words of one cluster and count stand together; there are no more counts than the root of twice the tokens
    groups = words.groupBy("cluster", "c").agg(F.count("*").alias("n")).toPandas().sort_values(["cluster", "c"], ascending=[True, False])
    mass_of = {int(k): int((g["c"] * g["n"]).sum()) for k, g in groups.groupby("cluster")}
    spare, at, places = CLASSES - 2 - (CLUSTERS + 1), 2, []
    for k in sorted(mass_of, key=lambda k: (-mass_of[k], k)):
        bins = 1 + int(spare * mass_of[k] / sum(mass_of.values()))
        before = 0
        for c, n in groups.loc[groups["cluster"] == k, ["c", "n"]].itertuples(index=False):
            places.append((k, int(c), before, int(c * n), bins, mass_of[k], at))
            before += int(c * n)
        at += bins
    placed = spark.createDataFrame(places, "_k int, _c long, before long, own long, bins int, mass long, at int")
    place = F.floor((F.col("before") + uniform("h") * F.col("own")) * F.col("bins") / F.col("mass"))
    classed = words.join(F.broadcast(placed), (F.col("cluster") == F.col("_k")) & (F.col("c") == F.col("_c"))).select("h", "c", (F.col("at") + F.least(F.col("bins") - 1, place)).cast("int").alias("class"))
    classed = materialize(classed)
    in_class = [1] * CLASSES
    for r in classed.groupBy("class").agg(F.sum("c").alias("c")).collect():
        in_class[r["class"]] = r["c"]
    logp = F.log10(F.col("c") / F.element_at(F.array(*(F.lit(float(c)) for c in in_class)), F.col("class") + 1)).cast("float")
    first = [r["h"] for r in classed.orderBy(F.desc("c"), "h").limit(own).select("h").collect()]  # one for each row of its own
    ranked = spark.createDataFrame(list(zip(first, range(len(first)), strict=True)), "_h long, rank int")
    slot = F.coalesce("rank", (F.lit(own) + F.pmod("h", F.lit(slots - own))).cast("int"))
    classed = classed.join(F.broadcast(ranked), F.col("h") == F.col("_h"), "left").select(F.col("h").alias("_w"), "class", logp.alias("logp"), slot.alias("slot"))
    named = often.select("batch", "h", "c").join(classed, F.col("h") == F.col("_w")).drop("_w")
    # a word of a training text that is not among these is seen once; held-out texts cannot tell
    other = occurring.where((F.col("c") < LEAST) & F.col("out") | end).select("batch", "h", "c", F.lit(OTHER).alias("class"), F.lit(0.0).cast("float").alias("logp"), F.lit(-1).alias("slot"))
    return Vocabulary(materialize(named.unionByName(other)), occurring, spelling, int(total), int(distinct), slots, int(single), twice)


def _let_go(spark: SparkSession, *done: DataFrame) -> None:
    """Frees tables, and shuffle files that no plan holds any more."""
    for df in done:
        discard(df)
    gc.collect()
    spark._jvm.System.gc()


def code(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, fixed, classes, slots) of each text: sums of its tokens' log counts and
    log10 P(token | class), and the class and feature row of each token."""
    none = {"h": "long", "c": "long", "class": "int", "logp": "float", "slot": "int", "doc_id": "long", "text": "string"}
    blank = lambda names: [F.lit(None).cast(none[n]).alias(n) for n in names]
    one = v.words.select("batch", F.lit(True).alias("word"), "h", "c", "class", "logp", "slot", *blank(["doc_id", "text"]))
    two = texts.select("batch", F.lit(False).alias("word"), *blank(["h", "c", "class", "logp", "slot"]), "doc_id", "text")
    together = one.unionByName(two).repartition("batch").sortWithinPartitions("batch", F.desc("word"))
    shared = texts.sparkSession.sparkContext.broadcast(v.spelling)
    slots, own = v.slots, v.slots // 2
    share = 2 * v.twice / (2 * v.twice + v.once) if v.once and v.twice else 0.0
    each = share / max(v.once, 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "fixed", "classes", "slots"]

    def coded(words: list[np.ndarray], ids: list, some: list[bytes]) -> pa.RecordBatch:
        h, c, classes_of, logp, slot_of = words
        t = tokens(some)
        n = len(t.hashes)
        if len(h):
            k = np.minimum(np.searchsorted(h, t.hashes), len(h) - 1)
            found = h[k] == t.hashes
        else:
            k, found = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            h, c, classes_of, logp, slot_of = (np.zeros(1, dtype=x.dtype) for x in words)
        classes = np.where(found, classes_of[k], OTHER)
        end = t.hashes == END_HASH
        last = t.raw[np.maximum(t.ends - 1, 0)].astype(np.int64) * 31 + t.raw[np.maximum(t.ends - 2, 0)].astype(np.int64)
        slot = np.where(classes != OTHER, slot_of[k], own + last % (slots - own))
        fixed = np.where(classes != OTHER, logp[k], 0.0).astype(float)
        out = np.array([held_out(i) for i in ids])
        once = ~found & ~np.repeat(out, np.diff(t.bounds))  # of a training text
        rare = np.flatnonzero((classes == OTHER) & ~end)
        spelt = _spelt(shared.value, t, rare) + np.log10(1 - share)
        single = (once[rare] | found[rare] & (c[k[rare]] == 1)) & (each > 0)
        spelt[single] = np.logaddexp(spelt[single] * np.log(10), np.log(each or 1.0)) / np.log(10)
        fixed[rare] += spelt
        classes[end], slot[end] = END, slots - 1
        starts, cuts = t.bounds[:-1], list(zip(t.bounds[:-1], t.bounds[1:], strict=True))
        classes, slot = classes.astype(np.uint8), slot.astype(np.uint16 if slots <= 1 << 16 else np.uint32)
        logs = np.where(found, np.log10(c[k] + 1.0), np.where(once, np.log10(2.0), 0.0))
        sums = [np.add.reduceat(x, starts) for x in ((found | once).astype(np.int64), logs, fixed)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(out), pa.array(np.diff(t.bounds)), *map(pa.array, sums)]
            + [pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for x in (classes, slot)],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, words = None, [], None
        for number, part in _by_batch(batches):
            if number != at:
                at, parts, words = number, [], None
            is_word = part.column(0).to_numpy(zero_copy_only=False)
            n = int(is_word.sum())
            if n:
                first = part.slice(0, n)
                parts.append([first.column(i).to_numpy() for i in range(1, 6)])
            if n < part.num_rows:
                if words is None:
                    kinds = (np.uint64, np.int64, np.int64, np.float32, np.int64)
                    joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=k) for i, k in enumerate(kinds)]
                    joined[0] = joined[0].view(np.uint64)
                    _, order = np.unique(joined[0], return_index=True)  # a batch read in parts has its words twice
                    words, parts = [x[order] for x in joined], []
                rest = part.slice(n)
                for ids, some in _groups([pa.RecordBatch.from_arrays([rest.column(6), rest.column(7)], ["doc_id", "text"])], 1 << 20):
                    yield coded(words, ids, some)

    return together.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, fixed double, classes binary, slots binary")


def _features(classes: np.ndarray, slot: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Feature rows of each token: the word before, the word two before, the pair of classes before."""
    n = len(classes)
    inside = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))  # position in its text
    features = np.empty((n, 3), dtype=np.int64)
    before = []
    for k in (1, 2):
        moved = np.concatenate((np.zeros(min(k, n), dtype=np.int64), slot[: max(0, n - k)]))
        features[:, k - 1] = np.where(inside >= k, moved, slots - 1) + (k - 1) * slots
    for k in (1, 2):
        moved = np.concatenate((np.zeros(min(k, n), dtype=np.int64), classes[: max(0, n - k)]))
        before.append(np.where(inside >= k, moved, END))
    features[:, 2] = 2 * slots + before[0] * CLASSES + before[1]
    return features


def _read(part: pa.RecordBatch, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, classes, bounds) of the texts of a batch of coded rows, whose last columns are classes and slots."""
    names = part.schema.names
    classes, slot = (b"".join(part.column(names.index(c)).to_pylist()) for c in ("classes", "slots"))
    classes = np.frombuffer(classes, dtype=np.uint8).astype(np.int64)
    slot = np.frombuffer(slot, dtype=np.uint16 if slots <= 1 << 16 else np.uint32).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(part.column(names.index("n_tokens")).to_numpy())))
    return _features(classes, slot, bounds, slots), classes, bounds


def _softmax(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = w[features[:, 0]] + w[-1]
    for k in range(1, features.shape[1]):
        z += w[features[:, k]]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


class Trainer:
    """Adagrad over minibatches of one partition."""

    def __init__(self, rows: int) -> None:
        self.w = np.zeros((rows, CLASSES), dtype=np.float32)
        self.squares = np.full(rows, 1e-4, dtype=np.float32)
        self.seen = np.zeros(rows, dtype=np.int64)

    def step(self, features: np.ndarray, classes: np.ndarray) -> None:
        g = _softmax(self.w, features)
        g[np.arange(len(classes)), classes] -= 1
        width = features.shape[1]
        flat = features.ravel()
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rows = ordered[cuts]
        sums = np.add.reduceat(g[order // width], cuts, axis=0)
        rows, sums = np.append(rows, len(self.w) - 1), np.concatenate((sums, g.sum(axis=0, keepdims=True)))
        self.seen[rows] += np.diff(np.concatenate((cuts, [len(flat), len(flat) + len(classes)])))
        self.squares[rows] += (sums * sums).mean(axis=1)
        self.w[rows] -= RATE * sums / np.sqrt(self.squares[rows])[:, None] / np.sqrt(CLASSES / 8)


def train(coded: DataFrame, slots: int) -> np.ndarray:
    n_rows = 2 * slots + CLASSES * CLASSES + 1  # the last is the bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(n_rows)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                features, classes, _ = _read(whole.slice(k, 1024), slots)
                for at in range(0, len(classes), BATCH):
                    trainer.step(features[at : at + BATCH], classes[at : at + BATCH])
        rows = np.flatnonzero(trainer.seen)
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(trainer.seen[some]), pa.array([w.tobytes() for w in trainer.w[some]], pa.binary())], ["row", "seen", "w"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((n_rows, CLASSES)), np.zeros(n_rows)
        for batch in batches:
            rows, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
            w = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float32).reshape(-1, CLASSES)
            np.add.at(sums, rows, w * n[:, None])
            np.add.at(seen, rows, n)
        rows = np.flatnonzero(seen)
        if len(rows):
            mean = (sums[rows] / seen[rows, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([w.tobytes() for w in mean], pa.binary())], ["row", "w"])

    trained = coded.where("not held_out").select("n_tokens", "classes", "slots")
    parts = trained.mapInArrow(run, "row int, seen long, w binary").repartition("row").mapInArrow(average, "row int, w binary")
    w = np.zeros((n_rows, CLASSES), dtype=np.float32)
    for r in parts.toLocalIterator():  # at most n_rows rows
        w[r["row"]] = np.frombuffer(r["w"], dtype=np.float32)
    return w


def _spelt(spelling: Spelling, t: Tokens, which: np.ndarray) -> np.ndarray:
    """log10 P(bytes) of the chosen words."""
    codes, of = _byte_codes(t, which)
    return np.bincount(of, weights=spelling.logs(codes), minlength=len(which))


def score(coded: DataFrame, w: np.ndarray, slots: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, score) of coded texts."""
    shared = coded.sparkSession.sparkContext.broadcast(w)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                part = whole.slice(k, 1024)
                features, classes, bounds = _read(part, slots)
                logs = np.empty(len(classes))
                for at in range(0, len(logs), BATCH):
                    own = classes[at : at + BATCH]
                    logs[at : at + BATCH] = np.log10(np.maximum(_softmax(shared.value, features[at : at + BATCH])[np.arange(len(own)), own], 1e-12))
                sums = np.add.reduceat(logs, bounds[:-1]) + part.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sums)], names)

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")


@tidy
def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text)."""
    texts = materialize(dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "zstd")
    counted = materialize(count_tokens(texts), "zstd")
    v = build_vocabulary(counted)
    _let_go(docs.sparkSession, v.occurring)
    coded = materialize(code(texts, v), "zstd")
    _let_go(docs.sparkSession, texts, v.words)
    scored = score(coded, train(coded, v.slots), v.slots)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(v.total + v.distinct + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
