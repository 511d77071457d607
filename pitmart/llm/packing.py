"""Shortest-pack-first packing over the length histogram.

Documents become token ids (with an end id), are cut into full pieces and one remainder, and the histogram of piece
lengths, at most `longest` numbers, goes to the driver.  Lengths are placed longest first: pieces of one length go to
the open packing pattern with most room, by the count of both, and only where none has room a new pattern opens.
Patterns with their counts, whose number depends on `longest` alone, are joined back to the pieces by the rank of a
piece among those of its length; ranks are made of salted row numbers, so that a hot length is no single task.

Defined results: a null or empty text is the end id alone, one piece of length 1; repeated rows are packed each on
their own; an empty table gives no rows; other columns are not read.  Spark's own hash spreads ties.
"""

from __future__ import annotations

import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitmart.llm.common import materialize, table, tidy

LONGEST = 2048
END = 1
#: Runs of text whose ids a worker keeps at most, and the bytes of text it looks up at once.
CACHED = 900_000
AT_ONCE = 1 << 23
#: A special token of the tokenizer, and how many runs are encoded at once.
BETWEEN = "<|endoftext|>"
TOGETHER = 1_000
#: Marks that stand for themselves: beside them and beside digits a text can be cut without changing its ids.
MARKS = ".,;:!?*#$%&()[]{}\"/\\+=-_@^~`"
#: Shares that the rows of one length are dealt to, at least, and pieces of the commonest length for a share.
SALTS = 64
SHARE = 500_000
_CACHES: dict[str, "_Ids"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds() -> np.ndarray:
    """Per byte: 1 blank and newline, 2 ASCII letter, 3 ASCII digit, 4 mark, 0 any other."""
    kinds = np.zeros(256, dtype=np.uint8)
    for kind, members in ((1, " \n"), (2, string.ascii_letters), (3, string.digits), (4, MARKS)):
        kinds[np.frombuffer(members.encode(), dtype=np.uint8)] = kind
    return kinds


_KIND = _kinds()
#: [kind of a byte, kind of the next]: whether a text is cut between them.
_CUT = np.zeros((5, 5), dtype=bool)
_CUT[2, 4] = _CUT[4, 2] = True
_CUT[3, 2:] = _CUT[2:, 3] = True


def runs_of(raw: bytes, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the runs of all texts, the first run of each text and the end) of texts joined by blanks, which begin at `bounds`.

    Runs are cut at blanks and newlines, between ASCII or Latin-1 letters and marks, and on both sides of a digit.  At
    each of these places the tokenizer's own split ends a token, normal forms join nothing, and nothing looks back."""
    b = np.frombuffer(raw, dtype=np.uint8)
    kind = _KIND[b]
    lead = np.flatnonzero(b == 0xC3)
    lead = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]  # all but the signs for times and divided by
    kind[lead] = kind[lead + 1] = 2
    inside = kind != 1
    first = inside & np.concatenate(([True], (kind[:-1] == 1) | _CUT[kind[:-1], kind[1:]]))
    count = np.cumsum(inside, dtype=np.int32)
    at = np.flatnonzero(first)
    offsets = np.concatenate((count[at] - 1, count[-1:])).astype(np.int32) if len(at) else np.zeros(1, dtype=np.int32)
    runs = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(b[inside]))
    return runs, np.searchsorted(at, bounds)


def _one_word(run: str) -> bool:
    """Letters below U+0250 whose lower case is letters too: one token of the tokenizer's split."""
    return run.isalpha() and max(run) < "\u0250" and "\u0130" not in run


class _Ids(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of runs; the ids of a text are those of its runs one after another."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _encoded(self, lots: list[list[str]], between: str) -> Iterator[np.ndarray]:
        for x in self.tokenizer.encode_batch_fast([between.join(lot) for lot in lots], add_special_tokens=False):
            yield np.asarray(x.ids, dtype="<u4")

    def learn(self, runs: list[str]) -> None:
        """Words are encoded TOGETHER with blanks between, each up to an id that ends a word; other runs with a special
        token between, which no run holds."""
        words, rest, alone = [], [], []
        for r in runs:
            (words if _one_word(r) else alone if "<|" in r else rest).append(r)
        lots = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for lot, ids in zip(lots, self._encoded(lots, " "), strict=True):
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(lot):
                raw = ids.tobytes()
                self.update(zip(lot, map(raw.__getitem__, map(slice, [0, *(4 * (last[:-1] + 1)).tolist()], (4 * (last + 1)).tolist())), strict=True))
            else:
                rest += lot
        lots = [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)] + [[r] for r in alone]
        for lot, ids in zip(lots, self._encoded(lots, BETWEEN), strict=True):
            cuts = np.flatnonzero(ids == self.between) if len(lot) > 1 else ids[:0]
            raw = ids.tobytes()
            self.update(zip(lot, map(raw.__getitem__, map(slice, [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(raw)])), strict=True))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END behind, where each text begins and the last ends)."""
        raws = [_lower(t).encode() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
        runs, firsts = runs_of(b" ".join(raws) + b" ", bounds)
        coded = runs.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self) + len(known) > CACHED:
            self.clear()
        if new := list(filterfalse(self.__contains__, known)):
            self.learn(new)
        found = [*map(self.__getitem__, known), np.asarray([END], dtype="<u4").tobytes()]
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        order = np.insert(coded.indices.to_numpy().astype(np.int64), firsts[1:], len(known))
        taken = sizes[order]
        ends = np.cumsum(taken)
        out = pool[np.repeat(starts[order] - (ends - taken), taken) + np.arange(ends[-1])]
        return out, np.concatenate(([0], ends[firsts[1:] + np.arange(len(texts))]))


def _lower(text: str) -> str:
    """In lower case, as the tokenizer has it, where that is certain to be the same: in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for each piece of at most `longest` ids."""
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _CACHES.get(path) or _CACHES.setdefault(path, _Ids(path))
        for whole in batches:
            keys, texts = whole.column(0).to_pylist(), [t or "" for t in whole.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts]) // AT_ONCE
            for lot in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                if not len(lot):
                    continue
                ids, bounds = cache.ids(texts[lot[0] : lot[-1] + 1])
                raw = memoryview(ids.tobytes())
                rows: list[tuple] = []
                for key, a, z in zip(keys[lot[0] : lot[-1] + 1], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for start in range(a, z, longest):
                        end = min(start + longest, z)
                        piece = raw[4 * start : 4 * end]
                        rows.append((key, start - a, end - start, zlib.crc32(piece), z - a, *([bytes(piece)] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], longest: int = LONGEST) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack in the order placed, how many such packs)."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(longest, length - 1, -1) if open_packs.get(r)), None)
            if room is None:
                pack, there = (), left
            else:
                pack, there = open_packs[room].popitem()
            used = min(left, there)
            if room is not None and there > used:
                open_packs[room][pack] = there - used
            at = (longest if room is None else room) - length
            grown = (*pack, length)
            open_packs[at][grown] = open_packs[at].get(grown, 0) + used
            left -= used
    return [(pack, n) for room in sorted(open_packs) for pack, n in sorted(open_packs[room].items(), reverse=True)]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by rank: ranks from `rank` on go to sequences from `sequence` on, at `offset`."""
    rows, taken, base = [], defaultdict(int), 0
    for pack, n in patterns:
        offset = 0
        for length in pack:
            rows.append((length, taken[length], base, offset))
            taken[length] += n
            offset += length
        base += n
    rows.sort()
    return {k: np.asarray(v, dtype=np.int64) for k, v in zip(("length", "rank", "sequence", "offset"), zip(*rows, strict=True) if rows else [()] * 4, strict=True)}


def pack(pieces: DataFrame, longest: int = LONGEST) -> DataFrame:
    """pieces, which are read three times, with sequence_id and offset."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `longest` rows
    salts = max(SALTS, max(histogram.values(), default=0) // SHARE)
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts))
    salted = pieces.withColumn("_salt", salt)
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    place = slots(shortest_pack_first(histogram, longest))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("length").alias("_length"), F.col("_salt").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("_row", number).join(offsets, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_of")))
    ranked = ranked.withColumn("sequence_id", F.col("_row") - 1 + F.col("_before")).withColumn("offset", F.lit(0).cast("long")).drop("_salt", "_row", "_length", "_of", "_before")
    shared = pieces.sparkSession.sparkContext.broadcast(place)  # as many rows as patterns have slots: a bound by `longest`
    wide = np.int64(1) << 44

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        keys = at["length"] * wide + at["rank"]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "sequence_id"))
            k = np.searchsorted(keys, length * wide + rank, side="right") - 1
            new = {"sequence_id": pa.array(at["sequence"][k] + rank - at["rank"][k], pa.int64()), "offset": pa.array(at["offset"][k], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    return ranked.mapInArrow(put, ranked.schema)


@tidy
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(tokenize_pieces(table(spark, sf_dir, "documents")))
    return pack(pieces)
