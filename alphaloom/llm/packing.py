"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Every partition packs its own pieces best-fit and emits the bins that are nearly full. The underfull ones are items of the next round: their counts by length are merged up
a tree, so that the root fits all of them whatever their number is, and bins meet by length and rank.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alphaloom.llm.common import in_parts, table, written

CAPACITY = 4096
#: Appended to every document.
END = 1
#: A bin with at most so many places left is nearly full.
SLACK = 4
#: Pieces that a task packs, about: bounds its memory (under 100 bytes each in Arrow).
BLOCK = 100_000
#: Counts of underfull bins by task and length that are broadcast at most (24 bytes each); more are shuffled.
BROADCAST_ROWS = 500_000
#: Above any capacity.
CAPACITY_BITS = 1 << 16
#: Words, and chunks between white space, whose ids a task remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters outside the Latin blocks, and controls on which regular expression engines differ about white space.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids by string, found by a function where they are not known yet; long strings are not remembered."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        ids = self.find(key)
        if len(key) <= LONGEST:
            self[key] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's.

    Texts of Latin letters are split at white space and into words here, and the model merges each word once: the ids of a text are those of its words, one after the
    other, and words and chunks repeat. Any other text, and any tokenizer that does not split and normalise like the one this was written for, goes through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.split = regex.compile(_WORD).findall
        self.letters = _byte_letters()
        self.words, self.chunks = _Known(self.word), _Known(self.chunk)
        self.latin = all(x in str(self.tokenizer.pre_tokenizer) + str(self.tokenizer.normalizer) for x in (_WORD, "NFC()", r"\s+", "Lowercase()", "ByteLevel(add_prefix_space=False"))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.merge(word)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.word(chunk)
        return b"".join(map(self.words.__getitem__, self.split(chunk)))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif not self.latin or _ODD.search(text) or not unicodedata.is_normalized("NFC", text):
                yield self.whole(text)
            else:
                yield b"".join(map(self.chunks.__getitem__, text.lower().split()))
                if max(len(self.words), len(self.chunks)) > REMEMBERED:
                    self.forget()

    def forget(self) -> None:
        self.words.clear()
        self.chunks.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room; ties by index."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by places left
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        above = mask >> n
        if above:
            left = n + (above & -above).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
            left -= n
        else:
            b, left = len(bins), capacity - n
            bins.append([])
        bins[b].append(i)
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins


class Runs(NamedTuple):
    """Items of one length and of consecutive ranks, each go to consecutive bins: per of them to a bin, at place and after."""

    length: int
    rank: int
    per: int
    bin: int
    place: int


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[Runs]:
    """Best fit, longest first, of items of which only the number of each length is known: where the items of each length and rank (from 0) go.

    Bins with the same room are taken together: each takes as many items of a length as fit, since a bin that took one is the fullest with room for the next. The result
    has no more runs than there are lengths and rooms, whatever the number of items is.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # by places left: (first bin, bins)
    mask, opened, out = 0, 0, []

    def leave(left: int, first: int, n: int) -> None:
        nonlocal mask
        if n and left:
            rooms.setdefault(left, []).append((first, n))
            mask |= 1 << left

    for length, todo in sorted(counts.items(), reverse=True):
        rank = 0
        while rank < todo:
            above = mask >> length
            if above:
                left = length + (above & -above).bit_length() - 1
                first, n = rooms[left].pop()
                if not rooms[left]:
                    del rooms[left]
                    mask ^= 1 << left
            else:
                left, first, n = capacity, opened, -(-(todo - rank) // (capacity // length))
                opened += n
            per = left // length
            full = min(n, (todo - rank) // per)
            some = min(per, todo - rank - full * per) if full < n else 0  # in one more bin
            out.append(Runs(length, rank, per, first, capacity - left))
            rank += full * per + some
            leave(left - per * length, first, full)
            if some:
                leave(left - some * length, first + full, 1)
            leave(left, first + full + bool(some), n - full - bool(some))
    return out


def _tokenized(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(x.as_py() for x in batch.column(1)), strict=True):
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(_PIECE), _PIECE, strict=True)], schema=pa.schema(_PIECE))
        encoder(path).forget()  # workers outlive their tasks

    return run


def _local(capacity: int):
    """A partition's own best fit. Bins that are nearly full are done (rank -1); the others get a rank among the partition's bins of the same total."""

    def settle(rows: pa.Table, node: int, used: int, seen: Counter) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        bins = best_fit(lengths.tolist(), capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
        sizes = np.fromiter(map(len, bins), np.int64, len(bins))
        first = np.cumsum(sizes) - sizes
        ends = np.cumsum(lengths[order])
        totals = np.add.reduceat(lengths[order], first)
        ranks = np.full(len(bins), -1)
        for b in np.flatnonzero(totals < capacity - SLACK).tolist():
            ranks[b] = seen[totals[b]]
            seen[totals[b]] += 1
        each = lambda x: pa.array(np.repeat(x, sizes))
        places = ends - lengths[order] - np.repeat(np.cumsum(totals) - totals, sizes)
        new = [("bin", each((node << 32) + used + np.arange(len(bins)))), ("offset", pa.array(places)), ("total", each(totals)), ("node", pa.array(np.full(len(order), node))), ("rank", each(ranks))]
        out = rows.take(pa.array(order))
        for name, column in new:
            out = out.append_column(name, column)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, used, seen, held = TaskContext.get().partitionId(), 0, Counter(), []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 2 * BLOCK:  # more than repartition() deals to a task; bounds the memory all the same
                out = settle(pa.Table.from_batches(held), node, used, seen)
                used, held = used + out.num_rows, []
                yield from out.to_batches(max_chunksize=10_000)
        if held:
            yield from settle(pa.Table.from_batches(held), node, used, seen).to_batches(max_chunksize=10_000)

    return run


def _merged(runs: list[Runs]):
    """Puts bins, known by total and rank, where the runs say."""
    table = np.array(sorted(runs), np.int64).reshape(-1, len(Runs._fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = np.searchsorted(table[:, 0], np.arange(CAPACITY_BITS))
        for batch in batches:
            total, rank = batch.column("total").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(total), np.int64)
            for x in np.unique(total).tolist():
                own = total == x
                a, b = begins[x], begins[x + 1]
                at[own] = a + np.searchsorted(table[a:b, 1], rank[own], "right") - 1
            _, from_, per, first, place = table[at].T
            nth = rank - from_
            offset = pa.array(batch.column("offset").to_numpy() + place + nth % per * total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array((1 << 62) + first + nth // per), offset], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32), written before, with sequence_id and offset.

    1. Pieces are dealt to tasks of about BLOCK in turn, however the input is laid out, and each task packs its own best-fit. Bins that are nearly full are done.
    2. The underfull bins are items of the next round, which needs only their lengths: partial counts by length are merged up Spark's aggregation tree, at most capacity
       numbers a node, and the root fits the counts. No bin is shut for want of room in a node.
    3. Each bin goes to its place by its length and its rank among the bins of that length, which the counts of the nodes before it give.
    """
    if capacity >= CAPACITY_BITS - 1:
        raise ValueError(f"sequences have at most {CAPACITY_BITS - 2} tokens")
    tasks = max(1, -(-pieces.count() // BLOCK))
    local = written(pieces.repartition(tasks).mapInArrow(_local(capacity), f"{PIECES}, bin long, offset long, total long, node long, rank long"), "packed")
    open_ = local.filter("rank >= 0")
    counts = written(open_.filter("offset = 0").groupBy("node", "total").agg(F.count(F.lit(1)).alias("n")), "counts")
    runs = best_fit_counts({r.total: r.n for r in counts.groupBy("total").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("total").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("node", "total", F.coalesce(before, F.lit(0)).alias("_before"))
    near = F.broadcast(offsets) if counts.count() <= BROADCAST_ROWS else offsets
    ranked = open_.join(near, ["node", "total"]).select("doc_id", "piece", "start", "length", "ids_crc32", "offset", "total", (F.col("_before") + F.col("rank")).alias("rank"))
    out = f"{PIECES}, sequence_id long, offset long"
    done = local.filter("rank < 0").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return done.unionAll(ranked.mapInArrow(_merged(runs), out))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    A null or empty text is the id END alone. Repeated rows and null ids are documents of their own; an empty table gives no rows; other columns are left out. Documents
    longer than the capacity are cut into pieces of it, which fill sequences of their own, and a shorter last piece. Pieces and local bins are written to the shared
    folder, so that a lost executor never makes a later step see other bins; texts are never shuffled.
    """
    path = path or tokenizer_path()
    return pack_pieces(written(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_tokenized(path, capacity), PIECES), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
