"""Shortest-pack-first packing of tokenised documents over the histogram of lengths.

One pass encodes every text. It cuts a document into full sequences and a rest, the rest in every permitted way (whole, or
after multiples of 1024, 512, 256 ids), takes each piece's checksum at once, and counts the pieces of a length as it goes:
a piece's number among those of its length and task is stored with it. Lengths are few (at most `capacity` a way), so their
histogram is all that the driver reads. It places lengths longest first, each into the shortest pack that still holds it,
updating how many packs have a pattern; a pack is opened where none does. The way with the fewest cuts whose padding is
within `padding` is taken, or the one with the least padding. Patterns then meet pieces by rank: the pieces before in
other tasks and the stored number give a piece's rank among its length, and slots of patterns are intervals of ranks. No
key stands for a length, so a length that a third of all pieces have is dealt like the others.

Defined cases: a null or empty text is its end token alone; strings of special tokens inside a text become what the library
makes of them; null, repeated ids and repeated rows are packed row by row; an empty table gives an empty table; columns
besides id and text are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .tokens import pieces

CAPACITY, END, PADDING = 2048, 1, 0.01
#: Ways to cut a rest: after multiples of these, most whole first.
WAYS = (2048, 1024, 512, 256)
#: Distinct pieces of text whose ids a worker remembers, bytes that go to the library at once, characters of texts encoded together.
REMEMBERED, JOINED_BYTES, RUN = 600_000, 40_000, 400_000
PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, way int, part int, place long"


#: The character that names a byte in byte-level vocabularies: itself if it shows, else the next free one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a tokenizers file. Texts are cut before single spaces between
    other characters, where no token of a byte-level tokenizer can cross; ids of these pieces are remembered. New pieces
    go to the library joined, and are told apart by the bytes that ids stand for.

    ranks, pattern: the same vocabulary as a rank file, for the library that merges ranks: new pieces in ASCII, where both
    libraries split alike, then go to that one, which is faster."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.known, self.merger = Tokenizer.from_file(path), {}, None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            names = self.library.get_vocab(with_added_tokens=False)
            if any(names.get("".join(map(ALPHABET.__getitem__, token))) != rank for token, rank in table.items()):
                raise ValueError(f"{ranks} is not the vocabulary of {path}")
            self.merger = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, "int64")
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # a character of a byte-level token is a byte

    def one(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        groups: dict[bool, list[list[str]]] = {False: [], True: []}
        sizes = dict.fromkeys(groups, JOINED_BYTES)
        for x in new:
            if len(x) < 2 or x[0] != " " or x[1].isspace() or x[-1].isspace() or len(x) > 1000:
                self.known[x] = self.one(x)
                continue
            plain = self.merger is not None and x.isascii() and "<|" not in x
            if sizes[plain] >= JOINED_BYTES:
                groups[plain].append([])
                sizes[plain] = 0
            groups[plain][-1].append(x)
            sizes[plain] += len(x)
        for plain, some in groups.items():
            texts = list(map("".join, some))
            if plain:
                found = [self.merger.encode_ordinary(x) for x in texts]
            else:
                found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            for group, ids in zip(some, found):
                self.keep(group, np.array(ids, "<u4"))

    def keep(self, group: list[str], ids: np.ndarray) -> None:
        """Cut the ids of joined pieces apart and remember them."""
        upto = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        ends = np.cumsum([*map(len, group)] if all(map(str.isascii, group)) else [len(x.encode()) for x in group])
        at = np.searchsorted(upto, ends)
        if at[-1] < len(upto) and (upto[at] == ends).all() and upto[-1] == ends[-1]:
            raw, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
            self.known.update(zip(group, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
        else:  # an id that stands for other bytes than its name says
            self.known.update((x, self.one(x)) for x in group)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the pieces that are new in any of them are learned together."""
        parts = [pieces(x) if x else [] for x in texts]
        every = set().union(*parts)
        new = every.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = every
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in parts]


def runs(texts: list[str], size: int) -> Iterator[list[str]]:
    """The texts in order, in runs of `size` characters or one text."""
    run: list[str] = []
    held = 0
    for x in texts:
        if run and held + len(x) > size:
            yield run
            run, held = [], 0
        run.append(x)
        held += len(x)
    if run:
        yield run


#: A worker's encoders by their files: kept from task to task.
ENCODERS: dict[tuple, Encoder] = {}


def encoder(*files: str | None) -> Encoder:
    if files not in ENCODERS:
        ENCODERS[files] = Encoder(*files)
    return ENCODERS[files]


def cuts(n: int, capacity: int, ways: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(start, end, way) of a document of n ids: full sequences (way -1), then its rest in every way."""
    full = n - n % capacity
    out = [(a, a + capacity, -1) for a in range(0, full, capacity)]
    if full < n:
        out += [(a, min(a + step, n), w) for w, step in enumerate(ways) for a in range(full, n, step)]
    return out


def encoded_pieces(docs: DataFrame, files: tuple, end: int, capacity: int, ways: tuple[int, ...]) -> DataFrame:
    """docs (doc_id, text) as pieces of all ways, numbered by way and length within their task."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(*files).encode, TaskContext.get().partitionId()
        seen: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                rows: list[tuple] = []
                coded = (x for run in runs([x or "" for x in some["text"].to_pylist()], RUN) for x in encode(run))
                for doc_id, ids in zip(some["doc_id"].to_pylist(), coded):
                    ids += tail
                    n = len(ids) // 4
                    for a, b, way in cuts(n, capacity, ways):
                        key = (way, b - a)
                        rows.append((doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n, way, part, seen[key]))
                        seen[key] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], NAMES)

    return docs.mapInArrow(run, PIECE)


NAMES = [f.split()[0] for f in PIECE.split(", ")]
KINDS = [pa.int64() if f.endswith("long") else pa.int32() for f in PIECE.split(", ")]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many packs, [(length, how many of it in each)]): lengths longest first, each into the shortest pack
    that holds it, a pack opened where none does. Packs of one pattern are one entry, so work grows with lengths, not pieces.
    """
    packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (fill, order, packs, pattern), the shortest on top
    order = 0

    def put(fill: int, many: int, pattern: list[tuple[int, int]]) -> None:
        nonlocal order
        order += 1
        heapq.heappush(packs, (fill, order, many, pattern))

    def grown(pattern: list[tuple[int, int]], length: int, times: int) -> list[tuple[int, int]]:
        if pattern and pattern[-1][0] == length:
            return [*pattern[:-1], (length, pattern[-1][1] + times)]
        return [*pattern, (length, times)]

    done: list[tuple[int, list[tuple[int, int]]]] = []
    shortest = min(histogram, default=0)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and packs and packs[0][0] + length <= capacity:
            fill, _, many, pattern = heapq.heappop(packs)
            if left < many:
                put(fill, many - left, pattern)
                many = times = left
                times = 1
            else:
                # several at once while these packs stay the shortest
                upto = min(packs[0][0] if packs else capacity, capacity - length)
                times = max(1, min((upto - fill) // length + 1, (capacity - fill) // length, left // many))
            left -= many * times
            put(fill + length * times, many, grown(pattern, length, times))
        fits = capacity // length
        for many, times in ((left // fits, fits), (1, left % fits)):
            if many and times:
                put(length * times, many, [(length, times)])
        while packs and packs[0][0] + shortest > capacity:
            done.append(heapq.heappop(packs)[2:])
    return done + [p[2:] for p in packs]


def padding_of(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> int:
    return sum(n * (capacity - sum(length * k for length, k in pattern)) for n, pattern in patterns)


def chosen(histograms: dict[int, dict[int, int]], full: int, ways: int, capacity: int, padding: float) -> tuple[int, list]:
    """The way with the fewest cuts whose padding is within the share, else that with the least, and its patterns."""
    best = None
    for way in range(ways):
        patterns = shortest_pack_first(histograms.get(way, {}), capacity)
        lost = padding_of(patterns, capacity) / max(capacity * (full + sum(n for n, _ in patterns)), 1)
        if best is None or lost < best[0]:
            best = lost, way, patterns
        if lost <= padding:
            break
    return best[1:]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]], first: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ascending: ranks from the first on, until the next row of the
    length, go to consecutive sequences at the offset. Sequences are numbered from `first`."""
    used: dict[int, int] = defaultdict(int)
    out = []
    for many, pattern in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                out.append((length, used[length], first, offset))
                used[length] += many
                offset += length
        first += many
    return np.array(sorted(out), "int64").reshape(-1, 4)


def pack_by_histogram(
    docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", *,
    end: int = END, capacity: int = CAPACITY, ways: tuple[int, ...] = WAYS, padding: float = PADDING,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. path: a tokenizers .json file
    that the executors can read (ranks, pattern: see Encoder); sequences hold `capacity` ids at most."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = keep(encoded_pieces(rows, (path, ranks, pattern), end, capacity, ways), "pack-pieces")
    counted = keep(made.groupBy("way", "part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counted.groupBy("way", "length").agg(F.sum("n").alias("n")).collect():  # at most (ways + 1) * capacity rows
        histograms[r["way"]][r["length"]] = r["n"]
    full = sum(histograms.pop(-1, {}).values())
    way, patterns = chosen(histograms, full, len(ways), capacity, padding)
    table = slots(patterns, full)
    placed = spark.sparkContext.broadcast((table[:, 0] << 48 | table[:, 1], table))  # slots: as many as patterns hold
    w = Window.partitionBy("way", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("way").isin(-1, way)
    before = counted.where(mine).select("way", "part", "length", (F.sum("n").over(w) - F.col("n")).alias("before"))
    ranked = made.where(mine).join(before, ["way", "part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "way", (F.col("before") + F.col("place")).alias("rank"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = placed.value
        for batch in batches:
            length, rank, kind = (batch[c].to_numpy().astype("int64") for c in ("length", "rank", "way"))
            sequence, offset = rank.copy(), np.zeros(len(rank), "int64")
            rest = kind >= 0
            if rest.any():
                at = np.searchsorted(keys, length[rest] << 48 | rank[rest], side="right") - 1
                sequence[rest] = table[at, 2] + rank[rest] - table[at, 1]
                offset[rest] = table[at, 3]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(length), batch["ids_crc32"], batch["doc_tokens"], pa.array(sequence), pa.array(offset)], LAID_NAMES)

    return ranked.mapInArrow(lay, LAID)


LAID = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LAID_NAMES = [f.split()[0] for f in LAID.split(", ")]
