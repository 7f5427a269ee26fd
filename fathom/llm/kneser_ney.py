"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark.

Counting works on sorted arrays instead of a row per n-gram: a task counts the
n-grams of a stretch of documents, sorts them, cuts them by bucket and sends each
bucket one compressed piece; a bucket's pieces are merged, and the sorted
arrays are written to the shared folder.  Scoring tasks memory-map those arrays
and look up the distinct n-grams of a batch in them.

* words: 64-bit hashes, sorted, with counts and numbers of distinct words before
  them; a word's id is its place in that order;
* trigrams: the three ids in one number, the middle one first, which makes those
  of a context neighbours, with counts; bucketed by the middle word, so that
  the trigrams of a context and those that end alike share a bucket;
* bigrams: ``id before << 32 | id``, sorted, with counts (of order 3: numbers of
  distinct words before them); bucketed by the first word.

A count takes the lowest four bits of its n-gram's number, if they are free, and what
a context has been followed by is summed from its n-grams when it is asked for.

Where a word is so frequent that its n-grams would make an uneven bucket, both words
of a bigram, and the first two of a trigram, deal it.  Everything kept for the
whole corpus is in those files; the driver holds sizes of buckets, sums, and the
few frequent words.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import shared_files
from fathom.llm.common import new_folder, prepare, stored, text_bytes

#: Words of the longest n-grams.
ORDER = 3
#: The end token; no word holds a line end.
END = b"\n"
#: Words that a counting task holds before it sends them on, and bigrams.
HELD_WORDS = 400_000
HELD_TOKENS = 2_000_000
#: Tokens that are scored together, but for a single longer text.
SCORED_TOKENS = 1_000_000
MEMO_WORDS = 300_000
#: Contexts with more followers than this are remembered by a scoring task.
LONG_CONTEXT = 64
#: A word is frequent if it makes up more than 1/(this * buckets) of all tokens.
FREQUENT = 4

Batches = Iterator[pa.RecordBatch]


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # lower() on bytes changes A-Z only


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A bucket for each number, the same for equal ones."""
    with np.errstate(over="ignore"):
        y = x.astype(np.uint64)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        y = (y ^ (y >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (y >> np.uint64(64 - bits)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


#: Keys that don't fit into 64 bits: what a context is told by, and the last word.
WIDE = np.dtype([("context", "<u8"), ("word", "<u8")])


def sorted_by(bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if keys.dtype == WIDE:
        return np.lexsort((keys["word"], keys["context"], bucket))
    order = np.argsort(keys)
    return order[dealt(bucket[order])]


def dealt(bucket: np.ndarray) -> np.ndarray:
    """Places by bucket, else as they are; few buckets are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")


def pieces(bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: its keys in order, as steps, and their counts."""
    order = sorted_by(bucket, keys)
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)]
    spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    if keys.dtype == WIDE:
        high, low = keys["context"], keys["word"]
    else:
        high, low = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
            pa.array([pack(np.diff(high[a:b], prepend=high.dtype.type(0))) for a, b in spans], pa.binary()),
            pa.array([pack(low[a:b]) for a, b in spans], pa.binary()),
            pa.array([pack(counts[a:b].astype(np.uint32)) for a, b in spans], pa.binary()),
        ],
        ["bucket", "high", "low", "counts"],
    )


PIECES = "bucket int, high binary, low binary, counts binary"


def piece_keys(row: dict, wide: bool) -> np.ndarray:
    kind = np.uint64 if wide else np.uint32
    high = np.cumsum(unpack(row["high"], kind), dtype=kind)
    low = unpack(row["low"], kind)
    if not wide:
        return high.astype(np.uint64) << np.uint64(32) | low
    keys = np.empty(len(low), WIDE)
    keys["context"], keys["word"] = high, low
    return keys


def merged(rows: Iterator[dict], wide: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts) of pieces that come sorted by bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def joined():
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([c for _, c in held]).astype(np.int64)
        order = np.lexsort((keys["word"], keys["context"])) if wide else np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return now, keys[first], np.add.reduceat(counts, first)

    for row in rows:
        if row["bucket"] != now:
            if held:
                yield joined()
            now, held = row["bucket"], []
        held.append((piece_keys(row, wide), unpack(row["counts"], np.uint32)))
    if held:
        yield joined()


def rows_of(batches: Batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


#: Bits of a count beside its key; larger counts stand in a list of their own.
COUNT_BITS = 4


def with_counts(keys: np.ndarray, counts: np.ndarray, room: bool) -> list[np.ndarray]:
    """The arrays of a :class:`Table`; with ``room`` the keys' highest COUNT_BITS are 0."""
    most = (1 << COUNT_BITS) - 1 if room else 255
    over = np.flatnonzero(counts >= most)
    small = np.minimum(counts, most)
    beside = np.zeros(0, np.uint8) if room else small.astype(np.uint8)
    own = keys << np.uint64(COUNT_BITS) | small.astype(np.uint64) if room else keys
    return [own, beside, over.astype(np.uint32), counts[over].astype(np.int64)]


class Table:
    """Sorted keys with counts."""

    def __init__(self, own: np.ndarray, beside: np.ndarray, over: np.ndarray, values: np.ndarray) -> None:
        self.own, self.beside, self.over, self.values = own, beside, over, values
        self.room = len(own) > len(beside)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys stand or would stand."""
        return np.searchsorted(self.own, keys << np.uint64(COUNT_BITS) if self.room else keys)

    def counts(self, at: np.ndarray) -> np.ndarray:
        most = (1 << COUNT_BITS) - 1 if self.room else 255
        found = (self.own[at] & np.uint64(most) if self.room else self.beside[at]).astype(np.int64)
        large = np.flatnonzero(found == most)
        if len(large):
            found[large] = self.values[np.searchsorted(self.over, at[large])]
        return found

    def count_of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys, 0 of those that aren't there."""
        at = np.minimum(self.places(keys), len(self.own) - 1)
        there = self.own[at] >> np.uint64(COUNT_BITS) if self.room else self.own[at]
        return np.where(there == keys, self.counts(at), 0)

    def summed(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of spans of keys, none of them empty: the sum of their counts, and how many are
        1, 2, more."""
        n = high - low
        firsts = np.cumsum(n) - n
        c = self.counts(np.arange(n.sum()) + np.repeat(low - firsts, n))
        total, ones, twos = (np.add.reduceat(x, firsts, dtype=np.int64) for x in (c, c == 1, c == 2))
        return np.stack((total, ones, twos, n - ones - twos), axis=1)

    def followed(self, low: np.ndarray, high: np.ndarray, seen: Memory, slot: Hashable, names: np.ndarray) -> np.ndarray:
        """Of spans of keys, some empty, what :meth:`summed` gives.  Long spans are
        remembered in ``seen`` by slot and the numbers ``names``."""
        found = np.zeros((len(low), 4), np.int64)
        length = high - low
        short = np.flatnonzero((length > 0) & (length <= LONG_CONTEXT))
        if len(short):
            found[short] = self.summed(low[short], high[short])
        long = np.flatnonzero(length > LONG_CONTEXT)
        if len(long):
            hit, told = seen.get(slot, names[long])
            found[long[hit]] = told
            new = long[~hit]
            # A stretch of spans at a time, as a context may have any number of followers.
            for part in np.split(new, np.flatnonzero(np.diff(np.cumsum(length[new]) // HELD_TOKENS)) + 1):
                if len(part):
                    found[part] = self.summed(low[part], high[part])
            seen.put(slot, names[new], found[new])
        return found


class Memory:
    """Rows of four numbers by slot and number, MEMO_WORDS of them at most."""

    def __init__(self) -> None:
        self.held: dict[Hashable, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def get(self, slot: Hashable, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which names are known, and the rows of these."""
        if slot not in self.held:
            return np.zeros(len(names), bool), np.zeros((0, 4), np.int64)
        known, rows = self.held[slot]
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        hit = known[at] == names
        return hit, rows[at[hit]]

    def put(self, slot: Hashable, names: np.ndarray, rows: np.ndarray) -> None:
        if not len(names):
            return
        if self.size + len(names) > MEMO_WORDS:
            self.held, self.size = {}, 0
        names, once = np.unique(names, return_index=True)
        known, old = self.held.get(slot, (names[:0], rows[:0]))
        every = np.concatenate((known, names))
        order = np.argsort(every)
        self.held[slot] = every[order], np.concatenate((old, rows[once]))[order]
        self.size += len(names)


def by_bucket(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


class Sharded:
    """Sorted keys in buckets and arrays beside them, memory-mapped when used."""

    def __init__(self, shelf: shared_files.Shelf, name: str, sizes: dict[int, int]) -> None:
        self.shelf, self.name, self.sizes = shelf, name, sizes

    def arrays(self, bucket: int) -> list[np.ndarray]:
        return self.shelf(f"{self.name}-{bucket}")

    def by_bucket(self, buckets: np.ndarray, keys: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket that there is and the places of what is asked of it, in order of
        ``keys``, or, without these, as it stands."""
        order = dealt(buckets) if keys is None else sorted_by(buckets, keys)
        ranked = buckets[order]
        cuts = [0, *(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1).tolist(), len(ranked)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a and int(ranked[a]) in self.sizes:
                yield int(ranked[a]), order[a:b]

    def table(self, bucket: int) -> Table:
        return Table(*self.arrays(bucket))

    def find(self, buckets: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """For each bucket asked for: (bucket, which of ``keys`` were found, their
        places in the bucket, the bucket's other arrays)."""
        for bucket, asked in self.by_bucket(buckets, keys):
            own, *rest = self.arrays(bucket)
            at = np.minimum(np.searchsorted(own, keys[asked]), len(own) - 1)
            hit = own[at] == keys[asked]
            yield bucket, asked[hit], at[hit], rest


class Triples:
    """Keys and buckets of trigrams of ids.

    A key has the middle word's number in its bucket (frequent words, whose trigrams
    are dealt to all buckets, have numbers beyond those), the first id, the last id:
    in 64 bits if they fit, which they do up to some 30 million words, else in 128.
    """

    def __init__(self, bits: int, sizes: dict[int, int], starts: dict[int, int], n_words: int, frequent: np.ndarray) -> None:
        self.bits, self.frequent = bits, frequent
        self.firsts, self.homes = np.array([*starts.values()] or [0], np.int64), np.array([*starts] or [0], np.int64)
        self.start_of = np.zeros(1 << bits, np.int64)
        self.start_of[self.homes] = self.firsts
        self.largest = max([1, *sizes.values()])
        self.width = max(1, n_words.bit_length())
        middle = (self.largest + len(frequent)).bit_length()
        if middle + self.width > 64:
            raise ValueError("too many words for a trigram's context to fit 64 bits: use more partitions")
        self.wide = middle + 2 * self.width > 64
        self.room = middle + 2 * self.width + COUNT_BITS <= 64

    def contexts(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, and what the first two words are told by in them."""
        home = np.searchsorted(self.firsts, two, side="right") - 1
        rank = np.minimum(np.searchsorted(self.frequent, two), len(self.frequent) - 1)
        often = self.frequent[rank] == two
        code = np.where(often, self.largest + rank, two - self.firsts[home]).astype(np.uint64)
        both = one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64)
        bucket = np.where(often, spread(both, self.bits), self.homes[home])
        return bucket, code << np.uint64(self.width) | one.astype(np.uint64)

    def keys(self, context: np.ndarray, three: np.ndarray) -> np.ndarray:
        if not self.wide:
            return context << np.uint64(self.width) | three.astype(np.uint64)
        keys = np.empty(len(context), WIDE)
        keys["context"], keys["word"] = context, three
        return keys

    def parts(self, bucket: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, middle words and last words of a bucket's keys."""
        mask = np.uint64((1 << self.width) - 1)
        context, three = (keys["context"], keys["word"]) if self.wide else (keys >> np.uint64(self.width), keys & mask)
        code = (context >> np.uint64(self.width)).astype(np.int64)
        often = code >= self.largest
        two = np.where(often, self.frequent[np.where(often, code - self.largest, 0)], code + self.start_of[bucket])
        return context, two, three.astype(np.int64)

    def spans(self, table: Table, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a bucket's trigrams with these contexts begin and end."""
        none = np.zeros(len(context), np.int64)
        return tuple(table.places(self.keys(context + np.uint64(k), none)) for k in (0, 1))


@dataclass
class Model:
    """What scoring needs besides the files; sizes are bounded by the buckets."""

    order: int
    folder: str
    bits: int
    word_sizes: dict[int, int]
    starts: dict[int, int]
    triple_sizes: dict[int, int]
    pair_sizes: dict[int, int]
    frequent: dict[int, tuple[int, int, int, int]]
    #: The words, and the place before a text, whose n-grams are dealt to all buckets.
    dealt: np.ndarray
    n_tokens: int
    n_words: int
    triple_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_total: int
    word_rest: float

    @property
    def begin(self) -> int:
        """The id of the place before a text's first word."""
        return self.n_words

class Known(dict):
    """Ids of words; one that isn't there gets a number from -2 down, in the order of ``new``."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = found = -1 - len(self.new)
        return found


class Words:
    """Ids of words, by way of the memory-mapped vocabulary."""

    def __init__(self, shelf: shared_files.Shelf, bits: int, sizes: dict[int, int], starts: dict[int, int]) -> None:
        self.shards = Sharded(shelf, "word", sizes)
        self.bits, self.starts = bits, starts
        self.memo = Known()

    def look_up(self, words: list[bytes]) -> np.ndarray:
        keys = hashed(words)
        ids = np.full(len(keys), -1, np.int64)
        for bucket, asked, at, _ in self.shards.find((keys >> np.uint64(64 - self.bits)).astype(np.int64), keys):
            ids[asked] = at + self.starts[bucket]
        return ids

    def sequence(self, documents: list[list[bytes]], begin: int, begins: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ids of [begin, ..., words, end] of all documents in a line, -1 for words not
        in the vocabulary; and where each document starts."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = Known()
        lengths = np.fromiter(map(len, documents), np.int64, len(documents)) + begins + 1
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        line = np.full(int(lengths.sum()), begin, np.int64)
        inner = np.ones(len(line), bool)
        for k in range(begins):
            inner[starts + k] = False
        inner[starts + lengths - 1] = False
        words = chain.from_iterable(documents)
        line[inner] = np.fromiter(map(self.memo.__getitem__, words), np.int64, int(lengths.sum()) - (begins + 1) * len(lengths))
        line[starts + lengths - 1] = self.memo[END]
        new = self.memo.new
        if new:
            ids = self.look_up(new)
            at = np.flatnonzero(line < -1)
            line[at] = ids[-2 - line[at]]
            self.memo.update(zip(new, ids.tolist(), strict=True))
            self.memo.new = []
        return line, starts


def _count_words(bits: int):
    def run(batches: Batches) -> Batches:
        gc.disable()
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            keys = hashed(list(held))
            counts = np.fromiter(held.values(), np.int64, len(held))
            return pieces((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)

        for batch in batches:
            for text in text_bytes(batch.column("text")):
                held.update(tokens_of(text))
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield sent()
                    held = Counter()
        if held:
            yield sent()

    return run


def _write_words(folder: str):
    def run(batches: Batches) -> Batches:
        for bucket, keys, counts in merged(rows_of(batches)):
            kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64
            shared_files.write(folder, f"word-{bucket}", keys, counts.astype(kind))
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "size": [len(keys)], "tokens": [int(counts.sum())]})

    return run


def _frequent_words(folder: str, starts: dict[int, int], over: float):
    def run(batches: Batches) -> Batches:
        shelf = shared_files.Shelf(folder)
        for batch in batches:
            for bucket in batch.column("bucket").to_pylist():
                counts = shelf(f"word-{bucket}")[1]
                yield pa.RecordBatch.from_pydict({"id": np.flatnonzero(counts > over) + starts[bucket]})

    return run


def pair_bucket(pairs: np.ndarray, before: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    return np.where(np.isin(before, frequent), spread(pairs, bits), spread(before, bits))


def _count_grams(order: int, folder: str, bits: int, sizes: dict, starts: dict, begin: int, frequent: np.ndarray):
    triples = Triples(bits, sizes, starts, begin, frequent)

    def run(batches: Batches) -> Batches:
        gc.disable()
        words = Words(shared_files.Shelf(folder), bits, sizes, starts)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            bucket, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            order_ = sorted_by(bucket, keys)
            bucket, keys = bucket[order_], keys[order_]
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])])
            return pieces(bucket[first], keys[first], np.diff(np.r_[first, len(keys)]))

        for batch in batches:
            documents = [tokens_of(x) for x in text_bytes(batch.column("text"))]
            if not documents:
                continue
            line, _ = words.sequence(documents, begin, order - 1)
            now = np.flatnonzero(line != begin)
            if order == 2:
                pairs = line[now - 1].astype(np.uint64) << np.uint64(32) | line[now].astype(np.uint64)
                held.append((pair_bucket(pairs, line[now - 1], frequent, bits).astype(np.int32), pairs))
            else:
                bucket, context = triples.contexts(line[now - 2], line[now - 1])
                held.append((bucket.astype(np.int32), triples.keys(context, line[now])))
            if sum(len(k) for _, k in held) > HELD_TOKENS:
                yield sent()
                held = []
        if held:
            yield sent()

    return run


def tallied(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and 3 or more."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]


STATS = "kind string, bucket int, size long, n1 long, n2 long, n3 long, n4 long, more long, high binary, low binary, counts binary"
ARROW_STATS = pa.schema(
    [("kind", pa.string()), ("bucket", pa.int32())]
    + [(n, pa.int64()) for n in ("size", "n1", "n2", "n3", "n4", "more")]
    + [(n, pa.binary()) for n in ("high", "low", "counts")]
)


def _stats_row(kind: str, bucket: int, size: int, sums=(0, 0, 0, 0, 0), piece=(None, None, None)) -> dict:
    return dict(zip(ARROW_STATS.names, (kind, bucket, size, *sums, *piece), strict=True))


def _piece_rows(kind: str, sent: pa.RecordBatch) -> list[dict]:
    return [_stats_row(kind, r["bucket"], 0, piece=(r["high"], r["low"], r["counts"])) for r in sent.to_pylist()]


def _write_triples(folder: str, triples: Triples):
    """Write the trigrams, and send each bigram that ends one with how many distinct
    words stand before it there."""

    def run(batches: Batches) -> Batches:
        gc.disable()
        for bucket, keys, counts in merged(rows_of(batches), triples.wide):
            shared_files.write(folder, f"triple-{bucket}", *with_counts(keys, counts, triples.room))
            _, two, three = triples.parts(bucket, keys)
            ends, times = np.unique(two.astype(np.uint64) << np.uint64(32) | three.astype(np.uint64), return_counts=True)
            home = pair_bucket(ends, (ends >> np.uint64(32)).astype(np.int64), triples.frequent, triples.bits)
            rows = [_stats_row("triples", bucket, len(keys), tallied(counts)), *_piece_rows("piece", pieces(home, ends, times))]
            yield pa.RecordBatch.from_pylist(rows, ARROW_STATS)

    return run


def _write_pairs(folder: str, frequent: np.ndarray, word_starts: list[int], word_buckets: list[int], n_words: int):
    room = n_words < 1 << (32 - COUNT_BITS)

    def run(batches: Batches) -> Batches:
        gc.disable()
        passed: list[dict] = []

        def sifted() -> Iterator[dict]:
            for row in rows_of(batches):
                if row["kind"] == "piece":
                    yield row
                else:
                    passed.append(row)

        for bucket, pairs, counts in merged(sifted()):
            rows = [_stats_row("pairs", bucket, len(pairs), tallied(counts))]
            before = (pairs >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
            of = np.stack(
                [np.add.reduceat(x, first) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1
            ).astype(np.int64)
            context = before[first]
            often = np.isin(context, frequent)
            for c, x in zip(context[often].tolist(), of[often].tolist(), strict=True):
                rows.append(_stats_row("frequent", 0, c, (*x, 0)))
            shared_files.write(folder, f"pair-{bucket}", *with_counts(pairs, counts, room))
            # Each bigram is one distinct word before its second word.
            after, times = np.unique(pairs & np.uint64(0xFFFFFFFF), return_counts=True)
            home = np.searchsorted(word_starts, after.astype(np.int64), side="right") - 1
            rows += _piece_rows("before", pieces(np.array(word_buckets)[home], after, times))
            yield pa.RecordBatch.from_pylist(rows, ARROW_STATS)
        yield pa.RecordBatch.from_pylist(passed, ARROW_STATS)

    return run


def _write_before(folder: str, sizes: dict[int, int], starts: dict[int, int]):
    """Write how many distinct words stand before each word; other rows pass."""

    def run(batches: Batches) -> Batches:
        passed: list[dict] = []

        def sifted() -> Iterator[dict]:
            for row in rows_of(batches):
                if row["kind"] == "before":
                    yield row
                else:
                    passed.append(row)

        for bucket, ids, counts in merged(sifted()):
            dense = np.zeros(sizes[bucket], np.uint32)
            dense[ids.astype(np.int64) - starts[bucket]] = counts
            shared_files.write(folder, f"before-{bucket}", dense)
            passed.append(_stats_row("words", bucket, int(counts.sum()), tallied(counts)))
        yield pa.RecordBatch.from_pylist(passed, ARROW_STATS)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more.  Where a small corpus has
    no n-grams of some count, that discount is half of its count at most."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    pairs = ((n1, n2), (n2, n3), (n3, n4))
    found = [k - (k + 1) * y * b / a if a else k / 2 for k, (a, b) in enumerate(pairs, 1)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count ``docs`` (needs ``text``; null is empty) into a model in the shared
    folder.  Other columns play no part, repeated rows count each time.  An empty
    table gives a model that knows no words."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = prepare(docs.sparkSession)
    folder = new_folder(spark, "kneser-ney")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (parts - 1).bit_length())
    text = docs.select(F.col("text").cast("string").alias("text"))

    words = by_bucket(text.mapInArrow(_count_words(bits), PIECES))
    sized = words.mapInArrow(_write_words(folder), "bucket long, size long, tokens long").collect()  # a row per bucket
    sizes = {r.bucket: r.size for r in sorted(sized)}
    starts, n_words = {}, 0
    for bucket, size in sizes.items():
        starts[bucket], n_words = n_words, n_words + size
    n_tokens = sum(r.tokens for r in sized)
    if n_words >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: ids no longer fit half a key")

    over = n_tokens / (FREQUENT << bits)
    frequent = _collect_frequent(spark, folder, sizes, starts, over)
    frequent = np.array(sorted([*frequent, n_words]), np.int64)  # and the place before a text

    counted = by_bucket(text.mapInArrow(_count_grams(order, folder, bits, sizes, starts, n_words, frequent), PIECES))
    if order == 3:
        triples = Triples(bits, sizes, starts, n_words, frequent)
        sent = by_bucket(counted.mapInArrow(_write_triples(folder, triples), STATS))
    else:
        sent = counted.withColumn("kind", F.lit("piece"))
    paired = by_bucket(sent.mapInArrow(_write_pairs(folder, frequent, list(starts.values()), list(starts), n_words), STATS))
    # What is left are a row per bucket and kind, and per bucket and frequent word.
    stats = stored(paired.mapInArrow(_write_before(folder, sizes, starts), STATS).drop("high", "low", "counts"))
    names = ("n1", "n2", "n3", "n4")
    totals = stats.groupBy("kind").agg(*(F.sum(n).alias(n) for n in (*names, "more", "size")))
    sums = {r.kind: tuple(r)[1:] for r in totals.collect()}
    by_size = stats.filter("kind in ('triples', 'pairs')").select("kind", "bucket", "size").collect()
    often = stats.filter("kind = 'frequent'").groupBy("size").agg(*(F.sum(n).alias(n) for n in names))
    c = sums.get("words", (0,) * 6)
    word_discounts = discounts(*c[:4])
    rest = (word_discounts[0] * c[0] + word_discounts[1] * c[1] + word_discounts[2] * c[4]) / c[5] if c[5] else 1.0
    none = (0, 0, 0, 0)
    return Model(
        order=order,
        folder=folder,
        bits=bits,
        word_sizes=sizes,
        starts=starts,
        triple_sizes={r.bucket: r.size for r in by_size if r.kind == "triples"},
        pair_sizes={r.bucket: r.size for r in by_size if r.kind == "pairs"},
        frequent={r["size"]: tuple(r)[1:] for r in often.collect()},
        dealt=frequent,
        n_tokens=n_tokens,
        n_words=n_words,
        triple_discounts=discounts(*sums.get("triples", none)[:4]),
        pair_discounts=discounts(*sums.get("pairs", none)[:4]),
        word_discounts=word_discounts,
        word_total=c[5],
        word_rest=rest,
    )


def _collect_frequent(spark: SparkSession, folder: str, sizes: dict, starts: dict, over: float) -> list[int]:
    """Ids of words counted more than ``over`` times: at most FREQUENT per bucket."""
    if not sizes:
        return []
    buckets = spark.createDataFrame([(b,) for b in sizes], "bucket int").repartition(max(1, len(sizes) // 4))
    return [r.id for r in buckets.mapInArrow(_frequent_words(folder, starts, over), "id long").collect()]


def taken_off(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3)], 0.0)


def _score(model: Model):
    names = ("n_tokens", "n_known", "base_score", "score")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        shelf = shared_files.Shelf(model.folder)
        words = Words(shelf, model.bits, model.word_sizes, model.starts)
        triple_shards = Sharded(shelf, "triple", model.triple_sizes)
        pair_shards = Sharded(shelf, "pair", model.pair_sizes)
        frequent = model.dealt
        triples = Triples(model.bits, model.word_sizes, model.starts, model.n_words, model.dealt)
        firsts = np.array(list(model.starts.values()), np.int64)
        homes = list(model.starts)
        long_contexts = Memory()

        def of_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Counts, and probabilities without context, of sorted ids; 0 for -1."""
            counts, befores = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            home = np.searchsorted(firsts, ids, side="right") - 1
            for h in np.unique(home[ids >= 0]).tolist():
                own = (home == h) & (ids >= 0)
                count, (before,) = shelf(f"word-{homes[h]}")[1], shelf(f"before-{homes[h]}")
                counts[own], befores[own] = count[ids[own] - firsts[h]], before[ids[own] - firsts[h]]
            known = taken_off(befores, model.word_discounts) / max(1, model.word_total)
            return counts, known + model.word_rest / (model.n_words + 1)

        def of_contexts(ids: np.ndarray) -> np.ndarray:
            """Total and followers seen once, twice, more often; zeros if unknown."""
            found = np.zeros((len(ids), 4), np.int64)
            for i in np.flatnonzero(np.isin(ids, frequent)).tolist():
                found[i] = model.frequent.get(int(ids[i]), (0, 0, 0, 0))
            rest = np.flatnonzero((ids >= 0) & ~np.isin(ids, frequent))
            keys = ids[rest].astype(np.uint64) << np.uint64(32)  # in order, as ids are
            for b, asked in pair_shards.by_bucket(spread(ids[rest], model.bits), None):
                table, own = pair_shards.table(b), ids[rest[asked]]
                low, high = table.places(keys[asked]), table.places(keys[asked] + np.uint64(1 << 32))
                found[rest[asked]] = table.followed(low, high, long_contexts, ("pair", b), own)
            return found

        def shares(contexts: np.ndarray, by: tuple) -> tuple[np.ndarray, np.ndarray]:
            """Contexts' totals, 1 at least, and what is left to the order below."""
            total, *n = contexts.T
            most = np.maximum(total, 1)
            return most, np.where(total > 0, (n[0] * by[0] + n[1] * by[1] + n[2] * by[2]) / most, 1.0)

        def with_context(below: np.ndarray, seen: np.ndarray, total: np.ndarray, back: np.ndarray, by: tuple) -> np.ndarray:
            """Probabilities from those of the order below, counts, and their contexts' shares."""
            return taken_off(seen, by) / total + back * below

        def third(below: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
            there = np.flatnonzero((one >= 0) & (two >= 0))
            bucket, context = triples.contexts(one[there], two[there])
            last = three[there]
            keys = triples.keys(context, np.maximum(last, 0))
            total, back, seen = np.ones(len(below), np.int64), np.ones(len(below)), np.zeros(len(below), np.int64)

            def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Of numbers in order: each once, and which one every place has."""
                first = np.r_[True, x[1:] != x[:-1]][: len(x)]
                return x[first], np.cumsum(first) - 1

            for b, asked in triple_shards.by_bucket(bucket, keys):  # by keys, so by contexts
                table = triple_shards.table(b)
                distinct, which = runs(context[asked])
                low, high = triples.spans(table, distinct)
                at = there[asked]
                for every, x in zip((total, back), shares(table.followed(low, high, long_contexts, b, distinct), model.triple_discounts), strict=True):
                    every[at] = x[which]
                known = asked[last[asked] >= 0]
                own, which = runs(keys[known])
                seen[there[known]] = table.count_of(own)[which]
            return with_context(below, seen, total, back, model.triple_discounts)

        def scored(documents: list[list[bytes]]) -> tuple[np.ndarray, ...]:
            begins = model.order - 1
            line, starts = words.sequence(documents, model.begin, begins)
            inside = np.ones(len(line), bool)
            for k in range(begins):
                inside[starts + k] = False
            places = np.flatnonzero(inside)
            before, now = line[places - 1], line[places]
            starts = starts - begins * np.arange(len(starts))  # in ``now``

            ids, which = np.unique(now, return_inverse=True)
            counts, alone = of_words(ids)
            # What stands before a token is the one before it, or the place before the text.
            which_context = np.r_[0, which[:-1]]
            which_context[starts] = len(ids)
            total, back = (x[which_context] for x in shares(of_contexts(np.r_[ids, model.begin]), model.pair_discounts))
            known = (before >= 0) & (now >= 0)
            keys = before[known].astype(np.uint64) << np.uint64(32) | now[known].astype(np.uint64)
            pairs, which_pair = np.unique(keys, return_inverse=True)
            seen = np.zeros(len(pairs), np.int64)
            firsts_of = (pairs >> np.uint64(32)).astype(np.int64)
            for b, asked in pair_shards.by_bucket(pair_bucket(pairs, firsts_of, model.dealt, model.bits), None):
                seen[asked] = pair_shards.table(b).count_of(pairs[asked])

            c = np.zeros(len(now), np.int64)
            c[known] = seen[which_pair]
            p = with_context(alone[which], c, total, back, model.pair_discounts)
            if model.order == 3:
                p = third(p, line[places - 2], before, now)
            base = np.log10((counts + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1)))[which]
            return (
                np.diff(np.r_[starts, len(now)]),
                np.add.reduceat((counts > 0)[which].astype(np.int64), starts),
                np.add.reduceat(base, starts),
                np.add.reduceat(np.log10(p), starts),
            )

        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        for column in batches:
            parts, held, n = [empty], [], 0
            for text in text_bytes(column):
                held.append(tokens_of(text))
                n += len(held[-1]) + 1
                if n >= SCORED_TOKENS:
                    parts.append(scored(held))
                    held, n = [], 0
            if held:
                parts.append(scored(held))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def score(docs: DataFrame, model: Model, into: str = "lm") -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced if there): n_tokens,
    n_known, base_score and score, the model's log10 probability of the text.

    Needs ``text``; null and empty texts consist of the end token.  Rows stand
    alone, other columns pass untouched, an empty table gives none.  Perplexity
    is ``pow(10, -score / n_tokens)``.
    """
    prepare(docs.sparkSession)
    kind = "n_tokens long, n_known long, base_score double, score double"
    return docs.withColumn(into, F.arrow_udf(_score(model), kind).asNondeterministic()(F.col("text").cast("string")))
