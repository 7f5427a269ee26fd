"""Byte-level BPE by merge replay over the corpus's distinct words.

The words (pre-tokens) of all documents are gathered once each, dealt by their hash,
and every part of them is replayed: an inverted index holds, for each token that
two neighbours can merge into, the positions of such pairs in the part's words;
the merges are applied in rank order, each touches only its positions and looks up
only the two new neighbour pairs, so a word costs n log n, whatever its length.
The ids go to sorted hash arrays in the shared folder, which the tasks that
encode documents memory-map: a document is the concatenation of its words' ids.

Words are independent of one another, so they may be dealt anyhow.  What is shuffled
is each task's distinct words.  A part's words are replayed in blocks of
``BLOCK_CHARS``, and what a worker remembers is bounded by ``MEMO_UNITS`` and
``MEMO_CHARS``; forgetting costs time only.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import shared_files
from fathom.llm.common import new_folder, prepare, texts
from fathom.llm.pretokens import UNITS, load_ranks, splitter

MEMO_UNITS = 250_000
#: Words that a gathering task holds before it sends them on, and their characters.
HELD_WORDS = 400_000
HELD_CHARS = 16 << 20
#: Characters of words replayed together, and of documents encoded together, but for
#: a single longer one.
BLOCK_CHARS = 4 << 20
#: Longer units are looked up anew each time.
MEMO_CHARS = 64


class Merges:
    """Pairs of tokens that merge, and the token (its id is its rank) they give.

    A token can arise from any two tokens whose bytes make it up.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {
            ranks[t[:k]] << 32 | ranks[t[k:]]: r
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        #: Ranks sort faster in the narrowest type that holds them.
        self.rank_type = np.uint16 if max(ranks.values()) < 1 << 16 else np.int64

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the tokens merge into, -1 if they don't (or if one is no token)."""
        key = (a.astype(np.int64) << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def one(self, word: bytes) -> list[int]:
        """A single word, lowest rank first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
            at = found.index(min(found))
            if found[at] == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word, as packed 32-bit integers: every merge applied to all
    words, in rank order."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    at = np.arange(1, len(word_of) + 1, dtype=np.int32) + word_of
    # The symbols of all words in one line; -1 stands between words, -2 where a
    # symbol has gone into its left neighbour.
    symbols = np.full(len(word_of) + len(words) + 1, -1, np.int32)
    symbols[at] = merges.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    after = np.arange(1, len(symbols) + 1, dtype=np.int32)
    before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
    index: dict[int, list[np.ndarray]] = {}  # rank of the merge -> where its pairs stand
    waiting: list[int] = []
    hard: list[np.ndarray] = []

    def enter(places: np.ndarray, now: int) -> None:
        ranks = merges.of(symbols[places], symbols[after[places]])
        found = ranks >= 0
        ranks, places = ranks[found], places[found]
        if not len(ranks):
            return
        order = np.argsort(ranks.astype(merges.rank_type), kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        firsts = ranks[cuts[:-1]].tolist()
        if firsts[0] < now:
            hard.append(places[ranks < now])
        for r, a, b in zip(firsts, cuts, cuts[1:], strict=False):
            if r in index:
                index[r].append(places[a:b])
            else:
                index[r] = [places[a:b]]
                heappush(waiting, r)

    enter(at, -1)
    while waiting:
        rank = heappop(waiting)
        chunks = index.pop(rank)
        left = chunks[0] if len(chunks) == 1 else np.unique(np.concatenate(chunks))
        right = after[left]
        still = merges.of(symbols[left], symbols[right]) == rank
        left, right = left[still], right[still]
        if len(left) > 1 and (linked := right[:-1] == left[1:]).any():
            # Overlapping pairs, as in "aaa": of each run the 1st, 3rd, ... merge.
            k = np.arange(len(left))
            begin = np.maximum.accumulate(np.where(np.r_[True, ~linked], k, 0))
            take = (k - begin) % 2 == 0
            left, right = left[take], right[take]
        if not len(left):
            continue
        end = after[right]
        symbols[left], symbols[right] = rank, -2
        after[left] = end
        before[end] = left
        enter(np.concatenate((before[left], left)), rank)

    alive = np.flatnonzero(symbols >= 0)
    ids = symbols[alive].tobytes()
    owner = np.zeros(len(symbols), np.int32)
    owner[at] = word_of
    ends = (4 * np.cumsum(np.bincount(owner[alive], minlength=len(words)))).tolist()
    out = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    if hard:
        # A merge made a pair of lower rank, which then comes before the rest of
        # its word; vocabularies that were trained hardly have such pairs.
        for w in np.unique(owner[np.concatenate(hard)]).tolist():
            out[w] = np.array(merges.one(words[w]), np.int32).tobytes()
    return out


def digests(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, (words, 2)."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)


class Cutter:
    """The words of units: a blank and letters are one, the rest is left to the pattern."""

    def __init__(self, pattern: str) -> None:
        self.split = splitter(pattern).findall

    def __call__(self, units: list[str]) -> list[tuple[str, ...] | list[str]]:
        return [(u,) if u[0] == " " and u[1:].isalpha() else self.split(u) for u in units]


@dataclass
class Words:
    """Where the words' ids stand: a file for each value of the hash's first ``bits``."""

    folder: str
    bits: int


def _gather(pattern: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        cut, words, met, chars = Cutter(pattern), set(), set(), 0

        def sent() -> pa.RecordBatch:
            found = list(words)
            bucket = (digests(found)[:, 0] >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows = pa.array(found, pa.binary()).take(pa.array(order))
            ends = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(found)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][ends[:-1]]), lists], ["bucket", "words"])

        for batch in batches:
            for block in blocks(texts(batch.column("text"))):
                new = set().union(*map(UNITS.findall, block)) - met
                met |= {u for u in new if len(u) <= MEMO_CHARS}
                made = {w.encode() for p in cut(list(new)) for w in p} - words
                words |= made
                chars += sum(map(len, made))
                if len(words) > HELD_WORDS or chars > HELD_CHARS:
                    yield sent()
                    words, chars = set(), 0
                if len(met) > HELD_WORDS:
                    met = set()
        if words:
            yield sent()

    return run


def _replay_words(ranks: Broadcast, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        merges = None

        def written(bucket: int, words: set[bytes]) -> pa.RecordBatch:
            found = list(words)
            keys = digests(found)
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            found, keys = [found[k] for k in order.tolist()], keys[order]
            ids = [x for block in blocks(found) for x in replay(block, merges)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            flat = np.frombuffer(b"".join(ids), np.int32)
            shared_files.write(folder, f"words-{bucket}", keys[:, 0], keys[:, 1], ends, flat)
            return pa.RecordBatch.from_pydict({"bucket": [bucket], "words": [len(found)]})

        now, words = None, set()
        for batch in batches:
            merges = merges or Merges(ranks.value)
            for bucket, more in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != now:
                    if words:
                        yield written(now, words)
                    now, words = bucket, set()
                words.update(more)
        if words:
            yield written(now, words)

    return run


def learn(docs: DataFrame, path: str, pattern: str, text: str = "text") -> Words:
    """Replay the merges over the distinct words of ``docs``, into the shared folder."""
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = Words(new_folder(spark, "bpe-words"), max(4, (parts - 1).bit_length()))
    told = docs.select(F.col(text).cast("string").alias("text"))
    gathered = told.mapInArrow(_gather(pattern, words.bits), "bucket int, words array<binary>")
    dealt = gathered.repartition(parts, "bucket").sortWithinPartitions("bucket")
    made = dealt.mapInArrow(_replay_words(vocabulary(docs, path), words.folder), "bucket long, words long")
    made.agg(F.sum("words")).collect()
    return words


class Encoder:
    """Encodes blocks of documents by the words' ids.

    Units that came up in more than one block are remembered, and those of the
    block before; both sets are bounded.
    """

    def __init__(self, words: Words, pattern: str) -> None:
        self.cut, self.bits = Cutter(pattern), words.bits
        self.shelf = shared_files.Shelf(words.folder)
        # Ids are kept as packed 32-bit integers.
        self.often: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, by their hashes."""
        keys = digests([w.encode() for w in words])
        bucket = (keys[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.lexsort((keys[:, 0], bucket))
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)].tolist()
        out: list[bytes] = [b""] * len(words)
        for a, b in zip(cuts, cuts[1:], strict=False):
            asked = order[a:b]
            first, second, ends, ids = self.shelf(f"words-{int(bucket[asked[0]])}")
            at = np.searchsorted(first, keys[asked, 0])
            # Words whose first hashes are equal stand side by side.
            while True:
                at = np.minimum(at, len(first) - 1)
                wrong = second[at] != keys[asked, 1]
                if not wrong.any():
                    break
                if (first[at[wrong]] != keys[asked[wrong], 0]).any() or (at[wrong] == len(first) - 1).any():
                    raise KeyError("a word that the corpus was not learned from")
                at = at + wrong
            spans = zip(asked.tolist(), ends[at].tolist(), ends[at + 1].tolist(), strict=True)
            for k, low, high in spans:
                out[k] = ids[low:high].tobytes()
        return out

    def look_up(self, units: list[str]) -> dict[str, bytes]:
        parts = self.cut(units)
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        of = dict(zip(words, self.ids_of(words), strict=True)) if words else {}
        return {u: of[p[0]] if len(p) == 1 else b"".join([of[x] for x in p]) for u, p in zip(units, parts, strict=True)}

    def block(self, documents: list[str]) -> list[bytes]:
        cut = [UNITS.findall(x) for x in documents]
        met = set().union(*cut)
        often, last = self.often, self.last
        again = {u: last[u] for u in met if u in last}
        found = self.look_up([u for u in met if u not in again and u not in often])
        if len(often) + len(again) > MEMO_UNITS:
            often = {u: often[u] for u in met if u in often}
        often.update(again)
        look = {**often, **found} if found else often
        self.often = often
        self.last = {u: i for u, i in found.items() if len(u) <= MEMO_CHARS}
        return [b"".join(map(look.__getitem__, units)) for units in cut]


def blocks(documents: list) -> Iterator[list]:
    """Runs of texts of at most BLOCK_CHARS characters together, or of one text."""
    first = held = 0
    for i, text in enumerate(documents):
        if held and held + len(text) > BLOCK_CHARS:
            yield documents[first:i]
            first, held = i, 0
        held += len(text)
    if first < len(documents):
        yield documents[first:]


def vocabulary(docs: DataFrame, path: str) -> Broadcast:
    """The ranks of a vocabulary file, broadcast.  A vocabulary is fixed and
    small (about 50,000 tokens); it never grows with the documents."""
    return docs.sparkSession.sparkContext.broadcast(load_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, into: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with an ``array<int>`` column ``into`` of token ids.

    Each match of ``pattern`` is encoded by itself; special tokens are ordinary
    text.  Null and empty texts give an empty array.  Rows stand alone: repeated
    rows get equal ids, other columns pass untouched (one named ``into`` is
    replaced), an empty table gives none.  ``docs`` is read twice: its words are
    learned (see :func:`learn`) when this is called.
    """
    words = learn(docs, path, pattern, text)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()  # millions of small tuples and no cycles
        encoder = Encoder(words, pattern)
        for column in batches:
            ids = [x for block in blocks(texts(column)) for x in encoder.block(block)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(run, "array<int>").asNondeterministic()(F.col(text).cast("string")))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """``tokens`` with a binary column ``into``: the bytes of the column ``ids``.

    A null array gives no bytes.  An id outside the vocabulary fails the job.
    """
    prepare(tokens.sparkSession)
    shared = vocabulary(tokens, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        of = {i: t for t, i in shared.value.items()}
        for column in batches:
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())]).tolist()
            cuts = zip(ends, ends[1:], strict=False)
            yield pa.array([b"".join(map(of.__getitem__, flat[a:b].tolist())) for a, b in cuts], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return tokens.withColumn(into, F.arrow_udf(run, "binary").asNondeterministic()(F.col(ids)))
