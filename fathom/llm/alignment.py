"""Alignment of two tokenizers' tokens over the same text.

A is a byte-level BPE of the ``tokenizers`` library, B a ``sentencepiece`` model that
puts a blank before its text, so both cut the bytes of a blank and the text.  A block
of an Arrow batch is handled at once: its texts are laid end to end, the places where
tokens of A and of B end are counted by ``bincount`` over the block's bytes, and where
both end is a cut.  The tokens between two cuts are a group; running sums over the
places, taken at the texts' ends, give each text its own tokens, groups and links.  An
A and a B token are linked where their bytes overlap: between two neighbouring places
there is one token of each, so a place is a link.

Encoding takes most of the time, and words come again and again.  A blank after a
character that is no white space always begins a token of A (no alternative of its
pre-token pattern goes on from such a character into white space), and one of B, as
none of its pieces has a blank after another character (:class:`Pieces` checks that).
Texts are therefore cut there into *units*, and what a unit is encoded into is
remembered.

:func:`count_links` counts for each pair of ids the documents that hold it linked.  The
most frequent pairs, a fixed number at most, are sent to all tasks; the others, which
are a small part of what a text links, are joined.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import new_folder, prepare, stored, text_or_empty, texts
from fathom.llm.pretokens import WHITE

ALIGNMENT = (
    "n_a long, n_b long, n_groups long, n_links long, groups string, ends array<int>, pairs array<long>, times array<int>"
)
#: Bytes of text that are aligned at once, unless one text is longer.
BLOCK_BYTES = 1 << 20
#: Units that a worker remembers, and the longest of them, in characters.
MEMO_UNITS = 300_000
MEMO_CHARS = 200
#: Units that are encoded side by side.
RUN = 256
#: Ids of a side beyond which all is forgotten.
MEMO_IDS = 3_000_000
#: A pair of ids is one number: that of A, then B's in so many bits.
ID_BITS = 20
#: Pairs that are sent to all tasks, at most.
HOT_PAIRS = 1 << 19

# White space of any version of Unicode.
_WHITE = f"{WHITE}᠎\x1c-\x1f"
_ODD = re.compile(f"[{_WHITE}] ")
_CUT = re.compile(f"(?<=[^{_WHITE}]) ")
# What a unit may end with, if it isn't clear where the next one begins; "" is an empty one's.
_NOT_LAST = {"", *re.findall(f"[{_WHITE}]", "".join(map(chr, range(0xD800))))}


def units_of(text: str) -> list[str]:
    """A blank and the text, cut before each blank that follows a character other than
    white space; units are given without the blank that they begin with."""
    if not _ODD.search(" " + text):
        return text.split(" ")
    first, *others = _CUT.split(" " + text)
    return [first[1:], *others]


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones
    of Latin-1 for themselves, the others by the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


def lengths_of(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, tokens), np.int64, len(tokens))


class Bytes:
    """Tokenizer A: byte-level BPE from a file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        of = byte_alphabet()
        vocabulary = self.encoder.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        with open(path, encoding="utf-8") as file:
            added = {x["id"] for x in json.load(file)["added_tokens"]}
        for token, i in vocabulary.items():
            self.tokens[i] = token.encode() if i in added else bytes(of[c] for c in token)
        self.lengths = lengths_of(self.tokens)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.encoder.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a ``sentencepiece`` model that adds a blank in front."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on over a blank, so texts cannot be cut before blanks")
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.encoder.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.blank = [self.encoder.piece_to_id("▁")]
        self.lengths = lengths_of(self.tokens)

    def encode(self, units: list[str]) -> list[list[int]]:
        """An empty unit is a blank at the text's end, for which a blank isn't added."""
        found = self.encoder.encode(units, num_threads=1)
        return [ids if u else self.blank for u, ids in zip(units, found, strict=True)]


def spelled(side, ids: list[int]) -> bytes:
    return b"".join(map(side.tokens.__getitem__, ids))


def encoded(side, units: list[str], sizes: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct units on end, how many each has, and whether they spell it.
    ``sizes``: their bytes, each with its blank; ``clean``: the numbers of those that say
    where the next one begins.  These are encoded side by side in longer texts, unless
    such a text isn't spelled; each text's ids are cut where its units' bytes end."""
    lines = [" ".join([units[i] for i in clean[at : at + RUN].tolist()]) for at in range(0, len(clean), RUN)]
    encodings = side.encode(lines)
    good = np.array([spelled(side, ids) == b" " + line.encode() for line, ids in zip(lines, encodings, strict=True)], bool)
    held = clean[np.repeat(good, RUN)[: len(clean)]]
    taken = [ids for ids, ok in zip(encodings, good.tolist(), strict=True) if ok]
    apart = np.ones(len(units), bool)
    apart[held] = False
    alone = np.flatnonzero(apart)
    singles = side.encode([units[i] for i in alone.tolist()])

    flat = np.fromiter(chain.from_iterable([*taken, *singles]), np.int32)
    first = sum(map(len, taken))
    tops = np.searchsorted(np.cumsum(side.lengths[flat[:first]]), np.cumsum(sizes[held])) + 1
    many, starts, whole = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.ones(len(units), bool)
    many[held] = np.diff(tops, prepend=0)
    starts[held] = tops - many[held]
    many[alone] = np.fromiter(map(len, singles), np.int64, len(singles))
    starts[alone] = first + np.cumsum(many[alone]) - many[alone]
    whole[alone] = [spelled(side, ids) == b" " + units[i].encode() for i, ids in zip(alone.tolist(), singles, strict=True)]
    return on_end(flat, starts, many), many, whole


def on_end(flat: np.ndarray, starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts`` and have so many, on end."""
    return flat[np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)]


class Memo:
    """What units are encoded into, by the units' numbers.  Most distinct units come
    once: where there is no room left, those stay that blocks have met again."""

    def __init__(self, sides: list) -> None:
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.whole = np.zeros(0, bool)
        self.again = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]
        self.ends = [np.zeros(1, np.int64) for _ in self.sides]

    def sift(self) -> None:
        """Forget the units that haven't been met again, and number the others anew."""
        units = [u for u, i in self.of.items() if self.again[i]]
        numbers = np.fromiter(map(self.of.__getitem__, units), np.int64, len(units))
        kept = [self.tokens(k, numbers) for k in range(len(self.sides))]
        self.of = dict(zip(units, range(len(units)), strict=True))
        self.whole, self.again = self.whole[numbers], np.zeros(len(units), bool)
        self.ids = [flat for flat, _ in kept]
        self.ends = [np.concatenate(([0], np.cumsum(many))) for _, many in kept]

    def full(self, more: int) -> bool:
        return len(self.of) + more > MEMO_UNITS or max(map(len, self.ids)) > MEMO_IDS

    def numbers(self, units: list[str]) -> np.ndarray:
        """The units' numbers, until the next call."""
        met = set(units)
        if self.full(len(met)):
            self.sift()
            if self.full(len(met)):
                self.clear()
        base = len(self.whole)
        new = [u for u in met if u not in self.of]
        if new:
            # Long units come last, and are forgotten by the next call.
            new.sort(key=len)
            self.of.update(zip(new, range(base, base + len(new)), strict=True))
            sizes = np.fromiter([len(u.encode()) + 1 for u in new], np.int64, len(new))
            clean = np.flatnonzero([u[-1:] not in _NOT_LAST for u in new])
            whole = np.ones(len(new), bool)
            for k, side in enumerate(self.sides):
                flat, many, right = encoded(side, new, sizes, clean)
                whole &= right
                self.ids[k] = np.concatenate((self.ids[k], flat))
                self.ends[k] = np.concatenate((self.ends[k], self.ends[k][-1] + np.cumsum(many)))
            self.whole = np.concatenate((self.whole, whole))
            self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
        found = np.fromiter(map(self.of.__getitem__, units), np.int64, len(units))
        self.again[found[found < base]] = True
        for u in reversed(new):
            if len(u) <= MEMO_CHARS:
                break
            del self.of[u]
        return found

    def tokens(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of side ``k`` for these units on end, and how many each unit has."""
        starts = self.ends[k][numbers]
        many = self.ends[k][numbers + 1] - starts
        return on_end(self.ids[k], starts, many), many


def per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the runs that end at ``ends``."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[ends], prepend=0)


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers up to ``most`` in decimal, a row of bytes each that ends with a free
    one; and how many bytes each has."""
    lines = [b"%d" % i for i in range(most + 1)]
    width = len(lines[-1]) + 1
    table = np.frombuffer(b"".join([x.rjust(width - 1) + b" " for x in lines]), np.uint8)
    return table.reshape(-1, width), np.fromiter(map(len, lines), np.int64, len(lines))


class Aligner:
    """Aligns blocks of texts; ``a`` and ``b`` are paths of the two vocabularies."""

    def __init__(self, a: str, b: str) -> None:
        self.memo = Memo([Bytes(a), Pieces(b)])
        self.digits = decimals(max(len(side.tokens) for side in self.memo.sides) - 1)
        if max(len(side.tokens) for side in self.memo.sides) > 1 << ID_BITS:
            raise ValueError(f"ids of over {ID_BITS} bits")

    def spells(self, text: str, numbers: np.ndarray) -> bool:
        """Whether both sides' tokens join to a blank and the text."""
        for k, side in enumerate(self.memo.sides):
            ids, _ = self.memo.tokens(k, numbers)
            if spelled(side, ids.tolist()) != b" " + text.encode():
                return False
        return True

    def block(self, documents: list[str]) -> pa.StructArray:
        memo = self.memo
        cut = [units_of(t) if t else [] for t in documents]
        units = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = memo.numbers(list(chain.from_iterable(cut)))
        ends = np.cumsum(units)
        bad = np.flatnonzero(per_text(~memo.whole[numbers], ends))
        wrong = [i for i in bad.tolist() if not self.spells(documents[i], numbers[ends[i] - units[i] : ends[i]])]
        if wrong:
            use = np.ones(len(cut), bool)
            use[wrong] = False
            numbers, units = numbers[np.repeat(use, units)], np.where(use, units, 0)
            ends = np.cumsum(units)
        sides = [memo.tokens(k, numbers) for k in range(2)]
        ids = [x[0] for x in sides]
        n_a, n_b = (per_text(many, ends) for _, many in sides)

        # Where tokens end, counted from the block's first byte.
        at = [np.cumsum(side.lengths[i]) for side, i in zip(memo.sides, ids, strict=True)]
        size = int(at[0][-1]) if len(at[0]) else 0
        in_a, in_b = (np.bincount(x, minlength=size + 1) for x in at)
        places = np.flatnonzero(in_a | in_b)
        is_a, is_b = in_a[places] > 0, in_b[places] > 0
        both = is_a & is_b
        group = np.cumsum(both) - both
        del in_a, in_b

        # The last place of each text is where its last token of A ends.
        tops = np.concatenate(([0], at[0]))[np.cumsum(n_a)]
        last = np.searchsorted(places, tops, side="right")
        n_links, n_groups = np.diff(last, prepend=0), per_text(both, last)

        # A place is a link of the tokens that reach up to it.
        pair = ids[0][np.cumsum(is_a) - is_a].astype(np.int64) << ID_BITS | ids[1][np.cumsum(is_b) - is_b]
        pair |= np.repeat(np.arange(len(cut), dtype=np.int64) << 2 * ID_BITS, n_links)
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        times = np.diff(np.append(first, len(pair)))
        pair = pair[first]
        n_pairs = np.bincount(pair >> 2 * ID_BITS, minlength=len(cut))

        # Tokens in the order in which groups are written: A's, then B's.
        of_a, of_b = group[is_a], group[is_b]
        a_in, b_in = (np.bincount(x, minlength=n_groups.sum()) for x in (of_a, of_b))
        place_a = np.arange(len(of_a)) + (np.cumsum(b_in) - b_in)[of_a]
        place_b = np.arange(len(of_b)) + np.cumsum(a_in)[of_b]
        shown, after = np.empty(len(of_a) + len(of_b), np.int32), np.full(len(of_a) + len(of_b), ord(","), np.uint8)
        shown[place_a], shown[place_b] = ids
        after[place_a[both[is_a]]] = ord("|")
        after[place_b[both[is_b]]] = ord(";")
        stops = np.cumsum(n_a + n_b)
        after[stops[n_a > 0] - 1] = 0
        table, widths = self.digits
        digits = table[shown]
        digits[:, -1] = after
        lengths = widths[shown] + (after > 0)
        line = digits[(digits != ord(" ")) & (digits > 0)]
        marks = np.concatenate(([0], np.cumsum(per_text(lengths, stops)))).astype(np.int32)
        groups = pa.StringArray.from_buffers(len(cut), pa.py_buffer(marks), pa.py_buffer(line))

        starts = np.concatenate(([0], tops[:-1])) if len(tops) else tops
        lists = (
            (places[both] - np.repeat(starts, n_groups), np.int32, n_groups),
            (pair & (1 << 2 * ID_BITS) - 1, np.int64, n_pairs),
            (times, np.int32, n_pairs),
        )
        columns = [*map(pa.array, (n_a, n_b, n_groups, n_links)), groups]
        for flat, kind, many in lists:
            offsets = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind))))
        return pa.StructArray.from_arrays(columns, [x.split()[0] for x in ALIGNMENT.split(", ")])


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def blocks(documents: list[str]) -> Iterator[list[str]]:
    """Runs of texts of at most BLOCK_BYTES bytes together, or of one text."""
    first = held = 0
    for i, text in enumerate(documents):
        size = len(text) if text.isascii() else len(text.encode())
        if held and held + size > BLOCK_BYTES:
            yield documents[first:i]
            first, held = i, 0
        held += size
    if first < len(documents):
        yield documents[first:]


def align(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``alignment``: the tokens of a blank and the text
    by A (path of a ``tokenizers`` file) and of the text by B (path of a
    ``sentencepiece`` model), special tokens being plain text.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``: numbers of tokens, groups and links;
    ``groups``: ids in decimal, as ``a1,a2|b1;a3|b2,b3``; ``ends``: where groups end, in
    bytes of a blank and the text; ``pairs``, ascending, and ``times``: linked pairs of
    ids (see :func:`ids_of`) and how many links of the text each has.

    Null and empty texts, and those that A or B doesn't spell byte for byte, have no
    tokens: zeros, an empty string and empty arrays.  Rows stand alone: repeated rows
    get equal results, other columns pass untouched (one named ``alignment`` is
    replaced), an empty table gives none.  A worker holds one block, or the longest
    text, at some 60 bytes for each of its own.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        for column in batches:
            for part in blocks(texts(column)):  # rows may come in other batches than they went
                yield aligner(a, b).block(part)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("alignment", F.arrow_udf(run, ALIGNMENT).asNondeterministic()(text_or_empty(text)))


def ids_of(pair):
    """Columns of A's and B's id of a pair."""
    return F.shiftright(pair, ID_BITS).cast("int"), pair.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of ``aligned`` (needs an array ``pairs``) have each
    pair linked, and whether no pair of the same id of A has more."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a, _ = ids_of(F.col("pair"))
    # A row for each id of A: at most 2 ** ID_BITS.
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    told = counts.withColumn("a", a).join(F.broadcast(most), "a")
    return stored(told.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def count_links(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The rows of ``aligned`` (see :func:`align`; without its column ``alignment``) with
    their numbers ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and, over the links of a row,
    ``n_best``, how many have the highest count that their id of A has with any
    (ties included), and ``count_sum``, the sum of their counts.

    The count of a pair of ids is the number of rows of ``aligned`` that hold it linked;
    rows that the table has twice count twice.  Rows without tokens get zeros.  Columns
    with the names of the numbers are replaced; names that begin with two underscores
    are not allowed.  All columns but the alignment's are written to the shared folder
    on the way, so texts and lists should be dropped before.  At most ``hot_pairs`` counts are
    broadcast.
    """
    spark = prepare(aligned.sparkSession)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    others = [c for c in aligned.columns if c not in ("alignment", *numbers, "n_best", "count_sum")]
    told = aligned.select(
        *others, *(F.col(f"alignment.{n}").alias(n) for n in numbers),
        F.col("alignment.pairs").alias("__pairs"), F.col("alignment.times").alias("__times"),
        F.monotonically_increasing_id().alias("__row"),
    )
    folder = new_folder(spark, "aligned")
    told.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)

    # Pairs by how often they are linked, an eighth of a power of two at a time.
    counts = pair_counts(rows.select(F.col("__pairs").alias("pairs")))
    degree = F.floor(F.log2("n") * 8)
    sizes = sorted(counts.groupBy(degree.alias("degree")).count().collect(), reverse=True)
    least, held = float("inf"), 0
    for size in sizes:
        held += size["count"]
        if held > hot_pairs:
            break
        least = size["degree"]
    sent = counts.filter(degree >= F.lit(least).cast("double")).toArrow()
    pair = sent.column("pair").to_numpy()
    order = np.argsort(pair)
    known = spark.sparkContext.broadcast((pair[order], sent.column("n").to_numpy()[order], sent.column("best").to_numpy()[order]))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        gc.disable()
        pair, n, best = known.value
        for pairs, times in batches:
            ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy())))
            linked, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, linked), max(len(pair) - 1, 0))
            hot = pair[at] == linked if len(pair) else np.zeros(len(linked), bool)
            where = np.where(hot, at, 0)
            sums = [per_text(np.where(hot, x[where], 0) * often if len(pair) else 0 * often, ends[1:]) for x in (best, n)]
            cold = np.concatenate(([0], np.cumsum(per_text(~hot, ends[1:])))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cold), pa.array(x[~hot])) for x in (linked, often)]
            yield pa.StructArray.from_arrays([*map(pa.array, sums), *lists], ["best", "sum", "pairs", "times"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    summed = F.arrow_udf(run, "best long, sum long, pairs array<long>, times array<long>").asNondeterministic()
    folder = new_folder(spark, "aligned-sums")
    rows.withColumn("__sums", summed("__pairs", "__times")).drop("__pairs", "__times").write.parquet(folder)
    rows = spark.read.parquet(folder)

    cold = rows.select("__row", F.explode(F.arrays_zip("__sums.pairs", "__sums.times")).alias("x"))
    cold = cold.select("__row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = cold.join(counts.filter(degree < F.lit(least).cast("double")), "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum")
    )
    return rows.join(met, "__row", "left").select(
        *others, *numbers,
        (F.col("__sums.best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
        (F.col("__sums.sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"),
    )
