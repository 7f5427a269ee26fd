"""Edit-aware token counts.

A document is kept as a segment tree in a row: its leaves hold pre-tokens with
their characters and tokens, the nodes above the sums below them.  An edit goes
down the tree to the pre-tokens that it touches, cuts from a few characters
before it until a new pre-token ends where an old one did, encodes what is new in
between, and updates the sums on the way up.  Nothing else is encoded again, not
even when the edits come in a later job: :func:`build` makes the trees, and
:func:`apply` takes them on from where they stand.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import prepare, texts
from fathom.llm.pretokens import load_ranks, splitter

#: Pre-tokens remembered by a worker, and the longest that are.
MEMO_PRETOKENS = 300_000
MEMO_CHARS = 64
#: Pre-tokens in a leaf when the tree is built or a leaf divided; at most twice as many.
LEAF = 32
#: A pre-token is settled by itself and at most so many characters after it
#: (an apostrophe looks at two, white space at the end of its run).
LOOK = 3
EDITS = "array<struct<start:int,removed:int,inserted:string>>"
#: Characters and tokens of each pre-token, pre-tokens of each leaf, and the sums of
#: the nodes, the root first, the two below node k at 2 k and 2 k + 1.
TREE = "struct<lengths:array<int>,tokens:array<int>,leaves:array<int>,char_sums:array<int>,token_sums:array<int>>"
RESULT = (
    "struct<n_chars:long,n_tokens:long,edited_chars:long,edited_tokens:long,n_pretokens:long,"
    "encoded_pretokens:long,edited_text:string>"
)
NUMBERS = ("n_chars", "n_tokens", "edited_chars", "edited_tokens", "n_pretokens", "encoded_pretokens")


class Counter:
    """Tokens of pre-tokens, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.cut = encoding.encode_ordinary, splitter(pattern)
        self.memo: dict[str, int] = {}

    def __call__(self, pretokens: list[str]) -> list[int]:
        memo = self.memo
        for p in {p for p in pretokens if p not in memo}:
            if len(memo) >= MEMO_PRETOKENS:
                memo.clear()
                memo.update((q, len(self.encode(q))) for q in set(pretokens))
                break
            memo[p] = len(self.encode(p))
        found = [memo[p] for p in pretokens]
        for p in pretokens:
            if len(p) > MEMO_CHARS:
                memo.pop(p, None)
        return found


class Leaf:
    __slots__ = ("text", "lengths", "tokens")

    def __init__(self, text: str, lengths: list[int], tokens: list[int]) -> None:
        self.text, self.lengths, self.tokens = text, lengths, tokens


class Tree:
    """A text's pre-tokens under edits: leaves in a line, and sums above them."""

    def __init__(self, leaves: list[Leaf], count: Counter) -> None:
        self.leaves, self.count = leaves, count
        self.encoded = 0
        self.sum_up()

    @classmethod
    def of(cls, text: str, count: Counter) -> Tree:
        pretokens = count.cut.findall(text)
        return cls(leaves_of(pretokens, count(pretokens)), count)

    def sum_up(self) -> None:
        """All sums anew, empty leaves dropped: the tree is balanced again."""
        self.leaves = [x for x in self.leaves if x.text]
        n = len(self.leaves)
        self.size = 1 << max(0, n - 1).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.size, np.int64) for _ in range(2))
        self.chars[self.size : self.size + n] = [len(x.text) for x in self.leaves]
        self.tokens[self.size : self.size + n] = [sum(x.tokens) for x in self.leaves]
        low = self.size // 2
        while low:
            for sums in (self.chars, self.tokens):
                sums[low : 2 * low] = sums[2 * low : 4 * low].reshape(-1, 2).sum(1)
            low //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before the leaf."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at - before >= self.chars[k] and self.chars[k + 1]:
                before += int(self.chars[k])
                k += 1
        return k - self.size, before

    def update(self, i: int) -> None:
        k = self.size + i
        self.chars[k], self.tokens[k] = len(self.leaves[i].text), sum(self.leaves[i].tokens)
        while k > 1:
            k //= 2
            for sums in (self.chars, self.tokens):
                sums[k] = sums[2 * k] + sums[2 * k + 1]

    def text(self) -> str:
        return "".join(x.text for x in self.leaves)

    def pretokens(self) -> int:
        return sum(len(x.lengths) for x in self.leaves)

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start`` on; places beyond the
        text's end count as its end."""
        total = int(self.chars[1])
        start = min(max(start, 0), total)
        end = min(start + max(removed, 0), total)
        first, begin = self.find(max(start - LOOK, 0)) if self.leaves else (0, 0)
        # The leaf's pre-tokens that end before the edit can be seen stay.
        kept, at = 0, begin
        lengths = self.leaves[first].lengths if self.leaves else []
        while kept < len(lengths) and at + lengths[kept] + LOOK <= start:
            at += lengths[kept]
            kept += 1
        last = first
        while True:
            old = self.leaves[first : last + 1]
            line = "".join(x.text for x in old)[at - begin :]
            whole = last + 1 >= len(self.leaves)
            if len(line) < end - at and not whole:
                last += 1
                continue
            new = line[: start - at] + inserted + line[end - at :]
            shift = len(inserted) - (end - start)
            # Where old pre-tokens end, in places of ``new``; from there on all is as it was.
            ends = np.cumsum([n for x in old for n in x.lengths][kept:], dtype=np.int64) + shift
            ends = {e: k for k, e in enumerate(ends.tolist(), kept + 1) if e >= start - at + len(inserted)}
            made, stop, rest = [], None, 0
            for m in self.count.cut.finditer(new):
                if not whole and m.end() + LOOK > len(new):
                    break
                made.append(m[0])
                if m.end() in ends:
                    stop, rest = m.end(), ends[m.end()]
                    break
            if stop is None and whole:
                stop, rest = len(new), sum(len(x.lengths) for x in old)
            if stop is not None:
                break
            last = min(len(self.leaves) - 1, last + max(1, last - first + 1))
        lengths = [n for x in old for n in x.lengths]
        tokens = [n for x in old for n in x.tokens]
        words = "".join(x.text for x in old)
        self.encoded += len(made)
        text = words[: at - begin] + new[:stop] + words[at - begin + stop - shift :]
        lengths = [*lengths[:kept], *map(len, made), *lengths[rest:]]
        tokens = [*tokens[:kept], *self.count(made), *tokens[rest:]]
        if self.leaves and len(lengths) <= 2 * LEAF:
            self.leaves[first] = Leaf(text, lengths, tokens)
            for i in range(first + 1, last + 1):
                self.leaves[i] = Leaf("", [], [])
            for i in range(first, last + 1):
                self.update(i)
        else:
            self.leaves[first : last + 1] = cut_leaves(text, lengths, tokens)
            self.sum_up()


def cut_leaves(text: str, lengths: list[int], tokens: list[int]) -> list[Leaf]:
    out, at = [], 0
    for i in range(0, len(lengths), LEAF):
        own = lengths[i : i + LEAF]
        size = sum(own)
        out.append(Leaf(text[at : at + size], own, tokens[i : i + LEAF]))
        at += size
    return out


def leaves_of(pretokens: list[str], tokens: list[int]) -> list[Leaf]:
    cuts = range(0, len(pretokens), LEAF)
    return [Leaf("".join(own := pretokens[i : i + LEAF]), list(map(len, own)), tokens[i : i + LEAF]) for i in cuts]


def rows_of(trees: list[Tree]) -> pa.StructArray:
    """Trees as rows."""

    def lists(parts: list) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)])
        flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    columns = [
        lists([[n for x in t.leaves for n in x.lengths] for t in trees]),
        lists([[n for x in t.leaves for n in x.tokens] for t in trees]),
        lists([[len(x.lengths) for x in t.leaves] for t in trees]),
        lists([t.chars[1:] for t in trees]),
        lists([t.tokens[1:] for t in trees]),
    ]
    return pa.StructArray.from_arrays(columns, ["lengths", "tokens", "leaves", "char_sums", "token_sums"])


def trees_of(column: list[str], rows: pa.StructArray, count: Counter) -> Iterator[Tree]:
    """Rows as trees again; nothing is cut or encoded."""
    parts = {}
    for name in ("lengths", "tokens", "leaves"):
        held = rows.field(name)
        parts[name] = (held.offsets.to_pylist(), held.values.to_pylist())

    def of(name: str, k: int) -> list[int]:
        ends, flat = parts[name]
        return flat[ends[k] : ends[k + 1]]

    for k, text in enumerate(column):
        lengths, tokens, leaves, at, place = of("lengths", k), of("tokens", k), [], 0, 0
        for n in of("leaves", k):
            own = lengths[at : at + n]
            size = sum(own)
            leaves.append(Leaf(text[place : place + size], own, tokens[at : at + n]))
            at, place = at + n, place + size
        yield Tree(leaves, count)


def build(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "tree") -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced if there): the tree of ``text``.

    The tree goes with its text, and both can be written and read again.  The root's
    sums, ``char_sums[0]`` and ``token_sums[0]``, are the text's characters and tokens.
    Null text is empty.  Rows stand alone, other columns pass, an empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # a fixed vocabulary

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        count = Counter(ranks.value, pattern)
        for column in batches:
            yield rows_of([Tree.of(x, count) for x in texts(column)])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(run, TREE).asNondeterministic()(F.col(text).cast("string")))


def after_edits(trees: Iterator[Tree], changes: list, keep: bool) -> tuple[list[Tree], pa.StructArray]:
    """Trees after their edits, if they are kept, and the counts (see :func:`apply`)."""
    made, numbers, edited = [], [], []
    for t, todo in zip(trees, changes, strict=True):
        before = (int(t.chars[1]), int(t.tokens[1]))
        n = t.pretokens()
        for e in todo or ():
            t.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
        if keep:
            made.append(t)
        numbers.append((*before, int(t.chars[1]), int(t.tokens[1]), n, t.encoded))
        edited.append(t.text())
    columns = np.array(numbers, np.int64).reshape(-1, len(NUMBERS))
    told = [pa.array(columns[:, k]) for k in range(len(NUMBERS))]
    return made, pa.StructArray.from_arrays([*told, pa.array(edited, pa.string())], [*NUMBERS, "edited_text"])


def apply(trees: DataFrame, path: str, pattern: str, edits: str = "edits", text: str = "text", tree: str = "tree", into: str = "counts") -> DataFrame:
    """``trees`` with the struct column ``tree`` as it is after the edits in the column
    ``edits``, and a struct column ``into`` (replaced if there): characters and
    tokens of ``text`` before and after them, how many pre-tokens it has and how
    many were encoded again, and the edited text, which goes with the new tree.

    ``edits`` is an array of (start, removed, inserted), applied in order, each
    to the text that the one before left, in code points.  Null or empty edits
    leave the text as it is; null parts count as 0 or empty; places out of range
    are moved to the nearest end.  Null text is empty.  Rows stand alone, other
    columns pass, an empty table gives none.  Memory follows the longest text.

    ``pattern`` must settle a pre-token by itself and at most LOOK characters after it.
    """
    spark = prepare(trees.sparkSession)
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # a fixed vocabulary

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        gc.disable()
        count = Counter(ranks.value, pattern)
        for column, rows, changes in batches:
            made, counts = after_edits(trees_of(texts(column), rows, count), changes.to_pylist(), True)
            yield pa.StructArray.from_arrays([rows_of(made), counts], ["tree", "counts"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, f"struct<tree:{TREE},counts:{RESULT}>").asNondeterministic()
    both = made(F.col(text).cast("string"), F.col(tree), F.col(edits).cast(EDITS))
    others = [c for c in trees.columns if c not in (tree, into)]
    held = trees.select(*others, both.alias("__both"))
    return held.select(*others, F.col("__both.tree").alias(tree), F.col("__both.counts").alias(into))


def count_edits(docs: DataFrame, path: str, pattern: str, edits: str = "edits", text: str = "text", into: str = "counts") -> DataFrame:
    """``docs`` with the struct column ``into`` of :func:`apply`, over trees that are made
    and edited in one pass and not kept."""
    spark = prepare(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # a fixed vocabulary

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        gc.disable()
        count = Counter(ranks.value, pattern)
        for column, changes in batches:
            trees = (Tree.of(x, count) for x in texts(column))  # one at a time
            yield after_edits(trees, changes.to_pylist(), False)[1]

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, RESULT).asNondeterministic()(F.col(text).cast("string"), F.col(edits).cast(EDITS))
    return docs.withColumn(into, made)
