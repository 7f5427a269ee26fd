"""Quality rules: counts of a text, and compression bands.

Repetitive text compresses far better than prose and noise far worse.  The
ratio (compressed / plain bytes, zstandard) is taken over the whole document
and over fixed chunks, the last and shorter one included; each must stay inside a
band that depends on its length, as short texts hardly compress and long ones find
more to refer back to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import prepare, text_bytes

#: (bytes up to which the band holds, lowest ratio, highest ratio).
BANDS = (
    (512, 0.40, 1.00),
    (2_048, 0.35, 0.90),
    (8_192, 0.30, 0.80),
    (32_768, 0.27, 0.75),
    (float("inf"), 0.22, 0.72),
)
CHUNK_BYTES = 4_096
#: The same for chunks; what is left over at a text's end may be short.
CHUNK_BANDS = (
    (64, 0.40, 16.0),
    (128, 0.40, 1.40),
    (256, 0.40, 1.05),
    (512, 0.38, 0.95),
    (1_024, 0.35, 0.88),
    (2_048, 0.31, 0.83),
    (float("inf"), 0.28, 0.80),
)
#: Share of the text that may lie in chunks outside their bands.
MAX_BAD = 0.25
LEVEL = 3

SYMBOLS = b"#*$%&|<>"
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " ratio double, worst_chunk_low double, worst_chunk_high double, bad_share double,"
    " base_failed boolean, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * np.int64(len(seen)) + ids[2:]  # pairs < n, so this fits for any n below 2**31
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    joined = b"".join(words)
    # A code point has one byte that is not of the form 10xxxxxx.
    chars = len(joined.decode("utf-8", "surrogatepass")) if not joined.isascii() else len(joined)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def band_of(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if n_bytes <= most)


def ratios(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """The whole text's ratio, and length and ratio of each of its chunks (none if
    it is no longer than one: the whole ratio says it then)."""
    if not text:
        return 1.0, []
    whole = len(packer.compress(text)) / len(text)
    cuts = range(0, len(text), CHUNK_BYTES) if len(text) > CHUNK_BYTES else ()
    parts = [text[i : i + CHUNK_BYTES] for i in cuts]
    return whole, [(len(p), len(packer.compress(p)) / len(p)) for p in parts]


def bad_share(chunks: list[tuple[int, float]]) -> float:
    """The share of the text that lies in chunks outside their bands."""
    bad = 0
    for n, ratio in chunks:
        low, high = band_of(n, CHUNK_BANDS)
        bad += 0 if low <= ratio <= high else n
    return bad / max(1, sum(n for n, _ in chunks))


def in_bands(ratio: float, chunks: list[tuple[int, float]], n_bytes: int) -> bool:
    low, high = band_of(n_bytes)
    return low <= ratio <= high and bad_share(chunks) <= MAX_BAD


def _judge(column: pa.Array) -> pa.Array:
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    rows = []
    for text in text_bytes(column):
        n, chars, symbols, dup, repeat = counts(text)
        whole, parts = ratios(text, packer)
        failed = n < 50 or 100 * repeat > 50 * n
        of_chunks = [x for _, x in parts] or [whole]
        kept = not failed and in_bands(whole, parts, len(text))
        rows.append((n, chars, symbols, dup, repeat, whole, min(of_chunks), max(of_chunks), bad_share(parts), failed, kept))
    names = [x.split()[0] for x in RESULT.split(",")]
    kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_()] * 2
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def judge(docs: DataFrame, into: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced if there) of the counts,
    the ratios, ``base_failed`` and the verdict ``kept``.

    Needs ``text``.  Null and empty texts have no words and fail the base
    rules.  Every row is judged by itself: repeated rows get equal verdicts, all
    other columns pass untouched, an empty table gives none.  Work per row is
    linear in the text but for one sort; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(into, F.arrow_udf(_judge, RESULT).asNondeterministic()(F.col("text").cast("string")))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes (see :func:`judge`), with the columns
    of ``docs``, whatever their names but ``__rules``.  Repeated rows all stay or all
    go; null and empty texts go; an empty table gives no rows."""
    return judge(docs, "__rules").filter("__rules.kept").select(*docs.columns)
