"""Scalar expressions of the lake: ids, names, search text, numbers, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(prefix: str, *parts, bits: int = 1) -> Column:
    """``prefix_`` and the first 16 hex digits of SHA-1 (``bits=1``) or SHA-256
    (``bits=256``) over the parts joined by colons."""
    joined = F.concat_ws(":", *[_col(p).cast("string") for p in parts])
    digest = F.sha1(joined.cast("binary")) if bits == 1 else F.sha2(joined.cast("binary"), bits)
    return F.concat(F.lit(prefix + "_"), F.substring(digest, 1, 16))


def object_identity(key, version) -> Column:
    """Compact JSON of [key, version or ""]."""
    return F.to_json(F.array(_col(key), F.coalesce(_col(version), F.lit(""))))


def object_id(key, version) -> Column:
    return F.sha2(object_identity(key, version).cast("binary"), 256)


def filename(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path) -> Column:
    """The last suffix in lower case with its dot; none for names like ``.bashrc``."""
    return F.lower(F.regexp_extract(filename(path), r"^.+(\.[^.]+)$", 1))


def search_text(heading, content) -> Column:
    """Heading (if any) and content, on lines of their own."""
    return F.concat_ws("\n", F.when(F.length(_col(heading)) > 0, _col(heading)), _col(content))


def normal_identifier(x) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(_col(x)), r"[^\p{L}\p{N}]", "")


def clock(seconds) -> Column:
    """``MM:SS``, from one hour on ``HH:MM:SS``."""
    s = F.greatest(F.floor(_col(seconds)), F.lit(0))
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(s < 3600, short).otherwise(
        F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    )


def rate(x) -> Column:
    """A number, or a fraction like ``30000/1001``; null if it is neither."""
    parts = F.split(_col(x), "/")
    top, bottom = (F.element_at(parts, i).try_cast("double") for i in (1, -1))
    return F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, bottom))


def strip(x) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def strip_blanks(x) -> Column:
    """Without blanks (of Unicode's class Zs) at either end; line ends and tabs stay."""
    return F.regexp_replace(_col(x), r"\A\p{Zs}+|\p{Zs}+\z", "")


def normalize_text(x) -> Column:
    """Line feeds only, at most one blank line in a row, no space at the ends."""
    lines = F.regexp_replace(F.regexp_replace(_col(x), r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return strip(lines)


# Words that carry no meaning in a question, English and Vietnamese.
STOP_WORDS = (
    "how", "many", "what", "where", "which", "the", "and", "are", "for", "from", "with", "contain", "in", "of", "to", "is",
    "a", "by", "that", "this", "be", "been", "has", "have", "had", "do", "does", "did", "were", "was", "or", "but", "about",
    "at", "on", "determine", "calculate", "find", "show", "me", "cho", "tôi", "xem", "là", "bao", "nhiêu", "của", "trong",
    "các", "được", "có", "nào", "đối", "với", "môn", "học", "nhóm", "đi", "hihihi", "cơ", "bản", "sự", "cách", "dự", "án",
    "tạo", "ra", "tác", "động", "bền", "vững", "gì", "hãy", "lựa", "chọn", "đáp", "đúng", "dưới", "đây", "theo", "tổng",
    "số", "thành", "viên", "hiện", "tại", "nhất", "không", "tính", "mới", "yêu", "cầu", "chỉ", "trả", "về", "tự", "định",
    "nghĩa", "tài", "liệu", "cụ", "thể",
)


def plain_question(question) -> Column:
    """In lower case, of letters, digits, ``_``, ``-``, dots and white space only."""
    return F.regexp_replace(F.lower(_col(question)), r"(?U)[^\w\s\-.]", "")


def query_tokens(question) -> Column:
    """Words of more than two characters, in lower case, without stop words, each
    once, in order."""
    words = F.filter(F.split(plain_question(question), r"(?U)\s+"), lambda w: F.length(w) > 2)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def name_matches(question, tokens, name) -> Column:
    """The question holds the whole name, or the name holds one of the tokens."""
    low = F.lower(_col(name))
    return F.contains(F.lower(_col(question)), low) | F.exists(_col(tokens), lambda t: F.contains(low, t))


def position(unit: str, start, end) -> Column:
    """Struct of unit, start and end; null if both ends are."""
    a, b = _col(start), _col(end)
    made = F.struct(F.lit(unit).alias("unit"), a.alias("start"), b.alias("end"))
    return F.when(a.isNotNull() | b.isNotNull(), made)


def relative_path(path) -> Column:
    """Forward slashes, without a leading ``./`` (a leading dot of a name stays)."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"\\", "/"), r"^(\./)+", "")


def plain_name(name) -> Column:
    """A file name as words: no suffix, blanks for ``_`` and ``-``."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(name), r"\.[^.]+$", ""), r"[_\-]+", " "))


def frame_times(duration, most: int) -> Column:
    """Middles of ``n`` equal parts of a video, n = one a second, at least one, at
    most ``most``; none reaches the end."""
    d = _col(duration).cast("double")
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(d).cast("int")))
    middles = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0.0), F.least((i + 0.5) * d / n, d - 0.001))
    )
    return F.when(d > 0, middles).otherwise(F.array().cast("array<double>"))


# What a cell's text is; each predicate takes the text without space around it.


def is_boolean(x) -> Column:
    return F.lower(_col(x)).isin("true", "false", "yes", "no", "0", "1")


def is_integer(x) -> Column:
    return _col(x).rlike(r"(?U)^[+-]?\d+(_\d+)*$")


def is_float(x) -> Column:
    digits = r"\d+(_\d+)*"
    number = rf"({digits}\.?({digits})?|\.{digits})([eE][+-]?{digits})?"
    return _col(x).rlike(rf"(?U)^[+-]?({number}|(?i:nan|inf|infinity))$")


def is_date(x) -> Column:
    c = _col(x)
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()


def is_datetime(x) -> Column:
    c = _col(x)
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?(Z|[+-]\d{2}:\d{2})?$"
    return c.rlike(shape) & c.try_cast("timestamp").isNotNull()


TYPES = (
    ("boolean", is_boolean),
    ("integer", is_integer),
    ("float", is_float),
    ("datetime", is_datetime),
    ("date", is_date),
)


def safe_float(x) -> Column:
    """A number from text or another type; null if it is none."""
    return _col(x).cast("string").try_cast("double")


def safe_int(x) -> Column:
    """A whole number from text or another type, fractions cut off; null if it is none."""
    text = F.trim(_col(x).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).when(
        ~is_float(text) | text.rlike("(?i)nan|inf"), None
    ).otherwise(text.try_cast("double").try_cast("bigint"))


#: Vectors of more dimensions are folded instead of unrolled, as a generated method
#: has a largest size.
UNROLLED = 96


def cosine_distance(vector: str, query: list[float]) -> Column:
    """1 - cosine to a fixed vector; null if either vector has length 0.  Short vectors
    are unrolled, so that they are compiled."""
    other = sum(q * q for q in query) ** 0.5
    if len(query) > UNROLLED:
        v = F.transform(F.slice(F.col(vector), 1, len(query)), lambda x: x.cast("double"))
        products = F.zip_with(v, F.array(*map(F.lit, query)), lambda x, q: x * q)
        dot = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return 1 - F.try_divide(dot, norm * F.lit(other))
    at = [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(len(query))]
    dot = reduce(lambda a, b: a + b, (x * F.lit(q) for x, q in zip(at, query, strict=True)))
    norm = F.sqrt(reduce(lambda a, b: a + b, (x * x for x in at)))
    return 1 - F.try_divide(dot, norm * F.lit(other))
