"""Images and sound: what the first bytes of a file tell of it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sides below which a picture isn't described.
LEAST_SIDE = 11
# Colour types of PNG files.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
ALPHA_MODES = ("RGBA", "LA", "PA")

IMAGE = pa.struct(
    [
        ("format", pa.string()),
        ("width", pa.int32()),
        ("height", pa.int32()),
        ("color_mode", pa.string()),
        ("has_alpha", pa.bool_()),
        ("frame_count", pa.int32()),
        ("is_animated", pa.bool_()),
        ("error", pa.string()),
    ]
)
SOUND = pa.struct(
    [
        ("codec_name", pa.string()),
        ("sample_rate", pa.int32()),
        ("channels", pa.int32()),
        ("duration_seconds", pa.float64()),
        ("warnings", pa.list_(pa.string())),
    ]
)


def _png(d: bytes) -> tuple:
    width, height, depth, kind = struct.unpack(">IIBB", d[16:26])
    frames, clear, at = 1, False, 8
    while at + 8 <= len(d):
        size, name = struct.unpack(">I4s", d[at : at + 8])
        if name == b"acTL":
            frames = struct.unpack(">I", d[at + 8 : at + 12])[0]
        clear |= name == b"tRNS"
        if name == b"IDAT":
            break
        at += size + 12
    mode = "1" if kind == 0 and depth == 1 else "I;16" if kind == 0 and depth == 16 else PNG_MODES[kind]
    return "png", width, height, mode, clear, frames


def _gif(d: bytes) -> tuple:
    width, height, flags = struct.unpack("<HHB", d[6:11])
    at, frames, clear = 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), 0, False

    def skip(at: int) -> int:
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d) and d[at] != 0x3B:
        if d[at] == 0x21:
            clear |= d[at + 1] == 0xF9 and bool(d[at + 3] & 1)
            at = skip(at + 2)
        elif d[at] == 0x2C:
            frames += 1
            own = d[at + 9]
            at = skip(at + 11 + (3 << ((own & 7) + 1) if own & 128 else 0))
        else:
            break
    return "gif", width, height, "P", clear, max(1, frames)


def _jpeg(d: bytes) -> tuple:
    at = 2
    while at + 9 < len(d):
        if d[at] != 0xFF:
            raise ValueError("broken JPEG markers")
        mark, size = d[at + 1], struct.unpack(">H", d[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", d[at + 5 : at + 10])
            return "jpeg", width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "RGB"), False, 1
        at += size + 2
    raise ValueError("no frame header")


def _webp(d: bytes) -> tuple:
    kind = d[12:16]
    if kind == b"VP8X":
        width, height = (int.from_bytes(d[i : i + 3], "little") + 1 for i in (24, 27))
        alpha = bool(d[20] & 16)
        at, frames = 12, 0
        while at + 8 <= len(d):
            name, size = struct.unpack("<4sI", d[at : at + 8])
            frames += name == b"ANMF"
            at += 8 + size + size % 2
        return "webp", width, height, "RGBA" if alpha else "RGB", alpha, max(1, frames)
    if kind == b"VP8L":
        bits = int.from_bytes(d[21:25], "little")
        alpha = bool(bits >> 28 & 1)
        return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if alpha else "RGB", alpha, 1
    width, height = struct.unpack("<HH", d[26:30])
    return "webp", width & 0x3FFF, height & 0x3FFF, "RGB", False, 1


def _tiff(d: bytes) -> tuple:
    e = "<" if d[:2] == b"II" else ">"
    at, pages, tags = struct.unpack(e + "I", d[4:8])[0], 0, {}
    while at and at + 2 <= len(d):
        n = struct.unpack(e + "H", d[at : at + 2])[0]
        for k in range(n if not pages else 0):
            tag, kind, _, raw = struct.unpack(e + "HHI4s", d[at + 2 + 12 * k : at + 14 + 12 * k])
            tags[tag] = struct.unpack(e + "H", raw[:2])[0] if kind == 3 else struct.unpack(e + "I", raw)[0]
        pages += 1
        at = struct.unpack(e + "I", d[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    parts = tags.get(277, 1)
    return "tiff", tags[256], tags[257], {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}.get(parts, "RGB"), parts in (2, 4), max(1, pages)


def image(d: bytes | None) -> dict:
    """Format, size, colour mode, transparency and frames of a picture."""
    try:
        if not d:
            raise ValueError("no content")
        kinds = ((b"\x89PNG", _png), (b"GIF8", _gif), (b"\xff\xd8\xff", _jpeg), (b"II*\0", _tiff), (b"MM\0*", _tiff))
        reader = next((f for code, f in kinds if d.startswith(code)), _webp if d[:4] == b"RIFF" and d[8:12] == b"WEBP" else None)
        if reader is None:
            raise ValueError("unsupported picture format")
        form, width, height, mode, clear, frames = reader(d)
        alpha = clear or mode in ALPHA_MODES
        names = ("format", "width", "height", "color_mode", "has_alpha", "frame_count", "is_animated")
        return dict(zip(names, (form, width, height, mode, alpha, frames, frames > 1), strict=True))
    except Exception as e:
        return {"error": f"{type(e).__name__}: {e}"}


def sound(d: bytes | None) -> dict:
    """Codec, rate, channels and duration as far as WAV and FLAC headers tell them;
    of other formats nothing but a warning."""
    try:
        if d and d[:4] == b"RIFF" and d[8:12] == b"WAVE":
            at, told, size = 12, None, None
            while at + 8 <= len(d) and size is None:
                name, n = struct.unpack("<4sI", d[at : at + 8])
                if name == b"fmt ":
                    told = struct.unpack("<HHIIHH", d[at + 8 : at + 24])
                size = n if name == b"data" else None
                at += 8 + n + n % 2
            kind, channels, rate, per_second, _, bits = told
            codec = {1: f"pcm_s{bits}le" if bits > 8 else "pcm_u8", 3: f"pcm_f{bits}le"}.get(kind, f"wav_{kind}")
            seconds = size / per_second if size is not None and per_second else None
            return {"codec_name": codec, "sample_rate": rate, "channels": channels, "duration_seconds": seconds, "warnings": []}
        if d and d[:4] == b"fLaC":
            bits = int.from_bytes(d[18:26], "big")
            rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & ((1 << 36) - 1)
            seconds = samples / rate if samples else None
            return {"codec_name": "flac", "sample_rate": rate, "channels": channels, "duration_seconds": seconds, "warnings": []}
    except Exception as e:
        return {"warnings": [f"The header can't be read: {type(e).__name__}: {e}"]}
    return {"warnings": ["No reader for this format; rate and duration are not known."]}


def _udf(reader, kind: pa.DataType, ddl: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([reader(d) for d in column.to_pylist()], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ddl)


def images(files: DataFrame) -> DataFrame:
    """Listed pictures (with content) with ``image``; frames are counted as far as the
    content goes."""
    kind = "struct<format:string,width:int,height:int,color_mode:string,has_alpha:boolean,frame_count:int,is_animated:boolean,error:string>"
    return files.withColumn("image", _udf(image, IMAGE, kind)(F.col("content"))).drop("content")


def sounds(files: DataFrame) -> DataFrame:
    """Listed sound files (with content, or their heads) with ``sound``."""
    kind = "struct<codec_name:string,sample_rate:int,channels:int,duration_seconds:double,warnings:array<string>>"
    return files.withColumn("sound", _udf(sound, SOUND, kind)(F.col("content"))).drop("content")


def large_enough(width: str | Column, height: str | Column) -> Column:
    """A picture that can be described: no side is below LEAST_SIDE."""
    return F.least(width, height) >= LEAST_SIDE
