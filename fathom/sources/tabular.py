"""Tables inside files: CSV, TSV, XLSX, SQLite, as rows of text cells.

A file's bytes go into an Arrow UDF that yields its tables; header detection,
names and previews are per table, everything that grows with the rows
(profiles, typed tables) is DataFrame work on the rows.
"""

from __future__ import annotations

import csv
import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.scalars import is_boolean, is_date, is_datetime, is_float, is_integer, normal_identifier, stable_id, strip

# How much is looked at.
SNIFFED = 8192
HEADER_ROWS = 10
CONTEXT_ROWS = 3
MOST_SHEETS = 50
PREVIEW_ROWS = 20
# Units that stand alone in a row under a header.
UNITS = ("%", "ppm", "ppb", "mg/kg", "ug/g", "μg/g", "cm", "mm", "m", "ky", "ka", "ma", "wt%")
# Names of sheets and columns that describe other sheets.
CONTEXT_SHEETS = (
    "readme", "index", "contents", "overview", "description", "descriptions", "summary", "legend", "notes", "dictionary",
)
SHEET_COLUMNS = ("sheet", "worksheet", "tab")
DESCRIPTION_COLUMNS = ("description", "summary", "content", "meaning", "notes")


# A cell may be as long as a file.
csv.field_size_limit((1 << 31) - 1)


def separator_of(text: str, path: str) -> str:
    """What separates cells, told from a text's first characters, else by the name."""
    usual = "\t" if path.lower().endswith(".tsv") else ","
    try:
        return csv.Sniffer().sniff(text[:SNIFFED], "".join(SEPARATORS)).delimiter if text.strip() else usual
    except csv.Error:
        return usual


def delimited(data: bytes, suffix: str) -> list[tuple[str, list[list[str]]]]:
    """One table; blank rows drop, ragged ones stay."""
    text = data.decode("utf-8-sig", "replace")
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=separator_of(text, suffix))
    return [("", [r for r in rows if any(c.strip() for c in r)])]


def _place(reference: str) -> int:
    """Column number from a cell's reference such as ``AB12``."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def workbook(data: bytes, suffix: str = ".xlsx") -> list[tuple[str, list[list[str]]]]:
    """Sheets in order, by name, those without a filled cell left out.  Numbers stay as
    they are written, booleans become true and false, gaps empty cells; blank rows drop."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:

        def tree(name: str):
            return ElementTree.fromstring(book.read(name))

        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [
                "".join(t.text or "" for t in si.iter() if t.tag.endswith("}t"))
                for si in tree("xl/sharedStrings.xml")
                if si.tag.endswith("}si")
            ]
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in [s for s in tree("xl/workbook.xml").iter() if s.tag.endswith("}sheet")][:MOST_SHEETS]:
            target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None))
            if target is None:
                continue  # a sheet that nothing stands behind
            target = target.lstrip("/")
            rows = []
            for row in (r for r in tree(target if target.startswith("xl/") else f"xl/{target}").iter() if r.tag.endswith("}row")):
                cells: list[str] = []
                for cell in (c for c in row if c.tag.endswith("}c")):
                    at = _place(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = next((v.text or "" for v in cell if v.tag.endswith("}v")), "")
                    kind = cell.get("t")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter() if t.tag.endswith("}t"))
                    cells[at] = value
                if any(c.strip() for c in cells):
                    rows.append(cells)
            if rows:
                out.append((sheet.get("name", ""), rows))
        return out


def database(data: bytes, suffix: str = ".db") -> list[tuple[str, list[list[str]]]]:
    """Tables of an SQLite file by name, the column names first; null cells are null."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        names = [n for (n,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        out = []
        for name in names:
            quoted = '"' + name.replace('"', '""') + '"'
            found = con.execute(f"SELECT * FROM {quoted}")
            header = [d[0] for d in found.description]
            out.append((name, [header, *([None if v is None else str(v) for v in r] for r in found)]))
        return out
    finally:
        con.close()


#: Tens of thousands of steps that a script may take, and bytes that it may fill.
SCRIPT_STEPS, SCRIPT_BYTES = 20_000, 1 << 30
DENIED = (sqlite3.SQLITE_ATTACH, sqlite3.SQLITE_DETACH, sqlite3.SQLITE_PRAGMA, sqlite3.SQLITE_CREATE_VTABLE)


def _allowed(action: int, first: str | None, second: str | None, *_) -> int:
    loads = action == sqlite3.SQLITE_FUNCTION and second == "load_extension"
    return sqlite3.SQLITE_DENY if loads or action in DENIED else sqlite3.SQLITE_OK


def sql_tables(data: bytes, suffix: str = ".sql") -> list[tuple[str, list[list[str]]]]:
    """Tables that a script creates and fills, by running it on an empty database in
    memory.  It may not attach files, set pragmas or load code, and is stopped after so
    many steps; a script that tries is an error."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"PRAGMA max_page_count = {SCRIPT_BYTES // 4096}")
        con.set_authorizer(_allowed)
        steps = iter(range(SCRIPT_STEPS))
        con.set_progress_handler(lambda: next(steps, None) is None, 10_000)
        con.executescript(data.decode("utf-8-sig", "replace"))
        con.set_authorizer(None)
        return database(con.serialize())
    finally:
        con.close()


READERS = {".csv": delimited, ".tsv": delimited, ".xlsx": workbook, ".db": database, ".sqlite": database, ".sqlite3": database, ".sql": sql_tables}
TABLES = "struct<tables:array<struct<name:string,rows:array<array<string>>>>,status:string,error:string,warnings:array<string>>"
#: What becomes of a file: parsed; or its format has no reader here; or it broke.
PARSED, UNSUPPORTED, ERROR = "parsed", "unsupported", "error"
EMPTY_WARNING = "The file has no filled cell; it is a table of 0 rows and 0 columns."
ARROW_TABLES = pa.struct(
    [
        ("tables", pa.list_(pa.struct([("name", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))),
        ("status", pa.string()),
        ("error", pa.string()),
        ("warnings", pa.list_(pa.string())),
    ]
)


def _parse(data: bytes | None, suffix: str) -> dict:
    if suffix not in READERS:
        return {"status": UNSUPPORTED, "error": f"no reader for {suffix or 'a name without a suffix'}", "warnings": []}
    if data is None:
        return {"status": ERROR, "error": "the file is too large to be read whole", "warnings": []}
    try:
        found = READERS[suffix](data, suffix)
    except Exception as e:  # one broken file must not stop the others
        return {"status": ERROR, "error": f"{type(e).__name__}: {e}", "warnings": []}
    warnings = []
    if not any(r for _, r in found):
        found, warnings = found or [("", [])], [EMPTY_WARNING]
    return {"tables": [{"name": n, "rows": r} for n, r in found], "status": PARSED, "warnings": warnings}


def _read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for contents, suffixes in batches:
        pairs = zip(contents.to_pylist(), suffixes.to_pylist(), strict=True)
        yield pa.array([_parse(data, suffix) for data, suffix in pairs], ARROW_TABLES)


_read.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def read(files: DataFrame) -> DataFrame:
    """Listed files (with content) with ``parsed``: status (PARSED, UNSUPPORTED or
    ERROR), tables of text rows, error, warnings.  Content that is null, as of files too
    large to be held, is an error, not an empty table."""
    return files.withColumn("parsed", F.arrow_udf(_read, TABLES).asNondeterministic()(F.col("content"), F.col("extension"))).drop("content")


#: What may separate cells, and how many blocks' states are broadcast at most.
SEPARATORS = (",", ";", "\t", "|")
MOST_STATES = 1_000_000


def quoted_after(text: str, separator: str, quoted: bool) -> bool:
    """Whether a quoted cell is open after ``text``, which begins inside one or not."""
    at, size = 0, len(text)
    while at < size:
        if quoted:
            at = text.find('"', at)
            if at < 0:
                return True
            at += 1
            if text[at : at + 1] == '"':  # two quotes are one
                at += 1
                continue
            quoted = False
        elif text[at] == '"':
            quoted, at = True, at + 1
            continue
        # A quote inside a cell that doesn't begin with one, or after its end, is plain.
        found = _END_OF_CELL[separator].search(text, at)
        if not found:
            return False
        at = found.end()
    return quoted


_END_OF_CELL = {s: re.compile(f"[{re.escape(s)}\r\n]") for s in SEPARATORS}


def _lines(spark: SparkSession, root: str, relative_paths: list[str]) -> DataFrame:
    """(relative_path, start, size, bytes, line): lines that end with a line feed, in the blocks into
    which Spark cuts files; ``start`` is where a block begins."""
    at = root.rstrip("/")
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    base = re.sub(scheme, "", at) + "/"
    relative = F.substr(F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), scheme, ""), F.lit(len(base) + 1))
    read = spark.read.option("lineSep", "\n").text([f"{at}/{p}" for p in relative_paths])
    return read.select(
        relative.alias("relative_path"),
        (F.col("_metadata.file_block_start") * 1).alias("start"),
        (F.col("_metadata.file_size") * 1).alias("size"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.make_valid_utf8("value").alias("line"),
    )


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and separator the states after it, by the state before; and
    of a file's first blocks the text from which its separator is told."""
    now, states, seen, size, total = None, {}, [], 0, 0

    def told() -> pa.RecordBatch:
        path, start = now
        head = "".join(seen)[:SNIFFED]
        columns = [[path], [start], [size], [total], [head], [[states[s, False] for s in SEPARATORS]], [[states[s, True] for s in SEPARATORS]]]
        kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.bool_()), pa.list_(pa.bool_())]
        names = ["relative_path", "start", "size", "bytes", "head", "plain", "quoted"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for path, start, size_, bytes_, line in zip(*(batch.column(n).to_pylist() for n in ("relative_path", "start", "size", "bytes", "line")), strict=True):
            if (path, start) != now:
                if now:
                    yield told()
                now, states, seen, held = (path, start), {(s, q): q for s in SEPARATORS for q in (False, True)}, [], 0
                size, total = size_, 0
            total += bytes_
            if start <= 4 * SNIFFED and held <= SNIFFED:
                seen.append((line.removeprefix("\ufeff") if start == 0 and not seen else line) + "\n")
                held += len(seen[-1])
            if '"' in line:
                states = {(s, q): quoted_after(line + "\n", s, was) for (s, q), was in states.items()}
    if now:
        yield told()


def _sniffed(heads: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, paths in heads:
        yield pa.array([separator_of(t or "", p) for t, p in zip(texts.to_pylist(), paths.to_pylist(), strict=True)], pa.string())


_sniffed.__annotations__ = {"heads": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def block_entries(lines: DataFrame, separator: str | None = None) -> DataFrame:
    """(relative_path, start, separator, cut, entry): for each block whether it begins inside
    a quoted cell, and whether its file ends without a line feed.  Every block is scanned for both states; a fold over a file's blocks, one
    row each, tells which one is true."""
    blocks = lines.mapInArrow(_block_states, "relative_path string, start long, size long, bytes long, head string, plain array<boolean>, quoted array<boolean>")
    one = F.struct("start", "bytes", "head", "plain", "quoted")
    files = blocks.groupBy("relative_path").agg(F.array_sort(F.collect_list(one)).alias("blocks"), F.max("size").alias("size"))
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["bytes"])
    head = F.substring(F.array_join(F.transform("blocks", lambda b: b["head"]), ""), 1, SNIFFED)
    whole = (F.length(head) < SNIFFED) & (total > F.col("size"))  # all of a file that ends without a line feed
    chosen = F.lit(separator) if separator else F.arrow_udf(_sniffed, "string")(F.when(whole, F.regexp_replace(head, r"\n\z", "")).otherwise(head), F.col("relative_path"))
    files = files.withColumn("separator", chosen)
    place = F.array_position(F.array(*map(F.lit, SEPARATORS)), F.col("separator")).cast("int")

    def step(entries: Column, block: Column) -> Column:
        before = F.element_at(entries, -1)
        return F.array_append(entries, F.when(before, F.element_at(block["quoted"], place)).otherwise(F.element_at(block["plain"], place)))

    entries = F.aggregate("blocks", F.array(F.lit(False)), step)
    zipped = F.zip_with("blocks", entries, lambda b, e: F.struct(b["start"].alias("start"), e.alias("entry")))
    told = files.select("relative_path", "separator", (total > F.col("size")).alias("cut"), F.explode(zipped).alias("b"))
    return told.filter("b.start is not null").select("relative_path", "b.start", "separator", "cut", "b.entry")


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lie in one block; and pieces of rows that don't: a block's lines up to
    the end of the quoted cell in which it begins (``opens`` is false), and those of the
    row that is open at its end (true)."""
    paths, rows, cells, pieces, opens = [], [], [], [], []

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
        columns = [pa.array(c, k) for c, k in zip((paths, rows, cells, pieces, opens), kinds, strict=True)]
        for c in (paths, rows, cells, pieces, opens):
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["relative_path", "row", "cells", "piece", "opens"])

    def put(path: str, row: int, found: list[str] | None, piece: str | None = None, open_: bool | None = None) -> None:
        for c, v in zip((paths, rows, cells, pieces, opens), (path, row, found, piece, open_), strict=True):
            c.append(v)

    now, held, n, inside, quoted, first, mark = None, [], 0, False, False, 0, ","

    def close() -> None:
        """The row or piece that is open at a block's end."""
        if held:
            put(now[0], now[1] + first, None, "\n".join(held) + "\n", not inside)

    for batch in batches:
        for path, start, line, separator, entry in zip(*(batch.column(c).to_pylist() for c in ("relative_path", "start", "line", "separator", "entry")), strict=True):
            if (path, start) != now:
                close()
                now, held, n, inside, quoted, first, mark = (path, start), [], 0, entry, entry, 0, separator
                line = line.removeprefix("\ufeff") if start == 0 else line
            if not held:
                first = n
            held.append(line)
            n += 1
            if '"' in line:
                quoted = quoted_after(line + "\n", mark, quoted)
            if quoted:
                continue
            text = "\n".join(held)
            if inside:
                put(path, start + first, None, text + "\n", False)
                inside = False
            else:
                # A carriage return alone ends a row too; a row has a byte or more, so blocks don't overlap.
                for k, found in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=mark)):
                    if any(c.strip() for c in found):
                        put(path, start + first + k, found)
                    n = max(n, first + k + 1)
            held = []
            if len(paths) >= 4096:
                yield batch_of()
    close()
    yield batch_of()


def _joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for path, row, text, mark, cut in zip(*(batch.column(c).to_pylist() for c in ("relative_path", "row", "text", "separator", "cut")), strict=True):
            text = text.removesuffix("\n") if cut else text  # only a quoted cell that never ends would show it
            for k, found in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=mark)):
                if any(c.strip() for c in found):
                    for c, v in zip(out, (path, row + k, found), strict=True):
                        c.append(v)
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["relative_path", "row", "cells"])


def large(spark: SparkSession, root: str, relative_paths: list[str], separator: str | None = None) -> DataFrame:
    """(relative_path, row, cells) of delimited files of any size, the same rows that
    :func:`delimited` gives: many tasks read a file's blocks.

    ``row`` ascends with the rows of a file, with gaps.  The separator is told from the
    file's first characters, unless it is given.  Files are read twice: a first pass
    tells for each block where it would end, begun inside a quoted cell or not (see
    :func:`block_entries`), and the second one makes rows.  Only rows that go over a
    block's end are shuffled, in pieces.  Blank rows drop, ragged ones stay; an empty file
    has no rows.
    """
    lines = _lines(spark, root, relative_paths)
    if spark.sparkContext.getCheckpointDir():
        entries = block_entries(lines, separator).checkpoint()
    else:
        entries = block_entries(lines, separator)
    few = entries.count() <= MOST_STATES  # a row for each block
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    states = entries.drop("cut")
    placed = placed.drop("size", "bytes").join(F.broadcast(states) if few else states, ["relative_path", "start"])
    if not few:  # what an exchange has mixed is put in order
        placed = placed.repartition("relative_path", "start").sortWithinPartitions("relative_path", "start", "at")
    made = placed.drop("at").mapInArrow(_block_rows, "relative_path string, row long, cells array<string>, piece string, opens boolean")
    whole = made.filter("cells is not null").select("relative_path", "row", "cells")

    # The pieces of a row: one that opens, and those after it that don't.
    order = Window.partitionBy("relative_path").orderBy("row")  # at most two pieces a block
    pieces = made.filter("piece is not null")
    grouped = pieces.withColumn("first", F.max(F.when(F.col("opens"), F.col("row"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "piece"))), lambda x: x["piece"]), "")
    cut = grouped.groupBy("relative_path", F.col("first").alias("row")).agg(text.alias("text"))
    marks = entries.select("relative_path", "separator", "cut").distinct()
    rest = cut.join(marks, "relative_path").mapInArrow(_joined_rows, "relative_path string, row long, cells array<string>")
    return whole.unionByName(rest)


def _data_like(cell):
    return is_boolean(cell) | is_integer(cell) | is_float(cell) | is_date(cell) | is_datetime(cell)


def tables(parsed: DataFrame) -> DataFrame:
    """One row per table: relative_path, table_name, header_index (from 0, null if
    there is none), header (names, unique), context (rows before the header), body,
    row_count and column_count of all of it, preview (its first rows).

    The header is the first of ten rows that has two cells or more and is no title
    and no row of units; if it and the row after it look like data there is none.
    """
    one = parsed.filter(F.col("parsed.status") == PARSED).select(
        "relative_path", "filename", "extension", F.posexplode("parsed.tables").alias("sheet_index", "t")
    )
    clean = F.transform("t.rows", lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    rows = one.select(
        "relative_path",
        "extension",
        "sheet_index",
        F.when(F.length("t.name") > 0, F.col("t.name")).otherwise(stem).alias("table_name"),
        clean.alias("rows"),
    )
    filled = lambda r: F.filter(r, lambda c: c != "")

    def data_row(r):
        some = filled(r)
        return (F.size(some) >= 2) & (F.size(F.filter(some, _data_like)) >= F.greatest(F.lit(2), F.size(some) - 1))

    def unit_row(r):
        some = filled(r)
        unit = lambda c: (F.startswith(c, F.lit("(")) & F.endswith(c, F.lit(")"))) | F.lower(c).isin(*UNITS)
        sparse = (F.size(r) - F.size(some)) >= F.lit(0.4) * F.size(r)
        return sparse & (F.size(some) >= 2) & (F.size(F.filter(some, unit)) >= F.greatest(F.lit(2), F.size(some) - 1))

    head = F.slice("rows", 1, HEADER_ROWS)
    looked = rows.withColumn(
        "head",
        F.transform(
            head, lambda r, i: F.struct(i.alias("i"), (F.size(filled(r)) >= 2).alias("wide"), unit_row(r).alias("unit"), data_row(r).alias("data"))
        ),
    )
    looked = looked.withColumn("first", F.get(F.filter("head", lambda h: h["wide"] & ~h["unit"]), F.lit(0)))
    following = F.get(F.col("head"), F.col("first.i") + 1)
    is_database = F.col("extension").isin(".db", ".sqlite", ".sqlite3", ".sql")
    at = F.when(is_database, F.when(F.size("rows") > 0, 0)).when(
        ~(F.col("first.data") & F.coalesce(following["data"], F.lit(False))), F.col("first.i")
    )
    placed = looked.withColumn("header_index", at)
    width = F.aggregate("rows", F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    pad = lambda r, w: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))
    shaped = placed.withColumn("width", width)
    raw = F.when(F.col("header_index").isNotNull(), pad(F.get("rows", "header_index"), F.col("width"))).otherwise(
        F.array_repeat(F.lit(""), F.col("width"))
    )
    named = F.transform(raw, lambda c, i: F.when(c != "", c).otherwise(F.concat(F.lit("column_"), (i + 1).cast("string"))))

    def unique(seen, c):
        """``seen`` and this name, or with the first number that makes it a new one."""
        numbered = F.transform(F.sequence(F.lit(2), F.size(seen) + 2), lambda k: F.concat(c, F.lit("_"), k.cast("string")))
        free = F.get(F.filter(numbered, lambda x: ~F.array_contains(seen, x)), F.lit(0))
        return F.array_append(seen, F.when(F.array_contains(seen, c), free).otherwise(c))

    start = F.coalesce(F.col("header_index") + 1, F.lit(0))
    before = F.slice("rows", 1, F.coalesce("header_index", F.lit(0)))
    return (
        shaped.withColumn("names", named)
        .withColumn("header", F.aggregate("names", F.array().cast("array<string>"), unique))
        .select(
            "relative_path",
            "sheet_index",
            "table_name",
            stable_id("table", "relative_path", "table_name", bits=256).alias("table_id"),
            "header_index",
            "header",
            F.slice(before, F.greatest(F.lit(1), F.size(before) - CONTEXT_ROWS + 1), CONTEXT_ROWS).alias("context"),
            F.transform(
                F.slice("rows", start + 1, F.greatest(F.lit(0), F.size("rows") - start)), lambda r: pad(r, F.col("width"))
            ).alias("body"),
        )
        .withColumn("row_count", F.size("body"))
        .withColumn("column_count", F.size("header"))
        .withColumn("preview", F.slice("body", 1, PREVIEW_ROWS))
    )


def cells(found: DataFrame, most_rows: int = 200) -> DataFrame:
    """(table_id, ordinal, name, row, value) of the first rows of each table, for
    :func:`fathom.operators.profile`."""
    some = found.select("table_id", "header", F.posexplode(F.slice("body", 1, most_rows)).alias("row", "cells"))
    return some.select("table_id", "row", F.posexplode(F.arrays_zip("header", "cells")).alias("ordinal", "c")).select(
        "table_id", "ordinal", F.col("c.header").alias("name"), "row", F.coalesce("c.cells", F.lit("")).alias("value")
    )


def context_sheets(found: DataFrame) -> DataFrame:
    """Tables with ``is_context_sheet`` and ``sheet_description``: sheets that look
    like an index of the others (scored by name, headers, width, and how many
    sheets they name) describe those that they name."""
    named = found.withColumn("key", normal_identifier("table_name"))
    lines = named.select(
        "relative_path", F.col("table_id").alias("by"), F.explode(F.slice("body", 1, 20)).alias("r")
    ).select("relative_path", "by", normal_identifier(F.get("r", F.lit(0))).alias("key"), F.get("r", F.lit(1)).alias("told"))
    told = lines.filter("key <> '' and told <> ''").join(named.select("relative_path", "key").distinct(), ["relative_path", "key"])
    many = told.groupBy("by").agg(F.count_distinct("key").alias("n_told")).withColumnRenamed("by", "table_id")
    header = F.transform("header", normal_identifier)
    has = lambda words: F.arrays_overlap(header, F.array(*map(F.lit, words))).cast("int") * 2
    n = F.coalesce("n_told", F.lit(0))
    score = (
        F.col("key").isin(*CONTEXT_SHEETS).cast("int") * 3
        + has(SHEET_COLUMNS)
        + has(DESCRIPTION_COLUMNS)
        + (F.col("column_count") <= 3).cast("int")
        + F.when(n >= 2, 4).when(n == 1, 2).otherwise(0)
    )
    scored = named.join(many, "table_id", "left").withColumn("is_context_sheet", score >= 4).drop("n_told")
    indexes = scored.filter("is_context_sheet").select(F.col("table_id").alias("by"))
    given = told.join(indexes, "by").groupBy("relative_path", "key").agg(F.max(F.struct("by", "told")).alias("g"))
    return scored.join(given.select("relative_path", "key", F.col("g.told").alias("sheet_description")), ["relative_path", "key"], "left").drop("key")
