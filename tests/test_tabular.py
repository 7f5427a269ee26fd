import io
import random
import sqlite3
import zipfile

import pytest

from fathom.operators import profile
from fathom.sources import files, tabular


def book(sheets):
    """A minimal workbook; cells that are numbers are written as such."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr(
            "xl/workbook.xml",
            '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            f'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>',
        )
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://x">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            lines = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if isinstance(v, int):
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                    elif v:
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                lines += f'<row r="{r}">{cells}</row>'
            z.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>',
            )
    return out.getvalue()


@pytest.fixture
def lake(spark, tmp_path):
    def make(contents):
        for name, data in contents.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(data if isinstance(data, bytes) else data.encode())
        listed = files.listing(spark, str(tmp_path), content=True)
        return tabular.read(listed)

    return make


def only(parsed):
    (row,) = tabular.tables(parsed).collect()
    return row


def test_csv(lake):
    text = "berth,draught,open,checked\nN1,7.5,yes,2025-01-31\nN2,9.25,no,2025-02-28\nN3,7.5,yes,2025-03-31\nN4,7.5,no,2025-04-30\n"
    parsed = lake({"ports/berths.csv": text})
    found = tabular.tables(parsed)
    row = only(parsed)
    assert (row.relative_path, row.table_name, row.row_count, row.column_count, row.header_index) == ("ports/berths.csv", "berths", 4, 4, 0)
    assert [r[0] for r in row.preview] == ["N1", "N2", "N3", "N4"]
    got = {r.name: r for r in profile.profile(tabular.cells(found), ["table_id"]).collect()}
    assert [got[c].inferred_type for c in row.header] == ["string", "float", "boolean", "date"]
    assert got["draught"].distinct_ratio == pytest.approx(2 / 4)
    assert got["draught"].sample_values == ["7.5", "9.25"]
    typed = profile.typed(found.selectExpr("explode(body) as cells"), "cells", [(c, got[c].inferred_type) for c in row.header])
    assert typed.agg({"draught": "sum"}).head()[0] == 31.75


def test_tables_are_profiled_apart(lake):
    found = tabular.tables(lake({"one.csv": "id,v\n1,x\n2,y\n", "two.csv": "id,v\nab,7\ncd,8\nef,8\n"}))
    got = {(r.table_id, r.name): r for r in profile.profile(tabular.cells(found), ["table_id"]).collect()}
    names = {r.table_name: r.table_id for r in found.collect()}
    assert [got[names["one"], c].inferred_type for c in ("id", "v")] == ["integer", "string"]
    assert [got[names["two"], c].inferred_type for c in ("id", "v")] == ["string", "integer"]
    assert got[names["two"], "v"].row_ratio == pytest.approx(2 / 3) and got[names["one"], "v"].n_filled == 2


def test_sql_over_registered_tables(spark, lake):
    found = tabular.tables(lake({"ships.csv": "ship,berth,tons\nAda,1,50\nBo,2,70\nCy,1,20\n", "berths.csv": "berth,pier\n1,west\n2,east\n"}))
    types = profile.infer_types(tabular.cells(found), ["table_id"])
    ids = {r.table_id: r.table_name for r in found.collect()}
    profile.register(found, types, ids)
    rows = spark.sql("select pier, sum(tons) as tons from ships join berths using (berth) group by pier order by pier").collect()
    assert [tuple(r) for r in rows] == [("east", 70), ("west", 70)]
    with pytest.raises(ValueError, match="no table"):
        profile.register(found, types, {"other": "x"})


def test_no_header(lake):
    row = only(lake({"gauge.tsv": "7\tnorth\t1.5\n8\tsouth\t2.5\n9\teast\t3.5\n"}))
    assert row.header_index is None
    assert row.header == ["column_1", "column_2", "column_3"]
    assert row.row_count == 3


def test_title_row_blank_and_repeated_names(lake):
    text = "TIDES OF THE WEST COAST,,,,,,\nDay,Port,,High,High,High_2,\n1,Brest,x,4,5,6,7\n2,Lorient,y,4,5,6,7\n"
    row = only(lake({"tides.csv": text}))
    assert row.header_index == 1
    assert row.header == ["Day", "Port", "column_3", "High", "High_2", "High_2_2", "column_7"]
    assert [c[0] for c in row.context] == ["TIDES OF THE WEST COAST"]
    assert row.row_count == 2


def test_workbook(lake):
    row = only(lake({"codes.xlsx": book({"Codes": [["Key", "Code"], ["p", 100000000001], ["q", 700000000000003]], "Blank": []})}))
    assert (row.table_name, row.header_index) == ("Codes", 0)
    assert [r[1] for r in row.body] == ["100000000001", "700000000000003"]


def test_a_sheet_without_a_part_is_skipped(lake):
    whole = book({"Here": [["k", "v"], ["a", 1]], "Gone": [["k", "v"], ["b", 2]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as z, zipfile.ZipFile(out, "w") as y:
        for n in z.namelist():
            data = z.read(n)
            y.writestr(n, data.replace(b'<Relationship Id="rId2" Target="worksheets/sheet2.xml"/>', b"") if n.endswith(".rels") else data)
    assert only(lake({"part.xlsx": out.getvalue()})).table_name == "Here"


def test_units_under_a_title(lake):
    sheet = [["WELLS"], ["", "", "(cm)", "(cm)", "(mm)"], ["Well", "Shaft", "Depth", "Width", "Rim"], ["w", "s", 11, 12, 13]]
    row = only(lake({"wells.xlsx": book({"S": sheet})}))
    assert row.header_index == 2
    assert len(row.context) == 2


def test_context_sheet(lake):
    sheets = {
        "Contents": [["Sheet", "Description"], ["T-1", "Water levels"], ["T-2", "Air"]],
        "T-1": [["k", "v"], ["a", 1], ["b", 2]],
        "T-2": [["k", "v"], ["a", 1], ["b", 2]],
    }
    got = {r.table_name: r for r in tabular.context_sheets(tabular.tables(lake({"levels.xlsx": book(sheets)}))).collect()}
    assert {n: r.is_context_sheet for n, r in got.items()} == {"Contents": True, "T-1": False, "T-2": False}
    assert got["T-1"].sheet_description == "Water levels"
    assert got["Contents"].sheet_description is None


def test_database_and_script(lake, tmp_path):
    con = sqlite3.connect(tmp_path / "crew.db")
    con.executescript("CREATE TABLE crew (no INT, rank TEXT); INSERT INTO crew VALUES (1, 'mate'), (2, 'cook'), (3, NULL);")
    con.close()
    script = "CREATE TABLE buoys (s TEXT, n INT); INSERT INTO buoys VALUES ('x', 1), ('y', 2);"
    got = {r.table_name: r for r in tabular.tables(lake({"buoys.sql": script})).collect()}
    assert got["crew"].header == ["no", "rank"]
    assert got["crew"].body[2] == ["3", ""]
    assert got["buoys"].row_count == 2


def test_broken_unsupported_and_empty_files_are_rows(lake):
    parsed = lake({"bad.xlsx": "no workbook at all", "ok.csv": "a,b\nx,y\n", "old.xls": "x", "none": "x", "blank.csv": " , \n"})
    got = {r.relative_path: r.parsed for r in parsed.collect()}
    assert {n: p.status for n, p in got.items()} == {
        "bad.xlsx": "error", "ok.csv": "parsed", "old.xls": "unsupported", "none": "unsupported", "blank.csv": "parsed"
    }
    assert got["blank.csv"].warnings == [tabular.EMPTY_WARNING] and got["ok.csv"].warnings == []
    shapes = {r.table_name: (r.row_count, r.column_count) for r in tabular.tables(parsed).collect()}
    assert shapes == {"ok": (1, 2), "blank": (0, 0)}


def test_files_too_large_are_errors_and_have_another_way(spark, tmp_path, monkeypatch):
    lines = [f"k{i},\"a, {i}\",{i}" for i in range(3000)]
    (tmp_path / "big lake").mkdir()
    (tmp_path / "big lake" / "big one.csv").write_text("\ufeffkey,text,n\n" + "\n".join(lines) + "\n\nragged\n")
    monkeypatch.setattr(files, "LARGEST", 1000)
    listed = files.listing(spark, str(tmp_path / "big lake"), content=True)
    (row,) = tabular.read(listed).collect()
    assert row.parsed.status == "error" and "too large" in row.parsed.error and row.parsed.tables is None
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = tabular.large(spark, str(tmp_path / "big lake"), ["big one.csv"])
        assert found.rdd.getNumPartitions() > 3
        rows = [r.cells for r in found.orderBy("row").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [["key", "text", "n"], *([f"k{i}", f"a, {i}", str(i)] for i in range(3000)), ["ragged"]]
    assert {r.relative_path for r in found.collect()} == {"big one.csv"}


@pytest.mark.parametrize(
    "script",
    [
        "ATTACH DATABASE '{0}/out.db' AS o; CREATE TABLE o.t (a);",
        "PRAGMA journal_mode = WAL; CREATE TABLE t (a);",
        "CREATE TABLE t (a); WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c) INSERT INTO t SELECT count(*) FROM c;",
        "VACUUM INTO '{0}/out.db';",
    ],
)
def test_scripts_have_no_rights(tmp_path, monkeypatch, script):
    monkeypatch.setattr(tabular, "SCRIPT_STEPS", 50)
    with pytest.raises(Exception, match="authorized|interrupted|denied|not"):
        tabular.sql_tables(script.format(tmp_path).encode())
    assert list(tmp_path.iterdir()) == []


def test_scripts_may_fill_tables():
    found = tabular.sql_tables(b"CREATE TABLE t (a, b); INSERT INTO t VALUES (1, upper('x')); CREATE TABLE u AS SELECT a FROM t;")
    assert found == [("t", [["a", "b"], ["1", "X"]]), ("u", [["a"], ["1"]])]


def odd_tables(n):
    """Texts of cells with quotes, line ends of all kinds, separators, and broken quoting."""
    rng = random.Random(3)
    parts = ["a", "bc", ",", ",", ";", "\t", "|", '"', '""', "\n", "\n", "\r\n", "\r", " ", '"x\ny"', '"p""q"', "é", "1", '"', ',"'] 
    plain = ["id,text", "1,a b", '2,"line one\nline two"', '3,"he said ""no"""', "", ' , ', '4,"x,\r\ny"', "5;6", '"7","8"']
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) if i % 2 else "\ufeff" * (i % 4 // 2) + "\r\n".join(rng.choice(plain) for _ in range(rng.randint(0, 12))) + "\n" * (i % 3) for i in range(n)]


@pytest.mark.parametrize("block", [5, 40, 100_000])
def test_large_equals_whole(spark, tmp_path, monkeypatch, block):
    """At any block size the rows are those of the reader of whole files."""
    texts = odd_tables(70)
    names = [f"t{i:03}.{'tsv' if i % 5 == 0 else 'csv'}" for i in range(len(texts))]
    for name, text in zip(names, texts, strict=True):
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        filled = [n for n, t in zip(names, texts, strict=True) if t]
        rows = tabular.large(spark, str(tmp_path), filled).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {n: [] for n in names}
    for r in sorted(rows, key=lambda r: (r.relative_path, r.row)):
        got[r.relative_path].append(r.cells)
    assert len({(r.relative_path, r.row) for r in rows}) == len(rows)
    for name, text in zip(names, texts, strict=True):
        assert got[name] == tabular.delimited(text.encode(), name[-4:])[0][1], text


def test_states_that_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tabular, "MOST_STATES", 0)
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,z\n' * 30)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        rows = sorted(tabular.large(spark, str(tmp_path), ["a.csv"]).collect(), key=lambda r: r.row)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.cells for r in rows] == [["k", "v"], ["1", "x\ny"], ["2", "z"]] * 30
