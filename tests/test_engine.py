import glob
import zipfile
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlake import queries as own
from gridlake import queries_more  # noqa: F401  registers its queries
from gridlake.errors import AuthoringError, GridlakeError, MalformedInput, UnsupportedFormat
from gridlake.functions import address, colors, dates, formula, values
from gridlake.operators import extent, facets, grid, outline, pivot, rules, tables
from gridlake.sources import csvgrid, parts, xlsx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {f.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(own.Q))
def test_query_matches_sql(spark, duck, name):
    got, want = own.Q[name](spark, SF).toPandas(), duck.execute(own.S[name]).df()
    cols = sorted(want.columns)
    canon = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert sorted(got.columns) == cols
    assert canon(got).equals(canon(want))


def test_csv_splitting():
    split = lambda t, d=",": list(csvgrid.split_rows(t, d))
    assert split("a;b;c\n1;2;3", ";") == [["a", "b", "c"], ["1", "2", "3"]]
    assert split('"a,b","he said ""hi""","line\nbreak"') == [["a,b", 'he said "hi"', "line\nbreak"]]
    assert split("a\r\nb\nc\rd\n") == [["a"], ["b"], ["cd"]]
    assert split("a\nb,c,d") == [["a"], ["b", "c", "d"]]
    assert split('x"y,z"w') == [["xy,zw"]]
    assert split('"open\nend') == [["open\nend"]]
    assert split("") == [] and split("\n") == [[""]] and split("a,\n") == [["a", ""]]


def test_csv_values(spark):
    fields = ["1", "-2.5e3", "007", "56343416020533614003", "1-3", "2018-02-31", "2018-01-05 12:30", "   ", "", "0099-01-02", "12\n"]
    got = [r["v"] for r in spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "i int, f string").withColumn("v", values.csv_value(F.col("f"))).orderBy("i").collect()]
    assert [g["kind"] for g in got] == ["number", "number", "number", "string", "string", "date", "date", "string", "null", "date", "string"]
    assert got[2]["num"] == 7 and got[5]["ts"] == datetime(2018, 3, 3) and got[6]["ts"] == datetime(2018, 1, 5, 12, 30) and got[9]["ts"] == datetime(1999, 1, 2)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name,age\n"a,b",7\n,2020-01-02\n')
    cells = csvgrid.read(spark, str(tmp_path / "x.csv"), header=True)
    assert {(r["row"], r["col"], r["kind"]) for r in cells.collect()} == {(1, 1, "string"), (1, 2, "number"), (2, 2, "date")}
    assert [r["line"] for r in csvgrid.lines(cells).orderBy("row").collect()] == ['"a,b",7', ",2020-01-02T00:00:00.000Z"]


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (12345678.0, "12345678"), (1e21, "1e+21"), (2e23, "2e+23"), (1e-7, "1e-7"), (0.000001, "0.000001"), (0.1, "0.1"), (-0.0, "0"), (123456.789, "123456.789"), (1e20, "1" + "0" * 20), (1.5e300, "1.5e+300")])
def test_number_text(x, text):
    assert values.number_text(x) == text


def test_addresses(spark):
    df = spark.createDataFrame([("$B$3",), ("XFD1",), ("A",), ("7",), ("xfe",), ("$",)], "a string").withColumn("d", address.decode_address(F.col("a")))
    assert [None if r["d"] is None else tuple(r["d"]) for r in df.collect()] == [(3, 2), (1, 16384), (None, 1), (7, None), None, None]
    r = spark.createDataFrame([("'It''s'!C5:A2",)], "a string").select(address.decode_range(F.col("a")).alias("r")).first()["r"]
    assert tuple(r) == ("It's", 2, 1, 5, 3)


def test_serials(spark):
    got = [r["t"] for r in spark.createDataFrame([(float(s),) for s in (1, 59, 60, 61, 45000.5)], "s double").select(dates.serial_to_date(F.col("s")).alias("t")).collect()]
    assert got == [datetime(1900, 1, 1), datetime(1900, 2, 28), datetime(1900, 2, 28), datetime(1900, 3, 1), datetime(2023, 3, 15, 12)]
    fmt = spark.createDataFrame([("yyyy-mm-dd",), ("0.00",), ("[Red]0",), ('"days"0',), (None,)], "c string").select(dates.is_date_format(F.col("c")).alias("x"))
    assert [r["x"] for r in fmt.collect()] == [True, False, False, False, False]


def test_formula_text():
    assert formula.translate('A1+$B2+C$3+$D$4+"A1"', 1, 1) == 'B2+$B3+D$3+$D$4+"A1"'
    assert formula.translate("LOG10(A1)+'A1'!B2+T[A1]", 0, 2) == "LOG10(A3)+'A1'!B4+T[A1]"
    assert formula.unmangle(formula.mangle("XLOOKUP(A1,B:B,C:C)+SUM(1)")) == "XLOOKUP(A1,B:B,C:C)+SUM(1)"
    assert formula.mangle("TEXTJOIN(A1)") == "_xlfn.TEXTJOIN(A1)"
    with pytest.raises(AuthoringError):
        formula.translate("A1", -1, 0)


def test_package_round_trip(spark, tmp_path):
    cells = spark.createDataFrame(
        [(1, 1, "string", None, "a & <b>", None), (1, 3, "number", 1.25, None, None), (2, 2, "date", None, None, datetime(2020, 1, 2)), (5, 1, "number", float("nan"), None, None)],
        "row int, col int, kind string, num double, str string, ts timestamp_ntz",
    )
    xlsx.write(cells, str(tmp_path / "a.xlsx"), "One")
    xlsx.write(cells, str(tmp_path / "b.xlsx"), "One")
    assert (tmp_path / "a.xlsx").read_bytes() == (tmp_path / "b.xlsx").read_bytes()
    got = {(r["row"], r["col"]): r for r in xlsx.read(spark, str(tmp_path / "a.xlsx")).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 2)}
    assert got[1, 1]["str"] == "a & <b>" and got[1, 3]["num"] == 1.25 and got[2, 2]["ts"] == datetime(2020, 1, 2) and got[2, 2]["kind"] == "date"
    assert xlsx.sheets(spark, str(tmp_path / "a.xlsx")).first()["sheet"] == "One"


def test_hostile_packages(tmp_path):
    with pytest.raises(UnsupportedFormat):
        list(xlsx.parse(bytes.fromhex("D0CF11E0A1B11AE1") + b"x"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", b"<workbook>" + b" " * 5_000_000 + b"</workbook>")
    data = (tmp_path / "z.zip").read_bytes()
    with pytest.raises(MalformedInput):
        list(xlsx.parse(data, limit=1_000_000))
    for n in range(4, len(data), 37):
        try:
            list(xlsx.parse(data[:n]))
        except GridlakeError:
            pass


def test_splices_and_merges(spark):
    m = spark.createDataFrame([(1, 1, 3, 1), (5, 1, 6, 1), (8, 1, 9, 1)], "top int, left int, bottom int, right int")
    got = {tuple(r) for r in grid.splice_merges(m, "row", 5, 2).select("top", "bottom").collect()}
    assert got == {(1, 3), (6, 7)}
    cells = spark.createDataFrame([(1, 1, "number", 1.0), (1, 2, "number", 2.0)], "row int, col int, kind string, num double")
    assert {(r["col"], r["num"]) for r in grid.merge_cells(cells, 1, 1, 1, 2).collect()} == {(1, 1.0), (2, None)}


def test_names_and_formulas():
    assert tables.disambiguate(["a", "A", "b", "a2", "a"]) == ["a", "A3", "b", "a2", "a4"]
    assert tables.subtotal_formula("count", "T", "x") == "SUBTOTAL(103,T[x])"
    assert pivot.caption("countNums", "Amount") == "Count of Amount"


def test_pivot_errors(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "a int, b int, c double")
    for bad in (([], ["b"], "c", "sum"), (["a"], ["z"], "c", "sum"), (["a"], ["b"], "c", "median")):
        with pytest.raises(AuthoringError):
            pivot.pivot_long(df, *bad)


def test_precedence(spark):
    m = spark.createDataFrame([(1, 1, 1, False), (1, 1, 2, True), (1, 1, 3, False)], "row int, col int, priority int, stop_if_true boolean")
    assert [r["priority"] for r in rules.precedence(m, ["row", "col"]).orderBy("priority").collect()] == [1, 2]


def test_outline(spark):
    rows = spark.createDataFrame([(1, 1, 1, True), (1, 2, 2, True), (1, 3, 0, False), (1, 4, 1, False), (1, 5, 0, None), (1, 7, 2, True), (1, 9, 0, False), (2, 1, None, None), (2, 2, 1, True)], "sheet_id int, row int, outline_level int, hidden boolean")
    after = {(r["sheet_id"], r["row"]) for r in outline.collapsed(rows, ["sheet_id"]).where("is_collapsed").collect()}
    before = {(r["sheet_id"], r["row"]) for r in outline.collapsed(rows, ["sheet_id"], summary_after=False).where("is_collapsed").collect()}
    assert after == {(1, 3)} and before == {(1, 1), (2, 1)}
    assert {r["sheet_id"]: r["max_level"] for r in outline.deepest(rows, ["sheet_id"]).collect()} == {1: 2, 2: 1}
    assert outline.collapsed(rows.limit(0), ["sheet_id"]).count() == 0


def test_colors(spark):
    import colorsys

    rows = [("FF4472C4", None, None, 0.4), ("#ed7d31", None, None, -0.25), ("80808080", None, None, 0.5), (None, 1, None, 0.35), (None, 0, None, -0.5), (None, None, 64, None), (None, None, 22, None), (None, 12, None, None), ("zz", 1, 1, None), (None, None, -1, None)]
    got = [r["c"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, argb string, theme int, indexed int, tint double").withColumn("c", colors.resolved(F.col("argb"), F.col("theme"), F.col("indexed"), F.col("tint"))).orderBy("i").collect()]

    def slow(argb, tint):
        h, l, s = colorsys.rgb_to_hls(*[int(argb[k : k + 2], 16) / 255 for k in (2, 4, 6)])
        l = l * (1 + tint) if tint < 0 else l * (1 - tint) + tint
        return argb[:2] + "".join(f"{int(x * 255 + 0.5):02X}" for x in colorsys.hls_to_rgb(h, l, s))

    assert got == [slow("FF4472C4", 0.4), slow("FFED7D31", -0.25), slow("80808080", 0.5), slow("FF000000", 0.35), slow("FFFFFFFF", -0.5), None, "FFC0C0C0", None, None, None]
    assert len(colors.PALETTE) == 64


def test_package_metadata(spark, tmp_path):
    cells = spark.createDataFrame([(1, 1, "number", 1.0, None, None)], "row int, col int, kind string, num double, str string, ts timestamp_ntz")
    xlsx.write(cells, str(tmp_path / "a.xlsx"), "One")
    with zipfile.ZipFile(tmp_path / "a.xlsx") as a, zipfile.ZipFile(tmp_path / "b.xlsx", "w") as b:
        for n in a.namelist():
            x = a.read(n).decode()
            x = x.replace("</sheets>", '</sheets><definedNames><definedName name="N" localSheetId="0" hidden="1">_xlfn.XLOOKUP(One!$A$1)</definedName><definedName name="M" localSheetId="7" comment="c">One!$B$2</definedName><definedName name="_xlnm._FilterDatabase">One!A1</definedName></definedNames>')
            b.writestr(n, x.replace("</sheetData>", '</sheetData><mergeCells><mergeCell ref="B2:C4"/><mergeCell ref="A:A"/><mergeCell ref="E9:D8"/></mergeCells>'))
        b.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:title>T</dc:title><dc:creator>me</dc:creator><dc:other>x</dc:other></c>')
        b.writestr("docProps/app.xml", "<p><Application>a</Application><Company>Co</Company></p>")
    path = str(tmp_path / "b.xlsx")
    assert {tuple(r)[1:] for r in xlsx.defined_names(spark, path).collect()} == {("N", "XLOOKUP(One!$A$1)", "One", True, None), ("M", "One!$B$2", None, False, "c")}
    assert [tuple(r)[1:] for r in xlsx.merges(spark, path).orderBy("idx").collect()] == [(1, 0, 2, 2, 4, 3), (1, 1, 8, 4, 9, 5)]
    assert {tuple(r)[1:] for r in xlsx.workbook_props(spark, path).collect()} == {("title", "T"), ("creator", "me"), ("company", "Co")}
    assert xlsx.merges(spark, str(tmp_path / "a.xlsx")).count() == 0


KINDS = "row int, col int, kind string, num double, str string, bool boolean, ts timestamp_ntz, err string, formula string, result_kind string"


def test_all_kinds_survive_the_package(spark, tmp_path):
    rows = [
        (1, 1, "number", 1.5, None, None, None, None, None, None), (1, 2, "string", None, " a <b> & c ", None, None, None, None, None), (1, 3, "boolean", None, None, True, None, None, None, None), (1, 4, "boolean", None, None, False, None, None, None, None),
        (2, 1, "date", None, None, None, datetime(2021, 5, 6, 12), None, None, None), (2, 2, "error", None, None, None, None, "#N/A", None, None), (2, 3, "richText", None, "bold text", None, None, None, None, None), (2, 4, "hyperlink", None, "here", None, None, None, None, None),
        (3, 1, "formula", 3.0, None, None, None, None, "A1*2", "number"), (3, 2, "formula", None, "x", None, None, None, 'CONCAT("x")', "string"), (3, 3, "formula", None, None, None, None, None, "B1", None), (3, 4, "formula", None, None, True, None, None, "TRUE()", "boolean"),
        (4, 1, "number", float("inf"), None, None, None, None, None, None),
    ]
    xlsx.write(spark.createDataFrame(rows, KINDS), str(tmp_path / "k.xlsx"))
    got = {(r["row"], r["col"]): r for r in xlsx.read(spark, str(tmp_path / "k.xlsx")).collect()}
    value = lambda r: next((r[c] for c in ("num", "str", "bool", "ts", "err") if r[c] is not None), None)
    assert {k: (r["kind"], value(r)) for k, r in got.items()} == {
        (1, 1): ("number", 1.5), (1, 2): ("string", " a <b> & c "), (1, 3): ("boolean", True), (1, 4): ("boolean", False), (2, 1): ("date", datetime(2021, 5, 6, 12)), (2, 2): ("error", "#N/A"), (2, 3): ("string", "bold text"),
        (2, 4): ("string", "here"), (3, 1): ("formula", 3.0), (3, 2): ("formula", "x"), (3, 3): ("formula", None), (3, 4): ("formula", True),
    }
    assert [got[3, c]["formula"] for c in (1, 2, 3, 4)] == ["A1*2", 'CONCAT("x")', "B1", "TRUE()"] and got[3, 1]["result_kind"] == "number"
    with zipfile.ZipFile(tmp_path / "k.xlsx") as z:
        assert b'_xlfn.CONCAT("x")' in z.read("xl/worksheets/sheet1.xml")


REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(path, sheet, more=(), rels="", book="book/workbook.xml"):
    """A package whose workbook stands where its own relationships say."""
    folder = book.rsplit("/", 1)[0]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="r" Type="{REL}/officeDocument" Target="/{book}"/></Relationships>')
        z.writestr(book, f'<workbook xmlns:r="{REL}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr(f"{folder}/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="sheets/s1.xml"/><Relationship Id="rId2" Target="styles.xml"/><Relationship Id="rId3" Target="persons/person.xml"/></Relationships>')
        z.writestr(f"{folder}/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="31"/></cellXfs></styleSheet>')
        z.writestr(f"{folder}/sheets/s1.xml", f'<worksheet xmlns:r="{REL}">{sheet}</worksheet>')
        z.writestr(f"{folder}/sheets/_rels/s1.xml.rels", f"<Relationships>{rels}</Relationships>")
        for name, text in more:
            z.writestr(name, text)
    return str(path)


def test_reader_of_unusual_packages(spark, tmp_path):
    data = '<sheetData><row r="1"><c r="A1" s="1"><v>44000</v></c><c><v>9</v></c><c r="C1"><f t="shared" si="0" ref="C1:C3">A1+$B$1</f><v>1</v></c></row><row r="2"><c r="C2"><f t="shared" si="0"/><v>2</v></c><c r="D2"><f t="shared" si="7"/><v>5</v></c></row></sheetData>'
    got = {(r["row"], r["col"]): r for r in xlsx.read(spark, package(tmp_path / "a.xlsx", data)).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 3), (2, 4)}  # a cell without a place is dropped
    assert got[1, 1]["kind"] == "date" and got[1, 1]["ts"] == datetime(2020, 6, 18)
    assert (got[2, 3]["formula"], got[2, 3]["shared_master"], got[2, 3]["num"]) == ("A2+$B$1", "C1", 2.0)
    assert (got[2, 4]["kind"], got[2, 4]["num"]) == ("number", 5.0)
    bad = package(tmp_path / "b.xlsx", "", book="x/workbook.xml")
    with zipfile.ZipFile(bad, "a") as z:
        z.writestr("x/sheets/s2.xml", "")
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<!--" + "c" * 5000 + '--><!DOCTYPE w [<!ENTITY e "boom">]><w>&e;</w>')
    with pytest.raises(MalformedInput):
        list(xlsx.parse((tmp_path / "c.xlsx").read_bytes()))


def test_facets_of_a_package(spark, tmp_path):
    sheet = """<cols><col min="2" max="3" width="9.5" hidden="1"/></cols><sheetData><row r="3" ht="20" outlineLevel="1"/><row r="4"/></sheetData>
    <autoFilter ref="A1:B9"><filterColumn colId="0"><filters blank="1"><filter val="x"/></filters></filterColumn><filterColumn colId="1"><customFilters and="1"><customFilter operator="greaterThan" val="3"/><customFilter val="7"/></customFilters></filterColumn><filterColumn colId="5"><filters><filter val="y"/></filters></filterColumn><filterColumn colId="1"><top10 val="3"/></filterColumn></autoFilter>
    <conditionalFormatting sqref="A1:A9 C3"><cfRule type="top10" priority="2" rank="4" percent="1"/><cfRule type="expression" priority="1" stopIfTrue="1"><formula>_xlfn.XOR(A1)</formula></cfRule></conditionalFormatting>
    <dataValidations><dataValidation type="whole" sqref="B2:B20" allowBlank="1"><formula1>0</formula1><formula2>100</formula2></dataValidation></dataValidations>
    <hyperlinks><hyperlink ref="A2" r:id="h1" tooltip="t"/><hyperlink ref="A3" r:id="gone"/><hyperlink ref="A4" location="S!A1"/></hyperlinks>"""
    rels = "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in (("h1", "http://a.test/?x=1"), ("t1", "../tables/table1.xml"), ("c1", "../comments1.xml"), ("d1", "../threadedComments/t1.xml"), ("p1", "../pivotTables/p1.xml"), ("g1", "../drawings/d1.xml")))
    more = [
        ("book/tables/table1.xml", '<table name="T" displayName="T" ref="C3:D6" totalsRowCount="1"><tableColumns><tableColumn name="Item" totalsRowLabel="All"/><tableColumn name="Qty" totalsRowFunction="sum"/></tableColumns></table>'),
        ("book/comments1.xml", '<comments><authors><author>Ann</author></authors><commentList><comment ref="B2" authorId="0"><text><r><t>hi </t></r><r><t>you</t></r></text></comment></commentList></comments>'),
        ("book/threadedComments/t1.xml", '<ThreadedComments><threadedComment ref="B2" id="{1}" personId="{P}"><text>q</text></threadedComment><threadedComment ref="B2" id="{2}" parentId="{1}" personId="{X}" done="1"><text>a</text></threadedComment></ThreadedComments>'),
        ("book/persons/person.xml", '<personList><person id="{P}" displayName="Pat"/></personList>'),
        ("book/pivotTables/p1.xml", '<pivotTableDefinition name="P"><rowFields><field x="0"/></rowFields><colFields><field x="1"/></colFields><dataFields><dataField name="Sum of Q" fld="2"/></dataFields></pivotTableDefinition>'),
        ("book/pivotTables/_rels/p1.xml.rels", '<Relationships><Relationship Id="r" Target="../pivotCache/pivotCacheDefinition1.xml"/></Relationships>'),
        ("book/pivotCache/pivotCacheDefinition1.xml", '<c><cacheSource><worksheetSource ref="A1:C9" sheet="S"/></cacheSource><cacheFields><cacheField name="a"/><cacheField name="b"/><cacheField name="Q"/></cacheFields></c>'),
        ("book/drawings/d1.xml", f'<w xmlns:r="{REL}"><twoCellAnchor><from><col>1</col><row>2</row></from><to><col>3</col><row>4</row></to><pic><blip r:embed="i1"/></pic></twoCellAnchor></w>'),
        ("book/drawings/_rels/d1.xml.rels", '<Relationships><Relationship Id="i1" Target="../media/image1.png"/></Relationships>'), ("book/vbaProject.bin", "macro"), ("customUI/customUI.xml", "<x/>"),
    ]
    path = package(tmp_path / "f.xlsx", sheet, more, rels)
    load = lambda what: [tuple(r)[1:] for r in parts.load(spark, path, what).collect()]
    assert load("row_props") == [(1, 3, 20.0, False, 1, False)] and [r[:4] for r in load("col_props")] == [(1, 2, 9.5, True), (1, 3, 9.5, True)]
    assert load("tables") == [(1, "T", "T", 3, 3, 2, True, True, ["Item", "Qty"], ["All", None], [None, "sum"], [None, None])]
    assert load("hyperlinks") == [(1, 2, 1, 2, 1, "http://a.test/?x=1", None, "t"), (1, 4, 1, 4, 1, None, "S!A1", None)]
    assert load("comments") == [(1, 2, 2, "Ann", "hi you")] and load("persons") == [("{P}", "Pat", None, None)]
    talk = facets.resolve_authors(facets.threads(parts.load(spark, path, "threads")), parts.load(spark, path, "persons")).orderBy("message_id").collect()
    assert [(r["thread_id"], r["author"], r["person_id"], r["done"]) for r in talk] == [("{1}", "Pat", "{P}", False), ("{1}", None, "{X}", True)]
    assert [r[3:10] for r in load("validations")] == [(2, 2, 20, 2, "whole", "between", ["0", "100"])]
    assert [(r[1:7], r[7], r[8], r[9], r[11]) for r in load("conditional_formats")] == [((0, 0, 1, 1, 9, 1), "top10", 2, False, []), ((0, 1, 3, 3, 3, 3), "top10", 2, False, []), ((1, 0, 1, 1, 9, 1), "expression", 1, True, ["XOR(A1)"]), ((1, 1, 3, 3, 3, 3), "expression", 1, True, ["XOR(A1)"])]
    assert [r[5:] for r in load("filters")] == [(0, ["x"], True, False, []), (1, [], False, True, [("greaterThan", "3"), (None, "7")])]
    assert load("pivots") == [(1, "P", "S", "A1:C9", ["a", "b", "Q"], [0], [1], 2, "sum", "Sum of Q")]
    assert load("images") == [(1, 2, 1, 4, 3, "book/media/image1.png")] and sorted(r[0] for r in load("preserved")) == ["ribbon", "vba"]


def test_refusals(spark):
    for args in ((0, 5, 0, 1), (3, 5, 3, 1), (3, 5, 0, 3), (3, 5, 0, 0)):
        with pytest.raises(AuthoringError):
            facets.check_filter(*args)
    facets.check_filter(3, 5, 2, 2)
    m = spark.createDataFrame([(1, 1, 2, 2)], "top int, left int, bottom int, right int")
    facets.check_merge(m, 3, 1, 4, 2)
    with pytest.raises(AuthoringError):
        facets.check_merge(m, 2, 2, 3, 3)
    assert facets.field_index(["a", "b", "a"], "a") == 0
    with pytest.raises(AuthoringError):
        facets.field_index(["a"], "z")
    rows = spark.createDataFrame([(1, {"k": "v", "z": "w"})], "row int, m map<string,string>")
    assert facets.from_keyed(rows, "m", {"k": 4}, known=False).collect() == [(1, 4, "v")]
    with pytest.raises(Exception, match="no column has the key z"):
        facets.from_keyed(rows, "m", {"k": 4}).collect()
    for text in ("A2>1", "$A$2", "VLOOKUP(A1)", "A1+", "(A1", "A1 A1"):
        with pytest.raises(AuthoringError):
            rules.expression(text, 1, {1: F.lit(1)})
    t = spark.range(1).select(rules.expression('=AND($A1>=2,LEN(B1&"x")=3,NOT(B1="q"),MOD(-1,3)=2)', 1, {1: F.lit(2), 2: F.lit("ab")}).alias("x")).first()
    assert t["x"] is True
    empty = spark.createDataFrame([], "row int, col int, kind string")
    assert facets.used_range(empty).count() == 0 and extent.tight_box(empty).first()["top"] is None
    assert facets.table_row_at(spark.createDataFrame([(1, 1, 2, True, True, 3)], "top int, left int, data_rows int, header_row boolean, totals_row boolean, columns int"), F.lit(3)).first()["insert_at"] == 4


def test_line_values_of_long_and_gappy_lines(spark):
    """Work in proportion to the line: tens of thousands of cells with gaps take seconds, maps are values too."""
    import time

    cells = spark.createDataFrame([(2, 1, "a"), (5, 1, None), (0, 2, "below"), (0, 3, "below"), (3, 3, "c")], "row int, col int, str string")
    got = {r["col"]: r["values"] for r in facets.line_values(cells, F.create_map(F.lit("s"), F.col("str")), "col").collect()}
    a, none, c = {"s": "a"}, {"s": None}, {"s": "c"}
    assert got == {1: [None, a, None, None, none], 2: [], 3: [None, None, c]}
    n, at = 40_000, time.time()
    long = spark.range(n).select((n - F.col("id")).cast("int").alias("k"), F.lit(1).alias("col")).select((F.col("k") * 3).alias("row"), "col", "k")
    values = facets.line_values(long, F.col("k"), "col").first()["values"]
    assert len(values) == 3 * n and values[2::3] == list(range(1, n + 1)) and values[0::3] == values[1::3] == [None] * n
    assert time.time() - at < 30
    with pytest.raises(Exception, match="two cells at one position"):
        facets.line_values(cells.unionByName(cells), F.col("str"), "col").collect()
