"""Spreadsheet packages (xlsx) as cells. Files are read by Spark, parsed on the executors, a file a task.

The container is told by its first bytes, parts are inflated under a cap on what really comes out, and XML with
entity declarations is refused.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.errors import MalformedInput, UnsupportedFormat
from gridlake.functions.dates import BUILTIN_FORMATS
from gridlake.functions.formula import translate, unmangle
from gridlake.functions.values import ERRORS
from gridlake.session import ship_package

CELLS = "workbook string, sheet_id int, sheet string, state string, row int, col int, kind string, num double, str string, bool boolean, ts timestamp_ntz, err string, formula string, result_kind string, num_fmt string, style_id int, shared_master string"
LIMIT, STEP = 512 << 20, 1 << 20


def sniff(data: bytes) -> str:
    """zip, or an error for other containers."""
    if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        raise UnsupportedFormat("a compound file: old or encrypted workbooks are not read")
    if data[:4] != b"PK\x03\x04":
        raise UnsupportedFormat("not a zip package")
    return "zip"


class Package:
    def __init__(self, data: bytes, limit: int = LIMIT) -> None:
        sniff(data)
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as x:
            raise MalformedInput(str(x)) from x
        self.names = {n.lower(): n for n in self.zip.namelist()}
        self.left = limit

    def part(self, name: str) -> bytes | None:
        real = self.names.get(name.lstrip("/").lower())
        if real is None:
            return None
        out = []
        try:
            with self.zip.open(real) as f:
                while piece := f.read(STEP):
                    self.left -= len(piece)
                    if self.left < 0:
                        raise MalformedInput("the package inflates beyond its limit")
                    out.append(piece)
        except (zipfile.BadZipFile, EOFError, OSError, RuntimeError, ValueError, NotImplementedError) as x:
            raise MalformedInput(str(x)) from x
        return b"".join(out)

    def events(self, name: str) -> Iterator[tuple[str, ET.Element]]:
        data = self.part(name)
        if data is None:
            return
        parser = ET.XMLPullParser(events=("start", "end"))

        def refused(*_: object) -> None:
            raise MalformedInput(f"{name}: entity declarations are refused")

        try:
            if _declares_entities(data):
                refused()
            for at in range(0, len(data), STEP):
                parser.feed(data[at : at + STEP])
                yield from parser.read_events()
            parser.close()
            yield from parser.read_events()
        except ET.ParseError as x:
            raise MalformedInput(f"{name}: {x}") from x

    def rels(self, name: str) -> dict[str, str]:
        folder, _, base = name.rpartition("/")
        out = {}
        for ev, el in self.events(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels"):
            if ev == "end" and _local(el) == "Relationship":
                t = el.get("Target", "")
                out[el.get("Id", "")] = t.lstrip("/") if t.startswith("/") else re.sub(r"[^/]+/\.\./", "", f"{folder}/{t}" if folder else t)
        return out

    def book(self) -> str:
        """The workbook part, by the package's own relationships; the usual place where they name none."""
        return next((t for t in self.rels("").values() if re.search(r"workbook[^/]*\.xml$", t, re.I)), "xl/workbook.xml")


def _declares_entities(data: bytes) -> bool:
    """Whether the part declares an entity, wherever the declaration stands: expat reads the part up to its first element."""
    from xml.parsers import expat

    class Root(Exception):
        pass

    found: list[bool] = []

    def root(*_: object) -> None:
        raise Root

    p = expat.ParserCreate()
    p.EntityDeclHandler = lambda *_: found.append(True)
    p.StartElementHandler = root
    try:
        p.Parse(data, True)
    except (Root, expat.ExpatError):
        pass
    return bool(found)


def _local(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2]


def _attr(el: ET.Element, name: str) -> str | None:
    return next((v for k, v in el.attrib.items() if k.rpartition("}")[2] == name), None)


def _strings(p: Package, name: str | None) -> list[tuple[str, bool]]:
    out: list[tuple[str, bool]] = []
    for ev, el in p.events(name) if name else ():
        if ev == "end" and _local(el) == "si":
            runs = [c for c in el if _local(c) == "r"]
            text = "".join(t.text or "" for c in (runs or [el]) for t in c if _local(t) == "t")
            out.append((text, bool(runs)))
            el.clear()
    return out


def _formats(p: Package, name: str | None) -> list[str | None]:
    own: dict[int, str] = {}
    out: list[str | None] = []
    inside = False
    for ev, el in p.events(name) if name else ():
        tag = _local(el)
        if tag == "cellXfs":
            inside = ev == "start"
        elif ev == "end" and tag == "numFmt":
            own[int(el.get("numFmtId", 0))] = el.get("formatCode", "")
        elif ev == "start" and tag == "xf" and inside:
            n = int(el.get("numFmtId") or 0)
            out.append(own.get(n) or BUILTIN_FORMATS.get(n))
    return out


def _is_date(code: str | None) -> bool:
    return bool(code) and bool(re.search("[ymdhs]", re.sub(r'\\.|"[^"]*"|\[[^\]]*\]', "", code), re.I))


def serial(x: float) -> datetime | None:
    try:
        return datetime(1899, 12, 30) + timedelta(milliseconds=round((x + 1 if x < 60 else x) * 86_400_000))
    except OverflowError:
        return None


_REF = re.compile(r"^([A-Z]{1,3})(\d+)$")


def _decode(kind: str | None, text: str | None, inline: str | None, strings: list, fmt: str | None) -> dict:
    """kind and value of a cell by its stored type."""
    if kind == "inlineStr":
        return {"kind": "string", "str": inline or ""}
    if text is None:
        return {"kind": "null"}
    if kind == "s":
        i = int(text) if text.strip().isdigit() else -1
        s, rich = strings[i] if 0 <= i < len(strings) else ("", False)
        return {"kind": "richText" if rich else "string", "str": s}
    if kind == "str":
        return {"kind": "string", "str": text}
    if kind == "b":
        return {"kind": "boolean", "bool": text.strip() in ("1", "true")}
    if kind == "e":
        return {"kind": "error", "err": text} if text in ERRORS else {"kind": "string", "str": text}
    if kind == "d":
        try:
            return {"kind": "date", "ts": datetime.fromisoformat(text.replace("Z", ""))}
        except ValueError:
            return {"kind": "date", "ts": None}
    try:
        x = float(text)
    except ValueError:
        return {"kind": "string", "str": text}
    return {"kind": "date", "ts": serial(x)} if _is_date(fmt) else {"kind": "number", "num": x}


def sheets_of(p: Package) -> list[tuple[int, str, str, str]]:
    """(number, name, state, part) in workbook order."""
    book = p.book()
    rels, out = p.rels(book), []
    for ev, el in p.events(book):
        if ev == "end" and _local(el) == "sheet":
            out.append((len(out) + 1, el.get("name", ""), el.get("state", "visible"), rels.get(_attr(el, "id") or "", "")))
    return out


def parse(data: bytes, sheet: str | int | None = None, limit: int = LIMIT) -> Iterator[dict]:
    """Cells of the sheets (or of one, by name or number), row by row."""
    p = Package(data, limit)
    rels = p.rels(p.book())
    strings = _strings(p, next((t for t in rels.values() if t.lower().endswith("sharedstrings.xml")), None))
    formats = _formats(p, next((t for t in rels.values() if t.lower().endswith("styles.xml")), None))
    for number, name, state, part in sheets_of(p):
        if sheet is not None and sheet not in (number, name):
            continue
        columns: dict[int, int] = {}
        row_style: int | None = None
        masters: dict[str, tuple[str, int, int, str]] = {}
        for ev, el in p.events(part) if part else ():
            tag = _local(el)
            if ev == "start" and tag == "col" and el.get("style"):
                columns |= dict.fromkeys(range(int(el.get("min", 1)), min(int(el.get("max", 1)), 16384) + 1), int(el.get("style")))
            elif ev == "start" and tag == "row":
                row_style = int(el.get("s")) if el.get("customFormat") in ("1", "true") and el.get("s") else None
            elif ev == "end" and tag == "c":
                m = _REF.match(el.get("r") or "")
                if not m:  # a cell that does not say where it stands is dropped
                    continue
                col, row = _column(m[1]), int(m[2])
                style = int(el.get("s")) if el.get("s") else row_style if row_style is not None else columns.get(col, 0)
                fmt = formats[style] if style < len(formats) else None
                by = {_local(c): c for c in el}
                inline = "".join(t.text or "" for t in by["is"].iter() if _local(t) == "t") if "is" in by else None
                got = _decode(el.get("t"), by["v"].text if "v" in by else None, inline, strings, fmt)
                if "f" in by:
                    f, si = by["f"].text or "", by["f"].get("si") if by["f"].get("t") == "shared" else None
                    if f and si is not None:
                        masters[si] = (f, col, row, m[0])
                    if f or si is None:
                        got |= {"formula": unmangle(f), "result_kind": got["kind"], "kind": "formula"}
                    elif si in masters:  # a clone: its master's formula, moved; without a master the cached value is all there is
                        text, of_col, of_row, at = masters[si]
                        got |= {"formula": unmangle(translate(text, col - of_col, row - of_row)), "result_kind": got["kind"], "kind": "formula", "shared_master": at}
                if got["kind"] != "null" and col <= 16384 and row <= 1048576:
                    yield {"sheet_id": number, "sheet": name, "state": state, "row": row, "col": col, "num_fmt": fmt, "style_id": style} | got
            elif ev == "end" and tag == "row":
                el.clear()


_COLUMNS = [c.split()[0] for c in CELLS.split(", ")]


def read(spark: SparkSession, path: str, sheet: str | int | None = None, limit: int = LIMIT) -> DataFrame:
    """Canonical cells of the packages at a path."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["path"], p["content"]):
                held = []
                for c in parse(data, sheet, limit):
                    held.append({"workbook": name} | c)
                    if len(held) == 10_000:
                        yield pd.DataFrame([[c.get(k) for k in _COLUMNS] for c in held], columns=_COLUMNS, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame([[c.get(k) for k in _COLUMNS] for c in held], columns=_COLUMNS, dtype=object)

    return files.mapInPandas(cells, CELLS)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """workbook, sheet_id, sheet, state: also of sheets without cells."""
    ship_package(spark)

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(n, i, s, st) for n, d in zip(p["path"], p["content"]) for i, s, st, _ in sheets_of(Package(d))], columns=["workbook", "sheet_id", "sheet", "state"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(listed, "workbook string, sheet_id int, sheet string, state string")


def names_of(p: Package) -> list[tuple]:
    """(name, refers_to, scope, hidden, comment); the name that a sheet's filter brings is no name of the user's."""
    rows = sheets_of(p)
    book = p.book()
    out = []
    for ev, el in p.events(book):
        if ev == "end" and _local(el) == "definedName" and el.get("name") not in (None, "_xlnm._FilterDatabase"):
            at = el.get("localSheetId", "")
            scope = rows[int(at)][1] if at.isdigit() and int(at) < len(rows) else None
            out.append((el.get("name"), unmangle(el.text or ""), scope, el.get("hidden") in ("1", "true"), el.get("comment")))
    return out


def merges_of(p: Package) -> list[tuple]:
    """(sheet_id, idx, top, left, bottom, right), by sheet and place in the part; refs that are no rectangle are left out."""
    out = []
    for number, _, _, part in sheets_of(p):
        at = 0
        for ev, el in p.events(part) if part else ():
            if ev == "end" and _local(el) == "mergeCell":
                ends = [_REF.match(x) for x in (el.get("ref") or "").replace("$", "").split(":")]
                if len(ends) == 2 and all(ends):
                    rows, cols = sorted(int(m[2]) for m in ends), sorted(_column(m[1]) for m in ends)
                    out.append((number, at, rows[0], cols[0], rows[1], cols[1]))
                    at += 1
    return out


def properties_of(p: Package) -> list[tuple]:
    """(property, value): title, creator, lastModifiedBy, created and modified of the core part, Company of the extended one."""
    wanted = (("docProps/core.xml", {"title", "creator", "lastModifiedBy", "created", "modified"}), ("docProps/app.xml", {"Company"}))
    return [(_local(el)[0].lower() + _local(el)[1:], el.text or "") for part, names in wanted for ev, el in p.events(part) if ev == "end" and _local(el) in names]


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def _listed(spark: SparkSession, path: str, of, schema: str) -> DataFrame:
    """What a function finds in each package, a row each, with the package's path first."""
    ship_package(spark)
    names = ["workbook"] + [c.split()[0] for c in schema.split(", ")]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(n, *r) for n, d in zip(p["path"], p["content"]) for r in of(Package(d))], columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"workbook string, {schema}")


def defined_names(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, names_of, "name string, refers_to string, scope string, hidden boolean, comment string")


def merges(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, merges_of, "sheet_id int, idx int, top int, left int, bottom int, right int")


def workbook_props(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, properties_of, "property string, value string")


# --- sink ---

def _xml(column: str):
    return _xml_of(F.col(column))


def _xml_of(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def rendered_rows(cells: DataFrame) -> DataFrame:
    """row, xml: sheet rows rendered by Spark tasks. Numbers that are not finite and invalid dates become empty cells;
    rich text and links are written as their text, formulas with their cached result."""
    from gridlake.functions.address import encode_address
    from gridlake.functions.dates import date_to_serial
    from gridlake.functions.formula import mangled
    from gridlake.functions.values import js_number

    ref = encode_address(F.col("row"), F.col("col"))
    has_formula = {"formula", "result_kind"} <= set(cells.columns)
    cells = cells.withColumns({c: F.lit(None).cast(t) for c, t in (("bool", "boolean"), ("err", "string"), ("ts", "timestamp_ntz")) if c not in cells.columns})
    dated = (F.col("kind") == "date") | (F.col("result_kind") == "date") if has_formula else F.col("kind") == "date"
    number = F.when(F.coalesce(dated, F.lit(False)), date_to_serial(F.col("ts"))).otherwise(F.col("num"))
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    formula = F.when(F.col("kind") == "formula", F.concat(F.lit("<f>"), F.coalesce(_xml_of(mangled(F.col("formula"))) if has_formula else F.lit(""), F.lit("")), F.lit("</f>"))).otherwise(F.lit(""))
    kind = F.when(F.col("kind") == "formula", F.coalesce(F.col("result_kind"), F.lit("null"))).otherwise(F.col("kind")) if has_formula else F.col("kind")
    cached = F.col("kind") == "formula"
    text = F.concat(F.lit(' t="str">'), formula, F.lit("<v>"), _xml("str"), F.lit("</v></c>"))
    inline = F.concat(F.lit(' t="inlineStr"><is><t xml:space="preserve">'), _xml("str"), F.lit("</t></is></c>"))
    body = F.when(kind.isin("string", "richText", "hyperlink"), F.when(cached, text).otherwise(inline))
    body = body.when(kind.isin("number", "date") & finite, F.concat(F.when(kind == "date", ' s="1">').otherwise(">"), formula, F.lit("<v>"), js_number(number), F.lit("</v></c>")))
    body = body.when(kind == "boolean", F.concat(F.lit(' t="b">'), formula, F.lit("<v>"), F.when(F.col("bool"), "1").otherwise("0"), F.lit("</v></c>")))
    body = body.when(kind == "error", F.concat(F.lit(' t="e">'), formula, F.lit("<v>"), _xml("err"), F.lit("</v></c>")))
    body = F.coalesce(body, F.when(cached, F.concat(F.lit(">"), formula, F.lit("</c>"))), F.lit("/>"))
    one = F.concat(F.lit('<c r="'), ref, F.lit('"'), body)
    rows = cells.select("row", F.struct("col", one.alias("x")).alias("c")).groupBy("row").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    return rows.select("row", F.concat(F.lit('<row r="'), F.col("row").cast("string"), F.lit('">'), F.array_join(F.transform("cs", lambda c: c["x"]), ""), F.lit("</row>")).alias("xml"))


def write(cells: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """One sheet to a local package: the driver only joins rendered rows, one partition at a time. Same cells, same bytes."""
    def info(name: str) -> zipfile.ZipInfo:
        i = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        i.compress_type = zipfile.ZIP_DEFLATED
        return i

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    safe = sheet.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    if not 1 <= len(sheet) <= 31 or re.search(r"[*?:\\/\[\]]", sheet) or sheet[0] == "'" or sheet[-1] == "'":
        from gridlake.errors import AuthoringError

        raise AuthoringError(f"no valid sheet name: {sheet!r}")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(info("[Content_Types].xml"), head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        z.writestr(info("_rels/.rels"), head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr(info("xl/workbook.xml"), head + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{safe}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr(info("xl/_rels/workbook.xml.rels"), head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr(info("xl/styles.xml"), head + f'<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>')
        with z.open(info("xl/worksheets/sheet1.xml"), "w") as f:
            f.write((head + f'<worksheet xmlns="{main}"><sheetData>').encode())
            for r in rendered_rows(cells).orderBy("row").select("xml").toLocalIterator():
                f.write(r["xml"].encode())
            f.write(b"</sheetData></worksheet>")
