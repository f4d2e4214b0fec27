"""What a package says beside its cells: lines, tables, links, comments, people, rules, filters, pivots, images, as tables.

Each loader reads the packages at a path, a file a task, and gives a row for each thing found. Readers are lenient:
what has no usable reference is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridlake.functions.formula import unmangle
from gridlake.sources.xlsx import Package, _attr, _column, _listed, _local, sheets_of

_CELL = re.compile(r"^\$?([A-Z]{1,3})\$?(\d+)$")


def rect(ref: str | None) -> tuple[int, int, int, int] | None:
    """top, left, bottom, right of A1 or A1:B2."""
    ends = [_CELL.match(x) for x in (ref or "").split(":")]
    if len(ends) not in (1, 2) or not all(ends):
        return None
    rows, cols = sorted(int(m[2]) for m in ends), sorted(_column(m[1]) for m in ends)
    return rows[0], cols[0], rows[-1], cols[-1]


def _yes(v: str | None) -> bool:
    return v in ("1", "true")


def _number(v: str | None, kind=int):
    try:
        return kind(v)
    except (TypeError, ValueError):
        return None


def _found(p: Package, part: str, *names: str):
    """Elements of these names, whole."""
    if part:
        for ev, el in p.events(part):
            if ev == "end" and _local(el) in names:
                yield el


def _targets(p: Package, part: str, suffix: str) -> list[str]:
    return [t for t in p.rels(part).values() if re.search(suffix, t, re.I)] if part else []


def _row_props(p: Package):
    for number, _, _, part in sheets_of(p):
        for ev, el in p.events(part) if part else ():
            if ev == "start" and _local(el) == "row" and (r := _number(el.get("r"))):
                own = (_number(el.get("ht"), float), _yes(el.get("hidden")), _number(el.get("outlineLevel")) or 0, _yes(el.get("collapsed")))
                if own != (None, False, 0, False):
                    yield (number, r, *own)


def _col_props(p: Package):
    for number, _, _, part in sheets_of(p):
        for el in _found(p, part, "col"):
            low, high = _number(el.get("min")), _number(el.get("max"))
            for c in range(low, min(high, 16384) + 1) if low and high else ():
                yield (number, c, _number(el.get("width"), float), _yes(el.get("hidden")), _number(el.get("outlineLevel")) or 0, _yes(el.get("collapsed")))


def _tables(p: Package):
    for number, _, _, part in sheets_of(p):
        for at in _targets(p, part, r"tables?/[^/]+\.xml$"):
            for el in _found(p, at, "table"):
                box = rect(el.get("ref"))
                if box is None:
                    continue
                header, totals = el.get("headerRowCount") != "0", (_number(el.get("totalsRowCount")) or 0) > 0
                columns = [c for x in el if _local(x) == "tableColumns" for c in x]
                rows = box[2] - box[0] + 1 - header - totals
                formulas = [next((x.text or "" for x in c if _local(x) == "totalsRowFormula"), None) for c in columns]
                yield (number, el.get("name"), el.get("displayName"), box[0], box[1], max(0, rows), header, totals, [c.get("name") for c in columns], [c.get("totalsRowLabel") for c in columns], [c.get("totalsRowFunction") for c in columns], formulas)


def _links(p: Package):
    for number, _, _, part in sheets_of(p):
        rels = p.rels(part) if part else {}
        external = {el.get("Id"): el.get("Target") for el in _found(p, re.sub(r"([^/]+)$", r"_rels/\1.rels", part), "Relationship")} if part else {}
        for el in _found(p, part, "hyperlink"):
            rid, box = _attr(el, "id"), rect(el.get("ref"))
            target = external.get(rid) if rid else None
            if box and (target or el.get("location")) and (not rid or rid in rels):
                yield (number, *box, target, el.get("location"), el.get("tooltip"))


def _comments(p: Package):
    for number, _, _, part in sheets_of(p):
        for at in _targets(p, part, r"/comments[^/]*\.xml$"):
            authors = [el.text or "" for el in _found(p, at, "author")]
            for el in _found(p, at, "comment"):
                box, who = rect(el.get("ref")), _number(el.get("authorId"))
                if box:
                    text = "".join(t.text or "" for t in el.iter() if _local(t) == "t")
                    yield (number, box[0], box[1], authors[who] if who is not None and 0 <= who < len(authors) else None, text)


def _threads(p: Package):
    for number, _, _, part in sheets_of(p):
        for at in _targets(p, part, r"/threadedComments?/?[^/]*\.xml$"):
            for el in _found(p, at, "threadedComment"):
                box = rect(el.get("ref"))
                if box:
                    yield (number, box[0], box[1], el.get("id"), el.get("parentId"), el.get("personId"), next((t.text or "" for t in el if _local(t) == "text"), ""), _yes(el.get("done")))


def _persons(p: Package):
    for at in _targets(p, p.book(), r"persons?/[^/]+\.xml$"):
        for el in _found(p, at, "person"):
            yield (el.get("id"), el.get("displayName"), el.get("userId"), el.get("providerId"))


def _validations(p: Package):
    for number, _, _, part in sheets_of(p):
        for k, el in enumerate(_found(p, part, "dataValidation")):
            inner = {_local(x): x for x in el.iter()}
            ref = el.get("sqref") or (inner["sqref"].text if "sqref" in inner else "") or ""
            operands = []
            for name in ("formula1", "formula2"):
                if name in inner:
                    text = "".join(inner[name].itertext()).strip()
                    operands.append(unmangle(text.removeprefix("=")))
            for j, box in enumerate(filter(None, map(rect, ref.split()))):
                yield (number, k, j, *box, el.get("type", "none"), el.get("operator", "between"), operands, _yes(el.get("allowBlank")), el.get("errorStyle", "stop"), el.get("error"), el.get("prompt"))


def _formats(p: Package):
    for number, _, _, part in sheets_of(p):
        at = 0
        for group in _found(p, part, "conditionalFormatting"):
            boxes = list(filter(None, map(rect, (group.get("sqref") or "").split())))
            for el in group:
                if _local(el) != "cfRule":
                    continue
                formulas = [unmangle(x.text or "") for x in el if _local(x) == "formula"]
                points = [f"{x.get('type')}:{x.get('val') or ''}" for x in el.iter() if _local(x) == "cfvo"]
                for j, box in enumerate(boxes):
                    yield (number, at, j, *box, el.get("type"), _number(el.get("priority")), _yes(el.get("stopIfTrue")), el.get("operator"), formulas, el.get("text"), _number(el.get("rank")), _yes(el.get("percent")), _yes(el.get("bottom")), el.get("aboveAverage") != "0", _yes(el.get("equalAverage")), _number(el.get("stdDev")) or 0, el.get("timePeriod"), points)
                at += 1


def _filters(p: Package):
    for number, _, _, part in sheets_of(p):
        for el in _found(p, part, "autoFilter"):
            box = rect(el.get("ref"))
            if box is None:
                continue
            for c in el:
                col = _number(c.get("colId"))
                inside = [x for x in c.iter() if _local(x) in ("filter", "customFilter")]
                values = [x.get("val") or "" for x in inside if _local(x) == "filter"]
                tests = [(x.get("operator"), x.get("val") or "") for x in inside if _local(x) == "customFilter"]
                blank = any(_yes(x.get("blank")) for x in c if _local(x) == "filters")
                both = any(_yes(x.get("and")) for x in c if _local(x) == "customFilters")
                if col is not None and 0 <= col <= box[3] - box[1] and (values or tests or blank):
                    yield (number, *box, col, values, blank, both, [{"operator": o, "val": v} for o, v in tests])


def _pivots(p: Package):
    for number, _, _, part in sheets_of(p):
        for at in _targets(p, part, r"pivotTables?/[^/]+\.xml$"):
            cache = next(iter(_targets(p, at, r"pivotCacheDefinition[^/]*\.xml$")), "")
            source = next(_found(p, cache, "worksheetSource"), None)
            fields = [el.get("name") for el in _found(p, cache, "cacheField")]
            for el in _found(p, at, "pivotTableDefinition"):
                axes = {_local(x): [_number(f.get("x")) for f in x if _local(f) == "field"] for x in el if _local(x) in ("rowFields", "colFields")}
                data = next((f for x in el if _local(x) == "dataFields" for f in x), None)
                yield (number, el.get("name"), source.get("sheet") if source is not None else None, source.get("ref") if source is not None else None, fields, axes.get("rowFields", []), axes.get("colFields", []), _number(data.get("fld")) if data is not None else None, data.get("subtotal", "sum") if data is not None else None, data.get("name") if data is not None else None)


def _images(p: Package):
    for number, _, _, part in sheets_of(p):
        for at in _targets(p, part, r"drawings?/[^/]+\.xml$"):
            rels = p.rels(at)
            for el in _found(p, at, "twoCellAnchor", "oneCellAnchor"):
                ends = {_local(x): {_local(y): _number(y.text) for y in x} for x in el if _local(x) in ("from", "to")}
                blip = next((_attr(x, "embed") for x in el.iter() if _local(x) == "blip"), None)
                if "from" in ends and rels.get(blip or ""):
                    to = ends.get("to", {})
                    yield (number, ends["from"].get("row"), ends["from"].get("col"), to.get("row"), to.get("col"), rels[blip])


def _parts(p: Package):
    """Macro projects and ribbons are kept as parts, not read."""
    for name in p.names:
        kind = "vba" if name.endswith("vbaproject.bin") else "ribbon" if "customui" in name and name.endswith(".xml") else None
        if kind:
            yield (kind, p.names[name], bytes(p.part(name) or b""))


_BOX = "top int, left int, bottom int, right int"
LOADERS = {
    "row_props": (_row_props, "sheet_id int, row int, height double, hidden boolean, outline_level int, collapsed boolean"),
    "col_props": (_col_props, "sheet_id int, col int, width double, hidden boolean, outline_level int, collapsed boolean"),
    "tables": (_tables, "sheet_id int, name string, display_name string, top int, left int, data_rows int, header_row boolean, totals_row boolean, columns array<string>, totals_labels array<string>, totals_functions array<string>, totals_formulas array<string>"),
    "hyperlinks": (_links, f"sheet_id int, {_BOX}, target string, location string, tooltip string"),
    "comments": (_comments, "sheet_id int, row int, col int, author string, text string"),
    "threads": (_threads, "sheet_id int, row int, col int, message_id string, parent_id string, person_id string, text string, done boolean"),
    "persons": (_persons, "person_id string, name string, user_id string, provider_id string"),
    "validations": (_validations, f"sheet_id int, idx int, rect_idx int, {_BOX}, type string, operator string, formulae array<string>, allow_blank boolean, error_style string, error string, prompt string"),
    "conditional_formats": (_formats, f"sheet_id int, idx int, rect_idx int, {_BOX}, type string, priority int, stop_if_true boolean, operator string, formulae array<string>, text string, rank int, percent boolean, bottom_n boolean, above_average boolean, equal_average boolean, std_dev int, time_period string, cfvo array<string>"),
    "filters": (_filters, f"sheet_id int, {_BOX}, col_id int, values array<string>, blank boolean, is_and boolean, predicates array<struct<operator:string,val:string>>"),
    "pivots": (_pivots, "sheet_id int, name string, source_sheet string, source_ref string, fields array<string>, row_fields array<int>, column_fields array<int>, value_field int, metric string, caption string"),
    "images": (_images, "sheet_id int, from_row int, from_col int, to_row int, to_col int, media string"),
    "preserved": (_parts, "kind string, part string, content binary"),
}


def load(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The facet (a key of ``LOADERS``) of the packages at a path."""
    of, schema = LOADERS[what]
    return _listed(spark, path, of, schema)
