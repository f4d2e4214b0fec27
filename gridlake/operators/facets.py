"""Facets of sheets beyond cells: lines, tables, links, comments, images, as plain tables and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.errors import AuthoringError
from gridlake.functions.address import encode_address, number_to_column
from gridlake.operators.extent import rectangle, used_extent
from gridlake.operators.grid import shifted

#: Operators that filter criteria may carry (fixed values of the file format).
FILTER_OPERATORS = ("equal", "notEqual", "greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual")


# --- extents and projections ---


def used_range(cells: DataFrame) -> DataFrame:
    """One row with ``ref``, A1 to the last used row and column; no row for a sheet that uses none."""
    e = used_extent(cells).where((F.col("row_count") > 0) & (F.col("column_count") > 0))
    return e.select(F.concat(F.lit("A1:"), encode_address(F.col("row_count").cast("int"), F.col("column_count").cast("int"))).alias("ref"))


def line_values(cells: DataFrame, value: Column, axis: str = "row") -> DataFrame:
    """The line's number and ``values``: from the first position to its last cell, null where there is none. Cells below
    position 1 are left out; two cells at one position are an error."""
    other = "col" if axis == "row" else "row"
    held = cells.groupBy(axis).agg(F.collect_list(F.when(F.col(other) < 1, None).otherwise(F.struct(F.col(other).alias("p"), value.alias("v")))).alias("m"))
    order = held.select(axis, "m", F.array_sort(F.transform("m", lambda x, i: F.struct(x["p"].alias("p"), i.alias("i")))).alias("o"))

    # nulls for the gap before a cell, then its value: in proportion to the line's length
    def piece(x: Column, i: Column) -> Column:
        gap = x["p"] - F.coalesce(F.get("o", i - 1)["p"], F.lit(0)) - 1
        gap = F.when(gap >= 0, gap).otherwise(F.raise_error(F.lit("two cells at one position, or a cell without one")).cast("int"))
        own = F.array(F.get("m", x["i"])["v"])
        return F.when(gap == 0, own).otherwise(F.concat(F.array_repeat(F.get(own, F.lit(1)), gap), own))

    return order.select(axis, F.flatten(F.transform("o", piece)).alias("values"))


def addresses(rects: DataFrame) -> DataFrame:
    """Each position of each rectangle (top, left, bottom, right), with its place in row-major order."""
    width = F.col("right") - F.col("left") + 1
    cells = rects.withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right")))
    return cells.withColumn("place", (F.col("row") - F.col("top")) * width + F.col("col") - F.col("left") + 1).withColumn("address", encode_address(F.col("row"), F.col("col")))


def uniform(cells: DataFrame, facet: Column, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """One row: the facet if every position of the rectangle has a cell and all agree, else null."""
    here = rectangle(cells, top, left, bottom, right).select("row", "col", facet.alias("f"))
    size = (bottom - top + 1) * (right - left + 1)
    agree = (F.count("*") == size) & (F.count("f") == size) & (F.min("f") == F.max("f"))
    return here.agg(F.when(agree, F.min("f")).alias("value"))


def kept_columns(col_props: DataFrame) -> DataFrame:
    """Columns that carry a property, in order."""
    own = [c for c in col_props.columns if c not in ("sheet_id", "col")]
    return col_props.where(F.coalesce(*[F.col(c).cast("string") for c in own]).isNotNull()).orderBy("col")


def from_keyed(rows: DataFrame, values: str, keys: dict[str, int], known: bool = True) -> DataFrame:
    """Cells (row, col, value) of rows given as maps of column key to value. A key that no column has is an error
    (``known`` false: it is left out)."""
    each = rows.select("row", F.explode(values).alias("key", "value"))
    place = F.create_map(*[F.lit(x) for k, c in sorted(keys.items()) for x in (k, c)])
    col = F.try_element_at(place, F.col("key"))
    if known:
        col = F.when(col.isNull(), F.raise_error(F.concat(F.lit("no column has the key "), F.col("key")))).otherwise(col)
    return each.select("row", col.alias("col"), "value").where(F.col("col").isNotNull() & F.col("value").isNotNull())


def shared_strings(cells: DataFrame) -> DataFrame:
    """One row: how many string cells there are, and how many different strings."""
    text = F.when(F.col("kind").isin("string", "richText"), F.col("str"))
    return cells.agg(F.count(text).alias("count"), F.countDistinct(text).alias("unique_count"))


# --- filters ---


def check_filter(width: int, height: int, col_id: int, predicates: int) -> None:
    """What an authored filter must be: a header row and a column within a bounded region, one or two predicates."""
    if width < 1 or height < 1:
        raise AuthoringError("a filter needs a bounded region with a header row")
    if not 0 <= col_id < width:
        raise AuthoringError(f"column {col_id} lies outside the filter's {width} columns")
    if not 1 <= predicates <= 2:
        raise AuthoringError("a custom filter has one or two predicates")


def lenient_criteria(criteria: DataFrame) -> DataFrame:
    """Criteria as files carry them (col_id, width, predicates array<struct<operator, val>>) made usable: predicates of
    unknown operators go, a missing operator means equal, at most two stay; columns outside the region and criteria
    without a predicate go. Kinds that are not modelled (dynamic, top10, colour, icon) have none and go with them."""
    named = F.transform("predicates", lambda p: F.struct(F.coalesce(p["operator"], F.lit("equal")).alias("operator"), p["val"].alias("val")))
    known = F.filter(named, lambda p: p["operator"].isin(*FILTER_OPERATORS))
    out = criteria.withColumn("predicates", F.slice(known, 1, 2))
    return out.where((F.size("predicates") > 0) & F.col("col_id").between(0, F.col("width") - 1))


def filter_region(tables: DataFrame) -> DataFrame:
    """A table's filter covers its header and data rows, never totals; a table without a header has none (null)."""
    bottom = F.when(F.col("header_row"), F.col("top") + F.col("data_rows"))
    return tables.withColumn("filter_bottom", bottom.cast("int"))


# --- edits ---


def add_columns(cells: DataFrame, columns: DataFrame, last: int) -> DataFrame:
    """Columns numbered from 1 go right of column ``last``."""
    return cells.unionByName(columns.withColumn("col", (F.col("col") + last).cast("int")), allowMissingColumns=True)


def splice_lines(props: DataFrame, axis: str, start: int, count: int, n_inserts: int = 0) -> DataFrame:
    """Row or column properties through a splice: those of deleted lines go."""
    kept = props.where(~F.col(axis).between(start, start + count - 1))
    return kept.withColumn(axis, shifted(F.col(axis), start, count, n_inserts).cast("int"))


def splice_tables(tables: DataFrame, axis: str, start: int, count: int, n_inserts: int = 0) -> DataFrame:
    """Tables (top, left, data_rows, header_row, totals_row) through a splice. Rows: a table moves, or its data rows grow
    or shrink; one that is deleted whole or keeps too few rows goes. Columns: only a table wholly to the right moves."""
    if axis == "col":
        right = F.col("left") >= start + count
        return tables.withColumn("left", F.when(right, F.col("left") + n_inserts - count).otherwise(F.col("left")).cast("int"))
    fixed = F.col("header_row").cast("int") + F.col("totals_row").cast("int")
    bottom = F.col("top") + F.col("data_rows") + fixed - 1
    t = tables.withColumn("__b", bottom).where(~((F.col("top") >= start) & (F.col("__b") < start + count)))
    t = t.withColumn("__t", shifted(F.col("top"), start, count, n_inserts)).withColumn("__b", shifted(F.col("__b"), start, count, n_inserts))
    t = t.withColumn("data_rows", (F.col("__b") - F.col("__t") + 1 - fixed).cast("int")).where((F.col("__b") >= F.col("__t")) & (F.col("data_rows") >= 0))
    return t.withColumn("top", F.col("__t").cast("int")).drop("__t", "__b")


def splice_images(images: DataFrame, axis: str, start: int, count: int, n_inserts: int = 0) -> DataFrame:
    """Image anchors (0-based from_row, from_col, to_row, to_col; null ends of one-cell anchors) move as merge edges do."""
    for end in ("from", "to"):
        c = f"{end}_{axis}"
        images = images.withColumn(c, (shifted(F.col(c) + 1, start, count, n_inserts) - 1).cast("int"))
    return images


def table_row_at(tables: DataFrame, width: Column) -> DataFrame:
    """Where the next data row of each table goes (below the data, which is the totals row's place if it has one, and
    then rows are inserted) and the table with that row. More values than columns are an error."""
    fits = F.when(width > F.col("columns"), F.raise_error(F.lit("more values than the table has columns"))).otherwise(F.col("data_rows") + 1)
    at = F.col("top") + F.col("header_row").cast("int") + F.col("data_rows")
    return tables.withColumn("insert_at", at.cast("int")).withColumn("inserts_row", F.col("totals_row")).withColumn("data_rows", fits.cast("int"))


def check_merge(merges: DataFrame, top: int, left: int, bottom: int, right: int) -> None:
    """A new merge may not overlap another one."""
    hit = merges.where((F.col("top") <= bottom) & (F.col("bottom") >= top) & (F.col("left") <= right) & (F.col("right") >= left))
    if not hit.isEmpty():
        raise AuthoringError("the range overlaps another merge")


def unmerge(merges: DataFrame, ref: str) -> DataFrame:
    """The merges without the one of exactly this reference."""
    own = F.concat(encode_address(F.col("top"), F.col("left")), F.lit(":"), encode_address(F.col("bottom"), F.col("right")))
    return merges.where(own != ref)


def fill_empty(cells: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated cells (totals, headers) only where no cell holds a value yet."""
    held = cells.where("kind <> 'null'").select("row", "col")
    return cells.join(generated.select("row", "col"), ["row", "col"], "left_anti").unionByName(
        cells.where("kind <> 'null'").join(generated.select("row", "col"), ["row", "col"], "left_semi")
    ).unionByName(generated.join(held, ["row", "col"], "left_anti"), allowMissingColumns=True)


def copy_sheet(facets: dict[str, DataFrame], sheet_id: int, to_id: int, to_name: str) -> dict[str, DataFrame]:
    """Every facet table with the sheet's rows once more under a new id and name."""
    out = {}
    for name, df in facets.items():
        more = df.where(F.col("sheet_id") == sheet_id).withColumn("sheet_id", F.lit(to_id))
        out[name] = df.unionByName(more.withColumn("sheet", F.lit(to_name)) if "sheet" in df.columns else more)
    return out


# --- lookups ---


def resolve_links(links: DataFrame, rels: DataFrame) -> DataFrame:
    """Links with their targets; a link whose relationship is missing goes."""
    return links.join(rels.select("rel_id", "target"), "rel_id")


def resolve_authors(messages: DataFrame, persons: DataFrame) -> DataFrame:
    """Messages with their author's name, null where the person is missing; the id stays."""
    return messages.join(persons.select(F.col("person_id").alias("__p"), F.col("name").alias("author")), F.col("person_id") == F.col("__p"), "left").drop("__p")


def threads(messages: DataFrame) -> DataFrame:
    """Each message with the head of its thread: itself without a parent, or if the parent is not there."""
    heads = messages.where("parent_id is null").select(F.col("message_id").alias("__h"))
    j = messages.join(heads, F.col("parent_id") == F.col("__h"), "left")
    return j.withColumn("thread_id", F.coalesce("__h", "message_id")).drop("__h")


def field_index(header: list[str], field: str) -> int:
    """Place of a field among header texts, the first match; absent fields are an error."""
    try:
        return header.index(field)
    except ValueError:
        raise AuthoringError(f"no column is called {field!r}") from None


def source_range(cells: DataFrame, fields: dict[int, str], header_row: int = 1) -> DataFrame:
    """One row: the rectangle of a pivot's source, from the header to the last used row, over its field columns."""
    at = sorted(fields)
    bottom = F.greatest(F.col("row_count").cast("int"), F.lit(header_row))
    ref = F.concat(encode_address(F.lit(header_row), F.lit(at[0])), F.lit(":"), encode_address(bottom, F.lit(at[-1])))
    return used_extent(cells).select(F.lit(header_row).alias("top"), F.lit(at[0]).alias("left"), bottom.alias("bottom"), F.lit(at[-1]).alias("right"), ref.alias("ref"))


def shared_formulas(cells: DataFrame, masters: DataFrame) -> DataFrame:
    """Clones (si) with their master's address; a clone without a master keeps its cached value alone."""
    m = masters.select("sheet_id", "si", encode_address(F.col("row"), F.col("col")).alias("shared_master"))
    return cells.join(m, ["sheet_id", "si"], "left")


def column_letters(df: DataFrame, col: str = "col") -> DataFrame:
    return df.withColumn("letters", number_to_column(F.col(col)))
