"""More queries of the library's own operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import address, dates, formula, values
from gridlake.operators import extent, facets, grid, pivot, rules, tables
from gridlake.plans import cells as plan
from gridlake.queries import R, T, _customer_cells, query
from gridlake.sources import csvgrid

_FIVE = "(SELECT unnest([1, 2, 3, 4, 5]) AS c)"


@query("SELECT 'A1:E' || max(c_custkey) AS ref FROM customer")
def used_range(spark, d):
    return facets.used_range(_customer_cells(spark, d))


@query("SELECT CAST(c_custkey AS INTEGER) AS row, '_|' || c_name || '|_|_|' || c_mktsegment AS line FROM customer")
def row_values(spark, d):
    v = facets.line_values(_customer_cells(spark, d), F.col("str"))
    return v.select("row", F.array_join("values", "|", "_").alias("line"))


@query("SELECT CAST(c AS INTEGER) AS col, CAST((SELECT max(c_custkey) FROM customer) AS INTEGER) AS last FROM (SELECT unnest([1, 2, 3, 4, 5]) AS c)")
def column_values(spark, d):
    return facets.line_values(_customer_cells(spark, d), F.col("str"), "col").select("col", F.size("values").alias("last"))


@query("SELECT n_nationkey, chr(CAST(65 + n_regionkey + c AS INTEGER)) || (n_nationkey + r) AS address, CAST((r - 1) * 3 + c AS INTEGER) AS place FROM nation, (SELECT unnest([1, 2]) AS r), (SELECT unnest([1, 2, 3]) AS c)")
def range_addresses(spark, d):
    n = T(spark, d, "nation")
    rects = n.select("n_nationkey", (F.col("n_nationkey") + 1).alias("top"), (F.col("n_regionkey") + 2).alias("left"), (F.col("n_nationkey") + 2).alias("bottom"), (F.col("n_regionkey") + 4).alias("right"))
    return facets.addresses(rects).select("n_nationkey", "address", "place")


@query("SELECT 1 AS id, 'string' AS value UNION ALL SELECT 2, NULL UNION ALL SELECT 3, NULL")
def uniform_facets(spark, d):
    c, k = _customer_cells(spark, d), F.col("kind")
    one = lambda i, *box: facets.uniform(c, k, *box).select(F.lit(i).alias("id"), "value")
    return one(1, 1, 2, 9, 2).unionByName(one(2, 1, 1, 9, 2)).unionByName(one(3, 1, 5, 9, 6))


@query("SELECT CAST(n_nationkey + 1 AS INTEGER) AS col, CAST(CASE WHEN n_regionkey = 0 THEN -1 ELSE n_regionkey END AS INTEGER) AS width FROM nation WHERE n_regionkey <> 0 OR n_nationkey % 2 = 0")
def format_columns(spark, d):
    n = T(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("col"), F.nullif("n_regionkey", F.lit(0)).cast("int").alias("width"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(True)).alias("hidden"))
    return facets.kept_columns(n).select("col", F.coalesce("width", F.lit(-1)).alias("width"))


@query("SELECT CAST(o_orderkey AS INTEGER) AS row, 2 AS col, o_orderstatus AS value FROM orders UNION ALL SELECT CAST(o_orderkey AS INTEGER), 7, o_orderpriority FROM orders WHERE o_custkey % 2 = 0")
def keyed_rows(spark, d):
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")))
    return facets.from_keyed(T(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("row"), m.alias("m")), "m", {"status": 2, "priority": 7})


@query("SELECT 2 * count(*) AS count, (SELECT count(DISTINCT s) FROM (SELECT c_name AS s FROM customer UNION ALL SELECT c_mktsegment FROM customer)) AS unique_count FROM customer")
def shared_string_counts(spark, d):
    return facets.shared_strings(_customer_cells(spark, d))


@query("""SELECT p_partkey, array_to_string(list_transform(kept, lambda x: x.o || ':' || x.v), ';') AS predicates FROM (SELECT p_partkey, p_size, list_filter([{'o': CASE p_size % 3 WHEN 0 THEN 'equal' WHEN 1 THEN 'lessThan' ELSE 'soundsLike' END, 'v': p_brand},
{'o': 'greaterThan', 'v': '1'}, {'o': 'notEqual', 'v': p_type}], lambda x: x.o <> 'soundsLike')[1:2] AS kept FROM part) WHERE p_size % 5 < 4""")
def filter_leniency(spark, d):
    size = F.col("p_size")
    p = lambda o, v: F.struct(o.alias("operator"), v.alias("val"))
    tests = F.array(p(F.when(size % 3 == 1, "lessThan").when(size % 3 == 2, "soundsLike"), F.col("p_brand")), p(F.lit("greaterThan"), F.lit("1")), p(F.lit("notEqual"), F.col("p_type")))
    out = facets.lenient_criteria(T(spark, d, "part").select("p_partkey", (size % 5).alias("col_id"), F.lit(4).alias("width"), tests.alias("predicates")))
    return out.select("p_partkey", F.array_join(F.transform("predicates", lambda x: F.concat(x["operator"], F.lit(":"), x["val"])), ";").alias("predicates"))


def _tables(spark, d):
    n, k = T(spark, d, "nation"), F.col("n_nationkey")
    return n.select("n_nationkey", (k * 3 + 1).cast("int").alias("top"), (F.col("n_regionkey") * 4 + 1).cast("int").alias("left"), (k % 5).cast("int").alias("data_rows"), (k % 2 == 0).alias("header_row"), (k % 3 == 0).alias("totals_row"), F.lit(3).alias("columns"))


_TABLES = "(SELECT n_nationkey, n_nationkey * 3 + 1 AS t, n_regionkey * 4 + 1 AS l, n_nationkey % 5 AS r, n_nationkey % 2 = 0 AS h, n_nationkey % 3 = 0 AS z FROM nation)"


@query(f"SELECT n_nationkey, CAST(CASE WHEN h THEN t + r ELSE 0 END AS INTEGER) AS filter_bottom FROM {_TABLES}")
def table_filter_region(spark, d):
    return facets.filter_region(_tables(spark, d)).select("n_nationkey", F.coalesce("filter_bottom", F.lit(0)).alias("filter_bottom"))


@query(f"""WITH x AS (SELECT *, CAST(h AS INT) + CAST(z AS INT) AS f FROM {_TABLES}), y AS (SELECT *, t + r + f - 1 AS b FROM x), s AS (SELECT *, CASE WHEN t < 20 THEN t WHEN t >= 28 THEN t - 6 ELSE 20 END AS t2, CASE WHEN b < 20 THEN b WHEN b >= 28 THEN b - 6 ELSE 20 END AS b2 FROM y WHERE NOT (t >= 20 AND b < 28))
SELECT n_nationkey, CAST(t2 AS INTEGER) AS top, CAST(b2 - t2 + 1 - f AS INTEGER) AS data_rows FROM s WHERE b2 >= t2 AND b2 - t2 + 1 - f >= 0""")
def splice_tables_rows(spark, d):
    return facets.splice_tables(_tables(spark, d), "row", 20, 8, 2).select("n_nationkey", "top", "data_rows")


@query(f'SELECT n_nationkey, CAST(CASE WHEN l >= 7 THEN l - 1 ELSE l END AS INTEGER) AS "left" FROM {_TABLES}')
def splice_tables_columns(spark, d):
    return facets.splice_tables(_tables(spark, d), "col", 5, 2, 1).select("n_nationkey", "left")


@query(f"SELECT n_nationkey, CAST(t + CAST(h AS INT) + r AS INTEGER) AS insert_at, z AS inserts_row, CAST(r + 1 AS INTEGER) AS data_rows FROM {_TABLES}")
def table_add_row(spark, d):
    return facets.table_row_at(_tables(spark, d), F.lit(3)).select("n_nationkey", "insert_at", "inserts_row", "data_rows")


@query(f"SELECT CAST(c_custkey AS INTEGER) AS row, c AS col FROM customer, {_FIVE} UNION ALL SELECT CAST(c_custkey AS INTEGER), 6 FROM customer")
def add_columns(spark, d):
    more = _customer_cells(spark, d).where("col = 3").withColumn("col", F.lit(1))
    return facets.add_columns(_customer_cells(spark, d), more, 5).select("row", "col")


@query("SELECT CAST(CASE WHEN o_orderkey < 100 THEN o_orderkey ELSE o_orderkey - 30 END AS INTEGER) AS row, o_totalprice AS height FROM orders WHERE o_orderkey NOT BETWEEN 100 AND 149")
def splice_row_props(spark, d):
    return facets.splice_lines(T(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("row"), F.col("o_totalprice").alias("height")), "row", 100, 50, 20)


@query("SELECT n_nationkey, CAST(CASE WHEN a < 5 THEN a WHEN a >= 8 THEN a - 2 ELSE 5 END - 1 AS INTEGER) AS from_row, CAST(CASE WHEN b < 5 THEN b WHEN b >= 8 THEN b - 2 ELSE 5 END - 1 AS INTEGER) AS to_row FROM (SELECT n_nationkey, n_nationkey + 1 AS a, CASE WHEN n_regionkey > 0 THEN n_nationkey + 1 + n_regionkey END AS b FROM nation)")
def splice_images(spark, d):
    k = F.col("n_nationkey")
    im = T(spark, d, "nation").select(k, k.cast("int").alias("from_row"), F.lit(0).alias("from_col"), F.when(F.col("n_regionkey") > 0, k + F.col("n_regionkey")).cast("int").alias("to_row"), F.lit(2).alias("to_col"))
    return facets.splice_images(im, "row", 5, 3, 1).select(k, "from_row", "to_row")


@query(f"SELECT CAST(c_custkey AS INTEGER) AS row, c AS col, CASE WHEN c_custkey BETWEEN 3 AND 6 AND c BETWEEN 2 AND 4 AND NOT (c_custkey = 3 AND c = 2) THEN 'null' WHEN c IN (2, 5) THEN 'string' ELSE 'number' END AS kind FROM customer, {_FIVE}")
def merge_cells(spark, d):
    return grid.merge_cells(_customer_cells(spark, d), 3, 2, 6, 4).select("row", "col", "kind")


def _merges(spark, d):
    k = F.col("n_nationkey").cast("int")
    return T(spark, d, "nation").select((k * 4 + 1).alias("top"), F.lit(2).alias("left"), (k * 4 + 3).alias("bottom"), F.lit(4).alias("right"))


@query("SELECT CAST(n_nationkey * 4 + 1 AS INTEGER) AS top FROM nation WHERE n_nationkey <> 2")
def unmerge(spark, d):
    return facets.unmerge(_merges(spark, d), "B9:D11").select("top")


@query(f"SELECT CAST(c_custkey AS INTEGER) AS row, c AS col, CAST(CASE WHEN m THEN (c_custkey - 1) // 4 * 4 + 1 ELSE c_custkey END AS INTEGER) AS master_row, CASE WHEN m THEN 2 ELSE c END AS master_col FROM (SELECT c_custkey, c, c_custkey BETWEEN 1 AND 100 AND (c_custkey - 1) % 4 < 3 AND c BETWEEN 2 AND 4 AS m FROM customer, {_FIVE})")
def resolve_merges(spark, d):
    return extent.resolve_merges(_customer_cells(spark, d), _merges(spark, d)).select("row", "col", "master_row", "master_col")


@query("SELECT CAST(CASE WHEN n_nationkey * 4 + 1 < 10 THEN n_nationkey * 4 + 1 ELSE greatest(n_nationkey * 4 + 1 - 2, 10) END AS INTEGER) AS top, CAST(CASE WHEN n_nationkey * 4 + 3 < 10 THEN n_nationkey * 4 + 3 WHEN n_nationkey * 4 + 3 <= 11 THEN 9 ELSE n_nationkey * 4 + 1 END AS INTEGER) AS bottom FROM nation")
def splice_merges(spark, d):
    return grid.splice_merges(_merges(spark, d), "row", 10, 2).select("top", "bottom")


@query("SELECT CAST(c_custkey AS INTEGER) AS row, c AS col, c_custkey < 5 AND c = 2 AS generated FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS c) WHERE c <> 2 OR c_custkey < 5 UNION ALL SELECT CAST(c_custkey AS INTEGER), 2, false FROM customer WHERE c_custkey >= 5")
def fill_empty_cells(spark, d):
    c = _customer_cells(spark, d).withColumn("generated", F.lit(False))
    gone = c.where("not (col = 2 and row < 5)")
    return facets.fill_empty(gone, c.where("col = 2").withColumn("generated", F.lit(True))).select("row", "col", "generated")


@query("SELECT 1 AS sheet_id, count(*) * 5 AS cells FROM customer UNION ALL SELECT 2, count(*) * 5 FROM customer")
def copy_sheet(spark, d):
    out = facets.copy_sheet({"cells": _customer_cells(spark, d).withColumn("sheet_id", F.lit(1)).withColumn("sheet", F.lit("a"))}, 1, 2, "b")["cells"]
    return out.groupBy("sheet_id").agg(F.count("*").alias("cells"))


@query("SELECT o_orderkey, n_name AS target FROM orders JOIN nation ON o_custkey % 40 = n_nationkey")
def link_targets(spark, d):
    links = T(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("rel_id"))
    return facets.resolve_links(links, T(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("rel_id"), F.col("n_name").alias("target"))).select("o_orderkey", "target")


@query("SELECT event_id, user_id % 40 AS person_id, n_name AS author FROM events LEFT JOIN nation ON user_id % 40 = n_nationkey")
def comment_authors(spark, d):
    m = T(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("person_id"))
    return facets.resolve_authors(m, T(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("person_id"), F.col("n_name").alias("name")))


@query("SELECT event_id AS message_id, CASE WHEN event_id % 4 = 0 OR event_id - event_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = 0) THEN event_id WHEN event_id % 4 = 3 THEN event_id ELSE event_id - event_id % 4 END AS thread_id FROM events")
def comment_threads(spark, d):
    e = F.col("event_id")
    m = T(spark, d, "events").select(e.alias("message_id"), F.when(e % 4 == 3, F.lit(-5)).when(e % 4 > 0, e - e % 4).cast("long").alias("parent_id"))
    return facets.threads(m).select("message_id", "thread_id")


@query("SELECT 1 AS top, 2 AS \"left\", CAST(max(c_custkey) AS INTEGER) AS bottom, 4 AS \"right\", 'B1:D' || max(c_custkey) AS ref FROM customer")
def pivot_source_range(spark, d):
    return facets.source_range(_customer_cells(spark, d), {2: "name", 3: "nation", 4: "balance"})


@query("SELECT CAST(o_orderkey AS INTEGER) AS row, CASE WHEN c = 1 THEN o_totalprice END AS num, CASE c WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(date_part('millisecond', o_orderdate) AS INT) % 1000 AS VARCHAR), 3, '0') || 'Z' WHEN 3 THEN o_orderstatus END AS str FROM orders, (SELECT unnest([1, 2, 3]) AS c)")
def pivot_scalars(spark, d):
    c = plan.from_table(T(spark, d, "orders").withColumn("row", F.col("o_orderkey")), "row", ["o_totalprice", "o_orderdate", "o_orderstatus"])
    return c.select("row", values.pivot_scalar(*[F.col(x) for x in ("kind", "num", "str", "bool", "ts")], F.lit(None).cast("string")).alias("x")).select("row", "x.num", "x.str")


@query("SELECT c_custkey, c_custkey % 7 = 0 AS is_error, c_custkey % 7 IN (1, 2) AS is_formula, c_custkey % 7 = 3 AS is_rich FROM customer")
def kind_guards(spark, d):
    k = F.element_at(F.array(*map(F.lit, ["error", "formula", "sharedFormula", "richText", "hyperlink", "number", "null"])), (F.col("c_custkey") % 7 + 1).cast("int"))
    return T(spark, d, "customer").select("c_custkey", values.is_kind("isErrorValue", k).alias("is_error"), values.is_kind("isFormulaValue", k).alias("is_formula"), values.is_kind("isRichTextValue", k).alias("is_rich"))


@query("SELECT event_id, upper('{' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '}') AS guid FROM (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN md5(CAST(event_id AS VARCHAR)) END AS m FROM events)")
def guids(spark, d):
    m = F.md5(F.col("event_id").cast("string").cast("binary"))
    t = F.when(F.col("event_id") % 3 == 0, m).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" {"), F.regexp_replace(m, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit("}"))).otherwise(F.substring(m, 1, 30))
    return T(spark, d, "events").select("event_id", values.guid(t).alias("guid"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size * 1.0::DOUBLE WHEN p_partkey % 4 = 1 THEN -(p_size + 0.25::DOUBLE) END AS num, CASE p_partkey % 4 WHEN 2 THEN p_size || 'E5' WHEN 3 THEN 'A' || p_size END AS str FROM part")
def literal_numbers(spark, d):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    t = F.when(k == 0, F.concat(F.lit(" "), s)).when(k == 1, F.concat(F.lit("-"), s, F.lit(".25"))).when(k == 2, F.concat(s, F.lit("E5"))).otherwise(F.concat(F.lit("A"), s))
    return T(spark, d, "part").select("p_partkey", values.literal_number(t).alias("x")).select("p_partkey", "x.num", "x.str")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size * 1.0::DOUBLE END AS num, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS str FROM part")
def validation_operands(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "list").otherwise("whole")
    return T(spark, d, "part").select("p_partkey", values.operand(kind, F.concat(F.lit("="), F.col("p_size").cast("string"))).alias("x")).select("p_partkey", "x.num", "x.str")


@query("SELECT event_id, event_id % 5 <> 2 AS present, event_id % 5 IN (0, 1) AS strict, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE 'neither' END AS tristate FROM events")
def stored_flags(spark, d):
    t = F.element_at(F.array(F.lit("1"), F.lit("true"), F.lit("0"), F.lit("maybe"), F.lit(None).cast("string")), (F.col("event_id") % 5 + 1).cast("int"))
    return T(spark, d, "events").select("event_id", *[values.flag(t, m).alias(m) for m in ("present", "strict")], F.coalesce(values.flag(t, "tristate").cast("string"), F.lit("neither")).alias("tristate"))


@query("SELECT o_orderkey, coalesce(i BETWEEN 14 AND 22 OR i BETWEEN 27 AND 36 OR i BETWEEN 45 AND 47 OR i BETWEEN 50 AND 58, false) AS is_date FROM (SELECT o_orderkey, o_orderkey % 64 AS i FROM orders)")
def builtin_date_formats(spark, d):
    code = dates.builtin_format(F.col("o_orderkey") % 64)
    return T(spark, d, "orders").select("o_orderkey", F.coalesce(dates.is_date_format(code), F.lit(False)).alias("is_date"))


@query("SELECT n_nationkey, '_xlfn.FILTER(A' || n_nationkey || ':B9,SUM(_xlfn.STDEV.S(C1),\"FILTER(x)\"))' AS formula FROM nation")
def formula_prefixes(spark, d):
    return T(spark, d, "nation").select("n_nationkey", formula.mangled(F.concat(F.lit("FILTER(A"), F.col("n_nationkey").cast("string"), F.lit(':B9,SUM(STDEV.S(C1),"FILTER(x)"))'))).alias("formula"))


@query("SELECT n_nationkey, 'C' || (n_nationkey + 3) || '+$A' || (n_nationkey + 3) || '+C$1+$A$1' AS formula FROM nation")
def formula_shift(spark, d):
    n = F.col("n_nationkey")
    f = F.concat(F.lit("B"), (n + 1).cast("string"), F.lit("+$A"), (n + 1).cast("string"), F.lit("+B$1+$A$1"))
    return T(spark, d, "nation").select(n, formula.translated(f, F.lit(1), F.lit(2)).alias("formula"))


@query("SELECT n_nationkey, CAST(n_regionkey + 2 AS INTEGER) AS col, CAST(n_nationkey + 1 AS INTEGER) AS row FROM nation")
def address_parts(spark, d):
    a = F.concat(F.lit("$"), F.substring(F.lit("BCDEFGH"), F.col("n_regionkey") + 1, F.lit(1)), F.lit("$"), (F.col("n_nationkey") + 1).cast("string"))
    return T(spark, d, "nation").select("n_nationkey", address.decode_address(a).alias("x")).select("n_nationkey", F.col("x.col").cast("int").alias("col"), F.col("x.row").cast("int").alias("row"))


@query("SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT regexp_matches(n_name, '^[A-Za-z]{1,3}[0-9]+$') THEN n_name ELSE '''' || n_name || '''' END AS quoted FROM nation")
def quoted_sheet_names(spark, d):
    return T(spark, d, "nation").select("n_nationkey", address.quote_sheet_name(F.col("n_name")).alias("quoted"))


@query("SELECT CAST(c_custkey AS INTEGER) AS row FROM customer UNION SELECT CAST(o_orderkey AS INTEGER) FROM orders")
def all_rows(spark, d):
    return extent.all_rows(_customer_cells(spark, d), T(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("row")))


@query("SELECT CAST(min(c_custkey) AS INTEGER) AS top, 1 AS \"left\", CAST(max(c_custkey) AS INTEGER) AS bottom, 5 AS \"right\" FROM customer")
def tight_box(spark, d):
    return extent.tight_box(_customer_cells(spark, d))


@query(f"SELECT CAST(c_custkey AS INTEGER) AS row, c AS col FROM customer, {_FIVE} WHERE c_custkey BETWEEN 3 AND 40 AND c >= 4")
def rectangle_cells(spark, d):
    return extent.rectangle(_customer_cells(spark, d), 3, 4, 40).select("row", "col")


@query("SELECT CAST(c_custkey AS INTEGER) AS row, c AS col FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS c) UNION ALL SELECT CAST((SELECT max(c_custkey) FROM customer) + n_nationkey + 1 AS INTEGER), 1 FROM nation")
def append_rows(spark, d):
    c = _customer_cells(spark, d)
    last = c.agg(F.max("row")).first()[0]
    more = plan.from_table(T(spark, d, "nation").withColumn("row", F.col("n_nationkey") + 1), "row", ["n_name"])
    return grid.append_rows(c, more, last).select("row", "col")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) AS new_row FROM part")
def sorted_rows(spark, d):
    return grid.sort_rows(T(spark, d, "part"), [F.col("p_brand"), F.col("p_size").desc()], "p_partkey").select("p_partkey", F.col("new_row").cast("long").alias("new_row"))


@query("SELECT p_partkey, p_partkey % 11 = 0 AS below, p_retailprice >= 1000 AS high FROM part")
def cf_cell_is(spark, d):
    k = F.col("p_partkey") % 11
    return T(spark, d, "part").select("p_partkey", rules.compare(k, "lessThan", F.lit(1)).alias("below"), rules.compare(F.col("p_retailprice"), "greaterThanOrEqual", F.lit(1000.0)).alias("high"))


@query("SELECT p_partkey, p_size * 2 > p_partkey % 50 AS matched FROM part")
def cf_expression(spark, d):
    return T(spark, d, "part").select("p_partkey", rules.expression("B1*2>MOD(A1,50)", 1, {1: F.col("p_partkey"), 2: F.col("p_size")}).alias("matched"))


@query("WITH r AS (SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice) AS k, count(*) OVER () AS n FROM part) SELECT p_partkey, p_retailprice <= (SELECT max(p_retailprice) FROM (SELECT p_retailprice FROM part ORDER BY p_retailprice LIMIT (SELECT CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) FROM part))) AS matched FROM r")
def cf_bottom_percent(spark, d):
    return rules.top_n(T(spark, d, "part"), "p_retailprice", 10, percent=True, bottom=True).select("p_partkey", "matched")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_type)) = 1 AS matched FROM part")
def cf_unique_values(spark, d):
    return rules.duplicates(T(spark, d, "part"), "p_type", unique=True).select("p_partkey", "matched")


@query("SELECT o_orderkey, length(o_orderstatus) BETWEEN 1 AND 3 AS length_ok, o_orderstatus IN ('O', 'F') AS list_ok, o_totalprice <= 100000.5 AS decimal_ok FROM orders")
def validation_others(spark, d):
    st, pr = F.col("o_orderstatus"), F.col("o_totalprice")
    none = F.lit(None).cast("double")
    return T(spark, d, "orders").select(
        "o_orderkey", rules.validation_passes(F.lit("string"), none, st, "textLength", "between", [1, 3]).alias("length_ok"), rules.validation_passes(F.lit("string"), none, st, "list", operands=["O", "F"]).alias("list_ok"),
        rules.validation_passes(F.lit("number"), pr, pr.cast("string"), "decimal", "lessThanOrEqual", [100000.5]).alias("decimal_ok"),
    )


@query("SELECT p_partkey, p_name || ' ' || p_type AS text, CAST(ceil(length(p_name || ' ' || p_type) / 10.0) AS BIGINT) AS lines FROM part")
def wrapped_lines(spark, d):
    t = F.concat_ws(" ", "p_name", "p_type")
    return T(spark, d, "part").select("p_partkey", t.alias("text"), values.wrapped_lines(t, 10).alias("lines"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'null' ELSE 'string' END AS kind, CASE WHEN event_id % 4 = 0 THEN event_id * 1.0::DOUBLE END AS num, CASE event_id % 4 WHEN 1 THEN event_type WHEN 3 THEN '  ' END AS str FROM events")
def csv_kinds(spark, d):
    k = F.col("event_id") % 4
    field = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.col("event_type")).when(k == 2, "").otherwise("  ")
    return T(spark, d, "events").select("event_id", values.csv_value(field).alias("v")).select("event_id", "v.kind", "v.num", "v.str")


@query("SELECT CAST(c_custkey AS INTEGER) AS row, CASE WHEN c_custkey % 3 = 0 THEN '' || c_custkey ELSE ',,' || c_nationkey END AS line FROM customer")
def csv_ragged_lines(spark, d):
    c = _customer_cells(spark, d)
    return csvgrid.lines(c.where("(row % 3 = 0 and col = 1) or (row % 3 <> 0 and col = 3)"))


@query("SELECT 'lineitem' AS name, 'SUBTOTAL(109,[l_tax])' AS formula")
def subtotal_formulas(spark, d):
    return spark.range(1).select(F.lit("lineitem").alias("name"), F.lit(tables.subtotal_formula("sum", "lineitem", "l_tax").replace("lineitem", "")).alias("formula"))


@query("SELECT 'p_type' AS field, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, 'none' AS all_integer, bool_or(p_type IS NULL) AS contains_blank FROM part UNION ALL SELECT 'p_size', min(p_size), max(p_size), 'true', false FROM part")
def pivot_summary_text(spark, d):
    return pivot.summary(T(spark, d, "part"), ["p_type", "p_size"]).withColumn("all_integer", F.coalesce(F.col("all_integer").cast("string"), F.lit("none")))




@query("SELECT nation.n_regionkey AS sheet_id, CAST(greatest(max(n_nationkey) + 1, 20) AS BIGINT) AS row_count, count(*) AS actual_row_count FROM nation GROUP BY 1")
def used_extent_by_sheet(spark, d):
    n = T(spark, d, "nation")
    c = n.select(F.col("n_regionkey").alias("sheet_id"), (F.col("n_nationkey") + 1).alias("row"), F.lit(1).alias("col"), F.lit("string").alias("kind"))
    props = n.select(F.col("n_regionkey").alias("sheet_id"), F.lit(20).alias("row")).distinct()
    return extent.used_extent(c, props, by=["sheet_id"]).select("sheet_id", "row_count", "actual_row_count")
