"""The library's own queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import address, colors, dates, values
from gridlake.operators import extent, grid, outline, pivot, rules, tables
from gridlake.plans import cells as plan
from gridlake.sources import csvgrid

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
S: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], S[f.__name__] = f, sql
        return f

    return add


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def R(*names: str, digits: int = 4):
    return [F.round(F.col(n), digits).alias(n) for n in names]


for _m, _sql in {
    "sum": "sum(l_quantity)", "count": "count(l_quantity)", "countNums": "count(l_quantity)", "average": "avg(l_quantity)", "max": "max(l_quantity)", "min": "min(l_quantity)",
    "stdDev": "stddev_samp(l_quantity)", "stdDevp": "stddev_pop(l_quantity)", "var": "var_samp(l_quantity)", "varp": "var_pop(l_quantity)",
}.items():
    def _f(spark, d, m=_m):
        return pivot.pivot_long(T(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], "l_quantity", m).select("l_returnflag", "l_linestatus", F.round(F.col("value").cast("double"), 4).alias("value"))

    Q[f"pivot_{_m}"], S[f"pivot_{_m}"] = _f, f"SELECT l_returnflag, l_linestatus, round(CAST({_sql} AS DOUBLE), 4) AS value FROM lineitem GROUP BY ALL"


@query("SELECT n_regionkey, n_nationkey % 3 AS k, CAST(product(n_nationkey + 1) AS DOUBLE) AS value FROM nation GROUP BY ALL")
def pivot_product(spark, d):
    df = T(spark, d, "nation").select("n_regionkey", (F.col("n_nationkey") % 3).alias("k"), (F.col("n_nationkey") + 1).alias("v"))
    return pivot.pivot_long(df, ["n_regionkey"], ["k"], "v", "product")


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS value, CAST(grouping(o_orderpriority) + 2 * grouping(o_orderstatus) AS INTEGER) AS total_level FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def pivot_grand_totals(spark, d):
    return pivot.pivot_long(T(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"], "o_totalprice", totals=True).select("o_orderstatus", "o_orderpriority", *R("value", digits=2), "total_level")


@query("SELECT l_returnflag, round(sum(l_extendedprice) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_extendedprice) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY ALL")
def pivot_wide(spark, d):
    return pivot.pivot_wide(T(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_extendedprice", items=["F", "O"]).select("l_returnflag", *R("F", "O", digits=2))


@query("SELECT CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS index, o_orderpriority AS item FROM orders GROUP BY o_orderpriority")
def pivot_dictionary(spark, d):
    return pivot.dictionary(T(spark, d, "orders"), "o_orderpriority", "o_orderkey").select(F.col("index").cast("int").alias("index"), "item")


@query("WITH x AS (SELECT o_orderpriority AS item, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY ALL) SELECT o_orderkey, CAST(i AS INTEGER) AS o_orderpriority_index FROM orders JOIN x ON item = o_orderpriority")
def pivot_records(spark, d):
    return pivot.records(T(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", F.col("o_orderpriority_index").cast("int").alias("o_orderpriority_index"))


@query("SELECT 'l_quantity' AS field, min(l_quantity) AS min_value, max(l_quantity) AS max_value, bool_and(l_quantity = floor(l_quantity)) AS all_integer, bool_or(l_quantity IS NULL) AS contains_blank FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount), bool_and(l_discount = floor(l_discount)), bool_or(l_discount IS NULL) FROM lineitem")
def pivot_summary(spark, d):
    return pivot.summary(T(spark, d, "lineitem"), ["l_quantity", "l_discount"])


@query("SELECT round(avg(o_totalprice), 4) AS o_totalprice, count(o_orderkey) AS o_orderkey, max(o_orderdate) AS o_orderdate, 'Total' AS o_orderstatus FROM orders")
def table_totals_row(spark, d):
    return tables.totals_row(T(spark, d, "orders"), {"o_totalprice": "average", "o_orderkey": "count", "o_orderdate": "max"}, {"o_orderstatus": "Total"}).select(*R("o_totalprice"), "o_orderkey", "o_orderdate", "o_orderstatus")


@query("SELECT round(sum(p_retailprice), 2) AS p_retailprice, round(stddev_samp(p_size), 4) AS p_size FROM part WHERE NOT p_size > 25")
def table_totals_visible(spark, d):
    return tables.totals_row(T(spark, d, "part").withColumn("hidden", F.col("p_size") > 25), {"p_retailprice": "sum", "p_size": "stdDev"}, hidden="hidden").select(*R("p_retailprice", digits=2), *R("p_size"))


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low') AND o_totalprice > 100000")
def autofilter(spark, d):
    df = T(spark, d, "orders")
    return rules.autofilter(df, [rules.values_filter(F.col("o_orderpriority"), ["1-URGENT", "5-low"]), rules.custom_filter(df, "o_totalprice", [("greaterThan", "100000")])]).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%a%e%' OR p_size <= 3")
def filter_wildcard(spark, d):
    df = T(spark, d, "part")
    return df.where(rules.custom_filter(df, "p_type", [("equal", "*A*e*")]) | rules.custom_filter(df, "p_size", [("lessThanOrEqual", "3")])).select("p_partkey")


def _customer_cells(spark, d):
    return plan.from_table(T(spark, d, "customer").withColumn("row", F.col("c_custkey")), "row", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("SELECT CAST(c_custkey AS INTEGER) AS row, c AS col, kind FROM (SELECT c_custkey, unnest([1, 2, 3, 4, 5]) AS c, unnest(['number', 'string', 'number', 'number', 'string']) AS kind FROM customer)")
def cells_of_table(spark, d):
    return _customer_cells(spark, d).select("row", "col", "kind")


@query("SELECT CAST(max(c_custkey) AS BIGINT) AS row_count, count(DISTINCT c_custkey) AS actual_row_count, CAST(5 AS BIGINT) AS column_count FROM customer")
def used_extent(spark, d):
    return extent.used_extent(_customer_cells(spark, d))


@query("SELECT CAST(c_custkey AS INTEGER) AS row, c_name AS name, c_mktsegment AS segment FROM customer")
def table_projection(spark, d):
    return plan.to_table(_customer_cells(spark, d), ["key", "name", "nation", "balance", "segment"]).select("row", "name", "segment")


@query("SELECT CAST(CASE WHEN c_custkey < 10 THEN c_custkey ELSE c_custkey - 3 END AS INTEGER) AS row, c AS col FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS c) WHERE c_custkey NOT BETWEEN 10 AND 14")
def splice_rows(spark, d):
    return grid.splice(_customer_cells(spark, d), "row", 10, 5, n_inserts=2).select("row", "col")


@query("SELECT CAST(c_custkey AS INTEGER) AS row, CASE WHEN c < 2 THEN c ELSE c - 1 END AS col FROM customer, (SELECT unnest([1, 3, 4, 5]) AS c)")
def splice_columns(spark, d):
    return grid.splice(_customer_cells(spark, d), "col", 2, 1).select("row", "col")


@query("SELECT CAST(CASE WHEN c_custkey <= 4 THEN c_custkey ELSE c_custkey + 2 END AS INTEGER) AS row, c AS col, CASE c WHEN 2 THEN c_name WHEN 5 THEN c_mktsegment ELSE '' END AS text FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS c) UNION ALL SELECT 4 + k, c, CASE c WHEN 2 THEN c_name WHEN 5 THEN c_mktsegment ELSE '' END FROM customer, (SELECT unnest([1, 2]) AS k), (SELECT unnest([1, 2, 3, 4, 5]) AS c) WHERE c_custkey = 4")
def duplicate_row(spark, d):
    return grid.duplicate_row(_customer_cells(spark, d), 4, 2).select("row", "col", F.coalesce("str", F.lit("")).alias("text"))


_RECTS = "(VALUES (1, 1, 1, 40, 3), (2, 20, 2, 80, 5), (3, 1, 4, 1048576, 4)) AS r(idx, t, l, b, g)"


@query(f"SELECT CAST(c_custkey AS INTEGER) AS row, c AS col, CAST(min(idx) AS INTEGER) AS rule_idx FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS c), {_RECTS} WHERE c_custkey BETWEEN t AND b AND c BETWEEN l AND g GROUP BY ALL")
def validation_lookup(spark, d):
    rects = spark.createDataFrame([(1, 1, 1, 40, 3), (2, 20, 2, 80, 5), (3, 1, 4, None, 4)], "idx int, top int, left int, bottom int, right int")
    return rules.first_rule(_customer_cells(spark, d).select("row", "col"), rects)


@query("SELECT l_orderkey, l_linenumber, l_quantity = floor(l_quantity) AND l_quantity BETWEEN 10 AND 30 AS ok FROM lineitem")
def validation_whole(spark, d):
    q = F.col("l_quantity")
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.validation_passes(F.lit("number"), q, q.cast("string"), "whole", "between", [10, 30]).alias("ok"))


@query("WITH b AS (SELECT min(o_totalprice) AS b FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10)) SELECT o_orderkey, o_totalprice >= b AS matched FROM orders, b")
def cf_top10(spark, d):
    return rules.top_n(T(spark, d, "orders"), "o_totalprice", 10).select("o_orderkey", "matched")


@query("SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS matched FROM orders")
def cf_above_average(spark, d):
    return rules.above_average(T(spark, d, "orders"), "o_totalprice").select("o_orderkey", "matched")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_name)) > 1 AS matched FROM part")
def cf_duplicate_values(spark, d):
    return rules.duplicates(T(spark, d, "part"), "p_name").select("p_partkey", "matched")


@query("SELECT p_partkey, round(CASE WHEN p_retailprice <= q THEN (p_retailprice - lo) / (q - lo) ELSE 1 + (p_retailprice - q) / (hi - q) END, 6) AS position FROM part, (SELECT min(p_retailprice) AS lo, quantile_cont(p_retailprice, 0.5) AS q, max(p_retailprice) AS hi FROM part)")
def cf_color_scale(spark, d):
    return rules.color_scale(T(spark, d, "part"), "p_retailprice", [("min", None), ("percentile", 50), ("max", None)]).select("p_partkey", *R("position", digits=6))


@query("SELECT p_partkey, contains(lower(p_type), 'steel') AS has, starts_with(lower(p_type), 's') AS begins, suffix(lower(p_type), 'l') AS ends FROM part")
def cf_text_rules(spark, d):
    t = F.col("p_type")
    return T(spark, d, "part").select("p_partkey", rules.text_rule(t, "containsText", "STEEL").alias("has"), rules.text_rule(t, "beginsWith", "S").alias("begins"), rules.text_rule(t, "endsWith", "L").alias("ends"))


@query("SELECT o_orderkey, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) ELSE chr(64 + (n - 27) // 676) || chr(65 + ((n - 27) // 26) % 26) || chr(65 + (n - 1) % 26) END AS letters, n AS back FROM (SELECT o_orderkey, CAST(o_orderkey % 16384 + 1 AS INTEGER) AS n FROM orders)")
def address_columns(spark, d):
    n = (F.col("o_orderkey") % 16384 + 1).cast("int")
    return T(spark, d, "orders").select("o_orderkey", address.number_to_column(n).alias("letters")).withColumn("back", address.column_to_number(F.col("letters")))


@query("SELECT o_orderkey, epoch_us(o_orderdate) / 86400000000.0 + 25569 AS serial, o_orderdate AS back FROM orders")
def date_serials(spark, d):
    df = T(spark, d, "orders").select("o_orderkey", dates.date_to_serial(F.col("o_orderdate")).alias("serial"))
    return df.withColumn("back", dates.serial_to_date(F.col("serial")))


@query("SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS text FROM events")
def number_text(spark, d):
    return T(spark, d, "events").select("event_id", values.js_number(F.col("value")).alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS field, 'date' AS kind, date_trunc('day', o_orderdate) AS ts FROM orders")
def csv_typing(spark, d):
    df = T(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("field"))
    return df.withColumn("v", values.csv_value(F.col("field"))).select("o_orderkey", "field", "v.kind", "v.ts")


@query("SELECT CAST(c_custkey AS INTEGER) AS row, c_custkey || ',' || CASE WHEN contains(c_name, ',') THEN '\"' || c_name || '\"' ELSE c_name END || ',' || c_nationkey || ',' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ',' || c_mktsegment AS line FROM customer")
def csv_lines(spark, d):
    return csvgrid.lines(_customer_cells(spark, d))


@query("""WITH r AS (SELECT o_orderkey AS n, CAST(o_custkey % 3 AS INTEGER) AS lv, o_totalprice < 250000 AS h FROM orders),
d AS (SELECT n, h, unnest(range(0, lv)) AS l FROM r), i AS (SELECT *, n - row_number() OVER (PARTITION BY l ORDER BY n) AS g FROM d),
u AS (SELECT l, max(n) + 1 AS beside FROM i GROUP BY l, g HAVING bool_and(h)) SELECT n AS o_orderkey, beside IS NOT NULL AS is_collapsed FROM r LEFT JOIN u ON n = beside AND lv = l""")
def outline_collapsed(spark, d):
    rows = T(spark, d, "orders").select(F.lit(1).alias("sheet_id"), F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 3).cast("int").alias("outline_level"), (F.col("o_totalprice") < 250000).alias("hidden"))
    return outline.collapsed(rows, ["sheet_id"]).select(F.col("row").alias("o_orderkey"), "is_collapsed")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-07' AND DATE '1996-03-13' AS last7, date_trunc('week', o_orderdate + INTERVAL 1 DAY) = date_trunc('week', DATE '1996-03-06' + INTERVAL 1 DAY) AS last_week,
date_trunc('month', o_orderdate) = DATE '1996-04-01' AS next_month FROM orders""")
def cf_time_period(spark, d):
    t, as_of = F.col("o_orderdate"), F.lit("1996-03-13")
    return T(spark, d, "orders").select("o_orderkey", *[rules.time_period(t, p, as_of).alias(n) for p, n in (("last7Days", "last7"), ("lastWeek", "last_week"), ("nextMonth", "next_month"))])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE p_size % 3 WHEN 0 THEN 'FFFFFFFF' WHEN 1 THEN 'FF000000' ELSE 'FFE7E6E6' END ELSE 'FFFF0000' END AS argb FROM part")
def color_references(spark, d):
    size = F.col("p_size")
    theme = F.when(size % 2 == 0, (size % 3).cast("int"))
    none = F.lit(None)
    return T(spark, d, "part").select("p_partkey", colors.resolved(none.cast("string"), theme, F.lit(10), none.cast("double")).alias("argb"))


def queries():
    from gridlake import queries_more  # noqa: F401  adds its own

    return dict(Q)


def oracle_sql():
    queries()
    return dict(S)
