"""Queries over the test tables, each with the SQL that it should agree with.

Two versions of a table are derived from one by rules on its key, so that an
SQL engine can derive the same.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canon import canonical, four_digits, parsed, readable_size, row_sum
from ..functions.lineage import shared_folder
from ..operators import history, ingest, profile, rowdiff
from ..operators.merge import Merge, merge
from ..streaming.commits import change_counts
from . import sqltext
from .versions import VersionStore, object_sizes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Versions: (new, old) in both languages.


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = four_digits(table(spark, sf_dir, "orders"))
    changed = F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    return t.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", changed), t.where("o_orderkey % 17 <> 0")


ORDERS_NEW = "(SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 13 <> 0)"
ORDERS_OLD = "(SELECT * FROM orders WHERE o_orderkey % 17 <> 0)"
ORDERS_DIFF = sqltext.diff(ORDERS_NEW, ORDERS_OLD, ["o_orderkey"], sqltext.ORDERS)


def customer_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = four_digits(table(spark, sf_dir, "customer"))
    moved = F.when(F.col("c_custkey") % 10 == 0, (F.col("c_nationkey") + 1).cast("int")).otherwise(F.col("c_nationkey"))
    return t.where("c_custkey % 13 <> 0").withColumn("c_nationkey", moved), t.where("c_custkey % 17 <> 0")


CUSTOMER_NEW = "(SELECT * REPLACE (CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey) FROM customer WHERE c_custkey % 13 <> 0)"
CUSTOMER_OLD = "(SELECT * FROM customer WHERE c_custkey % 17 <> 0)"
CUSTOMER_DIFF = sqltext.diff(CUSTOMER_NEW, CUSTOMER_OLD, ["c_custkey"], sqltext.CUSTOMER)


# Differences


@query(f"SELECT status, o_orderkey, \"sum\", old_sum FROM ({ORDERS_DIFF}) WHERE status <> 'unchanged'")
def diff_rows_orders(spark, sf_dir):
    return rowdiff.row_diff(*orders_pair(spark, sf_dir), ["o_orderkey"])


@query(
    f"""SELECT count_if(status = 'added')::BIGINT AS rows_added, count_if(status = 'removed')::BIGINT AS rows_removed, count_if(status = 'modified')::BIGINT AS rows_modified,
    0::BIGINT AS columns_added, 0::BIGINT AS columns_removed, NULL::VARCHAR AS key_change FROM ({ORDERS_DIFF})"""
)
def diff_summary_orders(spark, sf_dir):
    return rowdiff.summary(*orders_pair(spark, sf_dir), ["o_orderkey"])


def _of_status(status: str) -> None:
    def run(spark, sf_dir):
        d = rowdiff.row_diff(*customer_pair(spark, sf_dir), ["c_custkey"], unchanged=status == "unchanged")
        return d.where(F.col("status") == status).select("c_custkey", "sum", "old_sum")

    run.__name__ = f"diff_{status}"
    query(f"SELECT c_custkey, \"sum\", old_sum FROM ({CUSTOMER_DIFF}) WHERE status = '{status}'")(run)


for _status in ("added", "removed", "modified", "unchanged"):
    _of_status(_status)

_LINES = {"l_orderkey": "i", "l_linenumber": "i", "l_partkey": "i", "l_quantity": "d", "l_returnflag": "s"}
_LINES_SQL = "(SELECT l_orderkey, l_linenumber, min((l_partkey, l_quantity, l_returnflag)) AS r FROM lineitem GROUP BY ALL)"
_LINES_ROWS = f"(SELECT l_orderkey, l_linenumber, r[1] AS l_partkey, r[2] AS l_quantity, r[3] AS l_returnflag FROM {_LINES_SQL})"
_LINES_NEW = f"(SELECT * REPLACE (CASE WHEN l_orderkey % 9 = 0 THEN 'Z' ELSE l_returnflag END AS l_returnflag) FROM {_LINES_ROWS} WHERE (l_orderkey + l_linenumber) % 11 <> 0)"
_LINES_DIFF = sqltext.diff(_LINES_NEW, f"(SELECT * FROM {_LINES_ROWS} WHERE (l_orderkey + l_linenumber) % 7 <> 0)", ["l_orderkey", "l_linenumber"], _LINES)


@query(f"SELECT status, l_orderkey, l_linenumber FROM ({_LINES_DIFF}) WHERE status <> 'unchanged'")
def diff_composite_pk(spark, sf_dir):
    t = ingest.one_per_key(table(spark, sf_dir, "lineitem").select(*_LINES), ["l_orderkey", "l_linenumber"])
    t = four_digits(t)
    new = t.where("(l_orderkey + l_linenumber) % 11 <> 0").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 9 == 0, "Z").otherwise(F.col("l_returnflag")))
    d = rowdiff.row_diff(new, t.where("(l_orderkey + l_linenumber) % 7 <> 0"), ["l_orderkey", "l_linenumber"])
    return d.select("status", "l_orderkey", "l_linenumber")


@query(
    """WITH n AS (SELECT p_name, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0), o AS (SELECT p_name, p_brand, p_size FROM part WHERE p_partkey % 7 <> 0)
    SELECT 'added' AS status, * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"""
)
def diff_no_pk(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    side = lambda m: ingest.one_per_key(t.where(f"p_partkey % {m} <> 0").select("p_name", "p_brand", "p_size"), [])
    return rowdiff.row_diff(side(5), side(7), []).drop("sum", "old_sum")


@query(
    f"""SELECT CASE WHEN status = 'unchanged' THEN 'modified' ELSE status END AS status, c_custkey FROM ({CUSTOMER_DIFF})"""
)
def diff_columns_changed(spark, sf_dir):
    new, old = customer_pair(spark, sf_dir)
    new = new.drop("c_mktsegment").withColumn("c_region", F.col("c_nationkey") % 5)
    return rowdiff.row_diff(new, old, ["c_custkey"]).select("status", "c_custkey")


@query(
    """SELECT s_suppkey, u."column", u.old, u.new FROM (
      SELECT s_suppkey, unnest([{'column': 's_acctbal', 'old': s_acctbal::DECIMAL(38,4)::VARCHAR, 'new': (s_acctbal + 1.5)::DECIMAL(38,4)::VARCHAR},
                               {'column': 's_name', 'old': s_name, 'new': CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) || '!' ELSE s_name END}]) AS u
      FROM supplier WHERE s_suppkey % 3 <> 0) WHERE u.old IS DISTINCT FROM u.new"""
)
def diff_cells(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    louder = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.upper("s_name"), F.lit("!"))).otherwise(F.col("s_name"))
    new = t.where("s_suppkey % 3 <> 0").withColumn("s_acctbal", F.col("s_acctbal") + 1.5).withColumn("s_name", louder)
    return rowdiff.cell_diff(four_digits(new), four_digits(t), ["s_suppkey"])


@query(
    """SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'x' || n_name || '|' || n_name END AS n_name,
    n_regionkey::VARCHAR AS n_regionkey, 'new' AS extra FROM nation"""
)
def diff_combined_rows(spark, sf_dir):
    old = table(spark, sf_dir, "nation")
    new = old.withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("x"), "n_name"))).withColumn("extra", F.lit("new"))
    rows = rowdiff.combined_rows(new, old, ["n_nationkey"])
    return rows.select(*(F.array_join(c, "|").alias(c) for c in rows.columns))


@query(
    """WITH o AS (SELECT * FROM nation WHERE n_nationkey % 5 <> 0), n AS (SELECT * REPLACE (n_regionkey + 1 AS n_regionkey) FROM nation WHERE n_nationkey % 3 <> 0)
    SELECT * FROM (VALUES (0, '', 0, 'COLUMNS IN old', 'n_nationkey|n_name|n_regionkey'), (0, '', 1, 'COLUMNS IN new', 'n_nationkey|n_name|n_regionkey'),
                          (0, '', 2, 'PRIMARY KEY IN old', 'true||'), (0, '', 3, 'PRIMARY KEY IN new', 'true||')) AS t(section, key, line, label, cells)
    UNION ALL SELECT 1, n_nationkey::VARCHAR, 0, 'ADDED IN new', n_nationkey || '|' || n_name || '|' || n_regionkey FROM n WHERE n_nationkey NOT IN (SELECT n_nationkey FROM o)
    UNION ALL SELECT 2, n_nationkey::VARCHAR, 0, 'REMOVED IN new', n_nationkey || '|' || n_name || '|' || n_regionkey FROM o WHERE n_nationkey NOT IN (SELECT n_nationkey FROM n)
    UNION ALL SELECT 1, n_nationkey::VARCHAR, 0, 'BASE ROW FROM old', n_nationkey || '|' || n_name || '|' || n_regionkey FROM o WHERE n_nationkey IN (SELECT n_nationkey FROM n)
    UNION ALL SELECT 1, n_nationkey::VARCHAR, 1, 'MODIFIED IN new', n_nationkey || '|' || n_name || '|' || n_regionkey FROM n WHERE n_nationkey IN (SELECT n_nationkey FROM o)"""
)
def diff_labelled_export(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    new = t.where("n_nationkey % 3 <> 0").withColumn("n_regionkey", (F.col("n_regionkey") + 1).cast("int"))
    return rowdiff.labelled(new, t.where("n_nationkey % 5 <> 0"), ["n_nationkey"]).withColumn("cells", F.array_join("cells", "|"))


_LINE = """'rows: +' || count_if(status = 'added') || '/-' || count_if(status = 'removed') || '/m' || count_if(status = 'modified')"""


@query(f"SELECT 'customers' AS branch, {_LINE} AS summary FROM ({CUSTOMER_DIFF}) UNION ALL SELECT 'orders', {_LINE} FROM ({ORDERS_DIFF})")
def diff_multi_branch_summary(spark, sf_dir):
    same = table(spark, sf_dir, "region")
    return rowdiff.multi_summary(
        {
            "orders": (*orders_pair(spark, sf_dir), ["o_orderkey"]),
            "customers": (*customer_pair(spark, sf_dir), ["c_custkey"]),
            "same": (same, same, ["r_regionkey"]),
        }
    )


# Ingest


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(ts, event_id) AS ts, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def dedup_by_pk(spark, sf_dir):
    return ingest.one_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def distinct_rows(spark, sf_dir):
    return ingest.one_per_key(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"), [])


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_documents(spark, sf_dir):
    return ingest.one_per_key(table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"])


_PLACED = "SELECT *, row_number() OVER (ORDER BY {0}) - 1 AS \"row\" FROM {1}"


@query(f"""SELECT o_orderkey, "row", "row" // 255 AS block, "row" % 255 AS "offset" FROM ({_PLACED.format("o_orderkey", "orders")})""")
def sorted_blocks(spark, sf_dir):
    return ingest.blocks(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    f"""SELECT block, count(*) AS rows, md5(string_agg(s, '' ORDER BY "row")) AS "sum", min_by(o_orderkey, "row")::VARCHAR AS first_key FROM (
    SELECT *, "row" // 255 AS block, {sqltext.row_sum(sqltext.ORDERS)} AS s FROM ({_PLACED.format("o_orderkey", "orders")})) GROUP BY block"""
)
def block_sums(spark, sf_dir):
    return ingest.block_sums(four_digits(table(spark, sf_dir, "orders")), ["o_orderkey"])


@query(f"SELECT c_custkey, {sqltext.row_sum(sqltext.CUSTOMER)} AS row_sum, {sqltext.row_sum({'c_custkey': 'i'})} AS pk_sum FROM customer")
def row_hashes(spark, sf_dir):
    t = four_digits(table(spark, sf_dir, "customer"))
    return t.select("c_custkey", row_sum(t).alias("row_sum"), row_sum(t, ["c_custkey"]).alias("pk_sum"))


@query(f"""SELECT c_custkey, c_name, "row" FROM ({_PLACED.format("c_custkey", "customer")}) WHERE "row" IN (0, 7, 100, 1499, 1000000)""")
def rows_at_offsets(spark, sf_dir):
    return ingest.rows_at(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], [0, 7, 100, 1499, 1_000_000])


@query(f"""SELECT c_name, c_custkey, "row" // 255 AS block, "row" % 255 AS "offset", "row" FROM ({_PLACED.format("c_name, c_custkey", "customer")}) WHERE "row" // 255 IN (1, 2)""")
def block_range(spark, sf_dir):
    return ingest.block_range(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], 1, 3)


@query("SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_detection(spark, sf_dir):
    return ingest.duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


# Profiles

_PROFILED = {
    "customer": sqltext.CUSTOMER,
    "part": sqltext.PART,
    "events": sqltext.EVENTS,
    "lineitem": sqltext.LINEITEM,
}
_COUNTS = {t: sqltext.counts(t, c) for t, c in _PROFILED.items()}


def _profiled(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    return profile.counted(four_digits(table(spark, sf_dir, name)), list(_PROFILED[name]))


_MEAN = "CASE WHEN \"numeric\" AND filled > 0 THEN " + sqltext.ROUND2.format("(total / filled)") + " END AS mean"
_AVG_LEN = "CASE WHEN filled = 0 THEN 0 ELSE floor(bytes / filled + 0.5) END::INT AS avg_str_len"
_MIN_MAX = 'CASE WHEN "numeric" THEN mn END AS "min", CASE WHEN "numeric" THEN mx END AS "max"'


@query(f"""SELECT "column", rows, na_count, filled, "numeric", {_MIN_MAX}, {_MEAN}, min_str_len, max_str_len, {_AVG_LEN} FROM ({sqltext.stats(_COUNTS["customer"])})""")
def profile_basic(spark, sf_dir):
    return _profiled(spark, sf_dir, "customer")[1]


@query(f"""SELECT "column", rows, na_count, filled, "numeric", {_MIN_MAX}, {_MEAN}, min_str_len, max_str_len, {_AVG_LEN} FROM ({sqltext.stats(_COUNTS["lineitem"])})""")
def profile_lineitem(spark, sf_dir):
    return _profiled(spark, sf_dir, "lineitem")[1]


@query(
    f"""WITH v AS ({_COUNTS["part"]}), s AS (SELECT *, {_MEAN} FROM ({sqltext.stats(_COUNTS["part"])}))
    SELECT "column", {sqltext.ROUND2.format('sqrt(sum("count" * pow(value::DOUBLE - mean, 2)) / max(rows))')} AS std_deviation
    FROM (SELECT v.*, s.mean, s.rows FROM v JOIN s ON v."column" = s."column" WHERE s."numeric" AND value <> '') GROUP BY "column" """
)
def profile_stddev(spark, sf_dir):
    return profile.deviations(*_profiled(spark, sf_dir, "part"))


@query(
    f"""SELECT "column", max(CASE WHEN p = 50 THEN v END) AS median, string_agg(v::DECIMAL(18,2)::VARCHAR, ',' ORDER BY p) AS percentiles
    FROM ({sqltext.percentile_rows(_COUNTS["customer"])}) GROUP BY "column" """
)
def profile_percentiles(spark, sf_dir):
    p = profile.percentiles(*_profiled(spark, sf_dir, "customer"))
    return p.select("column", "median", F.array_join(F.transform("percentiles", lambda v: v.cast("decimal(18,2)").cast("string")), ",").alias("percentiles"))


@query(f"""SELECT "column", max(CASE WHEN p = 50 THEN v END) AS median FROM ({sqltext.percentile_rows(_COUNTS["events"])}) GROUP BY "column" """)
def profile_median(spark, sf_dir):
    return profile.percentiles(*_profiled(spark, sf_dir, "events")).select("column", "median")


@query(sqltext.top(_COUNTS["part"]))
def profile_top_values(spark, sf_dir):
    return profile.top_values(*_profiled(spark, sf_dir, "part"))


_CELLS = ["1", "-2.5", "+3e2", ".5", "5.", "1e400", " 1", "1 ", "1.0d", "1f", "", "abc", "--1", "1e", "007"]
_NAMED = {"inf": "'inf'", "-Infinity": "'-inf'", "NaN": "'nan'", "infinite": "NULL", "0x1p3": "8", "-0X1.8p-1": "-0.75", "0x.8p0": "0.5", "0x1": "NULL", "0xp1": "NULL"}


@query(
    f"""SELECT value, CASE WHEN {sqltext.NUMBER} AND isfinite(TRY_CAST(value AS DOUBLE)) THEN TRY_CAST(value AS DOUBLE)::VARCHAR END AS number FROM (SELECT unnest({_CELLS!r}) AS value)
    UNION ALL SELECT value, number::DOUBLE::VARCHAR FROM (VALUES {", ".join(f"('{v}', {n}::DOUBLE)" for v, n in _NAMED.items())}) AS t(value, number)"""
)
def profile_numeric_detection(spark, sf_dir):
    number = parsed(F.col("value"))
    text = F.when(F.isnan(number), "nan").when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf")).otherwise(number.cast("string"))
    return spark.createDataFrame([(c,) for c in [*_CELLS, *_NAMED]], "value string").withColumn("number", text)


def _orders_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(profile.profile(t, ["o_custkey", "o_orderstatus", "o_orderpriority"]) for t in orders_pair(spark, sf_dir))


_OCOLS = {"o_custkey": "i", "o_orderstatus": "s", "o_orderpriority": "s"}
_ONEW, _OOLD = sqltext.counts(ORDERS_NEW, _OCOLS), sqltext.counts(ORDERS_OLD, _OCOLS)


@query(
    f"""WITH n AS ({sqltext.top(_ONEW)}), o AS ({sqltext.top(_OOLD)}), rn AS (SELECT count(*) AS c FROM {ORDERS_NEW}), ro AS (SELECT count(*) AS c FROM {ORDERS_OLD}),
    b AS (SELECT coalesce(o."column", n."column") AS "column", coalesce(o.value, n.value) AS value, o.rank AS r1, n.rank AS r2, coalesce(o."count", 0)::BIGINT AS old_count, coalesce(n."count", 0)::BIGINT AS new_count
          FROM o FULL JOIN n ON o."column" = n."column" AND o.value = n.value)
    SELECT "column", (row_number() OVER (PARTITION BY "column" ORDER BY r1 IS NULL, r1, r2))::INT AS position, value, old_count, new_count,
           floor(old_count / (SELECT c FROM ro) * 100 + 0.5)::INT AS old_pct, floor(new_count / (SELECT c FROM rn) * 100 + 0.5)::INT AS new_pct FROM b"""
)
def profile_diff_top_values(spark, sf_dir):
    return profile.top_values_diff(*_orders_profiles(spark, sf_dir))


@query(
    f"""WITH n AS ({sqltext.percentile_rows(_ONEW)}), o AS ({sqltext.percentile_rows(_OOLD)})
    SELECT n."column", n.p::INT AS percent, o.v AS old, n.v AS "new" FROM n JOIN o ON n."column" = o."column" AND n.p = o.p"""
)
def profile_diff_percentiles(spark, sf_dir):
    return profile.percentiles_diff(*_orders_profiles(spark, sf_dir))


def _scalar_sql(counts: str) -> str:
    deviation = sqltext.ROUND2.format("""sqrt(sum("count" * pow(value::DOUBLE - mean, 2)) / max(rows))""")
    return f"""SELECT f."column", unnest(['na_count', 'min', 'max', 'mean', 'median', 'std_deviation', 'min_str_len', 'max_str_len', 'avg_str_len']) AS stat,
      unnest([na_count::DOUBLE, "min", "max", f.mean, median, std_deviation, min_str_len::DOUBLE, max_str_len::DOUBLE, avg_str_len::DOUBLE]) AS v
      FROM (SELECT "column", na_count, {_MIN_MAX}, {_MEAN}, min_str_len, max_str_len, {_AVG_LEN} FROM ({sqltext.stats(counts)})) f
      LEFT JOIN (SELECT "column", max(CASE WHEN p = 50 THEN v END) AS median FROM ({sqltext.percentile_rows(counts)}) GROUP BY "column") m ON m."column" = f."column"
      LEFT JOIN (SELECT v."column", {deviation} AS std_deviation
                 FROM ({counts}) v JOIN (SELECT "column", rows, "numeric", {_MEAN} FROM ({sqltext.stats(counts)})) s ON v."column" = s."column" WHERE s."numeric" AND value <> '' GROUP BY v."column") d
      ON d."column" = f."column" """


@query(
    f"""SELECT n."column", n.stat, o.v AS old, n.v AS "new", o.v IS NOT DISTINCT FROM n.v AS unchanged FROM ({_scalar_sql(_ONEW)}) n JOIN ({_scalar_sql(_OOLD)}) o ON n."column" = o."column" AND n.stat = o.stat
    WHERE n.stat = 'na_count' OR coalesce(o.v, 0) <> 0 OR coalesce(n.v, 0) <> 0"""
)
def profile_diff_scalar(spark, sf_dir):
    return profile.scalar_diff(*_orders_profiles(spark, sf_dir))


@query(
    f"""WITH n AS ({_scalar_sql(_ONEW)}), o AS ({_scalar_sql(_OOLD)}), rows AS (SELECT (SELECT count(*) FROM {ORDERS_NEW}) AS new_rows, (SELECT count(*) FROM {ORDERS_OLD}) AS old_rows)
    SELECT n."column", CASE WHEN n."column" = 'o_orderpriority' THEN 'added' ELSE 'changed' END AS status, new_rows, CASE WHEN n."column" <> 'o_orderpriority' THEN old_rows END AS old_rows FROM (SELECT DISTINCT "column" FROM n) n, rows
    UNION ALL SELECT 'o_comment', 'removed', NULL, old_rows FROM rows"""
)
def profile_diff_table(spark, sf_dir):
    new, old = orders_pair(spark, sf_dir)
    profiles = profile.profile(new, ["o_custkey", "o_orderstatus", "o_orderpriority"]), profile.profile(old.withColumn("o_comment", F.lit("x")), ["o_custkey", "o_orderstatus", "o_comment"])
    return profile.table_diff(*profiles).select("column", "status", "new_rows", "old_rows")


# Streams: the counts that a stream makes, over the table that it would bring


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS rows FROM events GROUP BY ALL")
def change_counts_by_hour(spark, sf_dir):
    return change_counts(table(spark, sf_dir, "events"), "ts", "event_type")


# Merges: layers of customer that change, remove and add rows by rules on the key


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    set_if = lambda c, rule, value: F.when(F.expr(rule), F.lit(value)).otherwise(F.col(c))
    one = base.where("c_custkey % 19 <> 0").withColumn("c_name", set_if("c_name", "c_custkey % 3 = 0", "one")).withColumn("c_mktsegment", set_if("c_mktsegment", "c_custkey % 11 = 0", "ONE"))
    two = base.where("c_custkey % 23 <> 0").withColumn("c_name", set_if("c_name", "c_custkey % 7 = 0", "two")).withColumn("c_mktsegment", set_if("c_mktsegment", "c_custkey % 5 = 0", "TWO"))
    return base, [one, two]


_MERGED = """SELECT b.c_custkey, b.c_name AS n0, b.c_mktsegment AS m0, k % 19 <> 0 AS h1, k % 23 <> 0 AS h2,
  CASE WHEN k % 3 = 0 THEN 'one' ELSE b.c_name END AS n1, CASE WHEN k % 11 = 0 THEN 'ONE' ELSE b.c_mktsegment END AS m1,
  CASE WHEN k % 7 = 0 THEN 'two' ELSE b.c_name END AS n2, CASE WHEN k % 5 = 0 THEN 'TWO' ELSE b.c_mktsegment END AS m2
  FROM (SELECT *, c_custkey AS k FROM customer) b"""
_CELL = """CASE WHEN {c} THEN {x}0 WHEN h1 AND {x}1 <> {x}0 THEN {x}1 WHEN h2 AND {x}2 <> {x}0 THEN {x}2 ELSE {x}0 END"""
_CLASH = """((h1 AND {x}1 <> {x}0 AND h2 AND {x}2 <> {x}0 AND {x}1 <> {x}2) OR (NOT (h1 AND h2) AND ((h1 AND {x}1 <> {x}0) OR (h2 AND {x}2 <> {x}0))))"""
_JUDGED = f"""SELECT c_custkey, n0, m0, n1, m1, n2, m2, h1, h2, {_CELL.format(c=_CLASH.format(x="n"), x="n")} AS c_name, {_CELL.format(c=_CLASH.format(x="m"), x="m")} AS c_mktsegment,
  {_CLASH.format(x="n")} AS cn, {_CLASH.format(x="m")} AS cm, h1 AND h2 AS here,
  NOT (h1 AND h2) AND NOT (h1 AND (n1 <> n0 OR m1 <> m0)) AND NOT (h2 AND (n2 <> n0 OR m2 <> m0)) AS dropped FROM ({_MERGED})"""


def _merge(spark: SparkSession, sf_dir: str) -> Merge:
    base, layers = _layers(spark, sf_dir)
    return merge(base, layers, ["c_custkey"])


@query(f"SELECT c_custkey, c_name, c_mktsegment FROM ({_JUDGED}) WHERE here AND NOT cn AND NOT cm")
def merge_resolved(spark, sf_dir):
    return _merge(spark, sf_dir).resolved()


@query(
    f"""SELECT c_custkey, c_name, c_mktsegment, concat_ws(',', CASE WHEN cn THEN 'c_name' END, CASE WHEN cm THEN 'c_mktsegment' END) AS unresolved,
    c_custkey || ',' || n0 || ',' || m0 || CASE WHEN h1 THEN ';' || c_custkey || ',' || n1 || ',' || m1 ELSE '' END || CASE WHEN h2 THEN ';' || c_custkey || ',' || n2 || ',' || m2 ELSE '' END AS versions
    FROM ({_JUDGED}) WHERE NOT dropped AND (NOT here OR cn OR cm)"""
)
def merge_conflicts(spark, sf_dir):
    lines = F.array_join(F.transform(F.array_compact("versions"), lambda v: F.array_join(v, ",")), ";")
    return _merge(spark, sf_dir).conflicts().withColumns({"unresolved": F.array_join("unresolved", ","), "versions": lines})


@query(f"SELECT count_if(dropped)::BIGINT AS dropped, count_if(NOT dropped AND here AND NOT cn AND NOT cm)::BIGINT AS resolved, count_if(NOT dropped AND (NOT here OR cn OR cm))::BIGINT AS conflicts FROM ({_JUDGED})")
def merge_summary(spark, sf_dir):
    return _merge(spark, sf_dir).rows.agg(F.count_if("dropped").alias("dropped"), F.count_if(F.expr("NOT dropped AND resolved")).alias("resolved"), F.count_if(F.expr("NOT dropped AND NOT resolved")).alias("conflicts"))


@query(
    f"""SELECT c_custkey, c_name, c_mktsegment FROM ({_JUDGED}) WHERE here AND NOT cn AND NOT cm
    UNION ALL SELECT c_custkey, 'decided', 'D' FROM ({_JUDGED}) WHERE NOT dropped AND (NOT here OR cn OR cm) AND c_custkey % 2 = 0"""
)
def merge_manual_resolution(spark, sf_dir):
    m = _merge(spark, sf_dir)
    decided = m.conflicts().select("c_custkey", F.lit("decided").alias("c_name"), F.lit("D").alias("c_mktsegment"), (F.col("c_custkey") % 2 == 1).alias("drop"))
    return m.result(decided)


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'one' ELSE n_name END AS n_name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'note' || n_nationkey END AS note
    FROM nation"""
)
def merge_added_column(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    one = base.withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, "one").otherwise(F.col("n_name")))
    two = base.withColumn("note", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("note"), "n_nationkey")))
    return merge(base, [one, two], ["n_nationkey"]).result()


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'one' ELSE s_name END AS s_name FROM supplier")
def merge_removed_column(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    one = base.withColumn("s_name", F.when(F.col("s_suppkey") % 2 == 0, "one").otherwise(F.col("s_name")))
    return merge(base, [one, base.drop("s_acctbal")], ["s_suppkey"]).result()


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'two' WHEN s_suppkey % 3 = 0 THEN 'three' ELSE s_name END AS s_name,
    CASE WHEN s_suppkey % 6 = 0 THEN 's_name' ELSE '' END AS unresolved FROM supplier"""
)
def merge_three_layers(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    layers = [base.withColumn("s_name", F.when(F.col("s_suppkey") % n == 0, name).otherwise(F.col("s_name"))) for n, name in ((2, "two"), (3, "three"))]
    rows = merge(base, [*layers, base], ["s_suppkey"]).rows
    return rows.select("s_suppkey", "s_name", F.array_join("unresolved", ",").alias("unresolved"))


@query(
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END::INT AS c_nationkey,
    CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 0.000001 WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 4 = 2 THEN 1e40 ELSE c_acctbal END::DOUBLE AS c_acctbal, c_mktsegment FROM customer"""
)
def merge_typed(spark, sf_dir):
    base = table(spark, sf_dir, "customer")
    quarter = F.col("c_custkey") % 4
    close = F.when(quarter == 0, F.col("c_acctbal") + 0.000001).when(quarter == 1, None).when(quarter == 2, 1e40).otherwise(F.col("c_acctbal"))
    two = base.withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + 1).cast("int")).otherwise(F.col("c_nationkey")))
    return merge(base, [base.withColumn("c_acctbal", close), two], ["c_custkey"]).result()


_ALL_LINES = list(sqltext.LINEITEM)
_REST = [c for c in _ALL_LINES if c not in ("l_orderkey", "l_linenumber")]
_WHOLE = f"(SELECT l_orderkey, l_linenumber, {', '.join(f'r[{i}] AS {c}' for i, c in enumerate(_REST, 1))} FROM (SELECT l_orderkey, l_linenumber, min(({', '.join(_REST)})) AS r FROM lineitem GROUP BY ALL))"


@query(
    f"""WITH o AS {_WHOLE}, n AS (SELECT * REPLACE (CASE l_linenumber WHEN 1 THEN l_extendedprice + 0.000001 WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 1e40 WHEN 4 THEN NULL ELSE l_extendedprice END AS l_extendedprice) FROM o)
    SELECT 'modified' AS status, n.l_orderkey, n.l_linenumber FROM n JOIN o USING (l_orderkey, l_linenumber) WHERE n.l_extendedprice IS DISTINCT FROM o.l_extendedprice"""
)
def diff_small_changes(spark, sf_dir):
    old = ingest.one_per_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_REST), ["l_orderkey", "l_linenumber"])
    line, price = F.col("l_linenumber"), F.col("l_extendedprice")
    new = old.withColumn("l_extendedprice", F.when(line == 1, price + 0.000001).when(line == 2, float("nan")).when(line == 3, 1e40).when(line == 4, None).otherwise(price))
    return rowdiff.row_diff(new, old, ["l_orderkey", "l_linenumber"]).drop("sum", "old_sum")


# Commit graph: each order is a commit, a customer's orders of one status are a branch that begins at the customer's first order;
# every seventh merges what the customer had before


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, branches): edges (child, parent), and (customer, segment, status, head) of each branch."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")
    every = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.withColumns({"p1": F.coalesce(F.lag("o_orderkey").over(own), F.first("o_orderkey").over(every)), "p2": F.when(F.col("o_orderkey") % 7 == 0, F.lag("o_orderkey").over(every))})
    edges = o.select(F.col("o_orderkey").alias("child"), F.explode(F.array_compact(F.array("p1", "p2"))).alias("parent")).where("child <> parent").distinct()
    heads = o.groupBy("o_custkey", "c_mktsegment", "o_orderstatus").agg(F.max("o_orderkey").alias("head"))
    return edges, heads


_HISTORY = """o AS (SELECT *, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey), min(o_orderkey) OVER (PARTITION BY o_custkey)) AS p1,
    CASE WHEN o_orderkey % 7 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS p2 FROM orders JOIN customer ON o_custkey = c_custkey),
  e AS (SELECT DISTINCT child, parent FROM (SELECT o_orderkey AS child, unnest([p1, p2]) AS parent FROM o) WHERE child <> parent),
  heads AS (SELECT o_custkey, c_mktsegment, o_orderstatus, max(o_orderkey) AS head FROM o GROUP BY ALL)"""


def _up(**starts: str) -> str:
    """SQL that begins with the history, and the commits that each of some sets of starts leads to."""
    walks = (f"{n}(sum) AS (SELECT DISTINCT head FROM ({q}) UNION SELECT e.parent FROM e JOIN {n} ON e.child = {n}.sum)" for n, q in starts.items())
    return f"WITH RECURSIVE {', '.join([_HISTORY, *walks])} "


_BUILDING = "SELECT head FROM heads WHERE c_mktsegment = 'BUILDING'"


def _sums(heads: DataFrame) -> DataFrame:
    return heads.select(F.col("head").alias("sum"))


@query(_up(up=_BUILDING) + "SELECT sum FROM up")
def commit_ancestors(spark, sf_dir):
    edges, heads = _history(spark, sf_dir)
    return history.ancestors(edges, _sums(heads.where("c_mktsegment = 'BUILDING'")))


@query(
    f"""WITH RECURSIVE {_HISTORY}, pairs AS (SELECT x.head AS a, y.head AS b FROM heads x JOIN heads y ON x.o_custkey = y.o_custkey AND x.o_orderstatus < y.o_orderstatus),
    up(head, sum) AS (SELECT DISTINCT head, head FROM heads UNION SELECT up.head, e.parent FROM up JOIN e ON e.child = up.sum),
    common AS (SELECT a, b, x.sum FROM pairs JOIN up x ON x.head = a JOIN up y ON y.head = b AND y.sum = x.sum),
    inner_ AS (SELECT DISTINCT a, b, e.parent AS sum FROM common JOIN e ON e.child = common.sum)
    SELECT a, b, max(sum) AS base FROM common ANTI JOIN inner_ USING (a, b, sum) GROUP BY a, b"""
)
def commit_merge_base(spark, sf_dir):
    edges, heads = _history(spark, sf_dir)
    x, y = heads.alias("x"), heads.alias("y")
    pairs = x.join(y, F.expr("x.o_custkey = y.o_custkey AND x.o_orderstatus < y.o_orderstatus")).select(F.col("x.head").alias("a"), F.col("y.head").alias("b"))
    return history.merge_bases(edges, pairs)


@query(_up(up=_BUILDING) + "SELECT o_orderkey AS sum FROM o WHERE o_orderkey NOT IN (SELECT sum FROM up)")
def prune_unreachable(spark, sf_dir):
    edges, heads = _history(spark, sf_dir)
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sum"))
    return history.unreachable(commits, edges, _sums(heads.where("c_mktsegment = 'BUILDING'")))


@query(_up(up="SELECT head FROM heads", down="SELECT head FROM heads WHERE o_orderstatus = 'F'") + "SELECT sum FROM up WHERE sum NOT IN (SELECT sum FROM down)")
def sync_set(spark, sf_dir):
    edges, heads = _history(spark, sf_dir)
    return history.to_send(edges, _sums(heads), _sums(heads.where("o_orderstatus = 'F'")))


# The store: a branch a nation with a commit for each version, and a tag a region; and stored versions of tables


def _named_store(spark: SparkSession, sf_dir: str) -> VersionStore:
    """Commits and refs of the 25 nations and 5 regions; metadata only, in a folder of the driver's."""
    store = VersionStore(spark, tempfile.mkdtemp())
    for n in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # the store's metadata is the driver's
        for i in range(1 + n["n_nationkey"] % 3):
            commit = store.add_commit(f"t{i}", [], f"version {i}", at=float(i), zone="+0000")
            store.set_ref(f"heads/{n['n_name']}", commit, "branch" if i == 0 else "commit")
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        store.set_ref(f"tags/{r['r_name']}", store.add_commit("t0", [], "version 0", at=0.0, zone="+0000"), "tag")
    return store


@query(
    """SELECT 'heads/' || n_name AS ref, (1 + n_nationkey % 3)::INT AS ordinal, CASE WHEN n_nationkey % 3 = 0 THEN 'branch' ELSE 'commit' END AS action FROM nation
    UNION ALL SELECT 'tags/' || r_name, 1, 'tag' FROM region"""
)
def reflog_latest(spark, sf_dir):
    return _named_store(spark, sf_dir).latest().drop("new")


@query("SELECT 'heads/' || n_name AS ref FROM nation WHERE n_name NOT LIKE 'NATION_1%'")
def refs_filter(spark, sf_dir):
    return spark.createDataFrame([(r,) for r in _named_store(spark, sf_dir).refs_like("heads/", but_not="heads/NATION_1")], "ref string")


@query(
    """WITH refs AS (SELECT length('heads/' || n_name) AS n FROM nation UNION ALL SELECT length('tags/' || r_name) FROM region)
    SELECT 'refs' AS kind, count(*) AS objects, avg(n) AS mean_key_size, median(n)::DOUBLE AS median_key_size, stddev_pop(n) AS std_key_size, 34::DOUBLE AS mean_value_size FROM refs"""
)
def object_size_stats(spark, sf_dir):
    return object_sizes(_named_store(spark, sf_dir)).where("kind = 'refs'").select("kind", "objects", "mean_key_size", "median_key_size", "std_key_size", "mean_value_size")


@query(
    """SELECT size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:.2f} KiB', size / 1024) ELSE format('{:.2f} MiB', size / 1048576) END AS readable
    FROM (SELECT lang, sum(strlen(text))::BIGINT AS size FROM documents GROUP BY lang UNION ALL SELECT source, max(strlen(text))::BIGINT FROM documents GROUP BY source)"""
)
def readable_sizes(spark, sf_dir):
    d, size = table(spark, sf_dir, "documents"), F.octet_length("text").cast("long")
    sizes = d.groupBy("lang").agg(F.sum(size).alias("size")).select("size").unionAll(d.groupBy("source").agg(F.max(size).alias("size")).select("size"))
    return sizes.withColumn("readable", F.regexp_replace(readable_size(F.col("size")), ",", ""))


def _stored_orders(spark: SparkSession, sf_dir: str) -> tuple[VersionStore, str, str]:
    """A store with both versions of orders, in the shared folder, and their sums."""
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    store = VersionStore(spark, folder, tempfile.mkdtemp())
    fs, at = store._fs(folder)
    fs.deleteOnExit(at)
    new, old = orders_pair(spark, sf_dir)
    return store, store.save(new, ["o_orderkey"]), store.save(old, ["o_orderkey"])


@query(f"""SELECT block, count(*) AS rows, md5(string_agg(s, '' ORDER BY "row")) AS "sum" FROM (
    SELECT *, "row" // 255 AS block, {sqltext.row_sum(sqltext.ORDERS)} AS s FROM ({_PLACED.format("o_orderkey", ORDERS_NEW)})) GROUP BY block""")
def stored_block_index(spark, sf_dir):
    store, new, _ = _stored_orders(spark, sf_dir)
    return store.block_index(new)


@query(f"""SELECT o_orderkey, "row", "row" // 255 AS block, "row" % 255 AS "offset" FROM ({_PLACED.format("o_orderkey", ORDERS_NEW)}) WHERE "row" // 255 BETWEEN 3 AND 5""")
def stored_blocks(spark, sf_dir):
    store, new, _ = _stored_orders(spark, sf_dir)
    return store.blocks(new, 3, 6).select("o_orderkey", "row", "block", "offset")


@query(
    f"""SELECT n."row" AS new_row, o."row" AS old_row FROM (SELECT *, {sqltext.row_sum(sqltext.ORDERS)} AS s FROM ({_PLACED.format("o_orderkey", ORDERS_NEW)})) n
    FULL JOIN (SELECT *, {sqltext.row_sum(sqltext.ORDERS)} AS s FROM ({_PLACED.format("o_orderkey", ORDERS_OLD)})) o ON n.o_orderkey = o.o_orderkey WHERE n.s IS DISTINCT FROM o.s"""
)
def stored_diff_offsets(spark, sf_dir):
    return (s := _stored_orders(spark, sf_dir))[0].diff_offsets(*s[1:])


@query(f"SELECT {', '.join(f'{sqltext.text(c, k)} AS {c}' for c, k in sqltext.PART.items())} FROM part")
def canonical_cells(spark, sf_dir):
    return canonical(four_digits(table(spark, sf_dir, "part")))
