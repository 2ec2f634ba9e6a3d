"""Pieces of DuckDB SQL that the catalogue's oracles are put together from."""

from __future__ import annotations

from collections.abc import Sequence

ORDERS = {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"}
CUSTOMER = {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"}
SUPPLIER = {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"}
PART = {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"}
NATION = {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"}
EVENTS = {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "d", "props": "s"}

LINEITEM = {
    "l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d",
    "l_discount": "d", "l_tax": "d", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t",
}


def text(column: str, kind: str) -> str:
    return f"coalesce({f'{column}::DECIMAL(38,4)' if kind == 'd' else column}::VARCHAR, '')"


def row_sum(columns: dict[str, str]) -> str:
    return "md5(" + " || ".join(f"strlen({text(c, k)}) || ':' || {text(c, k)}" for c, k in columns.items()) + ")"


def diff(new: str, old: str, key: Sequence[str], columns: dict[str, str], all_modified: bool = False) -> str:
    """A query for status, key and the sums of both sides, unchanged rows included."""
    on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM o.{k}" for k in key)
    keys = ", ".join(f"coalesce(n.{k}, o.{k}) AS {k}" for k in key)
    differs = "true" if all_modified else "n.s <> o.s"
    return f"""SELECT CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN {differs} THEN 'modified' ELSE 'unchanged' END AS status,
      {keys}, n.s AS "sum", o.s AS old_sum
      FROM (SELECT *, {row_sum(columns)} AS s FROM {new}) n FULL JOIN (SELECT *, {row_sum(columns)} AS s FROM {old}) o ON {on}"""


def counts(source: str, columns: dict[str, str]) -> str:
    """Value counts of the columns of a table or subquery."""
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {text(c, k)} AS value, count(*) AS "count" FROM {source} GROUP BY ALL""" for c, k in columns.items())


ROUND2 = "(sign({0}) * floor(abs({0}) * 100 + 0.5) / 100)"
NUMBER = "regexp_full_match(value, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"


def stats(value_counts: str) -> str:
    return f"""SELECT "column", sum("count")::BIGINT AS rows, sum(CASE WHEN value = '' THEN "count" ELSE 0 END)::BIGINT AS na_count,
      sum(CASE WHEN value <> '' THEN "count" ELSE 0 END)::BIGINT AS filled,
      coalesce(bool_and(CASE WHEN value <> '' THEN {NUMBER} END), false) AS "numeric",
      min(CASE WHEN {NUMBER} THEN value::DOUBLE END) AS mn, max(CASE WHEN {NUMBER} THEN value::DOUBLE END) AS mx,
      sum(CASE WHEN {NUMBER} THEN value::DOUBLE * "count" END) AS total,
      coalesce(min(CASE WHEN value <> '' THEN strlen(value) END), 0)::INT AS min_str_len, coalesce(max(strlen(value)), 0)::INT AS max_str_len,
      sum(strlen(value) * "count") AS bytes
      FROM ({value_counts}) GROUP BY "column" """


def percentile_rows(value_counts: str) -> str:
    """column, p and v for p = 5, 10, .. 95 of the numeric columns."""
    return f"""SELECT q."column", q.p, CASE WHEN q.rn = 1 OR q.p >= trunc(100.0::DOUBLE / total * (pcum + 0.5)) THEN n
        ELSE {ROUND2.format("(n + (total * (q.p - trunc(100.0::DOUBLE / total * (pcum - 1 + 0.5))))::DOUBLE / 100 * (n - pn))")} END AS v, total
      FROM (
        SELECT k."column", k.n, k.pn, k.pcum, k.rn, k.total, p.p, row_number() OVER (PARTITION BY k."column", p.p ORDER BY k.rn) AS pick
        FROM (SELECT "column", n, lag(n) OVER w AS pn, cum, lag(cum) OVER w AS pcum, row_number() OVER w AS rn, max(cum) OVER (PARTITION BY "column") AS total
              FROM (SELECT "column", n, sum(c) OVER (PARTITION BY "column" ORDER BY n) AS cum
                    FROM (SELECT v."column", v.value::DOUBLE AS n, sum(v."count") AS c
                          FROM ({value_counts}) v JOIN ({stats(value_counts)}) s ON v."column" = s."column" AND s."numeric" AND s.filled > 0
                          WHERE v.value <> '' GROUP BY ALL))
              WINDOW w AS (PARTITION BY "column" ORDER BY n)) k,
             (SELECT unnest(range(5, 100, 5)) AS p) p
        WHERE trunc(100.0::DOUBLE / k.total * (k.cum - 1 + 0.5)) >= p.p) q
      WHERE q.pick = 1"""


def top(value_counts: str) -> str:
    return f"""SELECT "column", rank::INT AS rank, value, "count" FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS rank, max("count") OVER (PARTITION BY "column") AS most
        FROM ({value_counts}) WHERE value <> '') WHERE rank <= 20 AND most > 1"""
