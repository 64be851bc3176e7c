"""SQL text over layers, one query per category."""

from geoquarry.operators.layer_sql import run_sql

from .base import query, table

TEXTS = {
    "sql_group_by": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM {} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    ),
    "sql_cte": (
        "orders",
        "WITH totals AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {} GROUP BY o_custkey) SELECT o_custkey, total FROM totals WHERE total > 100000",
    ),
    "sql_window": (
        "orders",
        "SELECT o_orderkey, o_custkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM {}",
    ),
    "sql_set_operation": (
        "orders",
        "SELECT o_custkey FROM {} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {} WHERE o_orderstatus = 'O'",
    ),
    "sql_case": (
        "lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS amount FROM {}",
    ),
    "sql_string": (
        "part",
        "SELECT p_partkey, upper(p_name) AS name, substr(p_brand, 7, 2) AS brand, CAST(length(p_type) AS BIGINT) AS n FROM {} WHERE p_name LIKE 's%'",
    ),
    "sql_date": (
        "orders",
        "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(extract(MONTH FROM o_orderdate) AS INTEGER) AS m, CAST(o_orderdate AS DATE) AS d FROM {}",
    ),
    "sql_math": (
        "part",
        "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS root, abs(p_size - 25) AS off, CAST(floor(p_retailprice) AS BIGINT) AS whole FROM {}",
    ),
    "sql_distinct": ("part", "SELECT DISTINCT p_brand, p_type FROM {}"),
    "sql_order_limit": (
        "orders",
        "SELECT o_orderkey, o_totalprice FROM {} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    ),
}


def _register(name: str, source: str, text: str) -> None:
    slots = text.count("{}")

    @query(name, text.format(*[source] * slots))
    def run(spark, sf_dir):
        return run_sql(table(spark, sf_dir, source), text.format(*["df"] * slots))


for _name, (_source, _text) in TEXTS.items():
    _register(_name, _source, _text)

JOINS = {
    "sql_left_join": "SELECT c_custkey, o_orderkey FROM {c} LEFT JOIN {o} ON c_custkey = o_custkey AND o_totalprice > 200000",
    "sql_full_join": "SELECT c_custkey, o_custkey, count(*) AS n FROM {c} FULL JOIN {o} ON c_custkey = o_custkey GROUP BY c_custkey, o_custkey",
    "sql_exists": "SELECT c_custkey FROM {c} WHERE EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sql_not_exists": "SELECT c_custkey FROM {c} WHERE NOT EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey)",
}


def _register_join(name: str, text: str) -> None:
    @query(name, text.format(c="customer", o="orders"))
    def run(spark, sf_dir):
        layers = {"orders_2024": table(spark, sf_dir, "orders")}
        return run_sql(table(spark, sf_dir, "customer"), text.format(c="df", o="orders_2024"), layers)


for _name, _text in JOINS.items():
    _register_join(_name, _text)
