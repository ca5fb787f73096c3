"""What the query modules share: the registry of queries and the contract panel over the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from okrug.session import load


def registry() -> tuple[dict, dict, Callable]:
    """QUERIES, ORACLE and a decorator that fills them."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f: Callable[[SparkSession, str], DataFrame]):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return keep

    return queries, oracle, query


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as contracts: entity = nation of the customer or supplier."""
    line, order, customer, supplier = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    return (
        line.join(order, line.l_orderkey == order.o_orderkey)
        .join(customer, order.o_custkey == customer.c_custkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .select(
            F.col("o_orderkey").alias("contract_id"), F.col("l_linenumber").alias("line"), F.to_date("o_orderdate").alias("d"), F.col("c_nationkey").alias("customer_mo"), F.col("s_nationkey").alias("supplier_mo"),
            F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("qty"), (F.col("o_orderpriority") == "1-URGENT").alias("single_supplier"), F.col("c_mktsegment").alias("segment"), F.col("o_custkey").alias("custkey"), F.col("l_suppkey").alias("suppkey"),
        )
    )


#: The same in SQL, as a common table expression named k.
K = """k AS (SELECT o_orderkey AS contract_id, l_linenumber AS line, CAST(o_orderdate AS DATE) AS d, c_nationkey AS customer_mo, s_nationkey AS supplier_mo,
 l_extendedprice AS price, l_partkey AS partkey, l_quantity AS qty, o_orderpriority = '1-URGENT' AS single_supplier, c_mktsegment AS segment, o_custkey AS custkey, l_suppkey AS suppkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def r(column: str, digits: int = 4, name: str | None = None):
    """A rounded column under its name."""
    return F.round(F.col(column), digits).alias(name or column)
