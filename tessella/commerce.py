"""Definitions of the test tables, and a catalog of them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.schema import TableDef, belongs_to, belongs_to_many, column, has_many, morph_many, morph_one, table
from tessella.sources.catalog import Catalog


def _key(kind: str = "BIGINT"):
    return column(kind, primary=True, nullable=False)


REGION = table("region", {"r_regionkey": _key("INT"), "r_name": "TEXT"}, {"nations": has_many("nation", "n_regionkey")})
NATION = table("nation", {"n_nationkey": _key("INT"), "n_name": "TEXT", "n_regionkey": "INT"}, {"region": belongs_to("region", "n_regionkey"), "customers": has_many("customer", "c_nationkey"), "suppliers": has_many("supplier", "s_nationkey")})
CUSTOMER = table(
    "customer", {"c_custkey": _key(), "c_name": "TEXT", "c_nationkey": "INT", "c_acctbal": "DOUBLE", "c_mktsegment": "TEXT"},
    {"nation": belongs_to("nation", "c_nationkey"), "orders": has_many("orders", "o_custkey"), "events": has_many("events", "user_id"), "clicks": morph_many("events", "user_id", "event_type", "click"), "signup": morph_one("events", "user_id", "event_type", "signup")},
)
SUPPLIER = table("supplier", {"s_suppkey": _key(), "s_name": "TEXT", "s_nationkey": "INT", "s_acctbal": "DOUBLE"}, {"nation": belongs_to("nation", "s_nationkey"), "parts": belongs_to_many("part", "lineitem", "l_suppkey", "l_partkey", ("l_quantity",))})
PART = table("part", {"p_partkey": _key(), "p_name": "TEXT", "p_brand": "TEXT", "p_type": "TEXT", "p_size": "INT", "p_retailprice": "DOUBLE"})
ORDERS = table(
    "orders", {"o_orderkey": _key(), "o_custkey": "BIGINT", "o_orderstatus": "TEXT", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "TEXT"},
    {"customer": belongs_to("customer", "o_custkey"), "lines": has_many("lineitem", "l_orderkey"), "parts": belongs_to_many("part", "lineitem", "l_orderkey", "l_partkey", ("l_quantity",))},
)
LINEITEM = table("lineitem", {"l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INT", "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE", "l_returnflag": "TEXT", "l_linestatus": "TEXT", "l_shipdate": "TIMESTAMP"}, {"order": belongs_to("orders", "l_orderkey")}, primary_key=("l_orderkey", "l_linenumber"))
EVENTS = table("events", {"event_id": _key(), "ts": "TIMESTAMP", "user_id": "BIGINT", "event_type": "TEXT", "value": "DOUBLE", "props": "JSON"}, {"customer": belongs_to("customer", "user_id")})
EMBEDDINGS = table("embeddings", {"vec_id": _key(), "embedding": column("VECTOR", dimension=64), "label": "INT"})
DOCUMENTS = table("documents", {"doc_id": _key(), "text": "TEXT", "lang": "TEXT", "source": "TEXT", "n_chars": "BIGINT"})
TABLES: tuple[TableDef, ...] = (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, EMBEDDINGS, DOCUMENTS)


def catalog(spark: SparkSession, root: str) -> Catalog:
    return Catalog(spark, root).define(*TABLES)
