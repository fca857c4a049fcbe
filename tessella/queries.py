"""Queries that apply the library's operators and functions to the test tables, each beside its SQL for DuckDB."""

from __future__ import annotations

import dataclasses
import datetime
import uuid
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import expr as e
from tessella.commerce import catalog
from tessella.expr import and_, asc, col, desc, eq, gt, gte, lit, lt, mul, neq, or_, sub
from tessella.functions import arrays, control, dates, json_text, numbers, text, vectors
from tessella.operators import changes, dml, openapi, validate
from tessella.operators.cache import QueryCache
from tessella.operators.session import Session
from tessella.operators.shaping import as_json, materialize, to_response
from tessella.operators.tree import Tree
from tessella.plans.filters import apply_filter
from tessella.plans.log import QueryRunner
from tessella.plans.paging import cursor_query, encode_cursor, execute_cursor, execute_filtered_paged, page_query
from tessella.plans.query import Include, Select, from_function, from_named, from_range, from_subquery, outer_ref, scalar, select_from
from tessella.plans.relations import lazy_relation, morph_owner, select_columns_deep
from tessella.schema import column, entity_table, morph_to, table
from tessella.sources import catalog as sources
from tessella.sources.shared import shared_path
from tessella.streaming import windows

#: name -> (what makes the query's result of a catalog, SQL or None)
_ALL: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        _ALL[name or f.__name__.rstrip("_")] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(catalog(spark, sf_dir))
            return out.to_df() if isinstance(out, Select) else out

        return run

    return {n: runner(make) for n, (make, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _ALL.items() if sql}


# scans and projections ----------------------------------------------------------------------------------------------


@_query("SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name")
def flagship_revenue(c):
    q = select_from(c, "region").join_relation("nations").join("customer", eq(col("customer.c_nationkey"), col("nations.n_nationkey")))
    q = q.join("orders", eq(col("orders.o_custkey"), col("customer.c_custkey"))).join("lineitem", eq(col("lineitem.l_orderkey"), col("orders.o_orderkey")))
    revenue = numbers.round_(e.sum_(mul(col("lineitem.l_extendedprice"), sub(1.0, col("lineitem.l_discount")))), 2)
    return q.select(r_name=col("region.r_name"), revenue=revenue, n=e.count_all()).group_by("region.r_name").order_by(desc(e.alias_ref("revenue")))


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000")
def scan_project(c):
    return select_from(c, "customer").select("c_custkey", "c_name", "c_acctbal").where(gt(col("customer.c_acctbal"), 9000))


@_query("SELECT * FROM nation")
def scan_default(c):
    return select_from(c, "nation")


@_query("SELECT n.n_name AS name FROM nation n WHERE n.n_regionkey = 1")
def scan_alias(c):
    return select_from(c, "nation").as_("n").select(name=col("n.n_name")).where(eq(col("n.n_regionkey"), 1))


@_query("SELECT k, b FROM (SELECT c_nationkey, max(c_acctbal) FROM customer GROUP BY c_nationkey) AS d(k, b) WHERE b > 9900")
def derived_table(c):
    inner = select_from(c, "customer").select(k=col("customer.c_nationkey"), b=e.max_(col("customer.c_acctbal"))).group_by("customer.c_nationkey")
    return from_subquery(c, inner, "d", ["k", "b"]).select("k", "b").where(gt(col("d.b"), 9900))


@_query("SELECT i AS n, i * i AS square FROM range(1, 21) AS t(i)")
def table_function_range(c):
    return from_range(c, 1, 20).select(n=col("series.value"), square=mul(col("series.value"), col("series.value")))


@_query("SELECT unnest([3, 1, 2]) AS value")
def table_function(c):
    return from_function(c, "explode", F.array(F.lit(3), F.lit(1), F.lit(2)), columns=["value"])


@_query("SELECT vec_id, round(u::DOUBLE, 6) AS x, i::INT AS i FROM (SELECT vec_id, unnest(list_reverse(embedding)) AS u, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def unnest_ordinality(c):
    q = select_from(c, "embeddings").lateral(lambda s: F.reverse(col("embeddings.embedding").build(s)), "u", ("x", "i"), True)
    return q.select(vec_id=col("embeddings.vec_id"), x=numbers.round_(e.cast(col("x"), "double"), 6), i=col("i"))


@_query("SELECT vec_id, round(u::DOUBLE, 6) AS x, i::INT AS i FROM (SELECT vec_id, unnest(embedding) AS u, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def unnest_ordinality_whole(c):
    q = select_from(c, "embeddings").lateral(lambda s: col("embeddings.embedding").build(s), "u", ("x", "i"), True)
    return q.select(vec_id=col("embeddings.vec_id"), x=numbers.round_(e.cast(col("x"), "double"), 6), i=col("i"))


@_query("SELECT upper(c_mktsegment) AS seg, count(*) AS n FROM customer GROUP BY upper(c_mktsegment)")
def select_raw(c):
    return select_from(c, "customer").select_raw(seg="upper(c_mktsegment)", n="count(1)").group_by(e.raw("upper(c_mktsegment)"))


@_query("SELECT n_nationkey, (SELECT max(c_acctbal) FROM customer) AS top FROM nation")
def select_subquery(c):
    return select_from(c, "nation").select("n_nationkey").select_subquery("top", select_from(c, "customer").select(m=e.max_(col("customer.c_acctbal"))))


@_query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(c):
    return select_from(c, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# filters ------------------------------------------------------------------------------------------------------------

_NULLED = "nullif(n_regionkey, 1)"
_nulled = lambda: control.nullif(col("nation.n_regionkey"), lit(1))


def _filter(name: str, make: Callable, sql: str, on: str = "nation", key: str = "n_nationkey") -> None:
    _ALL[name] = (lambda c: select_from(c, on).select(key).where(make()), f"SELECT {key} FROM {on} WHERE {sql}")


for _n, _m, _s in [
    ("filter_eq", lambda: eq(col("nation.n_regionkey"), 2), "n_regionkey = 2"),
    ("filter_neq", lambda: neq(_nulled(), 2), f"{_NULLED} <> 2"),
    ("filter_gt", lambda: gt(col("nation.n_nationkey"), 11), "n_nationkey > 11"),
    ("filter_gte", lambda: gte(col("nation.n_nationkey"), 11), "n_nationkey >= 11"),
    ("filter_lt", lambda: lt(col("nation.n_nationkey"), 11), "n_nationkey < 11"),
    ("filter_lte", lambda: e.lte(col("nation.n_nationkey"), 11), "n_nationkey <= 11"),
    ("filter_and", lambda: and_(gt(col("nation.n_nationkey"), 3), lt(col("nation.n_nationkey"), 9)), "n_nationkey > 3 AND n_nationkey < 9"),
    ("filter_or", lambda: or_(lt(col("nation.n_nationkey"), 3), gt(col("nation.n_nationkey"), 20)), "n_nationkey < 3 OR n_nationkey > 20"),
    ("filter_not", lambda: e.not_(eq(_nulled(), 2)), f"NOT ({_NULLED} = 2)"),
    ("filter_empty_logic", lambda: and_(and_(), e.not_(or_())), "TRUE"),
    ("filter_is_null", lambda: e.is_null(_nulled()), f"{_NULLED} IS NULL"),
    ("filter_is_not_null", lambda: e.is_not_null(_nulled()), f"{_NULLED} IS NOT NULL"),
    ("filter_in_list", lambda: e.in_list(col("nation.n_nationkey"), [1, 5, 7]), "n_nationkey IN (1, 5, 7)"),
    ("filter_in_list_empty", lambda: e.in_list(col("nation.n_nationkey"), []), "FALSE"),
    ("filter_not_in_list", lambda: e.not_in_list(_nulled(), [0, 2]), f"{_NULLED} NOT IN (0, 2)"),
    ("filter_between", lambda: e.between(col("nation.n_nationkey"), 5, 9), "n_nationkey BETWEEN 5 AND 9"),
    ("filter_not_between", lambda: e.not_between(col("nation.n_nationkey"), 5, 9), "n_nationkey NOT BETWEEN 5 AND 9"),
    ("filter_is_distinct", lambda: e.is_distinct_from(_nulled(), 2), f"{_NULLED} IS DISTINCT FROM 2"),
    ("filter_is_not_distinct", lambda: e.is_not_distinct_from(_nulled(), lit(None)), f"{_NULLED} IS NOT DISTINCT FROM NULL"),
    ("filter_collate", lambda: eq(e.collate(text.upper(col("nation.n_name")), "nocase"), text.lower(col("nation.n_name"))), "lower(n_name) = lower(n_name)"),
]:
    _filter(_n, _m, _s)
_filter("filter_like", lambda: e.like(col("part.p_name"), "%1_"), "p_name LIKE '%1_'", "part", "p_partkey")
_filter("filter_not_like", lambda: e.not_like(col("part.p_name"), "%1%"), "p_name NOT LIKE '%1%'", "part", "p_partkey")
_filter("filter_like_escape", lambda: e.like(text.concat(col("part.p_brand"), lit("_x%")), "%\\_x\\%"), "concat(p_brand, '_x%') LIKE '%\\_x\\%' ESCAPE '\\'", "part", "p_partkey")
_filter("filter_case_insensitive", lambda: e.like(text.lower(col("part.p_type")), "%a%"), "lower(p_type) LIKE '%a%'", "part", "p_partkey")

# expressions --------------------------------------------------------------------------------------------------------


def _value(name: str, on: str, key: str, make: Callable, sql: str | None) -> None:
    _ALL[name] = (lambda c: select_from(c, on).select(key, v=make()), f"SELECT {key}, {sql} AS v FROM {on}" if sql else None)


_k, _b = lambda: col("nation.n_nationkey"), lambda: col("customer.c_acctbal")
for _n, _m, _s in [
    ("arith_add", lambda: e.add(_k(), 2), "n_nationkey + 2"),
    ("arith_sub", lambda: sub(_k(), 2), "n_nationkey - 2"),
    ("arith_mul", lambda: mul(_k(), 3), "n_nationkey * 3"),
    ("arith_div", lambda: e.div(_k(), col("nation.n_regionkey")), "n_nationkey / nullif(n_regionkey, 0)"),
    ("bitwise_and", lambda: e.bit_and(_k(), 6), "n_nationkey & 6"),
    ("bitwise_or", lambda: e.bit_or(_k(), 6), "n_nationkey | 6"),
    ("bitwise_xor", lambda: e.bit_xor(_k(), 6), "xor(n_nationkey, 6)"),
    ("bitwise_shift_left", lambda: e.shift_left(_k(), 2), "n_nationkey << 2"),
    ("bitwise_shift_right", lambda: e.shift_right(_k(), 1), "n_nationkey >> 1"),
    ("case_when", lambda: e.case_when([(lt(_k(), 5), "low"), (lt(_k(), 15), "mid")], "high"), "CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey < 15 THEN 'mid' ELSE 'high' END"),
    ("case_when_no_else", lambda: e.case_when([(lt(_k(), 5), "low")]), "CASE WHEN n_nationkey < 5 THEN 'low' END"),
    ("cast_text", lambda: e.cast(_k(), "varchar(10)"), "CAST(n_nationkey AS VARCHAR)"),
    ("custom_expression", lambda: e.custom("twice_plus", lambda a, b: a * 2 + b, _k(), col("nation.n_regionkey")), "n_nationkey * 2 + n_regionkey"),
]:
    _value(_n, "nation", "n_nationkey", _m, _s)
_value("cast_int", "customer", "c_custkey", lambda: e.cast(_b(), "int"), "CAST(trunc(c_acctbal) AS INT)")
_value("cast_safe", "customer", "c_custkey", lambda: e.cast(col("customer.c_name"), "int", safe=True), "TRY_CAST(c_name AS INT)")
_value("json_path", "events", "event_id", lambda: e.json_path(col("events.props"), "$.k"), "props ->> '$.k'")

# joins --------------------------------------------------------------------------------------------------------------

_on = lambda: eq(col("customer.c_nationkey"), col("nation.n_nationkey"))


@_query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(c):
    return select_from(c, "customer").inner_join("nation", _on()).select("customer.c_custkey", "nation.n_name")


@_query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join_left(c):
    return select_from(c, "orders").left_join("lineitem", eq(col("lineitem.l_orderkey"), col("orders.o_orderkey"))).select(o_orderkey=col("orders.o_orderkey"), n=e.count(col("lineitem.l_orderkey"))).group_by("orders.o_orderkey")


@_query("SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9500")
def join_right(c):
    return select_from(c, "customer").right_join("nation", and_(_on(), gt(_b(), 9500))).select("nation.n_name", "customer.c_custkey")


@_query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(c):
    return select_from(c, "region").cross_join("nation").select("region.r_name", "nation.n_name")


@_query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey <= a.n_nationkey + 2")
def join_theta_range(c):
    k = lambda t: col(f"{t}.n_nationkey")
    return select_from(c, "nation").as_("a").join("nation", and_(lt(k("a"), k("b")), e.lte(k("b"), e.add(k("a"), 2))), alias="b").select(a=k("a"), b=k("b"))


@_query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(c):
    k = lambda t: col(f"{t}.n_nationkey")
    q = select_from(c, "nation").as_("a").join("nation", and_(eq(col("a.n_regionkey"), col("nation.n_regionkey")), lt(k("a"), k("nation"))))
    return q.select(one=col("a.n_name"), other=col("nation.n_name"))


@_query("SELECT n_name, t.n AS customers FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) t ON t.k = n_nationkey")
def join_subquery(c):
    inner = select_from(c, "customer").select(k=col("customer.c_nationkey"), n=e.count_all()).group_by("customer.c_nationkey")
    return select_from(c, "nation").join(inner, eq(col("t.k"), col("nation.n_nationkey")), alias="t").select(n_name=col("nation.n_name"), customers=col("t.n"))


@_query("SELECT o_orderkey, p_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7")
def join_many_to_many(c):
    return select_from(c, "orders").join_relation("parts", extra=eq(col("parts.p_size"), 7)).select("orders.o_orderkey", "parts.p_partkey")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(c):
    q = select_from(c, "orders").where(gt(col("orders.o_totalprice"), 300000))
    return select_from(c, "customer").select("c_custkey").where_exists(q, eq(col("orders.o_custkey"), col("customer.c_custkey")))


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(c):
    return select_from(c, "orders").select("o_orderkey").where_not_exists(select_from(c, "lineitem"), eq(col("lineitem.l_orderkey"), col("orders.o_orderkey")))


@_query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def in_subquery(c):
    return select_from(c, "nation").select("n_nationkey").where_in("n_regionkey", select_from(c, "region").select("r_regionkey").where(e.like(col("region.r_name"), "A%")))


@_query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def not_in_subquery(c):
    return select_from(c, "nation").select("n_nationkey").where_in("n_regionkey", select_from(c, "region").select("r_regionkey").where(e.like(col("region.r_name"), "A%")), negated=True)


@_query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region)")
def not_in_subquery_null(c):
    return select_from(c, "nation").select("n_nationkey").where_in("n_regionkey", select_from(c, "region").select(x=control.nullif(col("region.r_regionkey"), lit(1))), negated=True)


@_query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_subquery(c):
    return select_from(c, "customer").select("c_custkey").where(gt(_b(), scalar(select_from(c, "customer").select(m=e.avg(_b())))))


@_query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def match_distinct(c):
    return select_from(c, "customer").select("c_custkey").match("orders", eq(col("orders.o_orderstatus"), "P"))


@_query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size = 3)")
def where_has_many_to_many(c):
    return select_from(c, "supplier").select("s_suppkey").where_has("parts", eq(col("part.p_size"), 3))


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5)")
def where_has_not(c):
    return select_from(c, "orders").select("o_orderkey").where_has_not("lines", gt(col("lineitem.l_quantity"), 5))


# aggregation --------------------------------------------------------------------------------------------------------


@_query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS lo, max(l_tax) AS hi, count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_basic(c):
    l = lambda n: col(f"lineitem.{n}")  # noqa: E731, E741
    q = select_from(c, "lineitem").select("l_returnflag", "l_linestatus", sum_qty=numbers.round_(e.sum_(l("l_quantity")), 2), avg_price=numbers.round_(e.avg(l("l_extendedprice")), 4), lo=e.min_(l("l_discount")), hi=e.max_(l("l_tax")), n=e.count(l("l_orderkey")))
    return q.group_by("lineitem.l_returnflag", "lineitem.l_linestatus")


@_query("SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 5) AS var FROM lineitem GROUP BY l_returnflag")
def agg_stats(c):
    qty = col("lineitem.l_quantity")
    return select_from(c, "lineitem").select("l_returnflag", sd=numbers.round_(e.stddev(qty), 6), var=numbers.round_(e.variance(qty), 5)).group_by("lineitem.l_returnflag")


@_query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(c):
    return select_from(c, "nation").select("n_regionkey", names=e.group_concat(col("nation.n_name"), "; ", col("nation.n_name"))).group_by("nation.n_regionkey")


@_query("SELECT n_regionkey, to_json(list(n_nationkey ORDER BY n_nationkey))::VARCHAR AS ids FROM nation GROUP BY n_regionkey")
def agg_json_array(c):
    return select_from(c, "nation").select("n_regionkey", ids=json_text.json_array_agg(_k())).group_by("nation.n_regionkey")


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 18 AND max(o_totalprice) > 1000")
def agg_having(c):
    return select_from(c, "orders").select("o_custkey", n=e.count_all()).group_by("orders.o_custkey").having(gt(e.count_all(), 18)).having(gt(e.max_(col("orders.o_totalprice")), 1000))


@_query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)")
def agg_having_subquery(c):
    total = scalar(select_from(c, "orders").select(m=e.avg(col("orders.o_totalprice"))))
    return select_from(c, "orders").select("o_orderstatus", n=e.count_all()).group_by("orders.o_orderstatus").having(gt(e.avg(col("orders.o_totalprice")), total))


@_query("SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1")
def agg_group_by_alias(c):
    return select_from(c, "orders").select(y=dates.year(col("orders.o_orderdate")), n=e.count_all()).group_by(e.alias_ref("y"))


@_query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders")
def agg_global(c):
    return select_from(c, "orders").select(n=e.count_all(), customers=e.count_distinct(col("orders.o_custkey")), total=numbers.round_(e.sum_(col("orders.o_totalprice")), 2))


@_query("SELECT count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000")
def count_distinct_root(c):
    return select_from(c, "customer").include("orders", where=gt(col("orders.o_totalprice"), 100000), kind="inner").count_frame()


@_query("SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def count_rows(c):
    return select_from(c, "customer").join_relation("orders", "left").select(n=e.count_all())


# windows ------------------------------------------------------------------------------------------------------------


def _window(name: str, make: Callable, sql: str) -> None:
    _ALL[name] = (lambda c: select_from(c, "nation").select("n_nationkey", v=make()), f"SELECT n_nationkey, {sql} AS v FROM nation")


_p, _o = [col("nation.n_regionkey")], [asc(col("nation.n_nationkey"))]
_w = "OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)"
_t, _tw = [asc(col("nation.n_regionkey"))], "OVER (ORDER BY n_regionkey)"
for _n, _m, _s in [
    ("win_row_number", lambda: e.row_number(_p, _o), f"(row_number() {_w})::INT"),
    ("win_rank", lambda: e.rank((), _t), f"(rank() {_tw})::INT"),
    ("win_dense_rank", lambda: e.dense_rank((), _t), f"(dense_rank() {_tw})::INT"),
    ("win_percent_rank", lambda: numbers.round_(e.percent_rank((), _t), 6), f"round(percent_rank() {_tw}, 6)"),
    ("win_cume_dist", lambda: numbers.round_(e.cume_dist((), _t), 6), f"round(cume_dist() {_tw}, 6)"),
    ("win_ntile", lambda: e.ntile(3, _p, _o), f"(ntile(3) {_w})::INT"),
    ("win_lag", lambda: e.lag(_k(), 1, -1, _p, _o), f"lag(n_nationkey, 1, -1) {_w}"),
    ("win_lead", lambda: e.lead(_k(), 2, None, _p, _o), f"lead(n_nationkey, 2) {_w}"),
    ("win_first", lambda: e.first_value(col("nation.n_name"), _p, _o), f"first_value(n_name) {_w}"),
    ("win_last", lambda: e.last_value(col("nation.n_name"), _p, _o), f"last_value(n_name) {_w}"),
    ("win_nth", lambda: e.nth_value(col("nation.n_name"), 2, _p, _o), f"nth_value(n_name, 2) {_w}"),
    ("win_sum_running", lambda: e.over(e.sum_(_k()), _p, _o), f"(sum(n_nationkey) {_w})::BIGINT"),
    ("win_avg", lambda: numbers.round_(e.over(e.avg(_k()), _p), 6), "round(avg(n_nationkey) OVER (PARTITION BY n_regionkey), 6)"),
    ("win_count", lambda: e.over(e.count_all(), _p), "count(*) OVER (PARTITION BY n_regionkey)"),
    ("win_min_max", lambda: sub(e.over(e.max_(_k()), _p), e.over(e.min_(_k()), _p)), "max(n_nationkey) OVER (PARTITION BY n_regionkey) - min(n_nationkey) OVER (PARTITION BY n_regionkey)"),
]:
    _window(_n, _m, _s)

# order and pages ----------------------------------------------------------------------------------------------------


@_query("SELECT n_nationkey, nullif(n_regionkey, 1) AS r FROM nation ORDER BY r DESC NULLS LAST, n_nationkey LIMIT 22")
def sort_nulls_last(c):
    return select_from(c, "nation").select("n_nationkey", r=_nulled()).order_by(desc(e.alias_ref("r"), nulls="last"), asc(_k())).limit(22)


@_query("SELECT n_nationkey, nullif(n_regionkey, 1) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 7")
def sort_nulls_first(c):
    return select_from(c, "nation").select("n_nationkey", r=_nulled()).order_by(desc(e.alias_ref("r"), nulls="first"), asc(_k())).limit(7)


@_query("SELECT p_partkey, p_size FROM part ORDER BY p_size % 7 DESC, p_partkey LIMIT 25")
def sort_expression(c):
    return select_from(c, "part").select("p_partkey", "p_size").order_by(desc(numbers.mod(col("part.p_size"), lit(7))), asc(col("part.p_partkey"))).limit(25)


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(c):
    return select_from(c, "orders").select("o_orderkey", "o_totalprice").order_by(desc(col("orders.o_totalprice")), asc(col("orders.o_orderkey"))).limit(20)


@_query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def page(c):
    return page_query(select_from(c, "orders").select("o_orderkey").order_by(desc(col("orders.o_totalprice")), asc(col("orders.o_orderkey"))), 4, 10)


def _by_segment(c):
    return select_from(c, "customer").select("c_custkey", "c_mktsegment").order_by(desc(col("customer.c_mktsegment")), asc(col("customer.c_custkey")))


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'FURNITURE' OR (c_mktsegment = 'FURNITURE' AND c_custkey > 700) ORDER BY c_mktsegment DESC, c_custkey LIMIT 11")
def cursor_after(c):
    q = _by_segment(c)
    return cursor_query(q, first=10, after=encode_cursor(["FURNITURE", 700], q.orders))


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'FURNITURE' OR (c_mktsegment = 'FURNITURE' AND c_custkey < 700) ORDER BY c_mktsegment, c_custkey DESC LIMIT 11")
def cursor_before(c):
    q = _by_segment(c)
    return cursor_query(q, last=10, before=encode_cursor(["FURNITURE", 700], q.orders))


# set operations and named queries -----------------------------------------------------------------------------------

_segments = lambda c, n: select_from(c, "customer").select("c_mktsegment").where(lt(col("customer.c_nationkey"), n))
_keys = lambda c, lo, hi: select_from(c, "nation").select(k=col("nation.n_regionkey")).where(e.between(_k(), lo, hi))
_ks = "SELECT n_regionkey AS k FROM nation WHERE n_nationkey BETWEEN {} AND {}"


@_query(f"({_ks.format(0, 9)}) UNION ({_ks.format(5, 14)})")
def union(c):
    return _keys(c, 0, 9).union(_keys(c, 5, 14))


@_query(f"({_ks.format(0, 9)}) UNION ALL ({_ks.format(5, 14)})")
def union_all(c):
    return _keys(c, 0, 9).union_all(_keys(c, 5, 14))


@_query(f"({_ks.format(0, 6)}) INTERSECT ({_ks.format(5, 9)})")
def intersect(c):
    return _keys(c, 0, 6).intersect(_keys(c, 5, 9))


@_query(f"({_ks.format(0, 24)}) EXCEPT ({_ks.format(0, 2)})", "except")
def except_(c):
    return _keys(c, 0, 24).except_(_keys(c, 0, 2))


@_query(f"(({_ks.format(0, 9)}) UNION ALL ({_ks.format(5, 14)})) ORDER BY k DESC LIMIT 6")
def union_ordered(c):
    return _keys(c, 0, 9).union_all(_keys(c, 5, 14)).order_by(desc(e.alias_ref("k"))).limit(6)


@_query("WITH rich AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000) SELECT n_name, count(*) AS n FROM nation JOIN rich ON rich.c_nationkey = n_nationkey GROUP BY n_name")
def cte(c):
    rich = select_from(c, "customer").select("c_custkey", "c_nationkey").where(gt(_b(), 9000))
    return select_from(c, "nation").with_("rich", rich).join("rich", eq(col("rich.c_nationkey"), _k())).select(n_name=col("nation.n_name"), n=e.count_all()).group_by("nation.n_name")


@_query("WITH RECURSIVE s(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 12) SELECT n, f FROM s")
def cte_recursive(c):
    anchor = c.spark.sql("SELECT 1L AS n, 1L AS f")
    return from_named(c, "s").with_recursive("s", anchor, lambda d: d.where("n < 12").selectExpr("n + 1 AS n", "f * (n + 1) AS f")).select("n", "f")


# relations ----------------------------------------------------------------------------------------------------------

_json = lambda df, key, name: df.select(key, F.to_json(F.col(name)).alias("nested"))


@_query("SELECT n_nationkey, to_json(coalesce(list({'s_suppkey': s_suppkey, 's_name': s_name} ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), []))::VARCHAR AS nested FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def include_has_many(c):
    return _json(select_from(c, "nation").include("suppliers", ["s_suppkey", "s_name"]).to_df(), "n_nationkey", "suppliers")


@_query("SELECT n_nationkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::VARCHAR AS nested FROM nation JOIN region ON r_regionkey = n_regionkey")
def include_belongs_to(c):
    return _json(select_from(c, "nation").include("region").to_df(), "n_nationkey", "region")


@_query("SELECT o_orderkey, to_json(coalesce(list(DISTINCT {'p_partkey': p_partkey, 'p_size': p_size} ORDER BY {'p_partkey': p_partkey, 'p_size': p_size}) FILTER (p_partkey IS NOT NULL), []))::VARCHAR AS nested FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY o_orderkey")
def include_many_to_many(c):
    return _json(select_from(c, "orders").include("parts", ["p_partkey", "p_size"], where=gt(col("parts.p_size"), 10)).to_df(), "o_orderkey", "parts")


@_query("SELECT o_orderkey, to_json(coalesce(list(DISTINCT {'p_partkey': p_partkey, 'p_brand': p_brand} ORDER BY {'p_partkey': p_partkey, 'p_brand': p_brand}) FILTER (p_partkey IS NOT NULL), []))::VARCHAR AS nested FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def include_many_to_many_whole(c):
    return _json(select_from(c, "orders").include("parts", ["p_partkey", "p_brand"]).to_df(), "o_orderkey", "parts")


@_query("SELECT n_nationkey, to_json(coalesce(list({'c_custkey': c_custkey} ORDER BY c_custkey) FILTER (c_custkey IS NOT NULL), []))::VARCHAR AS nested FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500 GROUP BY n_nationkey")
def include_filtered(c):
    return _json(select_from(c, "nation").include("customers", ["c_custkey"], where=gt(_b(), 9500)).to_df(), "n_nationkey", "customers")


@_query("WITH s AS (SELECT n_nationkey, n_regionkey, coalesce(list({'s_suppkey': s_suppkey} ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), []) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) SELECT r_regionkey, to_json(list({'n_nationkey': n_nationkey, 'suppliers': suppliers} ORDER BY n_nationkey))::VARCHAR AS nested FROM region JOIN s ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def include_nested(c):
    return _json(select_from(c, "region").include("nations", ["n_nationkey"], include=[Include("suppliers", ("s_suppkey",))]).to_df(), "r_regionkey", "nations")


@_query("WITH p AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 5) SELECT c_custkey, to_json(coalesce(list({'o_orderkey': o_orderkey} ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), []))::VARCHAR AS nested FROM p LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def page_with_include(c):
    q = select_from(c, "customer").select("c_custkey").include("orders", ["o_orderkey"]).order_by(desc(_b()), asc(col("customer.c_custkey"))).offset(5).limit(15)
    return _json(q.to_df(), "c_custkey", "orders")


@_query("WITH p AS (SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) ORDER BY c_custkey LIMIT 10) SELECT c_custkey, to_json(list({'o_orderkey': o_orderkey} ORDER BY o_orderkey))::VARCHAR AS nested FROM p JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
def page_with_inner_include(c):
    q = select_from(c, "customer").select("c_custkey").include("orders", ["o_orderkey"], where=gt(col("orders.o_totalprice"), 400000), kind="inner").order_by("customer.c_custkey").limit(10)
    return _json(q.to_df(), "c_custkey", "orders")


@_query("SELECT n_regionkey AS root_key, n_nationkey, n_name, n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE '%A%'")
def include_lazy(c):
    return lazy_relation(select_from(c, "region").where(e.like(col("region.r_name"), "%A%")), "nations")


@_query("SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'click' AND value > 10 GROUP BY c_custkey")
def morph_many_include(c):
    return select_from(c, "customer").include("clicks", ["event_id"], where=gt(col("clicks.value"), 10)).to_df().select("c_custkey", F.size("clicks").cast("bigint").alias("n"))


@_query("SELECT c_custkey, min(event_id) AS signup_id FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'signup' AND value > 10 GROUP BY c_custkey")
def morph_one_include(c):
    return select_from(c, "customer").include("signup", ["event_id"], where=gt(col("signup.value"), 10)).to_df().select("c_custkey", F.col("signup.event_id").alias("signup_id"))


@_query("SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'click' GROUP BY c_custkey")
def morph_many_include_whole(c):
    return select_from(c, "customer").include("clicks", ["event_id"]).to_df().select("c_custkey", F.size("clicks").cast("bigint").alias("n"))


@_query("SELECT c_custkey, min(event_id) AS signup_id FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'signup' GROUP BY c_custkey")
def morph_one_include_whole(c):
    return select_from(c, "customer").include("signup", ["event_id"]).to_df().select("c_custkey", F.col("signup.event_id").alias("signup_id"))


@_query("SELECT event_id, coalesce(c_name, s_name) AS owner FROM events LEFT JOIN customer ON event_type = 'view' AND c_custkey = user_id LEFT JOIN supplier ON event_type = 'purchase' AND s_suppkey = user_id")
def morph_to_owner(c):
    events = c.definition("events").with_relations(owner=morph_to("user_id", "event_type", {"view": "customer", "purchase": "supplier"}))
    c.define(events)
    return morph_owner(select_from(c, events), "owner", ["c_name", "s_name"]).select("event_id", F.coalesce("owner.c_name", "owner.s_name").alias("owner"))


def _dict_filter(name: str, on: str, key: str, where: dict, sql: str) -> None:
    _ALL[name] = (lambda c: apply_filter(select_from(c, on), where).select(key), f"SELECT {key} FROM {on} WHERE {sql}")


_ex = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey{})"
for _n, _where, _s in [
    ("dict_some", {"lines": {"some": {"l_quantity": {"gt": 45}}}}, _ex.format(" AND l_quantity > 45")),
    ("dict_none", {"lines": {"none": {"l_quantity": {"gt": 10}}}}, "NOT " + _ex.format(" AND l_quantity > 10")),
    ("dict_every", {"lines": {"every": {"l_quantity": {"gte": 10}}}}, _ex.format("") + " AND NOT " + _ex.format(" AND NOT coalesce(l_quantity >= 10, false)")),
    ("dict_is_empty", {"lines": {"is_empty": True}}, "NOT " + _ex.format("")),
    ("dict_is_not_empty", {"lines": {"is_not_empty": True}}, _ex.format("")),
    ("dict_is_empty_false", {"lines": {"is_empty": False}}, _ex.format("")),
    ("dict_fields", {"o_orderstatus": {"in": ["P", "F"]}, "o_totalprice": {"gte": 1000, "lt": 50000}, "o_orderpriority": {"not": "5-LOW"}}, "o_orderstatus IN ('P', 'F') AND o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderpriority <> '5-LOW'"),
    ("dict_belongs_to", {"customer": {"some": {"c_mktsegment": "BUILDING", "nation": {"some": {"n_name": {"contains": "A"}}}}}}, "EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND contains(n_name, 'A'))"),
]:
    _dict_filter(_n, "orders", "o_orderkey", _where, _s)
_dict_filter("dict_insensitive", "part", "p_partkey", {"p_type": {"contains": "A", "mode": "insensitive"}, "p_brand": {"starts_with": "Brand"}}, "contains(lower(p_type), 'a') AND starts_with(p_brand, 'Brand')")
_dict_filter("dict_ends_with", "part", "p_partkey", {"p_name": {"ends_with": "7"}}, "ends_with(p_name, '7')")
_dict_filter("dict_nested_some", "nation", "n_nationkey", {"customers": {"some": {"orders": {"some": {"o_totalprice": {"gt": 450000}}}}}}, "EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 450000)")

# functions ----------------------------------------------------------------------------------------------------------

_name, _seg, _pt, _cust, _price, _od, _ts, _props = (lambda x=x: col(x) for x in ("customer.c_name", "customer.c_mktsegment", "part.p_type", "customer.c_custkey", "part.p_retailprice", "orders.o_orderdate", "events.ts", "events.props"))
for _n, _m, _s in [
    ("lower", lambda: text.lower(_name()), "lower(c_name)"), ("upper", lambda: text.upper(_name()), "upper(c_name)"), ("ascii", lambda: text.ascii_(_name()), "ascii(c_name)"),
    ("char", lambda: text.char(lit(72), lit(105)), "chr(72) || chr(105)"), ("char_length", lambda: text.char_length(_name()), "length(c_name)::INT"), ("length", lambda: text.length(_name()), "length(c_name)::INT"),
    ("trim", lambda: text.trim(text.concat(lit("  "), _name(), lit(" "))), "trim(concat('  ', c_name, ' '))"), ("trim_chars", lambda: text.trim(_name(), lit("C0")), "trim(c_name, 'C0')"),
    ("ltrim", lambda: text.ltrim(text.concat(lit("  "), _name())), "ltrim(concat('  ', c_name))"), ("rtrim", lambda: text.rtrim(text.concat(_name(), lit("  "))), "rtrim(concat(c_name, '  '))"),
    ("concat", lambda: text.concat(_name(), control.nullif(_seg(), lit("BUILDING")), lit("!")), "concat(c_name, nullif(c_mktsegment, 'BUILDING'), '!')"),
    ("concat_ws", lambda: text.concat_ws("-", _name(), control.nullif(_seg(), lit("BUILDING")), lit("x")), "concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'x')"),
    ("substr", lambda: text.substr(_name(), 3, 4), "substr(c_name, 3, 4)"), ("substr_open", lambda: text.substr(_name(), -5), "substr(c_name, -5)"),
    ("left", lambda: text.left(_name(), lit(4)), "left(c_name, 4)"), ("right", lambda: text.right(_name(), lit(4)), "right(c_name, 4)"),
    ("position", lambda: text.position(lit("0"), _name()), "position('0' IN c_name)::INT"), ("instr", lambda: text.instr(_name(), lit("0")), "instr(c_name, '0')::INT"),
    ("locate", lambda: text.locate("0", _name(), 12), "(CASE WHEN instr(substr(c_name, 12), '0') = 0 THEN 0 ELSE instr(substr(c_name, 12), '0') + 11 END)::INT"),
    ("replace", lambda: text.replace(_name(), lit("0"), lit("zero")), "replace(c_name, '0', 'zero')"), ("repeat", lambda: text.repeat(_seg(), lit(2)), "repeat(c_mktsegment, 2)"),
    ("lpad", lambda: text.lpad(_seg(), 12, "*"), "lpad(c_mktsegment, 12, '*')"), ("rpad", lambda: text.rpad(_seg(), 12, "*"), "rpad(c_mktsegment, 12, '*')"),
    ("space", lambda: text.concat(_seg(), text.space(lit(3)), lit("|")), "concat(c_mktsegment, repeat(' ', 3), '|')"), ("reverse", lambda: text.reverse(_name()), "reverse(c_name)"),
    ("initcap", lambda: text.initcap(_seg()), "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"), ("md5", lambda: text.md5(_name()), "md5(c_name)"), ("sha1", lambda: text.sha1(_name()), "sha1(c_name)"),
    ("sha2", lambda: text.sha2(_name(), 256), "sha256(c_name)"), ("bit_length", lambda: text.bit_length(_name()), "bit_length(c_name)::INT"), ("octet_length", lambda: text.octet_length(_name()), "octet_length(encode(c_name))::INT"),
    ("chr", lambda: text.chr_(e.add(numbers.mod(_cust(), lit(60)), 60)), "chr((c_custkey % 60 + 60)::INT)"),
    ("coalesce", lambda: control.coalesce(control.nullif(_seg(), lit("BUILDING")), lit("none")), "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"), ("nullif", lambda: control.nullif(_seg(), lit("BUILDING")), "nullif(c_mktsegment, 'BUILDING')"),
    ("greatest", lambda: control.greatest(_cust(), lit(700), control.nullif(_cust(), lit(9))), "greatest(c_custkey, 700, nullif(c_custkey, 9))"), ("least", lambda: control.least(_cust(), lit(700)), "least(c_custkey, 700)"),
    ("if_null", lambda: control.if_null(control.nullif(_cust(), lit(9)), lit(-1)), "coalesce(nullif(c_custkey, 9), -1)"),
]:
    _value(f"fn_{_n}", "customer", "c_custkey", _m, _s)

_u = lambda: e.div(sub(_b(), 5000.0), 10000.0)
_us = "((c_acctbal - 5000) / 10000)"
_r9 = lambda x: numbers.round_(x, 8)
for _n, _m, _s in [
    ("abs", lambda: numbers.abs_(_b()), "abs(c_acctbal)"), ("acos", lambda: _r9(numbers.acos(_u())), f"round(acos({_us}), 8)"), ("asin", lambda: _r9(numbers.asin(_u())), f"round(asin({_us}), 8)"),
    ("atan", lambda: _r9(numbers.atan(_u())), f"round(atan({_us}), 8)"), ("atan2", lambda: _r9(numbers.atan2(_u(), lit(2.0))), f"round(atan2({_us}, 2), 8)"), ("ceil", lambda: numbers.ceil(_b()), "ceil(c_acctbal)::BIGINT"),
    ("ceiling", lambda: numbers.ceiling(_b()), "ceiling(c_acctbal)::BIGINT"), ("cos", lambda: _r9(numbers.cos(_u())), f"round(cos({_us}), 8)"), ("cot", lambda: numbers.round_(numbers.cot(e.add(numbers.abs_(_u()), 0.5)), 8), f"round(cot(abs({_us}) + 0.5), 8)"),
    ("degrees", lambda: _r9(numbers.degrees(_u())), f"round(degrees({_us}), 8)"), ("exp", lambda: _r9(numbers.exp(_u())), f"round(exp({_us}), 8)"), ("floor", lambda: numbers.floor(_b()), "floor(c_acctbal)::BIGINT"),
    ("ln", lambda: _r9(numbers.ln(_cust1())), "round(ln(c_custkey + 1), 8)"), ("log", lambda: _r9(numbers.log(_cust1())), "round(log10(c_custkey + 1), 8)"), ("log10", lambda: _r9(numbers.log10(_cust1())), "round(log10(c_custkey + 1), 8)"),
    ("log_base", lambda: _r9(numbers.log_base(3.0, _cust1())), "round(ln(c_custkey + 1) / ln(3), 8)"), ("mod", lambda: numbers.mod(sub(_cust(), 700), lit(7)), "(c_custkey - 700) % 7"), ("pi", lambda: _r9(numbers.pi()), "round(pi(), 8)"),
    ("power", lambda: _r9(numbers.power(_u(), lit(2))), f"round(power({_us}, 2), 8)"), ("pow", lambda: _r9(numbers.pow_(_u(), lit(3))), f"round(pow({_us}, 3), 8)"), ("radians", lambda: _r9(numbers.radians(_b())), "round(radians(c_acctbal), 8)"),
    ("round", lambda: numbers.round_(e.div(_cust(), 8), 1), "round(c_custkey / 8, 1)"), ("sign", lambda: numbers.sign(_b()), "sign(c_acctbal)::DOUBLE"), ("sin", lambda: _r9(numbers.sin(_u())), f"round(sin({_us}), 8)"),
    ("sqrt", lambda: _r9(numbers.sqrt(_cust1())), "round(sqrt(c_custkey + 1), 8)"), ("tan", lambda: _r9(numbers.tan(_u())), f"round(tan({_us}), 8)"), ("trunc", lambda: numbers.trunc(e.div(_b(), 8.0)), "trunc(c_acctbal / 8)"),
    ("truncate", lambda: _r9(numbers.truncate(e.div(_cust(), 8), 2)), "round(trunc(c_custkey / 8 * 100) / 100, 8)"), ("log2", lambda: _r9(numbers.log2(_cust1())), "round(log2(c_custkey + 1), 8)"), ("cbrt", lambda: _r9(numbers.cbrt(_cust1())), "round(cbrt(c_custkey + 1), 8)"),
]:
    _value(f"fn_{_n}", "customer", "c_custkey", _m, _s)
_cust1 = lambda: e.cast(e.add(_cust(), 1), "double")

for _n, _m, _s in [
    ("year", lambda: dates.year(_ts()), "year(ts)::INT"), ("month", lambda: dates.month(_ts()), "month(ts)::INT"), ("day", lambda: dates.day(_ts()), "day(ts)::INT"), ("hour", lambda: dates.hour(_ts()), "hour(ts)::INT"),
    ("minute", lambda: dates.minute(_ts()), "minute(ts)::INT"), ("second", lambda: dates.second(_ts()), "second(ts)::INT"), ("quarter", lambda: dates.quarter(_ts()), "quarter(ts)::INT"),
    ("extract", lambda: dates.extract("month", _ts()), "extract(month FROM ts)::INT"), ("extract_dow", lambda: dates.extract("dow", _ts()), "extract(dow FROM ts)::INT"),
    ("date_add", lambda: dates.date_add(_ts(), 1, "month"), "ts + INTERVAL 1 MONTH"), ("date_sub", lambda: dates.date_sub(_ts(), 36, "hour"), "ts - INTERVAL 36 HOUR"), ("date_diff", lambda: dates.date_diff(_ts(), e.cast(lit("2024-01-01"), "date")), "date_diff('day', DATE '2024-01-01', ts::DATE)::INT"),
    ("date_format", lambda: dates.date_format(_ts(), "%Y/%m/%d at %H:%M"), "strftime(ts, '%Y/%m/%d at %H:%M')"), ("from_unix_time", lambda: e.cast(dates.from_unix_time(col("events.event_id")), "timestamp"), "make_timestamp(event_id * 1000000)"),
    ("end_of_month", lambda: dates.end_of_month(_ts()), "last_day(ts)"), ("day_of_week", lambda: dates.day_of_week(_ts()), "dayofweek(ts)::INT"), ("week_of_year", lambda: dates.week_of_year(_ts()), "weekofyear(ts)::INT"),
    ("date_trunc", lambda: dates.date_trunc("month", _ts()), "date_trunc('month', ts)::TIMESTAMP"), ("age", lambda: dates.age(e.cast(_ts(), "date"), e.cast(lit("2030-01-01"), "date")), "datepart('year', age(DATE '2030-01-01', ts::DATE)) || ' years ' || datepart('month', age(DATE '2030-01-01', ts::DATE)) || ' mons ' || datepart('day', age(DATE '2030-01-01', ts::DATE)) || ' days'"),
    ("json_length", lambda: json_text.json_length(_props()), "len(json_keys(props))::INT"), ("json_set", lambda: json_text.json_set(_props(), "$.z", 5), "json_merge_patch(props, '{\"z\":5}')::VARCHAR"),
    ("json_contains", lambda: json_text.json_contains(_props(), {"k": 3}), "coalesce((props ->> '$.k') = '3', false)"),
]:
    _value(f"fn_{_n}", "events", "event_id", _m, _s)


def _clock(name: str, make: Callable, of: Callable) -> None:
    """Another value at each run, so no SQL for it: what is compared is that it lies within ten minutes of this machine's clock."""

    def run(c):
        zone = ZoneInfo(c.spark.conf.get("spark.sql.session.timeZone"))
        now = datetime.datetime.now(datetime.timezone.utc)
        return select_from(c, "region").select("r_regionkey", v=e.call(f"near {name} {now}", lambda x: of(x, now, zone), make()))

    _ALL[f"fn_{name}"] = (run, "SELECT r_regionkey, TRUE AS v FROM region")


def _near(seconds, now: datetime.datetime):
    """Seconds since 1970 beside the machine's."""
    return F.abs(seconds - F.lit(now.timestamp())) < 600


def _time_of_day(x, now: datetime.datetime, zone: ZoneInfo):
    at = now.astimezone(zone)
    x = F.to_timestamp_ntz(F.concat(F.lit("2000-01-01 "), x))
    away = F.abs(F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x) - F.lit(at.hour * 3600 + at.minute * 60 + at.second))
    return F.least(away, 86400 - away) < 600


_clock("now", dates.now, lambda x, now, zone: _near(x.cast("double"), now))
_clock("unix_timestamp", dates.unix_timestamp, lambda x, now, zone: _near(x, now))
_clock("utc_now", dates.utc_now, lambda x, now, zone: F.date_format(x, "yyyy-MM-dd HH").isin([(now + datetime.timedelta(minutes=m)).strftime("%Y-%m-%d %H") for m in (-10, 0, 10)]))
_clock("local_timestamp", dates.local_timestamp, lambda x, now, zone: F.date_format(x, "yyyy-MM-dd HH").isin([(now + datetime.timedelta(minutes=m)).astimezone(zone).strftime("%Y-%m-%d %H") for m in (-10, 0, 10)]))
_clock("current_date", dates.current_date, lambda x, now, zone: x.cast("string").isin([(now + datetime.timedelta(minutes=m)).astimezone(zone).strftime("%Y-%m-%d") for m in (-10, 0, 10)]))
_clock("current_time", dates.current_time, _time_of_day)
_clock("local_time", dates.local_time, _time_of_day)
_clock("random", numbers.random, lambda x, now, zone: (x >= 0) & (x < 1))
_clock("rand", numbers.rand, lambda x, now, zone: (x >= 0) & (x < 1))


@_query("SELECT vec_id, len(list_append(embedding, 1.5::FLOAT))::INT AS n FROM embeddings")
def fn_array_append(c):
    return select_from(c, "embeddings").select("vec_id", n=e.call("size", F.size, arrays.array_append(col("embeddings.embedding"), e.cast(lit(1.5), "float"))))


# vectors ------------------------------------------------------------------------------------------------------------

_unit = [1.0, *[0.0] * 31, 0.5, *[0.25] * 31]
_list = "[" + ", ".join(f"{x}::DOUBLE" for x in _unit) + "]"
_dv = "embedding::DOUBLE[64]"
for _n, _metric, _s in [
    ("cosine", "cosine", f"array_cosine_distance({_dv}, {_list}::DOUBLE[64])"), ("l2", "l2", f"list_distance({_dv}::DOUBLE[], {_list})"), ("euclidean", "euclidean", f"list_distance({_dv}::DOUBLE[], {_list})"),
    ("inner_product", "inner_product", f"-list_inner_product({_dv}::DOUBLE[], {_list})"), ("dot", "dot", f"-list_inner_product({_dv}::DOUBLE[], {_list})"),
    ("l1", "l1", f"list_sum(list_transform(list_zip({_dv}::DOUBLE[], {_list}), lambda p: abs(p[1] - p[2])))"), ("manhattan", "manhattan", f"list_sum(list_transform(list_zip({_dv}::DOUBLE[], {_list}), lambda p: abs(p[1] - p[2])))"),
]:
    _value(f"vec_{_n}", "embeddings", "vec_id", lambda m=_metric: numbers.round_(vectors.vector_distance(m, col("embeddings.embedding"), _unit), 6), f"round({_s}, 6)")


@_query(f"SELECT vec_id, round(array_cosine_distance({_dv}, {_list}::DOUBLE[64]), 6) AS d FROM embeddings ORDER BY array_cosine_distance({_dv}, {_list}::DOUBLE[64]), vec_id LIMIT 10")
def vec_knn(c):
    d = vectors.cosine_distance(col("embeddings.embedding"), _unit)
    return select_from(c, "embeddings").select("vec_id", d=numbers.round_(d, 6)).order_by(asc(d), asc(col("embeddings.vec_id"))).limit(10)


@_query(f"SELECT vec_id, label FROM embeddings ORDER BY list_distance({_dv}::DOUBLE[], {_list}), vec_id LIMIT 25")
def vec_match(c):
    return select_from(c, "embeddings").select("vec_id", "label").nearest("embedding", _unit, 25)


# trees --------------------------------------------------------------------------------------------------------------

_TREE = Tree("id", "parent", "lft", "rght", "depth")
_PARENTS = "SELECT (r_regionkey + 1)::BIGINT AS id, NULL::BIGINT AS parent FROM region UNION ALL SELECT (100 + n_nationkey)::BIGINT, (n_regionkey + 1)::BIGINT FROM nation UNION ALL SELECT 1000 + s_suppkey, (100 + s_nationkey)::BIGINT FROM supplier"
#: Of a table of id, parent and place (its text order among its siblings), all that a nested set has.
_NESTED = """WITH RECURSIVE t AS MATERIALIZED ({}), p AS (SELECT id, parent, 0 AS depth, place AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, p.depth + 1, p.path || '/' || t.place FROM t JOIN p ON t.parent = p.id),
o AS (SELECT *, row_number() OVER (ORDER BY path) AS place FROM p),
s AS (SELECT a.id, a.parent, a.depth, 2 * a.place - a.depth - 1 AS lft, 2 * a.place - a.depth - 1 + 2 * (SELECT count(*) FROM p b WHERE starts_with(b.path, a.path || '/')) + 1 AS rght, path FROM o a)"""
_PLACE = "lpad(id::VARCHAR, 9, '0')"
_RECURSIVE = _NESTED.format(f"SELECT id, parent, {_PLACE} AS place FROM ({_PARENTS})")
_ALL_OF_IT = " SELECT id, parent, lft::BIGINT AS lft, rght::BIGINT AS rght, depth::INT AS depth FROM s"


def _tree(c):
    rows = [("region", "r_regionkey + 1", "CAST(NULL AS BIGINT)"), ("nation", "100 + n_nationkey", "n_regionkey + 1"), ("supplier", "1000 + s_suppkey", "100 + s_nationkey")]
    parts = [c.frame(t).selectExpr(f"CAST({i} AS BIGINT) AS id", f"CAST({p} AS BIGINT) AS parent", "CAST(NULL AS BIGINT) AS lft", "CAST(NULL AS BIGINT) AS rght", "CAST(NULL AS INT) AS depth") for t, i, p in rows]
    return _TREE.recover(parts[0].union(parts[1]).union(parts[2]))


@_query(_RECURSIVE + " SELECT id, parent, lft::BIGINT AS lft, rght::BIGINT AS rght, depth::INT AS depth FROM s")
def tree_recover(c):
    return _tree(c)


@_query(_RECURSIVE + " SELECT id, depth::INT AS level FROM s")
def tree_depths(c):
    return _TREE.with_depth(_tree(c), "level").select("id", "level")


@_query(_RECURSIVE + " SELECT id FROM s WHERE lft <= (SELECT lft FROM s WHERE id = 1005) AND rght >= (SELECT rght FROM s WHERE id = 1005)")
def tree_ancestors(c):
    t = _tree(c).cache()
    r = t.where("id = 1005").first()
    return _TREE.ancestors(t, (r["lft"], r["rght"])).select("id")


@_query(_RECURSIVE + " SELECT id FROM s WHERE lft > (SELECT lft FROM s WHERE id = 2) AND rght < (SELECT rght FROM s WHERE id = 2)")
def tree_descendants(c):
    t = _tree(c).cache()
    r = t.where("id = 2").first()
    return _TREE.descendants(t, (r["lft"], r["rght"])).select("id")


@_query(_RECURSIVE + " SELECT id FROM s WHERE lft >= (SELECT lft FROM s WHERE id = 3) AND rght <= (SELECT rght FROM s WHERE id = 3)")
def tree_subtree(c):
    t = _tree(c).cache()
    r = t.where("id = 3").first()
    return _TREE.subtree(t, (r["lft"], r["rght"])).select("id")


@_query(_RECURSIVE + " SELECT id FROM s WHERE parent = 2")
def tree_children(c):
    return _TREE.children(_tree(c), 2).select("id")


@_query(_RECURSIVE + " SELECT id FROM s WHERE parent IS NULL AND id <> 3")
def tree_siblings(c):
    return _TREE.siblings(_tree(c), None, 3).select("id")


@_query(_RECURSIVE + " SELECT id FROM s WHERE depth = 1")
def tree_at_depth(c):
    return _TREE.at_depth(_tree(c), 1).select("id")


@_query(_RECURSIVE + " SELECT id, (rght - lft - 1)::BIGINT // 2 AS n FROM s")
def tree_descendant_count(c):
    return _tree(c).select("id", _TREE.descendant_count().alias("n"))


@_query(_NESTED.format(f"SELECT id, CASE WHEN id = 102 THEN 4 ELSE parent END AS parent, CASE WHEN id = 102 THEN 'z' ELSE {_PLACE} END AS place FROM ({_PARENTS})") + _ALL_OF_IT)
def tree_move(c):
    return _TREE.move(_tree(c).cache(), 102, 4)


@_query(_NESTED.format(f"SELECT id, CASE WHEN id = 102 THEN NULL WHEN parent = 102 THEN (SELECT parent FROM ({_PARENTS}) WHERE id = 102) ELSE parent END AS parent, CASE WHEN id = 102 THEN 'z' WHEN parent = 102 THEN '000000102' || {_PLACE} ELSE {_PLACE} END AS place FROM ({_PARENTS})") + _ALL_OF_IT)
def tree_remove(c):
    return _TREE.remove(_tree(c).cache(), 102)


@_query(_NESTED.format(f"SELECT id, parent, CASE WHEN id = 108 THEN '000000102a' ELSE {_PLACE} END AS place FROM ({_PARENTS})") + _ALL_OF_IT)
def tree_move_up(c):
    return _TREE.move_up(_tree(c).cache(), 108)


@_query(_NESTED.format(f"SELECT id, parent, {_PLACE} AS place FROM ({_PARENTS} UNION ALL SELECT 9999::BIGINT, 3::BIGINT)") + _ALL_OF_IT)
def tree_insert(c):
    return _TREE.insert(_tree(c).cache(), {"id": 9999}, 3)


@_query(_RECURSIVE + " SELECT id FROM s WHERE rght - lft = 1")
def tree_leaves(c):
    return _TREE.leaves(_tree(c)).select("id")


@_query(_RECURSIVE + " SELECT id FROM s WHERE parent IS NULL")
def tree_roots(c):
    return _TREE.roots(_tree(c)).select("id")


@_query(_RECURSIVE + " SELECT id, repeat('__', depth) || id::VARCHAR AS label FROM s")
def tree_list(c):
    return _TREE.listed(_tree(c), "id")


#: Faults in a sound tree: two nodes whose ends change places, one that ends beyond its parent, one below 1, one turned round.
_FAULTY = "CASE WHEN id = 104 THEN rght + 3 WHEN id = 2 THEN 100000 WHEN id = 5 THEN lft - 1 ELSE rght END"
_FAULTS = _RECURSIVE.rstrip() + f""", f AS (SELECT id, CASE WHEN id = 1 THEN 0 ELSE lft END AS lft, {_FAULTY} AS rght FROM s), g AS (SELECT * FROM f WHERE lft < rght), b AS (SELECT id, unnest([lft, rght]) AS at FROM g)
SELECT id, 'lft must be below rght' AS problem FROM f WHERE lft >= rght UNION ALL SELECT id, 'lft must be 1 or more' FROM f WHERE lft < rght AND lft < 1
UNION ALL SELECT DISTINCT x.id, 'a bound is shared' FROM b AS x JOIN b AS y ON x.at = y.at AND x.id <> y.id
UNION ALL SELECT DISTINCT x.id, 'crosses another node' FROM g AS x JOIN g AS y ON x.lft < y.lft AND y.lft < x.rght AND x.rght < y.rght OR y.lft < x.lft AND x.lft < y.rght AND y.rght < x.rght"""


@_query(_FAULTS)
def tree_validate(c):
    left = "CASE WHEN id = 1 THEN 0 ELSE lft END"
    return _TREE.validate(_tree(c).selectExpr("id", "parent", f"{left} AS lft", f"{_FAULTY} AS rght", "depth"))


@_query("SELECT NULL::BIGINT AS id, NULL::VARCHAR AS problem WHERE FALSE")
def tree_validate_sound(c):
    return _TREE.validate(_tree(c))


_NATION_TREE = Tree("id", "parent", "lft", "rght", "depth", ("region",))


@_query("SELECT n_nationkey AS id, 2 * row_number() OVER w - 1 AS lft, 2 * row_number() OVER w AS rght FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def tree_scopes(c):
    """Trees of one table, a tree for each region, and what each scope holds."""
    rows = c.frame("nation").selectExpr("n_nationkey AS id", "CAST(NULL AS INT) AS parent", "CAST(NULL AS BIGINT) AS lft", "CAST(NULL AS BIGINT) AS rght", "CAST(NULL AS INT) AS depth", "n_regionkey AS region")
    t = _NATION_TREE.recover(rows)
    whole = _NATION_TREE.within(t, region=0)
    for r in range(1, 5):
        whole = whole.union(_NATION_TREE.within(t, region=r))
    return whole.select("id", "lft", "rght")


@_query(_NESTED.format(f"SELECT id, parent, {_PLACE} AS place FROM ({_PARENTS}) WHERE id <> 2") + _ALL_OF_IT)
def tree_delete(c):
    return _TREE.delete(_tree(c).cache(), 2)[0]


# changes ------------------------------------------------------------------------------------------------------------

_C = "SELECT c_custkey, c_name, c_acctbal FROM customer"
_customers = lambda c: c.frame("customer").select("c_custkey", "c_name", "c_acctbal")


@_query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where(c):
    return dml.update(_customers(c), {"c_acctbal": 0.0}, F.col("c_acctbal") < 0)


@_query("SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS c_name, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey")
def update_join(c):
    t = c.frame("customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").alias("k"))
    return dml.update_from(t, c.frame("nation").where("n_regionkey = 1").selectExpr("n_nationkey AS k", "n_name"), ["k"], {"c_name": "n_name"}).drop("k")


@_query(_C + " WHERE NOT c_acctbal < 0")
def delete_where(c):
    return dml.delete(_customers(c), F.col("c_acctbal") < 0)


@_query(_C + " WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def delete_using(c):
    return dml.delete_using(_customers(c), c.frame("orders").where("o_orderstatus = 'P'").selectExpr("o_custkey AS c_custkey"), ["c_custkey"])


_NEW = "SELECT c_custkey + 700 AS c_custkey, 'new' AS c_name, 1.0::DOUBLE AS c_acctbal FROM customer"
_new = lambda c: c.frame("customer").selectExpr("c_custkey + 700 AS c_custkey", "'new' AS c_name", "1.0D AS c_acctbal")


@_query(f"WITH n AS ({_NEW}) SELECT c_custkey, CASE WHEN n.c_custkey IS NULL THEN c.c_name ELSE 'changed' END AS c_name, c.c_acctbal FROM customer c LEFT JOIN n USING (c_custkey) UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def upsert_update(c):
    return dml.upsert(_customers(c), _new(c), ["c_custkey"], {"c_name": "changed"})


@_query(f"SELECT * FROM ({_NEW}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'changed', c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_custkey IN (SELECT c_custkey FROM ({_NEW}))")
def upsert_returning(c):
    return dml.upsert_returning(_customers(c), _new(c), ["c_custkey"], {"c_name": "changed"}, F.col("c_acctbal") > 5000)[1]


@_query(f"{_C} UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def upsert_nothing(c):
    return dml.upsert(_customers(c), _new(c), ["c_custkey"])


@_query(f"WITH n AS ({_NEW}) SELECT * FROM n UNION ALL {_C} WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def bulk_upsert(c):
    return dml.bulk_upsert(_customers(c), _new(c), ["c_custkey"])


@_query(f"WITH n AS ({_NEW}) SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN n ON n.c_custkey = c.c_custkey")
def bulk_update(c):
    return dml.bulk_update(_customers(c), _new(c), ["c_custkey"])


@_query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'big' ELSE c_name END AS c_name, c_acctbal FROM customer")
def bulk_update_where(c):
    return dml.bulk_update_where(_customers(c), c.frame("orders").where("o_totalprice > 400000").select("o_custkey"), "c_custkey", {"c_name": "big"})


@_query(_C + " WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def bulk_delete(c):
    return dml.bulk_delete(_customers(c), c.frame("orders").where("o_totalprice > 400000").select("o_custkey"), "c_custkey")


@_query(f"{_C} UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def insert_select(c):
    return sources.insert_select(_customers(c), c.frame("supplier").select("s_suppkey", "s_name", "s_acctbal"))


# sessions -----------------------------------------------------------------------------------------------------------


def _union_of(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


@_query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'Changed' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 90, 'New', 1")
def session_update(c):
    """Found, changed, added and removed rows of one session; the same key gives the same object."""
    s = Session(c)
    nation = c.definition("nation")
    row = s.find(nation, 3)
    row["n_name"] = "Changed"
    if s.find(nation, 3) is not row:
        raise AssertionError("two objects for one key")
    s.add(nation, {"n_nationkey": 90, "n_name": "New", "n_regionkey": 1})
    s.remove(nation, s.find(nation, 7))
    s.commit()
    return c.frame("nation")


@_query("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'kept' ELSE n_name END AS n_name FROM nation")
def session_transaction(c):
    """A transaction that fails leaves nothing; one that ends is kept."""
    s, nation = Session(c), c.definition("nation")
    try:
        with s.transaction():
            s.find(nation, 2)["n_name"] = "lost"
            s.flush()
            raise LookupError
    except LookupError:
        pass
    with s.transaction():
        s.find(nation, 1)["n_name"] = "kept"
    return c.frame("nation").select("n_nationkey", "n_name")


@_query("SELECT 'before' AS told, 91::BIGINT AS n UNION ALL SELECT 'after', 91 UNION ALL SELECT 'event', 5")
def session_hooks(c):
    s, nation, told = Session(c), c.definition("nation"), []
    s.on("before_insert", lambda t, r: told.append(("before", r["n_nationkey"])))
    s.on("after_insert", lambda t, r: told.append(("after", r["n_nationkey"])))
    s.on("imported", lambda n: told.append(("event", n)))
    s.add(nation, {"n_nationkey": 91, "n_name": "N", "n_regionkey": 0})
    s.raise_event("imported", 5)
    s.commit()
    return c.spark.createDataFrame(told, "told string, n long")


_GRAPH = "(VALUES (1, 'One', 11, 'Child 11', 200, 'S 200'), (1, 'One', 12, 'Child 12', 201, 'S 201'), (7, 'Seven', 13, 'Child 13', 202, 'S 202')) AS g(r, rn, n, nn, s, sn)"


@_query(f"WITH g AS (SELECT * FROM {_GRAPH}) SELECT 'region' AS t, coalesce(g.r, r_regionkey)::BIGINT AS id, coalesce(g.rn, r_name) AS name, NULL::BIGINT AS up FROM region FULL JOIN (SELECT DISTINCT r, rn FROM g) AS g ON g.r = r_regionkey UNION ALL SELECT 'nation', coalesce(n, n_nationkey), coalesce(nn, n_name), CASE WHEN n IS NULL AND n_regionkey IN (1, 7) THEN NULL ELSE coalesce(r, n_regionkey) END FROM nation FULL JOIN g ON n = n_nationkey UNION ALL SELECT 'supplier', coalesce(s, s_suppkey), coalesce(sn, s_name), CASE WHEN s IS NULL AND s_nationkey IN (11, 12, 13) THEN NULL ELSE coalesce(n, s_nationkey) END FROM supplier FULL JOIN g ON s = s_suppkey")
def graph_save(c):
    """Regions with nations with suppliers: inserted or updated, and children that the payload lacks detached."""
    payload = lambda r, rn, *ns: {"r_regionkey": r, "r_name": rn, "nations": [{"n_nationkey": n, "n_name": f"Child {n}", "suppliers": [{"s_suppkey": k, "s_name": f"S {k}"}]} for n, k in ns]}
    Session(c).save_graphs(c.definition("region"), [payload(1, "One", (11, 200), (12, 201)), payload(7, "Seven", (13, 202))], prune_missing=True)
    r, n, s = (c.frame(t) for t in ("region", "nation", "supplier"))
    return _union_of(
        r.selectExpr("'region' AS t", "CAST(r_regionkey AS BIGINT) AS id", "r_name AS name", "CAST(NULL AS BIGINT) AS up"), n.selectExpr("'nation'", "CAST(n_nationkey AS BIGINT)", "n_name", "CAST(n_regionkey AS BIGINT)"), s.selectExpr("'supplier'", "s_suppkey", "s_name", "CAST(s_nationkey AS BIGINT)"),
    )


@_query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'Patched' ELSE c_name END AS c_name, CASE WHEN c_custkey = 5 THEN 4 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey = 5 THEN 'Four' END AS nation FROM customer")
def graph_patch(c):
    """A row that is there, with the row it belongs to; one that isn't there raises."""
    s, customer = Session(c), c.definition("customer")
    s.patch_graph(customer, {"c_custkey": 5, "c_name": "Patched", "nation": {"n_nationkey": 4, "n_name": "Four"}})
    try:
        s.patch_graph(customer, {"c_custkey": -1, "c_name": "x"})
        raise AssertionError("a row that isn't there was patched")
    except LookupError:
        pass
    named = c.frame("nation").where("n_name = 'Four'").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return c.frame("customer").select("c_custkey", "c_name", "c_nationkey").join(named, "c_nationkey", "left").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") == 5, F.col("nation")).alias("nation"))


@_query("SELECT n_nationkey, CASE WHEN n_nationkey IN (2, 3) THEN 0 WHEN n_nationkey = 6 OR n_regionkey = 4 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def relation_changes(c):
    """Children attached, detached and cleared; all of a relation in one join."""
    s, region = Session(c), c.definition("region")
    s.attach(region, "nations", 0, [2, 3])
    s.detach(region, "nations", 1, [6])
    s.clear(region, "nations", 4)
    s.flush()
    return c.frame("nation").select("n_nationkey", "n_regionkey")


@_query("SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_orderkey <> 1 UNION ALL SELECT 1, 10 UNION ALL SELECT 1, 11 UNION SELECT 2, 12")
def relation_sync(c):
    """Pivot rows of a many-to-many relation: one order's set, another's extended."""
    c.put("lineitem", c.frame("lineitem").select("l_orderkey", "l_partkey").distinct())
    s, orders = Session(c), c.definition("orders")
    s.sync(orders, "parts", 1, [10, 11])
    s.attach(orders, "parts", 2, [12])
    s.flush()
    return c.frame("lineitem").select("l_orderkey", "l_partkey")


@_query("SELECT max(o_totalprice) AS top, count(*) AS n FROM orders WHERE o_custkey = 10")
def procedure_call(c):
    s = Session(c)
    s.procedures["totals"] = lambda session, customer: [r.asDict() for r in session.catalog.frame("orders").where(F.col("o_custkey") == customer).agg(F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n")).collect()]
    out, _ = s.call_procedure("totals", {"customer": 10}, ("top", "n"))
    return c.spark.createDataFrame([(out["top"], out["n"])], "top double, n long")


# changed rows, as they are returned


@_query("SELECT c_custkey, c_name, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_acctbal < 0")
def update_returning(c):
    return dml.update_returning(_customers(c), {"c_acctbal": 0.0}, F.col("c_acctbal") < 0)[1]


@_query(_C + " WHERE c_acctbal < 0")
def delete_returning(c):
    return dml.delete_returning(_customers(c), F.col("c_acctbal") < 0)[1]


@_query("SELECT * FROM region UNION ALL VALUES (50, 'FIFTY'), (51, 'FIFTY-ONE')")
def insert_values(c):
    return sources.insert_rows(c.frame("region"), [{"r_regionkey": 50, "r_name": "FIFTY"}, {"r_regionkey": 51, "r_name": "FIFTY-ONE"}])


# entities, results, pages -------------------------------------------------------------------------------------------


@dataclasses.dataclass
class Region:
    r_regionkey: int
    r_name: str


_REGIONS = lambda: entity_table(Region, "region", "r_regionkey")
_as_rows = lambda c, rows, kinds: c.spark.createDataFrame(rows, kinds)


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def entity_scan(c):
    found = materialize(select_from(sources.Catalog(c.spark, c.root), _REGIONS()).to_df(), Region)
    return _as_rows(c, [(r.r_regionkey, r.r_name) for r in found], "r_regionkey long, r_name string")


@_query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def pluck(c):
    return _as_rows(c, [(x,) for x in select_from(c, "nation").where(eq(col("nation.n_regionkey"), 2)).pluck("n_name")], "n_name string")


@_query("SELECT n_nationkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::VARCHAR AS nested FROM nation JOIN region ON r_regionkey = n_regionkey")
def columns_deep(c):
    return _json(select_columns_deep(select_from(c, "nation"), ["n_nationkey"], {"region": ["r_name"]}).to_df(), "n_nationkey", "region")


@_query("SELECT n_nationkey, to_json(coalesce(list({'s_suppkey': s_suppkey} ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), []))::VARCHAR AS nested FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_nationkey")
def include_updated(c):
    """A later call for a relation takes the place of the earlier."""
    q = select_from(c, "nation").include("suppliers", kind="inner").include("suppliers", ["s_suppkey"], where=gt(col("suppliers.s_acctbal"), 0))
    return _json(q.to_df(), "n_nationkey", "suppliers")


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def first_row(c):
    row = select_from(c, "customer").select("c_custkey", "c_name").order_by(desc(_b()), asc(col("customer.c_custkey"))).first_or_fail()
    return _as_rows(c, [(row["c_custkey"], row["c_name"])], "c_custkey long, c_name string")


@_query("SELECT o_orderkey, 2 AS page, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 20 AS more FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10)")
def filtered_page(c):
    page = execute_filtered_paged(select_from(c, "orders").select("o_orderkey", "o_totalprice"), {"o_orderstatus": "P"}, 2, 10, "-total", {"total": col("orders.o_totalprice")})
    said = page.response()
    return _as_rows(c, [(r["o_orderkey"], said["page"], said["totalItems"], said["hasNextPage"]) for r in page.items], "o_orderkey long, page int, total long, more boolean")


@_query("SELECT c_custkey, (row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) + 6)::BIGINT // 7 AS page FROM (SELECT * FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 21)")
def cursor_walk(c):
    """Three pages, each after the last cursor of the one before."""
    q, out, after = _by_segment(c), [], None
    for n in range(1, 4):
        page = execute_cursor(q, first=7, after=after)
        out += [(r["c_custkey"], n) for r in page.items]
        after = page.end_cursor
    return _as_rows(c, out, "c_custkey long, page long")


@_query("SELECT n_nationkey, n_name AS name, coalesce(nullif(n_regionkey, 1), -1) AS region FROM nation")
def shaped_response(c):
    df = select_from(c, "nation").select("n_nationkey", "n_name", n_regionkey=_nulled()).to_df()
    return to_response(df, ["n_nationkey", "n_name", "n_regionkey"], names={"n_name": "name", "n_regionkey": "region"}, defaults={"n_regionkey": -1})


@_query("SELECT to_json({'s_suppkey': s_suppkey, 's_name': s_name, 's_nationkey': s_nationkey})::VARCHAR AS json FROM supplier")
def json_rows(c):
    return as_json(select_from(c, "supplier").select("s_suppkey", "s_name", "s_nationkey").to_df())


@_query("SELECT 'unknown operator' AS said UNION ALL SELECT 'missing operator'")
def filter_guards(c):
    """What must raise, lest it match all rows."""
    said = []
    for name, where in (("unknown operator", {"o_orderstatus": {"equal": "P"}}), ("missing operator", {"lines": {"l_quantity": 5}})):
        try:
            apply_filter(select_from(c, "orders"), where)
        except ValueError:
            said.append((name,))
    return _as_rows(c, said, "said string")


@_query("SELECT (SELECT count(*) FROM region) AS first, (SELECT count(*) FROM region) + 1 AS later, 2 AS made")
def cached_query(c):
    """Kept rows are read again, until their table is written."""
    cache = QueryCache().bind(c)
    q, counts = select_from(c, "region").select("r_regionkey"), []
    for step in range(3):
        if step == 2:
            c.put("region", sources.insert_rows(c.frame("region"), [{"r_regionkey": 77, "r_name": "x"}]))
        counts.append(q.cached(cache, "regions", "5m").count())
    cache.invalidate("regions")
    return _as_rows(c, [(counts[1], counts[2], len(set(counts)))], "first long, later long, made int")


@_query("SELECT 'flagship' AS name, (SELECT count(DISTINCT r_regionkey) FROM region) AS n, true AS planned")
def logged_query(c):
    runner = QueryRunner()
    rows = runner.run("flagship", select_from(c, "region").select("r_regionkey").distinct())
    return _as_rows(c, [(runner.log[0].name, len(rows), "HashAggregate" in runner.log[0].plan)], "name string, n long, planned boolean")


# schemas ------------------------------------------------------------------------------------------------------------


@_query("SELECT column_name AS name, CASE column_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'TEXT' ELSE column_type END AS type FROM (DESCRIBE orders)")
def introspected_columns(c):
    return _as_rows(c, [(n, x.type) for n, x in sources.introspect("orders", c.frame("orders")).columns.items()], "name string, type string")


@_query("SELECT * FROM (VALUES ('add_column', 'r_size', true), ('alter_column', 'r_regionkey', false), ('drop_column', 'r_name', false), ('add_index', 'r_regionkey', true), ('create_table', NULL, true), ('drop_table', NULL, false)) AS t(kind, column_name, safe)")
def schema_diff(c):
    wanted = table("region", {"r_regionkey": column("BIGINT", primary=True), "r_size": "INT"}, indexes=(("r_regionkey",),))
    found = changes.diff_schema([wanted, table("added", {"id": "INT"})], {"region": c.frame("region"), "nation": c.frame("nation")})
    return _as_rows(c, [(x.kind, x.column, x.safe) for x in found], "kind string, column_name string, safe boolean")


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, 3 AS r_size FROM region")
def schema_synchronised(c):
    wanted = table("region", {"r_regionkey": column("BIGINT", primary=True), "r_size": column("INT", default=3)})
    changes.synchronise(c, [wanted], {"region": c.frame("region")}, allow_destructive=True)
    return c.frame("region")


@_query("SELECT r_regionkey AS id, r_name AS name, 'none' AS note FROM region")
def created_table(c):
    """A table made by its CREATE TABLE text, filled with the columns it shares; what isn't given takes its default."""
    name = f"tessella_created_{uuid.uuid4().hex}"
    t = table(name, {"id": column("INT", primary=True), "name": column("TEXT", comment="it's the name"), "note": column("TEXT", default="none")}, indexes=(("name",),))
    folder = shared_path(c.spark, "created")
    c.spark.sql(changes.create_table_sql(t, folder))
    c.spark.sql(f"INSERT INTO {name} (id, name) SELECT r_regionkey, r_name FROM parquet.`{c.root}/region.parquet`")
    out = c.spark.table(name).collect()
    c.spark.sql(f"DROP TABLE {name}")
    return _as_rows(c, [tuple(r) for r in out], "id int, name string, note string")


@_query("SELECT column_name AS name, CASE WHEN column_type IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN column_type = 'DOUBLE' THEN 'number' ELSE 'string' END AS type FROM (DESCRIBE customer)")
def openapi_columns(c):
    said = openapi.table_schema(c.definition("customer"))["properties"]
    return _as_rows(c, [(n, x["type"]) for n, x in said.items()], "name string, type string")


@_query("SELECT n_nationkey AS id, n_name AS name, 't' AS kind FROM nation")
def copied_through_files(c):
    """Written and read again as ORC, JSON and CSV: what the three agree on."""
    df = c.frame("nation").selectExpr("n_nationkey AS id", "n_name AS name")
    found = []
    for kind in ("orc", "json", "csv"):
        path = shared_path(c.spark, kind)
        sources.write_table(df, path, kind)
        found.append(sources.read_table(c.spark, kind, path, df.schema))
    return found[0].intersect(found[1]).intersect(found[2]).withColumn("kind", F.lit("t"))


# correlated and lateral ---------------------------------------------------------------------------------------------


@_query("SELECT n_nationkey, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS top FROM nation")
def select_subquery_correlated(c):
    q = select_from(c, "customer").select(m=e.max_(_b())).where(eq(col("customer.c_nationkey"), outer_ref("nation.n_nationkey")))
    return select_from(c, "nation").select("n_nationkey").select_subquery("top", q)


@_query("SELECT c_custkey FROM customer a WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer b WHERE b.c_nationkey = a.c_nationkey)")
def scalar_subquery_correlated(c):
    q = select_from(c, "customer").as_("b").select(m=e.avg(col("b.c_acctbal"))).where(eq(col("b.c_nationkey"), outer_ref("a.c_nationkey")))
    return select_from(c, "customer").as_("a").select("c_custkey").where(gt(col("a.c_acctbal"), scalar(q)))


@_query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def join_function(c):
    words = e.call("words", lambda x: F.split(x, " "), col("part.p_name"))
    return select_from(c, "part").join_function("explode", words, alias="w", columns=("word",)).select("part.p_partkey", word=col("w.word"))


@_query("SELECT event_id, props ->> '$.k' AS k FROM events")
def join_function_left(c):
    return select_from(c, "events").join_function("json_tuple", col("events.props"), lit("k"), alias="j", columns=("k",), kind="left").select("events.event_id", k=col("j.k"))


@_query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_columns(c):
    return select_from(c, "customer").select("c_nationkey", "c_mktsegment").distinct("customer.c_nationkey")


# validation and streams ---------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, regexp_matches(lower(c_mktsegment) || '@x.org', '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS mail, regexp_matches(c_mktsegment, '^[A-Za-z0-9]*$') AS alnum FROM customer")
def validate_email(c):
    return c.frame("customer").select("c_custkey", validate.email(F.concat(F.lower("c_mktsegment"), F.lit("@x.org"))).alias("mail"), validate.alphanumeric(F.col("c_mktsegment")).alias("alnum"))


_D = "list_transform(range(1, 12), lambda i: substr(lpad(p::VARCHAR, 11, '0'), i, 1)::INT)"
_W = lambda n, top: " + ".join(f"d[{i + 1}] * {top - i}" for i in range(n))


@_query(f"WITH x AS (SELECT c_custkey, c_custkey * 97 + 11144477735 - c_custkey % 2 * (c_custkey * 97) AS p FROM customer), y AS (SELECT c_custkey, {_D} AS d FROM x) SELECT c_custkey, (len(list_distinct(d)) > 1 AND d[10] = CASE WHEN ({_W(9, 10)}) % 11 < 2 THEN 0 ELSE 11 - ({_W(9, 10)}) % 11 END AND d[11] = CASE WHEN ({_W(10, 11)}) % 11 < 2 THEN 0 ELSE 11 - ({_W(10, 11)}) % 11 END) AS ok FROM y")
def validate_cpf(c):
    number = (F.col("c_custkey") * 97 + F.lit(11144477735) - F.col("c_custkey") % 2 * (F.col("c_custkey") * 97)).cast("string")
    return c.frame("customer").select("c_custkey", validate.cpf(F.lpad(number, 11, "0")).alias("ok"))


@_query(
    "WITH x AS (SELECT s_suppkey, list_transform(range(1, 15), lambda i: substr(lpad((11222333000100 + s_suppkey % 3 * 81)::VARCHAR, 14, '0'), i, 1)::INT) AS d FROM supplier), "
    "y AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: d[i] * [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2][i])) % 11 AS a, list_sum(list_transform(range(1, 14), lambda i: d[i] * [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2][i])) % 11 AS b FROM x) "
    "SELECT s_suppkey, d[13] = CASE WHEN a < 2 THEN 0 ELSE 11 - a END AND d[14] = CASE WHEN b < 2 THEN 0 ELSE 11 - b END AS ok FROM y"
)
def validate_cnpj(c):
    number = F.lpad((F.lit(11222333000100) + F.col("s_suppkey") % 3 * 81).cast("string"), 14, "0")
    return c.frame("supplier").select("s_suppkey", validate.country_check("BR", "cnpj", number).alias("ok"))


@_query("SELECT p_partkey, regexp_full_match(p_partkey::VARCHAR || '000-100', '[0-9]{5}-?[0-9]{3}') AS ok FROM part")
def validate_cep(c):
    return c.frame("part").select("p_partkey", validate.cep(F.concat(F.col("p_partkey").cast("string"), F.lit("000-100"))).alias("ok"))


@_query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def session_events(c):
    return windows.sessions(c.frame("events"), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_events(c):
    return windows.windowed(c.frame("events"), "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")])
