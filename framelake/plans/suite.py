"""Registered queries over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..operators import predicates as P
from ..operators import sketches
from ..operators.dataset import Dataset
from ..session import scratch_path
from ..sources import direct, formats, storage, writers
from ..sources.reader import reader
from ..sources.reader import sql as run_sql
from ..sources.schema import Report, label
from ..streaming import sink
from ..streaming import windows as event_windows
from ..streaming.sink import routed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> Dataset:
    return Dataset(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def both(name: str, table: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query written in Spark SQL over one table."""

    @query(name, duck_sql or spark_sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, spark_sql, **{table: read(spark, sf_dir, table)}).df


# SQL surface
both("sql_group_by", "lineitem", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag")
both("sql_having", "lineitem", "SELECT l_suppkey, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50")
both("sql_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
both("sql_order_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
both("sql_subquery", "orders", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey) AS t WHERE n > 3")
both(
    "sql_alias_where",
    "orders",
    "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders WHERE y >= 1995 GROUP BY YEAR(o_orderdate)",
    "SELECT y::INTEGER AS y, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) WHERE y >= 1995 GROUP BY y",
)


@query("sql_global_agg", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean_qty, min(l_tax) AS least, max(l_tax) AS most FROM lineitem")
def sql_global_agg(spark, d):
    li = read(spark, d, "lineitem").group_by("*").aggregate([("COUNT", "*"), ("AVG", "l_quantity"), ("MIN", "l_tax"), ("MAX", "l_tax")]).df
    return li.select(F.col("COUNT(*)").alias("n"), F.round("AVG(l_quantity)", 6).alias("mean_qty"), F.col("MIN(l_tax)").alias("least"), F.col("MAX(l_tax)").alias("most"))


# predicates
@query("expr_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%e%'")
def expr_like(spark, d):
    return read(spark, d, "part").filter(P.like("p_name", "%A%e%")).select("p_partkey", "p_name").df


@query("expr_not_like", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%BRASS'")
def expr_not_like(spark, d):
    return read(spark, d, "part").filter(P.not_like("p_type", "%BRASS")).select("p_partkey").df


@query("expr_matches", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-3][0-9]?$')")
def expr_matches(spark, d):
    return read(spark, d, "part").filter(P.matches("p_brand", "#[1-3][0-9]?$")).select("p_partkey").df


@query("expr_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def expr_in(spark, d):
    return read(spark, d, "orders").filter(P.is_in("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey").df


@query("expr_not_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def expr_not_in(spark, d):
    return read(spark, d, "orders").filter(P.not_in("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey").df


@query("expr_contains", "SELECT doc_id FROM documents WHERE contains(text, 'the')")
def expr_contains(spark, d):
    docs = read(spark, d, "documents")
    return docs.filter(P.contains(docs.df, "text", "the")).select("doc_id").df


@query("expr_contains_list", "SELECT vec_id FROM embeddings WHERE list_contains(list_transform(embedding, lambda x: x > 0.5), true)")
def expr_contains_list(spark, d):
    e = read(spark, d, "embeddings").set_value("big", F.transform("embedding", lambda x: x > F.lit(0.5)))
    return e.filter(P.contains(e.df, "big", True)).select("vec_id").df


_NULLED = "SELECT event_id, event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS u FROM events"


def nulled(spark, d) -> Dataset:
    return read(spark, d, "events").select("event_id", "event_type", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("u"))


@query("expr_null_logic", f"SELECT event_id FROM ({_NULLED}) WHERE u IS DISTINCT FROM 5 AND NOT coalesce(u < 20, false)")
def expr_null_logic(spark, d):
    return nulled(spark, d).filter(P.ne("u", 5) & P.negate(F.col("u") < 20)).select("event_id").df


@query("expr_is_none", f"SELECT event_id FROM ({_NULLED}) WHERE u IS NULL")
def expr_is_none(spark, d):
    return nulled(spark, d).filter(fn.is_none("u")).select("event_id").df


@query("expr_eq", f"SELECT event_id FROM ({_NULLED}) WHERE u = 7 OR event_type = 'click'")
def expr_eq(spark, d):
    return nulled(spark, d).filter(P.eq("u", 7) | P.eq("event_type", "click")).select("event_id").df


@query("expr_string", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 1000 AND o_orderstatus = 'O') OR o_custkey < 10")
def expr_string(spark, d):
    return read(spark, d, "orders").filter("(o_totalprice > 1000 AND o_orderstatus = 'O') OR o_custkey < 10").select("o_orderkey").df


@query("dnf_and_or", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR (c_nationkey IN (1, 2) AND c_name ILIKE '%1%')")
def dnf_and_or(spark, d):
    f = [[("c_mktsegment", "=", "BUILDING"), ("c_acctbal", ">", 0)], [("c_nationkey", "in", [1, 2]), ("c_name", "like", "%1%")]]
    return read(spark, d, "customer").filter(f).select("c_custkey").df


@query("dnf_null", f"SELECT event_id FROM ({_NULLED}) WHERE u <> 5 AND u NOT IN (6, 7)")
def dnf_null(spark, d):
    return nulled(spark, d).filter([("u", "!=", 5), ("u", "not in", [6, 7])]).select("event_id").df


@query("expr_string_like", f"SELECT event_id, event_type FROM ({_NULLED}) WHERE event_type ILIKE 'C%' AND (u IS NULL OR u < 50)")
def expr_string_like(spark, d):
    return nulled(spark, d).filter("event_type LIKE 'C%' AND (u IS NONE OR u < 50)").select("event_id", "event_type").df


@query("expr_string_matches", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-3]') AND contains(p_type, 'STEEL') AND p_name NOT ILIKE '%a%'")
def expr_string_matches(spark, d):
    return read(spark, d, "part").filter("p_brand MATCHES '#[1-3]' and p_type contains 'STEEL' and p_name not like '%A%'").select("p_partkey").df


@query("expr_string_null", f"SELECT event_id FROM ({_NULLED}) WHERE u IS DISTINCT FROM 5 AND NOT coalesce(u < 20, false) AND NOT coalesce(u IN (30, 31), false)")
def expr_string_null(spark, d):
    return nulled(spark, d).filter("u != 5 AND NOT u < 20 AND NOT u IN (30, 31)").select("event_id").df


@query("expr_not_between", f"SELECT event_id FROM ({_NULLED}) WHERE NOT coalesce(u BETWEEN 10 AND 60, false) AND NOT coalesce(event_type = 'click', false)")
def expr_not_between(spark, d):
    return nulled(spark, d).filter("u NOT BETWEEN 10 AND 60 AND NOT event_type = 'click'").select("event_id").df


@query("expr_not_precedence", f"SELECT event_id FROM ({_NULLED}) WHERE NOT coalesce(u BETWEEN 10 AND 60, false) AND u % 2 = 0 OR NOT coalesce(u + 5 > 2 * 30, false) AND event_type = 'view'")
def expr_not_precedence(spark, d):
    return nulled(spark, d).filter("NOT u BETWEEN 10 AND 60 AND u % 2 = 0 OR NOT u + 5 > 2 * 30 AND event_type = 'view'").select("event_id").df


@query("sql_case_not", f"SELECT event_type, sum(CASE WHEN NOT coalesce(u > 50, false) THEN 1 ELSE 0 END)::BIGINT AS low, count(*) FILTER (u IS DISTINCT FROM 7) AS other, sum(if(coalesce(u IN (1, 2), false), 0, 1))::BIGINT AS out FROM ({_NULLED}) GROUP BY event_type")
def sql_case_not(spark, d):
    q = "SELECT event_type, sum(CASE WHEN NOT u > 50 THEN 1 ELSE 0 END) AS low, count_if(NOT u = 7) AS other, sum(IF(u NOT IN (1, 2), 1, 0)) AS out FROM e GROUP BY event_type"
    return run_sql(spark, q, e=nulled(spark, d)).df


@query("sql_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per (k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM per WHERE n NOT BETWEEN 2 AND 3")
def sql_cte(spark, d):
    q = "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per (k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM per WHERE n NOT BETWEEN 2 AND 3"
    return run_sql(spark, q, orders=read(spark, d, "orders")).df


@query("sql_join_nulls", f"SELECT a.event_id AS x, c.c_name AS name FROM ({_NULLED}) a LEFT JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS k, c_name FROM customer) c ON a.u = c.k WHERE a.u IS DISTINCT FROM 10")
def sql_join_nulls(spark, d):
    """In ON a null meets nothing; in WHERE it is not 10."""
    customers = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("k"), "c_name")
    return run_sql(spark, "SELECT a.event_id AS x, c.c_name AS name FROM a LEFT JOIN c ON a.u = c.k WHERE a.u != 10", a=nulled(spark, d), c=customers).df


# scalar functions
@query(
    "fn_date_parts",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS dd, quarter(o_orderdate)::INTEGER AS q, hour(o_orderdate)::INTEGER AS h, minute(o_orderdate)::INTEGER AS mi, second(o_orderdate)::INTEGER AS s, week(o_orderdate)::INTEGER AS w, strftime(o_orderdate, '%Y-%m-%d') AS dt, strftime(o_orderdate, '%H:%M:%S') AS tm FROM orders",
)
def fn_date_parts(spark, d):
    o = "o_orderdate"
    parts = {"y": fn.year(o), "m": fn.month(o), "dd": fn.day(o), "q": fn.quarter(o), "h": fn.hour(o), "mi": fn.minute(o), "s": fn.second(o), "w": fn.week(o), "dt": fn.date(o).cast("string"), "tm": fn.time(o)}
    return read(spark, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in parts.items()]).df


@query("fn_iso_strings", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, strftime(o_orderdate, '%Y-%m-%d') AS dt FROM orders")
def fn_iso_strings(spark, d):
    o = read(spark, d, "orders").set_value("iso", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", fn.year("iso").alias("y"), fn.date("iso").cast("string").alias("dt")).df


@query("fn_add_days", "SELECT o_orderkey, o_orderdate + to_days((o_orderkey % 40)::INTEGER) AS later FROM orders")
def fn_add_days(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fn.add_days("o_orderdate", F.col("o_orderkey") % 40).alias("later")).df


@query("fn_days_diff", "SELECT o_orderkey, floor(epoch(TIMESTAMP '1996-03-01 05:00:00' - o_orderdate) / 86400)::BIGINT AS days FROM orders")
def fn_days_diff(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fn.days_diff("o_orderdate", F.lit("1996-03-01T05:00:00")).alias("days")).df


@query(
    "fn_strings",
    "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, trim('  ' || c_name || '  ') AS t, length(c_name)::INTEGER AS n, left(c_name, 4) AS lf, right(c_name, 3) AS rt, right(c_name, -2) AS rneg, substring(c_name, 3, 5) AS md, c_name || '/' || c_nationkey AS cc, left(c_mktsegment, greatest(length(c_mktsegment) - 3, 0)) AS lneg FROM customer",
)
def fn_strings(spark, d):
    c = {"u": fn.upper("c_name"), "l": fn.lower("c_mktsegment"), "t": fn.trim(F.concat(F.lit("  "), "c_name", F.lit("  "))), "n": fn.length("c_name"), "lf": fn.left("c_name", 4), "rt": fn.right("c_name", 3), "rneg": fn.right("c_name", -2), "md": fn.mid("c_name", 2, 5), "cc": fn.concat("c_name", F.lit("/"), "c_nationkey"), "lneg": fn.left("c_mktsegment", -3)}
    return read(spark, d, "customer").select("c_custkey", *[v.alias(k) for k, v in c.items()]).df


@query("fn_numbers", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS r, trunc(l_extendedprice)::BIGINT AS t, (l_quantity::VARCHAR)::DOUBLE AS dbl FROM lineitem")
def fn_numbers(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.round_(F.col("l_quantity") / 2).alias("r"), fn.trunc("l_extendedprice").alias("t"), fn.double(F.col("l_quantity").cast("string")).alias("dbl")).df


@query("fn_bool_hash", f"SELECT event_id, coalesce(upper(u::VARCHAR) <> 'FALSE', true) AS b, u IS NULL AS n, md5(event_type) AS m FROM ({_NULLED})")
def fn_bool_hash(spark, d):
    return nulled(spark, d).select("event_id", fn.boolean("u").alias("b"), fn.is_none("u").alias("n"), fn.md5("event_type").alias("m")).df


@query("fn_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def fn_between(spark, d):
    return read(spark, d, "lineitem").filter(fn.between("l_quantity", 10, 20)).select("l_orderkey", "l_linenumber").df


@query("fn_sort_array", "SELECT vec_id, list_sort(embedding)[1]::DOUBLE AS low, list_sort(embedding)[-1]::DOUBLE AS high FROM embeddings")
def fn_sort_array(spark, d):
    s = fn.sort("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.element_at(s, 1).cast("double").alias("low"), F.element_at(s, -1).cast("double").alias("high")).df


@query("fn_string_list", "SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def fn_string_list(spark, d):
    c = read(spark, d, "conversations").df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    c = c.withColumn("r", F.col("t.role"))
    return c.select("conv_id", fn.string("r", c.schema["r"].dataType).alias("roles"))


# dataset methods
@query("ds_group_aggregate", "SELECT sum(l_quantity) AS s, max(l_tax) AS mx, min(l_tax) AS mn, count(l_tax) AS n, round(avg(l_tax), 9) AS a, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
def ds_group_aggregate(spark, d):
    g = read(spark, d, "lineitem").group_by("l_returnflag", "l_linestatus").aggregate([("SUM", "l_quantity"), ("MAX", "l_tax"), ("MIN", "l_tax"), ("COUNT", "l_tax"), ("AVG", "l_tax")]).df
    return g.toDF("s", "mx", "mn", "n", "a", "l_returnflag", "l_linestatus").withColumn("a", F.round("a", 9))


@query("ds_groups", "SELECT DISTINCT event_type FROM events")
def ds_groups(spark, d):
    return read(spark, d, "events").group_by("event_type").groups().df


@query("ds_stats", "SELECT round(var_samp(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS mn, max(l_quantity) AS mx, round(avg(l_quantity), 6) AS a, sum(l_quantity) AS s FROM lineitem")
def ds_stats(spark, d):
    li, q = read(spark, d, "lineitem"), "l_quantity"
    least, most = li.min_max(q)
    row = [(li.variance(q), li.standard_deviation(q), least, most, li.mean(q), li.sum(q))]
    out = spark.createDataFrame(row, "v double, sd double, mn double, mx double, a double, s double")
    return out.withColumns({c: F.round(c, 6) for c in ("v", "sd", "a")})


@query("ds_distinct_on", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def ds_distinct_on(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").distinct("o_custkey").df


@query("ds_collect_set", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def ds_collect_set(spark, d):
    return read(spark, d, "events").collect_set("event_type").count().df


@query("ds_collected_max", "SELECT event_type, max(value) AS value FROM events GROUP BY event_type")
def ds_collected_max(spark, d):
    return read(spark, d, "events").collect_set("event_type").aggregate("value", max).df


@query("ds_histogram", "SELECT floor((p_size - lo) / ((1 + hi - lo) / 9.0::DOUBLE))::INTEGER AS bin, count(*) AS n FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) GROUP BY 1")
def ds_histogram(spark, d):
    return read(spark, d, "part").histogram("p_size", 10).df


@query("ds_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ds_top_k(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").sort_and_take("o_totalprice", 25, descending=True).df


@query("ds_missing_column", "SELECT o_orderkey, NULL::VARCHAR AS nothing FROM orders")
def ds_missing_column(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "nothing").df


@query("ds_set_value_flatten", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def ds_set_value_flatten(spark, d):
    e = read(spark, d, "events").set_value("p", F.from_json("props", "k bigint")).select("event_id", "p").flatten()
    return e.df.select("event_id", F.col("`p.k`").alias("k"))


@query("ds_flatten_group", "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n, max(event_id) AS most FROM events GROUP BY 1")
def ds_flatten_group(spark, d):
    """Flattened columns have dots in their names."""
    e = read(spark, d, "events").set_value("p", F.from_json("props", "k bigint")).select("event_id", "p").flatten()
    return e.group_by("p.k").aggregate([("COUNT", "*"), ("MAX", "event_id")]).df.toDF("n", "most", "k")


@query("ds_set_hash", "SELECT true AS any_order, true AS repeats_count, true AS values_count")
def ds_set_hash(spark, d):
    """Equal for the same rows in any order; different when rows are repeated or changed."""
    e = read(spark, d, "events").select("event_id", "event_type", "value")
    whole = e.set_hash()
    other = Dataset(e.df.select("value", "event_id", "event_type").orderBy(F.desc("value"), "event_id")).set_hash()
    twice = Dataset(e.df.union(e.df.limit(1)).union(e.df.limit(1))).set_hash()
    changed = e.set_value("value", F.when(F.col("event_id") == 7, -1.0).otherwise(F.col("value"))).set_hash()
    return spark.createDataFrame([(whole == other, whole != twice, whole != changed)], "any_order boolean, repeats_count boolean, values_count boolean")


@query(
    "ds_asof_join",
    "WITH r AS (SELECT user_id, ts, max(event_id) AS last_view FROM events WHERE event_type = 'view' GROUP BY user_id, ts)"
    " SELECT l.event_id, l.user_id, r.last_view, r.ts AS right_ts FROM (SELECT * FROM events WHERE event_type <> 'view') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
)
def ds_asof_join(spark, d):
    """To every other event of a user the last view before it."""
    events = read(spark, d, "events")
    views = events.filter("event_type = 'view'").select(F.col("event_id").alias("last_view"), "user_id", "ts")
    out = events.filter("event_type != 'view'").select("event_id", "user_id", "ts").asof_join(views, ["user_id"], "ts")
    return out.select("event_id", "user_id", "last_view", "right_ts").df


@query(
    "ds_interval_join",
    "SELECT v.event_id, p.event_id AS right_event_id, p.value AS right_value FROM events v JOIN events p ON v.user_id = p.user_id AND v.ts BETWEEN p.ts AND p.ts + to_hours(6)"
    " WHERE v.event_type = 'view' AND p.event_type = 'purchase'",
)
def ds_interval_join(spark, d):
    """Every view of a user within six hours after a purchase."""
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    bought = events.filter("event_type = 'purchase'").df.withColumn("till", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return views.interval_join(Dataset(bought), ["user_id"], ("ts", "ts"), ("ts", "till")).select("event_id", "right_event_id", "value").df.withColumnRenamed("value", "right_value")


@query("agg_sketch_merge", "SELECT o_orderpriority, count(*) AS n, true AS customers_near, true AS median_near FROM orders GROUP BY o_orderpriority")
def agg_sketch_merge(spark, d):
    """Two frames' sketches, stored and united, are held against exact counts and ranks."""
    root, orders = scratch_path(spark, "sketches"), read(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderdate")
    for day, part in (("2024-02-03", "o_orderdate < '1995-01-01'"), ("2024-02-04", "NOT o_orderdate < '1995-01-01'")):
        frame = orders.filter(part).sketch(["o_orderpriority", "o_orderstatus"], distinct=["o_custkey"], ranks=["o_totalprice"])
        writers.write_batch(frame.df, root, day, always_complete=True)
    united = reader(spark, root, start_date="2024-02-03", end_date="2024-02-04").unite_sketches(["o_orderpriority"]).df
    told = united.select("o_orderpriority", F.col("rows").alias("n"), sketches.n_distinct("o_custkey").alias("customers"), sketches.quantile("o_totalprice", 0.5).alias("median"))
    exact = orders.df.join(told, "o_orderpriority")
    below = F.avg((F.col("o_totalprice") <= F.col("median")).cast("int"))
    return exact.groupBy("o_orderpriority", "n").agg(
        (F.abs(F.countDistinct("o_custkey") - F.max("customers")) <= 0.07 * F.countDistinct("o_custkey")).alias("customers_near"),
        (F.abs(below - 0.5) < F.greatest(F.lit(0.02), 1 / F.count("*"))).alias("median_near"),
    )


@query("ds_rename", "SELECT r_regionkey AS id, r_name AS name FROM region")
def ds_rename(spark, d):
    return read(spark, d, "region").select("r_regionkey", "r_name").rename({"r_regionkey": "id", "r_name": "name"}).df


@query("stream_fanout", "SELECT event_id, 'out/' || event_type || '/' || unnest([1, 2]) AS path FROM events")
def stream_fanout(spark, d):
    e = read(spark, d, "events").df.withColumn("copies", F.array(F.lit(1), F.lit(2), F.lit(2)))
    return routed(e, "out/{event_type}/{copies}").select("event_id", F.col("_path").alias("path"))


# sources and sinks: written by a sink, read back by the reader
DAY = "2024-02-03"


@query("writer_roundtrip", "SELECT c_custkey, c_name, f AS format FROM customer, (VALUES ('parquet'), ('jsonl'), ('zstd'), ('lzma'), ('flat')) AS t(f)")
def writer_roundtrip(spark, d):
    out, customer = None, read(spark, d, "customer").df
    for format in ("parquet", "jsonl", "zstd", "lzma", "flat"):
        root = scratch_path(spark, "roundtrip")
        writers.write_batch(customer, root, DAY, format=format)
        back = reader(spark, root, start_date=DAY, select=["c_custkey", "c_name"]).df.withColumn("format", F.lit(format))
        out = back if out is None else out.unionByName(back)
    return out


@query("writer_rollover", "SELECT f AS format, count(*) AS n, true AS bounded, true AS full FROM orders, (VALUES ('jsonl'), ('zstd'), ('flat'), ('lzma')) AS t(f) GROUP BY f")
def writer_rollover(spark, d):
    """Rows of very different lengths in files cut by bytes: none is beyond the bound, and all but a
    task's last are within a fifth of it."""
    out, most = None, 1 << 16
    orders = read(spark, d, "orders").df.withColumn("note", F.expr("repeat('x', CASE WHEN o_orderkey % 50 = 0 THEN 4000 ELSE 10 END)"))
    for format in ("jsonl", "zstd", "flat", "lzma"):
        root = scratch_path(spark, "rollover")
        made = direct.write(orders, root, format, file_bytes=most)
        direct.commit(spark, root, made)
        last = {m.name.split("-")[1]: m for m in sorted(made, key=lambda m: m.name)}
        bounded, full = all(m.bytes <= most for m in made), all(m.bytes >= 0.8 * most for m in made if m not in last.values())
        back = reader(spark, root, raw_path=True, select=["o_orderkey"]).df.agg(F.count("*").alias("n"))
        back = back.select(F.lit(format).alias("format"), "n", F.lit(bounded).alias("bounded"), F.lit(full).alias("full"))
        out = back if out is None else out.unionByName(back)
    return out


@query("catalog_frames", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def catalog_frames(spark, d):
    """The newest frame that is complete and not ignored."""
    root, orders = scratch_path(spark, "frames"), read(spark, d, "orders").df
    frame = lambda name, status: writers.write_batch(orders.where(F.col("o_orderstatus") == status), root, DAY, frame_id=f"as_at_{name}", always_complete=True)
    frame("1", "O")
    frame("2", "F")
    storage.touch(spark, f"{frame('3', 'P')}/frame.ignore")
    storage.delete(spark, f"{frame('4', 'O')}/frame.complete")
    return reader(spark, root, start_date=DAY, select=["o_orderkey", "o_totalprice"]).df


@query("catalog_partition_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def catalog_partition_filter(spark, d):
    root = scratch_path(spark, "partitions")
    writers.write_batch(read(spark, d, "customer").df, root, DAY, partition_by=["c_mktsegment", "c_nationkey"])
    return reader(spark, root, start_date=DAY, partition_filter=("c_mktsegment", "==", "BUILDING"), filters="c_acctbal > 0", select=["c_custkey", "c_acctbal"]).df


@query("catalog_freshness", "SELECT r_regionkey, r_name FROM region")
def catalog_freshness(spark, d):
    root = scratch_path(spark, "freshness")
    writers.write_batch(read(spark, d, "region").df, root, DAY)
    return reader(spark, root, start_date="2024-02-06", freshness_limit="3d").df


@query("catalog_csv_headers", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def catalog_csv_headers(spark, d):
    """CSV files with columns of another order and number, each read by its own header."""
    root, c = scratch_path(spark, "headers"), read(spark, d, "customer").df
    for i, names in enumerate((("c_name", "c_custkey"), ("c_custkey", "c_mktsegment"), ("c_mktsegment", "c_custkey"))):
        c.where(F.col("c_custkey") % 3 == i).select(*names).write.csv(f"{root}/{i}", header=True)
    return reader(spark, root, raw_path=True, select=["c_custkey", "c_name", "c_mktsegment"]).df


@query("catalog_schema_union", "SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::VARCHAR AS o_custkey, CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 <> 2 THEN o_totalprice END AS o_totalprice FROM orders")
def catalog_schema_union(spark, d):
    """Parquet, ORC, JSON lines and CSV files whose columns differ in number and type."""
    root, o = scratch_path(spark, "evolving"), read(spark, d, "orders").df
    part = lambda i, *c: o.where(F.col("o_orderkey") % 4 == i).select(*c)
    key, customer = F.col("o_orderkey").cast("int").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey")
    part(0, key, "o_custkey", "o_totalprice").write.parquet(f"{root}/0")
    part(1, F.col("o_orderkey").cast("bigint"), "o_orderstatus", customer, "o_totalprice").write.parquet(f"{root}/1")
    part(2, key, customer).write.orc(f"{root}/2")
    part(3, "o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice").write.json(f"{root}/3")
    return reader(spark, root, raw_path=True, select=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]).df


@query("catalog_bad_blob", "SELECT o_orderkey, 1::BIGINT AS n_bad FROM orders WHERE o_orderkey % 10 <> 4")
def catalog_bad_blob(spark, d):
    """Ten folders of archives, one of which holds no archive: the rest is read, and one is counted."""
    root = scratch_path(spark, "blobs")
    orders = read(spark, d, "orders").df.select("o_orderkey", (F.col("o_orderkey") % 10).alias("part"))
    writers.write_routed(orders.withColumn("_path", F.concat(F.lit("part-"), "part")).drop("part").repartition(4, "_path"), root, "zstd")
    storage.delete(spark, f"{root}/part-4")
    spark.createDataFrame([("no archive",)], "value string").coalesce(1).write.text(f"{root}/broken")
    for f in storage.files(spark, f"{root}/broken"):
        if f.endswith(".txt"):
            storage.move(spark, f, f"{root}/part-4/blob.zstd")
    lost = formats.Rejects()
    out = reader(spark, root, raw_path=True, rejects=lost, schema=T.StructType.fromDDL("o_orderkey bigint")).df
    out.count()
    return out.withColumn("n_bad", F.lit(lost.count()).cast("bigint"))


@query("cursor_resume", "SELECT o_orderkey, o_custkey, 1 AS times FROM orders")
def cursor_resume(spark, d):
    """Reads that stop within files and go on from their cursors: every row, once."""
    root = scratch_path(spark, "cursor")
    writers.write_batch(read(spark, d, "orders").df.select("o_orderkey", "o_custkey").repartition(5), root, DAY, format="jsonl")
    kind = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint")
    start = lambda cursor: reader(spark, root, start_date=DAY, cursor=cursor, schema=kind)
    out, cursor = None, {}
    for rows in (7, 4_000, 1, None):
        part = start(cursor)
        batch = part.batch(rows)
        cursor = part.cursor
        if batch is not None:
            out = batch.df if out is None else out.unionByName(batch.df)
    return out.groupBy("o_orderkey", "o_custkey").agg(F.count("*").cast("int").alias("times"))


@query(
    "writer_expectations",
    "SELECT * FROM (SELECT 'rows' AS what, count(*) AS n FROM orders UNION ALL SELECT 'price', count(*) FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 200000"
    " UNION ALL SELECT 'status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'kept', count(*) FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O')"
    " UNION ALL SELECT 'both', count(*) FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus NOT IN ('F', 'O'))",
)
def writer_expectations(spark, d):
    """Rows that fail an expectation are counted and set aside, the others written."""
    root, report = scratch_path(spark, "expectations"), Report()
    rules = [
        {"expectation": "expect_column_values_to_be_between", "column": "o_totalprice", "minimum": 1000, "maximum": 200_000},
        {"expectation": "expect_column_values_to_be_in_set", "column": "o_orderstatus", "symbols": ["F", "O"]},
    ]
    writers.write_batch(read(spark, d, "orders").df, root, DAY, expectations=rules, report=report)
    counts = report.counts()
    kept = reader(spark, root, start_date=DAY).df.agg(F.lit("kept").alias("what"), F.count("*").alias("n"))
    bad = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/BACKOUT")
    both = bad.where(F.size("_failed") == 2).agg(F.lit("both").alias("what"), F.count("*").alias("n"))
    seen = [("rows", counts["rows"]), ("price", counts[label(rules[0])]), ("status", counts[label(rules[1])])]
    return spark.createDataFrame(seen, "what string, n long").unionByName(kept).unionByName(both)


@query("sql_dataset_path", "SELECT upper(left(l_shipmode, 3)) AS mode, count(*) AS n, max(l_quantity) AS most FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) WHERE l_linestatus <> 'F' AND l_returnflag ILIKE 'n' GROUP BY 1")
def sql_dataset_path(spark, d):
    """FROM names a dated dataset below a root."""
    root = scratch_path(spark, "datasets")
    writers.write_batch(read(spark, d, "lineitem").df.withColumn("l_shipmode", F.concat("l_returnflag", "l_linestatus")), f"{root}/sales/lines", DAY)
    return run_sql(spark, "SELECT UPPER(LEFT(l_shipmode, 3)) AS mode, COUNT(*) AS n, MAX(l_quantity) AS most FROM sales.lines WHERE l_linestatus != 'F' AND l_returnflag LIKE 'n' GROUP BY UPPER(LEFT(l_shipmode, 3))", root=root, reader_options={"start_date": DAY}).df


@query("sql_labels", 'SELECT left(c_mktsegment, 2) AS "LEFT(c_mktsegment,2)", substring(c_name, 2, 4) AS "MID(c_name,1,4)", c_custkey FROM customer')
def sql_labels(spark, d):
    return run_sql(spark, "SELECT LEFT(c_mktsegment, 2), mid(c_name, 1, 4), c_custkey FROM customer", customer=read(spark, d, "customer")).df


@query(
    "fn_sql_names",
    "SELECT o_orderkey, week(o_orderdate)::INTEGER AS w, strftime(o_orderdate, '%H:%M:%S') AS t, o_orderdate + to_days(3) AS later, right(o_orderpriority, 3) AS r, left(o_orderpriority, -2) AS l, trunc(o_totalprice)::BIGINT AS n, o_totalprice > 1000 AND o_totalprice < 90000 AS b, md5(o_orderstatus) AS m FROM orders",
)
def fn_sql_names(spark, d):
    q = "SELECT o_orderkey, WEEK(o_orderdate) AS w, TIME(o_orderdate) AS t, ADDDAYS(o_orderdate, 3) AS later, RIGHT(o_orderpriority, 3) AS r, LEFT(o_orderpriority, -2) AS l, INTEGER(o_totalprice) AS n, BETWEEN(o_totalprice, 1000, 90000) AS b, MD5(o_orderstatus) AS m FROM orders"
    return run_sql(spark, q, orders=read(spark, d, "orders")).df


@query("stream_batches", "SELECT event_id, event_type FROM events")
def stream_batches(spark, d):
    """Three micro-batches of a stream, routed by type, seen together by the reader."""
    source, root = scratch_path(spark, "source"), scratch_path(spark, "sink")
    events = read(spark, d, "events").df.select("event_id", "event_type")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink.start(stream, f"{root}/{{date}}/{{event_type}}", scratch_path(spark, "marks"), clock=lambda: datetime.datetime(2024, 2, 3)).awaitTermination()
    return reader(spark, root, start_date=DAY, template="{date}", select=["event_id", "event_type"]).df


#: Events in four batches by their number, but for some that come with the last one, days late.
_BATCHES = """e AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 3 ELSE least(3, event_id * 4 // (SELECT count(*) FROM events)) END AS b FROM events),
marks AS (SELECT b, (SELECT max(ts) FROM e AS x WHERE x.b < y.b) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT b FROM e) AS y),
last AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e)"""


def _streamed(spark, d, windows: event_windows.EventWindows):
    """(closed windows, open ones, late rows) of the events as a stream of four batches."""
    source, root, marks = (scratch_path(spark, x) for x in ("events", "windows", "marks"))
    events = read(spark, d, "events").df
    n = max(events.count(), 1)
    number = F.when(F.col("event_id") % 97 == 0, 3).otherwise(F.least(F.lit(3), F.floor(F.col("event_id") * 4 / n)))
    rows = events.select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), number.alias("b"))
    for b in range(4):
        rows.where(F.col("b") == b).drop("b").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.drop("b").schema).parquet(source)
        event_windows.start(stream, windows, f"{root}/{{date}}", marks, clock=lambda: datetime.datetime(2024, 2, 3), format="parquet").awaitTermination()
    still = event_windows.open_windows(spark, windows, marks)
    files = storage.files(spark, root)
    day = [f for f in files if "/2024-02-03/" in f and f.endswith(".parquet")]
    aside = [f for f in files if "/BACKOUT/" in f and f.endswith(".parquet")]
    given = spark.read.schema(still.schema).parquet(*day) if day else still.limit(0)
    return given, still, spark.read.parquet(*aside) if aside else rows.drop("b").limit(0)


def _all_windows(given: DataFrame, still: DataFrame) -> DataFrame:
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    both = given.withColumn("is_open", F.lit(False)).unionByName(still.withColumn("is_open", F.lit(True)))
    return both.withColumns({c: when(c) for c in ("window_start", "window_end")})


@query(
    "stream_windows",
    f"""WITH {_BATCHES}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS over FROM e JOIN marks USING (b))
SELECT event_type, strftime(over - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(over, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, max(user_id) AS most, over > (SELECT mark FROM last) AS is_open
FROM w WHERE mark IS NULL OR over > mark GROUP BY event_type, over""",
)
def stream_windows(spark, d):
    """Windows of six hours with an hour's delay: given out once closed, or still open at the end."""
    aggs = {"n": ("count", None), "cents": ("sum", "cents"), "most": ("max", "user_id")}
    given, still, _ = _streamed(spark, d, event_windows.EventWindows("ts", ["event_type"], aggs, length=datetime.timedelta(hours=6), delay=datetime.timedelta(hours=1)))
    return _all_windows(given, still)


@query(
    "stream_sessions",
    f"""WITH {_BATCHES}, k AS (SELECT * FROM e JOIN marks USING (b) WHERE mark IS NULL OR ts >= mark),
c AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR)::INT, 1) AS opens FROM k),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM c)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, max(ts) + INTERVAL 2 HOUR >= (SELECT mark FROM last) AS is_open FROM s GROUP BY user_id, session""",
)
def stream_sessions(spark, d):
    """Sessions of users over the batches of a stream: rows not more than two hours apart."""
    aggs = {"n": ("count", None), "cents": ("sum", "cents")}
    given, still, _ = _streamed(spark, d, event_windows.EventWindows("ts", ["user_id"], aggs, gap=datetime.timedelta(hours=2), delay=datetime.timedelta(hours=1)))
    return _all_windows(given, still)


@query("stream_late", f"WITH {_BATCHES} SELECT event_id, event_type FROM e JOIN marks USING (b) WHERE time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= mark")
def stream_late(spark, d):
    """The rows that came after their windows were closed."""
    windows = event_windows.EventWindows("ts", ["event_type"], {"n": ("count", None)}, length=datetime.timedelta(hours=6), delay=datetime.timedelta(hours=1))
    return _streamed(spark, d, windows)[2].select("event_id", "event_type")


@query("ds_items", "SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1)::BIGINT AS place FROM orders QUALIFY place IN (0, 7, 1000)")
def ds_items(spark, d):
    places = (0, 7, 1000)
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey").get_items(*places, order=["o_custkey", "o_orderkey"])
    return spark.createDataFrame([(r["o_orderkey"], r["o_custkey"], p) for r, p in zip(rows, places)], "o_orderkey long, o_custkey long, place long")


@query("ds_sample", "SELECT true AS near")
def ds_sample(spark, d):
    """A third of the rows, give or take a tenth."""
    orders = read(spark, d, "orders")
    n = orders.count()
    return spark.createDataFrame([(abs(orders.sample(1 / 3, seed=1).count() - n / 3) < n / 10,)], "near boolean")


@query("ds_collected_function", "SELECT event_type, max(value) - min(value) AS value FROM events GROUP BY event_type")
def ds_collected_function(spark, d):
    """A Python function over parts of each key's values, and one that merges the parts."""
    spread = read(spark, d, "events").collect_set("event_type").aggregate("value", lambda v: [min(v), max(v)], returns="array<double>", merge=lambda parts: [min(p[0] for p in parts), max(p[1] for p in parts)])
    return spread.df.select("event_type", (F.col("value")[1] - F.col("value")[0]).alias("value"))
