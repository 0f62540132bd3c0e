"""Relational and event queries: joins, grouping sets, windows, set operations, as-of join, sessions, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.operators import index
from papyrine.scratch import new_path
from papyrine.streaming import intake
from papyrine.tables import table


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"))
    )


def shipping_priority(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))
    out = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey, "left_semi").groupBy("o_orderkey", "o_orderdate", "o_orderpriority")
    return out.agg(F.round(F.sum("p"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def local_supplier_volume(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))
    j = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum("p"), 2).alias("revenue"))


def revenue_change(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_discount between 0.05 and 0.07 and l_quantity < 24")
    return x.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


def part_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"))


def customer_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("place", F.row_number().over(w)).where("place <= 3").select("c_nationkey", "c_custkey", "c_acctbal", "place")


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def customers_without_urgent_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


def nation_set_ops(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    both = c.intersect(s).withColumn("side", F.lit("both"))
    return both.unionByName(c.subtract(s).withColumn("side", F.lit("customers"))).unionByName(s.subtract(c).withColumn("side", F.lit("suppliers")))


def events_asof(spark: SparkSession, d: str) -> DataFrame:
    """For every purchase the user's last view before it, by one window over both kinds instead of a range join."""
    e = table(spark, d, "events").where("event_type in ('view', 'purchase')").select("user_id", "event_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", last).where("event_type = 'purchase'").select("event_id", "user_id", "view_id")


def events_windows(spark: SparkSession, d: str) -> DataFrame:
    out = intake.counts_by_window(table(spark, d, "events"), size="1 hour")
    return out.select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return intake.sessions(table(spark, d, "events"), gap="30 minutes")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows counted on a stream, whose last state is written as a table."""
    source = table(spark, d, "events")
    path = new_path(spark, "windows")
    stream = intake.table_stream(spark, f"{d}/event[s].parquet", source.schema).withColumn("ts", F.col("ts").cast("timestamp"))

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state")

    counted = intake.counts_by_window(stream)
    counted.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/state").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions closed on a stream: those that the watermark has passed, each once."""
    source = table(spark, d, "events")
    path = new_path(spark, "sessions")
    stream = intake.table_stream(spark, f"{d}/event[s].parquet", source.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = intake.sessions(stream)
    closed.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/closed", format="parquet").awaitTermination()
    out = spark.read.schema(closed.schema).parquet(f"{path}/closed")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


def stream_latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks taken in as a stream into a keyed collection, each batch once, the last row per id kept."""
    source = table(spark, d, "chunks")
    path = new_path(spark, "stream")
    stream = intake.table_stream(spark, f"{d}/chunk[s].parquet", source.schema, files_per_batch=64)
    found = index.Collection(spark, path, "latest", dim=0, key="chunk_id")

    def each(batch: DataFrame, _: int) -> None:
        found.create()
        rows = batch.where("chunk_id is not null").select("chunk_id", "row_id", "created_at")
        old = found.points()
        rows = rows if old is None else rows.unionByName(index.only_existing(old, rows, "chunk_id"))
        found.upsert(rows, force=True, order=("created_at", "row_id"))

    intake.run_available(stream, f"{path}/checkpoint", each).awaitTermination()
    return found.points().select("chunk_id", "row_id")


_P = "l_extendedprice * (1 - l_discount)"
ORACLES = {
    "pricing_summary": f"select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum({_P}), 2) sum_price, round(avg(l_discount), 4) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "shipping_priority": f"select o_orderkey, o_orderdate, o_orderpriority, round(sum({_P}), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1, 2, 3 order by revenue desc, o_orderkey limit 10",
    "local_supplier_volume": f"select r_name, n_name, round(sum({_P}), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "revenue_change": "select round(sum(l_extendedprice * l_discount), 2) revenue from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24",
    "order_rollup": "select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total, grouping_id(o_orderstatus, o_orderpriority)::INT level from orders group by rollup (o_orderstatus, o_orderpriority)",
    "part_cube": "select p_brand, p_size, count(*) n from part group by cube (p_brand, p_size)",
    "customer_rank": "select c_nationkey, c_custkey, c_acctbal, place::INT place from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) place from customer) where place <= 3",
    "status_pivot": "select o_orderpriority, nullif(count(*) filter (o_orderstatus = 'F'), 0) \"F\", nullif(count(*) filter (o_orderstatus = 'O'), 0) \"O\", nullif(count(*) filter (o_orderstatus = 'P'), 0) \"P\" from orders group by 1",
    "customers_without_urgent_orders": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "nation_set_ops": "with c as (select distinct c_nationkey k from customer where c_acctbal > 9000), s as (select distinct s_nationkey k from supplier where s_acctbal > 5000) select k, case when k in (select k from c) and k in (select k from s) then 'both' when k in (select k from c) then 'customers' else 'suppliers' end side from (select k from c union select k from s)",
    "events_asof": "select event_id, user_id, view_id from (select event_id, user_id, event_type, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, case when event_type = 'view' then 0 else 1 end, event_id rows between unbounded preceding and 1 preceding) view_id from events where event_type in ('view', 'purchase')) where event_type = 'purchase'",
    "events_windows": "select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2",
    "events_sessions": "select user_id, min(ts) session_start, max(ts) + interval 30 minutes session_end, count(*) n from (select *, sum(new) over (partition by user_id order by ts, event_id) s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end new from events)) group by user_id, s",
    "event_props": "select key, count(*) n from (select unnest(json_keys(props)) key from events) group by 1",
    "stream_windows": "select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2",
    "stream_sessions": "select * from (select user_id, min(ts) session_start, max(ts) + interval 30 minutes session_end, count(*) n from (select *, sum(new) over (partition by user_id order by ts, event_id) s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end new from events)) group by user_id, s) where session_end <= (select max(ts) - interval 10 minutes from events)",
    "stream_latest_chunks": "select chunk_id, row_id from (select chunk_id, row_id, row_number() over (partition by chunk_id order by created_at desc nulls last, row_id desc) n from chunks where chunk_id is not null) where n = 1",
}

QUERIES = {
    f.__name__: f
    for f in (
        pricing_summary, shipping_priority, local_supplier_volume, revenue_change, order_rollup, part_cube, customer_rank, status_pivot,
        customers_without_urgent_orders, nation_set_ops, events_asof, events_windows, events_sessions, event_props, stream_windows, stream_sessions, stream_latest_chunks,
    )
}
