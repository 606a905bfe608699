"""Scans, sinks, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.operators import rows
from sigmill.registry import query
from sigmill.sources.tables import AS_OF, items, signals, sql, table


@query("s01_scan_newest_first", sql("select id, source, cents, trend_id, row_number() over (order by created_at desc, id) as place from sig qualify place <= 1000"))
def s01(spark, d):
    from pyspark.sql import Window as W

    s = rows.top_k(signals(spark, d), 1000, F.desc("created_at"), F.asc("id"))
    return s.select("id", "source", "cents", "trend_id", F.row_number().over(W.orderBy(F.desc("created_at"), "id")).cast("long").alias("place"))


@query("s02_recent_window_scan", sql(f"select id, source, trend_id from sig where created_at >= timestamp '{AS_OF}' - interval 3 day and created_at < timestamp '{AS_OF}'"))
def s02(spark, d):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return signals(spark, d).filter((F.col("created_at") >= at - F.expr("INTERVAL 3 DAYS")) & (F.col("created_at") < at)).select("id", "source", "trend_id")


@query("s03_latest_snapshot", sql("select trend_id, day::varchar as day, n from items qualify row_number() over (partition by trend_id order by day desc) = 1"))
def s03(spark, d):
    return rows.latest(items(spark, d), "day", ["trend_id"]).select("trend_id", F.col("day").cast("string").alias("day"), "n")


@query("s04_last_n_snapshots", sql("select day::varchar as day, sum(n)::bigint as n from items group by day order by items.day desc limit 5"))
def s04(spark, d):
    return items(spark, d).groupBy("day").agg(F.sum("n").alias("n")).orderBy(F.desc("day")).limit(5).select(F.col("day").cast("string").alias("day"), "n")


@query("s05_head_count", sql("select count(*) as n from sig"))
def s05(spark, d):
    return signals(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("s14_source_rollup", sql("select trend_id, greatest(1, sum(comments) // 100)::bigint as score, count(*) as streams, arg_min(source, id) as tag from sig group by trend_id"))
def s14(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.greatest(F.lit(1), F.floor(F.sum("comments") / 100)).alias("score"), F.count(F.lit(1)).alias("streams"), F.min_by("source", "id").alias("tag"))


@query("s17_json_column", "select event_id as id, coalesce(json_extract_string(props, '$.k')::int, 0) as k, coalesce(json_extract_string(props, '$.absent'), 'none') as absent from events")
def s17(spark, d):
    p = F.from_json("props", "k int, absent string")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce(p["k"], F.lit(0)).alias("k"), F.coalesce(p["absent"], F.lit("none")).alias("absent"))


APPENDED = sql("select id, source from sig where id % 3 = 0 union all select id, source from sig where id % 3 <> 0")


@query("k02_append_skip_duplicates", APPENDED)
@query("k02_append_skip_duplicates_all", APPENDED)
def k02(spark, d):
    s = signals(spark, d).select("id", "source")
    return rows.append_new(s.filter("id % 3 = 0"), s.filter("id % 3 <> 0 or id % 2 = 0"), ["id"])


UPSERTED = sql("select id, case when id % 3 <> 0 or id % 2 = 0 then cents + 1 else cents end as cents from sig")


@query("k03_upsert", UPSERTED)
@query("k03_upsert_all", UPSERTED)
def k03(spark, d):
    s = signals(spark, d).select("id", "cents")
    return rows.upsert(s.filter("id % 3 = 0"), s.filter("id % 3 <> 0 or id % 2 = 0").withColumn("cents", F.col("cents") + 1), ["id"])


@query("k06_update_by_key", sql("select s.id, s.trend_id, case when s.id % 5 = 0 then 'updated' else s.source end as source from sig s"))
def k06(spark, d):
    s = signals(spark, d).select("id", "trend_id", "source")
    return rows.update_by_key(s, s.filter("id % 5 = 0").select("id", F.lit("updated").alias("source")), ["id"])


@query("k07_delete_by_predicate", sql("select id from sig where not (source = 'error' and comments < 50)"))
def k07(spark, d):
    return signals(spark, d).filter(~((F.col("source") == "error") & (F.col("comments") < 50))).select("id")


@query("k08_counter_by_aggregation", "select conv_id, count(*) as messages from conversations group by conv_id")
def k08(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


@query("k09_history_versions", sql("select trend_id, day::varchar as day, n, lag(n) over w as old_value, row_number() over w as version, lead(day) over w is null as is_current from items window w as (partition by trend_id order by day)"))
def k09(spark, d):
    return rows.with_history(items(spark, d).select("trend_id", "day", "n"), "trend_id", "day", "n").withColumns({"day": F.col("day").cast("string"), "version": F.col("version").cast("long")})


@query("k11_gate_log", sql("""select trend_id, gate, passed from (select trend_id, unnest(['persistence', 'artifacts', 'demand']) as gate, unnest([1, 2, 3]) as k,
  unnest([days >= 2, ids >= 10, demand >= 3]) as passed, case when days < 2 then 1 when ids < 10 then 2 else 3 end as last
  from (select trend_id, count(*) as days, sum(n) as ids, sum(demand) as demand from items group by trend_id)) where k <= last"""))
def k11(spark, d):
    t = items(spark, d).groupBy("trend_id").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("ids"), F.sum("demand").alias("demand"))
    gates = [("persistence", F.col("days") >= 2), ("artifacts", F.col("ids") >= 10), ("demand", F.col("demand") >= 3)]
    last = F.when(F.col("days") < 2, 1).when(F.col("ids") < 10, 2).otherwise(3)
    g = F.explode(F.slice(F.array(*[F.struct(F.lit(n).alias("gate"), p.alias("passed")) for n, p in gates]), F.lit(1), last))
    return t.select("trend_id", g.alias("g")).select("trend_id", "g.gate", "g.passed")


@query("p02_in_list_as_semi_join", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def p02(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("p04_exclusion_set", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def p04(spark, d):
    gone = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(gone, "p_partkey", "left_anti").select("p_partkey")


@query("p06_substring_search", sql("select id, title from sig where lower(title) like '%database%' or lower(title) like '%api%'"))
def p06(spark, d):
    t = F.lower("title")
    return signals(spark, d).filter(t.contains("database") | t.contains("api")).select("id", "title")


@query("p08_age_filter_keeping_unknown", sql("select id from (select id, case when id % 7 = 0 then null else created_at end as seen from sig) where seen is null or seen >= timestamp '2024-01-24'"))
def p08(spark, d):
    s = signals(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("created_at")).alias("seen"))
    return s.filter(F.col("seen").isNull() | (F.col("seen") >= F.lit("2024-01-24").cast("timestamp_ntz"))).select("id")


@query("p09_threshold_with_fallback", sql("select id, trend_id from sig qualify comments >= 95 or max((comments >= 95)::int) over (partition by trend_id) = 0"))
def p09(spark, d):
    return rows.filter_or_all(signals(spark, d), F.col("comments") >= 95, ["trend_id"]).select("id", "trend_id")


@query("p11_display_name", sql("""select id, coalesce(case when length(trim(title)) > 25 and title not like 'Ask%' then trim(title) end,
  case when source not in ('view', 'click') then source end, 'Signal #' || substr(id::varchar, 1, 6)) as name from sig"""))
def p11(spark, d):
    t = F.trim("title")
    name = F.coalesce(F.when((F.length(t) > 25) & ~F.col("title").startswith("Ask"), t), F.when(~F.col("source").isin("view", "click"), F.col("source")), F.concat(F.lit("Signal #"), F.substring(F.col("id").cast("string"), 1, 6)))
    return signals(spark, d).select("id", name.alias("name"))


@query("t01_top_k", sql("select trend_id, n from (select trend_id, sum(n)::bigint as n from items group by 1) order by n desc, trend_id limit 30"))
def t01(spark, d):
    return rows.top_k(items(spark, d).groupBy("trend_id").agg(F.sum("n").alias("n")), 30, F.desc("n"), F.asc("trend_id"))


@query("t03_top_k_per_group", sql("select trend_id, id, cents from sig qualify row_number() over (partition by trend_id order by cents desc, id) <= 5"))
def t03(spark, d):
    return rows.top_k(signals(spark, d).select("trend_id", "id", "cents"), 5, F.desc("cents"), F.asc("id"), keys=["trend_id"])


@query("t04_offset_page", sql("select id from sig order by created_at desc, id limit 50 offset 200"))
def t04(spark, d):
    return rows.page(signals(spark, d), 200, 50, F.desc("created_at"), F.asc("id")).select("id")


@query("t06_custom_category_order", sql("select source, count(*) as n, list_position(['purchase', 'signup', 'view', 'click', 'error'], source)::int as place from sig group by source"))
def t06(spark, d):
    order = F.array(*[F.lit(x) for x in ("purchase", "signup", "view", "click", "error")])
    return signals(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.array_position(order, F.col("source")).cast("int")).orderBy("place")


@query("t07_post_filter_limit", sql("select trend_id, n from (select trend_id, sum(n)::bigint as n from items group by 1 order by n desc, trend_id limit 20) where trend_id % 3 <> 0 order by n desc, trend_id limit 10"))
def t07(spark, d):
    return rows.top_k(t01(spark, d).orderBy(F.desc("n"), "trend_id").limit(20).filter("trend_id % 3 <> 0"), 10, F.desc("n"), F.asc("trend_id"))


@query("t08_capped_sorted_set", sql("select trend_id, array_to_string(list_sort(list(distinct comments))[1:5], ',') as ks from sig group by trend_id"))
def t08(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.slice(F.sort_array(F.collect_set("comments")), 1, 5).cast("array<string>").alias("k")).select("trend_id", F.array_join("k", ",").alias("ks"))


@query("u01_union_all", sql("select id, 'new' as kind from sig where created_at >= timestamp '2024-01-20' union all select id, 'large' from sig where cents > 20000"))
def u01(spark, d):
    s = signals(spark, d)
    return s.filter(F.col("created_at") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("id", F.lit("new").alias("kind")).unionByName(s.filter("cents > 20000").select("id", F.lit("large").alias("kind")))


@query("u02_array_sets", sql("""select trend_id, array_to_string(list_sort(list_intersect(a, b)), ',') as both_days, len(list_distinct(list_concat(a, b)))::int as n_any,
  array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as only_a from
  (select trend_id, coalesce(list(distinct source) filter (created_at < timestamp '2024-01-04'), []) as a, coalesce(list(distinct source) filter (created_at >= timestamp '2024-01-27'), []) as b from sig group by trend_id)"""))
def u02(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    s = signals(spark, d).groupBy("trend_id").agg(F.collect_set(F.when(F.col("created_at") < at("2024-01-04"), F.col("source"))).alias("a"), F.collect_set(F.when(F.col("created_at") >= at("2024-01-27"), F.col("source"))).alias("b"))
    return s.select("trend_id", F.array_join(F.sort_array(F.array_intersect("a", "b")), ",").alias("both_days"), F.size(F.array_union("a", "b")).alias("n_any"), F.array_join(F.sort_array(F.array_except("a", "b")), ",").alias("only_a"))


@query("u03_table_except", sql("select distinct trend_id from items where day = date '2024-01-30' except select trend_id from items where day = date '2024-01-29'"))
def u03(spark, d):
    i = items(spark, d)
    on = lambda x: i.filter(F.col("day") == F.lit(x).cast("date")).select("trend_id")
    return on("2024-01-30").exceptAll(on("2024-01-29")).distinct()


@query("u04_distinct_keep_first", sql("select title, trend_id, min(id) as id from sig group by title, trend_id"))
def u04(spark, d):
    return rows.top_k(signals(spark, d).select("title", "trend_id", "id"), 1, F.asc("id"), keys=["title", "trend_id"])


@query("u05_ordered_candidates", sql("""select id, array_to_string(list_filter([source, case when comments > 50 then 'popular' end, case when cents > 5000 then 'large' end, 'default'], lambda x: x is not null)[1:3], ',') as picks from sig"""))
def u05(spark, d):
    c = F.array_compact(F.array(F.col("source"), F.when(F.col("comments") > 50, "popular"), F.when(F.col("cents") > 5000, "large"), F.lit("default")))
    return signals(spark, d).select("id", F.array_join(F.slice(F.array_distinct(c), 1, 3), ",").alias("picks"))
