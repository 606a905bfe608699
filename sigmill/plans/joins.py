"""Joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import joins, rows, similar
from sigmill.registry import query
from sigmill.sources.tables import items, signals, sql, table


@query("j01_inner_equi", "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def j01(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("j02_left_with_defaults", "select c_custkey, coalesce(n, 0) as n, coalesce(status, 'none') as status from customer left join (select o_custkey, count(*) as n, max(o_orderstatus) as status from orders group by 1) on c_custkey = o_custkey")
def j02(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("status"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("status", F.lit("none")).alias("status"))


@query("j03_bridge_inner", "select o_custkey, p_brand, count(*) as n from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderpriority = '1-URGENT' group by 1, 2")
def j03(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").join(o, "l_orderkey").join(p, "l_partkey").groupBy("o_custkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("j04_left_anti", sql("select distinct trend_id from items where trend_id not in (select trend_id from items where day >= date '2024-01-29')"))
def j04(spark, d):
    i = items(spark, d)
    return i.join(i.filter(F.col("day") >= F.lit("2024-01-29").cast("date")).select("trend_id"), "trend_id", "left_anti").select("trend_id").distinct()


@query("j05_anti_ordered_limit", "select doc_id from documents left join labels using (doc_id) where labels.quality is null order by doc_id limit 100")
def j05(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(100).select("doc_id")


@query("j06_left_semi", "select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity >= 50)")
def j06(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(li, "s_suppkey", "left_semi").select("s_suppkey")


@query("j07_current_and_previous", sql("select trend_id, day::varchar as day, momentum, lag(momentum) over (partition by trend_id order by day) as prev_momentum from items"))
def j07(spark, d):
    return items(spark, d).select("trend_id", F.col("day").cast("string").alias("day"), "momentum", F.lag("momentum").over(W.partitionBy("trend_id").orderBy("day")).alias("prev_momentum"))


@query("j08_as_of_previous_snapshot", sql("""select trend_id, day::varchar as day, n, case when k - lag(k) over w <= 10 then lag(n) over w end as prev_n
  from (select *, day - date '2024-01-01' as k from items) window w as (partition by trend_id order by day)"""))
def j08(spark, d):
    i = items(spark, d).withColumn("k", F.date_diff("day", F.lit("2024-01-01").cast("date")))
    return joins.previous_state(i, "trend_id", "day", "k", ["n"], 10).select("trend_id", F.col("day").cast("string").alias("day"), "n", "prev_n")


@query("j09_nearest_in_time", sql("""select a.trend_id, a.day::varchar as day, a.n, arg_min(b.n, abs(b.day - (a.day - 7)) * 100 + (b.day - date '2024-01-01')) as near_7
  from items a left join items b on a.trend_id = b.trend_id and abs(b.day - (a.day - 7)) < 5 group by a.trend_id, a.day, a.n"""))
def j09(spark, d):
    return joins.nearest_in_time(items(spark, d).select("trend_id", "day", "n"), "trend_id", "day", "n", 7, 5).select("trend_id", F.col("day").cast("string").alias("day"), "n", "near_7")


@query("j10_title_similarity_pairs")
def j10(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return similar.title_pairs(t, "doc_id", "title", 0.9)


@query("j12_bigram_overlap_pairs", sql("""select a, b, count(*) as shared from (select x.title as a, y.title as b from
  (select distinct title, lower(w) as w from sig, unnest(string_split(title, ' ')) u(w)) x join (select distinct title, lower(w) as w from sig, unnest(string_split(title, ' ')) u(w)) y on x.w = y.w and x.title < y.title)
  group by a, b having count(*) >= 2"""))
def j12(spark, d):
    t = signals(spark, d).select("title").distinct().withColumn("w", F.split(F.lower("title"), " "))
    return joins.shared_token_pairs(t, "title", "w", 2)


@query("j12_name_bigram_pairs", """with n as (select distinct lower(p_name) as name from part), g as (select distinct name, w[i] || ' ' || w[i + 1] as g from (select name, w, unnest(range(1, len(w))) as i from (select name, string_split(name, ' ') as w from n)))
  select x.name as a, y.name as b, count(*) as shared from g x join g y on x.g = y.g and x.name < y.name group by 1, 2 having count(*) >= 2""")
def j12_names(spark, d):
    """Names of parts with two pairs of neighbouring words in common."""
    w = F.split("name", " ")
    two = F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, i: F.concat_ws(" ", F.element_at(w, i + 1), x))
    names = table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    return joins.shared_token_pairs(names.withColumn("g", two), "name", "g", 2)


NEAREST = """select query_id, vec_id, round(c, 6) as similarity from (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[])::double as c
  from embeddings e, embeddings q where q.vec_id % 100 = 0) where c >= 0.2 qualify row_number() over (partition by query_id order by c desc, vec_id) <= 10"""


@query("j13_vector_top_k", NEAREST)
@query("j13_vector_top_k_all", NEAREST)
def j13(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    best = joins.nearest_vectors(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, 0.2)
    return best.select("query_id", "vec_id", F.round("c", 6).alias("similarity"))


@query("j15_three_way_ordered", """select e.vec_id, l.quality, d.lang from embeddings e join documents d on d.doc_id = e.vec_id join labels l on l.doc_id = d.doc_id where e.label = 3""")
def j15(spark, d):
    e = table(spark, d, "embeddings").filter("label = 3").select(F.col("vec_id").alias("doc_id"))
    return e.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select(F.col("doc_id").alias("vec_id"), "quality", "lang")


@query("j16_star_join", """select o_orderkey, n_name, r_name, count(l_orderkey) as lines, max(p_brand) as brand from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey
  left join region on r_regionkey = n_regionkey left join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey where o_orderstatus = 'F' group by 1, 2, 3""")
def j16(spark, d):
    t = lambda n: table(spark, d, n)
    o = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    o = o.join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey", "left").join(geo, "c_nationkey", "left")
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), "l_orderkey").join(t("part").select("p_partkey", "p_brand"), "p_partkey", "left")
    return o.join(li, "o_orderkey", "left").groupBy("o_orderkey", "n_name", "r_name").agg(F.count("l_orderkey").alias("lines"), F.max("p_brand").alias("brand"))


@query("j17_recent_suppression", sql("""select id from (select id, trend_id, source, created_at, lag(created_at) over (partition by trend_id, source order by created_at, id) as before from sig)
  where before is null or created_at - before > interval 24 hour"""))
def j17(spark, d):
    before = F.lag("created_at").over(W.partitionBy("trend_id", "source").orderBy("created_at", "id"))
    s = signals(spark, d).withColumn("before", before)
    return s.filter(F.col("before").isNull() | (F.col("created_at") > F.col("before") + F.expr("INTERVAL 24 HOURS"))).select("id")


@query("j18_identity_lookup", "select d.doc_id, coalesce(c.first, d.doc_id) as canonical from documents d left join (select doc_id, min(doc_id) over (partition by text) as first from documents) c on c.doc_id = d.doc_id and c.first <> d.doc_id")
def j18(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = t.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    m = t.join(first, "h").filter("doc_id <> first").select("doc_id", "first")
    return rows.identity_lookup(t.select("doc_id", F.col("doc_id").alias("canonical")), "canonical", m, "doc_id", "first")


@query("j19_override_merge", "select p_partkey, coalesce(q, p_size) as size from part left join (select l_partkey, max(l_quantity)::int as q from lineitem where l_returnflag = 'A' group by 1) on l_partkey = p_partkey")
def j19(spark, d):
    q = table(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("q"))
    return table(spark, d, "part").join(q, "p_partkey", "left").select("p_partkey", F.coalesce("q", "p_size").alias("size"))
