"""Users, opportunities and outcomes: customers, parts and orders stand for them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import scoring as S
from sigmill.operators import rows
from sigmill.operators import users as U
from sigmill.registry import query
from sigmill.sources.tables import signals, sql, table


def N():  # noqa: N802
    """Count of the rows of a group."""
    return F.count(F.lit(1))

#: Outcomes of a part: starts, completions, completion rate, mean quality from the order's priority.
OUT = """oc as (select l_partkey as p, count_if(o_orderstatus <> 'P') as starts, count_if(o_orderstatus = 'F') as done, sum(6 - substr(o_orderpriority, 1, 1)::int) / count(*) as q,
  max(l_shipdate::date) - min(l_shipdate::date) as days from lineitem join orders on o_orderkey = l_orderkey group by 1), oo as (select *, case when starts > 0 then done / starts end as cr from oc)"""


def part_outcomes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("s"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("q"))
    t = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy(F.col("l_partkey").alias("p"))
    ship = F.to_date("l_shipdate")
    t = t.agg(F.count_if(F.col("s") != "P").alias("starts"), F.count_if(F.col("s") == "F").alias("done"), (F.sum("q") / N()).alias("q"), F.date_diff(F.max(ship), F.min(ship)).alias("days"))
    return t.withColumn("cr", F.when(F.col("starts") > 0, F.col("done") / F.col("starts")))


PAIR = "pair as (select distinct o_custkey as c_custkey, l_partkey as p_partkey from lineitem join orders on o_orderkey = l_orderkey)"


def pairs(spark, d):
    """Each customer with the parts of their orders, and the columns of both."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(o, "l_orderkey").select("c_custkey", "p_partkey").distinct()
    return t.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").join(table(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_brand"), "p_partkey")


@query("d22_feasibility", f"""with {PAIR} select c_custkey, p_partkey, round(0.2 * case when p_size <= 10 then 1 when p_size <= 25 then 0.6 else 0.2 end + 0.2 * least(1, (c_custkey % 12 + 1) / greatest(p_size, 1)) + 0.6 * case when c_mktsegment = 'BUILDING' then 0.9 else 0.7 end, 6)::double as feasibility
  from pair join customer using (c_custkey) join part using (p_partkey)""")
def d22(spark, d):
    x = 0.2 * F.when(F.col("p_size") <= 10, 1.0).when(F.col("p_size") <= 25, 0.6).otherwise(0.2) + 0.2 * F.least(F.lit(1), (F.col("c_custkey") % 12 + 1) / F.greatest("p_size", F.lit(1)))
    return pairs(spark, d).select("c_custkey", "p_partkey", F.round(x + 0.6 * F.when(F.col("c_mktsegment") == "BUILDING", 0.9).otherwise(0.7), 6).alias("feasibility"))


@query("d23_verdict", f"with {OUT} select p, case when q / 5 >= 0.7 and cr >= 0.5 then 'strong_fit' when q / 5 >= 0.5 then 'conditional_fit' when q / 5 >= 0.3 then 'high_risk' else 'execution_mismatch' end as verdict from oo")
def d23(spark, d):
    s = F.col("q") / 5
    return part_outcomes(spark, d).select("p", F.when((s >= 0.7) & (F.col("cr") >= 0.5), "strong_fit").when(s >= 0.5, "conditional_fit").when(s >= 0.3, "high_risk").otherwise("execution_mismatch").alias("verdict"))


@query("d29_relevance", f"""with {PAIR} select c_custkey, p_partkey, round(greatest(0, least(1, 0.25 * case when p_type like '%STEEL%' or lower(p_type) like '%steel%' then 1 else 0.5 end + 0.25 * case when p_size <= c_custkey % 50 then 1 else 0 end + 0.15 * (1 - p_size / 50) - 0.3 * (p_brand = 'Brand#11')::int)), 6)::double as relevance
  from pair join part using (p_partkey)""")
def d29(spark, d):
    parts = {
        "role": F.when(F.lower("p_type").contains("steel"), 1.0).otherwise(0.5),
        "domain": (F.col("p_size") <= F.col("c_custkey") % 50).cast("int"),
        "effort": 1 - F.col("p_size") / 50,
        "avoid": (F.col("p_brand") == "Brand#11").cast("int"),
    }
    return pairs(spark, d).select("c_custkey", "p_partkey", F.round(U.relevance(parts), 6).alias("relevance"))


MOD = """case when starts >= 3 then greatest(-0.3, least(0.3, case when cr >= 0.6 then 0.10 when cr >= 0.4 then 0.05 when cr < 0.2 then -0.15 else 0 end + case when q >= 4 then 0.10 when q >= 3 then 0.05 when q > 0 and q < 2 then -0.10 else 0 end
  + case when starts >= 10 then 0.05 when starts >= 5 then 0.02 else 0 end)) else 0 end"""


@query("d30_personal_rank", f"""with {PAIR}, {OUT}, r as (select c_mktsegment, p, round(0.6 * (q / 5) * (1 + {MOD}) + 0.4 * ((p % 10) / 10), 6)::double as score from oo join (select distinct c_mktsegment, p_partkey from pair join customer using (c_custkey)) on p_partkey = p)
  select c_mktsegment, p, score from r qualify row_number() over (partition by c_mktsegment order by score desc, p) <= 20""")
def d30(spark, d):
    bought = pairs(spark, d).select("c_mktsegment", F.col("p_partkey").alias("p")).distinct()
    base = U.personal_rank(F.col("q") / 5, S.outcome_modifier(F.col("starts"), F.col("cr"), F.col("q")), F.col("p") % 10 / 10)
    t = part_outcomes(spark, d).select("p", F.round(base, 6).alias("score")).join(bought, "p")
    return rows.top_k(t.select("c_mktsegment", "p", "score"), 20, F.desc("score"), F.asc("p"), keys=["c_mktsegment"])


@query("d31_outcome_modifier", f"with {OUT} select p, round({MOD}, 6)::double as modifier from oo")
def d31(spark, d):
    return part_outcomes(spark, d).select("p", F.round(S.outcome_modifier(F.col("starts"), F.col("cr"), F.col("q")), 6).alias("modifier"))


ARCH = "case when starts < 3 then null when cr < 0.3 and starts >= 5 then 'execution_trap' when cr >= 0.6 and q >= 4 then 'proven_winner' when days <= 7 and cr >= 0.4 then 'fast_mvp' when days >= 30 and q >= 3.5 then 'infra_bet' when cr >= 0.3 and cr < 0.6 then 'content_wedge' end"


@query("d32_archetype", f"with {OUT} select p, {ARCH} as archetype from oo")
def d32(spark, d):
    return part_outcomes(spark, d).select("p", S.archetype(F.col("starts"), F.col("cr"), F.col("q"), F.col("days")).alias("archetype"))


@query("d33_misclassification", f"""with {OUT}, a as (select p, starts, q / 5 >= 0.6 as predicted, case when done >= 3 and q >= 4 then 'successful' when done >= 2 and q >= 3 then 'moderate' when starts >= 5 and cr < 0.3 then 'trap' when done >= 2 then 'missed' else 'other' end as actual from oo where starts >= 3)
  select p, actual, case when predicted and actual = 'trap' then 'false_positive' when not predicted and actual in ('successful', 'missed') then 'false_negative' else 'none' end as kind from a""")
def d33(spark, d):
    t = part_outcomes(spark, d).filter("starts >= 3")
    done, q = F.col("done"), F.col("q")
    actual = F.when((done >= 3) & (q >= 4), "successful").when((done >= 2) & (q >= 3), "moderate").when((F.col("starts") >= 5) & (F.col("cr") < 0.3), "trap").when(done >= 2, "missed").otherwise("other")
    t = t.select("p", (q / 5 >= 0.6).alias("predicted"), actual.alias("actual"))
    kind = F.when(F.col("predicted") & (F.col("actual") == "trap"), "false_positive").when(~F.col("predicted") & F.col("actual").isin("successful", "missed"), "false_negative").otherwise("none")
    return t.select("p", "actual", kind.alias("kind"))


@query("d34_learned_weights", sql("""select trend_id, n, round(greatest(-0.2, least(0.2, gap * 0.05 * n / 5)), 4)::double as shift from (select trend_id, count(*) as n, sum(w * x) filter (source in ('purchase', 'signup')) / sum(w) filter (source in ('purchase', 'signup')) - sum(w * x) filter (source not in ('purchase', 'signup')) / sum(w) filter (source not in ('purchase', 'signup')) as gap
  from (select *, comments / 100 as x, 0.5 ** ((date '2024-01-31' - created_at::date) / 30) as w from sig) group by trend_id) where n >= 5 and gap is not null"""))
def d34(spark, d):
    age = F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("created_at"))
    return U.learned_weights(signals(spark, d), "trend_id", F.col("source").isin("purchase", "signup"), F.col("comments") / 100, age)


@query("d35_preference_inference", """with s as (select o_custkey, p_brand, count_if(l_returnflag <> 'R') - 0.5 * count_if(l_returnflag = 'R') as score, count(*) as n from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey group by 1, 2),
  t as (select *, sum(score) filter (score > 0) over (partition by o_custkey) as total, sum(n) over (partition by o_custkey) as items from s)
  select o_custkey, p_brand, round(score / total, 6)::double as share from t where items >= 8 and score > 0 and score / total >= 0.15 qualify row_number() over (partition by o_custkey order by score desc, p_brand) <= 3""")
def d35(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    back = F.col("l_returnflag") == "R"
    s = li.join(o, "l_orderkey").join(p, "l_partkey").groupBy("o_custkey", "p_brand").agg((F.count_if(~back) - 0.5 * F.count_if(back)).alias("score"), N().alias("n"))
    w = W.partitionBy("o_custkey")
    s = s.withColumns({"total": F.sum(F.when(F.col("score") > 0, F.col("score"))).over(w), "items": F.sum("n").over(w)})
    s = s.filter((F.col("items") >= 8) & (F.col("score") > 0)).filter(F.col("score") / F.col("total") >= 0.15)
    return rows.top_k(s, 3, F.desc("score"), F.asc("p_brand"), keys=["o_custkey"]).select("o_custkey", "p_brand", F.round(F.col("score") / F.col("total"), 6).alias("share"))


@query("d36_preference_merge", "select c_custkey, case when c_nationkey % 5 > 0 then c_mktsegment when c_custkey % 2 = 0 then 'INFERRED' end as preference from customer")
def d36(spark, d):
    explicit = F.when(F.col("c_nationkey") % 5 > 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    accepted = F.when(F.col("c_custkey") % 2 == 0, F.lit("INFERRED"))
    return table(spark, d, "customer").select("c_custkey", F.when(F.size(explicit) == 0, accepted).otherwise(F.try_element_at(explicit, F.lit(1))).alias("preference"))


@query("d43_experiment_assignment", "select c_custkey, case when c_custkey % 10 = 0 then 'kept' else 'v' || (('0x' || substr(sha256(c_custkey::varchar || 'exp'), 1, 8))::bigint % 2)::varchar end as variant from customer")
def d43(spark, d):
    from sigmill.functions.text import bucket

    c = table(spark, d, "customer").select("c_custkey")
    had = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("kept").alias("had"))
    new = F.concat(F.lit("v"), bucket(F.concat(F.col("c_custkey").cast("string"), F.lit("exp")), 2).cast("string"))
    return c.join(had, "c_custkey", "left").select("c_custkey", F.coalesce("had", new).alias("variant"))


@query("d44_rate_limit", "select conv_id, count_if(role = 'user') as sent, count_if(role = 'user') >= 3 as limited from conversations group by conv_id")
def d44(spark, d):
    n = F.count_if(F.col("role") == "user")
    return table(spark, d, "conversations").groupBy("conv_id").agg(n.alias("sent"), (n >= 3).alias("limited"))


@query("d48_fit_reasons", f"with {OUT} select p, array_to_string(list_filter([case when q >= 4 then 'high quality' end, case when cr >= 0.5 then 'often finished' end, case when starts < 3 then 'little data' end], lambda x: x is not null), '; ') as reasons from oo")
def d48(spark, d):
    r = F.array_compact(F.array(F.when(F.col("q") >= 4, "high quality"), F.when(F.col("cr") >= 0.5, "often finished"), F.when(F.col("starts") < 3, "little data")))
    return part_outcomes(spark, d).select("p", F.array_join(r, "; ").alias("reasons"))


@query("d57_outcome_analytics", f"with {OUT}, t as (select *, {ARCH} as a from oo order by starts desc, p limit 200) select coalesce(a, 'none') as archetype, count(*) as n, sum(starts)::bigint as starts, sum(done)::bigint as done from t group by 1")
def d57(spark, d):
    t = rows.top_k(part_outcomes(spark, d), 200, F.desc("starts"), F.asc("p")).withColumn("archetype", F.coalesce(S.archetype(F.col("starts"), F.col("cr"), F.col("q"), F.col("days")), F.lit("none")))
    return t.groupBy("archetype").agg(N().alias("n"), F.sum("starts").alias("starts"), F.sum("done").alias("done"))
