"""Further predicates, functions and rules: each a projection or one aggregation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import scoring as S
from sigmill.operators import rows
from sigmill.operators import windows as O
from sigmill.plans.aggregates import PRED, predictions
from sigmill.plans.scalars import listed
from sigmill.plans.windows import LIFE, D
from sigmill.registry import query
from sigmill.sources.tables import items, signals, sql, table

A_DAY = "2024-01-10"


@query("p01_comparisons", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 45 and l_discount < 0.05 and l_returnflag <> 'A' and l_linestatus = 'O'")
def p01(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity >= 45 and l_discount < 0.05 and l_returnflag <> 'A' and l_linestatus = 'O'").select("l_orderkey", "l_linenumber")


@query("p03_null_tests", "select count_if(l.quality is null) as unlabelled, count_if(l.quality is not null) as labelled from documents d left join labels l using (doc_id)")
def p03(spark, d):
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return t.agg(F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("quality").isNotNull()).alias("labelled"))


@query("p05_optional_predicate", sql("select id from sig where source = 'purchase'"))
def p05(spark, d):
    s = signals(spark, d)
    for column, value in {"source": "purchase", "trend_id": None}.items():
        s = s if value is None else s.filter(F.col(column) == value)
    return s.select("id")


@query("p07_merged_class", "select o_orderkey from orders where o_orderstatus in ('P', 'F')")
def p07(spark, d):
    merged = {"uncertain": ["P", "F"]}
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin(merged["uncertain"])).select("o_orderkey")


@query("p10_embedded_resource", "select n_nationkey, r_name as region_name, n_name as nation_name from nation left join region on r_regionkey = n_regionkey")
def p10(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.struct("r_name").alias("region"))
    return table(spark, d, "nation").join(r, "n_regionkey", "left").select("n_nationkey", F.col("region.r_name").alias("region_name"), F.col("n_name").alias("nation_name"))


@query("p12_clamp", "select c_custkey, greatest(0, least(5000, c_acctbal)) as balance from customer")
def p12(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("balance"))


@query("p13_name_filter", f"select p_partkey from part where len(list_filter(string_split(lower(p_name), ' '), lambda w: w not in {listed(['blue', 'red', 'green', 'small', 'large', 'hot', 'cold'])})) > 0")
def p13(spark, d):
    stop = F.array(*[F.lit(w) for w in ("blue", "red", "green", "small", "large", "hot", "cold")])
    return table(spark, d, "part").filter(~F.forall(F.split(F.lower("p_name"), " "), lambda w: F.array_contains(stop, w))).select("p_partkey")


@query("f08_canonical_phrase", "select p_partkey, case p_brand when 'Brand#11' then 'first' when 'Brand#12' then 'second' else p_brand end as phrase from part")
def f08(spark, d):
    forms = F.create_map(*[F.lit(x) for x in ("Brand#11", "first", "Brand#12", "second")])
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(forms, F.col("p_brand")), "p_brand").alias("phrase"))


@query("f16_evidence_hash", sql("select trend_id, substr(sha256(string_agg(id || ':' || cents, ',' order by cents desc, id)), 1, 16) as evidence from (select * from sig qualify row_number() over (partition by trend_id order by cents desc, id) <= 5) group by trend_id"))
def f16(spark, d):
    t = rows.top_k(signals(spark, d), 5, F.desc("cents"), F.asc("id"), keys=["trend_id"]).withColumn("e", F.struct((-F.col("cents")).alias("o"), "id", F.concat_ws(":", "id", "cents").alias("x")))
    return t.groupBy("trend_id").agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), ","), 256), 1, 16).alias("evidence"))


@query("f23_phrase_context", sql(r"select id, regexp_extract(title, '(?i)(.{0,30}\b(?:buggy|slow|expensive|regret|struggling)\b.{0,90})', 1) as context from sig where regexp_matches(title, '(?i)\b(?:buggy|slow|expensive|regret|struggling)\b')"))
def f23(spark, d):
    signs = r"\b(?:buggy|slow|expensive|regret|struggling)\b"
    return signals(spark, d).filter(F.col("title").rlike("(?i)" + signs)).select("id", F.regexp_extract("title", "(?i)(.{0,30}" + signs + ".{0,90})", 1).alias("context"))


@query("f26_required_stack", sql("""select id, array_to_string(list_filter([case when regexp_matches(title, '(?i)\\b(?:rust|python)\\b') then 'backend' end, case when regexp_matches(title, '(?i)\\b(?:database|queue|slow queries)\\b') then 'data' end, case when regexp_matches(title, '(?i)\\b(?:kubernetes|cloud)\\b') then 'infra' end], lambda x: x is not null), ',') as stack from sig""".replace("\\\\", "\\")))
def f26(spark, d):
    kinds = {"backend": r"\b(?:rust|python)\b", "data": r"\b(?:database|queue|slow queries)\b", "infra": r"\b(?:kubernetes|cloud)\b"}
    found = F.array_compact(F.array(*[F.when(F.col("title").rlike("(?i)" + p), F.lit(k)) for k, p in kinds.items()]))
    return signals(spark, d).select("id", F.array_join(found, ",").alias("stack"))


@query("f27_share_of_wants", "select p_partkey, len(list_filter(['steel', 'large', 'red'], lambda w: contains(lower(p_type || ' ' || p_name), w))) / 3 as share from part")
def f27(spark, d):
    from sigmill.operators.users import share_of_wants

    wants = F.array(F.lit("steel"), F.lit("large"), F.lit("red"))
    return table(spark, d, "part").select("p_partkey", share_of_wants(wants, F.lower(F.concat_ws(" ", "p_type", "p_name"))).alias("share"))


@query("f31_cluster_name", """with w as (select p_brand, unnest(string_split(lower(p_name), ' ')) as w from part), c as (select p_brand, w, count(*) as n from w group by 1, 2)
select p_brand, string_agg(upper(w[1]) || w[2:], ' ' order by n desc, w) as name from (select * from c qualify row_number() over (partition by p_brand order by n desc, w) <= 3) group by p_brand""")
def f31(spark, d):
    w = table(spark, d, "part").select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("w")).groupBy("p_brand", "w").agg(F.count(F.lit(1)).alias("n"))
    top = rows.top_k(w, 3, F.desc("n"), F.asc("w"), keys=["p_brand"]).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))).alias("a"))
    return top.select("p_brand", F.array_join(F.transform("a", lambda x: F.initcap(x["w"])), " ").alias("name"))


@query("f32_query_router", "select conv_id, turn, case when length(text) < 10 then 'blocked' when (text like '%?%')::int + (length(text) > 300)::int > (text like '%,%')::int then 'evidence' else 'idea' end as route from conversations")
def f32(spark, d):
    t = F.col("text")
    evidence = t.contains("?").cast("int") + (F.length(t) > 300).cast("int")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length(t) < 10, "blocked").when(evidence > t.contains(",").cast("int"), "evidence").otherwise("idea").alias("route"))


@query("f36_topic_only", sql("select trend_id, (count(distinct source) = 1 and count(*) <= 2) or count_if(title like 'I %' or title like 'My %') / count(*) > 0.6 as topic_only from sig group by trend_id"))
def f36(spark, d):
    n = F.count(F.lit(1))
    story = F.count_if(F.col("title").like("I %") | F.col("title").like("My %")) / n > 0.6
    return signals(spark, d).groupBy("trend_id").agg((((F.count_distinct("source") == 1) & (n <= 2)) | story).alias("topic_only"))


@query("m02_p90_normalise", sql("select id, least(cents / p90, 1) as norm from sig join (select source, greatest(list_sort(list(cents))[(count(*) * 9) // 10 + 1], 100) as p90 from sig group by source) using (source)"))
def m02(spark, d):
    from sigmill.operators.aggregates import index_p90, pick_by_place

    s = signals(spark, d)
    p = pick_by_place(s, ["source"], "cents", {"p90": index_p90()}).select("source", F.greatest("p90", F.lit(100)).alias("p90"))
    return s.join(p, "source").select("id", F.least(F.col("cents") / F.col("p90"), F.lit(1)).alias("norm"))


@query("m04_baseline_fallback", sql(f"""select trend_id, coalesce(case when a >= 20 then pa end, case when b >= 60 then pb end, 100) as p90, case when a >= 20 then 'batch' when b >= 60 then 'rolling' else 'default' end as method from (select trend_id,
  count_if(created_at < timestamp '{A_DAY}') as a, list_sort(list(cents) filter (created_at < timestamp '{A_DAY}'))[((count_if(created_at < timestamp '{A_DAY}') * 9) // 10 + 1)::bigint] as pa, count(*) as b, list_sort(list(cents))[(count(*) * 9) // 10 + 1] as pb from sig group by trend_id)"""))
def m04(spark, d):
    from sigmill.operators.aggregates import index_p90, pick_by_place

    s = signals(spark, d)
    place = {"p": index_p90()}
    batch = pick_by_place(s.filter(F.col("created_at") < F.lit(A_DAY).cast("timestamp_ntz")), ["trend_id"], "cents", place).select("trend_id", F.col("n").alias("a"), F.col("p").alias("pa"))
    t = pick_by_place(s, ["trend_id"], "cents", place).join(batch, "trend_id", "left")
    return t.select("trend_id", F.coalesce(F.when(F.col("a") >= 20, F.col("pa")), F.when(F.col("n") >= 60, F.col("p")), F.lit(100)).alias("p90"), F.when(F.col("a") >= 20, "batch").when(F.col("n") >= 60, "rolling").otherwise("default").alias("method"))


@query("m08_change_guards", sql("select trend_id, day::varchar as day, array_to_string(list_filter([case when pm is null then 'first_appearance' end, case when pm < 0.01 then 'previous_too_small' end], lambda x: x is not null), ',') as guards from life", LIFE))
def m08(spark, d):
    p = F.col("prev_momentum")
    g = F.array_compact(F.array(F.when(p.isNull(), "first_appearance"), F.when(p < 0.01, "previous_too_small")))
    return O.lifecycle(items(spark, d)).select("trend_id", D(), F.array_join(g, ",").alias("guards"))


@query("m12_gap_hours", sql("select id, round(date_diff('microsecond', lag(created_at) over w, created_at) / 3600000000, 6) as gap_hours from sig window w as (partition by trend_id order by created_at, id)"))
def m12(spark, d):
    before = F.lag("created_at").over(W.partitionBy("trend_id").orderBy("created_at", "id"))
    return signals(spark, d).withColumn("b", before).select("id", F.round(F.expr("timestampdiff(MICROSECOND, b, created_at)") / 3600000000, 6).alias("gap_hours"))


@query("m15_json_default", "select event_id as id, coalesce(json_extract_string(props, '$.stars'), json_extract_string(props, '$.k'), '0')::int as stars from events")
def m15(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce(F.get_json_object("props", "$.stars"), F.get_json_object("props", "$.k"), F.lit("0")).cast("int").alias("stars"))


@query("d12_creator_gates", sql("""select trend_id, case when c / n >= 0.7 then 'creator' when c / n <= 0.3 then 'developer' else 'mixed' end as kind, r >= 3 or p >= 2 as replicated from (select trend_id, count(*) as n, count_if(source in ('view', 'click')) as c, count(*) - count(distinct title) as r, count_if(source = 'error') as p from sig group by trend_id)"""))
def d12(spark, d):
    n = F.count(F.lit(1))
    t = signals(spark, d).groupBy("trend_id").agg((F.count_if(F.col("source").isin("view", "click")) / n).alias("share"), (n - F.count_distinct("title")).alias("r"), F.count_if(F.col("source") == "error").alias("p"))
    return t.select("trend_id", F.when(F.col("share") >= 0.7, "creator").when(F.col("share") <= 0.3, "developer").otherwise("mixed").alias("kind"), ((F.col("r") >= 3) | (F.col("p") >= 2)).alias("replicated"))


@query("d14_gate_predicate", sql("select trend_id, count(distinct title) >= 2 and not (count(distinct source) = 1 and count_if(source = 'purchase') = 0) and (count_if(source = 'purchase') >= 1 or count_if(source = 'error') >= 2) as go from sig group by trend_id"))
def d14(spark, d):
    demand, pain = F.count_if(F.col("source") == "purchase"), F.count_if(F.col("source") == "error")
    return signals(spark, d).groupBy("trend_id").agg(((F.count_distinct("title") >= 2) & ~((F.count_distinct("source") == 1) & (demand == 0)) & ((demand >= 1) | (pain >= 2))).alias("go"))


@query("d20_execution_requirements", "select p_partkey, (4 * case when p_type like '%STEEL%' or lower(p_type) like '%steel%' then 3 when lower(p_type) like '%brass%' then 2 else 1 end * case when p_size > 40 then 1.5 else 1 end)::int as weeks from part")
def d20(spark, d):
    t = F.lower("p_type")
    base = F.when(t.contains("steel"), 12).when(t.contains("brass"), 8).otherwise(4)
    return table(spark, d, "part").select("p_partkey", (base * F.when(F.col("p_size") > 40, 1.5).otherwise(1.0)).cast("int").alias("weeks"))


@query("d26_prediction_resolution", f"with {PRED} select doc_id, case when c >= 0.5 and actual then 'hit' when c >= 0.5 then 'false_alarm' when actual then 'miss' else 'quiet' end as outcome from pred")
def d26(spark, d):
    sure, actual = F.col("c") >= 0.5, F.col("actual")
    return predictions(spark, d).select("doc_id", F.when(sure & actual, "hit").when(sure, "false_alarm").when(actual, "miss").otherwise("quiet").alias("outcome"))


@query("d47_source_persona", sql("""select source, first(title order by n desc, title) as main_title, sum(n)::bigint as size, case when sum(n) >= 500 then 'large' when sum(n) >= 100 then 'medium' when sum(n) >= 10 then 'small' else 'tiny' end as tier from (select source, title, count(*) as n from sig group by 1, 2) group by source"""))
def d47(spark, d):
    c = signals(spark, d).groupBy("source", "title").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n")
    return c.groupBy("source").agg(F.min_by("title", F.struct(-F.col("n"), "title")).alias("main_title"), size.alias("size"), F.when(size >= 500, "large").when(size >= 100, "medium").when(size >= 10, "small").otherwise("tiny").alias("tier"))


@query("d62_guard_sentences", sql("select trend_id, day::varchar as day, case when pm is null then 'Seen for the first time.' when pm < 0.01 then 'The snapshot before was too weak.' else '' end as sentence from life", LIFE))
def d62(spark, d):
    p = F.col("prev_momentum")
    return O.lifecycle(items(spark, d)).select("trend_id", D(), F.when(p.isNull(), "Seen for the first time.").when(p < 0.01, "The snapshot before was too weak.").otherwise("").alias("sentence"))
