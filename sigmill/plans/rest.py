"""Scalars with a query of their own, gates of creators, limits, digests and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import market as M
from sigmill.functions import text as X
from sigmill.operators import dedup, rows
from sigmill.plans.market import HOST, PATH, REPO, _part, _site
from sigmill.plans.pairs import RELEVANCE, parts_of_relevance
from sigmill.plans.scalars import CLASS, listed, q
from sigmill.plans.state import LIFE, SCORE, STATE, history, score, state
from sigmill.registry import query
from sigmill.sources.posts import links, posts, sql_posts
from sigmill.sources.tables import signals, sql, table


def n_rows():
    return F.count(F.lit(1))


def joined(*parts, by: str = "; "):
    """Parts that aren't null, in order."""
    return F.array_join(F.array_compact(F.array(*parts)), by)


def joined_sql(*parts: str, by: str = "; ") -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x is not null), '{by}')"


@query("m06_momentum_composite", sql("select trend_id, round(0.5 * e + 0.3 * s + 0.2 * r * r, 6)::double as momentum from (select trend_id, sum(least(cents, 10000)) / (count(*) * 10000) as e, least(1, (count(distinct source) - 1) / 6) as s, count_if(source in ('purchase', 'signup')) / count(*) as r from sig group by 1)"))
def m06(spark, d):
    e = F.sum(F.least("cents", F.lit(10000))) / (n_rows() * 10000)
    r = F.count_if(F.col("source").isin("purchase", "signup")) / n_rows()
    t = signals(spark, d).groupBy("trend_id").agg(e.alias("e"), F.least(F.lit(1.0), (F.count_distinct("source") - 1) / 6).alias("s"), r.alias("r"))
    return t.select("trend_id", F.round(0.5 * F.col("e") + 0.3 * F.col("s") + 0.2 * F.col("r") * F.col("r"), 6).alias("momentum"))


@query("m07_acceleration", sql("select trend_id, slot, accel from hist where comparable", LIFE))
def m07(spark, d):
    return history(spark, d).filter("comparable").select("trend_id", "slot", "accel")


@query("m11_utc_date", sql("select id, strftime(created_at, '%Y-%m-%d') as day from sig"))
def m11(spark, d):
    return signals(spark, d).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("m17_json_struct", sql("select id, json_object('id', id, 'source', source, 'comments', comments)::varchar as j from sig"))
def m17(spark, d):
    return signals(spark, d).select("id", F.to_json(F.struct("id", "source", "comments")).alias("j"))


@query("t05_multi_key_sort", sql("select id, source, cents from sig order by source, cents desc, id limit 500"))
def t05(spark, d):
    return rows.top_k(signals(spark, d).select("id", "source", "cents"), 500, F.asc("source"), F.desc("cents"), F.asc("id"))


@query("f14_title_hash", sql_posts(r"select id, substr(sha256(regexp_replace(lower(title), '[^a-z]+', ' ', 'g')), 1, 32) as hash from posts"))
def f14(spark, d):
    return posts(spark, d).select("id", F.substring(F.sha2(F.regexp_replace(F.lower("title"), "[^a-z]+", " "), 256), 1, 32).alias("hash"))


FORUM = r"^/r/([^/]+)/comments/([^/]+)"
SITES = f"""lk as (select page_id, case when coalesce(url, '') <> '' then regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '^http://', 'https://') end as url from links),
cu as (select page_id, case when url is null then null {_site("contains(h, 'github.com')", REPO, f"'github.com/' || {_part(REPO)} || '/' || {_part(REPO, 2)}")} {_site("contains(h, 'dev.to')", '^/([^/]+)/([^/]+)', f"'dev.to/' || {_part('^/([^/]+)/([^/]+)')} || '/' || {_part('^/([^/]+)/([^/]+)', 2)}")}
  {_site("contains(h, 'producthunt.com')", '^/posts/([^/?]+)', f"'producthunt.com/posts/' || {_part('^/posts/([^/?]+)')}")} {_site("contains(h, 'indiehackers.com')", '^/post/([^/?]+)', f"'indiehackers.com/post/' || {_part('^/post/([^/?]+)')}")} {_site("ends_with(h, '.substack.com')", '^/p/([^/?]+)', f"h || '/p/' || {_part('^/p/([^/?]+)')}")}
  {_site("contains(h, 'reddit.com')", FORUM, f"'reddit.com/r/' || {_part(FORUM)} || '/comments/' || regexp_extract(p, {q(FORUM)}, 2)")} when h in {listed(X.WRAPPERS)} then null else rtrim(h || p, '/') end as canonical,
  case when url is null then 'no_url' {_site("contains(h, 'github.com')", REPO, "'github_repo'")} {_site("contains(h, 'dev.to')", '^/([^/]+)/([^/]+)', "'article'")} {_site("contains(h, 'producthunt.com')", '^/posts/([^/?]+)', "'product'")} {_site("contains(h, 'indiehackers.com')", '^/post/([^/?]+)', "'article'")}
  {_site("ends_with(h, '.substack.com')", '^/p/([^/?]+)', "'article'")} {_site("contains(h, 'reddit.com')", FORUM, "'discussion'")} when h in {listed(X.WRAPPERS)} then 'wrapper' else 'other' end as kind from (select page_id, url, {HOST} as h, {PATH} as p from lk))"""


@query("f02_canonical_url_by_site", sql_posts("select page_id, canonical, kind from cu", SITES))
def f02(spark, d):
    c = X.canonical_url(F.col("url"))
    return links(spark, d).select("page_id", c["url"].alias("canonical"), c["kind"].alias("kind"))


@query("d01_duplicates_by_site", sql_posts("select first as canonical, page_id as duplicate, 'canonical_url' as match_type from (select *, min(page_id) over (partition by canonical) as first from cu where canonical is not null) where first <> page_id", SITES))
def d01(spark, d):
    return dedup.url_duplicates(links(spark, d), "page_id", "url")


@query("a14_distinct_artifacts", sql_posts("select kind, count(distinct coalesce(canonical, 'page ' || (page_id // 22)::varchar)) as artifacts from cu group by kind", SITES))
def a14(spark, d):
    c = X.canonical_url(F.col("url"))
    t = links(spark, d).select(c["kind"].alias("kind"), F.coalesce(c["url"], F.concat(F.lit("page "), F.floor(F.col("page_id") / 22).cast("string"))).alias("key"))
    return t.groupBy("kind").agg(F.count_distinct("key").alias("artifacts"))


OFF = ["career_advice", "social_commentary", "personal_story", "opinion", "ask_hn"]


@query("d07_garbage_by_reasons", sql(f"""select trend_id, reasons, reasons >= 2 or off > 0.8 as garbage from (select trend_id, off, (off > 0.6)::int + (product = 0)::int + (shows = n and titles = n)::int as reasons from
  (select trend_id, count(*) as n, count_if(c in {listed(OFF)}) / count(*) as off, count_if(c in ('product', 'show_hn', 'technical')) as product, count_if(c = 'show_hn') as shows, count(distinct title) as titles from (select trend_id, title, {CLASS} as c from sig) group by 1))"""))
def d07(spark, d):
    t = signals(spark, d).select("trend_id", "title", X.content_class(F.col("title"), F.col("source")).alias("c")).groupBy("trend_id").agg(
        n_rows().alias("n"), (F.count_if(F.col("c").isin(OFF)) / n_rows()).alias("off"), F.count_if(F.col("c").isin("product", "show_hn", "technical")).alias("product"), F.count_if(F.col("c") == "show_hn").alias("shows"), F.count_distinct("title").alias("titles")
    )
    n = (F.col("off") > 0.6).cast("int") + (F.col("product") == 0).cast("int") + ((F.col("shows") == F.col("n")) & (F.col("titles") == F.col("n"))).cast("int")
    return t.select("trend_id", n.alias("reasons"), ((n >= 2) | (F.col("off") > 0.8)).alias("garbage"))


@query("d12_creator_gates_by_posts", sql_posts(f"""select trend, case when creators >= 0.7 then 'creator' when creators <= 0.3 then 'developer' else 'mixed' end as audience, (late - early) / greatest(early, 1) > 0.2 and (copies >= 3 or pain >= 2) and money > 0.05 as passed from (select trend, count_if(site = 'youtube_creator') / count(*) as creators,
  count_if(day >= 20) as late, count_if(day < 10) as early, count_if(regexp_matches(title, {q('(?i)' + M.AUDIENCE_PAIN)})) as pain, count_if(regexp_matches(title, {q('(?i)' + M.MONEY)})) / count(*) as money from posts group by 1)
  join (select trend, sum(case when k >= 2 then k else 0 end) as copies from (select trend, array_to_string(string_split(lower(title), ' ')[:4], ' ') as g, count(*) as k from posts group by 1, 2) group by 1) using (trend)"""))
def d12(spark, d):
    p = posts(spark, d)
    has = lambda x: F.count_if(F.col("title").rlike("(?i)" + x))
    a = p.groupBy("trend").agg((F.count_if(F.col("site") == "youtube_creator") / n_rows()).alias("creators"), F.count_if(F.col("day") >= 20).alias("late"), F.count_if(F.col("day") < 10).alias("early"), has(M.AUDIENCE_PAIN).alias("pain"), (has(M.MONEY) / n_rows()).alias("money"))
    k = p.groupBy("trend", F.array_join(F.slice(F.split(F.lower("title"), " "), 1, 4), " ").alias("g")).agg(n_rows().alias("k")).groupBy("trend").agg(F.sum(F.when(F.col("k") >= 2, F.col("k")).otherwise(0)).alias("copies"))
    fast = (F.col("late") - F.col("early")) / F.greatest("early", F.lit(1)) > 0.2
    who = F.when(F.col("creators") >= 0.7, "creator").when(F.col("creators") <= 0.3, "developer").otherwise("mixed")
    return a.join(k, "trend").select("trend", who.alias("audience"), (fast & ((F.col("copies") >= 3) | (F.col("pain") >= 2)) & (F.col("money") > 0.05)).alias("passed"))


@query("d44_rate_limit_by_hour", """select event_id, hour_count >= 30 or day_count >= 50 as limited, hour_count from (select event_id, count(*) over (partition by user_id order by s range between 3599 preceding and current row) as hour_count,
  count(*) over (partition by user_id, s // 86400 order by s range between unbounded preceding and current row) as day_count from (select event_id, user_id, floor(epoch_us(ts) / 1000000)::bigint as s from events))""")
def d44(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"))
    hour = n_rows().over(W.partitionBy("user_id").orderBy("s").rangeBetween(-3599, 0))
    day = n_rows().over(W.partitionBy("user_id", F.floor(F.col("s") / 86400)).orderBy("s").rangeBetween(W.unboundedPreceding, 0))
    return e.withColumns({"hour_count": hour, "d": day}).select("event_id", ((F.col("hour_count") >= 30) | (F.col("d") >= 50)).alias("limited"), "hour_count")


@query("d42_watch_reasons", sql(f"""select trend_id, {joined_sql("case when days < 2 then 'seen on one day only' end", "case when artifacts < 2 then 'one artifact only' end", "case when conf < 0.6 then 'stage not yet certain' end", "case when demand < 1 then 'no demand shown' end", "case when n_actions < 1 then 'nothing to build named' end")} as reasons
  from state where {SCORE} >= 0.2""", STATE))
def d42(spark, d):
    c = F.col
    t = state(spark, d).filter(score() >= 0.2)
    why = joined(F.when(c("days") < 2, "seen on one day only"), F.when(c("artifacts") < 2, "one artifact only"), F.when(c("conf") < 0.6, "stage not yet certain"), F.when(c("demand") < 1, "no demand shown"), F.when(c("n_actions") < 1, "nothing to build named"))
    return t.select("trend_id", why.alias("reasons"))


@query("d39_uncertainty_by_rules", sql(f"""select trend_id, {joined_sql("case when seen < 3 then 'few_snapshots:high' end", "case when days < 3 then 'short_history:medium' end", "case when sources < 2 then 'one_source:high' end", "case when conf < 0.5 then 'unclear_stage:medium' end", "case when demand = 0 then 'no_demand:medium' end", "case when not comparable then 'not_comparable:low' end", by=',')} as factors from state""", STATE))
def d39(spark, d):
    c = F.col
    why = joined(F.when(c("seen") < 3, "few_snapshots:high"), F.when(c("days") < 3, "short_history:medium"), F.when(c("sources") < 2, "one_source:high"), F.when(c("conf") < 0.5, "unclear_stage:medium"), F.when(c("demand") == 0, "no_demand:medium"), F.when(~c("comparable"), "not_comparable:low"), by=",")
    return state(spark, d).select("trend_id", why.alias("factors"))


FILLED = ["signals >= 2", "demand >= 1", "n_actions >= 1", "pains >= 1", "comparable", "conf >= 0.6"]


@query("d40_brief_completeness_by_fields", sql(f"select trend_id, round(f / 6, 6) as completeness, f / 6 < 0.5 as draft from (select trend_id, {' + '.join(f'({x})::int' for x in FILLED)} as f from state)", STATE))
def d40(spark, d):
    f = sum((F.expr(x).cast("int") for x in FILLED), F.lit(0))
    return state(spark, d).withColumn("f", f).select("trend_id", F.round(F.col("f") / 6, 6).alias("completeness"), (F.col("f") / 6 < 0.5).alias("draft"))


@query("d48_fit_reasons_of_pairs", sql_posts(f"""select u, part, {joined_sql("case when role >= 0.7 then 'fits the role' end", "case when domain >= 0.7 then 'in a wanted domain' end", "case when skills_fit >= 0.5 then 'uses a known stack' end", "case when effort < 0.5 then 'takes longer than planned' end", "case when avoided > 0 then 'touches an avoided topic' end")} as reasons from rel""", RELEVANCE))
def d48(spark, d):
    t = parts_of_relevance(spark, d)
    c = F.col
    why = joined(F.when(c("role") >= 0.7, "fits the role"), F.when(c("domain") >= 0.7, "in a wanted domain"), F.when(c("skills_fit") >= 0.5, "uses a known stack"), F.when(c("effort") < 0.5, "takes longer than planned"), F.when(c("avoided") > 0, "touches an avoided topic"))
    return t.select("u", "part", why.alias("reasons"))


@query("d56_overview_top_five", sql(f"select count(*) as trends, count_if({SCORE} >= 0.5) as qualified, count_if({SCORE} < 0.5 and {SCORE} >= 0.3) as watching, (select string_agg(trend_id::varchar, ',' order by s desc, trend_id) from (select trend_id, round({SCORE}, 6) as s from state order by s desc, trend_id limit 5)) as top from state", STATE))
def d56(spark, d):
    t = state(spark, d).select("trend_id", score().alias("s"))
    a = t.groupBy(F.lit(1).alias("one")).agg(n_rows().alias("trends"), F.count_if(F.col("s") >= 0.5).alias("qualified"), F.count_if((F.col("s") < 0.5) & (F.col("s") >= 0.3)).alias("watching"))
    top = rows.top_k(t.withColumn("s", F.round("s", 6)), 5, F.desc("s"), F.asc("trend_id")).groupBy(F.lit(1).alias("one")).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "trend_id"))).alias("x"))
    return a.join(top, "one").select("trends", "qualified", "watching", F.array_join(F.transform("x", lambda x: x["trend_id"].cast("string")), ",").alias("top"))


@query("d65_quotes_and_sources", sql_posts("""select trend, quotes, sources from (select trend, string_agg(title, ' | ' order by score desc, id) as quotes from (select * from posts qualify row_number() over (partition by trend order by score desc, id) <= 5) group by 1)
  join (select trend, string_agg(site || ':' || k::varchar, ',' order by site) as sources from (select trend, site, count(*) as k from posts group by 1, 2) group by 1) using (trend)"""))
def d65(spark, d):
    p = posts(spark, d).select("id", "trend", "site", "score", "title")
    top = rows.top_k(p, 5, F.desc("score"), F.asc("id"), keys=["trend"]).groupBy("trend").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "title"))).alias("x"))
    of = p.groupBy("trend", "site").agg(n_rows().alias("k")).groupBy("trend").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "site", F.col("k").cast("string")))), ",").alias("sources"))
    return top.select("trend", F.array_join(F.transform("x", lambda x: x["title"]), " | ").alias("quotes")).join(of, "trend")


@query("d52_calibration_by_type", """with p as (select lang, quality as y, least(n_chars, 4000) / 4000 as c from labels join documents using (doc_id) where quality is not null), b as (select lang, least(floor(c * 10), 9)::int as bin, count(*) as n, sum(c) as sc, sum(y) as sy from p group by 1, 2)
  select lang, round(brier + 1e-9, 5)::double as brier, round(ece + 1e-9, 5)::double as ece, n from (select lang, avg((c - y) * (c - y)) as brier, count(*) as n from p group by 1) join (select lang, sum(abs(sc - sy)) / sum(n) as ece from b group by 1) using (lang)""")
def d52(spark, d):
    t = table(spark, d, "labels").filter("quality is not null").select("doc_id", F.col("quality").alias("y"))
    t = t.join(table(spark, d, "documents").select("doc_id", "lang", (F.least("n_chars", F.lit(4000)) / 4000).alias("c")), "doc_id")
    brier = t.groupBy("lang").agg(F.avg((F.col("c") - F.col("y")) * (F.col("c") - F.col("y"))).alias("brier"), n_rows().alias("n"))
    bins = t.groupBy("lang", F.least(F.floor(F.col("c") * 10), F.lit(9)).alias("bin")).agg(n_rows().alias("k"), F.sum("c").alias("sc"), F.sum("y").alias("sy"))
    ece = bins.groupBy("lang").agg((F.sum(F.abs(F.col("sc") - F.col("sy"))) / F.sum("k")).alias("ece"))
    return brier.join(ece, "lang").select("lang", F.round(F.col("brier") + 1e-9, 5).alias("brier"), F.round(F.col("ece") + 1e-9, 5).alias("ece"), "n")
