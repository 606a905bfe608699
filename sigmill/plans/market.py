"""Competition, feasibility, audience and dialogue rules over posts, parts, customers and conversations."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import market as M
from sigmill.operators import rows
from sigmill.plans.scalars import listed, q
from sigmill.registry import query
from sigmill.sources.posts import links, posts, sql_posts
from sigmill.sources.tables import table

LEVELS = ["low", "moderate", "high", "uncertain"]

# Words that are never keywords.
COMMON = """the a an and or but in on at to for of with is are was were been be have has had do does did will would could should may might can
this that these those i you he she it we they what which who when where why how show hn ask just its over your about like now here there then than
them their into out all some any other more most such very much each every both few many says said make made get got
one two first last new old good bad""".split()


def n_rows():
    return F.count(F.lit(1))


def counted(text: str, patterns) -> str:
    return f"len(regexp_extract_all({text}, {q(M.any_of(patterns))}))"


def held(low: str, words) -> str:
    return "(" + " + ".join(f"contains({low}, {q(w)})::int" for w in words) + ")"


def ranked(low: str, kinds) -> str:
    """Kinds found, most keywords first, then as listed: a list of (less, k, name)."""
    each = ", ".join(f"{{'less': -{held(low, words)}, 'k': {k}, 'name': {q(name)}}}" for k, (name, words) in enumerate(kinds.items()))
    return f"list_sort(list_filter([{each}], lambda x: x.less < 0))"


def best(low: str, kinds, default: str) -> str:
    return f"coalesce({ranked(low, kinds)}[1].name, {q(default)})"


def found(low: str, kinds) -> str:
    return "list_filter([" + ", ".join(f"case when {held(low, words)} > 0 then {q(name)} end" for name, words in kinds.items()) + "], lambda x: x is not null)"


def mapped(values, key: str, default) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return f"case {key} " + " ".join(f"when {q(k)} then {lit(v)}" for k, v in values.items()) + f" else {lit(default)} end"


HOST = r"lower(regexp_extract(url, '^\w+://([^/?#]*)', 1))"
PATH = r"regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1)"


def _site(host: str, pattern: str, text: str) -> str:
    return f"when {host} and regexp_matches(p, {q(pattern)}) then {text}"


def _part(pattern: str, k: int = 1) -> str:
    return f"lower(regexp_extract(p, {q(pattern)}, {k}))"


REPO, DEV = r"(?i)^/([^/]+)/([^/]+?)(?:\.git)?(?:/.*)?$", r"^/([^/]+)/([^/]+)"


@query("f03_artifact_url", sql_posts(f"""select page_id, case when coalesce(url, '') = '' then null {_site("contains(h, 'github.com')", REPO, f"'github.com/' || {_part(REPO)} || '/' || {_part(REPO, 2)}")}
  {_site("contains(h, 'dev.to')", DEV, f"'dev.to/' || {_part(DEV)} || '/' || {_part(DEV, 2)}")} {_site("contains(h, 'producthunt.com')", '^/posts/([^/]+)', f"'producthunt.com/posts/' || {_part('^/posts/([^/]+)')}")}
  {_site("contains(h, 'indiehackers.com')", '^/post/([^/?]+)', f"'indiehackers.com/post/' || {_part('^/post/([^/?]+)')}")} {_site("ends_with(h, '.substack.com')", '^/p/([^/?]+)', f"h || '/p/' || {_part('^/p/([^/?]+)')}")}
  when h in ('news.ycombinator.com', 'reddit.com', 'twitter.com', 'x.com', 'facebook.com', 'linkedin.com') then null else rtrim(h || p, '/') end as artifact from (select page_id, url, {HOST} as h, {PATH} as p from links)"""))
def f03(spark, d):
    return links(spark, d).select("page_id", M.artifact_url(F.col("url")).alias("artifact"))


@query("f04_external_url", sql_posts(r"""select page_id, case when coalesce(url, '') <> '' and length(o) > 15 then o end as external from (select page_id, url, rtrim(b || case when len(k) > 0 then '?' || array_to_string(k, '&') else '' end, '/') as o from
  (select page_id, url, regexp_replace(regexp_replace(u, '\?.*$', ''), '^\w+://', 'https://') as b, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' and string_split(p, '=')[1] not in
    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'ref', 'source', 'share', 'fbclid', 'gclid', 'mc_cid', 'mc_eid')) as k from
  (select page_id, url, regexp_replace(case when list_bool_or(list_transform(['news.ycombinator.com', 'reddit.com', 'twitter.com', 'x.com', 'facebook.com', 'linkedin.com'], lambda w: contains(replace(h, 'www.', ''), w)))
    then coalesce(nullif(json_extract_string(data, '$.external_url'), ''), nullif(json_extract_string(data, '$.link'), ''), nullif(json_extract_string(data, '$.url'), ''), url) else url end, '#.*$', '') as u from (select *, """ + HOST + """ as h from links))))"""))
def f04(spark, d):
    return links(spark, d).select("page_id", M.external_url(F.col("url"), F.col("data")).alias("external"))


@query("f09_keywords", sql_posts(f"select id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda w: length(w) > 2 and w not in {listed(COMMON)}), ' ') as keywords from posts"))
def f09(spark, d):
    w = F.split(F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9\s]", "")), r"\s+")
    return posts(spark, d).select("id", F.array_join(F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(COMMON)), " ").alias("keywords"))


@query("f20_alternatives_and_intent", sql_posts(f"select id, {counted('title', M.ALTERNATIVES)}::bigint as alternatives, {counted('title', M.INTENT)}::bigint as intent from posts"))
def f20(spark, d):
    return posts(spark, d).select("id", M.count_of(F.col("title"), M.ALTERNATIVES).alias("alternatives"), M.count_of(F.col("title"), M.INTENT).alias("intent"))


#: Components of saturation by trend, and what they add up to.
SAT = f"""gs as (select trend, score, count(*) as c from posts where site = 'github' and score > 0 group by 1, 2),
gr as (select *, sum(c) over (partition by trend order by score rows unbounded preceding) - c as r, sum(c) over (partition by trend) as n from gs),
gini as (select trend, case when max(n) >= 2 then sum(score * c * (2 * r + c - n)) / (max(n) * sum(score * c)) else 0 end as gini from gr group by trend),
days as (select trend, day, count(*) as n from posts group by 1, 2),
tops as (select trend, day, sum(score) / count(*) / 1000 as t from (select trend, day, score from posts qualify row_number() over (partition by trend, day order by score desc, id) <= 3) group by 1, 2),
lasts as (select *, row_number() over (partition by trend order by day desc) as k from days join tops using (trend, day)),
tr as (select trend, max(n) filter (k = 1) as c2, max(n) filter (k = 3) as c0, max(t) filter (k = 1) as t2, max(t) filter (k = 3) as t0 from lasts where k <= 3 group by trend having count(*) = 3),
pt as (select trend, count(*) as n, count_if(site = 'github') as repos, sum({counted('title', M.ALTERNATIVES)}) as alts, sum({counted('title', M.INTENT)}) as ints, count(distinct site) as sites from posts group by trend),
comp as (select trend, n, case when repos > 0 then round(least(1, 0.6 * least(repos / 30, 1) + 0.4 * (1 - coalesce(gini, 0))), 3) end::double as repo_density,
  round(least(1, alts / greatest(n, 1) / 0.5), 3)::double as alt_phrases,
  case when c0 is null then null when not (c2 > c0 or (t2 < t0 and t0 > 0)) then 0 else round(least(1, ((c2 - c0) / greatest(c0, 1) + case when t2 < t0 and t0 > 0 then (t0 - t2) / greatest(t0, 0.01) else 0 end) / 2), 3) end::double as volume_vs_quality,
  case when sites >= 2 then round(least(1, (sites - 1) / 4), 3) end::double as cross_source_redundancy, round(least(1, ints / greatest(n, 1) / 0.3), 3)::double as search_intent,
  coalesce(c2 > c0, false) as growing from pt left join gini using (trend) left join tr using (trend)),
sat0 as (select *, {' + '.join(f'({k} is not null)::int' for k in M.SATURATION)} as used, 1 + (repo_density is not null)::int + (volume_vs_quality is not null)::int + (cross_source_redundancy is not null)::int as kinds,
  ({' + '.join(f'coalesce({w} * {k}, 0)' for k, w in M.SATURATION.items())}) / ({' + '.join(f'case when {k} is null then 0 else {w} end' for k, w in M.SATURATION.items())}) as raw from comp),
sat as (select *, round(raw, 3)::double as saturation, case when used < 3 or kinds < 2 then 'uncertain' when raw < {M.LOW} then 'low' when raw <= {M.HIGH} then 'moderate' else 'high' end as level,
  round(case when used < 3 or kinds < 2 then least(0.6, 0.5 + 0.5 * used / 5) else 0.5 + 0.5 * used / 5 end, 3)::double as confidence from sat0)"""


def components(spark, d):
    """Per trend: what makes its market crowded, each part null where there is nothing to judge it by."""
    p = posts(spark, d)
    stars = p.filter((F.col("site") == "github") & (F.col("score") > 0)).groupBy("trend", "score").agg(n_rows().alias("c"))
    w = W.partitionBy("trend")
    stars = stars.withColumns({"r": F.sum("c").over(w.orderBy("score").rowsBetween(W.unboundedPreceding, 0)) - F.col("c"), "n": F.sum("c").over(w)})
    uneven = F.sum(F.col("score") * F.col("c") * (2 * F.col("r") + F.col("c") - F.col("n"))) / (F.max("n") * F.sum(F.col("score") * F.col("c")))
    gini = stars.groupBy("trend").agg(F.when(F.max("n") >= 2, uneven).otherwise(0.0).alias("gini"))
    tops = rows.top_k(p.select("id", "trend", "day", "score"), 3, F.desc("score"), F.asc("id"), keys=["trend", "day"])
    tops = tops.groupBy("trend", "day").agg((F.sum("score") / n_rows() / 1000).alias("t"))
    days = p.groupBy("trend", "day").agg(n_rows().alias("n")).join(tops, ["trend", "day"])
    last = days.withColumn("k", F.row_number().over(w.orderBy(F.desc("day")))).filter("k <= 3")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    trend = last.groupBy("trend").agg(at("n", 1).alias("c2"), at("n", 3).alias("c0"), at("t", 1).alias("t2"), at("t", 3).alias("t0"), n_rows().alias("points")).filter("points = 3").drop("points")
    title = F.col("title")
    own = p.groupBy("trend").agg(n_rows().alias("n"), F.count_if(F.col("site") == "github").alias("repos"), F.sum(M.count_of(title, M.ALTERNATIVES)).alias("alts"), F.sum(M.count_of(title, M.INTENT)).alias("ints"), F.count_distinct("site").alias("sites"))
    t = own.join(gini, "trend", "left").join(trend, "trend", "left")
    one, falling = F.lit(1.0), (F.col("t2") < F.col("t0")) & (F.col("t0") > 0)
    growth = (F.col("c2") - F.col("c0")) / F.greatest("c0", F.lit(1))
    drop = F.when(falling, (F.col("t0") - F.col("t2")) / F.greatest("t0", F.lit(0.01))).otherwise(0.0)
    return t.select(
        "trend",
        "n",
        F.when(F.col("repos") > 0, F.round(F.least(one, 0.6 * F.least(F.col("repos") / 30, one) + 0.4 * (1 - F.coalesce("gini", F.lit(0.0)))), 3)).alias("repo_density"),
        F.round(F.least(one, F.col("alts") / F.col("n") / 0.5), 3).alias("alt_phrases"),
        F.when(F.col("c0").isNull(), None).when(~((F.col("c2") > F.col("c0")) | falling), 0.0).otherwise(F.round(F.least(one, (growth + drop) / 2), 3)).alias("volume_vs_quality"),
        F.when(F.col("sites") >= 2, F.round(F.least(one, (F.col("sites") - 1) / 4), 3)).alias("cross_source_redundancy"),
        F.round(F.least(one, F.col("ints") / F.col("n") / 0.3), 3).alias("search_intent"),
        F.coalesce(F.col("c2") > F.col("c0"), F.lit(False)).alias("growing"),
    )


def saturation(t):
    """Adds used, saturation, level and confidence to ``components``."""
    has = {k: F.col(k).isNotNull() for k in M.SATURATION}
    used = sum((h.cast("int") for h in has.values()), F.lit(0))
    kinds = 1 + has["repo_density"].cast("int") + has["volume_vs_quality"].cast("int") + has["cross_source_redundancy"].cast("int")
    total = sum((F.coalesce(w * F.col(k), F.lit(0.0)) for k, w in M.SATURATION.items()), F.lit(0.0))
    weight = sum((F.when(has[k], w).otherwise(0.0) for k, w in M.SATURATION.items()), F.lit(0.0))
    t = t.withColumns({"used": used, "raw": total / weight, "unsure": (used < 3) | (kinds < 2)})
    level = F.when(F.col("unsure"), "uncertain").when(F.col("raw") < M.LOW, "low").when(F.col("raw") <= M.HIGH, "moderate").otherwise("high")
    sure = 0.5 + 0.5 * F.col("used") / 5
    return t.withColumns({"saturation": F.round("raw", 3), "level": level, "confidence": F.round(F.when(F.col("unsure"), F.least(F.lit(0.6), sure)).otherwise(sure), 3)})


@query("d18_saturation_components", sql_posts(f"select trend, n, {', '.join(M.SATURATION)} from comp", SAT))
def d18(spark, d):
    return components(spark, d).select("trend", "n", *M.SATURATION)


@query("d17_saturation_level", sql_posts("select trend, used, saturation, level, confidence from sat", SAT))
def d17(spark, d):
    return saturation(components(spark, d)).select("trend", "used", "saturation", "level", "confidence")


@query("d19_competition_effect", sql_posts(f"select trend, level, {mapped(M.MODIFIERS, 'level', 0.0)}::double as modifier, case when growing then 'early_edge' else 'too_early' end as timing, case when growing and level = 'high' then 'crowded' end as timing_override from sat", SAT))
def d19(spark, d):
    t = saturation(components(spark, d))
    timing = F.when(F.col("growing"), "early_edge").otherwise("too_early")
    return t.select("trend", "level", M.lookup(M.MODIFIERS, F.col("level"), 0.0).alias("modifier"), timing.alias("timing"), F.when(F.col("growing") & (F.col("level") == "high"), "crowded").alias("timing_override"))


WEDGE = "[" + ", ".join(f"{{'less': -round(least(0.9, 0.5 + sum({counted('title', p)}) * 0.1), 3)::double, 'k': {k}, 'name': {q(n)}, 'n': sum({counted('title', p)})::bigint}}" for k, (n, p) in enumerate(M.WEDGES.items())) + "]"


@query("f21_wedges", sql_posts(f"""select trend, level, array_to_string(list_transform(list_sort(list_filter(w, lambda x: x.n > 0))[:2], lambda x: x.name || ':' || x.n::varchar), ',') as candidates,
  case when level = 'high' then array_to_string(list_transform(list_sort(list_filter(w, lambda x: x.n > 0))[:2], lambda x: x.name), ',') else '' end as wedges from (select trend, {WEDGE} as w from posts group by trend) join sat using (trend)""", SAT))
def f21(spark, d):
    counts = posts(spark, d).groupBy("trend").agg(*[F.sum(M.count_of(F.col("title"), p)).alias(n) for n, p in M.WEDGES.items()])
    each = [F.struct((-F.round(F.least(F.lit(0.9), 0.5 + F.col(n) * 0.1), 3)).alias("less"), F.lit(k).alias("k"), F.lit(n).alias("name"), F.col(n).alias("n")) for k, n in enumerate(M.WEDGES)]
    top = F.slice(F.array_sort(F.filter(F.array(*each), lambda x: x["n"] > 0)), 1, 2)
    t = counts.select("trend", top.alias("w")).join(saturation(components(spark, d)).select("trend", "level"), "trend")
    told = F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), ",")
    return t.select("trend", "level", told.alias("candidates"), F.when(F.col("level") == "high", F.array_join(F.transform("w", lambda x: x["name"]), ",")).otherwise("").alias("wedges"))


NEAR = rf"(?i).{{0,30}}{M.FUNDING}.{{0,30}}"


@query("f22_market_entities", sql_posts(f"""select trend, coalesce(repos, '') as repos, coalesce(tools, '') as tools, coalesce(funding, '') as funding, coalesce(n_repos, 0) + coalesce(n_tools, 0) as solutions,
  case when coalesce(n_repos, 0) + coalesce(n_tools, 0) + coalesce(n_funding, 0) >= 5 then 'high' when coalesce(n_repos, 0) + coalesce(n_tools, 0) + coalesce(n_funding, 0) >= 2 then 'medium' else 'low' end as confidence
  from (select distinct trend from posts) left join (select trend, array_to_string(list(x order by x)[:20], ',') as repos, count(*) as n_repos from (select distinct trend, lower(x) as x from (select trend, unnest(regexp_extract_all(t, {q(M.REPOSITORY)}, 1)) as x from txt)) group by trend) using (trend)
  left join (select trend, array_to_string(list(x order by x)[:15], ',') as tools, count(*) as n_tools from (select distinct trend, x from (select trend, unnest(regexp_extract_all(t, {q(M.TOOL)}, 1)) as x from txt) where length(x) >= 2 and lower(x) not in {listed(M.GENERIC)}) group by trend) using (trend)
  left join (select trend, array_to_string(list(x order by first, x), ' | ') as funding, count(*) as n_funding from (select trend, x, min(id) as first from (select trend, id, substr(trim(unnest(regexp_extract_all(t, {q(NEAR)}))), 1, 120) as x from txt) group by 1, 2 qualify row_number() over (partition by trend order by min(id), x) <= 5) group by trend) using (trend)""",
  "txt as (select id, trend, title || ' ' || substr(body, 1, 500) as t from posts)"))
def f22(spark, d):
    text = posts(spark, d).select("id", "trend", F.concat(F.col("title"), F.lit(" "), F.substring("body", 1, 500)).alias("t"))
    each = lambda p, k: text.select("id", "trend", F.explode(F.regexp_extract_all("t", F.lit(p), F.lit(k))).alias("x"))

    def listed_of(t, name: str, most: int):
        first = rows.top_k(t, most, F.asc("x"), keys=["trend"]).groupBy("trend").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias(name))
        return t.groupBy("trend").agg(n_rows().alias(f"n_{name}")).join(first, "trend")

    repos = listed_of(each(M.REPOSITORY, 1).select("trend", F.lower("x").alias("x")).distinct(), "repos", 20)
    tools = listed_of(each(M.TOOL, 1).filter((F.length("x") >= 2) & ~F.lower("x").isin(M.GENERIC)).select("trend", "x").distinct(), "tools", 15)
    money = each(NEAR, 0).select("id", "trend", F.substring(F.trim("x"), 1, 120).alias("x")).groupBy("trend", "x").agg(F.min("id").alias("first"))
    money = rows.top_k(money, 5, F.asc("first"), F.asc("x"), keys=["trend"]).groupBy("trend").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda s: s["x"]), " | ").alias("funding"), n_rows().alias("n_funding"))
    t = text.select("trend").distinct().join(repos, "trend", "left").join(tools, "trend", "left").join(money, "trend", "left").fillna(0).fillna("")
    every = F.col("n_repos") + F.col("n_tools") + F.col("n_funding")
    return t.select("trend", "repos", "tools", "funding", (F.col("n_repos") + F.col("n_tools")).alias("solutions"), F.when(every >= 5, "high").when(every >= 2, "medium").otherwise("low").alias("confidence"))


@query("f23_pain_phrases_typed", sql_posts(" union all ".join(f"""select id, {k} as pattern, {q(kind)} as phrase_type, substr(m, 1, 100) as matched, n,
  substr(case when a > 1 then '...' else '' end || trim(substr(t, a, b - a)) || case when b <= length(t) then '...' else '' end, 1, 200) as phrase from (select *, greatest(1, pos - 30) as a, least(length(t) + 1, pos + length(m) + 90) as b from
  (select *, instr(t, m) as pos from (select id, t, regexp_extract(t, {q('(?i)' + p)}) as m, len(regexp_extract_all(t, {q('(?i)' + p)}))::bigint as n from txt) where n > 0))""" for k, (p, kind) in enumerate(M.PAIN)), "txt as (select id, title || '. ' || body as t from posts)"))
def f23(spark, d):
    t = posts(spark, d).select("id", F.concat(F.col("title"), F.lit(". "), F.col("body")).alias("t"))
    # each text is read once by a pattern, and not at all where it holds none of the words that the pattern asks for
    t = t.withColumn("low", F.lower("t"))
    holds = lambda words: functools.reduce(operator.or_, [F.contains(F.col("low"), F.lit(w)) for w in words])
    seen = [F.when(holds(words), F.regexp_extract_all("t", F.lit("(?i)" + p), F.lit(0))) for (p, _), words in zip(M.PAIN, M.PAIN_WORDS, strict=True)]
    e = t.select("id", "t", F.posexplode(F.array(*seen)).alias("pattern", "all")).filter("size(all) > 0")
    kinds = M.strings(*[kind for _, kind in M.PAIN])
    e = e.select("id", "t", "pattern", F.element_at(kinds, F.col("pattern") + 1).alias("phrase_type"), F.col("all")[0].alias("m"), F.size("all").cast("long").alias("n")).withColumn("at", F.instr("t", F.col("m")))
    e = e.withColumns({"a": F.greatest(F.lit(1), F.col("at") - 30), "b": F.least(F.length("t") + 1, F.col("at") + F.length("m") + 90)})
    phrase = F.concat(F.when(F.col("a") > 1, "...").otherwise(""), F.trim(F.substring("t", F.col("a"), F.col("b") - F.col("a"))), F.when(F.col("b") <= F.length("t"), "...").otherwise(""))
    return e.select("id", "pattern", "phrase_type", F.substring("m", 1, 100).alias("matched"), "n", F.substring(phrase, 1, 200).alias("phrase"))


@query("f24_audience_flags", sql_posts(f"select trend, count_if(regexp_matches(title, {q('(?i)' + M.AUDIENCE_PAIN)})) as pain, round(count_if(regexp_matches(title, {q('(?i)' + M.MONEY)})) / count(*), 6) as monetisation from posts group by trend"))
def f24(spark, d):
    has = lambda p: F.count_if(F.col("title").rlike("(?i)" + p))
    return posts(spark, d).groupBy("trend").agg(has(M.AUDIENCE_PAIN).alias("pain"), F.round(has(M.MONEY) / n_rows(), 6).alias("monetisation"))


KINDS = {"execution": (M.EXECUTION, "saas"), "sales": (M.SALES, "self_serve"), "moat": (M.MOATS, "none_yet"), "risk": (M.RISKS, "none"), "load": (M.LOADS, "hobby")}


@query("f25_best_kinds", sql_posts(f"select id, {', '.join(f'{best("lower(title)", kinds, default)} as {name}' for name, (kinds, default) in KINDS.items())} from posts"))
def f25(spark, d):
    return posts(spark, d).select("id", *[M.best_kind(F.lower("title"), kinds, default).alias(name) for name, (kinds, default) in KINDS.items()])


STACKED = "list_filter([" + ", ".join(f"case when regexp_matches({{t}}, {q('(?i)' + p)}) then {q(n)} end" for n, p in M.STACK.items()) + "], lambda x: x is not null)"


@query("f26_required_stack_of_posts", sql_posts(f"select id, array_to_string({STACKED.replace('{t}', 'title')}, ',') as stack from posts"))
def f26(spark, d):
    return posts(spark, d).select("id", F.array_join(M.stack(F.col("title")), ",").alias("stack"))


@query("f28_keyword_match", sql_posts(f"select id, {', '.join(f'least({held("lower(title)", words)} / {max(len(words), 3)}, 1)::double as {name}' for name, words in M.ROLES.items())} from posts"))
def f28(spark, d):
    return posts(spark, d).select("id", *[M.keyword_match(F.lower("title"), words).alias(name) for name, words in M.ROLES.items()])


AVOID = ["docker", "enterprise", "course", "too slow"]


@query("f29_avoid_penalty", sql_posts(f"select id, least(1, 0.5 * {held('lower(title)', AVOID)})::double as graded, ({held('lower(title)', AVOID)} > 0)::int::double as any_topic from posts"))
def f29(spark, d):
    n = M.hits(F.lower("title"), AVOID)
    return posts(spark, d).select("id", F.least(F.lit(1.0), 0.5 * n).alias("graded"), (n > 0).cast("double").alias("any_topic"))


MIGRATION = [(r"from\s+(\w+)", 0), (r"to\s+(\w+)", 0), (r"(\w+)\s+to\s+(\w+)", 0)]
TARGET = [(r"alternative\s+to\s+(\w+)", 1), (r"(\w+)\s+alternative", 1), (r"self[- ]?hosted?\s+(\w+)", 1)]
firsts = lambda told, t: "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {q(p)}, {k}), '')" for p, k in told) + ")"
some = lambda t, words: "(" + " or ".join(f"contains({t}, {q(w)})" for w in words) + ")"
HOSTED, PACKAGE, LIBRARY = ["hosted", "cloud", "saas", "managed"], ["library", "sdk", "package", "client", "wrapper"], ["library", "sdk", "package", "framework"]


@query("f30_actions", sql_posts(f"""select trend, array_to_string(list_filter(list_filter([case when mig is not null then 'Create migration tooling for ' || trend || ' (' || mig || ')' end,
  case when target is not null then 'Build self-hosted alternative to ' || target || ' using ' || trend when hosted then 'Build self-hosted or open-source alternative for ' || trend end,
  case when lang is not null then 'Build ' || upper(lang[1]) || lang[2:] || ' SDK/client library for ' || trend when lib then 'Build SDK or client library for ' || trend end], lambda x: x is not null), lambda x: not {some('lower(x)', M.VAGUE)}), '; ') as actions
  from (select trend, arg_min(mig, id) filter (mig is not null) as mig, arg_min(target, id) filter (target is not null) as target, arg_min(lang, id) filter (lang is not null) as lang, bool_or(hosted) as hosted, bool_or(lib) as lib from (select id, trend,
    case when contains(t, 'migrat') then {firsts(MIGRATION, 't')} end as mig, case when {some('t', ['alternative', 'self-host', 'self host'])} then {firsts(TARGET, 't')} end as target,
    case when {some('t', PACKAGE)} then case {' '.join(f"when contains(t, '{x}') then '{x}'" for x in M.LANGUAGES)} end end as lang, {some('t', HOSTED)} as hosted, {some('t', LIBRARY)} as lib from (select id, trend, lower(title) as t from posts)) group by trend)"""))
def f30(spark, d):
    t = F.lower("title")
    has = lambda words: F.coalesce(M.hits(t, words) > 0, F.lit(False))
    first = lambda told: F.coalesce(*[F.nullif(F.regexp_extract(t, p, k), F.lit("")) for p, k in told])
    lang = F.when(t.contains(M.LANGUAGES[0]), M.LANGUAGES[0])
    for x in M.LANGUAGES[1:]:
        lang = lang.when(t.contains(x), x)
    p = posts(spark, d).select("id", "trend", F.when(t.contains("migrat"), first(MIGRATION)).alias("mig"), F.when(has(["alternative", "self-host", "self host"]), first(TARGET)).alias("target"), F.when(has(PACKAGE), lang).alias("lang"), has(HOSTED).alias("hosted"), has(LIBRARY).alias("lib"))
    one = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    g = p.groupBy("trend").agg(one("mig"), one("target"), one("lang"), F.bool_or("hosted").alias("hosted"), F.bool_or("lib").alias("lib"))
    made = F.array_compact(
        F.array(
            F.concat(F.lit("Create migration tooling for "), "trend", F.lit(" ("), "mig", F.lit(")")),
            F.when(F.col("target").isNotNull(), F.concat(F.lit("Build self-hosted alternative to "), "target", F.lit(" using "), "trend")).when(F.col("hosted"), F.concat(F.lit("Build self-hosted or open-source alternative for "), "trend")),
            F.when(F.col("lang").isNotNull(), F.concat(F.lit("Build "), F.initcap("lang"), F.lit(" SDK/client library for "), "trend")).when(F.col("lib"), F.concat(F.lit("Build SDK or client library for "), "trend")),
        )
    )
    return g.select("trend", F.array_join(F.filter(made, lambda x: M.hits(F.lower(x), M.VAGUE) == 0), "; ").alias("actions"))


TALK = "talk as (select conv_id, turn, role, coalesce(text, '') as text, coalesce(lag(text) over (partition by conv_id order by turn), '') as context from conversations)"


def talk(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("context"))


@query("f34_grounded_claims", f"""with {TALK} select conv_id, turn, round(share, 6)::double as supported, share >= 0.6 as grounded from (select conv_id, turn, case when len(claims) = 0 then 1 else
  len(list_filter(claims, lambda w: len(w) = 0 or len(list_filter(w, lambda x: contains(lower(context), x))) >= 0.2 * len(w))) / len(claims) end as share from (select conv_id, turn, context,
  list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 20 and regexp_matches(s, {q('(?i)' + M.ASSERTION)})), lambda s: list_filter(regexp_split_to_array(regexp_replace(lower(s), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 4)) as claims
  from talk where role = 'assistant'))""")
def f34(spark, d):
    t = talk(spark, d).filter("role = 'assistant'").withColumn("share", M.supported_share(F.col("text"), F.col("context")))
    return t.select("conv_id", "turn", F.round("share", 6).alias("supported"), (F.col("share") >= 0.6).alias("grounded"))


@query("f35_feasibility_guard", f"""with {TALK} select conv_id, turn, len(w)::bigint as n_words, len(w) >= 3 and len(list_filter(w, lambda x: contains(lower(context), x))) < 0.15 * len(w) as triggered from (select conv_id, turn, context,
  list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 4 and x not in {listed(M.QUESTION_WORDS)}) as w from talk where role = 'user')""")
def f35(spark, d):
    t = talk(spark, d).filter("role = 'user'").withColumn("w", F.filter(M.grounded_words(F.col("text")), lambda x: ~x.isin(M.QUESTION_WORDS)))
    near = F.size(F.filter("w", lambda x: F.contains(F.lower("context"), x)))
    return t.select("conv_id", "turn", F.size("w").cast("long").alias("n_words"), ((F.size("w") >= 3) & (near < 0.15 * F.size("w"))).alias("triggered"))


def tagged(kinds, most: int) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when bool_or({some('lower(title)', words)}) then {q(n)} end" for n, words in kinds.items()) + f"], lambda x: x is not null)[:{most}], ',')"


TAGS = {"niches": ({n: [n] for n in M.NICHES}, 5), "styles": ({n: [n] for n in M.STYLES}, 4), "earning": (M.EARNING, 99)}


@query("f38_creator_tags", sql_posts(f"select trend, {', '.join(f'{tagged(*v)} as {k}' for k, v in TAGS.items())} from posts group by trend"))
def f38(spark, d):
    shown = lambda kinds, most: F.array_join(F.slice(F.array_compact(F.array(*[F.when(F.bool_or(M.hits(F.lower("title"), words) > 0), F.lit(n)) for n, words in kinds.items()])), 1, most), ",")
    return posts(spark, d).groupBy("trend").agg(*[shown(*v).alias(k) for k, v in TAGS.items()])


LOWER = f"low as (select id, lower(title) as t, [{', '.join(map(q, LEVELS))}][id % 4 + 1] as level from posts)"
NEEDS = f"""{LOWER}, kinds as (select *, {best('t', M.EXECUTION, 'saas')} as execution_type, {best('t', M.SALES, 'self_serve')} as sales_motion, {best('t', M.LOADS, 'hobby')} as infra_cost, {ranked('t', M.MOATS)} as moats from low),
need as (select *, case when level = 'high' then floor(bmin * 1.5) else bmin end::int as build_min, case when level = 'high' then floor(bmax * 1.5) else bmax end::int as build_max, case when sales_motion = 'enterprise' then greatest(tmin, 2) else tmin end as team_min,
  case when sales_motion = 'enterprise' then greatest(tmax, 4) else tmax end as team_max, {STACKED.replace('{t}', 't')} as stack from (select *, {mapped(M.BUILD_MIN, 'execution_type', 4)} as bmin, {mapped(M.BUILD_MAX, 'execution_type', 12)} as bmax, {mapped(M.UPKEEP, 'execution_type', 'medium')} as upkeep,
  {mapped(M.COMPLEXITY, 'execution_type', 3)} as complexity, {mapped(M.TEAM_MIN, 'execution_type', 1)} as tmin, {mapped(M.TEAM_MAX, 'execution_type', 3)} as tmax from kinds)),
moat as (select *, case when len(moats) >= 2 and -moats[1].less >= 3 then 'strong' when len(moats) >= 1 and -moats[1].less >= 2 then 'moderate' when len(moats) = 1 and moats[1].name = 'speed_wedge' then 'temporary' when len(moats) = 0 then 'none' else 'weak' end as strength from need),
risk as (select *, list_sort(list_distinct({found('t', M.RISKS)} || list_filter([case when sales_motion = 'enterprise' then 'enterprise_sales_required' end, case when complexity >= 4 then 'infra_heavy' end, case when level = 'high' and strength in ('none', 'weak') then 'crowded_with_funding' end,
  case when strength in ('none', 'temporary') then 'low_switching_costs' end, case when sales_motion in ('outbound', 'enterprise') then 'requires_distribution_edge' end], lambda x: x is not null))) as flags from moat),
arch as (select *, case when sales_motion = 'enterprise' and team_max >= 4 then 'vc_scale_only' when execution_type = 'infra' or complexity >= 4 then 'infra_play' when (execution_type in ('marketplace', 'content') or list_contains(flags, 'requires_distribution_edge')) and team_max <= 2 then 'distribution_game'
  when team_max >= 3 then 'team_required' when team_max = 1 and build_max <= 6 then 'solo_feasible_mvp' else 'indie_saas_bet' end as archetype from risk)"""
NEEDED = ["execution_type", "sales_motion", "infra_cost", "build_min", "build_max", "upkeep", "complexity", "team_min", "team_max"]


def needs(spark, d):
    """Posts with what it takes to build them, their defences, risks and archetype."""
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("id") % 4 + 1).cast("int"))
    t = posts(spark, d).select("id", F.lower("title").alias("t"), level.alias("level"))
    low = F.col("t")
    t = t.withColumns({"execution_type": M.best_kind(low, M.EXECUTION, "saas"), "sales_motion": M.best_kind(low, M.SALES, "self_serve"), "infra_cost": M.best_kind(low, M.LOADS, "hobby"), "stack": M.stack(low), "moats": M.scores(low, M.MOATS)})
    t = t.withColumns(M.requirements(F.col("execution_type"), F.col("sales_motion"), F.col("level"))).withColumn("strength", M.moat_strength(F.col("moats")))
    t = t.withColumn("flags", M.risk_flags(F.col("t"), F.col("sales_motion"), F.col("complexity"), F.col("level"), F.col("strength")))
    return t.withColumn("archetype", M.execution_archetype(F.col("execution_type"), F.col("sales_motion"), F.col("complexity"), F.col("team_max"), F.col("build_max"), F.col("flags")))


@query("d20_requirements", sql_posts(f"select id, level, {', '.join(NEEDED)}, array_to_string(stack, ',') as stack from need", NEEDS))
def d20(spark, d):
    return needs(spark, d).select("id", "level", *NEEDED, F.array_join("stack", ",").alias("stack"))


MOAT_RISK = {"none": "No defensibility detected — easily replicated", "temporary": "Timing advantage only — will erode without additional moats"}


@query("d21_moat_risk_archetype", sql_posts(f"""select id, array_to_string(case when len(moats) = 0 then ['none_yet'] else list_transform(moats[:3], lambda x: x.name) end, ',') as moats, strength,
  case when strength = 'none' then {q(MOAT_RISK['none'])} when strength = 'temporary' then {q(MOAT_RISK['temporary'])} when level = 'high' then 'Moat signals present but competition is high — execution speed critical' else 'Defensibility signals present' end as moat_risk,
  array_to_string(flags, ',') as flags, archetype from arch""", NEEDS))
def d21(spark, d):
    names = F.when(F.size("moats") == 0, M.strings("none_yet")).otherwise(F.transform(F.slice("moats", 1, 3), lambda x: x["name"]))
    risk = F.when(F.col("strength").isin("none", "temporary"), M.lookup(MOAT_RISK, F.col("strength"), "")).when(F.col("level") == "high", "Moat signals present but competition is high — execution speed critical").otherwise("Defensibility signals present")
    return needs(spark, d).select("id", F.array_join(names, ",").alias("moats"), "strength", risk.alias("moat_risk"), F.array_join("flags", ",").alias("flags"), "archetype")


CATEGORIES, PERSONAS = list(M.PLAYBOOKS), list(M.BY_PERSONA)
chosen = lambda by, key, default: f"case {key} " + " ".join(f"when {q(k)} then [{', '.join(map(q, v))}]::varchar[]" for k, v in by.items()) + f" else [{', '.join(map(q, default))}]::varchar[] end"


@query("d41_playbooks", sql_posts(f"""select id, array_to_string(list_transform(list_filter(list_transform(range(1, len(a) + 1), lambda i: case when list_position(a, a[i]) = i then a[i] end), lambda x: x is not null)[:3], lambda x: x || ': ' || t), ' | ') as playbooks from (select id, t,
  ['user_interviews'] || {chosen(M.BY_COMPETITION, 'level', [])} || {chosen(M.BY_PERSONA, 'persona', [])} || {chosen(M.PLAYBOOKS, 'category', M.PLAYBOOKS['other'])} || [{', '.join(map(q, M.FILL_UP))}] as a
  from (select id, t, level, [{', '.join(map(q, PERSONAS))}][id % 3 + 1] as persona, [{', '.join(map(q, CATEGORIES))}][id % 9 + 1] as category from low))""", LOWER))
def d41(spark, d):
    at = lambda values: F.element_at(M.strings(*values), (F.col("id") % len(values) + 1).cast("int"))
    found = M.playbooks(at(CATEGORIES), at(LEVELS), at(PERSONAS))
    return posts(spark, d).select("id", F.array_join(F.transform(found, lambda x: F.concat_ws(": ", x, F.lower("title"))), " | ").alias("playbooks"))


# People of a team, and weeks of a horizon.
TEAMS = {"solo": 1, "small": 3, "company": 10}
WEEKS = {"weekend": 1, "1-2_weeks": 2, "1-3_months": 12, "flexible": 52}
INFRA_FIT = {"free_tier": 1.0, "hobby": 0.9, "startup": 0.7, "growth": 0.4, "enterprise": 0.2}
SKILLS = [["python", "postgres", "docker"], ["react", "node"], ["golang", "kubernetes", "redis"], []]
pick = lambda values, key: f"[{', '.join(map(q, values))}][{key} % {len(values)} + 1]"
FIT = f"""{NEEDS}, pair as (select distinct o_custkey as u, l_partkey as part, l_partkey % (select count(*) from documents) as id from lineitem join orders on o_orderkey = l_orderkey),
usr as (select c_custkey as u, {pick(TEAMS, 'c_custkey')} as team, {pick(WEEKS, 'c_nationkey')} as horizon, [{', '.join('[' + ', '.join(map(q, s)) + ']::varchar[]' for s in SKILLS)}][c_custkey % 4 + 1] as skills, c_mktsegment = 'BUILDING' as founder from customer),
fit0 as (select *, {mapped(TEAMS, 'team', 1)} as people, {mapped(WEEKS, 'horizon', 12)} as weeks, len(list_intersect(stack, skills)) as overlap from pair join usr using (u) join arch using (id)),
fit1 as (select *, case when people >= team_min then 1.0 when people >= team_min - 1 then 0.6 else 0.2 end as team_fit, case when weeks >= build_min then least(1, weeks / greatest(build_min, 1)) else greatest(0.1, weeks / greatest(build_min, 1)) end as time_fit,
  case when len(stack) = 0 then 0.7 when len(skills) = 0 then 0.5 else overlap / len(stack) end as skill, case when execution_type in ('developer_tool', 'integration', 'api_service') and team = 'solo' then 0.9 when execution_type in ('marketplace', 'infra') and team = 'solo' then 0.3 else 0.7 end as type_fit,
  case when sales_motion in ('self_serve', 'community_led') then 0.9 when sales_motion = 'outbound' and not founder then 0.3 when sales_motion = 'enterprise' then 0.2 else 0.7 end as sales_fit, {mapped(INFRA_FIT, 'infra_cost', 0.5)} as infra_fit from fit0),
fit as (select *, round((0.2 * team_fit + 0.2 * time_fit + 0.2 * skill + 0.15 * type_fit + 0.15 * sales_fit + 0.1 * infra_fit)::double, 6) as feasibility, list_filter([case when people < team_min - 1 then 'team_too_small' when people < team_min then 'team_size_tight' end, case when weeks < build_min then 'time_too_short' end,
  case when len(stack) > 0 and len(skills) > 0 and overlap < 0.5 * len(stack) then 'skill_gap' end, case when execution_type in ('marketplace', 'infra') and team = 'solo' then execution_type || '_hard_for_solo' end,
  case when sales_motion = 'outbound' and not founder then 'outbound_sales_required' when sales_motion = 'enterprise' then 'enterprise_sales_required' end, case when infra_cost in ('growth', 'enterprise') then 'high_infra_cost' end], lambda x: x is not null) as blockers from fit1)"""


def fits(spark, d, of_post=None):
    """Feasibility of every part's post for every customer who has ordered the part: score, parts and blocking factors; ``returned``: whether any was sent back.

    Columns ``of_post``, of a post alone, are made once for each post, not for each of its pairs.
    """
    li, o = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("r")), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("u"))
    n = table(spark, d, "documents").count()
    pair = li.join(o, "l_orderkey").groupBy("u", "part").agg(F.bool_or("r").alias("returned")).withColumn("id", F.col("part") % n)
    at = lambda values, key: F.element_at(F.array(*values), (key % len(values) + 1).cast("int"))
    named = lambda values: [F.lit(v) for v in values]
    c = F.col("c_custkey")
    usr = table(spark, d, "customer").select(c.alias("u"), at(named(TEAMS), c).alias("team"), at(named(WEEKS), F.col("c_nationkey")).alias("horizon"), at([M.strings(*s) for s in SKILLS], c).alias("skills"), (F.col("c_mktsegment") == "BUILDING").alias("founder"))
    t = pair.join(usr, "u").join(needs(spark, d).withColumns(of_post or {}), "id")
    t = t.withColumns({"people": M.lookup(TEAMS, F.col("team"), 1), "weeks": M.lookup(WEEKS, F.col("horizon"), 12), "overlap": F.size(F.array_intersect("stack", "skills"))})
    kind, sales, solo, asked = F.col("execution_type"), F.col("sales_motion"), F.col("team") == "solo", F.size("stack")
    reach = F.col("weeks") / F.greatest("build_min", F.lit(1))
    short, hard, out = F.col("weeks") < F.col("build_min"), kind.isin("marketplace", "infra") & solo, (sales == "outbound") & ~F.col("founder")
    team = F.when(F.col("people") >= F.col("team_min"), 1.0).when(F.col("people") >= F.col("team_min") - 1, 0.6).otherwise(0.2)
    time = F.when(short, F.greatest(F.lit(0.1), reach)).otherwise(F.least(F.lit(1.0), reach))
    skill = F.when(asked == 0, 0.7).when(F.size("skills") == 0, 0.5).otherwise(F.col("overlap") / asked)
    kinds = F.when(kind.isin("developer_tool", "integration", "api_service") & solo, 0.9).when(hard, 0.3).otherwise(0.7)
    sold = F.when(sales.isin("self_serve", "community_led"), 0.9).when(out, 0.3).when(sales == "enterprise", 0.2).otherwise(0.7)
    score = 0.2 * team + 0.2 * time + 0.2 * skill + 0.15 * kinds + 0.15 * sold + 0.1 * M.lookup(INFRA_FIT, F.col("infra_cost"), 0.5)
    blockers = F.array_compact(
        F.array(
            F.when(F.col("people") < F.col("team_min") - 1, "team_too_small").when(F.col("people") < F.col("team_min"), "team_size_tight"),
            F.when(short, "time_too_short"),
            F.when((asked > 0) & (F.size("skills") > 0) & (F.col("overlap") < 0.5 * asked), "skill_gap"),
            F.when(hard, F.concat(kind, F.lit("_hard_for_solo"))),
            F.when(out, "outbound_sales_required").when(sales == "enterprise", "enterprise_sales_required"),
            F.when(F.col("infra_cost").isin("growth", "enterprise"), "high_infra_cost"),
        )
    )
    return t.withColumns({"feasibility": F.round(score, 6), "blockers": blockers})


@query("d22_feasibility_pairs", sql_posts("select u, part, feasibility, array_to_string(blockers, ',') as blockers from fit", FIT))
def d22(spark, d):
    return fits(spark, d).select("u", "part", "feasibility", F.array_join("blockers", ",").alias("blockers"))


@query("d49_fit_summary", sql_posts("""select u, part, case when feasibility >= 0.8 and len(blockers) = 0 then 'Strong execution fit for ' || execution_type when feasibility >= 0.6 then 'Technically feasible' || case when sales_motion in ('self_serve', 'community_led') then '' else ' (' || sales_motion || ' motion)' end || ' with manageable gaps'
  when feasibility >= 0.4 then 'Feasible but challenging — ' || len(blockers)::varchar || ' blocking factor(s)' else 'Significant execution gaps — ' || len(blockers)::varchar || ' blocking factor(s)' end as summary from fit""", FIT))
def d49(spark, d):
    n, motion = F.size("blockers").cast("string"), F.when(F.col("sales_motion").isin("self_serve", "community_led"), "").otherwise(F.concat(F.lit(" ("), "sales_motion", F.lit(" motion)")))
    text = (
        F.when((F.col("feasibility") >= 0.8) & (F.size("blockers") == 0), F.concat(F.lit("Strong execution fit for "), "execution_type"))
        .when(F.col("feasibility") >= 0.6, F.concat(F.lit("Technically feasible"), motion, F.lit(" with manageable gaps")))
        .when(F.col("feasibility") >= 0.4, F.concat(F.lit("Feasible but challenging — "), n, F.lit(" blocking factor(s)")))
        .otherwise(F.concat(F.lit("Significant execution gaps — "), n, F.lit(" blocking factor(s)")))
    )
    return fits(spark, d).select("u", "part", text.alias("summary"))


@query("d23_verdict_of_pairs", sql_posts("""select u, part, case when v = 'strong_fit' and level = 'high' and strength in ('none', 'weak') then 'conditional_fit' when v = 'conditional_fit' and level = 'high' and strength in ('none', 'weak') and feasibility < 0.6 then 'high_risk' else v end as verdict from (select *,
  case when feasibility >= 0.7 and len(flags) <= 1 and len(blockers) = 0 then case when part % 2 = 0 then 'strong_fit' else 'conditional_fit' end when feasibility >= 0.5 and len(blockers) <= 2 then 'conditional_fit' when feasibility >= 0.3 then 'high_risk' else 'execution_mismatch' end as v from fit)""", FIT))
def d23(spark, d):
    s, bare = F.col("feasibility"), (F.col("level") == "high") & F.col("strength").isin("none", "weak")
    first = F.when((s >= 0.7) & (F.size("flags") <= 1) & (F.size("blockers") == 0), F.when(F.col("part") % 2 == 0, "strong_fit").otherwise("conditional_fit")).when((s >= 0.5) & (F.size("blockers") <= 2), "conditional_fit").when(s >= 0.3, "high_risk").otherwise("execution_mismatch")
    t = fits(spark, d).withColumn("v", first)
    return t.select("u", "part", F.when(bare & (F.col("v") == "strong_fit"), "conditional_fit").when(bare & (F.col("v") == "conditional_fit") & (s < 0.6), "high_risk").otherwise(F.col("v")).alias("verdict"))
