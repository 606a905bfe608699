"""Topic phrases of posts, their index and the trends that they make; intents and role matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions import market as M
from sigmill.functions import phrases as P
from sigmill.operators import dedup, trends
from sigmill.plans.market import held
from sigmill.plans.scalars import listed, q
from sigmill.registry import query
from sigmill.sources.posts import posts, sql_posts



def norm(x: str) -> str:
    return f"case {x} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in P.FORMS.items()) + f" else {x} end"


TOPICS = f"""cl as (select id, trend, clean, string_split(clean, ' ') as w from (select id, trend, trim(regexp_replace(regexp_replace(lower(title), '[^\\w\\s\\-+#.]', ' ', 'g'), '\\s+', ' ', 'g')) as clean from posts)),
tl as (select id, trend, list_filter([{', '.join(f"case when contains(clean, {q(p)}) then {q(P.FORMS.get(p.replace(' ', '-'), p.replace(' ', '-')))} end" for p in P.COMPOUNDS)}], lambda x: x is not null) as whole,
  list_transform(list_filter(list_transform(w, lambda x: trim(x, '.-')), lambda x: {norm('x')} in {listed(P.TERMS)} or x in {listed(P.TERMS)}), lambda x: {norm('x')}) as terms,
  list_transform(list_filter(w, lambda x: length(x) > 2 and x not in {listed(P.STOP)}), lambda x: {norm('x')}) as t from cl),
tp as (select id, trend, list_sort(list_distinct(whole || terms || list_transform(list_filter(range(1, len(t)), lambda i: t[i] in {listed(P.TERMS)} or t[i + 1] in {listed(P.TERMS)} or (length(t[i]) > 4 and length(t[i + 1]) > 4)), lambda i: t[i] || '-' || t[i + 1]))) as topics from tl)"""


def topics(spark, d):
    return posts(spark, d).select("id", "trend", P.topic_phrases(F.col("title")).alias("topics"))


@query("f07_topic_phrases", sql_posts("select id, array_to_string(topics, ',') as topics from tp", TOPICS))
def f07(spark, d):
    return topics(spark, d).select("id", F.array_join("topics", ",").alias("topics"))


@query("f08_normal_forms", sql_posts(f"select id, array_to_string(list_transform(string_split(lower(title), ' '), lambda x: {norm('x')}), ' ') as words from posts"))
def f08(spark, d):
    return posts(spark, d).select("id", F.array_join(F.transform(F.split(F.lower("title"), " "), P.normal), " ").alias("words"))


@query("d03_topic_index", sql_posts("select phrase, count(*) as n, min(id) as first from (select id, unnest(topics) as phrase from tp) group by phrase having count(*) >= 2", TOPICS))
def d03(spark, d):
    return dedup.phrase_index(topics(spark, d), "id", "topics")


@query("d03_merged_trends")
def d03_merged(spark, d):
    """Phrases that posts share, merged from the most common one on; the thirty largest groups."""
    return trends.trend_groups(topics(spark, d), "id", "topics")


INTENTS = [
    ("top_signals", r"\b(top|best|most (popular|engaged|upvoted|viewed|mentioned)|highest)\b"),
    ("source_breakdown", r"\b(source|platform|where|which site|subreddit|forum|community)\b"),
    ("timeline", r"\b(when|timeline|history|first|started|began|date|oldest|earliest|latest)\b"),
    ("persona", r"\b(who|person|people|creator|developer|persona|audience|user|engineer|target|affected)\b"),
    ("persona", r"\b(this for|meant for|aimed at|designed for)\b"),
]


@query("f33_intent_of_posts", sql_posts(f"select id, case {' '.join(f'when regexp_matches(lower(title), {q(p)}) then {q(n)}' for n, p in INTENTS)} else 'recent' end as intent from posts"))
def f33(spark, d):
    out = F.lit("recent")
    for name, p in reversed(INTENTS):
        out = F.when(F.lower("title").rlike(p), name).otherwise(out)
    return posts(spark, d).select("id", out.alias("intent"))


WANTED = [("developer", "founder"), ("marketer", "creator", "researcher"), ("developer",), ()]


@query("f27_role_share", sql_posts(f"select id, case id % 4 {' '.join(f'''when {k} then {('(' + ' + '.join(f'({held("lower(title)", M.ROLES[r])} > 0)::int' for r in w) + f') / {len(w)}') if w else 0.5}''' for k, w in enumerate(WANTED))} end::double as share from posts"))
def f27(spark, d):
    low = F.lower("title")
    share = F.lit(0.5)
    for k, wanted in enumerate(WANTED):
        if wanted:
            some = sum(((M.hits(low, M.ROLES[r]) > 0).cast("int") for r in wanted), F.lit(0))
            share = F.when(F.col("id") % 4 == k, some / len(wanted)).otherwise(share)
    return posts(spark, d).select("id", share.alias("share"))


@query("d47_creator_persona_by_posts", sql_posts("""select trend, case when avg(score) > 500 then 'macro' when avg(score) > 100 then 'mid' when avg(score) > 10 then 'micro' else 'nano' end as size, (select first(site order by k desc, site) from (select p.site, count(*) as k from posts p where p.trend = posts.trend group by 1)) as platform,
  count_if(regexp_matches(title, '(?i)how (do|can|to) ')) as how_to, count_if(regexp_matches(title, '(?i)(struggling|struggle) with ')) as struggle, count_if(regexp_matches(title, '(?i)(need|want) (more|better) ')) as unmet, count_if(regexp_matches(title, '(?i)(tired|sick) of ')) as tired from posts group by trend"""))
def d47(spark, d):
    p = posts(spark, d)
    site = p.groupBy("trend", "site").agg(F.count(F.lit(1)).alias("k")).groupBy("trend").agg(F.min_by("site", F.struct(-F.col("k"), "site")).alias("platform"))
    has = lambda x: F.count_if(F.col("title").rlike("(?i)" + x))
    mean = F.sum("score") / F.count(F.lit(1))
    t = p.groupBy("trend").agg(mean.alias("m"), has("how (do|can|to) ").alias("how_to"), has("(struggling|struggle) with ").alias("struggle"), has("(need|want) (more|better) ").alias("unmet"), has("(tired|sick) of ").alias("tired"))
    size = F.when(F.col("m") > 500, "macro").when(F.col("m") > 100, "mid").when(F.col("m") > 10, "micro").otherwise("nano")
    return t.join(site, "trend").select("trend", size.alias("size"), "platform", "how_to", "struggle", "unmet", "tired")


@query("d58_titles_by_site", sql_posts("select trend, site, string_agg(title, ' | ' order by id) as titles from (select trend, site, title, min(id) as id from posts group by 1, 2, 3) group by 1, 2"))
def d58(spark, d):
    once = posts(spark, d).groupBy("trend", "site", "title").agg(F.min("id").alias("id"))
    g = once.groupBy("trend", "site").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("x"))
    return g.select("trend", "site", F.array_join(F.transform("x", lambda x: x["title"]), " | ").alias("titles"))


@query("j11_entity_and_title_groups")
def j11(spark, d):
    """Posts that tell of one event, by entities and titles."""
    return dedup.event_groups(posts(spark, d), "id", "title")
