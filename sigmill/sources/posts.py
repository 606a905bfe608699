"""Posts: documents with a headline, for the rules that read English text; links: pages with the addresses that sites give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.sources.tables import _quoted, table

HEADLINES = [
    "Best alternative to Airtable vs Notion for finance teams",
    "Which tool is best for HIPAA compliance? Buyer's guide",
    "Migrating from Heroku to Kubernetes without downtime",
    "Self-hosted Dropbox alternative using Nextcloud, open source",
    "Python SDK wrapper library for payments, raised $5M in Series A funding",
    "I wish there was a faster plugin for Figma",
    "How do I handle flaky tests? Tutorial needed",
    "Struggling with slow dashboards, does anyone know of a better tool",
    "My audience keep asking for a course and a membership",
    "Sponsor and affiliate revenue for a newsletter, backed by YC W21",
    "Top 10 tools compared: picking a queue with low latency",
    "Docker and Postgres marketplace listing for vendors",
    "Enterprise procurement, SOC2 and an annual contract demo",
    "Looking for a replacement for Jira, it is too slow and buggy",
    "Serverless edge function, see github.com/Acme/fast-grid today",
    "A calm walk in the hills",
    "Subscription platform with webhook API and React dashboard",
    "First mover with training data, user data, network effect and daily use workflow",
    "Gaming and fitness vlog review for beginners, sell merch",
    "Existing tools lack offline mode and there is no support for sync",
    "Switching from Slack to a freemium community on Discord",
    "Confusing clunky UI, want a better UX for education",
    "Golang CLI linter with database, redis queue and cron worker",
    "How to choose a CRM instead of a spreadsheet",
]
SITES = ["github", "hackernews", "reddit", "devto", "youtube_creator"]

#: Addresses by page number modulo their count; {n} is the number, {u} the page's own address.
LINKS = [
    ("{u}", None),
    ("http://GitHub.com/Acme/Repo{n}.git?utm_source=x#top", None),
    ("https://dev.to/Someone/Post-{n}/comments?ref=home", None),
    ("https://www.producthunt.com/posts/Thing-{n}", None),
    ("https://www.indiehackers.com/post/Story-{n}?share=1", None),
    ("https://letter{n}.substack.com/p/Issue-{n}", None),
    ("https://reddit.com/r/tools/comments/{n}/title/", '{"external_url": "http://example.org/a/{n}/?utm_medium=y&k=1#z"}'),
    ("https://news.ycombinator.com/item?id={n}", '{"link": "https://example.net/b/{n}/"}'),
    ("https://x.com/someone/status/{n}", '{"other": 1}'),
    ("http://a.io/{n}", None),
    ("", None),
]


def _pick(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, trend, site, day (0 to 29), score, title (a headline and the begin of the text) and body; printable ASCII only."""
    text = F.coalesce("text", F.lit(""))
    begin = F.substring(F.regexp_replace(F.substring_index(text, "\n", 1), "[^ -~]", ""), 1, 40)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws("-", "lang", "source").alias("trend"),
        _pick(SITES, F.col("doc_id")).alias("site"),
        (F.floor(F.col("doc_id") / 7) % 30).alias("day"),
        (F.col("n_chars") % 1000).cast("long").alias("score"),
        F.concat(_pick(HEADLINES, F.col("doc_id")), F.lit(" "), begin).alias("title"),
        F.regexp_replace(text, "[^ -~]", " ").alias("body"),
    )


def shared_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, site, day, score, comments, url, data (JSON of the post), title (begin of the text) and headed (a headline, the same for equal begins, and that).

    Of each 44 documents in a row the first 22 share addresses in pairs, eleven apart.
    """
    n = F.when(F.floor(F.col("doc_id") / 11) % 4 < 2, F.floor(F.col("doc_id") / 22)).otherwise(F.col("doc_id")).cast("string")
    fill = lambda c: F.replace(F.replace(c, F.lit("{n}"), n), F.lit("{u}"), F.lit(""))
    begin = F.trim(F.substring(F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), "[^ -~]", ""), 1, 80))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        _pick(SITES, F.col("doc_id")).alias("site"),
        (F.floor(F.col("doc_id") / 7) % 30).alias("day"),
        (F.col("n_chars") % 1000).cast("long").alias("score"),
        (F.col("n_chars") % 37).cast("long").alias("comments"),
        fill(_pick([u for u, _ in LINKS], F.col("doc_id"))).alias("url"),
        fill(_pick([j for _, j in LINKS], F.col("doc_id"))).alias("data"),
        begin.alias("title"),
        F.concat(_pick(HEADLINES, F.crc32(begin)), F.lit(" "), begin).alias("headed"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and data (JSON of the post that holds the link)."""
    n = F.col("page_id").cast("string")
    fill = lambda c: F.replace(F.replace(c, F.lit("{n}"), n), F.lit("{u}"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fill(_pick([u for u, _ in LINKS], F.col("page_id"))).alias("url"), fill(_pick([j for _, j in LINKS], F.col("page_id"))).alias("data"))


def _list(values: list) -> str:
    return "[" + ", ".join("null" if v is None else _quoted(v) for v in values) + "]"


_POSTS = f"""posts as (select doc_id as id, concat_ws('-', lang, source) as trend, {_list(SITES)}[doc_id % {len(SITES)} + 1] as site, (doc_id // 7) % 30 as day, n_chars % 1000 as score,
  {_list(HEADLINES)}[doc_id % {len(HEADLINES)} + 1] || ' ' || substr(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[^ -~]', '', 'g'), 1, 40) as title,
  regexp_replace(coalesce(text, ''), '[^ -~]', ' ', 'g') as body from documents)"""
_FILL = "replace(replace({c}, '{n}', page_id::varchar), '{u}', url)"
_LINKS = "links as (select page_id, {} as url, {} as data from pages)".format(
    *[_FILL.replace("{c}", f"{_list([x[k] for x in LINKS])}[page_id % {len(LINKS)} + 1]") for k in (0, 1)]
)

_SHARED = "shared as (select id, site, day, score, comments, {} as url, {} as data from (select doc_id as id, {}[doc_id % {} + 1] as site, (doc_id // 7) % 30 as day, n_chars % 1000 as score, n_chars % 37 as comments, (case when (doc_id // 11) % 4 < 2 then doc_id // 22 else doc_id end)::varchar as n from documents))".format(
    *[f"replace(replace({_list([x[k] for x in LINKS])}[id % {len(LINKS)} + 1], '{{n}}', n), '{{u}}', '')" for k in (0, 1)], _list(SITES), len(SITES)
)


def sql_posts(body: str, *ctes: str) -> str:
    """SQL over the projections posts, links and shared (without titles): then ``ctes``, then ``body``."""
    return "with " + ",\n".join([_POSTS, _LINKS, _SHARED, *ctes]) + "\n" + body
