"""Text and URL functions: Column to Column, no Python in the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say where a visitor came from, and sites that only wrap other pages.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "source", "share", "fbclid", "gclid", "mc_cid", "mc_eid"]
WRAPPERS = ["news.ycombinator.com", "reddit.com", "twitter.com", "x.com", "facebook.com", "linkedin.com"]

# Signs of demand in a title.
DEMAND = [
    r"\bhow to\b", r"\blooking for\b", r"\bbenchmark\b", r"\bcomparison\b", r"\bmigrat(?:e|ion|ing)\b", r"\bproduction\b", r"\bscaling\b", r"\bpric(?:e|ing)\b",
    r"\blimitation[s]?\b", r"\bproblem[s]?\b", r"\bissue[s]?\b", r"\balternative\b", r"\bopen[- ]?source alternative\b", r"\bpain[- ]?point[s]?\b",
    r"\bfrustrat(?:ed|ing|ion)\b", r"\bwish(?:ing|ed)?\b", r"\bneed[s]?\b", r"\bwant[s]?\b", r"\breplace(?:ment)?\b", r"\bself[- ]?host(?:ed|ing)?\b",
    r"\bstruggl(?:e|es|ing)\b", r"\bworkaround\b", r"\bhack(?:y|ish)\b", r"\bbetter\s+(?:way|approach|tool|alternative)\b", r"\banyone\s+(?:using|tried|know)\b",
    r"\brecommend(?:ation)?s?\b", r"\bwhat\s+(?:do you|should I)\s+use\b", r"\btoo\s+(?:slow|expensive|complex|hard)\b", r"\bdoesn'?t\s+(?:work|scale|support)\b",
    r"\bbreaking\s+change\b", r"\bdeprecated\b", r"\bbuggy\b", r"\bunreliable\b", r"\bmissing\s+feature\b", r"\bno\s+(?:good|decent|proper)\b",
]

# Signs of rejection in a title.
NEGATIVE = [
    r"\boverhyped\b", r"\bdoesn'?t\s+scale\b", r"\bsecurity\s+(?:issue|flaw|vuln|hole|breach)", r"\bfailed\s+(?:attempt|migration|deployment|experiment)\b",
    r"\bnot\s+(?:ready|production|stable|mature)\b", r"\babandoned\b", r"\bdead\s+project\b", r"\bstay\s+away\b", r"\bregret(?:ted|ting)?\b", r"\bwaste\s+of\s+time\b",
    r"\bbug(?:gy|s|ridden)\b", r"\bunstable\b", r"\bunreliable\b", r"\bdowntime\b", r"\bdata\s+loss\b", r"\bbreaking\s+change\b", r"\bvapor\s?ware\b", r"\bscam\b",
    r"\bponzi\b", r"\bdisappoint(?:ed|ing|ment)\b", r"\bnightmare\b", r"\bhorrible\b", r"\bterrible\b", r"\bavoid\b", r"\bdon'?t\s+(?:use|recommend|bother)\b",
    r"\bworse\s+than\b", r"\boverpriced\b", r"\bhidden\s+(?:cost|fee|catch)\b", r"\block[\s-]?in\b", r"\bvendor\s+lock\b",
]

# Content classes in the order in which they are tried, each with its signs; product also holds for code hosts.
CLASSES = [
    ("show_hn", [r"^show\s+hn\b"]),
    ("ask_hn", [r"^ask\s+hn\b"]),
    ("career_advice", [r"\b(?:career|salary|salaries|compensation|resume|cv)\b", r"\b(?:job\s+hunt(?:ing)?|job\s+search|hiring|fired|laid\s+off)\b", r"\b(?:interview(?:ing)?|whiteboard|leetcode|coding\s+interview)\b",
                       r"\b(?:burnout|work[\s-]?life[\s-]?balance|imposter\s+syndrome)\b", r"\b(?:remote\s+work|return\s+to\s+office|rto|wfh)\b", r"\b(?:promotion|raise|negotiate|quit(?:ting)?|resign)\b",
                       r"\b(?:manager|management|leadership)\s+(?:advice|tips|lessons)\b"]),
    ("social_commentary", [r"\b(?:society|societal|culture\s+war|political|politics)\b", r"\bethics\s+of\b", r"\bmoral(?:ity|ly)?\b", r"\b(?:capitalism|socialism|inequality|privilege)\b",
                           r"\b(?:diversity|dei|discrimination|bias)\s+(?:in\s+tech|in\s+hiring)\b", r"\b(?:surveillance|privacy\s+rights|censorship)\b"]),
    ("personal_story", [r"^(?:I|We|My)\s+(?:built|made|created|wrote|started|quit|left|joined|switched)", r"^(?:I|We)\s+(?:am|was|have been|decided|think|believe|feel)", r"\bstory[\s-]?time\b", r"\bconfession\b",
                        r"\bmy\s+(?:journey|experience|story|take|thoughts)\b", r"^(?:How|Why)\s+I\s+", r"\bAMA\b"]),
    ("opinion", [r"\bunpopular\s+opinion\b", r"\bhot\s+take\b", r"\bthoughts\s+on\b", r"\bwhy\s+I\s+(?:think|believe|hate|love)\b", r"\brant\s+about\b", r"\bchange\s+my\s+mind\b", r"\boverrated\b", r"\bunderrated\b",
                 r"\bis\s+(?:dead|dying|overrated|overhyped)\b", r"\b(?:love|hate)\s+(?:letter|it\s+or\s+hate)\b"]),
    ("product", [r"\b(?:v\d+(?:\.\d+)*)\b", r"\b(?:launch(?:ed|ing)?|released?|announcing|shipped)\b", r"\b(?:open[\s-]?sourc(?:e|ed|ing))\b", r"\b(?:built\s+(?:with|using|in))\b",
                 r"\b(?:github\.com|gitlab\.com|npmjs\.com|pypi\.org|crates\.io)\b"]),
    ("technical", [r"\b(?:benchmark(?:s|ing)?|performance|latency|throughput)\b", r"\b(?:architecture|design\s+pattern|system\s+design)\b", r"\b(?:tutorial|guide|walkthrough|deep\s+dive)\b",
                   r"\b(?:bug|vulnerability|cve|security\s+(?:flaw|issue|patch))\b", r"\b(?:algorithm|data\s+structure|complexity|optimization)\b", r"\b(?:deploy(?:ment|ing)?|ci\/?cd|pipeline|infrastructure)\b",
                   r"\b(?:api|sdk|library|framework|runtime|compiler)\b", r"\b(?:database|query|index|migration|schema)\b", r"\b(?:container|docker|kubernetes|k8s|helm)\b",
                   r"\b(?:rust|golang|python|typescript|javascript|c\+\+|java|swift|kotlin)\b"]),
]

# Words and dates that a recurring title carries beside its pattern.
STOP = """the a an of in for to and or is are was were be been being have has had do does did will would could should may might can
this that these those it its my your our their with from at by on about into""".split()
DATES = "|".join(
    [
        r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b",
        r"\b(?:jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\b",
        r"\b20\d{2}\b",
        r"\bq[1-4]\b",
        r"\bweek\s*\d+\b",
        r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    ]
)


def clean_url(url: Column) -> Column:
    """Without fragment and tracking parameters, https for http; null for empty."""
    u = F.regexp_replace(url, "#.*$", "")
    query = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(TRACKING))
    base = F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), "^http://", "https://")
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(base, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def canonical_url(url: Column, source: Column | None = None) -> Column:
    """struct(url, kind): the site's own rule, or host and path; null for wrappers and empty."""
    u = clean_url(url)
    host, path = F.lower(F.regexp_extract(u, r"^\w+://([^/?]*)", 1)), F.regexp_extract(u, r"^\w+://[^/?]*([^?]*)", 1)
    part = lambda pattern, k: F.regexp_extract(path, pattern, k)
    site = lambda text, *parts: F.concat(F.lit(text), *parts)
    low = F.lower
    repo, dev, hunt, hacker, letter, forum = r"(?i)^/([^/]+)/([^/]+?)(?:\.git)?(?:/.*)?$", r"^/([^/]+)/([^/]+)", r"^/posts/([^/?]+)", r"^/post/([^/?]+)", r"^/p/([^/?]+)", r"^/r/([^/]+)/comments/([^/]+)"
    pair = lambda a, b: F.struct(a.alias("url"), F.lit(b).alias("kind") if isinstance(b, str) else b.alias("kind"))
    other = F.lit("other") if source is None else F.when(source.isin("hackernews", "devto"), "article").otherwise("other")
    return (
        F.when(u.isNull(), pair(F.lit(None).cast("string"), "no_url"))
        .when(host.contains("github.com") & path.rlike(repo), pair(site("github.com/", low(part(repo, 1)), F.lit("/"), low(part(repo, 2))), "github_repo"))
        .when(host.contains("dev.to") & path.rlike(dev), pair(site("dev.to/", low(part(dev, 1)), F.lit("/"), low(part(dev, 2))), "article"))
        .when(host.contains("producthunt.com") & path.rlike(hunt), pair(site("producthunt.com/posts/", low(part(hunt, 1))), "product"))
        .when(host.contains("indiehackers.com") & path.rlike(hacker), pair(site("indiehackers.com/post/", low(part(hacker, 1))), "article"))
        .when(host.endswith(".substack.com") & path.rlike(letter), pair(F.concat(host, F.lit("/p/"), low(part(letter, 1))), "article"))
        .when(host.contains("reddit.com") & path.rlike(forum), pair(site("reddit.com/r/", low(part(forum, 1)), F.lit("/comments/"), part(forum, 2)), "discussion"))
        .when(host.isin(WRAPPERS), pair(F.lit(None).cast("string"), "wrapper"))
        .otherwise(pair(F.rtrim(F.concat(host, path), F.lit("/")), other))
    )


def url_key(url: Column) -> Column:
    return F.lower(F.rtrim(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/")))


def normalize_title(title: Column) -> Column:
    """Lower case without dates, numbers, punctuation, stop words and words of one or two letters."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), DATES, ""), r"\d+", "")
    words = F.split(F.trim(F.regexp_replace(t, r"[^\w\s]", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(STOP) & (F.length(w) > 2)), " ")


def title_hash(title: Column) -> Column:
    return F.substring(F.sha2(normalize_title(title), 256), 1, 32)


def content_class(title: Column, source: Column) -> Column:
    out = F.lit("other")
    for name, signs in reversed(CLASSES):
        here = title.rlike("(?i)" + "|".join(signs))
        out = F.when(here | (source == "github") if name == "product" else here, name).otherwise(out)
    return out


def signs(title: Column, patterns: list[str]) -> Column:
    """Patterns that the title shows, in order."""
    return F.array_compact(F.array(*[F.when(title.rlike("(?i)" + p), F.lit(p)) for p in patterns]))


def entities(title: Column) -> Column:
    """Lower-cased proper names, quoted parts, acronyms and versions of a title."""
    found = [F.regexp_extract_all(title, F.lit(p), F.lit(1)) for p in (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", r'"([^"]+)"', r"\b([A-Z]{2,})\b", r"\b(v?\d+\.\d+(?:\.\d+)?)\b")]
    return F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda x: F.lower(x)))


# Names that begin titles and tell nothing, and acronyms that are too common.
STOP_NAMES = "The This That These Those What Why How When Where Who Show Ask New First Last Update Launch Release Breaking Just Now Today Yesterday".split()
STOP_ACRONYMS = "HN TL DR AI ML US UK EU".split()

#: Proper names of one word or more, quoted parts, acronyms, versions.
NAMES, QUOTES, ACRONYMS, VERSIONS = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", r'"([^"]+)"', r"\b([A-Z]{2,6})\b", r"\b(v?\d+\.\d+(?:\.\d+)?)\b"


def key_entities(title: Column) -> Column:
    """Lower-cased names of three letters or more, quoted parts, acronyms and versions, without those that tell nothing; in order, none for null."""
    every = lambda p: F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("(?U)" + p), F.lit(1))
    names = F.filter(every(NAMES), lambda x: ~x.isin(STOP_NAMES) & (F.length(x) > 2))
    quoted = F.transform(every(QUOTES), lambda x: F.trim(x))
    acronyms = F.filter(every(ACRONYMS), lambda x: ~x.isin(STOP_ACRONYMS))
    return F.array_sort(F.array_distinct(F.transform(F.concat(names, quoted, acronyms, every(VERSIONS)), lambda x: F.lower(x))))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bucket(key: Column, n: int) -> Column:
    """Stable assignment: first 8 hex digits of the hash, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def display_name(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.when(w.isin("ai", "api", "ml", "sdk"), F.upper(w)).otherwise(F.initcap(w))), " ")
