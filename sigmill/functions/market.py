"""Competition, feasibility and audience rules over texts: Column to Column, no Python in the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of alternatives and of a search for tools.
ALTERNATIVES = [r"\balternative\s+to\b", r"\bvs\.?\b", r"\bcomparison\b", r"\bbest\s+tools?\b", r"\bcompetitors?\b", r"\breplacement\s+for\b", r"\binstead\s+of\b", r"\bswitch(?:ing)?\s+from\b"]
INTENT = [r"\bhow\s+to\s+choose\b", r"\bwhich\s+tool\b", r"\bwhich\s+(?:is|are)\s+best\b", r"\bbuyer.?s?\s+guide\b", r"\btop\s+\d+\b", r"\bcompar(?:e|ing|ison)\b", r"\bpick(?:ing)?\s+(?:a|the)\b"]

# Signs of a way into a crowded market, by kind.
WEDGES = {
    "niche_vertical": [r"\bhealthcare\b", r"\bfinance\b", r"\blegal\b", r"\beduc(?:ation|ational)\b", r"\benterprise\b", r"\bgovernment\b", r"\bvertical\b", r"\bindustry-specific\b", r"\bsector\b", r"\bniche\b"],
    "integration": [r"\bworks?\s+with\b", r"\bplugin\s+for\b", r"\bintegrat(?:e|es|ion)\b", r"\bconnect(?:s|or)?\s+(?:to|with)\b", r"\bapi\s+for\b", r"\bextension\b"],
    "performance": [r"\bfaster\b", r"\blighter\b", r"\bscal(?:e|able|ability)\b", r"\bperformance\b", r"\bspeed\b", r"\blow\s+latency\b", r"\boptimiz\b"],
    "compliance": [r"\bsoc\s?2\b", r"\bhipaa\b", r"\bgdpr\b", r"\bcomplian(?:t|ce)\b", r"\bsecurity\s+certif\b", r"\biso\s+27001\b", r"\bfedramp\b"],
    "ux": [r"\bhard\s+to\s+use\b", r"\bconfusing\b", r"\bterrible\s+(?:ux|ui)\b", r"\busability\b", r"\bfrustrat\b", r"\bclunky\b", r"\bbetter\s+(?:ux|ui)\b"],
    "distribution": [r"\bcommunity\b", r"\bopen\s+source\b", r"\bembedded\b", r"\bself[- ]host\b", r"\bmarketplace\b", r"\bfreemium\b"],
}

# Repositories, tools and funding in a text.
REPOSITORY = r"(?i)github\.com/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"
TOOL = r"(?:using|with|vs\.?|versus|alternative\s+to|replaced?\s+by|switched?\s+to|migrat\w*\s+to)\s+([A-Z][a-zA-Z0-9]+)"
FUNDING = r"(?:\$\d+(?:\.\d+)?[MBK]|Series\s+[A-Z]|raised\s+\$|funding|YC\s+[WSF]\d{2}|backed\s+by|Y\s+Combinator)"
GENERIC = """the this that with from using how why what new best top here now just like use get show ask tell does should would could will
not but and for are was has had been more some any all also than then when""".split()

# Weights of what makes a market crowded, and the bounds of its levels.
SATURATION = {"repo_density": 0.30, "alt_phrases": 0.25, "volume_vs_quality": 0.20, "cross_source_redundancy": 0.15, "search_intent": 0.10}
LOW, HIGH = 0.30, 0.60
MODIFIERS = {"high": -0.20, "moderate": -0.10, "low": 0.0, "uncertain": 0.0}

# Keywords of each kind of product, sale, defence, risk and load.
EXECUTION = {
    "saas": ["saas", "subscription", "dashboard", "portal", "platform", "app"],
    "infra": ["infrastructure", "hosting", "server", "cluster", "deploy", "pipeline", "kubernetes", "docker"],
    "content": ["content", "blog", "newsletter", "course", "tutorial", "education", "media"],
    "marketplace": ["marketplace", "two-sided", "matching", "listing", "vendor", "supplier"],
    "developer_tool": ["cli", "sdk", "library", "framework", "devtool", "ide", "linter", "debugger"],
    "integration": ["plugin", "extension", "connector", "integration", "middleware", "adapter"],
    "api_service": ["api", "endpoint", "service", "webhook", "rest", "graphql"],
}
SALES = {
    "self_serve": ["self-serve", "self serve", "freemium", "free tier", "sign up", "try free"],
    "community_led": ["open source", "community", "contributor", "github", "discord"],
    "content_led": ["blog", "seo", "content marketing", "newsletter", "inbound"],
    "outbound": ["sales team", "outbound", "cold email", "demo", "sales call"],
    "enterprise": ["enterprise", "procurement", "soc2", "compliance", "annual contract"],
}
MOATS = {
    "data_moat": ["data flywheel", "user data", "training data", "proprietary data", "data advantage", "network effect", "more users", "data accumulation"],
    "workflow_lock_in": ["daily use", "workflow", "embedded", "habit", "integrated into", "switching cost", "migration pain"],
    "distribution_moat": ["audience", "community", "followers", "channel", "distribution", "viral", "word of mouth", "referral"],
    "speed_wedge": ["first mover", "early", "before anyone", "head start", "timing advantage"],
    "regulatory_moat": ["regulated", "license", "compliance", "certification", "approved", "hipaa", "soc2", "gdpr", "fedramp"],
}
RISKS = {
    "winner_take_most_market": ["winner take all", "network effects", "platform lock-in", "monopoly"],
    "enterprise_sales_required": ["enterprise sales", "long sales cycle", "procurement", "annual contract"],
    "infra_heavy": ["infrastructure", "ops burden", "devops", "scaling", "high availability", "self-hosted"],
    "low_switching_costs": ["easy to switch", "commodity", "no lock-in", "interchangeable"],
    "crowded_with_funding": ["well-funded", "series", "raised", "backed by", "venture"],
    "requires_distribution_edge": ["go-to-market", "distribution", "acquisition channel", "marketing spend"],
    "regulatory_uncertainty": ["regulation", "legal uncertainty", "pending legislation", "compliance risk"],
}
LOADS = {
    "free_tier": ["static site", "serverless", "edge function", "vercel", "netlify", "cloudflare"],
    "hobby": ["small vps", "single server", "sqlite", "minimal infra"],
    "startup": ["database", "redis", "queue", "worker", "cron", "s3", "cdn"],
    "growth": ["kubernetes", "auto-scaling", "multi-region", "elasticsearch", "data pipeline"],
    "enterprise": ["dedicated cluster", "sla", "multi-tenant", "data warehouse", "ml training"],
}
# Weeks to build, upkeep, complexity and team of each kind of product.
BUILD_MIN = {"developer_tool": 1, "api_service": 2, "integration": 1, "content": 1, "saas": 4, "marketplace": 6, "infra": 8}
BUILD_MAX = {"developer_tool": 4, "api_service": 6, "integration": 3, "content": 4, "saas": 12, "marketplace": 16, "infra": 24}
UPKEEP = {"developer_tool": "low", "api_service": "medium", "integration": "low", "content": "low", "saas": "medium", "marketplace": "high", "infra": "high"}
COMPLEXITY = {"developer_tool": 2, "api_service": 3, "integration": 2, "content": 1, "saas": 3, "marketplace": 4, "infra": 5}
TEAM_MIN = {"developer_tool": 1, "api_service": 1, "integration": 1, "content": 1, "saas": 1, "marketplace": 2, "infra": 2}
TEAM_MAX = {"developer_tool": 1, "api_service": 2, "integration": 1, "content": 1, "saas": 3, "marketplace": 5, "infra": 5}
STACK = {
    "python": r"\bpython\b", "typescript": r"\btypescript\b", "javascript": r"\bjavascript\b", "react": r"\breact\b", "node": r"\bnode(?:js)?\b", "rust": r"\brust\b", "go": r"\bgolang\b|\bgo\s",
    "postgres": r"\bpostgres", "redis": r"\bredis\b", "docker": r"\bdocker\b", "kubernetes": r"\bkubernetes\b|\bk8s\b", "aws": r"\baws\b", "gcp": r"\bgcp\b",
}

# Phrases of pain, each with its type.
PAIN = [
    (r"(?:i |we )?wish(?:ed)? (?:there was|someone would|i could)", "wish"),
    (r"(?:i |we )?need\s+(?:a |an |some )", "need"),
    (r"(?:i |we )?want\s+(?:a |an |some |to )", "need"),
    (r"if only (?:there was|someone|i could)", "wish"),
    (r"(?:i'm |we're )?looking for\s+(?:a |an |some )", "need"),
    (r"anyone know(?:s)? (?:of )?(?:a |an )", "need"),
    (r"recommend(?:ation)?(?:s)? for", "need"),
    (r"(?:it's |its |this is )?(?:so |really |incredibly )?(?:hard|difficult|painful|tedious|annoying) to", "frustration"),
    (r"(?:i'm |we're )?(?:frustrated|struggling|tired of|sick of|fed up)", "frustration"),
    (r"(?:this |it )?(?:doesn't|does not|won't|will not|can't|cannot) (?:work|scale|handle)", "frustration"),
    (r"(?:too |extremely )?(?:slow|expensive|complex|complicated|buggy|unreliable)", "frustration"),
    (r"broken|breaking change|deprecated|buggy|unreliable", "frustration"),
    (r"pain[- ]?point", "frustration"),
    (r"(?:keeps? |constantly |always )?(?:breaking|crashing|failing)", "frustration"),
    (r"why (?:doesn't|isn't|can't|won't) (?:anyone|somebody|someone)", "question"),
    (r"(?:has |is )?(?:anyone|somebody) (?:built|made|created|found)", "question"),
    (r"what(?:'s| is) the best (?:way|tool|approach|solution) (?:to|for)", "question"),
    (r"how (?:do|can|should) (?:i|we|you) (?:handle|deal with|solve|fix)", "question"),
    (r"any (?:good )?(?:alternative|replacement|substitute)(?:s)? (?:to|for)", "question"),
    (r"existing (?:tools?|solutions?|options?) (?:don't|doesn't|can't|lack)", "gap"),
    (r"no (?:good |decent )?(?:solution|tool|option|way) for", "gap"),
    (r"(?:missing|lacks?|no support for)\s+\w+", "gap"),
    (r"(?:current|existing) (?:tools?|solutions?) (?:are )?(?:too |not )", "gap"),
    (r"my (?:audience|followers|subscribers) (?:keep|want|ask|need)", "need"),
    (r"(?:no |lack of )?(?:good )?(?:monetization|revenue|income) (?:option|strategy|model)", "gap"),
    (r"(?:algorithm|reach|views|impressions) (?:dropped|decreased|tanked)", "frustration"),
]

# Signs of an audience's pain and of money in a title; niches, styles and ways to earn.
# Words in lower case of which a text holds one wherever the pattern of that number in PAIN matches.
PAIN_WORDS = [
    ["wish"], ["need"], ["want"], ["if only "], ["looking for"], ["anyone know"], ["recommend"], ["hard to", "difficult to", "painful to", "tedious to", "annoying to"], ["frustrated", "struggling", "tired of", "sick of", "fed up"],
    ["doesn't ", "does not ", "won't ", "will not ", "can't ", "cannot "], ["slow", "expensive", "complex", "complicated", "buggy", "unreliable"], ["broken", "breaking change", "deprecated", "buggy", "unreliable"], ["pain"], ["breaking", "crashing", "failing"],
    ["why doesn't ", "why isn't ", "why can't ", "why won't "], ["anyone ", "somebody "], ["the best "], ["how do ", "how can ", "how should "], ["alternative", "replacement", "substitute"], ["existing "], ["no "],
    ["missing", "lack", "no support for"], ["current ", "existing "], ["my audience ", "my followers ", "my subscribers "], ["monetization ", "revenue ", "income "], ["dropped", "decreased", "tanked"],
]
AUDIENCE_PAIN = r"\b(how (do|can|to|should)|tutorial|need more|need this|when (will|is the next)|anyone else|i wish|struggling with|can't figure|help with|looking for)\b"
MONEY = r"\b(sponsor|affiliate|course|merch|merchandise|product|brand deal|paid partner|subscribe|membership|patreon|sell|revenue|income|earn|monetize)\b"
NICHES = ["gaming", "beauty", "fitness", "education", "finance", "lifestyle", "tech", "cooking", "travel", "music", "entertainment", "business", "parenting", "comedy", "sports", "fashion", "health", "art"]
STYLES = ["tutorial", "vlog", "review", "educational", "entertaining", "inspirational", "challenge", "reaction", "commentary", "storytelling"]
EARNING = {
    "sponsorships": ["sponsor", "brand deal", "paid partnership"],
    "courses": ["course", "masterclass", "workshop", "bootcamp"],
    "affiliate": ["affiliate", "commission", "referral link"],
    "merchandise": ["merch", "merchandise", "shop"],
    "subscriptions": ["patreon", "membership", "subscribe", "premium"],
    "ads": ["ad revenue", "adsense", "monetize"],
    "products": ["product", "sell", "shop", "store"],
}

# Keywords of roles, words that say nothing in an action, words that questions and assertions share.
ROLES = {
    "developer": ["api", "sdk", "framework", "library", "tool", "cli", "database", "backend", "frontend"],
    "founder": ["startup", "business", "market", "growth", "revenue", "funding", "saas", "b2b", "b2c"],
    "marketer": ["content", "seo", "social", "brand", "campaign", "analytics", "audience", "viral"],
    "creator": ["content", "video", "podcast", "newsletter", "blog", "youtube", "tiktok", "audience"],
    "researcher": ["paper", "study", "analysis", "data", "academic", "science", "research"],
}
VAGUE = ["explore", "research", "investigate", "monitor", "watch", "consider", "evaluate", "assess", "analyze", "study"]
LANGUAGES = ["python", "javascript", "typescript", "go", "rust", "java", "ruby", "node"]
QUESTION_WORDS = """what when where which this that there their about would could should have with from into tell show find list give does will more some
than them they been were also said like just make your know want""".split()
ASSERTION = r"\b(is|are|was|were|has|have|had|will|shows?|indicates?|suggests?|reveals?|found|discovered|reported|stated|said|launched|released|created|built|developed|raised|earned|generated|reached|achieved)\b"

# Playbooks by category, competition and persona, and those that fill up.
PLAYBOOKS = {
    "devtools": ["github_mvp", "community_post", "reddit_ask"],
    "infrastructure": ["github_mvp", "community_post", "user_interviews"],
    "ai-ml": ["github_mvp", "community_post", "reddit_ask"],
    "saas": ["landing_page", "waitlist", "paid_ads_test"],
    "content": ["landing_page", "waitlist", "indie_hacker_post"],
    "data": ["github_mvp", "community_post", "user_interviews"],
    "security": ["community_post", "user_interviews", "reddit_ask"],
    "mobile": ["landing_page", "prototype_demo", "waitlist"],
    "other": ["landing_page", "user_interviews", "community_post"],
}
BY_COMPETITION = {"high": ["reddit_ask"], "low": ["prototype_demo", "paid_ads_test"], "moderate": [], "uncertain": []}
BY_PERSONA = {"expert": ["github_mvp"], "beginner": ["landing_page"], "intermediate": []}
FILL_UP = ["landing_page", "community_post", "indie_hacker_post", "prototype_demo"]

# What a timing label says.
TIMING = {
    "early_edge": "The market window is open — early movers have an advantage right now.",
    "too_early": "Still very early — limited data, but worth watching.",
    "crowded": "The space is getting crowded. Differentiation is key.",
    "late_but_monetizable": "Late to the trend, but monetization paths still exist.",
}

any_of = lambda patterns: "(?i)" + "|".join(patterns)


def lookup(values: Mapping, key: Column, default) -> Column:
    """``values[key]``, or ``default``."""
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def count_of(text: Column, patterns: Sequence[str]) -> Column:
    return F.regexp_count(text, F.lit(any_of(patterns))).cast("long")


def hits(low: Column, words: Sequence[str]) -> Column:
    """How many of the words a lower-cased text holds."""
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def scores(low: Column, kinds: Mapping[str, Sequence[str]]) -> Column:
    """Kinds with a keyword in the text, most keywords first, then as listed: array of (count, name)."""
    rows = [F.struct((-hits(low, words)).alias("less"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(kinds.items())]
    return F.transform(F.array_sort(F.filter(F.array(*rows), lambda r: r["less"] < 0)), lambda r: F.struct((-r["less"]).alias("n"), r["name"].alias("name")))


def best_kind(low: Column, kinds: Mapping[str, Sequence[str]], default: str) -> Column:
    found = scores(low, kinds)
    return F.coalesce(F.get(found, F.lit(0))["name"], F.lit(default))


def present(low: Column, kinds: Mapping[str, Sequence[str]]) -> Column:
    """Names of the kinds of which the text holds a keyword, as listed."""
    return F.array_compact(F.array(*[F.when(hits(low, words) > 0, F.lit(name)) for name, words in kinds.items()]))


def stack(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in STACK.items()]))


def requirements(kind: Column, sales: Column, level: Column) -> dict[str, Column]:
    """What it takes to build and sell a kind of product; a crowded market takes half as long again."""
    longer = lambda c: F.when(level == "high", F.floor(c * 1.5)).otherwise(c).cast("int")
    floor = lambda c, n: F.when(sales == "enterprise", F.greatest(c, F.lit(n))).otherwise(c)
    return {
        "build_min": longer(lookup(BUILD_MIN, kind, 4)),
        "build_max": longer(lookup(BUILD_MAX, kind, 12)),
        "upkeep": lookup(UPKEEP, kind, "medium"),
        "complexity": lookup(COMPLEXITY, kind, 3),
        "team_min": floor(lookup(TEAM_MIN, kind, 1), 2),
        "team_max": floor(lookup(TEAM_MAX, kind, 3), 4),
    }


def moat_strength(found: Column) -> Column:
    """``found`` as from ``scores`` over the moats."""
    top = F.coalesce(F.get(found, F.lit(0))["n"], F.lit(0))
    return (
        F.when((F.size(found) >= 2) & (top >= 3), "strong")
        .when((F.size(found) >= 1) & (top >= 2), "moderate")
        .when((F.size(found) == 1) & (F.get(found, F.lit(0))["name"] == "speed_wedge"), "temporary")
        .when(F.size(found) == 0, "none")
        .otherwise("weak")
    )


def risk_flags(low: Column, sales: Column, complexity: Column, level: Column, strength: Column) -> Column:
    more = [
        F.when(sales == "enterprise", "enterprise_sales_required"),
        F.when(complexity >= 4, "infra_heavy"),
        F.when((level == "high") & strength.isin("none", "weak"), "crowded_with_funding"),
        F.when(strength.isin("none", "temporary"), "low_switching_costs"),
        F.when(sales.isin("outbound", "enterprise"), "requires_distribution_edge"),
    ]
    return F.array_sort(F.array_distinct(F.concat(present(low, RISKS), F.array_compact(F.array(*more)))))


def execution_archetype(kind: Column, sales: Column, complexity: Column, team_max: Column, build_max: Column, flags: Column) -> Column:
    return (
        F.when((sales == "enterprise") & (team_max >= 4), "vc_scale_only")
        .when((kind == "infra") | (complexity >= 4), "infra_play")
        .when((kind.isin("marketplace", "content") | F.array_contains(flags, "requires_distribution_edge")) & (team_max <= 2), "distribution_game")
        .when(team_max >= 3, "team_required")
        .when((team_max == 1) & (build_max <= 6), "solo_feasible_mvp")
        .otherwise("indie_saas_bet")
    )


def keyword_match(low: Column, words: Sequence[str]) -> Column:
    """Share of the keywords that a text holds, of three at least."""
    return F.least(hits(low, words) / max(len(words), 3), F.lit(1.0))


def grounded_words(sentence: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(sentence), r"[^a-z\s]", " "), r"\s+"), lambda w: F.length(w) >= 4)


def supported_share(answer: Column, context: Column) -> Column:
    """Share of the asserting sentences of which a fifth of the words at least is in the context; 1 without any."""
    low = F.lower(context)
    claims = F.filter(F.transform(F.split(answer, "[.!?]+"), lambda s: F.trim(s)), lambda s: (F.length(s) > 20) & s.rlike("(?i)" + ASSERTION))

    def held(s: Column) -> Column:
        w = grounded_words(s)
        return (F.size(w) == 0) | (F.size(F.filter(w, lambda x: F.contains(low, x))) >= 0.2 * F.size(w))

    return F.when(F.size(claims) == 0, F.lit(1.0)).otherwise(F.size(F.filter(claims, held)) / F.size(claims))


def playbooks(category: Column, level: Column, persona: Column, n: int = 3) -> Column:
    """The first ``n`` playbooks: interviews, then by competition, persona and category, then the rest."""

    def chosen(by: Mapping[str, Sequence[str]], key: Column, default: Sequence[str]) -> Column:
        out = strings(*default)
        for k, v in by.items():
            out = F.when(key == k, strings(*v)).otherwise(out)
        return out

    every = F.concat(strings("user_interviews"), chosen(BY_COMPETITION, level, []), chosen(BY_PERSONA, persona, []), chosen(PLAYBOOKS, category, PLAYBOOKS["other"]), strings(*FILL_UP))
    return F.slice(F.array_distinct(every), 1, n)


def artifact_url(url: Column) -> Column:
    """The site's own address of a page, without tracking or discussion rules; null for wrappers and empty."""
    from sigmill.functions.text import WRAPPERS

    host, path = F.lower(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1)), F.regexp_extract(url, r"^\w+://[^/?#]*([^?#]*)", 1)
    part = lambda p, k: F.lower(F.regexp_extract(path, p, k))
    repo, dev, hunt, hacker, letter = r"(?i)^/([^/]+)/([^/]+?)(?:\.git)?(?:/.*)?$", r"^/([^/]+)/([^/]+)", r"^/posts/([^/]+)", r"^/post/([^/?]+)", r"^/p/([^/?]+)"
    return (
        F.when(F.coalesce(url, F.lit("")) == "", None)
        .when(host.contains("github.com") & path.rlike(repo), F.concat(F.lit("github.com/"), part(repo, 1), F.lit("/"), part(repo, 2)))
        .when(host.contains("dev.to") & path.rlike(dev), F.concat(F.lit("dev.to/"), part(dev, 1), F.lit("/"), part(dev, 2)))
        .when(host.contains("producthunt.com") & path.rlike(hunt), F.concat(F.lit("producthunt.com/posts/"), part(hunt, 1)))
        .when(host.contains("indiehackers.com") & path.rlike(hacker), F.concat(F.lit("indiehackers.com/post/"), part(hacker, 1)))
        .when(host.endswith(".substack.com") & path.rlike(letter), F.concat(host, F.lit("/p/"), part(letter, 1)))
        .when(host.isin(WRAPPERS), None)
        .otherwise(F.rtrim(F.concat(host, path), F.lit("/")))
    )


def external_url(url: Column, data: Column) -> Column:
    """What a post points to: for a wrapper the link in its JSON; https, without tracking, fragment and last slash; null up to 15 characters."""
    from sigmill.functions.text import TRACKING, WRAPPERS

    host = F.replace(F.lower(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    wraps = F.lit(False)
    for w in WRAPPERS:
        wraps = wraps | host.contains(w)
    named = F.coalesce(*[F.nullif(F.get_json_object(data, f"$.{k}"), F.lit("")) for k in ("external_url", "link", "url")])
    u = F.regexp_replace(F.when(wraps, F.coalesce(named, url)).otherwise(url), "#.*$", "")
    kept = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(TRACKING))
    base = F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), r"^\w+://", "https://")
    out = F.rtrim(F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")), F.lit("/"))
    return F.when((F.coalesce(url, F.lit("")) != "") & (F.length(out) > 15), out)
