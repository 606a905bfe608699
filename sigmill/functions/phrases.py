"""Topic phrases of a title: compound phrases, technical terms and pairs of telling words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never part of a phrase.
STOP = """the a an and or but in on at to for of with is are was were been be have has had do does did will would could should may might can
this that these those i you he she it we they what which who when where why how show hn ask just its over your about like now here there then than
them their into out all some any other more most such very much each every both few many says said make made get got
one two first last new old good bad""".split()

# Technical terms.
TERMS = """llm llms gpt chatgpt openai anthropic claude gemini mistral rag embeddings fine-tuning transformer diffusion copilot
rust python golang typescript javascript zig elixir ruby swift kotlin haskell ocaml gleam nim
react nextjs svelte vue angular django fastapi express docker kubernetes terraform nix guix
postgres sqlite redis clickhouse duckdb supabase firebase wasm webassembly webtorrent webrtc websocket
blockchain crypto defi web3 decentralized serverless edge p2p peer-to-peer self-hosted open-source cli tui api sdk ide devtools""".split()

# Phrases of several words, and forms that stand for others.
COMPOUNDS = [
    "machine learning", "deep learning", "large language model", "language model", "neural network", "computer vision", "natural language", "open source", "self hosted", "real time", "local first",
    "developer tools", "dev tools", "command line", "version control", "web scraping", "web assembly", "web torrent", "cloud native", "cloud computing", "edge computing", "vector database", "time series", "key value",
    "type safe", "type system", "memory safe", "code review", "code generation", "code editor", "ai agent", "ai agents", "ai model", "ai models", "ai coding", "ai powered", "speech model", "speech recognition", "text to speech",
    "data pipeline", "data engineering", "data visualization",
]
FORMS = {
    "llms": "llm", "models": "model", "agents": "agent", "apps": "app", "apis": "api", "databases": "database", "frameworks": "framework", "libraries": "library", "tools": "tool", "applications": "application",
    "endpoints": "endpoint", "developers": "developer", "embeddings": "embedding", "containers": "container", "pipelines": "pipeline", "languages": "language", "language-models": "llm", "language-model": "llm", "large-language-model": "llm", "chatgpt": "openai",
}


def normal(phrase: Column) -> Column:
    """The form that stands for a phrase."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair]), phrase), phrase)


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used there and within its lambdas."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _told(clean: Column, words: Column) -> Column:
    whole = F.array_compact(F.array(*[F.when(clean.contains(p), normal(F.lit(p.replace(" ", "-")))) for p in COMPOUNDS]))
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(".-")))
    terms = F.transform(F.filter(bare, lambda w: normal(w).isin(TERMS) | w.isin(TERMS)), normal)
    telling = F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP)), normal)
    # the last word has none behind it
    two = _let(telling, lambda t: F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    kept = F.filter(two, lambda p: p["b"].isNotNull() & (p["a"].isin(TERMS) | p["b"].isin(TERMS) | ((F.length(p["a"]) > 4) & (F.length(p["b"]) > 4))))
    return F.array_sort(F.array_distinct(F.concat(whole, terms, F.transform(kept, lambda p: normal(F.concat_ws("-", p["a"], p["b"]))))))


def topic_phrases(title: Column) -> Column:
    """Distinct phrases of a title, sorted."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\w\s\-+#.]", " "), r"\s+", " "))
    return _let(clean, lambda c: _let(F.split(c, " "), lambda words: _told(c, words)))
