"""What the operators of this subpackage share: text measures and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the cluster names it.

    Only a session on this one machine may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    values that depend on partition numbers stay as they were first computed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sigmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str], list[Column]]:
    """(docs, used, back): all columns under numbered names, those of ``used`` there, and what gives every column its own name back.

    Operators name their inner columns freely; so none of a table's own is met or overwritten.
    """
    names = [f"__{k}" for k in range(len(docs.columns))]
    of = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)} | dict(zip(docs.columns, names, strict=True))
    return docs.toDF(*names), [of.get(c, of.get(c.lower())) for c in used], [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. One mark replaces each word with the space before it."""
    kept = F.rtrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.length(F.regexp_replace(kept, rf"[{SPACE}]*+[^{SPACE}]++", "x")).cast("long")


def hex_draw(*parts: Column | str) -> Column:
    """Seeded draw of a row: 32 hex digits, the same in every run and engine."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))
