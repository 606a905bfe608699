"""Tables with a key, in hash buckets: a change rewrites the buckets that it touches and shows all at once.

A table is a folder. ``data/<change>/bucket=<k>`` holds Parquet files that are never changed, and
``versions/<number>.json`` names the folders that make up a version. A change writes its files first and is made by
renaming one small file last, so readers see the table before or after it, a job that dies leaves the table as it was, and of two
writers at a time the later one is refused. The number of buckets bounds what a version lists and what the driver sees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_B, _SPREAD = "_bucket", "_spread"


class ChangedMeanwhile(RuntimeError):
    """Another writer made the version that this change was to make; nothing was changed, it can be tried again."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are listed, in order; empty where there is no table."""
    fs, at = _fs(spark, path), _path(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _listed(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    if version is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no table at {path}")
        version = found[-1]
    return version, json.loads(spark.read.text(f"{path}/versions/{version:010d}.json", wholetext=True).first().value)


def _show(spark: SparkSession, path: str, version: int, listed: dict) -> None:
    """Makes a version, unless there is one of that number."""
    fs, name = _fs(spark, path), f"{path}/versions/{version:010d}.json"
    staged = _path(spark, f"{path}/versions/{uuid.uuid4().hex}.staged")
    out = fs.create(staged, False)
    out.write(json.dumps(listed).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(staged, _path(spark, name), options)
    except Exception as e:
        fs.delete(staged, False)
        if fs.exists(_path(spark, name)):
            raise ChangedMeanwhile(name) from e
        raise


def _bucket(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _write(df: DataFrame, path: str, listed: dict) -> str:
    """Files of the rows in a folder of their own, whose name is returned; a bucket is spread over ``files`` tasks."""
    change, keys = uuid.uuid4().hex[:16], listed["keys"]
    placed = df.withColumn(_B, _bucket(keys, listed["buckets"])).withColumn(_SPREAD, F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(listed["files"])))
    placed.repartition(_B, _SPREAD).drop(_SPREAD).withColumnRenamed(_B, "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{change}")
    return change


def _rows(spark: SparkSession, path: str, listed: dict, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of the version, or of some of its buckets; no file of another bucket is opened."""
    schema = StructType.fromJson(listed["schema"])
    folders = [f"{path}/data/{c}/bucket={k}" for k, changes in listed["parts"].items() for c in changes if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _filled(spark: SparkSession, path: str, change: str) -> list[int]:
    at = _path(spark, f"{path}/data/{change}")
    names = [s.getPath().getName() for s in _fs(spark, path).listStatus(at)]
    return sorted(int(n[len("bucket=") :]) for n in names if n.startswith("bucket="))


def _changed(spark: SparkSession, path: str, version: int, listed: dict, rows: DataFrame | None, touched: Sequence[int], keep: bool = False) -> DataFrame:
    """Makes the next version: ``rows`` in place of the touched buckets or, with ``keep``, beside what they hold."""
    parts = {k: v for k, v in listed["parts"].items() if keep or int(k) not in set(touched)}
    if rows is not None:
        change = _write(rows, path, listed)
        for k in _filled(spark, path, change):
            parts[str(k)] = [*parts.get(str(k), []), change]
    listed = {**listed, "parts": parts}
    _show(spark, path, version + 1, listed)
    return _rows(spark, path, listed)


def _touched(df: DataFrame, listed: dict) -> list[int]:
    """Buckets of the rows: as many at most as the table has."""
    return sorted(r[0] for r in df.select(_bucket(listed["keys"], listed["buckets"])).distinct().collect())


def _same(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same &= old[k].eqNullSafe(new[k])
    return same


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table, or a version of it that is still listed. A table that is changed afterwards isn't changed for this reader."""
    return _rows(spark, path, _listed(spark, path, version)[1])


def replace(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS, files: int = 1) -> DataFrame:
    """The rows alone as the table's next, or first, version. ``files`` are the files of a bucket: more for large ones."""
    spark, found = df.sparkSession, versions(df.sparkSession, path)
    listed = {"keys": list(keys), "buckets": buckets, "files": files, "schema": json.loads(df.schema.json()), "parts": {}}
    return _changed(spark, path, found[-1] if found else 0, listed, df, [])


def merge(df: DataFrame, path: str) -> DataFrame:
    """Rows of ``df`` in place of those with their keys, which are unique in ``df``; other rows stay. Null keys equal each other."""
    spark = df.sparkSession
    version, listed = _listed(spark, path)
    touched = _touched(df, listed)
    if not touched:
        return _rows(spark, path, listed)
    old = _rows(spark, path, listed, touched)
    rows = old.join(df.select(*listed["keys"]), _same(old, df, listed["keys"]), "left_anti").unionByName(df.select(*old.columns))
    return _changed(spark, path, version, listed, rows, touched)


def append_missing(df: DataFrame, path: str) -> DataFrame:
    """Adds the rows whose key the table lacks, one of each key, as files beside those that are there: nothing is rewritten."""
    spark = df.sparkSession
    version, listed = _listed(spark, path)
    touched = _touched(df, listed)
    old, new = _rows(spark, path, listed, touched), df.dropDuplicates(listed["keys"])
    return _changed(spark, path, version, listed, new.join(old.select(*listed["keys"]), _same(new, old, listed["keys"]), "left_anti").select(*old.columns), touched, keep=True)


def update(changes: DataFrame, path: str) -> DataFrame:
    """Non-null values of ``changes`` (the keys, unique, and some columns) replace those of rows with their keys; unknown keys change nothing."""
    spark = changes.sparkSession
    version, listed = _listed(spark, path)
    keys, touched = listed["keys"], _touched(changes, listed)
    if not touched:
        return _rows(spark, path, listed)
    old = _rows(spark, path, listed, touched)
    values = [F.coalesce(changes[c], old[c]).alias(c) if c in changes.columns and c not in keys else old[c] for c in old.columns]
    return _changed(spark, path, version, listed, old.join(changes, _same(old, changes, keys), "left").select(*values), touched)


def delete(spark: SparkSession, path: str, gone: Column) -> DataFrame:
    """The table without the rows for which ``gone`` holds; rows for which it is null stay. A first scan of the condition's columns tells the buckets."""
    version, listed = _listed(spark, path)
    rows = _rows(spark, path, listed)
    touched = _touched(rows.filter(gone), listed)
    if not touched:
        return rows
    return _changed(spark, path, version, listed, _rows(spark, path, listed, touched).filter(~F.coalesce(gone, F.lit(False))), touched)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the last ``keep`` versions and the folders that none of these names, those of failed changes too; tells how many folders went.

    For times when nobody writes or reads an older version: a folder of a change in the making is named by none yet.
    """
    fs, found = _fs(spark, path), versions(spark, path)
    used = {c for v in found[-keep:] for changes in _listed(spark, path, v)[1]["parts"].values() for c in changes}
    for v in found[:-keep]:
        fs.delete(_path(spark, f"{path}/versions/{v:010d}.json"), False)
    unused = [s.getPath() for s in fs.listStatus(_path(spark, f"{path}/data")) if s.getPath().getName() not in used]
    for p in unused:
        fs.delete(p, True)
    return len(unused)
