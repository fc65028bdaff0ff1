"""Readers for task tables, ledgers, annotation and trace files, and run directories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.sources import files as disk
from runlens.sources import runs

ATTEMPT = (
    "sweep string, inst string, rollout int, task string, attempt int, run_ts string, status string, tier string, backend string, model string, "
    "artifact_keys map<string,string>, metrics map<string,double>, extra string"
)
ANNOTATION = "instance_id string, snippets array<struct<file_path:string,start_line:int,end_line:int,category:string,description:string>>, metadata string"

SUMMARY = "lang string, instance_id string, agg_snippet_count bigint, candidate_counts array<bigint>, valid boolean, cost_usd double, duration_s double, error string"


@dataclass(frozen=True)
class Kind:
    """A registered table: the columns it must have, and what makes it typed."""

    columns: tuple[str, ...]
    normalise: Callable[[DataFrame], DataFrame] = lambda df: df


KINDS: dict[str, Kind] = {}


def register(name: str, kind: Kind) -> None:
    if name in KINDS:
        raise ValueError(f"{name} is registered already")
    KINDS[name] = kind


def find_parquet(spark: SparkSession, root: str, name: str) -> str:
    """The one Parquet file in <root>/<name>/data, on any file system; none or several are an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/data")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(x.getPath()) for x in fs.listStatus(folder) if str(x.getPath()).endswith(".parquet")] if fs.exists(folder) else []
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} Parquet files in {folder}, one expected")
    return found[0]


def load(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """Rows with `row_index`, their place in the file; missing columns are an error."""
    df = spark.read.parquet(path)
    if lost := [c for c in kind.columns if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    return kind.normalise(df.select(*(F.col(f"`{c}`") for c in kind.columns), F.col("_metadata.row_index").alias("row_index")))


def load_named(spark: SparkSession, root: str, name: str) -> DataFrame:
    return load(spark, find_parquet(spark, root, name), KINDS[name])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand on several rows: a table of unique keys has none."""
    return df.groupBy(key).count().where("count > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    if bad := repeated_keys(df, key).limit(5).collect():
        raise ValueError(f"repeated {key}: {', '.join(str(r[key]) for r in bad)}")
    return df


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, by a filter that reaches the scan."""
    return df.where(F.col(key) == value)


def require(df: DataFrame, key: str, value):
    row = get(df, key, value).first()
    if row is None:
        raise KeyError(value)
    return row


def scan_sweep(spark: SparkSession, sweep_path: str) -> DataFrame:
    """All attempts of a sweep: <inst>/r<N>/<task>/a<N>/run.json."""
    return spark.read.schema(ATTEMPT).option("multiLine", True).json(f"{sweep_path.rstrip('/')}/*/r*/*/a*/run.json")


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """<inst>/aggregate.json; a folder without any gives an empty table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*/aggregate.json")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    if found is None or not len(found):
        return spark.createDataFrame([], ANNOTATION)
    return spark.read.schema(ANNOTATION).option("multiLine", True).json(folder.toString())


def scan_candidates(spark: SparkSession, path: str, lang: str = "*") -> DataFrame:
    """<lang>__run<N>.json of one round: lang, run and the file's JSON object as a variant."""
    files = scan_files(spark, path, f"{lang}__run*.json").select("rel", decode("content").alias("text"))
    part = lambda i: F.regexp_extract("rel", r"([^/]*)__run(\d+)\.json$", i)
    return files.select(part(1).alias("lang"), part(2).cast("int").alias("run"), F.try_parse_json("text").alias("candidate"))


def scan_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Lines of summary.jsonl files."""
    return spark.read.schema(SUMMARY).option("pathGlobFilter", "summary.jsonl").option("recursiveFileLookup", True).json(path)


def scan_files(spark: SparkSession, root: str, pattern: str = "*.last_exchange.json") -> DataFrame:
    """(rel, content) of the files below root that fit the pattern, empty ones too."""
    return disk.contents(disk.listed(spark, root, pattern)).select("rel", "content")


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run folders below root: run, diff, conversation, report - null where a file is absent or, for the JSON ones, unreadable. One read of each file; filters on `run` prune folders."""
    runs.register(spark)
    return spark.read.format("runlens_runs").load(root)


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8, others as \\xNN, which no built-in writes; absent bytes are an empty text."""
    return content.map(lambda b: "" if b is None else bytes(b).decode("utf-8", "backslashreplace"))
