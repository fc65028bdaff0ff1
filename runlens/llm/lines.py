"""Cross-site boilerplate lines: HyperLogLog sketches of distinct sites, exact counts near the threshold.

A line's key is the line without blanks at its ends; a line is boilerplate if it stands on `sites` distinct sites or
more. Each line hash gets a HyperLogLog sketch of its sites, merged by aggregation before anything is shuffled whole.
Only lines whose estimate lies within MARGIN of the threshold are counted exactly. Then boilerplate lines leave all
documents: the hashes to remove go to their documents, texts are not taken apart and put together again.

Defined results: blank lines are never boilerplate and stay; null texts stay null; rows of null source count for no site
but lose boilerplate lines too; repeated rows are all cleaned; a text of boilerplate alone becomes empty; an empty table
gives an empty one; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.session import materialise

SITES = 5
MARGIN = 0.3  # four standard errors of a sketch of 2 ** LOG_K registers
LOG_K = 8
HELD = 1_000_000  # hashes that are broadcast; beyond that texts and hashes are joined


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(h): hashes of lines on at least `sites` distinct sites."""
    spark = docs.sparkSession
    rows = docs.where("source is not null and text is not null").select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    rows = rows.where(F.trim("line") != "").select(line_key(F.col("line")).alias("h"), "source")
    spread = rows.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LOG_K))).alias("about")).where(F.col("about") >= sites * (1 - MARGIN))
    spread = materialise(spark, spread)
    near = spread.where(F.col("about") <= sites * (1 + MARGIN)).select("h")
    exact = rows.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("source").alias("n")).where(F.col("n") >= sites).select("h")
    return spread.where(F.col("about") > sites * (1 + MARGIN)).select("h").unionByName(exact)


def _clean_here(docs: DataFrame, common: DataFrame) -> DataFrame:
    """For a set of hashes that every worker can hold: texts are cleaned where they are."""
    held = docs.sparkSession.sparkContext.broadcast(common.toArrow().column("h").to_numpy())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = set(held.value.tolist())
        digest = xxhash.xxh64_intdigest  # as Spark's xxhash64 of one string, but unsigned
        sign = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            row = batch.column("row")
            texts, counts, removed = [], [], []
            for text in row.field("text").to_pylist():
                lines = [] if text is None else text.split("\n")
                kept = [x for x in lines if sign(digest(x.strip(" "), 42)) not in gone]
                texts.append(None if text is None else text if len(kept) == len(lines) else "\n".join(kept))
                counts.append(len(lines))
                removed.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")]
    df = df.mapInArrow(step, T.StructType([df.schema["row"], T.StructField("text", T.StringType()), *longs]))
    return df.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")


def _clean_by_join(docs: DataFrame, common: DataFrame) -> DataFrame:
    """For any number of hashes: lines meet them by hash, and documents that lose some are put together again from the others."""
    spark = docs.sparkSession
    rows = materialise(spark, docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("id")))
    lines = rows.select("id", F.posexplode(F.split("row.text", "\n", -1)).alias("pos", "line"))
    lost = lines.select("id", "pos", line_key(F.col("line")).alias("h")).join(common, "h", "left_semi").select("id", "pos", F.lit(True).alias("gone"))
    lost = materialise(spark, lost)
    touched = lines.join(lost.select("id").distinct(), "id", "left_semi").join(lost, ["id", "pos"], "left").where("gone is null")
    kept = touched.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("kept"))
    out = rows.join(lost.groupBy("id").count(), "id", "left").join(kept, "id", "left")
    removed = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    text = F.when(removed > 0, F.coalesce("kept", F.lit(""))).otherwise(F.col("row.text"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n", -1))).cast("bigint")
    return out.select(*columns, n.alias("n_lines"), removed.alias("n_removed"))


def without_boilerplate(docs: DataFrame, sites: int = SITES, held: int = HELD) -> DataFrame:
    """The documents with boilerplate lines taken out of `text`, and n_lines and n_removed."""
    common = materialise(docs.sparkSession, boilerplate(docs, sites))
    return (_clean_here if common.count() <= held else _clean_by_join)(docs, common)


#: DuckDB's answer for the registered query.
SQL = f"""
WITH l AS (
  SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), s AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), k AS (
  SELECT doc_id, text, lines, (SELECT list(line) FROM b) AS common FROM s
), o AS (
  SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(common, trim(x)), false)) AS kept FROM k
)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_removed, md5(array_to_string(kept, chr(10))) AS text_md5 FROM o
"""
