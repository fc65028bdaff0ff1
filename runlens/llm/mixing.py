"""Mixing sources to target weights: a Pfair schedule, in DataFrame functions only.

Each source is a stream of blocks of `block` documents, in an order that mixes well (by md5 of the id). With a weight of
w units out of a period of Q, block j (from 0) of a source is released at slot floor(j Q / w) and due by slot
ceil((j + 1) Q / w). In each slot the released block with the earliest deadline goes next (ties: the source that sorts
first). Weights add up to the period, so every slot has a block and every block meets its deadline: after any number of
slots each source is within less than one block of its share. The schedule repeats after Q slots, so only one period is
drawn up, whose size depends on the number of sources alone, and every block finds its slot by arithmetic.

Sources of one weight have the same releases and deadlines, so the fold over the slots of the period looks at one
candidate for each distinct weight, however many sources there are; the slots are gathered in runs of about their root.

All rows are kept: when a source runs out its slots stay empty and the others go on in the same proportion. The rows are
written once in order of source and md5, ranges that split sources and repeated ids alike; a row's place in its file and
the counts of the files before give its rank, so that a source that holds a third of all rows is many tasks.

Defined results: rows of null source form one source (null) of their own; a null id is hashed as an empty one; repeated
ids stand next to each other; a source without a given weight, or of weight below 1, counts one unit; an empty table
gives an empty one; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialise

BLOCK = 8  # documents
UNITS = 20  # of the largest source when weights are drawn from sizes
BROADCAST_SOURCES = 10_000  # more are joined by shuffle
BROADCAST_HEADS = 1_000_000


def weights_by_size(docs: DataFrame) -> DataFrame:
    """(key, units): square-root weights, which raise the share of small sources; 1 to UNITS units. One row for each source."""
    sizes = docs.groupBy(_key()).agg(F.count("*").alias("n"))
    listed = sizes.groupBy().agg(F.collect_list(F.struct("key", "n")).alias("w"), F.max("n").alias("top")).select(F.explode("w").alias("s"), "top")
    return listed.select("s.key", F.ceil(UNITS * F.sqrt(F.col("s.n") / F.col("top"))).cast("bigint").alias("units"))


def _key() -> Column:
    """Sources as text; the null source sorts first."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("key")


def period(weights: DataFrame) -> DataFrame:
    """(key, units, total, turn, slot): at which slot of the period the turn-th block of a source goes."""
    long, zero = lambda c: c.cast("bigint"), F.lit(0).cast("bigint")
    every = weights.groupBy().agg(F.array_sort(F.collect_list(F.struct("key", "units"))).alias("w"), F.sum("units").alias("total"))
    placed = every.where("total > 0").select("w", "total", F.posexplode("w").alias("at", "s"))
    classes = placed.groupBy(F.col("s.units").alias("units")).agg(F.array_sort(F.collect_list(long(F.col("at")))).alias("members"), F.first("total").alias("total"))
    one = classes.groupBy().agg(F.array_sort(F.collect_list(F.struct("units", "members"))).alias("c"), F.first("total").alias("total")).where("total > 0")

    def turn(state: Column, t: Column) -> Column:
        """One slot. state: by class the turn it is at and how many of its members have had it; picks: (source, turn) by slot."""

        def candidate(c: Column, i: Column) -> Column:
            """(deadline, source, class) of a class's next block, null while that is not released."""
            own = state["at"][i]
            due = long(-F.floor(-(F.col("total") * (own["turn"] + 1)) / c["units"]))
            return F.when(F.col("total") * own["turn"] < (t + 1) * c["units"], F.struct(due.alias("due"), c["members"][own["done"].cast("int")].alias("source"), i.alias("class")))

        pick = F.array_min(F.transform("c", candidate))

        def moved(own: Column, i: Column) -> Column:
            done = own["done"] + 1
            whole = done == F.size(F.col("c")[i]["members"])
            after = F.struct((own["turn"] + F.when(whole, 1).otherwise(0)).alias("turn"), F.when(whole, zero).otherwise(done).alias("done"))
            return F.when(i == pick["class"], after).otherwise(own)

        got = F.struct(pick["source"].alias("source"), F.element_at(state["at"], pick["class"] + 1)["turn"].alias("turn"))
        return F.struct(F.transform(state["at"], moved).alias("at"), F.concat(state["picks"], F.array(got)).alias("picks"))

    none = F.array().cast("array<struct<source:bigint,turn:bigint>>")
    run = F.greatest(F.lit(1).cast("bigint"), long(F.ceil(F.sqrt("total"))))

    def many(state: Column, r: Column) -> Column:
        """One run of slots."""
        slots = F.sequence(r * run, F.least((r + 1) * run, F.col("total")) - 1)
        end = F.aggregate(slots, F.struct(state["at"].alias("at"), none.alias("picks")), turn)
        return F.struct(end["at"].alias("at"), F.concat(state["runs"], F.array(end["picks"])).alias("runs"))

    start = F.struct(F.transform("c", lambda x: F.struct(zero.alias("turn"), zero.alias("done"))).alias("at"), F.array().cast("array<array<struct<source:bigint,turn:bigint>>>").alias("runs"))
    runs = F.sequence(zero, long(F.ceil(F.col("total") / run)) - 1)
    slots = one.select("total", F.posexplode(F.flatten(F.aggregate(runs, start, many, lambda s: s["runs"]))).alias("slot", "p"))
    slots = slots.select(F.col("p.source").alias("at"), "p.turn", F.col("slot").cast("bigint").alias("slot"))
    sources = placed.select(long(F.col("at")).alias("at"), "s.key", "s.units", "total")
    return sources.join(slots, "at").select("key", "units", "total", "turn", "slot")


def _ranked(docs: DataFrame) -> DataFrame:
    """(row, key, rank): the documents as structs, numbered within their source by md5 of the id."""
    spark = docs.sparkSession
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key(), order.alias("order"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("tie"))
    written = materialise(spark, rows.repartitionByRange("key", "order", "id", "tie").sortWithinPartitions("key", "order", "id", "tie"))
    written = written.withColumns({"file": F.col("_metadata.file_path"), "line": F.col("_metadata.row_index")})
    heads = written.groupBy("key", "file").agg(F.min("line").alias("first"), F.count("*").alias("n"), F.min(F.struct("order", "id", "tie")).alias("from"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = materialise(spark, heads.select("key", "file", (before - F.col("first")).alias("shift")))
    few = heads.count() <= BROADCAST_HEADS  # a row for each file and source in it
    return written.join(F.broadcast(heads) if few else heads, ["key", "file"]).select("row", "key", (F.col("line") + F.col("shift")).alias("rank"))


def schedule(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents with block (its number within the source), release, deadline, slot and place (within the block)."""
    spark = docs.sparkSession
    if weights is None:
        units = weights_by_size(docs)
    else:
        given = spark.createDataFrame([("" if k is None else "s" + k, int(v)) for k, v in weights.items()], "key string, given bigint")
        units = docs.select(_key()).distinct().join(F.broadcast(given), "key", "left").select("key", F.greatest(F.coalesce("given", F.lit(1)), F.lit(1)).cast("bigint").alias("units"))
    plan = materialise(spark, period(units))

    # a row for each unit of each source, whatever the number of documents
    few = (plan.agg(F.max("total")).first()[0] or 0) <= UNITS * BROADCAST_SOURCES
    held = F.broadcast if few else lambda df: df
    numbered = _ranked(docs).select("row", "key", F.floor(F.col("rank") / block).alias("block"), (F.col("rank") % block).alias("place"))
    placed = numbered.join(held(plan.where("turn = 0").select("key", F.col("units").alias("u"))), "key")
    placed = placed.withColumn("turn", F.col("block") % F.col("u")).join(held(plan), ["key", "turn"])
    whole = lambda c: c.cast("bigint")
    placed = placed.select(
        "row", whole(F.col("block")).alias("block"), whole(F.floor(F.col("block") * F.col("total") / F.col("units"))).alias("release"),
        whole(F.ceil((F.col("block") + 1) * F.col("total") / F.col("units"))).alias("deadline"),
        (whole(F.floor(F.col("block") / F.col("units"))) * F.col("total") + F.col("slot")).alias("slot"), whole(F.col("place")).alias("place"),
    )
    own = ("block", "release", "deadline", "slot", "place")
    return placed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in own), *own)


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents in the order of the schedule, columns as they were: the order in which the partitions hold them."""
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "source")
    return schedule(inner, weights, block).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*(F.col(f"_row.`{c}`") for c in docs.columns))


#: DuckDB's answer for the registered query: the schedule slot by slot, ranks by plain windows.
SQL = f"""
WITH RECURSIVE k AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS key FROM documents
), z AS (
  SELECT key, count(*) AS n FROM k GROUP BY key
), u AS (
  SELECT key, CAST(ceil({UNITS} * sqrt(n / (SELECT max(n) FROM z))) AS BIGINT) AS units FROM z
), w AS (
  SELECT list(key ORDER BY key) AS keys, list(units ORDER BY key) AS units, CAST(sum(units) AS BIGINT) AS total FROM u
), s(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(units, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM w
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, done, CAST(list_position(due, list_min(due)) AS BIGINT) AS p FROM (
      SELECT t, done, list_transform(done, lambda d, i: CASE WHEN w.total * d < (t + 2) * w.units[i]
        THEN (w.total * (d + 1) + w.units[i] - 1) // w.units[i] END) AS due
      FROM s, w WHERE t + 1 < w.total))
), plan AS (
  SELECT w.keys[pick] AS key, w.units[pick] AS units, w.total, t AS slot,
    row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM s, w WHERE t >= 0
), r AS (
  SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM k
), b AS (
  SELECT r.*, rank // {BLOCK} AS block, rank % {BLOCK} AS place, u.units FROM r JOIN u USING (key)
)
SELECT doc_id, source, block, block * total // b.units AS release, ((block + 1) * total + b.units - 1) // b.units AS deadline,
  block // b.units * total + slot AS slot, place
FROM b JOIN plan ON plan.key = b.key AND plan.turn = b.block % b.units
"""
