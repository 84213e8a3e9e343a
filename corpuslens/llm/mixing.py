"""Mixing sources to target weights by capped water-filling, with built-in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm._common import scratch, stored, table

#: Hash bins at least, and the rows that a bin holds on average at most.
_BINS, _BIN_ROWS = 4096, 16384
#: Sources whose targets are broadcast at most; beyond it they are joined by a shuffle.
_BROADCAST_SOURCES = 10_000


def word_count(name: str = "text") -> Column:
    text = F.coalesce(F.col(name), F.lit(""))
    # \z and not $, which also matches before a final line separator of Unicode
    parts = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""), r"[\x20\x09-\x0D]+")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(parts)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size): one row for each source, ranked in one task.

    With water level L a target is ``min(max_epochs * source_size, L * weight)``.  Sources are sorted by the level at
    which they are full; L is the first level (the highest, as they fall from there) at which what the full ones leave, shared by the weights of the others,
    fills no further source.  All targets together are the sum of all sizes."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    ranked = ranked.withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", F.col("left") / F.col("weights_left"))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def draw(seed: int) -> Column:
    """A seeded place in [0, 2**40) for each doc_id, the same in every run and engine; rows without a doc_id are spread by
    their text."""
    own = F.concat(F.lit("null-"), F.md5(F.coalesce("text", F.lit(""))))
    name = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), own))
    return F.conv(F.substring(F.md5(name), 1, 10), 16, 10).cast("long")


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 8, cut: bool = True,
    with_row: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target, ``whole`` (full repetitions) and ``extra`` (words of one more) of every row.

    Every document of a source is repeated as often as the target holds the whole source.  The rest is drawn: in
    the order of a seeded hash documents are taken once more until the rest is used up; the last one gives only the
    words still missing (``cut``), or is taken whole or not at all, whichever is nearer.  The order isn't sorted
    out source by source: hash bins are summed before the shuffle, and only the one bin in which the rest ends is ordered,
    so a source with a third of all rows is spread like any other.

    Null texts have size 0, null sources are one source, ranked last; rows that repeat are drawn row by row; an empty
    table gives no rows.  Only doc_id, source and text are read, and (``with_row``) all columns returned in ``row``; texts are
    not shuffled but for those of the bins in which a rest ends."""
    numbers = ["doc_id", "source", word_count().alias("size"), draw(seed).alias("place")]
    sized = stored(docs.select(*numbers), "mix-sizes")
    n_bins = max(_BINS, 1 << (sized.count() // _BIN_ROWS).bit_length())  # a bin holds so many rows, whatever the input
    bin_of = (F.col("place") / F.lit(2**40 // n_bins)).cast("int")
    sized = sized.withColumn("bin", bin_of)
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    by_bin = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("bin_size").over(by_bin)).withColumnRenamed("source", "bin_source")
    ends = bins.join(targets, F.col("bin_source").eqNullSafe(F.col("source"))).filter("upto > rest")
    ends = ends.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("end"))
    ends = ends.select(F.col("source").alias("end_source"), F.col("end.bin").alias("end_bin"), F.col("end.before").alias("end_before"))
    targets = targets.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source")
    path = scratch(docs.sparkSession, "mix-targets")
    targets.withColumnRenamed("source", "target_source").coalesce(1).write.parquet(path)
    targets = docs.sparkSession.read.parquet(path)
    if targets.count() <= _BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    every = docs.select(*numbers, F.struct(*docs.columns).alias("row")).withColumn("bin", bin_of) if with_row else sized
    planned = every.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
    end_bin = F.coalesce("end_bin", F.lit(n_bins))
    ordered = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce("end_before", F.lit(0)) - F.coalesce(F.sum("size").over(ordered), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    if not cut:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", *(["row"] if with_row else [])]
    clear = planned.filter(F.col("bin") != end_bin)
    clear = clear.select(*columns, F.when(F.col("bin") < end_bin, F.col("size")).otherwise(0).alias("extra"))
    return clear.unionByName(planned.filter(F.col("bin") == end_bin).select(*columns, part.alias("extra")))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 8
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``plan_mix`` says, in whole documents; rows that get none
    and rows without words are left out."""
    plan = plan_mix(docs, weights, max_epochs, seed, cut=False, with_row=True)
    times = (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    repeated = plan.filter("size > 0").select("row", times.alias("times")).filter("times > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``plan_mix``: null texts have size 0 and are taken with 0 words, null doc_ids and sources
    stay null, an empty table gives no rows."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP8_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('8-' || coalesce(CAST(doc_id AS VARCHAR), 'null-' || md5(coalesce(text, '')))), 1, 10) AS BIGINT) AS place
  FROM documents),
ranked AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source)),
levels AS (
  SELECT source, s, w, 3 * s / CAST(w AS DOUBLE) AS full_at,
    CAST((sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0)) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
  FROM ranked
  WINDOW before AS (ORDER BY 3 * s / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, s, least(CAST(3 * s AS DOUBLE), coalesce(max(level) FILTER (level <= full_at) OVER (), 0.0) * w) AS target FROM levels),
rests AS (
  SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS whole,
    CAST(round(target - (CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END) * s) AS BIGINT) AS rest FROM targets),
drawn AS (
  SELECT d.doc_id, d.size, r.s AS source_size, r.target, r.whole,
    r.rest - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, left_over)) AS BIGINT) AS taken FROM drawn
"""
