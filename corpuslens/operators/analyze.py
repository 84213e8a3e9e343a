"""Descriptive statistics, time series, cross-tabulations and rater agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as t
from corpuslens.operators.clean import cut_lineage


def descriptive(articles: DataFrame) -> DataFrame:
    size = F.length("body_internal")
    has = size > 0
    return articles.agg(
        F.count("*").alias("total"),
        F.count_if("is_active").alias("active"),
        F.coalesce(F.min("date"), F.lit("")).alias("first_date"),
        F.coalesce(F.max("date"), F.lit("")).alias("last_date"),
        *[F.coalesce(f(F.when(has, size)).cast("double"), F.lit(0.0)).alias(n) for n, f in (("mean_chars", F.avg), ("median_chars", F.median), ("min_chars", F.min), ("max_chars", F.max))],
    )


def group_counts(df: DataFrame, column: str) -> DataFrame:
    if column not in ("publisher", "source"):
        raise ValueError(f"unsupported column: {column}")
    return df.groupBy(t.or_unknown(F.col(column)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def keyword_counts(df: DataFrame, words: Column, top: int = 50) -> DataFrame:
    found = df.select(F.explode(words).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "keyword").limit(top)


def period_counts(df: DataFrame, period: Column) -> DataFrame:
    return df.groupBy(period.alias("period")).agg(F.count("*").alias("n")).orderBy("period")


#: Column labels that get zeros, at most.  Where a model's free text has become labels, zeros for all of them would be rows
#: times labels, so that there only the counts are given.
MOST_DENSE = 1000


def _dense(rows: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """``counts`` with zeros: every one of ``rows`` with every label of ``column``, nulls being labels like others."""
    labels = [r[0] for r in counts.select(column).distinct().limit(MOST_DENSE + 1).collect()]
    if not labels or len(labels) > MOST_DENSE:
        return counts
    every = rows.withColumn("_label", F.explode(F.array(*[F.lit(x).cast(counts.schema[column].dataType) for x in labels])))
    (row,) = rows.columns
    found = counts.select(F.col(row).alias("_row"), F.col(column).alias("_column"), "n")
    same = F.col(row).eqNullSafe(F.col("_row")) & F.col("_label").eqNullSafe(F.col("_column"))
    return every.join(found, same, "left").select(row, F.col("_label").alias(column), F.coalesce("n", F.lit(0)).alias("n"))


def labelled(results: DataFrame, articles: DataFrame) -> DataFrame:
    """A job's results (one for each article) on active articles, with the articles' columns; failed ones have no label."""
    return results.join(articles.filter("is_active"), "article_id")


def label_periods(labelled: DataFrame, period: Column, articles: DataFrame | None = None) -> DataFrame:
    """(period, label, n) of articles with labels; null and empty labels are one.  Every period of ``articles`` (without
    them: of ``labelled``) is there with every label, with zeros; an article without a date has a period of its own, null.
    Zeros are given for MOST_DENSE labels at most."""
    counts = labelled.groupBy(period.alias("period"), t.or_unknown(F.col("label")).alias("label")).agg(F.count("*").alias("n"))
    periods = (labelled if articles is None else articles).select(period.alias("period")).distinct()
    return _dense(periods, "label", counts).orderBy("period", "label")


def classified(results: DataFrame, articles: DataFrame) -> DataFrame:
    """How many of the articles have a result of any job: one row."""
    return results.select("article_id").distinct().join(articles.select("article_id"), "article_id", "left_semi").agg(F.count("*").alias("n"))


def progress(calls: DataFrame, job: str, order: list[str], buckets: int = 64) -> DataFrame:
    """Adds what each job had processed, and got wrong, with each of its calls, and how many percent of all this was.

    Calls are dealt to ranges of the order over all jobs, so that a job may be many tasks; what lies before a range is known from a sum
    of each range, and only within it are calls counted one by one."""
    ranged = cut_lineage(calls.repartitionByRange(buckets, job, *order).withColumn("_range", F.spark_partition_id()))
    ranges = ranged.groupBy(job, "_range").agg(F.count("*").alias("_n"), F.count_if(~F.col("success")).alias("_wrong"))
    before = Window.partitionBy(job).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(job)
    starts = ranges.select(
        F.col(job).alias("_job"), F.col("_range").alias("_start"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_wrong").over(before), F.lit(0)).alias("_wrong_before"), F.sum("_n").over(whole).alias("_all"),
    )
    so_far = Window.partitionBy(job, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumns({"_so_far": F.count("*").over(so_far), "_errors": F.count_if(~F.col("success")).over(so_far)})
    found = counted.join(starts, F.col(job).eqNullSafe(F.col("_job")) & (F.col("_range") == F.col("_start")))
    done = F.col("_before") + F.col("_so_far")
    return found.select(*calls.columns, done.alias("processed"), (F.col("_wrong_before") + F.col("_errors")).alias("errors"), (100 * done / F.col("_all")).alias("percent"))


# What the rows of ``analysis_sets`` stand for.
_SETS = {"all": (), "publisher": ("publisher",), "source": ("source",), "month": ("month",), "week": ("week",), "size": ("size",), "label_month": ("label", "month"), "label_publisher": ("label", "publisher")}


def analysis_sets(articles: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """All counts of an analysis from one scan of the articles: part, value, label, total, n, n_labelled, first_date, last_date, chars.

    ``part`` names the grouping: all, publisher, source, month, week, size (characters of the body, for the median), label_month and
    label_publisher; ``value`` is the group's, null for all rows or a missing date.  total counts all articles, n active ones, n_labelled
    active ones with a result in ``labels`` (article_id, label)."""
    month = t.month_of(F.col("date"))
    rows = articles.select(
        "article_id", "is_active", "date", t.or_unknown(F.col("publisher")).alias("publisher"), t.or_unknown(F.col("source")).alias("source"),
        month.alias("month"), t.week_of(F.col("date")).alias("week"), F.length("body_internal").cast("long").alias("size"),
    )
    if labels is None:
        rows = rows.withColumns({"label": F.lit(None).cast("string"), "has": F.lit(False)})
    else:
        given = labels.select("article_id", t.or_unknown(F.col("label")).alias("label"), F.lit(True).alias("has"))
        rows = rows.join(given, "article_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    wanted = {k: v for k, v in _SETS.items() if labels is not None or "label" not in v}
    keys = ["publisher", "source", "month", "week", "size", "label"]
    numbers = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in v): part for part, v in wanted.items()}
    found = rows.groupingSets([[F.col(c) for c in v] for v in wanted.values()], *map(F.col, keys)).agg(
        F.grouping_id(*keys).alias("set"), F.count("*").alias("total"), F.count_if("is_active").alias("n"), F.count_if(F.col("is_active") & F.col("has")).alias("n_labelled"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(F.when(F.col("size") > 0, F.col("size"))).alias("chars"),
    )
    part = F.create_map(*[F.lit(x) for number, name in numbers.items() for x in (number, name)])[F.col("set").cast("int")]
    value = F.coalesce(*[F.when(F.col("part").endswith(c), F.col(c).cast("string")) for c in keys[:-1]])
    return found.withColumn("part", part).select("part", value.alias("value"), "label", "total", "n", "n_labelled", "first_date", "last_date", "chars")


def of_part(sets: DataFrame, part: str, name: str) -> DataFrame:
    """Active articles by the values of one part of ``analysis_sets``: (name, n); groups of inactive articles alone are not there."""
    return sets.filter((F.col("part") == part) & (F.col("n") > 0)).select(F.col("value").alias(name), "n")


def descriptive_of(sets: DataFrame) -> DataFrame:
    """``descriptive`` from the parts all and size: the median is where half of the sizes' counts lie."""
    sizes = sets.filter("part = 'size'").select(F.col("value").cast("long").alias("size"), "total").filter("size > 0")
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("size", "total"))).alias("sizes"), F.sum("total").alias("with_text"), F.min("size").alias("least"), F.max("size").alias("most"))
    upto = F.expr("aggregate(sizes, named_struct('n', 0L, 'low', 0L, 'high', 0L), (a, x) -> named_struct('n', a.n + x.total, 'low', if(2 * a.n < with_text, x.size, a.low), 'high', if(2 * a.n <= with_text, x.size, a.high)))")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    # Of an empty table there is no row for all.
    whole = sets.filter("part = 'all'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "n", "chars")], F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    whole = whole.withColumn("one", F.lit(1)).join(listed.withColumn("one", F.lit(1)).withColumn("upto", upto), "one")
    middle = (F.col("upto.low") + F.col("upto.high")) / 2
    return whole.select(
        "total", F.col("n").alias("active"), F.coalesce("first_date", F.lit("")).alias("first_date"), F.coalesce("last_date", F.lit("")).alias("last_date"),
        number(F.col("chars") / F.col("with_text")).alias("mean_chars"), number(middle).alias("median_chars"), number(F.col("least")).alias("min_chars"), number(F.col("most")).alias("max_chars"),
    )


def label_periods_of(sets: DataFrame) -> DataFrame:
    """``label_periods`` by month from ``analysis_sets``: every month of an active article with every label."""
    counts = sets.filter("part = 'label_month' and n_labelled > 0").select(F.col("value").alias("period"), "label", F.col("n_labelled").alias("n"))
    return _dense(of_part(sets, "month", "period").select("period"), "label", counts).orderBy("period", "label")


def label_tab_of(sets: DataFrame, column: str) -> DataFrame:
    """``label_tab`` from ``analysis_sets``."""
    rows = sets.filter((F.col("part") == f"label_{column}") & (F.col("n_labelled") > 0))
    counts = rows.groupBy(F.col("label").alias("row_label"), t.or_unknown(F.col("value")).alias("col_label")).agg(F.sum("n_labelled").alias("n"))
    return _dense(counts.select("col_label").distinct(), "row_label", counts).select("row_label", "col_label", "n")


def overview(articles: DataFrame, results: DataFrame) -> DataFrame:
    """total, active and classified: articles, active ones, and results on these articles; one row."""
    counts = articles.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active")).withColumn("one", F.lit(1))
    known = results.join(articles.select("article_id"), "article_id", "left_semi").agg(F.count("*").alias("classified"))
    return counts.join(known.withColumn("one", F.lit(1)), "one").drop("one")


def cross_tab(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """Long form with zeros: every row label with every column label that occurs; a missing or empty one is ``unknown``.  Zeros
    are given for MOST_DENSE row labels at most."""
    counts = df.groupBy(t.or_unknown(row).alias("row_label"), t.or_unknown(column).alias("col_label")).agg(F.count("*").alias("n"))
    return _dense(counts.select("col_label").distinct(), "row_label", counts).select("row_label", "col_label", "n")


def label_tab(labelled: DataFrame, column: str) -> DataFrame:
    """Labels against ``publisher`` or ``month``."""
    if column not in ("publisher", "month"):
        raise ValueError(f"unsupported column: {column}")
    return cross_tab(labelled, F.col("label"), F.col("publisher") if column == "publisher" else t.month_of(F.col("date")))




def agreement(raters: DataFrame) -> DataFrame:
    """n, accuracy and Cohen's kappa of ``raters`` (a, b), from one confusion table."""
    cells = raters.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = F.sum("n")
    rows = cells.groupBy(F.col("a").alias("label")).agg(total.alias("na"))
    columns = cells.groupBy(F.col("b").alias("label")).agg(total.alias("nb"))
    chance = rows.join(columns, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    whole = cells.agg(F.coalesce(total, F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    both = whole.withColumn("one", F.lit(1)).join(chance.withColumn("one", F.lit(1)), "one")
    n, seen, luck = F.col("n"), F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    kappa = F.when(n == 0, 0.0).when(F.col("chance") == n * n, 1.0).otherwise((seen - luck) / (1 - luck))
    return both.select("n", F.when(n == 0, 0.0).otherwise(seen).alias("accuracy"), kappa.alias("kappa"))


def agreement_by_label(raters: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every label that either rater gave; rater b is held against a."""
    cells = raters.groupBy("a", "b").agg(F.count("*").alias("n"))
    hit = F.col("a") == F.col("b")
    parts = cells.select(F.explode(F.when(hit, F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(F.array(
        F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")),
        F.struct(F.col("a").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn"))))).alias("x")).select("x.*")
    sums = parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    sums = sums.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return sums.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def quota_use(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """For each call (slot, ts_sec, call_id, tokens) how many calls its slot made, and how many tokens they took, in the last
    ``seconds``, itself included.  Calls are windowed by stretches of that length, each with a copy of the one before, so that
    a slot is not one task."""
    window = Window.partitionBy("slot", "_stretch").orderBy("ts_sec").rangeBetween(1 - seconds, 0)
    stretch = F.floor(F.col("ts_sec") / seconds)
    copies = calls.withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_stretch", stretch + F.col("_later"))
    used = copies.withColumns({"in_window": F.count("*").over(window), "tokens_in_window": F.sum("tokens").over(window)})
    return used.filter("_later = 0").drop("_later", "_stretch")
