"""Keyed state on immutable tables: first write wins, latest wins, what is pending, checks of stored hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The columns that may leave a project.
ARTICLE_COLUMNS = ("article_id", "source", "date", "publisher", "title", "body_excerpt", "keywords", "url", "cleaned_at", "is_active")
RESULT_COLUMNS = ("article_id", "date", "publisher", "title", "body_excerpt", "label", "confidence", "rationale", "called_at")


def first_write(new: DataFrame, stored: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that isn't stored yet."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = new.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return first if stored is None else first.join(stored.select(*key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str, preserve: str) -> DataFrame:
    """The latest row of each key, with the earliest value of ``preserve``; equal times: the new table's row."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    window = Window.partitionBy(key)
    last = F.row_number().over(window.orderBy(F.desc(order), F.desc("_new")))
    both = both.withColumn("_first", F.min(preserve).over(window)).withColumn("_rank", last).filter("_rank = 1")
    return both.withColumn(preserve, F.col("_first")).select(*stored.columns)


def pending(sample: DataFrame, results: DataFrame, job_id: str) -> DataFrame:
    """Articles without a successful result of the job; failed ones come again."""
    done = results.filter((F.col("job_id") == job_id) & F.col("success")).select("article_id").distinct()
    return sample.join(done, "article_id", "left_anti")


def surviving(articles: DataFrame, kept: DataFrame) -> DataFrame:
    """The articles whose article_id is among those kept; each once, however often ``kept`` has it."""
    return articles.join(kept.select("article_id"), "article_id", "left_semi")


def with_verified(texts: DataFrame, text: str = "prompt_text", sha256: str = "sha256") -> DataFrame:
    """Adds ``verified``: whether the stored hash is that of the text; without either it is not."""
    return texts.withColumn("verified", F.coalesce(F.sha2(F.col(text).cast("binary"), 256) == F.col(sha256), F.lit(False)))


def sample_first(articles: DataFrame, n: int) -> DataFrame:
    ordered = articles.orderBy("date", "article_id")
    return ordered.limit(n) if n else ordered


def safe_articles(articles: DataFrame, active_only: bool = True) -> DataFrame:
    """The columns that may leave the project; full bodies are not among them."""
    rows = articles.filter("is_active") if active_only else articles
    return rows.select(*ARTICLE_COLUMNS).orderBy("date", "article_id")


def latest_results(results: DataFrame) -> DataFrame:
    """One row for each job and article: the last call; of calls at one time a successful one."""
    keys = ["job_id", "article_id"]
    row = F.max_by(F.struct(*[c for c in results.columns if c not in keys]), F.struct("called_at", "success")).alias("row")
    return results.groupBy(*keys).agg(row).select(*keys, "row.*").select(*results.columns)


def safe_results(results: DataFrame, articles: DataFrame, job_id: str) -> DataFrame:
    """The last successful results of the job on active articles."""
    last = latest_results(results.filter(F.col("job_id") == job_id)).filter("success")
    return last.join(articles.filter("is_active"), "article_id").select(*RESULT_COLUMNS).orderBy("date", "article_id")


def changed_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem) of files that are missing or whose hash differs."""
    joined = expected.join(actual.withColumnRenamed("sha256", "found"), "path", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "mismatch")
    return joined.select("path", problem.alias("problem")).filter("problem is not null")


def job_metrics(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id").agg(
        F.count("*").alias("n_processed"), F.count_if(~F.col("success")).alias("n_errors"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )


def recent_activity(*logs: DataFrame, n: int = 5) -> DataFrame:
    """The latest ``n`` of the logs' rows (kind, what, at)."""
    found = logs[0]
    for log in logs[1:]:
        found = found.unionByName(log)
    return found.orderBy(F.desc("at"), "kind", "what").limit(n)
