"""What leaves a project: tables, a methodology report and a portable package."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.store import safe_articles, safe_results
from corpuslens.sources.packages import read_package, write_package  # noqa: F401  what leaves a project


def export_articles_parquet(articles: DataFrame, path: str, active_only: bool = True) -> None:
    safe_articles(articles, active_only).write.mode("overwrite").parquet(path)


def export_csv(rows: DataFrame, path: str, parts: int = 1) -> None:
    """CSV files in UTF-8, one unless more are asked for, each with a byte order mark before its headings; quotes are doubled,
    empty strings are nothing, arrays are joined by commas."""
    for column, kind in rows.dtypes:
        if kind.startswith("array"):
            rows = rows.withColumn(column, F.array_join(column, ","))
    rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]).coalesce(parts)
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def export_articles_csv(articles: DataFrame, path: str, active_only: bool = True) -> None:
    export_csv(safe_articles(articles, active_only), path)


def export_results_csv(results: DataFrame, articles: DataFrame, job_id: str, path: str) -> None:
    export_csv(safe_results(results, articles, job_id), path)


def chart_spec(kind: str, counts: DataFrame) -> dict:
    rows = counts.collect()  # periods of one series
    return {"type": "bar", "period_type": kind, "x": [r["period"] for r in rows], "y": [r["n"] for r in rows]}


def methodology_html(
    title: str, overview: DataFrame, publishers: DataFrame, months: DataFrame, keywords: DataFrame, agreement: DataFrame | None = None,
    sources: DataFrame | None = None, job_id: str | None = None,
) -> str:
    """A report of small aggregates: what the project holds, the names of its ``sources`` (a value each), the number of its publishers
    and the job, the first 20 publishers and 30 keywords, and every month in order.  Parts without rows are left out.  Every value
    is escaped, fractions have four decimals and counts separators of thousands; bodies are not among them."""

    def shown(value) -> str:
        return html.escape(f"{value:.4f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value))

    def table(rows: list, head: list[str] = ()) -> str:
        first = "<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in head) + "</tr>" if head else ""
        return "<table>" + first + "".join("<tr>" + "".join(f"<td>{shown(v)}</td>" for v in row) + "</tr>" for row in rows) + "</table>"

    def section(name: str, df: DataFrame, most: int | None) -> str:
        rows = (df if most is None else df.limit(most)).collect()
        return f"<h2>{html.escape(name)}</h2>{table(rows, df.columns)}" if rows else ""

    facts = list(overview.head().asDict().items())
    if sources is not None:
        facts.append(("sources", ", ".join(r[0] for r in sources.select(sources.columns[0]).orderBy(sources.columns[0]).collect()) or "n/a"))  # a name a source
    facts += [("publishers", publishers.count()), *([("job", job_id)] if job_id else [])]
    parts = [f"<h2>Overview</h2>{table(facts)}", section("Publishers", publishers, 20), section("Months", months.orderBy("period"), None), section("Keywords", keywords, 30)]
    if agreement is not None:
        parts.append(section("Agreement", agreement, 1))
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(parts)}"
