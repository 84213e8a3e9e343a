"""Article sources: CSV and spreadsheets, one file or one folder, with mapped columns."""

from __future__ import annotations

import csv
import io
import json
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as t
from corpuslens.sources.archive import HEADINGS, register, spreadsheet_rows
from corpuslens.sources.csv_ranges import read_ranges

FIELDS = ("title", "date", "body", "publisher", "keywords", "url")

#: Bytes of a file that are read to find its encoding and headings.
_HEAD_BYTES = 1 << 16
# Byte order marks; what has none is UTF-8.
_MARKS = ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"), (b"\xef\xbb\xbf", "UTF-8"))


def _head(spark: SparkSession, file: str) -> bytes:
    """The first bytes of a file, whatever file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readNBytes(_HEAD_BYTES))
    finally:
        stream.close()


def format_of(head: bytes) -> tuple[str, tuple[str, ...] | None]:
    """Encoding by the byte order mark, and the headings; None where they don't end within what was read."""
    mark, encoding = next((x for x in _MARKS if head.startswith(x[0])), (b"", "UTF-8"))
    text = head[len(mark) :].decode(encoding, "ignore")
    rows = csv.reader(io.StringIO(text, newline=""))
    headings = next(rows, [])
    ended = len(head) < _HEAD_BYTES or next(rows, None) is not None
    return encoding, tuple(headings) if ended else None


def read_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, seen: Observation | None = None) -> DataFrame:
    """Strings alone: nothing is inferred.  Files of one encoding with the same headings are one scan; scans are matched by
    name.  The driver reads only the head of each file.  UTF-8 files are read in ranges of bytes, side by side; others, and those whose
    headings are longer than the head, are a task each."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").orderBy("path").collect()
    scans: dict[tuple, list[str]] = {}
    for file in (r["path"] for r in listed):
        encoding, headings = format_of(_head(spark, file))
        scans.setdefault((encoding, headings if headings is not None else (file, None)), []).append(file)
    out = None
    for (encoding, headings), files in scans.items():
        if encoding == "UTF-8" and headings and None not in headings:
            raw = read_ranges(spark, files, headings)
        else:
            raw = spark.read.csv(files, header=True, multiLine=True, escape='"', inferSchema=False, encoding=encoding)
        out = raw if out is None else out.unionByName(raw, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path)
    return to_articles(out, columns or {}, "csv", keep_undated=True, seen=seen)


def read_xlsx(spark: SparkSession, path: str, headings: dict[str, str] | None = None, seen: Observation | None = None) -> DataFrame:
    """One spreadsheet or the spreadsheets of a folder, on any store that Spark reads; each file is parsed where its bytes are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = enumerate(spreadsheet_rows(io.BytesIO(content)))
                while part := list(islice(rows, 1000)):
                    yield pd.DataFrame({"path": [path] * len(part), "line": [i for i, _ in part], "cells": [r for _, r in part]})

    raw = files.mapInPandas(run, "path string, line int, cells map<string,string>")
    known = headings or HEADINGS
    raw = raw.select("path", "line", "cells", *[F.col("cells")[h].alias(name) for h, name in known.items()])
    return to_articles(raw, {}, "archive", keep_undated=False, seen=seen)


def read_archive(spark: SparkSession, path: str, headings: dict[str, str] | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The same through the ``news_archive`` data source, for stores that Python can open.  The dates reach the reader: rows
    outside, and undated ones where a start is set, never leave it."""
    register(spark)
    source = spark.read.format("news_archive")
    raw = (source.option("headings", json.dumps(headings)) if headings else source).load(path)
    for test, bound in ((F.col("date") >= date_from, date_from), (F.col("date") <= date_to, date_to)):
        raw = raw.filter(test) if bound else raw
    return to_articles(raw, {}, "archive", keep_undated=False)


def to_articles(raw: DataFrame, columns: dict[str, str], source: str, keep_undated: bool, seen: Observation | None = None) -> DataFrame:
    """Maps, strips and normalises; rows without a title go.  ``undated_kept`` tells the date filter what to do.  ``seen`` gets the
    number of rows, those without a title included, as ``raw``, from whatever pass reads them."""
    if seen is not None:
        raw = raw.observe(seen, F.count(F.lit(1)).alias("raw"))

    def of(field: str) -> Column:
        names = [n for n in dict.fromkeys([columns.get(field, field), field]) if n in raw.columns]
        return t.strip(F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names], F.lit("")))

    rows = raw.select(*[of(f).alias(f) for f in FIELDS], (of("date_raw") if "date_raw" in raw.columns else of("date")).alias("date_raw"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("raw_json"))
    rows = rows.filter("title <> ''").withColumn("date", t.normalize_date(F.col("date")))
    key = t.article_id(F.lit(source), F.col("title"), F.col("date"), F.col("publisher"))
    body = t.normalize_whitespace(F.col("body"))
    return rows.select(
        key.alias("article_id"), F.lit(source).alias("source"), "date", "date_raw", "publisher", "title", F.col("body").alias("body_internal"),
        t.excerpt(body).alias("body_excerpt"), t.keywords(F.col("keywords")).alias("keywords"), "url", "raw_json", F.lit(keep_undated).alias("undated_kept"),
    )


def in_range_test(date_from: str | None = None, date_to: str | None = None) -> Column:
    """Inclusive, by text order.  Undated rows of spreadsheets go where a start is set; those of CSV files stay."""
    keep = F.lit(True)
    if date_from:
        keep &= F.when(F.col("date") == "", F.col("undated_kept")).otherwise(F.col("date") >= date_from)
    if date_to:
        keep &= (F.col("date") == "") | (F.col("date") <= date_to)
    return keep


def in_range(articles: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    return articles.filter(in_range_test(date_from, date_to))


def read_news_api(*_: object) -> DataFrame:
    raise NotImplementedError("search services are not available in this version")


def read_raters(spark: SparkSession, first: str, second: str, key: str = "article_id", label: str = "label") -> DataFrame:
    """(a, b): labels of two CSV files, matched by key; what only one of them has is left out."""
    one, two = (spark.read.csv(p, header=True, multiLine=True, escape='"', inferSchema=False).select(F.col(key).alias("key"), F.col(label).alias(n)) for p, n in ((first, "a"), (second, "b")))
    return one.join(two, "key").select("a", "b")
