"""Spreadsheets, exports, the report and the stream on small files that the tests write."""

import csv
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import analyze, store
from corpuslens.sources import archive, csv_ranges, exports, files, packages
from corpuslens.streaming.ingest import ingest_stream

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets, shared=()):
    """Sheets by number; a cell is (reference, kind, value)."""
    with zipfile.ZipFile(path, "w") as out:
        if shared:
            out.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>" + "".join(f"<si><r><t>{x[:1]}</t></r><r><t>{x[1:]}</t></r></si>" for x in shared) + "</sst>")
        for number, rows in sheets.items():
            body = "".join("<row>" + "".join(cell(*c) for c in row) + "</row>" for row in rows)
            out.writestr(f"xl/worksheets/sheet{number}.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")


def cell(at, kind, value):
    if kind == "inlineStr":
        return f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>'
    return f'<c r="{at}"' + (f' t="{kind}"' if kind else "") + (f"><v>{value}</v></c>" if value is not None else "/>")


SHARED = ["일자", "제목", "본문", "언론사", "통합 분류1", "참사 소식"]
ROWS = [
    [("A1", "s", 0), ("B1", "s", 1), ("C1", "s", 2), ("D1", "s", 3), ("AA1", "s", 4)],
    [("A2", None, "20221030.0"), ("B2", "s", 5), ("C2", "inlineStr", " first  body "), ("AA2", "inlineStr", "society")],
    [("A3", None, None), ("B3", "inlineStr", "  ")],
    [("A4", None, "20221101"), ("B4", "inlineStr", " "), ("C4", "inlineStr", "has no title")],
    [("B5", "inlineStr", "undated"), ("D5", "inlineStr", "P")],
]


def test_spreadsheets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    workbook(tmp_path / "in" / "a.xlsx", {10: [[("A1", "inlineStr", "제목")], [("A2", "inlineStr", "of another sheet")]], 2: ROWS}, SHARED)
    workbook(tmp_path / "in" / "b.xlsx", {1: []})
    workbook(tmp_path / "in" / "c.xlsx", {1: [[("A1", "inlineStr", "제목"), ("B1", "inlineStr", "일자")], [("A2", "inlineStr", "other"), ("B2", "inlineStr", "2022/11/02")]]})
    (tmp_path / "in" / "d.txt").write_text("no workbook")
    found = files.read_xlsx(spark, str(tmp_path / "in"))
    rows = {r["title"]: r for r in found.collect()}
    assert {k: (r["date"], r["body_internal"].strip(), r["publisher"]) for k, r in rows.items()} == {
        "참사 소식": ("2022-10-30", "first  body", ""), "undated": ("", "", "P"), "other": ("2022-11-02", "", ""),
    }
    assert rows["참사 소식"]["body_excerpt"] == "first body" and "society" in rows["참사 소식"]["raw_json"]
    assert {r["title"] for r in files.in_range(found, "2022-10-01", "2022-10-31").collect()} == {"참사 소식"}
    assert {r["title"] for r in files.in_range(found, None, "2022-10-31").collect()} == {"참사 소식", "undated"}
    one = files.read_xlsx(spark, str(tmp_path / "in" / "c.xlsx"))
    assert [r["title"] for r in one.collect()] == ["other"]


def articles(spark):
    row = lambda i, active=True: (str(i), "csv", f"2024-0{i}-01", 'P <b> & "q"', f"t{i}, a\nline", "whole body", "short", ["a", "b,c"], "u", None, active)
    names = "article_id string, source string, date string, publisher string, title string, body_internal string, body_excerpt string, keywords array<string>, url string, cleaned_at string, is_active boolean"
    return spark.createDataFrame([row(2), row(1), row(3, False)], names)


def written(folder):
    (file,) = folder.glob("*.csv")
    raw = file.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    return list(csv.DictReader(raw.decode("utf-8-sig").splitlines(keepends=True)))


def test_csv_exports(spark, tmp_path):
    exports.export_articles_csv(articles(spark), str(tmp_path / "a"))
    rows = written(tmp_path / "a")
    assert list(rows[0]) == list(store.ARTICLE_COLUMNS) and [r["article_id"] for r in rows] == ["1", "2"]
    assert rows[0]["title"] == "t1, a\nline" and rows[0]["keywords"] == "a,b,c" and rows[0]["publisher"] == 'P <b> & "q"'
    calls = [("j", "1", False, None, None, None, "2024-01-01"), ("j", "1", True, "x", 0.5, "r", "2024-01-02"), ("j", "2", False, None, None, None, "2024-01-01"), ("j", "3", True, "y", 0.5, "r", "2024-01-01"), ("k", "2", True, "y", 0.5, "r", "2024-01-01")]
    results = spark.createDataFrame(calls, "job_id string, article_id string, success boolean, label string, confidence double, rationale string, called_at string")
    exports.export_results_csv(results, articles(spark), "j", str(tmp_path / "r"))
    rows = written(tmp_path / "r")
    assert list(rows[0]) == list(store.RESULT_COLUMNS) and [(r["article_id"], r["label"], r["called_at"]) for r in rows] == [("1", "x", "2024-01-02")]


def test_report_and_chart(spark):
    every = articles(spark)
    months = analyze.period_counts(every, F.substring("date", 1, 7))
    many = spark.range(45).select(F.concat(F.lit("k"), "id").alias("keyword"), F.lit(12345).alias("n"))
    text = exports.methodology_html("A <title>", analyze.descriptive(every), analyze.group_counts(every, "publisher"), months.orderBy(F.desc("period")), many, spark.createDataFrame([(0.123456, None)], "kappa double, x string"))
    assert "<h1>A &lt;title&gt;</h1>" in text and "P &lt;b&gt; &amp; &quot;q&quot;" in text and "whole body" not in text
    assert text.count("12,345") == 30 and "0.1235" in text and text.index(">2024-01<") < text.index(">2024-02<") < text.index(">2024-03<")
    assert exports.chart_spec("monthly", months) == {"type": "bar", "period_type": "monthly", "x": ["2024-01", "2024-02", "2024-03"], "y": [1, 1, 1]}
    assert exports.chart_spec("monthly", months.limit(0))["x"] == []


def test_stream_takes_each_file_once(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame(pairs, "article_id string, title string")
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")

    def take():
        ingest_stream(spark, folder, rows(("x", "x")).schema, target, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(target).collect()))

    rows(("1", "a"), ("2", "b"), ("2", "b")).write.parquet(folder)
    assert take() == [("1", "a"), ("2", "b")]
    assert take() == [("1", "a"), ("2", "b")]
    rows(("1", "changed"), ("3", "c")).write.mode("append").parquet(folder)
    assert take() == [("1", "a"), ("2", "b"), ("3", "c")]


def test_stream_that_is_stopped_goes_on(spark, tmp_path):
    """First by file time, then file and row, also within a micro-batch; a query that stops in the middle gives the rows of one run."""
    import os
    import threading

    schema = "article_id string, n long, at timestamp, words array<string>, x double"
    made = lambda *rows: spark.createDataFrame([(k, n, datetime(2024, 1, 1, 2, 3, 4, n), [k, None] if k else None, n / 7) for k, n in rows], schema)
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [(("a", 5), ("b", 1), (None, 2**53 + 1 - 2**53)), (("a", 1), ("c", 7), ("c", 8), (None, 3)), (("b", 9), ("d", 4)), (("e", 6), ("d", 5))]
    for i, rows in enumerate(batches):
        made(*rows).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (file,) = (tmp_path / f"part{i}").glob("*.parquet")
        file.rename(folder / f"{9 - i}.parquet")
        os.utime(folder / f"{9 - i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    expected = sorted(map(repr, map(tuple, made(("a", 5), ("b", 1), (None, 1), ("c", 7), ("d", 4), ("e", 6)).collect())))
    found = lambda target: sorted(map(repr, map(tuple, spark.read.parquet(target).collect())))
    for each in (None, 1):
        heard, target = [], str(tmp_path / f"out{each}")
        query = ingest_stream(spark, str(folder), made().schema, target, str(tmp_path / f"checkpoint{each}"), report=heard.append, files_each=each)
        query.awaitTermination()
        assert found(target) == expected
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert sum(x.rows for x in heard) == 11 and sum(x.new_keys for x in heard) == 6 and len({x.batch for x in heard if x.rows}) == (4 if each else 1)
    target, stopped = str(tmp_path / "stopped"), threading.Event()
    query = ingest_stream(spark, str(folder), made().schema, target, str(tmp_path / "checkpoint"), report=lambda x: stopped.set(), files_each=1)
    stopped.wait(60)
    query.stop()
    ingest_stream(spark, str(folder), made().schema, target, str(tmp_path / "checkpoint"), files_each=1).awaitTermination()
    assert found(target) == expected


def test_window_of_calls_over_stretches(spark):
    rows = [(i, i % 2, second, i + 1) for i, second in enumerate([0, 0, 5, 59, 60, 60, 61, 119, 120, 500, -1])]
    calls = spark.createDataFrame(rows, "call_id int, slot int, ts_sec long, tokens long")
    found = {r["call_id"]: (r["in_window"], r["tokens_in_window"]) for r in analyze.quota_use(calls).collect()}
    within = {c: [x for x in rows if x[1] == s and at - 60 < x[2] <= at] for c, s, at, _ in rows}
    assert found == {c: (len(x), sum(r[3] for r in x)) for c, x in within.items()}


def many_workbooks(folder, active="rId7"):
    """A workbook whose sheets were moved: the second tab, which is shown, lies in sheet1.xml."""
    rows = [[("A1", "inlineStr", "일자"), ("B1", "inlineStr", "제목")], [("A2", "inlineStr", "20240105"), ("B2", "inlineStr", "shown")]]
    other = [[("A1", "inlineStr", "제목")], [("A2", "inlineStr", "hidden")]]
    workbook(folder / "moved.xlsx", {1: other, 2: rows} if active == "rId7" else {1: rows, 2: other})
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(folder / "moved.xlsx", "a") as out:
        out.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{links}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="rId3"/><sheet name="b" sheetId="2" r:id="{active}"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId3" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>')


def test_the_active_sheet_is_read(spark, tmp_path):
    many_workbooks(tmp_path)
    assert [(r["title"], r["date"], r["date_raw"]) for r in files.read_archive(spark, str(tmp_path)).collect()] == [("shown", "2024-01-05", "20240105")]
    assert [r["title"] for r in files.read_xlsx(spark, str(tmp_path)).collect()] == ["shown"]


def test_archive_is_a_data_source(spark, tmp_path, capsys):
    """Written by tasks, read again by partitions; dates are compared by the reader, other filters by Spark."""
    archive.register(spark)
    rows = [(f"n{i}", f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}" if i % 9 else "", f"title <{i}> & \"q\"\n line", f"본문 {i}\x0b" * (i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "news_id string, date string, title string, body string").repartition(3)
    folder = f"file://{tmp_path}/books"
    df.write.format("news_archive").mode("overwrite").save(folder)
    assert len([p for p in (tmp_path / "books").iterdir() if p.suffix == ".xlsx"]) == 3 and not [p for p in (tmp_path / "books").iterdir() if p.suffix != ".xlsx"]
    read = spark.read.format("news_archive").load(folder)
    found = {r["news_id"]: (r["date"], r["title"], r["body"]) for r in read.collect()}
    assert found == {i: (d, t, b.replace("\x0b", " ").strip()) for i, d, t, b in rows}
    late = read.filter("date >= '2024-07-01' and date < '2024-09-01' and title like '%1%'")
    late.explain("formatted")
    assert "PushedFilters: [GreaterThanOrEqual(date,2024-07-01), LessThan(date,2024-09-01)]" in capsys.readouterr().out
    assert {r["news_id"] for r in late.collect()} == {i for i, d, t, _ in rows if "2024-07-01" <= d < "2024-09-01" and "1" in t}
    ranged = files.read_archive(spark, folder, date_from="2024-07-01", date_to="2024-08-31")
    assert ranged.count() == files.in_range(files.read_xlsx(spark, folder), "2024-07-01", "2024-08-31").count() > 0
    df.limit(5).write.format("news_archive").mode("overwrite").save(folder)
    assert spark.read.format("news_archive").load(folder).count() == 5


def test_a_sheet_of_many_rows_takes_little_memory(tmp_path):
    """Shared strings in a file, rows one at a time: memory stays far below the sheet."""
    import tracemalloc

    with zipfile.ZipFile(tmp_path / "long.xlsx", "w", zipfile.ZIP_DEFLATED) as out:
        with out.open("xl/sharedStrings.xml", "w") as part:
            part.write(f"<sst {_MAIN}><si><t>제목</t></si>".encode() + b"".join(f"<si><t>{'text ' * 20}{i}</t></si>".encode() for i in range(60_000)) + b"</sst>")
        with out.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<worksheet {_MAIN}><sheetData><row><c t="s"><v>0</v></c></row>'.encode())
            part.write(b"".join(f'<row><c t="s"><v>{i + 1}</v></c></row>'.encode() for i in range(60_000)) + b"</sheetData></worksheet>")
    tracemalloc.start()
    with open(tmp_path / "long.xlsx", "rb") as file:
        n = sum(1 for _ in archive.spreadsheet_rows(file))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 4_000_000  # the strings alone are 6.4 MB


def csv_text(rng, rows, end):
    words = ["", "plain", 'say "so"', "a,b", "line\nbreak", "carriage\r\nreturn", '"', '""', "\n\n", ' "odd', "x" * 30, 'a"b"c', "é漢"]
    out = ["id,title,body,body"]
    for i in range(rows):
        cells = [str(i), *(rng.choice(words) for _ in range(rng.choice([0, 2, 3, 3, 3, 5])))]
        quoted = [c if rng.random() < 0.5 and not set(c) & set(',"\r\n') or c in (' "odd', 'a"b"c') else '"' + c.replace('"', '""') + '"' + ("tail" if rng.random() < 0.05 else "") for c in cells]
        out.append(",".join(quoted) if rng.random() > 0.05 else "")
    return end.join(out)


def test_csv_of_any_ranges(spark, tmp_path):
    """Cut at any byte, a file has the rows of Python's reader; line ends, quotes and commas in fields, ragged rows, blank lines, no last line end."""
    import io
    import random

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rng = random.Random(2)
    try:
        for trial, (size, end) in enumerate([(37, "\n"), (150, "\r\n"), (1000, "\n"), (64, "\r")]):
            text = csv_text(rng, 60, end) + (end if trial % 2 else "") + ('\n9,"never closed\nat all' if trial == 2 else "")
            path = tmp_path / f"t{trial}.csv"
            path.write_bytes((("﻿" if trial == 1 else "") + text).encode())
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = csv_ranges.read_ranges(spark, [str(path)], ("id", "title", "body", "body"))
            assert found.columns == ["id", "title", "body"]
            if trial != 2:
                assert found.rdd.getNumPartitions() >= min(len(text.encode()) // size, 50)
            expected = [(r["id"], r["title"], r["body"]) for r in csv.DictReader(io.StringIO(text, newline=""))]
            assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_state_of_lines():
    inside = csv_ranges.ends_inside
    assert not inside("a,b", False) and inside('a,"b', False) and not inside('a,"b"', False) and inside('a,"b""', False)
    assert not inside('a"b,c', False) and not inside('"a"b"c,d', False) and inside('"a"b,"c', False)
    assert inside("a,b", True) and not inside('a",b', True) and inside('a","b', True) and inside('a""', True) and inside('""', True) and not inside('"', True)


def test_package_of_any_store(spark, tmp_path):
    """Written and read through a file system that only Spark knows; members are stored, checked by executors; secrets stay out."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.packages.link./p", f"file://{tmp_path}")
    root = "viewfs://packages/p"
    (tmp_path / "raw" / "sub").mkdir(parents=True)
    (tmp_path / "raw" / ".streamlit").mkdir()
    for name in ("a.csv", "sub/b.csv", ".env", "sub/secrets.toml", ".streamlit/config"):
        (tmp_path / "raw" / name).write_text(name)
    big = spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) AS text", "'p' AS project_id").repartition(3)
    project = {"name": 'a "b" \\ \t\x07é', "schema_version": "1.0"}
    exports.write_package({"big": big, "small": spark.range(0).selectExpr("id")}, project, f"{root}/p.zip", f"{root}/work", f"{root}/raw")
    with zipfile.ZipFile(tmp_path / "p.zip") as package:
        assert package.testzip() is None and {x.compress_type for x in package.infolist()} == {zipfile.ZIP_STORED}
        names = package.namelist()
        assert {n for n in names if n.startswith("data/raw/")} == {"data/raw/a.csv", "data/raw/sub/b.csv"} and sum(n.startswith("data/big/") for n in names) == 3
    tables, manifest, warnings = exports.read_package(spark, f"{root}/p.zip", f"{root}/out", "q")
    assert manifest["project"] == project and warnings == [] and set(tables) == {"big", "small"}
    assert tables["big"].exceptAll(big.withColumn("project_id", F.lit("q"))).isEmpty() and tables["big"].count() == 20_000
    # Deflated by other tools, with a file missing and one that was changed.
    with zipfile.ZipFile(tmp_path / "p.zip") as package, zipfile.ZipFile(tmp_path / "again.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for name in names:
            if name != "data/raw/a.csv":
                out.writestr(name, b"other" if name == "data/raw/sub/b.csv" else package.read(name))
    tables, _, warnings = exports.read_package(spark, f"{root}/again.zip", f"{root}/out2")
    assert warnings == ["missing: data/raw/a.csv", "mismatch: data/raw/sub/b.csv"] and tables["big"].count() == 20_000
    for bad, error in (({"manifest.toml": "[project]"}, "not a package"), ({"manifest.toml": "", "data/x/p.parquet": "", "../../x": ""}, "unsafe member"), ({"manifest.toml": "", "data/x/p.parquet": "", "/etc/x": ""}, "unsafe member")):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as out:
            for name, text in bad.items():
                out.writestr(name, text)
        with pytest.raises(ValueError, match=error):
            exports.read_package(spark, f"{root}/bad.zip", f"{root}/never")
    assert not (tmp_path / "never").exists()


def test_members_beyond_four_gigabytes(spark, tmp_path, monkeypatch):
    """The directory of large members, far offsets and very many members; the limits are lowered instead of writing so much."""
    (tmp_path / "x.bin").write_bytes(b"x" * 500)
    monkeypatch.setattr(packages, "_MOST_MEMBERS", 2)
    out = packages.StoredZip(spark, str(tmp_path / "many.zip"))
    for i in range(4):
        out.add_file(f"m{i}", str(tmp_path / "x.bin"), 500, zlib.crc32(b"x" * 500))
    out.close()
    with zipfile.ZipFile(tmp_path / "many.zip") as found:
        assert found.namelist() == ["m0", "m1", "m2", "m3"] and found.testzip() is None


def test_secret_files():
    assert [packages.secret(p) for p in ("a.csv", ".env", "x/.env", "secrets.toml", "a/.streamlit/b", "env", "x.env")] == [False, True, True, True, True, False, False]


def test_report_names_sources_publishers_and_job(spark):
    every = articles(spark)
    months, none = analyze.period_counts(every, F.col("date")), spark.createDataFrame([], "keyword string, n long")
    text = exports.methodology_html("T", analyze.descriptive(every), analyze.group_counts(every, "publisher"), months, none, sources=analyze.group_counts(every, "source"), job_id="j<1>")
    assert "<td>sources</td><td>csv</td>" in text and "<td>publishers</td><td>1</td>" in text and "<td>job</td><td>j&lt;1&gt;</td>" in text and "Keywords" not in text
