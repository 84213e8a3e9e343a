"""Behaviour of expressions and operators on small fixtures."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as t
from corpuslens.operators import analyze, clean, stats, store
from corpuslens.operators.classify import Limiter, Slots, classify
from corpuslens.sources import exports, files


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).head()["y"]


def test_text(spark):
    assert value(spark, t.clean_body, " <p>a\n</p> 　b ") == "a b"
    assert value(spark, t.strip, "　\x1c x\t") == "x"
    assert [len(value(spark, t.excerpt, "x" * n)) for n in (199, 200, 201)] == [199, 200, 200]
    assert value(spark, t.normalize_date, "2022/10/30") == value(spark, t.normalize_date, "20221030") == "2022-10-30"
    assert value(spark, t.week_of, "2022-02-30") == "2022-W00" and value(spark, t.week_of, "2024-01-08") == "2024-W02"
    assert value(spark, t.trigrams, "") == [] and value(spark, t.trigrams, "Ab") == ["ab"]
    assert value(spark, t.keywords, "a, b,,") == ["a", "b"]
    assert value(spark, t.strip_b_tags, "<B>x</b>") == "x"


def test_replies(spark):
    assert value(spark, t.parse_reply, 'so {"category": "x", "confidence": "0.5"}') == ("x", 0.5, None)
    assert value(spark, t.parse_reply, "{'label': 'x'}")["label"] == "{'label': 'x'}"
    assert value(spark, t.parse_reply, " \n yes\nno")["label"] == "yes" and value(spark, t.parse_reply, " ")["label"] is None


def test_greedy_is_not_transitive(spark):
    rows = [(1, "d", 1, "abcdefghij"), (2, "d", 2, "abcdefghijkl"), (3, "d", 3, "bcdefghijklmn"), (4, "e", 4, "abcdefghij"), (5, "d", 5, "")]
    df = spark.createDataFrame(rows, "id int, block string, seq int, title string")
    for way in (clean.fuzzy_kept, clean.fuzzy_kept_fold):
        assert sorted(r["id"] for r in way(df, 0.7).collect()) == [1, 3, 4, 5]


def test_fuzzy_titles_of_one_template(spark):
    """Dense groups take the way by leaders; a fold over the block gives the same rows."""
    line = "breaking news of the long day from the northern valley station {}"
    rows = [(i, "d", i, line.format(i * 7919 % 1000) if i % 3 else f"{i * 31 % 17} short {i * 57 % 23} titles {i}") for i in range(240)]
    rows += [(900, "d", 900, None), (901, "d", 901, " \t"), (902, "d", 902, "x\U0001f600"), (903, "e", 903, line.format(7)), (904, "e", 904, line.format(7))]
    df = spark.createDataFrame(rows, "id int, block string, seq int, title string")
    found = [sorted(r["id"] for r in way(df).collect()) for way in (clean.fuzzy_kept, clean.fuzzy_kept_fold)]
    assert found[0] == found[1] and {900, 901, 902, 903} <= set(found[0]) and 904 not in found[0]
    assert clean.fuzzy_kept(df.limit(0)).count() == 0


def test_banded_hashes_find_nearly_all_pairs(spark):
    """Of the exact pairs at 0.85 a share of 0.95 and more; no pair that isn't one; the option decides nearly alike."""
    import random

    rng, rows = random.Random(9), []
    for i in range(150):
        title = "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(20, 70)))
        for j in range(3):
            at = rng.randrange(len(title))
            rows.append((3 * i + j, "ab"[i % 2], 3 * i + j, title[:at] + rng.choice(["", "x", "yz"]) + title[at + rng.randrange(2) :]))
    df = spark.createDataFrame(rows, "id int, block string, seq int, title string")
    sets = df.select("id", "block", "seq", t.trigram_codes(F.col("title")).alias("g"))
    pairs = lambda **x: {tuple(r) for r in clean.similar_titles(sets, **x).collect()}
    exact, found = pairs(), pairs(bands=(8, 5))
    assert len(exact) > 100 and found <= exact and len(found) >= 0.95 * len(exact)
    kept = [{r["id"] for r in clean.fuzzy_kept(df, bands=b).collect()} for b in (None, (8, 5))]
    assert kept[0] == {r["id"] for r in clean.fuzzy_kept_fold(df).collect()} and len(kept[0] ^ kept[1]) <= 0.05 * len(kept[0])


def test_trigram_codes(spark):
    for title in ("", "a", "Ab", "a\U0001f600b c", "banana banana", "İx  Y"):
        whole = value(spark, t.trigrams, title)
        codes = value(spark, t.trigram_codes, title)
        assert codes == sorted(sum(ord(c) << 42 - 21 * i for i, c in enumerate(gram.ljust(3, chr(0)))) + sum((1 << 21) - 1 << 42 - 21 * i for i in range(len(gram), 3)) for gram in whole)


def test_greedy_ways_agree_on_copies(spark):
    """Copies of a title, titles close to each other and titles without a letter, in two blocks."""
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(i, "ab"[i % 2], 100 - i // 3, "" if i % 13 == 0 else base[: 43 - i % 7] + "!" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, block string, seq int, title string")
    found = [sorted(r["id"] for r in way(df, 0.85).collect()) for way in (clean.fuzzy_kept, clean.fuzzy_kept_fold)]
    assert found[0] == found[1] and len(found[0]) < 20


def test_filters(spark):
    rows = [(" ", "x" * 30), ("t", "short"), ("[ad] t", "x" * 30), ("t", "x" * 30)]
    df = spark.createDataFrame(rows, "t string, b string").select(clean.filter_reason(F.col("t"), F.col("b")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["no_title", "short", "advert", None]


def test_agreement(spark):
    found = analyze.agreement(spark.createDataFrame(list(zip("AABBA", "ABBBA")), "a string, b string")).head()
    assert found["accuracy"] == 0.8 and abs(found["kappa"] - 8 / 13) < 1e-12
    assert analyze.agreement(spark.createDataFrame([], "a string, b string")).head()["kappa"] == 0.0
    assert analyze.agreement(spark.createDataFrame([("A", "A")], "a string, b string")).head()["kappa"] == 1.0


def test_label_periods_have_zeros(spark):
    articles = spark.createDataFrame([("1", "2024-01-01"), ("2", "2024-02-01"), ("3", "2024-03-01")], "article_id string, date string")
    labelled = spark.createDataFrame([("1", "x"), ("2", "")], "article_id string, label string").join(articles, "article_id")
    month = F.substring("date", 1, 7)
    found = [tuple(r) for r in analyze.label_periods(labelled, month, articles).collect()]
    assert found == [(f"2024-0{i}", label, int((i, label) in ((2, "unknown"), (1, "x")))) for i in (1, 2, 3) for label in ("unknown", "x")]
    assert analyze.label_periods(labelled, month).count() == 4 and analyze.label_periods(labelled.limit(0), month, articles).count() == 0


def by_pseudo_inverse(x, y):
    """Coefficients, p-values by numeric integration, R squared and rank."""
    x, y = np.column_stack([np.ones(len(y)), x]).astype(float), np.asarray(y, float)
    inverse, rank = np.linalg.pinv(x), np.linalg.matrix_rank(x)
    beta, freedom = inverse @ y, len(y) - rank
    left = ((y - x @ beta) ** 2).sum()
    t_ = beta / np.sqrt(np.diag(inverse @ inverse.T) * left / freedom)
    grid = (np.arange(400_000) + 0.5) / 400_000  # of s in t = |t| + s / (1 - s)
    density = lambda t: np.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi) * (1 + t * t / freedom) ** (-(freedom + 1) / 2)
    p = [2 * (density(abs(v) + grid / (1 - grid)) / (1 - grid) ** 2).mean() for v in t_]
    return beta, p, 1 - left / ((y - y.mean()) ** 2).sum(), rank


def test_difference_in_differences(spark):
    rows = [(1, 0, 0), (2, 0, 0), (2, 0, 1), (3, 0, 1), (2, 1, 0), (3, 1, 0), (5, 1, 1), (7, 1, 1), (None, 1, 1)]
    for data in (rows, [(1, 1, 1), (2, 1, 1), (3, 0, 0), (2, 0, 0)], [(1, 0.5, 2), (4, 1.5, -1), (2, 2.5, 0.5), (3, 0, 1), (9, -3, 2), (1, 1, 1)]):
        found = stats.run_did(spark.createDataFrame([tuple(map(lambda v: None if v is None else float(v), r)) for r in data], "y double, t double, p double"), "y", "t", "p")
        y, t_, p_ = (np.array(c, float) for c in zip(*[r for r in data if r[0] is not None]))
        beta, p, r_squared, rank = by_pseudo_inverse(np.column_stack([t_, p_, t_ * p_]), y)
        s = found.summary
        assert (s["n"], s["rank"]) == (len(y), rank)
        assert np.allclose([s["coefficient"], s["p_value"], s["r_squared"]], [beta[3], p[3], r_squared], atol=1e-6)
        assert found.significant == (p[3] < 0.05)
    exact = stats.run_did(spark.createDataFrame([(1.0, 0, 0), (2.0, 1, 1)], "y double, t int, p int"), "y", "t", "p")
    assert exact.summary["rank"] == 2 and exact.summary["p_value"] is None and not exact.significant
    with pytest.raises(ValueError, match="no complete rows"):
        stats.run_did(spark.createDataFrame([], "y double, t int, p int"), "y", "t", "p")


def test_interrupted_time_series(spark):
    """Numbered by time, ties by outcome, over many ranges; a series without an intervention is collinear."""
    rng = np.random.default_rng(1)
    at = rng.permutation(np.repeat(np.arange(150), 2))
    y = 3 + 0.2 * at + (at >= 90) * (4 - 0.1 * at) + rng.normal(size=300)
    df = spark.createDataFrame([(float(v), int(a), int(a >= 90)) for v, a in zip(y, at)], "y double, at int, x int").repartition(5)
    order = np.lexsort((y, at))
    i, x = np.arange(300), at[order] >= 90
    beta, p, r_squared, _ = by_pseudo_inverse(np.column_stack([i, x, i * x]), y[order])
    s = stats.run_its(df, "y", "at", "x").summary
    assert np.allclose([s[k] for k in ("level_change", "slope_change", "level_p", "slope_p", "r_squared")], [*beta[2:], *p[2:], r_squared], atol=1e-6)
    flat = stats.run_its(df.withColumn("x", F.lit(0)), "y", "at", "x").summary
    assert flat["rank"] == 2 and abs(flat["level_change"]) < 1e-9


def test_poisson_by_scoring(spark):
    """The gradient vanishes, errors are those of the information matrix, AIC by log-factorials; separation is named."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 2, 500)])
    y = rng.poisson(np.exp(0.5 + 0.3 * x[:, 0] - 0.7 * x[:, 1]))
    s = stats.run_ppml(spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x)], "y int, a double, b double"), "y", ["a", "b"]).summary
    beta, full = np.array([s["intercept"], s["a"], s["b"]]), np.column_stack([np.ones(500), x])
    mu = np.exp(full @ beta)
    assert np.abs(full.T @ (y - mu)).max() < 1e-6 and not s["separated"]
    z = beta / np.sqrt(np.diag(np.linalg.inv(full.T @ (full * mu[:, None]))))
    assert np.allclose([s["p_intercept"], s["p_a"], s["p_b"]], [math.erfc(abs(v) / math.sqrt(2)) for v in z], atol=1e-9)
    assert abs(s["aic"] + 2 * sum(v * math.log(m) - m - math.lgamma(v + 1) for v, m in zip(y.tolist(), mu.tolist())) - 6) < 1e-6
    apart = spark.createDataFrame([(0, 1), (0, 1), (3, 0), (4, 0), (2, 0)], "y int, a int")
    found = stats.run_ppml(apart, "y", ["a"])
    assert found.summary["separated"] and found.summary["p_a"] is None and not found.significant and abs(found.summary["intercept"] - math.log(3)) < 1e-6
    with pytest.raises(ValueError, match="nowhere above 0"):
        stats.run_ppml(apart.filter("y = 0"), "y", ["a"])


def test_incomplete_beta():
    """Known values: the uniform and the arc sine distribution, and t with one and two degrees of freedom."""
    for x in (0.0, 0.001, 0.3, 0.5, 0.999, 1.0):
        assert abs(stats.beta_share(x, 1, 1) - x) < 1e-12 and abs(stats.beta_share(x, 0.5, 0.5) - 2 / math.pi * math.asin(math.sqrt(x))) < 1e-12
    for t_ in (0.0, 0.5, 3.0, 40.0):
        assert abs(stats.t_two_sided(t_, 1) - (1 - 2 / math.pi * math.atan(t_))) < 1e-12
        assert abs(stats.t_two_sided(t_, 2) - (1 - t_ / math.sqrt(2 + t_ * t_))) < 1e-12
        assert abs(stats.t_two_sided(t_, 10**7) - math.erfc(t_ / math.sqrt(2))) < 1e-6


def test_kept_titles_batch_after_batch(spark, tmp_path):
    """Batches in order of seq keep what one run over all rows keeps; a batch that is added again after a failure is decided alike."""
    line = "breaking news of the long day from the northern valley station {}"
    rows = [(i, ("a", "b", None)[i % 3], i, line.format(i * 7919 % 50) if i % 4 else f"{i * 31 % 17} short {i * 57 % 23} titles") for i in range(240)]
    rows += [(900, "a", 900, None), (901, "a", 901, " "), (902, "c", 902, line.format(7)), (903, "c", 903, line.format(7) + "!")]
    df = spark.createDataFrame(rows, "id int, block string, seq int, title string")
    expected = {r["id"] for r in clean.fuzzy_kept(df).collect()}
    titles, found = clean.KeptTitles(spark, str(tmp_path)), []
    for low, high in ((0, 100), (100, 101), (101, 230), (230, 1000)):
        batch, n = df.filter((F.col("seq") >= low) & (F.col("seq") < high)), titles.generations()
        kept = sorted(r["id"] for r in titles.add(batch).collect())
        if low == 100:
            (tmp_path / "sets" / f"generation={n}" / "_SUCCESS").unlink()  # as if it had failed
            assert titles.generations() == n and kept == sorted(r["id"] for r in titles.add(batch).collect())
        assert titles.generations() == n + 1
        found += kept
    assert sorted(found) == sorted(expected) and {900, 901, 902} <= expected and 903 not in expected


def test_analysis_from_one_scan(spark, tmp_path):
    """Each part equals its own query; articles without date, publisher, text or result; one scan of the articles in the plan."""
    rows = [(str(i), (None, "", "P", "Q")[i % 4], ("s", None)[i % 2], (None, f"2024-0{i % 3 + 1}-1{i % 9}")[i % 5 > 0], "x" * (i % 7), i % 6 > 0) for i in range(60)]
    rows += [("only", "R", "s", "2025-01-01", "y", False)]
    spark.createDataFrame(rows, "article_id string, publisher string, source string, date string, body_internal string, is_active boolean").write.parquet(str(tmp_path / "a"))
    articles = spark.read.parquet(str(tmp_path / "a"))
    results = spark.createDataFrame([(str(i), ("x", "", None, "y")[i % 4]) for i in range(0, 60, 2)] + [("gone", "z")], "article_id string, label string")
    sets = analyze.analysis_sets(articles, results)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    live, labelled, month = articles.filter("is_active"), analyze.labelled(results, articles), t.month_of(F.col("date"))
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))
    for part in ("publisher", "source"):
        assert same(analyze.of_part(sets, part, "value"), analyze.group_counts(live, part))
    assert same(analyze.of_part(sets, "month", "period"), analyze.period_counts(live, month))
    assert same(analyze.of_part(sets, "week", "period"), analyze.period_counts(live, t.week_of(F.col("date"))))
    assert same(analyze.label_periods_of(sets), analyze.label_periods(labelled, month, live))
    for column in ("publisher", "month"):
        assert same(analyze.label_tab_of(sets, column), analyze.label_tab(labelled, column))
    for some in (articles, articles.limit(0), articles.filter("body_internal = ''"), articles.filter("article_id = '3'")):
        assert same(analyze.descriptive_of(analyze.analysis_sets(some)), analyze.descriptive(some))


def test_store(spark):
    old = spark.createDataFrame([("a", 1, 1)], "k string, made int, at int")
    new = spark.createDataFrame([("a", 5, 5), ("b", 6, 6), ("b", 7, 7)], "k string, made int, at int")
    assert sorted(map(tuple, store.first_write(new, old, ["k"], ["at"]).collect())) == [("b", 6, 6)]
    assert sorted(map(tuple, store.upsert(old, new, "k", "at", "made").collect())) == [("a", 1, 5), ("b", 6, 7)]


def test_quota_and_resume(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    limiter = Limiter(rpm=2, tpm=100, rpd=3)
    limiter.record(at, 2, 10)
    assert limiter.room(at, 10) == 0 and limiter.room(at + timedelta(seconds=61), 10) == 1
    schema = "article_id string, date string, title string, body_internal string"
    articles = spark.createDataFrame([(str(i), "d", "t", "b") for i in range(5)], schema)
    run = lambda slots: classify(spark, articles, str(tmp_path / "r"), "j", lambda p: ('{"label": "x"}', 1, 1), slots, "p", lambda: at, sleep=waited.append)
    waited = []
    assert run(Slots([Limiter(rpm=2), Limiter(rpm=1)])) == "cancelled" and waited == [60]
    assert run(Slots([Limiter()])) == "success"
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("article_id").count().filter("count = 1").count() == 5


def test_csv_and_package(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes('﻿title,date,body\n"a ""q""\nb",20221030,x\n,2022,y\n'.encode())
    (tmp_path / "in" / "b.csv").write_text("date,title,url\n,t2,u\n")
    (tmp_path / "in" / "c.csv").write_text("date,title,url\n20240102,t3,u\n")
    (tmp_path / "in" / "d.csv").write_bytes("title,date\n제목,2024-01-03\n".encode("utf-16"))
    assert files.format_of(b"a," * (1 << 15)) == ("UTF-8", None) and files.format_of(b"") == ("UTF-8", ())
    found = files.read_csv(spark, str(tmp_path / "in"))
    more = {("t3", "2024-01-02"), ("제목", "2024-01-03")}
    assert more < {(r["title"], r["date"]) for r in found.collect()}
    found = found.filter("date < '2024'")
    assert sorted((r["title"], r["date"]) for r in found.collect()) == [('a "q"\nb', "2022-10-30"), ("t2", "")]
    assert files.in_range(found, "2022-11-01").count() == 1
    exports.write_package({"articles": found.drop("keywords")}, {"name": 'a "b"'}, str(tmp_path / "p.zip"), str(tmp_path / "w"))
    tables, manifest, warnings = exports.read_package(spark, str(tmp_path / "p.zip"), str(tmp_path / "out"))
    assert tables["articles"].count() == 2 and manifest["project"]["name"] == 'a "b"' and not warnings


def test_null_dates_and_blocks_count(spark):
    """An article without a date has a period, and a column, of its own; titles without a block are one block."""
    articles = spark.createDataFrame([("1", None, "P", True), ("2", "2024-01-02", "", True), ("3", "2024-01-03", "P", False)], "article_id string, date string, publisher string, is_active boolean")
    results = spark.createDataFrame([("1", "x"), ("2", None), ("3", "x")], "article_id string, label string")
    labelled = analyze.labelled(results, articles)
    found = {tuple(r) for r in analyze.label_periods(labelled, t.month_of(F.col("date"))).collect()}
    assert found == {(None, "x", 1), (None, "unknown", 0), ("2024-01", "x", 0), ("2024-01", "unknown", 1)}
    assert {tuple(r) for r in analyze.label_tab(labelled, "month").collect()} == {("x", "unknown", 1), ("unknown", "unknown", 0), ("x", "2024-01", 0), ("unknown", "2024-01", 1)}
    assert {tuple(r) for r in analyze.label_tab(labelled, "publisher").collect()} == {("x", "P", 1), ("unknown", "P", 0), ("x", "unknown", 0), ("unknown", "unknown", 1)}
    for wrong in (lambda: analyze.label_tab(labelled, "title"), lambda: analyze.group_counts(articles, "title")):
        with pytest.raises(ValueError, match="unsupported column: title"):
            wrong()
    rows = [(1, None, 1, "the same title here"), (2, None, 2, "the same title here!"), (3, "", 3, "the same title here"), (4, "", 4, "the same title here"), (5, None, 5, None)]
    df = spark.createDataFrame(rows, "id int, block string, seq int, title string")
    for way in (clean.fuzzy_kept, clean.fuzzy_kept_fold):
        assert sorted(r["id"] for r in way(df, 0.85).collect()) == [1, 3, 5]


def test_labels_beyond_the_bound_get_no_zeros(spark, monkeypatch):
    monkeypatch.setattr(analyze, "MOST_DENSE", 3)
    df = spark.createDataFrame([(str(i), f"l{i}", f"2024-0{i % 2 + 1}-01") for i in range(4)], "article_id string, label string, date string")
    assert analyze.label_periods(df, t.month_of(F.col("date"))).count() == 4
    assert analyze.label_periods(df.limit(3), t.month_of(F.col("date"))).count() == 6


def test_typed_replies(spark):
    """Values that count as empty give way to the next name; other types are put as text; a list is no confidence."""
    reply = lambda x: tuple(value(spark, t.parse_reply, x))
    assert reply('{"label": 0, "category": "c"}') == ("c", None, None)
    assert reply('{"label": [], "classification": {}, "category": false}') == (None, None, None)
    assert reply('{"label": true, "confidence": true}') == ("True", 1.0, None)
    assert reply('{"label": 1.5, "confidence": " 0.5 ", "reason": 7}') == ("1.5", 0.5, "7")
    assert reply('{"label": 0.0, "classification": "", "category": "k"}')[0] == "k"
    assert reply('{"label": "x", "confidence": [1]}')[0] == '{"label": "x", "confidence": [1]}'
    assert reply('{"label": "x"} and {"label": "y"}')[0] == '{"label": "x"} and {"label": "y"}'
    assert reply('{"label": "x", "confidence": false}') == ("x", 0.0, None)


def test_progress_of_one_job_over_many_tasks(spark):
    calls = spark.createDataFrame([("j", i, i % 7 != 0) for i in range(500)] + [("k", 1, True), (None, 4, False)], "job_id string, at int, success boolean").repartition(7)
    found = {(r["job_id"], r["at"]): (r["processed"], r["errors"], round(r["percent"], 6)) for r in analyze.progress(calls, "job_id", ["at"], 16).collect()}
    assert found == {("j", i): (i + 1, i // 7 + 1, round((i + 1) / 5, 6)) for i in range(500)} | {("k", 1): (1, 0, 100.0), (None, 4): (1, 1, 100.0)}
