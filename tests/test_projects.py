"""A project from ingest to package, and the settings and providers around it."""

import codecs
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpuslens.operators.classify import Limiter, Slots, classify, in_turn
from corpuslens.operators.projects import IngestParams, Job, Label, LabelSchema, Projects, Prompt, from_flat, to_flat
from corpuslens.sources import files, providers, settings

ROWS = """title,date,body,publisher,keywords,url
First title here,20240101,<p>A body that is long enough to stay</p>,P1,"a, b",u1
First title here!,20240101,Another body that is long enough,P2,a,u2
[AD] Buy,2024-01-02,A body that is long enough to stay,P1,c,u3
Short,2024-01-03,tiny,,c,u4
Last one,2024-02-01,A body that is long enough to stay too,P2,,u5
 ,2024-01-05,a row without a title counts as read,P2,,u6
"""


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("projects")
    (folder / "in.csv").write_text(ROWS)
    projects = Projects(spark, str(folder / "root"))
    assert len(projects.init()) == 7 and projects.init() == [] and projects.missing() == []
    projects.put_project("p", "A name")
    return projects, folder


def test_project_from_ingest_to_package(project):
    projects, folder = project
    made = projects.get("projects", "p")["created_at"]
    projects.put_project("p", "Renamed")
    assert projects.get("projects", "p")["created_at"] == made and projects.get("projects", "p")["name"] == "Renamed"
    assert projects.status("p")["step"] == 0
    ingest = lambda **x: projects.get("ingest_runs", projects.run_ingest(IngestParams("p", **x)))
    first = ingest(source="csv", input_path=str(folder / "in.csv"), date_to="2024-01-31")
    assert (first["status"], first["raw_count"], first["in_range_count"], first["inserted_count"]) == ("success", 6, 4, 4)
    again = ingest(source="csv", input_path=str(folder / "in.csv"))
    assert (again["in_range_count"], again["inserted_count"]) == (5, 1)
    assert ingest(source="news_search", input_path="x")["status"] == "failed" and ingest(source="nothing", input_path="x")["status"] == "failed"
    assert projects.status("p")["step"] == 1 and projects.articles("p").select("ingest_seq").distinct().count() == 5

    run = projects.get("clean_runs", projects.run_clean("p"))
    assert [run[c] for c in ("input_count", "output_count", "dedup_primary", "dedup_fallback", "dropped_short", "dropped_advert", "dropped_other")] == [5, 2, 0, 1, 1, 1, 0]
    assert projects.get("clean_runs", projects.run_clean("p"))["input_count"] == 2 and projects.articles("p").count() == 5
    kept = projects.articles("p", active_only=True)
    assert {r["body_internal"] for r in kept.collect()} == {"A body that is long enough to stay", "A body that is long enough to stay too"}

    with pytest.raises(ValueError, match="label_schemas"):
        projects.put_prompt("v", "s", "Classify.")
    schema = LabelSchema("s", "S", "single_label", [Label("yes", "fits", ["x"]), Label("no")])
    projects.put("label_schemas", **schema.row())
    assert LabelSchema.of(projects.get("label_schemas", "s")) == schema
    with pytest.raises(ValueError):
        LabelSchema("s", "S", "other", [])
    projects.put_prompt("v", "s", "Classify.")
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    answer = lambda prompt: ('{"label": "yes"}', 100, 20, None)
    job = projects.run_job("p", "s", "v", "gemini", "m-flash", answer, Slots([Limiter()]), now=lambda: at)
    row = projects.get("llm_jobs", job)
    assert (row["status"], row["n_processed"], row["n_errors"], row["prompt_tokens"], row["candidates_tokens"]) == ("success", 2, 0, 200, 40)
    assert abs(row["estimated_cost_usd"] - (200 * 0.15 + 40 * 0.6) / 1e6) < 1e-12
    assert projects.status("p") == {"ingest": "done", "clean": "done", "classify": "done", "analyse": "pending", "step": 3}

    found = projects.analyse("p", job, str(folder / "out"))
    assert [tuple(r) for r in found.monthly.collect()] == [("2024-01", 1), ("2024-02", 1)]
    assert [x.root for x in Projects.discover(projects.spark, str(folder))] == [projects.root]
    assert Projects.discover(projects.spark, str(folder / "none")) == []
    assert [tuple(r) for r in found.labels_monthly.collect()] == [("2024-01", "yes", 1), ("2024-02", "yes", 1)]
    assert found.descriptive.head()["total"] == 5 and found.by_publisher.agg(F.sum("n")).head()[0] == 2
    assert projects.status("p")["step"] == 4 and projects.counts("p") == {"total": 5, "active": 2, "classified": 2, "artifacts": 2}
    assert projects.activity("p").head()["kind"] == "classify" and projects.history("ingest_runs", "p").count() == 4
    assert "body_internal" not in projects.spark.read.parquet(str(folder / "out" / "articles.parquet")).columns

    projects.export_package("p", str(folder / "p.zip"), str(folder / "work"))
    other = Projects(projects.spark, str(folder / "other"))
    other.init()
    assert other.import_package(str(folder / "p.zip"), str(folder / "unpacked"), "q", "New") == {"project_id": "q", "articles": 5, "warnings": []}
    assert other.get("projects", "q")["name"] == "New" and other.articles("q").filter("project_id <> 'q'").isEmpty()


def test_rows_are_checked(project):
    projects, _ = project
    for row in ({"project_id": "x"}, {"project_id": "p", "colour": 1}):
        with pytest.raises(ValueError):
            projects.put("projects", **row)
    assert projects.get("projects", "x") is None


def test_job_that_fails_is_marked(project):
    projects, _ = project
    projects.put("label_schemas", **LabelSchema("s2", "S", "multi_label", []).row())
    projects.put_prompt("v2", "s2", "x")
    with pytest.raises(ZeroDivisionError):
        projects.run_job("p", "s2", "v2", "gemini", "m", lambda p: ("x", 1, 1), Slots([Limiter()]), job_id="bad", now=lambda: 1 / 0)
    assert projects.get("llm_jobs", "bad")["status"] == "failed"


def test_waiting():
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    limiter = Limiter(rpm=1, rpd=2)
    assert limiter.wait_seconds(at) == 0
    limiter.record(at, 1, 10)
    assert limiter.wait_seconds(at + timedelta(seconds=20)) == 40
    limiter.report_429("rpm", at)
    limiter.report_429("rpd", at)
    assert limiter.wait_seconds(at) == 8 * 3600


def test_slots_take_turns():
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    slots = Slots.of_keys({1: "key-of-one", 3: "key-of-three"}, lambda key: lambda prompt: (key, 1, 1), rpm=2, rpd=3)
    assert slots.admit(at, 3, 10) == [0, 1, 0] and slots.admit(at, 3, 10) == [1] and slots.all_exhausted(at)
    later = at + timedelta(seconds=61)
    slots.slots[0].enabled = False
    assert slots.admit(later, 3, 10) == [1] and slots.wait_seconds(later) > 3600
    assert [x["open"] for x in slots.status(later)] == [False, False] and "key-of" not in repr(slots.status(later)) + repr(slots.slots[0])
    assert Slots([]).admit(at, 1, 1) == [] and not Slots([]).all_exhausted(at)
    with pytest.raises(ValueError):
        Slots([Limiter() for _ in range(4)])


def test_slots_use_their_keys_and_hear_of_refusals(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    make = lambda key: lambda prompt: (None, 0, 0, "rate_limit_429:day") if key == "b" else ('{"label": "%s"}' % key, 1, 1, None)
    slots = Slots.of_keys({1: "a", 2: "b"}, make, rpm=3)
    articles = spark.createDataFrame([(str(i), "d", "t", "b") for i in range(6)], "article_id string, date string, title string, body_internal string")
    run = lambda: classify(spark, articles, str(tmp_path / "r"), "j", None, slots, "p", lambda: at + timedelta(seconds=61 * len(rounds)))
    rounds = []
    assert run() == "success" and not slots.slots[1].open(at + timedelta(seconds=61)) and slots.slots[0].limiter.wait_seconds(at) == 60
    rounds.append(1)
    assert run() == "success"
    rows = spark.read.parquet(str(tmp_path / "r"))
    assert "slot" not in rows.columns and {r["error"] for r in rows.filter("not success").collect()} == {"rate_limit_429"}
    assert rows.filter("label = 'a'").select("article_id").distinct().count() == 6 and rows.count() == 9


def test_places_are_dense(spark):
    rows = spark.range(1000).selectExpr("id % 10 AS a", "id AS b").repartition(7)
    found, total, folder = in_turn(rows, "a", "b")
    assert total == 1000 and [r["b"] for r in found.orderBy("place").collect()] == sorted(range(1000), key=lambda i: (i % 10, i))
    assert sorted(r["place"] for r in found.collect()) == list(range(1000)) and in_turn(rows.limit(0), "a")[1] == 0 and "in-turn" in folder


def test_answers():
    good = b'{"candidates": [{"content": {"parts": [{"text": "x"}]}}], "usageMetadata": {"promptTokenCount": 3}}'
    assert providers.answer_of(200, good) == ("x", 3, 0, None)
    assert [providers.answer_of(*x)[3] for x in ((429, b""), (500, b""), (200, b"{}"))] == ["rate_limit_429", "http_500", "no_candidates"]
    assert providers.provider("gemini", "http://127.0.0.1:9/", "k")("p")[0] is None
    assert providers.answer_of(429, b'{"quotaId": "GenerateRequestsPerDayPerProject"}')[3] == "rate_limit_429:day"
    assert providers.provider("claude", "k")("p") == (None, 0, 0, "claude_provider_not_yet_implemented")
    with pytest.raises(ValueError):
        providers.provider("other")


def test_settings(tmp_path):
    file = tmp_path / ".env"
    assert settings.read_settings(file) == {}
    file.write_bytes(codecs.BOM_UTF8 + b"# no\nA = 'b'\nGEMINI_KEY_1=old\nGEMINI_KEY_9=x\n")
    assert settings.read_settings(file)["A"] == "b" and settings.read_keys(file) == {1: "old"}
    settings.save_keys(file, {2: "new", 3: " "})
    assert settings.read_keys(file) == {2: "new"} and settings.read_settings(file)["A"] == "b"
    assert file.stat().st_mode & 0o777 == 0o600 and [x.name for x in tmp_path.iterdir()] == [".env"]
    file.write_text("# A=1\n=2\n\nB = \"x = 'y'\"\r\nC='\nD=\nB=last\n E =a#b", newline="")
    assert settings.read_settings(file) == {"B": "last", "C": "'", "D": "", "E": "a#b"}
    settings.save_keys(file, {1: "k"})
    assert settings.read_settings(file)["E"] == "a#b" and settings.read_keys(file) == {1: "k"}
    assert [settings.mask(x) for x in ("short", "test-key-12345", "a" * 39)] == ["****", "tes****45", "aaaa****aa"]
    file.write_bytes("A=b".encode("utf-16"))
    assert settings.read_settings(file) == {"A": "b"}


def test_raters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("article_id,label\n1,x\n2,y\n3,x\n")
    (tmp_path / "b.csv").write_text("article_id,label\n2,y\n1,z\n")
    found = files.read_raters(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert sorted(map(tuple, found.collect())) == [("x", "z"), ("y", "y")]


def test_codecs(spark):
    """Rows there and back: prompts that changed are told, jobs end in a final status, articles are flat rows."""
    prompt = Prompt.new("v", "s", "Text é")
    assert Prompt.of(prompt.row()) == prompt and prompt.verified() and not Prompt.of(prompt.row() | {"prompt_text": "other"}).verified()
    job = Job("j", "p", "s", "v", "gemini", "m-flash", sample_size=3)
    done = job.finished("cancelled", n_processed=2)
    assert Job.of(done.row()) == done and (done.status, done.n_processed) == ("cancelled", 2) and done.finished_at and Job.of(job.row() | {"n_errors": None}) == job
    with pytest.raises(ValueError, match="no final status"):
        job.finished("running")
    schema = "article_id string, publisher string, body_internal string, body_excerpt string, url string, cleaned_at string, keywords array<string>, raw_json string"
    articles = spark.createDataFrame([("1", None, "b", "", None, None, ["a", "b c"], None), ("2", "P", "", "", "u", "2024", None, '{"x": 1}')], schema)
    flat = to_flat(articles)
    assert [tuple(r) for r in flat.orderBy("article_id").collect()] == [("1", "", "b", "", "", "", "a, b c", "{}"), ("2", "P", "", "", "u", "2024", "", '{"x": 1}')]
    assert [r["keywords"] for r in from_flat(flat).orderBy("article_id").collect()] == [["a", "b c"], []]


def test_progress_is_a_record(spark, tmp_path):
    """Calls, errors, tokens, cost and percent, of a run and of the one that goes on with it."""
    at, said = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    articles = spark.createDataFrame([(str(i), "d", "t", "b") for i in range(5)], "article_id string, date string, title string, body_internal string")
    answer = lambda prompt: ('{"label": "x"}', 10, 2)
    run = lambda slots: classify(spark, articles, str(tmp_path / "r"), "j", answer, slots, "p", lambda: at, progress=said.append, sleep=lambda s: None, model="a-Flash")
    assert run(Slots([Limiter(rpm=2, rpd=2)])) == "cancelled" and run(Slots([Limiter()])) == "success"
    assert [(x.processed, x.total, x.errors, x.prompt_tokens, x.output_tokens, x.status, x.percent) for x in said] == [
        (2, 5, 0, 20, 4, "running", 40.0), (2, 5, 0, 20, 4, "cancelled", 40.0), (5, 5, 0, 50, 10, "running", 100.0), (5, 5, 0, 50, 10, "success", 100.0)]
    assert abs(said[-1].estimated_cost_usd - (50 * 0.15 + 10 * 0.6) / 1e6) < 1e-15
