"""Projects: related tables below one root folder, and the steps from ingest to analysis that read and write them.

Small tables are append-only logs of which the latest row of each key counts.  A project's articles are kept in generations:
ingest appends to the newest one, cleaning writes a new one, so a failed run leaves the old one as it was.  Paths go
through Spark's file systems alone, so a root can be any store that the cluster reads and writes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime, timezone
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as t
from corpuslens.operators import analyze, clean, store
from corpuslens.operators.classify import RESULTS, Provider, Slots, classify
from corpuslens.sources import exports, files

SCHEMA_VERSION = "1.0"

# The tables, their columns and which of them must be set; the key comes first.
LOGS = {
    "projects": "project_id string not null, name string not null, created_at string not null, updated_at string not null, schema_version string not null, description string",
    "ingest_runs": "run_id string not null, project_id string not null, source string not null, params_json string not null, started_at string not null, finished_at string, status string not null, raw_count long, in_range_count long, inserted_count long, error string",
    "clean_runs": "run_id string not null, project_id string not null, params_json string not null, started_at string not null, finished_at string, status string not null, input_count long, output_count long, dedup_primary long, dedup_fallback long, dropped_short long, dropped_advert long, dropped_other long, error string",
    "label_schemas": "schema_id string not null, name string not null, schema_type string not null, labels_json string not null, created_at string not null, description string",
    "prompt_versions": "version_id string not null, schema_id string not null, prompt_text string not null, created_at string not null, sha256 string not null",
    "llm_jobs": "job_id string not null, project_id string not null, schema_id string not null, prompt_version_id string not null, provider string not null, model string not null, temperature double not null, sample_size long not null, started_at string not null, finished_at string, status string not null, n_processed long, n_errors long, prompt_tokens long, candidates_tokens long, estimated_cost_usd double",
    "artifacts": "artifact_id string not null, project_id string not null, artifact_type string not null, file_path string not null, sha256 string not null, size_bytes long, created_at string not null, metadata_json string",
}
ARTICLES = "article_id string, project_id string, ingest_run_id string, source string, date string, publisher string, title string, body_internal string, body_excerpt string, keywords array<string>, url string, raw_json string, cleaned_at string, is_active boolean, ingest_seq long"
#: Columns that name a row of another table.
PARENTS = {"project_id": "projects", "schema_id": "label_schemas", "prompt_version_id": "prompt_versions"}


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _columns(name: str) -> dict[str, bool]:
    """Column names of a log, in order, and whether each must be set."""
    return {c.split()[0]: c.endswith("not null") for c in LOGS[name].split(", ")}


@dataclass(frozen=True)
class Label:
    name: str
    description: str = ""
    examples: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class LabelSchema:
    schema_id: str
    name: str
    schema_type: str
    labels: list[Label]
    description: str = ""

    def __post_init__(self):
        if self.schema_type not in ("single_label", "multi_label"):
            raise ValueError(f"schema_type is {self.schema_type!r}, not single_label or multi_label")

    def row(self) -> dict:
        labels = json.dumps([asdict(x) for x in self.labels], ensure_ascii=False)
        return {"schema_id": self.schema_id, "name": self.name, "schema_type": self.schema_type, "labels_json": labels, "created_at": _now(), "description": self.description}

    @classmethod
    def of(cls, row: dict) -> LabelSchema:
        known = {f.name for f in fields(Label)}
        labels = [Label(**{k: v for k, v in x.items() if k in known}) for x in json.loads(row["labels_json"] or "[]")]
        return cls(row["schema_id"], row["name"], row["schema_type"], labels, row["description"] or "")


@dataclass(frozen=True)
class Prompt:
    """A version of a prompt's text, which must not change any more."""

    version_id: str
    schema_id: str
    prompt_text: str
    created_at: str
    sha256: str

    @classmethod
    def new(cls, version_id: str, schema_id: str, text: str) -> Prompt:
        return cls(version_id, schema_id, text, _now(), sha256(text.encode()).hexdigest())

    @classmethod
    def of(cls, row: dict) -> Prompt:
        return cls(**{f.name: row[f.name] for f in fields(cls)})

    def row(self) -> dict:
        return asdict(self)

    def verified(self) -> bool:
        return sha256(self.prompt_text.encode()).hexdigest() == self.sha256


@dataclass(frozen=True)
class Job:
    """A classification job as its row has it."""

    job_id: str
    project_id: str
    schema_id: str
    prompt_version_id: str
    provider: str
    model: str
    temperature: float = 0.0
    sample_size: int = 0
    started_at: str = ""
    finished_at: str | None = None
    status: str = "running"
    n_processed: int = 0
    n_errors: int = 0
    prompt_tokens: int = 0
    candidates_tokens: int = 0
    estimated_cost_usd: float = 0.0

    @classmethod
    def of(cls, row: dict) -> Job:
        return cls(**{f.name: row[f.name] for f in fields(cls) if row.get(f.name) is not None})

    def row(self) -> dict:
        return asdict(self)

    def finished(self, status: str = "success", **counts) -> Job:
        if status not in FINAL:
            raise ValueError(f"no final status: {status!r}")
        return replace(self, status=status, finished_at=_now(), **counts)


# Fixed value: how a job can end.
FINAL = ("success", "failed", "cancelled")


def to_flat(articles: DataFrame) -> DataFrame:
    """Articles as flat rows: keywords joined by a comma and a space, empty text for what is missing."""
    empty = {c: "" for c in ("publisher", "body_internal", "body_excerpt", "url", "cleaned_at")}
    return articles.withColumn("keywords", F.coalesce(F.array_join("keywords", ", "), F.lit(""))).na.fill(empty).withColumn("raw_json", F.coalesce(F.nullif("raw_json", F.lit("")), F.lit("{}")))


def from_flat(rows: DataFrame) -> DataFrame:
    """The other way round: keywords cut at commas, empty ones left out; empty raw JSON is an empty object."""
    return to_flat(rows.withColumn("keywords", t.keywords(F.col("keywords")))).withColumn("keywords", t.keywords(F.col("keywords")))


@dataclass(frozen=True)
class IngestParams:
    project_id: str
    source: str
    input_path: str
    date_from: str | None = None
    date_to: str | None = None
    columns: dict[str, str] | None = None


#: Readers by source name: (spark, params, seen) -> articles of any date; ``seen`` gets how many rows there were before any filter.
SOURCES: dict[str, Callable[[SparkSession, IngestParams, Observation], DataFrame]] = {
    "csv": lambda spark, p, seen: files.read_csv(spark, p.input_path, p.columns, seen),
    "archive": lambda spark, p, seen: files.read_xlsx(spark, p.input_path, p.columns, seen),
    "news_search": files.read_news_api,
    "blog_search": files.read_news_api,
}


@dataclass(frozen=True)
class Analysis:
    descriptive: DataFrame
    publishers: DataFrame
    sources: DataFrame
    keywords: DataFrame
    monthly: DataFrame
    weekly: DataFrame
    labels_monthly: DataFrame | None = None
    by_publisher: DataFrame | None = None
    by_month: DataFrame | None = None


class Projects:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def discover(cls, spark: SparkSession, folder: str) -> list[Projects]:
        """The roots below ``folder``, by name; what is incomplete or can't be read is left out."""
        found = []
        for name in cls(spark, folder)._list(""):
            root = cls(spark, f"{folder.rstrip('/')}/{name}")
            try:
                if not root.missing():
                    root.table("projects").count()
                    found.append(root)
            except Exception:  # a root that can't be read is not one
                continue
        return found

    # Tables

    def _list(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        store_ = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in store_.listStatus(path)) if store_.exists(path) else []

    def init(self) -> list[str]:
        """Makes what tables are missing, and returns their names."""
        made = self.missing()
        for name in made:
            self.spark.createDataFrame([], self._schema(name)).write.parquet(f"{self.root}/{name}")
        return made

    def missing(self) -> list[str]:
        return [name for name in LOGS if "_SUCCESS" not in self._list(name)]

    def _schema(self, name: str) -> str:
        return LOGS[name].replace(" not null", "") + ", written_at long"

    def table(self, name: str) -> DataFrame:
        """The latest row of each key."""
        columns = list(_columns(name))
        rows = self.spark.read.schema(self._schema(name)).parquet(f"{self.root}/{name}")
        return rows.groupBy(columns[0]).agg(F.max_by(F.struct(*columns), "written_at").alias("row")).select("row.*")

    def get(self, name: str, key: str) -> dict | None:
        row = self.table(name).filter(F.col(next(iter(_columns(name)))) == key).head()
        return row.asDict() if row else None

    def put(self, name: str, /, **row) -> None:
        """Inserts a row or updates the given columns of one with that key; created_at stays as it was first written."""
        columns = _columns(name)
        if unknown := sorted(set(row) - set(columns)):
            raise ValueError(f"{name} has no columns {unknown}")
        key = next(iter(columns))
        old = self.get(name, row[key]) or {}
        new = old | row | ({"created_at": old["created_at"]} if old.get("created_at") else {})
        if unset := [c for c, needed in columns.items() if needed and new.get(c) is None]:
            raise ValueError(f"{name} needs {unset}")
        for column, parent in PARENTS.items():
            if column in columns and column != key and self.get(parent, new[column]) is None:
                raise ValueError(f"{parent} has no {new[column]!r}")
        values = [tuple([*(new.get(c) for c in columns), time.time_ns()])]
        self.spark.createDataFrame(values, self._schema(name)).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def put_project(self, project_id: str, name: str, description: str = "") -> None:
        self.put("projects", project_id=project_id, name=name, description=description, created_at=_now(), updated_at=_now(), schema_version=SCHEMA_VERSION)

    def put_prompt(self, version_id: str, schema_id: str, text: str) -> None:
        self.put("prompt_versions", **Prompt.new(version_id, schema_id, text).row())

    def _generation(self, project_id: str) -> int:
        """The newest complete generation of a project's articles; 0 where there is none."""
        found = [int(v[1:]) for v in self._list(f"articles/{project_id}") if v[1:].isdigit()]
        return max((v for v in found if "_SUCCESS" in self._list(f"articles/{project_id}/v{v}")), default=0)

    def _generation_path(self, project_id: str, number: int) -> str:
        return f"{self.root}/articles/{project_id}/v{number}"

    def articles(self, project_id: str, active_only: bool = False) -> DataFrame:
        number = self._generation(project_id)
        rows = self.spark.read.schema(ARTICLES).parquet(self._generation_path(project_id, number)) if number else self.spark.createDataFrame([], ARTICLES)
        return rows.filter("is_active") if active_only else rows

    def results(self, job_id: str) -> DataFrame:
        """The last result of each article: a failed one goes when its article is classified again."""
        return store.latest_results(self.spark.read.parquet(f"{self.root}/llm_results/{job_id}"))

    # Steps

    def run_ingest(self, params: IngestParams) -> str:
        """Appends new articles of a source; the first write of an article_id wins.  What fails is in the log's status and error."""
        run_id, log = uuid.uuid4().hex, "ingest_runs"
        self.put(log, run_id=run_id, project_id=params.project_id, source=params.source, params_json=json.dumps(asdict(params), ensure_ascii=False), started_at=_now(), status="running")
        try:
            if params.source not in SOURCES:
                raise ValueError(f"no source {params.source!r}")
            stored, (seen, wanted, written) = self.articles(params.project_id), (Observation(x) for x in ("seen", "wanted", "written"))
            # All three counts come from the one pass that writes.
            read = files.in_range(SOURCES[params.source](self.spark, params, seen), params.date_from, params.date_to)
            read = read.observe(wanted, F.count(F.lit(1)).alias("n"))
            last = stored.agg(F.coalesce(F.max("ingest_seq"), F.lit(-1))).head()[0]
            rows = read.withColumns({
                "project_id": F.lit(params.project_id), "ingest_run_id": F.lit(run_id), "cleaned_at": F.lit(None).cast("string"),
                "is_active": F.lit(True), "ingest_seq": F.monotonically_increasing_id() + last + 1,
            }).select(*stored.columns)
            path = self._generation_path(params.project_id, max(1, self._generation(params.project_id)))
            new = store.first_write(rows, stored, ["article_id"], ["ingest_seq"])
            new.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
            done = {"raw_count": seen.get["raw"], "in_range_count": wanted.get["n"], "inserted_count": written.get["n"]}
            self.put(log, run_id=run_id, status="success", finished_at=_now(), **done)
        except Exception as failed:
            self.put(log, run_id=run_id, status="failed", finished_at=_now(), error=str(failed)[:1000])
        return run_id

    def run_clean(self, project_id: str, least_chars: int = 20, threshold: float = 0.85) -> str:
        """Cleans active articles and takes out duplicates and filtered ones; rows that are out never come back."""
        run_id, log = uuid.uuid4().hex, "clean_runs"
        params = json.dumps({"least_chars": least_chars, "threshold": threshold})
        self.put(log, run_id=run_id, project_id=project_id, params_json=params, started_at=_now(), status="running")
        try:
            articles, number = self.articles(project_id), self._generation(project_id)
            decided = clean.dispositions(articles, least_chars, threshold)
            found = decided.withColumn("is_active", F.col("disposition") == "kept").withColumn("cleaned_at", F.lit(_now()))
            path = self._generation_path(project_id, number + 1)
            out = articles.filter("not is_active").withColumn("disposition", F.lit(None).cast("string"))
            # The decision is written along, so that it is taken once; readers' schema leaves it out.
            found.select(*articles.columns, "disposition").unionByName(out).write.mode("overwrite").parquet(path)
            rows = self.spark.read.schema(f"{ARTICLES}, disposition string").parquet(path).filter("disposition is not null")
            n = {r["disposition"]: r["count"] for r in rows.groupBy("disposition").count().collect()}
            names = {"output_count": "kept", "dedup_primary": "dup_primary", "dedup_fallback": "dup_fallback", "dropped_short": "short", "dropped_advert": "advert", "dropped_other": "no_title"}
            counts = {column: n.get(kind, 0) for column, kind in names.items()}
            self.put(log, run_id=run_id, status="success", finished_at=_now(), input_count=sum(n.values()), **counts)
        except Exception as failed:
            self.put(log, run_id=run_id, status="failed", finished_at=_now(), error=str(failed)[:1000])
            raise
        return run_id

    def run_job(
        self, project_id: str, schema_id: str, prompt_version_id: str, provider_name: str, model: str, provider: Provider, slots: Slots,
        sample_size: int = 0, temperature: float = 0.0, job_id: str | None = None, **options,
    ) -> str:
        """Classifies the first ``sample_size`` active articles (0: all).  With the id of an earlier job, it goes on with that."""
        job_id = job_id or uuid.uuid4().hex
        self.put(
            "llm_jobs", job_id=job_id, project_id=project_id, schema_id=schema_id, prompt_version_id=prompt_version_id, provider=provider_name,
            model=model, temperature=temperature, sample_size=sample_size, started_at=_now(), status="running",
        )
        prompt = self.get("prompt_versions", prompt_version_id)
        if not Prompt.of(prompt).verified():
            raise ValueError(f"the text of prompt {prompt_version_id} has changed")
        sample, status = store.sample_first(self.articles(project_id, active_only=True), sample_size), "failed"
        try:
            status = classify(self.spark, sample, f"{self.root}/llm_results/{job_id}", job_id, provider, slots, prompt["prompt_text"], model=model, **options)
        finally:
            self.finish_job(job_id, model, status)
        return job_id

    def finish_job(self, job_id: str, model: str, status: str) -> None:
        """Sums up a job's results in its row."""
        if status not in FINAL:
            raise ValueError(f"no final status: {status!r}")
        counts = {}
        if "_SUCCESS" in self._list(f"llm_results/{job_id}"):
            sums = store.job_metrics(self.results(job_id)).withColumn("cost", t.cost_usd(F.lit(model), F.col("prompt_tokens"), F.col("output_tokens")))
            for row in sums.collect():  # of one job
                counts = {"n_processed": row["n_processed"], "n_errors": row["n_errors"], "prompt_tokens": row["prompt_tokens"], "candidates_tokens": row["output_tokens"], "estimated_cost_usd": row["cost"]}
        self.put("llm_jobs", job_id=job_id, status=status, finished_at=_now(), **counts)

    def analyse(self, project_id: str, job_id: str | None = None, output: str | None = None) -> Analysis:
        """All analyses that project and job allow; with ``output``, articles and results are exported there and logged."""
        every = self.articles(project_id)
        results = self.results(job_id) if job_id else None
        sets = clean.cut_lineage(analyze.analysis_sets(every, results))
        by_count = lambda part: analyze.of_part(sets, part, "value").orderBy(F.desc("n"), "value")
        by_period = lambda part: analyze.of_part(sets, part, "period").orderBy("period")
        found = {
            "descriptive": analyze.descriptive_of(sets), "publishers": by_count("publisher"), "sources": by_count("source"),
            "keywords": analyze.keyword_counts(every.filter("is_active"), F.col("keywords")), "monthly": by_period("month"), "weekly": by_period("week"),
        }
        if job_id:
            found["labels_monthly"] = analyze.label_periods_of(sets)
            found["by_publisher"], found["by_month"] = (analyze.label_tab_of(sets, c) for c in ("publisher", "month"))
        if output:
            exports.export_articles_parquet(every, f"{output}/articles.parquet")
            self.log_artifact(project_id, "articles", f"{output}/articles.parquet")
            if job_id:
                exports.export_results_csv(results, every, job_id, f"{output}/results.csv")
                self.log_artifact(project_id, "results", f"{output}/results.csv")
        return Analysis(**found)

    def log_artifact(self, project_id: str, kind: str, path: str) -> None:
        """Logs an exported folder: its size, and the hash of its files' sorted hashes."""
        parts = self.spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("h"))
        row = parts.agg(F.sum("length").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h")).head()  # a hash a file
        self.put("artifacts", artifact_id=uuid.uuid4().hex, project_id=project_id, artifact_type=kind, file_path=path, sha256=row["h"], size_bytes=row["n"] or 0, created_at=_now())

    # Where a project stands

    def status(self, project_id: str) -> dict[str, str | int]:
        """State of the four stages, and how many of them are done in a row."""
        runs = lambda name, state: not self.table(name).filter((F.col("project_id") == project_id) & F.col("status").isin(state)).isEmpty()
        done = [
            not self.articles(project_id).isEmpty(), runs("clean_runs", "success"), runs("llm_jobs", "success"),
            not self.table("artifacts").filter(F.col("project_id") == project_id).isEmpty(),
        ]
        states = {stage: "done" if ok else "pending" for stage, ok in zip(("ingest", "clean", "classify", "analyse"), done)}
        if runs("llm_jobs", "running"):
            states["classify"] = "running"
        return states | {"step": next((i for i, ok in enumerate(done) if not ok), 4)}

    def counts(self, project_id: str) -> dict[str, int]:
        """Articles, active ones, results on this project's articles, and artifacts."""
        articles = self.articles(project_id)
        jobs = [r["job_id"] for r in self.table("llm_jobs").filter(F.col("project_id") == project_id).select("job_id").collect()]
        paths = [f"{self.root}/llm_results/{j}" for j in jobs if "_SUCCESS" in self._list(f"llm_results/{j}")]
        results = store.latest_results(self.spark.read.parquet(*paths)) if paths else self.spark.createDataFrame([], RESULTS)
        return analyze.overview(articles, results).head().asDict() | {"artifacts": self.table("artifacts").filter(F.col("project_id") == project_id).count()}

    def history(self, name: str, project_id: str) -> DataFrame:
        return self.table(name).filter(F.col("project_id") == project_id).orderBy(F.desc("started_at"))

    def activity(self, project_id: str, n: int = 5) -> DataFrame:
        logs = {"ingest": ("ingest_runs", "source"), "clean": ("clean_runs", "run_id"), "classify": ("llm_jobs", "model")}
        found = [
            self.table(name).filter(F.col("project_id") == project_id)
            .select(F.lit(kind).alias("kind"), F.concat_ws(" ", what, F.col("status")).alias("what"), F.col("started_at").alias("at"))
            for kind, (name, what) in logs.items()
        ]
        return store.recent_activity(*found, n=n)

    # Packages

    def export_package(self, project_id: str, target: str, work: str, raw_folder: str | None = None) -> None:
        """A zip with the project's row, its ingest runs and its articles; ``work`` is a folder that driver and cluster share."""
        of = lambda name: self.table(name).filter(F.col("project_id") == project_id)
        project = self.get("projects", project_id)
        tables = {"projects": of("projects"), "ingest_runs": of("ingest_runs"), "articles": self.articles(project_id)}
        exports.write_package(tables, {k: project[k] for k in ("project_id", "name", "schema_version", "created_at")}, target, work, raw_folder)

    def import_package(self, source: str, folder: str, project_id: str | None = None, name: str | None = None) -> dict:
        """Takes a package in, under another id or name if asked for: {project_id, articles, warnings}."""
        tables, manifest, warnings = exports.read_package(self.spark, source, folder, project_id)
        if manifest["project"].get("schema_version") != SCHEMA_VERSION:
            warnings = [*warnings, f"schema version {manifest['project'].get('schema_version')}"]
        project_id = project_id or manifest["project"]["project_id"]
        for table in ("projects", "ingest_runs"):  # a row for a project and one for each run
            for row in tables[table].collect():
                self.put(table, **{k: v for k, v in row.asDict().items() if v is not None} | ({"name": name} if name and table == "projects" else {}))
        names = self.spark.createDataFrame([], ARTICLES).columns
        rows = tables["articles"].select(*names)
        rows.write.parquet(self._generation_path(project_id, self._generation(project_id) + 1))
        return {"project_id": project_id, "articles": self.articles(project_id).count(), "warnings": warnings}
