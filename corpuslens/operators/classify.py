"""Resumable classification by a pluggable provider under global quotas.

Quotas hold for the whole cluster, so the driver admits a micro-batch that fits into what the slots have left, executors
call the provider for it, and its results are written before the next is admitted.  Results are keyed by job and article."""

from __future__ import annotations

import time as clock
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import FLASH_PRICES, PRICES, parse_reply
from corpuslens.operators.stats import numbered
from corpuslens.sources.settings import mask
from corpuslens.sources.shared import remove, shared_folder

# Default quotas of a slot, and the most slots at once.
REQUESTS_PER_MINUTE, TOKENS_PER_MINUTE, REQUESTS_PER_DAY, MOST_SLOTS = 15, 1_000_000, 1500, 3
_RESET_ZONE = ZoneInfo("America/Los_Angeles")


@dataclass
class Limiter:
    """Requests and tokens of the last minute, and requests since the last reset at midnight Pacific time."""

    rpm: int = REQUESTS_PER_MINUTE
    tpm: int = TOKENS_PER_MINUTE
    rpd: int = REQUESTS_PER_DAY
    _recent: deque = field(default_factory=deque)
    _today: int = 0
    _resets: datetime | None = None

    def _roll(self, now: datetime) -> None:
        if self._resets is None or now >= self._resets:
            local = now.astimezone(_RESET_ZONE)
            self._today, self._resets = 0, datetime.combine(local.date() + timedelta(days=1), time(), _RESET_ZONE)
        while self._recent and self._recent[0][0] <= now - timedelta(seconds=60):
            self._recent.popleft()

    def room(self, now: datetime, tokens_each: int) -> int:
        """Requests of so many tokens that may be sent now."""
        self._roll(now)
        used = sum(tokens for _, tokens in self._recent)
        by_tokens = (self.tpm - used) // tokens_each if tokens_each else self.rpm
        return max(0, min(self.rpd - self._today, self.rpm - len(self._recent), by_tokens))

    def record(self, now: datetime, requests: int, tokens_each: int) -> None:
        self._roll(now)
        self._recent.extend((now, tokens_each) for _ in range(requests))
        self._today += requests

    def report_429(self, axis: str, now: datetime) -> None:
        """A refusal on the day's quota (rpd) ends the day; one on another is left to the window."""
        self._roll(now)
        if axis == "rpd":
            self._today = self.rpd

    def wait_seconds(self, now: datetime) -> float:
        """Until a request may be sent, as far as requests go."""
        self._roll(now)
        if self._today >= self.rpd:
            return (self._resets - now).total_seconds()
        if len(self._recent) >= self.rpm:
            return (self._recent[len(self._recent) - self.rpm][0] + timedelta(seconds=60) - now).total_seconds()
        return 0.0


#: prompt -> (reply, or null if it failed; tokens in; tokens out; what went wrong, which may be left out)
Provider = Callable[[str], tuple]
# The error of a call that was refused, and what is added to it where the day's quota is used up.
REFUSED, OF_DAY = "rate_limit_429", ":day"


@dataclass
class Slot:
    """One quota.  Its calls go through its own provider, made with its key; without one, through the job's."""

    name: str
    limiter: Limiter = field(default_factory=Limiter)
    key: str = field(default="", repr=False)
    provider: Provider | None = field(default=None, repr=False)
    enabled: bool = True

    def open(self, now: datetime, tokens_each: int = 0) -> bool:
        return self.enabled and self.limiter.room(now, tokens_each) > 0

    def status(self, now: datetime) -> dict:
        """What may be shown and logged; the key is masked."""
        return {"name": self.name, "key": mask(self.key), "enabled": self.enabled, "open": self.open(now), "wait_seconds": self.limiter.wait_seconds(now)}


class Slots:
    """Slots that take turns; bare limiters are slots without a key."""

    def __init__(self, slots: list[Slot | Limiter]):
        if len(slots) > MOST_SLOTS:
            raise ValueError(f"at most {MOST_SLOTS} slots")
        self.slots = [x if isinstance(x, Slot) else Slot(f"slot{i}", x) for i, x in enumerate(slots, 1)]
        self._turn = 0

    @classmethod
    def of_keys(cls, keys: dict[int, str], make: Callable[[str], Provider], **quota) -> Slots:
        """A slot for each key, with a provider made from it."""
        return cls([Slot(f"slot{n}", Limiter(**quota), key, make(key)) for n, key in sorted(keys.items())])

    def admit(self, now: datetime, wanted: int, tokens_each: int) -> list[int]:
        """The slot of each request that is admitted: in turn, those without room left out."""
        taken, passed = [], 0
        while len(taken) < wanted and passed < len(self.slots):
            passed += 1
            if self.slots[self._turn].open(now, tokens_each):
                self.slots[self._turn].limiter.record(now, 1, tokens_each)
                taken.append(self._turn)
                passed = 0
            self._turn = (self._turn + 1) % len(self.slots)
        return taken

    def all_exhausted(self, now: datetime) -> bool:
        return bool(self.slots) and not any(x.open(now) for x in self.slots)

    def wait_seconds(self, now: datetime) -> float:
        return min((x.limiter.wait_seconds(now) for x in self.slots if x.enabled), default=0.0)

    def status(self, now: datetime) -> list[dict]:
        return [x.status(now) for x in self.slots]


# Fixed value: what stands between the prompt and the article.
_BETWEEN = "\n\n---\n\n기사:\n"
RESULTS = "article_id string, success boolean, label string, confidence double, rationale string, raw_response string, error string, prompt_tokens long, output_tokens long, job_id string, called_at string"


def call_provider(batch: DataFrame, providers: list[Provider], prompt: str, tasks: int = 2) -> DataFrame:
    """Results without job_id and called_at, and the slot: one call for each row, by the provider of its ``slot``."""

    def run(frames):
        for frame in frames:
            replies = [providers[slot](x) for slot, x in zip(frame["slot"], frame["prompt"])]
            yield pd.DataFrame({"article_id": frame["article_id"], "slot": frame["slot"], "reply": [r[0] for r in replies], "prompt_tokens": [r[1] for r in replies], "output_tokens": [r[2] for r in replies], "error": [r[3] if len(r) > 3 else None for r in replies]})

    asked = F.concat(F.lit(prompt + _BETWEEN + "제목: "), F.coalesce("title", F.lit("")), F.lit("\n본문: "), F.coalesce("body_internal", F.lit("")))
    answered = batch.select("article_id", "slot", asked.alias("prompt")).repartition(tasks).mapInPandas(run, "article_id string, slot int, reply string, prompt_tokens long, output_tokens long, error string")
    parsed = answered.withColumn("x", parse_reply(F.col("reply")))
    return parsed.select("article_id", "slot", F.col("reply").isNotNull().alias("success"), "x.label", "x.confidence", "x.rationale", F.col("reply").alias("raw_response"), "error", "prompt_tokens", "output_tokens")


@dataclass(frozen=True)
class Progress:
    """Where a job stands: calls of this run and of earlier ones that it went on with."""

    job_id: str
    total: int
    processed: int
    errors: int
    prompt_tokens: int
    output_tokens: int
    estimated_cost_usd: float
    status: str

    @property
    def percent(self) -> float:
        return 100 * self.processed / self.total if self.total else 0.0


def cost(model: str, prompt_tokens: int, output_tokens: int) -> float:
    """Estimated dollars."""
    prompt, output = FLASH_PRICES if "flash" in model.lower() else PRICES
    return (prompt_tokens * prompt + output_tokens * output) / 1_000_000


def in_turn(rows: DataFrame, *order: str) -> tuple[DataFrame, int, str]:
    """Rows with their ``place`` in that order, from 0, their number, and the folder where they lie in files by place: a stretch of
    places is read from the files that hold it alone."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "in-turn")
    numbered(rows, list(order), "place").write.mode("overwrite").parquet(folder)
    placed = spark.read.parquet(folder)
    return placed, placed.count(), folder


def classify(
    spark: SparkSession, articles: DataFrame, results_path: str, job_id: str, provider: Provider, slots: Slots, prompt: str,
    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), tokens_each: int = 1000, progress: Callable[[Progress], None] | None = None,
    sleep: Callable[[float], None] = clock.sleep, model: str = "",
) -> str:
    """Writes results until nothing is pending (success) or no slot has room (cancelled).  Where a slot has room again within the
    hour, it is waited for, a minute at most, and asked once more.  Calls that a slot's service refused are told to its
    limiter.  Failed calls of this run aren't repeated in it, but come again when the job is resumed.  ``progress`` hears of every
    stretch of calls."""
    from corpuslens.operators.store import pending

    spark.createDataFrame([], RESULTS).write.mode("append").parquet(results_path)
    before = spark.read.schema(RESULTS).parquet(results_path)
    todo, left, folder = in_turn(pending(articles, before, job_id), "date", "article_id")
    providers, done = [x.provider or provider for x in slots.slots], 0
    sums = before.filter((F.col("job_id") == job_id) & F.col("success")).agg(F.countDistinct("article_id"), F.sum("prompt_tokens"), F.sum("output_tokens")).head()
    known, used = sums[0], [0, sums[1] or 0, sums[2] or 0]
    try:
        return _calls(spark, todo, left, known, used, results_path, job_id, providers, slots, prompt, now, tokens_each, progress, sleep, model)
    finally:
        remove(spark, folder)


def _calls(spark, todo, left, known, used, results_path, job_id, providers, slots, prompt, now, tokens_each, progress, sleep, model) -> str:
    def tell(status: str) -> str:
        if progress:
            progress(Progress(job_id, known + left, known + done, *used, cost(model, used[1], used[2]), status))
        return status

    done = 0
    while done < left:
        turns = slots.admit(now(), left - done, tokens_each)
        if not turns and 0 < (wait := slots.wait_seconds(now())) < 3600:
            sleep(min(wait + 1, 60))
            turns = slots.admit(now(), left - done, tokens_each)
        if not turns:
            return tell("cancelled")
        mine = todo.filter(F.col("place").between(done, done + len(turns) - 1))
        mine = mine.withColumn("slot", F.element_at(F.array(*map(F.lit, turns)), (F.col("place") - done + 1).cast("int")))
        refused = Observation()
        counts = [F.count_if((F.col("slot") == i) & (F.col("error") == error)).alias(f"{kind}{i}") for i in range(len(providers)) for kind, error in (("rpm", REFUSED), ("rpd", REFUSED + OF_DAY))]
        counts += [F.count_if(~F.col("success")).alias("errors"), F.sum("prompt_tokens").alias("prompt"), F.sum("output_tokens").alias("output")]
        answered = call_provider(mine, providers, prompt).observe(refused, *counts).drop("slot").withColumn("error", F.when(F.startswith("error", F.lit(REFUSED)), REFUSED).otherwise(F.col("error")))
        answered.withColumns({"job_id": F.lit(job_id), "called_at": F.lit(now().isoformat())}).write.mode("append").parquet(results_path)
        found = refused.get
        used[:] = [n + (found.pop(name) or 0) for n, name in zip(used, ("errors", "prompt", "output"))]
        for name, n in found.items():
            if n:
                slots.slots[int(name[3:])].limiter.report_429(name[:3], now())
        done += len(turns)
        tell("running")
    return tell("success")
