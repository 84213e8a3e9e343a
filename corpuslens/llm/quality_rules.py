"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be trusted,
and the posterior probability of good quality decides.

Everything that touches a document is a built-in DataFrame function.  The votes of all documents are counted by their
pattern; the number of patterns is bounded by three to the power of the number of rules, whatever the input, and
the estimation runs on these counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import stored, table

_GAP = r"[\x20\x09-\x0D]+"
_WINDOW = 5

# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "with", "der", "die", "das", "und", "den", "von", "mit", "ist",
    "le", "la", "les", "des", "et", "en", "un", "une", "que", "el", "los", "de", "y", "por", "para", "una",
)


def with_text_features(docs: DataFrame) -> DataFrame:
    """Adds ``q`` (a struct of counts) to each row, without a shuffle.  ``docs`` has text and no column of the names used here.

    Repeated windows are found by hashing each window of words in place.  Only where the number of distinct hashes is
    smaller than the number of windows are (hash, place) pairs sorted to find which windows repeat."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("_words", F.filter(F.split(text, _GAP), lambda w: w != ""))
    base = base.withColumn(
        "_windows",
        F.when(
            F.size("_words") >= _WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - (_WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("_words", i, _WINDOW)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    base = base.withColumn(
        "_pairs",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    repeated = F.sort_array(
        F.transform(
            F.filter(
                "_pairs",
                lambda x, k: (F.get("_pairs", k - 1)["h"].eqNullSafe(x["h"]))
                | (F.get("_pairs", k + 1)["h"].eqNullSafe(x["h"])),
            ),
            lambda x: x["i"],
        )
    )
    base = base.withColumn("_places", repeated)
    covered = F.when(
        F.size("_places") > 0,
        F.aggregate(
            "_places",
            F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last")),
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(_WINDOW), p - acc["last"])).alias("n"), p.alias("last")
            ),
        )["n"],
    ).otherwise(0)
    base = base.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n_words = F.size("_words").cast("long")
    features = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*FUNCTION_WORDS))).cast("long").alias("n_function_words"),
    )
    return base.withColumn("q", features).drop("_words", "_windows", "_pairs", "_places", "_lines")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote on ``q``: 1 good, -1 bad, 0 abstains.  A document without words gets bad votes where it gets any."""
    q = F.col("q")
    words = q["n_words"]
    per_word = lambda name: q[name] / F.greatest(words, F.lit(1))
    empty = words == 0
    mean_length, symbols, runs = per_word("word_chars"), per_word("n_symbols"), per_word("n_symbol_runs")
    repeat = per_word("n_repeat_words")
    dup = q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1))
    letters = q["n_letters"] / F.greatest(q["word_chars"], F.lit(1))
    capitals = q["n_capitals"] / F.greatest(q["n_letters"], F.lit(1))
    return {
        "length": _vote(words < 10, words >= 30),
        "word_length": _vote((mean_length < 2.0) | (mean_length > 15), mean_length.between(3, 10)),
        "symbols": _vote(empty | (symbols > 0.2), symbols < 0.02),
        "symbol_runs": _vote(empty | (runs > 0.15), runs < 0.02),
        "letters": _vote(empty | (letters < 0.7), letters > 0.85),
        "capitals": _vote((words >= 10) & (capitals > 0.5), (words > 0) & (capitals < 0.2)),
        "repeated_windows": _vote(empty | (repeat > 0.2), repeat < 0.05),
        "repeated_lines": _vote(empty | (dup > 0.3), dup < 0.1),
        "function_words": F.when(per_word("n_function_words") > 0.05, 1).otherwise(0),
    }


def base_failed() -> Column:
    q = F.col("q")
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


@dataclass(frozen=True)
class LabelModel:
    """Prior probability of good quality and, for each rule, how likely a good and a bad document get each vote (bad,
    none, good).  That a rule abstains counts as well."""

    prior: float
    given_good: tuple[tuple[float, float, float], ...]
    given_bad: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, good, bad in zip(votes, self.given_good, self.given_bad):
            weights = [math.log(g / b) for g, b in zip(good, bad)]
            odds = odds + F.when(vote == -1, weights[0]).when(vote == 1, weights[2]).otherwise(weights[1])
        return 1 / (1 + F.exp(-odds))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation on (votes, count).  Rules are held to be better than chance: a good document gets a bad
    vote with a probability of 0.1 at most, and a bad one gets it twice as often at least.  With no patterns the start
    values stay."""
    width = len(patterns[0][0]) if patterns else 0
    good, bad, prior = [[0.02, 0.18, 0.8]] * width, [[0.4, 0.3, 0.3]] * width, 0.85
    for _ in range(rounds if patterns else 0):
        of_good = [[0.5, 1.0, 1.0] for _ in range(width)]  # pseudo-counts
        of_bad = [[1.0, 1.0, 1.0] for _ in range(width)]
        total = weight = 0.0
        for votes, n in patterns:
            x, y = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                x += math.log(good[j][v + 1])
                y += math.log(bad[j][v + 1])
            p = 1 / (1 + math.exp(min(700, y - x)))
            total += n
            weight += n * p
            for j, v in enumerate(votes):
                of_good[j][v + 1] += n * p
                of_bad[j][v + 1] += n * (1 - p)
        good = [_at_most([c / sum(x) for c in x], 0.1) for x in of_good]
        bad = [_at_least([c / sum(x) for c in x], 2 * g[0]) for x, g in zip(of_bad, good)]
        prior = min(0.98, max(0.5, weight / max(total, 1)))
    return LabelModel(prior, tuple(map(tuple, good)), tuple(map(tuple, bad)))


def _at_most(votes: list[float], bound: float) -> list[float]:
    return votes if votes[0] <= bound else [bound, *[v * (1 - bound) / (1 - votes[0]) for v in votes[1:]]]


def _at_least(votes: list[float], bound: float) -> list[float]:
    return votes if votes[0] >= bound else [bound, *[v * (1 - bound) / (1 - votes[0]) for v in votes[1:]]]


def rate_quality(docs: DataFrame, threshold: float = 0.5, with_row: bool = False) -> DataFrame:
    """doc_id (or, ``with_row``, all columns of ``docs`` in the struct ``row``), ``q``, ``votes``, ``posterior``, ``base_failed``
    and ``kept`` of every row of ``docs``.

    The features are computed once and written to the shared scratch folder.  ``kept`` is false where a base test fails,
    else whether the posterior reaches ``threshold``.  Null texts count as empty and fail; null or repeated doc_ids are
    rated row by row; other columns are ignored, whatever their names.  An empty table gives no rows."""
    votes = rules()
    own = F.struct(*docs.columns).alias("row") if with_row else F.col("doc_id")
    rated = with_text_features(docs.select(own, "text"))
    rated = rated.select("row" if with_row else "doc_id", "q", F.struct(*[v.cast("byte").alias(k) for k, v in votes.items()]).alias("votes"))
    rated = stored(rated, "quality")
    counted = rated.groupBy("votes").count().collect()  # at most 3 ** len(votes) rows
    model = fit_label_model(sorted((tuple(r["votes"]), r["count"]) for r in counted))
    rated = rated.withColumn("posterior", model.posterior([F.col("votes")[k] for k in votes]))
    rated = rated.withColumn("base_failed", base_failed())
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def accepted(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns alone."""
    return rate_quality(docs, threshold, with_row=True).filter("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``rate_quality``: null and empty texts have no words and fail, an empty table gives no rows."""
    rated = rate_quality(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rated.select("doc_id", *[F.col("q")[c].alias(c) for c in counts], "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def _smoothed(weight: str, none: float) -> str:
    """Expected counts of each rule's three votes as shares, from the weights of the patterns."""
    one = f"{{start}} + list_sum(list_transform(range(1, len(pats) + 1), lambda i: CASE WHEN pats[i].v[j] = {{vote}} THEN pats[i].n * {weight} ELSE 0.0::DOUBLE END))"
    votes = ", ".join(one.format(start=f"{s}::DOUBLE", vote=v) for s, v in ((none, -1), (1.0, 0), (1.0, 1)))
    return f"list_transform(list_transform(range(1, 10), lambda j: [{votes}]), lambda x: list_transform(x, lambda y: y / (x[1] + x[2] + x[3])))"


_ODDS = "list_sum(list_transform(range(1, 10), lambda j: ln({m}[j][{v}[j] + 2])))"
OP5_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (
  SELECT id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
again AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS k FROM windows) WHERE k > 1),
covered AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY id),
counts AS (
  SELECT s.id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(regexp_extract_all(text, '[#*$%&|<>]+')) AS n_runs, len(regexp_extract_all(text, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals,
    len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in FUNCTION_WORDS)}))) AS n_function FROM split s LEFT JOIN covered c ON s.id = c.id),
shares AS (
  SELECT *, n_words = 0 AS none, word_chars / greatest(n_words, 1)::DOUBLE AS size, n_symbols / greatest(n_words, 1)::DOUBLE AS symbols, n_runs / greatest(n_words, 1)::DOUBLE AS runs,
    n_letters / greatest(word_chars, 1)::DOUBLE AS letters, n_capitals / greatest(n_letters, 1)::DOUBLE AS capitals, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeats,
    n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup FROM counts),
voted AS (
  SELECT *, [CASE WHEN n_words < 10 THEN -1 WHEN n_words >= 30 THEN 1 ELSE 0 END,
    CASE WHEN size < 2 OR size > 15 THEN -1 WHEN size BETWEEN 3 AND 10 THEN 1 ELSE 0 END,
    CASE WHEN none OR symbols > 0.2::DOUBLE THEN -1 WHEN symbols < 0.02::DOUBLE THEN 1 ELSE 0 END,
    CASE WHEN none OR runs > 0.15::DOUBLE THEN -1 WHEN runs < 0.02::DOUBLE THEN 1 ELSE 0 END,
    CASE WHEN none OR letters < 0.7::DOUBLE THEN -1 WHEN letters > 0.85::DOUBLE THEN 1 ELSE 0 END,
    CASE WHEN n_words >= 10 AND capitals > 0.5::DOUBLE THEN -1 WHEN n_words > 0 AND capitals < 0.2::DOUBLE THEN 1 ELSE 0 END,
    CASE WHEN none OR repeats > 0.2::DOUBLE THEN -1 WHEN repeats < 0.05::DOUBLE THEN 1 ELSE 0 END,
    CASE WHEN none OR dup > 0.3::DOUBLE THEN -1 WHEN dup < 0.1::DOUBLE THEN 1 ELSE 0 END,
    CASE WHEN n_function / greatest(n_words, 1)::DOUBLE > 0.05::DOUBLE THEN 1 ELSE 0 END] AS v FROM shares),
patterns AS (
  SELECT list(struct_pack(v := v, n := n) ORDER BY v) AS pats FROM (SELECT v, count(*) AS n FROM voted GROUP BY v)),
model(r, good, bad, prior) AS (
  SELECT 0, list_transform(range(1, 10), lambda j: [0.02::DOUBLE, 0.18::DOUBLE, 0.8::DOUBLE]), list_transform(range(1, 10), lambda j: [0.4::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE]), 0.85::DOUBLE
  UNION ALL
  SELECT r + 1, good2, list_transform(range(1, 10), lambda j: CASE WHEN bad1[j][1] >= 2 * good2[j][1] THEN bad1[j]
      ELSE [2 * good2[j][1], bad1[j][2] * (1 - 2 * good2[j][1]) / (1 - bad1[j][1]), bad1[j][3] * (1 - 2 * good2[j][1]) / (1 - bad1[j][1])] END), prior1
  FROM (
    SELECT *, list_transform(good1, lambda x: CASE WHEN x[1] <= 0.1::DOUBLE THEN x ELSE [0.1::DOUBLE, x[2] * 0.9::DOUBLE / (1 - x[1]), x[3] * 0.9::DOUBLE / (1 - x[1])] END) AS good2
    FROM (
      SELECT r, {_smoothed('p[i]', 0.5)} AS good1, {_smoothed('(1 - p[i])', 1.0)} AS bad1,
        least(0.98::DOUBLE, greatest(0.5::DOUBLE, list_sum(list_transform(range(1, len(pats) + 1), lambda i: pats[i].n * p[i])) / list_sum(list_transform(pats, lambda x: x.n)))) AS prior1
      FROM (
        SELECT r, pats, list_transform(pats, lambda x: 1 / (1 + exp(least(700, ln(1 - prior) + {_ODDS.format(m='bad', v='x.v')} - ln(prior) - {_ODDS.format(m='good', v='x.v')})))) AS p
        FROM model, patterns WHERE r < 50))))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior
FROM (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1 / (1 + exp(ln(1 - prior) + {_ODDS.format(m='bad', v='v')} - ln(prior) - {_ODDS.format(m='good', v='v')})) AS p
  FROM voted, model WHERE r = 50)
"""
