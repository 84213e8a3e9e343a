"""Regression designs: difference in differences, interrupted time series, Poisson.

The rows are met by aggregates alone: a least-squares fit takes one for the sums of products and one for what is left, a Poisson fit one a
round.  What reaches the driver is a matrix of the design's few columns, whatever the number of rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.clean import cut_lineage


@dataclass(frozen=True)
class TestResult:
    name: str
    summary: dict[str, float | int | bool | None]
    text: str
    significant: bool


@dataclass(frozen=True)
class Fit:
    """Of a constant and the features, in that order: coefficients, standard errors and p-values (None where there are none)."""

    coefficients: list[float]
    errors: list[float | None]
    p_values: list[float | None]
    n: int
    rank: int


def _result(name: str, summary: dict, p: float | None) -> TestResult:
    lines = [f"{k} = {v:.4f}" if isinstance(v, float) else f"{k} = {v}" for k, v in summary.items()]
    return TestResult(name, summary, "\n".join([name, *lines]), p is not None and p < 0.05)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    c, value = 1.0, d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, freedom: int) -> float:
    """The chance of a t-distributed number at least as far from 0."""
    return beta_share(freedom / (freedom + t * t), freedom / 2, 0.5)


def _numbers(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Complete rows of these columns, as doubles."""
    return df.select(*[c.cast("double").alias(n) for n, c in columns.items()]).dropna()


def _design(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f) for f in features]]


def _products(x: list[Column], y: Column, weight: Column | None = None) -> list[Column]:
    """Sums of products of each two columns, and of each with ``y``."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [F.sum(w * a * b).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j <= i]
    return [*pairs, *[F.sum(w * a * y).alias(f"r{i}") for i, a in enumerate(x)]]


def _matrix(row, size: int) -> tuple[np.ndarray, np.ndarray]:
    gram = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)], float)
    return gram, np.array([row[f"r{i}"] for i in range(size)], float)


#: Eigenvalues of the scaled products below this share of the largest one count as zero.
_TOLERANCE = 1e-11


def pseudo_inverse(gram: np.ndarray) -> tuple[np.ndarray, int]:
    """Inverse and rank of a matrix of products; of a singular one the inverse that gives the shortest solution."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1))
    values = np.linalg.eigvalsh(gram / np.outer(scale, scale))
    rank = int((values > _TOLERANCE * max(values.max(), 0)).sum())
    if rank == len(gram):
        return np.linalg.inv(gram / np.outer(scale, scale)) / np.outer(scale, scale), rank
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    return (vectors / values) @ vectors.T, rank


def least_squares(df: DataFrame, outcome: Column, features: dict[str, Column]) -> tuple[Fit, float | None]:
    """The fit and R squared.  Of collinear features the shortest coefficients are given, with p-values on n minus rank degrees of freedom;
    where none is left there are no p-values."""
    names = [f"_x{i}" for i in range(len(features))]
    rows = _numbers(df, dict(zip(names, features.values())) | {"_y": outcome})
    x, y = _design(names), F.col("_y")
    row = rows.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), *_products(x, y)).head()
    if not row["n"]:
        raise ValueError("no complete rows")
    gram, right = _matrix(row, len(x))
    inverse, rank = pseudo_inverse(gram)
    beta = inverse @ right
    fitted = sum((float(b) * a for b, a in zip(beta[1:], x[1:])), F.lit(float(beta[0])))
    left = rows.agg(F.sum((y - fitted) * (y - fitted)).alias("left"), F.sum((y - F.lit(row["mean"])) * (y - F.lit(row["mean"]))).alias("all")).head()
    freedom = row["n"] - rank
    errors = [math.sqrt(max(v, 0) * left["left"] / freedom) if freedom > 0 else None for v in np.diag(inverse)]
    p = [None if e is None else t_two_sided(b / e, freedom) if e > 0 else 0.0 if b else 1.0 for b, e in zip(beta.tolist(), errors)]
    return Fit(beta.tolist(), errors, p, row["n"], rank), 1 - left["left"] / left["all"] if left["all"] > 0 else None


def run_did(df: DataFrame, outcome: str, treat: str, post: str) -> TestResult:
    treated, after = F.col(treat).cast("double"), F.col(post).cast("double")
    fit, r_squared = least_squares(df, F.col(outcome), {"t": treated, "p": after, "tp": treated * after})
    summary = {"coefficient": fit.coefficients[3], "p_value": fit.p_values[3], "r_squared": r_squared, "n": fit.n, "rank": fit.rank}
    return _result("Difference-in-Differences", summary, fit.p_values[3])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a row's place in the order, from 0: ranges of the order are counted on their own and know how many rows lie before them."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # a row a range
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    starts = F.array(*[F.lit(x).cast("long") for x in before or [0]])
    return ranged.withColumn(name, F.get(starts, F.col("_range")) + place).drop("_range")


def run_its(df: DataFrame, outcome: str, time: str, intervention: str) -> TestResult:
    """Rows are numbered by time (ties by outcome)."""
    rows = numbered(df.select(F.col(outcome).alias("y"), F.col(time).alias("at"), F.col(intervention).cast("double").alias("x")), ["at", "y"], "i")
    fit, r_squared = least_squares(rows, F.col("y"), {"i": F.col("i"), "x": F.col("x"), "ix": F.col("i") * F.col("x")})
    (_, _, level, slope), (_, _, level_p, slope_p) = fit.coefficients, fit.p_values
    summary = {"level_change": level, "level_p": level_p, "slope_change": slope, "slope_p": slope_p, "r_squared": r_squared, "n": fit.n, "rank": fit.rank}
    return _result("Interrupted Time Series", summary, level_p)


def _log_factorial(y: Column) -> Column:
    """log(y!) of numbers from 0 on, by Stirling's series seven steps further."""
    z = y + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    steps = F.lit(1.0)
    for i in range(1, 8):
        steps = steps * (y + i)
    return series - F.log(steps)


#: Rounds of a Poisson fit at most, halvings of a step, the share by which the deviance changes in the last round, and the share of the
#: mean outcome below which a fitted one counts as zero.
_ROUNDS, _HALVINGS, _CLOSE, _NOTHING = 100, 12, 1e-10, 1e-7


def run_ppml(df: DataFrame, outcome: str, features: list[str]) -> TestResult:
    """Poisson pseudo-maximum likelihood by iteratively reweighted least squares: one aggregate a round, steps halved where the deviance
    grows.  Where some feature tells apart rows whose outcome is 0 without exception, its coefficient has no finite estimate:
    ``separated`` says so, and there are no p-values."""
    names = [f"_x{i}" for i in range(len(features))]
    rows = _numbers(df, dict(zip(names, map(F.col, features))) | {"_y": F.col(outcome)})
    x, y = _design(names), F.col("_y")
    start = rows.agg(F.count("*").alias("n"), F.avg(y).alias("mean")).head()
    if not start["n"] or start["mean"] <= 0:
        raise ValueError("the outcome is nowhere above 0")

    def around(eta: Column):
        """Products for the next step, the deviance and the least fitted outcome at a linear predictor."""
        mu = F.exp(eta)
        deviance = 2 * F.sum(F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))
        return rows.agg(*_products(x, eta + (y - mu) / mu, mu), deviance.alias("deviance"), F.min(mu).alias("least"), F.sum(y * eta - mu - _log_factorial(y)).alias("likelihood")).head()

    def predictor(beta: np.ndarray) -> Column:
        return sum((float(b) * a for b, a in zip(beta[1:], x[1:])), F.lit(float(beta[0])))

    state, beta, deviance = around(F.log((y + start["mean"]) / 2)), None, math.inf
    for _ in range(_ROUNDS):
        gram, right = _matrix(state, len(x))
        inverse, rank = pseudo_inverse(gram)
        wanted = inverse @ right
        for halved in range(_HALVINGS + 1):
            tried = wanted if beta is None or not halved else beta + (wanted - beta) / 2**halved
            state = around(predictor(tried))
            if beta is None or state["deviance"] <= deviance * (1 + _CLOSE) + _CLOSE:
                break
        done = abs(deviance - state["deviance"]) <= _CLOSE * (abs(state["deviance"]) + 0.1)
        beta, deviance = tried, state["deviance"]
        if done:
            break
    gram, _ = _matrix(state, len(x))
    inverse, rank = pseudo_inverse(gram)
    separated = state["least"] < _NOTHING * start["mean"]
    errors = [math.sqrt(max(v, 0)) for v in np.diag(inverse)]
    p = [None if separated else math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else 1.0 for b, e in zip(beta.tolist(), errors)]
    summary = {f: float(b) for f, b in zip(features, beta[1:])} | {f"p_{f}": v for f, v in zip(features, p[1:])}
    summary |= {"intercept": float(beta[0]), "p_intercept": p[0], "aic": -2 * state["likelihood"] + 2 * rank, "n": start["n"], "separated": separated}
    return _result("PPML", summary, p[1] if features else None)
