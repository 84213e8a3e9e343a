"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Every usable row is indexed: it goes to the list of its nearest coarse centroid, and what is left of it is coded by one
byte for each slice of the vector.  A query looks through the lists nearest to it, with a table of distances from its own
(unquantised) residual to all code words; the best by these sums are ranked anew by exact distance in double precision.

The number of lists grows with the square root of the rows.  How many lists a query looks through is measured: the
true neighbours of some rows of the sample, and of some queries among all rows, are looked up in the lists nearest to
these, and as many are probed as hold the recall asked for.  Vectors that form clusters need few, isotropic ones most.
How many candidates are ranked anew is measured so as well: the sample is thinner than the rows, so in a group of
near copies many more lie before a true neighbour than it shows.

Lists are cut into blocks of bounded size, so that a list with a third of all rows is many blocks; each block passes on
a bounded number of candidates per query before anything is shuffled by query.  Queries are dealt by their nearest
list to chunks of bounded size: a task meets one block of rows with one chunk of queries that probe it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm._common import ship, stored, table


#: Rows that are compared with all centroids at once: 32 MB of distances to the 4096 lists that there are at most.
_SLICE = 1024


def kmeans(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(rows[order], first, axis=0)
        centres[found] = sums / np.diff(np.append(first, len(rows)))[:, None]
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None]


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(squared(rows[i : i + _SLICE], centres), axis=1) for i in range(0, len(rows), _SLICE)])


@dataclass
class Quantizer:
    coarse: np.ndarray  # (lists, width)
    words: np.ndarray  # (slices, words, width of a slice)

    @property
    def width(self) -> int:
        return self.coarse.shape[1]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(rows, self.coarse)
        rest = rows - self.coarse[lists]
        step = self.words.shape[2]
        codes = [nearest(rest[:, i * step : (i + 1) * step], w) for i, w in enumerate(self.words)]
        return lists, np.stack(codes, axis=1).astype(np.uint8)

    def constants(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The part of a row's squared distance that doesn't depend on the query: 2 c.w + w.w over the slices."""
        step, out = self.words.shape[2], np.zeros(len(lists))
        for i, words in enumerate(self.words):
            w = words[codes[:, i]]
            out += ((2 * self.coarse[lists, i * step : (i + 1) * step] + w) * w).sum(axis=1)
        return out

    def table(self, query: np.ndarray) -> np.ndarray:
        """The part that does: -2 q.w for every slice and code word.  With the squared distance from the query to the
        list's centroid and the row's constant it sums up to the distance to the row as coded."""
        parts = query.reshape(self.words.shape[0], -1)
        return -2 * np.einsum("swd,sd->sw", self.words, parts)


def fit_quantizer(sample: np.ndarray, lists: int, slices: int, words: int = 256, seed: int = 10) -> Quantizer:
    coarse = kmeans(sample, lists, 12, seed)
    rest = sample - coarse[nearest(sample, coarse)]
    step = sample.shape[1] // slices
    return Quantizer(coarse, np.stack([_padded(kmeans(rest[:, i * step : (i + 1) * step], words, 8, seed + i), words) for i in range(slices)]))


def probes_for(sample: np.ndarray, coarse: np.ndarray, k: int, recall: float, asked: int = 512, seed: int = 10) -> int:
    """Lists to probe so that a share ``recall`` of the ``k`` nearest rows of the sample lies in them, measured on ``asked`` rows
    of the sample, each without itself."""
    own, near = _asked(sample, k, asked, seed)
    if not near.shape[1]:
        return 1
    lists, at = nearest(sample, coarse), []
    for i in range(0, len(own), _FEW):
        rank = np.argsort(np.argsort(squared(sample[own[i : i + _FEW]], coarse), axis=1, kind="stable"), axis=1, kind="stable")
        at.append(np.take_along_axis(rank, lists[near[i : i + _FEW]], axis=1).ravel())
    return int(_at_share(np.concatenate(at), recall)) + 1


#: Rows that are compared with the whole sample at once.
_FEW = 32


def _asked(sample: np.ndarray, k: int, asked: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Some rows of the sample, and for each the places of its ``k`` nearest others."""
    rng = np.random.default_rng(seed)
    own, k = rng.choice(len(sample), min(asked, len(sample)), replace=False), min(k, len(sample) - 1)
    near = [np.empty((0, max(k, 0)), np.int64)]
    for i in range(0, len(own) if k > 0 else 0, _FEW):
        apart = squared(sample[own[i : i + _FEW]], sample)
        apart[np.arange(len(apart)), own[i : i + _FEW]] = np.inf
        near.append(np.argpartition(apart, k - 1, axis=1)[:, :k])
    return own, np.concatenate(near)


def _at_share(places: np.ndarray, share: float) -> int:
    """The place at or before which so large a share of ``places`` lies."""
    at = np.sort(places)
    return at[min(len(at) - 1, int(np.ceil(share * len(at))) - 1)]


def rerank_for(sample: np.ndarray, quantizer: Quantizer, k: int, recall: float, asked: int = 256, seed: int = 10) -> int:
    """Candidates to rank anew so that a share ``recall`` of the ``k`` nearest rows of the sample is among them by their estimated
    distance, measured on ``asked`` rows of the sample: what quantisation costs is made good by exact distances."""
    own, near = _asked(sample, k, asked, seed)
    if not near.shape[1]:
        return 1
    lists, codes = quantizer.encode(sample)
    constant = quantizer.constants(lists, codes)
    flat = codes + np.arange(codes.shape[1], dtype=np.int64) * quantizer.words.shape[1]
    places = []
    for row, others in zip(own, near):
        query, estimate = sample[row], constant.copy()
        of_list = ((query - quantizer.coarse) ** 2).sum(axis=1)
        table = quantizer.table(query).ravel()
        for i in range(0, len(sample), 1 << 14):
            estimate[i : i + (1 << 14)] += of_list[lists[i : i + (1 << 14)]] + table[flat[i : i + (1 << 14)]].sum(axis=1)
        estimate[row] = np.inf
        places.append(np.searchsorted(np.sort(estimate), estimate[others]))
    return int(_at_share(np.concatenate(places), recall)) + 1


#: Queries whose true neighbours are looked up among all rows.
_MEASURED = 128


def _measured(rows: DataFrame, asked: DataFrame, index: DataFrame, quantizer: Quantizer, filled: np.ndarray, k: int, probes: int | None, least: int, recall: float) -> tuple[int, int]:
    """Lists to probe and candidates to rank anew, so that of the true neighbours of some queries among all rows a share
    ``recall`` lies in these lists, and nearly all of those among the candidates.  ``least`` lists are probed; with ``probes``
    their number is given."""
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(_MEASURED).toPandas()
    ids, queries = some["query_id"].to_numpy(np.int64), np.array(some["v"].tolist(), np.float64).reshape(len(some), -1)
    centre = quantizer.coarse.mean(axis=0)  # less is lost in differences of squares about it

    def brute(batches):
        apart, found = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            for low in range(0, len(own), _SLICE):
                here = own[low : low + _SLICE]
                new = squared(queries - centre, _matrix(batch.column(1).slice(low, _SLICE), quantizer.width) - centre)
                new[ids[:, None] == here[None]] = np.inf
                apart, found = np.hstack([apart, new]), np.hstack([found, np.broadcast_to(here, new.shape)])
                if apart.shape[1] > k:
                    best = np.argpartition(apart, k - 1, axis=1)[:, :k]
                    apart, found = np.take_along_axis(apart, best, axis=1), np.take_along_axis(found, best, axis=1)
        i, j = np.nonzero(np.isfinite(apart))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(found[i, j]), pa.array(apart[i, j])], ["i", "vec_id", "apart"])

    place = F.row_number().over(Window.partitionBy("i").orderBy("apart", "vec_id"))
    true = rows.select("vec_id", "v").mapInArrow(brute, "i int, vec_id long, apart double").withColumn("place", place).filter(F.col("place") <= k)
    true = F.broadcast(true.select("i", "vec_id")).join(index, "vec_id").toPandas()
    if not len(true):
        return max(least, probes or 1), 1
    of, lists = true["i"].to_numpy(), true["list"].to_numpy()
    apart = np.concatenate([squared(queries[i : i + _FEW], quantizer.coarse[filled]) for i in range(0, len(queries), _FEW)])
    rank = np.argsort(np.argsort(apart, axis=1, kind="stable"), axis=1, kind="stable")
    at = rank[of, np.searchsorted(filled, lists)]
    probes = probes or max(least, int(_at_share(at, recall)) + 1)
    codes = np.frombuffer(b"".join(true["codes"]), np.uint8).reshape(len(true), -1).astype(np.int64)
    step = np.arange(codes.shape[1]) * quantizer.words.shape[1]
    base = np.full((len(queries), len(quantizer.coarse)), np.inf)
    for i, query in enumerate(queries):
        near = filled[rank[i] < probes]
        base[i, near] = ((query - quantizer.coarse[near]) ** 2).sum(axis=1)
    inside = np.flatnonzero(at < probes)
    estimate = np.array([base[of[t], lists[t]] + true["constant"][t] + quantizer.table(queries[of[t]]).ravel()[codes[t] + step].sum() for t in inside])
    # Sums of the same numbers may differ in their last bits by the way they are added up.
    estimate += 1e-12 * (np.abs(estimate) + np.abs(true["constant"].to_numpy()[inside]))

    def before(batches):
        n = np.zeros(len(inside), np.int64)
        for batch in batches:
            lists, constant = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), -1) + step
            for i in np.unique(of[inside]).tolist():
                here = np.flatnonzero(np.isfinite(base[i, lists]))
                sums = np.sort(base[i, lists[here]] + constant[here] + quantizer.table(queries[i]).ravel()[flat[here]].sum(axis=1))
                mine = np.flatnonzero(of[inside] == i)
                n[mine] += np.searchsorted(sums, estimate[mine], side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["t", "n"])

    counts = index.select("vec_id", "list", "codes", "constant").mapInArrow(before, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    return probes, int(_at_share(counts["n"].to_numpy(), 1 - (1 - recall) / 4)) if len(counts) else 1


def _padded(words: np.ndarray, n: int) -> np.ndarray:
    return words if len(words) == n else np.vstack([words, np.repeat(words[:1], n - len(words), axis=0)])


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, not all zero, and holds finite components alone."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def build_index(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """(vec_id, list, codes, constant) of every row of ``vectors`` (vec_id, v)."""

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column(1), quantizer.width)
            if len(rows):
                lists, codes = quantizer.encode(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes]),
                     pa.array(quantizer.constants(lists, codes))],
                    ["vec_id", "list", "codes", "constant"],
                )

    return vectors.mapInArrow(run, "vec_id long, list int, codes binary, constant double")


def plan_blocks(sizes: dict[int, int], block_rows: int) -> tuple[dict[int, list[int]], int]:
    """For each list the blocks that hold it: small lists share a block, one that is larger than a block is cut."""
    out, block, used = {}, 0, 0
    for at in sorted(sizes):
        if sizes[at] > block_rows:
            parts = -(-sizes[at] // block_rows)
            if used:
                block, used = block + 1, 0
            out[at] = list(range(block, block + parts))
            block += parts
            continue
        if used and used + sizes[at] > block_rows:
            block, used = block + 1, 0
        out[at] = [block]
        used += sizes[at]
    return out, block + bool(used)


def _search_block(index: pa.Table, queries: pa.Table, quantizer: Quantizer, keep: int) -> pa.Table:
    ids = index["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    lists = index["list"].to_numpy()[order]
    slices = quantizer.words.shape[0]
    codes = np.frombuffer(b"".join(index["codes"].to_pylist()), np.uint8).reshape(-1, slices)[order].astype(np.int64)
    constant = index["constant"].to_numpy()[order]
    flat = codes + np.arange(slices) * quantizer.words.shape[1]
    found = ([], [], [])
    for query_id, vector, probes in zip(*(queries[c].to_pylist() for c in ("query_id", "v", "probes"))):
        query = np.asarray(vector, np.float64)
        base = np.full(len(quantizer.coarse), np.inf)
        base[probes] = ((query - quantizer.coarse[probes]) ** 2).sum(axis=1)
        rows = np.flatnonzero(np.isfinite(base[lists]) & (ids != query_id))
        sums = base[lists[rows]] + constant[rows] + quantizer.table(query).ravel()[flat[rows]].sum(axis=1)
        if len(sums) > keep:  # the sums up to the keep-th smallest, ties included
            few = np.flatnonzero(sums <= np.partition(sums, keep - 1)[keep - 1])
            rows, sums = rows[few], sums[few]
        best = np.argsort(sums, kind="stable")[:keep]  # ids ascend: of equal sums the smaller ids are kept
        found[0].append(np.full(len(best), query_id))
        found[1].append(ids[rows[best]])
        found[2].append(sums[best])
    return pa.table(
        [pa.array(np.concatenate([*x, np.empty(0, t)]).astype(t)) for x, t in zip(found, (np.int64, np.int64, np.float64))],
        ["query_id", "vec_id", "estimate"],
    )


#: Bytes of the sample that is brought to the driver, and of the queries that are broadcast, at most.
_SAMPLE_BYTES, _BROADCAST_BYTES = 64 << 20, 32 << 20


def _once(rows: DataFrame, key: str) -> DataFrame:
    """One row for each id, the one of the smallest vector; where no id repeats, nothing but ids is shuffled."""
    if rows.groupBy(key).count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy(key).agg(F.min("v").alias("v"))


#: Bytes that code a vector of that many numbers or more.
_SLICES = 16


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None, rerank: int = 200,
    recall: float = 0.96, sample_rows: int = 16384, most_lists: int = 4096, block_rows: int = 16384, chunk_queries: int = 16384,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, v) to each of ``queries`` (query_id, v): query_id, rank, vec_id, score.

    The quantizer is fitted on a sample of about ``sample_rows`` rows, or 32 for each list, and 64 MB at most; every usable
    row is indexed.  Without other numbers there are as many ``lists`` as the square root of the rows, ``most_lists`` at most,
    and ``probes`` is measured on the sample, for ``recall``.  A query looks through its nearest lists
    and as many more as hold ``rerank`` rows, so that it gets all candidates where there are fewer than ``k``; ``rerank``
    is four times ``k`` at least, and more where as many candidates are needed, on the sample or for some queries among all
    rows, for a share of 1 - (1 - ``recall``) / 4 of the neighbours.  Vectors are filled with zeros to a multiple of 16 numbers, which changes no distance.  A task holds about ``block_rows`` codes and ``chunk_queries`` queries.

    Vectors null, zero, or with null or non-finite components take no part, neither do null ids; a query's own id isn't a
    candidate; of repeated ids the smallest vector counts, once.  Vectors of another length have no distance: each
    length is searched on its own.  Ties go to the smaller id.  Other columns are ignored; an empty table gives no rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")), "v").filter("vec_id is not null")
    asked = usable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v")), "v").filter("query_id is not null")
    rows, asked = _once(rows, "vec_id"), _once(asked, "query_id")
    widths = [{r["width"]: r["count"] for r in x.groupBy(F.size("v").alias("width")).count().collect()} for x in (rows, asked)]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in sorted(set(widths[0]) & set(widths[1])):
        own = F.size("v") == width
        found = _search_width(rows.filter(own), asked.filter(own), width, widths[0][width], widths[1][width], k, lists, probes, max(rerank, 4 * k), recall, sample_rows, most_lists, block_rows, chunk_queries)
        out = found if len(widths[0]) == 1 else out.unionByName(found)
    return out


def _search_width(rows, asked, width, total, n_asked, k, lists, probes, rerank, recall, sample_rows, most_lists, block_rows, chunk_queries) -> DataFrame:
    if width > _SLICES and width % _SLICES:
        fill = F.array_repeat(F.lit(0.0), _SLICES - width % _SLICES)
        rows, asked = (x.withColumn("v", F.concat("v", fill)) for x in (rows, asked))
        width += _SLICES - width % _SLICES
    lists = lists or max(16, min(most_lists, round(total**0.5)))
    sample_rows = min(max(sample_rows, 32 * lists), max(1024, _SAMPLE_BYTES // (4 * width)))
    sample = rows.filter(F.rand(10) < min(1.0, sample_rows / total)).select(F.col("v").cast("array<float>").alias("v")).toPandas()
    fitted = np.array(sample["v"].tolist(), np.float64)
    if not len(fitted):
        fitted = np.array(rows.limit(1).toPandas()["v"].tolist(), np.float64)
    quantizer = fit_quantizer(fitted, lists, min(_SLICES, width))
    least = probes or probes_for(fitted, quantizer.coarse, k, recall)
    rerank = max(rerank, rerank_for(fitted, quantizer, k, 1 - (1 - recall) / 4))
    index = stored(build_index(rows, quantizer), "vector-index")
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    blocks, _ = plan_blocks(sizes, block_rows)
    filled = np.array(sorted(sizes))
    counts = np.array([sizes[i] for i in filled])
    probes, places = _measured(rows, asked, index, quantizer, filled, k, probes, least, recall)
    rerank = max(rerank, places)

    def place(batches):
        for batch in batches:
            near = nearest(_matrix(batch.column(1), width), quantizer.coarse) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["query_id", "v", "near"])

    def choose(batches):
        for batch in batches:
            yield from (chosen for low in range(0, batch.num_rows, _SLICE) for chosen in choose_lists(batch.slice(low, _SLICE)))

    def choose_lists(batch):
        own, distances = _matrix(batch.column(1), width), quantizer.coarse[filled]
        for low in range(0, len(own), _FEW * 4):
            order = np.argsort(squared(own[low : low + _FEW * 4], distances), axis=1, kind="stable")
            out = ([], [], [], [], [])
            ids, numbers = (batch.column(c).slice(low, _FEW * 4).to_pylist() for c in (0, 2))
            for i, (query_id, chunk, near) in enumerate(zip(ids, numbers, order), low):
                enough = int(np.searchsorted(np.cumsum(counts[near]), rerank + 1)) + 1
                chosen = filled[near[: max(probes, enough)]].tolist()
                of: dict[int, list[int]] = {}
                for at in chosen:
                    for block in blocks[at]:
                        of.setdefault(block, []).append(at)
                for block, probed in of.items():
                    for column, value in zip(out, (query_id, own[i].tolist(), block, probed, chunk)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32()), pa.int32()))],
                ["query_id", "v", "block", "probes", "chunk"],
            )

    def dealt(of: dict[int, list[int]], at: str, key: str):
        """The block (or chunk) of a row: those of its list by turns of its id's hash."""
        first = F.create_map(*[F.lit(x) for i, b in of.items() for x in (i, b[0])])
        parts = F.create_map(*[F.lit(x) for i, b in of.items() for x in (i, len(b))])
        return (first[F.col(at)] + F.pmod(F.xxhash64(key), parts[F.col(at)]).cast("int")).cast("int")

    asked = stored(asked.mapInArrow(place, "query_id long, v array<double>, near int"), "vector-queries")
    chunks, n_chunks = plan_blocks({r["near"]: r["count"] for r in asked.groupBy("near").count().collect()}, chunk_queries)
    sent = asked.select("query_id", "v", dealt(chunks, "near", "query_id").alias("chunk"))
    sent = sent.mapInArrow(choose, "query_id long, v array<double>, block int, probes array<int>, chunk int")
    placed = index.withColumn("block", dealt(blocks, "list", "vec_id"))
    # A block is copied for each chunk with a query that probes it, and for no other.
    if n_chunks == 1:
        placed = placed.withColumn("chunk", F.lit(0))
    else:
        placed = placed.join(stored(sent.select("block", "chunk").distinct(), "vector-blocks"), "block")
    found = placed.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(
        lambda a, b: _search_block(a, b, quantizer, rerank), "query_id long, vec_id long, estimate double"
    )
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("estimate", "vec_id"))
    kept = found.withColumn("place", best).filter(F.col("place") <= rerank).select("query_id", "vec_id")
    small = n_asked * width * 8 <= _BROADCAST_BYTES
    target = asked.select("query_id", F.col("v").alias("q"))
    pairs = kept.join(rows, "vec_id").join(F.broadcast(target) if small else target, "query_id")
    apart = F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id", F.sqrt(apart).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each row whose vec_id is divisible by 100, by ``search``: null ids and vectors that are null,
    zero or not finite take no part, of a repeated id the smallest vector counts, ties go to the smaller id, an empty table gives no rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"))
