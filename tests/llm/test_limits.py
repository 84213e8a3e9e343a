"""Hot keys, limits and memory, and the results by value that the plainer tests leave open."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import AWKWARD, DATA, SCHEMA, bag

from corpuslens.llm import jaccard_join, language_id, mixing, packing, pii, vector_search


def near_copies(rng, n, others):
    """Copies of one text of 120 words with two words changed, and templated short texts of 5 to 39 words."""
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for _ in range(n):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append(" ".join(words))
    shared = [f"t{i}" for i in range(40)]
    for _ in range(others):
        size = rng.randrange(5, 40)
        rows.append(" ".join(w if rng.random() > 0.03 else f"y{rng.randrange(9)}" for w in shared[:size]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("parts", [1, 6])
def test_near_copies_of_a_hot_text(spark, parts):
    rows = near_copies(random.Random(parts), 300, 250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert found == {d: tuple(x[:2]) for (d, _), x in zip(rows, brute.classes(rows))}


def test_a_hot_key_is_settled_in_its_chunk():
    """What goes to the bucket of a key is the key, or 24 sets of a chunk at most; its members go to buckets all over, whole."""
    rows = near_copies(random.Random(3), 900, 300)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["text"])
    members, keyed, by_bucket = Counter(), Counter(), Counter()
    for out in jaccard_join._emit_keys([batch], 5, 16, np.empty(0, np.uint64), 24):
        for bucket, keys, names, _, counts, large in zip(*(out.column(i).to_pylist() for i in range(6))):
            by_bucket[bucket] += len(keys) // 8
            if counts is None:
                assert len(keys) == len(names)
                members.update(np.frombuffer(keys, np.uint64).tolist())
            else:
                keyed.update(np.frombuffer(keys, np.uint64).tolist())
                assert not set(np.frombuffer(large, np.uint64).tolist()) & set(keyed)
    expected = Counter()
    for shingles in {jaccard_join.class_of(x): x for x in jaccard_join.shingle_sets(batch.column(0), 5)}.values():
        expected.update(set(jaccard_join.join_keys(shingles, np.empty(0, np.uint64))[0].tolist()))
    assert max(expected.values()) > 400 and max(keyed.values()) <= 24 < min(members.values())
    assert members + keyed == expected
    assert max(by_bucket.values()) <= 5 * sorted(by_bucket.values())[len(by_bucket) // 2]


def test_as_many_languages_as_promised(spark):
    rng = random.Random(4)
    words = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(4)) for _ in range(1000)]
    rows = [(i, words[i % 1000], f"l{i % 1000:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = language_id.fit_language_model(df)
    assert set(model.languages) == {f"l{i:04d}" for i in range(1000)}
    found = language_id.predict_language(df.limit(200), model).join(df, "doc_id").filter("lang_pred = lang").count()
    assert found > 150
    with pytest.raises(ValueError, match="more than 1000 values"):
        language_id.fit_language_model(df.withColumn("lang", F.when(F.col("doc_id") == 0, "another").otherwise(F.col("lang"))))


def test_sample_of_many_values_is_bounded(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "id % 40 AS kind", "cast(id as string) AS value")
    sizes = {r["kind"]: r["count"] for r in language_id.bounded_sample(df, "kind", 50, most_rows=800).groupBy("kind").count().collect()}
    assert 500 < sum(sizes.values()) < 1100
    assert language_id.bounded_sample(df, "kind", 100).count() == 4000


@pytest.mark.parametrize("width", [1, 2, 61, 64, 127])
def test_recall_at_any_width(spark, width):
    """Isotropic vectors, the hardest: nine of ten neighbours are found, whatever divides the width."""
    x = np.random.default_rng(width).normal(size=(4000, width))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, v array<double>")
    found = vector_search.search(df, df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")).toPandas()
    hits = []
    for query, group in found.groupby("query_id"):
        apart = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
        assert np.allclose(np.sort(group["score"]), np.sort(apart[group["vec_id"]]), rtol=1e-12)
        apart[query] = np.inf
        hits.append(len(set(np.argsort(apart)[:10].tolist()) & set(group["vec_id"])) / 10)
    assert len(hits) == 40 and np.mean(hits) >= 0.9


def test_fitting_takes_bounded_memory():
    """Probes and candidates are measured slice by slice: at 4096 lists far below what all distances would take at once."""
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(32_768, 16))
    quantizer = vector_search.Quantizer(sample[:4096].copy(), rng.normal(size=(16, 256, 1)))
    tracemalloc.start()
    probes = vector_search.probes_for(sample, quantizer.coarse, 10, 0.96, asked=256)
    candidates = vector_search.rerank_for(sample, quantizer, 10, 0.99, asked=64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1 < probes <= 4096 and 10 <= candidates <= 32_768 and peak < 250_000_000


def test_pieces_go_to_the_cheapest_sequence_with_room():
    """Descending, to the lowest cost of those that have room for all; a piece that fits nowhere is cut at the cheapest with any."""
    rng = random.Random(1)
    for _ in range(60):
        capacity, sequences = rng.choice([8, 50]), rng.randrange(1, 9)
        lengths = [rng.randrange(1, capacity) for _ in range(rng.randrange(1, 30))]
        window = packing.Window(capacity, 1.0, 1 / 50)
        room, cost, expected = [capacity] * sequences, [0.0] * sequences, []
        for size, i in sorted(((-n, i) for i, n in enumerate(lengths))):
            start, left = 0, -size
            while left and any(room):
                to = min((q for q in range(sequences) if room[q] >= left), key=lambda q: (cost[q], q), default=None)
                to = min((q for q in range(sequences) if room[q]), key=lambda q: (cost[q], q)) if to is None else to
                n = min(left, room[to])
                expected.append((i, start, n, to, capacity - room[to]))
                room[to] -= n
                cost[to] += n + n * n / 50
                start, left = start + n, left - n
        found, sums = window.assign(lengths, sequences)
        assert found == expected and np.allclose(sums, cost)


def test_sequences_are_nearly_full(spark):
    """The padding of a task is less than one sequence; it lies in the last window, where sequences of equal cost may share it."""
    df = spark.read.parquet(f"{DATA}/documents.parquet").repartition(2)
    rows = packing.pack_documents(df, window_sequences=16).collect()
    tokens, by_sequence = sum(r["length"] for r in rows), defaultdict(int)
    for r in rows:
        by_sequence[r["sequence_id"]] += r["length"]
    assert len(by_sequence) <= math.ceil(tokens / 2048) + 2
    by_task = defaultdict(list)
    for q, n in by_sequence.items():
        by_task[q >> 36].append(n)
    assert all(2048 * len(sizes) - sum(sizes) < 2048 for sizes in by_task.values()) and len(by_task) == 2


def test_documents_of_the_mix(spark):
    """Each row as often as its source's target asks for, the last one drawn whole or not at all."""
    awkward = spark.createDataFrame([(*r, *("own" for _ in range(SCHEMA.count(",") - 3))) for r in AWKWARD], SCHEMA)
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    for df in (awkward, real, real.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        expected = bag(r for r, n in zip(rows, brute.repeated(rows)) for _ in range(n))
        mixed = mixing.mix_sources(df)
        assert mixed.columns == df.columns and bag(mixed.select("doc_id", "text", "source").collect()) == expected


def test_masked_texts_are_counted_anew(spark):
    text = "write to a.b@c.de or call +49 (30) 1234567 now"
    rows = [(1, text, len(text)), (2, "nothing here", 99), (3, None, 7)]
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask_pii(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    masked = pii.masked(text, pii.find_spans(text))
    assert found == {1: (masked, len(masked)), 2: ("nothing here", 12), 3: (None, None)} and len(masked) != len(text)


def test_scores_by_value():
    """What a pattern is worth, what its checksum adds, what a word nearby adds or takes."""
    score = lambda text: next(x[3] for x in pii.find_spans(text, 0.0) if x[0] == "iban")
    number = "DE89370400440532013000"
    base = pii.PATTERN_SCORE["iban"] + pii.CHECKSUM_BONUS
    near, against = next(iter(pii.CONTEXT["iban"])), next(iter(pii.COUNTER_CONTEXT))
    clipped = lambda x: round(min(1.0, max(0.0, x)), 4)
    assert score(number) == clipped(base)
    assert score(f"{near} {number}") == score(f"{number} {near}") == clipped(base + pii.CONTEXT_BONUS)
    assert score(f"{against} {number}") == clipped(base - pii.COUNTER_MALUS) and score(f"{number} {against}") == clipped(base)
    assert score(f"{near} {'x ' * 30}{number}") == clipped(base)


def test_keys_of_many_buckets_take_few_bytes():
    """With very many buckets a set has one key in most of them, so that its name and size go with each key."""
    rng = random.Random(8)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(300)])], ["text"])
    sets = {jaccard_join.class_of(x): x for x in jaccard_join.shingle_sets(batch.column(0), 5)}
    n_keys = sum(len(jaccard_join.join_keys(x, np.empty(0, np.uint64))[0]) for x in sets.values())
    rows = list(jaccard_join._compact(jaccard_join._emit_keys([batch], 5, 4096, np.empty(0, np.uint64), 24), 4096))
    sent = sum(len(x or b"") for out in rows for i in range(1, 6) for x in out.column(i).to_pylist())
    n_rows = sum(out.num_rows for out in rows)
    assert sent - 2 * n_rows <= 14 * n_keys  # 24 bytes a key with whole names, keys and numbers
    found = [x for out in jaccard_join._propose(iter(rows), 4096, 24) for x in out.to_pylist()]
    assert not [x for x in found if x["a"] == x["b"]]


@pytest.mark.parametrize("small_group", [2, 24])
def test_pairs_that_share_a_passage_alone_are_not_compared(spark, monkeypatch, small_group):
    """Of pairs with a key in common those go on that share more keys than the smaller set has spare ones."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = words(60), words(400)
    texts = [passage + words(340) for _ in range(12)] + [base, base[:380] + words(20), base[20:] + words(15)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    kept, stored = {}, jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label: kept.setdefault(label, stored(df, label)) if label in ("pairs", "proposed") else stored(df, label))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, small_group=small_group).collect()}
    assert found == {d: tuple(x[:2]) for (d, _), x in zip(rows, brute.classes(rows))}
    if small_group == 24:
        assert kept["proposed"].filter("key is null").select("a", "b").distinct().count() > 50 >= 10 > kept["pairs"].count()


def test_recall_where_the_sample_is_thin(spark):
    """Wide vectors that form no groups, many more than the sample has: its own rows are coded better than others, and fewer lie
    before a true neighbour among them."""
    x = np.random.default_rng(1).normal(size=(5000, 192))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, v array<double>").repartition(4)
    queries = df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = {(r["query_id"], r["vec_id"]) for r in vector_search.search(df, queries, sample_rows=512, lists=16).collect()}
    hits = 0
    for q in range(0, len(x), 50):
        apart = ((x - x[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        hits += sum((q, int(i)) in found for i in np.argsort(apart, kind="stable")[:10])
    assert hits >= 900  # of 1000
