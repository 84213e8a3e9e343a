"""Spelling variants, suffix-sorted deduplication and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import AWKWARD, DATA, ROWS, awkward, bag, nothing  # noqa: F401  the fixtures as well

from corpuslens.llm import periodic_runs, queries, spelling_variants, suffix_dedup
from corpuslens.llm.induced_sort import Buckets, Sorter


def suffixes(raw, cap, most, bound):
    text = np.concatenate([np.asarray(raw, np.uint8), np.zeros(1 + cap, np.uint8)])
    sorter, found = Sorter(cap, most, bound), []
    sorter.descending(text, 256, lambda pos, shared: found.extend(zip(pos.tolist(), shared.tolist())))
    return sorter, text.tobytes(), found


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_and_shared_lengths(seed):
    """Small alphabets, repeated texts, long runs of one character; tuples in pieces of any size, in memory and on disk."""
    rng = np.random.default_rng(seed)
    for trial in range(25):
        raw = rng.integers(1, 2 + int(rng.choice([0, 1, 3, 250])), int(rng.integers(0, 350)))
        raw = np.tile(raw[: len(raw) // 7 + 1], 7) if trial % 3 == 0 else raw
        cap = int(rng.choice([3, 8, 50]))
        sorter, text, found = suffixes(raw, cap, int(rng.choice([1, 5, 64, 1000])), int(rng.choice([1, 400, 1 << 20])))
        assert sorted(p for p, _ in found) == list(range(len(raw)))
        heads = [text[p : p + cap] for p, _ in found]
        assert heads == sorted(heads, reverse=True)
        for (a, b), (_, shared) in zip(zip(heads, heads[1:]), found[1:]):
            assert shared == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), cap)


def test_order_by_names_of_several_levels_on_disk():
    """A text whose substrings repeat is sorted by names, names of names, ...; waiting tuples go to disk; memory bounds don't change the order."""
    rng = random.Random(1)
    words = [bytes(rng.randrange(2, 6) for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    raw = list(b"\x01".join(b"".join(rng.choice(words) for _ in range(12)) for _ in range(400)))
    small, text, found = suffixes(raw, 50, 500, 4000)
    assert small.levels >= 3 and small.spilled > len(raw)
    large, _, same = suffixes(raw, 50, 1 << 18, 64 << 20)
    assert large.spilled == 0
    heads = [text[p : p + 50] for p, _ in found]
    assert heads == [text[p : p + 50] for p, _ in same] == sorted(heads, reverse=True)
    assert [n for _, n in found[1:]] == [n for _, n in same[1:]]


def test_buckets_keep_their_order_on_disk():
    for bound in (1, 100, 1 << 20):
        for backwards in (False, True):
            b = Buckets(2, bound)
            for i in range(30):
                x = np.arange(7 * i, 7 * i + 7)
                b.put(i % 2, x.astype("<u4"), (x + 1).astype("<u4"), (x % 200).astype("u1"))
            expected = [x for i in range(1, 30, 2) for x in range(7 * i, 7 * i + 7)]
            parts = list(b.take(1, 5, backwards))
            rank, pos, shared = (np.concatenate(x).tolist() for x in zip(*parts))
            assert rank == expected[:: -1 if backwards else 1] and pos == [x + 1 for x in rank] and shared == [x % 200 for x in rank]
            assert len(b.take_all(0)[0]) == 7 * 15 and not len(b.take_all(0)[0])


def as_rows(df):
    return bag((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in df.collect())


def expected_bytes(rows, window=50):
    return bag((d, n, r, s, hashlib.sha256(k).hexdigest(), k) for (d, _), (n, r, s, k) in zip(rows, brute.removed_bytes(rows, window)))


def test_repeated_bytes_on_awkward_rows(awkward, nothing):  # noqa: F811
    assert as_rows(suffix_dedup.remove_repeated_bytes(awkward)) == expected_bytes(ROWS)
    assert as_rows(suffix_dedup.remove_repeated_bytes(awkward, 21, most=50, bound=500)) == expected_bytes(ROWS, 21)
    found = suffix_dedup.remove_repeated_bytes(nothing)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"] and found.count() == 0
    with pytest.raises(ValueError, match="window"):
        suffix_dedup.remove_repeated_bytes(nothing, 20)


def test_repeated_bytes_of_mixed_texts(spark):
    """Passages that overlap, cross characters of several bytes, stand in one text twice, in texts in any order of doc_id; long runs."""
    rng = random.Random(3)
    letters = "abcdeé漢 \n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 160))) for _ in range(12)] + ["=" * 70, "ab" * 60]
    rows = []
    for i in rng.sample(range(-50, 250), 200):
        parts = [rng.choice(passages)[rng.randrange(4) :] if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(7))]
        rows.append((None if rng.random() < 0.05 else i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 7):
        assert as_rows(suffix_dedup.remove_repeated_bytes(df.repartition(n))) == expected_bytes(rows)


def test_repeated_bytes_of_a_hot_passage(spark):
    """A passage in chunks of more than 64 tasks: its hashes are hot, and windows of its differing ends are dealt one by one."""
    rng = random.Random(4)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 60)))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, noise() + passage + noise()) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(90, "doc_id")
    assert as_rows(suffix_dedup.remove_repeated_bytes(df)) == expected_bytes(rows)
    prints = suffix_dedup.keyed(df).select("doc", "none", "text").mapInArrow(lambda b: suffix_dedup._write_run(b, 50, 20, 4, suffix_dedup.ByteWindows), suffix_dedup._RUN)
    lists = prints.repartition(4, "bucket").mapInArrow(lambda b: suffix_dedup._merge_prints(b, 4), suffix_dedup._LISTS)
    hot = suffix_dedup._hot(lists)
    assert 1 <= len(hot) <= 90 and (np.diff(hot.astype(object)) > 0).all()


@pytest.mark.parametrize("most, bound, bits", [(1 << 18, 64 << 20, 25), (50, 500, 25), (50, 500, 3)])
def test_shards_sort_only_windows_that_may_repeat(monkeypatch, most, bound, bits):
    """Of stretches that have one passage in common only the passage is sorted; small memory and crowded tables change no result."""
    monkeypatch.setattr(suffix_dedup, "_MOST_BITS", bits, raising=False)
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1 << 20 if most > 50 else 700, raising=False)
    rng, sorted_bytes = random.Random(5), []
    noise = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage = noise(90)
    texts = [noise(80) + passage + noise(70) for _ in range(60)] + [noise(300) for _ in range(20)]
    texts += [texts[70], passage]  # an equal stretch, and one that has nothing but the passage
    docs = np.arange(len(texts))[::-1]  # the last row has the smallest doc_id
    shard = suffix_dedup.Shard(50, bound)
    for at in (slice(0, 50), slice(50, None)):
        size = np.array([len(x) for x in texts[at]], "<u4")
        packed = suffix_dedup._CODEC.compress(b"".join(texts[at]), asbytes=True)
        who = docs[at].astype(np.int64)
        shard.add(packed, size.tobytes(), np.zeros(len(size), "<u4").tobytes(), np.arange(len(size), dtype="<u4").tobytes(), who.tobytes(), np.zeros(len(size), bool).tobytes(), who.tobytes())
    descending = Sorter.descending
    monkeypatch.setattr(Sorter, "descending", lambda self, text, *x: (sorted_bytes.append(len(text)), descending(self, text, *x)))
    gone = {(int(d), (int(v) >> 32) + i) for found, _, values in shard.marked(most, bound) for d, v in zip(found, values) for i in range(int(v) & 0xFFFFFFFF)}
    first = {}
    for doc, text in sorted(zip(docs.tolist(), texts)):
        for i in range(len(text) - 49):
            first.setdefault(text[i : i + 50], doc)
    assert gone == {(doc, i) for doc, text in zip(docs.tolist(), texts) for i in range(len(text) - 49) if first[text[i : i + 50]] < doc}
    assert len(gone) >= 60 * 41 + 251
    if bits == 25:
        assert sum(sorted_bytes) < 0.5 * sum(map(len, texts)), "what the shard has once was sorted"


def test_shards_have_a_partition_each(spark):
    """Hashes of a few bucket numbers leave some partitions empty and put several shards into others."""
    df = spark.createDataFrame([(1, "a" * 60), (2, "a" * 60)], "doc_id long, text string")
    plan = suffix_dedup.remove_repeated_bytes(df)._jdf.queryExecution().toString()
    assert "hashpartitioning(bucket" not in plan and "bucket" in plan


def test_op12_removes_what_brute_force_does(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.queries()["op12_suffix_dedup"](spark, DATA)
    expected = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for (d, _), (n, r, s, k) in zip(rows, brute.removed_bytes(rows))]
    assert bag(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == bag(expected)


def expected_runs(doc_id, words):
    runs, kept = brute.runs_of(words)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *longest, 1000 * longest[1] // longest[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(kept))))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_awkward_rows(awkward, nothing):  # noqa: F811
    found = periodic_runs.find_runs(awkward)
    short = [(d, t) for d, t in ROWS if len(t or "") < 5000]
    assert bag(found.filter("coalesce(doc_id, 0) <> 7").select(RUN_COLUMNS).collect()) == bag(expected_runs(d, brute.words(t)) for d, t in short)
    row = found.filter("doc_id = 7").head()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"], row["collapsed_text"]) == (1, 0, 30_000, 1, 30_000_000, "word")
    assert periodic_runs.find_runs(nothing).count() == 0


def test_runs_of_random_words(spark):
    """Few different words, phrases repeated with errors, runs in runs, runs that overlap; texts of any length side by side."""
    rng, rows = random.Random(5), []
    for i in range(300):
        words = []
        while len(words) < rng.choice([0, 3, 30, 200]):
            phrase = [rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))]
            words += (phrase * rng.randrange(1, 7))[: rng.randrange(1, 60)]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert bag(periodic_runs.find_runs(df).select(RUN_COLUMNS).collect()) == bag(expected_runs(d, t.split()) for d, t in rows)
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.find_runs(df, least_length=20).collect()}
    assert runs == {d: brute.runs_of(t.split(), 20)[0] for d, t in rows}


def test_op13_repeats_the_tail_of_every_tenth_text(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    expected = []
    for d, t in rows:
        w, h = brute.words(t), zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) < 4000:
            expected.append(expected_runs(d, w))
    kept = {e[0] for e in expected}
    found = queries.queries()["op13_periodic_runs"](spark, DATA).select(RUN_COLUMNS).collect()
    assert len(found) == len(rows) and bag(r for r in found if r["doc_id"] in kept) == bag(expected) and any(e[1] for e in expected)


def near_words(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


def test_variants_of_awkward_words(spark):
    """Ties, chains of forms, letters beyond ASCII, words of odd and even length, edits at either end and in the middle."""
    rng, counts = random.Random(6), {}
    for base in ("banana", "abcdefg", "straße", "ÀÉÎÕÜýþÿ", "aaaaaaaa"):
        for _ in range(60):
            word = list(base)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(word) + 1)
                word[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "ÿ"])
            if len(word) >= 3:
                counts["".join(word)] = rng.choice([5, 5, 6, 25, 30, 125, 700])
    words = spark.createDataFrame([(w, n, "own") for w, n in counts.items()] + [(None, 9, "own")], "word string, n long, near string")
    assert near_words(spelling_variants.group_variants(words)) == brute.variants(counts)
    assert spelling_variants.group_variants(words.limit(0)).count() == 0


def test_variants_of_segments_that_very_many_words_share(spark):
    """Groups of more than 200 words with one half are joined on halves of the rest, and lose no pair."""
    rng = random.Random(7)
    ends = {"".join(rng.choice("abcd") for _ in range(rng.choice([4, 5]))) for _ in range(900)}
    counts = {"zzzz" + e: rng.choice([5, 30, 200]) for e in ends} | {e + "yyyyy": rng.choice([5, 30, 200]) for e in list(ends)[:400]}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    sizes = spelling_variants._entries(words).groupBy("l", "part", "segment").count().agg(F.max("count")).head()[0]
    assert sizes > spelling_variants._GROUP
    assert near_words(spelling_variants.group_variants(words)) == brute.variants(counts)


def counted(rows, damage):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if damage:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def test_word_counts_of_awkward_rows(awkward, nothing):  # noqa: F811
    for damage in (False, True):
        found = {r["word"]: r["n"] for r in spelling_variants.word_counts(awkward, damage=damage).collect()}
        assert found == counted(ROWS, damage) and len(found) > 5
    assert spelling_variants.word_counts(nothing).count() == 0


def test_op11_groups_what_brute_force_does(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    counts = counted(rows, True)
    assert near_words(queries.queries()["op11_spelling_variants"](spark, DATA)) == brute.variants(counts)
    assert any("h" in w for w in counts) and len(AWKWARD) == len(ROWS)
