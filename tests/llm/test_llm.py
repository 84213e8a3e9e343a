"""The operators against brute force on the smallest tables, and on awkward rows."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import _common, _links, jaccard_join, language_id, mixing, packing, pii, quality_classifier, quality_rules, queries, substring_dedup, token_counts, vector_search
from corpuslens.llm.language_id import fit_language_model, predict_language
from corpuslens.llm.quality_rules import rate_quality

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore "
AWKWARD = [
    (1, None, "en", None), (2, "", None, "s1"), (3, " \t\n", "en", "s1"), (4, LONG * 3, "en", "s1"), (5, LONG * 3, "en", None),
    (5, LONG * 3, "en", None), (None, LONG * 3 + "x", None, "s2"), (7, "word " * 30_000, "en", "s2"), (8, "ß ł 漢字 <|endoftext|>", "de", "s1"),
    (9, "mail a.b@c.de ip 1.2.3.4 card 4111 1111 1111 1111 iban DE89 3704 0044 0532 0130 00 +49 (30) 1234567", "de", "s1"),
    (10, "abc \x85", "en", "s2"), (11, "abc def\u2028", "en", "s2"), (12, "\u2029 a\x0bb\x0c \u2029", "de", None), (13, "12 34 --", "en", "s2"),
    (None, None, "en", None), (None, LONG * 3, "en", "s2"), (None, LONG * 3, "en", "s2"), (5, "another text of the same id " * 3, None, "s1"),
    (2**63 - 1, LONG * 2 + "y", "en", "s1"), (-(2**62), LONG + "z # line\n# line\n# line", "en", "s3"),
]
ROWS = [(r[0], r[1]) for r in AWKWARD]
#: Columns of names that operators use themselves.
CLASHING = ("size", "q", "v", "name", "found", "_id", "_key", "kept", "votes", "posterior", "base_failed", "row", "_words", "_windows", "_pairs",
            "_places", "_lines", "band", "bin", "place", "whole", "extra", "target", "doc", "none", "text_key", "key", "id", "n", "label",
            "component", "component_id", "other_id", "times", "times_", "part", "chunk", "_corpuslens", "value", "weight", "held", "spans")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, *(f"own {c}" for c in CLASHING)) for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(map(repr, map(tuple, rows)))


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_awkward_rows_of_row_operators(awkward):
    """Every value that has one right answer, row by row."""
    expected = []
    for d, t in ROWS:
        spans = [*brute.base_spans(t or ""), *brute.further_spans(t or "", pii.IBAN_LENGTHS, pii.CONTEXT, pii.COUNTER_CONTEXT)]
        expected.append((d, sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))))
    found = [(r["doc_id"], [tuple(x)[:3] for x in r["spans"]]) for r in pii.detect_pii(awkward).collect()]
    assert bag(found) == bag(expected)
    found = pii.mask_pii(awkward)
    assert found.columns == awkward.columns and bag(found.select("doc_id", "text").collect()) == bag((d, t and pii.masked(t, pii.find_spans(t))) for d, t in ROWS)
    names = ("n_words", "n_removed", "kept_sha256")
    found = substring_dedup.remove_repeats(awkward).select("doc_id", *names).collect()
    assert bag(found) == bag((d, *x) for (d, _), x in zip(ROWS, brute.removed(ROWS)))
    found = jaccard_join.jaccard_components(awkward).select("doc_id", "n_shingles", "component_id").collect()
    assert bag(found) == bag((d, *x[:2]) for (d, _), x in zip(ROWS, brute.classes(ROWS)))
    found = mixing.plan_mix(awkward).selectExpr("doc_id", "size", "source_size", "round(target, 6)", "whole * size + extra").collect()
    assert bag(found) == bag((d, a, b, round(c, 6), e) for (d, *_), (a, b, c, e) in zip(AWKWARD, brute.taken([(d, t, s) for d, t, _, s in AWKWARD])))
    assert mixing.plan_mix(awkward).filter("doc_id = 10").head()["size"] == 2


def test_awkward_rows_of_models(awkward):
    model = fit_language_model(awkward.filter("lang is not null"))
    found = predict_language(awkward, model).collect()
    undetermined = lambda t: not any(x.isalpha() for x in t or "")
    assert bag((r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in found) == bag((d, undetermined(t), undetermined(t)) for d, t in ROWS)
    for ids in ("doc_id", "concat('d', doc_id)"):
        df = awkward.selectExpr(f"{ids} doc_id", "text", "source quality")
        network = quality_classifier.fit_quality(df, awkward.selectExpr(f"{ids} doc_id", "cast(doc_id % 2 as int) quality").distinct())
        found = quality_classifier.score_quality(df, network).collect()
        own = {t: float(network.score(quality_classifier.pooled(pa.array([t or ""]), network.vectors))[0]) for _, t in ROWS}
        assert bag((r["doc_id"], round(r["score"], 5), r["predicted"]) for r in found) == bag(((f"d{d}" if d is not None and "d'" in ids else d), round(own[t], 5), int(own[t] >= 0.7)) for d, t in ROWS)


def test_nothing_in_nothing_out(spark, nothing):
    network = quality_classifier.fit_quality(nothing, nothing.selectExpr("doc_id", "1 quality"))
    for f in (
        packing.pack_documents, pii.detect_pii, pii.mask_pii, rate_quality, quality_rules.accepted, mixing.plan_mix, mixing.mix_sources, token_counts.count_tokens,
        jaccard_join.jaccard_components, jaccard_join.one_of_each, substring_dedup.remove_repeats,
        lambda d: predict_language(d, fit_language_model(d)), lambda d: quality_classifier.score_quality(d, network),
        lambda d: vector_search.search(d.selectExpr("doc_id vec_id", "array(1.0) v"), d.selectExpr("doc_id query_id", "array(1.0) v")),
    ):
        assert f(nothing).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0


def check_packing(rows, texts, added=False):
    """``texts``: (doc_id, text) of every row.  Ids by the tokenizers library; each id of each row lies in one piece."""
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = not added
    ids = {x: np.array([*coder.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u4") for x in set(texts)}
    wanted = defaultdict(list)
    for x, n in Counter(texts).items():
        wanted[x[0]].append((ids[x], np.full(len(ids[x]), n)))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        for own, left in wanted[r["doc_id"]]:
            part = slice(r["start"], r["start"] + r["length"])
            if len(own) == r["doc_tokens"] and zlib.crc32(own[part].tobytes()) == r["ids_crc32"] and left[part].min() > 0:
                left[part] -= 1
                break
        else:
            raise AssertionError(f"no such piece: {r}")
    assert not any(left.any() for parts in wanted.values() for _, left in parts)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_packing(spark, docs, awkward):
    check_packing(queries.queries()["op1_packing"](spark, DATA).collect(), list(docs.items()), added=True)
    check_packing(packing.pack_documents(awkward).collect(), ROWS)
    check_packing(packing.pack_documents(awkward.repartition(1), window_sequences=2).collect(), ROWS)


def test_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # in its default settings
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "x  <|endoftext|><|endoftext|>\n\n y\n<|endoftext|", 4: "漢字 \n<|endoftext|>ß"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    ids = {d: coder.encode(x, add_special_tokens=False).ids for d, x in texts.items()}
    assert ids[1] == [64, 220, 50256, 275]
    for rows in (queries.queries()["op1_packing"](spark, str(tmp_path)), corpus_pipeline.packing(spark, df, "")):
        found = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in rows.collect()}
        assert found == {d: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for d, x in ids.items()}
    found = {(r["doc_id"], r["line"]): (r["n_tokens"], r["doc_tokens"]) for r in queries.queries()["op9_token_counts"](spark, str(tmp_path)).collect()}
    assert found[1, 0] == (4, 4) and found[2, 0] == (1, 1)
    first = len(coder.encode("漢字 \n", add_special_tokens=False).ids)
    assert (found[4, 0], found[4, 1]) == ((first, len(ids[4])), (len(ids[4]) - first, len(ids[4])))


def test_pii(docs):
    odd = ["a@b@c.d", "x@y.z.@q.rr", "1.2.3.4.5.6.7.300", "@a.b", "a@b", "+1 2 3 45678 9--", "0000000000000 1", "..@.", "4111-1111-1111-1111 1"]
    two = "DE89 3704 0044 0532 0130 00 NO93 8601 1117 947"
    near = [
        "the hotel 555-123-4567", "555-123-4567 is my phone", "PHONE: 555-123-4567", "a trip of 123-45-6789", "ssn\n123-45-6789", "123-45-6789 (SSN)",
        "invoice phone 555-123-4567", "phone " + "x" * 40 + " 555-123-4567", "555-123-4567 " + "x" * 33 + " phone", "555-123-4567 " + "x" * 40 + " phone",
        two, two.replace(" ", ""), f"({two})", "DE89 3704 0044 0532 0130 0 0", "DE89 3704 0044 0532 0130 00x", "GR00 " + two, "x@y.zz 123-45-6789@a.bc ssn", "téléphone (555) 123-4567",
    ]
    for text in [*docs.values(), *odd, *near, AWKWARD[9][1]]:
        found = [s[:3] for s in pii.find_spans(text)]
        assert [s for s in found if s[0] in pii.BASE_KINDS] == brute.base_spans(text)
        assert sorted(s for s in found if s[0] not in pii.BASE_KINDS) == sorted(brute.further_spans(text, pii.IBAN_LENGTHS, pii.CONTEXT, pii.COUNTER_CONTEXT))
    kinds = [[s[0] for s in pii.find_spans(x)] for x in near]
    assert kinds[:7] == [[], ["phone_local"], ["phone_local"], [], ["national_id"], ["national_id"], []] and kinds[10] == ["iban", "iban"]
    assert [s[0] for s in pii.find_spans(AWKWARD[9][1])] == ["email", "ip", "card", "phone", "iban"]
    assert pii.masked("a x@y.zz b", pii.find_spans("a x@y.zz b")) == "a [EMAIL] b"


def test_pii_in_linear_time():
    seconds = []
    for n in (4000, 16000):
        text = "x@y.zz phone 555-123-4567 " * n
        began = time.perf_counter()
        assert len(pii.find_spans(text)) == 2 * n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0]


def test_account_numbers_of_the_whole_registry():
    numbers = [
        "NO93 8601 1117 947", "HR12 1001 0051 8630 0016 0", "BG80 BNBG 9661 1020 3456 78", "SI56 2633 0001 2039 086", "SK31 1200 0000 1987 4263 7541",
        "GR16 0110 1250 0000 0001 2300 695", "HU42 1177 3016 1111 1018 0000 0000", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
    ]
    for number in numbers:
        text = f"iban {number}, thanks"
        assert ("iban", 5, 5 + len(number)) in [s[:3] for s in pii.find_spans(text)]
        assert pii.masked(text, pii.find_spans(text)) == "iban [IBAN], thanks"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    expected, found = db.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    own = expected.select(*(f'"{c}"' for c in columns)).fetchall()  # of both as Python's numbers: a null is no float there
    assert sorted(map(repr, own)) == sorted(repr(tuple(r)) for r in found.select(columns).collect())


def test_incremental_dedup(spark, docs):
    rows = sorted(docs.items())
    old, new = spark.createDataFrame(rows[:120], "doc_id long, text string"), spark.createDataFrame(rows[120:], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, most_runs=2)
    substring_dedup.remove_repeats(old, index, batches=2).count()
    assert len(index.runs) == 2
    index.compact()
    assert len(index.runs) == 1
    found = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.remove_repeats(new, index, old, batches=1).collect()}
    whole = {r["doc_id"]: r["kept_sha256"] for r in queries.queries()["op3_substring_dedup"](spark, DATA).collect()}
    assert found == {d: whole[d] for d, _ in rows[120:]}


def test_a_batch_meets_the_runs_before_it(spark):
    """Only what the new batch shares is listed, of documents of all batches; runs beyond the number are one, with every entry once."""
    words = lambda *spans: " ".join(f"w{i}" for a, b in spans for i in range(a, b))
    texts = {1: words((0, 40)), 2: words((100, 140)), 3: words((0, 20), (200, 230)), 4: words((100, 130)), 5: words((300, 330), (0, 30))}
    rows = lambda *ids: substring_dedup.keyed(spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string"))
    for most_runs in (1, 5):
        index, met = substring_dedup.FingerprintIndex(spark, buckets=3, most_runs=most_runs), []
        for ids in ((1, 2), (3,), (4, 5), (4,)):
            found = substring_dedup.assembled(index.add(rows(*ids)), 3).collect()
            met.append({r["doc"] for r in found})
            assert len(index.runs) == min(most_runs, len(met))
        assert met == [set(), {1, 3}, {1, 2, 3, 4, 5}, {2, 4}]
        index.compact()
        entries = index._read(*index.runs).filter("kind = 'entries'").collect()
        assert len(index.runs) == 1 and len({r["bucket"] for r in entries}) == len(entries) <= 3
        for r in entries:
            prints, docs, kinds = substring_dedup._entries(3, r["bucket"], r["prints"], r["owners"], r["docs"], r["texts"])
            assert len(set(zip(prints.tolist(), docs.tolist(), kinds.tolist()))) == len(prints) and (np.diff(prints.astype(object)) >= 0).all()


def test_jaccard_join(spark, docs):
    base = [f"w{i}" for i in range(80)]
    near = {10_000 + k: " ".join(w for i, w in enumerate(base) if i != 2 * k) for k in range(40)}  # one large group
    short = {20_000: "a b", 20_001: "A B", 20_002: "a", 20_003: "", 20_004: None}
    texts = docs | near | short
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert found == {d: x[:2] for (d, _), x in zip(texts.items(), brute.classes(list(texts.items())))}


def test_jaccard_join_of_clusters(spark, monkeypatch):
    """Texts of a few templates with other words put in, so that groups of a key overlap and fall apart."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        words = [f"t{i % 4}-{j}" for j in range(60 + 20 * (i % 3))]
        for place in rng.choice(len(words), rng.integers(0, 4), replace=False):
            words[place] = f"x{rng.integers(0, 3)}"
        rows.append((int(rng.permutation(260)[0]) * 260 + i if i % 9 else None, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = bag((d, *x[:2]) for (d, _), x in zip(rows, brute.classes(rows)))
    monkeypatch.setattr(_links, "_FEW", 0)
    monkeypatch.setattr(_links, "_HOT", 20)
    monkeypatch.setattr(jaccard_join, "_BLOCK", 8)
    crossed = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label: (crossed.append(label), _common.stored(df, label))[1])
    for small_group, ids in ((2, 500_000), (24, 0)):
        monkeypatch.setattr(jaccard_join, "_BROADCAST_IDS", ids)
        found = jaccard_join.jaccard_components(df, small_group=small_group).select("doc_id", "n_shingles", "component_id").collect()
        assert bag(found) == expected
    assert "crossed" in crossed


def test_components_of_hubs_and_chains(spark, monkeypatch):
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001), (5002, 5001)]
    df = spark.createDataFrame(links, "a long, b long")
    expected = bag([(i, 0) for i in range(400)] + [(1000 + i, 1000) for i in range(61)] + [(5000 + i, 5000) for i in range(3)])
    for few in (10_000, 0):
        monkeypatch.setattr(_links, "_FEW", few)
        assert bag(_links.components(df).collect()) == expected


def test_jaccard_join_of_unequal_sizes_in_large_groups(spark):
    """17 and 20 shingles, 16 in common; the two keys that both emit are each in a group of 27."""
    rng = np.random.default_rng(4)

    def described(words):
        sets = jaccard_join.shingle_sets(pa.array([" ".join(w) for w in words]), 5)
        return [(w, x, set(jaccard_join.join_keys(x, np.empty(0, np.uint64))[0].tolist())) for w, x in zip(words, sets)]

    def words(n):
        return [f"w{i}" for i in rng.integers(0, 2**40, n)]

    def alone(shared, row):
        """The words of the shingles that are alone in the segments of the shared keys, or None."""
        found = []
        for i in range(16):
            ((_, own, _),) = described([row[i : i + 5]])
            place, parity = jaccard_join.segment_parities(own, 4)
            key = int(jaccard_join.mix(parity + jaccard_join.mix(place * np.uint64(64) + np.uint64(5)))[0])
            if key in shared:
                found.append((row[i : i + 5], key))
        return found if len(found) == len(shared) else None

    for _ in range(100):
        common = [words(20) for _ in range(1000)]
        small, large = described([w + words(1) for w in common]), described([w + words(4) for w in common])
        found = [(a, b, alone(a[2] & b[2], w)) for w, a, b in zip(common, small, large) if len(a[2] & b[2]) == 2]
        found = [x for x in found if x[2]]
        if found:
            break
    a, b, shingles = found[0]
    assert (len(a[1]), len(b[1]), len(np.intersect1d(a[1], b[1]))) == (17, 20, 16)
    texts = [a[0], b[0]]
    for own, key in shingles:
        fillers = []
        while len(fillers) < 25:
            fillers += [w for w, _, keys in described([own + words(15) for _ in range(200)]) if key in keys]
        texts += fillers[:25]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()}
    assert found == {i: 0 if i == 1 else i for i in range(len(texts))}
    leave = spark.range(1, 3000).selectExpr("id AS n").selectExpr("n", f"{jaccard_join._MAY_LEAVE} AS keys")
    assert all(r["keys"] == jaccard_join.spare(-(-3 * r["n"] // 4)) for r in leave.collect())


def test_jaccard_join_of_null_ids(spark):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(w for i, w in enumerate(base) if i != 2 * k) for k in range(40)]  # one large group
    other = " ".join(f"v{i}" for i in range(80))
    rows = [*((None, x) for x in texts), (None, other), (None, other + " x"), (None, other), (3, texts[0] + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_components(df).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r["component"]].append(r["component_id"])
    assert sorted(groups.values(), key=len) == [[None] * 3, [3] * 41]
    assert sorted(r["doc_id"] or 0 for r in jaccard_join.one_of_each(df).collect()) == [0, 3]


def test_sketch_bounds_difference():
    rng = np.random.default_rng(1)
    for n in (1, 3, 10, 100, 1000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
        for band in (n.bit_length(), n.bit_length() + 1):
            apart = np.unpackbits(jaccard_join.sketch(a, band) ^ jaccard_join.sketch(b, band)).sum()
            assert apart <= len(np.setxor1d(a, b))


def check_quality(found, texts):
    """``found``: rows of the operator in the order of ``texts``."""
    counted = [brute.features(t, quality_rules.FUNCTION_WORDS) for t in texts]
    good = brute.posteriors([brute.votes(f) for f in counted])
    for r, f, p in zip(found, counted, good, strict=True):
        assert {k: r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == {k: f[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        assert r["base_failed"] == (f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"])
        assert abs(r["posterior"] - p) < 2e-6 and r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_quality_rules(spark, docs, awkward):
    found = queries.queries()["op5_quality_rules"](spark, DATA).collect()
    check_quality(sorted(found, key=lambda r: r["doc_id"]), [docs[d] for d in sorted(docs)])
    rated = rate_quality(awkward, with_row=True).select("row", "q.*", "posterior", "base_failed", "kept").collect()
    assert bag((r["row"]["doc_id"], r["row"]["text"], r["row"]["kept"]) for r in rated) == bag((d, t, "own kept") for d, t in ROWS)
    check_quality(rated, [r["row"]["text"] for r in rated])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = [r for r in queries.queries()["op7_language_id"](spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found]) > 0.95
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in queries.queries()["op6_quality_classifier"](spark, folder).collect() if r["held_out"] and r["doc_id"] in quality]
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in found]) > 0.95


def test_classifier_by_hand(spark, docs):
    """Pooling, word vectors and gradients against loops; the temperature is the best of its grid on the rows held back."""
    texts = [docs[d][:3000] for d in sorted(docs)[:6]] + ["", "Aa1 b!! ÄÖ 2024"]
    column = pa.array(texts)
    parts = [re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0d]+", t.encode()) for t in texts]
    doc, word, shape = quality_classifier.tokens(column)
    assert [int((doc == i).sum()) for i in range(len(texts))] == [len(p) for p in parts]
    bucket = {p: [int(x[0]) for x in quality_classifier.tokens(pa.array([p.decode()]))[1:]] for ps in parts for p in ps if p.isascii()}
    flat = [p for ps in parts for p in ps]
    assert all(bucket[p] == [w, s] for p, w, s in zip(flat, word.tolist(), shape.tolist()) if p in bucket)

    index, rows, words = quality_classifier.index_vectors(), quality_classifier._ROWS, quality_classifier._WORDS
    assert set(np.unique(np.abs(index))) <= {0, 1, 2, 3, 4, 5, 6} and np.abs(index).sum(axis=1).max() == 6
    sums = np.zeros((rows, index.shape[1]))
    for i in range(len(texts)):
        own = [(w, s) for d, w, s in zip(doc.tolist(), word.tolist(), shape.tolist()) if d == i]
        for at, (w, s) in enumerate(own):
            for step in (1, 2):
                for to in (at - step, at + step):
                    if 0 <= to < len(own):
                        (v, u), before = own[to], to < at
                        sums[w] += index[v] / step
                        sums[s] += index[u] / step
                        if before:  # a word and the shape behind it are neighbours
                            sums[s] += index[v] / step
                        else:
                            sums[w] += index[u] / step
    assert np.allclose(quality_classifier.context_sums(column, index), sums, atol=1e-2)

    vectors = np.random.default_rng(0).normal(size=(rows, 48)).astype(np.float32)
    for i, x in enumerate(quality_classifier.pooled(column, vectors)):
        w, s = word[doc == i], shape[doc == i]
        n, total = np.bincount(w, minlength=words), max(1, len(w))
        damped = np.sqrt(n)
        pools = [damped @ vectors[:words] / max(1, damped.sum()), n @ vectors[:words] / total, np.bincount(s - words, minlength=rows - words) @ vectors[words:] / total]
        more = [math.log1p(total), (n > 0).sum() / total, math.log1p(n.max() / total * 10), *map(np.linalg.norm, pools)]
        assert np.allclose(x, [*np.concatenate(pools), *more], atol=1e-3)

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), (rng.random(60) > 0.4).astype(float)
    at = {"w1": rng.normal(size=(5, 3)), "b1": rng.normal(size=3), "w2": rng.normal(size=3), "b2": 0.3}

    def loss(w1, b1, w2, b2):
        z = np.tanh(x @ w1 + b1) @ w2 + b2
        return np.logaddexp(0, np.where(y == 1, -z, z)).mean() + quality_classifier._DECAY / 2 * ((w1**2).sum() + (w2**2).sum())

    for name, g in quality_classifier.gradients(*at.values(), x, y).items():
        for place in np.ndindex(np.shape(g)):
            moved = [np.array(at[name], float) for _ in range(2)]
            for m, e in zip(moved, (1e-6, -1e-6)):
                m[place] += e
            assert abs((loss(**at | {name: moved[0]}) - loss(**at | {name: moved[1]})) / 2e-6 - np.asarray(g)[place]) < 1e-6
    model = quality_classifier.fit_network(vectors, x.astype(np.float32), y.astype(int), epochs=40)
    z, t = model.logits(x.astype(np.float32))[4::5], y[4::5]
    of = lambda heat: np.logaddexp(0, np.where(t == 1, -z, z) / heat).mean()
    assert of(model.temperature) <= min(of(h) for h in np.geomspace(0.5, 5.0, 41)) + 1e-12
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-model.logits(x) / model.temperature)))


def test_language_by_hand(spark):
    """TF-IDF vectors, centroids and rejection against loops over trigrams."""
    rng = np.random.default_rng(2)
    syllables = {"aa": ["ba", "lo", "ki"], "bb": ["üx", "ze", "qu"], "cc": ["漢字", "語", "文"]}
    texts, names = [], []
    for i in range(90):
        name = ["aa", "bb", "cc"][i % 3]
        texts.append(" ".join("".join(rng.choice(syllables[name], 3)) for _ in range(20)) + (" BA.9" if i % 2 else ""))
        names.append(name)

    def grams(text):
        raw = b" " + bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in text.encode().lower()) + b" "
        out = Counter()
        for i in range(len(raw) - 2):
            if raw[i : i + 3] != b"   ":
                out[(int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1 % 2**32) >> 20] += 1
        return out

    counts = language_id.trigram_counts(pa.array(texts))
    assert all({int(k): int(row[k]) for k in np.flatnonzero(row)} == grams(t) for row, t in zip(counts, texts))
    model = language_id.fit_centroids(names, counts, 4)
    assert model.languages == [x for x in ("aa", "bb", "cc") for _ in range(4)] and not np.allclose(model.centroids[0], model.centroids[1])
    held = Counter(k for t in texts for k in grams(t))
    tested = [*texts, "zzz yyy xxx www", "ba", "unheard of words in a row"]
    found = model.predict(language_id.trigram_counts(pa.array(tested)))
    for text, name, score, rejected in zip(tested, *found):
        row = {k: math.log1p(n) * (math.log((1 + len(texts)) / (1 + held[k])) + 0.1) for k, n in grams(text).items()}
        size = math.sqrt(sum(x * x for x in row.values()))
        cosine = [sum(x * c[k] for k, x in row.items()) / size for c in model.centroids]
        best = max(range(12), key=lambda i: cosine[i])
        assert name == model.languages[best] and abs(score - min(1, max(0, cosine[best]))) < 1e-4 and rejected == (cosine[best] < model.reject_below[best])
    assert found[0][:90] == names and not any(found[2][:90].tolist()) and bool(found[2][90]) and bool(found[2][92])
    df = spark.createDataFrame([(i, str(i), "x") for i in range(40)], "doc_id long, lang string, text string")
    with pytest.raises(ValueError):
        language_id.bounded_sample(df, "lang", 5, most_values=39)
    some = language_id.bounded_sample(df.selectExpr("doc_id", "if(doc_id < 4, 'few', 'many') lang", "text").union(df.selectExpr("null", "'none'", "text")), "lang", 9)
    n = Counter(r["lang"] for r in some.collect())
    assert n["few"] == 4 and 1 <= n["many"] <= 20 and n["none"] <= 1


def test_mixing(spark, docs, awkward, monkeypatch):
    """Both ways to join targets, and bins of few rows, give the same plan."""
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    expected = bag((d, a, b, round(c, 4), e) for d, (a, b, c, e) in zip(docs, brute.taken([(d, t, source[d]) for d, t in docs.items()])))
    for sources, bins in ((10_000, 4096), (0, 4)):
        monkeypatch.setattr(mixing, "_BROADCAST_SOURCES", sources)
        monkeypatch.setattr(mixing, "_BINS", bins)
        assert bag(mixing.plan_mix(df).selectExpr("doc_id", "size", "source_size", "round(target, 4)", "whole * size + extra").collect()) == expected
    mixed = mixing.mix_sources(awkward)
    assert mixed.columns == awkward.columns
    whole = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert all(brute.words(t) and n <= 3 * Counter(ROWS)[d, t] for (d, t), n in whole.items())


def test_token_counts(spark, docs, awkward):
    """Every line of every document, by the bytes of each token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}

    def lines(text):
        tokens, at, out = coder.encode(text or "", add_special_tokens=False).tokens, 0, Counter()
        raw = (text or "").encode()
        for x in tokens:
            part = x.encode() if x == "<|endoftext|>" else bytes(byte[c] for c in x)
            assert raw[at : at + len(part)] == part
            out[raw[:at].count(b"\n")] += 1
            at += len(part)
        return {i: (out[i], len(tokens)) for i in range((text or "").count("\n") + 1)}

    found = defaultdict(dict)
    for r in queries.queries()["op9_token_counts"](spark, DATA).collect():
        found[r["doc_id"]][r["line"]] = r["n_tokens"], r["doc_tokens"]
    assert found == {d: lines(t) for d, t in docs.items()}
    once = awkward.selectExpr("monotonically_increasing_id() doc_id", "text", *CLASHING)
    texts = {r["doc_id"]: r["text"] for r in once.collect()}
    found = defaultdict(dict)
    for r in token_counts.count_tokens(once, added_tokens=True).collect():
        found[r["doc_id"]][r["section"]] = int(r["n_tokens"]), r["doc_tokens"]
    assert found == {d: lines(t) for d, t in texts.items()}
    two = token_counts.count_tokens(awkward, ("source", "text"), by_line=False).groupBy("doc_id", "field").count().collect()
    assert {(r["doc_id"], r["field"]): r["count"] for r in two} == {(d, f): n for d, n in Counter(d for d, _ in ROWS).items() for f in ("source", "text")}
    spans = np.array([0, 3, 4]), np.array([3, 4, 9]), np.array([0, 5, 9])
    assert token_counts.attribute(*spans, "first_byte").tolist() == [3, 0]
    assert token_counts.attribute(*spans, "majority").tolist() == [2, 1]
    assert token_counts.attribute(*spans, "split").tolist() == [2.2, 0.8]


def test_vector_search(spark):
    found = queries.queries()["op10_vector_search"](spark, DATA).toPandas()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), np.float64), rows["vec_id"].to_numpy()
    hits = []
    for query, group in found.groupby("query_id"):
        apart = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, apart)) if ids[i] != query][:10]
        hits += [len(set(ids[order]) & set(group["vec_id"])) / 10]
    assert np.mean(hits) >= 0.9
    some = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("vec_id", "embedding v")
    asked = some.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    whole, dealt = ({tuple(r) for r in vector_search.search(some, asked, chunk_queries=n).collect()} for n in (16384, 7))
    assert whole == dealt and len({r[0] for r in whole}) > 7
    odd = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame(odd, "vec_id long, v array<float>")
    got = vector_search.search(rows, rows.withColumnRenamed("vec_id", "query_id").filter("query_id < 5")).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 5, 1.0), (0, 2, 6, 1.0)]
    again = spark.createDataFrame([(0, [1.0, 0.0], "x")] * 3 + [(1, [9.0, 1.0], "x"), (1, [1.0, 3.0], "x"), (2, [1.0], "x"), (4, [4.0], "x")] + [(3, [2.0, 2.0], "x")] * 300, "vec_id long, v array<double>, query_id string")
    got = vector_search.search(again, again.selectExpr("vec_id query_id", "v", "vec_id"), k=2, rerank=1).collect()
    assert sorted((*r[:3], round(r[3], 6)) for r in got) == [(0, 1, 3, 2.236068), (0, 2, 1, 3.0), (1, 1, 3, 1.414214), (1, 2, 0, 3.0), (2, 1, 4, 3.0), (3, 1, 1, 1.414214), (3, 2, 0, 2.236068), (4, 1, 2, 3.0)]


def test_vector_search_by_cluster_or_not(spark):
    """Clustered vectors are found in a few lists, isotropic ones in most of them; recall is high in both."""
    rng = np.random.default_rng(5)
    centres, kinds = rng.normal(size=(60, 32)), {}
    kinds["clustered"] = centres[rng.integers(0, 60, 4000)] + rng.normal(0, 0.1, (4000, 32))
    kinds["isotropic"] = rng.normal(size=(4000, 32))
    share = {}
    for kind, x in kinds.items():
        df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, v array<double>")
        found = vector_search.search(df, df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")).toPandas()
        hits = []
        for query, group in found.groupby("query_id"):
            apart = ((x - x[query]) ** 2).sum(axis=1)
            apart[query] = np.inf
            hits.append(len(set(np.argsort(apart)[:10].tolist()) & set(group["vec_id"])) / 10)
        assert np.mean(hits) >= 0.9
        coarse = vector_search.kmeans(x, 63, 12, 10)
        share[kind] = vector_search.probes_for(x, coarse, 10, 0.96) / 63
    assert share["clustered"] <= 0.1 < share["isotropic"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns and docs.count() > 0
    found = corpus_pipeline.packing(spark, docs, DATA).collect()
    check_packing(found, [(r["doc_id"], r["text"]) for r in docs.collect()], added=True)
    check_packing(corpus_pipeline.run(spark, DATA).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], added=True)


def test_stages_on_awkward_rows(spark, awkward):
    """Each stage against brute force; all columns come through, whatever their names."""
    stages, rows = dict(corpus_pipeline.STAGES), [tuple(r) for r in awkward.collect()]
    run = lambda name: stages[name](spark, awkward, DATA)
    assert all(run(name).columns == awkward.columns for name in list(stages)[:-1])
    counted = [brute.features(r[1], quality_rules.FUNCTION_WORDS) for r in rows]
    good = brute.posteriors([brute.votes(f) for f in counted])
    assert bag(run("quality_rules").collect()) == bag(r for r, f, p in zip(rows, counted, good) if p >= 0.5 and f["n_words"] >= 10 and 100 * f["n_repeat_words"] <= 20 * f["n_words"])
    kept = Counter()
    for i, (_, n, members) in enumerate(x for x in [(i, *x[:1], x[2]) for i, x in enumerate(brute.classes(ROWS))]):
        first = min(members, key=lambda j: (ROWS[j][0] is None, ROWS[j][0] or 0))
        if not n or (i == first):
            kept[ROWS[i][0], ROWS[i][1]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in run("near_duplicates").collect()) == kept
    assert bag(run("personal_data").drop("text").collect()) == bag((r[0], *r[2:]) for r in rows)
    check_packing(run("packing").collect(), ROWS, added=True)


def test_shared_folders(spark):
    """Without a shared folder a cluster is refused; tables that are no longer read can be deleted."""
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x"))
    with pytest.raises(ValueError):
        _common.scratch(cluster, "x")
    kept = _common.stored(spark.range(3), "x")
    assert kept.count() == 3
    _common.discard(kept)
    assert not Path(kept._corpuslens_path.removeprefix("file://")).exists()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    size = Path(f"{DATA}/documents.parquet").stat().st_size
    assert _common.tasks_for(docs, 1 << 40) == least and abs(_common.tasks_for(docs.filter("doc_id > 3"), 1000) - size / 1000) < size / 5000 + 1
    assert _common.tasks_for(spark.range(5).cache(), 1 << 30) == least
