"""Substring deduplication on a log-structured index of window fingerprints.

A window of 13 words holds nine runs of five words; the smallest of their hashes is the window's fingerprint.  Equal
windows have equal fingerprints, wherever they start, and windows side by side mostly share theirs, so the index holds
about a fifth of an entry for each word.  A run is immutable: for each bucket of hashes sorted arrays of fingerprints with the
documents that have them.  A new batch of documents is merge-joined with the runs of all earlier ones, bucket by bucket, which gives
the fingerprints that the batch shares with them or within itself.  The same pass writes the batch's own run, or, where there are
as many runs as there may be, one that all of them are compacted into.

Fingerprints found in two or more documents only propose.  The windows they stand for are then verified by 96 further bits
of two independent hashes of all 13 words, and a word is removed if a window that covers it also starts in a
document with a smaller doc_id.  So results are exact up to collisions of these 96 bits.

What several documents of one batch share is settled there: of such a fingerprint or window one entry per batch is
sent on, so a passage in a third of all documents gives as many entries as there are batches, not documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import delete, scratch, ship, slices, table, tasks_for
from corpuslens.llm._vectors import Texts, rolled, sliding_min

_U = np.uint64
_RUN = "bucket int, prints binary, owners binary, docs binary, texts binary, counts binary, found binary"
_RUN_ARROW = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("prints", "owners", "docs", "texts", "counts", "found")]])
_MARKS = "bucket int, windows binary, checks binary, places binary, docs binary, texts binary, counts binary, found binary"
_MARKS_ARROW = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("windows", "checks", "places", "docs", "texts", "counts", "found")]])
_SHARED = 2**32 - 1  # an owner: several documents of the batch
#: What an owner is: several documents of a batch, a document with a doc_id, one without (``doc`` is then its text_key).
_SEVERAL, _OWN, _NONE = 0, 1, 2


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class Windows:
    """Fingerprints of the windows of some texts: ``print``, and the text and first word of each."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.texts, self.window = Texts(column), window
        self.starts, self.ends, self.doc = self.texts.words()
        self.hashes = self.texts.hashes(self.starts, self.ends)
        n = len(self.hashes) - window + 1
        if n <= 0:
            self.at, self.print = np.empty(0, np.int64), np.empty(0, np.uint64)
            return
        least = sliding_min(rolled(self.hashes, gram), window - gram + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :])
        self.print = least[self.at]

    def first_words(self) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(len(self.texts.bounds) - 1))

    def content(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = self.texts.hashes(self.starts, self.ends, lane=1)
        return rolled(self.hashes, self.window, 0)[at], (rolled(other, self.window, 1)[at] >> _U(32)).astype(np.uint32)


def _by_owner(owners: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(owners, kind="stable")
    at, first = np.unique(owners[order], return_index=True)
    return zip(at.tolist(), np.split(values[order], first[1:]))


def _halves(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their lower and their upper halves; small numbers' upper halves compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view("<u2").reshape(-1, 2).T).tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "<u2").reshape(2, -1).T).view("<u4").ravel()


def _thin(prints: np.ndarray, buckets: int) -> bytes:
    """Ascending fingerprints of one bucket as the steps between their quotients, byte by byte: upper bytes are mostly zeros."""
    steps = np.diff(prints // _U(buckets), prepend=_U(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _thick(raw: bytes, bucket: int, buckets: int) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64) * _U(buckets) + _U(bucket)


#: Values by document, dealt to parts of the documents: doc, text_key, number of values, and the values one after another.
_LISTS = "part int, docs binary, texts binary, counts binary, found binary"
_LISTS_ARROW = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("docs", "texts", "counts", "found")]])


def _first(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _lists(docs: np.ndarray, texts: np.ndarray, values: np.ndarray, parts: int) -> list[tuple]:
    """Rows of _LISTS: a row for each part, not for each document."""
    out = []
    for part, at in _by_owner(docs % parts, np.arange(len(docs))):
        at = at[np.lexsort((texts[at], docs[at]))]
        doc, text = docs[at], texts[at]
        first = np.flatnonzero(_first(doc, text))
        counts = np.diff(np.append(first, len(doc)))
        out.append((part, doc[first].tobytes(), text[first].tobytes(), _halves(counts), values[at].tobytes()))
    return out


def _assemble(batches, kind: str):
    """(doc, text_key, found): all values of each document of this partition, once."""
    docs, texts, values = [], [], []
    for batch in batches:
        for doc, text, count, found in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            count = _whole(count)
            docs.append(np.repeat(np.frombuffer(doc, np.int64), count))
            texts.append(np.repeat(np.frombuffer(text, np.int64), count))
            values.append(np.frombuffer(found, kind))
    if not docs:
        return
    docs, texts, values = map(np.concatenate, (docs, texts, values))
    order = np.lexsort((values, texts, docs))
    docs, texts, values = docs[order], texts[order], values[order]
    new = _first(docs, texts)
    once = new | _first(values)
    docs, texts, values, new = docs[once], texts[once], values[once], new[once]
    first = np.flatnonzero(new)
    found = np.split(values, first[1:])
    for start in range(0, len(first), 5000):
        at = first[start : start + 5000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[at]), pa.array(texts[at]), pa.array([x.tobytes() for x in found[start : start + 5000]], pa.binary())],
            ["doc", "text_key", "found"],
        )


#: Bytes of text whose windows a task holds at once.
_CHUNK = 8 << 20


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text"), _CHUNK):
            yield batch.slice(a, b - a)


def _starts_of_groups(prints: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_first(prints))


def _shared(kinds: np.ndarray, docs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of equal fingerprints whether two owners have it, one of them with a doc_id: what only documents
    without a doc_id have removes nothing."""
    own = kinds == _OWN
    least = np.minimum.reduceat(np.where(own, docs, np.iinfo(np.int64).max), first)
    most = np.maximum.reduceat(np.where(own, docs, np.iinfo(np.int64).min), first)
    some, none = (np.logical_or.reduceat(kinds == k, first) for k in (_OWN, _NONE))
    return np.logical_or.reduceat(kinds == _SEVERAL, first) | (some & (none | (least != most)))


def _write_run(batches, window: int, gram: int, buckets: int, windows: type = Windows):
    for batch in _chunks(batches):
        docs = np.array(batch.column(0).to_pylist(), np.int64)
        kinds = np.where(np.array(batch.column(1).to_pylist(), bool), _NONE, _OWN).astype(np.uint8)
        prints, owners = [], []
        for a, b in slices(batch.column(2), 1 << 20):
            w = windows(batch.column(2).slice(a, b - a), window, gram)
            doc = w.doc[w.at]
            new = _first(w.print, doc)
            prints.append(w.print[new])
            owners.append(doc[new] + a)
        if not prints or not sum(map(len, prints)):
            continue
        prints, owners = np.concatenate(prints), np.concatenate(owners)
        order = np.lexsort((docs[owners], kinds[owners], prints))
        prints, owners = prints[order], owners[order]
        first = _starts_of_groups(prints)
        size = np.diff(np.append(first, len(prints)))
        shared = _shared(kinds[owners], docs[owners], first)
        is_shared = np.repeat(shared, size)
        of = owners[is_shared]
        rows = [(p, None, None, *rest) for p, *rest in _lists(docs[of], kinds[of].astype(np.int64), _proposed(prints[is_shared]), buckets)]
        # One entry for each fingerprint and owner, or one with the mark that several documents have it.
        once = ~is_shared
        once[first] = True
        who = np.where(is_shared, _SHARED, owners).astype(np.uint32)[once]
        entries = prints[once]
        for bucket, at in _by_owner((entries % _U(buckets)).astype(np.int64), np.arange(len(entries))):
            rows.append((bucket, *_packed(entries[at], buckets, who[at], docs, kinds), None, None))
        yield _table(_RUN_ARROW, rows)


def _proposed(prints: np.ndarray) -> np.ndarray:
    """What lists hold of a fingerprint: 32 bits are enough to propose, as windows are verified."""
    return prints.astype(np.uint32)


def _packed(prints: np.ndarray, buckets: int, who: np.ndarray, docs: np.ndarray, kinds: np.ndarray) -> tuple:
    """prints, owners, docs and texts (here: the kinds of the docs, or null if all have doc_ids) of a run's bucket."""
    single = who != _SHARED
    held, inner = np.unique(who[single], return_inverse=True)
    own = np.full(len(who), _SHARED, np.uint32)
    own[single] = inner
    kind = kinds[held]
    return _thin(prints, buckets), _halves(own), docs[held].tobytes(), kind.tobytes() if (kind != _OWN).any() else None


def _entries(buckets: int, bucket: int, prints: bytes, owners: bytes, docs: bytes, kinds: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a run's bucket, ascending, with the doc and the kind of each owner."""
    own, doc = _whole(owners), np.append(np.frombuffer(docs, np.int64), 0)
    kind = np.full(len(doc), _OWN, np.uint8) if kinds is None else np.append(np.frombuffer(kinds, np.uint8), 0)
    several, at = own == _SHARED, np.minimum(own, len(doc) - 1)
    return _thick(prints, bucket, buckets), np.where(several, 0, doc[at]), np.where(several, _SEVERAL, kind[at]).astype(np.uint8)


def _merged(runs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of several runs in order of their fingerprints.  Each is sorted, so the stable sort, which looks for ascending
    stretches and merges them, is a merge."""
    prints, docs, kinds = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(prints, kind="stable")
    return prints[order], docs[order], kinds[order]


def _passed_on(batch: pa.RecordBatch, columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows that hold settled lists go on as they are."""
    settled = batch.column(1).is_null()
    if settled.true_count:
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(settled), *[batch.column(c).filter(settled) for c in columns]], schema=_LISTS_ARROW)


def _run_row(bucket: int, buckets: int, prints: np.ndarray, docs: np.ndarray, kinds: np.ndarray) -> tuple:
    """A run's row of one bucket, without repeated entries."""
    order = np.lexsort((docs, kinds, prints))  # prints ascend already: only owners of one fingerprint change places
    prints, docs, kinds = prints[order], docs[order], kinds[order]
    new = _first(prints, docs, kinds)
    prints, docs, kinds = prints[new], docs[new], kinds[new]
    owned = kinds != _SEVERAL
    owner = np.full(len(docs), _SHARED, np.uint32)
    by_doc = np.lexsort((kinds[owned], docs[owned]))
    fresh = _first(docs[owned][by_doc], kinds[owned][by_doc])
    inner = np.empty(len(by_doc), np.uint32)
    inner[by_doc] = (np.cumsum(fresh) - 1).astype(np.uint32)
    owner[owned] = inner
    held_docs, held_kinds = (x[owned][by_doc][fresh] for x in (docs, kinds))
    return bucket, *_packed(prints, buckets, owner, held_docs, held_kinds), None, None


def _join_batch(batches, buckets: int, compact: bool):
    """Lists of the fingerprints that the new batch (``fresh`` rows) shares, of all documents that have them, and the rows of the
    run to be written: of the batch, or (``compact``) of all runs."""
    held: dict[int, list] = {}
    for batch in batches:
        settled = batch.column(1).is_null()
        if settled.true_count:
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(settled) for c in range(7)], schema=_RUN_ARROW)
        for bucket, *entries, fresh in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7))):
            if entries[0] is not None:
                prints, docs, kinds = _entries(buckets, bucket, *entries)
                held.setdefault(bucket, []).append((prints, docs, kinds, np.full(len(prints), fresh)))
    for bucket in list(held):
        # Each run is sorted, so the stable sort, which looks for ascending stretches and merges them, is a merge.
        prints, docs, kinds, fresh = (np.concatenate(x) for x in zip(*held.pop(bucket)))
        order = np.argsort(prints, kind="stable")
        prints, docs, kinds, fresh = prints[order], docs[order], kinds[order], fresh[order]
        first = _starts_of_groups(prints)
        wanted = _shared(kinds, docs, first) & np.logical_or.reduceat(fresh, first)
        wanted = np.repeat(wanted, np.diff(np.append(first, len(prints)))) & (kinds != _SEVERAL)
        rows = []
        if wanted.any():
            lists = _lists(docs[wanted], kinds[wanted].astype(np.int64), _proposed(prints[wanted]), buckets)
            rows += [(part, None, None, *rest) for part, *rest in lists]
        if compact or fresh.any():
            kept = slice(None) if compact else fresh
            rows.append(_run_row(bucket, buckets, prints[kept], docs[kept], kinds[kept]))
        if rows:
            yield _table(_RUN_ARROW, rows)


def _later(new: np.ndarray, docs: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Which rows lie behind a row of their group that has a smaller doc_id; groups are sorted by ``none``, then doc."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return ~none[first] & (none | (docs > docs[first]))


def _mark_windows(batches, window: int, gram: int, buckets: int):
    for batch in _chunks(batches):
        docs, keys = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 2))
        nones = np.array(batch.column(1).to_pylist(), bool)
        parts = []
        for a, b in slices(batch.column(3), 1 << 20):
            w = Windows(batch.column(3).slice(a, b - a), window, gram)
            bounds = np.searchsorted(w.doc[w.at], np.arange(b - a + 1))
            wanted = []
            for i, found in enumerate(batch.column(4).slice(a, b - a).to_pylist()):
                own = slice(bounds[i], bounds[i + 1])
                if bounds[i] < bounds[i + 1]:
                    wanted.append(bounds[i] + np.flatnonzero(np.isin(_proposed(w.print[own]), np.frombuffer(found, "<u4"))))
            wanted = w.at[np.concatenate(wanted)] if wanted else np.empty(0, np.int64)
            if len(wanted):
                doc = w.doc[wanted]
                parts.append((*w.content(wanted), (wanted - w.first_words()[doc]).astype(np.uint32), doc + a))
        if not parts:
            continue
        content, check, place, owner = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((docs[owner], nones[owner], check, content))
        content, check, place, owner = content[order], check[order], place[order], owner[order]
        later = _later(_first(content, check), docs[owner], nones[owner])  # a smaller doc_id of this batch has the window
        lists = _lists(docs[owner[later]], keys[owner[later]], place[later], buckets)
        rows = [(part, None, None, None, *rest) for part, *rest in lists]
        content, check, place, owner = (x[~later] for x in (content, check, place, owner))
        for bucket, at in _by_owner((content % _U(buckets)).astype(np.int64), np.arange(len(content))):
            at = at[np.lexsort((place[at], owner[at]))]
            held, counts = np.unique(owner[at], return_counts=True)
            rows.append(
                (bucket, content[at].tobytes(), check[at].tobytes(), _halves(place[at]), docs[held].tobytes(), keys[held].tobytes(), _halves(counts), None)
            )
        yield _table(_MARKS_ARROW, rows)


def _settle_windows(batches, lists: int):
    """Lists of the first words of each document's windows that a document with a smaller doc_id has."""
    parts = []
    for batch in batches:
        for content, check, place, doc, key, count in zip(*(batch.column(i).to_pylist() for i in range(1, 7))):
            if content is not None:
                count = _whole(count)
                parts.append(
                    (np.frombuffer(content, np.uint64), np.frombuffer(check, np.uint32), _whole(place),
                     np.repeat(np.frombuffer(doc, np.int64), count), np.repeat(np.frombuffer(key, np.int64), count))
                )
        yield from _passed_on(batch, [4, 5, 6, 7])
    if not parts:
        return
    content, check, place, doc, key = (np.concatenate(x) for x in zip(*parts))
    del parts
    none = doc == key  # a null doc_id's doc is its text_key; a doc_id that equals its text's hash has a chance of 2**-64
    order = np.lexsort((doc, none, check, content))
    content, check, doc, none = content[order], check[order], doc[order], none[order]
    later = _later(_first(content, check), doc, none)
    if later.any():
        yield _table(_LISTS_ARROW, _lists(doc[later], key[order][later], place[order][later], lists))


def _remove(batches, window: int):
    for batch in batches:
        out = ([], [], [], [])
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = text.encode().split()  # of bytes, split() cuts at the six white space characters alone
            n = len(words)
            if found:
                step = np.zeros(n + 1, np.int64)
                starts = np.unique(np.frombuffer(b"".join(found), "<u4")).astype(np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + window, -1)
                gone = np.cumsum(step[:n]) > 0
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            for column, value in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3])],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


#: Bytes of input for each task that merges runs or windows, where that gives more tasks than the session's number.
_BYTES_A_TASK = 8 << 20


class FingerprintIndex:
    """Immutable runs below one folder, ``most_runs`` at most.  ``buckets`` is set by the first batch and stays."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 13, gram: int = 5, buckets: int | None = None, most_runs: int = 1):
        self.spark, self.path, self.window, self.gram = spark, path or scratch(spark, "fingerprints"), window, gram
        self.buckets, self.most_runs = buckets, most_runs
        self.runs: list[str] = []
        self._written = 0

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch of ``docs``: doc (not null), none (whether doc stands for a null) and text; its doc_ids may lie before or
        behind those of earlier batches.  Lists of the fingerprints that it shares with documents of any batch, of both."""
        self.buckets = self.buckets or tasks_for(docs, _BYTES_A_TASK)
        window, gram, buckets = self.window, self.gram, self.buckets
        new = docs.select("doc", "none", "text").mapInArrow(lambda b: _write_run(b, window, gram, buckets), _RUN)
        return self._pass(new, len(self.runs) >= self.most_runs)

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            self._pass(None, True)

    def _pass(self, new: DataFrame | None, compact: bool) -> DataFrame:
        path, buckets, old = f"{self.path}/run-{self._written:06d}", self.buckets, self.runs
        self._written += 1
        both = None if new is None else new.withColumn("fresh", F.lit(True))
        if old:
            rows = self._read(*old).filter("kind = 'entries'").drop("kind").withColumn("fresh", F.lit(False))
            both = rows if both is None else both.unionByName(rows)
        joined = both.repartition(buckets, "bucket").mapInArrow(lambda b: _join_batch(b, buckets, compact), _RUN)
        kind = F.when(F.col("prints").isNull(), "lists").otherwise("entries")
        joined.withColumn("kind", kind).write.partitionBy("kind").parquet(path)
        self.runs = [path] if compact else [*old, path]
        for replaced in old if compact else []:
            delete(self.spark, f"{replaced}/kind=entries")
        return self._read(path).filter("kind = 'lists'").select(F.col("bucket").alias("part"), "docs", F.col("texts"), "counts", "found")

    def _read(self, *paths: str) -> DataFrame:
        tables = [self.spark.read.schema(f"{_RUN}, kind string").parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, tables)


def assembled(lists: DataFrame, parts: int, kind: str = "<u4") -> DataFrame:
    return lists.repartition(parts, "part").mapInArrow(lambda b: _assemble(b, kind), "doc long, text_key long, found binary")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with what tells them apart: ``doc`` is doc_id, or where that is null (``none``) the hash of the text."""
    text = F.coalesce("text", F.lit(""))
    key, doc = F.xxhash64(text), F.col("doc_id").cast("long")
    return docs.select("doc_id", F.coalesce(doc, key).alias("doc"), doc.isNull().alias("none"), key.alias("text_key"), text.alias("text"))


def remove_repeats(
    docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, batches: int = 2
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of ``docs`` (doc_id, text).

    ``index`` holds the runs of earlier batches and ``history`` their documents, which are read again only where a
    fingerprint matches; ``docs`` is added to the index in ``batches`` by ranges of doc_id, each merge-joined with the runs
    before it, which are compacted on the way.  Null texts have no words.  A null doc_id is smaller than none, so its words can be removed
    but remove no others; rows with one doc_id don't remove each other's words (they share a task, as a doc_id is meant
    for one row; rows without one are spread by their text).  Windows are judged on the input, not on what is left.
    Other columns are ignored, whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    index = index or FingerprintIndex(spark)
    source = keyed(docs)
    wanted = [i / batches for i in range(1, batches)]
    cuts = source.filter("not none").approxQuantile("doc", wanted, 0.05) if wanted else []
    bounds = [None, *sorted({min(int(c), 2**63 - 1) for c in cuts}), None]
    lists = None
    for low, high in zip(bounds[:-1], bounds[1:]):
        part = source if low is None else source.filter(F.col("doc") >= low)
        found = index.add(part if high is None else part.filter(F.col("doc") < high))
        lists = found if lists is None else lists.unionByName(found)
    everything = source if history is None else source.unionByName(keyed(history))
    window, gram, parts = index.window, index.gram, index.buckets
    # With the same columns on both ways, the exchange of the texts by doc is made once for this and for the removal.
    by_doc = everything.repartition(parts, "doc", "none")
    matches = assembled(lists, parts).select("doc", (F.col("text_key") == _NONE).alias("none"), "found")
    marked = by_doc.join(matches.repartition(parts, "doc", "none"), ["doc", "none"]).select("doc", "none", "text_key", "text", "found", "doc_id")
    marked = marked.mapInArrow(lambda b: _mark_windows(b, window, gram, parts), _MARKS)
    settled = marked.repartition(parts, "bucket").mapInArrow(lambda b: _settle_windows(b, parts), _LISTS)
    # Grouped and joined by doc alone, so that the texts stay where they are; rows of one doc_id are told apart afterwards.
    removed = assembled(settled, parts).withColumn("none", F.col("doc") == F.col("text_key"))
    removed = removed.repartition(parts, "doc", "none").groupBy("doc", "none").agg(F.collect_list(F.struct("text_key", "found")).alias("marks"))
    joined = source.repartition(parts, "doc", "none").join(removed, ["doc", "none"], "left")
    mine = F.filter("marks", lambda m: m["text_key"] == F.col("text_key"))
    joined = joined.withColumn("found", F.transform(mine, lambda m: m["found"]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return joined.select("doc_id", "text", "found").mapInArrow(lambda b: _remove(b, window), schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``remove_repeats``: null and empty texts have no words, an empty table gives no rows."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (
  SELECT doc_id, w, len(w) AS n FROM split),
starts AS (
  SELECT doc_id, n, unnest(range(1, n - 11)) AS i, w FROM words WHERE n >= 13),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM starts),
firsts AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM windows),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM firsts WHERE first_doc < doc_id),
gone_lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, CAST(len(coalesce(g.ps, [])) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, d.n + 1), lambda p: NOT list_contains(coalesce(g.ps, []), p)), lambda p: d.w[p]), ' '), '')) AS kept_sha256
FROM words d LEFT JOIN gone_lists g ON d.doc_id = g.doc_id
"""
