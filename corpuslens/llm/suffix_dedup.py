"""Removal of repeated byte strings on suffix arrays that are sorted shard by shard.

Shards are cut by content, so that all copies of a string meet in one: every window of 50 bytes belongs to the smallest hash of its
grams of 20 bytes, and windows side by side that share it form one stretch of text.  Only windows whose hash two
documents have can repeat; their stretches are dealt to shards by that hash.  A shard first discards the windows whose own hash its
stretches have once.  Stretches of what is left are one text, whose suffixes are put in order by external induced sorting
(``induced_sort``), and neighbours that share 50 bytes or more are one group.  A window is marked if its group has a document with
a smaller doc_id, and the bytes under marked windows go.

The hashes only decide what is compared, never whether it is equal: results are exact.  Equal stretches of a chunk of documents
are settled in the chunk, which sends one of them on, and those of a shard are in its text once.  Where very many documents share a passage, the stretches at its ends all
differ but share their hash; windows of hashes that very many chunks have are therefore dealt one by one, by all their bytes."""

from __future__ import annotations

import hashlib
import itertools
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import release, ship, slices, stored, table, tasks_for
from corpuslens.llm._vectors import Texts, gram_hashes, sliding_min, span_hashes
from corpuslens.llm.induced_sort import Buckets, Sorter, room
from corpuslens.llm.substring_dedup import (
    _BYTES_A_TASK, _LISTS, _LISTS_ARROW, _NONE, _RUN, _SEVERAL, _by_owner, _chunks, _entries, _first, _lists, _merged, _passed_on, _proposed, _shared, _table, _write_run,
    assembled, keyed,
)

#: Bytes of a hashed gram.  Shorter ones are shared by chance more often, longer ones cut stretches shorter.
_GRAM = 20
#: Places whose grams are hashed at once.
_BLOCK = 1 << 15
#: A hash that so many chunks or single documents of different chunks have may be hot; so many of the most frequent are.
_HOT_ENTRIES, _MOST_HOT = 64, 1000
_U = np.uint64
#: Texts of stretches, many alike, are packed for the exchange.
_CODEC = pa.Codec("zstd", compression_level=1)
#: Bytes of a shard's text that are hashed at once; slots of a table of hashes are 2 ** _MOST_BITS at most.
_SLICE, _MOST_BITS = 1 << 20, 25
#: Shards for each task's share of the input.  Each chunk of text sends a row to each shard, so fewer shards are fewer rows.
_SHARDS = 1

_PIECES = "bucket int, texts binary, sizes binary, starts binary, owners binary, docs binary, nones binary, keys binary, part_docs binary, part_texts binary, counts binary, found binary"
_PIECES_ARROW = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in _PIECES.replace(",", "").split()[2::2]]])
#: What becomes of a byte in a shard's text: 0 ends it, 1 parts stretches; UTF-8 has no byte above 0xF4.
_CODES = bytes(min(b + 2, 255) for b in range(256))


class ByteWindows:
    """Windows of bytes of some texts: ``at`` (first byte), ``print`` (least hash of a gram), and ``doc`` of each byte."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.texts = Texts(column)
        n = len(self.texts.data) - window + 1
        self.doc = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(self.texts.bounds))
        if n <= 0:
            self.at, self.print = np.empty(0, np.int64), np.empty(0, np.uint64)
            return
        least = np.empty(n, np.uint64)
        for a in range(0, n, _BLOCK):  # small enough for the processor's cache
            b = min(n, a + _BLOCK)
            least[a:b] = sliding_min(gram_hashes(self.texts.data[a : b + window - 1], gram), window - gram + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :])
        self.print = least[self.at]


def _merge_prints(batches, parts: int):
    """Lists of the hashes of each document that another one has as well, and (bucket -1) hashes of very many entries."""
    runs = []
    for batch in batches:
        runs += [_entries(parts, *x) for x in zip(*(batch.column(i).to_pylist() for i in range(5))) if x[1] is not None]
        yield from _passed_on(batch, [3, 4, 5, 6])
    if not runs:
        return
    prints, docs, kinds = _merged(runs)
    first = np.flatnonzero(_first(prints))
    size = np.diff(np.append(first, len(prints)))
    shared = np.repeat(_shared(kinds, docs, first), size) & (kinds != _SEVERAL)
    rows = _lists(docs[shared], kinds[shared].astype(np.int64), _proposed(prints[shared]), parts) if shared.any() else []
    often = first[size >= _HOT_ENTRIES]
    if len(often):
        rows.append((-1, None, None, size[size >= _HOT_ENTRIES].astype("<i8").tobytes(), prints[often].astype("<u8").tobytes()))
    del runs, prints, docs, kinds, shared
    if rows:
        yield _table(_LISTS_ARROW, rows)
    release()


def _hot(lists: DataFrame) -> np.ndarray:
    """The most frequent of the hashes with very many entries: at most _MOST_HOT numbers, which steer what a task gets, not the result."""

    def run(batches):
        for batch in batches:
            for counts, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(prints, "<i8")), pa.array(np.frombuffer(counts, "<i8"))], ["print", "n"])

    rows = lists.filter("part = -1").select("counts", "found").mapInArrow(run, "print long, n long").orderBy(F.desc("n"), "print").limit(_MOST_HOT).collect()
    return np.array(sorted(np.uint64(r["print"] & (2**64 - 1)) for r in rows), np.uint64)


def _stretches(batches, window: int, hot: np.ndarray, shards: int, parts: int):
    """Stretches of windows that may repeat, dealt by their hash; lists of what this chunk has settled: (start << 32 | windows)."""
    for batch in _chunks(batches):
        docs, keys = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 2))
        nones = np.array(batch.column(1).to_pylist(), bool)
        found, texts = [], []  # of each stretch (owner, first byte in its text, windows, bucket), and its bytes
        rank = np.empty(len(docs), np.int64)
        order = np.lexsort((docs, nones))
        rank[order] = np.cumsum(_first(docs[order], nones[order]))
        least_none = int(rank[nones].min()) if nones.any() else 1 << 62
        for a, b in slices(batch.column(3), 1 << 20):
            w = ByteWindows(batch.column(3).slice(a, b - a), window, _GRAM)
            if not len(w.at):
                continue
            doc = w.doc[w.at]
            first = np.flatnonzero(_first(w.print, doc))
            shared = batch.column(4).slice(a, b - a).to_pylist()
            keys_of = np.repeat(np.arange(b - a, dtype=np.uint64), [len(x) // 4 for x in shared]) << _U(32) | np.frombuffer(b"".join(shared), "<u4")
            wanted = np.isin(doc[first].astype(np.uint64) << _U(32) | _proposed(w.print[first]), keys_of)
            count = np.diff(np.append(first, len(doc)))[wanted]
            first = first[wanted]
            lone = np.isin(w.print[first], hot)
            row = np.repeat(np.arange(len(first)), np.where(lone, count, 1))
            inner = _ranges(np.where(lone, count, 1))
            first, count, lone = first[row] + inner, np.where(lone, 1, count)[row], lone[row]
            owner, start, raw = doc[first], w.at[first], w.texts.data.tobytes()
            mine = [raw[x:y] for x, y in zip(start.tolist(), (start + count + window - 1).tolist())]
            bucket = (w.print[first] % _U(shards)).astype(np.int64)
            bucket[lone] = [zlib.crc32(mine[i]) % shards for i in np.flatnonzero(lone).tolist()]
            texts += mine
            found.append((owner + a, start - w.texts.bounds[owner], count, bucket))
        if not texts:
            continue
        owner, start, count, bucket = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(rank[owner], kind="stable")  # the smallest doc_id first, rows without one last
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(texts[i], len(known)) for i in order.tolist()])
        del known
        ranks = rank[owner[order]]
        held = ranks[np.unique(number, return_index=True)[1]][number]  # the first that has the same bytes
        alone = (held < ranks) & (held < least_none)
        settled, order = order[alone], order[~alone]
        rows = []
        if len(settled):
            who, values = owner[settled], start[settled].astype(np.uint64) << _U(32) | count[settled].astype(np.uint64)
            rows += [(part, *[None] * 7, *rest) for part, *rest in _lists(docs[who], keys[who], values, parts)]
        for k, at in _by_owner(bucket[order], order):
            who, owners = np.unique(owner[at], return_inverse=True)
            text = _CODEC.compress(b"".join([texts[i] for i in at.tolist()]), asbytes=True)
            columns = count[at] + window - 1, start[at], owners
            rows.append((k, text, *(x.astype("<u4").tobytes() for x in columns), docs[who].tobytes(), nones[who].tobytes(), keys[who].tobytes(), *[None] * 4))
        del found, texts
        if rows:
            yield _table(_PIECES_ARROW, rows)
        release()


def _pieces(bounds: np.ndarray, most: int):
    """Ranges (a, b) of parts that lie between ``bounds``, of about ``most`` in all, or one part."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... of each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Shard:
    """The stretches of one shard as one text on disk, each once as far as ``bound`` bytes of them are remembered, and who holds them."""

    def __init__(self, window: int, bound: int):
        self.window, self.bound, self.file = window, bound, tempfile.TemporaryFile()
        self.known: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.held = [[] for _ in range(6)]  # of each row: stretch, start and owner of every holder; doc, none and key of every owner
        self.n_docs = self.n_bytes = 0

    def add(self, texts: bytes, sizes: bytes, starts: bytes, owners: bytes, docs: bytes, nones: bytes, keys: bytes) -> None:
        size = np.frombuffer(sizes, "<u4").astype(np.int64)
        ends, known, before = np.cumsum(size), self.known, len(self.sizes)
        coded = _CODEC.decompress(texts, int(ends[-1]), asbytes=True).translate(_CODES)
        stretches = [coded[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]
        if self.n_bytes < self.bound:
            number = np.array([known.setdefault(x, len(known)) for x in stretches])
        else:
            fresh = itertools.count(before)
            number = np.array([next(fresh) if (found := known.get(x)) is None else found for x in stretches])
        at, first = np.unique(number, return_index=True)
        new = first[np.searchsorted(at, before) :]
        self.file.write(b"".join([stretches[i] + b"\x01" for i in new.tolist()]))
        self.sizes += size[new].tolist()
        self.n_bytes += int(size[new].sum())
        docs = np.frombuffer(docs, np.int64)
        columns = number, np.frombuffer(starts, "<u4"), np.frombuffer(owners, "<u4") + np.int64(self.n_docs), docs, np.frombuffer(nones, bool), np.frombuffer(keys, np.int64)
        for column, values in zip(self.held, columns):
            column.append(values)
        self.n_docs += len(docs)

    def _repeated(self, text: np.ndarray, bounds: np.ndarray, bound: int) -> np.ndarray:
        """Places of the windows whose hash the shard's text has more than once, ascending; a few others may be among them."""
        total, n, done = int((bounds[1:] - bounds[:-1] - self.window).sum()), int(bounds[-1]), 0
        places, hashes = room(total, np.uint32, bound), room(total, np.uint64, bound)
        for a in range(0, n, _SLICE):
            part = np.asarray(text[a : min(n, a + _SLICE) + self.window - 1])
            ends = np.concatenate([[0], np.cumsum(part == 1, dtype=np.int32)])
            at = np.flatnonzero(ends[self.window :] == ends[: -self.window])
            places[done : done + len(at)], hashes[done : done + len(at)] = at + a, span_hashes(part, at, at + self.window)
            done += len(at)
        bits = min((2 * total).bit_length(), _MOST_BITS)
        for shift in (64 - bits, (64 - bits) // 2, 0):  # each time other bits of what is left
            seen, again = (np.zeros(1 << bits, bool) for _ in range(2))
            slot = lambda a: ((hashes[a : min(done, a + _SLICE)] >> _U(shift)) & _U((1 << bits) - 1)).astype(np.uint32)  # noqa: B023, E731
            for a in range(0, done, _SLICE):
                mine = slot(a)
                order = np.sort(mine)
                again[order[1:][order[1:] == order[:-1]]] = True
                again[mine[seen[mine]]] = True
                seen[mine] = True
            left = 0
            for a in range(0, done, _SLICE):
                kept = a + np.flatnonzero(again[slot(a)])
                places[left : left + len(kept)], hashes[left : left + len(kept)] = places[kept], hashes[kept]
                left += len(kept)
            done = left
        return places[:done]

    def marked(self, most: int, bound: int):
        """(docs, keys, start << 32 | windows) of windows that a document with a smaller doc_id has too."""
        self.known.clear()
        stretch, starts, owners, docs, nones, keys = (np.concatenate(x) for x in self.held)
        self.held.clear()
        sizes = np.array(self.sizes, np.int64)
        order = np.lexsort((docs, nones))
        rank = np.empty(len(docs), np.int32)
        rank[order] = np.cumsum(_first(docs[order], nones[order]))
        least_none = int(rank[nones].min()) if nones.any() else np.iinfo(np.int32).max
        smallest = np.full(len(sizes), np.iinfo(np.int32).max, np.int32)  # of each stretch, the least rank of its holders
        np.minimum.at(smallest, stretch, rank[owners])
        places, counts = self._lowered(sizes, smallest, least_none, most, bound)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        low = np.searchsorted(places, bounds)  # spans of each stretch
        for a in range(0, len(stretch), 1 << 16):
            k, who, start = stretch[a : a + (1 << 16)], owners[a : a + (1 << 16)], starts[a : a + (1 << 16)].astype(np.int64)
            whole = (rank[who] > smallest[k]) & (smallest[k] < least_none)  # another holder removes all windows
            rest = np.flatnonzero(~whole & (low[k + 1] > low[k]))
            number = low[k[rest] + 1] - low[k[rest]]
            row = np.repeat(rest, number)
            span = low[k[row]] + _ranges(number)
            at = np.concatenate([np.flatnonzero(whole), row])
            if not len(at):
                continue
            first = np.concatenate([start[whole], start[row] + places[span] - bounds[k[row]]])
            count = np.concatenate([sizes[k[whole]] - self.window + 1, counts[span]])
            yield docs[who[at]], keys[who[at]], (first.astype(np.uint64) << _U(32)) | count.astype(np.uint64)

    def _lowered(self, sizes: np.ndarray, smallest: np.ndarray, least_none: int, most: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Spans of windows (first place in the shard's text, windows; ascending) that a document of smaller rank has in another stretch
        than those that hold them.  Only windows whose hash the text has more than once are sorted: the others are alone, as equal
        windows have equal hashes."""
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.file.write(b"\0" * (1 + self.window))
        self.file.flush()
        text = np.memmap(self.file, np.uint8, "r", shape=(int(bounds[-1]) + 1 + self.window,))
        places = self._repeated(text, bounds, bound)
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(places):
            return nothing
        # Windows side by side are one run; runs that touch the end of a slice may be cut, as any stretch may.
        begin = np.flatnonzero(_first(places - np.arange(len(places), dtype=np.uint32)))
        runs, windows = places[begin].astype(np.int64), np.diff(np.append(begin, len(places)))
        del places
        run_bounds = np.concatenate([[0], np.cumsum(windows + self.window)])
        holder = np.searchsorted(bounds, runs, side="right") - 1
        file, first = tempfile.TemporaryFile(), room(int(run_bounds[-1]), np.int32, bound)  # of each window, the least rank of all that have it
        for a, b in _pieces(run_bounds, _SLICE):
            size = windows[a:b] + self.window
            part = text[np.repeat(runs[a:b] - run_bounds[a:b], size) + np.arange(run_bounds[a], run_bounds[b])]
            part[run_bounds[a + 1 : b + 1] - run_bounds[a] - 1] = 1
            file.write(part.tobytes())
            first[run_bounds[a] : run_bounds[b]] = np.repeat(smallest[holder[a:b]], size)
        file.write(b"\0" * (1 + self.window))
        file.flush()
        text = np.memmap(file, np.uint8, "r", shape=(int(run_bounds[-1]) + 1 + self.window,))
        groups, minima, state = Buckets(1, bound), [], {"group": -1, "held": None}

        def keep(pos, group):
            inside = pos + self.window < run_bounds[np.searchsorted(run_bounds, pos, side="right")]  # else the window holds the end of its run
            pos, group = pos[inside], group[inside]
            if not len(pos):
                return
            begin = np.flatnonzero(_first(group))
            least = np.minimum.reduceat(first[pos], begin)
            if minima and minima[-1][0][-1] == group[0]:  # a group that the last piece began
                least[0] = min(least[0], minima[-1][1][-1])
            minima.append((group[begin], least))
            groups.put(0, pos.astype(np.uint32), group.astype(np.uint32), np.zeros(len(pos), np.uint8))

        def out(pos, shared):
            pos, same = pos.astype(np.int64), shared >= self.window
            if state["held"] is not None:
                pos, same = np.append(state["held"][0], pos), np.append(state["held"][1], same)
            group = state["group"] + np.cumsum(~same)
            if state["held"] is not None and not state["held"][1]:
                group -= 1  # the held one has its number already
            kept = same[:-1] | same[1:]
            keep(pos[:-1][kept], group[:-1][kept])
            state["held"], state["group"] = (pos[-1:], same[-1:]), int(group[-1])

        Sorter(self.window, most, bound).descending(text, 256, out)
        if state["held"] is not None and state["held"][1][0]:
            keep(state["held"][0], np.array([state["group"]]))
        if not minima:
            return nothing
        number, least = (np.concatenate(x) for x in zip(*minima))
        found = []
        for pos, group, _ in groups.take(0, most):  # of a group in several pieces, the last one has its least
            pos = pos.astype(np.int64)
            run = np.searchsorted(run_bounds, pos, side="right") - 1
            lower = least[np.searchsorted(number, group, side="right") - 1] < np.minimum(smallest[holder[run]], least_none)
            found.append((runs[run] + pos - run_bounds[run])[lower])
        places = np.sort(np.concatenate(found))
        begin = np.flatnonzero(_first(places - np.arange(len(places))))
        return places[begin], np.diff(np.append(begin, len(places)))


def _sort_shards(batches, window: int, lists: int, most: int, bound: int):
    shard = None
    for batch in batches:
        settled = batch.column(1).is_null()
        if settled.true_count:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(settled), *[batch.column(c).filter(settled) for c in range(8, 12)]], schema=_LISTS_ARROW)
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
            if row[0] is not None:
                shard = shard or Shard(window, bound)
                shard.add(*row)
    if shard:
        for docs, keys, values in shard.marked(most, bound):
            yield _table(_LISTS_ARROW, _lists(docs, keys, values, lists))
    release()


def _cut(batches, window: int):
    for batch in batches:
        for low, high in slices(batch.column(1), 4 << 20):
            part, out = batch.slice(low, high - low), ([], [], [], [], [])
            for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw, removed, spans = text.encode(), 0, 0
                n = len(raw)
                if found:
                    values = np.frombuffer(b"".join(found), "<u8")
                    first, count = (values >> _U(32)).astype(np.int64), (values & _U(0xFFFFFFFF)).astype(np.int64)
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + count + window - 1, -1)
                    gone = np.cumsum(step[:n]) > 0
                    removed, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (n, removed, spans, hashlib.sha256(raw).hexdigest(), raw)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )
    release()


def remove_repeated_bytes(docs: DataFrame, window: int = 50, most: int = 1 << 18, bound: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every row of ``docs`` (doc_id, text).

    Bytes go that are covered by a string of ``window`` bytes of UTF-8 that also starts in a document with a smaller doc_id; strings
    are judged on the input, not on what is left, and lie in one text.  Null texts are empty.  A null doc_id is smaller than none, so
    its bytes can be removed but remove no others; rows of one doc_id don't remove each other's.  Other columns are ignored,
    whatever their names; an empty table gives no rows.  ``window`` is more than 20 and at most 250.  A shard's task holds pieces of
    ``most`` suffixes and ``bound`` bytes of waiting ones in memory, the rest on its own disk while it sorts; a shard has less than
    4 GB of text."""
    if not _GRAM < window <= 250:
        raise ValueError(f"window must be more than {_GRAM} and at most 250")
    spark = docs.sparkSession
    ship(spark)
    source, parts = keyed(docs), tasks_for(docs, _BYTES_A_TASK)
    prints = source.select("doc", "none", "text").mapInArrow(lambda b: _write_run(b, window, _GRAM, parts, ByteWindows), _RUN)
    lists = stored(prints.repartitionById(parts, F.col("bucket")).mapInArrow(lambda b: _merge_prints(b, parts), _LISTS), "prints")
    hot = _hot(lists)
    shared = assembled(lists.filter("part >= 0"), parts).select("doc", (F.col("text_key") == _NONE).alias("none"), "found")
    # With the same columns on both ways, the exchange of the texts by doc is made once for this and for the removal.
    by_doc = source.repartition(parts, "doc", "none")
    wanted = by_doc.join(shared.repartition(parts, "doc", "none"), ["doc", "none"]).select("doc", "none", "text_key", "text", "found", "doc_id")
    shards = _SHARDS * parts
    pieces = wanted.mapInArrow(lambda b: _stretches(b, window, hot, shards, parts), _PIECES)
    marked = pieces.repartitionById(shards, F.col("bucket")).mapInArrow(lambda b: _sort_shards(b, window, parts, most, bound), _LISTS)
    marks = assembled(marked, parts, "<u8").withColumn("none", F.col("doc") == F.col("text_key"))
    marks = marks.repartition(parts, "doc", "none").groupBy("doc", "none").agg(F.collect_list(F.struct("text_key", "found")).alias("marks"))
    joined = source.repartition(parts, "doc", "none").join(marks, ["doc", "none"], "left")
    mine = F.filter("marks", lambda m: m["text_key"] == F.col("text_key"))
    joined = joined.withColumn("found", F.transform(mine, lambda m: m["found"]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "found").mapInArrow(lambda b: _cut(b, window), schema)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``remove_repeated_bytes``: null and empty texts have no bytes, an empty table gives no rows."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


OP12_SQL = """
WITH coded AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM coded),
blocks AS (
  SELECT doc_id, n, unnest(range(0, greatest(n, 1), 256)) AS base, h FROM sized),
pieces AS (
  SELECT doc_id, n, base, substr(h, 2 * base + 1, 2 * (256 + 49)) AS piece FROM blocks),
starts AS (
  SELECT doc_id, n, base, piece, unnest(range(0, greatest(least(256, n - 49 - base), 0))) AS i FROM pieces),
windows AS (
  SELECT doc_id, n, base + i AS i, md5(substr(piece, 2 * i + 1, 100)) AS w FROM starts),
firsts AS (
  SELECT w, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM windows GROUP BY w),
later AS (
  SELECT x.doc_id, x.n, x.i FROM windows x JOIN firsts f ON x.w = f.w WHERE f.first_doc < x.doc_id),
steps AS (
  SELECT doc_id, n, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM later),
numbered AS (
  SELECT doc_id, n, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps),
spans AS (
  SELECT doc_id, n, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, n, span),
gaps AS (
  SELECT doc_id, span, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY span), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(span) + 1, max(b), max(n) FROM spans GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, string_agg(substr(s.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.span) AS h FROM gaps g JOIN sized s ON g.doc_id = s.doc_id GROUP BY g.doc_id),
totals AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_bytes, coalesce(t.removed, 0) AS n_removed, CAST(coalesce(t.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, s.h))) AS kept_sha256
FROM sized s LEFT JOIN totals t ON s.doc_id = t.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
