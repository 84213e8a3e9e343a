"""Periodic runs of words: stretches that repeat a phrase over and over, found by names of power-of-two windows.

Level 0 names every word, and level k + 1 names a window of 2**(k + 1) words by the pair of names of its halves, so two
windows have one name if and only if their words are the same.  A run that repeats a phrase of q words at least four times
holds a point of the grid 0, q, 2q, ... from which two neighbouring stretches of 2**k <= q words are the same, one phrase
apart.  All points of all grids are n log n together; those that pass two comparisons of names are extended to both sides
by the longest common extension, which goes down the levels.  Nothing is hashed and no suffixes are sorted."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import release, ship, slices, table

#: A phrase has to be repeated so often: the grid's points rest on it.
LEAST_TIMES = 4


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... of each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Names:
    """Names of all windows of 2**k words of some texts.  ``bounds[i]:bounds[i + 1]`` are the words of text i.  A level holds
    the windows of the texts that are at least LEAST_TIMES times as long; -1 stands where there is none."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.sizes, self.starts = np.diff(bounds), bounds[:-1]
        self.levels = [words.astype(np.int32)]
        while (long := np.flatnonzero(self.sizes >= LEAST_TIMES << len(self.levels))).size:
            half = 1 << (len(self.levels) - 1)
            count = self.sizes[long] - 2 * half + 1
            at = np.repeat(self.starts[long], count) + _ranges(count)
            below = self.levels[-1]
            pair = below[at].astype(np.int64) << 32 | below[at + half]
            level = np.full(len(words), -1, np.int32)
            level[at] = np.unique(pair, return_inverse=True)[1]
            self.levels.append(level)

    def extension(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i and j on (or, ``back``, before them) are the same, ``room`` at most."""
        size = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            width, level = 1 << k, self.levels[k]
            active = np.flatnonzero(size + width <= room)
            while active.size:  # once a level, but for the highest one that a text has
                step = -size[active] - width if back else size[active]
                a, b = level[i[active] + step], level[j[active] + step]
                active = active[(a == b) & (a >= 0)]
                size[active] += width
                active = active[size[active] + width <= room[active]]
        return size

    def runs(self, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start in the text, length, smallest period) of every run, sorted."""
        found = []
        for k, level in enumerate(self.levels):
            text = np.flatnonzero(self.sizes >= LEAST_TIMES << k)
            periods = np.minimum((2 << k) - 1, self.sizes[text] // LEAST_TIMES) - (1 << k) + 1
            text, q = np.repeat(text, periods), _ranges(periods) + (1 << k)
            points = (self.sizes[text] - 2 * q - (1 << k)) // q + 1
            text, q, step = np.repeat(text, points), np.repeat(q, points), _ranges(points)
            at = self.starts[text] + step * q
            name = level[at + q]
            same = np.flatnonzero((level[at] == name) & (name == level[at + 2 * q]) & (name >= 0))
            text, q, at = text[same], q[same], at[same]
            first = self.starts[text]
            before = self.extension(at, at + q, at - first, back=True)
            length = before + q + self.extension(at, at + q, first + self.sizes[text] - at - q)
            good = length >= np.maximum(least_length, LEAST_TIMES * q)
            found.append(np.stack([text, at - before - first, length, q])[:, good])
        text, start, length, q = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        order = np.lexsort((q, length, start, text))  # the smallest period of one stretch comes first
        text, start, length, q = text[order], start[order], length[order], q[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        text, start, length, q = text[new], start[new], length[new], q[new]
        order = np.lexsort((q, start, text))
        return text[order], start[order], length[order], q[order]


def _answer(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    runs = list(zip(start.tolist(), length.tolist(), period.tolist()))
    kept = words
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, start + period, 1)
        np.add.at(step, start + length, -1)
        kept = [w for w, n in zip(words, np.cumsum(step[:-1]).tolist()) if not n]
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    collapsed = b" ".join(kept)
    exponent = 1000 * longest[1] // longest[2] if runs else None
    return len(runs), *longest, exponent, listed, hashlib.sha256(collapsed).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed.decode()


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_COLUMNS = [
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", _RUNS), ("collapsed_text", pa.string()),
]


def find_runs(docs: DataFrame, least_length: int = 6, rewrite: Callable[[int | str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests, runs and collapsed_text of every row.

    A run is a stretch of words that repeats its smallest period of q words, ``max(least_length, 4 * q)`` words long or longer,
    and can't be extended on either side.  Of runs of equal length the first, then that of smaller period is the longest;
    without runs the four are null.  ``collapsed_text`` has the words that no run holds after its first period, joined by a
    space.  ``rewrite`` may change a text's words before (given doc_id and words).  Null and empty texts have no words and no
    runs; null and repeated doc_ids are answered row by row, other columns are ignored, an empty table gives no rows.
    Texts are whole: a task holds one slice of a megabyte of texts, or one longer text, with 4 bytes a word and level."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(a, b - a)
                split = [(x or "").encode().split() for x in batch.column(1).slice(a, b - a).to_pylist()]  # of bytes: at the six white space characters
                if rewrite:
                    split = [rewrite(i, w) for i, w in zip(ids.to_pylist(), split)]
                bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])])
                words = pa.array([w for text in split for w in text], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                text, start, length, period = Names(words, bounds).runs(least_length)
                cut = np.searchsorted(text, np.arange(len(split) + 1))
                rows = [_answer(w, start[x:y], length[x:y], period[x:y]) for w, x, y in zip(split, cut[:-1], cut[1:])]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *(c for c, _ in _COLUMNS)])
        release()

    schema = (
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    )
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def repeated_from(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the tail of every tenth text made periodic, by the CRC-32 of its doc_id; rows without one stay."""
    if doc_id is None or not words:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``find_runs`` on words of which every tenth document's tail is made periodic: null and
    empty texts have no words, rows without a doc_id stay as they are, an empty table gives no rows."""
    return find_runs(table(spark, sf_dir, "documents"), rewrite=repeated_from).drop("runs", "collapsed_text")


#: CRC-32 of a list of bytes, by its table; ``{bytes}`` is an expression.
CRC_TABLE = """
steps AS (
  SELECT list(list_reduce(list_concat([CAST(b AS BIGINT)], CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc
  FROM range(256) t(b))"""
CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, x: xor(c // 256, steps.crc[(xor(c, x) & 255) + 1])), 4294967295)"

OP13_SQL = f"""
WITH {CRC_TABLE},
split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
coded AS (
  SELECT doc_id, w, len(w) AS n, {CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")} AS h FROM split, steps),
tails AS (
  SELECT doc_id, w, n, h, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM coded),
phrases AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM tails),
changed AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM phrases),
words AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM changed),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT doc_id, s, n, min(q) AS q FROM stretches GROUP BY doc_id, s, n),
listed AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS digest,
    first(struct_pack(s := s, n := n, q := q) ORDER BY n DESC, s, q) AS longest
  FROM runs GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(l.longest.s AS BIGINT) AS start, CAST(l.longest.n AS BIGINT) AS length,
  CAST(l.longest.q AS BIGINT) AS period, CAST(1000 * l.longest.n // l.longest.q AS BIGINT) AS exponent_milli,
  coalesce(l.digest, sha256('')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
