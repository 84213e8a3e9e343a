"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join, and led back to their usual form.

A word of length l is cut into two segments, of l // 2 and the remaining characters.  One edit leaves one of the two as it is,
so every word one edit away holds that segment: at the same place if it has the same length or the edit lies behind,
one place further on if it is one longer and the edit lies before.  Words are indexed under (length, segment number, segment);
each word probes the index of its own length and of the next smaller one with the substrings that can match.  Candidates are
verified by their edit distance.

A segment that very many words share would bring them all together.  Such groups are cut once more: if a segment is
untouched, the edit lies in the rest, whose two halves meet the same pigeonhole; groups above a size are therefore joined on
(segment, half of the rest) and give the same pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import discard, stored, table
from corpuslens.llm.periodic_runs import CRC, CRC_TABLE

#: Fixed values of the contract: letters of a run, the least length and number of a word, the ratio of a form's number to its word's.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 6, 5, 5
#: A run loses a letter if this divides its hash.
DELETED_EACH = 199

#: Entries of one segment above which its group is cut by halves of the rest.
_GROUP = 200


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is.  ``lower`` would change further letters, so it is used for plain ASCII alone."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def damaged(run: Column, doc_id: Column) -> Column:
    """The run without one letter, where the hash of doc_id and run says so; a null doc_id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % DELETED_EACH == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: bool = False) -> DataFrame:
    """(word, n) of the words of all of ``docs`` (doc_id, text): maximal runs of letters, counted over whole texts.  Null texts have none."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    word = lower_ascii(F.col("run"))
    if damage:
        word = damaged(word, F.col("doc_id"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _cut(word: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` on, counted from 0."""
    return F.substr(word, start + 1, size)


def _entries(words: DataFrame) -> DataFrame:
    """Index entries: (word, l, part, segment, rest): the word without that segment is ``rest``."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    head, tail = _cut(F.col("word"), F.lit(0), half), _cut(F.col("word"), half, size - half)
    parts = F.array(
        F.struct(F.lit(0).alias("part"), head.alias("segment"), tail.alias("rest")),
        F.struct(F.lit(1).alias("part"), tail.alias("segment"), head.alias("rest")),
    )
    return words.select("word", size.alias("l"), F.inline(parts))


def _probes(words: DataFrame) -> DataFrame:
    """Probes of words of the same length or one shorter: (word, l, part, segment, rest), l the length of what they look for."""
    word, size = F.col("word"), F.length("word")

    def probe(l: Column, part: int, shift: int) -> Column:
        half = F.floor(l / 2).cast("int")
        if part == 0:
            segment, rest = _cut(word, F.lit(0), half), _cut(word, half, size - half)
        else:
            segment, rest = _cut(word, half + shift, l - half), _cut(word, F.lit(0), half + shift)
        return F.struct(l.alias("l"), F.lit(part).alias("part"), segment.alias("segment"), rest.alias("rest"))

    own, shorter = size, size - 1
    # Of equal length a pair is proposed once, by its larger word: see near_pairs.
    return words.select("word", F.inline(F.array(probe(own, 0, 0), probe(own, 1, 0), probe(shorter, 0, 0), probe(shorter, 1, 1))))


def _halves(rest: Column, looked_for: Column) -> Column:
    """Keys of the rest: (which half, half) at the places where a rest of ``looked_for`` characters has its halves."""
    half = F.floor(looked_for / 2).cast("int")
    shift = F.length(rest) - looked_for
    first = F.struct(F.lit(0).alias("side"), _cut(rest, F.lit(0), half).alias("half"))
    second = F.struct(F.lit(1).alias("side"), _cut(rest, half + shift, looked_for - half).alias("half"))
    return F.inline(F.array(first, second))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) once for every pair of ``words`` (word, distinct) that are one inserted, deleted or replaced character apart."""
    entries, probes = _entries(words), _probes(words)
    key = ["l", "part", "segment"]
    large = entries.groupBy(*key).agg(F.count("*").alias("held")).filter(F.col("held") > _GROUP).drop("held")
    a, b = F.col("a"), F.col("b")
    one_edit = (F.length(a) != F.length(b)) | (a < b)
    one_edit = one_edit & (F.levenshtein(a, b, 1) == 1)
    entries = entries.withColumnRenamed("word", "a").withColumnRenamed("rest", "a_rest")
    probes = probes.withColumnRenamed("word", "b")
    few = entries.join(large, key, "left_anti").join(probes, key).filter(one_edit).select("a", "b")
    deep = [*key, "side", "half"]
    many = entries.join(large, key, "left_semi").select("a", *key, _halves(F.col("a_rest"), F.length("a_rest")))
    # What is looked for in a word's rest is as long as the indexed words' rests are: l without the segment.
    sought = probes.join(large, key, "left_semi").select("b", *key, _halves(F.col("rest"), F.col("l") - F.length("segment")))
    pairs = few.union(many.join(sought, deep).filter(one_edit).select("a", "b"))
    return pairs.distinct()


def group_variants(words: DataFrame, form_times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; each word once).

    A word's form is the word near it (one edit away) of the largest n, of equals the first in code-point order, if that n is
    at least ``form_times`` the word's own; else null.  Following forms leads to the root, the word itself where there is no
    form: n grows on the way, so it ends, and every round doubles the way that is known.  Null words are left out, other
    columns ignored; an empty table gives no rows."""
    words = words.filter("word IS NOT NULL").select("word", "n")
    pairs = stored(near_pairs(words), "near")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b"), F.col("a")))
    ends = ends.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The largest n and of equals the smallest word, as one minimum.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    near = ends.groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))
    has_form = F.col("form_n") >= form_times * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(has_form, F.col("form")).alias("form"), F.when(has_form, F.col("form_n")).alias("form_n")), "forms")
    forms = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    known = stored(forms, "roots")
    while True:
        beyond = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stored(known.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(known)
        known, moved = further, not further.filter("moved").isEmpty()
        if not moved:
            break
    return found.join(known.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each word of at least 6 letters that occurs 5 times or more in all documents, by ``word_counts`` and
    ``group_variants``: null texts have no words, a null doc_id counts as an empty one, an empty table gives no rows."""
    words = stored(word_counts(table(spark, sf_dir, "documents"), damage=True), "words")
    return group_variants(words)


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
long_runs AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h16 FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, {CRC.format(bytes="list_transform(range(CAST(length(h16) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h16, 2 * i + 1, 2) AS BIGINT))")} AS h FROM long_runs, steps),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5),
places AS (
  SELECT word, n, length(word) AS l, unnest(range(1, length(word) + 1)) AS p FROM words),
shorter AS (
  SELECT word, n, l, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM places),
ends AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM shorter x JOIN shorter y ON x.l = y.l AND x.p = y.p AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM shorter x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM shorter x JOIN words y ON x.rest = y.word),
near AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM ends GROUP BY word),
found AS (
  SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.form_n >= 5 * w.n THEN x.form END AS form, CASE WHEN x.form_n >= 5 * w.n THEN x.form_n END AS form_n
  FROM words w LEFT JOIN near x ON w.word = x.word),
way AS (
  SELECT word, word AS root FROM found
  UNION ALL SELECT y.word, f.form FROM way y JOIN found f ON y.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, y.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM found f JOIN way y ON f.word = y.word JOIN found g ON y.root = g.word WHERE g.form IS NULL
"""
