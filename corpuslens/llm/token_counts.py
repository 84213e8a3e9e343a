"""Token counts by field or section: whole documents are encoded once and their tokens attributed by position.

A byte-level vocabulary's tokens, put together, are the document's bytes.  The lengths of its tokens therefore give each
token's span without any search, and the spans, both of tokens and of sections, ascend: the interval join is one
sorted lookup per document."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import ship, slices, table
from corpuslens.llm.packing import added_ids, fast_encoder

RULES = ("first_byte", "majority", "split")


@lru_cache(maxsize=2)
def token_lengths(vocabulary: str) -> np.ndarray:
    """Bytes of every token; a byte-level vocabulary writes each byte as one character."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    added = added_ids(vocabulary)
    out = np.zeros(max([*ids.values(), *added.values()]) + 1, np.int64)
    for token, number in ids.items():
        out[number] = len(token)
    for token, number in added.items():
        out[number] = len(token.encode())
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section (``bounds[i]:bounds[i + 1]``).  A token that crosses a bound counts for the section of its
    first byte; for the one that holds most of it, the earlier of equals; or for each by its share of the bytes."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds[1:], starts, side="right")
    if rule == "first_byte":
        return np.bincount(first, minlength=n).astype(float)
    last = np.searchsorted(bounds[1:], ends - 1, side="right")
    out = np.bincount(first[first == last], minlength=n).astype(float)
    for t in np.flatnonzero(first != last):
        within = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[t], bounds[within + 1]) - np.maximum(starts[t], bounds[within])
        if rule == "majority":
            out[within[np.argmax(share)]] += 1
        else:
            out[within] += share / (ends[t] - starts[t])
    return out


def count_tokens(
    docs: DataFrame, fields: tuple[str, ...] = ("text",), by_line: bool = True, rule: str = "first_byte",
    vocabulary: str = "byte_bpe_50k.json", added_tokens: bool = False,
) -> DataFrame:
    """(doc_id, field, section, start, end, n_tokens, doc_tokens): a row for each section of every row of ``docs``.

    The fields are joined by a line feed, which belongs to the field before it, and encoded as one document.  A field is
    one section, or (``by_line``) a section for each of its lines with the line feed that ends it; start and end are
    code points in the field, end exclusive and without the joining line feed.  Null fields count as empty; an empty field
    is one section.  Null and repeated doc_ids are counted row by row, other columns are ignored, and an empty table
    gives no rows.  The n_tokens of a row's sections add up to its doc_tokens under every rule.
    With ``added_tokens`` the string of an added token of the vocabulary is that token, else ordinary text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        encode, lengths = fast_encoder(vocabulary, added_tokens), token_lengths(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                columns = [batch.column(1 + i).slice(a, b - a).to_pylist() for i in range(len(fields))]
                rows = [[x or "" for x in row] for row in zip(*columns)]
                out: list[list] = [[] for _ in range(7)]
                for doc_id, row, tokens in zip(ids, rows, encode(["\n".join(row) for row in rows])):
                    ends = np.cumsum(lengths[np.asarray(tokens, np.int64)])
                    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                    names, numbers, points, sizes = [], [], [], []
                    for i, (field, text) in enumerate(zip(fields, row)):
                        parts = (text.split("\n") if by_line else [text]) or [""]
                        at = 0
                        for j, part in enumerate(parts):
                            inner = j < len(parts) - 1
                            names.append(field)
                            numbers.append(j)
                            points.append((at, at + len(part) + inner))
                            at += len(part) + inner
                            sizes.append(len(part.encode()) + (inner or i < len(row) - 1))
                    bounds = np.concatenate([[0], np.cumsum(sizes)])
                    counted = attribute(starts, ends, bounds, rule)
                    n = len(names)
                    for column, values in zip(out, ([doc_id] * n, names, numbers, [p[0] for p in points], [p[1] for p in points], counted.tolist(), [len(tokens)] * n)):
                        column.extend(values)
                types = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, types)],
                    ["doc_id", "field", "section", "start", "end", "n_tokens", "doc_tokens"],
                )

    schema = f"doc_id {kind.simpleString()}, field string, section int, start long, end long, n_tokens double, doc_tokens long"
    return docs.select("doc_id", *[F.col(f).cast("string") for f in fields]).mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses lines counts for the line of its first byte.  Null texts are one
    empty line without tokens, null and repeated doc_ids are counted row by row, an empty table gives no rows."""
    found = count_tokens(table(spark, sf_dir, "documents"), added_tokens=True)
    return found.select("doc_id", F.col("section").alias("line"), "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens")
