"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A document's attention cost is estimated as ``linear * n + quadratic * n**2`` for each of its pieces, as attention does
not cross pieces.  Pieces are assigned in descending length to the sequence of lowest cost that still has room; a piece
that fits nowhere whole is cut at the room of the lowest-cost sequence that has any.

Packing is local to a task and streams through windows of a fixed number of sequences, so nothing is shuffled, memory
doesn't grow with the input, and a task that runs again on another executor makes the same pieces.  What doesn't fill
whole sequences of a window is carried to the next one; only the last sequence of each partition can be padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import release, ship, slices, table, text_or_empty

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_cost double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_cost", pa.float64())]
)


def added_ids(vocabulary: str) -> dict[str, int]:
    """The added tokens of a vocabulary file, which its pairs don't make."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


@lru_cache(maxsize=4)
def fast_encoder(vocabulary: str, added: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """Batch encoder for a byte-level vocabulary file.

    The pairs file of the same vocabulary gives the same ids through a leaner coder at about a sixth of the processor
    time (a test compares both); where there is no such file, the tokenizers library encodes.  An added token's string
    in a text gives its id with ``added``, as the library does unless told otherwise, and is ordinary text without."""
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    if vocabulary == "byte_bpe_50k.json":
        import base64

        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        special = added_ids(vocabulary) if added else {}
        coder = tiktoken.Encoding(
            "pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        return lambda texts: [
            coder.encode(x, allowed_special="all") if any(t in x for t in special) else coder.encode_ordinary(x) for x in texts
        ]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    return lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


class Window:
    """Balances the pieces of one window over sequences of equal capacity."""

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic

    def cost(self, n):
        return self.linear * n + self.quadratic * n * n

    def assign(self, lengths: list[int], sequences: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
        """(piece, start in it, length, sequence, offset) until the sequences are full or the pieces are used up."""
        room = np.full(sequences, self.capacity, np.int64)
        cost = np.zeros(sequences)
        out = []
        for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            start, left = 0, lengths[piece]
            while left:
                fits = np.flatnonzero(room >= left)
                if not len(fits):
                    fits = np.flatnonzero(room)
                    if not len(fits):
                        break
                to = int(fits[np.argmin(cost[fits])])
                n = min(left, int(room[to]))
                out.append((piece, start, n, to, self.capacity - int(room[to])))
                room[to] -= n
                cost[to] += self.cost(n)
                start, left = start + n, left - n
        return out, cost


def _pack(batches, capacity, window_sequences, end_id, vocabulary, linear, quadratic, added_tokens):
    encode = fast_encoder(vocabulary, added_tokens)
    window = Window(capacity, linear, quadratic)
    first = TaskContext.get().partitionId() << 36
    made = 0
    held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
    held_tokens = 0

    def rows(pieces) -> list[tuple]:
        return [(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes()), n, first + q, o, c) for d, s, x, n, q, o, c in pieces]

    def flush(sequences: int) -> list[tuple]:
        nonlocal held, held_tokens, made
        placed, cost = window.assign([len(h[2]) for h in held], sequences)
        done = [0] * len(held)
        out = []
        for i, start, n, to, offset in placed:
            d, s, ids, total = held[i]
            out.append((d, s + start, ids[start : start + n], total, made + to, offset, float(cost[to])))
            done[i] = max(done[i], start + n)
        made += sequences
        held = [(d, s + done[i], ids[done[i] :].copy(), t) for i, (d, s, ids, t) in enumerate(held) if done[i] < len(ids)]
        held_tokens = sum(len(h[2]) for h in held)
        return rows(out)

    def emit(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _ARROW)], schema=_ARROW)

    for batch in batches:
        doc_ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts, 1 << 20):
            out = []
            for d, ids in zip(doc_ids.slice(a, b - a).to_pylist(), encode(texts.slice(a, b - a).to_pylist())):
                ids = np.array([*ids, end_id], np.uint32)
                total, start = len(ids), 0
                for start in range(0, total - capacity + 1, capacity):
                    out.append((d, start, ids[start : start + capacity], total, made, 0, window.cost(float(capacity))))
                    made += 1
                start = total - total % capacity
                if start < total:
                    held.append((d, start, ids[start:].copy(), total))
                    held_tokens += total - start
            found = rows(out)
            while held_tokens >= window_sequences * capacity:
                found += flush(window_sequences)
            if found:
                yield emit(found)
        release()
    if held:
        yield emit(flush(-(-held_tokens // capacity)))


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    window_sequences: int = 512,
    end_id: int = 1,
    vocabulary: str = "byte_bpe_50k.json",
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    added_tokens: bool = False,
) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text; other columns are ignored) and returns a row per piece.

    Null texts count as empty; an empty document has its end token alone.  Each token lies in exactly one piece and the
    pieces of a sequence follow without a gap.  Null and repeated doc_ids are kept row by row (``start`` restarts for
    each row).  An empty table gives no rows.  Documents longer than a sequence fill whole sequences; what is left of
    them is packed with the others.  A sequence's id is made of its task's partition number and a running number.
    With ``added_tokens`` the string of an added token of the vocabulary is that token, else ordinary text."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpuslens.llm.packing import _pack

        return _pack(batches, capacity, window_sequences, end_id, vocabulary, linear, quadratic, added_tokens)

    return source.mapInArrow(run, PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of every document, by ``pack_documents``: null and empty texts are their end token alone, rows that
    repeat are packed one by one, an empty table gives no rows."""
    return pack_documents(table(spark, sf_dir, "documents"), added_tokens=True)
