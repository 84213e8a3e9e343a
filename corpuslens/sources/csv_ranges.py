"""CSV files read in parallel, whatever their size, although quoted fields may hold line ends.

Spark cuts files into ranges of bytes and each into lines.  Whether a line begins inside a quoted field depends on all before it.  But a
range can tell what it would do under either assumption: at its end it is inside a field or not.  These two-valued functions are put
together range after range (a row for each), and then every range knows how it begins and is parsed on its own.  Only records that cross
ranges are put together from pieces.  Rows are those of Python's csv module."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = re.compile('[^"]*(?:""[^"]*)*')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one, or not.  A quote opens a field at its start alone."""
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(',"')
            if at < 0:
                return False
            at += 1
        at += 1
    while True:
        at = _QUOTED.match(line, at).end()
        if at == len(line):
            return True
        at = line.find(',"', at + 1)  # what follows the closing quote is taken as it is, up to a comma
        if at < 0:
            return False
        at += 2


def _lines(batches) -> Iterator[tuple[str, int, str, str]]:
    """(path, range, line, the line end that follows); a carriage return ends a line as well."""
    for batch in batches:
        for value, path, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
            *parts, last = value.split("\r")
            for part in parts:
                yield path, block, part, "\r"
            yield path, block, last, "\n"


def _summary(batches):
    """For each range: whether it ends inside a field if it begins outside or inside, and whether it leaves the field in the latter case."""
    found: dict[tuple[str, int], list[bool]] = {}
    for path, block, line, _ in _lines(batches):
        state = found.setdefault((path, block), [False, True, False])
        quoted = '"' in line
        if quoted or state[0]:
            state[0] = ends_inside(line, state[0]) if quoted else state[0]
        if quoted:
            state[1] = ends_inside(line, state[1])
        state[2] |= not state[1]
    rows = [(*key, *state) for key, state in found.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "block", "outside", "inside", "leaves"])


def _scan(ranges: pd.DataFrame) -> pd.DataFrame:
    """Of a file's ranges in order those that begin or end inside a field, and the range where that field's record begins."""
    rows, inside, owner = [], False, -1
    for r in ranges.sort_values("block").itertuples():
        begins, first = inside, owner
        if not inside or r.leaves:
            owner = r.block
        inside = r.inside if inside else r.outside
        if begins or inside:
            rows.append((r.path, r.block, first if begins else -1))
    return pd.DataFrame(rows, columns=["path", "block", "owner"])


def _parsed(batches, owners: dict[tuple[str, int], int], width: int, pieces: bool):
    """Whole records of every range as cells, or (``pieces``) the parts of records that cross ranges."""
    csv.field_size_limit(sys.maxsize)
    key, held, open_, head, records, cut = None, [], False, False, [], []

    def finish():
        if key is not None and held:
            cut.append((key[0], owners.get(key, -1) if head else key[1], key[1], "".join(held)))

    def flush():
        if pieces and cut:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "owner", "block", "piece"])
            cut.clear()
            yield out
        if not pieces and records:
            yield _cells(records, width)
        records.clear()

    for batch in batches:
        for path, block, line, end in _lines([batch]):
            if (path, block) != key:
                finish()
                key, held, first = (path, block), [], block == 0
                open_ = head = owners.get(key, -1) >= 0
                line = line.removeprefix("﻿") if first else line
            open_ = ends_inside(line, open_) if open_ or '"' in line else False
            if open_:
                held.append(line + end)
                continue
            if head:
                held.append(line)
                finish()
                held, head = [], False
                continue
            if not first and not pieces:
                records.append("".join(held) + line)
            first = False  # the headings
            held = []
        yield from flush()
    finish()
    yield from flush()


def _cells(records: list[str], width: int) -> pa.RecordBatch:
    rows = [(*r[:width], *[None] * (width - len(r))) for r in csv.reader(records) if r]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["cells"])


def _joined(batches, width: int):
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        yield _cells([x.removesuffix("\n") for x in batch.column(0).to_pylist()], width)


def read_ranges(spark: SparkSession, files: list[str], headings: tuple[str, ...]) -> DataFrame:
    """A column of strings for each heading (of equal ones the last counts), null where a row is too short; cells beyond the headings and
    blank lines are left out; a field that the file's end leaves open goes without a last line end.  The files are UTF-8 and begin with a line of these headings.  What the driver gets is a row for each range that
    begins inside a field; it holds a split of each range anyway."""
    lines = spark.read.option("lineSep", "\n").text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    summary = lines.mapInArrow(_summary, "path string, block long, outside boolean, inside boolean, leaves boolean")
    crossing = summary.groupBy("path").applyInPandas(_scan, "path string, block long, owner long").collect()
    owners = {(r["path"], r["block"]): r["owner"] for r in crossing if r["owner"] >= 0}
    width = len(headings)
    cells = lines.mapInArrow(lambda b: _parsed(b, owners, width, False), "cells array<string>")
    if crossing:
        pieces = lines.mapInArrow(lambda b: _parsed(b, owners, width, True), "path string, owner long, block long, piece string")
        parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"])
        whole = pieces.groupBy("path", "owner").agg(F.array_join(parts, "").alias("record")).select("record")
        cells = cells.union(whole.mapInArrow(lambda b: _joined(b, width), "cells array<string>"))
    last = {name: i for i, name in enumerate(headings)}
    return cells.select(*[F.col("cells")[i].alias(name) for name, i in last.items()])
