"""Interaction audit of row filters, by incremental retraction in a stream.

All files are read as available-now micro-batches.  Four filters depend on the
row alone and give its mask; the fifth, a copy of a smaller id's text, depends on
the whole table.  The state of a text is the smallest id seen and what that id's
rows added to the counters of their parts; some hundred texts of near hash share a
state entry, since a call for each text would cost more than its work.  A row with a larger id counts as a
copy at once; when a smaller id arrives, the earlier rows are retracted from the
mask without the copy bit and added to the mask with it.  The counters
``(part, mask, good, toxic)`` are written as one folder of deltas an epoch, so a
repeated epoch overwrites its own; their sum does not depend on the order of files.
From the 32 masks of a part, every order of the filters is plain arithmetic.

Before a shuffle, rows of one text meet in each task and all but those of the
smallest id there become plain counter rows, so a text that holds a third of the
table sends a few rows a task to its state.  The state lives in RocksDB and its
checkpoint in the shared folder.

Defined cases: a null text is empty; a null lang is the part ``''`` (as an empty
one); rows with equal ids are no copies of each other, and each counts; a row with
a null id is no copy and makes none; a document is good or toxic if any label row
of its id says so; null labels say nothing; a table without rows gives no part;
other columns are not read.  The id must cast to long.  Texts are told apart by a
128-bit hash.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b
from itertools import permutations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.session import new_folder, write_table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Entries that a task merges before it passes them on.
MERGE_ROWS = 50_000
_STORE = "spark.sql.streaming.stateStore"
#: State on disk, one bound on the memory of all stores of an executor, and no store kept open between batches.
STATE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STORE}.rocksdb.writeBufferSizeMB": "8",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.unloadOnCommit": "true",
}
#: Rows of the table for each state entry.
ENTRY_ROWS = 512

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"

ROWS = "text_key binary, doc_id long, part string, mask int, n long"
KEYED = "text_key binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long"
DELTAS = "part string, mask int, good boolean, toxic boolean, n long"


def row_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()
    chars = len(text.translate(None, _CONTINUED))
    failed = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * chars,
        len(text.translate(None, _MARKS)) < len(text),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one text, id and part as one row with their number."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()]

    def out(merged: Counter) -> pa.RecordBatch:
        cols = zip(*((*k, n) for k, n in merged.items()), strict=True)
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    merged = Counter()
    for b in batches:
        for at in range(0, b.num_rows, 256):
            ids, texts, parts = (c.to_pylist() for c in b.slice(at, 256).columns)
            for i, text, part in zip(ids, texts, parts, strict=True):
                text = text or b""
                merged[blake2b(text, digest_size=16).digest(), i, part or "", row_mask(text)] += 1
        if len(merged) > MERGE_ROWS:
            yield out(merged)
            merged = Counter()
    if merged:
        yield out(merged)


def _first_ids(entries: int):
    names = ["entry", "text_key", "doc_id", "part", "mask", "good", "toxic", "n"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]

    def out(low: dict, sure: Counter) -> pa.RecordBatch:
        rows = [(int.from_bytes(key[:6], "big") % entries, key, i, part, mask, good, toxic, n)
                for key, (i, mask, good, toxic, parts) in low.items() for part, n in parts.items()]
        here = TaskContext.get().partitionId() % entries
        rows += [(here, b"", None, *k, n) for k, n in sure.items()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text the rows of its smallest id in this task; all others as finished counter rows (no id)."""
        low, sure = {}, Counter()
        for b in batches:
            for key, i, part, mask, n, good, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i is None:
                    sure[part, mask, good, toxic] += n
                    continue
                seen = low.get(key)
                if seen is None:
                    low[key] = (i, mask, good, toxic, Counter({part: n}))
                elif i == seen[0]:
                    seen[4][part] += n
                elif i > seen[0]:
                    sure[part, mask | COPY, good, toxic] += n
                else:
                    for p, m in seen[4].items():
                        sure[p, mask | COPY, seen[2], seen[3]] += m
                    low[key] = (i, mask, good, toxic, Counter({part: n}))
            if len(low) + len(sure) > MERGE_ROWS:
                yield out(low, sure)
                low, sure = {}, Counter()
        if low or sure:
            yield out(low, sure)

    return run


def _retract(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Counter deltas of new rows; the state holds ``text: [smallest id, good, toxic, {part: rows}]``."""
    delta = Counter()
    texts = json.loads(state.get[0]) if state.exists else {}
    columns = ("text_key", "doc_id", "part", "mask", "good", "toxic", "n")
    for frame in frames:
        # ids stay exact: a float column would round them
        ids = frame["doc_id"].astype("Int64")
        for text, i, part, mask, good, toxic, n in zip(
                *(ids.tolist() if c == "doc_id" else frame[c].tolist() for c in columns), strict=True):
            if i is pd.NA:
                delta[part, mask, good, toxic] += n
                continue
            seen = texts.get(text := text.hex())
            if seen is not None and i > seen[0]:
                delta[part, mask | COPY, good, toxic] += n
                continue
            if seen is None or i < seen[0]:
                for p, m in (seen[3] if seen else {}).items():
                    delta[p, mask, seen[1], seen[2]] -= m
                    delta[p, mask | COPY, seen[1], seen[2]] += m
                texts[text] = seen = [i, good, toxic, {}]
            delta[part, mask, good, toxic] += n
            seen[3][part] = seen[3].get(part, 0) + n
    if texts:
        state.update((json.dumps(texts),))
    rows = [(*k, n) for k, n in delta.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"])


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """The state settings that a query takes over when it starts; what was set before comes back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, id_col: str = "doc_id",
             text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, good, toxic, n)`` over all files of the parquet table at ``path``, in ``batches`` micro-batches."""
    table = spark.read.parquet(path)
    marked = write_table(
        labels.groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
             F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        .where("labelled is not null and (good or toxic)"))
    names = table.inputFiles()
    files = ceil(max(1, len(names)) / batches)
    entries = max(1, table.count() // ENTRY_ROWS)
    if [n.rsplit("/", 1)[-1] for n in names] == [path.rstrip("/").rsplit("/", 1)[-1]]:
        path = f"{path[:-1]}[{path[-1]}]"  # the table is one file: the stream takes folders and patterns
    rows = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
        .select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), F.col(part_col).cast("string"))
        .mapInArrow(_masks, ROWS))
    # rows without an id meet no label: they are dealt by their text
    near = F.coalesce("doc_id", F.xxhash64("text_key")) == F.col("labelled")
    # merged at every size: labels grow with the documents, and a task then runs one Python step, not two
    labelled = rows.join(marked.hint("merge"), near & F.col("doc_id").isNotNull(), "left").select(
        "text_key", "doc_id", "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    deltas = (
        labelled.mapInArrow(_first_ids(entries), f"entry long, {KEYED}")
        .groupBy("entry").applyInPandasWithState(_retract, DELTAS, "texts string", "update", "NoTimeout"))
    out = new_folder(spark, "audit")

    def add(part: DataFrame, epoch: int) -> None:
        part.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(
            f"{out}/epoch={epoch}")

    with _state_settings(spark):
        deltas.writeStream.outputMode("update").option("checkpointLocation", new_folder(spark, "audit_state")) \
            .trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    epochs = spark.read.schema(f"{DELTAS}, epoch long").parquet(out)
    return epochs.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")


ORDERS = ["".join(p) for p in permutations(FILTERS)]
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    grid = [(order, step, 1 << FILTERS.index(order[step - 1]), sum(1 << FILTERS.index(f) for f in order[:step - 1]))
            for order in ORDERS for step in range(1, len(FILTERS) + 1)]
    masks = np.arange(1 << len(FILTERS))
    bits = np.array([int(m).bit_count() for m in masks])
    for b in batches:
        for part, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n, good, toxic = np.zeros((3, len(masks)), np.int64)
            for c in cells:
                n[c["mask"]] += c["n"]
                good[c["mask"]] += c["n"] * c["good"]
                toxic[c["mask"]] += c["n"] * c["toxic"]
            rows = []
            for order, step, own, earlier in grid:
                fails, gone = masks & own > 0, masks & earlier > 0
                here = fails & ~gone
                # of all orders, a share of 1 / (failing filters) has this one first among them
                share = int((n[fails] * (len(ORDERS) // bits[fails])).sum())
                rows.append((part, order, step, n[~fails & ~gone].sum(), n[here].sum(), n[fails & gone].sum(), n[own],
                             good[here].sum(), toxic[here].sum(), share))
            cols = list(zip(*rows, strict=True))
            types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.record_batch([pa.array([x if isinstance(x, str) else int(x) for x in c], t)
                                   for c, t in zip(cols, types, strict=True)], names=names)


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """One row per part, order of the five filters and step."""
    cells = counters(spark, path, labels, batches).groupBy("part").agg(
        F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # at most 128 a part
    return cells.mapInArrow(_orders, RESULT)
