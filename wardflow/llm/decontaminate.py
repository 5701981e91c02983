"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document when at least ``threshold`` of the item's
distinct word shingles occur there.  A short item inside a long document has a
Jaccard similarity near zero, so comparing two MinHash signatures cannot find
it.  The min-wise order is therefore taken on the item's side alone: items are
partitioned by size, and a partition whose largest size is ``n`` keeps its
items' ``floor((1 - threshold) * n) + 1`` smallest shingle hashes.  A document
that holds enough of an item lacks at most ``floor((1 - threshold) * n)`` of its
shingles, so it holds at least one of the kept ones: the search loses nothing.

The documents are scanned once against two fixed-size bitmaps (kept shingles,
all shingles); only documents with a hit leave the scan, with the text of the
shingles they share.  Candidates are then joined on the kept shingle and
verified on the shingle texts, so hash collisions cannot add a match.

Words are the lower-cased runs of letters and digits.  Defined cases: a null or
blank text has no words; an item with fewer words than a shingle is one shingle
of all its words; an item without words matches nothing; items with equal words
are each reported; rows with the same id and text are one document; a null id is
an id like any other; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import write_table

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Both bitmaps together are at most 32 MB, whatever the benchmark's size; beyond
#: that fill, more documents pass the scan and the exact join does the rest.
MIN_BITS, MAX_BITS = 16, 27
_ODD = 0x9E3779B97F4A7C15


class Shingler:
    """Word shingles of a text as offsets into its normalised bytes, with rolling 64-bit hashes."""

    def __init__(self) -> None:
        self.word = re.compile(r"[^\W_]+")
        self.powers = self.inverse = np.ones(1, np.uint64)

    def load(self, text: str | None) -> int:
        """Normalise a text; returns its number of words."""
        found = self.word.findall((text or "").lower())
        self.line = " ".join(found).encode()
        data = np.frombuffer(self.line, np.uint8)
        gaps = np.nonzero(data == 32)[0]
        self.starts = np.concatenate(([0], gaps + 1)) if found else gaps
        self.ends = np.concatenate((gaps, [len(data)])) if found else gaps
        n = len(data) + 1
        if n > len(self.powers):
            size = 2 * n
            for name, base in (("powers", _ODD), ("inverse", pow(_ODD, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        self.total = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: n - 1], out=self.total[1:])
        return len(found)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every ``size``-word shingle, repeats included."""
        m = max(0, len(self.starts) - size + 1)
        s, e = self.starts[:m], self.ends[len(self.ends) - m:]
        h = (self.total[e] - self.total[s]) * self.inverse[s]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return s, e, h ^ (h >> np.uint64(29))


def sketch_size(n: int, threshold: float) -> int:
    """Kept shingles of an item with ``n``: the bound of its size partition (powers of two)."""
    largest = 1 << max(0, n - 1).bit_length()
    return min(n, math.floor((1 - threshold) * largest + 1e-9) + 1)


def _items(threshold: float, shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = make.load(text)
                if not words:
                    continue
                size = min(words, shingle_words)
                by_text = {make.line[s:e].decode(): int(h) for s, e, h in zip(*make.shingles(size), strict=True)}
                order = sorted(by_text, key=lambda x: (by_text[x], x))
                hashes = np.array([by_text[x] for x in order], np.uint64).view(np.int64)
                rows.append((item, make.line.decode(), size, order, hashes.tolist(),
                             sketch_size(len(order), threshold)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)],
                                  names=["item", "line", "size", "shingles", "hashes", "kept"])

    return run


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """Bitmap of a column ``h``; at most 2^bits / 64 rows reach the driver."""
    words = hashes.select((F.col("h").bitwiseAND((1 << bits) - 1)).alias("i")).groupBy(
        F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("m"))
    out = np.zeros(1 << (bits - 6), np.int64)
    rows = words.toPandas()
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out.tobytes()


def _hits(bits: int, sizes: list[int], maps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, every = (np.frombuffer(x, np.uint64) for x in maps.value)
        place, make = np.uint64((1 << bits) - 1), Shingler()

        def inside(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
            i = h & place
            return (bitmap[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1

        for b in batches:
            index, found = [], []
            for row, text in enumerate(b.column(2)):
                if make.load(text.as_py()) < sizes[0]:
                    continue
                parts = [make.shingles(n) for n in sizes]
                if not any(inside(kept, h).any() for _, _, h in parts):
                    continue
                shared = set()
                for s, e, h in parts:
                    at = np.nonzero(inside(every, h))[0]
                    shared.update(make.line[x:y].decode() for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True))
                index.append(row)
                found.append(list(shared))
            take = pa.array(index, pa.int64())
            yield pa.record_batch(
                [b.column(0).take(take), b.column(1).take(take), pa.array(found, pa.list_(pa.string()))],
                names=["doc", "th", "shared"],
            )

    return run


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc, th, item, n_shingles, n_shared, containment)`` of every match.

    ``doc`` and ``th`` (hash of the text) name the document, ``item`` the test item.
    """
    spark = docs.sparkSession
    items = write_table(
        benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
        .mapInArrow(_items(threshold, shingle_words),
                    "item long, line string, size int, shingles array<string>, hashes array<long>, kept int"))
    facts = items.agg(F.sum(F.size("hashes")).alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    schema = "doc long, th long, shared array<string>"
    if facts["n"]:
        bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(64 * facts["n"]))))
        maps = spark.sparkContext.broadcast((
            _bitmap(items.select(F.explode(F.expr("slice(hashes, 1, kept)")).alias("h")), bits),
            _bitmap(items.select(F.explode("hashes").alias("h")), bits),
        ))
        source = docs.select(F.col(id_col).cast("long").alias("doc"),
                             F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("t"))
        hits = write_table(source.mapInArrow(_hits(bits, facts["sizes"], maps), schema))
    else:
        hits = spark.createDataFrame([], schema)
    texts = items.groupBy("line", "size").agg(F.first("shingles").alias("shingles"), F.first("kept").alias("kept"))
    sketch = texts.select("line", F.explode(F.expr("slice(shingles, 1, kept)")).alias("shingle"))
    pairs = (
        hits.select("doc", "th", F.explode("shared").alias("shingle")).join(sketch, "shingle")
        .select("doc", "th", "line").distinct()
    )
    h = hits.select(F.col("doc").alias("doc_"), F.col("th").alias("th_"), "shared").dropDuplicates(["doc_", "th_"])
    checked = (
        pairs.join(h, F.expr("doc <=> doc_ and th = th_"))
        .join(texts.select("line", "shingles"), "line")
        .select("doc", "th", "line", F.size("shingles").cast("long").alias("n_shingles"),
                F.size(F.array_intersect("shared", "shingles")).cast("long").alias("n_shared"))
        .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles"))
    )
    return checked.join(items.select("item", "line").distinct(), "line").select(
        "doc", "th", "item", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns unchanged."""
    bad = find_contaminated(docs, benchmark, id_col, text_col, **options).select(
        F.col("doc").alias("__doc"), F.col("th").alias("__th")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(
        bad, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__th")), "left_anti")
