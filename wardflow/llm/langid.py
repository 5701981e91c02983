"""Language identification by nearest centroid.

A text is a vector of hashed character 1- to 3-grams, weighted by TF-IDF and
normalised.  Document frequencies come from every training row.  Each language
is split into a few centroids by spherical k-means over a bounded sample of its
rows (about ``sample_per_language``, chosen by a hash of id and text).  A text
gets the language of the centroid with the largest cosine; a cosine below the
smallest that the centroid's own training rows reach, less a margin, rejects it
(``rejected``; ``lang_pred`` stays the nearest language).

The row counts of the languages reach the driver (one number a language), and the
centroid table, bounded by languages x centroids x dimensions, is sent to the
tasks.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows
without a language are not learned from; with nothing to learn every text is
``und``; equal cosines go to the first language in string order; a null id
hashes like the empty text; repeated rows count and are returned row by row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 8192
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 400
MARGIN = 0.05
_BETWEEN = re.compile(r"[\W\d_]+")


def gram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams; None for a text without a letter."""
    line = _BETWEEN.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, line)):
        return None
    c = np.frombuffer(f" {line} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]
    three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[2:]
    grams = np.concatenate((c, two, three)) * np.uint64(0xD6E8FEB86659FD93)
    return np.bincount(((grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(
        np.int64) % dims, minlength=dims)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows of a matrix of counts."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, centroid of each row); seeds are chosen farthest first from the mean."""
    mean = rows.mean(axis=0)
    seeds = [mean / max(np.linalg.norm(mean), 1e-9)]
    for _ in range(min(k, len(rows)) - 1):
        seeds.append(rows[np.argmin(np.max(rows @ np.array(seeds).T, axis=1))])
    centres = np.array(seeds)
    for _ in range(rounds):
        label = np.argmax(rows @ centres.T, axis=1)
        new = np.array([rows[label == i].sum(axis=0) if (label == i).any() else centres[i] for i in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres, np.argmax(rows @ centres.T, axis=1)


def _frequencies(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for text in b.column(0):
                counts = gram_counts(text.as_py(), dims)
                if counts is not None:
                    df += counts > 0
                    n += 1
        at = np.nonzero(df)[0]
        yield pa.record_batch([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate(([n], df[at])))],
                              names=["gram", "n"])

    return run


def _fit_language(idf: np.ndarray, dims: int, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "text"])
        counts = [c for c in (gram_counts(t, dims) for t in rows["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        x = weigh(np.array(counts), idf)
        centres, label = spherical_kmeans(x, k)
        floor = [float((x[label == i] @ c).min()) if (label == i).any() else 1.0 for i, c in enumerate(centres)]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.tolist() for c in centres], "floor": floor})

    return run


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        dims: int = DIMENSIONS, centroids: int = CENTROIDS,
        sample_per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(idf, language of each centroid, unit centroids, smallest own cosine)."""
    rows = train.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    df = rows.select("text").mapInArrow(_frequencies(dims), "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).toPandas().set_index("gram")["n"]
    total = int(df.get(-1, 0))
    if not total:
        return np.ones(dims, np.float32), [], np.zeros((0, dims), np.float32), np.zeros(0, np.float32)
    seen = df.drop(-1).reindex(range(dims), fill_value=0).to_numpy()
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    size = F.create_map(*[F.lit(x) for r in per_lang for x in (r["lang"], float(r["n"]))])
    place = F.xxhash64("id", F.xxhash64("text"))
    share = (F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53)))
    sample = rows.withColumn("h", place).where(share * F.element_at(size, F.col("lang")) < sample_per_language).select(
        "lang", "text", "h")
    found = sample.groupBy("lang").applyInPandas(
        _fit_language(idf, dims, centroids), "lang string, centroid array<float>, floor double").toPandas()
    found = found.sort_values(["lang"], kind="stable").reset_index(drop=True)
    centres = np.array(found["centroid"].tolist(), np.float32).reshape(-1, dims)
    return idf, found["lang"].tolist(), centres, found["floor"].to_numpy(np.float32)


def _predict(model, dims: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centres, floor = model.value
        for b in batches:
            pred, score, rejected = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            for at in range(0, b.num_rows if langs else 0, 256):
                counts = [gram_counts(t.as_py(), dims) for t in b.column(2).slice(at, 256)]
                rows = [i for i, c in enumerate(counts) if c is not None]
                if not rows:
                    continue
                cosine = weigh(np.array([counts[i] for i in rows]), idf) @ centres.T
                best = np.argmax(cosine, axis=1)
                for i, k, c in zip(rows, best.tolist(), cosine[np.arange(len(rows)), best].tolist(), strict=True):
                    pred[at + i], score[at + i] = langs[k], min(1.0, max(0.0, c))
                    rejected[at + i] = c < floor[k] - margin
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pred), pa.array(score), pa.array(rejected)],
                                  names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def held_out(id_col: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves the remainder ``part``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             margin: float = MARGIN, **options) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``, learned from the rows that are not held out."""
    dims = options.get("dims", DIMENSIONS)
    model = docs.sparkSession.sparkContext.broadcast(
        fit(docs.where(~held_out(id_col, 5, 0)), text_col, lang_col, id_col, **options))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"),
                       F.col(text_col).alias("text")).mapInArrow(
        _predict(model, dims, margin),
        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
