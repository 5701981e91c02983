"""Nearest neighbours inside groups as a Spark join (used by SMOTE, E11).

All pairs of a group would be its square, so candidates are found in rank
windows and verified by real distance:

1. rows are projected on several seeded directions and numbered in the order of
   each projection by a range-partitioned sort; ``block`` rows that follow each
   other are one window, so a group of any size, or of one repeated value, is cut
   into windows of bounded size;
2. inside a window the real distances give every row its ``keep`` nearest (numpy
   on one window at a time);
3. the lists of all projections are merged per row, nearest first;
4. ``rounds`` times, the neighbours of a row's neighbours are candidates as well
   (at most ``keep`` squared a row).  A row and its vector meet the list of each of
   its neighbours, which brings its own vectors, so no pair of rows is exchanged;
   of a list only the candidates that are no farther than the row's last one go on.

The sorts carry ids and projections only; vectors join the windows by id.

Where neighbours are wanted of few rows only, these meet every row of their group
instead: each task keeps the nearest rows of each wanted one, so the lists are exact
and no vector is exchanged (``nearest_of``).

A group of at most ``block`` rows is one window of every projection, so its lists
are exact.  Rows at distance zero are neighbours of each other; a row is not its
own neighbour.  Ties go to the smaller id.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.prefix import row_numbers
from wardflow.session import write_table

FOUND = "id long, near array<struct<distance: double, id: long>>"
#: Most rows that ``nearest_of`` takes, and how many of them and of other rows it measures at once.
FEW, WANTED_ROWS, OTHER_ROWS = 100_000, 2048, 1024


def _distances(width: int):
    """Squared distances of a vector from each of the vectors that the second array holds end to end."""

    @F.arrow_udf("array<double>")
    def run(one: pa.Array, many: pa.Array) -> pa.Array:
        x = one.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        y = many.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        counts = many.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // width
        row, out = np.repeat(np.arange(len(x)), counts), np.zeros(len(y))
        for j in range(width):  # summed in the order of the columns
            step = x[row, j] - y[:, j]
            out += step * step
        ends = np.concatenate([[0], counts.cumsum()]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out))

    return run


def _window_lists(keep: int):
    """The nearest rows of each row of one window."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        ids = rows["id"].to_numpy()[order]
        x = np.array(rows["x"].to_pylist(), np.float64).reshape(len(ids), -1)[order]
        size, n = (x * x).sum(axis=1), min(keep, len(ids) - 1)
        near = []
        for at in range(0, len(ids), 256):
            part = np.arange(at, min(at + 256, len(ids)))
            rough = size[part, None] + size[None, :] - 2 * x[part] @ x.T
            rough[np.arange(len(part)), part] = np.inf
            # some spare ones: the rough distances are rounded differently
            best = np.argpartition(rough, min(2 * n, len(ids) - 2), axis=1)[:, : 2 * n] if 2 * n < len(ids) - 1 else \
                np.argsort(rough, axis=1, kind="stable")[:, : len(ids) - 1]
            exact = np.zeros(best.shape)
            for j in range(x.shape[1]):  # summed in the order of the columns
                step = x[part, j][:, None] - x[best, j]
                exact += step * step
            for i in range(len(part)):
                rank = np.lexsort((ids[best[i]], exact[i]))[:n]
                near.append([{"distance": d, "id": k} for d, k in zip(exact[i][rank].tolist(), ids[best[i]][rank].tolist(),
                                                                      strict=True)])
        kind = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64())]))
        return pa.table([pa.array(ids), pa.array(near, kind)], names=["id", "near"])

    return run


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """One list a row: the nearest of all its lists (each of a bounded length)."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return lists.groupBy("id").agg(F.slice(every, 1, keep).alias("near"))


def _second(best: DataFrame, vectors: DataFrame, keep: int, width: int) -> DataFrame:
    """``(id, near)``: what the list of each neighbour of a row offers it, at most one row an edge."""
    worst = F.when(F.size("near") >= keep, F.element_at("near", -1)["distance"])
    edges = best.join(vectors, "id").select(
        F.col("id").alias("a"), F.col("x").alias("xa"), worst.alias("worst"), F.explode("near.id").alias("b"))
    lists = (
        best.select(F.col("id").alias("b"), F.explode("near.id").alias("c")).join(vectors.toDF("c", "xc"), "c")
        .groupBy("b").agg(F.collect_list(F.struct("c", "xc")).alias("cs")))  # at most keep
    measured = edges.join(lists, "b").select(
        "a", "worst", F.col("cs.c").alias("ids"), _distances(width)("xa", F.flatten("cs.xc")).alias("far"))
    offered = F.filter(
        F.zip_with("far", "ids", lambda d, c: F.struct(d.alias("distance"), c.alias("id"))),
        lambda e: (e["id"] != F.col("a")) & (F.col("worst").isNull() | (e["distance"] <= F.col("worst"))))
    return measured.select(F.col("a").alias("id"), offered.alias("near")).where(F.size("near") > 0)


def nearest_rows(rows: DataFrame, k: int = 5, projections: int = 4, block: int = 2048, rounds: int = 1,
                 seed: int = 42) -> DataFrame:
    """``(id, near)`` of ``rows(grp, id, x)``: the ``k`` nearest other rows of the same group, nearest first.

    ``id`` is unique, ``x`` an array of doubles of one length without nulls.
    A row that is alone in its group has an empty list.
    """
    rows = write_table(rows.select("grp", F.col("id").cast("long"), "x"))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return rows.select("id", F.expr("cast(array() as array<struct<distance: double, id: long>>)").alias("near"))
    keep, dice = 2 * k, random.Random(seed)
    lists = []
    for p in range(projections):
        weights = F.array(*[F.lit(dice.gauss(0.0, 1.0)) for _ in range(width)])
        shade = F.aggregate(F.zip_with("x", weights, lambda a, w: a * w), F.lit(0.0), lambda t, v: t + v)
        # equal projections are spread by a hash, so a repeated row does not fill one range partition
        placed = row_numbers(rows.select("grp", "id", shade.alias("p"), F.xxhash64("id", F.lit(seed + p)).alias("h")),
                             ["grp", "p", "h"], "row")
        first = write_table(placed.groupBy("grp").agg(F.min("row").alias("first")))
        windows = placed.join(first, "grp").select("id", F.floor((F.col("row") - F.col("first")) / block).alias("window"))
        lists.append(windows.join(rows, "id").select("grp", "window", "id", "x").groupBy("grp", "window").applyInArrow(
            _window_lists(keep), FOUND))
    best = write_table(_merged(reduce(DataFrame.unionByName, lists), keep))
    vectors = rows.select("id", "x")
    for _ in range(rounds):
        best = write_table(_merged(best.unionByName(_second(best, vectors, keep, width)), keep))
    return best.select("id", F.slice("near", 1, k).alias("near"))


class _Nearest:
    """The ``k`` nearest rows so far of each wanted row of one group."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.size = (x * x).sum(axis=1)
        # one product gives |x|^2 + |y|^2 - 2 x y
        self.wide = np.column_stack([-2 * x, np.ones(len(x)), self.size]).T.copy()
        self.distance, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        size = (x * x).sum(axis=1)
        wide = np.column_stack([x, size, np.ones(len(x))])
        at, step = 0, max(4 * self.k, 32)
        while at < len(ids):  # few rows first: they bound what the next ones must beat
            rows = slice(at, at + step)
            for first in range(0, len(self.ids), WANTED_ROWS):
                some = slice(first, first + WANTED_ROWS)
                # some spare room: the rough distances are rounded differently
                worst = self.distance[some, -1] + 1e-9 * (self.size[some] + size[rows].max() + 1)
                i, j = np.nonzero(wide[rows] @ self.wide[:, some] <= worst)
                i, j = i + at, j + first
                other = ids[i] != self.ids[j]
                self._take(j[other], ids[i[other]], x[i[other]])
            at, step = at + step, min(2 * step, OTHER_ROWS)

    def _take(self, j: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(j):
            return
        exact, own = np.zeros(len(j)), self.x[j]
        for c in range(x.shape[1]):  # summed in the order of the columns
            step = own[:, c] - x[:, c]
            exact += step * step
        worst = self.distance[j, -1]
        closer = (exact < worst) | ((exact == worst) & (ids < self.near[j, -1]))
        j, ids, exact = j[closer], ids[closer], exact[closer]
        met = np.unique(j)
        j = np.concatenate([j, np.repeat(met, self.k)])
        far, ids = np.concatenate([exact, self.distance[met].ravel()]), np.concatenate([ids, self.near[met].ravel()])
        order = np.lexsort((ids, far, j))
        starts = np.searchsorted(j[order], met)[:, None] + np.arange(self.k)  # each has k at least
        self.distance[met], self.near[met] = far[order][starts], ids[order][starts]

    def lists(self) -> tuple[list, list]:
        known = np.isfinite(self.distance)
        return self.ids.tolist(), [[{"distance": d, "id": i} for d, i in zip(ds[m].tolist(), ns[m].tolist(), strict=True)]
                                   for ds, ns, m in zip(self.distance, self.near, known, strict=True)]


def nearest_of(wanted: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """``(id, near)`` of the ``wanted`` ones of ``rows(grp, id, x)``, at most ``FEW``: their ``k`` nearest other rows, exactly."""
    asked = wanted.select("grp", F.col("id").cast("long"), "x").toArrow()
    if asked.num_rows > FEW:
        raise ValueError(f"neighbours of over {FEW} rows wanted")
    none = wanted.select(F.col("id").cast("long"), F.expr("cast(array() as array<struct<distance: double, id: long>>)").alias("near"))
    if not asked.num_rows:
        return none
    ids = asked.column("id").to_numpy()
    x = np.array(asked.column("x").to_pylist(), np.float64).reshape(len(ids), -1)
    groups: dict = {}
    for i, g in enumerate(asked.column("grp").to_pylist()):
        groups.setdefault(g, []).append(i)

    def run(batches):
        found = {g: _Nearest(ids[at], x[at], k) for g, at in groups.items()}
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            numbers, coded = b.column("id").to_numpy(), b.column("grp").dictionary_encode()
            for code, g in enumerate(coded.dictionary.to_pylist()):
                if g in found:
                    at = np.flatnonzero(coded.indices.to_numpy() == code)
                    found[g].meet(numbers[at], vectors[at])
        kind = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64())]))
        for one in found.values():
            who, near = one.lists()
            yield pa.record_batch([pa.array(who, pa.int64()), pa.array(near, kind)], ["id", "near"])

    met = rows.select("grp", F.col("id").cast("long"), "x").where("grp is not null").mapInArrow(run, FOUND).where(F.size("near") > 0)
    return _merged(met.unionByName(none), k)
