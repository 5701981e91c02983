"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its word
shingles.  Fingerprints at most two bits apart are linked, without comparing
all pairs:

* a fingerprint is cut into three segments of 22, 21 and 21 bits.  Two errors
  leave at least one segment exact (pigeonhole);
* the following segment, padded to 23 bits, is read as a received word of the
  perfect binary Golay code.  The word and its 23 one-bit neighbours decode to
  one codeword index, or six.  Two words at most two bits apart have a common
  neighbour (the midpoint), hence a common index;
* so the keys (exact segment, codeword index) of the three cyclic choices find
  every pair within two bits.  Rows that share a key are verified by their real
  bit distance.

A key shared by more than ``max_run`` distinct fingerprints is not compared
pairwise: its members are dealt out again by the 65 words of their own radius-1
balls, where sharing a word proves a distance of at most two.  Work and rows
stay linear in the group, and no link is lost.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of the whole sequence;
repeated rows and equal texts share a fingerprint and so a component; a row
with a null id gets the component of its fingerprint (null if no id in the
component is known); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.session import write_table

from .common import temp_name
from .components import connected_components

#: Generator polynomial of the binary Golay code of length 23.
GOLAY_GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits) of a 64-bit fingerprint
MAX_RUN = 65536
PAIRWISE = 128


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 23-bit word's two halves, error pattern of each syndrome)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_GENERATOR << (bit - 11)
        return word

    single = np.array([remainder(1 << b) for b in range(23)], dtype=np.int64)
    halves = np.zeros((2, 4096), dtype=np.int64)
    for half, (base, bits) in enumerate(((0, 12), (12, 11))):
        for b in range(bits):
            halves[half, [x for x in range(4096) if x >> b & 1]] ^= single[base + b]
    errors = np.zeros(2048, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << b for b in bits)
    return halves, errors


def golay_index(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    halves, errors = tables
    words = words.astype(np.int64)
    return (words ^ errors[halves[0][words & 4095] ^ halves[1][words >> 12]]) >> 11


def golay_keys(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of 24 sorted indices: of each word and its one-bit neighbours (repeats included)."""
    flips = np.array([0] + [1 << b for b in range(23)], dtype=np.int64)
    return np.sort(golay_index(words.astype(np.int64)[:, None] ^ flips[None, :], tables), axis=1)


def fingerprint(text: bytes | None, shingle_words: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle_words - 1:].tolist(), strict=True)),
        np.uint64, n,
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3, row: Column | None = None) -> DataFrame:
    """``(doc_id, fp)``: one signed 64-bit fingerprint a row; with the long ``row``, ``(doc_id, th, fp)``."""

    names = ["doc_id", "fp"] if row is None else ["doc_id", "th", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py(), shingle_words) for x in b.column(b.num_columns - 1)]
            yield pa.record_batch(
                [*b.columns[:-1], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=names
            )

    keys = [F.col(id_col).cast("long").alias("doc_id"), *([] if row is None else [row.alias("th")])]
    return docs.select(*keys, F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, ", ".join(f"{x} long" for x in names))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 8192):
            part = fp[at:at + 8192]
            parts = [((part >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
            keys, rows = [], []
            for c in range(3):
                idx = golay_keys(parts[(c + 1) % 3], tables)
                first = np.ones(idx.shape, dtype=bool)
                first[:, 1:] = idx[:, 1:] != idx[:, :-1]
                r, k = np.nonzero(first)
                keys.append((c << 40) | (parts[c][r] << 12) | idx[r, k])
                rows.append(r)
            yield pa.record_batch(
                [pa.array(np.concatenate(keys)), pa.array(part[np.concatenate(rows)].view(np.int64))],
                names=["key", "fp"],
            )


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _ball(fps: np.ndarray) -> np.ndarray:
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    return fps[:, None] ^ flips[None, :]


def run_edges(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) of the link components inside one key's distinct fingerprints."""
    n = len(fps)
    if n <= PAIRWISE:
        chunks = []
        for at in range(0, n, 512):
            near = np.bitwise_count(fps[at:at + 512, None] ^ fps[None, :]) <= max_bits
            i, j = np.nonzero(near)
            keep = i + at < j
            chunks.append((i[keep] + at, j[keep]))
        a, b = (np.concatenate(x) for x in zip(*chunks, strict=True))
    else:
        words = _ball(fps).ravel()
        order = np.argsort(words, kind="stable")
        owner, words = order // 65, words[order]
        same = words[1:] == words[:-1]
        a, b = owner[1:][same], owner[:-1][same]
    if not len(a):
        return fps[:0], fps[:0]
    root = _local_roots(n, a, b)
    moved = np.nonzero(root != np.arange(n))[0]
    return fps[moved], fps[root[moved]]


def _link(max_bits: int, max_run: int):
    def out(a: np.ndarray, b: np.ndarray, word: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.record_batch(
            [pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)),
             none if word is None else pa.array(word.view(np.int64))], names=["a", "b", "word"],
        )

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
        sizes = np.diff(cuts)
        at = cuts[:-1][sizes == 2]
        if len(at):
            near = np.bitwise_count(fps[at] ^ fps[at + 1]) <= max_bits
            yield out(fps[at + 1][near], fps[at][near])
        for s, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = run_edges(fps[s:s + n], max_bits)
            if len(a):
                yield out(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            while len(keys):
                last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
                if hot is not None and keys[0] == hot:
                    n = int(np.searchsorted(keys, hot, side="right"))
                    for at in range(0, n, 4096):
                        part = fps[at:min(n, at + 4096)]
                        yield out(np.repeat(part, 65), None, _ball(part).ravel())
                    keys, fps = keys[n:], fps[n:]
                    continue
                if last:
                    yield from settle(keys[:last], fps[:last])
                    keys, fps = keys[last:], fps[last:]
                if len(keys) > max_run:
                    hot = keys[-1]
                    continue
                break
        if len(keys):
            yield from settle(keys, fps)

    return run


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
    max_bits: int = 2, max_run: int = MAX_RUN,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is the smallest id reachable.

    ``max_bits`` must be 2, the distance the keys and the ball words are built for.
    """
    fps = _written_fingerprints(docs, id_col, text_col, shingle_words, max_bits)
    by_fp = _group_minima(fps, {"component_id": F.col("doc_id")}, max_bits, max_run)
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _written_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int,
                          row: Column | None = None) -> DataFrame:
    if max_bits != 2:
        raise ValueError("the Golay keys and ball words are built for two differing bits")
    return write_table(fingerprints(docs, id_col, text_col, shingle_words, row))


def _group_minima(fps: DataFrame, values: dict[str, Column], max_bits: int, max_run: int) -> DataFrame:
    """``fp`` and, of each value, the smallest one over the rows of the fingerprint's component."""
    nodes = fps.groupBy("fp").agg(*[F.min(v).alias(k) for k, v in values.items()])
    keyed = nodes.select("fp").mapInArrow(_key_rows, "key long, fp long")
    links = write_table(
        keyed.repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(_link(max_bits, max_run), "a long, b long, word long").distinct()
    )
    hot = links.where("word is not null").select("a", "word")
    by_word = hot.groupBy("word").agg(F.min("a").alias("b"))
    edges = links.where("word is null").select("a", "b").union(hot.join(by_word, "word").select("a", "b"))
    groups = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    labelled = nodes.join(groups, "fp", "left").select("fp", *values, F.coalesce("root", "fp").alias("root"))
    # written, so that the partition of a giant component can be split in the join
    smallest = write_table(labelled.groupBy("root").agg(*[F.min(k).alias(k) for k in values]))
    return labelled.select("fp", "root").join(smallest, "root").select("fp", *values)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
             max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; columns unchanged.

    Rows are told apart by id and text: of rows that share the smallest id, the
    one with the smallest text hash stays, and of equal texts the one that is
    smallest as JSON.  A row with a null id is not known to be the document of
    any id, so one such row a component, chosen in the same way, stays as well.
    """
    d, t = temp_name(docs, "doc"), temp_name(docs, "th")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    fps = _written_fingerprints(docs, id_col, text_col, shingle_words, max_bits, text_hash)
    own = F.struct("doc_id", "th")
    by_fp = _group_minima(fps, {"best": F.when(F.col("doc_id").isNotNull(), own), "best_null": F.when(
        F.col("doc_id").isNull(), F.col("th"))}, max_bits, MAX_RUN)
    stays = F.when(F.col("doc_id").isNull(), F.col("th") == F.col("best_null")).otherwise(own == F.col("best"))
    rows = write_table(fps.join(by_fp, "fp").select(F.col("doc_id").alias(d), F.col("th").alias(t), stays.alias("stays")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(*names, text_hash.alias(f"{t}_own"))

    def same(which: DataFrame) -> Column:
        return F.col(f"`{id_col}`").cast("long").eqNullSafe(which[d]) & (F.col(f"{t}_own") == which[t])

    # one plan at every size: the rows that go are not bounded, so they are merged, never broadcast
    gone = rows.where("not stays").select(d, t).distinct().hint("merge")
    kept = hashed.join(gone, same(gone), "left_anti")
    repeated = rows.where("stays").groupBy(d, t).count().where("count > 1").drop("count")
    if not repeated.head(1):
        return kept.select(*names)
    first = F.min_by(F.struct(*names), F.to_json(F.struct(*names)))
    again = kept.join(repeated, same(repeated), "left_semi").groupBy(
        F.col(f"`{id_col}`").cast("long"), f"{t}_own").agg(first.alias(d)).select(f"{d}.*")
    return kept.join(repeated, same(repeated), "left_anti").select(*names).union(again)
