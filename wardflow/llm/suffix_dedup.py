"""Repeated-passage removal with a sparse, partitioned enhanced suffix array.

Every byte covered by a ``min_len``-byte string that also starts anywhere else
is removed.  A suffix array over all positions would shuffle many times the
text, so the array is sparse and cut by content:

1. Anchors.  Each ``min_len``-byte window owns the leftmost smallest k-gram hash
   inside it.  Equal windows own the same anchor at the same offset, so only
   suffixes that start at anchors (about 2 in ``min_len - k`` positions) have to
   be compared, and only with suffixes of the same anchor hash.
2. An anchor's region is the union of the windows it owns.  Anchor hashes seen
   once are dropped; where all regions of a hash are equal, they form one repeat
   group.  Both come from one pre-aggregated count per hash.
3. Mixed hashes: equal regions are first collapsed to one representative.  The
   representatives' suffixes are sorted (the suffix array), neighbours give the
   common-prefix array, and a stack scan walks the tree of common-prefix
   intervals.  Inside an interval the left contexts are sorted the same way; an
   interval of that order has diverse left extensions by construction and is a
   maximal repeat when it spans more than one child of the right interval.  Each
   is emitted as a group with all its occurrences.
4. A hash with more than ``max_group`` different regions is opened into its
   single windows, which are counted by a 128-bit hash (a common-prefix interval
   of depth ``min_len`` is then one key), so no group has to meet in one task.

Repeats longer than a region appear as groups of consecutive anchors; their
union in a document gives the maximal removed runs.

Defined cases: a null text is an empty one; texts shorter than ``min_len`` bytes
hold no window; rows are told apart by id and text, so repeated rows, null ids
and ties in the id all count as separate occurrences (equal rows get equal
results); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import write_table

from .common import temp_name

MIN_LEN = 200
MAX_GROUP = 32768
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def gram_length(min_len: int) -> int:
    """Length of an anchor's k-gram: offsets inside a window must fit one byte."""
    return max(1, min_len // 5, min_len - 255)


class AnchorFinder:
    """Window-owned anchors of byte strings; holds the power tables of the rolling hash."""

    def __init__(self, min_len: int) -> None:
        self.min_len, self.k = min_len, gram_length(min_len)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            for name, base in (("powers", _ODD), ("inverse", pow(_ODD, -1, 1 << 64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor of each window, hash of each k-gram) of at most BLOCK windows."""
        k, n = self.k, len(data)
        self._grow(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.inverse[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        place = np.uint64((1 << 22) - 1)
        low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        width, have = self.min_len - k + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have:])
        return (low & place).astype(np.int64), h

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first and last owned window start, anchor hash) of each owned run."""
        n_windows = len(text) - self.min_len + 1
        none = np.empty(0, np.int64)
        if n_windows <= 0:
            return none, none, none, np.empty(0, np.uint64)
        data = np.frombuffer(text, np.uint8)
        parts = []
        for at in range(0, n_windows, BLOCK):
            size = min(BLOCK, n_windows - at)
            anchors, h = self._block(data[at: at + size + self.min_len - 1])
            first = np.concatenate(([0], np.nonzero(anchors[1:] != anchors[:-1])[0] + 1))
            parts.append((anchors[first] + at, first + at, h[anchors[first]]))
        anchor, first, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]  # a run that a block border cut is one run
        anchor, first, h = anchor[new], first[new], h[new]
        return anchor, first, np.concatenate((first[1:] - 1, [n_windows - 1])), h


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("body")
    )


def _anchors(source: DataFrame, min_len: int) -> DataFrame:
    """(doc, th, h, c, at): c hashes the region's bytes and shape, ``at`` packs anchor, lo and span.

    ``at = anchor << 16 | lo << 8 | span`` with ``lo = anchor - first window``
    and ``span = last window - first window``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder(min_len)
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            counts = np.zeros(b.num_rows, np.int64)
            for i, body in enumerate(b.column(2)):
                text = body.as_py()
                anchor, first, last, h = finder.find(text)
                if not len(anchor):
                    continue
                shape = (anchor - first) << 8 | (last - first)
                c = np.fromiter(
                    (digest(text[s:e], seed)
                     for s, e, seed in zip(first.tolist(), (last + min_len).tolist(), shape.tolist(), strict=True)),
                    np.uint64, len(anchor),
                )
                counts[i] = len(anchor)
                for out, x in zip(cols, (h.view(np.int64), c.view(np.int64), anchor << 16 | shape), strict=False):
                    out.append(x)
            index = pa.array(np.repeat(np.arange(b.num_rows), counts))
            h, c, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in cols[:3])
            yield pa.record_batch(
                [b.column(0).take(index), b.column(1).take(index), pa.array(h), pa.array(c), pa.array(at)],
                names=["doc", "th", "h", "c", "at"],
            )

    return source.mapInArrow(run, "doc long, th long, h long, c long, at long")


def _prefix(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


def _intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals, by a stack scan; lcp[i] is of i-1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and depth < stack[-1][0]:
            top, left = stack.pop()
            yield top, left, i - 1
        if depth >= 0 and (not stack or depth > stack[-1][0]):
            stack.append((depth, left))


def maximal_repeats(
    rights: list[bytes], lefts: list[bytes], min_len: int
) -> Iterator[tuple[int, int, list[int]]]:
    """(left length, right length, members) of the maximal repeats of at least ``min_len`` bytes.

    ``rights`` must be sorted; ``lefts`` are reversed, nearest byte first.
    """
    n = len(rights)
    lcp = [0] + [_prefix(rights[i - 1], rights[i]) for i in range(1, n)]
    for depth, first, last in _intervals(lcp):
        if last == first or depth == 0:
            continue
        child = 0
        children = {}
        for i in range(first, last + 1):
            child += i > first and lcp[i] == depth
            children[i] = child
        order = sorted(range(first, last + 1), key=lefts.__getitem__)
        common = [0] + [_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)]
        if max(common) + depth < min_len:
            continue  # no two members extend far enough to the left
        for left, i, j in _intervals(common):
            members = order[i: j + 1]
            if j > i and left + depth >= min_len and len({children[x] for x in members}) > 1:
                yield left, depth, members


def _scan(min_len: int, spans_only: bool):
    """Rows (h, left, right, doc, th, anchor) sorted by (h, right) -> groups with all occurrences.

    With ``spans_only`` an occurrence that several groups hold is returned once,
    with the union of its spans (each contains the anchor, so that is one span).
    """

    def groups(rows: list[tuple]) -> Iterator[tuple]:
        rights, lefts = [r[2] for r in rows], [r[1] for r in rows]
        reach: dict[int, tuple[int, int]] = {}
        for g, (left, right, members) in enumerate(maximal_repeats(rights, lefts, min_len)):
            for x in members:
                if spans_only:
                    a, b = reach.get(x, (0, 0))
                    reach[x] = max(a, left), max(b, right)
                else:
                    yield rows[x][0], g, rows[x][3], rows[x][4], rows[x][5] - left, left + right
        for x, (left, right) in reach.items():
            yield rows[x][0], 0, rows[x][3], rows[x][4], rows[x][5] - left, left + right

    names = ["h", "part", "doc", "th", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_rows: list[tuple] = []
        places: set[tuple] = set()  # (doc, th, anchor): repeated rows of other tasks are passed over
        for b in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if run_rows and run_rows[-1][0] != row[0]:
                    if len(run_rows) > 1:
                        out.extend(groups(run_rows))
                    run_rows, places = [], set()
                if row[3:] not in places:
                    places.add(row[3:])
                    run_rows.append(row)
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)
        out = list(groups(run_rows)) if len(run_rows) > 1 else []
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    return run


def _regions(min_len: int):
    """Documents with their wanted anchors -> rows (h, left reversed, right, doc, th, anchor).

    Of repeated rows (equal id and text) a task reads only the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            rows = []
            for doc, th, body, wanted in zip(*[b.column(i) for i in range(4)], strict=True):
                doc, th = doc.as_py(), th.as_py()
                if (doc, th) in seen:
                    continue
                seen.add((doc, th))
                text = body.as_py()
                for x in wanted.as_py():
                    anchor, lo, span = x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255
                    rows.append((x["h"], text[anchor - lo:anchor][::-1],
                                 text[anchor:anchor - lo + span + min_len], doc, th, anchor))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)],
                                  names=["h", "left", "right", "doc", "th", "anchor"])

    return run


def _windows(min_len: int):
    """Regions of a hot anchor -> rows (w1, w2, doc, th, start), one a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for left, right, doc, th, anchor in zip(*[b.column(i).to_pylist() for i in range(1, 6)], strict=True):
                text = left[::-1] + right
                for i in range(len(text) - min_len + 1):
                    d = xxhash.xxh3_128_intdigest(text[i:i + min_len])
                    rows.append(((d >> 64) - (1 << 63), (d & _WRAP) - (1 << 63), doc, th, anchor - len(left) + i))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], names=["w1", "w2", "doc", "th", "start"])

    return run


def _groups(source: DataFrame, min_len: int, max_group: int, spans_only: bool = False) -> DataFrame:
    """(h, c, part, doc, th, start, length): occurrences of repeat groups; (h, c, part) names the group."""
    # written, so that both sides of the join below are plain exchanges whose hot partitions can be split
    shared = write_table(
        _anchors(source, min_len)
        .groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
        .where("n > 1").select("h", F.expr("low < high").alias("mixed"))
    )
    found = write_table(_anchors(source, min_len).join(shared, "h"))
    region = [
        F.lit(0).cast("long").alias("part"), "doc", "th",
        F.expr("(at >> 16) - ((at >> 8) & 255)").alias("start"),
        F.expr(f"(at & 255) + {min_len}").cast("long").alias("length"),
    ]
    equal = found.where("not mixed").select("h", "c", *region)
    mixed = found.where("mixed")
    classes = write_table(
        mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "at")).alias("rep"))
        .select("h", "c", "n", "rep.doc", "rep.th", "rep.at")
    )
    copies = mixed.join(classes.where("n > 1").select("h", "c"), ["h", "c"]).select("h", "c", *region)
    per_hash = write_table(classes.groupBy("h").agg(F.count(F.lit(1)).alias("regions")))

    def regions(which: str) -> DataFrame:
        wanted = (
            classes.join(per_hash.where(which), "h")
            .groupBy(F.col("doc").alias("doc_"), F.col("th").alias("th_"))
            .agg(F.collect_list(F.struct("h", "at")).alias("wanted"))
        )
        return source.join(wanted, F.expr("doc <=> doc_ and th = th_")).select("doc", "th", "body", "wanted").mapInArrow(
            _regions(min_len), "h long, left binary, right binary, doc long, th long, anchor long"
        )

    scanned = (
        regions(f"regions <= {max_group}").repartition("h").sortWithinPartitions("h", "right")
        .mapInArrow(_scan(min_len, spans_only), "h long, part long, doc long, th long, start long, length long")
        .select("h", F.lit(0).cast("long").alias("c"), (F.col("part") + 1).alias("part"),
                "doc", "th", "start", "length")
    )
    out = equal.union(copies).union(scanned)
    if per_hash.where(f"regions > {max_group}").head(1):
        opened = write_table(regions(f"regions > {max_group}").mapInArrow(
            _windows(min_len), "w1 long, w2 long, doc long, th long, start long"))
        again = opened.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
        out = out.union(opened.join(again, ["w1", "w2"]).select(
            F.col("w1").alias("h"), F.col("w2").alias("c"), F.lit(-1).cast("long").alias("part"), "doc", "th", "start",
            F.lit(min_len).cast("long").alias("length")))
    return out


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                  max_group: int = MAX_GROUP) -> DataFrame:
    """``(h, c, part, doc, th, start, length)``: every occurrence of every repeat group.

    ``(h, c, part)`` names a group of at least two occurrences of one string of
    ``length >= min_len`` bytes; ``doc`` and ``th`` (hash of the text) name the row.
    """
    return _groups(_source(docs, id_col, text_col), min_len, max_group)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end) spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > reach[:-1]
    at = np.nonzero(first)[0]
    return starts[at], reach[np.concatenate((at[1:] - 1, [len(starts) - 1]))]


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    pieces, at = [], 0
    for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
        pieces.append(text[at:x])
        at = max(at, y)
    return b"".join([*pieces, text[at:]])


def _whole_characters(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans drawn in to UTF-8 character borders."""
    data = np.frombuffer(text + b" ", np.uint8)
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        starts += (data[starts] & 0xC0) == 0x80
        ends -= (data[ends] & 0xC0) == 0x80
    return starts, np.maximum(starts, ends)


def _cut(text_at: int, n_cols: int, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, kept_text, counts = [], [], []
            for body, spans in zip(b.column(text_at).cast(pa.binary()), b.column(n_cols), strict=True):
                text = body.as_py() or b""
                if not spans.is_valid:
                    kept.append(text)
                    kept_text.append(None)
                    counts.append((len(text), 0, 0))
                    continue
                flat = spans.values.flatten()
                s = flat[0].to_numpy(zero_copy_only=False)
                starts, ends = _merge(s, s + flat[1].to_numpy(zero_copy_only=False))
                kept.append(_without(text, starts, ends))
                kept_text.append(_without(text, *_whole_characters(text, starts, ends)).decode())
                counts.append((len(text), len(text) - len(kept[-1]), len(starts)))
            cols = list(zip(*counts, strict=True)) or [(), (), ()]
            yield pa.record_batch(
                [*b.columns[:n_cols], *[pa.array(x, pa.int64()) for x in cols], pa.array(kept, pa.binary()),
                 pa.array(kept_text, pa.string())],
                names=schema_names,
            )

    return run


RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "kept_text": "string"}


def _cut_rows(docs: DataFrame, id_col: str, text_col: str, min_len: int, max_group: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus the columns of ``RESULT``, under names that ``docs`` does not use; those names."""
    groups = _groups(_source(docs, id_col, text_col), min_len, max_group, spans_only=True)
    d, t, spans = (temp_name(docs, x) for x in ("doc", "th", "spans"))
    by_row = groups.groupBy(F.col("doc").alias(d), F.col("th").alias(t)).agg(
        F.collect_set(F.struct("start", "length")).alias(spans))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = docs.columns
    joined = docs.join(
        by_row, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left"
    ).select(*[F.col(f"`{c}`") for c in names], spans)
    added = {x: temp_name(docs, x) for x in RESULT}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields),
                        *(f"`{added[x]}` {kind}" for x, kind in RESULT.items())])
    return joined.mapInArrow(_cut(names.index(text_col), len(names), [*names, *added.values()]), schema), added


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` plus ``n_bytes, n_removed, n_spans`` (long), ``kept`` (binary) and ``kept_text``.

    ``n_spans`` counts maximal removed runs and ``kept`` is the remaining bytes;
    ``kept_text`` is the same as text, where a partly covered character stays
    (null if nothing was removed).  Columns of ``docs`` with these names are
    replaced.
    """
    docs = docs.drop(*RESULT)
    cut, added = _cut_rows(docs, id_col, text_col, min_len, max_group)
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{name}`").alias(x) for x, name in added.items()])


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                  max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text; every row and column stays.

    A character that is only partly covered stays whole.  A column ``n_chars``
    is brought up to date; all other columns keep their values, whatever their names.
    """
    cut, added = _cut_rows(docs, id_col, text_col, min_len, max_group)
    changed, text = F.col(f"`{added['n_removed']}`") > 0, F.col(f"`{added['kept_text']}`")
    new = {text_col: F.when(changed, text).otherwise(F.col(f"`{text_col}`"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
