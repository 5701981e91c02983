"""Merkle manifest of a table with resumable hash states.

A row's leaf is the SHA-256 of its columns, each as byte count, ``:`` and value
(``-`` for null).  The leaves of a source, ordered by id, are hashed in runs of
``FAN`` up to a subroot; the subroots, ordered by source, likewise up to the root.

A parent keeps a copy of its hash state before each child slot.  To fold a changed
child, the state of its slot is resumed with the replacement and the siblings to
its right; what stands to its left is never hashed again.

The tree is built in chunks of ``SPAN`` neighbouring nodes (six levels of three),
one row a chunk whatever the sources' sizes, so a source of any size spreads over
all tasks and needs one shuffle for six levels.  Going down, a chunk gets the
siblings above it once, as the states and right parts of its ancestors, and all
its leaves share them.

Defined cases: a null source is a source of its own, first in order; a null id
comes first in its source and is never tampered with; repeated ids are ordered by
leaf, equal rows by their place in the table (their results are equal); one row
alone is its source's subroot, one source alone gives the root; without siblings a
proof is the hash of nothing; an empty table gives an empty result; other columns
are not read.  The id must cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.prefix import row_numbers
from wardflow.session import write_table

FAN = 3
HEIGHT = 6
#: Nodes of a chunk: ``HEIGHT`` levels of the tree.
SPAN = FAN**HEIGHT

STEPS = "array<struct<left: binary, right: binary>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*columns: Column) -> Column:
    """SHA-256 (binary) of the columns, each ``-`` or byte count, ``:`` and value in UTF-8."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def height_of(n: int) -> int:
    """Levels above ``n`` nodes, of those that a chunk holds."""
    height, width = 0, 1
    while width < n and height < HEIGHT:
        height, width = height + 1, width * FAN
    return height


class Subtree:
    """The levels above some neighbouring nodes, with the hash state before each child slot."""

    def __init__(self, nodes: list[bytes], height: int) -> None:
        self.levels = []
        for _ in range(height):
            states, above = [], []
            for at in range(0, len(nodes), FAN):
                state = sha256()
                for child in nodes[at:at + FAN]:
                    states.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.levels.append((nodes, states))
            nodes = above
        self.top = nodes[0]

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """(left, right) of node ``i`` and of its ancestors, from below."""
        out = []
        for nodes, _ in self.levels:
            first = i - i % FAN
            out.append((b"".join(nodes[first:i]), b"".join(nodes[i + 1:first + FAN])))
            i //= FAN
        return out

    def fold(self, i: int, node: bytes) -> bytes:
        """The top with node ``i`` replaced: resumed states, right siblings only."""
        for nodes, states in self.levels:
            state = states[i].copy()
            state.update(node)
            for right in nodes[i + 1:i - i % FAN + FAN]:
                state.update(right)
            node = state.hexdigest().encode()
            i //= FAN
        return node


def _subtree(members: list[dict], n: int) -> Subtree:
    return Subtree([m["digest"].hex().encode() for m in members], height_of(n))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 16):
            part = b.slice(at, 16)
            tops = [bytes.fromhex(_subtree(m, n).top.decode())
                    for n, m in zip(part["n"].to_pylist(), part["members"].to_pylist(), strict=True)]
            yield pa.record_batch([part["tree"], part["n"], part["chunk"], pa.array(tops, pa.binary())],
                                  names=["tree", "n", "chunk", "digest"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The siblings above each member of a chunk: its own in the chunk, then the chunk's."""
    fields = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
    for b in batches:
        for row in range(b.num_rows):
            tree, members, n, steps = (b[c][row].as_py() for c in ("tree", "members", "n", "steps"))
            sub = _subtree(members, n)
            paths = [[{"left": x, "right": y} for x, y in sub.siblings(i)] + steps for i in range(len(members))]
            yield pa.record_batch(
                [pa.array([tree] * len(members), pa.int64()), pa.array([m["pos"] for m in members], pa.int64()),
                 pa.array([m["inner"] for m in members], pa.int64()), pa.array(paths, fields)],
                names=["tree", "pos", "inner", "steps"])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            members, n, steps, subroot, root = (
                b[c][row].as_py() for c in ("members", "n", "steps", "subroot", "root"))
            sub = _subtree(members, n)
            tail = b"".join(s["left"] + s["right"] for s in steps)
            above = [(sha256(s["left"]), s["right"]) for s in steps]
            proofs, folded = [], []
            for i, m in enumerate(members):
                proof = sha256(b"".join(x + y for x, y in sub.siblings(i)))
                proof.update(tail)
                proofs.append(proof.hexdigest())
                node = sub.fold(i, (m["forged"] or m["digest"]).hex().encode())
                for state, right in above:
                    state = state.copy()
                    state.update(node)
                    state.update(right)
                    node = state.hexdigest().encode()
                folded.append(node.decode())
            yield pa.record_batch(
                [pa.array([m["doc_id"] for m in members], pa.int64()), pa.array([m["digest"].hex() for m in members]),
                 pa.array([subroot.hex()] * len(members)), pa.array([root.hex()] * len(members)),
                 pa.array(proofs), pa.array(folded), pa.array([x == root.hex() for x in folded])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def grow(nodes: DataFrame, most: int, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(chunk tables from the leaves up, ``(tree, digest)`` of the tops).

    ``nodes`` holds ``tree``, ``n`` (its number of nodes), ``pos`` (from 0 without
    gaps), ``digest`` and the payload; ``most`` is the largest ``n``.
    """
    floors, tops = [], None
    while True:
        member = F.struct("pos", "digest", *payload)
        chunks = write_table(
            nodes.withColumn("chunk", F.expr(f"pos div {SPAN}")).groupBy("tree", "n", "chunk")
            .agg(F.array_sort(F.collect_list(member)).alias("members")))
        floors.append(chunks)
        done = write_table(chunks.select("tree", "n", "chunk", "members").mapInArrow(
            _tops, "tree long, n long, chunk long, digest binary"))
        whole = done.where(F.col("n") <= SPAN).select("tree", "digest")
        tops = whole if tops is None else tops.unionByName(whole)
        most = -(-most // SPAN)
        if most == 1:
            return floors, tops
        payload = ["inner"]
        nodes = done.where(F.col("n") > SPAN).select(
            "tree", F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("chunk").alias("pos"), "digest",
            F.lit(None).cast("long").alias("inner"))


def descend(floors: list[DataFrame], tops: DataFrame, to: int) -> DataFrame:
    """Chunks of floor ``to`` with the siblings above them; ``tops`` gives (tree, steps, ...) of whole trees."""
    chunks = None
    extra = [c for c in tops.columns if c not in ("tree", "steps")]
    for level in range(len(floors) - 1, to - 1, -1):
        here = floors[level]
        ends = here.where(F.col("n") <= SPAN).join(tops, "tree")
        if chunks is None:
            chunks = ends
            continue
        paths = chunks.select("tree", "members", "n", "steps").mapInArrow(
            _down, f"tree long, pos long, inner long, steps {STEPS}")
        inside = here.where(F.col("n") > SPAN).join(
            paths.select("tree", F.col("pos").alias("chunk"), "steps"), ["tree", "chunk"])
        if extra:
            inside = inside.join(tops.drop("steps"), "tree")
        chunks = ends.unionByName(inside)
    return chunks


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, source_col: str = "source", id_col: str = "doc_id",
             forged: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row a document.

    ``forged`` is the digest (binary) of a changed row, null where it is unchanged;
    such a leaf is folded up its path instead of the original.
    """
    spark = docs.sparkSession
    # written first: the sort below samples its input before it reads it
    leaves = write_table(docs.select(
        F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("doc_id"),
        digest_of(*[F.col(c) for c in columns]).alias("digest"),
        (F.lit(None).cast("binary") if forged is None else forged).alias("forged"),
        F.monotonically_increasing_id().alias("nth")))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("nth")]
    leaves = row_numbers(leaves, order, out="row").drop("nth")
    sources = write_table(leaves.groupBy("source").agg(F.min("row").alias("tree"), F.count(F.lit(1)).alias("n")))
    size = sources.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
    placed = leaves.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "tree", "n", (F.col("row") - F.col("tree")).alias("pos"), "digest", "doc_id", "forged")
    floors, subroots = grow(placed, size["most"], ["doc_id", "forged"])

    # the tree over the subroots: a source's first row number gives its rank
    ranked = row_numbers(subroots.withColumnRenamed("tree", "inner"), [F.col("inner")], out="pos").select(
        F.lit(0).cast("long").alias("tree"), F.lit(size["n"]).cast("long").alias("n"), "pos", "digest", "inner")
    upper, root = grow(ranked, size["n"], ["inner"])
    whole = root.withColumn("steps", F.expr(f"cast(array() as {STEPS})"))
    above = descend(upper, whole, 0).select("tree", "members", "n", "steps").mapInArrow(
        _down, f"tree long, pos long, inner long, steps {STEPS}")
    tops = write_table(
        above.select(F.col("inner").alias("tree"), "steps")
        .join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        .withColumn("root", F.lit(bytes(root.first()["digest"]))))
    rows = descend(floors, tops, 0).select("members", "n", "steps", "subroot", "root")
    return rows.mapInArrow(_prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                   "folded_root string, verified boolean")
