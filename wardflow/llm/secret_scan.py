"""Secret scan with corpus-wide ownership of the found values.

Three patterns give the base spans.  Besides, every run of token characters that
looks like a credential is a candidate.  All values are hashed and counted over
the whole corpus: first the distinct repositories of a value and owner, then the
owners of a value.  A value that many owners or repositories share is an example
that has been copied about; one that a single owner has, and that looks live, is a
credential of that owner.  Candidates of the second sort get a span of kind
``owned`` if they are strong by themselves or equal a value that a base pattern
found elsewhere (the bare echo of a password, for instance).

Texts are scanned once and whole; what is shuffled are hashes, spans and counts.
Counting goes from (value, owner, repository) down, so a value that a third of all
documents hold is reduced before it meets in one task, and the counted values are
written before they are joined back, so a hot value's partition can be split.

Defined cases: a null or empty text has no span; a null owner is one unnamed owner,
a null repository one unnamed repository of its owner; repeated rows are scanned
row by row, and count once for a repository; a table without rows gives an empty
result; other columns are not read.  Spans are in code points, end exclusive.  The
id must cast to long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.session import write_table

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
RUN = "[A-Za-z0-9][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9]"
#: A value with so many owners, or repositories, is an example.
WIDE_OWNERS, WIDE_REPOS = 3, 100

SPAN = "struct<start: int, kind: int, end: int, value: binary, live: boolean, strong: boolean>"


def looks(value: str) -> tuple[bool, bool]:
    """(may be live, strong enough without a keyword beside it)."""
    distinct = len(set(value))
    digit, lower, upper = (re.search(p, value) is not None for p in ("[0-9]", "[a-z]", "[A-Z]"))
    live = len(value) >= 12 and distinct >= 8 and digit and (lower or upper)
    return live, len(value) >= 20 and distinct >= 12 and digit and lower and upper


def _finder():
    """Base spans and candidates ``(start, kind, end, value)`` of a text."""
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    # runs are maximal, so leaving short ones to the pattern finds the same spans
    access, digits, run = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}"), re.compile(RUN)
    words = ("password", "passwd", "secret", "token", "api")

    def find(text: str) -> list[tuple[int, int, int, str]]:
        found = []
        lower = text.lower()
        if any(w in lower for w in words):
            found += [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end(), m[0]) for m in access.finditer(text)]
        found += [(m.start(), 2, m.end(), m[0]) for m in digits.finditer(text)]
        taken = sorted((s, e) for s, _, e, _ in found)
        at, reach = 0, 0
        for m in run.finditer(text):
            # base spans that begin before the run's end; the run is free if none of them reaches into it
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= m.start() and looks(m[0])[0]:
                found.append((m.start(), 3, m.end(), m[0]))
        return sorted(found)

    return find


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = _finder()
    fields = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
                                 ("value", pa.binary()), ("live", pa.bool_()), ("strong", pa.bool_())]))
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            found = []
            for text in part.column(4).to_pylist():
                spans = []
                for start, kind, end, value in find(text or ""):
                    live, strong = looks(value)
                    key = blake2b(value.encode(), digest_size=16).digest()
                    spans.append({"start": start, "kind": kind, "end": end, "value": key, "live": live, "strong": strong})
                found.append(spans)
            yield pa.record_batch([*part.columns[:4], pa.array(found, fields)],
                                  names=["row", "doc_id", "owner", "repo", "found"])


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value, n_owners, n_repos, known)`` of ``candidates(value, owner, repo, kind)``; known: a base pattern found it."""
    known = F.max(F.col("kind") < KINDS.index("owned"))
    by_repo = candidates.groupBy("value", "owner", "repo").agg(known.alias("known"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"),
                                         F.max("known").alias("known"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans sorted by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """``(doc_id, base, added, n_example, n_live)`` a row: spans as arrays of (start, kind, end), and the
    numbers of its found values that are examples, and live credentials of one owner."""
    rows = write_table(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                    F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
                    F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_scan, f"row long, doc_id long, owner string, repo string, found array<{SPAN}>"))
    candidates = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.inline("found"))
    counted = write_table(ownership(candidates).select(
        "value", "known", ((F.col("n_owners") >= wide_owners) | (F.col("n_repos") >= wide_repos)).alias("example"),
        (F.col("n_owners") == 1).alias("own")))
    live = ~F.col("example") & F.col("own") & F.col("live")
    owned = live & (F.col("kind") == KINDS.index("owned")) & (F.col("strong") | F.col("known"))
    per_row = candidates.select("row", "start", "kind", "end", "value", "live", "strong").join(counted, "value") \
        .groupBy("row").agg(
            F.sum(F.col("example").cast("long")).alias("n_example"), F.sum(live.cast("long")).alias("n_live"),
            F.collect_list(F.when(owned, F.struct("start", "kind", "end"))).alias("added"))
    base = F.transform(F.filter("found", lambda s: s["kind"] < KINDS.index("owned")),
                       lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    return rows.select("row", "doc_id", base.alias("base")).join(per_row, "row", "left").select(
        "doc_id", "base", F.coalesce(F.array_sort("added"), none).alias("added"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"))
