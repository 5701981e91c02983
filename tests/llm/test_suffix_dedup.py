import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.llm import suffix_dedup as sd

from .helpers import docs, prose, with_clashes


def brute(texts, n):
    """(removed mask) of each text."""
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - n + 1):
            seen[b[i:i + n]] = seen.get(b[i:i + n], 0) + 1
    out = []
    for b in data:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                mask[i:i + n] = True
        out.append(mask)
    return data, out


def check(spark, texts, n, **options):
    rows = sorted(sd.remove_repeats(docs(spark, texts), min_len=n, **options).collect(), key=lambda r: r.doc_id)
    data, masks = brute(texts, n)
    assert len(rows) == len(texts)
    for r, b, m in zip(rows, data, masks, strict=True):
        runs = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(m.sum()), runs), r.doc_id
        assert bytes(r.kept) == bytes(np.frombuffer(b, np.uint8)[~m])


def shuffled(seed, n_docs=10):
    """Documents of shared and own passages, some overlapping, periodic or nested."""
    r = random.Random(seed)
    shared = [prose(seed + i, r.randint(5, 60)) for i in range(5)]
    out = []
    for i in range(n_docs):
        parts = []
        for _ in range(r.randint(1, 6)):
            s = r.choice(shared)
            cut = r.randint(0, len(s) // 2)
            parts.append(r.choice([s, s[cut:], s[: len(s) - cut], prose(1000 * seed + i, 15), "ab" * r.randint(5, 200)]))
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("seed,n", [(1, 20), (2, 50), (3, 200)])
def test_removal_equals_brute_force(spark, seed, n):
    check(spark, [*shuffled(seed), None, "", "short", "é" * 300, "é" * 250, "z" * 700], n)


def test_hot_anchor_is_opened(spark):
    """More different regions of one anchor than a group may hold give the same result."""
    core = prose(9, 30)
    texts = [prose(100 + i, 20) + core + prose(200 + i % 4, 20) for i in range(30)]
    check(spark, texts, 60, max_group=3)


def test_runs_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 64)
    finder = sd.AnchorFinder(50)
    small = [x.tolist() for x in finder.find(prose(4, 300).encode())]
    monkeypatch.setattr(sd, "BLOCK", 1 << 20)
    whole = [x.tolist() for x in sd.AnchorFinder(50).find(prose(4, 300).encode())]
    assert small == whole


def test_groups_hold_all_occurrences(spark):
    core = prose(7, 40)
    texts = [prose(10 + i, 10) + " " + core + " " + prose(50 + i, 10) for i in range(5)]
    groups = sd.repeat_groups(docs(spark, texts), min_len=60).collect()
    found = {}
    for g in groups:
        assert g.length >= 60
        found.setdefault((g.h, g.c, g.part), []).append((texts[g.doc].encode()[g.start:g.start + g.length], g.doc))
    for members in found.values():
        assert len({t for t, _ in members}) == 1 and len(members) > 1
    assert any({d for _, d in members} == set(range(5)) for members in found.values())


def test_interval_tree_finds_diverse_left_extensions():
    rights = [b"abcdX", b"abcdY", b"abceZ"]
    lefts = [b"qr1", b"qr2", b"qx3"]
    got = {(left, right, tuple(sorted(m))) for left, right, m in sd.maximal_repeats(rights, lefts, 4)}
    assert (2, 4, (0, 1)) in got and (1, 3, (0, 1, 2)) in got


def test_text_output_keeps_whole_characters_and_rows(spark):
    a = prose(1, 50) + "é"
    df = with_clashes(docs(spark, [a + " x " + prose(2, 5), "y " + a[:-1] + "è", None, (None, a), (0, "own")]))
    out = sd.drop_passages(df, min_len=60)
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == 5
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    assert any(r.text == "own" for r in rows) and any(r.text is None for r in rows)
    assert sd.drop_passages(df.limit(0), min_len=60).count() == 0


def test_columns_with_the_operators_names_keep_their_values(spark):
    a = prose(1, 50)
    df = docs(spark, [a + " x", "y " + a, "own", None])
    for i, c in enumerate([*sd.RESULT, "doc", "th", "spans", "start", "h"]):
        df = df.withColumn(c, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    out = sd.drop_passages(df, min_len=60)
    assert out.columns == df.columns
    before = {r.doc_id: r.asDict() for r in df.collect()}
    for r in out.collect():
        want, got = before[r.doc_id], r.asDict()
        assert {k: v for k, v in got.items() if k not in ("text", "n_chars")} == {
            k: v for k, v in want.items() if k not in ("text", "n_chars")}
        assert (got["text"] != want["text"]) == (r.doc_id < 2)


def test_repeated_rows_do_not_make_a_large_group(spark, monkeypatch):
    """300 equal rows of three documents reach the scan at most once a task, and only once a group."""
    core = prose(9, 30)
    texts = [(i % 3, prose(100 + i % 3, 20) + core + prose(200 + i % 3, 20)) for i in range(300)]
    df = docs(spark, texts).repartition(4)
    rows = sd.remove_repeats(df, min_len=60).collect()
    assert len(rows) == 300 and all(r.n_removed == r.n_bytes for r in rows)
    found = sd.repeat_groups(docs(spark, texts[:3]).union(docs(spark, texts[:1])), min_len=60).collect()
    keys = [tuple(g) for g in found if g.part > 0]
    assert len(keys) == len(set(keys))
    source = sd._source(df, "doc_id", "text")
    wanted = source.select("doc", "th", "body").distinct().select("doc", "th").collect()
    rows = source.withColumn("wanted", F.expr("array(named_struct('h', 1L, 'at', 256L))")).mapInArrow(
        sd._regions(60), "h long, left binary, right binary, doc long, th long, anchor long").collect()
    assert len(wanted) == 3 and len(rows) <= 3 * 4
