import re

import numpy as np
import pytest
import xxhash

from wardflow.llm import simhash
from wardflow.llm.components import connected_components

from .helpers import docs, prose, with_clashes


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """Smallest index reachable over links of at most two bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_golay_tables_are_perfect():
    tables = simhash.golay_tables()
    assert len(set(tables[1].tolist())) == 2048
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 300)
    keys = simhash.golay_keys(words, tables)
    assert {len(set(k)) for k in keys.tolist()} <= {1, 6}
    for bits in ((), (3,), (5, 17)):
        other = words ^ sum(1 << b for b in bits)
        near = simhash.golay_keys(other, tables)
        assert all(set(a) & set(b) for a, b in zip(keys.tolist(), near.tolist(), strict=True))


TEXTS = [None, "", "  \n", "One", "one two", "One Two three", "É x y z", prose(1, 300), prose(1, 300).upper(),
         prose(1, 300) + " tail", prose(2, 5000), prose(3, 40), prose(3, 40), "a b c\x0bd e"]


def test_components_equal_brute_force(spark):
    df = with_clashes(docs(spark, TEXTS))
    rows = sorted(simhash.simhash_components(df).collect())
    fps = [brute_fp(t) for t in TEXTS]
    assert [r.fp % (1 << 64) for r in rows] == fps
    assert [r.component_id for r in rows] == brute_groups(fps)


@pytest.mark.parametrize("pairwise,max_run", [(128, 65536), (3, 65536), (3, 8)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, pairwise, max_run):
    """Chains of one-bit steps and stars, through the pairwise, ball and hot-key ways."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    r = np.random.default_rng(3)
    fps = [int(x) for x in r.integers(0, 1 << 63, 20)]
    for base in fps[:3]:
        chain = base
        for b in r.permutation(21)[:12]:
            chain ^= 1 << int(b)
            fps.append(chain)
    fps = sorted({x for x in fps})
    batches = [[x - (1 << 64) if x >> 63 else x] for x in fps]
    df = spark.createDataFrame(batches, "fp long")
    keyed = df.mapInArrow(simhash._key_rows, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 4)  # a hot key is one that goes on over batches
    try:
        links = keyed.mapInArrow(simhash._link(2, max_run), "a long, b long, word long").distinct().collect()
    finally:
        spark.conf.set(batch, before)
    by_word = {}
    pairs = [(x.a, x.b) for x in links if x.word is None]
    for x in links:
        if x.word is not None:
            pairs.append((x.a, by_word.setdefault(x.word, x.a)))
    assert (max_run > 100) == (not by_word)
    at = {x % (1 << 64): i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(at[a % (1 << 64)]), find(at[b % (1 << 64)])))
        root[y] = x
    assert [find(i) for i in range(len(fps))] == brute_groups(fps)


def test_connected_components(spark):
    r = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(int(a), int(b)) for a, b in r.integers(0, 60, (40, 2))] + [(7, 7), (200, None), (None, None)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and 200 not in got
    for a, b in edges:
        if a is not None and b is not None and a != b:
            assert got[a] == got[b] <= min(a, b)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    df = with_clashes(docs(spark, [prose(1, 80), prose(1, 80), (None, prose(1, 80)), prose(2, 80), (3, prose(2, 80)), None]))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "5", "None"]
    assert simhash.keep_one(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_components(df, max_bits=3)


def test_keep_one_of_repeated_and_null_ids(spark):
    """Every group keeps one row with an id, whatever other texts its ids have; and at most one row without."""
    a, b, c, d, e = (prose(i, 80) for i in range(11, 16))
    rows = [(5, a), (7, a), (8, a), (3, b), (5, b), (9, c), (9, d), (10, d), (2, e), (2, e.upper()),
            (None, a), (None, a), (None, a.upper()), (None, prose(20, 80)), (None, prose(20, 80)), (4, None), (4, ""), (6, " ")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(with_clashes(docs(spark, rows))).collect()]
    lower = sorted((str(i), (t or "").lower()) for i, t in kept)
    want = [(5, a), (3, b), (9, c), (9, d), (2, e), (None, a), (None, prose(20, 80)), (4, "")]
    assert lower == sorted((str(i), t.lower()) for i, t in want)
    assert all(x in rows for x in kept)
