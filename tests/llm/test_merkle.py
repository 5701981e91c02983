from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from wardflow.llm import merkle, registry

from .helpers import DOC_SCHEMA, prose, with_clashes


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def brute(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    by = {}
    for d, text, lang, source, n in rows:
        changed = text
        if d is not None and crc32(str(d).encode()) % 2 == 0 and text is not None:
            changed = text.replace("\n", "")
        by.setdefault(source, []).append((d is not None, d or 0, leaf((d, source, lang, n, text)), d,
                                          leaf((d, source, lang, n, changed))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, (_, _, own, d, now) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            siblings = []
            for levels, j in ((trees[s], i), (top, k)):
                for nodes in levels[:-1]:
                    at = j - j % 3
                    left, right = nodes[at:j], nodes[j + 1:at + 3]
                    siblings += left + right
                    now, j = H(*left, now, *right), j // 3
            out.append((d, own, trees[s][-1][0], root, H(*siblings), now, now == root))
    return out


def run(spark, rows, forge=True):
    df = with_clashes(spark.createDataFrame(rows, DOC_SCHEMA)).withColumn("tree", F.lit("x")).withColumn("pos", F.lit("x"))
    row = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in merkle.COLUMNS]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return [tuple(r) for r in merkle.manifest(df.repartition(3), forged=F.when(odd, merkle.digest_of(*row)) if forge else None)
            .collect()]


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


def sample(n, sources):
    return [(i, prose(i, 6) + ("\n" if i % 3 else " ") + "é end" * (i % 2), "en", sources[i % len(sources)], i) for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_equals_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "SPAN", 3**height)
    rows = sample(90, ["b", "a", "ä", "b", "b"]) + [(1000, "alone\n", None, "z", None)]
    got = run(spark, rows)
    assert same(got, brute(rows)) and 0 < sum(r[-1] for r in got) < len(got)


def test_nulls_repeats_and_ties(spark):
    rows = [(None, "a\nb", None, None, None), (None, None, "en", None, 3), (5, None, "en", None, 3), (5, "x\ny", "en", "s", 3),
            (5, "x\ny", "en", "s", 3), (5, "x\nz", "en", "s", 3), (2, "", "", "", 0), (7, "w" * 100_000 + "\n", "en", "s", 1)]
    assert same(run(spark, rows), brute(rows))


def test_one_row_many_sources_and_empty(spark):
    one = [(3, "only\none", "en", "s", 8)]
    got = run(spark, one)
    assert same(got, brute(one)) and got[0][4] == sha256(b"").hexdigest() and got[0][1] == got[0][3]
    many = [(i, f"t{i}", "en", f"s{i}", 1) for i in range(40)]
    assert same(run(spark, many), brute(many))
    assert run(spark, []) == []


def test_without_tampering_all_verify(spark):
    got = run(spark, sample(30, ["a", "b"]), forge=False)
    assert len(got) == 30 and all(r[-1] and r[-2] == r[3] for r in got)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = [tuple(r) for r in registry.op13_merkle(spark, "/root/testdata/sf0.001").collect()]
    assert same(got, brute([tuple(r) for r in docs.collect()]))
