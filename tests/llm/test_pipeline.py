import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wardflow.llm import quality_rules as qr

from . import test_decontaminate as td
from . import test_packing as tp
from . import test_quality_rules as tq
from . import test_simhash as ts
from . import test_suffix_dedup as tx
from .helpers import docs

STOPS = "the of and to in is that it for was on are as with his they at be this have".split()


def english(seed, n):
    r = random.Random(seed)
    own = ["".join(r.choice("abcdefghilmnoprstuy") for _ in range(r.randint(3, 9))) for _ in range(300)]
    return " ".join(r.choice(STOPS) if r.random() < 0.3 else r.choice(own) for _ in range(n))


def fixture():
    boiler = english(77, 60)  # over 200 bytes, in several documents
    item = english(88, 30)
    texts = [english(i, 60 + 9 * i) for i in range(8)]
    texts += [texts[0], texts[1] + " "]  # copies
    texts += [english(20 + i, 40) + "\n" + boiler + "é\n" + english(30 + i, 50) for i in range(3)]
    texts += [english(40, 300) + " " + item + " " + english(41, 200), english(42, 20) + "\n" + item.upper()]
    texts += [None, "", "too short", "$$$ ### %%% " * 40, "spam words here " * 60, english(50, 4000)]
    return texts, [(1, item), (2, english(99, 25)), (3, None)]


def brute(texts, items):
    """(id, text) after the first four stages."""
    rows = []
    for i, t in enumerate(texts):
        n_words, word_chars, n_symbols, n_dup, n_repeat, failed = tq.brute(t)
        if failed:
            continue
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        stops = sum(w.lower() in qr.STOP_WORDS for w in t.split())
        value = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
                 "n_lines": len(lines), "n_repeat_words": n_repeat, "n_stop_words": stops}
        ok = True
        for rule in qr.RULES:
            num, _, den = rule.value.partition(" / ")
            v = value[num] / value[den] if den else value[num]
            if n_words >= rule.min_words:
                ok &= (rule.low is None or v >= rule.low) and (rule.high is None or v <= rule.high)
        if ok:
            rows.append((i, t))
    groups = ts.brute_groups([ts.brute_fp(t) for _, t in rows])
    rows = [row for k, row in enumerate(rows) if groups[k] == k]
    data, masks = tx.brute([t for _, t in rows], 200)
    cut = []
    for (i, _), b, m in zip(rows, data, masks, strict=True):
        m = m.copy()
        at = 0
        for ch in b.decode():  # a character goes only if all of its bytes go
            n = len(ch.encode())
            m[at:at + n] = m[at:at + n].all()
            at += n
        cut.append((i, bytes(np.frombuffer(b, np.uint8)[~m]).decode()))
    bad = {d for d, *_ in td.brute([t for _, t in cut], items)}
    return [row for k, row in enumerate(cut) if k not in bad]


def test_run_equals_brute_force(spark, scratch):
    texts, items = fixture()
    docs(spark, texts).repartition(3).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    want = brute(texts, items)
    assert 8 < len(want) < len(texts) - 6
    frame = spark.read.parquet(f"{scratch}/documents.parquet")
    columns = frame.columns
    for name, stage in cp.STAGES[:-1]:
        frame = cp.write_table(stage(spark, frame, scratch))
        assert frame.columns == columns, name
    assert sorted((r.doc_id, r.text) for r in frame.collect()) == want
    assert frame.where(F.col("n_chars") != F.length("text")).count() == 0
    rows = cp.run(spark, scratch).collect()
    order = {d: k for k, (d, _) in enumerate(want)}
    tp.check([type("R", (), r.asDict() | {"doc_id": order[r.doc_id]}) for r in rows], [t for _, t in want], 2048)


def test_empty_documents(spark, scratch):
    docs(spark, ["x"]).limit(0).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    assert cp.run(spark, scratch).count() == 0


def test_stages_are_the_listed_ones():
    assert [f.__module__ for _, f in cp.STAGES] == ["corpus_pipeline"] * 5 and len(cp.STAGES) == 5
