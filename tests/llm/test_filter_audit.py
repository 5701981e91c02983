import re
from collections import Counter
from itertools import permutations

from wardflow.llm import filter_audit as fa

from .helpers import DOC_SCHEMA, prose, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(rows, labels):
    """Rows are (doc_id, text, lang)."""
    low = {}
    for d, t, _ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    parts = {}
    for d, t, lang in rows:
        f = fails(t) + [d is not None and d > low[t or ""]]
        parts.setdefault(lang or "", []).append((f, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, docs in parts.items():
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                i = "ABCDE".index(letter)
                gone = [x for x in left if x[0][i]]
                left = [x for x in left if not x[0][i]]
                shapley[letter] += len(gone)
                failing = sum(x[0][i] for x in docs)
                alone = sum(x[0][i] and sum(x[0]) == 1 for x in docs)
                steps.append(("".join(order), step, letter, len(left), len(gone), failing - len(gone), alone,
                              sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(part, o, s, *rest, shapley[letter]) for o, s, letter, *rest in steps]
    return sorted(out)


def texts():
    rich = " ".join(f"w{i}" for i in range(130))
    return [None, "", rich, rich, "short #1", "SHOUTING " * 120, rich + " $", prose(1, 150, 30), rich, "short #1", "É" * 50,
            "w" * 200_000, "a\x0bb\x0cc\x1cd "]


def write(spark, rows, path, files):
    """One file a slice of rows, in order."""
    schema = DOC_SCHEMA
    for k in range(files):
        part = [(d, t, lang, "s", None) for d, t, lang in rows[k::files]]
        with_clashes(spark.createDataFrame(part, schema)).selectExpr("*", "1 as mask", "'x' as part", "'y' as text_key") \
            .coalesce(1).write.mode("append").parquet(path)


def check(spark, rows, labels, path, files, batches):
    write(spark, rows, path, files)
    got = fa.audit(spark, path, spark.createDataFrame(labels, LABELS), batches=batches)
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_small_ids_that_arrive_late_retract_earlier_masks(spark, scratch):
    # ids fall from file to file, so that every file moves the smallest id of each repeated text
    rows = [(1000 - i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts() * 4)]
    labels = [(d, d % 2, d % 3 == 0) for d, _, _ in rows] + [(1000, 1, None), (None, 1, 1)]
    labels = [(d, q, None if x is None else int(x)) for d, q, x in labels]
    check(spark, rows, labels, f"{scratch}/t", 6, 6)


def test_null_and_repeated_ids(spark, scratch):
    rows = [(None, "same", "en"), (5, "same", "en"), (5, "same", "de"), (5, "same", "en"), (7, "same", "en"),
            (None, "same", "fr"), (2, "same", "en"), (2, None, "en"), (9, "", "en"), (2**53 + 1, "", "en"), (2**53, "", "en")]
    check(spark, rows, [(5, 1, 0), (2, 0, 1), (7, 1, 1), (5, 0, 0)], f"{scratch}/t", 4, 4)


def test_one_text_in_most_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(fa, "MERGE_ROWS", 10)
    monkeypatch.setattr(fa, "ENTRY_ROWS", 4)
    rows = [((i * 37) % 301, "copied" if i % 3 else f"text {i}", "en") for i in range(301)]
    check(spark, rows, [], f"{scratch}/t", 3, 2)


def test_table_of_one_file_and_empty_table(spark, scratch):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    write(spark, rows, f"{scratch}/folder", 1)
    one = spark.read.parquet(f"{scratch}/folder").inputFiles()[0]
    got = fa.audit(spark, one, spark.createDataFrame([], LABELS))
    assert sorted(map(tuple, got.collect())) == brute(rows, [])
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{scratch}/empty")
    assert fa.audit(spark, f"{scratch}/empty", spark.createDataFrame([], LABELS)).collect() == []


def test_every_epoch_adds_to_its_own_folder(spark, scratch):
    """The counters are the sum of the epochs' deltas, and hold retractions."""
    rows = [(10 - i, "same", "en") for i in range(6)]
    write(spark, rows, f"{scratch}/t", 3)
    cells = fa.counters(spark, f"{scratch}/t", spark.createDataFrame([], LABELS), batches=3).collect()
    a = fails("same")
    own = sum(1 << i for i, f in enumerate(a) if f)
    assert sorted((r.part, r["mask"], r.n) for r in cells) == [("en", own, 1), ("en", own | fa.COPY, 5)]
