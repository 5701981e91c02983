import re
from collections import Counter

from pyspark.sql import functions as F

from wardflow.llm import quality_rules as qr

from .helpers import docs, prose, with_clashes


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    many = Counter(shingles)
    covered = {j for i, s in enumerate(shingles) if many[s] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), len(ws) < 10 or 100 * len(covered) > 20 * len(ws))


TEXTS = [
    None, "", " \t\n", "one", "a b c d e", prose(1, 200), prose(1, 40) + "\n" + prose(1, 40), "x y " * 50,
    "a\x0bb\x0cc\rd e \n\n a", "# $ % & | < > *** " * 5 + prose(2, 30), "é ü " + prose(3, 60) + " ￿ 😀",
    "\n".join(["same line here"] * 5 + [prose(4, 30)]), prose(5, 20000), "w " * 3000,
]


def test_statistics_equal_brute_force(spark):
    out = qr.quality_rules(docs(spark, TEXTS)).select("doc_id", "quality.*").orderBy("doc_id").collect()
    assert len(out) == len(TEXTS)
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(TEXTS[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_prose_is_kept_and_junk_goes(spark):
    good = ("The cat of the house is in the garden and it was on the wall.\n"
            "They have seen that this is not the only way to be at peace with a dog.")
    bad = ["buy $$$ now ### free *** " * 8, "same words again and again " * 20, "A B C"]
    rows = {r.doc_id for r in qr.keep_good(docs(spark, [good, *bad])).collect()}
    assert rows == {0}


def test_columns_pass_through_and_empty_table(spark):
    df = with_clashes(docs(spark, [prose(1, 5), None, "the of and to in is that it for was on are"]))
    kept = qr.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 1
    assert qr.quality_rules(df).select("quality.n_words").count() == 3
    assert qr.keep_good(df.limit(0)).count() == 0


def test_one_projection(spark):
    plan = qr.quality_rules(docs(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_are_parameters(spark):
    df = docs(spark, [prose(1, 50), prose(2, 150)])
    rules = (qr.Rule("length", "n_words", low=100),)
    assert [r.doc_id for r in qr.keep_good(df, rules=rules).collect()] == [1]
    assert qr.keep_good(df, rules=()).select(F.col("doc_id")).count() == 2
