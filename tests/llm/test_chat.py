import random

from pyspark.sql import functions as F

from wardflow.llm import chat, registry

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE x]", "[/ROLE]", "\\", "\\5c", "\\3c", "<", "[",
          "]", ">", " ", "\n", "ok", "é😀", "", "\n\n", "\\5b", "ROLE", "$1", "INST"]


def hostile(n):
    r = random.Random(4)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 9))) for _ in range(n)]


def conversations():
    texts = hostile(240)
    rows = []
    r = random.Random(5)
    for i in range(0, 240, 4):
        for j, t in enumerate(texts[i:i + 4]):
            rows.append((i, j, r.choice(["user", "assistant", "system", "tool", None, "a<b]c\\[x", ""]), t))
    return rows


def test_every_text_reads_back(spark):
    rows = conversations() + [(1, 0, "user", None), (1, None, "assistant", "x"), (1, 0, "user", None),
                              (None, 0, "user", "n"), (2, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    source = {}
    for c, t, role, text in rows:
        source.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(source)
    for c, turns in source.items():
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in sorted(turns)], got[c].formatted
        spans = [got[c].formatted[s.start:s.start + s.length] for s in got[c].loss_spans]
        assert spans == [t.body for t in got[c].turns if t.role == "assistant"]


def test_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(0, 0, "user", "a < b [c] \\ d"), (0, 1, "assistant", "fine")],
                               "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first().formatted == "[INST] a < b [c] \\ d [/INST]\n<s> fine </s>"


def test_parser_refuses_broken_grammar(spark):
    bad = ["", "x", "[INST] a [/INST]", "[INST] a </s>", "[INST] a [/INST] <s> b </s>", "[INST]a[/INST]", "<s> a </s>\nx"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, f string")
    ok = [r.i for r in df.select("i", chat.parse(F.col("f")).alias("t")).where("t is not null").collect()]
    assert ok == [2]


def test_native_plan_and_empty_table(spark, scratch):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).count() == 0
    df.write.parquet(f"{scratch}/conversations.parquet")
    rows = registry.op6_chat(spark, scratch).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-1, 2, 21)]
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
