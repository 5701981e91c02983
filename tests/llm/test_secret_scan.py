import random
import re

from pyspark.sql import functions as F

from wardflow.llm import secret_scan as ss

from .helpers import DOC_SCHEMA, prose, with_clashes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PATTERNS = ((0, ASSIGN), (1, re.compile("AKIA[A-Z0-9]+")), (2, re.compile("[0-9a-f]+")), (3, re.compile(ss.RUN)))


def plain_find(text):
    out = []
    for kind, p in PATTERNS:
        for m in p.finditer(text):
            value = m[2] if kind == 0 else m[0]
            if (kind == 0 and len(value) < 6) or (kind == 1 and len(value) < 20) or (kind == 2 and len(value) < 24):
                continue
            if kind == 3 and (not ss.looks(value)[0] or any(a < m.end() and m.start() < e for a, k, e, _ in out if k < 3)):
                continue
            out.append((m.start(), kind, m.end(), value))
    return sorted(out)


def brute(rows):
    """Rows are (doc_id, text, source)."""
    found = [plain_find(t or "") for _, t, _ in rows]
    places, known = {}, set()
    for (d, _, s), spans in zip(rows, found, strict=True):
        for _, kind, _, value in spans:
            places.setdefault(value, set()).add((s, d))
            if kind < 3:
                known.add(value)
    out = []
    for (d, _, _), spans in zip(rows, found, strict=True):
        example = {x[3] for x in spans if len({s for s, _ in places[x[3]]}) >= 3 or len(places[x[3]]) >= 100}
        own = {x[3] for x in spans if len({s for s, _ in places[x[3]]}) == 1} - example
        own = {v for v in own if ss.looks(v)[0]}
        added = [x[:3] for x in spans if x[1] == 3 and x[3] in own and (ss.looks(x[3])[1] or x[3] in known)]
        out.append((d, [x[:3] for x in spans if x[1] < 3], added, sum(x[3] in example for x in spans),
                    sum(x[3] in own for x in spans)))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, "en", s, None) for d, t, s in rows], DOC_SCHEMA)
    df = with_clashes(df).withColumn("owner", F.lit("x")).withColumn("row", F.lit("x")).withColumn("found", F.lit("x"))
    return sorted(((r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.added], r.n_example, r.n_live)
                   for r in ss.scan(df.repartition(parts)).collect()), key=str)


STRONG = "Zx9Kq2LmP7vR4tYw8BnC"
TEXTS = [None, "", "password=hunter22", "PASSWORD : 'x'; token token=abcdefgh", "ApI_kEy\" = \"Abc123+/=\" and secret:short",
         "password: token =\"abcdefgh\"", "key " + "0a" * 12 + " AKIA" + "B2" * 8 + "z", "AKIAAKIA" + "C" * 11, "AKIA" + "D" * 15,
         "ſecret=abcdefg toKen=abcdefg", "é😀 password=1a2b3c4d5e6f7a8b9c after", f"note {STRONG}. done", "1a2b3c4d5e6f7a8b9c bare",
         "x" * 300_000 + " token=abcdefghij", "a" + "-" * 50_000 + " b", "0123456789abcdef" * 4000, "password" + " " * 40_000 + "x"]


def test_equals_brute_force(spark):
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(TEXTS)]
    assert run(spark, rows) == brute(rows)


def test_ownership_separates_examples_from_live_credentials(spark):
    rows = [(i, f"docs say password={STRONG} here", f"s{i}") for i in range(3)]  # three owners: an example
    mine = "Qw3rTy7uIoP9aSdF5gHj"
    rows += [(10, f"bare {mine} in the open", "me"), (11, f"bare {STRONG}", "me"), (12, "bare 1a2b3c4d5e6f7a8b9c", "you"),
             (13, "password=1a2b3c4d5e6f7a8b9c", "you"), (14, "weak one2three4five6", "you")]
    rows += [(100 + i, "wide Ab1Cd2Ef3Gh4Ij5Kl6Mn", "one") for i in range(100)]  # one owner, many repositories
    got = run(spark, rows)
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by[0][3:] == (1, 0) and by[11][2] == [] and by[10][2] == [(5, 3, 25)] and by[12][2] == [(5, 3, 23)]
    assert by[14][2] == [] and by[100][2] == [] and by[100][3:] == (1, 0)


def test_random_texts(spark):
    r = random.Random(3)
    bits = ["password", "token", "api_key", "secret", "=", ":", " ", "\"", "'", "abc123", "AKIA", "0f" * 9, "Zz9", "\n", ".", "é", "-"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 60))), f"s{r.randint(0, 2)}") for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "password=hunter22", None), (None, "password=hunter22", None), (4, f"a {STRONG}", None), (4, f"a {STRONG}", None),
            (4, prose(1, 40), "s")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
