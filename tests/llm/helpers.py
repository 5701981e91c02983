"""Small frames for the operator tests."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with the operators' own.
CLASH = ("n_words", "fp", "th", "h", "kept", "spans", "shared", "doc", "quality")


def docs(spark, texts, schema=DOC_SCHEMA):
    """Documents numbered from 0; a text may be given with its id as a pair."""
    rows = []
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        rows.append((i, t, "en", "src", None if t is None else len(t)))
    return spark.createDataFrame(rows, schema)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """``n`` invented words."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df
