import random
import re

import pytest

from wardflow.llm import decontaminate as dc

from .helpers import docs, prose, with_clashes


def shingle_set(text, size=5, k=None):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    k = k or min(size, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(texts, items, threshold=0.8):
    out = set()
    for item, text in items:
        own = shingle_set(text)
        if own:
            k = len(next(iter(own)))
            for d, t in enumerate(texts):
                shared = len(own & shingle_set(t, k=k))
                if shared >= threshold * len(own):
                    out.add((d, item, len(own), shared))
    return out


ITEMS = [(i, prose(500 + i, n)) for i, n in enumerate((1, 3, 5, 9, 14, 25, 33, 60, 120))] + [
    (20, None), (21, " !! "), (22, prose(504, 14)), (None, prose(600, 20))]


def edited(text, n, seed):
    """``text`` with ``n`` words replaced."""
    w = text.split()
    for i in random.Random(seed).sample(range(len(w)), n):
        w[i] = f"zz{i}"
    return " ".join(w)


def test_matches_equal_brute_force(spark):
    texts = [None, "", prose(1, 50)]
    for i, (_, t) in enumerate(ITEMS):
        if t:
            texts += [prose(i, 3000) + " " + t + " " + prose(90 + i, 2000), "So: " + t.upper().replace(" ", ",  ") + "."]
            if len(t.split()) > 20:
                texts += [prose(i, 30) + " " + edited(t, n, n) + " end" for n in (1, 2, 3, 4)]
                texts.append(" ".join(t.split()[: int(0.9 * len(t.split()))]))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc, r.item, r.n_shingles, r.n_shared) for r in dc.find_contaminated(with_clashes(docs(spark, texts)), bench).collect()}
    assert got == brute(texts, ITEMS)
    assert len(got) > 20 and any(n > m for _, _, n, m in got)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 55, 400])
def test_sketch_cannot_miss(n):
    """A document that lacks as much as the threshold allows still holds a kept shingle."""
    lacking = max(m for m in range(n + 1) if n - m >= 0.8 * n)
    assert lacking < dc.sketch_size(n, 0.8) or lacking == n == 0


def test_drop_contaminated(spark):
    bench = spark.createDataFrame([(0, prose(1, 20))], "item_id long, text string")
    df = with_clashes(docs(spark, [prose(1, 20) + " more", (None, "x " + prose(1, 20)), None, prose(2, 30), prose(2, 30)]))
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert dc.drop_contaminated(df.limit(0), bench).count() == 0
    assert dc.drop_contaminated(df, bench.limit(0)).count() == 5
