import math
import random
import re
import zlib

import numpy as np

from wardflow.llm import langid, pu_quality

from .helpers import DOC_SCHEMA, with_clashes

STEMS = {"xx": ["ka", "lo", "mi", "ra", "to"], "yy": ["sch", "ein", "ung", "der", "pf"], "zz": ["çã", "õe", "que", "nh", "lh"]}


def text(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def corpus(spark, n=90):
    rows = [(i, text(k, i, 5 + i), k, "s", 0) for i in range(n) for k in [list(STEMS)[i % 3]]]
    rows += [(1000, None, "xx", None, None), (1001, "", None, None, None), (1002, "12 34 ½ !!", "yy", None, None),
             (None, text("zz", 1, 40), None, None, None), (5, rows[5][1], rows[5][2], "s", 0), (1003, "漢字 仮名", None, "s", 0)]
    return rows, spark.createDataFrame(rows, DOC_SCHEMA)


def test_language_of_held_out_rows(spark):
    rows, df = corpus(spark)
    out = langid.identify(with_clashes(df), dims=2048).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == truth[r.doc_id]
        elif r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und" and r.score == 0
    assert next(r for r in out if r.doc_id is None).lang_pred == "zz"
    assert next(r for r in out if r.doc_id == 1003).rejected
    assert langid.identify(df.limit(0)).count() == 0


def test_nothing_to_learn(spark):
    _, df = corpus(spark, 6)
    out = langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in out} == {"und"}


def test_gram_counts_by_hand():
    c = langid.gram_counts("Ab 1 a", 1 << 14)
    assert c.sum() == 6 + 5 + 4 and langid.gram_counts("½ 12", 64) is None  # " ab a "


def test_non_negative_risk_separates_without_negatives():
    r = np.random.default_rng(1)
    pos = r.normal(1.5, 1, (600, 4))
    unl = np.concatenate((r.normal(1.5, 1, (700, 4)), r.normal(-1.5, 1, (300, 4))))
    prior = pu_quality.estimate_prior(pos, unl)
    assert 0.6 < prior < 0.85
    p = pu_quality.fit_nnpu(pos, unl, prior, total_steps=400).p
    good, bad = (pu_quality.sigmoid(pu_quality.raw_score(p, r.normal(m, 1, (300, 4)))) for m in (1.5, -1.5))
    assert (good >= 0.5).mean() > 0.93 and (bad < 0.5).mean() > 0.93


def test_quality_of_held_out_rows(spark):
    rows, labels = [], []
    for i in range(240):
        good = i % 6 != 0
        t = text(list(STEMS)[i % 3], i, 60) if good else " ".join([text("xx", i, 1)] * 30) + " $$$ !!! ###"
        rows.append((i, t, None, None, None))
        if i % 2:
            labels.append((i, int(good), None))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "x", None, None, None)]
    labels += [(1, 1, 0), (None, 1, 1), (7, None, None)]
    df = with_clashes(spark.createDataFrame(rows, DOC_SCHEMA))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = pu_quality.classify(df, lab).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    good, bad = ([r.score for r in held if (r.doc_id % 6 != 0) == x] for x in (True, False))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    none = pu_quality.classify(df, lab.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert pu_quality.classify(df.limit(0), lab).count() == 0


def plain_grams(t):
    """Counts of the 1- to 3-grams of a text as strings; none without a letter."""
    line = " ".join(x for x in re.split(r"[\W\d_]+", (t or "").lower()) if x)
    if not any(ch.isalpha() for ch in line):
        return {}
    line, out = f" {line} ", {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            out[line[i:i + n]] = out.get(line[i:i + n], 0) + 1
    return out


def test_prediction_equals_plain_cosines(spark):
    """Weights, cosines and the choice of language by plain loops over strings, given the fitted centroids."""
    rows, df = corpus(spark)
    dims = 1 << 14
    idf, langs, centres, _ = langid.fit(df.where(~langid.held_out("doc_id", 5, 0)), dims=dims)
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 and r[2] is not None]
    vectors = [g for g in (plain_grams(r[1]) for r in train) if g]
    place, df_of = {}, {}
    for g in {g for v in [*vectors, *(plain_grams(r[1]) for r in rows)] for g in v}:
        # the slot that the operator hashes a gram to: the slots of a lone gram's text hold it and its parts
        place[g] = slot(g, dims)
    for v in vectors:
        for k in {place[g] for g in v}:
            df_of[k] = df_of.get(k, 0) + 1
    weight = lambda k: math.log((1 + len(vectors)) / (1 + df_of.get(k, 0))) + 1
    for k in set(place.values()):
        assert abs(idf[k] - weight(k)) < 1e-5
    got = {}
    for r in langid.identify(df, dims=dims).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    for doc, t, *_ in rows:
        slots = {}
        for g, n in plain_grams(t).items():
            slots[place[g]] = slots.get(place[g], 0) + n
        vector = {k: math.log1p(n) * weight(k) for k, n in slots.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        if not norm:
            assert ("und", 0.0) in got[doc]
            continue
        cosines = [sum(x / norm * float(c[k]) for k, x in vector.items()) for c in centres]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert any(p == langs[best] and abs(s - cosines[best]) < 1e-4 for p, s in got[doc])


def slot(gram, dims):
    """Slot of a gram by the arithmetic of its definition, in plain integers."""
    wrap, mix, h = (1 << 64) - 1, 0xD6E8FEB86659FD93, 0
    for ch in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(ch)) & wrap
    h = h * mix & wrap
    return (((h ^ (h >> 32)) * mix & wrap) >> 40) % dims


def plain_risk(p, pos, unl, prior):
    """The non-negative risk by loops over rows, and its two parts."""
    def raw(x):
        hidden = [math.tanh(sum(a * b for a, b in zip(x, col)) + c) for col, c in zip(p[0].T.tolist(), p[1].tolist())]
        return sum(h * w for h, w in zip(hidden, p[2].tolist())) + float(p[3][0])

    loss = lambda z: math.log1p(math.exp(-z))
    gp, gu = [raw(x) for x in pos.tolist()], [raw(x) for x in unl.tolist()]
    first = prior * sum(map(loss, gp)) / len(gp)
    rest = sum(loss(-g) for g in gu) / len(gu) - prior * sum(loss(-g) for g in gp) / len(gp)
    return first + max(0.0, rest), first, rest


def test_training_minimises_the_plain_risk():
    r = np.random.default_rng(3)
    pos = r.normal(1, 1, (120, 3))
    unl = np.concatenate((r.normal(1, 1, (140, 3)), r.normal(-1, 1, (100, 3))))
    risks = [plain_risk(pu_quality.fit_nnpu(pos, unl, 0.58, total_steps=n, batch=1000).p, pos, unl, 0.58)[0] for n in (1, 40, 300)]
    assert risks[0] > risks[1] > risks[2]
    best = pu_quality.fit_nnpu(pos, unl, 0.58, total_steps=300, batch=1000).p
    worse = 0
    for _ in range(20):  # no random step of some size lowers the risk by much
        moved = [x + r.normal(0, 0.3, x.shape) for x in best]
        worse += plain_risk(moved, pos, unl, 0.58)[0] > risks[2]
    assert worse >= 19


def test_one_step_follows_the_slope_of_the_plain_risk():
    """The step's direction is that of the risk's numeric slope, in the usual case and in the reversed one."""
    r = np.random.default_rng(5)
    pos, unl = r.normal(0.5, 1, (40, 2)), r.normal(-0.2, 1, (50, 2))
    for prior in (0.2, 3.0):  # with the second prior the rest is negative
        start = pu_quality.Scorer(2, seed=7).p
        _, _, rest = plain_risk(start, pos, unl, prior)
        assert (rest < 0) == (prior == 3.0)
        after = pu_quality.fit_nnpu(pos, unl, prior, total_steps=1, batch=1000, rate=1e-3, decay=0.0, seed=7).p
        for k in (2, 3):
            for i in range(len(start[k])):
                up, down = [x.copy() for x in start], [x.copy() for x in start]
                up[k][i] += 1e-5
                down[k][i] -= 1e-5
                part = 0 if rest >= 0 else 2
                slope = (plain_risk(up, pos, unl, prior)[part] - plain_risk(down, pos, unl, prior)[part]) / 2e-5
                slope = slope if rest >= 0 else -slope  # the reversed step raises the rest again
                if abs(slope) > 1e-3:
                    assert np.sign(after[k][i] - start[k][i]) == -np.sign(slope)


def test_scores_by_plain_loops(spark):
    rows = [(i, text("xx", i, 20 + i) if i % 3 else "$$$ !!! ### " * 9, None, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    lab = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = {}
    fit = pu_quality.fit_nnpu

    def seen(pos, unl, prior, **options):
        kept["model"], kept["sizes"] = fit(pos, unl, prior, total_steps=200), (len(pos), len(unl))
        return kept["model"]

    pu_quality.fit_nnpu = seen
    try:
        out = pu_quality.classify(df, lab, max_positive=15, max_unlabelled=25).collect()
    finally:
        pu_quality.fit_nnpu = fit
    assert kept["sizes"] == (15, 25)
    x = [pu_quality.features(t) for _, t, *_ in rows]
    mean = [sum(c) / len(x) for c in zip(*x)]
    spread = [max(1e-6, math.sqrt(sum((v - m) ** 2 for v in c) / len(x))) for c, m in zip(zip(*x), mean)]
    p = kept["model"].p
    for r in out:
        z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(x[r.doc_id], mean, spread)]
        hidden = [math.tanh(sum(a * b for a, b in zip(z, col)) + c) for col, c in zip(p[0].T.tolist(), p[1].tolist())]
        raw = sum(h * w for h, w in zip(hidden, p[2].tolist())) + float(p[3][0])
        assert abs(r.score - 1 / (1 + math.exp(-raw))) < 1e-4


def test_a_repeated_row_does_not_fill_the_sample_beyond_its_bound(spark):
    df = spark.createDataFrame([(1, [0.5] * len(pu_quality.FEATURES))] * 500, "doc_id long, x array<double>")
    assert len(pu_quality._sample(df, 40, 500)) <= 40
