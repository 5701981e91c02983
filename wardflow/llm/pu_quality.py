"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a scorer that minimises the
non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss: where the second part falls below zero its gradient is
reversed.  The class prior is estimated from the data: a first scorer ranks
positives against unlabelled rows, and the smallest ratio of the unlabelled to
the positive share above a cut, with a confidence allowance, bounds the prior.
No negative label is read.

One pass over the corpus turns each whole text into some thirty shape features
(a table the size of the ids); their mean and spread come from all rows.  The
scorer is fitted on at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` different rows,
the first in the order of a hash.

Defined cases: null and empty texts have the features of an empty text and are
scored like any other; without a positive or an unlabelled training row every
score is 0; labels that repeat or contradict themselves count as positive if one
of them is 1; a null id is held out by the hash of the empty text and has no
label; repeated rows are returned row by row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import write_table

from .langid import held_out

MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
THRESHOLD = 0.7
HIDDEN = 24

FEATURES = (
    "log_words", "mean_word", "sd_word", "upper_words", "upper_chars", "digits", "symbols", "bangs", "marked_words",
    "stops", "distinct_words", "top_word", "echo_words", "distinct_pairs", "distinct_fives", "log_lines", "dup_lines",
    "words_a_line", "bar_words", "letters", "entropy", "distinct_chars", "long_words", "one_char_words", "title_words",
    "words_a_sentence", "bracketed", "non_ascii",
)


def features(text: str | None) -> list[float]:
    """Shape features of a whole text; all finite."""
    text = text or ""
    words = text.split()
    n, m = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    w, c = max(1, n), max(1, m)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lowered = [x.lower() for x in words]
    counts = Counter(lowered)
    chars = Counter(text)
    share = np.array(list(chars.values()), np.float64) / c if chars else np.ones(1)
    pick = lambda marks: sum(chars.get(x, 0) for x in marks)
    letters = sum(v for k, v in chars.items() if k.isalpha())
    upper = sum(v for k, v in chars.items() if k.isupper())
    pairs = len(set(zip(lowered, lowered[1:], strict=False))) if n > 1 else 1
    fives = len({tuple(lowered[i:i + 5]) for i in range(n - 4)}) if n > 4 else 1
    symbols = pick("#*$%&|<>~^=_{}\\@")
    return [
        math.log1p(n), float(sizes.mean()), float(sizes.std()), sum(x.isupper() for x in words) / w, upper / c,
        sum(v for k, v in chars.items() if k.isdigit()) / c, symbols / w, chars.get("!", 0) / w,
        sum(not x[-1].isalnum() for x in words) / w, pick(".?!") / w, len(counts) / w ** 0.9,
        max(counts.values(), default=0) / w, sum(a == b for a, b in zip(lowered, lowered[1:], strict=False)) / w,
        pairs / max(1, n - 1), fives / max(1, n - 4), math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)) / 100, sum(x == "|" for x in words) / w, letters / c, float(-(share * np.log(share)).sum()),
        math.log1p(len(chars)), float((sizes > 15).mean()), float((sizes == 1).mean()),
        sum(x.istitle() for x in words) / w, n / max(1, pick(".?!")) / 100, pick("()[]{}<>") / w,
        sum(v for k, v in chars.items() if ord(k) > 127) / c,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = pa.array([features(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))
        yield pa.record_batch([b.column(0), b.column(1), rows], names=["doc_id", "held_out", "x"])


def raw_score(p: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3][0]


class Scorer:
    """One hidden layer over scaled features, trained with Adam."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, size ** -0.5, (size, hidden)), np.zeros(hidden), r.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.m = [np.zeros_like(x) for x in self.p]
        self.v = [np.zeros_like(x) for x in self.p]
        self.t = 0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return raw_score(self.p, x)

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        """One Adam step along d(risk)/d(raw score) = ``slope``."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        back = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [x.T @ back + decay * self.p[0], back.sum(axis=0), h.T @ slope + decay * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for p, m, v, g in zip(self.p, self.m, self.v, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, total_steps: int = 2000, batch: int = 1024,
             rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Scorer:
    """Minimise the non-negative risk of the logistic loss by mini-batches."""
    r, net = np.random.default_rng(seed), Scorer(pos.shape[1])
    steps = max(1, math.ceil(len(unl) / batch))
    epochs = math.ceil(total_steps / steps)
    for epoch in range(epochs):
        order_u, order_p = r.permutation(len(unl)), r.permutation(len(pos))
        for i in range(steps):
            u = unl[order_u[i::steps]]
            p = pos[order_p[i::steps]] if len(pos) >= steps else pos
            x = np.concatenate((p, u))
            g = net.raw(x)
            s = sigmoid(g)
            sp, su = s[: len(p)], s[len(p):]
            # loss of calling a row negative is log(1 + e^g), its slope sigmoid(g)
            rest = np.logaddexp(0, g[len(p):]).mean() - prior * np.logaddexp(0, g[: len(p)]).mean()
            if rest >= 0:
                slope = np.concatenate(((prior * (sp - 1) - prior * sp) / len(p), su / len(u)))
            else:
                slope = np.concatenate((prior * sp / len(p), -su / len(u)))
            net.step(x, slope, rate / (1 + 3 * epoch / epochs), decay)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """Share of positives among unlabelled rows: the best-bin bound over a first scorer's ranking."""
    r = np.random.default_rng(seed)
    fold_p, fold_u = r.random(len(pos)) < 0.5, r.random(len(unl)) < 0.5
    if min(fold_p.sum(), (~fold_p).sum(), fold_u.sum(), (~fold_u).sum()) < 10:
        return 0.5
    net = Scorer(pos.shape[1], seed=seed)
    a, b = pos[fold_p], unl[fold_u]
    x = np.concatenate((a, b))
    y = np.concatenate((np.ones(len(a)), np.zeros(len(b))))
    weight = np.concatenate((np.full(len(a), 0.5 / len(a)), np.full(len(b), 0.5 / len(b))))
    for _ in range(200):
        net.step(x, weight * (sigmoid(net.raw(x)) - y), 0.02, 1e-4)
    sp, su = np.sort(net.raw(pos[~fold_p])), np.sort(net.raw(unl[~fold_u]))
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    allowance = math.sqrt(math.log(20) / (2 * len(su))) + math.sqrt(math.log(20) / (2 * len(sp)))
    at = int(np.argmin((qu + allowance) / qp))
    return float(min(0.99, max(0.01, qu[at] / qp[at])))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, spread, params = model.value
        for b in batches:
            x = np.array(b.column(2).to_pylist(), np.float64).reshape(b.num_rows, len(mean))
            score = np.zeros(b.num_rows) if params is None else sigmoid(raw_score(params, scale(x, mean, spread)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(score),
                                   pa.array((score >= THRESHOLD).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    return run


def scale(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -6, 6)


def _sample(rows: DataFrame, size: int, total: int) -> np.ndarray:
    """At most ``size`` different rows, the first in the order of a hash of id and features."""
    place = F.xxhash64("doc_id", "x")
    share = F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53))
    # somewhat more than the wanted share (eight deviations), so that few rows travel at any size of the table; repeated
    # rows pass together and are made one before they do
    chosen = rows.where(share * total < size + 8 * math.sqrt(size) + 16).select(place.alias("place"), "doc_id", "x").distinct()
    found = chosen.orderBy("place", "doc_id", "x").limit(size).toPandas()
    return np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", max_positive: int = MAX_POSITIVE,
             max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; learns positives only from rows that are not held out."""
    table = write_table(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("t")
    ).mapInArrow(_measure, "doc_id long, held_out boolean, x array<double>"))
    stats = table.select([F.col("x")[i].alias(n) for i, n in enumerate(FEATURES)]).agg(
        *[f(n).alias(f"{k}_{n}") for n in FEATURES for k, f in (("m", F.mean), ("s", F.stddev_pop))]).first()
    # rounded: the last digits of a distributed sum depend on the order of its parts
    mean = np.array([round(stats[f"m_{n}"] or 0.0, 9) for n in FEATURES])
    spread = np.maximum(np.array([round(stats[f"s_{n}"] or 0.0, 9) for n in FEATURES]), 1e-6)
    train = table.where("not held_out and doc_id is not null")
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    positive = train.join(trusted, "doc_id", "left_semi")
    n_pos, n_all = positive.count(), train.count()
    pos, unl = _sample(positive, max_positive, n_pos), _sample(train, max_unlabelled, n_all)
    params = None
    if len(pos) and len(unl):
        pos, unl = scale(pos, mean, spread), scale(unl, mean, spread)
        params = fit_nnpu(pos, unl, estimate_prior(pos, unl)).p
    model = docs.sparkSession.sparkContext.broadcast((mean, spread, params))
    return table.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
