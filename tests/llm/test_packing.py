import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from wardflow.llm import packing as pk

from .helpers import docs, prose, with_clashes

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    t = Tokenizer.from_file(PATH)
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


TEXTS = [None, "", "Hello, World!", "don't STOP it's 3.14 x²", "<|endoftext|> A<|startoftext|>b <|ENDOFTEXT|>", "ÀÉ é ñ ß Σας İ ½ Ⅷ 漢字 😀!!",
         "a b\x0bc\x0cd\x1ce　f", "W̊ ẘ é ́x", "word...word ?! 'll 'LL I'm",
         "ÉCOLE L'Été, naïve... o'clock_x a× ÷b µm ªº “quoted…!” it's'", "Wow W̊ Ẉ̇ don't", prose(1, 9000), prose(2, 700)]


def test_word_encoder_equals_the_tokenizer():
    with open(PATH, encoding="utf-8") as f:
        enc = pk.WordEncoder(f.read())
    for t in TEXTS:
        ws = enc.words((t or "").encode())
        enc.learn(set(ws))
        assert b"".join(enc.cache[w] for w in ws) == ids(t)[:-1].tobytes(), t


def test_one_cache_holds_words_and_their_parts():
    with open(PATH, encoding="utf-8") as f:
        enc = pk.WordEncoder(f.read())
    enc.learn({b"river", b"river,", b"it's", b"River"})
    assert set(enc.cache) == {b"river", b"river,", b",", b"it's", b"it", b"'s", b"River"}
    assert not [x for x in vars(enc).values() if isinstance(x, dict) and x is not enc.cache and x is not enc.alphabet]


def test_workers_get_texts_in_small_batches(spark):
    """However wide the rows are, few of them are held at once; the session's own setting stays."""
    from wardflow.session import arrow_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    seen, pieces = [], pk._pieces

    def watched(*args):
        seen.append(int(spark.conf.get(key)))
        return pieces(*args)

    pk._pieces = watched
    try:
        pk.pack(spark.range(1200).selectExpr("id as doc_id", "'a b' as text"), PATH)
    finally:
        pk._pieces = pieces
    assert seen == [pk.BATCH_TEXTS] and spark.conf.get(key) == before

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows, b.nbytes])], ["n"])

    wide = spark.range(0, 1200, 1, 1).selectExpr("repeat('x', 100000) as text")
    with arrow_batches(spark, pk.BATCH_TEXTS, pk.BATCH_BYTES):
        found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(found[::2]) == 1200 and max(found[1::2]) < 2 * 4 * 2**20


def test_best_fill_is_optimal():
    r = random.Random(1)
    for _ in range(60):
        counts = {r.randint(1, 15): r.randint(1, 3) for _ in range(r.randint(1, 4))}
        room = r.randint(1, 40)
        got = pk.best_fill(counts, room)
        assert all(got[k] <= counts[k] for k in got)
        sums = {sum(k * n for k, n in zip(counts, take, strict=True))
                for take in product(*[range(v + 1) for v in counts.values()])}
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def test_plan_uses_the_multiset_once():
    r = random.Random(2)
    counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(30)}
    plan = pk.plan_patterns(counts, 64)
    used = {}
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


def check(rows, texts, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, pieces in by_doc.items():
        whole, at = ids(texts[d]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(whole[at:at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_pieces_cover_every_document(spark):
    texts = TEXTS + [prose(10 + i, 5 + 7 * i) for i in range(60)]
    for window in (64, 2048):
        rows = pk.pack(with_clashes(docs(spark, texts)).repartition(5), PATH, window=window).collect()
        check(rows, texts, window)
    tokens = sum(len(ids(t)) for t in texts)
    assert max(r.sequence_id for r in rows) + 1 <= -(-tokens // 2048) + 1


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = docs(spark, [(None, "a b"), (None, "a b"), (4, "a b"), (4, "c")])
    rows = pk.pack(df, PATH).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert pk.pack(df.limit(0), PATH).count() == 0
