"""Sequence packing by minimum bin slack.

Every document's token ids (with an end id) are cut into full windows and one
remainder.  What is packed is the multiset of piece lengths, a table of at most
``window`` counts: for the largest remaining length, a bitset subset-sum dynamic
programme over the multiset finds the set that fills the window closest to
capacity, backtracking gives how often each length is taken, and the pattern is
used as often as the counts allow.  The pieces themselves never meet in one
task: the pieces that one task cut meet the task's first rank of each length (at
most ``window`` rows) and look up their places in the pattern table.

Defined cases: a null or empty text is one piece with the end id alone; a
document longer than the window is cut at multiples of it; repeated rows and
null ids are packed row by row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.session import arrow_batches, write_table

WINDOW = 2048
END_ID = 1
#: Bound of a worker's word cache (entries); a full cache is emptied.
CACHE_WORDS = 400_000
#: Texts, and bytes, that a worker is sent at once.
BATCH_TEXTS, BATCH_BYTES = 500, "4m"
#: Lead bytes from U+0300 on: combining marks and other scripts.
_BEYOND = bytes(range(0xCC, 0xF5))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCache(dict):
    """Token ids (little-endian uint32 bytes) of white-space words; a missing word is encoded."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, through a cache of words.

    The tokenizer never joins across white space, so the ids of a text are those
    of its words, which are looked up as they stand.  A new word is lower-cased
    (ASCII letters, as the tokenizer does) and cut where a run of letters meets an
    ASCII mark, since the tokenizer ends a run there; a word that may hold a
    special token, or a combining mark after a capital, stays whole.  Parts of
    Latin-1 letters go straight to the tokenizer's merge model, in its byte
    alphabet; all others through the whole tokenizer.
    """

    after_letter = re.compile(rb"([a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])(?=[!-/:-@\[-`{-~])")
    capital_mark = re.compile(rb"[A-Z][\xcc-\xf4]")

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize
        self.cache = WordCache(self.word_ids)  # of words and of the parts that they are cut into
        # the byte alphabet: printable Latin-1 stands for itself, the rest follows from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}

    def words(self, text: bytes) -> list[bytes]:
        """The text cut into words that can be looked up one by one; in lower case where that is safe for all of it."""
        if b"<|" in text or len(text.translate(None, _BEYOND)) < len(text):
            return text.split()
        return text.lower().split()

    def word_ids(self, word: bytes) -> bytes:
        low = word.lower()
        if low.isalpha():  # ASCII letters only
            return self.part_ids(low) if low == word else self.cache[low]
        if low[:-1].isalpha() and low[-1] < 0x80:  # letters and one mark
            return self.cache[low[:-1]] + self.cache[low[-1:]]
        if b"<|" in word or self.capital_mark.search(word):
            return self.part_ids(word)
        parts = self.after_letter.sub(rb"\1 ", low).split()
        return self.part_ids(low) if len(parts) == 1 else b"".join(map(self.cache.__getitem__, parts))

    def part_ids(self, part: bytes) -> bytes:
        if part.isalpha():
            return self.merged_ids(part.lower().decode())
        text = part.decode()
        if text.isalpha() and max(text) < "\u0100":
            return self.merged_ids(text.lower().encode().decode("latin-1").translate(self.alphabet))
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged_ids(self, text: str) -> bytes:
        return packed([t.id for t in self.merge(text)])

    def learn(self, words: set[bytes]) -> None:
        """Make sure that every word is in the cache; a full cache is emptied first."""
        self.trim()
        for w in words:
            self.cache[w]

    def trim(self) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()


def worker_encoder(key: str, tokenizer) -> WordEncoder:
    """The encoder of this worker process, kept from task to task with its cache."""
    held = sys.modules.setdefault("_held_word_encoder", ModuleType("_held_word_encoder"))
    if getattr(held, "key", None) != key:
        held.key, held.encoder = key, WordEncoder(tokenizer.value)
    return held.encoder


def _pieces(key: str, tokenizer, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, tokenizer)
        words, ids_of, task, seen = encoder.words, encoder.cache.__getitem__, TaskContext.get().partitionId(), Counter()
        for b in batches:
            docs, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 64):
                encoder.trim()
                rows = []
                for i, text in enumerate(texts.slice(at, 64).to_pylist()):
                    buffer = b"".join(map(ids_of, words(text or b""))) + end
                    total = len(buffer) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        rows.append((at + i, start, length, zlib.crc32(buffer[4 * start:4 * (start + length)]),
                                     total, task, seen[length]))
                        seen[length] += 1
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch(
                    [docs.take(pa.array(cols[0])), *[pa.array(x, pa.int64()) for x in cols[1:]]],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"],
                )

    return run


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``counts`` whose sum is the largest that is at most ``room``.

    Bit ``s`` of a bitset says that sum ``s`` can be made.  Lengths go in from
    large to small, each by binary parts of its count; backtracking over the
    bitsets before each part gives the counts taken.
    """
    goal, limit = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        part = 1
        while left > 0 and not reach & goal:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & limit
            left -= take
            part *= 2
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] += take
            total -= length * take
    return dict(out)


def plan_patterns(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their counts, times used) until the multiset is used up."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        pattern = Counter(best_fill({k: v for k, v in rest.items() if v}, window - largest))
        pattern[largest] += 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((dict(sorted(pattern.items(), reverse=True)), times))
    return out


def _lookup(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, taken a sequence, first sequence, offset), sorted."""
    used, sequence, rows = Counter(), 0, []
    for pattern, times in patterns:
        offset = 0
        for length, n in pattern.items():
            rows.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table: np.ndarray, window: int):
    keys = table[:, 0] << 47 | table[:, 1]

    def run(pieces: pa.Table, offsets: pa.Table) -> pa.Table:
        """Places of one task's pieces; ``offsets`` has the rank of its first piece of each length."""
        first = np.zeros(window + 1, np.int64)
        first[offsets["length"].to_numpy()] = offsets["first"].to_numpy()
        length = pieces["length"].to_numpy()
        rank = first[length] + pieces["rank"].to_numpy()
        row = table[np.searchsorted(keys, length << 47 | rank, side="right") - 1]
        nth = rank - row[:, 1]
        return pa.table(
            [*(pieces[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
             pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row a piece."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    key, tokenizer = sha256(text.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(text)
    names = "start long, length long, ids_crc32 long, doc_tokens long"
    with arrow_batches(docs.sparkSession, BATCH_TEXTS, BATCH_BYTES):
        pieces = write_table(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(_pieces(key, tokenizer, window, end_id), f"doc_id long, {names}, task long, rank long")
        )
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = write_table(per_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _lookup(plan_patterns(counts, window))
    return pieces.groupBy("task").cogroup(offsets.select("task", "length", "first").groupBy("task")).applyInArrow(
        _place(table, window), f"doc_id long, {names}, sequence_id long, offset long")
