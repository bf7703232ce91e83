"""Packing token sequences by cutting stock with column generation.

Every text is tokenised and closed with the id 1; ids are cut into pieces of ``LENGTH`` and a rest.
Full pieces are sequences of their own. The rests are counted by length class (``GRAIN`` tokens
wide), and the histogram, which is bounded by the number of classes, is solved as a cutting-stock
problem on the driver: a linear program over patterns (how many rests of each class share a
sequence), whose new columns an unbounded-knapsack dynamic program prices, until no pattern is
worth ``1 + GAP`` sequences at the current prices. Patterns are rounded down; what is left over is
packed largest first. Rests are ranked in their class by prefix sums over hashed buckets, and a
broadcast table of rank ranges (bounded by patterns times classes) assigns them to sequences.

Word by word, the ids come from the vocabulary's own merges run by a byte-pair encoder, with a
cache; words with characters outside ASCII and Latin-1 letters go through the tokenizer itself.

Defined cases: a null or blank text is the single id 1; rows repeated whole are packed each; a
document that fills several pieces, however long, has rows at ascending starts; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, released, small_batches, words_of, written

VOCABULARY, CLOSE = "word_bpe_49k.json", 1
LENGTH, GRAIN, GAP = 2048, 16, 1e-4
CAPACITY = LENGTH // GRAIN
#: Rests that one bucket of a class may hold when ranks are counted, about.
BUCKET_ROWS = 20_000
#: Words that a task remembers before it starts afresh (about 30 MB).
CACHE = 150_000
_MARKS = ".,;:!?|"
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words whose normal form is their lower case: printable ASCII and Latin-1 letters.
_PLAIN = re.compile(f"[!-~{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0xFF)}]+")


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class WordEncoder:
    """Ids of texts; ids of single words are remembered."""

    END = b"\xff"  # no UTF-8 text holds this byte; it closes a word

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte_of, ranks = _byte_of(), {}
        for token, rank in vocabulary.items():
            word = token.removesuffix("</w>")
            if all(c in byte_of for c in word):
                raw = bytes(byte_of[c] for c in word)
                if self.END not in raw:
                    ranks[raw + self.END * (word != token)] = rank
        ranks[self.END] = max(vocabulary.values()) + 1
        self.pairs = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.pair = self.pairs._core_bpe.encode_single_piece
        self.marks = {m: self.pair(m.encode() + self.END) for m in _MARKS}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def word(self, word: str) -> list[int]:
        if word.isalpha() and _PLAIN.fullmatch(word):
            return self.pair(word.lower().encode() + self.END)
        stem = word[:-1]
        if stem.isalpha() and word[-1] in _MARKS and _PLAIN.fullmatch(stem):
            return self.pair(stem.lower().encode() + self.END) + self.marks[word[-1]]
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.whole.encode(word, add_special_tokens=False).ids
        return [i for piece in _PIECE.findall(word.lower()) for i in self.pair(piece.encode() + self.END)]

    def _learn(self, words: list[str]) -> None:
        ids = list(map(self.word, words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.known), int(sizes.sum())
        while first + len(words) > len(self.sizes):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.sizes, self.sizes * 0])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids * 0])
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text, closed with CLOSE."""
        if len(self.known) > CACHE:
            self.forget()
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if new:
            self._learn(new)
        get, out = self.known.__getitem__, []
        for words in split:
            at = np.fromiter(map(get, words), np.int64, len(words))
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(at) else 0
            ids = np.empty(total + 1, "<u4")
            ids[:total] = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)]
            ids[total] = CLOSE
            out.append(ids)
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each process; what a task learns on top of the vocabulary is forgotten at its end."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        released()
        encoder = encoder_of(public_tokenizers.path(vocabulary))
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, j in chunks(texts, [len(t or "") for t in texts], 400_000):
                    rows = [(d, s, min(LENGTH, len(x) - s), zlib.crc32(x[s : s + LENGTH].tobytes()), len(x)) for d, x in zip(ids[i:j], encoder.encode(texts[i:j]), strict=True) for s in range(0, len(x), LENGTH)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            # Workers live on and serve other stages.
            encoder.forget()
            released()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[float, np.ndarray]:
    """The pattern of the highest total price that fits: unbounded knapsack by dynamic programming."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sorted_sizes, sorted_prices = sizes[order], prices[order]
    counts = np.searchsorted(sorted_sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        value[w], n = value[w - 1], counts[w]
        if n:
            gain = value[w - sorted_sizes[:n]] + sorted_prices[:n]
            k = gain.argmax()
            if gain[k] > value[w] + 1e-12:
                value[w], choice[w] = gain[k], order[k]
    pattern, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(value[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = 6000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, from the linear program's last basis (revised simplex)."""
    m = len(sizes)
    patterns = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(patterns)])
    use = inverse @ demand
    for _ in range(rounds):
        prices = np.maximum(inverse.sum(0), 0)
        value, column = best_pattern(prices, sizes, capacity)
        if value <= 1 + GAP:
            break
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, use / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        use = use - step * direction
        use[out] = step
        inverse[out] /= direction[out]
        others = np.arange(m) != out
        inverse[others] -= direction[others, None] * inverse[out]
        patterns[out] = column
    return list(zip(patterns, np.maximum(use, 0), strict=True))


def plan(histogram: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """(rests of each class in a sequence, sequences) that hold all of the histogram."""
    classes = np.array(sorted(histogram), np.int64)
    if not len(classes):
        return []
    left = np.array([histogram[c] for c in classes.tolist()], np.int64)
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        out.append(({int(classes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, times))
        np.subtract(left, pattern * times, out=left)

    for pattern, times in column_generation(classes, left.astype(float)):
        held = pattern > 0
        times = min(int(np.floor(times + 1e-9)), int((left[held] // pattern[held]).min()) if held.any() else 0)
        if times > 0:
            use(pattern, times)
    while left.any():
        pattern, room = np.zeros(len(classes), np.int64), CAPACITY
        for i in range(len(classes) - 1, -1, -1):
            pattern[i] = min(left[i], room // classes[i])
            room -= pattern[i] * classes[i]
        held = pattern > 0
        use(pattern, int((left[held] // pattern[held]).min()))
    return out


def packed(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = documents.sparkSession
    cut = pieces(documents, vocabulary).withColumn("class", F.when(F.col("length") == LENGTH, 0).otherwise(F.ceil(F.col("length") / GRAIN)).cast("int"))
    cut = written(cut, "pieces")
    counts = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}
    full = counts.pop(0, 0)
    rows, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan(counts):
        for c, each in pattern.items():
            rows.append((c, taken[c], taken[c] + each * times, sequence, each))
            taken[c] += each * times
        sequence += times
    rows.append((0, 0, full, sequence, 1))
    table = spark.createDataFrame(rows, "c int, low long, high long, sequence long, each long")

    buckets = max(1, (sum(counts.values()) + full) // BUCKET_ROWS)
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = bucketed.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("class").alias("k"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    inside = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = bucketed.withColumn("within", F.row_number().over(inside) - 1)
    ranked = numbered.join(sizes, (F.col("class") == F.col("k")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("above") + F.col("within"))
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    slots = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(slots), F.lit(0))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.cast("long").alias("offset"))
