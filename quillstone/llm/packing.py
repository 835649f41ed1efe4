"""Best-fit packing by fitted patterns.

1. Every document is tokenized (its ids, then the end id); only documents longer than a sequence
   are cut, into full pieces and a rest.  Only lengths and checksums leave this step.
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) comes to the
   driver.  Patterns of few documents that fill a sequence exactly, or nearly, are enumerated, and
   their repeat counts are fitted to the histogram by non-negative least squares.  The counts are
   rounded so that no length is used more often than it occurs.
3. What the rounded patterns leave over is packed on the histogram by best fit, longest first;
   runs of equal bins are handled together, so this too depends on the number of lengths only.
4. The patterns and the best-fit bins are one table of slots (also bounded by the histogram).
   Each piece's rank among the pieces of its length names its slot; ranks come from per-salt
   counts, so a length that a third of all pieces share is dealt over many tasks.

Edge cases: a null text is the empty text and packs its end id alone; repeated rows are packed as
often as they occur; rows without doc_id are packed too; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, filterfalse
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, kept, let_go, materialize, partitions
from .token_align import _byte_of_char

Pattern = tuple[tuple[int, int], ...]  # (length, times) in descending length

#: Texts with any of these go to the tokenizer whole: white space that Python and the tokenizer may see
#: differently, combining marks and letters whose lower case depends on more than themselves.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u0130\u0300-\u036f\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]|<\\|")
#: Those of them that ASCII texts may have.
_ODD_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_LATIN = "a-zªµºß-öø-ɏ"
#: Words for the faster encoder; it is slow for very long ones.
_LETTERS = re.compile(f"[{_LATIN}]{{1,64}}")
#: ASCII marks that end a word after a Latin letter; a word and its end marks are tokenized apart, as the tokenizer does.
#: A mark stands before the look at the letter, so the search goes from mark to mark.
_MARKS = re.compile(rf"[!-/:-@\[-`{{-~](?<=[{_LATIN}].)[!-/:-@\[-`{{-~]*(?=\s|$)")
#: Stands between words that are tokenized together; it never occurs in them.
_BETWEEN = "\x01"
#: Ends each word for the faster encoder; words have small letters only.
_END = "E"


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    capacity: int = 4096
    end_id: int = 1
    cached_bytes: int = 96 << 20
    patterns_a_length: int = 8
    rank_rows: int = 100_000
    batch_rows: int = 1_000


def _odd(text: str) -> bool:
    """Has the text any of ``_ODD``?"""
    if text.isascii():
        return any(x in text for x in _ODD_ASCII)
    return _ODD.search(text) is not None


def _ranks(path: str) -> tuple[tiktoken.Encoding | None, np.ndarray]:
    """A faster encoder of words of small Latin letters, each with ``_END`` behind it, and by id: does the token end a word?

    None, if the vocabulary's ids aren't in the order of its merges (single bytes, then bytes that end a word, then merges).
    A word's last byte and ``_END`` are then merged before all others.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model.get("end_of_word_suffix")
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    chars = _byte_of_char()
    if not end or any(vocab.get(c, 512) >= 256 or not 256 <= vocab.get(c + end, 512) < 512 for c in chars) or any(vocab.get("".join(m)) != 512 + i for i, m in enumerate(merges)):
        return None, np.empty(0, dtype=bool)
    ranks, last = {_END.encode(): len(vocab)}, np.zeros(len(vocab) + 1, dtype=bool)
    for token, i in vocab.items():
        last[i] = token.endswith(end)
        own = [chars[c] for c in token.removesuffix(end)]
        if all(97 <= x <= 122 or x >= 128 for x in own):
            ranks[bytes(own) + _END.encode() * bool(last[i])] = i
    return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}), last


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases and never joins characters across white space.

    Texts are cut at white space and before end marks, and each distinct lower-case word is tokenized
    once; new words go to the tokenizer together, with a mark between them.  The cache has a young
    and an old half: when the young one is full it becomes the old one, whose words come back as
    they are met, so frequent words stay and at most ``cached_bytes`` and one call's words are held.
    New words of Latin letters go to a faster encoder of the same vocabulary (:func:`_ranks`).
    """

    #: What an entry takes besides the word's characters and the ids' bytes: two objects' heads and its place in the table.
    _ENTRY = 190

    def __init__(self, path: str, cached_bytes: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.most = cached_bytes
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the young half
        self.between = self._whole(_BETWEEN)
        self.quick, self.last = _ranks(path)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: set[str]) -> None:
        cache = self.cache
        quick = [w for w in words if _LETTERS.fullmatch(w)] if self.quick else []
        for at in range(0, len(quick), 5_000):
            own = quick[at : at + 5_000]
            ids = np.array(self.quick.encode_ordinary(_END.join(own) + _END), dtype="<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            raw = ids.tobytes()
            for w, start, end in zip(own, [0, *ends[:-1]], ends, strict=True):
                cache[w] = raw[start:end]
        words = words.difference(quick)
        plain = [w for w in words if _BETWEEN not in w]
        for at in range(0, len(plain), 5_000):
            own = plain[at : at + 5_000]
            ids = self._whole(f" {_BETWEEN} ".join(own))
            ends = [*np.flatnonzero(ids == self.between[0]).tolist(), len(ids)]
            start = 0
            for w, end in zip(own, ends, strict=True):
                cache[w] = ids[start:end].tobytes()
                start = end + 1
        for w in words.difference(plain):
            cache[w] = self._whole(w).tobytes()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        words = [None if _odd(t) else _MARKS.sub(r" \g<0>", t.lower()).split() for t in texts]
        new = set(filterfalse(self.cache.__contains__, chain.from_iterable(filter(None, words))))
        if new and self.held > self.most // 2:
            self.old, self.cache, self.held = self.cache, {}, 0
            new = set().union(*[w for w in words if w])
        if known := new & self.old.keys():
            self.cache.update((w, self.old[w]) for w in known)
        if unknown := new - known:
            self._learn(unknown)
        self.held += sum(self._ENTRY + len(w) + len(self.cache[w]) for w in new)
        get = self.cache.__getitem__
        return [self._whole(t) if w is None else np.frombuffer(b"".join(map(get, w)), dtype="<u4") for t, w in zip(texts, words, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def _tokenizer(path: str, cached_bytes: int) -> WordTokenizer:
    """One tokenizer and cache for a Python worker, which serves many tasks; the cache is bounded in bytes."""
    return kept(("word tokenizer", path, cached_bytes), lambda: WordTokenizer(path, cached_bytes))


def _slices(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes of text (one row at least)."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(at, end - at)
            at = end


def cut(docs: DataFrame, p: PackParams, with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` (and ``ids``, on request) of ``docs(doc_id, text)``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(p.tokenizer, p.cached_bytes)
        end = np.array([p.end_id], dtype="<u4")
        for part in _slices(batches, 500, 4 << 20):  # few texts at a time are Python strings
            out = []
            for doc_id, own_ids in zip(part.column("doc_id").to_pylist(), t.encode_many(part.column("text").to_pylist()), strict=True):
                ids = np.concatenate([own_ids, end])
                for piece, start in enumerate(range(0, len(ids), p.capacity)):
                    own = ids[start : start + p.capacity]
                    row = (doc_id, piece, start, len(own), crc32(own.tobytes()))
                    out.append(row + (own.astype(np.int32),) if with_ids else row)
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(run, schema)


def enumerate_patterns(h: np.ndarray, capacity: int, most: int) -> list[Pattern]:
    """Patterns of one to four documents that fill a sequence exactly, or as nearly as the lengths allow.

    Every length is the longest of some patterns: up to ``most`` of them with the commonest other
    lengths, besides those of equal parts, so the whole histogram is covered at any size.
    """
    lengths = np.nonzero(h)[0]
    lengths = lengths[lengths > 0]
    found: set[Pattern] = set()

    there = h.tolist()

    def add(parts: list[int]) -> None:
        pattern = tuple(sorted(Counter(parts).items(), reverse=True))
        if all(n <= there[length] for length, n in pattern):
            found.add(pattern)

    below = np.zeros(capacity + 1, dtype=np.int64)
    below[lengths[lengths <= capacity]] = lengths[lengths <= capacity]
    below = np.maximum.accumulate(below).tolist()

    def nearest(space: int) -> int:
        """The greatest occurring length that fits, or 0."""
        return below[space] if space > 0 else 0

    common = lengths[np.argsort(-h[lengths], kind="stable")][:64]
    for a in lengths[::-1].tolist():
        if b := nearest(capacity - a):
            add([a, b])
            if c := nearest(capacity - a - b):
                add([a, b, c])
        else:
            add([a])
        tried = 0
        for b in common.tolist():
            space = capacity - a - b
            if space < 0:
                continue
            if tried == most:
                break
            tried += 1
            c = nearest(space)
            add([a, b, c] if c else [a, b])
            if c and (d := nearest(space - c)):
                add([a, b, c, d])
        for parts in (3, 4):
            if (capacity - a) // parts > 0 and (b := nearest((capacity - a) // (parts - 1))):
                rest = capacity - a - (parts - 2) * b
                if c := nearest(rest):
                    add([a, *[b] * (parts - 2), c])
    return sorted(found, reverse=True)


def fit_counts(patterns: list[Pattern], h: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|^2, A the patterns' lengths, by accelerated projected gradients."""
    width = max(len(p) for p in patterns)
    at, times = np.zeros((len(patterns), width), dtype=np.int64), np.zeros((len(patterns), width))
    for i, p in enumerate(patterns):
        at[i, : len(p)], times[i, : len(p)] = [a for a, _ in p], [n for _, n in p]

    def of(x: np.ndarray) -> np.ndarray:
        return np.bincount(at.ravel(), weights=(times * x[:, None]).ravel(), minlength=len(h))

    def back(r: np.ndarray) -> np.ndarray:
        return (times * r[at]).sum(1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(of(v))
        largest = float(np.linalg.norm(v))
        v /= largest
    step = 1 / (1.05 * largest)
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        grad = back(of(y) - h)
        new = np.maximum(0.0, y - step * grad)
        if float(grad @ (new - x)) > 0:
            momentum = 1.0  # start the acceleration anew when it leads uphill
        later = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y = new + (momentum - 1) / later * (new - x)
        moved, x, momentum = float(np.abs(new - x).sum()), new, later
        if moved < 1e-7 * max(1.0, float(h.sum())):
            break
    return x


def round_counts(patterns: list[Pattern], x: np.ndarray, h: np.ndarray) -> list[tuple[Pattern, int]]:
    """Whole repeat counts, the largest fitted ones first, so that no length is used more than it occurs."""
    left = h.copy()
    out = []
    for i in np.argsort(-x, kind="stable").tolist():
        n = min([int(round(x[i])), *(int(left[length]) // times for length, times in patterns[i])])
        if n > 0:
            for length, times in patterns[i]:
                left[length] -= n * times
            out.append((patterns[i], n))
    return out


def best_fit(h: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram; equal bins are kept as one run with a count."""
    runs: dict[int, list[tuple[dict[int, int], int]]] = {}  # by free space
    free = np.zeros(capacity + 1, dtype=bool)
    for length in np.nonzero(h)[0][::-1].tolist():
        n = int(h[length])
        while n and length:
            spaces = np.nonzero(free[length:])[0]
            if len(spaces):
                space = length + int(spaces[0])
                parts, bins = runs[space].pop()
                if bins > n:
                    runs[space].append((parts, bins - n))
                free[space] = bool(runs[space])
                used = min(bins, n)
                grown, rest = parts | {length: parts.get(length, 0) + 1}, space - length
            else:
                each = min(n, capacity // length)
                used, grown, rest = n // each, {length: each}, capacity - each * length
                n -= used * (each - 1)
            runs.setdefault(rest, []).append((grown, used))
            free[rest] = True
            n -= used
    return [(tuple(sorted(parts.items(), reverse=True)), bins) for same in runs.values() for parts, bins in same]


def plan(h: np.ndarray, capacity: int, most: int) -> list[tuple[Pattern, int]]:
    """Patterns and their repeat counts that together hold exactly the histogram ``h`` (by length)."""
    done: list[tuple[Pattern, int]] = []
    left = h.astype(np.int64).copy()
    alone = left[capacity]
    if alone:
        done.append((((capacity, 1),), int(alone)))
        left[capacity] = 0
    for _ in range(3):  # what one fit leaves over is fitted again
        patterns = [p for p in enumerate_patterns(left, capacity, most) if sum(a * n for a, n in p) >= 0.995 * capacity]
        if not patterns:
            break
        chosen = round_counts(patterns, fit_counts(patterns, left), left)
        for pattern, n in chosen:
            for length, times in pattern:
                left[length] -= n * times
        done += chosen
        if not chosen:
            break
    return done + best_fit(left, capacity)


def slots(planned: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, times a sequence, offset) in the order of ranks."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in planned:
        offset = 0
        for length, times in pattern:
            out.setdefault(length, []).append((used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, p: PackParams) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    spark = docs.sparkSession
    with arrow_rows(spark, p.batch_rows):  # a batch of texts is held by Spark and by Python
        pieces = materialize(cut(docs, p), "pack-pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one row for each length up to capacity
    h = np.zeros(p.capacity + 1, dtype=np.int64)
    for r in counts:
        h[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(slots(plan(h, p.capacity, p.patterns_a_length)))
    salts = int(max(1, -(-int(h.max()) // p.rank_rows)))
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(salts, min(64, int(h.max()) // 1_000 + 1)))).cast("int"))
    cells = keyed.groupBy("length", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("r", within).join(cells, ["length", "salt"]).withColumn("rank", F.col("skip") + F.col("r") - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()  # the tokenizer: all pieces are written
        for b in batches:
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            lengths, ranks = b["length"].to_numpy(), b["rank"].to_numpy()
            for length in np.unique(lengths):
                at = np.nonzero(lengths == length)[0]
                rows = table.value[int(length)]
                slot = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
                nth = ranks[at] - slot[:, 0]
                sequence[at] = slot[:, 1] + nth // slot[:, 2]
                offset[at] = slot[:, 3] + nth % slot[:, 2] * length
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, out)


def sequences(docs: DataFrame, p: PackParams) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (at most ``capacity`` ids each)."""
    placed = pack(docs, p)
    found = cut(docs, p, with_ids=True).dropDuplicates(["doc_id", "piece", "length", "ids_crc32"])
    joined = placed.join(found.select("doc_id", "piece", "length", "ids_crc32", "ids"), ["doc_id", "piece", "length", "ids_crc32"]).repartition(partitions(docs.sparkSession), "sequence_id")
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
