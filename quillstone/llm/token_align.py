"""Cross-tokenizer alignment by byte-owner arrays.

Tokenizer A is a byte-level one that reads a space and the text; B is a piece tokenizer that puts the space before the
text itself.  Neither joins characters across a single space between other characters (A's pattern starts a new part
there, B has no piece with a space after another character), so a text is aligned word by word, and a word is
what stands between such spaces, with the space before it.

1. A task takes its texts in chunks of bounded size.  Each distinct word of a chunk is encoded once.  ``np.repeat`` of
   token indices over bytes gives the owner of every byte under A and under B; consecutive distinct pairs of owners are
   the links, and where both owners change the groups are cut.
2. A chunk is written as one row: its distinct id pairs with the number of its documents that hold each, and packed
   arrays of its documents' words.  So a pair that every document holds is one row a chunk, not one a document.
3. The chunks' pairs are summed over the corpus and compared with the highest count of their A id (a table no longer
   than A's vocabulary, which is broadcast).  The counts return to the chunks, which sum them by document.

Edge cases: texts that are null or empty, or whose tokens' bytes are not the space and the text, have zeros and a blank
digest.  Repeated rows are documents of their own, rows without doc_id too; an empty table gives no rows.  Other
columns are ignored.  A text longer than a chunk is a chunk alone.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

#: A single space between characters that are no white space parts words.
_PARTED = re.compile(r"(?<=\S) (?=\S)")
#: White space next to a space, or at an end: the text is parted by the pattern, else at every space.
_ODD = re.compile(r"\s | \s|^\s|\s\Z")
#: Latin letters, digits and marks, which all versions of Unicode class alike.
_LATIN = re.compile("[\\t\\n\\r\x20-\x7e\xa1-\xac\xae-\u024f]*\\Z")
#: The pattern by which byte-level tokenizers of this kind part a text; fixed by the vocabulary file's kind.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


@dataclass(frozen=True)
class AlignParams:
    """``a``: a tokenizers JSON file of a byte-level BPE; ``b``: a sentencepiece model."""

    a: str
    b: str
    chunk_chars: int = 12_000_000
    slice_chars: int = 400_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def _lengths(pieces: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in pieces], dtype=np.int64)


@dataclass
class Words:
    """Alignment of words: counts by word, ``pairs`` of A and B ids of all links in order, and each word's groups as text."""

    ok: np.ndarray
    counts: np.ndarray  # by COLUMNS and word
    pairs: np.ndarray
    groups: list[str]


class Aligner:
    """Both tokenizers, and what their ids stand for in bytes."""

    def __init__(self, p: AlignParams) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.p = p
        self.a = Tokenizer.from_file(p.a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=p.b)
        chars, known = _byte_of_char(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for x in [self.b.id_to_piece(i)]]
        self.a_len, self.b_len = _lengths(self.a_bytes), _lengths(self.b_bytes)
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], dtype=object)
        self.most = most
        self.quick = self._ranks()

    def _ranks(self):
        """A faster encoder of A's vocabulary, if its ids are in the order of its merges; None otherwise."""
        import json

        import tiktoken

        with open(self.p.a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(merges)):
            return None
        ranks = {self.a_bytes[i]: i for i in model["vocab"].values() if i < 256 + len(merges)}
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_a(self, words: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the number of each word's."""
        if not joined or self.quick is None:
            found = [e.ids for e in self.a.encode_batch([f" {w}" for w in words], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64)
        ids = np.array(self.quick.encode_ordinary(" " + " ".join(words)), dtype=np.int64)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        last = np.searchsorted(np.cumsum(self.a_len[ids]), ends)  # the token that ends with the word
        return ids, np.diff(np.r_[-1, last])

    def align(self, words: list[str], joined: bool) -> Words:
        """``joined``: the words may stand side by side in one text for A."""
        a, n_a = self._encode_a(words, joined)
        found = self.b.encode(words, num_threads=1)
        b, n_b = np.fromiter(chain.from_iterable(found), dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64)
        ok = np.ones(len(words), dtype=bool)
        want = "".join([f" {w}" for w in words]).encode()
        for ids, n, known in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            if b"".join([known[i] for i in ids.tolist()]) != want or (n == 0).any():
                at = np.r_[0, np.cumsum(n)]
                for i, w in enumerate(words):
                    ok[i] &= b"".join([known[x] for x in ids[at[i] : at[i + 1]].tolist()]) == f" {w}".encode()
        a, b, n_a, n_b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)], n_a * ok, n_b * ok
        return self._owners(a, b, n_a, n_b, ok)

    def _owners(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ok: np.ndarray) -> Words:
        n = len(ok)
        if not len(a):
            return Words(ok, np.zeros((4, n), dtype=np.int64), np.zeros(0, dtype=np.int64), [""] * n)
        own_a, own_b = np.repeat(np.arange(len(a)), self.a_len[a]), np.repeat(np.arange(len(b)), self.b_len[b])
        new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        link = np.r_[0, np.flatnonzero(new_a | new_b) + 1]
        cut = np.r_[0, np.flatnonzero(new_a & new_b) + 1]
        word_a, word_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        counts = np.array([n_a, n_b, np.bincount(word_a[own_a[cut]], minlength=n), np.bincount(word_a[own_a[link]], minlength=n)])
        # each group shows its A ids, then its B ids: tokens are placed by group and side
        first_a, first_b = np.r_[own_a[cut], len(a)], np.r_[own_b[cut], len(b)]
        size_a, size_b = np.diff(first_a), np.diff(first_b)
        place_a, place_b = np.arange(len(a)) + np.repeat(first_b[:-1], size_a), np.arange(len(b)) + np.repeat(first_a[1:], size_b)
        at = np.empty(len(a) + len(b), dtype=np.int64)
        at[place_a], at[place_b] = a, b
        at[place_a[first_a[1:] - 1]] += self.most  # the last A id of a group
        at[place_b[first_b[1:] - 1]] += 2 * self.most  # the last B id
        shown, ends = self.shown[at].tolist(), np.cumsum(n_a + n_b).tolist()
        groups = ["".join(shown[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return Words(ok, counts, a[own_a[link]] << 32 | b[own_b[link]], groups)

    def align_all(self, words: list[str]) -> tuple[Words, np.ndarray]:
        """The words' alignment, and the place of each word in it."""
        plain = [bool(w) and not (w[0].isspace() or w[-1].isspace()) and bool(_LATIN.match(w)) for w in words]
        order = np.argsort(~np.array(plain, dtype=bool), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        parts, n_plain = [], sum(plain)
        ordered = [words[i] for i in order.tolist()]
        for some, joined in ((ordered[:n_plain], True), (ordered[n_plain:], False)):
            at = 0
            while at < len(some):
                end, size = at, 0
                while end < len(some) and (end == at or size + len(some[end]) <= self.p.slice_chars):
                    size += len(some[end]) + 1
                    end += 1
                parts.append(self.align(some[at:end], joined))
                at = end
        if not parts:
            return Words(np.zeros(0, dtype=bool), np.zeros((4, 0), dtype=np.int64), np.zeros(0, dtype=np.int64), []), place
        joined_parts = Words(np.concatenate([x.ok for x in parts]), np.concatenate([x.counts for x in parts], axis=1), np.concatenate([x.pairs for x in parts]), [g for x in parts for g in x.groups])
        return joined_parts, place


_LOADED: dict[AlignParams, Aligner] = {}


def _aligner(p: AlignParams) -> Aligner:
    """One for each Python worker, which serves many tasks."""
    if p not in _LOADED:
        _LOADED[p] = Aligner(p)
    return _LOADED[p]


def _packed(x: np.ndarray) -> bytes:
    """A non-negative array in the least width, compressed."""
    x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    width, n = x[0], int.from_bytes(x[1:9], "little")
    return np.frombuffer(pa.decompress(x[9:], n * width, codec="zstd", asbytes=True), dtype=f"<u{width}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + sizes[i] - 1`` one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum())) if len(sizes) else np.zeros(0, dtype=np.int64)


_DOC = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COLUMNS], ("groups_sha256", pa.string()), ("n_words", pa.int64())])
_CHUNK = pa.schema([("chunk", pa.binary()), ("pairs", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int64())), ("docs", pa.list_(_DOC)), *[(c, pa.binary()) for c in ("words", "times", "sizes", "links")]])
_CHUNK_DDL = "chunk binary, pairs array<long>, dfs array<long>, docs array<struct<doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_words long>>, words binary, times binary, sizes binary, links binary"


def words_of(text: str) -> list[str]:
    return _PARTED.split(text) if _ODD.search(text) else text.split(" ")


def chunk_row(aligner: Aligner, doc_ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """One chunk's row, see the module's description."""
    index: dict[str, int] = {}
    put = index.setdefault
    codes = [np.array([put(w, len(index)) for w in words_of(t)], dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
    known, place = aligner.align_all(list(index))
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    flat = place[np.concatenate(codes)] if len(index) else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(codes)), sizes)
    good = np.bincount(doc, weights=~known.ok[flat], minlength=len(codes)) == 0
    sums = [np.bincount(doc, weights=c[flat], minlength=len(codes)).astype(np.int64) * good for c in known.counts]
    shas, ends = [], np.cumsum(sizes).tolist()
    shown = known.groups.__getitem__
    for start, end, fine in zip([0, *ends[:-1]], ends, good.tolist(), strict=True):
        shas.append(hashlib.sha256("".join(map(shown, flat[start:end].tolist()))[:-1].encode()).hexdigest() if fine and end > start else "")
    n_words = max(1, len(index))
    key, times = np.unique((doc * n_words + flat)[good[doc]], return_counts=True)
    doc, word = key // n_words, key % n_words
    pairs, links = np.unique(known.pairs, return_inverse=True)
    per = known.counts[3]
    starts = np.cumsum(per) - per
    n_pairs = max(1, len(pairs))
    held = np.unique(np.repeat(doc, per[word]) * n_pairs + links[_ranges(starts[word], per[word])])
    dfs = np.bincount(held % n_pairs, minlength=len(pairs))
    present = np.flatnonzero(dfs)  # a rejected document's pairs are no document's
    number = np.zeros(len(pairs), dtype=np.int64)
    number[present] = np.arange(len(present))
    own = np.bincount(doc, minlength=len(codes))
    # words that only rejected documents hold may name absent pairs, but no document that counts names such words
    docs = pa.StructArray.from_arrays([pa.array(doc_ids, pa.int64()), *[pa.array(s, pa.int64()) for s in sums], pa.array(shas, pa.string()), pa.array(own, pa.int64())], fields=list(_DOC))
    row = [pa.array([uuid.uuid4().bytes], pa.binary())]
    row += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(pairs[present], pa.int64()), pa.array(dfs[present], pa.int64()), docs)]
    row += [pa.array([_packed(x)], pa.binary()) for x in (word, times, per, number[links])]
    return pa.RecordBatch.from_arrays(row, schema=_CHUNK)


def align(docs: DataFrame, p: AlignParams) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs(doc_id, text)``."""

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(p)
        ids, texts, size = [], [], 0
        for b in batches:
            named, column = b.column("doc_id").to_pylist(), b.column("text")
            for i in range(b.num_rows):
                text = column[i].as_py()
                if ids and size + len(text or "") > p.chunk_chars:
                    yield chunk_row(aligner, ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(named[i])
                texts.append(text)
                size += len(text or "") + 64
        if ids:
            yield chunk_row(aligner, ids, texts)

    def summed(key: tuple, counts: pa.Table, chunks: pa.Table) -> pa.Table:
        rows = chunks.column("docs").combine_chunks().flatten()
        word, times, per, links = (_unpacked(chunks.column(c)[0].as_py()) for c in ("words", "times", "sizes", "links"))
        at = counts.column("pos").to_numpy()
        doc = np.repeat(np.arange(len(rows)), rows.field("n_words").to_numpy())
        ends = np.r_[0, np.cumsum(per)]
        out = []
        for c in ("best", "n"):
            value = np.zeros(max(1, len(at)), dtype=np.int64)
            value[at] = counts.column(c).to_numpy()
            total = np.r_[0, np.cumsum(value[links])]  # of links before each; links that no document counts point anywhere
            by_word = total[ends[1:]] - total[ends[:-1]]
            sums = np.r_[0, np.cumsum(by_word[word] * times)]
            last = np.cumsum(np.bincount(doc, minlength=len(rows)))
            out.append(sums[last] - sums[np.r_[0, last[:-1]]] if len(rows) else np.zeros(0, dtype=np.int64))
        return pa.table([rows.field("doc_id"), *[rows.field(c) for c in COLUMNS], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), rows.field("groups_sha256")], names=["doc_id", *COLUMNS, "n_best", "count_sum", "groups_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 500):  # whole texts
        chunks = materialize(rows.mapInArrow(chunks_of, _CHUNK_DDL), "align-chunks")
    each = chunks.select(F.explode(F.arrays_zip("pairs", "dfs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.dfs").alias("df"))
    counts = materialize(each.groupBy("pair").agg(F.sum("df").alias("n")), "align-counts").withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # no longer than A's vocabulary
    judged = counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    spread = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair")).join(judged, "pair").select("chunk", "pos", "n", "best")
    bodies = chunks.select(F.col("chunk").alias("of_chunk"), "docs", "words", "times", "sizes", "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return spread.groupBy("chunk").cogroup(bodies.groupBy("of_chunk")).applyInArrow(summed, schema)
