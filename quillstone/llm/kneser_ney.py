"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

Tokens are words and single punctuation marks, case kept.  A token is its own symbol if trusted
text of its language has it at least ``least_count`` times; every other token is the class of its
shape (lower case, capitalised, upper case, digits, mark, other) in its language.  All trusted
documents are counted, in full.  Vocabulary and counts grow with the input, so neither is ever
gathered: they are tables, joined by symbol or counted in shards of symbol pairs.

1. One pass cuts the corpus into chunks of about ``chunk_tokens``.  A chunk has its documents with
   their tokens as numbers of its distinct words, and apart from them the sorted words with their
   counts in trusted documents.  Chunks are written bucketed, so that later joins leave them in place.
2. A chunk's words go to shards, each a range of word hashes.  A shard sums the counts over all
   chunks, numbers its symbols by frequency and answers every chunk with the numbers of the words it
   sent, in their order; the words are deleted then.  Languages, for the classes, are numbered apart.
3. Each chunk sends its distinct pairs of symbols, with their counts in its trusted documents, to
   shards by the hash of the pair; a frequent word's pairs are thus dealt over all shards.
4. A shard sums the counts of its pairs over all chunks and answers every chunk with the counts of
   the pairs it asked for; what contexts and continuations need goes to the symbol's own shard.
   Steps 3 and 4 are done ``pair_passes`` times, each for a part of the shards.
5. Each chunk gets these answers and its symbols' values and sums its documents' log
   probabilities.  All discounts, of pairs and of continuations, are estimated.
6. A document is kept if its judged perplexity is at most ``slack`` times its language's
   ``quantile`` over trusted documents and its fitted one at least the ``low_quantile`` over
   ``slack``: text that is far more predictable than any trusted text repeats itself.

What is sent is sorted and packed, answers come in the order of what was asked, and neither files of
shuffles nor tables stay longer than they are read: disk is what bounds this method.

A trusted document is judged as if it were new: its own pairs are taken off the counts of pairs,
contexts and continuations (back-off weights stay), else the model would know it by heart and every
new document would exceed the trusted ones.  ``fitted`` is what the model says with those counts,
which is also what it says of an untrusted copy.  Both are shrunk, for a text of n tokens, towards
the language's mean with the weight of ``prior_tokens`` tokens: a few tokens alone say little.  The
raw fitted perplexity is returned as well.

Edge cases: null or blank texts have no tokens, perplexity null, and are not kept; a null language
is a language of its own; a language without its own threshold (fewer than ``least_trusted``
trusted documents) uses the one of all languages; without any trusted document nothing is judged
and every document with a token is kept.  Rows are judged one by one, repeated rows alike;
documents without doc_id are judged too (never trusted).  Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bucketed, current_owner, last_written, let_go, materialize, owned, partitions, remove, temporary, without_shuffle_files

_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens of one character; setting them apart and splitting at white space gives the same tokens as ``_TOKEN``, faster.
_MARK = re.compile(r"[^\w\s]")
_SHAPES = 6


@dataclass(frozen=True)
class QualityParams:
    least_count: int = 2
    chunk_tokens: int = 1_000_000
    shard_pairs: int = 1_500_000
    pair_passes: int = 2
    batch_rows: int = 1_000
    block_tokens: int = 100_000
    quantile: float = 0.99
    low_quantile: float = 0.005
    slack: float = 1.1
    prior_tokens: int = 40
    least_trusted: int = 20
    broadcast_rows: int = 2_000_000


def shape(word: str) -> int:
    if not word[0].isalnum() and word[0] != "_":
        return 4
    if word.islower():
        return 0
    if word.isupper() and len(word) > 1:
        return 2
    if word[0].isupper() and (len(word) == 1 or word[1:].islower()):
        return 1
    return 3 if word.isdigit() else 5


def _tokens(text: str) -> list[str]:
    return _MARK.sub(r" \g<0> ", text).split()


def _symbol(lang: str, kind: str, name: str) -> int:
    h = xxhash.xxh3_64_intdigest(f"{lang}\x1f{kind}\x1f{name}".encode("utf-8", "surrogatepass"))
    return h - (h >> 63 << 64)


def _word(lang: str, word: str) -> int:
    return _symbol(lang, "w", word)


def _class(lang: str, shape: int) -> int:
    """The symbol of a shape; shape -1 is the start mark."""
    return _symbol(lang, "c", str(shape))


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8).T
    used = max((i + 1 for i in range(8) if planes[i].any()), default=1)
    raw = planes[:used].tobytes()
    return len(x).to_bytes(8, "little") + bytes([used]) + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n, used = int.from_bytes(blob[:8], "little"), blob[8]
    raw = pa.Codec("zstd").decompress(blob[9:], decompressed_size=n * used, asbytes=True) if n else b""
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[:used] = np.frombuffer(raw, dtype=np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(n)


def _shards(b: np.ndarray, c: np.ndarray, shards: int) -> np.ndarray:
    """Each pair's shard, by its hash."""
    x = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ c.astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) % np.uint64(shards)).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once (``np.unique`` hashes, which is slow for so many)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _places(x: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """``x``, whole numbers from 0 and ``below`` a bound, sorted and each once; and the place of each number there.

    Numbers are sorted with their positions in their lowest bits, where both fit: much faster than to search for each.
    """
    bits = len(x).bit_length()
    if below.bit_length() + bits > 63:
        once = _distinct(x)
        return once, np.searchsorted(once, x).astype(np.int32)
    both = np.sort(x.astype(np.int64) << bits | np.arange(len(x)))
    x, at = both >> bits, np.empty(len(x), dtype=np.int32)
    first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, dtype=bool)
    at[both & (1 << bits) - 1] = np.cumsum(first, dtype=np.int32) - 1
    return x[first], at


@dataclass
class _Pairs:
    """A chunk's token pairs: ``at[i]`` is the place of pair i in the distinct ones, ``b`` and ``c``, which are sorted."""

    b: np.ndarray
    c: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> _Pairs:
        """``ids``: symbol number by word number; ``starts``: the start mark's word number of each document."""
        before = _before(tokens, starts, sizes)
        kinds, rank = np.unique(ids, return_inverse=True)
        keys = rank[before] * len(kinds)
        keys += rank[tokens]
        once, at = _places(keys, len(kinds) ** 2)
        return cls(kinds[once // max(len(kinds), 1)], kinds[once % max(len(kinds), 1)], at)


_ENC = "chunk long, own_names array<string>, n_words long, doc_ids array<long>, hashes array<long>, langs array<string>, trusted array<boolean>, sizes array<long>, starts array<long>, tokens binary, freqs binary, codes binary, words binary, counts binary, owns binary, kind string"
_WORDS = "shard int, chunk long, own_names array<string>, words binary, counts binary, owns binary"
_KNOWN = "shard int, chunk long, ids binary, own_names array<string>, owns binary, kinds array<long>"
_GRAMS = "shard int, chunk long, b binary, c binary, n binary"
_COUNTED = "shard int, chunk long, n binary, part int, b binary, s binary, n1 binary, n2 binary, n3 binary, c binary, cc binary, cofc array<long>"
_VALUES = "shard int, cc binary, s binary, n1 binary, n2 binary, n3 binary, own string, sums array<long>, class long, of_class array<long>"
_GIVEN = "part long, what string, shard int, a binary, cc binary, s binary, n1 binary, n2 binary, n3 binary, own string, number long, m double, floor double, classes array<array<long>>"
_SCORED = "doc_id long, h long, lang string, trusted boolean, n_tokens long, nats double, new_nats double"


class _Chunk:
    """Documents as they are read, until they make a row."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.docs: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.words: list[int] = []
        self.shapes: list[int] = []
        self.owns: list[int] = []
        self.numbers: dict[str, dict[str, int]] = {}

    def add(self, doc_id: int | None, h: int, lang: str, good: bool, text: str) -> None:
        found = _tokens(text)
        if lang not in self.numbers:
            self.numbers[lang] = {"": len(self.words)}  # the start mark
            self.words.append(_class(lang, -1))
            self.shapes.append(-1)
            self.owns.append(len(self.numbers) - 1)
        number = self.numbers[lang]
        own = self.owns[number[""]]
        for w in dict.fromkeys(found):
            if w not in number:
                number[w] = len(self.words)
                self.words.append(_word(lang, w))
                self.shapes.append(shape(w))
                self.owns.append(own)
        self.tokens.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
        self.docs.append((doc_id, h, lang, bool(good), len(found), number[""]))
        self.size += len(found) + 8

    def rows(self) -> pd.DataFrame:
        """The chunk's documents, and its words, sorted; tokens number them by frequency, which packs best (:func:`_by_frequency`)."""
        numbers = np.concatenate(self.tokens)
        words = np.array(self.words, dtype=np.int64)
        own, code = np.array(self.owns), np.array(self.owns) * 8 + np.array(self.shapes) + 1
        order = np.argsort(words)
        freqs = np.bincount(numbers, minlength=len(words))[order]
        rank = np.empty_like(order)
        rank[order[_by_frequency(freqs)]] = np.arange(len(order))
        doc_ids, hashes, langs, good, sizes, starts = zip(*self.docs, strict=True)
        counts = np.bincount(numbers[np.repeat(good, sizes)], minlength=len(words))[order]
        names, none = list(self.numbers), [None] * 9
        docs = (list(doc_ids), list(hashes), list(langs), list(good), list(sizes), rank[list(starts)].tolist(), _pack(rank[numbers]), _pack(freqs), _pack(code[order]))
        packed = (_pack(np.diff(words[order], prepend=0)), _pack(counts), _pack(own[order]))
        return pd.DataFrame([(self.number, names, len(words), *docs, *none[:3], "docs"), (self.number, names, len(words), *none, *packed, "words")], columns=_names(_ENC))


def _by_frequency(freqs: np.ndarray) -> np.ndarray:
    """The places of sorted words in the order in which tokens number them."""
    return np.argsort(-freqs, kind="stable")


def judge(docs: DataFrame, trusted: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Perplexity and decision for every row of ``docs(doc_id, text, lang)``.

    ``trusted(doc_id)``: the documents whose text is trusted.  Returns doc_id, text_hash
    (``xxhash64(text)``, which with doc_id finds the row again), lang, n_tokens, perplexity, fitted and
    judged (shrunk perplexities), threshold, low_threshold, keep.
    """
    spark = docs.sparkSession
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    if trusted.count() <= p.broadcast_rows:  # checked: at most two million ids
        trusted = F.broadcast(trusted)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("\x00")).alias("lang"))
    base = base.join(trusted, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        let_go()
        chunk = _Chunk(TaskContext.get().partitionId() << 32)
        for b in batches:
            for doc_id, h, lang, good, text in zip(b["doc_id"], b["h"], b["lang"], b["trusted"], b["text"], strict=True):
                chunk.add(None if pd.isna(doc_id) else int(doc_id), h, lang, good, text)
                if chunk.size >= p.chunk_tokens:
                    yield chunk.rows()
                    chunk = _Chunk(chunk.number + 1)
        if chunk.docs:
            yield chunk.rows()

    owner = current_owner()
    with temporary(spark), without_shuffle_files(spark):
        with arrow_rows(spark, p.batch_rows):  # a batch of texts is held as Python strings
            enc = bucketed(base.mapInPandas(encode, _ENC), "chunk", "kn-chunks", "kind")
        scored = _scored(enc, last_written(), p)
        with owned(owner):
            scored = materialize(scored, "kn-scored")

    good = scored.where("trusted and n_tokens > 0")
    mean_all = good.agg((F.sum("new_nats") / F.sum("n_tokens")).alias("m")).first()["m"]
    means = good.groupBy("lang").agg((F.sum("new_nats") / F.sum("n_tokens")).alias("mean"))
    scored = scored.join(F.broadcast(means) if _few(means, p) else means, "lang", "left")
    any_good = F.lit(mean_all is not None) & (F.col("n_tokens") > 0)  # without trusted text there is no model
    prior = p.prior_tokens * F.coalesce("mean", F.lit(mean_all or 0.0))

    def shrunk(nats: str) -> Column:
        return F.when(any_good, F.exp((F.col(nats) + prior) / (F.col("n_tokens") + p.prior_tokens)))

    scored = scored.withColumns({"perplexity": F.when(any_good, F.exp(F.col("nats") / F.col("n_tokens"))), "fitted": shrunk("nats"), "judged": shrunk("new_nats")})
    good = scored.where("trusted and n_tokens > 0")
    quantile = F.percentile_approx("judged", p.quantile, 10_000)
    low = F.percentile_approx("fitted", p.low_quantile, 10_000)
    every = good.agg(quantile.alias("t"), low.alias("l")).first()
    own_t = good.groupBy("lang").agg(quantile.alias("t"), low.alias("l"), F.count("*").alias("c")).where(F.col("c") >= p.least_trusted).select("lang", "t", "l")
    out = scored.join(F.broadcast(own_t) if _few(own_t, p) else own_t, "lang", "left")
    out = out.withColumn("threshold", p.slack * F.coalesce("t", F.lit(every["t"]).cast("double"))).withColumn("low_threshold", F.coalesce("l", F.lit(every["l"]).cast("double")) / p.slack)
    within = F.when(F.lit(mean_all is None), F.col("n_tokens") > 0).otherwise((F.col("judged") <= F.col("threshold")) & (F.col("fitted") >= F.col("low_threshold")))
    lang = F.nullif(F.col("lang"), F.lit("\x00")).alias("lang")
    return out.select("doc_id", F.col("h").alias("text_hash"), lang, "n_tokens", "perplexity", "fitted", "judged", "threshold", "low_threshold", F.coalesce(within, F.lit(False)).alias("keep"))


def _scored(enc: DataFrame, path: str, p: QualityParams) -> DataFrame:
    """``_SCORED`` of every document of the chunks, which lie in ``path``."""
    spark = enc.sparkSession
    docs, total = enc.where("kind = 'docs'"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    n = docs.agg(F.coalesce(F.sum(total), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    shards, word_shards = (max(partitions(spark), -(-int(x) // p.shard_pairs)) for x in n)
    known = materialize(_numbered(enc.where("kind = 'words'"), word_shards, p), "kn-numbers")
    remove(spark, f"{path}/kind=words")
    answers, vocabulary = known.where("chunk is not null").select("shard", "chunk", "ids"), known.where("chunk is null").select("shard", "own_names", "owns", "kinds")
    languages = materialize(_languages(vocabulary), "kn-languages")
    spoken = docs.select(F.col("chunk").alias("part"), F.explode(F.array_union("own_names", F.array(F.lit("")))).alias("own"))

    def given(df: DataFrame, what: str, *columns: str) -> DataFrame:
        """Rows of ``_GIVEN``: what a chunk (``part``) is told; numbers are never null, which would make all of them floats."""
        fill = {"shard": F.lit(-1), "number": F.lit(-1), "what": F.lit(what)}
        return df.select(*[F.col(c) if c in columns else fill.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in _GIVEN.split(", "))])

    def grams(turn: int, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """The chunk's distinct pairs and their counts in its trusted documents, by shard; those of the shards whose turn it is."""
        out = []
        for row in docs.itertuples(index=False):
            sizes = np.asarray(row.sizes, dtype=np.int64)
            pairs = _Pairs.of(_symbols(row, told)[0], _unpack(row.tokens).astype(np.int32), np.asarray(row.starts, dtype=np.int32), sizes)
            n = np.bincount(pairs.at[np.repeat(np.asarray(row.trusted, dtype=bool), sizes)], minlength=len(pairs.b))
            shard = _shards(pairs.b, pairs.c, shards)
            mine = np.nonzero(shard % p.pair_passes == turn)[0]
            order = mine[np.argsort(shard[mine], kind="stable")]
            for k, at in zip(*_parts(shard[order]), strict=True):
                own = order[at]
                out.append((k, row.chunk, _pack(np.diff(pairs.b[own], prepend=0)), _pack(pairs.c[own]), _pack(n[own])))
        return pd.DataFrame(out, columns=_names(_GRAMS))

    asked = docs.select("chunk", "own_names", "trusted", "sizes", "starts", "tokens", "freqs", "codes")
    named = given(spoken.join(languages.select("own", "number"), "own"), "language", "part", "own", "number")
    numbers = given(answers.select(F.col("chunk").alias("part"), "shard", F.col("ids").alias("a")), "numbers", "part", "shard", "a")

    def sent(turn: int) -> DataFrame:
        def grams_of_turn(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            return grams(turn, docs, told)

        return asked.groupBy("chunk").cogroup(numbers.union(named).groupBy("part")).applyInPandas(grams_of_turn, _GRAMS)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        """The shard's pairs summed over the chunks, and for each chunk the counts of the pairs it sent."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for row in rows.itertuples(index=False):
            n = _unpack(row.n)
            some = n > 0
            held.append((np.cumsum(_unpack(row.b))[some], _unpack(row.c)[some], n[some]))
        b, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        kb, rb = np.unique(b, return_inverse=True)
        kc, rc = np.unique(c, return_inverse=True)
        keys = rb.astype(np.int64) * len(kc) + rc
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.empty(0, dtype=bool)
        at = np.nonzero(first)[0]
        keys, n = keys[order][at], np.add.reduceat(n[order], at) if len(at) else n
        out = []
        for row in rows.itertuples(index=False):
            b, c = np.cumsum(_unpack(row.b)), _unpack(row.c)
            found = np.zeros(len(b), dtype=np.int64)
            if len(keys):
                i, j = np.minimum(np.searchsorted(kb, b), len(kb) - 1), np.minimum(np.searchsorted(kc, c), len(kc) - 1)
                wanted = i * len(kc) + j
                k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = np.where((kb[i] == b) & (kc[j] == c) & (keys[k] == wanted), n[k], 0)
            out.append((row.shard, row.chunk, _pack(found), *[None] * 9))
        own_b, own_c = keys // max(len(kc), 1), keys % max(len(kc), 1)
        levels = [np.bincount(own_b, weights=w, minlength=len(kb)).astype(np.int64) for w in (n, n == 1, n == 2, n >= 3)]
        follows = np.bincount(own_c, minlength=len(kc))
        none = [rows["shard"].iloc[0], None, None]
        at_b, at_c = (dict(zip(*_by_shard(k, word_shards), strict=True)) for k in (kb, kc))
        for k in at_b.keys() | at_c.keys():
            i, j = (x.get(k, np.empty(0, dtype=np.int64)) for x in (at_b, at_c))
            out.append((*none, k, _pack(np.diff(kb[i], prepend=0)), *[_pack(x[i]) for x in levels], _pack(np.diff(kc[j], prepend=0)), _pack(follows[j]), None))
        out.append((*none, *[None] * 8, [int((n == i).sum()) for i in (1, 2, 3, 4)]))
        return pd.DataFrame(out, columns=_names(_COUNTED)).astype({"chunk": "Int64", "part": "Int32"})

    # All pairs at once would take more disk than the chunks do, so the shards take turns.
    turns = [materialize(sent(turn).groupBy("shard").applyInPandas(count, _COUNTED), "kn-counted") for turn in range(p.pair_passes)]
    counted = functools.reduce(DataFrame.union, turns)
    d2 = _discounts(*counted.where("cofc is not null").agg(*[F.coalesce(F.sum(F.col("cofc")[i]), F.lit(0)) for i in range(4)]).first())
    values = materialize(_values(counted.where("part is not null"), vocabulary, word_shards), "kn-values")
    languages, d1 = _smoothed(values, languages)
    languages = materialize(languages, "kn-floors")

    def valued(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Each chunk's symbols with their values, in the order of the symbols."""
        out = []
        columns = [_unpack(x) for x in held.iloc[0][["cc", "s", "n1", "n2", "n3"]]] if len(held) else []
        for row in asked.itertuples(index=False):
            ids = _unpack(row.ids)
            at = (ids[ids > 0] >> 1) // word_shards
            out.append((row.chunk, "values", row.shard, row.ids, *[_pack(x[at]) for x in columns], None, -1, None, None, None))
        return pd.DataFrame(out, columns=_names(_GIVEN))

    symbols = answers.groupBy("shard").cogroup(values.where("shard is not null").select("shard", "cc", "s", "n1", "n2", "n3").groupBy("shard")).applyInPandas(valued, _GIVEN)
    counts = given(counted.where("chunk is not null").select(F.col("chunk").alias("part"), "shard", F.col("n").alias("a")), "counts", "part", "shard", "a")
    named = given(spoken.join(languages, "own"), "language", "part", "own", "number", "m", "floor", "classes")

    def score(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        answer = {int(r.shard): r.a for r in told[told["what"] == "counts"].itertuples(index=False)}
        for row in docs.itertuples(index=False):
            sizes, tokens, starts = np.asarray(row.sizes, dtype=np.int64), _unpack(row.tokens).astype(np.int32), np.asarray(row.starts, dtype=np.int32)
            ids, cc, s, *ns, m, floor = _symbols(row, told, values=True)
            g = np.where(s > 0, (d2[0] * ns[0] + d2[1] * ns[1] + d2[2] * ns[2]) / np.maximum(s, 1), 1.0)
            pairs = _Pairs.of(ids, tokens, starts, sizes)
            n = np.zeros(len(pairs.b))
            shard = _shards(pairs.b, pairs.c, shards)
            order = np.argsort(shard, kind="stable")
            for k, at in zip(*_parts(shard[order]), strict=True):
                n[order[at]] = _unpack(answer[k])
            before = _before(tokens, starts, sizes)
            low = _discounted(cc, d1) / m + floor
            # trusted documents once more, without what they added to the counts themselves
            good, ends = np.asarray(row.trusted, dtype=bool), np.cumsum(sizes)
            nats, new_nats = np.empty(len(sizes)), np.empty(len(sizes))
            for docs_at in _blocks(sizes, p.block_tokens):  # what each token needs takes much more memory than the tokens
                own_sizes, own_good = sizes[docs_at], good[docs_at]
                token_at = slice(ends[docs_at.start] - sizes[docs_at.start], ends[docs_at.stop - 1])
                at, b, c = pairs.at[token_at], before[token_at], tokens[token_at]
                nats[docs_at] = new = _by_document(-np.log(_interpolated(n[at], s[b], d2, g[b], low[c])), own_sizes)
                own = np.repeat(own_good, own_sizes)
                if own.any():
                    doc, at, b, c = np.repeat(np.arange(len(own_sizes)), own_sizes)[own], at[own], b[own], c[own]
                    n_new = n[at] - _times(doc, at)
                    s_new = s[b] - _times(doc, b)
                    cc_new = cc[c] - _alone(doc, at, c, n_new)
                    prob = _interpolated(n_new, s_new, d2, g[b], _discounted(cc_new, d1) / m[c] + floor[c])
                    new = new.copy()
                    new[own_good] = _by_document(-np.log(prob), own_sizes[own_good])
                new_nats[docs_at] = new
            out.append(pd.DataFrame({"doc_id": pd.array(list(row.doc_ids), dtype="Int64"), "h": row.hashes, "lang": row.langs, "trusted": row.trusted, "n_tokens": sizes, "nats": nats, "new_nats": new_nats}))
        return pd.concat(out) if out else pd.DataFrame(columns=_names(_SCORED))

    chunks = docs.select(*asked.columns, "doc_ids", "hashes", "langs")
    return chunks.groupBy("chunk").cogroup(counts.union(symbols).union(named).groupBy("part")).applyInPandas(score, _SCORED)


def _by_shard(ids: np.ndarray, shards: int) -> tuple[list[int], list[np.ndarray]]:
    """The shards of symbols, and for each the places of its symbols, in order."""
    shard = (ids >> 1) % shards
    order = np.argsort(shard, kind="stable")
    found, at = _parts(shard[order])
    return found, [order[x] for x in at]


def _numbered(words: DataFrame, shards: int, p: QualityParams) -> DataFrame:
    """``_KNOWN``: the symbols' numbers for each chunk and shard, in the order of the chunk's words (0: no symbol); and, without a chunk, each shard's symbols.

    A word's number is odd, ``2 * (rank * shards + shard) + 1``; ranks go by frequency, so frequent
    symbols have small numbers everywhere.  Classes have even numbers (:func:`_languages`).
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                w, n, own = np.cumsum(_unpack(row.words)), _unpack(row.counts), _unpack(row.owns)
                shard = ((w >> 32) + (1 << 31)) * shards >> 32
                for k, at in zip(*_parts(shard), strict=True):
                    out.append((k, row.chunk, row.own_names, _pack(np.diff(w[at], prepend=0)), _pack(n[at]), _pack(own[at])))
            yield pd.DataFrame(out, columns=_names(_WORDS))

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        shard, names = int(rows["shard"].iloc[0]), {}
        held = []
        for row in rows.itertuples(index=False):
            own = np.array([names.setdefault(x, len(names)) for x in row.own_names])
            held.append((np.cumsum(_unpack(row.words)), _unpack(row.counts), own[_unpack(row.owns)]))
        w, n, own = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(w, kind="stable")
        w, n, own = w[order], n[order], own[order]
        at = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
        w, n, own = w[at], np.add.reduceat(n, at), own[at]
        some = n >= max(p.least_count, 1)  # words without a count are no trusted ones
        w, n, own = w[some], n[some], own[some]
        order = np.argsort(-n, kind="stable")
        ids = np.empty_like(w)
        ids[order] = 2 * (np.arange(len(w)) * shards + shard) + 1
        out = [(shard, None, None, list(names), _pack(own[order]), np.bincount(own, minlength=len(names)))]
        for row, (sent, _, _) in zip(rows.itertuples(index=False), held, strict=True):
            k = np.minimum(np.searchsorted(w, sent), max(len(w) - 1, 0))
            found = np.where(w[k] == sent, ids[k], 0) if len(w) else np.zeros(len(sent), dtype=np.int64)
            out.append((shard, row.chunk, _pack(found), None, None, None))
        return pd.DataFrame(out, columns=_names(_KNOWN)).astype({"chunk": "Int64"})

    with_words = words.select("chunk", "own_names", "words", "counts", "owns")
    return with_words.mapInPandas(deal, _WORDS).groupBy("shard").applyInPandas(number, _KNOWN)


def _languages(vocabulary: DataFrame) -> DataFrame:
    """``own, number, kinds`` of every language that has symbols of its own, and of none (``''``); a class's number is ``2 * (8 * number + shape + 1)``."""
    kinds = vocabulary.select(F.explode(F.arrays_zip("own_names", "kinds")).alias("x")).groupBy(F.col("x.own_names").alias("own")).agg(F.sum("x.kinds").alias("n"))
    kinds = kinds.where("n > 0").union(vocabulary.sparkSession.range(1).select(F.lit("").alias("own"), F.lit(0).cast("long").alias("n"))).groupBy("own").agg((F.max("n") + 1 + _SHAPES).alias("kinds"))
    # Numbers are dense: the rank in one of many equal shares of the languages, and the share.
    share = F.pmod(F.xxhash64("own"), F.lit(64))
    rank = F.row_number().over(Window.partitionBy(share).orderBy("own")) - 1
    return kinds.select("own", (rank.cast("long") * 64 + share).alias("number"), "kinds")


def _symbols(row: tuple, told: pd.DataFrame, values: bool = False) -> list[np.ndarray]:
    """The number of each of the chunk's words: the symbol's, else its class's, else that of the class without a language.

    With ``values`` also ``cc, s, n1, n2, n3`` of the symbol and ``m, floor`` of its language (see :func:`_values`).
    """
    spoken = {r.own: r for r in told[told["what"] == "language"].itertuples(index=False)}
    rows = [spoken.get(x, spoken[""]) for x in row.own_names]
    codes = _unpack(row.codes)
    own, kind = codes >> 3, codes & 7
    kept = told[told["what"] == ("values" if values else "numbers")].sort_values("shard")
    ids = np.concatenate([_unpack(x) for x in kept["a"]])
    word = ids > 0
    ids = np.where(word, ids, 2 * (8 * np.array([r.number for r in rows], dtype=np.int64)[own] + kind))
    order = _by_frequency(_unpack(row.freqs))
    if not values:
        return [ids[order]]
    classes = np.array([np.stack(r.classes) for r in rows], dtype=np.int64)[own, kind]
    out = [ids]
    for i, c in enumerate(("cc", "s", "n1", "n2", "n3")):
        x = classes[:, i]
        x[word] = np.concatenate([_unpack(v) for v in kept[c] if v is not None])
        out.append(x)
    return [x[order] for x in (*out, *[np.array([getattr(r, c) for r in rows])[own] for c in ("m", "floor")])]


def _values(stats: DataFrame, vocabulary: DataFrame, shards: int) -> DataFrame:
    """What the symbols of a shard have in all pairs, by rank; sums over a shard's languages; classes one by one.

    ``cc``: the symbol's continuations; ``s``: how often it is a context, ``n1``, ``n2``, ``n3``: how many of
    that context's pairs are seen once, twice, more often.  ``sums``: for a language, how many words
    have 1, 2, 3, 4 and at least 3 continuations, and all continuations.
    """

    def add(stats: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        owns = _unpack(words["owns"].iloc[0]) if len(words) else np.empty(0, dtype=np.int64)
        held = [np.zeros(len(owns), dtype=np.int64) for _ in range(5)]
        classes: dict[int, np.ndarray] = {}
        for row in stats.itertuples(index=False):
            b, c = np.cumsum(_unpack(row.b)), np.cumsum(_unpack(row.c))
            for ids, i, x in ((c, 0, _unpack(row.cc)), *((b, i, _unpack(x)) for i, x in enumerate((row.s, row.n1, row.n2, row.n3), 1))):
                word = ids & 1 == 1
                held[i][(ids[word] >> 1) // shards] += x[word]  # a symbol is once in a row
                for k, v in zip(ids[~word].tolist(), x[~word].tolist(), strict=True):
                    classes.setdefault(k, np.zeros(5, dtype=np.int64))[i] += v
        cc, out, none = held[0], [], [None] * 6
        if len(words):
            shard, names = int(words["shard"].iloc[0]), list(words["own_names"].iloc[0])
            out.append((shard, *[_pack(x) for x in held], None, None, None, None))
            sums = np.stack([np.bincount(owns, weights=w, minlength=len(names)).astype(np.int64) for w in (cc == 1, cc == 2, cc == 3, cc == 4, cc >= 3, cc)], axis=1)
            out += [(*none, name, x, None, None) for name, x in zip(names, sums, strict=True) if x[-1]]
        out += [(*none, None, None, k, x) for k, x in classes.items()]
        return pd.DataFrame(out, columns=_names(_VALUES)).astype({"shard": "Int32", "class": "Int64"})

    return stats.select("part", "b", "s", "n1", "n2", "n3", "c", "cc").groupBy("part").cogroup(vocabulary.groupBy("shard")).applyInPandas(add, _VALUES)


def _smoothed(values: DataFrame, languages: DataFrame) -> tuple[DataFrame, list[float]]:
    """``own, number, m, floor, classes`` by language, and the discounts of continuations.

    ``m``: the continuations of all its symbols; ``floor``: the share of each of its symbols in what is
    never seen; ``classes``: the values of each of its classes (:func:`_values`), the start mark first.
    """
    classes = values.where("class is not null").select(F.shiftright("class", 4).alias("number"), F.pmod(F.shiftright("class", 1), F.lit(8)).cast("int").alias("kind"), "of_class")
    cc = F.col("of_class")[0]
    sums = F.array(*[(cc == i).cast("long") for i in (1, 2, 3, 4)], (cc >= 3).cast("long"), cc)
    every = values.where("own is not null").select("own", "sums").union(classes.where(cc > 0).join(languages, "number").select("own", sums))
    every = every.groupBy("own").agg(*[F.sum(F.col("sums")[i]).alias(x) for i, x in enumerate(("m1", "m2", "m3", "m4", "more", "m"))])
    d1 = _discounts(*every.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("m1", "m2", "m3", "m4")]).first())
    weight = (d1[0] * F.col("m1") + d1[1] * F.col("m2") + d1[2] * F.col("more")) / F.col("m")
    seen = classes.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("kind", "of_class"))).alias("seen"))  # eight at most
    zeros = F.array(*[F.lit(0).cast("long")] * 5)
    of_kinds = F.array(*[F.coalesce(F.try_element_at("seen", F.lit(k)), zeros) for k in range(8)]).alias("classes")
    found = languages.join(every, "own", "left").join(seen, "number", "left")
    return found.select("own", "number", F.coalesce("m", F.lit(1)).cast("double").alias("m"), (F.coalesce(weight, F.lit(1.0)) / F.col("kinds")).alias("floor"), of_kinds), d1


def _discounted(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(n - np.choose(np.clip(n, 0, 3).astype(np.int64), [0.0, *d]), 0.0)


def _interpolated(n: np.ndarray, s: np.ndarray, d: list[float], g: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A pair's probability from its count, its context's, and what its second symbol has without a context."""
    return np.where(s > 0, _discounted(n, d) / np.maximum(s, 1) + g * low, low)


def _before(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; a document's first one has the start mark."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    some = sizes > 0
    before[(np.cumsum(sizes) - sizes)[some]] = starts[some]
    return before


def _blocks(sizes: np.ndarray, tokens: int) -> list[slice]:
    """Runs of documents that begin within ``tokens`` tokens of each other; together they are all documents."""
    return _parts((np.cumsum(sizes) - sizes) // tokens)[1]


def _by_document(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over each document's tokens; NaN where it has none."""
    sums, ends = np.concatenate([[0.0], np.cumsum(x)]), np.cumsum(sizes)
    return np.where(sizes > 0, sums[ends] - sums[ends - sizes], np.nan)


def _times(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How often each token's value occurs in its document."""
    _, at, n = np.unique(doc * (int(x.max()) + 1) + x, return_inverse=True, return_counts=True)  # doc is 64-bit
    return n[at]


def _alone(doc: np.ndarray, pair: np.ndarray, c: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each token: how many distinct pairs with its second symbol only its document has."""
    only = left <= 0
    _, first = np.unique(doc[only] * (int(pair.max()) + 1) + pair[only], return_index=True)
    width = int(c.max()) + 1
    keys, n = np.unique(doc[only][first] * width + c[only][first], return_counts=True)
    if not len(keys):
        return np.zeros(len(c), dtype=np.int64)
    want = doc * width + c
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, n[at], 0)


def _parts(ordered: np.ndarray) -> tuple[list[int], list[slice]]:
    """The distinct values of a sorted array and where each lies."""
    if not len(ordered):
        return [], []
    at = np.concatenate([[0], np.nonzero(ordered[1:] != ordered[:-1])[0] + 1, [len(ordered)]])
    return ordered[at[:-1]].tolist(), [slice(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _few(df: DataFrame, p: QualityParams) -> bool:
    """At most ``broadcast_rows`` rows, counted."""
    return df.count() <= p.broadcast_rows


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three modified Kneser-Ney discounts; fixed ones where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.0), float(i)) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]


def accepted(docs: DataFrame, trusted: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns."""
    judged = judge(docs, trusted, p).where("not keep")
    rejected = materialize(judged.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), F.col("lang").alias("r_lang")).distinct(), "kn-rejected")
    few = _few(rejected, p)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("r_id")) & (F.xxhash64("text") == F.col("r_hash")) & F.col("lang").eqNullSafe(F.col("r_lang"))
    return docs.join(F.broadcast(rejected) if few else rejected, same, "left_anti")
