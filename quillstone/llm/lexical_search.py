"""Ranked lexical search with WAND over document shards.

1. Every document's terms are counted once, within its row; of the terms that some item holds, ids and numbers of
   occurrences are written as a table of postings, beside the document's length.  Numbers of documents (N), of all
   terms (L) and of documents that hold a term are aggregates of that table.
2. A task's documents form shards of a bounded number of postings.  In a shard every term's postings lie in the order
   of doc_id, with their impacts (the parts of a score) and the largest of them.  For each item the lists' next
   documents are kept in order; the pivot is the first document at which the largest impacts of the lists so far exceed
   the worst score in the heap, so every document before it is skipped without being scored.
3. The shards' heaps, at most ``k`` rows an item and shard, are cut again in salted groups and then merged.

Scores are whole numbers, so largest impacts are true bounds and the result is exact.  Documents are met in the order
of doc_id, so one that only equals the heap's worst score never enters: ties go to the smaller doc_id.

Items come in blocks of bounded size, by the hash of their id; each block is sent to all tasks and
meets all documents.  One block is the rule; more of them reread the documents.

Edge cases: null or termless texts take no part and don't count in N; an item without terms has no rows.  Rows of one
item_id (null is one) are one item with all their terms.  Each row of the documents is a document: repeated rows take
a rank each; null doc_ids come last among equal scores.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

#: What is no term: ASCII but letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In UTF-8 all bytes of other characters are above 0x7F, so a table of bytes lower-cases A-Z and blanks what is no term.
_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else 32 for b in range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    block_bytes: int = 16 << 20
    shard_postings: int = 2_000_000
    salts: int = 64


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_BYTES).split()


def impact(weight: int | np.ndarray, tf: int | np.ndarray, m: int | np.ndarray) -> int | np.ndarray:
    """A term's part of the score of a document of relative length ``m``."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def wand(docs: array, impacts: array, lists: list[tuple[int, int, int]], k: int) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, document)``, best first, equal scores by document; ``lists``: (start, end, largest impact).

    ``docs[start:end]`` are a term's documents in ascending order and ``impacts`` their parts of the score.
    """
    heap: list[tuple[int, int]] = []  # (score, -document), the worst first
    worst = 0
    ends, most = [x[1] for x in lists], [x[2] for x in lists]
    now = sorted((docs[start], t, start) for t, (start, end, _) in enumerate(lists) if start < end)  # (next document, list, place)
    while now:
        bound, pivot = 0, -1
        for doc, t, _ in now:
            bound += most[t]
            if bound > worst:
                pivot = doc
                break
        if pivot < 0:
            break
        moved = 0
        if now[0][0] == pivot:
            score = 0
            for doc, t, at in now:
                if doc != pivot:
                    break
                score += impacts[at]
                now[moved] = (docs[at + 1], t, at + 1) if at + 1 < ends[t] else None
                moved += 1
            if score > worst:
                if len(heap) < k:
                    heappush(heap, (score, -pivot))
                else:
                    heapreplace(heap, (score, -pivot))
                worst = heap[0][0] if len(heap) == k else 0
        else:
            for doc, t, at in now:
                if doc >= pivot:
                    break
                at = bisect_left(docs, pivot, at, ends[t])
                now[moved] = (docs[at], t, at) if at < ends[t] else None
                moved += 1
        if None in now[:moved]:
            now = [x for x in now if x is not None]
        now.sort()
    return [(score, -doc) for score, doc in sorted(heap, key=lambda x: (-x[0], -x[1]))]


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, ids, tfs`` of every document with a term; ``ids``: the numbers of its terms in the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in batches:
            n, ids, tfs, ends, kept = [], [], [], [0], []
            texts = b.column("text").cast(pa.binary())
            for i in range(b.num_rows):
                own = terms(texts[i].as_py() or b"")
                if not own:
                    continue
                met = Counter(map(number, own))
                met.pop(None, None)
                kept.append(i)
                n.append(len(own))
                ids += met.keys()
                tfs += met.values()
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<int>")


class _Shard:
    """Postings of some documents by term, and the search in them."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        sizes = np.concatenate([np.diff(b.column("ids").offsets.to_numpy()) for b in batches])
        ids, tfs = (np.concatenate([b.column(c).flatten().to_numpy() for b in batches]) for c in ("ids", "tfs"))
        named = table.column("doc_id")
        no_id = np.asarray(named.is_null())
        own = named.fill_null(0).to_numpy()
        order = np.lexsort((own, no_id))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.doc_ids = [None if x else int(d) for d, x in zip(own[order], no_id[order], strict=True)]
        m = 10 + 90 * table.column("n").to_numpy() * n_docs // n_terms
        at = np.repeat(np.arange(len(sizes)), sizes)
        parts = impact(weights[ids], tfs.astype(np.int64), m[at])
        by = np.lexsort((place[at], ids))
        ids, parts = ids[by], parts[by]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, dtype=np.int64)
        most = np.maximum.reduceat(parts, starts) if len(ids) else parts
        self.docs, self.impacts = array("i", place[at][by].astype(np.int32).tobytes()), array("q", parts.astype(np.int64).tobytes())
        ends = np.r_[starts[1:], len(ids)][: len(starts)]
        self.lists = {int(t): (int(a), int(z), int(x)) for t, a, z, x in zip(ids[starts], starts, ends, most, strict=True) if x > 0}

    def search(self, item: list[int], k: int) -> list[tuple[int | None, int]]:
        lists = [self.lists[t] for t in item if t in self.lists]
        return [(self.doc_ids[doc], score) for score, doc in wand(self.docs, self.impacts, lists, k)]


def _block(docs: DataFrame, items: DataFrame, p: SearchParams) -> DataFrame:
    """The shards' best of one block of items, written."""
    found = items.collect()  # bounded by block_bytes
    vocabulary: dict[bytes, int] = {}
    item_ids = [r["item_id"] for r in found]
    own = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(x for text in r["texts"] for x in terms(text.encode()))] for r in found]
    with arrow_rows(docs.sparkSession, 500):  # whole texts
        rows = materialize(postings(docs, vocabulary), "postings")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for t, df in rows.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # at most a row a term of the block
        weights[t] = weight(n_docs, df)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def best() -> pa.RecordBatch:
            shard = _Shard(held, weights, n_docs, n_terms)
            out = [(item_ids[i], d, s) for i, item in enumerate(own) for d, s in shard.search(item, p.k)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

        for b in batches:
            held.append(b)
            size += len(b.column("ids").flatten()) + b.num_rows
            if size >= p.shard_postings:
                yield best()
                held, size = [], 0
        if held:
            yield best()

    with arrow_rows(docs.sparkSession, 2_000):
        return materialize(rows.mapInArrow(search, "item_id long, doc_id long, score long"), "shard-heaps")


def search(docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``p.k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // p.block_bytes))
    merged = None
    for b in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
        heaps = _block(docs, own, p)
        merged = heaps if merged is None else merged.union(heaps)
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = merged.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(p.salts)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*best))).where(F.col("rank") <= p.k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= p.k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB SQL for the rows of :func:`search` over ``documents`` and ``benchmark``, every pair scored.
SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
t AS (SELECT rid, unnest(terms) AS term FROM d WHERE len(terms) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM t GROUP BY rid, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
k AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
m AS (SELECT rid, doc_id, 100 - 90 + ((90 * len(terms) * n) // l) AS m FROM d, k WHERE len(terms) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, k),
s AS (SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, rid),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
