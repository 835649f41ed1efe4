"""N-gram Jaccard join by MinHash banding.

Shingles are ``n`` consecutive words (word characters, lower case); a text of fewer words is one
shingle.  Texts with equal shingle sets form a class; the join runs on classes, so copies never
meet each other.

1. Every class gets ``bands * rows`` minima; bands and rows are chosen so that a pair at the
   threshold shares a band with the target recall.  Band hashes are shuffled; a bucket of several
   classes links each of them to its least one (a star, never all pairs).
2. The stars' connected components hold every candidate pair.  Their members are sorted by set
   size and cut into blocks of ``block`` classes; each pair of blocks whose sizes can reach the
   threshold is one task that verifies on the full shingle sets by matrix products.  It returns
   each class's number of links and a spanning forest of the links, never the pairs.
3. Connected components of the forests are the result's classes.

Nothing is capped: a component of any size is verified whole, block by block.

Edge cases: a null text is the empty text; texts without words (also empty ones) have no shingle
and link to nothing, each row its own class; repeated rows and equal texts are copies of one
another and count as links; rows without doc_id take part and have a class, whose id is the least
doc_id in it (null if none has one).  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize

_WORD = re.compile(r"\w+")
_P = (1 << 61) - 1


@dataclass(frozen=True)
class JoinParams:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    seed: int = 2026
    block: int = 512
    broadcast_rows: int = 1_000_000


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """``(bands, rows)``: the most selective banding of at most ``most`` minima that reaches the recall."""
    best = (most, 1)
    for rows in range(1, 13):
        bands = int(np.ceil(np.log(max(1e-12, 1 - recall)) / np.log(1 - threshold**rows)))
        if bands * rows <= most // 2:
            best = (bands, rows)
    return best


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of ``text``."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, dtype=np.int64)
    cache: dict[str, int] = {}
    ids = np.fromiter((cache.get(w) or cache.setdefault(w, crc32(b := w.encode("utf-8", "surrogatepass")) << 16 ^ len(b) * 40503 ^ crc32(b[::-1]) >> 3) for w in words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        ids = _mix(ids)
        if len(ids) <= n:
            ids = np.concatenate([ids, np.zeros(n - len(ids), dtype=np.uint64)])
        h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
    return np.unique(h.view(np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def band_hashes(sets: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One 64-bit hash a band of the minima of ``sets`` under multiply-shift permutations."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size=bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size=bands * rows, dtype=np.uint64)
    x = _mix(sets.view(np.uint64))
    out = np.empty(bands * rows, dtype=np.uint64)
    with np.errstate(over="ignore"):
        step = max(1, 262_144 // max(1, len(x)))
        for i in range(0, len(out), step):
            y = a[i : i + step, None] * x[None, :] + b[i : i + step, None]
            y ^= y >> np.uint64(32)
            y *= np.uint64(0xD6E8FEB86659FD93)
            out[i : i + step] = y.min(axis=1)
        h = np.zeros(bands, dtype=np.uint64)
        for k in range(rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + out.reshape(bands, rows)[:, k])
    return h.view(np.int64)


def verify(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at or above the threshold, within ``sets`` (i < j) or between it and ``other``.

    The intersection sizes are products of 0/1 matrices over the shared shingles, in column
    slices, so memory does not depend on the texts.
    """
    every = sets if other is None else sets + other
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    flat = np.concatenate(every)
    kinds, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    many = n > 1
    number = np.cumsum(many) - 1
    live = many[col]
    owner, col = owner[live], number[col[live]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width, total = 8192, int(many.sum())
    rows = len(sets)
    inter = np.zeros((rows, len(every) - (0 if other is None else rows)), dtype=np.float32)
    for start in range(0, total, width):
        lo, hi = np.searchsorted(col, [start, start + width])
        m = np.zeros((len(every), min(width, total - start)), dtype=np.float32)
        m[owner[lo:hi], col[lo:hi] - start] = 1
        left, right = m[:rows], m if other is None else m[rows:]
        a, b = left.any(1), right.any(1)
        inter[np.ix_(a, b)] += left[a] @ right[b].T
    size_l = np.array([len(s) for s in sets], dtype=np.float64)
    size_r = size_l if other is None else np.array([len(s) for s in other], dtype=np.float64)
    near = inter >= threshold * (size_l[:, None] + size_r[None, :] - inter) - 1e-9
    if other is None:
        near &= np.triu(np.ones_like(near), 1)
    return np.nonzero(near)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges over ``n`` nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def similar(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """The class and number of links of every row of ``docs(doc_id, text)``.

    Returns doc_id, text_hash (``xxhash64(text)``), class_id (least doc_id among the linked
    documents and their links, transitively), class_key (the same for classes without any
    doc_id), n_links (how many other rows are at or above the threshold), n_shingles.
    """
    bands, rows = banding(p.threshold, p.recall)

    def fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, h, text in zip(b["doc_id"], b["h"], b["text"], strict=True):
                s = shingles(text, p.n)
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                out.append((None if pd.isna(doc_id) else int(doc_id), h, key, len(s), band_hashes(s, bands, rows, p.seed) if len(s) else None))
            yield pd.DataFrame(out, columns=["doc_id", "h", "k", "n", "bands"]).astype({"doc_id": "Int64", "k": "Int64"})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    marked = materialize(base.mapInPandas(fingerprint, "doc_id long, h long, k long, n int, bands array<long>"), "join-marked")
    sets = marked.where("k is not null").groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("copy"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = materialize(sets, "join-sets")

    keyed = sets.select("k", F.posexplode("bands").alias("band", "hash"))
    stars = keyed.groupBy("band", "hash").agg(F.min("k").alias("low"), F.count("*").alias("c")).where("c > 1")
    edges = keyed.join(stars, ["band", "hash"]).where("k <> low").select(F.col("k").alias("a"), F.col("low").alias("b")).distinct()
    groups = materialize(connected_components(edges, "join-candidates").join(sets.select(F.col("k").alias("node"), "n", "copies", "copy"), "node"), "join-groups")

    # Blocks: members of a component in the order of their size; a block's place follows from
    # per-size counts, so that a component of any size is never one task.
    found = _blocks(docs, groups, p)
    links = found.where("a is null").groupBy("k").agg(F.sum("links").alias("links"))
    forest = found.where("a is not null").select("a", "b")
    linked = connected_components(forest, "join-links")

    per = sets.select("k", "copies", "least").join(linked.withColumnRenamed("node", "k"), "k", "left").join(links, "k", "left")
    per = per.withColumn("component", F.coalesce("component", "k"))
    ids = per.groupBy("component").agg(F.min("least").alias("class_id"))
    per = per.join(ids, "component").select("k", F.col("component").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.select("doc_id", F.col("h").alias("text_hash"), "k", F.col("n").alias("n_shingles")).join(per, "k", "left")
    return out.select("doc_id", "text_hash", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")


def _blocks(docs: DataFrame, groups: DataFrame, p: JoinParams) -> DataFrame:
    """Verified links of the candidate components: rows ``k, links`` and forest rows ``a, b``."""
    # Rank by size within the component through counts of (component, size, salt) cells.
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)).cast("int"))
    cells = salted.groupBy("component", "n", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("component").orderBy("n", "salt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("component")
    cells = cells.withColumn("skip", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("m", F.sum("c").over(whole))
    within = F.row_number().over(Window.partitionBy("component", "n", "salt").orderBy("node"))
    placed = salted.withColumn("r", within).join(cells, ["component", "n", "salt"])
    placed = placed.withColumn("blk", F.floor((F.col("skip") + F.col("r") - 1) / p.block).cast("int"))
    placed = materialize(placed.select("node", "component", "n", "copies", "copy", "blk"), "join-placed")

    spans = placed.groupBy("component", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c"))
    left = spans.select("component", F.col("blk").alias("x"), F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"), F.col("c").alias("c_x"))
    right = spans.select("component", F.col("blk").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), F.col("c").alias("c_y"))
    pairs = left.join(right, "component").where((F.col("x") <= F.col("y")) & (F.col("hi_x") >= p.threshold * F.col("lo_y")))
    pairs = pairs.where((F.col("x") < F.col("y")) | (F.col("c_x") > 1))
    roles = pairs.select("component", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("blk"))
    jobs = placed.join(roles, ["component", "blk"]).select("node", "component", "copies", "x", "y", "blk")

    # The members' shingle sets, made again from one copy of each text.  Which copies these are is
    # broadcast up to a counted number of rows; beyond it the texts are shuffled.
    wanted = placed.select("node", F.col("copy.doc_id").alias("w_id"), F.col("copy.h").alias("w_h"))
    if placed.count() <= p.broadcast_rows:
        wanted = F.broadcast(wanted)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "set": [shingles(t, p.n).tobytes() for t in b["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    texts = texts.join(wanted, (F.col("h") == F.col("w_h")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "text")
    texts = materialize(texts.mapInPandas(again, "node long, set binary").dropDuplicates(["node"]), "join-texts")
    jobs = jobs.join(texts, "node")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].iloc[0], rows["y"].iloc[0]
        first = rows[rows["blk"] == x].reset_index(drop=True)
        second = rows[rows["blk"] == y].reset_index(drop=True) if x != y else None
        sets = [np.frombuffer(s, dtype=np.int64) for s in first["set"]]
        others = [np.frombuffer(s, dtype=np.int64) for s in second["set"]] if second is not None else None
        i, j = verify(sets, others, p.threshold)
        right = first if second is None else second
        nodes = first["node"].to_numpy(dtype=np.int64)
        if second is not None:
            nodes = np.concatenate([nodes, second["node"].to_numpy(dtype=np.int64)])
        shift = 0 if second is None else len(first)
        links = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(links, i, right["copies"].to_numpy()[j])
        np.add.at(links, j + shift, first["copies"].to_numpy()[i])
        edges = _forest(len(nodes), i, j + shift)
        some = np.nonzero(links)[0]
        counted = pd.DataFrame({"k": nodes[some], "links": links[some], "a": None, "b": None})
        tree = pd.DataFrame({"k": None, "links": None, "a": [nodes[u] for u, _ in edges], "b": [nodes[v] for _, v in edges]})
        return pd.concat([d.astype({c: "Int64" for c in d}) for d in (counted, tree)])

    found = jobs.groupBy("component", "x", "y").applyInPandas(check, "k long, links long, a long, b long")
    return materialize(found, "join-found")


def one_of_each(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """``docs`` with one row of each class of :func:`similar`: least doc_id (null last), then least text hash.

    Rows without any word stay; of repeated rows one stays.
    """
    found = materialize(similar(docs, p).select("doc_id", "text_hash", "class_key").where("class_key is not null"), "join-classes")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), "text_hash", "doc_id")
    first = found.groupBy("class_key").agg(F.min(order).alias("first"))
    every = found.groupBy("class_key", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    marked = every.join(first, "class_key").select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "times", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"))
    marked = materialize(marked.where("not stays or times > 1"), "join-marked-rows")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("m_id")) & (F.xxhash64("text") == F.col("m_hash"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= p.broadcast_rows else df

    others = docs.join(small(marked), same, "left_anti")
    repeated = docs.join(small(marked.where("stays")), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return others.union(repeated)
