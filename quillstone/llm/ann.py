"""Approximate nearest neighbours by a hierarchical k-means tree.

Index.  A tree of k-means splits is fitted on the driver over a bounded, documented sample
(``train_rows`` vectors); every vector of the table is then routed down the tree to a leaf.
Equal vectors are one entry with the ``k + 1`` smallest ids (ties go to smaller ids, so no
other copy can ever be among a query's ``k``): a vector that holds a third of all rows costs
one comparison.  The entries of a leaf are cut into blocks of bounded size, so a hot leaf is
many rows, never one group.

Search.  For each distinct query vector a priority queue holds the tree's open branches by
inner product with their centroid; the best branch is opened first and leaves are visited in
that order.  How many leaves are visited is calibrated: for a bounded set of calibration
queries the true neighbours are found by brute force over every row, and the visits widen
until the target recall is reached.  Neighbouring leaves form groups of bounded size.  A query
goes once to each group that holds a leaf it visits; there a group's entries stay in memory
while its queries stream past, each visited leaf is a matrix product with those queries, and a
query leaves a group with its ``k + 1`` best.  The cut to the best is by exact score, then by
smaller id, after every entry as good as the last one (but for rounding) was scored again by one
fixed sum in double precision, so ties are cut by id and equal vectors have equal scores.

On vectors without clusters a fixed share of the leaves has to be visited, as any tree must.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part,
neither do rows without vec_id, nor vectors whose length is not the table's commonest (ties:
the longer); identical repeated rows count once; a table without vectors gives no rows; a
query gets all candidates if there are fewer than ``k``.  Products beyond the range of doubles are
infinite scores, which tie; a sum of both infinities counts as minus infinity.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions


@dataclass(frozen=True)
class AnnParams:
    """``train_rows`` and ``train_bytes`` bound the fitted sample; the tree that is sent to executors has at most
    a leaf for four sampled vectors.  ``group_bytes``: vectors that a task holds at once."""

    k: int = 20
    train_rows: int = 131_072
    train_bytes: int = 64 << 20
    branching: int = 16
    leaf_rows: int = 96
    target_recall: float = 0.96
    calibration_queries: int = 256
    group_bytes: int = 32 << 20
    hot_rows: int = 10_000
    seed: int = 2026


@dataclass
class Tree:
    """``first[i], count[i]``: children of node i in ``centroids``; ``leaf[i]``: its number, or -1."""

    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child centroid at every level."""
        node = np.zeros(len(x), dtype=np.int64)
        out = np.full(len(x), -1, dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            at = node[todo]
            done = self.leaf[at] >= 0
            out[todo[done]] = self.leaf[at[done]]
            todo, at = todo[~done], at[~done]
            for n in np.unique(at):
                rows = todo[at == n]
                c = self.centroids[self.first[n] : self.first[n] + self.count[n]]
                near = (c * c).sum(1) - 2.0 * (x[rows] @ c.T)
                node[rows] = self.first[n] + near.argmin(1)
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves in best-bin-first order for inner products with ``q``."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, n = heapq.heappop(heap)
            if self.leaf[n] >= 0:
                out.append(int(self.leaf[n]))
                continue
            a, b = int(self.first[n]), int(self.first[n] + self.count[n])
            for child, near in zip(range(a, b), self.centroids[a:b] @ q, strict=True):
                heapq.heappush(heap, (-float(near), child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centers * centers).sum(1) - 2.0 * (x @ centers.T)).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def fit_tree(sample: np.ndarray, leaves: int, p: AnnParams) -> Tree:
    """Split the largest cells first until there are about ``leaves`` of them."""
    x = np.unique(np.asarray(sample, dtype=np.float64), axis=0)
    rng = np.random.default_rng(p.seed)
    cent, first, count = [x.mean(0)], [0], [0]
    heap = [(-len(x), 0, 0, x)]
    n_leaves, ties = 1, 0
    while heap and n_leaves < leaves:
        _, _, node, rows = heapq.heappop(heap)
        k = min(p.branching, leaves - n_leaves + 1, len(rows) // 2)
        if k < 2:
            continue
        centers = _kmeans(rows, k, rng)
        near = ((centers * centers).sum(1) - 2.0 * (rows @ centers.T)).argmin(1)
        used = np.unique(near)
        if len(used) < 2:
            continue
        first[node], count[node] = len(cent), len(used)
        for u in used:
            ties += 1
            own = rows[near == u]
            cent.append(own.mean(0))
            first.append(0)
            count.append(0)
            heapq.heappush(heap, (-len(own), ties, len(cent) - 1, own))
        n_leaves += len(used) - 1
    counts = np.array(count)
    leaf = np.full(len(cent), -1, dtype=np.int64)
    leaf[counts == 0] = np.arange((counts == 0).sum())
    return Tree(np.array(cent), np.array(first), counts, leaf)


def usable(vector: Column) -> Column:
    """Not null, not zero, every component present and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, p: AnnParams = AnnParams()) -> DataFrame:
    """The ``p.k`` nearest other rows of each query row of ``vectors(vec_id, embedding)``.

    Returns query_id, rank (from 1), vec_id, score: the largest inner products, ties to the
    smaller vec_id.
    """
    spark = vectors.sparkSession
    k1 = p.k + 1
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, total = int(sizes[0]["d"]), int(sizes[0]["count"])
    base = base.where(F.size("v") == dim)

    def by_hash(df: DataFrame, rows: int, of: int, salt: int) -> DataFrame:
        share = min(1.0, rows / max(of, 1))
        return df.where(F.pmod(F.xxhash64("vec_id", F.lit(p.seed + salt)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else df

    train = max(4, min(p.train_rows, p.train_bytes // (8 * dim)))
    sample = by_hash(base, train, total, 0).select("v").limit(2 * train).toPandas()
    if not len(sample):
        sample = base.select("v").limit(train).toPandas()
    leaves = max(1, min(round(total / p.leaf_rows), len(sample) // 4))
    tree = fit_tree(np.stack(sample["v"].to_list()), leaves, p)
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.ascontiguousarray(np.stack(b["v"].to_list()), dtype=np.float64) + 0.0
            yield pd.DataFrame({"vec_id": b["vec_id"], "q": b["q"], "key": [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], "leaf": shared.value.assign(x).astype(np.int32), "vec": [r.tobytes() for r in x]})

    routed = materialize(base.mapInPandas(route, "vec_id long, q boolean, key binary, leaf int, vec binary"), "ann-routed")

    # Equal vectors: one entry with the k + 1 smallest ids, kept through a salted top-k first.
    ids = routed.select("key", "vec_id").distinct()
    salted = Window.partitionBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy("vec_id")
    ids = ids.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k1)
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k1)
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = routed.groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("vec").alias("vec"), F.max("q").alias("q"), F.count("*").alias("n")).join(ids, "key")
    entries = materialize(entries, "ann-entries")

    visits = _calibrate(entries, by_hash(routed.select("vec_id", "vec").dropDuplicates(["vec"]), p.calibration_queries, total, 1), tree, dim, p)
    group_of, groups = _groups(entries, tree, dim, p)
    grouping = spark.sparkContext.broadcast(group_of)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every entry for its leaf's group, or one of the group's parts if its leaves alone are too large for one."""
        for b in batches:
            first, parts = (x[b["leaf"].to_numpy()] for x in grouping.value)
            part = np.array([int.from_bytes(k[:8], "little") for k in b["key"]], dtype=np.uint64) % parts.astype(np.uint64)
            yield pd.DataFrame({"grp": first + part.astype(np.int32), "kind": np.zeros(len(b), dtype=np.int8), "key": None, "vec": b["vec"], "leaves": [[x] for x in b["leaf"]], "ids": b["ids"]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, parts = grouping.value
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for key, vec in zip(b["key"].iloc[at : at + 256], b["vec"].iloc[at : at + 256], strict=True):
                    seen = np.array(shared.value.best_first(np.frombuffer(vec), visits), dtype=np.int32)
                    own = first[seen]
                    for g in np.unique(own):
                        mine = seen[own == g]
                        rows += [(g + k, 1, key, vec, mine, None) for k in range(int(parts[mine[0]]))]
                yield pd.DataFrame(rows, columns=["grp", "kind", "key", "vec", "leaves", "ids"])

    kinds = "grp int, kind byte, key binary, vec binary, leaves array<int>, ids array<long>"
    held = entries.select("key", "leaf", "vec", "ids").mapInPandas(gather, kinds)
    asking = entries.where("q").select("key", "vec").mapInPandas(probe, kinds)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, new, block = None, [], None
        for b in batches:
            for (g, kind), rows in b.groupby(["grp", "kind"], sort=True):
                if g != group:
                    group, new, block = g, [], None
                if kind == 0:
                    new.append(rows[["vec", "leaves", "ids"]])
                    continue
                if block is None and new:
                    block, new = _Block.of(pd.concat(new), dim), []
                if block is not None:
                    step = max(1, min(256, _SCORES // max(1, len(block.x))))
                    for at in range(0, len(rows), step):
                        yield block.best(rows.iloc[at : at + step], k1)

    found = held.union(asking).repartition(max(groups, partitions(spark)), "grp").sortWithinPartitions("grp", "kind")
    found = found.mapInPandas(score, "key binary, scores array<double>, ids array<long>")
    # A query meets a bounded number of groups, with k + 1 neighbours each.
    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i")))
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k1)
    lists = materialize(found.groupBy("key").agg(best.alias("best")), "ann-found")
    # A key with very many copies answers as many queries: its list is dealt over 64 places.
    hot = entries.where(F.col("q") & (F.col("n") > p.hot_rows)).select("key", F.lit(True).alias("hot"))
    places = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    lists = lists.join(hot, "key", "left").withColumn("place", F.explode(places))
    asked = routed.where("q").select(F.col("vec_id").alias("query_id"), "key").distinct().join(hot, "key", "left")
    asked = asked.withColumn("place", F.when(F.col("hot"), F.pmod(F.xxhash64("query_id"), F.lit(64)).cast("int")).otherwise(F.lit(0)))
    out = asked.select("query_id", "key", "place").join(lists.select("key", "place", "best"), ["key", "place"])
    own = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, p.k)
    out = out.select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _groups(entries: DataFrame, tree: Tree, dim: int, p: AnnParams) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """``((first group, parts) by leaf, number of groups)``: neighbouring leaves share a group, a hot leaf has several parts."""
    spark = entries.sparkSession
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for r in entries.groupBy("leaf").count().collect():  # at most one row a leaf of the bounded tree
        sizes[r["leaf"]] = r["count"]
    most = max(1, p.group_bytes // (8 * dim + 8 * (p.k + 1)))
    width = max(1, min(most, -(-int(sizes.sum()) // partitions(spark))))
    first, parts = np.zeros(tree.leaves, dtype=np.int32), np.ones(tree.leaves, dtype=np.int32)
    group, filled = 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if filled and filled + n > width:
            group, filled = group + 1, 0
        first[leaf] = group
        filled += n
        if n > most:
            parts[leaf] = -(-n // most)
            group, filled = group + int(parts[leaf]), 0
    return (first, parts), group + 1


#: Scores held at once: 64 MB of doubles.
_SCORES = 8 << 20
#: Of a visited entry whose score is no number or minus infinity.
_LEAST = np.finfo(np.float64).min


@dataclass
class _Block:
    """The entries of a group, in the order of their leaves."""

    x: np.ndarray
    leaf: np.ndarray
    ids: list[np.ndarray]
    least: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, dim: int) -> _Block:
        leaf = np.array([v[0] for v in rows["leaves"]], dtype=np.int32)
        order = np.argsort(leaf, kind="stable")
        x = np.frombuffer(b"".join(rows["vec"])).reshape(-1, dim)[order]
        ids = [rows["ids"].iloc[i] for i in order]
        return cls(x, leaf[order], ids, np.array([i[0] for i in ids], dtype=np.int64))

    def best(self, asked: pd.DataFrame, k1: int) -> pd.DataFrame:
        """``key, scores, ids``: each query's ``k1`` best ids among the leaves it visits, ties to smaller ids."""
        qs = np.frombuffer(b"".join(asked["vec"])).reshape(len(asked), -1)
        near = np.full((len(qs), len(self.x)), -np.inf)
        visits = np.repeat(np.arange(len(qs)), [len(v) for v in asked["leaves"]])
        leaves = np.concatenate(asked["leaves"].to_list())
        order = np.argsort(leaves, kind="stable")
        kinds, at = np.unique(leaves[order], return_index=True)
        ends = [*at[1:].tolist(), len(order)]
        for leaf, a, b in zip(kinds.tolist(), at.tolist(), ends, strict=True):
            lo, hi = np.searchsorted(self.leaf, [leaf, leaf + 1])
            if lo < hi:
                rows = visits[order[a:b]]
                with np.errstate(over="ignore", invalid="ignore"):
                    found = qs[rows] @ self.x[lo:hi].T
                near[rows, lo:hi] = np.where(found > -np.inf, found, _LEAST)  # also of sums that have no order
        last = np.partition(near, -k1, axis=1)[:, -k1] if near.shape[1] > k1 else np.full(len(qs), -np.inf)
        # rounding: a matrix product may differ from the exact sum by far less than this
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * (np.abs(qs).sum(1) * np.abs(self.x).max() + 1e-300)
            least = np.where(last == np.inf, np.inf, last - slack)  # infinite scores tie
        row, col = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.einsum("ij,ij->i", self.x[col], qs[row])
        exact = np.where(exact > -np.inf, exact, -np.inf)
        order = np.lexsort((self.least[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        starts = np.searchsorted(row, np.arange(len(qs)))
        keep = np.arange(len(row)) - starts[row] < k1  # the best k1 ids are among the best k1 entries
        row, col, exact = row[keep], col[keep], exact[keep]
        each = [self.ids[c] for c in col.tolist()]
        count = [len(i) for i in each]
        row, exact = np.repeat(row, count), np.repeat(exact, count)
        ids = np.concatenate(each) if each else np.empty(0, dtype=np.int64)
        order = np.lexsort((ids, -exact, row))
        row, exact, ids = row[order], exact[order], ids[order]
        starts = np.searchsorted(row, np.arange(len(qs) + 1))
        cuts = [(a, min(b, a + k1)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return pd.DataFrame({"key": asked["key"].to_list(), "scores": [exact[a:b] for a, b in cuts], "ids": [ids[a:b] for a, b in cuts]})


def _calibrate(entries: DataFrame, queries: DataFrame, tree: Tree, dim: int, p: AnnParams) -> int:
    """How many leaves to visit so that the calibration queries reach the target recall.

    The calibration queries are a bounded set; they meet every entry of the table, in blocks,
    so that their true neighbours are known.  Only (query, neighbour's leaf) comes back.
    """
    asked = [np.frombuffer(r["vec"]) for r in queries.select("vec").limit(2 * p.calibration_queries).collect()]
    if not asked or tree.leaves == 1:
        return max(1, tree.leaves)
    qs = np.stack(asked)
    shared = entries.sparkSession.sparkContext.broadcast(qs)
    own = {q.tobytes(): i for i, q in enumerate(qs)}
    k = p.k

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_s, best_l = np.empty((len(shared.value), 0)), np.empty((len(shared.value), 0), dtype=np.int32)
        for b in batches:
            if not len(b):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                near = shared.value @ np.frombuffer(b"".join(b["vec"])).reshape(-1, dim).T
            near = np.where(near > -np.inf, near, _LEAST)
            for j, vec in enumerate(b["vec"]):
                if (i := own.get(bytes(vec))) is not None:
                    near[i, j] = -np.inf  # a vector is not its own neighbour
            best_s = np.hstack([best_s, near])
            best_l = np.hstack([best_l, np.broadcast_to(b["leaf"].to_numpy(dtype=np.int32), near.shape)])
            if best_s.shape[1] > k:
                keep = np.argpartition(-best_s, k - 1, axis=1)[:, :k]
                best_s, best_l = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_l, keep, 1)
        n = best_s.shape[1]
        if n:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(best_s)), n).astype(np.int32), "leaf": best_l.ravel(), "s": best_s.ravel()})

    near = entries.select("leaf", "vec").mapInPandas(brute, "i int, leaf int, s double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "leaf"))).where(F.col("r") <= k).select("i", "leaf").toPandas()
    orders = {i: {leaf: at for at, leaf in enumerate(tree.best_first(qs[i], tree.leaves))} for i in near["i"].unique()}
    needed = np.sort([orders[i][leaf] + 1 for i, leaf in zip(near["i"], near["leaf"], strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(p.target_recall * len(needed))) - 1)])
