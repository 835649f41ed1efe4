"""Mixing sources to target weights by Sainte-Lague apportionment.

1. A document's size is its number of words (runs without ASCII white space).
2. Targets: the sources, in code point order with null last, share all words by weight; a target
   stops at ``most`` times its source's size and the excess is shared again by weight.
3. A source whose target exceeds its size is taken whole as often as it fits; the rest of all targets
   is apportioned in words by Sainte-Lague (highest quotients), so each source has a whole number of
   them, and each source's words go to its shards the same way.  Shards are hash-dealt parts of a
   source of at most about ``shard`` words, so a source of any size is many tasks.
4. A shard's quota is as many whole blocks of ``block`` words as fit, and the beginning of one more for
   what is left, so sources of any size meet their targets to the word.  In a shard the documents lie one after the other, in seeded order, and are cut into blocks;
   the blocks are taken in a seeded order (a permutation by a stride without common factor), so
   whether a block is taken is a formula, not a join.

Sources and shards are tables on the driver: at most ``max_sources`` rows (more is an error, never
a cut) and ``max_shards`` shards besides one per source; sizes are summed on the map side first.

Edge cases: a null text has size 0 and is never taken; a table without words gives all targets 0;
repeated rows are documents of their own, each counted and taken; rows without doc_id too.  Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, local_rows, materialize

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    block: int = 256
    shard: int = 1_000_000
    max_sources: int = 1_000_000
    max_shards: int = 100_000
    seed: int = 2026


def targets(sizes: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Shares of ``sum(sizes)`` by weight, none above ``most * size``; the excess is shared again."""
    sizes, weights = sizes.astype(np.float64), weights.astype(np.float64)
    out, cap = np.zeros(len(sizes)), most * sizes
    total = sizes.sum()
    if not total:
        return out
    # Raise one level for all until each stops at its cap: the order in which they stop is known.
    stops = cap / weights
    order = np.argsort(stops, kind="stable")
    left, weight = total, weights.sum()
    for at, i in enumerate(order):
        if stops[i] * weight >= left:
            rest = order[at:]
            out[rest] = left * weights[rest] / weight
            break
        out[i] = cap[i]
        left -= cap[i]
        weight -= weights[i]
    return np.minimum(out, cap)


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Whole seats by highest quotients ``votes / (2 k + 1)``, at most ``most`` each; ties to the earlier one.

    The last quotient that gets a seat is found by bisection; what remains is dealt one by one.
    """
    votes = np.asarray(votes, dtype=np.float64)
    most = np.where(votes > 0, most, 0)
    if seats >= most.sum():
        return most.astype(np.int64)
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)

    def given(q: float) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.minimum(np.floor(votes / q / 2 + 0.5), most).astype(np.int64)

    low, high = 0.0, float(votes.max()) * 1.0000001
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    while (missing := seats - int(out.sum())) > 0:
        open_ = out < most
        quotient = np.where(open_, votes / (2 * out + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[: min(missing, int(open_.sum()))]
        best = best[quotient[best] >= quotient[best[0]] * (1 - 1e-12)]
        out[best] += 1
    return out


def size_of(text: Column) -> Column:
    """The number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _mix64(*parts: int) -> int:
    return crc32(repr(parts).encode()) << 16 ^ crc32(repr(parts[::-1]).encode())


def place(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Every row of ``docs(doc_id, text, source)`` with its size, target and place in its shard.

    Adds size, source_size, target, full (how often it is taken whole), start (words of its shard
    before it), quota, blocks, stride, first, extra: block j of the shard is taken once more if
    ``(j * stride + first) mod blocks < quota``, and its first ``extra`` words if the two are equal.  Keeps
    text_hash to find the row again.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    base = materialize(base, "mix-sizes")
    rows = base.groupBy("source").agg(F.sum("size").alias("size")).limit(p.max_sources + 1).collect()
    if len(rows) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources; raise max_sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = np.array([r["size"] for r in rows], dtype=np.int64)
    weights = np.array([p.weights[i % len(p.weights)] for i in range(len(rows))])
    target = targets(sizes, weights, p.most)
    full = np.minimum(np.floor(target / np.maximum(sizes, 1) + 1e-12), p.most).astype(np.int64)
    rest = np.maximum(target - full * sizes, 0.0)
    width = max(p.shard, int(sizes.sum()) // p.max_shards)
    shards = np.maximum(1, -(-sizes // width))
    kind = "sid int, source string, shards int, source_size long, target double, full int"
    sources = pd.DataFrame({"sid": np.arange(len(rows), dtype=np.int32), "source": [r["source"] for r in rows], "shards": shards.astype(np.int32), "source_size": sizes, "target": target, "full": full.astype(np.int32)})
    sources = local_rows(spark, [tuple(x) for x in sources.itertuples(index=False)], kind)
    keyed = base.join(F.broadcast(sources), base["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(p.seed)), F.col("shards")).cast("int"))

    per = keyed.groupBy("sid", "shard").agg(F.sum("size").alias("size")).orderBy("sid", "shard").collect()  # at most one row a shard
    sid = np.array([r["sid"] for r in per], dtype=np.int64)
    own = np.array([r["size"] for r in per], dtype=np.int64)
    blocks = -(-own // p.block)
    quota = np.zeros(len(per), dtype=np.int64)
    seats = sainte_lague(rest, int(round(rest.sum())), np.ceil(rest).astype(np.int64))
    for s in range(len(rows)):
        at = np.nonzero(sid == s)[0] if len(rows) < 1000 else np.arange(np.searchsorted(sid, s), np.searchsorted(sid, s, side="right"))
        quota[at] = sainte_lague(own[at], int(seats[s]), own[at])  # in words
    strides = []
    for s, r, n, words, size in zip(sid.tolist(), (x["shard"] for x in per), blocks.tolist(), quota.tolist(), own.tolist(), strict=True):
        step = _mix64(p.seed, s, r, 1) % max(n, 1) or 1
        while gcd(step, max(n, 1)) != 1:
            step += 1
        strides.append((s, r, n, *_whole(words, size, n, step, (at := _mix64(p.seed, s, r, 2) % max(n, 1)), p.block), step, at))
    table = local_rows(spark, strides, "sid int, shard int, blocks long, quota long, extra long, stride long, first long")
    order = Window.partitionBy("sid", "shard").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(p.seed + 1)), "doc_id", "text_hash")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("start", start).join(F.broadcast(table), ["sid", "shard"])
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", "full", "start", "quota", "blocks", "stride", "first", "extra")


def _whole(words: int, size: int, blocks: int, stride: int, first: int, block: int) -> tuple[int, int]:
    """``(quota, extra)``: whole blocks, in the order in which they are taken, and words of the next one that make ``words``.

    All blocks have ``block`` words but the shard's last one.
    """
    if words >= size:
        return blocks, 0
    short = blocks * block - size  # words that the last block lacks
    when = ((blocks - 1) * stride + first) % blocks if blocks else 0
    quota = words // block
    if when <= quota:  # the last block is taken before what is left, or is it
        quota = max(when, (words + short) // block)
    return quota, words - quota * block + (short if when < quota else 0)


def _taken(block: int) -> Column:
    """Words of the document that lie in taken blocks of its shard."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    some = (F.col("size") > 0) & (F.col("quota") + F.col("extra") > 0)

    def overlap(total: Column, j: Column) -> Column:
        turn = F.pmod(j * F.col("stride") + F.col("first"), F.col("blocks"))
        until = F.when(turn < F.col("quota"), (j + 1) * block).when(turn == F.col("quota"), j * block + F.col("extra")).otherwise(F.lit(0))
        return total + F.greatest(F.lit(0).cast("long"), F.least(until, F.col("start") + F.col("size")) - F.greatest(j * block, F.col("start")))

    every = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), overlap)
    return F.when(some, F.when(F.col("quota") >= F.col("blocks"), F.col("size")).otherwise(every)).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, taken`` of every row of ``docs``."""
    taken = F.col("full") * F.col("size") + _taken(p.block)
    return place(docs, p).select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken whole, and once
    more with the runs of its words that lie in taken blocks (joined by a line feed), if there are any.

    ``n_chars`` is set to the new text's length where ``docs`` has it.  Texts without words are never taken.
    """
    names = docs.columns
    own = ["doc_id", "text_hash", "full", "words", "start", "size", "quota", "blocks", "stride", "first", "extra", "nth", "source"]
    new = dict(zip(own, fresh(docs, *[f"mix_{c}" for c in own]), strict=True))
    row_hash, row_nth, row_salt = fresh(docs, "mix_row_hash", "mix_row_nth", "mix_row_salt")
    places = place(docs, p).withColumn("words", _taken(p.block))
    # Rows of one doc_id, text and source are alike in all that was placed but their start: both sides number them,
    # before any is left out.  Only where such a row is repeated there is more than one number.
    places = places.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash", "source").orderBy("start")))
    places = places.where("size > 0 and (full > 0 or words > 0)").select(*[F.col(c).alias(n) for c, n in new.items()])
    places = materialize(places, "mix-places")
    rows = docs.withColumn(row_hash, F.xxhash64("text"))
    rows = rows.withColumn(row_nth, F.row_number().over(Window.partitionBy("doc_id", row_hash, "source").orderBy(F.lit(0))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(new["doc_id"])) & (F.col(row_hash) == F.col(new["text_hash"])) & F.col("source").cast("string").eqNullSafe(F.col(new["source"]))
    met = rows.join(places, same & (F.col(row_nth) == F.col(new["nth"])))
    used = own[2:11]
    at_chars = names.index("n_chars") if "n_chars" in names else None

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked, texts, held = [], [], 0
            columns = [b.column(new[c]).to_pylist() for c in used]
            for i, (full, words, start, size, quota, blocks, stride, first, extra) in enumerate(zip(*columns, strict=True)):
                text = b.column("text")[i].as_py() or ""
                times = full + (words == size and size > 0)
                picked += [i] * times
                texts += [text] * times
                held += len(text) * times
                if words and words != size:
                    picked.append(i)
                    texts.append(runs(text, start, quota, blocks, stride, first, extra, p.block))
                    held += len(texts[-1])
                if held > 4 << 20:  # few texts at a time are Python strings
                    yield mixed(b, picked, texts)
                    picked, texts, held = [], [], 0
            if picked:
                yield mixed(b, picked, texts)

    def mixed(b: pa.RecordBatch, picked: list[int], texts: list[str]) -> pa.RecordBatch:
        at = pa.array(picked, type=pa.int64())
        out = [pa.array(texts, type=b.schema.field(c).type) if c == "text" else b.column(c).take(at) for c in names]
        if at_chars is not None:
            out[at_chars] = pa.array([len(t) for t in texts], type=b.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(out, names=names)

    return met.select(*names, *[new[x] for x in used]).mapInArrow(expand, docs.schema)


def runs(text: str, start: int, quota: int, blocks: int, stride: int, first: int, extra: int, block: int) -> str:
    """The slices of ``text`` whose words lie in taken blocks."""
    out, open_at, end = [], None, 0
    for n, m in enumerate(_WORD.finditer(text)):
        turn = ((start + n) // block * stride + first) % blocks
        if turn < quota or turn == quota and (start + n) % block < extra:
            if open_at is None:
                open_at = m.start()
            end = m.end()
        elif open_at is not None:
            out.append(text[open_at:end])
            open_at = None
    if open_at is not None:
        out.append(text[open_at:end])
    return "\n".join(out)
