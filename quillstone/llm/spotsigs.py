"""SpotSigs document fingerprints.

A spot signature is an anchor (a common word of the language) together with the chain of the
next ``chain`` content words, taken ``distance`` content words apart.  The fingerprint of a text
is the set of its signatures, each as a 40-bit hash.  Chains are made of content words only, so
navigation scraps without sentences leave hardly any signature.  Likeness is the Jaccard
similarity of two signature sets.

* :func:`signatures` gives the set of a text, :func:`fingerprint` its text form.
* :func:`fingerprint_edits` fingerprints every text and its edited text.
* :func:`similar_pairs` is the self-join: texts with equal sets are one class; classes are
  dealt to partitions by set length, so that sets whose lengths alone rule the threshold out
  never meet, then meet on the rarest signatures (prefix filter) and are compared with
  pruned Jaccard.

Edge cases: a null text is the empty text; the empty text has the empty set and two empty sets
have likeness 1; a text without any anchor uses each of its words as an anchor, so every text
with a word has a signature; equal texts have equal fingerprints.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Common words of English, German, French and Spanish; they anchor the chains.
ANCHORS = frozenset(
    """a an and are as at be been but by can do for from had has have he her his if in into is it its
    not of on or she so that the their there they this to was we were what when which who will with you
    aber als am auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es
    für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so um und uns von vor war wenn wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou où par
    pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con cual de del e el ella ellos en entre era es ese esta este fue ha hay la las le lo los más me mi
    muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya""".split()
)
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class SpotSigsParams:
    chain: int = 2
    distance: int = 1
    threshold: float = 0.8


def signatures(text: str, p: SpotSigsParams = SpotSigsParams()) -> np.ndarray:
    """The sorted distinct 40-bit signature hashes of ``text``."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, dtype=np.int64)
    common = ANCHORS
    content = [w for w in words if w not in common]
    found = set()
    if len(content) == len(words):  # no anchor at all: every word is one
        for i in range(len(words)):
            found.add(" ".join(words[i : i + 1 + p.chain * p.distance : p.distance]))
    else:
        at, span, step = 0, p.chain * p.distance, p.distance
        for w in words:
            if w in common:
                found.add(w + "\x1f" + " ".join(content[at : at + span : step]))
            else:
                at += 1
    packed = np.fromiter((crc32(b := s.encode()) << 8 | (len(b) * 31 + b[-1] * 7 + b[0]) & 255 for s in found), dtype=np.int64, count=len(found))
    return np.unique(packed)


def fingerprint(sigs: np.ndarray) -> str:
    """A signature set as text: base64 of its sorted 40-bit big-endian values, after its length."""
    five = sigs.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return f"{len(sigs)}:{base64.b64encode(five.tobytes()).decode()}"


def parse(text: str) -> np.ndarray:
    """The signature set of a fingerprint."""
    five = np.frombuffer(base64.b64decode(text.partition(":")[2]), dtype=np.uint8).reshape(-1, 5)
    whole = np.zeros((len(five), 8), dtype=np.uint8)
    whole[:, 3:] = five
    return whole.reshape(-1).view(">i8").astype(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0.0 as soon as the lengths rule ``at_least`` out."""
    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if small < at_least * large:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


#: Rows without an id are dealt to so many slices of their text hash.
_SLICES = 64


def _buckets(docs: DataFrame, rows: int) -> tuple[np.ndarray, list[tuple[int, int | None, int, int]]]:
    """Cut points of ``doc_id``, and each bucket's ``(number, greatest id, greatest hash, bucket before it)`` of ``docs(doc_id, th)``.

    One row a bucket comes to the driver: at most 20,000 and the slices of rows without an id.
    Buckets are streamed, so more rows than ``rows`` in one cost time, not memory.
    """
    n = docs.count()
    cuts = max(1, min(20_000, n // rows))
    share = [i / cuts for i in range(1, cuts)]
    points = docs.agg(F.percentile_approx("doc_id", share, 100 * cuts).alias("p")).first()["p"] if share else []
    points = np.unique(np.array(points or [], dtype=np.int64))
    heads = docs.groupBy(_bucket(points).alias("b")).agg(F.max("doc_id").alias("m"), F.max("th").alias("h")).collect()
    heads.sort(key=lambda r: -r["b"])
    return points, [(r["b"], r["m"], r["h"], heads[i - 1]["b"]) for i, r in enumerate(heads)]


def _bucket(points: np.ndarray) -> Column:
    """How many of the sorted points are below ``doc_id``, by bisection; rows without an id come after all, by slices of ``th``."""

    @F.pandas_udf("int")
    def below(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, ids.to_numpy(dtype=np.int64)).astype(np.int32))

    part = F.shiftrightunsigned(F.col("th").bitwiseXOR(F.lit(-(1 << 63))), 58).cast("int")  # in the order of the hashes
    return F.when(F.col("doc_id").isNull(), part - _SLICES).otherwise(below(F.coalesce("doc_id", F.lit(0))))


def fingerprint_edits(docs: DataFrame, p: SpotSigsParams = SpotSigsParams(), bucket_rows: int = 1_000) -> DataFrame:
    """Fingerprint every text and the same text with its last third replaced by the next one's start.

    Next: descending doc_id, after the last the first; rows without doc_id follow all others, the
    greater text hash first; among rows of one doc_id the greater text comes first.  Texts move once: they are dealt by
    ranges of doc_id, and the head of each range also goes to the range before it, where it
    follows the last row.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    points, heads = _buckets(base.select("doc_id", "th"), bucket_rows)
    if not heads:
        return spark.createDataFrame([], _EDITS)
    base = base.withColumn("b", _bucket(points))
    # The head rows: those whose id (or hash, where there is no id) is the greatest of their range; one row a range.
    links = spark.createDataFrame(heads, "hb int, head long, head_th long, into int")
    own = (F.col("b") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("doc_id").isNotNull() | (F.col("th") == F.col("head_th")))
    rows = base.join(F.broadcast(links), own, "left")
    both = F.array(F.struct(F.col("b"), F.lit(0).alias("extra")), F.struct(F.col("into").alias("b"), F.lit(1).alias("extra")))
    rows = rows.select("doc_id", "text", "th", F.explode(F.when(F.col("into").isNotNull(), both).otherwise(F.slice(both, 1, 1))).alias("to")).select("doc_id", "text", "th", "to.b", "to.extra")
    by_hash = F.when(F.col("doc_id").isNull(), F.col("th"))
    rows = rows.repartition(partitions(spark), "b").sortWithinPartitions("b", "extra", F.desc_nulls_last("doc_id"), by_hash.desc(), F.desc("text")).drop("th")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        last = None  # (bucket, doc_id, text, signatures) that waits for the next text
        closed = None  # the bucket whose helper row was used

        def close(text: str, sigs: np.ndarray) -> None:
            _, doc_id, own_text, own_sigs = last
            n = len(own_text)
            cut = n // 3
            edited = own_text[: n - cut] + text[:cut]
            new = signatures(edited, p)
            out.append((doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own_sigs), fingerprint(new), jaccard(own_sigs, new), jaccard(own_sigs, sigs)))

        for batch in batches:
            for doc_id, text, b, extra in zip(batch["doc_id"], batch["text"], batch["b"], batch["extra"], strict=True):
                if extra:
                    if closed != b and last is not None:
                        close(text, signatures(text, p))
                        closed, last = b, None
                    continue
                sigs = signatures(text, p)
                if last is not None:
                    close(text, sigs)
                last = (b, None if pd.isna(doc_id) else int(doc_id), text, sigs)
                if len(out) >= 256:
                    yield pd.DataFrame(out, columns=_NAMES)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return rows.mapInPandas(run, _EDITS)


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _EDITS.split(", ")]


def similar_pairs(docs: DataFrame, p: SpotSigsParams = SpotSigsParams()) -> DataFrame:
    """Classes of equal signature sets and the pairs of classes at or above the threshold.

    Returns ``class_a, class_b`` (least doc_id of each class, a < b) and ``likeness``; class
    membership is :func:`classes`.  Empty sets take no part.
    """
    sets = materialize(classes(docs, p).groupBy("sigs").agg(F.min("doc_id").alias("c")), "spotsigs")
    sets = sets.where(F.size("sigs") > 0)
    # Prefix filter: pairs at the threshold share one of each set's first n - ceil(t n) + 1 rarest signatures.
    each = sets.select("c", F.explode("sigs").alias("s"))
    freq = each.groupBy("s").count().where("count > 1")
    ranked = each.join(freq, "s").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("r"))
    ranked = sets.join(ranked, "c").withColumn("n", F.size("sigs"))
    lead = F.col("n") - F.ceil(F.lit(p.threshold) * F.col("n")) + 1 - (F.col("n") - F.size("r"))
    # Signatures of one set only are the rarest; they use up the prefix first.
    keyed = ranked.select("c", "n", "sigs", F.explode(F.slice("r", 1, F.greatest(lead, F.lit(0)).cast("int"))).alias("k")).select("c", "n", "sigs", "k.s")
    part = F.floor(F.log("n") / F.log(F.lit(1 / p.threshold))).cast("int")
    left = keyed.select(F.col("c").alias("ca"), F.col("n").alias("na"), F.col("sigs").alias("sa"), "s", part.alias("part"))
    right = keyed.select(F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("sigs").alias("sb"), "s", F.explode(F.array(part, part + 1, part - 1)).alias("part"))
    near = (F.col("nb") >= p.threshold * F.col("na")) & (F.col("na") >= p.threshold * F.col("nb"))
    pairs = left.join(right, ["s", "part"]).where((F.col("ca") < F.col("cb")) & near)
    common = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.select("ca", "cb", (common / (F.col("na") + F.col("nb") - common)).alias("likeness")).where(F.col("likeness") >= p.threshold)
    return pairs.groupBy(F.col("ca").alias("class_a"), F.col("cb").alias("class_b")).agg(F.first("likeness").alias("likeness"))


def classes(docs: DataFrame, p: SpotSigsParams = SpotSigsParams()) -> DataFrame:
    """``doc_id, sigs`` (sorted) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "sigs": [signatures(t, p) for t in b["text"]]})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return base.mapInPandas(run, "doc_id long, sigs array<long>")
