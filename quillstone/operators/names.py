"""Person names to stable identifiers: exact groups, cautious fuzzy links, components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..functions.text import sequence_ratio
from .ranking import sorted_places


def numbered(keys: DataFrame, key: str, out: str, pattern: str) -> DataFrame:
    """Consecutive ids of the distinct non-blank keys in their order.

    Numbered by sampled ranges of the whole order, see :func:`sorted_places`; no step groups by a part of the key.
    """
    distinct = keys.select(key).where(F.coalesce(F.col(key), F.lit("")) != "").distinct()
    return sorted_places(distinct, [key], "_place").select(key, F.format_string(pattern, "_place").alias(out))


def exact_groups(df: DataFrame, key: str, out: str = "exact_id") -> DataFrame:
    """Rows of one name key share an id; blank keys have none."""
    return df.join(numbered(df, key, out, "AEX%06d"), key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def prefix_pairs(names: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of first names in a last-name block of which one begins with the other; ``names(key, first, last)``.

    Every name meets the names that equal one of its proper beginnings, so no pair is made that isn't one; equal names are none.
    """
    length = F.length("first")
    beginnings = names.where(length > least).select(F.col("key").alias("long_key"), "last", F.explode(F.transform(F.sequence(F.lit(least), length - 1), lambda n: F.substring("first", F.lit(1), n))).alias("first"))
    shorter = names.where(length >= least).select("last", "first", F.col("key").alias("short_key"))
    pairs = beginnings.join(shorter, ["last", "first"]).where("short_key <> long_key")
    return pairs.select(F.least("short_key", "long_key").alias("key_a"), F.greatest("short_key", "long_key").alias("key_b"), F.lit("prefix").alias("reason"))


def initial_pairs(names: DataFrame) -> DataFrame:
    """An initial and the only full first name of its block that begins with it."""
    full = names.where(F.length("first") > 1).select("last", F.substring("first", 1, 1).alias("i"), F.col("key").alias("full_key"))
    only = full.groupBy("last", "i").agg(F.count("*").alias("n"), F.min("full_key").alias("full_key")).where("n = 1")
    single = names.where(F.length("first") == 1).select("last", F.col("first").alias("i"), "key")
    met = single.join(only, ["last", "i"])
    return met.select(F.least("key", "full_key").alias("key_a"), F.greatest("key", "full_key").alias("key_b"), F.lit("unique initial").alias("reason"))


def similar_pairs(names: DataFrame, least: float = 0.92, letters: int = 4) -> DataFrame:
    """Pairs in a last-name block whose first names differ, begin with the same letter, have at least ``letters`` each
    and are that similar, compared in the order of their keys.

    The ratio is twice the number of matched letters over both lengths, so a pair of lengths ``m <= n`` must have
    ``ceil(least * (m + n) / 2)`` letters in common, in order, and may leave out ``k`` on both sides together.  The shorter
    name is cut into ``k + 1`` parts, of which one at least stands whole in the longer name, no further from its place than
    the letters left out allow.  So names meet on (last name, letter, both lengths, part), which splits a block of any size,
    and only names that share a part are compared.  ``least`` above 2/3 keeps every part non-empty.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError(f"least has to be above 2/3 and at most 1, not {least}")
    if names.schema["first"].dataType.simpleString() != "string":
        raise ValueError("first names have to be strings")
    size = F.length("first")
    rows = names.where(size >= letters).select("key", "last", "first", F.substring("first", 1, 1).alias("initial"), size.alias("n"))
    slack = 1e-9  # of a product that should be whole

    def left_out(m: Column, n: Column) -> Column:
        return (m + n - 2 * F.ceil(F.lit(least) * (m + n) / 2 - slack)).cast("int")

    def start(i: Column, m: Column, k: Column) -> Column:
        return F.floor(i * m / (k + 1)).cast("int")

    shorter = rows.select("key", "last", "first", "initial", F.col("n").alias("short"))
    longest = F.floor(F.col("short") * (2 - least) / least + slack).cast("int")
    shorter = shorter.select("*", F.explode(F.sequence(F.col("short"), longest)).alias("long")).withColumn("k", left_out(F.col("short"), F.col("long"))).where("k > 0 and k >= long - short")
    shorter = shorter.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("part"))
    own = start(F.col("part"), F.col("short"), F.col("k"))
    shorter = shorter.select("key", "first", "last", "initial", "short", "long", "part", F.substring("first", own + 1, start(F.col("part") + 1, F.col("short"), F.col("k")) - own).alias("text"))

    longer = rows.select("key", "last", "first", "initial", F.col("n").alias("long"))
    shortest = F.greatest(F.lit(letters), F.ceil(F.col("long") * least / (2 - least) - slack).cast("int"))
    longer = longer.select("*", F.explode(F.sequence(F.least(shortest, F.col("long")), F.col("long"))).alias("short")).withColumn("k", left_out(F.col("short"), F.col("long"))).where("k > 0 and k >= long - short")
    longer = longer.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("part"))
    own = start(F.col("part"), F.col("short"), F.col("k"))
    width = start(F.col("part") + 1, F.col("short"), F.col("k")) - own
    gap = F.col("long") - F.col("short")
    low, high = F.greatest(F.lit(0), own - F.floor((F.col("k") - gap) / 2)), F.least(F.col("long") - width, own + F.floor((F.col("k") + gap) / 2))
    places = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    longer = longer.select("key", "first", "last", "initial", "short", "long", "part", F.explode(F.array_distinct(F.transform(places, lambda p: F.substring("first", p + 1, width)))).alias("text"))

    a, b = (d.select("last", "initial", "short", "long", "part", "text", F.col("key").alias(f"key_{x}"), F.col("first").alias(f"first_{x}")) for d, x in ((shorter, "s"), (longer, "l")))
    met = a.join(b, ["last", "initial", "short", "long", "part", "text"]).where("key_s <> key_l and first_s <> first_l")
    ahead = F.col("key_s") < F.col("key_l")
    sides = {"key_a": F.when(ahead, F.col("key_s")).otherwise(F.col("key_l")), "key_b": F.when(ahead, F.col("key_l")).otherwise(F.col("key_s")), "first_a": F.when(ahead, F.col("first_s")).otherwise(F.col("first_l")), "first_b": F.when(ahead, F.col("first_l")).otherwise(F.col("first_s"))}
    pairs = met.select(*[c.alias(n) for n, c in sides.items()]).distinct().withColumn("ratio", sequence_ratio("first_a", "first_b"))
    return pairs.where(F.col("ratio") >= least).select("key_a", "key_b", "ratio")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, component)``: the least node that edges ``(a, b)`` reach.

    Minimum labels travel along the edges and, by pointer jumping, along the labels, so a chain shortens by half a
    round; each round is a written table.  ``rounds`` that do not suffice are an error, never a partial result.
    """
    with Scratch(edges.sparkSession, "components") as scratch:
        both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
        both = scratch.write(both)
        keep = Scratch(edges.sparkSession, "labels")
        labels = keep.write(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
        for _ in range(rounds):
            near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
            step = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("m"))
            jump = labels.select(F.col("node").alias("j"), F.col("component").alias("jc"))
            new = step.join(jump, F.col("m") == F.col("j"), "left").select("node", "component", F.least("m", F.coalesce("jc", F.col("m"))).alias("m"))
            new = keep.write(new)
            labels = new.select("node", F.col("m").alias("component"))
            if new.where("m < component").isEmpty():
                out = keep.kept(labels)
                keep.drop()
                return out
            keep.drop(keep=1)
        keep.drop()
        raise RuntimeError(f"components did not settle in {rounds} rounds")


def greedy_overlap(left: DataFrame, right: DataFrame, group: str, least: float = 0.8) -> DataFrame:
    """Greedy one-to-one matches of ``left(group, l_id, l_name)`` and ``right(group, r_id, r_name)`` within a group.

    Overlap: longest common substring over the longer name.  Left rows in the order of their id take
    the best remaining right row (ties to the smaller id).  Groups are the authors of one paper, so
    each side of a group is an array in one row, and many groups are matched in one Arrow batch.
    """

    def overlap(x: str, y: str) -> float:
        best, row = 0, [0] * (len(y) + 1)
        for ch in x:
            above = 0
            for j, other in enumerate(y, 1):
                row[j], above = (above + 1 if ch == other else 0), row[j]
                best = max(best, row[j])
        return best / max(len(x), len(y), 1)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], float] = {}
        for batch in batches:
            out = []
            for lefts, rights in zip(batch["lefts"], batch["rights"], strict=True):
                free = [(r["id"], r["name"]) for r in rights]
                for row in lefts:
                    if not free:
                        break
                    scored = []
                    for r_id, name in free:
                        pair = (row["name"], name)
                        if pair not in known:
                            known[pair] = overlap(*pair)
                        scored.append((-known[pair], r_id))
                    score, r_id = min(scored)
                    if -score >= least:
                        out.append((row["id"], r_id, -score))
                        free = [x for x in free if x[0] != r_id]
            known = known if len(known) < 100_000 else {}
            yield pd.DataFrame(out, columns=["l_id", "r_id", "overlap"])

    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    a = left.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("l_id").alias("id"), F.coalesce("l_name", F.lit("")).alias("name")))).alias("lefts"))
    b = right.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("r_id").alias("id"), F.coalesce("r_name", F.lit("")).alias("name")))).alias("rights"))
    return a.join(b, group).select("lefts", "rights").mapInPandas(match, f"l_id {kinds['l_id']}, r_id {kinds['r_id']}, overlap double")


def manual_review(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows with at least one reason, and their reasons in order."""
    from ..functions.columns import ordered_reasons

    return df.withColumn("review_reasons", ordered_reasons(reasons)).where("review_reasons <> ''")

