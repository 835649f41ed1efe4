"""Record linkage: staged unique keys, two-pass outer joins, validated joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import assert_unique
from ..functions.columns import blank, first_nonblank, first_nonblank_source
from ..functions.scratch import Scratch
from .names import greedy_overlap


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose non-blank key occurs once.

    Counted by key, with the least value of every other column, which is a lone row's own: a key of many rows shrinks before
    it is moved.
    """
    others = [c for c in df.columns if c != key]
    once = df.where(~blank(F.col(key))).groupBy(key).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in others]).where("_n = 1")
    return once.select(*df.columns)


def staged_link(left: DataFrame, right: DataFrame, ids: tuple[str, str], stages: list[tuple[str, str, str]]) -> DataFrame:
    """Match rows stage by stage on keys that are unique on both remaining sides.

    ``stages``: (name, left key, right key).  Matched rows leave the pool; ambiguous keys stay for
    later stages.  Returns (left id, right id, strategy) for every row of both sides; unmatched
    rows have strategy ``left_only`` or ``right_only``.
    """
    a, b = ids
    kind_a, kind_b = left.schema[a].dataType, right.schema[b].dataType
    with Scratch(left.sparkSession, "link") as scratch:
        found: list[DataFrame] = []
        for name, key_l, key_r in stages:
            own = unique_keys(_unmatched(left, a, found).select(a, F.col(key_l).alias("_k")), "_k")
            other = unique_keys(_unmatched(right, b, found).select(b, F.col(key_r).alias("_k")), "_k")
            # written, so that a stage reads the matches before it and never plans them again
            found.append(scratch.write(own.join(other, "_k").select(a, b, F.lit(name).alias("strategy"))))
        left_only = _unmatched(left, a, found).select(a, F.lit(None).cast(kind_b).alias(b), F.lit("left_only").alias("strategy"))
        right_only = _unmatched(right, b, found).select(F.lit(None).cast(kind_a).alias(a), b, F.lit("right_only").alias("strategy"))
        return scratch.kept(reduce(DataFrame.unionByName, [*found, left_only, right_only]))


def _unmatched(rows: DataFrame, key: str, found: list[DataFrame]) -> DataFrame:
    """Rows whose ``key`` no stage has matched yet."""
    return rows.join(reduce(DataFrame.union, [f.select(key) for f in found]), key, "left_anti") if found else rows


def two_pass_outer(left: DataFrame, right: DataFrame, ids: tuple[str, str], first: list[str], second: list[str]) -> DataFrame:
    """All pairs equal on ``first``; what is left is joined on ``second`` and kept on both sides.

    Blank keys match each other; keys need not be unique.  A key that is heavy on both sides gives all its pairs:
    :func:`outer_classes` says the same in a row for each row.
    """
    a, b = ids
    pairs = left.select(a, *first).join(right.select(b, *first), first).select(a, b).distinct()
    rest_l, rest_r = left.join(pairs.select(a).distinct(), a, "left_anti"), right.join(pairs.select(b).distinct(), b, "left_anti")
    outer = rest_l.select(a, *second).join(rest_r.select(b, *second), second, "full").select(a, b)
    kind = F.when(F.col(a).isNull(), "right_only").when(F.col(b).isNull(), "left_only").otherwise("second_pass")
    return pairs.withColumn("strategy", F.lit("first_pass")).unionByName(outer.withColumn("strategy", kind))


def outer_classes(left: DataFrame, right: DataFrame, ids: tuple[str, str], first: list[str], second: list[str]) -> DataFrame:
    """The links of :func:`two_pass_outer` as classes: one row for each row of either side, however many partners it has.

    ``side`` (left or right), ``id``, ``strategy`` (first_pass, second_pass, left_only, right_only), ``class`` (the key as JSON; null
    without partners), ``n_left`` and ``n_right``: the members of the class on both sides, which are all linked with each other.
    Only counts by key are joined to rows, so a key of a million blank rows on both sides gives two million rows.
    """
    with Scratch(left.sparkSession, "classes") as scratch:
        a, b = ids
        sides = {"left": left.select(F.col(a).alias("id"), *dict.fromkeys([*first, *second])), "right": right.select(F.col(b).alias("id"), *dict.fromkeys([*first, *second]))}
        found: list[DataFrame] = []
        for strategy, keys in (("first_pass", first), ("second_pass", second)):
            counts = [rows.groupBy(*keys).agg(F.count("*").alias(f"n_{side}")) for side, rows in sides.items()]
            classes = scratch.write(counts[0].join(counts[1], keys))
            labelled = classes.withColumn("class", F.to_json(F.struct(*keys)))
            for side, rows in sides.items():
                found.append(rows.join(labelled, keys).select(F.lit(side).alias("side"), "id", F.lit(strategy).alias("strategy"), "class", "n_left", "n_right"))
                sides[side] = scratch.write(rows.join(classes, keys, "left_anti"))
        for side, rows in sides.items():
            none = F.lit(None).cast("long")
            found.append(rows.select(F.lit(side).alias("side"), "id", F.lit(f"{side}_only").alias("strategy"), F.lit(None).cast("string").alias("class"), none.alias("n_left"), none.alias("n_right")))
        return scratch.kept(reduce(DataFrame.unionByName, found))


def class_links(classes: DataFrame) -> DataFrame:
    """``strategy, classes, links``: how many pairs the classes stand for, without making one."""
    own = classes.where("class IS NOT NULL").groupBy("strategy", "class").agg(F.first("n_left").alias("a"), F.first("n_right").alias("b"))
    return own.groupBy("strategy").agg(F.count("*").alias("classes"), F.sum(F.col("a") * F.col("b")).alias("links"))


def expand_classes(classes: DataFrame, ids: tuple[str, str], most: int | None = None, part: int = 10_000) -> DataFrame:
    """The pairs (left id, right id, strategy) of the classes of at most ``most`` links; None is all.

    A class's left members are dealt to parts of about ``part`` rows, and its right ones go to each part, so no key is one task.
    """
    linked = classes.where("class IS NOT NULL")
    linked = linked if most is None else linked.where(F.col("n_left") * F.col("n_right") <= most)
    parts = F.ceil(F.col("n_left") / part).cast("int")
    left = linked.where("side = 'left'").select(F.col("id").alias(ids[0]), "strategy", "class", F.pmod(F.xxhash64("id"), parts).cast("int").alias("_part"))
    right = linked.where("side = 'right'").select(F.col("id").alias(ids[1]), "strategy", "class", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return left.join(right, ["strategy", "class", "_part"]).select(*ids, "strategy")


def lookup_join(left: DataFrame, right: DataFrame, on: Column, right_keys: list[str], indicator: str) -> DataFrame:
    """Left join to a table whose keys are asserted unique; ``indicator``: both or left_only."""
    assert_unique(right, right_keys)
    joined = left.join(right, on, "left")
    return joined.withColumn(indicator, F.when(F.col(right_keys[0]).isNotNull(), "both").otherwise("left_only"))


def conflict_filter(links: DataFrame, group: str, strategy: str, drop: str) -> DataFrame:
    """Where a group holds both left_only and right_only rows, the ``drop`` side's rows go."""
    part = Window.partitionBy(group)
    has = {s: F.max((F.col(strategy) == s).cast("int")).over(part) for s in ("left_only", "right_only")}
    rows = links.withColumns({"_l": has["left_only"], "_r": has["right_only"]})
    return rows.where(~((F.col("_l") == 1) & (F.col("_r") == 1) & (F.col(strategy) == drop))).drop("_l", "_r")


def year_scoped_link(left: DataFrame, right: DataFrame, ids: tuple[str, str], year: str, stages: list[tuple[str, str, str]]) -> DataFrame:
    """Stages within a year: right keys must be unique in their year; a left row takes its best right row.

    ``left`` has array keys (ordered) or plain ones; the earliest key wins, then the least right id.
    """
    a, b = ids
    with Scratch(left.sparkSession, "year-link") as scratch:
        found: list[DataFrame] = []
        for name, key_l, key_r in stages:
            keys = F.col(key_l) if left.schema[key_l].dataType.typeName() == "array" else F.array(F.col(key_l))
            own = _unmatched(left, a, found).select(a, year, F.posexplode(F.array_distinct(keys)).alias("_at", "_k")).where(~blank(F.col("_k")))
            other = _unmatched(right, b, found).where(~blank(F.col(key_r))).select(b, year, F.col(key_r).alias("_k"))
            other = other.groupBy(year, "_k").agg(F.count("*").alias("_n"), F.first(b).alias(b)).where("_n = 1")
            best = own.join(other, [year, "_k"]).groupBy(a).agg(F.min(F.struct("_at", b))[b].alias(b))
            found.append(scratch.write(best.select(a, b, F.lit(name).alias("strategy"))))
        return scratch.kept(reduce(DataFrame.unionByName, found))


def keep_first_join(left: DataFrame, right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join to the first right row of each non-blank key in the given order; left rows stay one each."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = right.where(~blank(F.col(key))).withColumn("_r", place).where("_r = 1").drop("_r")
    return left.join(first, key, "left")


def join_chain(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left joins of tables that have ``key`` once each (asserted), in order; the base's rows stay one each."""
    for other in others:
        assert_unique(other, [key])
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def combined_columns(df: DataFrame, names: list[str], first: str, second: str, out: str = "") -> DataFrame:
    """After a linkage: for each name the value of the ``first`` source's column, else the ``second``'s, and which it was."""
    made = {}
    for n in names:
        a, b = F.col(f"{first}{n}"), F.col(f"{second}{n}")
        made[f"{out}{n}"] = first_nonblank(a, b)
        made[f"{out}{n}_source"] = first_nonblank_source({first.rstrip("_"): a, second.rstrip("_"): b})
    return df.withColumns(made)


def three_pass_outer(left: DataFrame, right: DataFrame, group: str, names: tuple[str, str], least: float = 0.8) -> DataFrame:
    """Equal (group, last, first); then equal (group, last); then greedy overlap of last names within the group; the rest stays.

    ``left(l_id, group, last, first)``, ``right(r_id, group, last, first)`` with ``names`` = (last, first).
    Returns l_id, r_id, strategy of every row of both sides.
    """
    last, first = names
    with Scratch(left.sparkSession, "three-pass") as scratch:
        two = scratch.write(two_pass_outer(left, right, ("l_id", "r_id"), [group, last, first], [group, last]))
        met = two.where("strategy in ('first_pass', 'second_pass')")
        rest_l = left.join(met.select("l_id"), "l_id", "left_anti").select(group, "l_id", F.col(last).alias("l_name"))
        rest_r = right.join(met.select("r_id"), "r_id", "left_anti").select(group, "r_id", F.col(last).alias("r_name"))
        third = scratch.write(greedy_overlap(rest_l, rest_r, group, least).select("l_id", "r_id", F.lit("overlap").alias("strategy")))
        found = met.unionByName(third)
        only_l = _unmatched(left, "l_id", [found]).select("l_id", F.lit(None).cast(right.schema["r_id"].dataType).alias("r_id"), F.lit("left_only").alias("strategy"))
        only_r = _unmatched(right, "r_id", [found]).select(F.lit(None).cast(left.schema["l_id"].dataType).alias("l_id"), "r_id", F.lit("right_only").alias("strategy"))
        return scratch.kept(reduce(DataFrame.unionByName, [found, only_l, only_r]))


def zip_by_position(tables: dict[str, DataFrame], position: str) -> DataFrame:
    """Tables side by side by their row numbers ``position``, their other columns prefixed by their name.

    Numbers of rows that differ, or repeated or missing positions, are an error.
    """
    sizes = {name: t.agg(F.count("*"), F.countDistinct(position), F.min(position), F.max(position)).first() for name, t in tables.items()}
    if len({tuple(s) for s in sizes.values()}) > 1 or any(s[0] != s[1] for s in sizes.values()):
        raise ValueError(f"row counts or positions differ: { {n: s[0] for n, s in sizes.items()} }")
    named = [t.select(position, *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c != position]) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, position), named)


def inner_on_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of several tables on a composite key that is unique in each (asserted)."""
    for t in tables:
        assert_unique(t, keys)
    return reduce(lambda a, b: a.join(b, keys), tables)
