"""Evidence scores and the resolution of competing evidence; append-only checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_score(similarity: Column, candidates: Column, has_institution: Column, has_year: Column, direct: Column, places: int = 4) -> Column:
    """0.95 of the weighted evidence, at most 0.99, rounded."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))
    unique = F.when(direct, F.lit(1.0)).otherwise(F.greatest(F.lit(0.35), F.lit(1.0) - F.lit(0.15) * (F.greatest(candidates, F.lit(1)) - 1)))
    raw = F.lit(0.55) * clamped + F.lit(0.20) * unique + F.when(has_institution, 0.15).otherwise(0.0) + F.when(has_year, 0.10).otherwise(0.0)
    return F.round(F.least(F.lit(0.99), F.lit(0.95) * raw), places)


def resolve(evidence: DataFrame, subjects: DataFrame, least: float = 0.85, margin: float = 0.12) -> DataFrame:
    """One outcome for each subject, by an ordered list of decisions.

    ``evidence(subject, profile, institution, year, confidence, seq)``; ``subjects(subject,
    candidates, truncated)``.  The best usable record (with an institution; ties to the smaller
    seq) decides, unless its profile contradicts itself, the search was truncated, another profile
    comes too close, or its confidence is too low.  Evidence that repeats a subject's profile, institution
    (in any case) and year counts once: the first (least seq) of the most confident.
    """
    same_record = [F.col("subject"), F.col("profile"), F.lower(F.trim("institution")), F.col("year")]
    evidence = first_of_each(evidence, same_record, [F.desc("confidence"), F.col("seq")])
    usable = F.coalesce(F.trim("institution"), F.lit("")) != ""
    key = F.struct(F.col("confidence"), -F.col("seq"))
    tops = evidence.groupBy("subject").agg(
        F.count("*").alias("records"),
        F.max("confidence").alias("any_confidence"),
        F.max_by(F.struct("profile", "institution", "year", "confidence"), F.when(usable, key)).alias("top"),
    )
    rows = evidence.where(usable).join(tops.select("subject", "top"), "subject")
    same = F.col("profile") == F.col("top.profile")
    rivals = rows.groupBy("subject").agg(F.max(F.when(~same, F.col("confidence"))).alias("rival"), F.countDistinct(F.when(same, F.lower(F.trim("institution")))).alias("places"), F.countDistinct(F.when(same, F.col("year"))).alias("years"))
    out = subjects.join(tops, "subject", "left").join(rivals, "subject", "left")
    none = F.col("top.profile").isNull()
    reason = (
        F.when(none & (F.coalesce("records", F.lit(0)) > 0), "record_missing_institution")
        .when(none & F.col("truncated"), "search_truncated_without_match")
        .when(none & (F.col("candidates") > 0), "profiles_without_record")
        .when(none, "no_profile")
        .when((F.col("places") > 1) | (F.col("years") > 1), "profile_conflicts")
        .when(F.col("truncated"), "search_truncated")
        .when(F.col("top.confidence") - F.col("rival") < margin, "competing_profiles")
        .when(F.col("top.confidence") < least, "below_threshold")
        .when(F.col("top.year").isNull(), "year_not_public")
        .otherwise("clear_record")
    )
    out = out.withColumn("reason", reason)
    status = (
        F.when(F.col("reason") == "record_missing_institution", "incomplete_record")
        .when(F.col("reason").isin("profiles_without_record", "no_profile"), "not_found")
        .when(F.col("reason") == "below_threshold", "low_confidence")
        .when(F.col("reason") == "year_not_public", "matched_institution_only")
        .when(F.col("reason") == "clear_record", "matched_high_confidence")
        .otherwise("ambiguous")
    )
    accepted = F.col("reason").isin("year_not_public", "clear_record")
    return out.select("subject", status.alias("status"), "reason", F.when(none, F.coalesce("any_confidence", F.lit(0.0))).otherwise(F.col("top.confidence")).alias("confidence"), F.when(accepted, F.col("top.institution")).otherwise("").alias("institution"), F.when(accepted, F.col("top.year")).alias("year"))


def latest(checkpoint: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key of an append-only table."""
    return checkpoint.groupBy(key).agg(F.max_by(F.struct(*[c for c in checkpoint.columns if c != key]), F.col(seq)).alias("_r")).select(key, "_r.*")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys without a finished record."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def first_of_each(evidence: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Evidence deduplicated on normalized keys; the first one wins."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return evidence.withColumn("_r", place).where("_r = 1").drop("_r")


def resolution_rows(subjects: DataFrame, outcomes: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(final, review)``: every subject's outcome, ``not_processed`` by default, and what has to be looked at by hand.

    ``outcomes`` is :func:`resolve`'s table of the processed subjects.  A subject that was not accepted has a review
    row for each piece of its evidence, ranked by confidence, or one of rank 0 without any.
    """
    final = subjects.select("subject").join(outcomes, "subject", "left")
    final = final.withColumn("status", F.coalesce("status", F.lit("not_processed"))).na.fill("", ["reason", "institution"])
    accepted = F.col("status").isin("matched_high_confidence", "matched_institution_only")
    shown = final.withColumn("review_reason", F.when(accepted | (F.col("status") == "not_processed"), "").otherwise(F.col("reason")))
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("confidence"), "seq"))
    ranked = evidence.withColumn("candidate_rank", place).select("subject", "candidate_rank", F.col("institution").alias("candidate_institution"), F.col("year").alias("candidate_year"), F.col("confidence").alias("candidate_confidence"))
    review = shown.where("review_reason <> ''").select("subject", "status", "review_reason").join(ranked, "subject", "left").na.fill(0, ["candidate_rank"])
    return shown, review
