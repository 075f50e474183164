"""Checks of newest scores against expectations."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ward_analytics.catalogue import NO_SCORE_TEXT
from ward_analytics.operators.latest import latest_scores


def scenario_check(scores: DataFrame, expectations: DataFrame) -> DataFrame:
    """PASS or FAIL for each expectation, with the reasons and a report line."""
    newest = latest_scores(
        scores.select("patient_id", "window_start", "news2_score", "risk_level")
    ).select(
        "patient_id",
        F.col("news2_score").alias("score"),
        F.upper("risk_level").alias("risk"),
    )
    checked = expectations.join(newest, "patient_id", "left")
    score = F.col("score").cast("string")
    missing = F.col("score").isNull()
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    reasons = F.concat_ws(
        "; ",
        F.when(
            F.col("risk") != F.col("risk_level"),
            text("expected risk ", F.col("risk_level"), ", got ", F.col("risk")),
        ),
        F.when(
            F.col("score") < F.col("min_score"),
            text("expected score >= ", F.col("min_score").cast("string"), ", got ", score),
        ),
        F.when(
            F.col("score") > F.col("max_score"),
            text("expected score <= ", F.col("max_score").cast("string"), ", got ", score),
        ),
        F.when(missing, NO_SCORE_TEXT),
    )
    judged = checked.withColumn("reasons", reasons).withColumn(
        "verdict", F.when(F.col("reasons") == "", "PASS").otherwise("FAIL")
    )
    who = text(
        F.col("verdict"), " — ", F.col("scenario"), " (patient ",
        F.col("patient_id").cast("string"), "): ",
    )
    found = text("score=", score, ", risk=", F.col("risk"))
    report = (
        F.when(missing, text(who, F.col("reasons")))
        .when(F.col("verdict") == "PASS", text(who, found))
        .otherwise(text(who, found, " (", F.col("reasons"), ")"))
    )
    return judged.select(
        "patient_id", "scenario", "score", "risk", "verdict", "reasons", report.alias("report")
    )


def missing_scores(scores: DataFrame, expectations: DataFrame) -> DataFrame:
    """Expected patients without any score; the scores shrink to their ids before the join."""
    scored = scores.select("patient_id").distinct()
    return expectations.select("patient_id", "scenario").join(scored, "patient_id", "left_anti")


def check_summary(checked: DataFrame) -> DataFrame:
    """Number of checks and failures in one row; a job fails when there are any."""
    return checked.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(F.col("verdict") == "FAIL").alias("n_failures"),
    )


class CheckFailed(Exception):
    """Rows that fail a check kept a table from being written; ``counts`` has the number of rows and of failures by check."""

    def __init__(self, counts: Mapping[str, int]):
        self.counts = dict(counts)
        failed = ", ".join(f"{name}: {n}" for name, n in self.counts.items() if n and name != "n_rows")
        super().__init__(f"of {self.counts['n_rows']} rows fail {failed}")


def gated_write(df: DataFrame, path: str, failing: Mapping[str, Column]) -> dict[str, int]:
    """Write a table at a new path unless a row fails a check (a condition that marks bad rows; null marks none); the counts.

    Checks are observed by the write itself, so all takes one job over one pass. The rows go to a folder beside the path, which becomes the table when no
    row failed, and is removed when one did; then CheckFailed is raised and nothing is left at the path.
    """
    metrics = [F.count(F.lit(1)).alias("n_rows"), *(F.count_if(condition).alias(name) for name, condition in failing.items())]
    seen = Observation(f"gate-{uuid.uuid4().hex}")
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staged = hadoop(path.rstrip("/")), hadoop(f"{path.rstrip('/')}._{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    try:
        df.observe(seen, *metrics).write.parquet(staged.toString())
        counts = {name: int(n or 0) for name, n in seen.get.items()}
        if any(n for name, n in counts.items() if name != "n_rows"):
            raise CheckFailed(counts)
        if not files.rename(staged, target):
            raise OSError(f"{staged} could not be moved to {path}")
    finally:
        files.delete(staged, True)
    return counts
