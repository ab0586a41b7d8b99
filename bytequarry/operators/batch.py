"""Batches of targets: preparation, dry-run verdicts, summary and exit codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..repository import Repository
from ..schema import COMPLETED, PROCESSING

#: Exit codes.
SUCCESS, EXECUTION, VALIDATION, INVARIANT = 0, 1, 2, 3


def targets(spark: SparkSession, args: list[str], path: str | None = None) -> DataFrame:
    """place and raw: arguments, then the lines of a file; trimmed, without blank lines and comments."""
    keep = lambda df: df.withColumn("raw", F.trim("raw")).where("raw <> '' AND NOT startswith(raw, '#')")
    given = keep(spark.createDataFrame(list(enumerate(args)), "place long, raw string"))
    if path:
        lines = spark.read.text(path).select((F.monotonically_increasing_id() + len(args)).alias("place"), F.col("value").alias("raw"))
        given = given.unionByName(keep(lines))
    return given


def prepared(rows: DataFrame) -> DataFrame:
    """place, raw, id and state: planned, failed (not a positive number) or skipped (a repetition)."""
    number = F.when(F.trim("raw").rlike(r"^\+?[0-9]{1,18}$"), F.expr("try_cast(trim(raw) AS BIGINT)"))
    p = rows.withColumn("id", F.when(number > 0, number))
    again = F.row_number().over(Window.partitionBy("id").orderBy("place")) > 1
    return p.withColumn("state", F.when(F.col("id").isNull(), "failed").when(again, "skipped").otherwise("planned"))


def restore_dry_run(repo: Repository, rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """What a restore would do; existing: original_name of outputs that are there and may not be overwritten."""
    p = prepared(rows).join(repo.logical_file.select("id", "status", "original_name"), "id", "left")
    there = F.lit(False)
    if existing is not None:
        p = p.join(existing.select("original_name", F.lit(True).alias("exists")).distinct(), "original_name", "left")
        there = F.coalesce("exists", F.lit(False))
    result = F.when(F.col("state") != "planned", F.col("state")).when(F.col("status").isNull() | (F.col("status") != COMPLETED) | there, "failed").otherwise("planned")
    return p.select("place", "raw", "id", result.alias("state"))


def remove_dry_run(repo: Repository, rows: DataFrame) -> DataFrame:
    """What a removal would do: a file that is missing or still being stored fails."""
    p = prepared(rows).join(repo.logical_file.select("id", "status"), "id", "left")
    result = F.when(F.col("state") != "planned", F.col("state")).when(F.col("status").isNull() | (F.col("status") == PROCESSING), "failed").otherwise("planned")
    return p.select("place", "raw", "id", result.alias("state"))


def prepared_paths(rows: DataFrame) -> DataFrame:
    """place, raw, path and state of stored paths: planned, failed (blank) or skipped (a repetition)."""
    p = rows.withColumn("path", F.trim("raw"))
    again = F.row_number().over(Window.partitionBy("path").orderBy("place")) > 1
    return p.withColumn("state", F.when(F.col("path") == "", "failed").when(again, "skipped").otherwise("planned"))


#: What can be repaired.
REPAIRS = ("ref-counts",)


def prepared_repairs(rows: DataFrame) -> DataFrame:
    """place, raw and state of repair targets: planned, failed (unknown) or skipped (a repetition)."""
    p = rows.withColumn("name", F.lower(F.trim("raw")))
    again = F.row_number().over(Window.partitionBy("name").orderBy("place")) > 1
    return p.select("place", "raw", F.when(~F.col("name").isin(*REPAIRS), "failed").when(again, "skipped").otherwise("planned").alias("state"))


def executed(repo: Repository, rows: DataFrame, work: Callable[[Repository, int], Repository], fail_fast: bool = False) -> tuple[Repository, list[dict[str, object]]]:
    """Planned ids one after another; the repository after those that went well, and the results in order. fail_fast: nothing
    is tried after the first failure. A batch is a command's targets."""
    results: list[dict[str, object]] = []
    for r in sorted(prepared(rows).collect(), key=lambda r: r["place"]):
        item: dict[str, object] = {"place": r["place"], "raw": r["raw"], "id": r["id"], "state": r["state"], "code": None, "action": None}
        if r["state"] == "planned":
            try:
                repo, item["state"] = work(repo, r["id"]), "success"
            except (ValueError, AssertionError) as e:
                item |= {"state": "failed", "message": str(e), "exit": exit_of(e), "code": getattr(e, "code", None), "action": getattr(e, "action", None)}
        results.append(item)
        if fail_fast and item["state"] == "failed":
            break
    return repo, results


def summary(results: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Counts by state, and the overall status."""
    if fail_fast:
        w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a batch is a command's targets
        results = results.withColumn("_f", F.coalesce(F.sum(F.when(F.col("state") == "failed", 1).otherwise(0)).over(w), F.lit(0))).where("_f = 0")
    n = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    out = results.agg(F.count(F.lit(1)).alias("total"), n("success"), n("failed"), n("skipped"), n("planned"))
    good = F.col("success") + F.col("planned")
    return out.withColumn("status", F.when(F.col("failed") == 0, "ok").when(good > 0, "partial_failure").otherwise("error"))


def exit_code(invariant: Column, execution: Column, validation: Column) -> Column:
    """From the numbers of failures of each kind."""
    return F.when(invariant > 0, INVARIANT).when(execution > 0, EXECUTION).when(validation > 0, VALIDATION).otherwise(SUCCESS)


def exit_of(error: Exception) -> int:
    """By the kind of error: a broken invariant, wrong input, a recovery that can't be trusted, or anything else."""
    if isinstance(error, AssertionError):
        return INVARIANT
    return VALIDATION if isinstance(error, (ValueError, KeyError)) else EXECUTION
