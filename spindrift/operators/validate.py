"""Output validation: every rule is a query that returns offending ids, capped only for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import S1

HEADERS = {"matching": (S1, "matched_entity_ids"), "candidates": (S1, "candidate_entity_ids")}


def parsed_lines(lines: DataFrame, header: str) -> DataFrame:
    """Lines of a tab-separated file (column ``value``, header left out): id, list and ``no_tab``."""
    rows = lines.where((F.trim("value") != "") & (F.col("value") != header))
    tab = F.instr("value", "\t")
    rest = F.rtrim(F.col("value").substr(tab + 1, F.length("value")))
    ids = F.when(tab == 0, F.array().cast("array<string>")).when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    return rows.select(F.when(tab > 0, F.substring("value", F.lit(1), (tab - 1).cast("int"))).otherwise(F.col("value")).alias(S1), ids.alias("ids"), (tab == 0).alias("no_tab"))


def header_fault(first_line: str | None, kind: str) -> str | None:
    """Why a file's first line is not the expected header, or null."""
    if not first_line:
        return "empty file"
    if "\t" not in first_line and "," in first_line:
        return "comma-separated"
    if tuple(c.strip().lower() for c in first_line.rstrip("\n").split("\t")) != HEADERS[kind]:
        return "unexpected header"
    return None


def _rows(rule: str, level: str, df: DataFrame, subject: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), subject.alias("subject"))


def list_faults(parsed: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, level, subject) of every fault of a result or candidate file."""
    good = parsed.where("not no_tab")
    each = good.select(S1, F.explode("ids").alias("target")).distinct()
    foreign = ~F.col("target").startswith("S1-") & ~F.col("target").startswith("S2-") & ~F.col("target").startswith("S3-")
    required = required.select(F.col("entity_id").alias(S1)).distinct()
    faults = [
        _rows("row_without_tab", "error", parsed.where("no_tab"), F.col(S1)),
        _rows("duplicate_row", "error", good.groupBy(S1).count().where("count > 1"), F.col(S1)),
        _rows("repeated_id", "error", good.where(F.size("ids") != F.size(F.array_distinct("ids"))), F.col(S1)),
        _rows("self_match", "error", each.where(F.col("target").startswith("S1-")), F.col("target")),
        _rows("wrong_prefix", "error", each.where(foreign), F.col("target")),
        _rows("missing_record", "error", required.join(good.select(S1), S1, "left_anti"), F.col(S1)),
        _rows("extra_record", "error", good.select(S1).distinct().join(required, S1, "left_anti"), F.col(S1)),
    ]
    if known is not None:
        ours = each.where(F.col("target").startswith("S2-") | F.col("target").startswith("S3-"))
        faults.append(_rows("unknown_id", "error", ours.join(known.select(F.col("entity_id").alias("target")), "target", "left_anti"), F.col("target")))
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out.distinct()


def outside_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings: records with a match that is not among their candidates."""
    rows = matching.join(candidates.select(S1, F.col("ids").alias("allowed")), S1, "left")
    gone = F.size(F.array_except("ids", F.coalesce("allowed", F.array().cast("array<string>")))) > 0
    return _rows("match_not_candidate", "warning", rows.where(gone), F.col(S1))


def report(faults: DataFrame, examples: int = 5) -> DataFrame:
    """Faults by rule with their number and the first few subjects in order."""
    first = F.array_join(F.slice(F.sort_array(F.collect_set("subject")), 1, examples), ",")
    # the examples are the smallest subjects: keep that many of each rule before gathering them
    place = F.row_number().over(Window.partitionBy("rule", "level").orderBy("subject"))
    few = faults.withColumn("place", place).where(F.col("place") <= examples).groupBy("rule", "level").agg(first.alias("examples"))
    return faults.groupBy("rule", "level").agg(F.count("*").alias("n")).join(few, ["rule", "level"])
