"""Rules for result files. Each rule is a DataFrame of offending rows; a report adds examples and a verdict."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.sources import entities

MATCHING_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def listed(rows: DataFrame) -> DataFrame:
    """line_no, s1_id, id of every list entry; an empty element counts, an empty list does not."""
    return rows.where("not malformed").select("line_no", "s1_id", F.explode("ids").alias("id"))


def malformed(rows: DataFrame) -> DataFrame:
    """Rows without a tab."""
    return rows.where("malformed").select("line_no")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.where("not malformed").groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.where("not malformed").where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id", F.concat_ws(",", "ids").alias("ids"))


def self_matches(rows: DataFrame) -> DataFrame:
    return listed(rows).where(F.col("id").startswith("S1-")).select("s1_id", "id")


def wrong_prefixes(rows: DataFrame) -> DataFrame:
    return listed(rows).where(~F.col("id").rlike("^S[123]-")).select("s1_id", "id")


def unknown_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Well-formed ids that neither pool has. known: column entity_id."""
    own = listed(rows).where(F.col("id").rlike("^S[23]-")).select("s1_id", F.col("id").alias("entity_id"))
    return own.join(known, "entity_id", "left_anti").select("s1_id", F.col("entity_id").alias("id"))


def missing_records(rows: DataFrame, required: DataFrame) -> DataFrame:
    return required.join(rows.where("not malformed").select(F.col("s1_id").alias("entity_id")), "entity_id", "left_anti")


def extra_records(rows: DataFrame, required: DataFrame) -> DataFrame:
    return rows.where("not malformed").select(F.col("s1_id").alias("entity_id")).distinct().join(required, "entity_id", "left_anti")


def not_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that the candidate file lacks."""
    return listed(matching).select("s1_id", "id").distinct().join(listed(candidates).select("s1_id", "id"), ["s1_id", "id"], "left_anti")


def row_stats(rows: DataFrame) -> DataFrame:
    some = F.size("ids") > 0
    return rows.where("not malformed").agg(F.count("*").alias("rows"), F.count_if(some).alias("non_empty"), F.count_if(~some).alias("empty"))


def examples(offending: DataFrame, column: str, most: int = 5) -> DataFrame:
    """One row: the first few values in order, and how many there are. Only `most` rows per task travel."""
    values = offending.select(F.col(column).cast("string").alias("v")).distinct()
    first = values.orderBy("v").limit(most).select("v", F.lit(0).cast("long").alias("n"))
    both = first.union(values.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("v"), "n"))
    return both.agg(F.concat_ws(", ", F.array_sort(F.collect_list("v"))).alias("examples"), F.max("n").alias("total"))


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        return 1 if self.errors else 0


def _header_fault(line: str | None, expected: tuple[str, str], name: str) -> str | None:
    if line is None:
        return f"{name}: file is empty"
    if "\t" not in line and "," in line:
        return f"{name}: separated by commas, not tabs"
    if tuple(x.strip().lower() for x in line.split("\t")) != expected:
        return f"{name}: header is {line!r}, expected {' and '.join(expected)}"
    return None


def check_file(spark: SparkSession, path: str, expected: tuple[str, str], required: DataFrame, known: DataFrame | None, report: Report) -> DataFrame | None:
    """Applies every rule of one file; returns its rows unless the file cannot be read as a list file."""
    if not entities.exists(spark, path):
        report.errors.append(f"{path}: file is missing")
        return None
    broken = spark.read.format("binaryFile").load(path).where(F.expr("not is_valid_utf8(cast(content as string))"))
    if not broken.isEmpty():
        report.errors.append(f"{path}: not UTF-8")
        return None
    lines = entities.read_lines(spark, path)
    first = lines.where("line_no = 1").select("value").take(1)
    if fault := _header_fault(first[0][0] if first else None, expected, path):
        report.errors.append(fault)
        return None
    rows = entities.parse_lists(lines)
    rules = [
        ("rows without a tab, lines", malformed(rows), "line_no"),
        ("repeated records", duplicate_rows(rows), "s1_id"),
        ("ids repeated in a list of", duplicate_ids(rows), "s1_id"),
        ("records matched with source 1, in", self_matches(rows), "s1_id"),
        ("ids without an S2- or S3- prefix", wrong_prefixes(rows), "id"),
        ("records missing", missing_records(rows, required), "entity_id"),
        ("records that are not in source 1", extra_records(rows, required), "entity_id"),
    ]
    if known is not None:
        rules.append(("unknown ids", unknown_ids(rows, known), "id"))
    for what, offending, column in rules:
        found = examples(offending, column).first()
        if found.total:
            report.errors.append(f"{path}: {what}: {found.examples} ({found.total} in all)")
    report.stats[path] = row_stats(rows).first().asDict()
    return rows


def validate(spark: SparkSession, source1: str, matching: str, candidates: str | None = None, pools: tuple[str, ...] = (), check_ids: bool = False) -> Report:
    report = Report()
    if not entities.exists(spark, source1):
        report.errors.append(f"{source1}: file is missing")
        return report
    known = None
    if check_ids:
        there = [p for p in pools if entities.exists(spark, p)]
        report.warnings += [f"{p}: missing, its ids are not checked" for p in pools if p not in there]
        if len(there) == len(pools) and there:
            known = entities.required_ids(spark, there[0])
            for p in there[1:]:
                known = known.union(entities.required_ids(spark, p)).distinct()
    required = entities.required_ids(spark, source1)
    own = check_file(spark, matching, MATCHING_HEADER, required, known, report)
    if not candidates or not entities.exists(spark, candidates):
        report.warnings.append("no candidate file")
        return report
    other = check_file(spark, candidates, CANDIDATE_HEADER, required, known, report)
    if own is not None and other is not None:
        found = examples(not_candidates(own, other), "id").first()
        if found.total:
            report.warnings.append(f"matches that are no candidates: {found.examples} ({found.total} in all)")
    return report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Check result files.")
    parser.add_argument("--source1", required=True)
    parser.add_argument("--matching", required=True)
    parser.add_argument("--candidates")
    parser.add_argument("--pool", action="append", default=[])
    parser.add_argument("--check-ids", action="store_true")
    args = parser.parse_args(argv)
    report = validate(SparkSession.builder.getOrCreate(), args.source1, args.matching, args.candidates, tuple(args.pool), args.check_ids)
    for w in report.warnings:
        print("warning:", w)
    for e in report.errors:
        print("error:", e)
    print("FAIL" if report.errors else "PASS", report.stats)
    return report.exit_code


if __name__ == "__main__":
    sys.exit(main())
