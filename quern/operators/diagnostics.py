"""Analyzer messages: reading them, finding the component they lie in, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.cleaning import as_col

SEVERITIES = ("error", "warning", "note")


def severity(c: Column | str) -> Column:
    """error, warning or note by what a word contains; warning for anything else."""
    text = F.lower(as_col(c))
    return (
        F.when(F.contains(text, F.lit("error")), "error")
        .when(F.contains(text, F.lit("warn")), "warning")
        .when(F.contains(text, F.lit("note")) | F.contains(text, F.lit("info")), "note")
        .otherwise("warning")
    )


def severity_rank(c: Column | str) -> Column:
    return F.when(as_col(c) == "error", 0).when(as_col(c) == "warning", 1).otherwise(2)


def parse_lines(rows: DataFrame, column: str = "line") -> DataFrame:
    """(file, line, severity, code, message) of lines file:line[:column]:severity:message.

    Split at the first four colons. Fewer than four parts or a line number
    that is none: no message, the line is dropped.
    """
    p = F.split(F.col(column), ":", 5)
    long = F.size(p) >= 5
    at = lambda i: F.get(p, F.lit(i))
    out = rows.where(F.size(p) >= 4).select(
        F.replace(F.trim(at(0)), F.lit("\\"), F.lit("/")).alias("file"),
        F.trim(at(1)).try_cast("int").alias("line"),
        severity(F.when(long, at(3)).otherwise(at(2))).alias("severity"),
        F.lit("").alias("code"),
        F.trim(F.when(long, at(4)).otherwise(at(3))).alias("message"),
    )
    return out.where("line IS NOT NULL")


def located(diagnostics: DataFrame, components: DataFrame) -> DataFrame:
    """diagnostics with the id of every component whose lines hold them: equal file, line within the span."""
    spans = components.select("id", F.col("file").alias("_file"), "start_line", "end_line")
    inside = (F.col("file") == F.col("_file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return diagnostics.join(spans, inside).drop("_file", "start_line", "end_line")


def faults(found: DataFrame) -> DataFrame:
    """(id, errors, warnings, notes) per component."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy("id").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("note").alias("notes"))


def lists(found: DataFrame) -> DataFrame:
    """(id, diagnostics): each component's messages by severity, line and text, as an array of structs."""
    item = F.struct(severity_rank("severity").alias("rank"), "line", "severity", "message")
    return found.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("diagnostics"))


def totals(diagnostics: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return diagnostics.agg(
        F.count(F.lit(1)).alias("total"), count("error").alias("errors"), count("warning").alias("warnings"), count("note").alias("notes")
    )
