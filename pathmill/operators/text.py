"""Documents as rows of lines: carried headers, sections, weekly plans, context lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmill.functions.text import labelled, lines_of
from pathmill.operators.aggregates import ordered_list


def numbered_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(doc, F.posexplode(lines_of(F.col(text))).alias("pos", "line"))


def carried(lines: DataFrame, doc: str, value: Column, name: str) -> DataFrame:
    """lines with the last non-null value at or before each line of its document."""
    so_far = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(so_far))


def sections(lines: DataFrame, doc: str, headers: dict[str, str], default: str) -> DataFrame:
    """doc, section, text: lines by the section whose header line precedes them; header lines themselves are left out."""
    header = F.try_element_at(F.create_map(*[F.lit(v) for kv in headers.items() for v in kv]), F.col("line"))
    rows = carried(lines.withColumn("_header", header), doc, F.col("_header"), "section").where("_header is null").withColumn("section", F.coalesce("section", F.lit(default)))
    return rows.groupBy(doc, "section").agg(F.array_join(ordered_list(F.col("line"), "pos"), "\n").alias("text"))


def merged_sections(found: DataFrame, doc: str, into: str, parts: dict[str, str]) -> DataFrame:
    """Sections of `parts` become one line each, with their prefix, ahead of the section `into`."""
    prefix = F.try_element_at(F.create_map(*[F.lit(v) for kv in parts.items() for v in kv]), F.col("section"))
    line = F.when(prefix.isNotNull(), F.concat(prefix, F.regexp_replace("text", "\n", ", "))).otherwise(F.col("text"))
    target = F.when(prefix.isNotNull(), into).otherwise(F.col("section"))
    order = F.when(prefix.isNotNull(), F.array_position(F.array(*map(F.lit, parts)), F.col("section"))).otherwise(F.lit(99))
    return found.select(doc, target.alias("section"), line.alias("text"), order.alias("o")).groupBy(doc, "section").agg(F.array_join(ordered_list(F.col("text"), "o"), "\n").alias("text"))


def graded_lines(lines: DataFrame, doc: str, pattern: str = r"(\d)학년\s*(\d)학기") -> DataFrame:
    """Lines after a header of year and term, with grade and the semester counted from the first year; headers are left out."""
    is_header = F.col("line").rlike(pattern)
    grade, term = F.regexp_extract("line", pattern, 1).cast("int"), F.regexp_extract("line", pattern, 2).cast("int")
    rows = carried(lines.withColumn("_h", is_header), doc, F.when(is_header, grade), "grade")
    rows = carried(rows, doc, F.when(is_header, (grade - 1) * 2 + term), "semester")
    return rows.where("not _h").drop("_h")


def syllabus_fields(docs: DataFrame, doc: str, text: str, labels: dict[str, str]) -> DataFrame:
    return docs.select(doc, *[labelled(F.col(text), label).alias(name) for name, label in labels.items()])


def weekly_plan(lines: DataFrame, doc: str, topic_mark: str, noise: list[str], week: str = r"^(\d+)주") -> DataFrame:
    """doc, week, topic: lines from the topic mark on, or all lines of a week without one, noise left out."""
    number = F.when(F.col("line").rlike(week), F.regexp_extract("line", week, 1).cast("int"))
    rows = carried(lines, doc, number, "week").where("week is not null").where(~F.col("line").rlike(week) & ~F.col("line").isin(noise))
    of_week = Window.partitionBy(doc, "week")
    marked = F.startswith("line", F.lit(topic_mark))
    first = F.min(F.when(marked, F.col("pos"))).over(of_week)
    kept = rows.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("pos") >= F.col("_first")))
    plain = F.trim(F.when(marked, F.expr(f"substring(line, {len(topic_mark) + 1})")).otherwise(F.col("line")))
    return kept.withColumn("line", plain).groupBy(doc, "week").agg(F.array_join(ordered_list(F.col("line"), "pos"), " ").alias("topic"))


def result_lines(rows: DataFrame, owner: str, place: str, line: Column, empty: str, owners: DataFrame) -> DataFrame:
    """owner, text: an owner's results as numbered lines, or the mark of an empty result."""
    numbered = rows.withColumn("_line", F.concat(F.col(place).cast("string"), F.lit(". "), line))
    text = numbered.groupBy(owner).agg(F.array_join(ordered_list(F.col("_line"), place), "\n").alias("text"))
    return owners.select(owner).join(text, owner, "left").withColumn("text", F.coalesce("text", F.lit(empty)))
