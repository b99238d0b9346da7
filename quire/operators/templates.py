"""Documents and prompts from templates: rows fill the placeholders, on the JVM, one document a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The built-in templates; `{name}` stands for a column. Others come as strings or from a table of their own.
TEMPLATES = {
    "plan": "# Plan: {goal}\n\nKind: {kind}\n\n{phases}\n",
    "requirements": "# Requirements: {goal}\n\n## Context\n\n{context}\n\n## Time\n\n{phases}\n\n## From the library\n\n{sources}\n",
    "architecture": "# Architecture brief: {goal}\n\n## Components\n\n{components}\n\n## Flows\n\n{flows}\n\n## Decisions\n\n{decisions}\n",
    "analysis": "# Analysis: {goal}\n\nComplexity: {level} ({score})\n\n{phases}\n\n## Recommended\n\n{recommended}\n",
    "research": "Look up {topic} in the library ({depth}). Quote the chapters that you use and name where they disagree.\n",
    "explain": "Explain {concept} to a reader of {level} experience, from the chapters that define it. Close with an example.\n",
    "reading": "Order the chapters on {goal} into {weeks} weeks of {hours} hours each.\n",
    "compare": "Set out how the books {books} treat {topic}: what they share, where they differ, and when each applies.\n",
}
_PLACE = re.compile(r"\{(\w+)\}")


def fill(template: str, columns: list[str]) -> Column:
    """The template with the columns' values in its placeholders; null is empty."""
    if unknown := sorted({m for m in _PLACE.findall(template) if m not in columns}):
        raise ValueError(f"no column for {', '.join(unknown)}")
    parts = _PLACE.split(template)  # text, name, text, ...
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def render(rows: DataFrame, template: str, key: str = "id") -> DataFrame:
    """key, document: one document for each row. template: a name of TEMPLATES or a text with placeholders."""
    return rows.select(key, fill(TEMPLATES.get(template, template), rows.columns).alias("document"))


def table(rows: DataFrame, key: str, columns: dict[str, str], order: str) -> DataFrame:
    """key, body: the rows of each key as a Markdown table, by `order`. columns: heading -> column. For the few rows of a plan."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns.values())), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return rows.groupBy(key).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("body"))


def timelines(phases: DataFrame, key: str, start: str) -> DataFrame:
    """phases with starts and ends: those of each key in order of `position`, a day apart. phases: key, position, phase, days."""
    before = F.sum(F.col("days") + 1).over(Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    begin = F.date_add(F.to_date(F.lit(start)), F.coalesce(before, F.lit(0)).cast("int"))
    return phases.withColumn("starts", begin).withColumn("ends", F.date_add("starts", F.col("days")))


def plans(goals: DataFrame, phases: DataFrame, start: str, key: str = "id") -> DataFrame:
    """key, document: a plan for each goal. goals: key, goal, kind. phases: kind, position, phase, days; a kind without phases
    has a plan without a table."""
    dated = timelines(goals.select(key, "kind").join(phases, "kind"), key, start)
    body = table(dated, key, {"Phase": "phase", "Days": "days", "Starts": "starts", "Ends": "ends"}, "position")
    return render(goals.join(body.withColumnRenamed("body", "phases"), key, "left").select(key, "goal", "kind", "phases"), "plan", key)
