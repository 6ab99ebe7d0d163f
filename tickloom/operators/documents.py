"""Text documents per session or company, kept as ordered parts.

A document is the space-joined non-blank texts of its headlines. It is stored as rows (keys, part, text) whose
parts follow each other, with a fixed span of input positions per part: a session with a third of
all headlines is many parts, never one huge string, and the whole text is the parts joined by spaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Input positions covered by one part.
PART_SPAN = 65_536


def document_parts(
    rows: DataFrame, keys: Sequence[str], text: Column, position: str = "pos", span: int = PART_SPAN
) -> DataFrame:
    """(keys, part, text): non-blank texts joined by a space in `position` order."""
    part = F.floor(F.col(position) / F.lit(span)).cast("long")
    lines = rows.select(*keys, part.alias("part"), F.struct(F.col(position).alias("p"), text.alias("t")).alias("line"))
    lines = lines.where(F.trim(F.col("line.t")) != "")
    ordered = F.transform(F.sort_array(F.collect_list("line")), lambda x: x["t"])
    return lines.groupBy(*keys, "part").agg(F.array_join(ordered, " ").alias("text"))


