"""Graphs and tables as lines of text formats; writers take the lines, so nothing is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line for each node (id, label) and edge (src, dst), without the header ``graph TD``."""
    shown = nodes.select(F.concat(F.lit("  "), "id", F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    return shown.union(edges.select(F.concat(F.lit("  "), "src", F.lit(" --> "), "dst")))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    shown = nodes.select(F.concat(F.lit("  "), quoted("id"), F.lit(" [label="), quoted("label"), F.lit("];")).alias("line"))
    return shown.union(edges.select(F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";"))))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    attr = lambda c: tx.escape_xml(F.col(c))
    shown = nodes.select(F.concat(F.lit('<node id="'), attr("id"), F.lit('"><data key="label">'), attr("label"), F.lit("</data></node>")).alias("line"))
    return shown.union(edges.select(F.concat(F.lit('<edge source="'), attr("src"), F.lit('" target="'), attr("dst"), F.lit('"/>'))))


def csv_lines(rows: DataFrame) -> DataFrame:
    """RFC 4180 lines: strings quoted with quotes doubled, null empty, other types as they are."""
    cells = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        cell = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else c.cast("string")
        cells.append(F.coalesce(cell, F.lit("")))
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet with a folder for each value, as for documents by language or logs by month."""
    rows.write.mode("append").partitionBy(*by).parquet(path)
