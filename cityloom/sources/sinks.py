"""Result sinks and the guards in front of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cityloom.rules import HIDDEN_COLUMNS
from cityloom.sources.tables import require_columns


class HiddenColumnError(RuntimeError):
    """An export for labellers carries a column they must not see."""


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_report(df: DataFrame, path: str, provenance: list[str]) -> None:
    """Small report as one CSV; provenance lines go to a side ``_meta`` table next to it."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    spark = df.sparkSession
    meta = spark.range(len(provenance)).select(
        F.col("id").alias("line"), F.element_at(F.array(*[F.lit(p) for p in provenance]), F.col("id").cast("int") + 1).alias("text")
    )
    meta.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_meta")


def write_commented_csv(df: DataFrame, path: str, provenance: list[str]) -> None:
    """Report as CSV that carries its own provenance: ``#`` lines, the header, then rows, in every file it consists of.

    Rows are not gathered; a small report is one file. :func:`tables.read_report_csv` reads it back in one call.
    """
    head = [*(f"# {line}" for line in provenance), ",".join(df.columns)]

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"line": head})
        yield from batches

    df.select(F.to_csv(F.struct(*df.columns)).alias("line")).mapInArrow(headed, "line string").write.mode("overwrite").text(path)


def blind_export(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``columns``; refuses input that carries a hidden column or lacks a wanted one."""
    leaked = sorted(set(HIDDEN_COLUMNS) & set(df.columns))
    if leaked:
        raise HiddenColumnError(f"forbidden columns: {leaked}")
    return require_columns(df, columns).select(*columns)


def folder_export(df: DataFrame, folder: str, order: str, fields: list[str]) -> DataFrame:
    """One placemark row per item with its folder ordinal and position inside the folder.

    Rows stay separate (a folder is never gathered into one value); writers sort by the two ordinals.
    """
    from pyspark.sql import Window

    starts = df.groupBy(folder).agg(F.min(order).alias("_start"))
    ranked = starts.withColumn("folder_no", F.row_number().over(Window.orderBy("_start")))
    placed = df.join(F.broadcast(ranked.select(folder, "folder_no")), folder)
    return placed.select(folder, "folder_no", F.col(order).alias("item_no"), F.struct(*fields).alias("placemark"))


def xml_escape(c):
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def placemark_text(name, url, ring):
    """Placemark markup of one item: name, link, and the closed outer ring with seven decimals."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    coords = F.array_join(F.transform(closed, lambda p: F.format_string("%.7f,%.7f,0", p.x, p.y)), " ")
    return F.concat(
        F.lit("<Placemark><name>"),
        xml_escape(name),
        F.lit("</name><description>"),
        xml_escape(url),
        F.lit("</description><coordinates>"),
        coords,
        F.lit("</coordinates></Placemark>"),
    )
