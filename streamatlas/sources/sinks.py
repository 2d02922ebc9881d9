"""Sinks: the versioned snapshot and the playlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


ENTRY_COLUMNS = ("id", "title", "category", "source", "source_page_url", "target_url")


def snapshot_rows(entries: DataFrame) -> DataFrame:
    """One row per id: the later row wins, at the position of the first."""
    rest = [c for c in ENTRY_COLUMNS if c != "id"]
    row = F.struct("ord", *rest)
    out = entries.groupBy("id").agg(F.min("ord").alias("ord"), F.max(row).alias("_row"))
    return out.select("ord", "id", *[F.col("_row")[c].alias(c) for c in rest])


def write_snapshot(entries: DataFrame, root: str) -> int:
    """Write the next snapshot folder, then move the pointer to it. A reader sees the old or the new one, never a mix."""
    spark = entries.sparkSession
    version = (current_version(spark, root) or 0) + 1
    snapshot_rows(entries).write.mode("overwrite").parquet(f"{root}/snapshot={version}")
    pointer = spark.range(1).select(F.lit(version).cast("long").alias("version"))
    pointer.write.mode("append").parquet(f"{root}/_pointer_log")
    return version


def current_version(spark: SparkSession, root: str) -> int | None:
    try:
        row = spark.read.parquet(f"{root}/_pointer_log").agg(F.max("version")).first()
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise
    return row[0]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(f"{root}/snapshot={version}")


def playlist_lines(entries: DataFrame, base_url: str) -> DataFrame:
    """Playlist as rows (ord, line_no, line): the header row first, then two lines per entry."""
    title = F.col("title")
    info = F.concat(
        F.lit('#EXTINF:-1 tvg-id="'), F.col("id"), F.lit('" tvg-name="'), title,
        F.lit('" group-title="'), F.col("category"), F.lit('",'), title,
    )
    stream = F.concat(F.lit(f"{base_url}/stream/"), F.col("id"))
    body = entries.select("ord", F.posexplode(F.array(info, stream)).alias("line_no", "line"))
    header = entries.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("line_no"), F.lit("#EXTM3U").alias("line")
    )
    return header.unionByName(body)


def write_playlist(entries: DataFrame, base_url: str, path: str) -> None:
    """Text files whose names sort in playlist order; the range partitions of the sort keep the writers parallel."""
    playlist_lines(entries, base_url).orderBy("ord", "line_no").select("line").write.mode("overwrite").text(path)


