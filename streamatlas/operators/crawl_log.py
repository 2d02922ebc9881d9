"""The landed fetches of a crawl, kept as the last fetch of every URL.

A landing is merged into a versioned table bucketed by URL: only the buckets of the URLs that landed are read and written again. Every fetch leaves
its outcome; a body over the limit is left out and told as too large, an empty one counts as no document. Adapters that are given `documents_of` see one
document per URL, whatever was fetched how often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed import catalogue as fc
from .versioned import Version, VersionedTable

FETCHES = "key string, source string, url string, part int, fetched_at timestamp, seq long, outcome string, body string"
MAX_BYTES = 8 << 20


class CrawlLog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, max_bytes: int = MAX_BYTES) -> None:
        self.table = VersionedTable(spark, root, FETCHES, "key", buckets)
        self.max_bytes = max_bytes

    def land(self, step: int, fetches: DataFrame) -> Version:
        """fetches: (source, url, part, fetched_at, seq, outcome, body); `seq` orders fetches of one time. A landing that comes twice changes nothing, and a fetch
        that is older than the one in the log never replaces it."""
        body, outcome = F.col("body"), F.coalesce("outcome", F.lit(fc.OK))
        too_large = F.octet_length(body) > self.max_bytes
        rows = fetches.select(
            F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("part", F.lit(0)).cast("string")).alias("key"),
            "source", "url", F.coalesce("part", F.lit(0)).alias("part"), F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.col("seq").cast("long").alias("seq"),
            F.when((outcome == fc.OK) & too_large, F.lit(fc.TOO_LARGE)).otherwise(outcome).alias("outcome"),
            F.when((outcome == fc.OK) & ~too_large & (body != ""), body).alias("body"),
        )
        return self.table.upsert(step, rows, ["fetched_at", "seq"])

    def last_fetches(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).drop("key")

    def documents_of(self, version: int | None = None) -> DataFrame:
        """(source, url, part, body) of the fetches that brought a document, the input of a build cycle."""
        return self.last_fetches(version).where(F.col("body").isNotNull()).select("source", "url", "part", "body")
