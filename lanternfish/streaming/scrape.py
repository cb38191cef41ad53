"""A scrape that goes on where it stopped: a stream of listed titles, whose lookups are upserted by title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lanternfish.operators import ingest
from lanternfish.sources import remote
from lanternfish.sources.scratch import written
from lanternfish.sources.snapshots import Table

LISTED = StructType([StructField("key", StringType()), StructField("category", StringType()), StructField("title", StringType()), StructField("level", IntegerType()), StructField("pos", IntegerType())])
SAID = StructType([StructField("title", StringType()), *(StructField(n, IntegerType() if n in ("width", "height") else StringType()) for n in remote.INFO), StructField("failure", StringType())])


class Scrape:
    """Titles of categories and what a service says of them, kept at ``path``: the listing's checkpoint, and two tables, of what was
    listed, by category and title, and of what was said, by title. A batch that died is listed and asked again, and upserts the
    same rows; titles that are known are not asked again, whichever run or category named them first."""

    def __init__(self, spark: SparkSession, client: str, path: str):
        self.spark, self.client, self.path = spark, client, path.rstrip("/")
        self.listed = Table(spark, f"{self.path}/listed", LISTED, key="key", group="category")
        self.said = Table(spark, f"{self.path}/said", SAID, key="title", group="failure")

    def _take(self, batch: DataFrame, number: int = 0) -> None:
        rows = written(batch, "listed")  # a page; asked once, however often it is read
        known = self.said.snapshot().read().where("failure is null").select("title")
        new = rows.select("title").distinct().join(known, "title", "left_anti")
        self.said.upsert(remote.outcomes(new, self.client))
        self.listed.upsert(rows.withColumn("key", F.concat_ws("\n", "category", "title")))

    def run(self, categories: list[str], most: int) -> None:
        """List and ask until the listing ends, from where the last run stopped. What was listed is the same whether runs are interrupted or not."""
        stream = remote.stream_categories(self.spark, self.client, categories, most)
        query = stream.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.path}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def retry(self) -> int:
        """Ask again for the titles that failed; how many still do."""
        failed = written(self.said.snapshot().read().where("failure is not null").select("title"), "failed")
        if not failed.isEmpty():
            self.said.upsert(remote.outcomes(failed, self.client))
        return self.said.snapshot().read().where("failure is not null").count()

    def failures(self) -> DataFrame:
        """(failure, n) of the titles that are listed and have no answer."""
        return remote.failures(self.said.snapshot().read())

    def taken(self, phrases: DataFrame, offset: int, target: int, load: DataFrame | None = None, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Annotations and notes of what the scrape has so far (``ingest.scraped``): each url once, and none of ``seen`` (url), in the order of
        categories and places. ``phrases`` is (category, phrase)."""
        rows = self.listed.snapshot().read().select("category", "title", F.struct("level", "pos").alias("place")).join(phrases, "category")
        return ingest.scraped(rows, self.said.snapshot().read().drop("failure"), ["category", "place"], offset, target, load, seen)
