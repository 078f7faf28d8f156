"""A ledger of first-seen hashes, so that a day's run does not group all history again.

The ledger is a Parquet table, partitioned by day and bucketed by hash. A run reads the hash column of
the days before its own, bucket by bucket and without an exchange; where the day is small beside the
history, Spark's runtime filter is built from the day's hashes, since the lookup is a semi join. A
day's run overwrites that day's partition only and never looks at its own or later days, so one that
runs again after a failure gives the same rows. A day whose events change has to be followed by the
runs of all later days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import funnel as Fu
from turnwise.session import cut_lineage


class SeenLedger:
    """First event of each hash in order of (day, event).

    `table` is the name in the session's catalog; `path` is the shared folder of the ledger, which a later
    session opens under the same number of buckets. `buckets` is to grow with the expected
    history, about one for each 10 million hashes, and to be no less than `spark.sql.shuffle.partitions`:
    Spark exchanges a table of fewer buckets.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 32):
        self.spark, self.table = spark, table
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (hash STRING, event BIGINT, day DATE) USING parquet "
            f"PARTITIONED BY (day) CLUSTERED BY (hash) SORTED BY (hash) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def rows(self) -> DataFrame:
        """(hash, event, day) of all hashes seen."""
        return self.spark.table(self.table)

    def fresh(self, refs: DataFrame, day: dt.date) -> DataFrame:
        """(hash, event) of the hashes in `refs` (hash, event) that no earlier day has, each at its smallest event.

        Null hashes are none. Repeated rows count once; an empty table gives none.
        """
        firsts = cut_lineage(refs.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("event").alias("event")))
        earlier = self.rows().filter(F.col("day") < F.lit(day)).select("hash")
        known = earlier.join(firsts.select("hash"), "hash", "left_semi")
        return firsts.join(known, "hash", "left_anti")

    def advance(self, refs: DataFrame, day: dt.date) -> DataFrame:
        """Write the day's fresh hashes over its partition and return them."""
        found = cut_lineage(self.fresh(refs, day).select("hash", F.col("event").cast("long").alias("event")))
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (day = '{day:%Y-%m-%d}') SELECT hash, event FROM {{found}}", found=found)
        return self.rows().filter(F.col("day") == F.lit(day)).select("hash", "event")

    def weigh(self, events: DataFrame, hashes: str, event: str, day: dt.date) -> DataFrame:
        """The day's events with `hash_refs` and `weight`, as `funnel.event_weights` gives them over all days."""
        refs = Fu.event_hashes(events, hashes, event)
        firsts = self.advance(refs.select("hash", F.col(event).alias("event")), day)
        return Fu.weighed(events, refs, firsts.withColumnRenamed("event", event), event)
