"""The change journal as a stream: each batch is folded into the entries of the drives it names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quarry.operators import cdc
from quarry.sources import entries as source
from quarry.storage import shared_dir


class Maintainer:
    """Entries kept current by foreachBatch: the fold of a batch rewrites the drives that it names, and no others.

    All state is in the shared folder ``place``: a folder for each drive and batch that changed it, and a marker of
    the last finished batch.  A batch that Spark delivers again, after a restart too, finds the marker and does
    nothing; one that broke off is written anew.
    """

    def __init__(self, spark: SparkSession, place: str, schema: str):
        self.spark, self.place, self.schema = spark, place, schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(place).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(place))

    def start(self, entries: DataFrame) -> None:
        """What there is before the first batch (number -1); does nothing if it was done before."""
        if self.done() is None:
            self.commit(entries, [r[0] for r in entries.select("drive").distinct().collect()], -1)

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.files.listStatus(self.path(self.place))]

    def done(self) -> int | None:
        """The last finished batch."""
        return max((int(n.removeprefix("done")) for n in self.names() if n.startswith("done")), default=None)

    def written(self) -> dict[str, list[tuple[int, str]]]:
        """Of each drive the folders that finished batches left, oldest first."""
        done, out = self.done(), {}
        for name in self.names():
            if name.startswith("entries_") and done is not None:
                _, number, drive = name.split("_", 2)
                if int(number) <= done:
                    out.setdefault(drive, []).append((int(number), name))
        return {drive: sorted(found) for drive, found in out.items()}

    def entries(self, drives: list[str] | None = None) -> DataFrame:
        """The entries as they are now; of some drives alone if they are named."""
        paths = [f"{self.place}/{found[-1][1]}" for drive, found in sorted(self.written().items()) if drives is None or drive in drives]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, drives: list[str], number: int) -> None:
        """Write the drives, then the marker; what it makes old goes, but for the version before, which may be in use."""
        for drive in drives:
            rows.where(F.col("drive") == drive).write.mode("overwrite").parquet(f"{self.place}/entries_{number}_{drive}")
        self.files.create(self.path(f"{self.place}/done{number}")).close()
        old = [name for found in self.written().values() for _, name in found[:-2]]
        for name in old + [n for n in self.names() if n.startswith("done") and n != f"done{number}"]:
            self.files.delete(self.path(f"{self.place}/{name}"), True)

    def publish(self, batch: DataFrame, number: int) -> None:
        """Idempotent for a batch that Spark delivers again."""
        done = self.done()
        if done is None or number > done:
            drives = [r[0] for r in batch.select("drive").distinct().collect()]
            names = [c.split()[0] for c in self.schema.split(", ")]
            self.commit(cdc.fold(self.entries(drives), batch).select(*names), drives, number)


def fold_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold all journal records that are there now, through a streaming query."""
    events = source.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    ops = source.journal_of(stream).where("is_close").drop("is_close")
    place = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    keeper = Maintainer(spark, f"{place}/entries", f"drive string, record long, {cdc.LINK_TYPE}, name_lower string")
    run = ops.writeStream.foreachBatch(keeper.publish).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return keeper.entries()


def replay_with_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState: one record's links are the state; the links after a batch come out."""
    rows = pd.concat(list(batches)).sort_values("usn")
    links = [dict(zip(cdc.LINK, map(cdc.plain, x))) for x in state.get[0]] if state.exists else []
    links = cdc.replay(links, [{k: cdc.plain(v) for k, v in r.items()} for r in rows.to_dict("records")])
    state.update(([tuple(x[f] for f in cdc.LINK) for x in links],))
    yield pd.DataFrame([(*key, x["parent"], x["name"]) for x in links], columns=["drive", "record", "parent", "name"])
