"""The crawl's frontier and politeness as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.frontier import DELAY_S, PARTITIONS, prepared

#: Keyed state on the executors' disks; set it before a stream starts.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def admitted(urls: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """A stream of urls(url, ...) -> canonical, crawlable URLs, each key once for as long as the stream's state lives."""
    return prepared(urls, partitions).dropDuplicates(["url_key"])


def polite(visits: DataFrame, delay: int = DELAY_S) -> DataFrame:
    """A stream of visits(host, at, seq) -> (host, seq, at, start): starts of a host are `delay` apart, over batches too.

    Nothing is dropped: a visit that must wait gets a later start.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        starts = []
        for at in rows["at"]:
            start = at if free is None else max(at, free)
            starts.append(start)
            free = start + delay
        state.update((int(free),))
        yield pd.DataFrame({"host": key[0], "seq": rows["seq"], "at": rows["at"], "start": starts})

    return visits.groupBy("host").applyInPandasWithState(run, "host string, seq long, at long, start long", "free long", "append", GroupStateTimeout.NoTimeout)


def host_metrics(fetches: DataFrame) -> DataFrame:
    """A stream of fetches(host, ok, ms, bytes) -> counts, failures, mean time and bytes by host."""
    return fetches.groupBy("host").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.avg("ms").alias("mean_ms"), F.sum("bytes").alias("bytes"))


class Monitor(StreamingQueryListener):
    """Keeps the last progress of each stream: rows in and out a second, rows of state."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.last[str(event.id)] = {}

    def onQueryProgress(self, event):
        p = event.progress
        self.last[str(p.id)] = {"batch": p.batchId, "in_per_s": p.inputRowsPerSecond, "done_per_s": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}

    def onQueryTerminated(self, event):
        pass
