"""Timed micro-batches of jobs: a batch goes out once it is full or its first job has waited long enough.

Jobs are dealt to ``queues``; each queue's waiting jobs are its state, so a stream that
stops goes on from its checkpoint with the jobs that were waiting, and each job is in one
batch. A timer on processing time lets out a batch that doesn't fill up. ``run_batches``
hands a batch to a sink that may see it again after a failure, under the same number:
batches have names made of their queue and a count, so the sink can tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIZE, WAIT_MS = 10, 100
BATCH = "queue int, number long, jobs array<long>, full boolean"
_STATE = "waiting array<long>, next long"


def batched_jobs(jobs: DataFrame, size: int = SIZE, wait_ms: int = WAIT_MS, queues: int = 8) -> DataFrame:
    """queue, number, jobs, full: batches of a stream's job ids (id), in order of arrival, ids within a micro-batch in order of priority (higher first) and id."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, number = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        found = []
        if state.hasTimedOut:
            found.append((key[0], number, waiting, False))
            waiting, number = [], number + 1
        else:
            rows = pd.concat(list(frames)).sort_values(["priority", "id"], ascending=[False, True])
            waiting += rows["id"].tolist()
            while len(waiting) >= size:
                found.append((key[0], number, waiting[:size], True))
                waiting, number = waiting[size:], number + 1
        state.update((waiting, number))
        if waiting:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(found, columns=["queue", "number", "jobs", "full"])

    dealt = jobs.select(F.pmod(F.xxhash64("id"), F.lit(queues)).cast("int").alias("queue"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"))
    return dealt.groupBy("queue").applyInPandasWithState(run, BATCH, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_batches(batches: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "100 milliseconds") -> StreamingQuery:
    return batches.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
