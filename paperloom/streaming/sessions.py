"""Arrivals of a stream, held back until their source has been quiet.

A scan batch is a session of one source: its pages come in any number of
micro-batches and leave together once nothing came for the quiet period.  The
state of a source is what its open session holds, at most one scan batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .batches import QUIET

_OUT = "source string, session string, record string"
_STATE = "records array<string>"


def _milliseconds(period: str) -> int:
    number, unit = period.split()
    return round(float(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])


def close_sessions(rows: DataFrame, source: str, quiet: str = QUIET) -> DataFrame:
    """The rows of a stream with ``session``, once their ``source`` was quiet for the period.

    Time is the cluster's, so a last session closes without later rows; a stream
    that is stopped keeps open sessions in its checkpoint.  A session is named by
    what it holds, so a repeated micro-batch gives it the same name.
    """
    wait = _milliseconds(quiet)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            name = hashlib.sha256("\n".join(sorted(held)).encode()).hexdigest()[:16]
            yield pd.DataFrame({"source": [key[0]] * len(held), "session": [name] * len(held), "record": held})
            return
        for frame in frames:
            held += frame["record"].tolist()
        state.update((held,))
        state.setTimeoutDuration(wait)

    packed = rows.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.to_json(F.struct("*")).alias("record"))
    closed = packed.groupBy("source").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return closed.select("session", F.from_json("record", rows.schema).alias("r")).select("r.*", "session")
