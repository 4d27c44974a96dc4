"""One small result from all rows of a frame: folded in tasks, then into each other."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: States that reach the driver at most.
FOLDED = 32
S = TypeVar("S")
KIND = pa.schema([("place", pa.int32()), ("state", pa.binary())])
SCHEMA = "place int, state binary"


def fold(df: DataFrame, add: Callable[[S | None, np.ndarray], S], merge: Callable[[S, S], S]) -> S | None:
    """The state that ``add`` builds from the rows of ``df`` (doubles without NULL, one line a row); None without rows.

    Each task sends one state, so states must not grow with the rows. They are merged in ``FOLDED`` groups and then on the
    driver. ``merge`` must not depend on the order.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(state, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        if state is not None:
            yield packed(TaskContext.get().partitionId() % FOLDED, state).to_batches()[0]

    def packed(place: int, state: S) -> pa.Table:
        return pa.Table.from_pylist([{"place": place, "state": pickle.dumps(state)}], schema=KIND)

    def merged(group: pa.Table) -> pa.Table:
        return packed(0, reduce(merge, map(pickle.loads, group.column("state").to_pylist())))

    found = df.mapInArrow(local, SCHEMA).groupBy("place").applyInArrow(merged, SCHEMA).collect()
    return reduce(merge, [pickle.loads(r["state"]) for r in found]) if found else None
