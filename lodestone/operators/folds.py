"""Folds whose order matters: one group's rows stream through a task in order, with a state of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def in_order(rows: DataFrame, group: str, order: list[str], reads: list[str], adds: dict[str, tuple[str, pa.DataType]], start: Callable[[], object], step: Callable) -> DataFrame:
    """rows with the columns of adds (name -> SQL type, Arrow type). For each row of a group, in order, step(state, values of reads) gives the next state and the new values; start() is a group's first state. No group is ever held as a whole."""
    names = [*rows.columns, *adds]
    at = [rows.columns.index(c) for c in (group, *reads)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            new: list[tuple] = []
            for key, *values in zip(*(batch.column(i).to_pylist() for i in at)):
                if key != last:
                    last, state = key, start()
                state, out = step(state, *values)
                new.append(out)
            columns = zip(*new) if new else [()] * len(adds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t) in zip(columns, adds.values()))], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} {t}" for n, (t, _) in adds.items()])
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
