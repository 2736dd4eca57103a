"""Ordered folds: one pass over each group's sorted rows, with nothing but the state kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable, end: Callable | None, schema: str) -> DataFrame:
    """Rows are dealt by ``by`` and sorted within; of each group, in order, ``step(state, row)`` gives the rows to put out
    (tuples of schema's columns), and ``end(state, key)`` those at its end. A group of any length streams through a task."""
    width = len(by)
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        key, state = None, None
        for frame in frames:
            out: list[tuple] = []
            for row in frame[columns].itertuples(index=False):
                now = tuple(getattr(row, b) for b in by) if width > 1 else getattr(row, by[0])
                if state is None or now != key:
                    if state is not None and end:
                        out += end(state, key)
                    key, state = now, start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if state is not None and end:
            yield pd.DataFrame(end(state, key), columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
