"""One key's share of a micro-batch in order, whatever its size.

Spark groups the rows of a stateful operator by key, not by time, and streams know no sort. So a worker cuts them into sorted
runs of ``RUN_BYTES`` on the executor's own disk and merges these; it holds one run, or one portion of each of ``FAN`` runs.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

RUN_BYTES = 32 << 20
FAN = 64
PLACE = "_place"


def in_order(chunks: Iterable[pd.DataFrame], schema: pa.Schema, by: list[str]) -> Iterator[pa.Table]:
    """The columns of ``schema`` in ascending order of ``by`` (integers), NULL last, equal rows as they came, as tables of at
    most about a run. NULL in a column that the schema does not let be NULL is an error. A share of less than a run stays in memory."""
    held, size, count = [], 0, 0
    by = [*by, PLACE]
    # The folders of Spark's own spills; they go with the application, should this worker not come to its end.
    local = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")
    with tempfile.TemporaryDirectory(prefix="order-", dir=local[os.getpid() % len(local)]) as folder:
        levels: list[list[str]] = []
        for chunk in chunks:
            rows = pa.Table.from_pandas(chunk[schema.names], schema, preserve_index=False).replace_schema_metadata()
            held.append(rows.append_column(PLACE, pa.array(np.arange(count, count + len(rows)))))
            size, count = size + held[-1].nbytes, count + len(rows)
            if size >= RUN_BYTES:
                _keep(levels, folder, iter([_sorted(held, by)]), by)
                held, size = [], 0
        runs = [_read(run) for level in reversed(levels) for run in level]
        if held:
            runs.append(iter(_portions(_sorted(held, by))))
        held = []
        for rows in _merge(runs, by):
            yield rows.drop_columns(PLACE)


def _sorted(tables: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(tables).combine_chunks().sort_by([(name, "ascending") for name in by])


def _portions(table: pa.Table) -> list[pa.Table]:
    """So small that one of each of ``FAN`` runs make a run."""
    rows = max(1, len(table) * (RUN_BYTES // FAN) // max(table.nbytes, 1))
    return [table.slice(first, rows) for first in range(0, len(table), rows)]


def _keep(levels: list[list[str]], folder: str, tables: Iterator[pa.Table], by: list[str], level: int = 0) -> None:
    """Write one more run; ``FAN`` runs of a level become one of the next, so that few are open at a time."""
    if level == len(levels):
        levels.append([])
    path = f"{folder}/{level}-{len(levels[level])}.arrow"
    writer = None
    for table in tables:
        writer = writer or pa.ipc.new_stream(path, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
        for portion in _portions(table):
            writer.write_table(portion.combine_chunks())
    writer.close()
    levels[level].append(path)
    if len(levels[level]) == FAN:
        _keep(levels, folder, _merge([_read(run) for run in levels[level]], by), by, level + 1)
        for run in levels[level]:
            os.remove(run)
        levels[level] = []


def _read(path: str) -> Iterator[pa.Table]:
    with pa.OSFile(path) as file, pa.ipc.open_stream(file) as reader:
        for batch in reader:
            yield pa.Table.from_batches([batch])


def _merge(runs: list[Iterator[pa.Table]], by: list[str]) -> Iterator[pa.Table]:
    """What is at or before the first end of a portion can be handed over: all that comes later is behind it."""
    open_runs = [(head, run) for run in runs if (head := next(run, None)) is not None]
    while open_runs:
        ends = [tuple(head[name][-1].as_py() for name in by) for head, _ in open_runs]
        bound = min(ends, key=lambda end: [(value is None, value or 0) for value in end])
        ready, left = [], []
        for head, run in open_runs:
            rows = _up_to(head, by, bound)
            ready.append(head.slice(0, rows))
            rest = head.slice(rows) if rows < len(head) else next(run, None)
            if rest is not None:
                left.append((rest, run))
        open_runs = left
        yield _sorted(ready, by)


def _up_to(table: pa.Table, by: list[str], bound: tuple) -> int:
    """How many rows of a sorted table are at or before the bound."""
    low, high = 0, len(table)
    for name, value in zip(by, bound):
        values = table[name].slice(low, high - low)
        filled = len(values) - values.null_count
        if value is None:
            low += filled
        else:
            numbers = values.slice(0, filled).to_numpy()
            low, high = low + int(numbers.searchsorted(value, "left")), low + int(numbers.searchsorted(value, "right"))
    return high
