"""Arrow batches of whole texts, a few rows at a time, so that neither a Python worker nor the JVM holds the results of many."""

from collections.abc import Iterator

import pyarrow as pa

#: Rows of an Arrow batch of whole texts, and how many of them are worked on and returned at once.
SENT, AT_ONCE = 1000, 250


def few(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
