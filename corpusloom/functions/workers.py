"""Code for Python workers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

#: What a worker turns into objects at once: so many rows, and so many bytes of them as Arrow has them.
PART_ROWS, PART_BYTES = 256, 1 << 20


def ship(module: str) -> None:
    """Send the functions of a module to Python workers by value: they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def parts(column: pa.Array, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.Array]:
    """A batch's texts, or its lists of texts, in stretches of at most ``rows`` rows and ``size`` bytes, or one longer row.

    A batch has up to 10,000 rows, however long; Python's objects for all of them would outweigh it many times.
    """
    at = 0
    while at < len(column):
        n = min(rows, len(column) - at)
        while n > 1 and _bytes(column.slice(at, n)) > size:
            n = -(-n // 2)
        yield column.slice(at, n)
        at += n


def _bytes(column: pa.Array) -> int:
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return pc.sum(pc.binary_length(flat)).as_py() or 0


def joined(pieces: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


ship(__name__)
