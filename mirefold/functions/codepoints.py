"""Arrow strings as numpy arrays of code points, without a call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def explode_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column end to end, and the n+1 offsets.

    Nulls are empty here; the caller keeps the validity of the column.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = b"" if data is None else data.to_pybytes()[bounds[0] : bounds[-1]]
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32), offsets


def pack_codepoints(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse: a large_string array with the given n+1 offsets.

    UTF-8 widths come from comparisons on the code points, so the byte
    offsets are gathered from one running sum.
    """
    points = np.ascontiguousarray(points, dtype=np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(width, out=ends[1:])
    raw = points.tobytes().decode("utf-32-le").encode("utf-8")
    nulls = None if valid is None else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [nulls, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(raw)])
