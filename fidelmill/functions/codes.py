"""Many texts as one array of code points, so that what is done to each character is done to all at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are handled at once, about: a worker's memory follows them, not a batch or a partition.
CHARACTERS = 1 << 16
BREAK = 10


def parcels(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of parcels of about ``CHARACTERS``; a longer text is one by itself."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if held and size + len(t or "") > CHARACTERS:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield at, held


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a line break, and the places of these breaks; null is as empty."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    whole = "".join([(t or "") + "\n" for t in texts])
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths + 1) - 1


def strings(codes: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Arrow strings of code points that lie one after another without breaks, each up to one of ``ends``."""
    widths = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
    data = codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    sizes = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
    offsets = np.concatenate(([0], sizes[ends])).astype(np.int32)
    out = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))
    return out if null is None or not null.any() else pc.if_else(pa.array(~null), out, None)
