"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """The one large object (a model or vocabulary, with what it remembers) that a worker keeps for its next tasks.

    Workers are reused by later stages, so the object of another key goes first.
    """
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For tasks that need no such object: drops what an earlier stage has left in this worker."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


#: Bytes of text that one numpy pass takes at a time; a longer text is a pass of its own.
PASS_BYTES = 2 << 20


def passes(texts: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each, one row at least."""
    sizes = np.frombuffer(texts.cast(pa.large_string()).buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + most, side="right")) - 1)
        yield low, min(high, len(texts))
        low = high


def filled(texts: pa.Array) -> pa.Array:
    """The texts with null as the empty text, from offset 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of large_string texts without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
