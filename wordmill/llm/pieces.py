"""Ids of texts by way of their distinct pieces.

The pieces of a slice of texts are told apart in Arrow, so that Python sees each distinct
piece of a slice once, and an encoder is asked once for each piece that is not remembered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class PieceMemory:
    """What ``ask`` said about pieces, in two generations of at most ``limit`` each.

    When the young generation is full it becomes the old one, and what was not wanted again
    by then is forgotten; so memory is bounded, and new pieces are always taken in.
    """

    def __init__(self, ask: Callable[[list[str]], list[bytes]], limit: int) -> None:
        self._ask, self._limit = ask, limit
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def __call__(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self._young.get, pieces))
        missing = [i for i, f in enumerate(found) if f is None]
        new = [i for i in missing if pieces[i] not in self._old]
        for i, ids in zip(new, self._ask([pieces[i] for i in new])):
            found[i] = ids
        for i in missing:
            if found[i] is None:
                found[i] = self._old[pieces[i]]
        for i in missing:
            if len(self._young) >= self._limit:
                self._old, self._young = self._young, {}
            self._young[pieces[i]] = found[i]
        return found


def concatenated(values: pa.Array, which: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Entries ``which`` of ``values`` (binary), put together run by run: ``lengths`` of them each."""
    taken = values.take(which)
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])


def between_spaces(texts: pa.Array, odd: str, cut: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, number of pieces of each) between single spaces; texts that
    match ``odd`` (a regular expression of Arrow's) are left to ``cut``. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    which = np.flatnonzero(pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False))
    if not len(which):
        lists = pc.split_pattern(texts, " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy()
    parts, lengths, at = [], [], 0
    for i in (*which.tolist(), len(texts)):
        if i > at:
            lists = pc.split_pattern(texts[at:i], " ")
            parts.append(lists.flatten())
            lengths.append(pc.list_value_length(lists).to_numpy())
        if i < len(texts):
            parts.append(pa.array(cut(texts[i].as_py()), pa.large_string()))
            lengths.append(np.array([len(parts[-1])]))
        at = i + 1
    return pa.concat_arrays(parts), np.concatenate(lengths)
