"""A binary file of token ids in patched frame-of-reference blocks.

A file is a sequence of frames, so that a writer holds one frame at a time. A frame has
whole documents; its ids, document after document, are cut into blocks of 256.

    frame   = magic "TOKPFOR1", counts, arrays, crc32 of everything before it
    counts  = 5 unsigned 64-bit: documents, ids, blocks, exceptions, packed words
    arrays  = document ids (int64), null flags (uint8), ids per document (int64),
              per block: minimum (uint32), width (uint8), exceptions (uint16), start of its
              packed words (uint64, the index),
              per exception: place in the block (uint8), value above the minimum (uint32),
              packed words (uint64)

All numbers are little-endian. A block's values have the minimum taken away and are
packed at the width of one of the ``PERCENTILES`` of their bit lengths, whichever makes
the block smallest; wider values are exceptions, stored whole on the list (their packed bits
are zero). Groups of 64 values fill exactly
``width`` words. The last block is padded with its minimum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"TOKPFOR1"
BLOCK = 256
#: Shares of a block's values that its width may be chosen to hold.
PERCENTILES = (0.75, 0.9, 0.97, 1.0)
#: Bytes of an exception on the list.
_EXCEPTION = 5
_GROUP = 64


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of unsigned 32-bit values."""
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(groups, 64) values of at most ``width`` bits → (groups, width) words."""
    out = np.zeros((len(rows), width), dtype=np.uint64)
    for i in range(_GROUP):
        word, shift = divmod(i * width, 64)
        v = rows[:, i]
        out[:, word] |= v << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(words), _GROUP), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(_GROUP):
        word, shift = divmod(i * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = v & mask
    return out


def _widths(bits: np.ndarray) -> np.ndarray:
    ranked = np.sort(bits, axis=1)
    choices = np.stack([ranked[:, int(np.ceil(p * BLOCK)) - 1] for p in PERCENTILES], axis=1)
    over = (bits[:, None, :] > choices[:, :, None]).sum(axis=2)
    best = np.argmin(choices.astype(np.int64) * (BLOCK // 8) + over * _EXCEPTION, axis=1)
    return choices[np.arange(len(bits)), best]


def encode_frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """``ids``: unsigned 32-bit, the documents' ids one after another."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros((blocks, BLOCK), dtype=np.uint32)
    values.reshape(-1)[:n] = ids
    if n % BLOCK:
        values[-1, n % BLOCK :] = values[-1, : n % BLOCK].min()
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    values -= low[:, None]
    bits = _bits(values)
    width = _widths(bits)
    odd = bits > width[:, None]
    at_block, at_place = np.nonzero(odd)
    odd_values = values[at_block, at_place]
    values[at_block, at_place] = 0
    starts = np.concatenate([[0], np.cumsum(width.astype(np.uint64) * (BLOCK // _GROUP))]).astype(np.uint64)
    packed = np.zeros(int(starts[-1]), dtype=np.uint64)
    for w in np.unique(width):
        if w:
            which = np.nonzero(width == w)[0]
            words = _pack(values[which].reshape(-1, _GROUP).astype(np.uint64), int(w)).reshape(len(which), -1)
            packed[starts[which].astype(np.int64)[:, None] + np.arange(words.shape[1])] = words
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    body = b"".join((
        MAGIC, struct.pack("<5Q", len(doc_ids), n, blocks, len(odd_values), len(packed)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), null.tobytes(), np.asarray(lengths, dtype="<i8").tobytes(),
        low.astype("<u4").tobytes(), width.astype("u1").tobytes(), np.bincount(at_block, minlength=blocks).astype("<u2").tobytes(), starts[:-1].astype("<u8").tobytes(),
        at_place.astype("u1").tobytes(), odd_values.astype("<u4").tobytes(), packed.astype("<u8").tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def read_frames(f) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, ids per document, ids) of every frame of an open file."""
    head = len(MAGIC) + 40
    while first := f.read(head):
        if len(first) < head or not first.startswith(MAGIC):
            raise ValueError("not a token file, or cut short")
        docs, n, blocks, odd, words = struct.unpack("<5Q", first[len(MAGIC) :])
        rest = f.read(docs * 17 + blocks * 15 + odd * 5 + words * 8 + 4)
        if len(rest) != docs * 17 + blocks * 15 + odd * 5 + words * 8 + 4 or zlib.crc32(rest[:-4], zlib.crc32(first)) != struct.unpack("<I", rest[-4:])[0]:
            raise ValueError("a frame is damaged")
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(rest, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
        low, width, exceptions, starts = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks)
        places, odd_values, packed = take("u1", odd), take("<u4", odd), take("<u8", words)
        values = np.zeros((blocks, BLOCK), dtype=np.uint32)
        for w in np.unique(width):
            if w:
                which = np.nonzero(width == w)[0]
                got = packed[starts[which].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // _GROUP))]
                values[which] = _unpack(got.reshape(-1, int(w)), int(w)).reshape(len(which), BLOCK)
        values[np.repeat(np.arange(blocks), exceptions), places] = odd_values
        values += low[:, None]
        yield [None if z else int(d) for d, z in zip(doc_ids, null)], lengths, values.reshape(-1)[:n]
