"""Words of texts as byte spans with 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

#: Bytes that are hashed at a time.
PIECE = 1 << 20
#: Bytes above which a span is hashed alone.
LONG_SPAN = 64
BASE = 0x9E3779B97F4A7C15
#: Words: everything but U+0020 and U+0009 to U+000D.
WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
#: Letters and digits; bytes outside ASCII count as letters.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
ALPHA = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(n, BASE, dtype=np.uint64)
    inverse = np.full(n, pow(BASE, -1, 2**64), dtype=np.uint64)
    power[0] = inverse[0] = 1
    return np.cumprod(power), np.cumprod(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, (n + 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are inside."""
    edge = np.diff(inside[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time are mixed in, long spans go through XXH3."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    out = mix(size.astype(np.uint64) + np.uint64(BASE))
    live = np.flatnonzero(size <= LONG_SPAN)
    for at in range(0, LONG_SPAN, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        chunk, left = eight[starts[live] + at], size[live] - at
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] * np.uint64(BASE) ^ chunk)
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes())
    return out


def words(data: bytes, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text of any length."""
    out, at, all_bytes = [], 0, np.frombuffer(data, dtype=np.uint8)
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and inside[data[end - 1]]:  # no word is cut
            end += 1
        piece = all_bytes[at:end]
        starts, ends = spans(piece, inside)
        out.append((starts + at, ends + at, span_hash(piece, starts, ends)))
        at = end
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Neighbouring texts as blocks of about limit bytes: the first one's number, the block, where each text starts and the last ends; \\n stands between them."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < limit):
            size += len(texts[upto]) + 1
            upto += 1
        block = b"\n".join(texts[at:upto]) + b"\n"
        yield at, block, np.cumsum([0] + [len(t) + 1 for t in texts[at:upto]])
        at = upto


def grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the sequences of n words that start at each word but the last n - 1."""
    if len(word_hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = powers(len(word_hashes))
    total = np.zeros(len(word_hashes) + 1, dtype=np.uint64)
    np.cumsum(word_hashes * power[: len(word_hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(word_hashes) - n + 1])
