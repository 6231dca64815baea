"""64-bit hashes of words, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * M2
    x = (x ^ (x >> U(29))) * M1
    return x ^ (x >> U(32))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Words over this many bytes are hashed one by one.
_LONG = 512


#: Which bytes belong to words: all but ASCII white space; or only digits, letters and whatever is above ASCII.
SPACED = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])
LETTERS = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than ASCII white space, A-Z lowered) and, per text, where its words end."""
    return word_places(texts)[:2]


def word_places(texts: list[str | None], inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes of ``inside``, A-Z lowered); per text, where its words end; the lowered texts in one, and the words' starts and sizes in it."""
    parts = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    data = b"\n".join(parts) + b"\n" + bytes(8)
    raw = np.frombuffer(data, np.uint8, len(data) - 8)
    word = inside[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(raw) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    upto = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))
    eights = np.ndarray((len(raw),), "<u8", data, strides=(1,))  # the eight bytes from each place on
    out = sizes.astype(U) * M3
    rest = np.flatnonzero(sizes <= _LONG)
    at, left = starts[rest], sizes[rest]
    while len(rest):
        out[rest] = mix((out[rest] ^ (eights[at] & _MASKS[np.minimum(left, 8)])) * M1)
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return out, upto, data, starts, sizes
