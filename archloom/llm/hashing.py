"""Words of byte buffers, their 128-bit ids, and mixed hashes, vectorised."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Keys of the hashes; any values do.
SALT = b"archloom corpus."
LANES = np.random.default_rng(20_012).integers(1, 2**63, (2, 3), dtype=np.uint64) * U(2) + U(1)
#: Masks of the first n bytes of a little-endian 64-bit number.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
TABLE = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII capitals to small letters, on the values of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space."""
    space = np.ones(len(buffer) + 2, dtype=bool)
    space[1:-1] = IS_SPACE[buffer]
    change = np.flatnonzero(space[1:] != space[:-1])
    return change[::2], change[1::2]


def word_ids(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits for each word [start, end), as rows of two 64-bit numbers: the word itself and its length if it has at most
    15 bytes, else 120 bits of a salted BLAKE2b digest. Short words never clash, long ones not by their structure."""
    n = end - start
    padded = np.concatenate([buffer, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray(len(buffer) + 9, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    out = np.empty((len(start), 2), dtype=np.uint64)
    out[:, 0] = eight[start] & MASKS[np.minimum(n, 8)]
    out[:, 1] = (eight[np.minimum(start + 8, len(buffer))] & MASKS[np.clip(n - 8, 0, 7)]) | (np.minimum(n, 15).astype(np.uint64) << U(56))
    for i in np.flatnonzero(n > 15).tolist():
        out[i] = np.frombuffer(digest(buffer[start[i] : end[i]]), dtype="<u8")
        out[i, 1] |= U(0xFF << 56)
    return out


def digest(content) -> bytes:
    """128 bits that stand for a content wherever contents are only compared by name."""
    return blake2b(content, digest_size=16, salt=SALT).digest()


def scrambled(ids: np.ndarray, lane: int = 0) -> np.ndarray:
    """64 mixed bits of each word id; the two lanes together lose nothing of it in practice."""
    return mix(mix(ids[:, 0] ^ LANES[lane, 0]) + (ids[:, 1] ^ LANES[lane, 1]) * LANES[lane, 2])


def words_in(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ids of the words of a buffer."""
    start, end = word_spans(buffer)
    return start, word_ids(buffer, start, end)


def joined_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer with a line feed between, and where each starts (one more: the buffer's end)."""
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return (LOWER[buffer] if lower else buffer), at
