"""Hashes of many byte strings at once.

`word_ids` gives words 64-bit ids under a key that is drawn for each run: without it nobody can
write words with equal ids, and by chance two words have one with a probability of 2**-64.
`range_hashes` mixes eight bytes at a time with public constants, so words with equal hashes can
be made: it may only deal features to bins. `Prefixes` gives every substring of a text its
hash in constant time by a polynomial modulo 2**64, which structured strings can make
collide: it may only propose what is then compared.
"""

from __future__ import annotations

import functools
import hashlib
import secrets

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Longer strings are hashed one by one.
LONG, SEED = 64, 0x5851F42D4C957F2D


def range_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[start:stop]; none of them may be empty."""
    padded = np.append(data, np.zeros(8, "u1"))
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # at every byte, that and the seven after it
    length = stops - starts
    h = mix(length.astype("u8") + np.uint64(SEED))
    for k in range(0, min(LONG, int(length.max(initial=0))), 8):
        now = np.flatnonzero(length > k) if k else slice(None)
        left = np.minimum(length[now] - k, 8).astype("u8")
        part = eight[starts[now] + k] & (np.uint64(2**64 - 1) >> ((np.uint64(8) - left) * np.uint64(8)))
        h[now] = mix(h[now] ^ part)
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes(), SEED)
    return h


def new_key() -> bytes:
    return secrets.token_bytes(16)


class WordIds(dict):
    """A task's ids of words; it forgets them when there are too many."""

    LIMIT = 500_000

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key
        self.secrets = np.frombuffer(hashlib.blake2b(b"words", digest_size=32, key=key).digest(), "<u8")

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        made = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        return made


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all words of joined texts, and each text's first among them."""
    if not len(data):
        return np.empty(0, "i8"), np.empty(0, "i8"), np.zeros(len(offsets), "i8")
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & _after_blank_or_start(blank, offsets))
    stops = np.flatnonzero(~blank & _before_blank_or_end(blank, offsets)) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def _after_blank_or_start(blank: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.ones(len(blank), bool)
    at[1:] = blank[:-1]
    at[offsets[offsets < len(blank)]] = True
    return at


def _before_blank_or_end(blank: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.ones(len(blank), bool)
    at[:-1] = blank[1:]
    inner = offsets[(offsets > 0) & (offsets <= len(blank))]
    at[inner - 1] = True
    return at


def word_ids(data: np.ndarray, offsets: np.ndarray, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words of joined texts, A-Z in lower case, and each text's first among them.

    A word of up to eight bytes is its bytes, mixed one to one under the key, so that no two of them are
    equal. Up to sixteen bytes are two such numbers, the first multiplied by a secret one. Longer
    words, and those with a zero byte, have digests.
    """
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, stops, first = word_spans(data, offsets)
    length = stops - starts
    plain = length <= 16
    if not data.all():
        zeros = np.concatenate([[0], np.cumsum(data == 0)])
        plain &= zeros[stops] == zeros[starts]
    padded = np.append(data, np.zeros(16, "u1"))
    eight = np.ndarray(len(data) + 9, "<u8", padded, 0, (1,))  # at every byte, that and the seven after it
    one, two, odd, _ = known.secrets

    def part(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at] & (np.uint64(2**64 - 1) >> ((np.uint64(8) - np.minimum(left, 8).astype("u8")) * np.uint64(8)))

    ids = mix(part(starts, length) ^ one)
    more = np.flatnonzero(plain & (length > 8))
    with np.errstate(over="ignore"):
        ids[more] = mix(ids[more] * (odd | np.uint64(1)) + mix(part(starts[more] + 8, length[more] - 8) ^ two))
    whole, others = data.tobytes(), np.flatnonzero(~plain)
    ids[others] = np.fromiter((known[whole[a:b]] for a, b in zip(starts[others].tolist(), stops[others].tolist(), strict=True)), "u8", len(others))
    return ids, first


@functools.cache
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype="u8"))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base**0 to base**(n-1), kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, "u8")
        have[0], filled, step = 1, 1, base
        with np.errstate(over="ignore"):
            while filled < size:
                have[filled : 2 * filled] = have[:filled] * step
                filled, step = 2 * filled, step * step
        _powers[name] = have
    return have[:n]


class Prefixes:
    """Hashes of any substrings of one byte array in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.empty(n + 1, "u8")
            self.sums[0] = 0
            np.cumsum(byte_values()[data] * powers(n, BASE, "up"), out=self.sums[1:])
        self.down = powers(n + 1, INVERSE, "down")

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype("u8") * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every substring of that width."""
        n = len(self.sums) - width
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width) * np.uint64(0xD6E8FEB86659FD93)) if n > 0 else np.empty(0, "u8")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column's values, joined, and their n + 1 offsets; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, "u1") if data else np.empty(0, "u1")
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts_by_bytes(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """Slices of a batch whose texts take about limit bytes together; a longer text is a slice of its own."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def shrink(a: np.ndarray) -> bytes:
    """An array's bytes, compressed; grown() gives them back."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def grown(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys, which compress better."""
    return np.diff(sorted_keys, prepend=np.uint64(0))
