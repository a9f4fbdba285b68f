"""Sets of word shingles as 64-bit hashes, whole batches of text at a time in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_RNG = np.random.default_rng(20240607)
_MIX = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes whose words are Python objects at a time.
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[bytes]) -> np.ndarray:
    """[word, 2]: 128 bits of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)


def _pieces(data: bytes):
    """data in pieces of _PIECE bytes, cut at a separator."""
    at = 0
    while len(data) - at > _PIECE:
        end = at + _PIECE
        while end > at and not _SPACE[data[end - 1]]:
            end -= 1
        if end == at:  # one word longer than a piece
            end = at + _PIECE
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _as_bytes(t: str | bytes | None) -> bytes:
    """A-Z lower-cased; bytes.lower() and bytes.split() know ASCII only, as the contract's words do."""
    return (t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")).lower()


def shingle_hashes(texts: list[str | bytes | None], width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct hashes of its shingles of width words, and a second hash of each; a text of fewer
    words is one shingle; a text without words, or null, has none."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    words: list[bytes] = []
    bounds, held = [0], 0

    def flush() -> None:
        nonlocal held
        if len(bounds) > 1:
            out.extend(_sets(_hashed(words), bounds, width))
            words.clear()
            bounds[:] = [0]
            held = 0

    for t in texts:
        b = _as_bytes(t)
        if len(b) >= _PIECE // 2:
            flush()
            h = np.concatenate([_hashed(p.split()) for p in _pieces(b)])
            out.extend(_sets(h, [0, len(h)], width))
            continue
        if held + len(b) > _PIECE:
            flush()
        words.extend(b.split())
        bounds.append(len(words))
        held += len(b) + 1
    flush()
    return out


def shingle_sets(texts: list[str | bytes | None], width: int = 5) -> list[np.ndarray]:
    return [s for s, _ in shingle_hashes(texts, width)]


def set_digest(s: np.ndarray, second: np.ndarray) -> bytes:
    """16 bytes that tell a set of shingles from any other, by 128 bits of each."""
    return hashlib.blake2b(s.tobytes() + second.tobytes(), digest_size=16).digest()


def _sets(words: np.ndarray, bounds: list[int], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    n = len(words)
    rolled = np.zeros((max(0, n - width + 1), 2), np.uint64)
    if n >= width:
        for k in range(width):
            rolled += mix(words[k : n - width + 1 + k] ^ _MIX[k]) * _MIX[k]
        rolled = mix(rolled)
    out = []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - s >= width:
            found, at = np.unique(rolled[s : e - width + 1, 0], return_index=True)
            out.append((found, rolled[s + at, 1]))
        elif e > s:
            short = np.full((1, 2), e - s, np.uint64)
            for k in range(e - s):
                short += mix(words[s + k : s + k + 1] ^ _MIX[k]) * _MIX[k]
            short = mix(short)
            out.append((short[:, 0], short[:, 1]))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


class Words:
    """A text's words by position, and where each of its shingles is first, for comparing shingles word by word."""

    def __init__(self, text: str | bytes | None, width: int = 5):
        self.data = _as_bytes(text)
        space = np.concatenate(([True], _SPACE[np.frombuffer(self.data, dtype=np.uint8)], [True]))
        edge = np.diff(space.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.width = min(width, len(self.starts))
        h = np.concatenate([_hashed(p.split()) for p in _pieces(self.data)])
        if len(h) >= width:
            rolled = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                rolled += mix(h[k : len(h) - width + 1 + k, 0] ^ _MIX[k]) * _MIX[k]
            self.hashes, self.first = np.unique(mix(rolled), return_index=True)
        else:
            self.hashes, self.first = _sets(h, [0, len(h)], width)[0][0], np.zeros(min(1, len(h)), np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def shingle(self, at: int) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(self.starts[at : at + self.width], self.ends[at : at + self.width], strict=True)]

    def common(self, other: Words) -> int:
        """Shingles of both, equal word by word."""
        _, i, j = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        return sum(self.shingle(a) == other.shingle(b) for a, b in zip(self.first[i].tolist(), other.first[j].tolist(), strict=True))


class MinHasher:
    """n minima over linear hashes of a set; 32 bits are kept of each."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def __call__(self, s: np.ndarray, block: int = 4096) -> np.ndarray:
        low = None
        for at in range(0, len(s), block):
            x = s[at : at + block]
            m = (x[None, :] * self.a[:, None] + self.b[:, None]).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
