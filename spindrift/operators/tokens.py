"""Token counts, cuts and windows by a learned byte-pair vocabulary; without one, a token for each four characters (functions.text)."""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Different pieces whose token lengths a worker remembers, beside those of the texts at hand.
REMEMBERED = 1 << 18
#: Characters of the texts whose pieces are at hand together.
AT_HAND = 1 << 20
#: Bytes of the longest pieces that are merged together, and how many are.
SHORT, TOGETHER = 48, 1 << 14


@dataclass(frozen=True)
class Vocabulary:
    """ranks: a file of lines `base64(token) rank`, which says in what order bytes are merged; pattern: what pieces a text is cut into first."""

    ranks: tuple[tuple[bytes, int], ...]
    pattern: str

    @staticmethod
    def read(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
        """By Spark's reader, so that the file can be wherever Spark reads; a vocabulary has some 100,000 rows."""
        rows = spark.read.text(path).where("value <> ''").collect()
        pairs = (r["value"].split() for r in rows)
        return Vocabulary(tuple(sorted(((base64.b64decode(t), int(n)) for t, n in pairs), key=lambda x: x[1])), pattern)


class Encoder:
    """A worker's encoder: texts are cut into pieces, and each different piece is merged once while it is remembered; new pieces of many
    texts are merged together, length by length."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.ranks = dict(vocabulary.ranks)
        self.pieces = regex.compile(vocabulary.pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        # Tokens by number: 256 bytes, then what is made of two, by rank.
        made = sorted((t for t in self.ranks if len(t) > 1), key=self.ranks.get)
        number = {bytes([i]): i for i in range(256)} | {t: i for i, t in enumerate(made, 256)}
        self.size = len(number)
        pairs = sorted((number[t[:i]] * self.size + number[t[i:]], number[t]) for t in made for i in range(1, len(t)) if t[:i] in number and t[i:] in number)
        self.pairs, self.makes = np.array([*pairs, (np.iinfo(np.int64).max, self.size)], dtype=np.int64).T.copy()

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b make, self.size if none."""
        pair = a * self.size + b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.makes[at], self.size)

    def _together(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Byte lengths of the tokens of pieces of one length: in each step every piece's neighbours of the least rank are joined, those of
        pieces without any are done.  So the pieces of a step have as many tokens."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        token = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1).astype(np.int64)
        width, of, pair = np.ones_like(token), np.arange(len(pieces)), self._made(token[:, :-1], token[:, 1:])
        while pair.shape[1]:
            at = pair.argmin(axis=1)
            best = pair[np.arange(len(of)), at]
            go = best < self.size
            for i, w in zip(of[~go].tolist(), width[~go].tolist(), strict=True):
                out[i] = tuple(w)
            token, width, pair, of, at, best = token[go], width[go], pair[go], of[go], at[go], best[go]
            if not len(of):
                return out
            i = np.arange(len(of))
            token[i, at] = best
            width[i, at] += width[i, at + 1]
            stays = np.arange(token.shape[1]) != at[:, None] + 1
            token, width, pair = (x[y].reshape(len(of), -1) for x, y in ((token, stays), (width, stays), (pair, stays[:, 1:])))
            left, right = i[at > 0], i[at < pair.shape[1]]
            pair[left, at[left] - 1] = self._made(token[left, at[left] - 1], best[left])
            pair[right, at[right]] = self._made(best[right], token[right, at[right] + 1])
        for i, w in zip(of.tolist(), width.tolist(), strict=True):
            out[i] = tuple(w)
        return out

    def _alone(self, piece: bytes) -> tuple[int, ...]:
        """The same for one piece of any length, by a heap of neighbours."""
        n, rank = len(piece), self.ranks.get
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = stop[i]
            if not 0 < middle < n or stop[middle] != end:
                continue  # one of the two was joined otherwise
            stop[i], stop[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(piece[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if before[i] >= 0 and (r := rank(piece[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        return tuple(e - i for i, e in enumerate(stop) if e)

    def learn(self, pieces: Iterable[str]) -> None:
        """Let `known` have byte lengths of these pieces' tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()  # the pieces in use are soon known again
        alike: dict[int, list[tuple[str, bytes]]] = {}
        for p in set(pieces).difference(self.known):
            b = p.encode("utf-8", "surrogatepass")
            if b in self.ranks:
                self.known[p] = (len(b),)
            elif len(b) > SHORT:
                self.known[p] = self._alone(b)
            else:
                alike.setdefault(len(b), []).append((p, b))
        for group in alike.values():
            for i in range(0, len(group), TOGETHER):
                some = group[i : i + TOGETHER]
                self.known.update(zip((p for p, _ in some), self._together([b for _, b in some]), strict=True))

    def cut(self, texts: Iterable[str | None]) -> Iterator[tuple[str | None, list[str]]]:
        """Texts with their pieces, which are known until the next text is asked for; null texts have none."""
        held: list[str | None] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= AT_HAND:
                yield from self._cut(held)
                held, size = [], 0
        yield from self._cut(held)

    def _cut(self, texts: list[str | None]) -> Iterator[tuple[str | None, list[str]]]:
        split = [self.pieces.findall(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(split))
        return zip(texts, split, strict=True)

    def count(self, pieces: list[str]) -> int:
        """Tokens of known pieces."""
        return sum(map(len, map(self.known.__getitem__, pieces)))

    def lengths(self, text: str) -> list[int]:
        """Bytes of each token, in order."""
        pieces = self.pieces.findall(text)
        self.learn(pieces)
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def edges(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """The character before which each token begins, and the text's length; -1 where a token begins inside a character.  pieces: the text's, if known."""
        lengths = self.lengths(text) if pieces is None else list(chain.from_iterable(map(self.known.__getitem__, pieces)))
        at = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))])
        if text.isascii():
            return at
        head = np.concatenate([(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80, [True]])
        return np.where(head[at], np.cumsum(head)[at] - 1, -1)

    def first(self, text: str, pieces: list[str], tokens: int) -> str:
        """The text of the first tokens, whole characters only; a piece has a token at least, so no more pieces than tokens are looked at."""
        some = pieces[: max(tokens, 0)]
        head = text[: sum(map(len, some))]
        return head[: cut_left(self.edges(head, some), tokens)]

    def last(self, text: str, pieces: list[str], tokens: int) -> str:
        some = pieces[max(0, len(pieces) - max(tokens, 0)) :]
        tail = text[len(text) - sum(map(len, some)) :]
        return tail[cut_right(self.edges(tail, some), tokens) :]


def _down(edges: np.ndarray, i: int) -> int:
    """The last token at or before i that begins at a character."""
    while edges[i] < 0:
        i -= 1
    return i


def _up(edges: np.ndarray, i: int) -> int:
    while edges[i] < 0:
        i += 1
    return i


def cut_left(edges: np.ndarray, tokens: int) -> int:
    """Characters of the first `tokens` tokens; a character that is cut is left out."""
    return int(edges[_down(edges, min(max(tokens, 0), len(edges) - 1))])


def cut_right(edges: np.ndarray, tokens: int) -> int:
    return int(edges[_up(edges, max(0, len(edges) - 1 - max(tokens, 0)))])


def spans(edges: np.ndarray, width: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first character, last + 1, tokens) of windows of at most `width` tokens, each `overlap` tokens or a few more into the one before; a
    character of more tokens than a window is a window of its own.  The last window ends at the text's end."""
    out, last = [], len(edges) - 1
    i = 0
    while i < last:
        j = _down(edges, min(i + width, last))
        if j <= i:
            j = _up(edges, i + 1)
        out.append((int(edges[i]), int(edges[j]), j - i))
        if j == last:
            break
        i = max(_down(edges, max(j - overlap, 0)), _up(edges, i + 1))
    return out


#: A worker's encoder by its vocabulary's digest: kept from task to task, the last one only.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(digest: str, shared: Broadcast) -> Encoder:
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = Encoder(shared.value)
    return _ENCODERS[digest]


def _worker(vocabulary: Vocabulary):
    """A broadcast vocabulary and what makes the encoder of a worker of it, once."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(vocabulary)
    digest = hashlib.sha256(pickle.dumps(vocabulary)).hexdigest()
    return lambda: _encoder(digest, shared)


def count(text: Column, vocabulary: Vocabulary) -> Column:
    """Tokens; null texts have none."""
    encoder = _worker(vocabulary)

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([encoder().count(pieces) for _, pieces in encoder().cut(p)], dtype="int64")

    return run(text)


def truncate(text: Column, tokens: int, vocabulary: Vocabulary, side: str = "right") -> Column:
    """The text of the first tokens (side='right' cuts the end) or the last ones, whole characters only; null stays null."""
    encoder = _worker(vocabulary)
    if side not in ("left", "right"):
        raise ValueError("side is left or right")

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            one = encoder().first if side == "right" else encoder().last
            yield pd.Series([one(t, pieces, tokens) if t else t for t, pieces in encoder().cut(p)], dtype=object)

    return run(text)


def count_and_cut(text: Column, tokens: int, vocabulary: Vocabulary) -> Column:
    """A struct of count() (tokens) and of truncate() on either side (first, last): texts are encoded once for all, by one worker."""
    encoder = _worker(vocabulary)

    @F.arrow_udf("struct<tokens: long, first: string, last: string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            e = encoder()
            rows = [(e.count(pieces), e.first(t, pieces, tokens) if t else t, e.last(t, pieces, tokens) if t else t) for t, pieces in e.cut(x.as_py() for x in p)]
            columns = ([r[i] for r in rows] for i in range(3))
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["tokens", "first", "last"])

    return run(text)


#: Texts whose windows a worker holds at once.
TEXTS = 500


def windows(text: Column, width: int, overlap: int, vocabulary: Vocabulary) -> Column:
    """array of (start, stop, tokens): windows by characters; with no overlap they rejoin to the text.  Null and empty texts have none."""
    return all_windows(text, {"w": (width, overlap)}, vocabulary)["w"]


def all_windows(text: Column, sizes: dict[str, tuple[int, int]], vocabulary: Vocabulary) -> Column:
    """A struct of windows() by name, name: (width, overlap): texts are encoded once for all, by one worker."""
    if any(not 0 <= overlap < width for width, overlap in sizes.values()):
        raise ValueError("overlap is from 0 to width - 1")
    encoder = _worker(vocabulary)
    one = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("tokens", pa.int64())])

    @F.arrow_udf("struct<" + ", ".join(f"{n}: array<struct<start: long, stop: long, tokens: long>>" for n in sizes) + ">")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            done = [_windows(encoder(), p.slice(i, TEXTS), sizes, one) for i in range(0, len(p), TEXTS)]
            yield pa.concat_arrays(done) if done else _windows(encoder(), p, sizes, one)

    return run(text)


def _windows(encoder: Encoder, texts: pa.Array, sizes: dict[str, tuple[int, int]], one: pa.DataType) -> pa.Array:
    edges = (encoder.edges(t, pieces) if t else None for t, pieces in encoder.cut(x.as_py() for x in texts))
    found = [[spans(e, *size) if e is not None else [] for size in sizes.values()] for e in edges]
    return pa.StructArray.from_arrays([_lists([f[i] for f in found], one) for i in range(len(sizes))], names=list(sizes))


def _lists(rows: list[list[tuple[int, int, int]]], one: pa.DataType) -> pa.Array:
    flat = np.array([s for r in rows for s in r], dtype=np.int64).reshape(-1, 3)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(one)))


def pieces(text: Column, spans_of: Column) -> Column:
    """The texts of windows()."""
    return F.transform(spans_of, lambda w: F.substring(text, (w["start"] + 1).cast("int"), (w["stop"] - w["start"]).cast("int")))
