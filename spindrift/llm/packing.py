"""Packing by vector bin packing.

A sequence has room for tokens, segments and loss-bearing tokens at once.  The next piece for it is
the one whose demand has the largest dot product with what is left, each as a share of its limit.
When nothing whole fits, a piece is cut to fill the room.  Every task packs the rows of its input
split in order, with a bounded buffer; nothing is shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import raw, slices
from spindrift.session import share_package

END_ID = 2
BUFFER = 256
#: Words whose ids a worker remembers, at most about; then it starts anew.
WORDS_KEPT = 700_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers, end id included.

    The tokenizer drops white space, so what lies between ASCII white space is encoded on its own and
    remembered: a text's ids are those of its words, end to end.  New words are encoded many at a time and told apart by
    their numbers of pre-tokens, each of which ends in an id with a word end.
    """

    def __init__(self, path: str | None = None, end_id: int = END_ID):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.end = np.uint32(end_id).tobytes()
        self.known: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # The fixed value of the tokenizer file's own pre-tokenizer pattern.
        spec = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        found = [p["pattern"]["Regex"] for p in spec.get("pretokenizers", []) if p["type"] == "Split"]
        self.pattern = regex.compile(found[0]) if len(found) == 1 and self.ends.any() else None
        small = "".join(chr(c) for c in range(33, 127) if not chr(c).isupper())
        self.plain = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(small) == small

    def _one_by_one(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def _together(self, words: list[bytes]) -> None:
        text = b" ".join(words).decode("utf-8", "replace")
        # The normalizer leaves small ASCII letters and marks as they are.
        normal = (text if self.plain and text.isascii() and text == text.lower() else self.tokenizer.normalizer.normalize_str(text)).split(" ")
        counts = [1 if w.isalpha() else 2 if w[:-1].isalpha() and w[-1] in ".,;:!?" else len(self.pattern.findall(w)) for w in normal]
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        upto = np.cumsum(counts)
        if len(normal) != len(words) or len(stops) != upto[-1] or stops[-1] != len(ids) or 0 in counts:
            return self._one_by_one(words)
        data, at = ids.tobytes(), 0
        for w, stop in zip(words, (4 * stops[upto - 1]).tolist(), strict=True):
            self.known[w] = data[at:stop]
            at = stop
        return None

    def __call__(self, texts: list[str | bytes | None]) -> list[bytes]:
        # The tokenizer lower-cases; doing so first for A-Z leaves fewer different words.  Special tokens' strings stay as they are.
        texts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        split = [(b if b"<|" in b else b.lower()).split() for b in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()  # the words in use are soon known again
        new = list(set().union(*split).difference(self.known))
        # Special tokens' strings inside a word are ids of their own.
        odd = [w for w in new if b"<|" in w] if self.pattern else new
        new = [w for w in new if b"<|" not in w] if self.pattern else []
        for at in range(0, len(odd), 1024):
            self._one_by_one(odd[at : at + 1024])
        # Small ASCII words need no normalizer, so the others are apart.
        ascii_ = [w for w in new if w.isascii()]
        for some in (ascii_, [w for w in new if not w.isascii()]):
            for at in range(0, len(some), 512):
                self._together(some[at : at + 512])
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) + self.end for ws in split]


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """A worker's encoder, kept from task to task with the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Item:
    """What is left of a document: its ids from `start` on."""

    __slots__ = ("doc", "ids", "loss_from", "start", "total")

    def __init__(self, doc, ids: bytes, loss: int | None):
        self.doc, self.ids, self.start, self.total = doc, ids, 0, len(ids) // 4
        self.loss_from = 0 if loss is None else max(0, self.total - loss)

    def left(self) -> int:
        return self.total - self.start

    def loss_in(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))

    def longest(self, tokens: int, loss: int) -> int:
        """Ids that fit into so many tokens and loss-bearing tokens."""
        n = min(self.left(), tokens)
        return n if self.loss_in(n) <= loss else max(0, self.loss_from - self.start) + loss

    def cut(self, length: int) -> tuple:
        piece = (self.doc, self.start, length, zlib.crc32(self.ids[4 * self.start : 4 * (self.start + length)]), self.total, self.loss_in(length), self.ids[4 * self.start : 4 * (self.start + length)])
        self.start += length
        return piece


class Packer:
    """Streams items in, gives sequences (lists of pieces) out; holds BUFFER items and one open sequence."""

    def __init__(self, capacity: int = 4096, max_segments: int = 256, max_loss: int | None = None):
        self.limits = np.array([capacity, max_segments, capacity if max_loss is None else max_loss], dtype=float)
        self.held: list[Item] = []
        #: Of each held item: ids left, and loss-bearing ids among them.
        self.need = np.zeros((2, BUFFER + 1))
        self.open: list[tuple] = []
        self.room = self.limits.copy()

    def add(self, item: Item):
        cap, loss = int(self.limits[0]), int(self.limits[2])
        while item.left() >= cap and item.loss_in(cap) <= loss:
            yield [item.cut(cap)]
        if item.left():
            self._note(len(self.held), item)
            self.held.append(item)
        while len(self.held) >= BUFFER:
            yield from self._place()

    def _note(self, at: int, item: Item) -> None:
        self.need[:, at] = item.left(), item.loss_in(item.left())

    def finish(self):
        while self.held:
            yield from self._place()
        yield from self._close()

    def _place(self):
        """Puts one more piece into the open sequence; closes it if it is full."""
        tokens, segments, loss = (int(x) for x in self.room)
        if segments and tokens:
            n, need = self.need[:, : len(self.held)]
            share = self.room / self.limits
            score = n / self.limits[0] * share[0] + share[1] / self.limits[1] + need / self.limits[2] * share[2]
            score[(n > tokens) | (need > loss)] = -1
            best = int(score.argmax())
            if score[best] < 0:
                # Ids of each that fit: those before its loss-bearing ones, and as many of these as there is room for.
                fits = np.minimum(np.minimum(n, tokens), n - need + loss)
                best = int(fits.argmax())
            item = self.held[best]
            if length := item.longest(tokens, loss):
                piece = item.cut(length)
                self.open.append(piece)
                self.room -= (length, 1, piece[5])
                if item.left():
                    self._note(best, item)
                else:
                    self.held[best] = self.held[-1]
                    self.need[:, best] = self.need[:, len(self.held) - 1]
                    self.held.pop()
                if self.room[0] and self.room[1]:
                    return
        yield from self._close()

    def _close(self):
        """The open sequence; if it isn't full, as sequences whose lengths are powers of two, which need no padding."""
        left, self.open, self.room = deque(self.open), [], self.limits.copy()
        total = sum(p[2] for p in left)
        while total:
            want = int(self.limits[0]) if total == self.limits[0] else 1 << (total.bit_length() - 1)
            total -= want
            out = []
            while want:
                p = left.popleft()
                if p[2] > want:
                    head, tail = _halves(p, want)
                    left.appendleft(tail)
                    p = head
                out.append(p)
                want -= p[2]
            yield out


def _halves(p: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, length, _, total, loss, ids = p
    first, second = ids[: 4 * n], ids[4 * n :]
    tail_loss = min(loss, length - n)  # trainable ids are a document's last
    return (doc, start, n, zlib.crc32(first), total, loss - tail_loss, first), (doc, start + n, length - n, zlib.crc32(second), total, tail_loss, second)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, max_segments: int = 256, max_loss: int | None = None, loss_col: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> one row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids).

    A document is its token ids and the end id.  Its last loss_col ids are loss-bearing, all of them if no column is
    named.  Each id lies in one piece; a sequence has `capacity` ids, or a power of two that needs no padding.
    Null and empty texts have the end id alone; texts of any length are cut; rows that repeat are packed each; other
    columns are ignored; a table without rows gives none.  The packing depends on the input's splits, which
    a lost task reads again in the same order.
    """
    share_package(docs.sparkSession)
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), loss.alias("loss"))
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = f"`{id_col}` long, " + ", ".join(f"{c} long" for c in numbers) + ", ids binary" * with_ids

    def run(batches):
        encode, packer = encoder(tokenizer), Packer(capacity, max_segments, max_loss)
        sequence = TaskContext.get().partitionId() << 33

        def table(sequences) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for s in sequences:
                at = 0
                for doc, start, length, crc, total, loss, ids in s:
                    out.append((doc, start, length, crc, total, sequence, at, loss, ids))
                    at += length
                sequence += 1
            cols = list(zip(*out, strict=True)) or [()] * 9
            arrays = [pa.array(c, pa.int64()) for c in cols[:8]] + ([pa.array(cols[8], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, [id_col, *numbers] + ["ids"] * with_ids)

        # Ids are Python integers on their way: none, and large ones, stay what they are.
        for b in slices(batches):
            items = zip(b.column("id").to_pylist(), encode(raw(b.column("text"))), b.column("loss").to_pylist(), strict=True)
            yield table(s for d, ids, n in items for s in packer.add(Item(d, ids, n)))
        yield table(packer.finish())

    return rows.mapInArrow(run, schema)
