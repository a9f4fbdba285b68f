"""Benchmark phrases in training documents: an FM-index of each shard of documents is searched for all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import words
from spindrift.llm.common import cut, reading
from spindrift.llm.fm_index import MOST, FmIndex

WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Words of documents in an index, about; a longer document is several indexes' that overlap.
SHARD_WORDS = 900_000
#: Benchmark texts are broadcast up to so many bytes; more are searched in several passes.
PHRASE_BYTES = 8 << 20


@dataclass
class Phrases:
    """words: symbols of the benchmark's words; windows: a row each of places in words, -1 in front where one is shorter; items
    of window w are item[first[w]:first[w + 1]], places in names."""

    words: np.ndarray
    windows: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list[str | None]

    @staticmethod
    def of(names: list[str | None], texts: list[bytes | None], window: int) -> Phrases:
        w = words.split([t or b"" for t in texts], words.separators(WORD_BYTES, lower=True))
        codes, known = pd.factorize(words.symbols(w))
        rows, owner = [np.zeros((0, window), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
            if b - a >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(codes[a:b], window))
            elif b > a:
                rows.append(np.concatenate([np.full(window - (b - a), -1), codes[a:b]])[None])
            else:
                continue
            owner.append(np.full(len(rows[-1]), k))
        windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owner)], axis=1), axis=0)
        return Phrases(known, windows, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1], names)


def _pieces(counts: list[int], shard_words: int, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Documents' words dealt to indexes: lists of (document, first word, last + 1)."""
    parts, room = [], shard_words
    for d, n in enumerate(counts):
        if parts and n + 1 > room:
            yield parts
            parts, room = [], shard_words
        at = 0
        while n - at > MOST - 1:
            yield [(d, at, at + MOST - 1)]
            at += MOST - 1 - overlap
        if n:
            parts.append((d, at, n))
            room = max(0, room - (n - at + 1))
    if parts:
        yield parts


def _find(symbols: np.ndarray, bounds: np.ndarray, phrases: Phrases, shard_words: int) -> tuple[np.ndarray, ...]:
    """document, start, end, window of every occurrence."""
    size = (phrases.windows >= 0).sum(axis=1)
    found = [(np.zeros(0, dtype=np.int64),) * 4]
    for parts in _pieces(np.diff(bounds).tolist(), shard_words, phrases.windows.shape[1] - 1):
        spans = [symbols[bounds[d] + a : bounds[d] + b] for d, a, b in parts]
        codes, distinct = pd.factorize(np.concatenate(spans))
        ends = np.cumsum([len(s) for s in spans])
        index = FmIndex.build(np.insert(codes + 1, ends, 0), len(distinct) + 1)
        have = np.append(pd.Index(distinct).get_indexer(phrases.words) + 1, -1)  # 0: a word that isn't here; -1 stays
        asked = np.where(phrases.windows < 0, -1, have[phrases.windows])
        whole = np.flatnonzero((asked != 0).all(axis=1))
        lo, hi = index.search(asked[whole])
        n = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
        window, place = np.repeat(whole, n), index.locate(rows)
        at = np.concatenate([[0], ends[:-1]]) + np.arange(len(spans))
        part = np.searchsorted(at, place, side="right") - 1
        start = np.array([a for _, a, _ in parts])[part] + place - at[part]
        found.append((np.array([d for d, *_ in parts])[part], start, start + size[window], window))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(document: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Spans of each document that has some, in order, those that touch as one."""
    base = bounds[:-1] + np.arange(len(bounds) - 1)  # a gap between documents
    order = np.argsort(base[document] + start)
    d, s, e = document[order], (base[document] + start)[order], (base[document] + end)[order]
    reach = np.maximum.accumulate(e)
    new = np.concatenate([[True], s[1:] > reach[:-1]]) if len(s) else np.zeros(0, dtype=bool)
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]]) if len(s) else np.zeros(0, dtype=np.int64)
    out: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in zip(d[new].tolist(), s[new].tolist(), reach[last].tolist(), strict=True):
        out.setdefault(k, []).append((a - int(base[k]), b - int(base[k])))
    return out


def _without(w: words.Words, text: bytes, at: int, first: int, spans: list[tuple[int, int]]) -> bytes:
    """text, which begins at byte `at` of w and at word `first`, without the bytes of the spans' words."""
    out, from_ = [], 0
    for a, b in spans:
        out.append(text[from_ : int(w.start[first + a]) - at])
        from_ = int(w.end[first + b - 1]) - at
    return b"".join([*out, text[from_:]])


def _pass(docs: DataFrame, phrases: Phrases, id_kind: str, shard_words: int, clean: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    table = words.separators(WORD_BYTES, lower=True)

    def search(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        p = shared.value
        w = words.split(texts, table)
        document, start, end, window = _find(words.symbols(w), w.bounds, p, shard_words)
        spans = _merged(document, start, end, w.bounds)
        items: dict[int, set[str]] = {}
        pairs = np.unique(document * max(1, len(p.windows)) + window)
        for d, k in zip((pairs // max(1, len(p.windows))).tolist(), (pairs % max(1, len(p.windows))).tolist(), strict=True):
            items.setdefault(d, set()).update(n for n in (p.names[i] for i in p.item[p.first[k] : p.first[k + 1]].tolist()) if n is not None)
        every = range(len(texts))
        columns = [pa.concat_arrays(ids), pa.array(np.diff(w.bounds)), pa.array([[{"start": a, "end": b} for a, b in spans.get(d, ())] for d in every], spans_type), pa.array([sorted(items.get(d, ()), key=str.encode) for d in every], pa.list_(pa.string()))]
        if clean:
            at = np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
            columns.append(pa.array([_without(w, t, at[d], int(w.bounds[d]), spans.get(d, [])) for d, t in enumerate(texts)], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        held = 0
        for part in words.text_slices(batches, 1):
            if ids and held + part.column(1).nbytes > 7 * shard_words:
                yield search(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(part.column(0))
            texts.extend(t or b"" for t in part.column(1).to_pylist())
            held += part.column(1).nbytes
        if ids:
            yield search(ids, texts)

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["id", "n_words", "spans", "items", *["clean"] * clean]
    return docs.mapInArrow(run, f"id {id_kind}, n_words long, spans array<struct<start: long, end: long>>, items array<string>{', clean binary' * clean}")


def find_phrases(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, clean: bool = False, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """id, n_words, spans, items for each row of docs: where `window` consecutive words of a benchmark item, or all words of a shorter
    one, occur.

    Words are runs of letters and digits, A-Z in lower case, other characters than ASCII are parts of words.  spans: stretches
    of hit words (first, last + 1), in order, merged; items: the distinct ids, as sorted strings; clean (on request): the text without its spans.

    A shard is a run of documents of one partition, of shard_words words about: nothing is shuffled, a worker holds one shard, and
    a lost one costs its task.  Longer documents are indexed in pieces that overlap by window - 1 words.  The items' bytes
    are counted first: up to phrase_bytes they are broadcast, more are searched in as many passes by a hash of the item.
    Nulls: null texts and items without words hit nothing; a null item id hits words but isn't listed; null and repeated
    document ids stay, a result for each row.  Two words of over 8 bytes are taken for equal by 64 bits of hash.
    """
    asked = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // phrase_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def phrases(part: int) -> Phrases:
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        got = mine.toArrow().to_pydict()  # phrase_bytes about
        return Phrases.of(got["item"], got["text"], window)

    def shaped(found: DataFrame) -> DataFrame:
        out = found.select(F.col("id").alias(id_col), "n_words", "spans", "items", *[F.col("clean").cast("string").alias("clean")] * clean)
        return out

    kind = rows.schema["id"].dataType.simpleString()
    if parts == 1:
        return shaped(_pass(rows, phrases(0), kind, shard_words, clean))
    if clean:
        raise ValueError(f"clean texts are made in one pass; the items have {size} bytes")
    # A number for each row, stored, brings the passes' results together.
    kept = cut(rows.select(F.struct(F.monotonically_increasing_id().alias("row"), "id").alias("id"), "text"))
    keyed = f"struct<row: long, id: {kind}>"
    found = [_pass(kept, phrases(i), keyed, shard_words, False) for i in range(parts)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    one = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s)))
    merged = F.aggregate("spans", F.expr("cast(array() as array<struct<start: long, end: long>>)"), step)
    return reading(shaped(one.select(F.col("id")["id"].alias("id"), "n_words", merged.alias("spans"), "items")), kept)
