"""Benchmark decontamination: a hash set of test n-grams, scanned over every training window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, slices

ship(__name__)

#: Words are 0-9, a-z after lower-casing A-Z, and everything beyond ASCII.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
MULT = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes | None) -> list[bytes]:
    return data.translate(WORDS).split() if data else []


class Windows:
    """The n-grams of one block of items as flat arrays: word ids of all items in a row, and for each window length the
    sorted 64-bit hashes with the places where the windows start, whose items and words verify a hit."""

    def __init__(self, n: int, plain: tuple | None = None):
        self.n, self.ids, self.names, self.flat, self.item, self.tables = plain or (n, {}, [], [], [], {})

    def add(self, name: str, ws: list[bytes]) -> None:
        if ws:
            ids = self.ids
            self.flat.append(np.array([ids.setdefault(w, len(ids) + 1) for w in ws], np.uint32))
            self.names.append(name)

    def close(self) -> Windows:
        """Make the arrays; what plain() gives can be broadcast."""
        lengths = np.array([len(x) for x in self.flat], np.int64)
        starts = np.cumsum(lengths) - lengths
        self.flat = np.concatenate(self.flat) if len(lengths) else np.zeros(0, np.uint32)
        self.item = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        sizes = np.minimum(lengths, self.n)
        for size in np.unique(sizes).tolist():
            own = sizes == size
            count = lengths[own] - size + 1
            at = np.repeat(starts[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            h = self.rolled(self.flat, at, size)
            order = np.argsort(h, kind="stable")
            self.tables[size] = (h[order], at[order])
        return self

    def plain(self) -> tuple:
        return self.n, self.ids, self.names, self.flat, self.item, self.tables

    @staticmethod
    def rolled(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = (h ^ ids[at + k]) * MULT
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ws: list[bytes]) -> list[tuple[int, int, set]]:
        """(first word, end word, items) of every occurrence."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in ws), np.uint32, len(ws))
        # a window has known words only, so stretches between unknown ones are looked at alone
        unknown = np.flatnonzero(ids == 0)
        gap = np.diff(np.concatenate([[-1], unknown, [len(ids)]])) - 1
        begin = np.concatenate([[0], unknown + 1])
        out = []
        for size, (known, where) in self.tables.items():
            long = gap >= size
            first, count = begin[long], gap[long] - size + 1
            if not len(first):
                continue
            at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            h = self.rolled(ids, at, size)
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            for k in np.flatnonzero(high > low):
                p = where[low[k] : high[k]]
                same = (self.flat[p[:, None] + np.arange(size)] == ids[at[k] : at[k] + size]).all(1)
                if same.any():
                    out.append((int(at[k]), int(at[k]) + size, {self.names[i] for i in self.item[p[same]].tolist()}))
        return out


def blocks(items: DataFrame, n: int, max_words: int) -> Iterator[Windows]:
    """The benchmark as blocks of at most about ``max_words`` words (and one item more), streamed to the driver one
    partition at a time. A null id counts as the empty string."""
    block, size = Windows(n), 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.encode("text", "UTF-8").alias("text")).toLocalIterator():
        ws = words(bytes(r.text) if r.text is not None else None)
        if size and size + len(ws) > max_words:
            yield block.close()
            block, size = Windows(n), 0
        block.add(r.item, ws)
        size += len(ws)
    yield block.close()


def merged(hits: list[dict]) -> list[tuple[int, int]]:
    """Hit stretches joined where they touch."""
    out: list[list[int]] = []
    for first, end in sorted((h["first"], h["end"]) for h in hits):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(x, y) for x, y in out]


def word_spans(data: bytes, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of stretches of words."""
    a = np.frombuffer(b" " + data.translate(WORDS) + b" ", np.uint8) != 32
    edge = np.flatnonzero(a[1:] != a[:-1])
    return [(int(edge[2 * x]), int(edge[2 * y - 1])) for x, y in wanted]


HITS = "array<struct<first:int,end:int,items:array<string>>>"


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, mode: str = "remove", max_share: float = 1.0, max_words: int = 500_000) -> DataFrame:
    """Per document: its columns, n_words, n_hit, n_items, items_sha256, contaminated, clean_text.

    A document word inside any occurrence of a window is hit; a hash hit is verified word by word. mode "remove": clean_text
    is null where the document is contaminated; "cut": the hit words are cut out of it, and it is null only where
    more than max_share of the words were hit. items_sha256 digests the item ids, sorted as strings.
    Null text has no words and stays null. An empty benchmark hits nothing. Null item text: no
    window. Repeated items count once by id. Columns of docs that clash with the new ones are replaced.

    A benchmark of up to ``max_words`` words is one hash set, broadcast (some 20 bytes a word and its vocabulary), and one pass.
    A larger one goes by blocks of that size: each but the last takes a pass of its own, whose hits are checkpointed with
    the documents before its broadcast is freed, so that one block at a time is in memory.
    """
    if mode not in ("remove", "cut"):
        raise ValueError(f"unknown mode {mode!r}")
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    base = docs.select([c for c in docs.columns if c not in new and c != "_hits"])
    keep, schema = base.columns, base.schema
    for name, kind in zip(new, ("long", "long", "long", "string", "boolean", "string"), strict=True):
        schema = schema.add(name, kind)
    hit_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("items", pa.list_(pa.string()))]))

    def verdict(raw: bytes | None, ws: list[bytes], hits: list[dict]) -> tuple:
        spans = merged(hits)
        n_hit = sum(y - x for x, y in spans)
        ids = sorted({i for h in hits for i in h["items"]})
        clean = raw
        if n_hit and (mode == "remove" or n_hit > max_share * len(ws)):
            clean = None
        elif n_hit:
            at, kept = 0, []
            for x, y in word_spans(raw, spans):
                kept.append(raw[at:x])
                at = y
            clean = b"".join([*kept, raw[at:]])
        return len(ws), n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0, clean.decode(errors="replace") if clean is not None else None

    def scanned(rows: DataFrame, block: Windows, last: bool) -> tuple:
        held = docs.sparkSession.sparkContext.broadcast(block.plain())

        def run(batches):
            w = Windows(n, held.value)
            for b in slices(batches):
                hits, out = [], [[] for _ in new]
                for data, old in zip(b.column("text"), b.column("_hits"), strict=True):
                    raw = data.as_buffer().to_pybytes() if data.is_valid else None
                    ws = words(raw)
                    all_hits = (old.as_py() or []) + [{"first": x, "end": y, "items": sorted(z)} for x, y, z in w.hits(ws)]
                    if last:
                        for own, v in zip(out, verdict(raw, ws, all_hits), strict=True):
                            own.append(v)
                    else:
                        hits.append(all_hits)
                if last:
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[*keep, *new])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(hits, hit_type)], names=[*keep, "_hits"])

        return rows.mapInArrow(run, schema if last else rows.schema), held

    rows = base.withColumn("_hits", F.expr(f"cast(array() as {HITS})"))
    waiting: Windows | None = None
    for block in blocks(items, n, max_words):
        if waiting is not None:
            hit, held = scanned(rows, waiting, False)
            rows = cut(hit)
            held.destroy()
        waiting = block
    return scanned(rows, waiting, True)[0]
