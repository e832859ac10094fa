"""Benchmark decontamination: q-gram lemma filtering with banded verification.

A document is contaminated by a benchmark item if some stretch of it is within
``edit_rate`` x length edits of one of the item's windows of ``window`` characters
(an item that is no longer is its own window).  Windows start every ``stride``
characters, so each verbatim part of window + stride - 1 characters holds a whole one.
An item shorter than ``min_item`` is searched exactly, as whole words.
Case is folded and runs of white space count as one space on both sides.

Method.  A pattern of m characters with k edits shares at least
T = m + 1 - q (k + 1) q-grams with its match, and all lie on k + 1 neighbouring
diagonals (document position less pattern position).  Shared q-grams are counted
in bands of 2 (k + 1) diagonals that overlap by half, so some band holds a whole
match.  Bands that reach T are verified by an alignment confined to the band.
Every pattern has T >= 1 (``min_item`` sees to it; a short item has no edits and
q-grams of its own length at most), so the filter loses no match.

Scale.  The documents are scanned where they lie, no shuffle: per batch the
q-gram hashes of whole texts are looked up in the patterns' table.  The benchmark is
stored in blocks of about ``block_chars`` characters of windows; tasks read a block from
the shared folder and a worker holds the tables of one.  The driver holds the blocks'
numbers alone; a larger benchmark takes more passes over the documents, not more memory.

Defined results: null or empty texts and documents shorter than any pattern
match nothing; items that are null or empty are passed over; repeated
items are all reported; repeated documents are reported each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_store, pieces, spare, stage, stage_path

SEAM = 0x110000  # no character: parts texts that are scanned together
MULT = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
SHARED = 4_000_000  # shared q-grams held at once


@dataclass(frozen=True)
class Decontam:
    q: int = 8
    edit_rate: float = 0.1
    window: int = 100
    stride: int = 20
    min_item: int = 40
    block_chars: int = 4_000_000


def fold(text: str) -> np.ndarray:
    """Code points, lower case, each run of white space one space."""
    return squeeze(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4"))


def is_white(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0x85) | (c == 0xA0) | (c == 0x3000)


def squeeze(c: np.ndarray) -> np.ndarray:
    w = is_white(c)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(w[1:] & w[:-1])
    return np.where(w, np.uint32(32), c)[keep]


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q code points, built by doubling."""
    out, size, c = None, 0, c.astype(np.uint64)
    power, width, mult = c, 1, MULT
    while True:
        if q & width:
            if out is None:
                out, size = power, width
            else:
                n = len(c) - (size + width) + 1
                if n <= 0:
                    return np.zeros(0, dtype=np.uint64)
                out = out[:n] * mult + power[size:size + n]
                size += width
        if 2 * width > q:
            break
        n = len(c) - 2 * width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        power = power[:n] * mult + power[width:width + n]
        mult = np.uint64(int(mult) ** 2 & (2 ** 64 - 1))
        width *= 2
    out = out[:max(0, len(c) - q + 1)] * MULT
    return out ^ (out >> np.uint64(32))


def windows(n: int, window: int, stride: int) -> list[tuple[int, int]]:
    """Overlapping windows over the item, the last one flush with its end; a shorter item is one window."""
    if n <= window:
        return [(0, n)]
    return [(a, a + window) for a in [*range(0, n - window, stride), n - window]]


def by_gram(items: list[tuple[object, str]], how: Decontam) -> list[Patterns]:
    """Patterns of the items, a table for each q-gram size: ``q``, or the length of a shorter item."""
    sizes: dict = {}
    for item, raw in items:
        n = len(fold(raw.strip()))
        if n:
            sizes.setdefault(min(how.q, n), []).append((item, raw))
    return [Patterns(some, replace(how, q=q)) for q, some in sorted(sizes.items())]


class Patterns:
    """q-gram table of a block of items."""

    def __init__(self, items: list[tuple[object, str]], how: Decontam):
        self.q = how.q
        self.item, self.offset, self.text, self.k, self.need, self.whole = [], [], [], [], [], []
        grams, owner, at = [], [], []
        for item, raw in items:
            c = fold(raw.strip())
            seen = set()
            for a, b in windows(len(c), how.window, how.stride):
                if c[a:b].tobytes() in seen:  # an item that repeats itself: its first such window stands for all
                    continue
                seen.add(c[a:b].tobytes())
                k = int(how.edit_rate * (b - a)) if len(c) >= how.min_item else 0
                need = (b - a) + 1 - how.q * (k + 1)
                while need < 1:  # cannot come up for the lengths min_item admits at the default q and rate
                    k -= 1
                    need = (b - a) + 1 - how.q * (k + 1)
                g = gram_hashes(c[a:b], how.q)
                grams.append(g)
                owner.append(np.full(len(g), len(self.item)))
                at.append(np.arange(len(g)))
                self.item.append(item)
                self.offset.append(a)
                self.text.append(c[a:b])
                self.k.append(k)
                self.need.append(need)
                self.whole.append(len(c) < how.min_item)
        self.k, self.need = np.array(self.k, dtype=np.int64), np.array(self.need, dtype=np.int64)
        grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(grams, kind="stable")
        self.owner = (np.concatenate(owner)[order] if len(order) else np.zeros(0, dtype=np.int64)).astype(np.int32)
        self.at = (np.concatenate(at)[order] if len(order) else np.zeros(0, dtype=np.int64)).astype(np.int32)
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)

    def table(self) -> np.ndarray:
        t = np.zeros(1 << TABLE_BITS, dtype=bool)
        t[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return t

    def bands(self, pos: np.ndarray, g: np.ndarray):
        """(band keys, shared q-grams in each) of text positions ``pos`` that hold the q-grams numbered ``g``."""
        times = self.count[g]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hit = np.repeat(self.first[g], times) + inside
        owner = self.owner[hit].astype(np.int64)
        diag = np.repeat(pos, times) - self.at[hit]
        half = self.k[owner] + 1
        band = diag // half + 1  # may start one half band before the text
        both = np.concatenate([owner * (1 << 40) + band, owner * (1 << 40) + band - 1])
        return np.unique(both, return_counts=True)

    def scan(self, c: np.ndarray, table: np.ndarray):
        """(pattern, band start diagonal) candidates: bands that hold enough shared q-grams."""
        h = gram_hashes(c, self.q)
        pos = np.flatnonzero(table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int32)])
        if not len(pos) or not len(self.grams):
            return np.zeros((0, 2), dtype=np.int64)
        g = np.searchsorted(self.grams, h[pos])
        g[g == len(self.grams)] = 0
        ok = self.grams[g] == h[pos]
        pos, g = pos[ok], g[ok]
        both, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        upto = np.cumsum(self.count[g])
        a = 0
        while a < len(pos):  # so many shared q-grams at a time, however often one repeats in text and patterns
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SHARED, side="right")))
            more, times = self.bands(pos[a:b], g[a:b])
            both, at = np.unique(np.concatenate([both, more]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times]), len(both)).astype(np.int64)
            a = b
        owner, band = both >> 40, both & ((1 << 40) - 1)
        good = n >= self.need[owner]
        owner, band = owner[good], band[good]
        return np.stack([owner, (band - 1) * (self.k[owner] + 1)], axis=1)


def banded(patterns: list[np.ndarray], c: np.ndarray, starts: np.ndarray, widths: np.ndarray):
    """For each row the least edits between its pattern and a stretch of c on diagonals [start, start + width),
    and where the stretch ends."""
    sizes = np.array([len(p) for p in patterns])
    width, longest = int(widths.max()), int(sizes.max())
    text = np.full((len(patterns), longest), SEAM + 1, np.uint32)
    for i, p in enumerate(patterns):
        text[i, :len(p)] = p
    lanes = np.arange(width)
    at = starts[:, None] + lanes + longest + width
    padded = np.pad(c, longest + width, constant_values=SEAM)
    big = 1 << 20
    cost = np.where(lanes < widths[:, None], 0, big)
    drop = np.full_like(cost, big)
    for i in range(longest):
        drop[:, :-1] = cost[:, 1:] + 1  # pattern character left out
        char = padded[np.minimum(at + i, len(padded) - 1)]
        seam = char == SEAM  # no stretch runs over the end of its text
        put = np.cumsum(np.where(seam, big, 1), axis=1)
        step = np.minimum(cost + np.where(seam, big, char != text[:, i, None]), drop) - put
        step = np.minimum.accumulate(step, axis=1) + put  # document characters put in
        step[lanes >= widths[:, None]] = big
        cost = np.where((i < sizes)[:, None], step, cost)
    best = cost.argmin(axis=1)
    return cost[np.arange(len(starts)), best], starts + best + sizes


def find_leaks(docs: DataFrame, benchmark: DataFrame, how: Decontam = Decontam(), id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, window_start, edits, end): stretches of documents that match a benchmark item.

    ``end`` is the match's end in the folded text; one row for each document, item and window, the best match.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).dropna()
    types, kinds = dict(src.dtypes), dict(items.dtypes)
    schema = f"doc_id {types['doc_id']}, item_id {kinds['item_id']}, window_start int, edits int, end long"
    blocks = store_blocks(items, how)
    if not blocks:
        return src.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [_scan(src, uri, how, schema) for uri in blocks])


def store_blocks(items: DataFrame, how: Decontam) -> list[str]:
    """The items (item_id, text) stored in blocks, one folder each: the folders.

    Equal rows are stored once with their number, so a row that is most of the
    benchmark does not swell its block.
    """
    spark = items.sparkSession
    stored = stage(items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times")), "benchmark")
    n = F.length("text")
    chars = F.when(n <= how.window, n).otherwise((F.ceil((n - how.window) / how.stride) + 1) * how.window)
    total = stored.agg(F.sum(chars)).first()[0]
    if not total:
        return []
    blocks = -(-total // how.block_chars)
    path = stage_path(spark, "benchmark-blocks")
    (stored.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition(blocks, "block")
     .write.partitionBy("block").parquet(path))
    held = spark.read.parquet(path).select("block").distinct().collect()  # a row a block
    return [f"{path}/block={r.block}" for r in sorted(held)]


@lru_cache(maxsize=1)
def read_block(uri: str, how: Decontam) -> tuple[list, list, list]:
    """(item ids, times, (patterns, table) pairs) of a stored block; a worker keeps the last one over its tasks."""
    store, root = open_store(uri)
    rows = pq.read_table(root, filesystem=store, partitioning=None, columns=["item_id", "text", "times"])
    patterns = by_gram(list(enumerate(rows.column("text").to_pylist())), how)
    return rows.column("item_id").to_pylist(), rows.column("times").to_pylist(), [(p, p.table()) for p in patterns]


def _scan(src: DataFrame, uri: str, how: Decontam, schema: str) -> DataFrame:
    fields = src.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        items, times, tables = read_block(uri, how)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0)
            rows: list = []
            for a, b in pieces(texts, 1_000_000):
                for p, table in tables:
                    for doc, item, *rest in leaks(p, table, texts[a:b], a):
                        rows += [(doc, items[item], *rest)] * times[item]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r[0]].as_py() for r in rows], arrow.field(0).type),
                 *[pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(1, 5)]], schema=arrow)

    return src.mapInArrow(run, fields)


def _whole(c: np.ndarray, a: int, b: int) -> bool:
    """Whether c[a:b] cuts no word at its ends."""
    letter = lambda i: 0 <= i < len(c) and c[i] < SEAM and chr(c[i]).isalnum()
    return not (letter(a - 1) and letter(a)) and not (letter(b - 1) and letter(b))


def leaks(patterns: Patterns, table: np.ndarray, texts: list, base: int = 0) -> list[tuple]:
    """(index, item, window start, edits, end) of the best match of each text and pattern."""
    parts, first, n = [], [], 0
    seam = np.full(1, SEAM, np.uint32)
    for t in texts:
        c = fold(t) if t else seam[:0]
        first.append(n)
        parts += [c, seam]
        n += len(c) + 1
    c = np.concatenate(parts)
    first = np.array(first)
    got: dict = {}
    cand = patterns.scan(c, table)
    for a in range(0, len(cand), 2048):
        owner, starts = cand[a:a + 2048].T
        edits, end = banded([patterns.text[o] for o in owner], c, starts, 2 * (patterns.k[owner] + 1))
        for i in np.flatnonzero(edits <= patterns.k[owner]):
            if patterns.whole[owner[i]] and not _whole(c, int(end[i]) - len(patterns.text[owner[i]]), int(end[i])):
                continue
            doc = int(np.searchsorted(first, end[i] - 1, side="right") - 1)
            key, val = (base + doc, int(owner[i])), (int(edits[i]), int(end[i] - first[doc]))
            if key not in got or val < got[key]:
                got[key] = val
    return [(d, patterns.item[o], patterns.offset[o], e, z) for (d, o), (e, z) in got.items()]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, how: Decontam = Decontam(), **cols) -> DataFrame:
    """The documents without a leak, with the columns of ``docs``; a document with a null id is judged with the null ids."""
    hit, = spare(docs, "_bad")
    bad = stage(find_leaks(docs, benchmark, how, **cols).select(F.col("doc_id").alias(hit)).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(hit)), "left_anti")
