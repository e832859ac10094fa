"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with a smallest period q (words q apart are
equal), at least ``2 * q`` and ``min_words`` words long, that no neighbouring word
extends.  Its words after the first q say nothing new and can be dropped.

Method.  The words of many texts stand in one array of numbers, each text with
numbers of its own, so that no match crosses two texts.  The suffix array comes from
prefix doubling over the suffixes not yet told apart; its LCP values from the
irreducible ones, whose lengths sum to O(n log n), the others being one less than
their left neighbour's.  Each LCP value d parts its interval at one place in two sides
of suffixes that agree on exactly d words; every suffix i of the smaller side looks
up the rank of i + d and i - d: if it lies in the other side, the two are a branching
square of period d.  A run's last square is branching, so rotating each branching
square to the left while the words agree gives the run; a run found with multiples of
its period keeps the least one.  There are no tree nodes, only arrays.

Scale.  Texts do not meet: one narrow map over the documents, no shuffle.  A task
works on ``batch_chars`` characters of texts at a time (a longer text by itself,
about 100 bytes of arrays a word).

Defined results: a null text has no runs and stays null; a text without a word
collapses to the empty text; rows with equal ids are judged each by itself; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, pieces

STEPS = 24  # words compared for all pairs at once, before the rest go one by one
RUN = "struct<start: bigint, length: bigint, period: bigint>"


@dataclass(frozen=True)
class Runs:
    min_words: int = 12
    batch_chars: int = 2_000_000


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) of an array of numbers, by prefix doubling."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    first = np.append(True, s[sa][1:] != s[sa][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    h = 1
    while len(open_):
        at = sa[open_]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[open_] = at
        first = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(first, open_, 0))
        rank[at] = head
        open_ = open_[~(first & np.append(first[1:], True))]
        h *= 2
    return sa, rank


def agreement(s: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Number of equal words of ``s`` from each a and b on, going by ``step`` (1 or -1); ``s`` ends with a
    number that occurs nowhere else."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(STEPS):
        same = s[a[live] + step * k] == s[b[live] + step * k]
        live = live[same]
        out[live] += 1
        if not len(live):
            return out
    for j in live.tolist():
        x, y, k, width = int(a[j]), int(b[j]), STEPS, 64
        while True:
            room = min(width, (len(s) - max(x, y) if step > 0 else min(x, y) + 1) - k)
            if room <= 0:
                break
            p = s[x + k:x + k + room] if step > 0 else s[x - k - room + 1:x - k + 1][::-1]
            q = s[y + k:y + k + room] if step > 0 else s[y - k - room + 1:y - k + 1][::-1]
            differ = p != q
            if differ.any():
                k += int(differ.argmax())
                break
            k += room
            width *= 2
        out[j] = k
    return out


def lcp_values(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[r]: words that the suffixes of rank r - 1 and r share; ``s`` ends with a number of its own."""
    n = len(sa)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = n  # the last number: agrees with nothing
    i = np.arange(n)
    leads = s[i - 1] != s[phi - 1]
    leads[0] = leads[sa[0]] = True
    leads[phi == 0] = True
    at = i[leads]
    plcp = np.zeros(n, np.int64)
    plcp[at] = agreement(s, at, phi[at], 1)
    last = np.maximum.accumulate(np.where(leads, i, 0))
    return (plcp[last] - (i - last))[sa]


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, left end, right end): for each lcp[r] > 0, ranks [left, r) and [r, right) agree on lcp[r] words and no more."""
    before, after, stack = {}, {}, []
    for r, v in enumerate(lcp.tolist()):
        while stack and stack[-1][1] >= v:
            after[stack.pop()[0]] = r
        if v:
            before[r] = stack[-1][0] if stack else -1
            stack.append((r, v))
        else:
            stack = [(r, 0)]
    for r, v in stack:
        after[r] = len(lcp)
    at = np.fromiter(before, np.int64, len(before))
    left = np.fromiter(before.values(), np.int64, len(before))
    return at, left, np.fromiter((after[r] for r in before), np.int64, len(before))


def branching_squares(lcp: np.ndarray, sa: np.ndarray, rank: np.ndarray, room: int = 1 << 20):
    """(start, period) of each square whose second half is followed by another word than its first."""
    at, left, right = intervals(lcp)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small_left = at - left <= right - at
    lo, size = np.where(small_left, left, at), np.where(small_left, at - left, right - at)
    other_lo, other_hi = np.where(small_left, at, left), np.where(small_left, right, at)
    depth, n = lcp[at], len(sa)
    upto = np.cumsum(size)
    starts, periods = [], []
    a = 0
    while a < len(at):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + room, side="right")))
        count = size[a:b]
        node = np.repeat(np.arange(a, b), count)
        x = np.arange(len(node)) - np.repeat(upto[a:b] - count - done, count) + lo[node]
        i, d = sa[x], depth[node]
        for j in (i + d, i - d):
            inside = (j >= 0) & (j < n)
            r = rank[np.where(inside, j, n)]
            hit = inside & (r >= other_lo[node]) & (r < other_hi[node])
            starts.append(np.minimum(i, j)[hit])
            periods.append(d[hit])
        a = b
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(s: np.ndarray, min_words: int) -> np.ndarray:
    """(start, length, period) rows of all runs of ``s``, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(s) < 2:
        return none
    sa, rank = suffix_array(s)
    ended = np.append(s, -1)
    start, period = branching_squares(lcp_values(ended, sa), sa, rank)
    if not len(start):
        return none
    end = start + 2 * period
    first = start - agreement(ended, start - 1, start - 1 + period, -1)
    length = end - first
    keep = length >= min_words
    first, length, period = first[keep], length[keep], period[keep]
    order = np.lexsort((period, length, first))
    first, length, period = first[order], length[order], period[order]
    # the same stretch with a multiple of its period is the same run
    new = np.append(True, (first[1:] != first[:-1]) | (length[1:] != length[:-1]))[:len(first)]
    out = np.stack([first[new], length[new], period[new]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of_texts(texts: list[bytes], min_words: int) -> list[tuple[np.ndarray, bytes]]:
    """Of each text its runs (word number, words, period) and the text without their repeats."""
    words, numbers, sizes, base = [], [], [], 0
    for t in texts:
        w = t.split()  # bytes split at ASCII white space alone
        seen: dict[bytes, int] = {}
        numbers.append(np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w)) + base)
        base += len(seen)
        words.append(w)
        sizes.append(len(w))
    ends = np.cumsum(sizes)
    found = runs_of(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), min_words)
    cut = np.searchsorted(found[:, 0], np.append(0, ends))
    out = []
    for k, w in enumerate(words):
        mine = found[cut[k]:cut[k + 1]].copy()
        mine[:, 0] -= ends[k] - sizes[k]
        if len(mine):
            gone = np.zeros(len(w) + 1, np.int64)
            np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
            np.add.at(gone, mine[:, 0] + mine[:, 1], -1)
            w = list(compress(w, (np.cumsum(gone)[:-1] == 0).tolist()))
        out.append((mine, b" ".join(w)))
    return out


def collapse(docs: DataFrame, how: Runs = Runs(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text by start, then period, and its words without the
    repeats, joined by one blank."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in pieces(texts, how.batch_chars):
                got = runs_of_texts([t or b"" for t in texts[a:b]], how.min_words)
                flat = np.concatenate([r for r, _ in got])
                items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type))
                ends = np.cumsum([0] + [len(r) for r, _ in got]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), items, type=kind),
                     pa.array([None if t is None else c for t, (_, c) in zip(texts[a:b], got)], pa.binary()).cast(pa.string())],
                    ["doc_id", "runs", "collapsed"])

    return src.mapInArrow(run, f"doc_id {src.dtypes[0][1]}, runs array<{RUN}>, collapsed string")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with known runs in every tenth text: from word a on, the text repeats its next p words.

    a, p and which text follow from the CRC of the id; a null id leaves its text as it is.
    """
    h = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), WHITE), lambda w: w != "")
    rest = F.col("_n") - F.col("_a")
    p = (F.lit(1) + F.floor(rest / (F.lit(3) + F.col("_g") % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), g.alias("_g"),
                      F.when(h % 10 == 0, words).alias("_w"))
    src = src.select("*", F.size("_w").alias("_n")).select("*", (F.col("_g") % F.nullif("_n", F.lit(0))).cast("int").alias("_a"))
    return src.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))
