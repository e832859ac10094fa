"""Substring dedup by hashing units of text.

Units are lines of any length, sentences within a line, and runs of words between
cuts that the words themselves set, over the whole text.  A unit is normalised (lower
case, white space runs as one blank), hashed to 128 bits (two polynomials over the
hashes of its words, so that any stretch of words is a difference of two running
sums), and digests are grouped over all documents.  The occurrence that ranks first (least document id, then least
offset) stays, every other is removed; removed spans keep their offsets in the
original text.  A sentence or run below ``min_words`` words is never removed by itself:
a shorter sentence belongs to the next long one of its line.

Why sentences and runs too: a passage inside a longer line, or a line changed in one
word, shares no whole line with its copies, but shares its sentences, and the runs
where it starts or ends inside a sentence or is laid out in other lines.

Cuts.  Of every ``span`` neighbouring word pairs, the one of the least hash (the last of
equals) has a cut before it, so the same words have the same cuts whatever stands
around them.  A run goes from each cut to the first cut ``min_words`` or more words
on.  A shared passage of 4 * span + min_words - 2 words or more (50) holds a whole run
at any offset; up to 2 * span words or so at either end of it may stay.

Scale.  Units are narrow rows.  The group's first comes from an aggregate with a
map-side step, so a line that a third of all documents share is one row a task;
the join back is between stored tables, so adaptive execution splits it.  Texts
move once, by document id.

Defined results: a null text stays null, an empty one empty; rows with the same
id are taken as one document (each loses the spans found for the id, its first
occurrence stays in all); a null id ranks before all others.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, spare, stage

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the two polynomials; their powers have inverses modulo 2 ** 64.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # every Unicode white space lies below
KNOWN = 1 << 18  # words whose hashes a task remembers


@dataclass(frozen=True)
class Units:
    min_words: int = 8
    sentences: bool = True
    span: int = 11
    batch_chars: int = 1_000_000


class Words(dict):
    """Numbers of words; word k has the CRC ``short[k]`` and the two halves ``long[:, k]`` of its MD5."""

    def __init__(self):
        super().__init__()
        self.raw, self.short, self.long = [], np.zeros(0, np.uint64), np.zeros((2, 0), np.uint64)

    def __missing__(self, word):
        self[word] = n = len(self)
        self.raw.append(word.encode("utf-8", "surrogatepass"))
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
            self.__init__()
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.raw:
            crc = np.fromiter(map(zlib.crc32, self.raw), np.uint64, len(self.raw))
            md5 = b"".join(hashlib.md5(w, usedforsecurity=False).digest() for w in self.raw)
            self.short = np.concatenate([self.short, crc])
            self.long = np.concatenate([self.long, np.frombuffer(md5, "<u8").reshape(-1, 2).T], axis=1)
            self.raw = []
        return got


class Stretches:
    """Digests of stretches of words: two running sums of word hash times power."""

    def __init__(self, hashes: np.ndarray):
        n = hashes.shape[1]
        self.sums, self.back = [], []
        for h, base in zip(hashes, BASES):
            up, down = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
            self.sums.append(np.append(np.uint64(0), np.cumsum(h * up[:n])))
            self.back.append(down)

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(2, n) digests of the stretches [first, end); their number of words goes in, too."""
        size = (end - first).astype(np.uint64)
        return np.stack([((s[end] - s[first]) * b[first] + size) * MIX for s, b in zip(self.sums, self.back)])


def units_of(texts: list[str], how: Units, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end, digests) of the units of all texts, in order of text, start and end."""
    joined = "\n".join(texts)  # so that a text's end is a line's end
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    word_char = ~SPACE[np.minimum(code, 0x3001)]
    edge = np.diff(np.concatenate([[False], word_char, [False]]).astype(np.int8))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    number = known.numbers(joined.lower().split())
    hashes = Stretches(known.long[:, number])
    text_end = np.cumsum([len(t) + 1 for t in texts])
    # lines
    line_end = np.append(np.flatnonzero(code == 10), len(code))
    line_begin = np.append(0, line_end[:-1] + 1)
    w0, w1 = np.searchsorted(begin, line_begin), np.searchsorted(begin, line_end)
    some = w1 > w0
    found = [(line_begin[some], line_end[some], w0[some], w1[some])]
    if how.sentences:
        found.append(_sentences(code, begin, stop, line_begin, line_end, w0, w1, how))
    # runs between cuts
    short = known.short[number]
    at = np.append(0, np.searchsorted(begin, text_end))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > how.span:
            cuts = a + _cuts(short[a:b], how.span)
            to = np.searchsorted(cuts, cuts + how.min_words)
            i, j = cuts[:-1][to[:-1] < len(cuts)], cuts[to[to < len(cuts)]]
            i = i[:len(j)]
            found.append((begin[i], stop[j - 1], i, j))
    start, end, first, last = (np.concatenate(x) for x in zip(*found))
    # a run or sentence that is a line as well is one unit
    key = start * (len(code) + 2) + end
    order = np.argsort(key, kind="stable")
    order = order[np.append(True, np.diff(key[order]) != 0)[:len(order)]]
    start, end = start[order], end[order]
    text = np.searchsorted(text_end, start, side="right")
    before = (text_end - np.array([len(t) + 1 for t in texts]))[text]
    return text, start - before, end - before, hashes.digests(first[order], last[order])


def _sentences(code, begin, stop, line_begin, line_end, w0, w1, how: Units):
    """Sentences of ``min_words`` words or more, with the shorter ones before them, of lines of several."""
    mark = np.isin(code[stop - 1], [33, 46, 63])
    marks = np.append(0, np.cumsum(mark))
    out = []
    for k in np.flatnonzero((w1 - w0 >= how.min_words) & (marks[w1] > marks[w0])).tolist():
        lo, hi, a, b = int(w0[k]), int(w1[k]), int(line_begin[k]), int(line_end[k])
        close = (np.flatnonzero(mark[lo:hi]) + lo + 1).tolist()  # words up to here end a sentence
        if close[-1] == hi and stop[hi - 1] == b:
            close.pop()  # the line's own end
        start, first, piece = a, lo, lo
        for c in close:
            if c - piece >= how.min_words:
                out.append((start, int(stop[c - 1]), first, c))
                start, first = int(begin[c]) if c < hi else b, c
            piece = c
        if hi - first >= how.min_words and start > a:
            out.append((start, b, first, hi))
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _cuts(short: np.ndarray, span: int) -> np.ndarray:
    """Words that begin the pair of the least hash (the last of equals) of some ``span`` neighbouring pairs."""
    pair = (short[:-1] * MIX + short[1:]) * MIX
    pair ^= pair >> np.uint64(32)
    n = len(pair)
    reach = np.ones(n, np.int64)
    for shift, holds in ((-1, np.greater_equal), (1, np.greater)):
        live = np.ones(n, bool)
        for k in range(1, span):
            if shift < 0:
                live[k:] &= holds(pair[:-k], pair[k:])
                live[:k] = False
            else:
                live[:-k] &= holds(pair[k:], pair[:-k])
                live[-k:] = False
            reach += live
    return np.flatnonzero(reach >= span)


def units(text: str, how: Units) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of a text, in order of their start."""
    if not text:
        return []
    _, start, end, digest = units_of([text], how, Words())
    return [(a, b, d.tobytes()) for a, b, d in zip(start.tolist(), end.tolist(), digest.T)]


def repeated(docs: DataFrame, how: Units = Units(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, first_doc, first_start): every occurrence of a unit but the first one."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def run(batches):
        known = Words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces(texts, how.batch_chars):
                text, start, end, digest = units_of([t or "" for t in texts[a:b]], how, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text + a)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                     *(pa.array(np.ascontiguousarray(d).view(np.int64)) for d in digest)], ["doc_id", "start", "end", "h1", "h2"])

    found = stage(src.mapInArrow(run, f"doc_id {kind}, start int, end int, h1 long, h2 long"), "units")
    groups = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.filter("n > 1").select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first.doc_id").alias("first_doc"),
        F.col("first.start").alias("first_start")), "unit-groups")
    same = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    return (found.join(groups, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(~same)
            .select("doc_id", "start", "end", "first_doc", "first_start"))


def outermost(spans: list[tuple]) -> list[tuple]:
    """The spans (start, end, ...) that lie in no other, in order."""
    out, upto = [], -1
    for x in sorted(spans, key=lambda x: (x[0], -x[1])):
        if x[1] > upto:
            out.append(x)
            upto = x[1]
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line that is taken out whole takes its line break along, and a
    stretch that runs over a line's end otherwise leaves a line break."""
    out, at = [], 0
    joined: list[list[int]] = []
    for a, b in outermost(spans):
        if joined and (a <= joined[-1][1] or (gap := text[joined[-1][1]:a]).isspace() and "\n" not in gap):
            joined[-1][1] = b
        else:
            joined.append([a, b])
    for a, b in joined:
        out.append(text[at:a])
        starts, ends = a == 0 or text[a - 1] == "\n", b == len(text) or text[b] == "\n"
        at = b + 1 if starts and ends else b
        if not starts and not ends and "\n" in text[a:b]:
            out.append("\n")
    out.append(text[at:])
    return "".join(out)


def dedup(docs: DataFrame, how: Units = Units(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated units taken out of the text, and ``removed``: array of (start, end, first_doc)."""
    docs = docs.drop("removed")  # a column of that name gives way
    spans = repeated(docs, how, id_col, text_col)
    doc, = spare(docs, "_doc")
    spans = stage(spans.groupBy(F.col("doc_id").alias(doc)).agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "first_doc"))).alias("removed")), "unit-spans")
    joined = docs.join(spans.hint("merge"), F.col(id_col).eqNullSafe(F.col(doc)), "left").drop(doc)
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            hit = [i for i, r in enumerate(batch.column(last).is_valid().to_pylist()) if r]
            if hit:
                texts, gone = batch.column(at).to_pylist(), [None] * batch.num_rows
                for i in hit:
                    spans = [(r["start"], r["end"], r["first_doc"]) for r in batch.column(last)[i].as_py()]
                    gone[i] = [dict(zip(("start", "end", "first_doc"), x)) for x in outermost(spans)]
                    if texts[i] is not None:
                        texts[i] = without(texts[i], [x[:2] for x in spans])
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                batch = batch.set_column(last, batch.schema.field(last), pa.array(gone, batch.schema.field(last).type))
            yield batch

    return joined.mapInArrow(run, joined.schema)
