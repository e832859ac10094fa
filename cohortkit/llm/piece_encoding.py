"""SentencePiece encoding by vectorised merge rounds, and decoding.

A BPE model of the sentencepiece library joins, again and again, the neighbouring
symbols whose joined piece scores best (the leftmost of equals) until no two
neighbours form a piece.  Here that runs for all words of a batch at once on flat
numpy arrays: a round looks up the rank of every pair of neighbours, takes the least
rank of each word (a segmented minimum), joins all its pairs of that rank that do not
overlap, leftmost first, and compacts the arrays.  Words without a pair left are
done and leave the arrays.

The rounds give the library's ids because a joined piece normally makes no new pair
that ranks before it; pieces for which the model does make one are found when it is
loaded, and a word joins only the leftmost pair of such a rank in a round.

A word ends where no piece of the model holds the two characters next to each other:
before a blank mark that follows another character (if the model has no piece with
one inside), and at any pair of characters that no piece has.  Each distinct word of
a batch is encoded once.  Normalisation and decoding are the library's.

Scale.  One narrow map, no shuffle; the model (under a megabyte) travels with the
tasks, so executors need no file.  A task holds ``batch_chars`` characters of texts
and the ids of at most ``cache_chars`` characters of distinct words.

Supported models: BPE with byte fallback and without unused or user-defined pieces;
others raise ValueError on the driver.

Defined results: a null or empty text has the begin and end ids alone and decodes to
the empty text; rows with equal ids are encoded each by itself; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

BLANK = "▁"
NO_PAIR = np.iinfo(np.int64).max


class Numbers(dict):
    """Numbers things in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PieceModel:
    """A sentencepiece BPE model as lookup arrays; ``encode`` and ``decode`` whole texts."""

    def __init__(self, proto: bytes, cache_chars: int = 8_000_000):
        from sentencepiece import SentencePieceProcessor

        self.lib = sp = SentencePieceProcessor(model_proto=proto)
        self.size, self.cache_chars = len(sp), cache_chars
        kind = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        normal = {sp.id_to_piece(i): i for i in range(self.size) if not kind(i)}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "<u4")
        if any(sp.is_unused(i) for i in range(self.size)) or not all(sp.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("only models with byte fallback and without unused pieces")
        scores = {z: sp.get_score(i) for z, i in normal.items()}
        # symbols: pieces by their id, and after them characters that stand in pieces but are none
        symbols = dict(normal)
        for c in sorted({c for z in normal for c in z} - normal.keys()):
            symbols[c] = self.size + len(symbols) - len(normal)
        self.n_symbols = self.size + len(symbols) - len(normal)
        chars = sorted((ord(c), k) for c, k in symbols.items() if len(c) == 1)
        self.chars = np.array([c for c, _ in chars], np.int64)
        self.char_symbols = np.array([k for _, k in chars], np.int64)
        self.symbol_char = np.full(self.n_symbols, -1, np.int64)
        self.symbol_char[self.char_symbols] = self.chars
        pairs = {}
        for z, i in normal.items():
            for k in range(1, len(z)):
                x, y = symbols.get(z[:k]), symbols.get(z[k:])
                if x is not None and y is not None:
                    pairs[x * self.n_symbols + y] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        by_score = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = np.full(self.n_symbols, -1, np.int64)
        for z, i in normal.items():
            rank[i] = by_score[scores[z]]
        self.pair_rank = rank[self.pair_piece]
        # pieces that can go on to a pair which ranks no later than they do
        early = set()
        for part in (self.pair_keys // self.n_symbols, self.pair_keys % self.n_symbols):
            early.update(part[(self.pair_rank <= rank[part]) & (self.symbol_char[part] < 0)].tolist())
        self.single = np.zeros(self.n_symbols, bool)
        self.single[sorted(early)] = True
        inner = {(ord(a), ord(b)) for z in normal for a, b in zip(z, z[1:])}
        self.bigrams = np.array(sorted(a << 32 | b for a, b in inner), np.int64)
        own_words = not any(b == ord(BLANK) and a != b for a, b in inner)
        self.words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if own_words else r"[\s\S]+")
        self._clear()

    def _clear(self) -> None:
        self.known, self.known_chars = Numbers(), 0  # word -> its number; word k has ids table[ends[k]:ends[k + 1]]
        self.table, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        place = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        sym = np.where(self.chars[place] == code, self.char_symbols[place], -1 - code)  # below 0: in no piece
        # segments: stretches of a word without a pair of characters that no piece holds
        near = np.minimum(np.searchsorted(self.bigrams, code[:-1] << 32 | code[1:]), len(self.bigrams) - 1)
        joint = (word[:-1] == word[1:]) & (self.bigrams[near] == (code[:-1] << 32 | code[1:]))
        seg = np.append(0, np.cumsum(~joint)) if len(code) else np.zeros(0, np.int64)
        pair_rank, piece = self._pairs(sym, seg, np.arange(len(sym)))
        done = []
        while len(sym):
            begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            least_of = np.repeat(np.minimum.reduceat(pair_rank, begin), np.diff(np.append(begin, len(seg))))
            over = least_of == NO_PAIR
            if over.any():
                done.append((seg[over], sym[over], word[over]))
                go = ~over
                sym, seg, word, pair_rank, piece, least_of = (x[go] for x in (sym, seg, word, pair_rank, piece, least_of))
                if not len(sym):
                    break
            at = np.flatnonzero(pair_rank == least_of)
            # pairs that overlap: every other one of a chain, from its left end
            fresh = np.append(True, at[1:] != at[:-1] + 1)
            chain = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - chain) % 2 == 0]
            alone = self.single[piece[at]]
            if alone.any():
                first = np.append(True, seg[at][1:] != seg[at][:-1])
                at = at[first | ~alone]
            sym[at] = piece[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, seg, word, pair_rank, piece = (x[stay] for x in (sym, seg, word, pair_rank, piece))
            # only the pairs beside a joined piece are new
            now = at - np.arange(len(at))
            for new in (now, np.maximum(now - 1, 0)):
                pair_rank[new], piece[new] = self._pairs(sym, seg, new)
        if not done:
            return np.zeros(0, "<u4"), np.zeros(len(words), np.int64)
        seg, sym, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(seg, kind="stable")
        return self._ids(sym[order], word[order], len(words))

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of the symbols ``at`` with the next ones of their segments."""
        to = np.minimum(at + 1, len(sym) - 1)
        left, right = sym[at], sym[to]
        key = left * self.n_symbols + right
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        fits = (self.pair_keys[place] == key) & (seg[at] == seg[to]) & (to > at) & (left >= 0) & (right >= 0)
        return np.where(fits, self.pair_rank[place], NO_PAIR), self.pair_piece[place]

    def _ids(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids; characters that are no piece as the ids of their UTF-8 bytes."""
        odd = (sym < 0) | (sym >= self.size)
        if not odd.any():
            return sym.astype("<u4"), np.bincount(word, minlength=n_words)
        code = np.where(sym[odd] < 0, -1 - sym[odd], self.symbol_char[np.maximum(sym[odd], 0)])
        uniq, which = np.unique(code, return_inverse=True)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in uniq.tolist()]
        width = np.fromiter(map(len, raw), np.int64, len(raw))
        from_ = np.append(0, np.cumsum(width))
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = np.ones(len(sym), np.int64)
        sizes[odd] = width[which]
        ends = np.cumsum(sizes)
        out = np.zeros(ends[-1], "<u4")
        out[(ends - 1)[~odd]] = sym[~odd]
        at = np.repeat((ends - sizes)[odd] - np.append(0, np.cumsum(width[which])[:-1]), width[which])
        src = np.repeat(from_[which] - np.append(0, np.cumsum(width[which])[:-1]), width[which])
        k = np.arange(len(at))
        out[at + k] = flat[src + k]
        return out, np.bincount(word, weights=sizes, minlength=n_words).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the begin and end ids."""
        if self.known_chars > self.cache_chars:
            self._clear()
        known, had = self.known, len(self.known)
        split = [self.words.findall(self.lib.normalize(t)) if t else [] for t in texts]
        split = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in split]
        new = list(islice(reversed(known), len(known) - had))[::-1]
        if new:
            ids, counts = self.rounds(new)
            self.known_chars += sum(map(len, new))
            self.table = np.concatenate([self.table, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        out = []
        bos, eos = (np.array([x], "<u4") for x in (self.lib.bos_id(), self.lib.eos_id()))
        for k in split:
            first, count = self.ends[k], self.ends[k + 1] - self.ends[k]
            upto = np.cumsum(count)
            body = self.table[np.arange(upto[-1] if len(k) else 0) + np.repeat(first - (upto - count), count)]
            out.append(np.concatenate([bos, body, eos]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.lib.decode(ids.tolist())


def piece_model(proto: bytes) -> PieceModel:
    """The worker process's model: its cache of words outlives a task."""
    held = sys.modules.setdefault("_piece_models", types.ModuleType("_piece_models")).__dict__
    key = hashlib.sha256(proto).hexdigest()
    if key not in held:
        held[key] = PieceModel(proto)
    return held[key]


def read_model(path: str) -> bytes:
    """The model's bytes, checked to be of a supported kind: its own pieces, strung together, are encoded both ways."""
    with open(path, "rb") as f:
        proto = f.read()
    model = piece_model(proto)
    words = [model.lib.id_to_piece(i).replace(BLANK, " ") for i in range(model.size)]
    probe = ["".join(words[k:k + 16]) for k in range(0, len(words), 16)]
    want = model.lib.encode(probe, add_bos=True, add_eos=True, num_threads=1)
    if any(got.tolist() != ids for got, ids in zip(model.encode(probe), want)):
        raise ValueError("not a BPE model without user-defined pieces")
    return proto


def encode(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False,
           batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]): the ids of each whole text as little-endian unsigned 32-bit numbers,
    and, if asked for, the text that they decode to."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        model = piece_model(proto)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces(texts, batch_chars):
                got = model.encode([t or "" for t in texts[a:b]])
                cols = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                        "ids": pa.array([x.tobytes() for x in got], pa.binary())}
                if decoded:
                    cols["decoded"] = pa.array([model.decode(x) for x in got], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return src.mapInArrow(run, f"doc_id {src.dtypes[0][1]}, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, proto: bytes, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, decoded) of ids as ``encode`` gives them; null ids decode to null."""
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        model = piece_model(proto)
        for batch in batches:
            text = [None if x is None else model.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "decoded"])

    return src.mapInArrow(run, f"doc_id {src.dtypes[0][1]}, decoded string")
