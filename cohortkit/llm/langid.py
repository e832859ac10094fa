"""Language ID as a mixture: expectation-maximisation over n-gram likelihoods.

A model of each language gives every word a likelihood from its character n-grams.
A document's words are drawn from a mixture of languages; EM estimates the
proportions.  The set of languages is chosen by penalised likelihood: languages
are added in order of their proportion while the log likelihood gains more than
``penalty`` x log(words) each.  The document's language is the largest of the
chosen set; its score is its proportion.  The whole set and its proportions are
returned as well, largest first.

Training counts n-grams per language on a bounded sample of the labelled rows,
about ``train_rows`` in all (documented bound, picked by a hash of the id); the
model has ``2 ** table_bits`` entries a language.  Prediction reads every whole
text once, with no shuffle; words repeated in a batch are scored once.

Defined results: a null text or one without a letter is ``und`` with score 0 and no mixture; ties
go to the language first in the alphabet; with no labelled row every text is
``und``; repeated rows are each predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LangId:
    train_rows: int = 8_000
    table_bits: int = 16
    orders: tuple = (1, 2, 3)
    smooth: float = 0.5
    rounds: int = 12
    penalty: float = 2.0
    piece_chars: int = 2_000_000


def words_of(texts: list, bound: int):
    """(unique words as bytes, word number of each token, number of tokens of each text)."""
    # lower case before splitting; white space at either end would split off an empty word
    arr = pa.array([(t.lower().strip(" \t\n\r\x0b\x0c") or None) if t else None for t in texts], pa.large_string())
    split = pc.ascii_split_whitespace(arr)
    flat = split.flatten()
    counts = np.diff(split.offsets.to_numpy())
    code = pc.dictionary_encode(flat)
    if isinstance(code, pa.ChunkedArray):
        code = code.combine_chunks()
    return [w.encode() for w in code.dictionary.to_pylist()], code.indices.to_numpy(zero_copy_only=False), counts


def gram_slots(words: list[bytes], orders, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of every byte n-gram of every word, words fenced by blanks."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + 1)  # index of the blank after each word
    owner = np.searchsorted(ends, np.arange(len(buf)), side="left")  # a blank belongs to the word before it
    slots, who = [], []
    h = np.zeros(len(buf), dtype=np.uint64)
    for n in range(1, max(orders) + 1):
        h = h[:len(buf) - n + 1] * np.uint64(257) + buf[n - 1:] + np.uint64(1)
        if n not in orders:
            continue
        a = np.arange(len(h))
        last = owner[a + n - 1]
        # a gram may begin with the blank before its word and end with the blank after it
        ok = (owner[np.minimum(a + (n > 1), len(buf) - 1)] == last) & (last < len(words))
        if n == 1:
            ok &= buf[a] != 32
        mixed = (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        slots.append((mixed >> np.uint64(64 - bits))[ok].astype(np.int64))
        who.append(last[ok])
    return np.concatenate(slots), np.concatenate(who)


@dataclass
class Model:
    langs: list
    table: np.ndarray  # float32, (slots, languages): log likelihood of a gram
    how: LangId

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """(words, languages): mean log likelihood of each word's grams, times its letters."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float64)
        for a in range(0, len(words), 200_000):
            part = words[a:a + 200_000]
            slots, who = gram_slots(part, self.how.orders, self.how.table_bits)
            n = np.bincount(who, minlength=len(part))
            for j in range(len(self.langs)):
                out[a:a + len(part), j] = np.bincount(who, self.table[slots, j], minlength=len(part))
            out[a:a + len(part)] /= len(self.how.orders)
        return out

    def predict(self, texts: list) -> tuple[list, list, list]:
        """(language, score, mixture) lists; a mixture is (language, proportion) pairs, largest first."""
        langs, scores, mixtures = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not rows or not self.langs:
            return langs, scores, mixtures
        words, token, counts = words_of([texts[i] for i in rows], 0)
        score = self.word_scores(words)
        score -= score.max(axis=1, keepdims=True)
        like = np.exp(score)[token]  # tokens x languages
        at = np.repeat(np.arange(len(rows)), counts)
        start = np.cumsum(counts) - counts
        has = counts > 0

        def per_doc(x):
            out = np.zeros((len(rows), *x.shape[1:]))
            out[has] = np.add.reduceat(x, start[has], axis=0)
            return out

        def em(share, rounds):
            for _ in range(rounds):
                r = like * share[at]
                r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
                share = per_doc(r) / np.maximum(counts, 1)[:, None]
            return share, per_doc(np.log(np.maximum((like * share[at]).sum(axis=1), 1e-300)))

        k = len(self.langs)
        full, _ = em(np.full((len(rows), k), 1.0 / k), self.how.rounds)
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        best = np.where(rank == 0, 1.0, 0.0)
        best_ll = per_doc(np.log(np.maximum((like * best[at]).sum(axis=1), 1e-300)))
        cost = self.how.penalty * np.log(np.maximum(counts, 2))
        going = np.ones(len(rows), dtype=bool)
        for size in range(2, k + 1):  # one more language while it pays
            share = np.where(rank < size, np.maximum(full, 1e-6), 0.0)
            share, ll = em(share / share.sum(axis=1, keepdims=True), 3)
            going &= ll - best_ll > cost
            if not going.any():
                break
            best, best_ll = np.where(going[:, None], share, best), np.where(going, ll, best_ll)
        top = best.argmax(axis=1)
        for n, i in enumerate(rows):
            langs[i], scores[i] = self.langs[top[n]], float(min(1.0, best[n, top[n]]))
            share = best[n].tolist()
            mixtures[i] = [(self.langs[j], min(1.0, share[j])) for j in sorted(range(k), key=lambda j: -share[j]) if share[j] > 0]
        return langs, scores, mixtures


def train(docs: DataFrame, how: LangId = LangId(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """n-gram model of each language among the rows of ``docs`` with a language."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    slots = 1 << 20
    most = max(1, min(slots, int(slots * how.train_rows / max(n, 1))))
    rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(slots)) < most)
    orders, bits = how.orders, how.table_bits

    def run(batches):
        total: dict = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces(texts, how.piece_chars):
                for lang in set(langs[a:b]):
                    words, token, _ = words_of([t for t, x in zip(texts[a:b], langs[a:b]) if x == lang], 0)
                    if words:
                        times = np.bincount(token, minlength=len(words))
                        s, who = gram_slots(words, orders, bits)
                        total[lang] = total.get(lang, 0) + np.bincount(s, times[who], minlength=1 << bits)
        for lang, c in total.items():
            slot = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot),
                                              pa.array(c[slot].astype(np.int64))], ["lang", "slot", "n"])

    got = (rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
           .mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    # at most 2 ** table_bits counts a language, languages as many as the labels name
    got = got.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts")).orderBy("lang")
    langs, cols = [], []
    for r in got.collect():
        c = np.full(1 << bits, how.smooth)
        c[np.array(r.slots, dtype=np.int64)] += np.array(r.counts, dtype=float)
        langs.append(r.lang)
        cols.append(np.log(c / c.sum()))
    return Model(langs, np.stack(cols, axis=1).astype(np.float32) if cols else np.zeros((1 << bits, 0), np.float32), how)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, langs, shares) of every row, from the text alone."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores, mixtures = [], [], []
            for a, b in pieces(texts, model.how.piece_chars):
                x, y, z = model.predict(texts[a:b])
                langs += x
                scores += y
                mixtures += z
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([[x for x, _ in m] for m in mixtures], pa.list_(pa.string())),
                 pa.array([[p for _, p in m] for m in mixtures], pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "langs", "shares"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double, "
                               "langs array<string>, shares array<double>")
