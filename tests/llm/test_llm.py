"""The training-data operators against brute force, with the cases their docstrings define."""

import base64
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortkit.llm import (bitplane, common, components, decontam, hilbert, langid, log_templates, mixing, quality, queries,
                           simhash, substring_dedup, warc_index)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(1, None, "en", "a", 3), (2, "", None, None, None), (3, "one two three", "en", "a", 1),
            (3, "one two three", "en", "a", 1), (None, "one two three", "fr", "b", 9), (5, "word " * 30000, "en", "a", 7),
            (6, "\n\n  \n", "en", "b", 2), (7, "only some clean words here that are all different from the rest", "fr", "b", 5)]
    clash = ["n_words", "kept", "rule", "fp", "component_id", "tokens", "prob", "topic", "shard", "slot", "removed", "n_lines",
             "n_dropped", "key", "node", "root"]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("own") for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 ------------------------------------------------------------------------

def test_substring_dedup_brute_force(docs, texts):
    how = substring_dedup.Units()
    first = {}
    for d in sorted(texts):
        for a, b, h in substring_dedup.units(texts[d], how):
            first.setdefault(h, (d, a))
    want = {d: substring_dedup.without(t, sorted({(a, b) for a, b, h in substring_dedup.units(t, how) if first[h] != (d, a)}))
            for d, t in texts.items()}
    got = {r.doc_id: r.text for r in substring_dedup.dedup(docs).collect()}
    assert got == want and any(got[d] != texts[d] for d in got)


def test_substring_dedup_cases(spark, odd, empty):
    line = "a shared line of more than eight words in all documents"
    df = spark.createDataFrame([(4, f"x\n{line.upper()}\ny"), (2, line), (9, None), (1, "only a few words")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed) for r in substring_dedup.dedup(df).collect()}
    assert got[2] == (line, None) and got[9] == (None, None)
    assert got[4][0] == "x\ny" and [tuple(x) for x in got[4][1]] == [(2, 2 + len(line), 2)]
    assert substring_dedup.dedup(empty).count() == 0
    assert substring_dedup.dedup(odd).count() == odd.count()


def test_units_resume_inside_a_passage():
    passage = "Short one. This sentence has clearly more than eight words in it. Tail. And yet another sentence with enough words inside."
    how = substring_dedup.Units()
    a = {h for *_, h in substring_dedup.units("Lead words here. " + passage, how)}
    b = {h for *_, h in substring_dedup.units("Something else entirely before the passage starts, see. " + passage, how)}
    assert len(a & b) >= 1


def test_substring_dedup_passages_and_short_lines(spark):
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = [(0, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]))]
    for k in range(1, 40):  # at every offset, in one line or in short ones
        lead, tail = [word() for _ in range(k)], [word() for _ in range(40)]
        rows.append((k, " ".join(lead) + " " + (" " if k % 2 else "\n").join(passage) + " " + " ".join(tail)))
    rows += [(100, "Read more\nfirst own words"), (101, "second own words\nread  more\nend")]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[100] == rows[-2][1] and got[101] == "second own words\nend"
    for d, t in rows[1:40]:
        left, all_words = got[d].split(), t.split()
        assert left[:d] == all_words[:d] and left[-40:] == all_words[-40:]
        assert len(left) - d - 40 <= 45 and not any(left[i:i + 50] == passage[j:j + 50] for i in range(len(left)) for j in range(11))


# -- 2 ------------------------------------------------------------------------

def test_loser_tree():
    rnd = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        for _ in range(10):
            runs = [sorted(rnd.randrange(40) for _ in range(rnd.randrange(8))) for _ in range(k)]
            assert list(warc_index.merge_runs(runs)) == sorted(sum(runs, []))


def test_warc_round_trip(spark):
    pages = common.table(spark, SF, "pages").select("page_id", "url", "html")
    extra = spark.createDataFrame([(900001, "http://x.org/a", None), (900002, None, ""), (900003, "http://x.org/a", "WARC/1.1\r\n\r\n"),
                                   (900004, "bad [url", "WARC/1.1\r\n\r\n"), (None, "http://y.org", "z")], "page_id long, url string, html string")
    both = pages.unionByName(extra)
    html = {r.page_id: (r.html or "").encode() for r in both.collect()}
    last = {}
    for p, h in html.items():
        if p is not None:
            last[h] = max(last.get(h, p), p)
    got = warc_index.capture_index(both).toPandas().sort_values(["range_no", "place"])
    assert len(got) == len(html)
    for r in got.itertuples():
        p = None if np.isnan(r.page_id) else int(r.page_id)
        assert r.payload_bytes == len(html[p])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[p]).digest()).decode()
        if p is not None:
            assert (r.record_type, r.refers_to if r.record_type == "revisit" else last[html[p]]) == (
                ("response", p) if last[html[p]] == p else ("revisit", last[html[p]]))
    keys = [(r.urlkey, r.captured) for r in got.itertuples()]
    assert keys == sorted(keys)
    assert warc_index.capture_index(pages.limit(0)).count() == 0


def test_warc_files_close_after_so_many_records(spark):
    pages = common.table(spark, SF, "pages").select("page_id", "url", "html")
    how = warc_index.Warc(file_records=7)
    path = common.stage_path(spark, "warc-test")
    files = warc_index.write_archives(pages, path, how)
    assert {r.records for r in files.collect()} >= {7} and files.agg(F.max("records")).first()[0] == 7
    runs = warc_index.read_runs(spark, path, files)
    assert runs.groupBy("file").count().agg(F.max("count")).first()[0] == 7
    order = [r.page_id for r in warc_index.merge_index(runs, how).orderBy("range_no", "place").collect()]
    whole = [r.page_id for r in warc_index.capture_index(pages).orderBy("range_no", "place").collect()]
    assert order == whole and len(whole) == pages.count()


# -- 3 ------------------------------------------------------------------------

def brute_templates(texts, how):
    """{(doc, line)} that go, by plain counting: stretches in a leaf, the commonest tokens, the share that agrees."""
    docs_of, lines_of, lines = defaultdict(set), defaultdict(list), {}
    for d, t in texts.items():
        for i, line in enumerate((t or "").split("\n")):
            raw = WORDS.findall(line)
            w = ["<*>" if re.search("[0-9]", x) else x for x in raw]
            w = w if any(not re.search("[0-9]", x) for x in raw) else raw
            n = len(w)
            if n:
                cuts = [n * p // how.parts for p in range(how.parts + 1)]
                lines[d, i] = [(n, "all", *w)] + [(n, p, w[0], *w[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))
                                                  if n >= how.min_tokens]
                for k in lines[d, i]:
                    docs_of[k].add(d)
                    lines_of[k].append((d, i, w))
    gone = set()
    for k, held in lines_of.items():
        least = how.min_docs if k[0] >= how.min_tokens else how.short_docs
        if len(docs_of[k]) < least:
            continue
        if k[1] != "all":
            top = [max((n, x) for x, n in Counter(w[j] for *_, w in held).items())[1] for j in range(k[0])]
            held = [x for x in held if sum(a == b for a, b in zip(x[2], top)) >= how.agree * k[0]]
            if len({x[0] for x in held}) < how.min_docs:
                continue
        gone |= {(d, i) for d, i, _ in held}
    return gone


@pytest.mark.parametrize("how", [log_templates.Tree(), log_templates.Tree(min_docs=3, short_docs=4)])
def test_log_templates_brute_force(spark, docs, texts, how):
    planted = {10 ** 6 + i: f"{n} text of {i}\nUser {n} logged in from the host {c} without error\nIn the end {n} met {c}\n1 2 3 4 5 6 7"
               for i, (n, c) in enumerate(zip(NAMES, CITIES))}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    texts = {**texts, **planted}
    gone = brute_templates(texts, how)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}
    got = {r.doc_id: (r.text, r.n_dropped) for r in log_templates.drop_templates(df, how).collect()}
    assert {d: x[0] for d, x in got.items()} == want
    assert sum(x[1] for x in got.values()) == len(gone) > 0
    assert all("logged in" not in got[d][0] for d in planted)


NAMES = "Ann Bob Cid Dora Eve Finn Gus Hal Ida Jon Kim Lea".split()
CITIES = "Oslo Rome Bern Riga Cork Lima Kiev Nice Bonn Graz Pisa York".split()


def test_log_templates_token_by_token(spark):
    """Fields without digits in two places are one template; sentences that share two thirds of six words are none."""
    figures = [" ".join(str((i * 37 + j * 101) % 997) for j in range(8)) for i in range(12)]
    rows = [(i, f"User {n} logged in from the host {c} without error\nIn the end {n} met {c}\n{figures[i]}")
            for i, (n, c) in enumerate(zip(NAMES, CITIES))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in log_templates.drop_templates(df).collect()}
    assert got == {i: (f"In the end {n} met {c}\n{figures[i]}", 1) for i, (n, c) in enumerate(zip(NAMES, CITIES))}
    found = {(r.template, r.n_docs) for r in log_templates.templates(df).collect()}
    assert found == {("User <*> logged in from the host <*> without error", 12)}


def test_log_templates_fields(spark, odd, empty):
    rows = [(i, f"User number {i} signed in from host alpha{i} today\nown line {i} of document kept as it is {'abcdefghij'[i]}x") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = log_templates.Tree(min_docs=10)
    found = {r.template: r.n_docs for r in log_templates.templates(df, how).collect()}
    assert found["User number <*> signed in from host <*> today"] == 10
    assert all("signed" not in r.text for r in log_templates.drop_templates(df, how).collect())
    assert log_templates.drop_templates(odd).count() == odd.count() and log_templates.drop_templates(empty).count() == 0


def test_log_templates_short_lines(spark):
    rows = [(i, f"Share this\n\nown words {'abcdefghijk'[i]}x\n{i + 100}\n2024\nPage {i} of 9") for i in range(11)]
    df = spark.createDataFrame(rows + [(50, "Share this page")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in log_templates.drop_templates(df).collect()}
    assert got == {**{i: f"\nown words {'abcdefghijk'[i]}x\n{i + 100}" for i in range(11)}, 50: "Share this page"}
    assert {(r.template, r.n_docs) for r in log_templates.templates(df).collect()} >= {("Share this", 11), ("Page <*> of <*>", 11)}


# -- 4 ------------------------------------------------------------------------

def test_bitplane_encoder_equals_library(texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    hard = ["it's   a test\n\n  x", "a<|endoftext|>b it's", "", "don't 'stuff' 1st  2nd\t\tx ", "\n\nab\n c", "x　 y été's×a",
            "I'll we've 'd 9's \x1c z", "日本 語  x", "a é b\né", "x" * 5000, "A1b2's'tx!?a #$% é1"]
    some = hard + list(texts.values())[:60]
    got = bitplane.Encoder(path, cache=500).encode([t.encode() for t in some])
    for t, ids in zip(some, got):
        assert list(ids) == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_bitplane_file(unit):
    rnd = np.random.default_rng(1)
    sets = [rnd.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 999, 5000, 3)]
    out = io.BytesIO()
    w = bitplane.Writer(out, bitplane.Planes(block=1000, unit=unit))
    for i, x in enumerate(sets):
        w.add(i, x)
    w.close()
    r = bitplane.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert all((a == b).all() for (_, a), b in zip(r.documents(), sets, strict=True))
    assert (r.ids(900, 2100) == np.concatenate(sets)[900:2100]).all()


def test_bitplane_query(spark, docs, texts, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in queries.op4_bitplane_ids(spark, SF).collect()}
    at = 0
    for d in sorted(texts):
        ids = np.array(tok.encode(texts[d], add_special_tokens=False).ids + [0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bitplane.encode_documents(odd, queries.tokenizer_path()).count() == odd.count()
    assert bitplane.encode_documents(empty, queries.tokenizer_path()).count() == 0


def test_bitplane_null_ids_stay_null(spark):
    rows = [(-1, "b"), (None, "a long one"), (-5, "c"), (None, None), (0, "d"), (2 ** 63 - 1, "e"), (-2 ** 63, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bitplane.encode_documents(docs, queries.tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -2 ** 63, -5, -1, 0, 2 ** 63 - 1]
    assert got[0].n_tokens == 1 and got[1].n_tokens > 1  # rows of one id go by text, nulls first
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


# -- 5 ------------------------------------------------------------------------

def test_hilbert_curve_steps_to_neighbours():
    n, bits = 3, 3
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    index = hilbert.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    walk = points[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_shards(spark, docs, odd, empty):
    got = hilbert.shards(docs.unionByName(docs), 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    few = hilbert.shards(odd, 16)
    assert few.count() == odd.count() and sorted(r.shard for r in few.collect()) == list(range(odd.count()))
    assert hilbert.shards(empty).count() == 0


# -- 6 ------------------------------------------------------------------------

def edits_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_decontamination_brute_force(spark, docs, texts):
    items = common.table(spark, SF, "benchmark").collect()
    grams = defaultdict(set)
    for r in items:
        w = r.text.lower().split()
        for i in range(len(w) - 4):
            grams[tuple(w[i:i + 5])].add(r.item_id)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, common.table(spark, SF, "benchmark")).collect()}
    shared = set()
    for d, t in texts.items():
        w = t.lower().split()
        shared |= {(d, i) for k in range(len(w) - 4) for i in grams.get(tuple(w[k:k + 5]), ())}
    assert got and got == shared  # the table's leaks are whole items, found here by shared word runs


def test_decontamination_edits_and_cases(spark, odd, empty):
    rnd = random.Random(5)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(260))
    how = decontam.Decontam()
    rows = []
    for n, edits in enumerate((0, 3, 6, 9)):  # within a tenth of every window
        s = list(item)
        for at in sorted(rnd.sample(range(0, 260, 24), edits), reverse=True):
            s[at:at + 1] = rnd.choice([[], ["z"], ["z", s[at]]])
        rows.append((n, "lead " * 40 + "".join(s).upper().replace(" ", "\n ") + " tail" * 40))
    rows += [(100, item[:99]), (101, "nothing of it " * 50), (102, None), (103, ""), (104, item[100:215])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    got = {r.doc_id for r in decontam.find_leaks(df, bench, how).collect()}
    assert got >= {0, 1, 2, 3} and not got & {101, 102, 103}
    one_by_one = {r.doc_id for r in decontam.find_leaks(df, bench, decontam.Decontam(block_chars=1)).collect()}
    assert one_by_one == got
    kept = {r.doc_id for r in decontam.drop_leaks(df, bench, how).collect()}
    assert kept == {r[0] for r in rows} - got
    assert decontam.drop_leaks(odd, bench).count() == odd.count() and decontam.drop_leaks(empty, bench).count() == 0
    assert decontam.drop_leaks(odd, bench.limit(0)).columns == odd.columns


def test_decontamination_blocks_are_read_by_tasks(spark):
    rnd = random.Random(23)
    item = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(150))
    texts = [item() for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[1])] + [(3, texts[3])] * 4
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(i, "lead " * 9 + t + " tail" * 9) for i, t in enumerate(texts)], "doc_id long, text string")
    small = decontam.Decontam(block_chars=1_500)
    folders = decontam.store_blocks(bench, small)
    held = [decontam.read_block.__wrapped__(f, small) for f in folders]
    assert len(folders) >= 10 and sum(sum(times) for _, times, _ in held) == len(rows)
    assert sorted(i for ids, _, _ in held for i in ids) == sorted(i for i, _ in set(rows))
    key = lambda how: sorted(map(tuple, decontam.find_leaks(docs, bench, how).collect()))
    whole = key(decontam.Decontam())
    assert key(small) == whole and {r[0] for r in whole} == set(range(40))
    assert Counter(r[:2] for r in whole)[3, 3] == 5 * Counter(r[:2] for r in whole)[2, 2]  # repeated items are all reported


def test_decontamination_counts_in_parts(monkeypatch):
    rnd = random.Random(11)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(260))
    patterns = decontam.Patterns([(1, "ab" * 200), (2, item)], decontam.Decontam())
    texts = ["ab" * 30_000, "x" + item[:150] + "ab" * 90, "nothing of it " * 50]
    found = []
    for held in (10 ** 9, 1_000, 1):  # one position at a time at the least
        monkeypatch.setattr(decontam, "SHARED", held)
        found.append(sorted(decontam.leaks(patterns, patterns.table(), texts if held > 1 else texts[1:], 0 if held > 1 else 1)))
    assert found[0] == found[1] and {(r[0], r[1]) for r in found[0]} == {(0, 1), (1, 1), (1, 2)}
    assert found[2] == [r for r in found[0] if r[0] > 0]


def test_decontamination_stays_inside_a_text():
    rnd = random.Random(3)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(100))
    patterns = decontam.Patterns([(1, item)], decontam.Decontam())
    for lead in range(25):  # the bands' borders fall everywhere
        for cut in (1, 5, 9):
            texts = ["z" * lead + item[:-cut], "clean " * 30, item[cut:] + "z", "clean " * 30, item[:50], item[50:]]
            assert {r[0] for r in decontam.leaks(patterns, patterns.table(), texts)} == {0, 2}


def test_decontamination_parts_at_every_offset_and_short_items():
    rnd = random.Random(17)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    how = decontam.Decontam()
    items = [(1, item), (2, "the quick answer"), (3, "is 42"), (4, "xy")]
    size = how.window + how.stride - 1
    texts = ["clean prose " * 9 + item[a:a + size] + " clean prose" * 9 for a in range(len(item) - size + 1)]
    texts += ["so The  quick answer.", "so the quick answers", "it (is 42)", "is 421", "an xy", "axy", "xy"]
    got = defaultdict(set)
    for p in decontam.by_gram(items, how):
        for r in decontam.leaks(p, p.table(), texts):
            got[r[0]].add(r[1])
    n = len(item) - size + 1
    assert all(1 in got[i] for i in range(n))
    assert [got[n + i] for i in range(7)] == [{2}, set(), {3}, set(), {4}, set(), {4}]


def test_banded_equals_full_alignment():
    rnd = random.Random(9)
    for _ in range(30):
        p = "".join(rnd.choice("ab ") for _ in range(30))
        t = "".join(rnd.choice("ab ") for _ in range(15)) + p[:12] + "x" + p[13:25] + p[26:] + "bbb"
        c = np.array([ord(x) for x in t], np.uint32)
        edits, _ = decontam.banded([np.array([ord(x) for x in p], np.uint32)], c, np.array([-40]), np.array([len(t) + 80]))
        assert edits[0] == edits_within(p, t)


# -- 7 ------------------------------------------------------------------------

def test_language_accuracy(spark, docs):
    got = queries.op7_language_mixture(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()


def plain_mixture(model, text):
    """The mixture of one text by plain loops: a word's grams, EM over its words, languages added while they pay."""
    how, k, wrap = model.how, len(model.langs), (1 << 64) - 1

    def score(word):
        raw, out = b" " + word + b" ", [0.0] * k
        for n in how.orders:
            for a in range(len(raw) - n + 1):
                if n == 1 and raw[a] == 32:
                    continue
                h = 0
                for byte in raw[a:a + n]:
                    h = (h * 257 + byte + 1) & wrap
                slot = ((h * 0x9E3779B97F4A7C15 + n) * 0xBF58476D1CE4E5B9 & wrap) >> (64 - how.table_bits)
                out = [x + float(model.table[slot, j]) for j, x in enumerate(out)]
        out = [x / len(how.orders) for x in out]
        return [math.exp(x - max(out)) for x in out]

    known, like = {}, []
    for w in text.lower().encode().split():
        like.append(known.setdefault(w, None) or known.__setitem__(w, score(w)) or known[w])

    def em(share, rounds):
        for _ in range(rounds):
            total = [0.0] * k
            for row in like:
                part = [x * s for x, s in zip(row, share)]
                whole = max(sum(part), 1e-300)
                total = [t + p / whole for t, p in zip(total, part)]
            share = [t / len(like) for t in total]
        return share, fit(share)

    def fit(share):
        return sum(math.log(max(sum(x * s for x, s in zip(row, share)), 1e-300)) for row in like)

    full, _ = em([1 / k] * k, how.rounds)
    order = sorted(range(k), key=lambda j: -full[j])
    best = [float(j == order[0]) for j in range(k)]
    best_fit = fit(best)
    for size in range(2, k + 1):
        share = [max(full[j], 1e-6) if j in order[:size] else 0.0 for j in range(k)]
        share, now = em([x / sum(share) for x in share], 3)
        if now - best_fit <= how.penalty * math.log(max(len(like), 2)):
            break
        best, best_fit = share, now
    return {model.langs[j]: best[j] for j in range(k) if best[j] > 0}


def test_language_mixture_brute_force(spark, docs):
    model = langid.train(docs.filter(~queries.held_out()))
    rows = [r.text for r in docs.orderBy("doc_id").collect() if r.text and len(r.text) < 4000]
    rows += [a[:600] + " " + b[:900] for a, b in zip(rows, rows[7:40])]
    langs, scores, mixtures = model.predict(rows)
    for text, lang, score, mixture in zip(rows, langs, scores, mixtures):
        if langid.LETTER.search(text):
            want = plain_mixture(model, text)
            assert dict(mixture) == pytest.approx(want, abs=1e-6)
            assert score == pytest.approx(max(want.values()), abs=1e-6) and (lang, score) == mixture[0]
    assert any(len(m) > 1 for m in mixtures) and any(len(m) == 1 for m in mixtures)


def test_language_cases(spark, docs, odd, empty):
    model = langid.train(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()]
    assert all(lang == "und" and score == 0 for d, lang, score in got if d in (1, 2, 6)) and len(got) == odd.count()
    mixed = [r.text for r in docs.filter("lang = 'en'").limit(3).collect() + docs.filter("lang = 'fr'").limit(3).collect()]
    _, score, mixture = model.predict([mixed[0], mixed[0] + " " + mixed[3]])
    assert score[1] < score[0] and {x for x, _ in mixture[1]} >= {"en", "fr"}
    assert all(langs == [] == shares for d, langs, shares in
               langid.predict(odd, model).select("doc_id", "langs", "shares").collect() if d in (1, 2, 6))
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


# -- 8 ------------------------------------------------------------------------

def test_mixing_meets_targets(spark, docs, odd, empty):
    how = mixing.Mix(targets={"lang": {"en": 0.4, "fr": 0.2}})
    got = mixing.mix(docs, how).toPandas()
    assert len(got) == docs.count() and got.prob.between(0, 1).all()
    mass = got.tokens * got.prob
    share = mass.groupby(got.lang).sum() / mass.sum()
    assert abs(share["en"] - 0.4) < 1e-3 and abs(share["fr"] - 0.2) < 1e-3
    flat = (got.groupby("source").tokens.sum() / got.tokens.sum()) ** 0.5
    have = mass.groupby(got.source).sum() / mass.sum()
    assert np.allclose(have, flat / flat.sum(), atol=2e-3)
    kept = {r.doc_id for r in mixing.sample(docs, how).collect()}
    assert kept == set(got[got.kept].doc_id)
    assert mixing.mix(odd).count() == odd.count() and mixing.sample(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0


def test_mixing_rare_category_does_not_set_the_scale(spark, docs):
    plain = mixing.mix(docs).toPandas()
    rare = spark.createDataFrame([(10 ** 6, "word " * 5, "en", None, 25)], DOCS)
    grown = docs.withColumn("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.col("doc_id") + 10_000 * i)))
    got = mixing.mix(grown.unionByName(rare)).toPandas()
    assert got.prob.between(0, 1).all() and got[got.doc_id == 10 ** 6].prob.item() > 1 - 1e-6
    share = lambda x: (x.tokens * x.prob).sum() / x.tokens.sum()
    assert share(got) >= 0.4 - 1e-3 and abs(share(got) - share(plain)) < 0.02


def brute_rake(cells, how):
    """{cell: prob} by plain IPF, then the same with the inclusion bound, over NumPy arrays."""
    tokens = np.array([float(n) for *_, n in cells])
    group = [np.unique([c[i] for c in cells], return_inverse=True) for i in range(3)]
    margin = lambda x, i: np.bincount(group[i][1], x)
    w, target = tokens / tokens.sum(), []
    for i, d in enumerate(mixing.DIMS):
        named = how.targets.get(d, {})
        flat = np.array([0.0 if c in named else m ** how.temperature[d] for c, m in zip(group[i][0], margin(w, i))])
        fixed = np.array([named.get(c, 0.0) for c in group[i][0]])
        target.append(fixed + flat / flat.sum() * max(0.0, 1 - fixed.sum()))
    for _ in range(how.sweeps):
        for i in range(3):
            w = w * (target[i] / margin(w, i))[group[i][1]]
    ratio = w / tokens
    over = [r for r in ratio if w[ratio >= r].sum() > how.at_bound]
    kept = min(1.0, max(how.min_kept, 1 / (max(over or ratio) * tokens.sum())))
    cap = tokens / (tokens.sum() * kept)
    for i in range(3):
        t, has = target[i], margin(cap, i)
        for _ in range(4):
            t = np.minimum(t, has)
            free = np.where(t < has, t, 0.0)
            t = t + (free * (1 - t.sum()) / free.sum() if free.any() else 0)
        target[i] = t
    w = np.minimum(w, cap)
    for _ in range(how.sweeps):
        for i in range(3):
            w = np.minimum(cap, w * (target[i] / margin(w, i))[group[i][1]])
    for _ in range(4):
        w = np.minimum(cap, w / w.sum())
    return {tuple(c[:3]): min(1.0, x) for c, x in zip(cells, w / cap)}


@pytest.mark.parametrize("one_task_cells, n_sources, sweeps", [(10 ** 6, 1000, 12), (0, 300, 1)])
def test_mixing_rakes_every_category(spark, one_task_cells, n_sources, sweeps):
    """No category is pooled, whatever their number, in one task or over many; the same as plain IPF."""
    how = mixing.Mix(targets={"lang": {"fr": 0.3}, "source": {"s7": 0.05}}, one_task_cells=one_task_cells, sweeps=sweeps)
    cells = [(f"s{i}", lang, topic, 1 + (i * 37 + j * 11 + k * 5) % 97) for i in range(n_sources) for j, lang in enumerate(("en", "fr", "de"))
             for k, topic in enumerate(("a", "b")) if (i + j + k) % 3]
    df = common.stage(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), "test-cells")
    got = {(r.source, r.lang, r.topic): r.prob for r in mixing.rake(df, how).collect()}
    want = brute_rake(cells, how)
    assert got.keys() == want.keys() and max(abs(got[c] - want[c]) for c in want) < 1e-9
    if sweeps > 1:  # the marginals hold: by source, too
        size = {c[:3]: c[3] for c in cells}
        mass = sum(size[c] * p for c, p in got.items())
        share = lambda i, v: sum(size[c] * p for c, p in got.items() if c[i] == v) / mass
        assert abs(share(1, "fr") - 0.3) < 5e-3 and len({c[0] for c in got}) == n_sources


# -- 9 ------------------------------------------------------------------------

def test_quality_counts_brute_force(docs, odd):
    for df in (docs, odd):
        for r in quality.judge(df.select("doc_id", "text"), quality.DecisionList()).collect():
            text = r.text or ""
            w = WORDS.findall(text)
            lines = [x for x in text.split("\n") if WORDS.search(x)]
            seen = defaultdict(list)
            for i in range(len(w) - 4):
                seen[tuple(w[i:i + 5])].append(i)
            twice = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice))
            assert tuple(r[c] for c in quality.COUNTS) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)


def test_quality_rules_learned(spark, docs, odd, empty):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + (" ### $$$ ***" * 3 if i % 4 == 0 else "")) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(1200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rules = quality.learn(df, labels)
    assert rules.rules
    kept = {r.doc_id for r in quality.keep_good(df, rules).collect()}
    assert kept == {i for i in range(1200) if i % 4}
    assert not quality.learn(df, labels.limit(0)).rules and not quality.learn(empty, labels).rules
    assert quality.keep_good(odd, rules).columns == odd.columns
    assert all(r.n_words == "own" for r in quality.keep_good(odd, rules).collect())
    assert quality.keep_good(empty, rules).count() == 0


# -- 10 -----------------------------------------------------------------------

def brute_fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    votes = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_groups(values, tau):
    ids = sorted(values)
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(values[a] ^ values[b]).count("1") <= tau:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def test_simhash_query(spark, texts):
    want = {d: brute_fingerprint(t) for d, t in texts.items()}
    group = brute_groups(want, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_groups(spark, SF).collect()}
    assert got == {d: (f"{want[d]:016x}", group[d]) for d in want}


@pytest.mark.parametrize("bucket_rows,parts", [(4096, None), (8, None), (16, [2]), (4096, [3])])
def test_simhash_links(spark, bucket_rows, parts):
    rnd = random.Random(11)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    values = set()
    for s in seeds:
        for _ in range(25):
            values.add(s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))))
    values |= {0, 7, (1 << 64) - 1}
    signed = {int(np.uint64(v).astype(np.int64)): v for v in values}
    fps = common.stage(spark.createDataFrame([(x,) for x in signed], "fp long"), "test-fps")
    layout = simhash.plan(fps, 3, *([parts] if parts else []))
    assert sum(t + 1 for _, t in layout) == 4
    found = components.components(simhash.links(fps, layout, 3, bucket_rows), "fp", "other")
    root = {r.node: r.root for r in found.collect()}
    got = {x: root.get(x, x) for x in signed}
    want = brute_groups(signed, 3)
    assert len(set(got.values())) == len(set(want.values()))
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in signed for b in list(signed)[:20])


def test_thresholds_by_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(20):
        costs = [[0.0, *(rnd.random() for _ in range(4))] for _ in range(3)]
        every = [(sum(costs[i][t + 1] for i, t in enumerate(ts)), ts) for ts in product(range(-1, 4), repeat=3)
                 if sum(t + 1 for t in ts) == 4]
        cost, ts = simhash.allocate(costs, 3)
        assert sum(t + 1 for t in ts) == 4 and abs(cost - min(every)[0]) < 1e-12


def test_simhash_cases(odd, empty):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(odd).collect()}
    assert {(1, 1), (2, 1), (6, 1), (3, 3), (None, 3)} <= got
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7]
    assert simhash.keep_first(empty).count() == 0


# -- pipeline -------------------------------------------------------------------

def test_pipeline(spark, docs, texts):
    import corpus_pipeline

    at = docs
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        at = common.stage(step(spark, at, SF), "test-pipeline")
        seen[name] = at
    assert all(seen[n].columns == docs.columns for n in list(seen)[:-1])
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in seen.items()}
    prints = {d: brute_fingerprint(texts[d]) for d in ids["quality_rules"]}
    assert ids["simhash_dedup"] == set(brute_groups(prints, 3).values())
    bad = {r.doc_id for r in decontam.find_leaks(docs, common.table(spark, SF, "benchmark")).collect()}
    assert ids["benchmark_decontamination"] == ids["simhash_dedup"] - bad
    assert ids["mixing"] <= ids["benchmark_decontamination"] and ids["hilbert_sharding"] == ids["mixing"]
    again = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert again == ids["hilbert_sharding"]


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        common.table(spark, SF, t).write.parquet(os.path.join(tmp_path, f"{t}.parquet"))
    for df in (odd.drop("shard", "slot"), empty):
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, df, str(tmp_path))
            assert out.count() <= df.count() and set(df.columns) <= set(out.columns)
