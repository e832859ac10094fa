"""Conversation repair, piece encoding and periodic runs against brute force, and the cases their docstrings define."""

import hashlib
import heapq
import random
import re
import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cohortkit.llm import common, conversation_repair, periodic_runs, piece_encoding, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "a b " * 9), (5, "word " * 30000),
            (6, "\n\n  \n"), (7, " x y z\u0085 w " * 4), (90, "<s> a</s> <0x41> ▁b  c\x00 \U0001f600")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["runs", "collapsed", "ids", "n_tokens", "decoded", "start", "_w", "_n", "_a", "_g"]
    return df.withColumns({c: F.lit("own") for c in names})


# -- conversation repair -------------------------------------------------------------

def cheapest(rows):
    """(cost, edits) of (initial, fault) rows by uniform-cost search over (cost, edits)."""
    heap, seen = [(0, "", 0, "")], set()
    keeps = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    while heap:
        cost, edits, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, edits
        if (i, last) in seen:
            continue
        seen.add((i, last))
        put = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, edits + "I", i, put))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (last, initial) in keeps:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, initial))
                heapq.heappush(heap, (cost + 2 + extra, edits + "R", i + 1, put))


def audit_of(rows):
    """The contract's row for one conversation's (turn, role, text) rows after damage, in their order."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        if not words:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, edits = cheapest([(r[:1], f) for (_, r, _), f in zip(rows, faults)])
    out, i, last = [], 0, ""
    for e in edits:
        if e != "D":
            put = "a" if last == "u" else "u"
            last = rows[i][1][:1] if e == "K" else put
            role = rows[i][1] if e == "K" else {"u": "user", "a": "assistant"}[put]
            out.append(f"{role}:{rows[i][2] if e != 'I' else ''}")
        i += e != "I"
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": edits,
            "repaired_sha256": sha("\n".join(out))}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    key = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))


def expected(rows):
    convs = {}
    for conv, *rest in damaged(rows):
        convs.setdefault(conv, []).append(tuple(rest))
    return {c: audit_of(in_order(convs.get(c, []))) for c in {r[0] for r in rows}}


def got_audit(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_repair_query_brute_force(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = got_audit(queries.op11_conversation_repair(spark, SF))
    assert got == expected(rows)
    assert {e for r in got.values() for e in r["audit"]} == set("DIKR")


def test_search_is_cheapest_and_ascii_least():
    rnd = random.Random(4)
    initials = ["", "s", "u", "a"]
    for _ in range(1500):
        n = rnd.randrange(9)
        rows = bytes((2 + i % 2 if rnd.random() < .6 else rnd.randrange(4)) + 4 * rnd.choice([0, 0, 0, 0, 1, 2]) for i in range(n))
        named = [(initials[r & 3], ("", "truncated", "blank")[r >> 2]) for r in rows]
        want = cheapest(named)
        assert conversation_repair.Search(rows).solve()[:2] == want
        cut = rnd.randint(0, n)
        head, tail = rows[:cut], rows[cut:]
        finish = tuple(conversation_repair.Search(tail).solve(s)[0] for s in range(4))
        cost, edits, state = conversation_repair.Search(head, finish).solve()
        assert (cost, edits + conversation_repair.Search(tail).solve(state)[1]) == want
        if head:
            between = conversation_repair.costs_between(head)
            assert min(between[t] + finish[t] for t in range(4)) == want[0]


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_long_conversations_are_cut_and_repaired_as_whole(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(7, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
             rnd.choice(["Yes.", "No", "", f"A thing {t}.", f"B {t}", " \n"])) for t in range(90)]
    rows += [(None, None, None, None), (None, None, "user", "x."), (None, 3, "user", "x."), (8, 1, "system", "s."), (9, 0, "user", "")]
    rows += [(7, 12, "user", "Yes.")] * 5 + [(10, t, "user", "all users.") for t in range(30)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("own") for c in ("conv", "digest", "n", "part", "chunk", "state", "edits", "kind", "cost")})
    how = conversation_repair.Repair(chunk=chunk)
    assert got_audit(conversation_repair.audit(df, conversation_repair.damage(df), how)) == expected(rows)


def test_repair_of_conversations_without_rows(spark):
    schema = "conv_id string, turn int, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert conversation_repair.audit(empty, conversation_repair.damage(empty)).count() == 0
    gone = next(str(k) for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)
    got = got_audit(conversation_repair.audit(df, conversation_repair.damage(df)))
    assert got == {gone: {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                          "repaired_sha256": sha("")}}


# -- piece encoding -------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))


def encoded(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, struct.pack(f"<{len(ids)}I", *ids)


def test_piece_query_against_the_library(spark, docs, library):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids, raw = encoded(library, r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(raw).hexdigest(), sha(library.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_piece_encoding(spark, SF).collect()}
    assert got == want


def test_rounds_against_the_library(library):
    model = piece_encoding.PieceModel(piece_encoding.read_model(queries.tokenizer_path(queries.PIECE_MODEL)), cache_chars=2000)
    rnd = random.Random(6)
    parts = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "é", "日本", "語", "\U0001f600", "\x00", "　",
             "ﬁ", "<s>", "<0x41>", "1", "23", "//", "==", "\t", "the ", "́", "aaa", "-----", "한국", "​"]
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2000), rnd.randrange(0x3000, 0x9fff)]))
                      for _ in range(rnd.randrange(30))) for _ in range(1500)]
    texts += ["", " ", "x" * 50000, "".join(rnd.choice("abcdefghij0123456789") for _ in range(50000))]
    for k in range(0, len(texts), 7):  # many batches, the cache of words is cleared on the way
        for t, ids in zip(texts[k:k + 7], model.encode(texts[k:k + 7])):
            assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True), t


def test_piece_cases(spark, odd, library, tmp_path):
    proto = piece_encoding.read_model(queries.tokenizer_path(queries.PIECE_MODEL))
    out = piece_encoding.encode(odd, proto, decoded=True, batch_chars=50)
    rows = out.collect()
    want = sorted((r.doc_id or -1, encoded(library, r.text)[1]) for r in odd.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in rows) == want
    assert {r.doc_id: r.decoded for r in rows}[1] == "" and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {2}
    again = sorted((r.doc_id or -1, r.decoded) for r in piece_encoding.decode(out, proto).collect())
    assert again == sorted((r.doc_id or -1, r.decoded) for r in rows)
    assert piece_encoding.encode(odd.limit(0), proto).count() == 0
    (tmp_path / "other").write_bytes(b"no model")
    with pytest.raises(Exception):
        piece_encoding.read_model(str(tmp_path / "other"))


# -- periodic runs -----------------------------------------------------------------------

def all_runs(words, least):
    """(start, length, period) of every run, by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1 if j > i else i + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_numbers_brute_force():
    rnd = random.Random(8)
    for _ in range(1500):
        n, k = rnd.randrange(70), rnd.choice([1, 2, 3, 9])
        s = [rnd.randrange(k) for _ in range(n)]
        if n and rnd.random() < .4:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 2))
            s[a:] = [s[a + (i - a) % p] for i in range(a, n)]
        least = rnd.choice([2, 12])
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(s, np.int64), least).tolist()] == all_runs(s, least)
    long = np.array([1, 2, 3] * 5000 + [4] * 3000 + list(range(10, 400)) * 2, np.int64)
    assert periodic_runs.runs_of(long, 12).tolist() == [[0, 15000, 3], [15000, 3000, 1], [18000, 780, 390]]


def test_runs_query_brute_force(spark, docs):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = WORDS.findall(r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]

        runs = all_runs(words, 12) if n <= 3000 else None
        if runs is None:
            continue
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want[r.doc_id] = (len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
                          sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)),
                          sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    got = {r.doc_id: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
           for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {d: got[d] for d in want} == want and any(x[0] for x in want.values()) and len(want) > 100


def test_runs_cases(odd):
    got = periodic_runs.collapse(odd, periodic_runs.Runs(batch_chars=40)).collect()
    rows = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert (1, [], None) in rows and (2, [], "") in rows and (6, [], "") in rows
    assert rows.count((3, [], "one two three")) == 2
    assert (None, [(0, 18, 2)], "a b") in rows and (5, [(0, 30000, 1)], "word") in rows
    assert (7, [(0, 12, 3)], " x y z\u0085 w") in rows
    assert periodic_runs.collapse(odd.limit(0)).count() == 0
    same = {(r.doc_id, r.text) for r in periodic_runs.with_periods(odd).collect()}
    assert (None, "a b " * 9) in same and (1, None) in same
