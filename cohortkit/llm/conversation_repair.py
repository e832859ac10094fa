"""Conversation repair by iterative-deepening A*.

A conversation is repaired when its role initials read ``(s?(ua)+)?``.  Edits, by their
initial: Keep a row (no cost), Rerole it to user or assistant (2), Delete it (3; blank
and duplicate rows have to go), Insert an empty user or assistant row anywhere (2).  A
truncated row that stays costs 1.  The cheapest edits are wanted, and of equals those
whose initials come first in ASCII order.

Method.  Depth-first search tries the edits of a state (row, last role) in ASCII order
under a bound on cost so far plus a lower bound of the rest: 3 a row that has to go, 1
a truncated one, 2 an edit needed to mend the illegal neighbours, of which one edit
mends two at most.  A state that fails under what is left of the bound enters a
transposition table with the least that any continuation needs; it is not searched
again until the bound allows that.  The least bound that failed by is the next one.
The first accepting path under the first bound that has one is the answer: all paths
under that bound that accept cost the same, and the search met the ASCII-least first.

Long conversations.  A search takes ``chunk`` rows at most.  A conversation of more is
cut; chunks know of each other by four numbers, the least cost from each of the four
possible last roles to the end, folded from the last chunk to the first.  An insert
belongs to the row after it, so a chunk's edits are no beginning of another choice for
the same chunk, and the ASCII-least edits of the chunks in turn are the ASCII-least of
all.  Searches of the chunks run apart, wherever their rows lie.

Scale.  Texts move once, to their conversation, in order.  All else works on narrow
rows (ids, turn, role, MD5 of role and text, two flags), counted when equal; they are
sorted by range, so one conversation with a third of all rows spreads over tasks.  Per
conversation a task streams its chunks (rows / ``chunk``) and writes its edits; nothing
holds a conversation in memory.

Defined results: rows go by turn (nulls first), then role, then the MD5 of role and
text; equal rows are neighbours.  Null roles and texts read as one blank.  Null
conversation ids are one conversation.  Roles count by their first character alone, an
empty one is illegal beside any.  Blank is no character but ASCII white space,
duplicate a role and text met in an earlier row, truncated a last character other than
``.!?`` (white space aside); a row has the first of these faults.  An empty table has
no conversations.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage

BLANKS = " \t\n\x0b\x0c\r"
LETTERS = {"s": 1, "u": 2, "a": 3}  # also the state after a kept row of that letter; 0: none yet
FINE, TRUNCATED, GONE = 0, 1, 2
ROLES = {2: "user", 3: "assistant"}
FOLLOWS = (2, 2, 3, 2)  # the role that an insert or rerole puts after each state
KEPT = ((0, 1, 2, 0), (0, 0, 2, 0), (0, 0, 0, 3), (0, 0, 2, 0))  # state after keeping a letter; 0: not allowed
REROLE, INSERT, DELETE = 2, 2, 3
NEVER = 1 << 40


@dataclass(frozen=True)
class Repair:
    chunk: int = 64


# -- the search ------------------------------------------------------------------

class Search:
    """Cheapest edits of rows, given as letter + 4 * fault.

    ``finish`` gives the cost of the rest from each state behind the last row; without
    it the conversation ends there and the last state has to accept.
    """

    def __init__(self, rows: bytes, finish: tuple | None = None):
        self.rows, self.finish, self.path = rows, finish, []
        n = len(rows)
        end = finish or (0, 2 * INSERT, INSERT, 0)
        low = [0] * (4 * n + 4)
        low[4 * n:] = end
        least = min(end[2:])
        rest = 0  # for rows that have to go, and truncated ones
        after = None  # (letter of the next row that may stay, edits for the junctions behind it, ... one further)
        for i in range(n - 1, -1, -1):
            letter, fault = rows[i] & 3, rows[i] >> 2
            rest += DELETE if fault == GONE else fault
            if fault != GONE:
                if after is None:
                    after = (letter, 0 if letter > 1 and end[letter] - least < 2 else 1, 0)
                else:
                    bad = not letter or KEPT[letter][after[0]] == 0
                    after = (letter, 1 + after[2] if bad else after[1], after[1])
            for st in range(4):
                if after is None:
                    cost = rest + min(end[st], INSERT + least)
                else:
                    cost = rest + least + 2 * (after[1] if KEPT[st][after[0]] else 1 + after[2])
                # without a u or a, all rows go, but for an s that opens
                if st == 0:
                    cost = min(cost, DELETE * (n - i) + end[0])
                if st < 2:
                    cost = min(cost, DELETE * (n - i - (st == 0)) + end[1])
                low[4 * i + st] = cost
        self.low = low

    def solve(self, start: int = 0) -> tuple[int, str, int]:
        """(cost, edits, last state) of the cheapest, then ASCII-least edits."""
        bound = self.low[start]
        while not self._dive(0, start, bound):
            bound = self.low[start]
        edits = "".join(reversed(self.path))
        self.path = []
        state, i = start, 0
        for e in edits:
            state = step(state, e, self.rows[i] & 3 if e != "I" else 0)
            i += e != "I"
        return bound, edits, state

    def _dive(self, i: int, st: int, left: int) -> bool:
        low, key = self.low, 4 * i + st
        if low[key] > left:
            return False
        if i == len(self.rows):
            if self.finish or st in (0, 3):
                return True
            if self._dive(i, FOLLOWS[st], left - INSERT):
                self.path.append("I")
                return True
            low[key] = max(low[key], INSERT + low[4 * i + FOLLOWS[st]])
            return False
        letter, fault = self.rows[i] & 3, self.rows[i] >> 2
        moves = [("D", DELETE, i + 1, st), ("I", INSERT, i, FOLLOWS[st])]
        if fault != GONE:
            if KEPT[st][letter]:
                moves.append(("K", fault, i + 1, KEPT[st][letter]))
            moves.append(("R", REROLE + fault, i + 1, FOLLOWS[st]))
        for edit, cost, j, to in moves:
            if self._dive(j, to, left - cost):
                self.path.append(edit)
                return True
        low[key] = max(low[key], min(cost + low[4 * j + to] for _, cost, j, to in moves))
        return False


def step(state: int, edit: str, letter: int) -> int:
    """The state after an edit."""
    if edit == "D":
        return state
    return KEPT[state][letter] if edit == "K" else FOLLOWS[state]


def costs_between(rows: bytes) -> list[int]:
    """Least cost from each state before the rows to each state behind them (16 numbers, by rows)."""
    opens = any(r & 3 == 1 and r >> 2 != GONE for r in rows)
    out = []
    for s in range(4):
        for t in range(4):
            possible = t >= 2 or s == t or (s == 0 and t == 1 and opens)
            only = tuple(0 if x == t else NEVER for x in range(4))
            out.append(Search(rows, only).solve(s)[0] if possible else NEVER)
    return out


# -- rows ---------------------------------------------------------------------------

def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, digest) with null roles and texts as one blank."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    known = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.md5(F.encode(known, "UTF-8"))))


def _narrow(rows: DataFrame) -> DataFrame:
    """Equal rows counted, with their faults: blank, cut (truncated), late (role and text met in an earlier turn)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    flags = rows.select("conv", "turn", "role", "digest", (bare == "").alias("blank"),
                        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    count = stage(flags.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n")),
                  "conversation-rows")
    when = F.struct(F.col("turn").isNotNull().alias("timed"), F.col("turn").alias("turn"))
    again = count.filter(~F.col("blank")).groupBy(F.col("conv").alias("a_conv"), F.col("digest").alias("a_digest")).agg(
        F.min(when).alias("first"), F.max(when).alias("last"))
    again = stage(again.filter(F.col("first") != F.col("last")), "conversation-repeats")
    same = F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("digest") == F.col("a_digest"))
    late = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return count.join(again.hint("merge"), same, "left").select(*count.columns, late.alias("late"))


def _chunks(narrow: DataFrame, how: Repair) -> DataFrame:
    """Runs of at most ``chunk`` rows of one conversation in order: their codes, faults and first row's key."""
    kind = dict(narrow.dtypes)
    order = ("conv", "turn", "role", "digest")
    src = (narrow.select(*order, "n", "blank", "cut", "late")
           .repartitionByRange(shuffle_partitions(narrow.sparkSession), *order).sortWithinPartitions(*order)
           .select("*", F.spark_partition_id().alias("part")))

    def run(batches):
        held, seq, number = None, 0, 0
        out = []
        for batch in batches:
            for conv, turn, role, digest, n, blank, cut, late, part in zip(*(c.to_pylist() for c in batch.columns)):
                letter = LETTERS.get(role[:1], 0)
                for k in range(n):
                    if held is None or held["conv"] != conv or len(held["codes"]) == how.chunk:
                        if held is not None:
                            out.append(held)
                        number += 1
                        held = {"conv": conv, "part": part, "seq": number, "turn": turn, "role": role, "digest": digest,
                                "codes": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                    fault = FINE
                    if blank:
                        held["blank"] += 1
                        fault = GONE
                    elif late or k:
                        held["duplicate"] += 1
                        fault = GONE
                    elif cut:
                        held["truncated"] += 1
                        fault = TRUNCATED
                    if held["codes"]:
                        held["illegal"] += not legal(held["codes"][-1] & 3, letter)
                    held["codes"].append(letter + 4 * fault)
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if held is not None:
            out.append(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv", src_type(src, "conv")), ("part", pa.int32()), ("seq", pa.int64()),
                        ("turn", src_type(src, "turn")), ("role", pa.string()), ("digest", pa.binary()),
                        ("codes", pa.binary()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                        ("truncated", pa.int64()), ("illegal", pa.int64())])
    found = stage(src.mapInArrow(run, f"conv {kind['conv']}, part int, seq long, turn {kind['turn']}, role string, "
                                      "digest binary, codes binary, blank long, duplicate long, truncated long, illegal long"),
                  "conversation-chunks")
    # windows over chunks, a row for 64 rows; neither keeps more than a row
    each = Window.partitionBy("conv").orderBy("part", "seq")
    letter = lambda at: F.conv(F.hex(F.substring("codes", at, 1)), 16, 10).cast("int") % 4
    before = F.lag(letter(-1)).over(each)
    joint = before.isNotNull() & ~F.struct(before, letter(1)).isin(F.struct(F.lit(1), F.lit(2)), F.struct(F.lit(2), F.lit(3)),
                                                                   F.struct(F.lit(3), F.lit(2)))
    found = found.select("*", F.row_number().over(each).alias("chunk"), F.lead("part").over(each).isNull().alias("last"),
                         joint.cast("long").alias("joint"))
    return stage(found.withColumn("illegal", F.col("illegal") + F.col("joint")).drop("part", "seq", "joint"),
                 "conversation-chunks")


def legal(before: int, here: int) -> bool:
    return (before, here) in ((1, 2), (2, 3), (3, 2))


def src_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def _per_chunk(chunks: DataFrame, fn, fields: dict, order: tuple | None = None) -> DataFrame:
    """``fn(rows)`` over (conv, chunk, last, codes, ...) dictionaries; ``order``: the rows of a conversation
    stream through one task in that order, else chunks go anywhere."""
    n = shuffle_partitions(chunks.sparkSession)
    src = chunks.repartition(n, "conv").sortWithinPartitions("conv", *order) if order else chunks.repartition(n, "conv", "chunk")
    kind = dict(src.dtypes)["conv"]
    schema = pa.schema([("conv", src_type(src, "conv")), ("chunk", pa.int32()), *[(k, v[1]) for k, v in fields.items()]])

    def run(batches):
        for batch in batches:
            out = list(fn(batch.to_pylist()))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return src.mapInArrow(run, f"conv {kind}, chunk int, " + ", ".join(f"{k} {v[0]}" for k, v in fields.items()))


def _solved(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, state, edits, cost): the edits of each chunk, the state before them, and on the first chunk
    of a conversation the cost of the whole."""
    longs, codes = ("array<bigint>", pa.list_(pa.int64())), ("binary", pa.binary())
    flag = ("boolean", pa.bool_())

    def between(rows):
        for r in rows:
            long = r["chunk"] > 1 or not r["last"]
            if long and r["last"]:
                cost = [Search(r["codes"]).solve(s)[0] for s in range(4)]
            else:
                cost = costs_between(r["codes"]) if long else None
            yield {"conv": r["conv"], "chunk": r["chunk"], "last": r["last"], "codes": r["codes"], "between": cost}

    def behind():
        known = [None]

        def fold(rows):
            for r in rows:  # the last chunk of a conversation comes first
                c, rest = r["between"], None if r["last"] else known[0]
                yield {"conv": r["conv"], "chunk": r["chunk"], "codes": r["codes"], "finish": rest}
                known[0] = c if r["last"] else [min(c[4 * s + t] + rest[t] for t in range(4)) for s in range(4)]
        return fold

    def edits(rows):
        for r in rows:
            finish = tuple(r["finish"]) if r["finish"] else None
            found = [Search(r["codes"], finish).solve(s) for s in (range(4) if r["chunk"] > 1 else (0,))]
            yield {"conv": r["conv"], "chunk": r["chunk"], "costs": [f[0] for f in found],
                   "audits": [f[1] for f in found], "ends": [f[2] for f in found]}

    def chosen():
        state = [0]

        def walk(rows):
            for r in rows:
                s = state[0] if r["chunk"] > 1 else 0
                yield {"conv": r["conv"], "chunk": r["chunk"], "state": s, "edits": r["audits"][s],
                       "cost": 0 if r["chunk"] > 1 else r["costs"][0]}
                state[0] = r["ends"][s]
        return walk

    a = _per_chunk(chunks.select("conv", "chunk", "last", "codes"), between, {"last": flag, "codes": codes, "between": longs})
    b = _per_chunk(a, _fresh(behind), {"codes": codes, "finish": longs}, order=(F.desc("chunk"),))
    c = _per_chunk(b, edits, {"costs": longs, "audits": ("array<string>", pa.list_(pa.string())), "ends": longs})
    return stage(_per_chunk(c, _fresh(chosen), {"state": ("int", pa.int32()), "edits": ("string", pa.string()),
                                                "cost": ("long", pa.int64())}, order=("chunk",)), "conversation-edits")


class _fresh:
    """A function with a state of its own in each task (made when the task first calls it)."""

    def __init__(self, make):
        self.make, self.fn = make, None

    def __call__(self, rows):
        self.fn = self.fn or self.make()
        return self.fn(rows)

    def __reduce__(self):
        return (_fresh, (self.make,))


def repair(rows: DataFrame, how: Repair = Repair(), conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, edits).

    ``report``: a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    ``edits``: a row an edit, each conversation's in one partition, together and in order: conv_id, edit (K, R, D
    or I), and the role and text of the repaired row (null for D).
    """
    full = _prepared(rows, conv_col, turn_col, role_col, text_col)
    narrow = _narrow(full)
    chunks = _chunks(narrow, how)
    solved = _solved(chunks)
    turns = narrow.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    counts = ("blank", "duplicate", "truncated", "illegal")
    parts = [turns.select("conv", "gaps", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(0).cast("long").alias("cost")),
             chunks.select("conv", F.lit(0).cast("long").alias("gaps"), *counts, F.lit(0).cast("long").alias("cost")),
             solved.select("conv", F.lit(0).cast("long").alias("gaps"), *[F.lit(0).cast("long").alias(c) for c in counts], "cost")]
    report = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.sum(c).alias(c) for c in ("gaps", *counts, "cost")])
    return report, _applied(full, chunks, solved)


def _applied(full: DataFrame, chunks: DataFrame, solved: DataFrame) -> DataFrame:
    """The edits on the rows: texts and their chunks' edits meet in one sorted stream."""
    s = solved.select(F.col("conv").alias("s_conv"), F.col("chunk").alias("s_chunk"), "state", "edits")
    heads = chunks.join(s.hint("merge"), F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("chunk") == F.col("s_chunk")))
    heads = heads.select("conv", "turn", "role", "digest", F.lit(0).alias("row"), "chunk", "state", "edits",
                         F.lit(None).cast("string").alias("text"))
    texts = full.select("conv", "turn", "role", "digest", F.lit(1).alias("row"), F.lit(0).alias("chunk"),
                        F.lit(0).alias("state"), F.lit(None).cast("string").alias("edits"), "text")
    both = heads.unionByName(texts).repartition(shuffle_partitions(full.sparkSession), "conv").sortWithinPartitions(
        "conv", "turn", "role", "digest", "row", "chunk").select("conv", "role", "row", "state", "edits", "text")
    schema = pa.schema([("conv_id", src_type(both, "conv")), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        waiting, edits, at, state, out, size = [], "", 0, 0, [], 0
        for batch in batches:
            for conv, role, row, first, todo, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not row:  # edits of a chunk; those of equal first rows come before the rows
                    waiting.append((first, todo))
                    continue
                if at == len(edits):
                    (state, edits), at = waiting.pop(0), 0
                while True:
                    e = edits[at]
                    at += 1
                    state = step(state, e, LETTERS.get(role[:1], 0))
                    if e == "I":
                        out.append((conv, e, ROLES[state], ""))
                    else:
                        out.append((conv, e, *((None, None) if e == "D" else (role if e == "K" else ROLES[state], text))))
                        size += len(text)
                        break
                # inserts behind the last row of the conversation
                if at < len(edits) and not edits[at:].strip("I"):
                    for e in edits[at:]:
                        state = step(state, e, 0)
                        out.append((conv, e, ROLES[state], ""))
                    at = len(edits)
                if len(out) >= 5000 or size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return both.mapInArrow(run, f"conv_id {dict(both.dtypes)['conv']}, edit string, role string, text string")


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of edits as ``repair`` returns them: the initials of the edits, and the
    SHA-256 of the repaired ``role:text`` rows joined by line breaks.  Holds a hash and the initials, not the texts."""
    schema = pa.schema([("conv_id", src_type(edits, "conv_id")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        now, letters, sha, some = None, [], None, False
        out = []
        for batch in batches:
            for conv, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if sha is None or conv != now:
                    if sha is not None:
                        out.append((now, "".join(letters), sha.hexdigest()))
                    now, letters, sha, some = conv, [], hashlib.sha256(), False
                letters.append(edit)
                if edit != "D":
                    sha.update((("\n" if some else "") + role + ":" + text).encode("utf-8"))
                    some = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, "".join(letters), sha.hexdigest()),
                                                                               schema.types)], schema=schema)

    return (edits.select("conv_id", "edit", "role", "text")
            .mapInArrow(run, f"conv_id {dict(edits.dtypes)['conv_id']}, audit string, repaired_sha256 string"))


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with known faults, by the CRC of ``conv_id:turn`` (nulls read as one blank): rows
    dropped, emptied, without their sentence ends, repeated, or all set to the role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    src = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times: Column = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    src = src.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                     text.alias("text"), times.alias("times"))
    return (src.filter("times > 0").select("*", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy"))
            .select("conv_id", "turn", "role", "text"))


def audit(original: DataFrame, damaged: DataFrame, how: Repair = Repair()) -> DataFrame:
    """A row for each conversation of ``original``: the report and digests of the damaged one's repair; one
    without rows has zeros, no edits and the hash of nothing."""
    report, edits = repair(damaged, how)
    numbers = [c for c in report.columns if c != "conv_id"]
    zero = [F.lit(0).cast("long").alias(c) for c in numbers]
    text = [F.lit(None).cast("string").alias(c) for c in ("audit", "repaired_sha256")]
    rows = (original.select("conv_id").distinct().select("conv_id", *zero, *text)
            .unionByName(report.select("conv_id", *numbers, *text))
            .unionByName(digests(edits).select("conv_id", *zero, "audit", "repaired_sha256")))
    return rows.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
