"""Quality rules: a learned decision list over text statistics, as Spark conditional expressions.

Native throughout: statistics are built-in functions over the text, learning is
a series of small DataFrame aggregates, and the learned list is a ``CASE WHEN``
column.

Learning is sequential covering.  Every statistic is binned at quantiles of the
labelled rows.  A rule grows one threshold condition at a time, the one with the
most information gain on rows no earlier rule covers; it is pruned from the end
on rows held back from growing; it joins the list if it is precise enough there.
Rules reject; a document that none matches is kept.

Bounds: learning reads at most about ``sample_rows`` labelled rows (a documented
bound, chosen by a hash of the id); every grow or prune step returns at most
2 x statistics x bins counts to the driver.

Defined results: a null or empty text has no words and fails the base rules; no
labels, or labels of one kind, give an empty list (only the base rules hold);
null labels are ignored; a document labelled twice counts as bad if one label
says so.  Repeated documents are judged each on their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, stage

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Statistics that rules may use: name -> expression over the counts.
_share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
STATISTICS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word": lambda: _share("word_chars", "n_words"),
    "symbol_share": lambda: _share("n_symbols", "word_chars"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "distinct_share": lambda: _share("n_distinct", "n_words"),
    "upper_share": lambda: _share("n_upper", "word_chars"),
    "mark_share": lambda: _share("n_marks", "word_chars"),
    "digit_share": lambda: _share("n_digits", "word_chars"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
HELPERS = ["n_lines", "n_distinct", "n_upper", "n_marks", "n_digits"]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the helper counts as long columns; columns named ``_q*`` are dropped.

    ``n_repeat_words`` counts the words in windows of five words found twice or
    more.  Windows are told apart by a 64-bit hash; only texts with a repeated
    window sort theirs (O(n log n), never n squared), so a very long text of
    one repeated word is linear apart from that sort.
    """
    w, g, s, m, p = "_q_words", "_q_grams", "_q_sorted", "_q_twice", "_q_at"
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({
        w: F.array_remove(F.split(text, WHITE), ""),
        "_q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_marks": F.regexp_count(text, F.lit(r"[!?,;:]")).cast("long"),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.concat_ws("", w)).cast("long"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        g: F.when(F.size(w) >= WINDOW, F.transform(
            F.slice(F.col(w), F.lit(1), F.size(w) - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, WINDOW)]))),
    })
    d = d.withColumn(s, F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(
        F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn(m, F.filter(s, lambda e, j: (
        F.coalesce(F.get(F.col(s), j + 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get(F.col(s), F.greatest(j - 1, F.lit(0)))["h"] == e["h"], F.lit(False)) & (j > 0))))
    d = d.withColumn(p, F.array_sort(F.transform(m, lambda e: e["i"])))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(
        F.transform(p, lambda x, k: F.coalesce(F.least(F.get(F.col(p), k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return d.drop(*[c for c in d.columns if c.startswith("_q_")])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = STATISTICS[self.statistic]()
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self):
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """Text of the first rule that matches, null if none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            cond = rule[0].column()
            for c in rule[1:]:
                cond = cond & c.column()
            out = F.when(cond, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


@dataclass(frozen=True)
class Learn:
    sample_rows: int = 20_000
    quantiles: tuple = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96,
                        0.98, 0.99)
    max_rules: int = 8
    max_conditions: int = 3
    min_precision: float = 0.97
    min_rows: int = 10


def learn(docs: DataFrame, labels: DataFrame, how: Learn = Learn(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> DecisionList:
    """A decision list that rejects documents labelled 0, from at most about ``how.sample_rows`` labelled rows."""
    lab = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).dropna()
           .groupBy("_id").agg(F.min("_y").alias("_y")))
    n = lab.count()
    if not n:
        return DecisionList()
    slots = 1 << 20
    most = max(1, min(slots, int(slots * how.sample_rows / n)))
    lab = lab.filter(F.pmod(F.xxhash64("_id"), F.lit(slots)) < most)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the sample has at most about sample_rows rows of two numbers: a bounded broadcast
    rows = with_counts(own.join(F.broadcast(lab), "_id"), "_text")
    names = list(STATISTICS)
    # stored before it is filtered: a filter would be pushed below the counts and compute them again
    rows = stage(rows.select("_id", (F.col("_y") == 0).alias("bad"), base_failed().alias("base"),
                             *[STATISTICS[c]().alias(c) for c in names]), "quality-sample").filter("not base")
    cuts = rows.agg(*[F.percentile_approx(c, list(how.quantiles), 2000).alias(c) for c in names]).first()
    if cuts[0] is None:
        return DecisionList()
    cuts = {c: sorted(set(cuts[c])) for c in names}
    # bin = number of cuts below the value, so "value > cut[k]" is "bin > k"
    binned = stage(rows.select(
        "bad", (F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(3)) == 0).alias("prune"),
        *[F.col(c).alias(f"v_{c}") for c in names],
        *[sum(((F.col(c) > t).cast("int") for t in cuts[c]), F.lit(0)).alias(c) for c in names]), "quality-bins")

    def test(rule) -> Column:
        cond = F.lit(True)
        for name, at, above in rule:
            cond = cond & ((F.col(name) > at) if above else (F.col(name) <= at))
        return cond

    def counts(where: Column) -> dict:
        """{(statistic, bin): [good, bad]}"""
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).alias("b")) for c in names]))
        out: dict = {}
        for r in binned.filter(where).select("bad", each.alias("e")).groupBy("e.s", "e.b", "bad").count().collect():
            out.setdefault((r.s, r.b), [0, 0])[r.bad] += r["count"]
        return out

    def gain(p0, n0, p1, n1):
        return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0

    found: list[list[Condition]] = []
    fresh = F.lit(True)
    while len(found) < how.max_rules:
        rule: list[tuple[str, int, bool]] = []
        while len(rule) < how.max_conditions:
            c = counts(~F.col("prune") & fresh & test(rule))
            p0 = sum(v[1] for (s, _), v in c.items() if s == names[0])
            n0 = sum(v[0] for (s, _), v in c.items() if s == names[0])
            if p0 < how.min_rows or not n0:
                break
            best = (1e-9, None)
            for name in names:
                above = [0, 0]
                for at in range(len(cuts[name]) - 1, -1, -1):
                    got = c.get((name, at + 1), [0, 0])
                    above = [above[0] + got[0], above[1] + got[1]]
                    for up, (nn, pp) in ((True, above), (False, (n0 - above[0], p0 - above[1]))):
                        if pp >= how.min_rows:
                            best = max(best, (gain(p0, n0, pp, nn), (name, at, up)), key=lambda x: (x[0], str(x[1])))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = binned.filter(F.col("prune") & fresh).agg(*[
            F.struct(F.count_if(test(rule[:k]) & F.col("bad")).alias("p"),
                     F.count_if(test(rule[:k]) & ~F.col("bad")).alias("n")).alias(f"k{k}")
            for k in range(1, len(rule) + 1)]).first()
        score = {k: (held[f"k{k}"].p - held[f"k{k}"].n) / max(1, held[f"k{k}"].p + held[f"k{k}"].n)
                 for k in range(1, len(rule) + 1)}
        k = max(score, key=lambda x: (score[x], -x))
        if held[f"k{k}"].p < how.min_rows / 3 or held[f"k{k}"].p < how.min_precision * (held[f"k{k}"].p + held[f"k{k}"].n):
            break
        rule = rule[:k]
        # each threshold moves half way from its cut to the nearest bad row that the rule covers
        near = binned.filter(fresh & test(rule) & F.col("bad")).agg(*[
            (F.min(f"v_{s}") if up else F.max(f"v_{s}")).alias(f"k{i}") for i, (s, _, up) in enumerate(rule)]).first()
        found.append([Condition(s, up, (cuts[s][at] + near[i]) / 2) for i, (s, at, up) in enumerate(rule)])
        fresh = fresh & ~test(rule)
    return DecisionList(found)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``rule`` (the rejecting rule, null if none) and ``kept``.

    Columns of ``docs`` with those names are replaced.
    """
    d = with_counts(docs, text_col).withColumn("base_failed", base_failed())
    d = d.withColumn("rule", F.when(~F.col("base_failed"), rules.verdict()))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents kept, with the columns of ``docs``."""
    # the document rides along as a struct, so a column of its own may share a name with a count; the row number bars
    # the optimizer from pushing the filter below the counts, where it would compute them anew
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text"))
    judged = judge(rows, rules, "_text").withColumn("_row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_row") >= 0)).select("_doc.*")
