"""Line dedup by a log-template tree, native.

Each line is parsed down a tree of fixed depth: token count, then its leading ``depth``
tokens, where a token with a digit is a variable field (``<*>``).  In a leaf, lines are
compared token by token.  Candidates are lines that agree on one of ``parts`` stretches
of their tokens in ``min_docs`` documents or more; the commonest token at each place of
such a group is its template, and a line belongs to it if at least ``agree`` of its
tokens are the template's (where they differ is a variable field).  A template whose
lines stand in ``min_docs`` documents or more is boilerplate, and its lines are dropped
from all documents, as are lines that stand in so many documents token for token.
Grouping, not a scan in line order: the result does not hang on the order of lines.
Lines that vary in every one of their ``parts`` stretches are not found.

Lines below ``min_tokens`` tokens have a leaf of their own, by all their tokens, and are
dropped when ``short_docs`` documents or more hold the same.  A line whose tokens are all
variable fields is taken with its tokens as they are, so tables of numbers stay.

Scale.  A line is ``parts + 1`` narrow rows; documents are counted by a distinct count
that spreads a hot template over its documents; tokens are counted by place with a
map-side step; joins back are between stored tables, so adaptive execution splits a hot
template.  Texts move twice, by document id: to take out the candidates' tokens, and to
be cleaned.  No Python runs.

Defined results: a null text stays null and counts no lines; lines without a
token are never dropped; repeated rows with one id count as one
document and are cleaned alike; a null id counts as no document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, spare, stage

FIELD = "<*>"


@dataclass(frozen=True)
class Tree:
    depth: int = 1
    parts: int = 4
    agree: float = 0.75
    min_tokens: int = 6
    min_docs: int = 10
    short_docs: int = 10


SHORT, WHOLE = -2, -1  # key of a short line, and of all tokens of a longer one; 0 and up: of a stretch


def tokens_of(line: Column) -> Column:
    """The line's tokens, variable fields masked unless every token is one."""
    some = line.rlike("[0-9]") & line.rlike(r"(?<!\S)[^\s0-9]+(?!\S)")
    masked = F.when(some, F.regexp_replace(line, r"(?<!\S)(?=\S*[0-9])\S+", FIELD)).otherwise(line)
    return F.array_remove(F.split(masked, WHITE), "")


def keys_of(tokens: str, how: Tree) -> Column:
    """Array of (part, key): the line's place in the tree with all its tokens, and with each stretch of them."""
    t, n = F.col(tokens), F.size(tokens)
    key = lambda part, *what: F.struct(F.lit(part).alias("part"), F.xxhash64(n, F.lit(part), *what).alias("key"))
    cut = lambda p: F.floor(n * p / how.parts).cast("int")
    stretches = [key(p, F.slice(t, 1, how.depth), F.slice(t, cut(p) + 1, cut(p + 1) - cut(p))) for p in range(how.parts)]
    none = F.array(F.struct(F.lit(SHORT).alias("part"), F.lit(None).cast("long").alias("key")))
    return F.when(n >= max(how.min_tokens, how.parts), F.array(key(WHOLE, t), *stretches)).when(n > 0, F.array(key(SHORT, t))).otherwise(none)


def marked_lines(docs: DataFrame, how: Tree, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, exact, keys) of each line, stored: whether its tokens recur, and the stretches of it that do."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    lines = src.select("doc_id", "line_no", tokens_of(F.col("line")).alias("tokens"))
    lines = stage(lines.select("doc_id", "line_no", F.inline(keys_of("tokens", how))), "template-lines")
    found = lines.filter("key is not null").groupBy("key", "part").agg(F.countDistinct("doc_id").alias("n"))
    least = F.when(F.col("part") == SHORT, how.short_docs).otherwise(how.min_docs)
    found = stage(found.filter(F.col("n") >= least).select(F.col("key").alias("_key")), "template-keys")
    hit = F.col("_key").isNotNull()
    marked = lines.join(found, F.col("key") == F.col("_key"), "left").groupBy("doc_id", "line_no").agg(
        F.max(hit & (F.col("part") < 0)).alias("exact"), F.collect_set(F.when(F.col("part") >= 0, F.col("_key"))).alias("keys"))
    return stage(marked, "template-marks")


def by_document(lines: DataFrame, doc: str, name: str, *cols: str) -> DataFrame:
    """(doc, array of ``cols`` in line order) of lines that are all there from 0 up."""
    return lines.groupBy(F.col("doc_id").alias(doc)).agg(F.array_sort(F.collect_list(F.struct("line_no", *cols))).alias(name))


def verified(docs: DataFrame, marked: DataFrame, how: Tree, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((key, doc_id, line_no, tokens) of the candidates that agree with a recurring template, (key, words, n_docs))."""
    some = by_document(marked, "_doc", "_lines", "keys").filter(F.exists("_lines", lambda x: F.size(x["keys"]) > 0))
    some = stage(some, "template-candidates")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.alias("line_no"), x.alias("line"), F.get(F.col("_lines"), i)["keys"].alias("keys")))
    src = src.join(some.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")))
    src = src.select("doc_id", F.inline(F.filter(line, lambda x: F.size(x["keys"]) > 0)))
    src = src.select("doc_id", "line_no", "keys", tokens_of(F.col("line")).alias("tokens"))
    own = F.transform(keys_of("tokens", how), lambda x: x["key"])  # rows of one id may differ in text
    src = stage(src.select("doc_id", "line_no", "tokens", F.array_intersect("keys", own).alias("keys")), "template-tokens")
    each = src.select("doc_id", "line_no", "tokens", F.explode("keys").alias("key"))
    count = each.select("key", F.posexplode("tokens").alias("at", "token")).groupBy("key", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    top = count.groupBy("key", "at").agg(F.max(F.struct("n", "token")).alias("top"))
    words = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.col("top.token").alias("w")))).alias("t"))
    words = stage(words.select(F.col("key").alias("_key"), F.col("t.w").alias("words")), "template-words")
    same = F.aggregate(F.zip_with("tokens", "words", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    fits = each.join(words, F.col("key") == F.col("_key")).filter(same >= F.lit(how.agree) * F.size("words"))
    fits = stage(fits.select("key", "doc_id", "line_no", "tokens"), "template-fits")
    kept = fits.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs")).filter(F.col("n_docs") >= how.min_docs)
    kept = stage(kept.select(F.col("key").alias("_key"), "n_docs"), "templates")
    return fits.join(kept, F.col("key") == F.col("_key")).drop("_key"), kept


def templates(docs: DataFrame, how: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(template, n_docs): the text of each recurring template, fields that differ shown as ``<*>``; several groups
    may show one template, each with its own count of documents."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    lines = lines.select("doc_id", tokens_of(F.col("line")).alias("tokens"))
    exact = lines.select("doc_id", "tokens", F.get(keys_of("tokens", how), F.lit(0)).alias("k")).filter("k.key is not null")
    exact = exact.groupBy("k.key", "k.part").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("tokens").alias("tokens"))
    exact = exact.filter(F.col("n_docs") >= F.when(F.col("part") == SHORT, how.short_docs).otherwise(how.min_docs))
    fits, _ = verified(docs, marked_lines(docs, how, id_col, text_col), how, id_col, text_col)
    token = (fits.select("key", "n_docs", F.posexplode("tokens").alias("at", "token"))
             .groupBy("key", "n_docs", "at").agg(F.min("token").alias("a"), F.max("token").alias("b")))
    word = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(FIELD))
    return (token.groupBy("key", "n_docs").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("w")))).alias("t"))
            .select(F.array_join(F.col("t.w"), " ").alias("template"), "n_docs")
            .unionByName(exact.select(F.array_join("tokens", " ").alias("template"), "n_docs")).distinct())


def drop_templates(docs: DataFrame, how: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of recurring templates, with ``n_lines`` and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")  # columns of these names give way
    marked = marked_lines(docs, how, id_col, text_col)
    fits, _ = verified(docs, marked, how, id_col, text_col)
    lines = marked.select("doc_id", "line_no", "exact").unionByName(fits.select("doc_id", "line_no", F.lit(True).alias("exact")))
    lines = lines.groupBy("doc_id", "line_no").agg(F.max("exact").alias("hit"))
    doc, hit = spare(docs, "_doc", "_hit")
    flags = by_document(lines, doc, "flags", "hit")
    flags = stage(flags.select(doc, F.transform("flags", lambda x: x["hit"]).alias(hit))
                  .filter(F.array_contains(hit, True)), "template-flags")
    out = docs.join(flags.hint("merge"), F.col(id_col).eqNullSafe(F.col(doc)), "left")
    split = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.coalesce(F.get(F.col(hit), i), F.lit(False))), "\n")
    gone = F.coalesce(F.size(F.filter(hit, lambda x: x)), F.lit(0))
    return out.select(
        *[F.when(F.col(hit).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c)
          for c in docs.columns],
        F.coalesce(F.size(split), F.lit(0)).cast("int").alias("n_lines"), gone.cast("int").alias("n_dropped"))
