"""Mixing to target weights: iterative proportional fitting, then calibrated sampling.

Native throughout.  Token counts are summed by (source, language, topic) cell.
The cell weights are raked: scaled to the source targets, then the language
targets, then the topic targets, over and over, until all three marginals hold.
A document's inclusion probability is its cell's raked weight over its tokens'
share, scaled to a kept share of all tokens, and it stays if a hash of its id
falls below.  Expected token shares among the kept are then the targets.

The kept share is as large as the raked cells allow, where cells with the largest
ratios that hold at most ``at_bound`` of the raked weight together do not set the
scale, and never below ``min_kept``.  No probability exceeds 1: a category whose
target asks for more tokens than it has keeps all of them and the others of its
dimension take up the rest, a cell at the bound keeps everything, and the other
cells are raked again.  So one rare category cannot thin out the whole corpus.

Targets: a share for named categories (``Mix.targets``), the rest of the mass by
``share ** temperature`` of the corpus's own shares (1 keeps them, 0 is flat).

Scale.  One aggregate over the documents (with a map-side step, so a source with
a third of all rows is one row a task) gives the cells.  Every category is a stratum
of its own, however many there are.  A cell table of up to ``one_task_cells`` rows is
raked in one task, with no exchange between sweeps; a larger one stays distributed: a
marginal is an aggregate with a map-side step, joined back to the stored cells, so a
language that all sources share is split over tasks.  Both ways compute the same.

Defined results: a null category is a category of its own; a null or empty text
has no tokens and no weight to calibrate, and takes its cell's probability; an
empty table gives an empty one; rows with the same id share their draw.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, spare, stage

DIMS = ("source", "lang", "topic")


def default_topic(text: str = "text") -> Column:
    """A form of text read off its marks: license, list, table, contact or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.when(t.rlike(r"(?i)licen[sc]e|all rights reserved"), "license")
            .when(t.rlike(r"https?://|[\w.]+@[\w.]+"), "contact")
            .when(t.contains(" | "), "table")
            .when(t.rlike(r"\d{4}"), "figures")
            .otherwise("prose"))


@dataclass(frozen=True)
class Mix:
    temperature: dict = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 1.0})
    targets: dict = field(default_factory=dict)  # {dim: {category: share}}
    one_task_cells: int = 100_000
    sweeps: int = 12
    min_kept: float = 0.4  # share of all tokens
    at_bound: float = 0.02  # share of the raked weight
    seed: str = "mix-1"


def tokens(text: str = "text") -> Column:
    """Words of the text."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def strata(docs: DataFrame, topic: Column | None = None, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of each document; nulls are the category ``(none)``."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.select("doc_id", none("source").alias("source"), none("lang").alias("lang"),
                       (default_topic(text) if topic is None else topic).alias("topic"), tokens(text).alias("tokens"))


class Sums:
    """Sums over the cells as a column, by windows in one task or by aggregates over many."""

    def __init__(self, one_task: bool):
        self.one_task = one_task

    def gather(self, cells: DataFrame) -> DataFrame:
        return cells.coalesce(1) if self.one_task else cells

    def by(self, c: DataFrame, dim: str, value, name: str) -> DataFrame:
        """``c`` with the sum of ``value`` over the cells of the same category."""
        if self.one_task:
            return c.withColumn(name, F.sum(value).over(Window.partitionBy(dim)))
        c = stage(c.drop(name), "mix-cells")
        total = c.groupBy(F.col(dim).alias("_key")).agg(F.sum(value).alias(name))
        return c.join(total, F.col(dim) == F.col("_key")).drop("_key")

    def all(self, c: DataFrame, value) -> Column:
        """The sum of ``value`` over all cells."""
        if self.one_task:
            return F.sum(value).over(Window.partitionBy())
        return F.lit(c.agg(F.sum(value)).first()[0]).cast("double")

    def bound(self, c: DataFrame, share: float) -> Column:
        """The largest ratio ``_r`` where the cells at it and above hold more than ``share`` of the weight;
        the largest of all if there is none."""
        if self.one_task:
            above = F.sum("weight").over(Window.partitionBy().orderBy(F.col("_r").desc()))
            top = F.when(F.col("_above") > share, F.col("_r"))
            c = c.withColumn("_above", above).withColumn("_top", top).agg(F.max("_top").alias("t"), F.max("_r").alias("r"))
        else:  # running sums inside range partitions, after those of the partitions before (a row each)
            parts = shuffle_partitions(c.sparkSession)
            ratio = c.groupBy("_r").agg(F.sum("weight").alias("w")).repartitionByRange(parts, F.desc("_r"))
            ratio = stage(ratio.select("_r", "w", F.spark_partition_id().alias("p")), "mix-ratios")
            whole = ratio.groupBy(F.col("p").alias("q")).agg(F.sum("w").alias("m"))
            whole = whole.select("q", (F.sum("m").over(Window.orderBy("q")) - F.col("m")).alias("before"))
            above = F.col("before") + F.sum("w").over(Window.partitionBy("p").orderBy(F.desc("_r")))
            c = ratio.join(F.broadcast(whole), F.col("p") == F.col("q")).withColumn("_above", above)
            c = c.agg(F.max(F.when(F.col("_above") > share, F.col("_r"))).alias("t"), F.max("_r").alias("r"))
        got = c.first()
        return F.lit(got.r if got.t is None else got.t).cast("double")


def rake(cells: DataFrame, how: Mix) -> DataFrame:
    """``cells`` (source, lang, topic, tokens > 0; stored) with raked ``weight`` (sums to 1) and inclusion ``prob``."""
    sums = Sums(cells.count() <= how.one_task_cells)
    c = sums.gather(cells)
    c = c.withColumn("weight", F.col("tokens") / sums.all(c, "tokens"))
    for d in DIMS:
        c = sums.by(c, d, "weight", "_m")
        named = how.targets.get(d, {})
        lookup = F.coalesce(*[F.when(F.col(d) == k, F.lit(float(v))) for k, v in named.items()], F.lit(None).cast("double"))
        c = c.withColumn("_named", lookup)
        # each category counts once: its cells share its mass in proportion to their own weight
        flat = F.when(F.col("_named").isNull(), F.pow("_m", F.lit(how.temperature.get(d, 1.0))))
        c = c.withColumn("_flat", flat)
        part = F.col("weight") / F.col("_m")
        all_flat = sums.all(c, F.col("_flat") * part)
        all_named = F.coalesce(sums.all(c, F.col("_named") * part), F.lit(0.0))
        c = c.withColumn(f"_t_{d}", F.when(F.col("_named").isNull(), F.col("_flat") / all_flat
                                           * F.greatest(F.lit(0.0), 1 - all_named)).otherwise(F.col("_named")))
        c = c.drop("_m", "_named", "_flat")
    for _ in range(how.sweeps):
        for d in DIMS:
            c = sums.by(c, d, "weight", "_m")
            c = c.withColumn("weight", F.col("weight") * F.col(f"_t_{d}") / F.col("_m")).drop("_m")
    return bounded(stage(c, "mix-unbounded"), how, sums).select(*DIMS, "tokens", "weight", "prob")


def bounded(c: DataFrame, how: Mix, sums: Sums) -> DataFrame:
    """Raked cells with the targets ``_t_<dim>``, raked again so that no ``prob`` exceeds 1 at the kept share."""
    c = sums.gather(c).withColumn("_r", F.col("weight") / F.col("tokens"))
    scale = sums.bound(c, how.at_bound)
    c = c.withColumn("_all", sums.all(c, "tokens")).withColumn(
        "_kept", F.least(F.lit(1.0), F.greatest(F.lit(how.min_kept), 1 / (scale * F.col("_all")))))
    c = c.withColumn("_cap", F.col("tokens") / (F.col("_all") * F.col("_kept")))
    for d in DIMS:
        c = sums.by(c, d, "_cap", "_has").withColumn("_part", F.col("_cap") / F.col("_has"))
        for _ in range(4):  # what a category lacks goes to those that have more
            c = c.withColumn(f"_t_{d}", F.least(f"_t_{d}", "_has"))
            free = F.when(F.col(f"_t_{d}") < F.col("_has"), F.col(f"_t_{d}")).otherwise(F.lit(0.0))
            c = c.withColumn("_free", free)
            lack = 1 - sums.all(c, F.col(f"_t_{d}") * F.col("_part"))
            grow = lack / sums.all(c, F.col("_free") * F.col("_part"))
            c = c.withColumn("_grow", F.when(F.col("_free") > 0, grow).otherwise(F.lit(0.0)))
            c = c.withColumn(f"_t_{d}", F.col(f"_t_{d}") + F.col("_free") * F.col("_grow"))
        c = c.drop("_has", "_part", "_free", "_grow")
    c = sums.gather(stage(c, "mix-bounds"))
    c = c.withColumn("weight", F.least("weight", "_cap"))
    for _ in range(how.sweeps):
        for d in DIMS:
            c = sums.by(c, d, "weight", "_m")
            c = c.withColumn("weight", F.least("_cap", F.col("weight") * F.col(f"_t_{d}") / F.col("_m"))).drop("_m")
    for _ in range(4):  # the kept share itself
        c = c.withColumn("weight", F.least("_cap", F.col("weight") / sums.all(c, "weight")))
    return c.withColumn("prob", F.least(F.lit(1.0), F.col("weight") / F.col("_cap")))


def draw(seed: str, id_col: str = "doc_id") -> Column:
    """A number in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def probabilities(rows: DataFrame, how: Mix) -> DataFrame:
    """(source, lang, topic, prob) of every combination among ``rows`` (as ``strata`` makes them)."""
    cells = stage(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    weighed = stage(cells.filter("tokens > 0"), "mix-weighed")
    raked = stage(rake(weighed, how).select(*DIMS, "prob"), "mix-raked")
    # a cell without tokens has no weight to calibrate: its documents stay
    return stage(raked.unionByName(cells.filter("tokens = 0").select(*DIMS, F.lit(1.0).alias("prob"))), "mix-prob")


def with_draw(rows: DataFrame, prob: DataFrame, how: Mix) -> DataFrame:
    """``rows`` with ``prob`` and ``kept``."""
    prob = prob.withColumnsRenamed({d: f"_c_{d}" for d in DIMS})
    out = rows.join(prob, [F.col(d) == F.col(f"_c_{d}") for d in DIMS]).drop(*[f"_c_{d}" for d in DIMS])
    return out.withColumn("kept", draw(how.seed) < F.col("prob"))


def mix(docs: DataFrame, how: Mix = Mix(), topic: Column | None = None, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, tokens, prob, kept) for every document."""
    rows = stage(strata(docs, topic, text), "mix-strata")
    return with_draw(rows, probabilities(rows, how), how)


def sample(docs: DataFrame, how: Mix = Mix(), topic: Column | None = None, text: str = "text") -> DataFrame:
    """The documents drawn, with the columns of ``docs``: those whose draw is below their cell's probability."""
    prob = probabilities(strata(docs, topic, text), how)
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    mine, other = spare(docs, *[f"_c_{d}" for d in DIMS]), spare(docs, *[f"_p_{d}" for d in DIMS])
    share, = spare(docs, "_prob")
    own = dict(zip(mine, (none("source"), none("lang"), default_topic(text) if topic is None else topic)))
    keys = prob.select(*[F.col(d).alias(o) for d, o in zip(DIMS, other)], F.col("prob").alias(share))
    out = docs.withColumns(own).join(keys, [F.col(m) == F.col(o) for m, o in zip(mine, other)])
    return out.filter(draw(how.seed) < F.col(share)).select(*docs.columns)
