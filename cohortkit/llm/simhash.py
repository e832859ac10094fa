"""SimHash near-duplicates by a generalised pigeonhole.

Fingerprints are 64 bit.  Two fingerprints link at ``max_bits`` (tau) or fewer
differing bits; components of links are the groups.

Method.  The 64 bits are dealt into m partitions so that correlated bits share
one.  Partition i gets its own threshold t_i >= -1 with sum(t_i + 1) = tau + 1:
if every partition of a pair differed in more than t_i bits, the pair would
differ in more than tau, so each linked pair agrees on some partition up to t_i
bits (t_i = -1 leaves a partition out).  Dynamic programming picks the
thresholds, for m = 2, 3 and 4, by the estimated work: rows moved and candidate
pairs.  Estimates come from all fingerprints: the exact number of pairs that
agree on a partition, carried on to one more differing bit by the bits' shares.
Every fingerprint is indexed under its own value in each used partition and
probes the values up to t_i flips away (of a pair one flips the lowest differing
bit from 0 to 1, so only such flips are made).  Candidates are verified on all 64
bits.

Scale.  Copies collapse to one distinct fingerprint first.  A bucket's
candidates are compared inside a task and only a spanning forest of the links
found leaves it (fewer rows than the bucket has), so a group of many near copies
never emits its pairs.  Buckets above ``bucket_rows`` are cut into blocks and every
two blocks meet in a task of their own: no pair is lost and no task holds more
than two blocks.

Nulls, empty texts: a text with no word has fingerprint zero and is linked like
any other; a null text counts as empty.  Repeated rows are copies.  A null
doc_id is never a component id unless nothing else is there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, spare, stage
from .components import components

BITS = 64
#: Work of moving a row through a shuffle, in comparisons of two fingerprints.
ROW_COST = 20.0


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of lower-cased words; a bit is 1 if set in over half the shingle hashes."""
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    xx = xxhash.xxh64_intdigest
    hashes = np.array([xx(g, seed) for g in grams], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 15):  # a very long text in bounded pieces
        part = hashes[a:a + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = np.empty(len(texts), dtype="<u8")
            for i, t in enumerate(texts):
                t = t.as_py()
                out[i] = fingerprint(t.lower().split(), shingle) if t else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view("<i8"))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, fp long")


# -- plan ---------------------------------------------------------------------

def co_occurrence(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over all fingerprints (one bounded matrix a task)."""

    def run(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            v = np.ascontiguousarray(batch.column(0).to_numpy())
            for a in range(0, len(v), 1 << 14):
                x = np.unpackbits(v[a:a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((BITS, BITS), dtype=np.int64)
    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # 4096 rows whatever the input
        out[r.i, r.j] = r.n
    return out


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits dealt into m near equal partitions, each grown from its most correlated pair."""
    share = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(share, share)
    dev = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        sub = corr[np.ix_(left, left)]
        x, y = divmod(int(sub.argmax()), len(left))
        part = [left[x], left[y]] if x != y else left[:2]
        left = [b for b in left if b not in part]
        while len(part) < size:
            best = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            left.remove(best)
        groups.append(sorted(part))
    return groups


def project(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, packed from the lowest."""
    out = np.zeros(len(values), dtype=np.uint64)
    for to, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(to)
    return out


def agreeing_pairs(fps: DataFrame, layouts: list[list[int]]) -> list[float]:
    """For each group of bits the number of pairs of distinct fingerprints that agree on it."""

    def run(batches):
        for batch in batches:
            v = np.ascontiguousarray(batch.column(0).to_numpy()).view("<u8")
            for p, bits in enumerate(layouts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), p, dtype=np.int32)), pa.array(project(v, bits).view("<i8"))], ["p", "key"])

    sizes = fps.select("fp").mapInArrow(run, "p int, key long").groupBy("p", "key").count()
    rows = sizes.groupBy("p").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    found = {r.p: r.pairs for r in rows.collect()}  # one row a group of bits
    return [found.get(p, 0.0) for p in range(len(layouts))]


def growth(share: np.ndarray, bits: list[int], most: int) -> list[float]:
    """P(at most t of the bits differ) / P(none differs) for t = 0..most, bits taken as independent."""
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for b in bits:
        d = min(max(2 * share[b] * (1 - share[b]), 1e-9), 1 - 1e-9)
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return list(np.cumsum(dist[:most + 1]) / max(dist[0], 1e-300))


def flips(n_bits: int, t: int) -> list[int]:
    """Masks that flip 1..t of n_bits bits."""
    return [sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(range(n_bits), r)]


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost with sum(t + 1) = tau + 1; costs[i][t + 1] for t = -1..tau."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, tau - used + 1):
                cand = (cost + row[t + 1], [*ts, t])
                if used + t + 1 not in step or cand < step[used + t + 1]:
                    step[used + t + 1] = cand
        best = step
    return best[tau + 1]


def plan(fps: DataFrame, tau: int, partitions=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest layout; partitions with threshold -1 are left out."""
    together = co_occurrence(fps)
    n = fps.count()
    share = np.diag(together) / max(n, 1)
    layouts = {m: group_bits(together, n, m) for m in partitions}
    flat = [bits for m in partitions for bits in layouts[m]]
    pairs = iter(agreeing_pairs(fps, flat))
    best = None
    for m in partitions:
        costs = []
        for bits in layouts[m]:
            base, ratio = next(pairs), growth(share, bits, tau)
            costs.append([0.0] + [
                n * ROW_COST * (1 + len(flips(len(bits), t)) / 2) + max(base, n * n / 2 ** (len(bits) + 1)) * ratio[t]
                for t in range(tau + 1)])
        cost, ts = allocate(costs, tau)
        if best is None or cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(layouts[m], ts) if t >= 0])
    return best[1]


# -- probe and verify ------------------------------------------------------------

def bucket_rows_of(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(p, key, probe, fp): each fingerprint under its own key and, as a probe, under the keys t flips away."""

    def run(batches):
        for batch in batches:
            v = np.ascontiguousarray(batch.column(0).to_numpy()).view("<u8")
            for p, (bits, t) in enumerate(parts):
                own = project(v, bits)
                for mask in [0, *flips(len(bits), t)]:
                    low = np.uint64(mask & -mask)
                    take = slice(None) if not mask else (own & low) == 0
                    key, fp = own[take] ^ np.uint64(mask), v[take]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), p, dtype=np.int32)), pa.array(key.view("<i8")),
                         pa.array(np.full(len(fp), bool(mask))), pa.array(fp.view("<i8"))], ["p", "key", "probe", "fp"])

    return fps.select("fp").mapInArrow(run, "p int, key long, probe boolean, fp long")


def link_forest(fp: np.ndarray, probe: np.ndarray, start: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of each bucket, thinned to a forest: (fingerprint, least one it is joined to).

    ``start``: first row of the bucket for each row; buckets lie one after another.
    """
    n = len(fp)
    bits = fp.view("<u8")
    root = np.arange(n)

    def find(x):
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = root[up]

    active, d = np.arange(n), 1
    while True:
        active = active[active + d < n]
        active = active[start[active + d] == start[active]]
        if not len(active):
            break
        a, b = active, active + d
        hit = (np.bitwise_count(bits[a] ^ bits[b]) <= tau) & ~(probe[a] & probe[b])
        if hit.any():
            ra, rb = find(a[hit]), find(b[hit])
            for x, y in np.unique(np.stack([ra, rb], 1)[ra != rb], axis=0):
                x, y = int(x), int(y)
                while root[x] != x:
                    x = int(root[x])
                while root[y] != y:
                    y = int(root[y])
                if x != y:
                    lo, hi = (x, y) if fp[x] <= fp[y] else (y, x)
                    root[hi] = lo
        d += 1
    top = find(np.arange(n))
    keep = fp[top] != fp
    return fp[keep], fp[top][keep]


def links(fps: DataFrame, parts: list[tuple[list[int], int]], tau: int, bucket_rows: int = 4096) -> DataFrame:
    """(fp, other): links whose components are those of all pairs within tau bits."""
    rows = stage(bucket_rows_of(fps, parts), "simhash-probes")
    hot = stage(rows.groupBy("p", "key").count().filter(F.col("count") > bucket_rows)
                .select(F.col("p").alias("_p"), F.col("key").alias("_key"),
                        F.ceil(F.col("count") / F.lit(bucket_rows)).cast("int").alias("_blocks")), "simhash-hot")
    block = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    meets = F.when(F.col("_blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda d: (
            F.least(d, F.col("_block")).cast("long") * F.col("_blocks") + F.greatest(d, F.col("_block")))))
    dealt = (rows.join(hot, (F.col("p") == F.col("_p")) & (F.col("key") == F.col("_key")), "left")
             .withColumn("_block", block).select("p", "key", "probe", "fp", F.explode(meets).alias("unit")))
    n = shuffle_partitions(fps.sparkSession)
    dealt = dealt.repartition(n, "p", "key", "unit").sortWithinPartitions("p", "key", "unit", "probe")

    def run(batches):
        left = None
        for batch in batches:
            cols = {k: np.ascontiguousarray(batch.column(k).to_numpy(zero_copy_only=False))
                    for k in ("p", "key", "unit", "probe", "fp")}
            if left is not None:
                cols = {k: np.concatenate([left[k], v]) for k, v in cols.items()}
            new = np.ones(len(cols["fp"]), dtype=bool)
            if len(new):
                new[1:] = ((cols["p"][1:] != cols["p"][:-1]) | (cols["key"][1:] != cols["key"][:-1])
                           | (cols["unit"][1:] != cols["unit"][:-1]))
                cut = int(np.flatnonzero(new)[-1])  # the last bucket may go on in the next batch
                left = {k: v[cut:] for k, v in cols.items()}
                yield forest({k: v[:cut] for k, v in cols.items()}, new[:cut])
        if left is not None:
            new = np.zeros(len(left["fp"]), dtype=bool)
            new[0] = True
            yield forest(left, new)

    def forest(cols, new):
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else new.astype(int)
        a, b = link_forest(cols["fp"], cols["probe"].astype(bool), start, tau)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp", "other"])

    return dealt.mapInArrow(run, "fp long, other long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, its own included."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    own = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    joined = components(links(own, plan(own, max_bits), max_bits, bucket_rows), "fp", "other")
    member = stage(own.join(joined, own.fp == joined.node, "left")
                   .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-member")
    least = stage(member.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id")), "simhash-least")
    label = stage(member.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"),
                  "simhash-label")
    return fps.join(label, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The document with the smallest id of each group, with all columns of ``docs``.

    Rows are told apart by id and text: of a repeated id only the rows whose own text leads its group stay, of
    different texts with the smallest id the one of the least hash, and of equal rows one.
    """
    from pyspark.sql import Window

    first, nth = spare(docs, "_first", "_nth")
    # a null id comes after all others
    own = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    groups = simhash_groups(docs.select(own.alias("row"), "text"), id_col="row", **how)
    lead = stage(groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(first)).distinct(),
                 "simhash-first")
    # one plan at every size: the texts move once, by id
    ids = F.col("doc_id").eqNullSafe(F.col(f"{first}.id")) & (F.xxhash64("text") == F.col(f"{first}.h"))
    kept = docs.join(lead.hint("merge"), ids, "left_semi")
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return kept.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*docs.columns)
