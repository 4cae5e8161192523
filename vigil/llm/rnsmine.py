"""Hard-negative mining with exact integer scores (residue-number-system matrix products).

Every anchor row is scored against all rows by the inner product of the vectors'
whole components ``floor(scale * x)``.  Its best other rows of the same label are
its positives; for each positive, the best rows of another label whose score lies
in a window below the positive's are its hard negatives.

Method.  Component matrices are taken modulo several small primes and multiplied in
float32: the primes are so small that no sum of products reaches 2^24, so float32
is exact.  Chinese remaindering (balanced mixed radix digits) gives the signed
score back; there are as many primes as the corpus' own bound on a score needs
(largest component times largest sum of components).  Selection keeps the first k
of each anchor and window, tile by tile, and drops what can't enter early.

On Spark.  Equal rows collapse to one with its count.  Anchors are dealt to blocks of
about ``ANCHOR_BLOCK`` components and rows to slices of about ``ROW_SLICE``, by hash, so no key,
label or group of copies can fill a block; each (block, slice) is one group of a
cogroup and returns at most k rows per anchor and window, which a ranked window
merges.  Two products: one finds the positives, one the negatives in their windows.

Rows with a null label, a null vector or a null or non-finite component take no part.
Vectors of different lengths are compared as if the shorter ended in zeros.  A null
id is never an anchor's and sorts last.  A row that is repeated is another row: each
copy can be a positive, and each copy of an anchor returns its rows.  Scores that
would not fit 2^56 raise ValueError.  Empty tables return no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import fresh, partitions_for, prepare_python, release_memory, stored

#: Components of a block of anchors and of a slice of rows (8,192 and 65,536 vectors of 64 components).
ANCHOR_BLOCK, ROW_SLICE = 1 << 19, 1 << 22
#: Anchors and rows of the largest tile of scores.
TILE_ANCHORS, TILE_ROWS = 512, 4_096
#: Least score that counts as one; marks empty places.
NONE = -(1 << 62)
MAX_SCORE = 1 << 56
EXACT = 1 << 24


# ---------------------------------------------------------------- residues


def residue_primes(bound: int, dims: int) -> tuple[list[int], int]:
    """Primes whose product is over twice ``bound``, and the dimensions that one float32 product may sum.

    The largest primes are taken for which ``dims`` (1,024 at most at a time) products
    of centred residues stay within 2^24.
    """
    span = max(1, min(dims, 1_024))
    top = 2 * int((EXACT / span) ** 0.5)
    found, product, p = [], 1, top
    while product <= 2 * bound + 1 or len(found) < 2:
        p -= 1
        if p > 2 and all(p % q for q in range(2, int(p ** 0.5) + 1)):
            found.append(p)
            product *= p
    return found, span


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of integers in -(p-1)/2 .. (p-1)/2."""
    h = (p - 1) // 2
    return np.mod(x + h, p) - h


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(x, p).astype(np.float32) for p in primes]


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int], span: int) -> np.ndarray:
    """Signed inner products of the rows of two matrices that are given by their residues."""
    total, radix = None, 1
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        r = np.zeros((len(a[k]), len(b[k])), np.int32)
        for at in range(0, a[k].shape[1], span):
            r += centred((a[k][:, at:at + span] @ b[k][:, at:at + span].T).astype(np.int32), p)
        r = centred(r, p)
        for q, d in zip(primes, digits, strict=False):  # mixed radix: take the digits so far out, one after the other
            r = centred((r - d) * pow(q, -1, p), p)
        digits.append(r)
        term = r.astype(np.int64)
        if total is None:
            total = term
        else:
            term *= radix
            total += term
        radix *= p
    return total


# ---------------------------------------------------------------- selection


class _Best:
    """First k rows of each anchor and window; equal scores keep the row that came first."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k = k
        self.score = np.full((anchors, windows, k), NONE, np.int64)
        self.row = np.full((anchors, windows, k), -1, np.int64)

    def offer(self, w: int, score: np.ndarray, eligible: np.ndarray, base: int) -> None:
        a, j = np.nonzero(eligible & (score > self.score[:, w, -1:]))
        if not len(a):
            return
        who = np.unique(a)
        anchor = np.concatenate([np.repeat(who, self.k), a])
        value = np.concatenate([self.score[who, w].ravel(), score[a, j]])
        row = np.concatenate([self.row[who, w].ravel(), base + j])
        order = np.lexsort((row, -value, anchor))
        first = np.searchsorted(anchor[order], who)[:, None] + np.arange(self.k)
        self.score[who, w], self.row[who, w] = value[order][first], row[order][first]


def _matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column as a matrix; shorter lists end in zeros."""
    column = column.combine_chunks()
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets, np.int64)
    size = np.diff(off)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _product(primes: list[int], span: int, dims: int, k: int, same: bool):
    """Group function: the first k rows of a slice for each anchor and window of a block."""
    import pyarrow as pa

    schema = pa.schema([("__anchor", pa.int64()), ("__w", pa.int32()), ("__id", pa.int64()), ("__score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        rid = rows["__id"].combine_chunks()
        null = np.asarray(rid.is_null())
        ids = np.asarray(rid.fill_null(0))
        order = np.lexsort((ids, null))  # so that equal scores keep the smaller id
        order = np.repeat(order, np.minimum(rows["__copies"].to_numpy()[order], k))
        label, r = rows["__label"].to_numpy()[order], _matrix(rows["__q"], dims)[order]
        keys, mine, q = anchors["__anchor"].to_numpy(), anchors["__label"].to_numpy(), _matrix(anchors["__q"], dims)
        low, high = (_matrix(anchors[c], max(1, max(map(len, anchors[c].to_pylist())))) for c in ("__low", "__high"))
        n_w = np.array([len(x) for x in anchors["__low"].to_pylist()])
        out = []
        tiles, at, step = [], 0, 256
        while at < len(r):
            tiles.append((at, residues(r[at:at + step], primes)))
            at, step = at + step, min(2 * step, TILE_ROWS)
        for a in range(0, len(keys), TILE_ANCHORS):
            some = slice(a, a + TILE_ANCHORS)
            left, best = residues(q[some], primes), _Best(len(keys[some]), low.shape[1], k)
            for at, right in tiles:
                s = scores(left, right, primes, span)
                wanted = (mine[some][:, None] == label[at:at + s.shape[1]]) == same
                for w in range(low.shape[1]):
                    best.offer(w, s, wanted & (n_w[some] > w)[:, None] & (s >= low[some][:, w, None]) & (s <= high[some][:, w, None]), at)
            x, w, i = np.nonzero(best.row >= 0)
            hit = order[best.row[x, w, i]]
            out.append(pa.table({"__anchor": keys[some][x], "__w": w.astype(np.int32), "__id": pa.array(ids[hit], mask=null[hit]),
                                 "__score": best.score[x, w, i]}, schema))
        return pa.concat_tables(out)

    def tidied(anchors, rows):
        try:
            return run(anchors, rows)
        finally:
            release_memory()
    return tidied


# ---------------------------------------------------------------- operator


def _first(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, k: int, kernel) -> DataFrame:
    """First k rows of every anchor and window over all slices: (__anchor, __w, __rank, __id, __score)."""
    left = anchors.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("__block", "__slice").cogroup(right.groupBy("__block", "__slice")) \
        .applyInArrow(kernel, "__anchor long, __w int, __id long, __score long")
    order = Window.partitionBy("__anchor", "__w").orderBy(F.desc("__score"), F.asc_nulls_last("__id"))
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80,
                   high_percent: int = 100, scale: int = 256, vec_id: str = "vec_id", label: str = "label",
                   vector: str = "embedding") -> DataFrame:
    """Hard negatives of the anchor rows (see the module's text).

    ``is_anchor`` is a condition on the id, named by ``F.col(vec_id)``.  A negative's score is
    within ``low_percent`` and ``high_percent`` of its positive's.  Returns anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    prepare_python(spark)
    condition = fresh(rows, "__is_anchor")
    x = rows.withColumn(condition, is_anchor)
    x = x.select(F.col(vec_id).cast("long").alias("__id"), F.col(label).cast("long").alias("__label"),
                 F.col(vector).cast("array<double>").alias("__x"), F.coalesce(condition, F.lit(False)).alias("__is_anchor"))
    finite = F.forall("__x", lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False)))
    x = x.where(F.col("__label").isNotNull() & F.col("__x").isNotNull() & finite)
    whole = F.transform("__x", lambda v: F.floor(v * F.lit(float(scale))))
    x = x.select("__id", "__label", "__is_anchor", whole.alias("__q"),
                 F.aggregate("__x", F.lit(0.0), lambda t, v: t + F.abs(v * F.lit(float(scale))) + 1).alias("__sum"),
                 F.coalesce(F.array_max(F.transform("__x", lambda v: F.abs(v * F.lit(float(scale))) + 1)), F.lit(0.0)).alias("__max"))
    x = stored(x.groupBy("__id", "__label", "__is_anchor", "__q", "__sum", "__max").agg(F.count(F.lit(1)).alias("__copies")), "vectors")
    size = x.agg(F.count(F.lit(1)).alias("n"), F.count_if("__is_anchor").alias("anchors"), F.max("__sum").alias("sum"),
                 F.max("__max").alias("max"), F.max(F.size("__q")).alias("dims")).first()
    bound, dims = (size["sum"] or 0.0) * (size["max"] or 0.0), max(1, size["dims"] or 1)
    if not bound < MAX_SCORE:
        raise ValueError(f"scores may reach {bound:g}; components are too large for exact 64-bit scores at scale {scale}")
    primes, span = residue_primes(int(bound), dims)
    blocks = partitions_for(size["anchors"] * dims, ANCHOR_BLOCK)
    slices = partitions_for(size["n"] * dims, ROW_SLICE, 2 * spark.sparkContext.defaultParallelism)
    spot = F.xxhash64("__id", "__label", "__q")
    corpus = x.select("__id", "__label", "__q", F.col("__copies").cast("long").alias("__copies"), F.pmod(spot, F.lit(slices)).cast("int").alias("__slice"))
    # numbered before they are written, so that every later read sees the same numbers
    anchors = stored(x.where("__is_anchor").select(
        F.monotonically_increasing_id().alias("__anchor"), "__id", "__label", "__q", "__copies",
        F.pmod(spot, F.lit(blocks)).cast("int").alias("__block"),
        F.aggregate("__q", F.lit(0).cast("long"), lambda t, v: t + v * v).alias("__own")), "anchors")

    span_of = lambda low, high: (F.array(low).alias("__low"), F.array(high).alias("__high"))
    task = ("__anchor", "__label", "__q", "__block")
    k = n_positives + 1  # an anchor itself may be among them
    near = _first(anchors.select(*task, *span_of(F.lit(NONE + 1), F.lit(-NONE))), corpus, blocks, slices, k, _product(primes, span, dims, k, True))
    near = near.groupBy("__anchor").agg(F.array_sort(F.collect_list(F.struct("__rank", "__id", "__score"))).alias("__near"))
    anchors_near = anchors.join(near, "__anchor")
    pairs = F.transform("__near", lambda r: F.struct(r["__id"].alias("__id"), r["__score"].alias("__score")))
    own = F.struct(F.col("__id").alias("__id"), F.col("__own").alias("__score"))
    anchors_near = anchors_near.withColumn("__near", pairs)
    anchors_near = anchors_near.withColumn("__self", F.coalesce(F.array_position("__near", own), F.lit(0)))
    others = F.slice(F.filter("__near", lambda r, i: i != F.col("__self") - 1), 1, n_positives)
    positives = stored(anchors_near.withColumn("__near", others).where(F.size("__near") > 0).drop("__self", "__own"), "positives")

    limit = lambda percent, up: F.transform(  # noqa: E731  in whole numbers: the least (up) or greatest n with 100 n on the right side of percent * p
        "__near", lambda r: -_floor_div(-r["__score"] * percent, 100) if up else _floor_div(r["__score"] * percent, 100))
    far = _first(positives.select(*task, limit(low_percent, True).alias("__low"), limit(high_percent, False).alias("__high")),
                 corpus, blocks, slices, n_negatives, _product(primes, span, dims, n_negatives, False))
    each = positives.select("__anchor", F.col("__id").alias("anchor_id"), "__copies", F.posexplode("__near").alias("__w", "__positive"))
    return far.join(each, ["__anchor", "__w"]).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))) \
        .select("anchor_id", F.col("__positive.__id").alias("positive_id"), F.col("__rank").alias("rank"),
                F.col("__id").alias("negative_id"), F.col("__positive.__score").alias("positive_score"),
                F.col("__score").alias("negative_score"))


def _floor_div(a: Column, b: int) -> Column:
    """Whole division that rounds down."""
    b = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)
