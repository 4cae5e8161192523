"""N-gram Jaccard self-join of whole texts by vertical partitioning.

A document is its set of word n-grams, as 64-bit hashes.  The order of the
hashes is cut into fragments; each fragment gets its stretch of every set and
works alone, and what the fragments count is summed.

1. Documents with equal sets form a class; from here on a class is one item, so
   copies cost nothing further.
2. Fragments count in how many classes each n-gram occurs and pass on those in
   two or more.  Summed over the fragments this bounds what a class can share; a
   class whose bound is under its least overlap has no partner and leaves.
3. Candidates: classes that share one of their rarest n-grams (prefix filter).
   In each n-gram's list all others are first compared with one centre, the one
   that shares the largest part of its set.  Links make components, and only
   pairs of different components that sizes and bounds allow are compared
   after that, so a group of near copies isn't expanded into all its pairs: in
   short lists as rows, in long ones block by block inside tasks.
4. A pair's overlap is counted fragment by fragment and summed per pair.

No list, candidate or partner is capped: a pair is skipped only if a bound
excludes it or both are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import K1, NULL_ID, byte_slices, column_bytes, partitions_for, prepare_python, stored, tidy
from vigil.llm.components import connected
from vigil.llm.hashes import all_words, mix, shingles

#: n-grams that one fragment task sorts together.
FRAGMENT_TOKENS = 2_000_000
#: Classes in an n-gram's list up to which its pairs are joined as rows; longer lists are compared in blocks.
SHORT_LIST = 32
#: Classes of a block.
BLOCK_MEMBERS = 512


def document_sets(buf, starts, ends, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, size, class) of a batch: each text's distinct n-gram hashes in order, their number, and the set's hash."""
    h, row, _ = shingles(*all_words(buf, starts, ends), n)
    by = np.argsort(row, kind="stable")
    h, row = h[by], row[by]
    at = np.searchsorted(row, np.arange(len(starts) + 1))
    sets = [np.unique(h[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens), dtype=np.uint64)])
    end = np.cumsum(size)
    cls = mix(total[end] - total[end - size] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return tokens, size, cls


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, cls = (np.concatenate(x) for x in zip(*[document_sets(*column_bytes(p, 1), n)[1:] for p in byte_slices(b, 1)], strict=True))
            yield pa.record_batch([b.column(0), pa.array(size), pa.array(cls.view(np.int64), mask=size == 0)],
                                  names=["k", "n", "cls"])
    return run


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    """Arrays in one byte string: a count for each, then their bytes in turn."""
    head = np.array([len(v) for v in columns.values()], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(v).tobytes() for v in columns.values())


def _unpacked(data: bytes, types: dict[str, type]) -> dict[str, np.ndarray]:
    counts = np.frombuffer(data, np.int64, len(types))
    at, out = 8 * len(types), {}
    for (name, t), c in zip(types.items(), counts, strict=True):
        out[name] = np.frombuffer(data, t, int(c), at)
        at += int(c) * np.dtype(t).itemsize
    return out


SEGMENTS = {"cls": np.uint64, "size": np.int32, "count": np.int32, "token": np.uint64}
SHARED = {"cls": np.uint64, "size": np.int32, "count": np.int32, "token": np.uint64, "rarity": np.uint8}
_BLOB = pa.schema([("f", pa.int32()), ("data", pa.binary())])


def _segment_rows(n: int, fragments: int):
    """Texts -> (fragment, packed stretches of the sets of a batch); a class once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (p for whole in batches for p in byte_slices(whole, 0)):
            tokens, size, cls = document_sets(*column_bytes(b, 0), n)
            fresh = np.zeros(len(size), bool)
            for i, c in enumerate(cls.tolist()):
                if size[i] and c not in seen:
                    seen.add(c)
                    fresh[i] = True
            doc = np.repeat(np.arange(len(size)), size)
            keep = fresh[doc]
            tokens, doc = tokens[keep], doc[keep]
            frag = ((tokens >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(frag, kind="stable")
            frag, doc, tokens = frag[by], doc[by], tokens[by]
            edges = np.searchsorted(frag, np.arange(fragments + 1))
            for f in range(fragments):
                a, z = int(edges[f]), int(edges[f + 1])
                if a == z:
                    continue
                d, count = np.unique(doc[a:z], return_counts=True)
                data = _packed({"cls": cls[d], "size": size[d].astype(np.int32), "count": count.astype(np.int32),
                                "token": tokens[a:z]})
                yield pa.record_batch([pa.array([f], pa.int32()), pa.array([data], pa.binary())], schema=_BLOB)
    return run


def _by_fragment(batches: Iterator[pa.RecordBatch], types: dict[str, type]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Blobs sorted by fragment -> (fragment, its arrays joined)."""
    held: list[dict[str, np.ndarray]] = []
    now = None
    for b in batches:
        for f, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if f != now and held:
                yield now, {k: np.concatenate([x[k] for x in held]) for k in types}
                held = []
            now = f
            held.append(_unpacked(data.as_py(), types))
    if held:
        yield now, {k: np.concatenate([x[k] for x in held]) for k in types}


def _shared_rows(groups: int):
    """A fragment's stretches -> its n-grams in two or more classes, packed for groups of classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _by_fragment(batches, SEGMENTS):
            classes, first, inverse = np.unique(x["cls"], return_index=True, return_inverse=True)
            size = x["size"][first]
            once = np.zeros(len(x["cls"]), bool)
            once[first] = True  # a class that several tasks sent counts once
            use = np.repeat(once, x["count"])
            owner = np.repeat(inverse, x["count"])[use].astype(np.int32)
            token = x["token"][use]
            by = np.argsort(token)
            token, owner = token[by], owner[by]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            begin = np.flatnonzero(new)
            df = np.diff(np.append(begin, len(token)))
            rarity = np.minimum(255, 8 * np.log2(np.maximum(df, 1))).astype(np.uint8)
            many = np.repeat(df > 1, df)
            rarity = np.repeat(rarity, df)[many]
            token, owner = token[many], owner[many]
            by = np.argsort(owner, kind="stable")
            token, owner, rarity = token[by], owner[by], rarity[by]
            have, count = np.unique(owner, return_counts=True)
            group = (classes[have] % np.uint64(groups)).astype(np.int64)
            end = np.cumsum(count)
            for g in np.unique(group):
                pick = np.flatnonzero(group == g)
                which = np.repeat(pick, count[pick])
                place = np.arange(len(which)) - np.repeat(np.cumsum(count[pick]) - count[pick], count[pick]) + (end - count)[which]
                data = _packed({"cls": classes[have[pick]], "size": size[have[pick]], "count": count[pick].astype(np.int32),
                                "token": token[place], "rarity": rarity[place]})
                yield pa.record_batch([pa.array([g], pa.int32()), pa.array([data], pa.binary())], schema=_BLOB)
    return run


def _least(size, percent: int):
    """Least overlap that a set of ``size`` has with any partner."""
    return -(-percent * size // 100)


def _survivor_rows(percent: int):
    """What the fragments passed on, summed per class -> classes that can have a partner, rarest n-grams first."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("prefix", pa.int32()),
                        ("token", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _by_fragment(batches, SHARED):
            classes, first, inverse = np.unique(x["cls"], return_index=True, return_inverse=True)
            size = x["size"][first].astype(np.int64)
            s = np.bincount(inverse, x["count"], len(classes)).astype(np.int64)
            alive = s >= _least(size, percent)
            owner = np.repeat(inverse, x["count"])
            use = alive[owner]
            owner, token, rarity = owner[use], x["token"][use], x["rarity"][use]
            by = np.lexsort((token, rarity, owner))
            token = token[by].view(np.int64)
            pick = np.flatnonzero(alive)
            for i in range(0, len(pick), 2000):
                part = pick[i:i + 2000]
                offs = np.concatenate([[0], np.cumsum(s[part])]).astype(np.int32)
                base = int(s[pick[:i]].sum())
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(token[base:base + int(offs[-1])]))
                prefix = s[part] - _least(size[part], percent) + 1
                yield pa.record_batch([pa.array(classes[part].view(np.int64)), pa.array(size[part]), pa.array(s[part]),
                                       pa.array(prefix.astype(np.int32)), lists], schema=schema)
    return run


def _allowed(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bounds let two classes link: neither shares fewer n-grams than their overlap would need."""
    need = F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    return (F.lit(100 + percent) * F.least(F.col(f"{a}.s"), F.col(f"{b}.s")) >= need) \
        & (100 * F.col(f"{a}.n") >= percent * F.col(f"{b}.n")) & (100 * F.col(f"{b}.n") >= percent * F.col(f"{a}.n"))


def _enough(percent: int) -> Column:
    """Whether ``c`` n-grams shared by two prefixes leave the overlap possible.

    Two sets share what their prefixes share and at most what is left of the
    one whose prefix ends first: fewer than its least overlap.
    """
    least = lambda n: F.ceil(F.lit(percent) * F.col(n) / 100)
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    return F.col("c") + F.greatest(least("na"), least("nb")) - 1 >= need


def block_pairs(cls, n, s, root, prefixes, left, right, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left index, right index) of different components that sizes, bounds and their prefixes allow."""
    size = np.array([len(x) for x in prefixes], np.int64)
    _, token = np.unique(np.concatenate(prefixes), return_inverse=True)
    times = np.bincount(token)
    member = np.repeat(np.arange(len(prefixes)), size)
    many = times[token] > 1
    _, token = np.unique(token[many], return_inverse=True)
    member = member[many]
    by = np.argsort(token, kind="stable")
    token, member = token[by], member[by]
    shared = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(prefixes), -1)
    at_left, at_right = place.copy(), place.copy()
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    width = 4096
    for t in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        lo, hi = np.searchsorted(token, (t, t + width))
        mats = []
        for at, k in ((at_left, len(left)), (at_right, len(right))):
            m = np.zeros((k, width), np.float32)
            own = at[member[lo:hi]]
            m[own[own >= 0], token[lo:hi][own >= 0] - t] = 1
            mats.append(m)
        shared += mats[0] @ mats[1].T
    nl, nr, sl, sr = n[left][:, None], n[right][None], s[left][:, None], s[right][None]
    need = -(-percent * (nl + nr) // (100 + percent))
    ok = (np.minimum(sl, sr) >= need) & (100 * nl >= percent * nr) & (100 * nr >= percent * nl)
    ok &= shared + np.maximum(_least(nl, percent), _least(nr, percent)) - 1 >= need
    ok &= (shared > 0) & (root[left][:, None] != root[right][None])
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    once = cls[i] < cls[j] if left is right else np.ones(len(i), bool)
    return i[once], j[once]


def _block_rows(percent: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, n, s, root = (pdf[c].to_numpy(np.int64) for c in ("cls", "n", "s", "root"))
        own = pdf["own"].to_numpy()
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            left = right = np.arange(len(pdf))
        else:
            left, right = np.flatnonzero(own == pdf["i"].iloc[0]), np.flatnonzero(own == pdf["j"].iloc[0])
        x, y = block_pairs(cls, n, s, root, [np.asarray(t) for t in pdf["prefix"]], left, right, percent)
        low = cls[x] < cls[y]
        a, b = np.where(low, x, y), np.where(low, y, x)
        return pd.DataFrame({"a": cls[a], "b": cls[b], "na": n[a], "nb": n[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            key = pdf[["q", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for k, part in enumerate(np.split(np.arange(len(pdf)), cuts)):
                now = pdf.iloc[part]
                if held and (k or tuple(held[-1][["q", "i", "j"]].iloc[0]) != tuple(now[["q", "i", "j"]].iloc[0])):
                    yield solve(pd.concat(held, ignore_index=True))
                    held = []
                held.append(now)
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _long_list_pairs(long: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of classes that meet in long lists.

    Classes tied together by long lists form a cluster, cut into blocks; every
    two blocks meet in one task, which counts what all their prefixes share in
    one matrix product and passes on only the pairs that the bound leaves.
    """
    cluster = connected(long.select(F.col("cls").alias("a"), F.col("token").alias("b"))).withColumnRenamed("root", "q")
    members = long.select("cls", "n", "s", "root").distinct().join(cluster, F.col("cls") == F.col("v")).drop("v")
    blocks = members.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("blocks"))
    members = members.join(blocks, "q").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")) \
        .join(alive.select("cls", F.slice("token", 1, F.col("prefix")).alias("prefix")), "cls") \
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = members.select("q", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "cls", "n", "s", "root", "prefix")
    return met.repartition("q", "i", "j").sortWithinPartitions("q", "i", "j") \
        .mapInPandas(tidy(_block_rows(percent)), "a long, b long, na long, nb long")


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) that link, with ``overlap``: counted in each fragment, summed per pair."""
    left = segments.select(F.col("cls").alias("a"), "f", F.col("part").alias("pa"))
    right = segments.select(F.col("cls").alias("b"), "f", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "f"]) \
        .select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("c"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("overlap"))
    return total.where((100 + percent) * F.col("overlap") >= percent * (F.col("na") + F.col("nb")))


def ngram_jaccard(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Document sizes and near-duplicate components.

    ``docs``: ``doc_id`` (long), ``text``; other columns are ignored.  A-Z count
    as a-z; a text with fewer than ``n`` words is one n-gram, a text without
    words has none and links with nothing.  Two documents link when ``100 *
    intersection >= percent * union`` of their n-gram sets.

    One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest
    ``doc_id`` that links reach, the document's own without links; null ids
    count as the largest and give null if they are alone).  N-grams and equal
    sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(K1), F.col("text").cast("binary").alias("t"))
    sets = stored(keyed.mapInArrow(tidy(_set_rows(n)), "k long, n long, cls long"), "sets")
    classes = stored(sets.where("n > 0").groupBy("cls").agg(F.min("k").alias("least"), F.max("n").alias("n")), "classes")
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    fragments = partitions_for(tokens, FRAGMENT_TOKENS)

    cut = keyed.select("t").mapInArrow(tidy(_segment_rows(n, fragments)), "f int, data binary")
    shared = cut.repartition(fragments, "f").sortWithinPartitions("f") \
        .mapInArrow(tidy(_shared_rows(fragments)), "f int, data binary")
    alive = stored(shared.repartition(fragments, "f").sortWithinPartitions("f").mapInArrow(
        tidy(_survivor_rows(percent)), "cls long, n long, s long, prefix int, token array<long>"), "survivors")

    # a quarter of the (signed) hash order each
    segments = alive.select("cls", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("f"), "token") \
        .select("cls", "f", F.expr("filter(token, t -> shiftright(t, 62) + 2 = f)").alias("part")).where(F.size("part") > 0)
    index = stored(alive.select("cls", "n", "s", F.explode(F.slice("token", 1, F.col("prefix"))).alias("token")), "index")

    # each n-gram's list has a centre; a class is compared with the best of its centres only
    share = F.col("s") / F.col("n")
    centres = index.groupBy("token").agg(F.max(F.struct(share.alias("share"), "cls", "n", "s")).alias("c"),
                                         F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "c.*")
    star = index.alias("x").join(centres.alias("c"), F.col("x.token") == F.col("c.token")) \
        .where((F.col("x.cls") != F.col("c.cls")) & _allowed("x", "c", percent)) \
        .groupBy(F.col("x.cls").alias("b"), F.col("x.n").alias("nb")).agg(F.max(F.struct("c.share", "c.cls", "c.n")).alias("c")) \
        .select(F.col("c.cls").alias("a"), "b", F.col("c.n").alias("na"), "nb")
    star = stored(star, "pairs")
    first = stored(linked(star, segments, percent).select("a", "b"), "links")

    # what is left: pairs of different components in a list that has several
    roots = connected(first)
    placed = index.join(roots, index["cls"] == roots["v"], "left").select(
        "token", "cls", "n", "s", F.coalesce("root", "cls").alias("root"))
    lists = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("least"),
                                        F.max("n").alias("most")).where("r0 <> r1").select("token", "least", "most")
    open_ = placed.join(lists, "token").where(
        ((100 + percent) * F.col("s") - percent * F.col("n") >= percent * F.col("least"))
        & (100 * F.col("most") >= percent * F.col("n"))).select("token", "cls", "n", "s", "root")
    open_ = stored(open_, "open")
    sizes = open_.groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    short = open_.join(sizes.where(F.col("m") <= SHORT_LIST).select("token"), "token")
    rest = short.alias("x").join(short.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls"))
                                 & (F.col("x.root") != F.col("y.root")) & _allowed("x", "y", percent)) \
        .groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")) \
        .agg(F.count(F.lit(1)).alias("c")).where(_enough(percent)).drop("c")
    long = stored(open_.join(sizes.where(F.col("m") > SHORT_LIST).select("token"), "token"), "long-lists")
    if long.limit(1).count():
        rest = rest.unionByName(_long_list_pairs(long, alive, percent)).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    second = stored(linked(rest, segments, percent).select("a", "b"), "links")
    if second.limit(1).count():
        roots = connected(first.unionByName(second))

    whole = classes.join(roots, classes["cls"] == roots["v"], "left").select(
        "cls", "least", F.coalesce("root", "cls").alias("root"))
    of = whole.groupBy("root").agg(F.min("least").alias("component"))
    of = whole.join(of, "root").select("cls", "component")
    out = sets.join(of, "cls", "left")
    return out.select(F.nullif("k", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.nullif(F.coalesce("component", "k"), F.lit(NULL_ID)).alias("component_id"))
