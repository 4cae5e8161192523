"""Benchmark decontamination: rare n-gram seeds join texts to test items, Smith-Waterman alignment scores the copies.

A seed is an ordered pair of words that stand next to each other or with one word
between, in the item or in the text alike.  So a pair survives a word put in, left
out or replaced between its two, and a bound holds: an alignment of an item of m
words with a score of at least s keeps at least ``s * m - 1`` seeds, each at a place
of its own in the item.  (It matches M words with E mismatches and gaps between
them; a score of s means 2 M - E >= 2 s m, and at most E / 2 neighbouring matches are
over one edit apart.)

1. The items' seeds are looked up in all texts, which gives their document frequency.
2. All but about ``s * m - SHARED`` of an item's places, the most frequent, have its
   rare seeds (those that occur).  By the bound every copy holds at least ``SHARED`` of
   them, so the frequent ones, turns of phrase, need not be joined, and nothing is
   lost, however often an item leaked and whoever edited it.
3. Rare seeds join texts (by digest, so copies count once) to items; a text meets an
   item if it has rare seeds of ``SHARED`` of its places (all, for short items).
4. Where a window of such a text has seeds of all kinds enough for the bound, it is
   aligned with the item, word by word.  The local alignment's score, as a share of a
   full match, tells exact, edited and paraphrased copies from chance.

Items of one or two words, which almost any text holds, count only where they are the
whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import byte_slices, column_bytes, fresh, prepare_python, stored, tidy
from vigil.llm.hashes import PUNCTUATION, all_words, mix
from vigil.plans.bits import hash_bits, keep_possible
from vigil.plans.sizing import DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast, is_small

MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a full match's score at which a stretch counts as a copy.
MIN_SCORE = 0.5
#: Words under which an item must be the whole text.
SHORT_WORDS = 3
#: Bytes of texts that a task looks at together.
SLICE_BYTES = 4 << 20
#: Places of an item whose rare seeds a text must have.
SHARED = 3
#: Items that a text meets in one row; more come in further rows.
ITEMS_PER_ROW = 100
#: Bits of the filter that texts' seeds pass before they are joined: 2^20 words of 64, 8 MB.
FILTER_WORDS = 1 << 20

HIT = "struct<item_id:bigint,score:double,n_seeds:int,first_word:bigint,end_word:bigint>"
HITS = f"array<{HIT}>"


# ---------------------------------------------------------------- words and seeds


def _words(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words of a text column, in lower case (of A-Z only, if a text isn't valid UTF-8)."""
    try:
        batch = pa.record_batch([pc.utf8_lower(batch.column(i))], names=["t"])
        i = 0
    except pa.ArrowInvalid:
        pass
    return all_words(*column_bytes(batch, i), gaps=PUNCTUATION)


def seeds(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of all pairs of words of a text that are at most one word apart."""
    first = h * np.uint64(0x9E3779B97F4A7C15)
    keys, at = [], []
    for step in (1, 2):
        same = np.flatnonzero(row[:-step] == row[step:]) if len(h) > step else np.zeros(0, np.int64)
        keys.append(mix(first[same] + h[same + step]))
        at.append(same)
    return np.concatenate(keys), np.concatenate(at)


def whole_key(h: np.ndarray) -> int:
    """Key of a text of one or two words as a whole; no seed has it but by chance."""
    acc = np.uint64(len(h))
    for x in h:
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(1))
    return int(acc)


def needed_seeds(n_words, min_score: float):
    """Seeds that an alignment of ``min_score`` keeps at least (by the module's bound), one for items that align at all."""
    return np.maximum(np.ceil(min_score * np.asarray(n_words) - 1 - 1e-9), 1).astype(np.int64)


def _keys_of(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the seeds of texts and of short texts as a whole."""
    key, at = seeds(h, row)
    r, first, size = np.unique(row, return_index=True, return_counts=True)
    short = np.flatnonzero(size < SHORT_WORDS)
    whole = np.array([whole_key(h[first[k]:first[k] + size[k]]) for k in short], np.uint64)
    return np.concatenate([key, whole]), np.concatenate([row[at], r[short]])


class _Filter:
    """Bits of a set of keys: ``FILTER_WORDS`` words of 64 bits, whatever the number of keys."""

    def __init__(self, keys: DataFrame):
        word, bit = F.col("key").bitwiseAND(F.lit(FILTER_WORDS - 1).cast("long")), F.shiftrightunsigned("key", 58).cast("int")
        rows = keys.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")) \
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.bits = np.zeros(FILTER_WORDS, np.uint64)
        self.bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)

    def may_have(self, key: np.ndarray) -> np.ndarray:
        word = self.bits[(key & np.uint64(FILTER_WORDS - 1)).astype(np.int64)]
        return (word >> (key >> np.uint64(58)) & np.uint64(1)).astype(bool)


def _known(filter_of, text_at: int):
    """Slices of a batch with the (key, row) of their texts' seeds that pass the filter, each once per text."""
    def run(batch: pa.RecordBatch):
        for b in byte_slices(batch, text_at, SLICE_BYTES):
            key, row = _keys_of(*_words(b, text_at))
            ok = filter_of.value.may_have(key)
            key, row = key[ok], row[ok]
            by = np.lexsort((key, row))
            key, row = key[by], row[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            yield b, key[new], row[new]
    return run


def _frequencies(filter_of):
    """(text) -> (key, number of texts) of a slice."""
    known = _known(filter_of, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, key, _ in known(batch):
                k, n = np.unique(key, return_counts=True)
                yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "df"])
    return run


def _occurrences(filter_of):
    """(digest, text) -> (digest, key)."""
    known = _known(filter_of, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, key, row in known(batch):
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(key.view(np.int64))], names=["digest", "key"])
    return run


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (item, words' hashes, number of words)."""
    for b in batches:
        h, row = _words(b, 1)
        size = np.bincount(row, minlength=b.num_rows)
        words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(h.view(np.int64)))
        yield pa.record_batch([b.column(0), words, pa.array(size, pa.int64())], names=["item", "words", "size"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words) -> (item, place, key)."""
    for b in batches:
        for item, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            h = np.asarray(words.values, np.int64).view(np.uint64)
            if 0 < len(h) < SHORT_WORDS:
                key, at = np.array([whole_key(h)], np.uint64), np.zeros(1, np.int64)
            else:
                key, at = seeds(h, np.zeros(len(h), np.int64))
            yield pa.record_batch([pa.array(np.full(len(key), item)), pa.array(at), pa.array(key.view(np.int64))], names=["item", "place", "key"])


# ---------------------------------------------------------------- alignment


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment of two word sequences: (score as a share of a full match, index after its last text word)."""
    m, n = len(item), len(text)
    if not m or not n:
        return 0.0, 0
    row = np.zeros(n + 1)
    slope = np.arange(n + 1) * float(-GAP)
    best, end = 0.0, 0
    for w in item:
        step = np.zeros(n + 1)
        step[1:] = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        step = np.maximum(np.maximum(step, row + GAP), 0)
        # a gap in the item: the best value to the left, less GAP for each word between
        row = np.maximum.accumulate(step + slope) - slope
        j = int(row.argmax())
        if row[j] > best:
            best, end = float(row[j]), j
    return best / (MATCH * m), end


def find_copy(item: np.ndarray, text: np.ndarray, keys: np.ndarray, at: np.ndarray, min_score: float) -> tuple | None:
    """Best copy of an item in a text: (score, n_seeds, first_word, end_word), or None.

    ``keys`` and ``at``: the text's seeds.  Only stretches that can reach the score are aligned: an alignment's words lie
    within ``m + 2 m (1 - min_score)`` words, and keep the needed number of seeds.
    """
    m, n = len(item), len(text)
    if m < SHORT_WORDS:
        return (1.0, 0, 0, n) if n == m and (item == text).all() else None
    own, place = seeds(item, np.zeros(m, np.int64))
    hit = np.isin(keys, own)
    if not hit.any():
        return None
    there = np.zeros(n + 1, np.int64)
    there[at[hit] + 1] = 1  # a word counts once, however many seeds begin with it
    upto = np.cumsum(there)
    span = m + math.ceil(2 * m * (1 - min_score)) + 2
    starts = np.flatnonzero(there[1:])
    enough = starts[upto[np.minimum(starts + span, n)] - upto[starts] >= needed_seeds(m, min_score)]
    best = None
    for part in np.split(enough, np.flatnonzero(np.diff(enough) > span) + 1):
        if not len(part):
            continue
        lo, hi = max(0, int(part[0]) - span), min(n, int(part[-1]) + span)
        if np.isin(item, text[lo:hi]).sum() < min_score * m:  # no alignment matches more words than that
            continue
        score, end = align(item, text[lo:hi])
        if score >= min_score and (best is None or score > best[0]):
            inside = hit & (at >= lo) & (at < hi)
            best = (score, len(np.unique(place[np.isin(own, keys[inside])])), lo, lo + end)
    return best


def _aligned(min_score: float):
    """(digest, text, items: array of (item_id, words)) -> (digest, hits)."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int32()), ("first_word", pa.int64()),
                               ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, 1, SLICE_BYTES):
                h, row = _words(b, 1)
                edges = np.searchsorted(row, np.arange(b.num_rows + 1))
                hits = []
                for i, items in enumerate(b.column(2)):
                    text = h[edges[i]:edges[i + 1]]
                    keys, at = seeds(text, np.zeros(len(text), np.int64))
                    found = []
                    for item in items.values:
                        words = np.asarray(item["words"].values, np.int64).view(np.uint64)
                        copy = find_copy(words, text, keys, at, min_score)
                        if copy:
                            found.append(dict(zip(("score", "n_seeds", "first_word", "end_word"), copy, strict=True)) | {"item_id": item["item_id"].as_py()})
                    hits.append(found)
                yield pa.record_batch([b.column(0), pa.array(hits, kind)], names=["digest", "hits"])
    return run


# ---------------------------------------------------------------- operator


def rare_seeds(items: DataFrame, texts: DataFrame, min_score: float) -> DataFrame:
    """(key, item, place, share) of each item's rare seeds: all but so many of its most frequent places that a copy must hold ``share``.

    ``items``: item, words, size; ``texts``: text.  Places whose seeds no text has are left out.
    """
    spark = items.sparkSession
    places = stored(items.select("item", "words").mapInArrow(tidy(_item_seeds), "item long, place long, key long"), "item-seeds")
    bits = spark.sparkContext.broadcast(_Filter(places.select("key")))
    df = texts.mapInArrow(tidy(_frequencies(bits)), "key long, df long").groupBy("key").agg(F.sum("df").alias("df"))
    known = stored(places.join(df, "key"), "seed-frequencies")  # a seed that no text has falls out
    of_place = known.groupBy("item", "place").agg(F.sum("df").alias("df"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("df"), "place"))
    # a copy holds ``need`` places, so with need - share left out it still holds share; places that no text has need no room
    need = F.greatest(F.ceil(F.lit(min_score) * F.col("size") - 1 - 1e-9), F.lit(1)).cast("int")
    rare = of_place.withColumn("rank", rank).join(items.select("item", need.alias("need"), F.least(need, F.lit(SHARED)).alias("share")), "item") \
        .where("rank > need - share")
    return known.join(rare.select("item", "place", "share"), ["item", "place"]).select("key", "item", "place", "share").distinct()


def find_copies(docs: DataFrame, items: DataFrame, text: str, min_score: float) -> DataFrame:
    """(digest, hits) of the texts of ``docs`` that copy an item; ``digest`` is the text's MD5 as bytes."""
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    named = stored(named.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    words = stored(named.select("item", "text").mapInArrow(tidy(_item_rows), "item long, words array<bigint>, size long").where("size > 0"), "item-words")
    texts = docs.select(digest(text).alias("digest"), F.col(text).alias("text"))
    rare = stored(rare_seeds(words, texts.select("text"), min_score), "rare-seeds")
    bits = spark.sparkContext.broadcast(_Filter(rare.select("key")))
    # copies of a text have one digest and meet an item once
    held = texts.mapInArrow(tidy(_occurrences(bits)), "digest binary, key long")
    pairs = held.join(bounded_broadcast(rare), "key").groupBy("digest", "item", "share", "place").agg(F.lit(1).alias("one")) \
        .groupBy("digest", "item", "share").agg(F.count("one").alias("places")).where("places >= share").select("digest", "item")
    met = pairs.join(words.select("item", "words"), "item").join(named.select("item", "item_id"), "item")
    met = met.withColumn("row", F.floor((F.row_number().over(Window.partitionBy("digest").orderBy("item")) - 1) / ITEMS_PER_ROW))
    met = stored(met.groupBy("digest", "row").agg(F.collect_list(F.struct("item_id", "words")).alias("items")), "candidates")
    small = is_small(met.select("digest"), DEFAULT_MAX_BROADCAST_ROWS)
    touched = texts.dropDuplicates(["digest"]) if not small else texts
    some = met.select(F.col("digest").alias("d")).distinct()
    if small:
        touched = texts.join(F.broadcast(some), F.col("digest") == F.col("d"), "left_semi").dropDuplicates(["digest"])
    else:  # the texts that may be meant, by a bounded filter, before any of them moves
        hexed = lambda c: F.hex(c).alias("key")
        touched = keep_possible(texts.withColumn("key", F.hex("digest")), "key", stored(hash_bits(some.select(hexed("d")), "key"), "digest-bits")) \
            .drop("key").dropDuplicates(["digest"])
    aligned = touched.join(met, "digest").select("digest", "text", "items").mapInArrow(tidy(_aligned(min_score)), f"digest binary, hits {HITS}")
    found = aligned.select("digest", F.explode("hits").alias("hit"))
    # one hit per item id, the best, then the first
    order = Window.partitionBy("digest", "hit.item_id").orderBy(F.desc("hit.score"), "hit.first_word", "hit.end_word")
    found = found.withColumn("k", F.row_number().over(order)).where("k = 1")
    return found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct(F.col("hit.item_id").isNull().alias("last"), "hit.item_id", "hit"))).alias("h")) \
        .select("digest", F.transform("h", lambda x: x["hit"]).alias("hits"))


def digest(text: str):
    """MD5 of a text as bytes; a null text has that of the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", min_score: float = MIN_SCORE,
                  out: str = "hits") -> DataFrame:
    """All rows of ``docs`` with the test items that their text copies, as array ``out``.

    ``items``: ``item_id`` (long), ``text``.  A hit has the item's id, the score
    (1.0: the whole item, word for word), the number of the item's places whose seeds are
    there, and the words of the text between which the copy lies; of several copies of an
    item the best (then the first) is told.  Words are runs of ASCII letters, digits and
    non-ASCII characters, in lower case.

    A null or empty text has no hits, an item without words is never found; items of one or
    two words are found where they are the whole text.  An existing column ``out`` is replaced.
    """
    prepare_python(docs.sparkSession)
    work = docs.drop(out)
    hits = bounded_broadcast(stored(find_copies(work, items, text, min_score), "copies"))
    mark, mine, theirs = fresh(work, out), fresh(work, "__digest"), fresh(work, "__found")
    hits = hits.select(F.col("digest").alias(theirs), F.col("hits").alias(mark))
    joined = work.withColumn(mine, digest(text)).join(hits, F.col(mine) == F.col(theirs), "left").drop(mine, theirs)
    return joined.withColumn(mark, F.coalesce(F.col(mark), F.array().cast(HITS)))
