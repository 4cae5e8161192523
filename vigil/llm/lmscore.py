"""Cross-entropy difference of two matched n-gram models.

A target model (documents known to be good) and a background model (all
documents) score every document by the difference of their losses per token:
low means that a text looks like the target, not just like fluent text.

Both are bigram models with the same vocabulary (every word of the documents),
order and smoothing.  They are matched in size too: the background's counts are
scaled to the target's number of tokens, so smoothing weighs the same in both.

Counts are exact and grow with the corpus.  They are never stored as a table of
pairs nor joined token by token: documents are worked off in slices of about
``SLICE_BYTES``; a slice asks for the counts of its distinct words and pairs, once
each, and gets them back.

1. The documents are written once, numbered and with their target flag, so both
   passes cut the same slices.
2. A slice's questions are sorted hashes with the slice's own counts, packed (gaps
   between neighbours, by byte planes) for each of a number of fragments of the
   hash range.
3. A fragment adds up what all slices know of its words and pairs and answers each
   slice in the order of its questions.
4. The slice's documents meet the answers, and losses are summed within the task.

A word or pair costs one question per slice that has it, however frequent it is, so
no key is hot; a fragment holds the questions of about ``FRAGMENT_BYTES`` of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import byte_slices, column_bytes, partitions_for, prepare_python, stored, tidy
from vigil.llm.hashes import all_words, mix
from vigil.plans.sizing import bounded_broadcast

#: Bytes of texts that a task counts or scores together.
SLICE_BYTES = 8 << 20
#: Bytes of texts whose words and pairs one fragment holds.
FRAGMENT_BYTES = 8 << 20
#: Weight of the word model in the pair model, in tokens.
PRIOR = 20.0

#: The word before a text's first.
START = np.uint64(1)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def tokens(buf, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word before, hash of the word, row) of every token."""
    h, row = all_words(buf, starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = row[1:] != row[:-1]
        before[first] = START
    return before, h, row


# ---------------------------------------------------------------- packing


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on: each its length, its width in bytes, and its byte planes."""
    out = []
    for x in columns:
        x = np.ascontiguousarray(x, "<u8")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [np.array([len(x), width], "<i8").tobytes(), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return b"".join(out)


def unpack(data) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = (int(v) for v in np.frombuffer(data, "<i8", 2, at))
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(x.reshape(-1).view("<u8"))
        at += 16 + n * width
    return out


def _gaps(x: np.ndarray) -> np.ndarray:
    """Sorted values as the first and the steps between neighbours."""
    return np.diff(x, prepend=np.uint64(0))


# ---------------------------------------------------------------- slices


class Slice:
    """Distinct words and pairs of a slice of texts, and where its tokens find them."""

    def __init__(self, buf, starts, ends):
        before, word, self.row = tokens(buf, starts, ends)
        self.pairs, self.pair = np.unique(pair_hash(before, word), return_inverse=True)
        self.words, at = np.unique(np.append(word, START), return_inverse=True)
        self.word = at[:-1]
        self.context = np.empty(len(word), np.int64)
        self.context[1:] = self.word[:-1]
        self.context[before == START] = at[-1]

    def counts(self, good: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of words: n, good, as context, good as context; of pairs: n, good.  ``good``: the rows' flags."""
        good = good[self.row]
        count = lambda where, n: [np.bincount(where, minlength=n), np.bincount(where[good], minlength=n)]
        return (count(self.word, len(self.words)) + count(self.context, len(self.words)), count(self.pair, len(self.pairs)))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows) of a task's slices: its rows (number, doc_id, good, text) in order, cut at about ``SLICE_BYTES`` of text.

    A slice is numbered like its first row; the same partition is always cut alike.
    """
    held, size = [], 0

    def whole():
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return b.column(0)[0].as_py(), b

    for b in (p for batch in batches for p in byte_slices(batch, 3, SLICE_BYTES)):
        if not b.num_rows:
            continue
        _, starts, ends = column_bytes(b, 3)
        n = int((ends - starts).sum())
        if held and size + n > SLICE_BYTES:
            yield whole()
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield whole()


def _edges(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Where each fragment begins among sorted hashes; fragments are ranges of their upper 32 bits."""
    frag = (hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
    return np.searchsorted(frag, np.arange(fragments + 1))


_QUESTIONS = pa.schema([("fragment", pa.int32()), ("slice", pa.int64()), ("data", pa.binary())])


def _ask(fragments: int):
    """Numbered documents -> a slice's questions, packed by fragment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _sliced(batches):
            s = Slice(*column_bytes(b, 3))
            of_words, of_pairs = s.counts(np.asarray(b.column(2)))
            a, z = _edges(s.words, fragments), _edges(s.pairs, fragments)
            for f in range(fragments):
                w, p = slice(a[f], a[f + 1]), slice(z[f], z[f + 1])
                if w.start == w.stop and p.start == p.stop:
                    continue
                data = pack(_gaps(s.words[w]), *(c[w] for c in of_words), _gaps(s.pairs[p]), *(c[p] for c in of_pairs))
                yield pa.record_batch([pa.array([f], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], schema=_QUESTIONS)
    return run


_ANSWERS = pa.schema([("fragment", pa.int32()), ("slice", pa.int64()), ("data", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
                      ("n_good", pa.int64())])


def _added(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parts of (gaps of keys, counts...) -> (place of each part's keys among all, total counts by place)."""
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    found, place = np.unique(keys, return_inverse=True)
    # sums in doubles are exact up to 2^53 tokens
    totals = [np.bincount(place, np.concatenate([p[k] for p in parts]), len(found)).astype(np.uint64) for k in range(1, len(parts[0]))]
    return place, totals


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions sorted by fragment -> answers to each slice; a fragment's totals stand in its first answer."""
    def answered(f, held):
        words, of_words = _added([h[1][:5] for h in held])
        pairs, of_pairs = _added([h[1][5:] for h in held])
        facts = [int((of_words[0] > 0).sum()), int(of_words[0].sum()), int(of_words[1].sum())]
        w = p = 0
        for number, x in held:
            a, z = words[w:w + len(x[0])], pairs[p:p + len(x[5])]
            w, p = w + len(a), p + len(z)
            data = pack(*(t[a] for t in of_words), *(t[z] for t in of_pairs))
            yield pa.record_batch([pa.array([v], t.type) for v, t in zip((f, number, data, *facts), _ANSWERS, strict=True)], schema=_ANSWERS)
            facts = [0, 0, 0]

    now, held = None, []
    for b in batches:
        for f, number, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if f != now and held:
                yield from answered(now, held)
                held = []
            now = f
            held.append((number, unpack(data)))
    if held:
        yield from answered(now, held)


def _tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered documents -> the rows with their slice and place, as ``_ask`` cut them."""
    for number, b in _sliced(batches):
        yield pa.record_batch([pa.array(np.full(b.num_rows, number)), pa.array(np.arange(b.num_rows, dtype=np.int32)), b.column(1), b.column(3)],
                              names=["slice", "place", "doc_id", "text"])


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])


def _score(n_all: float, n_good: float, size: int):
    """Answers and documents sorted by slice, answers first -> losses of the documents."""
    scale = n_good / n_all if n_good and n_all else 1.0

    def losses(count, of_word, of_context, total, by):
        one = (of_word * by + 1.0) / (total + size)
        return -np.log((count * by + PRIOR * one) / (of_context * by + PRIOR))

    def scored(answers, rows):
        b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        s = Slice(*column_bytes(b, 1))
        known = [np.concatenate(x).astype(np.float64) for x in zip(*(unpack(a) for a in answers), strict=True)] if answers else [np.zeros(0)] * 6
        if len(known[0]) != len(s.words) or len(known[4]) != len(s.pairs):
            raise RuntimeError("a slice was cut differently when it asked")
        n = np.bincount(s.row, minlength=b.num_rows)
        means = []
        for k, (total, by) in enumerate(((n_all * scale, scale), (n_good, 1.0))):  # columns: n, good
            loss = losses(known[4 + k][s.pair], known[k][s.word], known[2 + k][s.context], total, by)
            means.append(np.bincount(s.row, loss, b.num_rows) / np.maximum(n, 1))
        return pa.record_batch([b.column(0), pa.array(n), pa.array(means[1], mask=n == 0), pa.array(means[0], mask=n == 0)], schema=_SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, rows = None, [], []
        for b in batches:
            number, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
            cuts = np.flatnonzero(np.diff(number)) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if at == end:
                    continue
                if number[at] != now:
                    if rows:
                        yield scored(answers, rows)
                    now, answers, rows = number[at], [], []
                docs = at + int(np.searchsorted(kind[at:end], 1))
                answers += b.column(3).slice(at, docs - at).to_pylist()
                if docs < end:
                    part = b.slice(docs, end - docs)
                    rows.append(pa.record_batch([part.column(4), part.column(5)], names=["doc_id", "text"]))
        if rows:
            yield scored(answers, rows)
    return run


# ---------------------------------------------------------------- operator


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Losses per token of all documents under both models and their difference.

    ``docs``: ``doc_id``, ``text``; ``target``: ``doc_id`` of the documents that
    the target model learns from (null ids are never in it).  One row per input
    row: ``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss``, ``score``
    (the first less the second; lower is nearer to the target).  A text without
    words has null losses.  Without target tokens the target model is uniform over
    the vocabulary.  Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    ids = bounded_broadcast(target.select(F.col("doc_id").alias("__t")).where("__t is not null").distinct())
    flagged = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__t"), "left")
    rows = stored(flagged.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long").alias("doc_id"),
                                 F.col("__t").isNotNull().alias("good"), "text"), "lm-documents")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    fragments = partitions_for(size, FRAGMENT_BYTES, cores)
    asked = rows.mapInArrow(tidy(_ask(fragments)), "fragment int, slice long, data binary")
    answers = asked.repartition(fragments, "fragment").sortWithinPartitions("fragment", "slice") \
        .mapInArrow(tidy(_answer), "fragment int, slice long, data binary, n_words long, n_tokens long, n_good long")
    answers = stored(answers, "lm-answers")
    got = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_good")]).first()
    known = answers.select("slice", F.lit(0).alias("kind"), F.col("fragment").alias("place"), "data",
                           F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    said = rows.mapInArrow(tidy(_tag), "slice long, place int, doc_id long, text string") \
        .select("slice", F.lit(1).alias("kind"), "place", F.lit(None).cast("binary").alias("data"), "doc_id", "text")
    met = known.unionByName(said).repartition(partitions_for(size, SLICE_BYTES, cores), "slice").sortWithinPartitions("slice", "kind", "place")
    scored = met.mapInArrow(tidy(_score(float(got["n_tokens"]), float(got["n_good"]), max(1, got["n_words"]))),
                            "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
