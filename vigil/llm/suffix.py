"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``min_len`` bytes that covers it starts earlier too
(in a smaller document, or earlier in its own).

All suffixes of a corpus are too many to sort together, so the work is cut by
content.  Every window of ``min_len`` bytes holds one anchor, its ``gram``-byte
string of least hash, at a place that depends on the window's bytes alone:
equal windows share an anchor.  An anchor's context (the bytes of all windows
that may have chosen it) is compared only with the contexts of equal anchors:

1. anchors of all texts (hash of the gram, hash of the context, place) are
   shuffled by gram, after copies within a batch of texts are settled.  A context that occurred before as a whole is repeated as a
   whole; first contexts go on if their gram has another context;
2. those contexts, in blocks of whole grams, become a text of which a suffix
   array and its Burrows-Wheeler transform are built, sorted to a depth just
   over ``min_len``.  Breadth-first backward extension of intervals sets the
   longest common prefixes by increasing value and stops at ``min_len``: what it
   has not set by then is at least that long, so neighbours there share a window;
3. repeated windows become byte ranges per document, joined to the texts.

The texts are shuffled once (both joins use the same exchange).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import K1, NULL_ID, byte_slices, column_bytes, prepare_python, stored, tidy, with_ordinal
from vigil.llm.hashes import PIECE, Poly, mix

#: Length of an anchor's string; shorter ones are fewer but more often equal by chance.
GRAM = 32
#: Bytes of contexts whose suffixes are sorted together (more if one gram has more).
BLOCK = 1 << 20
#: Occurrences of a gram beyond which its windows are compared by their own hashes, spread over all tasks.
HOT_GRAM = 200_000

_GRAMS, _CONTEXTS = Poly(0xA11CE), Poly(0xB0B)


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, m = 1, v
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    more = width - span
    return np.minimum(m[:len(m) - more], m[more:]) if more else m


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, row, offset) of every anchor of a batch of texts.

    Ties go to the leftmost gram of a window.  Texts shorter than ``min_len`` have none.
    """
    full = np.flatnonzero(ends - starts >= min_len)
    outs: list[tuple] = []
    reach = min_len - gram  # a window's anchor begins up to so far after the window
    if not len(full):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    s, e = starts[full], ends[full]
    low = np.uint64((1 << 21) - 1)
    at, stop = int(s[0]), int(e[-1])
    while at < stop:
        # windows that begin in [at, to); bytes up to the last window's end, and a context's width before
        to = min(stop, at + PIECE)
        lo, hi = max(int(s[0]), at - reach), min(stop, to + min_len + reach)
        part = buf[lo:hi]
        sums = _GRAMS.sums(part)
        n = len(part) - gram + 1
        if n >= reach + 1:
            h = (sums[gram:] - sums[:-gram]) * _GRAMS.down[:n]
            v = (h & ~low) | np.arange(n, dtype=np.uint64)
            place = (_slide_min(v, reach + 1) & low).astype(np.int64)
            begin = np.arange(at - lo, min(to - lo, len(place)))
            row = np.searchsorted(s, begin + lo, "right") - 1
            inside = (row >= 0) & (begin + lo + min_len <= e[row])
            chosen, owner = place[begin[inside]], row[inside]
            if len(chosen):
                new = np.ones(len(chosen), bool)
                new[1:] = chosen[1:] != chosen[:-1]
                chosen, owner = chosen[new], owner[new]
                a = np.maximum(chosen + lo - reach, s[owner])
                z = np.minimum(chosen + lo + gram + reach, e[owner])
                context = _CONTEXTS.sums(part)
                c = _CONTEXTS.of(context, a - lo, z - lo) + (chosen + lo - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                outs.append((mix(h[chosen]), mix(c + (z - a).astype(np.uint64)), full[owner], chosen + lo - s[owner]))
        at = to
    if not outs:
        return anchors(buf, starts[:0], ends[:0], min_len, gram)
    h, c, row, off = (np.concatenate(x) for x in zip(*outs, strict=True))
    # a piece's first anchor may be the last one of the piece before
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (off[1:] != off[:-1])
    return h[new], c[new], row[new], off[new]


def suffix_array(sym: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols at least (prefix doubling; symbols below 512)."""
    n = len(sym)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([sym.astype(np.int64), np.zeros(7, np.int64)])
    for k in range(7):
        key = (key << 9) | padded[k:n + k]
    done = 7
    while True:
        order = np.argsort(key)  # equal keys get one rank, so their order is free
        k = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = k[1:] != k[:-1]
        rank = np.cumsum(new)
        if done >= depth or rank[-1] == n - 1:
            return order
        by_place = np.empty(n, np.int64)
        by_place[order] = rank + 1
        nxt = np.zeros(n, np.int64)
        nxt[:n - done] = by_place[done:]
        key = by_place * (n + 1) + nxt
        done *= 2


def common_prefixes_below(sym: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each neighbouring pair in ``order`` whether their common prefix is shorter than ``limit``.

    Entry j speaks of suffixes j-1 and j.  Intervals of the suffix array are
    extended backward over the Burrows-Wheeler transform, all intervals of one
    string length at a time.  The interval of ``c + w`` ends where the prefix of
    length ``|w| + 1`` changes; an end seen for the first time at that length is
    a common prefix of exactly ``|w|``.  An end already known is not followed.
    Symbol 0 separates texts and is never extended over, so pairs whose common
    prefix holds a separator are not told apart (callers skip such suffixes).
    """
    n = len(sym)
    bwt = sym[order - 1]  # order 0 takes the last symbol, a separator
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    change = np.ones(n, bool)
    change[1:] = bwt[1:] != bwt[:-1]
    run_start = np.flatnonzero(change)
    run_end = np.append(run_start[1:], n) - 1
    run = np.cumsum(change) - 1
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    left, right = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(limit):
        if not len(left):
            break
        r0, r1 = run[left], run[right]
        one = r0 == r1
        a, z, c = [lf[left[one]]], [lf[right[one]]], [bwt[left[one]]]
        if not one.all():
            lo, hi, r0, r1 = left[~one], right[~one], r0[~one], r1[~one]
            count = r1 - r0 + 1
            which = np.repeat(np.arange(len(lo)), count)
            runs = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + r0[which]
            first, last = np.maximum(run_start[runs], lo[which]), np.minimum(run_end[runs], hi[which])
            s = bwt[first].astype(np.int64)
            by = np.argsort(which * 512 + s, kind="stable")
            key = (which * 512 + s)[by]
            edge = np.ones(len(by), bool)
            edge[1:] = key[1:] != key[:-1]
            tail = np.append(np.flatnonzero(edge)[1:], len(by)) - 1
            a.append(lf[first[by[edge]]])
            z.append(lf[last[by[tail]]])
            c.append(s[by[edge]])
        a, z, c = np.concatenate(a), np.concatenate(z), np.concatenate(c)
        go = (c != 0) & ~known[z + 1]
        a, z = a[go], z[go]
        known[z + 1] = True
        left, right = a, z
    return known[:n]


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of every window of ``min_len`` bytes in ``texts`` that also starts at a smaller place.

    A text's place is ``(doc, start)``, comparable numbers; a window's is
    ``(doc, start + offset)``.  Windows at one and the same place do not count.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    flat[begin + sizes] = 0
    order = suffix_array(flat, min_len)
    differ = common_prefixes_below(flat, order, min_len)
    text = np.searchsorted(begin, order, "right") - 1
    offset = order - begin[text]
    valid = offset + min_len <= sizes[text]
    cut = differ | ~valid
    cut[1:] |= ~valid[:-1]
    group = np.cumsum(cut)[valid]
    text, offset = text[valid], offset[valid]
    d, p = doc[text], start[text] + offset
    by = np.lexsort((p, d, group))
    g = group[by]
    head = np.ones(len(by), bool)
    head[1:] = g[1:] != g[:-1]
    lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    later = (d[by] != d[lead]) | (p[by] != p[lead])
    return text[by[later]], offset[by[later]]


def _settled(h: np.ndarray, c: np.ndarray, k: np.ndarray, o: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Anchors whose whole context another anchor of the same batch has at a smaller place."""
    out = np.zeros(len(h), bool)
    key = mix(c) ^ h
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    many = np.zeros(len(h), bool)
    many[by[1:]] |= same
    many[by[:-1]] |= same
    at = np.flatnonzero(many)
    if len(at):
        at = at[np.lexsort((off[at], o[at], k[at], c[at], h[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (h[at][1:] != h[at][:-1]) | (c[at][1:] != c[at][:-1])
        lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        out[at] = (k[at] != k[lead]) | (o[at] != o[lead]) | (off[at] != off[lead])
    return out


def _anchor_rows(min_len: int, gram: int):
    """Texts -> anchors; those settled within the batch leave as byte ranges instead (``z`` is their end)."""
    reach = min_len - gram
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("k", pa.int64()), ("o", pa.int32()), ("off", pa.int64()), ("z", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in byte_slices(whole, 2, 32 << 20)):
            buf, starts, ends = column_bytes(b, 2)
            h, c, row, off = anchors(buf, starts, ends, min_len, gram)
            k, o = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row].astype(np.int64)
            done = _settled(h, c, k, o, off)
            # a settled anchor's context reaches from off - reach to off + gram + reach
            r = _ranges((k[done], o[done]), off[done] - reach, gram + 2 * reach) if done.any() else None
            h, c, k, o, off = (x[~done] for x in (h, c, k, o, off))
            for i in range(0, max(len(h), 1), 1 << 18):
                j = slice(i, i + (1 << 18))
                yield pa.record_batch([pa.array(h[j].view(np.int64)), pa.array(c[j].view(np.int64)), pa.array(k[j]),
                                       pa.array(o[j].astype(np.int32)), pa.array(off[j]), pa.nulls(len(h[j]), pa.int64())], schema=schema)
            if r is not None:
                # spread by a hash of their own; they take no part in any gram
                spread = mix(r["k"].to_numpy().view(np.uint64) ^ mix(r["a"].to_numpy().view(np.uint64))).view(np.int64)
                yield pa.record_batch([pa.array(spread), pa.nulls(len(r), pa.int64()), pa.array(r["k"]),
                                       pa.array(r["o"].to_numpy().astype(np.int32)), pa.array(r["a"]), pa.array(r["z"])], schema=schema)

    return run


def _context_rows(min_len: int, gram: int, hot: bool):
    """Texts with wanted anchors -> (h, k, o, start, context); with ``hot`` every window instead, as its 128-bit hash (h, w)."""
    reach = min_len - gram
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("k", pa.int64()), ("o", pa.int32()), ("start", pa.int64()),
                        ("left", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, o = b.column("k").to_numpy(), b.column("o").to_numpy()
            texts, want = b.column("t"), b.column("want")
            out: list[tuple] = []
            for i in range(b.num_rows):
                t = texts[i].as_py()
                for x in want[i].as_py():
                    a, z = max(0, x["off"] - reach), min(len(t), x["off"] + gram + reach)
                    if hot:
                        for p in range(a, z - min_len + 1):
                            d = hashlib.blake2b(t[p:p + min_len], digest_size=16).digest()
                            out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                                        k[i], o[i], p, None, None))
                    else:
                        out.append((x["h"], None, k[i], o[i], a, x["off"] - a, t[a:z]))
                    if len(out) >= 20_000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _ranges(doc, off: np.ndarray, min_len: int) -> pd.DataFrame:
    """Window starts of (key, ordinal) documents -> merged byte ranges."""
    k, o = doc
    by = np.lexsort((off, o, k))
    k, o, off = k[by], o[by], off[by]
    new = np.ones(len(off), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (off[1:] > off[:-1] + min_len)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(off)) - 1
    return pd.DataFrame({"k": k[first], "o": o[first], "a": off[first], "z": off[last] + min_len})


def _can_repeat(pdf: pd.DataFrame, min_len: int, gram: int) -> np.ndarray:
    """Contexts that share, beside the gram, the half before or the half after it with another of the same gram.

    A window has at least half of the bytes besides its gram on one side of
    it, so equal windows share one of the two halves; the other contexts, whose
    gram is equal by chance, need no suffix array.
    """
    half = (min_len - gram) // 2
    times: dict[tuple, int] = {}
    sides = []
    for h, left, context in zip(pdf["h"].to_numpy().tolist(), pdf["left"].to_numpy().tolist(), pdf["context"], strict=True):
        a = (h, 0, context[left - half:left]) if left >= half else None
        b = (h, 1, context[left + gram:left + gram + half]) if len(context) >= left + gram + half else None
        sides.append((a, b))
        for key in (a, b):
            if key is not None:
                times[key] = times.get(key, 0) + 1
    return np.array([times.get(a, 0) > 1 or times.get(b, 0) > 1 for a, b in sides], bool)


def _block_rows(min_len: int, gram: int, block: int):
    """Contexts sorted by gram -> byte ranges of repeated windows, block by block of whole grams."""

    def solve(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True)
        k, o = pdf["k"].to_numpy(np.int64), pdf["o"].to_numpy(np.int64)
        start = pdf["start"].to_numpy(np.int64)
        by = np.lexsort((o, k))
        kk, oo = k[by], o[by]
        rank = np.zeros(len(by), np.int64)
        rank[by] = np.concatenate([[0], np.cumsum((kk[1:] != kk[:-1]) | (oo[1:] != oo[:-1]))])
        text, offset = repeated_windows(list(pdf["context"]), rank, start, min_len)
        if len(text):
            yield _ranges((k[text], o[text]), start[text] + offset, min_len)

    def whole_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows again, cut only between grams, in parts of at least ``block`` bytes."""
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            h = pdf["h"].to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and len(h) and held[-1]["h"].iloc[-1] != h[0]:
                cuts = np.append(0, cuts)
            total = np.cumsum(pdf["context"].map(len).to_numpy())
            at = 0
            for cut in cuts:
                if size + (total[cut - 1] if cut else 0) - (total[at - 1] if at else 0) >= block:
                    yield pd.concat([*held, pdf.iloc[at:cut]], ignore_index=True)
                    held, size, at = [], 0, cut
            if at < len(pdf):
                held.append(pdf.iloc[at:])
                size += int(total[-1] - (total[at - 1] if at else 0))
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[pd.DataFrame] = []
        size = 0
        for pdf in whole_grams(batches):
            pdf = pdf[_can_repeat(pdf, min_len, gram)]
            if len(pdf):
                ready.append(pdf)
                size += int(pdf["context"].map(len).sum())
            if size >= block:
                yield from solve(ready)
                ready, size = [], 0
        if ready:
            yield from solve(ready)

    return run


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their byte ranges -> counts and digest of what stays."""
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for b in batches:
        texts, marks = b.column("t"), b.column("marks")
        out: list[tuple] = []
        for i, key in enumerate(b.column("k").to_pylist()):
            t = texts[i].as_py()
            got = marks[i].as_py()
            kept, removed, spans, at = [], 0, 0, 0
            end = -1
            for m in sorted((max(0, x["a"]), min(len(t), x["z"])) for x in got or ()):
                if m[1] <= m[0]:
                    continue
                if m[0] > end:
                    spans += 1
                    kept.append(t[at:m[0]])
                if m[1] > end:
                    removed += m[1] - max(m[0], end if end >= 0 else m[0])
                    end = m[1]
                at = max(at, end)
            kept.append(t[at:])
            rest = b"".join(kept)
            out.append((key, len(t), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def remove_repeats(docs: DataFrame, min_len: int = 100, gram: int = GRAM, block: int = BLOCK,
                   hot_gram: int = HOT_GRAM) -> DataFrame:
    """Texts without the bytes that repeat an earlier string of ``min_len`` bytes.

    ``docs``: ``doc_id`` (long) and ``text``; other columns are ignored.  One row
    per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept_sha256`` and ``kept`` (binary: the remaining bytes).

    A null text is empty.  A null ``doc_id`` counts as the largest; different
    texts with one id are ordered by their hash; rows equal in id and text are
    one document, which does not repeat itself, and get the same result.
    Strings are compared by content except for whole contexts (two 64-bit
    hashes) and windows of hot grams (128-bit hash).
    """
    spark = docs.sparkSession
    prepare_python(spark)
    d = with_ordinal(docs.select("doc_id", "text"))
    d = d.select(F.col(K1).alias("k"), F.col("__ord").alias("o"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"))
    rows = d.mapInArrow(tidy(_anchor_rows(min_len, gram)), "h long, c long, k long, o int, off long, z long")
    same_gram, same = Window.partitionBy("h"), Window.partitionBy("h", "c").orderBy("k", "o", "off")
    # one shuffle and one sort serve both windows
    rows = rows.repartition("h").sortWithinPartitions("h", "c", "k", "o", "off")
    seen = rows.withColumn("later", F.col("z").isNotNull() | (F.rank().over(same) > 1)) \
        .withColumn("mixed", F.min("c").over(same_gram) != F.max("c").over(same_gram)) \
        .withColumn("hot", F.count("c").over(same_gram) > hot_gram) \
        .where(F.col("later") | F.col("mixed"))
    reach = min_len - gram
    found = stored(seen.select("k", "o", "off", "z", "later", "hot", F.when(~F.col("later"), F.col("h")).alias("h")), "anchors")

    texts = d.select("k", "o", "t")

    def contexts(hot: bool) -> DataFrame:
        first = found.where(~F.col("later") & (F.col("hot") == hot))
        want = first.groupBy("k", "o").agg(F.collect_set(F.struct("off", "h")).alias("want"))
        return texts.join(want, ["k", "o"]).mapInArrow(
            tidy(_context_rows(min_len, gram, hot)), "h long, w long, k long, o int, start long, left int, context binary")

    # not stored: its join and the last one read the same exchange of the texts
    blocks = contexts(False).select("h", "k", "o", "start", "left", "context").repartition("h").sortWithinPartitions("h")
    by_block = blocks.mapInPandas(tidy(_block_rows(min_len, gram, block)), "k long, o int, a long, z long")
    whole = found.where("later").select("k", "o", F.when(F.col("z").isNull(), F.col("off") - reach).otherwise(F.col("off")).alias("a"),
                                        F.coalesce("z", F.col("off") + gram + reach).alias("z"))
    ranges = whole.unionByName(by_block)
    if found.where(~F.col("later") & F.col("hot")).limit(1).count():
        windows = stored(contexts(True).select("h", "w", "k", "o", "start"), "windows")
        least = windows.groupBy("h", "w").agg(F.min(F.struct("k", "o", "start")).alias("least"))
        ranges = ranges.unionByName(windows.join(least, ["h", "w"]).where(F.struct("k", "o", "start") != F.col("least"))
                                    .select("k", "o", F.col("start").alias("a"), (F.col("start") + min_len).alias("z")))
    marks = ranges.groupBy("k", "o").agg(F.collect_set(F.struct("a", "z")).alias("marks"))
    out = texts.join(marks, ["k", "o"], "left").select("k", "t", "marks") \
        .mapInArrow(tidy(_digest_rows), "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif(F.col("k"), F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
