"""BPE encoding and decoding with a public vocabulary file (BPE with word ends).

``encode`` turns a text column into token ids, ``decode`` ids into text, equal
to what the ``tokenizers`` library gives for the file (``add_special_tokens``
off, special tokens kept on decoding).  The library itself is not used.

Method.  A text is cut at special tokens, normalised (NFC, lower case) and split
into words; words are merged as contiguous rank arrays.  A short word holds the
ids of its parts and, beside them, the rank of every two adjacent parts.  The
least rank is sought, its right boundary deleted, and the ranks of the two
neighbours looked up anew, until no adjacent parts have a rank.  All new short
words of a piece of text do this together as rows of one matrix.  Words over
``SHORT`` bytes, for which repeated scans would cost the square of their
length, take the same merges in the same order from a heap.

Texts of any length are worked off in pieces of about ``PIECE`` characters that
end before a space, where no word, special token or composition can straddle.
Words that were met are kept in a table per task, emptied when it is full.

A null text counts as empty and has no ids; empty ids decode to the empty text.
Ids are bytes: unsigned 32-bit integers, little-endian (``id_array`` unpacks
them).  Invalid UTF-8 is read with replacement characters.  NFC is that of the
Python version's Unicode tables (15.1 for Python 3.13); classes and lower case
follow Unicode 16.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Longest word in bytes that is merged by scans of its rank array.
SHORT = 64
#: Characters of text that are split and merged together.
PIECE = 1 << 19
#: Words that a task remembers; the table is emptied when it grows beyond.
REMEMBERED = 300_000
NO_RANK = np.int32(2**31 - 1)

# Fixed values of the Unicode standard: letters and numbers that version 16 added, and the
# capitals without a lower case in older tables, as (first, last, distance to the lower case).
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
               (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
               (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
               (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
               (0x1E5F1, 0x1E5FA)]
NEW_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
                (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
#: White space of Unicode, for ``\s`` of the file's pattern.
SPACES = "\\t-\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


# ---------------------------------------------------------------- vocabulary


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    at = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(odd)}
    return [chr(at[b]) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What tasks need of a vocabulary file, as plain arrays and lists (about 3 MB for 49,000 tokens).

    Raises ValueError for a file of another kind than BPE over bytes with a word-end suffix.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = spec["pre_tokenizer"].get("pretokenizers", [])
    known = (model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
             and steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
             and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
             and spec["decoder"] is None and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]))
    if not known:
        raise ValueError(f"not a BPE vocabulary with word ends that this operator reads: {path}")
    suffix, letters = model["end_of_word_suffix"] or "", byte_letters()
    pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
    key, made = left << 32 | right, np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(key, kind="stable")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
    for t, i in [*vocab.items(), *special.items()]:
        tokens[i] = t
    return {"pattern": cuts[0]["pattern"]["Regex"], "special": special, "tokens": tokens,
            "inner": np.array([vocab[c] for c in letters], np.int32), "last": np.array([vocab[c + suffix] for c in letters], np.int32),
            "key": key[order], "rank": order.astype(np.int32), "made": made[order]}


# ---------------------------------------------------------------- words of a text


@functools.cache
def _classes() -> tuple[str, str]:
    """The letters and the numbers of Unicode as the inside of a character class."""
    runs: dict[str, list[list[int]]] = {"L": [list(r) for r in NEW_LETTERS], "N": [list(r) for r in NEW_NUMBERS]}
    for cp in range(sys.maxunicode + 1):
        kind = runs.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            if kind[-1][1] == cp - 1:
                kind[-1][1] = cp
            else:
                kind.append([cp, cp])
    return tuple("".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in sorted(runs[k])) for k in "LN")  # type: ignore[return-value]


@functools.cache
def _splitter(pattern: str):
    letters, numbers = _classes()
    return re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", SPACES))


@functools.cache
def _new_capitals():
    table = {c: c + by for a, b, by in NEW_CAPITALS for c in range(a, b + 1)}
    return re.compile("[" + "".join(map(chr, table)) + "]"), table


def normalised(text: str) -> str:
    """NFC, then the lower case of each character for itself (no final sigma)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    capitals, table = _new_capitals()
    if capitals.search(text):
        text = text.translate(table)
    return text.replace("Σ", "σ").lower()


def pieces(text: str, size: int = PIECE):
    """A text in pieces of at least ``size`` characters that end before a space."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


# ---------------------------------------------------------------- merges


def _lookup(v: dict, left, right):
    """Rank of each two adjacent parts (``NO_RANK`` if they don't merge) and the id they make."""
    want = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(v["key"], want), len(v["key"]) - 1)
    hit = v["key"][at] == want
    return np.where(hit, v["rank"][at], NO_RANK), np.where(hit, v["made"][at], -1)


def _merge_short(parts: np.ndarray, size: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """Merges words of one matrix, a row each: (ids, number of ids).  ``parts`` beyond ``size`` is -1."""
    n, width = parts.shape
    out, left = parts.copy(), size.copy()
    ranks = np.full((n, width), NO_RANK, np.int32)
    made = np.full((n, width), -1, np.int32)
    ranks[:, :-1], made[:, :-1] = _lookup(v, parts[:, :-1], parts[:, 1:])
    row, cols = np.arange(n), np.arange(width)
    while len(row):
        j = ranks.argmin(axis=1)
        at = np.arange(len(row))
        live = ranks[at, j] != NO_RANK
        if not live.all():
            out[row[~live]], left[row[~live]] = parts[~live], size[~live]
            parts, ranks, made, size, row, j = parts[live], ranks[live], made[live], size[live], row[live], j[live]
            if not len(row):
                break
            at = np.arange(len(row))
        new = made[at, j]
        take = np.minimum(cols + (cols > j[:, None]), width - 1)  # the boundary after part j goes
        parts, ranks, made = (np.take_along_axis(x, take, 1) for x in (parts, ranks, made))
        parts[:, -1], ranks[:, -1], made[:, -1] = -1, NO_RANK, -1
        parts[at, j] = new
        size = size - 1
        ranks[at, j], made[at, j] = _lookup(v, new, parts[at, np.minimum(j + 1, width - 1)])
        before = j > 0
        at, j, new = at[before], j[before], new[before]
        ranks[at, j - 1], made[at, j - 1] = _lookup(v, parts[at, j - 1], new)
    return out, left


def _merge_long(parts: np.ndarray, v: dict) -> np.ndarray:
    """Merges one long word: least rank first, leftmost of equal ranks, from a heap over linked parts."""
    ids, n = parts.tolist(), len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    key, rank, made = v["key"], v["rank"], v["made"]

    def pair(i):
        j = after[i]
        if j >= n:
            return None
        want = ids[i] << 32 | ids[j]
        at = int(np.searchsorted(key, want))
        return (int(rank[at]), i, ids[i], ids[j], int(made[at])) if at < len(key) and int(key[at]) == want else None

    first, made0 = _lookup(v, parts[:-1], parts[1:])
    heap = [(int(first[i]), int(i), ids[i], ids[i + 1], int(made0[i])) for i in np.flatnonzero(first != NO_RANK)]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0 and (found := pair(k)):
                heapq.heappush(heap, found)
    return np.array([x for x in ids if x >= 0], np.int32)


def merge_words(words: list[str], v: dict) -> list[bytes]:
    """Packed ids of each word."""
    raw = [w.encode("utf-8") for w in words]
    length = np.array([len(r) for r in raw], np.int64)
    found: list[bytes] = [b""] * len(raw)
    low = 0
    for high in (4, 8, 12, 16, 24, 32, 48, SHORT):
        who = np.flatnonzero((length > low) & (length <= high))
        low = high
        for some in np.array_split(who, max(1, -(-len(who) // 20_000))):
            if not len(some):
                continue
            size = length[some]
            box = np.frombuffer(b"".join(raw[i].ljust(high, b"\0") for i in some), np.uint8).reshape(len(some), high)
            parts = np.where(np.arange(high) < size[:, None], v["inner"][box], -1)
            parts[np.arange(len(some)), size - 1] = v["last"][box[np.arange(len(some)), size - 1]]
            ids, n = _merge_short(parts, size, v)
            flat = np.ascontiguousarray(ids[np.arange(high) < n[:, None]].astype("<u4")).tobytes()
            ends = 4 * np.cumsum(n)
            for i, a, b in zip(some.tolist(), (ends - 4 * n).tolist(), ends.tolist(), strict=True):
                found[i] = flat[a:b]
    for i in np.flatnonzero(length > SHORT):
        box = np.frombuffer(raw[i], np.uint8)
        parts = v["inner"][box]
        parts[-1] = v["last"][box[-1]]
        found[i] = _merge_long(parts, v).astype("<u4").tobytes()
    return found


# ---------------------------------------------------------------- columns


class _Encoder:
    """A task's encoder: the vocabulary and the words it has met."""

    def __init__(self, v: dict):
        self.v, self.met = v, {}
        self.split = _splitter(v["pattern"]).findall
        special = sorted(v["special"], key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in v["special"].items()}

    def runs(self, text: str):
        """The text between special tokens, and those, in order: (is special, text)."""
        if self.marks is None:
            return [(False, text)]
        return [(i % 2 == 1, x) for i, x in enumerate(self.marks.split(text)) if x]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, todo, held = [bytearray() for _ in texts], [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text):
                todo += [(i, x if mark else self.split(normalised(x)), mark) for mark, x in self.runs(piece)]
                held += len(piece)
                if held >= PIECE:
                    self._flush(todo, out)
                    todo, held = [], 0
        self._flush(todo, out)
        return [bytes(o) for o in out]

    def _flush(self, todo, out) -> None:
        if len(self.met) > REMEMBERED:
            self.met.clear()
        new = list(set().union(*(w for _, w, mark in todo if not mark)) - self.met.keys())
        self.met.update(zip(new, merge_words(new, self.v), strict=True))
        get = self.met.__getitem__
        for i, found, mark in todo:
            out[i] += self.special[found] if mark else b"".join(map(get, found))


def _values(array, limit: int = 4 << 20):
    """Bytes of an Arrow text or binary column (null: empty) in lists of up to ``limit`` bytes, one value at least."""
    held, size = [], 0
    for x in array:
        x = x.as_buffer()
        x = b"" if x is None else x.to_pybytes()
        if held and size + len(x) > limit:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def vocabulary(spark: SparkSession, path: str):
    """Broadcast vocabulary of a file that the driver can read (bounded by the file, whatever the corpus)."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(text: Column, vocab) -> Column:
    """Packed token ids of a text column; ``vocab`` is from ``vocabulary``."""
    from vigil.llm.common import release_memory

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _Encoder(vocab.value)
        try:
            for batch in batches:
                done = []
                for some in _values(batch):
                    done += enc([x.decode("utf-8", "replace") for x in some])
                yield pa.array(done, pa.binary())
        finally:
            enc.met.clear()
            release_memory()

    return ids(text)


def decode(ids: Column, vocab) -> Column:
    """Text of packed token ids: tokens with a space between, special ones included.  Ids beyond the vocabulary are left out."""
    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = vocab.value["tokens"]
        for batch in batches:
            done = []
            for some in _values(batch):
                for x in some:
                    got = np.frombuffer(x, "<u4")
                    if len(got) and got.max() >= len(tokens):
                        got = got[got < len(tokens)]
                    done.append(" ".join(map(tokens.__getitem__, got.tolist())))
            yield pa.array(done, pa.string())

    return text(ids)


def id_array(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    @F.arrow_udf("array<bigint>")
    def unpacked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = [np.frombuffer(x, "<u4") for some in _values(batch) for x in some]
            ends = np.cumsum([0, *map(len, flat)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, "<u4")]).astype(np.int64)))

    return unpacked(ids)
