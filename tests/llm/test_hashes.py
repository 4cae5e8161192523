"""Word and shingle hashes do not depend on where a text lies or how it is cut into pieces."""

import random

import numpy as np
import pyarrow as pa

from vigil.llm import hashes
from vigil.llm.common import byte_slices, column_bytes


def batch(texts):
    return pa.record_batch([pa.array(texts, pa.string())], names=["t"])


def test_words_of_long_texts_match_plain_splitting():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcXYZé#0") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    long = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t  ", "\x0b"]) for _ in range(400_000))  # three pieces
    texts = ["", long, None, "one Two", "x" * 3_000_000 + " y", " ", "two"]
    h, row = hashes.all_words(*column_bytes(batch(texts), 0))
    plain = [(t or "").encode().lower().split() for t in texts]
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(w) for w in plain]
    seen = {}
    for value, word in zip(h.tolist(), (w for ws in plain for w in ws)):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_and_long_texts():
    texts = ["a b c d e", "a b c", "", "b c d e", "A b C", "a", "x a b c d"]
    h, row = hashes.all_words(*column_bytes(batch(texts), 0))
    s, r, at = hashes.shingles(h, row, 4)
    got = {i: set(s[r == i].tolist()) for i in range(len(texts))}
    assert [len(got[i]) for i in range(len(texts))] == [2, 1, 0, 1, 1, 1, 2]
    assert got[3] < got[0] and got[1] == got[4] and not got[1] & got[0] and len(got[6] & got[0]) == 1
    assert len(hashes.shingles(h, row, 4, short=False)[0]) == 5


def test_slices_cover_a_batch_once():
    texts = ["a" * n for n in (0, 5, 100, 1, 0, 30, 0)]
    b = batch(texts)
    for limit in (1, 10, 50, 1000):
        parts = [x for p in byte_slices(b, 0, limit) for x in p.column(0).to_pylist()]
        assert parts == texts
    assert [p.num_rows for p in byte_slices(batch([]), 0)] == [0]
    cut = b.slice(2, 3)
    buf, s, e = column_bytes(cut, 0)
    assert [bytes(buf[x:y]).decode() for x, y in zip(s, e)] == texts[2:5]
