"""Decontamination: planted copies, and the alignment against a plain dynamic program."""

import random

import numpy as np

from tests.conftest import SF001
from vigil.llm import decontam


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return h.max() / (decontam.MATCH * len(a)) if len(a) else 0.0


def test_alignment_matches_plain_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(0, 40))
        assert decontam.align(a.astype(np.uint64), b.astype(np.uint64))[0] == (plain_score(a, b) if len(b) else 0.0)


def _corpus():
    rng = random.Random(8)
    vocab = ["the", "of", "and", "to"] * 20 + [f"w{i}" for i in range(800)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.randint(12, 60))) for i in range(20)]
    docs, truth = [], set()
    for k in range(300):
        w = say(rng.randint(20, 400))
        if k % 5 == 0:
            i, q = rng.choice(items)
            copy = list(q)
            if k % 10 == 0:  # edited: a word in seven changed, one dropped, one added
                for p in range(3, len(copy), 7):
                    copy[p] = rng.choice(vocab)
                del copy[len(copy) // 2]
                copy.insert(len(copy) // 3, "extra")
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," if k % 3 == 0 else x for x in copy]
            truth.add((k, i))
        docs.append((k, " ".join(w)))
    return [(i, " ".join(q)) for i, q in items], docs, truth


def test_finds_exact_and_edited_copies_and_nothing_else(spark, monkeypatch):
    items, docs, truth = _corpus()
    docs += [(1000 + i, items[0][1]) for i in range(500)]  # one item leaked very often
    truth |= {(1000 + i, items[0][0]) for i in range(500)}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    for bound in (200_000, 10):  # candidates broadcast, and joined by a shuffle
        monkeypatch.setattr(decontam, "DEFAULT_MAX_BROADCAST_ROWS", bound)
        monkeypatch.setattr(decontam, "ITEMS_PER_ROW", 500 if bound > 10 else 1)
        got = {(r["doc_id"], h["item_id"]) for r in decontam.decontaminate(d, b).collect() for h in r["hits"]}
        assert got == truth


def test_given_tables_catch_every_whole_copy(spark):
    from vigil.llm.queries import QUERIES
    items = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontaminate"](spark, SF001).collect()}
    whole = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    assert whole <= got
    assert len(got) <= 2 * max(1, len(whole))


def test_nulls_and_empties(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "alpha beta gamma delta épsilon zeta eta theta")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 7), (None, "", 7), (3, "x Alpha beta GAMMA delta Épsilon zeta eta theta y", 7), (4, "one two", 7)],
                                 "doc_id long, text string, hits long")
    out = decontam.decontaminate(docs, items).collect()
    hits = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in out}
    assert hits == {1: [], None: [], 3: [None], 4: [3]}  # a short item counts where it is the whole text
    assert decontam.decontaminate(docs, items.limit(0)).count() == 4
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


def test_edited_copies_are_found_however_many_documents_hold_them(spark):
    """Two items, edited at every 4th or 5th word; one of them by two editors, of whom one's copy is far more common."""
    rng = random.Random(5)
    items = [(i, [f"q{i}x{j}" for j in range(40)]) for i in range(2)]

    def edited(item, step, first=2):
        return [f"e{rng.randint(0, 10 ** 9)}" if p % step == first else w for p, w in enumerate(items[item][1])]

    b = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    for step in (4, 5):
        for n in (9, 100, 5000):
            one, other, rare = edited(0, step), edited(1, step), edited(1, step, 0)
            docs = [(k, k % 2, " ".join([f"a{k}", *(other if k % 2 else one), f"z{k}"])) for k in range(2 * n)]
            docs += [(2 * n + k, 1, " ".join(rare)) for k in range(9)]
            docs += [(2 * n + 9, None, " ".join(f"c{j}" for j in range(60)))]
            d = spark.createDataFrame(docs, "doc_id long, item long, text string").repartition(4)
            for r in decontam.decontaminate(d, b).collect():
                assert [h["item_id"] for h in r["hits"]] == ([] if r["item"] is None else [r["item"]])


def edited(rng, words, share):
    """A copy with about ``share`` of its words replaced, dropped, swapped, or with words put in."""
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
            continue
        kind = rng.choice(["replace", "drop", "swap", "insert"])
        if kind == "replace":
            out.append(f"new{rng.randint(0, 999)}")
        elif kind == "swap" and out:
            out.insert(len(out) - 1, w)
        elif kind == "insert":
            out += [w, f"more{rng.randint(0, 999)}"]
    return out


def test_recall_against_full_alignment_by_score(spark):
    """Every edited copy that a full alignment scores at the limit or above is found, and no other."""
    rng = random.Random(21)
    vocab = ["the", "of", "and", "to", "in", "a"] * 6 + [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(3, 60))]) for i in range(40)]
    docs = []
    for k in range(500):
        i, q = rng.choice(items)
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(body))
        body[at:at] = edited(rng, q, rng.choice([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]))
        docs.append((k, body))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    got = {(r["doc_id"], h["item_id"]): h["score"] for r in decontam.decontaminate(d, b).collect() for h in r["hits"]}
    number = {w: n for n, w in enumerate({w for _, q in [*items, *docs] for w in q})}
    code = lambda q: np.array([number[w] for w in q], np.uint64)
    full = {(k, i): decontam.align(code(q), code(w))[0] for k, w in docs for i, q in items}
    want = {pair: s for pair, s in full.items() if s >= decontam.MIN_SCORE}
    for low in (0.5, 0.6, 0.7, 0.8, 0.9):
        band = [p for p, s in want.items() if low <= s < low + 0.1 or s == low + 0.1 == 1.0]
        print(f"score from {low}: {len(band)} copies, found {sum(p in got for p in band)}")
    assert got == want


def test_words_put_in_or_replaced_throughout(spark):
    """A word put in after every second one (score 0.76), after every one (0.51), and every third one replaced (0.51)."""
    q = [f"q{j}" for j in range(40)]
    second = [x for j, w in enumerate(q) for x in ([w, f"x{j}"] if j % 2 else [w])]
    each = [x for j, w in enumerate(q) for x in (w, f"y{j}")]
    third = [f"z{j}" if j % 3 == 2 else w for j, w in enumerate(q[:39])]
    docs = [(1, second), (2, each), (3, [*third, "end"]), (4, [w for j, w in enumerate(q) if j % 4 == 0])]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(q)), (8, " ".join(q[:39]))], "item_id long, text string")
    got = {r["doc_id"]: {h["item_id"]: round(h["score"], 2) for h in r["hits"]} for r in decontam.decontaminate(d, b).collect()}
    assert got[1][7] == 0.76 and got[2][7] == 0.51 and got[3][8] == 0.51 and got[4] == {}
