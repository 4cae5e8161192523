"""Personal data: seed spans against plain regular expressions, and planted contexts for the bootstrapping."""

import hashlib
import re

from pyspark.sql import functions as F

from tests.conftest import SF001
from vigil.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [
    "a@b.c_x@d.e-f.g, q@r @s.t u@v w@x.y. z@1.2..3", "1.2.3.4.5.6.7.8 999.1.2.3.4 0001.002.3.255 1.2.3.256 1.2.3 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111-1 x4111111111111111y 5 4111111111111111", "4012888888881881 0000000000000000 123 45",
    "+1 (732) 555-3520 +49-30-1234567 ++1 2345678 +1+2 +1(((((((( +12345678901234567 +1 2 3 4 5 6 7 8 9 ", "é😀 a.b+c@mail.example.com😀 1.1.1.1",
    "x" * 20000 + "@" + "y" * 50, "9" * 20000, "1 " * 3000, None, "", "@", "+", "a@b.c" * 50, "4111111111111111 " * 40,
]


def test_seeds_match_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100 + r["doc_id"], r["text"]) for r in
                                                   spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.personal_data(df).select("doc_id", pii.span_list(F.col("base")).alias("s")).collect()}
    assert got == {k: brute(t) for k, t in rows}


def test_query_digests(spark):
    from vigil.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in QUERIES["op4_pii_bootstrap"](spark, SF001).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert r["n_email"] == want.count("email:") and r["n_phone"] == want.count("phone:")


def test_contexts_discover_unseen_identifiers(spark):
    rows = [f"hello mailto: user{i}@host{i}.org and more words here" for i in range(8)]
    rows += [f"the office dial: +1 212 555 01{i:02d} today" for i in range(8)]
    rows += ["please mailto: bob at example dot com soon", "we met bob at example dot com", "dial: 212 555 0188 now",
             "in room 212 555 0188 x", "it was 300 400 5000 of them", "she is at home.page the dot"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.personal_data(df).select(
        "doc_id", "text", "base", "extra", pii.redact(F.col("text"), F.concat("base", "extra")).alias("clean")).collect()}
    assert out[16]["clean"] == "please mailto: [email] soon"
    assert out[17]["clean"] == "we met [email]"  # the value is known by now
    assert out[18]["clean"] == "dial: [phone] now"
    assert out[20]["extra"] == [] and out[21]["extra"] == []
    assert all(out[i]["extra"] == [] and len(out[i]["base"]) == 1 for i in range(16))


def test_empty_repeated_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).collect() == []
    df = spark.createDataFrame([(None, "a@b.c", 1, "k"), (None, None, 2, None), (1, "a@b.c", 3, "x"), (1, "a@b.c", 3, "x")],
                               "doc_id long, text string, base long, kind string")
    got = pii.personal_data(df)
    assert got.columns == ["doc_id", "text", "kind", "base", "extra"] and got.count() == 4
    assert sorted(len(r["base"]) for r in got.collect()) == [0, 1, 1, 1]


def test_found_identifiers_make_patterns_of_words_without_seeds(spark):
    """A chain of four steps: seeds prove dial:, its numbers fone:, those ring:, those call:, each with numbers of its own."""
    number = lambda step, i: f"212 555 {step}{i:03d}"
    labels = ["dial:", "fone:", "ring:", "call:"]
    rows = [f"office dial: +1 {number(9, i)} s{i}" for i in range(200)]
    rows += [f"office {label} {number(step, i)} {label[0]}{step}x{i}" for k, label in enumerate(labels) for step in (k, k + 1) for i in range(10)
             for _ in range(3 if step == k else 1)]
    rows += [f"invoice {number(7, i)} paid" for i in range(10)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = pii.personal_data(df).select("text", "extra").collect()
    for r in got:
        assert len(r["extra"]) == (0 if "+1" in r["text"] or "invoice" in r["text"] else 1), r


def test_labels_that_touch_their_identifier(spark):
    rows = [f"mail:user{i}@host{i}.org s{i}" for i in range(8)] + ["mail:bob at example dot com x1"]
    rows += [f"dial:+1 212 555 01{i:02d} t{i}" for i in range(8)] + ["dial:212 555 0188. Next", "dial: 212 555 0189, x2"]
    # marks beside identifiers are no evidence where they stand beside everything
    rows += [f"met (user{i}@home{i}.org) v{i}" for i in range(4)] + [f"word{i} (other words) here, and (more)" for i in range(20)]
    rows += ["( alone", "room (300 400 5000) x3", "sue (ann at work dot com) x4"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r["text"]: [s["value"] for s in r["extra"]] for r in pii.personal_data(df).select("text", "extra").collect()}
    assert {t: x for t, x in out.items() if x} == {
        "mail:bob at example dot com x1": ["bob at example dot com"],
        "dial:212 555 0188. Next": ["212 555 0188"], "dial: 212 555 0189, x2": ["212 555 0189"]}


def test_candidates_with_much_evidence_are_found(spark):
    """One number beside k labels, each with eight seeds: found in all k documents, however sure it is."""
    for k in (1, 2, 6, 8, 12):
        names = [f"label{chr(97 + i)}:" for i in range(k)]
        rows = [f"{n} +1 212 555 {a:02d}{i:02d} s{a}x{i}" for a, n in enumerate(names) for i in range(8)]
        rows += [f"{n} 300 400 5000 t{a}" for a, n in enumerate(names)]
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = {r["doc_id"]: [s["value"] for s in r["extra"]] for r in pii.personal_data(df).select("doc_id", "extra").collect()}
        assert {i: v for i, v in got.items() if v} == {8 * k + a: ["300 400 5000"] for a in range(k)}, k


def test_contexts_of_any_length(spark):
    """A label longer than any window, and one that a long gap parts from its identifier."""
    label = "x" * 300 + ":"
    rows = [f"{label} +1 212 555 01{i:02d} a{i}" for i in range(8)] + [f"fax:{' ' * 400}+1 212 556 01{i:02d} b{i}" for i in range(8)]
    rows += [f"{label} 212 555 0188 c", f"fax:{' ' * 90}212 556 0189 d", f"{'x' * 299}: 212 557 0190 e"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["extra"]] for r in pii.personal_data(df).select("doc_id", "extra").collect()}
    assert {i: v for i, v in got.items() if v} == {16: ["212 555 0188"], 17: ["212 556 0189"]}


def test_listed_and_joined_contexts_are_counted_alike(spark):
    texts = spark.createDataFrame([("Call me: now, call ME; (me) — now",), ("now now",), (None,), ("",)], "t string")
    apt = spark.createDataFrame([("before", "me:"), ("before", "now"), ("after", "(me"), ("after", "now"), ("after", "never")], "side string, word string")
    one, two = ({(r["side"], r["word"]): r["uses"] for r in pii.unit_uses(texts, F.col("t"), apt, n).collect()} for n in (100, 1))
    assert one == two == {("before", "me:"): 1, ("before", "now"): 3, ("after", "(me"): 1, ("after", "now"): 4}


def test_hints_pass_every_match():
    """A text that the hint turns down holds no match of the pattern."""
    import random
    import re

    rng = random.Random(12)
    bits = ["bob", "a", "at", "AT", "dot", "Dot", "example", "com", "[", "]", "(", ")", "{", "}", " ", " ", ".", "@", "1", "23", "456", "+", "-", "\n"]
    for _ in range(40_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 16)))
        for kind in pii.KINDS:
            for patterns, hints in ((pii.SEEDS, pii.HINTS), (pii.CANDIDATES, pii.CANDIDATE_HINTS)):
                if "\\G" not in patterns[kind] and re.search(patterns[kind], t):
                    assert re.search(hints[kind], t), (kind, t)
                    assert kind == "email" or re.search("[0-9]", t)
