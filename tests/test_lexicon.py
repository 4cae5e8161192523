"""Lexicon map, tokenising, stopwords, counts and ratios."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.functions.stopwords import english_stopwords
from vigil.functions.text import tokenize
from vigil.operators.lexicon import lexicon_map, lexicon_scores

LEX = [("kind", "care.virtue", 1), ("harm", "care.vice", 2), ("fair", "fairness.virtue", 3),
       ("cheat", "fairness.vice", 4), ("Kind", "care.vice", 5), ("the", "loyalty.virtue", 6),
       ("two words", "loyalty.vice", 7), ("pure", "sanctity.virtue", 8)]
TEXTS = [(1, "Kind and fair, the kind KIND harm"), (2, "nothing here"), (3, None), (4, ""),
         (5, "don't cheat\\nthe café 3x pure"), (6, "the the the")]


def python_scores(text, lex, stop=()):
    m = {}
    for t, c, _ in sorted(lex, key=lambda r: r[2]):
        m[t.lower()] = c
    toks = [t for t in re.findall(r"[a-zA-Z]+", str(text if text is not None else "nan").lower()) if t not in stop]
    cnt = Counter(m[t] for t in toks if t in m)
    return cnt, sum(cnt.values())


def test_lexicon_map_last_wins(spark):
    lex = spark.createDataFrame(LEX, "token string, category string, ordinal long")
    got = dict((r.token, r.category) for r in lexicon_map(lex).collect())
    assert got["kind"] == "care.vice" and got["two words"] == "loyalty.vice" and len(got) == 7


def test_tokenize_edges(spark):
    df = spark.createDataFrame([("Don't",), ("café",), ("3x",), ("a\\nthe",), ("UPPER",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tokenize("t")).collect()]
    assert got == [["don", "t"], ["caf"], ["x"], ["a", "nthe"], ["upper"], [], ["nan"]]


def _check(spark, stop, strategy):
    lex = spark.createDataFrame(LEX, "token string, category string, ordinal long")
    df = spark.createDataFrame(TEXTS, "id int, text string")
    out = lexicon_scores(df, lex, col="text", stopwords=stop, strategy=strategy).collect()
    cats = sorted({c for _, c, _ in LEX})
    stopset = set(english_stopwords()) if stop == "english" else set()
    for r in out:
        cnt, matched = python_scores(r.text, LEX, stopset)
        for c in cats:
            n = c.replace(".", "_")
            assert r[f"{n}_count"] == cnt.get(c, 0), (r.id, c)
            assert abs(r[f"{n}_ratio"] - cnt.get(c, 0) / max(matched, 1)) < 1e-15
        for f in ("care", "fairness", "loyalty", "sanctity"):
            tot = sum(v for k, v in cnt.items() if k.startswith(f + "."))
            assert r[f"{f}_count"] == tot
            assert abs(r[f"{f}_ratio"] - tot / max(matched, 1)) < 1e-15
        ratios = sum(r[f"{c.replace('.', '_')}_ratio"] for c in cats)
        assert abs(ratios - (1.0 if matched else 0.0)) < 1e-12
    return {r.id: r for r in out}


def test_scores_inset_and_join_agree_with_python(spark):
    a = _check(spark, None, "inset")
    b = _check(spark, None, "join")
    assert a.keys() == b.keys()
    # dense zero column: sanctity.vice is never named -> not a column; care.virtue named but empty after L1
    assert a[1]["care_virtue_count"] == 0 and a[1]["care_vice_count"] == 4


def test_stopwords_lower_counts(spark):
    with_stop = _check(spark, "english", "inset")
    without = _check(spark, None, "inset")
    assert with_stop[6]["loyalty_virtue_count"] == 0 and without[6]["loyalty_virtue_count"] == 3


def test_no_shuffle_in_inset_plan(spark):
    lex = spark.createDataFrame(LEX, "token string, category string, ordinal long")
    df = spark.createDataFrame(TEXTS, "id int, text string")
    plan = lexicon_scores(df, lex, col="text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_documents_trial_counts(spark):
    """FIXTURES trial: small lexicon over documents.text at sf0.01, no stopwords."""
    from tests.conftest import SF01
    from vigil.sources.fixtures import small_lexicon
    from vigil.sources.tables import read_table

    d = read_table(spark, SF01, "documents", ["doc_id", "text"])
    s = lexicon_scores(d, small_lexicon(spark), col="text", stopwords=None)
    tot = s.agg(*[F.sum(c).alias(c) for c in ("authority_vice_count", "authority_virtue_count", "care_vice_count",
                                               "fairness_vice_count", "fairness_virtue_count", "loyalty_vice_count",
                                               "loyalty_virtue_count", "sanctity_vice_count",
                                               "sanctity_virtue_count")]).collect()[0]
    assert tuple(tot) == (17215, 1528, 2358, 4198, 8409, 2408, 6018, 1000, 4682)


def test_plans_agree_on_repeated_and_null_rows(spark):
    """Rows need no key: equal texts, null texts and repeated rows are each scored for themselves."""
    lex = spark.createDataFrame([("aa", "x.virtue", 1), ("nan", "x.vice", 2)], "token string, category string, ordinal long")
    rows = [(1, "aa bb"), (1, "cc"), (None, "aa"), (None, "aa"), (2, None), (3, "aa aa AA")]
    df = spark.createDataFrame(rows, "id int, text string")
    a, b = (sorted((tuple(r) for r in lexicon_scores(df, lex, col="text", stopwords=None, strategy=s, keep_matched=True).collect()), key=str)
            for s in ("inset", "join"))
    assert a == b and len(a) == 6


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_dic_parts_round_trip_in_order(spark, tmp_path, end):
    from vigil.sources.lexicon import read_dic_lexicon, write_dic_lexicon

    path = str(tmp_path / "lex")
    rows = [(f"tok{i % 70} of", f"c{i % 23:02d}.x", i) for i in range(600)]
    df = spark.createDataFrame(rows, "token string, category string, ordinal long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_dic_lexicon(df, path, line_end=end)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(p.name for p in (tmp_path / "lex").glob("part-*"))
    assert len(parts) > 2
    text = [(tmp_path / "lex" / p).read_bytes().decode() for p in parts]
    assert text[0].split(end)[0] == "%" and not any("%" in t for t in text[1:])
    got = [tuple(r) for r in read_dic_lexicon(spark, path).orderBy("ordinal").collect()]
    assert got == [(t, c, i + 1) for t, c, i in rows]


def test_dic_files_with_and_without_marks(spark, tmp_path):
    from vigil.sources.lexicon import read_dic_lexicon

    (tmp_path / "a0.dic").write_text("lost\t1\n")  # before any marks
    (tmp_path / "a1.dic").write_text("note\n%\n1\tx\n2\ty\n%\none\t1\ntwo\t2\t1\n%\nthree\t9\n")
    (tmp_path / "a2.dic").write_text("four\t2\n")
    (tmp_path / "b.dic").write_text("%\n1\tz\n%\nfive\t1\n")
    (tmp_path / "c.dic").write_text("%\n1\tz\n")  # a header that never ends has no entries
    (tmp_path / "d.dic").write_text("")
    got = [tuple(r) for r in read_dic_lexicon(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [("one", "x", 1), ("two", "y", 2), ("two", "x", 3), ("four", "y", 4), ("five", "z", 5)]


def test_empty_and_null_lexicon_rows(spark, tmp_path):
    from vigil.sources.lexicon import read_dic_lexicon, write_dic_lexicon

    schema = "token string, category string, ordinal long"
    write_dic_lexicon(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert read_dic_lexicon(spark, str(tmp_path / "none")).count() == 0
    write_dic_lexicon(spark.createDataFrame([(None, "a", 1), ("x", None, 2), ("y", "b", None), ("z", "b", 1)], schema), str(tmp_path / "some"))
    assert [r.token for r in read_dic_lexicon(spark, str(tmp_path / "some")).orderBy("ordinal").collect()] == ["y", "z"]


def test_large_lexicon_never_moves_a_text(spark):
    from vigil.operators.lexicon import lexicon_scores

    texts = [(i, f"alpha beta w{i % 3} gamma gamma " * (i % 4)) for i in range(40)] + [(99, None), (100, ""), (100, "")]
    df = spark.createDataFrame(texts, "id long, body string").withColumn("n", F.lit(1))
    lex = spark.createDataFrame([("alpha", "a.v", 1), ("gamma", "b.v", 2), ("w", "a.w", 3), ("nan", "b.w", 4)], "token string, category string, ordinal long")
    want = sorted(tuple(r) for r in lexicon_scores(df, lex, col="body", stopwords=None).drop("body").collect())
    for bound in (1_000, 0):
        out = lexicon_scores(df, lex, col="body", stopwords=None, strategy="join", max_broadcast_tokens=bound).drop("body")
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [line for at, line in enumerate(plan.splitlines()) if "Input [" in line and "Exchange" in plan.splitlines()[at - 1]]
        assert moved and not any("body#" in line for line in moved)
        assert sorted(tuple(r) for r in out.collect()) == want


def test_hash_filter_loses_no_key(spark):
    from vigil.plans.bits import hash_bits, keep_possible

    keys = spark.range(0, 3000, 3).selectExpr("concat('k', id) as k")
    df = spark.range(3000).selectExpr("concat('k', id) as k", "id")
    kept = {r["id"] for r in keep_possible(df, "k", hash_bits(keys, "k", 8), 8).collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 2000


@pytest.mark.parametrize("bound", [1_000, 0])
def test_large_lexicon_shuffles_no_row_per_text_and_token(spark, bound):
    df = spark.createDataFrame([(i, f"alpha beta w{i % 3} gamma") for i in range(40)], "id long, body string")
    lex = spark.createDataFrame([("alpha", "a.v", 1), ("gamma", "b.v", 2)], "token string, category string, ordinal long")
    out = lexicon_scores(df, lex, col="body", stopwords=None, strategy="join", max_broadcast_tokens=bound)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    lines = out._jdf.queryExecution().explainString(mode).splitlines()
    moved = [line for at, line in enumerate(lines) if "Input [" in line and " Exchange" in lines[at - 1]]
    assert moved and not any("__k#" in line and re.search(r"\btoken#", line) for line in moved)
    # md5 is taken once per text, below the generator
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"md5[^\n]*\n[^\n]*Generate", plan)


def test_blocks_of_any_size_give_the_same_sums(spark):
    from vigil.operators.lexicon import _block_sums

    texts = [f"alpha beta w{i % 7} " * (i % 4) + "gamma" * (i % 2) for i in range(60)] * 2
    rows = [(str(i % 60).encode(), t.split()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "__k binary, __t array<string>").repartition(3)
    lex = {"alpha": 0, "w1": 1, "gamma": 1, "never": 0}
    words = spark.createDataFrame(list(lex.items()), "token string, __cat int")
    want = {k: tuple(sum(lex.get(w) == c for w in t) for c in (0, 1)) for k, t in rows if t}
    for chars in (1, 100, 1 << 20):
        got = _block_sums(df, words, 2, chars).collect()
        assert len(got) == len(want) and {bytes(r["__k"]): (r["__c0"], r["__c1"]) for r in got} == want


def test_large_lexicon_of_other_categories_and_an_empty_one(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, None), (2, None)], "id int, text string")
    schema = "token string, category string, ordinal long"
    for rows, want in (([("aa", "x", 1), ("bb", None, 2), ("nan", "y", 3)], [(1, 1), (2, 0), (2, 0)]), ([], [(1, 0), (2, 0), (2, 0)])):
        for bound in (1_000, 0):
            out = lexicon_scores(df, spark.createDataFrame(rows, schema), col="text", categories=["x", "z", "x"], stopwords=None,
                                 strategy="join", max_broadcast_tokens=bound, keep_matched=True)
            assert sorted((r["id"], r["x_count"]) for r in out.collect()) == want
            assert all(r["z_count"] == 0 and r["matched_count"] == r["x_count"] for r in out.collect())


def test_only_vocabularies_meet_the_lexicon(spark, monkeypatch):
    from vigil.operators import lexicon as L
    from vigil.plans.bits import keep_possible

    words = ["cod", "dab", "eel", "fin", "gar"]
    texts = [f"alpha beta alpha {words[i % 5]}" for i in range(90)] + ["", "4 2", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3).sortWithinPartitions("id")
    lex = spark.createDataFrame([("alpha", "a.v", 1), ("eel", "b.v", 2), ("nan", "b.v", 3)], "token string, category string, ordinal long")
    met = []
    monkeypatch.setattr(L, "keep_possible", lambda tokens, key, bits: met.append(tokens) or keep_possible(tokens, key, bits))
    out = L.lexicon_scores(df, lex, col="text", stopwords=None, strategy="join", max_broadcast_tokens=0)
    got = {r["id"]: (r["a_v_count"], r["b_v_count"]) for r in out.collect()}
    assert got == {i: (2, i % 5 == 2) for i in range(90)} | {90: (0, 0), 91: (0, 0), 92: (0, 1)}
    # a row per distinct token of a block, not one per text and token
    assert met[0].count() <= 3 * len({"alpha", "beta", "nan", *words})


def test_long_texts_among_texts_without_tokens_in_blocks(spark):
    from vigil.operators.lexicon import _block_sums

    rows = [(b"a", ["x"] * 100_000 + ["y"] * 300), (b"b", []), (b"c", ["never"]), (b"d", []), (b"e", ["y", "z", "y"])]
    words = spark.createDataFrame([("x", 0), ("y", 1)], "token string, __cat int")
    for some in (rows, rows[1:2], rows[:0]):
        df = spark.createDataFrame(some, "__k binary, __t array<string>").coalesce(1)
        for chars in (1, 20, 150_000, 1 << 25):
            got = {bytes(r["__k"]): (r["__c0"], r["__c1"]) for r in _block_sums(df, words, 2, chars).collect()}
            assert got == {k: (t.count("x"), t.count("y")) for k, t in some if t}


def test_distinct_tokens_make_no_row_per_occurrence(spark):
    from vigil.operators.lexicon import distinct_tokens

    df = spark.createDataFrame([("One two, ONE",), (None,), ("",), ("12",), ("Kelvin café two",)], "text string")
    out = distinct_tokens(df, "text")
    assert sorted(r["token"] for r in out.collect()) == sorted({"one", "two", "nan", "kelvin", "caf"})
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
