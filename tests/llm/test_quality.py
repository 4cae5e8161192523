"""Quality rules against plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF001
from vigil.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics_match(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a b"), (-4, "a b c a b c"), (-5, "a a a a"), (-6, "x\n \nx\r\nx\n\x0bx\n"), (-7, "😀 é#|< >"),
             (-8, "q w " * 30000), (-9, "\n" * 1000), (-10, " a  b\tc\x0bd ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.quality_rules(df).select("doc_id", *BASE).collect()}
    assert got == {k: brute(t) for k, t in rows}


def test_lines_are_judged_alone_and_lossy_documents_go(spark):
    prose = [" ".join(f"word{i}x{k}" for k in range(10)) + "." for i in range(12)]
    nav = "Home | Products | About | Jobs | Contact"
    docs = [
        "\n".join(prose), "\n".join([nav, *prose, "All rights reserved, someone 2020", "### *** $$$ %%% !!!", "Home Menu Login"]),
        "\n".join(prose[:5] + [" | ".join(f"item{i}x{k}{'q' * 20}" for k in range(6)) for i in range(12)]),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == docs[0] and got[0]["n_lines_removed"] == 0
    assert got[1]["kept"] and got[1]["clean_text"] == docs[0] and got[1]["n_lines_removed"] == 4
    assert not got[2]["base_failed"] and not got[2]["kept"] and got[2]["lost_share"] > 0.5
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    """Labelled good documents without a failed limit are kept and lose a line of boilerplate at most."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    good = spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 1")
    judged = quality.quality_rules(docs).join(good, "doc_id").where(~F.col("base_failed"))
    lossy = judged.where(~F.col("kept") | (F.col("lost_share") > 0.05)).select("doc_id", "lost_share", "toxic").collect()
    assert not lossy and judged.count() > 0


def test_one_phrase_or_a_few_separators_do_not_fail_a_long_line(spark):
    clean = " ".join(f"word{i}x" for i in range(400))
    more = clean.replace("x", "y")
    lines = {"phrase": clean + " powered by a diesel engine " + more, "separators": clean + " | a | b > c | " + more,
             "short phrase": "Powered by SomeCMS", "long notice": "Copyright 2020 by the firm. All rights reserved. See our Terms of use and Privacy policy.",
             "row": "one two | three | four five | six | seven", "sentence": "She asked whether all rights reserved to the crown in that county had ever been sold to anyone at all, "
             "and nobody in the long hall of the old house by the river could tell her"}
    df = spark.createDataFrame(list(lines.items()), "name string, text string").withColumn("bad", quality.line_failed(F.col("text")))
    assert {r["name"]: r["bad"] for r in df.collect()} == {"phrase": False, "separators": False, "short phrase": True, "long notice": True,
                                                           "row": True, "sentence": False}
    whole = spark.createDataFrame([(1, lines["phrase"])], "doc_id long, text string")
    got = quality.quality_rules(whole).first()
    assert got["kept"] and got["lost_share"] == 0.0 and got["clean_text"] == lines["phrase"]
