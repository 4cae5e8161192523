"""The pipeline: each stage against a plain version on its own input, and the whole run."""

import re

import corpus_pipeline as P
from tests.conftest import SF001
from tests.llm.test_fragjoin import brute as near_brute
from tests.llm.test_mixing import check_mix
from tests.llm.test_pii import brute as pii_brute
from tests.llm.test_quality import brute as quality_brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, SF001)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, {r["doc_id"]: r.asDict() for r in docs.collect()})
        assert name == "mixture" or out.columns == columns
    before, after = seen["quality"]
    failed = {k for k, d in before.items() if quality_brute(d["text"])[5]}
    assert not failed & set(after) and set(after) <= set(before) - failed
    assert all(d["n_chars"] == len(d["text"]) for d in after.values())
    before, after = seen["near_duplicates"]
    rows = near_brute([(k, d["text"]) for k, d in before.items()], 5, 80)
    assert {k: d for k, d in before.items() if k in {c for _, _, c in rows}} == after
    before, after = seen["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert not [k for k, d in after.items() if any(i in d["text"] for i in items)]
    assert len(after) > 0.9 * len(before)
    before, after = seen["private_data"]
    assert set(before) == set(after)
    for k, d in before.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in pii_brute(d["text"]).split(",") if s]
        gone = {d["text"][a:b] for a, b in spans}
        assert not any(x in after[k]["text"] for x in gone) and len(re.findall(r"\[(?:email|ip|card|phone)\]", after[k]["text"])) >= bool(spans)
        assert spans or after[k]["text"] == d["text"]
    check_mix([(d["doc_id"], d["source"], d["size"], d["source_size"], d["target"], d["taken"]) for d in seen["mixture"][1].values()])
    whole = {r["doc_id"]: r.asDict() for r in P.run(spark, SF001).collect()}
    assert whole == seen["mixture"][1]


def test_odd_rows_pass_through(spark):
    text = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(None, text, None, None, None, 1), (1, text, "en", "s", 5, 2), (2, None, "en", "s", 0, 3), (3, "", None, "s", 0, 4), (1, text, "en", "s", 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token long")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF001)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert stage(spark, docs.limit(0) if name != "mixture" else spark.createDataFrame([], "doc_id long, text string, source string"), SF001).count() == 0
    assert docs.count() >= 1


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """One row of each group stays, whatever its ids; other texts of an id that goes stay; rows without words stay."""
    words = [f"word{i}" for i in range(100)]
    copy, near, clean = " ".join(words), " ".join([*words, "more"]), " ".join(f"clean{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(5, copy), (7, near), (7, clean), (None, near), (None, copy), (None, copy), (None, other), (None, other), (9, clean + " x"), (9, clean + " x"),
            (None, None), (None, ""), (3, " "), (3, " ")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = P.near_duplicates(spark, docs, SF001)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    # the clean text of id 7 is a near copy of id 9's, which comes first as id 7 names another text before it (by hash) or not
    assert [x for x in got if x[1] in (copy, near)] == [(5, copy)]
    assert len([x for x in got if (x[1] or "").startswith("clean")]) == 1
    assert [x for x in got if x[1] == other] == [(None, other)]
    assert len([x for x in got if not (x[1] or "").strip()]) == 4
    assert P.near_duplicates(spark, docs.limit(0), SF001).count() == 0
