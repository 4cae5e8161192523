"""Runs that go on: ledgers, incremental statistics, grids cached by content, row accounting."""

import os
import time

import pytest
from pyspark.sql import functions as F

from vigil.operators import increments as I
from vigil.operators.ledger import answer_jobs, job_key, read_ledger, respond_with_ledger
from vigil.operators.rates import report_ratio, stats_by_model_perspective
from vigil.sources import accounting as A
from vigil.sources.grid_cache import _publish, fingerprint, grid_by_content
from vigil.sources.responses import write_responses


def shouting():
    def shout(model, setting, prompt):
        """Answers in capitals; notes every call in a file in the prompt's folder; rejects prompts with 'bad'."""
        folder, said = prompt.split("|", 1)
        with open(os.path.join(folder, "calls"), "a", encoding="utf-8") as f:
            f.write(f"{model}/{setting}/{said}\n")
        if "bad" in said:
            raise RuntimeError("rejected " + said)
        return None, said.upper()
    return shout


shout = shouting()  # a nested function, so that it travels by value


def jobs(spark, tmp_path, n):
    return spark.createDataFrame([(i, f"m{i % 2}", f"{tmp_path}|say {i % 5}") for i in range(n)], "i long, model string, prompt string")


def calls(tmp_path):
    path = tmp_path / "calls"
    return sorted(path.read_text().splitlines()) if path.exists() else []


def test_equal_jobs_are_asked_once_and_answers_join_back(spark, tmp_path):
    df = jobs(spark, tmp_path, 40)
    out = respond_with_ledger(df, shout, str(tmp_path / "ledger")).collect()
    assert len(out) == 40 and all(r["response"] == f"SAY {r['i'] % 5}" and r["raw_response"] is None for r in out)
    assert len(calls(tmp_path)) == 10 == len(set(calls(tmp_path)))
    respond_with_ledger(df, shout, str(tmp_path / "ledger")).collect()
    assert len(calls(tmp_path)) == 10


def test_a_broken_run_asks_only_the_rest(spark, tmp_path):
    df = spark.createDataFrame([(f"m{i}", f"{tmp_path}|say {i}") for i in range(60)], "model string, prompt string")
    ledger = str(tmp_path / "ledger")

    def stop(batch):
        if batch == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        answer_jobs(df, shout, ledger, calls_per_batch=15, after_batch=stop)
    before = calls(tmp_path)
    assert 0 < len(before) < 60 and read_ledger(spark, ledger).count() == len(before)
    assert answer_jobs(df, shout, ledger, calls_per_batch=15) == 60 - len(before)
    after = calls(tmp_path)
    assert len(after) == 60 == len(set(after))
    assert {r["calls"] for r in read_ledger(spark, ledger).collect()} == {1}


def test_failed_jobs_stay_or_are_tried_again(spark, tmp_path):
    df = spark.createDataFrame([("m", f"{tmp_path}|bad {i}") for i in range(3)] + [("m", f"{tmp_path}|fine")], "model string, prompt string")
    ledger = str(tmp_path / "ledger")
    assert answer_jobs(df, shout, ledger) == 4 and answer_jobs(df, shout, ledger) == 0
    assert answer_jobs(df, shout, ledger, retry_failed=True) == 3
    got = sorted((r["failed"], r["attempt"], r["calls"]) for r in read_ledger(spark, ledger).collect())
    assert got == [(False, 1, 1), (True, 2, 2), (True, 2, 2), (True, 2, 2)]
    out = [r["response"] for r in respond_with_ledger(df, shout, ledger).collect()]
    assert sorted(out) == ["FINE", "rejected bad 0", "rejected bad 1", "rejected bad 2"]


def test_settings_nulls_errors_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", f"{tmp_path}|x", "low", None), (2, "a", f"{tmp_path}|x", "high", None), (3, None, f"{tmp_path}|x", "low", None),
                                (4, "b", None, "low", "no route"), (5, "a", f"{tmp_path}|x", "low", None)],
                               "i int, model string, prompt string, setting string, error string").withColumn("response", F.lit("old"))
    out = {r["i"]: r["response"] for r in respond_with_ledger(df, shout, str(tmp_path / "l"), reasoning="setting", error_col="error").collect()}
    assert out == {1: "X", 2: "X", 3: "X", 4: "no route", 5: "X"}
    assert calls(tmp_path) == ["None/low/x", "a/high/x", "a/low/x"]
    assert respond_with_ledger(df.limit(0), shout, str(tmp_path / "none")).count() == 0
    key = lambda *a: spark.range(1).select(job_key(*map(F.lit, a))).first()[0]
    assert len({key("a", "b", "c"), key("ab", "", "c"), key("a", "", "bc"), key("", "ab", "c"), key(None, "b", "c")}) == 5


def test_rows_without_a_job_are_not_dealt_by_their_null_key(spark, tmp_path):
    rows = [(f"m{i % 3}", f"{tmp_path}|say {i}", None if i < 40 else "no route") for i in range(440)]
    df = spark.createDataFrame(rows, "model string, prompt string, error string").repartition(4)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = respond_with_ledger(df, shout, str(tmp_path / "ledger"), error_col="error")
        rest = out.select("model", "prompt", "error", "response", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    at = [r[4] for r in rest if r["error"]]
    assert max(map(at.count, at)) < 200
    assert sorted((tuple(r[:4]) for r in rest), key=str) == sorted(((m, p, e, e or p.split("|")[1].upper()) for m, p, e in rows), key=str)


def test_a_rate_is_shared_by_the_tasks(spark, tmp_path):
    df = spark.createDataFrame([("m", f"{tmp_path}|{i}") for i in range(24)], "model string, prompt string")
    at = time.monotonic()
    answer_jobs(df, shout, str(tmp_path / "ledger"), calls_per_second=12)
    assert time.monotonic() - at > 1.2 and len(calls(tmp_path)) == 24


SCORED = "model string, perspective_run string, closeness_level int, closeness_level_name string, severity_level int, answer string, " + \
    ", ".join(f"{c} double" for c in I.MORAL4)


def scored(spark, runs, seed=0):
    rows = []
    for k, run in enumerate(runs):
        for i in range(60):
            x = (i * 7 + k * 3 + seed) % 11
            level = None if x == 10 else 1 + i % 4
            rows.append((f"m:{i % 2}", run, level, f"c{level}", 1 + (i // 4) % 4, [None, "Yes", "No", "yes"][x % 4],
                         *(float("nan") if (x + j) % 9 == 0 else x / 7 + j for j in range(4))))
    return spark.createDataFrame(rows, SCORED)


def near(a, b):
    flat = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert flat(a) == flat(b)


def test_state_equals_a_full_pass_and_reads_only_what_changed(spark, tmp_path):
    root, state, same = str(tmp_path / "runs"), str(tmp_path / "state"), lambda d: d
    write_responses(scored(spark, ["p_1", "d_1"]), root)
    assert I.update_state(spark, root, state, same) == [("d_1", "m:0"), ("d_1", "m:1"), ("p_1", "m:0"), ("p_1", "m:1")]
    assert I.update_state(spark, root, state, same) == []
    write_responses(scored(spark, ["p_2"]), root)
    assert I.update_state(spark, root, state, same) == [("p_2", "m:0"), ("p_2", "m:1")]
    write_responses(scored(spark, ["d_1"], seed=5).where("model = 'm:1'"), root)  # rewritten
    assert I.update_state(spark, root, state, same) == [("d_1", "m:1")]
    full = spark.read.schema(SCORED).option("basePath", root).parquet(root)
    cells = I.read_state(spark, root, state)
    for combine in (True, False):
        want = stats_by_model_perspective(full, combine_runs=combine)
        near(I.stats_from_state(cells, combine).select(*want.columns).collect(), want.collect())
    want = report_ratio(full.withColumn("perspective", F.regexp_replace("perspective_run", "_[123]$", "")))
    near(I.report_from_state(cells).select(*want.columns).collect(), want.collect())


def test_state_of_a_folder_that_is_gone_or_empty(spark, tmp_path):
    import shutil

    root, state = str(tmp_path / "runs"), str(tmp_path / "state")
    write_responses(scored(spark, ["p_1", "d_1"]), root)
    nothing = lambda d: d.where("perspective_run = 'p_1'")  # noqa: E731  no row of d_1 counts
    assert len(I.update_state(spark, root, state, nothing)) == 4
    assert I.update_state(spark, root, state, nothing) == []
    assert {r["perspective_run"] for r in I.read_state(spark, root, state).collect()} == {"p_1"}
    shutil.rmtree(tmp_path / "runs" / "perspective_run=p_1" / "model=m%3A0")
    assert {r["model"] for r in I.read_state(spark, root, state).collect()} == {"m:1"}


def test_fingerprint_depends_on_content_only(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, "c", "d")], "n int, s string, t string")
    one = fingerprint({"x": df})
    assert one == fingerprint({"x": df.repartition(3).orderBy(F.desc("n"))})
    others = [df.union(df.limit(1)), df.withColumn("s", F.lit("a")), df.withColumnRenamed("s", "u"), df.withColumn("n", F.col("n").cast("long")),
              spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, "c", "d")], df.schema), df.limit(0)]
    assert len({one, *(fingerprint({"x": d}) for d in others), fingerprint({"y": df}), fingerprint({})}) == len(others) + 3


def test_grid_is_built_once_per_content(spark, tmp_path):
    built = []

    def build(t):
        built.append(1)
        return t["a"].crossJoin(t["b"])

    a, b = spark.createDataFrame([("x",), ("y",)], "u string"), spark.range(3)
    for _ in range(2):
        assert grid_by_content(spark, str(tmp_path), {"a": a, "b": b}, build).count() == 6
    assert len(built) == 1
    more = a.union(spark.createDataFrame([("z",)], "u string"))
    assert grid_by_content(spark, str(tmp_path), {"a": more, "b": b}, build).count() == 9
    assert grid_by_content(spark, str(tmp_path), {"a": a, "b": b}, build).count() == 6
    assert len(built) == 2 and len([p for p in os.listdir(tmp_path) if p.startswith("grid-")]) == 2


def test_two_builders_do_not_overwrite_each_other(spark, tmp_path):
    for name in ("one", "two"):
        spark.createDataFrame([(name,)], "who string").write.parquet(str(tmp_path / name))
    target = str(tmp_path / "grid")
    assert _publish(spark, str(tmp_path / "one"), target) and not _publish(spark, str(tmp_path / "two"), target)
    assert [r.who for r in spark.read.parquet(target).collect()] == ["one"] and not (tmp_path / "two").exists()
    with pytest.raises(Exception, match="."):
        _publish(spark, str(tmp_path / "missing"), str(tmp_path / "other"))


def test_every_csv_record_is_accounted_for(spark, tmp_path):
    good = '"{""answer"": ""Yes"", ""reason"": ""a\nb""}"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f'id,level,response\n1,2,{good}\n2,x,{good}\n3,4\n4,5,{good},more\n5,6,nothing\n6,,{good}\n')
    (tmp_path / "in" / "b.csv").write_text("id,level,response\n7,1,\n")
    (tmp_path / "in" / "c.csv").write_text("id,level,response\n")
    checked = A.with_status(A.scan_checked(spark, str(tmp_path / "in"), "id long, level int, response string"))
    got = {os.path.basename(r[A.FILE]): tuple(r)[1:] for r in A.account(checked).collect()}
    assert got == {"a.csv": (6, 2, 1, 3), "b.csv": (1, 0, 1, 0)}
    assert sorted(r["id"] for r in A.kept_rows(checked).collect()) == [1, 6]
    A.write_quarantine(checked, str(tmp_path / "q"))
    held = sorted(r[A.RECORD] for r in spark.read.parquet(str(tmp_path / "q")).collect())
    assert [h.split(",")[0] for h in held] == ["2", "3", "4"] and held[1] == "3,4"
