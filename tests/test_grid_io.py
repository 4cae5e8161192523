"""G1-G6, I1-I3, S1-S6, streaming."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions.text import render_template, short_model_name, strip_run_suffix
from vigil.operators import grid as G
from vigil.operators.responder import map_responder
from vigil.sources import responses as S
from vigil.sources.lexicon import read_dic_lexicon, read_lexicon
from vigil.operators.lexicon import lexicon_map


def test_factor_grid_product_and_dependent_levels(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "template int")
    c = spark.createDataFrame([(1, "near"), (2, "far")], "closeness_level int, closeness_level_name string")
    ex = spark.createDataFrame([(1, 1, "sibling"), (1, 2, "friend"), (2, 1, "stranger")],
                               "closeness_level int, example_n int, example string")
    s = spark.createDataFrame([(1,), (2,), (3,), (4,)], "severity_level int")
    g = G.factor_grid([t, c, s], nested=[(ex, ["closeness_level"])])
    assert g.count() == 3 * 3 * 4
    assert g.select("template", "closeness_level", "example_n", "severity_level").distinct().count() == 36
    with pytest.raises(ValueError):
        G.factor_grid([t, c, s], max_rows=10)


def test_render_single_pass(spark):
    df = spark.createDataFrame([("Is {closeness} ok with {violation}? {{json}}", "{violation}", "theft"),
                                ("plain", "x", "y")], "t string, c string, v string")
    out = [r[0] for r in df.select(render_template("t", {"closeness": "c", "violation": "v"})).collect()]
    assert out == ["Is {violation} ok with theft? {json}", "plain"]
    bad = spark.createDataFrame([("{unknown}",)], "t string")
    with pytest.raises(Exception):
        bad.select(render_template("t", {"closeness": F.lit("a")})).collect()


def test_strip_and_short_names(spark):
    df = spark.createDataFrame([("action_1",), ("action_3",), ("action_4",), ("a_1_2",), ("plain",)], "r string")
    assert [r[0] for r in df.select(strip_run_suffix("r")).collect()] == ["action", "action", "action_4", "a_1",
                                                                          "plain"]
    m = spark.createDataFrame([("org/model-x", "low"), ("model-y", ""), ("a/b/c", None)], "m string, r string")
    assert [r[0] for r in m.select(short_model_name("m", "r")).collect()] == ["model-x_low", "model-y", "c"]


def test_sample_validate_route(spark):
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    a = [r.id for r in G.sample_n(df, 25, seed=42, key="k").collect()]
    b = [r.id for r in G.sample_n(df.repartition(5), 25, seed=42, key="k").collect()]
    assert len(a) == 25 and sorted(a) == sorted(b) and len(set(a)) == 25
    assert G.sample_n(df, 0, key="k").count() == 1000
    with pytest.raises(ValueError):
        G.validate_keys(spark.createDataFrame([("x",), ("y",)], "p string"), ["x"], "p")
    r = {x.model: x for x in G.route_models(spark.createDataFrame([("a",), ("b",)], "model string"),
                                            {"a": "direct"}).collect()}
    assert r["a"].provider == "direct" and r["b"].route_error.startswith("no provider")


def test_map_responder_errors_become_rows(spark):
    def _responder(model, reasoning, prompt):  # defined inline so workers receive it by value
        if "boom" in prompt:
            raise ValueError("service failed")
        return {"raw": prompt}, f"{model}:{prompt.upper()}"

    df = spark.createDataFrame([(i, "m", "boom" if i == 3 else f"p{i}") for i in range(10)],
                               "id int, model string, prompt string")
    out = {r.id: r for r in map_responder(df, _responder, concurrency=4).collect()}
    assert out[1].response == "m:P1" and out[3].response == "service failed" and out[3].raw_response == "service failed"


def test_csv_round_trip_and_file_layout(spark, tmp_path):
    pdf = pd.DataFrame({"id": [1, 2], "response": ['He said "yes",\nthen {"answer": "Yes"}', "plain"]})
    for run, model in (("action_1", "m1"), ("action_2", "m2")):
        os.makedirs(tmp_path / run, exist_ok=True)
        pdf.to_csv(tmp_path / run / f"{model}.csv", index=False)
    one = S.scan_responses(spark, str(tmp_path / "action_1" / "m1.csv"), schema="id int, response string")
    assert [r.response for r in one.orderBy("id").collect()] == list(pdf.response)
    allr = S.scan_all_runs(spark, str(tmp_path), fmt="csv", layout="files", schema="id int, response string",
                           combine_runs=True)
    got = sorted((r.perspective_run, r.model, r.perspective, r.id) for r in allr.collect())
    assert got[0] == ("action_1", "m1", "action", 1) and len(got) == 4
    with pytest.raises(ValueError):
        S.score(one, "unknown")


def test_partitioned_sink_and_cached_grid(spark, tmp_path):
    df = spark.createDataFrame([("a_1", "m", 1), ("a_2", "n", 2)], "perspective_run string, model string, v int")
    S.write_responses(df, str(tmp_path / "out"))
    back = S.scan_all_runs(spark, str(tmp_path / "out"), combine_runs=True)
    assert sorted((r.perspective_run, r.model, r.perspective, r.v) for r in back.collect()) == [
        ("a_1", "m", "a", 1), ("a_2", "n", "a", 2)]
    calls = []

    def build():
        calls.append(1)
        return df

    S.grid_cached(spark, str(tmp_path / "grid"), build)
    S.grid_cached(spark, str(tmp_path / "grid"), build)
    assert len(calls) == 1


def test_dic_with_cr_line_ends_and_csv_lexicon(spark, tmp_path):
    text = "%\r1\tcare.virtue\r2\tcare.vice\r%\rkind\t1\rcruel\t2\rkind\t2\rboth\t1\t2\r"
    p = tmp_path / "lex.dic"
    p.write_bytes(text.encode())
    lex = read_dic_lexicon(spark, str(p))
    assert sorted((r.token, r.category) for r in lex.collect()) == [
        ("both", "care.vice"), ("both", "care.virtue"), ("cruel", "care.vice"), ("kind", "care.vice"),
        ("kind", "care.virtue")]
    assert dict((r.token, r.category) for r in lexicon_map(lex).collect())["kind"] == "care.vice"
    c = tmp_path / "lex.csv"
    c.write_text("token,category\nKind,care.virtue\nkind,care.vice\n")
    assert dict((r.token, r.category) for r in lexicon_map(read_lexicon(spark, str(c))).collect()) == {
        "kind": "care.vice"}


def test_streaming_scores_match_batch(spark, tmp_path):
    from vigil.streaming import scored_stream, start_scored_sink, streaming_yes_counts
    from vigil.sources.fixtures import small_lexicon

    src = str(tmp_path / "src")
    rows = [(i, "m", "p_1", '{"answer": "%s", "reasoning": "the er of in"}' % ("Yes" if i % 2 else "No"))
            for i in range(6)]
    schema = "row_key int, model string, perspective_run string, response string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    st = scored_stream(spark, src, schema, small_lexicon(spark), stopwords=None)
    q = start_scored_sink(st, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "sink"))
    assert out.count() == 6 and {r.authority_vice_count for r in out.collect()} == {2}  # the, er
    agg = streaming_yes_counts(scored_stream(spark, src, schema, small_lexicon(spark), stopwords=None))
    q2 = agg.writeStream.format("memory").queryName("yes_counts").outputMode("complete").start()
    q2.processAllAvailable()
    q2.stop()
    r = spark.sql("select * from yes_counts").collect()[0]
    assert (r.rows, r.yes) == (6, 3)


@pytest.mark.parametrize("n", [1, 25, 3000, 19999])
def test_sample_n_equals_the_plain_top_n(spark, n):
    """The threshold filter and its small cut give the n smallest hashes, whatever n is."""
    from vigil.functions.hashing import unit_hash
    df = spark.range(20000).withColumn("k", F.col("id").cast("string"))
    got = sorted(r.id for r in G.sample_n(df, n, seed=7, key="k").collect())
    want = sorted(r.id for r in df.orderBy(unit_hash(7, "k", method="xxhash64"), "k").limit(n).collect())
    assert got == want and len(got) == n


def test_balanced_sink_spreads_a_hot_value(spark, tmp_path):
    """A run holding most rows is written whole, through a REBALANCE shuffle."""
    from pyspark.sql import functions as F
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot_1")).otherwise(F.lit("cold_1")).alias("perspective_run"),
        F.lit("m").alias("model"), F.col("id").alias("v")).repartition(4)
    assert "RebalancePartitions" in df.hint("rebalance", "perspective_run", "model")._jdf.queryExecution() \
        .optimizedPlan().toString()
    S.write_responses(df, str(tmp_path / "bal"), balance=True)
    back = spark.read.parquet(str(tmp_path / "bal"))
    assert back.count() == 20000
    assert back.where(F.col("perspective_run") == "hot_1").count() == 16000


def test_cross_product_is_spread_over_tasks(spark):
    """No single task emits the whole product of broadcast level tables."""
    from vigil.operators.grid import cross_product
    sizes = [3, 4, 5, 10]
    tables = [spark.range(n).withColumnRenamed("id", f"f{i}").coalesce(1) for i, n in enumerate(sizes)]
    out = cross_product(tables, sizes, rows_per_task=100)
    assert out.rdd.getNumPartitions() == 6
    per_task = out.rdd.glom().map(len).collect()
    assert sum(per_task) == 600 and max(per_task) <= 100
    assert out.distinct().count() == 600


def test_grid_without_limits(spark):
    """A grid's exact size counts; children are counted by parent, and nothing is refused by default."""
    parents = spark.range(40).withColumnRenamed("id", "p")
    child = spark.range(80).select((F.col("id") % 40).alias("p"), F.col("id").alias("c"))
    other = spark.range(3).withColumnRenamed("id", "x")
    assert G.factor_grid([parents, other], nested=[(child, ["p"])], max_rows=240).count() == 240
    with pytest.raises(ValueError):
        G.factor_grid([parents, other], nested=[(child, ["p"])], max_rows=239)
    jobs = G.job_grid(parents, spark.range(5).withColumnRenamed("id", "model"), spark.range(4).withColumnRenamed("id", "run"), rows_per_task=100)
    assert jobs.count() == 800 and max(jobs.rdd.glom().map(len).collect()) <= 120


def test_unfinished_grid_is_built_again(spark, tmp_path):
    path = str(tmp_path / "grid")
    spark.range(10).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert S.grid_cached(spark, path, lambda: spark.range(100)).count() == 100
    assert S.grid_cached(spark, path, lambda: spark.range(5)).count() == 100


def test_csv_keeps_white_space_and_names(spark, tmp_path):
    texts = ["  lead", "trail  ", ' "q" , ', "a\nb ", "plain"]
    df = spark.createDataFrame([(i, t, m, "p_1") for i, t in enumerate(texts) for m in ("007", "10")],
                               "row_key long, response string, model string, perspective_run string")
    S.write_responses(df, str(tmp_path / "runs"), fmt="csv")
    for schema in ("row_key long, response string", None):
        back = S.scan_all_runs(spark, str(tmp_path / "runs"), fmt="csv", schema=schema)
        assert sorted((int(r.row_key), r.response, r.model) for r in back.collect()) == sorted((r.row_key, r.response, r.model) for r in df.collect())


def test_responder_keeps_long_keys(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "a", "x"), (None, "b", "y"), (big + 2, "c", "z")], "k long, model string, prompt string")
    df = df.withColumn("err", F.when(F.col("model") == "b", F.lit("no route")))
    out = map_responder(df, lambda m, r, p: (r, m + p), reasoning=F.lit("high"), error_col="err").collect()
    assert sorted((r.k or 0, r.response, r.raw_response) for r in out) == [(0, "no route", "no route"), (big, "ax", "high"), (big + 2, "cz", "high")]


def test_lexicon_files_keep_their_order(spark, tmp_path):
    from vigil.operators.lexicon import lexicon_map
    from vigil.sources.lexicon import read_dic_lexicon, read_lexicon
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("token,category\nx,first\ny,first\n")
    (tmp_path / "csv" / "b.csv").write_text("token,category\n" + "".join(f"t{i},c\n" for i in range(500)) + "x,last\n")
    got = {r.token: r.category for r in lexicon_map(read_lexicon(spark, str(tmp_path / "csv"), fmt="csv")).collect()}
    assert got["x"] == "last" and got["y"] == "first"
    ids = "\n".join(f"{i}\tc{i}" for i in range(100))
    (tmp_path / "l.dic").write_text(f"%\n{ids}\n%\n" + "x\t" + "\t".join(str(i) for i in range(100)) + "\nx\t7\n")
    assert {r.token: r.category for r in lexicon_map(read_dic_lexicon(spark, str(tmp_path / "l.dic"))).collect()} == {"x": "c7"}
