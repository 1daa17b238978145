import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import aggregates as ag
from scoreloom.operators import grid, windows
from scoreloom.plans import inference, judging
from scoreloom.sources import generate, readers, sinks
from scoreloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def percentile(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


def test_exact_percentiles_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 0.0, 0.0, round(rng.random(), 2), rng.random() * 1e6])) for _ in range(5000)] + [("one", 3.0), ("none", None)]
    points = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r[0]: tuple(r)[1:] for r in ag.exact_percentiles(df, ["k"], "v", points).collect()}
    assert set(got) == {"hot", "a", "b", None, "one"}
    for k, found in got.items():
        own = [v for g, v in rows if g == k and v is not None]
        assert found == pytest.approx(tuple(percentile(own, p) for p in points))
    whole = ag.exact_percentiles(df, [], "v", (0.5,)).first()[0]
    assert whole == pytest.approx(percentile([v for _, v in rows if v is not None], 0.5))
    assert ag.exact_percentiles(df.limit(0), ["k"], "v", points).count() == 0
    assert {r.k: r.p50 for r in ag.describe_by(df, ["k"], "v").collect()}["none"] is None


@pytest.mark.parametrize("n", [3, 400])
def test_rolling_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 9 + ["b"]), rng.randrange(50), i, rng.choice([None, rng.random()])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v double").withColumn("__split", F.lit(1))
    got = {r.id: r.rolling_mean for r in windows.rolling(df, "k", ["t", "id"], "v").collect()}
    want = {}
    for k in ("hot", "b"):
        own = sorted((t, i, v) for g, t, i, v in rows if g == k)
        for j, (_, i, _) in enumerate(own):
            last = [v for *_, v in own[max(0, j - 4) : j + 1] if v is not None]
            want[i] = sum(last) / len(last) if j >= 4 and last else None
    assert set(got) == set(want) and all(got[i] == (pytest.approx(want[i], abs=1e-6) if want[i] is not None else None) for i in want)
    last = windows.last_n(df, "k", ["t", "id"], 3)
    assert {(r.k, r.id) for r in last.collect()} == {(k, i) for k in ("hot", "b") for _, i in sorted((t, i) for g, t, i, _ in rows if g == k)[-3:]}


def test_pivots_hold_every_value(spark):
    rows = [(random.Random(i).choice("ab"), f"p{i % 40}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "m string, p string, v double")
    cells = ag.pivot_cells(df, "m", "p", F.col("v"))
    assert cells.agg(F.sum("n_rows")).first()[0] == 200
    wide = ag.pivot_metric(df, "m", "p", F.col("v"))
    assert len(wide.columns) == 41 and {(r.m, r.p): r.value for r in cells.collect()} == {(r.m, c): r[c] for r in wide.collect() for c in wide.columns[1:] if r[c] is not None}
    with pytest.raises(ValueError):
        ag.pivot_metric(spark.range(1001).selectExpr("'a' AS m", "cast(id AS string) AS p", "1.0 AS v"), "m", "p", F.col("v"))


def test_correlations_of_what_does_not_vary(spark):
    df = spark.createDataFrame([(1.0, float(i), None if i % 2 else float(-i)) for i in range(20)], "a double, b double, c double")
    got = {(r.metric_a, r.metric_b): (r.n, r.correlation) for r in ag.correlations(df, ("a", "b", "c")).collect()}
    assert got == {("a", "b"): (20, None), ("a", "c"): (10, None), ("b", "c"): (10, -1.0)}
    assert {r.n for r in ag.complete_correlations(df, ("a", "b", "c")).collect()} == {10}
    assert [r.correlation for r in ag.complete_correlations(df.limit(0), ("a", "b")).collect()] == [None]


def test_examples_for_prompts(spark, tmp_path):
    bank = spark.createDataFrame([(i, f"q{i}", None if i == 2 else f"a{i}") for i in range(1, 9)], "question_id int, question string, answer string")
    assert [e.question for e in inference.choose_examples(bank, 3).first().examples] == ["q1", "q3", "q4"]
    picked = inference.choose_examples(bank, 3, "random").first().examples
    assert picked == inference.choose_examples(bank, 3, "random").first().examples and len(picked) == 3
    assert inference.choose_examples(bank.limit(0), 3).first().examples == []
    with pytest.raises(ValueError):
        inference.choose_examples(bank, 3, "best")
    own = inference.custom_examples(spark, [{"problem": "p", "solution": "s"}, {"question": "q"}, {"question": "x", "answer": "y"}], 5).first().examples
    assert [(e.question, e.answer) for e in own] == [("p", "s"), ("x", "y")]
    (tmp_path / "e.json").write_text('{"math": [{"problem": "p1", "solution": "s1"}, {"problem": "p2"}, {"question": "p3", "answer": "s3"}]}')
    read = lambda task: [(e.question, e.answer) for e in inference.examples_from_file(spark, str(tmp_path / "e.json"), task, 5).first().examples]
    assert read("math") == [("p1", "s1"), ("p3", "s3")] and read("other") == []


def test_settings_fall_back(spark):
    table = {("cot", "a"): {"n": 1}, ("default", "a"): {"n": 2}}
    of = lambda p, m: one(spark, inference.settings(F.lit(p), F.lit(m), table, {"n": 9})).n
    assert (of("cot", "a"), of("x", "a"), of("cot", "b")) == (1, 2, 9)
    assert one(spark, inference.settings(F.lit("p"), F.lit("m"), {}, {"n": 9})).n == 9


def test_whole_evaluation(spark):
    q = spark.createDataFrame([(1, "2 + 2?", "4", "x"), (2, "3 + 3?", "6", "x"), (3, "bad", "6", "x")], "question_id int, question string, solution string, question_type string")

    def backend(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("6")
        return [f"Đáp án: {4}" for _ in prompts]

    rows = inference.evaluate(inference.with_prompts(q, ["zero_shot"]).coalesce(1), "m", backend, 1)
    got = {r.question_id: r for r in rows.collect()}
    assert [got[i].is_correct for i in (1, 2, 3)] == [True, False, False] and got[1].final_answer == "4" and got[3].response == "[Error: 6]" and got[1].latency >= 0
    p = inference.progress(rows, 5).first()
    assert (p.done, p.left, round(p.accuracy, 3)) == (3, 2, 0.333) and p.seconds_left >= 0


def test_fallback_of_judges(spark):
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise ConnectionError
        return ["Score: 7/10"] * len(prompts)

    assert inference.with_fallback([flaky])(["a", "b"]) == ["Score: 7/10"] * 2 and calls == [2, 2, 2]
    broken = lambda prompts: 1 / 0
    assert inference.with_fallback([broken, broken], 2)(["a"]) == [""]
    df = spark.createDataFrame([(1, "q", "r", "e", "cot"), (2, None, "x" * 9000, None, None)], "result_id int, question_text string, response string, expected_answer string, prompt_type string")
    zero = judging.judged_reasoning(df, broken).select("scores.*").collect()
    assert all(v == 0.0 for r in zero for v in r) and [r.completeness for r in judging.judged_completeness(df, broken).collect()] == [5.0, 5.0]
    assert [r.error.error_type for r in judging.judged_errors(df, broken).collect()] == ["Unknown"] * 2
    judged = judging.judged_twice(df, judging.offline).select("second.*").collect()
    assert all(0 <= r.quality <= 1 and r.feedback == "offline" for r in judged)
    assert judging.given_up(judging.ask(df, F.lit("n/10"), broken)).first().given_up and not judging.given_up(judging.ask(df, F.lit("n/10"), judging.offline)).first().given_up
    assert len(df.select(judging.completeness_prompt(F.col("question_text"), F.col("response")).alias("p")).collect()[1].p) < 4200


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n3,\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), ("3", None)]
    default = spark.createDataFrame([(0,)], "k int")
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "b.json").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "c.json").write_text("no json")
    assert [sorted(r.k for r in readers.read_json(spark, str(tmp_path / f), default).collect()) for f in ("a.json", "b.json", "c.json", "missing.json")] == [[1, 2], [1, 2], [0], [0]]
    with pytest.raises(Exception):  # noqa: B017
        readers.read_json(spark, str(tmp_path / "missing.json"))
    assert readers.read_yaml(str(tmp_path / "missing.yaml"), {"a": 1}) == {"a": 1}
    df = readers.resolve_texts(spark.createDataFrame([("r", "t")], "Model_Output string, ground_truth string"))
    assert df.columns == ["response", "expected_answer"] and readers.resolve_texts(default).first().response is None
    assert readers.require(default, "k") is default
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.require(default, "k", "z")
    assert readers.resolve_columns(df, {"answer": ("response",), "other": ("none",)}).columns == ["answer", "expected_answer", "other"]
    assert one(spark, readers.http_wait(F.lit("Wed, 05 Jan 2022 10:01:00 GMT"), F.to_timestamp(F.lit("2022-01-05 10:00:00")))) == 60
    assert one(spark, readers.http_wait(F.lit("Wed, 05 Jan 2022 09:01:00 GMT"), F.to_timestamp(F.lit("2022-01-05 10:00:00")))) == 0 and one(spark, readers.http_wait(F.lit("soon"), F.current_timestamp())) is None
    assert one(spark, readers.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4)))) == {"a": 1, "b": 3, "c": 4}


ROWS = "result_id int, model_name string, prompt_type string, is_correct boolean, f1_score double"


def test_reports(spark, tmp_path):
    rows = [(i, "a|b" if i % 2 else "<m>", f"p{i % 7}", i % 3 == 0, i / 10) for i in range(70)]
    df = spark.createDataFrame(rows, ROWS)
    lines = {(r.part, r.name): r.total for r in sinks.report_lines(df).collect()}
    assert lines["meta", "all"] == 70 and lines["model_name", "<m>"] == 35 and lines["prompt_type", "p0"] == 10
    text = sinks.markdown_report(df)
    assert "| a\\|b | 12 | 35 | 0.3429 |" in text and "## Models by prompt" in text and "| f1_score | 3.4500 |" in text
    page = sinks.html_report(df, sample=("result_id", "model_name"))
    assert "&lt;m&gt;" in page and "<m>" not in page and page.count("<tr>") > 30
    few = sinks.report_tables(df, 2)
    assert few[1][2][-1][0] == "(others)" and sum(int(r[2]) for r in few[1][2]) == 70
    assert "Not enough data." in sinks.markdown_report(df.limit(0)) and "Not enough data." in sinks.html_report(df.limit(0))
    sinks.save_statistics({"models": df.groupBy("model_name").count()}, str(tmp_path / "s"))
    assert readers.read_csv(spark, str(tmp_path / "s" / "models")).count() == 2


def test_partial_results_and_retention(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x", True, 0.1), (2, "b", "x", False, 0.2)], ROWS)
    path = str(tmp_path / "partial")
    assert sinks.read_results(spark, path, ROWS).count() == 0
    sinks.save_partial(df, path)
    sinks.save_partial(df.where("model_name = 'a'").withColumn("is_correct", F.lit(False)), path)
    assert sorted((r.model_name, r.is_correct) for r in sinks.read_results(spark, path, ROWS).collect()) == [("a", False), ("b", False)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("broken")
    assert sinks.read_results(spark, str(tmp_path / "bad"), ROWS).count() == 0
    folder = tmp_path / "checkpoints"
    folder.mkdir()
    for k in range(7):
        (folder / f"checkpoint_{k}.json").write_text("{}")
    files = readers.list_files(spark, str(folder))
    assert sinks.keep_newest(spark, files, 5) == 2 and len(list(folder.iterdir())) == 5
    assert sinks.keep_newest(spark, readers.list_files(spark, str(folder)), 0) == 5 and not list(folder.iterdir())
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Phần I", "Bài 1 ,x", "Lời giải", "y"])], "doc_id int, line_no int, line string")
    sinks.save_sections(readers.section_documents(docs), str(tmp_path / "sections"))
    assert spark.read.json(str(tmp_path / "sections")).first().section == "Phần I"


def test_filters_and_runs(spark):
    q = spark.createDataFrame([(1, "A", "Dễ", ["X"]), (2, "b", "Khó", None), (3, None, None, [])], "question_id int, question_type string, difficulty string, tags array<string>")
    ids = lambda **k: sorted(r.question_id for r in grid.filtered(q, **k).collect())
    assert ids() == [1, 2, 3] and ids(ids=[3, 9]) == [3] and ids(tags=["x"]) == [1] and ids(types=["a", "B"]) == [1, 2] and ids(difficulties=["Khó"]) == [2] and ids(first=2) == [1, 2]
    runs = [("r1", "a", "x", "2022-01-01"), ("r1", "b", "y", "2022-01-01"), ("r2", "a", "x", "2022-02-01"), ("r3", "a", "x", "2021-01-01"), ("r3", "b", "y", "2021-01-01")]
    df = spark.createDataFrame(runs, "run_id string, model_name string, prompt_type string, d string").withColumn("run_timestamp", F.to_timestamp("d"))
    assert readers.latest_run(df, ["a", "b"], ["x"]).first().run_id == "r1" and readers.latest_run(df, ["c"], ["x"]).first().run_id is None
    a, b = (grid.run_id(["m"], ["p"], spark.createDataFrame([(i,) for i in ids], "question_id int")).first().run_id for ids in ([1, 2, 2, None], [2, 1]))
    assert a == b and a != grid.run_id(["m"], ["p"], spark.range(3).toDF("question_id")).first().run_id


def test_generated_corpus(spark):
    df = generate.generate(spark, 3000)
    rows = df.collect()
    assert rows == generate.generate(spark, 3000).collect() and 2000 < len(rows) <= 3000 and not any("{" in r.question + r.solution for r in rows)
    for r in rows[:300]:
        n = [int(x) for x in __import__("re").findall(r"\d+", r.question)]
        if r.question_type == "số học":
            assert r.solution == f"{n[0]} + {n[1]} = {sum(n)}"
        if r.question_type == "josephus":
            circle, at = list(range(1, n[0] + 1)), 0
            while len(circle) > 1:
                at = (at + n[1] - 1) % len(circle)
                circle.pop(at)
            assert r.solution == f"Người thứ {circle[0]}"
    counts = {r.question_type: r["count"] for r in df.groupBy("question_type").count().collect()}
    assert counts["số học"] > counts["chuyển động"]


def test_streamed_batches_and_history(spark, tmp_path):
    schema = "model_name string, ts timestamp"
    source = str(tmp_path / "in")
    rows = lambda seconds: spark.createDataFrame([("m", s) for s in seconds], "model_name string, s int").selectExpr("model_name", "timestamp_seconds(s) AS ts").coalesce(1)
    rows(range(0, 40, 2)).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for _ in range(2):
        ingest.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    q = ingest.retry_history(stream).writeStream.format("memory").queryName("history").outputMode("update").option("checkpointLocation", str(tmp_path / "h")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("history").collect()] == [("m", 10, 2.0)]
