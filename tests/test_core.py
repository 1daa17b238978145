import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scoreloom.functions import scoring as sc
from scoreloom.functions import text as tx
from scoreloom.functions.numbers import clamp01, fraction_equal, gcd, number_equal, row_mean
from scoreloom.operators import aggregates as ag
from scoreloom.operators import grid, windows
from scoreloom.plans import inference
from scoreloom.sources import readers, sinks
from scoreloom.streaming import ingest

ROWS = "model_name string, question_id string, answer string, id bigint"


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_consistency_cases(spark):
    cases = {"a": ["7"] * 3, "b": ["6", "9", "6"], "c": ["P", "Q", "R", "S", "P"], "d": ["Z"], "e": [None, None]}
    rows = [("m", q, a, i) for q, answers in cases.items() for i, a in enumerate(answers)]
    out = {r.question_id: r for r in ag.consistency(spark.createDataFrame(rows, ROWS), ["model_name", "question_id"], "answer", "id").collect()}
    assert set(out) == {"a", "b", "c"}
    assert [out[q].consistency_score for q in "abc"] == [1.0, pytest.approx(2 / 3, abs=1e-6), 0.4]
    assert [out[q].unique_answers for q in "abc"] == [1, 2, 4]
    assert [out[q].most_common for q in "abc"] == ["7", "6", "P"]


def test_percentages_total_100(spark):
    rows = spark.createDataFrame([("m", random.Random(i).choice(["A", "B", "C"])) for i in range(60)], "model_name string, error_type string")
    assert ag.error_distribution(rows, ["model_name"]).agg(F.sum("percent")).first()[0] == pytest.approx(100, abs=1e-4)


def test_auc_counts_ties_half(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(300)]
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = ag.auc(spark.createDataFrame(rows, "t boolean, s double"), F.col("t"), "s").first().auc
    assert got == pytest.approx(want, abs=1e-6)


def test_running_totals(spark):
    rows = [(float(x), 1) for x in random.Random(2).sample(range(1000), 200)]
    out = ag.running_totals(spark.createDataFrame(rows, "s double, n int"), "s", ["n"]).orderBy("s").collect()
    assert [r.before_n for r in out] == list(range(200))


def test_number_helpers(spark):
    assert one(spark, number_equal(F.lit(100.0), F.lit(101.0))) and not one(spark, number_equal(F.lit(0.5), F.lit(0.6)))
    assert one(spark, fraction_equal(F.lit(2), F.lit(4), F.lit(1), F.lit(2))) and one(spark, fraction_equal(F.lit(1), F.lit(0), F.lit(1), F.lit(2))) is None
    assert one(spark, gcd(F.lit(462), F.lit(1071))) == 21
    assert one(spark, clamp01(F.lit(1.5))) == 1.0
    assert one(spark, row_mean("a", "b"), a=1.0, b=3.0) == 2.0


def test_text_functions(spark):
    assert one(spark, tx.clean_text(F.lit("  Xin CHÀO,  bạn! 12 "), numbers=True)) == "xin chào bạn"
    assert one(spark, tx.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.remove_diacritics(F.lit("Đường Nguyễn Huệ"))) == "Đuong Nguyen Hue"
    assert one(spark, tx.numbers(F.lit("có 3,5 và -2 và 7."))) == [3.5, -2.0, 7.0]
    assert one(spark, tx.normalize_spacing(F.lit("a ,b( c )"))) == "a, b(c)"
    assert one(spark, tx.sentences(F.lit("Một câu. Hai câu! Số 3. 4 nữa?"))) == ["Một câu.", "Hai câu!", "Số 3.", "4 nữa?"]
    assert one(spark, tx.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["a b", "b c"]
    assert one(spark, tx.final_answer(F.lit("x\nFinal answer: 42\n\ny"))) == "42"
    assert one(spark, tx.normalize_answer(F.lit(" Là 12 quả!"))) == "12"
    assert one(spark, tx.prompt_category(F.lit("few_shot_3"))) == "Few-shot"
    assert one(spark, tx.levenshtein_ratio(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)


def test_scores(spark):
    overlap = one(spark, sc.token_overlap(F.lit("a b b c"), F.lit("b b d")))
    assert (overlap.precision, overlap.recall) == (0.5, pytest.approx(2 / 3))
    assert one(spark, sc.token_overlap(F.lit(""), F.lit("a"))) is None
    assert one(spark, sc.exact_match(F.lit("A!"), F.lit("a"))) and one(spark, sc.exact_match(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(spark, sc.relaxed_match(F.lit("đáp số là 5"), F.lit("đáp số 5")))
    assert one(spark, sc.rouge_n(F.lit("a b c"), F.lit("a b c"), 2)).f == 1.0
    assert one(spark, sc.any_number_match(F.lit("có 100"), F.lit("101")))
    assert one(spark, sc.react_cycles(F.lit("Think: a Act: b Observe: c Think: d Act: e"))) == 1
    assert one(spark, sc.error_class(F.lit("3. Lỗi"))) == "Calculation Error"
    assert one(spark, sc.judge_scores(F.lit('{"accuracy": 4, "reasoning": 2}{"x": 1}'), ("accuracy", "reasoning"))).average == 3.0
    assert one(spark, sc.completeness_score(F.lit("Điểm: 7/10"))) == 0.7
    assert one(spark, sc.vector_cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_arrow_scores_against_brute_force():
    from scoreloom.functions.udfs import lcs_length, meteor_exact, sentence_bleu

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert lcs_length(a, b) == slow(a, b)
    same = "the cat sat on the mat".split()
    assert sentence_bleu(same, same) == pytest.approx(1.0) and sentence_bleu([], same) == 0.0
    assert 0.9 < meteor_exact(same, same) <= 1.0 and meteor_exact(["x"], same) == 0.0


def test_rolling_needs_five_rows(spark):
    df = spark.createDataFrame([("m", i, float(i)) for i in range(7)], "k string, t int, v double")
    out = [r.rolling_mean for r in windows.rolling(df, "k", ["t"], "v").orderBy("t").collect()]
    assert out == [None] * 4 + [2.0, 3.0, 4.0]


def test_grid_and_pending(spark):
    models, prompts = spark.createDataFrame([("a",), ("b",)], "model_name string"), spark.createDataFrame([("x",)], "prompt_type string")
    questions = spark.createDataFrame([(1,), (2,)], "question_id bigint")
    full = grid.full_grid(models, prompts, questions)
    done = spark.createDataFrame([("a", "x", 1), ("a", "x", 1)], "model_name string, prompt_type string, question_id bigint")
    assert full.count() == 4 and {tuple(r) for r in grid.pending(full, done).collect()} == {("a", "x", 2), ("b", "x", 1), ("b", "x", 2)}


def test_generation_keeps_failures_as_results(spark):
    def backend(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "prompt string").coalesce(1)
    out = {r.prompt: r.response for r in inference.generate(df, "prompt", backend, batch=1).collect()}
    assert out == {"ok": "OK", "bad": "[Error: no answer]", None: None}


def test_prompts(spark):
    examples = F.array(*(F.struct(F.lit(f"q{i}").alias("question"), F.lit(f"a{i}").alias("answer")) for i in range(5)))
    text = one(spark, inference.prompt(F.lit("Q"), F.lit("few_shot_3"), examples))
    assert "q2" in text and "q3" not in text and text.index("q2") < text.index("Q")
    assert "5" in one(spark, inference.prompt(F.lit("Q"), F.lit("cot_self_consistency_5"))) and one(spark, inference.prompt(F.lit("Q"), F.lit("other"))) is None


def test_question_files(spark, tmp_path):
    rows = '[{"id": 1, "question": "a", "solution": "s", "answer": "t"}, {"id": 2, "text": "b"}, {"id": 3}, {"question": "c"}]'
    texts = {"array": rows, "object": '{"total": 4, "questions": ' + rows + "}", "lines": '{"id": 1, "question": "a", "answer": "s"}\n{"id": 2, "text": "b"}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = {(r.id, r.question, r.solution, r.question_type) for r in readers.read_questions(spark, str(tmp_path / f"{name}.json")).collect()}
        assert got == {("1", "a", "s", "general"), ("2", "b", None, "general")}, name


def test_nested_results_checkpoints_and_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"llama_cot_3": [{"question": "q", "answer": "hello"}, {"response": "[Error: x]"}]}')
    row = readers.read_nested_results(spark, str(tmp_path / "r.json")).collect()
    assert [(r.model_name, r.prompt_type, r.response, r.response_length) for r in row] == [("llama", "cot_3", "hello", 5)]
    df = spark.createDataFrame([("a", "x", 1, True), ("b", "x", 1, False)], "model_name string, prompt_type string, question_id bigint, is_correct boolean")
    for batch in (1, 1, 2):
        sinks.append_checkpoint(df, str(tmp_path / "c"), "run1", batch)
    saved = sinks.read_checkpoint(spark, str(tmp_path / "c"), "run1")
    assert saved.count() == 4 and sinks.checkpoint_info(saved).first().n_combinations == 2
    assert "| a | 1 | 1 | 1.0000 |" in sinks.markdown_report(df) and "<h1>" in sinks.html_report(df)
    sinks.save_results(df, str(tmp_path / "out"))
    assert all(spark.read.format(f).load(str(tmp_path / "out" / f)).count() > 0 for f in ("parquet", "json", "csv"))
    files = readers.list_files(spark, str(tmp_path / "out"), "*.parquet", True)
    assert files.count() > 0 and readers.latest_checkpoint(files, "part").first().path and sinks.expired(files, 0).count() == files.count()


def test_stream_delivers_once_and_resumes(spark, tmp_path):
    schema = "model_name string, prompt_type string, question_id bigint, run_timestamp timestamp"
    rows = lambda ids: spark.createDataFrame([("m", "p", i) for i in ids], "model_name string, prompt_type string, question_id bigint").withColumn("run_timestamp", F.to_timestamp(F.lit("2022-01-05 10:00:00")))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for ids in ([1, 2, 2], [2, 3]):
        rows(ids).write.mode("append").parquet(source)
        ingest.append(ingest.result_stream(spark, source, "*.parquet", schema), out, state).awaitTermination()
    assert Counter(r.question_id for r in spark.read.parquet(out).collect()) == {1: 1, 2: 1, 3: 1}


def test_sessions_and_windows(spark):
    ts = [0, 10, 20, 60, 200]
    df = spark.createDataFrame([(1, m, "a", 1.0) for m in ts], "user_id bigint, m int, event_type string, value double").selectExpr("*", "timestamp'2022-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0) AS ts")
    assert sorted(r.n_events for r in ingest.sessions(df, "ts").collect()) == [1, 1, 3]
    assert ingest.windowed(df, "ts").agg(F.sum("n")).first()[0] == 5 and ingest.windowed(df, "ts", slide="30 minutes").agg(F.sum("n")).first()[0] == 10


def test_registry_is_whole():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 150 and "p5_found" in q


def test_empty_input(spark):
    empty = spark.createDataFrame([], "model_name string, is_correct boolean, latency double, response string, error_type string")
    assert ag.basic_metrics(empty).first().n_rows == 0 and ag.group_metrics(empty, ["model_name"]).count() == 0
    assert ag.error_distribution(empty, []).count() == 0 and math.isclose(1.0, 1.0)
