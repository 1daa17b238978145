"""Queries of the group-by analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.functions.numbers import correlation, round6
from scoreloom.operators import aggregates as ag
from scoreloom.plans.base import LEGACY_SCORES, SCORES, P, R, legacy, query, results
from scoreloom.sources.tables import table

#: Levels of difficulty from easy to hard, context prompts.
LEVELS = ("Dễ", "Trung bình", "Khó")
CONTEXT = ("few_shot_3", "few_shot_5", "few_shot_7", "react")
CRITERIA = ("reasoning_accuracy", "reasoning_reasoning", "reasoning_completeness", "reasoning_explanation", "reasoning_cultural_context")
SIMILARITY = ("f1_score", "meteor_score", "bert_score", "rouge1_f", "rougel_f", "bleu")
MODELS = ("gemini", "groq", "llama", "openai", "qwen")


def r6(x: str) -> str:
    return f"round(({x}) + 1e-10, 6) + 0.0"


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_GROUP = (
    f"count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy, {r6('avg(latency)')} AS average_latency, max(latency) AS max_latency, min(latency) AS min_latency"
)


def _where(keys) -> str:
    return " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"


@query("a01_basic_metrics", f"WITH {R} SELECT count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy, {r6('avg(latency)')} AS average_latency, max(latency) AS max_latency, min(latency) AS min_latency, {r6('avg(length(response)::DOUBLE)')} AS average_response_length FROM r")
def a01(spark, folder):
    return ag.basic_metrics(results(spark, folder))


def _grouped(name: str, *keys: str) -> None:
    sql = f"WITH {R} SELECT {', '.join(keys)}, {_GROUP} FROM r WHERE {_where(keys)} GROUP BY {', '.join(keys)}"
    query(name, sql)(lambda spark, folder: ag.group_metrics(results(spark, folder), keys))


_grouped("metrics_by_model_prompt", "model_name", "prompt_type")
_grouped("a03_accuracy_by_model", "model_name")
_grouped("a04_accuracy_by_prompt", "prompt_type")
_grouped("a06_accuracy_by_type", "question_type")
_grouped("a09_accuracy_by_difficulty", "difficulty")
_grouped("a55_model_prompt_difficulty", "model_name", "prompt_type", "difficulty")
_grouped("a77_type_by_model", "question_type", "model_name")


def _pivot(name: str, row: str, column: str, metric: str, expr=None, fill: float | None = None) -> None:
    value = r6(f"avg({metric})")
    value = value if fill is None else f"coalesce({value}, {fill}::DOUBLE)"
    sql = f"WITH {R} SELECT {row}, {column}, count(*) AS n_rows, {value} AS value FROM r WHERE {_where((row, column))} GROUP BY {row}, {column}"
    query(name, sql)(lambda spark, folder: ag.pivot_cells(results(spark, folder), row, column, expr() if expr else F.col(metric), fill))


_correct_sql = "is_correct::INT::DOUBLE"


def _correct():
    return F.col("is_correct").cast("double")


# Pivots come out as their cells, for every value of both sides.
_pivot("a05_accuracy_pivot", "model_name", "prompt_type", _correct_sql, _correct)
_pivot("a09_model_difficulty_pivot", "model_name", "difficulty", _correct_sql, _correct)
_pivot("a09_prompt_difficulty_pivot", "prompt_type", "difficulty", _correct_sql, _correct)
_pivot("a44_length_pivot", "model_name", "prompt_type", "length(response)::DOUBLE", lambda: F.length("response").cast("double"))
_pivot("a70_latency_pivot", "model_name", "prompt_type", "latency", fill=0.0)
_pivot("a70_topic_pivot", "model_name", "question_type", _correct_sql, _correct, 0.0)
_pivot("a75_reasoning_pivot", "model_name", "prompt_type", "reasoning_average", fill=0.0)
_pivot("a83_latency_heatmap", "model_name", "difficulty", "latency")
for _m in ("f1_score", "meteor_score", "bert_score", "exact_match", "rouge1_f", "bleu"):
    _pivot(f"a78_{_m}_pivot", "model_name", "prompt_type", _m)


@query("r01_criteria_by_level", f"WITH {R} SELECT model_name, " + ", ".join(f"""{r6(f"avg(reasoning_average) FILTER (WHERE difficulty = '{v}')")} AS "{v}" """ for v in LEVELS) + " FROM r WHERE model_name IS NOT NULL GROUP BY model_name")
def r01(spark, folder):
    """A wide pivot over the three levels that are defined; other difficulties have no column."""
    return ag.pivot_metric(results(spark, folder), "model_name", "difficulty", F.col("reasoning_average"), values=LEVELS)


def _case(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + " END"


@query(
    "a10_difficulty_deltas",
    f"""WITH {R}, a AS (SELECT model_name, difficulty, avg(is_correct::INT::DOUBLE) AS acc, {_case('difficulty', LEVELS)} AS rank FROM r
        WHERE difficulty IN {_listed(LEVELS)} AND model_name IS NOT NULL GROUP BY ALL),
      d AS (SELECT model_name, lag(difficulty) OVER w AS easier, difficulty AS harder, {r6('acc - lag(acc) OVER w')} AS delta FROM a WINDOW w AS (PARTITION BY model_name ORDER BY rank))
      SELECT * FROM d WHERE easier IS NOT NULL""",
)
def a10(spark, folder):
    return ag.difficulty_deltas(results(spark, folder), LEVELS)


_IN_CONTEXT = f"coalesce(prompt_type IN {_listed(CONTEXT)}, false)"
_CONTEXT_AVG, _PLAIN_AVG = f"avg(is_correct::INT::DOUBLE) FILTER (WHERE {_IN_CONTEXT})", f"avg(is_correct::INT::DOUBLE) FILTER (WHERE NOT {_IN_CONTEXT})"


@query(
    "a11_context_adherence",
    f"""WITH {R} SELECT model_name, {r6(_CONTEXT_AVG)} AS context_accuracy, {r6(_PLAIN_AVG)} AS plain_accuracy, {r6(f'coalesce({_CONTEXT_AVG} - {_PLAIN_AVG}, 0.0)')} AS delta,
      {r6('avg(reasoning_cultural_context)')} AS cultural_average, max(reasoning_cultural_context) AS cultural_max, min(reasoning_cultural_context) AS cultural_min
      FROM r WHERE model_name IS NOT NULL GROUP BY model_name""",
)
def a11(spark, folder):
    return ag.context_adherence(results(spark, folder), F.coalesce(F.col("prompt_type").isin(*CONTEXT), F.lit(False)))


def _f1(name: str, *keys: str) -> None:
    a = "avg(is_correct::INT::DOUBLE)"
    sql = f"WITH {R} SELECT {', '.join(keys)}, {r6(a)} AS precision, CASE WHEN {a} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall, {r6(f'coalesce(2 * {a} / (1 + {a}), 0.0)')} AS f1 FROM r WHERE {_where(keys)} GROUP BY {', '.join(keys)}"
    query(name, sql)(lambda spark, folder: ag.f1_closed_form(results(spark, folder), keys))


_f1("a12_f1_by_model", "model_name")
_f1("a12_f1_by_model_prompt", "model_name", "prompt_type")
_f1("a13_f1_by_type", "question_type")


def _errors(name: str, *keys: str) -> None:
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    sql = f"WITH {R}, c AS (SELECT {k}error_type, count(*) AS n_errors FROM r WHERE error_type IS NOT NULL AND {_where(keys)} GROUP BY {k}error_type) SELECT {k}error_type, n_errors, {r6(f'100.0::DOUBLE * n_errors / sum(n_errors) OVER ({part})')} AS percent FROM c"
    query(name, sql)(lambda spark, folder: ag.error_distribution(results(spark, folder), keys))


_errors("a14_error_distribution")
_errors("a15_errors_by_model", "model_name")
_errors("a15_errors_by_prompt", "prompt_type")
_errors("a15_errors_by_model_prompt", "model_name", "prompt_type")
_errors("a62_errors_by_topic", "question_type")


@query("a15_error_ladder", f"WITH {R} SELECT model_name, prompt_type, error_type, grouping(model_name, prompt_type, error_type)::BIGINT AS level, count(*) AS n_errors FROM r WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL AND error_type IS NOT NULL GROUP BY CUBE (model_name, prompt_type, error_type)")
def a15_ladder(spark, folder):
    return ag.ladder(results(spark, folder), ["model_name", "prompt_type", "error_type"], F.count("*").alias("n_errors"))


def _means(name: str, metrics, *keys: str) -> None:
    sql = f"WITH {R} SELECT {', '.join(keys)}, count(*) AS n_rows, " + ", ".join(f"{r6(f'avg({m}::DOUBLE)')} AS {m}" for m in metrics) + f" FROM r WHERE {_where(keys)} GROUP BY {', '.join(keys)}"
    query(name, sql)(lambda spark, folder: ag.group_means(results(spark, folder), keys, metrics))


_means("a16_reasoning_by_type", (*CRITERIA, "reasoning_average"), "question_type")
_means("a39_quality_by_model", ("f1_score", "meteor_score", "bert_score"), "model_name")
_means("a38_text_metrics_by_model_prompt", ("bleu", "rouge1_f", "rouge2_f", "rougel_f", "f1_score", "meteor_score", "bert_score"), "model_name", "prompt_type")
_means("a66_reasoning_by_prompt_model", ("reasoning_average",), "prompt_type", "model_name")
_means("a98_metrics_by_prompt", ("exact_match", "f1_score", "latency"), "prompt_type")


@query(
    "a18_completeness_ladder",
    f"""WITH {R} SELECT model_name, prompt_type, grouping(model_name, prompt_type)::BIGINT AS level, {r6('avg(reasoning_completeness / 5)')} AS average, {r6('avg(CASE WHEN reasoning_completeness / 5 >= 0.8 THEN 1.0::DOUBLE WHEN reasoning_completeness IS NOT NULL THEN 0.0::DOUBLE END)')} AS complete_share
      FROM r WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY CUBE (model_name, prompt_type)""",
)
def a18(spark, folder):
    score = F.col("reasoning_completeness") / 5
    return ag.ladder(results(spark, folder), ["model_name", "prompt_type"], round6(F.avg(score)).alias("average"), round6(F.avg((score >= 0.8).cast("double"))).alias("complete_share"))


@query(
    "a19_similarity_ladder",
    f"""WITH {R} SELECT model_name, prompt_type, grouping(model_name, prompt_type)::BIGINT AS level, {r6('avg(rouge1_f)')} AS mean, {r6('quantile_cont(rouge1_f, 0.5)')} AS median, {r6('stddev_samp(rouge1_f)')} AS std, min(rouge1_f) AS min, max(rouge1_f) AS max
      FROM r WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY CUBE (model_name, prompt_type)""",
)
def a19(spark, folder):
    return ag.median_ladder(results(spark, folder), ["model_name", "prompt_type"], "rouge1_f")


def _corr_sql(metrics, least: int = 5) -> str:
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    one = " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, count(*) AS n, CASE WHEN count(*) > {least} THEN {r6(f'corr({a}, {b})')} END AS correlation FROM r2 WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs
    )
    return f"WITH {R}, r2 AS (SELECT *, is_correct::INT::DOUBLE AS correct FROM r) {one}"


@query("a20_correlation_with_correctness", _corr_sql(("correct", "rouge1_f")))
def a20(spark, folder):
    return ag.correlations(results(spark, folder).withColumn("correct", _correct()), ("correct", "rouge1_f"))


@query("a21_pairwise_correlations", _corr_sql(("correct", *SIMILARITY)))
def a21(spark, folder):
    return ag.correlations(results(spark, folder).withColumn("correct", _correct()), ("correct", *SIMILARITY))


_COMPLETE = " AND ".join(f"{m} IS NOT NULL" for m in SIMILARITY)


@query("a23_metric_correlations", _corr_sql(SIMILARITY, 4).replace("FROM r) ", f"FROM r WHERE {_COMPLETE}) ", 1))
def a23(spark, folder):
    """Correlations over the rows that have every metric."""
    return ag.complete_correlations(results(spark, folder), SIMILARITY)


_BUCKETS = ("Rất thấp", "Thấp", "Cao", "Rất cao")


@query(
    "a22_accuracy_by_quartile",
    f"""WITH {R}, e AS (SELECT quantile_cont(f1_score, 0.25) AS a, quantile_cont(f1_score, 0.5) AS b, quantile_cont(f1_score, 0.75) AS c FROM r)
      SELECT CASE WHEN f1_score <= a THEN 'Rất thấp' WHEN f1_score <= b THEN 'Thấp' WHEN f1_score <= c THEN 'Cao' ELSE 'Rất cao' END AS bucket, count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy
      FROM r, e WHERE f1_score IS NOT NULL GROUP BY 1""",
)
def a22(spark, folder):
    return ag.accuracy_by_quartile(results(spark, folder), "f1_score", _BUCKETS)


#: Self-consistency: answers of one question by one model over the samples of a prompt family.
_BASE = "regexp_replace(prompt_type, '_[0-9]+$', '')"
_ANSWER = "nullif(regexp_extract(lower(response), '[0-9]+(?:[.,][0-9]+)*[^0-9]*$', 0), '')"
_NUMBER = f"nullif(regexp_extract({_ANSWER}, '[0-9]+(?:[.,][0-9]+)*', 0), '')"
_CONSISTENCY = f"""c AS (SELECT model_name, question_id, {_BASE} AS base_prompt, {_NUMBER} AS answer, result_id FROM r WHERE prompt_type IS NOT NULL AND model_name IS NOT NULL AND question_id IS NOT NULL),
  n AS (SELECT model_name, question_id, base_prompt, answer, count(*) AS n, min(result_id) AS first FROM c WHERE answer IS NOT NULL GROUP BY ALL),
  g AS (SELECT model_name, question_id, base_prompt, sum(n)::BIGINT AS n_answers, count(*) AS unique_answers, arg_max(answer, (n, -first)) AS most_common, max(n) AS top FROM n GROUP BY ALL),
  s AS (SELECT model_name, question_id, base_prompt, n_answers, unique_answers, most_common, {r6('top / n_answers')} AS agreement_rate, {r6('CASE WHEN unique_answers = 1 THEN 1.0::DOUBLE ELSE top / n_answers END')} AS consistency_score FROM g WHERE n_answers > 1)"""
_KEYS = ("model_name", "question_id", "base_prompt")


def _answers(spark, folder):
    number = F.nullif(F.regexp_extract(F.regexp_extract(F.lower("response"), r"[0-9]+(?:[.,][0-9]+)*[^0-9]*$", 0), r"[0-9]+(?:[.,][0-9]+)*", 0), F.lit(""))
    df = results(spark, folder).where(F.col("prompt_type").isNotNull())
    return df.select("result_id", "model_name", "question_id", F.regexp_replace("prompt_type", "_[0-9]+$", "").alias("base_prompt"), number.alias("answer"))


@query("a24_consistency", f"WITH {R}, {_CONSISTENCY} SELECT * FROM s")
def a24(spark, folder):
    return ag.consistency(_answers(spark, folder), _KEYS, "answer", "result_id")


@query("a25_consistency_write_back", f"WITH {R}, {_CONSISTENCY} SELECT result_id, s.consistency_score, s.agreement_rate FROM c LEFT JOIN s USING (model_name, question_id, base_prompt)")
def a25(spark, folder):
    rows = _answers(spark, folder).where(F.col("model_name").isNotNull() & F.col("question_id").isNotNull())
    groups = ag.consistency(rows, _KEYS, "answer", "result_id")
    return ag.write_back(rows, groups, _KEYS, ["consistency_score", "agreement_rate"]).select("result_id", "consistency_score", "agreement_rate")


@query("a17_consistency_ladder", f"WITH {R}, {_CONSISTENCY} SELECT model_name, base_prompt, grouping(model_name, base_prompt)::BIGINT AS level, {r6('avg(consistency_score)')} AS score, {r6('avg(agreement_rate)')} AS agreement, count(*) AS n_groups FROM s GROUP BY CUBE (model_name, base_prompt)")
def a17(spark, folder):
    groups = ag.consistency(_answers(spark, folder), _KEYS, "answer", "result_id")
    return ag.ladder(groups, ["model_name", "base_prompt"], round6(F.avg("consistency_score")).alias("score"), round6(F.avg("agreement_rate")).alias("agreement"), F.count("*").alias("n_groups"))


@query("a26_consistency_overall", f"WITH {R}, {_CONSISTENCY} SELECT count(*) AS n_groups, {r6('avg(consistency_score)')} AS consistency FROM s")
def a26(spark, folder):
    groups = ag.consistency(_answers(spark, folder), _KEYS, "answer", "result_id")
    return groups.agg(F.count("*").alias("n_groups"), round6(F.avg("consistency_score")).alias("consistency"))


_RATIO = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


@query(
    "a27_binary_metrics",
    f"""WITH {R}, c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn
        FROM (SELECT is_correct AS t, f1_score >= 0.5 AS p FROM r) WHERE t IS NOT NULL AND p IS NOT NULL),
      m AS (SELECT *, {_RATIO('tp', 'tp + fp')} AS pr, {_RATIO('tp', 'tp + fn')} AS re FROM c)
      SELECT tp, fp, fn, tn, {r6(_RATIO('tp + tn', 'tp + fp + fn + tn'))} AS accuracy, {r6('pr')} AS precision, {r6('re')} AS recall, {r6(_RATIO('2 * pr * re', 'pr + re'))} AS f1 FROM m""",
)
def a27(spark, folder):
    return ag.binary_metrics(results(spark, folder), F.col("is_correct"), F.col("f1_score") >= 0.5)


@query(
    "a27_auc",
    f"""WITH {R}, s AS (SELECT is_correct AS t, f1_score AS s FROM r WHERE is_correct IS NOT NULL AND f1_score IS NOT NULL),
      g AS (SELECT s, count(*) FILTER (WHERE t) AS pos, count(*) FILTER (WHERE NOT t) AS neg FROM s GROUP BY s),
      b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
      SELECT sum(pos)::BIGINT AS n_positive, sum(neg)::BIGINT AS n_negative, {r6('sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)')} AS auc FROM b""",
)
def a27_auc(spark, folder):
    return ag.auc(results(spark, folder), F.col("is_correct"), "f1_score")


_TRUE_PRED = "SELECT t, p, count(*) AS n FROM (SELECT question_type AS t, q2 AS p FROM (SELECT r.question_type, q.question_type AS q2 FROM r JOIN questions q USING (question_id))) WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY t, p"
_LABELS = f"""cells AS ({_TRUE_PRED}),
  labels AS (SELECT label, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(pred)::BIGINT AS n_predicted FROM (
    SELECT t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, n AS support, 0 AS pred FROM cells UNION ALL SELECT p, 0, 0, n FROM cells) GROUP BY label),
  pl AS (SELECT label, support, {r6(_RATIO('tp', 'n_predicted'))} AS precision, {r6(_RATIO('tp', 'support'))} AS recall,
    {r6(_RATIO(f"2 * ({_RATIO('tp', 'n_predicted')}) * ({_RATIO('tp', 'support')})", f"({_RATIO('tp', 'n_predicted')}) + ({_RATIO('tp', 'support')})"))} AS f1 FROM labels)"""


def _typed_pairs(spark, folder):
    rows = results(spark, folder).select("question_id", F.col("question_type").alias("truth"))
    asked = table(spark, folder, "questions").select("question_id", F.col("question_type").alias("predicted"))
    return rows.join(asked, "question_id")


@query("a28_multiclass_by_label", f"WITH {R}, {_LABELS} SELECT * FROM pl")
def a28(spark, folder):
    return ag.multiclass_metrics(_typed_pairs(spark, folder), "truth", "predicted")


@query(
    "a28_multiclass_average",
    f"WITH {R}, {_LABELS} SELECT " + ", ".join(f"{r6(f'avg({c})')} AS macro_{c}, {r6(f'sum({c} * support) / nullif(sum(support), 0)')} AS weighted_{c}" for c in ("precision", "recall", "f1")) + " FROM pl",
)
def a28_average(spark, folder):
    return ag.multiclass_average(ag.multiclass_metrics(_typed_pairs(spark, folder), "truth", "predicted"))


@query("a86_confusion_matrix", f"WITH {R}, cells AS ({_TRUE_PRED}) SELECT t AS truth, p AS predicted, n, {r6('n / sum(n) OVER (PARTITION BY t)')} AS row_share FROM cells")
def a86(spark, folder):
    rows = _typed_pairs(spark, folder).where(F.col("truth").isNotNull() & F.col("predicted").isNotNull())
    cells = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    totals = cells.groupBy("truth").agg(F.sum("n").alias("total"))
    return cells.join(totals, "truth").select("truth", "predicted", "n", round6(F.col("n") / F.col("total")).alias("row_share"))


@query(
    "a29_regression_metrics",
    f"""WITH {R}, s AS (SELECT bert_score AS y, f1_score AS p, bert_score - f1_score AS e FROM r WHERE bert_score IS NOT NULL AND f1_score IS NOT NULL),
      c AS (SELECT count(*) AS n, avg(e * e) AS mse, avg(abs(e)) AS mae, var_pop(y) AS v, avg(CASE WHEN y <> 0 THEN abs(e / y) END) AS mape FROM s)
      SELECT n, {r6('mse')} AS mse, {r6('sqrt(mse)')} AS rmse, {r6('mae')} AS mae, {r6('CASE WHEN v > 0 THEN 1 - mse / v ELSE 0.0::DOUBLE END')} AS r2, {r6('100 * mape')} AS mape FROM c""",
)
def a29(spark, folder):
    return ag.regression_metrics(results(spark, folder), F.col("bert_score"), F.col("f1_score"))


@query(
    "a30_latency_percentiles",
    f"""WITH {R} SELECT model_name, count(*) AS n, {r6('avg(latency)')} AS mean, min(latency) AS min, max(latency) AS max, {r6('stddev_pop(latency)')} AS std, """
    + ", ".join(f"{r6(f'quantile_cont(latency, {p / 100})')} AS p{p}" for p in (50, 90, 95, 99))
    + " FROM r WHERE latency > 0 AND model_name IS NOT NULL GROUP BY model_name",
)
def a30(spark, folder):
    return ag.latency_stats(results(spark, folder), ["model_name"])


@query("a31_answer_correctness", f"WITH {R} SELECT model_name, count(exact_match) AS n, {r6('avg(CASE WHEN exact_match >= 0.999 THEN 1.0::DOUBLE WHEN exact_match IS NOT NULL THEN 0.0::DOUBLE END)')} AS correct_share, {r6('avg(exact_match)')} AS partial_score FROM r WHERE model_name IS NOT NULL GROUP BY model_name")
def a31(spark, folder):
    df = results(spark, folder).where(F.col("model_name").isNotNull())
    return df.groupBy("model_name").agg(F.count("exact_match").alias("n"), round6(F.avg((F.col("exact_match") >= 0.999).cast("double"))).alias("correct_share"), round6(F.avg("exact_match")).alias("partial_score"))


_WEIGHTS = (0.3, 0.3, 0.2, 0.1, 0.1)
_OVERALL = " + ".join(f"coalesce({c}, 0.0::DOUBLE) * {w / sum(_WEIGHTS)!r}::DOUBLE" for c, w in zip(CRITERIA, _WEIGHTS))


@query(
    "a32_judge_summary",
    f"WITH {R}, o AS (SELECT *, {_OVERALL} AS overall FROM r WHERE model_name IS NOT NULL) SELECT model_name, count(*) AS n, {r6('avg(overall)')} AS mean, {r6('min(overall)')} AS min, {r6('max(overall)')} AS max, {r6('stddev_samp(overall)')} AS std, "
    + ", ".join(f"{r6(f'avg(coalesce({c}, 0.0::DOUBLE))')} AS {c}_mean" for c in CRITERIA) + " FROM o GROUP BY model_name",
)
def a32(spark, folder):
    return ag.judge_summary(results(spark, folder), CRITERIA, _WEIGHTS, ["model_name"])


#: Legacy rows: an error text in the response marks a failed call.
_HAS_ERROR = "coalesce(contains(response, 'Error:') OR contains(response, '[Không thể tạo phản hồi'), true)"
_TPS = "CASE WHEN elapsed_time > 0 THEN response_length / greatest(0.1::DOUBLE, elapsed_time) ELSE 0.0::DOUBLE END"
_QUALITY = "0.6::DOUBLE * correctness_score + 0.4::DOUBLE * consistency_score"
PX = f"{P}, px AS (SELECT *, {_HAS_ERROR} AS has_error, {_TPS} AS tokens_per_second, {_QUALITY} AS quality_index FROM p)"


def scored(spark, folder):
    """Legacy rows with has_error, tokens_per_second and quality_index."""
    df = legacy(spark, folder)
    error = F.coalesce(F.col("response").contains("Error:") | F.col("response").contains("[Không thể tạo phản hồi"), F.lit(True))
    tps = F.when(F.col("elapsed_time") > 0, F.col("response_length") / F.greatest(F.lit(0.1), F.col("elapsed_time"))).otherwise(0.0)
    return df.withColumns({"has_error": error, "tokens_per_second": tps, "quality_index": 0.6 * F.col("correctness_score") + 0.4 * F.col("consistency_score")})


def _statistics(name: str, *keys: str) -> None:
    full = ", ".join(f"{r6(f'{f}({c}::DOUBLE)')} AS {c}_{n}" for c in ("elapsed_time", "response_length") for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))
    means = ", ".join(f"{r6(f'avg({c}{cast}::DOUBLE)')} AS {c}" for c, cast in (("has_error", "::INT"), ("tokens_per_second", ""), ("correctness_score", ""), ("quality_index", "")))
    query(name, f"WITH {PX} SELECT {', '.join(keys)}, count(*) AS n_rows, {full}, {means} FROM px WHERE {_where(keys)} GROUP BY {', '.join(keys)}")(
        lambda spark, folder: ag._known(scored(spark, folder), keys).groupBy(*keys).agg(
            F.count("*").alias("n_rows"),
            *(round6(f(F.col(c).cast("double"))).alias(f"{c}_{n}") for c in ("elapsed_time", "response_length") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))),
            *(round6(F.avg(F.col(c).cast("double"))).alias(c) for c in ("has_error", "tokens_per_second", "correctness_score", "quality_index")),
        )
    )


_statistics("a40_model_statistics", "model_name")
_statistics("a41_prompt_statistics", "prompt_type")
_statistics("a42_combined_statistics", "model_name", "prompt_type")


@query("a43_error_rate_pivot", f"WITH {PX} SELECT model_name, prompt_type, count(*) AS n_rows, {r6('avg(100.0::DOUBLE * has_error::INT)')} AS value FROM px WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL")
def a43(spark, folder):
    return ag.pivot_cells(scored(spark, folder), "model_name", "prompt_type", 100 * F.col("has_error").cast("double"))


@query("a71_error_rate_by_model", f"WITH {PX} SELECT model_name, count(*) AS n_rows, {r6('avg(100.0::DOUBLE * has_error::INT)')} AS error_rate FROM px WHERE model_name IS NOT NULL GROUP BY model_name")
def a71(spark, folder):
    return ag._known(scored(spark, folder), ["model_name"]).groupBy("model_name").agg(F.count("*").alias("n_rows"), round6(F.avg(100 * F.col("has_error").cast("double"))).alias("error_rate"))


@query(
    "a45_radar",
    f"""WITH {PX}, g AS (SELECT model_name, avg(elapsed_time) AS t, avg(has_error::INT::DOUBLE) AS e, avg(response_length::DOUBLE) AS l, avg(correctness_score) AS q FROM px WHERE model_name IS NOT NULL GROUP BY model_name)
      SELECT model_name, {r6('1 - t / max(t) OVER ()')} AS speed, {r6('1 - e')} AS reliability, {r6('l / max(l) OVER ()')} AS length, {r6('q / max(q) OVER ()')} AS quality FROM g""",
)
def a45(spark, folder):
    return ag.radar(scored(spark, folder), "model_name")


@query(
    "a46_minmax_means",
    f"WITH {R}, g AS (SELECT model_name, " + ", ".join(f"avg({m}) AS {m}" for m in SIMILARITY) + " FROM r WHERE model_name IS NOT NULL GROUP BY model_name), s AS (SELECT model_name, "
    + ", ".join(f"{r6(f'CASE WHEN max({m}) OVER () > min({m}) OVER () THEN ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) ELSE 0.5::DOUBLE END')} AS {m}" for m in SIMILARITY)
    + f" FROM g) UNPIVOT s ON {', '.join(SIMILARITY)} INTO NAME metric VALUE scaled",
)
def a46(spark, folder):
    return ag.minmax_means(results(spark, folder), "model_name", SIMILARITY)


@query(
    "a47_headline",
    f"""WITH {PX}, m AS (SELECT model_name, avg(correctness_score) AS q FROM px WHERE model_name IS NOT NULL GROUP BY 1), t AS (SELECT prompt_type, avg(correctness_score) AS q FROM px WHERE prompt_type IS NOT NULL GROUP BY 1)
      SELECT (SELECT count(*) FROM px) AS n_rows, (SELECT count(DISTINCT model_name) FROM px) AS n_models, (SELECT count(DISTINCT prompt_type) FROM px) AS n_prompts,
      (SELECT {r6('avg(has_error::INT::DOUBLE)')} FROM px) AS error_rate, (SELECT model_name FROM m ORDER BY q DESC NULLS LAST, model_name LIMIT 1) AS best_model, (SELECT prompt_type FROM t ORDER BY q DESC NULLS LAST, prompt_type LIMIT 1) AS best_prompt""",
)
def a47(spark, folder):
    df = scored(spark, folder)
    head = df.agg(F.count("*").alias("n_rows"), F.count_distinct("model_name").alias("n_models"), F.count_distinct("prompt_type").alias("n_prompts"), round6(F.avg(F.col("has_error").cast("double"))).alias("error_rate"))
    best = lambda k, name: df.where(F.col(k).isNotNull()).groupBy(k).agg(F.avg("correctness_score").alias("q")).orderBy(F.desc_nulls_last("q"), k).limit(1).select(F.col(k).alias(name))
    return head.crossJoin(F.broadcast(best("model_name", "best_model"))).crossJoin(F.broadcast(best("prompt_type", "best_prompt")))


@query(
    "a48_cost_efficiency",
    f"""WITH {PX}, g AS (SELECT model_name, avg(correctness_score) AS q, avg(elapsed_time) AS t, stddev_samp(elapsed_time) AS s FROM px WHERE model_name IS NOT NULL GROUP BY model_name)
      SELECT model_name, {r6('q / greatest(0.1::DOUBLE, t)')} AS cost_efficiency, {r6('100 - least(100.0::DOUBLE, 100 * s / greatest(0.1::DOUBLE, t))')} AS time_consistency, {r6('0.7::DOUBLE * q + 0.3::DOUBLE * (1 - t / max(t) OVER ())')} AS quality_speed_index FROM g""",
)
def a48(spark, folder):
    return ag.cost_efficiency(scored(spark, folder), "model_name")


@query("a49_useful_content", f"WITH {PX} SELECT model_name, {r6('1 - coalesce(sum(response_length) FILTER (WHERE has_error), 0) / greatest(1, coalesce(sum(response_length), 0))::DOUBLE')} AS useful_ratio FROM px WHERE model_name IS NOT NULL GROUP BY model_name")
def a49(spark, folder):
    errors, all_ = F.sum(F.when(F.col("has_error"), F.col("response_length"))), F.sum("response_length")
    df = scored(spark, folder).where(F.col("model_name").isNotNull())
    return df.groupBy("model_name").agg(round6(1 - F.coalesce(errors, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(all_, F.lit(0)))).alias("useful_ratio"))


@query("a50_stability", f"WITH {PX}, g AS (SELECT model_name, stddev_samp(correctness_score) AS s, stddev_samp(correctness_score) / nullif(avg(correctness_score), 0) AS cv FROM px WHERE model_name IS NOT NULL GROUP BY model_name) SELECT model_name, {r6('s')} AS std, {r6('cv')} AS cv, CASE WHEN cv < 0.3 THEN 'High' WHEN cv < 0.6 THEN 'Medium' WHEN cv IS NOT NULL THEN 'Low' END AS stability FROM g")
def a50(spark, folder):
    return ag.stability(scored(spark, folder), "model_name", "correctness_score")


@query("a51_bubble", f"WITH {PX}, g AS (SELECT model_name, avg(elapsed_time) AS t, avg(correctness_score) AS q, avg(response_length::DOUBLE) AS l FROM px WHERE model_name IS NOT NULL GROUP BY 1) SELECT model_name, {r6('t')} AS elapsed, {r6('q')} AS quality, {r6('1000 * l / max(l) OVER ()')} AS size FROM g")
def a51(spark, folder):
    g = scored(spark, folder).where(F.col("model_name").isNotNull()).groupBy("model_name").agg(F.avg("elapsed_time").alias("t"), F.avg("correctness_score").alias("q"), F.avg(F.col("response_length").cast("double")).alias("l"))
    top = g.agg(F.max("l").alias("ml"))
    return g.crossJoin(F.broadcast(top)).select("model_name", round6(F.col("t")).alias("elapsed"), round6(F.col("q")).alias("quality"), round6(1000 * F.col("l") / F.col("ml")).alias("size"))


@query("a52_error_crosstab", f"WITH {PX} SELECT model_name, prompt_type, count(*) FILTER (WHERE NOT has_error) AS n_without, count(*) FILTER (WHERE has_error) AS n_with FROM px WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL")
def a52(spark, folder):
    df = ag._known(scored(spark, folder), ["model_name", "prompt_type"])
    return df.groupBy("model_name", "prompt_type").agg(F.count_if(~F.col("has_error")).alias("n_without"), F.count_if("has_error").alias("n_with"))


@query("a80_error_shares", f"WITH {R}, c AS (SELECT model_name, error_type, count(*) AS n FROM r WHERE model_name IS NOT NULL AND error_type IS NOT NULL GROUP BY ALL) SELECT model_name, error_type, n, {r6('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY model_name)')} AS row_percent, {r6('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY error_type)')} AS column_percent FROM c")
def a80(spark, folder):
    cells = ag._known(results(spark, folder), ["model_name", "error_type"]).groupBy("model_name", "error_type").agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy("model_name").agg(F.sum("n").alias("r")), cells.groupBy("error_type").agg(F.sum("n").alias("c"))
    joined = cells.join(rows, "model_name").join(columns, "error_type")
    return joined.select("model_name", "error_type", "n", round6(100.0 * F.col("n") / F.col("r")).alias("row_percent"), round6(100.0 * F.col("n") / F.col("c")).alias("column_percent"))


@query("a79_consistency_pivot", f"WITH {R}, {_CONSISTENCY} SELECT model_name, base_prompt, count(*) AS n_rows, {r6('avg(consistency_score)')} AS score, {r6('avg(agreement_rate)')} AS agreement FROM s GROUP BY ALL")
def a79(spark, folder):
    groups = ag.consistency(_answers(spark, folder), _KEYS, "answer", "result_id")
    return groups.groupBy("model_name", "base_prompt").agg(F.count("*").alias("n_rows"), round6(F.avg("consistency_score")).alias("score"), round6(F.avg("agreement_rate")).alias("agreement"))


_FLAGS = "avg((coalesce(has_calculation_error, false))::INT::DOUBLE)"


@query(
    "a53_error_kinds",
    f"WITH {PX}, f AS (SELECT *, coalesce(has_calculation_error, false) AS c, coalesce(has_logic_error, false) AS l FROM px WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL) SELECT model_name, prompt_type, {r6('avg(c::INT::DOUBLE)')} AS calculation_rate, {r6('avg(l::INT::DOUBLE)')} AS logic_rate, {r6('avg((NOT c AND NOT l)::INT::DOUBLE)')} AS none_rate FROM f GROUP BY ALL",
)
def a53(spark, folder):
    c, l = F.coalesce("has_calculation_error", F.lit(False)), F.coalesce("has_logic_error", F.lit(False))
    df = ag._known(scored(spark, folder), ["model_name", "prompt_type"])
    return df.groupBy("model_name", "prompt_type").agg(round6(F.avg(c.cast("double"))).alias("calculation_rate"), round6(F.avg(l.cast("double"))).alias("logic_rate"), round6(F.avg((~c & ~l).cast("double"))).alias("none_rate"))


@query("a54_time_efficiency", f"WITH {PX}, g AS (SELECT model_name, prompt_type, avg(correctness_score) AS q, avg(elapsed_time) AS t, avg(num_reasoning_steps::DOUBLE) AS s FROM px WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL) SELECT model_name, prompt_type, {r6('CASE WHEN t > 0 THEN q / t ELSE 0.0::DOUBLE END')} AS time_efficiency, {r6('s')} AS average_steps FROM g")
def a54(spark, folder):
    g = ag._known(scored(spark, folder), ["model_name", "prompt_type"]).groupBy("model_name", "prompt_type").agg(F.avg("correctness_score").alias("q"), F.avg("elapsed_time").alias("t"), F.avg(F.col("num_reasoning_steps").cast("double")).alias("s"))
    return g.select("model_name", "prompt_type", round6(F.when(F.col("t") > 0, F.col("q") / F.col("t")).otherwise(0.0)).alias("time_efficiency"), round6(F.col("s")).alias("average_steps"))


_TAGS = "tags AS (SELECT px.*, trim(tag) AS tag FROM px, unnest(string_split(question_tags, ',')) AS u(tag))"


def _tagged(spark, folder):
    df = scored(spark, folder)
    return df.withColumn("tag", F.explode(F.split("question_tags", ","))).withColumn("tag", F.trim("tag")).where(F.col("tag") != "")


@query("a56_tag_analysis", f"WITH {PX}, {_TAGS} SELECT tag, model_name, prompt_type, count(*) AS n_rows, {r6('avg(correctness_score)')} AS correctness_score FROM tags WHERE tag <> '' AND model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL")
def a56(spark, folder):
    return ag.group_means(_tagged(spark, folder), ["tag", "model_name", "prompt_type"], ["correctness_score"])


#: Subjects and the tag patterns that belong to them; a row may have several.
SUBJECTS = {"arithmetic": "phép|cộng|chia|số", "algebra": "phương trình|tỷ số|tỷ lệ|nồng độ", "geometry": "hình|diện tích|chu vi", "logic": "tuổi|logic|thơ"}


@query(
    "a57_subject_slices",
    f"WITH {PX}, s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS subject, * FROM px WHERE regexp_matches(lower(question_tags), '{v}')" for k, v in SUBJECTS.items()) + f") SELECT subject, model_name, prompt_type, count(*) AS n_rows, {r6('avg(correctness_score)')} AS correctness_score FROM s WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL",
)
def a57(spark, folder):
    tags = F.lower("question_tags")
    # One pass: a row that belongs to several subjects is exploded, instead of a scan for each.
    subjects = F.array_compact(F.array(*(F.when(tags.rlike(v), F.lit(k)) for k, v in SUBJECTS.items())))
    return ag.group_means(scored(spark, folder).withColumn("subject", F.explode(subjects)), ["subject", "model_name", "prompt_type"], ["correctness_score"])


@query("a58_prompt_effectiveness", f"WITH {PX} SELECT prompt_type, {r6('coalesce(avg(correctness_score), 1 - avg(has_error::INT::DOUBLE))')} AS effectiveness, {r6('avg(elapsed_time)')} AS elapsed_time, {r6('avg(response_length::DOUBLE)')} AS response_length FROM px WHERE prompt_type IS NOT NULL GROUP BY prompt_type")
def a58(spark, folder):
    df = ag._known(scored(spark, folder), ["prompt_type"])
    return df.groupBy("prompt_type").agg(
        round6(F.coalesce(F.avg("correctness_score"), 1 - F.avg(F.col("has_error").cast("double")))).alias("effectiveness"), round6(F.avg("elapsed_time")).alias("elapsed_time"), round6(F.avg(F.col("response_length").cast("double"))).alias("response_length")
    )


@query("a59_response_time", f"WITH {PX} SELECT model_name, {r6('avg(elapsed_time)')} AS mean, {r6('quantile_cont(elapsed_time, 0.5)')} AS median, min(elapsed_time) AS min, max(elapsed_time) AS max, {r6('stddev_samp(elapsed_time)')} AS std FROM px WHERE model_name IS NOT NULL GROUP BY model_name")
def a59(spark, folder):
    return ag.median_stats(scored(spark, folder), ["model_name"], "elapsed_time")


def _describe_sql(source: str, with_: str, key: str, m: str) -> str:
    q = ", ".join(f"{r6(f'quantile_cont({m}, {p / 100})')} AS p{p}" for p in (25, 50, 75))
    return f"WITH {with_} SELECT {key}, count({m}) AS n, {r6(f'avg({m})')} AS mean, {r6(f'stddev_samp({m})')} AS std, min({m}) AS min, {q}, max({m}) AS max FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"


@query("a61_describe_latency", _describe_sql("r", R, "model_name", "latency"))
def a61(spark, folder):
    return ag.describe_by(results(spark, folder), ["model_name"], "latency")


@query("a61_describe_confidence", _describe_sql("px", PX, "model_name", "confidence_score"))
def a61_confidence(spark, folder):
    return ag.describe_by(scored(spark, folder), ["model_name"], "confidence_score")


@query("a63_time_trend", f"WITH {R} SELECT date_trunc('day', run_timestamp)::TIMESTAMP AS day, count(*) AS n_rows, {r6('avg(latency)')} AS latency, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy FROM r WHERE run_timestamp IS NOT NULL GROUP BY 1")
def a63(spark, folder):
    df = results(spark, folder).where(F.col("run_timestamp").isNotNull())
    return df.groupBy(F.date_trunc("day", "run_timestamp").alias("day")).agg(F.count("*").alias("n_rows"), round6(F.avg("latency")).alias("latency"), round6(ag.rate("is_correct")).alias("accuracy"))


def _spread_table(name: str, key: str) -> None:
    cells = ", ".join(f"{r6(f'{f}({m})')} AS {m}_{n}" for m in ("elapsed_time", "correctness_score") for f, n in (("avg", "mean"), ("stddev_samp", "std")))
    query(name, f"WITH {PX} SELECT {key}, count(*) AS n_rows, {cells}, {r6('avg(has_error::INT::DOUBLE)')} AS error_rate FROM px WHERE {key} IS NOT NULL GROUP BY {key}")(
        lambda spark, folder: ag._known(scored(spark, folder), [key]).groupBy(key).agg(
            F.count("*").alias("n_rows"),
            *(round6(f(m)).alias(f"{m}_{n}") for m in ("elapsed_time", "correctness_score") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))),
            round6(F.avg(F.col("has_error").cast("double"))).alias("error_rate"),
        )
    )


for _name, _key in (("a64_trend_by_run", "run_stamp"), ("a64_trend_by_model", "model_name"), ("a64_trend_by_prompt", "prompt_type"), ("a64_trend_by_topic", "question_type")):
    _spread_table(_name, _key)


@query(
    "a62_error_patterns",
    f"""WITH {R}, u AS (SELECT u.side, u.name, error_type FROM r, unnest([{{'side': 'all', 'name': 'all'}}, {{'side': 'model', 'name': model_name}}, {{'side': 'prompt', 'name': prompt_type}}, {{'side': 'topic', 'name': question_type}}]) AS t(u) WHERE u.name IS NOT NULL)
      SELECT side, name, count(*) AS n_rows, count(error_type) AS n_errors, {r6('count(error_type)::DOUBLE / count(*)')} AS error_rate, count(DISTINCT error_type) AS n_types FROM u GROUP BY side, name""",
)
def a62_patterns(spark, folder):
    """Errors overall and for each model, prompt and topic, in one pass."""
    sides = [("all", F.lit("all")), ("model", F.col("model_name")), ("prompt", F.col("prompt_type")), ("topic", F.col("question_type"))]
    long = results(spark, folder).select(F.explode(F.array(*(F.struct(F.lit(k).alias("side"), c.alias("name")) for k, c in sides))).alias("x"), "error_type").where(F.col("x.name").isNotNull())
    # Counted by type first, so that no group is larger than its different types.
    by_type = long.groupBy("x.side", "x.name", "error_type").agg(F.count("*").alias("n"))
    errors = F.sum(F.when(F.col("error_type").isNotNull(), F.col("n")).otherwise(0))
    return by_type.groupBy("side", "name").agg(F.sum("n").alias("n_rows"), errors.alias("n_errors"), round6(errors / F.sum("n")).alias("error_rate"), F.count("error_type").alias("n_types"))


def _best_sql(k: str) -> str:
    return f"SELECT '{k}' AS side, arg_max({k}, (q, {k})) AS best_quality, arg_min({k}, (t, {k})) AS fastest, arg_min({k}, (e, {k})) AS most_reliable FROM (SELECT {k}, avg(correctness_score) AS q, avg(elapsed_time) AS t, avg(has_error::INT::DOUBLE) AS e FROM px WHERE {k} IS NOT NULL GROUP BY {k}) WHERE q IS NOT NULL AND t IS NOT NULL"


@query("a65_recommendations", f"WITH {PX} {_best_sql('model_name')} UNION ALL {_best_sql('prompt_type')}")
def a65_best(spark, folder):
    """The best model and prompt by quality, time and errors; ties go to the last name by quality and the first otherwise."""
    def best(k: str):
        g = ag._known(scored(spark, folder), [k]).groupBy(k).agg(F.avg("correctness_score").alias("q"), F.avg("elapsed_time").alias("t"), F.avg(F.col("has_error").cast("double")).alias("e"))
        g = g.where(F.col("q").isNotNull() & F.col("t").isNotNull())
        return g.agg(F.lit(k).alias("side"), F.max_by(k, F.struct("q", k)).alias("best_quality"), F.min_by(k, F.struct("t", k)).alias("fastest"), F.min_by(k, F.struct("e", k)).alias("most_reliable"))

    return best("model_name").unionByName(best("prompt_type"))


def _kinds_sql() -> str:
    return "CASE WHEN contains(lower(prompt_type), 'few_shot') THEN 'Few-shot' WHEN contains(lower(prompt_type), 'zero_shot') THEN 'Zero-shot' WHEN contains(lower(prompt_type), 'cot') THEN 'CoT' WHEN contains(lower(prompt_type), 'react') THEN 'ReAct' ELSE 'Other' END"


def _shots_sql() -> str:
    return "try_cast(nullif(regexp_extract(prompt_type, '([0-9]+)', 1), '') AS INTEGER)"


def _grouped_scores(name: str, keys: dict[str, tuple], where: str = "true") -> None:
    """Means of the legacy scores by derived keys: name -> (SQL, Column)."""
    metrics = ("correctness_score", "reasoning_score", "elapsed_time", "response_length")
    sql = f"WITH {PX} SELECT {', '.join(f'{q} AS {k}' for k, (q, _) in keys.items())}, count(*) AS n_rows, {', '.join(f'{r6(f'avg({m}::DOUBLE)')} AS {m}' for m in metrics)} FROM px WHERE ({where}) AND {' AND '.join(f'({q}) IS NOT NULL' for q, _ in keys.values())} GROUP BY ALL"

    def run(spark, folder):
        df = scored(spark, folder).where(where)
        return ag.group_means(df.select(*(c().alias(k) for k, (_, c) in keys.items()), *metrics), list(keys), metrics)

    query(name, sql)(run)


_kind = (_kinds_sql(), lambda: tx.prompt_category(F.col("prompt_type")))
_by = lambda c: (c, lambda: F.col(c))
_grouped_scores("a66_reasoning_by_category_model", {"category": _kind, "model": _by("model_name")}, "prompt_type IS NOT NULL")
_grouped_scores("a66_few_shot_curve", {"shots": (_shots_sql(), lambda: tx.shots(F.col("prompt_type"))), "model": _by("model_name")}, "contains(lower(prompt_type), 'few_shot')")
_grouped_scores("a66_scores_by_steps", {"n_steps": _by("num_reasoning_steps")}, "contains(lower(prompt_type), 'cot')")
_grouped_scores("a68_by_prompt", {"prompt": _by("prompt_type")})
_grouped_scores("a68_by_prompt_model", {"prompt": _by("prompt_type"), "model": _by("model_name")})
_grouped_scores("a68_by_category", {"category": _kind}, "prompt_type IS NOT NULL")
_grouped_scores("a68_by_prompt_topic", {"prompt": _by("prompt_type"), "topic": _by("question_type")})
_grouped_scores("a68_by_prompt_difficulty", {"prompt": _by("prompt_type"), "difficulty": _by("question_difficulty")})
_grouped_scores("a68_by_prompt_outcome", {"prompt": _by("prompt_type"), "outcome": _by("result_type")})
_grouped_scores("a68_by_category_model", {"category": _kind, "model": _by("model_name")}, "prompt_type IS NOT NULL")


@query("a66_reasoning_correlation", f"WITH {PX} SELECT model_name, count(*) AS n_rows, {r6('corr(reasoning_score, correctness_score)')} AS correlation FROM px WHERE model_name IS NOT NULL AND reasoning_score IS NOT NULL AND correctness_score IS NOT NULL GROUP BY model_name")
def a66_corr(spark, folder):
    df = ag._known(scored(spark, folder), ["model_name", "reasoning_score", "correctness_score"])
    return df.groupBy("model_name").agg(F.count("*").alias("n_rows"), round6(correlation(F.col("reasoning_score"), F.col("correctness_score"))).alias("correlation"))


@query("a07_type_details", f"WITH {PX} SELECT question_type, count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy, {r6('avg(elapsed_time)')} AS average_latency, {r6('avg(token_count::DOUBLE)')} AS average_tokens FROM px WHERE question_type IS NOT NULL GROUP BY question_type")
def a07(spark, folder):
    df = ag._known(scored(spark, folder), ["question_type"])
    return df.groupBy("question_type").agg(F.count("*").alias("n_rows"), round6(ag.rate("is_correct")).alias("accuracy"), round6(F.avg("elapsed_time")).alias("average_latency"), round6(F.avg(F.col("token_count").cast("double"))).alias("average_tokens"))


@query("a58_react_by_model", f"WITH {PX} SELECT model_name, count(*) AS n_rows, {r6('coalesce(avg(correctness_score), 1 - avg(has_error::INT::DOUBLE))')} AS effectiveness FROM px WHERE model_name IS NOT NULL AND contains(lower(prompt_type), 'react') GROUP BY model_name")
def a58_react(spark, folder):
    df = ag._known(scored(spark, folder), ["model_name"]).where(F.contains(F.lower("prompt_type"), F.lit("react")))
    return df.groupBy("model_name").agg(F.count("*").alias("n_rows"), round6(F.coalesce(F.avg("correctness_score"), 1 - F.avg(F.col("has_error").cast("double")))).alias("effectiveness"))


@query("a101_dashboard", f"WITH {PX} SELECT model_name, {r6('avg(has_error::INT::DOUBLE)')} AS error_rate, {r6('avg(elapsed_time)')} AS elapsed_time, {r6('avg(response_length::DOUBLE)')} AS response_length FROM px WHERE model_name IS NOT NULL GROUP BY model_name")
def a101(spark, folder):
    return ag._known(scored(spark, folder), ["model_name"]).groupBy("model_name").agg(round6(F.avg(F.col("has_error").cast("double"))).alias("error_rate"), round6(F.avg("elapsed_time")).alias("elapsed_time"), round6(F.avg(F.col("response_length").cast("double"))).alias("response_length"))


@query("a102_error_types_among_errors", f"WITH {PX}, e AS (SELECT CASE WHEN has_calculation_error THEN 'calculation' WHEN has_logic_error THEN 'logic' ELSE 'other' END AS kind FROM px WHERE has_error) SELECT kind, count(*) AS n, {r6('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share FROM e GROUP BY kind")
def a102(spark, folder):
    kind = F.when(F.col("has_calculation_error"), "calculation").when(F.col("has_logic_error"), "logic").otherwise("other")
    cells = scored(spark, folder).where("has_error").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("t")))).select("kind", "n", round6(F.col("n") / F.col("t")).alias("share"))


@query("a87_criteria_long", f"WITH {R}, u AS (UNPIVOT (SELECT model_name, {', '.join(CRITERIA)} FROM r) ON {', '.join(CRITERIA)} INTO NAME criterion VALUE score) SELECT model_name, upper(substring(replace(replace(criterion, 'reasoning_', ''), '_', ' '), 1, 1)) || substring(replace(replace(criterion, 'reasoning_', ''), '_', ' '), 2) AS criterion, score::BIGINT AS score, count(*) AS n FROM u WHERE model_name IS NOT NULL AND score = floor(score) GROUP BY ALL")
def a87(spark, folder):
    """How often each criterion has each whole score, in long form with readable names."""
    long = ag._known(results(spark, folder), ["model_name"]).select("model_name", *CRITERIA).unpivot("model_name", list(CRITERIA), "criterion", "score")
    plain = F.replace(F.replace(F.col("criterion"), F.lit("reasoning_"), F.lit("")), F.lit("_"), F.lit(" "))
    name = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 99))
    return long.where(F.col("score") == F.floor("score")).groupBy("model_name", name.alias("criterion"), F.col("score").cast("bigint").alias("score")).agg(F.count("*").alias("n"))


@query("a65_alerts", f"WITH {PX} SELECT model_name, prompt_type, count(*) AS n_rows, {r6('avg(has_error::INT::DOUBLE)')} AS error_rate FROM px WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL HAVING avg(has_error::INT::DOUBLE) > 0.2")
def a65(spark, folder):
    g = ag._known(scored(spark, folder), ["model_name", "prompt_type"]).groupBy("model_name", "prompt_type").agg(F.count("*").alias("n_rows"), F.avg(F.col("has_error").cast("double")).alias("e"))
    return g.where(F.col("e") > 0.2).select("model_name", "prompt_type", "n_rows", round6(F.col("e")).alias("error_rate"))


@query("a68_token_efficiency", f"WITH {PX} SELECT prompt_type, {r6('avg(correctness_score / greatest(response_length, 1) * 1000)')} AS token_efficiency FROM px WHERE prompt_type IS NOT NULL GROUP BY prompt_type")
def a68(spark, folder):
    return ag._known(scored(spark, folder), ["prompt_type"]).groupBy("prompt_type").agg(round6(F.avg(F.col("correctness_score") / F.greatest("response_length", F.lit(1)) * 1000)).alias("token_efficiency"))


@query("a73_positive_criteria", f"WITH {R}, g AS (SELECT model_name, " + ", ".join(f"{r6(f'coalesce(avg({c}) FILTER (WHERE {c} > 0), 0.0)')} AS {c}" for c in CRITERIA) + f" FROM r WHERE model_name IS NOT NULL GROUP BY model_name) UNPIVOT g ON {', '.join(CRITERIA)} INTO NAME criterion VALUE mean")
def a73(spark, folder):
    return ag.positive_means(results(spark, folder), "model_name", CRITERIA)


@query("a74_row_average", f"WITH {R}, a AS (SELECT model_name, list_avg(list_filter([{', '.join(CRITERIA)}], lambda x: x IS NOT NULL)) AS m FROM r WHERE model_name IS NOT NULL) SELECT model_name, count(m) AS n, {r6('avg(m)')} AS mean FROM a GROUP BY model_name")
def a74(spark, folder):
    from scoreloom.functions.numbers import row_mean

    return ag._known(results(spark, folder), ["model_name"]).withColumn("m", row_mean(*CRITERIA)).groupBy("model_name").agg(F.count("m").alias("n"), round6(F.avg("m")).alias("mean"))


@query("a76_criteria_by_type", f"WITH {R}, u AS (UNPIVOT (SELECT question_type, {', '.join(CRITERIA)} FROM r) ON {', '.join(CRITERIA)} INTO NAME criterion VALUE score) SELECT criterion, question_type, count(score) AS n, {r6('avg(score)')} AS mean FROM u WHERE question_type IS NOT NULL GROUP BY ALL")
def a76(spark, folder):
    long = results(spark, folder).select("question_type", *CRITERIA).unpivot("question_type", list(CRITERIA), "criterion", "score")
    return ag._known(long, ["question_type"]).groupBy("criterion", "question_type").agg(F.count("score").alias("n"), round6(F.avg("score")).alias("mean")).where(F.col("n") > 0)


@query(
    "a81_error_share_of_all",
    f"WITH {R}, c AS (SELECT model_name, coalesce(error_type, 'Unknown') AS error_type, count(*) AS n FROM r WHERE model_name IS NOT NULL AND NOT is_correct GROUP BY ALL) SELECT model_name, error_type, n, {r6('n / sum(n) OVER ()')} AS share FROM c",
)
def a81(spark, folder):
    df = ag._known(results(spark, folder), ["model_name"]).where(~F.col("is_correct"))
    cells = df.groupBy("model_name", F.coalesce("error_type", F.lit("Unknown")).alias("error_type")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    return cells.crossJoin(F.broadcast(total)).select("model_name", "error_type", "n", round6(F.col("n") / F.col("total")).alias("share"))


@query(
    "a84_box_stats",
    f"""WITH {R}, q AS (SELECT model_name, quantile_cont(latency, 0.25) AS q1, quantile_cont(latency, 0.5) AS median, quantile_cont(latency, 0.75) AS q3 FROM r WHERE model_name IS NOT NULL GROUP BY 1),
      f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
      SELECT model_name, {r6('any_value(q1)')} AS q1, {r6('any_value(median)')} AS median, {r6('any_value(q3)')} AS q3, min(latency) FILTER (WHERE latency BETWEEN low AND high) AS whisker_low, max(latency) FILTER (WHERE latency BETWEEN low AND high) AS whisker_high,
      count(*) FILTER (WHERE NOT (latency BETWEEN low AND high)) AS n_outliers FROM r JOIN f USING (model_name) GROUP BY model_name""",
)
def a84(spark, folder):
    return ag.box_stats(results(spark, folder), "model_name", "latency")


@query("a85_histogram", f"WITH {R} SELECT (CASE WHEN f1_score < 0 THEN 0 WHEN f1_score >= 1 THEN 11 ELSE floor(f1_score * 10) + 1 END)::BIGINT AS bin, count(*) AS n_rows FROM r WHERE f1_score IS NOT NULL GROUP BY 1")
def a85(spark, folder):
    return ag.histogram(results(spark, folder), "f1_score", 0.0, 1.0, 10)


@query("a88_corpus_by_type", f"WITH c AS (SELECT coalesce(question_type, 'general') AS question_type, coalesce(difficulty, 'Không xác định') AS difficulty, count(*) AS n FROM questions GROUP BY ALL) SELECT question_type, difficulty, n, {r6('100.0::DOUBLE * n / sum(n) OVER ()')} AS percent FROM c")
def a88(spark, folder):
    q = table(spark, folder, "questions")
    cells = q.groupBy(F.coalesce("question_type", F.lit("general")).alias("question_type"), F.coalesce("difficulty", F.lit("Không xác định")).alias("difficulty")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    return cells.crossJoin(F.broadcast(total)).select("question_type", "difficulty", "n", round6(100.0 * F.col("n") / F.col("total")).alias("percent"))


@query("a88_tag_frequency", "SELECT tag, count(*) AS n FROM (SELECT trim(u.tag) AS tag FROM questions, unnest(tags) AS u(tag)) WHERE tag <> '' GROUP BY tag")
def a88_tags(spark, folder):
    tags = table(spark, folder, "questions").select(F.explode("tags").alias("tag")).select(F.trim("tag").alias("tag"))
    return tags.where(F.col("tag") != "").groupBy("tag").agg(F.count("*").alias("n"))


@query("j07_context_union", f"WITH {R} SELECT model_name, 'context' AS kind, count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy FROM r WHERE model_name IS NOT NULL AND {_IN_CONTEXT} GROUP BY 1 UNION ALL SELECT model_name, 'plain', count(*), {r6('avg(is_correct::INT::DOUBLE)')} FROM r WHERE model_name IS NOT NULL AND NOT {_IN_CONTEXT} GROUP BY 1")
def j07(spark, folder):
    kind = F.when(F.coalesce(F.col("prompt_type").isin(*CONTEXT), F.lit(False)), "context").otherwise("plain")
    df = ag._known(results(spark, folder), ["model_name"])
    return df.groupBy("model_name", kind.alias("kind")).agg(F.count("*").alias("n_rows"), round6(ag.rate("is_correct")).alias("accuracy"))
