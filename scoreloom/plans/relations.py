"""Queries of joins, windows, top-k, sampling, reshaping, sources, sinks, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.numbers import clamp01, ratio, round6
from scoreloom.operators import aggregates as ag
from scoreloom.operators import grid, ml, windows
from scoreloom.plans import inference
from scoreloom.plans.analytics import CRITERIA, LEVELS, PX, r6, scored
from scoreloom.plans.base import R, query, results
from scoreloom.sources import readers, sinks
from scoreloom.sources.tables import table
from scoreloom.streaming import ingest


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("w01_rolling_latency", f"""WITH {R} SELECT model_name, run_timestamp, result_id, {r6('CASE WHEN count(*) OVER w = 5 THEN avg(latency) OVER w END')} AS rolling_mean, {r6('CASE WHEN count(*) OVER w = 5 THEN stddev_samp(latency) OVER w END')} AS rolling_std
  FROM r WHERE run_timestamp IS NOT NULL AND model_name IS NOT NULL WINDOW w AS (PARTITION BY model_name ORDER BY run_timestamp, result_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w01(spark, folder):
    df = results(spark, folder).where(F.col("run_timestamp").isNotNull() & F.col("model_name").isNotNull())
    return windows.rolling(df, "model_name", ["run_timestamp", "result_id"], "latency")


@query("w05_error_spacing", f"""WITH {R}, h AS (SELECT model_name, result_id, run_timestamp, row_number() OVER (PARTITION BY model_name ORDER BY run_timestamp DESC, result_id DESC) AS place
  FROM r WHERE error_type IS NOT NULL AND run_timestamp IS NOT NULL AND model_name IS NOT NULL), e AS (SELECT *, lead(run_timestamp) OVER (PARTITION BY model_name ORDER BY place) AS before FROM h WHERE place <= 10)
  SELECT model_name, result_id, (epoch_us(run_timestamp) - epoch_us(before)) / 1000000.0::DOUBLE AS seconds FROM e WHERE place <= 3""")
def w05(spark, folder):
    """Seconds before each of the last three errors of a model, within a history of ten."""
    from pyspark.sql import Window

    df = results(spark, folder).where(F.col("error_type").isNotNull() & F.col("run_timestamp").isNotNull() & F.col("model_name").isNotNull())
    history = windows.last_n(df.select("model_name", "run_timestamp", "result_id"), "model_name", ["run_timestamp", "result_id"], 10)
    last = Window.partitionBy("model_name").orderBy(F.desc("run_timestamp"), F.desc("result_id"))
    spaced = history.withColumn("before", F.lead("run_timestamp").over(last)).withColumn("place", F.row_number().over(last)).where(F.col("place") <= 3)
    return spaced.select("model_name", "result_id", ((_micros("run_timestamp") - _micros("before")) / 1000000.0).alias("seconds"))


_SPREAD = f"""m AS (SELECT question_id, model_name, avg(is_correct::INT::DOUBLE) AS a FROM r WHERE question_id IS NOT NULL AND model_name IS NOT NULL GROUP BY ALL),
  s AS (SELECT question_id, count(*) AS n_models, {r6('avg(a)')} AS accuracy, {r6('max(a) - min(a)')} AS spread, {r6('(0.5::DOUBLE - abs(avg(a) - 0.5::DOUBLE)) * stddev_samp(a)')} AS mixedness FROM m GROUP BY question_id)"""


def _spread(spark, folder):
    return windows.question_spread(results(spark, folder), "question_id", "model_name", F.col("is_correct").cast("double"))


@query("t01_interesting", f"WITH {R}, {_SPREAD} SELECT * FROM s WHERE n_models > 1 ORDER BY spread DESC, question_id LIMIT 10")
def t01(spark, folder):
    return windows.top(_spread(spark, folder).where(F.col("n_models") > 1), [F.desc("spread"), F.col("question_id")], 10)


@query("t02_hardest", f"WITH {R}, {_SPREAD} SELECT * FROM s ORDER BY accuracy NULLS LAST, question_id LIMIT 10")
def t02(spark, folder):
    return windows.top(_spread(spark, folder), [F.asc_nulls_last("accuracy"), F.col("question_id")], 10)


@query("t03_easiest", f"WITH {R}, {_SPREAD} SELECT * FROM s ORDER BY accuracy DESC NULLS LAST, question_id LIMIT 10")
def t03(spark, folder):
    return windows.top(_spread(spark, folder), [F.desc_nulls_last("accuracy"), F.col("question_id")], 10)


@query("t04_mixed", f"WITH {R}, {_SPREAD} SELECT * FROM s ORDER BY mixedness DESC NULLS LAST, question_id LIMIT 10")
def t04(spark, folder):
    return windows.top(_spread(spark, folder), [F.desc_nulls_last("mixedness"), F.col("question_id")], 10)


@query("o01_slowest", f"WITH {R} SELECT result_id, model_name, latency FROM r WHERE latency IS NOT NULL ORDER BY latency DESC, result_id LIMIT 20")
def o01(spark, folder):
    return windows.top(results(spark, folder).where(F.col("latency").isNotNull()).select("result_id", "model_name", "latency"), [F.desc("latency"), F.col("result_id")], 20)


@query("x01_hash_sample", "SELECT result_id FROM analyzed_results ORDER BY md5('42-' || result_id::VARCHAR), result_id LIMIT 50")
def x01(spark, folder):
    return windows.hash_sample(results(spark, folder), "result_id", 50).select("result_id")


@query("x02_unclassified_errors", f"WITH {R} SELECT result_id FROM r WHERE NOT is_correct AND error_type IS NULL ORDER BY md5('42-' || result_id::VARCHAR), result_id LIMIT 50")
def x02(spark, folder):
    df = results(spark, folder).where(~F.col("is_correct") & F.col("error_type").isNull())
    return windows.hash_sample(df, "result_id", 50).select("result_id")


@query("j01_grid", f"WITH {R}, m AS (SELECT DISTINCT model_name FROM r WHERE model_name IS NOT NULL), p AS (SELECT DISTINCT prompt_type FROM results WHERE prompt_type IS NOT NULL) SELECT model_name, prompt_type, count(*) AS n_questions FROM m, p, questions GROUP BY ALL")
def j01(spark, folder):
    """Questions of each model and configured prompt type; the prompt types are those of `results` only."""
    return _grid(spark, folder).groupBy("model_name", "prompt_type").agg(F.count("*").alias("n_questions"))


def _grid(spark, folder):
    models = results(spark, folder).where(F.col("model_name").isNotNull()).select("model_name").distinct()
    prompts = table(spark, folder, "results").where(F.col("prompt_type").isNotNull()).select("prompt_type").distinct()
    return grid.full_grid(models, prompts, table(spark, folder, "questions").select("question_id"))


@query("j02_pending", f"""WITH {R}, m AS (SELECT DISTINCT model_name FROM r WHERE model_name IS NOT NULL), p AS (SELECT DISTINCT prompt_type FROM results WHERE prompt_type IS NOT NULL)
  SELECT model_name, prompt_type, question_id FROM m, p, questions q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.model_name = m.model_name AND r.prompt_type = p.prompt_type AND r.question_id = q.question_id)""")
def j02(spark, folder):
    """What of the grid has no result row; prompt types that aren't in `results` aren't listed."""
    return grid.pending(_grid(spark, folder), results(spark, folder))


@query("j04_enriched", f"""WITH {R} SELECT result_id, coalesce(CASE WHEN q.question_id IS NOT NULL THEN coalesce(q.question_type, 'general') END, 'unknown') AS asked_type, coalesce(CASE WHEN q.question_id IS NOT NULL THEN coalesce(q.difficulty, 'Không xác định') END, 'unknown') AS asked_difficulty, len(q.tags)::INTEGER AS n_tags
  FROM r LEFT JOIN questions q USING (question_id)""")
def j04(spark, folder):
    df = grid.with_questions(results(spark, folder), table(spark, folder, "questions"))
    return df.select("result_id", "asked_type", "asked_difficulty", F.when(F.col("asked_tags").isNotNull(), F.size("asked_tags")).alias("n_tags"))


@query("j10_first_per_question", f"WITH {R} SELECT question_id, model_name, min(result_id) AS result_id FROM r WHERE question_id IS NOT NULL AND model_name IS NOT NULL GROUP BY ALL")
def j10(spark, folder):
    df = results(spark, folder).where(F.col("question_id").isNotNull() & F.col("model_name").isNotNull())
    return df.groupBy("question_id", "model_name").agg(F.min("result_id").alias("result_id"))


@query("p01_filters", f"""SELECT question_id FROM questions WHERE lower(question_type) IN ('tỷ lệ', 'hình học', 'bài toán hình học') OR difficulty IN ('Dễ', 'Khó') AND len(list_filter(tags, lambda t: lower(t) IN ('diện tích', 'chu vi', 'phân số'))) > 0""")
def p01(spark, folder):
    q = table(spark, folder, "questions")
    tagged = F.exists("tags", lambda t: F.lower(t).isin("diện tích", "chu vi", "phân số"))
    return q.where(F.lower("question_type").isin("tỷ lệ", "hình học", "bài toán hình học") | (F.col("difficulty").isin("Dễ", "Khó") & tagged)).select("question_id")


@query("p03_exclude_tags", "SELECT question_id FROM questions WHERE tags IS NULL OR len(list_filter(tags, lambda t: lower(t) IN ('diện tích', 'chu vi'))) = 0")
def p03(spark, folder):
    q = table(spark, folder, "questions")
    return q.where(F.col("tags").isNull() | ~F.exists("tags", lambda t: F.coalesce(F.lower(t).isin("diện tích", "chu vi"), F.lit(False)))).select("question_id")


@query("p10_prompt_regex", f"WITH {R} SELECT prompt_type, count(*) AS n FROM r WHERE regexp_matches(lower(prompt_type), 'consistency|react') GROUP BY prompt_type")
def p10(spark, folder):
    return results(spark, folder).where(F.lower("prompt_type").rlike("consistency|react")).groupBy("prompt_type").agg(F.count("*").alias("n"))


@query("p20_derived", f"WITH {PX} SELECT processed_id, {r6('quality_index')} AS quality_index, {r6('tokens_per_second')} AS tokens_per_second, has_error, correctness_score >= 0.7 AS passed FROM px")
def p20(spark, folder):
    return scored(spark, folder).select("processed_id", round6(F.col("quality_index")).alias("quality_index"), round6(F.col("tokens_per_second")).alias("tokens_per_second"), "has_error", (F.col("correctness_score") >= 0.7).alias("passed"))


@query("r02_unpivot", f"WITH {R} SELECT criterion, count(*) AS n, {r6('avg(score)')} AS mean FROM (UNPIVOT (SELECT {', '.join(CRITERIA)} FROM r) ON {', '.join(CRITERIA)} INTO NAME criterion VALUE score) GROUP BY criterion")
def r02(spark, folder):
    long = results(spark, folder).select("result_id", *CRITERIA).unpivot("result_id", list(CRITERIA), "criterion", "score").where(F.col("score").isNotNull())
    return long.groupBy("criterion").agg(F.count("*").alias("n"), round6(F.avg("score")).alias("mean"))


@query("r03_tags", "SELECT question_id, trim(tag) AS tag FROM questions, unnest(tags) AS u(tag)")
def r03(spark, folder):
    return table(spark, folder, "questions").select("question_id", F.explode("tags").alias("tag")).withColumn("tag", F.trim("tag"))


@query("r04_json_columns", f"WITH {R} SELECT result_id, CASE WHEN json_valid(reasoning_scores_str) THEN try_cast(json_extract_string(reasoning_scores_str, '$.accuracy') AS DOUBLE) END AS accuracy FROM r WHERE reasoning_scores_str IS NOT NULL")
def r04(spark, folder):
    df = results(spark, folder).where(F.col("reasoning_scores_str").isNotNull())
    return df.select("result_id", F.get_json_object("reasoning_scores_str", "$.accuracy").try_cast("double").alias("accuracy"))


@query("m03_standardise", f"WITH {PX}, z AS (SELECT processed_id, coalesce(elapsed_time, 0.0::DOUBLE) AS a, coalesce(response_length::DOUBLE, 0.0::DOUBLE) AS b FROM px) SELECT processed_id, {r6('(a - avg(a) OVER ()) / stddev_pop(a) OVER ()')} AS elapsed_time, {r6('(b - avg(b) OVER ()) / stddev_pop(b) OVER ()')} AS response_length FROM z")
def m03(spark, folder):
    return ml.standardise(scored(spark, folder), "processed_id", ["elapsed_time", "response_length"])


_PERFORMANCE = ("elapsed_time", "response_length", "tokens_per_second", "confidence_score")


@query("m01_components")
def m01(spark, folder):
    return ml.components(scored(spark, folder), "processed_id", _PERFORMANCE)


@query("m02_clusters")
def m02(spark, folder):
    return ml.clusters(scored(spark, folder), "processed_id", _PERFORMANCE[:3])


@query("s04_legacy_rows", f"""WITH l AS (SELECT legacy_id, lower(trim(model_name)) AS model_name, prompt_type, greatest(coalesce(CASE WHEN NOT isnan(elapsed_time) THEN elapsed_time END, 0.0::DOUBLE), 0.001::DOUBLE) AS e, coalesce(response_length::BIGINT, length(coalesce(answer, ''))::BIGINT) AS n, coalesce(answer, '') AS a FROM results)
  SELECT legacy_id, model_name, prompt_type, e AS elapsed_time, n AS response_length, {r6('n / e')} AS tokens_per_second, contains(a, 'Error:') OR contains(a, '[Không thể tạo phản hồi') AS has_error FROM l""")
def s04(spark, folder):
    df = readers.legacy_rows(table(spark, folder, "results"))
    return df.withColumn("tokens_per_second", round6(F.col("tokens_per_second")))


@query("s09_files")
def s09(spark, folder):
    """Files of the folder with their sizes; paths without the folder."""
    files = readers.list_files(spark, folder, "*.parquet", True)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"), readers.human_size(F.col("length")).alias("size"))


#: Questions of exercise texts in SQL: table `e` with doc_id, question_no, section, question and solution.
SECTIONS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
  m AS (SELECT *, lower(trim(line, ' ')) AS low FROM l),
  f AS (SELECT *, (starts_with(low, 'bài ') OR starts_with(low, 'câu '))::INT AS q, (starts_with(low, 'lời giải') OR starts_with(low, 'hướng dẫn giải'))::INT AS s, CASE WHEN starts_with(low, 'phần ') THEN trim(line, ' ') END AS sec FROM m),
  n AS (SELECT *, sum(q) OVER w AS question_no, last_value(sec IGNORE NULLS) OVER w AS section FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT *, max(s) OVER (PARTITION BY doc_id, question_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) = 1 AS sol FROM n WHERE question_no > 0),
  e AS (SELECT doc_id, question_no::BIGINT AS question_no, arg_min_null(section, line_no) AS section, coalesce(trim(string_agg(line, ' ' ORDER BY line_no) FILTER (WHERE NOT sol), ' '), '') AS question, coalesce(trim(string_agg(line, ' ' ORDER BY line_no) FILTER (WHERE sol), ' '), '') AS solution FROM p GROUP BY doc_id, question_no)"""


@query("s11_sections", f"WITH {SECTIONS} SELECT * FROM e")
def s11(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.sections(docs)


@query("s12_latest_file", "SELECT dataset, arg_max(file_name, (written_at, file_id)) AS file_name FROM raw_files WHERE written_at IS NOT NULL GROUP BY dataset")
def s12(spark, folder):
    files = table(spark, folder, "raw_files").where(F.col("written_at").isNotNull())
    return files.groupBy("dataset").agg(F.max_by("file_name", F.struct("written_at", "file_id")).alias("file_name"))


@query("s13_checkpoint_info", f"WITH {R} SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT model_name, prompt_type, question_id FROM r WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL AND question_id IS NOT NULL)) AS n_combinations, count(DISTINCT model_name) AS n_models, count(DISTINCT prompt_type) AS n_prompts FROM r")
def s13(spark, folder):
    return sinks.checkpoint_info(results(spark, folder))


@query("s14_runs_with_prompts", f"WITH {R} SELECT run_id, count(*) AS n_rows FROM r WHERE run_id IS NOT NULL GROUP BY run_id HAVING count(DISTINCT CASE WHEN prompt_type IN ('cot', 'react') THEN prompt_type END) = 2")
def s14(spark, folder):
    g = results(spark, folder).where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count_distinct(F.when(F.col("prompt_type").isin("cot", "react"), F.col("prompt_type"))).alias("n"))
    return g.where(F.col("n") == 2).select("run_id", "n_rows")


_PART = "SELECT '{k}' AS part, {k} AS name, count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total, {a} AS accuracy FROM r WHERE {k} IS NOT NULL GROUP BY {k}"
_ACCURACY = r6("count(*) FILTER (WHERE is_correct)::DOUBLE / count(*)")


@query("k04_json_report", f"WITH {R} SELECT 'meta' AS part, 'all' AS name, count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total, {_ACCURACY} AS accuracy FROM r UNION ALL " + " UNION ALL ".join(_PART.format(k=k, a=_ACCURACY) for k in ("model_name", "prompt_type")))
def k04(spark, folder):
    return sinks.report_lines(results(spark, folder)).select("part", "name", "correct", "total", "accuracy")


@query("k16_corpus_summary", "SELECT count(*) AS total_problems, count(question) AS n_questions, count(solution) AS n_solutions FROM questions")
def k16(spark, folder):
    return table(spark, folder, "questions").agg(F.count("*").alias("total_problems"), F.count("question").alias("n_questions"), F.count("solution").alias("n_solutions"))


@query("i01_delivered_once", f"WITH {R}, u AS (SELECT * EXCLUDE (result_id, ingested_at), min(result_id) AS result_id FROM r GROUP BY ALL) SELECT model_name, count(*) AS n_rows FROM u WHERE model_name IS NOT NULL GROUP BY model_name")
def i01(spark, folder):
    """Rows without those delivered again under another id.

    Rows are the same if 128 bits of two hashes of all their other columns are; only
    those move.
    """
    df = results(spark, folder)
    same = [c for c in df.columns if c not in ("result_id", "ingested_at")]
    # A null and '' hash alike otherwise, as does a null beside its neighbour.
    marked = [*same, F.array(*(F.col(c).isNull() for c in same))]
    rows = df.select("model_name", "result_id", F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit("second"), *marked).alias("h2"))
    once = rows.groupBy("h1", "h2").agg(F.min("result_id").alias("result_id"), F.first("model_name").alias("model_name"))
    return once.where(F.col("model_name").isNotNull()).groupBy("model_name").agg(F.count("*").alias("n_rows"))


@query("i02_late_rows", f"WITH {R} SELECT date_trunc('day', run_timestamp)::TIMESTAMP AS day, count(*) AS n_rows, count(*) FILTER (WHERE ingested_at > run_timestamp + INTERVAL 1 DAY) AS n_late FROM r WHERE run_timestamp IS NOT NULL GROUP BY 1")
def i02(spark, folder):
    df = results(spark, folder).where(F.col("run_timestamp").isNotNull())
    return df.groupBy(F.date_trunc("day", "run_timestamp").alias("day")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("ingested_at") > F.col("run_timestamp") + F.expr("INTERVAL 1 DAY")).alias("n_late"))


_ID_HASH = "('0x' || substring(md5(question_id::VARCHAR), 1, 15))::BIGINT"


@query("i03_run_id", f"WITH i AS (SELECT DISTINCT question_id FROM questions WHERE question_id IS NOT NULL), h AS (SELECT {_ID_HASH} AS h FROM i) SELECT 'llama_qwen_cot_react_' || substring(md5(count(*) || '-' || bit_xor(h) || '-' || sum(h)::VARCHAR), 1, 8) AS run_id FROM h")
def i03(spark, folder):
    return grid.run_id(["qwen", "llama"], ["react", "cot"], table(spark, folder, "questions"))


@query("i05_windows", f"SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, {r6('avg(value)')} AS mean_value FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def i05_windows(spark, folder):
    df = ingest.windowed(table(spark, folder, "events").where(F.col("ts").isNotNull()), "ts")
    return df.withColumn("mean_value", round6(F.col("mean_value")))


@query("i05_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, no""")
def i05_sessions(spark, folder):
    return ingest.sessions(table(spark, folder, "events"), "ts")


@query("u01_prompts", "SELECT question_id, 'Hãy giải bài toán sau, suy luận từng bước.' || chr(10) || chr(10) || question || chr(10) || chr(10) || 'Trình bày từng bước rồi nêu kết luận.' AS prompt FROM questions")
def u01(spark, folder):
    return table(spark, folder, "questions").select("question_id", inference.prompt(F.col("question"), F.lit("cot")).alias("prompt"))


def _echo(prompts):
    """The offline backend: the length of each prompt."""
    return [f"Final answer: {len(p)}" for p in prompts]


@query("u05_generate", "SELECT question_id, 'Final answer: ' || length('Hãy giải bài toán sau.' || chr(10) || chr(10) || question) AS response FROM questions")
def u05(spark, folder):
    df = table(spark, folder, "questions").select("question_id", inference.prompt(F.col("question"), F.lit("zero_shot")).alias("prompt"))
    return inference.generate(df, "prompt", _echo).select("question_id", "response")


def _vote_sql(where: str) -> str:
    """Votes over the final answers of the rows that a condition picks."""
    from scoreloom.plans.texts import _MARKED, _collapse

    final = f"coalesce({_MARKED}, nullif(trim(list_last(string_split(response, '\n\n')), ' '), ''), response)"
    plain = f"translate(lower({_collapse('final')}), '.,;:!?()\"\'\'', '')"
    answer = f"coalesce(nullif(regexp_extract({plain}, '[-+]?[0-9]*\\.?[0-9]+'), ''), {plain})"
    return f"""WITH {R}, a AS (SELECT result_id, model_name, question_id, {final} AS final FROM r WHERE {where} AND model_name IS NOT NULL AND question_id IS NOT NULL), c AS (SELECT *, {answer} AS answer FROM a),
      n AS (SELECT model_name, question_id, answer, count(*) AS n, min(result_id) AS first FROM c WHERE answer IS NOT NULL GROUP BY ALL),
      g AS (SELECT model_name, question_id, sum(n)::BIGINT AS n_answers, count(*) AS unique_answers, arg_max(answer, (n, -first)) AS most_common, max(n) AS top FROM n GROUP BY ALL)
      SELECT model_name, question_id, n_answers, unique_answers, most_common, {r6('top / n_answers')} AS agreement_rate, {r6('CASE WHEN unique_answers = 1 THEN 1.0::DOUBLE ELSE top / n_answers END')} AS consistency_score FROM g WHERE n_answers > 1"""


@query("u07_vote", _vote_sql("regexp_matches(prompt_type, '^(?:cot_)?self_consistency')"))
def u07(spark, folder):
    """Votes over the samples of both families of self-consistency."""
    df = results(spark, folder).where(F.col("prompt_type").rlike("^(?:cot_)?self_consistency"))
    return inference.vote(df, ["model_name", "question_id"], "response", "result_id")


@query("n02_digit_search", "WITH q AS (SELECT question_id, regexp_extract(question, 'tổng các chữ số là ([0-9]+)', 1) AS s, regexp_extract(question, 'tích của chúng là ([0-9]+)', 1) AS p FROM questions), n AS (SELECT q.question_id, min(v.v) AS number FROM q, range(10, 100) AS v(v) WHERE s <> '' AND p <> '' AND v.v // 10 + v.v % 10 = s::BIGINT AND (v.v // 10) * (v.v % 10) = p::BIGINT GROUP BY q.question_id) SELECT question_id, number::BIGINT AS number FROM n")
def n02(spark, folder):
    """The least number of two digits with the sum and product that a question names."""
    part = lambda p: F.nullif(F.regexp_extract("question", p, 1), F.lit("")).try_cast("bigint")
    q = table(spark, folder, "questions").select("question_id", part("tổng các chữ số là ([0-9]+)").alias("s"), part("tích của chúng là ([0-9]+)").alias("p")).where(F.col("s").isNotNull() & F.col("p").isNotNull())
    tens, ones = lambda v: F.floor(v / 10), lambda v: v % 10
    fits = F.filter(F.sequence(F.lit(10), F.lit(99)), lambda v: (tens(v) + ones(v) == F.col("s")) & (tens(v) * ones(v) == F.col("p")))
    return q.select("question_id", F.get(fits, F.lit(0)).cast("bigint").alias("number")).where(F.col("number").isNotNull())


@query("n06_row_arithmetic", f"WITH {PX} SELECT processed_id, {r6('CASE WHEN correctness_score + bias_correction IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, correctness_score + bias_correction)) END')} AS clamped, {r6('CASE WHEN response_length = 0 THEN 0.0::DOUBLE ELSE token_count::DOUBLE / response_length END')} AS density FROM px")
def n06(spark, folder):
    df = scored(spark, folder)
    total = F.col("correctness_score") + F.col("bias_correction")
    return df.select("processed_id", round6(clamp01(total)).alias("clamped"), round6(ratio(F.col("token_count"), F.col("response_length"))).alias("density"))


@query("dt02_stamps", f"WITH {R} SELECT result_id, strftime(run_timestamp, '%Y%m%d_%H%M%S') AS stamp, (epoch_us(ingested_at) - epoch_us(run_timestamp)) / 1000000.0::DOUBLE AS delay, ingested_at::DATE > run_timestamp::DATE AS next_day FROM r WHERE run_timestamp IS NOT NULL AND ingested_at IS NOT NULL")
def dt02(spark, folder):
    df = results(spark, folder).where(F.col("run_timestamp").isNotNull() & F.col("ingested_at").isNotNull())
    delay = (_micros("ingested_at") - _micros("run_timestamp")) / 1000000.0
    return df.select("result_id", F.date_format("run_timestamp", "yyyyMMdd_HHmmss").alias("stamp"), delay.alias("delay"), (F.to_date("ingested_at") > F.to_date("run_timestamp")).alias("next_day"))


@query("h02_group_map", f"WITH {R}, m AS (SELECT model_name, {', '.join(f'{r6(f'avg({c})')} AS {c}' for c in CRITERIA)} FROM r WHERE model_name IS NOT NULL GROUP BY model_name) SELECT model_name, array_to_string([" + ", ".join(f"'{c}=' || round({c} * 1000)::BIGINT" for c in CRITERIA) + "], ',') AS means FROM m")
def h02(spark, folder):
    """Means of the criteria of a model as one map, printed in thousandths; the keys are the criteria, whatever the data."""
    df = results(spark, folder).where(F.col("model_name").isNotNull()).groupBy("model_name").agg(*(round6(F.avg(c)).alias(c) for c in CRITERIA))
    means = df.select("model_name", F.map_from_arrays(F.array(*map(F.lit, CRITERIA)), F.array(*(F.col(c) for c in CRITERIA))).alias("m"))
    printed = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("bigint").cast("string")))
    return means.select("model_name", F.array_join(printed, ",").alias("means"))


@query("a10_levels", f"SELECT difficulty, count(*) AS n FROM questions WHERE difficulty IN {LEVELS!r} GROUP BY difficulty")
def levels(spark, folder):
    return table(spark, folder, "questions").where(F.col("difficulty").isin(*LEVELS)).groupBy("difficulty").agg(F.count("*").alias("n"))
