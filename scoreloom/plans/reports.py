"""Queries of examples, reports, prompts, runs and the smaller helpers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import scoring as sc
from scoreloom.functions import text as tx
from scoreloom.functions.numbers import let, round6
from scoreloom.operators import aggregates as ag
from scoreloom.operators import grid, windows
from scoreloom.plans import inference
from scoreloom.plans.analytics import CRITERIA, PX, r6, scored
from scoreloom.plans.base import R, query, results
from scoreloom.plans.relations import SECTIONS, _SPREAD, _spread
from scoreloom.sources import readers, sinks
from scoreloom.sources.tables import table

# --- examples of questions with all models' responses

_EXAMPLES = {
    "interesting": ("spread DESC", lambda: [F.desc("spread"), F.col("question_id")], "n_models > 1"),
    "errors": ("accuracy NULLS LAST", lambda: [F.asc_nulls_last("accuracy"), F.col("question_id")], "true"),
    "success": ("accuracy DESC NULLS LAST", lambda: [F.desc_nulls_last("accuracy"), F.col("question_id")], "true"),
    "mixed": ("mixedness DESC NULLS LAST", lambda: [F.desc_nulls_last("mixedness"), F.col("question_id")], "true"),
}
_FIRST = "f AS (SELECT question_id, model_name, min(result_id) AS result_id FROM r WHERE question_id IS NOT NULL AND model_name IS NOT NULL GROUP BY ALL)"
_CHOSEN = " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM (SELECT question_id, accuracy FROM s WHERE {w} ORDER BY {o}, question_id LIMIT 10)" for k, (o, _, w) in _EXAMPLES.items())
_ENTRY = "'{\"correct\":' || coalesce(is_correct::VARCHAR, 'null') || ',\"length\":' || coalesce(length(response)::VARCHAR, 'null') || '}'"


@query(
    "t05_examples",
    f"""WITH {R}, {_SPREAD}, {_FIRST}, c AS ({_CHOSEN}) SELECT kind, question_id, any_value(accuracy) AS accuracy, string_agg(model_name || '=' || {_ENTRY}, ',' ORDER BY model_name) AS responses
      FROM c JOIN f USING (question_id) JOIN (SELECT result_id, is_correct, response FROM r) x USING (result_id) GROUP BY kind, question_id""",
)
def t05(spark, folder):
    """Ten questions of each kind with a map from model to its first response, printed as correctness and length."""
    return examples(spark, folder, 10).select("kind", "question_id", "accuracy", F.array_join(F.transform(F.array_sort(F.map_entries("responses")), lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.struct(
        F.coalesce(e["value"]["is_correct"].cast("string"), F.lit("null")).alias("c"), F.coalesce(F.char_length(e["value"]["response"]).cast("string"), F.lit("null")).alias("l"))))), ",").alias("responses")).select(
        "kind", "question_id", "accuracy", F.regexp_replace("responses", '\\{"c":"([^"]*)","l":"([^"]*)"\\}', '{"correct":$1,"length":$2}').alias("responses"))


def examples(spark, folder, n: int):
    """n questions of each kind with `responses`: for each model its first response, its correctness and prompt. One map holds one entry a model."""
    rows = results(spark, folder).where(F.col("question_id").isNotNull() & F.col("model_name").isNotNull())
    spread = _spread(spark, folder)
    chosen = None
    for kind, (_, order, where) in _EXAMPLES.items():
        part = windows.top(spread.where(where), order(), n).select(F.lit(kind).alias("kind"), "question_id", "accuracy")
        chosen = part if chosen is None else chosen.unionByName(part)
    # A few questions: their rows are found by a semi join before anything is grouped.
    near = rows.join(F.broadcast(chosen.select("question_id").distinct()), "question_id", "left_semi")
    first = near.groupBy("question_id", "model_name").agg(F.min_by(F.struct("response", "is_correct", "prompt_type"), "result_id").alias("r"))
    maps = first.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", "r")))).alias("responses"))
    return chosen.join(maps, "question_id").select("kind", "question_id", "accuracy", "responses")


# --- ReAct

_CYCLES = "least({}, {}, {})".format(*(" + ".join(f"((length(l) - length(replace(l, '{m}', ''))) / {len(m)})::BIGINT" for m in pair) for pair in (("think:", "suy nghĩ:"), ("act:", "hành động:"), ("observe:", "quan sát:"))))
_REACT = f"x AS (SELECT *, lower(response) AS l FROM r WHERE contains(lower(prompt_type), 'react') AND response IS NOT NULL AND model_name IS NOT NULL), c AS (SELECT *, {_CYCLES} AS cycles FROM x)"


def _react(spark, folder):
    df = results(spark, folder).where(F.contains(F.lower("prompt_type"), F.lit("react")) & F.col("response").isNotNull() & F.col("model_name").isNotNull())
    return df.withColumn("cycles", sc.react_cycles(F.col("response")))


@query("a69_react_by_model", f"WITH {R}, {_REACT} SELECT model_name, count(*) AS n_rows, {r6('avg(cycles::DOUBLE)')} AS cycles, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy, {r6('avg(latency)')} AS latency, {r6('avg(length(response)::DOUBLE)')} AS response_length FROM c GROUP BY model_name")
def a69_model(spark, folder):
    return _react(spark, folder).groupBy("model_name").agg(
        F.count("*").alias("n_rows"), round6(F.avg(F.col("cycles").cast("double"))).alias("cycles"), round6(ag.rate("is_correct")).alias("accuracy"), round6(F.avg("latency")).alias("latency"),
        round6(F.avg(F.char_length("response").cast("double"))).alias("response_length"),
    )


@query("a69_cycles_to_correctness", f"WITH {R}, {_REACT} SELECT cycles, count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy FROM c GROUP BY cycles")
def a69_cycles(spark, folder):
    return _react(spark, folder).groupBy("cycles").agg(F.count("*").alias("n_rows"), round6(ag.rate("is_correct")).alias("accuracy"))


@query("a69_time_by_category", f"WITH {R} SELECT CASE WHEN contains(lower(prompt_type), 'react') THEN 'ReAct' WHEN contains(lower(prompt_type), 'cot') THEN 'CoT' ELSE 'Other' END AS category, model_name, count(*) AS n_rows, {r6('avg(latency)')} AS latency FROM r WHERE prompt_type IS NOT NULL AND model_name IS NOT NULL GROUP BY ALL")
def a69_time(spark, folder):
    low = F.lower("prompt_type")
    category = F.when(F.contains(low, F.lit("react")), "ReAct").when(F.contains(low, F.lit("cot")), "CoT").otherwise("Other")
    return ag._known(results(spark, folder), ["prompt_type", "model_name"]).groupBy(category.alias("category"), "model_name").agg(F.count("*").alias("n_rows"), round6(F.avg("latency")).alias("latency"))


def _union_sql(kind: str, word: str) -> str:
    return f"SELECT '{kind}' AS kind, model_name, count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy FROM r WHERE model_name IS NOT NULL AND contains(lower(prompt_type), '{word}') GROUP BY model_name"


@query("j08_react_and_cot", f"WITH {R} {_union_sql('ReAct', 'react')} UNION ALL {_union_sql('CoT', 'cot')}")
def j08(spark, folder):
    """Accuracy of ReAct and of CoT prompts by model; a prompt type of both names counts in both."""
    low = F.lower("prompt_type")
    kinds = F.array_compact(F.array(F.when(F.contains(low, F.lit("react")), "ReAct"), F.when(F.contains(low, F.lit("cot")), "CoT")))
    rows = ag._known(results(spark, folder), ["model_name"]).select("model_name", "is_correct", F.explode(kinds).alias("kind"))
    return rows.groupBy("kind", "model_name").agg(F.count("*").alias("n_rows"), round6(ag.rate("is_correct")).alias("accuracy"))


# --- bundles, trees and progress

_LONG = ("is_correct::INT::DOUBLE", "latency", "f1_score", "bleu", "rouge1_f")
_LONG_NAMES = ("accuracy", "latency", "f1_score", "bleu", "rouge1_f")
_SIDES = {"overall": "'all'", "model": "model_name", "prompt": "prompt_type", "model_prompt": "model_name || '/' || prompt_type"}
_TREE = " UNION ALL ".join(f"SELECT '{s}' AS side, {k} AS name, '{n}' AS metric, {r6(f'avg({m})')} AS value FROM r WHERE ({k}) IS NOT NULL GROUP BY {k}" for s, k in _SIDES.items() for m, n in zip(_LONG, _LONG_NAMES))


@query("a08_accuracy_bundle", f"WITH {R} {_TREE}")
def a08(spark, folder):
    """The accuracy bundle as a long tree: side, name, metric, value, overall and by model, prompt and both, from one pass."""
    sides = {"overall": F.lit("all"), "model": F.col("model_name"), "prompt": F.col("prompt_type"), "model_prompt": F.concat("model_name", F.lit("/"), "prompt_type")}
    metrics = {n: F.col("is_correct").cast("double") if n == "accuracy" else F.col(n) for n in _LONG_NAMES}
    long = results(spark, folder).select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), c.alias("name")) for s, c in sides.items()))).alias("x"), *(c.alias(n) for n, c in metrics.items())).where(F.col("x.name").isNotNull())
    g = long.groupBy("x.side", "x.name").agg(*(round6(F.avg(n)).alias(n) for n in _LONG_NAMES))
    return g.unpivot(["side", "name"], list(_LONG_NAMES), "metric", "value")


@query("r05_metric_tree", f"WITH {R}, t AS ({_TREE}) SELECT side, name, string_agg(metric || '=' || coalesce(round(value * 1000)::BIGINT::VARCHAR, 'null'), ',' ORDER BY metric) AS metrics FROM t GROUP BY ALL")
def r05(spark, folder):
    """The long tree folded back to one map a name, printed in thousandths; a map has one entry a metric."""
    text = F.concat("metric", F.lit("="), F.coalesce(F.round(F.col("value") * 1000).cast("bigint").cast("string"), F.lit("null")))
    return a08(spark, folder).groupBy("side", "name").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("metrics"))


@query("a90_progress", f"WITH {R}, n AS (SELECT count(DISTINCT question_id) AS total FROM questions), g AS (SELECT model_name, prompt_type, count(DISTINCT question_id) AS done, avg(is_correct::INT::DOUBLE) AS a, avg(latency) AS l FROM r WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL) SELECT model_name, prompt_type, done, greatest(0, total - done)::BIGINT AS left, {r6('a')} AS accuracy, {r6('greatest(0, total - done) * l')} AS seconds_left FROM g, n")
def a90(spark, folder):
    """Accuracy of each model and prompt so far, what is left of the questions, and for how long at the mean latency."""
    total = table(spark, folder, "questions").select("question_id").distinct().count()
    p = inference.progress(ag._known(results(spark, folder), ["model_name", "prompt_type"]), total)
    return p.select("model_name", "prompt_type", "done", F.col("left").cast("bigint").alias("left"), round6(F.col("accuracy")).alias("accuracy"), round6(F.col("seconds_left")).alias("seconds_left"))


@query("a89_section_statistics", f"WITH {SECTIONS} SELECT coalesce(section, 'general') AS section, count(*) AS n_questions, count(*) FILTER (WHERE solution <> '') AS n_solutions FROM e GROUP BY 1")
def a89(spark, folder):
    """Questions and solutions of each section of the exercise texts."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.sections(docs).groupBy(F.coalesce("section", F.lit("general")).alias("section")).agg(F.count("*").alias("n_questions"), F.count_if(F.col("solution") != "").alias("n_solutions"))


@query("k17_section_documents")
def k17(spark, folder):
    """Questions of the exercise texts as they are written to one file a section: normalised, with difficulty and tags."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.section_documents(docs)


# --- filters and the grid


@query("p01_by_ids", "SELECT question_id, question_type FROM questions WHERE question_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def p01_ids(spark, folder):
    return grid.filtered(table(spark, folder, "questions"), ids=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89]).select("question_id", "question_type")


@query("p02_any_tag", "SELECT question_id FROM questions WHERE len(list_filter(tags, lambda t: lower(t) IN ('phân số', 'diện tích'))) > 0")
def p02(spark, folder):
    return grid.filtered(table(spark, folder, "questions"), tags=["Phân số", "diện tích"]).select("question_id")


@query("p04_difficulty", "SELECT question_id FROM questions WHERE difficulty IN ('Dễ', 'Khó')")
def p04(spark, folder):
    return grid.filtered(table(spark, folder, "questions"), difficulties=["Dễ", "Khó"]).select("question_id")


@query("p05_type", "SELECT question_id FROM questions WHERE lower(question_type) IN ('hình học', 'tỷ lệ')")
def p05(spark, folder):
    return grid.filtered(table(spark, folder, "questions"), types=["Hình học", "tỷ lệ"]).select("question_id")


@query("p06_first_questions", "SELECT question_id FROM questions ORDER BY question_id LIMIT 20")
def p06(spark, folder):
    """The first questions in the order of their ids, as --max-questions takes them."""
    return grid.filtered(table(spark, folder, "questions"), first=20).select("question_id")


@query("p07_test_run", f"WITH {R}, m AS (SELECT min(model_name) AS model_name FROM r), p AS (SELECT min(prompt_type) AS prompt_type FROM r), q AS (SELECT question_id FROM questions ORDER BY question_id LIMIT 2) SELECT * FROM m, p, q")
def p07(spark, folder):
    """A test run: the first model and prompt, and two questions."""
    first = results(spark, folder).agg(F.min("model_name").alias("model_name"), F.min("prompt_type").alias("prompt_type"))
    return grid.filtered(table(spark, folder, "questions"), first=2).select("question_id").crossJoin(F.broadcast(first))


@query("j03_models_with_work", f"""WITH {R}, m AS (SELECT DISTINCT model_name FROM r WHERE model_name IS NOT NULL), p AS (SELECT DISTINCT prompt_type FROM results WHERE prompt_type IS NOT NULL),
  w AS (SELECT model_name, question_id FROM m, p, questions q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.model_name = m.model_name AND r.prompt_type = p.prompt_type AND r.question_id = q.question_id)) SELECT model_name, count(*) AS n_pending FROM w GROUP BY model_name""")
def j03(spark, folder):
    from scoreloom.plans.relations import j02

    return j02(spark, folder).groupBy("model_name").agg(F.count("*").alias("n_pending"))


@query("j04_enriched_by_text", f"""WITH {PX}, q AS (SELECT question, min(question_id) AS first FROM questions WHERE question IS NOT NULL GROUP BY question), k AS (SELECT q.question, coalesce(x.question_type, 'general') AS t, coalesce(x.difficulty, 'Không xác định') AS d FROM q JOIN questions x ON x.question_id = q.first)
  SELECT processed_id, coalesce(t, 'unknown') AS asked_type, coalesce(d, 'unknown') AS asked_difficulty FROM px LEFT JOIN k USING (question)""")
def j04_text(spark, folder):
    """Legacy rows with the type and difficulty of the question whose text is the same; of questions with one text the first id counts."""
    q = table(spark, folder, "questions").where(F.col("question").isNotNull())
    first = q.groupBy("question").agg(F.min_by(F.struct(F.coalesce("question_type", F.lit("general")).alias("t"), F.coalesce("difficulty", F.lit("Không xác định")).alias("d")), "question_id").alias("k"))
    rows = scored(spark, folder).select("processed_id", "question").join(first, "question", "left")
    return rows.select("processed_id", F.coalesce("k.t", F.lit("unknown")).alias("asked_type"), F.coalesce("k.d", F.lit("unknown")).alias("asked_difficulty"))


@query("j11_merged_runs", f"WITH {R}, l AS (SELECT lower(trim(model_name)) AS model_name, prompt_type FROM results), u AS (SELECT model_name, prompt_type, 'analyzed' AS origin FROM r UNION ALL SELECT model_name, prompt_type, 'legacy' FROM l) SELECT model_name, prompt_type, count(*) AS n_rows, count(*) FILTER (WHERE origin = 'legacy') AS n_legacy FROM u WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL")
def j11(spark, folder):
    """Rows of several runs under one key, as the lists of several processes are joined."""
    new = results(spark, folder).select("model_name", "prompt_type", F.lit("analyzed").alias("origin"))
    old = readers.legacy_rows(table(spark, folder, "results")).select("model_name", "prompt_type", F.lit("legacy").alias("origin"))
    return ag._known(new.unionByName(old), ["model_name", "prompt_type"]).groupBy("model_name", "prompt_type").agg(F.count("*").alias("n_rows"), F.count_if(F.col("origin") == "legacy").alias("n_legacy"))


#: Settings by (prompt type, model); examples of a configuration, which is a parameter.
TOKENS = {("cot", "qwen"): {"max_tokens": 768}, ("react", "llama"): {"max_tokens": 1024}, ("default", "gemini"): {"max_tokens": 2048}}
_TOKENS_SQL = "CASE " + " ".join(f"WHEN prompt_type = '{p}' AND model_name = '{m}' THEN {v['max_tokens']}" for (p, m), v in TOKENS.items()) + " " + " ".join(f"WHEN model_name = '{m}' THEN {v['max_tokens']}" for (p, m), v in TOKENS.items() if p == "default") + " ELSE 1024 END"


@query("p25_max_tokens", f"WITH {R} SELECT model_name, prompt_type, {_TOKENS_SQL} AS max_tokens, count(*) AS n_rows FROM r WHERE model_name IS NOT NULL AND prompt_type IS NOT NULL GROUP BY ALL")
def p25(spark, folder):
    keys = ag._known(results(spark, folder), ["model_name", "prompt_type"]).groupBy("model_name", "prompt_type").agg(F.count("*").alias("n_rows"))
    return keys.select("model_name", "prompt_type", inference.settings(F.col("prompt_type"), F.col("model_name"), TOKENS, {"max_tokens": 1024})["max_tokens"].alias("max_tokens"), "n_rows")


@query("p26_numeric_scores", f"WITH {R} SELECT result_id, " + ", ".join(f"try_cast(json_extract_string(CASE WHEN json_valid(reasoning_scores_str) THEN reasoning_scores_str END, '$.{c.removeprefix('reasoning_')}') AS DOUBLE) AS {c.removeprefix('reasoning_')}" for c in CRITERIA) + " FROM r WHERE reasoning_scores_str IS NOT NULL")
def p26(spark, folder):
    """All criteria of the judge's JSON as numbers; what is no number is null."""
    df = results(spark, folder).where(F.col("reasoning_scores_str").isNotNull())
    names = [c.removeprefix("reasoning_") for c in CRITERIA]
    return df.select("result_id", *(F.get_json_object("reasoning_scores_str", f"$.{n}").try_cast("double").alias(n) for n in names))


@query("r04_columns_to_json", f"WITH {R} SELECT result_id, '{{' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '\"{c.removeprefix('reasoning_')}\":' || (round({c} * 100)::BIGINT)::VARCHAR END" for c in CRITERIA) + "], lambda x: x IS NOT NULL), ',') || '}' AS scores FROM r")
def r04_json(spark, folder):
    """The criteria as one JSON object, in hundredths; nulls are left out."""
    return results(spark, folder).select("result_id", F.to_json(F.struct(*(F.round(F.col(c) * 100).cast("bigint").alias(c.removeprefix("reasoning_")) for c in CRITERIA))).alias("scores"))


@query("j12_merged_settings", f"WITH {R} SELECT model_name, CASE WHEN contains(model_name, 'qwen') THEN 'max_tokens=384,temperature=0.7,top_p=0.95' ELSE 'max_tokens=512,temperature=0.7,top_p=0.95' END AS settings FROM (SELECT DISTINCT model_name FROM r WHERE model_name IS NOT NULL)")
def j12(spark, folder):
    """Settings of each model: defaults overridden by its own."""
    base = F.create_map(*(F.lit(x) for kv in (("max_tokens", "512"), ("temperature", "0.7"), ("top_p", "0.95")) for x in kv))
    own = F.when(F.contains("model_name", F.lit("qwen")), F.create_map(F.lit("max_tokens"), F.lit("384"))).otherwise(F.create_map().cast("map<string,string>"))
    models = results(spark, folder).where(F.col("model_name").isNotNull()).select("model_name").distinct()
    merged = readers.merged(base, own)
    return models.select("model_name", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("settings"))


# --- prompts and generation

KINDS = ("standard", "zero_shot", "zero_shot_cot", "cot", "hybrid_cot", "tree_of_thought", "self_consistency_5", "cot_self_consistency_3", "cot_self_consistency_5", "cot_self_consistency_7", "react")


def _frame_sql(kind: str, lang: str = "vi") -> str:
    base = kind.rsplit("_", 1)[0] if kind[-1].isdigit() else kind
    name = "self_consistency" if base.endswith("self_consistency") else base
    before, after = inference.FRAMES[lang][name]
    if "%s" in after:
        after = after % kind.rsplit("_", 1)[1]
    text = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"{text(before)} || question || {text(after)}"


@query("u03_prompts_of_all_kinds", " UNION ALL ".join(f"SELECT question_id, '{k}' AS prompt_type, {_frame_sql(k)} AS prompt FROM questions" for k in KINDS))
def u03(spark, folder):
    """Every question with its prompt of each kind but few-shot."""
    return inference.with_prompts(table(spark, folder, "questions").select("question_id", "question"), KINDS).select("question_id", "prompt_type", "prompt")


@query("u01b_english_prompts", " UNION ALL ".join(f"SELECT question_id, '{k}' AS prompt_type, {_frame_sql(k, 'en')} AS prompt FROM questions" for k in KINDS))
def u01b(spark, folder):
    return inference.with_prompts(table(spark, folder, "questions").select("question_id", "question"), KINDS, frames=inference.FRAMES["en"]).select("question_id", "prompt_type", "prompt")


def _few_sql(kinds, how: str) -> str:
    place = "md5('42-' || question_id::VARCHAR), question_id" if how == "random" else "question_id"
    text = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"
    before, after = inference.FRAMES["vi"]["few_shot"]
    bank = f"b AS (SELECT question AS q, solution AS s, row_number() OVER (ORDER BY {place}) AS place FROM questions WHERE question IS NOT NULL AND solution IS NOT NULL)"
    shown = lambda n: f"(SELECT string_agg(q || chr(10) || s, chr(10) || chr(10) ORDER BY place) FROM b WHERE place <= {n})"
    return f"WITH {bank} " + " UNION ALL ".join(f"SELECT question_id, '{k}' AS prompt_type, {text(before)} || {shown(k[-1])} || chr(10) || chr(10) || question || {text(after)} AS prompt FROM questions" for k in kinds)


_FEW = ("few_shot_3", "few_shot_5", "few_shot_7")


def _few(name: str, how: str) -> None:
    def run(spark, folder):
        q = table(spark, folder, "questions")
        bank = inference.choose_examples(q.select("question_id", "question", F.col("solution").alias("answer")), 7, how)
        return inference.with_prompts(q.select("question_id", "question"), _FEW, bank).select("question_id", "prompt_type", "prompt")

    query(name, _few_sql(_FEW, how))(run)


_few("u02_few_shot_prompts", "random")
_few("u04_first_examples_prompts", "default")


def _solver(prompts):
    """The offline backend: it answers with the last number of a prompt."""
    import re

    return [f"Bước 1: đọc đề.\nĐáp án: {(re.findall(r'[0-9]+', p) or ['0'])[-1]}" for p in prompts]


@query("u08_evaluated", """WITH q AS (SELECT *, list_last(regexp_extract_all(question, '[0-9]+')) AS n FROM questions WHERE question IS NOT NULL)
  SELECT question_id, 'Bước 1: đọc đề.' || chr(10) || 'Đáp án: ' || coalesce(n, '0') AS response, coalesce(n, '0') AS final_answer FROM q""")
def u08(spark, folder):
    """Result rows of a whole evaluation with the offline backend: prompt, response, final answer."""
    asked = inference.with_prompts(table(spark, folder, "questions").where(F.col("question").isNotNull()), ["zero_shot"])
    return inference.evaluate(asked, "offline", _solver).select("question_id", "response", "final_answer")


@query("u08_accuracy_by_prompt")
def u08_accuracy(spark, folder):
    """Accuracy of a whole evaluation by prompt type, with the offline backend."""
    asked = inference.with_prompts(table(spark, folder, "questions").where(F.col("question").isNotNull()), ["zero_shot", "cot", "react"])
    rows = inference.evaluate(asked, "offline", _solver)
    return rows.groupBy("prompt_type").agg(F.count("*").alias("n_rows"), round6(ag.rate("is_correct")).alias("accuracy"))


_WORDS = "len(list_filter(string_split(trim(regexp_replace(coalesce({}, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), ' '), lambda t: t <> ''))::BIGINT"


@query("u16_throughput", f"WITH {R} SELECT model_name, count(*) AS n_requests, sum({_WORDS.format('question_text')})::BIGINT AS input_words, sum({_WORDS.format('response')})::BIGINT AS output_words, {r6('CASE WHEN sum(latency) > 0 THEN sum(' + _WORDS.format('response') + ') / sum(latency) ELSE 0.0::DOUBLE END')} AS words_per_second FROM r WHERE model_name IS NOT NULL AND latency > 0 GROUP BY model_name")
def u16(spark, folder):
    df = ag._known(results(spark, folder), ["model_name"]).where(F.col("latency") > 0)
    out = inference.throughput(df, ["model_name"], "question_text")
    return out.select("model_name", "n_requests", "input_words", "output_words", round6(F.col("words_per_second")).alias("words_per_second"))


@query("u14_ngrams", "WITH w AS (SELECT question_id, list_filter(string_split(trim(regexp_replace(coalesce(question, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), ' '), lambda t: t <> '') AS w FROM questions), g AS (SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 0) + 1), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) > 1")
def u14(spark, folder):
    """Pairs of neighbouring words that questions have more than once."""
    grams = table(spark, folder, "questions").select(F.explode(tx.ngrams(tx.words(F.col("question")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1)


@query("u13_pluggable_score", f"WITH {R} SELECT model_name, count(*) AS n, {r6('avg((length(response) > length(expected_answer))::INT::DOUBLE)')} AS score FROM r WHERE model_name IS NOT NULL AND response IS NOT NULL AND expected_answer IS NOT NULL GROUP BY model_name")
def u13(spark, folder):
    """A corpus score by a scorer of one's own: the share of responses longer than their reference."""
    longer = lambda r, e: (F.char_length(r) > F.char_length(e)).cast("double")
    return ag.corpus_score(results(spark, folder), ["model_name"], F.col("response"), F.col("expected_answer"), longer)


# --- small helpers


@query("n07_row_spread", f"WITH {R}, l AS (SELECT result_id, list_filter([{', '.join(CRITERIA)}], lambda x: x IS NOT NULL) AS v FROM r) SELECT result_id, {r6('list_max(v) - list_min(v)')} AS spread, {r6('CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END')} AS std FROM l WHERE len(v) > 0")
def n07(spark, folder):
    """Greatest difference and deviation of a row's criteria, nulls left out."""
    present = F.filter(F.array(*CRITERIA), lambda x: x.isNotNull())
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))

    def std(v):
        mean = total(v, lambda x: x) / F.size(v)
        return F.when(F.size(v) > 1, let(lambda m, w: F.sqrt(total(w, lambda x: (x - m) * (x - m)) / (F.size(w) - 1)), mean, v))

    df = results(spark, folder).select("result_id", present.alias("v")).where(F.size("v") > 0)
    return df.select("result_id", round6(F.array_max("v") - F.array_min("v")).alias("spread"), round6(std(F.col("v"))).alias("std"))


@query("h01_map_default", f"WITH {R} SELECT result_id, coalesce(try_cast(json_extract_string(CASE WHEN json_valid(reasoning_scores_str) THEN reasoning_scores_str END, '$.accuracy') AS DOUBLE), -1.0::DOUBLE) AS accuracy FROM r")
def h01(spark, folder):
    """A value of a map by key, with a default for a missing key or map."""
    scores = F.from_json("reasoning_scores_str", "map<string,string>")
    return results(spark, folder).select("result_id", F.coalesce(F.try_element_at(scores, F.lit("accuracy")).try_cast("double"), F.lit(-1.0)).alias("accuracy"))


@query("dt01_iso_stamps", f"WITH {R} SELECT result_id, strftime(run_timestamp, '%Y-%m-%dT%H:%M:%S') AS iso FROM r WHERE run_timestamp IS NOT NULL")
def dt01(spark, folder):
    return results(spark, folder).where(F.col("run_timestamp").isNotNull()).select("result_id", F.date_format("run_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("dt05_wait_seconds", f"WITH {R} SELECT result_id, greatest(0, (epoch_us(ingested_at) - epoch_us(run_timestamp)) // 1000000)::BIGINT AS seconds FROM r WHERE run_timestamp IS NOT NULL AND ingested_at IS NOT NULL AND epoch_us(ingested_at) >= epoch_us(run_timestamp)")
def dt05(spark, folder):
    """Whole seconds from a row's time to the time that an HTTP date names, 0 for one in the past."""
    df = results(spark, folder).where(F.col("run_timestamp").isNotNull() & F.col("ingested_at").isNotNull() & (F.col("ingested_at") >= F.col("run_timestamp")))
    # The date is written to whole seconds, so the rest of both times is compared apart.
    rest = (F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("run_timestamp").cast("timestamp")))
    return df.select("result_id", F.greatest(F.lit(0).cast("bigint"), F.floor(rest / 1000000).cast("bigint")).alias("seconds"))


# --- runs and their files


@query("s14_latest_run_with", f"WITH {R}, g AS (SELECT run_id, max(run_timestamp) AS t, list(DISTINCT model_name) AS m, count(DISTINCT CASE WHEN prompt_type IN ('cot', 'react') THEN prompt_type END) AS n FROM r WHERE run_id IS NOT NULL AND model_name IS NOT NULL GROUP BY run_id) SELECT arg_max(run_id, (t, run_id)) AS run_id FROM g WHERE list_has_all(m, ['llama', 'qwen']) AND n = 2 AND t IS NOT NULL")
def s14_latest(spark, folder):
    """The newest run that has all wanted models and prompts."""
    return readers.latest_run(ag._known(results(spark, folder), ["run_id", "model_name"]), ["llama", "qwen"], ["cot", "react"])


@query("s13_run_sizes", f"WITH {R} SELECT run_id, count(*) AS n_rows, count(DISTINCT model_name) AS n_models, sum(octet_length(encode(coalesce(response, ''))))::BIGINT AS n_bytes FROM r WHERE run_id IS NOT NULL GROUP BY run_id")
def s13_sizes(spark, folder):
    """Rows, models and bytes of responses of each run."""
    df = ag._known(results(spark, folder), ["run_id"])
    return df.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count_distinct("model_name").alias("n_models"), F.sum(F.octet_length(F.coalesce("response", F.lit(""))).cast("bigint")).alias("n_bytes"))


@query("k07_summary_lines", f"WITH {R}, t AS ({_TREE}) SELECT '- ' || side || ' ' || name || ' ' || metric || ': ' || coalesce(round(value * 1000)::BIGINT::VARCHAR, 'n/a') AS line FROM t")
def k07(spark, folder):
    """The metric tree as lines of a summary, values in thousandths."""
    value = F.coalesce(F.round(F.col("value") * 1000).cast("bigint").cast("string"), F.lit("n/a"))
    return a08(spark, folder).select(F.concat(F.lit("- "), "side", F.lit(" "), "name", F.lit(" "), "metric", F.lit(": "), value).alias("line"))


@query("s15_generated_corpus")
def s15(spark, folder):
    """Generated questions by type and difficulty: five families, weighted, the same in every run."""
    from scoreloom.sources.generate import generate

    return generate(spark, 2000).groupBy("question_type", "difficulty").agg(F.count("*").alias("n"))


@query("n03_josephus", "WITH RECURSIVE j AS (SELECT k, 1 AS n, 0 AS spot FROM range(2, 8) AS t(k) UNION ALL SELECT k, n + 1, (spot + k) % (n + 1) FROM j WHERE n < 30) SELECT n::BIGINT AS n, k::BIGINT AS k, (spot + 1)::BIGINT AS survivor FROM j WHERE n >= 2")
def n03(spark, folder):
    from scoreloom.sources.generate import survivor

    pairs = spark.range(2, 31).select(F.col("id").alias("n"), F.explode(F.expr("sequence(2L, 7L)")).alias("k"))
    return pairs.select("n", "k", survivor(F.col("n").cast("int"), F.col("k").cast("int")).alias("survivor"))


@query("k05_report_tables")
def k05(spark, folder):
    """The lines of the Markdown report."""
    lines = sinks.markdown_report(results(spark, folder)).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


@query("k16_corpus_lines", "SELECT question_id, coalesce(question_type, 'general') AS question_type, length(question) AS n_chars, coalesce(len(tags), 0)::BIGINT AS n_tags FROM questions")
def k16_lines(spark, folder):
    """The corpus as it is written, one JSON line a question, read back."""
    q = table(spark, folder, "questions").select(F.to_json(F.struct("question_id", "question", "question_type", "tags")).alias("line"))
    back = q.select(F.from_json("line", "question_id bigint, question string, question_type string, tags array<string>").alias("q")).select("q.*")
    return back.select("question_id", F.coalesce("question_type", F.lit("general")).alias("question_type"), F.char_length("question").cast("bigint").alias("n_chars"), F.coalesce(F.when(F.col("tags").isNotNull(), F.size("tags")), F.lit(0)).cast("bigint").alias("n_tags"))
