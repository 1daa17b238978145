"""Queries of the text functions and row scores, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import answers, reasoning, udfs
from scoreloom.functions import scoring as sc
from scoreloom.functions import text as tx
from scoreloom.functions.numbers import fraction_equal, gcd, let, number_equal, round6
from scoreloom.plans.analytics import PX, r6, scored
from scoreloom.plans.base import R, query
from scoreloom.plans.base import results as _results
from scoreloom.session import spread
from scoreloom.sources.tables import table


def results(spark, folder):
    """Result rows for row scores, which cost more than moving the few columns they read."""
    kept = ("result_id", "model_name", "prompt_type", "question_id", "question_type", "question_text", "response", "expected_answer", "is_correct", "rouge1_f", "bleu", "reasoning_scores_str", "error_type", "error_explanation")
    return spread(_results(spark, folder).select(*kept))


#: The same expressions in SQL.
_SP = r"[ \t\n\r\f\v]"
_PUNCT = tx.PUNCTUATION.replace("'", "''")


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'), ' ')"


def _clean(x: str, numbers: bool = False) -> str:
    out = f"translate(lower(coalesce({x}, '')), '{_PUNCT}', '')"
    return _collapse(f"regexp_replace({out}, '[0-9]+', '', 'g')" if numbers else out)


def _words(x: str) -> str:
    return f"list_filter(string_split({_collapse(f'''coalesce({x}, '')''')}, ' '), lambda t: t <> '')"


def _numbers(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[-+]?[0-9]+[.,]?[0-9]*'), lambda t: try_cast(replace(t, ',', '.') AS DOUBLE)), lambda v: v IS NOT NULL)"


def _overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda z: z = x))))), 0)::BIGINT"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def _rows(name: str, column: str, make, sql: str | None = None, source: str = "response", where: str | None = None) -> None:
    """A query of one scalar function over all responses."""
    text = f"WITH {R} SELECT result_id, {sql} AS {column} FROM r" + (f" WHERE {where}" if where else "") if sql else None

    def run(spark, folder):
        df = results(spark, folder)
        return (df.where(where) if where else df).select("result_id", make(F.col(source)).alias(column))

    query(name, text)(run)


_rows("f01_clean_text", "cleaned", lambda c: tx.clean_text(c, numbers=True, unicode=True))
_rows("f01_clean_text_as_composed", "cleaned", lambda c: tx.clean_text(c, numbers=True), _clean("response", True))
_rows("f02_remove_diacritics", "plain", lambda c: tx.remove_diacritics(c), f"translate(regexp_replace(question_text, '[̀-ͯ]', '', 'g'), '{tx.ACCENTED}', '{tx.BASE}')", "question_text")
_rows("f03_tokens", "tokens", lambda c: F.array_join(tx.tokens(c), " "), f"""array_to_string({_words("regexp_replace(coalesce(response, ''), '([.,!?();:\"\'\'])', ' \\1 ', 'g')")}, ' ')""")
_rows("f04_normalize_text", "normalized", lambda c: tx.normalize_spacing(c, unicode=True))
_rows(
    "f04_normalize_spacing", "normalized", tx.normalize_spacing,
    _collapse("regexp_replace(" * 8 + "coalesce(question_text, ''), '" + _SP + r"+([,.!?;:])', '\1', 'g'), '([,.!?;:])([^ \t\n\r\f\v0-9])', '\1 \2', 'g'), '\(" + _SP + r"+', '(', 'g'), '" + _SP + r"+\)', ')', 'g'), '"
              + '"' + _SP + "+', '\"', 'g'), '" + _SP + "+\"', '\"', 'g'), '''" + _SP + "+', '''', 'g'), '" + _SP + "+''', '''', 'g')"),
    "question_text",
)
_rows("f05_numbers", "numbers", lambda c: F.array_join(F.transform(tx.numbers(c), lambda x: F.round(x * 1000).cast("bigint").cast("string")), " "), f"array_to_string(list_transform({_numbers('response')}, lambda x: round(x * 1000)::BIGINT::VARCHAR), ' ')", "response", "response IS NOT NULL")
_rows("f06_is_vietnamese", "vietnamese", tx.is_vietnamese, f"coalesce(length(response) > 0 AND length(response) - length(translate(response, '{tx.VIETNAMESE}', '')) >= 0.3 * length(response), false)")
_rows("f12_sentences", "sentences", lambda c: F.array_join(tx.sentences(c), "\n"), None, "response", "response IS NOT NULL")
_rows("f14_normalize_answer", "answer", tx.normalize_answer, f"""coalesce(nullif(regexp_extract(translate(lower({_collapse('response')}), '.,;:!?()"\'\'', ''), '[-+]?[0-9]*\\.?[0-9]+'), ''), translate(lower({_collapse('response')}), '.,;:!?()"\'\'', ''))""", "response")
_MARKED = ", ".join(f"nullif(trim(regexp_extract(response, '(?is){m}(.+?)(?:\\z|\n\n)', 1), ' '), '')" for m in tx.ANSWER_MARKERS)
_rows("f15_final_answer", "answer", tx.final_answer, f"coalesce({_MARKED}, nullif(trim(list_last(string_split(response, '\n\n')), ' '), ''), response)")
_rows("p27_preview", "preview", tx.preview, "CASE WHEN length(response) > 100 THEN substring(response, 1, 100) || '...' ELSE response END")
_rows("p24_token_estimate", "n_tokens", lambda c: F.floor(F.char_length(c) / 3), "floor(length(response) / 3)::BIGINT")


@query("f07_jaccard", f"WITH {R}, w AS (SELECT result_id, {_words(_clean('response'))} AS a, {_words(_clean('expected_answer'))} AS b FROM r) SELECT result_id, {r6('CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END')} AS jaccard FROM w")
def f07(spark, folder):
    a, b = tx.words(tx.clean_text(F.col("response"))), tx.words(tx.clean_text(F.col("expected_answer")))
    return results(spark, folder).select("result_id", round6(tx.jaccard(a, b)).alias("jaccard"))


@query("f08_cosine", f"""WITH {R}, w AS (SELECT result_id, {_words(_clean('question_text'))} AS a, {_words(_clean('expected_answer'))} AS b FROM r),
  c AS (SELECT *, list_transform(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x))::DOUBLE) AS na, list_transform(list_distinct(b), lambda x: len(list_filter(b, lambda y: y = x))::DOUBLE) AS nb,
    list_transform(list_intersect(a, b), lambda x: len(list_filter(a, lambda y: y = x))::DOUBLE * len(list_filter(b, lambda z: z = x))) AS ab FROM w)
  SELECT result_id, {r6('CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE coalesce(list_sum(ab), 0) / (sqrt(list_sum(list_transform(na, lambda x: x * x))) * sqrt(list_sum(list_transform(nb, lambda x: x * x)))) END')} AS cosine FROM c""")
def f08(spark, folder):
    return results(spark, folder).select("result_id", round6(udfs.cosine_counts(tx.clean_text(F.col("question_text")), tx.clean_text(F.col("expected_answer")))).alias("cosine"))


@query("f09_levenshtein")
def f09(spark, folder):
    """Edit-distance similarity of the cleaned question and answer, letters with accents included."""
    df = results(spark, folder).select("result_id", tx.clean_text(F.col("question_text")).alias("a"), tx.clean_text(F.col("expected_answer")).alias("b"))
    return df.select("result_id", round6(tx.levenshtein_ratio(F.col("a"), F.col("b"))).alias("similarity"))


_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"


@query("f10_keywords", f"SELECT question_id, array_to_string(list_filter({_words(_clean('question'))}, lambda t: t NOT IN {_STOP} AND length(t) >= 2), ' ') AS keywords FROM questions")
def f10(spark, folder):
    return table(spark, folder, "questions").select("question_id", F.array_join(tx.keywords(F.col("question")), " ").alias("keywords"))


@query("f11_format_number", f"WITH {PX} SELECT processed_id, translate(format('{{:,.2f}}', elapsed_time * 1000), '.,', ',.') || ' đ' AS price FROM px WHERE elapsed_time IS NOT NULL")
def f11(spark, folder):
    return scored(spark, folder).where(F.col("elapsed_time").isNotNull()).select("processed_id", tx.format_number(F.col("elapsed_time") * 1000, currency="VND").alias("price"))


_QW, _SW = f"len({_words('question')})", f"len({_words('solution')})"


@query("f19_difficulty", f"SELECT question_id, CASE WHEN {_QW} = 0 THEN 'Dễ' WHEN {_SW}::DOUBLE / {_QW} > 3.5 OR {_SW} > 100 THEN 'Khó' WHEN {_SW}::DOUBLE / {_QW} > 1.8 OR {_SW} > 50 THEN 'Trung bình' ELSE 'Dễ' END AS estimated FROM questions")
def f19(spark, folder):
    return table(spark, folder, "questions").select("question_id", tx.difficulty(F.col("question"), F.col("solution")).alias("estimated"))


def _tags_sql() -> str:
    alone = [f"CASE WHEN regexp_matches(t, '{tx.tag_pattern(ws)}') THEN '{k}' END" for k, ws in tx.TAG_WORDS.items()]
    parts = ["CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in tx.TAG_PARTS.items()]
    found = "list_distinct(list_filter([" + ", ".join(alone + parts) + "], lambda x: x IS NOT NULL))"
    return f"WITH q AS (SELECT question_id, lower(coalesce(question, '')) AS t FROM questions), f AS (SELECT question_id, {found} AS tags FROM q) SELECT question_id, array_to_string(CASE WHEN len(tags) = 0 THEN ['tổng hợp'] ELSE list_sort(tags) END, ',') AS tags FROM f"


@query("f21_tags", _tags_sql())
def f21(spark, folder):
    return table(spark, folder, "questions").select("question_id", F.array_join(tx.tags(F.col("question")), ",").alias("tags"))


for _name, _more in (("f22_tags_extracted", False), ("f22c_tags_first_generator", True)):
    _kinds = {t: ws + (tx.MORE_TAG_WORDS[t] if _more else ()) for t, ws in tx.SHORT_TAG_WORDS.items()}
    _cells = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(question, '')), '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in _kinds.items())
    query(_name, f"SELECT question_id, array_to_string(list_filter([{_cells}], lambda x: x IS NOT NULL), ',') AS tags FROM questions")(
        lambda spark, folder, more=_more: table(spark, folder, "questions").select("question_id", F.array_join(tx.short_tags(F.col("question"), more), ",").alias("tags"))
    )


@query("f20_difficulty_by_length", f"SELECT question_id, CASE WHEN {_QW} = 0 THEN 'Dễ' WHEN {_SW} > 2 * {_QW} THEN 'Khó' WHEN {_SW} > 1.5 * {_QW} THEN 'Trung bình' ELSE 'Dễ' END AS estimated FROM questions")
def f20(spark, folder):
    return table(spark, folder, "questions").select("question_id", tx.length_difficulty(F.col("question"), F.col("solution")).alias("estimated"))


@query("f18_normalize_extracted", f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_SP}+', ' ', 'g'), ' *([.,!?]) *', '\\1 ', 'g'), ' *([()\\[\\]]) *', '\\1', 'g'), ' ') AS line FROM documents""")
def f18(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", tx.normalize_extracted(F.col("text")).alias("line"))


@query("f23_subject", "SELECT subject, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{k}'" for k, p in tx.SUBJECT_PATTERNS) + " ELSE 'general' END AS subject FROM questions) GROUP BY subject")
def f23(spark, folder):
    return table(spark, folder, "questions").groupBy(tx.subject(F.col("question")).alias("subject")).agg(F.count("*").alias("n"))


@query("f24_vietnamese_letters", "SELECT question_id, regexp_matches(question, '[À-ỹ]') AS vietnamese FROM questions")
def f24(spark, folder):
    return table(spark, folder, "questions").select("question_id", F.col("question").rlike("[\\u00C0-\\u1EF9]").alias("vietnamese"))


@query("f16_answer_by_prompt")
def f16(spark, folder):
    """The final answer by kind of prompt; '' for a null response."""
    return results(spark, folder).select("result_id", reasoning.answer_by_prompt(F.col("response"), F.coalesce("prompt_type", F.lit(""))).alias("answer"))


@query("f17_structured")
def f17(spark, folder):
    """Responses to ReAct prompts in the frame of thinking, acting and observing."""
    df = results(spark, folder).where(F.contains(F.lower("prompt_type"), F.lit("react")) & F.col("response").isNotNull())
    return df.select("result_id", reasoning.structured(F.col("response")).alias("structured"))


@query("p16_prompt_features", f"""WITH {R} SELECT DISTINCT prompt_type, regexp_replace(prompt_type, '_[0-9]+$', '') AS base, nullif(regexp_extract(prompt_type, '([0-9]+)', 1), '')::INTEGER AS shots,
  CASE WHEN contains(lower(prompt_type), 'few_shot') THEN 'Few-shot' WHEN contains(lower(prompt_type), 'zero_shot') THEN 'Zero-shot' WHEN contains(lower(prompt_type), 'cot') THEN 'CoT' WHEN contains(lower(prompt_type), 'react') THEN 'ReAct' ELSE 'Other' END AS category FROM r""")
def p16(spark, folder):
    c = F.col("prompt_type")
    return results(spark, folder).select("prompt_type").distinct().select("prompt_type", tx.base_prompt(c).alias("base"), tx.shots(c).alias("shots"), tx.prompt_category(c).alias("category"))


@query("p19_prompt_classes", f"""WITH {R}, u AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS class, is_correct FROM r WHERE {w}" for k, w in {
    "zero_shot": "starts_with(lower(prompt_type), 'zero_shot')", "few_shot": "contains(lower(prompt_type), 'few_shot')", "cot": "contains(lower(prompt_type), 'cot')", "self_consistency": "contains(lower(prompt_type), 'self_consistency')", "react": "contains(lower(prompt_type), 'react')"}.items()) + f") SELECT class, count(*) AS n_rows, {r6('avg(is_correct::INT::DOUBLE)')} AS accuracy FROM u GROUP BY class")
def p19(spark, folder):
    df = results(spark, folder).withColumn("class", F.explode(tx.prompt_classes(F.col("prompt_type"))))
    return df.groupBy("class").agg(F.count("*").alias("n_rows"), round6(F.avg(F.col("is_correct").cast("double"))).alias("accuracy"))


@query("g01_exact_match", f"WITH {R} SELECT result_id, CASE WHEN response IS NOT NULL AND expected_answer IS NOT NULL THEN {_clean('response')} = {_clean('expected_answer')} END AS matched FROM r")
def g01(spark, folder):
    return results(spark, folder).select("result_id", sc.exact_match(F.col("response"), F.col("expected_answer")).alias("matched"))


_RSTOP = "(" + ", ".join(f"'{w}'" for w in sc.RELAXED_STOP) + ")"


def _relaxed(x: str) -> str:
    kept = f"regexp_replace({_clean(x)}, '[^a-zA-Z0-9 À-ỹ]', '', 'g')"
    return f"array_to_string(list_filter({_words(kept)}, lambda w: w NOT IN {_RSTOP}), ' ')"


@query("g02_relaxed_match", f"""WITH {R}, x AS (SELECT result_id, {_relaxed('response')} AS p, {_relaxed('expected_answer')} AS q FROM r WHERE response IS NOT NULL AND expected_answer IS NOT NULL),
  y AS (SELECT *, list_distinct(list_filter(string_split(p, ' '), lambda w: length(w) >= 3)) AS a, list_distinct(list_filter(string_split(q, ' '), lambda w: length(w) >= 3)) AS b FROM x)
  SELECT result_id, p = q OR contains(p, q) OR contains(q, p) OR (len(list_intersect(a, b)) > 0 AND len(list_intersect(a, b)) >= 0.8::DOUBLE * least(len(a), len(b))) AS matched FROM y""")
def g02(spark, folder):
    df = results(spark, folder).where(F.col("response").isNotNull() & F.col("expected_answer").isNotNull())
    return df.select("result_id", sc.relaxed_match(F.col("response"), F.col("expected_answer")).alias("matched"))


_PAIR = f"w AS (SELECT result_id, model_name, {_words(_clean('response'))} AS a, {_words(_clean('expected_answer'))} AS b FROM r)"


@query("g03_token_overlap", f"WITH {R}, {_PAIR}, o AS (SELECT *, {_overlap('a', 'b')} AS s FROM w WHERE len(a) > 0 AND len(b) > 0), m AS (SELECT *, {_ratio('s', 'len(a)')} AS p, {_ratio('s', 'len(b)')} AS q FROM o) SELECT result_id, {r6('p')} AS precision, {r6('q')} AS recall, {r6(_ratio('2 * p * q', 'p + q'))} AS f1 FROM m")
def g03(spark, folder):
    df = results(spark, folder).select("result_id", sc.token_overlap(F.col("response"), F.col("expected_answer")).alias("o")).where(F.col("o").isNotNull())
    return df.select("result_id", *(round6(F.col(f"o.{k}")).alias(k) for k in ("precision", "recall", "f1")))


@query("a34_token_overlap_mean", f"WITH {R}, {_PAIR}, o AS (SELECT *, {_overlap('a', 'b')} AS s FROM w WHERE len(a) > 0 AND len(b) > 0 AND model_name IS NOT NULL) SELECT model_name, count(*) AS n, {r6('avg(' + _ratio('s', 'len(a)') + ')')} AS precision, {r6('avg(' + _ratio('s', 'len(b)') + ')')} AS recall FROM o GROUP BY model_name")
def a34(spark, folder):
    df = results(spark, folder).where(F.col("model_name").isNotNull()).select("model_name", sc.token_overlap(F.col("response"), F.col("expected_answer")).alias("o")).where(F.col("o").isNotNull())
    return df.groupBy("model_name").agg(F.count("*").alias("n"), round6(F.avg("o.precision")).alias("precision"), round6(F.avg("o.recall")).alias("recall"))


@query("a33_exact_match_rate", f"WITH {R}, m AS (SELECT model_name, {_clean('response')} = {_clean('expected_answer')} AS e FROM r WHERE response IS NOT NULL AND expected_answer IS NOT NULL AND model_name IS NOT NULL) SELECT model_name, count(*) AS n, count(*) FILTER (WHERE e) AS n_matched, {r6('avg(e::INT::DOUBLE)')} AS matched_rate FROM m GROUP BY model_name")
def a33(spark, folder):
    df = results(spark, folder).where(F.col("model_name").isNotNull()).select("model_name", sc.exact_match(F.col("response"), F.col("expected_answer")).alias("e")).where(F.col("e").isNotNull())
    return df.groupBy("model_name").agg(F.count("*").alias("n"), F.count_if("e").alias("n_matched"), round6(F.avg(F.col("e").cast("double"))).alias("matched_rate"))


def _ngrams(a: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({a}) - {n - 1}, 0) + 1), lambda i: array_to_string({a}[i:i + {n - 1}], ' '))"


for _n in (1, 2):
    _sql = f"""WITH {R}, {_PAIR}, g AS (SELECT result_id, {_ngrams('a', _n)} AS a, {_ngrams('b', _n)} AS b FROM w), o AS (SELECT *, {_overlap('a', 'b')} AS s FROM g), m AS (SELECT *, {_ratio('s', 'len(a)')} AS p, {_ratio('s', 'len(b)')} AS q FROM o)
      SELECT result_id, {r6('p')} AS precision, {r6('q')} AS recall, {r6(_ratio('2 * p * q', 'p + q'))} AS f FROM m"""

    def _rouge(spark, folder, n=_n):
        df = results(spark, folder).select("result_id", sc.rouge_n(F.col("response"), F.col("expected_answer"), n).alias("o"))
        return df.select("result_id", *(round6(F.col(f"o.{k}")).alias(k) for k in ("precision", "recall", "f")))

    query(f"g06_rouge_{_n}", _sql)(_rouge)


@query("g07_bleu_1", f"WITH {R}, {_PAIR} SELECT result_id, {r6('(CASE WHEN len(a) >= len(b) THEN 1.0::DOUBLE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE exp(1 - len(b)::DOUBLE / len(a)) END) * ' + '(' + _ratio(_overlap('a', 'b'), 'len(a)') + ')')} AS bleu FROM w")
def g07(spark, folder):
    return results(spark, folder).select("result_id", round6(sc.bleu_n(F.col("response"), F.col("expected_answer"), 1)).alias("bleu"))


@query("g08_meteor_unigram", f"WITH {R}, {_PAIR}, o AS (SELECT *, {_overlap('a', 'b')} AS s FROM w), m AS (SELECT *, {_ratio('s', 'len(a)')} AS p, {_ratio('s', 'len(b)')} AS q FROM o) SELECT result_id, {r6(_ratio('p * q', '0.9::DOUBLE * p + (1 - 0.9::DOUBLE) * q'))} AS meteor FROM m")
def g08(spark, folder):
    return results(spark, folder).select("result_id", round6(sc.meteor_unigram(F.col("response"), F.col("expected_answer"))).alias("meteor"))


def _metrics(spark, folder):
    """Result rows with the struct `m` of all metrics of response against expected answer, from one Arrow pass."""
    df = results(spark, folder).select("result_id", "model_name", tx.clean_text(F.col("response")).alias("c"), tx.clean_text(F.col("expected_answer")).alias("r"))
    return df.select("result_id", "model_name", "c", "r", udfs.text_metrics("c", "r").alias("m"))


@query("g12_arrow_metrics")
def g12(spark, folder):
    """All text metrics of each row: F1 (by its fallback where no word is shared), exact match, ROUGE-1, 2 and L, BLEU, METEOR and token similarity."""
    df = results(spark, folder)
    c, r = F.col("response"), F.col("expected_answer")
    df = df.select("result_id", sc.fallback_f1(c, r).alias("fallback"), tx.clean_text(c).alias("c"), tx.clean_text(r).alias("r"))
    df = df.select("result_id", "fallback", (F.col("c") == F.col("r")).cast("double").alias("exact"), udfs.text_metrics("c", "r").alias("m"), udfs.token_similarity()("c", "r").alias("t"))
    f1 = F.when(F.col("m.f1") > 0, F.col("m.f1")).otherwise(F.col("fallback"))
    named = {"f1_score": f1, "exact_match": F.col("exact"), "token_similarity": F.col("t.f")} | {k: F.col(f"m.{k}") for k in ("rouge1_f", "rouge2_f", "rougel_f", "bleu", "bleu1", "bleu2", "bleu4", "meteor")}
    return df.select("result_id", *(round6(x).alias(k) for k, x in named.items()))


@query("g05_fallback_f1")
def g05(spark, folder):
    """The fallback F1 of the rows whose texts share no word."""
    df = results(spark, folder).select("result_id", sc.fallback_f1(F.col("response"), F.col("expected_answer")).alias("f1"), udfs.overlap(1)(tx.clean_text(F.col("response")), tx.clean_text(F.col("expected_answer"))).alias("o"))
    return df.where(F.col("o.shared") == 0).select("result_id", round6(F.col("f1")).alias("f1"))


@query("g11_similarity")
def g11(spark, folder):
    """rouge_score, the mean of the three ROUGE F, and bleu_score."""
    rouge = (F.col("m.rouge1_f") + F.col("m.rouge2_f") + F.col("m.rougel_f")) / 3
    return _metrics(spark, folder).select("result_id", round6(rouge).alias("rouge_score"), round6(F.col("m.bleu")).alias("bleu_score"))


@query("g09_token_similarity")
def g09(spark, folder):
    """Greedy token similarity with the offline encoder; a model's encoder can be passed instead."""
    df = results(spark, folder).select("result_id", tx.clean_text(F.col("response")).alias("c"), tx.clean_text(F.col("expected_answer")).alias("r"))
    return df.select("result_id", udfs.token_similarity()("c", "r").alias("t")).select("result_id", *(round6(F.col(f"t.{k}")).alias(k) for k in ("precision", "recall", "f")))


@query("g10_text_cosine")
def g10_text(spark, folder):
    """Cosine of the two texts' vectors by the offline encoder."""
    df = results(spark, folder).select("result_id", tx.clean_text(F.col("response")).alias("c"), tx.clean_text(F.col("expected_answer")).alias("r"))
    return df.select("result_id", round6(udfs.text_cosine()("c", "r")).alias("cosine"))


def _corpus_means(name: str, metrics: tuple[str, ...]) -> None:
    @query(name)
    def run(spark, folder):
        """Means over all rows of a model; rows without a text count 0."""
        df = _metrics(spark, folder).where(F.col("model_name").isNotNull())
        return df.groupBy("model_name").agg(F.count("*").alias("n_rows"), *(round6(F.avg(f"m.{m}")).alias(m) for m in metrics))


_corpus_means("a35_rouge", tuple(m for m in udfs.METRICS if m.startswith("rouge")))
_corpus_means("a36_bleu", ("bleu", "bleu1", "bleu2", "bleu3", "bleu4"))
_corpus_means("a37_meteor", ("meteor",))
_corpus_means("a38_text_bundle", udfs.METRICS)


@query("g16_legacy_correctness")
def g16(spark, folder):
    """Legacy correctness: last number, matching-block ratio and keyword ratio decide the class."""
    df = scored(spark, folder).select("processed_id", F.lower(F.trim("response")).alias("c"), F.lower(F.trim("question")).alias("r"))
    nums = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+\.?[0-9]*"), F.lit(0))
    hit = F.coalesce(F.array_contains(nums(F.col("c")), F.try_element_at(nums(F.col("r")), F.lit(-1))), F.lit(False))
    keys = F.filter(tx.words(F.col("r")), lambda w: (F.char_length(w) > 3) & ~w.rlike("^[0-9]+$"))
    share = F.size(F.filter(keys, lambda w: F.contains(F.col("c"), w))) / F.greatest(F.lit(1), F.size(keys))
    df = df.select("processed_id", hit.alias("hit"), udfs.match_ratio("c", "r").alias("ratio"), share.alias("share"))
    kind = F.when(F.col("hit") & (F.col("ratio") > 0.5), "correct").when(F.col("hit") & (F.col("share") > 0.3), "partially_correct").when((F.col("ratio") > 0.3) | (F.col("share") > 0.5), "related").otherwise("incorrect")
    return df.select("processed_id", kind.alias("result_type"), F.when(kind == "correct", 1.0).when(kind == "partially_correct", 0.7).when(kind == "related", 0.4).otherwise(0.0).alias("score"))


@query("g10_embedding_cosine", f"""WITH c AS (SELECT label, list_transform(generate_series(1, 64), lambda i: 0.0::DOUBLE) AS z FROM embeddings GROUP BY label),
  u AS (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
  e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
  SELECT vec_id, {r6('sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m)))')} AS cosine FROM e JOIN u USING (label, i) GROUP BY vec_id""")
def g10(spark, folder):
    """Cosine of every vector with the mean of its label."""
    df = table(spark, folder, "embeddings")
    parts = df.select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    center = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("center"))
    return df.join(center, "label").select("vec_id", round6(sc.vector_cosine(F.col("embedding"), F.col("center"))).alias("cosine"))


def _number_equal(a: str, b: str, tol: str = "0.02::DOUBLE") -> str:
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN true WHEN abs({a}) > 1 OR abs({b}) > 1 THEN abs({a} - {b}) <= {tol} * greatest(abs({a}), abs({b})) ELSE abs({a} - {b}) <= {tol} END"


_LASTS = f"n AS (SELECT result_id, list_last({_numbers('response')}) AS a, list_last({_numbers('expected_answer')}) AS b FROM r WHERE response IS NOT NULL AND expected_answer IS NOT NULL)"


@query("g13_number_equal", f"WITH {R}, {_LASTS} SELECT result_id, {_number_equal('a', 'b')} AS equal FROM n WHERE a IS NOT NULL AND b IS NOT NULL")
def g13(spark, folder):
    """Whether the last number of the response is that of the expected answer."""
    last = lambda c: F.try_element_at(tx.numbers(F.col(c)), F.lit(-1))
    df = results(spark, folder).select("result_id", last("response").alias("a"), last("expected_answer").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return df.select("result_id", number_equal(F.col("a"), F.col("b")).alias("equal"))


_FRACTION = "regexp_extract_all({c}, '([0-9]{{1,9}})/([0-9]{{1,9}})', {k})"
_PARTS_SQL = ", ".join(f"try_cast({_FRACTION.format(c=c, k=k)}[{i}] AS BIGINT) AS {n}" for c, i, n, k in (("question", 1, "a", 1), ("question", 1, "b", 2), ("solution", -1, "c", 1), ("solution", -1, "d", 2)))


@query("g14_fractions", f"WITH f AS (SELECT question_id, {_PARTS_SQL} FROM questions) SELECT question_id, gcd(a, b) AS divisor, CASE WHEN b <> 0 AND d <> 0 THEN a * d = c * b OR abs(a::DOUBLE / b - c::DOUBLE / d) < 1e-4 END AS equal FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")
def g14(spark, folder):
    """The first fraction of a question against the last one of its solution."""
    part = lambda c, at, k: F.try_element_at(F.regexp_extract_all(F.col(c), F.lit("([0-9]{1,9})/([0-9]{1,9})"), F.lit(k)), F.lit(at)).try_cast("bigint")
    df = table(spark, folder, "questions").select("question_id", part("question", 1, 1).alias("a"), part("question", 1, 2).alias("b"), part("solution", -1, 1).alias("c"), part("solution", -1, 2).alias("d"))
    df = df.where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull() & F.col("d").isNotNull())
    return df.select("question_id", gcd(F.col("a"), F.col("b")).alias("divisor"), fraction_equal(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("equal"))


def _checked(name: str, lenient: bool) -> None:
    @query(name)
    def run(spark, folder):
        """Whether each response holds its expected answer, what decided, and the question's kind."""
        df = results(spark, folder).select("result_id", answers.checked(F.col("response"), F.col("expected_answer"), F.col("question_type"), lenient).alias("x"))
        return df.select("result_id", "x.found", "x.by", "x.kind")


_checked("g15_answer_check", True)
_checked("g15_answer_check_strict", False)


@query("g15_any_number", f"WITH {R}, n AS (SELECT result_id, {_numbers('response')} AS a, {_numbers('expected_answer')} AS b FROM r WHERE response IS NOT NULL AND expected_answer IS NOT NULL) SELECT result_id, len(list_filter(a, lambda x: len(list_filter(b, lambda y: {_number_equal('x', 'y')})) > 0)) > 0 AS found FROM n")
def g15_any(spark, folder):
    df = results(spark, folder).where(F.col("response").isNotNull() & F.col("expected_answer").isNotNull())
    return df.select("result_id", sc.any_number_match(F.col("response"), F.col("expected_answer")).alias("found"))


@query("g15_by_kind")
def g15_kind(spark, folder):
    """For the questions of each kind, how many responses agree by its comparison alone, by model."""
    df = results(spark, folder).where(F.col("model_name").isNotNull() & F.col("response").isNotNull() & F.col("expected_answer").isNotNull())
    df = df.select("model_name", "response", "expected_answer", answers.question_kind(F.col("question_type"), F.col("expected_answer")).alias("kind")).where(F.col("kind").isNotNull())
    same = None
    for k in answers.KINDS:
        match = answers.kind_match(F.col("response"), F.col("expected_answer"), k)
        same = F.when(F.col("kind") == k, match) if same is None else same.when(F.col("kind") == k, match)
    return df.groupBy("model_name", "kind").agg(F.count("*").alias("n"), round6(F.avg(F.coalesce(same, F.lit(False)).cast("double"))).alias("agreement"))


def _any_sql(c: str, words) -> str:
    return " + ".join(f"contains({c}, '{w}')::INT" for w in words)


_STEPS_SQL = " + ".join(f"((length(l) - length(replace(l, '{m}', ''))) / {len(m)})::BIGINT" for m in sc.STEP_COUNTED)


@query("g20_confidence", f"""WITH {R}, x AS (SELECT result_id, response, lower(response) AS l, ({_any_sql('lower(response)', sc.CONFIDENT)}) AS h, ({_any_sql('lower(response)', sc.DOUBTFUL)}) AS d, string_split(response, '.') AS parts FROM r),
  s AS (SELECT result_id, response, CASE WHEN h + d = 0 THEN 0.5::DOUBLE ELSE h::DOUBLE / (h + d) END AS s, array_to_string(parts[greatest(len(parts) - 2, 1):], '.') AS e FROM x),
  t AS (SELECT result_id, response, CASE WHEN regexp_matches(e, '[0-9]') THEN least(1.0::DOUBLE, s + 0.2::DOUBLE) ELSE s END AS s FROM s)
  SELECT result_id, {r6(f"CASE WHEN len({_words('response')}) > 300 THEN greatest(0.1::DOUBLE, s - 0.1::DOUBLE) ELSE s END")} AS confidence FROM t WHERE response IS NOT NULL""")
def g20(spark, folder):
    df = results(spark, folder).where(F.col("response").isNotNull())
    return df.select("result_id", round6(sc.confidence(F.col("response"))).alias("confidence"))


def _share_sql(c: str, markers, least: int = 1) -> str:
    return f"({_any_sql(c, markers)})::DOUBLE / {float(max(least, len(markers)))!r}::DOUBLE"


def _or_sql(*words: str) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


_COT_SQL = f"""0.4::DOUBLE * least({_share_sql('l', sc.STEP_MARKERS, 4)}, 1.0::DOUBLE) + 0.3::DOUBLE * {_share_sql('response', sc.MATH_MARKERS, 3)} + 0.3::DOUBLE * {_share_sql('l', sc.REASON_MARKERS, 3)}
  + 0.1::DOUBLE * ((contains(l, 'bước 1') AND contains(l, 'bước 2')) OR (contains(l, 'thứ nhất') AND contains(l, 'thứ hai')))::INT + 0.1::DOUBLE * {_or_sql('kết luận', 'vậy', 'do đó', 'conclusion')}::INT"""
_THINK, _ACT, _SEE = _or_sql("think:", "suy nghĩ:", "suy nghĩ rằng", "tôi cần"), _or_sql("act:", "hành động:", "tôi sẽ", "tiến hành"), _or_sql("observe:", "quan sát:", "kết quả là", "nhận thấy")
_TURNS = "least(" + ", ".join(f"(length(l) - length(replace(l, '{m}', ''))) / {len(m)}" for m in ("think:", "act:")) + ")"
_REACT_SQL = f"CASE WHEN {_THINK} AND {_ACT} AND {_SEE} THEN 0.9::DOUBLE WHEN {_THINK} AND {_ACT} THEN 0.7::DOUBLE WHEN {_THINK} THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END + 0.1::DOUBLE * ({_TURNS} >= 2)::INT"
_FEW_SQL = f"0.5::DOUBLE + 0.3::DOUBLE * {_share_sql('l', sc.EXAMPLE_MARKERS)} + 0.2::DOUBLE * {_or_sql('đáp án', 'kết quả')}::INT"
_REASONING_SQL = f"""CASE WHEN contains(p, 'cot') THEN {_COT_SQL} WHEN contains(p, 'react') THEN {_REACT_SQL} WHEN contains(p, 'self_consistency') THEN 0.6::DOUBLE + 0.4::DOUBLE * {_share_sql('l', sc.CONSISTENT_MARKERS)}
  WHEN contains(p, 'few_shot') THEN {_FEW_SQL} WHEN contains(p, 'zero_shot') THEN 0.5::DOUBLE + 0.5::DOUBLE * {_share_sql('l', sc.STRUCTURE_MARKERS)} ELSE 0.5::DOUBLE END"""


@query("g23_prompt_reasoning", f"WITH {R}, x AS (SELECT result_id, response, lower(response) AS l, lower(prompt_type) AS p FROM r WHERE response IS NOT NULL AND prompt_type IS NOT NULL) SELECT result_id, {r6(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_REASONING_SQL}))')} AS reasoning FROM x")
def g23(spark, folder):
    df = results(spark, folder).where(F.col("response").isNotNull() & F.col("prompt_type").isNotNull())
    return df.select("result_id", round6(sc.prompt_reasoning(F.col("response"), F.col("prompt_type"))).alias("reasoning"))


@query("g24_step_count", f"WITH {R}, x AS (SELECT result_id, lower(response) AS l FROM r WHERE response IS NOT NULL) SELECT result_id, {_STEPS_SQL} AS n_steps FROM x")
def g24(spark, folder):
    return results(spark, folder).where(F.col("response").isNotNull()).select("result_id", sc.step_count(F.col("response")).alias("n_steps"))


@query("g25_react_cycles", f"WITH {R} SELECT result_id, least(" + ", ".join(" + ".join(f"((length(lower(response)) - length(replace(lower(response), '{m}', ''))) / {len(m)})::BIGINT" for m in pair) for pair in (("think:", "suy nghĩ:"), ("act:", "hành động:"), ("observe:", "quan sát:"))) + ") AS n_cycles FROM r WHERE contains(lower(prompt_type), 'react') AND response IS NOT NULL")
def g25_cycles(spark, folder):
    df = results(spark, folder).where(F.contains(F.lower("prompt_type"), F.lit("react")) & F.col("response").isNotNull())
    return df.select("result_id", sc.react_cycles(F.col("response")).alias("n_cycles"))


@query("g25_react")
def g25(spark, folder):
    df = results(spark, folder).where(F.contains(F.lower("prompt_type"), F.lit("react")))
    return df.select("result_id", sc.react_cycles(F.col("response")).alias("n_cycles"), sc.react_actions(F.col("response")).alias("actions"))


def _asked(spark, folder):
    """Legacy rows with response and question, null as ''."""
    return scored(spark, folder).select("processed_id", "model_name", "subject_type", "correctness_score", F.coalesce("response", F.lit("")).alias("response"), F.coalesce("question", F.lit("")).alias("question"))


@query("g17_reasoning_quality")
def g17(spark, folder):
    """Steps, calculations, consistency and complexity of each response, and the reasoning score they give."""
    df = results(spark, folder).where(F.col("response").isNotNull()).select("result_id", reasoning.quality(F.col("response")).alias("q"))
    return df.select("result_id", "q.n_steps", "q.n_wrong", *(round6(F.col(f"q.{k}")).alias(k) for k in ("reasoning", "consistency", "complexity")))


@query("g18_enhanced_reasoning")
def g18(spark, folder):
    """Relevance, efficiency and illogical statements of each response, and the score they give with its quality."""
    asked = table(spark, folder, "questions").select("question_id", "solution")
    df = results(spark, folder).where(F.col("response").isNotNull()).join(asked, "question_id", "left")
    c = F.col("response")
    df = df.select("result_id", reasoning.enhanced(c, F.col("solution"), F.col("question_text")).alias("e"), reasoning.illogical(c).alias("n_illogical"))
    return df.select("result_id", "n_illogical", *(round6(F.col(f"e.{k}")).alias(k) for k in ("relevance", "efficiency", "enhanced")))


def _notions_sql(words, enough: int) -> str:
    return f"least(1.0::DOUBLE, ({_any_sql('l', words)}) / {float(enough)!r}::DOUBLE)"


_CALC = r"([0-9]+\.?[0-9]*)\s*([-+*/])\s*([0-9]+\.?[0-9]*)\s*=\s*([0-9]+\.?[0-9]*)"
_RIGHT = "list_filter(range(1, len(a) + 1), lambda i: abs(d[i]::DOUBLE - CASE o[i] WHEN '+' THEN a[i]::DOUBLE + b[i]::DOUBLE WHEN '-' THEN a[i]::DOUBLE - b[i]::DOUBLE WHEN '*' THEN a[i]::DOUBLE * b[i]::DOUBLE ELSE a[i]::DOUBLE / nullif(b[i]::DOUBLE, 0) END) <= 0.01)"
_SUBJECT_SQL = f"""CASE subject WHEN 'arithmetic' THEN CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len({_RIGHT})::DOUBLE / len(a) END
  WHEN 'algebra' THEN 0.6::DOUBLE * {_notions_sql(reasoning.ALGEBRA, 3)} + 0.4::DOUBLE * least(1.0::DOUBLE, len(regexp_extract_all(c, '=>|⟹|→|=|⟺')) / 5.0::DOUBLE)
  WHEN 'geometry' THEN 0.7::DOUBLE * {_notions_sql(reasoning.GEOMETRY, 3)} + 0.3::DOUBLE * contains(l, 'công thức')::INT
  WHEN 'logic' THEN 0.5::DOUBLE * {_notions_sql(reasoning.LOGIC, 4)} + 0.5::DOUBLE * least(1.0::DOUBLE, len(regexp_extract_all(c, '{reasoning.ORDER}')) / 3.0::DOUBLE) ELSE 0.5::DOUBLE END"""
_SUBJECT_OF = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{k}'" for k, p in tx.SUBJECT_PATTERNS) + " ELSE 'general' END"


@query("g22_subject_score", f"WITH {PX}, x AS (SELECT processed_id, coalesce(response, '') AS c, lower(coalesce(response, '')) AS l, {_SUBJECT_OF.replace('lower(question)', "lower(coalesce(question, ''))")} AS subject FROM px), y AS (SELECT *, " + ", ".join(f"regexp_extract_all(c, '{_CALC}', {k}) AS {n}" for k, n in ((1, "a"), (2, "o"), (3, "b"), (4, "d"))) + f") SELECT processed_id, subject, {r6(_SUBJECT_SQL)} AS score FROM y".replace(") SELECT", " FROM x) SELECT", 1))
def g22(spark, folder):
    """Score of each legacy response by the criteria of its question's subject."""
    df = _asked(spark, folder).withColumn("subject", tx.subject(F.col("question")))
    return df.select("processed_id", "subject", round6(reasoning.subject_score(F.col("response"), F.col("subject"))).alias("score"))


@query("j05_scored_rows")
def j05(spark, folder):
    """Legacy rows scored anew, with defaults for questions that aren't known: answer, reasoning and their blend."""
    known = table(spark, folder, "questions").where(F.col("question").isNotNull()).groupBy("question").agg(F.min_by("solution", "question_id").alias("solution"), F.min_by("question_type", "question_id").alias("question_type"))
    df = _asked(spark, folder).join(known, "question", "left")
    c = F.col("response")
    df = df.select("processed_id", F.coalesce("question_type", F.lit("unknown")).alias("asked_type"), answers.checked(c, F.col("solution"), F.col("question_type")).alias("x"), reasoning.quality(c).alias("q"))
    right = F.col("x.found").cast("double")
    return df.select("processed_id", "asked_type", right.alias("correctness"), round6(F.col("q.reasoning")).alias("reasoning"), round6(reasoning.blended(right, F.col("q.reasoning"))).alias("score"))


def _blend_sql(*weights: float) -> str:
    names = ("correctness_score", "reasoning_score", "consistency_score", "efficiency_score", "confidence_score")
    return " + ".join(f"coalesce({n}, 0.0::DOUBLE) * {w!r}::DOUBLE" for n, w in zip(names, weights))


_BIAS_SQL = """CASE WHEN prompt_type = 'standard' THEN 0.05::DOUBLE WHEN prompt_type = 'cot' THEN -0.05::DOUBLE * least(0.1::DOUBLE, response_length / 5000.0::DOUBLE) + CASE WHEN reasoning_score > 0.7::DOUBLE THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
  WHEN prompt_type = 'hybrid_cot' THEN CASE WHEN reasoning_score > 0.6::DOUBLE AND correctness_score > 0.7::DOUBLE THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END"""
_MIXED_SQL = f"CASE WHEN prompt_type = 'cot' THEN {_blend_sql(0.45, 0.25, 0.15, 0.10, 0.05)} WHEN prompt_type = 'hybrid_cot' THEN {_blend_sql(0.35, 0.25, 0.15, 0.15, 0.10)} ELSE {_blend_sql(0.9, 0.1, 0.0, 0.0, 0.0)} END"


@query("g19_final_score", f"WITH {PX}, b AS (SELECT processed_id, {_BIAS_SQL} AS bias, {_MIXED_SQL} AS mixed FROM px) SELECT processed_id, {r6('bias')} AS bias, {r6('greatest(0.0::DOUBLE, least(1.0::DOUBLE, mixed + coalesce(bias, 0.0::DOUBLE)))')} AS score FROM b")
def g19(spark, folder):
    c = [F.col(x) for x in ("prompt_type", "correctness_score", "reasoning_score", "consistency_score", "efficiency_score", "confidence_score")]
    bias = sc.bias_correction(c[0], c[1], c[2], F.col("response_length"))
    return scored(spark, folder).select("processed_id", round6(bias).alias("bias"), round6(sc.final_score(*c, bias)).alias("score"))


_JUDGE = ("accuracy", "reasoning", "completeness", "explanation", "cultural_context")


@query("g27_judge_scores", f"WITH {R}, j AS (SELECT result_id, regexp_extract(reasoning_scores_str, '\\{{[^{{}}]*\\}}') AS j FROM r) SELECT result_id, " + ", ".join(f"coalesce(try_cast(json_extract_string(j, '$.{k}') AS DOUBLE), 0.0) AS {k}" for k in _JUDGE) + " FROM j WHERE j <> '' AND json_valid(j)")
def g27(spark, folder):
    """Scores of all rows whose judge's reply holds JSON; the other forms are in g27_judge_replies."""
    df = results(spark, folder).select("result_id", sc.first_object(F.col("reasoning_scores_str")).alias("j")).where(F.col("j").isNotNull())
    parsed = df.select("result_id", F.from_json("j", "map<string,string>").alias("m"), sc.judge_scores(F.col("j"), sc.CRITERIA_NAMES).alias("s")).where(F.col("m").isNotNull())
    return parsed.select("result_id", *(F.col(f"s.{k}") for k in _JUDGE))


def _judged_sql() -> str:
    by_json = lambda k: f"try_cast(json_extract_string(j, '$.{k}') AS DOUBLE)"
    by_line = lambda p: f"try_cast(nullif(regexp_extract(t, '(?is)(?:{p}).*?([0-9]+(?:\\.[0-9]+)?)[/\\s]*5', 1), '') AS DOUBLE)"
    value = lambda k, p: f"coalesce(CASE WHEN j <> '' AND json_valid(j) THEN {by_json(k)} ELSE {by_line(p)} END, 0.0::DOUBLE)"
    given = ", ".join(f"{value(k, p)} AS {k}" for k, p in (*sc.CRITERIA_NAMES.items(), ("average_", sc.AVERAGE_NAMES))).replace("$.average_", "$.average")
    positive = f"list_filter([{', '.join(_JUDGE)}], lambda x: x > 0)"
    return f"""j AS (SELECT result_id, model_name, reasoning_scores_str AS t, regexp_extract(reasoning_scores_str, '\\{{[^{{}}]*\\}}') AS j FROM r WHERE reasoning_scores_str IS NOT NULL),
      g AS (SELECT result_id, model_name, t, j, {given} FROM j), s AS (SELECT *, CASE WHEN average_ <> 0 THEN average_ ELSE coalesce(list_avg({positive}), 0.0::DOUBLE) END AS average FROM g)"""


@query("g27_judge_replies", f"WITH {R}, {_judged_sql()} SELECT result_id, {', '.join(_JUDGE)}, {r6('average')} AS average FROM s")
def g27_all(spark, folder):
    """Scores and average of every judge's reply, as JSON or as lines."""
    df = results(spark, folder).where(F.col("reasoning_scores_str").isNotNull())
    s = df.select("result_id", sc.judge_scores(F.col("reasoning_scores_str"), sc.CRITERIA_NAMES).alias("s"))
    return s.select("result_id", *(F.col(f"s.{k}") for k in _JUDGE), round6(F.col("s.average")).alias("average"))


_WHY = "coalesce(CASE WHEN j <> '' AND json_valid(j) THEN json_extract_string(j, '$.explanation') END, nullif(trim(regexp_extract(t, '(?is)(?:Giải thích|Explanation)\\s*:(.*)', 1), ' '), ''))"


@query("g28_judge_summary", f"WITH {R}, {_judged_sql()} SELECT r.model_name, count(s.average) AS n, count({_WHY}) AS n_explained, {', '.join(f'{r6(f'avg({k})')} AS {k}' for k in (*_JUDGE, 'average'))} FROM r LEFT JOIN s USING (result_id) WHERE r.model_name IS NOT NULL GROUP BY r.model_name")
def g28(spark, folder):
    """Means of the judges' scores by model, and how many replies explain them."""
    df = results(spark, folder).where(F.col("model_name").isNotNull())
    s = df.select("model_name", sc.judge_scores(F.col("reasoning_scores_str"), sc.CRITERIA_NAMES).alias("s"), sc.judge_explanation(F.col("reasoning_scores_str")).alias("why"))
    return s.groupBy("model_name").agg(F.count("s.average").alias("n"), F.count("why").alias("n_explained"), *(round6(F.avg(f"s.{k}")).alias(k) for k in (*_JUDGE, "average")))


_POINTS = [f"try_cast(nullif(regexp_extract(lower(error_explanation), '(?:điểm|score)[^0-9]*([0-9]+(?:\\.[0-9]+)?){end}', 1), '') AS DOUBLE)" for end in ("/10", "")]


@query("g30_completeness_scores", f"WITH {R}, x AS (SELECT result_id, coalesce({', '.join(_POINTS)}) AS n FROM r WHERE error_explanation IS NOT NULL) SELECT result_id, {r6('CASE WHEN n IS NULL THEN 5.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, n / 10)) END')} AS score FROM x")
def g30(spark, folder):
    """A completeness score read from every explanation of an error, 5.0 where none is given."""
    df = results(spark, folder).where(F.col("error_explanation").isNotNull())
    return df.select("result_id", round6(sc.completeness_score(F.col("error_explanation"))).alias("score"))


def _class_sql(c: str) -> str:
    words = " ".join("WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in sc.ERROR_WORDS.items())
    return f"CASE {words} " + " ".join(f"WHEN starts_with({c}, '{i}') THEN '{k}'" for i, k in enumerate(sc.ERROR_WORDS, 1)) + " ELSE 'Other' END"


_KIND_SQL = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(error_explanation, '(?i){p}:\\s*([^\n]*)', 1), ' '), '')" for p in ("(?:Loại lỗi|Error Type)", "(?:lỗi|error)")) + ")"
_REASON_SQL = "nullif(trim(regexp_extract(error_explanation, '(?is)(?:Giải thích|Brief Explanation|explanation):\\s*(.*)', 1), ' '), '')"


@query("g31_error_analysis", f"WITH {R}, x AS (SELECT result_id, error_explanation, lower({_KIND_SQL}) AS k, {_REASON_SQL} AS w FROM r WHERE error_explanation IS NOT NULL) SELECT result_id, CASE WHEN k IS NULL THEN 'Unknown' ELSE {_class_sql('k')} END AS error_type, coalesce(w, error_explanation) AS explanation FROM x")
def g31(spark, folder):
    """Error class and explanation read from every explanation of an error."""
    df = results(spark, folder).where(F.col("error_explanation").isNotNull()).select("result_id", sc.error_analysis(F.col("error_explanation")).alias("x"))
    return df.select("result_id", "x.error_type", "x.explanation")


@query("g32_error_class", f"WITH {R}, x AS (SELECT lower(coalesce(error_type, error_explanation)) AS l FROM r WHERE coalesce(error_type, error_explanation) IS NOT NULL), c AS (SELECT CASE " + " ".join("WHEN " + " OR ".join(f"contains(l, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in sc.ERROR_WORDS.items()) + " " + " ".join(f"WHEN starts_with(l, '{i}') THEN '{k}'" for i, k in enumerate(sc.ERROR_WORDS, 1)) + " ELSE 'Other' END AS class FROM x) SELECT class, count(*) AS n FROM c GROUP BY class")
def g32(spark, folder):
    text = F.coalesce("error_type", "error_explanation")
    return results(spark, folder).where(text.isNotNull()).groupBy(sc.error_class(text).alias("class")).agg(F.count("*").alias("n"))
