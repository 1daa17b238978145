"""Judging by a second model: prompts, replies read back as columns, and the queries over them.

A judge is a backend as in `inference`: a function of a list of prompts. The queries
use an offline one whose replies follow from the prompt, so that they run anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import scoring as sc
from scoreloom.functions.numbers import correlation, round6
from scoreloom.operators.windows import hash_sample
from scoreloom.plans.base import query, results
from scoreloom.plans.inference import Backend, generate, with_fallback

#: Characters of an answer that the completeness prompt holds.
ANSWER_CHARS = 4000
#: A judged sample with more failures than this share is given up.
GIVEN_UP = 1 / 3

_JSON = 'Reply with JSON only: {%s}, each from 1 to 5, and "explanation".'
CRITERIA = tuple(sc.CRITERIA_NAMES)
FIVE_CRITERIA = tuple(sc.FIVE_CRITERIA_NAMES)
CLASSES = ", ".join(sc.ERROR_WORDS)


def _parts(*parts) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def reasoning_prompt(question: Column, expected: Column, response: Column, criteria: Sequence[str] = CRITERIA) -> Column:
    """Asks for a score of each criterion."""
    return _parts("Judge how this answer reasons.\n\nQuestion: ", question, "\n\nExpected answer: ", expected, "\n\nAnswer: ", response, "\n\n" + _JSON % ", ".join(f'"{c}"' for c in criteria))


def completeness_prompt(question: Column, response: Column) -> Column:
    """Asks how complete an answer is, of ten; of a very long answer the first ANSWER_CHARS characters."""
    return _parts("Does this answer cover all that is asked?\n\nQuestion: ", question, "\n\nAnswer: ", F.substring(response, 1, ANSWER_CHARS), "\n\nReply with a line `Score: n/10`.")


def error_prompt(question: Column, response: Column, expected: Column) -> Column:
    """Asks for the class of an answer's error."""
    return _parts("What kind of error is in this answer?\n\nQuestion: ", question, "\n\nAnswer: ", response, "\n\nExpected: ", expected, f"\n\nClasses: {CLASSES}.\nReply with `Error Type: …` and `Explanation: …`.")


def second_prompt(question: Column, prompt_type: Column, response: Column) -> Column:
    """Asks for the quality of reasoning and correctness, of ten, and feedback."""
    return _parts("Judge this answer.\n\nKind of prompt: ", prompt_type, "\nQuestion: ", question, "\nAnswer: ", response, "\n\nReply with the lines `Reasoning_Quality: n`, `Correctness: n` and `Feedback: …`.")


def ask(df: DataFrame, prompt: Column, judge: Backend | Sequence[Backend], tries: int = 3) -> DataFrame:
    """The rows with the judge's `reply` to a prompt of each; of several judges the first that answers."""
    backend = with_fallback(judge if isinstance(judge, (list, tuple)) else [judge], tries)
    return generate(df.withColumn("__prompt", prompt), "__prompt", backend, "reply").drop("__prompt", "latency")


def judged_reasoning(df: DataFrame, judge, criteria: dict[str, str] = sc.CRITERIA_NAMES) -> DataFrame:
    """Scores of each row by the judge; without a reply all are 0."""
    asked = ask(df, reasoning_prompt(F.col("question_text"), F.col("expected_answer"), F.col("response"), tuple(criteria)), judge)
    return asked.select("*", sc.judge_scores(F.col("reply"), criteria).alias("scores"), sc.judge_explanation(F.col("reply")).alias("explanation"))


def judged_completeness(df: DataFrame, judge) -> DataFrame:
    """Completeness of each row, 0..1; 5.0 where the judge gives no score."""
    return ask(df, completeness_prompt(F.col("question_text"), F.col("response")), judge).withColumn("completeness", sc.completeness_score(F.col("reply")))


def judged_errors(df: DataFrame, judge) -> DataFrame:
    """Error class and explanation of each row; `Unknown` where the judge names none."""
    asked = ask(df, error_prompt(F.col("question_text"), F.col("response"), F.col("expected_answer")), judge)
    return asked.withColumn("error", sc.error_analysis(F.col("reply")))


def judged_twice(df: DataFrame, judge) -> DataFrame:
    """quality, correctness and feedback of each row by a second judge."""
    asked = ask(df, second_prompt(F.col("question_text"), F.col("prompt_type"), F.col("response")), judge)
    return asked.withColumn("second", sc.second_judge(F.col("reply")))


def given_up(df: DataFrame) -> DataFrame:
    """n_rows, n_failed (without a reply) and whether so many failed that the sample says nothing."""
    failed = F.count_if(F.coalesce(F.col("reply"), F.lit("")) == "")
    return df.agg(F.count("*").alias("n_rows"), failed.alias("n_failed"), (failed > GIVEN_UP * F.count("*")).alias("given_up"))


def offline(prompts: Sequence[str]) -> list[str]:
    """Replies in the asked form whose numbers follow from a checksum of the prompt."""
    out = []
    for p in prompts:
        h = zlib.crc32(p.encode())
        if "JSON only" in p:
            names = [w.strip().strip('"') for w in p.rsplit("{", 1)[1].split("}")[0].split(",")]
            out.append("{" + ", ".join(f'"{n}": {1 + (h >> 3 * k) % 5}' for k, n in enumerate(names)) + ', "explanation": "offline"}')
        elif "n/10" in p:
            out.append(f"Score: {h % 11}/10")
        elif "Error Type" in p:
            out.append(f"Error Type: {list(sc.ERROR_WORDS)[h % len(sc.ERROR_WORDS)]}\nExplanation: offline")
        else:
            out.append(f"Reasoning_Quality: {h % 11}\nCorrectness: {h // 16 % 11}\nFeedback: offline")
    return out


def _rows(spark, folder):
    return results(spark, folder).select("result_id", "model_name", "prompt_type", "question_text", "response", "expected_answer", "is_correct", "error_type", "reasoning_average", "f1_score").where(F.col("response").isNotNull())


#: Rows that a judge is asked about, chosen by a hash; asking about all is a matter of leaving the sample out.
SAMPLE = 100


@query("u09_judge_reasoning")
def u09(spark, folder):
    """A judge's scores of a sample of rows."""
    df = judged_reasoning(hash_sample(_rows(spark, folder), "result_id", SAMPLE), offline)
    return df.select("result_id", *(F.col(f"scores.{c}") for c in CRITERIA), round6(F.col("scores.average")).alias("average"))


@query("u10_judge_completeness")
def u10(spark, folder):
    df = judged_completeness(hash_sample(_rows(spark, folder), "result_id", SAMPLE), offline)
    return df.select("result_id", "completeness")


@query("u11_judge_errors")
def u11(spark, folder):
    """A judge's class of a sample of wrong rows that have none."""
    wrong = _rows(spark, folder).where(~F.col("is_correct") & F.col("error_type").isNull())
    return judged_errors(hash_sample(wrong, "result_id", SAMPLE), offline).select("result_id", "error.error_type", "error.explanation")


@query("u12_judge_unscored")
def u12(spark, folder):
    """Five criteria for a sample of rows without a reasoning score, with the judge's explanation."""
    unscored = _rows(spark, folder).where(F.col("reasoning_average").isNull())
    df = judged_reasoning(hash_sample(unscored, "result_id", SAMPLE), offline, sc.FIVE_CRITERIA_NAMES)
    return df.select("result_id", *(F.col(f"scores.{c}") for c in FIVE_CRITERIA), round6(F.col("scores.average")).alias("average"), "explanation")


@query("u09b_judge_with_fallback")
def u09b(spark, folder):
    """A judge that always fails, and the one asked after it."""
    def broken(prompts):
        raise ConnectionError("no judge")

    df = ask(hash_sample(_rows(spark, folder), "result_id", SAMPLE), completeness_prompt(F.col("question_text"), F.col("response")), [broken, offline])
    return given_up(df)


@query("a67_second_judge")
def a67(spark, folder):
    """Mean quality and correctness by prompt, best first, and how the quality goes with the reasoning score."""
    df = judged_twice(hash_sample(_rows(spark, folder), "result_id", SAMPLE), offline).where(F.col("prompt_type").isNotNull())
    g = df.groupBy("prompt_type").agg(
        F.count("*").alias("n"), round6(F.avg("second.quality")).alias("quality"), round6(F.avg("second.correctness")).alias("correctness"), round6(correlation(F.col("second.quality"), F.col("reasoning_average"))).alias("correlation")
    )
    return g.orderBy(F.desc_nulls_last("quality"), "prompt_type")
