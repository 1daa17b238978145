"""Prompts, pluggable generation and judging, and voting over samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.answers import checked
from scoreloom.functions.reasoning import answer_by_prompt
from scoreloom.functions.text import final_answer, normalize_answer, words
from scoreloom.operators.aggregates import consistency

#: What stands around a question in each kind of prompt; a parameter of `prompt`.
FRAMES = {
    "vi": {
        "zero_shot": ("Hãy giải bài toán sau.\n\n", ""),
        "few_shot": ("Dưới đây là một số ví dụ.\n\n", "\nLời giải:"),
        "cot": ("Hãy giải bài toán sau, suy luận từng bước.\n\n", "\n\nTrình bày từng bước rồi nêu kết luận."),
        "self_consistency": ("Hãy giải bài toán sau bằng nhiều cách.\n\n", "\n\nNêu %s cách giải, mỗi cách một kết quả."),
        "react": ("Hãy giải bài toán sau theo vòng suy nghĩ, hành động, quan sát.\n\n", "\n\nSuy nghĩ:"),
        "standard": ("", ""),
        "zero_shot_cot": ("Hãy giải bài toán sau.\n\n", "\n\nHãy nghĩ từng bước một."),
        "hybrid_cot": ("Hãy giải bài toán sau: suy luận từng bước, rồi tự kiểm tra lại kết quả.\n\n", "\n\nCác bước, phần kiểm tra và kết luận:"),
        "tree_of_thought": ("Hãy nêu vài hướng giải bài toán sau, so sánh chúng rồi đi theo hướng tốt nhất.\n\n", "\n\nCác hướng giải:"),
    },
    "en": {
        "zero_shot": ("Solve this problem.\n\n", ""),
        "few_shot": ("Here are some examples.\n\n", "\nAnswer:"),
        "cot": ("Solve this problem step by step.\n\n", "\n\nGive each step, then the conclusion."),
        "self_consistency": ("Solve this problem in several ways.\n\n", "\n\nGive %s solutions, each with its result."),
        "react": ("Solve this problem by thinking, acting and observing in turn.\n\n", "\n\nThink:"),
        "standard": ("", ""),
        "zero_shot_cot": ("Solve this problem.\n\n", "\n\nLet us think step by step."),
        "hybrid_cot": ("Solve this problem: reason step by step, then check the result yourself.\n\n", "\n\nSteps, check and conclusion:"),
        "tree_of_thought": ("Name some ways to solve this problem, compare them and follow the best one.\n\n", "\n\nWays:"),
    },
}


def prompt(question: Column, kind: Column, examples: Column | None = None, frames: dict = FRAMES["vi"]) -> Column:
    """The prompt of a question by its kind; null for a kind that has no frame.

    `examples` is an array of (question, answer); few-shot kinds take as many as
    their number says.
    """
    count = F.regexp_extract(kind, r"([0-9]+)$", 1).try_cast("int")
    framed = lambda k: F.concat(F.lit(frames[k][0]), question, F.lit(frames[k][1]))
    voted = F.concat(F.lit(frames["self_consistency"][0]), question, F.format_string(frames["self_consistency"][1], count.cast("string")))
    shown = F.array_join(F.transform(F.slice(examples, F.lit(1), count), lambda e: F.concat(e["question"], F.lit("\n"), e["answer"])), "\n\n") if examples is not None else F.lit("")
    few = F.concat(F.lit(frames["few_shot"][0]), shown, F.lit("\n\n"), question, F.lit(frames["few_shot"][1]))
    return (
        F.when(kind == "zero_shot", framed("zero_shot")).when(kind.startswith("few_shot_") & count.isNotNull(), few).when(kind == "cot", framed("cot"))
        .when(kind.rlike("^(?:cot_)?self_consistency_[0-9]+$"), voted).when(kind == "react", framed("react")).when(kind == "standard", framed("standard"))
        .when(kind == "zero_shot_cot", framed("zero_shot_cot")).when(kind == "hybrid_cot", framed("hybrid_cot")).when(kind == "tree_of_thought", framed("tree_of_thought"))
    )


def choose_examples(bank: DataFrame, n: int, how: str = "default", key: str = "question_id", seed: int = 42) -> DataFrame:
    """n examples of a bank (question, answer) as one row with the array `examples`; fewer if the bank has fewer.

    `default` takes the first by key, `random` the first by a hash of seed and key,
    the same in every run. Rows without a question or an answer are no examples.
    """
    if how not in ("default", "random"):
        raise ValueError(f"unknown choice of examples: {how}")
    place = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))) if how == "random" else F.lit("")
    known = bank.where(F.col("question").isNotNull() & F.col("answer").isNotNull()).select(place.alias("place"), F.col(key).alias("key"), "question", "answer")
    chosen = known.orderBy("place", "key").limit(n)
    ordered = F.array_sort(F.collect_list(F.struct("place", "key", "question", "answer")))
    return chosen.agg(F.transform(ordered, lambda e: F.struct(e["question"].alias("question"), e["answer"].alias("answer"))).alias("examples"))


def custom_examples(spark: SparkSession, examples: Sequence[dict[str, str]], n: int) -> DataFrame:
    """The first n given examples as one row; `problem` and `solution` stand for `question` and `answer`."""
    pick = lambda e, *names: next((e[k] for k in names if e.get(k)), None)
    rows = [(pick(e, "question", "problem"), pick(e, "answer", "solution")) for e in examples]
    return spark.createDataFrame([([r for r in rows if all(r)][:n],)], "examples array<struct<question:string,answer:string>>")


def examples_from_file(spark: SparkSession, path: str, task: str, n: int) -> DataFrame:
    """The first n examples of a task in a JSON file {task: [{problem, solution}, …]}; none if the task isn't there."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.try_element_at(F.from_json("value", "map<string,string>"), F.lit(task))
    rows = F.from_json(listed, "array<struct<question:string,problem:string,answer:string,solution:string>>")
    known = F.filter(F.transform(rows, lambda e: F.struct(F.coalesce(e["question"], e["problem"]).alias("question"), F.coalesce(e["answer"], e["solution"]).alias("answer"))), lambda e: e["question"].isNotNull() & e["answer"].isNotNull())
    return raw.select(F.slice(F.coalesce(known, F.array().cast("array<struct<question:string,answer:string>>")), 1, n).alias("examples"))


def with_prompts(questions: DataFrame, kinds: Sequence[str], examples: DataFrame | None = None, frames: dict = FRAMES["vi"]) -> DataFrame:
    """Every question with its prompt of each kind: the question's columns, prompt_type and prompt. `examples` is one row."""
    rows = questions.select("*", F.explode(F.array(*map(F.lit, kinds))).alias("prompt_type"))
    if examples is None:
        return rows.withColumn("prompt", prompt(F.col("question"), F.col("prompt_type"), None, frames))
    return rows.crossJoin(F.broadcast(examples)).withColumn("prompt", prompt(F.col("question"), F.col("prompt_type"), F.col("examples"), frames)).drop("examples")


def settings(kind: Column, model: Column, table: dict[tuple[str, str], dict[str, float]], default: dict[str, float]) -> Column:
    """Generation settings of a row: of its (prompt type, model), else of ('default', model), else the default; one value each."""
    keys = F.map_from_arrays(F.array(*(F.lit(f"{p}|{m}") for p, m in table)), F.array(*(F.struct(*(F.lit(v.get(k, d)).alias(k) for k, d in default.items())) for v in table.values()))) if table else None
    fallback = F.struct(*(F.lit(d).alias(k) for k, d in default.items()))
    if keys is None:
        return fallback
    at = lambda p: F.try_element_at(keys, F.concat(p, F.lit("|"), model))
    return F.coalesce(at(kind), at(F.lit("default")), fallback)


Backend = Callable[[Sequence[str]], Sequence[str]]


def generate(df: DataFrame, prompt_col: str, backend: Backend, out: str = "response", batch: int = 32) -> DataFrame:
    """The rows with a backend's response to each prompt and the mean latency of its batch.

    The backend gets lists of prompts inside the executors. A batch that fails
    gives `[Error: …]` responses; a null prompt gives none.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("latency", T.DoubleType())])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                asked = part[prompt_col].notna()
                began = time.monotonic()
                try:
                    given = list(backend(part.loc[asked, prompt_col].tolist()))
                except Exception as e:  # a backend's failure is a result of its own
                    given = [f"[Error: {e}]"] * int(asked.sum())
                part[out] = None
                part.loc[asked, out] = given
                part["latency"] = (time.monotonic() - began) / max(1, len(part))
                yield part

    return df.mapInPandas(run, schema)


def with_fallback(backends: Sequence[Backend], tries: int = 3) -> Backend:
    """A backend that asks each of the given ones, up to `tries` times, for the prompts still without a response; '' if none answers."""

    def ask(prompts: Sequence[str]) -> list[str]:
        out: list[str | None] = [None] * len(prompts)
        for backend in backends:
            for _ in range(tries):
                left = [k for k, r in enumerate(out) if r is None]
                if not left:
                    return out
                try:
                    for k, r in zip(left, backend([prompts[k] for k in left])):
                        out[k] = r
                except Exception:  # the next try, or the next backend, is the answer to it
                    continue
        return ["" if r is None else r for r in out]

    return ask


def throughput(df: DataFrame, keys: Sequence[str], prompt_col: str = "prompt", response: str = "response", latency: str = "latency") -> DataFrame:
    """Requests, words of prompts and responses, seconds, and words a second of generated rows, by group."""
    n_in, n_out = (F.sum(F.size(words(F.col(c))).cast("bigint")) for c in (prompt_col, response))
    g = df.groupBy(*keys).agg(F.count("*").alias("n_requests"), n_in.alias("input_words"), n_out.alias("output_words"), F.sum(latency).alias("seconds"))
    return g.withColumn("words_per_second", F.when(F.col("seconds") > 0, F.col("output_words") / F.col("seconds")).otherwise(0.0))


def evaluate(prompted: DataFrame, model: str, backend: Backend, batch: int = 32) -> DataFrame:
    """Result rows of prompted questions: response, latency (of the batch over its rows), final answer, is_correct, time.

    `prompted` has question_id, question, solution, question_type, prompt_type and
    prompt. A failed call is a row with an `[Error: …]` response, which is wrong.
    """
    rows = generate(prompted, "prompt", backend, "response", batch)
    failed = F.coalesce(F.col("response").startswith("[Error:"), F.lit(True))
    found = checked(F.col("response"), F.col("solution"), F.col("question_type"))["found"]
    return rows.select(
        F.lit(model).alias("model_name"), "prompt_type", "question_id", F.col("question").alias("question_text"), "question_type", "response", F.col("solution").alias("expected_answer"),
        answer_by_prompt(F.col("response"), F.col("prompt_type")).alias("final_answer"), (found & ~failed).alias("is_correct"), "latency", F.char_length("response").alias("response_length"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def progress(rows: DataFrame, total: int) -> DataFrame:
    """Accuracy of each (model, prompt) so far, rows left of `total` questions, and the seconds that those will take at the mean latency."""
    g = rows.groupBy("model_name", "prompt_type").agg(F.count_distinct("question_id").alias("done"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.avg("latency").alias("latency"))
    left = F.greatest(F.lit(0), F.lit(total) - F.col("done"))
    return g.select("model_name", "prompt_type", "done", left.alias("left"), "accuracy", (left * F.col("latency")).alias("seconds_left"))


def vote(df: DataFrame, keys: Sequence[str], response: str, order: str) -> DataFrame:
    """The most common final answer of each group of samples, with its share."""
    answered = df.withColumn("answer", normalize_answer(final_answer(F.col(response))))
    return consistency(answered, keys, "answer", order)
