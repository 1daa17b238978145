"""The grid of models, prompts and questions, and what of it is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import BROADCAST_ROWS

KEYS = ("model_name", "prompt_type", "question_id")


def full_grid(models: DataFrame, prompts: DataFrame, questions: DataFrame) -> DataFrame:
    """Every combination of the three dimensions.

    Models and prompts are dimensions of known small size; they are counted, and
    multiplied as one array that each question explodes.
    """
    n = models.count() * prompts.count()
    if n > BROADCAST_ROWS:
        return models.crossJoin(prompts).crossJoin(questions)
    pairs = models.crossJoin(prompts).agg(F.array_sort(F.collect_list(F.struct("model_name", "prompt_type"))).alias("pairs"))
    return questions.crossJoin(F.broadcast(pairs)).select(F.explode("pairs").alias("p"), "question_id").select("p.*", "question_id")


def filtered(questions: DataFrame, ids=None, tags=None, types=None, difficulties=None, first: int | None = None) -> DataFrame:
    """Questions with one of the ids, a tag (in any case), a type (in any case) and a difficulty of those given, and of these the first by id.

    A question without tags has none of them; what isn't given doesn't filter.
    """
    q = questions
    if ids is not None:
        q = q.where(F.col("question_id").isin(*ids))
    if tags is not None:
        low = [t.lower() for t in tags]
        q = q.where(F.exists("tags", lambda t: F.coalesce(F.lower(t).isin(*low), F.lit(False))))
    if types is not None:
        q = q.where(F.lower("question_type").isin(*(t.lower() for t in types)))
    if difficulties is not None:
        q = q.where(F.col("difficulty").isin(*difficulties))
    return q if first is None else q.orderBy("question_id").limit(first)


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """The combinations that no done row has."""
    return grid.join(done.select(*KEYS).distinct(), list(KEYS), "left_anti")


def with_questions(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Result rows with their question's solution, type, difficulty and tags; defaults where it is unknown."""
    q = questions.select(
        "question_id", F.col("solution").alias("asked_solution"), F.coalesce("question_type", F.lit("general")).alias("asked_type"),
        F.coalesce("difficulty", F.lit("Không xác định")).alias("asked_difficulty"), F.col("tags").alias("asked_tags"),
    )
    out = results.join(q, "question_id", "left")
    return out.withColumns({"asked_type": F.coalesce("asked_type", F.lit("unknown")), "asked_difficulty": F.coalesce("asked_difficulty", F.lit("unknown"))})


def run_id(models: list[str], prompts: list[str], question_ids: DataFrame) -> DataFrame:
    """Identity of a run: its settings and a hash of its different question ids, whatever their order.

    The hash is made of the ids' count, exclusive or and sum of hashes, which are
    combined where the ids lie.
    """
    ids = question_ids.where(F.col("question_id").isNotNull()).select("question_id").distinct()
    h = F.conv(F.substring(F.md5(F.col("question_id").cast("string")), 1, 15), 16, 10).cast("bigint")
    sums = ids.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    digest = F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in ("n", "x", "s"))))
    return sums.select(F.concat(F.lit("_".join([*sorted(models), *sorted(prompts)]) + "_"), F.substring(digest, 1, 8)).alias("run_id"))
