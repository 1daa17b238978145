"""Readers of question sets, result files, checkpoints and folders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("question", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("solution", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("difficulty", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
LEGACY_ROW = T.StructType(
    [
        T.StructField("question", T.StringType()), T.StructField("response", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("prompt_type", T.StringType()), T.StructField("elapsed_time", T.DoubleType()), T.StructField("token_count", T.LongType()), T.StructField("response_length", T.LongType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def _listed(first_line: str) -> Column | None:
    """How to get the items of a document that begins so; None if it is one object a line."""
    whole = F.trim("value")
    if first_line.startswith("["):
        return F.from_json(whole, T.ArrayType(T.StringType()))
    try:
        value = json.loads(first_line)
    except ValueError:
        value = None  # an object over several lines
    if isinstance(value, dict) and not any(isinstance(v, list) and v and isinstance(v[0], dict) for v in value.values()):
        return None
    return F.from_json(F.regexp_extract(whole, r"(?s)^\{.*?:\s*(\[.*\])", 1), T.ArrayType(T.StringType()))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array, JSON lines, or an object that holds a list of them.

    Rows need an id and a question (`text` stands for it); `solution` wins over
    `answer`; type and difficulty have defaults. Other rows are dropped.
    """
    rows = spark.read.text(path).where(F.trim("value") != "")
    first = rows.first()
    items = _listed(first.value.strip()) if first else None
    if items is None:  # one object a line: any number of lines, read in parallel
        raw, items = rows, F.array("value")
    else:  # one document, which is a task's work as a whole
        raw = spark.read.text(path, wholetext=True)
    q = raw.select(F.explode(items).alias("item")).select(F.from_json("item", QUESTION).alias("q")).select("q.*")
    text = F.coalesce("question", "text")
    return q.where(F.col("id").isNotNull() & text.isNotNull()).select(
        "id", text.alias("question"), F.coalesce("solution", "answer").alias("solution"), F.coalesce("type", F.lit("general")).alias("question_type"),
        F.coalesce("difficulty", F.lit("Không xác định")).alias("difficulty"), "tags",
    )


def read_nested_results(spark: SparkSession, path: str) -> DataFrame:
    """Legacy results, a map from `model_prompt` to rows: one row each, without failed calls."""
    raw = spark.read.text(path, wholetext=True)
    cells = raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("key", "rows"))
    rows = cells.select("key", F.explode(F.from_json("rows", T.ArrayType(LEGACY_ROW))).alias("r"))
    response = F.coalesce("r.response", "r.answer")
    out = rows.where(~F.coalesce(response.startswith("[Error:"), F.lit(False)))
    return out.select(
        F.split("key", "_", 2)[0].alias("model_name"), F.split("key", "_", 2)[1].alias("prompt_type"), F.col("r.question").alias("question"), response.alias("response"),
        F.coalesce("r.elapsed_time", F.lit(0.0)).alias("elapsed_time"), F.coalesce("r.response_length", F.char_length(response).cast("bigint")).alias("response_length"),
    )


def resolve_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their canonical names: the first alias that exists, if the name itself doesn't."""
    for name, others in aliases.items():
        if name not in df.columns:
            found = next((o for o in others if o in df.columns), None)
            df = df.withColumnRenamed(found, name) if found else df.withColumn(name, F.lit(None).cast("string"))
    return df


def legacy_rows(df: DataFrame) -> DataFrame:
    """Flat legacy rows with elapsed time of at least 0.001, and derived length, speed and error flag."""
    answer = F.coalesce("answer", F.lit(""))
    length = F.coalesce(F.col("response_length").cast("bigint"), F.char_length(answer).cast("bigint"))
    elapsed = F.greatest(F.coalesce(F.when(~F.isnan("elapsed_time"), F.col("elapsed_time")), F.lit(0.0)), F.lit(0.001))
    return df.select(
        "legacy_id", F.lower(F.trim("model_name")).alias("model_name"), "prompt_type", elapsed.alias("elapsed_time"), length.alias("response_length"),
        (length / elapsed).alias("tokens_per_second"), (F.contains(answer, F.lit("Error:")) | F.contains(answer, F.lit("[Không thể tạo phản hồi"))).alias("has_error"),
    )


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files of a folder by pattern: path, size and time; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.select("path", "length", "modificationTime")


def human_size(c: Column) -> Column:
    """A size in bytes with its unit."""
    out = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(c < 1024 ** (k + 1), F.concat(F.format_number(c / 1024**k, 2), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_number(c / 1024**4, 2), F.lit(" TB")))


def sections(lines: DataFrame) -> DataFrame:
    """Questions and solutions from lines of an exercise text.

    `lines` has doc_id, line_no and line. A line that begins with Phần starts a
    section, Bài or Câu a question, Lời giải or Hướng dẫn giải its solution.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    low = F.lower(F.trim("line"))
    starts = lambda *ms: F.coalesce(F.greatest(*(low.startswith(m) for m in (*ms, ms[0]))), F.lit(False))
    rows = lines.select("*", starts("bài ", "câu ").alias("q"), starts("lời giải", "hướng dẫn giải").alias("s"), F.when(starts("phần "), F.trim("line")).alias("section"))
    rows = rows.withColumn("question_no", F.sum(F.col("q").cast("int")).over(w)).withColumn("section", F.last("section", True).over(w))
    part = Window.partitionBy("doc_id", "question_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(F.col("question_no") > 0).withColumn("in_solution", F.max(F.col("s").cast("int")).over(part) == 1)
    texts = lambda inside: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("in_solution") == inside, F.struct("line_no", "line")))), lambda x: x["line"]), " ")
    return rows.groupBy("doc_id", "question_no").agg(F.min_by("section", "line_no").alias("section"), F.trim(texts(False)).alias("question"), F.trim(texts(True)).alias("solution"))


def latest_checkpoint(files: DataFrame, pattern: str = "checkpoint_|emergency_") -> DataFrame:
    """The newest file whose name matches."""
    named = files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return named.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modificationTime"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; all columns are text, quoted line breaks stay inside their cell."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def read_json(spark: SparkSession, path: str, default: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """A JSON document or JSON lines; `default` where the file is missing or holds no JSON."""
    try:
        first = spark.read.text(path).where(F.trim("value") != "").first()
        if first is None:
            raise ValueError("empty")
        whole = first.value.lstrip().startswith("[") or not first.value.rstrip().endswith("}")
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.json(path, multiLine=whole, mode="PERMISSIVE")
        if df.columns == ["_corrupt_record"]:
            raise ValueError("no JSON")
        return df
    except Exception:
        if default is None:
            raise
        return default


def read_yaml(path: str, default=None):
    """A configuration in YAML, read on the driver; needs the yaml package. `default` where it is missing or broken."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except Exception:
        if default is None:
            raise
        return default


#: Other names of the columns with the response and the expected answer; the first that exists counts.
RESPONSE_NAMES = ("response", "answer", "model_answer", "output", "generation", "predicted_answer", "model_response", "prediction", "model_output")
ANSWER_NAMES = ("correct_answer", "expected_answer", "ground_truth", "reference", "true_answer", "human_answer", "gold_answer", "gold_standard", "reference_answer")


def resolve_texts(df: DataFrame) -> DataFrame:
    """Result rows with `response` and `expected_answer`, whatever they are called (in any case)."""
    for name, others in (("response", RESPONSE_NAMES), ("expected_answer", ANSWER_NAMES)):
        if name not in df.columns:
            found = next((c for c in df.columns if c.lower() in others), None)
            df = df.withColumnRenamed(found, name) if found else df.withColumn(name, F.lit(None).cast("string"))
    return df


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, if it has all the columns; an error that names the missing ones otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def section_documents(lines: DataFrame) -> DataFrame:
    """Questions of exercise texts as written to one file a section: normalised texts, difficulty and tags."""
    from scoreloom.functions.text import length_difficulty, normalize_extracted, short_tags

    rows = sections(lines)
    q, s = normalize_extracted(F.col("question")), normalize_extracted(F.col("solution"))
    return rows.select("doc_id", "question_no", F.coalesce("section", F.lit("general")).alias("section"), q.alias("question"), s.alias("solution"), length_difficulty(q, s).alias("difficulty"), F.array_join(short_tags(q), ",").alias("tags"))


def latest_run(rows: DataFrame, models: list[str], prompts: list[str]) -> DataFrame:
    """The id of the newest run that has all the models and prompts; null if there is none."""
    has = lambda c, values: F.count_distinct(F.when(F.col(c).isin(*values), F.col(c))) == len(set(values))
    g = rows.groupBy("run_id").agg(F.max("run_timestamp").alias("t"), (has("model_name", models) & has("prompt_type", prompts)).alias("whole"))
    return g.where(F.col("whole") & F.col("t").isNotNull()).agg(F.max_by("run_id", F.struct("t", "run_id")).alias("run_id"))


def merged(base: Column, override: Column) -> Column:
    """Two maps as one; the second wins."""
    return F.map_zip_with(base, override, lambda k, a, b: F.coalesce(b, a))


def http_wait(date: Column, now: Column) -> Column:
    """Seconds from now to an HTTP date, at least 0; null for what is no such date."""
    at = F.try_to_timestamp(F.regexp_replace(date, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.when(at.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.unix_timestamp(at) - F.unix_timestamp(now)))
