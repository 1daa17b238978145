"""Writers of results, reports and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv", "json")) -> None:
    """Rows as Parquet, CSV and JSON lines under one path; each is committed whole or not at all."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
    for f in formats:
        writer = (flat if f == "csv" else df).write.mode("overwrite")
        (writer.option("header", True).option("escape", '"') if f == "csv" else writer).format(f).save(f"{path}/{f}")


def append_checkpoint(df: DataFrame, path: str, run: str, batch: int) -> None:
    """Add a batch of result rows to a run's checkpoint; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run}/batch={batch}")


def read_checkpoint(spark: SparkSession, path: str, run: str) -> DataFrame:
    """All rows of a run's checkpoint."""
    return spark.read.option("basePath", path).parquet(f"{path}/run_id={run}")


def checkpoint_info(df: DataFrame) -> DataFrame:
    """Rows, combinations, models and prompts of a checkpoint."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("model_name", "prompt_type", "question_id").alias("n_combinations"), F.count_distinct("model_name").alias("n_models"), F.count_distinct("prompt_type").alias("n_prompts")
    )


def expired(files: DataFrame, keep: int = 5) -> DataFrame:
    """Checkpoint files beyond the newest `keep` of their folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    w = Window.partitionBy(folder).orderBy(F.desc("modificationTime"), F.desc("path"))
    return files.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep).drop("place")


def report_lines(df: DataFrame) -> DataFrame:
    """Totals, and accuracy by model and by prompt, one line each: part, name, correct, total, accuracy and the line as JSON."""
    correct = F.count_if("is_correct")
    accuracy = F.round(correct / F.count("*") + 1e-10, 6) + 0.0
    numbers = [correct.alias("correct"), F.count("*").alias("total"), accuracy.alias("accuracy")]
    out = df.agg(*numbers).select(F.lit("meta").alias("part"), F.lit("all").alias("name"), "correct", "total", "accuracy")
    for key in ("model_name", "prompt_type"):
        out = out.unionByName(df.where(F.col(key).isNotNull()).groupBy(F.lit(key).alias("part"), F.col(key).alias("name")).agg(*numbers))
    return out.withColumn("line", F.to_json(F.struct("part", "name", "correct", "total", "accuracy")))


#: A report lists so many prompts, those with most rows; the others are one line.
PROMPT_LINES = 200


def _by(df: DataFrame, key: str, lines: int = PROMPT_LINES) -> list[tuple]:
    """(name, correct, total) of the groups with most rows, and of all others together as `(others)`; counted where the rows lie."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"))
    top = g.orderBy(F.desc("total"), key).limit(lines).collect()
    rest = g.agg(F.sum("correct"), F.sum("total")).first()
    out = [tuple(r) for r in sorted(top)]
    left = ((rest[0] or 0) - sum(r[1] for r in out), (rest[1] or 0) - sum(r[2] for r in out))
    return out + ([("(others)", *left)] if left[1] else [])


def report_tables(df: DataFrame, lines: int = PROMPT_LINES) -> list[tuple[str, list[str], list[list[str]]]]:
    """(title, header, rows) of a report's tables: models, prompts, similarity means, models by prompt; a table without rows says so.

    Only aggregates of bounded size reach the driver.
    """
    rate = lambda c, n: f"{c / n:.4f}" if n else "-"
    counts = lambda rows: [[str(k), str(c), str(n), rate(c, n)] for k, c, n in rows]
    header = ["name", "correct", "total", "accuracy"]
    models, prompts = _by(df, "model_name", lines), _by(df, "prompt_type", lines)
    out = [("Models", header, counts(models)), ("Prompts", header, counts(prompts))]
    scores = [m for m in ("f1_score", "meteor_score", "bert_score", "rouge1_f", "bleu") if m in df.columns]
    if scores:
        means = df.agg(*(F.avg(m).alias(m) for m in scores)).first()
        out.append(("Similarity", ["metric", "mean"], [[m, "-" if means[m] is None else f"{means[m]:.4f}"] for m in scores]))
    shown = [k for k, _, _ in prompts if k != "(others)"][:20]
    if models and shown:
        cells = df.where(F.col("prompt_type").isin(*shown) & F.col("model_name").isin(*(k for k, _, _ in models))).groupBy("model_name", "prompt_type").agg(F.avg(F.col("is_correct").cast("double")).alias("a")).collect()
        at = {(r.model_name, r.prompt_type): r.a for r in cells}
        out.append(("Models by prompt", ["model", *shown], [[k, *("-" if at.get((k, p)) is None else f"{at[k, p]:.4f}" for p in shown)] for k, _, _ in models if k != "(others)"]))
    return out


def sample_rows(df: DataFrame, columns: tuple[str, ...], n: int = 20, seed: int = 42) -> list[list[str]]:
    """n rows as text, chosen by a hash, for the reader of a report."""
    from scoreloom.operators.windows import hash_sample

    key = columns[0]
    return [["" if v is None else str(v) for v in r] for r in hash_sample(df.select(*columns), key, n, seed).collect()]


def markdown_report(df: DataFrame, title: str = "Evaluation report") -> str:
    """Totals and the tables of `report_tables` as Markdown; a table without data says so."""
    total = df.agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c")).first()
    lines = [f"# {title}", "", f"Rows: {total.n}, correct: {total.c} ({100 * total.c / max(1, total.n):.2f} %)"]
    cell = lambda c: c.replace("|", "\\|").replace("\n", " ")
    for name, header, rows in report_tables(df):
        lines += ["", f"## {name}", ""]
        if rows:
            lines += ["| " + " | ".join(map(cell, header)) + " |", "|" + "-|" * len(header), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
        else:
            lines.append("Not enough data.")
    return "\n".join(lines) + "\n"


def html_report(df: DataFrame, title: str = "Evaluation report", sample: tuple[str, ...] = ()) -> str:
    """A page with a card of totals, the tables of `report_tables`, and a sample of rows of the columns `sample`; all text is escaped."""
    from html import escape

    total = df.agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c")).first()
    row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    out = [f"<h1>{escape(title)}</h1>", f'<div class="card"><b>{total.n}</b> rows, <b>{total.c}</b> correct</div>']
    tables = report_tables(df)
    if sample:
        tables.append(("Sample", list(sample), sample_rows(df, sample)))
    for name, header, rows in tables:
        body = "<table>" + row("th", header) + "".join(row("td", r) for r in rows) + "</table>" if rows else "<p>Not enough data.</p>"
        out.append(f'<section class="card"><h2>{escape(name)}</h2>{body}</section>')
    return '<!doctype html><html><head><meta charset="utf-8"><title>' + escape(title) + "</title></head><body>" + "\n".join(out) + "</body></html>"


def save_statistics(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def save_partial(df: DataFrame, path: str) -> None:
    """Rows in one folder for each model and prompt; those written again replace theirs and leave the others.

    Tasks write files of their own, so no lock is needed.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name", "prompt_type").parquet(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a results folder; an empty table where it is missing or holds nothing readable, as a fresh run finds it."""
    try:
        df = spark.read.parquet(path)
        df.limit(1).count()
        return df
    except Exception:
        return spark.createDataFrame([], schema)


def save_sections(documents: DataFrame, path: str) -> None:
    """Questions as JSON lines in one folder a section."""
    documents.write.mode("overwrite").partitionBy("section").json(path)


def delete(spark: SparkSession, files: DataFrame) -> int:
    """Delete the files of a list of paths, on any file system; how many there were. The list is that of checkpoints, which are few."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    for r in files.select("path").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(r.path)
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def keep_newest(spark: SparkSession, files: DataFrame, keep: int = 5) -> int:
    """Delete all but the newest `keep` checkpoint files of each folder; how many were deleted. 0 clears them."""
    return delete(spark, expired(files, keep))


def corpus_document(questions: DataFrame) -> DataFrame:
    """All questions as one JSON document {total_problems, questions}; for corpora that fit one file."""
    return questions.agg(F.to_json(F.struct(F.count("*").alias("total_problems"), F.collect_list(F.struct(*questions.columns)).alias("questions"))).alias("document"))
