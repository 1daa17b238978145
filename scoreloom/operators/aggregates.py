"""Group-by analytics over scored result rows. All are DataFrame to DataFrame, without Python in the rows' path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.numbers import correlation, ratio, round6


def rate(c: str) -> Column:
    """Share of true among the non-null values."""
    return F.avg(F.col(c).cast("double"))


def basic_metrics(df: DataFrame) -> DataFrame:
    """Overall accuracy, latency and response length: one row, also for an empty table."""
    return df.agg(
        F.count("*").alias("n_rows"),
        round6(rate("is_correct")).alias("accuracy"),
        round6(F.avg("latency")).alias("average_latency"),
        F.max("latency").alias("max_latency"),
        F.min("latency").alias("min_latency"),
        round6(F.avg(F.length("response").cast("double"))).alias("average_response_length"),
    )


def group_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, latency and count for each group; rows with a null key belong to none."""
    return _known(df, keys).groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        round6(rate("is_correct")).alias("accuracy"),
        round6(F.avg("latency")).alias("average_latency"),
        F.max("latency").alias("max_latency"),
        F.min("latency").alias("min_latency"),
    )


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def group_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric for each group."""
    return _known(df, keys).groupBy(*keys).agg(F.count("*").alias("n_rows"), *(round6(F.avg(F.col(m).cast("double"))).alias(m) for m in metrics))


def pivot_cells(df: DataFrame, row: str, column: str, metric: Column, fill: float | None = None) -> DataFrame:
    """The cells of a pivot in long form: row, column, n_rows and the mean of a metric, for every pair that occurs.

    No value of either side is left out, however many there are; a cell without a
    metric is null or `fill`.
    """
    value = round6(F.avg(metric))
    return _known(df, [row, column]).groupBy(row, column).agg(F.count("*").alias("n_rows"), (F.coalesce(value, F.lit(fill)) if fill is not None else value).alias("value"))


#: A pivot has at most so many columns; more values are a table in long form.
PIVOT_COLUMNS = 1000


def pivot_metric(df: DataFrame, row: str, column: str, metric: Column, fill: float | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """Mean of a metric by row, with a column for each value of `column`; the values are counted and read first if they aren't given."""
    if values is None:
        found = _known(df, [column]).select(column).distinct().orderBy(column).limit(PIVOT_COLUMNS + 1).collect()
        if len(found) > PIVOT_COLUMNS:
            raise ValueError(f"{column} has more than {PIVOT_COLUMNS} values; pivot_cells gives them in long form")
        values = [r[0] for r in found]
    out = _known(df, [row]).groupBy(row).pivot(column, list(values)).agg(round6(F.avg(metric)))
    return out.na.fill(fill) if fill is not None else out


def ladder(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """The aggregates overall, for each key, and for all keys together, in one pass.

    `level` is a number: bit k (from the last key) is set where that key is aggregated away.
    """
    return _known(df, keys).cube(*keys).agg(F.grouping_id().cast("bigint").alias("level"), *aggs)


def difficulty_deltas(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Accuracy of each level minus that of the easier present level, for each model."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("difficulty"))
    known = df.where(F.col("difficulty").isin(*levels) & F.col("model_name").isNotNull())
    acc = known.groupBy("model_name", "difficulty").agg(rate("is_correct").alias("accuracy"))
    by_model = Window.partitionBy("model_name").orderBy(rank)
    out = acc.withColumn("easier", F.lag("difficulty").over(by_model)).withColumn("delta", round6(F.col("accuracy") - F.lag("accuracy").over(by_model)))
    return out.where(F.col("easier").isNotNull()).select("model_name", "easier", F.col("difficulty").alias("harder"), "delta")


def context_adherence(df: DataFrame, is_context: Column) -> DataFrame:
    """Accuracy with and without context for each model, their difference (0 if one is missing), and the cultural score."""
    context = F.avg(F.when(is_context, F.col("is_correct").cast("double")))
    plain = F.avg(F.when(~is_context, F.col("is_correct").cast("double")))
    return _known(df, ["model_name"]).groupBy("model_name").agg(
        round6(context).alias("context_accuracy"),
        round6(plain).alias("plain_accuracy"),
        round6(F.coalesce(context - plain, F.lit(0.0))).alias("delta"),
        round6(F.avg("reasoning_cultural_context")).alias("cultural_average"),
        F.max("reasoning_cultural_context").alias("cultural_max"),
        F.min("reasoning_cultural_context").alias("cultural_min"),
    )


def f1_closed_form(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of the prediction "always correct": a, 1 (0 without positives), 2a / (1 + a)."""
    acc = rate("is_correct")
    return _known(df, keys).groupBy(*keys).agg(
        round6(acc).alias("precision"),
        F.when(acc > 0, 1.0).otherwise(0.0).alias("recall"),
        round6(F.coalesce(2 * acc / (1 + acc), F.lit(0.0))).alias("f1"),
    )


def error_distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and share (percent) of each error type within each group."""
    counts = _known(df, [*keys, "error_type"]).groupBy(*keys, "error_type").agg(F.count("*").alias("n_errors"))
    totals = counts.groupBy(*keys).agg(F.sum("n_errors").alias("total"))
    joined = counts.join(totals, list(keys)) if keys else counts.crossJoin(F.broadcast(totals))
    return joined.select(*keys, "error_type", "n_errors", round6(100.0 * F.col("n_errors") / F.col("total")).alias("percent"))


#: Groups are split at so many quantiles of their different values to find exact percentiles.
SPLITS = 256


def _place(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts are below a value, by bisection."""
    steps = SPLITS.bit_length() + 1
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(cuts, mid) < value
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, mid).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda s: s["low"])


def exact_percentiles(df: DataFrame, keys: Sequence[str], metric: str, points: Sequence[float]) -> DataFrame:
    """Exact percentiles, interpolated, of a metric in each group: the keys and p0, p1, … in the order of the points.

    No task holds a group: equal values are counted first, each group's different
    values are split at approximate quantiles, and only the splits that hold a
    wanted rank are put in order. Null metrics don't count and null keys are a group
    of their own; a group without values has no row.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(metric).cast("double").alias("v")).where(F.col("v").isNotNull())
    if not names:
        names, rows = ["__k0"], rows.withColumn("__k0", F.lit(0))
    counts = rows.groupBy(*names, "v").agg(F.count("*").alias("c"))
    cuts = F.array_sort(F.array_distinct(F.percentile_approx("v", F.array(*(F.lit(k / SPLITS) for k in range(1, SPLITS))), F.lit(8 * SPLITS))))
    groups = counts.groupBy(*names).agg(F.sum("c").alias("n"), cuts.alias("cuts"))
    same = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in names]
    split = counts.alias("a").join(groups.alias("b"), same("a", "b")).select(*(F.col(f"a.{k}") for k in names), "v", "c", "n", _place(F.col("cuts"), F.col("v")).alias("split"))
    before = Window.partitionBy(*names).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.groupBy(*names, "split").agg(F.sum("c").alias("held"), F.first("n").alias("n"))
    sums = sums.withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0)))
    ranks = [(F.col("n") - 1) * F.lit(float(p)) for p in points]
    wanted = F.array(*(r for x in ranks for r in (F.floor(x), F.ceil(x))))
    sums = sums.where(F.exists(wanted, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("held")))).drop("n", "held")
    near = split.alias("a").join(sums.alias("b"), [*same("a", "b"), F.col("a.split") == F.col("b.split")]).select(*(F.col(f"a.{k}") for k in names), "v", "c", "n", "a.split", "below")
    within = Window.partitionBy(*names, "split").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("first", F.col("below") + F.coalesce(F.sum("c").over(within), F.lit(0)))
    at = lambda r: F.max(F.when((r >= F.col("first")) & (r < F.col("first") + F.col("c")), F.col("v")))
    out = near.groupBy(*names).agg(F.first("n").alias("n"), *(at(F.floor(x)).alias(f"low{i}") for i, x in enumerate(ranks)), *(at(F.ceil(x)).alias(f"high{i}") for i, x in enumerate(ranks)))
    mixed = lambda i, x: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (x - F.floor(x))
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), *(mixed(i, x).alias(f"p{i}") for i, x in enumerate(ranks)))


def _with_percentiles(table: DataFrame, df: DataFrame, keys: Sequence[str], metric: str, points: Sequence[float]) -> DataFrame:
    """A table of one row a group with the group's percentiles p0, p1, …; null where it has no values."""
    found = exact_percentiles(df, keys, metric, points)
    if not keys:
        return table.crossJoin(F.broadcast(found.agg(*(F.first(f"p{i}").alias(f"p{i}") for i in range(len(points))))))
    return table.alias("t").join(found.alias("f"), [F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left").select("t.*", *(f"f.p{i}" for i in range(len(points))))


def describe_by(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of a metric for each group; quartiles are exact."""
    known = _known(df, keys)
    out = known.groupBy(*keys).agg(F.count(metric).alias("n"), round6(F.avg(metric)).alias("mean"), round6(F.stddev_samp(metric)).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))
    out = _with_percentiles(out, known, keys, metric, (0.25, 0.5, 0.75))
    return out.select(*keys, "n", "mean", "std", "min", *(round6(F.col(f"p{k}")).alias(f"p{p}") for k, p in enumerate((25, 50, 75))), "max")


def latency_stats(df: DataFrame, keys: Sequence[str], points: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """Mean, extremes, population deviation and percentiles of positive latencies."""
    known = _known(df.where(F.col("latency") > 0), keys)
    out = known.groupBy(*keys).agg(F.count("*").alias("n"), round6(F.avg("latency")).alias("mean"), F.min("latency").alias("min"), F.max("latency").alias("max"), round6(F.stddev_pop("latency")).alias("std"))
    out = _with_percentiles(out, known, keys, "latency", [p / 100 for p in points])
    return out.select(*keys, "n", "mean", "min", "max", "std", *(round6(F.col(f"p{k}")).alias(f"p{p}") for k, p in enumerate(points)))


def box_stats(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Quartiles, fences at 1.5 times the interquartile range, and the values beyond them."""
    q = exact_percentiles(_known(df, [key]), [key], metric, (0.25, 0.5, 0.75)).select(F.col(key).alias("k"), F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"))
    q = q.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col(metric).between(F.col("low"), F.col("high"))
    # One row a group: it goes to every executor if its size, which Spark knows at run time, allows it.
    joined = df.join(q, df[key] == q["k"])
    return joined.groupBy(key).agg(
        round6(F.first("q1")).alias("q1"), round6(F.first("median")).alias("median"), round6(F.first("q3")).alias("q3"),
        F.min(F.when(inside, F.col(metric))).alias("whisker_low"), F.max(F.when(inside, F.col(metric))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def median_stats(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """mean, median, min, max and std of a metric for each group; the median is exact."""
    known = _known(df, keys)
    m = F.col(metric)
    out = known.groupBy(*keys).agg(round6(F.avg(m)).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"), round6(F.stddev_samp(m)).alias("std"))
    return _with_percentiles(out, known, keys, metric, (0.5,)).select(*keys, "mean", round6(F.col("p0")).alias("median"), "min", "max", "std")


def median_ladder(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """`median_stats` overall, for each key, and for all keys together, with the `level` of `ladder`."""
    known = _known(df, keys)
    n = len(keys)
    sets = F.array(*(F.struct(F.lit(level).cast("bigint").alias("level"), *(F.when(F.lit(not level >> (n - 1 - i) & 1), F.col(k)).alias(k) for i, k in enumerate(keys))) for level in range(2**n)))
    long = known.select(F.explode(sets).alias("g"), F.col(metric)).select("g.*", metric)
    m, all_keys = F.col(metric), [*keys, "level"]
    out = long.groupBy(*all_keys).agg(round6(F.avg(m)).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"), round6(F.stddev_samp(m)).alias("std"))
    return _with_percentiles(out, long, all_keys, metric, (0.5,)).select(*all_keys, "mean", round6(F.col("p0")).alias("median"), "std", "min", "max")


def correlations(df: DataFrame, metrics: Sequence[str], least: int = 5) -> DataFrame:
    """Pearson correlation of every pair of metrics over rows that have both; null if there are at most `least`."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(
        *(F.count_if(both(a, b)).alias(f"n_{a}_{b}") for a, b in pairs),
        *(correlation(F.col(a), F.col(b)).alias(f"c_{a}_{b}") for a, b in pairs),
    )
    rows = F.array(
        *(
            F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"n_{a}_{b}").alias("n"), round6(F.when(F.col(f"n_{a}_{b}") > least, F.col(f"c_{a}_{b}"))).alias("correlation"))
            for a, b in pairs
        )
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")


def complete_correlations(df: DataFrame, metrics: Sequence[str], least: int = 5) -> DataFrame:
    """Pearson correlations of all pairs of metrics over the rows that have every one; null if there are fewer than `least`."""
    for m in metrics:
        df = df.where(F.col(m).isNotNull())
    return correlations(df, metrics, least - 1)


def accuracy_by_quartile(df: DataFrame, metric: str, labels: Sequence[str]) -> DataFrame:
    """Accuracy within the quartiles of a metric, whose exact edges are one row."""
    edges = exact_percentiles(df, [], metric, (0.25, 0.5, 0.75))
    x = F.col(metric)
    bucket = F.when(x <= F.col("p0"), labels[0]).when(x <= F.col("p1"), labels[1]).when(x <= F.col("p2"), labels[2]).otherwise(labels[3])
    rows = df.where(x.isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bucket", bucket)
    return rows.groupBy("bucket").agg(F.count("*").alias("n_rows"), round6(rate("is_correct")).alias("accuracy"))


def consistency(df: DataFrame, keys: Sequence[str], answer: str, order: str) -> DataFrame:
    """Self-consistency of groups of more than one answer.

    Agreement is the share of the most common answer (of equally common ones the
    first by `order`); the score is 1 if all agree, else the agreement. Null
    answers aren't counted. Counts are combined per answer before groups are
    formed, so a group of any size is no more than its different answers.
    """
    per_answer = _known(df, [*keys, answer]).groupBy(*keys, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    most = F.max_by(answer, F.struct("n", (-F.col("first")).alias("f")))
    out = per_answer.groupBy(*keys).agg(
        F.sum("n").alias("n_answers"), F.count("*").alias("unique_answers"), most.alias("most_common"), F.max("n").alias("top")
    )
    agreement = F.col("top") / F.col("n_answers")
    out = out.where(F.col("n_answers") > 1)
    return out.select(
        *keys, "n_answers", "unique_answers", "most_common", round6(agreement).alias("agreement_rate"),
        round6(F.when(F.col("unique_answers") == 1, 1.0).otherwise(agreement)).alias("consistency_score"),
    )


def write_back(df: DataFrame, groups: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows with their group's metrics; rows of no group have nulls."""
    return df.join(groups.select(*keys, *columns), list(keys), "left")


def binary_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; 0 where a division has no ground."""
    rows = df.select(truth.alias("t"), predicted.alias("p")).where(F.col("t").isNotNull() & F.col("p").isNotNull())
    tp, fp = F.count_if(F.col("t") & F.col("p")), F.count_if(~F.col("t") & F.col("p"))
    fn, tn = F.count_if(F.col("t") & ~F.col("p")), F.count_if(~F.col("t") & ~F.col("p"))
    c = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        "tp", "fp", "fn", "tn", round6(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
        round6(precision).alias("precision"), round6(recall).alias("recall"), round6(ratio(2 * precision * recall, precision + recall)).alias("f1"),
    )


def running_totals(df: DataFrame, order: str, totals: Sequence[str], buckets: int = 64) -> DataFrame:
    """Totals of all rows with a smaller `order`, over the whole table, without one task that holds it.

    Rows are split at quantiles of `order`; the few bucket totals are added up
    before the rows of each bucket are.
    """
    cuts = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.01)))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col(order) > c).cast("int")
    rows = df.withColumn("__bucket", bucket)
    sums = rows.groupBy("__bucket").agg(*(F.sum(t).alias(f"__{t}") for t in totals))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__bucket", *(F.coalesce(F.sum(f"__{t}").over(before), F.lit(0)).alias(f"__{t}") for t in totals))
    within = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(sums), "__bucket")
    return out.select(*df.columns, *((F.col(f"__{t}") + F.coalesce(F.sum(t).over(within), F.lit(0))).alias(f"before_{t}") for t in totals))


def auc(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """Area under the ROC curve, ties counting half, from counts of positives and negatives by score."""
    rows = df.select(truth.alias("t"), F.col(score).alias("s")).where(F.col("t").isNotNull() & F.col("s").isNotNull())
    by_score = rows.groupBy("s").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    ranked = running_totals(by_score, "s", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return ranked.agg(F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"), round6(wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def multiclass_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each label."""
    cells = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    side = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("is_truth")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_truth")))).alias("x"), "t", "p", "n")
    out = side.groupBy("x.label").agg(
        F.sum(F.when((F.col("x.is_truth") == 1) & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.is_truth") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.is_truth") == 0, F.col("n")).otherwise(0)).alias("n_predicted"),
    )
    precision, recall = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("support"))
    return out.select("label", "support", round6(precision).alias("precision"), round6(recall).alias("recall"), round6(ratio(2 * precision * recall, precision + recall)).alias("f1"))


def multiclass_average(per_label: DataFrame) -> DataFrame:
    """Macro and weighted means of the labels' scores."""
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))
    names = ("precision", "recall", "f1")
    return per_label.agg(*(round6(F.avg(c)).alias(f"macro_{c}") for c in names), *(round6(weighted(c)).alias(f"weighted_{c}") for c in names))


def regression_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """MSE, RMSE, MAE, R2 (0 if the truth doesn't vary) and MAPE over non-zero truths, in percent."""
    rows = df.select(truth.cast("double").alias("y"), predicted.cast("double").alias("p")).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    e = F.col("y") - F.col("p")
    c = rows.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y").alias("var"), F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y")))).alias("mape"))
    r2 = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).otherwise(0.0)
    return c.select("n", round6(F.col("mse")).alias("mse"), round6(F.sqrt("mse")).alias("rmse"), round6(F.col("mae")).alias("mae"), round6(r2).alias("r2"), round6(100 * F.col("mape")).alias("mape"))


def minmax_means(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Group means of each metric, scaled to 0..1 over the groups (0.5 if all are equal), in long form."""
    means = _known(df, [key]).groupBy(key).agg(*(F.avg(m).alias(m) for m in metrics))
    ends = means.agg(*(F.min(m).alias(f"min_{m}") for m in metrics), *(F.max(m).alias(f"max_{m}") for m in metrics))
    joined = means.crossJoin(F.broadcast(ends))
    scaled = lambda m: F.when(F.col(f"max_{m}") > F.col(f"min_{m}"), (F.col(m) - F.col(f"min_{m}")) / (F.col(f"max_{m}") - F.col(f"min_{m}"))).otherwise(0.5)
    return joined.select(key, *(round6(scaled(m)).alias(m) for m in metrics)).unpivot(key, list(metrics), "metric", "scaled")


def radar(df: DataFrame, key: str) -> DataFrame:
    """Speed, reliability, length and quality of each model against the greatest mean of all models."""
    means = _known(df, [key]).groupBy(key).agg(
        F.avg("elapsed_time").alias("t"), F.avg(F.col("has_error").cast("double")).alias("e"), F.avg(F.col("response_length").cast("double")).alias("l"), F.avg("correctness_score").alias("q")
    )
    top = means.agg(F.max("t").alias("mt"), F.max("l").alias("ml"), F.max("q").alias("mq"))
    j = means.crossJoin(F.broadcast(top))
    return j.select(
        key, round6(1 - ratio(F.col("t"), F.col("mt"))).alias("speed"), round6(1 - F.col("e")).alias("reliability"),
        round6(ratio(F.col("l"), F.col("ml"))).alias("length"), round6(ratio(F.col("q"), F.col("mq"))).alias("quality"),
    )


def cost_efficiency(df: DataFrame, key: str) -> DataFrame:
    """Quality per second, consistency of time, and an index of quality and speed for each model."""
    g = _known(df, [key]).groupBy(key).agg(F.avg("correctness_score").alias("q"), F.avg("elapsed_time").alias("t"), F.stddev_samp("elapsed_time").alias("s"))
    top = g.agg(F.max("t").alias("mt"))
    j = g.crossJoin(F.broadcast(top))
    least = lambda c: F.greatest(F.lit(0.1), c)
    return j.select(
        key, round6(F.col("q") / least(F.col("t"))).alias("cost_efficiency"),
        round6(100 - F.least(F.lit(100.0), 100 * F.col("s") / least(F.col("t")))).alias("time_consistency"),
        round6(0.7 * F.col("q") + 0.3 * (1 - ratio(F.col("t"), F.col("mt")))).alias("quality_speed_index"),
    )


def stability(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Deviation, coefficient of variation and its class for each group."""
    cv = F.stddev_samp(metric) / F.nullif(F.avg(metric), F.lit(0.0))
    return _known(df, [key]).groupBy(key).agg(
        round6(F.stddev_samp(metric)).alias("std"), round6(cv).alias("cv"), F.when(cv < 0.3, "High").when(cv < 0.6, "Medium").when(cv.isNotNull(), "Low").alias("stability")
    )


def judge_summary(df: DataFrame, criteria: Sequence[str], weights: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Weighted mean of the judge's criteria for each group: mean, extremes and deviation; a missing score is 0."""
    total = sum(weights)
    overall = sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in zip(criteria, weights)), F.lit(0.0))
    rows = _known(df, keys).withColumn("__overall", overall)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), round6(F.avg("__overall")).alias("mean"), round6(F.min("__overall")).alias("min"), round6(F.max("__overall")).alias("max"),
        round6(F.stddev_samp("__overall")).alias("std"), *(round6(F.avg(F.coalesce(F.col(c), F.lit(0.0)))).alias(f"{c}_mean") for c in criteria),
    )


def positive_means(df: DataFrame, key: str, criteria: Sequence[str]) -> DataFrame:
    """Mean of the positive scores of each criterion and model; 0 where there is none. All pairs come out."""
    g = _known(df, [key]).groupBy(key).agg(*(round6(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))).alias(c) for c in criteria))
    return g.unpivot(key, list(criteria), "criterion", "mean")


def histogram(df: DataFrame, metric: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in bins of equal width; 0 and bins + 1 hold what lies outside."""
    return df.where(F.col(metric).isNotNull()).groupBy(F.width_bucket(metric, F.lit(low), F.lit(high), F.lit(bins)).cast("bigint").alias("bin")).agg(F.count("*").alias("n_rows"))


def corpus_score(df: DataFrame, keys: Sequence[str], candidate: Column, reference: Column, scorer) -> DataFrame:
    """Mean by group of a score of (candidate, reference) Columns that is passed in; rows without one of the texts don't count."""
    rows = _known(df, keys).where(candidate.isNotNull() & reference.isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), round6(F.avg(scorer(candidate, reference))).alias("score"))
