"""Hidden storage limits of each source, and the texts that they or a broken transfer cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A limit shows as at least so many texts of one length with different endings, as so many
#: times as many as each length within AROUND units has on average, and as so many standard
#: deviations more than that, as chance alone has high counts among many lengths.
LEAST, TIMES, DEVIATIONS, AROUND = 10, 6.0, 8.0, 40
#: A cut falls between characters, so a text may be so many units shorter than its limit;
#: a broken last character that was replaced makes it so many bytes longer.
SLACK, REPLACED = 3, 2
#: No store has a limit shorter than the second; texts are counted from the first on.
COUNTED, SHORTEST = 24, 64
#: Characters, with digits alike, by which endings differ: messages made of one template end alike.
ENDING = 12
#: Limits that are handed to the workers as one map; beyond them they are joined.
MAP_ROWS = 50_000


def _count(text: Column, char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def lengths(text: Column) -> dict[str, Column]:
    """Length of a text under each way in which a store may have measured it."""
    chars, utf8 = F.char_length(text), F.octet_length(text)
    lines = _count(text, "\n") - _count(text, "\r\n") / 2
    quoted = _count(text, '"') + _count(text, "\\") + _count(text, "\n") + _count(text, "\r") + _count(text, "\t")
    entities = 4 * _count(text, "&") + 3 * _count(text, "<") + 3 * _count(text, ">") + 5 * _count(text, '"')
    return {
        "characters": chars,
        "utf8": utf8,
        "utf16": F.octet_length(F.encode(text, "UTF-16LE")) / 2,
        "crlf": chars + lines,
        "crlf_utf8": utf8 + lines,
        "json": chars + quoted,
        "json_utf8": utf8 + quoted,
        "entities": chars + entities,
        "entities_utf8": utf8 + entities,
    }


def length_of(measure: str, text: str) -> int:
    """The same lengths, of one Python string."""
    base = len(text.encode("utf-8", "replace")) if measure.endswith("utf8") else len(text)
    if measure == "utf16":
        return len(text.encode("utf-16-le", "replace")) // 2
    if measure.startswith("crlf"):
        return base + text.count("\n") - text.count("\r\n")
    if measure.startswith("json"):
        return base + sum(map(text.count, '"\\\n\r\t'))
    if measure.startswith("entities"):
        return base + 4 * text.count("&") + 3 * text.count("<") + 3 * text.count(">") + 5 * text.count('"')
    return base


def source_key(source: Column) -> Column:
    """Sources that differ only in case and blanks around are the same; null is one of its own."""
    return F.coalesce(F.lower(F.trim(source)), F.lit(""))


def storage_limits(df: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """Lengths at which the texts of a source pile up: source, measure, size, n_texts, n_expected.

    All texts that don't end as a sentence are measured under every encoding, and
    the different endings of each (source, measure, length) are counted. A limit also
    shows, weaker, under the other encodings near it; the one under which most texts
    have it is the limit's own (of equal ones the first of `lengths`, then the
    shortest), so a limit is one row. Null and empty texts and limits below SHORTEST
    are left out; a source without limit gives no row, as does an empty table.
    """
    text = F.col(f"`{text_col}`")
    unfinished = ~F.substring(F.rtrim(text), -1, 1).isin(".", "!", "?")
    kinds = lengths(text)
    names = F.array(*map(F.lit, kinds))
    # Texts delivered again, or made of one template, count once; only a hash and lengths move.
    ending = F.xxhash64(F.regexp_replace(F.substring(text, -ENDING, ENDING), "[0-9]+", "0"))
    different = df.where((F.char_length(text) >= COUNTED) & unfinished).select(
        source_key(F.col(f"`{source_col}`")).alias("source"), ending.alias("ending"), F.array(*(c.cast("int") for c in kinds.values())).alias("sizes")
    ).distinct()
    measured = different.select("source", F.posexplode("sizes").alias("place", "size"))
    counts = measured.groupBy("source", "place", "size").agg(F.count("*").alias("n_texts"))
    near = Window.partitionBy("source", "place").orderBy("size").rangeBetween(-AROUND, AROUND)
    found = counts.withColumn("n_expected", (F.sum("n_texts").over(near) - F.col("n_texts")) / (2.0 * AROUND))
    high = (F.col("n_texts") >= TIMES * F.col("n_expected")) & (F.col("n_texts") - F.col("n_expected") >= DEVIATIONS * F.sqrt(F.col("n_expected") + 1))
    found = found.where((F.col("n_texts") >= LEAST) & high & (F.col("size") >= SHORTEST))
    rank = F.struct("n_texts", (-F.col("place")).alias("p"), (-F.col("size")).alias("s"))
    of_source = Window.partitionBy("source").orderBy("size").rangeBetween(-AROUND, AROUND)
    best = found.withColumn("rank", rank).withColumn("best", F.max("rank").over(of_source)).where(F.col("rank") == F.col("best"))
    return best.select("source", F.element_at(names, F.col("place") + 1).alias("measure"), "size", "n_texts", "n_expected")


def limit_map(limits: DataFrame) -> dict[str, list[tuple[str, int]]] | None:
    """The limits by source, or None if there are more than MAP_ROWS."""
    rows = limits.select("source", "measure", "size").take(MAP_ROWS + 1)
    if len(rows) > MAP_ROWS:
        return None
    out: dict[str, list[tuple[str, int]]] = {}
    for r in rows:
        out.setdefault(r.source, []).append((r.measure, r["size"]))
    return out


def at_limit(limits: list[tuple[str, int]], text: str) -> bool:
    """Whether a text is as long as one of its source's limits."""
    for measure, size in limits:
        short = size - length_of(measure, text)
        if (-REPLACED if measure.endswith("utf8") else 0) <= short <= SLACK:
            return True
    return False
