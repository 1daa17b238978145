"""Schemas that drift between the files of a series: changes, and one consistent table.

The schema of each file is read from the top-level keys of its records. A field's
type in a file is the most frequent of its values' types; over files the types
are folded through a promotion lattice, records are cast to the union schema, and
the differences between consecutive files are logged in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import BROADCAST_ROWS, written

#: JSON types in the order of the alphabet.
TYPES = ("array", "boolean", "number", "object", "string")
#: A new name is a renamed one if at least this share of the values that both
#: files hold agree, and for truth values, which agree easily, the second share.
SAME_VALUES, SAME_FLAGS = 0.5, 0.8


def json_type(value: Column) -> Column:
    """The JSON type of a variant; null for a JSON null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", F.lit(None).cast("string"))
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def canonical(value: Column) -> Column:
    """A value as text: the same for a scalar, for it as text and for a one-element list of it."""
    text = F.to_json(value)
    single = F.schema_of_variant(value).startswith("ARRAY") & F.try_variant_get(value, "$[1]", "variant").isNull()
    inner = F.when(single, F.to_json(F.try_variant_get(value, "$[0]", "variant"))).otherwise(text)
    bare = F.when(inner.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), inner, F.lit("}")), "$.v"), inner)).otherwise(inner)
    number = F.try_variant_get(F.try_parse_json(F.when(bare.rlike(r"^-?\d"), bare)), "$", "double")
    return F.when(number.isNotNull(), number.cast("string")).when(F.lower(bare).isin("true", "false"), F.lower(bare)).otherwise(bare)


def fields(records: DataFrame, *keep: str) -> DataFrame:
    """One row for each top-level field of each record: the columns kept, name, value.

    A payload that isn't one JSON object with keys of different names has no fields.
    """
    parsed = records.select(*keep, F.try_parse_json("payload").alias("payload"))
    parsed = parsed.where(F.col("payload").isNotNull() & F.schema_of_variant("payload").startswith("OBJECT"))
    exploded = parsed.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("payload").outer()))
    return exploded.select(*keep, F.col("key").alias("name"), "value")


def file_schemas(records: DataFrame) -> DataFrame:
    """The type of each field of each file, the most frequent of its non-null values: file_id, name, type, n, whole.

    Of types that are equally frequent the first of the alphabet counts; a field
    that is null throughout has a null type. n is the number of records that hold
    the field. Counts are combined before the shuffle.
    """
    typed = fields(records, "file_id").select("file_id", "name", json_type(F.col("value")).alias("t"), F.when(json_type(F.col("value")) == "number", F.schema_of_variant("value") == "BIGINT").alias("w"))
    counts = typed.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.coalesce(F.bool_and("w"), F.lit(False)).alias("whole"), *(F.count_if(F.col("t") == t).alias(t) for t in TYPES))
    most = F.greatest(*TYPES)
    chosen = F.when(most == 0, F.lit(None).cast("string"))
    for t in TYPES:
        chosen = chosen.when(F.col(t) == most, t)
    return counts.select("file_id", "name", chosen.alias("type"), "n", "whole")


def _transitions(files: DataFrame, records: DataFrame) -> DataFrame:
    """For each file with one before it, its new, gone and retyped fields: file_id, before_id, name, how, old_type, new_type.

    A field's files are put in order; a field that the file before lacks is new,
    one that the file after lacks is gone there.
    """
    series = ["exporter", "dataset"]
    one = files.select("file_id", *series, F.col("file_no").cast("long").alias("no"))
    in_order = Window.partitionBy(*series).orderBy("no", "file_id")
    one = one.withColumn("before_id", F.when(F.lag("no").over(in_order) == F.col("no") - 1, F.lag("file_id").over(in_order)))
    one = one.withColumn("after_id", F.when(F.lead("no").over(in_order) == F.col("no") + 1, F.lead("file_id").over(in_order)))
    held = file_schemas(records).drop("n", "whole").join(one, "file_id")
    of_field = Window.partitionBy(*series, "name").orderBy("no", "file_id")
    held = held.select(
        "*",
        (F.lag("file_id").over(of_field) == F.col("before_id")).alias("kept_before"),
        F.lag("type").over(of_field).alias("type_before"),
        (F.lead("file_id").over(of_field) == F.col("after_id")).alias("kept_after"),
    )
    none = F.lit(None).cast("string")
    event = lambda how, f, b, old, new: F.struct(F.lit(how).alias("how"), f.alias("file_id"), b.alias("before_id"), old.alias("old_type"), new.alias("new_type"))
    this, before, after, kind = F.col("file_id"), F.col("before_id"), F.col("after_id"), F.col("type")
    is_kept = F.coalesce("kept_before", F.lit(False))
    events = F.array(
        F.when(before.isNotNull() & ~is_kept, event("new", this, before, none, kind)),
        F.when(is_kept & (F.col("type_before") != kind), event("retyped", this, before, F.col("type_before"), kind)),
        F.when(after.isNotNull() & ~F.coalesce("kept_after", F.lit(False)), event("gone", after, this, kind, none)),
    )
    return held.select("name", F.explode(F.array_compact(events)).alias("e")).select("e.*", "name")


def _renames(records: DataFrame, events: DataFrame) -> DataFrame:
    """Which new names hold the values of names that are gone: file_id, name, old_name.

    Values are compared for the records that both files hold, by record_key; of a
    record whose lines differ the least value counts. Each name is matched at most
    once, the closest pair first.
    """
    both = events.where(F.col("how") != "retyped").groupBy("file_id", "before_id").agg(
        F.collect_list(F.when(F.col("how") == "new", F.col("name"))).alias("new"), F.collect_list(F.when(F.col("how") == "gone", F.col("name"))).alias("gone")
    )
    both = both.where((F.size("new") > 0) & (F.size("gone") > 0))
    side = lambda name, f, names: F.struct(f.alias("file_id"), F.col("file_id").alias("pair"), F.lit(name).alias("side"), names.alias("names"))
    wanted = both.select(F.explode(F.array(side("new", F.col("file_id"), F.col("new")), side("old", F.col("before_id"), F.col("gone")))).alias("w")).select("w.*")
    # A file is in at most two pairs.
    wanted = wanted.groupBy("file_id").agg(F.collect_list(F.struct("pair", "side", "names")).alias("wanted"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = fields(records.where(F.col("record_key").isNotNull()).join(wanted, "file_id"), "record_key", "wanted")
    found = found.where(~F.is_variant_null("value")).select("record_key", "name", "value", F.explode("wanted").alias("w"))
    found = found.where(F.array_contains("w.names", F.col("name")))
    value = found.select("w.pair", "w.side", "record_key", "name", F.xxhash64(canonical(F.col("value"))).alias("v"), (json_type(F.col("value")) == "boolean").alias("flag"))
    value = value.groupBy("pair", "record_key", "side", "name").agg(F.min("v").alias("v"), F.max("flag").alias("flag"))
    by_record = value.groupBy("pair", "record_key").agg(
        F.collect_list(F.when(F.col("side") == "new", F.struct("name", "v", "flag"))).alias("new"),
        F.collect_list(F.when(F.col("side") == "old", F.struct("name", "v"))).alias("old"),
    )
    compared = by_record.select("pair", F.explode("new").alias("n"), "old").select("pair", "n", F.explode("old").alias("o"))
    score = compared.groupBy("pair", F.col("n.name").alias("name"), F.col("o.name").alias("old_name")).agg(
        F.count_if(F.col("n.v") == F.col("o.v")).alias("same"), F.count("*").alias("shared"), F.max("n.flag").alias("flag")
    )
    share = F.col("same") / F.col("shared")
    enough = F.when(F.col("flag"), share >= SAME_FLAGS).otherwise(share >= SAME_VALUES)
    score = score.where((F.col("same") > 0) & enough).withColumn("rank", F.struct(share.alias("s"), "same"))
    by_new = Window.partitionBy("pair", "name").orderBy(F.col("rank").desc(), "old_name")
    by_old = Window.partitionBy("pair", "old_name").orderBy(F.col("rank").desc(), "name")
    ranked = score.withColumn("a", F.row_number().over(by_new)).withColumn("b", F.row_number().over(by_old))
    return ranked.where((F.col("a") == 1) & (F.col("b") == 1)).select(F.col("pair").alias("file_id"), "name", "old_name")


def changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """Every change of a file's schema against the file before it: file_id, field_name, change_kind, old_name, old_type, new_type.

    Kinds are `renamed`, `added`, `removed` and `retyped`; a field that is renamed
    and changes type has two rows. The first file of a series has none, and so has
    a file whose number doesn't follow another's. A file without records has no
    fields. Records that occur twice count twice for types and once for renames;
    null record keys match nothing; a field that is null throughout has no type
    to change. Empty tables give an empty log.

    The payloads are parsed twice: once for the schemas, whose few differences are
    written to the checkpoint folder, and once for the values of new and gone
    names only.
    """
    events = written(_transitions(files, records))
    moved = _renames(records, events)
    new = events.where(F.col("how") == "new").join(moved, ["file_id", "name"], "left")
    gone = events.where(F.col("how") == "gone").select("file_id", F.col("name").alias("old_name"), "old_type")
    # Each gone name meets the new name that took it over, if there is one.
    met = new.drop("old_type", "how", "before_id").join(gone, ["file_id", "old_name"], "full")
    event = lambda kind, name: F.struct(name.alias("field_name"), F.lit(kind).alias("change_kind"))
    name, old = F.col("name"), F.col("old_name")
    kinds = F.array(
        F.when(name.isNotNull() & old.isNotNull(), event("renamed", name)),
        F.when(name.isNotNull() & old.isNull(), event("added", name)),
        F.when(name.isNull(), event("removed", old)),
        F.when(name.isNotNull() & old.isNotNull() & (F.col("old_type") != F.col("new_type")), event("retyped", name)),
    )
    first = met.select("file_id", F.explode(F.array_compact(kinds)).alias("e"), "old_name", "old_type", "new_type")
    first = first.select("file_id", "e.field_name", "e.change_kind", "old_name", "old_type", "new_type")
    kept = events.where(F.col("how") == "retyped").select("file_id", F.col("name").alias("field_name"), F.lit("retyped").alias("change_kind"), F.col("name").alias("old_name"), "old_type", "new_type")
    return first.unionByName(kept)


#: The lattice of types: what is next above each. Null is below every type; text, which holds any value as JSON, is above all.
ABOVE = {"integer": "number", "number": "string", "boolean": "string", "array": "string", "object": "string", "string": None}


def promote(types: set[str | None]) -> str:
    """The least type that holds all given types: the first of the chain above one that lies above each of the others too; text for none."""

    def chain(t: str | None) -> list[str]:
        return [] if t is None else [t, *chain(ABOVE[t])]

    chains = [chain(t) for t in types if t]
    return next((t for t in chains[0] if all(t in c for c in chains)), "string") if chains else "string"


#: How each type of the lattice is stored in the consistent table.
COLUMN_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "array": "string", "object": "string"}


#: A text that is a number.
NUMBER, INTEGER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$", r"^\s*[-+]?[0-9]+\s*$"


def stored(value: Column, kind: str) -> Column:
    """A value as its field's type is stored; null if it isn't of this type nor text of it.

    Numbers are no truth values and truth values no numbers.
    """
    t, text = json_type(value), F.try_variant_get(value, "$", "string")
    if COLUMN_TYPES[kind] == "string":
        return text
    if kind == "boolean":
        fits = (t == "boolean") | ((t == "string") & F.lower(text).isin("true", "false"))
    else:
        # What doesn't fit whole numbers, as 7.5 among them, is a stray.
        fits = F.when(t == "number", F.schema_of_variant(value) == "BIGINT" if kind == "integer" else F.lit(True)).otherwise((t == "string") & text.rlike(INTEGER if kind == "integer" else NUMBER))
    return F.when(fits, F.try_variant_get(value, "$", COLUMN_TYPES[kind]))


def one_table(files: DataFrame, records: DataFrame, dataset: str, strays: str | None = None) -> DataFrame:
    """All records of a dataset as one table with one column for each field.

    Names that a rename links are one field, called by its most frequent name (of
    equally frequent ones the first). A field's type is that of all its files
    folded through the lattice: whole numbers are below numbers, and these, truth
    values, lists and objects below text, which holds all values as JSON text. A value that differs from the
    type of all its field's files and can't be cast is a stray and null there, and
    of a record that holds two names of a field the first with a value counts. Both
    are kept as JSON text by name in the column that `strays` names, a map that is
    null where nothing was left out. Columns are file_id, line_no, record_key, the
    fields in the order of the alphabet, and the strays; a field called like one of
    these gets a `_` after it. Lines that occur twice come out twice. The list of
    names is small, as schemas are; no values reach the driver.
    """
    own = files.where(F.col("dataset") == dataset)
    rows = records.join(own.select("file_id"), "file_id")
    counts = file_schemas(rows).groupBy("name").agg(F.sum("n").alias("n"), F.collect_set(F.when((F.col("type") == "number") & F.col("whole"), "integer").otherwise(F.col("type"))).alias("types"))
    seen = {r.name: r for r in counts.collect()}
    log = changes(own, rows)
    links = log.where(F.col("change_kind") == "renamed").select("field_name", "old_name").distinct().collect()
    group = {n: n for n in seen}

    def root(n: str) -> str:
        while group[n] != n:
            n = group[n]
        return n

    for a, b in sorted(map(tuple, links)):
        group[root(a)] = root(b)
    members: dict[str, list[str]] = {}
    for n in sorted(seen):
        members.setdefault(root(n), []).append(n)
    found, cast, columns, left_out = [], [], [], []
    for names in members.values():
        main = min(names, key=lambda n: (-seen[n]["n"], n))
        kind = promote({t for n in names for t in seen[n]["types"]})
        before: list[Column] = []
        for n in sorted(names, key=lambda n: (n != main, n)):
            v, c = f"v{len(found)}", f"c{len(found)}"
            found.append(F.try_element_at("fields", F.lit(n)).alias(v))
            cast.append(stored(F.col(v), kind).alias(c))
            taken = F.col(c).isNotNull() & (F.coalesce(*before).isNull() if before else F.lit(True))
            left_out.append(F.when(~taken & F.col(v).isNotNull() & ~F.is_variant_null(v), F.struct(F.lit(n).alias("key"), F.to_json(F.col(v)).alias("value"))))
            before.append(F.col(c))
        columns.append((main, F.coalesce(*before)))
    fixed = ["file_id", "line_no", "record_key"]
    named = [v.alias(n + "_" if n in [*fixed, strays] else n) for n, v in sorted(columns, key=lambda x: x[0])]
    if strays:
        entries = F.array_compact(F.array(*left_out)) if left_out else F.array().cast("array<struct<key:string,value:string>>")
        named.append(F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias(strays))
    # By key, as a path can't hold every name.
    by_name = F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>")
    each = rows.select(*fixed, by_name.alias("fields")).select(*fixed, *found)
    return each.select("*", *cast).select(*fixed, *named)
