import json
from datetime import datetime

from scoreloom.operators import drift

FILES = "file_id bigint, exporter string, dataset string, file_no int, file_name string, written_at timestamp"
RECORDS = "file_id bigint, line_no int, record_key bigint, payload string"


def tables(spark, series):
    """series: {(exporter, file_no): [(key, object or text)]}"""
    files, records = [], []
    for i, ((exporter, no), rows) in enumerate(series.items(), 1):
        files.append((i, exporter, "results", no, f"f{i}", datetime(2022, 1, 1)))
        records += [(i, k, key, p if isinstance(p, str) or p is None else json.dumps(p)) for k, (key, p) in enumerate(rows, 1)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(records, RECORDS)


def log(spark, series):
    return {tuple(r) for r in drift.changes(*tables(spark, series)).select("file_id", "field_name", "change_kind").collect()}


def test_added_removed_retyped_renamed(spark):
    first = [(k, {"model": f"m{k}", "t": k * 1.5, "old": k, "same": True}) for k in range(6)]
    second = [(k, {"model_name": f"m{k}", "t": str(k * 1.5), "new": "x", "same": True}) for k in range(3, 9)]
    assert log(spark, {("a", 1): first, ("a", 2): second}) == {
        (2, "model_name", "renamed"), (2, "t", "retyped"), (2, "new", "added"), (2, "old", "removed"),
    }


def test_renamed_and_retyped_as_text_or_list(spark):
    first = [(k, {"a": k + 0.5, "b": f"v{k}"}) for k in range(4)]
    second = [(k, {"a2": str(k + 0.5), "b2": [f"v{k}"]}) for k in range(4)]
    assert log(spark, {("a", 1): first, ("a", 2): second}) == {(2, x, kind) for x in ("a2", "b2") for kind in ("renamed", "retyped")}


def test_strays_nulls_repeated_and_broken_lines(spark):
    first = [(1, {"x": 1}), (2, {"x": 2}), (3, {"x": "stray"}), (1, {"x": 1}), (None, {"x": 3}), (9, None), (9, "no json"), (9, "[1]")]
    second = [(1, {"x": None}), (2, {"x": 5}), (3, {"x": 6})]
    assert log(spark, {("a", 1): first, ("a", 2): second}) == set()


def test_gap_empty_file_and_other_series(spark):
    series = {("a", 1): [(1, {"x": 1})], ("a", 3): [(1, {"y": 1})], ("b", 1): [(1, {"x": 1})], ("b", 2): [], ("b", 3): [(1, {"x": 1})]}
    assert log(spark, series) == {(4, "x", "removed"), (5, "x", "added")}


def test_empty_tables(spark):
    assert drift.changes(spark.createDataFrame([], FILES), spark.createDataFrame([], RECORDS)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    files, records = tables(spark, {("a", 1): [(1, {"x": 1})], ("a", 2): [(1, {"y": 2})]})
    out = drift.changes(files.selectExpr("*", "1 AS name", "2 AS payload"), records.selectExpr("*", "3 AS name", "4 AS exporter"))
    assert {r.change_kind for r in out.collect()} == {"added", "removed"}


def test_one_table_unites_names_and_types(spark):
    first = [(k, {"model": f"m{k}", "n": k, "file_id": 7}) for k in range(30)]
    second = [(k, {"model_name": f"m{k}", "n": "stray" if k == 29 else k, "tags": ["a"]}) for k in range(20, 60)]
    out = drift.one_table(*tables(spark, {("a", 1): first, ("a", 2): second}), "results")
    assert out.columns == ["file_id", "line_no", "record_key", "file_id_", "model_name", "n", "tags"]
    assert dict(out.dtypes)["n"] == "bigint"
    assert out.where("model_name IS NULL").count() == 0 and out.count() == 70


def test_one_table_keeps_files_of_other_types_and_strays(spark):
    first = [(k, {"n": k + 0.5, "ok": True, "f": 0.25}) for k in range(100)]
    second = [(k, {"n": {"value": k + 0.5}, "ok": k, "f": True if k == 1 else "x" if k == 2 else "nan" if k == 3 else "7.5"}) for k in range(4)]
    second += [(k, {"f": k}) for k in range(100, 110)]
    out = drift.one_table(*tables(spark, {("a", 1): first, ("a", 2): second}), "results", "strays")
    assert dict(out.dtypes[3:]) == {"f": "double", "n": "string", "ok": "string", "strays": "map<string,string>"}
    rows = {r.record_key: r for r in out.where("file_id = 2").collect()}
    assert [(rows[k].n, rows[k].ok, rows[k].f, rows[k].strays) for k in range(4)] == [
        ('{"value":0.5}', "0", 7.5, None), ('{"value":1.5}', "1", None, {"f": "true"}), ('{"value":2.5}', "2", None, {"f": '"x"'}), ('{"value":3.5}', "3", None, {"f": '"nan"'}),
    ]
    assert out.where("record_key >= 100 AND strays IS NOT NULL").count() == 0
    assert out.where("file_id = 1 AND (n IS NULL OR ok IS NULL OR f IS NULL OR strays IS NOT NULL)").count() == 0


def test_one_table_keeps_both_names_of_a_field(spark):
    first = [(k, {"t": k}) for k in range(5)]
    second = [(k, {"time": k}) for k in range(5)]
    third = [(9, {"t": 1, "time": 2})]
    out = drift.one_table(*tables(spark, {("a", 1): first, ("a", 2): second, ("b", 1): third}), "results", "strays")
    assert out.where("file_id = 3").select("t", "strays").collect() == [(1.0, {"time": "2"})]


def test_one_table_keeps_names_of_any_letters(spark):
    first = [(k, {"it's": k, "d'": f"v{k}", 'a"b\'c': True, "": "x", "p.q`": 1}) for k in range(5)]
    second = [(k, {"it": k, "d'": f"v{k}"}) for k in range(5)]
    out = drift.one_table(*tables(spark, {("a", 1): first, ("a", 2): second}), "results", "strays")
    assert out.columns[3:] == ["", 'a"b\'c', "d'", "it", "p.q`", "strays"]
    rows = [tuple(r)[3:] for r in out.orderBy("file_id", "line_no").collect()]
    assert rows == [("x", True, f"v{k}", float(k), 1.0, None) for k in range(5)] + [(None, None, f"v{k}", float(k), None, None) for k in range(5)]


def test_promotion():
    assert drift.promote({"number", None}) == "number" and drift.promote({"integer"}) == "integer"
    assert drift.promote({"integer", "number"}) == "number" and drift.promote({"number", "integer", None}) == "number"
    assert drift.promote({"number", "string"}) == drift.promote({"integer", "boolean"}) == drift.promote({"array", "object"}) == "string"
    assert drift.promote({"boolean"}) == "boolean" and drift.promote(set()) == drift.promote({None}) == "string"


def test_whole_numbers_become_numbers_where_a_file_has_others(spark):
    first = [(k, {"n": k, "w": k}) for k in range(6)]
    second = [(k, {"n": k + 0.5, "w": "12" if k == 1 else "7.5" if k == 2 else k}) for k in range(6)]
    out = drift.one_table(*tables(spark, {("a", 1): first, ("a", 2): second}), "results", "strays")
    assert dict(out.dtypes[3:]) == {"n": "double", "w": "bigint", "strays": "map<string,string>"}
    rows = {r.record_key: r for r in out.where("file_id = 2").collect()}
    assert (rows[0].n, rows[1].w, rows[2].w, rows[2].strays) == (0.5, 12, None, {"w": '"7.5"'})


def test_no_shared_folder_is_an_error(spark, monkeypatch):
    from types import SimpleNamespace

    from scoreloom import session

    empty = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)), getConf=lambda: {}, master="spark://host:7077")
    with __import__("pytest").raises(ValueError, match="spark.checkpoint.dir"):
        session.written(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))
