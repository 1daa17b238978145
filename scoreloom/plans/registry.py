"""All queries of the core with their SQL."""

from __future__ import annotations

from scoreloom.operators import drift
from scoreloom.plans import analytics, judging, relations, reports, texts  # noqa: F401
from scoreloom.plans.base import QUERIES, SQL, Query, query
from scoreloom.sources.tables import table


@query("p5_found")
def p5_found(spark, folder):
    files, records = table(spark, folder, "raw_files"), table(spark, folder, "raw_records")
    return drift.changes(files, records).select("file_id", "field_name", "change_kind")


def _one_table(dataset: str) -> None:
    query(f"p5_table_{dataset}")(lambda spark, folder: drift.one_table(table(spark, folder, "raw_files"), table(spark, folder, "raw_records"), dataset, "strays"))


for _dataset in ("analyzed_results", "processed_results", "results"):
    _one_table(_dataset)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
