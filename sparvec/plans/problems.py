"""Queries of the general data-preparation operators of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.badrows import load_lines


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load_lines(spark.read.parquet(f"{sf_dir}/glove_lines.parquet"), spark.read.parquet(f"{sf_dir}/glove_files.parquet"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)[1].select("line_id", "reason")


def p7_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)[1]


def p7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)[0].withColumn("vector", F.transform("vector", lambda x: x.cast("double")))


# The SQL judges by its own patterns (RE2, no possessive quantifiers), not by those of the operator.
_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_FIELD = r'[ \t]*("([^"]|"")*"[ \t]*|[^",]*)'
_JUDGED = rf"""
WITH l AS (SELECT line_id, file_no, line_no, trim(line, ' ' || chr(9) || chr(13)) AS s, format, dimensions
           FROM glove_lines JOIN glove_files USING (file_no)
           WHERE line IS NOT NULL AND trim(line, ' ' || chr(9) || chr(13)) <> ''),
     f AS (SELECT *, CASE WHEN format = 'csv' AND NOT regexp_full_match(s, '{_FIELD}(,{_FIELD})*') THEN NULL
                          WHEN format = 'csv' THEN regexp_extract_all(',' || s, ',({_FIELD})', 1)
                          ELSE regexp_split_to_array(s, '[ \t]+') END AS raw FROM l),
     g AS (SELECT *, list_transform(raw, lambda x: CASE WHEN format = 'csv' AND starts_with(trim(x, ' ' || chr(9)), '"')
                          THEN replace(trim(x, ' ' || chr(9))[2:-2], '""', '"')
                          WHEN format = 'csv' THEN trim(x, ' ' || chr(9)) ELSE x END) AS v FROM f),
     h AS (SELECT *, CASE WHEN v IS NULL THEN 'broken_quoting'
                          WHEN len(v) < dimensions + 1 THEN 'too_few_columns'
                          WHEN len(v) > dimensions + 1 THEN 'too_many_columns'
                          WHEN NOT regexp_matches(v[1], '[^\s\p{{Z}}]') THEN 'missing_term'
                          WHEN len(list_filter(v[2:], lambda x: NOT regexp_full_match(x, '{_NUM}') OR abs(try_cast(x AS DOUBLE)) >= 3.4028235677973366e38)) > 0 THEN 'bad_value' END AS reason FROM g)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p7_found": p7_found, "p7_failures": p7_failures, "p7_rows": p7_rows}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": _JUDGED + "SELECT line_id, reason FROM h WHERE reason IS NOT NULL",
        "p7_rows": _JUDGED + "SELECT line_id, file_no, line_no, v[1] AS term, list_transform(v[2:], lambda x: x::FLOAT::DOUBLE) AS vector FROM h WHERE reason IS NULL",
    }
