import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparvec.sources.badrows import LineSchema, first_broken_field, load_lines

NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
FILES = "file_no int, file_name string, format string, dimensions int"
LINES = "line_id long, file_no int, line_no long, line string, format string"


def judged(line, fmt, dims):
    """Character by character, without patterns."""
    if line is None or not (s := line.strip(" \t\r")):
        return "skip"
    if fmt == "glove":
        fields = s.replace("\t", " ").split(" ")
        fields = [f for f in fields if f]
    else:
        fields, i = [], 0
        while True:
            while i < len(s) and s[i] in " \t":
                i += 1
            if i < len(s) and s[i] == '"':
                i += 1
                out = ""
                while True:
                    if i >= len(s):
                        return "broken_quoting"
                    if s[i] == '"':
                        if s[i + 1 : i + 2] == '"':
                            out += '"'
                            i += 2
                            continue
                        i += 1
                        break
                    out += s[i]
                    i += 1
                while i < len(s) and s[i] in " \t":
                    i += 1
                if i < len(s) and s[i] != ",":
                    return "broken_quoting"
            else:
                j = s.find(",", i)
                out = s[i : len(s) if j < 0 else j]
                if '"' in out:
                    return "broken_quoting"
                i += len(out)
                out = out.strip(" \t")
            fields.append(out)
            if i >= len(s):
                break
            i += 1
    if len(fields) < dims + 1:
        return "too_few_columns"
    if len(fields) > dims + 1:
        return "too_many_columns"
    if not fields[0].strip():
        return "missing_term"
    for f in fields[1:]:
        if not NUMBER.fullmatch(f) or math.isinf(float(f)) or abs(float(f)) > 3.4028235677973366e38:
            return "bad_value"
    return None


def run(spark, lines, fmt, dims):
    files = spark.createDataFrame([(1, "f", fmt, dims)], FILES)
    df = spark.createDataFrame([(i, 1, i, x, "clash") for i, x in enumerate(lines)], LINES)
    valid, failing = load_lines(df, files)
    return {r["line_id"]: r for r in valid.collect()}, {r["line_id"]: r for r in failing.collect()}


CSV = ['a,1,2', '"a,b",1,2', '"a ""q""",1,2', '"a,1,2', 'a"b,1,2', '"a" x,1,2', ' "a" , 1 ,2 ', "a,1", "a,1,2,3", ",1,2", '"",1,2', '"  ",1,2', "a,,2", "a,1e,2", 'a,"1","2"', "a,1e39,2", "a,.5,5.", "", "  \t\r", None, "a,1,2\r", '"', '"""",1,2', "a,٣,2", "a,nan,2", "a,1,-3.4028235e38", "a,1_0,2", ",", '""""', "a,1,2,", "　,1,2"]
SPACED = ["a 1 2", "a\t1  2 ", '"a 1 2', "a 1", "a 1 2 3", "\xa0 1 2", "a 1 x", "a +1 -.5e3", "a 1 inf", "1 2", "", None, "\r", "a 1 2\r", "a 1 1e-999", "a 0x1 2"]


@pytest.mark.parametrize(("fmt", "lines"), [("csv", CSV), ("glove", SPACED)])
def test_cases(spark, fmt, lines):
    valid, failing = run(spark, lines, fmt, 2)
    for i, line in enumerate(lines):
        want = judged(line, fmt, 2)
        got = "skip" if i not in valid and i not in failing else failing[i]["reason"] if i in failing else None
        assert got == want, (line, got, want)
        assert not (i in valid and i in failing)
    for i, r in valid.items():
        assert len(r["vector"]) == 2 and r["term"].strip()


def test_terms_and_broken_fields(spark):
    valid, failing = run(spark, ['"a ""q"", b" ,1,2', "a,1,x", "a,x,2", "b,1,1e39", '"a,1,2'], "csv", 2)
    assert valid[0]["term"] == 'a "q", b' and list(valid[0]["vector"]) == [1.0, 2.0]
    assert [failing[i]["broken_field"] for i in (1, 2, 3, 4)] == [2, 1, 2, 0]
    s = LineSchema("csv", 2)
    assert first_broken_field(s, "a,1,x") == 2 and first_broken_field(s, "a,1,2") == 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='a",1.e \t-\r', max_size=14), min_size=30, max_size=60), st.sampled_from(["csv", "glove"]))
def test_against_a_plain_parser(spark, lines, fmt):
    valid, failing = run(spark, lines, fmt, 1)
    for i, line in enumerate(lines):
        want = judged(line, fmt, 1)
        got = "skip" if i not in valid and i not in failing else failing[i]["reason"] if i in failing else None
        assert got == want, (line, got, want)


def test_whole_table_against_the_plain_parser(spark, small):
    lines, files = spark.read.parquet(f"{small}/glove_lines.parquet"), spark.read.parquet(f"{small}/glove_files.parquet")
    kind = {r["file_no"]: (r["format"], r["dimensions"]) for r in files.collect()}
    want = {r["line_id"]: j for r in lines.collect() if (j := judged(r["line"], *kind[r["file_no"]])) not in (None, "skip")}
    assert {r["line_id"]: r["reason"] for r in load_lines(lines, files)[1].collect()} == want


def test_unknown_files_empty_tables_and_long_lines(spark):
    files = spark.createDataFrame([(1, "f", "csv", 1)], FILES)
    df = spark.createDataFrame([(1, 9, 1, "a,1", ""), (2, None, 1, "a,1", ""), (3, 1, 1, "a," * 200_000, ""), (4, 1, 2, '"' + "x" * 500_000, ""), (5, 1, 3, '"' + '""' * 200_000 + '",1', "")], LINES)
    got = {r["line_id"]: r["reason"] for r in load_lines(df, files)[1].collect()}
    assert got == {1: "unknown_schema", 2: "unknown_schema", 3: "too_many_columns", 4: "broken_quoting"}
    for part in load_lines(df.where("false"), files):
        assert part.count() == 0
    assert {r["reason"] for r in load_lines(df, files.where("false"))[1].collect()} == {"unknown_schema"}
    assert F is not None
    with pytest.raises(ValueError):
        LineSchema("xml", 2)
