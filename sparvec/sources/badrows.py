"""Loading delimited vector lines while setting failing rows apart with their reason.

One anchored pattern per schema (format and dimensions) accepts whole rows. Rows it refuses pass
through incremental field-prefix patterns, of which the first that no longer matches names the
first broken field: prefixes of well-formed fields where quoting or the number of columns is at
fault, prefixes of a term and values where the row has its columns. That field decides the reason:
beyond the last column there are too many, before it the row ended early, field 0 is the term, any
other a value. All of it is JVM-side ``rlike``; repetition is possessive, so a row costs time linear
in its length and no stack. Prefixes are tried in strides, then within the stride.

The verdict passes through a generator (one row for one), behind which filters are not pushed, so
each pattern stands in the plan once.

Defined cases
    * null and blank lines (spaces, tabs, carriage returns only) are neither rows nor failures;
    * a line whose file has no known schema fails with ``unknown_schema``;
    * a line read twice is judged twice; each ``line_id`` keeps its own verdict;
    * other columns of the input are dropped unless named in ``keep``;
    * an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?"
BLANKS = r"[ \t]*+"
WHITE = r"\p{IsWhite_Space}"
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
CSV_FIELD = rf'{BLANKS}(?:{QUOTED}{BLANKS}|[^",]*+)'
CSV_VALUE = rf'{BLANKS}(?:"{NUMBER}"|{NUMBER}){BLANKS}'
#: A field with at least one character that is no white space.
CSV_TERM = rf'{BLANKS}(?:"{WHITE}*+(?:""|[^"{WHITE}])[^"]*+(?:""[^"]*+)*+"{BLANKS}|{WHITE}*+[^",{WHITE}][^",]*+)'
CSV_STRUCTURE = rf"\A{CSV_FIELD}(?:,{CSV_FIELD})*+\z"
SPACED_FIELD = r"[^ \t]++"
SPACED_TERM = rf"(?:(?![ \t]){WHITE})*+[^ \t{WHITE}][^ \t]*+"
#: What a decimal beyond the float range holds at least: an exponent or 39 digits in a row.
LARGE = r"[eE]|[0-9]{39}"
#: Prefixes that are tried at a time.
STRIDE = 8

REASONS = ("broken_quoting", "too_few_columns", "too_many_columns", "missing_term", "bad_value")


@dataclass(frozen=True)
class LineSchema:
    """``fmt`` is ``glove`` (white-space separated) or ``csv``; a row holds 1 + ``dimensions`` fields."""

    fmt: str
    dimensions: int

    def __post_init__(self) -> None:
        if self.fmt not in ("glove", "csv") or self.dimensions < 1:
            raise ValueError(f"no such line schema: {self}")

    def _pattern(self, values: bool, more: int, end: str) -> str:
        """A term and ``more`` values, or as many fields of any content."""
        if self.fmt == "csv":
            return rf"\A{CSV_TERM if values else CSV_FIELD}(?:,{CSV_VALUE if values else CSV_FIELD}){{{more}}}(?:{end})"
        return rf"\A{SPACED_TERM if values else SPACED_FIELD}(?:[ \t]++{NUMBER if values else SPACED_FIELD}){{{more}}}(?:{end})"

    @property
    def whole(self) -> str:
        """The anchored pattern of a whole trimmed row."""
        return self._pattern(True, self.dimensions, r"\z")

    @property
    def columns(self) -> str:
        """The pattern of a row of 1 + ``dimensions`` well-formed fields."""
        return self._pattern(False, self.dimensions, r"\z")

    def prefix(self, fields: int, values: bool = True) -> str:
        """The pattern of a row's first ``fields`` fields: the term, then values; or well-formed fields of any content."""
        return self._pattern(values, fields - 1, r",|\z" if self.fmt == "csv" else r"[ \t]|\z")

    def prefixes(self, values: bool) -> list[str]:
        return [self.prefix(n, values) for n in range(1, self.dimensions + 2)]


def _first_broken(line: Column, prefixes: list[str]) -> Column:
    """The number of the first field whose prefix does not match, from 0; as many as there are prefixes if all do."""

    def walk(a: int, b: int, last: int) -> Column:
        """Among prefixes a to b; ``last`` if they all match."""
        out = F
        for i in range(a, b):
            out = out.when(~line.rlike(prefixes[i]), F.lit(i))
        return out.otherwise(F.lit(last)) if isinstance(out, Column) else F.lit(last)

    out, n = F, len(prefixes)
    for a in range(0, n - STRIDE + 1, STRIDE):
        gate = a + STRIDE - 1
        out = out.when(~line.rlike(prefixes[gate]), walk(a, gate, gate))
    rest = walk(n - n % STRIDE, n, n)
    return out.otherwise(rest) if isinstance(out, Column) else rest


def _fields(line: Column, csv: bool) -> Column:
    if csv:
        # with a comma ahead no match is empty, so an empty first field is not passed over
        return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({CSV_FIELD})"), F.lit(1))
    return F.split(line, r"[ \t]+")


def _plain(field: Column) -> Column:
    """A csv field without its blanks and enclosing quotes."""
    bare = F.btrim(field, F.lit(" \t"))
    return F.when(
        bare.startswith('"'), F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(bare)


def _values(line: Column, csv: Column) -> Column:
    """The values of a row of the right columns; null where no number."""
    fields = F.when(csv, _fields(line, True)).otherwise(_fields(line, False))
    return F.transform(F.slice(fields, F.lit(2), F.size(fields) - 1), lambda x: F.btrim(x, F.lit(' \t"')).try_cast("float"))


def _behind(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is worked out once: behind a generator of one row for one, which no filter passes."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def judge(lines: DataFrame, schemas: list[LineSchema], line: str = "line", fmt: str = "format", dimensions: str = "dimensions") -> DataFrame:
    """``lines`` with ``_reason`` (null where valid), ``_broken_field`` and the trimmed line ``_line``.

    Null and blank lines are left out. ``_broken_field`` counts from 0, the term; 1 + dimensions is the first field too many.
    """
    trimmed = F.btrim(F.col(line), F.lit(" \t\r"))
    rows = lines.withColumn("_line", trimmed).filter(F.col("_line").isNotNull() & (F.col("_line") != ""))
    at, csv = F.col("_line"), F.col(fmt) == "csv"

    def by_schema(make, without) -> Column:
        out = F
        for s in schemas:
            out = out.when((F.col(fmt) == s.fmt) & (F.col(dimensions) == s.dimensions), make(s))
        return out.otherwise(without) if isinstance(out, Column) else without

    beyond = at.rlike(LARGE) & F.exists(_values(at, csv), lambda v: F.abs(v) == float("inf"))

    def fault(s: LineSchema) -> Column:
        """What a row is refused for, broadly; null for a valid one."""
        structure = F.when(at.rlike(CSV_STRUCTURE), "columns").otherwise("quoting") if s.fmt == "csv" else F.lit("columns")
        return F.when(at.rlike(s.whole), F.when(beyond, "range")).when(at.rlike(s.columns), "value").otherwise(structure)

    rows = _behind(rows, "_fault", by_schema(fault, F.lit("schema")))
    kind = F.col("_fault")

    def broken(s: LineSchema) -> Column:
        return F.when(kind == "value", _first_broken(at, s.prefixes(True))).otherwise(_first_broken(at, s.prefixes(False)))

    overflow = F.array_min(F.transform(_values(at, csv), lambda v, i: F.when(F.abs(v) == float("inf"), i + 1)))
    first = F.when(kind.isNull() | (kind == "schema"), F.lit(None).cast("int")).when(kind == "range", overflow).otherwise(by_schema(broken, F.lit(None).cast("int")))
    rows = _behind(rows, "_broken_field", first)
    field = F.col("_broken_field")
    reason = (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind == "schema", "unknown_schema")
        .when(kind == "quoting", "broken_quoting")
        .when(field > F.col(dimensions), "too_many_columns")
        .when(kind == "columns", "too_few_columns")
        .when(field == 0, "missing_term")
        .otherwise("bad_value")
    )
    return rows.withColumn("_reason", reason)


def line_schemas(files: DataFrame, most: int = 1000) -> list[LineSchema]:
    """The distinct schemas of a file table; more than ``most`` is an error, as each becomes patterns in the plan."""
    rows = files.select("format", "dimensions").where("format in ('glove', 'csv') and dimensions > 0").distinct().orderBy("format", "dimensions").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} line schemas")
    return [LineSchema(r["format"], int(r["dimensions"])) for r in rows]


def judged_lines(lines: DataFrame, files: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Raw lines joined with their file's schema and judged. The file table is broadcast only while small."""
    small = files.select(F.col("file_no"), F.col("format"), F.col("dimensions")).dropDuplicates(["file_no"])
    if files.limit(broadcast_rows + 1).count() <= broadcast_rows:
        small = F.broadcast(small)
    source = lines.select("line_id", "file_no", "line_no", "line")
    return judge(source.join(small, "file_no", "left"), line_schemas(files))


def load_lines(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failing rows): the two halves of one judgement.

    Valid: ``line_id, file_no, line_no, term, vector``. Failing: ``line_id, file_no, line_no, reason, broken_field``.
    """
    judged = judged_lines(lines, files)
    at, csv = F.col("_line"), F.col("format") == "csv"
    first = F.when(csv, _plain(F.get(_fields(at, True), F.lit(0)))).otherwise(F.get(_fields(at, False), F.lit(0)))
    valid = judged.where("_fault is null").select("line_id", "file_no", "line_no", first.alias("term"), _values(at, csv).alias("vector"))
    failing = judged.where("_fault is not null").select("line_id", "file_no", "line_no", F.col("_reason").alias("reason"), F.col("_broken_field").alias("broken_field"))
    return valid, failing


def first_broken_field(schema: LineSchema, line: str, values: bool = True) -> int:
    """The same walk over one line in Python, for tests and interactive use."""
    import regex

    text = line.strip(" \t\r")
    for i, pattern in enumerate(schema.prefixes(values)):
        if not regex.match(pattern.replace(r"\z", r"\Z").replace("IsWhite_Space", "White_Space"), text):
            return i
    return schema.dimensions + 1
