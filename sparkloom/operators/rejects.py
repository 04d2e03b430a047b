"""Rows that fail to parse, with the reason, while the rest load.

Lines are read permissively under an explicit schema that keeps the corrupt text. A line that was read
well takes its casts from the record. Lines are reclassified over the raw text, by quoting, by the number of
fields and by casts, when the reader kept them as corrupt or may have read them otherwise than meant: it lets
stray quotes and an empty line pass, ends a record at its own separator (U+001E here, so that line breaks are plain characters)
and refuses very many fields. All of it is built-in expressions, without a shuffle.

Defined results: a null line is no record and no case; an empty line is one empty field; null and
blank values are no faults; very long lines are read whole (the patterns are possessive, so they
neither backtrack nor recurse).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_WHOLE_QUOTED = r"(?:(?<=,)|\A)" + _QUOTED + r"(?=,|\z)"
_INT_MAX = "2147483647"


@dataclass(frozen=True)
class Layout:
    """The columns of a kind of extract and what must hold of some of them."""

    columns: tuple[str, ...]
    integers: tuple[str, ...] = ()
    decimals: tuple[str, ...] = ()


def bad_integer(c: Column) -> Column:
    """Neither null nor blank, and not digits 0-9 up to 2147483647."""
    t = F.trim(c)
    digits = F.regexp_replace(t, r"\A0++(?=[0-9])", "")
    fits = (F.length(digits) < 10) | ((F.length(digits) == 10) & (digits <= _INT_MAX))
    return F.coalesce((t != "") & ~(t.rlike(r"\A[0-9]++\z") & fits), F.lit(False))


def bad_decimal(c: Column) -> Column:
    """Neither null nor blank, and not digits 0-9 with at most one point between digits."""
    t = F.trim(c)
    return F.coalesce((t != "") & ~t.rlike(r"\A[0-9]++(?:\.[0-9]++)?\z"), F.lit(False))


def _unquoted(field: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(field, r'\A"|"\z', ""), '""', '"')
    return F.when(field.startswith('"'), inner).otherwise(field)


def _field(line: Column, k: int) -> Column:
    """Field k of a line whose quoting holds."""
    one = rf'(?:{_QUOTED}|[^,"]*+)'
    return _unquoted(F.regexp_extract(line, rf"\A(?:{one},){{{k}}}({one})(?:,|\z)", 1))


_SEPARATOR = "\u001e"
_MOST_FIELDS = 20_000  # the reader's own limit is a little higher


def _read(text: Column, layout: Layout) -> Column:
    schema = StructType([StructField(c, StringType()) for c in layout.columns] + [StructField("_corrupt", StringType())])
    return F.from_csv(text, schema.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "lineSep": _SEPARATOR, "maxCharsPerColumn": "-1"})


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are evaluated once: neither projections nor filters above are merged into a generator."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("__sl_once")
    return df.select(*kept, one).select(*kept, "__sl_once.*")


def classify_lines(df: DataFrame, line: str, kind: str, layouts: dict[str, Layout]) -> DataFrame:
    """df with `read_<kind>` (the permissive reading), `corrupt` and `reason`; reason is null for good lines.

    Lines of a kind without a layout are no cases and get no record. Columns already called like
    the new ones are replaced.
    """
    text = F.col(line)
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    wide = commas >= _MOST_FIELDS
    reads = _once(df, {f"read_{name}": F.when((F.col(kind) == name) & ~wide, _read(text, layout)) for name, layout in layouts.items()})

    def by_kind(each) -> Column:  # noqa: ANN001
        out = F.lit(None)
        for name, layout in layouts.items():
            out = F.when(F.col(kind) == name, each(layout, F.col(f"read_{name}"))).otherwise(out)
        return out

    corrupt = by_kind(lambda layout, record: record["_corrupt"]).cast("string")
    doubtful = wide | corrupt.isNotNull() | text.contains('"') | text.contains(_SEPARATOR) | (text == "")
    bare = F.regexp_replace(text, _WHOLE_QUOTED, "q")
    broken = F.when(bare.contains('"'), "quoting").when(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1 != by_kind(lambda layout, _: F.lit(len(layout.columns))), "columns")
    known = F.col(kind).isin(list(layouts)) & text.isNotNull()
    # One check for the first integer of every kind, one for the second and so on; the same for decimals.
    value = F.lit(False)
    for bad, names in ((bad_integer, "integers"), (bad_decimal, "decimals")):
        for i in range(max(len(getattr(x, names)) for x in layouts.values())):
            has = lambda x, i=i, names=names: getattr(x, names)[i] if i < len(getattr(x, names)) else None
            again = by_kind(lambda x, _, has=has: _field(text, x.columns.index(has(x))) if has(x) else F.lit(None))
            given = by_kind(lambda x, record, has=has: record[has(x)] if has(x) else F.lit(None))
            value = value | bad(F.when(F.col("__sl_doubtful"), again).otherwise(given).cast("string"))
    made = _once(reads, {"corrupt": corrupt, "__sl_doubtful": doubtful})
    return _once(made, {"reason": F.when(known, F.coalesce(F.when(F.col("__sl_doubtful"), broken), F.when(value, "value")))}).drop("__sl_doubtful")


def loaded_records(df: DataFrame, line: str, kind: str, name: str, layout: Layout, keep: list[str]) -> DataFrame:
    """The records of one kind that load: `keep` and every column of the layout, integers and decimals cast, blank texts null."""
    mine = classify_lines(df.where(F.col(kind) == name), line, kind, {name: layout}).where(F.col("reason").isNull() & F.col(line).isNotNull())
    types = dict.fromkeys(layout.integers, "int") | dict.fromkeys(layout.decimals, "double")
    value = lambda c: F.nullif(F.trim(F.col(f"read_{name}.{c}")), F.lit(""))
    return mine.select(*keep, *[(value(c).try_cast(types[c]) if c in types else value(c)).alias(c) for c in layout.columns])


def landed_faults(df: DataFrame, integers: tuple[str, ...] = (), decimals: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a landed table with a value that does not cast, with reason `value`."""
    bad = F.lit(False)
    for c in integers:
        bad = bad | bad_integer(F.col(c))
    for c in decimals:
        bad = bad | bad_decimal(F.col(c))
    return df.where(bad).withColumn("reason", F.lit("value"))
