"""Turn a raw table of strings into the canonical fact."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveer.functions import quoted
from tallyveer.operators.order import numbered
from tallyveer.schema import (
    CATEGORICALS,
    FACT_COLUMNS,
    FACT_SCHEMA,
    MALFORMED,
    MONEY,
    NUMERICS,
    REDUCED_DIMENSIONS,
    REDUCED_MEASURES,
    UNKNOWN,
    alias_lookup,
)

#: Spellings per canonical column.
Aliases = Mapping[str, Sequence[str]] | None


def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def canonical_names(columns: Sequence[str], aliases: Aliases = None) -> list[str]:
    """Name of each column after mapping, different from one another whatever their case.

    ``aliases`` are a user's own spellings per canonical column, beside the known ones and before them.

    A column spelled like the canonical name takes it before any alias, then the first alias does. Others keep their own
    name, with a running number where it would collide.
    """
    own = {c: [normalise_name(n) for n in names] for c, names in (aliases or {}).items()}
    lookup, given = alias_lookup(own), {}
    normal = [normalise_name(c) for c in columns]
    for exact in (True, False):
        for i, name in enumerate(normal):
            target = name if name in FACT_COLUMNS else lookup.get(name)
            if target and (name == target or not exact) and target not in given:
                given[target] = i
    place = {i: target for target, i in given.items()}
    taken = set(given)
    names = []
    for i, column in enumerate(columns):
        name, n = place.get(i), 0
        if name is None:
            name = column
            while name.lower() in taken:
                n += 1
                name = f"{column}_{n}"
            taken.add(name.lower())
        names.append(name)
    return names


def map_columns(df: DataFrame, aliases: Aliases = None) -> DataFrame:
    """Rename known spellings to canonical names; columns that lose a name keep their own."""
    return df.toDF(*canonical_names(df.columns, aliases))


def unmapped_aliases(columns: Sequence[str]) -> list[str]:
    """Columns that lost their canonical name to another column."""
    lookup = alias_lookup()
    return [
        column
        for column, name in zip(columns, canonical_names(columns), strict=True)
        if (lookup.get(normalise_name(column)) or normalise_name(column)) in FACT_COLUMNS and name not in FACT_COLUMNS
    ]


#: Months as dates are written.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?\s*(?:[AaPp][Mm])?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
NAME = r"([A-Za-z]{3})[a-z]*\.?"

SEPARATORS = ("-", "/", ".")
#: Shapes of dates. A look at the first characters tells which one a text can have, so one pattern is tried.
YEAR_FIRST = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){TIME}$"
EIGHT_DIGITS = r"^((?:19|20)\d{2})(\d{2})(\d{2})$"
NAME_FIRST = rf"^{NAME}[-/ ](\d{{1,2}})[-/ ,]+(\d{{4}}){TIME}$"
NUMBER_FIRST = rf"^(\d{{1,2}})(?:([-/.])(\d{{1,2}})([-/.])(\d{{4}}|\d{{2}})|[-/ ]{NAME}[-/ ,]+(\d{{4}})){TIME}$"
#: Parts the fields of a date; texts that hold it are no dates.
BREAK = "\x01"

#: How a column writes numbers parted by slashes or dashes, month before day (``m/d``) or day before month (``d/m``).
MONTH_FIRST, DAY_FIRST = "month_first", "day_first"
#: The order of a column whose dates can all be read both ways, or in which as many can only be read the one way as the other.
DEFAULT_ORDER = MONTH_FIRST


def date_fields(value: Column) -> Column:
    """What stands where in a text that may be a date: its kind, then the groups of the kind's pattern.

    Kinds are ``y`` (year, month, day), ``n`` (name, day, year) and ``d`` (first number, separators, second number, year; or name and year).
    Other texts are returned as they are, as the only field.
    """
    text = F.trim(value.cast("string"))
    second, third, fifth = (F.substring(text, i, 1) for i in (2, 3, 5))
    parting = (*SEPARATORS, " ")

    def read(pattern: str, *groups: str) -> Column:
        return F.regexp_replace(text, pattern, BREAK.join(groups))

    found = (
        F.when(second.isin(*parting) | third.isin(*parting), read(NUMBER_FIRST, "d", "$1", "$2$4", "$3", "$5", "$6", "$7"))
        .when(fifth.isin(*SEPARATORS), read(YEAR_FIRST, "y", "$1", "$2", "$3"))
        .when(F.length(text) == 8, read(EIGHT_DIGITS, "y", "$1", "$2", "$3"))
        .otherwise(read(NAME_FIRST, "n", "$1", "$2", "$3"))
    )
    return F.split(found, BREAK)


def _field(f: Column, i: int) -> Column:
    return F.get(f, F.lit(i))


def _one_way(f: Column) -> tuple[Column, Column]:
    """Whether two numbers of a date can only be day and month, or only month and day."""
    # compared as text of two digits: a cast that fails costs an exception inside
    a, b = (F.lpad(_field(f, i), 2, "0") for i in (1, 3))
    free = (_field(f, 0) == "d") & (_field(f, 5) == "") & ~F.contains(_field(f, 2), F.lit("."))
    return (
        free & a.between("13", "31") & b.between("01", "12"),
        free & b.between("13", "31") & a.between("01", "12"),
    )


def _read_date(f: Column, day_first: Column) -> Column:
    """The date of the fields ``f``. Dots and the only possible reading come before the column's order."""
    numbers = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS, 1) for x in (name, str(i))])
    kind, one, two, three = (_field(f, i) for i in range(4))
    only_day, only_month = _one_way(f)
    first_is_day = F.contains(two, F.lit(".")) | only_day | (day_first & ~only_month)
    last = _field(f, 4)
    year = F.when(F.length(last) == 4, last).otherwise(F.concat(F.when(last <= "68", "20").otherwise("19"), last))

    def iso(y: Column, m: Column, d: Column) -> Column:
        return F.concat(y, F.lit("-"), m, F.lit("-"), d)

    def month(name: Column) -> Column:
        return F.try_element_at(numbers, F.lower(name))

    shape = (
        F.when(kind == "y", iso(one, two, three))
        .when(kind == "n", iso(three, month(one), two))
        .when((kind == "d") & (_field(f, 5) != ""), iso(_field(f, 6), month(_field(f, 5)), one))
        .when(kind == "d", iso(year, F.when(first_is_day, three).otherwise(one), F.when(first_is_day, one).otherwise(three)))
    )
    return shape.try_cast("date")


def _plain_date(text: Column) -> Column:
    """The date of the shape that most columns have, which needs no pattern."""
    plain = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return F.when(plain, text.try_cast("date"))


def parse_date(value: Column, order: str | Column = DEFAULT_ORDER) -> Column:
    """The date a text shows, as written (a zone does not move it); null for anything else.

    ``order`` tells how two numbers parted by slashes or dashes are read where both readings are dates: see
    :func:`date_order` for the order of a column. Parted by dots, the day comes first. Two-digit years up to 68 belong to this century.
    Numbers are not dates, but for eight digits that spell one.
    """
    day_first = F.lit(order) == DAY_FIRST if isinstance(order, str) else order == DAY_FIRST
    return F.coalesce(_plain_date(value.cast("string")), _read_apart(date_fields(value), day_first))


def _read_apart(f: Column, day_first: Column) -> Column:
    """:func:`_read_date` as a lambda, so that its branches do not swell the generated code beyond what the JVM compiles."""
    parts = F.array(F.struct(f.alias("f"), day_first.alias("day_first")))
    return F.get(F.transform(parts, lambda x: _read_date(x["f"], x["day_first"])), 0)


def way_of(f: Column) -> Column:
    """``d`` for a date that can only be read day first, ``m`` for one that can only be read month first, else null."""
    day, month = _one_way(f)
    return F.when(day, "d").when(month, "m")


def with_fields(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the fields of a date column of text, null where its text is a plain date."""
    plain = _plain_date(quoted(column)).isNotNull()
    return df.withColumn(into, F.when(~plain, date_fields(quoted(column))))


def order_votes(value: Column) -> tuple[Column, Column]:
    """Aggregates over a column of ways: values that can only be read day first, and only month first."""
    return F.count_if(value == "d"), F.count_if(value == "m")


def order_of(day: Column, month: Column) -> Column:
    """The order of a column with so many values of one reading only: that of more of them, else the default."""
    return F.when(day > month, DAY_FIRST).when(day < month, MONTH_FIRST).otherwise(DEFAULT_ORDER)


def date_order(df: DataFrame, column: str) -> Column:
    """How a column of text writes its dates, as one value for the whole column: a pass over that column."""
    day, month = order_votes(F.col("way"))
    ways = with_fields(df.select(quoted(column)), column, "_f").select(way_of(F.col("_f")).alias("way"))
    votes = ways.agg(day.alias("day"), month.alias("month"))
    return votes.select(order_of(F.col("day"), F.col("month")).alias("order")).scalar()


def with_date(df: DataFrame, column: str, into: str, order: str | None = None) -> DataFrame:
    """``df`` with the date of ``column`` in ``into``; text is read in one ``order``, the column's own if none is given."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return df.withColumn(into, quoted(column))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(into, quoted(column).cast("date"))
    if not isinstance(kind, T.StringType):
        return df.withColumn(into, parse_date(quoted(column)))
    return read_fields(with_fields(df, column, "_f"), df, column, into, order).drop("_f")


def read_fields(fielded: DataFrame, df: DataFrame, column: str, into: str, order: str | None = None) -> DataFrame:
    """As :func:`with_date` on top of the fields in ``_f``; ``df`` is where the column's order is looked up."""
    known = fielded.withColumn("_order", F.lit(order) if order else date_order(df, column))
    read = _read_apart(F.col("_f"), F.col("_order") == DAY_FIRST)
    return known.withColumn(into, F.coalesce(_plain_date(quoted(column)), read)).drop("_order")


def text_columns(df: DataFrame) -> list[str]:
    """Columns of text that belong to the data."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != MALFORMED]


def looks_like_date(name: str) -> Column:
    """A date that is more than a number: digits alone do not make a column one of dates."""
    return parse_date(quoted(name)).isNotNull() & ~F.trim(quoted(name)).rlike("^[0-9]+$")


def date_candidates(df: DataFrame) -> DataFrame:
    """Share of values that are dates, over all rows, for each text column: one pass, one row per column."""
    names = text_columns(df)
    if not names:
        raise ValueError("no text column to look for dates in")
    rates = df.agg(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                F.try_divide(
                    F.count_if(looks_like_date(name)).cast("double"), F.count(quoted(name))
                ).alias("parse_rate"),
            ).alias(f"c{i}")
            for i, name in enumerate(names)
        ]
    )
    return rates.select(F.inline(F.array(*[f"c{i}" for i in range(len(names))])))


DATE_RATE = 0.6


def find_date_column(df: DataFrame, threshold: float = DATE_RATE) -> DataFrame:
    """Rename the first column that looks like dates to ``date``."""
    if "date" in df.columns:
        return df
    typed = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    if typed:
        return df.withColumnRenamed(typed[0], "date")
    if not text_columns(df):
        return df
    found = (
        date_candidates(df)
        .filter(F.col("parse_rate") >= threshold)
        .agg(F.min_by("column", "position"))
        .first()[0]
    )
    return df if found is None else df.withColumnRenamed(found, "date")


def assign_sequential_dates(
    df: DataFrame, order_by: Sequence[str], anchor: dt.date, rows: int | None = None
) -> DataFrame:
    """Give undated rows consecutive days ending at ``anchor``, in ``order_by`` order.

    ``order_by`` must identify rows.
    """
    total = df.agg(F.count(F.lit(1))).scalar() if rows is None else F.lit(rows)
    placed = numbered(df, [], [quoted(c) for c in order_by], "_n")
    back = (total - F.col("_n")).cast("int")
    return placed.withColumn("date", F.date_sub(F.lit(anchor), back)).select(
        "date", *[quoted(c) for c in df.columns if c != "date"]
    )


def numeric_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of each column in one pass; one row comes back."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[i] if row[i] is not None else float("-inf")) for i, c in enumerate(columns)}


def ensure_measures(df: DataFrame, means: dict[str, float | None] | None = None) -> DataFrame:
    """Promote numeric columns to missing ``revenue`` and ``orders``.

    The column with the highest mean (known ones may be given) becomes revenue, the first one left becomes orders; without
    any, every row counts 1.
    """
    reserved = set(NUMERICS)
    free = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in reserved
    ]
    if "revenue" not in df.columns:
        if free:
            known = numeric_means(df, free) if means is None else means
            best = max(free, key=lambda c: float("-inf") if known[c] is None else known[c])
            free.remove(best)
            df = df.withColumnRenamed(best, "revenue")
        else:
            df = df.withColumn("revenue", F.lit(1.0))
    if "orders" not in df.columns:
        if free:
            df = df.withColumnRenamed(free[0], "orders")
        else:
            df = df.withColumn("orders", F.lit(1.0))
    return df


def add_missing_columns(df: DataFrame) -> DataFrame:
    """Canonical columns the table lacks, as typed nulls."""
    return df.withColumns(
        {
            f.name: F.lit(None).cast(f.dataType)
            for f in FACT_SCHEMA.fields
            if f.name not in df.columns
        }
    )


def missing_columns(df: DataFrame) -> DataFrame:
    """Canonical columns the table lacks, one row each."""
    absent = [c for c in FACT_COLUMNS if c not in df.columns]
    return df.sparkSession.createDataFrame([(c,) for c in sorted(absent)], "missing string")


def unfilled_columns(df: DataFrame) -> DataFrame:
    """Required columns without a single value: absent ones and those that are all null.

    The values of all columns are counted in one pass; the columns that hold
    some are then taken from the required ones.
    """
    full = add_missing_columns(df)
    counts = full.agg(*[F.count(c).alias(c) for c in FACT_COLUMNS])
    held = counts.unpivot([], list(FACT_COLUMNS), "column", "n")
    return held.select("column").exceptAll(held.filter(F.col("n") > 0).select("column"))


#: Numbers from here on do not fit the exact sums.
TOO_LARGE = 1e14


def number_in(df: DataFrame, name: str) -> Column:
    """Number of a cell, null unless it is one: finite, written as a number, and within the exact sums' range.

    The cast also takes what programs write, such as ``12d``, ``0x1p3`` and ``Infinity``: no user's cell means a number by these.
    """
    value, written = quoted(name), F.lit(True)
    if isinstance(df.schema[name].dataType, T.StringType):
        value = F.trim(value)
        written = ~F.lower(F.right(value, F.lit(1))).isin("d", "f") & ~F.contains(F.lower(value), F.lit("x"))
        # a cast that fails costs an exception inside: leave out what does not begin like a number
        value = F.when(F.substring(value, 1, 1).isin(*"0123456789+-."), value)
    number = value.try_cast("double")
    return F.when((F.abs(number) < TOO_LARGE) & written, number)  # not so for NaN


def repair(df: DataFrame, order: str | None = None) -> DataFrame:
    """Canonical fact: dates parsed, numbers coerced, gaps filled, other columns dropped.

    A column of text dates is read in one order, ``order`` or the one its values show.
    """
    full = add_missing_columns(df)
    text = isinstance(full.schema["date"].dataType, T.StringType)
    dated = with_date(full, "date", "_day", order)
    # the row number keeps the parsing below the filter, where it would be done again
    day = F.when(F.monotonically_increasing_id() >= 0, F.col("_day")) if text else F.col("_day")
    return (
        dated.withColumn("date", day)
        .filter(F.col("date").isNotNull())
        .withColumns({c: F.coalesce(number_in(full, c), F.lit(0.0)) for c in NUMERICS})
        .withColumns({c: F.col(c).cast("string") for c in CATEGORICALS})
        .na.fill(UNKNOWN, list(CATEGORICALS))
        .select(*FACT_COLUMNS)
    )


def repair_reduced(df: DataFrame) -> DataFrame:
    """The seven-column profile of :func:`repair`."""
    return repair(df).select(*REDUCED_DIMENSIONS, *REDUCED_MEASURES)


def quality_columns(df: DataFrame) -> dict[str, Column]:
    """Counters over a raw table with its parsed date in ``_day``."""
    full, day = set(df.columns), F.col("_day")
    kept = day.isNotNull()
    counters = {
        "input_rows": F.count(F.lit(1)),
        "dropped_rows": F.count_if(~kept),
        "kept_rows": F.count_if(kept),
        "first_date": F.min(day),
        "last_date": F.max(day),
    }
    if "date" in full and isinstance(df.schema["date"].dataType, T.StringType):
        only_day, only_month = order_votes(F.col("_way"))
        counters["day_first_dates"], counters["month_first_dates"] = only_day, only_month
        counters["contradicted_dates"] = F.least(only_day, only_month)
    if MALFORMED in full:
        counters["malformed_rows"] = F.count(quoted(MALFORMED))
    for c in NUMERICS:
        if c in full:
            counters[f"coerced_{c}"] = F.count_if(kept & quoted(c).isNotNull() & number_in(df, c).isNull())
            counters[f"null_{c}"] = F.count_if(kept & quoted(c).isNull())
    for c in CATEGORICALS:
        if c in full:
            counters[f"filled_{c}"] = F.count_if(kept & quoted(c).isNull())
    if "revenue" in full:
        counters["total_revenue"] = F.sum(
            F.when(kept, F.coalesce(number_in(df, "revenue"), F.lit(0.0))).cast(MONEY)
        )
    return counters


def with_parsed_day(df: DataFrame) -> DataFrame:
    """Read the date once, for all counters to use: ``_day``, and ``_way`` of a text that can be read in one order only."""
    if "date" not in df.columns:
        return df.withColumn("_day", F.lit(None).cast("date"))
    if not isinstance(df.schema["date"].dataType, T.StringType):
        return with_date(df, "date", "_day")
    fielded = with_fields(df, "date", "_f")
    return read_fields(fielded.withColumn("_way", way_of(F.col("_f"))), df, "date", "_day").drop("_f")


def quality_report(df: DataFrame) -> DataFrame:
    """One row of data-quality counters; a value counts as coerced only if text was lost."""
    counters = quality_columns(df)
    return with_parsed_day(df).agg(*[expr.alias(name) for name, expr in counters.items()])


def observe_quality(df: DataFrame, observation) -> DataFrame:
    """Collect the same counters while another action runs over ``df``."""
    counters = quality_columns(df)
    observed = with_parsed_day(df).observe(
        observation, *[expr.alias(name) for name, expr in counters.items()]
    )
    return observed.drop("_day", "_way")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail early on an empty table."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def flag_holidays(fact: DataFrame, holidays: Sequence[tuple[int, int]]) -> DataFrame:
    """A fact whose source has no holidays of its own gets the days of a user's calendar."""
    return fact.withColumn("holiday_flag", holiday_flag(F.col("date"), holidays))


def holiday_flag(date: Column, holidays: Sequence[tuple[int, int]]) -> Column:
    """1.0 on the given (month, day) pairs."""
    code = F.month(date) * 100 + F.dayofmonth(date)
    return code.isin([m * 100 + d for m, d in holidays]).cast("double")
