"""Delimited files: encoding, separator and header of each file are found out, then Spark reads.

A folder may mix files. One pass over all lines tells, per file, its first line, whether every line is valid UTF-8, how many
bytes are zero and how well each separator fits; files of the same kind are then read together and joined by column name. The driver
holds one short row per file, as Spark's own file listing does.

Records with line breaks in quotes are put together in parallel (:func:`records`): files stay split.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveer.functions import quoted
from tallyveer.schema import MALFORMED
from tallyveer.session import stored

SEPARATORS = (",", ";", "\t", "|")
EXTENSIONS = (".csv", ".txt", ".tsv")
#: Byte order marks of encodings whose lines Spark's text reader cannot part.
MARKS = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}
#: Share of zero bytes from which a file without a mark is taken for UTF-16: half of each separator, digit, blank and line break is
#: zero there, and text in one-byte encodings and UTF-8 has none.
ZEROS = 0.02


@dataclass(frozen=True)
class FileFormat:
    """How one file is written; ``agreement`` is the share of its records as wide as its header.

    ``breaks`` tells whether records span lines, from quote to quote.
    """

    encoding: str
    separator: str
    header: tuple[str, ...]
    agreement: float = 1.0
    path: str = ""
    breaks: bool = False


def occurrences(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def separators_in(line: Column, separator: str) -> Column:
    """Separators outside quotes."""
    return occurrences(F.regexp_replace(line, '"[^"]*"', ""), separator)


def profile_lines(lines: DataFrame) -> DataFrame:
    """Per ``file``: its first line, whether all lines are UTF-8, and the lines that fit each separator.

    ``bytes`` and ``zeros`` count bytes and zero bytes, ``odd`` the lines with an odd number of quotes. ``lines`` has columns file, place and
    line (binary). One shuffle of distinct widths; no file is gathered.
    """
    text = F.decode("line", "ISO-8859-1")  # any byte is a character; separators are ASCII
    widths = [separators_in(text, s).alias(f"w{i}") for i, s in enumerate(SEPARATORS)]
    shapes = (
        lines.where(F.length(F.translate(text, "\r", "")) > 0)
        .select("file", "place", "line", *widths, occurrences(text, "\0").alias("zeros"), occurrences(text, '"').alias("quotes"))
        .groupBy("file", *[f"w{i}" for i in range(len(SEPARATORS))])
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("place", "line")).alias("first"),
            F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("valid"),
            F.sum(F.length("line")).alias("bytes"),
            F.sum("zeros").alias("zeros"),
            F.count_if(F.col("quotes") % 2 == 1).alias("odd"),
        )
    )
    head = F.min(F.struct(F.col("first.place"), F.col("first.line"), *[F.col(f"w{i}") for i in range(len(SEPARATORS))]))
    shapes = shapes.withColumn("head", head.over(Window.partitionBy("file")))
    return shapes.groupBy("file").agg(
        F.any_value("head").alias("head"),
        F.bool_and("valid").alias("valid"),
        F.sum("n").alias("lines"),
        *[F.sum(c).alias(c) for c in ("bytes", "zeros", "odd")],
        *[F.sum(F.when(F.col(f"w{i}") == F.col(f"head.w{i}"), F.col("n"))).alias(f"fit{i}") for i in range(len(SEPARATORS))],
    )


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get a running number: ``c, c_1, c_2``; case does not tell names apart."""
    seen: Counter[str] = Counter()
    unique, taken = [], {n.lower() for n in names}
    for name in names:
        n, new = seen[name.lower()], name
        while n and (new := f"{name}_{n}").lower() in taken:
            n += 1
        unique.append(new)
        taken.add(new.lower())
        seen[name.lower()] = n + 1
    return unique


def header_fields(line: str, separator: str) -> list[str]:
    return next(csv.reader(io.StringIO(line.lstrip("﻿").rstrip("\r"), newline=""), delimiter=separator), [])


def text_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Columns file, place and line; places order the lines of a file. Only UTF-16 needs its ``encoding`` here."""
    if encoding:
        reader = spark.read.option("encoding", encoding).option("lineSep", "\n")
        df = reader.csv(path, schema="value string", sep="\u0001", quote="")
        line = F.encode(F.coalesce("value", F.lit("")), "UTF-8")
    else:
        df, line = spark.read.text(path), F.col("value").cast("binary")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), line.alias("line"))


def records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """The records of files with line breaks in quotes: file, place and line, with its breaks.

    A line begins a record if an even number of quotes stands before it in its file. Each split counts its quotes and, for both
    cases, the records that would begin in it; running sums over the splits of a file say which case holds and how many records
    began before. The lines of a split are then joined to records where they are, and only pieces of records that cross from split to
    split meet in a shuffle.
    """
    # UTF-16 as bytes: reading it as values would skip blank lines, which belong to what is quoted
    raw = spark.read.option("encoding", encoding if encoding.startswith("UTF-16") else "UTF-8").text(files, lineSep="\n")
    line = F.col("value").cast("binary")
    paired = F.substring(line, F.lit(1), F.length(line) - F.length(line) % 2)
    text = F.col("value") if encoding == "UTF-8" else F.decode(paired if encoding.startswith("UTF-16") else line, encoding)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        text.alias("text"),
    )
    text = F.col("text")
    lines = lines.select("file", "block", "row", text.alias("text"), (occurrences(text, '"') % 2).alias("odd"))
    split = Window.partitionBy("file", "block")
    earlier = split.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)

    splits = lines.groupBy("file", "block").agg(
        F.sum("odd").alias("odd"), F.count_if(F.col("inside") == 0).alias("even"), F.count_if(F.col("inside") == 1).alias("uneven")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begun = F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("uneven"))
    splits = splits.select("file", "block", "open", begun.alias("begun"), F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("so_far"))

    begins = (F.col("inside") + F.col("open")) % 2 == 0
    here = F.count_if(begins).over(split.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.join(splits, ["file", "block"]).withColumn("number", F.col("so_far") + here)
    pieces = numbered.groupBy("file", "block", "number").agg(
        F.sort_array(F.collect_list(F.struct("row", "text"))).alias("lines"),
        F.any_value(F.col("so_far")).alias("so_far"),
        F.any_value(F.col("begun")).alias("begun"),
    )
    # the first piece may go on what an earlier split began, the last one go on in a later split
    whole = (F.col("number") > F.col("so_far")) & (F.col("number") < F.col("so_far") + F.col("begun"))
    joined = F.array_join(F.col("lines.text"), "\n")
    pieces = stored(pieces.select("file", "block", "number", joined.alias("text"), whole.alias("whole")), "record-pieces")
    crossing = pieces.where("NOT whole").groupBy("file", "number")
    crossing = crossing.agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("pieces"))
    crossing = crossing.select("file", "number", F.array_join(F.col("pieces.text"), "\n").alias("text"))
    out = pieces.where("whole").select("file", "number", "text").union(crossing)
    return out.select(
        "file",
        F.struct(F.lit(0).cast("long").alias("block"), F.col("number").alias("row")).alias("place"),
        F.col("text").cast("binary").alias("line"),
    )


def _format(row, encoding: str, breaks: bool = False) -> FileFormat:
    """Separator that fits most lines, the widest of equals, and the header under it."""
    plain = encoding if not (breaks or encoding.startswith("UTF-16")) else "UTF-8"
    line = bytes(row["head"]["line"]).decode(plain, errors="replace")
    rated = []
    for i, separator in enumerate(SEPARATORS):
        fields, wide = header_fields(line, separator), row["head"][f"w{i}"] > 0
        rated.append((row[f"fit{i}"] / row["lines"] if wide else 0.0, len(fields) if wide else 0, -i, separator, fields))
    share, width, _, separator, fields = max(rated, key=lambda r: r[:3])
    if not width:  # one column: no separator occurs in the header
        share = row["fit0"] / row["lines"]
    return FileFormat(encoding, separator, tuple(unique_names(fields)), share, unquote(row["file"]), breaks)


def encoding_of(row) -> str:
    """UTF-16 by its mark, or by zero bytes and where they stand in the first line; UTF-8 if every line is valid, else ISO-8859-1.

    ISO-8859-1 accepts any byte and so also stands for cp1252.
    """
    line = bytes(row["head"]["line"])
    if line[:2] in MARKS:
        return MARKS[line[:2]]
    if row["zeros"] >= ZEROS * row["bytes"]:
        return "UTF-16LE" if line[1::2].count(0) > line[0::2].count(0) else "UTF-16BE"
    return "UTF-8" if row["valid"] else "ISO-8859-1"


def inspect_files(spark: SparkSession, path: str, breaks: bool | None = None) -> list[FileFormat]:
    """The format of each file under ``path``.

    A file with an odd number of quotes in some line is looked at once more with its quotes taken as going on to the next line, and
    read so if no more records miss the header then than lines do (``breaks`` settles it without a look).
    """
    found, wide, odd = [], {}, {}
    for row in profile_lines(text_lines(spark, path)).collect():
        encoding = encoding_of(row)
        if encoding.startswith("UTF-16"):
            wide.setdefault(encoding, []).append(unquote(row["file"]))
        else:
            found.append((row, encoding))
    for encoding, files in wide.items():
        found += [(row, encoding) for row in profile_lines(text_lines(spark, files, encoding)).collect()]
    if not found:
        raise ValueError(f"{path} holds no data")
    formats, missing = {}, {}
    for row, encoding in found:
        f = _format(row, encoding)
        formats[f.path], missing[f.path] = f, (1 - f.agreement) * row["lines"]
        if row["odd"] and breaks is not False:
            odd.setdefault(encoding, []).append(unquote(row["file"]))
    for encoding, files in odd.items():
        for row in profile_lines(records(spark, files, encoding)).collect():
            other = _format(row, encoding, True)
            if breaks or (1 - other.agreement) * row["lines"] <= missing[other.path] + 0.5:
                formats[other.path] = other
    return [formats[file] for file in sorted(formats)]


def inspect(spark: SparkSession, path: str) -> FileFormat:
    """The format of a single file, or of the first file of a folder."""
    return inspect_files(spark, path)[0]


def read_delimited(spark: SparkSession, path: str, multi_line: bool | None = None, least_agreement: float = 0.5) -> DataFrame:
    """All columns as strings, under the files' own (de-duplicated) names, joined by name.

    Rows with too few or too many fields keep what fits and their whole text in ``_malformed``. A file in which fewer than
    ``least_agreement`` of the records are as wide as its header is refused: it is not a table with that separator. Whether quotes hold line
    breaks is found out per file; ``multi_line`` settles it.
    """
    kinds: dict[tuple, list[str]] = {}
    for f in inspect_files(spark, path, multi_line):
        if f.agreement < least_agreement:
            raise ValueError(f"{f.path}: only {f.agreement:.0%} of the lines have the header's {len(f.header)} fields")
        kinds.setdefault((f.encoding, f.separator, f.header, f.breaks), []).append(f.path)
    parts = [_read(spark, files, *kind) for kind, files in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[quoted(c) for c in out.columns if c != MALFORMED], MALFORMED)


def _read(
    spark: SparkSession, files: list[str], encoding: str, separator: str, header: tuple[str, ...], breaks: bool
) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*header, MALFORMED)])
    options = {
        "sep": separator,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": MALFORMED,
        "columnPruning": "false",  # else a row is only as wide as the columns asked for
        "escape": '"',
    }
    if breaks:
        return _parsed(records(spark, files, encoding), schema, options)
    reader = spark.read.schema(schema).options(**options, header=True, encoding=encoding)
    if encoding.startswith("UTF-16"):
        reader = reader.option("lineSep", "\n")
    return reader.csv(files)


def _parsed(found: DataFrame, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The fields of records; the first record of a file that is not blank is its header."""
    text = F.regexp_replace(F.col("line").cast("string"), "\r$", "")
    found = found.select("file", "place.row", text.alias("text")).where(F.length(F.trim("text")) > 0)
    heads = found.groupBy("file").agg(F.min("row").alias("head"))
    rows = found.join(heads, "file").where(F.col("row") > F.col("head"))
    # a CSV record is read as one value; multiLine leaves the breaks in it as they are
    fields = F.from_csv("text", _ddl(schema), options | {"multiLine": "true"})
    return rows.select(fields.alias("fields")).select("fields.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema.fields)
