"""Delimited lines that fail to parse: typed good rows on one side, bad rows with their reasons on the other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from okrug.functions.registry import inn_valid

BLANKS = r"[ \u00a0\u2007\u202f]"
EDGES = r"^[\s\u00a0\u2007\u202f\ufeff]+|[\s\u00a0\u2007\u202f\ufeff]+$"
#: Fields that the reader is asked to take apart; a line with more is corrupt as it stands.
READ_FIELDS = 1_000
AMOUNT = r"^(?:[0-9]+|[0-9]{1,3}(?:[ \u00a0\u2007\u202f][0-9]{3})+)(?:[.,][0-9]{1,2})?$"


def stripped(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, EDGES, "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def iso_text(text: Column) -> Column:
    """yyyy-MM-dd of a text that is written so or as dd.MM.yyyy, else null."""
    s = stripped(text)
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s).when(s.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))


def real_date(iso: Column) -> Column:
    """DATE of yyyy-MM-dd where that is a real day, else null."""
    y, m, d = (F.substring(iso, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= length), F.make_date(y, m, d))


def amount_value(text: Column) -> Column:
    """DECIMAL(38,2) of an unsigned number, plain or in threes parted by single spaces, with at most two decimals; else null."""
    return F.when(text.rlike(AMOUNT), F.translate(without_blanks(text), ",", ".").try_cast("decimal(38,2)"))


@dataclass(frozen=True)
class Check:
    """A column's cast in two steps, `clean` and then `value`, which gives null for a bad text; an empty field is good if `may_be_empty`."""

    column: str
    clean: Callable[[Column], Column]
    value: Callable[[Column], Column]
    may_be_empty: bool


def classify_lines(lines: DataFrame, line: str, columns: list[str], checks: list[Check], delimiter: str = ";") -> DataFrame:
    """`lines` with `fields` STRUCT (the columns as texts), `typed` STRUCT (values of `checks`) and `reasons` ARRAY<STRING>.

    The lines are read permissively under an explicit schema, which keeps the raw text of those that the reader finds corrupt
    (`corrupt`); as the reader forgives much, each line is then classified anew: `quoting` = a quote that neither encloses a
    whole field nor is doubled inside one (delimiters and line breaks may stand inside quotes); else `column_count` = another
    number of fields than columns; else one reason per failed cast, named as the column. A line without reasons is good.

    A line that no reading could bring near the columns, with more than READ_FIELDS fields, isn't read at all: it is corrupt, and has its reason from the
    classification as every other. A null line has no fields and is `column_count`, as is an empty one. Repeated lines are judged each. Other columns pass
    through, but for those named as the four that are added. Works on one line at a time: no shuffle, no limit on its length.
    """
    schema = T.StructType([*[T.StructField(x, T.StringType()) for x in columns], T.StructField("__corrupt", T.StringType())])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", "maxCharsPerColumn": "-1", "nullValue": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    keep = [F.col(x) for x in lines.columns if x not in ("fields", "typed", "reasons", "corrupt")]
    # the texts between quotes: those at even places stand outside of quoted fields
    out = lines.withColumn("__parts", F.split(F.coalesce(F.col(line), F.lit("")), '"', -1))
    size = F.size("__parts")
    outside = F.transform("__parts", lambda x, i: F.when(i % 2 == 0, x))
    stray = F.exists(
        F.transform("__parts", lambda x, i: (i % 2 == 0) & ~F.when(size == 1, F.lit(True)).when(i == 0, (x == "") | x.endswith(delimiter)).when(i == size - 1, (x == "") | x.startswith(delimiter)).otherwise((x == "") | (x.startswith(delimiter) & x.endswith(delimiter)))),
        lambda bad: bad,
    )
    out = out.withColumn("__quoting", (size % 2 == 0) | stray)
    outer = F.array_join(outside, "")
    out = out.withColumn("__count", F.when(F.col(line).isNull(), 0).otherwise(F.length(outer) - F.length(F.replace(outer, F.lit(delimiter), F.lit(""))) + 1))
    sound = ~F.col("__quoting") & (F.col("__count") == len(columns))
    # as a generator, so that the optimizer doesn't read the line once for each column
    text = F.coalesce(F.col(line), F.lit(""))
    # quotes that don't pair may show the reader any delimiter
    fields = F.when(F.col("__quoting"), F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit(""))) + 1).otherwise(F.col("__count"))
    wide = fields > READ_FIELDS
    read = F.from_csv(F.when(wide, F.lit("")).otherwise(text), schema.simpleString(), options)
    out = out.select(*keep, "__quoting", "__count", F.when(wide, F.col(line)).alias("__wide"), F.explode(F.array(read)).alias("__read"))
    out = out.withColumn("fields", F.when(sound, F.struct(*[F.col(f"__read.{x}").alias(x) for x in columns])))
    # step by step, so that no step is evaluated once a digit
    out = out.withColumns({f"__clean_{x.column}": x.clean(F.col(f"fields.{x.column}")) for x in checks})
    out = out.withColumns({f"__value_{x.column}": x.value(F.col(f"__clean_{x.column}")) for x in checks})
    failed = [F.when(F.col(f"__value_{x.column}").isNull() & ~(F.coalesce(F.col(f"fields.{x.column}"), F.lit("")) == "" if x.may_be_empty else F.lit(False)), x.column) for x in checks]
    reasons = F.when(F.col("__quoting"), F.array(F.lit("quoting"))).when(F.col("__count") != len(columns), F.array(F.lit("column_count"))).otherwise(F.array_compact(F.array(*failed)))
    typed = F.when(sound, F.struct(*[F.col(f"__value_{x.column}").alias(x.column) for x in checks]))
    return out.select(*keep, "fields", typed.alias("typed"), reasons.alias("reasons"), F.coalesce("__wide", "__read.__corrupt").alias("corrupt"))


CONTRACT_COLUMNS = ["canonical_contract_id", "contract_number", "sign_date", "law", "amount", "currency", "customer", "customer_inn", "supplier", "supplier_inn", "subject"]
CONTRACT_CHECKS = [
    Check("supplier_inn", without_blanks, lambda digits: F.when(inn_valid(digits), digits), True),
    Check("amount", stripped, amount_value, True),
    Check("sign_date", iso_text, real_date, False),
]


def contract_lines(lines: DataFrame) -> DataFrame:
    """classify_lines() for the contract register's 11 columns."""
    return classify_lines(lines, "line", CONTRACT_COLUMNS, CONTRACT_CHECKS)


def good_contracts(lines: DataFrame) -> DataFrame:
    """The good lines as typed rows."""
    typed = {x.column for x in CONTRACT_CHECKS}
    return contract_lines(lines).where(F.size("reasons") == 0).select("line_id", *[F.col(f"{'typed' if x in typed else 'fields'}.{x}").alias(x) for x in CONTRACT_COLUMNS])
