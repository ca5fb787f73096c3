"""Reading dates and times of unknown layout as one instant, in JVM expressions only.

Every layout is first rewritten to `yyyy-MM-dd` and what follows it; the rest is then split once into clock and zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first three letters of month names.
MONTHS = {
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "мая": 5, "май": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

#: Abbreviations of zones that no offset or zone name stands for, as names of fixed offsets (whose signs are turned round).
ABBREVIATIONS = {
    "EST": "Etc/GMT+5", "EDT": "Etc/GMT+4", "CST": "Etc/GMT+6", "CDT": "Etc/GMT+5", "MST": "Etc/GMT+7", "MDT": "Etc/GMT+6", "PST": "Etc/GMT+8", "PDT": "Etc/GMT+7",
    "WET": "Etc/GMT", "WEST": "Etc/GMT-1", "CET": "Etc/GMT-1", "CEST": "Etc/GMT-2", "EET": "Etc/GMT-2", "EEST": "Etc/GMT-3",
}

SPACES = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+"
#: Layouts of a date; the text that follows it is the last group.
YEAR_FIRST = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?!\d)(.*)$"
DAY_FIRST = r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4}|\d{2})(?!\d)(.*)$"
NAMED_DAY_FIRST = r"(?iu)^(\d{1,2})[ -]?([а-яa-z]{3,9})\.?[ ,-]*(\d{4})(?: ?(?:года|год|г\.|г)(?![а-я]))?,?(.*)$"
NAMED_MONTH_FIRST = r"(?iu)^([а-яa-z]{3,9})\.? (\d{1,2}),? (\d{4})(.*)$"
CLOCK = r"^(?:[Tt ,]{1,2}(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([AaPp])\.?[Mm]\.?)?)? ?(.*)$"
OFFSET = r"(?iu)^\(?(?:(utc|gmt|z|msk|мск)? ?([+-])(\d{1,2}):?(\d{2})?|(utc|gmt|z|msk|мск))\)?(?:\[[^\]]*\])?$"
#: Rarer layouts, rewritten to those above: a weekday or a time before the date, days of a year, days of a week.
WEEKDAY = r"(?iu)^(?:mon|tue|wed|thu|fri|sat|sun|пон|вто|сре|чет|пят|суб|вос|пн|вт|ср|чт|пт|сб|вс)[a-zа-я]*\.?,? (?=.*\d)"
TIME_FIRST = r"^(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)[, ]+(\d.*)$"
ORDINAL = r"^(\d{4})-(\d{3})(?!\d)(.*)$"
WEEK = r"^(\d{4})-?[Ww](\d{2})-?([1-7])(?!\d)(.*)$"
BRACKET = r"^\[([^\]]+)\]$"
#: Separates the groups of a layout that was matched once; no feed can hold it, since control characters count as spaces.
MARK = "\x01"


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that the JVM knows; a text with any other name is unreadable instead of an error."""
    return spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString()[1:-1].split(", ")


def _int(column: Column) -> Column:
    return F.when(column != "", column).cast("int")


def local_epoch(instant: Column, zone: Column) -> Column:
    """Seconds since 1970 UTC of a local time given as seconds. Of two instants the earlier holds; a skipped time is read with the offset before the change."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(instant), zone))


def with_epoch(df: DataFrame, raw: str, zone: str, target: str = "utc_epoch") -> DataFrame:
    """Adds `target` BIGINT: the whole seconds since 1970 UTC that the text `raw` means, `zone` being the source's zone.

    A zone or offset in the text holds before `zone`. A bare day is its local midnight. The day precedes the month unless the
    year leads; two-digit years are 20yy. 10, 13 or 16 digits are seconds, milliseconds or microseconds since 1970. 24:00 ends its day. A zone may be an
    offset, a name or an abbreviation of a fixed offset. Null where the text is
    null, empty, no real calendar day or clock time, or where neither text nor source tells the zone.
    """
    c = F.col
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    zones = ",".join(f"'{x}'" for x in known_zones(df.sparkSession))
    keep = [x for x in df.columns if x != target]
    out = df.withColumn("__s", F.trim(F.regexp_replace(c(raw), SPACES, " ")))
    # digits only: epochs, or the basic layout, which is rewritten to the extended one
    out = out.withColumn("__ticks", F.when(c("__s").rlike(r"^\d{10}$"), c("__s").cast("bigint")).when(c("__s").rlike(r"^\d{13}$"), F.floor(c("__s").cast("bigint") / 1000).cast("bigint")).when(c("__s").rlike(r"^\d{16}$"), F.call_function("div", c("__s").cast("bigint"), F.lit(1_000_000))).when(c("__s").rlike(r"^\d{10}[.,]\d+$"), F.substring("__s", 1, 10).cast("bigint")))
    basic = F.regexp_replace(c("__s"), r"^(\d{8})(\d{6})(?!\d)", "$1T$2")
    basic = F.regexp_replace(basic, r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    basic = F.regexp_replace(basic, r"(?<=^.{10})[T ](\d{2})(\d{2})(\d{2})(?!\d)", "T$1:$2:$3")
    basic = F.regexp_replace(basic, r"(?<=^.{10})[T ](\d{2})(\d{2})(?!\d)", "T$1:$2")
    out = out.withColumn("__s", F.when(c("__s").rlike(r"^\d{8}(?:\d{6})?(?!\d)"), basic).otherwise(c("__s")))

    s = c("__s")
    out = out.withColumn("__s", F.when(s.rlike(TIME_FIRST), F.regexp_replace(s, TIME_FIRST, "$2 $1")).when(s.rlike(WEEKDAY), F.regexp_replace(s, WEEKDAY, "")).otherwise(s))
    part = lambda layout, k: _int(F.regexp_extract(s, layout, k))
    january = F.make_date(part(ORDINAL, 1), F.lit(1), F.lit(1))
    nth = F.date_add(january, part(ORDINAL, 2) - 1)
    fourth = F.make_date(part(WEEK, 1), F.lit(1), F.lit(4))  # is in the first week
    monday = F.date_add(fourth, (part(WEEK, 2) - 1) * 7 - F.weekday(fourth))
    iso = F.when(s.rlike(ORDINAL), F.when((part(ORDINAL, 2) > 0) & (F.year(nth) == part(ORDINAL, 1)), F.concat(F.date_format(nth, "yyyy-MM-dd"), F.regexp_extract(s, ORDINAL, 3))))
    iso = iso.when(s.rlike(WEEK), F.when((part(WEEK, 2) > 0) & (F.year(F.date_add(monday, 3)) == part(WEEK, 1)), F.concat(F.date_format(F.date_add(monday, part(WEEK, 3) - 1), "yyyy-MM-dd"), F.regexp_extract(s, WEEK, 4))))
    out = out.withColumn("__s", iso.otherwise(s))

    # a layout is matched once: its groups, in the order year, month, day, rest, come as one array
    found = F.when(c("__ticks").isNotNull(), F.lit(None))
    for layout, order in ((YEAR_FIRST, "1234"), (DAY_FIRST, "3214"), (NAMED_DAY_FIRST, "3214"), (NAMED_MONTH_FIRST, "3124")):
        found = found.when(c("__s").rlike(layout), F.split(F.regexp_replace(c("__s"), layout, MARK.join(f"${k}" for k in order)), MARK))
    out = out.withColumn("__d", found)
    year, month = _int(c("__d")[0]), c("__d")[1]
    month = F.when(month.rlike("^[0-9]"), _int(month)).otherwise(months[F.lower(F.substring(month, 1, 3))])
    out = out.withColumns({"__y": F.when(year < 100, year + 2000).otherwise(year), "__m": month, "__day": _int(c("__d")[2])})
    y, m, d = c("__y"), c("__m"), c("__day")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= length)
    out = out.withColumn("__day", F.when(real, F.unix_date(F.make_date(y, m, d)).cast("bigint")))
    out = out.withColumn("__t", F.when(c("__day").isNotNull(), F.split(F.regexp_replace(c("__d")[3], CLOCK, MARK.join(f"${k}" for k in range(1, 6))), MARK)))
    hour, half = _int(c("__t")[0]), F.lower(c("__t")[3])
    hour = F.when(half == "", F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    out = out.withColumns({"__h": hour, "__i": F.coalesce(_int(c("__t")[1]), F.lit(0)), "__sec": F.coalesce(_int(c("__t")[2]), F.lit(0)), "__z": F.trim(c("__t")[4])})
    good = ((c("__h") <= 23) & (c("__i") <= 59) & (c("__sec") <= 60)) | ((c("__h") == 24) & (c("__i") == 0) & (c("__sec") == 0))
    out = out.withColumn("__local", F.when(good, c("__day") * 86400 + c("__h") * 3600 + c("__i") * 60 + c("__sec")))
    z = c("__z")
    out = out.withColumn("__o", F.when((z != "") & z.rlike(OFFSET), F.split(F.regexp_replace(z, OFFSET, MARK.join(f"${k}" for k in range(1, 6))), MARK)))
    o = c("__o")
    base = F.when(F.lower(F.concat(o[0], o[4])).isin("msk", "мск"), 3 * 3600).otherwise(0)
    shift = base + F.when(o[1] == "-", -1).otherwise(1) * (F.coalesce(_int(o[2]), F.lit(0)) * 3600 + F.coalesce(_int(o[3]), F.lit(0)) * 60)
    # a name that the JVM doesn't know leaves the value unreadable
    out = out.withColumn("__name", F.when(z == "", c(zone)).when(o.isNull(), F.coalesce(F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])[z], F.regexp_replace(z, BRACKET, "$1"))))
    out = out.withColumn("__name", F.expr(f"CASE WHEN __name IN ({zones}) THEN __name END"))
    epoch = F.when(c("__ticks").isNotNull(), c("__ticks")).when(o.isNotNull(), c("__local") - shift).otherwise(local_epoch(c("__local"), c("__name")))
    return out.withColumn("__epoch", epoch.cast("bigint")).select(*keep, c("__epoch").alias(target))
