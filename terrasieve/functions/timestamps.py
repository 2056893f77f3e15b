"""Mixed timestamp spellings and zones, normalised to microseconds since 1970 UTC.

An ordered cascade of anchored patterns rewrites each value to one canonical field list;
strict calendar checks follow, then the zone: one written in the value decides, otherwise
the default zone of the row's source, with a stated policy for wall times that occur twice
or never. Everything but the (tiny) abbreviation table is JVM-side expressions.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"(?:[Tt]|\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*([Zz]|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d(?::\d{2})?)?\s*(?:\[([A-Za-z_/+\-0-9]+)\])?"
_MON = r"([A-Za-z]{3,9})\.?"

#: (form, pattern, replacement to "order|a|b|c|hour|minute|second|fraction|am/pm|zone|region");
#: order: ymd, dmy, mdy (by name of month) or ? (the source's date order decides).
FORMS = [
    ("epoch_s", r"^(\d{10})(?:\.(\d+))?$", "epoch|$1|0|0|||s|$2|||"),
    ("epoch_ms", r"^(\d{13})$", "epoch|$1|0|0|||ms||||"),
    ("epoch_us", r"^(\d{16})$", "epoch|$1|0|0|||us||||"),
    ("year_first", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:{_TIME}{_AMPM}{_ZONE})?$", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE})?$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:{_TIME}{_AMPM}{_ZONE})?$", "?|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:{_TIME}{_AMPM}{_ZONE})?$", "dmy|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("day_name_month", rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})([-\s/])\s*{_MON}\2\s*(\d{{4}})(?:,?{_TIME}{_AMPM}{_ZONE})?$", "dmy|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("name_month_day", rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?{_TIME}{_AMPM}{_ZONE})?$", "mdy|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
]
#: English names of months; three letters or the full name are accepted.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def zone_abbreviations(names: pd.Series) -> pd.Series:
    """For each IANA zone, its own alphabetic abbreviations with their offset in seconds (the latest use counts)."""
    import datetime as dt
    import zoneinfo

    def one(name):
        out: dict[str, int] = {}
        try:
            zone = zoneinfo.ZoneInfo(name)
        except Exception:  # unknown zone: it has no abbreviations
            return out
        for year in range(1970, 2038):
            for month in (1, 4, 7, 10):
                at = dt.datetime(year, month, 15, 12, tzinfo=dt.timezone.utc).astimezone(zone)
                if (abbr := at.tzname() or "").isalpha():
                    out[abbr.upper()] = int(at.utcoffset().total_seconds())
        return out

    return pd.Series([one(x) for x in names])


#: Microseconds by which a clock goes back at most, in the zones' rules since 1970.
LONGEST_OVERLAP = 3 * 3600 * 1000000
#: Policies for wall times that a clock change makes occur twice, or skips.
TWICE, NEVER = ("first", "last", "reject"), ("reject", "forward")


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names that Spark's JVM knows, some 600."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def with_zone_table(lookup: DataFrame, tz_col: str = "tz_name") -> DataFrame:
    """The lookup plus zone_abbr MAP<STRING,INT>; a known Java zone is kept in zone_ok, else null."""
    table = F.pandas_udf(zone_abbreviations, "map<string,int>")
    known = F.col(tz_col).isin(known_zones(lookup.sparkSession))
    return lookup.withColumn("zone_abbr", table(F.col(tz_col))).withColumn("zone_ok", F.when(known, F.col(tz_col)))


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,9}$"), c.cast("int"))


def _month(c: Column) -> Column:
    low = F.lower(c)
    named = [F.when(low.isin(name, name[:3], *(["sept"] if name == "september" else [])), F.lit(i + 1)) for i, name in enumerate(MONTHS)]
    return F.coalesce(_int(c), *named)


def _stage(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """keep and the new columns. Generators aren't merged, so that long expressions don't multiply across stages."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def resolve(df: DataFrame, keep: list[str], twice: str = "first", never: str = "reject") -> DataFrame:
    """keep plus form, status and instant_us; df has raw, zone, abbr and date_order.

    status: 'ok'; 'twice' (wall time that occurs twice); 'never' (wall
    time skipped by a clock change); 'no_zone' (wall time without a known zone);
    'impossible' (a form matches, but no such date, time or zone exists); 'unreadable'; null
    for null. An offset, abbreviation or zone name in the value decides over the source's zone.
    twice: the 'first' or 'last' of the two instants, or 'reject'; never: 'reject', or 'forward'
    by the skipped time. instant_us is non-null for 'ok' and, unless rejected, 'twice' and
    'never'; finer digits are cut off.
    """
    if twice not in TWICE or never not in NEVER:
        raise ValueError(f"twice must be one of {TWICE}, never one of {NEVER}")
    c, p = F.col, lambda i: F.col("_p")[i]
    df = _stage(df, [*keep, "raw", "zone", "abbr", "date_order"], _s=F.regexp_replace("raw", r"^\s+|\s+$", ""))
    canon = reduce(lambda rest, f: F.when(c("_s").rlike(f[1]), F.regexp_replace("_s", f[1], f"{f[2]}|{f[0]}")).otherwise(rest), reversed(FORMS), F.lit(None).cast("string"))
    keep = [*keep, "raw", "zone", "abbr"]
    df = _stage(df, [*keep, "date_order"], _p=F.split(canon, r"\|", -1))
    order = F.when(p(0) == "?", F.when(c("date_order") == "MDY", "mdy").otherwise("dmy")).otherwise(p(0))
    df = _stage(df, [*keep, "_p"], _o=order)
    is_epoch = c("_o") == "epoch"
    hour, half = _int(p(4)), F.lower(p(8))
    df = _stage(
        df, [*keep, "_o"],
        form=F.coalesce(F.try_element_at("_p", F.lit(-1)), F.lit("none")), _number=F.when(is_epoch, p(1).cast("bigint")), _unit=p(6),
        _y=F.when(is_epoch, None).when(c("_o") == "ymd", _int(p(1))).otherwise(_int(p(3))),
        _m=F.when(is_epoch, None).when(c("_o") == "dmy", _month(p(2))).when(c("_o") == "mdy", _month(p(1))).otherwise(_int(p(2))),
        _d=F.when(is_epoch, None).when(c("_o") == "ymd", _int(p(3))).when(c("_o") == "dmy", _int(p(1))).otherwise(_int(p(2))),
        _h=F.when(p(4) == "", 0).when(half == "", hour).when((hour < 1) | (hour > 12), None).when(half == "p", hour % 12 + 12).otherwise(hour % 12),
        _mi=F.when(p(5) == "", 0).otherwise(_int(p(5))), _s=F.when(p(6) == "", 0).otherwise(_int(p(6))),
        _f=F.when(p(7) == "", F.lit(0)).otherwise(F.rpad(F.substring(p(7), 1, 6), 6, "0").cast("int")),
        _z=F.upper(p(9)), _r=p(10),
    )
    valid = (c("_y") >= 1) & (c("_h") < 24) & (c("_mi") < 60) & (c("_s") < 60)
    sec = ((c("_s") * 1000000 + c("_f")).cast("decimal(10,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(16,6)")
    bare = F.regexp_replace("_z", r"^(UTC|GMT)", "")
    digits = F.replace(F.regexp_replace(bare, r"^([+-])(\d)(?=:|$)", "$10$2"), F.lit(":"), F.lit(""))  # sign, two digits of hours, minutes
    minutes = F.when(F.length(digits) > 3, F.substring(digits, 4, 2).cast("int")).otherwise(0)
    size = F.substring(digits, 2, 2).cast("int") * 3600 + minutes * 60
    numeric = c("_z").rlike(r"^(UTC|GMT)?[+-]\d{1,2}(:?\d{2})?$")
    offset = (
        F.when(c("_z").isin("Z", "UTC", "GMT"), 0)
        .when(numeric, F.when((minutes < 60) & (size <= 18 * 3600), F.when(F.substring(digits, 1, 1) == "-", -size).otherwise(size)))
        .when(c("_z") != "", F.try_element_at("abbr", c("_z")))
    )
    zone = F.when(c("_r") == "", c("zone")).otherwise(F.when(c("_r").isin(known_zones(df.sparkSession)), c("_r")))
    stamp = lambda tz: F.unix_micros(F.try_make_timestamp(c("_y"), c("_m"), c("_d"), c("_h"), c("_mi"), sec, tz))
    final = keep[:-2]
    df = _stage(
        df, [*final, "form", "_o", "_z", "_f", "_number", "_unit"],
        _off=offset, _zone=F.when(c("_z") == "", zone), _wall=F.when(valid, stamp(F.lit("UTC"))),
        # make_timestamp takes the earlier offset where a wall time occurs twice and moves skipped times on; going back tells them
        _at=F.when(valid & (c("_z") == "") & zone.isNotNull(), stamp(F.coalesce(zone, F.lit("UTC")))),
    )
    local = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), c("_zone")))
    gained = local(c("_at")) - local(c("_at") + LONGEST_OVERLAP) + LONGEST_OVERLAP  # by a clock that goes back soon after
    df = _stage(df, [*final, "form", "_o", "_z", "_f", "_number", "_unit", "_off", "_zone", "_wall", "_at"], _gained=gained)
    status = (
        F.when(c("raw").isNull(), None)
        .when(c("form") == "none", "unreadable")
        .when(is_epoch, "ok")
        .when(c("_wall").isNull() | ((c("_z") != "") & c("_off").isNull()), "impossible")
        .when(c("_off").isNotNull(), "ok")
        .when(c("_zone").isNull(), "no_zone")
        .when(local(c("_at")) != c("_wall"), "never")
        .when((c("_gained") > 0) & (local(c("_at") + c("_gained")) == c("_wall")), "twice")
        .otherwise("ok")
    )
    epoch = F.when(is_epoch, F.when(c("_unit") == "s", c("_number") * 1000000 + c("_f")).when(c("_unit") == "ms", c("_number") * 1000).otherwise(c("_number")))
    at = c("_at") if twice != "last" else c("_at") + F.when(c("status") == "twice", c("_gained")).otherwise(0)
    given = ["ok", *(["twice"] if twice != "reject" else []), *(["never"] if never == "forward" else [])]
    df = _stage(df, [*final, "form", "_at", "_gained"], status=status, _us=F.coalesce(epoch, c("_wall") - c("_off") * F.lit(1000000).cast("bigint")))
    return df.select(*final, "form", "status", F.when(c("status").isin(given), F.coalesce("_us", at)).alias("instant_us"))


def normalise_timestamps(df: DataFrame, id_col: str, fields: list[str], source_col: str, lookup: DataFrame, twice: str = "first", never: str = "reject") -> DataFrame:
    """One row (id, field_name, raw, form, status, instant_us) for each row of df and field.

    df: any table with id_col, source_col and the string columns of fields; other columns,
    also ones named like those of lookup, don't matter. lookup: one row a source with columns
    source_col, tz_name, date_order (DMY or MDY; null counts as DMY). A row whose source is null
    or unknown is read without default zone. Null values come out with null form, status and
    instant; an empty df gives an empty result. Repeated rows come out repeatedly. twice and never: see resolve.
    """
    zones = with_zone_table(lookup.select(F.col(source_col).alias("_source"), "tz_name", "date_order").dropDuplicates(["_source"]))
    long = df.select(
        F.col(id_col), F.col(source_col).alias("_source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("raw")) for f in fields])).alias("_v"),
    ).select(id_col, "_source", "_v.*")
    staged = long.join(zones, "_source", "left").select(id_col, "field_name", "raw", F.col("zone_ok").alias("zone"), F.col("zone_abbr").alias("abbr"), "date_order")
    return resolve(staged, [id_col, "field_name"], twice, never).select(id_col, "field_name", "raw", F.when(F.col("raw").isNotNull(), F.col("form")).alias("form"), "status", "instant_us")
