"""Scalar functions of market data: fixed-point prices, bit flags, buckets and enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales of fixed-point prices, decimal places. Fixed values.
PRICE_PLACES, FINE_PLACES = 4, 8


def floor_bucket(time: Column, width: int) -> Column:
    """Start of the bucket, toward minus infinity."""
    return time - F.pmod(time, F.lit(width))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def from_mantissa(value: Column, places: int = PRICE_PLACES) -> Column:
    """A fixed-point number as a decimal."""
    return (value.cast("decimal(19,0)") / F.lit(10**places).cast("decimal(19,0)")).cast(f"decimal(19,{places})")


def maturity_date(value: Column) -> Column:
    """yyyymmdd as a date; null if it is none."""
    return F.when(value > 0, F.try_to_date(value.cast("string"), "yyyyMMdd"))


def trimmed(value: Column) -> Column:
    """Fixed-width text without the zero bytes and blanks at its end."""
    return F.regexp_replace(value, r"[\x00 ]+$", "")


def price_places(divisor: Column, default: int = PRICE_PLACES) -> Column:
    """Decimal places from a price divisor: its exponent if it is a power of ten."""
    out = F.when(divisor == 1, 0)
    for k in range(1, 13):
        out = out.when(divisor == 10**k, k)
    return out.otherwise(default)


def imbalance_side(quantity: Column) -> Column:
    return F.when(quantity > 0, "buyers").when(quantity < 0, "sellers").when(quantity == 0, "balanced")


def auto_resolution(span: Column) -> Column:
    """Seconds of a candle for a chart that spans so many seconds."""
    return F.when(span <= 600, 1).when(span <= 3600, 5).when(span <= 7200, 15).when(span <= 14400, 60).otherwise(300)


def effective_band(kind: Column, limit: Column, reference: Column, increment: Column) -> Column:
    """A price limit in mantissas of 4 places. kind 0: absolute; 1: ticks from the reference; 2: percent of it. limit has 4 places, reference and increment have 8."""
    exact = "decimal(38,0)"
    fine = F.lit(10_000).cast(exact)
    ticks = reference.cast(exact) + (limit.cast(exact) / fine) * increment.cast(exact)
    percent = reference.cast(exact) * (F.lit(1_000_000).cast(exact) + limit.cast(exact)) / F.lit(1_000_000).cast(exact)
    return F.when(kind == 0, limit).when(kind == 1, F.round(ticks / fine, 0).cast("bigint")).when(kind == 2, F.round(percent / fine, 0).cast("bigint"))


def tag_value_checksum(text: Column) -> Column:
    """Sum of all UTF-8 bytes modulo 256, as three digits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    total = F.aggregate(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.lpad(F.pmod(total, F.lit(256)).cast("string"), 3, "0")


SOH = "\x01"


def tag_value(kind: str, fields: dict[int, Column]) -> Column:
    """A tag=value message: version and body length first, the fields that aren't null in order, the checksum last."""
    body = F.concat_ws("", F.lit(f"35={kind}{SOH}"), *(F.concat(F.lit(f"{tag}="), value.cast("string"), F.lit(SOH)) for tag, value in fields.items()))
    whole = F.concat(F.lit(f"8=FIX.4.4{SOH}9="), F.octet_length(body).cast("string"), F.lit(SOH), body)
    return F.concat(whole, F.lit("10="), tag_value_checksum(whole), F.lit(SOH))


def tag_values(message: Column) -> Column:
    """A message's fields as an array of (tag, value), in order; what isn't tag=value is left out."""
    parts = F.filter(F.split(message, SOH), lambda x: F.rlike(x, F.lit("^[0-9]+=")))
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).cast("int").alias("tag"), F.regexp_replace(x, "^[0-9]+=", "").alias("value")))


def intact(message: Column) -> Column:
    """Whether the checksum at the end, and the body length, are those of the message."""
    body = F.regexp_extract(message, f"^8=[^{SOH}]*{SOH}9=[0-9]+{SOH}(.*)10=[0-9]{{3}}{SOH}$", 1)
    whole = F.regexp_extract(message, f"^(.*)10=[0-9]{{3}}{SOH}$", 1)
    length = F.regexp_extract(message, f"{SOH}9=([0-9]+){SOH}", 1).try_cast("int")
    return F.coalesce((body != "") & (F.octet_length(body) == length) & (tag_value_checksum(whole) == F.regexp_extract(message, f"10=([0-9]{{3}}){SOH}$", 1)), F.lit(False))


def decoded(value: Column, length: Column) -> Column:
    """Latin text of a binary field of fixed width, without the zero bytes and blanks at its end; null if the field is shorter than length says."""
    return F.when((length >= 0) & (F.octet_length(value) >= length), trimmed(F.decode(F.substring(value, F.lit(1), length), "ISO-8859-1")))


def csv_field(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line break; quotes are doubled, null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.rlike(text, F.lit("[\",\r\n]")), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def utc_stamp(micros: Column) -> Column:
    """yyyyMMdd-HH:mm:ss.SSS of microseconds since 1970, in UTC whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86400000000).cast("int"))
    rest = F.pmod(micros, F.lit(86400000000))
    two = lambda unit, base: F.lpad(F.pmod(F.floor(rest / unit), F.lit(base)).cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), two(3600000000, 24), F.lit(":"), two(60000000, 60), F.lit(":"), two(1000000, 60), F.lit("."), F.lpad(F.pmod(F.floor(rest / 1000), F.lit(1000)).cast("string"), 3, "0"))


#: Categories of instruments by the first letter of a classification code, and groups of equities by the second. Fixed values.
CFI_CATEGORIES = {"E": "Equity", "D": "Debt", "R": "Right/Warrant", "O": "Option", "F": "Future", "M": "Others(Multileg)", "S": "Swap"}
CFI_EQUITIES = {"S": "Common/Ordinary", "P": "Preferred", "C": "Convertible", "F": "Preference", "L": "Limited Partnership", "D": "Depositary Receipt", "Y": "Structured Instrument", "M": "Others"}
#: Names of price limit types, and of sides of a leg. Fixed values.
LIMIT_TYPES = {0: "Price Unit", 1: "Ticks", 2: "Percentage"}
LEG_SIDES = {1: "Buy", 2: "Sell"}


def label(value: Column, names: dict) -> Column:
    """The name of a value, or the value itself as text; null for null."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(table[value], value.cast("string"))


def cfi_label(code: Column) -> Column:
    """Category of a classification code, with the group if it is an equity: the code itself if the category is unknown, null if it has less than two letters."""
    named = lambda names, letter: F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[letter]
    category, group = named(CFI_CATEGORIES, F.substring(code, 1, 1)), named(CFI_EQUITIES, F.substring(code, 2, 1))
    whole = F.when(F.startswith(code, F.lit("E")) & group.isNotNull(), F.concat_ws(" / ", category, group)).otherwise(F.coalesce(category, code))
    return F.when(F.length(code) >= 2, whole)
