"""Number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip(s: Column) -> Column:
    return F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def general(v: Column, digits: int = 6) -> Column:
    """Shortest of fixed and exponent form with ``digits`` significant digits (%g)."""
    parts = lambda x: F.split(F.format_string(f"%.{digits - 1}e", x), "e")
    return _bound(v.cast("double") + F.lit(0.0), lambda x: F.when(x.isNotNull(), _bound(parts(x), lambda p: _general(p, digits))))


def _general(parts: Column, digits: int) -> Column:
    mantissa, power = parts[0], F.get(parts, F.lit(1)).cast("int")
    minus, figures = F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise(""), F.translate(mantissa, "-.", "")
    whole = F.when(power < 0, "0").otherwise(F.substring(figures, F.lit(1), power + 1))
    rest = F.when(power < 0, F.concat(F.repeat(F.lit("0"), -power - 1), figures)).otherwise(F.substring(figures, power + 2, F.lit(digits)))
    short = lambda s: F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))  # of texts with a point
    fixed = short(F.concat(minus, whole, F.lit("."), rest))
    return F.when((power >= -4) & (power < digits), fixed).otherwise(F.concat(short(mantissa), F.lit("e"), F.get(parts, F.lit(1))))


def to_places(v: Column, places: int = 3) -> Column:
    """The double nearest to ``v`` with so many decimals, judged by its exact binary value and a half to the even digit,
    as C prints it (a Java format judges the shortest decimal text and rounds its half up). For 3 places or fewer."""
    scale, cut = float(10 ** places), float(1 << 26)
    size = F.abs(v)
    part = size - F.floor(size)  # this and the halves below are exact
    high = F.floor(part * cut) / cut
    unit = F.floor(high * scale)
    over = (high * scale - unit - 0.5) + (part - high) * scale
    up = (over > 0) | ((over == 0) & (unit % 2 == 1))
    out = (F.floor(size) * 10 ** places + unit + up.cast("long")) / scale
    return F.when((size > 0) & (size < float(1 << 40)), F.when(v < 0, -out).otherwise(out)).otherwise(v)


def signed(v: Column, text: Column) -> Column:
    return F.when(v >= 0, F.concat(F.lit("+"), text)).otherwise(text)


def _bound(c: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(c), fn)[0]


def plain(v: Column) -> Column:
    """A double in full without an exponent, with the fewest digits that tell it apart, at least one decimal."""
    return _bound(v.cast("double") + F.lit(0.0), lambda x: _bound(F.split(F.abs(x).cast("string"), "E"), lambda parts: _plain(x, parts)))


def _plain(v: Column, parts: Column) -> Column:
    mantissa = F.split(parts[0], r"\.")
    digits = F.concat(mantissa[0], F.coalesce(F.get(mantissa, F.lit(1)), F.lit("")))
    point = F.length(mantissa[0]) + F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0))
    none = F.lit(0)
    wide = F.concat(F.repeat(F.lit("0"), F.greatest(1 - point, none)), digits, F.repeat(F.lit("0"), F.greatest(point - F.length(digits), none)))
    cut = F.greatest(point, F.lit(1))
    s = _strip(F.concat(F.substring(wide, F.lit(1), cut), F.lit("."), F.substring(wide, cut + 1, F.length(wide)), F.lit("0")))
    s = F.when(F.instr(s, ".") > 0, s).otherwise(F.concat(s, F.lit(".0")))
    return F.when(v < 0, F.concat(F.lit("-"), s)).otherwise(s)


def plain_rounded(v: Column) -> Column:
    """``plain`` of a number rounded to 20 places or fewer and below 1e18, by way of a decimal."""
    s = _strip(v.cast("string").cast("decimal(38,20)").cast("string"))
    return F.when(F.instr(s, ".") > 0, s).otherwise(F.concat(s, F.lit(".0")))


def padded(v: Column, width: int = 5) -> Column:
    """Zero-padded decimal text, the sign first."""
    body = F.abs(v).cast("string")
    minus = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    room = F.lit(width) - F.length(minus)
    return F.concat(minus, F.when(F.length(body) < room, F.lpad(body, room, F.lit("0"))).otherwise(body))


def float_hex(v: Column) -> Column:
    """The eight hex digits of the nearest 32-bit float."""
    x = F.abs(v.cast("float").cast("double"))
    guess = F.floor(F.log2(x))
    power = (
        F.when(F.pow(F.lit(2.0), guess) > x, guess - 1)
        .when(F.pow(F.lit(2.0), guess + 1) <= x, guess + 1)
        .otherwise(guess)
    )
    mantissa = (x / F.pow(F.lit(2.0), power) * float(1 << 23)).cast("long") - (1 << 23)
    sign = F.when(v < 0, F.lit(1 << 31)).otherwise(F.lit(0))
    bits = F.when(x == 0, sign).otherwise(sign + (power + 127) * (1 << 23) + mantissa)
    return F.lpad(F.lower(F.hex(bits.cast("long"))), 8, "0")


def fixed_hex(v: Column) -> Column:
    """Q5.23 fixed point; a negative value is the 28-bit complement of its size."""
    size = (F.abs(v) * float(1 << 23)).cast("long")
    return F.lpad(F.lower(F.hex(F.when(v < 0, size.bitwiseXOR(F.lit(0xFFFFFFF))).otherwise(size))), 8, "0")
