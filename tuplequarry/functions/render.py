"""Values as the server would print them, and as SQL or CSV, in built-in functions only: they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.text import ACL_LETTERS

_S = "string"


def bytea(c: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(c)))


def uuid(c: Column) -> Column:
    """Of 16 bytes."""
    return F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def mac(c: Column) -> Column:
    """Of 6 or 8 bytes."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(c)), "(..)", "$1:"), F.lit(":"))


def clock(us: Column) -> Column:
    """Microseconds as hh:mm:ss, with the fraction if there is one."""
    us = F.abs(us)
    two = lambda x: F.lpad(x.cast(_S), 2, "0")
    s = ((us - us % 1_000_000) / 1_000_000).cast("long")
    hours = F.when(s < 360_000, two(((s - s % 3600) / 3600).cast("long"))).otherwise(((s - s % 3600) / 3600).cast("long").cast(_S))
    whole = F.concat(hours, F.lit(":"), two(((s % 3600 - s % 60) / 60).cast("long")), F.lit(":"), two(s % 60))
    fraction = us % 1_000_000
    return F.when(fraction == 0, whole).otherwise(F.concat(whole, F.lit("."), F.rtrim(F.lpad(fraction.cast(_S), 6, "0"), F.lit("0"))))


def timestamp(c: Column, zone: str = "") -> Column:
    """Six digits of fraction, or none."""
    pattern = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.concat(pattern, F.lit(zone)) if zone else pattern


def timetz(c: Column) -> Column:
    """Of struct<micros, zone>; zone counts seconds west."""
    z = F.abs(c["zone"])
    two = lambda x: F.lpad(x.cast("long").cast(_S), 2, "0")
    sign = F.when(c["zone"] > 0, "-").otherwise("+")
    return F.concat(clock(c["micros"]), sign, two((z - z % 3600) / 3600), F.lit(":"), two((z % 3600 - z % 60) / 60))


def interval(c: Column) -> Column:
    """Of struct<months, days, micros>."""
    m, d, us = c["months"], c["days"], c["micros"]
    years, months = ((m - m % 12) / 12).cast("int"), m % 12  # remainders take the dividend's sign, so both truncate
    unit = lambda n, name: F.concat(n.cast(_S), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
    plus = lambda n, before: F.when(before & (n > 0), "+").otherwise("")
    below = lambda *xs: F.coalesce(*[F.when(x != 0, x < 0) for x in xs], F.lit(False))  # noqa: E731  the last nonzero one is negative
    parts = [
        F.when(years != 0, unit(years, "year")),
        F.when(months != 0, F.concat(plus(months, below(years)), unit(months, "mon"))),
        F.when(d != 0, F.concat(plus(d, below(months, years)), unit(d, "day"))),
        F.when((us != 0) | ((m == 0) & (d == 0)), F.concat(F.when(us < 0, "-").otherwise(plus(us, below(d, months, years))), clock(us))),
    ]
    return F.when(m.isNotNull(), F.concat_ws(" ", *parts))


def bits(c: Column, n: Column) -> Column:
    """The first n bits of bytes."""
    digits = F.transform(F.filter(F.split(F.hex(c), ""), lambda x: x != ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0"))
    return F.substring(F.array_join(digits, ""), F.lit(1), n)


def acl_privileges(c: Column) -> Column:
    letters = F.array(*[F.when(c.bitwiseAND(F.lit(1 << i)) != 0, x) for i, x in enumerate(ACL_LETTERS)])
    return F.array_join(letters, "")


def point(c: Column) -> Column:
    return F.concat(F.lit("("), c["x"].cast(_S), F.lit(","), c["y"].cast(_S), F.lit(")"))


def array_element(c: Column) -> Column:
    plain = (c != "") & (F.upper(c) != "NULL") & ~c.rlike(r'[,{}"\\]|^\s|\s$')
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.isNull(), "NULL").when(plain, c).otherwise(quoted)


def array(c: Column) -> Column:
    """An array of strings as an array literal."""
    return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(c, array_element), ","), F.lit("}")))


def vector(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast(_S)), " ")


# --- SQL and CSV -----------------------------------------------------------------------------------------------------


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_literal(c: Column) -> Column:
    """'text', or E'text' with escapes where there are quotes, backslashes or control characters."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    for ch, to in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(ch), F.lit(to))
    rest = F.array_join(F.transform(F.split(out, ""), lambda x: F.when(x.rlike(r"^[\x00-\x1f\x7f]$"), F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x)), "")
    escaped = F.when(out.rlike(r"[\x00-\x1f\x7f]"), rest).otherwise(out)
    return F.when(c.rlike(r"['\\\x00-\x1f\x7f]"), F.concat(F.lit("E'"), escaped, F.lit("'"))).otherwise(F.concat(F.lit("'"), c, F.lit("'")))


def csv_field(c: Column, delimiter: str = ",") -> Column:
    r"""Quoted if it holds the delimiter, a quote or a line end, or reads \N; null is a bare \N."""
    special = F.contains(c, F.lit(delimiter)) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r")) | (c == "\\N")
    return F.when(c.isNull(), "\\N").when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
