"""JSON texts as column expressions, byte by byte as Python's json.dumps writes them (ensure_ascii off)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "  "
#: Control characters with a short form; the others are written as a number.
SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def json_string(text: Column) -> Column:
    """The text in quotes; null stays null."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = [chr(i) for i in range(32) if chr(i) not in SHORT]
    short = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SHORT.items(), plain)
    full = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"\\u{ord(s):04x}")), rare, short)
    has = lambda chars: F.regexp_like(text, F.lit("[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]"))
    return F.concat(F.lit('"'), F.when(has(rare), full).when(has(SHORT), short).otherwise(plain), F.lit('"'))


def json_double(x: Column) -> Column:
    """A double's shortest text, with an exponent below 1e-4 and from 1e16 on."""
    text = x.cast("string")  # Java's: an exponent below 1e-3 and from 1e7 on
    parts = F.split(text, "E")
    power = F.element_at(parts, -1).try_cast("int")
    lead = F.replace(F.get(parts, F.lit(0)), F.lit("-"))
    digits = F.regexp_replace(F.replace(lead, F.lit(".")), "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    sign = F.when(text.startswith("-"), "-").otherwise("")
    point = F.greatest(F.lit(0), power)  # the first digit stands before the point
    filled = F.rpad(digits, F.greatest(F.length(digits), point + 2), F.lit("0"))
    whole = F.concat(F.substr(filled, F.lit(1), point + 1), F.lit("."), F.substr(filled, point + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -power - 1)), digits)
    mantissa = F.when(F.length(digits) > 1, F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string")))
    scientific = F.concat(mantissa, F.lit("e"), exponent)
    moved = F.when((power < -4) | (power >= 16), scientific).when(power < 0, small).otherwise(whole)
    return F.when(F.size(parts) == 1, text).otherwise(F.concat(sign, moved))


def json_value(x: Column, kind: str) -> Column:
    """One of boolean, int, double or string; null is written as such."""
    got = {"boolean": lambda: x.cast("string"), "int": lambda: x.cast("string"), "double": lambda: json_double(x), "string": lambda: json_string(x)}[kind]()
    return F.coalesce(got, F.lit("null"))


def json_object(fields: list[tuple[str, Column]], indent: int | None = None) -> Column:
    """An object of names and JSON texts, in the order given. A null text leaves its field out (a null value is "null")."""
    head, gap, tail = ("{", ", ", "}") if indent is None else ("{\n" + STEP * (indent + 1), ",\n" + STEP * (indent + 1), "\n" + STEP * indent + "}")
    return F.concat(F.lit(head), F.concat_ws(gap, *(F.concat(F.lit(f'"{name}": '), text) for name, text in fields)), F.lit(tail))


def json_array(texts: Column, indent: int | None = None) -> Column:
    """An array of an array of JSON texts."""
    head, gap, tail = ("[", ", ", "]") if indent is None else ("[\n" + STEP * (indent + 1), ",\n" + STEP * (indent + 1), "\n" + STEP * indent + "]")
    return bound(texts, lambda t: F.when(F.size(t) == 0, "[]").otherwise(F.concat(F.lit(head), F.array_join(t, gap), F.lit(tail))))


def indented(text: Column, indent: int = 0) -> Column:
    """Any JSON text set out over lines, as it stands at that depth; strings and numbers stay as they are written.

    An object of plain values is put together from its tokens as they are; of any other text the tokens are gone through
    once with the depth as state.
    """
    def flat(tokens: Column) -> Column:
        gap = "\n" + STEP * (indent + 1)
        said = F.transform(tokens, lambda t: F.when(t == ",", "," + gap).when(t == ":", ": ").when(t == "{", "{" + gap).when(t == "}", "\n" + STEP * indent + "}").otherwise(t))
        return F.array_join(said, "")

    def any_text(tokens: Column) -> Column:
        return F.aggregate(tokens, start, step, lambda s: s["out"])

    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+'), F.lit(0))
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit(STEP), depth))

    def step(s: Column, t: Column) -> Column:
        opens, closes, after_open = t.isin("{", "["), t.isin("}", "]"), s["last"].isin("{", "[")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        gap = F.when(closes, F.when(after_open, "").otherwise(line(depth))).when(after_open | (s["last"] == ","), line(s["depth"])).otherwise("")
        return F.struct(F.concat(s["out"], gap, F.when(t == ":", ": ").otherwise(t)).alias("out"), depth.alias("depth"), t.alias("last"))

    start = F.struct(F.lit("").alias("out"), F.lit(indent).alias("depth"), F.lit("").alias("last"))
    plain = F.regexp_like(text, F.lit(r"^\s*\{\s*[^\[\]{}\s][^\[\]{}]*\}\s*$"))
    return F.when(plain, flat(tokens)).otherwise(any_text(tokens))
