"""Canonical JSON text of a row in built-in expressions.

The text equals Python's ``json.dumps(row, sort_keys=True, default=str)``: keys in
code-point order, ``", "`` and ``": "`` between them, ASCII only with ``\\u``
escapes (surrogate pairs beyond the basic plane), and the shortest float text that
reads back as the same number.

A float's shortest text: the engine's own text of a double has enough digits but
not always the fewest, so its digits are rounded to fewer places and the first
text that reads back as the same double is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_string(text: Column) -> Column:
    """A JSON string literal, in ASCII."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        out = F.when(char == '"', '\\"').when(char == "\\", "\\\\")
        for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = out.when(char == raw, short)
        return out.when(code.between(32, 126), char).when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))

    chars = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    odd = text.rlike(r'["\\]|[^ -~]')
    return F.concat(F.lit('"'), F.when(odd, F.array_join(F.transform(chars, escaped), "")).otherwise(text), F.lit('"'))


def _shortest(number: Column, x: Column) -> Column:
    """(digits, point) of the fewest digits with ``0.digits * 10^point == x``; ``number`` has enough of them."""
    digits, point = number["digits"], number["point"]
    powers = F.array(*[F.lit(10**i).cast("long") for i in range(18)])
    div = lambda a, b: F.call_function("div", a, b)  # noqa: E731  whole numbers: doubles would lose digits

    def rounded(m: Column) -> Column:
        unit = F.get(powers, F.length(digits) - m)
        text = div(digits.cast("long") + div(unit, F.lit(2).cast("long")), unit).cast("string")
        return F.struct(text.alias("digits"), (point + F.length(text) - m).cast("int").alias("point"))

    # two texts of up to 15 digits are never the same normal double, so such a text is the shortest one; a longer one
    # may only be cut to 15, or grow from there
    normal = x >= F.lit(2.2250738585072014e-308)
    tries = F.transform(F.sequence(F.when(normal, 15).otherwise(1), F.length(digits)), rounded)
    same = F.filter(tries, lambda t: F.concat(
        t["digits"], F.lit("E"), (t["point"] - F.length(t["digits"])).cast("string")).cast("double") == x)
    best = _let(F.element_at(same, 1), lambda t: F.struct(
        F.regexp_replace(t["digits"], "0+$", "").alias("digits"), t["point"].alias("point")))
    return F.when((F.length(digits) <= 15) & normal, number).otherwise(best)


def _plain(value: Column) -> Column:
    """Whether the engine's own text is the shortest one, and written as Python does.

    From 0.001 to under 10^7 both write plain decimals.  16 characters beside the sign hold at most 15 digits, so
    the text is the shortest but for a zero at its end (the engine writes some numbers with one too many).
    """
    text, size = value.cast("string"), F.abs(value)
    return ((size >= 1e-3) & (size < 1e7) & (F.length(text) <= F.when(value < 0, 17).otherwise(16))
            & (text.endswith(".0") | ~text.endswith("0")))


def json_float(value: Column) -> Column:
    """A float as Python writes it; NaN counts as null, infinities are ``Infinity``."""
    value = value.cast("double")

    def parts(text: Column) -> Column:
        """Of ``12.50E3``: its digits, and the places before the point and the power."""
        number = F.split(F.ltrim(text, F.lit("-")), "[.E]")
        left, right = F.get(number, F.lit(0)), F.get(number, F.lit(1))
        return F.struct(F.concat(left, right).alias("every"),
                        (F.length(left) + F.coalesce(F.get(number, F.lit(2)).cast("int"), F.lit(0))).alias("before"))

    def significant(p: Column) -> Column:
        cut = F.ltrim(p["every"], F.lit("0"))
        return F.struct(F.rtrim(cut, F.lit("0")).alias("digits"),
                        (p["before"] - F.length(p["every"]) + F.length(cut)).cast("int").alias("point"))

    def form(short: Column) -> Column:
        digits, point = short["digits"], short["point"]
        size = F.length(digits)
        power = point - 1
        sign = F.when(power < 0, "-").otherwise("+")
        places = F.when(F.abs(power) > 99, F.abs(power).cast("string")).otherwise(F.lpad(F.abs(power).cast("string"), 2, "0"))
        raised = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(size > 1, F.concat(
            F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), sign, places)
        return (F.when((point <= -4) | (point > 16), raised)
                .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
                .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size), F.lit(".0")))
                .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))))

    text = value.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    infinite = F.abs(value) == F.lit(float("inf"))
    # each step is bound before the next one uses it several times
    written = _let(_let(_let(_let(text, parts), significant), lambda n: _shortest(n, F.abs(value))), form)
    return (F.when(value.isNull() | F.isnan(value), "null").when(_plain(value), text)
            .when(infinite, F.concat(sign, F.lit("Infinity")))
            .when(value == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, written)))


def json_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return json_float(value)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        out = value.cast("string")
    elif isinstance(kind, (T.StringType, T.DateType)):
        out = json_string(value.cast("string"))
    else:
        raise ValueError(f"no canonical text for {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def canonical_json(schema: T.StructType, fields: list[str]) -> Column:
    """One JSON object of the fields; a field that is named twice counts once."""
    kinds = {f.name: f.dataType for f in schema.fields}
    parts = [F.concat(json_string(F.lit(f)), F.lit(": "), json_value(F.col(f"`{f}`"), kinds[f])) for f in sorted(set(fields))]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
