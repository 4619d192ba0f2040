"""Coercion of parsed JSON values (VARIANT) to field types.

Each function gives struct(value, error): at most one is not null.  Values are
never guessed: units, wrong types and out-of-range numbers are errors.  Null in,
null out, without error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_DATE_FORMAT, FieldDef
from .text import let, quoted, strip

#: strptime directives and the Java pattern letters that read the same text.
#: Single letters: one or two digits are accepted alike.
DIRECTIVES = {"d": "d", "m": "M", "Y": "yyyy", "y": "yy", "H": "H", "M": "m", "S": "s", "b": "MMM", "B": "MMMM", "I": "h", "p": "a", "j": "D", "f": "S", "%": "%"}


def java_pattern(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in DIRECTIVES:
                raise ValueError(f"date directive %{fmt[i + 1]} is not supported")
            out.append(DIRECTIVES[fmt[i + 1]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i])
            i += 1
    return "".join(out)


#: Integers of any length are kept, up to this many digits.
INTEGER = "decimal(38,0)"


def kind(v: Column) -> Column:
    """Name of the value's JSON type as messages give it."""
    return let(
        F.schema_of_variant(v),
        lambda t: F.when(t == "STRING", "str")
        .when(t == "BIGINT", "int")
        .when(F.rlike(t, F.lit(r"^DECIMAL\((19|2[0-9]|3[0-9]),0\)$")), "int")  # too long for BIGINT; 34.0 is DECIMAL(2,0)
        .when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "float")
        .when(t == "BOOLEAN", "bool")
        .when(t.startswith("ARRAY"), "list")
        .when(t.startswith("OBJECT"), "dict")
        .when(t == "VOID", "NoneType")
        .otherwise(F.lower(t)),
    )


def is_null(v: Column) -> Column:
    """SQL null or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def shown(v: Column, depth: int = 2) -> Column:
    """A value as messages show it: lists and objects to `depth` levels, what is
    deeper as JSON."""

    def inner(x):
        return F.when(is_null(x), "None").otherwise(shown(x, depth - 1))

    def by_kind(k):
        scalar = (
            F.when(k == "str", quoted(as_string(v)))
            .when(k == "bool", F.initcap(as_string(v)))
            .when(k == "float", F.try_variant_get(v, "$", "double").cast("string"))
        )
        if depth == 0:
            return scalar.when(k.isin("list", "dict"), F.to_json(v)).otherwise(as_string(v))
        items = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), inner), ", ")
        pairs = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.concat(quoted(e["key"]), F.lit(": "), inner(e["value"])))
        return (
            scalar.when(k == "list", F.concat(F.lit("["), items, F.lit("]")))
            .when(k == "dict", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
            .otherwise(as_string(v))
        )

    return let(kind(v), by_kind)


def _result(fd: FieldDef, cases: list[tuple[Column, Column]], value: Column, v: Column) -> Column:
    """`value`, unless one of `cases` (condition, message) holds; first wins."""
    message = F.lit(None).cast("string")
    for cond, text in reversed(cases):
        message = F.when(cond, text).otherwise(message)
    found = F.when(~is_null(v), F.concat(F.lit(f"{fd.name}: coercion failed -- "), message))
    return let(found, lambda err: F.struct(F.when(~is_null(v) & err.isNull(), value).alias("value"), err.alias("error")))


def _range(fd: FieldDef, n: Column) -> list[tuple[Column, Column]]:
    cases = []
    if fd.min is not None:
        cases.append((n < fd.min, F.concat(n.cast("string"), F.lit(f" is below min {float(fd.min)}"))))
    if fd.max is not None:
        cases.append((n > fd.max, F.concat(n.cast("string"), F.lit(f" is above max {float(fd.max)}"))))
    return cases


def to_integer(v: Column, fd: FieldDef) -> Column:
    s, x = strip(as_string(v)), F.try_variant_get(v, "$", "double")

    def by_kind(k):
        whole = F.when(k == "str", s.try_cast(INTEGER)).otherwise(F.coalesce(F.try_variant_get(v, "$", INTEGER), x.try_cast(INTEGER)))
        digits = F.rlike(s, F.lit(r"^[+-]?[0-9]+\z"))

        def checked(n):
            cases = [
                (k == "bool", F.lit("boolean is not an integer")),
                ((k == "float") & (x != F.floor(x)), F.concat(x.cast("string"), F.lit(" has a fractional part"))),
                ((k == "str") & ~digits, F.concat(quoted(as_string(v)), F.lit(" is not an integer"))),
                (~k.isin("int", "float", "str"), F.concat(F.lit("cannot coerce "), k, F.lit(" to integer"))),
                (n.isNull(), F.concat(as_string(v), F.lit(" has more than 38 digits"))),
            ]
            return _result(fd, cases + _range(fd, n), n, v)

        return let(whole, checked)

    return let(kind(v), by_kind)


def to_float(v: Column, fd: FieldDef) -> Column:
    s = strip(as_string(v))

    def by_kind(k):
        n = F.when(k == "str", s.try_cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        cases = [
            (k == "bool", F.lit("boolean is not a number")),
            ((k == "str") & ~F.rlike(s, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z")), F.concat(quoted(as_string(v)), F.lit(" is not a number"))),
            (~k.isin("int", "float", "str"), F.concat(F.lit("cannot coerce "), k, F.lit(" to float"))),
        ]
        return let(n, lambda x: _result(fd, cases + _range(fd, x), x, v))

    return let(kind(v), by_kind)


def to_date(v: Column, fd: FieldDef) -> Column:
    """The stripped text, if it parses; the text itself is what is kept."""
    s, fmt = strip(as_string(v)), fd.format or DEFAULT_DATE_FORMAT

    def by_kind(k):
        cases = [
            (k != "str", F.concat(F.lit("date must be a string, got "), k)),
            (F.try_to_timestamp(s, F.lit(java_pattern(fmt))).isNull(), F.concat(quoted(as_string(v)), F.lit(f" does not parse as {fmt}"))),
        ]
        return _result(fd, cases, s, v)

    return let(kind(v), by_kind)


def _members(fd: FieldDef) -> dict[str, str]:
    return {m.lower(): m for m in fd.values}


def _members_shown(fd: FieldDef) -> str:
    return str(list(fd.values))


def _member_map(fd: FieldDef) -> Column:
    return F.create_map(*[F.lit(x) for kv in _members(fd).items() for x in kv])


def to_enum(v: Column, fd: FieldDef) -> Column:
    member = F.try_element_at(_member_map(fd), F.lower(strip(as_string(v))))

    def by_kind(k):
        def checked(value):
            cases = [
                (k != "str", F.concat(F.lit("enum value must be a string, got "), k)),
                (value.isNull(), F.concat(quoted(as_string(v)), F.lit(f" is not one of {_members_shown(fd)}"))),
            ]
            return _result(fd, cases, value, v)

        return let(member, checked)

    return let(kind(v), by_kind)


def to_boolean(v: Column, fd: FieldDef) -> Column:
    s = F.lower(strip(as_string(v)))

    def by_kind(k):
        good = (k == "bool") | ((k == "str") & s.isin("true", "false"))
        return _result(fd, [(~good, F.concat(shown(v), F.lit(" is not a boolean")))], s == "true", v)

    return let(kind(v), by_kind)


def to_checkbox_group(v: Column, fd: FieldDef) -> Column:
    items, members = F.try_variant_get(v, "$", "array<variant>"), _member_map(fd)

    def member(x):
        return F.when(kind(x) == "str", F.try_element_at(members, F.lower(strip(as_string(x)))))

    def by_kind(k):
        def checked(found):
            at = F.array_position(F.transform(found, lambda m: m.isNull()), F.lit(True)).cast("int")
            bad = F.get(items, at - 1)
            cases = [
                (k != "list", F.lit("checkbox_group must be a list")),
                (at > 0, F.concat(F.when(is_null(bad), "None").otherwise(shown(bad)), F.lit(f" is not one of {_members_shown(fd)}"))),
            ]
            return _result(fd, cases, found, v)

        return let(F.transform(items, member), checked)

    return let(kind(v), by_kind)


def to_string(v: Column, fd: FieldDef) -> Column:
    if fd.regex:
        re.compile(fd.regex)

    def by_kind(k):
        def checked(s):
            cases = [(k != "str", F.concat(F.lit("expected a string, got "), k))]
            if fd.max_length:
                cases.append((F.length(s) > fd.max_length, F.concat(F.lit("length "), F.length(s).cast("string"), F.lit(f" exceeds max_length {fd.max_length}"))))
            if fd.regex:
                cases.append((~F.rlike(s, F.lit(rf"^(?:{fd.regex})\z")), F.concat(quoted(s), F.lit(f" does not match {fd.regex}"))))
            return _result(fd, cases, s, v)

        return let(strip(as_string(v)), checked)

    return let(kind(v), by_kind)


def to_table(v: Column, fd: FieldDef) -> Column:
    """Rows with every column, missing ones null; any bad cell fails the field.
    Each row is read once, into its values and what is wrong with it."""
    rows = F.try_variant_get(v, "$", "array<variant>")
    names = [c.name for c in fd.columns]

    def one(row, i):
        def read(cells):
            got = F.struct(*[coerce(F.try_element_at(cells, F.lit(c.name)), c).alias(c.name) for c in fd.columns])
            return let(got, lambda g: judged(cells, g))

        def judged(cells, g):
            unknown = F.array_sort(F.array_except(F.map_keys(cells), F.array(*map(F.lit, names))))
            listed = F.concat(F.lit("['"), F.array_join(unknown, "', '"), F.lit("']"))
            at = F.concat(F.lit("row "), i.cast("string"))
            trouble = (
                F.when(cells.isNull(), F.concat(at, F.lit(" is not an object")))
                .when(F.size(unknown) > 0, F.concat(at, F.lit(" has unknown columns "), listed))
                .otherwise(F.concat(at, F.lit(": "), F.coalesce(*[g[n]["error"] for n in names])))
            )
            return F.struct(F.struct(*[g[n]["value"].alias(n) for n in names]).alias("value"), trouble.alias("trouble"))

        return let(F.when(kind(row) == "dict", F.try_variant_get(row, "$", "map<string,variant>")), read)

    def checked(k, found):
        first = F.get(F.filter(F.transform(found, lambda r: r["trouble"]), lambda t: t.isNotNull()), F.lit(0))
        cases = [
            (k != "list", F.lit("table must be a list of row objects")),
            (F.size(found) > fd.max_rows, F.concat(F.size(found).cast("string"), F.lit(f" rows exceeds max_rows {fd.max_rows}"))),
            (first.isNotNull(), first),
        ]
        return _result(fd, cases, F.transform(found, lambda r: r["value"]), v)

    return let(kind(v), lambda k: let(F.transform(rows, one), lambda found: checked(k, found)))


_BY_TYPE = {
    "integer": to_integer, "float": to_float, "date": to_date, "datetime": to_date, "enum": to_enum, "boolean": to_boolean,
    "checkbox_group": to_checkbox_group, "string": to_string, "free_text": to_string, "table": to_table,
}


def coerce(v: Column, fd: FieldDef) -> Column:
    """struct(value, error) of a VARIANT for the field's type."""
    return _BY_TYPE[fd.type](v, fd)


def json_text(value: Column) -> Column:
    """A coerced value as stored: JSON text, the text null for null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', ""), F.lit("null"))
