"""JSON text on the JVM side: strict parsing, typed access, Python-style output.

A document is parsed once into a VARIANT.  Key order is not kept by VARIANT, so
objects whose order matters are lifted from the text with ``from_json``, which
keeps it and lets the last of two equal keys win.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.fixed_values import STRIPPED_CHARACTERS


def strip_right(text: Column) -> Column:
    """Remove trailing white space, Unicode white space included."""
    return F.rtrim(text, F.lit(STRIPPED_CHARACTERS))


def once(**columns: Column) -> Column:
    """Generator that yields ``columns`` as one row of values.

    Filters written later on a generated column cannot be rewritten in terms of
    the expression behind it, so a costly expression runs once per row, however
    many predicates and projections use its result.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def sealed(text: Column) -> Column:
    """``[document, seal]`` as VARIANT, or NULL where that is not valid JSON."""
    seal = F.xxhash64(text).cast("string")
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), seal, F.lit("]")))


def strict_document(text: Column, sealed_document: Column) -> Column:
    """The one JSON document that ``text`` holds, else NULL.

    ``try_parse_json`` alone ignores text behind the document.  With the seal as
    second array element, a document that closes the array early loses it and a
    second document takes its place, so one parse decides both questions.
    """
    found = F.try_variant_get(sealed_document, "$[1]", "bigint")
    return F.when(found == F.xxhash64(text), F.try_variant_get(sealed_document, "$[0]", "variant"))


def present(document: Column, path: str) -> Column:
    """True if the key exists, also when its value is JSON null."""
    return F.try_variant_get(document, path, "variant").isNotNull()


def type_name(document: Column, path: str) -> Column:
    """Type name of the value at ``path``; ``VOID`` for JSON null, NULL if absent."""
    return F.schema_of_variant(F.try_variant_get(document, path, "variant"))


def text_at(document: Column, path: str) -> Column:
    """Value at ``path`` as text."""
    return F.try_variant_get(document, path, "string")


def printed(document: Column, path: str) -> Column:
    """The value as Python prints it: ``None`` for null or absent, ``True``/``False``."""
    kind = type_name(document, path)
    text = text_at(document, path)
    return F.coalesce(F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text), F.lit("None"))


def ordered_entries(parsed: Column) -> Column:
    """Entries of a parsed JSON object in text order; equal keys: first place, last value.

    ``parsed`` is a map column that ``from_json`` produced in an earlier
    projection, which keeps every entry, repeated keys included.
    """
    entries = F.map_entries(parsed)
    keys = F.map_keys(parsed)
    distinct = F.array_distinct(keys)
    last_of_equal = F.transform(
        distinct,
        lambda k: F.struct(
            k.alias("key"),
            F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"),
        ),
    )
    return F.when(F.size(keys) == F.size(distinct), entries).otherwise(last_of_equal)


def only_text_values(document: Column, path: str) -> Column:
    """True if the object at ``path`` has string and null values only."""
    members = F.map_values(F.try_variant_get(document, path, "map<string,variant>"))
    return F.forall(members, lambda v: F.schema_of_variant(v).isin("STRING", "VOID"))


def _escaped_character(ch: Column) -> Column:
    code = F.ascii(ch)
    unit = lambda c: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(c), 4, "0")))
    high = (F.floor((code - 0x10000) / 0x400) + 0xD800).cast("bigint")
    low = ((code - 0x10000) % 0x400 + 0xDC00).cast("bigint")
    named = F.create_map(
        *[F.lit(x) for pair in ('""', "\\\\", "\nn", "\rr", "\tt", "\ff", "\bb") for x in pair]
    )
    return (
        F.when(named[ch].isNotNull(), F.concat(F.lit("\\"), named[ch]))
        .when((code >= 0x20) & (code < 0x7F), ch)
        .when(code < 0x10000, unit(code.cast("bigint")))
        .otherwise(F.concat(unit(high), unit(low)))
    )


def quoted(text: Column) -> Column:
    """ASCII-only JSON string literal, ``null`` for NULL."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    spelled = F.array_join(F.transform(F.split(text, ""), _escaped_character), "")
    body = F.when(text.rlike(r"^[\x20-\x7e]*\z"), plain).otherwise(spelled)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def object_text(**members: Column) -> Column:
    """JSON object with ``", "`` and ``": "`` separators from already encoded members."""
    parts: list[Column] = []
    for position, (name, value) in enumerate(members.items()):
        parts += [F.lit(f'{", " if position else ""}"{name}": '), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))
