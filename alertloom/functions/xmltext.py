"""XML text from columns, with the spelling that ElementTree gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
ATTRIBUTE_ESCAPES = (
    *TEXT_ESCAPES, ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;"),
)


def _escape(value: Column, table: tuple) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), table, value)


def escape_text(value: Column) -> Column:
    return _escape(value, TEXT_ESCAPES)


def escape_attribute(value: Column) -> Column:
    return _escape(value, ATTRIBUTE_ESCAPES)


def attributes(**values: Column) -> Column:
    """`` name="value"`` per attribute; NULL if any value is NULL."""
    return F.concat(
        *[
            F.concat(F.lit(f' {name}="'), escape_attribute(value), F.lit('"'))
            for name, value in values.items()
        ]
    )


def element(name: Column | str, text: Column, attrs: Column | str = "") -> Column:
    """``<name attrs>text</name>``, or the self-closing form for empty or NULL text."""
    tag = F.lit(name) if isinstance(name, str) else name
    head = F.concat(F.lit("<"), tag, F.lit(attrs) if isinstance(attrs, str) else attrs)
    body = F.concat(head, F.lit(">"), escape_text(text), F.lit("</"), tag, F.lit(">"))
    return F.when(F.length(text) > 0, body).otherwise(F.concat(head, F.lit(" />")))


def filled(name: str, escaped: Column) -> Column:
    """Element around escaped text, self-closing for empty or NULL text."""
    return F.when(F.length(escaped) > 0, wrap(name, escaped)).otherwise(F.lit(f"<{name} />"))


def wrap(name: str, children: Column, attrs: str = "") -> Column:
    """Element around serialised children that are never empty."""
    return F.concat(F.lit(f"<{name}{attrs}>"), children, F.lit(f"</{name}>"))


def container(name: str, children: Column, attrs: str = "") -> Column:
    """Element around serialised children, self-closing without any.

    ``children`` should be a column of an earlier projection; it is used twice.
    """
    return F.when(F.length(children) > 0, wrap(name, children, attrs)).otherwise(F.lit(f"<{name}{attrs} />"))


def first_upper(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 2147483647))
