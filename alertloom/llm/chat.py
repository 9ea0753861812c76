"""Chat formatting by schema fingerprints.

Records come as JSON with differing layouts: lists of messages, prompt and completion,
instruction with input and output, single turns.  The nested field paths of a record that
matter to some layout are hashed; the hash selects a declarative mapping from the record
to canonical turns (role, text).  No code depends on the source of a record.

The template marks each turn and is reversible: control strings inside texts get a
backslash behind their first character, as do control strings that already have some
there, and reading back takes one off.  Turns are rendered row by row, so that a
conversation of any length is never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

# The JSON reader's own limits (texts of 20,000,000 characters, depth 1,000, numbers of 1,000 digits) are lifted; it stays strict.
PARSER = {
    "maxStringLen": "2147483647", "maxNestingDepth": "2147483647", "maxNumLen": "2147483647",
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
}

# The template's control strings.
OPEN, ROLE_END, CLOSE = "<|turn|>", "<|text|>", "</s>"
CONTROL = ("<|turn|>", "<|text|>", "</s>", "<s>", "[INST]", "[/INST]")
# Names that stand for a role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Turn:
    """How a turn is read: its text's path, and its role's path or the role itself."""

    text: str
    role: str = ""
    fixed_role: str = ""


@dataclass(frozen=True)
class Layout:
    """A layout: its name, the paths that it must have, and its turns; ``each`` is the list that holds one turn per item."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Turn, ...]
    each: str = ""


LAYOUTS = (
    Layout("messages", ("$.messages[*].content", "$.messages[*].role"), (Turn("content", "role"),), "$.messages"),
    Layout("from_value", ("$.conversations[*].from", "$.conversations[*].value"), (Turn("value", "from"),), "$.conversations"),
    Layout("turns", ("$.turns[*].role", "$.turns[*].text"), (Turn("text", "role"),), "$.turns"),
    Layout("turn_row", ("$.role", "$.text"), (Turn("$.text", "$.role"),)),
    Layout(
        "instruction", ("$.instruction", "$.output"),
        (Turn("$.instruction", fixed_role="user"), Turn("$.output", fixed_role="assistant")),
    ),
    Layout(
        "instruction_input", ("$.input", "$.instruction", "$.output"),
        (Turn("$.instruction", fixed_role="system"), Turn("$.input", fixed_role="user"), Turn("$.output", fixed_role="assistant")),
    ),
    Layout(
        "prompt_completion", ("$.completion", "$.prompt"),
        (Turn("$.prompt", fixed_role="user"), Turn("$.completion", fixed_role="assistant")),
    ),
    Layout(
        "prompt_response", ("$.prompt", "$.response"),
        (Turn("$.prompt", fixed_role="user"), Turn("$.response", fixed_role="assistant")),
    ),
    Layout(
        "nested_prompt", ("$.prompt.user", "$.response.text"),
        (Turn("$.prompt.system", fixed_role="system"), Turn("$.prompt.user", fixed_role="user"), Turn("$.response.text", fixed_role="assistant")),
    ),
    Layout(
        "question_answer", ("$.answer", "$.question"),
        (Turn("$.question", fixed_role="user"), Turn("$.answer", fixed_role="assistant")),
    ),
)


def fingerprint_of(paths: Sequence[str]) -> int:
    """The hash of a set of field paths, as ``fingerprint`` computes it in Spark."""
    digest = hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()
    return int(digest[:15], 16)


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The hash of the nested field paths that a record (a VARIANT) has, among those some layout knows.

    Fields that no layout knows, and optional ones, do not matter.  A path into a list looks
    at its first item.  A path ends at a scalar or null, so that ``prompt`` as an object is
    not ``prompt`` as a text.
    """
    known = sorted({p for layout in layouts for p in layout.paths})
    scalar = lambda p: F.schema_of_variant(F.try_variant_get(record, p.replace("[*]", "[0]"), "variant"))
    found = [F.when(~scalar(p).rlike("^(OBJECT|ARRAY)"), F.lit(p)) for p in known]
    return F.conv(F.substring(F.sha2(F.concat_ws("\n", *found), 256), 1, 15), 16, 10).cast("bigint")


def _turns(record: Column, layout: Layout) -> Column:
    """The turns of a record of that layout: array of (role, text)."""
    text = lambda source, path: F.try_variant_get(source, path, "string")
    if layout.each:
        rule = layout.turns[0]
        items = F.try_variant_get(record, layout.each, "array<variant>")
        return F.transform(items, lambda item: F.struct(
            text(item, f"$.{rule.role}").alias("role"), text(item, f"$.{rule.text}").alias("text")
        ))
    made = F.array(*[
        F.struct((text(record, t.role) if t.role else F.lit(t.fixed_role)).alias("role"), text(record, t.text).alias("text"))
        for t in layout.turns
    ])
    required = {t.text for t in layout.turns} & set(layout.paths)
    optional = [k for k, t in enumerate(layout.turns) if t.text not in required]
    return F.filter(made, lambda t, k: ~k.isin(optional) | t["text"].isNotNull()) if optional else made


def canonical(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout``, ``problem`` and ``turns`` (array of role and text) instead of the JSON text ``record``.

    Roles are lower-cased where they are another name of a known one, and else as they are.
    Null roles and texts are empty.  A record that is null, no JSON or of no known layout has
    a null layout and no turns; two layouts with the same paths are refused.

    ``problem`` tells why a record that is not null has no layout: ``unparsed`` (no JSON, or more
    than a VARIANT holds, 128 MiB) or ``no layout``.  ``unread`` are those records.
    """
    by_hash = {fingerprint_of(layout.paths): layout for layout in layouts}
    if len(by_hash) < len(layouts):
        raise ValueError("two layouts have the same field paths")
    rest = [F.col(f"`{c}`") for c in records.columns if c not in (record, "layout", "problem", "turns")]
    parsed = records.select(
        *rest, F.from_json(F.col(record), "variant", PARSER).alias("__record"), (F.lower(F.trim(F.substring(record, 1, 100))) != "null").alias("__given")
    )
    marked = parsed.withColumn("__print", fingerprint(F.col("__record"), layouts))
    layout, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role: string, text: string>>")
    for mark, own in by_hash.items():
        layout = F.when(F.col("__print") == mark, own.name).otherwise(layout)
        turns = F.when(F.col("__print") == mark, _turns(F.col("__record"), own)).otherwise(turns)
    problem = F.when(F.col("__record").isNull(), F.when(F.col("__given"), "unparsed")).when(~F.col("__print").isin(list(by_hash)), "no layout")
    return marked.select(*rest, layout.alias("layout"), problem.alias("problem"), F.coalesce(_clean(turns), F.array()).alias("turns"))


def _clean(turns: Column) -> Column:
    """Turns with the known names of roles, and without nulls."""
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = lambda r: F.coalesce(names[F.lower(r)], r, F.lit(""))
    return F.transform(turns, lambda t: F.struct(role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def unread(records: DataFrame) -> DataFrame:
    """The rows of ``canonical`` whose record is not null and yet has no layout, with ``problem``."""
    return records.where(F.col("problem").isNotNull()).drop("layout", "turns")


def _paths(kind: DataType, at: str = "$") -> set[str]:
    """The field paths of a type that end at a scalar, as ``fingerprint`` finds them in a record."""
    if isinstance(kind, StructType):
        return set().union(*(_paths(f.dataType, f"{at}.{f.name}") for f in kind.fields))
    if isinstance(kind, ArrayType):
        return _paths(kind.elementType, f"{at}[*]")
    return set() if isinstance(kind, (MapType, VariantType)) else {at}


def canonical_columns(rows: DataFrame, columns: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``rows`` with ``layout``, ``problem`` and ``turns`` instead of ``columns``, which are the fields of a record.

    As ``canonical``, but typed columns have one set of field paths for all rows, so that the
    layout follows from their type, and texts of any length go past the JSON parser.
    """
    kind = StructType([f for f in rows.schema.fields if f.name in columns])
    known = {p for layout in layouts for p in layout.paths}
    paths = _paths(kind)
    own = {fingerprint_of(layout.paths): layout for layout in layouts}.get(fingerprint_of(sorted(paths & known)))
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (*columns, "layout", "problem", "turns")]
    none = F.array().cast("array<struct<role: string, text: string>>")
    if own is None:
        return rows.select(*rest, F.lit(None).cast("string").alias("layout"), F.lit("no layout").alias("problem"), none.alias("turns"))

    def at(path: str) -> Column:
        first, *more = path.removeprefix("$.").split(".")
        found = F.col(f"`{first}`")
        for name in more:
            found = found[name]
        return found

    if own.each:
        rule = own.turns[0]
        turns = F.transform(at(own.each), lambda item: F.struct(
            item[rule.role].cast("string").alias("role"), item[rule.text].cast("string").alias("text")
        ))
        some = F.coalesce(F.size(at(own.each)) > 0, F.lit(False))
    else:
        made = [t for t in own.turns if t.text in paths]
        turns = F.array(*[
            F.struct((at(t.role).cast("string") if t.role else F.lit(t.fixed_role)).alias("role"), at(t.text).cast("string").alias("text")) for t in made
        ])
        optional = [k for k, t in enumerate(made) if t.text not in own.paths]
        turns = F.filter(turns, lambda t, k: ~k.isin(optional) | t["text"].isNotNull()) if optional else turns
        some = F.lit(True)
    return rows.select(
        *rest, F.when(some, own.name).alias("layout"), F.when(~some, "no layout").alias("problem"),
        F.coalesce(F.when(some, _clean(turns)), none).alias("turns"),
    )


def turn_rows(records: DataFrame) -> DataFrame:
    """The rows of ``canonical``, one per turn: their other columns, ``within`` (from 0), ``role`` and ``text``.

    Records without turns have no rows; ``unread`` reports those that could not be read.  An inner explode would let Catalyst infer a filter on
    ``turns`` and push it below the parse, where it tests the fingerprint again for each layout.
    """
    rest = [c for c in records.columns if c not in ("turns", "within", "role", "text")]
    rows = records.select(*[F.col(f"`{c}`") for c in rest], F.posexplode_outer("turns").alias("within", "__turn"))
    return rows.where(F.col("within").isNotNull()).select(
        *[F.col(f"`{c}`") for c in rest], "within", F.col("__turn")["role"].alias("role"), F.col("__turn")["text"].alias("text")
    )


_FIRST = "".join(sorted({c[0] for c in CONTROL}))
_TAILS = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL)
_INSIDE = rf"([{_FIRST.replace('[', chr(92) + '[')}])(\\*(?:{_TAILS}))"
_ESCAPED = rf"([{_FIRST.replace('[', chr(92) + '[')}])\\(\\*(?:{_TAILS}))"


def escaped(text: Column) -> Column:
    """``text`` without control strings: each, and each that has backslashes already, gets one more."""
    return F.regexp_replace(text, _INSIDE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def rendered(turns: DataFrame) -> DataFrame:
    """``turns`` (rows with role and text) with ``formatted``, ``text_start`` and ``in_loss`` instead of both.

    ``formatted`` is the turn as the template writes it; a conversation is its turns' one after
    the other.  Its text starts behind ``text_start`` code points and ends before the closing
    mark.  ``in_loss`` tells whether a model is trained on that text: assistant turns only.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(ROLE_END))
    rest = [F.col(f"`{c}`") for c in turns.columns if c not in ("role", "text", "formatted", "text_start", "in_loss")]
    return turns.select(
        *rest, F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("formatted"), F.length(head).alias("text_start"),
        (F.col("role") == "assistant").alias("in_loss"),
    )


def read_back(rows: DataFrame) -> DataFrame:
    """``rows`` of ``rendered`` with role, text and loss_text, read from ``formatted`` and the loss span alone."""
    body = F.col("formatted").substr(F.lit(len(OPEN) + 1), F.length("formatted") - (len(OPEN) + len(CLOSE)))
    cut = F.instr(body, ROLE_END)
    span = F.col("formatted").substr(F.col("text_start") + 1, F.length("formatted") - F.col("text_start") - len(CLOSE))
    return rows.withColumns({
        "role": unescaped(F.substring(body, F.lit(1), cut - 1)),
        "text": unescaped(body.substr(cut + len(ROLE_END), F.length(body))),
        "loss_text": F.when(F.col("in_loss"), unescaped(span)),
    })


def summaries(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``rows`` are those of ``read_back``.  They are sorted by conversation and ``order`` and hashed
    as they stream by, so that a conversation of any length takes little memory.
    """

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, state, started = None, None, False

        def finished() -> list:
            return [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for part in parts:
            out = []
            for own, role, text, loss, chars in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "chars"))):
                if not started or own != conv:
                    if started:
                        out.append(finished())
                    conv, state, started = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += chars
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(6)], names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(finished(), kinds)], names)

    rows = rows.withColumn("chars", F.length("formatted").cast("bigint")).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", *order)
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.select("conv_id", "role", "text", "loss_text", "chars").mapInArrow(digest, schema)
