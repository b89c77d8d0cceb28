"""Fields of a line: JSON body as VARIANT, nested lookup, aliases, key=value text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMESTAMP_THEN_JSON = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s+(\{.+\})\s*$"

# Names under which one field is looked up, in order.
FIELD_ALIASES = {
    "message": ["message", "msg", "error.message", "exception.message", "error", "log", "text", "content"],
    "msg": ["message", "msg", "error.message", "exception.message", "error", "log", "text", "content"],
    "severity": ["severity", "level", "log_level", "loglevel", "log.level"],
    "level": ["severity", "level", "log_level", "loglevel", "log.level"],
}


def json_body(content: Column) -> Column:
    """The JSON text of a line: the line itself, or what follows a leading timestamp."""
    trimmed = F.trim(content)
    prefixed = F.regexp_extract(content, TIMESTAMP_THEN_JSON, 1)
    return F.when(trimmed.startswith("{"), trimmed).when(prefixed != "", prefixed)


def parse_json(content: Column) -> Column:
    """Line to VARIANT; null for text that is not a JSON object."""
    return F.try_parse_json(json_body(content))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A filter on a plain projected column is pushed below the projection, which copies the expression into
    the filter once per use. A one-element explode keeps it above, inside the same generated code.
    """
    for name, column in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(column)).alias(name))
    return df


def with_fields(lines: DataFrame) -> DataFrame:
    """Add `fields`, the JSON of each line, parsed once however many fields are tested."""
    return compute_once(lines, fields=parse_json(F.col("content")))


def json_paths(name: str) -> list[str]:
    """JSON paths a dotted name may mean: literal key first, then every split into nested keys."""

    def step(part: str) -> str:
        quoted = part.replace("\\", "\\\\").replace("'", "\\'")
        return f"[{part}]" if part.isdigit() else f"['{quoted}']"

    def spellings(parts: list[str]) -> list[str]:
        whole = ".".join(parts)
        found = [f"['{whole}']" if "." in whole else step(whole)]
        for cut in range(len(parts) - 1, 0, -1):
            found += [step(".".join(parts[:cut])) + rest for rest in spellings(parts[cut:])]
        return found

    parts = name.split(".")
    return list(dict.fromkeys("$" + s for s in spellings(parts)))


def field(name: str, fields: Column | str = "fields") -> Column:
    """Value of a possibly nested field as text; null when missing or JSON null."""
    if isinstance(fields, str):  # one SQL text is one call into the JVM
        paths = [p.replace("\\", "\\\\").replace("'", "\\'") for p in json_paths(name)]
        found = [f"try_variant_get({fields}, '{p}', 'string')" for p in paths]
        return F.expr(found[0] if len(found) == 1 else f"coalesce({', '.join(found)})")
    found = [F.try_variant_get(fields, p, "string") for p in json_paths(name)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def field_is_json_null(name: str, fields: Column | None = None) -> Column:
    """True only where the field exists and holds JSON null."""
    v = F.col("fields") if fields is None else fields
    tests = [F.coalesce(F.is_variant_null(F.try_variant_get(v, p, "variant")), F.lit(False)) for p in json_paths(name)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def text_field(content: Column, name: str) -> Column:
    """`name="v"`, `name='v'` or bare `name=v` (also with `:`) in plain text."""
    head = rf"(?i)\b{re.escape(name)}[=:]\s*"
    forms = [head + r'"([^"]+)"', head + r"'([^']+)'", head + r"(\S+)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for p in forms])


def resolve_field(name: str) -> Column:
    """Value of a field of a line with columns `fields` and `content`: aliases in the JSON, then the text.

    A message that cannot be found is the whole line.
    """
    found = [field(n) for n in FIELD_ALIASES.get(name, [name])]
    if name in ("message", "msg"):
        joined = F.concat_ws(": ", field("exception.class"), field("exception.message"))
        both = field("exception.class").isNotNull() & field("exception.message").isNotNull()
        return F.coalesce(*found[:2], F.when(both, joined), *found[2:], F.col("content"))
    return F.coalesce(*found, text_field(F.col("content"), name))


# The types of fields, by name.
TYPES = ["array", "boolean", "number", "object", "string", "unknown"]


def json_type(schema: Column) -> Column:
    """Type name from the schema text of a VARIANT value: string, number, boolean, array, object or unknown."""
    return (
        F.when(schema == "STRING", "string")
        .when(schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("unknown")
    )


ENTRY = "array<struct<field:string,value:variant,schema:string>>"


def _entries(v: Column, prefix: Column | None = None) -> Column:
    """Keys of a JSON object as array<struct<field, value, schema>>, names led by `prefix`."""

    def entry(e: Column) -> Column:
        name = e["key"] if prefix is None else F.concat_ws(".", prefix, e["key"])
        return F.struct(name.alias("field"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("schema"))

    return F.coalesce(
        F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), entry), F.array().cast(ENTRY)
    )


LEVELS = 4


def _has_objects(rows: DataFrame, levels: int) -> bool:
    """Whether an object is left to open in some row of flatten_fields."""
    if "content" in rows.columns:
        rows = rows.where(F.length("content") - F.length(F.replace("content", F.lit("{"), F.lit(""))) > levels)
    return not rows.where(F.exists(f"_l{levels - 1}", lambda e: e["schema"].startswith("OBJECT"))).isEmpty()


def flatten_fields(parsed: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per field of a line's JSON: dotted `field`, VARIANT `value`, its `type` and `text`, in one pass.

    Objects are kept and also opened, level by level until none is left, or `depth` levels down. A list of strings also yields
    `<field>_concat` with the words joined. Below LEVELS levels each further one is opened only if some line has it, which takes a
    look at the lines that hold enough braces.
    """
    keep = [c for c in parsed.columns if c != "fields"]
    rows = compute_once(parsed.where("fields is not null"), _l0=_entries(F.col("fields")))
    levels = 1
    while levels < (depth or LEVELS) or depth is None and _has_objects(rows, levels):
        objects = F.filter(f"_l{levels - 1}", lambda e: e["schema"].startswith("OBJECT"))
        deeper = F.flatten(F.transform(objects, lambda e: _entries(e["value"], e["field"])))
        rows = compute_once(rows, **{f"_l{levels}": deeper})
        levels += 1
    depth = levels
    rows = rows.select(*keep, F.explode(F.concat(*[f"_l{i}" for i in range(depth)])).alias("_e")).select(
        *keep, "_e.field", "_e.value", json_type(F.col("_e.schema")).alias("type"),
        F.try_variant_get("_e.value", "$", "string").alias("text"), (F.col("_e.schema") == "ARRAY<STRING>").alias("_words"),
    )
    itself = F.struct("field", "type", "text")
    joined = F.struct(
        F.concat("field", F.lit("_concat")).alias("field"), F.lit("string").alias("type"),
        F.array_join(F.try_variant_get("value", "$", "array<string>"), " ").alias("text"),
    )
    both = F.when(F.col("_words"), F.array(itself, joined)).otherwise(F.array(itself))
    return rows.select(*keep, "value", F.explode(both).alias("_f")).select(*keep, "_f.field", "_f.type", "_f.text", "value")


KEY_VALUE = r"(\w+)=([^\s]+)"
KEY_COLON_VALUE = r"(\w+):([^\s]+)"


def kv_pairs(content: Column) -> Column:
    """`key=value`, then `key:value` pairs of a text line, as array<struct<key, value, type>>."""

    def pairs(pattern: str) -> Column:
        keys = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
        return F.zip_with(
            keys, values,
            lambda k, v: F.struct(
                k.alias("key"), v.alias("value"),
                F.when(v.rlike(r"^\d+$"), "number").when(v.isin("true", "false"), "boolean").otherwise("string").alias("type"),
            ),
        )

    return F.concat(pairs(KEY_VALUE), pairs(KEY_COLON_VALUE))
