"""Predicates over lines with columns `content` and `fields`, as null-safe boolean Columns.

Every leaf is true or false, never null, so `&`, `|` and `~` mean what they say. Negative field tests
(`neq`, `field_not_contains`, `field_not_regex`, `not_in`) are true where the field is missing.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import field, field_is_json_null, resolve_field


def _known(test: Column, missing: bool = False) -> Column:
    return F.coalesce(test, F.lit(missing))


def wildcard(pattern: str) -> str:
    """Anchored, case-insensitive regex of a pattern in which `*` and `?` are wildcards.

    Bracket classes such as `[abc]` stay classes.
    """
    pieces = re.split(r"(\[[^\]]+\]|\*|\?)", pattern)
    kept = {"*": ".*", "?": "."}
    body = "".join(kept.get(p, p if p.startswith("[") and p.endswith("]") and len(p) > 2 else re.escape(p)) for p in pieces)
    return f"(?iu)^{body}$"


def _has_wildcard(value) -> bool:
    return isinstance(value, str) and ("*" in value or "?" in value)


def valid_regex(pattern: str) -> bool:
    """Whether the JVM accepts the pattern; checked once, on the driver."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # PatternSyntaxException, in whichever class the gateway wraps it
        return False


def java_regex(pattern: str) -> str:
    """Named groups in Java spelling."""
    return re.sub(r"\(\?P<([A-Za-z]\w*)>", lambda m: f"(?<{m.group(1).replace('_', '')}>", pattern)


# text of the whole line ---------------------------------------------------------------------------

def contains(text: str) -> Column:
    return _known(F.contains(F.lower("content"), F.lit(text.lower())))


def not_contains(text: str) -> Column:
    return ~contains(text)


def regex(pattern: str) -> Column:
    pattern = "(?iu)" + java_regex(pattern)
    return _known(F.col("content").rlike(pattern)) if valid_regex(pattern) else F.lit(False)


# one field ----------------------------------------------------------------------------------------

def _text(value) -> str:
    return str(value).lower()


def eq(name: str, value) -> Column:
    """Case-insensitive equality; `*` and `?` are wildcards; None matches JSON null only."""
    if value is None or _text(value) == "null":
        return field_is_json_null(name) | _known(F.lower(resolve_field(name)) == "null")
    f = resolve_field(name)
    if _has_wildcard(value):
        return _known(f.rlike(wildcard(value)))
    return _known(F.lower(f) == _text(value))


def neq(name: str, value) -> Column:
    return ~eq(name, value)


def _number(name: str, value, test) -> Column:
    try:
        bound = float(value)
    except (TypeError, ValueError):
        return F.lit(False)
    return _known(test(resolve_field(name).try_cast("double"), F.lit(bound)))


def gt(name: str, value) -> Column:
    return _number(name, value, lambda a, b: a > b)


def gte(name: str, value) -> Column:
    return _number(name, value, lambda a, b: a >= b)


def lt(name: str, value) -> Column:
    return _number(name, value, lambda a, b: a < b)


def lte(name: str, value) -> Column:
    return _number(name, value, lambda a, b: a <= b)


def field_contains(name: str, text: str) -> Column:
    return _known(F.contains(F.lower(resolve_field(name)), F.lit(_text(text))))


def field_not_contains(name: str, text: str) -> Column:
    return ~field_contains(name, text)


def field_regex(name: str, pattern: str) -> Column:
    pattern = "(?iu)" + java_regex(pattern)
    return _known(resolve_field(name).rlike(pattern)) if valid_regex(pattern) else F.lit(False)


def field_not_regex(name: str, pattern: str) -> Column:
    return ~field_regex(name, pattern)


def is_in(name: str, values: list) -> Column:
    f = resolve_field(name)
    exact = [_text(v) for v in values if not _has_wildcard(v)]
    wild = [wildcard(v) for v in values if _has_wildcard(v)]
    tests = [F.lower(f).isin(exact)] if exact else []
    tests += [f.rlike("|".join(f"(?:{w})" for w in wild))] if wild else []
    return _known(reduce(or_, tests)) if tests else F.lit(False)


def not_in(name: str, values: list) -> Column:
    return ~is_in(name, values)


def exists(name: str) -> Column:
    return resolve_field(name).isNotNull() | field_is_json_null(name)


def not_exists(name: str) -> Column:
    return ~exists(name)


# trees --------------------------------------------------------------------------------------------

def all_of(*parts: Column) -> Column:
    """Conjunction; an empty tree matches nothing. Put cheap tests first: they run first."""
    return reduce(and_, parts) if parts else F.lit(False)


def any_of(*parts: Column) -> Column:
    return reduce(or_, parts) if parts else F.lit(False)


def negate(part: Column) -> Column:
    return ~part


def json_condition(tree: dict) -> Column:
    """Condition tree of dicts: TEXT, AND, OR, NOT, FIELD_EQ, FIELD_NEQ, FIELD_GT, FIELD_GTE, FIELD_LT, FIELD_LTE.

    Field tests hold only on JSON lines that have the field, also the negative one.
    """
    kind = tree["type"]
    if kind == "TEXT":
        return contains(tree["value"])
    if kind in ("AND", "OR"):
        parts = [json_condition(c) for c in tree["children"]]
        return all_of(*parts) if kind == "AND" else any_of(*parts)
    if kind == "NOT":
        return negate(json_condition(tree["child"]))
    f, value = field(tree["field"]), tree["value"]
    if kind == "FIELD_EQ":
        return _known(F.lower(f) == _text(value))
    if kind == "FIELD_NEQ":
        return _known(F.lower(f) != _text(value))
    tests = {
        "FIELD_GT": lambda a: a > float(value),
        "FIELD_GTE": lambda a: a >= float(value),
        "FIELD_LT": lambda a: a < float(value),
        "FIELD_LTE": lambda a: a <= float(value),
    }
    return _known(tests[kind](f.try_cast("double")))


def service_is(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files whose service matches any pattern: `rails`, `*worker*`, or `service:file-part`."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    bare = F.replace(name, F.lit(".log"), F.lit(""))

    def one(pattern: str) -> Column:
        service, _, part = pattern.partition(":")
        matches = F.col("service").rlike(wildcard(service)) if _has_wildcard(service) else F.col("service") == service
        if not part:
            return matches
        if _has_wildcard(pattern):
            return matches & (name.rlike(wildcard(part)) | bare.rlike(wildcard(part)))
        part = part.lower()
        squeezed = F.replace(bare, F.lit("_"), F.lit(""))
        return matches & (F.contains(name, F.lit(part)) | F.contains(squeezed, F.lit(part.replace("_", "").replace(".log", ""))))

    every = [p.strip() for pattern in patterns for p in pattern.split(",")]
    return files.where(_known(any_of(*[one(p) for p in every])))
