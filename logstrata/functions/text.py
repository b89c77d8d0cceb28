"""Text functions: normalisation, ids, timestamps, units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as variable in a message and its placeholder, applied in this order.
MESSAGE_RULES = [
    (r"\bJID-[a-f0-9]{24}\b", "<JID>"),
    (r"\b[a-f0-9]{32}\b", "<CORRELATION_ID>"),
    (r"\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b", "<UUID>"),
    (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", "<TIMESTAMP>"),
    (r"\(\d+\):", "(<ID>):"),
    (r"\b\d+\.\d+\s*(?:sec|ms|s)\b", "<DURATION>"),
    (r"\b\d{6,}\b", "<ID>"),
]
# How stamps and UUIDs look.
SECONDS_STAMP = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"
UUID = r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"


def normalize_message(message: Column) -> Column:
    for pattern, placeholder in MESSAGE_RULES:
        message = F.regexp_replace(message, pattern, placeholder)
    return message


def error_signature(pattern_id: Column, message: Column) -> Column:
    """Grouping key of an error: pattern id and the message without its variables; of more than 100 characters, the first 100 and the
    hash of all."""
    text = F.regexp_replace(message, SECONDS_STAMP, "TIMESTAMP")
    text = F.regexp_replace(text, UUID, "UUID")
    text = F.regexp_replace(text, r"\b\d+\b", "N")
    short = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("~"), F.md5(text))).otherwise(text)
    return F.concat(pattern_id, F.lit(":"), short)


def match_hash(component: Column, pattern_id: Column, message: Column) -> Column:
    """Hash of component, pattern id and the whole message without its variables."""
    text = F.regexp_replace(message, SECONDS_STAMP, "")
    text = F.regexp_replace(text, UUID, "UUID")
    text = F.regexp_replace(text, r"\b\d+\b", "N")
    return F.substring(F.md5(F.concat_ws(":", component, pattern_id, text)), 1, 16)


def clean_line(content: Column) -> Column:
    """Trim, drop colour codes, collapse blanks."""
    plain = F.regexp_replace(content, r"\x1b\[[0-9;]*m", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def is_variable(value: Column) -> Column:
    """Whether a value looks like an id, a stamp or free text rather than a name."""
    # The longest name, and how ids and stamps begin.
    return (F.length(value) > 40) | value.rlike(r"^[a-fA-F0-9-]{8,}$") | value.rlike(r"^\d{4}-\d{2}-\d{2}")


# ids ----------------------------------------------------------------------------------------------

# Spellings of ids in a line.
NARROW_ID_FORMS = [
    r'"correlation_id"\s*:\s*"([a-f0-9]{32})"',
    r"correlation_id[=:]\s*([a-f0-9]{32})",
    r'"request_id"\s*:\s*"([a-f0-9-]{36})"',
    r"request_id[=:]\s*([a-f0-9-]{36})",
]
WIDE_ID_FORMS = [
    r'"correlation_id"\s*:\s*"([^"]+)"',
    r"correlation_id=([a-zA-Z0-9\-_]+)",
    r'"request_id"\s*:\s*"([^"]+)"',
    r"request_id=([a-zA-Z0-9\-_]+)",
    r'"job_id"\s*:\s*"([^"]+)"',
    r"job_id=([a-zA-Z0-9\-_]+)",
    r'"trace_id"\s*:\s*"([^"]+)"',
    r"RequestId:\s*([a-zA-Z0-9\-_]+)",
    r"X-Request-Id:\s*([a-zA-Z0-9\-_]+)",
    r'"x-request-id"\s*:\s*"([^"]+)"',
]


def correlation_ids(content: Column, wide: bool = False) -> Column:
    """Distinct ids in a line. Wide: any of ten spellings, longer than five characters.

    A spelling is searched for only in lines that hold its name.
    """
    low, none = F.lower(content), F.array().cast("array<string>")

    def ids(form: str) -> Column:
        name = re.match(r'"?([A-Za-z_-]+)', form).group(1)
        word = name.lower() + ("=" if form.startswith(name + "=") else "")
        hit = F.regexp_extract_all(content, F.lit(("(?i)" if wide else "") + form), F.lit(1))
        return F.when(F.contains(low, F.lit(word)), hit).otherwise(none)

    found = F.array_distinct(F.concat(*[ids(form) for form in (WIDE_ID_FORMS if wide else NARROW_ID_FORMS)]))
    return F.filter(found, lambda x: F.length(x) > 5) if wide else found


# timestamps ---------------------------------------------------------------------------------------

def _stamp(text: Column) -> Column:
    """Seconds precision; fractions and zones are cut off."""
    seconds = F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 19)
    return F.try_to_timestamp(F.regexp_replace(seconds, r"\s", " "), F.lit("yyyy-MM-dd HH:mm:ss"))


def extract_ts(content: Column) -> Column:
    """First stamp of a line: bare ISO, then the JSON keys time, timestamp, @timestamp, then bracketed."""
    # Where a line has its stamp, in order.
    forms = [
        rf"({SECONDS_STAMP})",
        r'"time":"([^"]+)"',
        r'"timestamp":"([^"]+)"',
        r'"@timestamp":"([^"]+)"',
        rf"\[({SECONDS_STAMP}[^\]]*)\]",
    ]
    return F.coalesce(*[_stamp(F.regexp_extract(content, p, 1)) for p in forms])


SYSLOG_STAMP = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"


def event_ts(field_values: list[Column], content: Column, year: Column | int = 1970) -> Column:
    """Timestamp of a hit: first usable field, else an ISO stamp in the text, else a syslog date in `year`."""
    # Fixed value: how an ISO stamp looks in a text.
    iso = F.regexp_extract(content, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)", 1)
    year = F.lit(year) if isinstance(year, int) else year
    syslog = F.regexp_replace(F.regexp_extract(content, SYSLOG_STAMP, 1), r"\s+", " ")
    syslog_ts = F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), syslog), F.lit("yyyy MMM d HH:mm:ss"))
    return F.coalesce(*[v.try_cast("timestamp") for v in field_values], iso.try_cast("timestamp"), syslog_ts)


TAI64_OFFSET = (1 << 62) + 10  # epoch label plus the leap seconds of 1970


def tai64n_seconds(hex24: Column) -> Column:
    label = F.conv(F.substring(hex24, 1, 16), 16, 10).cast("decimal(20,0)")
    return (label - F.lit(TAI64_OFFSET).cast("decimal(20,0)")).cast("bigint")


def tai64n_to_ts(content: Column) -> Column:
    """Replace a leading `@<24 digits>` stamp by `[YYYY-MM-DD HH:MM:SS]` in UTC; other lines stay."""
    digits = F.regexp_extract(content, r"^@([0-9a-fA-F]{16})", 1)
    stamp = F.date_format(F.timestamp_seconds(tai64n_seconds(digits)), "yyyy-MM-dd HH:mm:ss")
    rest = F.regexp_replace(F.substring(content, 26, 1 << 30), r"^\s+", "")
    stamped = (F.length(content) > 25) & (digits != "")
    return F.when(stamped, F.concat(F.lit("["), stamp, F.lit("] "), rest)).otherwise(content)


def tai64n_file_ts(name: Column) -> Column:
    """Stamp in a rotated file's name, or "unknown time"."""
    digits = F.regexp_extract(name, r"^@([0-9a-fA-F]{16})", 1)
    stamp = F.date_format(F.timestamp_seconds(tai64n_seconds(digits)), "yyyy-MM-dd HH:mm:ss")
    return F.when(digits != "", stamp).otherwise("unknown time")


# units --------------------------------------------------------------------------------------------

def _number(text: Column) -> Column:
    """A number or null. The empty text is null without a try: a failed cast costs far more than a comparison."""
    return F.nullif(text, F.lit("")).try_cast("double")


def _factors(units: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for name, size in units.items() for x in (name, float(size))])


def parse_duration(text: Column) -> Column:
    """`1h9m20.6s`, `350ms` or a bare number of seconds, as seconds; 0 for anything else."""

    def part(unit: str, name: str) -> Column:
        found = _number(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1))
        return F.when(F.contains(text, F.lit(name)), F.coalesce(found, F.lit(0.0))).otherwise(0.0)

    total = part("h", "h") * 3600 + part("m(?!s)", "m") * 60 + part("s", "s") + part("ms", "ms") / 1000
    bare = _number(F.replace(F.trim(text), F.lit(","), F.lit("")))
    has_unit = F.contains(text, F.lit("h")) | F.contains(text, F.lit("m")) | F.contains(text, F.lit("s"))  # no number has these letters
    return F.when(has_unit, total).otherwise(F.coalesce(bare, F.lit(0.0)))


# Bytes per unit.
BYTE_UNITS = {
    "B": 1, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "TB": 1000**4,
    "KIB": 1024, "MIB": 1024**2, "GIB": 1024**3, "TIB": 1024**4,
}


def parse_bytes(text: Column) -> Column:
    """`5.01 GiB` or `12 MB` as bytes, with 1024 and 1000 units kept apart; 0 without a unit."""
    form = r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?I?B)"
    number = _number(F.regexp_extract(F.upper(text), form, 1))
    factor = F.coalesce(F.try_element_at(_factors(BYTE_UNITS), F.regexp_extract(F.upper(text), form, 2)), F.lit(1.0))
    return F.coalesce(F.floor(number * factor).cast("bigint"), F.lit(0).cast("bigint"))


# Megabytes per unit; M and none are one.
SIZE_UNITS = {"P": 1024.0**3, "T": 1024.0**2, "G": 1024.0, "K": 1 / 1024.0}


def parse_size_mb(text: Column) -> Column:
    """`10G`, `512M`, `2T` or `300K` as megabytes; a bare number already is; 0 for anything else."""
    form = r"^([\d.]+)([KMGTP]?)(?:I?B)?$"
    number = _number(F.regexp_extract(F.upper(F.trim(text)), form, 1))
    factor = F.coalesce(F.try_element_at(_factors(SIZE_UNITS), F.regexp_extract(F.upper(F.trim(text)), form, 2)), F.lit(1.0))
    return F.coalesce(number * factor, F.lit(0.0))


def to_kb(number: Column, unit: Column) -> Column:
    """A memory figure of `top` in kB by the unit of its line (KiB, MiB, GiB)."""
    u = F.lower(F.substring(unit, 1, 1))
    return number * F.when(u == "g", 1024.0 * 1024).when(u == "m", 1024.0).otherwise(1.0)


# Texts that stand for no number.
NO_NUMBER = ["", ".", "..", "-", "--", "N/A", "n/a", "NA", "null", "none"]


def safe_double(text: Column, default: float = 0.0) -> Column:
    """Number of a cell: sentinels give the default, units are dropped, dots after the first are dropped."""
    bare = F.regexp_replace(F.trim(text), r"[^0-9.\-]", "")
    dot = F.instr(bare, ".")
    tail = F.replace(F.substr(bare, dot + 1), F.lit("."), F.lit(""))
    number = F.when(F.contains(text, F.lit(".")), F.concat(F.substr(bare, F.lit(1), dot), tail)).otherwise(bare)
    value = F.when(~F.trim(text).isin(NO_NUMBER), _number(number))
    return F.coalesce(value, F.lit(default))
