"""Column expressions on text: identity, names, escapes, durations. All run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script; Java's \s alone holds the ASCII ones.
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def canonical(x: Column) -> Column:
    """Small letters, one space for every run of white space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), f"{WS}+", " "), "^ +| +$", "")


def slug(x: Column) -> Column:
    """canonical() without all but ASCII letters, digits and blanks; hyphens for blanks. Names of other scripts give an empty slug."""
    return F.regexp_replace(F.regexp_replace(canonical(x), "[^a-z0-9 ]", ""), " +", "-")


def type_prefix(kind: Column) -> Column:
    return F.regexp_replace(F.lower(kind), "[^a-z0-9]", "")


def stable_id(kind: Column, name: Column) -> Column:
    """The identity of an entity: type prefix, hyphen, slug of the name."""
    return F.concat(type_prefix(kind), F.lit("-"), slug(name))


def edge_key(kind: Column, src: Column, dst: Column) -> Column:
    """The full identity of an edge, 64 hex digits; edges are grouped on it."""
    return F.sha2(F.concat(kind, F.lit("|"), src, F.lit("|"), dst), 256)


def edge_id(key: Column, digits: int = 6) -> Column:
    """The short name of an edge. Six digits collide above some 4,000 edges, so it is for show; longer ones are for storage."""
    return F.concat(F.lit("edge-"), F.substring(key, 1, digits))


def task_id(system: Column, user: Column, label: Column) -> Column:
    """Content hash of a request, under which its answer is remembered."""
    return F.sha2(F.concat(system, F.lit("\n--user--\n"), user, F.lit("\n--ctx--\n"), label), 256)


def clamp(x: Column) -> Column:
    """A confidence within 0..1: what is no number counts 0; NaN, which orders above all numbers, counts 1."""
    plain = F.when(x.cast("string").rlike(r"(?i)^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf(inity)?)\s*$"), x.cast("string").try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(plain, F.lit(0.0))))


def snake(x: Column) -> Column:
    """Camel humps, blanks and hyphens to underscores, small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-_]+", "_"))


def name_parts(x: Column) -> Column:
    """The words of an identifier: runs of letters or of digits, cut where a small letter meets a capital and before the last capital of an acronym that a word follows."""
    for border in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        x = F.regexp_replace(x, border, "$1 $2")
    return F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda p: p != "")


def label_name(x: Column) -> Column:
    """PascalCase of a type, for node labels, without the digits it starts with; empty where nothing is left."""
    parts = F.filter(name_parts(F.regexp_replace(x, "^[^A-Za-z]+", "")), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def relation_name(x: Column) -> Column:
    """SCREAMING_SNAKE of a property, for relation types."""
    return F.array_join(F.transform(name_parts(x), F.upper), "_")


def turtle_local(x: Column) -> Column:
    """A name as a local name in Turtle: letters, digits, underscores and hyphens stay."""
    return F.regexp_replace(x, "[^A-Za-z0-9_-]", "_")


def turtle_text(x: Column) -> Column:
    """A literal's text with backslashes, quotes and line ends escaped."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def html_text(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def attribute_key(x: Column) -> Column:
    """An attribute's name as the formats with plain keys allow it."""
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def file_slug(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\:]", "_")


def without_counter(stem: Column) -> Column:
    """A file's stem without the counter it ends in."""
    return F.regexp_replace(stem, r"[_\- ]*\d+$", "")


def without_fence(answer: Column) -> Column:
    """What stands inside a Markdown code fence, or all of it where there is none."""
    inner = F.regexp_extract(answer, r"(?s)```[a-zA-Z]*\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.when(answer.contains("```"), inner).otherwise(answer), f"^{WS}+|{WS}+$", "")


def seconds_of(clock: Column) -> Column:
    """HH:MM:SS in seconds."""
    p = F.split(clock, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def duration(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    h, m, s = (seconds / 3600).cast("int"), ((seconds % 3600) / 60).cast("int"), (seconds % 60).cast("int")
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def display_name(attributes: Column, other: Column) -> Column:
    """The name of a node: its name, else subject, else title, else `other`. Empty ones count as missing."""
    got = lambda k: F.nullif(F.try_element_at(attributes, F.lit(k)).getField("value"), F.lit(""))
    return F.coalesce(got("name"), got("subject"), got("title"), other)
