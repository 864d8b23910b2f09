"""Scalar functions on text, as columns; patterns are ASCII unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case words: all but ASCII word characters and white space is a separator, single characters go."""
    bare = F.regexp_replace(F.lower(text), r"[^\w\s]", " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) > 1)


def word_set(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets, 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def slug(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 to one dash, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def split_camel(text: Column) -> Column:
    """Words of an identifier: at changes of case, at white space, dashes and underscores."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[\s_-]+"), lambda w: w != "")


def naming_pattern(name: Column) -> Column:
    """The first naming style that fits the whole identifier."""
    styles = (
        ("^[A-Z][a-zA-Z]*$", "PascalCase"), ("^[a-z][a-zA-Z]*$", "camelCase"), ("^[a-z]+(_[a-z]+)*$", "snake_case"),
        ("^[A-Z]+(_[A-Z]+)*$", "UPPER_SNAKE_CASE"), ("^[a-z]+(-[a-z]+)*$", "kebab-case"),
    )
    out = F.when(F.lit(False), F.lit(""))
    for pattern, style in styles:
        out = out.when(name.rlike(pattern), F.lit(style))
    return out.otherwise(F.lit("unknown"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, then an ellipsis if something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def sentences(text: Column, least: int = 0) -> Column:
    """Trimmed parts between runs of . ! and ?, of ``least`` characters at least and never empty."""
    parts = F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (s != "") & (F.length(s) >= least))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!])", r"\\$1")


def escape_xml(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def module_of(path: Column) -> Column:
    """The directory after the first ``src``, else the parent directory, else ``root``."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src")
    inner = F.when((at > 0) & (at + 1 < F.size(parts)), F.element_at(parts, (at + 1).cast("int")))
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.coalesce(inner, F.nullif(parent, F.lit("")), F.lit("root"))


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression of a glob: ** any characters, * none but /, ? one of these."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def keywords(text: Column, stop: tuple[str, ...], most: int = 5) -> Column:
    """The first ``most`` words of over three characters that are no stop words, in order."""
    bare = F.regexp_replace(F.lower(text), r"[^\w\s]", " ")
    kept = F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    return F.slice(kept, 1, most)


def issues(text: Column) -> Column:
    """Issue references in order of kind: #12, then PROJ-12; each once."""
    plain = F.regexp_extract_all(text, F.lit(r"#(\d+)"), F.lit(0))
    project = F.regexp_extract_all(text, F.lit(r"\b([A-Z]+-\d+)\b"), F.lit(1))
    return F.array_distinct(F.concat(plain, project))


def headings(text: Column) -> Column:
    """Texts of Markdown headings of any level."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6} (.+)$"), F.lit(1))


def markdown_links(text: Column) -> Column:
    """Targets of Markdown links."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))


def markdown_to_html(text: Column) -> Column:
    """Headings 1 to 3, bold, emphasis, code and links, in that order."""
    for pattern, new in (
        (r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"(?m)^## (.+)$", "<h2>$1</h2>"), (r"(?m)^# (.+)$", "<h1>$1</h1>"),
        (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), ("`([^`]+)`", "<code>$1</code>"),
        (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace {{name}} by its value (null: empty)."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template
