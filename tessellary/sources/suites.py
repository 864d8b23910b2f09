"""Test suites, cases and assertions of source files, found on tokens with a stack of scopes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .lexer import Token, brackets, tokens

# Names of the public test frameworks.
SUITES, CASES = {"describe", "context", "suite"}, {"it", "test", "specify"}
MARKS = {"only", "skip", "todo", "each", "concurrent"}
ANNOTATIONS = {"Test", "ParameterizedTest", "RepeatedTest"}

SCHEMA = "path string, ordinal int, kind string, name string, suite string, line int, end_line int, mark string, assertions array<string>"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]


def _unquoted(t: Token) -> str:
    return t.text[1:-1] if t.kind in ("string", "template") else t.text


def _assertion(text: str, found: list[Token], ends: dict[int, int], i: int) -> int:
    """The place after the assertion that begins at ``i``: the call and what is chained to it; ``i`` if none begins there."""
    word = found[i].text
    if found[i].kind != "word" or not (word == "expect" or word.startswith("assert")) or i and found[i - 1].text in (".", "function", "void"):
        return i
    at = i + 1
    while at + 1 < len(found) and found[at].text == ".":
        at += 2
    if at >= len(found) or found[at].text != "(":
        return i
    at = ends[at] + 1
    while at + 1 < len(found) and found[at].text == "." and found[at + 1].kind == "word":
        at += 2
        if at < len(found) and found[at].text == "(":
            at = ends[at] + 1
    return min(at, len(found))


def scopes(text: str, language: str) -> list[tuple]:
    """(kind, name, suite, line, end_line, mark, assertions) of suites and cases in the order of the text; names of outer suites are joined by " > ".

    A call by a suite's or case's name, with or without a mark and with a literal name, opens a scope up to its closing bracket; in
    Java a class is a suite and an annotated method a case. Assertions belong to the innermost case around them.
    """
    found = [t for t in tokens(text, language) if t.kind != "comment"]
    ends = brackets(found)
    rows: list[list] = []
    stack: list[tuple[int, int]] = []  # (where a scope ends, its row)
    annotated = False
    i = 0
    while i < len(found):
        while stack and stack[-1][0] <= i:
            stack.pop()
        t = found[i]
        after = found[i + 1].text if i + 1 < len(found) else ""
        opened = None
        if language == "java":
            if t.text == "@" and after in ANNOTATIONS:
                annotated = True
            elif t.text == "class" and i + 2 < len(found):
                at = next((k for k in range(i + 2, len(found)) if found[k].text == "{"), None)
                opened = ("suite", after, at, "") if at is not None else None
            elif annotated and t.kind == "word" and after == "(" and found[i - 1].text != "@":
                at = next((k for k in range(ends[i + 1] + 1, len(found)) if found[k].text == "{"), None)
                opened, annotated = ("case", t.text, at, "") if at is not None else None, False
        elif t.kind == "word" and t.text in SUITES | CASES and (not i or found[i - 1].text != "."):
            at, mark = i + 1, ""
            while at + 1 < len(found) and found[at].text == "." and found[at + 1].text in MARKS:
                mark, at = found[at + 1].text, at + 2
            if mark == "each" and at < len(found) and found[at].text == "(":
                at = ends[at] + 1
            if at + 1 < len(found) and found[at].text == "(" and found[at + 1].kind in ("string", "template"):
                opened = ("suite" if t.text in SUITES else "case", _unquoted(found[at + 1]), at, mark)
        if opened:
            kind, name, at, mark = opened
            last = found[min(ends[at], len(found) - 1)]
            outer = " > ".join(rows[r][1] for _, r in stack if rows[r][0] == "suite")
            rows.append([kind, name, outer or None, t.line, last.line, mark or None, []])
            stack.append((ends[at], len(rows) - 1))
            i = at + 1
            continue
        n = _assertion(text, found, ends, i)
        if n > i:
            case = next((r for _, r in reversed(stack) if rows[r][0] == "case"), None)
            if case is not None:
                last = found[n - 1]
                rows[case][6].append(" ".join(text[t.start : last.start + len(last.text)].split()))
            i = n
            continue
        i += 1
    return [tuple(r) for r in rows]


def suites(files: DataFrame) -> DataFrame:
    """A row for each suite and case of ``files`` (path, language, content): its name, the suites around it, lines, mark and assertions.

    Files without any, null content and other languages give no row.
    """

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = scopes(content, language) if content and language in ("typescript", "java") else []
                if found:
                    columns = [[path] * len(found), list(range(len(found))), *map(list, zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return files.select(files["path"].cast("string"), "language", "content").mapInArrow(on_partition, SCHEMA)
