"""What files import and export, read from tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import Token, tokens

_LIST = pa.list_(pa.string())
IMPORTS = "path string, ordinal int, source string, specifiers array<string>, is_default boolean, is_namespace boolean, is_external boolean"
EXPORTS = "path string, ordinal int, name string, is_default boolean"


def _named(found: list[Token], i: int) -> tuple[list[tuple[str, str]], int]:
    """(name, alias) pairs between the braces that open at ``i``, and the place after them."""
    out, part = [], []
    i += 1
    while i < len(found):
        if found[i].text in (",", "}"):
            words = [t.text for t in part if t.text != "type" or len(part) == 1]
            if words:
                out.append((words[0].strip("\"'"), words[-1].strip("\"'")))
            part = []
            if found[i].text == "}":
                return out, i + 1
        else:
            part.append(found[i])
        i += 1
    return out, i


def imports_of(text: str, language: str) -> list[tuple]:
    """(source, specifiers, is_default, is_namespace, is_external) of import statements in order; relative and absolute sources are internal."""
    found = [t for t in tokens(text, language) if t.kind != "comment"]
    out, i, depth = [], 0, 0
    while i < len(found):
        t = found[i]
        depth += {"{": 1, "}": -1}.get(t.text, 0) if t.kind == "mark" else 0
        starts = t.text == "import" and not depth and (not i or found[i - 1].text != ".") and i + 1 < len(found) and found[i + 1].text not in ("(", ".")
        i += 1
        if not starts:
            continue
        if language == "java":
            parts = []
            while i < len(found) and found[i].text != ";" and found[i].line == t.line:
                parts.append(found[i].text)
                i += 1
            names = [p for p in parts if p != "static"]
            out.append(("".join(names), [n for n in names[-1:] if n != "*"], False, names[-1:] == ["*"], True))
            continue
        named, default, space = [], False, False
        while i < len(found) and found[i].kind != "string" and found[i].text != ";":
            if found[i].text == "{":
                more, i = _named(found, i)
                named += [name for name, _ in more]
                continue
            space |= found[i].text == "*"
            word = found[i].kind == "word" and found[i].text not in ("from", "as", "type")
            default |= word and found[i - 1].text in ("import", "type")
            i += 1
        if i < len(found) and found[i].kind == "string":
            source = found[i].text[1:-1]
            out.append((source, named, default, space, not source.startswith((".", "/"))))
    return out


def exports_of(text: str) -> list[tuple[str, bool]]:
    """(name, is_default) of export statements: declared names, listed ones by their outer names, and ``default``."""
    found = [t for t in tokens(text) if t.kind != "comment"]
    out, i, depth = [], 0, 0
    while i < len(found):
        t = found[i]
        depth += {"{": 1, "}": -1}.get(t.text, 0) if t.kind == "mark" else 0
        i += 1
        if t.text != "export" or depth or i >= len(found):
            continue
        if found[i].text == "default":
            out.append(("default", True))
        elif found[i].text == "{" or found[i].text == "type" and i + 1 < len(found) and found[i + 1].text == "{":
            more, i = _named(found, i + (found[i].text == "type"))
            out += [(alias, alias == "default") for _, alias in more]
        else:
            while i < len(found) and found[i].text in ("declare", "abstract", "async", "const", "let", "var", "function", "class", "interface", "enum", "type", "namespace", "*"):
                i += 1
            if i < len(found) and found[i].kind == "word" and found[i].text not in ("from", "as"):
                out.append((found[i].text, False))
    return out


def _rows(files: DataFrame, schema: str, types: list[pa.DataType], read) -> DataFrame:  # noqa: ANN001
    names = [x.split()[0] for x in schema.split(", ")]

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = read(content, language) if content else []
                if found:
                    columns = [[path] * len(found), list(range(len(found))), *map(list, zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return files.select(F.col("path").cast("string"), "language", "content").mapInArrow(on_partition, schema)


def imports(files: DataFrame) -> DataFrame:
    """A row for each import of files (path, language, content); null contents and other languages have none."""
    return _rows(files.where("language in ('typescript', 'java')"), IMPORTS, [pa.string(), pa.int32(), pa.string(), _LIST, pa.bool_(), pa.bool_(), pa.bool_()], imports_of)


def exports(files: DataFrame) -> DataFrame:
    """A row for each name that a TypeScript or JavaScript file exports; what ``export *`` hands on isn't named."""
    return _rows(files.where("language = 'typescript'"), EXPORTS, [pa.string(), pa.int32(), pa.string(), pa.bool_()], lambda text, _: exports_of(text))
