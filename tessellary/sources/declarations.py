"""Declarations with members, parameters, modifiers, decorators and documentation, read from tokens in one Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .lexer import Token, brackets, tokens

# Modifiers of the two languages, and the kinds that their keywords declare.
MODIFIERS = {
    "typescript": {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "get", "set", "accessor"},
    "java": {"public", "private", "protected", "abstract", "static", "final", "synchronized", "native", "transient", "volatile", "strictfp", "default", "sealed"},
}
KINDS = {
    "typescript": {"class": "class", "interface": "interface", "enum": "enum", "function": "function", "type": "type-alias", "const": "constant", "let": "variable", "var": "variable"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "class"},
}
_BINDS = set("=|&:,.?+-*/%<>(") | {"=>", "||", "&&", "??", "extends", "implements", "keyof", "typeof", "new", "in", "of", "is"}
_CONTINUES = set("=|&.?+*/%,)<>:") | {"=>", "||", "&&", "??", "?.", "extends", "is"}

_NAMED = "struct<name:string,type:string,optional:boolean,default:string>"
SCHEMA = (
    "path string, ordinal int, parent int, name string, kind string, line int, end_line int, exported boolean, modifiers array<string>, "
    "decorators array<struct<name:string,arguments:array<string>>>, generics array<struct<name:string,constraint:string,default:string>>, extends array<string>, "
    f"implements array<string>, parameters array<{_NAMED}>, type string, signature string, description string, documentation string"
)
_STRINGS = pa.list_(pa.string())
_TYPES = {
    "path": pa.string(), "ordinal": pa.int32(), "parent": pa.int32(), "name": pa.string(), "kind": pa.string(), "line": pa.int32(), "end_line": pa.int32(), "exported": pa.bool_(),
    "modifiers": _STRINGS, "decorators": pa.list_(pa.struct([("name", pa.string()), ("arguments", _STRINGS)])),
    "generics": pa.list_(pa.struct([("name", pa.string()), ("constraint", pa.string()), ("default", pa.string())])), "extends": _STRINGS, "implements": _STRINGS,
    "parameters": pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("optional", pa.bool_()), ("default", pa.string())])),
    "type": pa.string(), "signature": pa.string(), "description": pa.string(), "documentation": pa.string(),
}


class _Reader:
    """One file's declarations as rows, in the order of the text; members follow what holds them."""

    def __init__(self, path: str, text: str, language: str) -> None:
        self.path, self.text, self.java, self.language = path, text, language == "java", language
        every = tokens(text, language)
        self.tokens = [t for t in every if t.kind != "comment"]
        self.ends, self.size = brackets(self.tokens), len(self.tokens)
        place = {t.start: i for i, t in enumerate(self.tokens)}
        self.docs: dict[int, list[str]] = {}  # documentation comments before a token
        held: list[str] = []
        for t in every:
            if t.kind == "comment":
                held = [*held, t.text] if t.text.startswith("/**") and len(t.text) > 4 else held
                continue
            if held:
                self.docs[place[t.start]], held = held, []
        self.tokens.append(Token("end", "", len(text), every[-1].line if every else 1))
        self.rows: list[dict] = []

    def word(self, i: int) -> str:
        return self.tokens[i].text if i < self.size else ""

    def source(self, i: int, end: int) -> str:
        """The text of tokens i..end-1, white space as one space."""
        if i >= end or i >= self.size:
            return ""
        last = self.tokens[min(end, self.size) - 1]
        return re.sub(r"\s+", " ", self.text[self.tokens[i].start : last.start + len(last.text)])

    def after(self, i: int) -> int:
        """The place after token i, or after the bracket that it opens."""
        return self.ends.get(i, i) + 1

    def angle(self, i: int) -> int:
        """The place after the angle brackets that open at i."""
        depth = 0
        while i < self.size:
            depth += {"<": 1, ">": -1}.get(self.word(i), 0)
            i = self.after(i)
            if depth <= 0:
                break
        return i

    def until(self, i: int, end: int, stops: set[str]) -> int:
        """The first of ``stops`` outside brackets and angle brackets from i on, or ``end``."""
        depth = 0
        while i < end:
            t = self.word(i)
            if depth <= 0 and t in stops:
                return i
            depth += {"<": 1, ">": -1}.get(t, 0)
            i = self.after(i)
        return end

    def parts(self, i: int, end: int) -> list[tuple[int, int]]:
        """Stretches between commas outside brackets; a last empty one is left out."""
        out = []
        while i < end:
            cut = self.until(i, end, {","})
            out.append((i, cut))
            i = cut + 1
        return [p for p in out if p[0] < p[1]]

    def statement_end(self, i: int, end: int) -> int:
        """Where a statement without a block ends: at ; or , outside brackets, or with a line that the next one doesn't carry on."""
        while i < end:
            if self.word(i) in (";", ","):
                return i
            n = self.after(i)
            if self.word(i) == "<" and i and self.tokens[i - 1].kind == "word" and self.tokens[i].start == self.tokens[i - 1].start + len(self.word(i - 1)):
                closed = self.angle(i)  # of a type; a comparison finds no partner
                n = closed if self.word(closed - 1) == ">" else n
            if n >= end or not self.java and self.tokens[n].line > self.tokens[n - 1].line and self.word(n - 1) not in _BINDS and self.word(n) not in _CONTINUES:
                return min(n, end)
            i = n
        return end

    def generics(self, i: int) -> tuple[list[dict] | None, int]:
        if self.word(i) != "<":
            return None, i
        end, out = self.angle(i), []
        for low, high in self.parts(i + 1, end - 1):
            default = self.until(low, high, {"="})
            limit = self.until(low, default, {"extends"})
            out.append({"name": self.source(low, min(limit, low + 1)), "constraint": self.source(limit + 1, default) or None, "default": self.source(default + 1, high) or None})
        return out, end

    def head(self, i: int, end: int) -> tuple[int, list[str], list[dict]]:
        """The place after decorators and modifiers, and these."""
        modifiers, decorators = [], []
        while i < end:
            if self.word(i) == "@" and self.word(i + 1) != "interface":
                n = i + 2
                while self.word(n) == ".":
                    n += 2
                name, arguments = self.source(i + 1, n), []
                if self.word(n) == "(":
                    arguments = [self.source(*p) for p in self.parts(n + 1, self.ends[n])]
                    n = self.after(n)
                decorators.append({"name": name, "arguments": arguments})
                i = n
            elif self.word(i) in MODIFIERS[self.language] and i + 1 < end and self.word(i + 1) not in ("(", "=", ":", ";", "?", ",", *("<" * (not self.java))):
                modifiers.append(self.word(i))
                i += 1
            else:
                break
        return i, modifiers, decorators

    def parameters(self, i: int) -> list[dict]:
        out = []
        for low, high in self.parts(i + 1, self.ends.get(i, i + 1)):
            low, _, _ = self.head(low, high)
            if self.java:
                name = high - 1
                out.append({"name": self.word(name), "type": self.source(low, name) or "Object", "optional": False, "default": None})
                continue
            default = self.until(low, high, {"="})
            kind = self.until(low, default, {":"})
            name = kind - (self.word(kind - 1) == "?")
            optional = name < kind or default < high or self.word(low) == "..."
            out.append({"name": self.source(low + (self.word(low) == "..."), name), "type": self.source(kind + 1, default) or "any", "optional": optional, "default": self.source(default + 1, high) or None})
        return out

    def add(self, first: int, last: int, name: str, kind: str, parent: int | None, modifiers: list[str], decorators: list[dict], **more: object) -> int:
        """A row for tokens first..last, documented by the comment before it."""
        docs = self.docs.get(first, [])
        lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in re.sub(r"^/\*\*|\*/$", "", docs[0 if not self.java else -1]).strip("\n ").split("\n")] if docs else []
        text = "\n".join(lines).strip()
        stop = next((k for k, x in enumerate(lines) if x.lstrip().startswith("@")), len(lines))
        described = text if self.java else "\n".join(lines[:stop]).strip()
        end = self.tokens[min(last, self.size - 1)]
        shown = "export" in modifiers if not self.java else "public" in modifiers
        row = dict.fromkeys(_TYPES) | {
            "path": self.path, "ordinal": len(self.rows), "parent": parent, "name": name, "kind": kind, "line": self.tokens[first].line, "end_line": end.line + end.text.count("\n"),
            "exported": shown, "modifiers": modifiers or None, "decorators": decorators or None, "description": described if docs else None,
            "documentation": ("\n".join(docs) if not self.java else text) if docs else None,
        }
        self.rows.append(row | more)
        return row["ordinal"]

    def heritage(self, i: int) -> tuple[list[str] | None, list[str] | None, int]:
        """Names after extends and implements up to the body's brace, and its place."""
        found: dict[str, list[str]] = {}
        while (key := self.word(i)) in ("extends", "implements", "permits"):
            end = self.until(i + 1, self.size, {"extends", "implements", "permits", "{", ";"})
            found[key] = [self.source(*p) for p in self.parts(i + 1, end)]
            i = end
        return found.get("extends"), found.get("implements"), i

    def block(self, i: int, end: int) -> None:
        """Declarations of a stretch that no class holds; what declares nothing is passed over with its brackets."""
        while i < end:
            n = self.declaration(i, end, None)
            i = n if n > i else self.after(i)

    def declaration(self, first: int, end: int, parent: int | None) -> int:
        """Reads the declaration that begins at ``first``, if one does; returns the place after it, else ``first``."""
        i, modifiers, decorators = self.head(first, end)
        key = self.word(i)
        kind = KINDS[self.language].get(key)
        if self.java and key == "@" and self.word(i + 1) == "interface":
            kind, i = "annotation", i + 1
        if key == "const" and self.word(i + 1) == "enum":
            i, kind = i + 1, "enum"
        named = i + 1 < end and (self.tokens[i + 1].kind == "word" or kind in ("function", "class") and "default" in modifiers or key == "function" and self.word(i + 1) == "*" or kind in ("constant", "variable") and self.word(i + 1) in ("{", "["))
        if kind is None or not named:
            return first
        about = (parent, modifiers, decorators)
        if kind in ("constant", "variable"):
            return self.variables(first, i + 1, end, kind, about)
        at = i + 1 + (self.word(i + 1) == "*")
        if at >= end:
            return first
        anonymous = self.tokens[at].kind != "word" or self.word(at) in ("extends", "implements")
        name = "<anonymous>" if anonymous else self.word(at)
        generics, at = self.generics(at + (not anonymous))
        if kind == "function":
            return self.callable(first, at, end, name, kind, about, generics)
        if kind == "type-alias":
            if self.word(at) != "=":
                return first
            stop = self.statement_end(at + 1, end)
            self.add(first, stop - (stop == end or self.word(stop) != ";"), name, kind, *about, generics=generics, type=self.source(at + 1, stop))
            return stop + (self.word(stop) == ";")
        components = self.parameters(at) if self.word(at) == "(" else None
        at = self.after(at) if components is not None else at
        extends, implements, at = self.heritage(at)
        if self.word(at) != "{":
            return first
        last = self.ends[at]
        own = self.add(first, last, name, kind, *about, generics=generics, extends=extends, implements=implements, parameters=components)
        self.members(at + 1, min(last, end), kind, name, own)
        return last + 1

    def variables(self, first: int, i: int, end: int, kind: str, about: tuple) -> int:
        while True:
            stop = self.statement_end(i, end)
            value = self.until(i, stop, {"="})
            colon = self.until(i, value, {":"})
            about_type = self.source(colon + 1, value) or None
            signature = self.source(i, self.until(value, stop, {"=>"})) if self.word(value + 1) in ("(", "async") else None
            self.add(first, max(i, stop - 1), self.source(i, colon), kind, *about, type=about_type, signature=signature)
            if self.word(stop) != "," or stop + 1 >= end:
                return stop + (self.word(stop) == ";")
            i = stop + 1

    def callable(self, first: int, at: int, end: int, name: str, kind: str, about: tuple, generics: list[dict] | None, returns: str | None = None) -> int:
        """A function or method whose parameters open at ``at``: up to the end of its block, or of its statement if it has none."""
        if self.word(at) != "(":
            return first
        parameters, i = self.parameters(at), self.after(at)
        if self.word(i) == ":":
            low = i + 1
            # a type in braces is passed over, any other brace opens the block
            i = self.statement_end(low, self.until(self.after(low) if self.word(low) == "{" else low, end, {"{", ";", ","}))
            returns = self.source(low, i)
        elif self.java:
            i = self.until(i, end, {"{", ";"})
        head = i
        i = self.after(i) if self.word(i) == "{" else i + (self.word(i) in (";", ","))
        shown = self.source(first, head)
        if kind == "function":
            inner = "" if not generics else "<" + ", ".join(g["name"] + (f" extends {g['constraint']}" if g["constraint"] else "") + (f" = {g['default']}" if g["default"] else "") for g in generics) + ">"
            shown = f"{'' if name == '<anonymous>' else name}{inner}({', '.join(self.source(*p) for p in self.parts(at + 1, self.ends.get(at, at + 1)))}): {returns or 'any'}"
        self.add(first, i - 1, name, kind, *about, parameters=parameters, type=returns, signature=shown, generics=generics)
        return i

    def members(self, i: int, end: int, holder: str, name: str, own: int) -> None:
        if holder == "enum":
            stop = self.until(i, end, {";"}) if self.java else end
            for low, high in self.parts(i, stop):
                at, _, _ = self.head(low, high)
                value = self.source(self.until(low, high, {"="}) + 1, high) or None
                self.add(low, high - 1, self.word(at).strip("\"'"), "enum-member", own, [], [], type=value)
            i = stop + 1
        while i < end:
            n = self.member(i, end, name, own)
            i = n if n > i else self.after(i)

    def member(self, first: int, end: int, holder: str, own: int) -> int:
        nested = self.declaration(first, end, own) if self.java else first
        if nested > first:
            return nested
        i, modifiers, decorators = self.head(first, end)
        if i >= end or self.word(i) in (";", ",", "{", "}"):
            return first
        if self.word(i) == "[" and self.until(i + 1, self.ends[i], {":"}) < self.ends[i]:
            return self.statement_end(i, end)  # an index signature names nothing
        about, generics, returns = (own, modifiers, decorators), None, None
        if self.java:
            generics, i = self.generics(i)
            if self.word(i) == holder and self.word(i + 1) == "(":
                return self.callable(first, i + 1, end, holder, "constructor", about, generics)
            low, i = i, self.until(i, end, {"=", ";", "(", ","}) - 1
            if i <= low or self.tokens[i].kind != "word":
                return first
            returns = self.source(low, i)
            if self.word(i + 1) == "(":
                return self.callable(first, i + 1, end, self.word(i), "method", about, generics, returns)
            stop = self.until(i, end, {";"})
            for k, (a, b) in enumerate(self.parts(i, stop)):
                self.add(first if not k else a, b - 1, self.word(a), "field", *about, type=returns)
            return stop + 1
        i += self.word(i) == "*"
        named = self.source(i, self.after(i)).strip("\"'") if self.word(i) == "[" else self.word(i).strip("\"'")
        at = self.after(i) if self.word(i) == "[" else i + 1
        at += self.word(at) in ("?", "!")
        generics, at = self.generics(at)
        if self.word(at) == "(" and self.tokens[i].text != "(":
            kind = "constructor" if named == "constructor" else "method"
            if {"get", "set"} & set(modifiers):
                kind = "accessor"
            return self.callable(first, at, end, named, kind, about, generics)
        if self.tokens[i].kind not in ("word", "string", "number") or self.word(at) not in (":", "=", ";", ",", "}") and at < end and self.tokens[at].line == self.tokens[at - 1].line:
            return first
        stop = self.statement_end(i, end)
        value = self.until(at, stop, {"="})
        self.add(first, max(i, stop - 1), named, "property", *about, type=self.source(at + 1, value) if self.word(at) == ":" else None)
        return stop + (self.word(stop) in (";", ","))


def declarations(files: DataFrame) -> DataFrame:
    """A row for each declaration of ``files`` (path, language, content), ``parent`` being the ordinal of the one that holds it.

    In TypeScript those of the file's top level and members of their classes, interfaces and enums; in Java nested types too. Types are those
    that the text states (``any`` for a parameter without one), as no type checker runs. Null content and other languages have none; a text that
    is no valid program gives what can be read of it. Columns that don't apply are null.
    """

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if language not in KINDS or not content:
                    continue
                reader = _Reader(path, content, language)
                reader.block(0, reader.size)
                if reader.rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in reader.rows], t) for c, t in _TYPES.items()], list(_TYPES))

    return files.select(files["path"].cast("string"), "language", "content").mapInArrow(on_partition, SCHEMA)


def token_rows(files: DataFrame) -> DataFrame:
    """(path, ordinal, kind, text, line) of every token, comments included."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: list[Token] = tokens(content or "", language or "typescript")
                columns = ([path] * len(found), range(len(found)), [t.kind for t in found], [t.text for t in found], [t.line for t in found])
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["path", "ordinal", "kind", "text", "line"])

    return files.select(files["path"].cast("string"), "language", "content").mapInArrow(on_partition, "path string, ordinal int, kind string, text string, line int")
