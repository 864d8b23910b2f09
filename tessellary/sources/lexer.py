"""Tokens of brace languages (TypeScript, JavaScript, Java): what is a string, comment, template or pattern, and which brackets belong together."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, template, pattern, comment, mark
    text: str
    start: int
    line: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\[\s\S])*(?:"|$|(?=\n))|'(?:[^'\\\n]|\\[\s\S])*(?:'|$|(?=\n)))"""
    r"""|(?P<word>[^\W\d][\w$]*|[$#][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|[-+*/%&|^<>=!?]=|\?\.|&&|\|\||\?\?|[\s\S])"""
)
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_BLOCK = re.compile(r'"""[\s\S]*?(?:"""|\Z)')
#: Words after which a slash begins a pattern, as after an operator.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new"}
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def tokens(text: str, language: str = "typescript") -> list[Token]:
    """All tokens of a text but white space, whatever it holds: an unclosed string ends with its line, an unclosed comment or template with the text.

    A template is one token with all it nests, found with a stack of open braces and inner templates.
    """
    breaks = [m.start() for m in re.finditer("\n", text)]
    out: list[Token] = []
    at, last = 0, None
    while at < len(text):
        line = bisect_right(breaks, at - 1) + 1
        kind, found = "", None
        if text[at] == "`" and language != "java":
            kind, end = "template", _template_end(text, at)
        elif text[at] == "/" and language != "java" and (last is None or last.text in _BEFORE_PATTERN or last.kind == "mark" and last.text not in (")", "]", "}")):
            found, kind = _PATTERN.match(text, at), "pattern"
        elif language == "java" and text.startswith('"""', at):
            found, kind = _BLOCK.match(text, at), "string"
        if not kind or kind == "pattern" and (found is None or text[at : at + 2] in ("//", "/*")):
            found = _TOKEN.match(text, at)
            kind = found.lastgroup
        if kind != "template":
            end = found.end()
        if kind != "space":
            out.append(Token(kind, text[at:end], at, line))
            last = out[-1] if kind != "comment" else last
        at = end
    return out


def _template_end(text: str, at: int) -> int:
    """Where the template that begins at ``at`` ends. The stack holds "`" for a template, "{" for a brace inside a nested expression."""
    stack, at = ["`"], at + 1
    while at < len(text) and stack:
        c = text[at]
        if stack[-1] == "`":
            if c == "\\":
                at += 1
            elif c == "`":
                stack.pop()
            elif text.startswith("${", at):
                stack.append("{")
                at += 1
        elif c == "`" or c == "{":
            stack.append(c)
        elif c == "}":
            stack.pop()
        elif c in "\"'":
            at = _TOKEN.match(text, at).end() - 1
        at += 1
    return min(at, len(text))


def brackets(found: list[Token]) -> dict[int, int]:
    """The closing bracket's place for each opening one's, both in the list; one without a partner closes at the end."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for i, t in enumerate(found):
        if t.kind != "mark":
            continue
        if t.text in _CLOSING:
            open_.append(i)
        elif t.text in ")]}":
            match = next((k for k in range(len(open_) - 1, -1, -1) if _CLOSING[found[open_[k]].text] == t.text), None)
            if match is not None:
                out.update((k, i) for k in open_[match:])
                del open_[match:]
    return out | {k: len(found) for k in open_}
