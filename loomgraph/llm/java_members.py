"""A small lexer for the members of Java types: which methods stand where, and under which documentation."""

from __future__ import annotations

import re
from typing import NamedTuple

_SKIPPED = r'/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?'
#: Within a body only braces count; among members also names and what separates them.
_IN_BODY = re.compile(rf"(?P<skip>{_SKIPPED})|[{{}}]")
_IN_TYPE = re.compile(rf"(?P<skip>{_SKIPPED})|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|[{{}}()\[\];,=@.<>]")
_TYPE_WORDS = {"class", "interface", "enum", "record"}
_CONTROL = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "throw", "else", "do", "super", "this"}


class Member(NamedTuple):
    """A method or constructor with a body."""

    name: str
    line: int  # on which the name stands, from 1; lines end with \n
    start: int  # offset of its declaration, annotations included
    end: int  # offset after its body
    params: tuple[str, ...]
    owner: str  # the type around it, '' if there is none
    doc: str | None  # the whole comment, with its signs
    closed: bool  # its body ends


class _Open(NamedTuple):
    kind: str  # 'type', 'enum' or 'record'
    name: str


def _annotation_end(tokens: list[tuple[str, int]], i: int) -> int:
    """The index after the annotation that begins at ``i``."""
    i += 2
    while i + 1 < len(tokens) and tokens[i][0] == ".":
        i += 2
    if i < len(tokens) and tokens[i][0] == "(":
        depth = 0
        while i < len(tokens):
            depth += {"(": 1, ")": -1}.get(tokens[i][0], 0)
            i += 1
            if not depth:
                break
    return i


def _is_annotation(tokens: list[tuple[str, int]], i: int) -> bool:
    return tokens[i][0] == "@" and i + 1 < len(tokens) and tokens[i + 1][0] != "interface"


def _header(tokens: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The header without its annotations; an annotation type's ``@`` goes, too."""
    out, i = [], 0
    while i < len(tokens):
        if _is_annotation(tokens, i):
            i = _annotation_end(tokens, i)
        else:
            if tokens[i][0] != "@" or i + 1 == len(tokens):
                out.append(tokens[i])
            i += 1
    return out


def _only_annotations(tokens: list[tuple[str, int]], done: int) -> tuple[bool, int]:
    """Are there only annotations, and up to which index is that settled? Up to ``done`` it is known, so that each token is looked at about once."""
    i = done
    while i < len(tokens) and _is_annotation(tokens, i):
        done, i = i, _annotation_end(tokens, i)
    return i >= len(tokens), done


def _params(tokens: list[tuple[str, int]]) -> tuple[str, ...]:
    """Names of the parameters: the last name of each part between commas that stand outside of < > and ( )."""
    names, depth, last = [], 0, ""
    for t, _ in tokens:
        if t in "(<[" and t:
            depth += 1
        elif t in ")>]" and t:
            depth -= 1
        elif t == "," and depth == 0:
            names.append(last)
        elif depth == 0 and t not in ",.=@;":
            last = t
    return tuple(n for n in [*names, last] if n)


def members(source: str, in_type: bool = False) -> tuple[list[Member], bool]:
    """Methods and constructors with a body, in the order in which they begin, and whether there is any doc comment.

    ``in_type``: the source is what stands within a type (single methods). What stands in strings, characters, text
    blocks and comments is no code. Members of types within a body (local and anonymous classes) are part of that
    body. A source that ends within a body gives a member that isn't closed.
    """
    found: list[Member] = []
    stack: list[_Open] = [_Open("type", "")] if in_type else []
    header: list[tuple[str, int]] = []
    doc, any_doc, constants, paren, pos = None, False, False, 0, 0
    settled, line, counted = 0, 1, 0  # of the header; of the newlines up to an offset
    n = len(source)

    def body_end(at: int) -> tuple[int, bool]:
        nonlocal any_doc
        depth = 1
        while True:
            m = _IN_BODY.search(source, at)
            if m is None:
                return n, False
            at = m.end()
            if m.lastgroup:
                if m[0].startswith("/**") and len(m[0]) > 4:
                    any_doc = True
                continue
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return at, True

    while m := _IN_TYPE.search(source, pos):
        text, pos = m[0], m.end()
        if m.lastgroup == "skip":
            if text.startswith("/**") and len(text) > 4:
                any_doc = True
            if not paren and text.startswith("/*"):
                only, settled = _only_annotations(header, settled)
                if only:
                    doc = text if text.startswith("/**") and len(text) > 4 else None  # another kind of comment stands between
            continue
        if text == "(":
            paren += 1
        elif text == ")":
            paren = max(0, paren - 1)
        if text == "{" and not paren:
            tokens = _header(header)
            words = [t for t, _ in tokens]
            first = words.index("(") if "(" in words else len(words)
            kind = next((i for i, w in enumerate(words[: first + 1]) if w in _TYPE_WORDS and i + 1 < len(words) and (i + 1 < first or w != "record") and re.match(r"[^\W\d]|\$", words[i + 1])), None)
            if kind is None and "record" in words[:first] and words.index("record") + 2 == first:
                kind = words.index("record")
            equals = "=" in words[:first]
            record = bool(stack) and stack[-1].kind == "record" and words and words[-1] == stack[-1].name and first == len(words)
            if kind is not None:
                stack.append(_Open(words[kind] if words[kind] in ("enum", "record") else "type", words[kind + 1]))
                constants = words[kind] == "enum"
            elif constants and stack and stack[-1].kind == "enum":
                stack.append(_Open("type", words[first - 1] if first else ""))
                constants = False
            elif stack and (record or (0 < first < len(words) and not equals and re.match(r"[^\W\d]|\$", words[first - 1]) and words[first - 1] not in _CONTROL)):
                at = len(words) - 1 if record else first - 1
                depth, close = 0, first
                for close in range(first, len(words)):
                    depth += {"(": 1, ")": -1}.get(words[close], 0)
                    if not depth:
                        break
                end, closed = body_end(pos)
                name, offset = tokens[at]
                line, counted = line + source.count("\n", counted, offset), offset  # members come in their order
                found.append(Member(name, line, header[0][1], end, _params(tokens[first + 1 : close]), stack[-1].name, doc, closed))
                pos = end
            else:
                pos, _ = body_end(pos)
                if equals:
                    header.append(("=", pos))  # the declaration goes on to its semicolon
                    continue
            header, doc, paren, settled = [], None, 0, 0
        elif text == "}" and not paren:
            if len(stack) > in_type:
                left = stack.pop()
                constants = bool(stack) and stack[-1].kind == "enum" and left.kind == "type" and left.name.isupper()
            header, doc, settled = [], None, 0
        elif text == ";" and not paren:
            header, doc, constants, settled = [], None, False, 0
        elif text == "," and not paren and constants and stack and stack[-1].kind == "enum":
            header, doc, settled = [], None, 0
        else:
            header.append((text, m.start()))
    return found, any_doc
