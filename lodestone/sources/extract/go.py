"""Go: structs, interfaces with their methods, other types, functions and methods."""

from __future__ import annotations

import re

from lodestone.sources.extract import Analysis, Symbol
from lodestone.sources.extract.lexer import Source

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S)
_DECL = re.compile(r"^[ \t]*(func|type|import)\b", re.M)
_TYPE = re.compile(r"\s*(\w+)\s*(\[[^\]]*\])?\s*(=)?\s*")
TYPE_CHARS = 40


def exported(name: str) -> str:
    return "public" if name[:1].isupper() else "private"


def _tags(body: str) -> list[str]:
    keys = sorted({k for tag in re.findall(r"`([^`]*)`", body) for k in re.findall(r"(\w+):", tag)})
    return [f"tags:{','.join(keys)}"] if keys else []


def extract(text: str) -> Analysis:
    src, out = Source(text, _HIDDEN), Analysis()
    bare, at = src.bare, 0
    while m := _DECL.search(bare, at):
        at = m.end()
        if m[1] == "import":
            k = at + len(bare[at:]) - len(bare[at:].lstrip(" \t"))
            end = src.end_of(k) if bare[k : k + 1] == "(" else _line_end(bare, k)
            out.imports += re.findall(r'"([^"\n]+)"', text[k : end + 1])
            at = end + 1
        elif m[1] == "func":
            at = _func(src, m.start(), at, out)
        else:
            k = at + len(bare[at:]) - len(bare[at:].lstrip(" \t"))
            if bare[k : k + 1] == "(":
                end, k = src.end_of(k), k + 1
                while k < end:
                    n = _TYPE.match(bare, k, end)
                    if not n:
                        k = _line_end(bare, k) + 1
                        continue
                    k = _type(src, n.start(1), n, out) + 1
                at = end + 1
            elif n := _TYPE.match(bare, k):
                at = _type(src, m.start() + len(m[0]) - len(m[1]), n, out)
    return out


def _line_end(bare: str, at: int) -> int:
    end = bare.find("\n", at)
    return len(bare) if end < 0 else end


def _spec_end(src: Source, at: int) -> int:
    """End of a type or signature: its line's end, past brackets that open in it."""
    i, n = at, len(src.bare)
    while i < n and src.bare[i] != "\n":
        i = src.end_of(i) + 1 if src.bare[i] in "([{" else i + 1
    return i


def _type(src: Source, start: int, m: re.Match[str], out: Analysis) -> int:
    name, body = m[1], m.end()
    end = _spec_end(src, body)
    shown = src.between(body, end).rstrip()
    lines = src.line(start), src.line(end - 1)
    signature = f"type {name} {shown[:TYPE_CHARS]}"
    kind = re.match(r"(struct|interface)\b\s*\{", src.bare[body:end])
    if kind and kind[1] == "struct":
        out.symbols.append(Symbol(name, "struct", exported(name), signature, _tags(shown), [], None, *lines))
    elif kind:
        out.symbols.append(Symbol(name, "interface", exported(name), signature, [], [], None, *lines))
        opening = body + kind.end() - 1
        at, close = opening + 1, src.end_of(opening)
        while at < close:
            stop = min(_spec_end(src, at), close)
            piece = src.between(at, stop).strip()
            if method := re.match(r"(\w+)\s*\(", src.bare[at:stop].strip()):
                out.symbols.append(Symbol(method[1], "method", exported(method[1]), re.sub(r"\s*//[^\n]*$", "", piece).strip(), [], [], name, *lines))
            at = stop + 1
    else:
        out.symbols.append(Symbol(name, "class", exported(name), signature, [], [], None, *lines))
    return end


def _func(src: Source, start: int, at: int, out: Analysis) -> int:
    m = re.compile(r"\s*(\([^)]*\)\s*)?(\w+)\s*(\[[^\]]*\])?\s*\(").match(src.bare, at)
    if not m:
        return at
    opening = m.end() - 1
    params = src.between(opening, src.end_of(opening) + 1)
    body = src.end_of(opening) + 1
    while body < len(src.bare) and src.bare[body] not in "{\n":
        body = src.end_of(body) + 1 if src.bare[body] in "([" else body + 1
    end = src.end_of(body) if src.bare[body : body + 1] == "{" else body - 1
    lines = src.line(start), src.line(max(end, start))
    if m[1]:
        receiver = src.between(m.start(1), m.end(1)).strip()
        words = receiver[1:-1].split()
        parent = re.sub(r"\[.*$", "", words[-1].lstrip("*")) if words else None
        out.symbols.append(Symbol(m[2], "method", exported(m[2]), f"func {receiver} {m[2]}{params}", [], [], parent, *lines))
    else:
        out.symbols.append(Symbol(m[2], "function", exported(m[2]), f"func {m[2]}{params}", [], [], None, *lines))
    return end + 1
