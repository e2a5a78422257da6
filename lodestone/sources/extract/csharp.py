"""C#: classes, interfaces, structs, enums and their methods, constructors, properties and fields."""

from __future__ import annotations

import re

from lodestone.sources.extract import Analysis, Symbol
from lodestone.sources.extract.lexer import Source, split_top

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\$?@\$?\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|^[ \t]*#[^\n]*", re.S | re.M)
MODIFIERS = r"(?:public|private|protected|internal|static|abstract|sealed|partial|virtual|override|async|readonly|const|extern|unsafe|new|volatile|required|file|ref)"
_USING = re.compile(r"(?:global\s+)?using\s+[^;(]+;")
_SPACE = re.compile(r"namespace\s+[\w.]+\s*[{;]")
_TYPE = re.compile(rf"(?P<mods>(?:{MODIFIERS}\s+)*)(?P<kind>class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(?P<name>\w+)")
_METHOD = re.compile(rf"(?P<mods>(?:{MODIFIERS}\s+)*)(?:(?P<ret>[\w.?<>\[\],\s()]*?[\w?>\])])\s+)?(?P<name>\w+)\s*(?:<[^()<>]*>)?\s*\(")
_PROPERTY = re.compile(rf"(?P<mods>(?:{MODIFIERS}\s+)*)(?P<type>[\w.?<>\[\],\s]*?[\w?>\]])\s+(?P<name>\w+)\s*(?:\{{|=>)")
_FIELD = re.compile(rf"(?P<mods>(?:{MODIFIERS}\s+)*)(?:event\s+)?(?P<type>[\w.?<>\[\],\s]*?[\w?>\]])\s+(?P<name>\w+)\s*(?:=(?!>)|;|,)")
#: Bodies' words that no member is named.
KEYWORDS = {"if", "for", "foreach", "while", "switch", "using", "lock", "return", "catch", "new", "throw", "await", "get", "set", "base", "this", "where"}


def extract(text: str) -> Analysis:
    src, out = Source(text, _HIDDEN), Analysis()
    _body(src, 0, len(text), None, "", out)
    return out


def _visibility(mods: str, default: str) -> str:
    for v in ("public", "private", "protected", "internal"):
        if re.search(rf"\b{v}\b", mods):
            return v
    return default


def _end(src: Source, at: int, hi: int) -> int:
    """End of a member: its body's brace, or its semicolon."""
    i = at
    while i < hi:
        c = src.bare[i]
        if c == "{":
            close = src.end_of(i)
            m = re.compile(r"\s*=[^=>]").match(src.bare, close + 1, hi)  # a property with an initial value
            if not m:
                return close
            i = close
        elif c in "([":
            i = src.end_of(i)
        elif c == ";":
            return i
        i += 1
    return hi - 1


def _body(src: Source, lo: int, hi: int, parent: str | None, kind: str, out: Analysis) -> None:
    at, attributes = lo, []
    start = None
    while at < hi:
        c = src.bare[at]
        if c.isspace() or c in ";}":
            at += 1
            continue
        start = at if start is None else start
        if c == "[":
            close = src.end_of(at)
            if m := re.match(r"\s*(?:assembly|module)\s*:", src.bare[at + 1 : close]):
                del m
            else:
                attributes += split_top(src.text[at + 1 : close], src.bare[at + 1 : close])
            at = close + 1
            continue
        if m := _USING.match(src.bare, at, hi):
            out.imports.append(src.between(at, m.end()).strip())
            at = m.end()
        elif m := _SPACE.match(src.bare, at, hi):
            if m[0].endswith("{"):
                _body(src, m.end(), src.end_of(m.end() - 1), None, "", out)
                at = src.end_of(m.end() - 1) + 1
            else:
                at = m.end()
        elif m := _TYPE.match(src.bare, at, hi):
            at = _type(src, m, attributes, parent, start, hi, out)
        elif parent is not None and kind != "enum":
            at = _member(src, at, hi, parent, kind, attributes, start, out)
        else:
            at = _end(src, at, hi) + 1
        attributes, start = [], None


def _type(src: Source, m: re.Match[str], attributes: list[str], parent: str | None, start: int, hi: int, out: Analysis) -> int:
    kind = m["kind"].split()[0]
    kind = ("struct" if m["kind"].endswith("struct") else "class") if kind == "record" else kind
    name = m["name"]
    end = _end(src, m.end(), hi)
    body = src.bare.find("{", m.end(), end + 1)
    head_end = body if body >= 0 else end
    head = src.bare[m.end() : head_end]
    colon = re.search(r"(?<!:):(?!:)", re.sub(r"\([^)]*\)", lambda x: " " * len(x[0]), head))
    bases = []
    if colon:
        listed = src.text[m.end() + colon.end() : head_end]
        listed = re.split(r"\bwhere\b", listed)[0]
        bases = [re.sub(r"\(.*$", "", b, flags=re.S).strip() for b in split_top(listed, listed)]
    default = "private" if parent else "internal"
    visible = "public" if kind == "interface" and not re.search(r"\b(?:private|protected|internal)\b", m["mods"]) else _visibility(m["mods"], default)
    signature = f"{visible} {kind} {name}" + (f" : {', '.join(bases)}" if bases else "")
    out.symbols.append(Symbol(name, kind, visible, signature, attributes, bases if kind in ("class", "struct") else [], parent, src.line(start), src.line(end)))
    if body >= 0 and kind != "enum":
        _body(src, body + 1, src.end_of(body), name, kind, out)
    return end + 1


def _member(src: Source, at: int, hi: int, parent: str, kind: str, attributes: list[str], start: int, out: Analysis) -> int:
    end = _end(src, at, hi)
    lines = src.line(start), src.line(end)
    default = "public" if kind == "interface" else "private"
    m = _METHOD.match(src.bare, at, hi)
    if m and m["name"] not in KEYWORDS and m.end() <= end + 1 and "=" not in src.bare[at : m.end()]:
        params = re.sub(r"\s+", " ", src.between(m.end() - 1, src.end_of(m.end() - 1) + 1))
        visible = _visibility(m["mods"], default)
        if m["name"] == parent and not (m["ret"] or "").strip():
            out.symbols.append(Symbol(m["name"], "constructor", visible, f"{visible} {m['name']}{params}", attributes, [], parent, *lines))
            return end + 1
        if (m["ret"] or "").strip():
            returns = re.sub(r"\s+", " ", m["ret"].strip())
            out.symbols.append(Symbol(m["name"], "method", visible, f"{visible} {returns} {m['name']}{params}", attributes, [], parent, *lines))
            return end + 1
    if (m := _PROPERTY.match(src.bare, at, hi)) and m["name"] not in KEYWORDS:
        visible = _visibility(m["mods"], default)
        out.symbols.append(Symbol(m["name"], "property", visible, f"{visible} {' '.join(m['type'].split())} {m['name']}", attributes, [], parent, *lines))
    elif (m := _FIELD.match(src.bare, at, hi)) and m["name"] not in KEYWORDS:
        visible = _visibility(m["mods"], default)
        out.symbols.append(Symbol(m["name"], "field", visible, f"{visible} {' '.join(m['type'].split())} {m['name']}", attributes, [], parent, *lines))
    return end + 1
