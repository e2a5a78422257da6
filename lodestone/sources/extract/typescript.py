"""TypeScript and JavaScript: classes with their methods, interfaces, functions, arrow functions, exports."""

from __future__ import annotations

import re

from lodestone.sources.extract import Analysis, Symbol
from lodestone.sources.extract.lexer import Source, split_top

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{}\n])[ \t]*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[gimsuyd]*", re.S)
_DECL = re.compile(
    r"(?P<import>\bimport\b[^;\n]*)|(?P<class>\b(?:abstract\s+)?class\s+(?P<cname>[\w$]+))|(?P<iface>\binterface\s+(?P<iname>[\w$]+))"
    r"|(?P<func>\b(?:async\s+)?function\s*\*?\s*(?P<fname>[\w$]+)\s*(?:<[^()]*>)?\s*\()|(?P<const>\b(?:const|let|var)\s+(?P<vname>[\w$]+)\s*(?::[^=;\n]+)?=\s*)|(?P<open>[{(\[])|(?P<list>\bexport\s*\{)"
)
_MEMBER = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|async|abstract|override|readonly|get|set|declare)\s+)*)\*?\s*(?P<name>#?[\w$]+)\s*\??\s*(?:<[^(){};=]*>)?\s*\(")
_ARROW = re.compile(r"(?:async\s*)?(?:<[^>()]*>\s*)?(?:[\w$]+\s*=>|\()")
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "with", "do", "else", "new", "await", "typeof"}


def extract(text: str) -> Analysis:
    src, out = Source(text, _HIDDEN), Analysis()
    _scan(src, 0, len(text), out)
    return out


def _decorators(src: Source, at: int, floor: int) -> list[str]:
    """Decorators right before ``at``, in order."""
    found: list[str] = []
    while True:
        head = src.bare[floor:at].rstrip()
        end = floor + len(head)
        k = end
        if head.endswith(")"):
            opening = next((o for o, c in src.close.items() if c == end - 1), None)
            if opening is None:
                return found[::-1]
            k = opening
        m = re.search(r"@([\w$.]+)\s*$", src.bare[floor:k])
        if not m:
            return found[::-1]
        at = floor + m.start()
        found.append(src.between(at + 1, end))


def _exported(src: Source, at: int, floor: int) -> tuple[int, bool]:
    """Where a declaration with its ``export default`` starts, and whether it is exported."""
    m = re.search(r"\bexport\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?$", src.bare[floor:at])
    return (floor + m.start(), True) if m else (at, False)


def _scan(src: Source, lo: int, hi: int, out: Analysis) -> None:
    at = floor = lo
    while m := _DECL.search(src.bare, at, hi):
        at = m.end()
        if m["import"]:
            out.imports.append(src.between(m.start(), m.end()).strip())
        elif m["list"]:
            end = src.end_of(m.end() - 1)
            out.exports += [p.split(" as ")[-1].strip() for p in split_top(src.text[m.end() : end], src.bare[m.end() : end])]
            at = end + 1
        elif m["open"]:
            at = src.end_of(m.start()) + 1  # bodies and arguments are not entered
            if re.search(r"@[\w$.]+\s*$", src.bare[floor : m.start()]):
                continue  # a decorator's arguments: it belongs to what follows
        elif m["class"]:
            at = _class(src, m, floor, out)
        elif m["iface"]:
            start, public = _exported(src, m.start(), floor)
            body = src.bare.find("{", m.end())
            end = src.end_of(body) if body >= 0 else m.end()
            out.symbols.append(Symbol(m["iname"], "interface", "public", f"interface {m['iname']}", [], [], None, src.line(m.start()), src.line(end)))
            if public:
                out.exports.append(m["iname"])
            at = end + 1
        elif m["func"]:
            start, public = _exported(src, m.start(), floor)
            params, returns, body = _head(src, m.end() - 1, hi)
            end = src.end_of(body) if src.bare[body : body + 1] == "{" else body
            out.symbols.append(Symbol(m["fname"], "function", "public", f"function {m['fname']}{params}{returns}", [], [], None, src.line(m.start()), src.line(end)))
            if public:
                out.exports.append(m["fname"])
            at = end + 1
        elif m["const"]:
            start, public = _exported(src, m.start(), floor)
            if public:
                out.exports.append(m["vname"])
            arrow = _ARROW.match(src.bare, m.end())
            if arrow and _is_arrow(src, arrow):
                end = _statement_end(src, m.end(), hi)
                out.symbols.append(Symbol(m["vname"], "function", "public", f"const {m['vname']} = ...", [], [], None, src.line(m.start()), src.line(end)))
                at = end + 1
        floor = at if not m["import"] else floor


_RETURNS = re.compile(r"\s*(?::[^=;{]+)?=>")


def _is_arrow(src: Source, m: re.Match[str]) -> bool:
    if m[0].endswith("=>"):
        return True
    return bool(_RETURNS.match(src.bare, src.end_of(m.end() - 1) + 1))


def _statement_end(src: Source, at: int, hi: int) -> int:
    i = at
    while i < hi:
        c = src.bare[i]
        if c in "([{":
            i = src.end_of(i)
            if c == "{" and not re.match(r"\s*(?:=>|\.|\()", src.bare[i + 1 : i + 40]):
                return i
        elif c == ";":
            return i
        elif c == "\n" and not re.match(r"\s*(?:=>|[.?:+*/|&,({\[])", src.bare[i + 1 : i + 60]) and not re.search(r"(?:=>|[=(,:?+|&])\s*$", src.bare[at:i]):
            return i
        i += 1
    return hi - 1


def _head(src: Source, opening: int, hi: int) -> tuple[str, str, int]:
    """Parameters, return type, and where the body (or the end) is, of what has its parenthesis at ``opening``."""
    close = src.end_of(opening)
    i = close + 1
    m = re.compile(r"\s*:").match(src.bare, i, hi)
    if not m:
        body = re.compile(r"[{;\n]").search(src.bare, i, hi)
        return src.between(opening, close + 1), "", body.start() if body else hi
    j = m.end()
    while j < hi:
        c = src.bare[j]
        if c == "{" and src.bare[m.end() : j].strip() and not re.search(r"[|&<,:]\s*$", src.bare[m.end() : j]):
            break
        if c in "([{":
            j = src.end_of(j)
        elif c in ";\n}":
            break
        j += 1
    return src.between(opening, close + 1), src.between(m.end() - 1, j).rstrip(), j


def _class(src: Source, m: re.Match[str], floor: int, out: Analysis) -> int:
    name = m["cname"]
    body = src.bare.find("{", m.end())
    if body < 0:
        return m.end()
    head = src.text[m.end() : body]
    head = re.sub(r"^\s*<[^{}]*?>(?=\s*(?:extends|implements|$))", "", head)
    extends = re.search(r"\bextends\s+(.+?)(?=\s+implements\b|$)", head, re.S)
    implements = re.search(r"\bimplements\s+(.+)$", head, re.S)
    listed = split_top(implements[1], implements[1]) if implements else []
    signature = f"class {name}" + (f" extends {extends[1].strip()}" if extends else "")
    start, public = _exported(src, m.start(), floor)
    end = src.end_of(body)
    out.symbols.append(Symbol(name, "class", "public", signature, _decorators(src, start, floor), listed, None, src.line(m.start()), src.line(end)))
    if public:
        out.exports.append(name)
    at = inner = body + 1
    while at < end:
        c = src.bare[at]
        if c.isspace() or c == ";":
            at += 1
            continue
        if c == "@":
            n = re.compile(r"@[\w$.]+\s*").match(src.bare, at)
            at = n.end() if n else at + 1
            if src.bare[at : at + 1] == "(":
                at = src.end_of(at) + 1
            continue
        n = _MEMBER.match(src.bare, at, end)
        if n and n["name"] not in KEYWORDS:
            params, returns, stop = _head(src, n.end() - 1, end)
            last = src.end_of(stop) if src.bare[stop : stop + 1] == "{" else stop - 1
            access = re.search(r"\b(public|private|protected)\b", n["mods"])
            visible = access[1] if access else ("private" if n["name"].startswith("#") else "public")
            if src.bare[stop : stop + 1] == "{" or "abstract" in n["mods"]:
                out.symbols.append(Symbol(n["name"], "method", visible, f"{n['name']}{params}{returns}", _decorators(src, at, inner), [], name, src.line(at), src.line(last)))
            at = max(last, n.end()) + 1
        else:
            at = _statement_end(src, at, end) + 1
        inner = at
    return end + 1
