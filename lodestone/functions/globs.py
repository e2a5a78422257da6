"""Globs and ignore files, compiled on the driver to regular expressions without look-around."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.paths import C, col, posix

NEVER = r"[^\s\S]"


def _class_at(glob: str, i: int) -> tuple[str, int]:
    """The bracket expression at ``i`` and where it ends, or a literal bracket."""
    end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in "!^" else i + 1 + (glob[i + 1 : i + 2] == "]"))
    if end < 0:
        return r"\[", i + 1
    body = glob[i + 1 : end]
    negated = body[:1] in ("!", "^")
    body = re.sub(r"([\\\[\]^&])", r"\\\1", body[1:] if negated else body)
    return f"[{'^' if negated else ''}{body}]", end + 1


def shell_regex(glob: str) -> str:
    """A shell pattern where ``*`` and ``?`` also cross ``/``, as an unanchored expression."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "[":
            part, i = _class_at(glob, i)
        else:
            part = {"*": r"[\s\S]*", "?": r"[\s\S]"}.get(glob[i]) or re.escape(glob[i])
            i += 1
        out.append(part)
    return "".join(out)


def any_of(parts: list[str]) -> str:
    return rf"^(?:{'|'.join(parts)})\z" if parts else NEVER


def exclude_parts(globs: list[str] | tuple[str, ...]) -> tuple[list[str], list[str], list[str]]:
    """Expressions for whole paths, expressions for single components, and strings to look for in ``/path/``.

    A glob stands for whole paths; stripped of ``**/`` before and ``/**`` behind it also
    stands for a component if no slash is left.  A component that is literal but for a ``*``
    at one end is a plain string in the path, and its whole paths hold that too.
    """
    whole, component, plain = [], [], []
    for g in globs:
        bare = re.sub(r"/\*\*$", "", re.sub(r"^\*\*/", "", g))
        name = bare.strip("*")
        if bare and "/" not in bare and not re.search(r"[*?\[]", name) and name and bare in (name, "*" + name, name + "*"):
            plain.append(("" if bare[0] == "*" else "/") + name + ("" if bare[-1] == "*" else "/"))
            continue
        whole.append(shell_regex(g))
        if bare and "/" not in bare:
            component.append(shell_regex(bare))
    return whole, component, plain


def excluded(path: C, globs: list[str] | tuple[str, ...]) -> Column:
    whole, component, plain = exclude_parts(globs)
    p = posix(path)
    out = F.lit(False)
    for text in plain:
        out = out | F.contains(F.concat(F.lit("/"), p, F.lit("/")), F.lit(text))
    if whole:
        out = out | p.rlike(any_of(whole))
    return out | F.exists(F.split(p, "/"), lambda x: x.rlike(any_of(component))) if component else out


def excludes(globs: list[str] | tuple[str, ...]) -> Callable[[str], bool]:
    """``excluded`` as a test of one path on the driver."""
    whole, component, plain = exclude_parts(globs)
    at_whole, at_part = (re.compile(any_of(x).replace(r"\z", r"\Z")) for x in (whole, component))

    def test(path: str) -> bool:
        p = path.replace("\\", "/")
        return any(t in f"/{p}/" for t in plain) or bool(at_whole.search(p)) or any(at_part.search(x) for x in p.split("/"))

    return test


def included(path: C, globs: list[str] | tuple[str, ...]) -> Column:
    """Without globs everything is included."""
    return posix(path).rlike(any_of([shell_regex(g) for g in globs])) if globs else F.lit(True)


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool


def ignore_rule(line: str, base: str = ".") -> Rule | None:
    """One line of an ignore file that lies in ``base``; None for blanks and comments."""
    text = line.rstrip("\r\n")
    text = re.sub(r"(?<!\\)\s+$", "", text.lstrip())
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    text = text[1:] if text[:2] in ("\\#", "\\!") else text
    only_dir = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.lstrip("/")
    if not text:
        return None
    out, i = [], 0
    while i < len(text):
        if text.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif text[i:] == "**" and i:
            out.append(".*")
            i += 2
        elif text[i] == "[":
            part, i = _class_at(text, i)
            out.append(part)
        elif text[i] == "\\" and i + 1 < len(text):
            out.append(re.escape(text[i + 1]))
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(text[i]) or re.escape(text[i]))
            i += 1
    inside = "" if base in (".", "") else re.escape(base) + "/"
    return Rule(rf"^{inside}{'' if anchored else '(?:.*/)?'}{''.join(out)}{'/.*' if only_dir else '(?:/.*)?'}\z", negated)


def ignore_rules(files: list[tuple[str, str]]) -> list[Rule]:
    """Rules of ignore files (directory, text), outer directories first, so that inner files win."""
    ordered = sorted(files, key=lambda f: (0 if f[0] in (".", "") else f[0].count("/") + 1, f[0]))
    return [r for d, text in ordered for line in text.splitlines() if (r := ignore_rule(line, d))]


def ignored(path: C, rules: list[Rule]) -> Column:
    """The last rule that matches decides; neighbours of one kind are one expression."""
    runs: list[tuple[bool, list[str]]] = []
    for r in rules:
        if runs and runs[-1][0] == r.negated:
            runs[-1][1].append(r.regex)
        else:
            runs.append((r.negated, [r.regex]))
    out = F.lit(False)
    for negated, parts in runs:
        out = F.when(col(path).rlike("|".join(f"(?:{p})" for p in parts)), F.lit(not negated)).otherwise(out)
    return out


def ignores(rules: list[Rule]) -> Callable[[str], bool]:
    """``ignored`` as a test of one path on the driver."""
    compiled = [(re.compile(r.regex.replace(r"\z", r"\Z")), r.negated) for r in reversed(rules)]
    return lambda path: next((not negated for regex, negated in compiled if regex.search(path)), False)
