"""Python: classes, methods and functions by ``ast``; files that don't parse are scanned by indentation."""

from __future__ import annotations

import ast
import re

from lodestone.sources.extract import Analysis, Symbol


def visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


def _source(node: ast.AST, lines: list[str], text: str) -> str:
    return ast.get_source_segment(text, node) or ast.unparse(node)


def extract(text: str) -> Analysis:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _by_indentation(text)
    out, lines = Analysis(), text.splitlines()
    seg = lambda n: _source(n, lines, text)

    def head(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        a = node.args
        parts = []
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        for i, (arg, d) in enumerate(zip(plain, defaults, strict=True)):
            parts.append(_param(arg, d, seg))
            if a.posonlyargs and i == len(a.posonlyargs) - 1:
                parts.append("/")
        if a.vararg:
            parts.append("*" + _param(a.vararg, None, seg))
        elif a.kwonlyargs:
            parts.append("*")
        parts += [_param(arg, d, seg) for arg, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        if a.kwarg:
            parts.append("**" + _param(a.kwarg, None, seg))
        returns = f" -> {seg(node.returns)}" if node.returns else ""
        return f"def {node.name}({', '.join(parts)}){returns}"

    def visit(body: list[ast.stmt], parent: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                out.imports.append(seg(node))
            elif isinstance(node, ast.ClassDef):
                bases = [seg(b) for b in node.bases if isinstance(b, (ast.Name, ast.Subscript, ast.Attribute, ast.Call))]
                shown = [seg(b) for b in node.bases] + [f"{k.arg}={seg(k.value)}" if k.arg else f"**{seg(k.value)}" for k in node.keywords]
                signature = f"class {node.name}({', '.join(shown)})" if shown else f"class {node.name}"
                out.symbols.append(Symbol(node.name, "class", visibility(node.name), signature, [seg(d) for d in node.decorator_list], bases, parent, node.lineno, node.end_lineno or node.lineno))
                visit(node.body, node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if parent else "function"
                out.symbols.append(Symbol(node.name, kind, visibility(node.name), head(node), [seg(d) for d in node.decorator_list], [], parent, node.lineno, node.end_lineno or node.lineno))
            else:
                # declarations under conditions and guards; function bodies are not entered
                for name in ("body", "orelse", "finalbody"):
                    visit([n for n in getattr(node, name, []) or [] if isinstance(n, ast.stmt)], parent)
                for h in getattr(node, "handlers", []):
                    visit(h.body, parent)

    visit(tree.body, None)
    return out


def _param(arg: ast.arg, default: ast.expr | None, seg) -> str:
    note = f": {seg(arg.annotation)}" if arg.annotation else ""
    if default is None:
        return arg.arg + note
    return f"{arg.arg}{note}{' = ' if note else '='}{seg(default)}"


_DECL = re.compile(r"^(\s*)(?:async\s+)?(class|def)\s+(\w+)\s*(\([^)]*\))?(?:\s*->\s*([^:]+))?")


def _by_indentation(text: str) -> Analysis:
    out = Analysis()
    open_: list[tuple[int, str, str]] = []
    pending: list[str] = []
    for i, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        open_ = [o for o in open_ if o[0] < depth]
        if bare.startswith("@"):
            pending.append(bare[1:])
            continue
        m = _DECL.match(line)
        if m:
            if not any(k == "def" for _, k, _ in open_):
                parent = open_[-1][2] if open_ else None
                args = m[4] or ("" if m[2] == "class" else "()")
                if m[2] == "class":
                    bases = [b.strip() for b in (m[4] or "()")[1:-1].split(",") if b.strip() and "=" not in b]
                    signature = f"class {m[3]}{args if args != '()' else ''}"
                    out.symbols.append(Symbol(m[3], "class", visibility(m[3]), signature, pending, bases, parent, i, i))
                else:
                    returns = f" -> {m[5].strip()}" if m[5] else ""
                    out.symbols.append(Symbol(m[3], "method" if parent else "function", visibility(m[3]), f"def {m[3]}{args}{returns}", pending, [], parent, i, i))
            open_.append((depth, m[2], m[3]))
        elif re.match(r"(?:import|from)\s", bare) and not open_:
            out.imports.append(bare)
        pending = []
    return out
