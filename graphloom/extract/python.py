"""Python, from its syntax tree: functions with calls, classes with bases, decorated definitions, imports."""

from __future__ import annotations

import ast

from .base import Facts, one_line


def _docstring(source: str, node: ast.AST) -> str | None:
    first = node.body[0] if node.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        text = ast.get_source_segment(source, first.value) or ""
        if text.startswith(('"""', "'''")):
            return one_line(text[3:-3]) or None
    return None


def _calls(facts: Facts, source: str, v: str, node: ast.AST) -> None:
    """Outer calls before the calls within them, in the order of the text."""
    found = sorted((n for n in ast.walk(node) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset, -n.end_lineno, -n.end_col_offset))
    for n in found:
        if callee := ast.get_source_segment(source, n.func):
            facts.call(v, callee)


def _names(nodes: list[ast.AST]) -> list[tuple]:
    out = []
    for top in nodes:
        for n in ast.walk(top):
            if isinstance(n, ast.Name):
                out.append((n.lineno, n.col_offset, n.id))
            elif isinstance(n, ast.Attribute):
                out.append((n.end_lineno, n.end_col_offset - len(n.attr), n.attr))
            elif isinstance(n, ast.keyword) and n.arg:
                out.append((n.lineno, n.col_offset, n.arg))
    return sorted(out)


def extract_python(path: str, source: str, methods: bool = False) -> Facts:
    """methods: also methods of classes, as Class.name (an addition)."""
    facts = Facts(path, source)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return facts

    def visit(node: ast.AST) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            if node.decorator_list:
                d = node.decorator_list[0]
                v = facts.add(node.name, "function", f"L{d.lineno}")
                if isinstance(d, ast.Name):
                    facts.refer(v, d.id, "references")
            else:
                _calls(facts, source, facts.add(node.name, "function", f"L{node.lineno}", _docstring(source, node)), node)
        elif isinstance(node, ast.ClassDef):
            if node.decorator_list:
                facts.add(node.name, "class", f"L{node.decorator_list[0].lineno}")
            else:
                v = facts.add(node.name, "class", f"L{node.lineno}", _docstring(source, node))
                for *_, name in _names([*node.bases, *node.keywords]):
                    facts.refer(v, name, "inherits")
                for m in node.body if methods else []:
                    if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                        facts.edge(v, facts.add(f"{node.name}.{m.name}", "method", f"L{m.lineno}", _docstring(source, m)), "contains")
        elif isinstance(node, ast.Import | ast.ImportFrom):
            a = node.names[0]
            facts.refer(facts.file, f"{a.name} as {a.asname}" if a.asname else a.name, "imports")
        else:
            for child in ast.iter_child_nodes(node):
                visit(child)

    visit(tree)
    return facts
