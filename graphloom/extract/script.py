"""JavaScript and TypeScript, lexically: declarations, class members, calls, relative imports, doc comments.

Calls come from function declarations only, ``const`` and ``let`` are no declarations, functions within functions are not
declared on their own, and targets of calls are names of the same file: what the compared behaviour amounts to.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .base import IMPORT_SCORE, Facts, closing, mask, node_id, one_line

_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "yield", "void", "delete", "in", "of", "do", "else", "case", "throw", "super", "import", "with", "new", "async"}
_NAME = r"[A-Za-z_$][\w$]*"
_DECLARATION = re.compile(rf"\b(?:(?P<function>(?:async\s+)?function\b\s*\*?\s*)|(?P<class>(?:abstract\s+)?class\s+)|(?P<interface>interface\s+)|(?P<type>type\s+)|(?P<var>var\s+)|(?P<import>import\b))(?P<name>{_NAME})?")
_CALL = re.compile(rf"(?<![\w$.])(?P<callee>{_NAME}(?:\s*\??\.\s*#?{_NAME})*)\s*(?:<[^()<>;]*>\s*)?(?:\?\.\s*)?\(")


def _starts_statement(code: str, at: int) -> bool:
    before = code[:at].rstrip()
    if not before or before[-1] in ";{}":
        return True
    word = re.search(r"[\w$]+$", before)
    if word and word[0] in ("export", "default", "async", "declare", "else", "abstract"):
        return True
    return before[-1] not in "=(,:?&|+-*/[!<>." and "\n" in code[len(before) : at] and not (word and word[0] in _KEYWORDS)


def _calls(code: str, source: str, lo: int, hi: int) -> list[str]:
    out = []
    for m in _CALL.finditer(code, lo, hi):
        first = re.match(_NAME, m["callee"])[0]
        before = code[lo : m.start()].rstrip()
        if (first in _KEYWORDS and first != "super") or re.search(r"\b(new|function|get|set)\s*\*?$", before):
            continue
        end = closing(code, m.end() - 1)
        if code[end:hi].lstrip().startswith("{"):  # a method's head
            continue
        out.append(source[m.start("callee") : m.end("callee")])
    return out


def _doc(facts: Facts, comments: list[tuple[int, int]], at: int) -> str | None:
    """The text of a doc comment that directly precedes `at`."""
    for a, b in comments:
        if b <= at and not facts.source[b:at].strip():
            text = facts.source[a:b]
            if text.startswith(("/**", "///")):
                text = re.sub(r"\s*\*/$", "", re.sub(r"^/\*\*\s*|^//[!/]\s*", "", text))
                return one_line(re.sub(r"\n\s*\*\s?", " ", text)) or None
    return None


def _members(facts: Facts, code: str, comments: list[tuple[int, int]], name: str, owner: str, lo: int, hi: int, fields: bool) -> None:
    at = lo
    head = re.compile(rf"(?P<mods>(?:(?:public|private|protected|static|readonly|override|async|get|set|declare|accessor)\s+)*)\*?\s*(?P<name>#?{_NAME}|\[[^\]]*\]|\"[^\"]*\"|'[^']*')\s*[?!]?\s*(?P<next>[(<:=;\n}}])")
    while at < hi:
        space = re.compile(r"[\s;]*(?:@[\w.$]+(?:\([^)]*\))?\s*)*").match(code, at, hi)
        at = space.end()
        m = head.match(code, at, hi)
        if not m:
            nxt = code.find("{", at, hi)
            semi = code.find(";", at, hi)
            if nxt >= 0 and (semi < 0 or nxt < semi):
                at = closing(code, nxt)
            else:
                at = semi + 1 if semi >= 0 else hi
            continue
        label = f"{name}.{facts.source[m.start('name') : m.end('name')]}"
        if m["next"] in "(<":
            par = code.find("(", m.end("name"), hi)
            after = closing(code, par)
            body = re.compile(r"\s*(?::[^;{]*)?\{").match(code, after, hi)
            if body:
                facts.edge(owner, facts.add(label, "method", facts.line(at), _doc(facts, comments, at)), "contains")
                at = closing(code, body.end() - 1)
            else:  # a signature
                semi = code.find(";", after, hi)
                at = semi + 1 if semi >= 0 else hi
            continue
        if fields:
            facts.edge(owner, facts.add(label, "method", facts.line(at), _doc(facts, comments, at)), "contains")
        at = m.end() - 1
        while at < hi and code[at] not in ";\n}":
            at = closing(code, at) if code[at] in "({[" else at + 1
        at += 1


def extract_script(path: str, source: str, resolve: Callable[[str, str], str | None], typed: bool) -> Facts:
    facts = Facts(path, source)
    code, comments = mask(source)
    at = 0
    while m := _DECLARATION.search(code, at):
        start, at = m.start(), m.end()
        name, kind = m["name"], m.lastgroup if m.lastgroup != "name" else next(k for k in ("function", "class", "interface", "type", "var", "import") if m[k])
        if start and code[start - 1] in ".$" or not _starts_statement(code, start):
            continue
        exported = bool(re.search(r"\b(export|default)\s*$", code[:start]))
        doc = None if exported else _doc(facts, comments, start)
        if kind == "function" and name:
            par = code.find("(", at)
            body = re.compile(r"\s*(?::\s*(?:\{[^{}]*\}\s*)?[^;{]*)?\{").match(code, closing(code, par)) if par >= 0 else None
            if not body:  # an overload
                continue
            end = closing(code, body.end() - 1)
            v = facts.add(name, "function", facts.line(start), doc)
            for callee in _calls(code, source, par, end):
                facts.call(v, callee)
            at = end
        elif kind == "class" and name:
            body = code.find("{", at)
            if body < 0:
                continue
            v = facts.add(name, "class", facts.line(start), doc)
            heritage = re.search(r"\bextends\s+(.*)$", re.split(r"\bimplements\b", code[at:body])[0], re.S)
            for base in re.findall(rf"(?<![\w$.]){_NAME}", re.sub(r"<[^<>]*>", "", heritage[1])) if heritage else []:
                facts.refer(v, base, "inherits")
            at = closing(code, body)
            _members(facts, code, comments, name, v, body + 1, at - 1, typed)
        elif kind in ("interface", "type") and name and typed:
            after = code[at:].lstrip()[:1]
            if kind == "type" and after not in ("=", "<"):
                continue
            facts.add(name, kind, facts.line(start), doc)
            if kind == "interface" and (body := code.find("{", at)) >= 0:
                at = closing(code, body)
        elif kind == "var" and name:
            value = re.compile(rf"\s*(?::[^=;]*)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*\)|{_NAME})\s*(?::[^=;]*)?=>)").match(code, at)
            depth = code.count("{", 0, start) - code.count("}", 0, start)
            if value:
                facts.add(name, "function", facts.line(start), doc)
            elif depth == 0:
                facts.add(name, "variable", facts.line(start), doc)
        elif kind == "import":
            spec = re.compile(r"import\b(?P<clause>[^;'\"`(]*?)(?:\bfrom\s*)?(?P<q>['\"])").match(code, start)
            if not spec:
                continue
            end = code.find(spec["q"], spec.end())
            target = source[spec.end() : end]
            at = end + 1
            if target.startswith(".") and (found := resolve(path, target)):
                facts.edge(facts.file, node_id(found, "file"), "imports")
    return facts


def named_imports(path: str, source: str, resolve: Callable[[str, str], str | None]) -> list[tuple]:
    """Edges to the named imports of relative modules, which extract_script() leaves out."""
    code, _ = mask(source)
    out = []
    for m in re.finditer(r"\bimport\b[^;'\"`(]*?\{(?P<names>[^}]*)\}\s*from\s*['\"]", code):
        target = source[m.end() : source.find(code[m.end() - 1], m.end())]
        if target.startswith(".") and (found := resolve(path, target)):
            out += [(node_id(path, "file"), node_id(found, n.split(" as ")[0].replace("type ", "").strip()), "imports", "INFERRED", IMPORT_SCORE) for n in m["names"].split(",") if n.strip()]
    return out
