"""Go, shell, JSON, and a lexical extractor for Java, Rust, C++, Ruby, Kotlin and Scala."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from .base import Facts, closing, mask

_NO_NAME = {"if", "for", "while", "switch", "catch", "return", "new", "else", "sizeof", "synchronized", "throw", "super", "this"}
_CONTROL = _NO_NAME | {"func", "match", "loop", "fn", "def", "when"}


def _calls(code: str, source: str, lo: int, hi: int, joiner: str = r"(?:\.|::|->)") -> list[str]:
    out = []
    for m in re.compile(rf"(?<![\w.])(?P<callee>[A-Za-z_]\w*(?:{joiner}[A-Za-z_]\w*)*)\s*\(").finditer(code, lo, hi):
        if re.match(r"\w+", m["callee"])[0] in _CONTROL or re.search(r"\b(new|func|fn|def|fun)\s+$", code[lo : m.start()]):
            continue
        out.append(source[m.start("callee") : m.end("callee")])
    return out


def extract_go(path: str, source: str) -> Facts:
    facts = Facts(path, source)
    code, _ = mask(source)
    pattern = re.compile(r"^(?:func\s+(?P<recv>\([^)]*\)\s*)?(?P<func>\w+)|type\s+(?P<type>\w+|\()|import\s+(?P<import>\(|[\w.]+\s|[\"`]))", re.M)
    at = 0
    while m := pattern.search(code, at):
        at = m.end()
        if m["func"]:
            par = code.find("(", at)
            if par < 0:
                break
            after = closing(code, par)
            body = re.compile(r"[^\n{]*(?:\{\})?[^\n{]*\{").match(code, after)
            end = closing(code, body.end() - 1) if body else after
            if m["recv"]:
                kind = re.findall(r"[A-Za-z_]\w*", m["recv"])
                facts.add(f"{kind[-1] if len(kind) != 1 or '*' in m['recv'] or kind else ''}.{m['func']}", "method", facts.line(m.start()))
            else:
                v = facts.add(m["func"], "function", facts.line(m.start()))
                for callee in _calls(code, source, par, end):
                    facts.call(v, callee)
            at = end
        elif m["type"]:
            if m["type"] == "(":
                end = closing(code, m.end() - 1)
                specs = re.compile(r"^\s*(?P<n>[A-Za-z_]\w*)(?:\[[^\]]*\])?[ \t]+(?P<eq>=)?(?P<rest>[^\n]*)", re.M).finditer(code, m.end(), end - 1)
                depth_at = m.end()
                for s in specs:
                    inner = code[depth_at : s.start()]
                    if inner.count("{") != inner.count("}") or s["eq"]:
                        continue
                    facts.add(s["n"], "struct" if s["rest"].startswith("struct") else "type", facts.line(s.start("n")))
                at = end
            else:
                rest = code[at : at + 200].lstrip()
                rest = re.sub(r"^\[[^\]]*\]\s*", "", rest) if rest.startswith("[") and not rest.startswith("[]") else rest
                if not rest.startswith("="):
                    facts.add(m["type"], "struct" if re.match(r"struct\b", rest) else "type", facts.line(m.start("type")))
        elif m["import"]:
            group = m["import"] == "("
            end = closing(code, m.end() - 1) if group else code.find("\n", m.start())
            end = len(code) if end < 0 else end
            for alias in re.finditer(r"(?:^|\(|import)\s*([A-Za-z_.]\w*)\s+[\"`]", code[m.start() : end], re.M):
                if alias[1] != "import":
                    facts.refer(facts.file, alias[1], "imports")
            at = end
    return facts


def extract_shell(path: str, source: str) -> Facts:
    facts = Facts(path, source)
    for m in re.finditer(r"^(?:function\s+)?([A-Za-z0-9_]+)\s*\(\s*\)", source, re.M):
        facts.add(m[1], "function", facts.line(m.start()))
    return facts


def _js_key_order(keys: list[str]) -> list[str]:
    """Object keys as a JavaScript engine lists them: array indices by value, then the rest by insertion."""
    index = [k for k in keys if k == "0" or re.fullmatch(r"[1-9]\d{0,9}", k) and int(k) < 2**32 - 1]
    return sorted(index, key=int) + [k for k in keys if k not in set(index)]


def extract_json(path: str, source: str, limit: int = 20) -> Facts:
    facts = Facts(path, source, distinct=False)
    try:
        data = json.loads(source, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except (ValueError, RecursionError):
        return facts
    if isinstance(data, dict):
        for key in _js_key_order(list(data))[:limit]:
            facts.add(key, "field")
    return facts


@dataclass(frozen=True)
class Family:
    """Patterns of a language; each has a group `name`. Bodies begin at the next brace before a semicolon."""

    functions: str | None
    classes: tuple[tuple[str, str], ...] = ()  # kind, pattern
    bases: str | None = None  # what a class's head inherits from, group 1
    imports: str | None = None  # the imported path, group 1
    separator: str = "."
    quotes: str = "\"'"
    line: tuple[str, ...] = ("//",)
    object_calls: bool = False  # a call's first part is the object, not the method


_JAVA_HEAD = r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*"
FAMILIES = {
    "java": Family(
        r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?:(?!return\b|new\b|else\b|throw\b)[\w.<>\[\],?]+\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{|;)",
        (("class", _JAVA_HEAD + r"class\s+(?P<name>\w+)"), ("interface", _JAVA_HEAD + r"interface\s+(?P<name>\w+)"), ("enum", _JAVA_HEAD + r"enum\s+(?P<name>\w+)")),
        r"\b(?:extends|implements)\s+([\w.<>,\s]+?)(?=\bextends\b|\bimplements\b|$)", r"^[ \t]*import\s+(?:static\s+)?([\w.]+)", object_calls=True,
    ),
    "rust": Family(None, (("struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("trait", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)")), r"^\s*(?:<[^>]*>)?\s*:\s*([\w:+\s]+)$", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:use|mod)\s+([\w:]+)", separator="::", quotes='"'),
    "cpp": Family(r"^[ \t]*(?:(?!return\b|else\b|new\b|delete\b|throw\b|using\b|typedef\b)[\w:<>,*&~\[\]]+[\s*&]+)+(?:\w+::)*(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?(?=\{)"),
    "ruby": Family(None, line=("#",)),
    "kotlin": Family(r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>\w+)\s*\(", (("interface", r"\binterface\s+(?P<name>\w+)"), ("class", r"\bclass\s+(?P<name>\w+)"))),
    "scala": Family(r"\bdef\s+(?P<name>\w+)", (("class", r"\bclass\s+(?P<name>\w+)"), ("object", r"\bobject\s+(?P<name>\w+)")), r"\bextends\s+([\w.\[\],\s]+)", r"^[ \t]*import\s+([\w.]+)"),
}
#: Definitions that a complete extraction adds: (kind, pattern) by language.
COMPLETE = {
    "rust": (("function", r"\bfn\s+(?P<name>\w+)"),),
    "cpp": (("class", r"^[ \t]*class\s+(?P<name>\w+)(?=[^;]*\{)"), ("struct", r"^[ \t]*struct\s+(?P<name>\w+)(?=[^;]*\{)")),
    "ruby": (("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!]?)"), ("class", r"^[ \t]*class\s+(?P<name>\w+)")),
    "scala": (("trait", r"\btrait\s+(?P<name>\w+)"),),
    "kotlin": (("object", r"\bobject\s+(?P<name>\w+)"),),
}


def _body(code: str, at: int) -> int:
    """The end of the block that follows, or of the statement."""
    m = re.compile(r"[^;{]*?([;{]|\Z)").match(code, at)
    return closing(code, m.end() - 1) if m and m[1] == "{" else (m.end() if m else at)


def extract_generic(path: str, source: str, language: str, complete: bool = False) -> Facts:
    f = FAMILIES[language]
    facts = Facts(path, source)
    code, _ = mask(source, f.line, block=language != "ruby", quotes=f.quotes, triple=language in ("kotlin", "scala"))
    patterns = [("function", f.functions)] if f.functions else []
    patterns += [*f.classes, *(COMPLETE.get(language, ()) if complete else ())]
    found = [(m.start("name"), kind, m) for kind, p in patterns for m in re.finditer(p, code, re.M)]
    found += [(m.start(1), "import", m) for m in re.finditer(f.imports, code, re.M)] if f.imports else []
    for at, kind, m in sorted(found, key=lambda x: (x[0], x[1])):
        if kind == "import":
            parts = m[1].split(f.separator)
            for x in parts:
                if x not in ("use", "import", "mod", "pub", "crate", ""):
                    facts.refer(facts.file, x, "imports")
            for n in range(len(parts), 1, -1):
                facts.refer(facts.file, f.separator.join(parts[:n]), "imports")
            continue
        if m["name"] in _NO_NAME:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        v = facts.add(m["name"], kind, facts.line(start))
        if kind == "function":
            for callee in _calls(code, source, m.end(), _body(code, m.end())):
                facts.call(v, callee.rsplit(".", 1)[0] if f.object_calls and "." in callee else callee)
        elif f.bases:
            head = code[m.end() : next((i for i in (code.find(c, m.end()) for c in "{;\n") if i >= 0), len(code))]
            for b in re.finditer(f.bases, head):
                for name in re.findall(r"[A-Za-z_]\w*(?:(?:\.|::)\w+)*", re.sub(r"<[^<>]*>", "", b[1])):
                    if name not in ("with", "extends", "implements"):
                        facts.refer(v, name, "inherits")
    return facts
