"""What extractors share: the result being built, masking of strings and comments, bracket matching."""

from __future__ import annotations

import re

CALL_SCORE, IMPORT_SCORE = 0.85, 0.95
#: File name extension to language.
LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript",
    ".py": "python", ".pyi": "python", ".go": "go", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".json": "json",
    ".java": "java", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sc": "scala",
}


def node_id(path: str, name: str) -> str:
    """As functions.text.node_id, for one string."""
    clean = re.sub(r"\.[^.]+$", "", re.sub(r"[\\/]", "_", path))
    return f"{clean}_{re.sub(r'[^a-zA-Z0-9_$]', '_', name)}"


class Facts:
    """The nodes and edges of one file, in the order of their discovery; a repeated id is one node."""

    def __init__(self, path: str, source: str, distinct: bool = True):
        self.path, self.source = path, source
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.seen: set[str] = set()
        self.distinct = distinct
        self.file = node_id(path, "file")
        self.nodes.append((self.file, path, "file", None, None))
        self.seen.add(self.file)

    def line(self, offset: int) -> str:
        return f"L{self.source.count(chr(10), 0, offset) + 1}"

    def add(self, name: str, kind: str, location: str | None = None, description: str | None = None) -> str:
        v = node_id(self.path, name)
        if self.distinct and v in self.seen:
            return v
        self.seen.add(v)
        self.nodes.append((v, name, kind, location, description))
        self.edge(self.file, v, "contains")
        return v

    def edge(self, source: str, target: str, relation: str, confidence: str = "EXTRACTED", score: float | None = None) -> None:
        self.edges.append((source, target, relation, confidence, score))

    def call(self, source: str, callee: str) -> None:
        self.edge(source, node_id(self.path, callee), "calls", "INFERRED", CALL_SCORE)

    def refer(self, source: str, name: str, relation: str) -> None:
        self.edge(source, node_id(self.path, name), relation)


def one_line(text: str, limit: int = 200) -> str:
    return re.sub(r"\s+", " ", text).strip()[:limit]


def mask(source: str, line: tuple[str, ...] = ("//",), block: bool = True, quotes: str = "\"'`", triple: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """Blank out strings and comments, keeping length and line feeds; also the comments' spans."""
    parts = ["|".join(re.escape(x) + r"[^\n]*" for x in line)] if line else []
    if block:
        parts.append(r"/\*.*?(?:\*/|\Z)")
    strings = []
    if triple:
        strings.append(r'"""(?:[^\\]|\\.)*?(?:"""|\Z)')
    for q in quotes:
        inner = rf"[^{q}\\]" if q == "`" else rf"[^{q}\\\n]"
        strings.append(rf"{q}(?:{inner}|\\.)*{q}?")
    pattern = re.compile(f"(?P<comment>{'|'.join(parts)})|(?P<string>{'|'.join(strings)})" if parts else f"(?P<string>{'|'.join(strings)})", re.S)
    comments = []

    def blank(m: re.Match) -> str:
        if m.lastgroup == "comment":
            comments.append(m.span())
            return re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

    return pattern.sub(blank, source), comments


def closing(text: str, at: int) -> int:
    """The offset after the bracket that closes the one at `at`; the text's end if none does."""
    pairs = {"(": ")", "{": "}", "[": "]"}
    depth, a, b = 0, text[at], pairs[text[at]]
    for m in re.compile(f"[{re.escape(a + b)}]").finditer(text, at):
        depth += 1 if m[0] == a else -1
        if depth == 0:
            return m.end()
    return len(text)
