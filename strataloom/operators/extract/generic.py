"""Symbols and imports by regular expressions, for languages outside the JavaScript family."""

from __future__ import annotations

import bisect
import re

# Declarations by language, as kind and pattern (groups n: name, p: parameters; kind with * is async).
_CLASS_LIKE = r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:class|interface|enum|record)\s+(?P<n>[A-Za-z_]\w*)"
DECLARATIONS = {
    "python": (
        ("function", r"^(\s*)def\s+(?P<n>[A-Za-z_][\w]*)\s*\((?P<p>[^)]*)\)"),
        ("function*", r"^(\s*)async\s+def\s+(?P<n>[A-Za-z_][\w]*)\s*\((?P<p>[^)]*)\)"),
        ("class", r"^(\s*)class\s+(?P<n>[A-Za-z_][\w]*)"),
    ),
    "java": (
        ("class", _CLASS_LIKE),
        ("method", r"^\s*(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?[\w<>[\],\s.?]+\s+(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^)]*)\)\s*(?:throws [\w,\s.]+)?\{"),
    ),
    "kotlin": (
        ("function", r"^\s*(?:override\s+|private\s+|internal\s+|suspend\s+)*fun\s+(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^)]*)\)"),
        ("class", r"^\s*(?:data\s+|sealed\s+|abstract\s+|open\s+)*class\s+(?P<n>[A-Za-z_]\w*)"),
    ),
    "go": (
        ("function", r"^func\s+(?:\([^)]*\)\s*)?(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^)]*)\)"),
        ("class", r"^type\s+(?P<n>[A-Za-z_]\w*)\s+(?:struct|interface)"),
    ),
    "rust": (
        ("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<n>[A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*\((?P<p>[^)]*)\)"),
        ("class", r"^\s*(?:pub\s+)?(?:struct|enum|trait|impl)\s+(?P<n>[A-Za-z_]\w*)"),
    ),
    "ruby": (
        ("method", r"^\s*def\s+(?:self\.)?(?P<n>[A-Za-z_]\w*[?!=]?)"),
        ("class", r"^\s*(?:class|module)\s+(?P<n>[A-Z]\w*)"),
    ),
    "php": (
        ("function", r"^\s*(?:public|private|protected|static|\s)*function\s+(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^)]*)\)"),
        ("class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(?P<n>[A-Za-z_]\w*)"),
    ),
    "csharp": (
        ("method", r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|virtual\s+|override\s+|async\s+)*[\w<>[\],\s?]+\s+(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^)]*)\)"),
        ("class", r"^\s*(?:public|internal|abstract|sealed|\s)*(?:class|interface|record|struct)\s+(?P<n>[A-Za-z_]\w*)"),
    ),
    "c": (
        ("function", r"^[A-Za-z_][\w\s*]*\s+\*?(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^;{)]*)\)\s*\{"),
        ("class", r"^\s*(?:typedef\s+)?struct\s+(?P<n>[A-Za-z_]\w*)"),
    ),
    "swift": (
        ("function", r"^\s*(?:public|private|internal|open|\s)*func\s+(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^)]*)\)"),
        ("class", r"^\s*(?:public|final|open|\s)*(?:class|struct|protocol|enum)\s+(?P<n>[A-Za-z_]\w*)"),
    ),
    "sql": (("function", r"(?i)create\s+(?:or\s+replace\s+)?(?:table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?[`\"\[]?(?P<n>[\w.]+)"),),
    "shell": (("function", r"^(?:function\s+)?(?P<n>[A-Za-z_]\w*)\s*\(\)\s*\{"),),
}
# Imports by language.
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+);",
    "kotlin": r"^\s*import\s+([\w.*]+)",
    "go": r"^\s*(?:import\s+)?\"([\w./-]+)\"",
    "rust": r"^\s*use\s+([\w:{}, ]+);",
    "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
    "php": r"^\s*(?:use|require|include)(?:_once)?\s*\(?['\"]?([\w\\/.]+)",
    "csharp": r"^\s*using\s+([\w.]+);",
    "c": r"^\s*#include\s+[<\"]([^>\"]+)[>\"]",
    "swift": r"^\s*import\s+(\w+)",
}
for _like, _lang in (("cpp", "c"), ("scala", "java")):
    DECLARATIONS[_like], IMPORTS[_like] = DECLARATIONS[_lang], IMPORTS[_lang]

_COMPILED = {lang: [(kind, re.compile(p, re.M)) for kind, p in rules] for lang, rules in DECLARATIONS.items()}
_IMPORTS = {lang: re.compile(p, re.M) for lang, p in IMPORTS.items()}


def analysis(**parts) -> dict:
    """An empty record of one file, with the given parts."""
    return {"parse_ok": True, "imports": [], "exports": [], "symbols": [], "routes": [], "calls": []} | parts


def is_external(raw: str) -> bool:
    return not raw.startswith((".", "/"))


def analyze_generic(code: str, language: str) -> dict:
    """Symbols end where the next one begins; the last at the end of the file. Calls, exports and routes are none.

    A symbol begins on the line on which its match begins, so on the first of the blank lines before it. Exported is
    what has an upper-case initial, and in any language but Go everything else too.
    """
    breaks = [i for i, c in enumerate(code) if c == "\n"]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    symbols = []
    for kind, pattern in _COMPILED.get(language, ()):
        for m in pattern.finditer(code):
            name = m["n"]
            if len(name) >= 120:
                continue
            params = m["p"] if "p" in pattern.groupindex else None
            symbols.append({
                "name": name, "qualified_name": name, "kind": kind.rstrip("*"), "class_name": "", "signature": m[0].strip()[:160], "params": [p for p in map(str.strip, (params or "").split(",")) if p][:10],
                "exported": bool(re.match("[A-Z]", name)) or language != "go", "is_async": kind.endswith("*"), "doc": "", "start_line": line(m.start()), "calls": [],
            })
    symbols.sort(key=lambda s: s["start_line"])
    total = len(breaks) + 1
    for s, after in zip(symbols, [*symbols[1:], None], strict=False):
        s["end_line"] = max(s["start_line"], after["start_line"] - 1) if after else total
        s["loc"] = s["end_line"] - s["start_line"] + 1
    imports = []
    if language in _IMPORTS:
        for m in _IMPORTS[language].finditer(code):
            if raw := next(filter(None, m.groups()), ""):
                imports.append({"raw": raw, "specifiers": [], "is_external": is_external(raw), "line": line(m.start())})
    return analysis(symbols=symbols, imports=imports)
