"""Functions in C files: headers, bodies, the comment before them."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Words that look like a function's name before a parenthesis but aren't: fixed values.
KEYWORDS = set(
    "if else for while switch case do goto break continue default return sizeof typedef static inline extern struct union enum const volatile register unsigned signed void char int float double short long auto".split()
)
#: What a function header looks like: a fixed pattern.
HEADER = re.compile(r"^\s*(?:static|inline|extern|unsigned|signed|struct|const|volatile)?\s*([a-zA-Z_][\w\s*]+)\s+(?P<name>[a-zA-Z_]\w*)\s*\(\s*([^)]*)\)\s*\{", re.M)


def balanced(text: str, start: int) -> str:
    """From start to the brace that closes the first one opened; empty if none does. Strings and comments count like code."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[start : m.end()]
    return ""


def comment_before(lines: list[str], at: int) -> str | None:
    """First sentence of the block comment or run of line comments that ends above line `at`, blank lines between allowed."""
    k = at - 1
    while k >= 0 and not lines[k].strip():
        k -= 1
    if k < 0:
        return None
    if lines[k].strip().endswith("*/"):
        top = next((j for j in range(k, -1, -1) if "/*" in lines[j]), None)
        if top is None:
            return None
        found = " ".join(line.strip("/* ") for line in lines[top : k + 1])
    elif lines[k].strip().startswith("//"):
        top = k
        while top > 0 and lines[top - 1].strip().startswith("//"):
            top -= 1
        found = " ".join(line.strip()[2:].strip() for line in lines[top : k + 1])
    else:
        return None
    return re.split(r"[.@]", " ".join(found.split()), maxsplit=1)[0].strip() or None


def functions(text: str, with_comment: bool = True) -> Iterator[tuple[str, str, str | None]]:
    """(name, source, comment) of each function; those that are never closed are left out."""
    lines = text.splitlines() if with_comment else []
    for m in HEADER.finditer(text):
        name = m["name"]
        if name in KEYWORDS or not (source := balanced(text, m.start())):
            continue
        yield name, source.strip(), comment_before(lines, text.count("\n", 0, m.start("name"))) if with_comment else None
