"""Functions of source files: Go, Python, JavaScript, TypeScript and Java.

Python is parsed with ``ast``.  The others are scanned: strings, comments and
regular expressions are blanked out, brackets are matched, and patterns of
declarations find the braces that hold a body.  A file that can't be read that
way has no functions and stays one item.
"""

from __future__ import annotations

import ast
import os
import re
from dataclasses import dataclass

# Languages by extension.
LANGUAGES = {".go": "go", ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".java": "java"}
CONTEXT_BYTES = 2048


@dataclass
class Function:
    name: str
    lead: int  # first line, comments and decorators included
    start: int
    end: int


def language_of(path: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(path)[1].lower())


_SKIP = {
    "go": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'", re.S),
    "java": re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S),
    "javascript": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{}\[\n])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S),
}
_OPEN, _CLOSE = "([{", ")]}"


def blank(src: str, language: str) -> str:
    """The source with strings and comments as spaces; line breaks stay."""
    skip = _SKIP["javascript" if language == "typescript" else language]
    return skip.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), src)


def match_brackets(text: str) -> dict[int, int] | None:
    """Closing position of every opening bracket; None if they don't match."""
    out, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m[0]
        if c in _OPEN:
            stack.append(m.start())
        elif not stack or text[stack[-1]] != _OPEN[_CLOSE.index(c)]:
            return None
        else:
            out[stack.pop()] = m.start()
    return out if not stack else None


_GO_VAR = re.compile(r"^(?:var\s+)?(\w+)(?:\s+[\w.()\[\]* ]+)?\s*=\s*func\b", re.M)
_JS_FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)?\s*(?:<[^({]*>)?\s*(?=\()")
_JS_VAR = re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?=\s*(?:async\s+)?(?=\(|function\b|\w+\s*=>)")
_JS_CLASS = re.compile(r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*(?=\{)")
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(#?\w+)\s*(?:<[^({]*>)?\s*(?=\()")
_JAVA_TYPE = re.compile(r"\b(?:class|interface|enum|record)\s+(\w+)[^{;]*(?=\{)")
_JAVA_METHOD = re.compile(r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+|@\w+(?:\([^)]*\))?\s+)*(?:<[^>]*>\s*)?(?:[\w.<>\[\]?,\s]+?\s+)?(\w+)\s*(?=\()")
_NOT_NAMES = frozenset("if for while switch catch return new function else do try synchronized super this throw typeof await yield import".split())


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _lead(lines: list[str], start: int, marks: tuple[str, ...]) -> int:
    """The first line of the comments and annotations right above ``start``."""
    n = start
    while n > 1 and lines[n - 2].strip().startswith(marks):
        n -= 1
    return n


def _body(text: str, pairs: dict[int, int], at: int, stop: str = ";") -> int | None:
    """The opening brace of the body that follows a parameter list at or after ``at``."""
    i = text.find("(", at)
    if i < 0 or i not in pairs:
        return None
    i = pairs[i] + 1
    while i < len(text):
        c = text[i]
        if c == "{":
            before = text[:i].rstrip()
            if not before.endswith(("interface", "struct")):
                return i
            i = pairs[i]
        elif c in "([":
            i = pairs.get(i, i)
        elif c in stop or c == "}":
            return None
        i += 1
    return None


def _go(src: str) -> list[Function] | None:
    text = blank(src, "go")
    pairs = match_brackets(text)
    if pairs is None:
        return None
    lines, out = src.split("\n"), []
    for m in re.finditer(r"^func\b\s*(\([^)]*\))?\s*(\w+)", text, re.M):
        brace = _body(text, pairs, m.end())
        if brace is None or "\n" in text[m.end() : brace] and not _spans(text, pairs, m.end(), brace):
            continue
        receiver = re.search(r"\*?\s*(\w+)\s*(?:\[[^\]]*\])?\s*\)$", m[1]) if m[1] else None
        name = f"{receiver[1]}.{m[2]}" if receiver else m[2]
        start = _line(text, m.start())
        out.append(Function(name, _lead(lines, start, ("//",)), start, _line(text, pairs[brace])))
    for m in _GO_VAR.finditer(text):
        depth0 = not any(a < m.start() < b for a, b in pairs.items() if text[a] == "{")
        brace = _body(text, pairs, m.end()) if depth0 else None
        if brace is not None:
            start = _line(text, m.start())
            out.append(Function(m[1], _lead(lines, start, ("//",)), start, _line(text, pairs[brace])))
    return sorted(out, key=lambda f: f.start)


def _spans(text: str, pairs: dict[int, int], a: int, b: int) -> bool:
    """Whether all line breaks between a and b lie inside brackets."""
    i = a
    while i < b:
        if text[i] in "([" and i in pairs:
            i = pairs[i]
        elif text[i] == "\n":
            return False
        i += 1
    return True


def _js(src: str) -> list[Function] | None:
    text = blank(src, "javascript")
    pairs = match_brackets(text)
    if pairs is None:
        return None
    lines, out = src.split("\n"), []

    def add(name: str, at: int, close: int) -> None:
        start = _line(text, at)
        out.append(Function(name, _lead(lines, start, ("//", "*", "/*", "@")), start, _line(text, close)))

    def scan(lo: int, hi: int, prefix: str, inside_class: bool) -> None:
        i = lo
        while i < hi:
            c = text[i]
            if c.isspace() or c in ";,":
                i += 1
                continue
            if m := _JS_CLASS.match(text, i):
                brace = text.find("{", m.end() - 1)
                scan(brace + 1, pairs[brace], f"{prefix}{m[1]}.", True)
                i = pairs[brace] + 1
                continue
            if m := re.compile(r"(?:export\s+)?(?:namespace|module)\s+([\w.]+)\s*(?=\{)").match(text, i):
                brace = text.find("{", m.end())
                scan(brace + 1, pairs[brace], f"{prefix}{m[1]}.", False)
                i = pairs[brace] + 1
                continue
            m = (_JS_METHOD if inside_class else _JS_FUNCTION).match(text, i)
            if m and (m[1] or "") not in _NOT_NAMES:
                brace = _body(text, pairs, m.end())
                if brace is not None and brace < hi:
                    add(prefix + (m[1] or "default"), i, pairs[brace])
                    i = pairs[brace] + 1
                    continue
            # any other statement: it is a unit if it holds a function
            j = i
            while j < hi and text[j] not in ";":
                if text[j] in _OPEN:
                    j = pairs[j]
                    if text[j] == "}" and re.match(r"\s*\n", text[j + 1 : j + 40] + "\n") and not re.match(r"\s*[.,()\[=?:|&+*/-]", text[j + 1 :]):
                        break
                elif text[j] == "\n" and re.match(r"\s*(?:export|import|function|class|const|let|var|async|@|\}|$)", text[j:]):
                    break
                j += 1
            part = text[i : j + 1]
            if re.search(r"=>|\bfunction\b", part):
                named = _JS_VAR.match(text, i) or re.match(r"\s*((?:module\.)?[\w.#]+)\s*[=:(]", text[i:hi])
                title = re.match(r"\s*(?:describe|it|test)(?:\.\w+)*\(\s*([\"'`])(.*?)\1", src[i:hi], re.S)
                add(prefix + (title[2] if title else named[1] if named else "anonymous"), i, min(j, hi))
            i = max(j + 1, i + 1)

    scan(0, len(text), "", False)
    return out


def _java(src: str) -> list[Function] | None:
    text = blank(src, "java")
    pairs = match_brackets(text)
    if pairs is None:
        return None
    lines, out = src.split("\n"), []

    def scan(lo: int, hi: int, prefix: str) -> None:
        i = lo
        while i < hi:
            j = i
            while j < hi and text[j] not in ";{":
                j = pairs[j] if text[j] in "([" and j in pairs else j
                j += 1
            if j >= hi or text[j] == ";":
                i = j + 1
                continue
            head = text[i:j]
            at = i + len(head) - len(head.lstrip())
            kind = re.search(r"\b(class|interface|enum|record)\s+(\w+)", head)
            call = re.search(r"(\w+)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:throws\s+[\w.,\s]+)?$", head.rstrip() + "")
            value = re.search(r"(\w+)\s*=[^=].*$", head, re.S)
            if kind and not call or kind and kind[1] == "record":
                scan(j + 1, pairs[j], f"{prefix}{kind[2]}.")
            elif value and ("->" in head or re.search(r"\bnew\b", head)):
                end = pairs[j]
                out.append(Function(prefix + value[1], _lead(lines, _line(text, at), ("//", "*", "/*", "@")), _line(text, at), _line(text, end)))
            elif call and call[1] not in _NOT_NAMES:
                start = _line(text, at)
                out.append(Function(prefix + call[1], _lead(lines, start, ("//", "*", "/*", "@")), start, _line(text, pairs[j])))
            i = pairs[j] + 1

    for m in _JAVA_TYPE.finditer(text):
        brace = text.find("{", m.end() - 1)
        if not any(a < m.start() < b for a, b in pairs.items() if text[a] == "{"):
            scan(brace + 1, pairs[brace], f"{m[1]}.")
    return sorted(out, key=lambda f: (f.start, f.end))


def _python(src: str) -> list[Function] | None:
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError):
        return None
    lines, out = src.split("\n"), []

    def visit(body: list, prefix: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                out.append(Function(prefix + node.name, _lead(lines, first, ("#",)), first, node.end_lineno))
            elif isinstance(node, ast.ClassDef):
                visit(node.body, f"{prefix}{node.name}.")
            elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []), prefix)
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, prefix)

    visit(tree.body, "")
    return sorted(out, key=lambda f: f.start)


_PARSERS = {"go": _go, "python": _python, "javascript": _js, "typescript": _js, "java": _java}


def functions(path: str, src: str) -> list[Function] | None:
    """The functions of a file; None if its language is unknown or it can't be read."""
    language = language_of(path)
    return _PARSERS[language](src.replace("\r\n", "\n")) if language else None


def context(path: str, src: str, limit: int = CONTEXT_BYTES) -> str:
    """Package and import lines, at most ``limit`` bytes."""
    found, used = [], 0
    for line in re.findall(r"^(?:package|import|from|use|require|#include)\b[^\n]*(?:\([^)]*\))?", src, re.M):
        used += len(line.encode()) + 1
        if used > limit:
            break
        found.append(line)
    return "\n".join(found)


def code_breaks(path: str):
    """Breaks for ``split``: the first lines of functions."""
    return lambda lines: {f.lead for f in functions(path, "\n".join(lines)) or []}
