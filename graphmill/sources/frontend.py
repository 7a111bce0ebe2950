"""Facts of JavaScript, TypeScript and Vue sources, a row each: imports, functions, calls and routes. What names mean over files is left to joins."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.lineage import bounded_batches

#: path; kind (import, function, call, route); owner: the function it is in ("" for the file's top); name: of the function, or what an import is called
#: here (* for a whole module); target: the file or package imported and the name there (file#name), the callee as written, or a route's component;
#: values: a call's arguments as text (literals as they are, template parts as ${...}), a route's path; line.
FACTS = "path string, kind string, owner string, name string, target string, values array<string>, line int, place int"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[^\W\d][\w$]*|\$[\w$]*|\#[\w$]+)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|\?\.|.)""",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.DOTALL | re.IGNORECASE)
# Words before a bracket that aren't calls.
_NO_CALL = frozenset("if for while switch catch function return typeof await async new of in with import super".split())
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do".split())


def _template(text: str, at: int) -> int:
    """The place after the template string that begins at `at`; its parts may hold strings and templates."""
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template(text, at)
                    continue
                if text[at] in "'\"":
                    at = _TOKEN.match(text, at).end()
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return at


def _tokens(text: str, line: int) -> list[tuple[str, str, int]]:
    out, at, words = [], 0, {}  # a word that comes again is held once
    while at < len(text):
        if text[at] == "`":
            end, kind = _template(text, at), "text"
        elif text[at] == "/" and (not out or out[-1][1] in _BEFORE_REGEX or (out[-1][0] == "mark" and out[-1][1] not in ")]}")) and (m := _REGEX.match(text, at)):
            end, kind = m.end(), "regex"
        else:
            m = _TOKEN.match(text, at)
            end, kind = m.end(), m.lastgroup
        if kind != "skip":
            word = text[at:end]
            out.append((kind, words.setdefault(word, word), line))
        line += text.count("\n", at, end)
        at = end
    return out


def resolved(path: str, module: str) -> str:
    """The path of a module named in a file: relative to it, or to src for @/; without an ending of source files. Packages stay as they are."""
    if module.startswith("@/"):
        top = path.partition("src/")[0] if "src/" in path else ""
        module = f"{top}src/{module[2:]}" if "src/" in path else module[2:]
    elif module.startswith("."):
        module = posixpath.normpath(posixpath.join(posixpath.dirname(path), module))
    return re.sub(r"(/index)?\.(ts|js|tsx|jsx|vue|mjs)$", "", module)


class _File:
    def __init__(self, path: str):
        self.path, self.rows, self.here = path, [], resolved("", path)

    def fact(self, kind: str, owner: str, name: str, target: str, values: list[str], line: int) -> None:
        self.rows.append((self.path, kind, owner, name, target, values, line, len(self.rows)))

    def script(self, text: str, line: int) -> None:
        t = [*_tokens(text, line), *[("end", "\0", 0)] * 4]
        closes = self._closes(t)
        ends: list[tuple[int, str]] = []  # functions that are open: the place they end, their names
        at, n = 0, len(t) - 4
        while at < n:
            while ends and at >= ends[-1][0]:
                ends.pop()
            owner = ends[-1][1] if ends else ""
            kind, word, here = t[at]
            if kind == "word" and word == "import" and t[at + 1][1] not in ("(", "."):
                at = self._import(t, at, n)
                continue
            if kind == "word" and word in ("function", "const", "let", "var", "async") or (kind == "word" and t[at + 1][1] in ("(", ":", "=")):
                found = self._function(t, at, closes, n)
                if found:
                    name, end = found
                    whole = f"{owner}.{name}" if owner else name
                    self.fact("function", owner, whole, "", [], here)
                    ends.append((end, whole))
                    at += 1 if word not in ("function", "async", "const", "let", "var") else (2 if t[at + 1][1] != "function" else 3)
                    continue
            if kind == "word" and word == "path" and t[at + 1][1] == ":" and t[at + 2][0] == "text":
                self._route(t, at, n, closes)
            if kind == "word" and word not in _NO_CALL and (opens := self._opens(t, at)) and t[at - 1][1] != "function":
                name, back = word, at
                while back >= 2 and t[back - 1][1] in (".", "?.") and t[back - 2][0] == "word":
                    back -= 2
                    name = f"{t[back][1]}.{name}"
                if back >= 1 and t[back - 1][1] in (".", "?."):
                    name = f".{name}"
                self.fact("call", owner, "", name, self._arguments(t, opens, closes), here)
            at += 1

    def _closes(self, t: list) -> dict[int, int]:
        out, open_ = {}, []
        for k, (kind, word, _) in enumerate(t):
            if kind == "mark" and word in "([{":
                open_.append(k)
            elif kind == "mark" and word in ")]}" and open_:
                out[open_.pop()] = k
        for k in open_:
            out[k] = len(t) - 4
        return out

    def _opens(self, t: list, at: int) -> int:
        """Where the arguments of a call begin, after type arguments as in get<User[]>(...); 0 if it is none."""
        if t[at + 1][1] == "(":
            return at + 1
        if t[at + 1][1] != "<":
            return 0
        depth, k = 0, at + 1
        while k < len(t) - 4 and (t[k][0] in ("word", "text") or t[k][1] in "<>[],.|{}:;&?"):
            if t[k][1] == t[k + 1][1] == "&":
                return 0
            depth += (t[k][1] == "<") - (t[k][1] == ">")
            k += 1
            if not depth:
                return k if t[k][1] == "(" else 0
        return 0

    def _arguments(self, t: list, opens: int, closes: dict[int, int]) -> list[str]:
        out, begin, k, stop = [], opens + 1, opens + 1, closes.get(opens, len(t) - 4)
        while k <= stop:
            if k == stop or t[k][1] == ",":
                if k > begin:
                    out.append(self._text(t, begin, k))
                begin = k + 1
            elif k in closes:
                k = closes[k]
            k += 1
        return out

    def _text(self, t: list, a: int, b: int) -> str:
        """Strings and templates without quotes, added ones as one with ${} for other operands; else the tokens."""
        if t[a][0] == "text" or (b - a > 2 and any(t[k][0] == "text" and t[k - 1][1] == "+" for k in range(a + 1, b))):
            parts, k, begin, depth = [], a, a, 0
            for k in range(a, b + 1):
                depth += (k < b and t[k][1] in "([{") - (k < b and t[k][1] in ")]}")
                if k == b or (t[k][1] == "+" and not depth):
                    parts.append(t[begin][1].strip("'\"`") if k - begin == 1 and t[begin][0] == "text" else "${}")
                    begin = k + 1
            return "".join(parts)
        return "".join(w for _, w, _ in t[a:b])

    def _import(self, t: list, at: int, n: int) -> int:
        line, names, k = t[at][2], [], at + 1
        while k < n and t[k][0] != "text" and t[k][1] != ";":
            word = t[k][1]
            if t[k][0] == "word" and word not in ("from", "type", "as"):
                if t[k + 1][1] == "as":
                    names.append((t[k + 2][1], word))
                    k += 2
                elif word not in [x[0] for x in names]:
                    inside = any(t[j][1] == "{" for j in range(at, k)) and not any(t[j][1] == "}" for j in range(at, k))
                    names.append((word, word if inside else "default"))
            elif word == "*" and t[k + 1][1] == "as":
                names.append((t[k + 2][1], "*"))
                k += 2
            k += 1
        if k < n and t[k][0] == "text":
            module = resolved(self.path, t[k][1].strip("'\"`"))
            for here, there in names or [("", "")]:
                self.fact("import", "", here, f"{module}#{there}", [], line)
        return k + 1

    def _function(self, t: list, at: int, closes: dict[int, int], n: int) -> tuple[str, int] | None:
        """Name and end of a function declared at `at`: function f() {}, const f = (...) => ..., f = function, f(...) {} or f: (...) => in an object or class."""
        k = at
        if t[k][1] == "async":
            k += 1
        if t[k][1] == "function":
            k += 1 + (t[k + 1][1] == "*")
            opens = k + 1
            if t[k][0] != "word" or t[opens][1] != "(":
                return None
            return self._body(t, t[k][1], closes.get(opens, n) + 1, closes, n)
        if t[k][1] in ("const", "let", "var"):
            k += 1
            if t[k + 1][1] not in ("=", ":"):
                return None
        name = t[k][1]
        if t[k][0] != "word" or name in _NO_CALL or name == "component":  # a route's component isn't a function of the file
            return None
        k += 1
        if t[k][1] == "(":  # a method: name(...) {
            end = closes.get(k, n) + 1
            if t[at - 1][1] in (".", "?.", "new", "function", "=>", "=", "(", "&", "|", "!", "?", "return", "await") or t[end][1] not in ("{", ":") or (t[end][1] == ":" and t[at - 1][1] == "?"):
                return None
            return self._body(t, name, end, closes, n) if t[end][1] == "{" else None
        if t[k][1] not in ("=", ":"):
            return None
        k += 1
        if t[k][1] == "async":
            k += 1
        if t[k][1] == "function":
            k += 1 + (t[k + 1][1] == "*") + (t[k + 1][0] == "word")
            return self._body(t, name, closes.get(k, n) + 1, closes, n) if t[k][1] == "(" else None
        after = closes.get(k, n) + 1 if t[k][1] == "(" else k + 1
        if t[after][1] == ":":  # a return type
            j = after + 1
            while j < n and t[j][1] not in ("=>", ";", "{"):
                j += 1
            after = j
        return self._body(t, name, after + 1, closes, n) if after < n and t[after][1] == "=>" else None

    def _body(self, t: list, name: str, at: int, closes: dict[int, int], n: int) -> tuple[str, int]:
        while at < n and t[at][1] == ":" or (at < n and t[at][0] == "word" and t[at - 1][1] in (":", "<", ",")):
            at += 1
        if t[at][1] == "{":
            return name, closes.get(at, n) + 1
        k = at
        while k < n and t[k][1] not in (";", ",", ")", "}"):
            k = closes[k] + 1 if k in closes else k + 1
            if k < n and t[k][2] > t[k - 1][2] and t[k][1] not in (".", "?.", "+", "?", ":"):
                break
        return name, k

    def _route(self, t: list, at: int, n: int, closes: dict[int, int]) -> None:
        """path: '...' and, in the same object, component: () => import('...') or a name."""
        k, component = at + 3, ""
        while k < n and t[k][1] != "}":
            if t[k][1] == "component" and t[k + 1][1] == ":":
                for j in range(k + 2, min(n, k + 10)):
                    if t[j][1] == "import" and t[j + 1][1] == "(" and t[j + 2][0] == "text":
                        component = resolved(self.path, t[j + 2][1].strip("'\"`"))
                        break
                    if t[j][0] == "word" and t[k + 2][0] == "word" and j == k + 2:
                        component = t[j][1]
                break
            k = closes[k] + 1 if k in closes else k + 1
        if component:
            self.fact("route", "", "", component, [t[at + 2][1].strip("'\"`")], t[at][2])


def facts_of(path: str, text: str) -> list[tuple]:
    found = _File(path)
    if path.endswith((".vue", ".html")):
        for m in _SCRIPT.finditer(text):
            found.script(m[1], 1 + text.count("\n", 0, m.start(1)))
    else:
        found.script(text, 1)
    return found.rows


#: Rows that are handed on at once.
ROWS = 10_000


def frontend_facts(files: DataFrame) -> DataFrame:
    """FACTS of files (path from the project's top, text); of .vue and .html files their scripts. Null and empty texts have none."""
    bounded_batches(files.sparkSession)
    columns = [c.split(" ")[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                rows += facts_of(path, text) if text else []
                while len(rows) >= ROWS:
                    yield pd.DataFrame(rows[-ROWS:], columns=columns)
                    del rows[-ROWS:]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text").mapInPandas(run, FACTS)
