"""Facts of Python source files, a row each, from their syntax trees. What names mean over files is left to joins."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.lineage import bounded_batches

#: path; module (dotted, of the path); kind (import, function, class, decorator, call, assign); owner: the function or class it is in ("" for the
#: module's top); name; target: the callee, as written, or what an import names in full; values: key=value of the arguments (0=, 1= for those
#: without a name; a list's items one by one; a class's bases); place: the order in the file.
FACTS = "path string, module string, kind string, owner string, name string, target string, values array<string>, line int, end_line int, place int"


def module_of(path: str) -> str:
    return re.sub(r"(^|\.)__init__$", "", re.sub(r"\.py$", "", path).strip("/").replace("/", "."))


def _text(node: ast.AST) -> str:
    """A literal as it is, {} for what a format string fills in or what is added to a string; names dotted; calls with their arguments."""
    if isinstance(node, ast.Constant):
        return "" if node.value is None else str(node.value)
    if isinstance(node, ast.JoinedStr):
        return "".join(str(v.value) if isinstance(v, ast.Constant) else "{}" for v in node.values)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        left, right = (_text(x) if _is_string(x) else "{}" for x in (node.left, node.right))
        return left + right if _is_string(node.left) or _is_string(node.right) else "{}"
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_text(node.value)}.{node.attr}"
    if isinstance(node, ast.Call):
        return f"{_text(node.func)}({','.join(_text(a) for a in node.args)})"
    return "{}"


def _is_string(node: ast.AST) -> bool:
    if isinstance(node, ast.BinOp):
        return isinstance(node.op, ast.Add) and (_is_string(node.left) or _is_string(node.right))
    return isinstance(node, ast.JoinedStr) or (isinstance(node, ast.Constant) and isinstance(node.value, str))


def _values(call: ast.Call) -> list[str]:
    pairs = [*((str(k), a) for k, a in enumerate(call.args)), *((a.arg or "**", a.value) for a in call.keywords)]
    return [f"{key}={_text(x)}" for key, a in pairs for x in (a.elts if isinstance(a, ast.List | ast.Tuple | ast.Set) else [a])]


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.module, self.owner, self.rows = path, module_of(path), "", []
        self.above, self.place = 0, 0  # lines before this piece, facts before it

    def fact(self, node: ast.AST, kind: str, name: str, target: str = "", values: list[str] = (), owner: str | None = None) -> None:
        self.rows.append((self.path, self.module, kind, self.owner if owner is None else owner, name, target, list(values), node.lineno + self.above, getattr(node, "end_lineno", node.lineno) + self.above, self.place))
        self.place += 1

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.fact(node, "import", a.asname or a.name.partition(".")[0], a.name if a.asname else a.name.partition(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        parts = self.module.split(".")
        package = parts if re.search(r"(^|/)__init__\.py$", self.path) else parts[:-1]
        base = ".".join([*package[: len(package) - node.level + 1], *([node.module] if node.module else [])]) if node.level else node.module
        for a in node.names:
            self.fact(node, "import", a.asname or a.name, f"{base}.{a.name}".lstrip("."))

    def _inside(self, node: ast.AST, kind: str, values: list[str]) -> None:
        name = f"{self.owner}.{node.name}".lstrip(".")
        self.fact(node, kind, name, values=values)
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            self.fact(d, "decorator", name, _text(call.func if call else d), _values(call) if call else [])
        before, self.owner = self.owner, name
        for child in node.body:
            self.visit(child)
        self.owner = before

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a = node.args
        self._inside(node, "function", [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._inside(node, "class", [_text(b) for b in node.bases])

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call):
            for t in node.targets:
                if isinstance(t, ast.Name | ast.Attribute):
                    self.fact(node, "assign", _text(t), _text(node.value.func), _values(node.value))
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        self.fact(node, "call", "", _text(node.func), _values(node))
        self.generic_visit(node)


#: Characters of a file that are parsed at once, from one statement of the module to another; a single longer statement is parsed whole.
PIECE = 1 << 18
#: A line that may begin a statement of the module: not indented, no rest of the statement before.
_BEGINS = re.compile(r"^(?!(?:else|elif|except|finally)\b)[@\w(\[{'\"*~+\-]", re.MULTILINE)
#: Rows that are handed on at once.
ROWS = 10_000


def _parsed(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _cuts(text: str) -> list[int]:
    """Where the pieces begin, and the end. A cut inside a statement leaves a beginning that doesn't parse, so the piece gets twice as long."""
    cuts, long = [0], PIECE
    while cuts[-1] < len(text):
        start = cuts[-1]
        found = _BEGINS.search(text, start + long) if start + long < len(text) else None
        end = found.start() if found else len(text)
        try:
            _parsed(text[start:end])
        except SyntaxError:
            if end == len(text):
                raise
            long *= 2
            continue
        cuts.append(end)
        long = PIECE
    return cuts


def facts_of(path: str, text: str) -> Iterator[list[tuple]]:
    """The facts of a file by pieces, so that no tree of a whole large file is held. A file that isn't Python gives none."""
    try:
        found = _Facts(path)
        cuts = _cuts(text) if len(text) > PIECE else [0, len(text)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            found.visit(_parsed(text[start:end] if len(cuts) > 2 else text))
            found.above += sum(n * text.count(x, start, end) for x, n in (("\n", 1), ("\r", 1), ("\r\n", -1)))
            yield found.rows
            found.rows = []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return


def python_facts(files: DataFrame) -> DataFrame:
    """FACTS of files (path from the project's top, text). Null texts and files that don't parse have none."""
    bounded_batches(files.sparkSession)
    columns = [c.split(" ")[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                for part in facts_of(path, text) if text else ():
                    rows += part
                    while len(rows) >= ROWS:
                        yield pd.DataFrame(rows[-ROWS:], columns=columns)
                        del rows[-ROWS:]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text").mapInPandas(run, FACTS)
