"""Large source files: parsed in pieces or handed on in bounded batches, with the same facts."""

import pandas as pd
import pytest

from graphmill.sources import frontend, java, python


class Files:
    """Stands for a frame of files and gives the function that runs on its batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):  # noqa: N802
        return run


def test_python_pieces(monkeypatch):
    one = '@r.get("/a/{k}")\nasync def p{k}(x: int):\n    """doc\nimport no\n"""\n    return q.f{k}(x)\nif x:\n    g()\nelse:\n    h(\n1,\n)\n'
    text = "x = '''a\nb\n'''\nimport os\r\n" + "".join(one.replace("{k}", str(k)) for k in range(200))
    whole = list(python.facts_of("m/a.py", text))
    assert len(whole) == 1
    for size in (30, 333, 5000):
        monkeypatch.setattr(python, "PIECE", size)
        parts = list(python.facts_of("m/a.py", text))
        assert len(parts) > 1 and [r for p in parts for r in p] == whole[0]
    assert list(python.facts_of("m/a.py", text + "\ndef (")) == []


@pytest.mark.parametrize(
    ("facts", "path", "text"),
    [
        (python.python_facts, "a.py", "\n".join(f"f{k}(1)" for k in range(25_000))),
        (java.java_facts, "A.java", "class A { void a() {" + "\n".join(f"f{k}(1);" for k in range(25_000)) + "} }"),
        (frontend.frontend_facts, "a.js", "function a() {" + "\n".join(f"f{k}(1);" for k in range(25_000)) + "}"),
    ],
)
def test_batches_are_bounded(spark, facts, path, text):
    sizes = [len(x) for x in facts(Files(spark))(iter([pd.DataFrame({"path": [path, "b", "c"], "text": [text, None, ""]})]))]
    assert sum(sizes) >= 25_000 and max(sizes) < 20_000
