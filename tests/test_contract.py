import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 45


def test_nothing_imports_the_text_subpackage():
    for f in (ROOT / "lithoflow").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text("utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f
