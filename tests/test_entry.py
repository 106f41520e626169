"""What the driver calls."""

import __spark_entry__


def test_names_and_sql():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_general_part_stands_alone():
    import ast
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for p in (root / "jobweave").rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["skill_a", "skill_b", "joint", "lift", "npmi", "jaccard"]
