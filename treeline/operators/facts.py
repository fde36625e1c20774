"""P3 ``python_facts``: one real parse per ``.py`` file, run as a Spark job.

Python's grammar (multi-line statements, nested imports, syntax errors) cannot
be matched by SQL, so this is the one place that needs Python: a
``mapInPandas`` over the partitions of the inventory. It is narrow (no
shuffle) and keeps every passthrough column, so no join back is needed. Only
rows whose ``content`` is non-null are parsed; the caller nulls the content of
every other row before the job, so only Python text crosses into Python.
"""

from __future__ import annotations

import ast
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STMT_TYPE = T.StructType([
    T.StructField("module", T.StringType()),
    T.StructField("is_relative", T.BooleanType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("names", T.ArrayType(T.StringType())),
])

FACT_FIELDS = [
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("ast_main", T.BooleanType()),
    T.StructField("ast_tests", T.BooleanType()),
    T.StructField("stmts", T.ArrayType(STMT_TYPE)),
]


def parse_python(text) -> tuple[list, bool, bool, list]:
    """Facts of one file: (imports, has_main, has_tests, statements).

    imports: ``import a, b`` adds a and b, ``from m import x`` adds m, a
    module-less ``from . import x`` adds nothing; walk order is breadth first.
    Any failure to parse gives no facts.
    """
    if text is None:
        return [], False, False, []
    if isinstance(text, (bytes, bytearray)):
        text = bytes(text).decode("utf-8", errors="ignore")
    try:
        tree = ast.parse(text)
        nodes = list(ast.walk(tree))
    except Exception:  # syntax errors, null bytes, deep nesting
        return [], False, False, []
    imports: list[str] = []
    stmts: list[dict] = []
    has_main = False
    has_tests = False
    for node in nodes:
        if isinstance(node, ast.Import):
            for alias in node.names:
                imports.append(alias.name)
                stmts.append({"module": alias.name, "is_relative": False, "level": 0,
                              "line_number": node.lineno, "names": []})
        elif isinstance(node, ast.ImportFrom):
            if node.module:
                imports.append(node.module)
            level = node.level or 0
            stmts.append({"module": node.module or "", "is_relative": level > 0, "level": level,
                          "line_number": node.lineno, "names": [a.name for a in node.names]})
        elif isinstance(node, ast.If) and not has_main:
            test = node.test
            if (isinstance(test, ast.Compare) and isinstance(test.left, ast.Name)
                    and test.left.id == "__name__"):
                has_main = True
        elif not has_tests:
            if isinstance(node, ast.FunctionDef) and node.name.startswith("test_"):
                has_tests = True
            elif isinstance(node, ast.ClassDef) and node.name.startswith("Test"):
                has_tests = True
    return imports, has_main, has_tests, stmts


def _facts_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [parse_python(t) if t is not None else ([], False, False, [])
                  for t in pdf["content"]]
        ok = pdf["text_ok"] if "text_ok" in pdf.columns else [True] * len(pdf)
        out = pdf.drop(columns=[c for c in ("content", "text_ok") if c in pdf.columns])
        out["imports"] = [p[0] for p in parsed]
        out["ast_main"] = [p[1] for p in parsed]
        out["ast_tests"] = [p[2] for p in parsed]
        # the statement reader decodes strictly: text with bad bytes gives no statements
        out["stmts"] = [p[3] if good is not False else [] for p, good in zip(parsed, ok)]
        yield out


def python_facts(df: DataFrame) -> DataFrame:
    """Replace ``content`` (and ``text_ok``) by the parsed facts; other columns pass through."""
    from treeline.session import ship_package
    ship_package(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in ("content", "text_ok")]
    schema = T.StructType(keep + FACT_FIELDS)
    return df.mapInPandas(_facts_batches, schema=schema)


def statements(files: DataFrame) -> DataFrame:
    """P3 statement table ``imports``: one row per import statement."""
    return (files
            .select("repo_id", "file_seq", "relative_path",
                    F.posexplode("stmts").alias("stmt_no", "s"))
            .select("repo_id", "file_seq", "relative_path", "stmt_no",
                    F.col("s.module").alias("module"), F.col("s.is_relative").alias("is_relative"),
                    F.col("s.level").alias("level"), F.col("s.line_number").alias("line_number"),
                    F.col("s.names").alias("names")))
