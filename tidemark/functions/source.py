"""Source text: line differences as unified hunks, and the complexity of functions."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_LINES, CONTEXT = 1500, 3


def unified(old: str, new: str) -> str:
    """The hunks that turn one text into the other; texts over ``MOST_LINES`` lines are replaced as a whole."""
    a, b = (x.replace("\r\n", "\n").split("\n") if x else [] for x in (old, new))
    if a == b:
        return ""
    if max(len(a), len(b)) > MOST_LINES:
        return "\n".join([f"@@ -1,{len(a)} +1,{len(b)} @@", *("-" + x for x in a), *("+" + x for x in b)])
    lines = list(difflib.unified_diff(a, b, n=CONTEXT, lineterm=""))
    return "\n".join(lines[2:])


@F.pandas_udf(T.StringType())
def unified_diff(old: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in old:
        yield pd.Series([unified(x or "", y or "") for x, y in zip(a, b, strict=True)])


_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Match)


def _own(node: ast.AST):
    """The nodes of a function without those of functions within it."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield child
            yield from _own(child)


def _cognitive(node: ast.AST, depth: int) -> int:
    total = 0
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if isinstance(child, _NEST):
            chained = isinstance(child, ast.If) and isinstance(node, ast.If) and node.orelse == [child]
            total += 1 if chained else 1 + depth
            total += _cognitive(child, depth if chained else depth + 1)
        else:
            total += len(child.values) - 1 if isinstance(child, ast.BoolOp) else isinstance(child, ast.IfExp) * (1 + depth)
            total += _cognitive(child, depth)
    return total


def complexity(source: str) -> list[tuple[str, int, int]] | None:
    """(name, cyclomatic, cognitive) of each function of a Python file, in order; None if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = list(_own(node))
            branches = sum(isinstance(n, _BRANCH) for n in own) + sum(len(n.values) - 1 for n in own if isinstance(n, ast.BoolOp)) + sum(len(n.cases) for n in own if isinstance(n, ast.Match))
            out.append((node.lineno, node.name, 1 + branches, _cognitive(node, 0)))
    return [x[1:] for x in sorted(out)]


_FUNCTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("cyclomatic", T.IntegerType()), T.StructField("cognitive", T.IntegerType())]))


@F.pandas_udf(_FUNCTIONS)
def functions_of(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The functions of a Python source, null if it doesn't parse: a parser is no relational operator."""
    as_rows = lambda own: None if own is None else [dict(zip(("name", "cyclomatic", "cognitive"), f, strict=True)) for f in own]
    for batch in sources:
        yield batch.map(lambda s: None if s is None else as_rows(complexity(s)))
