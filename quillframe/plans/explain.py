"""Text and DOT views of Catalyst's own plans. There is no plan tree beside Spark's."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import DataFrame


def _plan(df: DataFrame, optimized: bool):
    execution = df._jdf.queryExecution()
    return execution.optimizedPlan() if optimized else execution.analyzed()


def logical_text(df: DataFrame) -> str:
    return _plan(df, False).toString()


def optimized_text(df: DataFrame) -> str:
    return _plan(df, True).toString()


def _cluster(plan, title: str, name: str) -> list[str]:
    lines, ids = [f"  subgraph cluster_{name} {{", f'    label="{title}";'], iter(range(1 << 30))

    def add(node) -> str:
        me = f"{name}_{next(ids)}"
        label = node.simpleString(25).replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'    {me} [shape=box, label="{label}"];')
        children = node.children()
        for i in range(children.size()):
            lines.append(f"    {me} -> {add(children.apply(i))};")
        return me

    add(plan)
    return [*lines, "  }"]


def to_dot(df: DataFrame, optimized: bool = False) -> str:
    """The plan as written and, if asked, the optimized one beside it."""
    parts = _cluster(_plan(df, False), "Unoptimized Plan", "unoptimized")
    if optimized:
        parts += _cluster(_plan(df, True), "Optimized Plan", "optimized")
    return "\n".join(["digraph G {", *parts, "}"])


def explain(df: DataFrame, path: str | None = None, optimized: bool = False) -> str:
    dot = to_dot(df, optimized)
    if path is None:
        return dot
    if path.endswith(".png"):
        if not shutil.which("dot"):
            raise RuntimeError("no Graphviz binary 'dot' to render a PNG with; give a path that ends in .dot")
        subprocess.run(["dot", "-Tpng", "-o", path], input=dot.encode(), check=True)
    else:
        with open(path, "w", encoding="utf-8") as out:
            out.write(dot)
    return dot
