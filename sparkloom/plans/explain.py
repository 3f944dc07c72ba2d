"""Plans as text, in detail, and as a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Explained:
    text: str
    detailed: str
    dot: str


def _tree(node, lines: list[str], edges: list[str], depth: int = 0) -> int:
    me = len(lines)
    lines.append("  " * depth + node.simpleString(100))
    children = node.children()
    for k in range(children.size()):
        child = _tree(children.apply(k), lines, edges, depth + 1)
        edges.append(f"  n{child} -> n{me};")
    return me


def explain(df: DataFrame) -> Explained:
    """The optimized plan as an indented tree and in Graphviz's language, and Spark's formatted physical plan."""
    execution = df._jdf.queryExecution()
    lines: list[str] = []
    edges: list[str] = []
    _tree(execution.optimizedPlan(), lines, edges)
    label = lambda x: x.strip().replace("\\", "\\\\").replace('"', '\\"')
    nodes = [f'  n{i} [label="{label(x)}"];' for i, x in enumerate(lines)]
    dot = "\n".join(["digraph plan {", "  node [shape=box];", *nodes, *edges, "}"])
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return Explained("\n".join(lines), execution.explainString(mode), dot)
