"""JSON and Newick trees, and directed multigraphs, as columns and tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_at(text: Column, *path: str | int) -> Column:
    """The value at a path of keys and indices, as text; null where there is none."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(text, "$" + steps)


def json_pretty(text: Column, schema: str) -> Column:
    """Parsed by a schema and written again with line breaks."""
    return F.to_json(F.from_json(text, schema), {"pretty": "true"})


def json_value(text: Column) -> Column:
    """A text of any JSON parsed without a schema; null where it is none."""
    return F.try_parse_json(text)


def json_text(value: Column, pretty: bool = False) -> Column:
    """A parsed value written again; with ``pretty`` with line breaks, two blanks a level."""
    plain = F.to_json(value)
    if not pretty:
        return plain

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in texts], dtype=object)

    return run(plain)


def parse_newick(text: str) -> list[tuple[int, int, str, float | None]]:
    """(node, parent, name, distance) of a tree's nodes in the order in which they end; the
    root's parent is -1."""
    nodes: list[list] = []
    waiting: list[list[int]] = []
    i = 0
    while i < len(text) and text[i] != ";":
        if text[i] in " \t\r\n,":
            i += 1
        elif text[i] == "(":
            waiting.append([])
            i += 1
        else:
            children: list[int] = []
            if text[i] == ")":
                if not waiting:
                    raise ValueError("an unexpected )")
                children = waiting.pop()
                i += 1
            start = i
            while i < len(text) and text[i] not in ",();":
                i += 1
            name, _, length = text[start:i].strip().partition(":")
            nodes.append([len(nodes), -1, name, float(length) if length.strip() else None])
            for c in children:
                nodes[c][1] = len(nodes) - 1
            if waiting:
                waiting[-1].append(len(nodes) - 1)
    if waiting:
        raise ValueError("a ) is missing")
    return [tuple(n) for n in nodes]


def format_newick(nodes: list[tuple[int, int, str, float | None]]) -> str:
    children: dict[int, list] = {}
    for n in nodes:
        children.setdefault(n[1], []).append(n)

    def text(n) -> str:
        inner = ",".join(text(c) for c in children.get(n[0], []))
        return (f"({inner})" if inner else "") + n[2] + (f":{n[3]:g}" if n[3] is not None else "")

    return ",".join(text(n) for n in children.get(-1, [])) + ";"


@F.udtf(returnType="node int, parent int, name string, distance double")
class NewickNodes:
    """The nodes of a tree, for LATERAL joins."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from parse_newick(text)


def without_vertices(vertices: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph (vertices id, arcs src, dst) without some vertices and all of their arcs."""
    gone = gone.select("id")
    left = arcs.join(gone, arcs["src"] == gone["id"], "left_anti")
    return vertices.join(gone, "id", "left_anti"), left.join(gone, left["dst"] == gone["id"], "left_anti")


def degrees(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, out_arcs, in_arcs)."""
    ends = arcs.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(arcs.select(F.col("dst").alias("id"), F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return vertices.join(sums, "id", "left").select("id", F.coalesce("o", F.lit(0).cast("long")).alias("out_arcs"), F.coalesce("i", F.lit(0).cast("long")).alias("in_arcs"))


def with_arcs(vertices: DataFrame, arcs: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with more arcs (src, dst), parallel ones too, and the vertices that they name."""
    ends = added.select(F.col("src").alias("id")).union(added.select("dst"))
    return vertices.select("id").union(ends).distinct(), arcs.select("src", "dst").union(added.select("src", "dst"))


def without_arcs(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    """Arcs but those from and to the same vertices as one of ``gone``."""
    return arcs.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def graph_lines(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """A line for each vertex: its name, then after a tab each arc's end and number of arcs."""
    each = arcs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    ends = each.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "n"))).alias("ends"))
    text = F.transform("ends", lambda x: F.concat_ws("x", x["dst"].cast("string"), x["n"].cast("string")))
    return vertices.join(ends, "id", "left").orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), text).alias("value"))
