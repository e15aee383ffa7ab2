"""Taint over Python functions: tables of assignments and calls, an ordered fold in each function, and bounded propagation across calls.

Parsing uses the standard library's parser (other grammars aren't available); the fold is local to a
file, and the propagation across functions is a join a level over the call edges.
"""

from __future__ import annotations

import ast
import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpoint, scratch

@dataclass(frozen=True)
class TaintRule:
    rule_id: str
    sinks: tuple[tuple[str, int], ...]  # name and argument, -1 for any
    sources: tuple[str, ...]
    sanitizers: tuple[str, ...] = ()


RULES = (
    TaintRule("TP-PY-SQL", (("execute", 0), ("executemany", 0)), ("request.args", "request.form", "input"), ("escape", "quote")),
    TaintRule("TP-PY-CMD", (("os.system", -1), ("subprocess.run", 0), ("popen", 0)), ("request.args", "request.form", "input", "sys.argv"), ("shlex.quote",)),
    TaintRule("TP-PY-EVAL", (("eval", 0), ("exec", 0)), ("request.args", "request.form", "input"), ("literal_eval",)),
)
def extended(rules: tuple[TaintRule, ...], rule_id: str | None = None, sources: tuple[str, ...] = (), sinks: tuple[tuple[str, int], ...] = (), sanitizers: tuple[str, ...] = ()) -> tuple[TaintRule, ...]:
    """The rules with further sources, sinks and sanitizers, of one rule or of all; what is there already isn't added again."""
    add = lambda old, new: (*old, *(x for x in dict.fromkeys(new) if x not in old))
    return tuple(replace(r, sources=add(r.sources, sources), sinks=add(r.sinks, sinks), sanitizers=add(r.sanitizers, sanitizers)) if rule_id in (None, r.rule_id) else r for r in rules)


SCHEMA = "path string, function string, line int, rule_id string, sink string, direct boolean, param int"
CALLS = "path string, caller string, callee string, line int, arg int, param int, tainted boolean"


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    if isinstance(node, (ast.Call, ast.Subscript)):
        return _dotted(node.func if isinstance(node, ast.Call) else node.value)
    return ""


def _is(name: str, wanted: str) -> bool:
    return name == wanted or name.endswith("." + wanted)


def _analyse(path: str, text: str, rules: tuple[TaintRule, ...]) -> tuple[list[tuple], list[tuple]]:
    """Findings and calls of one file; a variable is tainted by any rule's source and cleared by any rule's sanitizer, and assigning a clean value doesn't clear it."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    sources = {s for r in rules for s in r.sources}
    sanitizers = {s for r in rules for s in r.sanitizers}
    found, calls = [], []

    def source(node: ast.AST) -> bool:
        d = _dotted(node)
        return any(d == s or d.startswith(s + ".") or (isinstance(node, ast.Call) and _is(d, s)) for s in sources)

    def scan(body: list[ast.stmt], name: str, params: list[str]) -> None:
        taint: dict[str, set] = {p: {i} for i, p in enumerate(params)}  # parameter numbers, or -1 for a source

        def origins(node: ast.AST) -> set:
            if isinstance(node, ast.Call) and any(_is(_dotted(node), s) for s in sanitizers):
                return set()
            if source(node):
                return {-1}
            if isinstance(node, ast.Name):
                return taint.get(node.id, set())
            return set().union(*(origins(c) for c in ast.iter_child_nodes(node))) if list(ast.iter_child_nodes(node)) else set()

        def visit(node: ast.AST) -> None:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                scan(node.body, node.name, [a.arg for a in node.args.args])
                return
            if isinstance(node, ast.ClassDef):
                for c in node.body:
                    visit(c)
                return
            for c in ast.iter_child_nodes(node):
                visit(c)
            if isinstance(node, ast.Call):
                called = _dotted(node)
                for r in rules:
                    for sink, at in r.sinks:
                        if _is(called, sink):
                            for i, a in enumerate(node.args):
                                if at in (-1, i):
                                    for o in origins(a):
                                        found.append((path, name, node.lineno, r.rule_id, called, o == -1, o))
                for i, a in enumerate(node.args):
                    for o in origins(a):
                        calls.append((path, name, called.rpartition(".")[2], node.lineno, i, o, o == -1))
            elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and node.value is not None:
                cleans = isinstance(node.value, ast.Call) and any(_is(_dotted(node.value), s) for s in sanitizers)
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    for n in ast.walk(t):
                        if isinstance(n, ast.Name):
                            if cleans:
                                taint.pop(n.id, None)
                            else:
                                taint[n.id] = taint.get(n.id, set()) | origins(node.value)

        for s in body:
            visit(s)

    scan(tree.body, "<module>", [])
    return found, calls


def _run(files: DataFrame, rules: tuple[TaintRule, ...], which: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["content"], strict=True) for r in _analyse(p, t, rules)[which]], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def sink_hits(files: DataFrame, rules: tuple[TaintRule, ...] = RULES) -> DataFrame:
    """Sinks that a source (direct) or a parameter (its number) reaches within a function."""
    return _run(files, rules, 0, SCHEMA).distinct()


def call_edges(files: DataFrame, rules: tuple[TaintRule, ...] = RULES) -> DataFrame:
    """Calls with the argument that a source or a parameter of the caller reaches."""
    return _run(files, rules, 1, CALLS).distinct()


def call_graph(files: DataFrame) -> DataFrame:
    """(path, caller, callee)."""
    return call_edges(files).select("path", "caller", "callee").distinct()


def taint_findings(files: DataFrame, rules: tuple[TaintRule, ...] = RULES, max_depth: int = 3) -> DataFrame:
    """(path, function, line, rule_id, confidence): direct hits, and hits through at most max_depth calls with the suffix -IP.

    Backwards from each sink that a parameter reaches, one join over the file's call edges a level;
    seen (function, parameter, sink) triples aren't walked again.
    """
    with scratch(files.sparkSession) as keep:
        hits, calls = keep(sink_hits(files, rules)), keep(call_edges(files, rules))
        out = hits.where("direct").select("path", "function", "line", "rule_id", F.lit("medium").alias("confidence"))
        frontier = seen = hits.where("not direct").select("path", "function", "param", F.col("line").alias("sink_line"), "rule_id").distinct()
        for _ in range(max_depth):
            step = frontier.join(calls.select("path", F.col("callee").alias("function"), F.col("arg").alias("param"), "caller", F.col("param").alias("up"), "tainted"), ["path", "function", "param"])
            step = keep(step)
            out = out.unionByName(step.where("tainted").select("path", "function", F.col("sink_line").alias("line"), F.concat("rule_id", F.lit("-IP")).alias("rule_id"), F.lit("high").alias("confidence")))
            up = step.where("not tainted").select("path", F.col("caller").alias("function"), F.col("up").alias("param"), "sink_line", "rule_id").distinct()
            frontier = keep(up.join(seen, ["path", "function", "param", "sink_line", "rule_id"], "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return checkpoint(out.distinct())


def python_nodes(files: DataFrame) -> DataFrame:
    """(path, node, parent, kind, name, line): the syntax tree of each Python file as rows, numbered in document order; broken files give none."""

    def walk(path: str, text: str) -> Iterator[tuple]:
        try:
            stack = [(ast.parse(text or ""), -1)]
        except (SyntaxError, ValueError, RecursionError):
            return
        number = 0
        while stack:
            node, parent = stack.pop()
            yield path, number, parent, type(node).__name__, _dotted(node) or getattr(node, "name", None) or "", getattr(node, "lineno", 0)
            stack += [(c, number) for c in reversed(list(ast.iter_child_nodes(node)))]
            number += 1

    schema = "path string, node int, parent int, kind string, name string, line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["content"], strict=True) for r in walk(p, t)], columns=["path", "node", "parent", "kind", "name", "line"])

    return files.select("path", "content").mapInPandas(run, schema)


def backward_reach(edges: DataFrame, sinks: DataFrame, sources: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """(sink, source, depth): sources (node) from which a sink (node) is reached over edges (node, next), at the least depth.

    A backward closure over a data-flow edge table, one frontier join a level until a level finds
    nothing new; sanitizer nodes cut the walk, and a node that a sink has seen isn't walked again, so
    cycles end. Sixteen tables of levels are merged into one at a time, so plans stay small at any depth.
    """
    spark = edges.sparkSession
    back = edges.select(F.col("next").alias("node"), F.col("node").alias("before")).where("node is not null and before is not null").distinct()
    clean = sanitizers.select(F.col("node").alias("before")).distinct()
    with scratch(spark) as keep:
        back, clean = keep(back), keep(clean)
        seen = frontier = keep(sinks.select(F.col("node").alias("sink"), "node", F.lit(0).alias("depth")).where("node is not null").distinct())
        merged: list[list[DataFrame]] = [[seen]]
        for depth in itertools.count(1):
            step = frontier.select("sink", "node").join(back, "node").join(clean, "before", "left_anti").select("sink", F.col("before").alias("node")).distinct()
            frontier = keep(step.join(seen.select("sink", "node"), ["sink", "node"], "left_anti").withColumn("depth", F.lit(depth)))
            if frontier.isEmpty():
                break
            new = frontier
            for own in merged:
                own.append(new)
                if len(own) < 16:
                    break
                new = keep(functools.reduce(DataFrame.unionByName, own))
                own.clear()
            else:
                merged.append([new])
            seen = functools.reduce(DataFrame.unionByName, [x for own in merged for x in own])
        return checkpoint(seen.join(sources.select("node").distinct(), "node", "left_semi").select("sink", F.col("node").alias("source"), "depth"))
