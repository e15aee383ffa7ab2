"""Deeply nested JSON records to flat tables by Dewey labelling.

Every node of a record gets the list of its ordinals from the root (its Dewey label); the parent's
label is the label without its last ordinal, and nodes that share a schema path form one table.
Labels need nothing but the record itself, so the operator runs without any shuffle.

Defined results: rows without a key, null bodies, bodies that are no valid JSON (NaN and Infinity included) and records
without the wanted keys give no rows; nesting may be of any depth. Keys match in any letter case; of keys that differ in case
alone the last non-null one counts. Where the schema has a list, a bare value stands for a list of
one and a text that holds a JSON list or object stands for that. Nulls keep their ordinals but give
no rows. Numbers come out as their text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema paths of an advisory record that hold lists.
ADVISORY_LISTS = frozenset({"affected", "affected[].ranges", "affected[].ranges[].events", "affected[].versions", "aliases", "severity"})
ADVISORY_LEAVES = ("affected[].versions[]", *(f"affected[].ranges[].events[].{k}" for k in ("introduced", "fixed", "last_affected")))
_FOREIGN = frozenset({"database_specific", "ecosystem_specific"})


class _Number(str):
    """A number as it was written."""


def _no_constant(name: str):
    raise ValueError(name)


def parse_json(text: str | None):
    """The value of a JSON text with numbers as text; ValueError if it is none."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """parse_json for any depth: open lists and objects lie on a stack of their own."""
    skip = lambda i: _BLANK.match(text, i).end()
    root: list = []
    stack, at, n = [(root, None)], skip(0), len(text)
    while True:
        holder, key = stack[-1]
        c = text[at : at + 1]
        opened = None
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c and c in "[{":
            value = opened = [] if c == "[" else {}
            at += 1
        elif word := next((w for w in _WORDS if text.startswith(w, at)), None):
            value, at = _WORDS[word], at + len(word)
        elif m := _NUMBER.match(text, at):
            value, at = _Number(m[0]), m.end()
        else:
            raise ValueError(f"no value at {at}")
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[key] = value
        if opened is not None:
            at = skip(at)
            if text[at : at + 1] != ("]" if isinstance(opened, list) else "}"):
                stack.append((opened, None))
                at = _key(text, stack, at, skip)
                continue
            at += 1
        while True:  # close what ends here
            at = skip(at)
            holder, _ = stack[-1]
            if len(stack) == 1:
                if at != n:
                    raise ValueError(f"more than one value at {at}")
                return root[0]
            c = text[at : at + 1]
            at += 1
            if c == ",":
                at = _key(text, stack, skip(at), skip)
                break
            if c != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"not closed at {at}")
            stack.pop()


def _key(text: str, stack: list, at: int, skip) -> int:
    """Reads the key of the next value if the innermost holder is an object; the place of the value."""
    holder, _ = stack[-1]
    if isinstance(holder, list):
        return at
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    stack[-1] = (holder, key)
    return skip(at + 1)


def _fields(node: dict) -> dict:
    out = {}
    for k, v in node.items():
        low = k.lower()
        if v is not None or low not in out:
            out[low] = v
    return out


def find_record(top, marks: tuple[str, ...] = ("id", "affected")) -> dict | None:
    """The shallowest object that has a key of marks, in document order; nothing inside it is searched."""
    level = [top]
    while level:
        below = []
        for node in level:
            if isinstance(node, dict):
                fields = _fields(node)
                if any(m in fields for m in marks):
                    return fields
                below += [v for k, v in fields.items() if k not in _FOREIGN and isinstance(v, (dict, list))]
            else:
                below += [v for v in node if isinstance(v, (dict, list))] if isinstance(node, list) else []
        level = below
    return None


def _decoded(value):
    """A text that holds a JSON list or object, decoded; else the value."""
    if type(value) is str and value.lstrip()[:1] in ("[", "{"):
        try:
            inner = parse_json(value)
        except ValueError:
            return value
        if isinstance(inner, (dict, list)):
            return inner
    return value


def dewey_nodes(record: dict, lists: frozenset[str], wanted: frozenset[str], prefixes: frozenset[str], parents: frozenset[str] = frozenset()) -> Iterator[tuple[str, list[int], str | None]]:
    """(schema path, Dewey label, text) of the scalar nodes at wanted paths, and of the objects at parents (text null); a label has an ordinal for each key and each element."""
    stack = [("", (), record)]
    while stack:
        path, label, node = stack.pop()
        if path in lists:
            node = _decoded(node)
            node = [] if node is None else node if isinstance(node, list) else [node]
        if isinstance(node, list):
            inner = f"{path}[]"
            if inner in prefixes:
                stack += [(inner, (*label, i), v) for i, v in enumerate(node) if v is not None]
            continue
        if path.endswith("[]") and path not in wanted:
            node = _decoded(node)
        if isinstance(node, dict):
            if path in parents:
                yield path, list(label), None
            for i, (k, v) in enumerate((node if node is record else _fields(node)).items()):
                inner = f"{path}.{k}" if path else k
                if v is not None and inner in prefixes:
                    stack.append((inner, (*label, i), v))
        elif path in wanted and node is not None:
            text = ("true" if node else "false") if isinstance(node, bool) else str(node)
            if text:
                # an escaped half of a surrogate pair is no character
                yield path, list(label), text if text.isascii() else text.encode("utf-8", "replace").decode()


def shred(rows: DataFrame, key: str, body: str, leaves: tuple[str, ...] = ADVISORY_LEAVES, lists: frozenset[str] = ADVISORY_LISTS, parents: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, dewey array<int>, text): the scalar nodes of each record at the given schema paths, and its objects at parents with a null text.

    Each path's rows are one flat table; `parent_label` and `element_ordinals` give the links.
    Only key and body are read; extra columns don't matter. Repeated keys give their rows again.
    """
    wanted, above = frozenset(leaves), frozenset(parents)
    prefixes = frozenset(p[:i] for p in (*leaves, *parents) for i in range(1, len(p) + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch[key], batch[body], strict=True):
                try:
                    record = find_record(parse_json(text))
                except ValueError:
                    continue
                if record is not None:
                    out += [(k, *x) for x in dewey_nodes(record, lists, wanted, prefixes, above)]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=[key, "path", "dewey", "text"])
                    out = []
            yield pd.DataFrame(out, columns=[key, "path", "dewey", "text"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, body).where(F.col(key).isNotNull() & F.col(body).isNotNull()).mapInPandas(run, f"`{key}` {kind}, path string, dewey array<int>, text string")


def parent_label(dewey: Column) -> Column:
    """The label of the parent: the label without its last ordinal; of a root null."""
    return F.when(F.size(dewey) > 1, F.slice(dewey, F.lit(1), F.size(dewey) - 1))


ADVISORY_PARENTS = ("affected[]", "affected[].ranges[]")


def advisory_parents(nodes: DataFrame, key: str) -> DataFrame:
    """(key, affected_no, range_no) of each affected entry (range_no null) and each range, with or without leaves.

    Labels read [affected key, affected_no] or [affected key, affected_no, ranges key, range_no].
    """
    at = lambda i: F.try_element_at("dewey", F.lit(i))
    return nodes.where(F.col("path").isin(*ADVISORY_PARENTS)).select(key, at(2).alias("affected_no"), at(4).alias("range_no"))


def advisory_leaves(nodes: DataFrame, key: str) -> DataFrame:
    """(key, affected_no, leaf_kind, range_no, leaf_no, leaf) from shredded advisory records.

    Labels read [affected key, affected_no, ranges key, range_no, events key, leaf_no, leaf key] or
    [affected key, affected_no, versions key, leaf_no].
    """
    version = F.col("path") == "affected[].versions[]"
    at = lambda i: F.try_element_at("dewey", F.lit(i))
    return nodes.select(
        key,
        at(2).alias("affected_no"),
        F.when(version, "version").otherwise(F.element_at(F.split("path", r"\."), -1)).alias("leaf_kind"),
        F.when(version, F.lit(-1)).otherwise(at(4)).cast("int").alias("range_no"),
        F.when(version, at(4)).otherwise(at(6)).alias("leaf_no"),
        F.col("text").alias("leaf"),
    )
