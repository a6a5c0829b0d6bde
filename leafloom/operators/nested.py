"""Deeply nested semi-structured records into flat related tables (problem 5).

One depth-first pass over each record emits tagged rows: table tag, primary key, parent key and a payload, which is the
columns of all tables, empty where a tag has none of them. The tagged rows are then written partitioned by tag, and
each tag is read from its own folder with its own schema.

Defined results
* null, blank or incomplete JSON: no rows for that record.
* the same record twice: the same rows twice; callers that need a set use distinct().
* a null record key is kept as null; an empty table gives an empty table.
* a lone object stands for a list of one; text that holds a list (or an object) stands for what it holds;
  entries that are no objects only take up a position; a list in any other shape has no entries.
* nesting of any depth: the visitor keeps its own stack, and the parser falls back to one that does too.
* other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.session import materialize

GROUP, OPERATION, ATTRIBUTE = "group", "operation", "attribute"
TAGS = (GROUP, OPERATION, ATTRIBUTE)
LISTS = ("children", "operation_groups")
ROOT = "group_tree"

_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}
_BLANK = " \t\n\r"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _parse_deep(text: str):
    """A JSON parser with its own stack, for records nested too deep for the recursive one."""
    done: list = []
    stack: list[tuple[object, object]] = [(done, None)]
    expect, at, end = "value", 0, len(text)

    def put(value: object) -> None:
        holder, key = stack[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)

    while True:
        while at < end and text[at] in _BLANK:
            at += 1
        if at == end:
            break
        c = text[at]
        if expect in ("value", "value or ]"):
            if c in "{[":
                value: object = {} if c == "{" else []
                put(value)
                stack.append((value, None))
                expect, at = ("key or }" if c == "{" else "value or ]"), at + 1
                continue
            if c == "]" and expect == "value or ]":
                stack.pop()
                expect, at = "next", at + 1
                continue
            if m := _STRING.match(text, at):
                put(json.loads(m.group()))
                at = m.end()
            elif m := _NUMBER.match(text, at):
                put(json.loads(m.group()))
                at = m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError("no JSON value")
                put(_WORDS[word])
                at += len(word)
            expect = "next"
        elif expect in ("key", "key or }"):
            if c == "}" and expect == "key or }":
                stack.pop()
                expect, at = "next", at + 1
                continue
            m = _STRING.match(text, at)
            if not m:
                raise ValueError("no key")
            at = m.end()
            while at < end and text[at] in _BLANK:
                at += 1
            if at == end or text[at] != ":":
                raise ValueError("no colon")
            stack[-1] = (stack[-1][0], json.loads(m.group()))
            expect, at = "value", at + 1
        else:
            if len(stack) == 1:
                raise ValueError("text after the end")
            holder = stack[-1][0]
            if c == ",":
                expect, at = ("key" if isinstance(holder, dict) else "value"), at + 1
            elif c == ("}" if isinstance(holder, dict) else "]"):
                stack.pop()
                at += 1
            else:
                raise ValueError("no separator")
    if len(stack) != 1 or expect != "next":
        raise ValueError("incomplete")
    return done[0]


def parse(text: str):
    """The value of complete JSON text; ValueError otherwise."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


def _entries(value: object) -> list:
    """The list that a value stands for."""
    while isinstance(value, str):
        head = value.lstrip(_BLANK)[:1]
        if head not in ("[", "{", '"') or not head:
            return []
        try:
            value = parse(value)
        except ValueError:
            return []
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def as_text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _number(value: object) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


PAYLOAD = "type string, role string, x double, y double, w double, h double, value string"
_NOTHING = (None, None, None, None, None, None)


def visit(tree: str) -> Iterator[tuple]:
    """(tag, key, parent key, id, position, *payload) of one record, depth first, in the order as stored."""
    try:
        value = parse(tree)
    except ValueError:
        return
    todo = [(f"{ROOT}[{i}]", "", i, e) for i, e in enumerate(_entries(value)) if isinstance(e, dict)][::-1]
    while todo:
        path, parent, position, group = todo.pop()
        box, kind, role = group.get("bbox"), group.get("type"), group.get("role")
        box = box if isinstance(box, dict) else {}
        yield GROUP, path, parent, as_text(group.get("id")), position, kind if isinstance(kind, str) else None, role if isinstance(role, str) else None, *[_number(box.get(k)) for k in "xywh"], None
        ordinals = group.get("operation_ordinals")
        for i, x in enumerate(ordinals if isinstance(ordinals, list) else []):
            if isinstance(x, int) and not isinstance(x, bool):
                yield OPERATION, f"{path}.operation_ordinals[{i}]", path, "", i, *_NOTHING, str(x)
        if isinstance(group.get("attributes"), dict):
            for i, (k, v) in enumerate(group["attributes"].items()):
                yield ATTRIBUTE, f"{path}.attributes.{k}", path, k, i, *_NOTHING, as_text(v)
        below = [(f"{path}.{name}[{i}]", path, i, e) for name in LISTS for i, e in enumerate(_entries(group.get(name))) if isinstance(e, dict)]
        todo += below[::-1]


def flatten(df: DataFrame, key: Column, tree: Column) -> DataFrame:
    """One tagged row for each group, operation reference and attribute of every record."""
    source = df.select(key.alias("rec_key"), tree.alias("tree")).where("tree is not null")
    kind = source.schema["rec_key"].dataType.simpleString()
    schema = f"rec_key {kind}, tag string, row_path string, parent_path string, row_id string, position bigint, {PAYLOAD}"
    names = [x.split()[0] for x in schema.split(", ")]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for rec, text in zip(batch["rec_key"], batch["tree"]):
                for row in visit(text):
                    rows.append((rec, *row))
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(emit, schema)


def tables(df: DataFrame, key: Column, tree: Column) -> dict[str, DataFrame]:
    """The related tables: the tagged rows are written once, by tag, and each tag read with its schema."""
    tagged = materialize(flatten(df, key, tree), "nested", by="tag")

    def of(tag: str) -> DataFrame:
        return tagged.where(F.col("tag") == tag)

    return {
        GROUP: of(GROUP).select("rec_key", "row_path", "parent_path", "row_id", "position", "type", "role", "x", "y", "w", "h"),
        OPERATION: of(OPERATION).select("rec_key", "row_path", "parent_path", "position", F.expr("try_cast(value as bigint)").alias("ordinal")),
        ATTRIBUTE: of(ATTRIBUTE).select("rec_key", "row_path", "parent_path", F.col("row_id").alias("name"), "value"),
    }


def groups(df: DataFrame, key: Column, tree: Column) -> DataFrame:
    """The table of groups, keys only."""
    return tables(df, key, tree)[GROUP].select(F.col("rec_key").alias("rec_id"), F.col("row_path").alias("group_path"), "parent_path", F.col("row_id").alias("group_id"))
