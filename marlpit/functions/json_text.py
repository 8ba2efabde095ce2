"""JSON functions on text: Spark's own where they exist, Arrow-batched Python only to change documents."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract(doc: Column, path: str) -> Column:
    """json_extract() and ->>: a scalar unwrapped, an object or array as JSON text. [#-n] counts from the end."""
    if found := re.fullmatch(r"(.*)\[#-(\d+)\]", path):
        items = F.from_json(F.get_json_object(doc, found[1]), "array<string>")
        return F.get(items, F.size(items) - int(found[2]))
    return F.get_json_object(doc, path)


def extract_json(doc: Column, path: str) -> Column:
    """->: the value as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), path, "variant"))


def extract_all(doc: Column, *paths: str) -> Column:
    """json_extract() with several paths: a JSON array."""
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(extract_json(doc, p), F.lit("null")) for p in paths)), F.lit("]"))


def minify(doc: Column) -> Column:
    return F.to_json(F.try_parse_json(doc))


def valid(doc: Column) -> Column:
    """json_valid(). Within brackets, for the parser stops after a first value and ignores what follows."""
    wrapped = F.concat(F.lit("["), doc, F.lit("]"))
    return F.when(doc.isNotNull(), F.try_parse_json(wrapped).isNotNull() & F.coalesce(F.json_array_length(wrapped) == 1, F.lit(False)))


def kind(doc: Column, path: str = "$") -> Column:
    """json_type(): object, array, text, integer, real, true, false or null."""
    value = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    name, text = F.schema_of_variant(value), F.to_json(value)
    return (
        F.when(value.isNull(), None)
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "text")
        .when(name == "BOOLEAN", text)
        .when(name == "VOID", "null")
        .when(name == "BIGINT", "integer")
        .otherwise("real")
    )


def array_length(doc: Column) -> Column:
    """json_array_length(): 0 for what is no array."""
    return F.when(doc.isNotNull(), F.coalesce(F.json_array_length(doc), F.lit(0)))


def quote(x: Column) -> Column:
    """json_quote(): one value as JSON."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def array(*xs: Column) -> Column:
    """json_array() of values of any types."""
    return F.concat(F.lit("["), F.concat_ws(",", *(quote(x) for x in xs)), F.lit("]"))


def object_(**xs: Column) -> Column:
    """json_object(), members in the order given."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(k) + ":"), quote(x)) for k, x in xs.items())), F.lit("}"))


def keys(doc: Column) -> Column:
    return F.json_object_keys(doc)


def has_key(doc: Column, key: str) -> Column:
    """?"""
    return F.coalesce(F.array_contains(keys(doc), key), F.lit(False))


def has_any(doc: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(keys(doc), F.array(*map(F.lit, names))), F.lit(False))


def has_all(doc: Column, *names: str) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), keys(doc))) == 0, F.lit(False))


# --- changes of a document: no expression of Spark's makes them ---


def _steps(path: str) -> list[str | int]:
    out: list[str | int] = []
    for name, quoted, at in re.findall(r'\.([^.\["]+)|\."([^"]*)"|\[(#(?:-\d+)?|\d+)\]', path):
        out.append(at if at.startswith("#") else int(at) if at else name or quoted)
    return out


def _at(holder, step):
    if isinstance(step, str) and step.startswith("#") and isinstance(holder, list):
        return len(holder) + int(step[1:] or 0)
    return step


def _put(doc, path: str, value, create: bool, overwrite: bool):
    steps, at = _steps(path), doc
    if not steps:
        return value if overwrite else doc
    for k, step in enumerate(steps):
        step, last = _at(at, step), k == len(steps) - 1
        if isinstance(at, dict) and isinstance(step, str):
            there = step in at
        elif isinstance(at, list) and isinstance(step, int):
            there = 0 <= step < len(at)
            if not there and step != len(at):
                return doc
        else:
            return doc
        if last:
            if there and overwrite:
                at[step] = value
            elif not there and create:
                at.append(value) if isinstance(at, list) else at.__setitem__(step, value)
        elif there:
            at = at[step]
        elif create:
            new = {} if isinstance(steps[k + 1], str) and not str(steps[k + 1]).startswith("#") else []
            at.append(new) if isinstance(at, list) else at.__setitem__(step, new)
            at = new
        else:
            return doc
    return doc


def _drop(doc, path: str):
    steps, at = _steps(path), doc
    for step in steps[:-1]:
        try:
            at = at[_at(at, step)]
        except (KeyError, IndexError, TypeError):
            return doc
    try:
        del at[_at(at, steps[-1])]
    except (KeyError, IndexError, TypeError):
        pass
    return doc


def _merge(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


def _strip(x):
    if isinstance(x, dict):
        return {k: _strip(v) for k, v in x.items() if v is not None}
    return [_strip(v) for v in x] if isinstance(x, list) else x


def _contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_contains(x, y) for x in a) for y in b) if isinstance(b, list) else b in a
    return type(a) is type(b) and a == b or {type(a), type(b)} == {int, float} and a == b


def _text(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _changed(doc: Column, change: Callable, *others: Column, returns: str = "string") -> Column:
    # batch to batch, not iterators: all changes of a projection share a worker, while each iterator has its own in every task
    def run(*cols: pd.Series) -> pd.Series:
        out = []
        for first, *rest in zip(*cols):
            try:
                out.append(None if first is None else change(json.loads(first), *rest))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    columns = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[1 + len(others)]  # a named argument a column
    columns.__annotations__ = dict.fromkeys("ab"[: 1 + len(others)], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(columns, returns)(doc, *others)


def set_(doc: Column, path: str, value: Column) -> Column:
    """json_set(): value is JSON text. Invalid documents give null."""
    return _changed(doc, lambda d, v: _text(_put(d, path, json.loads(v), True, True)), value)


def insert(doc: Column, path: str, value: Column) -> Column:
    return _changed(doc, lambda d, v: _text(_put(d, path, json.loads(v), True, False)), value)


def replace(doc: Column, path: str, value: Column) -> Column:
    return _changed(doc, lambda d, v: _text(_put(d, path, json.loads(v), False, True)), value)


def remove(doc: Column, *paths: str) -> Column:
    def run(d):
        for p in paths:
            d = _drop(d, p)
        return _text(d)

    return _changed(doc, run)


def patch(doc: Column, other: Column) -> Column:
    """json_patch(): RFC 7396 merge."""
    return _changed(doc, lambda d, o: _text(_merge(d, json.loads(o))), other)


def strip_nulls(doc: Column) -> Column:
    return _changed(doc, lambda d: _text(_strip(d)))


def pretty(doc: Column) -> Column:
    return _changed(doc, lambda d: json.dumps(d, indent=4, ensure_ascii=False))


def contains(doc: Column, other: Column) -> Column:
    """@>"""
    return _changed(doc, lambda d, o: _contains(d, json.loads(o)), other, returns="boolean")


# --- table-valued functions ---


def each(df: DataFrame, doc: str) -> DataFrame:
    """json_each(): df's rows for each member of the document, with key and value (JSON text)."""
    members = F.from_json(F.col(doc), "map<string,string>")
    return df.select("*", F.explode(members).alias("key", "value"))


def object_keys(df: DataFrame, doc: str) -> DataFrame:
    """jsonb_object_keys()."""
    return df.select("*", F.explode(F.json_object_keys(F.col(doc))).alias("key"))


def to_record(df: DataFrame, doc: str, schema: str) -> DataFrame:
    """jsonb_to_record(): a column for each field of the schema."""
    fields = F.from_json(F.col(doc), schema)
    return df.select(*df.columns, fields.alias("__mp_r")).select(*df.columns, "__mp_r.*")


def path_query(df: DataFrame, doc: str, path: str) -> DataFrame:
    """jsonb_path_query(): a row for each match; [*] takes every element."""
    head, star, rest = path.partition("[*]")
    found = F.from_json(F.get_json_object(F.col(doc), head), "array<string>") if star else F.array(extract_json(F.col(doc), head))
    rows = df.select("*", F.explode(found).alias("value"))
    if rest:
        rows = rows.withColumn("value", F.get_json_object("value", "$" + rest))
    return rows.where(F.col("value").isNotNull())


def path_exists(doc: Column, path: str) -> Column:
    """@?"""
    return F.coalesce(F.is_variant_null(F.try_variant_get(F.try_parse_json(doc), path, "variant")).isNotNull() & F.try_variant_get(F.try_parse_json(doc), path, "variant").isNotNull(), F.lit(False))


def array_elements(df: DataFrame, doc: str) -> DataFrame:
    """jsonb_array_elements_text()."""
    return df.select("*", F.explode(F.from_json(F.col(doc), "array<string>")).alias("value"))


def tree(df: DataFrame, doc: str, id_col: str) -> DataFrame:
    """json_tree(): (id, fullkey, key, type, atom) of every node of each document."""

    def walk(x, path, key):
        name = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "null" if x is None else str(x).lower() if isinstance(x, bool) else "integer" if isinstance(x, int) else "real" if isinstance(x, float) else "text"
        yield path, key, name, None if isinstance(x, (dict, list)) else _text(x)
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            yield from walk(v, f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]", str(k))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *node) for i, text in zip(part[id_col], part[doc]) if text is not None for node in walk(json.loads(text), "$", None)]
            yield pd.DataFrame(rows, columns=[id_col, "fullkey", "key", "type", "atom"])

    kind_ = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, doc).mapInPandas(run, f"{id_col} {kind_}, fullkey string, key string, type string, atom string")
