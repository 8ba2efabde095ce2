"""Binary-JSON functions: paths as lists of steps, texts with a space after commas and colons.

Spark has no expression that changes a document, so these run on Arrow batches. A null or invalid document gives null;
keys keep their order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlpit.functions.json_text import _changed, _strip


def _text(x) -> str:
    return json.dumps(x, ensure_ascii=False)


def _place(at, step: str) -> str | int | None:
    """The key or index that a step names in a container, None where it can't name one. Negative indexes count from the end."""
    if isinstance(at, dict):
        return step
    if isinstance(at, list) and step.lstrip("-").isdigit():
        return int(step) + (len(at) if step.startswith("-") else 0)
    return None


def _there(at, k: str | int | None) -> bool:
    return k in at if isinstance(at, dict) else isinstance(k, int) and 0 <= k < len(at)


def _holder(doc, path: tuple[str, ...]):
    """The container of the path's last step, with that step's place; None where a step before it leads nowhere."""
    for step in path[:-1]:
        k = _place(doc, step)
        if k is None or not _there(doc, k):
            return None, None
        doc = doc[k]
    return doc, _place(doc, path[-1])


def text(doc: Column) -> Column:
    """The document as binary JSON prints it."""
    return _changed(doc, _text)


def pretty(doc: Column) -> Column:
    return _changed(doc, lambda d: json.dumps(d, indent=4, ensure_ascii=False))


def strip_nulls(doc: Column) -> Column:
    """Members that are null are left out, at any depth; null elements of arrays stay."""
    return _changed(doc, lambda d: _text(_strip(d)))


def set_(doc: Column, path: tuple[str, ...], value: Column, create: bool = True) -> Column:
    """The value at path replaced, or added where create is true and only the last step is missing."""

    def run(d, v):
        at, k = _holder(d, path)
        if k is not None and _there(at, k):
            at[k] = json.loads(v)
        elif k is not None and create:
            if isinstance(at, dict):
                at[k] = json.loads(v)
            else:
                at.insert(0 if k < 0 else len(at), json.loads(v))
        return _text(d)

    return _changed(doc, run, value)


def insert(doc: Column, path: tuple[str, ...], value: Column, after: bool = False) -> Column:
    """The value as a new member, or before (after) the array element at path; members that are there stay."""

    def run(d, v):
        at, k = _holder(d, path)
        if isinstance(at, dict):
            at.setdefault(k, json.loads(v))
        elif k is not None:
            at.insert(max(0, k + after), json.loads(v))
        return _text(d)

    return _changed(doc, run, value)


def delete(doc: Column, *keys: str | int) -> Column:
    """`-`: an object's member by key, array elements equal to a text, or the element at an index."""

    def run(d):
        for k in keys:
            if isinstance(d, list) and isinstance(k, int):
                if -len(d) <= k < len(d):
                    del d[k]
            elif isinstance(d, list):
                d = [x for x in d if x != k]
            elif isinstance(d, dict):
                d.pop(k, None)
        return _text(d)

    return _changed(doc, run)


def delete_path(doc: Column, path: tuple[str, ...]) -> Column:
    """`#-`"""

    def run(d):
        at, k = _holder(d, path)
        if k is not None and _there(at, k):
            del at[k]
        return _text(d)

    return _changed(doc, run)


def concat(a: Column, b: Column) -> Column:
    """`||`: members of two objects, the right one's winning; otherwise an array, values beside arrays being elements."""

    def run(x, other):
        if other is None:
            return None
        y = json.loads(other)
        if isinstance(x, dict) and isinstance(y, dict):
            return _text(x | y)
        return _text((x if isinstance(x, list) else [x]) + (y if isinstance(y, list) else [y]))

    return _changed(a, run, b)


def at_path(doc: Column, *path: str | int) -> Column:
    """`#>`: the value at the path as JSON text (this stays in the JVM)."""
    steps = "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path)
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), f"${steps}", "variant"))


def text_at_path(doc: Column, *path: str | int) -> Column:
    """`#>>`: the value at the path, a text without its quotes."""
    steps = "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path)
    return F.get_json_object(doc, f"${steps}")
