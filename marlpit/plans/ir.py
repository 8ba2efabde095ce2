"""Queries as typed JSON: a small tree of nodes lowered to the DataFrame API, without SQL text."""

from __future__ import annotations

import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINARY = {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "div": F.try_divide, "mod": operator.mod,
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge,
    "and": operator.and_, "or": operator.or_, "is": lambda a, b: a.eqNullSafe(b), "concat": F.concat,
}
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.countDistinct, "median": F.median}
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def expression(x: Mapping) -> Column:
    """{"col": name}, {"lit": value}, {"op": ..., "args": [...]}, {"agg": ..., "arg": ..., "filter": ...}, {"fn": ..., "args": [...]},
    {"case": [[when, then], ...], "else": ...}, {"in": [arg, [values]]}, {"between": [arg, low, high]}, {"is_null": arg},
    {"not": arg}, {"cast": [arg, type]}."""
    if "col" in x:
        return F.col(x["col"])
    if "lit" in x:
        return F.lit(x["lit"])
    if "op" in x:
        first, *rest = map(expression, x["args"])
        for r in rest:
            first = BINARY[x["op"]](first, r)
        return first
    if "agg" in x:
        arg = expression(x["arg"]) if "arg" in x else F.lit(1)
        if "filter" in x:
            arg = F.when(expression(x["filter"]), arg)
        return AGGREGATES[x["agg"]](arg)
    if "fn" in x:
        return F.call_function(x["fn"], *map(expression, x.get("args", [])))
    if "case" in x:
        out = F
        for when, then in x["case"]:
            out = out.when(expression(when), expression(then))
        return out.otherwise(expression(x["else"])) if "else" in x else out
    if "in" in x:
        return expression(x["in"][0]).isin(*x["in"][1])
    if "between" in x:
        return expression(x["between"][0]).between(*map(expression, x["between"][1:]))
    if "is_null" in x:
        return expression(x["is_null"]).isNull()
    if "not" in x:
        return ~expression(x["not"])
    if "cast" in x:
        return expression(x["cast"][0]).try_cast(x["cast"][1])
    raise ValueError(f"unknown expression: {sorted(x)}")


def query(x: Mapping, tables: Mapping[str, DataFrame]) -> DataFrame:
    """{"from": table or query, "joins": [{"table", "kind", "on"}], "where", "group_by", "select": {name: expression},
    "having", "distinct", "union_all": [queries], "order_by": [[name, "asc" or "desc"]], "limit", "offset"}."""
    source = x["from"]
    df = tables[source] if isinstance(source, str) else query(source, tables)
    for j in x.get("joins", ()):
        other = tables[j["table"]] if isinstance(j["table"], str) else query(j["table"], tables)
        kind = j.get("kind", "inner")
        df = df.crossJoin(other) if kind == "cross" else df.join(other, expression(j["on"]), JOINS[kind])
    if "where" in x:
        df = df.where(expression(x["where"]))
    if "group_by" in x or any("agg" in e for e in x.get("select", {}).values()):
        keys = x.get("group_by", {})
        df = df.groupBy(*(expression(e).alias(k) for k, e in keys.items())).agg(*(expression(e).alias(k) for k, e in x["select"].items()))
        if "having" in x:
            df = df.where(expression(x["having"]))
    elif "select" in x:
        df = df.select(*(expression(e).alias(k) for k, e in x["select"].items()))
    if x.get("distinct"):
        df = df.distinct()
    for other in x.get("union_all", ()):
        df = df.unionAll(query(other, tables))
    if "order_by" in x:
        df = df.orderBy(*(F.col(k).asc() if way == "asc" else F.col(k).desc() for k, way in x["order_by"]))
    if "offset" in x:
        df = df.offset(x["offset"])
    return df.limit(x["limit"]) if "limit" in x else df
