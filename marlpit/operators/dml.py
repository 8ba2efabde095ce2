"""Row changes as new table versions: each function takes DataFrames and returns the next version."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.session import ConstraintError, cut_lineage


def aligned(rows: DataFrame, like: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """rows with the columns and types of like; missing ones get their default or null."""
    defaults = defaults or {}
    return rows.select(*((F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).try_cast(f.dataType).alias(f.name) for f in like.schema))


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    return table.unionByName(aligned(rows, table, defaults))


def with_row_ids(table: DataFrame, rows: DataFrame, column: str, order: Sequence[Column], parts: int = 64) -> DataFrame:
    """rows with ids that go on, without gaps, from the table's greatest: partition totals give every partition its start."""
    base = table.agg(F.coalesce(F.max(column), F.lit(0)).alias("__mp_top"))  # one row
    # the partition a row falls in is written down: totals and ranks must see the same ones
    dealt = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("__mp_p", F.spark_partition_id()))
    starts = dealt.groupBy("__mp_p").count().select("__mp_p", (F.sum("count").over(Window.orderBy("__mp_p")) - F.col("count")).alias("__mp_s"))  # a row per partition
    ranked = dealt.withColumn("__mp_n", F.row_number().over(Window.partitionBy("__mp_p").orderBy(*order)))
    found = ranked.join(F.broadcast(starts), "__mp_p").crossJoin(F.broadcast(base))
    return found.withColumn(column, F.col("__mp_top") + F.col("__mp_s") + F.col("__mp_n")).drop("__mp_p", "__mp_n", "__mp_s", "__mp_top")


def _whole(key: Sequence[str]) -> Column:
    """Whether no part of the key is null: nulls never conflict."""
    found = F.lit(True)
    for k in key:
        found = found & F.col(k).isNotNull()
    return found


def _one_per_key(rows: DataFrame, key: Sequence[str], pick: Callable[[Column], Column]) -> DataFrame:
    """Of rows with one key that `pick` chooses; rows whose key has a null all stay."""
    own = F.struct(*(F.col(c) for c in rows.columns))
    folded = rows.where(_whole(key)).groupBy(*(F.col(k).alias(f"__mp_{k}") for k in key)).agg(pick(own).alias("__mp_r")).select("__mp_r.*")
    return folded.unionByName(rows.where(~_whole(key)))


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str], first: Column) -> DataFrame:
    """New keys only; of several rows with a new key, that with the smallest `first`."""
    rows = _one_per_key(rows, key, lambda own: F.min_by(own, first))
    return table.unionByName(aligned(rows.join(table.select(*key), list(key), "left_anti"), table))


def insert_or_replace(table: DataFrame, rows: DataFrame, key: Sequence[str], last: Column) -> DataFrame:
    """Rows take the place of those with their key; of several rows with a key, that with the greatest `last`."""
    rows = aligned(_one_per_key(rows, key, lambda own: F.max_by(own, last)), table)
    return table.join(rows.select(*key), list(key), "left_anti").select(*table.columns).unionByName(rows)


def insert_or_abort(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    clash = rows.join(table.select(*key), list(key), "left_semi").limit(1).unionByName(rows.where(_whole(key)).groupBy(*key).count().where("count > 1").join(rows, list(key)).select(*rows.columns).limit(1))
    if not clash.isEmpty():
        raise ConstraintError(f"{', '.join(key)} is not unique")
    return insert(table, rows)


@dataclass
class When:
    """A clause of merge(): `action` is update, delete or insert; values are SQL over t (table) and s (source)."""

    matched: bool
    action: str
    values: dict[str, str] | None = None
    condition: str = "true"


def merge(table: DataFrame, source: DataFrame, on: Sequence[str], clauses: Sequence[When]) -> DataFrame:
    """MERGE: the first clause whose condition holds decides a row; a table row matched twice is an error."""
    t, s = table.withColumn("__mp_t", F.lit(True)).alias("t"), source.withColumn("__mp_s", F.lit(True)).alias("s")
    if not source.groupBy(*on).count().where("count > 1").join(table, list(on), "left_semi").isEmpty():
        raise ConstraintError("a row is matched more than once")
    pairs = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "full")
    both, new = F.col("__mp_t") & F.col("__mp_s"), F.col("__mp_t").isNull()
    action = F.when(F.lit(False), -1)
    for i, c in enumerate(clauses):
        action = action.when((both if c.matched else new) & F.expr(c.condition), i)
    pairs = pairs.withColumn("__mp_a", action)
    gone = [i for i, c in enumerate(clauses) if c.action == "delete"]
    kept = pairs.where((F.col("__mp_t") | F.col("__mp_a").isNotNull()) & ~F.coalesce(F.col("__mp_a").isin(gone), F.lit(False)))
    out = []
    for f in table.schema:
        value = F.col(f"t.{f.name}")
        cases = F
        for i, c in enumerate(clauses):
            if c.action == "delete":
                continue
            given = (c.values or {}).get(f.name)
            if given is not None or c.action == "insert":
                cases = cases.when(F.col("__mp_a") == i, F.expr(given).cast(f.dataType) if given is not None else F.lit(None).cast(f.dataType))
        out.append((value if cases is F else cases.otherwise(value)).alias(f.name))
    return kept.select(*out)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], update: dict[str, str] | None, order: Column, where: str = "true") -> DataFrame:
    """INSERT ... ON CONFLICT(key) DO UPDATE SET update WHERE where (s is the row proposed), or DO NOTHING where update is None.

    Of several proposed rows with one key, the first by `order` is inserted where the key is new, and the last updates.
    """
    own = F.struct(*(F.col(c) for c in rows.columns))
    folded = rows.where(_whole(key)).groupBy(*(F.col(k).alias(f"__mp_{k}") for k in key))
    folded = folded.agg(F.min_by(own, order).alias("first"), F.max_by(own, order).alias("last"), F.count("*").alias("n"))
    known = table.where(_whole(key)).select(*(F.col(k).alias(f"__mp_{k}") for k in key), F.lit(True).alias("known"))
    folded = folded.join(known, [f"__mp_{k}" for k in key], "left")
    grown = insert(insert(table, folded.where("known is null").select("first.*")), rows.where(~_whole(key)))
    if update is None:
        return grown
    return merge(grown, aligned(folded.where("known or n > 1").select("last.*"), table), key, [When(True, "update", update, where)])


def upsert_arms(table: DataFrame, rows: DataFrame, arms: Sequence[tuple[Sequence[str], dict[str, str] | None]], order: Column) -> DataFrame:
    """INSERT with several ON CONFLICT arms (key, update or None): the first arm whose key a proposed row meets in the table decides it.

    Rows are taken as proposed at once: of those new under every key, the first by `order` of each key stays.
    """
    rest, out = rows, table
    for key, values in arms:
        hit = rest.join(table.select(*key), list(key), "left_semi").select(*rows.columns)
        rest = rest.join(table.select(*key), list(key), "left_anti").select(*rows.columns)
        if values is not None:
            hit = aligned(_one_per_key(hit, key, lambda own: F.max_by(own, order)), table)
            out = merge(out, hit, key, [When(True, "update", values)])
    for key, _ in arms:
        rest = _one_per_key(rest, key, lambda own: F.min_by(own, order))
    return insert(out, rest)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*(F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema))


def returning(table: DataFrame, where: Column, values: dict[str, Column], columns: Sequence[Column]) -> DataFrame:
    """RETURNING of an UPDATE: projections of the rows it changes, after the change."""
    return update(table.where(where), F.lit(True), values).select(*columns)


def update_limited(table: DataFrame, where: Column, values: dict[str, Column], order: Sequence[Column], n: int, key: Sequence[str]) -> DataFrame:
    """UPDATE ... ORDER BY ... LIMIT n: the first n rows under an order are changed."""
    hit = limited(table, where, order, n, key).withColumn("__mp_hit", F.lit(True))
    joined = table.join(F.broadcast(hit), list(key), "left")  # n rows
    return update(joined, F.col("__mp_hit"), values).select(*table.columns)


def restricted(child: DataFrame, column: str, gone: DataFrame, parent_column: str) -> DataFrame:
    """ON DELETE RESTRICT: the child rows that forbid the deletion."""
    return child.join(gone.select(F.col(parent_column).alias(column)), column, "left_semi").select(*child.columns)


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def limited(table: DataFrame, where: Column, order: Sequence[Column], n: int, key: Sequence[str]) -> DataFrame:
    """Keys of the first n rows of an ordered, limited UPDATE or DELETE."""
    return table.where(where).orderBy(*order).limit(n).select(*key)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose reference has no parent."""
    parents = parent.select(F.col(parent_column).alias(column))
    return child.where(F.col(column).isNotNull()).join(parents, column, "left_anti")


def cascade_delete(child: DataFrame, column: str, gone: DataFrame, parent_column: str) -> DataFrame:
    """ON DELETE CASCADE: child rows whose parents are not among the deleted."""
    return child.join(gone.select(F.col(parent_column).alias(column)), column, "left_anti").select(*child.columns)


def cascade_set(child: DataFrame, column: str, gone: DataFrame, parent_column: str, value: Column) -> DataFrame:
    """ON DELETE SET DEFAULT, or SET NULL: references to deleted parents get a value."""
    lost = gone.select(F.col(parent_column).alias("__mp_k")).distinct().withColumn("__mp_g", F.lit(True))
    joined = child.join(lost, F.col(column) == F.col("__mp_k"), "left")
    return joined.withColumn(column, F.when(F.col("__mp_g").isNull(), F.col(column)).otherwise(value)).select(*child.columns)


def cascade_set_null(child: DataFrame, column: str, gone: DataFrame, parent_column: str) -> DataFrame:
    return cascade_set(child, column, gone, parent_column, F.lit(None).cast(child.schema[column].dataType))
