"""A session over named tables: immutable DataFrame versions, SQL over them, transactions by snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the semantics of typed SQL text depend on: wrapping arithmetic, NULL on division by zero, UTC.
CONF = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local folder only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "/tmp/checkpoints/marlpit").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a version that no longer depends on how it came about."""
    path = f"{shared_folder(df.sparkSession)}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class TableMeta:
    """Declared properties of a table; indexes are a matter of record only."""

    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)  # column, table, its column
    indexes: dict[str, list[str]] = field(default_factory=dict)


class ConstraintError(ValueError):
    """Rows break a declared constraint."""


class Session:
    """Named tables and views, with SQL over them. Statements replace a table's version; nothing is changed in place."""

    def __init__(self, spark: SparkSession, configure: bool = True):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.meta: dict[str, TableMeta] = {}
        self.views: dict[str, str] = {}
        self.sequences: dict[str, int] = {}
        self.hooks: list[Callable[[str, str], None]] = []
        self._saved: list[tuple[str, dict, dict, dict]] = []
        self.epoch = 0
        if configure:
            for k, v in CONF.items():
                spark.conf.set(k, v)

    # --- tables ---

    def create(self, name: str, df: DataFrame, meta: TableMeta | None = None, replace: bool = False) -> None:
        if name in self.tables and not replace:
            raise ValueError(f"table {name} already exists")
        meta = meta or TableMeta()
        for column, expression in meta.generated.items():
            df = df.withColumn(column, F.expr(expression))
        self.meta[name] = meta
        self.check(name, df)
        self.put(name, df, "create")

    def drop(self, name: str, missing_ok: bool = False) -> None:
        if name not in self.tables and not missing_ok:
            raise KeyError(name)
        self.tables.pop(name, None)
        self.meta.pop(name, None)
        self.epoch += 1

    def rename(self, name: str, new: str) -> None:
        self.tables[new], self.meta[new] = self.tables.pop(name), self.meta.pop(name)
        self.epoch += 1

    def rename_column(self, name: str, column: str, new: str) -> None:
        self.put(name, self.tables[name].withColumnRenamed(column, new), "alter")

    def add_column(self, name: str, column: str, kind: str, default: str = "null") -> None:
        self.put(name, self.tables[name].withColumn(column, F.expr(default).cast(kind)), "alter")

    def drop_column(self, name: str, column: str) -> None:
        self.put(name, self.tables[name].drop(column), "alter")

    def put(self, name: str, df: DataFrame, what: str) -> None:
        """The table's next version."""
        self.tables[name] = df
        self.epoch += 1
        for hook in self.hooks:
            hook(what, name)

    def attach(self, schema: str, folder: str, names: list[str]) -> None:
        """Parquet tables of a folder as schema.table."""
        for n in names:
            self.tables[f"{schema}.{n}"] = self.spark.read.parquet(f"{folder}/{n}.parquet")
            self.meta[f"{schema}.{n}"] = TableMeta()

    def sql(self, text: str, params: dict | list | None = None) -> DataFrame:
        """A query over the session's tables: {name} stands for a table's present version, :name and ? for parameters."""
        named = {k: v for k, v in self.tables.items() if f"{{{k}}}" in text}
        return self.spark.sql(text, args=params, **named)

    def create_view(self, name: str, text: str) -> None:
        """A view: its query is planned anew, over the tables' versions of that moment, whenever it is read."""
        self.views[name] = text

    def view(self, name: str) -> DataFrame:
        return self.sql(self.views[name])

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False) -> None:
        """Indexes are recorded; a unique one is a constraint from now on."""
        meta = self.meta[table]
        meta.indexes[name] = columns
        if unique:
            meta.unique.append(columns)
            try:
                self.check(table, self.tables[table])
            except ConstraintError:
                meta.unique.pop()
                del meta.indexes[name]
                raise

    def index_list(self, table: str) -> DataFrame:
        """(seq, name, unique, columns)."""
        meta = self.meta[table]
        rows = [(i, n, int(c in meta.unique), ", ".join(c)) for i, (n, c) in enumerate(meta.indexes.items())]
        return self.spark.createDataFrame(rows, "seq int, name string, `unique` int, columns string")

    def foreign_key_list(self, table: str) -> DataFrame:
        """(id, table, from, to)."""
        rows = [(i, other, column, theirs) for i, (column, other, theirs) in enumerate(self.meta[table].foreign_keys)]
        return self.spark.createDataFrame(rows, "id int, `table` string, `from` string, `to` string")

    def function_list(self) -> DataFrame:
        """(name) of every function that SQL text may call."""
        return self.spark.sql("SHOW FUNCTIONS").select(F.col("function").alias("name"))

    def integrity_check(self) -> DataFrame:
        """(table, message) of every table whose rows break a constraint."""
        rows = []
        for name, df in self.tables.items():
            try:
                self.check(name, df)
            except ConstraintError as e:
                rows.append((name, str(e)))
        return self.spark.createDataFrame(rows, "table string, message string")

    def explain(self, text: str) -> str:
        """The formatted physical plan."""
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def statistics(self, name: str) -> DataFrame:
        """ANALYZE: (column, n, distinct, nulls, low, high) of a table, in one pass with sketches for the distinct counts."""
        df = self.tables[name]
        each = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.approx_count_distinct(c, 0.01).alias("distinct"), F.sum(F.col(c).isNull().cast("bigint")).alias("nulls"), F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high")) for c, kind in df.dtypes if "<" not in kind]
        return df.agg(F.array(*each).alias("x")).select(F.inline("x"))

    def schema_table(self) -> DataFrame:
        """(type, name, columns) of every table, as a DataFrame."""
        rows = [("table", n, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)) for n, df in sorted(self.tables.items())]
        return self.spark.createDataFrame(rows, "type string, name string, columns string")

    def table_info(self, name: str) -> DataFrame:
        """(cid, name, type, notnull, dflt_value, pk) of a table's columns."""
        meta, df = self.meta[name], self.tables[name]
        rows = [(i, f.name, f.dataType.simpleString(), int(f.name in meta.not_null), meta.defaults.get(f.name), meta.primary_key.index(f.name) + 1 if f.name in meta.primary_key else 0) for i, f in enumerate(df.schema)]
        return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")

    # --- constraints ---

    def check(self, name: str, df: DataFrame) -> None:
        """Raise ConstraintError where rows of df break what name declares: one aggregate a constraint, nothing collected."""
        meta = self.meta[name]
        for key in [meta.primary_key, *meta.unique]:
            if key:
                whole = df.where(" and ".join(f"`{c}` is not null" for c in key))
                if not whole.groupBy(*key).count().where("count > 1").isEmpty():
                    raise ConstraintError(f"{name}: {', '.join(key)} is not unique")
        for column in {*meta.not_null, *meta.primary_key}:
            if not df.where(F.col(column).isNull()).isEmpty():
                raise ConstraintError(f"{name}: {column} is null")
        for label, expression in meta.checks.items():
            if not df.where(f"not ({expression})").isEmpty():
                raise ConstraintError(f"{name}: {label} fails")
        for column, other, theirs in meta.foreign_keys:
            parents = self.tables[other].select(F.col(theirs).alias(column))
            if not df.where(F.col(column).isNotNull()).join(parents, column, "left_anti").isEmpty():
                raise ConstraintError(f"{name}: {column} has no row in {other}")

    # --- transactions ---

    def _state(self) -> tuple[dict, dict, dict]:
        return dict(self.tables), dict(self.meta), dict(self.sequences)

    def savepoint(self, name: str = "") -> None:
        self._saved.append((name, *self._state()))

    def begin(self) -> None:
        if self._saved:
            raise RuntimeError("already in a transaction")
        self.savepoint("")

    def commit(self) -> None:
        self._saved.clear()

    def rollback(self) -> None:
        if self._saved:
            _, self.tables, self.meta, self.sequences = self._saved[0]
            self._saved.clear()
            self.epoch += 1

    def rollback_to(self, name: str) -> None:
        at = max(i for i, s in enumerate(self._saved) if s[0] == name)
        _, tables, meta, sequences = self._saved[at]
        self.tables, self.meta, self.sequences = dict(tables), dict(meta), dict(sequences)
        del self._saved[at + 1 :]
        self.epoch += 1

    def release(self, name: str) -> None:
        at = max(i for i, s in enumerate(self._saved) if s[0] == name)
        del self._saved[at:]

    # --- sequences ---

    def nextval(self, name: str) -> int:
        self.sequences[name] = self.sequences.get(name, 0) + 1
        return self.sequences[name]

    def nextvals(self, name: str, df: DataFrame, column: str, order: list) -> DataFrame:
        """df with the sequence's next values, one a row in the given order; the sequence moves on by the number of rows."""
        from marlpit.operators.dml import with_row_ids

        start = self.spark.range(1).select(F.lit(self.sequences.get(name, 0)).cast("bigint").alias(column))
        out = with_row_ids(start, df, column, order)
        self.sequences[name] = self.sequences.get(name, 0) + df.count()
        return out

    def currval(self, name: str) -> int:
        return self.sequences[name]

    def setval(self, name: str, value: int) -> int:
        self.sequences[name] = value
        return value
