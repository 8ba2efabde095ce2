"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are put in a hash order and cut in blocks of one BLOCKS-th of all rows (or of `block_rows`,
where given). With the weights of the sources
that are not used up, a source's fair share grows slot by slot; block k may not come before the slot in which its
fair share reaches k - 1 blocks (release) and must come by the slot in which it reaches k (deadline). Earliest
deadline first over the released blocks meets every deadline, so at any slot each source is less than one block from
its fair share. When a source is used up, the others go on in the proportions of their weights: every document
comes once.

Only (source, number of rows) goes to the driver; the plan has a row for each block: BLOCKS plus one for each source
at any table's size, so at any place of the order a source is less than 1 / BLOCKS of the table from its share. A
given block_rows that makes more than MAX_BLOCKS blocks raises ValueError. Null sources form a source of their own. Rows
of a source come in the order of a hash of id and text, then id; repeated rows by chance. An empty table gives an empty
result. Names that begin with __mp_ are reserved.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.llm.text import materialize, row_keys

BLOCKS, MAX_BLOCKS, POWER = 1 << 14, 1 << 20, 0.7
#: Rows of a source that are sorted together, where there are enough of them for every core.
BUCKET_ROWS = 20_000


def windows(counts: dict, weights: dict) -> list[tuple[int, int, object, int]]:
    """(release, deadline, source, block) of each block: whole slots, from fair shares of exact fractions."""
    order = sorted((s for s in counts if counts[s] > 0), key=lambda s: (counts[s] / weights[s], repr(s)))
    # fair time runs so that an unfinished source gets its weight of blocks per unit; it is piecewise linear in slots
    out = []
    time, slots, left = Fraction(0), Fraction(0), sum((weights[s] for s in order), Fraction(0))
    pieces = []  # (fair time, slots, total weight) where each piece begins
    for s in order:
        pieces.append((time, slots, left))
        end = counts[s] / weights[s]
        slots += (end - time) * left
        time, left = end, left - weights[s]
    for at, s in enumerate(order):
        p, moved = 0, []
        for k in range(counts[s] + 1):
            fair = k / weights[s]
            while p < at and pieces[p + 1][0] <= fair:
                p += 1
            t0, s0, w = pieces[p]
            moved.append(s0 + (fair - t0) * w)
        out += [(int(moved[k]), -int(-moved[k + 1] // 1), s, k) for k in range(counts[s])]
    return out


def schedule(counts: dict, weights: dict) -> list[tuple[object, int, int]]:
    """(source, block, slot) of every block: earliest deadline first among the released."""
    jobs = sorted(windows(counts, weights), key=lambda x: (x[0], x[1], repr(x[2]), x[3]))
    ready: list[tuple[int, str, int, object]] = []
    out, at = [], 0
    for slot in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= slot:
            _, deadline, s, k = jobs[at]
            heapq.heappush(ready, (deadline, repr(s), k, s))
            at += 1
        deadline, _, k, s = heapq.heappop(ready)
        if deadline < slot + 1:
            raise AssertionError("a deadline was missed")
        out.append((s, k, slot))
    return out


def target_weights(counts: dict, weights: dict | None = None, power: float = POWER) -> dict:
    """Weights as fractions: those given, or each source's share of rows to a power below 1, which lifts small sources."""
    return {s: Fraction((weights[s] if weights else n**power)).limit_denominator(10**6) for s, n in counts.items() if n}


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int | None = None) -> DataFrame:
    """(doc_id, source, row_key, row_check, block, slot, position): where every row comes; position counts rows from 0, without gaps."""
    key, check = row_keys("doc_id", "text")
    rows = docs.select("doc_id", "source", key.alias("row_key"), check.alias("row_check"))
    return places(materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "mixing"), weights, block_rows).drop("tie")


def places(rows: DataFrame, weights: dict | None = None, block_rows: int | None = None) -> DataFrame:
    """mix of rows (doc_id, source, row_key, row_check, tie) that are written already, with their tie: a number of each row."""
    spark = rows.sparkSession
    counts = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}  # a row per source
    total = sum(counts.values())
    block_rows = block_rows or max(1, -(-total // BLOCKS))
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    if sum(blocks.values()) > MAX_BLOCKS + len(blocks):
        raise ValueError(f"blocks of {block_rows} rows are too many to plan: take at least {-(-total // MAX_BLOCKS)}")
    plan = schedule(blocks, target_weights(counts, weights)) if counts else []
    before, table = 0, []
    for s, k, slot in plan:
        table.append((s, k, slot, before))
        before += min(block_rows, counts[s] - k * block_rows)
    # a row's place in its source: rows before its bucket of the hash order, and its place in the bucket; each source
    # has buckets of its own number, so that a hot source is dealt over many tasks
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = min(BUCKET_ROWS, 1 + total // parts)
    kind = rows.schema["source"].dataType.simpleString()
    shares = spark.createDataFrame([(s, -(-n // per)) for s, n in counts.items()], f"s {kind}, parts long")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(17), "row_key"), 1)
    rows = rows.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # a row per source
    rows = rows.withColumn("key", key).withColumn("bucket", F.floor((F.shiftright(key, 32) * F.col("parts")) / F.lit(float(1 << 31))).cast("long"))
    sizes = rows.groupBy("source", "bucket").count()
    starts = sizes.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("count").over(Window.partitionBy("source").orderBy("bucket")) - F.col("count")).alias("start"))
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie")
    rows = rows.withColumn("place", F.row_number().over(own) - 1)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("place", F.col("place") + F.col("start"))
    rows = rows.withColumn("block", F.expr(f"place div {block_rows}")).drop("s", "b", "start", "bucket", "parts")
    slots = F.broadcast(spark.createDataFrame(table, f"s {kind}, b long, slot long, first long"))  # a row per block
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return rows.select("doc_id", "source", "row_key", "row_check", "tie", "block", "slot", (F.col("first") + F.expr(f"place % {block_rows}")).alias("position"))


def in_order(docs: DataFrame, weights: dict | None = None, block_rows: int | None = None) -> DataFrame:
    """docs with its rows in mixed order, in range partitions of it. Columns as in docs; rows that repeat stay as many."""
    places = mix(docs, weights, block_rows).groupBy(F.col("row_key").alias("__mp_key"), F.col("row_check").alias("__mp_check")).agg(F.min("position").alias("__mp_at"))
    key, check = row_keys("doc_id", "text")
    own = docs.withColumn("__mp_key", key).withColumn("__mp_check", check).join(places, ["__mp_key", "__mp_check"]).drop("__mp_key", "__mp_check")
    return own.repartitionByRange("__mp_at").sortWithinPartitions("__mp_at").drop("__mp_at")
