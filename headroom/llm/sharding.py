"""Resharding with the fewest bytes moved, as a minimum-cost flow of blocks.

Old shards supply their bytes, new shards take up to their capacity.  Sending
a byte of old shard i to new shard i costs nothing, to any other it costs one.
The cheapest flow therefore fills the free arcs first, and any routing of the
rest is equally cheap: no flow moves less than the sum over i of
max(0, size i - capacity i).  The flow is solved over shards, never over
documents; documents follow it by their byte position in the old shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.llm.common import blocks_for, fresh, running_totals
from headroom.session import stage, stage_path

ROW_BYTES = 16
BLOCK_ROWS = 20_000
FILE_BYTES = 64 << 20  # of texts, about, in a written file


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities that add up to ``total`` and are at most one byte apart."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def solve_transfers(old_sizes: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): byte ranges of old shards and the new shard that takes each.

    Capacities must add up to the old sizes.  At most len(old) + len(new)
    ranges; the bytes that change shard are as few as can be.
    """
    if sum(old_sizes) != sum(capacities):
        raise ValueError("capacities must add up to the old sizes")
    room = list(capacities)
    blocks, rest = [], []
    for i, size in enumerate(old_sizes):
        stays = min(size, room[i]) if i < len(room) else 0
        if stays:
            blocks.append((i, i, 0, stays))
            room[i] -= stays
        if size > stays:
            rest.append((i, stays, size))
    j = 0
    for i, at, end in rest:
        while at < end:
            while not room[j]:
                j += 1
            part = min(room[j], end - at)
            blocks.append((i, j, at, at + part))
            room[j] -= part
            at += part
    return blocks


def document_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def plan_reshard(
    docs: DataFrame, old: str, shards: int, block_rows: int = BLOCK_ROWS, row: str | None = None
) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of every document, and ``row`` if there is one.

    ``row`` is a column that tells every row from every other and stays the
    same whenever ``docs`` is read: written, or the file and position of a row.

    ``old`` is a column with the name of the shard that holds a document now;
    old shards are numbered by name, and old shard i is what new shard i was.
    A document goes where the middle of its bytes goes, so a new shard differs
    from its capacity by no more than a document at each of its ranges' ends.
    Only ids, sizes and checksums are read and shuffled; the driver sees one
    size per old shard.

    Defined cases: null text has no bytes and the checksum of an empty text;
    null shard name: a shard of its own; repeated rows are separate rows; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    key = [] if row is None else [row]
    name = F.coalesce(F.concat(F.lit("/"), F.col(old)), F.lit(""))
    slim = docs.select(
        "doc_id",
        document_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        name.alias("_name"),
        *key,
    )
    slim = stage(slim, "sizes")
    sizes = slim.groupBy("_name").agg(F.sum("size"), F.count(F.lit(1))).orderBy("_name").collect()
    old_sizes = [r[1] for r in sizes]
    blocks = blocks_for(sum(r[2] for r in sizes), block_rows)
    ranges = solve_transfers(old_sizes, equal_capacities(sum(old_sizes), shards))
    # both tables have at most one row per old shard and new shard
    numbers = spark.createDataFrame([(r[0], i) for i, r in enumerate(sizes)], "_name string, old_shard int")
    moves = spark.createDataFrame(ranges, "old_shard int, shard int, _from long, _to long")
    numbered = slim.join(F.broadcast(numbers), "_name").drop("_name")
    placed = running_totals(numbered, ["old_shard"], ["doc_id", "text_crc32", "size", *key], {"_start": F.col("size")}, blocks)
    middle = F.col("_start") + F.floor(F.col("size") / 2)
    placed = placed.join(F.broadcast(moves), "old_shard").filter((middle >= F.col("_from")) & (middle < F.col("_to")))
    placed = stage(placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", *key), "placed")
    order = ["doc_id", "text_crc32", "size", "old_shard", *key]
    return running_totals(placed, ["shard"], order, {"slot": F.lit(1)}, blocks).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", F.col("slot").cast("long").alias("slot"), *key
    )


def affected_shards(plan: DataFrame) -> DataFrame:
    """(shard, moved_bytes): new shards that are not what the old shard of that number was."""
    arrive = plan.select("shard", "size", (F.col("shard") != F.col("old_shard")).alias("moves"))
    leave = plan.filter("shard != old_shard").select(F.col("old_shard").alias("shard"), "size", F.lit(True).alias("moves"))
    return (
        arrive.unionByName(leave)
        .groupBy("shard")
        .agg(F.sum(F.when(F.col("moves"), F.col("size")).otherwise(0)).alias("moved_bytes"))
        .filter("moved_bytes > 0")
    )


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str, row: str | None = None) -> None:
    """Write the new files of the affected shards, one folder each; other shards stay as they are.

    Documents meet their plan by ``row``, the column the plan was made with,
    which is not written.  Without it they meet by doc_id, and null or
    repeated ids raise, as their rows would be lost or multiplied.
    """
    if row is None and not plan.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        raise ValueError("ids are null or repeat: plan and rewrite with a row key")
    key = "doc_id" if row is None else row
    changed = plan.join(F.broadcast(affected_shards(plan).select("shard")), "shard")
    moved = docs.join(changed.select(key, "shard", "slot"), key)
    moved = moved if row is None else moved.drop(row)
    moved.repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)).write.partitionBy("shard").mode("overwrite").parquet(path)


def reshard(docs: DataFrame, old: str, shards: int, row: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Plan, rewrite the affected shards, and tell what their files hold.

    (doc_id, size, text_crc32, old_shard, shard, slot) of every document.
    Files are written under ``spark.checkpoint.dir``, with all columns of
    ``docs`` but ``old`` and ``row``.  Sizes and checksums are those of the
    texts in the new files, and in the old files of shards that stay as they
    are; only old_shard is taken from the plan.  ``row`` as in ``plan_reshard``.
    """
    spark = docs.sparkSession
    plan = stage(plan_reshard(docs, old, shards, block_rows, row), "plan")
    path = stage_path(spark, "shards")
    whole = docs.drop(old)
    rewrite_affected(whole, plan, path, row)
    schema = whole.drop(row).schema.add("slot", "long").add("shard", "integer")
    written = _digests(spark.read.schema(schema).parquet(path), "shard", "slot")
    told = written.join(plan.select("shard", "slot", "old_shard"), ["shard", "slot"], "left")
    stay = plan.join(F.broadcast(affected_shards(plan).select("shard")), "shard", "left_anti")
    if not stay.isEmpty():
        told = told.unionByName(_digests(docs, row).join(stay.select(row, "old_shard", "shard", "slot"), row).drop(row))
    return told.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


# --- shards that are read in order ---------------------------------------------------------------


def position_ranges(docs: DataFrame, old: str, position: str, shards: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_name, old_shard, shard, _first, _last, _slot, _bytes): runs of positions of an old shard that go to one new shard.

    Documents keep their order in the old shard, so a byte range of the flow
    is a run of positions: at most one per old and new shard and no row per
    document.  ``position`` counts the rows of an old shard from 0; anything
    else raises.  ``_slot`` is the slot of the run's first row.

    Positions are summed in blocks of consecutive rows, with an offset per
    block, so one old shard may hold any share of the rows.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("/"), F.col(old)), F.lit(""))
    slim = docs.select(name.alias("_name"), F.col(position).cast("long").alias("_at"), document_size(F.col("text")).alias("size"))
    slim = stage(slim, "sizes")
    sizes = slim.groupBy("_name").agg(
        F.sum("size"), F.count(F.lit(1)), F.min("_at"), F.max("_at"), F.sum("_at")
    ).orderBy("_name").collect()
    for _, _, rows, first, last, total in sizes:
        if (first, last, total) != (0, rows - 1, rows * (rows - 1) // 2):
            raise ValueError("positions must count the rows of a shard from 0")
    old_sizes = [r[1] for r in sizes]
    moves = solve_transfers(old_sizes, equal_capacities(sum(old_sizes), shards))
    # both tables have at most one row per old shard and new shard
    numbers = spark.createDataFrame([(r[0], i) for i, r in enumerate(sizes)], "_name string, old_shard int")
    moves = spark.createDataFrame(moves, "old_shard int, shard int, _from long, _to long")
    block = F.floor(F.col("_at") / block_rows).alias("_block")
    sums = slim.groupBy("_name", block).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_name", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_name", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = slim.select("*", block).withColumn("_start", start).join(sums, ["_name", "_block"])
    middle = F.col("_before") + F.col("_start") + F.floor(F.col("size") / 2)
    placed = rows.join(F.broadcast(numbers), "_name").join(F.broadcast(moves), "old_shard")
    placed = placed.filter((middle >= F.col("_from")) & (middle < F.col("_to")))
    runs = placed.groupBy("_name", "old_shard", "shard", "_from").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("size").alias("_bytes")
    )
    # a row per run, as many as ranges of the flow
    earlier = Window.partitionBy("shard").orderBy("old_shard", "_first").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(earlier), F.lit(0))
    return stage(runs.withColumn("_slot", slot).drop("_from"), "runs")


def reshard_in_order(docs: DataFrame, old: str, position: str, shards: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Plan, rewrite the affected shards, and tell what their files hold: (doc_id, size, text_crc32, old_shard, shard, slot).

    As ``reshard`` for old shards whose rows have a ``position``, such as the
    rows of files: the plan is one small table, so it meets the documents by a
    broadcast and texts are shuffled once, those of affected shards only.
    Files hold the other columns of ``docs``, and the slot and shard under
    names of their own, and about ``FILE_BYTES`` of texts each.  Sizes and
    checksums are those of the new files, and of the old files of shards that
    stay as they are.

    Defined cases: null text has no bytes and the checksum of an empty text;
    null shard name: a shard of its own; ids may be null or repeat, repeated
    rows are separate rows; ties and very long texts: a document goes where the
    middle of its bytes goes; columns of any name go along; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    whole = [c for c in docs.columns if c not in (old, position)]
    shard, slot = fresh("shard", whole), fresh("slot", [*whole, "shard"])
    runs = position_ranges(docs, old, position, shards, block_rows)
    arrive = runs.groupBy("shard").agg(
        F.max(F.col("shard") != F.col("old_shard")).alias("_in"),
        F.sum("_bytes").alias("_all"),
        F.sum(F.col("_last") - F.col("_first") + 1).alias("_rows"),
    )
    leave = runs.filter("shard != old_shard").select(F.col("old_shard").alias("shard"), F.lit(True).alias("_out")).distinct()
    touched = arrive.join(F.broadcast(leave), "shard", "left").withColumn("_new", F.col("_in") | F.coalesce("_out", F.lit(False)))
    each = F.greatest(F.lit(1), F.floor(F.col("_rows") * FILE_BYTES / F.greatest(F.col("_all"), F.lit(1))))
    plan = runs.join(touched.select("shard", "_new", each.alias("_each")), "shard")
    # as many rows as ranges of the flow: at most one per old shard and new shard
    plan = stage(plan.withColumnsRenamed({"_name": "_run", "shard": "_shard", "_slot": "_base"}), "plan")
    name = F.coalesce(F.concat(F.lit("/"), F.col(f"`{old}`")), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in whole])
    # the other columns travel in one, so that their names do not matter
    rows = docs.select(name.alias("_name"), F.col(f"`{position}`").cast("long").alias("_at"), row.alias("_row"))
    met = rows.join(
        F.broadcast(plan), (F.col("_name") == F.col("_run")) & F.col("_at").between(F.col("_first"), F.col("_last"))
    ).withColumn("_to", F.col("_base") + F.col("_at") - F.col("_first"))
    stay = met.filter(~F.col("_new")).select("_row.doc_id", "_row.text", "old_shard", "_shard", F.col("_to").alias("_slot"))
    moved = met.filter("_new").repartition("_shard", F.floor(F.col("_to") / F.col("_each")))
    path = stage_path(spark, "shards")
    moved.select("_row.*", F.col("_to").alias(slot), F.col("_shard").alias(shard)).write.partitionBy(shard).parquet(path)
    schema = docs.select(*[f"`{c}`" for c in whole]).schema.add(slot, "long").add(shard, "integer")
    written = spark.read.schema(schema).parquet(path)
    written = written.select("doc_id", "text", F.col(f"`{shard}`").alias("_shard"), F.col(f"`{slot}`").alias("_slot"))
    origin = plan.select(F.col("_shard").alias("_of"), "old_shard", "_base", (F.col("_base") + F.col("_last") - F.col("_first")).alias("_end"))
    written = written.join(F.broadcast(origin), (F.col("_of") == F.col("_shard")) & F.col("_slot").between(F.col("_base"), F.col("_end")))
    told = _digests(written.select(*stay.columns).unionByName(stay), "old_shard", "_shard", "_slot")
    return told.withColumnsRenamed({"_shard": "shard", "_slot": "slot"})


def _digests(docs: DataFrame, *others: str) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id", document_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), *others
    )
