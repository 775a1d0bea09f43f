"""What a set of filters costs, together and in every order.

A document is known by the set of filters it fails, a bit mask, so the table
shrinks to one cell per part and mask: a count and the counts of good and toxic
rows.  Every cell is folded along every order of the filters, an array carried
in the plan, with ``aggregate`` and ``transform``; the structs that come out,
one per order and step, are added up element by element over the cells of a
part.  Documents never meet the orders.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_FILTERS = 6  # 720 orders; a part has at most 2^6 cells
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

# fixed values: limits of the four filters on a text alone
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # per cent of the words
MOST_CAPITALS = 10  # per cent of the code points
MARKS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def text_filters() -> dict[str, Column]:
    """Name -> whether the column ``text``, never null, fails: few words, few distinct ones, capitals, marks."""
    text = F.col("text")
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.char_length(text),
        "D": text.rlike(MARKS),
    }


def _mask(filters: Sequence[Column]) -> Column:
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(filters)]
    return sum(bits[1:], bits[0]).cast("int")


def document_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters.

    Bit k of the mask is the k-th of ``filters``; the bit behind them says that
    a smaller doc_id anywhere in the table has the identical text, as told by
    SHA-256.  Only ids, masks and hashes leave the scan.  Copies of a text meet
    in partial sums before the shuffle, so a text may be any share of the rows.

    Defined cases: null text or part: empty; null id: no label, and neither a
    copy nor the original of one; rows that repeat an id count each, and are no
    copies of each other; an id with several label rows has the largest of
    each; labels of unknown documents, null labels and extra columns are
    ignored; long texts are read whole; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    slim = rows.select("doc_id", "part", _mask(list(filters.values())).alias("mask"), F.unhex(F.sha2("text", 256)).alias("hash"))
    slim = slim.groupBy("doc_id", "part", "mask", "hash").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id are dealt by their hash and meet no label
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("hash"), F.lit(1 << 20))).otherwise(F.lit(0))
    slim = slim.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_salt": salt})
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        F.lit(0).cast("long").alias("_salt"),
    )
    told = slim.join(known, ["_id", "_salt"], "left").fillna(False, ["good", "toxic"])
    has_id = F.col("doc_id").isNotNull()
    groups = told.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("with_id"),
        F.sum("n").alias("n"),
    )
    # a text has few groups, at most four a part, however many copies
    least = F.min("first.doc_id").over(Window.partitionBy("hash"))
    groups = groups.withColumn("least", least)
    copies = F.col("with_id") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.coalesce(copies, F.lit(0))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")),
        F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), copies.alias("n")),
    )
    split = groups.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def _step(alive: Column, filter_: Column, cell: Column) -> Column:
    """The counts of one filter at its place in an order, for one cell."""
    bit = F.call_function("shiftleft", F.lit(1), filter_)
    fails = cell["mask"].bitwiseAND(bit) != 0
    here = alive & fails

    def counted(condition: Column, weight: str, name: str) -> Column:
        return F.when(condition, cell[weight]).otherwise(F.lit(0).cast("long")).alias(name)

    return F.struct(
        filter_.alias("filter"),
        counted(alive & ~fails, "n", "kept"),
        counted(here, "n", "removed"),
        counted(~alive & fails, "n", "redundant"),
        counted(cell["mask"] == bit, "n", "unique_fails"),
        counted(here, "good", "good_lost"),
        counted(here, "toxic", "toxic_lost"),
    )


STEP = "struct<filter:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def _folded(cell: Column, orders: Column) -> Column:
    """The cell along every order: an array of one struct per order and step."""

    def along(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<{STEP}>").alias("steps"))

        def take(state: Column, filter_: Column) -> Column:
            step = _step(state["alive"], filter_, cell)
            survives = state["alive"] & (cell["mask"].bitwiseAND(F.call_function("shiftleft", F.lit(1), filter_)) == 0)
            return F.struct(survives.alias("alive"), F.concat(state["steps"], F.array(step)).cast(f"array<{STEP}>").alias("steps"))

        return F.aggregate(order, start, take, lambda state: state["steps"])

    return F.flatten(F.transform(orders, along))


def _added(total: Column, more: Column) -> Column:
    both = F.zip_with(
        total, more, lambda a, b: F.struct(b["filter"].alias("filter"), *[(a[c] + b[c]).alias(c) for c in COUNTS])
    )
    return both.cast(f"array<{STEP}>")


def filter_orders(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, counts, shapley): every part, order of the filters and step.

    ``cells`` has (part, mask, n, good, toxic), bit k of the mask for the k-th
    name, at most one row per part and mask.  kept are left after the step,
    removed go in it, redundant fail its filter but went before, unique_fails
    fail no other, good_lost and toxic_lost are the labelled ones of removed;
    shapley is what the filter removes, summed over all orders.

    A part has at most 2^filters cells, so the cells of a part are one bounded
    array.  Defined cases: a part appears with zeros where nothing is counted;
    null parts stay null; no cells give no rows.
    """
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST_FILTERS} filters of different names")
    every = list(permutations(range(len(names))))
    orders = F.from_json(F.lit(json.dumps(every)), "array<array<int>>")  # one literal, broadcast with the plan
    per_part = cells.groupBy("part").agg(
        F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), *[F.col(c).cast("long").alias(c) for c in ("n", "good", "toxic")])).alias("cells")
    )
    zeros = F.array_repeat(F.struct(F.lit(0).alias("filter"), *[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(every) * len(names))
    zeros = zeros.cast(f"array<{STEP}>")
    merged = F.aggregate("cells", zeros, lambda total, cell: _added(total, _folded(cell, orders)))
    summed = per_part.select("part", merged.alias("steps"))

    def removed_by(f: int) -> Column:
        mine = F.filter("steps", lambda s: s["filter"] == f)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda total, s: total + s["removed"])

    of_filter = [removed_by(f) for f in range(len(names))]
    rows = summed.select("part", F.array(*of_filter).alias("_of_filter"), F.posexplode("steps").alias("_at", "_step"))
    order_names = F.from_json(F.lit(json.dumps(["".join(names[f] for f in order) for order in every])), "array<string>")
    return rows.select(
        "part",
        F.element_at(order_names, (F.floor(F.col("_at") / len(names)) + 1).cast("int")).alias("filter_order"),
        (F.col("_at") % len(names) + 1).alias("step"),
        *[F.col(f"_step.{c}").alias(c) for c in COUNTS],
        F.element_at("_of_filter", F.col("_step.filter") + 1).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The four filters on texts, then copies (E): cells of ``document_cells`` along all 120 orders."""
    filters = text_filters()
    return filter_orders(document_cells(docs, labels, filters, part), [*filters, "E"])
