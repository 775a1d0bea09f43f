"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, document after document, are cut into blocks.  Output
shards draw how many blocks they take from each source (multinomial); the
slots of a source count up through all shards, and slot t takes the block that
a pseudorandom permutation of the source's block numbers puts at t modulo
their number.  Slots meet blocks in a join by block number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.llm.common import blocks_for, n_words, running_totals
from headroom.session import stage

BLOCK_WORDS = 64
SHARDS = 64
WEIGHTS = (3, 1, 2)
VOLUME = 1.5
MOST = 2.0
SEED = 20_240
BLOCK_ROWS = 20_000
SLOT_CHUNK = 4_096
ROUNDS = 4
WALK = 16


def source_targets(sizes: Sequence[int], weights: Sequence[float], volume: float, most: float) -> list[float]:
    """Words to take per source: ``volume`` times all words shared by weight.

    A target stops at ``most`` times its source's size; what is over is shared
    again among the others until no target is above.
    """
    targets = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], volume * sum(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def draw_counts(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial draws by what is left of each quota, adding up to the quotas."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, dtype=np.int64)
    counts = np.zeros((shards, len(left)), dtype=np.int64)
    for k in range(shards - 1):
        whole = int(left.sum())
        if not whole:
            break
        take = np.minimum(rng.multinomial(whole // (shards - k), left / whole), left)
        counts[k] = take
        left -= take
    counts[-1] += left
    return counts


def permuted(df: DataFrame, position: str, out: str, seed: int) -> DataFrame:
    """Add ``out``: the number that the source's keyed permutation has at ``position``.

    A Feistel network over a _width x _height grid that holds _number cells
    and fewer than _width more.  A cell beyond is walked on from; in a grid
    that tight ``WALK`` steps always end inside (by count for numbers up to
    200, with a chance of failure below 1e-18 for larger ones, which raises).
    """
    width, height, number = F.col("_width"), F.col("_height"), F.col("_number")

    def once(cell: Column) -> Column:
        a, b = F.floor(cell / height).cast("long"), cell % height
        for r in range(ROUNDS):
            a = (a + F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * r), "_source", b), width)) % width
            b = (b + F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * r + 1), "_source", a), height)) % height
        return a * height + b

    df = df.withColumn("_cell", once(F.col(position)))
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALK)), F.col("_cell"), lambda x, _: F.when(x < number, x).otherwise(once(x))
    )
    df = df.withColumn("_cell", F.when(F.col("_cell") < number, F.col("_cell")).otherwise(walked))
    lost = F.raise_error(F.lit("a permutation left its range")).cast("long")
    return df.withColumn(out, F.when(F.col("_cell") < number, F.col("_cell")).otherwise(lost)).drop("_cell")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # null comes last


def copy_number() -> Column:
    """Tells rows that share an id apart; equal rows are interchangeable."""
    return F.row_number().over(Window.partitionBy("doc_id").orderBy(source_key(), F.xxhash64("text")))


class Mix:
    """A planned mix: ``rows`` of documents, ``sources``, and the taken ``blocks``.

    rows: doc_id, _copy, _source, size, _start (words of the source before it)
    sources: _source, source_size, target, _number (of blocks), _draws
    slots: _source, shard, slot (counting up through all shards), block
    """

    def __init__(self, docs: DataFrame, block_words: int, shards: int, volume: float, most: float, seed: int):
        spark = docs.sparkSession
        self.block_words = block_words
        slim = docs.select("doc_id", source_key().alias("_key"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
        slim = stage(slim, "word-counts")
        # one row per source; Spark compares strings by their bytes, as code points are ordered
        found = slim.groupBy("_key").agg(F.sum("size"), F.count(F.lit(1))).orderBy(F.col("_key") == "~", "_key").collect()
        sizes = [r[1] for r in found]
        weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
        targets = source_targets(sizes, weights, volume, most)
        numbers = [-(-s // block_words) for s in sizes]
        # the last block of a source is shorter, so draws are counted in mean blocks
        draws = [round(t * n / s) if s else 0 for t, n, s in zip(targets, numbers, sizes, strict=True)]
        rows, counts = [], draw_counts(draws, shards, seed)
        for i, (r, target, number) in enumerate(zip(found, targets, numbers, strict=True)):
            width = int(np.ceil(np.sqrt(number))) or 1
            rows.append((r[0], i, sizes[i], float(target), number, width, -(-number // width) or 1))
        schema = "_key string, _source int, source_size long, target double, _number long, _width long, _height long"
        self.sources = spark.createDataFrame(rows, schema)
        drawn, before = [], np.cumsum(counts, axis=0) - counts
        for k in range(shards):
            drawn += [(i, k, int(before[k, i]), int(counts[k, i])) for i in range(len(found)) if counts[k, i]]
        # a task makes the slots of a few chunks
        self.slot_tasks = blocks_for(sum(draws), 4 * SLOT_CHUNK)
        self.drawn = spark.createDataFrame(drawn, "_source int, shard int, _first long, _count long")
        numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("_key", "_text"))
        keyed = slim.withColumn("_copy", numbered).join(F.broadcast(self.sources.select("_key", "_source")), "_key")
        keyed = stage(keyed.select("doc_id", "_copy", "_source", "size"), "sized")
        blocks = blocks_for(sum(r[2] for r in found), BLOCK_ROWS)
        self.rows = running_totals(keyed, ["_source"], ["doc_id", "_copy"], {"_start": F.col("size")}, blocks).drop("_block")
        self.seed = seed

    def slots(self) -> DataFrame:
        """(_source, shard, slot, block): every draw and the block it takes."""
        last = F.col("_first") + F.col("_count") - 1
        chunks = self.drawn.select(
            "_source", "shard", last.alias("_last"), F.explode(F.sequence("_first", last, F.lit(SLOT_CHUNK))).alias("_at")
        )
        chunks = chunks.repartition(self.slot_tasks, "_source", "_at")
        upto = F.least(F.col("_at") + SLOT_CHUNK - 1, F.col("_last"))
        slots = chunks.select("_source", "shard", F.explode(F.sequence("_at", upto)).alias("slot"))
        grid = self.sources.select("_source", "_number", "_width", "_height")
        slots = slots.join(F.broadcast(grid), "_source").withColumn("_position", F.col("slot") % F.col("_number"))
        return permuted(slots, "_position", "block", self.seed).select("_source", "shard", "slot", "block")

    def pieces(self) -> DataFrame:
        """(doc_id, _copy, _source, _start, size, block, _from, _words): a document's words in each block it touches."""
        size = F.lit(self.block_words)
        start, end = F.col("_start"), F.col("_start") + F.col("size")
        touched = F.sequence(F.floor(start / size), F.floor((end - 1) / size))
        rows = self.rows.filter("size > 0").select("doc_id", "_copy", "_source", "_start", "size", F.explode(touched).alias("block"))
        begin = F.greatest(start, F.col("block") * size)
        stop = F.least(end, (F.col("block") + 1) * size)
        return rows.select(
            "doc_id", "_copy", "_source", "_start", "size", "block", (begin - start).alias("_from"), (stop - begin).alias("_words")
        )


def plan_mix(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    volume: float = VOLUME,
    most: float = MOST,
    seed: int = SEED,
) -> Mix:
    """Plan a mix of ``docs`` (doc_id, text, source).

    Sources in code-point order, null last, weigh 3, 1, 2, 3, 1, 2, ...  The
    driver sees one row per source and one count per source and output shard.

    Defined cases: null text: no words, never taken; null source: a source of
    its own; sources without words: target 0; repeated rows are rows of their
    own; an empty table gives an empty mix; other columns are ignored.
    """
    return Mix(docs, block_words, shards, volume, most, seed)


def taken_words(mix: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    times = mix.slots().groupBy("_source", "block").agg(F.count(F.lit(1)).alias("_times"))
    # a start tells the documents of a source apart, as those without words have no pieces
    taken = (
        mix.pieces()
        .join(times, ["_source", "block"])
        .groupBy("_source", "_start")
        .agg(F.sum(F.col("_words") * F.col("_times")).alias("taken"))
    )
    rows = mix.rows.join(F.broadcast(mix.sources.select("_source", "source_size", "target")), "_source")
    some = rows.filter("size > 0").join(taken, ["_source", "_start"], "left")
    none = rows.filter("size = 0").withColumn("taken", F.lit(None).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return some.select(*columns).unionByName(none.select(*columns))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: a row per document and pass, holding the words that pass takes.

    A source's slots pass over its blocks once or twice.  A document taken
    whole keeps its text as it is; of one taken in part the taken words stay,
    with the white space between neighbours; one not taken goes.  Columns are
    those of ``docs``; n_chars is counted anew.
    """
    mix = plan_mix(docs, **settings)
    slots = mix.slots().join(F.broadcast(mix.sources.select("_source", "_number")), "_source")
    slots = slots.select("_source", "block", F.floor(F.col("slot") / F.col("_number")).alias("_pass"))
    span = F.struct(F.col("_from").cast("int").alias("at"), F.col("_words").cast("int").alias("n"))
    taken = (
        mix.pieces()
        .join(slots, ["_source", "block"])
        .groupBy("doc_id", "_copy", "_pass")
        .agg(F.sort_array(F.collect_list(span)).alias("_spans"), (F.sum("_words") == F.max("size")).alias("_whole"))
        .withColumnRenamed("doc_id", "_id")
    )
    # other columns travel in one, so that their names do not matter
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select("doc_id", "text", "source", row.alias("_row")).withColumn("_copy", copy_number())
    rows = packed.join(taken, packed["doc_id"].eqNullSafe(F.col("_id")) & (packed["_copy"] == taken["_copy"]))
    # a word with the white space before it; bound to a name, as each span would split the text anew
    units = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    bound = F.array(F.struct(units.alias("units"), F.col("_spans").alias("spans")))

    def words_at(x: Column) -> Column:
        return F.array_join(F.transform(x["spans"], lambda s: F.array_join(F.slice(x["units"], s["at"] + 1, s["n"]), "")), "")

    part = F.ltrim(F.transform(bound, words_at)[0])
    rows = rows.withColumn("_mixed", F.when(F.col("_whole"), F.col("text")).otherwise(part))
    replaced = {"text": F.col("_mixed"), "n_chars": F.char_length("_mixed").cast("long")}
    return rows.select(*[replaced.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
