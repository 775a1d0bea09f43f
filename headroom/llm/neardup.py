"""Near duplicates by SetSketch registers, joint likelihood and exact checks.

A text is the set of its word shingles.  Register i of a sketch holds
floor(1 - log_b h) for the smallest of exponentially distributed hashes h of
the set's members, truncated to 16 bits; registers of a union are the larger
of both, and two sets agree in a register with about the probability of their
Jaccard similarity.  Sets that agree in all registers of a band are
candidates.  The likelihood of a candidate pair's registers, given both set
sizes, says whether the similarity can reach the threshold; the full sets of
what is left are compared.

Candidates are never listed pair by pair.  Each bucket of a band first
proposes links to one of its members only; what that connects is one
component.  In buckets that still hold several components, members are then
compared across components inside tasks, a bounded block of the bucket with
another.  The rows of a bucket's largest component, which may be most of it,
meet only the rest, and blocks meet only where set sizes allow the similarity.
First the likeliest pairs that would join the components of a block pair are
checked, a forest; then all that is left, and only links leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from headroom.llm.common import with_row_key, without
from headroom.llm.graph import components
from headroom.llm.words import GROUP_BYTES, LOWER, MASK, Hashed, groups, mix, pieces
from headroom.session import stage

SHINGLE_WORDS = 3
SIMILARITY = 85  # per cent
BANDS = 21
BAND_ROWS = 6
REGISTERS = BANDS * BAND_ROWS
BASE = 1.02
TOP = 2**16 - 2
SEED = 7
SURE = 4.0
HEAD_ROWS = 2_000
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 18  # of a block, unless one set has more
SLICE = 1 << 14
STEPS, CHUNKS = 1 << 14, 1 << 30  # places of a block's number

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


# --- shingles and sketches -------------------------------------------------------------


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words are one shingle."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(words) - n + 1])
    return np.unique(total)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle set of every text of a column; A-Z are lower-cased, null is empty."""
    for first, last, data, bounds in groups(column):
        data = LOWER[data]
        if last - first == 1 and len(data) > GROUP_BYTES:
            parts = [Hashed(p, np.array([0, len(p)])).words().hash for p in pieces(data)]
            yield shingles(np.concatenate(parts), n)
            continue
        words = Hashed(data, bounds).words()
        cuts = np.searchsorted(words.text, np.arange(last - first + 1))
        for k in range(last - first):
            yield shingles(words.hash[cuts[k] : cuts[k + 1]], n)


def smallest_hashes(members: np.ndarray) -> np.ndarray:
    """Per register, the smallest hash of the members, a slice of them at a time."""
    x = (members >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(REGISTERS, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(x), SLICE):
        np.minimum(least, (x[at : at + SLICE] * FACTORS + TERMS).min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Register values out of smallest hashes: 1 - log_b of an exponential variable, truncated."""
    h = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union of sets."""
    return np.maximum(a, b)


def band_keys(values: np.ndarray) -> np.ndarray:
    """(sets, bands): one 64-bit key per band of register values."""
    rows = values.reshape(len(values), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, :, k])
    return key.astype(np.int64)


def set_hash(members: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever order they were made in."""
    if not len(members):
        return 0, 0
    one = int(mix(members * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64))
    two = int(mix(members ^ np.uint64(0x165667B19E3779F9)).sum(dtype=np.uint64))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (one & MASK, two & MASK))


def _sketches(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, least = [], [], []
            for members in shingle_sets(batch.column(2), n):
                sizes.append(len(members))
                hashes.append(set_hash(members))
                least.append(smallest_hashes(members))
            if not sizes:
                continue
            values = registers(np.array(least))
            keys = band_keys(values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array([h[0] for h in hashes], pa.int64()),
                    pa.array([h[1] for h in hashes], pa.int64()),
                    pa.array([v.tobytes() for v in values], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
                ],
                names=["place", "doc_id", "n", "h1", "h2", "registers", "bands"],
            )

    return sketch


# --- likelihood of a pair ----------------------------------------------------------------


def score_at(j: float, n_a, n_b, above, below) -> np.ndarray:
    """Slope of the joint log-likelihood of two sketches at similarity ``j``.

    ``above`` and ``below`` count registers in which the first is larger and
    smaller.  The likelihood is concave in j, so the slope is positive where
    the best estimate lies above ``j``.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    rate = (BASE - 1) / BASE

    def p(x):
        x = np.clip(x, 0.0, 1.0)
        return -np.log1p(-x * rate) / np.log(BASE), rate / ((1 - x * rate) * np.log(BASE))

    (up, d_up), (down, d_down) = p(u - v * j), p(v - u * j)
    equal = REGISTERS - above - below
    tiny = 1e-12
    return (
        -above * v * d_up / np.maximum(up, tiny)
        - below * u * d_down / np.maximum(down, tiny)
        + equal * (v * d_up + u * d_down) / np.maximum(1 - up - down, tiny)
    )


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: int) -> np.ndarray:
    """Whether the registers of pairs leave room for the similarity.

    A pair stays unless the best estimate lies below a similarity that is
    lower by ``SURE`` standard deviations.
    """
    j = similarity / 100
    low = j - SURE * np.sqrt(j * (1 - j) / REGISTERS)
    return score_at(low, n_a.astype(float), n_b.astype(float), (a > b).sum(axis=1), (a < b).sum(axis=1)) >= 0


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _keep_likely(similarity: int):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in batches:
            if len(pairs):
                a, b = _registers(pairs["reg_a"]), _registers(pairs["reg_b"])
                yield pairs.loc[likely(a, b, pairs["n_a"].to_numpy(), pairs["n_b"].to_numpy(), similarity), ["a", "b"]]

    return keep


def sizes_allow(n_a: Column, n_b: Column, similarity: int) -> Column:
    """Sets of these sizes can be that similar: the smaller one inside the larger."""
    return 100 * F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b)


# --- exact check -------------------------------------------------------------------------


def _compare(n: int, similarity: int):
    """Over rows (head, salt, member, is_member, text) sorted with the head's own text first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_set = None, None
        for batch in batches:
            heads, members, is_member = (batch.column(k).to_pylist() for k in (0, 2, 3))
            a, b = [], []
            for k, found in enumerate(shingle_sets(batch.column(4), n)):
                if not is_member[k]:
                    head, head_set = heads[k], found
                    continue
                if head != heads[k]:
                    raise ValueError("a member came before its head")
                common = len(np.intersect1d(head_set, found, assume_unique=True))
                if common and 100 * common >= similarity * (len(head_set) + len(found) - common):
                    a.append(head)
                    b.append(members[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Members of a head are dealt to salted groups; the head's text comes once
    per group, before its members.
    """
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_members"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("_members") / HEAD_ROWS)).cast("int")
    heads = heads.withColumn("_salts", salts)
    dealt = pairs.join(heads, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int"))
    members = dealt.join(texts, dealt["b"] == texts["id"]).select(
        "a", "_salt", "b", F.lit(True).alias("is_member"), "text"
    )
    own = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    own = own.join(texts, own["a"] == texts["id"]).select(
        "a", "_salt", F.col("a").alias("b"), F.lit(False).alias("is_member"), "text"
    )
    rows = members.unionByName(own).repartition("a", "_salt").sortWithinPartitions("a", "_salt", "is_member")
    return rows.mapInArrow(_compare(n, similarity), "a long, b long")


# --- the operator ------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked when their shingle sets share ``similarity`` per cent
    of their union; a component is named by its smallest doc_id, which stays.
    Documents with equal sets are one class from the start; a class is
    represented by one row, of its smallest doc_id, and known by the number of
    that row, as an id may come with several texts.  A pair at the threshold misses all 21
    bands with a chance of 5e-5, one at 0.9 of 2e-7; sizes and likelihood are
    checked before the full sets are.

    Defined cases: very long texts: all shingles, a piece of the text at a
    time; ties: the smallest id, then any of its rows; null or empty text: no shingles, linked with nothing; null
    doc_id: a row of its own, never linked; rows that repeat an id share their
    component if their texts are equal, and are linked each by its own text if
    not; an empty table gives no rows; other
    columns are ignored.
    """
    keyed, row = with_row_key(docs, "near-in")
    told = _told(keyed, row, n, similarity)
    return told.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def _told(keyed: DataFrame, row: str, n: int, similarity: int) -> DataFrame:
    """(place, row, doc_id, n_shingles, component_id, first_row) of every row; ``place`` is its key.

    Rows are numbered as their sketches are written.  ``first_row`` is the row
    that stands for the component, one of its smallest doc_id; null for rows
    that are never linked.
    """
    place = F.col(row).alias("place")
    rows = keyed.select(place, F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "place struct<file:string,row_index:long>, doc_id long, n long, h1 long, h2 long, registers binary, bands array<long>"
    sketched = rows.mapInArrow(_sketches(n), schema).withColumn("row", F.monotonically_increasing_id())
    sketched = stage(sketched, "sketches")
    filled = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "row", "registers", "bands")).alias("first")
    classes = filled.groupBy("h1", "h2", "n").agg(first)
    # equal sets have equal registers; below, a class goes by the number of its row
    classes = classes.select(
        "h1", "h2", "n", "first.doc_id", F.col("first.row").alias("id"), "first.registers", "first.bands"
    )
    classes = stage(classes, "classes")

    # buckets with more than one class
    banded = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    crowded = stage(banded.join(shared, "key"), "buckets")
    near = stage(crowded.select("id").distinct(), "near")
    sketches = classes.select("id", "n", "registers").join(near, "id")
    sketches = stage(sketches, "near-sketches")
    places = sketched.select("place", F.col("row").alias("id")).join(near, "id")
    texts = stage(rows.select("place", "text").join(places, "place").select("id", "text"), "near-texts")

    pairs = stage(hub_pairs(crowded, similarity), "proposed")
    links = stage(confirmed(candidates(pairs, sketches, similarity), texts, n, similarity), "links")
    found = stage(components(links), "components")
    open_ = stage(open_buckets(crowded, found, similarity), "open-buckets")
    if not open_.isEmpty():
        likeliest = stage(joining_pairs(open_, sketches, similarity), "likeliest")
        links = links.unionByName(stage(confirmed(likeliest, texts, n, similarity), "likeliest-links"))
        found = stage(components(links), "components")
        open_ = stage(open_buckets(crowded, found, similarity), "open-buckets")
    if not open_.isEmpty():
        links = links.unionByName(links_across(open_, sketches, texts, n, similarity))
        found = components(links)
    member = classes.select("h1", "h2", "n", "doc_id", "id").join(found, "id", "left")
    member = member.withColumn("component", F.coalesce("component", "id"))
    least = member.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("least"))
    member = member.join(least, "component").select(
        "h1", "h2", "n", F.col("least.doc_id").alias("component_id"), F.col("least.id").alias("first_row")
    )
    told = sketched.select("place", "row", "doc_id", "n", "h1", "h2").join(member, ["h1", "h2", "n"], "left")
    linked = F.col("doc_id").isNotNull()
    return told.select(
        "place",
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.when(linked, F.col("component_id")), F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("first_row")).alias("first_row"),
    )


def hub_pairs(crowded: DataFrame, similarity: int) -> DataFrame:
    """(a, b), each once: every bucket links its members to the one that meets most others.

    That member is the likely original of a group of copies.  There are no
    more pairs than rows in buckets.
    """
    meets = crowded.groupBy("id").agg(F.sum("members").alias("meets"))
    head = F.min(F.struct((-F.col("meets")).alias("rank"), "id", "n")).alias("head")
    heads = crowded.join(meets, "id").groupBy("key").agg(head)
    heads = heads.select("key", F.col("head.id").alias("a"), F.col("head.n").alias("n_a"))
    pairs = crowded.join(heads, "key").filter((F.col("id") != F.col("a")) & sizes_allow(F.col("n"), F.col("n_a"), similarity))
    return pairs.select("a", F.col("id").alias("b")).distinct()


def open_buckets(crowded: DataFrame, found: DataFrame, similarity: int) -> DataFrame:
    """Rows of buckets that hold several components: (key, id, n, component, block).

    A block is a part of a bucket of bounded rows and shingles, numbered by
    whether it is of the bucket's largest component, by the step of its set
    sizes, and by a hash.  Sizes of one step are within the similarity of
    each other, those two steps apart are not.
    """
    marked = crowded.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = marked.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_rows"))
    largest = parts.groupBy("key").agg(
        F.max_by("component", F.struct("_rows", -F.col("component"))).alias("_largest"), F.count(F.lit(1)).alias("_parts")
    )
    rows = marked.join(largest.filter("_parts > 1").select("key", "_largest"), "key")
    rows = rows.withColumn("_main", (F.col("component") == F.col("_largest")).cast("long"))
    # a step is a little wider than the similarity allows, so that rounding cannot put a pair two steps apart
    width = max(-math.log(similarity / 100) * (1 + 1e-9), 0.005)
    rows = rows.withColumn("_step", F.floor(F.log("n") / width))
    sizes = rows.groupBy("key", "_main", "_step").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("_chunks")
    )
    rows = rows.join(sizes, ["key", "_main", "_step"])
    return rows.select("key", "id", "n", "component", _block(F.pmod(F.xxhash64("id"), F.col("_chunks"))).alias("block"))


def _block(chunk: Column) -> Column:
    return (F.col("_main") * STEPS + F.col("_step")) * CHUNKS + chunk


def block_pairs(open_: DataFrame) -> DataFrame:
    """(key, block, _lo, _hi): the pairs of blocks that every block of a bucket goes to."""
    blocks = open_.select("key", "block").distinct()
    other = blocks.select("key", F.col("block").alias("_with"))
    main, step = (lambda c: F.floor(c / (STEPS * CHUNKS))), (lambda c: F.floor(c / CHUNKS) % STEPS)
    own, others = F.col("block"), F.col("_with")
    meet = (main(own) + main(others) < 2) & (F.abs(step(own) - step(others)) <= 1)
    pairs = blocks.join(other, "key").filter(meet)
    return pairs.select("key", "block", F.least(own, others).alias("_lo"), F.greatest(own, others).alias("_hi"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with (key, _lo, _hi) brought together and sorted by them."""
    group = ["key", "_lo", "_hi"]
    return rows.repartition(*group).sortWithinPartitions(*group)


def _with_registers(open_: DataFrame, sketches: DataFrame) -> DataFrame:
    dealt = open_.join(block_pairs(open_), ["key", "block"])
    rows = dealt.join(sketches.select("id", "registers"), "id")
    return _grouped(rows.select("key", "_lo", "_hi", F.col("block").alias("_own"), "id", "n", "component", "registers"))


def joining_pairs(open_: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """(a, b): per pair of blocks the likeliest pairs that would join its components, fewer than its rows."""
    rows = _with_registers(open_, sketches)
    return rows.mapInArrow(_in_groups(_likeliest(similarity)), "a long, b long").distinct()


def links_across(open_: DataFrame, sketches: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """Links (a, b) between components that share a bucket.

    Every pair of blocks is one group of a bounded size, whatever the bucket
    holds.  Sizes, registers and bands say which rows of a group have a likely
    partner; only their texts are brought in, and links that join what the
    group has not joined yet go out.
    """
    group = ["key", "_lo", "_hi"]
    schema = "key long, _lo long, _hi long, _own long, id long, n long, component long"
    rows = _with_registers(open_, sketches)
    partnered = stage(rows.mapInArrow(_in_groups(_with_partner(similarity)), schema), "partnered")
    rows = _grouped(partnered.join(texts, "id").select(*group, "_own", "id", "component", "text"))
    return stage(rows.mapInArrow(_in_groups(_linked(n, similarity)), "a long, b long").distinct(), "links-across")


def _in_groups(kernel):
    """A function for mapInArrow over rows sorted by their first three columns, a whole group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield from kernel(table.slice(a, b - a))
            held = table.slice(cuts[-1] if len(cuts) else 0)
        if held is not None and len(held):
            yield from kernel(held)

    return run


def _apart(table: pa.Table) -> np.ndarray:
    """(rows, rows): the first of two rows in order, from both blocks if there are two, of two components."""
    own, component = (table.column(k).to_numpy() for k in ("_own", "component"))
    if table.column("_lo")[0] != table.column("_hi")[0]:
        different = own[:, None] < own[None, :]
    else:
        different = np.triu(np.ones((len(own), len(own)), dtype=bool), 1)
    return different & (component[:, None] != component[None, :])


def _likely_pairs(table: pa.Table, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, equal registers) of the pairs of a group, of two components, that may be similar; a slice at a time.

    A pair that shares an earlier band too has met in that band's bucket.
    """
    size = table.column("n").to_numpy()
    smaller, larger = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    a, b = np.nonzero(_apart(table) & (100 * smaller >= similarity * larger))
    values = _registers(table.column("registers").to_pylist())
    keys = band_keys(values)
    band = int((keys[0] == table.column("key")[0].as_py()).argmax())
    for at in range(0, len(a), SLICE):
        i, j = a[at : at + SLICE], b[at : at + SLICE]
        new = ~(keys[i, :band] == keys[j, :band]).any(axis=1)
        i, j = i[new], j[new]
        keep = likely(values[i], values[j], size[i], size[j], similarity)
        i, j = i[keep], j[keep]
        yield i, j, (values[i] == values[j]).sum(axis=1)


def _with_partner(similarity: int):
    """The rows of a group that may be similar to one of another component."""

    def find(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        found = np.zeros(len(table), dtype=bool)
        for i, j, _ in _likely_pairs(table, similarity):
            found[i] = True
            found[j] = True
        if found.any():
            yield from table.select(list(range(7))).filter(pa.array(found)).combine_chunks().to_batches()

    return find


def _likeliest(similarity: int):
    """A forest over the components of a group: of the pairs that would join two, those with most equal registers."""

    def find(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        _, part = np.unique(table.column("component").to_numpy(), return_inverse=True)
        pairs = list(_likely_pairs(table, similarity))
        if not pairs:
            return
        i, j, equal = (np.concatenate([p[k] for p in pairs]) for k in range(3))
        # the best pair of every two components, then those that join trees
        order = np.argsort(-equal, kind="stable")
        i, j = i[order], j[order]
        both = np.minimum(part[i], part[j]).astype(np.int64) * (part.max() + 1) + np.maximum(part[i], part[j])
        first = np.sort(np.unique(both, return_index=True)[1])
        root = list(range(part.max() + 1))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        a, b = [], []
        for k in first:
            x, y = top(part[i[k]]), top(part[j[k]])
            if x != y:
                root[x] = y
                a.append(min(ids[i[k]], ids[j[k]]))
                b.append(max(ids[i[k]], ids[j[k]]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return find


def _linked(n: int, similarity: int):
    """Links of a group: full sets compared, one row against all it may be linked with at a time."""

    def find(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        texts = table.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        sets = list(shingle_sets(texts, n))
        sizes = np.array([len(s) for s in sets])
        # shingles as numbers; who holds which, sorted by shingle
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(number, kind="stable")
        by_shingle = holder[order]
        first = np.searchsorted(number[order], np.arange(number.max() + 2))
        ends = np.cumsum(sizes)
        apart = _apart(table)
        joined = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        a, b = [], []
        for i in range(len(sets)):
            mine = number[ends[i] - sizes[i] : ends[i]]
            spans = [by_shingle[first[k] : first[k + 1]] for k in mine]
            common = np.bincount(np.concatenate(spans), minlength=len(sets))
            near = apart[i] & (100 * common >= similarity * (sizes[i] + sizes - common))
            for j in np.flatnonzero(near):
                if joined[i] != joined[j]:
                    joined[joined == joined[j]] = joined[i]
                    a.append(ids[i])
                    b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return find


def candidates(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """The pairs that the likelihood of their registers leaves."""
    first = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("reg_a"))
    second = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("reg_b"))
    joined = pairs.join(first, "a").join(second, "b")
    return stage(joined.mapInPandas(_keep_likely(similarity), "a long, b long"), "candidates")


def keep_one_of_each(docs: DataFrame, n: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows whole, one of every group of near duplicates; rows without shingles or id stay."""
    keyed, row = with_row_key(docs, "near-in")
    told = _told(keyed, row, n, similarity)
    return without(keyed, row, told.filter("first_row != row").select("place"))
