import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from checking import connect, differences
from llm_cases import ROWS, no_documents, odd_documents, words
from pyspark.sql import functions as F

from headroom.llm import chat, common, mixing, sharding
from headroom.llm.queries import ORACLES, QUERIES

# --- chats ---------------------------------------------------------------------------------


def test_chat_query_equals_sql(spark, data_folder):
    assert differences(QUERIES["op7_chat"](spark, data_folder), connect(data_folder), ORACLES["op7_chat"]) == []


def test_chats_read_back(spark):
    texts = ["", "a<b>", r"\### Assistant: </turn> ok", "\\n\\l\\\\b", "<next>", "</turn>\n<turn user>\n", "x\ny", None, "é🙂"]
    rng = np.random.default_rng(3)
    roles = ["user", "assistant", "sys>tem\n", "", None]
    rows = [(c, t, roles[rng.integers(5)], texts[rng.integers(len(texts))], "k") for c in range(30) for t in range(rng.integers(1, 9))]
    rows += [(None, 1, "user", "no id", "k"), (7, None, "user", "no turn", "k"), (8, 0, "user", "x", "k"), (8, 0, "user", "x", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    wanted = defaultdict(list)
    for c, t, role, text, _ in rows:
        wanted[c].append((t is not None, t, role or "", text or ""))
    wanted = {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: (v[0], v[1] or 0, v[2], v[3]))] for c, v in wanted.items()}
    read = chat.read_chats(chat.format_chats(df))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read.collect()} == wanted
    for r in chat.chat_digests(read).collect():
        turns = wanted[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_runs_of_a_role_are_one_block(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = chat.format_chats(df).first()["formatted"]
    assert text == "<turn user>\na<next>b</turn>\n<turn assistant>\nc</turn>\n"


# --- shards --------------------------------------------------------------------------------


def size_of(text):
    return len((text or "").encode()) + 16


def check_shards(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (repr(i), size_of(t), zlib.crc32((t or "").encode())) for i, t in texts
    )
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(0 <= s < shards for s in by)
    return {s: sum(r["size"] for r in rows) for s, rows in by.items()}


def test_sharding_query(spark, data_folder):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{data_folder}/documents.parquet'").fetchall()
    rows = QUERIES["op3_sharding"](spark, data_folder).collect()
    sizes = check_shards(rows, texts, 40)
    mean, largest = sum(sizes.values()) / 40, max(size_of(t) for _, t in texts)
    assert all(abs(sizes.get(s, 0) - mean) <= largest for s in range(40))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_the_fewest_bytes_move(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(1, 60)), f"part-{int(k):02d}") for i, k in enumerate(rng.choice(5, 600, p=[0.5, 0.2, 0.2, 0.05, 0.05]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string")
    plan = sharding.plan_reshard(df, "file", 4, block_rows=50)
    got = plan.collect()
    sizes = check_shards(got, [r[:2] for r in rows], 4)
    old = Counter()
    for _, text, file in rows:
        old[int(file[-2:])] += size_of(text)
    total = sum(old.values())
    assert all(abs(s - total / 4) <= 5 * 76 for s in sizes.values())
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    least = sum(max(0, n - total // 4) if k < 4 else n for k, n in old.items())
    assert abs(moved - least) <= 8 * 76
    affected = {r["shard"] for r in sharding.affected_shards(plan).collect()}
    assert affected == {0, 1, 2, 3, 4}  # the last one is gone


def cheapest(old, capacities):
    """Fewest units moved, by trying every whole flow."""
    best = [10**9]

    def send(i, room, cost):
        if cost >= best[0]:
            return
        if i == len(old):
            best[0] = cost
            return

        def split(j, left, room, cost):
            if j == len(room) - 1:
                if left <= room[j]:
                    send(i + 1, [*room[:j], room[j] - left], cost + left * (i != j))
                return
            for part in range(min(left, room[j]) + 1):
                split(j + 1, left - part, [*room[:j], room[j] - part, *room[j + 1 :]], cost + part * (i != j))

        split(0, old[i], room, cost)

    send(0, list(capacities), 0)
    return best[0]


@pytest.mark.parametrize("seed", range(8))
def test_transfers_are_a_cheapest_flow(seed):
    rng = np.random.default_rng(seed)
    old = rng.integers(0, 6, rng.integers(1, 4)).tolist()
    cuts = np.sort(rng.integers(0, sum(old) + 1, 2))
    capacities = np.diff([0, *cuts, sum(old)]).tolist()
    ranges = sharding.solve_transfers(old, capacities)
    for i, size in enumerate(old):
        own = sorted((a, b) for o, _, a, b in ranges if o == i)
        assert [a for a, _ in own] == [0, *[b for _, b in own]][: len(own)] and sum(b - a for a, b in own) == size
    for j, room in enumerate(capacities):
        assert sum(b - a for _, n, a, b in ranges if n == j) == room
    assert sum(b - a for o, n, a, b in ranges if o != n) == cheapest(old, capacities)
    assert len(ranges) <= len(old) + len(capacities) + len(old)


def test_sharding_odd_cases(spark, tmp_path):
    docs = odd_documents(spark).withColumn("file", F.when(F.col("doc_id") < 8, F.concat(F.lit("f"), F.col("doc_id") % 3)))
    plan = sharding.plan_reshard(docs, "file", 3)
    check_shards(plan.collect(), [r[:2] for r in ROWS], 3)
    assert sharding.plan_reshard(no_documents(spark).withColumn("file", F.lit("f")), "file", 3).count() == 0


def test_rewrite_affected(spark, tmp_path):
    rows = [(i, "x" * 10, "a" if i < 50 else "b") for i in range(100)] + [(100 + i, "y" * 10, "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    plan = sharding.plan_reshard(docs, "file", 3)
    assert sharding.affected_shards(plan).count() == 0  # already equal
    wider = sharding.plan_reshard(docs, "file", 4)
    sharding.rewrite_affected(docs, wider, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    wanted = {(r["doc_id"], r["shard"], r["slot"]) for r in wider.collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in written.collect()} == wanted


def test_reshard_keeps_null_and_repeated_ids(spark, tmp_path):
    """Several null ids, one id with several texts and rows repeated whole: every row once, in the files too."""
    rows = [(None if i % 5 == 0 else i % 7, "x" * (i % 11), "ab"[i > 40]) for i in range(120)]
    rows += [(3, "same", "a")] * 6 + [(None, None, "b")] * 3
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "doc_id long, text string, file string")
    df.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sharding.reshard(docs, "file", 3, "at", block_rows=20).collect()
    check_shards(got, [r[:2] for r in rows], 3)
    plan = sharding.plan_reshard(docs, "file", 3, row="at")
    sharding.rewrite_affected(docs, plan, str(tmp_path / "out"), "at")
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in written) == Counter(r[:2] for r in rows)
    with pytest.raises(ValueError, match="row key"):
        sharding.rewrite_affected(docs, plan, str(tmp_path / "no"))


def test_shards_that_stay_are_read_from_their_old_files(spark, tmp_path):
    rows = [(i, "x" * 10, "a") for i in range(30)] + [(i, "y" * 10, "b") for i in range(20)] + [(i, "z" * 10, "c") for i in range(40)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, file string").withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sharding.reshard(docs, "file", 3, "at").collect()
    check_shards(got, [r[:2] for r in rows], 3)
    assert {(r["old_shard"], r["shard"]) for r in got} == {(0, 0), (1, 1), (2, 1), (2, 2)}


def test_sharding_query_writes_its_shards(spark, data_folder):
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "headroom"
    before = set(folder.glob("shards-*"))
    rows = QUERIES["op3_sharding"](spark, data_folder).collect()
    (path,) = set(folder.glob("shards-*")) - before
    files = spark.read.parquet(str(path)).collect()
    shards = {r["shard"] for r in files}
    wanted = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows if r["shard"] in shards)
    assert Counter((r["doc_id"], size_of(r["text"]), zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in files) == wanted
    assert {r["old_shard"] for r in rows if r["shard"] not in shards} <= {r["shard"] for r in rows} - shards


# --- mixing --------------------------------------------------------------------------------


def targets_of(sizes):
    """The rule in plain steps, for sources in order."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    fixed, left = {}, 1.5 * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: (left - sum(fixed.values())) * weights[i] / sum(weights[k] for k in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: 2.0 * sizes[i] for i in over}


def check_mix(rows, docs, tolerance):
    source_sizes = Counter()
    for _, text, source in docs:
        source_sizes[source] += len(words(text))
    names = sorted((s for s in source_sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in source_sizes)
    targets = dict(zip(names, targets_of([source_sizes[s] for s in names]), strict=True))
    assert len(rows) == len(docs)
    source_of = {i: s for i, _, s in docs}
    size_of = {i: len(words(t)) for i, t, _ in docs}
    taken = Counter()
    for r in rows:
        s = source_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size_of[r["doc_id"]], source_sizes[s])
        assert r["target"] == pytest.approx(targets[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - targets[s]) <= tolerance
    return taken


def test_mixing_query(spark, data_folder):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{data_folder}/documents.parquet'").fetchall()
    rows = QUERIES["op6_mixing"](spark, data_folder).collect()
    check_mix(rows, docs, 2 * mixing.BLOCK_WORDS)
    assert sorted(rows) == sorted(QUERIES["op6_mixing"](spark, data_folder).collect())


def test_mixing_odd_cases(spark):
    rows = mixing.taken_words(mixing.plan_mix(odd_documents(spark), block_words=2, shards=5)).collect()
    check_mix(rows, [(r[0], r[1], r[3]) for r in ROWS], 4)
    assert mixing.taken_words(mixing.plan_mix(no_documents(spark))).count() == 0


def test_mixed_documents_hold_what_is_taken(spark):
    docs = odd_documents(spark)
    taken = mixing.taken_words(mixing.plan_mix(docs, block_words=16, shards=3))
    wanted = {r[0]: r[1] for r in taken.groupBy("doc_id").sum("taken").collect()}
    mixed = mixing.mixed_documents(docs, block_words=16, shards=3)
    assert mixed.columns == docs.columns
    got, texts = Counter(), defaultdict(set)
    for r in mixed.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        texts[r["doc_id"]].add(r["text"])
        assert r["n_chars"] == len(r["text"]) and r["gone"] == "gone"
    assert got == {i: n for i, n in wanted.items() if n}
    for doc_id, text, *_ in ROWS:
        for part in texts[doc_id]:
            assert set(words(part)) <= set(words(text))
    assert mixing.mixed_documents(no_documents(spark)).count() == 0


@pytest.mark.parametrize("number", [1, 2, 3, 7, 10, 97, 1000, 4099])
def test_permutations(spark, number):
    width = int(np.ceil(np.sqrt(number)))
    df = spark.range(number).select(
        "id", F.lit(0).alias("_source"), F.lit(number).cast("long").alias("_number"),
        F.lit(width).cast("long").alias("_width"), F.lit(-(-number // width)).cast("long").alias("_height"),
    )
    got = [r[0] for r in mixing.permuted(df, "id", "to", 5).orderBy("id").select("to").collect()]
    assert sorted(got) == list(range(number)) and (number < 10 or got != sorted(got))


def test_draws_add_up():
    quotas = [0, 5, 1000, 17, 123456]
    counts = mixing.draw_counts(quotas, 16, 1)
    assert (counts >= 0).all() and counts.sum(axis=0).tolist() == quotas
    assert (counts[:, 4] > 0).all()


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.integers(4)}", int(rng.integers(0, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = common.running_totals(df, ["k"], ["id"], {"before": F.col("v"), "at": F.lit(1)}, 7).collect()
    by = defaultdict(list)
    for r in got:
        by[r["k"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["at"])
        assert [r["at"] for r in rows] == list(range(len(rows)))
        assert [r["before"] for r in rows] == [0, *np.cumsum([r["v"] for r in rows])[:-1]]
