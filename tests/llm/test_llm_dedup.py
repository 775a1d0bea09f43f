import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from checking import connect, differences
from llm_cases import ASCII_LOWER, ROWS, documents, near_components, no_documents, odd_documents
from pyspark.sql import functions as F

from headroom.llm import common, exact, graph, neardup
from headroom.llm.queries import ORACLES, QUERIES


def test_exact_query_equals_sql(spark, data_folder):
    df = QUERIES["op8_exact_dedup"](spark, data_folder)
    assert differences(df, connect(data_folder), ORACLES["op8_exact_dedup"]) == []


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_odd_cases(spark, keep):
    got = exact.exact_duplicates(odd_documents(spark), keep).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[(text or "").translate(ASCII_LOWER)].append(doc_id)
    wanted = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        wanted += [(i, best, len(ids), i == best, digest) for i in ids]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_exact_keeps_texts_apart_that_share_a_hash(spark, monkeypatch):
    md5 = F.md5
    monkeypatch.setattr(exact.F, "md5", lambda c: md5(F.substring(c, 1, 1)))
    rows = [(1, "ab"), (2, "ac"), (3, "AB"), (4, "b"), (5, "ac"), (6, "ac")]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "largest")
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got.collect()} == {
        1: (3, 2), 2: (6, 3), 3: (3, 2), 4: (4, 1), 5: (6, 3), 6: (6, 3)
    }


def test_exact_drop_and_empty(spark):
    docs = odd_documents(spark)
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    left_ids = sorted(r["doc_id"] or 0 for r in left.collect())
    assert left_ids == [0, 3, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16]
    assert exact.exact_duplicates(no_documents(spark)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    wanted = {v: root(v) for e in edges if e[0] != e[1] for v in e}
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(wanted) and {r["id"]: r["component"] for r in got} == wanted


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def wanted_rows(rows):
    sizes, parts = near_components(rows)
    return sorted(
        ((i, n, c, i == c) for (i, _), n, c in zip(rows, sizes, parts, strict=True)), key=repr
    )


def test_near_query_equals_brute_force(spark, data_folder):
    got = QUERIES["op2_near_dedup"](spark, data_folder)
    assert rows_of(got) == wanted_rows(list(documents(data_folder).items()))


def test_near_odd_cases(spark):
    wanted = wanted_rows([(r[0], r[1]) for r in ROWS])
    wanted = [(i, n, c, True) if i is None else (i, n, c, k) for i, n, c, k in wanted]
    assert rows_of(neardup.near_duplicates(odd_documents(spark))) == sorted(wanted, key=repr)
    assert neardup.near_duplicates(no_documents(spark)).count() == 0


def test_near_chains_and_groups(spark):
    """Copies that drift apart, a large group, and a passage that many share."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [str(w) for w in rng.choice(vocabulary, 120)]
    rows, chain = [], base
    for i in range(25):
        chain = list(chain)
        chain[int(rng.integers(len(chain)))] = f"c{i}"
        rows.append((1000 + i, " ".join(chain)))
    for i in range(60):
        copy = list(base)
        for k in rng.integers(len(base), size=2):
            copy[int(k)] = f"x{i}"
        rows.append((10 + i, " ".join(copy)))
    passage = " ".join(str(w) for w in rng.choice(vocabulary, 60))
    for i in range(40):
        own = " ".join(str(w) for w in rng.choice(vocabulary, 12 + i % 9))
        rows.append((3000 + i, f"{own} {passage}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(df)) == wanted_rows(rows)


def test_blocks_of_a_bucket_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):  # copies about as far from each other as the threshold
        copy = list(base)
        for k in rng.choice(len(base), rng.integers(1, 3), replace=False):
            copy[int(k)] = f"x{rng.integers(6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = wanted_rows(rows)
    assert 1 < len({r[2] for r in wanted}) < 80
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 10)
    assert rows_of(neardup.near_duplicates(df)) == wanted


def test_keep_one_of_each(spark):
    docs = odd_documents(spark)
    left = neardup.keep_one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert None in ids and {1, 4, 5, 6, 10}.issubset(ids) and not {2, 3, 11} & set(ids)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 6000).astype(np.uint64)
    a, b = np.unique(pool[:4000]), np.unique(pool[1000:5000])
    ra, rb = (neardup.registers(neardup.smallest_hashes(x)) for x in (a, b))
    both = neardup.registers(neardup.smallest_hashes(np.union1d(a, b)))
    assert (neardup.merged(ra, rb) == both).all()
    above, below = np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()])
    sizes = np.array([float(len(a))]), np.array([float(len(b))])
    # the similarity is 0.6; the slope changes its sign near it
    assert neardup.score_at(0.40, *sizes, above, below)[0] > 0 > neardup.score_at(0.80, *sizes, above, below)[0]


def test_bands_find_similar_sets():
    rng = np.random.default_rng(2)
    found = 0
    for _ in range(200):
        common = rng.integers(0, 2**63, 170).astype(np.uint64)
        sets = [np.unique(np.r_[common, rng.integers(0, 2**63, 15).astype(np.uint64)]) for _ in range(2)]
        keys = neardup.band_keys(np.array([neardup.registers(neardup.smallest_hashes(s)) for s in sets]))
        found += bool((keys[0] == keys[1]).any())
    assert found == 200


def test_near_classes_of_one_id(spark):
    """An id with two texts: each is linked by its own text, whichever comes first."""
    one, two, three = ([f"{w}{k}" for k in range(60)] for w in ("a", "b", "c"))
    rows = [(9, one), (9, two), (9, three), (3, [*one, "x"]), (20, [*two, "y"]), (30, [*three, "z"]), (31, [*three, "z", "q"])]
    wanted = Counter({(9, 58, 3): 1, (3, 59, 3): 1, (9, 58, 9): 2, (20, 59, 9): 1, (30, 59, 9): 1, (31, 60, 9): 1})
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in order], "doc_id long, text string")
        got = neardup.near_duplicates(df).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == wanted
        left = neardup.keep_one_of_each(df).collect()
        assert Counter(r["text"] for r in left) == Counter(" ".join(w) for w in ([*one, "x"], two, three))


def test_exact_drop_keeps_texts_of_null_ids(spark):
    rows = [(None, "a b"), (1, "A b"), (None, "only here"), (None, None)]
    left = exact.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"] or "") for r in left) == ["", "A b", "only here"]


def test_row_keys_are_of_rows(spark, tmp_path):
    """Straight from files a row is its place; rows that a plan multiplies are told apart too."""
    path = str(tmp_path / "in")
    spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text")).write.parquet(path)
    files = spark.read.parquet(path)
    double = files.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    for docs in (files, double, files.unionByName(files), files.crossJoin(spark.range(2))):
        keyed, row = common.with_row_key(docs, "keys")
        assert keyed.select(row).distinct().count() == docs.count()
        assert keyed.drop(row).columns == docs.columns
