import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from checking import connect, differences
from llm_cases import ASCII_LOWER, ROWS, no_documents, odd_documents, words
from pyspark.sql import functions as F

from headroom.llm import audit, divergence
from headroom.llm.queries import ORACLES, QUERIES

NO_LABELS = "doc_id long, quality int, toxic int"


# --- filters in every order ----------------------------------------------------------------


def failed(rows):
    """Per row, the letters of the filters it fails."""
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        text, w = text or "", words(text)
        fails = "A" if len(w) < 100 else ""
        fails += "B" if 100 * len(set(w)) < 80 * len(w) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        fails += "D" if re.search("[#$%&*|]", text) else ""
        fails += "E" if doc_id is not None and least[text] < doc_id else ""
        out.append(fails)
    return out


def audited(rows, labels):
    """{(part, order, step): counts}, document by document along each order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    counts, shapley = defaultdict(lambda: [0] * 6), Counter()
    orders = ["".join(p) for p in permutations("ABCDE")]
    for (doc_id, _, lang, *_), fails in zip(rows, failed(rows), strict=True):
        for order in orders:
            alive = True
            for step, letter in enumerate(order, 1):
                c = counts[lang or "", order, step]
                hit = letter in fails
                here = alive and hit
                for k, add in enumerate(
                    (alive and not hit, here, hit and not alive, fails == letter, here and doc_id in good, here and doc_id in toxic)
                ):
                    c[k] += add
                shapley[lang or "", letter] += here
                alive = alive and not hit
    return {(p, o, s): (*c, shapley[p, o[s - 1]]) for (p, o, s), c in counts.items()}


def test_filter_audit_equals_sql(spark, data_folder):
    df = QUERIES["op11_filter_audit"](spark, data_folder)
    assert differences(df, connect(data_folder), ORACLES["op11_filter_audit"]) == []


def test_filter_audit_odd_cases(spark):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [*[r[:3] for r in ROWS], (20, many, "en"), (21, many, None), (21, many, "en"), (None, many, "en"), (None, many, "fr")]
    rows += [(18, many, "fr"), (22, many + " 100% A", "fr"), (23, "A B C", "fr"), (24, "w " * 200, ""), (25, None, "fr"), (2, many, "")]
    labels = [(1, 1, 0), (2, 1, 1), (20, 0, 1), (20, 1, 0), (21, None, 1), (None, 1, 1), (99, 1, 1), (25, 1, None), (5, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("part", "mask", "hash", "n", "good", "_id", "_salt", "first", "least"):
        docs = docs.withColumn(name, docs["lang"])
    got = audit.audit_filters(docs, spark.createDataFrame(labels, NO_LABELS)).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_without_rows_or_labels(spark):
    none = spark.createDataFrame([], NO_LABELS)
    assert audit.audit_filters(no_documents(spark), none).count() == 0
    rows = audit.audit_filters(odd_documents(spark), none).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in rows} == audited([r[:3] for r in ROWS], [])


def test_any_filters_can_be_audited(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 2, 1), ("p", 3, 2, 0, 1), (None, 2, 1, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {tuple(r[:3]): tuple(r[3:]) for r in audit.filter_orders(cells, ["x", "y"]).collect()}
    assert got == {
        ("p", "xy", 1): (5, 5, 0, 3, 2, 2, 8), ("p", "xy", 2): (5, 0, 2, 0, 0, 0, 2),
        ("p", "yx", 1): (8, 2, 0, 0, 0, 1, 2), ("p", "yx", 2): (5, 3, 2, 3, 2, 1, 8),
        (None, "xy", 1): (1, 0, 0, 0, 0, 0, 0), (None, "xy", 2): (0, 1, 0, 1, 1, 1, 2),
        (None, "yx", 1): (0, 1, 0, 1, 1, 1, 2), (None, "yx", 2): (0, 0, 0, 0, 0, 0, 0),
    }
    with pytest.raises(ValueError, match="filters"):
        audit.filter_orders(cells, list("ABCDEFG"))


# --- sources of a language -----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def diverged(rows, least_documents, top):
    """All rows of the result, with Python's whole numbers."""
    counts, holders, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(ASCII_LOWER))
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            holders[lang, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        sources = sorted(s for own, s in groups if own == lang)
        kept = [t for own, t in holders if own == lang and holders[own, t] >= least_documents]
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}

        def share(own, t, kept=kept):
            return 1 + 1_000_000_000 * (own[t] + 5) // (sum(own.values()) + 5 * len(kept))

        for s in sources:
            pairs = [(sum(abs(share(n[s], t) - share(n[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(share(n[s], t) - share(whole, t), t) for t in kept if n[s][t] and share(n[s], t) > share(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def test_divergence_equals_sql(spark, data_folder):
    df = QUERIES["op12_source_divergence"](spark, data_folder)
    assert differences(df, connect(data_folder), ORACLES["op12_source_divergence"]) == []


@pytest.mark.parametrize("least_documents, bits", [(1, 15), (2, 1), (30, 15)])
def test_divergence_odd_cases(spark, monkeypatch, least_documents, bits):
    monkeypatch.setattr(divergence, "RANGE_BITS", bits)
    rng = np.random.default_rng(8)
    vocabulary = ["One", "two", "TWO", "thréé", "Éa", "x1y", "日本", "a\x00b", "z_z", "  ", "7"]
    rows = [(r[1], r[2], r[3]) for r in ROWS]
    for _ in range(60):
        text = " ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), rng.integers(0, 9)))
        rows.append((text, ["en", "fr", None, ""][rng.integers(4)], ["a", "b", "é", "hot", "hot", None][rng.integers(6)]))
    rows += [(None, "xx", "only"), ("", "yy", "a"), (None, "yy", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(c) for c in ("term", "n", "id", "kept", "total", "part", "item", "a", "b", "range", "doc_id")})
    got = divergence.source_divergence(docs, least_documents, 3).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == diverged(rows, least_documents, 3)
    assert divergence.source_divergence(no_documents(spark)).count() == 0


def test_counts_are_handed_on_and_long_texts_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 100)
    found = divergence.term_counts(odd_documents(spark)).collect()
    wanted, holders = Counter(), Counter()
    for _, text, lang, source in ROWS:
        terms = TERM.findall((text or "").translate(ASCII_LOWER))
        wanted.update((lang or "", source or "", t) for t in terms)
        holders.update((lang or "", source or "", t) for t in set(terms))
    assert {tuple(r[:3]): (r["n"], r["documents"]) for r in found} == {k: (n, holders[k]) for k, n in wanted.items()}


def test_galloping_finds_what_is_common():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(0, size))) for size in rng.choice([1, 5, 90, 2500], 2))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_shares_are_exact(spark):
    rows = [(0, 0, 1), (1, 3, 7), (9 * 10**14, 9 * 10**15, 10**6), (10**15 - 1, 10**15, 3), (4, 4, 1)]
    df = spark.createDataFrame(rows, "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * kept) for n, total, kept in rows]
    assert got == [int(divergence.shares(np.array([n]), total, kept)[0]) for n, total, kept in rows]
