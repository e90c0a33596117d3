"""Ranked search, hard negatives and decontamination against plain versions, with odd rows, ties and crowded groups."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, dualtree, ranked, terms
from evalspark.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i * i % 977}" for i in range(60_000))
DOCS = [
    (1, None), (2, ""), (3, " .,; \n"), (4, "one two three"), (4, "one two three"), (5, "One, TWO; three four-five six seven eight nine ten eleven twelve"), (5, "another text of the same id one two"),
    (None, "no id here one two three"), (6, LONG), (7, "Ünï日本 x_y ünï日本 🎉 Ä"), (8, "a b c d e f g h i j k l m a b c d e f g h i j"), (9, "twelve one two three four five six seven eight nine ten"),
]
ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "... ! "), (4, "three"), (5, "A b C d"), (6, "a b c d e f g h i j"), (6, "b c d e f g h i j k"), (7, "one two three four five six seven eight nine ten eleven"),
    (None, "six seven eight"), (10, "ünï日本 🎉"), (11, "w0 w1 w4 w9 w16 w25 w36 w49 w64 w81 w100"), (12, "nowhere to be found"), (12, "nowhere to be found"),
]
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def crowd(seed=3):
    """Documents of four vocabularies, a third of them copies of one text, and items cut from them."""
    rng = np.random.default_rng(seed)
    vocabulary = [[f"{p}{i}" for i in range(60)] for p in "abcd"]
    texts = [" ".join(rng.choice(vocabulary[i % 4], rng.integers(5, 60))) for i in range(400)]
    texts += [texts[17]] * 200
    items = [" ".join(t.split()[3:20]) for t in texts[:40]] + [texts[17]] * 20 + [f"{texts[1]} {texts[2]}"]
    return [(i, t) for i, t in enumerate(texts)], [(i, t) for i, t in enumerate(items)]


def plain_hits(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        yield d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("case", ["odd", "crowd"])
def test_decontamination_against_all_windows(spark, monkeypatch, case):
    docs, items = (DOCS, ITEMS) if case == "odd" else crowd()
    monkeypatch.setattr(decontaminate, "LISTED", 2)
    d, b = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM)
    d, b = (t.withColumns({c: F.lit("x") for c in ("row", "shingle", "window", "words")}) for t in (d, b))
    got = sorted(map(repr, map(tuple, decontaminate.contaminated(d, b).collect())))
    assert got == sorted(map(repr, plain_hits(docs, items)))


def plain_ranking(docs, items, k=10):
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    for i, words in sorted({(i, tuple(sorted(split(t)))) for i, t in items}, key=repr):
        scores = []
        for d, c, n in counted:
            m = 100 - 75 + 75 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1):
            yield i, rank, d, -s


@pytest.mark.parametrize("case", ["odd", "crowd"])
def test_ranking_against_all_documents(spark, monkeypatch, case):
    """With small shards and one shard at first, several rounds of visits are needed."""
    docs, items = (DOCS, ITEMS) if case == "odd" else crowd()
    monkeypatch.setattr(ranked, "SHARD", 16)
    monkeypatch.setattr(ranked, "CHUNK", 8)
    got = ranked.search(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), depth=4, first=1).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_ranking(docs, items)))


def test_ranking_tells_terms_of_one_hash_apart(spark, monkeypatch):
    true = terms.hashes

    def narrow(items, seed=0):
        return true(items, seed) % np.uint64(64) if seed == 0 else true(items, seed)

    monkeypatch.setattr(terms, "hashes", narrow)
    monkeypatch.setattr(ranked, "hashes", narrow)
    docs, items = crowd()
    got = ranked.search(spark.createDataFrame(docs[:60], DOC), spark.createDataFrame(items[:5], ITEM)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_ranking(docs[:60], items[:5])))


def test_bisection_parts_vocabularies():
    """Documents of four vocabularies end in leaves of one vocabulary each, also such as the fit has not seen."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)) + 40 * (i % 4) for i in range(800)]
    flat, offsets = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    seen = offsets[:401]
    model = ranked.bisect(flat[: seen[-1]], seen, 2, 256)
    leaf = ranked.place(*model, flat, offsets)
    kinds = [Counter(leaf[i::4].tolist()).most_common(1)[0] for i in range(4)]
    assert len({k for k, _ in kinds}) == 4 and all(n > 190 for _, n in kinds)


def vectors(seed=2, n=900, d=8):
    """Tight clusters, a label that a third of the rows has, and a vector that many rows share."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, d))[np.arange(n) % 12] + 0.1 * rng.normal(size=(n, d))
    x[1::3] = x[1]
    labels = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 5, n))
    return [(10 * i, x[i].tolist(), int(labels[i])) for i in range(n)]  # ids of odd rows repeat some of them


ODD = [(1, None, 1), (200, [0.0] * 8, 2), (300, [0.1] * 7 + [None], 2), (400, [0.1] * 7 + [float("nan")], 2), (500, [0.1] * 7 + [float("inf")], 2), (600, [0.1] * 8, None), (None, [0.1] * 8, 1), (7_000_000, [0.5] * 8, 9), (7_000_000, [0.5] * 8, 9), (8_000_100, [-0.5] * 8, 9)]


def plain_negatives(rows):
    t = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * c) for c in x)) for i, x, lab in rows if i is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)}
    for a, label, x in t:
        if a % 100 == 0:
            scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, other, y in t if i != a))
            for s, p, _ in [r for r in scored if r[2] == label][:5]:
                fits = [(-r[0], r[1]) for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
                for rank, (score, i) in enumerate(fits, 1):
                    yield a, p, rank, i, -s, score


@pytest.mark.parametrize("d", [8, 24])
def test_negatives_against_all_rows(spark, monkeypatch, d):
    monkeypatch.setattr(dualtree, "PART", 32)
    monkeypatch.setattr(dualtree, "CHUNK", 16)
    rows = vectors(d=d) + (ODD if d == 8 else [])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = dualtree.mine(table, label=dualtree.shifted_label(), leaf=16).collect()
    assert sorted(map(tuple, got)) == sorted(plain_negatives(rows)) and len(got) > 100


def test_walk_prunes_groups_and_keeps_every_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 6))[np.arange(2000) % 8] * 5 + 0.1 * rng.normal(size=(2000, 6))
    y = x[:200] + 0.1 * rng.normal(size=(200, 6))
    a, b = dualtree.fit(y, 8, 6, 0), dualtree.fit(x, 32, 6, 0)
    for tree, rows in ((a, y), (b, x)):
        leaf, reach = dualtree.descend(tree, rows)
        tree.radii = np.full(2 * tree.leaves - 1, -1.0)
        for i, at in enumerate(leaf + tree.leaves - 1):
            for level in range(reach.shape[1] - 1, -1, -1):
                tree.radii[at] = max(tree.radii[at], reach[i, level])
                at = (at - 1) // 2
    own, other = dualtree.descend(a, y)[0], dualtree.descend(b, x)[0]
    scores = y @ x.T
    floor = np.full(a.leaves, np.inf)
    np.minimum.at(floor, own, np.sort(scores, axis=1)[:, -5])
    i, j = dualtree.walk(a, b, floor, np.full(a.leaves, np.inf))
    met = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(met) == len(i) < a.leaves * b.leaves / 2
    for r, c in zip(*np.nonzero(scores >= floor[own][:, None]), strict=True):
        assert (own[r], other[c]) in met


def test_query_of_negatives_against_its_sql(spark, tmp_path):
    odd = [r for r in ODD if r[0] not in (200, 7_000_000)]  # SQL tells rows apart by their ids
    table = spark.createDataFrame(vectors(seed=6) + odd, "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES["op12_dualtree"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op12_dualtree']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_products_beyond_doubles_are_exact():
    x, y = np.array([[2.0**29, 3.0]]), np.array([[2.0**29, 1.0]])
    assert dualtree._products(x, y)[0, 0] == 2**58 + 3
    with pytest.raises(ValueError):
        dualtree._products(x * 8, y * 8)


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    docs, items = spark.createDataFrame(DOCS, DOC), spark.createDataFrame(ITEMS, ITEM)
    assert ranked.search(no_docs, items).count() == ranked.search(docs, no_items).count() == ranked.search(no_docs, no_items).count() == 0
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(docs, no_items).where("contaminated or n_hit > 0").count() == 0
    schema = "vec_id long, embedding array<float>, label int"
    assert dualtree.mine(spark.createDataFrame([], schema)).count() == 0
    assert dualtree.mine(spark.createDataFrame([(1, [1.0], 0), (2, [0.5], 1)], schema)).count() == 0
