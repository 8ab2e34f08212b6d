"""Ranked lexical search against plain scoring of every document."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from docspark.llm import ball_tree_search as bts

SF = "/root/testdata/sf0.001"
TERM = re.compile(bts.TERM)
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("rank", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("doc_id", T.StringType())])


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, split(t)) for i, t, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(len(b) for _, b in bags)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(split(t))
    out = set()
    for item, terms in asked.items():
        found = []
        for i, bag in bags:
            m, score = 50 + (50 * len(bag) * n_docs) // total, 0
            for t in terms & set(bag):
                df = sum(t in set(b) for _, b in bags)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                tf = bag.count(t)
                score += w * ((10 ** 9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(found[:k])}
    return out


def rows(frame):
    got = [tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in frame.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def hard_docs():
    random = np.random.Generator(np.random.PCG64(3))
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "中文", "ab", "AB", "x9"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    docs = [(i, " ".join(random.choice(vocabulary, random.integers(1, 40), p=weights / weights.sum())), "s", "r") for i in range(300)]
    docs += [(400, None, "", ""), (401, "", "", ""), (402, " -- ..", "", ""), (None, "w1 w2 ab", "", ""),
             (403, "w50 " * 5000 + "w1", "", "")]
    # Ties: the same text under many ids, out of order, and repeated rows.
    return docs + [(900 - i, "w3 w40 AB", "", "") for i in range(90)] + [docs[5]] * 3


ASKED = [(1, "w1 w2, W3 w3", "x"), (2, "w40 ab", None), (3, None, "x"), (4, "...", "x"), (None, "É 中文", "x"),
         (5, "nowhere", "x"), (2, "x9", "x"), (6, " ".join(f"w{i}" for i in range(60)), "x"), (1, "w1 w2, W3 w3", "x")]


@pytest.mark.parametrize("block_terms,k", [(bts.BLOCK_TERMS, 50), (20, 50), (bts.BLOCK_TERMS, 7)])
def test_against_brute_force(spark, block_terms, k):
    docs = spark.createDataFrame(hard_docs(), DOCS).repartition(3)
    items = spark.createDataFrame(ASKED, ITEMS)
    assert rows(bts.lexical_search(docs, items, k, block_terms)) == brute(hard_docs(), ASKED, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(hard_docs()[:9], DOCS), spark.createDataFrame(ASKED, ITEMS)
    none = spark.createDataFrame([], DOCS)
    assert rows(bts.lexical_search(none, items)) == set()
    assert rows(bts.lexical_search(docs, items.limit(0))) == set()
    assert rows(bts.lexical_search(spark.createDataFrame([(1, None, "", "")], DOCS), items)) == set()


def test_same_as_sql_on_given_tables(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    expected = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({bts.SQL})").fetchall()
    got = rows(bts.lexical_search(*[spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark")]))
    assert len(expected) > 100 and got == set(expected)


def random_tree(seed=1, n=500, v=200):
    random = np.random.Generator(np.random.PCG64(seed))
    sizes = random.integers(1, 20, n)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    term = np.concatenate([np.sort(random.choice(v, s, replace=False)) for s in sizes])
    value = random.integers(1, 900_000, len(term))
    weight = random.integers(1, 9000, v)
    group = bts._groups(np.bincount(term, minlength=v))
    return bounds, term, value, weight, group


def test_bounds_hold_for_every_subtree():
    bounds, term, value, weight, group = random_tree()
    tree = bts.BallTree(bounds, term, value, weight, group)
    root = np.sqrt(weight.astype(float))
    dense = np.zeros((len(bounds) - 1, len(weight)), dtype=np.int64)
    for d in range(len(dense)):
        dense[d, term[bounds[d]:bounds[d + 1]]] = value[bounds[d]:bounds[d + 1]]
    for numbers in (np.array([0, 5, 90]), np.arange(200), np.array([199])):
        ceiling = tree.ceilings(numbers, root, group)
        exact = dense[:, numbers] @ weight[numbers]
        for node in range(len(tree.start)):
            assert exact[tree.order[tree.start[node]:tree.end[node]]].max() <= ceiling[node]


def test_search_prunes_given_documents(spark):
    """For the best 50 of the given documents most leaves are not scored."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    number = {t: i for i, t in enumerate(sorted({t for _, x in items for t in split(x)}))}
    bags = [{t: c for t, c in Counter(split(x)).items() if t in number} for _, x in docs]
    bags = [b for b in bags if b]
    sizes = np.array([len(b) for b in bags])
    term = np.array([number[t] for b in bags for t in sorted(b, key=number.get)])
    count = np.array([b[t] for b in bags for t in sorted(b, key=number.get)])
    df = np.bincount(term, minlength=len(number))
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * int(d) + 1))) for d in df])
    value = bts.saturated(count, np.repeat(sizes, sizes), len(docs), int(sizes.sum()))
    group, root = bts._groups(df), np.sqrt(weight.astype(float))
    tree = bts.BallTree(np.append(0, np.cumsum(sizes)), term, value, weight, group)
    leaves = sum(c < 0 for c in tree.left)
    ids, null = np.arange(len(bags)), np.zeros(len(bags), dtype=bool)
    scored = []
    for _, text in items:
        numbers = np.array(sorted({number[t] for t in split(text)}))
        scored.append(bts._search_tree(tree, ids, null, numbers, weight, root, group, bts.Best(10)))
    assert np.mean(scored) < 0.8 * leaves


def test_long_documents_do_not_overflow():
    n = np.array([1, 2 ** 40])
    got = bts.saturated(np.array([1, 2 ** 33]), n, 10 ** 9, 10 ** 15)
    assert got.tolist() == [10 ** 9 // (1000 + 20 * 50),
                            (10 ** 9 * 2 ** 33) // (1000 * 2 ** 33 + 20 * (50 + 50 * 10 ** 9 * 2 ** 40 // 10 ** 15))]
