"""Ranked lexical search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohort.llm import lexical_search
from tests.llm.helpers import ascii_lower, documents, rows_of


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def plain_search(docs, items, best=10):
    held = [(doc_id, Counter(words(text))) for doc_id, text in docs if doc_id is not None and words(text)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item_id, text in items:
        if item_id is not None:
            asked.setdefault(item_id, Counter()).update(words(text))
    found = []
    for item_id, terms in asked.items():
        scores = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            gain = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in terms.items() if t in c)
            scores += [(-gain, doc_id)] if gain else []
        found += [(item_id, rank, doc_id, -gain) for rank, (gain, doc_id) in enumerate(sorted(scores)[:best], 1)]
    return sorted(found, key=repr)


def tables(rng, n_docs=300, n_items=25):
    vocabulary = [f"w{n}" for n in range(150)] + ["É", "straße", "7"]
    weights = [1 / (1 + n) for n in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "-", ".\n"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(n, text(rng.choice([1, 5, 40, 120])).title()) for n in range(n_docs)]
    docs += [(n + 1000, docs[3][1]) for n in range(30)] + [(5000, None), (5001, ""), (5002, "..."), (None, docs[0][1]), (5003, "w0 " * 50_000)]
    items = [(n, text(rng.choice([1, 4, 20]))) for n in range(n_items)]
    items += [(100, docs[3][1]), (101, None), (102, ""), (103, "nowhere found"), (None, "w1"), (104, "w0 w0 w0"), (3, "w2 w140")]
    return docs, items


@pytest.mark.parametrize("shard, bundle", [(4096, 256), (37, 4)])
def test_search_equals_scoring_all(spark, monkeypatch, shard, bundle):
    monkeypatch.setattr(lexical_search, "DOCUMENTS_IN_SHARD", shard)
    monkeypatch.setattr(lexical_search, "ITEMS_IN_BUNDLE", bundle)
    docs, items = tables(random.Random(shard))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("w1")).withColumn("bundle", F.lit(1))
    got = lexical_search.search(documents(spark, docs, extra=True).withColumn("a.b", F.lit(1)), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["item_id"].dataType.typeName() == "long"
    assert rows_of(got) == plain_search(docs, items)


def test_terms_beyond_the_shipped_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHIPPED_TERMS", 3)
    docs, items = tables(random.Random(5), 60, 6)
    assert rows_of(lexical_search.search(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))) == plain_search(docs, items)


def test_repeated_ids_are_documents_of_their_own(spark):
    docs = [(1, "a b"), (1, "a b"), (1, "c"), (2, "a"), (3, "z y x")]
    got = rows_of(lexical_search.search(documents(spark, docs), spark.createDataFrame([("q", "a b")], "item_id string, text string")))
    assert [r[:3] for r in got] == [("q", 1, 1), ("q", 2, 1), ("q", 3, 2)] and got[0][3] == got[1][3] > got[2][3]


def test_empty_tables_have_no_results(spark):
    docs, items = documents(spark, [(1, "a b")]), spark.createDataFrame([("q", "a b")], "item_id string, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(documents(spark, [(1, None), (2, "..")]), items).count() == 0
