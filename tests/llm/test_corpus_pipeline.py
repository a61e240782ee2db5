"""The pipeline and the registration of the queries."""

import random
from collections import Counter

import __spark_entry__ as entry_points
import corpus_pipeline
from cohort.llm import queries, stages
from cohort.llm.tokens import encoder
from tests.llm.helpers import rows_of
from tests.llm.test_text_joins import contamination, plain_groups, plain_line_dedup

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(names) | {"pipeline"} <= set(entry_points.queries()) and set(queries.ORACLES) <= set(names)


def test_pipeline_equals_plain_stages(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    rows = [(r[0], r[3]) for r in plain_line_dedup(rows)]
    groups = Counter(r[2] for r in plain_groups(rows, stages.NEAR_SHINGLE, stages.NEAR_PERCENT))
    rows = [r for r in rows if r[0] in groups]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {r[0] for r in contamination(rows, items) if r[5]}
    expected = Counter()
    for doc_id, text in rows:
        if doc_id not in hit:
            expected[doc_id] = len(encoder().encode(text)) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r["doc_id"]] += r["length"]
    assert got == expected and 0 < len(hit) and len(groups) < table.count()


def test_stages_keep_columns_and_take_odd_rows(spark):
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choice("alpha beta gamma".split()) for _ in range(30)), "en", "s", 1, "x", 2) for n in range(20)]
    rows += [(None, "without an id", "en", None, None, "x", 2), (50, None, None, None, 0, None, None), (51, "", "de", "s", 0, "y", 1), (52, "12 34", "en", "s", 0, "y", 1), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, pos int").repartition(4)
    for table in (docs, docs.limit(0)):
        for _, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, table, FOLDER)
            assert out.columns == docs.columns
            assert out.count() <= table.count()
    assert rows_of(stages.language_id(spark, docs, FOLDER).select("doc_id")) == sorted([(r[0],) for r in rows if r[0] not in (50, 51, 52)], key=repr)
