"""The registered query of each operator and, where SQL can say it, the SQL whose rows it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import (
    context_mixing, decontaminate, langid, lexical_search, licenses, line_dedup, ngram_join, order_minhash, packing, periodic_runs, pii, substring_dedup,
    token_counts,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP1_SQL = r"""
with docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from documents
), items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from benchmark
), item_starts as (
    select item_id, ws, least(len(ws), 10) as size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from items where len(ws) > 0
), windows as (
    select distinct cast(item_id as varchar) as item_id, size, array_to_string(ws[i : i + size - 1], ' ') as passage from item_starts
), sizes as (
    select distinct size from windows
), doc_starts as (
    select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as i from docs cross join sizes where len(ws) >= size
), hits as (
    select d.doc_id, d.i, d.size, w.item_id
    from (select doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') as passage from doc_starts) d
    join windows w on d.passage = w.passage and d.size = w.size
), places as (
    select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + size)) as j from hits) group by doc_id
), met as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct doc_id, item_id from hits) group by doc_id
)
select d.doc_id, len(d.ws) as n_words, coalesce(p.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items,
       sha256(coalesce(m.ids, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from docs d left join places p on d.doc_id = p.doc_id left join met m on d.doc_id = m.doc_id
"""


@_query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op2_order_minhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.fingerprint_neighbours(_table(spark, folder, "documents"))


OP3_SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), held as (
    select key, max(doc_id) as keeper
    from (select distinct doc_id, key from keyed where length(key) >= 40)
    group by key having count(*) >= 5
), judged as (
    select k.*, coalesce(k.doc_id < h.keeper, false) as gone from keyed k left join held h on k.key = h.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


@_query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents"))


OP4_SQL = r"""
with split as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), starts as (
    select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from split
), passages as (
    select doc_id, i, array_to_string(ws[i : i + 49], ' ') as passage from starts
), firsts as (
    select passage, min(doc_id) as first from passages group by passage having min(doc_id) < max(doc_id)
), gone as (
    select distinct p.doc_id, unnest(range(p.i, p.i + 50)) as j from passages p join firsts f on p.passage = f.passage where f.first < p.doc_id
), words as (
    select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from split
), judged as (
    select w.*, g.j is not null as is_gone from words w left join gone g on w.doc_id = g.doc_id and w.j = g.j
), kept as (
    select doc_id, count(*) as n_words, count(*) filter (where is_gone) as n_removed,
           string_agg(word, ' ' order by j) filter (where not is_gone) as rest
    from judged group by doc_id
)
select d.doc_id, coalesce(k.n_words, 0) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.rest, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
"""


@_query("op4_substring_dedup", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup_passages(_table(spark, folder, "documents"))


@_query("op5_pii")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(_table(spark, folder, "documents"))


OP6_SQL = r"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as ws
    from documents
), starts as (
    select doc_id, ws, least(len(ws), 3) as size, unnest(range(1, len(ws) - least(len(ws), 3) + 2)) as i from split where len(ws) > 0
), shingles as (
    select distinct doc_id, array_to_string(ws[i : i + size - 1], ' ') as s from starts
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), common as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s where a.doc_id <> b.doc_id group by 1, 2
), links as (
    select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)
), reach as (
    select doc_id as root, doc_id as node from documents
    union
    select r.root, l.y from reach r join links l on r.node = l.x
)
select d.doc_id, coalesce(z.n, 0) as n_shingles, r.component_id
from documents d left join sizes z on d.doc_id = z.doc_id
join (select root, min(node) as component_id from reach group by root) r on r.root = d.doc_id
"""


@_query("op6_ngram_join", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, folder, "documents"))


@_query("op7_license_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


@_query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_through_edits(_table(spark, folder, "documents"), token_counts.sample_edits())


@_query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


@_query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


@_query("op11_context_mixing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.score_texts(_table(spark, folder, "documents"))


@_query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest_runs(_table(spark, folder, "documents"))


OP13_SQL = r"""
with asked as (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
), words as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
), sizes as (
    select doc_id, count(*) as n from words group by doc_id
), totals as (
    select count(*) as docs, cast(sum(n) as bigint) as terms from sizes
), postings as (
    select doc_id, term, count(*) as tf from words where term in (select term from asked) group by doc_id, term
), weights as (
    select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w
    from postings cross join totals group by term
), gains as (
    select p.doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) as gain
    from postings p join sizes s on p.doc_id = s.doc_id join weights x on p.term = x.term cross join totals
), scored as (
    select a.item_id, g.doc_id, cast(sum(gain) as bigint) as score from asked a join gains g on a.term = g.term group by a.item_id, g.doc_id
), ranked as (
    select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""


@_query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
