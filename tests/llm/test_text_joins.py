"""Operators that compare documents, against plain versions that compare all with all."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohort.llm import decontaminate, line_dedup, ngram_join, order_minhash, substring_dedup
from cohort.llm.words import window_hashes, word_hashes
from tests.llm.helpers import ascii_lower, documents, edited, plain_words, rows_of, space_words

VOCABULARY = [f"w{n}" for n in range(200)]


def prose(rng, n, vocabulary=VOCABULARY):
    return [rng.choice(vocabulary) for _ in range(n)]


def test_word_hashes_follow_the_words():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aAbé \n\t\x0b\x1cß") for _ in range(rng.randint(0, 40)))
        words, hashes = space_words(text), word_hashes(text)
        assert [word_hashes(w)[0] for w in words] == hashes.tolist()
        assert (word_hashes(text, True) == word_hashes(ascii_lower(text))).all()
        assert [window_hashes(word_hashes(" ".join(words[n : n + 3])), 3)[0] for n in range(len(words) - 2)] == window_hashes(hashes, 3).tolist()


# Benchmark decontamination


def contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        size = min(window, len(words))
        for n in range(len(words) - size + 1 if words and item is not None else 0):
            windows.setdefault(tuple(words[n : n + size]), set()).add(str(item))
    found = []
    for doc_id, text in docs:
        words, hit, met = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for n in range(len(words) - size + 1 if doc_id is not None else 0):
                if (held := windows.get(tuple(words[n : n + size]))) is not None:
                    hit |= set(range(n, n + size))
                    met |= held
        found.append((doc_id, len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=repr)


def test_contamination_equals_all_windows(spark):
    rng = random.Random(3)
    few = [w + str(n) for w in ["Alpha", "beta", "Délta", "É"] for n in range(4)]
    items = [(f"it{n}", " ".join(prose(rng, rng.choice([0, 1, 3, 6, 9, 10, 11, 15, 40]), few))) for n in range(30)]
    items += [(None, "alpha1 beta1"), ("x", None), ("y", "a b " * 7), ("it1", "another text of it1"), items[5]]
    docs = []
    for _ in range(100):
        words = prose(rng, rng.randint(0, 60), few)
        for _ in range(rng.randint(0, 3)):
            if own := (rng.choice(items)[1] or "").split():
                at = rng.randint(0, len(own) - 1)
                words[rng.randint(0, len(words)) : 0] = own[at : at + rng.randint(1, 30)]
        docs.append((rng.randint(0, 90), rng.choice([" ", ". ", "\n-- "]).join(words)))
    docs += [(None, items[3][1]), (700, None), (701, ""), (702, "a b " * 40), docs[0], (703, "long words " * 20_000)]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("words", F.lit(1)).withColumn("key", F.lit(2))
    table = documents(spark, docs, extra=True)
    assert rows_of(decontaminate.find_contamination(table, bench)) == contamination(docs, items)
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns and kept.count() == sum(not r[5] for r in contamination(docs, items))
    assert decontaminate.find_contamination(table, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_contamination(table.limit(0), bench).count() == 0


def test_decontamination_runs_no_python(spark):
    table = documents(spark, [(1, "a b c")])
    plan = decontaminate.find_contamination(table, spark.createDataFrame([("i", "a b c")], "item_id string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# Document fingerprints


def test_neighbours_in_order_of_ids(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 90):
        rows = [(k * 7 - 100, rng.choice([None, "", " ".join(prose(rng, rng.randint(0, 80)))])) for k in range(n)]
        expected = []
        for k, (doc_id, text) in enumerate(rows):
            text, following = text or "", rows[(k + 1) % n][1] or ""
            half = len(text) // 2
            other = text[: len(text) - half] + following[:half]
            a, b, c = map(order_minhash.fingerprint, (text, other, following))
            expected.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), a, b, order_minhash.likeness(a, b), order_minhash.likeness(a, c)))
        assert rows_of(order_minhash.fingerprint_neighbours(documents(spark, rows, extra=True), 10)) == sorted(expected, key=repr)


def test_neighbours_of_ids_that_doubles_cannot_name(spark):
    rng = random.Random(12)
    for base, step in ((2**62, 1_000), (-(2**62), 1_000), (2**62, 2**47), (2**63 - 400_000, 1_000)):
        rows = [(base + n * step + rng.randrange(step), f"w{n} " * 3) for n in range(400)]
        expected = {}
        for (doc_id, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
            half = len(text) // 2
            expected[doc_id] = hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        got = order_minhash.fingerprint_neighbours(documents(spark, rows), 10).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["edited_sha256"] for r in got} == expected


def test_neighbours_of_repeated_and_missing_ids(spark):
    rows = [(None, "x y z"), (None, "y"), (3, "a b c d"), (3, "a b c d"), (3, "q"), (9, "zz top")]
    got = order_minhash.fingerprint_neighbours(documents(spark, rows), 1).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == [(-1, 1), (-1, 5), (3, 1), (3, 7), (3, 7), (9, 6)]
    assert sum(r["near_next"] == 1.0 for r in got) == 1


def test_likeness_follows_edits_and_order():
    rng = random.Random(5)
    text = prose(rng, 600)
    mark = order_minhash.fingerprint(" ".join(text))
    near = [order_minhash.likeness(mark, order_minhash.fingerprint(" ".join(edited(rng, text, n, VOCABULARY)))) for n in (0, 6, 60, 400)]
    assert near[0] == 1.0 and near[0] >= near[1] > near[2] > near[3]
    assert order_minhash.likeness(mark, order_minhash.fingerprint(" ".join(text[300:] + text[:300]))) < 0.75  # same grams, other order
    assert order_minhash.fingerprint("") == order_minhash.fingerprint(" \n") != order_minhash.fingerprint("a")


# Line and passage deduplication


def plain_line_dedup(rows):
    def key(line):
        return ascii_lower(line.strip(" \t\n\r\x0b\x0c"))

    holders = {}
    for doc_id, text in rows:
        for k in {k for line in (text or "").split("\n") if len(k := key(line)) >= 40}:
            holders.setdefault(k, []).append(doc_id)
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if len(k := key(line)) < 40 or len(holders[k]) < 5 or doc_id is None or doc_id >= max(h for h in holders[k] if h is not None)
        ]
        found.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


def line_rows(rng):
    lines = ["é" * 39 + x for x in "abc"] + ["x" * 38, "Q" * 40 + " y", " " * 3 + "q" * 40 + " Y\t"]
    rows = [(rng.randint(0, 70), "\n".join(rng.choice([*lines, "short", "", " ".join(prose(rng, 20))]) for _ in range(rng.randint(0, 6)))) for _ in range(90)]
    return [*rows, (None, lines[0]), (7, None), (8, ""), (900, lines[0] + "\n" + lines[0]), (10, "long line " * 20_000)]


def test_line_dedup_equals_plain_version(spark):
    rows = line_rows(random.Random(5))
    table, expected = documents(spark, rows, extra=True), plain_line_dedup(rows)
    assert rows_of(line_dedup.dedup_lines(table)) == sorted([(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in expected], key=repr)
    dropped = line_dedup.drop_lines(table)
    assert dropped.columns == table.columns
    assert rows_of(dropped.selectExpr("doc_id", "coalesce(text, '')")) == sorted([(r[0], r[3]) for r in expected], key=repr)
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for batch in ([(9, 1, 1), (8, 1, 1), (8, 2, 2)], [(7, 1, 1), (7, 3, 3)], [(5, 2, 2)], [(4, 3, 3)], [(3, 1, 1)]):
        runs.add(spark.createDataFrame(batch, "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert rows_of(runs.repeated(2)) == [(1, 1, 9), (2, 2, 8), (3, 3, 7)]


def plain_passages(rows, window=50):
    firsts, split = {}, [space_words(t) for _, t in rows]
    for (doc_id, _), words in zip(rows, split, strict=True):
        for n in range(len(words) - window + 1 if doc_id is not None else 0):
            passage = tuple(words[n : n + window])
            firsts[passage] = min(firsts.get(passage, doc_id), doc_id)
    found = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        gone = [False] * len(words)
        for n in range(len(words) - window + 1 if doc_id is not None else 0):
            if firsts[tuple(words[n : n + window])] < doc_id:
                gone[n : n + window] = [True] * window
        found.append((doc_id, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(found, key=repr)


def test_passages_equal_plain_version(spark):
    rng = random.Random(5)
    shared = [prose(rng, rng.randint(30, 300)) for _ in range(6)]
    rows = []
    for _ in range(120):
        kind = rng.random()
        if kind < 0.2:
            words = list(rng.choice(shared))
        elif kind < 0.8:
            words = prose(rng, rng.randint(0, 120))
            for _ in range(rng.randint(1, 3)):
                own = rng.choice(shared)
                at = rng.randint(0, len(own) - 1)
                words[rng.randint(0, len(words)) : 0] = own[at : at + rng.randint(20, 120)]
        else:
            words = ["a", "b"] * rng.randint(5, 200) if kind < 0.9 else prose(rng, rng.randint(0, 60))
        rows.append((rng.randint(0, 110), rng.choice([" ", "\n", "  ", "\t "]).join(words)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), rows[3], (rows[4][0], rows[5][1]), (502, " ".join(prose(rng, 30_000)))]
    table = documents(spark, rows, extra=True)
    assert rows_of(substring_dedup.dedup_passages(table)) == plain_passages(rows)
    assert substring_dedup.dedup_passages(table.limit(0)).count() == 0


# Jaccard join


def plain_groups(rows, shingle, percent):
    sets = []
    for _, text in rows:
        words = [ascii_lower(w) for w in space_words(text)]
        size = min(shingle, len(words))
        sets.append({tuple(words[n : n + size]) for n in range(len(words) - size + 1)} if words else set())
    parent = {doc_id: doc_id for doc_id, _ in rows if doc_id is not None}
    hashes = [ngram_join._set_hash(ngram_join.Rule(shingle, percent).shingles(text)) for _, text in rows]
    counts = {}  # of several rows with one id, the one whose set has the smallest hash
    for n, (doc_id, _) in enumerate(rows):
        counts[doc_id] = min(counts.get(doc_id, n), n, key=lambda m: hashes[m])

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, _) in enumerate(rows):
        for m, (b, _) in enumerate(rows[:n]):
            if sets[n] and sets[m] and a is not None and b is not None and (counts[a], counts[b]) == (n, m):
                common = len(sets[n] & sets[m])
                if 100 * common >= percent * (len(sets[n]) + len(sets[m]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return sorted([(d, len(s), root(d) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True)], key=repr)


def near_rows(rng):
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(40)]
    boiler = prose(rng, 30)
    texts += [prose(rng, rng.randint(5, 40)) + boiler for _ in range(30)]
    first, second = prose(rng, 120), prose(rng, 60)
    third, part = edited(rng, first, 30, VOCABULARY), edited(rng, first, 5, VOCABULARY)
    for base, copies, most in ((first, 90, 6), (part, 40, 3), (second, 50, 4), (third, 40, 5), (second, 15, 0)):
        texts += [edited(rng, base, rng.randint(0, most), VOCABULARY) for _ in range(copies)]
    for _ in range(8):
        own = prose(rng, rng.randint(3, 80))
        texts += [edited(rng, own, rng.randint(0, 3), VOCABULARY) for _ in range(5)]
    rng.shuffle(texts)
    rows = [(2 * n, " ".join(words)) for n, words in enumerate(texts)]
    return [*rows, (None, rows[3][1]), (5000, None), (5001, ""), (rows[7][0], rows[8][1]), rows[9], (5002, " ".join(prose(rng, 20_000)))]


@pytest.mark.parametrize(("shingle", "percent", "costly"), [(3, 90, 20), (5, 80, 10)])
def test_groups_equal_all_pairs(spark, monkeypatch, shingle, percent, costly):
    monkeypatch.setattr(ngram_join, "COSTLY", costly)  # so that groups of this size count as large
    rows = near_rows(random.Random(percent))
    assert rows_of(ngram_join.near_groups(documents(spark, rows, extra=True), shingle, percent)) == plain_groups(rows, shingle, percent)


def two_radii(rng, size):
    """Copies of one text near its centre and far from it; the far ones share some of their edits, so a few of them link."""
    words = prose(rng, 100)
    places = [(at, word) for at in range(0, 100, 3) for word in ("one", "two")]
    rows = [(1, " ".join(words))]
    for k in range(size):
        copy = list(words)
        for at, word in rng.sample(places[: rng.choice((9, 14, len(places)))], rng.choice((0, 1, 2, 4, 5, 8))):
            copy[at] = word
        del copy[len(copy) - rng.randrange(3) :]
        rows.append((2 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("seed", "shingle", "percent", "costly", "rounds"), [(1, 5, 80, 2, 4), (3, 3, 90, 3, 2)])
def test_groups_with_far_copies_equal_all_pairs(spark, monkeypatch, seed, shingle, percent, costly, rounds):
    monkeypatch.setattr(ngram_join, "COSTLY", costly)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rows = two_radii(random.Random(seed), 150)
    assert rows_of(ngram_join.near_groups(documents(spark, rows), shingle, percent)) == plain_groups(rows, shingle, percent)


def test_far_copies_with_one_shared_edit_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COSTLY", 20)
    rng = random.Random(7)
    words = prose(rng, 100)
    rows = [(1, " ".join(words))]
    for k in range(120):
        copy = list(words)
        for n, at in enumerate(rng.sample(range(2, 98, 5), 6)):
            copy[at] = "shared" if n == 0 else f"own{k}n{n}"
        rows.append((2 + k, " ".join(copy)))
    assert rows_of(ngram_join.near_groups(documents(spark, rows), 5, 80)) == plain_groups(rows, 5, 80)


def test_documents_take_part_in_no_more_families_than_needed(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COSTLY", 5)
    rng, made, differences = random.Random(11), [], ngram_join._differences

    def counted(*args):
        found = differences(*args)
        made.append((found.count(), found.select("doc_id").distinct().count()))
        return found

    monkeypatch.setattr(ngram_join, "_differences", counted)
    bodies, endings = [prose(rng, 100) for _ in range(3)], [prose(rng, 8) for _ in range(3)]
    # Each ending is held by copies of all bodies, so it leads to a family of its own.
    rows = [(k, " ".join(edited(rng, bodies[k % 3], rng.randint(0, 3), VOCABULARY) + endings[k // 3 % 3])) for k in range(60)]
    assert rows_of(ngram_join.near_groups(documents(spark, rows), 5, 80)) == plain_groups(rows, 5, 80)
    assert 40 < made[0][0] <= 1.2 * made[0][1]


def test_copies_that_keep_some_lines_move_few_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COSTLY", 8)
    rng, moved, unpacked = random.Random(5), [], ngram_join._unpacked

    def counted(sets, *more):
        found = unpacked(sets, *more)
        if "family" in more:
            moved.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_unpacked", counted)
    bodies = [[prose(rng, 25) for _ in range(4)] for _ in range(2)]
    rows = []
    for k in range(120):
        kept = [line for line in bodies[k % 2] if rng.random() < 0.6] or bodies[k % 2]
        rows.append((k, " ".join(word for line in kept for word in edited(rng, line, rng.randint(0, 1), VOCABULARY))))
    assert rows_of(ngram_join.near_groups(documents(spark, rows), 5, 80)) == plain_groups(rows, 5, 80)
    assert sum(moved) < 14_000


def test_groups_of_an_empty_table(spark):
    assert ngram_join.near_groups(documents(spark, [(1, "a")]).limit(0)).count() == 0
