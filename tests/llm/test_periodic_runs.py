"""Periodic runs against a plain version that tries every period at every place."""

import hashlib
import random
import zlib

from cohort.llm import periodic_runs
from tests.llm.helpers import documents, rows_of, space_words


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 3 + 1):
        same, k = [words[n] == words[n + q] for n in range(len(words) - q)], 0
        while k < len(same):
            end = k
            while end < len(same) and same[end]:
                end += 1
            run = words[k : end + q]
            if end > k and len(run) >= max(24, 3 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.append((k, len(run), q))
            k = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    few, words = rng.choice([1, 2, 3, 5, 50]), []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.5:
            unit = [rng.randrange(few) for _ in range(rng.randint(1, 30))]
            size = rng.randint(1, 5 * len(unit) + 30)
            words += (unit * (size // len(unit) + 1))[:size]
        elif kind < 0.8:
            words += [rng.randrange(few) for _ in range(rng.randint(0, 60))]
        else:
            words = words * rng.randint(1, 3)
        words = words[:400]
    return [str(w) for w in words]


def test_runs_equal_all_periods():
    rng = random.Random(4)
    for _ in range(120):
        texts = [some_words(rng) for _ in range(rng.randint(1, 12))]
        assert periodic_runs.runs_of([[w.encode() for w in t] for t in texts]) == [plain_runs(t) for t in texts]


def test_runs_of_hard_texts():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 700:
        a, b = b, b + a
    texts = [b, [b"a"] * 900, ([b"a"] * 20 + [b"x"]) * 30, sum(([b"a"] * 25 + [b"%d" % n] for n in range(30)), []), [b"%d" % n for n in range(800)], (b[:40] * 4 + [b"c"]) * 4]
    assert periodic_runs.runs_of(texts) == [plain_runs(t) for t in texts]
    assert periodic_runs.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]


def test_grammar_spells_its_texts():
    import numpy as np

    rng = random.Random(9)
    ids, text = [], []
    for n in range(20):
        words = some_words(rng)
        ids += [n * 100 + int(w) for w in words]
        text += [n] * len(words)
    g = periodic_runs.re_pair(np.array(ids, dtype=np.int64), np.array(text, dtype=np.int64))
    spelled = list(range(g.terminals))
    spelled = [[s] for s in spelled]
    for a, b in zip(g.left, g.right, strict=True):
        spelled.append(spelled[a] + spelled[b])
    assert sum((spelled[s] for s in g.symbols), []) == ids
    for n, at in enumerate(g.first):
        assert ids[at : at + g.length[g.terminals + n]] == spelled[g.terminals + n]
    pairs = [(int(x), int(y), int(t)) for x, y, t, u in zip(g.symbols, g.symbols[1:], g.text, g.text[1:], strict=False) if t == u]
    assert all(pairs.count(p) == 1 or p[0] == p[1] for p in pairs)


def plain_digest(doc_id, text):
    words = space_words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    gone = {k for a, size, q in runs for k in range(a + q, a + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *tail, sha("".join(f"{a},{size},{q}\n" for a, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def test_digest_of_documents(spark):
    rng = random.Random(6)
    docs = [(rng.randint(0, 300), rng.choice([" ", "\n", " \t"]).join(some_words(rng))) for _ in range(150)]
    docs += [(None, "a " * 40), (None, None), (500, None), (501, ""), (502, " \n "), docs[0], (503, "é ü " * 30), (504, "\x1f " * 24)]
    got = periodic_runs.digest_runs(documents(spark, docs, extra=True).selectExpr("*", "1 as `a.b`", "2 as start"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows_of(got) == sorted((plain_digest(*d) for d in docs), key=repr)
    assert periodic_runs.digest_runs(documents(spark, docs).limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    got = periodic_runs.find_runs(documents(spark, [(10, "x " + "a b " * 15 + "y"), (2, None)], extra=True)).collect()
    assert sorted((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == [(2, [], ""), (10, [(1, 30, 2)], "x a b y")]
