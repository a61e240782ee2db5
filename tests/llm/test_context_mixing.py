"""Language-model scores against plain counts and a plain model that looks every decision up by itself."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohort.llm import context_mixing as cm
from tests.llm.helpers import ascii_lower, documents, space_words


def some_documents(rng, n=160):
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    weights = [1 / (1 + k) for k in range(80)]
    text = lambda k: rng.choice([" ", "\n", "  "]).join(w.title() if rng.random() < 0.1 else w for w in rng.choices(vocabulary, weights, k=k))
    docs = [(k, text(rng.choice([1, 8, 60]))) for k in range(n)]
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "x" * 500), (904, "Y" * 64 + " " + "y" * 63 + " z"), (None, "a b"), docs[3], (905, text(3000))]


def plain_base(docs):
    held = [doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 for doc_id, _ in docs]
    counts, ends = Counter(), 0
    for (doc_id, text), out in zip(docs, held, strict=True):
        if doc_id is not None and not out:
            counts.update(space_words(ascii_lower(text or "")))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    found = []
    for (doc_id, text), out in zip(docs, held, strict=True):
        cs = [counts[w] for w in space_words(ascii_lower(text or ""))] + [ends]
        found.append((doc_id, out, len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in cs)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("frequent, fan_in", [(1 << 17, 32), (7, 2)])
def test_base_scores_equal_plain_counts(spark, monkeypatch, frequent, fan_in):
    monkeypatch.setattr(cm, "FREQUENT", frequent)
    monkeypatch.setattr(cm, "FAN_IN", fan_in)
    docs = some_documents(random.Random(2))
    got = cm.score_texts(documents(spark, docs, extra=True).selectExpr("*", "1 as `a.b`", "2 as `row`", "3 as word"))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    expected = plain_base(docs)
    key = lambda r: repr(r[:5])
    rows, expected = sorted(rows, key=lambda r: (key(r), r[5])), sorted(expected, key=lambda r: (key(r), r[5]))
    assert [r[:5] for r in rows] == [r[:5] for r in expected]
    assert all(a[5] == pytest.approx(b[5], rel=1e-9) for a, b in zip(rows, expected, strict=True))
    assert all(r[6] < 0 and r[7] > 0 for r in rows)
    assert len({r[6] for r in rows if r[0] == 3}) == 1  # copies score alike


def test_scores_are_lengths_of_a_code(spark):
    """The scores do not hang on how rows are dealt, and learnt text is described better than other text."""
    docs = some_documents(random.Random(4), 300)
    held = next(k for k in range(2000, 3000) if zlib.crc32(str(k).encode()) % 10 == 0)
    letters = list(docs[165][1] or docs[40][1] * 30)
    random.Random(1).shuffle(letters)
    docs += [(held, (docs[307][1] or "")[:900]), (held * 10, "".join(letters)[:900])]
    a = {(r["doc_id"], r["n_tokens"]): r for r in cm.score_texts(documents(spark, docs)).collect()}
    b = {(r["doc_id"], r["n_tokens"]): r for r in cm.score_texts(documents(spark, docs[::-1]).coalesce(2)).collect()}
    assert all(a[k]["score"] == pytest.approx(b[k]["score"], rel=1e-4, abs=1e-3) for k in a)
    by_id = {k[0]: r for k, r in a.items()}
    assert by_id[held]["held_out"] and by_id[held]["bits_per_byte"] < 0.7 * by_id[held * 10]["bits_per_byte"]


def test_texts_are_cut_whole():
    texts = [(t or "").encode() for _, t in some_documents(random.Random(7))]
    cut = cm.cut_texts(texts)
    for n, text in enumerate(texts):
        pieces = [cut.pieces[k] for k in cut.which[cut.first[n] : cut.first[n + 1]]]
        assert b"".join(pieces) == text + cm.END
        assert all(len(p) <= cm.LONGEST and not any(c in cm._BLANKS for c in p[:-1]) for p in pieces)
        assert all(len(p) == cm.LONGEST or p[-1] in cm._BLANKS for p in pieces)
    assert len(cut.pieces) == len(set(cut.pieces))
    assert len(cm.cut_texts([]).pieces) == 0


def test_costs_equal_a_plain_mixer():
    """Every decision looked up by itself, in tables filled by counting every piece of every text."""
    texts = [(t or "").encode() for _, t in some_documents(random.Random(8), 40)]
    counts = np.bincount(np.frombuffer(b"".join(t + cm.END for t in texts), dtype=np.uint8), minlength=256)
    code = cm.code_of(counts.tolist())
    assert sum(2.0 ** -s for s in code.size.tolist()) == 1.0
    cut = cm.cut_texts(texts)
    d = cm.decisions_of(cut.pieces, code)
    seen = {}
    for k, p in enumerate(cut.pieces):  # the same context and node have the same slot, others another one
        at = int(d.begin[k])
        for i, byte in enumerate(p):
            for depth in range(int(code.size[byte])):
                for t, order in enumerate([*cm.ORDERS, None]):
                    context = (t, p[:i] if order is None else p[max(0, i - order) : i], int(code.node[byte, depth]))
                    assert seen.setdefault(context, int(d.slots[t][at])) == int(d.slots[t][at])
                assert d.answer[at] == code.answer[byte, depth]
                at += 1
    rng = np.random.default_rng(1)
    tables = [rng.integers(-120, 120, sum(1 << b for b in cm.TABLE_BITS)).astype(np.int8), rng.integers(0, 4, sum(1 << b for b in cm.TABLE_BITS)).astype(np.uint8)]
    mixer = cm.Mixer.of(code, tables, rng.random((cm.SETS, cm.GATES, len(cm.TABLE_BITS))))
    got = mixer.nats(cut)
    for n in range(len(texts)):
        total = [0.0] * cm.SETS
        for k in cut.which[cut.first[n] : cut.first[n + 1]]:
            end = d.begin[k + 1] if k + 1 < len(d.begin) else len(d.answer)
            for at in range(d.begin[k], end):
                odds = [float(o[s[at]]) / 16 for o, s in zip(mixer.odds, d.slots, strict=True)]
                gate = 4 * int(mixer.trust[cm.PREFIX][d.slots[cm.PREFIX][at]]) + int(mixer.trust[cm.GATING][d.slots[cm.GATING][at]])
                for s in range(cm.SETS):
                    z = sum(w * o for w, o in zip(mixer.weights[s][gate], odds, strict=True))
                    total[s] += math.log1p(math.exp(-z if d.answer[at] else z))
        least = min(total)
        assert got[n] == pytest.approx(least - math.log(sum(math.exp(least - t) for t in total) / cm.SETS), rel=1e-4)


def test_weights_learn_from_all_training_texts(spark, monkeypatch):
    """What the weights are fitted to is every piece of every training text, in whichever parts they are summed up."""
    monkeypatch.setattr(cm, "KEPT", 50)
    monkeypatch.setattr(cm, "TEXT_AT_ONCE", 2000)
    docs, given, fit = some_documents(random.Random(6), 700), [], cm.fit

    def seen(pieces, *more):
        given.extend(pieces.collect())
        return fit(pieces, *more)

    monkeypatch.setattr(cm, "fit", seen)
    cm.score_texts(documents(spark, docs)).count()
    learnt = [(t or "").encode() for k, t in docs if k is not None and zlib.crc32(str(k).encode()) % 10]
    cut = cm.cut_texts(learnt)
    expected = Counter({cut.pieces[n]: k for n, k in enumerate(np.bincount(cut.which).tolist())})
    assert len(learnt) > 600
    assert {bytes(r["piece"]): sum(r[f"times{k}"] for k in range(cm.SETS)) for r in given} == expected
    assert all(sum(r[f"times{k}"] for r in given) > 100 for k in range(cm.SETS))


def test_slopes_are_those_of_the_costs():
    pieces = [b"one ", b"two ", b"three\n", b"one\xff"]
    code, rng = cm.code_of([1] * 256), np.random.default_rng(5)
    tables = [rng.integers(-90, 90, sum(1 << b for b in cm.TABLE_BITS)).astype(np.int8), rng.integers(0, 4, sum(1 << b for b in cm.TABLE_BITS)).astype(np.uint8)]
    weights, times = rng.random((cm.SETS, cm.GATES, len(cm.TABLE_BITS))), rng.integers(0, 9, (4, cm.SETS)).astype(float)
    first, second = cm.Mixer.of(code, tables, weights).slopes(pieces, times)
    for s, g, k in ((0, 5, 1), (1, 10, 3), (1, 0, 0)):
        moved = [weights.copy(), weights.copy()]
        moved[0][s, g, k] -= 1e-2
        moved[1][s, g, k] += 1e-2
        low, high = (cm.Mixer.of(code, tables, w) for w in moved)
        assert ((high.costs(pieces) - low.costs(pieces)) * times).sum() / 2e-2 == pytest.approx(first[s, g, k], rel=1e-2, abs=1e-2)
        assert (high.slopes(pieces, times)[0] - low.slopes(pieces, times)[0])[s, g] / 2e-2 == pytest.approx(second[s, g, k], rel=1e-2, abs=1e-2)
    twice = [np.stack([tables[0]] * 2, axis=1), tables[1]]  # a log odds for each answer
    assert (cm.Mixer.of(code, twice, weights).costs(pieces) == cm.Mixer.of(code, tables, weights).costs(pieces)).all()


def test_priced_pieces_cost_the_same():
    texts = [(t or "").encode() for _, t in some_documents(random.Random(9), 60)]
    cut, rng = cm.cut_texts(texts), np.random.default_rng(2)
    assert (cm.names_of(cut.pieces) == cut.names).all() and (np.diff(cut.names.astype(object)) > 0).all()
    tables = [rng.integers(-120, 120, sum(1 << b for b in cm.TABLE_BITS)).astype(np.int8), rng.integers(0, 4, sum(1 << b for b in cm.TABLE_BITS)).astype(np.uint8)]
    mixer = cm.Mixer.of(cm.code_of([1] * 256), tables, rng.random((cm.SETS, cm.GATES, len(cm.TABLE_BITS))))
    plain = mixer.nats(cut)
    mixer.priced = (cut.names[::3], mixer.costs(cut.pieces[::3]))
    assert mixer.nats(cut) == pytest.approx(plain)


def plain_phrases(text):
    """The pieces of each phrase."""
    cut, out = cm.cut_texts([text]), [[]]
    for piece in (cut.pieces[k] for k in cut.which):
        out[-1].append(piece)
        if int(cm.names_of([piece])[0]) % cm.PHRASE == 0 or len(out[-1]) == cm.MOST:
            out.append([])
    return [tuple(p) for p in out if p]


def plain_gains(texts, learnt, costs):
    """What each text's phrases cost less for the phrase before them, counted phrase by phrase; ``costs`` are those of pieces."""
    phrases = [plain_phrases(t) for t in texts]
    costs = [[sum(own[k] for k in range(e - len(x), e)) for x, e in zip(p, np.cumsum([len(x) for x in p]), strict=True)] for p, own in zip(phrases, costs, strict=True)]
    placed = [[*zip([None, *p], p, strict=False)] for p in phrases]
    seen = Counter(x for p, known in zip(placed, learnt, strict=True) if known for x in p)
    out = []
    for p, known, own_costs in zip(placed, learnt, costs, strict=True):
        out.append(0.0)
        for (context, phrase), cost in zip(p, own_costs, strict=True):
            seen[context, phrase] -= known
            after = {x[1]: n for x, n in seen.items() if x[0] == context and n}
            n, k = sum(after.values()), len(after)
            out[-1] += math.log((after.get(phrase, 0) + k * math.exp(-cost)) / (n + k)) + cost if n else 0
            seen[context, phrase] += known
    return out


def test_gains_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(cm, "SHARES", 5)
    rng = random.Random(10)
    texts = [" ".join(rng.choices("abcd", k=rng.choice([0, 3, 9]))).encode() for _ in range(40)] + [b"", b"x" * 200 + b" x", b"\n" * 50, b" " * 50] * 2
    learnt = np.array([rng.random() < 0.7 for _ in texts])
    parts, costs = [], []
    for at in (0, 25):  # two batches
        cut = cm.cut_texts(texts[at : at + 25])
        so_far = np.concatenate([np.cumsum([rng.choice([0.5, 3.0, 100.0]) for _ in range(n)]) for n in np.diff(cut.first)])
        costs += [np.diff(so_far[a:b], prepend=0) for a, b in zip(cut.first[:-1], cut.first[1:], strict=True)]
        dealt = [*cm._dealt(cut, so_far, learnt[at : at + 25])]
        rows = {"share": [d[0] for d in dealt], "batch": [at] * len(dealt), **{c: [d[k] for d in dealt] for k, c in ((1, "name"), (2, "cost"), (3, "owner"))}}
        parts.append(pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * len(dealt)), type=f.type) for f in cm.WORKED], schema=cm.WORKED))
    got = [0.0] * len(texts)
    for share in range(cm.SHARES):  # tasks
        some = [p.filter(pa.array([s == share for s in p.column("share").to_pylist()])) for p in parts]
        for r in pa.Table.from_batches([*cm._gained(iter(some))], schema=cm.TEXTS).to_pylist():
            for place, grains in zip(r["places"], r["grains"], strict=True):
                got[r["batch"] + place] += grains / cm.GRAIN
    expected = plain_gains(texts, learnt.tolist(), costs)
    assert max(expected) > 90 and min(expected) < -1
    assert got == pytest.approx(expected, abs=1e-3)


def test_order_of_words_counts(spark):
    """A text whose words follow one another as in learnt texts costs less than the same words in another order."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    lines = [" ".join(words[k : k + 20]) for k in range(0, 400, 20)]
    learnt = [k for k in range(500) if zlib.crc32(str(k).encode()) % 10][:60]
    a, b = [k for k in range(500) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    other = lines[3].split() + lines[8].split()
    rng.shuffle(other)
    docs = [(k, "\n".join(rng.sample(lines, 6))) for k in learnt] + [(a, lines[3] + "\n" + lines[8]), (b, " ".join(other))]
    got = {r["doc_id"]: r["bits_per_byte"] for r in cm.score_texts(documents(spark, docs)).collect()}
    assert got[a] < 0.5 * got[b]


def test_packs_add_up():
    rng = np.random.default_rng(3)
    counts = [np.where(rng.random((cm.BLOCK, 2)) < 0.01, rng.integers(1, 10 ** (9 if k < 2 else 11), (cm.BLOCK, 2)), 0) for k in range(3)]
    total = np.zeros((cm.BLOCK, 2), dtype=np.int64)
    for c in counts:
        cm._unpack(cm._pack(c), total)
    assert (total == sum(counts)).all()


def test_nothing_to_learn_from(spark):
    out = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = cm.score_texts(documents(spark, [(out, "a b"), (None, "c")])).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in rows] == [(0, 0)] * 2 and all(r["base_score"] < 0.5 and r["score"] < 0 for r in rows)
    assert cm.score_texts(documents(spark, [(1, "a")]).limit(0)).count() == 0
