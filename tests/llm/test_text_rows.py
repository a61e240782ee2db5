"""Operators that look at one document at a time, and packing."""

import dataclasses
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohort.llm import langid, licenses, packing, pii, stages, token_counts
from cohort.llm.tokens import VOCABULARY, encoder, vocabulary_path
from tests.llm.helpers import documents, rows_of

ODD = [(None, "no id"), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "wörd " * 30_000), (5, "\n\t \n"), (6, "a" * 50_000)]


def test_plain_identifiers_match_the_patterns():
    text = "a@b.c@d.e 1.2.3.4.5.6.7.8 x@y 256.1.1.1 +1 (988) 555-2485 or 4041894974608795 or 4041894974608796 me.2@mail-1.example.com."
    assert [(text[s:e], k) for s, e, k in pii.detect(text)] == [
        ("a@b.c", "email"), ("1.2.3.4", "ip"), ("5.6.7.8", "ip"), ("+1 (988) 555-2485", "phone"), ("4041894974608795", "card"), ("me.2@mail-1.example.com", "email"),
    ]


@pytest.mark.parametrize(("text", "span", "kind"), [
    ("mail bob.42 (at) mail.example (dot) com now", "bob.42 (at) mail.example (dot) com", "email"),
    ("write joe at mail dot example dot com please", "joe at mail dot example dot com", "email"),
    ("é аdmin@exаmple.com", "аdmin@exаmple.com", "email"),
    ("é call plus one five five five one two three four five six seven ok", "plus one five five five one two three four five six seven", "phone"),
    ("ip one nine two dot one six eight dot one dot one end", "one nine two dot one six eight dot one dot one", "ip"),
    ("n ＋1 (555) 555-2485", "＋1 (555) 555-2485", "phone"),
    ("zero​ width 1​0.0.0.1 x", "1​0.0.0.1", "ip"),
])
def test_disguised_identifiers_keep_their_places(text, span, kind):
    assert [(text[s:e], k) for s, e, k in pii.disguised(text, pii.detect(text))] == [(span, kind)]


@pytest.mark.parametrize("text", ["look at the dot on the map", "one two three", "un deux trois quatre", "plain words at home", "(at) (dot)", "5 six 7"])
def test_clean_texts_have_no_spans(text):
    assert pii.detect(text) == [] and pii.disguised(text, []) == []


def test_pii_rows(spark):
    got = rows_of(pii.find_pii(documents(spark, [*ODD, (9, "Ä a@b.co x (at) y.com")], extra=True)))
    row = next(r for r in got if r[0] == 9)
    assert row[5] == hashlib.sha256(b"email:2:8").hexdigest() and row[6] == "email:2:8,email:9:21" and row[7] == 1
    assert pii.find_pii(documents(spark, ODD).limit(0)).count() == 0


def test_license_rules_are_many_and_ordered():
    rules = licenses.rules()
    assert len(rules) > 300 and [r.rank for r in rules] == list(range(len(rules)))


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("SPDX-License-Identifier: MIT", ["mit"]),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", ["cc-by-sa-4.0"]),
    ("GPLv2 or BSD-3-Clause license", ["gpl-2.0", "bsd-3-clause"]),
    ("we commit to permits and limits", []),
])
def test_license_labels(text, labels):
    assert [d[2] for d in licenses.detections(text)] == labels


def _example(parts, rng):
    """A text that the parsed pattern matches, with its alternatives and repeats drawn at random."""
    out = ""
    for op, value in parts:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            kind, first = rng.choice(value)
            out += chr(first) if str(kind) == "LITERAL" else chr(rng.randint(*first)) if str(kind) == "RANGE" else {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "w"}[str(first)]
        elif name == "ANY":
            out += "/"
        elif name == "BRANCH":
            out += _example(rng.choice(value[1]), rng)
        elif name == "SUBPATTERN":
            out += _example(value[-1], rng)
        elif name == "MAX_REPEAT":
            least, most, inner = value
            out += "".join(_example(inner, rng) for _ in range(rng.randint(least, min(int(most), least + 2))))
        else:
            assert name == "ASSERT_NOT", name
    return out


def _ungated(text):
    kept = []
    for rule in licenses.rules():
        for m in rule.pattern.finditer(text.lower()):
            if not any(s <= m.start() and m.end() <= e for s, e, _, _ in kept):
                kept.append((m.start(), m.end(), rule.label, rule.score))
    return sorted(kept)


def test_license_keywords_lose_no_hit_of_a_rule():
    rng = random.Random(7)
    for rule in licenses.rules():
        for _ in range(6):
            text = _example(re._parser.parse(rule.pattern.pattern), rng)
            assert rule.pattern.search(text), (rule.pattern.pattern, text)
            assert licenses.detections(text) == _ungated(text) != [], text


def test_license_rules_run_only_where_they_can_hit(monkeypatch):
    """Texts without a keyword are not looked into, and rules do not run where literals of theirs are missing."""
    rng = random.Random(8)
    for rule in licenses.rules():
        text = _example(re._parser.parse(rule.pattern.pattern), rng)
        assert re.search(licenses.any_keyword(), text) and all(word in text for word in rule.needs), (rule.pattern.pattern, text)
    looked = []
    monkeypatch.setattr(licenses, "detections", lambda text: looked.append(text) or [])
    texts = [None, "", "a free text", "SUBMITTED", "\u212azlib", "Apache license"]
    rows = next(licenses._scan(iter([{"doc_id": [*range(6)], "text": texts}])))
    assert looked == texts[3:] and rows["n_words"] == [0, 0, 3, 1, 1, 2] and rows["n_base"] == [0] * 5 + [1]
    monkeypatch.undo()
    ran = []

    class Counted:
        def __init__(self, rule):
            self.rule = rule

        def finditer(self, low):
            ran.append((self.rule.label, self.rule.needs))
            return self.rule.pattern.finditer(low)

    counted = [dataclasses.replace(r, pattern=Counted(r)) for r in licenses.rules()]
    by_key = {key: [r for r in counted if key in r.keywords] for key in licenses._gate()[1]}
    monkeypatch.setattr(licenses, "_gate", lambda gate=licenses._gate()[0]: (gate, by_key))
    assert licenses.detections("a mit of vim, mpl 3") == [] and ran == []
    assert [d[2] for d in licenses.detections("a vim license")] == ["vim"] and ran == [("vim", ("licen",))] * 2
    assert {r.needs for r in licenses.rules() if r.label in ("cc-by-4.0", "gpl-2.0", "php-3.01", "sspl-1.0")} == {
        (), *((*form, *v) for form in [("under ",), ("licen",), ()] for v in [("4.0",), ("2",), ("3",), ()])}


@pytest.mark.parametrize(("text", "labels"), [
    ("Released under MIT.", ["mit"]),
    ("distributed under the BSD-3-Clause", ["bsd-3-clause"]),
    ("available under ISC", ["isc"]),
    ("provided under MS-PL, published under WTFPL", ["ms-pl", "wtfpl"]),
    ("0BSD", ["bsd-0"]),
    ("a note on MIT-0", ["mit-0"]),
    ("x11", ["x11"]),
    ("ECL 2.0 and AFL 3.0", ["ecl-2.0", "afl-3.0"]),
    ("CC-0 1.0, CC 0", ["cc0-1.0", "cc0-1.0"]),
    ("released under Open RAIL-M", ["openrail"]),
])
def test_license_labels_without_a_common_word(text, labels):
    assert [d[2] for d in licenses.detections(text)] == labels


def test_license_rows(spark):
    got = rows_of(licenses.scan_licenses(documents(spark, [*ODD, (9, "The MIT-License; the Apache\nlicense, mit license")], extra=True)))
    row = next(r for r in got if r[0] == 9)
    assert row[1:6] == (8, 3, 1, 6, "apache,mit") and set(row[6].split(",")) >= {"apache", "mit"} and 0 < row[7] <= 1
    assert next(r for r in got if r[0] == 1)[1:] == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan_licenses(documents(spark, ODD).limit(0)).count() == 0


TEXTS = ["a  b\n\n c\n d  \n", " lead", "x y  z", "it's  don't\tq", "", "  ", "<|endoftext|> a<|endoftext|>b", "\x1c a\x1fb", "٣٤ é日本 ​ x", " " * 5000 + "x", "ab" * 5000]


def test_ranks_give_the_ids_of_the_tokenizer():
    whole = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    for text in TEXTS:
        assert encoder().encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_places_every_piece(spark):
    rng = random.Random(4)
    rows = [*ODD, *[(100 + n, " ".join(rng.choice(["alpha", "be", "gamma9"]) for _ in range(rng.choice([3, 40, 900])))) for n in range(60)], (7, "cut me " * 3000)]
    got = packing.pack(documents(spark, rows, extra=True)).collect()
    whole = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    expected = Counter()
    for (doc_id, _), own in zip(rows, ids, strict=True):
        first = len(own) % 2048 or 2048
        cuts = [0, *range(min(first, len(own)), len(own) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, n, a, b - a, zlib.crc32(np.array(own[a:b], dtype="<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(documents(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    lengths = rng.choice(np.arange(1, capacity + 1), size=int(rng.integers(1, capacity)), replace=False)
    counts = {int(n): int(rng.integers(1, 40)) for n in lengths}
    used = {}
    for length, first, sequence, each, offset in packing.plan(counts, capacity).tolist():
        used[length, first] = (sequence, each, offset)
    room = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        open_ = [n for n, r in enumerate(room) if r >= length]
        if open_:
            room[min(open_, key=lambda n: room[n])] -= length
        else:
            room.append(capacity - length)
    last = max(s + max(0, (c - 1) // e) for (n, f), (s, e, _) in used.items() for c in [min([g for m, g in used if m == n and g > f], default=counts[n]) - f])
    assert last + 1 == len(room)


def test_token_trees_count_like_the_whole_text():
    count, rng = encoder().count, random.Random(2)
    parts = ["a", "word ", "  ", "\n", " é", "it's ", "9 ", "\t x", " the", " \n ", " ", "hello", "…"]
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        tree = token_counts.TokenTree.of(text, count, rng.choice([1, 3, 8, 20]))
        assert tree.total == count(text)
        for _ in range(rng.randint(0, 6)):
            start, removed = rng.randint(-2, len(text) + 3), rng.randint(0, rng.choice([0, 3, 30]))
            inserted = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
            at = min(max(0, start), len(text))
            text = text[:at] + inserted + text[min(len(text), at + removed) :]
            tree.edit(start, removed, inserted)
            assert tree.text == text and tree.total == count(text) == sum(tree.tokens[tree.width :])


def test_an_edit_encodes_its_surroundings_only():
    tree = token_counts.TokenTree.of("some words here " * 5000, encoder().count)
    tree.encoded = 0
    tree.edit(40_000, 3, "new")
    assert 0 < tree.encoded < 2000


def test_token_counts_through_edits(spark):
    rows = [*ODD, (9, "one two three four five " * 100)]
    got = {r["doc_id"]: r for r in token_counts.count_through_edits(documents(spark, rows, extra=True), token_counts.sample_edits()).collect()}
    for doc_id, text in rows:
        text, before = text or "", encoder().count(text or "")
        size = len(text)
        for start, removed, inserted in ((size // 3, 4, text[:24]), (size // 2, 30, ""), (size - size // 5, 0, " [a note of 2024]")):
            at = min(start, len(text))
            text = text[:at] + inserted + text[min(len(text), at + removed) :]
        assert (got[doc_id]["n_tokens"], got[doc_id]["n_tokens_edited"], got[doc_id]["n_chars_edited"]) == (before, encoder().count(text), len(text))
    trees = token_counts.build_trees(documents(spark, rows))
    edits = spark.createDataFrame([(9, 1, 5, 3, "zzz"), (9, 0, 0, 2, ""), (77, 0, 1, 1, "q"), (1, 0, 0, 0, None)], "doc_id long, nth int, start long, removed long, inserted string")
    after = {r["doc_id"]: r for r in token_counts.edit_trees(trees, edits).collect()}
    text = rows[-1][1][2:]
    text = text[:5] + "zzz" + text[8:]
    assert "".join(after[9]["leaves"]) == text and after[9]["n_tokens"] == encoder().count(text) and after[1]["n_tokens"] == 0


def test_languages_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(table.filter(~langid.held_out()))
    got = langid.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert len(got) > 250 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, "the words of this text", "en"), (2, "die wörter dieses textes", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "", None), (None, "the text", "en"), (6, "some words", None), (1, "the words of this text", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(table, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in ("en", "de")
    assert langid.keep_determined(table, model).count() == 5
    empty = langid.fit(table.limit(0))
    assert {r["lang_pred"] for r in langid.predict(table, empty).collect()} == {"und"}


def test_documents_stay_when_no_row_has_a_label(spark):
    rows = [(1, "the words", None), (2, None, None), (3, "", None), (4, "12 !?", None), (None, "é", None), (6, "слово", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in stages.language_id(spark, table, "").collect()) == ["the words", "é", "слово"]
    assert stages.language_id(spark, table.limit(0), "").count() == 0
