"""Personal data, language, toxicity, licences and packing against plain versions, round trips and held-out rows."""

import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import langid, licenses, packing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"
ODD = [(None, "no id"), (1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "word. " * 60_000), (6, "\U0001f600 é ß \x00")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated rows, and columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in ODD], f"{KIND}, ids string, n int, score string")


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    """The base kinds by scanning with their patterns."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1]))
            ok = {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


FRAGMENTS = st.sampled_from(["a", "Z", "@", ".", "-", " ", "+", "(", ")", "0", "7", "255", "256", "4111111111111111", "x@y.zz", "1.2.3.4", "+1 (222) 555-0100", "é", "\n", "_", "%", "0000000000000000"])


@settings(max_examples=600, deadline=None)
@given(st.lists(FRAGMENTS, max_size=24).map("".join))
@example("a@b.c@d.e")
@example("1.2.3.4.5.6.7.8.9")
@example("300.1.1.1.1.1.1")
@example("9" * 5000 + ".1.1.1")
@example("+12 345 678 901-")
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.spans_of(text) if s[2] in pii.BASE] == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(FRAGMENTS, max_size=16).map("".join))
def test_redaction_leaves_nothing(text):
    assert pii.spans_of(pii.redacted(text)) == []


def test_added_spans():
    text = "see https://user.example.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no 99-1234-77, token = \"2abc3f\" password is long"
    assert [(k, text[a:b]) for a, b, k in pii.spans_of(text) if k not in pii.BASE] == [
        ("url", "https://user.example.org/a?b=1"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "99-1234-77"), ("account", "2abc3f"),
    ]


def test_pii_frames(spark, odd):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == len(ODD) and {r["pii_spans"] for r in rows} == {""}
    assert pii.find_pii(odd).columns == [*odd.columns, "pii_spans"]
    assert [r["text"] for r in pii.redact_pii(odd).collect()] == [t for _, t in ODD]
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in spans) for k in pii.BASE]
        everything = pii.spans_of(texts[r["doc_id"]])
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k in everything) and r["n_spans"] == len(everything)


def slow_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(slow_ids, "of"):
        slow_ids.of = Tokenizer.from_file(queries.tokenizer_path())
    return slow_ids.of.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "\t", "'s", "'RE", "don't", "x1", "éa", "　", " ", "\U0001f600", "٣", "<|", "日本"]), max_size=12).map("".join))
def test_both_readers_give_the_same_ids(text):
    assert list(packing.encoder(queries.tokenizer_path())(text)) == slow_ids(text)


def check_pieces(rows, texts, length):
    """Round trip: pieces give each document back, and fill sequences without gaps."""
    by_place = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in by_place:
        assert (r["sequence_id"], r["offset"]) == divmod(at, length) and 0 < r["length"] <= length - r["offset"] and len(r["ids"]) == 4 * r["length"]
        at += r["length"]
    got, open_ = [], None
    for r in by_place:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        if r["start"] == 0:
            open_ = (r["doc_id"], [])
            got.append(open_)
        assert r["doc_id"] == open_[0] and r["start"] == len(open_[1])
        open_[1].extend(ids)
        if len(open_[1]) == r["doc_tokens"]:
            assert open_[1][-1] == 0
    return sorted(map(str, got)) == sorted(str((i, [*slow_ids(t or ""), 0])) for i, t in texts)


def test_packing_round_trip(spark, odd):
    assert check_pieces(packing.pack(spark, odd.repartition(3), queries.tokenizer_path(), 64).collect(), ODD, 64)
    assert packing.pack(spark, odd.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = packing.pack(spark, docs, queries.tokenizer_path()).collect()
    assert check_pieces(pieces, texts, 1024)
    digests = sorted((r["doc_id"], r["start"], zlib.crc32(r["ids"]), r["sequence_id"]) for r in pieces)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"]) for r in queries.op8_packing(spark, SF).collect()) == digests


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op10_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    model = langid.train_language_model(docs)
    got = langid.identify_language(spark, odd.withColumn("lang", F.lit("q")), model).collect()
    assert len(got) == len(ODD)
    for r, (_, text) in zip(got, ODD, strict=True):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
    assert langid.train_language_model(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.identify_language(spark, odd, None).collect()} == {"und"}


def plain_language(text, model):
    """The likeliest language and its probability, one subword at a time."""
    codes = [c if c.isalpha() else " " for c in f" {(text or '').lower()} "]
    sums, n_all = np.zeros(langid.DIM), 0
    for n in langid.LENGTHS:
        for i in range(len(codes) - n + 1):
            part = codes[i : i + n]
            if " " in part[1:-1] or part[0] == part[-1] == " ":
                continue
            h = ord(part[0])
            for c in part[1:]:
                h = (h * 0x01000193 ^ ord(c) * 0x85EBCA6B) % 2**32
            sums, n_all = sums + model.vectors[(h + n) * 0x9E3779B1 % 2**32 >> 32 - langid.BITS], n_all + 1
    if not n_all:
        return "und", 0.0
    z = model.weights @ (sums / n_all) / model.temperature
    e = np.exp(z - z.max())
    return model.langs[int(e.argmax())], float(e.max() / e.sum())


def test_language_scores_are_those_of_the_plain_version(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train_language_model(docs)
    rows = docs.select("doc_id", F.substring("text", 1, 1500).alias("text")).unionByName(odd.where("doc_id <> 5 or doc_id is null").select("doc_id", "text"))
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    got = langid.identify_language(spark, spark.createDataFrame(texts, KIND), model).collect()
    for r, (i, text) in zip(got, texts, strict=True):
        lang, score = plain_language(text, model)
        assert (r["doc_id"], r["lang_pred"], r["score"]) == (i, lang, pytest.approx(score, abs=1e-6))


def test_language_of_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert langid.train_language_model(docs.limit(0)) is None
    assert langid.identify_language(spark, odd.limit(0), None).count() == 0
    again = docs.unionByName(docs.withColumn("text", F.lit("another text"))).unionByName(docs.withColumn("lang", F.lit("zz")))
    a, b = (langid.train_language_model(again.repartition(n)) for n in (2, 5))
    assert a.langs == b.langs and np.array_equal(a.vectors, b.vectors) and np.array_equal(a.weights, b.weights)  # whichever row comes first


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 2000)
    word = lambda i: "".join(chr(97 + (i * p) % 26) for p in (1, 3, 7, 11, 17)) + chr(0x4E00 + i)
    rows = [(k * 1000 + i, f"{word(i)} {word(i)}x {word(i)}", f"l{i:04}") for i in range(1000) for k in range(3)]
    model = langid.train_language_model(spark.createDataFrame(rows, f"{KIND}, lang string"), epochs=12)
    assert len(model.langs) == 1000 and model.weights.shape == (1000, langid.DIM) and model.vectors.nbytes == 4 << 20
    few = spark.createDataFrame([(i, f"x{t}", l) for i, (_, t, l) in enumerate(rows[:60] * 5)], f"{KIND}, lang string")
    model = langid.train_language_model(few, epochs=30)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(spark, few, model).collect()}
    assert sum(got[i] == rows[i % 60][2] for i in got) >= 0.95 * len(got)


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    text = "Ein Wort, zwei Wörter; drei."
    whole = np.sort(np.concatenate(list(langid._subwords(text))))
    monkeypatch.setattr(langid, "CHUNK", 5)
    assert np.array_equal(np.sort(np.concatenate(list(langid._subwords(text)))), whole)


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = ([s for y, s in held if y == v] for v in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) >= 0.85 * len(bad) * len(good)
    assert sum(s >= 0.7 for s in good) <= 0.03 * len(good)
    none = toxicity.train_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_toxicity(spark, odd, none).collect()} == {0.0}


def plain_toxicity(text, model):
    """The noisy-or of all sentences' scores, calibrated."""
    clean = 1.0
    for sentence in re.findall(r"[^.!?\n]+[.!?]*", text or ""):
        words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
        z = model.bias + sum(model.words.get(w, 0) + sum(model.beginnings.get(w[:n], 0) for n in toxicity.PREFIXES if len(w) >= n) for w in words)
        clean *= 1 - 1 / (1 + math.exp(-z))
    odds = max(-30.0, min(30.0, math.log((1 - clean) / clean))) if 0 < clean < 1 else (-30.0 if clean == 1 else 30.0)
    return 1 / (1 + math.exp(-(model.slope * odds + model.shift)))


def test_toxicity_scores_are_those_of_the_plain_version(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train_toxicity(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    more = ["", None, "\u03a3\u03a3.\u03a3a \u0130x", *(f"{w}. {w.upper()}!{w}x\n" for w in model.words), *(f"x {w}abc; {w}" for w in model.beginnings)]
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100_000 + i, t) for i, t in enumerate(more)]
    got = toxicity.score_toxicity(spark, spark.createDataFrame(texts, KIND), model).collect()
    assert [r["score"] for r in got] == pytest.approx([plain_toxicity(t, model) for _, t in texts], abs=1e-7)
    assert sum(r["score"] >= 0.7 for r in got) > 10


def test_toxicity_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    empty = toxicity.train_toxicity(odd.limit(0), labels)
    assert empty.prior == 0.0 and toxicity.score_toxicity(spark, odd.limit(0), empty).count() == 0
    twice = odd.unionByName(odd.withColumn("text", F.lit("a second text")))
    models = [toxicity.train_toxicity(twice.repartition(n), labels) for n in (2, 5)]
    assert models[0] == models[1]
    assert len(toxicity.score_toxicity(spark, odd, models[0]).collect()) == len(ODD)


def test_offending_sentences(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=5))
    rows = []
    for i in range(600):
        sentences = [" ".join(word() for _ in range(6)) for _ in range(8)]
        if i % 3 == 0:
            sentences[i % 8] += " vileword indeed"
        rows.append((i, ". ".join(sentences) + "."))
    docs = spark.createDataFrame(rows, KIND)
    model = toxicity.train_toxicity(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int"))
    scored = toxicity.score_toxicity(spark, docs, model).collect()
    for r, (i, text) in zip(scored, rows, strict=True):
        assert (r["score"] >= 0.5) == (i % 3 == 0)
        assert all("vileword" in text[s["start"] : s["end"]] for s in r["offending"]) and bool(r["offending"]) == (i % 3 == 0)
    again = docs.withColumn("s", toxicity.toxic_score(spark, F.col("text"), model)).collect()
    assert [r["s"] for r in again] == pytest.approx([r["score"] for r in scored])


def bucket(*words):
    """A gram's place by the hash that Spark's xxhash64 is built on."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h % licenses.BUCKETS


def plain_scan(text, model):
    """Paragraphs that reach the least probability, and licence families, one paragraph at a time, all in full."""
    families, known, own = set(), 0, licenses.own_pairs()
    place = {int(b): i for i, b in enumerate(model.buckets)}
    for p in (n for x in re.split(r"[\r\n]+", text or "") if x.strip() for n in licenses.notices_of(x)):
        words = licenses.words_of(p)
        grams = {bucket(w) for w in words} | {bucket(*ws) for ws in zip(words, words[1:], strict=False)}
        z = (model.bias + sum((model.weights[place[g]] for g in sorted(grams) if g in place), np.zeros(len(model.classes)))) / model.temperature
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = 1 + int(np.argmax(z[1:]))
        if q[best] < model.least:
            continue
        known += 1
        family, pairs, near = model.classes[best], licenses.pairs_of(p), 0.0
        for t in licenses.TEMPLATES[family]:
            of = licenses.pairs_of(t)
            alone = of & own[family]
            near = max(near, len(pairs & alone) / max(1, len(alone)), len(pairs & of) / max(1, len(pairs)) if len(pairs & alone) > 1 else 0)
        if near >= 0.5 and not (family in licenses.FURTHER_OF and pairs & set(licenses.further_pairs())):
            families.add(family)
    return known, ",".join(sorted(families))


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.train_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def scanned(spark, texts, model):
    rows = licenses.scan_licenses(spark, spark.createDataFrame(list(texts), KIND), model).collect()
    return {r["doc_id"]: (r["n_known"], r["families"]) for r in rows}


def test_licenses(spark, odd, license_model):
    model = license_model
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    templates = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    others = licenses.OTHERS + licenses.OTHER_TEXTS + [w.format(n) for n in licenses.OTHER_NAMES + licenses.FURTHER_NAMES for w in licenses.WORDINGS]
    more = [f"Some words.\n{t}\nmore" for _, t in templates] + others
    texts += [(100_000 + i, t) for i, t in enumerate(more)]
    got = scanned(spark, texts, model)
    assert got == {i: plain_scan(t, model) for i, t in texts}
    assert [got[100_000 + i][1] for i in range(len(templates))] == [f for f, _ in templates]
    assert {got[100_000 + len(templates) + i][1] for i in range(len(others))} == {""}
    assert sum(bool(f) for i, (_, f) in got.items() if i < 100_000) > 20
    rows = licenses.scan_licenses(spark, odd, model).collect()
    assert len(rows) == len(ODD) and {(r["n_known"], r["families"], r["probability"]) for r in rows} == {(0, "", 0.0)}
    twice = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, "Released under the MIT License.")], KIND)
    assert [(r["n_known"], r["families"]) for r in licenses.scan_licenses(spark, twice, model).collect()] == [(1, "mit")] * 3
    assert licenses.scan_licenses(spark, odd.limit(0), model).count() == 0


def test_calibration_is_inside_its_range(license_model):
    assert 0.3 < license_model.temperature < 15 and 0.5 <= license_model.least <= 0.95


#: Wordings that are no templates; families as a reader would name them.
NOTICES = [
    ("", "This project is released under the ISC license."), ("", "Distributed under the Boost Software License"), ("", "Licensed under the Eclipse Public License"),
    ("", "// SPDX-License-Identifier: ISC"), ("", "License: EPL-2.0"), ("", "This code is under the Foo Bar License."), ("", "Use it under the terms of the zlib license."),
    ("", "Licensed under the GNU Affero General Public License v3"), ("", "She teaches at MIT."), ("", "My driving license says otherwise."),
    ("mit", "main.js SPDX-License-Identifier: MIT"), ("bsd", "main.py SPDX-License-Identifier: BSD-3-Clause"), ("gpl", "Package license: GPLv3"), ("gpl", "Released under GPL-3.0."),
    ("gpl", "Distributed under the terms of GPL-3.0, see the file COPYING."), ("lgpl", "Declared license: LGPL-2.1"), ("apache", "Code is made available under Apache-2.0"),
    ("cc-by", "Published under CC BY 4.0"), ("cc-by-sa", "Published under CC BY-SA 4.0"), ("mit", "The MIT License (MIT)"), ("proprietary", "Copyright (c) 2020 Jane Doe. All rights reserved."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO'),
    ("proprietary", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
    ("mit", "of this software and associated documentation files, to deal in the Software without restriction"),
]


def test_notices_that_are_no_templates(spark, license_model):
    known = {" ".join(licenses.words_of(t)) for ts in licenses.TEMPLATES.values() for t in ts}
    assert not any(" ".join(licenses.words_of(t)) in known for _, t in NOTICES)
    got = scanned(spark, [(i, f"before\n{t}\nafter") for i, (_, t) in enumerate(NOTICES)], license_model)
    assert [(got[i][1], t) for i, (_, t) in enumerate(NOTICES)] == NOTICES


def test_further_parts_and_several_licences(spark, license_model):
    """Further conditions make another licence; a choice names each of its licences."""
    cases = [
        ("", "Licensed under CC BY-NC-SA 4.0."), ("", "CC BY-NC-ND 4.0"), ("", "This work is licensed under a CC BY-ND 4.0."), ("", "License: CC-BY-NC-SA-4.0"),
        ("", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."), ("", "Licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
        ("cc-by-nc", "This work is licensed under a CC BY-NC 4.0."), ("cc-by-sa", "Licensed under CC BY-SA 4.0."), ("cc-by", "Released under the CC BY 4.0."),
        ("apache,mit", "SPDX-License-Identifier: Apache-2.0 OR MIT"), ("apache,mit", '"license": "(MIT OR Apache-2.0)",'), ("apache,bsd,mit", "// SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)"),
        ("mit", "License: MIT OR EPL-2.0"), ("apache,mit", "Licensed under either of Apache License, Version 2.0 or MIT License at your option."), ("", "License: ISC or Zlib"),
    ]
    texts = [(i, f"before\n{t}\nafter or before") for i, (_, t) in enumerate(cases)]
    got = scanned(spark, texts, license_model)
    assert [(got[i][1], t) for i, (_, t) in enumerate(cases)] == cases
    assert got == {i: plain_scan(t, license_model) for i, t in texts}
    long = "license: a" + " or b" * 20_000
    start = time.perf_counter()
    assert len(licenses.notices_of(long)) == 20_001
    odd = ["license: " * 20_000, "under either " * 20_000, "under either x" + " " * 200_000 + "y", "under either of the MIT License" + " or" * 50_000]
    assert [len(licenses.notices_of(t)) for t in odd] == [1, 1, 1, 2]
    assert scanned(spark, [(1, long), *enumerate(odd, 2)], license_model).keys() == {1, 2, 3, 4, 5}
    assert time.perf_counter() - start < 60


def test_licenses_cut_out(spark, license_model):
    """Pieces of templates against all paragraphs' decisions in full."""
    cut = [w[at : at + n] for ts in licenses.TEXTS.values() for t in ts for w in [t.split()] for n in (3, 5, 8, 12) for at in range(0, max(1, len(w) - n), 3)]
    texts = [(i, f"before\n{' '.join(words)}\nafter\n\n{' '.join(words)}") for i, words in enumerate(cut)]
    assert scanned(spark, texts, license_model) == {i: plain_scan(t, license_model) for i, t in texts}


@pytest.mark.parametrize("after", [" BIC COBADEFF", " Please pay", " 2024", " A", "", ".", " 1", "X"])
@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19"])
def test_iban_before_capitals_and_digits(iban, after):
    text = f"IBAN: {iban}{after}"
    assert (6, 6 + len(iban), "iban") in pii.spans_of(text)
    assert pii.redacted(text).startswith("IBAN: <IBAN>")
    assert not any(k == "iban" for _, _, k in pii.spans_of("IBAN: DE88 3704 0044 0532 0130 00 BIC COBADEFF"))


@pytest.mark.parametrize("before", ["", "\u0130\u0130 \U0001f600 "])
@pytest.mark.parametrize("cue", ["API key", "Api Key", "User ID", "Customer ID", "user ID", "customer ID", "API_key", "passWord", "iBAN"])
def test_cues_whatever_their_case(cue, before):
    text = f"{before}{cue}: 9f8e7d6c5b and more"
    at = len(before) + len(cue) + 2
    assert pii.spans_of(text) == [(at, at + 10, "account")]
    assert pii.redacted(text) == f"{before}{cue}: <ACCOUNT> and more"


def test_long_schemes():
    url = "com.example.mobile.application.callback+v2://open/x1"
    assert pii.spans_of(f"see {url}, then {url}.") == [(4, 4 + len(url), "url"), (11 + len(url), 11 + 2 * len(url), "url")]
    assert pii.spans_of(f"{'9' * 30}{url}")[-1][1:] == (30 + len(url), "url")


def test_pii_cues_in_any_spelling():
    for text, value in (
        ("user_id: 48213344", "48213344"), ("customer_id=4821334", "4821334"), ("user-id: 48213344", "48213344"), ("api-key: 9f8e7d6c5b", "9f8e7d6c5b"), ("apikey=9f8e7d6c5b", "9f8e7d6c5b"),
        ("account number is 12345678", "12345678"), ("My USER ID 48213344", "48213344"),
    ):
        assert [text[a:b] for a, b, k in pii.spans_of(text) if k == "account"] == [value]
    assert pii.spans_of("tokens and accounts are counted, the secret garden") == []


@pytest.mark.parametrize("piece", ["1://", "a://", "://", "a@", "a.b@c", "+1(", "1.1.1.", "11 ", "1-", "token=", "token/abcde ", "iban AB12", "user_id ", "http", "a.", "account number is "])
def test_pii_takes_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    pii.spans_of(text)
    assert time.perf_counter() - start < 10  # a quadratic scan takes minutes


def test_pii_base_columns_equal_sql(spark):
    """The fixed kinds in DuckDB: a match's place follows from the pieces between matches."""
    sf = "/root/testdata/sf0.01"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda p: p::HUGEINT <= 255))"),
        "card": (r"[0-9](?:[ -]?[0-9])+", "len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT ELSE d[-i]::INT * 2 - 9 * (d[-i]::INT > 4)::INT END)) % 10 = 0"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "len(d) BETWEEN 9 AND 15"),
    }
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS k, start, '{kind}:' || start || ':' || (start + len(m)) AS span FROM (
            SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
                (list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT AS start
            FROM (SELECT doc_id, ms, pieces, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
                  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS pieces FROM docs))) WHERE {check}"""
        for i, (kind, (pattern, check)) in enumerate(kinds.items())
    )
    sql = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM '{sf}/documents.parquet'), found AS ({found})
        SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{kind}" for i, kind in enumerate(kinds))},
            sha256(coalesce(string_agg(span, ',' ORDER BY start, k), '')) AS base_sha256 FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
    got = queries.op2_pii(spark, sf).select("doc_id", *(f"n_{k}" for k in kinds), "base_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall()) and any(r["n_card"] for r in got)
