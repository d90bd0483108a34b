"""The secret scan: base spans against plain patterns, tags against a whole-chain search, quality on unseen texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from parley.llm import queries, secrets

PLAIN = (
    ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
WORD = re.compile(r"(\w+(?:[-+/.~]\w+)*)")
FILLER = "The cat sat on the mat, and it was 12 o'clock in Année 2021; then they went home again by the river road. "


def plain_base(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, group, least) in enumerate(PLAIN) for m in re.finditer(p, text) if m.end(group) - m.start(group) >= least]
    return [s for _, _, s in sorted(found)]


@pytest.fixture(scope="module")
def model():
    return secrets.fit_field([FILLER * 12] * 120)


@pytest.fixture(scope="module")
def tagger(model):
    return secrets.Tagger(model)


def test_base_spans_equal_plain_patterns(tagger):
    rng = random.Random(3)
    parts = ["token", "Token", "pass", "word", "passwd", "api", "_", "key", "ſecret", "secret", "\"", "'", " ", "  ", ":", "=", "abcdefgh", "x", "AKIA", "AKIA0123456789AB", "Z9", "0f" * 16, "é", "\n", "KelvinKey", "12"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        spans = [f"{k}:{a}:{b}" for a, b, k in secrets.spans_of(text, tagger)]
        assert [s for s in spans if not s.startswith("secret")] == plain_base(text)
    assert secrets.spans_of(None, tagger) == secrets.spans_of("", tagger) == []


def test_words_and_gaps_equal_a_plain_split(tagger):
    rng = random.Random(4)
    marks = ["a", "Bc", "9", "_", "-", "+", "/", ".", "~", " ", "\n", "=", ":", '"', "(", ",", "é", "ß", "日", "𝒳", "²", "́", "word", "Token", "API_KEY"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(600)]
    texts += ["a" * (secrets.BLOCK + 5) + " b-c " + "é=日本 x_1 " * 40_000, " " * secrets.BLOCK + "x", "--", "a", "\n"]
    for text in texts:
        starts, ends, classes, gaps = tagger.words(text)
        parts = WORD.split(text)
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == parts[1::2]
        if len(starts):
            assert gaps.tolist() == [secrets._gap_number(g) for g in parts[::2]]
            for w, c in {*zip(parts[1::2], classes.tolist(), strict=True)}:
                assert np.array_equal(tagger.scores[c], tagger.scores[tagger.classed(secrets._word(w))])


def test_viterbi_equals_all_chains():
    rng = np.random.default_rng(5)
    for _ in range(60):
        e, moves = rng.normal(size=(5, 3)).tolist(), rng.normal(size=(3, 3))

        def total(tags, e=e, moves=moves):
            path = [0, *tags, 0]
            return sum(moves[a, b] for a, b in itertools.pairwise(path)) + sum(row[t] for row, t in zip(e, tags, strict=True))

        assert secrets.best_tags(e, moves) == list(max(itertools.product(range(3), repeat=5), key=total))


def test_stretches_equal_the_whole_chain(tagger, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(secrets, "WORDS", 7)
    for _ in range(60):
        text, _ = secrets.written_into(FILLER * 5, rng, 6)
        starts, _, classes, gaps = tagger.words(text)
        whole = tagger.model.score(secrets._whole_text(gaps, tagger.digits[classes]))
        tags = secrets.best_tags(tagger.emissions(classes, gaps, whole, 0, len(starts)).tolist(), tagger.model.moves)
        assert tagger.tags(classes, gaps) == {i: t for i, t in enumerate(tags) if t}


def test_field_finds_what_patterns_miss(tagger):
    rng = random.Random(77)
    held = hit = wrong = 0
    for _ in range(80):
        text, spans = secrets.written_into(FILLER.replace("cat", "dog") * 8, rng, 5)
        found = [(a, b) for a, b, _ in secrets.spans_of(text, tagger)]
        held += len(set(spans))
        hit += sum(any(a < d and c < b for c, d in found) for a, b in set(spans))
        wrong += sum(k == "secret" and not any(a < d and c < b for c, d in spans) for a, b, k in secrets.spans_of(text, tagger))
    assert hit >= 0.9 * held and wrong <= 0.03 * held
    clean = "def load(path):\n    version = '1.12.3'\n    return read(path, token_count=12)  # see https://example.com/docs/a_long_page\n" * 3
    assert secrets.spans_of(clean, tagger) == []
    found = secrets.spans_of('client = connect("db", credential="Zx81kLq09TtPw7YbNv3mQ4")', tagger)
    assert [(k, b - a) for a, b, k in found] == [("secret", 22)]


def test_find_secrets_on_odd_rows(spark, model):
    rows = [(1, None, "a"), (1, "", "b"), (None, 'token = "' + "0f" * 20 + '"', "c"), (2, "x" * 200_000 + " " + "AKIA" * 9, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secret_spans string")
    found = secrets.find_secrets(spark, docs, model)
    assert found.columns == ["doc_id", "text", "secret_spans"]
    assert [r["secret_spans"] for r in found.collect()] == ["", "", "assign:0:49,hex:9:49", "access:200001:200037"]
    assert secrets.find_secrets(spark, docs.limit(0), secrets.train_secrets(docs.limit(0))).collect() == []


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secrets.BASE] == [sum(s.startswith(k) for s in base) for k in secrets.BASE]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("secret")] == base


@pytest.mark.parametrize("piece", ["token ", "token=", "AKIA", "a" * 31 + " ", "a-", '"=', "password" + " " * 50])
def test_time_is_linear(tagger, piece):
    import time

    def seconds(n):
        text = piece * (n // len(piece))
        start = time.perf_counter()
        secrets.spans_of(text, tagger)
        return time.perf_counter() - start

    seconds(50_000)
    assert seconds(1_000_000) < 25  # a quadratic scan takes minutes
