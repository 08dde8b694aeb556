"""Fields in contexts, budgets, keys and the classifier against plain versions."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillveil.operators import contexts as C
from quillveil.operators.features import classify


def test_recovered_fields(spark):
    rng = random.Random(4)
    words = lambda n: [rng.choice("a b c dd é".split()) for _ in range(n)]
    texts = {k: words(rng.randrange(12)) for k in range(30)}
    fields = {(q, f): (words(rng.randrange(4)), words(rng.randrange(2))) for q in range(10) for f in "xyz"}
    top = [(q, d) for q in range(10) for d in rng.sample(range(30), 3)]
    held = lambda p, t: bool(p) and any(t[i : i + len(p)] == p for i in range(len(t)))
    want = {(q, f): (sum(held(e, texts[d]) for x, d in top if x == q), sum(held(e, texts[d]) or held(c, texts[d]) for x, d in top if x == q)) for (q, f), (e, c) in fields.items()}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = C.recovered_fields(frame(top, "q long, doc long"), frame([(q, f, *v) for (q, f), v in fields.items()], "q long, field string, exact array<string>, coarse array<string>"), frame(list(texts.items()), "doc long, words array<string>"), "q", "doc")
    assert {(r.q, r.field): (r.exact_docs, r.coarse_docs) for r in got.collect()} == want
    for r in C.field_sets(got, "q").collect():
        assert r.exact == [f for f in "xyz" if want[r.q, f][0]] and r.lost == [f for f in "xyz" if not want[r.q, f][1]]
        assert sorted(r.exact + r.only_coarse + r.lost) == ["x", "y", "z"]


def test_budget_stops_at_the_first_part_that_does_not_fit(spark):
    rows = [(["aaaa", "bbb", "c"], 8), (["aaaa", "bbb", "c"], 6), ([], 5), (["toolong", "x"], 5), (["ab", "cd"], 4)]
    got = spark.createDataFrame(rows, "p array<string>, b int").select(*[C.budgeted(F.col("p"), b).alias(f"b{b}") for b in (4, 5, 6, 8)]).collect()
    for (parts, _), r in zip(rows, got, strict=True):
        for b in (4, 5, 6, 8):
            taken, used = [], 0
            for p in parts:
                if used + len(p) > b:
                    break
                taken, used = [*taken, p], used + len(p)
            assert r[f"b{b}"] == taken


def test_call_keys(spark):
    row = spark.createDataFrame([("a", "b", None)], "x string, y string, z string").select(C.call_key(F.col("x"), F.col("y")).alias("k"), C.call_key(F.lit("ab"), F.lit("")).alias("j"), C.call_key(F.col("x"), F.col("z")).alias("i")).first()
    assert row.k == hashlib.sha256(b"a\x1fb").hexdigest() and row.i == hashlib.sha256(b"a\x1f").hexdigest() and len({*row}) == 3


def softmax_fit(x, y, n, reg, rounds=4000):
    """Plain gradient descent on the same loss: mean cross-entropy and half the squared weights, the constant free."""
    w, b = np.zeros((x.shape[1], n)), np.zeros(n)
    one = np.eye(n)[y]
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 2.0 * (x.T @ (p - one) / len(x) + reg * w)
        b -= 2.0 * (p - one).mean(axis=0)
    return w, b


def test_classifier_equals_a_plain_softmax(spark):
    rng = random.Random(8)
    own = {"en": "the of and to in is".split(), "fr": "le de et la un est".split(), "es": "el de y la un es".split()}
    rows = []
    for k in range(90):
        lang = ["en", "fr", "es"][k % 3]
        rows.append((k, lang if k != 3 else None, [rng.choice(own[lang] if rng.random() < 0.6 else own["en"]) for _ in range(rng.randrange(1, 8))], k < 45))
    rows += [(200, "en", [], False), (201, "fr", None, False), (202, "de", ["zzz"], False)]
    df = spark.createDataFrame(rows, "id long, lang string, terms array<string>, fit boolean")
    got = {r.id: r.predicted for r in classify(df, "id", "terms", "lang", "fit", reg=0.01, rounds=200).collect()}
    grams = lambda t: [*(t or []), *(f"{a} {b}" for a, b in zip(t or [], (t or [])[1:]))]  # noqa: E731, B905
    train = [r for r in rows if r[3] and r[1]]
    df_of = {}
    for r in train:
        for g in set(grams(r[2])):
            df_of[g] = df_of.get(g, 0) + 1
    terms = sorted(g for g, c in df_of.items() if c >= 2)
    idf = {g: math.log((1 + len(train)) / (1 + df_of[g])) + 1 for g in terms}

    def row(t):
        g = grams(t)
        v = np.array([(1 + math.log(g.count(x))) * idf[x] if x in g else 0.0 for x in terms])
        return v / (np.linalg.norm(v) or 1)

    labels = sorted({r[1] for r in train})
    w, b = softmax_fit(np.array([row(r[2]) for r in train]), np.array([labels.index(r[1]) for r in train]), len(labels), 0.01)
    test = [r for r in rows if not r[3]]
    z = np.array([row(r[2]) for r in test]) @ w + b
    sure = np.sort(z, axis=1)[:, -1] - np.sort(z, axis=1)[:, -2] > 0.02
    assert set(got) == {r[0] for r in test} and sure.mean() > 0.8
    assert all(got[r[0]] == labels[k] for r, k, s in zip(test, z.argmax(axis=1), sure, strict=True) if s)
    assert {r.predicted for r in classify(df.where("not fit"), "id", "terms", "lang", "fit").collect()} == {None}
