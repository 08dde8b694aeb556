"""Dictionaries, class sums, nearest rows by fields, linkage rounds and rank counts against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillveil.operators import kanon as K
from quillveil.operators import linkage as L
from quillveil.operators import neighbours as N
from quillveil.operators import patterns as P
from quillveil.operators import tfidf as I


def test_phrases_in_texts(spark):
    rng = random.Random(1)
    texts = [(k, "".join(rng.choice("ab cé") for _ in range(rng.randrange(60)))) for k in range(80)] + [(80, None), (81, ""), (1, "ab ab")]
    phrases = ["".join(rng.choice("ab cé") for _ in range(rng.randrange(5))) for _ in range(300)] + [None, ""]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in phrases], "p string")
    want = sorted((i, x) for i, t_ in texts for x in set(phrases) if x and t_ and x in t_)
    for most in (1 << 20, 4000):  # one automaton, and several
        assert sorted(map(tuple, P.phrases_in(t, ["id"], "text", p, "p", most_bytes=most).collect())) == want
    assert P.phrases_in(t, ["id"], "text", p.limit(0), "p").count() == 0
    assert P.phrases_in(t.limit(0), ["id"], "text", p, "p").count() == 0


def test_all_handle_patterns(spark):
    text = "PERSON_A1 email_x9, phone_77 (account_q) City_12 ORG_003 ACCT-99 me.x-y@some-place.org (212) 555-0199 xcity_12 org_x city_ acct- person_"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(P.handles(F.col("t")).alias("h")).collect()
    assert sorted(got[0].h) == sorted("handle::" + x for x in ["person_a1", "email_x9", "phone_77", "account_q", "city_12", "org_003", "acct-99", "me.x-y@some-place.org", "(212) 555-0199", "person_"][:9])
    assert got[1].h is None


@pytest.mark.parametrize("often", [2, 5, 1000])
def test_class_sums_give_all_scores(spark, often):
    rng = random.Random(often)
    sets = {k: {f"t{int(20 * rng.random() ** 3)}" for _ in range(rng.randrange(1, 6))} for k in range(60)}
    idf = {f"t{k}": 1 + 0.1 * k for k in range(21)}
    terms = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id long, term string")
    model = spark.createDataFrame(list(idf.items()), "term string, idf double")
    members, classes, light, heavy = P.term_classes(terms, "id", model, often)
    got = {(r.a, r.b): r.score for r in P.row_scores(members, "id", P.class_scores(classes, light, heavy)).collect()}
    norm = lambda s: math.sqrt(sum(idf[t] ** 2 for t in s))
    want = {(a, b): sum(idf[t] ** 2 for t in sets[a] & sets[b]) / norm(sets[a]) / norm(sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    most = {}
    for r in classes.join(light, F.col("class") == F.col("a")).groupBy("a").count().collect():
        most[r.a] = r["count"]
    if often == 2:
        assert not most  # nothing meets by the inverted index when every shared term is heavy


@pytest.mark.parametrize("lot", [1, 8, 100])
def test_nearest_by_fields(spark, lot):
    rng = random.Random(lot)
    weights = {"a": 1.5, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0}
    rows = [(k, *[rng.choice([0, 0, 0, 1, 2, None]) for _ in weights]) for k in range(40)] + [(k, 9, 9, 9, 9, 9) for k in range(40, 60)]
    place = lambda k: int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:12], 16)
    want = set()
    for i, *x in rows:
        cands = sorted((-sum(w for w, p, q in zip(weights.values(), x, y, strict=True) if p is not None and p == q), (place(j) - place(i)) % (1 << 48), j) for j, *y in rows if j != i)
        want |= {(i, j, -o, n + 1) for n, (o, _, j) in enumerate(cands[:4])}
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, d int, e int")
    assert {tuple(r) for r in N.nearest_by_fields(df, "id", weights, 4, most_masks=lot).collect()} == want
    assert N.nearest_by_fields(df.limit(0), "id", weights, 4).count() == 0
    assert N.nearest_by_fields(df.limit(1), "id", weights, 4).count() == 0


def test_masks_fall_in_weight():
    lots = N.agreement_masks({"a": 1.5, "b": 1.0, "c": 1.0}, 2)
    assert sorted(m for _, ms in lots for m in ms) == sorted({(), ("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")})
    assert [w for w, _ in lots] == sorted((w for w, _ in lots), reverse=True)


@pytest.mark.parametrize("few", [512, 9])
def test_linkage_rounds_equal_the_greedy_loop(spark, few):
    rng = np.random.default_rng(6)
    rows = [(100 * g + k, g, int(rng.integers(0, 4)), rng.normal(size=5).tolist()) for g in range(2) for k in range(25)]
    df = spark.createDataFrame(rows, "id long, tier long, label int, v array<double>")
    got = defaultdict(lambda: defaultdict(set))
    for r in L.fixed_k_clusters(df, "tier", "id", "v", "label", few).collect():
        got[r.tier][r.cluster].add(r.id)
    for g in range(2):
        own = [r for r in rows if r[1] == g]
        x = np.array([r[3] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        labels = L.average_linkage(np.rint(np.clip(1 - np.round(x @ x.T, 9), 0, 1) * 1e9), len({r[2] for r in own}))
        assert sorted(map(sorted, got[g].values())) == sorted(sorted(own[i][0] for i in np.flatnonzero(labels == c)) for c in set(labels))


@pytest.mark.parametrize("few", [512, 1])
def test_every_merge_is_of_a_nearest_pair(spark, few):
    """With many ties: in order of height every merge joins clusters that no pair is nearer than."""
    rng = np.random.default_rng(2)
    n = 24
    d = np.triu(rng.integers(0, 4, (n, n)), 1)
    d = (d + d.T).astype(float)
    d[:6, :6] = 0  # copies
    pairs = spark.createDataFrame([(0, i, j, int(d[i, j]), 1) for i in range(n) for j in range(i + 1, n)], "tier int, a long, b long, s long, m long")
    found = sorted(L.merges(pairs, "tier", few).collect(), key=lambda r: (r.d, r.round))
    assert len(found) == n - 1 and (few > 1 or max(r.round for r in found) < 14)
    groups = {i: [i] for i in range(n)}
    for r in found:
        means = {(a, b): d[np.ix_(groups[a], groups[b])].mean() for a in groups for b in groups if a < b}
        assert means[r.a, r.b] == pytest.approx(r.d) and r.d == pytest.approx(min(means.values()))
        groups[r.a] += groups.pop(r.b)


def test_vectors_without_direction_stand_alone(spark):
    rows = [(1, 0, 1, [1.0, 0.0]), (2, 0, 1, [0.9, 0.1]), (3, 0, 2, [0.0, 1.0]), (4, 0, 2, [0.0, 0.0]), (5, 0, 2, None), (6, 1, 1, [1.0, 1.0])]
    got = {r.id: r.cluster for r in L.fixed_k_clusters(spark.createDataFrame(rows, "id long, tier long, label int, v array<double>"), "tier", "id", "v", "label").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_first_relevant_counts_ranks(spark):
    rng = random.Random(3)
    scored = [(q, d, rng.choice([0.1, 0.2, 0.3])) for q in range(6) for d in range(30) if rng.random() < 0.7]
    relevant = [(q, d) for q in range(5) for d in rng.sample(range(30), 3)]
    want = {}
    for q in range(6):
        order = [d for s, d in sorted((-s, d) for x, d, s in scored if x == q)]
        hits = [n + 1 for n, d in enumerate(order) if (q, d) in relevant]
        if hits:
            want[q] = (hits[0], len(hits))
    for most in (10, 0):  # broadcast, and joined
        got = I.first_relevant(spark.createDataFrame(scored, "q long, d long, score double"), spark.createDataFrame(relevant, "q long, d long"), ["q"], "d", most)
        assert {r.q: (r.first_rank, r.total) for r in got.collect()} == want


def test_passages_of_any_length(spark):
    from quillveil.plans.text import passages_held

    docs = [(1, "one two three four five six seven"), (2, "xone two threex"), (3, "aéb  two"), (4, None), (5, "")]
    items = [(1, "two three four five six seven"), (2, "one two three"), (3, "wo thr"), (4, "é"), (5, "three four five"), (6, ""), (7, None), (8, "zero two three")]
    got = passages_held(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for d, t in docs for i, p in items if t is not None and p is not None and p in t)


def test_agreeing_counts_in_lots(spark):
    rng = random.Random(5)
    fields = ["x", "y"]
    people = [(rng.randrange(6), rng.randrange(4)) for _ in range(50)]
    df = spark.createDataFrame([(x, x // 3, y, y // 3, 1) for x, y in people], "x int, x_coarse int, y int, y_coarse int, n long")
    asks = [(k, *rng.choice(people), rng.randrange(3), rng.randrange(3)) for k in range(40)]
    at = spark.createDataFrame([(k, x, x // 3, y, y // 3, a, b) for k, x, y, a, b in asks], "id long, x int, x_coarse int, y int, y_coarse int, level_x int, level_y int")
    same = lambda p, q, level: level == 2 or (p == q if level == 0 else p // 3 == q // 3)
    want = {k: sum(same(x, p, a) and same(y, q, b) for p, q in people) for k, x, y, a, b in asks}
    for lot in (1, 1024):
        assert {r.id: r.k for r in K.agreeing(at, df, fields, ["id"], lot).collect()} == want


def test_patterns_are_the_fixed_ones():
    assert len(P.HANDLES) == 9 and all(re.compile(p) for p in P.HANDLES)
