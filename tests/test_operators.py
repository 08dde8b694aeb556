import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillveil.operators import kanon as K
from quillveil.operators import linkage as L
from quillveil.operators import redaction as R
from quillveil.operators import reports as Q
from quillveil.operators import tfidf as I
from quillveil.sources import files as S


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b", "z"]), (2, ["b", "c", "z"]), (3, ["z"])], "d long, w array<string>")
    counts = I.term_counts(docs, ["d"], F.col("w"))
    model = I.fit(counts, docs.agg(F.count("*").alias("n")), [], max_df=0.9)
    got = {(r.d, r.term): r.w for r in I.weigh(counts, model, [], ["d"]).collect()}
    a, b = (1 + math.log(2)) * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert got[(1, "a")] == pytest.approx(a / math.hypot(a, b)) and (1, "z") not in got and (3, "z") not in got
    assert sum(w * w for (d, _), w in got.items() if d == 2) == pytest.approx(1)


def test_retrieval_metrics(spark):
    ranks = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 7, True), (2, 1, False)], "q long, rank int, relevant boolean")
    got = {r.q: r for r in I.retrieval_metrics(ranks, ["q"]).collect()}
    assert (got[1].hit_at_1, got[1].hit_at_5, got[1].multi_at_10, got[1].recall_at_10, got[1].reciprocal_rank) == (0, 1, 1, 1.0, 0.5)
    assert got[2].first_rank is None and got[2].reciprocal_rank == 0


def greedy(rows, target, fields, k):
    """The planner as a loop: raise the best field until enough rows agree."""
    n, level = len(rows), {f: 0 for f in fields}
    rare = {f: -math.log((sum(r[f] == target[f] for r in rows) + 0.5) / (n + 0.5 * len({r[f] for r in rows}))) for f in fields}
    agree = lambda: sum(all(level[f] == 2 or r[f] == target[f] or (level[f] == 1 and r[f] // 3 == target[f] // 3) for f in fields) for r in rows)
    while agree() < k and any(v < 2 for v in level.values()):
        f = max((round((rare[f] + p + 1) / max(c * (1 + 0.8 * level[f]), 0.1), 9), f) for f, (p, c) in fields.items() if level[f] < 2)[1]
        level[f] += 1
    return agree(), level


def test_planner_equals_greedy_loop(spark):
    rng = random.Random(4)
    fields = {"x": (2.0, 0.3), "y": (1.0, 0.8), "z": (1.5, 0.5)}
    rows = [{f: rng.randrange(m) for f, m in (("x", 9), ("y", 6), ("z", 4))} for _ in range(60)]
    counts = Counter(tuple(r.values()) for r in rows)
    data = [("|".join(map(str, c)), *c, *[v // 3 for v in c], n) for c, n in counts.items()]
    combos = spark.createDataFrame(data, "combo string, x int, y int, z int, x_coarse int, y_coarse int, z_coarse int, n long")
    for k in (1, 5, 60, 61):
        stop, levels = K.plan(combos, fields, k)
        got = {r.combo: [r.estimated_k, {}] for r in stop.collect()}
        for r in levels.collect():
            got[r.combo][1][r.field] = r.level
        for c, *values in [(d[0], *d[1:4]) for d in data]:
            assert got[c] == list(greedy(rows, dict(zip("xyz", values, strict=True)), fields, k))


def test_plans_from_another_population(spark):
    rows = [(k, k % 7, k % 7 // 3, k % 5, k % 5 // 3) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, x int, x_coarse int, y int, y_coarse int")
    dealt = K.shuffled(df, ["x", "y"], "id", 3)
    for f in "xy":
        assert Counter(r[f] for r in dealt.collect()) == Counter(r[f] for r in df.collect())
    group = lambda d: d.groupBy("x", "x_coarse", "y", "y_coarse").agg(F.count("*").alias("n")).withColumn("combo", F.concat_ws("|", "x", "y"))
    fields = {"x": (1.0, 0.5), "y": (1.0, 0.7)}
    stop, levels = K.plan(group(df), fields, 4)
    true = {r.combo: r.k for r in K.true_k(group(df), levels, ["x", "y"]).collect()}
    assert true == {r.combo: r.estimated_k for r in stop.collect()}
    stop, levels = K.plan(group(df), fields, 4, levels=(2,), population=group(dealt))
    assert {r.level for r in levels.collect()} <= {0, 2} and stop.count() == group(df).count()


def test_threshold(spark):
    pairs = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.6, 1), (0.8, 1), (0.9, 1)], "score double, label int")
    best = L.best_threshold(pairs).first()
    cand = np.unique(np.quantile([0.1, 0.4, 0.6, 0.8, 0.9], np.linspace(0.5, 0.995, 120)))
    f1 = lambda t: 2 * sum(s >= t and y for s, y in ((0.1, 0), (0.4, 0), (0.6, 1), (0.8, 1), (0.9, 1))) / (sum(s >= t for s in (0.1, 0.4, 0.6, 0.8, 0.9)) + 3)
    want = max(cand, key=lambda t: (round(f1(t), 12), -t))
    assert best.threshold == pytest.approx(want) and best.f1 == pytest.approx(f1(want))
    assert tuple(L.best_threshold(pairs.limit(0)).first()) == (1.0, 0.0)
    same = L.best_threshold(spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")).first()
    assert same.threshold == 0.5 and same.f1 == pytest.approx(2 / 3)


def test_components_and_scores(spark):
    nodes = spark.createDataFrame([(k,) for k in range(8)], "k long")
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (7, 6)], "a long, b long")
    got = {r.k: r.component for r in L.connected(nodes, edges, "k").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 6}
    rng = random.Random(1)
    items = [(k, rng.randrange(4), rng.randrange(5)) for k in range(60)]
    r = L.cluster_scores(spark.createDataFrame(items, "k long, t int, c int"), "t", "c").first()
    share = lambda a, b: sum(sum(x[1] == y[1] and x[2] == y[2] for y in items) / sum(x[a] == y[a] for y in items) for x in items) / 60
    assert r.bcubed_precision == pytest.approx(share(2, 1)) and r.bcubed_recall == pytest.approx(share(1, 2))
    perfect = L.cluster_scores(spark.createDataFrame([(1, 1, 7), (2, 1, 7), (3, 2, 8)], "k long, t int, c int"), "t", "c").first()
    assert perfect.ari == pytest.approx(1) and perfect.nmi == pytest.approx(1)
    assert L.cluster_scores(spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "k long, t int, c int"), "t", "c").first().nmi == 1


def test_average_linkage():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.7, 0.9], [0.9, 0.7, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert L.average_linkage(d, 2).tolist() == [0, 0, 2, 2] and L.average_linkage(d, 4).tolist() == [0, 1, 2, 3] and len(set(L.average_linkage(d, 1))) == 1


def test_average_linkage_takes_the_first_smallest_pair():
    def plain(distance, k):
        label, size, d = np.arange(len(distance)), np.ones(len(distance)), np.array(distance, float)
        np.fill_diagonal(d, np.inf)
        for _ in range(len(d) - k):
            i, j = sorted(divmod(int(d.argmin()), len(d)))
            d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i, i] = np.inf
            d[j] = d[:, j] = np.inf
            size[i] += size[j]
            label[label == j] = i
        return label

    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40, 90):
        for d in (rng.random((n, n)), rng.integers(0, 4, (n, n)) / 4):
            d = np.triu(d, 1) + np.triu(d, 1).T
            for k in {1, min(n, 3), n}:
                assert L.average_linkage(d, k).tolist() == plain(d, k).tolist()


def test_fixed_k_clusters_all_of_a_tier(spark, tmp_path):
    from quillveil.plans.linkage import avg_linkage_fixed_k

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(k, [float(x) for x in centres[k % 6] + rng.normal(size=8) * 0.01], k % 6) for k in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = avg_linkage_fixed_k(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(t, 200, 1.0, 1.0) for t in range(3)]


def test_redacted_text_keeps_no_identifier(spark):
    person = spark.createDataFrame([("P1", "Ann Lee", "ann@x.org", "(212) 555-0199", "1 Elm St", "ACCT-77", "Ann Lee (ANN@x.org, (212) 555-0199) of 1 Elm St, acct-77; lee")], "pid string, name string, email string, phone string, address string, account string, text string")
    repl = person.select("pid", F.lit("c1").alias("condition"), R.direct_replacements({c: F.col(c) for c in ("name", "email", "phone", "address", "account")}).alias("replacements"))
    got = R.transform_conditions(person.select("pid", "text"), repl, "pid").first().text
    assert got == "[NAME] ([EMAIL], [PHONE]) of [ADDRESS], [ACCOUNT]; [NAME]"


def test_reports(spark):
    rows = spark.createDataFrame([("T3", 9), ("T3", 8), ("T3", 7), ("T1", 6), ("T1", 5)], "tier string, v int")
    got = Q.top_with_backfill(rows, "tier", ["T3", "T2"], [F.desc("v")], 1, 3).orderBy("pick").collect()
    assert [(r.tier, r.v) for r in got] == [("T3", 9), ("T3", 8), ("T3", 7)]
    est = Q.token_estimate(spark.createDataFrame([("a", 10, 5), ("a", 10, None), ("b", 5, None)], "c string, chars long, tok long"), "c", F.col("chars"), F.col("tok"))
    assert sorted(r.estimated for r in est.collect()) == [2, 5, 5]  # 2.5 rounds to even
    ci = Q.bootstrap_mean(spark.createDataFrame([("a", float(k % 2)) for k in range(200)], "g string, v double"), "g", "v").first()
    assert ci.mean == 0.5 and 0.4 < ci.low < 0.5 < ci.high < 0.6
    first = Q.keep_first(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, t string"), ["t"], [F.asc("id")])
    assert sorted(r.id for r in first.collect()) == [1, 3]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x_y", 0.5)], "b int, a string, c double")
    S.write_jsonl(df, str(tmp_path / "j"))
    assert S.read_jsonl(spark, str(tmp_path / "j"), "b int, a string").first() == (1, "x_y")
    S.write_csv(df, str(tmp_path / "c"))
    assert S.read_csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()
    (tmp_path / "s.yaml").write_text("k: 5\n")
    assert S.read_settings(spark, str(tmp_path / "s.yaml")) == {"k": 5}
    assert S.markdown_table(df).splitlines()[2] == "| 1 | x_y | 0.500 |" and r"x\_y" in S.latex_table(df, "t", "l")
    (tmp_path / "u").mkdir()
    (tmp_path / "u/batch_2_pilot.json").write_text('{"usage": {"input_tokens": 3}}')
    assert tuple(S.cache_summary(spark, str(tmp_path / "u")).first()) == (1, 3, 0, 0)
    assert S.discover_runs(spark, str(tmp_path / "u")).select("batch", "run").first() == (2, "pilot")
    assert S.manifest(spark, str(tmp_path / "u")).first().bytes == 30
    note = spark.createDataFrame([("x\n- Calls made: 12\ny",)], "t string")
    assert note.select(S.note_value("t", "Calls made")).first()[0] == "12"
    df.withColumn("condition", F.lit("c1")).write.partitionBy("condition").parquet(str(tmp_path / "p"))
    assert S.read_conditions(spark, str(tmp_path / "p"), ["c1"]).count() == 1
    with pytest.raises(ValueError):
        S.read_conditions(spark, str(tmp_path / "p"), ["c1", "c9"])


def test_block_counts_match_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(20, 6)), 2, axis=0) + 0.3 * rng.normal(size=(40, 6))
    rows = [(i, int(i // 2), i % 3, v.tolist()) for i, v in enumerate(x)] + [(40, 7, 0, None), (41, 7, 1, [0.0] * 6), (42, 7, 2, [1.0, None] + [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, who int, tier int, v array<double>")
    cos = lambda i, j: round(float(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])), 9)
    pairs = [(i, j, int(i // 2 == j // 2), cos(i, j)) for i in range(40) for j in range(i + 1, 40)]
    whole = L._cosine_blocks
    monkeypatch.setattr(L, "_cosine_blocks", lambda *a: whole(*a, per=7))
    assert {tuple(r) for r in L.links(df, "id", "v", 0.8).collect()} == {(i, j) for i, j, _, s in pairs if s >= 0.8}
    got = {(r.tier, r.m): (r.n, r.same) for r in L.score_counts(df, "id", "v", "who", np.array([-0.2, 0.2]), ["tier"]).collect()}
    want = {}
    for i, j, same, s in pairs:
        if i % 3 == j % 3:
            k = (i % 3, int(s >= -0.2) + int(s >= 0.2))
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + same)
    assert got == want
    table = spark.createDataFrame([(s, same) for _, _, same, s in pairs], "score double, label int")
    best = L.best_threshold(table).first()
    assert np.allclose(L.cosine_threshold(df, "id", "v", "who"), (best.threshold, best.f1))
    assert L.cosine_threshold(df.where(F.lit(False)), "id", "v", "who") == (1.0, 0.0)
    assert L.links(df.where("id >= 40"), "id", "v", 0.0).count() == 0
