"""What shuffles and how often: steps whose cost once grew with terms or pairs, against plain versions."""

import random

import numpy as np
import pyarrow as pa
from quillveil.functions import text as X
from quillveil.operators import kanon as K
from quillveil.operators import linkage as L
from quillveil.operators import tfidf as I
from pyspark.sql import functions as F


def test_group_cosines_are_those_of_term_tables(spark):
    rows = [(1, 7, -1, "a b c a d"), (1, 8, 0, "a b c"), (1, 9, 1, "x y"), (1, 9, 2, ""), (2, 7, 0, "no own text"), (3, 7, -1, "alone")]
    texts = spark.createDataFrame(rows, "q long, cand long, slot int, text string")
    got = I.group_cosines(texts, "q", "slot", "cand", {"word": X.space_words, "char": X.space_words}, {"word": X.runs_of, "char": X.char_runs_of}, 11, 0.9)
    chars = F.flatten(F.array(*[X.char_ngrams(F.col("text"), n) for n in (3, 4, 5)]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # no row for each term
    got = {(r.q, r.slot): (r.cand, r.word, r.char) for r in got.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    for at, (terms, upto) in enumerate(((X.space_words(F.col("text")), 3), (chars, 1)), 1):
        counts = I.term_counts(texts, ["q", "slot"], terms, upto)
        w = I.weigh(counts, I.fit(counts, spark.createDataFrame([(1, 11), (2, 11), (3, 11)], "q long, n int"), ["q"], max_df=0.9), ["q"], ["q", "slot"])
        known = {(r.q, r.slot): r.score for r in I.scores(w.where("slot = -1").drop("slot"), w.where("slot >= 0"), ["q"], [], ["slot"]).collect()}
        assert all(abs(v[at] - known.get(k, 0.0)) < 1e-12 for k, v in got.items())


def test_char_ngrams_are_made_from_distinct_words(spark, tmp_path):
    from quillveil.plans import text as T

    spark.createDataFrame([("aa bb aa " * 60,), ("AA\tü",), (None,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = T.QUERIES["char_ngram_counts"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # words first
    assert {(r.n, r.gram): r.occurrences for r in got.collect()} == {(3, " aa"): 121, (3, "aa "): 121, (4, " aa "): 121, (5, " aa "): 121}


def test_decoys_hash_only_those_that_agree_most(spark, tmp_path):
    import duckdb

    from quillveil.plans import linkage as L

    # 60 suppliers agree on all, others on one field, some on none; a null band; a region of one
    rows = [(k, 0 if k < 90 else k % 3, None if k == 7 else float(100 * (k % 3 if k > 60 else 1) * 20)) for k in range(1, 130)] + [(500, 9, 1.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k // 4) for k in range(12)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("decoy_candidates_hash", "extend_candidate_sets"):
        got = L.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(L.ORACLES[name]).fetchall())
    pairs = got._jdf.queryExecution().optimizedPlan().toString()
    assert "level" in pairs  # not all pairs of a region


def test_nearest_needs_no_table_of_pairs(spark):
    docs = spark.createDataFrame([(k, f"common word{k % 7} other{k % 3}" if k < 40 else "") for k in range(45)], "doc long, t string")
    asked = spark.createDataFrame([(k, f"common word{k} other{k}") for k in range(9)] + [(99, "unseen")], "q long, t string")
    counts = lambda d, key: I.term_counts(d, [key], X.space_words(F.col("t")), 3, hashed=True)
    model = I.fit(counts(docs, "doc"), docs.agg(F.count("*").alias("n")), [])
    q, d = I.weigh(counts(asked, "q"), model, [], ["q"]), I.weigh(counts(docs, "doc"), model, [], ["doc"])
    order = [F.desc(F.round("score", 9)), F.asc("doc")]
    known = sorted((r.q, r.rank, r.doc) for r in I.ranked(I.scores(q, d, [], ["q"], ["doc"]), ["q"], order).where("rank <= 4").collect())
    assert len(known) == 36
    for sizes in ((8_000_000, 4_000_000), (40, 12)):
        assert sorted((r.q, r.rank, r.doc) for r in I.nearest(q, d, "q", "doc", 4, *sizes).collect()) == known


def test_contexts_neither_shuffle_terms_nor_collect_values(spark, tmp_path, monkeypatch):
    import duckdb
    from pyspark.sql import DataFrame

    from quillveil.plans import contexts as C

    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("a b c dd ee f-g [x] common".split()) + str(rng.randrange(4)) for _ in range(n))
    rows = [(k, t, f"common {words(rng.randrange(22))}" if t else words(rng.randrange(3, 18))) for k in range(40) for t in range(rng.randrange(1, 4))]
    rows += [(50, 0, "common0"), (51, 1, "no profile"), (52, 0, None), (52, 1, None), (None, 0, "a1 b1"), (None, 1, "a1 b1 common a1 b2")]
    rows += [(60 + k, t, "same words for all") for k in range(9) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")

    def refused(*_, **__):
        raise AssertionError("terms as rows, or values on the driver")

    monkeypatch.setattr(I, "term_counts", refused)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    for name in ("context_fields", "context_field_rates", "context_field_sets", "prompt_plan"):
        got = sorted(map(str, map(tuple, C.QUERIES[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(str, duckdb.sql(C.ORACLES[name]).fetchall())) and got
    convs = C.conversations(spark, str(tmp_path))
    sides = [convs.select(F.col("conv_id").alias("key"), X.tokens(F.coalesce(c, F.lit("")), X.PORTABLE).alias("_w")) for c in ("body", "profile")]
    found = []
    for per, sizes in ((2_000_000, {}), (60, {"doc_entries": 90, "query_entries": 50, "dense": 3, "most": 64})):
        d, q = I.lists(*sides, 0.9, convs.count(), per)
        best = I.nearest_lists(q.withColumnRenamed("key", "q"), d.withColumnRenamed("key", "doc"), "q", "doc", 5, **sizes)
        found.append(sorted((str(r.q), r.rank, str(r.doc)) for r in best.collect()))
    assert found[0] == found[1] and len(found[0]) > 100


def test_cosines_shuffle_counts_once(spark):
    docs = [(k, f"common common word{k % 7} other{k % 3} c{k}") for k in range(30)] + [(30, ""), (31, None), (32, "one")]
    asked = spark.createDataFrame([(k, f"common word{k} other{k} word{k}") for k in range(9)] + [(99, "unseen")], "q long, t string")
    words, order = X.space_words(F.col("t")), ["q", "doc"]
    for rows in (docs, docs + [(3, "shares its key"), (None, "common")]):
        d = spark.createDataFrame(rows, "doc long, t string")
        plain, counts = I.term_counts(d, ["doc"], words, 3), I.hashed_counts(d, ["doc"], words)
        tfs = lambda c: sorted((str(r.doc), r.tf) for r in c.collect())
        assert tfs(plain) == tfs(counts)
        assert len(rows) > len(docs) or "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
        n = d.agg(F.count("*").alias("n"))
        model = I.fit(plain, n, [], max_df=0.65)
        known = I.scores(I.weigh(I.term_counts(asked, ["q"], words, 3), model, [], ["q"]), I.weigh(plain, model, [], ["doc"]), [], ["q"], ["doc"]).where("doc is not null")
        got = I.cosines(I.hashed_counts(asked, ["q"], words), counts, n, 0.65, [], ["q"], ["doc"])
        both = [sorted((r.q, r.doc, round(r.score, 10)) for r in x.orderBy(*order).collect()) for x in (known, got)]
        assert both[0] == both[1] and len(both[0]) > 50


def test_search_equals_cosines_in_every_version(spark):
    from quillveil.operators.search import search

    rng = random.Random(7)
    docs = [(k, " ".join(rng.choice("the of station path tion x common".split()) + str(rng.randrange(3)) for _ in range(rng.randrange(14)))) for k in range(60)]
    docs += [(100 + k, "the0 same text") for k in range(6)] + [(200, ""), (201, None), (None, "the0 of1 common2")]
    d = spark.createDataFrame(docs, "doc long, t string").repartition(3)
    asked = spark.createDataFrame([(k % 4, f"y{k}", f"the{k} of{k % 3} common{k % 3} station1 the{k}") for k in range(9)] + [(99, "none", "unseen"), (None, None, "the0 same")], "q long, y string, t string")
    words = lambda c: X.tokens(c, X.PORTABLE)
    texts = [F.col("t"), F.replace("t", F.lit("tion"), F.lit("[X]")), F.replace("t", F.lit("th"), F.lit("[T]"))]
    relevant = spark.createDataFrame([(q, k) for q in range(4) for k in rng.sample(range(60), 5)] + [(99, 3), (1, 200), (None, 3), (None, 7)], "q long, doc long")
    keys, n = ["q", "y"], d.agg(F.count("*").alias("n"))
    known, first = set(), set()
    for v, t in enumerate(texts):
        counts, ask = I.term_counts(d, ["doc"], words(t), 3), I.term_counts(asked, keys, words(F.col("t")), 3)
        model = I.fit(counts, n, [], max_df=0.65)
        scored = I.scores(I.weigh(ask, model, [], keys), I.weigh(counts, model, [], ["doc"]), [], keys, ["doc"])
        best = I.ranked(scored, keys, [F.desc(F.round("score", 9)), F.asc_nulls_last("doc")])
        known |= {(v, r.q, r.y, r["rank"], r.doc, round(r.score, 9)) for r in best.where("rank <= 4").collect()}
        first |= {(v, r.q, r.y, r.first_rank, r.total) for r in best.join(relevant, ["q", "doc"]).groupBy(*keys).agg(F.min("rank").alias("first_rank"), F.count("*").alias("total")).collect()}
    for sizes in ({}, {"per": 50, "most": 60, "query_entries": 40, "cells": 30}):
        top, got = search(d, "doc", list(map(words, texts)), asked, keys, words(F.col("t")), 0.65, 4, relevant, **sizes)
        assert {(r.version, r.q, r.y, r["rank"], r.doc, round(r.score, 9)) for r in top.collect()} == known and len(known) > 80
        assert {(r.version, r.q, r.y, r.first_rank, r.total) for r in got.collect()} == first and len(first) > 20


def test_retrieval_keeps_no_table_of_pairs(spark, monkeypatch):
    import duckdb

    from quillveil.plans import audit, conditions, text

    def refused(*_, **__):
        raise AssertionError("a row for each query and document")

    monkeypatch.setattr(I, "cosines", refused)
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "customer", "orders", "nation", "region", "events", "supplier", "lineitem", "part"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for plans, name in ((text, "exposure_by_condition"), (text, "retrieval_hit_mrr"), (text, "tfidf_topk_benchmark"), (audit, "context_recovery"), (conditions, "label_retrieval")):
        got = sorted(map(str, map(tuple, plans.QUERIES[name](spark, sf).collect())))
        assert got == sorted(map(str, duckdb.sql(plans.ORACLES[name]).fetchall())) and got


def test_field_match_scores_distinct_texts(spark, tmp_path):
    import duckdb

    from quillveil.plans import linkage as L

    rows = [(k, k % 5, ("BUILDING", "FURNITURE", None)[k % 3], f"c{k}") for k in range(60)] + [(3, 3, "BUILDING", "again")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long, c_mktsegment string, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"NATION {k}", k // 3) for k in range(5)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "EAST"), (1, "WEST")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    con = duckdb.connect()
    for t in ("customer", "nation", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = L.QUERIES["field_weighted_match"](spark, str(tmp_path))
    assert "<=>" in got._jdf.queryExecution().optimizedPlan().toString()  # scores are looked up by text
    known = con.sql(L.ORACLES["field_weighted_match"]).fetchall()
    keyed = lambda rows: sorted((r[0], float(r[2])) for r in rows)
    assert keyed(got.collect()) == keyed(known) and sorted(r.rank for r in got.collect() if r.c_custkey != 3) == sorted(r[1] for r in known if r[0] != 3)


def test_tiles_within_a_block_have_each_pair_once(spark):
    """A task's two blocks are larger than the scores it holds at a time, so that rows shuffle to fewer tasks."""
    df = spark.createDataFrame([(i, [float(i % 13), 1.0, float(i % 5) - 2]) for i in range(120)], "id long, v array<float>")

    def of(by, a, b, scores, pairs):
        x, y = np.nonzero(pairs)
        x, y = a.column("id").to_numpy()[x], b.column("id").to_numpy()[y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "s": scores[pairs], "cells": np.full(len(x), scores.size)})

    got = L._cosine_blocks(df, "id", "v", [], [], of, "a long, b long, s double, cells long", per=50, tile=7, spread=1).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((i, j) for j in range(120) for i in range(j))
    assert max(r.cells for r in got) <= 49
    v = {r.id: np.array(r.v) for r in df.collect()}
    assert all(abs(r.s - v[r.a] @ v[r.b] / np.sqrt(v[r.a] @ v[r.a] * (v[r.b] @ v[r.b]))) < 1e-12 for r in got)


def test_many_choices_of_levels_are_counted_by_hashes(spark):
    """One pass counts each of many choices on arrays; nulls agree with none, blocks add up."""
    values = [(i, i % 4 if i % 9 else None, i % 3, i % 2, i % 5) for i in range(60)]
    people = spark.createDataFrame([(a, b, c, d, 1 + i % 3) for i, a, b, c, d in values], "x int, x_coarse int, y int, y_coarse int, n long")
    at = spark.createDataFrame([(100 * i + 10 * l + m, l, m, a, b, c, d) for i, a, b, c, d in values for l in range(3) for m in range(3)], "id long, level_x int, level_y int, x int, x_coarse int, y int, y_coarse int")
    tell = lambda l, exact, coarse: (exact, coarse, "")[l]  # noqa: E741, E731

    def count(r):
        own = (tell(r.level_x, r.x, r.x_coarse), tell(r.level_y, r.y, r.y_coarse))
        return 0 if None in own else sum(1 + i % 3 for i, a, b, c, d in values if (tell(r.level_x, a, b), tell(r.level_y, c, d)) == own)

    want = {r.id: count(r) for r in at.collect()}
    for hashed in (None, K.population_hashes(people, ["x", "y"])):
        assert {r.id: r.k for r in K.agreeing(at, people, ["x", "y"], ["id"], block=7, hashed=hashed).collect()} == want


def test_set_sums_make_a_pair_once(spark):
    from itertools import combinations_with_replacement

    from quillveil.operators import patterns as P

    rng = np.random.default_rng(4)
    sets = {int(k): sorted(rng.choice(40, rng.integers(1, 12), replace=False).tolist()) for k in rng.permutation(60)}
    sets[99] = [77]  # a term of its own
    idf = {t: 1 + t / 7 for t in range(80)}
    rows = [(k, f"t{t}", idf[t]) for k, ts in sets.items() for t in ts]
    want = {(a, b): sum(idf[t] ** 2 for t in set(sets[a]) & set(sets[b])) for a, b in combinations_with_replacement(sorted(sets), 2) if set(sets[a]) & set(sets[b])}
    entries = spark.createDataFrame(rows, "s long, term string, idf double")
    for sizes in ({}, {"per": 20, "tile": 7, "columns": 5}, {"tile": 7, "columns": 3}):
        found = P.set_sums(entries, "s", **sizes)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # rows for each shared term before
        got = [((r.a, r.b), r.dot) for r in found.collect()]
        assert len(got) == len(want) and all(abs(want[p] - d) < 1e-9 for p, d in got)
    assert P.set_sums(entries.limit(0), "s").count() == 0


def test_softmax_keeps_numbers_for_rows_not_for_terms(spark):
    from quillveil.operators import features as C

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(k, [f"w{rng.integers(0, 30)}" for _ in range(rng.integers(0, 9))]) for k in range(50)], "id long, terms array<string>")
    counts = I.term_counts(docs, ["id"], F.col("terms"), 2).withColumn("i", F.when(F.col("id") < 40, F.col("id")))
    held, dense = counts.where("i is not null").collect(), {}
    for r in held:
        dense.setdefault(r.term, np.zeros(40))[r.i] = 1 + np.log(r.tf)
    x = np.stack([v * (np.log(41 / (1 + (v > 0).sum())) + 1) for v in dense.values() if (v > 0).sum() >= 2], 1)
    some = rng.normal(size=(40, 3))
    for per in (2_000_000, 20):  # one block, and many
        blocks = C.term_blocks(counts, "id", 40, per=per)
        assert (blocks.count() > 1) == (per == 20)
        assert np.allclose(C.products(blocks.select("i", "t", "w"), some), x @ (x.T @ some))
    seen = np.eye(3)[rng.integers(0, 3, 40)]
    shapes = []
    a, b = C.softmax(lambda v: (shapes.append(v.shape), x @ (x.T @ v))[1], seen, 0.01, 200)
    p = np.exp(x @ (x.T @ a) + b)
    p /= p.sum(1, keepdims=True)
    assert set(shapes) == {(40, 3)} and x.shape[1] != 40
    assert abs(x.T @ (p - seen) / 40 + 0.01 * x.T @ a).max() < 1e-4 and abs((p - seen).sum(0)).max() < 1e-3


def test_texts_with_nothing_to_hide_are_searched_once(spark, tmp_path, monkeypatch):
    import duckdb

    from quillveil.operators import patterns as P
    from quillveil.plans import patterns as Q

    texts = ["see a.b@c.test or (123) 555-9999, ACCT-7 Mr. Smith", "plain words of asia", "PERSON_x1 city_2 Org_3 acct-4 email_z phone_5 account_q", "555- @ acct- person_", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "plain words of")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t, c, v in (("nation", "n_name", "FRANCE"), ("region", "r_name", "ASIA"), ("customer", "c_mktsegment", "TOOLS"), ("part", "p_name", "smith")):
        spark.createDataFrame([(v,)], f"{c} string").write.parquet(f"{tmp_path}/{t}.parquet")
    for t in ("documents", "benchmark", "nation", "region", "customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    read, plain = [], P.phrases_in
    monkeypatch.setattr(P, "phrases_in", lambda texts, *a, **b: (read.append(texts.count()), plain(texts, *a, **b))[1])
    got = Q.QUERIES["signature_token_counts"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(Q.ORACLES["signature_token_counts"]).fetchall())
    assert read == [len(texts) + 1]  # twice each before


def test_close_pairs_among_marked_rows(spark):
    docs = spark.createDataFrame([(k, f"a b c{k % 5} d{k % 5} e{k % 2}") for k in range(30)], "doc long, t string")
    counts = I.hashed_counts(docs, ["doc"], X.space_words(F.col("t")))
    model = I.fit(counts, docs.agg(F.count("*").alias("n")), [])
    w = I.weigh(counts, model, [], ["doc"])
    marks = spark.createDataFrame([(k, m) for k in range(28) for m in (k % 3, 3 + k % 4)], "doc long, mark int")
    every = {(r.a, r.b): round(r.score, 9) for r in I.close_pairs(w, model, "doc", 0.5).collect()}
    got = I.close_pairs(w, model, "doc", 0.5, marks)
    want = {(a, b): s for (a, b), s in every.items() if b < 28 and (a % 3 == b % 3 or a % 4 == b % 4)}
    assert {(r.a, r.b): round(r.score, 9) for r in got.collect()} == want and 0 < len(want) < len(every)


def test_classifier_deals_runs_as_lists(spark, monkeypatch):
    from quillveil.operators import features as C

    rows = [(1, 0, "a b a b"), (2, 1, "a b c"), (2, 1, "a c"), (3, 2, "b c a b"), (4, 3, ""), (5, 4, None)]
    docs = spark.createDataFrame(rows, "id long, i int, t string")
    words, plain = X.space_words(F.col("t")), {}
    for r in I.term_counts(docs, ["i"], words, 2).collect():
        plain.setdefault(r.term, {})[r.i] = 1 + np.log(r.tf)
    want = sorted((i, round(w * (np.log(8 / (1 + len(own))) + 1), 9)) for own in plain.values() if len(own) >= 2 for i, w in own.items())
    for blocks in (1, 5):
        dealt = C.dealt_runs(docs, "id", words, blocks)
        made = C.fitted_blocks(dealt, 7).collect()
        assert sorted((i, round(w, 9)) for r in made for i, w in zip(r.i, r.w, strict=True)) == want
        assert all(len(r.term) == len(r.idf) == len(set(r.t)) for r in made)
    # test documents in many blocks, some with keys twice or none, are told as in one; no row for each term shuffles
    texts = [(k, "en" if k % 2 else "fr", f"{'the of' if k % 2 else 'le de'} w{k % 7} w{k % 3}", k < 20) for k in range(40)]
    some = spark.createDataFrame([*texts, (30, "fr", "le w1", False), (None, "en", "the", False), (50, None, None, False)], "id long, lang string, t string, fit boolean")
    monkeypatch.setattr(I, "term_counts", None)  # a row for each term before
    one, many = (sorted(map(str, C.classify(some, "id", words, "lang", "fit", per=per).collect())) for per in (2_000_000, 20))
    assert one == many and len(one) == 23 and sum("lang='en', predicted='en'" in x for x in one) >= 10


def test_top_terms_shuffle_no_strings_of_runs(spark, tmp_path, monkeypatch):
    import duckdb

    from quillveil.plans import text as T

    texts = ["b a b a-b [x] a b", "a b, a B; 𝒳 é z ﬀ ~ ö", "", None, "z " * 9, "a b a b a-b", *(f"w{k % 3} v{k % 5} a u{k}" for k in range(30)), "a b a b a-b"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a no id")], "doc_id long, text string")
    tables = {"one": docs, "twice": docs.union(spark.createDataFrame([(1, "a b c c"), (None, "a b")], docs.schema))}
    con, counted = duckdb.connect(), I.term_counts
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        con.sql("CREATE OR REPLACE VIEW benchmark AS SELECT 1 AS item_id, 'a' AS text")
        spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        want = sorted(map(str, con.sql(T.ORACLES["tfidf_top_terms"]).fetchall()))
        # before, a row with a string for each run shuffled
        monkeypatch.setattr(I, "term_counts", counted if name == "twice" else None)
        got = T.QUERIES["tfidf_top_terms"](spark, f"{tmp_path}/{name}")
        assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) > 100
    terms = X.tokens(F.col("text"), X.PORTABLE)
    one, many = (sorted((str(r.doc_id), r.rank, r.term, round(r.w, 9)) for r in I.top_terms(docs, "doc_id", terms, 5, 0.65, per=per).collect()) for per in (2_000_000, 10))
    assert one == many


def test_frequent_runs_shuffle_no_strings_of_runs(spark, tmp_path, monkeypatch):
    import duckdb

    from quillveil.plans import text as T

    texts = ["b a b a-b [x] a b", "", None, "z " * 9, "é Ü é ü ﬀ", *(f"w{k % 3} v{k % 5} a u{k}" for k in range(30)), *["é ü é ü copy of a text"] * 6]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, duckdb.sql(T.ORACLES["word_ngram_df"]).fetchall()))
    monkeypatch.setattr(X, "word_ngrams", None)  # strings of all runs before
    got = T.QUERIES["word_ngram_df"](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) > 20
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for per in (5, 1000):  # many blocks, and one
        found = I.frequent_runs(docs, "text", lambda t: X.tokens(t, X.PORTABLE), 5, per=per)
        assert sorted(str(tuple(r)) for r in found.collect()) == want


def test_copies_are_served_before_many_sets_of_fields(spark, monkeypatch):
    from quillveil.operators import neighbours as N

    weights = {"region": 1.5} | {f"f{k}": 1.0 for k in range(12)}
    lots, taken = N.agreement_masks(weights, 2500), []
    assert sum(len(m) for _, m in lots) == 2**13 and [len(m) <= 16**k for k, (_, m) in enumerate(lots[:3])] == [True] * 3
    # one lot of 1 set for copies; before it had 2,380
    monkeypatch.setattr(N, "agreement_masks", lambda *_: (taken.append(len(m)) or (least, m) for least, m in lots))
    rows = [(k, *[(k % 4 + 1) * f for f in range(13)]) for k in range(44)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} int" for c in weights))
    got = N.nearest_by_fields(df, "id", weights, 9).collect()
    assert len(got) == 44 * 9 and all(r.overlap == 13.5 and r.id % 4 == r.cand % 4 for r in got) and taken[0] == 1 and len(taken) == 2


def test_signature_pairs_search_each_text_once(spark, tmp_path, monkeypatch):
    import duckdb

    from quillveil.plans import text as T

    texts = ["A.b@c.test a license", "a.B@c.test (123) 555-9999", "PASSWORD (123) 555-9999", "Copyright, all rights reserved", "none", "", None, "a license", "a license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, duckdb.sql(T.ORACLES["signature_similarity_pairs"]).fetchall()))
    assert sorted(str(tuple(r)) for r in T.QUERIES["signature_similarity_pairs"](spark, str(tmp_path)).collect()) == want and len(want) > 4
    searched = spark.sparkContext.accumulator(0)

    def tokens(text):
        searched.add(1)
        return [text] if text else []

    monkeypatch.setattr(T, "_signature_tokens", lambda: F.udf(tokens, "array<string>")(F.col("text")))
    for f in (T._signatures, T._signature_weights):
        before = searched.value
        f(spark, str(tmp_path)).collect()
        assert searched.value - before == len(texts)  # twice or three times before
