"""Rewriting conditions over documents against a plain version, and edge cases of personas' documents."""

import hashlib
import re

from quillveil.functions import text as X
from quillveil.plans import conditions as C
from pyspark.sql import functions as F

_FIELDS = len(C.FIELDS)


def person(pid: int, levels: list[int]) -> dict:
    exact, coarse = [f"{f} {pid + i};" for i, f in enumerate(C.FIELDS)], [f"{f} group {i};" for i, f in enumerate(C.FIELDS)]
    return {"pid": pid, "name": f"Ann Öz {pid}", "email": f"a{pid}@mail.test", "phone": "(001) 555-0001", "address": f"{pid} Harbour Lane", "account": f"ACCT-{pid}", "nation_id": "CITY_000", "segment_id": "ORG_001", "exact": exact, "coarse": coarse, "levels": levels, "tier": "T0"}


def plain(d: dict, condition: str) -> str:
    """All replacements, longest source first, in any case, whether the text holds them or not."""
    direct = [(d[c], f"[{c.upper()}]") for c in C._IDENTITY]
    e, g = d["exact"], d["coarse"]
    tokens = lambda s: [(d[c], f"{'PERSON' if c == 'name' else c.upper()}_{s}") for c in C._IDENTITY] + [(e[0], d["nation_id"] + ";"), (e[1], d["segment_id"] + ";")]
    planned = []
    for i, f in enumerate(C.FIELDS):
        gone, both = f"[{f.upper()}];", f"{e[i]} in the {g[i]}"
        if d["levels"][i] == 1:
            planned += [(both, f"the {g[i]}"), (e[i], f"a place in the {g[i]}")] if f == "nation" else [(e[i], g[i])]
        elif d["levels"][i] == 2:
            planned += [(e[i], gone), (g[i], gone)] + ([(both, gone)] if f == "nation" else [])
    lists = {
        "c0_original": [], "c1_direct": direct, "c1b_detected": direct, "c2_stable": tokens(d["pid"]), "c3_per_document": tokens(hashlib.sha1(str(d["doc_id"]).encode()).hexdigest()[:6].upper()),
        "c4_local": [*direct, (e[0], f"a place in the {g[0]}"), (d["address"].split(" ")[-1], "[STREET]"), (e[10], g[10])], "c5_planned": direct + planned,
        "c6_aggressive": direct + [(v[i], f"[{f.upper()}];") for i, f in enumerate(C.FIELDS) for v in (e, g)] + [(d["priority"], "[ISSUE]")],
    }
    text = d["text"]
    if text is None:
        return None
    if condition == "c1b_detected":
        for pattern, mark in ((X.EMAIL, "[EMAIL]"), (X.PHONE, "[PHONE]"), (X.ACCOUNT, "[ACCOUNT]")):
            text = re.sub(pattern, mark, text)
    for src, dst in sorted(lists[condition], key=lambda p: -len(p[0] or "")):
        if src:
            text = re.sub(re.escape(src), lambda _, d=dst: d, text, flags=re.IGNORECASE)
    return text


def test_rewritten(spark):
    people = [person(1, [0] * _FIELDS), person(2, [1] * _FIELDS), person(3, [2] * _FIELDS), person(4, [i % 3 for i in range(_FIELDS)])]
    docs = []
    for p in people:
        full = f"Subject: {p['name']} <{p['email']}>, {p['phone']}\n{p['address']} Lane {p['account']}\n1-URGENT request\n{p['exact'][0]} in the {p['coarse'][0]} {' '.join(p['exact'])} {' '.join(p['coarse'])}"
        for text in (full, full.lower(), full.upper(), "", None, full * 40, "other@mail.test (123) 555-9999 ACCT-77 $1 \\2"):
            docs.append({**p, "doc_id": len(docs), "priority": "1-URGENT", "status": "O", "source": "plain", "text": text})
    schema = "pid long, name string, email string, phone string, address string, account string, nation_id string, segment_id string, exact array<string>, coarse array<string>, levels array<int>, tier string, doc_id long, priority string, status string, source string, text string"
    got = {(r.doc_id, r.condition): r.text for r in C.rewritten(spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in docs], schema)).select("doc_id", "condition", "text").collect()}
    want = {(d["doc_id"], c): plain(d, c) for d in docs for c in C.CONDITIONS}
    assert got == want


def test_some_conditions_and_no_rows(spark):
    d = {**person(1, [0] * _FIELDS), "doc_id": 5, "priority": "2-HIGH", "status": "F", "source": "plain", "text": "2-high of ann öz 1"}
    df = spark.createDataFrame([d], "pid long, name string, email string, phone string, address string, account string, nation_id string, segment_id string, exact array<string>, coarse array<string>, levels array<int>, tier string, doc_id long, priority string, status string, source string, text string")
    two = ("c1_direct", "c6_aggressive")
    assert {r.condition: r.text for r in C.rewritten(df, two).collect()} == {"c1_direct": "2-high of [NAME]", "c6_aggressive": "[ISSUE] of [NAME]"}
    assert C.rewritten(df.limit(0)).count() == 0


def test_replace_each_is_replace_ordered_without_patterns(spark):
    pairs = "array<struct<src:string,dst:string>>"
    rows = [
        ("Straße STRASSE ſtraße \u212a k İi ŉ", [("STRASSE", "$1"), ("straße", "\\E"), ("K", "k2"), ("i", "[I]")], [("", "x"), (None, "y"), ("k", "kk")]),
        ("a.b A.B axb \\Q", [("a.b", "b"), ("b", "B.B"), ("\\q", "")], []),
        ("aaaa", [("aa", "a"), ("AA", "c"), ("a", "aa")], [("a", None)]),
        ("", [("a", "b")], [("a", "b")]), (None, [("a", "b")], []), ("ÀÉ àé", [("àé", "ÉÀ"), ("éà", "z")], [("É", "e")]),
    ]
    df = spark.createDataFrame(rows, f"text string, a {pairs}, b {pairs}")
    shout = F.concat("text", F.lit("!A"))
    got = df.select(X.replace_each([F.col("text"), shout], [(0, F.col("a")), (1, F.col("b")), (1, F.col("a"))]).alias("x"), F.array(X.replace_ordered(F.col("text"), F.col("a")), X.replace_ordered(shout, F.col("b")), X.replace_ordered(shout, F.col("a"))).alias("y"))
    assert "(?iu)" not in got.select("x")._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.x == r.y for r in got.collect()), got.collect()


def test_a_small_table_of_orders_is_dealt_out(spark, tmp_path):
    orders = spark.createDataFrame([(k, 1, "1-URGENT", "O") for k in range(40)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    people = spark.createDataFrame([person(1, [0] * _FIELDS)], "pid long, name string, email string, phone string, address string, account string, nation_id string, segment_id string, exact array<string>, coarse array<string>, levels array<int>, tier string")
    docs = C.rewritten(C.documents(spark, str(tmp_path), people))
    assert docs.select(F.spark_partition_id()).distinct().count() > 1  # all in one task before
    assert docs.count() == 40 * 2 * 8
