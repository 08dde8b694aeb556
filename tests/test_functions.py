import hashlib
import re

from pyspark.sql import functions as F

from quillveil.functions import parsing as P
from quillveil.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokens_follow_word_boundaries(spark):
    text = "Hello [NAME], foo[BAR]baz a-b c_d Été 12"
    want = re.findall(r"(?u)\b[\w\[\]_-]+\b", text.lower())
    assert one(spark, X.tokens(F.col("t")), t=text) == want
    assert "name" in want and "foo[bar]baz" in want


def test_ngrams(spark):
    w = F.array(*[F.lit(x) for x in "abc"])
    assert one(spark, X.word_ngrams_upto(w, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, X.word_ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, X.char_ngrams(F.col("t"), 4), t="Ab cde") == [" ab ", " cde", "cde "]
    assert one(spark, X.char_ngrams(F.col("t"), 5), t="a") == [" a "]


def test_phrases(spark):
    cases = [("The big  Dog ran", "big dog", True), ("bigdog", "dog", False), ("a_dog", "dog", False), ("dog", "dog", True), ("dog", "", False), ("c.d", "c.d", True), ("cxd", "c.d", False), ("a\\Eb c", "a\\eb", True)]
    for text, phrase, want in cases:
        assert one(spark, X.phrase_in_text(F.col("t"), F.col("p")), t=text, p=phrase) is want, (text, phrase)


def test_ordered_replacement(spark):
    cases = [
        ("Ann Lee met ann", [("Ann", "[A]"), ("Ann Lee", "[AL]")], "[AL] met [A]"),
        ("the lee side of Leeds", [("Lee", "$1\\")], "the $1\\ side of $1\\ds"),
        ("abc", [("", "x"), ("b", "ab"), ("ab", "-")], "-c"),
        ("ab", [("ab", "cd"), ("c", "x")], "xd"),
        ("a.b axb", [("a.b", "!")], "! axb"),
    ]
    for text, pairs, want in cases:
        repl = F.array(*[F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst")) for s, d in pairs])
        assert one(spark, X.replace_ordered(F.col("t"), repl), t=text) == want


def test_span_merge(spark):
    def merged(spans):
        col = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(x).alias("label")) for s, e, x in spans])
        return [tuple(r) for r in one(spark, X.merge_spans(col))]

    assert merged([(5, 8, "A"), (0, 4, "B"), (3, 6, "B")]) == [(0, 8, "[MIXED]")]
    assert merged([(0, 4, "A"), (4, 6, "A")]) == [(0, 4, "A"), (4, 6, "A")]
    assert merged([(0, 9, "A"), (2, 3, "A"), (2, 2, "A")]) == [(0, 9, "A")]
    spans = X.merge_spans(F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("[X]").alias("label"))))
    assert one(spark, X.splice(F.col("t"), spans), t="abcdef") == "ab[X]ef"


def test_small_text_helpers(spark):
    assert one(spark, X.body_text(F.col("t")), t="Subject: x\n\n hi \nmy Contact: y\nbye") == "hi\nbye"
    assert one(spark, X.placeholder_rate(F.col("t")), t="[NAME] went to [CITY_A] now ok") == 2 / 6
    assert one(spark, X.with_article(F.lit("apple"))) == "an apple" and one(spark, X.with_article(F.lit("pear"))) == "a pear"
    assert one(spark, X.tie_break(F.lit(7), F.lit("a"), F.lit("b"))) == int(hashlib.sha256(b"7:a:b").hexdigest()[:12], 16) / 16**12
    assert one(spark, X.pseudonym("ORG", F.lit("d1"))) == "ORG_" + hashlib.sha1(b"d1").hexdigest()[:6].upper()
    assert one(spark, X.rotating_choice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(4), 1)) == 3


def test_parsing(spark):
    answers = {"```json\n{\"a\": 1}\n```": '{"a": 1}', 'so: {"a": {"b": 2}} done': '{"a": {"b": 2}}', "nothing": None, "x [1, 2] y": "[1, 2]", "{bad": None}
    for text, want in answers.items():
        assert one(spark, P.extract_json(F.col("t")), t=text) == want
    for text, want in {"Yes": True, " 0 ": False, "true": True, "maybe": None}.items():
        assert one(spark, P.boolish(F.col("t")), t=text) is want
    assert one(spark, P.safe_double(F.lit("1.5"))) == 1.5 and one(spark, P.safe_double(F.lit("x"))) is None and one(spark, P.safe_double(F.lit(" "))) is None
    ranked = '{"top_candidate": "P9", "ranked": ["P1", {"candidate_id": "P2", "score": 3}]}'
    assert one(spark, P.ranked_ids(F.col("t")), t=ranked) == ["P9", "P1", "P2"]
    assert one(spark, P.canonical_json(b=F.lit("x\"y"), a=F.lit(3))) == '{"a": 3, "b": "x\\"y"}'
    assert one(spark, P.slug(F.lit(" My Run: 3! "))) == "my_run_3"
