"""Queries on rewriting conditions, attacks, context recovery and audit parsing, with their DuckDB SQL.

A persona is a customer: name, account, city (nation), region and employer (segment). Conditions, query
types, target k and candidate numbers are columns, so every sweep is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as X
from ..operators import redaction as R
from ..operators import tfidf as I
from ..operators.search import search
from . import read
from .text import _GRAMS, _TOK, alone, candidates, passages_held

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PERSONA = """
p AS (SELECT c_custkey AS pid, c_name AS name, 'ACCT-' || c_custkey AS account, c_nationkey AS nation, n_name AS city, r_name AS region, c_mktsegment AS employer,
      CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'home goods' ELSE 'industry' END AS sector, c_custkey % 3 AS level
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
d AS (SELECT *, name || ' of ' || city || ', ' || region || ' works in ' || employer || ' and pays by ' || account || '.' AS text FROM p)"""


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personas with their coarse values, planned level and profile text."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    p = joined.select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.concat(F.lit("ACCT-"), F.col("c_custkey")).alias("account"), F.col("c_nationkey").alias("nation"), F.col("n_name").alias("city"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("employer"))
    p = p.withColumn("sector", F.when(F.col("employer").isin("FURNITURE", "HOUSEHOLD"), "home goods").otherwise("industry")).withColumn("level", F.col("pid") % 3)
    return p.withColumn("text", F.format_string("%s of %s, %s works in %s and pays by %s.", "name", "city", "region", "employer", "account"))


def pairs(*items: tuple[Column | str, Column | str]) -> Column:
    """A replacement list; texts that are no column names come as literals."""
    return F.array(*[F.struct(F.col(s).alias("src"), (d if isinstance(d, Column) else F.lit(d)).alias("dst")) for s, d in items])


def replacement_lists(people: DataFrame, employers: DataFrame) -> DataFrame:
    """(pid, condition, replacements): original, direct, stable and document-local pseudonyms, planned levels, all."""
    direct = [("name", "[NAME]"), ("account", "[ACCOUNT]")]
    planned = lambda exact, coarse, gone: R.level_value(F.col(exact), F.col(coarse), F.lit(gone), F.col("level"))
    lists = {
        "c0_original": F.array().cast("array<struct<src:string,dst:string>>"),
        "c1_direct": pairs(*direct),
        "c2_stable": pairs(("name", F.concat(F.lit("PERSON_"), F.col("pid"))), ("account", "[ACCOUNT]"), ("city", F.concat(F.lit("CITY_"), F.lpad(F.col("nation").cast("string"), 3, "0"))), ("employer", F.col("pseudonym"))),
        "c4_local": pairs(*direct, ("city", F.concat(F.lit("a city in the "), F.col("region")))),
        "c5_planned": pairs(*direct, ("city", planned("city", "region", "[CITY]")), ("employer", planned("employer", "sector", "[EMPLOYER]"))),
        "c6_aggressive": pairs(*direct, ("city", "[CITY]"), ("region", "[REGION]"), ("employer", "[EMPLOYER]")),
    }
    full = people.join(employers, "employer")
    return full.select("pid", F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), v.alias("replacements")) for k, v in lists.items()])).alias("x")).select("pid", "x.*")


_REWRITTEN = f"""{_PERSONA},
e AS (SELECT employer, 'ORG_' || lpad((row_number() OVER (ORDER BY employer) - 1)::VARCHAR, 3, '0') AS org FROM (SELECT DISTINCT employer FROM p)),
t AS (SELECT pid, level, name, account, city, region, employer, unnest([
  {{'condition': 'c0_original', 'text': text}},
  {{'condition': 'c1_direct', 'text': replace(replace(text, name, '[NAME]'), account, '[ACCOUNT]')}},
  {{'condition': 'c2_stable', 'text': replace(replace(replace(replace(text, name, 'PERSON_' || pid), account, '[ACCOUNT]'), city || ',', 'CITY_' || lpad(nation::VARCHAR, 3, '0') || ','), employer, org)}},
  {{'condition': 'c4_local', 'text': replace(replace(replace(text, name, '[NAME]'), account, '[ACCOUNT]'), city || ',', 'a city in the ' || region || ',')}},
  {{'condition': 'c5_planned', 'text': replace(replace(replace(replace(text, name, '[NAME]'), account, '[ACCOUNT]'), city || ',', CASE level WHEN 0 THEN city WHEN 1 THEN region ELSE '[CITY]' END || ','), employer, CASE level WHEN 0 THEN employer WHEN 1 THEN sector ELSE '[EMPLOYER]' END)}},
  {{'condition': 'c6_aggressive', 'text': replace(replace(replace(replace(replace(text, name, '[NAME]'), account, '[ACCOUNT]'), city || ',', '[CITY],'), region, '[REGION]'), employer, '[EMPLOYER]')}}]) AS x
  FROM d JOIN e USING (employer)),
x AS (SELECT pid, level, name, account, city, region, employer, x.condition AS condition, x.text AS text FROM t)"""


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personas' texts under all conditions."""
    people = personas(spark, sf_dir)
    employers = R.dense_ids(people, "employer", "ORG")
    return R.transform_conditions(people, replacement_lists(people, employers), "pid")


@query(f"WITH {_REWRITTEN} SELECT pid, condition, text FROM x")
def condition_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).select("pid", "condition", "text")


_BUNDLE = f"""
WITH {_REWRITTEN}, m AS (SELECT *, contains(text, name)::INT AS name_left, contains(text, account)::INT AS account_left, contains(text, city || ',')::INT AS city_left, contains(text, employer)::INT AS employer_left,
  len(regexp_extract_all(text, '\\[[A-Z_]+\\]')) / len(string_split(text, ' ')) AS marks, abs(length(text) - max(length(text)) FILTER (WHERE condition = 'c0_original') OVER (PARTITION BY pid)) AS delta FROM x)"""


@query(_BUNDLE + """ SELECT condition, count(*) AS n, round(avg(name_left), 6) AS name_left, round(avg(account_left), 6) AS account_left, round(avg(city_left), 6) AS city_left, round(avg(employer_left), 6) AS employer_left,
  round(avg(marks), 6) AS placeholder_rate, round(avg(delta), 6) AS mean_delta, round((4 - avg(name_left) - avg(account_left) - avg(city_left) - avg(employer_left)) / 4, 6) AS composite FROM m GROUP BY condition""")
def condition_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each field, marks and length changes for every condition, and their composite."""
    x = rewritten(spark, sf_dir)
    own = Window.partitionBy("pid")
    left = {k: F.contains("text", v).cast("int") for k, v in (("name_left", F.col("name")), ("account_left", F.col("account")), ("city_left", F.concat("city", F.lit(","))), ("employer_left", F.col("employer")))}
    m = x.select("condition", *[v.alias(k) for k, v in left.items()], X.placeholder_rate(F.col("text")).alias("marks"), F.abs(F.length("text") - F.max(F.when(F.col("condition") == "c0_original", F.length("text"))).over(own)).alias("delta"))
    return m.groupBy("condition").agg(F.count("*").alias("n"), *[F.round(F.avg(k), 6).alias(k) for k in left], F.round(F.avg("marks"), 6).alias("placeholder_rate"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round((4 - sum((F.avg(k) for k in left), F.lit(0.0))) / 4, 6).alias("composite"))


@query(f"""WITH {_REWRITTEN}, f AS (SELECT condition, level, (contains(text, city || ','))::INT + contains(text, employer)::INT AS fields FROM x)
SELECT condition, level, count(*) AS n, round(avg(fields), 6) AS mean_fields, sum((fields = 2)::INT)::BIGINT AS both_left FROM f GROUP BY 1, 2""")
def tier_condition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual fields of each condition within each planned level."""
    fields = F.contains("text", F.concat("city", F.lit(","))).cast("int") + F.contains("text", F.col("employer")).cast("int")
    return rewritten(spark, sf_dir).select("condition", "level", fields.alias("fields")).groupBy("condition", "level").agg(F.count("*").alias("n"), F.round(F.avg("fields"), 6).alias("mean_fields"), F.sum((F.col("fields") == 2).cast("int")).alias("both_left"))


_ABLATED = {"direct": ("name", "account"), "place": ("city", "region"), "work": ("employer",), "everything": ("name", "account", "city", "region", "employer")}


@query(f"WITH {_PERSONA} " + " UNION ALL ".join("SELECT pid, '" + k + "' AS ablation, " + "replace(" * len(v) + "text" + "".join(f", {c}{' || chr(44)' if c == 'city' else ''}, '[ABLATE_{c.upper()}]{',' if c == 'city' else ''}')" for c in v) + " AS text FROM d" for k, v in _ABLATED.items()))
def ablation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field groups replaced by marks, one group at a time: the groups and fields are a dimension table."""
    dim = spark.createDataFrame([(k, list(v)) for k, v in _ABLATED.items()], "ablation string, fields array<string>")
    people = personas(spark, sf_dir)
    values = F.map_from_arrays(F.array(*map(F.lit, _ABLATED["everything"])), F.array(*_ABLATED["everything"]))
    lists = people.select("pid", values.alias("v")).crossJoin(F.broadcast(dim)).select("pid", F.col("ablation").alias("condition"), F.transform("fields", lambda f: F.struct(F.col("v")[f].alias("src"), F.concat(F.lit("[ABLATE_"), F.upper(f), F.lit("]")).alias("dst"))).alias("replacements"))
    return R.transform_conditions(people, lists, "pid").select("pid", F.col("condition").alias("ablation"), "text")


_KS = (2, 5, 10, 25, 100)


@query(f"""WITH {_PERSONA}, k AS (SELECT pid, count(*) OVER (PARTITION BY city, employer) AS k0, count(*) OVER (PARTITION BY region, employer) AS k1, count(*) OVER (PARTITION BY region, sector) AS k2, count(*) OVER () AS k3 FROM p),
t AS (SELECT unnest([{', '.join(map(str, _KS))}]) AS target_k),
l AS (SELECT target_k, CASE WHEN k0 >= target_k THEN 0 WHEN k1 >= target_k THEN 1 WHEN k2 >= target_k THEN 2 ELSE 3 END AS level, k0, k1, k2, k3 FROM k, t)
SELECT target_k, count(*) AS n, round(avg(level), 6) AS mean_level, min([k0, k1, k2, k3][level + 1]) AS min_k, round(avg(([k0, k1, k2, k3][level + 1] >= target_k)::INT), 6) AS coverage, round(avg((k1 >= target_k)::INT), 6) AS fixed_level_coverage FROM l GROUP BY target_k""")
def target_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that reach each target k, and what the fixed level 1 would cover.

    Persons count once for each combination of values; combinations are few, so the sweep runs on these.
    """
    cells = personas(spark, sf_dir).groupBy("city", "region", "employer", "sector").agg(F.count("*").alias("people"))
    within = lambda *by: F.sum("people").over(Window.partitionBy(*by))
    k = cells.select("people", within("city", "employer").alias("k0"), within("region", "employer").alias("k1"), within("region", "sector").alias("k2"), within(F.lit(0)).alias("k3"))
    t = k.select("*", F.explode(F.array(*map(F.lit, _KS))).alias("target_k"))
    level = F.when(F.col("k0") >= F.col("target_k"), 0).when(F.col("k1") >= F.col("target_k"), 1).when(F.col("k2") >= F.col("target_k"), 2).otherwise(3)
    t = t.withColumn("level", level).withColumn("k", F.element_at(F.array("k0", "k1", "k2", "k3"), F.col("level") + 1))
    mean = lambda c: F.round(F.sum(c * F.col("people")) / F.sum("people"), 6)
    return t.groupBy("target_k").agg(F.sum("people").alias("n"), mean(F.col("level")).alias("mean_level"), F.min("k").alias("min_k"), mean((F.col("k") >= F.col("target_k")).cast("int")).alias("coverage"), mean((F.col("k1") >= F.col("target_k")).cast("int")).alias("fixed_level_coverage"))


_CHAR = r"flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''), lambda x: flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(x) + 2 - n + 1, 1) + 1), lambda i: substring(' ' || x || ' ', i, n))))))"


def _attack(name: str, terms: str) -> str:
    return f"""
{name}c AS (SELECT q, slot, term, count(*) AS tf FROM (SELECT q, slot, {terms} AS term FROM g) GROUP BY 1, 2, 3),
{name}m AS (SELECT q, term, ln((1 + 11) / (1.0 + count(*))) + 1 AS idf FROM {name}c GROUP BY 1, 2 HAVING count(*) <= 0.9 * 11),
{name}r AS (SELECT q, slot, term, (1 + ln(tf)) * idf AS w FROM {name}c JOIN {name}m USING (q, term)),
{name}w AS (SELECT q, slot, term, w / sqrt(sum(w * w) OVER (PARTITION BY q, slot)) AS w FROM {name}r),
{name}s AS (SELECT a.q, b.slot, sum(a.w * b.w) AS score FROM {name}w a JOIN {name}w b ON a.q = b.q AND a.term = b.term AND a.slot = -1 AND b.slot >= 0 GROUP BY 1, 2)"""


_HYBRID = f"""
WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn > 0) AS body, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn = 0) AS profile,
           row_number() OVER (ORDER BY conv_id) - 1 AS pos, count(*) OVER () AS total FROM conversations GROUP BY conv_id),
g AS (SELECT a.conv_id AS q, b.conv_id AS cand, o.o AS slot, b.profile AS text FROM c a, (SELECT unnest(range(0, 10)) AS o) o JOIN c b ON b.pos = (a.pos + o.o * 7) % a.total
      UNION ALL SELECT conv_id, NULL, -1, body FROM c),
{_attack("x", _GRAMS.format("coalesce(text, '')"))}, {_attack("y", "unnest(" + _CHAR.format("coalesce(text, '')") + ")")},
s AS (SELECT g.q, g.cand, g.slot, coalesce(xs.score, 0) AS word, coalesce(ys.score, 0) AS char FROM g LEFT JOIN xs ON xs.q = g.q AND xs.slot = g.slot LEFT JOIN ys ON ys.q = g.q AND ys.slot = g.slot WHERE g.slot >= 0),
h AS (SELECT q, cand, slot, unnest([{{'attack': 'word', 'score': word}}, {{'attack': 'char', 'score': char}}, {{'attack': 'hybrid', 'score': 0.5 * word + 0.5 * char}}]) AS x FROM s),
a AS (SELECT q, cand, slot, x.attack AS attack, x.score AS score FROM h)"""


def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, cand, slot, attack, score): word, character and hybrid similarity of each candidate."""
    text = F.coalesce("text", F.lit(""))
    out = I.group_cosines(candidates(spark, sf_dir)[1].withColumn("text", text), "q", "slot", "cand", {"word": lambda t: X.tokens(t, X.PORTABLE), "char": X.space_words}, {"word": X.runs_of, "char": X.char_runs_of}, 11, 0.9)
    kinds = F.array(*[F.struct(F.lit(k).alias("attack"), s.alias("score")) for k, s in (("word", F.col("word")), ("char", F.col("char")), ("hybrid", 0.5 * F.col("word") + 0.5 * F.col("char")))])
    return out.select("q", "cand", "slot", F.explode(kinds).alias("x")).select("q", "cand", "slot", "x.*")


@query(_HYBRID + """, r AS (SELECT *, row_number() OVER (PARTITION BY attack, q ORDER BY round(score, 9) DESC, slot) AS rank FROM a),
t AS (SELECT attack, q, min(rank) FILTER (WHERE slot = 0) AS rank, max(score) FILTER (WHERE slot = 0) AS own, arg_min(cand, rank) FILTER (WHERE slot > 0) AS rival, max(round(score, 9)) FILTER (WHERE slot > 0) AS best FROM r GROUP BY 1, 2)
SELECT attack, q AS conv_id, rank::INT AS rank, rival, round(own - best, 6) AS margin FROM t""")
def attack_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the true candidate, the nearest wrong one and the margin over it, for each attack."""
    r = I.ranked(attacks(spark, sf_dir), ["attack", "q"], [F.desc(F.round("score", 9)), F.asc("slot")])
    true, wrong = F.col("slot") == 0, F.col("slot") > 0
    t = r.groupBy("attack", F.col("q").alias("conv_id")).agg(F.min(F.when(true, F.col("rank"))).alias("rank"), F.max(F.when(true, F.col("score"))).alias("own"), F.min(F.when(wrong, F.struct("rank", "cand")))["cand"].alias("rival"), F.max(F.when(wrong, F.round("score", 9))).alias("best"))
    return t.select("attack", "conv_id", "rank", "rival", F.round(F.col("own") - F.col("best"), 6).alias("margin"))


@query(_HYBRID + """, n AS (SELECT unnest([2, 5, 10]) AS n),
r AS (SELECT n, attack, q, slot, row_number() OVER (PARTITION BY n, attack, q ORDER BY round(score, 9) DESC, slot) AS rank FROM a JOIN n ON slot < n)
SELECT attack, n AS candidates, round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 3)::INT), 6) AS top3, round(avg(rank), 6) AS mean_rank, round(1.0 / n, 6) AS chance_top1, round(least(3, n) / n, 6) AS chance_top3 FROM r WHERE slot = 0 GROUP BY attack, n""")
def candidate_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each attack fares among the first n candidates, beside chance."""
    a = attacks(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10)))).where("slot < n")
    r = I.ranked(a, ["n", "attack", "q"], [F.desc(F.round("score", 9)), F.asc("slot")]).where("slot = 0")
    return r.groupBy("attack", F.col("n").alias("candidates")).agg(F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("rank") <= 3).cast("int")), 6).alias("top3"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(1 / F.first("n"), 6).alias("chance_top1"), F.round(F.least(F.lit(3), F.first("n")) / F.first("n"), 6).alias("chance_top3"))


_TYPES = {"short": 6, "medium": 15, "verbose": 100_000}


@query(f"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM benchmark),
y AS (SELECT item_id, t.kind AS query_type, array_to_string(w[1:t.n], ' ') AS text FROM b, (SELECT unnest([{', '.join("{'kind': '" + k + "', 'n': " + str(n) + "}" for k, n in _TYPES.items())}]) AS t)),
tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_GRAMS.format('text')} AS term FROM documents) GROUP BY 1, 2),
m AS (SELECT term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tc GROUP BY 1), (SELECT count(*) AS n FROM documents) WHERE df <= 0.9 * n),
r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tc JOIN m USING (term)),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r),
qc AS (SELECT query_type, item_id, term, count(*) AS tf FROM (SELECT query_type, item_id, {_GRAMS.format('text')} AS term FROM y) GROUP BY 1, 2, 3),
qr AS (SELECT query_type, item_id, term, (1 + ln(tf)) * idf AS w FROM qc JOIN m USING (term)),
q AS (SELECT query_type, item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_type, item_id)) AS w FROM qr),
s AS (SELECT query_type, item_id, doc_id, sum(q.w * w.w) AS score FROM q JOIN w USING (term) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY query_type, item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
t AS (SELECT query_type, item_id, count(*) AS n_docs, sum(contains(d.text, b.text)::INT) AS held, min(rank) FILTER (WHERE contains(d.text, b.text)) AS first_rank FROM k JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 10 GROUP BY 1, 2)
SELECT query_type, count(*) AS n_queries, sum((held > 0)::INT)::BIGINT AS recovered, round(avg((held > 0)::INT), 6) AS recovery_rate, sum(held)::BIGINT AS passages_held, round(avg(held / n_docs), 6) AS context_share, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM t GROUP BY query_type""")
def context_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ten documents found for short, medium and verbose queries still hold of the passage."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    asked = items.select("item_id", words.alias("w")).select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("query_type"), F.array_join(F.slice("w", 1, n), " ").alias("text")) for k, n in _TYPES.items()])).alias("x")).select("item_id", "x.*")
    terms = X.tokens(F.col("text"), X.PORTABLE)
    if alone(docs, "doc_id"):
        top = search(docs, "doc_id", [terms], asked, ["query_type", "item_id"], terms, 0.9, 10)[0]
    else:
        counts = I.hashed_counts(docs, ["doc_id"], terms)
        scored = I.cosines(I.hashed_counts(asked, ["query_type", "item_id"], terms), counts, docs.agg(F.count("*").alias("n")), 0.9, [], ["query_type", "item_id"], ["doc_id"])
        top = I.ranked(scored, ["query_type", "item_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")]).where("rank <= 10")
    top = top.join(passages_held(docs, items).withColumn("held", F.lit(1)), ["item_id", "doc_id"], "left").fillna({"held": 0})
    t = top.groupBy("query_type", "item_id").agg(F.count("*").alias("n_docs"), F.sum("held").alias("held"), F.min(F.when(F.col("held") == 1, F.col("rank"))).alias("first_rank"))
    some = (F.col("held") > 0).cast("int")
    return t.groupBy("query_type").agg(F.count("*").alias("n_queries"), F.sum(some).alias("recovered"), F.round(F.avg(some), 6).alias("recovery_rate"), F.sum("held").alias("passages_held"), F.round(F.avg(F.col("held") / F.col("n_docs")), 6).alias("context_share"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


@query(r"""WITH d AS (SELECT lang, length(text) AS chars, regexp_extract_all(lower(text), '[\p{L}\p{N}_\[\]-]+') AS w, string_split(text, chr(10))[1] AS line FROM documents)
SELECT lang, count(*) AS n, round(avg(chars), 6) AS mean_chars, round(avg(len(w)), 6) AS mean_tokens, round(median(len(w)), 6) AS median_tokens, round(avg(len(list_distinct(w)) / greatest(len(w), 1)), 6) AS type_token_ratio, count(DISTINCT line) AS first_lines FROM d GROUP BY lang""")
def style_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, vocabulary and first lines by language; a null language is a group."""
    d = read(spark, sf_dir, "documents").select("lang", F.length("text").alias("chars"), X.tokens(F.col("text"), X.PORTABLE).alias("w"), F.substring_index("text", "\n", 1).alias("line"))
    d = d.select("lang", "chars", "line", F.size("w").alias("n"), (F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))).alias("ratio"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.round(F.avg(F.col("n")), 6).alias("mean_tokens"), F.round(F.median("n"), 6).alias("median_tokens"), F.round(F.avg("ratio"), 6).alias("type_token_ratio"), F.countDistinct("line").alias("first_lines"))


_ANSWER = """'note: {"ranked": [{"id": "c' || user_id || '", "score": ' || json_extract_string(props, '$.k') || '}, {"id": "c' || (user_id + 1) || '", "score": 5}], "fields": ["' || event_type || '", " City ", ""], "found": ' || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || CASE WHEN event_id % 7 = 0 THEN '' ELSE '}' END"""


@query(f"""WITH a AS (SELECT event_id, user_id, event_type, {_ANSWER} AS answer FROM events),
j AS (SELECT *, event_id % 7 <> 0 AS parsed, answer[7:] AS js FROM a),
f AS (SELECT event_id, event_type, parsed, CASE WHEN parsed THEN json_extract_string(js, '$.found') = 'true' END AS found, CASE WHEN parsed THEN json_extract_string(js, '$.ranked[0].score')::DOUBLE END AS own_score,
  CASE WHEN parsed THEN 2 ELSE 0 END AS n_fields FROM j)
SELECT event_type, count(*) AS n, sum(parsed::INT)::BIGINT AS n_parsed, round(avg(parsed::INT), 6) AS parse_rate, round(avg(found::INT), 6) AS found_rate, round(avg(own_score), 6) AS mean_own_score, sum(n_fields)::BIGINT AS fields_named FROM f GROUP BY event_type""")
def audit_parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parsed where they can be: score map of the ranked list, clean field lists, nullable flags.

    Figures that need a parsed answer leave the others out; the parse rate counts them.
    """
    k = F.get_json_object("props", "$.k")
    flag = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("null")), (F.col("event_id") % 3 + 1).cast("int"))
    answer = F.concat(F.lit('note: {"ranked": [{"id": "c'), "user_id", F.lit('", "score": '), k, F.lit('}, {"id": "c'), F.col("user_id") + 1, F.lit('", "score": 5}], "fields": ["'), "event_type", F.lit('", " City ", ""], "found": '), flag, F.when(F.col("event_id") % 7 == 0, "").otherwise("}"))
    kind = "struct<ranked:array<struct<id:string,score:double>>,fields:array<string>,found:string>"
    e = read(spark, sf_dir, "events").select("event_type", F.concat(F.lit("c"), "user_id").alias("own"), F.from_json(F.when(F.col("event_id") % 7 != 0, P.extract_json(answer)), kind).alias("j"))
    parsed = F.col("j.ranked").isNotNull()
    scores = F.map_from_entries(F.transform("j.ranked", lambda x: F.struct(x["id"], x["score"])))
    fields = F.array_distinct(F.filter(F.transform("j.fields", lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    m = e.select("event_type", parsed.alias("parsed"), P.boolish(F.col("j.found")).alias("found"), F.try_element_at(scores, F.col("own")).alias("own_score"), F.coalesce(F.size(fields), F.lit(0)).alias("n_fields"))
    return m.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("parsed").cast("int")).alias("n_parsed"), F.round(F.avg(F.col("parsed").cast("int")), 6).alias("parse_rate"), F.round(F.avg(F.col("found").cast("int")), 6).alias("found_rate"), F.round(F.avg("own_score"), 6).alias("mean_own_score"), F.sum(F.when(F.col("parsed"), F.col("n_fields")).otherwise(0)).alias("fields_named"))


@query("""WITH l AS (SELECT o_custkey, unnest(string_split(o_orderstatus || '|' || substring(o_orderpriority, 3) || '|' || o_orderstatus, '|')) AS label FROM orders),
c AS (SELECT count(DISTINCT o_custkey) AS cases FROM orders)
SELECT label, count(*) AS mentions, count(DISTINCT o_custkey) AS n_cases, round(count(DISTINCT o_custkey) / max(cases), 6) AS case_rate FROM l, c GROUP BY label""")
def label_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each label of the joined lists occurs, and in what share of the cases."""
    o = read(spark, sf_dir, "orders")
    labels = o.select("o_custkey", F.explode(F.split(F.concat_ws("|", "o_orderstatus", F.substring("o_orderpriority", 3, 100), "o_orderstatus"), r"\|")).alias("label"))
    cases = o.agg(F.countDistinct("o_custkey").alias("cases"))
    counts = labels.groupBy("label").agg(F.count("*").alias("mentions"), F.countDistinct("o_custkey").alias("n_cases"))
    return counts.crossJoin(F.broadcast(cases)).select("label", "mentions", "n_cases", F.round(F.col("n_cases") / F.col("cases"), 6).alias("case_rate"))


_CASES = {"dear": "o_totalprice >= 40000", "urgent": "o_orderpriority = '1-URGENT'", "pending": "o_orderstatus = 'P'"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS bucket, o_orderkey, o_totalprice AS price, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS nth FROM orders WHERE {w}) WHERE nth <= 8" for k, w in _CASES.items()))
def bucketed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight dearest orders of each of three overlapping buckets: a report of fixed size."""
    o = read(spark, sf_dir, "orders")
    hit = F.filter(F.array(*[F.when(F.expr(w), F.lit(k)) for k, w in _CASES.items()]), lambda b: b.isNotNull())
    rows = o.select(F.explode(hit).alias("bucket"), "o_orderkey", F.col("o_totalprice").alias("price"))
    return I.ranked(rows, ["bucket"], [F.desc("price"), F.asc("o_orderkey")]).where("rank <= 8").withColumnRenamed("rank", "nth")


@query("""SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'unknown' ELSE 'known' END AS state, coalesce(n, -1)::BIGINT AS n_orders, coalesce(nullif(trim(CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE lower(c_name) END), ''), c_name) AS shown,
  coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'FURNITURE' THEN 'Home' END, c_mktsegment) AS label, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS place
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON c_custkey = o_custkey""")
def id_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids a log knows, default values where it doesn't, blank rewrites, labels with a fallback and an explicit order."""
    c = read(spark, sf_dir, "customer")
    log = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    names = F.create_map(*map(F.lit, ("BUILDING", "Construction", "FURNITURE", "Home")))
    rewrite = F.when(F.col("c_custkey") % 4 == 0, " ").when(F.col("c_custkey") % 4 > 1, F.lower("c_name"))
    order = F.when(F.col("c_mktsegment") == "MACHINERY", 0).when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2)
    return c.join(log, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "unknown").otherwise("known").alias("state"), F.coalesce("n", F.lit(-1)).alias("n_orders"), F.coalesce(F.nullif(F.trim(rewrite), F.lit("")), "c_name").alias("shown"), F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), "c_mktsegment").alias("label"), order.alias("place"))


@query("""WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS pos, count(*) OVER () AS total FROM (SELECT DISTINCT conv_id FROM conversations)),
g AS (SELECT a.conv_id AS q, b.conv_id AS cand FROM c a, (SELECT unnest(range(0, 10)) AS o) o JOIN c b ON b.pos = (a.pos + o.o * 7) % a.total),
s AS (SELECT q, count(*) AS n, count(DISTINCT cand) AS distinct_n, max((cand = q)::INT) AS held FROM g GROUP BY q)
SELECT check_id, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, bad FROM (
SELECT 'size_ten' AS check_id, sum((n <> 10)::INT)::BIGINT AS bad FROM s UNION ALL SELECT 'unique_candidates', sum((n <> distinct_n)::INT)::BIGINT FROM s
UNION ALL SELECT 'truth_held', sum((held = 0)::INT)::BIGINT FROM s UNION ALL SELECT 'candidates_known', (SELECT count(*) FROM g WHERE cand NOT IN (SELECT conv_id FROM conversations)))""")
def candidate_set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands, _, convs = candidates(spark, sf_dir)
    s = cands.groupBy("q").agg(F.count("*").alias("n"), F.countDistinct("cand").alias("d"), F.max((F.col("cand") == F.col("q")).cast("int")).alias("held"))
    bad = s.agg(F.sum((F.col("n") != 10).cast("int")).alias("size_ten"), F.sum((F.col("n") != F.col("d")).cast("int")).alias("unique_candidates"), F.sum((F.col("held") == 0).cast("int")).alias("truth_held"))
    bad = bad.crossJoin(cands.join(convs, F.col("cand") == F.col("conv_id"), "left_anti").agg(F.count("*").alias("candidates_known")))
    return bad.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.when(F.col(k) == 0, "PASS").otherwise("FAIL").alias("status"), F.col(k).alias("bad")) for k in bad.columns])).alias("x")).select("x.*")


@query(f"""WITH d AS (SELECT doc_id, source, lang, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(lower(x), 'subject:') AND NOT contains(lower(x), 'contact') AND NOT contains(lower(x), 'identity line')), chr(10)) AS body FROM documents),
w AS (SELECT doc_id, lang, {_TOK.format("body")} AS w FROM d)
SELECT lang, count(*) AS n, sum(len(w))::BIGINT AS body_tokens, sum((len(w) = 0)::INT)::BIGINT AS empty_bodies FROM w GROUP BY lang""")
def body_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the bodies alone, the lines that name an identity left out."""
    w = read(spark, sf_dir, "documents").select("lang", F.size(X.tokens(X.body_text(F.col("text")), X.PORTABLE)).alias("n"))
    return w.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").alias("body_tokens"), F.sum((F.col("n") == 0).cast("int")).alias("empty_bodies"))
