"""Text queries on documents, benchmark and conversations, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import patterns as P
from ..operators import redaction as R
from ..operators import reports as A
from ..operators import tfidf as I
from ..operators.reports import written
from ..operators.search import search
from . import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\[\]-]+')"


#: All runs of one to three tokens.
_GRAMS = "unnest(flatten(list_transform([" + _TOK + "], lambda w: list_concat(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))))"


def passages_held(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a document's text holds a passage's text.

    A passage's second to fifth word stand whole in each text that holds it; their hash finds the few pairs whose
    texts are compared. A passage of three to five words has its second word whole. Shorter ones needn't hold a whole
    word at all: they make one automaton that is passed over each text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    run = lambda w, i, n: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])
    items = items.select("item_id", F.col("text").alias("passage")).withColumn("w", words(F.col("passage")))
    size = F.size("w")
    sought = items.where(size >= 3).select("item_id", "passage", F.when(size >= 6, run(F.col("w"), F.lit(1), 4)).otherwise(run(F.col("w"), F.lit(1), 1)).alias("h"))
    lengths = [n for n, some in ((4, size >= 6), (1, size.between(3, 5))) if not items.where(some).isEmpty()]
    every = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: run(F.col("w"), i, n))
    runs = F.flatten(F.array(*map(every, lengths))) if lengths else F.array().cast("array<long>")
    found = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(runs)).alias("h")).join(sought.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    pairs = found.join(docs.select("doc_id", "text"), "doc_id").join(sought.drop("h"), "item_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    short = items.where(size < 3)
    if short.isEmpty():
        return pairs
    hits = P.phrases_in(docs, ["doc_id"], "text", short, "passage").withColumnRenamed("phrase", "passage").join(short.select("item_id", "passage"), "passage").select("item_id", "doc_id")
    empty = docs.where("text is not null").select("doc_id").crossJoin(F.broadcast(short.where("passage = ''").select("item_id"))) if not short.where("passage = ''").isEmpty() else None
    out = pairs.union(hits)
    return out.union(empty.select("item_id", "doc_id")) if empty is not None else out


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(q, cand, slot) with ten candidates for each conversation, the true one at slot 0; the texts
    (q, cand, slot, text), the conversation's own at -1; the conversations."""
    turns = read(spark, sf_dir, "conversations")
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    convs = turns.groupBy("conv_id").agg(joined(F.col("turn") > 0).alias("body"), joined(F.col("turn") == 0).alias("profile"))
    place, total = A.numbered(turns.select("conv_id"), "conv_id", "pos")
    slots = place.select(F.col("conv_id").alias("q"), "pos", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot")).crossJoin(F.broadcast(total)).withColumn("pos", (F.col("pos") + F.col("slot") * 7) % F.col("total")).drop("total")
    cands = slots.join(place.select("pos", F.col("conv_id").alias("cand")), "pos").select("q", "cand", "slot")
    own = convs.select(F.col("conv_id").alias("q"), F.lit(None).cast(dict(convs.dtypes)["conv_id"]).alias("cand"), F.lit(-1).alias("slot"), F.col("body").alias("text"))
    texts = cands.join(convs.select(F.col("conv_id").alias("cand"), F.col("profile").alias("text")), "cand").select("q", "cand", "slot", "text").union(own)
    return cands, texts, convs


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, {_TOK.format('text')} AS w FROM documents)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.tokens(F.col("text"), X.PORTABLE)
    return read(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(f"""
WITH d AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents),
g AS (SELECT doc_id, n, array_to_string(w[i:i+n-1], ' ') AS term
      FROM d, (SELECT unnest([1, 2, 3]) AS n) k, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) t)
SELECT n, term, count(DISTINCT doc_id) AS df FROM g GROUP BY n, term HAVING count(DISTINCT doc_id) >= 5""")
def word_ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frequent_runs(read(spark, sf_dir, "documents"), "text", lambda t: X.tokens(t, X.PORTABLE), 5)


@query(r"""
WITH p AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT doc_id, n, substring(w, i, n) AS gram FROM p, (SELECT unnest([3, 4, 5]) AS n) k,
      LATERAL (SELECT unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i) t)
SELECT n, gram, count(*) AS occurrences FROM g GROUP BY n, gram HAVING count(*) >= 100""")
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams stay within words, so each distinct word gives its own once, times its number."""
    words = read(spark, sf_dir, "documents").select(F.explode(X.space_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), X.char_ngrams(F.col("w"), n).alias("grams")) for n in (3, 4, 5)])
    return words.select("c", F.explode(grams).alias("g")).select("c", "g.n", F.explode("g.grams").alias("gram")).groupBy("n", "gram").agg(F.sum("c").alias("occurrences")).where("occurrences >= 100")


def _tfidf(max_df: float) -> str:
    return f"""
WITH tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_GRAMS.format('text')} AS term FROM documents) GROUP BY 1, 2),
m AS (SELECT term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tc GROUP BY 1), (SELECT count(*) AS n FROM documents) WHERE df <= {max_df} * n),
r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tc JOIN m USING (term)),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r),
qc AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, {_GRAMS.format('text')} AS term FROM benchmark) GROUP BY 1, 2),
qr AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM qc JOIN m USING (term)),
q AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qr),
s AS (SELECT item_id, doc_id, sum(q.w * w.w) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _weights(spark: SparkSession, sf_dir: str, max_df: float) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents")
    terms = X.tokens(F.col("text"), X.PORTABLE)
    counts = I.term_counts(docs, ["doc_id"], terms, 3)
    model = I.fit(counts, docs.agg(F.count("*").alias("n")), [], max_df=max_df)
    queries = I.term_counts(read(spark, sf_dir, "benchmark"), ["item_id"], terms, 3)
    return I.weigh(counts, model, [], ["doc_id"]), I.weigh(queries, model, [], ["item_id"])


def _scored(spark: SparkSession, sf_dir: str, max_df: float) -> DataFrame:
    """(item_id, doc_id, score) of all documents that share a term with an item."""
    docs = read(spark, sf_dir, "documents")
    terms = X.tokens(F.col("text"), X.PORTABLE)
    n = docs.agg(F.count("*").alias("n"))
    return I.cosines(I.hashed_counts(read(spark, sf_dir, "benchmark"), ["item_id"], terms), I.hashed_counts(docs, ["doc_id"], terms), n, max_df, [], ["item_id"], ["doc_id"])


def alone(docs: DataFrame, key: str) -> bool:
    """Whether no two rows share their key; rows that do count as one document and take the former plan."""
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _found(spark: SparkSession, sf_dir: str, max_df: float, k: int, relevant: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The k best documents for each item, and the ranks of the first relevant ones."""
    docs, items, terms = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), X.tokens(F.col("text"), X.PORTABLE)
    if alone(docs, "doc_id"):
        return search(docs, "doc_id", [terms], items, ["item_id"], terms, max_df, k, relevant)
    scored = _scored(spark, sf_dir, max_df)
    return _best(scored, ["item_id"], k), None if relevant is None else I.first_relevant(scored, relevant, ["item_id"], "doc_id")


def _best(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    return I.ranked(scored, by, [F.desc(F.round("score", 9)), F.asc("doc_id")]).where(F.col("rank") <= n)


@query(_tfidf(0.65) + """
SELECT doc_id, term, round(w, 6) AS weight, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank FROM w) WHERE rank <= 5""")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return I.top_terms(docs, "doc_id", X.tokens(F.col("text"), X.PORTABLE), 5, 0.65).select("doc_id", "term", F.round("w", 6).alias("weight"), "rank")
    docs, _ = _weights(spark, sf_dir, 0.65)  # rows of one id count as one document
    return I.ranked(docs, ["doc_id"], [F.desc(F.round("w", 9)), F.asc("term")]).where("rank <= 5").select("doc_id", "term", F.round("w", 6).alias("weight"), "rank")


@query(_tfidf(0.65) + " SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 5")
def tfidf_topk_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 0.65, 5)[0].select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_tfidf(0.9) + """,
t AS (SELECT k.*, contains(d.text, b.text) AS rel FROM k JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
p AS (SELECT item_id, max((rel AND rank <= 1)::INT) AS h1, max((rel AND rank <= 5)::INT) AS h5, max((rel AND rank <= 10)::INT) AS h10,
      sum((rel AND rank <= 10)::INT) AS f10, sum(rel::INT) AS total, min(rank) FILTER (WHERE rel) AS first_rank FROM t GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(h1), 6) AS hit_at_1, round(avg(h5), 6) AS hit_at_5, round(avg(h10), 6) AS hit_at_10,
       round(avg((f10 >= 2)::INT), 6) AS multi_at_10, round(avg(f10 / total), 6) AS recall_at_10, round(avg(1.0 / first_rank), 6) AS mrr
FROM p WHERE total > 0""")
def retrieval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    relevant = written(passages_held(docs, items))
    best, first = _found(spark, sf_dir, 0.9, 10, relevant)
    found = best.join(relevant, ["item_id", "doc_id"]).groupBy("item_id").agg(F.count("*").alias("found"))
    m = first.join(found, "item_id", "left").fillna({"found": 0})
    within = lambda k: F.round(F.avg((F.col("first_rank") <= k).cast("int")), 6)
    return m.agg(F.count("*").alias("n_queries"), within(1).alias("hit_at_1"), within(5).alias("hit_at_5"), within(10).alias("hit_at_10"), F.round(F.avg((F.col("found") >= 2).cast("int")), 6).alias("multi_at_10"), F.round(F.avg(F.col("found") / F.col("total")), 6).alias("recall_at_10"), F.round(F.avg(1 / F.col("first_rank")), 6).alias("mrr"))


@query(f"""
WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn > 0) AS body, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn = 0) AS profile,
           row_number() OVER (ORDER BY conv_id) - 1 AS pos, count(*) OVER () AS total FROM conversations GROUP BY conv_id),
g AS (SELECT a.conv_id AS q, b.conv_id AS cand, o.o AS slot, b.profile AS text FROM c a, (SELECT unnest(range(0, 10)) AS o) o JOIN c b ON b.pos = (a.pos + o.o * 7) % a.total
      UNION ALL SELECT conv_id, NULL, -1, body FROM c),
tc AS (SELECT q, slot, term, count(*) AS tf FROM (SELECT q, slot, {_GRAMS.format("coalesce(text, '')")} AS term FROM g) GROUP BY 1, 2, 3),
df AS (SELECT q, term, count(*) AS df FROM tc GROUP BY 1, 2),
m AS (SELECT q, term, ln((1 + 11) / (1.0 + df)) + 1 AS idf FROM df WHERE df <= 0.9 * 11),
r AS (SELECT q, slot, term, (1 + ln(tf)) * idf AS w FROM tc JOIN m USING (q, term)),
w AS (SELECT q, slot, term, w / sqrt(sum(w * w) OVER (PARTITION BY q, slot)) AS w FROM r),
s AS (SELECT a.q, b.slot, sum(a.w * b.w) AS score FROM w a JOIN w b ON a.q = b.q AND a.term = b.term AND a.slot = -1 AND b.slot >= 0 GROUP BY 1, 2),
k AS (SELECT g.q, g.cand, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY g.q ORDER BY round(coalesce(score, 0), 9) DESC, g.cand DESC) AS rank
      FROM g LEFT JOIN s ON s.q = g.q AND s.slot = g.slot WHERE g.slot >= 0)
SELECT q AS conv_id, rank::INT AS rank, (rank = 1)::INT AS top1, (rank <= 3)::INT AS top3, round(score, 6) AS score_true FROM k WHERE cand = q""")
def per_group_aux_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match the later turns of a conversation against the first turns of ten candidates."""
    texts = candidates(spark, sf_dir)[1].withColumn("text", F.coalesce("text", F.lit("")))
    scored = I.group_cosines(texts, "q", "slot", "cand", {"score": lambda t: X.tokens(t, X.PORTABLE)}, {"score": X.runs_of}, 11, 0.9)
    ranks = I.ranked(scored, ["q"], [F.desc(F.round("score", 9)), F.desc("cand")])
    return ranks.where("cand = q").select(F.col("q").alias("conv_id"), "rank", (F.col("rank") == 1).cast("int").alias("top1"), (F.col("rank") <= 3).cast("int").alias("top3"), F.round("score", 6).alias("score_true"))


_SIG = rf"""
WITH t AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(list_transform(regexp_extract_all(text, '{X.EMAIL}'), lambda x: 'handle::' || lower(x)),
           list_transform(regexp_extract_all(text, '{X.PHONE.replace(chr(92), chr(92))}'), lambda x: 'handle::' || x)),
           list_filter(['phrase::license', 'phrase::password', 'phrase::copyright', 'phrase::all rights reserved'], lambda p: contains(lower(text), p[9:])))) AS tok FROM documents),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
i AS (SELECT tok, ln((n + 1) / (count(*) + 1.0)) + 1 AS idf FROM t, n GROUP BY tok, n),
w AS (SELECT doc_id, tok, idf / sqrt(sum(idf * idf) OVER (PARTITION BY doc_id)) AS w FROM t JOIN i USING (tok)),
sig AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2)"""


def _signature_tokens() -> Column:
    return R.signature_tokens(F.col("text"), [X.EMAIL, X.PHONE], ["license", "password", "copyright", "all rights reserved"])


def _signature_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term), written, as searching the texts costs more than all that follows."""
    return written(docs.select("doc_id", F.explode(_signature_tokens()).alias("term")))


def _signature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = _signature_terms(docs).withColumn("tf", F.lit(1))
    model = I.fit(counts, docs.agg(F.countDistinct("doc_id").alias("n")), [])
    return I.weigh(counts, model, [], ["doc_id"], binary=True)


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    terms = _signature_terms(docs)
    model = I.fit(terms, docs.agg(F.countDistinct("doc_id").alias("n")), [])
    members, classes, light, heavy = P.term_classes(terms, "doc_id", model)
    return P.row_scores(members, "doc_id", P.class_scores(classes, light, heavy))


@query(_SIG + " SELECT a, b, round(s, 6) AS score FROM sig")
def signature_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select("a", "b", F.round("score", 6).alias("score"))


@query(_SIG + f""",
tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_GRAMS.format('text')} AS term FROM documents) GROUP BY 1, 2),
m AS (SELECT term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tc GROUP BY 1), (SELECT count(*) AS n FROM documents) WHERE df <= 0.65 * n),
r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tc JOIN m USING (term) WHERE doc_id IN (SELECT doc_id FROM t)),
x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r),
tx AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS s FROM x a JOIN x b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE doc_id IN (SELECT doc_id FROM t))
SELECT a, b, round(0.9 * sig.s + 0.1 * tx.s, 6) AS score FROM sig JOIN tx USING (a, b) WHERE 0.9 * sig.s + 0.1 * tx.s >= 0.95
  AND a IN (SELECT rep FROM e) AND (b IN (SELECT rep FROM e) OR a = (SELECT rep FROM e WHERE e.doc_id = b))""")
def blended_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose 0.9 signature and 0.1 TF-IDF similarity is 0.95 or more.

    These have a TF-IDF cosine of 0.5 at least and both have a signature. Equal texts are one class, which
    its smallest id stands for in pairs with others; each other id of a class is paired with it (score 1).
    """
    docs, words = read(spark, sf_dir, "documents"), X.tokens(F.col("text"), X.PORTABLE)
    signed = written(_signature_weights(spark, sf_dir))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(signed.select("doc_id").distinct(), "doc_id", "left_semi")
    # texts meet by hash and are compared whole; each class has one representative
    members = texts.groupBy("h", "text").agg(F.min("doc_id").alias("a"), F.collect_set("doc_id").alias("ids"))
    copies = members.select("a", F.explode("ids").alias("b")).where("a <> b").select("a", "b", F.lit(1.0).alias("score"))
    reps = members.select(F.col("a").alias("doc_id"))
    # terms as 64-bit hashes, and only those that a representative holds
    counts = I.hashed_counts(docs.join(reps, "doc_id", "left_semi"), ["doc_id"], words)
    every = I.fit(I.hashed_counts(docs, ["doc_id"], words), docs.agg(F.count("*").alias("n")), [], max_df=0.65)
    model = written(every.join(counts.select("term").distinct(), "term", "left_semi"))
    # the signatures' cosine is 0.944 at least, so the two share one of the first tokens of both
    order = Window.partitionBy("doc_id").orderBy(F.desc("w"), "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(order), F.lit(0.0))
    marks = signed.withColumn("before", before).where(1 - F.col("before") >= (0.85 / 0.9) ** 2 - 1e-6).select("doc_id", F.col("term").alias("mark")).distinct()
    near = I.close_pairs(written(I.weigh(counts, model, [], ["doc_id"])), model, "doc_id", 0.5, marks).withColumnRenamed("score", "t")
    a, b = (signed.select(F.col("doc_id").alias(c), "term", F.col("w").alias(f"w{c}")) for c in "ab")
    both = near.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b", "t").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    score = 0.9 * F.col("s") + 0.1 * F.col("t")
    return both.where(score >= 0.95).select("a", "b", F.round(score, 6).alias("score")).union(copies)


_EMAIL_SQL, _PHONE_SQL = X.EMAIL, X.PHONE


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{X.EMAIL}'))::INT AS n_email, len(regexp_extract_all(text, '{X.PHONE}'))::INT AS n_phone, len(regexp_extract_all(text, '{X.ACCOUNT}'))::INT AS n_account,
  md5(regexp_replace(regexp_replace(regexp_replace(text, '{X.EMAIL}', '[EMAIL]', 'g'), '{X.PHONE}', '[PHONE]', 'g'), '{X.ACCOUNT}', '[ACCOUNT]', 'g')) AS redacted_md5 FROM documents""")
def pii_redact_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p))
    return read(spark, sf_dir, "documents").select("doc_id", n(X.EMAIL).alias("n_email"), n(X.PHONE).alias("n_phone"), n(X.ACCOUNT).alias("n_account"), F.md5(R.redact(F.col("text")).cast("binary")).alias("redacted_md5"))


@query(rf"""SELECT source, count(*) AS n_docs, sum(regexp_matches(text, '{X.EMAIL}')::INT)::BIGINT AS email_docs, sum(regexp_matches(text, '{X.PHONE}')::INT)::BIGINT AS phone_docs,
  round(avg((regexp_matches(text, '{X.EMAIL}') OR regexp_matches(text, '{X.PHONE}'))::INT), 6) AS leak_rate FROM documents GROUP BY source""")
def pii_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    email, phone = F.regexp_like("text", F.lit(X.EMAIL)), F.regexp_like("text", F.lit(X.PHONE))
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(email.cast("int")).alias("email_docs"), F.sum(phone.cast("int")).alias("phone_docs"), F.round(F.avg((email | phone).cast("int")), 6).alias("leak_rate"))


@query(r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)the user', '[USER]', 'g'), '(?i)tion', 'ux', 'g'), '(?i)the', '$1\\x', 'g'), '(?i)ux', 'U', 'g')) AS text_md5 FROM conversations""")
def multi_replace_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest source first, each on the output of the one before, special characters literal."""
    pairs = [("ux", "U"), ("the", "$1\\x"), ("tion", "ux"), ("", "never"), ("the user", "[USER]")]
    repl = F.array(*[F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst")) for s, d in pairs])
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.replace_ordered(F.col("text"), repl).cast("binary")).alias("text_md5"))


@query(rf"""SELECT doc_id, 'PERSON_' || upper(substring(sha1(doc_id::VARCHAR), 1, 6)) AS pseudonym,
  md5(regexp_replace(text, '{X.EMAIL}', 'PERSON_' || upper(substring(sha1(doc_id::VARCHAR), 1, 6)), 'g')) AS text_md5 FROM documents""")
def per_doc_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.pseudonym("PERSON", F.col("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", name.alias("pseudonym"), F.md5(F.regexp_replace("text", F.lit(X.EMAIL), name).cast("binary")).alias("text_md5"))


@query("SELECT DISTINCT source, 'ORG_' || lpad((dense_rank() OVER (ORDER BY source) - 1)::VARCHAR, 3, '0') AS pseudonym FROM documents")
def dense_pseudonym_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_ids(read(spark, sf_dir, "documents"), "source", "ORG")


@query(rf"""WITH r AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '{X.EMAIL}', '[EMAIL]', 'g'), '{X.PHONE}', '[PHONE]', 'g') AS t FROM documents)
SELECT source, round(avg(len(regexp_extract_all(t, '\[[A-Z_]+\]')) / greatest(len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')), 1)), 9) AS rate FROM r GROUP BY source""")
def placeholder_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("text", F.lit(X.EMAIL), F.lit("[EMAIL]")), F.lit(X.PHONE), F.lit("[PHONE]"))
    return read(spark, sf_dir, "documents").select("source", X.placeholder_rate(text).alias("r")).groupBy("source").agg(F.round(F.avg("r"), 9).alias("rate"))


@query(r"""WITH b AS (SELECT doc_id, lower(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(lower(x), 'subject:') AND NOT contains(lower(x), 'contact')), chr(10))) AS t, lang FROM documents)
SELECT lang, count(*) AS n, round(avg((contains(t, 'the')::INT + contains(t, 'tion')::INT + (contains(t, 'der') OR contains(t, 'und'))::INT + (contains(t, 'que') OR contains(t, 'los'))::INT) / 4.0), 6) AS score FROM b GROUP BY lang""")
def slot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", F.lower(X.body_text(F.col("text"))).alias("t"))
    slots = [["the"], ["tion"], ["der", "und"], ["que", "los"]]
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(sum((X.contains_rate(F.col("t"), s) for s in slots), F.lit(0.0)) / 4), 6).alias("score"))


_WORD = r"(^|[^\p{L}\p{N}_])"


@query(rf"""WITH f(field, exact, coarse) AS (VALUES ('article', 'of the', 'the'), ('romance', 'de la', 'la'), ('german', 'in der', 'der')),
t AS (SELECT conv_id, regexp_replace(trim(lower(string_agg(text, ' ' ORDER BY turn))), '\s+', ' ', 'g') AS t FROM conversations GROUP BY conv_id)
SELECT field, count(*) AS n, sum(regexp_matches(t, '{_WORD}' || exact || '($|[^\p{{L}}\p{{N}}_])')::INT)::BIGINT AS exact_recovered,
       sum((regexp_matches(t, '{_WORD}' || exact || '($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(t, '{_WORD}' || coarse || '($|[^\p{{L}}\p{{N}}_])'))::INT)::BIGINT AS coarse_recovered
FROM t, f GROUP BY field""")
def phrase_recovery_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phrases remain in an entity's texts: exact, or at least the coarse one."""
    fields = [("article", "of the", "the"), ("romance", "de la", "la"), ("german", "in der", "der")]
    return R.recovery(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", fields)


@query()
def edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each turn to its redacted form; matching blocks, which SQL can't express."""
    turns = read(spark, sf_dir, "conversations").withColumn("redacted", X.replace_ordered(F.col("text"), F.array(F.struct(F.lit("tion").alias("src"), F.lit("[X]").alias("dst")))))
    return R.edit_rows(turns, ["conv_id", "turn"], "text", "redacted")


_CONDITIONS = {"original": ("", ""), "tion_masked": ("tion", "[X]"), "th_masked": ("th", "[T]")}


def _replaced(condition: str) -> str:
    old, new = _CONDITIONS[condition]
    return f"replace(text, '{old}', '{new}')" if old else "text"


@query(f"""
WITH c AS ({" UNION ALL ".join(f"SELECT '{k}' AS condition, doc_id, {_replaced(k)} AS text FROM documents" for k in _CONDITIONS)}),
tc AS (SELECT condition, doc_id, term, count(*) AS tf FROM (SELECT condition, doc_id, {_GRAMS.format('text')} AS term FROM c) GROUP BY 1, 2, 3),
m AS (SELECT condition, term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT condition, term, count(*) AS df FROM tc GROUP BY 1, 2), (SELECT count(*) AS n FROM documents) WHERE df <= 0.9 * n),
r AS (SELECT condition, doc_id, term, (1 + ln(tf)) * idf AS w FROM tc JOIN m USING (condition, term)),
w AS (SELECT condition, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY condition, doc_id)) AS w FROM r),
qc AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, {_GRAMS.format('text')} AS term FROM benchmark) GROUP BY 1, 2),
qr AS (SELECT condition, item_id, term, (1 + ln(tf)) * idf AS w FROM qc JOIN m USING (term)),
q AS (SELECT condition, item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY condition, item_id)) AS w FROM qr),
s AS (SELECT condition, item_id, doc_id, sum(q.w * w.w) AS score FROM q JOIN w USING (condition, term) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY condition, item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
t AS (SELECT condition, item_id, min(rank) AS first_rank FROM k JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE contains(d.text, b.text) GROUP BY 1, 2)
SELECT condition, count(*) AS n_queries, round(avg((first_rank <= 1)::INT), 6) AS hit_at_1, round(avg((first_rank <= 5)::INT), 6) AS hit_at_5, round(avg(1.0 / first_rank), 6) AS mrr FROM t GROUP BY condition""")
def exposure_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each passage still finds the documents that held it, by rewriting condition."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    items, terms = read(spark, sf_dir, "benchmark"), X.tokens(F.col("text"), X.PORTABLE)
    changed = [F.replace("text", F.lit(old), F.lit(new)) if old else F.col("text") for old, new in _CONDITIONS.values()]
    if alone(docs, "doc_id"):
        first = search(docs, "doc_id", [X.tokens(t, X.PORTABLE) for t in changed], items, ["item_id"], terms, 0.9, relevant=passages_held(docs, items))[1]
        first = first.withColumn("condition", F.get(F.array(*map(F.lit, _CONDITIONS)), F.col("version")))
    else:
        options = F.array(*[F.struct(F.lit(k).alias("condition"), t.alias("text")) for k, t in zip(_CONDITIONS, changed, strict=True)])
        every = docs.select("doc_id", F.explode(options).alias("o")).select("doc_id", "o.condition", "o.text")
        counts = I.hashed_counts(every, ["condition", "doc_id"], terms)
        asked = I.hashed_counts(items, ["item_id"], terms).crossJoin(F.broadcast(every.select("condition").distinct()))  # three conditions
        scored = I.cosines(asked, counts, every.groupBy("condition").agg(F.count("*").alias("n")), 0.9, ["condition"], ["item_id"], ["doc_id"])
        first = I.first_relevant(scored, passages_held(docs, items), ["condition", "item_id"], "doc_id")
    within = lambda k: F.round(F.avg((F.col("first_rank") <= k).cast("int")), 6)
    return first.groupBy("condition").agg(F.count("*").alias("n_queries"), within(1).alias("hit_at_1"), within(5).alias("hit_at_5"), F.round(F.avg(1 / F.col("first_rank")), 6).alias("mrr"))


@query(f"""
WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn > 0) AS body, row_number() OVER (ORDER BY conv_id) - 1 AS pos FROM conversations GROUP BY conv_id),
p AS (SELECT a.conv_id AS q, b.conv_id AS cand, {_TOK.format("coalesce(a.body, '')")} AS x, {_TOK.format("coalesce(b.body, '')")} AS y FROM c a JOIN c b ON b.pos = a.pos + 1)
SELECT q, cand, len(list_intersect(list_distinct(x), list_distinct(y)))::INT AS shared, round(coalesce(len(list_intersect(list_distinct(x), list_distinct(y))) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 6) AS jaccard FROM p""")
def shared_tokens_with_rival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that an entity's texts share with the next entity's: what a rival match rests on."""
    turns = read(spark, sf_dir, "conversations").where("turn > 0")
    convs, _ = A.numbered(read(spark, sf_dir, "conversations"), "conv_id", "pos")
    words = turns.select("conv_id", F.explode(X.tokens(F.col("text"), X.PORTABLE)).alias("w")).groupBy("conv_id").agg(F.collect_set("w").alias("ws"))
    full = convs.join(words, "conv_id", "left").withColumn("ws", F.coalesce("ws", F.array().cast("array<string>")))
    a, b = full.select(F.col("conv_id").alias("q"), (F.col("pos") + 1).alias("pos"), F.col("ws").alias("x")), full.select(F.col("conv_id").alias("cand"), "pos", F.col("ws").alias("y"))
    shared, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return a.join(b, "pos").select("q", "cand", shared.alias("shared"), F.round(F.coalesce(F.try_divide(shared, union), F.lit(0.0)), 6).alias("jaccard"))
