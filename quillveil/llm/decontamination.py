"""Benchmark passages in documents, with some words replaced, by spaced seeds.

A mask picks some of the positions in a run of words; the hash of the words it picks ignores the
others. Hashes at all positions of all documents are joined with those of the benchmark. Each hit
gives a document, an item and their alignment, along which the words are compared one by one.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, only, scratch

#: Positions that count in each mask over four words.
MASKS = ((0, 1, 3), (0, 2, 3))
#: With these, three words that agree among any four consecutive ones are a seed. Without one, at most two
#: of every four words agree: of 13 words at most 7, and fewer than 60% of any number not in UNSURE.
SEEDS = ((0, 1, 2), *MASKS)
#: Numbers of words of which 60% can agree without such a seed, and the masks that find these.
UNSURE = (1, 2, 3, 5, 6, 10)
SHORT = ((0,), (0, 1), (0, 2))
_CHUNK = 512
#: Words of a text, and alignments, that are compared in one row.
_BLOCK = 4096
_TOGETHER = 256


def words(text: Column) -> Column:
    """Lower-case words without empty ones."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def seeds(texts: DataFrame, masks: tuple, *carry: str) -> DataFrame:
    """All masked hashes of the column ``words``: rows of the columns ``carry``, pos, h and goes_on.

    ``goes_on`` tells that the same mask has the same hash one word before, as in a run of one word. Words
    are hashed once; long texts go on in overlapping chunks of bounded size, each of which begins anew.
    """
    reach = max(map(max, masks)) + 1
    cut = lambda hs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(hs) - 1, F.lit(0)), F.lit(_CHUNK)), lambda s: F.struct(s.alias("base"), F.slice(hs, s + 1, F.lit(_CHUNK + reach - 1)).alias("hs")))
    # the list of one element binds the hashes to a name
    chunks = F.flatten(F.transform(F.array(F.transform("words", lambda w: F.xxhash64(w))), cut))
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("c.hs", 1, _CHUNK + reach - 1))
    rows = texts.select(*carry, F.explode(chunks).alias("c")).select(*carry, "c.base", F.arrays_zip(before.alias("before"), *[F.slice("c.hs", k + 1, _CHUNK + reach).alias(f"h{k}") for k in range(reach)]).alias("runs"))
    rows = rows.select(*carry, "base", F.posexplode("runs").alias("pos", "run")).where(F.col("pos") < _CHUNK)
    key = lambda mask: F.when(F.col(f"run.h{max(mask)}").isNotNull(), F.xxhash64(F.lit(str(mask)), *[F.col(f"run.h{k}") for k in mask]))
    same = lambda mask: reduce(and_, [F.col(f"run.h{k}") == F.col(f"run.h{k - 1}" if k else "run.before") for k in mask])
    seed = lambda mask: F.struct(key(mask).alias("h"), F.coalesce(same(mask), F.lit(False)).alias("goes_on"))
    return rows.select(*carry, (F.col("base") + F.col("pos")).alias("pos"), F.explode(F.array(*map(seed, masks))).alias("s")).select(*carry, "pos", "s.h", "s.goes_on").where("h is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple = SEEDS, window: int = 13, least: int = 10, share: float = 0.6, broadcast_rows: int = 2_000_000, unique: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold benchmark passages (item_id, text), one row per document and item.

    Along an alignment, a passage counts as held if ``least`` of some ``window`` consecutive words agree,
    or ``share`` of all its words. Words are lower-cased; null texts have no words. Rows that share an id
    are reported once; a null id is kept as null. Other columns are not read. A long text is compared in
    blocks of words, and a text with very many alignments (a word repeated) in groups of these, so that no row
    grows with either. No such passage is missed with the default masks and
    the default or stricter values of ``window``, ``least`` and ``share``; items of few words (UNSURE)
    are also sought by SHORT masks, on both sides only if there are such items. ``unique`` says that no
    id repeats or is null, which saves a copy of the rows.

    Returns ``id_col``, item_id, n_matched (words that agree), n_words (of the item), best_window,
    at (the document's word where the item would begin). The benchmark's seeds are broadcast if they
    are at most ``broadcast_rows``, else the hashes shuffle.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source, row = (source.withColumn("_row", F.col("doc_id")), "_row") if unique else numbered(source)
    items = benchmark.select("item_id", words(F.col("text")).alias("words"))
    few = F.size("words").isin(*UNSURE)
    short = not items.where(few).isEmpty()
    own = seeds(items, masks, "item_id")
    if short:
        own = own.union(seeds(items.where(few), SHORT, "item_id"))
    keys = scratch(own.withColumnRenamed("pos", "item_pos"), "seeds")
    small = keys.count() <= broadcast_rows
    found = seeds(source.select(row, words(F.col("text")).alias("words")), (*masks, *SHORT) if short else masks, row)
    # where a seed goes on in the text and in the item, the word before gives the same alignment
    targets = keys.select("h", "item_id", "item_pos", F.explode(F.when(F.col("goes_on"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("goes_on"))
    hits = found.join(F.broadcast(targets) if small else targets, ["h", "goes_on"])
    hits = scratch(hits.select(row, "item_id", (F.col("pos") - F.col("item_pos")).alias("at")).distinct(), "hits")
    longest = items.agg(F.max(F.size("words"))).first()[0] or 1
    block = max(_BLOCK, longest)
    hits = hits.withColumn("block", F.greatest(F.floor(F.col("at") / block), F.lit(0)).cast("int"))
    many = scratch(hits.groupBy(row, "block").agg(F.count("*").alias("n")).where(F.col("n") > _TOGETHER), "many")
    n_many = many.count()
    if n_many:
        hits = hits.join(F.broadcast(many) if n_many <= broadcast_rows else many, [row, "block"], "left")
    part = F.pmod(F.xxhash64("item_id", "at"), F.ceil(F.col("n") / _TOGETHER)) if n_many else F.lit(0)
    pairs = hits.withColumn("part", F.coalesce(part, F.lit(0))).join(items.withColumnRenamed("words", "item"), "item_id").groupBy(row, "block", "part").agg(F.collect_list(F.struct("item_id", (F.col("at") - F.col("block") * block).alias("at"), "item")).alias("hits"))
    cut = lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(block)), lambda s: F.struct((s / block).cast("int").alias("block"), F.concat_ws(" ", F.slice(ws, s + 1, F.lit(block + longest))).alias("text")))
    held = only(source, scratch(hits.select(row).distinct(), "hit"), row, most=broadcast_rows)
    held = held.select(row, "doc_id", F.explode(F.flatten(F.transform(F.array(words(F.col("text"))), cut))).alias("b")).select(row, "doc_id", "b.block", "b.text")
    both = held.join(pairs, [row, "block"])

    def same(ws: Column, x: Column) -> Column:
        return F.transform(x["item"], lambda w, k: F.when((x["at"] + k >= 0) & (w == F.get(ws, F.greatest(x["at"] + k, F.lit(0)))), 1).otherwise(0))

    # the list of one element splits a text once, not for every word that is compared
    bound = F.transform(F.array(F.split("text", " ")), lambda ws: F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), x["at"].alias("at"), same(ws, x).alias("same"))))
    lined = both.select("doc_id", F.explode(F.flatten(bound)).alias("x"), (F.col("block").cast("long") * block).alias("from")).select("doc_id", "x.item_id", (F.col("x.at") + F.col("from")).cast("int").alias("at"), "x.same")
    total = F.aggregate("same", F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("same") - window + 1, F.lit(1))), lambda s: F.aggregate(F.slice(F.col("same"), s, window), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))))
    lined = lined.withColumn("n_matched", total).where(f"n_matched >= least({least}, {share} * size(same))")
    judged = lined.select("doc_id", "item_id", "at", "n_matched", best.alias("best_window"), F.size("same").alias("n_words"))
    judged = judged.where((F.col("best_window") >= least) | (F.col("n_matched") >= share * F.col("n_words")))
    top = F.max(F.struct("n_matched", "best_window", (-F.col("at")).alias("at"), "n_words"))
    return judged.groupBy("doc_id", "item_id").agg(top.alias("t")).select(F.col("doc_id").alias(id_col), "item_id", F.col("t.n_matched").alias("n_matched"), F.col("t.n_words").alias("n_words"), F.col("t.best_window").alias("best_window"), (-F.col("t.at")).alias("at"))
