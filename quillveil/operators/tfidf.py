"""TF-IDF as long tables: (group columns, document, term, weight).

One implementation serves a corpus, a fit per group and unseen queries. Term weights are
``1 + ln(tf)`` (or 1), idf ``ln((1+n)/(1+df)) + 1``, rows have length 1, and terms in more than
``max_df`` of a group's documents are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .reports import written


def term_counts(docs: DataFrame, keys: list[str], terms: Column, upto: int = 1, hashed: bool = False) -> DataFrame:
    """(keys, term, tf) of a list of terms, or of all space-joined runs of one to ``upto`` of them; counts
    combine before they shuffle.

    With ``hashed`` a term is told by its 64-bit hash, so that what shuffles has a fixed small width. Of n distinct terms
    two have one hash with a probability of n * n / 2**65; they would count as one term.
    """
    if upto == 1:
        rows = docs.select(*keys, F.explode(terms).alias("term"))
    else:  # rows of a term and its followers, so that runs are joined in generated code
        listed = docs.select(*keys, terms.alias("_w"))
        rest = lambda k: F.slice("_w", k + 1, F.greatest(F.size("_w") - k, F.lit(0))).alias(f"t{k}")
        runs = listed.select(*keys, F.explode(F.arrays_zip(*map(rest, range(upto)))).alias("_r"))
        run = lambda n: F.when(F.col(f"_r.t{n - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"_r.t{k}") for k in range(n)]))
        rows = runs.select(*keys, F.explode(F.array(*map(run, range(1, upto + 1)))).alias("term")).where("term is not null")
    if hashed:
        rows = rows.withColumn("term", F.xxhash64("term"))
    return rows.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def fit(counts: DataFrame, sizes: DataFrame, group: list[str], max_df: float = 1.0, binary: bool = False) -> DataFrame:
    """(group, term, idf) from term counts and the number of documents n of each group.

    ``sizes`` has the group columns and n; without group columns it is one row.
    """
    df = counts.groupBy(*group, "term").agg(F.count("*").alias("df"))
    joined = df.join(sizes, group) if group else df.crossJoin(F.broadcast(sizes))  # one row without groups
    return joined.where(F.col("df") <= max_df * F.col("n")).select(*group, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, model: DataFrame, group: list[str], keys: list[str], binary: bool = False) -> DataFrame:
    """(keys, term, w) before rows get length 1; terms outside the model are dropped."""
    tf = F.lit(1.0) if binary else 1 + F.log("tf")
    return counts.join(model, [*group, "term"]).select(*keys, "term", (tf * F.col("idf")).alias("w"))


def weigh(counts: DataFrame, model: DataFrame, group: list[str], keys: list[str], binary: bool = False) -> DataFrame:
    """(keys, term, weight) with unit rows; terms outside the model are dropped."""
    raw = weights(counts, model, group, keys, binary)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("w") / norm).alias("w"))


def scores(queries: DataFrame, docs: DataFrame, on: list[str], query_keys: list[str], doc_keys: list[str]) -> DataFrame:
    """Cosines of all query and document rows that share a term: (on, query keys, doc keys, score)."""
    q = queries.withColumnRenamed("w", "wq")
    keys = list(dict.fromkeys([*on, *query_keys, *doc_keys]))
    return q.join(docs, [*on, "term"]).groupBy(*keys).agg(F.sum(F.col("wq") * F.col("w")).alias("score"))


#: Odd factors of the words in a run, so that runs are told by their words' hashes.
_SEEDS = {k: xxhash.xxh3_64_intdigest(b"run%d" % k) | 1 for k in range(12)}


def row_runs(b: pa.RecordBatch, upto: int = 3, most: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of one to ``upto`` tokens of rows whose last column is a list of tokens, by 64-bit hash, some rows at a time.

    Gives (first row, end row, their tokens, and for each distinct run of a row: hash, row, place of its first token among these,
    number of its tokens, tf), by row and hash.
    """
    listed = b.column(b.num_columns - 1)
    size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        tokens = listed.slice(i, j - i).flatten()
        words = tokens.dictionary_encode()
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(i, j), size[i:j])
        terms, places = [h], [np.arange(len(h))]
        for n in range(2, upto + 1):
            run = sum((h[k : len(h) - n + 1 + k] * np.uint64(_SEEDS[3 * n + k]) for k in range(n)), np.zeros(max(len(h) - n + 1, 0), np.uint64))
            run ^= run >> np.uint64(31)
            same = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
            terms.append((run * np.uint64(_SEEDS[0]))[same])
            places.append(same)
        term, at, n = np.concatenate(terms), np.concatenate(places), np.repeat(np.arange(1, upto + 1), [len(x) for x in terms])
        order = np.lexsort((term, row[at]))
        term, at, n = term[order], at[order], n[order]
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[at][1:] != row[at][:-1]))) if len(term) else np.zeros(0, np.int64)
        yield i, j, tokens, term[first].view(np.int64), row[at[first]], at[first], n[first], np.diff(np.append(first, len(term)))
        i = j


def as_lists(own: np.ndarray, /, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Entries dealt by number (from 0): a row for each number with lists of what its entries hold, in their order."""
    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.diff(own[order], prepend=-1))
    ends, where = pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(order)
    lists = [pa.ListArray.from_arrays(ends, (pa.array(c) if isinstance(c, np.ndarray) else c).take(where)) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(own[order][first].astype(np.int64)), *lists], names=["_block", *columns])


def blocks_of(listed: DataFrame, upto: int, per: int) -> int:
    """Into how many blocks of about ``per`` the runs of one to ``upto`` of the tokens in ``_w`` are to be dealt."""
    return max(1, -(-upto * int(listed.agg(F.sum(F.greatest(F.size("_w"), F.lit(0)))).first()[0] or 0) // per))


def block_of(term: np.ndarray, blocks: int) -> np.ndarray:
    """The blocks of hashes."""
    return (term.view(np.uint64) % np.uint64(blocks)).astype(np.int64)


def _places(tokens: pa.Array, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct runs of rows (by row): their place in the order of their row's runs as strings, and where their row starts.

    Tokens hold only characters above the space, so joined runs are in order of their tokens, a run before what continues it.
    """
    words = tokens.dictionary_encode()
    rank = np.empty(len(words.dictionary), np.int64)
    rank[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
    r = np.append(rank[words.indices.to_numpy()], [-1, -1])
    order = np.lexsort((np.where(n > 2, r[at + 2], -1), np.where(n > 1, r[at + 1], -1), r[at], row))
    start = np.searchsorted(row, row)
    nth = np.empty(len(row), np.int64)
    nth[order] = np.arange(len(row))
    return nth - start, start


def top_terms(docs: DataFrame, key: str, terms: Column, best: int, max_df: float, per: int = 2_000_000) -> DataFrame:
    """(key, term, w, rank): the ``best`` runs of one to three tokens in each document by TF-IDF weight to nine decimals, ties by term.

    Keys are unique; tokens hold only characters above the space. Runs are told by 64-bit hashes and dealt to blocks of about ``per``
    as lists, where those are counted that several documents hold. Their counts go back to the documents' groups, which make the
    runs again from the tokens; so no string shuffles but the tokens, and no entry twice that only one document holds.
    """
    listed = docs.select(F.col(key).alias("key"), terms.alias("_w"))
    blocks, n_docs, kind = blocks_of(listed, 3, per), docs.count(), dict(docs.dtypes)[key]
    listed = listed.select("key", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("_block"), "_w")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, tokens, term, row, at, n, _ in row_runs(b, 3, 1 << 18):
                where, nth = pa.array(row), _places(tokens, row, at, n)[0]
                yield as_lists(block_of(term, blocks), term=term, key=b.column(0).take(where), own=b.column(1).take(where), nth=nth.astype(np.int32))

    def count(t: pa.Table) -> pa.Table:
        flat = lambda c: pc.list_flatten(t.column(c)).combine_chunks()
        _, code, df = np.unique(flat("term").to_numpy(), return_inverse=True, return_counts=True)
        some = np.flatnonzero(df[code] > 1)
        where = pa.array(some)
        return pa.Table.from_batches([as_lists(flat("own").take(where).to_numpy(), key=flat("key").take(where), nth=flat("nth").take(where), df=df[code[some]].astype(np.int32))])

    def choose(_: tuple, own: pa.Table, held: pa.Table) -> pa.Table:
        batch = own.select(["key", "_w"]).combine_chunks().to_batches()[0]
        keys, nth_held, df_held = (pc.list_flatten(held.column(c)).combine_chunks() for c in ("key", "nth", "df"))
        at_held = pc.index_in(keys, value_set=batch.column(0)).to_numpy(zero_copy_only=False)
        order = np.argsort(at_held, kind="stable")
        at_held, nth_held, df_held = at_held[order], nth_held.to_numpy()[order], df_held.to_numpy()[order]
        out: list[tuple] = []
        for i, j, tokens, _, row, at, n, tf in row_runs(batch, 3, 1 << 18):
            nth, start = _places(tokens, row, at, n)
            first = np.searchsorted(row, np.arange(i, j))
            some = slice(*np.searchsorted(at_held, [i, j]))
            df = np.ones(len(row), np.int64)
            df[first[at_held[some].astype(np.int64) - i] + nth_held[some]] = df_held[some]
            df = df[start + nth]
            w = (1 + np.log(tf)) * (np.log((1 + n_docs) / (1 + df)) + 1)
            kept = df <= max_df * n_docs
            row, at, n, nth, w = row[kept], at[kept], n[kept], nth[kept], w[kept]
            w = w / np.sqrt(np.bincount(row - i, w * w, j - i))[row - i]
            order = np.lexsort((nth, -np.round(w, 9), row))
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1  # rows keep their place
            order, rank = order[rank <= best], rank[rank <= best]
            text = [" ".join(tokens.slice(a, k).to_pylist()) for a, k in zip(at[order].tolist(), n[order].tolist(), strict=True)]
            out.append((batch.column(0).take(pa.array(row[order])), pa.array(text, pa.string()), pa.array(w[order]), pa.array(rank.astype(np.int32))))
        return pa.concat_tables(pa.table(dict(zip(("key", "term", "w", "rank"), x, strict=True))) for x in out)

    dealt = listed.mapInArrow(deal, f"_block long, term array<long>, key array<{kind}>, own array<long>, nth array<int>")
    held = dealt.groupBy("_block").applyInArrow(count, f"_block long, key array<{kind}>, nth array<int>, df array<int>")
    met = listed.groupBy("_block").cogroup(held.groupBy("_block")).applyInArrow(choose, f"key {kind}, term string, w double, rank int")
    return met.withColumnRenamed("key", key)


def hashed_counts(docs: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """Like ``term_counts`` for runs of one to three, with 64-bit hashes (of its own) as terms. They are counted within rows, so
    nothing shuffles unless rows share their keys."""
    listed = docs.select(*keys, terms.alias("_w"))
    kinds = dict(listed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, term, row, _, _, tf in row_runs(b):
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(where) for c in range(len(keys))), pa.array(term), pa.array(tf)], names=[*keys, "term", "tf"])

    counts = listed.mapInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "term long, tf long")
    if docs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return counts
    return counts.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def frequent_runs(docs: DataFrame, text: str, terms: Callable[[Column], Column], least: int, per: int = 2_000_000) -> DataFrame:
    """(n, term, df): the runs of n tokens, one to three, that ``least`` rows hold.

    Runs are told by 64-bit hashes, counted for some rows at a time and dealt to blocks of about ``per`` as lists, each with the hash of
    a text that holds it and its place there; only frequent ones become strings, from these texts. A frequent run has the hash
    of one of N others with a probability of N / 2**64; they would count as one.
    """
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    listed = texts.select("h", terms(F.col("text")).alias("_w"))
    # three runs a token of four bytes; blocks of shorter tokens are at most twice as large
    blocks = max(1, -(-3 * int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (4 * per)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, term, row, at, n, _ in row_runs(b):
                if not len(term):
                    continue
                _, first, df = np.unique(term, return_index=True, return_counts=True)
                order = np.argsort(first)  # by row, so that a text's entries stand together
                first, df = first[order], df[order]
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                place = at - np.repeat(np.minimum.reduceat(at, starts), np.diff(np.append(starts, len(row))))
                yield as_lists(block_of(term[first], blocks), term=term[first], df=df.astype(np.int32), h=b.column(0).take(pa.array(row[first])), at=place[first].astype(np.int32), n=n[first].astype(np.int32))

    def count(t: pa.Table) -> pa.Table:
        flat = {c: pc.list_flatten(t.column(c)).to_numpy() for c in ("term", "df", "h", "at", "n")}
        _, first, code = np.unique(flat["term"], return_index=True, return_inverse=True)
        df = np.bincount(code, flat["df"], len(first)).astype(np.int64)
        kept = first[df >= least]
        return pa.table({"h": flat["h"][kept], "at": flat["at"][kept], "n": flat["n"][kept], "df": df[df >= least]})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                words, own = b.column(0).slice(r, 1).flatten().to_pylist(), b.column(1).slice(r, 1).flatten()
                at, n, df = (own.field(c) for c in ("at", "n", "df"))
                names = [" ".join(words[i : i + k]) for i, k in zip(at.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([n, pa.array(names, pa.string()), df], names=["n", "term", "df"])

    dealt = listed.mapInArrow(deal, "_block long, term array<long>, df array<int>, h array<long>, at array<int>, n array<int>")
    found = dealt.groupBy("_block").applyInArrow(count, "h long, at int, n int, df long")
    asked = found.groupBy("h").agg(F.collect_list(F.struct("at", "n", "df")).alias("_e"))
    held = texts.join(asked, "h").dropDuplicates(["h"])  # copies are one text
    return held.select(terms(F.col("text")).alias("_w"), "_e").mapInArrow(spell, "n int, term string, df long")


def cosines(queries: DataFrame, counts: DataFrame, sizes: DataFrame, max_df: float, on: list[str], query_keys: list[str], doc_keys: list[str]) -> DataFrame:
    """Like ``scores`` from both sides' term counts, fitted on the documents as ``fit`` does, in a written table.

    Counts shuffle once, by term. Next to their number of documents they become the squares that a document's length is
    summed from; only those of terms that queries hold are kept apart and go on to be scored.
    """
    keys = list(dict.fromkeys([*on, *doc_keys]))
    df = counts.withColumn("df", F.count("*").over(Window.partitionBy(*on, "term")))
    joined = df.join(F.broadcast(sizes), on) if on else df.crossJoin(F.broadcast(sizes))  # one row for each group
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = joined.where(F.col("df") <= max_df * F.col("n")).select(*keys, "term", idf.alias("idf"), ((1 + F.log("tf")) * idf).alias("w"))
    sought = queries.select(*on, "term").distinct().withColumn("asked", F.lit(True))
    told = raw.join(sought, [*on, "term"], "left").groupBy(*keys, F.when(F.col("asked"), F.col("term")).alias("term"))
    told = written(told.agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.max("w").alias("w"), F.max("idf").alias("idf")))
    norms = told.groupBy(*keys).agg(F.sqrt(F.sum("square")).alias("_norm"))
    hits = told.where("term is not null")
    asked = weigh(queries, hits.groupBy(*on, "term").agg(F.max("idf").alias("idf")), on, list(dict.fromkeys([*on, *query_keys])))
    found = scores(asked, hits.select(*keys, "term", "w"), on, query_keys, doc_keys)
    return written(found.join(norms, keys).withColumn("score", F.col("score") / F.col("_norm")).drop("_norm"))


def lists(docs: DataFrame, queries: DataFrame, max_df: float, n_docs: int, per: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(key, term, w) of the documents and of the queries: lists of the terms that both sides hold, with unit rows, fitted on the documents as ``fit`` does.

    Both have (key, _w) with a list of tokens, each key once; terms are runs of one to three, told by 64-bit hashes. They are dealt to
    blocks of about ``per`` as lists, where documents are counted; squares of all terms and weights of the shared ones go back to their rows.
    """
    blocks = max(blocks_of(docs, 3, per), blocks_of(queries, 3, per))

    def dealt(rows: DataFrame) -> DataFrame:
        listed = rows.select("key", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("_own"), "_w")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, _, term, row, _, _, tf in row_runs(b, 3, 1 << 18):
                    where = pa.array(row)
                    yield as_lists(block_of(term, blocks), term=term, key=b.column(0).take(where), own=b.column(1).take(where), tf=tf.astype(np.int32))

        return listed.mapInArrow(deal, f"_block long, term array<long>, key array<{kind}>, own array<int>, tf array<int>")

    def flat(t: pa.Table, c: str) -> pa.Array:
        return pc.list_flatten(t.column(c)).combine_chunks()

    def match(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = (t if t.num_rows else empty for t in (a, b))  # the columns of an empty side are missing
        term, code, df = np.unique(flat(a, "term").to_numpy(), return_inverse=True, return_counts=True)
        idf = np.where(df <= max_df * n_docs, np.log((1 + n_docs) / (1 + df)) + 1, 0.0)
        w = (1 + np.log(flat(a, "tf").to_numpy())) * idf[code]
        sought = flat(b, "term").to_numpy()
        at = np.minimum(np.searchsorted(term, sought), max(len(term) - 1, 0))
        held = (term[at] == sought) & (idf[at] > 0) if len(term) else np.zeros(len(sought), bool)
        both = np.zeros(len(term), bool)
        both[at[held]] = True
        wq = (1 + np.log(flat(b, "tf").to_numpy()[held])) * idf[at[held]]
        keys = flat(a, "key").dictionary_encode("encode")
        _, first, row = np.unique(keys.indices.to_numpy(), return_index=True, return_inverse=True)
        out = []
        for t, side, some, values in ((a, 0, np.flatnonzero(both[code]), w[both[code]]), (b, 1, np.flatnonzero(held), wq), (a, 2, first, np.bincount(row, w * w, len(first)))):
            where = pa.array(some)
            terms = flat(t, "term").take(where) if side < 2 else pa.nulls(len(some), pa.int64())
            batch = as_lists(flat(t, "own").take(where).to_numpy(), key=flat(t, "key").take(where), term=terms, w=values)
            out.append(batch.append_column("side", pa.array(np.full(batch.num_rows, side, np.int32))))
        return pa.Table.from_batches(out)

    def packed(t: pa.Table) -> pa.Table:
        out, sides = [], t.column("side").to_numpy()
        for side in (0, 1):
            own, squares = t.filter(pa.array(sides == side)), t.filter(pa.array(sides == (2 if side == 0 else 1)))
            key, w, term = flat(own, "key"), flat(own, "w").to_numpy(), flat(own, "term").to_numpy()
            known = key.unique()
            row = pc.index_in(key, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(flat(squares, "key"), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            square = flat(squares, "w").to_numpy() ** (1 if side == 0 else 2)
            norm = np.sqrt(np.bincount(at[at >= 0], square[at >= 0], len(known)))
            order = np.lexsort((term, row))
            ends = pa.array(np.searchsorted(row[order], np.arange(len(known) + 1)).astype(np.int32))
            columns = [known, pa.ListArray.from_arrays(ends, pa.array(term[order])), pa.ListArray.from_arrays(ends, pa.array((w / norm[row])[order]))]
            out.append(pa.table([pa.array(np.full(len(known), side, np.int32)), *columns], names=["side", "key", "term", "w"]))
        return pa.concat_tables(out)

    kind = dict(docs.dtypes)["key"]
    empty = pa.schema([("term", pa.list_(pa.int64())), ("key", pa.list_(to_arrow_type(docs.schema["key"].dataType))), ("own", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))]).empty_table()
    met = dealt(docs).groupBy("_block").cogroup(dealt(queries).groupBy("_block"))
    back = met.applyInArrow(match, f"_block long, key array<{kind}>, term array<long>, w array<double>, side int")
    rows = written(back.groupBy("_block").applyInArrow(packed, f"side int, key {kind}, term array<long>, w array<double>"))
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


def nearest(queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int, doc_entries: int = 4_000_000, query_entries: int = 4_000_000) -> DataFrame:
    """(query, doc, score to nine decimals): the ``k`` best documents for each query by cosine, ties by smaller ``doc``.

    Both tables have (key, term, w) with unit rows and hashed terms. See ``nearest_lists``.
    """
    packed = lambda rows, key: written(rows.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("e")).select(key, "e.term", "e.w"))
    return nearest_lists(packed(queries, query), packed(docs, doc), query, doc, k, doc_entries, query_entries)


def nearest_lists(q: DataFrame, d: DataFrame, query: str, doc: str, k: int, doc_entries: int = 4_000_000, query_entries: int = 4_000_000, spread: int = 8, dense: int = 512, most: int = 1 << 22) -> DataFrame:
    """``nearest`` of written rows with lists of terms and weights.

    Blocks of queries and of documents, bounded by their entries, meet in a task; no table of pairs is made. Few documents make
    up to ``spread`` smaller blocks. A task adds up the lists of some queries' terms at a time, ``most`` sums or entries, and
    multiplies the ``dense`` terms with the longest lists as a matrix. Rows meet each block of the other side once, and
    the best of the blocks are ranked.
    """
    entries = lambda rows: int(rows.agg(F.sum(F.size("term"))).first()[0] or 0)
    nq, held = max(1, -(-entries(q) // query_entries)), entries(d)
    nd = max(1, -(-held // doc_entries), min(spread, held // 500_000))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # other names, as both sides may come from one table
    q = q.select(query, F.col("term").alias("_term"), F.col("w").alias("_w"), own(query, nq).alias("_i"), every(nd).alias("_j"))
    d = d.select("*", own(doc, nd).alias("_j"), every(nq).alias("_i"))

    def flat(t: pa.Table, c: str) -> np.ndarray:
        return pc.list_flatten(t.column(c)).to_numpy()

    def run(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:  # the columns of an empty side are missing
            return pa.Table.from_batches([], schema=told)
        b = b.sort_by(doc)
        term, place = flat(b, "term"), np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("term")).to_numpy())
        order = np.argsort(term, kind="stable")
        known, start = np.unique(term[order], return_index=True)
        place, w, start = place[order], flat(b, "w")[order], np.append(start, len(order))
        size, sought = np.diff(start), flat(a, "_term")
        at = np.minimum(np.searchsorted(known, sought), max(len(known) - 1, 0))
        some = known[at] == sought if len(known) else np.zeros(len(sought), bool)
        row, at, wq = np.repeat(np.arange(a.num_rows), pc.list_value_length(a.column("_term")).to_numpy())[some], at[some], flat(a, "_w")[some]
        heavy = np.argsort(-size, kind="stable")[:dense]
        heavy = heavy[size[heavy] * 32 > b.num_rows]
        column = np.full(len(known), -1)
        column[heavy] = np.arange(len(heavy))
        matrix = np.zeros((len(heavy), b.num_rows))
        for c, h in enumerate(heavy):
            matrix[c, place[start[h] : start[h + 1]]] = w[start[h] : start[h + 1]]
        ends = np.searchsorted(row, np.arange(a.num_rows + 1))
        work = np.append(0, np.cumsum(np.where(column[at] < 0, size[at], 0)))[ends] + np.arange(a.num_rows + 1) * b.num_rows
        found, i = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        while i < a.num_rows:
            j = max(i + 1, int(np.searchsorted(work, work[i] + most, side="right")) - 1)
            e = slice(ends[i], ends[j])
            r, t, x, c = row[e] - i, at[e], wq[e], column[at[e]]
            light = c < 0
            n, sums = size[t[light]], np.zeros((j - i, b.num_rows))
            if n.sum():
                where = np.repeat(start[t[light]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                sums = np.bincount(np.repeat(r[light] * b.num_rows, n) + place[where], np.repeat(x[light], n) * w[where], sums.size).reshape(sums.shape)
            if len(heavy):
                some = np.zeros((j - i, len(heavy)))
                some[r[~light], c[~light]] = x[~light]
                sums += some @ matrix
            least = np.partition(sums, -k, axis=1)[:, -k, None] if b.num_rows > k else np.zeros((j - i, 1))
            x, y = np.nonzero((sums > 0) & (sums >= least - 2e-9))  # what may be among the best once it is rounded
            score = np.round(sums[x, y], 9)
            order = np.lexsort((y, -score, x))
            order = order[np.arange(len(x)) - np.searchsorted(x, x) < k]  # rows keep their place
            found.append((x[order] + i, y[order], score[order]))
            i = j
        x, y, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({query: a.column(query).take(pa.array(x)), doc: b.column(doc).take(pa.array(y)), "score": score})

    told = pa.schema([(query, to_arrow_type(q.schema[query].dataType)), (doc, to_arrow_type(d.schema[doc].dataType)), ("score", pa.float64())])
    met = q.groupBy("_i", "_j").cogroup(d.groupBy("_i", "_j")).applyInArrow(run, f"{query} {dict(q.dtypes)[query]}, {doc} {dict(d.dtypes)[doc]}, score double")
    return ranked(met, [query], [F.desc(F.round("score", 9)), F.asc_nulls_last(doc)]).where(F.col("rank") <= k)


def _to_first(texts: list[Iterable[str]], n: int, max_df: float) -> list[float]:
    """Cosines of all texts' terms with those of the first one, fitted on these texts alone."""
    counts = [Counter(t) for t in texts]
    held = Counter(chain.from_iterable(counts))
    idf = {c: math.log((1 + n) / (1 + c)) + 1 for c in set(held.values()) if c <= max_df * n}
    rows = [{t: (1 + math.log(c)) * idf[held[t]] for t, c in own.items() if held[t] in idf} for own in counts]
    norms = [math.sqrt(sum(w * w for w in r.values())) for r in rows]
    dots = (sum(w * rows[0].get(t, 0.0) for t, w in r.items()) for r in rows)
    return [d / (norms[0] * norm) if d else 0.0 for d, norm in zip(dots, norms, strict=True)]


def group_cosines(texts: DataFrame, group: str, slot: str, cand: str, split: dict[str, Callable], runs: dict[str, Callable], n: int, max_df: float) -> DataFrame:
    """(group, cand, slot, a score for each kind): cosines of a group's few texts with its own one, which has slot -1.

    Each group is a fit of its own on n documents. ``split`` gives the words of a text as a column, ``runs`` the terms of these
    words in Python. A group's texts meet as one row, so texts shuffle and terms don't; 0 for texts that share no term.
    """
    kinds = dict(texts.dtypes)
    compose = lambda f: lambda x: f(x["text"])
    sets = texts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(slot, cand, "text"))).alias("_s"))
    each = {slot: lambda x: x[slot], cand: lambda x: x[cand]} | {k: compose(f) for k, f in split.items()}
    words = sets.select(group, *[F.transform("_s", f).alias(k) for k, f in each.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for row in b.slice(i, 256).to_pylist():
                    first = int(row[slot][0] == -1)  # a group may lack a text of its own
                    scores = [_to_first([runs[k](w) for w in ([] if first else [[]]) + row[k]], n, max_df)[1:] for k in split]
                    out += zip([row[group]] * len(scores[0]), row[cand][first:], row[slot][first:], *scores, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

    names = [group, cand, slot, *split]
    types = [words.schema[group].dataType, words.schema[cand].dataType.elementType, words.schema[slot].dataType.elementType]
    types = [*map(to_arrow_type, types), *[pa.float64()] * len(split)]
    return words.mapInArrow(run, f"{group} {kinds[group]}, {cand} {kinds[cand]}, {slot} {kinds[slot]}, " + ", ".join(f"{k} double" for k in split))


def first_relevant(scored: DataFrame, relevant: DataFrame, by: list[str], doc: str, most: int = 1_000_000) -> DataFrame:
    """(by, first_rank, total): the rank of a query's best relevant document, and how many it scored at all.

    Scores to nine digits come first, ties by smaller ``doc``. Nothing is ranked: what beats a query's best relevant
    document is counted, and counts combine before they shuffle. ``relevant`` has (by or some of it, doc).
    """
    on = [c for c in relevant.columns if c in (*by, doc)]
    place = F.struct(F.round("score", 9).alias("score"), (-F.col(doc)).alias("doc"))
    best = written(scored.join(relevant.select(on).distinct(), on).groupBy(*by).agg(F.max(place).alias("_best"), F.count("*").alias("total")))
    small = F.broadcast(best) if best.count() <= most else best
    above = scored.join(small, by).where(place >= F.col("_best"))
    return above.groupBy(*by).agg(F.count("*").alias("first_rank"), F.first("total").alias("total"))


def pair_scores(weights: DataFrame, key: str) -> DataFrame:
    """Cosines of all pairs a < b of rows that share a term, through the inverted index."""
    a, b = weights.select(F.col(key).alias("a"), "term", F.col("w").alias("wa")), weights.select(F.col(key).alias("b"), "term", F.col("w").alias("wb"))
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def close_pairs(weights: DataFrame, model: DataFrame, key: str, least: float, marks: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of unit rows with a cosine of ``least`` or more: (a, b, score).

    In a global order of terms, the rarest first, a row's prefix ends where what is left is shorter than
    ``least``. Rows that reach the cosine share a term of both prefixes, so only prefixes are indexed; the
    candidates are then scored over all terms. With ``marks`` (key, mark) only rows that share a mark are candidates.
    """
    order = Window.partitionBy(key).orderBy(F.desc("idf"), "term")
    left = weights.join(model.select("term", "idf"), "term").withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    prefix = left.where(1 - F.col("before") >= least * least - 1e-9).select(key, "term")
    if marks is not None:
        prefix = prefix.join(marks, key)
    pairs = prefix.withColumnRenamed(key, "a").join(prefix.withColumnRenamed(key, "b"), [c for c in prefix.columns if c != key]).where("a < b").select("a", "b").distinct()
    a, b = weights.select(F.col(key).alias("a"), "term", F.col("w").alias("wa")), weights.select(F.col(key).alias("b"), "term", F.col("w").alias("wb"))
    return pairs.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")).where(F.col("score") >= least)


def ranked(scored: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Add rank within ``by``; the order must settle ties."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def retrieval_metrics(ranks: DataFrame, by: list[str], relevant: str = "relevant", ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: hits within each k, several hits within the largest, their number, recall, first
    relevant rank and its reciprocal (0 if there is none)."""
    rel, top = F.col(relevant), max(ks)
    hits = [F.max(F.when(rel & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_at_{k}") for k in ks]
    found = F.sum(F.when(rel & (F.col("rank") <= top), 1).otherwise(0))
    total = F.sum(F.when(rel, 1).otherwise(0))
    first = F.min(F.when(rel, F.col("rank")))
    return ranks.groupBy(*by).agg(*hits, (found >= 2).cast("int").alias(f"multi_at_{top}"), found.alias(f"found_at_{top}"), F.coalesce(F.try_divide(found, total), F.lit(0.0)).alias(f"recall_at_{top}"), first.alias("first_rank"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"))
