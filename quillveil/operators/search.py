"""Few queries against many documents by TF-IDF, in several versions of the documents, without tables of terms or of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .reports import written
from .tfidf import as_lists, hashed_counts, ranked, row_runs, weigh


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) if len(x) else b""


def unsqueezed(x: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x, 8 * n, codec="zstd"), np.uint8).reshape(8, n).T).view(np.int64).ravel() if n else np.zeros(0, np.int64)


def _range_of(term: np.ndarray, blocks: int) -> np.ndarray:
    """The blocks of hashes (unsigned), in their order."""
    return ((term >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _entries(data: bytes, size: int, versions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's texts: each (term, row) once, by term, and how often each version of the row holds it."""
    buffer = pa.py_buffer(pa.decompress(data, size, codec="zstd", asbytes=True))
    texts = pa.ipc.open_stream(buffer).read_all().column(0).combine_chunks()
    terms, rows, own, tfs = [], [], [], []
    for v in range(versions):
        at = pa.array(np.arange(v, len(texts), versions))
        own_texts = texts.take(at)
        words = pc.split_pattern(pc.if_else(pc.equal(own_texts, ""), pa.scalar(None, pa.string()), own_texts), " ")
        for _, _, _, term, row, _, _, tf in row_runs(pa.RecordBatch.from_arrays([words], names=["w"]), 3, 1 << 62):
            terms.append(term.view(np.uint64))
            rows.append(row)
            own.append(np.full(len(term), v))
            tfs.append(tf)
    term, row, own, tf = (np.concatenate(x) for x in (terms, rows, own, tfs))
    order = np.lexsort((row, term))
    term, row = term[order], row[order]
    new = np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])) if len(term) else np.zeros(0, bool)
    counts = np.zeros((int(new.sum()), versions), np.int32)
    counts[np.cumsum(new) - 1, own[order]] = tf[order]
    return term[new], row[new], counts


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    return (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows))


def _firsts(term: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)


def _chunks(docs: DataFrame, key: str, words: list[Column], most: int) -> DataFrame:
    """(_chunk, keys, size, data, tokens): documents by some at a time, up to ``most`` tokens of all versions, as compressed texts."""
    listed = docs.select(F.col(key).alias("key"), *[F.array_join(w, " ").alias(f"t{v}") for v, w in enumerate(words)], sum((F.coalesce(F.size(w), F.lit(0)) for w in words), F.lit(0)).alias("n"))
    kind, versions = dict(listed.dtypes)["key"], len(words)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, i = np.cumsum(np.maximum(b.column("n").to_numpy(), 0).astype(np.int64)), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
                texts = [pc.fill_null(b.column(f"t{v}").slice(i, j - i), "") for v in range(versions)]
                order = np.arange(versions * (j - i)).reshape(versions, -1).T.ravel()  # the versions of a text side by side
                sink = pa.BufferOutputStream()
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays(texts).take(pa.array(order))], names=["t"])
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                data = sink.getvalue()
                keys = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column("key").slice(i, j - i))
                yield pa.RecordBatch.from_arrays([keys, pa.array([data.size], pa.int64()), pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary()), pa.array([int(ends[j - 1] - (ends[i - 1] if i else 0))], pa.int64())], names=["keys", "size", "data", "tokens"])
                i = j

    packed = listed.mapInArrow(pack, f"keys array<{kind}>, size long, data binary, tokens long")
    return written(packed.select(F.monotonically_increasing_id().alias("_chunk"), "*"))


def _counted(chunks: DataFrame, asked: DataFrame, versions: int, max_df: float, n_docs: int, per: int) -> DataFrame:
    """For each chunk and block of terms the numbers of documents (_chunk, _block, n, data) that hold the chunk's terms, in
    order of the terms, by version; and the idf of asked terms by version (term, idf)."""
    blocks = max(1, -(-3 * int(chunks.agg(F.sum("tokens")).first()[0] or 0) // (versions * per)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                term, _, tf = _entries(r["data"], r["size"], versions)
                first = _firsts(term)
                df = np.add.reduceat((tf > 0).astype(np.int64), first, axis=0) if len(first) else np.zeros((0, versions), np.int64)
                term = term[first]
                ends = np.searchsorted(_range_of(term, blocks), np.arange(blocks + 1))
                own = np.flatnonzero(np.diff(ends))
                parts = [slice(ends[k], ends[k + 1]) for k in own]
                h = [squeezed(np.diff(term[p], prepend=np.uint64(0)).view(np.int64)) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([r["_chunk"]] * len(own), pa.int64()), pa.array(np.diff(ends)[own]), pa.array(h, pa.binary()), pa.array([squeezed(df[p].T.ravel()) for p in parts], pa.binary())], names=["_block", "_chunk", "n", "h", "f"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term = b.column(0).to_numpy()
            yield as_lists(_range_of(term.view(np.uint64), blocks), term=term)

    def count(block: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:  # the columns of an empty side are missing
            return told.empty_table()
        n = a.column("n").to_numpy()
        term = np.concatenate([np.cumsum(unsqueezed(h.as_py(), k).view(np.uint64)) for h, k in zip(a.column("h"), n, strict=True)])
        df = np.concatenate([unsqueezed(f.as_py(), k * versions).reshape(versions, k) for f, k in zip(a.column("f"), n, strict=True)], axis=1)
        known, code = np.unique(term, return_inverse=True)
        df = np.array([np.bincount(code, x, len(known)) for x in df]).astype(np.int64)
        ends = np.append(0, np.cumsum(n))
        # later versions as differences from the first
        data = [squeezed(np.vstack([df[:1, c], df[1:, c] - df[:1, c]]).ravel()) for c in (code[i:j] for i, j in zip(ends, ends[1:], strict=False))]
        out = [pa.table([a.column("_chunk"), pa.array([block[0].as_py()] * len(n), pa.int64()), a.column("n"), pa.array(data, pa.binary()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.list_(pa.float64()))], schema=told)]
        if b.num_rows:
            some = np.flatnonzero(np.isin(known, pc.list_flatten(b.column("term")).to_numpy().view(np.uint64)))
            idf = np.where((df[:, some] > 0) & (df[:, some] <= max_df * n_docs), np.log((1 + n_docs) / (1 + df[:, some])) + 1, 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, idf.size + 1, versions, dtype=np.int32)), pa.array(idf.T.ravel()))
            out.append(pa.table([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(known[some].view(np.int64)), lists], schema=told))
        return pa.concat_tables(out)

    told = pa.schema([("_chunk", pa.int64()), ("_block", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("term", pa.int64()), ("idf", pa.list_(pa.float64()))])
    dealt = chunks.select("_chunk", "size", "data").mapInArrow(deal, "_block long, _chunk long, n long, h binary, f binary")
    sought = asked.select("term").distinct().mapInArrow(ask, "_block long, term array<long>")
    met = dealt.groupBy("_block").cogroup(sought.groupBy("_block"))
    return written(met.applyInArrow(count, "_chunk long, _block long, n long, data binary, term long, idf array<double>"))


def search(docs: DataFrame, key: str, words: list[Column], queries: DataFrame, query_keys: list[str], terms: Column, max_df: float, k: int = 0, relevant: DataFrame | None = None, per: int = 2_000_000, most: int = 1 << 19, query_entries: int = 500_000, cells: int = 1 << 22) -> tuple[DataFrame, DataFrame | None]:
    """(version, query keys, key, score, rank) of the ``k`` best documents for each query, scores to nine decimals, ties by smaller key;
    and (version, query keys, first_rank, total) of the ``relevant`` (some of the query keys, key), as ``first_relevant`` has them.

    ``words`` has a version's tokens of a document each; each version is a fit of its own on all documents, as ``cosines`` makes it. Keys are
    whole numbers, each in one row. Documents are kept as chunks of compressed texts. Their runs of one to three tokens, told by
    64-bit hashes, are made three times: a chunk's distinct ones go to blocks of hashes and their numbers of documents come back, then
    it is scored, and what beats a query's best relevant document is counted. No entry shuffles with its document, and no table of
    pairs is made. Queries are broadcast by ``query_entries``, a pass over the chunks for each lot; a task holds a chunk or a block.
    """
    spark, versions, n_docs = docs.sparkSession, len(words), docs.count()
    chunks = _chunks(docs, key, words, most)
    asked = written(hashed_counts(queries, query_keys, terms))
    counted = _counted(chunks, asked, versions, max_df, n_docs, per)
    model = counted.where("term is not null").select("term", F.posexplode("idf").alias("version", "idf")).where("idf > 0")
    weighed = written(weigh(asked.join(model.select("term", "version"), "term"), model, ["version"], ["version", *query_keys]))
    ready = chunks.join(counted.where("term is null").groupBy("_chunk").agg(F.sort_array(F.collect_list(F.struct("_block", "n", "data"))).alias("_df")), "_chunk")
    own: list[str] = []
    if relevant is not None:
        own = [c for c in query_keys if c in relevant.columns]
        where = chunks.select("_chunk", F.posexplode("keys").alias("_at", key)).join(relevant.select(*own, key).dropna().distinct(), key)
        ready = ready.join(where.groupBy("_chunk").agg(F.collect_list(F.struct("_at", *own)).alias("_rel")), "_chunk", "left")
    lots = max(1, -(-weighed.count() // query_entries))
    lot = F.pmod(F.xxhash64(*query_keys), F.lit(lots))
    kinds = dict(weighed.dtypes)

    def passes(part: int) -> tuple[DataFrame, DataFrame | None]:
        got = weighed.where(lot == part).toArrow()  # about query_entries rows
        numbers: dict[tuple, int] = {}
        number = np.array([numbers.setdefault(q, len(numbers)) for q in zip(*(got.column(c).to_pylist() for c in query_keys), strict=True)], np.int64)
        version, term, w = got.column("version").to_numpy(), got.column("term").to_numpy().view(np.uint64), got.column("w").to_numpy()
        sides = []
        for v in range(versions):
            some = np.flatnonzero(version == v)
            some = some[np.argsort(term[some], kind="stable")]
            known, start = np.unique(term[some], return_index=True)
            sides.append((known, np.append(start, len(some)), number[some], w[some]))
        shared = spark.sparkContext.broadcast((sides, list(numbers)))
        names = {c: to_arrow_type(weighed.schema[c].dataType) for c in query_keys}

        def scored(r: dict) -> Iterator[tuple[int, int, int, np.ndarray]]:
            """(version, first row, end row, scores) of a chunk."""
            term, row, tf = _entries(r["data"], r["size"], versions)
            first, n_rows = _firsts(term), len(r["keys"])
            df = np.concatenate([np.zeros((versions, 0), np.int64), *(unsqueezed(x["data"], x["n"] * versions).reshape(versions, -1) for x in r["_df"])], axis=1)
            df[1:] += df[:1]
            code = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
            for v, (known, start, number, wq) in enumerate(shared.value[0]):
                kept = df[v] <= max_df * n_docs
                idf = np.where(kept, np.log((1 + n_docs) / (1 + df[v])) + 1, 0.0)
                w = np.where(tf[:, v] > 0, (1 + np.log(np.maximum(tf[:, v], 1))) * idf[code], 0.0)
                norm = np.sqrt(np.bincount(row, w * w, n_rows))
                at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
                some = np.flatnonzero((known[at] == term) & (w > 0)) if len(known) else np.zeros(0, np.int64)
                some = some[np.argsort(row[some], kind="stable")]
                at, own, x = at[some], row[some], w[some]
                size = np.diff(start)[at] if len(some) else np.zeros(0, np.int64)
                ends = np.searchsorted(own, np.arange(n_rows + 1))
                width = len(shared.value[1])
                work = np.append(0, np.cumsum(size))[ends] + np.arange(n_rows + 1) * width
                i = 0
                while i < n_rows:
                    j = max(i + 1, int(np.searchsorted(work, work[i] + cells, side="right")) - 1)
                    e = slice(ends[i], ends[j])
                    n = size[e]
                    where = np.repeat(start[at[e]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
                    dots = np.bincount(np.repeat((own[e] - i) * width, n) + number[where], np.repeat(x[e], n) * wq[where], (j - i) * width).reshape(j - i, width)
                    yield v, i, j, dots / np.where(norm[i:j] > 0, norm[i:j], 1.0)[:, None]
                    i = j

        def listed(v: int, q: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
            known = shared.value[1]
            asked_keys = [pa.array([known[x][c] for x in q.tolist()], t) for c, t in enumerate(names.values())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), v, np.int32)), *asked_keys, *map(pa.array, columns.values())], names=["version", *names, *columns])

        def places(r: dict) -> np.ndarray:
            return np.array([np.iinfo(np.int64).max if x is None else x for x in r["keys"]], np.int64)  # null keys are last

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in _rows(b):
                    place, held = places(r), {}
                    if r.get("_rel"):
                        for n, q in enumerate(shared.value[1]):
                            held.setdefault(tuple(x for x, c in zip(q, query_keys, strict=True) if c in own), []).append(n)
                    pairs = np.array([(x["_at"], n) for x in (r.get("_rel") or []) for n in held.get(tuple(x[c] for c in own), [])], np.int64).reshape(-1, 2)
                    for v, i, j, s in scored(r):
                        if k:
                            least = np.partition(s, -k, axis=0)[-k] if j - i > k else np.zeros(s.shape[1])
                            x, q = np.nonzero((s > 0) & (s >= least - 2e-9))  # what may be among the best once it is rounded
                            score = np.round(s[x, q], 9)
                            order = np.lexsort((place[x + i], -score, q))
                            x, q, score = x[order], q[order], score[order]
                            top = np.arange(len(q)) - np.searchsorted(q, q) < k
                            yield listed(v, q[top], key=place[x[top] + i], score=score[top], relevant=np.zeros(top.sum(), np.int64))
                        near = pairs[(pairs[:, 0] >= i) & (pairs[:, 0] < j)]
                        near = near[s[near[:, 0] - i, near[:, 1]] > 0]
                        if len(near):  # the best one of each query, and their number
                            score = np.round(s[near[:, 0] - i, near[:, 1]], 9)
                            order = np.lexsort((place[near[:, 0]], -score, near[:, 1]))
                            q, first, n = np.unique(near[order, 1], return_index=True, return_counts=True)
                            yield listed(v, q, key=place[near[order[first], 0]], score=score[order[first]], relevant=n)

        schema = "version int, " + "".join(f"{c} {kinds[c]}, " for c in query_keys)
        by = ["version", *query_keys]
        found = ready.select("keys", "size", "data", "_df", *(["_rel"] if relevant is not None else [])).mapInArrow(find, schema + "key long, score double, relevant long")
        if relevant is None:
            return found, None
        found = written(found)
        best = found.where("relevant > 0").groupBy(*by).agg(F.max(F.struct("score", (-F.col("key")).alias("key"))).alias("b"), F.sum("relevant").alias("total")).select(*by, "b.score", (-F.col("b.key")).alias("key"), "total")
        best = written(best)
        score, doc = np.full((versions, len(numbers)), np.inf), np.zeros((versions, len(numbers)), np.int64)
        for r in best.collect():  # a row for each query of the lot and version at most
            at = r.version, numbers[tuple(r[c] for c in query_keys)]
            score[at], doc[at] = r.score, r.key
        bound = spark.sparkContext.broadcast((score, doc))

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in _rows(b):
                    place, total = places(r), np.zeros(bound.value[0].shape, np.int64)
                    for v, i, j, s in scored(r):
                        s, (least, last) = np.round(s, 9), (x[v] for x in bound.value)
                        total[v] += ((s > least) | (s == least) & (s > 0) & (place[i:j, None] <= last)).sum(axis=0)
                    for v in range(versions):
                        q = np.flatnonzero(total[v])
                        yield listed(v, q, n=total[v][q])

        counts = ready.select("keys", "size", "data", "_df").mapInArrow(above, schema + "n long")
        first = counts.groupBy(*by).agg(F.sum("n").alias("first_rank")).join(best.select(*by, "total"), by)
        return found.where("relevant = 0"), first.select(*by, "first_rank", "total")

    parts = [passes(p) for p in range(lots)]
    top = reduce(DataFrame.union, [t.drop("relevant") for t, _ in parts])
    top = ranked(top.withColumn("_key", F.nullif("key", F.lit(np.iinfo(np.int64).max))), ["version", *query_keys], [F.desc("score"), F.asc("key")]).where(F.col("rank") <= k)
    first = reduce(DataFrame.union, [f for _, f in parts]) if relevant is not None else None
    return top.select("version", *query_keys, F.col("_key").alias(key), "score", "rank"), first
