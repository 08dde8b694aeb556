"""Groups of texts whose word-shingle sets have a high Jaccard similarity, found exactly.

Token-combination prefixes. Shingles are put in one global order: those seen once, then rare ones, then
frequent ones, each by hash. If two sets of sizes n reach the similarity, they share at least ``a = ceil(t*n)``
shingles, so they share two within their first ``n - a + 2``. Hence one of these holds: they share a
rare shingle there, or two frequent ones. The index has one key for each rare shingle of that prefix
and one for each pair of frequent ones. (Pairs grow with the square of the prefix, so two sets of
which the larger is long share single frequent shingles of their ``n - a + 1`` prefix instead; sets
within reach of the limit emit both kinds.) Which shingles are repeated and which are frequent is
counted over the whole corpus and told by filters; any division into classes gives whole results.

Texts with equal sets form a class and only one of each class is indexed. A filter of twice-seen
keys leaves the rest of the index out before anything shuffles. Within a key's list every
member is first compared with one of them; only members that are still in different components are
then compared with each other, so that a large group of copies costs a number of comparisons in
proportion to its size, and no link that could join two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowKeys, scratch, text_pieces
from .components import components
from .seen import expected_units, filter_of, seen_often, seen_twice
from .words import mix64, word_hashes

_C = [np.uint64(c) for c in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_PARITY = 32


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in rising order; A-Z lower-cased."""
    words, _, _, first = word_hashes(buf, bounds, lower=True)
    n, count = len(words), np.diff(first)
    whole = np.full(n, mix64(np.array([size], np.uint64))[0])
    for k in range(min(size, n)):
        whole[: n - k] += mix64(words[k:] ^ np.uint64(0x1000 + k)) * _C[k % len(_C)]
    whole = mix64(whole)
    out = []
    for k, (at, m) in enumerate(zip(first[:-1], count, strict=True)):
        if m >= size:
            out.append(np.unique(whole[at : at + m - size + 1]))
        elif m:
            out.append(mix64(np.array([sum((int(w) * 0x2545F4914F6CDD1D ** (q + 1) for q, w in enumerate(words[at : at + m])), int(m)) % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """2,048 bits as longs; bit b tells whether an odd number of shingles hash to b. Two sets differ in
    at least as many shingles as their parities differ in bits."""
    return np.packbits(np.bincount((shingles >> np.uint64(53)).astype(np.int64), minlength=64 * _PARITY).astype(np.uint8) & 1).view(np.int64)


def index_keys(shingles: np.ndarray, repeated: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set (see above); ``repeated`` and ``frequent`` flag its shingles."""
    n = len(shingles)
    if n < 2:
        return np.zeros(0, np.uint64)
    spare = n - -(-percent * n // 100)
    frequent = frequent & repeated
    rare = np.concatenate([shingles[~repeated], shingles[repeated & ~frequent]])
    often = shingles[frequent][: max(0, spare + 2 - len(rare))]
    keys = [mix64(rare[: spare + 2])]
    most = 10000 // max(1, 100 - percent)  # the size up to which pairs are made: prefixes of about 100
    if n <= most and len(often) > 1:
        i, j = np.triu_indices(len(often), 1)
        keys.append(mix64(often[i] * _C[1] + mix64(often[j]) * _C[2]))
    if 100 * n >= percent * most:
        keys.append(mix64(often[: max(0, spare + 1 - len(rare))]))
    return np.concatenate(keys)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def ngram_groups(docs: DataFrame, size: int = 5, percent: int = 80, frequent: int = 32, most_bytes: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected groups of texts whose sets of ``size``-word shingles have a Jaccard similarity of
    ``percent``/100 or more (percent above 50).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer words than ``size`` has
    the whole sequence as its one shingle; a null text or one without words has none and links with
    nothing. Repeated rows are texts of their own that link with each other. Other columns are not
    read. A shingle is frequent if ``frequent`` texts hold it; ``most_bytes`` bounds each filter.

    Returns one row per input row: ``id_col``, n_shingles (long), component_id (the smallest id in
    the group, ignoring nulls), kept (boolean: true for one row of each group).
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sc = source.sparkSession.sparkContext
    expected = expected_units(source, "text", 6)

    def shingles_of(b):
        for _, _, buf, bounds in text_pieces(b.column(0)):
            yield np.concatenate(shingle_sets(buf, bounds, size))

    filters = seen_often(source.select("text"), shingles_of, expected, (2, frequent), most_bytes)
    shared = sc.broadcast(tuple(filters))

    def keyed(buf, bounds):
        """Of each text the shingles, their signature, and the index keys with the signature's own at the end."""
        sets = shingle_sets(buf, bounds, size)
        flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        repeated, often = (f.has(flat) for f in shared.value)
        for s, at, to in zip(sets, ends[:-1], ends[1:], strict=True):
            sign = xxhash.xxh3_128_digest(s.tobytes())
            keys = index_keys(s, repeated[at:to], often[at:to], percent)
            yield s, sign, np.append(keys, np.frombuffer(sign[:8], np.uint64)) if len(s) else keys

    def hashes(b):
        for _, _, buf, bounds in text_pieces(b.column(0)):
            yield np.concatenate([k for _, _, k in keyed(buf, bounds)])

    again = sc.broadcast(seen_twice(source.select("text"), hashes, expected, most_bytes))

    def suspect(batches):
        rows = RowKeys()
        for b in batches:
            for i, j, buf, bounds in text_pieces(b.column(1)):
                n, signs, keys, bits = [], [], [], []
                texts = [*keyed(buf, bounds)]
                ends = np.cumsum([0, *(len(k) for _, _, k in texts)])
                flags = again.value.has(np.concatenate([k for _, _, k in texts]))
                for (s, sign, k), at, to in zip(texts, ends[:-1], ends[1:], strict=True):
                    hit = k[flags[at:to]]
                    n.append(len(s))
                    signs.append(sign if len(hit) else None)
                    bits.append(parity(s) if len(hit) else None)
                    keys.append(np.unique(hit[hit != k[-1]]).view(np.int64) if len(hit) else None)
                yield pa.RecordBatch.from_arrays([pa.array(rows.take(j - i)), b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["key", "doc_id", "n", "sign", "keys", "bits"])

    judged = scratch(source.mapInArrow(suspect, "key long, doc_id long, n long, sign binary, keys array<long>, bits array<long>"), "shingles")
    shared.destroy()
    again.destroy()
    suspects = judged.where("sign is not null")
    classes = scratch(suspects.groupBy("sign").agg(F.min("key").alias("node"), F.count("*").alias("copies")), "classes")
    parities = suspects.select(F.col("key").alias("node"), *[F.col("bits")[q].alias(f"p{q}") for q in range(_PARITY)])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the similarity; the sets of their texts alone are made again and shuffled."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        signs = scratch(classes.join(wanted, "node").select("node", "sign"), "signs")
        wanted_by = sc.broadcast(filter_of(signs.select("sign"), lambda b: (np.array([int.from_bytes(x[:8], "little") for x in b.column(0).to_pylist()], np.uint64),), signs.count(), most_bytes))

        def pick(batches):
            for b in batches:
                for _, _, buf, bounds in text_pieces(b.column(0)):
                    got = [(s, xxhash.xxh3_128_digest(s.tobytes())) for s in shingle_sets(buf, bounds, size) if len(s)]
                    hit = wanted_by.value.has(np.array([int.from_bytes(d[:8], "little") for _, d in got], np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array([d for (_, d), h in zip(got, hit, strict=True) if h], pa.binary()), pa.array([s.tobytes() for (s, _), h in zip(got, hit, strict=True) if h], pa.binary())], names=["sign", "shingles"])

        sets = source.select("text").mapInArrow(pick, "sign binary, shingles binary").join(signs, "sign").dropDuplicates(["sign"]).select(F.col("node").alias("key"), "shingles")
        sets = scratch(sets, "sets")
        wanted_by.destroy()
        return _verified(pairs, sets, percent)

    entries = suspects.select("key", "n", "keys").join(classes.select(F.col("node").alias("key"), "copies"), "key").select(F.col("key").alias("node"), "n", "copies", F.explode("keys").alias("k"))
    entries = scratch(entries, "entries")
    lists = scratch(entries.groupBy("k").agg(F.count("*").alias("c"), F.min(F.struct((-F.col("copies")).alias("c"), "n", "node")).alias("lo"), F.max(F.struct((-F.col("copies")).alias("c"), "n", "node")).alias("hi")).where("c > 1"), "lists")
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    members = scratch(entries.join(lists.where("c > 2").select("k", "lo"), "k"), "members")
    two = lists.where("c = 2").select(F.col("lo.node").alias("a"), F.col("lo.n").alias("na"), F.col("hi.node").alias("b"), F.col("hi.n").alias("nb"))
    star = members.where("node <> lo.node").select(F.col("lo.node").alias("a"), F.col("lo.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    tried = two.union(star).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("total")).distinct()
    for c in "ab":
        tried = tried.join(parities.toDF(c, *[f"{c}{q}" for q in range(_PARITY)]), c)
    apart = " + ".join(f"bit_count(a{q} ^ b{q})" for q in range(_PARITY))
    close = f"{100 + percent} * ({apart}) <= {100 - percent} * "
    tried = scratch(tried.where(close + "total").select("a", "b"), "pairs")
    links = scratch(verified(tried), "links")
    roots = components(links)
    named = members.select("k", "node", "n").join(roots, "node", "left").select("k", "node", "n", F.coalesce("root", "node").alias("root"))
    named = scratch(named, "named")
    split = scratch(named.groupBy("k").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("k"), "split")
    open_ = named.join(split, "k", "left_semi").join(parities, "node").select("k", "node", "n", "root", *[f"p{q}" for q in range(_PARITY)])
    x, y = (open_.toDF("k", c, f"n{c}", f"r{c}", *[f"{c}{q}" for q in range(_PARITY)]) for c in "ab")
    cross = x.join(y, "k").where("a < b and ra <> rb").where(near).where(close + "(na + nb)").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = scratch(verified(scratch(cross, "pairs")), "links")
    roots = scratch(components(links.union(more)), "roots")

    placed = suspects.select("key", "doc_id", "n", "sign").join(classes, "sign").join(roots, "node", "left").select("key", "doc_id", "n", F.coalesce("root", "node").alias("root"))
    placed = scratch(placed, "placed")
    # a table of its own, so that Spark can split the rows of a large group in the join
    heads = scratch(placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("head")), "heads")
    grouped = placed.join(heads, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"), (F.col("key") == F.col("head.key")).alias("kept"))
    alone = judged.where("sign is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.union(alone).withColumnRenamed("doc_id", id_col)
