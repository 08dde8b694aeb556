"""Language-model scores of whole texts from a log-frequency Bloom filter.

Spark counts all words and all pairs of neighbouring words of the texts to learn from. A pair that
occurs ``min_count`` times or more is held: its count c is quantised to q = 1 + floor(log2(c / min_count))
and the filter gets the pair's key with each of 1..q. A reader probes 1, 2, ... until a probe fails; the
number of hits gives the level. (A pair below ``min_count`` tells nothing beyond the few texts that hold
it; left in, a text to learn from would be scored by its own pairs.)

    P(w|u) = (v(u,w) + R(u) * P1(w)) / (Z(u) + R(u))
    P1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)),    R(u) = mu + (pairs after u that aren't held)

v is the middle of the level's counts and Z(u) the sum of v over all pairs held after u, so P(.|u) sums
to 1 over the V words and one unknown one. A false answer of the filter would add v for a word that
never followed u; the filter gives so few (an expected ``false_words`` for each u at most, counted in Z)
that the sum moves by no more than about a hundredth.

Pairs are counted in segments of the hash space that follow from their first word, split for
frequent words. Each segment builds its part of the filter, sized by its keys, and the sums of its first
words. The parts are broadcast as long as they take ``most_bytes`` at most; a larger filter is broadcast
part by part, and each pass scores the pairs of its parts. The numbers of the ``head`` most frequent words
are broadcast too; those of all others stay in Spark and are joined to the rare occurrences only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RowKeys, lists, scratch, text_pieces
from .seen import segment_of, segments_for, summed
from .words import mix64, word_hashes

END, START = np.uint64(0x2D358DCCAA6C78A5), np.uint64(0x8BB84B93962EACC9)
_ADD = 0.1
_LEVEL, _PAIR, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)
_IN_SEGMENT = 1 << 17


def tokens(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's lower-cased words and its end, those of the token before, and each text's
    first token."""
    words, _, _, first = word_hashes(buf, bounds, lower=True)
    out, first = np.insert(words, first[1:], END), first + np.arange(len(first))
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first[:-1]] = START
    return out, before, first


def counted(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """(h, c): how often each 64-bit key occurs."""

    def run(batches):
        for k, c in summed(x for b in batches for x in keys_of(b)):
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["h", "c"])

    return df.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Head:
    """What is known at once of frequent words: counts, and later the sums of the pairs after them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        log = max(1, int(len(words)).bit_length())
        self.shift = np.uint64(64 - log)
        # the first word of each of the 2^log equal parts of the hash space, one or none in most
        self.starts = np.searchsorted(self.words, np.arange(1 << log, dtype=np.uint64) << self.shift).astype(np.int32)
        self.starts = np.append(self.starts, np.int32(len(words)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each token's word, -1 for words outside."""
        out, part = np.full(len(h), -1), (h >> self.shift).astype(np.int64)
        at, end = self.starts[part], self.starts[part + 1]
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while len(left):
            hit = self.words[at] == h
            out[left[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < end))
            left, at, end, h = left[more], at[more] + 1, end[more], h[more]
        return out

    def segments(self, before: np.ndarray, at: np.ndarray, h: np.ndarray, log_segments: int) -> np.ndarray:
        """The segment of each pair: by its first word, which is at ``at``, and for frequent ones by some
        bits of the second."""
        splits = np.where(at >= 0, self.counts[at] >> 17, 0) if len(self.words) else np.zeros(len(h), np.int64)
        part = mix64(h) % (splits.astype(np.uint64) + np.uint64(1))
        return segment_of(mix64(before ^ (part * _STEP)), log_segments)


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64(before * _PAIR + h)


def level_of(counts: np.ndarray, min_count: int) -> np.ndarray:
    """0 for pairs that are not held."""
    return np.where(counts >= min_count, np.floor(np.log2(np.maximum(counts, 1) / min_count) + 1e-12) + 1, 0).astype(np.int64)


def value_of(level: np.ndarray, min_count: int) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(level > 0, (3.0 * min_count * np.exp2(level - 1.0) - 1) / 2, 0.0)


def places(keys: np.ndarray, level: int, bits: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """The bits of each key at a level, within as many bits as each key's segment has."""
    a = mix64(keys + np.uint64(level * int(_LEVEL) % (1 << 64)))
    b = mix64(a ^ _STEP) | np.uint64(1)
    for _ in range(probes):
        yield ((a >> np.uint64(32)) * bits) >> np.uint64(32)
        a = a + b


class LogFrequencies:
    """Consecutive segments of the filter."""

    def __init__(self, low: int, sizes: np.ndarray, data: np.ndarray, probes: int):
        self.low, self.sizes, self.data, self.probes = low, sizes.astype(np.uint64), data, probes
        self.starts = (np.cumsum(sizes) - sizes).astype(np.uint64)

    def levels(self, keys: np.ndarray, segments: np.ndarray) -> np.ndarray:
        u, back = np.unique(keys, return_inverse=True)
        seg = np.empty(len(u), np.int64)
        seg[back] = segments - self.low
        size, start = self.sizes[seg], self.starts[seg]
        level, open_, q = np.zeros(len(u), np.int64), np.flatnonzero(size > 0), 0
        while len(open_):
            q += 1
            a = mix64(u[open_] + np.uint64(q * int(_LEVEL) % (1 << 64)))
            b, own, at = mix64(a ^ _STEP) | np.uint64(1), size[open_], start[open_]
            # most keys of pairs that aren't held fail at once
            for n in (2, 2, 4, self.probes - 8):
                hit = np.ones(len(open_), bool)
                for _ in range(n):
                    p = (((a >> np.uint64(32)) * own) >> np.uint64(32)) + at
                    hit &= (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
                    a += b
                open_, a, b, own, at = open_[hit], a[hit], b[hit], own[hit], at[hit]
            level[open_] = q
        return level[back]


def pair_counts(learn: DataFrame, head, log_segments: int, most: int = 1_500_000) -> DataFrame:
    """(seg, us, ns, ps, cs): first words, the numbers of pairs of each, the pairs' keys and counts."""

    def cut(us, hs, n):
        u, h = np.concatenate(us), np.concatenate(hs)
        keys, at, counts = np.unique(pair_keys(u, h), return_index=True, return_counts=True)
        u, seg = u[at], head.value.segments(u[at], head.value.find(u[at]), h[at], log_segments)
        order = np.lexsort((u, seg))
        u, seg, keys, counts = u[order], seg[order], keys[order], counts[order]
        new = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (seg[1:] != seg[:-1])))
        each = np.diff(np.append(new, len(u)))
        some = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        by_pair, by_word = np.append(some, len(seg)), np.append(np.searchsorted(new, some), len(new))
        return pa.RecordBatch.from_arrays([pa.array(seg[some].astype(np.int32)), lists(u[new].view(np.int64), by_word), lists(each.astype(np.int32), by_word), lists(keys.view(np.int64), by_pair), lists(counts.astype(np.int32), by_pair)], names=["seg", "us", "ns", "ps", "cs"])

    def run(batches):
        us, hs, n = [], [], 0
        for b in batches:
            for _, _, buf, bounds in text_pieces(b.column(0)):
                h, before, _ = tokens(buf, bounds)
                us.append(before)
                hs.append(h)
                n += len(h)
                if n >= most:
                    yield cut(us, hs, n)
                    us, hs, n = [], [], 0
        if n:
            yield cut(us, hs, n)

    return learn.mapInArrow(run, "seg int, us array<long>, ns array<int>, ps array<long>, cs array<int>")


def filter_parts(parts: DataFrame, min_count: int, probes: int) -> DataFrame:
    """(seg, n_bits, bits, u, held, open): each segment's part of the filter and the sums of its first
    words: values of the pairs held, and counts of the others."""

    def build(t: pa.Table) -> pa.Table:
        flat = lambda name: np.concatenate([c.values.to_numpy() for c in t.column(name)])
        us, ns, keys, counts = (flat(c) for c in ("us", "ns", "ps", "cs"))
        keys = keys.view(np.uint64)
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        c, u = np.add.reduceat(counts[order].astype(np.int64), at), np.repeat(us, ns)[order][at]
        keys, level = keys[order][at], level_of(c, min_count)
        n = int(level.sum())
        n_bits = max(1 << 12, -(-int(n * probes / np.log(2)) // 64) * 64) if n else 0
        own = np.zeros(n_bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            for p in places(keys[level >= q], q, np.uint64(n_bits), probes):
                own[p] = True
        word, back = np.unique(u, return_inverse=True)
        held = np.bincount(back, value_of(level, min_count), len(word))
        rest = np.bincount(back, np.where(level > 0, 0, c), len(word))
        return pa.table({"seg": pa.array([t.column("seg")[0].as_py()], pa.int32()), "n_bits": pa.array([n_bits], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary()), "u": pa.array([word], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.float64())), "open": pa.array([rest], pa.list_(pa.float64()))})

    return parts.groupBy("seg").applyInArrow(build, "seg int, n_bits long, bits binary, u array<long>, held array<double>, open array<double>")


def lm_score(docs: DataFrame, held_out: Column, head: int = 1 << 19, min_count: int = 2, mu: float = 100.0, false_words: float = 0.125, most_bytes: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a model learnt from the rows for which ``held_out`` isn't true.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Null texts are
    empty: their one token is the end. See the module for the model. Logarithms are to base 10.

    Returns one row per input row: ``id_col``, held_out (false for a null condition), n_tokens,
    n_known, train_tokens (long), base_score (sum of log P1), score (sum of log P). Other columns are
    not read. With nothing to learn from, N and V are 0 and all probabilities are 1.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = source.where(~F.col("held_out")).select("text")
    sc = source.sparkSession.sparkContext

    def words_of(b):
        for _, _, buf, bounds in text_pieces(b.column(0)):
            yield tokens(buf, bounds)[0]

    counts = scratch(counted(learn, words_of), "counts")
    n, v, often = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") >= min_count, 1))).first()
    # the lowest count such that no more than `head` words have it or more: one row per distinct count
    per_count = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("c"))))
    least = per_count.where(F.col("above") <= head).agg(F.min("c")).first()[0] or 1 << 62
    frequent = counts.where(F.col("c") >= least)

    def arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
        got = df.select(*names).toArrow()  # at most `head` rows
        return [got.column(c).to_numpy() for c in names]

    h, c = arrays(frequent, "h", "c")
    top = Head(h.astype(np.int64).view(np.uint64), c.astype(np.int64))
    at_first = sc.broadcast(top)
    log_segments = segments_for(n, _IN_SEGMENT)
    probes = max(24, int(np.ceil(np.log2(max(1, often) / false_words))))
    built = scratch(filter_parts(pair_counts(learn, at_first, log_segments), min_count, probes), "pairs")
    at_first.destroy()

    false_mass = often * 0.5**probes * float(value_of(np.array([1]), min_count)[0])
    sums = built.select(F.explode(F.arrays_zip("u", "held", "open")).alias("x")).groupBy(F.col("x.u").alias("h")).agg(F.sum("x.held").alias("held"), F.sum("x.open").alias("open"))
    rest = mu + F.coalesce("open", F.lit(0.0))
    known = scratch(counts.join(sums, "h", "full").select("h", "c", rest.alias("rest"), (F.coalesce("held", F.lit(0.0)) + false_mass + rest).alias("whole")), "words")
    h, rests, wholes = arrays(known.where((F.col("c") >= least) | (F.col("h") == int(START.view(np.int64)))), "h", "rest", "whole")
    h = h.astype(np.int64).view(np.uint64)
    by_word = {"rest": np.full(len(top.words), mu), "whole": np.full(len(top.words), mu + false_mass)}
    at = top.find(h)
    by_word["rest"][at[at >= 0]], by_word["whole"][at[at >= 0]] = rests[at >= 0], wholes[at >= 0]
    first = np.flatnonzero(h == START)
    start = (float(rests[first[0]]), float(wholes[first[0]])) if len(first) else (mu, mu + false_mass)
    total = n + _ADD * (v + 1)
    shared = sc.broadcast((top, np.append(by_word["rest"], [start[0]]), np.append(by_word["whole"], [start[1]])))

    def score(batches, part, base_too: bool):
        """Sums over the tokens whose pair lies in this part, and what is left for the joins:
        [word, context or 0, level, rest] of rare words and [context, level, P1] of rare contexts alone."""
        top, rest, whole = shared.value
        rows, filt = RowKeys(), part.value
        inside = (filt.low, filt.low + len(filt.sizes))
        for b in batches:
            for i, j, buf, bounds in text_pieces(b.column(1), 1 << 20):
                h, before, first = tokens(buf, bounds)
                w = top.find(h)
                u = np.append(-1, w[:-1])
                u[first[:-1]] = -1
                seg = top.segments(before, u, h, log_segments)
                u[first[:-1]] = len(top.words)
                here = (seg >= inside[0]) & (seg < inside[1])
                level = np.zeros(len(h), np.int64)
                level[here] = filt.levels(pair_keys(before[here], h[here]), seg[here])
                c = np.where(w >= 0, top.counts[w], 0) if len(top.words) else np.zeros(len(h), np.int64)
                level[(w >= 0) & (c < min_count)] = 0
                p1 = (c + _ADD) / total
                done = here & (w >= 0) & (u >= 0)
                own = np.where(done, np.log10((value_of(level, min_count) + rest[u] * p1) / whole[u]), 0.0)
                at = first[:-1]
                base = np.where(w >= 0, np.log10(p1), 0.0) if base_too else np.zeros(len(h))
                rare = np.flatnonzero(here & (w < 0))
                lone = np.flatnonzero(here & (w >= 0) & (u < 0))
                own[rare] = np.where(u[rare] >= 0, -np.log10(whole[u[rare]]), 0.0)
                at_rare, at_lone = np.searchsorted(rare, first), np.searchsorted(lone, first)
                arrays = [pa.array(rows.take(j - i)), b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(own, at))]
                arrays += [lists(h[rare].view(np.int64), at_rare), lists(np.where(u[rare] >= 0, 0, before[rare].view(np.int64)), at_rare), lists(level[rare].astype(np.int8), at_rare), lists(np.where(u[rare] >= 0, rest[u[rare]], 0.0), at_rare)]
                arrays += [lists(before[lone].view(np.int64), at_lone), lists(level[lone].astype(np.int8), at_lone), lists(p1[lone], at_lone)]
                yield pa.RecordBatch.from_arrays(arrays, names=NAMES)

    NAMES = ["key", "doc_id", "held_out", "n_tokens", "known", "base", "part", "w", "wu", "wl", "wr", "u", "ul", "up"]
    kind = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, part double, w array<long>, wu array<long>, wl array<byte>, wr array<double>, u array<long>, ul array<byte>, up array<double>"
    passes = []
    for k, (low, sizes, data) in enumerate(_loaded(built, log_segments, most_bytes)):
        part = sc.broadcast(LogFrequencies(low, sizes, data, probes))
        del data
        passes.append(scratch(source.select("doc_id", "text", "held_out").mapInArrow(lambda it, part=part, k=k: score(it, part, k == 0), kind), "scored"))
        part.destroy()
    shared.destroy()
    scored, later = passes[0], passes[1:]
    value = lambda level: F.when(F.col(level) > 0, (F.lit(3.0 * min_count) * F.pow(F.lit(2.0), F.col(level) - 1.0) - 1.0) / 2.0).otherwise(0.0)
    tails = []
    for p in passes:
        rare = p.select("key", F.explode(F.arrays_zip("w", "wu", "wl", "wr")).alias("x")).select("key", F.col("x.w").alias("h"), "x.wu", "x.wl", "x.wr")
        rare = rare.join(known.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("p1", (F.col("c") + _ADD) / total)
        rare = scratch(rare.select("key", "wu", "c", "p1", F.when(F.col("c") >= min_count, F.col("wl")).otherwise(F.lit(0)).cast("byte").alias("wl"), "wr"), "rare")
        tails.append(rare.select("key", F.when(F.col("wu") == 0, F.log10(value("wl") + F.col("wr") * F.col("p1"))).otherwise(0.0).alias("more"), F.log10("p1").alias("base"), F.when(F.col("c") > 0, 1).otherwise(0).cast("long").alias("known")))
        lone = p.select("key", F.explode(F.arrays_zip("u", "ul", "up")).alias("x")).select("key", F.col("x.u").alias("h"), F.col("x.ul").alias("l"), F.col("x.up").alias("p1"))
        lone = lone.union(rare.where("wu <> 0").select("key", F.col("wu").alias("h"), F.col("wl").alias("l"), "p1")).join(known.select("h", "rest", "whole"), "h", "left")
        more = F.log10((value("l") + F.coalesce("rest", F.lit(mu)) * F.col("p1")) / F.coalesce("whole", F.lit(mu + false_mass)))
        tails.append(lone.select("key", more.alias("more"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known")))
    for p in later:
        tails.append(p.select("key", F.col("part").alias("more"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known")))
    tail = tails[0]
    for t in tails[1:]:
        tail = tail.union(t)
    tail = tail.groupBy("key").agg(F.sum("more").alias("more"), F.sum("base").alias("tail_base"), F.sum("known").alias("found"))
    zero = F.lit(0.0)
    return scored.select("key", "doc_id", "held_out", "n_tokens", "known", "base", "part").join(tail, "key", "left").select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("part") + F.coalesce("more", zero)).alias("score"))


def _loaded(built: DataFrame, log_segments: int, most_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The filter in runs of segments of at most ``most_bytes``, or one segment: first segment, bits of each, bytes."""
    got = built.select("seg", "n_bits").toArrow()  # a row of two numbers for each segment
    sizes = np.zeros(1 << log_segments, np.int64)
    sizes[got.column("seg").to_numpy()] = got.column("n_bits").to_numpy()
    low = 0
    while low < len(sizes):
        ends = np.cumsum(sizes[low:]) // 8
        high = low + max(1, int(np.searchsorted(ends, most_bytes, side="right")))
        own = sizes[low:high]
        starts, data = (np.cumsum(own) - own) // 8, np.zeros(int(own.sum()) // 8 + 1, np.uint8)
        for row in built.where(F.col("seg").between(low, high - 1)).select("seg", "bits").toLocalIterator():
            data[starts[row.seg - low] : starts[row.seg - low] + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
        yield low, own, data
        low = high
