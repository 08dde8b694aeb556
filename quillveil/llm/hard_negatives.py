"""Hard negatives by integer scores, with angular triangle filtering.

Each vector stores its angles to a few reference directions. For vectors a and x with angles s and t to one of
them, the angle between a and x lies in [|s - t|, min(s + t, 2 pi - s - t)], so its cosine lies in an interval;
times both norms and widened for rounding this bounds the score. Rows lie in windows of neighbours: by their
nearest direction, then by the angle to it. A window has an interval of angles for every direction and one of
norms, and an anchor scores its rows only if the window's bounds overlap the scores that still count: those
above its fifth best positive so far, or those within a positive's limits and above its tenth best negative.

Anchors meet rows in blocks of bounded size on either side. Tasks return the best few rows of each anchor,
and a window function takes the best of these. Blocks whose bounds rule out all negatives aren't shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RowKeys, batch, scratch
from .cover_tree import matrix

_ANGLE = 1e-6
_PACKED = "first long, last long, n int, width int, keys binary, ids binary, labels binary, vectors binary, norms binary, angles binary, low array<double>, high array<double>, least double, most double"


def directions(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` unit rows of the sample, each in turn the furthest from those before."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0, None]
    out, best = unit[:1], np.full(len(unit), np.inf)
    while 0 < len(out) < min(k, len(unit)):
        best = np.minimum(best, 2 - 2 * unit @ out[-1])
        if best.max() <= 1e-9:
            break
        out = np.vstack([out, unit[best.argmax()]])
    return out


def angles_to(x: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    cos = x @ refs.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cos, -1, 1))


def bounds(norms: np.ndarray, angles: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and window the least and the most that a score can be.

    ``low`` and ``high`` are the windows' angles to the directions, ``least`` and ``most`` their norms.
    """
    near, far = np.zeros((len(norms), len(least))), np.full((len(norms), len(least)), np.pi)
    for r in range(angles.shape[1]):
        s = angles[:, r : r + 1]
        near = np.maximum(near, np.maximum(low[None, :, r] - s, s - high[None, :, r]))
        far = np.minimum(far, np.minimum(s + high[None, :, r], 2 * np.pi - s - low[None, :, r]))
    up, down = np.cos(np.clip(near - _ANGLE, 0, np.pi)), np.cos(np.clip(far + _ANGLE, 0, np.pi))
    room = norms[:, None] * most * 1e-9 + 1
    return norms[:, None] * np.where(down >= 0, least, most) * down - room, norms[:, None] * np.where(up >= 0, most, least) * up + room


class Packed:
    """A block of rows, sorted into windows."""

    def __init__(self, row: dict, dims: int):
        n = row["n"]
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("keys", "ids", "labels"))
        self.x = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(n, dims)
        self.norms = np.frombuffer(row["norms"])
        self.angles = np.frombuffer(row["angles"]).reshape(n, -1)

    def windows(self, rows: int) -> tuple[np.ndarray, ...]:
        at = np.arange(0, len(self.keys), rows)
        return np.minimum.reduceat(self.angles, at), np.maximum.reduceat(self.angles, at), np.minimum.reduceat(self.norms, at), np.maximum.reduceat(self.norms, at)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by doubles while these hold every sum."""
    size = lambda m: float(np.abs(m.astype(float)).max(initial=0))
    if size(a) * size(x) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(float) @ x.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ x.T.astype(np.int64)


class Best:
    """The best ``k`` rows for each of some slots: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.rows, self.held = k, [np.zeros((0, 4), np.int64)], 0
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        self.rows.append(np.stack([slot, score, ids, keys], axis=1))
        self.held += len(slot)
        if self.held > 1 << 16:
            self.done()

    def done(self) -> np.ndarray:
        rows = np.concatenate(self.rows)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begin = np.searchsorted(rows[:, 0], rows[:, 0])
        rows = rows[np.arange(len(rows)) - begin < self.k]
        full = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0]) == self.k - 1)
        self.least[rows[full, 0]] = rows[full, 1]
        self.rows, self.held = [rows], 0
        return rows


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, n_directions: int = 8, sample: int = 4096, together: int = 512, block: int = 2048, window: int = 128, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of the same label, the first ``negatives``
    rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    A component x counts as floor(scale * x), x as a double; a score is the inner product of two rows, higher ones
    come first, ties by smaller id. Shorter vectors count as padded by zeros. Rows with a null id, label or vector,
    a null or non-finite component, or a scaled vector with a squared norm above 2^56 take no part. ``anchor`` is a
    condition on the columns. Repeated rows are rows of their own: a copy of an anchor is another row of its label,
    and each copy has its own output rows. Other columns are not read; an empty table gives none. The sample of
    ``sample`` rows only places the directions; all rows are compared.

    Returns anchor_id, positive_id (long), rank (int, from 1), negative_id, positive_score, negative_score (long).
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    source = source.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    source = source.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double"))).where(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c) <= float(1 << 56))
    n, asking, dims = source.agg(F.count("*"), F.count_if("is_anchor"), F.greatest(F.coalesce(F.max(F.size("v")), F.lit(0)), F.lit(1))).first()
    few = source.select("v", F.xxhash64("v").alias("h")).where(F.pmod("h", F.lit(-(-max(1, n) // (16 * sample)))) == 0)
    some = few.distinct().orderBy("h", "v").limit(sample).collect()
    refs = directions(np.array([np.pad(r.v, (0, dims - len(r.v))) for r in some]).reshape(len(some), dims), n_directions)
    refs = refs if len(refs) else np.zeros((1, dims))
    shared = spark.sparkContext.broadcast(refs)

    def place(batches):
        keys = RowKeys()
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(2), dims)
                norms = np.sqrt((x * x).sum(axis=1))
                angles = angles_to(x, norms, shared.value)
                cell = angles.argmin(axis=1)
                yield batch(["key", "id", "label", "v", "is_anchor", "cell", "near"], [keys.take(len(x)), b.column(0), b.column(1), b.column(2), b.column(3), cell.astype(np.int32), angles[np.arange(len(x)), cell]])

    placed = scratch(source.mapInArrow(place, "key long, id long, label long, v array<double>, is_anchor boolean, cell int, near double"), "placed")

    def packed(rows: DataFrame, count: int, size: int) -> DataFrame:
        """Blocks of up to ``size`` neighbouring rows, each a row of arrays."""

        def pack(batches):
            held = None
            for b in batches:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                while held.num_rows >= size:
                    yield one(held.slice(0, size))
                    held = held.slice(size)
            if held is not None and held.num_rows:
                yield one(held)

        def one(t: pa.Table) -> pa.RecordBatch:
            key, ids, labels = (t.column(c).to_numpy() for c in ("key", "id", "label"))
            x = matrix(t.column("v").combine_chunks(), dims)
            norms = np.sqrt((x * x).sum(axis=1))
            angles = angles_to(x, norms, shared.value)
            width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(x).max(initial=0) < 1 << (8 * w - 1))
            row = {"first": int(key.min()), "last": int(key.max()), "n": len(key), "width": width, "keys": key.tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": x.astype(f"i{width}").tobytes(), "norms": norms.tobytes(), "angles": angles.tobytes(), "low": angles.min(axis=0).tolist(), "high": angles.max(axis=0).tolist(), "least": float(norms.min()), "most": float(norms.max())}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("first", pa.int64()), ("last", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("keys", "ids", "labels", "vectors", "norms", "angles")], ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("least", pa.float64()), ("most", pa.float64())]))

        parts = max(1, -(-count // (4 * size)))
        spread = rows.repartitionByRange(parts, "cell", "near", "key").coalesce(parts).sortWithinPartitions("cell", "near", "key")
        return spread.select("key", "id", "label", "v").mapInArrow(pack, _PACKED)

    held = scratch(packed(placed, n, block).withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = scratch(packed(placed.where("is_anchor"), asking, together).withColumn("asker", F.monotonically_increasing_id()), "anchors")
    shared.destroy()
    # these numbers are a task's in the upper bits and count from 0 in the lower 33
    tasks, most = asked.agg(F.coalesce(F.max(F.shiftright("asker", 33)), F.lit(0)), F.coalesce(F.max(F.col("asker").bitwiseAND((1 << 33) - 1)), F.lit(0))).first()
    every = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(tasks))).alias("task")).select("block", "task", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    every = every.select("block", (F.shiftleft(F.col("task").cast("long"), 33) + F.col("k")).alias("asker")).join(asked.select("asker"), "asker")
    every = scratch(every.select("block", "asker"), "pairs")

    def blocks_of(t: pa.Table):
        return [Packed(r, dims) for r in t.to_pylist()]

    def meet(pairs: DataFrame, left: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on each pair of blocks that is left, the anchors' first."""
        one = left.join(pairs, "asker")
        two = held.join(pairs.select("block", F.col("asker").alias("with")), "block")
        # the pair is the key: a group holds one block of either side
        return one.groupBy("asker", "block").cogroup(two.groupBy("with", "block")).applyInArrow(work, schema)

    best = "asker long, anchor int, key long, score long, id long"

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        top = None
        for a, x in zip(blocks_of(left), blocks_of(right), strict=True):
            top = Best(len(a.keys), positives)
            lows, highs, least, most = x.windows(window)
            _, up = bounds(a.norms, a.angles, lows, highs, least, most)
            for w in np.argsort(-up.max(axis=0)):
                rows = slice(w * window, (w + 1) * window)
                who = np.flatnonzero(up[:, w] >= top.least)
                if not len(who):
                    continue
                s = scores(a.x[who], x.x[rows])
                good = (a.labels[who, None] == x.labels[None, rows]) & (a.keys[who, None] != x.keys[None, rows]) & (s >= top.least[who, None])
                p, q = np.nonzero(good)
                top.add(who[p], s[p, q], x.ids[rows][q], x.keys[rows][q])
        rows = top.done() if top else np.zeros((0, 4), np.int64)
        asker = left.column("asker")[0].as_py() if left.num_rows else 0
        return pa.table({"asker": np.full(len(rows), asker), "anchor": rows[:, 0].astype(np.int32), "key": rows[:, 3], "score": rows[:, 1], "id": rows[:, 2]})

    first = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id", "key")
    found = meet(every, asked, nearest, best)
    found = found.withColumn("slot", F.row_number().over(first("asker", "anchor"))).where(F.col("slot") <= positives)
    found = scratch(found, "positives")
    # at most ``positives`` for each of the ``together`` anchors of a block
    limits = found.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("anchor", "slot", "score", "id"))).alias("slots"), F.min(F.when(F.col("score") >= 0, F.col("score"))).alias("worst"))
    asked = scratch(asked.join(limits, "asker"), "asked")
    # what a block can score at most with any anchor of a block, against the least that counts
    side = lambda t, k: t.select(k, *[F.col(c).alias(f"{c}_{k}") for c in ("low", "high", "least", "most")])
    pairs = every.join(side(asked, "asker"), "asker").join(asked.select("asker", "worst"), "asker").join(side(held, "block"), "block")
    apart = F.array_max(F.zip_with(F.zip_with("low_block", "high_asker", lambda x, y: x - y), F.zip_with("low_asker", "high_block", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))))
    up = F.cos(F.greatest(apart - _ANGLE, F.lit(0.0)))
    reach = F.when(up >= 0, F.col("most_asker") * F.col("most_block") * up).otherwise(F.col("least_asker") * F.col("least_block") * up) + F.col("most_asker") * F.col("most_block") * 1e-9 + 1
    pairs = scratch(pairs.where(reach >= F.col("worst") * (low / 100)).select("block", "asker"), "pairs")

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, a, x in zip(left.to_pylist(), blocks_of(left), blocks_of(right), strict=True):
            slots = row["slots"]
            who, slot, ps, pid = (np.array([s[c] for s in slots], np.int64) for c in ("anchor", "slot", "score", "id"))
            lo, hi = -(-low * ps // 100), high * ps // 100
            some = np.flatnonzero(lo <= hi)
            who, slot, ps, pid, lo, hi = (c[some] for c in (who, slot, ps, pid, lo, hi))
            top = Best(len(who), negatives)
            lows, highs, least, most = x.windows(window)
            down, up = bounds(a.norms, a.angles, lows, highs, least, most)
            for w in np.argsort(-up.max(axis=0)):
                rows = slice(w * window, (w + 1) * window)
                on = np.flatnonzero((down[who, w] <= hi) & (up[who, w] >= np.maximum(lo, top.least)))
                if not len(on):
                    continue
                some, back = np.unique(who[on], return_inverse=True)
                s = scores(a.x[some], x.x[rows])[back]
                good = (s >= np.maximum(lo, top.least)[on, None]) & (s <= hi[on, None]) & (a.labels[who[on], None] != x.labels[None, rows])
                p, q = np.nonzero(good)
                top.add(on[p], s[p, q], x.ids[rows][q], x.keys[rows][q])
            rows = top.done()
            k = rows[:, 0]
            out.append(pa.table({"asker": np.full(len(rows), row["asker"]), "anchor": who[k].astype(np.int32), "slot": slot[k].astype(np.int32), "anchor_id": a.ids[who[k]], "positive_id": pid[k], "positive_score": ps[k], "key": rows[:, 3], "score": rows[:, 1], "id": rows[:, 2]}))
        empty = pa.table({c: pa.array([], t) for c, t in (("asker", pa.int64()), ("anchor", pa.int32()), ("slot", pa.int32()), *[(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "key", "score", "id")])})
        return pa.concat_tables([empty, *out])

    mined = meet(pairs, asked, negative, "asker long, anchor int, slot int, anchor_id long, positive_id long, positive_score long, key long, score long, id long")
    mined = mined.withColumn("rank", F.row_number().over(first("asker", "anchor", "slot"))).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
