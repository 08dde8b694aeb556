"""Periodic runs of words by recompression.

Rounds replace blocks of one repeated symbol by (symbol, length) and then pairs of neighbours by a symbol of
their own, until each text is down to a symbol. The rules make a run-length grammar of the texts. Equal
stretches are parsed alike but for their ends, so the longest common extension of two positions is found by
climbing while both stand at the begin of their parents, and descending to the first symbol that differs.

A run of period q and length 4q or more holds four multiples of q in a row, of which one, a multiple of 3q, has
its successor in the run too. So for each period q it is enough to extend the pairs (k, k+q) at multiples k of
3q to both sides: the harmonic grid, of n log n pairs. Pairs that differ at once go before any query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, text_pieces
from .words import mix64, word_hashes

#: Pairs of the grid that are looked at together.
_TOGETHER = 1 << 20


class Grammar:
    """Levels of symbols from the words up. Level h has ``sym``; ``up`` leads to level h+1, whose ``head``
    leads back to the first child. Sentinels, each a symbol of its own, stand around every text."""

    def __init__(self, sym: np.ndarray, fixed: np.ndarray):
        self.sym, self.up, self.head, self.block = [sym.astype(np.int32)], [], [], []
        nxt, k = int(sym.max(initial=0)) + 1, 0
        while not fixed.all():
            for block in (True, False):
                if block:
                    apart = np.append(True, sym[1:] != sym[:-1])
                else:
                    left = (mix64(sym.astype(np.uint64) ^ np.uint64(0xA24BAED4963EE407 + k)) >> np.uint64(63) == 0) & ~fixed
                    apart = np.append(True, ~(left[:-1] & ~left[1:] & ~fixed[1:]))
                head = np.flatnonzero(apart)
                if len(head) == len(sym):
                    continue
                size = np.diff(np.append(head, len(sym)))
                new, many = sym[head], size > 1
                key = sym[head[many]] << 32 | (size[many] if block else sym[head[many] + 1])
                _, names = np.unique(key, return_inverse=True)
                new[many] = nxt + names
                nxt += int(names.max(initial=-1)) + 1
                self.up.append((np.cumsum(apart) - 1).astype(np.int32))
                self.head.append(np.append(head, len(sym)).astype(np.int32))
                self.block.append(block)
                sym, fixed = new, fixed[head]
                self.sym.append(sym.astype(np.int32))
            k += 1
            # a text is done when it is down to a symbol; one that the bits of this round spared goes on
            if not (~fixed[1:] & ~fixed[:-1]).any():
                break

    def _steps(self, h: int, a: np.ndarray, b: np.ndarray, ahead: int) -> np.ndarray | int:
        """How far both may go on equal symbols of level h: the shorter rest of two blocks."""
        if h == len(self.up) or not self.block[h]:
            return 1
        up, head = self.up[h], self.head[h]
        if ahead > 0:
            return np.minimum(head[up[a] + 1] - a, head[up[b] + 1] - b)
        return np.minimum(a - head[up[a]], b - head[up[b]]) + 1

    def extend(self, i: np.ndarray, j: np.ndarray, ahead: int) -> np.ndarray:
        """The numbers of equal words from ``i`` and ``j`` on, to the right (``ahead`` 1) or left (-1)."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        stop, top = np.zeros(len(a), np.int64), len(self.up)
        rising = np.arange(len(a))
        for h in range(top + 1):
            here, rising = rising, []
            while len(here):
                x, y = a[here], b[here]
                if h < top:
                    up, head = self.up[h], self.head[h]
                    edge = (lambda z: head[up[z]] == z) if ahead > 0 else (lambda z: head[up[z] + 1] - 1 == z)  # noqa: B023
                    rise = edge(x) & edge(y)
                    if rise.any():
                        go = here[rise]
                        a[go], b[go] = up[a[go]], up[b[go]]
                        rising.append(go)
                        here, x, y = here[~rise], x[~rise], y[~rise]
                same = self.sym[h][x] == self.sym[h][y]
                stop[here[~same]] = h
                here, x, y = here[same], x[same], y[same]
                step = self._steps(h, x, y, ahead)
                a[here], b[here] = x + ahead * step, y + ahead * step
            rising = np.concatenate(rising) if rising else np.zeros(0, np.int64)
        for h in range(top - 1, -1, -1):
            here = np.flatnonzero(stop > h)
            head = self.head[h]
            a[here], b[here] = (head[a[here]], head[b[here]]) if ahead > 0 else (head[a[here] + 1] - 1, head[b[here] + 1] - 1)
            while len(here):
                x, y = a[here], b[here]
                same = self.sym[h][x] == self.sym[h][y]
                here, x, y = here[same], x[same], y[same]
                step = self._steps(h, x, y, ahead)
                a[here], b[here] = x + ahead * step, y + ahead * step
        return (a - i) * ahead


def _grid(first: np.ndarray, n: np.ndarray, sym: np.ndarray, exponent: int):
    """Pairs (text, k, q) of the grid with equal words at k and k+q and at a neighbour, in bounded lots."""
    most = n // exponent
    text = np.repeat(np.arange(len(n)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (n[text] - q - 1) // ((exponent - 1) * q) + 1
    total = np.cumsum(count)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _TOGETHER, side="right")))
        c = count[lo:hi]
        d, p = np.repeat(text[lo:hi], c), np.repeat(q[lo:hi], c)
        k = first[d] + (exponent - 1) * p * (np.arange(len(d)) - np.repeat(np.cumsum(c) - c, c))
        some = np.flatnonzero(sym[k] == sym[k + p])
        d, p, k = d[some], p[some], k[some]
        some = np.flatnonzero((sym[k + 1] == sym[k + p + 1]) | (sym[k - 1] == sym[k + p - 1]))
        yield d[some], k[some], p[some]
        lo = hi


def runs_of(words: np.ndarray, first: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts given as word hashes, in that order."""
    n = np.diff(first)
    texts = len(n)
    _, names = np.unique(words, return_inverse=True)
    sym, fixed = np.empty(len(words) + texts + 1, np.int64), np.zeros(len(words) + texts + 1, bool)
    at = first + np.arange(texts + 1)  # the sentinels' places
    fixed[at] = True
    sym[~fixed] = names
    sym[at] = int(names.max(initial=-1)) + 1 + np.arange(texts + 1)
    grammar, found, begin = None, [np.zeros((0, 4), np.int64)], at[:-1] + 1
    for d, k, q in _grid(begin, n, sym, exponent):
        if not len(d):
            continue
        grammar = grammar or Grammar(sym, fixed)
        s = k - grammar.extend(k - 1, k + q - 1, -1)
        e = k + q + grammar.extend(k, k + q, 1)
        good = e - s >= np.maximum(least, exponent * q)
        d, s, e, q = d[good], s[good], e[good], q[good]
        found.append(_once(np.stack([d, s - begin[d], e - s, q], axis=1)))
    return _once(np.concatenate(found))


def _once(rows: np.ndarray) -> np.ndarray:
    """Each stretch with its smallest period, in order."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[: len(rows)]
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All maximal stretches of words that repeat with a smallest period q at least ``exponent`` (2 or more)
    times, and the text with each such stretch cut down to its first q words.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged; a stretch has ``least`` words or more. Words that
    several runs hold go if any run drops them. Null and empty texts have no words and an empty ``collapsed``.
    Long texts are handled whole, at about 150 bytes a word. Repeated rows and ids are rows of their own, a
    null id stays null, other columns are not read, an empty table gives none.

    Returns ``id_col``, n_words (long), runs (array of start, length, period by start, then period), collapsed
    (string, the words that are left joined by one space).
    """

    def run(batches):
        for b in batches:
            for i, j, buf, bounds in text_pieces(b.column(1), 1 << 20):
                words, _, _, first = word_hashes(buf, bounds, lower=False)
                rows = runs_of(words, first, exponent, least)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
                np.add.at(gone, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
                keep = np.cumsum(gone)[:-1] == 0
                of = np.searchsorted(rows[:, 0], np.arange(j - i + 1))
                raw, out = buf.tobytes(), []
                for k in range(j - i):
                    own = raw[bounds[k] : bounds[k + 1]].split()
                    if of[k + 1] > of[k]:
                        own = [own[x] for x in np.flatnonzero(keep[first[k] : first[k + 1]])]
                    out.append(b" ".join(own).decode())
                structs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
                yield batch(["doc_id", "n_words", "runs", "collapsed"], [b.column(0).slice(i, j - i), np.diff(first).astype(np.int64), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), structs), pa.array(out, pa.string())])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("doc_id", id_col)


def run_digest(runs: DataFrame) -> DataFrame:
    """The first column of ``periodic_runs`` with n_runs, the longest run (ties: smallest start, then period) and
    its exponent in thousandths, and sha256 of all runs and of the collapsed text."""
    id_col = runs.columns[0]
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    every = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = runs.select(id_col, F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("top.shorter")
    return out.select(id_col, "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"), F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of every tenth id, by crc32 of its decimal text, made periodic from some word on.

    With h that number, g = floor(h / 10) and n words, word i >= a = g mod n becomes word a + (i - a) mod p, where
    p = 1 + floor((n - a) / (3 + g mod 8)). A null id or a text without words changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def periodic(ws):
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.concat_ws(" ", F.slice(ws, F.lit(1), a.cast("int")), F.transform(F.slice(ws, a.cast("int") + 1, (n - a).cast("int")), lambda w, k: F.get(ws, (a + F.pmod(k.cast("long"), p)).cast("int"))))

    # the list of one element splits a text once
    made = F.get(F.transform(F.array(words), periodic), F.lit(0))
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), made).otherwise(F.col(text_col)))
