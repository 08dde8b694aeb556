"""Removal of long repeated word sequences by recompression.

Rounds name runs of equal tokens and then neighbouring pairs. A name is a 64-bit hash of the parts,
so all tasks give equal parts the same name without exchanging dictionaries. Whether two symbols pair
depends on these two alone (a hash bit puts the first on the left side, the second on the right), so
two equal word sequences get the same symbols except near their ends. For each window the code
follows how far its ends can disturb the parse; the symbols between, its core, are the same
wherever the window occurs. Hence a window can repeat only if all symbols of its core occur twice.
Those windows (and the few without a core) are suspects; only their 128-bit hashes are shuffled and
counted exactly. Hashes with a single occurrence clear the suspicion, everything else is a repeat:
this needs no join on the hash, so a passage that a third of the documents share makes no hot task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowKeys, lists, scratch, text_pieces
from .seen import expected_units, seen_twice
from .words import mix64, other_hashes, word_hashes, word_spans

_NAME_L, _NAME_R, _RUN = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC13FA9A902A6328F), np.uint64(0x91E10DA5C79E7B1D)


def _rounds(words: np.ndarray, doc: np.ndarray, rounds: int, window: int = 0):
    """Symbols after the rounds, and with ``window`` each window's core: first, last symbol, has one."""
    n = len(words)
    same = np.empty(n, bool)
    same[:1] = False
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    index = np.cumsum(~same) - 1
    at = np.flatnonzero(~same)
    size = np.diff(np.append(at, n)).astype(np.uint64)
    sym, owner = np.where(size > 1, mix64(words[at] ^ (size * _RUN)), words[at]), doc[at]
    if window:
        starts = np.arange(max(0, n - window + 1))
        starts = starts[doc[starts] == doc[starts + window - 1]]
        lo, hi = index[starts] + 1, index[starts + window - 1] - 1
        alive = lo <= hi
    for k in range(rounds):
        left = mix64(sym ^ np.uint64(0xA24BAED4963EE407 + k)) >> np.uint64(63) == 0
        head = np.ones(len(sym), bool)
        head[1:] = ~(left[:-1] & ~left[1:] & (owner[1:] == owner[:-1]))
        index = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        wide = np.diff(np.append(at, len(sym))) == 2
        if window:
            lo, hi = np.minimum(lo, len(sym) - 1), np.maximum(hi, 0)
            lo, hi = index[lo] + ~left[lo], index[hi] - left[hi]
            alive &= lo <= hi
        second = sym[np.minimum(at + 1, len(sym) - 1)] if len(sym) else sym
        sym, owner = np.where(wide, mix64(sym[at] * _NAME_L + mix64(second) * _NAME_R + np.uint64(k)), sym[at]), owner[at]
    return (sym, starts, lo, hi, alive) if window else sym


def _docs_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _window_hashes(words: np.ndarray, others: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit polynomial hashes of the windows, each over word hashes of its own."""
    out = []
    for base, own in ((0xD1342543DE82EF95, words), (0xAF251AF3B0F025B5, others)):
        a = mix64(own ^ np.uint64(base))
        h = np.zeros(len(starts), np.uint64)
        for k in range(window):
            h = h * np.uint64(base) + a[starts + k]
        out.append(mix64(h).view(np.int64))
    return out[0], out[1]


def substring_dedup(docs: DataFrame, window: int = 35, rounds: int = 5, most_bytes: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that a repeated window covers.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged. A window is ``window`` consecutive words of
    one text; it is repeated if its sequence also starts anywhere else, in the same text or another.
    Overlapping occurrences count. All judgements are made on the input, so copies all lose the words.

    Returns one row per input row: ``id_col``, n_words, n_removed (long), kept (string, the remaining
    words joined by one space), kept_sha256. Null and empty texts have no words and an empty ``kept``.
    Repeated rows and repeated ids are judged as separate texts; a null id is kept as null. Other
    columns are not read. With few, long texts nothing changes: a text is handled in pieces of arrays.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def symbols(b: pa.RecordBatch):
        for _, _, buf, bounds in text_pieces(b.column(0)):
            words, _, _, first = word_hashes(buf, bounds, lower=False)
            if len(words):
                yield _rounds(words, _docs_of(first), rounds)

    expected = expected_units(source, "text", 6 * 1.4**rounds)
    shared = source.sparkSession.sparkContext.broadcast(seen_twice(source.select("text"), symbols, expected, most_bytes))

    def suspects(batches):
        keys = RowKeys()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i, j, buf, bounds in text_pieces(texts):
                words, ws, we, first = word_hashes(buf, bounds, lower=False)
                counts = np.diff(first)
                starts = np.zeros(0, np.int64)
                if len(words):
                    sym, starts, lo, hi, alive = _rounds(words, _docs_of(first), rounds, window)
                    twice = np.concatenate([[0], np.cumsum(shared.value.has(sym))])
                    lo, hi = np.where(alive, lo, 0), np.where(alive, hi, 0)
                    starts = starts[~alive | (twice[hi + 1] - twice[lo] == hi + 1 - lo)]
                of = np.searchsorted(starts, first)
                kept, texts_out = [], []
                raw = buf.tobytes()
                for k in range(j - i):
                    if of[k + 1] > of[k]:
                        kept.append(None)
                        texts_out.append(raw[bounds[k] : bounds[k + 1]].decode())
                    else:
                        kept.append(b" ".join(raw[bounds[k] : bounds[k + 1]].split()).decode())
                        texts_out.append(None)
                where = starts - first[np.searchsorted(first, starts, side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.take(j - i)), ids.slice(i, j - i), pa.array(counts.astype(np.int64)), pa.array(kept, pa.string()), pa.array(texts_out, pa.string()), lists(where.astype(np.int32), of)], names=["key", "doc_id", "n_words", "kept", "text", "at"])

    judged = scratch(source.mapInArrow(suspects, "key long, doc_id long, n_words long, kept string, text string, at array<int>"), "windows")

    def hashed(batches):
        for b in batches:
            at = b.column(2)
            for i, j, buf, bounds in text_pieces(b.column(1)):
                words, ws, we, first = word_hashes(buf, bounds, lower=False)
                own = at.slice(i, j - i)
                n = np.diff(own.offsets.to_numpy())
                where = own.flatten().to_numpy()
                h1, h2 = _window_hashes(words, other_hashes(buf, ws, we), np.repeat(first[:-1], n) + where, window)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.repeat(b.column(0).slice(i, j - i).to_numpy(), n)), pa.array(where)], names=["h1", "h2", "key", "at"])

    windows = judged.where("text is not null").select("key", "text", "at").mapInArrow(hashed, "h1 long, h2 long, key long, at int")
    single = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("at").alias("at")).where("n = 1")
    cleared = single.groupBy("key").agg(F.collect_list("at").alias("cleared"))

    def remove(batches):
        for b in batches:
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
            for doc_id, text, at, cleared_at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                ws, we, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                starts = np.setdiff1d(np.array(at), np.array(cleared_at or [], np.int64)).astype(np.int64)
                step = np.zeros(len(ws) + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                words = raw.split()
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(b" ".join(words[k] for k in np.flatnonzero(~gone)).decode())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    repeats = judged.where("text is not null").select("key", "doc_id", "text", "at").join(cleared, "key", "left").select("doc_id", "text", "at", "cleared").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
    clean = judged.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    out = clean.union(repeats)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
