"""Removal of lines that many documents share.

Two Bloom filters, one of once-seen and one of twice-seen line hashes, are built in segments of the
hash space. Only lines that the twice-seen filter knows are suspected; these alone shuffle, for the
exact count of documents and the choice of the one that keeps the line. Then the texts of documents
that lose lines meet the lines that they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowKeys, scratch
from .seen import expected_units, seen_twice

_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    """Keys of all lines of a UTF-8 text: stripped, A-Z lower-cased."""
    return [x.strip(_STRIP) for x in text.lower().split(b"\n")]


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, most_bytes: int = 1 << 27, broadcast_bytes: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep a line that ``min_docs`` documents or more hold only where the largest id holds it.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Keys
    of fewer than ``min_chars`` code points never count. Every row counts as a document, repeated rows
    too; rows that tie for the largest id all keep the line. Null ids are below all others.

    Returns one row per input row: ``id_col``, n_lines (before), n_dropped (long), kept (string, the
    other lines unchanged, joined by a line feed), kept_sha256. A null or empty text is one empty line.
    Other columns are not read. The shared lines are broadcast if they take no more than
    ``broadcast_bytes``; else texts with suspected lines shuffle to the lines that they lose.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def keys_of(text: str) -> list[bytes]:
        return list({k for k in line_keys(text.encode()) if _long(k, min_chars)})

    def hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        own: list[int] = []
        for text in b.column(0):
            own += map(xxhash.xxh3_64_intdigest, keys_of(text.as_py()))
            if len(own) > 1 << 18:
                yield np.array(own, np.uint64)
                own = []
        yield np.array(own, np.uint64)

    expected = expected_units(source, "text", 2 * min_chars)
    twice = source.sparkSession.sparkContext.broadcast(seen_twice(source.select("text"), hashes, expected, most_bytes))

    def found(col: pa.Array) -> list[list[str]]:
        """Of each text the suspected keys."""
        doc_keys = [keys_of(t.as_py()) for t in col]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in doc_keys])])
        flat = [k for ks in doc_keys for k in ks]
        hit = twice.value.has(np.array([xxhash.xxh3_64_intdigest(k) for k in flat], np.uint64))
        return [[flat[n].decode() for n in range(offsets[k], offsets[k + 1]) if hit[n]] for k in range(len(doc_keys))]

    def suspect(batches):
        for b in batches:
            lines = found(b.column(1))
            of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array([x for own in lines for x in own], pa.string())], names=["doc_id", "line"])

    lines = source.mapInArrow(suspect, "doc_id long, line string")
    shared = lines.groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("line", "keeper")
    shared = scratch(shared, "shared")
    size = shared.agg(F.sum(F.octet_length("line") + 100)).first()[0] or 0

    def drop(batches, gone_of):
        for b in batches:
            out = {"doc_id": b.column(0).to_pylist(), "n_lines": [], "n_dropped": [], "kept": []}
            for text, gone in zip(b.column(1).to_pylist(), gone_of(b), strict=True):
                raw = text.encode()
                n = raw.count(b"\n") + 1
                out["n_lines"].append(n)
                if gone:
                    kept = [x for x, k in zip(raw.split(b"\n"), line_keys(raw), strict=True) if k not in gone]
                    text, n = b"\n".join(kept).decode(), len(kept)
                out["n_dropped"].append(out["n_lines"][-1] - n)
                out["kept"].append(text)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]))

    kind = "doc_id long, n_lines long, n_dropped long, kept string"
    if size <= broadcast_bytes:
        keepers = source.sparkSession.sparkContext.broadcast({r.line.encode(): r.keeper for r in shared.toLocalIterator()})

        def known(b):
            own = keepers.value
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield {k for k in line_keys(text.as_py().encode()) if k in own and own[k] != doc_id}

        out = source.mapInArrow(lambda it: drop(it, known), kind)
    else:
        def judge(batches):
            rows = RowKeys()
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(rows.take(b.num_rows)), b.column(0), b.column(1), pa.array(found(b.column(1)), pa.list_(pa.string()))], names=["key", "doc_id", "text", "lines"])

        judged = scratch(source.mapInArrow(judge, "key long, doc_id long, text string, lines array<string>"), "lines")
        held = judged.select("key", "doc_id", F.explode("lines").alias("line"))
        drops = held.join(shared, "line").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("key").agg(F.collect_list("line").alias("drops"))
        # rows without suspects never shuffle their text
        kinds = judged.where(F.size("lines") > 0).join(drops, "key", "left").select("doc_id", "text", "drops")
        rest = judged.where(F.size("lines") == 0).select("doc_id", "text", F.lit(None).cast("array<string>").alias("drops"))
        out = kinds.unionByName(rest).mapInArrow(lambda it: drop(it, lambda b: ({g.encode() for g in gone or ()} for gone in b.column(2).to_pylist())), kind)
    return out.select(F.col("doc_id").alias(id_col), "n_lines", "n_dropped", "kept", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
