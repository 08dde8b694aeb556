"""Token files: documents as frequency-ranked ids in a byte-aligned variable-length coding.

Format. A file set is a folder with two Parquet tables. ``ranks`` holds the token ids of the corpus
and their rank by falling count (ties by id). ``blocks`` holds one row per block of whole documents:
shard and block number, position of the block's first id in its shard, document ids and lengths, and
two byte strings. ``control`` has two bits per id, four ids to a byte, lowest first: the number of
bytes of its rank less one. ``data`` has those bytes, little end first. Shards and blocks follow the
ids of the documents. Readers look up a control byte's four lengths in a table and gather all
values at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, removed, scratch, text_pieces, written
from .words import span_hashes

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
#: Parts that a worker remembers; with their tokens some 100 MB at most.
_CACHE = 3_000_000
#: Bytes of the longest part that is known by its hash.
_LONGEST = 256
BLOCK = "shard int, block int, first long, ids array<long>, sizes array<int>, control binary, data binary"


def _bytes(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return out


_SPACE = _bytes([*range(0x09, 0x0E), 0x20])
_LETTER = _bytes([*range(65, 91), *range(97, 123)])
_MARK = _bytes([c for c in range(0x21, 0x7F) if not chr(c).isalnum()])
_SOLID = _bytes(range(0x21, 0x7F))
#: Bytes that may begin a character of white space.
_OPEN = _SPACE | _bytes([*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])


def part_starts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where parts begin that byte-level BPE encodes alike alone and in the text: at each text, at a space
    before a character that is no white space, at white space after a visible ASCII character, and at a
    mark after an ASCII letter."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n:
        cut[: n - 1] = (buf[:-1] == 0x20) & ~_OPEN[buf[1:]]
        cut[1:n] |= (_SOLID[buf[:-1]] & _SPACE[buf[1:]] & (buf[1:] != 0x20)) | (_LETTER[buf[:-1]] & _MARK[buf[1:]])
    cut[bounds] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Token ids of texts; each distinct part is encoded once while it stays in the worker's memory."""

    def __init__(self, tokenizer_path: str, kind: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = np.dtype(kind)
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)  # a letter of the vocabulary stands for a byte
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([*map(len, got)], np.int64)
        return np.fromiter((i for ids in got for i in ids), self.kind, int(n.sum())), n

    def parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts. In a row they cost less than alone; a part that can't follow any other follows " a"."""
        free = [len(t) > 1 and t[0] == 0x20 and not _OPEN[t[1]] for t in texts]
        tied = [not f and (_SPACE[t[0]] and t[0] != 0x20 or bool(_MARK[t[0]])) for f, t in zip(free, texts, strict=True)]
        out = [np.zeros(0, self.kind)] * len(texts)
        alone = [k for k in range(len(texts)) if not free[k] and not tied[k]]
        rows = [k for k in range(len(texts)) if free[k] or tied[k]]
        for s in range(0, len(rows), 2048):
            own, row = rows[s : s + 2048], []
            for k in own:
                row += [texts[k]] if free[k] else [b" a", texts[k]]
            ids = np.array(self.tok.encode_batch_fast([b"".join(row).decode()], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([*map(len, row)])) + 1
            last = np.cumsum([1 if free[k] else 2 for k in own]) - 1
            for k, a, b in zip(own, np.where(last > 0, ends[last - 1], 0).tolist(), ends[last].tolist(), strict=True):
                out[k] = ids[a:b]
        if alone:
            flat, own = self.alone([texts[k].decode() for k in alone])
            for k, a in zip(alone, np.split(flat, np.cumsum(own)[:-1]), strict=True):
                out[k] = a
        return np.concatenate(out), np.array([*map(len, out)], np.int64)

    def keep(self, flat: np.ndarray) -> int:
        """Add ids to the pool; where they begin."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def encode(self, buf: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's ids begin."""
        raw = buf.tobytes()
        if len(self.keys) > _CACHE:
            self.clear()
        starts = part_starts(buf, bounds)
        whole = any(t in raw for t in self.special)
        if whole:  # such a text isn't cut: white space before a special token is its own part
            starts = np.unique(bounds[:-1][np.diff(bounds) > 0])
        ends = np.append(starts[1:], len(raw))
        hashes = span_hashes(buf, starts, ends)
        far = (ends - starts > _LONGEST) | whole
        u, first, back = np.unique(hashes[~far], return_index=True, return_inverse=True)
        first = np.flatnonzero(~far)[first]
        place = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            flat, n = self.parts([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = self.keep(flat) + np.cumsum(n) - n
            into = np.searchsorted(self.keys, u[new])
            self.keys, self.at, self.n = np.insert(self.keys, into, u[new]), np.insert(self.at, into, at), np.insert(self.n, into, n)
            place = np.searchsorted(self.keys, u)
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[~far], n[~far] = self.at[place][back], self.n[place][back]
        used = self.used
        if far.any():
            flat, own = self.alone([raw[starts[k] : ends[k]].decode() for k in np.flatnonzero(far)])
            at[far], n[far] = self.keep(flat) + np.cumsum(own) - own, own
        parts = np.searchsorted(starts, bounds)  # an end stands after each text's parts
        at, n = np.insert(at, parts[1:], self.keep(np.array([end_id]))), np.insert(n, parts[1:], 1)
        before = np.cumsum(n) - n
        out = self.pool[np.repeat(at - before, n) + np.arange(int(n.sum()))]
        self.used = used
        return out, np.append(before, len(out))[parts + np.arange(len(parts))]


def encode(batches, tokenizer_path: str, end_id: int, kind: str, special_as_text: bool = False):
    """(doc_id, text) to (doc_id, ids as ``kind``, little end first)."""
    kept = kept_by_worker(f"{tokenizer_path} {kind} {special_as_text}")
    if "encoder" not in kept:
        kept["encoder"] = Encoder(tokenizer_path, kind, special_as_text)
    for b in batches:
        for i, j, buf, bounds in text_pieces(b.column(1), 1 << 20):
            ids, at = kept["encoder"].encode(buf, bounds, end_id)
            offsets = pa.py_buffer((at * ids.itemsize).astype(np.int32).tobytes())
            blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, offsets, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), blobs], names=["doc_id", "tokens"])


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    n = len(values)
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(n, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block_ids: int = 1 << 16, special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write a file set at ``path``, documents in ascending id order.

    Nulls are empty texts; every document ends with ``end_id``. Equal ids are ordered by their
    tokens; a null id comes first. Other columns are not read. A block closes once it has
    ``block_ids`` ids; a document is never split. Strings of special tokens in a text become these
    tokens, or with ``special_as_text`` ordinary text.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    coded_at = len(written)
    coded = scratch(source.mapInArrow(lambda it: encode(it, tokenizer_path, end_id, kind, special_as_text), "doc_id long, tokens binary"), "tokens")

    def count(batches):
        total: np.ndarray = np.zeros(1 << 16, np.int64)
        for b in batches:
            for blob in b.column(0):
                own = np.bincount(np.frombuffer(blob.as_buffer(), kind))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    counts = coded.select("tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as the tokenizer has ids, so one sort and one broadcast of fixed size
    ranks = counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"))
    ranks.write.parquet(f"{path}/ranks")
    known = spark.read.parquet(f"{path}/ranks").toPandas()
    rank = np.zeros(int(known["id"].max() if len(known) else 0) + 1, np.uint32)
    rank[known["id"].to_numpy(np.int64)] = known["rank"].to_numpy(np.uint32)
    rank_of = spark.sparkContext.broadcast(rank)

    def blocks(batches):
        from pyspark import TaskContext

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal ids, parts, held, block, first
            flat = np.concatenate(parts)
            control, data = pack(flat)
            row = {"shard": [shard], "block": [block], "first": [first], "ids": [ids], "sizes": [[len(p) for p in parts]], "control": [control], "data": [data]}
            out = pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())]))
            ids, parts, held, block, first = [], [], 0, block + 1, first + len(flat)
            return out

        for b in batches:
            for doc_id, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts.append(rank_of.value[np.frombuffer(blob.as_buffer(), kind)])
                ids.append(doc_id)
                held += len(parts[-1])
                if held >= block_ids:
                    yield close()
        if parts:
            yield close()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = coded.withColumn("tie", F.xxhash64("tokens")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "tokens")
    ordered.select("doc_id", "tokens").mapInArrow(blocks, BLOCK).write.parquet(f"{path}/blocks")
    rank_of.destroy()
    removed(spark, coded_at)


def read_token_files(spark: SparkSession, path: str, digest: Callable[[np.ndarray], int], name: str) -> DataFrame:
    """Decode the blocks and apply ``digest`` to each document's ids; its result is the column ``name``.

    Returns doc_id, start (ids of all documents before this one), n_tokens and ``name`` (long).
    """
    arrow = pa.schema([(c, pa.int64()) for c in ("shard", "doc_id", "first", "n_tokens", name)])
    known = spark.read.parquet(f"{path}/ranks").toPandas()
    id_at = np.zeros(len(known), np.uint32)
    id_at[known["rank"].to_numpy(np.int64)] = known["id"].to_numpy(np.uint32)
    ids_of = spark.sparkContext.broadcast(id_at)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row per file
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def decode(batches):
        for b in batches:
            for row in range(b.num_rows):
                shard, first, ids, sizes, control, data = (b.column(k)[row].as_py() for k in range(6))
                ends = np.cumsum(sizes)
                flat = ids_of.value[unpack(control, data, int(ends[-1]))]
                out = [[shard] * len(ids), ids, [first + int(e) - s for s, e in zip(sizes, ends, strict=True)], sizes, [digest(flat[e - s : e]) for s, e in zip(sizes, ends, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=arrow)

    docs = blocks.select("shard", "first", "ids", "sizes", "control", "data").mapInArrow(decode, f"shard long, doc_id long, first long, n_tokens long, {name} long")
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", name)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
