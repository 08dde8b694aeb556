"""Language identification by compression.

For each language of the labelled rows a bounded sample of text becomes a raw-content zstandard
dictionary. A text is compressed with every dictionary, in blocks so that its own history doesn't
outweigh the dictionary; the language with the smallest output wins. Outputs are whole bytes, too coarse
for a few words; so short texts are also compressed with parts of each dictionary, and all outputs add up.
The relative distance to the runner-up is the score, and a narrow one rejects the text.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


def fit(docs: DataFrame, learn: Column, sample_docs: int = 300, sample_chars: int = 1000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries by language from at most ``sample_docs`` pieces of ``sample_chars`` code points each.

    The pieces are chosen by a hash of the row and start at a hashed place of the text. Rows with a
    null text or language don't count. What reaches the driver is bounded by these two parameters
    and the number of languages.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)).alias("h"))
    piece = F.substring(F.col("text"), (1 + F.pmod("h", F.greatest(F.length("text") - sample_chars, F.lit(1)))).cast("int"), F.lit(sample_chars))
    ranked = rows.select("lang", piece.alias("piece"), "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece")))
    parts: dict[str, list[bytes]] = {}
    for r in ranked.where(F.col("n") <= sample_docs).orderBy("lang", "n").collect():
        parts.setdefault(r.lang, []).append(r.piece.lower().encode())
    return {k: b"\n".join(v) + b"\n" for k, v in parts.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int = 2048, level: int = 3, short: int = 512, parts: int = 8):
        self.langs, self.block, self.short = sorted(dictionaries), block, short

        def packer(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.packers, self.finer = [], []
        for raw in map(dictionaries.get, self.langs):
            step = -(-len(raw) // parts)
            self.packers.append([packer(raw)])
            self.finer.append(self.packers[-1] + [packer(raw[k : k + step]) for k in range(0, len(raw), step)])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = text.lower().encode()
        blocks = [raw[k : k + self.block] for k in range(0, len(raw), self.block)]
        packers = self.packers if len(raw) > self.short else self.finer
        sizes = sorted((sum(len(p.compress(b)) for p in own for b in blocks), lang) for own, lang in zip(packers, self.langs, strict=True))
        return sizes[0][1], 1.0 if len(sizes) == 1 else 1.0 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.001, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All rows of ``docs`` with lang_pred, score (0 to 1) and rejected, or other ``names`` for these.

    ``und`` with score 0 goes to a null text and one without a letter (also if nothing was learnt);
    such rows and those whose score is below ``min_margin`` are rejected. Equal sizes go to the first
    language by code point, with score 0. The language and source columns are never read. Columns of
    those three names in ``docs`` are replaced. Whole texts are compressed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    base = docs.drop(*names)
    at = base.columns.index(text_col)

    def run(batches):
        model = Classifier(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                got = [model.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[1] < min_margin for g in got], pa.bool_())], names=[*part.schema.names, *names])

    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    return base.mapInArrow(run, schema)
