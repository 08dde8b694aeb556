import hashlib
import math
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from .helpers import LOWER, SCHEMA, documents, frame, words


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_line_dedup(spark):
    from quillveil.llm.line_dedup import line_dedup

    rows = documents() + [(200 + k, "x\n  A LINE that stands in many documents and is LONG \r\ny", "en", "a") for k in range(5)] + [(210, "\ta line THAT stands in many documents and is long\n" * 2, "en", "a")]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held, top = Counter(), {}
    for i, t, *_ in rows:
        for k in {strip(x) for x in (t or "").split("\n")}:
            held[k] += 1
            top[k] = max(top.get(k, -1), -1 if i is None else i)
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(strip(x)) >= 40 and held[strip(x)] >= 5 and top[strip(x)] != i)]
        want[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    for bound in (1 << 26, 0):  # with the shared lines broadcast, and joined
        got = line_dedup(frame(spark, rows), broadcast_bytes=bound)
        assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    for most in (1 << 27, 1):  # filters that are folded until they are nearly full change nothing
        got = line_dedup(frame(spark, rows), most_bytes=most)
        assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substring_dedup(spark):
    from quillveil.llm.substring_dedup import substring_dedup

    rows = documents()
    seen = Counter(tuple(w[i : i + 35]) for _, t, *_ in rows for w in [words(t)] for i in range(len(w) - 34))
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = {q for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for q in range(k, k + 35)}
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    got = substring_dedup(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(k[2] for k in want) > 500
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recompression_names_equal_cores_alike():
    import numpy as np

    from quillveil.llm.substring_dedup import _rounds

    rng = np.random.default_rng(0)
    part = rng.integers(0, 9, 35).astype(np.uint64)
    for _ in range(50):
        syms = []
        for _ in range(2):
            own = np.concatenate([rng.integers(0, 9, rng.integers(0, 30)).astype(np.uint64), part, rng.integers(0, 9, rng.integers(0, 30)).astype(np.uint64)])
            at = next(k for k in range(len(own) - 34) if (own[k : k + 35] == part).all())
            sym, starts, lo, hi, alive = _rounds(own, np.zeros(len(own), np.int64), 5, 35)
            syms.append((bool(alive[at]), list(sym[lo[at] : hi[at] + 1]) if alive[at] else None))
        assert syms[0] == syms[1]


def test_ngram_groups(spark):
    from quillveil.llm.ngram_join import ngram_groups

    rows = documents()
    for size, percent in ((3, 90), (5, 80)):
        sets = []
        for _, t, *_ in rows:
            w = [x.translate(LOWER) for x in words(t)]
            sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
        group = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
        ids = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
        want = Counter((r[0], len(s), ids[g]) for r, s, g in zip(rows, sets, group, strict=True))
        got = ngram_groups(frame(spark, rows), size, percent).cache()
        assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
        assert got.where("kept").count() == len(set(group))
    assert ngram_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_keys_lose_no_pair():
    import numpy as np

    from quillveil.llm.ngram_join import index_keys

    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        base = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        cut = int(rng.integers(0, max(1, len(base) // 8)))
        other = np.unique(np.concatenate([base[rng.permutation(len(base))[cut:]], rng.integers(0, 1 << 60, int(rng.integers(0, 5))).astype(np.uint64)]))
        both, either = len(np.intersect1d(base, other)), len(np.union1d(base, other))
        known = lambda s: s % np.uint64(5) > np.uint64(1)
        often = lambda s: s % np.uint64(3) > np.uint64(rng_share)  # noqa: E731, B023
        for rng_share in (0, 1, 2):
            if 100 * both >= 90 * either and len(base) > 1 and len(other) > 1:
                assert len(np.intersect1d(index_keys(base, known(base), often(base), 90), index_keys(other, known(other), often(other), 90)))


class PlainModel:
    """The model of lm_score by dictionaries of exact counts."""

    def __init__(self, texts, mu=100.0):
        self.words, self.pairs, self.mu = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(["<s>", *t], t, strict=False)), mu
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.held, self.open = Counter(), Counter()
        for (u, _), c in self.pairs.items():
            self.held[u] += self.value(c)
            self.open[u] += c if c < 2 else 0

    def value(self, c):
        return (6 * 2 ** (int(math.log2(c / 2))) - 1) / 2 if c > 1 else 0

    def p1(self, w):
        return (self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, w, u):
        rest = self.mu + self.open[u]
        return (self.value(self.pairs[u, w]) + rest * self.p1(w)) / (self.held[u] + rest)


@pytest.mark.parametrize("in_segment", [1 << 17, 256])
def test_lm_score(spark, monkeypatch, in_segment):
    from quillveil.llm import lm_score as module
    from quillveil.llm.common import id_bucket

    monkeypatch.setattr(module, "_IN_SEGMENT", in_segment)
    rows = documents()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    texts = [[*[w.translate(LOWER) for w in words(t)], None] for _, t, *_ in rows]
    plain = PlainModel([t for r, t in zip(rows, texts, strict=True) if not held(r[0])])
    for u in ("<s>", "the", "w1", "w2", "nowhere"):
        assert sum(plain.p(w, u) for w in [*plain.words, "nowhere"]) == pytest.approx(1)
    want = sorted((-1 if r[0] is None else r[0], held(r[0]), len(t), sum(plain.words[w] > 0 for w in t), plain.n, sum(math.log10(plain.p1(w)) for w in t), sum(math.log10(plain.p(w, u)) for u, w in zip(["<s>", *t], t, strict=False))) for r, t in zip(rows, texts, strict=True))
    # with and without joined words, and with the filter in one pass and, of 256 pairs a segment, in some
    for head, most in ((1 << 19, 1 << 27), (50, 1 << 27), (0, 1 << 27), (50, 1 << 12)):
        got = module.lm_score(frame(spark, rows), id_bucket("doc_id", 10) == 0, head=head, most_bytes=most).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        # the expected false answers of the filter are counted in the sums
        assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-5)
    assert module.lm_score(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0
    assert all(r.score == 0 for r in module.lm_score(frame(spark, rows[:3]), F.lit(True)).collect())


def test_false_answers_are_rare_and_counted():
    import numpy as np

    from quillveil.llm import lm_score as module

    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 1 << 62, 20_000).astype(np.uint64), rng.integers(2, 9, 20_000)
    level, probes = module.level_of(counts, 2), 8
    n_bits = -(-int(level.sum() * probes / np.log(2)) // 64) * 64
    bits = np.zeros(n_bits, bool)
    for q in range(1, level.max() + 1):
        for p in module.places(keys[level >= q], q, np.uint64(n_bits), probes):
            bits[p] = True
    filt = module.LogFrequencies(0, np.array([n_bits]), np.packbits(bits, bitorder="little"), probes)
    assert (filt.levels(keys, np.zeros(len(keys), np.int64)) >= level).all()
    other = rng.integers(0, 1 << 62, 200_000).astype(np.uint64)
    false = (filt.levels(other, np.zeros(len(other), np.int64)) > 0).mean()
    assert 0.5**probes / 2 < false < 0.5**probes * 2


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillveil.llm.token_files import crc_of_ids, read_token_files, write_token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = documents() + [(300, "a\n \nb  c   d\t e  f 　g's ...,x, y.\n z ", "en", "a"), (301, " lead", "en", "a"), (302, "trail  ", "en", "a"), (303, "a  <|endoftext|>  b c<|endoftext|>d\n", "en", "a"), (304, "x" * 5000 + " \u3000\u00a0 y\u2028,z  don't 'tis \x1d q …, w", "en", "a")]
    coded = [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    write_token_files(frame(spark, rows), str(tmp_path / "a"), path, block_ids=500)
    got = read_token_files(spark, str(tmp_path / "a"), crc_of_ids, "crc").collect()
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert Counter((r.doc_id, r.n_tokens, r.crc) for r in got) == Counter((i, len(t), crc(t)) for i, t in coded)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"), path)
    assert read_token_files(spark, str(tmp_path / "b"), crc_of_ids, "crc").count() == 0


def test_parts_encode_alike_alone():
    import random

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillveil.llm.token_files import encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng, letters = random.Random(4), [*"ab'sd tT9\n\t  ,.!-_…é«»", "\u00a0", "\u3000", "\u2009", "\x1c", "\x85", " the", "\r\n", "<|endoftext|>", "漢", "😀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, ""]
    for special in (False, True):
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
        got = [t for b in encode([batch, batch], path, 2, "<u2", special) for t in b.column(1).to_pylist()]
        want = [struct.pack(f"<{len(e.ids) + 1}H", *e.ids, 2) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert got == want * 2


def test_byte_coding_round_trip():
    import numpy as np

    from quillveil.llm.token_files import pack, unpack

    for values in ([], [0], [255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]):
        x = np.array(values, np.uint32)
        assert (unpack(*pack(x), len(x)) == x).all()


def test_language_id(spark):
    from quillveil.llm.language_id import fit, identify

    learn = [(k, " ".join(["the cat and the dog went out", "le chat et le chien sont partis"][k % 2].split() * 5), ["en", "fr"][k % 2], "a") for k in range(20)]
    docs = frame(spark, learn + documents())
    model = fit(docs.where("source = 'a' and doc_id < 20 and lang is not null and length(text) > 100"), F.lit(True))
    assert sorted(model) == ["en", "fr"]
    got = {r.text: (r.lang_pred, r.score, r.rejected) for r in identify(docs, model).collect()}
    assert got[learn[0][1]][0] == "en" and got[learn[1][1]][0] == "fr" and not got[learn[0][1]][2]
    for t in (None, "", " \t\n\x0b ", "12 34 !!"):
        assert got[t] == ("und", 0.0, True)
    assert all(0 <= s <= 1 for _, s, _ in got.values())
    assert identify(docs.limit(0), fit(docs.limit(0), F.lit(True))).count() == 0
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
