"""Hard negatives, periodic runs and token counts against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .helpers import SCHEMA, documents, frame, words

VECTORS = "vec_id long, label int, embedding array<double>, key long, cell int, id long, v string, score long, block long"


def brute_negatives(rows, anchors, low=30, high=90):
    """Rows (id, label, integers) against all others; copies are rows of their own."""
    out = Counter()
    for a, (i, label, x) in enumerate(rows):
        if not anchors(i):
            continue
        score = [sum(p * q for p, q in zip(x, y, strict=True)) for _, _, y in rows]
        same = sorted((-score[b], r[0], b) for b, r in enumerate(rows) if b != a and r[1] == label)[:5]
        for s, pid, _ in same:
            others = sorted((-score[b], r[0]) for b, r in enumerate(rows) if r[1] != label and low * -s <= 100 * score[b] <= high * -s)[:10]
            out.update((i, pid, k + 1, n, -s, -t) for k, (t, n) in enumerate(others))
    return out


@pytest.mark.parametrize("sizes", [(512, 2048, 128), (4, 16, 5)])
def test_hard_negatives(spark, sizes):
    from quillveil.llm.hard_negatives import hard_negatives

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = [(k, int(rng.integers(0, 3)), (centres[k % 4] + 0.3 * rng.normal(size=6)).tolist()) for k in range(150)]
    rows += [(200 + k, k % 2, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for k in range(30)]  # ties
    rows += [(10, 1, rows[10][2]), (20, rows[20][1], rows[20][2]), (-30, 2, rows[5][2]), (300, 1, [0.0] * 6), (310, 0, []), (320, 2, [0.3, -0.2])]
    left_out = [(None, 1, rows[0][2]), (400, None, rows[0][2]), (410, 1, None), (420, 1, [0.1, None, 0.0, 0.0]), (430, 1, [0.1, float("nan"), 0.0]), (440, 1, [float("inf"), 0.0]), (450, 1, [1e200, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5) for r in rows + left_out], VECTORS).repartition(3)
    together, block, window = sizes
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, together=together, block=block, window=window)
    pad = lambda v: [int(np.floor(256 * c)) for c in v] + [0] * (6 - len(v))
    want = brute_negatives([(i, label, pad(v)) for i, label, v in rows], lambda i: i % 10 == 0)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 200
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0


def test_score_bounds_hold():
    from quillveil.llm.hard_negatives import angles_to, bounds, directions, scores

    rng = np.random.default_rng(1)
    for spread in (0.05, 1.0):
        x = np.floor(256 * (rng.normal(size=(3, 1, 16)) + spread * rng.normal(size=(3, 40, 16)))).reshape(-1, 16)
        x[7], x[8] = 0, x[9]
        refs, norms = directions(x, 5), np.linalg.norm(x, axis=1)
        angles = angles_to(x, norms, refs)
        at = np.arange(0, 120, 10)
        low, high, least, most = (f.reduceat(v, at) for f, v in ((np.minimum, angles), (np.maximum, angles), (np.minimum, norms), (np.maximum, norms)))
        down, up = bounds(norms, angles, low, high, least, most)
        s = scores(x.astype(int), x.astype(int)).reshape(120, 12, 10)
        assert (down <= s.min(axis=2)).all() and (s.max(axis=2) <= up).all()
        if spread < 1:  # windows within a cluster are told apart from other clusters
            assert (up < s.max()).mean() > 0.3


def brute_runs(x, exponent=4, least=6):
    out = {}
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        t = []
        for _ in range(rng.randrange(6)):
            unit = [rng.randrange(rng.choice([1, 2, 5, 50])) for _ in range(rng.randrange(1, 12))]
            t += (unit * 9)[: rng.randrange(9 * len(unit) + 1)] if rng.random() < 0.6 else [rng.randrange(3) for _ in range(rng.randrange(30))]
        yield t


def test_grammar_finds_every_run(monkeypatch):
    from quillveil.llm import periodic_runs as module

    for together in (1 << 20, 7):
        monkeypatch.setattr(module, "_TOGETHER", together)
        texts = [*periodic_texts(together, 150), [0] * 4000, [0, 1] * 1500 + [1, 1]]
        first = np.cumsum([0, *map(len, texts)])
        for exponent in (2, 3, 4):
            got = module.runs_of(np.array([w for t in texts for w in t], np.uint64), first, exponent)
            assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t, exponent)]


def test_extensions_match_word_by_word():
    from quillveil.llm.periodic_runs import Grammar

    x = np.array([w for t in periodic_texts(5, 60) for w in [99, *t]])
    n = len(x)
    sym = np.concatenate([[1000], x, [1001]])
    fixed = np.zeros(n + 2, bool)
    fixed[[0, -1]] = True
    grammar, rng = Grammar(sym, fixed), np.random.default_rng(0)
    i = rng.integers(1, n, 400)
    j = np.array([rng.choice(np.flatnonzero(sym == sym[k])) for k in i])
    i, j = i[i != j], j[i != j]
    for ahead in (1, -1):
        for a, b, got in zip(i, j, grammar.extend(i, j, ahead), strict=True):
            want = next(k for k in range(n + 2) if sym[a + ahead * k] != sym[b + ahead * k])
            assert got == want


def test_periodic_runs(spark):
    from quillveil.llm.periodic_runs import periodic_runs, planted, run_digest

    rows = documents() + [(500 + k, " ".join(f"t{w}" for w in t), "en", "a") for k, t in enumerate(periodic_texts(9, 40))]
    rows += [(600, "la " * 30000 + "di " * 5, "en", "a"), (601, "the  cat\n" * 5, "en", "a")]
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = [(0, 30000, 1)] if i == 600 else brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = min(((-n, s, q) for s, n, q in runs), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i, len(runs), *((top[1], -top[0], top[2], -1000 * top[0] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert zlib.crc32(b"600") % 10
    got = run_digest(periodic_runs(planted(frame(spark, rows)))).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_runs > 0 for r in got) > 20
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


NASTY = [*"ab'sd tT9\n\t  ,.!-_…é«»", " ", "　", " ", "\x1c", "\x85", " the", "\r\n", "<|endoftext|>", "漢", "😀", "'re", "'ll", " hello", "    ", "----", "ing"]


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_every_prefix_is_counted(monkeypatch, chunk):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillveil.llm import token_counts as module
    from quillveil.llm.common import text_pieces

    monkeypatch.setattr(module, "_CHUNK", chunk)
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(chunk)
    tok, counter = Tokenizer.from_file(path), module.Counter(path)
    texts = ["".join(rng.choice(NASTY) for _ in range(rng.randrange(60 if chunk > 64 else 300))) for _ in range(800 if chunk > 64 else 60)] + [None, "", "  ", "<|endoftext|>", "x" * 700 + " y", "\n" * 300 + "a"]
    for i, j, buf, bounds in text_pieces(pa.array(texts)):
        for text, table in zip(texts[i:j], module.text_counts(counter, buf, bounds), strict=True):
            text = text or ""
            at = np.cumsum([len(c.encode()) for c in text]).astype(int) - 1
            want = [len(e.ids) for e in tok.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)]
            assert table[at].tolist() == want
            assert (module.unpacked(module.packed(np.diff(table, prepend=0))) == table).all()


def test_white_space_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillveil.llm.token_counts import blanks

    pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    for c in (x for x in range(0x3100) if not 0xD800 <= x < 0xE000):
        raw = np.frombuffer(chr(c).encode(), np.uint8)
        assert blanks(raw).all() == blanks(raw).any() == all(len(pieces(x + chr(c))) == 2 for x in "a1!"), hex(c)


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillveil.llm.token_counts import prefix_counts, within_budget

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8)
    tok = Tokenizer.from_file(path)
    rows = documents() + [(700 + k, "".join(rng.choice(NASTY) for _ in range(200)), "en", "a") for k in range(20)] + [(800, " ".join(rng.choice(["word", "other", "x1,"]) for _ in range(500_000)), "en", "a")]
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        most = len(t) if n <= 12 else max((k for k in range(80) if len(tok.encode(t[:k], add_special_tokens=False).ids) <= 12), default=0)
        want[i, len(t.encode()), n, n > 12, len(t[:most].encode())] += 1
    got = within_budget(prefix_counts(frame(spark, rows), path), 12)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.bytes_within) for r in got.collect()) == want
    assert prefix_counts(spark.createDataFrame([], SCHEMA), path).count() == 0
