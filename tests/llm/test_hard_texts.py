"""Texts that are hard for hashes and for bounded rows: colliding words, one word repeated, periods."""

import pytest

from .helpers import SCHEMA, frame


def thue_morse(n, a, b):
    bits = "0"
    while len(bits) < n:
        bits += bits.translate(str.maketrans("01", "10"))
    return bits[:n].replace("0", a).replace("1", b), bits[:n].replace("0", b).replace("1", a)


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_that_collide_in_polynomial_hashes(spark, n):
    from quillveil.llm.lm_score import lm_score
    from quillveil.llm.ngram_join import ngram_groups
    from quillveil.llm.substring_dedup import substring_dedup

    one, two = thue_morse(n, *("&", "u") if n == 512 else ("a", "b"))
    rest = [f"w{k}" for k in range(40)]
    long = frame(spark, [(k, " ".join([*rest[:20], w, *rest[20:]]), "en", "a") for k, w in enumerate((one, two))])
    assert {r.n_removed for r in substring_dedup(long).collect()} == {0}
    short = frame(spark, [(1, f"x {one} y", "en", "a"), (2, f"x {two} y", "en", "a"), (3, f"X {two.upper()} y", "en", "a")])
    assert {r.doc_id: r.component_id for r in ngram_groups(short, 3, 90).collect()} == {1: 1, 2: 2, 3: 2}
    from pyspark.sql import functions as F

    assert {r.doc_id: r.n_known for r in lm_score(short, F.col("doc_id") > 1).collect()} == {1: 4, 2: 3, 3: 3}


def test_decontamination_of_repeated_words(spark):
    from quillveil.llm.decontamination import overlaps

    rows = [(1, "the " * 9000, "en", "a"), (2, "a b " * 5000 + "last of all", "en", "a"), (3, "x " * 4090 + "p q r s t u v w", "en", "a"), (4, "one two three", "en", "a")]
    items = [(k, " ".join(["the"] * (20 + k))) for k in range(5)] + [(10, "a b " * 10), (11, "b a " * 3 + "last of all"), (12, "p q r s t u v w"), (13, "the"), (14, "x x x p q r")]
    ws = {i: t.split() for i, t, *_ in rows}
    want = {}
    for i, t in items:
        item = t.split()
        for d, w in ws.items():
            best = None
            for at in range(1 - len(item), len(w)):
                same = [0 <= at + k < len(w) and w[at + k] == x for k, x in enumerate(item)]
                window = max(sum(same[s : s + 13]) for s in range(max(1, len(same) - 12)))
                if window >= 10 or 10 * sum(same) >= 6 * len(same):
                    best = max(best or (0,), (sum(same), window, -at, len(same)))
            if best:
                want[d, i] = (best[0], best[1], -best[2])
    got = overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_matched, r.best_window, r["at"]) for r in got} == want and len(got) == len(want) > 8
    assert overlaps(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).count() == 0
