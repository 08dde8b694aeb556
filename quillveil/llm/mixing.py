"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every row of a source needs the same fractional number of copies. The whole part is certain; the
fractions are rounded together: two units meet, and one passes expected words to the other, in a
direction drawn so that no expectation changes, until the probability of one of them is 0 or 1 and
settled. The expected words of the source never change on the way. Units meet from the largest to the
smallest, so that what stays unsettled is small. Blocks of bounded size do this side by side; each
leaves at most one unsettled unit, and these meet in the next level of the tree, until a source has
one unit left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch

_ROWS = 1 << 16
_UNIT = "struct<size:bigint,h:bigint,id:bigint>"


def targets(totals: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Add weight and target to (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last. ``share`` of all sizes goes by weight; a
    target stops at ``most`` times its source's size and the excess is shared again, which ends where
    target = least(cap, level * weight) for one level. The table has one row per source, so its windows
    run in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest)
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)["level"]
    return t.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), "cap"))).select("source", "source_size", "weight", "target")


def _settle(units: str, level: int) -> str:
    """SQL that folds an array of units with probabilities into settled units and at most one open one."""
    u = f"(pmod(xxhash64(acc.u.h, x.u.h, acc.u.id, x.u.id, {level}), 1000000007L) + 0.5D) / 1000000007D"
    # words that can pass up to the open unit and down from it
    moves = "named_struct('up', least((1D - acc.p) * acc.u.size, x.p * x.u.size), 'down', least(acc.p * acc.u.size, (1D - x.p) * x.u.size))"
    words = f"transform(array({moves}), m -> if({u} * (m.up + m.down) < m.down, m.up, -m.down))[0]"
    after = f"transform(array({words}), w -> named_struct('a', acc.p + w / acc.u.size, 'x', x.p - w / x.u.size))[0]"
    done = lambda unit, p: f"if({p} < 1e-9D or {p} > 1D - 1e-9D, array(named_struct('u', {unit}, 'copy', if({p} < 0.5D, 0, 1))), array())"
    kind = f"struct<u:{_UNIT},p:double,done:array<struct<u:{_UNIT},copy:int>>>"
    met = f"""transform(array({after}), n -> cast(named_struct(
      'u', if(n.a < 1e-9D or n.a > 1D - 1e-9D, x.u, acc.u),
      'p', if(n.a < 1e-9D or n.a > 1D - 1e-9D, if(n.x < 1e-9D or n.x > 1D - 1e-9D, -1D, n.x), n.a),
      'done', concat(acc.done, {done("acc.u", "n.a")}, {done("x.u", "n.x")})) as {kind}))[0]"""
    step = f"if(acc.p < 0D, cast(named_struct('u', x.u, 'p', x.p, 'done', acc.done) as {kind}), {met})"
    return f"aggregate({units}, cast(named_struct('u', null, 'p', -1D, 'done', array()) as {kind}), (acc, x) -> {step})"


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), block: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each row.

    A row's size is its number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0); see ``targets`` for the sources'
    targets. A null source is a source of its own. Rows of a source without words are not taken. All
    choices hash the ids and sizes, so reruns agree. Repeated rows (same id, source and size) are
    exchangeable: together they get their expected copies, rounded as those of one unit. Other columns are not read.

    Returns one row per input row: ``id_col``, source, size, source_size (long), target (double), copies,
    taken (long, copies * size). ``copies`` differs from target / source_size by less than 1.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # equal rows are one unit, however many they are
    sized = scratch(sized.groupBy("id", "source", "size").agg(F.count("*").alias("times")), "sized")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n"))
    goals = targets(sources.select("source", "source_size"), share, most, weights).withColumnRenamed("source", "s")
    plan = scratch(sources.select("source", "n").join(goals, F.col("source").eqNullSafe(F.col("s"))).select("source", "n", "source_size", "target"), "targets")
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor(F.col("rate") + 1e-9))
    rows = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("h", F.xxhash64("id", "size", "source"))
    rows = rows.withColumn("due", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("times")).withColumn("sure", F.floor(F.col("due") + 1e-9)).withColumn("p", F.greatest(F.col("due") - F.col("sure"), F.lit(0.0)))
    drawn = lambda h, p: F.when(F.pmod(F.xxhash64(h, F.lit(0)), F.lit(1000000007)) < p * 1000000007, 1).otherwise(0)
    certain = rows.where("p < 1e-9 or size = 0").select("id", "source", "size", F.when(F.col("p") < 1e-9, 0).otherwise(drawn(F.col("h"), F.col("p"))).alias("copy"))
    unit = F.struct("size", "h", "id")
    open_ = rows.where("p >= 1e-9 and size > 0").select("source", "n", F.struct(unit.alias("u"), "p").alias("x"))
    settled, level = [], 0
    while True:
        level += 1
        bucket = F.pmod(F.xxhash64(F.col("x.u.h"), F.lit(level)), F.ceil(F.col("n") / block))
        folded = open_.groupBy("source", bucket.alias("bucket")).agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs")).select("source", F.expr(_settle("xs", level)).alias("r"))
        folded = scratch(folded, "folded")
        settled.append(folded.select("source", F.explode("r.done").alias("d")).select("d.u.id", "source", "d.u.size", "d.copy"))
        left = folded.where("r.p >= 0").select("source", F.struct("r.u", "r.p").alias("x"))
        sizes = left.groupBy("source").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        open_ = left.join(sizes.toDF("s", "n"), F.col("source").eqNullSafe(F.col("s"))).select("source", "n", "x")
    last = left.select("x.u.id", "source", "x.u.size", drawn(F.col("x.u.h"), F.col("x.p")).alias("copy"))  # one unit of a source
    for part in [*settled, last]:
        certain = certain.union(part)
    key = lambda side: F.struct(*[F.coalesce(F.col(f"{side}.{c}"), F.lit(z)) for c, z in (("id", 0), ("source", ""), ("size", 0))], F.col(f"{side}.id").isNull(), F.col(f"{side}.source").isNull())
    both = rows.alias("a").join(certain.alias("b"), key("a") == key("b")).select("a.id", "a.source", "a.size", "a.times", "a.sure", "a.whole", "a.source_size", "a.target", "b.copy")
    # rows of a large group are made in many tasks
    parts = both.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / _ROWS))))
    parts = parts.where(f"times <= {_ROWS}").union(parts.where(f"times > {_ROWS}").repartition("id", "part"))
    out = parts.withColumn("nth", F.explode(F.sequence(F.col("part") * _ROWS + 1, F.least(F.col("times"), (F.col("part") + 1) * _ROWS))))
    copies = (F.col("whole") + F.when(F.col("nth") <= F.col("sure") + F.col("copy"), 1).otherwise(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
