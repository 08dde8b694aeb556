"""What retrieved contexts tell of an entity's fields, and prompts made from them within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def padded(ws: Column) -> Column:
    """Words with one space around each, so that a padded phrase stands in a padded text word by word."""
    return F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))


def recovered_fields(top: DataFrame, fields: DataFrame, texts: DataFrame, entity: str, doc: str) -> DataFrame:
    """(entity, field, exact_docs, coarse_docs): in how many of an entity's contexts its fields are told.

    ``top`` has (entity, doc), ``fields`` (entity, field, exact, coarse) with arrays of words, ``texts`` (doc, words). An exact
    value tells the coarse one too; an empty value is told nowhere. An entity's fields go to the texts of its contexts, so the
    work follows these, and nothing is collected or broadcast.
    """
    value = lambda c: F.when(F.size(c) > 0, padded(F.col(c))).alias(c)
    asked = fields.groupBy(entity).agg(F.collect_list(F.struct("field", value("exact"), value("coarse"))).alias("_f"))
    pairs = top.select(entity, doc).join(asked, entity).join(texts.select(doc, padded(F.col("words")).alias("_text")), doc)
    held = lambda c: F.coalesce(F.contains("_text", c), F.lit(False))
    told = lambda f: F.struct(f["field"].alias("field"), held(f["exact"]).alias("has_exact"), held(f["coarse"]).alias("has_coarse"))
    both = pairs.select(entity, F.inline(F.transform("_f", told)))
    return both.groupBy(entity, "field").agg(F.count_if("has_exact").alias("exact_docs"), F.count_if(F.col("has_exact") | F.col("has_coarse")).alias("coarse_docs"))


def field_sets(recovered: DataFrame, entity: str) -> DataFrame:
    """(entity, exact, only_coarse, lost): the fields of each entity as sorted arrays, by how they are told."""
    kind = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("field"))))
    exact, coarse = F.col("exact_docs") > 0, F.col("coarse_docs") > 0
    return recovered.groupBy(entity).agg(kind(exact).alias("exact"), kind(coarse & ~exact).alias("only_coarse"), kind(~coarse).alias("lost"))


def budgeted(parts: Column, budget: int) -> Column:
    """The parts (array of strings, in order) that fit: each is taken if the lengths taken so far and its own are
    ``budget`` at most, and the first that doesn't fit ends the list."""
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(acc: Column, part: Column) -> Column:
        fits = ~acc["full"] & (acc["used"] + F.length(part) <= budget)
        return F.when(fits, F.struct(F.array_append(acc["taken"], part).alias("taken"), (acc["used"] + F.length(part)).alias("used"), F.lit(False).alias("full"))).otherwise(F.struct(acc["taken"].alias("taken"), acc["used"].alias("used"), F.lit(True).alias("full")))

    return F.aggregate(parts, start, add, lambda acc: acc["taken"])


def call_key(*parts: Column) -> Column:
    """A canonical key of a call: SHA-256 of all that it depends on, joined by a control character that texts lack."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)
