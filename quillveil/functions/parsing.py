"""Lenient parsing of model answers and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_json(text: Column) -> Column:
    """The JSON in a model's answer: the text without a code fence if that parses, else the longest
    braced or bracketed part that parses; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    parsed = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(parsed(bare), parsed(F.nullif(inner, F.lit(""))))


def boolish(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "y", "1"), True).when(t.isin("false", "no", "n", "0"), False)


def safe_double(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def canonical_json(**fields: Column) -> Column:
    """One-level JSON text with sorted keys and a space after separators."""
    parts = [F.concat(F.lit(f'"{k}": '), F.to_json(F.array(fields[k])).substr(F.lit(2), F.length(F.to_json(F.array(fields[k]))) - 2)) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def cache_key(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields).cast("binary"), 256)


def ranked_ids(answer: Column) -> Column:
    """Candidate ids of an answer {top_candidate, ranked: [id or {candidate_id, score}, ...]}; a first
    choice that the list lacks goes to its front."""
    raw = F.from_json(F.get_json_object(answer, "$.ranked"), "array<string>")
    ids = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.coalesce(F.get_json_object(x, "$.candidate_id"), x))
    top = F.get_json_object(answer, "$.top_candidate")
    return F.when(top.isNotNull() & ~F.array_contains(ids, F.coalesce(top, F.lit(""))), F.concat(F.array(top), ids)).otherwise(ids)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
