"""Text expressions: tokens, n-grams, phrase tests, rewriting, spans."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns. TOKEN is anchored at word boundaries, so ``[NAME]`` gives ``NAME``; PORTABLE is the
#: form without boundaries that other engines read alike.
TOKEN = r"(?U)\b[\w\[\]_-]+\b"
PORTABLE = r"[\p{L}\p{N}_\[\]-]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\([0-9]{3}\) 555-[0-9]{4}"
ACCOUNT = r"ACCT-[0-9]+"
PLACEHOLDER = r"\[[A-Z_]+\]"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-case tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def word_ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n words; none if there are fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.filter(F.transform(at, lambda i: F.when(F.size(words) >= n, F.array_join(F.slice(words, i, n), " "))), lambda x: x.isNotNull())


def word_ngrams_upto(words: Column, most: int) -> Column:
    return F.concat(*[word_ngrams(words, n) for n in range(1, most + 1)])


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams inside white-space words, each padded by one space on both sides; a padded word
    shorter than n is one n-gram."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
    return F.flatten(grams)


def space_words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def runs_of(words: list[str]) -> Iterable[str]:
    """In Python: all space-joined runs of one to three words."""
    return chain(words, map(" ".join, zip(words, words[1:])), map(" ".join, zip(words, words[1:], words[2:])))


@lru_cache(100_000)
def _char_runs(word: str) -> tuple[str, ...]:
    w = f" {word} "
    return tuple(w[i : i + n] for n in (3, 4, 5) for i in range(max(len(w) - n + 1, 1)))


def char_runs_of(words: list[str]) -> Iterable[str]:
    """In Python: ``char_ngrams`` of three to five characters of words that are split and in lower case."""
    return chain.from_iterable(map(_char_runs, words))


def squeeze(text: Column) -> Column:
    """Lower case, trimmed, white space runs as one space."""
    return F.regexp_replace(F.trim(F.lower(text)), r"(?U)\s+", " ")


def quoted(pattern: Column) -> Column:
    """A literal inside a Java regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def phrase_in_text(text: Column, phrase: Column) -> Column:
    """Does the phrase occur between word boundaries? Both are squeezed; an empty phrase never does."""
    p = squeeze(phrase)
    return (p != "") & F.coalesce(F.regexp_like(squeeze(text), F.concat(F.lit("(?U)(?<!\\w)"), quoted(p), F.lit("(?!\\w)"))), F.lit(False))


def replace_ordered(text: Column, replacements: Column) -> Column:
    """Apply replacements (array of struct src, dst) one after the other, longest source first.

    Sources match in any case, anywhere; empty ones are skipped. Later replacements also see the
    output of earlier ones. Equal lengths keep their order.
    """
    numbered = F.transform(replacements, lambda r, i: F.struct((-F.length(r["src"])).alias("n"), i.alias("i"), r["src"].alias("src"), r["dst"].alias("dst")))
    ordered = F.array_sort(F.filter(numbered, lambda r: F.coalesce(r["src"], F.lit("")) != ""))
    safe = lambda d: F.replace(F.replace(d, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.aggregate(ordered, text, lambda acc, r: F.regexp_replace(acc, F.concat(F.lit("(?iu)"), quoted(r["src"])), safe(r["dst"])))


class _Fold(dict):
    """A character as (?iu) compares it: the lower case of its upper case, where these are one character."""

    def __missing__(self, code: int) -> int:
        up = chr(code).upper()
        low = "i" if up == "\u0130" else (up if len(up) == 1 else chr(code)).lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_fold = _Fold()


def _folded(text: str) -> str:
    """Of the text's length."""
    return text.lower() if text.isascii() else text.translate(_fold)


def _replaced(text: str, low: str, pairs: Iterable[tuple[str, str | None]]) -> str | None:
    """The pairs (folded source, replacement) one after the other; ``low`` is the folded text."""
    for src, dst in pairs:
        at = low.find(src)
        if at < 0:
            continue
        if dst is None:
            return None
        parts, last = [], 0
        while at >= 0:
            parts += (text[last:at], dst)
            last = at + len(src)
            at = low.find(src, last)
        text = "".join([*parts, text[last:]])
        low = _folded(text)
    return text


def replace_each(bases: list[Column], lists: list[tuple[int, Column]]) -> Column:
    """One text for each list of replacements, as ``replace_ordered`` makes it from the base with the list's number.

    Sources are sought in folded texts without compiling patterns, in Arrow batches.
    """
    which = [k for k, _ in lists]

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, replacements: pa.Array) -> pa.Array:
        out = []
        pairs = replacements.flatten().flatten()
        sizes, starts = replacements.flatten().value_lengths().to_pylist(), replacements.value_lengths().to_pylist()
        src, dst = pairs.field("src").to_pylist(), pairs.field("dst").to_pylist()
        at = nth = 0
        for own, n in zip(texts.to_pylist(), starts, strict=True):
            low, made = [t and _folded(t) for t in own], []
            for k, size in zip(which, sizes[nth : nth + n], strict=True):
                known = sorted((p for p in zip(src[at : at + size], dst[at : at + size], strict=True) if p[0]), key=lambda p: -len(p[0]))
                made.append(own[k] and _replaced(own[k], low[k], [(_folded(s), d) for s, d in known]))
                at += size
            nth += n
            out.append(made)
        return pa.array(out, pa.list_(pa.string()))

    return run(F.array(*bases), F.array(*[r for _, r in lists]))


def merge_spans(spans: Column, mixed: str = "[MIXED]") -> Column:
    """Merge overlapping spans (array of struct start, end, label); touching ones stay apart.

    Spans are taken by start, longest first. Merged spans with different labels get ``mixed``.
    """
    kind = "array<struct<start:int,end:int,label:string>>"
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["end"]).cast("int").alias("back"), s["label"].alias("label")))), lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["label"].alias("label")))

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.when(last["label"] == s["label"], s["label"]).otherwise(mixed).alias("label"))
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined)).cast(kind)).otherwise(F.concat(acc, F.array(s)).cast(kind))

    return F.aggregate(ordered, F.array().cast(kind), lambda acc, s: F.when(F.size(acc) == 0, F.array(s).cast(kind)).otherwise(add(acc, s)))


def splice(text: Column, spans: Column) -> Column:
    """Replace merged spans (0-based, end exclusive) by their labels."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"]).alias("out"), s["end"].cast("int").alias("at"))

    return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def body_text(text: Column, banned: tuple[str, ...] = ("contact", "identity line", "profile contact")) -> Column:
    """Trimmed lines without blank ones, subject lines and lines that name an identity."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def keep(line: Column) -> Column:
        low = F.lower(line)
        ok = (line != "") & ~low.startswith("subject:")
        for b in banned:
            ok &= ~low.contains(b)
        return ok

    return F.array_join(F.filter(lines, keep), "\n")


def placeholder_rate(text: Column) -> Column:
    """Bracketed upper-case placeholders per white-space word."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.size(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))) / F.greatest(words, F.lit(1))


def with_article(phrase: Column) -> Column:
    return F.concat(F.when(F.lower(F.substring(phrase, 1, 1)).isin(*"aeiou"), "an ").otherwise("a "), phrase)


def rotating_choice(values: Column, index: Column, offset: int = 0) -> Column:
    return F.element_at(values, (F.pmod(index + offset, F.size(values)) + 1).cast("int"))


def tie_break(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts joined by colons: its first 12 hex digits."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def pseudonym(prefix: str, key: Column) -> Column:
    """A pseudonym that only holds within one document: prefix and six hex digits of the key's SHA-1."""
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 6)))


def contains_rate(text: Column, phrases: list[str]) -> Column:
    """1.0 if any of the phrases occurs as a substring."""
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p)).cast("double")
