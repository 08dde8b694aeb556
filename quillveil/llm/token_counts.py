"""Exact token counts of every prefix of a text, by dynamic programming.

In byte-level BPE the tokens of a string less the last one are the tokens of what is left. So with the
last token of each prefix known, ``count(i) = count(i - its length) + 1``, and the last token of prefix i is
the one suffix that is a token of its own and whose pair with the last token before it stays apart when
encoded. Whether two tokens stay apart is asked of the library once a pair.

Texts fall into parts that encode alike alone and in the text. Each distinct part gets its table of counts once
and the tables are gathered for all texts together. White space at the end of a prefix is different: the
library takes the whole run there as one piece, so the counts along runs have tables of their own. A special
token counts 1 at its end; prefixes that end within it are ordinary text.

The table of a text holds the count at each of its bytes (within a character that at the character's end) as
differences: a byte for the width, then little-endian integers. Truncations and budgets are answered
from it without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, kept_by_worker, text_pieces
from .token_files import part_starts
from .words import overlapping_hashes, span_hashes

#: Bytes of the longest part that is known by its hash, and how many counts a worker keeps.
_LONGEST = 256
_CACHE = 8_000_000
_PAIRS = 2_000_000
_CHUNK = 1 << 20
#: White space of the library's pattern above ASCII, as UTF-8 (fixed values).
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), 0x20]] = True
_FIRST = np.zeros(256, bool)
_FIRST[[w[0] for w in _WIDE]] = True
#: Endings that the pattern takes as one piece (fixed values); cut short they are two.
_ENDINGS = (b"'re", b"'ve", b"'ll")
#: Parts that are surely one piece.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+)")


def _letters() -> dict[str, int]:
    """The byte for which each letter of the vocabulary stands: visible Latin-1 stands for itself, the others follow
    from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(sorted({*range(256)} - {*own}))}


def windows(buf: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the spans of ``n`` bytes from ``starts`` on, which may overlap; as ``span_hashes`` gives them."""
    if n == 1:
        one = span_hashes(np.arange(256, dtype=np.uint8), np.arange(256), np.arange(1, 257))
        return one[buf[starts]]
    return overlapping_hashes(buf, starts, n)


def blanks(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _BLANK[buf]
    for k in np.flatnonzero(_FIRST[buf]):
        for w in _WIDE:
            if buf[k : k + len(w)].tobytes() == w:
                out[k : k + len(w)] = True
                break
    return out


class Counter:
    """Tables of prefix counts, kept for distinct parts."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.model, self.pieces_of = self.tok.model, self.tok.pre_tokenizer.pre_tokenize_str
        vocab = self.tok.get_vocab(with_added_tokens=False)
        # tokens that encoding their own string gives
        self.ids = {t: i for t, i in vocab.items() if len(t) == 1 or len(self.model.tokenize(t)) == 1}
        self.names = {i: t for t, i in self.ids.items()}
        letters = _letters()
        raw = [bytes(map(letters.__getitem__, t)) for t in self.ids]
        bounds = np.cumsum([0, *map(len, raw)])
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], np.array([*self.ids.values()], np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.longest = max(map(len, self.ids))
        lengths: dict[str, set[int]] = {}
        for t in self.ids:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {end: sorted(n, reverse=True) for end, n in lengths.items() if len(end) == 2}
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in special)) if special else None
        self.clear()

    def clear(self) -> None:
        self.runs: dict[bytes, np.ndarray] = {}
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)

    def stay(self, a: str, b: str) -> bool:
        return [t.value for t in self.model.tokenize(a + b)] == [a, b]

    def pairs_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each token ``a`` and the token ``b`` after it are encoded as these two."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        if not known.all():
            new = np.unique(pair[~known])
            names = self.names
            got = [self.stay(names[x >> 32], names[x & 0xFFFFFFFF]) for x in new.tolist()]
            if len(self.pairs) > _PAIRS:
                self.pairs, self.apart = self.pairs[:0], self.apart[:0]
                return self.pairs_stay(a, b)
            into = np.searchsorted(self.pairs, new)
            self.pairs, self.apart = np.insert(self.pairs, into, new), np.insert(self.apart, into, got)
            at = np.searchsorted(self.pairs, pair)
        return self.apart[at]

    def prefixes(self, piece: str) -> np.ndarray:
        """Counts of all prefixes of one piece of the library's pattern, a letter for each byte."""
        count, last, ids = [0], [""], self.ids
        for i in range(1, len(piece) + 1):
            for n in (*self.lengths.get(piece[i - 2 : i], ()), 1):
                if n <= i and (t := piece[i - n : i]) in ids and (n == i or self.stay(last[i - n], t)):
                    count.append(count[i - n] + 1)
                    last.append(t)
                    break
        return np.array(count[1:], np.int32)

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of many pieces, and where each piece's begin: the same recurrence, by the
        length of the prefix for all pieces at once."""
        begin = np.cumsum([0, *map(len, pieces)])
        buf, size = np.frombuffer(b"".join(pieces), np.uint8), np.diff(begin)
        local = np.arange(len(buf)) - np.repeat(begin[:-1], size)
        ends, tokens, lens = [], [], []
        for n in range(1, min(self.longest, int(size.max(initial=0))) + 1):
            e = np.flatnonzero(local >= n - 1)
            h = windows(buf, e - n + 1, n)
            some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            e, h = e[some], h[some]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            ends.append(e[hit])
            tokens.append(self.by_hash[at[hit]])
            lens.append(np.full(int(hit.sum()), n))
        ends, tokens, lens = (np.concatenate(x) for x in (ends, tokens, lens))
        order = np.lexsort((-lens, ends, local[ends]))
        ends, tokens, lens = ends[order], tokens[order], lens[order]
        steps = np.searchsorted(local[ends], np.arange(int(size.max(initial=0)) + 1))
        count, last = np.zeros(len(buf), np.int32), np.zeros(len(buf), np.int64)
        for i, (lo, hi) in enumerate(zip(steps[:-1], steps[1:], strict=True)):
            k = lo + np.flatnonzero(np.append(True, ends[lo + 1 : hi] != ends[lo : hi - 1]))[: hi - lo]
            while len(k):  # the longest candidate of each prefix, then the next
                e, n = ends[k], lens[k]
                whole = n == i + 1
                ok = whole.copy()
                if not whole.all():
                    rest = np.flatnonzero(~whole)
                    ok[rest] = self.pairs_stay(last[e[rest] - n[rest]], tokens[k[rest]])
                done = e[ok]
                last[done] = tokens[k[ok]]
                count[done] = np.where(whole[ok], 0, count[done - n[ok]]) + 1
                k = k[~ok] + 1
        return count, begin

    def parts(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each part the counts of all prefixes, by bytes; those that end in white space are set elsewhere."""
        number: dict[bytes, int] = {}
        own = []
        for t in texts:
            if _PLAIN.fullmatch(t):
                own.append([(number.setdefault(t, len(number)), t)])
                continue
            mine, at = [], 0
            for piece, _ in self.pieces_of(t.decode()):
                raw = t[at : at + len(piece)]
                at += len(piece)
                mine.append((number.setdefault(raw, len(number)) if len(raw) <= _LONGEST else self.prefixes(piece), raw))
            own.append(mine)
        short = [t for t in number]
        count, begin = self.many(short) if short else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        out = []
        for mine in own:
            row, base = [], 0
            for k, raw in mine:
                table = count[begin[k] : begin[k + 1]] if isinstance(k, int) else k
                if raw in _ENDINGS:
                    table = np.array([1, 2, table[2]], np.int32)
                row.append(table + base if base else table)
                base += int(table[-1])
            out.append(row[0] if len(row) == 1 else np.concatenate(row))
        return out

    def run(self, raw: bytes) -> np.ndarray:
        if raw not in self.runs:
            got = self.prefixes("".join(p for p, _ in self.pieces_of(raw.decode())))
            if len(raw) > _LONGEST:
                return got
            self.runs[raw] = got
        return self.runs[raw]

    def keep(self, flat: np.ndarray) -> int:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def tables(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The count at the end of each byte's prefix, from the last of ``bounds`` on (no special tokens)."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64)
        if self.used > _CACHE:
            self.clear()
        raw, starts = buf.tobytes(), part_starts(buf, bounds)
        ends = np.append(starts[1:], n)
        size = ends - starts
        far = size > _LONGEST
        at = np.zeros(len(starts), np.int64)
        u, first, back = np.unique(span_hashes(buf, starts, ends)[~far], return_index=True, return_inverse=True)
        first = np.flatnonzero(~far)[first]
        place = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            found = self.parts([raw[starts[k] : ends[k]] for k in first[new]])
            where = np.cumsum([0, *map(len, found)])
            where = where[:-1] + self.keep(np.concatenate(found))
            into = np.searchsorted(self.keys, u[new])
            self.keys, self.at = np.insert(self.keys, into, u[new]), np.insert(self.at, into, where)
            place = np.searchsorted(self.keys, u)
        at[~far] = self.at[place][back]
        used = self.used
        for k in np.flatnonzero(far):
            at[k] = self.keep(self.parts([raw[starts[k] : ends[k]]])[0])
        total = self.pool[at + size - 1].astype(np.int64)
        base = np.cumsum(total) - total
        of_text = np.searchsorted(bounds, starts, side="right") - 1  # the last of equal bounds: empty texts have no parts
        head = np.searchsorted(starts, bounds[:-1])
        base -= np.append(base, 0)[head][of_text]
        out = self.pool[np.repeat(at - starts, size) + np.arange(n)] + np.repeat(base, size)
        self.used = used
        blank = blanks(buf)
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[bounds[:-1][np.diff(bounds) > 0]] |= blank[bounds[:-1][np.diff(bounds) > 0]]
        s = np.flatnonzero(begin)
        if len(s):
            stop = blank & np.append(~blank[1:] | begin[1:], True)
            e = np.flatnonzero(stop) + 1
            fresh = np.isin(s, bounds)
            before = np.where(fresh, 0, out[s - 1])
            one = e - s == 1
            out[s[one]] = before[one] + 1
            for k in np.flatnonzero(~one):
                out[s[k] : e[k]] = before[k] + self.run(raw[s[k] : e[k]])
        ahead = np.append((buf[1:] & 0xC0) == 0x80, False)  # the character goes on
        if ahead.any():
            end = np.where(ahead, n, np.arange(n))
            out = out[np.minimum.accumulate(end[::-1])[::-1]]
        return out


def _chunks(buf: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a long text at a space between visible ASCII characters, where counts simply add."""
    i, n = 0, len(buf)
    while n - i > limit:
        k, j = i + limit, n
        while k + 1 < n:
            part = buf[k - 1 : k + (1 << 16) + 1]
            good = np.flatnonzero((part[:-2] > 0x20) & (part[:-2] < 0x7F) & (part[1:-1] == 0x20) & (part[2:] > 0x20) & (part[2:] < 0x7F))
            if len(good):
                j = k + int(good[0])
                break
            k += 1 << 16
        yield i, j
        i = j
    if n > i:
        yield i, n


def packed(deltas: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(deltas) or max(-int(deltas.min()), int(deltas.max())) < 1 << (8 * w - 1))
    return bytes([width]) + deltas.astype(f"<i{width}").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    """The counts at all bytes of a text."""
    return np.cumsum(np.frombuffer(blob, f"<i{blob[0]}", offset=1), dtype=np.int64) if len(blob) > 1 else np.zeros(0, np.int64)


def text_counts(counter: Counter, buf: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Counts at all bytes of each text, special tokens included."""
    raw = buf.tobytes()
    marks = np.array([m.span() for m in counter.special.finditer(raw)] if counter.special else [], np.int64).reshape(-1, 2)
    # a mark over a border of texts is none
    marks = marks[np.searchsorted(bounds, marks[:, 0], side="right") == np.searchsorted(bounds, marks[:, 1], side="left")]
    cuts = np.unique(np.concatenate([bounds, marks[:, 1]]))
    out = np.zeros(len(buf), np.int64)
    if len(buf) <= 2 * _CHUNK:
        borders = cuts
        out[:] = counter.tables(buf, cuts)
    else:
        pieces = [(i + a, i + b) for i, j in zip(cuts[:-1], cuts[1:], strict=True) for a, b in _chunks(buf[i:j], _CHUNK)]
        borders = np.array([0, *(j for _, j in pieces)], np.int64)
        for i, j in pieces:
            out[i:j] = counter.tables(buf[i:j], np.array([0, j - i]))
    s, e = marks[:, 0], marks[:, 1]  # at its end the token stands after what came before it
    out[e - 1] = np.where(np.isin(s, borders), 0, out[s - 1]) + 1
    ends = borders[1:] - 1  # each stretch goes on from the end of the one before, unless a text begins
    if len(borders) > 1:
        totals, fresh = out[ends], np.isin(borders[:-1], bounds)
        run = np.cumsum(totals) - totals
        run -= np.maximum.accumulate(np.where(fresh, run, 0))
        out += np.repeat(run, np.diff(borders))
    return np.split(out, bounds[1:-1])


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The exact number of tokens of every prefix of each whole text, for byte-level BPE in a tokenizers file.

    Counts are those of ``encode(prefix, add_special_tokens=False)``; special strings in a text are special
    tokens. A null text is empty; an empty one has an empty table. Long texts are handled in chunks that are cut
    where counts add; the table has one byte for each byte of text. Repeated rows and ids are rows of their own, a
    null id stays null, other columns are not read, an empty table gives none.

    Returns ``id_col``, n_bytes, n_tokens (long), counts (binary, see ``unpacked``).
    """

    def run(batches):
        kept = kept_by_worker(f"counts {tokenizer_path}")
        if "counter" not in kept:
            kept["counter"] = Counter(tokenizer_path)
        for b in batches:
            for i, j, buf, bounds in text_pieces(b.column(1), _CHUNK):
                tables = text_counts(kept["counter"], buf, bounds)
                totals = np.array([t[-1] if len(t) else 0 for t in tables], np.int64)
                yield batch(["doc_id", "n_bytes", "n_tokens", "counts"], [b.column(0).slice(i, j - i), np.diff(bounds), totals, pa.array([packed(np.diff(t, prepend=0)) for t in tables], pa.binary())])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, counts binary").withColumnRenamed("doc_id", id_col)


def within_budget(counts: DataFrame, limit: int) -> DataFrame:
    """The columns of ``prefix_counts`` less the tables, with over_limit (boolean) and bytes_within (long): the
    most bytes of a prefix of at most ``limit`` tokens, from the stored tables alone. No character is cut in two.
    A null table gives null."""

    def run(batches):
        for b in batches:
            most = []
            for blob in b.column(3).to_pylist():
                table = unpacked(blob) if blob is not None else None
                fits = None if table is None else np.flatnonzero(table <= limit)
                most.append(None if fits is None else int(fits[-1]) + 1 if len(fits) else 0)
            yield batch(["id", "n_bytes", "n_tokens", "bytes_within"], [b.column(0), b.column(1), b.column(2), pa.array(most, pa.int64())])

    id_col = counts.columns[0]
    out = counts.select(F.col(id_col).alias("id"), "n_bytes", "n_tokens", "counts").mapInArrow(run, "id long, n_bytes long, n_tokens long, bytes_within long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "bytes_within")
