"""Token counts by prefix dynamic programming, for a BPE vocabulary with word ends (tokenizers .json).

For a text the table holds, at the end of every unit (a pre-token, or a special string where the library
takes such strings as tokens), the exact number of tokens of the prefix that ends there: the recurrence
adds to the previous entry the tokens of one more unit. Inside a unit the prefix counts follow from the
unit's own table: n[j] is the count of its first j symbols when more symbols follow, and the last token
of those is the only one that (a) ends at j and (b) stays apart from the last token before it when the
two are merged by rank; the count of a prefix that ends there adds one closing token, found alike.
So a budget or a truncation needs a search in the table and at most one unit's table, and no text is
encoded again: prefix_tables() gives the tables as columns, and budgets are answered from these alone. Positions are code points of the normalised text (NFC and lower case, white space kept as is;
special strings as they are), and the count of a prefix is what the library gives for that prefix.
"""

from __future__ import annotations

import json
import os
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Splitter, in_arrow, texts

#: Distinct units whose counts a worker remembers, at least those met last; the others are counted anew.
REMEMBERED = 500_000
_counters: dict = {}


def _symbols() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Counts(dict):
    """Counts of units, each found when it is first asked for. Two generations: a full one is kept until the next is full."""

    def __init__(self, count):
        self.count, self.old = count, {}

    def __missing__(self, unit: str) -> int:
        n = self.old.get(unit)
        if n is None:
            n = self.count(unit)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[unit] = n
        return n


class Counter:
    """Prefix counts by one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError("unsupported pre-tokenizer")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if [k for k in kinds if k != "Replace"] != ["NFC", "Lowercase"] or any(x["pattern"] != {"Regex": "\\s+"} for x in spec["normalizer"]["normalizers"] if x["type"] == "Replace"):
            raise ValueError("unsupported normalizer")
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("unsupported added token")
        self.library = Tokenizer.from_file(path)
        self.split = Splitter(steps[0]["pattern"]["Regex"])
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.mark = os.path.commonprefix(special)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.longest = max(map(len, spec["model"]["vocab"]))  # of a token, in symbols
        self.vocab, self.known = spec["model"]["vocab"], _Counts(self.unit_count)
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.symbol = _symbols()
        self.bytes_to_symbols = {b: self.symbol[b] for b in range(256)}
        self.tokenize = self.library.model.tokenize
        self.merged = lru_cache(1 << 16)(self._merged)

    # whole units

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # str.lower() would look at the letters around a sigma
            return "".join(c.lower() if c != "Σ" else "σ" for c in text)
        return text.lower()

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, text): special strings are found in the raw text, the rest is normalised."""
        at = 0
        for m in self.special.finditer(text) if self.special and self.mark in text else ():
            if m.start() > at:
                yield False, self.normalise(text[at : m.start()])
            yield True, m[0]
            at = m.end()
        if at < len(text) or not text:
            yield False, self.normalise(text[at:])

    def unit_count(self, unit: str) -> int:
        """The library's tokens of a whole unit."""
        if not (unit.isascii() and unit.isalnum()):
            unit = unit.encode("utf-8", "replace").decode("latin-1").translate(self.bytes_to_symbols)
        return len(self.tokenize(unit))

    def table(self, units: list[str]) -> np.ndarray:
        """The recurrence over units: each entry is the one before and the tokens of one more unit."""
        return np.cumsum(np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)))

    def entries(self, text: str) -> tuple[int, list[int], np.ndarray]:
        """(code points of the normalised text, where each unit starts, the table: tokens up to the end of each unit)."""
        at, starts, tables, so_far = 0, [], [], 0
        for special, s in self.segments(text):
            if special:
                starts.append(at)
                tables.append(np.array([so_far + 1]))
            else:
                found = [(m.start(), m[0]) for m in self.split.finditer(s)]
                starts += [at + x for x, _ in found]
                tables.append(so_far + self.table([u for _, u in found]))
            so_far = int(tables[-1][-1]) if len(tables[-1]) else so_far
            at += len(s)
        return at, starts, np.concatenate(tables) if tables else np.zeros(0, np.int64)

    def totals(self, batch: list[str]) -> list[int]:
        """The last table entry of each text."""
        return [int(t[-1]) if len(t) else 0 for _, _, t in map(self.entries, batch)]

    def prefixes(self, text: str) -> Prefixes:
        text, parts, units, at = text or "", [], [], 0
        for special, s in self.segments(text):
            found = [(0, len(s))] if special else [m.span() for m in self.split.finditer(s)]
            units += [(at + a, at + b, special) for a, b in found]
            parts.append(s)
            at += len(s)
        return Prefixes(self, "".join(parts), units, self.entries(text)[2])

    # inside a unit

    def _merged(self, symbols: tuple[str, ...]) -> tuple[str, ...]:
        """The tokens of a sequence of symbols: the adjacent pair of lowest rank is merged until none is left."""
        s = list(symbols)
        while len(s) > 1:
            best = min((self.rank.get(p, 1 << 60) for p in zip(s, s[1:], strict=False)), default=1 << 60)
            if best == 1 << 60:
                break
            out, k = [], 0
            while k < len(s):
                if k + 1 < len(s) and self.rank.get((s[k], s[k + 1])) == best:
                    out.append(s[k] + s[k + 1])
                    k += 2
                else:
                    out.append(s[k])
                    k += 1
            s = out
        return tuple(s)

    def _apart(self, left: tuple[str, ...], right: tuple[str, ...]) -> bool:
        """Whether the symbols of two tokens, merged together, come out as the two tokens."""
        return self.merged(left + right) == ("".join(left), "".join(right))

    def unit_table(self, unit: str) -> list[int]:
        """The counts of unit[:0], unit[:1], ... as units of their own, by the recurrence of the module's text; in time in proportion to the unit, as no token is longer than the vocabulary's longest."""
        sym = [self.symbol[b] for b in unit.encode()]
        m = len(sym)
        n, last = [0] * (m + 1), [()] * (m + 1)

        def token(a: int, b: int, closing: bool) -> tuple[str, ...] | None:
            t = tuple(sym[a:b])
            t = (*t[:-1], t[-1] + self.end) if closing else t
            if "".join(t) not in self.vocab or self.merged(t) != ("".join(t),):
                return None
            return t if not a or self._apart(last[a], t) else None

        for j in range(1, m):
            for a in range(max(0, j - self.longest), j):
                if t := token(a, j, False):
                    n[j], last[j] = n[a] + 1, t
                    break
        out, size = [0], 0
        for c in unit:
            size += len(c.encode())
            out.append(next(n[a] + 1 for a in range(max(0, size - self.longest), size) if token(a, size, True)))
        return out


class Prefixes:
    """The table of one text."""

    def __init__(self, counter: Counter, text: str, units: list[tuple[int, int, bool]], counts: np.ndarray):
        self.counter, self.text, self.units, self.counts = counter, text, units, counts
        self.ends = [b for _, b, _ in units]

    def _inside(self, a: int, b: int) -> int:
        """Tokens of text[a:b], a proper prefix of a unit."""
        total = 0
        for piece in self.counter.split.findall(self.text[a:b]):
            total += self.counter.unit_table(piece)[-1]
        return total

    def count(self, length: int) -> int:
        """Tokens of the first `length` code points."""
        k = bisect_right(self.ends, length)
        done = int(self.counts[k - 1]) if k else 0
        if k < len(self.units) and self.units[k][0] < length:
            return done + self._inside(self.units[k][0], length)
        return done

    def fits(self, budget: int) -> int:
        """The longest prefix that ends with a unit, or with text between units, and has at most `budget` tokens."""
        k = int(np.searchsorted(self.counts, budget, "right"))
        return self.units[k][0] if k < len(self.units) else len(self.text)

    def cut(self, budget: int) -> int:
        """The longest prefix of at most `budget` tokens that ends anywhere; longer units are cut inside."""
        k = int(np.searchsorted(self.counts, budget, "right"))
        if k == len(self.units):
            return len(self.text)
        a, b, special = self.units[k]
        done = int(self.counts[k - 1]) if k else 0
        if special:
            return a
        if b - a > 4:  # a run of letters or of signs, whose prefixes are units too
            inside = self.counter.unit_table(self.text[a : b - 1])
        else:
            inside = [0, *(self._inside(a, x) for x in range(a + 1, b))]
        return a + max(k for k, n in enumerate(inside) if not k or done + n <= budget)


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def prefix_tables(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_chars, starts array<int>, counts array<int>): every row's prefix table.

    counts[k] is the exact number of tokens up to the end of unit k, starts[k] where that unit begins, in code
    points of the normalised text, which has n_chars. A null text counts as empty, without units. Rows with null
    or repeated ids come back as they are; an empty table gives no rows; other columns are ignored, so their
    names don't matter. Very long texts and words are counted whole; of pairs with equal rank the first merges.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        c = counter(path)
        n_bytes, n_chars, ends = [], [], [0]
        starts, counts = [], []
        for t in b.column(1):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            size, s, k = c.entries(raw.decode("utf-8", "replace"))
            n_bytes.append(len(raw))
            n_chars.append(size)
            starts.append(np.array(s, np.int32))
            counts.append(k.astype(np.int32))
            ends.append(ends[-1] + len(s))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (starts, counts)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_chars, pa.int64()), *lists], names=["id", "n_bytes", "n_chars", "starts", "counts"])

    docs = texts(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return in_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, n_bytes long, n_chars long, starts array<int>, counts array<int>")


def tokens_of() -> Column:
    """The number of tokens of a whole text, from its prefix table."""
    return F.when(F.size("counts") > 0, F.element_at("counts", -1)).otherwise(0).cast("long")


def fits(budget: int | Column) -> Column:
    """Code points of the longest prefix, ended by a unit or by what stands between units, of at most budget tokens, from a prefix table."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    units = F.size(F.filter("counts", lambda n: n <= budget))
    return F.when(units >= F.size("counts"), F.col("n_chars")).otherwise(F.element_at("starts", units + 1)).cast("long")


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fits_chars): one row for every row of df, all from its prefix table.

    over_limit: n_tokens > limit; fits_chars: code points of the normalised text's longest prefix of whole
    units within the limit. Nulls, empty and long texts, repeated rows and empty tables: as prefix_tables().
    """
    return prefix_tables(df, path, id_col, text_col).select("id", "n_bytes", tokens_of().alias("n_tokens"), (tokens_of() > limit).alias("over_limit"), fits(limit).alias("fits_chars"))
