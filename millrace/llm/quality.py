"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, and then on the pairs of features that
explain most of what is left. Every tree adds to a lookup table over its feature's bins, so the model is
a table for each feature and pair, and scoring adds up table entries. All features come from the whole text.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, texts

#: Labelled rows to learn from at most: those with the smallest hashes of their ids.
MAX_ROWS = 20000
BINS, PAIR_BINS, PAIRS = 64, 16, 8
NAMES = ("chars", "words", "word_length", "upper", "digits", "symbols", "marks", "spaces", "entropy", "distinct_words", "top_word", "word_runs", "lines", "line_words", "repeated_lines", "ended_lines", "odd_words", "short_words", "bars", "shouts", "other_bytes", "squeezed", "longest_word", "sentence_words", "spread")
_sentence = re.compile(r"[.!?]+(?:\s|$)")


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789")
_SYMBOL, _MARK, _BLANK = _bytes("#$%&*+/<=>@[\\]^_`{|}~"), _bytes(".,;:!?'\"()-"), _bytes(" \t\n\r\v\f")
_LETTER, _HIGH = _UPPER | _LOWER, np.arange(256) >= 128


def features(text: str) -> list[float]:
    """The values of NAMES for a text; an empty text has defined values too."""
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1.0, count.sum())
    p = count[count > 0] / n
    words = text.split()
    m = max(1, len(words))
    often = Counter(words)
    top = max(often.values(), default=0)
    runs = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in words)
    ended = sum(x.rstrip()[-1] in ".!?:;\"')" for x in lines)
    packer, packed = zlib.compressobj(1), 0
    for at in range(0, len(raw), 1 << 20):
        packed += len(packer.compress(raw[at : at + (1 << 20)]))
    packed += len(packer.flush())
    size = [len(w) for w in often]
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / m, count[_UPPER].sum() / max(1.0, count[_LETTER].sum()), count[_DIGIT].sum() / n,
        count[_SYMBOL].sum() / n, count[_MARK].sum() / n, count[_BLANK].sum() / n, float(-(p * np.log2(p)).sum()), len(often) / m,
        top / m, runs / m, np.log1p(len(lines)), np.log1p(m / k), 1 - len(set(lines)) / k if lines else 0.0,
        ended / k, odd / m, sum(c for w, c in often.items() if len(w) <= 3) / m, count[ord("|")] / m, count[ord("!")] / m,
        count[_HIGH].sum() / n, packed / n, np.log1p(max(size, default=0)), m / (1 + len(_sentence.findall(text))), float(np.std(size)) if size else 0.0,
    ]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[tuple[np.ndarray, np.ndarray]]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: table entries are added up, bin by bin."""
        z = np.full(len(x), self.base)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(c, x[:, f], "right")]
        for (a, b), (ca, cb), t in zip(self.pairs, self.pair_cuts, self.pair_tables, strict=True):
            z += t[np.searchsorted(ca, x[:, a], "right"), np.searchsorted(cb, x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins)) if len(v) else np.zeros(0)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best split of histograms of gradients and curvatures."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of that depth over bins, as a table of its leaves' values."""
    gain, k = _best_split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that parts one feature of a pair and then the other on each side: (gain, table)."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            total, table = 0.0, np.zeros_like(a)
            for part in (slice(0, k), slice(k, None)):
                gain, cut = _best_split(a[part].sum(0), b[part].sum(0))
                for side in (slice(0, cut), slice(cut, None)):
                    s, c = a[part, side].sum(), b[part, side].sum()
                    table[part, side] = s / (c + 1)
                    total += s**2 / (c + 1)
            total -= a.sum() ** 2 / (b.sum() + 1)
            if total > best[0]:
                best = (total, table.T.copy() if flip else table)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 25, rate: float = 0.1) -> Model:
    """Trains on rows of features and labels 0 or 1; without rows the score is 1/2 for every text."""
    n, width = x.shape
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    cuts = [_cuts(x[:, f], BINS) for f in range(width)]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables, z = [np.zeros(len(c) + 1) for c in cuts], np.full(n, base)
    state = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(rounds if n else 0):
        for f in range(width):
            g, h = state()
            add = rate * _tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += add
            z += add[bins[f]]
    small = [_cuts(x[:, f], PAIR_BINS) for f in range(width)]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(small)]

    def histograms(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = state()
        size = (len(small[a]) + 1, len(small[b]) + 1)
        cell = coarse[a] * size[1] + coarse[b]
        return np.bincount(cell, g, size[0] * size[1]).reshape(size), np.bincount(cell, h, size[0] * size[1]).reshape(size)

    ranked = sorted(((-_pair_tree(*histograms(a, b))[0], a, b) for a, b in itertools.combinations(range(width), 2)) if n else [])
    pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain < 0]
    pair_tables = [np.zeros((len(small[a]) + 1, len(small[b]) + 1)) for a, b in pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(pairs):
            add = rate * _pair_tree(*histograms(a, b))[1]
            pair_tables[k] += add
            z += add[coarse[a], coarse[b]]
    return Model(base, cuts, tables, [(small[a], small[b]) for a, b in pairs], pairs, pair_tables)


def feature_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x array<double>): the features of each row's whole text; a null text counts as empty."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = [features((t or b"").decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    docs = texts(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return in_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, x array<double>")


def train(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows of labels for which usable is true: at most max_rows ids, by the smallest hashes. Null ids and labels are left out; of rows that share an id the one with the smallest features counts."""
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"), usable.alias("u")).where("u and id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    n = named.count()
    h = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.lit(1 << 30))
    few = named.where(h < int((1 << 30) * min(1.0, 1.1 * max_rows / max(1, n)))).orderBy(h, "id").limit(max_rows)
    docs = texts(df, id_col, text_col).join(F.broadcast(few.select(F.col("id").alias(id_col), "y")), id_col)  # at most max_rows rows
    rows = feature_rows(docs, id_col, text_col).toPandas()
    rows = rows.merge(few.toPandas(), on="id").assign(k=lambda r: r["x"].map(tuple)).sort_values(["id", "k"]).drop_duplicates("id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES))
    return fit(x, rows["y"].to_numpy(float))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) for every row of df, from its whole text alone; a null text counts as empty.

    Very long texts are read whole; equal texts have equal scores. Rows with null or repeated ids come back as
    they are; an empty table gives no rows; other columns are ignored, so their names don't matter.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array([features((t or b"").decode("utf-8", "replace")) for t in b.column(1).to_pylist()], float)
        s = model.score(x)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    docs = texts(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return in_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, score double, predicted int")
