"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword; for each bit a binary classifier, logistic over hashed n-gram
frequencies, predicts which side a text is on. Decoding weighs each bit's logistic loss by how well its
classifier did on the training rows, and takes the language whose codeword loses least; the margin to
the runner-up tells how sure that is, and small margins are flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, spare, texts

#: Hash buckets of n-grams of 1 to 3 characters.
BUCKETS = 4096
#: Training rows at most, over all languages; an equal share for each language.
MAX_ROWS = 2400
#: Languages at most: those with the most training rows.
MAX_LANGUAGES = 200
#: A text is ambiguous if the best language's probability is below this, and clear from CLEAR on.
AMBIGUOUS, CLEAR = 0.55, 0.9
UNKNOWN = "und"
_other = re.compile(r"[\W\d_]+")
_CHUNK = 1 << 20


def features(text: str) -> np.ndarray:
    """Square roots of the frequencies of hashed n-grams of the whole lower-cased text; runs of other characters than letters count as one blank.

    Long texts are read in pieces, in bounded memory; a piece goes on where the last one ended, so their size makes no difference."""
    total = np.zeros(BUCKETS, np.int64)
    tail = " "  # the last two characters so far
    for at in range(0, len(text), _CHUNK):
        piece = _other.sub(" ", text[at : at + _CHUNK].replace("Σ", "σ").lower())  # a sigma's form would depend on the letters around it
        if tail[-1] == " " and piece[:1] == " ":
            piece = piece[1:]
        tail = _add(total, tail, piece)
    _add(total, tail, "" if tail[-1] == " " else " ")
    if len(text):
        _add(total, "", " ")  # the blank before the text
    out = np.sqrt(total.astype(np.float32))
    return out / max(1e-9, float(np.linalg.norm(out)))


def _add(total: np.ndarray, tail: str, piece: str) -> str:
    """Counts the n-grams that end in piece; returns the last two characters."""
    if piece:
        c = np.frombuffer((tail + piece).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for k in range(3):
            if k:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[k:] * np.uint64(0x9E3779B97F4A7C15)
            new = h[max(0, len(tail) - k) :]
            total += np.bincount(((new * np.uint64(0x94D049BB133111EB)) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    return (tail + piece)[-2:]


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: all ways to part up to 5 languages, else the best of some seeded random codes."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 5:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(cols, np.int8).T.reshape(k, -1)
    rng, bits, best = np.random.default_rng(5), 10 * math.ceil(math.log2(k)), None
    for _ in range(50):
        code = rng.choice(np.array([1, -1], np.int8), (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + 999 * np.eye(k, dtype=int)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for rows of features: from the codewords' weighted losses."""
        m = self.margins(x)
        loss = np.stack([(np.logaddexp(0, -m * c) * self.trust).sum(1) for c in self.code], 1) / max(1e-9, self.trust.sum()) * 2 * math.log2(max(2, len(self.languages)))
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: list[str], steps: int = 400) -> Model:
    """Trains one classifier per bit; rows of rarer languages weigh as much in total as those of others."""
    languages = sorted(set(y))
    own = np.array([languages.index(v) for v in y], int)
    code = codewords(len(languages))
    if not len(languages) or not code.shape[1]:
        return Model(languages, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    t = code[own].astype(np.float32)
    w = (1 / np.bincount(own, minlength=len(languages))[own] / len(languages)).astype(np.float32)[:, None]
    weight, bias = np.zeros((x.shape[1], t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
    speed, fast = np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(steps):  # accelerated gradient steps on the logistic loss
        g = -t * w / (1 + np.exp(np.clip(t * (x @ weight + bias), -30, 30)))
        speed = 0.9 * speed - 8 * (x.T @ g + 1e-5 * weight)
        fast = 0.9 * fast - 8 * g.sum(0)
        weight, bias = weight + speed, bias + fast
    right = (((x @ weight + bias) * t > 0) * w).sum(0)
    return Model(languages, code, weight, bias, np.log(np.clip(right, 0.5, 0.999) / np.clip(1 - right, 0.001, 0.5)) + 1e-3)


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows of df for which usable is true and text and lang aren't null: at most max_rows rows,
    for each of the MAX_LANGUAGES most frequent languages those with the smallest hashes of their ids (ties:
    by id, then text). No rows: a model without languages. Very long texts count whole."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("y"), usable.alias("u")).where("u and t is not null and y is not null and id is not null")
    counts = {r["y"]: r["n"] for r in docs.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    share = max(1, max_rows // len(counts))
    # first a threshold on the hash that leaves a little more than the share, then the exact share of few rows
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    odds = F.element_at(F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, 1.5 * share / n + 30 / n))]), F.col("y"))
    from pyspark.sql import Window

    few = docs.withColumn("h", part).where(F.col("h") < odds).select("id", "y", "h", "t")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", F.col("id").cast("string"), "t"))).where(F.col("k") <= share).select("y", "k", F.col("t").cast("binary").alias("t"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = [features(t.decode("utf-8", "replace")).astype(np.float16).tobytes() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["y", "k", "x"])

    rows = sorted(in_arrow(few, run, "y string, k int, x binary").collect(), key=lambda r: (r["y"], r["k"]))
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["y"] for r in rows])


def classify(text: list[str | None], model: Model) -> list[tuple[str, float, str | None, bool]]:
    """(language, score, runner-up, ambiguous) of each text; `und`, 0, null and false for one that is null or has no letter."""
    out: list[tuple[str, float, str | None, bool]] = [(UNKNOWN, 0.0, None, False)] * len(text)
    on = [k for k, t in enumerate(text) if model.languages and t and any(map(str.isalpha, t))]
    for at in range(0, len(on), 256):
        part = on[at : at + 256]
        p = model.probabilities(np.stack([features(text[k]) for k in part]))
        for k, q, o in zip(part, p, np.argsort(-p, axis=1, kind="stable"), strict=True):
            out[k] = (model.languages[o[0]], float(q[o[0]]), model.languages[o[1]] if len(o) > 1 else None, bool(q[o[0]] < AMBIGUOUS))
    return out


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, runner_up, ambiguous) for every row, from its whole text alone, however long.

    A text that is null or has no letter is `und`, with score 0, and not ambiguous; so is any text if the
    model has no language. Of languages with equal scores the first by name is taken. Rows with null or
    repeated ids come back as they are; an empty table gives no rows; other columns are ignored, so their
    names don't matter.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = classify([None if t is None else t.decode("utf-8", "replace") for t in b.column(1).to_pylist()], model)
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "lang_pred", "score", "runner_up", "ambiguous"])

    docs = texts(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return in_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, lang_pred string, score double, runner_up string, ambiguous boolean")


def crc_part(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(parts))


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose language can be told, with lang_col set by the model where it is clear.

    Rejected: texts that are null or have no letter, and texts without a lang of their own that are ambiguous.
    lang_col becomes the predicted language where it is null, and where it differs from a prediction with a
    score of at least CLEAR; an ambiguous or less clear text keeps the lang that it came with. A model without
    languages rejects only texts that are null or have no letter and changes none. All other columns stay as
    they are, whatever their names; repeated rows stay repeated; an empty table gives no rows; long texts are
    read whole; bytes that aren't UTF-8 count as other characters.
    """
    spare_col = spare(df, "text_bytes")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = [t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else None for t in b.column(b.num_columns - 1)]
        at = b.schema.get_field_index(lang_col)
        keep, lang = [], []
        for t, (best, score, _, ambiguous), own in zip(text, classify(text, model), b.column(at).to_pylist(), strict=True):
            known = bool(t) and any(map(str.isalpha, t)) and not (ambiguous and own is None)
            keep.append(known)
            lang.append(best if best != UNKNOWN and (own is None or score >= CLEAR) else own)
        columns = [pa.array(lang, b.schema.field(at).type) if k == at else c for k, c in enumerate(b.columns[:-1])]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(df.withColumn(spare_col, F.col(f"`{text_col}`").cast("binary")), run, df.schema)
