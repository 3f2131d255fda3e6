"""Language ID, quality, FLAC, token counts and BPE: against held-out labels, round trips and the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, flac, langid, prefix_tokens, quality, queries
from millrace.llm.common import Splitter

BYTE_BPE, WORD_BPE = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def rows(df, key="id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


# language ID


def test_codewords_tell_languages_apart():
    for k in (2, 3, 4, 5, 12):
        code = langid.codewords(k).astype(int)
        far = (code.shape[1] - code @ code.T) // 2 + 999 * np.eye(k, dtype=int)
        assert code.shape[0] == k and far.min() >= (1 if k == 2 else code.shape[1] // 4)
        assert (np.abs(code.sum(0)) < k).all()


def test_decoding_takes_the_nearest_codeword_and_corrects_a_wrong_bit():
    x = np.eye(4, langid.BUCKETS, dtype=np.float32)
    m = langid.fit(x, ["a", "b", "c", "d"])
    assert [m.languages[i] for i in m.probabilities(x).argmax(1)] == ["a", "b", "c", "d"]
    m.weight[0, 0] *= -1  # one classifier errs on the first row
    m.bias[:] = 0
    assert m.languages[m.probabilities(x)[0].argmax()] == "a"


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    r = out.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert r["n"] > 200 and r["right"] > 0.97


def test_language_odd_rows(odd_docs, docs_of):
    model = langid.train(odd_docs, F.lit(True))
    got = langid.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    und = [r for r in got if r.lang_pred == "und"]
    assert len(und) == 5 and all(r.score == 0 for r in und)  # two nulls, empty, white space, a dot
    assert langid.identify(odd_docs, model).count() == len(got) - 5 and langid.identify(odd_docs, model).columns == odd_docs.columns
    none = docs_of([])
    assert langid.predict(none, langid.train(none, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.train(none, F.lit(True))).collect()} == {"und"}


def test_identify_fills_corrects_and_rejects(spark):
    """The stage's rule against labels: nulls are filled, wrong labels corrected, what can't be told is rejected, all else kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, langid.crc_part("doc_id", 4) != 2)
    part = F.pmod("doc_id", F.lit(3))
    bare = docs.withColumn("lang", F.when(part == 0, None).when(part == 1, F.lit("en")).otherwise(F.col("lang")))
    out = langid.identify(bare, model)
    assert out.columns == docs.columns and out.count() == docs.count()
    r = out.select("doc_id", F.col("lang").alias("now")).join(docs, "doc_id").agg(F.avg((F.col("now") == F.col("lang")).cast("double")).alias("right")).first()
    assert r["right"] > 0.99
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 ...", "en"), (3, "Re.", None), (4, "Re.", "en")], "doc_id long, text string, lang string")
    by = {r.id: r for r in langid.predict(odd, model).collect()}
    want = {k for k in (3, 4) if k == 4 or not by[k].ambiguous}
    assert {r.doc_id for r in langid.identify(odd, model).collect()} == want
    none = langid.train(docs.limit(0), F.lit(True))
    assert [(r.doc_id, r.lang) for r in langid.identify(odd, none).orderBy("doc_id").collect()] == [(3, None), (4, "en")]


def test_predictions_are_those_of_plain_decoding(spark, sf):
    """Every row of the query against n-grams counted one by one and a plain loop over codewords."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.train(docs, langid.crc_part("doc_id", 4) != 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op1_language_id(spark, sf).collect()}
    for r in docs.collect():
        s, total = " " + " ".join("".join(c if c.isalpha() else " " for c in r.text.lower()).split()) + " ", {}
        for k in (1, 2, 3):
            for at in range(len(s) - k + 1):
                h = 0
                for j, c in enumerate(s[at : at + k]):
                    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 if j else 0) + ord(c) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                b = (h * 0x94D049BB133111EB & (1 << 64) - 1) >> 52
                total[b] = total.get(b, 0) + 1
        norm = sum(total.values()) ** 0.5
        margin = [sum(v**0.5 / norm * float(m.weight[b, k]) for b, v in total.items()) + float(m.bias[k]) for k in range(m.code.shape[1])]
        loss = [sum(t * np.logaddexp(0, -x * c) for t, x, c in zip(m.trust, margin, code, strict=True)) / m.trust.sum() * 2 * np.log2(max(2, len(m.languages))) for code in m.code]
        p = np.exp(min(loss) - np.array(loss))
        assert got[r.doc_id][0] == m.languages[int(np.argmin(loss))] and abs(got[r.doc_id][1] - p.max() / p.sum()) < 1e-3


@given(st.text("abÉΣ  1.x", min_size=1, max_size=40).filter(lambda t: any(map(str.isalpha, t))), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_pieces_of_a_long_text_leave_no_seam(text, size):
    was, whole = langid._CHUNK, langid.features(text)
    try:
        langid._CHUNK = size
        assert np.allclose(langid.features(text), whole)
    finally:
        langid._CHUNK = was


def test_training_sample_is_bounded(docs_of):
    df = docs_of([f"text {k} of many" for k in range(500)])
    assert langid.train(df, F.lit(True), max_rows=20).languages == ["en"]


def test_long_text_features_are_those_of_the_whole():
    text = "ab cd " * 200_000
    x = langid.features(text)
    assert x.shape == (langid.BUCKETS,) and abs(np.linalg.norm(x) - 1) < 1e-5
    assert not np.allclose(langid.features("ab " * 400_000 + "zq " * 100_000), langid.features("ab " * 400_000))


# quality


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair explains it
    m = quality.fit(x, y, rounds=20, pair_rounds=60)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95 and (0, 1) in m.pairs
    z = m.base + sum(t[np.searchsorted(c, x[7, f], "right")] for f, (c, t) in enumerate(zip(m.cuts, m.tables, strict=True)))
    z += sum(t[np.searchsorted(ca, x[7, a], "right"), np.searchsorted(cb, x[7, b], "right")] for (a, b), (ca, cb), t in zip(m.pairs, m.pair_cuts, m.pair_tables, strict=True))
    assert m.score(x)[7] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op3_quality_gam(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = out.groupBy("quality").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")).alias("right")).collect()
    assert len(r) == 2 and all(x.right > 0.95 for x in r)


def test_quality_query_is_the_plain_sum_of_its_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), langid.crc_part("doc_id", 5) != 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op3_quality_gam(spark, sf).collect():
        x = quality.features(texts[r.doc_id])
        z = m.base + sum(t[sum(c <= v for c in cuts)] for v, cuts, t in zip(x, m.cuts, m.tables, strict=True))
        z += sum(t[sum(c <= x[a] for c in ca), sum(c <= x[b] for c in cb)] for (a, b), (ca, cb), t in zip(m.pairs, m.pair_cuts, m.pair_tables, strict=True))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) and r.predicted == (r.score >= 0.3)


def test_quality_odd_rows(spark, odd_docs, docs_of):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(odd_docs, labels, F.lit(True))
    got = quality.score(odd_docs, m).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    empty = quality.train(docs_of([]), labels, F.lit(True))
    assert quality.score(odd_docs, empty).first()["score"] == 0.5 and quality.score(docs_of([]), m).count() == 0


# FLAC

payloads = st.lists(st.one_of(st.binary(max_size=3000), st.text(max_size=2000).map(str.encode), st.binary(max_size=3).map(lambda b: b * 700)), min_size=1, max_size=5)


@given(payloads, st.sampled_from([0, 1, 4, 12]))
@settings(max_examples=60, deadline=None)
def test_flac_round_trip(texts, lpc):
    raw = [flac.padded(t) for t in texts]
    for want, blocks in zip(raw, flac.decode(flac.encode(raw, lpc)), strict=True):
        assert b"".join(p for _, p in blocks) == want
        assert [o for o, _ in blocks] == list(range(0, len(want), flac.FRAME))


def test_flac_uses_every_kind_of_subframe():
    rng = np.random.default_rng(1)
    wave = (128 + 60 * np.sin(np.arange(4096) / 9) + rng.normal(0, 1, 4096)).astype(np.uint8).tobytes()
    noise, flat = rng.integers(0, 256, 1024, dtype=np.uint8).tobytes(), b"a" * 1024
    kinds = set()
    for body, lpc in ((wave, 0), (wave, 8), (noise, 0), (flat, 0)):
        m = flac.encode([body], lpc)[0]
        at = 4 + 4 + 34 + 4 + 18 * (len(body) // flac.FRAME)
        kinds.add("constant verbatim".split()[m[at + 6] >> 1] if m[at + 6] >> 1 < 2 else "lpc" if m[at + 6] >> 1 >= 32 else "fixed")
        assert b"".join(p for _, p in flac.decode([m])[0]) == body
    assert kinds == {"constant", "verbatim", "lpc", "fixed"}
    assert len(flac.encode([wave], 8)[0]) < len(flac.encode([wave], 0)[0]) < len(wave)


def test_flac_without_seek_table_and_with_damage():
    body = flac.padded(b"some words, again and again " * 300)
    m = flac.encode([body])[0]
    points = (len(body) + flac.FRAME - 1) // flac.FRAME
    bare = m[:4] + b"\x80" + m[5:42] + m[46 + 18 * points :]
    assert flac.decode([bare, m]) == flac.decode([m, bare])[::-1] and b"".join(p for _, p in flac.decode([bare])[0]) == body
    for at in random.Random(3).sample(range(46 + 18 * points, len(m)), 40):
        bad = bytearray(m)
        bad[at] ^= 1 << at % 8
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_column(odd_docs, docs_of):
    media = flac.encode_column(odd_docs)
    got, blocks = flac.read_back(media).collect(), flac.pcm_blocks(media).collect()
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id not in (3)").collect()}
    for r in got:
        if r.id in texts:
            raw = flac.padded((texts[r.id] or "").encode())
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
            own = sorted((b.sample_offset, b.pcm) for b in blocks if b.id == r.id)
            assert b"".join(p for _, p in own) == raw and len(raw) % 64 == 0
    same = [r for r in got if r.id in (7, 8)]
    assert {**same[0].asDict(), "id": 0} == {**same[1].asDict(), "id": 0}
    assert flac.read_back(flac.encode_column(docs_of([]))).count() == 0


def test_a_long_stream_is_handled_in_groups(monkeypatch):
    monkeypatch.setattr(flac, "GROUP", 3)
    body = flac.padded(b"a long text, with some more of it in every frame " * 2000)
    m = flac.encode([body, b"x" * 64], 4)
    monkeypatch.setattr(flac, "GROUP", 2048)
    assert flac.encode([body, b"x" * 64], 4) == m
    monkeypatch.setattr(flac, "GROUP", 5)
    assert [b"".join(p for _, p in blocks) for blocks in flac.decode(m)] == [body, b"x" * 64]


def test_op4_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_flac_media(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        raw = flac.padded(texts[r.doc_id].encode())
        m = flac.encode([raw], flac.ORDER)[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        x = [b - 128 for b in raw]
        steps = [abs(a - b) for a, b in zip(x, x[1:], strict=False)]
        assert r.feature == f"{len(x)}:{-(-len(x) // flac.FRAME)}:{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))}:{sum(map(abs, x))}:{max(steps, default=0)}"


# token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


ALPHABET = "abcXYZ  'stréİΣσςéß中́ \n\t\x1c\x85   !?.,-012<|>😀½ⅷ"


@given(st.lists(st.one_of(st.text(ALPHABET, max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "Σίσυφος", "they're"])), max_size=6).map("".join))
@settings(max_examples=300, deadline=None)
def test_totals_are_the_library_s(text):
    c = prefix_tokens.counter(WORD_BPE)
    want = len(c.library.encode(text, add_special_tokens=False).ids)
    p = c.prefixes(text)
    assert c.totals([text]) == [want] and p.count(len(p.text)) == want


def test_every_prefix(library):
    c = prefix_tokens.counter(WORD_BPE)
    text = "Unbelievable thhereating; they're 1234 naïve-ish!? <|endoftext|> zukeitpfung don't stop"
    p = c.prefixes(text)
    counts = [library(p.text[:k]) for k in range(len(p.text) + 1)]
    inside = [k for k in range(len(p.text) + 1) if "<|endof" not in p.text[:k] or p.text[:k].count("<|endoftext|>")]
    assert [p.count(k) for k in inside] == [counts[k] for k in inside]
    for budget in range(counts[-1] + 2):
        k = p.cut(budget)
        assert counts[k] <= budget and p.fits(budget) <= max(k, p.fits(budget)) and library(p.text[: p.fits(budget)]) <= budget


def test_unit_tables_match_the_library(library):
    c = prefix_tokens.counter(WORD_BPE)
    for word in ("unbelievable", "zukeitpfung", "éauçhé", "aaaaaaaaaa", "中文", "'", "!?!?!"):
        assert c.unit_table(word) == [library(word[:k]) for k in range(len(word) + 1)]


def test_token_count_column(odd_docs, docs_of, library):
    got = prefix_tokens.token_counts(odd_docs, WORD_BPE).collect()
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id <> 3").collect()}
    for r in got:
        if r.id in texts:
            n = library(texts[r.id] or "")
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.id] or "").encode()), n > 2048)
    assert prefix_tokens.token_counts(docs_of([]), WORD_BPE).count() == 0


def test_budgets_are_answered_from_the_tables(spark, docs_of, library):
    texts = ["one two three, four!", "", None, "a " * 50 + "<|endoftext|> unbelievable"]
    tables = prefix_tokens.prefix_tables(docs_of(texts), WORD_BPE)
    for budget in (0, 1, 3, 7, 1000):
        for r in tables.select("id", prefix_tokens.fits(budget).alias("to"), "n_chars").collect():
            p = prefix_tokens.counter(WORD_BPE).prefixes(texts[r.id])
            assert (r.to, r.n_chars) == (p.fits(budget), len(p.text)) and library(p.text[: r.to]) <= budget


def test_long_words():
    c = prefix_tokens.counter(WORD_BPE)
    assert len(c.unit_table("x" * 70_000)) == 70_001
    p = c.prefixes("x" * 20_000 + " y")
    assert p.count(p.cut(7)) <= 7 < p.count(p.cut(7) + 40)


def test_op6_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op6_prefix_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


# byte-level BPE


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    with open(BYTE_BPE, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def check_bpe(df, coder):
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    coded = bpe.encode(df, BYTE_BPE, P.PATTERN)
    got = sorted((r.id is None, r.id or 0, list(r.ids)) for r in coded.collect())
    assert got == sorted((n, i, coder.encode_ordinary(t)) for n, i, t in texts)
    back = sorted((r.id is None, r.id or 0, bytes(r.bytes).decode()) for r in bpe.decode(coded, BYTE_BPE).collect())
    assert back == texts
    sums = sorted(r.ids_sha256 for r in bpe.digests(coded, BYTE_BPE).collect())
    assert sums == sorted(hashlib.sha256(" ".join(map(str, coder.encode_ordinary(t))).encode()).hexdigest() for _, _, t in texts)


def test_bpe_odd_rows(odd_docs, coder):
    check_bpe(odd_docs, coder)


def test_bpe_random_texts_in_small_blocks(docs_of, coder, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(400)]
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 500)
    check_bpe(docs_of(texts + texts[:50]), coder)


def test_op10_query_and_counts(spark, sf, coder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    counted = bpe.with_counts(spark.read.parquet(f"{sf}/documents.parquet"), BYTE_BPE, P.PATTERN, "n")
    assert {r.doc_id: r.n for r in counted.collect()} == {r.doc_id: r.n_tokens for r in got}


def test_blocks_of_equal_ids_and_structure(spark, coder):
    """Two partitions, each with one row of a null id and one word: they differ only in the word."""
    df = spark.createDataFrame([(None, "ab"), (None, "cd")], "doc_id double, text string").repartition(2, "text")
    got = sorted(list(r.ids) for r in bpe.encode(df, BYTE_BPE, P.PATTERN).collect())
    assert got == sorted([coder.encode_ordinary("ab"), coder.encode_ordinary("cd")])


def test_bpe_repeated_blocks_and_empty_table(docs_of, coder, spark):
    one = docs_of([(1, "same words"), (2, "same words again")], 1)
    check_bpe(one.union(one), coder)
    assert bpe.digests(bpe.encode(docs_of([]), BYTE_BPE, P.PATTERN), BYTE_BPE).count() == 0


@given(st.text(st.characters(max_codepoint=127), max_size=60), st.sampled_from([P.PATTERN, r"'s|'t|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]))
@settings(max_examples=400, deadline=None)
def test_ascii_texts_split_alike(text, pattern):
    s = Splitter(pattern)
    assert s.ascii is not s.any and s.findall(text) == s.any.findall(text)
    assert Splitter(r"\p{Lu}+").findall("ABcD") == ["AB", "D"]


@given(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, 300)))
def test_planes(x):
    assert bpe._from_planes(bpe._planes(np.array(x, np.uint32))).tolist() == x


@given(st.lists(st.binary(max_size=20)))
def test_packs(x):
    assert bpe.unpack(bpe.pack(list(x))) == x
    words = sorted({w + w[:1] * 20 for w in x} | set(x))
    assert bpe.unpack_words(bpe.pack_words(words, bpe._shared(words))) == words
