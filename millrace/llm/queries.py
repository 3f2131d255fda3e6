"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, flac, langid, lattice, mixing, prefix_tokens, quality, simhash, sitetree, surrogates
from .common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = _table(spark, sf_dir, "documents"), langid.crc_part("doc_id", 4)
    out = langid.predict(docs, langid.train(docs, part != 2)).withColumnRenamed("id", "doc_id")
    return out.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))


def op2_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = _table(spark, sf_dir, "documents"), langid.crc_part("doc_id", 5)
    model = quality.train(docs, _table(spark, sf_dir, "labels"), part != 0)
    return quality.score(docs, model).withColumnRenamed("id", "doc_id").withColumn("held_out", F.coalesce(part == 0, F.lit(False)))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(flac.encode_column(_table(spark, sf_dir, "documents")), "flac-media")  # what is read back has been written
    return flac.read_back(media).withColumnRenamed("id", "doc_id")


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


#: Keys the replacements; a real run gives its own.
PII_KEY = "millrace surrogate key 1"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    kinds = F.transform("pii_found", surrogates.kind_of)
    of = lambda kind: F.coalesce(F.size(F.filter(kinds, lambda k: k == kind)), F.lit(0)).cast("long")
    return out.select("doc_id", "text", *[F.greatest(of(kind), F.lit(0)).alias(f"n_{kind}") for kind in surrogates.KINDS])


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Mixing weights: domains, languages; sources within a language share alike.
DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 3, 1


def mix_domain(source: Column) -> Column:
    """The tables have no domains: sources are dealt to four by their names' last character."""
    return F.concat(F.lit("d"), (F.ascii(F.substring(source, -1, 1)) % 4).cast("string"))


def mix_weight() -> Column:
    given = lambda c, table: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)], F.lit(1.0))
    return F.when(F.col("level_no") == 0, given("domain", DOMAIN_WEIGHTS)).when(F.col("level_no") == 1, given("lang", LANGUAGE_WEIGHTS)).otherwise(1.0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = mixing.mix(docs, mix_domain(F.col("source")), mix_weight(), share=MIX_SHARE, epochs=MIX_EPOCHS, seed=MIX_SEED)
    return out.select("doc_id", "mix.domain", "lang", "source", "mix.epoch", F.col("mix.tokens").alias("n_tokens"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = byte_bpe()
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path).withColumnRenamed("id", "doc_id")


def byte_bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


OPERATORS = (op1_language_id, op2_lattice_near_dedup, op3_quality_gam, op4_flac_media, op5_site_style_tree, op6_prefix_token_counts, op7_pii_surrogates, op8_simhash_near_dedup, op9_mixing, op10_byte_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def _mix_sql() -> str:
    weigh = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END"

    def level(name: str, above: str, keys: str, weight: str) -> str:
        parent = ", ".join(keys.split(", ")[:-1])
        part = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN {above} USING ({parent})" if parent else ""
        budget = f"{above}.got" if parent else f"(SELECT floor({MIX_SHARE} * CAST(sum(tokens) AS DOUBLE)) FROM leaves)"
        return f"""
{name}_n AS (SELECT n.*, {budget} AS budget FROM (SELECT {keys}, CAST(sum(tokens) AS DOUBLE) * {MIX_EPOCHS} AS cap, CAST({weight} AS DOUBLE) AS w FROM leaves GROUP BY {keys} HAVING sum(tokens) > 0) n {join}),
{name}_s AS (SELECT *, sum(w) OVER ({part}) AS all_w, sum(cap) OVER ({part} ORDER BY cap / w, {keys} ROWS UNBOUNDED PRECEDING) AS cap_to, sum(w) OVER ({part} ORDER BY cap / w, {keys} ROWS UNBOUNDED PRECEDING) AS w_to FROM {name}_n),
{name}_f AS (SELECT *, cap_to + cap / w * (all_w - w_to) <= budget AS is_full FROM {name}_s),
{name}_r AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS rest, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS left_w FROM {name}_f),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE floor(rest / left_w * w) END AS got FROM {name}_r)"""

    place = f"CAST('0x' || substr(md5('{MIX_SEED}|' || %s || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)"
    return f"""WITH own AS (SELECT doc_id, coalesce('d' || CAST(ascii(right(source, 1)) % 4 AS VARCHAR), 'unknown') AS domain, coalesce(lang, 'unknown') AS l, coalesce(source, 'unknown') AS s,
  lang, source, coalesce(CAST(ceil(strlen(text) / 4.0) AS BIGINT), 0) AS tokens FROM documents),
leaves AS (SELECT domain, l, s, CAST(sum(tokens) AS BIGINT) AS tokens FROM own GROUP BY domain, l, s),{level("a", "", "domain", weigh("domain", DOMAIN_WEIGHTS))},{level("b", "a", "domain, l", weigh("l", LANGUAGE_WEIGHTS))},{level("c", "b", "domain, l, s", "1.0")},
plan AS (SELECT domain, l, s, CAST(CASE WHEN tokens > 0 THEN floor(coalesce(got, 0) / tokens) ELSE 0 END AS BIGINT) AS passes, CAST(coalesce(got, 0) AS BIGINT) AS budget, tokens AS all_tokens FROM leaves LEFT JOIN c USING (domain, l, s)),
placed AS (SELECT own.*, passes, budget - passes * all_tokens AS rest, {place % "CAST(passes AS VARCHAR)"} AS place FROM own JOIN plan USING (domain, l, s)),
upto AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed),
times AS (SELECT *, passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM upto)
SELECT doc_id, domain, lang, source, CAST(e.epoch AS BIGINT) AS epoch, tokens AS n_tokens FROM times, LATERAL (SELECT unnest(range(n)) AS epoch) e"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": _mix_sql()}
