"""The registered queries of this subpackage: thin wrappers that derive each contract's columns from an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, mixing, near_dup, periodic, resampling, secrets, tokens, toxicity, url_rules, vector_dup, winnowing
from .common import crc_of_id, table

VOCABULARY = "word_bpe_49k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted before the join with labels, so that no text is shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.mix(mixing.quality_weight(table(spark, sf_dir, "labels"), docs), F.col("quality_weight"), size=F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts that the method itself blocks where no site rule fits.
BLOCKED_WORDS = ("ads", "ads-track", "adserver", "banner", "casino", "cheap-pills", "click-bait", "pills", "spam", "spam-farm", "tracker", "warez")
#: Folders and kinds of files that hold no running text.
BLOCKED_FOLDERS = ("admin", "basket", "cart", "cgi-bin", "checkout", "login", "logout", "signin", "sign-up", "wp-admin", "wp-login.php")
BLOCKED_FILES = ("apk", "avi", "css", "dmg", "exe", "gif", "iso", "jpeg", "jpg", "js", "mp3", "mp4", "png", "svg", "woff", "zip")
RULES = [
    *[url_rules.site_rule(v, r) for v, r in SITE_RULES], *[url_rules.word_rule("block", w) for w in BLOCKED_WORDS], *[url_rules.folder_rule("block", w) for w in BLOCKED_FOLDERS],
    *[url_rules.file_rule("block", w) for w in BLOCKED_FILES],
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), RULES)


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
named AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[^a-z0-9])(%s)($|[^a-z0-9])') OR regexp_matches(path, '(?i)/(%s)(/|$)') OR regexp_matches(path, '(?i)/[^/]*\.(%s)$') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""" % ("|".join(BLOCKED_WORDS), "|".join(x.replace(".", r"\.") for x in BLOCKED_FOLDERS), "|".join(BLOCKED_FILES))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast(c.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(c.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_chats(c.unionByName(added).withColumn("parts", chat.parts_of_text(F.col("text"))))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("turns", turns).withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
written AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\\\2', 'g')) AS n FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + n + 8) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).withColumn("spans", secrets.spans_text(F.col("spans")))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_url_filter, op4_chat_format, op7_secret_scan)}
ORACLES = {"op3_url_filter": OP3_SQL, "op4_chat_format": OP4_SQL}


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES |= {"op8_decontaminate": op8_decontaminate}


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), F.pmod(crc_of_id(F.col("doc_id")), F.lit(4))
    model = toxicity.fit_sample(docs, table(spark, sf_dir, "labels"), part != 2)
    return toxicity.score_toxicity(docs, model).select("doc_id", (part == 2).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), F.pmod(crc_of_id(F.col("doc_id")), F.lit(5))
    model = language.fit_sample(docs, part != 0)
    return language.identify(docs, model).select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score")


QUERIES |= {"op9_toxicity": op9_toxicity, "op10_language_id": op10_language_id}


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES |= {"op5_near_duplicates": op5_near_duplicates}


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op6_near_vectors": op6_near_vectors}


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents"))).withColumn("best", periodic.longest_run(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op11_resample, op12_periodic_runs, op13_fingerprints)}
