"""One query per operator over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, language, line_dedup, mixing, multi_index, packing, page_text, sharding, simhash, url_filter
from tidewatch.llm.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                                    F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(docs, shards=8, seed=2, by=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


@query("op2_page_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return page_text.extract(pages.select("page_id", "url", "html"), page_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), words=3, errors=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL5 = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op5_exact_dedup", SQL5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_groups(docs, stored=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The rules to apply, as (host/path, verdict), and words of hosts that are known to be bad.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BAD_HOST_WORDS = ["spam", "ads", "track", "casino", "bets", "pills", "adult"]


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES, BAD_HOST_WORDS).select("page_id", "host", "path", "rule", "verdict")


@query("op7_multi_index")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


#: Shares of tokens to reach, by source, language and form.
MIX_TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10},
    "topic": {"prose": 0.91, "marked": 0.055, "table": 0.03, "other": 0.005},
}
MIX_SEED = 11


def mixed(docs: DataFrame, keep_unlisted: bool = False) -> DataFrame:
    """Documents with topic, tokens, weight, probability and kept; `keep_unlisted` as in `mixing.mixture`."""
    docs = docs.withColumn("topic", mixing.form_topic(F.col("text"))).withColumn("tokens", mixing.token_count(F.col("text")))
    return mixing.mixture(docs, MIX_TARGETS, tokens="tokens", seed=MIX_SEED, keep_unlisted=keep_unlisted)


def _mix_sql() -> str:
    """The raking as a recursion over the table of cells, each round scaling by source, language and form."""
    cats, held = [], []
    for c, targets in MIX_TARGETS.items():
        listed = ", ".join(f"'{v}'" for v in targets if v != "other")
        cats.append(f"CASE WHEN {c} IN ({listed}) THEN {c} ELSE 'other' END AS k_{c}")
        rest = targets.get("other", max(0.0, 1 - sum(targets.values())))
        share = " ".join(f"WHEN '{v}' THEN {s}" for v, s in targets.items() if v != "other")
        held.append(f"h_{c} AS (SELECT k_{c}, t / sum(t) OVER () AS t_{c} FROM (SELECT k_{c}, CASE k_{c} {share} ELSE {rest} END::DOUBLE AS t "
                    f"FROM own WHERE w > 0 GROUP BY k_{c}))")
    keys = [f"k_{c}" for c in MIX_TARGETS]
    step = "SELECT it + 1 AS it, {k}, {t}, own, w FROM r WHERE it < 300".format(k=", ".join(keys), t=", ".join(f"t_{c}" for c in MIX_TARGETS))
    for c in MIX_TARGETS:
        step = (f"SELECT it, {', '.join(keys)}, {', '.join(f't_{x}' for x in MIX_TARGETS)}, own, "
                f"coalesce(w * t_{c} / nullif(sum(w) OVER (PARTITION BY k_{c}), 0), 0) AS w FROM ({step})")
    n = "length(coalesce(text, ''))"
    without = lambda chars: f"({n} - length(translate(coalesce(text, ''), '{chars}', '')))"
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, lang, CASE WHEN {n} = 0 THEN 'note' WHEN {without('|')} * 40 >= {n} THEN 'table'
      WHEN {without('!#$%&*')} * 20 >= {n} THEN 'marked' WHEN ({n} - length(replace(coalesce(text, ''), chr(10), ''))) * 60 >= {n} THEN 'list'
      WHEN {n} < 400 THEN 'note' ELSE 'prose' END AS topic,
      len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens
  FROM documents),
d AS (SELECT doc_id, source, lang, topic, tokens,
  {', '.join(cats)} FROM base),
own AS (SELECT {', '.join(keys)}, sum(tokens) / sum(sum(tokens)) OVER () AS w FROM d GROUP BY {', '.join(keys)}),
{', '.join(held)},
r(it, {', '.join(keys)}, {', '.join(f't_{c}' for c in MIX_TARGETS)}, own, w) AS (
  SELECT 0, {', '.join(f'own.{k}' for k in keys)}, {', '.join(f't_{c}' for c in MIX_TARGETS)}, w, w::DOUBLE
  FROM own {' '.join(f'JOIN h_{c} USING (k_{c})' for c in MIX_TARGETS)}
  UNION ALL {step}),
raked AS (SELECT {', '.join(keys)}, w / own AS weight, w / own / max(w / own) OVER () AS p FROM r WHERE it = 300 AND own > 0)
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(coalesce(weight, 0), 6) AS weight, round(coalesce(p, 0), 6) AS probability,
  ('0x' || substr(md5('{MIX_SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 0) AS kept
FROM d LEFT JOIN raked USING ({', '.join(keys)})
"""


@query("op8_mixing", _mix_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"),
                        F.round("probability", 6).alias("probability"), "kept")


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.similar_lines(table(spark, sf_dir, "documents"), settings=line_dedup.Settings(words=1), stored=True)
    return found.select("doc_id", "line", "class_doc_id", "class_line", "links", "removed")


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
