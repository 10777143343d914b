"""The registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrina.functions.text import let
from vitrina.llm.common import WORD, split_words

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def enter(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return enter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.mixing import mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


OP5_SQL = r"""
WITH doc AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), gram AS (
    SELECT doc_id, i, words[i:i + 4] AS g
    FROM doc, LATERAL (SELECT unnest(generate_series(1, len(words) - 4)) AS i)
), twice AS (
    SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id
), feature AS (
    SELECT doc.doc_id, source, len(words) AS n_words,
           coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
           length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
           len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
             - len(list_distinct(list_filter(string_split(text, chr(10)),
                                             lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
           coalesce(covered.n, 0) AS n_repeat_words
    FROM doc LEFT JOIN covered ON doc.doc_id = covered.doc_id
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM feature
), host AS (
    SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source
), total AS (
    SELECT sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS k FROM host
), moment AS (
    SELECT m, (SELECT sum(n * (f / n - m) * (f / n - m)) FROM host) / n - (k - 1) * m * (1 - m) / n AS v
    FROM total
), prior AS (
    SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END, 1.0), 1e6) AS w FROM moment
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (f + w * m) / (n + w) <= 0.5 AS kept
FROM judged JOIN host ON judged.source IS NOT DISTINCT FROM host.source, prior
"""


@query(OP5_SQL)
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.quality import host_rules

    return host_rules(_table(spark, sf_dir, "documents")).drop("host_rate")


@query()
def op7_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 old shards, by the hash of the id, to 40 of equal bytes; affected ones are written."""
    from vitrina.llm.common import keep
    from vitrina.llm.shards import reshard, rewrite
    from vitrina.operators.durable import new_path

    old = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    docs = _table(spark, sf_dir, "documents")
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    placed, transfers = reshard(docs, old, 32, 40, row=row)
    placed = keep(placed, "placed", "zstd")
    rewrite(docs, placed, transfers, new_path(spark, "shards"), row=row)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


@query()
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", keep_ids=False)


URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@query()
def op9_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.urls import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).drop("ratio")


@query()
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents with their entities replaced."""
    from vitrina.llm.pii import replace_entities

    return replace_entities(_table(spark, sf_dir, "documents"), "corpus").select("doc_id", "text", "n_entities")


@query()
def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@query()
def op1_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


@query()
def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.wrappers import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


@query()
def op6_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


@query(r"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op11_radix_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.radix import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by its id's crc32, the words from one place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    numbered = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.col("g") % n
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        word = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.array_join(word, " ")

    text = F.col("text")
    some = (F.col("h") % 10 == 0) & text.rlike(WORD)
    return numbered.select("doc_id", F.when(some, let(split_words(text), repeated)).otherwise(text).alias("text"))


@query()
def op12_frequency_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.periods import periodic_runs, strongest

    found = periodic_runs(planted_periods(_table(spark, sf_dir, "documents")))
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), total AS (
    SELECT count(*) FILTER (len(terms) > 0) AS n_all, sum(len(terms))::BIGINT AS l_all FROM doc
), posting AS (
    SELECT r, doc_id, len(terms) AS n, t, count(*) AS tf FROM (SELECT *, unnest(terms) AS t FROM doc) GROUP BY ALL
), weight AS (
    SELECT t, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM posting, total GROUP BY t
), asked AS (
    SELECT i, item_id, unnest(list_distinct(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
    FROM (SELECT row_number() OVER () AS i, * FROM benchmark)
), scored AS (
    SELECT i, item_id, r, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::BIGINT AS score
    FROM asked JOIN weight USING (t) JOIN posting USING (t), total GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
""")
def op13_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrina.llm.ranking import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
