"""The registered queries of the llm operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, embed_dedup, filter_audit, html_text, minhash, packing, pii, quality, token_counts, token_store, toxicity, url_filter, vector_codes
from .common import new_path, table

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def op1_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=2)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), carried=["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("_row.doc_id", *counts, F.sha2(F.expr(pii.rendered("base")), 256).alias("base_sha256"), F.expr(pii.rendered("spans")).alias("spans"))


def op4_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return found.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The pages carry no fetch times and no lists come with them: a page is taken to be fetched PAGE_MINUTES times its id after START, and a list's log follows from the hosts themselves.
START, PAGE_MINUTES, LIST_DAYS = "2024-01-01 00:00:00", 7, 400


def url_log(pages: DataFrame) -> DataFrame:
    """A log of three lists over the hosts of pages and the domains above them: every domain whose length leaves 0 when divided by 3 is added, taken off and perhaps added again on days that its length and list tell."""
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).where("h is not null").distinct()
    domains = hosts.select("h").union(hosts.select(F.expr("substring(h, locate('.', h) + 1)"))).distinct().where("length(h) % 3 = 0")
    entries = domains.select("h", F.expr("explode(array(struct('adult' as list, 0 as k), struct('malware' as list, 1 as k), struct('spam' as list, 2 as k)))").alias("e")).where("length(h) % 4 >= e.k")
    steps = entries.select("h", "e.*", F.expr("explode(array(struct('add' as action, 0 as n), struct('remove' as action, 1 as n), struct('add' as action, 2 as n)))").alias("s")).where("length(h) % 5 >= s.n")
    day = f"(length(h) * 31 + k * 53 + s.n * 97) % {LIST_DAYS} + s.n * 40"
    return steps.select("list", F.col("h").alias("domain"), "s.action", F.expr(f"timestamp_ntz'{START}' + make_dt_interval(cast({day} as int))").alias("at"))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(f"timestamp_ntz'{START}' + make_dt_interval(0, 0, cast({PAGE_MINUTES} * page_id % ({LIST_DAYS} * 1440) as int))").alias("fetched_at"))
    found = url_filter.judge(captures, url_log(pages))
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws("@", m["list"], m["domain"])), ",")
    return found.select("_row.page_id", "host", "blocked", F.size("matches").cast("long").alias("n_matches"), listed.alias("matched"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, toxicity.labelled_grades(table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select("doc_id", "text"), model).select("_row.doc_id", "severity", (F.col("severity") >= toxicity.REJECT).alias("rejected"))


def op8_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, decoded=True)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pack_ffd, op2_token_store, op3_pii_bootstrap, op4_embedding_tiles, op5_quality_votes, op6_url_lists, op7_toxicity, op8_minhash_bbit, op9_bpe_trie, op10_html_text, op11_token_counts, op12_filter_audit, op13_vector_codes)}


def queries() -> dict:
    def shipped(f):
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}
