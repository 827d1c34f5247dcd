"""Each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import chat_format, decontamination, fill_in_middle, packing, pii, prefix_trie, quality_classifier, quality_rules, secret_scan, signature_join, token_counts, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_vector_best_fit")
def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op1_ordinal_quality")
def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.rate(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_naive_bayes_ngrams")
def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_tokeniser_fertility")
def _fertile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query("op10_prefix_join_decontamination", decontamination.DIGEST_SQL)
def _contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op7_signature_tree_join", signature_join.COMPONENTS_SQL)
def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signature_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op4_multipart_credentials", secret_scan.report_sql())
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query("op8_feistel_pseudonyms")
def _pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op3_temporal_lists", url_filters.JUDGED_SQL)
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filters.judged(url_filters.dated_captures(pages), url_filters.dated_entries(pages))
    return found.select("page_id", "host", F.col("day").cast("string").alias("day"), "verdict", "domain", F.col("since").cast("string").alias("since"))


@query("op5_separator_scan")
def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


@query("op11_skip_list_middle", fill_in_middle.DIGEST_SQL)
def _infilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transformed(table(spark, sf_dir, "documents")))


@query("op12_centroid_trie", prefix_trie.TRIE_SQL)
def _trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.spliced(prefix_trie.fingerprints(prefix_trie.turns_in_order(table(spark, sf_dir, "conversations")))))


@query("op13_template_chat", chat_format.FORMAT_SQL)
def _formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(turns.dtypes)
    said = [(chat_format.PLANTED_ID, k, role, chat_format.PLANTED_TEXT) for k, role in enumerate(("user", "assistant"))]
    planted = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    return chat_format.digest(chat_format.formatted(turns.unionByName(planted.select(*(F.col(c).cast(kinds[c]) for c in turns.columns)))))
