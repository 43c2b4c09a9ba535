"""The registered queries of this subpackage: thin forms of the operators over the given tables."""

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.decontaminate import benchmark_matches
from pairloom.llm.frames import table
from pairloom.llm.fst import token_counts
from pairloom.llm.itq import embedding_duplicates
from pairloom.llm.jaccard import jaccard_components
from pairloom.llm.licenses import license_labels
from pairloom.llm import mixing
from pairloom.llm.maxent import language_scores
from pairloom.llm.mixing import mixing_probabilities
from pairloom.llm.planes import binary_output
from pairloom.llm import ranking
from pairloom.llm.sentencepieces import digests
from pairloom.llm.toxicity import toxicity
from pairloom.llm.urls import url_verdicts
from pairloom.llm.whitening import whitening

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_probabilities(table(spark, sf_dir, "documents"))


ORACLES["op4_mixing"] = mixing.oracle_sql()


@query
def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


@query
def op3_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = ranking.oracle_sql()


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
