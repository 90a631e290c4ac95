"""Documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

from vicinity.llm import exact, language, packing, quality, simhash
from vicinity.llm.common import workspace
from vicinity.llm.queries import vocabulary

#: A document is rejected if its most likely language is less likely than this.
LEAST_LANGUAGE = 0.4


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go; labels are those of the corpus."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def language_id(spark, docs, sf_dir):
    """Documents without a letter, or of no language in particular, go."""
    return language.keep_known(docs, language.fit(docs), LEAST_LANGUAGE)


def exact_dedup(spark, docs, sf_dir):
    """Of documents with equal text the one with the largest ``doc_id`` stays."""
    return exact.keep_latest(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """Of documents linked by fingerprints the one with the smallest ``doc_id`` stays."""
    return simhash.keep_first(docs)


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of all documents left and the sequences they are packed into."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Models, fingerprints and tokens are not what SQL expresses; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to ``documents``; each one's rows are stored for the next."""
    folder = workspace(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    *most, last = STAGES
    for number, (name, stage) in enumerate(most):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return last[1](spark, docs, sf_dir)
