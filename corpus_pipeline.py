"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. Rows without a doc_id take no part in links and
counts and stay where their text is kept; the benchmark stage judges them by their text too. Empty tables give empty tables, and columns that documents have beside its own stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontaminate, line_dedup, parity_join, quality
from millrace.llm.shared import source, stored

#: Documents that score less go.
LEAST_QUALITY = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores ``LEAST_QUALITY`` or more."""
    weights = quality.train(docs, source(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep(docs, weights, LEAST_QUALITY)


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, made longer until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    return tuple(next(n for i in range(len(taken) + 1) if (n := name + "_" * i) not in taken) for name in names)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of 20 code points or more that three documents share, but in the last of them."""
    dropped = line_dedup.LineIndex.build(docs, min_docs=3, least=20).dropped()
    kept, _, gone = new = _free(docs, "kept", "n_lines", "n_dropped")
    cleaned = line_dedup.clean(docs, dropped, names=new)
    now = {"text": F.when(F.col(gone) > 0, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(F.col(gone) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast("long")}
    return cleaned.select(*[now[c].alias(c) if c in now else c for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    groups = parity_join.join(docs, k=5, num=80, den=100).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(stored(groups, "copies"), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (or all words of a shorter one)."""
    (key,) = _free(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))  # each row by its own text, those without or with one doc_id too
    found = decontaminate.find(keyed, source(spark, sf_dir, "benchmark", "item_id", "text"), 10, id_col=key)
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(stored(hit, "contaminated"), key, "left_anti").select(*docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and n_bytes of the text that they decode to."""
    both = byte_bpe.round_trip(docs)
    return both.select("doc_id", "n_tokens", "ids", F.length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_common_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", as_tokens),
]

#: No SQL: the first stage is a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
