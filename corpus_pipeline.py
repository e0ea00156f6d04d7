"""A corpus pipeline over the operators of weftgraph.llm.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents: language ID drops
texts whose language it rejects, the quality classifier those it scores below 0.5, near-dedup all but one document of each
group, mixing takes documents as often as their source's target asks, and BPE encodes what is left. An empty table gives
an empty table at each stage, and columns of documents may have any further names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe_segtree, covering_simhash, gam_quality, mixing, zstd_langid
from weftgraph.llm._shared import materialise
from weftgraph.llm.queries import tokenizer_path

#: Columns that operators read by name.
READ = ("doc_id", "text", "lang", "source")


def _kept(docs: DataFrame, judge, keep: str) -> DataFrame:
    """The rows of docs that judge() marks as to be kept, with docs' columns whatever their names: those that no operator
    reads travel under other names."""
    plain = docs.toDF(*[c if c.lower() in READ else f"c{i}" for i, c in enumerate(docs.columns)])
    return judge(plain).filter(keep).select(*plain.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told apart by the least margin. Null texts and texts without letters go; so do
    all if no document has a lang. Equal texts fare alike, whatever their ids; long texts are judged as a whole."""
    return _kept(docs, lambda d: zstd_langid.annotate(d, zstd_langid.learn(d)), "NOT rejected")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of score 0.5 or more. Null and empty texts are scored like any other; without labels all score 0.5
    and stay. Equal texts fare alike; labels of null ids teach nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(docs, lambda d: gam_quality.annotate(d, gam_quality.learn(d, labels)), "predicted = 1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that of least id; rows without an id or with a repeated one are rows like any other.
    Null and empty texts are one group, rows that are equal in all columns one row."""
    return covering_simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is a source; rows of equal id
    and text are taken together; null and empty texts have no words and are taken by their hash like any other."""
    return mixing.repeated(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the text and their number; a null or empty text has none. A row for each row."""
    return bpe_segtree.encode(docs.select("doc_id", "source", "text"), tokenizer_path()).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: Models and hashes beyond SQL decide the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
