"""The corpus pipeline over ``documents``: quality, near duplicates, benchmark passages, secrets, tokens.

Every stage takes what the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.decontaminate import drop_contaminated
from flowloom.llm.minhash_join import near_duplicates
from flowloom.llm.quality_net import fit_on_labels, score_quality
from flowloom.llm.queries import tokenizer_path
from flowloom.llm.secret_scan import scan_secrets
from flowloom.llm.sentencepiece_bpe import encode_texts
from flowloom.session import scratch_path

#: Similarity of the near-duplicate stage, in percent.
NEAR_PERCENT = 80


def _hidden(docs: DataFrame) -> tuple[DataFrame, list[str], list]:
    """``docs`` under neutral names plus ``text``, those names, and the way back: an operator's columns can't clash."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    hidden = docs.toDF(*names)
    hidden = hidden.withColumn("text", F.col(names[docs.columns.index("text")]))
    return hidden, names, [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels of ``docs``, does not reject.

    Null and empty texts are scored too; rows without an id are scored, but teach nothing. Equal texts, and so repeated
    rows, get one score. Columns may have any names. A very long text is one row of one task.
    """
    hidden, names, back = _hidden(docs)
    net = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(hidden, net, names).where("predicted = 1").select(*back)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; of repeated rows one stays.

    Texts without words and rows without an id all stay. Columns may have any names. A very long text is one row of one task.
    """
    hidden, names, back = _hidden(docs)
    own = F.col(names[docs.columns.index("doc_id")])
    keyed = hidden.withColumns({"doc_id": own, "_text_key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    found = near_duplicates(keyed, NEAR_PERCENT, keep=("_text_key",)).where("kept")
    times = found.groupBy("doc_id", "_text_key").agg(F.count("*").alias("_times")).withColumnsRenamed({"doc_id": "_id", "_text_key": "_key"})
    kept = keyed.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")))
    again = (F.col("_times") > 1) & F.col("doc_id").isNotNull()
    once = kept.where(again).dropDuplicates(["doc_id", "_text_key"])
    return kept.where(~again).unionByName(once).select(*back)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and wordless texts and rows without an id stay like others;
    repeated rows fare alike. Columns may have any names. A very long text is one row of one task."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced; ``n_chars`` follows the text where one was found.

    A null text stays null. Rows without an id and repeated rows stay. Columns may have any names. A very long text is one
    row of one task.
    """
    hidden, names, back = _hidden(docs)
    scanned = scan_secrets(hidden, names, with_text=True)
    columns = dict(zip(docs.columns, back))
    found = F.col("spans") != ""
    put = {"text": F.col("redacted")}
    if "n_chars" in columns:
        put["n_chars"] = F.when(found, F.length("redacted").cast("bigint")).otherwise(columns["n_chars"])
    return scanned.select(*[put[c].alias(c) if c in put else columns[c] for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document; a null text is empty, null ids and repeated rows each give their row."""
    return encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id"])


STAGES = [
    ("quality", quality), ("near_duplicate", near_duplicate), ("decontaminated", decontaminated),
    ("without_secrets", without_secrets), ("tokens", tokens),
]
#: SQL can't express the network, so the pipeline is tested stage by stage.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's folder goes once the next one is written; only the last one, which the result reads, stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline/{spark.range(1).selectExpr('uuid()').first()[0]}/{k}_{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
