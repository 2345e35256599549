"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, tokens. Each stage works on what the one before kept.

Every stage takes (spark, docs, sf_dir), keeps all columns of docs but the last one, and holds for null and empty texts,
repeated rows, empty tables and extra columns of any name. Rows with a null doc_id are never dropped as duplicates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sievework.llm import secret_scan, sentencepiece_bpe, shingles, source_mix, toxicity
from sievework.llm.common import annotate, materialise
from sievework.llm.queries import piece_model

#: Ids up to which a table of them (8 bytes a row) is broadcast; beyond, the join shuffles.
FEW_IDS = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the classifier learns from labels outside its held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = annotate(docs, "text", lambda texts: [pa.array(model.score(texts)[0])], "_new0 double", [pa.float64()])
    return scored.filter("_new0 < 0.5").drop("_new0").toDF(*docs.columns)


def _sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest id.

    Rows of one id are documents of their own: of those in one group the first by text class and content stays.
    """
    groups = materialise(shingles.near_copies(docs), "near-duplicates")
    names = docs.columns
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    key = f"_{names.index('doc_id')}"
    again = materialise(groups.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key)), "repeated-ids")
    gone = materialise(groups.filter("first <> doc_id").select(F.col("doc_id").alias(key)).distinct().join(again, key, "left_anti"), "duplicate-ids")
    kept = rows.join(_sized(gone), key, "left_anti").select(*rows.columns)
    if again.isEmpty():
        return kept.toDF(*names)
    mine = groups.select(F.col("doc_id").alias(key), F.col("class").alias("_class"), "group", "first").distinct()
    again = _sized(again)
    several = annotate(rows.join(again, key, "left_semi").select(*rows.columns), f"_{names.index('text')}", lambda texts: [pa.array([shingles.class_of(shingles.words_of(t)) for t in texts], pa.binary())], "_new0 binary", [pa.binary()])
    several = several.withColumnRenamed("_new0", "_class").join(mine.join(again, key, "left_semi"), [key, "_class"]).filter(F.col("first") == F.col(key))
    order = Window.partitionBy(key, "group").orderBy("_class", F.to_json(F.struct(*rows.columns)))
    once = several.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return kept.join(again, key, "left_anti").select(*rows.columns).unionByName(once.select(*rows.columns)).toDF(*names)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars counted anew where the text changed."""
    model = secret_scan.RandomStrings(secret_scan.builtin_samples())

    def clean(texts: list[str | None]) -> list[pa.Array]:
        found = [secret_scan.find(t, model) if h else [] for t, h in zip(texts, secret_scan.sieve(texts))]
        return [pa.array([secret_scan.redact(t, f) if f else None for t, f in zip(texts, found)], pa.string())]

    out = annotate(docs, "text", clean, "_new0 string", [pa.string()])
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    columns = []
    for i, f in enumerate(docs.schema.fields):
        if i == at:
            columns.append(F.coalesce("_new0", f"_{i}"))
        elif i == size:
            columns.append(F.when(F.col("_new0").isNotNull(), F.length("_new0").cast(f.dataType)).otherwise(F.col(f"_{i}")))
        else:
            columns.append(F.col(f"_{i}"))
    return out.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.copies_of(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document of the mix."""
    out = sentencepiece_bpe.encode_documents(docs, piece_model())
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
