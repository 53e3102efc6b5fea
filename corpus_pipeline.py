"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory.llm import lines, minhash, packing, toxicity
from observatory.shared import cut
from observatory.sources.tables import table

#: Documents with a toxicity of this or more go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on this corpus' labels, rejects.

    A null or empty text has the score of no words; null ids and repeated rows are
    scored like any other; an empty table stays so.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    # under names of their own, whatever the columns are called
    plain = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    scored = toxicity.scores(docs.withColumnsRenamed(plain), model, plain["doc_id"], plain["text"], tuple(n for c, n in plain.items() if c != "doc_id"))
    return scored.where(F.col("score") < TOXIC).select(*(F.col(n).alias(c) for c, n in plain.items()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays where it stands first; a document of which nothing is left goes.

    n_chars is counted anew where lines go. Documents with null texts, or blank ones
    that lose no line, stay; repeated rows are treated alike; an empty table stays so.
    """
    plain = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    done = lines.dedup_lines(docs.withColumnsRenamed(plain), plain["doc_id"], plain["text"])
    emptied = F.col("lines_removed").isNotNull() & (F.col(plain["text"]) == "")
    done = done.where(~emptied)
    if "n_chars" in plain:
        count = F.length(plain["text"]).cast(docs.schema["n_chars"].dataType)
        done = done.withColumn(plain["n_chars"], F.when(F.col("lines_removed").isNull(), F.col(plain["n_chars"])).otherwise(count))
    return done.select(*(F.col(n).alias(c) for c, n in plain.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays.

    With it stay all rows of its doc_id. Documents without words, with null texts or
    null doc_ids stay; an empty table stays so.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they stand in sequences.

    A null or empty text is the final id alone; null ids and repeated rows are
    documents of their own; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: A trained classifier and BPE are beyond SQL; the operators are tested against brute force, the stages for what they keep.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
