"""A corpus pipeline of five stages over the operators of ``ledgerlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, language, line_dedup, ngram_join
from ledgerlens.llm.common import materialize, read_table, set_aside
from ledgerlens.llm.queries import piece_vocabulary, sha256_hex, word_vocabulary

#: A document goes if its likeliest language has no more than this posterior.
LEAST_LANGUAGE_SCORE = 0.5
#: A text with no character but white space.
BLANK = "^[\\x20\\x09-\\x0D]*$"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or a likeliest language go. The
    models are learned from all documents with a language.

    A null, empty or letterless text goes; where no document has a language, all
    go. Equal texts are judged alike, repeated rows stay repeated; of languages
    equally likely the first in order is taken. An empty table stays empty, and
    other columns, of any name, stay as they are."""
    model = language.fit(docs, piece_vocabulary())
    rows, back = set_aside(docs, "_found")
    found = rows.withColumn("_found", language.predict_column(spark, model, "text"))
    sure = (F.col("_found.lang") != language.UNKNOWN_LANGUAGE) & (F.col("_found.score") > LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*rows.columns).withColumnsRenamed(back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later matches are cut; a document that consisted of nothing
    else goes.

    Earlier is by document id, then line; a null id comes first. A null or blank
    text has no lines that match, and stays; of repeated rows (equal id and text)
    lines are those of one document. ``n_chars`` follows a text that was cut;
    other columns, of any name, stay as they are. An empty table stays empty."""
    rows, back = set_aside(docs, "_removed")
    cut = line_dedup.remove_repeated_lines(rows, count="_removed")
    return cut.where((F.col("_removed") == 0) | ~F.col("text").rlike(BLANK)).select(*rows.columns).withColumnsRenamed(back)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the smallest id stays.

    A null id is ignored as a smallest id; null, empty and wordless texts are
    linked with nothing and stay; rows of equal id and text are one document, and
    stay or go together. Other columns, of any name, stay as they are; an empty
    table stays empty."""
    return ngram_join.one_per_component(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go.

    Null and empty texts have no words and stay; repeated rows are judged alike;
    without benchmark items all stay. Other columns, of any name, stay as they
    are; an empty table stays empty."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: documents with their token ids, and digests of the ids and
    of what they decode to.

    A null or empty text has no ids and decodes to ''. Columns of the results'
    names are replaced, others stay; repeated rows stay; an empty table gives an
    empty one with all columns."""
    docs = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    rows, back = set_aside(docs, "_decoded")
    coded = bpe.code(rows, word_vocabulary(), decoded="_decoded")
    return coded.select(
        *[F.col(c).alias(back.get(c, c)) for c in rows.columns],
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("_decoded")).alias("decoded_sha256"),
    )


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_copies),
    ("decontamination", remove_benchmark),
    ("bpe", encode),
]

#: Language models are learned by expectation-maximisation, and BPE follows a
#: vocabulary file: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
