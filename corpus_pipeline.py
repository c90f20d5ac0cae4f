"""The training-data pipeline: documents through stages, each written as Parquet and read again.

1. Language ID: texts without a letter, or mostly in no one language, go.
2. MinHash near-dedup: of each group of near-duplicates the smallest id stays.
3. Substring dedup: passages of 50 words and more that a smaller id has are cut out.
4. Mixing: documents are repeated so that sources come to their target weights.
5. SentencePiece: every copy is encoded, and decoded again for a checksum.

What every stage makes of odd rows:

- Null and empty texts, and texts without a letter, go in the first stage. Rows
  that lose all their words go in the third.
- Texts of any length are handled whole.
- Repeated rows (equal id and text) are near copies of each other: one stays.
  Texts under one id are judged each by itself. Rows without an id are no near
  copies of anything, and stay.
- Ties: of near copies the smallest id stays, and under one id the text with the
  smallest hash; a passage stays where the smallest id has it; languages with
  equally many letters count in the order of the alphabet.
- Columns beyond those of documents are handed on as they are, whatever they are
  called. Only where the last stage adds a column of the same name (ids,
  n_tokens, decoded_sha256), the given one gets a name with ``_`` behind it.
- An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm import language_id, mixing, near_dedup, piece_codec, substring_dedup
from tallygrain.llm.common import set_aside, table
from tallygrain.session import work_folder

# a text stays if one language has this share of its letters: mixed texts stay, unreadable ones go
MIN_LANGUAGE_SHARE = 0.4
# texts of this similarity and more, in percent, are near-duplicates
NEAR_PERCENT = 80
CODED = ("ids", "n_tokens", "decoded_sha256", "decoded")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.train(docs), MIN_LANGUAGE_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given = set_aside(docs, mixing.OWN_COLUMNS)
    return mixing.poisson_mix(given).select(*given.columns).toDF(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(set_aside(docs, CODED))
    return coded.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2("decoded", 256)}
    ).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_language),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# language ID and encoding have no SQL form: tests/llm/test_pipeline.py holds the rows against a plain version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
