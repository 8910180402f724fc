"""The corpus operators bound to the driver tables: name -> query, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_sort, warc
from ._common import workspace
from .content_sort import content_sort_dedup
from .html_text import extract_main_text
from .mixture import mix
from .ngram_join import ngram_jaccard_join
from .packing import harmonic_pack
from .repeated_phrases import repeated_phrases
from .syncmers import syncmer_fingerprints
from .token_files import read_token_files, token_files_folder, write_token_files
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "warc")
    whole = warc.write_warc(_table(spark, sf_dir, "pages"), f"{folder}/whole")
    records = warc.normalise_warc(whole, f"{folder}/records")
    return warc.read_warc(records, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(_table(spark, sf_dir, "documents"), end_id=1).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer_fingerprints(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("passages", "evidence")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files_folder(spark)
    manifest = write_token_files(_table(spark, sf_dir, "documents"), folder, end_id=2)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases(_table(spark, sf_dir, "documents")).drop("spans")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_normalise": op1,
    "op2_ngram_jaccard_join": op2,
    "op3_harmonic_packing": op3,
    "op4_closed_syncmers": op4,
    "op5_toxic_segments": op5,
    "op6_pivotal_mixture": op6,
    "op7_token_stream_files": op7,
    "op8_content_sort_dedup": op8,
    "op9_repeated_phrases": op9,
    "op10_main_text": op10,
}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

NGRAM_ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

PHRASE_ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT win FROM w GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 35)) AS j FROM w SEMI JOIN r USING (win))),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) u ANTI JOIN c USING (doc_id, p) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_warc_normalise": warc.ORACLE,
    "op2_ngram_jaccard_join": NGRAM_ORACLE,
    "op8_content_sort_dedup": content_sort.ORACLE,
    "op9_repeated_phrases": PHRASE_ORACLE,
}
