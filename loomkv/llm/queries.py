"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .prefix_bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import write_and_read

    return write_and_read(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import byte_shards

    return byte_shards(_table(spark, sf_dir, "documents"), shards=40, overhead=16)


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import classify, fit

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, _table(spark, sf_dir, "labels")), threshold=0.7)


def op8_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, length=2048)


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_rank_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rank_merge import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def _crc_table() -> str:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        table.append(n)
    return f"[{', '.join(map(str, table))}]::BIGINT[]"


def _op5_sql(shards: int, overhead: int) -> str:
    # an unsigned crc32 over the text's bytes, by its table
    codes = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"
    return f"""
WITH t AS (SELECT {_crc_table()} AS crc),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + {overhead} AS BIGINT) AS size, {crc} AS text_crc32 FROM documents, t),
p AS (SELECT *, 2 * sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS middle, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least({shards - 1}, (middle * {shards}) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""


def _op6_sql(k: int, percent: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
size AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN sh USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * i >= {percent} * (a.n + b.n - i)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM size JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)"""


ORACLE: dict[str, str] = {"op5_byte_shards": _op5_sql(40, 16), "op6_superminhash": _op6_sql(4, 80)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
