"""Operator 10: token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a block that haven't been met lie end to end in one array of symbols. In each round every pre-token's
pair of lowest rank is merged, in all of them at once; a pre-token without a pair that merges leaves the array, and its
symbols count (merges.RankMerger). Blocks and what is kept of pre-tokens met before are library_bpe's.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows with equal texts get equal counts, whatever their
doc_id, null or repeated; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, pick
from .library_bpe import encoder, small_batches

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Per document: bytes, tokens, whether there are more than the limit. One scan, no shuffle."""
    file = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def batch(b: pa.RecordBatch) -> dict:
        enc, counts = encoder(file.value), []
        for run in small_batches(x.as_py() for x in b.column("text")):
            counts += [len(ids) // 4 for ids in enc.encode_many(run)]
        size = pc.binary_length(b.column("text"))
        return {"doc_id": b.column("doc_id"), "n_bytes": size.cast("int64"), "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return arrow_map(pick(docs, "doc_id", "text"), batch, SCHEMA, holds=True)
