"""Operator 1: token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyscape.llm.memo import safe_pieces, tokenizer_memo
from keyscape.llm.words import flat


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``, in no order.

    ``tokenizer`` is the path of a tokenizers .json file that every executor
    has; its pre-tokenizer must keep white space at the front of a pre-token or
    drop it, as byte-level and word BPE do. Texts are cut at safe boundaries
    (white space after a sure non-space), and every distinct piece of a batch
    that the worker has not yet seen is encoded, in batches of about equal bytes;
    only lengths leave the encoder. No begin, end or added special tokens;
    special strings inside a text count as the tokenizer's default has it.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated
    rows give repeated rows; an empty table gives an empty result. Other columns
    are not read. Pieces are known by a 64-bit hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokenizer_memo(tokenizer, ids=False)
        for batch in batches:
            data, off = flat(batch.column(1))
            totals = np.zeros(len(off), np.int64)
            for base, starts, ends, keys in safe_pieces(data, off):
                slots = memo.resolve(data, starts + base, ends - starts, keys)
                sums = np.concatenate(([0], np.cumsum(memo.lengths[slots])))
                upto = np.searchsorted(starts, np.clip(off - base, 0, int(ends[-1])))
                totals += sums[upto]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)), pa.array(np.diff(totals))],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = T.StructType([
        T.StructField(id_col, rows.schema[0].dataType),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ])
    return rows.mapInArrow(count, schema)
