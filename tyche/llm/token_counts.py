"""Token counts: lengths only, from Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .encoding import encoder
from .shared import mapped

#: Texts of about so many characters make one batch of results.
BATCH_CHARS = 1 << 20


def balanced(rows: Iterator[pa.RecordBatch], text_at: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``chars`` bytes of text each, a longer text alone."""
    for batch in rows:
        text, start, size = batch.column(text_at), 0, 0
        lengths = pc.binary_length(text).to_pylist()
        for k, n in enumerate(lengths):
            if size and size + (n or 0) > chars:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n or 0
        if start < len(lengths):
            yield batch.slice(start)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens`` of each row of ``docs``; ``vocabulary`` is the path of a tokenizers (.json) or sentencepiece (.model) file.

    Rows map one to one: a repeated row is counted again, a null text counts as empty (0 tokens), a null id stays
    null, other columns are not read, and an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths_of = encoder(vocabulary).lengths
        for batch in balanced(batches, 1):
            counts = pa.array(lengths_of(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = StructType([StructField("id", kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return mapped(narrow, lengths, out).withColumnRenamed("id", id_col)
