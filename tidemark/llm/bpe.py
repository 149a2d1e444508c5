"""Tables of texts and of token ids: what bpe_automaton does for one batch, for a DataFrame.

``encode_decode`` keeps every row, in place, with no shuffle.  Null and empty
texts give no ids and an empty decoded text; a text of any length is taken
whole; repeated rows are repeated; an empty table gives an empty table.  Other
columns than the key and the text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.token_text import batches, encoder


def id_bytes(ids: np.ndarray, stops: np.ndarray) -> pa.LargeBinaryArray:
    """Ids of each document as little-endian unsigned 32-bit integers."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int64) * 4), pa.py_buffer(ids.astype("<u4"))])


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", library: bool = False) -> DataFrame:
    """key, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded string, of every row."""
    table = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path, library)
        for b in batches(parts, "text"):
            ids, stops = one.encode(b.column("text"))
            decoded = one.split.decode(ids, stops)
            packed = id_bytes(ids, stops)
            # JVM side columns have 32-bit places; a batch that is too large for them goes in halves
            step = max(1, int(len(b) * (1 << 30) // max(1, decoded.nbytes)))
            for k in range(0, len(b), step):
                n = min(step, len(b) - k)
                yield pa.RecordBatch.from_arrays([b.column("key").slice(k, n), pa.array(np.diff(stops)[k : k + n]), packed.slice(k, n).cast(pa.binary()), decoded.slice(k, n).cast(pa.string())], ["key", "n_tokens", "ids", "decoded"])

    kind = dict(table.dtypes)["key"]
    out = table.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary, decoded string")
    return out.withColumnRenamed("key", key)
