"""Encoding of documents with a public tokenizer. Null and empty texts have no ids; repeated rows are encoded one by one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm import tokenizers


def ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.FOLDER) -> DataFrame:
    """(doc_id, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizers.load(tokenizer, folder).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype="int64"))).astype("int32")
            flat = np.fromiter(chain.from_iterable(lists), "int32", count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def sizes(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.FOLDER) -> DataFrame:
    """(doc_id, source, n_tokens)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizers.load(tokenizer, folder).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")
