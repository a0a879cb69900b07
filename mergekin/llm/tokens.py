"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the tokenizer's vocabulary lies: rank files end in .tiktoken, others are read by the tokenizers library.
TOKENIZER = os.environ.get("MERGEKIN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published word pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str):
    """A function from a list of texts to their lengths in tokens."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coder.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in coder.encode_batch(texts, add_special_tokens=False)]


def with_token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns keep and n_tokens (long) of every row; a null or empty text has 0 tokens. Whole texts, in Arrow batches."""
    if os.path.exists(path):  # goes to the executors, which need no copy at that place
        docs.sparkSession.sparkContext.addFile(path)
    kept = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped = SparkFiles.get(os.path.basename(path))
        lengths = counter(shipped if os.path.exists(shipped) else path)
        for b in batches:
            n = pa.array(lengths(b.column(b.num_columns - 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    return kept.mapInArrow(count, schema)
