"""Token counts by a public tokenizer, one pass over the texts."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are, and which one is meant unless another is given.
TOKENIZERS = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the usual word pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict[str, object] = {}


def counter(path: str):
    """A function from text to its number of tokens; the vocabulary is read once per worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda text: len(encoding.encode_ordinary(text))
        elif path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda text: len(processor.encode(text))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _loaded[path] = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    return _loaded[path]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``tokens``; a null text has no tokens."""
    path = os.path.join(folder, vocabulary)
    fields = [documents.schema[k] for k in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            sizes = pa.array([count(t) if t else 0 for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=[*keep, "tokens"])

    return documents.select(*keep, F.col("text")).mapInArrow(run, ddl)
