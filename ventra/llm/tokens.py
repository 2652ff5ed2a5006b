"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


def _encoding(path: str):
    """The encoding of a rank file; kept for the life of the worker."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_by_path", {})
    if path not in kept:
        where = path if os.path.exists(path) else public_tokenizers.path(path)
        with open(where, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def with_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens``, the tokens of the whole text; null and empty texts have none.

    ``vocabulary`` is a rank file, by path or by its name among the public tokenizers.  Strings of
    special tokens are ordinary text.  No shuffle; texts are encoded one at a time.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            out = batch[keep].copy()
            out["n_tokens"] = [len(encode(t)) if t else 0 for t in batch["__text"]]
            yield out

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens bigint"
    return documents.select(*keep, F.col(text).alias("__text")).mapInPandas(count, schema)
