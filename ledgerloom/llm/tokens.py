"""Token counts of texts under a public byte-pair vocabulary, read from a folder given as parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import widen

#: Folder with the vocabulary files; every node must have it.
TOKENIZERS = "/opt/tokenizers"

#: The vocabulary's published rule for cutting text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"



def encoding(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(enc, text: object) -> int:
    return len(enc.encode_ordinary(text)) if isinstance(text, str) and text.strip() else 0


def with_tokens(documents: DataFrame, folder: str = TOKENIZERS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``tokens``; null and blank texts have none."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for pdf in batches:
            enc = enc or encoding(folder)
            out = pdf[list(keep)].copy()
            out["tokens"] = [count(enc, t) for t in pdf["text"]]
            yield out

    return widen(documents.select(*keep, "text")).mapInPandas(run, schema)
