"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.session import spread, written

#: Where the vocabulary files are, unless the session or the caller says otherwise.
TOKENIZERS = os.environ.get("QUILLMESH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a worker process."""
    import tiktoken

    # This module may reach workers by value, anew with each task; the library's own module stays.
    kept = tiktoken.__dict__.setdefault("_kept", {})
    if path not in kept:
        # Without its own split pattern the sizes would be those of another tokenizer.
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def shipped(path: str) -> str:
    """Where a task finds the file: as the session sent it, else where the driver has it."""
    try:
        at = SparkFiles.get(os.path.basename(path))
    except Exception:
        return path
    return at if os.path.exists(at) else path


def count_tokens(path: str):
    """A column function: tokens of each text; null for null. Equal texts of a batch are encoded once."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(shipped(path))
        codes, values = pd.factorize(texts)
        n = [len(enc.encode_ordinary(v)) for v in values]
        return pd.Series([n[k] if k >= 0 else None for k in codes], dtype="Int64")

    # A condition on the count would else be pushed down and encode every text twice.
    return count.asNondeterministic()


def sized(docs: DataFrame, extra: dict | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n (tokens) and the extra columns, written once, so that no text is encoded twice.

    Null and empty texts have no tokens and give no row.
    """
    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    if os.path.exists(path):
        docs.sparkSession.sparkContext.addFile(path)
    d = spread(docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text", *[c.alias(k) for k, c in (extra or {}).items()]))
    return written(d.select("doc_id", *(extra or {}), count_tokens(path)("text").alias("n")).where("n > 0"), "sizes")
