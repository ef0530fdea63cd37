"""Token counts without tokens: initial symbols minus heap merges, per word, summed over whole texts.

Null and empty texts have no tokens.  Each worker remembers the counts of words it has met, up to
a fixed number of words; forgetting costs time only.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPECIAL, vocabulary
from .common import table, with_columns

LIMIT = 1024
CACHED_WORDS = 400_000


class _Counts(dict):
    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)

    def __missing__(self, word: str) -> int:
        n = 1 if word.startswith(SPECIAL) else self.vocabulary.count(word.encode())
        self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(path)


def count_tokens(text: bytes | None, path: str) -> int:
    if not text:
        return 0
    counts = _counts(path)
    if len(counts) > CACHED_WORDS:
        counts.clear()
    return sum(map(counts.__getitem__, counts.vocabulary.pieces(text.decode("utf-8", "replace"))))


def with_token_count(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` and the number of tokens of ``text`` under the vocabulary file ``path``."""
    return with_columns(docs, text, f"`{name}` long", lambda texts: [[count_tokens(t, path) for t in texts]])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = with_token_count(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
