"""Token counts: whole texts through a public tokenizer, only lengths come back.

Texts arrive in Arrow batches, are cut before single spaces between words - where no pre-token of a byte-level tokenizer
can cross, so counts add up - and the distinct pieces go to the library in batches of about equal bytes. Counts of
pieces are remembered up to a fixed number, so a common word is encoded once per task.

Defined cases: null or empty text counts 0 bytes and 0 tokens; a text without a safe boundary is encoded in one piece;
strings of special tokens inside a text are handled as the library does by default; repeated rows are counted row by row;
an empty table gives an empty table; other columns of the input are kept, result columns replace those of the same name,
no other name is taken.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Pieces that a task remembers, and bytes that go to the library at once.
REMEMBERED, BATCH_BYTES = 400_000, 1_000_000
#: White space next to a space: there a cut could part one pre-token.
UNSAFE = re.compile(r" \s|\s ")
SAFE = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> list[str]:
    """The text cut before every single space that stands between two other characters."""
    if UNSAFE.search(text) or text[:1].isspace():
        return SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def n_bytes(text: str) -> int:
    """Bytes in UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class Counter:
    """Counts tokens with a tokenizers file; counts of pieces are kept, and forgotten all at once when too many."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode, self.known = Tokenizer.from_file(path).encode_batch_fast, {}

    def learn(self, new: list[str]) -> None:
        start = size = 0
        for i, x in enumerate(new):
            size += n_bytes(x) + 8
            if size >= BATCH_BYTES or i + 1 == len(new):
                batch = new[start : i + 1]
                self.known.update(zip(batch, (len(e) for e in self.encode(batch, add_special_tokens=False))))
                start, size = i + 1, 0

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of the texts, a few megabytes at a time."""
        out: list[int] = []
        group: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(pieces(text) if text else [])
            size += n_bytes(text)
            if size >= 4 * BATCH_BYTES or i + 1 == len(texts):
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.learn(list(set().union(*group) - self.known.keys()))
                known = self.known.__getitem__
                out += [sum(map(known, x)) for x in group]
                group, size = [], 0
        return out


def token_counts(text: Column, path: str) -> Column:
    """n_bytes and n_tokens of each text as a struct; path: a tokenizers .json file that the executors can read."""

    @F.pandas_udf("n_bytes long, n_tokens long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(path)
        for part in batches:
            texts = ["" if x is None else x for x in part]
            yield pd.DataFrame({"n_bytes": [n_bytes(x) for x in texts], "n_tokens": counter.count(texts)}, dtype="int64")

    return counts(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (replacing columns of those names)."""
    names, counts = ("n_bytes", "n_tokens", "over_limit"), unused(docs, "token_counts")
    out = docs.withColumn(counts, token_counts(F.col(text), path))
    n = F.col(counts)
    return out.select(*[c for c in docs.columns if c.lower() not in names], n["n_bytes"].alias("n_bytes"), n["n_tokens"].alias("n_tokens"), (n["n_tokens"] > limit).alias("over_limit"))
