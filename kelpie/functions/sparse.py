"""Sparse term vectors: tokens, hashed term numbers, postings and inverse document frequency."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.batches import pieces, tidy

#: Tokens that a kernel counts at a time, but for a single text of more.
PIECE_TOKENS = 500_000
VOCABULARY = 30_000
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def term_number(token: Column, vocabulary: int = VOCABULARY) -> Column:
    """The token's md5, as one large number, modulo the vocabulary: folded over 16-bit digits."""
    digest = F.md5(token)
    places = F.array(*(F.lit(i) for i in range(1, 32, 4)))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, i: (a * 65536 + F.conv(F.substr(digest, i, F.lit(4)), 16, 10).cast("long")) % vocabulary).cast("int")


@lru_cache(1 << 16)
def term_number_of(token: str, vocabulary: int = VOCABULARY) -> int:
    """The same in Python; the latest are kept."""
    return int(hashlib.md5(token.encode()).hexdigest(), 16) % vocabulary


def tokens_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def postings(df: DataFrame, key: str, text: str, only: Iterable[int] | None = None) -> DataFrame:
    """(key, term, tf): raw term frequencies of texts whose keys are unique; tokens that share a number add up.

    A document's counts lie within its row, so nothing shuffles: tokens are found in the JVM and
    counted in an Arrow kernel, which hashes each token once in a piece of PIECE_TOKENS. With
    ``only`` the terms of some queries alone are handed on.
    """
    kept = None if only is None else np.unique(np.fromiter(only, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, pc.list_value_length(whole.column(1)), PIECE_TOKENS)):
            own = b.column(1)
            encoded = own.flatten().dictionary_encode()
            if not len(encoded):
                continue
            terms = np.fromiter(map(term_number_of, encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
            at = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
            pairs, tf = np.unique(at * VOCABULARY + terms[encoded.indices.to_numpy()], return_counts=True)
            row, term = np.divmod(pairs, VOCABULARY)
            if kept is not None:
                some = np.isin(term, kept)
                row, term, tf = row[some], term[some], tf[some]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(term.astype(np.int32)), pa.array(tf.astype(np.int64))], [key, "term", "tf"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tokens(text).alias("tokens")).mapInArrow(tidy(run), f"{key} {kind}, term int, tf long")


def idf(postings: DataFrame, key: str, n_docs: Column | int) -> DataFrame:
    """(term, df, idf_q): ln((N - n + 0.5)/(n + 0.5) + 1) in whole millionths, so that equal texts tie exactly."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    # a term has one row a document
    per_term = postings.groupBy("term").agg(F.count(key).alias("df"))
    value = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return per_term.select("term", "df", F.round(value * 1_000_000).cast("long").alias("idf_q"))
