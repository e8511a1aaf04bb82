"""Document fingerprints by I-Match with randomised lexicons.

Document frequencies are counted over all documents. Terms within a band of inverse document frequency form the
lexicon: not so common that all texts hold them, not so rare that one edit changes everything. A text's distinct
lexicon terms, sorted, are hashed once for each of several random subsets of the lexicon; texts that agree on a subset
agree on its hash. The band's lower end of document frequency bounds the lexicon: with D distinct terms a document on
average, at most D / LEAST_SHARE terms can be that frequent, however many documents there are. So it can be broadcast.
The first hash of a fingerprint is that of the whole lexicon, so a text that thin subsets leave out still has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, mix64, words_of

#: The band: shares of the documents that a term of the lexicon is in, and the fewest documents.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 1 / 2000, 1 / 5, 2
#: Subsets at each rate 1/8, 1/16, ... of the lexicon: the thicker tell small edits, the thinner large ones.
SUBSETS_PER_RATE, RATES = 8, 8
#: Distinct terms a task counts before it sends partial counts on.
COUNTED_AT_ONCE = 1 << 20
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EMPTY = "-" * 8
_RNG = np.random.default_rng(20_240_607)
_SEEDS = np.append(0, _RNG.integers(0, 2**63, SUBSETS_PER_RATE * RATES, dtype=np.int64)).astype(np.uint64)
_MASKS = np.append(0, np.repeat((1 << np.arange(3, RATES + 3)) - 1, SUBSETS_PER_RATE)).astype(np.uint64)
#: Bytes of text in a block of neighbouring documents; there are as many blocks as shuffle partitions at least.
BLOCK_BYTES = 64 << 20


def terms_of(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct words, A-Z lower-cased."""
    words = set(w.lower() for w in words_of(text))
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: the number of rows each term is in. Tasks add up what they have read before it is shuffled; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    held.append(terms_of(text))
                    size += len(held[-1])
                    if size >= COUNTED_AT_ONCE * 4:
                        yield counts()
                        held, size = [], 0
        if held:
            yield counts()

    return docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sorted hashes of the terms within the band; at most D / LEAST_SHARE of them."""
    total = docs.count()
    rows = document_frequencies(docs, text_col).where((F.col("n") >= max(LEAST_DOCS, total * LEAST_SHARE)) & (F.col("n") <= max(LEAST_DOCS, total * MOST_SHARE))).select("term")
    return np.sort(rows.toArrow().column("term").to_numpy().view(np.uint64))


def fingerprint(text: str | None, terms: np.ndarray) -> str:
    """8 hex digits for the whole lexicon and for each subset, dashes where the text has none of its terms.

    A text with no lexicon term at all is hashed by all its terms, so that it still has a fingerprint of its own.
    """
    mine = terms_of(text)
    if len(mine):
        at = np.minimum(np.searchsorted(terms, mine), max(len(terms) - 1, 0))
        known = mine[terms[at] == mine] if len(terms) else mine[:0]
        mine = known if len(known) else mine
    if not len(mine):
        return _EMPTY * len(_SEEDS)
    chosen = (mix64(mine[None, :] ^ _SEEDS[:, None]) & _MASKS[:, None]) == 0
    return "".join(xxhash.xxh3_64_hexdigest(mine[c].tobytes())[:8] if c.any() else _EMPTY for c in chosen)


def likeness(a: str, b: str) -> float:
    """Of the subsets that either text has terms of, the share whose hashes agree; equal fingerprints give 1."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    told = [x == y for x, y in pairs if x != _EMPTY or y != _EMPTY]
    return sum(told) / len(told)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many leading code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its fingerprint, that of its edited text and both likenesses.

    Null texts count as empty; a null id sorts first; repeated ids are ordered by text, repeated rows are each other's next.
    A table's only row is its own next. An empty table gives an empty result. Only the two named columns are read, so
    others cannot clash. A text is held whole, with the one before it. Texts move once: to blocks of neighbouring ids, one a
    task, the first of each block also to the block before (that of the first block to the last).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    terms = spark.sparkContext.broadcast(lexicon(rows))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1)
    ends = rows.select(F.min(key).alias("first"), F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10 * n).alias("ends")).first()
    firsts = np.unique(np.array([ends["first"], *(ends["ends"] or [])], np.int64)) if ends["first"] is not None else np.zeros(1, np.int64)

    @F.pandas_udf("array<struct<block:int,ahead:boolean>>")
    def homes(ids: pd.Series) -> pd.Series:
        block = np.maximum(np.searchsorted(firsts, ids.to_numpy(), side="right") - 1, 0)
        leads = firsts[block] == ids.to_numpy()
        return pd.Series([[{"block": b, "ahead": False}, {"block": (b - 1) % len(firsts), "ahead": True}] if lead else [{"block": b, "ahead": False}] for b, lead in zip(block.tolist(), leads.tolist())])

    dealt = rows.select("doc_id", "text", F.explode(homes(key)).alias("_home")).select("doc_id", "text", "_home.block", "_home.ahead")
    dealt = dealt.repartitionById(len(firsts), "block").sortWithinPartitions("block", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    schema = to_arrow_schema(T.StructType.fromDDL(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, last, out = terms.value, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for i, text, block, ahead in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns)):
                    own = fingerprint(text, lex)
                    if last and last[0] == block:
                        _, prior, before, print_before = last
                        new = edited(before, text)
                        print_new = fingerprint(new, lex)
                        out.append((prior, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_before, print_new, likeness(print_before, print_new), likeness(print_before, own)))
                    last = None if ahead else (block, i, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                    out = []

    return dealt.select("doc_id", "text", "block", "ahead").mapInArrow(run, COLUMNS)
