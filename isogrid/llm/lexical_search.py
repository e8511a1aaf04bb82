"""Ranked lexical search, reversed: the queries are the index and the documents stream through it.

The items' terms form an inverted index (term -> items and their counts) that every task holds. A first pass writes each
document's counts of the items' terms, which gives the statistics of the corpus; a second one streams them through the index,
a block of documents at a time, and keeps a heap of the best documents of each item. Heaps of all tasks are merged by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Fixed value of the query: documents returned for an item.
MOST_RANKS = 20
#: Items are taken in blocks of about so many words, each block an index of bounded size and a search of its own.
BLOCK_WORDS = 1_000_000
#: Scores that a task holds at a time, documents by items; heaps are merged in so many parts first.
BLOCK_SCORES, MERGE_PARTS = 2_000_000, 16

#: Letters A to Z lower-cased and all ASCII but letters and digits blank; bytes of other characters stay.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text (UTF-8) in order."""
    return text.translate(_FOLD).split() if text else []


class ItemIndex:
    """Items by number, with the inverted index of their terms: places[t]:places[t + 1] of items and times."""

    def __init__(self, texts: list[bytes | None]):
        held: dict[bytes, dict[int, int]] = {}
        for item, text in enumerate(texts):
            for term, times in Counter(terms_of(text)).items():
                held.setdefault(term, {})[item] = times
        self.terms = {term: k for k, term in enumerate(held)}
        self.n_items = len(texts)
        self.places = np.cumsum([0, *map(len, held.values())], dtype=np.int64)
        self.items = np.fromiter((i for x in held.values() for i in x), np.int64, self.places[-1])
        self.times = np.fromiter((n for x in held.values() for n in x.values()), np.int64, self.places[-1])


class Heaps:
    """The best documents of each item so far: score descending, then id ascending (a null id before all)."""

    def __init__(self, n_items: int, most: int):
        self.most, self.least = most, np.zeros(n_items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Take in what is as good as the last of a full heap, and drop what is beyond ``most``."""
        good = score >= np.maximum(self.least[item], 1)
        if not good.any():
            return
        item, score, doc, null = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, ~null, -score, item))
        item = item[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        kept = order[rank < self.most]
        last = rank == self.most - 1
        self.least[item[last]] = score[order[last]]
        self.item, self.score, self.doc, self.null = item[rank < self.most], score[kept], doc[kept], null[kept]


def term_counts(docs: DataFrame, index: ItemIndex, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, times of each document with a term: its number of terms, and the items' terms it has, by number."""
    shared = docs.sparkSession.sparkContext.broadcast(index.terms)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, ns, terms, times, ends = [], [], [], [], [0]
                for name, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    words = terms_of(text)
                    if words:
                        counts = [(t, c) for w, c in Counter(words).items() if (t := known(w)) is not None]
                        ids.append(name)
                        ns.append(len(words))
                        terms += [t for t, _ in counts]
                        times += [c for _, c in counts]
                        ends.append(len(terms))
                if ids:
                    lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def _best(counts: DataFrame, index: ItemIndex, weights: np.ndarray, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """item, doc_id, score: the heaps of each task."""
    shared = counts.sparkSession.sparkContext.broadcast((index, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        heaps = Heaps(index.n_items, most)
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            held = index.places[1:] - index.places[:-1]
            ends = np.r_[0, np.cumsum(lengths)]
            work = np.r_[0, np.cumsum(held[batch.column(2).flatten().to_numpy()])][ends]  # index places that the documents meet
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, min(np.searchsorted(work, work[at] + BLOCK_SCORES, "right") - 1, at + BLOCK_SCORES // max(1, index.n_items)))
                part = batch.slice(at, upto - at)
                terms, times = (part.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
                doc, n = np.repeat(np.arange(part.num_rows), lengths[at:upto]), held[terms]
                m = 75 + (25 * part.column(1).to_numpy() * n_docs) // n_terms
                gain = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
                which = np.repeat(index.places[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
                scores = np.zeros(part.num_rows * index.n_items, np.int64)
                np.add.at(scores, np.repeat(doc * index.n_items, n) + index.items[which], np.repeat(gain, n) * index.times[which])
                scores = scores.reshape(part.num_rows, -1)
                where, item = np.nonzero(scores >= np.maximum(heaps.least, 1))
                ids = part.column(0)
                heaps.add(item, scores[where, item], ids.fill_null(0).to_numpy()[where], ids.is_null().to_numpy(zero_copy_only=False)[where])
                at = int(upto)
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item), pa.array(heaps.doc, mask=heaps.null), pa.array(heaps.score)], names=["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item long, doc_id long, score long")


def _search(spark: SparkSession, docs: DataFrame, names: list, texts: list[bytes | None], kind: str, id_col: str, text_col: str, most: int) -> DataFrame:
    index = ItemIndex(texts)
    counts = stored(term_counts(docs, index, id_col, text_col), "term-counts")
    whole = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(index.terms), np.int64)
    df[held.column("t").to_numpy()] = held.column("df").to_numpy()
    weights = np.floor(1000 * np.log((2 * whole[0] + 2) / (2 * df + 1))).astype(np.int64)
    heaps = _best(counts, index, weights, whole[0], whole[1] or 1, most)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    parts = heaps.withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    for keys in (["item", "part"], ["item"]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
    return parts.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = MOST_RANKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` documents of highest score above 0 for each item.

    Equal scores are ranked by id, a null id first. Null and empty texts have no terms: such documents are never found and such
    items find nothing. Repeated documents are ranked each by itself, and so are repeated items (each gives its own ranks). Long
    texts are counted whole. Only the named columns are read, so others can't clash. Empty tables give an empty result.
    A task holds one block's index, the scores of a block of documents and the heaps. More items than one block are searched
    block by block (``block_words`` words or one item each), all documents every time.
    """
    spark, kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    size = F.coalesce(F.length(item_text_col), F.lit(0)) / 4 + 1
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"), size.alias("size"))
    n_blocks = int((rows.agg(F.sum("size")).first()[0] or 0) // block_words) + 1
    if n_blocks > 1:
        rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "search-items")
    out = None
    for block in range(n_blocks):
        held = (rows.where(F.col("block") == block) if n_blocks > 1 else rows).select("item_id", "text").toArrow()
        found = _search(spark, docs, held.column(0).to_pylist(), held.column(1).cast(pa.binary()).to_pylist(), kind, id_col, text_col, most)
        found = stored(found, "search-block") if n_blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
