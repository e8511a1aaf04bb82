"""Packing tokenized documents into windows of 2048 ids by non-negative least squares.

A document gives its full windows and a rest. Shallow combinations of two or three rest lengths that fill a window
exactly are enumerated; non-negative least squares fits how often to use each to the histogram of rest lengths (at most
2047 numbers, all that the driver sees); the counts are rounded to what is there. What is left over is packed greedily by
best fit: the longest length with the longest that still fit, as long as the window ends up exactly full. Only what no full
window can be made of is laid end to end with cuts at window ends, and its last window is cut into powers of two, which need
no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, map_slices, shuffled, stored, with_prefix_sums
from .tokens import default_tokenizer, encoder

WINDOW = 2048
END_ID = 1
#: Combinations of three lengths that the fit may use, besides all of two; and sweeps of its coordinate descent.
TRIPLES = 2048
SWEEPS = 100
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(histogram: np.ndarray, window: int = WINDOW, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Sets of two lengths that fill the window, and of three with the most frequent lengths, the more plentiful first."""
    out = [(a, window - a) for a in range(1, window // 2 + 1) if histogram[a] and histogram[window - a]]
    common = np.argsort(-histogram, kind="stable")[:192]
    common = common[histogram[common] > 0]
    a, b = np.meshgrid(common, common, indexing="ij")
    c = window - a - b
    fits = (c >= b) & (b >= a) & (c < window) & (c > 0)
    a, b, c = a[fits], b[fits], c[fits]
    least = np.minimum(np.minimum(histogram[a], histogram[b]), histogram[c])
    best = np.argsort(-least, kind="stable")[:triples]
    return out + [(int(a[i]), int(b[i]), int(c[i])) for i in best if least[i] > 0]


def fit(histogram: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the lengths used from the histogram."""
    left, x = histogram.astype(float), np.zeros(len(patterns))
    uses = [{v: p.count(v) for v in set(p)} for p in patterns]
    norm = [sum(k * k for k in u.values()) for u in uses]
    for _ in range(sweeps):
        moved = 0.0
        for n, u in enumerate(uses):
            new = max(0.0, x[n] + sum(k * left[v] for v, k in u.items()) / norm[n])
            step = new - x[n]
            if step:
                x[n] = new
                for v, k in u.items():
                    left[v] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


#: (length, first rank, end rank, first sequence, offset): the rests of these ranks go to one sequence each.
Places = list[tuple[int, int, int, int, int]]


def best_fit(left: np.ndarray, window: int = WINDOW, depth: int = 12) -> tuple[int, ...]:
    """Lengths that fill a window, of those that ``left`` counts: the longest, then the longest that fit, until one or two
    more end it exactly. Empty if the longest can't be used so.
    """
    left, rest, out = left.copy(), window, []
    while len(out) < depth:
        if out and left[rest]:
            return (*out, rest)
        if out:
            a = np.arange(1, rest // 2 + 1)
            pairs = a[(left[a] > 0) & (left[rest - a] > (a * 2 == rest))]
            if len(pairs):
                return (*out, int(rest - pairs[-1]), int(pairs[-1]))
        there = np.flatnonzero(left[1 : min(rest, window - 1) + 1])
        if not len(there):
            return ()
        longest = int(there[-1]) + 1
        out.append(longest)
        left[longest] -= 1
        rest -= longest
    return ()


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[Places, int]:
    """Places of the rests that fill windows exactly, those of the fitted combinations first; their number of sequences."""
    places, sequences, left = by_combinations(histogram, window)
    more, sequences, _ = by_best_fit(histogram, left, sequences, window)
    return places + more, sequences


def _place(places: Places, pattern: tuple[int, ...], times: int, sequence: int, histogram: np.ndarray, left: np.ndarray) -> None:
    """Note ``times`` windows of a pattern from ``sequence`` on; ranks go on where earlier ones of a length ended."""
    offset = 0
    for v in pattern:
        rank = int(histogram[v] - left[v])
        places.append((v, rank, rank + times, sequence, offset))
        left[v] -= times
        offset += v


def by_combinations(histogram: np.ndarray, window: int = WINDOW) -> tuple[Places, int, np.ndarray]:
    """Places by non-negative least squares, their number of sequences, and the counts that are left."""
    patterns = combinations(histogram, window)
    counts = np.rint(fit(histogram, patterns)).astype(np.int64) if patterns else []
    left, places, sequence = histogram.astype(np.int64), [], 0
    for pattern, wanted in sorted(zip(patterns, counts), key=lambda x: (-x[1], x[0])):
        times = min([int(wanted), *(int(left[v]) // pattern.count(v) for v in set(pattern))])
        if times > 0:
            _place(places, pattern, times, sequence, histogram, left)
            sequence += times
    return places, sequence, left


def by_best_fit(histogram: np.ndarray, left: np.ndarray, sequence: int, window: int = WINDOW) -> tuple[Places, int, np.ndarray]:
    """Places by best fit of what is left. Each step uses up a length or sets one aside, so there are few whatever the counts."""
    left, free, places = left.copy(), left.copy(), []
    while free.any():
        pattern = best_fit(free, window)
        if not pattern:
            free[np.flatnonzero(free)[-1]] = 0  # no full window has it: it is laid end to end
            continue
        times = min(int(free[v]) // pattern.count(v) for v in set(pattern))
        _place(places, pattern, times, sequence, histogram, left)
        for v in pattern:
            free[v] -= times
        sequence += times
    return places, sequence, left


def tail_cuts(total: int, window: int = WINDOW) -> list[int]:
    """Starts of the sequences after the last full window of a stream of ``total`` ids: one for each power of two in the rest."""
    at, rest, out = total // window * window, total % window, []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """row_id, doc_id, n, id_bytes, ids of each document, END_ID included; stored, as it is read twice."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(rows: list, ids: list, texts: list) -> Iterator[tuple]:
        for row, i, blob in zip(rows, ids, encoder(tokenizer).encode(texts)):
            data = np.frombuffer(blob + end, "<u4")
            width = 2 if int(data.max()) < 1 << 16 else 4
            yield row, i, len(data), width, data.astype(f"<u{width}").tobytes()

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(map_slices(rows, run, "row_id long, doc_id long, n long, id_bytes int, ids binary"), "packing-ids")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone, a null id is kept. Repeated rows are packed each by itself. Rests of equal
    length are ranked by a hash of the row. A text longer than a window gives its full windows and a rest; its ids are held
    whole by one task at a time. An empty table gives an empty result. Only the two named columns are read, so others cannot
    clash. The ids move once, to meet their places; the places are computed on three numbers a document, with hot rest
    lengths split into ranges of a hash.
    """
    ids = tokenized(docs, id_col, text_col, tokenizer or default_tokenizer())
    spark = docs.sparkSession
    slim = ids.select("row_id", F.expr(f"n div {window}").alias("_full"), (F.col("n") % window).cast("int").alias("_rest"), shuffled(F.col("row_id")).alias("_order"), F.lit(1).cast("long").alias("_one"))
    found = slim.groupBy("_rest").agg(F.count("*").alias("n"), F.sum("_full").alias("full")).collect()  # a row for each length below the window
    histogram = np.zeros(window, np.int64)
    for r in found:
        histogram[r["_rest"]] = r["n"]
    histogram[0], n_full = 0, sum(r["full"] for r in found)
    places, n_combined = plan(histogram, window)
    total = int(histogram @ np.arange(window)) - sum(v * (b - a) for v, a, b, _, _ in places)
    base = n_combined + n_full
    tail = tail_cuts(total, window)

    ranked = with_prefix_sums(slim, ["_rest"], "_order", ["row_id"], {"_rank": "_one"})
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 0)], "_v int, _a long, _b long, _seq long, _off long")
    placed = ranked.join(F.broadcast(table), (F.col("_rest") == F.col("_v")) & F.col("_rank").between(F.col("_a"), F.col("_b") - 1), "left")
    placed = placed.withColumn("_left", F.when(F.col("_v").isNull(), F.col("_rest")).otherwise(0).cast("long"))
    summed = with_prefix_sums(placed, [], "_order", ["row_id"], {"_first": "_full", "_at": "_left"})

    at, stop = F.col("_at"), F.col("_at") + F.col("_left")
    window_end = (F.floor(at / window) + 1) * window
    cuts = F.array_sort(F.filter(F.array(window_end, *map(lambda c: F.lit(c).cast("long"), tail)), lambda c: (c > at) & (c < stop)))
    bounds = F.array_distinct(F.concat(F.array(at), cuts, F.array(stop)))

    def home(p):
        """The sequence and its first position, for a position in the left-over stream."""
        seq, start = F.lit(base) + F.floor(p / window), F.floor(p / window) * window
        for n, c in enumerate(tail):
            seq, start = F.when(p >= c, F.lit(base + total // window + n)).otherwise(seq), F.when(p >= c, F.lit(c).cast("long")).otherwise(start)
        return seq.cast("long"), start.cast("long")

    def piece(k):
        p, e = F.get(bounds, k), F.get(bounds, k + 1)
        seq, start = home(p)
        return F.struct((F.col("_full") * window + p - at).alias("start"), (e - p).alias("length"), seq.alias("sequence_id"), (p - start).alias("offset"))

    whole = F.array(F.struct((F.col("_full") * window).alias("start"), F.col("_rest").cast("long").alias("length"), F.col("_seq") + F.col("_rank") - F.col("_a"), F.col("_off")))
    rest_type = "array<struct<start:long,length:long,sequence_id:long,offset:long>>"
    pieces = F.when(F.col("_rest") == 0, F.array().cast(rest_type)).when(F.col("_v").isNotNull(), whole.cast(rest_type)).otherwise(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), piece).cast(rest_type))
    spots = summed.select("row_id", (F.lit(n_combined) + F.col("_first")).alias("full_sequence"), pieces.alias("rests"))
    schema = to_arrow_schema(T.StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                rows = []
                for r in batch.slice(k, SLICE_ROWS).to_pylist():
                    data = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                    n = len(data)
                    spans = [(i * window, window, r["full_sequence"] + i, 0) for i in range(n // window)]
                    spans += [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in r["rests"]]
                    rows += [(r["doc_id"], s, m, zlib.crc32(data[s : s + m].tobytes()), n, q, o) for s, m, q, o in spans]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return ids.join(spots, "row_id").select("doc_id", "id_bytes", "ids", "full_sequence", "rests").mapInArrow(run, PIECES)
