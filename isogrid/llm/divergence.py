"""Audit of how the sources of a language differ in their terms.

Tasks count terms without making an object of each: terms of up to 8 bytes are one 64-bit word, those of up to 16 bytes two,
radix-sorted and counted by runs in numpy; longer ones are sorted as bytes, a bucket for each length. Spark adds the counts up.
Each term's counts in all sources of its language then meet in one row, whose sources are compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Fixed values of the query: documents that a kept term is in, the scale of a share, and the ranks of a source's terms.
LEAST_DOCS, SCALE, MOST_TERMS = 3, 1_000_000_000, 200
#: Bytes of text that a task counts at a time, and numbers that one block of term rows by source pairs holds.
BLOCK_BYTES, BLOCK_CELLS = 4_000_000, 1_000_000

#: ASCII letters, lower-cased, and all bytes of other characters belong to terms; 0 is what separates them.
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 0 for c in bytes(range(256)).lower()], np.uint8)


def _radix(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by unsigned keys, the last one first, 16 bits at a time (which numpy sorts by radix)."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.zeros(len(sorted_keys[0]), bool)
    changed[:1] = True
    for key in sorted_keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def _counted(group: np.ndarray, doc: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One of each group and key (its place), its group, its occurrences and its documents; input is in order of documents."""
    order = _radix([*keys, group]) if keys[0].dtype.kind == "u" else np.lexsort((*keys, group))
    group, doc, keys = group[order], doc[order], [k[order] for k in keys]
    first, in_doc = _runs(group, *keys), _runs(group, *keys, doc)
    n_docs = np.diff(np.r_[np.searchsorted(in_doc, first), len(in_doc)])
    return order[first], group[first], np.diff(np.r_[first, len(group)]), n_docs


def count_terms(groups: np.ndarray, texts: pa.Array) -> list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, documents) of the texts (binary, no nulls), for each length bucket."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    # a separator after each text, and room to read 16 bytes from anywhere
    buffer = np.zeros(len(raw) + len(texts) + 16, np.uint8)
    buffer[np.arange(len(raw)) + np.repeat(np.arange(len(texts)), lengths)] = _FOLD[raw]
    ends_of = np.cumsum(lengths + 1)
    edges = np.flatnonzero(np.diff(buffer != 0, prepend=False))
    begin, size = edges[0::2], edges[1::2] - edges[0::2]
    doc = np.searchsorted(ends_of, begin, "right")
    word_at = np.ndarray((len(buffer) - 7,), ">u8", buffer.data, strides=(1,))
    out = []

    def head(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first n (1 to 8) bytes from there as a number, blanks after them."""
        cut = (8 * (8 - n)).astype(np.uint64)
        return (word_at[at].astype(np.uint64) >> cut) << cut

    for low, high in ((0, 8), (8, 16)):
        which = np.flatnonzero((size > low) & (size <= high))
        if not len(which):
            continue
        at, n = begin[which], size[which]
        keys = [head(at, n)] if high == 8 else [head(at + 8, n - 8), head(at, np.full(len(n), 8))]
        place, group, times, docs = _counted(groups[doc[which]], doc[which], keys)
        data = np.stack([k[place] for k in reversed(keys)], 1).astype(">u8").view(np.uint8)
        kept = np.arange(high) < n[place, None]
        out.append((_strings(data[kept], n[place]), group, times, docs))
    longer = np.flatnonzero(size > 16)
    longer = longer[np.argsort(size[longer], kind="stable")]
    for which in np.split(longer, np.flatnonzero(np.diff(size[longer])) + 1) if len(longer) else []:
        n = int(size[which[0]])
        table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, n)[begin[which]])
        place, group, times, docs = _counted(groups[doc[which]], doc[which], [table.view(f"S{n}").ravel()])
        out.append((_strings(table[place].ravel(), np.full(len(place), n)), group, times, docs))
    return out


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """lang, source, term, n, docs: what each task has counted; ('', 0, 0) stands for every group that it has met."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for part in _blocks(batches):
            names = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            number = {g: k for k, g in enumerate(dict.fromkeys(names))}
            langs, sources = (pa.array([g[k] for g in number], pa.string()) for k in (0, 1))
            new = [g for g in number if g not in seen]
            seen.update(new)
            zero = pa.array(np.zeros(len(new), np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array([g[k] for g in new], pa.string()) for k in (0, 1)), pa.array([""] * len(new), pa.string()), zero, zero], schema=schema)
            codes = np.fromiter((number[g] for g in names), np.uint32, len(names))
            for terms, group, times, n_docs in count_terms(codes, part.column(2).cast(pa.binary())):
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), terms, pa.array(times), pa.array(n_docs)], schema=schema)

    return docs.select(*plain).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about BLOCK_BYTES of text each; a longer text is a run of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset : batch.column(2).offset + batch.num_rows + 1].astype(np.int64))) if batch.num_rows else []
        at, done = 0, 0
        for k, end in enumerate(ends):
            if size + end - done >= BLOCK_BYTES:
                held.append(batch.slice(at, k + 1 - at))
                yield pa.concat_batches(held)
                held, size, at, done = [], 0, k + 1, end
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += int(ends[-1] - done)
    if held:
        yield pa.concat_batches(held)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exactly, a thousand at a time (totals up to 9 x 10^15)."""
    whole, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + more
    return whole + 1


def _compared(kept: DataFrame, totals: dict[str, tuple[list[str], np.ndarray, int]], most: int) -> DataFrame:
    """part, lang, source, item, high, low: what each task knows of pairs (sums as high x 2^32 + low) and the best terms."""
    shared = kept.sparkSession.sparkContext.broadcast(totals)
    schema = "part string, lang string, source string, item string, high long, low long"
    fields = [pa.string()] * 4 + [pa.int64()] * 2

    def best(group: np.ndarray, value: np.ndarray, terms: pa.Array) -> np.ndarray:
        """The ``most`` rows of highest value in each group, ties by term."""
        kept = []
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            if len(mine) > most:
                last = np.partition(value[mine], len(mine) - most)[len(mine) - most]
                over, ties = mine[value[mine] > last], mine[value[mine] == last]
                texts = terms.take(pa.array(ties)).cast(pa.binary()).to_pylist()
                mine = np.r_[over, ties[sorted(range(len(ties)), key=texts.__getitem__)[: most - len(over)]]]
            kept.append(mine)
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        tops: dict[str, tuple[np.ndarray, np.ndarray, pa.Array]] = {}
        number = {lang: {s: k for k, s in enumerate(sources)} for lang, (sources, _, _) in shared.value.items()}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                sources, sizes, n_terms = shared.value[lang]
                mine = batch.filter(pa.array(langs == lang))
                step = max(1, BLOCK_CELLS // len(sources))
                for at in range(0, mine.num_rows, step):
                    part = mine.slice(at, step)
                    held = part.column(2).flatten()
                    row = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
                    column = np.fromiter(map(number[lang].__getitem__, held.field(0).to_pylist()), np.int64, len(row))
                    times = np.zeros((len(sources), part.num_rows), np.int64)
                    np.add.at(times, (column, row), held.field(1).to_numpy())
                    p = shares(times, (sizes + n_terms)[:, None])
                    total = sums.setdefault(lang, np.zeros((2, len(sources), len(sources)), np.int64))
                    for k in range(len(sources)):
                        gap = p - p[k]
                        f = gap * gap // p[k]
                        total[0, :, k] += (f >> 32).sum(1)
                        total[1, :, k] += (f & 0xFFFFFFFF).sum(1)
                    q = shares(times.sum(0), np.int64(sizes.sum() + n_terms))
                    over = np.flatnonzero((times > 0) & (p > q))
                    source, place = np.divmod(over, part.num_rows)
                    gap = p.ravel()[over] - q[place]
                    value, terms = gap * gap // q[place], part.column(1).take(pa.array(place))
                    if lang in tops:
                        source, value, terms = np.r_[tops[lang][0], source], np.r_[tops[lang][1], value], pa.concat_arrays([tops[lang][2], terms])
                    kept = best(source, value, terms)
                    tops[lang] = source[kept], value[kept], terms.take(pa.array(kept))
        for lang, total in sums.items():
            names = pa.array(shared.value[lang][0], pa.string())
            one, other = np.nonzero(~np.eye(len(names), dtype=bool))
            yield _batch(fields, "pair", lang, names.take(pa.array(one)), names.take(pa.array(other)), total[0][one, other], total[1][one, other])
            source, value, terms = tops[lang]
            yield _batch(fields, "term", lang, names.take(pa.array(source)), terms, np.zeros(len(value), np.int64), value)

    return kept.mapInArrow(run, schema)


def _batch(fields: list[pa.DataType], part: str, lang: str, source: pa.Array, item: pa.Array, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    n = len(source)
    columns = [[part] * n, [lang] * n, source, item, high, low]
    return pa.RecordBatch.from_arrays([pa.array(v, f) if isinstance(v, list) else pa.array(v).cast(f) for v, f in zip(columns, fields)], names=["part", "lang", "source", "item", "high", "low"])


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the others of its language, and by which terms.

    Part ``pair`` has every other source of the language, part ``term`` the terms that the source has more than its share of,
    ``most_terms`` at most. Null lang, source and text are read as '', so such rows are a group and a language of that name;
    repeated rows count each. Groups without kept terms are there too, with differences of smoothed shares alone, or 0 where
    the language keeps none. Texts of any length are counted whole, a block at a time. Only the three named columns are read,
    so others can't clash. An empty table gives an empty result. The result has a row for each pair of sources of a language,
    so the totals of all groups, which are broadcast, are fewer than its rows.
    """
    counted = term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = stored(by_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "held"), "divergence-kept")
    each = kept.select("lang", "term", F.explode("held").alias("h")).select("lang", "h.source", (F.col("term") != "").cast("long").alias("one"), "h.n")
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("n")).collect()
    n_terms = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("n")).collect()}
    by_lang: dict[str, list[tuple[str, int]]] = {}
    for r in sizes:
        by_lang.setdefault(r["lang"], []).append((r["source"], r["n"]))
    totals = {lang: ([s for s, _ in of], np.array([n for _, n in of], np.int64), n_terms[lang]) for lang, of in by_lang.items()}
    spark = docs.sparkSession
    pairs = [(lang, a, b) for lang, (sources, _, n) in totals.items() if n == 0 for a in sources for b in sources if a != b]
    none = spark.createDataFrame(pairs, "lang string, source string, item string").select(F.lit("pair").alias("part"), "lang", "source", "item", F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    found = _compared(kept.where("term <> ''"), totals, most_terms).unionByName(none)
    value = (F.sum(F.col("high").cast("decimal(20,0)")) * F.lit(1 << 32) + F.sum(F.col("low").cast("decimal(20,0)"))).cast("long")
    summed = found.groupBy("part", "lang", "source", "item").agg(value.alias("value"))
    line = Window.partitionBy("part", "lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = summed.withColumn("rank", F.row_number().over(line).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most_terms)).select("lang", "source", "part", "item", "value", "rank")
