"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document is its set of distinct word shingles, as 64-bit hashes. Sizes fall into bands. In a band, sets that link
differ in at most H elements, and the universe of hashes is cut into somewhat more than H + 1 segments. What each
segment costs is measured in all tasks, each among the sets that it holds at once: how many share their elements of it with
another set. A set's budget of H + 1 is
then allotted by cost, the cheapest segments first: one for a segment that it has elements in, which is indexed by these,
and if that does not reach H + 1, one more for segments of two elements or more, which are also indexed by their
one-deletion neighbourhoods (and so still meet when one element differs). The order is the same for all sets of a band, so
of two sets that link, the one whose allotment ends first is covered by the other's: its H + 1 exceed the elements that
differ, so one of its segments meets. A set whose elements crowd into so few segments that even this falls short also
gets the keys of its least elements (prefix filter). So no link is lost, and hot segments are left out where others do.

Equal sets are joined first. Sets that share a key are then linked in two steps, so that a group of many near copies
isn't expanded into pairs: all of a key's sets are compared with the one that shares most keys; then only sets that
stayed outside the key's main component are compared with the others. Where that would be many with many (texts made from one
form), the sets of such keys meet by their rarest elements instead. Before sets are fetched, parity bits (as many as a
set has elements, at least 512) give a lower bound of their difference; what remains is verified on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, chain64, forget, let_go, map_slices, mix64, name_test, stored, stored_at, unused, words_of
from .components import components

#: Ratio of the ends of a size band, and least number of parity bits of a set.
BAND_RATIO = 1.5
PARITY_BITS = 512
#: Bits of a key. Two keys that agree by chance only add a candidate, which the verification drops.
KEY_BITS = 48
#: Share of segments beyond H + 1 that allotments can leave out.
SPARE = 0.1
#: Keys are dealt to so many rounds, each shuffled by itself, so that only a part of them is on disk at a time.
ROUNDS = 4
#: Costs are kept for bands up to this size (some 10 MB of numbers, which are broadcast); larger ones keep the natural order.
RANKED_SIZE = 1 << 20
#: Components among the sets of a key up to which those are compared with each other; sets of other keys meet by their rarest elements.
MOST_OPEN = 64
#: Keys among which a task counts repeats, and pairs of one set that go to one task.
MEASURED_AT_ONCE = 1 << 19
PAIRS_AT_ONCE = 256
#: Sets that a task remembers, to give copies no keys; beyond that it starts afresh.
REMEMBERED = 1 << 20

#: Keys of one set in one band: segments with elements and their keys; segments and keys of the neighbourhoods, and
#: the keys of the least elements, where H + 1 is not reached without them.
BandKeys = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the text, A-Z lower-cased; a shorter text is one shingle."""
    words = [w.lower() for w in words_of(text)]
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = chain64(out, hashes[k : k + n])
    return np.unique(out)


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    raw = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(raw[:8], signed=True), int.from_bytes(raw[8:], signed=True)


def parity(hashes: np.ndarray) -> list[int]:
    """Parity bits: the bits in which those of two sets differ are at most as many as the elements that they do."""
    bits = max(PARITY_BITS, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else PARITY_BITS
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


@lru_cache(maxsize=4096)
def band(k: int, percent: int) -> tuple[int, int, int, int]:
    """(least size, end, H, segments) of the k-th band.

    H holds for any two sets that link of which the smaller is in the band. Segments: so many that the least sets of the
    band are likely to have elements in H + 1 and some to spare.
    """
    low = 1 if k == 0 else band(k - 1, percent)[1]
    end = max(low + 1, int(low * BAND_RATIO))
    most = (end - 1) * (100 - percent) // percent
    segments = most + 1
    while most and segments < 2 * (most + 1):
        lacking = segments * math.exp(-low / segments)
        if segments - lacking - math.sqrt(lacking) >= (1 + SPARE) * (most + 1):
            break
        segments += 1
    return low, end, most, segments


@lru_cache(maxsize=1 << 16)
def bands_of(size: int, percent: int) -> tuple[int, ...]:
    """The bands that a set of this size is indexed in: its own, and all below that hold sets it may link with."""
    k = 0
    while band(k, percent)[1] <= size:
        k += 1
    out = [k]
    while k and size * percent <= (band(k - 1, percent)[1] - 1) * 100:
        k -= 1
        out.append(k)
    return tuple(out)


def _in_band(s: np.ndarray, k: int, percent: int) -> BandKeys:
    _, _, most, segments = band(k, percent)
    mixed = mix64(s)
    segment = ((s >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # grows with s
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    total, name = np.add.reduceat(mixed, first), segment[first]

    def tagged(sums: np.ndarray, names: np.ndarray, tag: int) -> np.ndarray:
        return chain64(chain64(np.full(len(sums), np.uint64(4 * k + tag)), names), sums) >> np.uint64(64 - KEY_BITS)

    none = np.empty(0, np.uint64)
    if len(first) > most:
        return k, name, tagged(total, name, 0), none, none, none
    sizes = np.diff(np.append(first, len(s)))
    where = np.repeat(np.arange(len(first)), sizes)
    more = sizes[where] > 1
    near_names = np.concatenate([name, segment[more]])
    near = np.concatenate([tagged(total, name, 1), tagged(total[where][more] - mixed[more], segment[more], 1)])
    least = none
    if len(first) + (sizes > 1).sum() <= most:
        prefix = len(s) - -(-len(s) * percent // 100) + 1
        least = chain64(np.full(prefix, np.uint64(3)), s[:prefix]) >> np.uint64(64 - KEY_BITS)
    return k, name, tagged(total, name, 0), near_names, near, least


def segment_keys(s: np.ndarray, percent: int) -> list[BandKeys]:
    """All keys that an allotment can choose from, by band."""
    return [_in_band(s, k, percent) for k in bands_of(len(s), percent)] if len(s) else []


def allotted(found: list[BandKeys], percent: int, ranks: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """The distinct keys of a set: H + 1 in each band, cheapest segments first. ranks: band -> place of each segment."""
    keys = []
    for k, name, exact, near_name, near, least in found:
        need, place = band(k, percent)[2] + 1, ranks[k] if ranks and k in ranks else None
        rank = lambda names, place=place: names if place is None else place[names.astype(np.int64)]
        if len(name) >= need:
            keys.append(exact[np.argpartition(rank(name), need - 1)[:need]] if len(name) > need else exact)
            continue
        keys += [exact, least]
        names, count = np.unique(near_name, return_counts=True)
        twice = np.sort(rank(names[count > 1]))
        keys.append(near if len(twice) < need - len(name) else near[rank(near_name) <= twice[need - len(name) - 1]])
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, np.int64)


def keys_of(s: np.ndarray, percent: int, ranks: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """The distinct keys of a set of hashes."""
    return allotted(segment_keys(s, percent), percent, ranks)


def packed(found: list[BandKeys], percent: int) -> bytes:
    """Compact form of ``segment_keys``: a bit for each segment, and KEY_BITS / 8 bytes for each key."""
    out = []
    for k, name, exact, near_name, near, least in found:
        has = np.zeros(band(k, percent)[3], bool)
        has[name.astype(np.int64)] = True
        out += [np.array([len(near), len(least)], "<u4").tobytes(), np.packbits(has).tobytes(), near_name.astype("<u4").tobytes()]
        out += [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes() for x in (exact, near, least)]
    return b"".join(out)


def unpacked(raw: bytes, size: int, percent: int) -> list[BandKeys]:
    """``segment_keys`` of a set of this size, from the compact form."""
    out, at = [], 0

    def take(n: int, kind: str, width: int) -> np.ndarray:
        nonlocal at
        at += n * width
        return np.frombuffer(raw, kind, n * width // np.dtype(kind).itemsize, at - n * width)

    def keys(n: int) -> np.ndarray:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : KEY_BITS // 8] = take(n, "u1", KEY_BITS // 8).reshape(n, KEY_BITS // 8)
        return wide.view(np.uint64).reshape(-1)

    for k in bands_of(size, percent) if size else ():
        n_near, n_least = (int(x) for x in take(2, "<u4", 4))
        segments = band(k, percent)[3]
        name = np.flatnonzero(np.unpackbits(take(-(-segments // 8), "u1", 1))[:segments]).astype(np.uint64)
        near_name = take(n_near, "<u4", 4).astype(np.uint64)
        out.append((k, name, keys(len(name)), near_name, keys(n_near), keys(n_least)))
    return out


def segment_costs(sets: DataFrame, percent: int) -> DataFrame:
    """band, segment, cost: how many sets share their key of it with another set, among those that a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def counted() -> pa.RecordBatch:
            bands, names, keys = (np.concatenate(x) for x in zip(*held))
            _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
            again = count[where] > 1
            both, cost = np.unique(bands[again] << np.int64(32) | names[again], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((both >> 32).astype(np.int32)), pa.array((both & 0xFFFFFFFF).astype(np.int32)), pa.array(cost.astype(np.int64))], names=["band", "segment", "cost"])

        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, name, exact, *_ in unpacked(raw, n, percent):
                    if band(k, percent)[1] <= RANKED_SIZE:
                        held.append((np.full(len(name), k, np.int64), name.astype(np.int64), exact))
                        size += len(name)
                if size >= MEASURED_AT_ONCE:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return sets.select("n", "keys").mapInArrow(run, "band int, segment int, cost long").groupBy("band", "segment").agg(F.sum("cost").alias("cost"))


def segment_ranks(sets: DataFrame, percent: int) -> dict[int, np.ndarray]:
    """band -> the place of each segment in the order of cost; bands up to RANKED_SIZE, so bounded whatever the data."""
    found: dict[int, list] = {}
    for r in segment_costs(sets, percent).collect():
        found.setdefault(r["band"], []).append((r["segment"], r["cost"]))
    ranks = {}
    for k, costs in found.items():
        cost = np.zeros(band(k, percent)[3], np.int64)
        at, value = zip(*costs)
        cost[list(at)] = value
        ranks[k] = np.argsort(np.argsort(cost, kind="stable"), kind="stable")
    return ranks


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and parity bits of two sets allow a link; the longer bits are folded onto the shorter."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    pa_, pb = F.col(f"{a}.bits"), F.col(f"{b}.bits")
    width = F.least(F.size(pa_), F.size(pb))

    def fold(bits: Column) -> Column:
        return F.when(F.size(bits) > width, F.zip_with(F.slice(bits, 1, width), F.slice(bits, width + 1, width), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)

    differ = F.aggregate(F.zip_with(fold(pa_), fold(pb), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> tuple[DataFrame, str]:
    """id, n, s of the wanted sets (columns name, id, h1, h2), made anew from their texts (columns name, text).

    The texts stay where they are: a filter picks those that may be wanted, and only their sets are joined.
    """

    passes = name_test(wanted.select("name"))

    def sets_of(names: list, texts: list) -> Iterator[tuple]:
        for name, text, asked in zip(names, texts, passes(np.array(names, np.int64)).tolist()):
            if asked:
                s = shingles(text, width)
                yield name, *set_id(s), len(s), s.view(np.int64).tolist()

    made = map_slices(texts.select("name", "text"), sets_of, "name long, h1 long, h2 long, n long, s array<long>")
    return stored_at(made.join(wanted, ["name", "h1", "h2"]).select("id", "n", "s"), "ngram-members")


def _verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame, width: int, percent: int) -> tuple[DataFrame, str]:
    """Those of the pairs (u, v) whose sets link, stored.

    Only sets in one of these pairs are fetched, from their texts. A set in many pairs goes to several tasks, each with some of its pairs.
    """
    spark = pairs.sparkSession
    pairs, pairs_path = stored_at(pairs, "ngram-pairs")
    let_go(spark)
    often = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.floor(F.count("*") / PAIRS_AT_ONCE).cast("int").alias("more"))
    wanted, wanted_path = stored_at(marks.select("id", "h1", "h2", "name").join(often, "id"), "ngram-wanted")
    sets, sets_path = _sets(texts, wanted.select("name", "id", "h1", "h2"), width)
    let_go(spark)
    sides = {}
    for side, other in (("u", "v"), ("v", "u")):
        more = wanted.where("more > 0").select(F.col("id").alias(side), F.col("more").alias(f"more_{side}"))
        pairs = pairs.join(more, side, "left").withColumn(f"copy_{side}", F.when(F.col(f"more_{side}").isNull(), 0).otherwise(F.pmod(F.hash(other), F.col(f"more_{side}") + 1)))
        copies = sets.join(wanted.select("id", "more"), "id").select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("s").alias(f"s_{side}"), F.explode(F.sequence(F.lit(0), "more")).alias(f"copy_{side}"))
        sides[side] = copies
    both = pairs.select("u", "v", "copy_u", "copy_v").join(sides["u"], ["u", "copy_u"]).join(sides["v"], ["v", "copy_v"])
    shared = F.size(F.array_intersect("s_u", "s_v"))
    linked = both.where(100 * shared >= percent * (F.col("n_u") + F.col("n_v") - shared)).select("u", "v").distinct()
    out = stored_at(linked, "ngram-links")
    for path in (pairs_path, wanted_path, sets_path):
        forget(spark, path)
    let_go(spark)
    return out


def _named(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A name for a row's id and text; repeated rows have the same."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _shared_keys(rows: DataFrame, first_of: DataFrame, percent: int) -> DataFrame:
    """key, id, times of the allotted keys that more than one set has. first_of: the set (id) of each row with keys."""
    spark = rows.sparkSession
    ranks = spark.sparkContext.broadcast(segment_ranks(rows, percent))

    def choose(ids: list, sizes: list, raws: list) -> Iterator[tuple]:
        for i, n, raw in zip(ids, sizes, raws):
            yield i, allotted(unpacked(raw, n, percent), percent, ranks.value).tolist()

    table, path = stored_at(map_slices(rows.select("row_id", "n", "keys"), choose, "row_id long, keys array<long>"), "ngram-keys")
    parts = []
    for r in range(ROUNDS):
        keys = table.select("row_id", F.explode(F.filter("keys", lambda k: k % ROUNDS == r)).alias("key"))  # noqa: B023
        often = keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
        parts.append(stored_at(keys.join(often, "key"), "ngram-often"))
        let_go(spark)
    forget(spark, path)
    every = reduce(DataFrame.union, [t for t, _ in parts]).join(first_of, "row_id").select("key", "id").distinct()
    times = every.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    shared = stored(every.join(times, "key"), "ngram-shared")
    for _, path in parts:
        forget(spark, path)
    return shared


def _main(placed: DataFrame) -> DataFrame:
    """key, kinds, main of keys (key, id, c) whose sets are of several components: how many, and the one with most of them."""
    return placed.groupBy("key", "c").count().groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("count", "c"))["c"].alias("main")).where("kinds > 1")


def _open_pairs(placed: DataFrame, main: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of a key's sets of different components that may link. Sets of the main component meet only those outside it."""
    open_keys = stored(placed.join(main, "key").join(brief, "id"), "ngram-open")
    let_go(brief.sparkSession)
    a, b = open_keys.where("c != main").alias("a"), open_keys.alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & ((F.col("b.c") == F.col("b.main")) | (F.col("a.id") < F.col("b.id")))
    return a.join(b, apart & _may_link("a", "b", percent)).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))


def _rare_keys(deep: DataFrame, texts: DataFrame, marks: DataFrame, width: int, percent: int) -> DataFrame:
    """key, id, c of sets (id, c) in crowded keys: their rarest elements, so many that two sets that link share one.

    Form letters share most segments and link with none. Their sets are cut into single elements instead, and those are taken
    first which fewest of these sets have; an element of one set alone makes no key. The order is the same for all of them, so
    the first n - ceil(n percent / 100) + 1 elements of two sets that link meet.
    """
    spark = deep.sparkSession
    sets, path = _sets(texts, marks.join(deep, "id").select("name", "id", "h1", "h2"), width)
    each = sets.select("id", "n", F.explode("s").alias("key"))
    ranked = each.join(each.groupBy("key").agg(F.count("*").alias("times")), "key")
    line = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("line"))
    first = F.slice("line", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    keys = line.select("id", F.explode(F.filter(first, lambda e: e["times"] > 1)).alias("e")).select("e.key", "id")
    out = stored(keys.join(deep, "id"), "ngram-rare")
    forget(spark, path)
    let_go(spark)
    return out


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, name, n, h1, h2), and for each distinct set (h1, h2) its component c and that one's least doc_id."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _named(docs, id_col, text_col).alias("name"))
    rows = texts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "name", "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of copies only the first in a task needs keys

        def one(row: int, i: int, name: int, text: str) -> tuple:
            s = shingles(text, width)
            mark = set_id(s)
            new = len(s) > 0 and mark not in seen
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(mark)
            return row, i, name, len(s), *mark, parity(s), packed(segment_keys(s, percent), percent) if new else None

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                made = [one(*r) for r in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*made), schema)], schema=schema)

    columns = "row_id long, doc_id long, name long, n long, h1 long, h2 long, bits array<long>, keys binary"
    schema = to_arrow_schema(T.StructType.fromDDL(columns))
    index_table, index_path = stored_at(rows.mapInArrow(index, columns), "ngram-index")
    groups = stored(index_table.where("n > 0").groupBy("h1", "h2").agg(F.min("row_id").alias("id"), F.min("doc_id").alias("least")), "ngram-sets")
    slim = stored(index_table.select("doc_id", "name", "n", "h1", "h2"), "ngram-rows")
    with_keys = index_table.where("keys IS NOT NULL")
    first_of = stored(with_keys.select("row_id", "h1", "h2").join(groups, ["h1", "h2"]).select("row_id", "id"), "ngram-firsts")
    shared = _shared_keys(with_keys, first_of, percent)
    marks = stored(index_table.withColumnRenamed("row_id", "id").join(first_of.select("id").distinct(), "id", "left_semi").select("id", "n", "h1", "h2", "name", "bits"), "ngram-marks")
    forget(spark, index_path)
    let_go(spark)

    mass = shared.groupBy("id").agg(F.sum("times").alias("mass"))
    weighed = shared.join(mass, "id").select("key", "id", "mass")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("mass", (-F.col("id")).alias("id")))["id"].alias("hub"))
    spokes = weighed.join(hubs, "key").select("id", (-F.col("hub")).alias("hub")).where("id != hub").distinct()
    sketch = marks.select("id", "n", "bits")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v), without repeats, that may link."""
        once = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        return once.join(sketch.alias("a"), F.col("a.id") == F.col("u")).join(sketch.alias("b"), F.col("b.id") == F.col("v")).where(_may_link("a", "b", percent)).select("u", "v")

    first, _ = _verified(likely(spokes.select(F.col("id").alias("u"), F.col("hub").alias("v"))), texts, marks, width, percent)

    label = components(first)
    placed = shared.select("key", "id").join(label.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    main = _main(placed)
    brief = marks.select("id", "n", F.transform(F.sequence(F.lit(0), F.lit(PARITY_BITS // 64 - 1)), lambda k: F.aggregate(F.filter("bits", lambda _, j: j % (PARITY_BITS // 64) == k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))).alias("bits"))
    pairs = _open_pairs(placed, main.where(F.col("kinds") <= MOST_OPEN), brief, percent)
    crowded = main.where(F.col("kinds") > MOST_OPEN).select("key")
    deep, deep_path = stored_at(placed.join(crowded, "key", "left_semi").select("id", "c").distinct(), "ngram-deep")
    let_go(spark)
    if not deep.isEmpty():
        rare = _rare_keys(deep, texts, marks, width, percent)
        pairs = pairs.unionByName(_open_pairs(rare, _main(rare), brief, percent))
    second, _ = _verified(likely(pairs), texts, marks, width, percent)
    forget(spark, deep_path)

    label = components(first.union(second)).select(F.col("u").alias("id"), F.col("v").alias("c"))
    linked = groups.join(label, "id", "left").select("h1", "h2", F.coalesce("c", "id").alias("c"), "least")
    least = linked.groupBy("c").agg(F.min("least").alias("component_id"))
    return slim, linked.join(least, "c").select("h1", "h2", "c", "component_id")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the least doc_id that links lead to, its own included.

    Two rows link when their sets share at least ``percent`` % (50 to 100) of their union. Null and empty texts have an
    empty set, link with nothing and are their own component. Repeated rows are copies and share a component; so do rows of
    one id only if their texts link. A null id counts only where a component has no other. Ties between equally good hubs
    or segments go to the least number and don't change the result. A text is read whole: a task holds a slice of rows and
    the sets of the one text it is at. An empty table gives an empty result. Only the two named columns are read, so others
    cannot clash.
    """
    rows, sets = _groups(docs, id_col, text_col, width, percent)
    out = rows.join(sets, (rows["h1"] == sets["h1"]) & (rows["h2"] == sets["h2"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when each component keeps one: that of least id.

    It is decided by row, so one of several texts of an id can go and another stay. Null ids come last; of several texts of
    the least id one is picked by a hash. Rows that repeat both id and text stay once (if their other columns differ, one of
    them). Rows without a word (null and empty texts too) have no links and all stay. An empty table gives an empty result.
    Any columns may be there, whatever their names. What goes is known by id and hash of the text; a filter of bounded size
    tells which rows must be joined with it, so most texts are not shuffled.
    """
    rows, sets = _groups(docs, id_col, text_col, width, percent)
    placed = rows.where("n > 0").join(sets, ["h1", "h2"]).select("doc_id", "name", "c")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")
    kept = placed.groupBy("c").agg(F.min(order).alias("kept"))
    told = placed.join(kept, "c").groupBy("doc_id", "name").agg(F.first(F.col("kept.name").eqNullSafe(F.col("name")) & F.col("kept.doc_id").eqNullSafe(F.col("doc_id"))).alias("stays"), F.count("*").alias("times"))
    told = told.where("NOT stays OR times > 1")
    name, gone_id, gone_name = (unused(docs.columns, n) for n in ("row_name", "gone_id", "gone_name"))
    told = stored(told.select(F.col("doc_id").alias(gone_id), F.col("name").alias(gone_name), "stays"), "ngram-gone")
    let_go(docs.sparkSession)
    gone, again = told.where("NOT stays").drop("stays"), told.where("stays").drop("stays")
    passes = name_test(told.select(gone_name))
    named = docs.withColumn(name, _named(docs, id_col, text_col))
    same = (F.col(name) == F.col(gone_name)) & F.col(id_col).cast("long").eqNullSafe(F.col(gone_id))
    asked_for = F.arrow_udf(lambda names: pa.array(passes(names.to_numpy())), "boolean")
    rest, asked = named.where(~asked_for(name)), named.where(asked_for(name))  # most rows are told by the filter and stay in place
    out = asked.join(gone, same, "left_anti")
    if not again.isEmpty():
        once = out.join(again, same, "left_semi").dropDuplicates([id_col, name])
        out = out.join(again, same, "left_anti").unionByName(once)
    return rest.unionByName(out).drop(name)


__all__ = ["keys_of", "link_documents", "one_of_each_group", "shingles"]
