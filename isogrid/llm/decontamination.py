"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds a posting (term, row, pos) for every place of a document where a word stands that any test item has, and one
head posting a document. It is written once, in the order of the documents, so building it shuffles nothing. A test window is
looked up from its rarest term: each of that term's postings, less the term's offset in the window, is a place where the
window may start. These lists meet those of the window's next rarest term, offset-adjusted alike, and what is left meets those
of all its other terms. A window whose terms are all found where they belong is a phrase match; one of which most terms are
found near there is a proximity match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Fixed values of the query: words after lower-casing A to Z, and the words of a window.
TERM_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: A proximity match has this share of the window's terms, each this many words at most from where the phrase has it.
NEAR_SHARE, SLACK = 0.8, 2
#: A side of so many rows at most (numbers and single words) is broadcast; a larger one is shuffled.
MOST_BROADCAST = 1_000_000
#: The term of a document's head posting; positions are joined by stretches of so many words.
HEAD, STRETCH = -1, 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TestIndex:
    """Postings of the documents (term, row, pos, doc_id, n_words), the windows' terms from the rarest on, and their items."""

    postings: DataFrame
    windows: DataFrame
    owners: DataFrame


def terms_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM_RE), F.lit(0)), F.array().cast("array<string>"))


def small_broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows, marked for a broadcast if a count finds them to be few enough; else the planner joins them by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def test_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(window, words) of the distinct windows and (window, item) of those that have them; an item of fewer words is one."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), terms_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    each = stored(words.select("item", F.explode(F.transform(starts, lambda s: F.slice("all", s, window))).alias("words")).distinct(), "test-windows")
    windows = stored(each.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "test-window-names")
    return windows, each.join(windows, "words").select("window", "item")


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> TestIndex:
    """The index of the documents for the windows of the items.

    A window with a term that no document has is left out, as it can't occur. Terms of a window are in order of how often
    the documents have them.
    """
    windows, owners = test_windows(items, item_col, item_text_col, window)
    places = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    terms = stored(places.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "test-terms")
    heads = terms.sparkSession.createDataFrame([("", HEAD)], "word string, term long")
    found = terms_of(F.col(text_col))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), found.alias("words"))
    placed = texts.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    postings = stored(placed.join(small_broadcast(terms.union(heads)), "word").select("term", "row", "pos", "doc_id", "n_words"), "postings")
    counts = postings.where(F.col("term") != HEAD).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = places.join(terms, "word").join(counts, "term").groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("places"))
    return TestIndex(postings, stored(ranked.where(F.size("places") == F.col("length")), "test-plans"), owners)


def _met(wanted: DataFrame, postings: DataFrame, slack: int) -> DataFrame:
    """wanted (row, term, at, ...) by postings of the same row and term at most ``slack`` places off, with the distance ``off``.

    Joined by stretches of positions, so that a frequent term of a long document makes no pairs of far places.
    """
    stretch = lambda c: F.floor(c / STRETCH)
    asked = wanted.withColumn("stretch", F.explode(F.sequence(stretch(F.col("at") - slack), stretch(F.col("at") + slack))))
    have = postings.select("row", "term", "pos", stretch(F.col("pos")).alias("stretch"))
    return asked.join(have, ["row", "term", "stretch"]).withColumn("off", F.abs(F.col("pos") - F.col("at"))).where(F.col("off") <= slack).drop("stretch", "pos")


def matches(index: TestIndex, slack: int = SLACK, share: float = NEAR_SHARE) -> DataFrame:
    """row, window, start (1 is the first word), length, exact, n_found: the phrase and proximity matches.

    exact: the window's words follow each other from ``start`` on. Every other row is a proximity match: with its rarest term
    in place, the next rarest and at least ``share`` of all its terms are within ``slack`` words of theirs.
    """
    place = lambda k: F.get("places", F.lit(k))
    anchors = index.windows.select("window", "length", "places", place(0)["term"].alias("term"), place(0)["offset"].alias("first"))
    rarest = index.postings.join(small_broadcast(anchors, MOST_BROADCAST // 10), "term")
    start = F.col("pos") - F.col("first")
    begun = rarest.where((start >= 1 - slack) & (start + F.col("length") - 1 <= F.col("n_words") + slack)).select("row", "window", start.alias("start"), "length", "places")
    alone = begun.where("length = 1").select("row", "window", "start", "length", "places", F.lit(0).alias("off"))
    second = begun.where("length > 1").select("*", place(1)["term"].alias("term"), (F.col("start") + place(1)["offset"]).alias("at"))
    seconds = index.windows.where("length > 1").select(place(1)["term"].alias("term")).distinct()
    met = _met(second, index.postings.join(small_broadcast(seconds), "term", "left_semi"), slack)
    key = ["row", "window", "start", "length"]
    pairs = met.groupBy(*key, "places").agg(F.min("off").alias("off")).unionByName(alone)
    pairs = stored(pairs, "test-pairs")
    rows = small_broadcast(pairs.where("length > 2").select("row").distinct())
    others = pairs.where("length > 2").select(*key, F.explode(F.slice("places", F.lit(3), F.col("length"))).alias("p")).select(*key, "p.offset", "p.term", (F.col("start") + F.col("p.offset")).alias("at"))
    near = _met(others, index.postings.join(rows, "row", "left_semi"), slack).groupBy(*key, "offset").agg(F.min("off").alias("off"))
    both = near.select(*key, "off").unionByName(pairs.select(*key, "off"))
    counted = both.groupBy(*key).agg(F.count_if(F.col("off") == 0).alias("n_exact"), F.count(F.lit(1)).alias("n_found"))
    more = F.least(F.col("length") - 1, F.lit(1))  # the rarest term itself, where the next one has been counted
    out = counted.select(*key, (F.col("n_exact") + more == F.col("length")).alias("exact"), (F.col("n_found") + more).cast("int").alias("n_found"))
    return out.where(F.col("exact") | (F.col("n_found") >= F.col("length") * share))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    n_hit counts the words inside any phrase match, n_items the items that have one, n_near_items those with a phrase or a
    proximity match. Null and empty texts have no words and no hits; a null doc_id is an id like others; repeated documents
    count each by itself, items of one id as one, and items of a null id as one that is named by the empty string. Texts of
    any length are taken whole: rows are places, so a long one is spread. Only the named columns are read, so others can't
    clash. Without documents the result is empty; without items nothing is hit.
    """
    index = build_index(docs, items, id_col, text_col, item_col, item_text_col, window)
    found = stored(matches(index), "test-matches")
    exact = found.where("exact")
    line = Window.partitionBy("row").orderBy("start", "length", "window").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = exact.select("row", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(line), F.lit(0)))).alias("fresh"))
    hit = covered.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    owned = found.groupBy("row", "window").agg(F.max("exact").alias("exact")).join(small_broadcast(index.owners), "window").groupBy("row", "item").agg(F.max("exact").alias("exact"))
    names = F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item"))))
    by_row = owned.groupBy("row").agg(F.count_if("exact").alias("n_items"), names.alias("items"), F.count(F.lit(1)).alias("n_near_items"))
    rows = index.postings.where(F.col("term") == HEAD).join(hit, "row", "left").join(by_row, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    sha = F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), sha.alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))
