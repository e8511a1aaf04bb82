"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents queue in a shuffled order, up to three times over. A packet's virtual finish time is its source's
words up to and with it, over the source's target. A document is one packet, but the one that its source's target falls
into is two, cut at that word. All packets are sorted by finish time over all sources, their words are added up in that
order, and what lies beyond the total budget is cut off. As the targets add up to the budget, that is at virtual time 1,
where each source has sent its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import PREFIX_BUCKETS, WORD_RE, shuffled, stored, unused, with_prefix_sums

#: Fixed values of the query: weights given to the sources in code-point order, and the most times a document is used.
WEIGHTS = (1.0, 2.0, 3.0)
MOST_USES = 3
SEED = "mix"


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_uses: int = MOST_USES) -> DataFrame:
    """source, source_size -> with ``target``: shares of the total by weight, none above most_uses times its size.

    Capped sources are those of least size by weight. Sorted so, the level of the others after capping the first k is
    (total - caps) / (weights left); the first k whose next source stays below its cap gives the answer. The windows
    run over one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weighed = (
        sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", most_uses * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    left = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_words"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_weights"),
    ).withColumn("_level", F.col("_words") / F.col("_weights"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return left.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_w") * level, F.lit(0.0))).alias("target"))


def _served(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], most_uses: int) -> DataFrame:
    """doc_id, source, name (of id, source and text), size, source_size, target, taken, first_finish of each row."""
    named = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), named.alias("name"), n_words(F.col(text_col)).alias("size"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "order": shuffled(F.col("doc_id"), SEED)})
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    queued = with_prefix_sums(rows, ["source"], "order", ["doc_id", "size"], {"before": "size"})
    budget = F.sum("source_size").over(Window.partitionBy()).alias("budget")
    goal = source_targets(sizes, weights, most_uses).select(F.col("source").alias("of"), "source_size", "target", F.round("target").cast("long").alias("goal"), budget)
    placed = queued.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def packets(use: Column) -> Column:
        """The packets of one use; none where it starts when its source has sent all it may."""
        start = use * F.col("source_size") + F.col("before")
        end, goal = start + F.col("size"), F.col("goal")
        one = lambda words, upto: F.struct(use.alias("use"), words.alias("words"), (upto.cast("double") / F.greatest(goal, F.lit(1))).alias("finish"))
        none = F.filter(F.array(one(F.col("size"), end)), lambda _: F.lit(False))
        return F.when((F.col("size") == 0) | (start >= goal), none).when(end > goal, F.array(one(goal - start, goal), one(end - goal, end))).otherwise(F.array(one(F.col("size"), end)))

    uses = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most_uses - 1).cast("long")), packets))
    sent = placed.select("*", F.explode_outer(uses).alias("packet")).select("*", "packet.use", "packet.finish", F.coalesce("packet.words", F.lit(0).cast("long")).alias("words")).drop("packet")
    unsent = PREFIX_BUCKETS + 2 + F.pmod(F.hash("row"), F.lit(PREFIX_BUCKETS))  # rows without a packet come last and are spread
    time = F.when(F.col("finish").isNull(), unsent).otherwise(F.least(F.floor(F.col("finish") * PREFIX_BUCKETS), F.lit(PREFIX_BUCKETS + 1)))
    line = with_prefix_sums(sent, [], "finish", ["order", "doc_id", "size", "use"], {"ahead": "words"}, time)
    served = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("ahead")))
    finish = F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("before") + F.col("size")) / F.when(F.col("target") > 0, F.col("target")))
    by_row = line.withColumn("first_finish", finish).groupBy("row", "doc_id", "source", "name", "size", "source_size", "target", "first_finish").agg(F.sum(served).cast("long").alias("taken"))
    return by_row.drop("row")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most_uses: int = MOST_USES) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, first_finish; in order of finish.

    taken: words the mix takes, repeats counted; a source's sum is its target, but for the rounding of all targets to whole
    words. Null and empty texts have size 0 and are never taken; a null source is a source of its own, a null id an id like
    others. Equal finish times are served in the order of the shuffle, then id and size. Repeated rows queue each by itself.
    Texts of any length are only counted. Only the three named columns are read, so others cannot clash. An empty table
    gives an empty result. Only ids, sources and sizes are shuffled; a hot source's queue is split into ranges of the
    shuffle key, and the line of all packets into ranges of virtual time.
    """
    served = _served(docs, id_col, source_col, text_col, weights, most_uses)
    return served.select("doc_id", "source", "size", "source_size", "target", "taken", "first_finish").orderBy(F.col("first_finish").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents of the mix with the columns of ``docs``: a row for each use, the use at the horizon cut after its words.

    A row takes part by itself, also if its id occurs with other texts. Rows that repeat id, source and text are alike to the
    mix: all their uses are there, with the columns of one of them. What is never taken (null and empty texts too) is left
    out. ``chars_col``, if there, is counted anew. A long text is cut in one step, by words. Any other columns may be there,
    whatever their names. An empty table gives an empty result.
    """
    served = _served(docs, id_col, source_col, text_col, WEIGHTS, MOST_USES).where("taken > 0")
    names = [unused(docs.columns, n) for n in ("mix_id", "mix_source", "mix_name", "mix_size", "mix_taken", "mix_times", "mix_rows", "mix_use", "mix_row_name")]
    own_id, own_source, name, size, taken, times, n_rows, use, row_name = names
    alike = served.groupBy("doc_id", "source", "name", "size", "taken").agg(F.count("*").alias("times"))
    rows = F.sum("times").over(Window.partitionBy("name", "doc_id", "source")).alias(n_rows)
    chosen = stored(alike.select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("name").alias(name), F.col("size").alias(size), F.col("taken").alias(taken), F.col("times").alias(times), rows), "mix-chosen")
    named = docs.withColumn(row_name, F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)))
    same = (F.col(row_name) == F.col(name)) & F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(source_col).eqNullSafe(F.col(own_source))
    again = chosen.where(F.col(n_rows) > 1)
    uses = named.join(chosen, same)
    if not again.isEmpty():
        once = named.join(again, same, "left_semi").dropDuplicates([id_col, source_col, row_name]).join(again, same)
        uses = named.join(chosen.where(F.col(n_rows) == 1), same).unionByName(once)
        uses = uses.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words_of_use = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(taken) / F.col(size)) - 1), lambda k: F.least(F.col(size), F.col(taken) - k * F.col(size)).cast("int"))
    each = uses.select(*docs.columns, size, F.explode(words_of_use).alias(use))
    start = F.regexp_extract(text_col, r"(?s)^[\x20\x09-\x0D]*", 0)
    cut = F.concat(start, F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), 1, F.greatest(F.col(use), F.lit(0))), ""))
    text = F.when(F.col(use) < F.col(size), cut).otherwise(F.col(text_col))
    out = each.select(*((text.alias(c) if c == text_col else F.col(c)) for c in docs.columns))
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
