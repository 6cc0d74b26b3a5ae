"""Operator 7, native: mix sources to target weights by Pareto order sampling.

Every source gets a target number of words (:func:`targets`).  A source whose target is ``m``
times its size first takes ``floor(m)`` whole copies of each document.  The remaining fraction
``f`` is drawn without replacement with unequal probabilities: document ``i`` has inclusion
probability ``p_i = min(1, c * x_i)`` where ``x_i = ln(1 + size_i)``, and ``c`` is solved for the
expected words to equal what is left, given the documents with ``p_i = 1``, which get their copy for certain.  The
rest are ranked by Pareto's ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of the document, and taken
in that order until the words of the source reach its target (the last one only if that comes
closer).  The sample has a fixed size in words, not in documents: the miss is at most half of one document.

Only DataFrame functions are used.  No source is ever gathered in one task: ranks go into
``BINS`` bins, whose words are summed before they are shuffled, the one bin of each source in which the
target falls into ``BINS`` finer ones, and only the finer one in which it falls is sorted.  Documents meet their source's threshold by a join
on a table with one row per source, which Spark broadcasts only if the stored table is under
``spark.sql.autoBroadcastJoinThreshold``; a larger table is joined by a shuffle that adaptive
execution splits.

Cases: null text has size 0.  A null source is a source of its own, ordered last.  Documents
of size 0 never win a draw (they follow the whole copies alone).  An empty table gives an empty
result.  Rows equal in ``doc_id`` and text have the same rank and share their fate.  Other
columns are kept by :func:`apply_mix` and may have any name not starting with ``__mix_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.llm.common import WORD, store

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 1024
SEED = 20_240_607


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``__mix_size`` (words), ``__mix_x`` (integer ``1024 ln(1 + size)``), ``__mix_u`` in (0, 1)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / F.lit(float(2**53))
    return docs.withColumn("__mix_size", size).withColumn("__mix_x", F.round(F.log1p("__mix_size") * 1024).cast("long")).withColumn("__mix_u", u)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """Words for each source: ``sources`` has ``source``, ``source_size``; adds ``target``.

    Sources in code point order, null last, weigh ``weights`` repeating.  Together they get the
    sum of all sizes.  With sources in the order of ``most * size / weight``, the capped ones
    are a prefix; the water level of the others follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.array(*[F.lit(float(w)) for w in weights])
    t = sources.withColumn("w", F.element_at(at, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * float(most)).withColumn("r", F.col("cap") / F.col("w"))
    by = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), zero)
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
    t = t.withColumn("level", level)
    level = F.first(F.when(F.col("r") >= F.col("level"), F.col("level")), ignorenulls=True).over(every)
    return t.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _ranked(joined: DataFrame) -> DataFrame:
    """Adds ``__mix_sure`` (certain copies) and ``__mix_v``, the Pareto rank mapped into (0, 1); null if it does not take part."""
    p = F.when(F.col("__mix_c") > 0, F.col("__mix_c") * F.col("__mix_x"))
    u = F.col("__mix_u")
    q = (u / (1 - u)) * ((1 - p) / p)
    return joined.withColumn("__mix_sure", F.col("__mix_whole") + F.when(p >= 1, 1).otherwise(0)).withColumn("__mix_v", F.when((p > 0) & (p < 1), q / (1 + q)))


def plan(base: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, bins: int = BINS) -> DataFrame:
    """One stored row per source: sizes, target, whole copies, scale of the probabilities, threshold.

    ``base`` has ``source``, ``__mix_size``, ``__mix_x`` and ``__mix_u`` and is read three times.
    """
    # one row for each source and size: a hot source has as many as it has different sizes
    by_size, _ = store(base.groupBy("source", "__mix_x").agg(F.sum("__mix_size").alias("words"), F.sum(F.col("__mix_size") * F.col("__mix_x")).alias("wx")), "mix-sizes")
    totals = by_size.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = targets(totals, weights, most)
    m = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    t = t.withColumn("__mix_whole", F.floor(m)).withColumn("f", m - F.floor(m))
    left = F.col("f") * F.col("source_size")
    # from the largest documents on, certain ones are set aside until none of the others has c * x above 1
    larger = Window.partitionBy("source").orderBy(F.col("__mix_x").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy(F.col("__mix_x").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sized = by_size.where("__mix_x > 0").select(F.col("source").alias("s2"), "__mix_x", F.coalesce(F.sum("words").over(larger), F.lit(0)).alias("sure"), F.sum("wx").over(smaller).alias("open"))
    solved = sized.join(t, F.col("source").eqNullSafe(F.col("s2"))).select("s2", "__mix_x", ((left - F.col("sure")) / F.col("open")).alias("c"))
    solved = solved.where((F.col("c") >= 0) & (F.col("c") * F.col("__mix_x") <= 1 + 1e-12)).groupBy(F.col("s2").alias("s6")).agg(F.max_by("c", "__mix_x").alias("c"))
    t = t.join(solved, F.col("source").eqNullSafe(F.col("s6")), "left").withColumn("__mix_c", F.coalesce("c", F.lit(0.0)))
    t, _ = store(t.select("source", "source_size", "target", "__mix_whole", "__mix_c"), "mix-sources")

    ranked = _ranked(with_sources(base, t))
    bin_of = F.floor(F.col("__mix_v") * bins)
    sums = ranked.groupBy("source", bin_of.alias("bin")).agg(F.sum(F.col("__mix_size") * F.col("__mix_sure")).alias("sure_words"), F.sum("__mix_size").alias("words"))
    sums, _ = store(sums, "mix-bins")
    sure = sums.groupBy(F.col("source").alias("s3")).agg(F.sum("sure_words").alias("sure_words"))
    rest = t.join(sure, t["source"].eqNullSafe(F.col("s3")), "left").select("source", (F.col("target") - F.coalesce("sure_words", F.lit(0))).alias("rest"))
    edge, _ = store(_edge(sums.where("bin is not null"), rest), "mix-edge")
    fine = F.floor((F.col("__mix_v") * bins - bin_of) * bins)
    inside, _ = store(ranked.join(edge, ranked["source"].eqNullSafe(edge["edge_source"]) & (bin_of == edge["edge_bin"])).select(ranked["source"], "__mix_v", "__mix_size", fine.alias("fine"), "before", "rest"), "mix-inside")
    still = edge.select(F.col("edge_source").alias("source"), (F.col("rest") - F.col("before")).alias("rest"))
    finest = _edge(inside.groupBy("source", F.col("fine").alias("bin")).agg(F.sum("__mix_size").alias("words")), still)
    finest, _ = store(finest.select(F.col("edge_source").alias("fine_source"), F.col("edge_bin").alias("fine_bin"), F.col("before").alias("fine_before")), "mix-fine")
    drawn = inside.join(finest, inside["source"].eqNullSafe(finest["fine_source"]) & (F.col("fine") <= F.col("fine_bin")))
    # whole finer bins before the edge count at once; only the edge is put in order
    running = F.sum("__mix_size").over(Window.partitionBy("source").orderBy("__mix_v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at_edge = drawn.where("fine = fine_bin").select("source", "__mix_v", "__mix_size", "before", "rest", "fine_before", running.alias("running"))
    middle = F.col("before") + F.col("fine_before") + F.col("running") - F.col("__mix_size") / 2
    last = drawn.where("fine < fine_bin").select("source", "__mix_v").unionByName(at_edge.where(middle <= F.col("rest")).select("source", "__mix_v"))
    last = last.groupBy(F.col("source").alias("edge_source")).agg(F.max("__mix_v").alias("__mix_last"))
    limits = edge.select(F.col("edge_source").alias("s5"), F.col("edge_bin").alias("__mix_bin")).join(last, F.col("s5").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    whole = t.join(limits, t["source"].eqNullSafe(F.col("s5")), "left").drop("s5")
    # without an edge there is nothing to draw
    return store(whole.withColumn("__mix_bin", F.coalesce("__mix_bin", F.lit(0))).withColumn("__mix_bins", F.lit(bins)), "mix-plan")[0]


def _edge(sums: DataFrame, rest: DataFrame) -> DataFrame:
    """Of ``sums`` (``source, bin, words``), the bin of each source in which the sum of words comes to ``rest``, and the words before it."""
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sums.select("source", "bin", "words", F.sum("words").over(up_to).alias("upto"))
    r = rest.select(F.col("source").alias("s4"), "rest")
    edge = cum.join(r, cum["source"].eqNullSafe(F.col("s4"))).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    return edge.select(F.col("s4").alias("edge_source"), F.col("bin").alias("edge_bin"), (F.col("upto") - F.col("words")).alias("before"), "rest")


def with_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    table = table.withColumnRenamed("source", "__mix_source")
    return rows.join(table, rows["source"].eqNullSafe(table["__mix_source"])).drop("__mix_source")


def copies(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``__mix_copies`` to measured rows, given the table of :func:`plan`."""
    ranked = _ranked(with_sources(rows, table.select("source", *[F.col(c).alias(f"__mix_{c}") for c in ("source_size", "target")], *[c for c in table.columns if c.startswith("__mix_")])))
    v, b = F.col("__mix_v"), F.floor(F.col("__mix_v") * F.col("__mix_bins"))
    drawn = F.coalesce((b < F.col("__mix_bin")) | ((b == F.col("__mix_bin")) & (v <= F.col("__mix_last"))), F.lit(False))
    return ranked.withColumn("__mix_copies", F.col("__mix_sure") + drawn.cast("long"))


def _base(docs: DataFrame, seed: int) -> DataFrame:
    return store(measured(docs.select("doc_id", "text", "source"), seed).drop("text"), "mix-base")[0]


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs`` (``doc_id, text, source``)."""
    base = _base(docs, seed)
    out = copies(base, plan(base, weights, most))
    return out.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    table = plan(_base(docs, seed), weights, most)
    out = copies(measured(docs, seed), table).where(F.col("__mix_copies") > 0)
    return out.withColumn("__mix_one", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)
