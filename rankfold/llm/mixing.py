"""Mixing sources to target weights: complete epochs, then Efraimidis-Spirakis sampling.

Each source has a token target.  It gives ``floor(target / size)`` complete epochs; the rest is
filled in the order of the keys ``-ln(u) / w`` (u uniform from the row's md5, w the document's
quality weight), the smallest first, until the running sum of sizes reaches the rest: sampling
without replacement in proportion to w.

No source is gathered: its keys are cut into bins that hold about equally many rows (through the
exact mean distribution function of the source's weights), bins are summed, and only rows of one
bin are sorted together.  There are at most ``MAX_BINS`` bins for a source, so that the table of
bins stays small; a bin of a large source grows and is then sorted with spilling.

Defined results: null and empty texts have size 0, weight 1 and nothing taken; a null source is
a source of its own, last in order; a null doc_id is drawn like any other; repeated rows are
drawn one by one, and rows that differ in any column, nulls included, are never mistaken for each other; an empty table gives an empty result; further columns are kept by
:func:`mix_documents` and ignored by :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.operators.ordering import positions
from rankfold.session import materialize

SEED = 17
MAX_EPOCHS = 3
BIN_ROWS = 256
MAX_BINS = 4096
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of words: separators between the first and the last word, plus one."""
    words = F.split(text, X.SEPARATOR_PATTERN, -1)
    return F.size(F.filter(words, lambda w: w != "")).cast("bigint")


def quality_level(text: Column, size: Column) -> Column:
    """1 (noisy) to 10: ten less the tenths of symbol and mark characters per word, at most nine."""
    noise = F.length(F.regexp_replace(text, r"[^#*$%&|<>!?]+", ""))
    return F.when(size == 0, F.lit(10)).otherwise(10 - F.least(F.lit(9), F.floor(10 * noise / F.greatest(size, F.lit(1))))).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, total: int | None = None) -> DataFrame:
    """(source, source_size, ..., target): targets share ``total`` (default: all sizes) by weight,
    stop at ``max_epochs`` times the source's size, and the excess is shared again by weight among
    the sources below until none is above.  Sources in code point order, null last, take the
    weights in turn.  Only sums reach the driver."""
    ordered = positions(
        sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], out="rank"
    ).drop("_last")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        ordered.withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int"))).withColumn("target", F.lit(None).cast("double")),
        "sources",
    )
    cap = F.col("source_size").cast("double") * max_epochs
    while True:
        left = table.agg(
            F.sum("source_size").alias("all"), F.sum("target").alias("fixed"),
            F.sum(F.when(F.col("target").isNull(), F.col("weight"))).alias("weight"),
        ).first()
        rest = float((left["all"] or 0) if total is None else total) - (left["fixed"] or 0.0)
        if not left["weight"]:
            return table
        share = F.col("weight") * F.lit(rest / left["weight"])
        open_ = F.col("target").isNull()
        above = open_ & (share > cap)
        if table.where(above).isEmpty():
            return table.withColumn("target", F.when(open_, share).otherwise(F.col("target")))
        table = materialize(table.withColumn("target", F.when(above, cap).otherwise(F.col("target"))), "sources")


def mix(docs: DataFrame, seed: int = SEED, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, level, source_size, target, times, row), one row per row of ``docs``:
    the row appears ``times`` times in the mix.  ``row`` names a column that numbers the rows; the
    result carries it (null without one)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = word_count(text)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("double")
    rows = materialize(
        docs.select(
            F.col("doc_id"), F.col("source"), size.alias("size"), text.alias("_text"), draw.alias("_draw"),
            F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != row]).alias("_tie"),
            (F.col(row) if row else F.lit(None).cast("bigint")).alias("row"),
        )
        .withColumn("level", quality_level(F.col("_text"), F.col("size"))).drop("_text")
        .withColumn("_key", -F.log((F.col("_draw") + 0.5) / F.lit(float(2**52))) / (F.col("level") / 10.0)).drop("_draw"),
        "draws",
    )
    levels = rows.groupBy("source", "level").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    sizes = materialize(
        levels.groupBy("source").agg(
            F.sum("s").alias("source_size"), F.sum("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("level", "n"))).alias("levels"),
        ),
        "levels",
    )
    sources = materialize(
        targets(sizes, weights, max_epochs).select(
            "source", "source_size", "target", "n", "levels",
            F.least(F.ceil(F.col("n") / BIN_ROWS), F.lit(MAX_BINS)).cast("int").alias("bins"),
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int").alias("epochs"),
        ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    below = F.aggregate(
        "levels", F.lit(0.0),
        lambda acc, c: acc + c["n"] / F.col("n") * (1 - F.exp(-F.col("_key") * c["level"] / 10.0)),
    )
    named = sources.withColumnRenamed("source", "_source")
    keyed = materialize(
        rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("bin", F.least(F.floor(below * F.col("bins")).cast("int"), F.col("bins") - 1))
        .drop("levels", "n", "bins"),
        "binned",
    )
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        bins.select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), F.coalesce(F.sum("bin_size").over(order), F.lit(0)).alias("bin_start")),
        "bins",
    )
    within = Window.partitionBy("source", "bin").orderBy("_key", "doc_id", "size", "_tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("bin_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        keyed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin")))
        .withColumn("_before", before)
        .select(
            "doc_id", "source", "size", "level", "source_size", "target",
            (F.col("epochs") + F.when((F.col("size") > 0) & (2 * F.col("_before") + F.col("size") <= 2 * F.col("rest")), 1).otherwise(0)).alias("times"),
            "row",
        )
    )


def mix_documents(docs: DataFrame, seed: int = SEED, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs``, with its columns, as often as it is taken.

    Rows are numbered once, in a written table, and told apart by that number alone."""
    row, times, epoch = (X.free_name(docs.columns, n) for n in ("_row", "_times", "_epoch"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, seed, weights, max_epochs, row).where("times > 0").select(F.col("row").alias(row), F.col("times").alias(times))
    drawn = numbered.join(taken.hint("merge"), row)
    return drawn.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
