"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Keys are range-sorted within their source: a source is cut
into key ranges of about `ROWS` rows, sizes are summed per range, and a row's prefix sum is
that of the ranges before plus that inside its own, so that no source is ever one task. A
source gives whole epochs as often as its target holds them, and from one more epoch the
rows before the cut at exactly the rest; the row at the cut gives a part of itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import written

WEIGHTS, MOST_EPOCHS, ROWS = (5, 2, 1), 3, 2048
_KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_: Column, seed: str = "") -> Column:
    """A number in [0, 2^60), the same in each run for one id and seed."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))), 1, _KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, rows, target from one row per source (source, source_size, rows).

    Sources in code point order, null last, have the weights in turn and share the sum of all
    sizes by them. A target stops at `most_epochs` times its source's size and the excess is
    shared again by weight: the level at which no target is above is found by going through
    the sources in the order in which they reach their stop.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    stops = sizes.withColumn("weight", w).withColumn("stop", F.col("source_size") * float(most_epochs))
    stops = stops.withColumn("ratio", F.col("stop") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = stops.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    found = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(everything)["level"]
    return leveled.select(
        "source", "source_size", "rows",
        F.least(F.col("stop"), F.coalesce(found, F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, rows: int = ROWS, seed: str = "",
) -> DataFrame:
    """All rows and columns of `docs`, with source_size, target, taken and epochs.

    `size_col` is a whole number per row, null counts as 0. `taken` is what the mix takes of
    the row, repeats counted: its size once per whole epoch, and what lies before the cut.
    Its sum over a source is the target rounded; no row is taken more than `most_epochs`
    times. Rows of size 0 are never taken. A null source is a source of its own. Rows with
    one id (or none) share a key and are told apart by their size, equal ones by nothing that
    matters. An empty table gives an empty mix. The added columns replace input columns of
    the same name; columns beginning with _mix_ are reserved.
    """
    added = ["source_size", "target", "taken", "epochs"]
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    keyed = docs.drop(*added).withColumns({
        "_mix_source": F.col(source_col), "_mix_size": size, "_mix_key": random_key(F.col(id_col), seed),
    })
    sizes = keyed.groupBy(F.col("_mix_source").alias("source")).agg(
        F.sum("_mix_size").alias("source_size"), F.count("*").alias("rows")
    )
    # one row per source; a join of its own keeps the windows off the documents
    targets = written(source_targets(sizes, weights, most_epochs), "source-targets")
    t = targets.select(
        F.col("source").alias("_mix_own"), "source_size", "target", F.ceil(F.col("rows") / rows).alias("_mix_ranges")
    )
    ranged = keyed.join(t, keyed["_mix_source"].eqNullSafe(t["_mix_own"])).drop("_mix_own").withColumn(
        "_mix_range", F.floor(F.col("_mix_key") / float(1 << _KEY_BITS) * F.col("_mix_ranges"))
    )
    totals = ranged.groupBy("_mix_source", "_mix_range").agg(F.sum("_mix_size").alias("_mix_total"))
    offsets = totals.select(
        F.col("_mix_source").alias("_mix_s"), F.col("_mix_range").alias("_mix_r"),
        (F.sum("_mix_total").over(Window.partitionBy("_mix_source").orderBy("_mix_range")) - F.col("_mix_total")).alias("_mix_offset"),
    )
    inside = Window.partitionBy("_mix_source", "_mix_range").orderBy("_mix_key", F.col(id_col), "_mix_size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_mix_inside", F.sum("_mix_size").over(inside) - F.col("_mix_size"))
    placed = summed.join(
        offsets, summed["_mix_source"].eqNullSafe(offsets["_mix_s"]) & (summed["_mix_range"] == offsets["_mix_r"])
    )
    budget = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(0)
    rest = budget - full * F.col("source_size")
    partial = F.least(F.greatest(rest - F.col("_mix_offset") - F.col("_mix_inside"), F.lit(0)), F.col("_mix_size"))
    return placed.select(
        *[c for c in docs.columns if c not in added], "source_size", "target",
        (full * F.col("_mix_size") + partial).cast("long").alias("taken"), full.cast("long").alias("epochs"),
    )


def mixed_rows(mixed: DataFrame, text_col: str = "text", size_col: str = "size") -> DataFrame:
    """The rows of the mix: each document once per whole epoch, and once up to the cut.

    The row at the cut keeps the words it gives, joined by one space.
    """
    left = F.col("taken") - F.col("epochs") * F.col(size_col)
    cut = F.array_join(F.slice(F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda x: x != ""), F.lit(1), left.cast("int")), " ")
    whole = F.array_repeat(F.col(text_col), F.when(F.col(size_col) > 0, F.col("epochs")).otherwise(0).cast("int"))
    last = F.when(left <= 0, F.array().cast("array<string>")).when(left == F.col(size_col), F.array(text_col)).otherwise(F.array(cut))
    texts = F.concat(whole, last)
    return mixed.withColumn("_copies", texts).withColumn(text_col, F.explode("_copies")).drop("_copies")
