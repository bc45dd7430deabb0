"""Quality rules whose verdict keeps false rejections under control, in DataFrame functions only.

Each rule rejects a document when a ratio of its counts is above a cutoff. The cutoffs of all
rules are tightened one after the other in a fixed order of steps, so every step is one
verdict, and it rejects all that the steps before it reject. Per stratum the steps are tested
in that order on labelled good documents: a step holds if so few of them are rejected that a
false rejection rate over `alpha` is excluded by the exact binomial tail at level `delta`
divided by the number of strata. The last step that holds is taken; without one the rules
reject nothing in that stratum. Testing in a fixed order up to the first failure needs no
division by the number of steps. So with probability 1 - delta the verdict rejects no more
than `alpha` of the good documents of any stratum, all rules together.

Trials are distinct texts: copies are no independent evidence. Near copies still count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import written

ALPHA, DELTA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\u000b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rule: ratio of two counts, and its grid of cutoffs, high to low.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "capitals": ("n_capitals", "word_chars", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words", "n_words", (0.9, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "lines": ("n_dup_lines", "n_lines", (0.9, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "length": ("word_chars", "n_words", (60.0, 40.0, 30.0, 20.0, 16.0, 13.0)),
}


def _log_factorial(n: Column) -> Column:
    """Stirling's series ten places up, and the way back by division; right to 1e-13."""
    x = n + 10.0
    series = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (x * 12) - 1 / (x**3 * 360) + 1 / (x**5 * 1260)
    steps = F.lit(1.0)
    for i in range(1, 11):
        steps = steps * (n + float(i))
    return series - F.log(steps)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with probability p, where k is below the mean; else 1.

    The terms from k downwards fall at least geometrically; as many are summed as matter.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    )
    terms = F.least(k, F.ceil(F.sqrt(n * p) * 12) + 50).cast("int")
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        at = k - i + 1
        term = s["term"] * at * (1 - p) / ((n - at + 1) * p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    below = F.aggregate(F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), state, add, lambda s: s["sum"])
    return F.when(n <= 0, 1.0).when(k >= n * p, 1.0).otherwise(F.least(top * below, F.lit(1.0)))


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of words, lines and characters that rules and base use; the text stays.

    n_words, word_chars, n_symbols, n_capitals, n_lines (with a word), n_dup_lines (equal to
    an earlier one), n_repeat_words (in runs of five words that the text holds twice).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def without(chars: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, chars, ""))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumns({
        "_hashes": F.transform(words, lambda x: F.xxhash64(x)), "_lines": lines,
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"), "n_capitals": without(CAPITALS).cast("long"),
    })
    n = F.size("_hashes")
    runs = F.when(n >= 5, F.transform(
        F.sequence(F.lit(0), n - 5),
        lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(5)]),
    ))
    counted = counted.withColumns({
        "n_words": n.cast("long"), "_runs": runs, "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_hashes", "_lines")
    twice = F.size(F.array_distinct("_runs")) < F.size("_runs")
    sorted_runs = F.when(twice, F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.withColumn("_sorted", sorted_runs).drop("_runs")
    alike = F.filter(
        "_sorted",
        lambda x, i: x["h"].eqNullSafe(F.get("_sorted", i - 1)["h"]) | x["h"].eqNullSafe(F.get("_sorted", i + 1)["h"]),
    )
    counted = counted.withColumn("_at", F.sort_array(F.transform(alike, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_at", i + 1) - p, F.lit(5)))),
        F.lit(0), lambda a, x: a + x,
    )
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def _ratio(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(0.0)


def first_steps() -> dict[str, Column]:
    """For each rule the first step at which it rejects, null if it never does.

    Step 0 sets the first rule to the highest cutoff of its grid, the next steps the others;
    then each rule in turn goes to its second cutoff, and so on.
    """
    out = {}
    for place, (rule, (_, _, grid)) in enumerate(RULES.items()):
        reached = F.lit(None).cast("int")
        for level in reversed(range(len(grid))):
            reached = F.when(_ratio(rule) > grid[level], F.lit(level * len(RULES) + place)).otherwise(reached)
        out[rule] = reached
    return out


def controlled_steps(
    good: DataFrame, stratum_col: str, step_col: str, text_col: str, alpha: float = ALPHA, delta: float = DELTA,
    strata: int | None = None,
) -> DataFrame:
    """(stratum, step, n_good, n_rejected): the last step that holds in each stratum that has one.

    `good` has a row per good document: its stratum, the first step that rejects it (null: none),
    and what tells its text from others. `strata` is the number of tests, by default all strata.
    """
    texts = good.groupBy(F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("_text")).agg(
        F.min(step_col).alias("step")
    )
    # rows per stratum: one per step at most
    cells = texts.groupBy("stratum", "step").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = cells.groupBy("stratum").agg(F.sum("n").alias("n_good")).withColumn(
        "tests", F.count("*").over(Window.partitionBy()) if strata is None else F.lit(strata)
    )
    # every step of every stratum, rejecting or not
    last = len(RULES) * max(len(grid) for _, _, grid in RULES.values()) - 1
    steps = known.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(last))))
    rejected = steps.join(cells.where("step is not null"), ["stratum", "step"], "left").withColumn(
        "n_rejected", F.coalesce(F.sum("n").over(upto), F.lit(0))
    )
    # the tail only grows with the step: what holds, holds with all before it
    held = rejected.where(binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha) * F.col("tests") <= delta)
    return held.groupBy("stratum").agg(
        F.max("step").alias("step"), F.max("n_good").alias("n_good"), F.max_by("n_rejected", "step").alias("n_rejected")
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """All rows of `docs` without the text, with counts, base_failed, kept and failed_rules.

    `labels` says by id which documents are good (1). Base: fewer than 10 words, or more
    than a fifth of the words in repeated runs of five. `kept` is false if base fails or a
    rule rejects; of the good documents of a stratum, rules reject no more than `alpha` with
    probability 1 - `delta` over all strata. Null and empty texts have no words and fail. Rows
    without id are judged but teach nothing; a label that occurs twice counts once if any says
    good; rows of one text in one stratum count once. A null stratum is one of its own (with the
    empty one). Empty labels, or too few for any certainty, give no rules: base alone decides.
    The added columns replace input columns of the same name.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "failed_rules"]
    counted = document_counts(docs.drop(*added), text_col).withColumn("_text", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    steps = first_steps()
    counted = counted.withColumns({f"_{r}": step for r, step in steps.items()})
    counts = written(counted.drop(text_col), "document-counts")
    good = labels.groupBy(F.col(id_col).alias("_good_id")).agg(F.max(quality_col).alias("_good")).where("_good = 1")
    known = counts.join(good, F.col(id_col) == F.col("_good_id")).withColumn("_step", F.least(*[F.col(f"_{r}") for r in steps]))
    held = controlled_steps(known, stratum_col, "_step", "_text", alpha, delta)
    # one entry per stratum in which a step holds: each needs many labelled documents
    table = held.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "step")))).scalar()
    upto = F.try_element_at("_steps", F.coalesce(F.col(stratum_col), F.lit("")))
    counts = counts.withColumn("_steps", table).withColumn("_upto", upto)
    failed = F.filter(F.array(*[F.when(F.col(f"_{r}") <= F.col("_upto"), F.lit(r)) for r in steps]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return counts.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    ).drop("_steps", "_upto", "_text", *[f"_{r}" for r in steps])
