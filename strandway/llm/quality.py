"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a ratio of a text in thousandths. A labelled document of quality 1 that the rules of its stratum (its
language) reject is a false rejection. The labelled documents are split by a hash of their id. A third of them, the
fitting part, proposes for each stratum and rule the cutoff with the most rejected quality-0 documents, less ``cost``
for each false rejection, orders the rules by that gain and leaves out those that add none to the ones before. The rest is the holdout: rules are added in that order,
and a step is allowed while the exact binomial bound shows that all rules so far together reject falsely at a rate of
at most ``risk``, at confidence ``1 - delta / strata``. The order doesn't depend on the holdout, so testing stops at
the first failure and needs no further correction within a stratum (a fixed sequence); across strata it is
Bonferroni's. With no false rejection, ln(strata / delta) / -ln(1 - risk) good holdout labels are enough, 86 for four
strata; a stratum with fewer has no rule, which ``used`` tells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = 1000
#: Strata up to which the cutoffs are broadcast (a few numbers each); with more, they are joined by a shuffle.
BROADCAST_STRATA = 10_000
RULES = ("symbols", "upper", "marks", "long_words", "dup_lines", "repeats")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the base counts of every whole text and each rule's ratio.

    A null text has no words. Columns of ``docs`` that have the names of new ones are replaced, other columns stay
    whatever their names; repeated rows are measured alike and an empty table gives no rows. n_repeat_words counts the words that lie in a window of three words found twice or more.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_marks", "n_repeat_words", *[f"r_{r}" for r in RULES], "base_failed"]
    rest = [c for c in docs.columns if c not in new]
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumn("_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")).withColumn("_lines", lines)
    solid = F.length(_without(text, SPACE))
    a = a.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": solid.cast("long"),
            "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_upper": (F.length(text) - F.length(_without(text, UPPER))).cast("long"),
            "n_marks": (F.length(text) - F.length(_without(text, "!?"))).cast("long"),
            "_windows": F.when(
                F.size("_words") > 2,
                F.transform(F.sequence(F.lit(1), F.size("_words") - 2), lambda i: F.concat_ws(" ", F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2))),
            ),
        }
    ).drop("_lines", "_words")
    # only texts with a repeated window pay for the sort
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    a = a.withColumn("_sorted", F.when(repeated, F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))).drop("_windows")
    n = F.size("_sorted")
    same = F.zip_with(
        F.slice("_sorted", F.lit(1), n - 1), F.slice("_sorted", F.lit(2), n - 1), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>"))
    )
    a = a.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.array_distinct(F.flatten(same))))).drop("_sorted")
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_at", zero, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")))
    a = a.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_at")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(F.floor(part * STEPS / whole), F.lit(STEPS))).otherwise(0).cast("int")

    ratios = {
        "symbols": share(F.col("n_symbols"), F.col("word_chars")),
        "upper": share(F.col("n_upper"), F.col("word_chars")),
        "marks": share(F.col("n_marks"), F.col("word_chars")),
        "long_words": share(F.col("word_chars"), F.col("n_words") * 20),
        "dup_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": share(F.col("n_repeat_words"), F.col("n_words")),
    }
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = a.withColumns({f"r_{k}": v for k, v in ratios.items()}).withColumn("base_failed", base)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], *new)


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 20 on (error under 1e-13)."""
    x = F.greatest(n.cast("double"), F.lit(20.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(19)).cast("int")).cast("double"))).otherwise(series)


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial(n, p) and k < n * p: the term of k, times the sum of its ratios to lower terms.

    The ratios fall faster than a geometric series; terms beyond 40 standard deviations are below any double.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 40).cast("int")
    steps = F.when(reach > 0, F.sequence(F.lit(0), reach - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, j: F.struct(
            (s["sum"] + s["term"] * ((k - j) / (n - k + j + 1)) * ((1 - p) / p)).alias("sum"),
            (s["term"] * ((k - j) / (n - k + j + 1)) * ((1 - p) / p)).alias("term"),
        ),
    )
    return top + F.log(total["sum"])


def cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, cost: int = 20, id_col: str = "doc_id", stratum_col: str = "lang", stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> DataFrame:
    """stratum, step, rule, cutoff, good, false_rejections, bad_rejections, used: the rules of each stratum in order,
    with the holdout's good documents and what the rules up to this step reject of it.

    A document with several labels counts with its lowest quality; labels without a document or a quality don't count.
    A rule that gains nothing in the fitting part has no row. Null strata form a stratum named ''. No labels give no
    rows. ``stage`` writes the labelled documents' ratios and the proposed rules to the shared folder.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") > 0).alias("good"))
    ratios = F.array(*[F.col(f"r_{r}") for r in RULES])
    rows = measured.where(~F.col("base_failed")).select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), ratios.alias("bins"))
    part = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 8), 16, 10).cast("long") % 3
    held = stage(rows.join(marks, "_id").select("stratum", "good", "bins", (part == 0).alias("fitting")), "held")

    bins = held.where("fitting").select("stratum", "good", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    above = W.partitionBy("stratum", "rule").orderBy("bin").rowsBetween(1, W.unboundedFollowing)  # bins are at most STEPS + 1
    # any cutoff up to the next bin rejects the same documents: the middle is taken
    between = F.coalesce(F.floor((F.col("bin") + F.lead("bin").over(W.partitionBy("stratum", "rule").orderBy("bin")) - 1) / 2), F.col("bin")).cast("int")
    gains = bins.withColumns({"gain": F.coalesce(F.sum("bad").over(above), F.lit(0)) - cost * F.coalesce(F.sum("good").over(above), F.lit(0)), "cutoff": between})
    best = gains.where("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b"))
    ordered = lambda order: F.row_number().over(W.partitionBy("stratum").orderBy(*order)).alias("step")
    path = stage(best.select("stratum", "rule", "b.cutoff", ordered([F.desc("b.gain"), "rule"])), "proposed")

    def by_step(rows: DataFrame, path: DataFrame) -> DataFrame:
        """Good and bad documents by the first step that rejects them, null for none."""
        paths = path.groupBy("stratum").agg(F.collect_list(F.struct("step", "rule", "cutoff")).alias("path"))  # one entry a rule
        paths = F.broadcast(paths) if path.count() <= BROADCAST_STRATA else paths
        over = F.filter("path", lambda x: F.element_at("bins", x["rule"] + 1) > x["cutoff"])
        first = rows.join(paths, "stratum").select("stratum", "good", F.array_min(F.transform(over, lambda x: x["step"])).alias("step"))
        return first.groupBy("stratum", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))

    more = by_step(held.where("fitting"), path).where(F.col("bad") > cost * F.col("good")).select("stratum", "step")
    path = stage(path.join(more, ["stratum", "step"], "left_semi").select("stratum", "rule", "cutoff", ordered(["step"])), "path")
    counts = by_step(held.where("NOT fitting"), path)
    totals = counts.groupBy("stratum").agg(F.sum("good").alias("n"))
    strata = held.select("stratum").distinct().agg(F.count("*").alias("strata"))
    upto = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    steps = (
        path.join(counts, ["stratum", "step"], "left")
        .join(totals, "stratum", "left")
        .crossJoin(F.broadcast(strata))
        .withColumns({"n": F.coalesce("n", F.lit(0)), "false": F.coalesce(F.sum("good").over(upto), F.lit(0)), "caught": F.coalesce(F.sum("bad").over(upto), F.lit(0))})
        .withColumn("bound", F.when(F.col("false") < F.col("n") * risk, log_binomial_cdf(F.col("false"), F.col("n"), risk)))
        .withColumn("used", F.every(F.coalesce(F.col("bound") <= F.log(F.lit(delta) / F.col("strata")), F.lit(False))).over(upto))
    )
    names = F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("rule") + 1)
    return steps.select("stratum", "step", names.alias("rule"), "cutoff", F.col("n").alias("good"), F.col("false").alias("false_rejections"), F.col("caught").alias("bad_rejections"), "used")


def judge(measured: DataFrame, chosen: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with n_rules (long, the rules in use for its stratum), rejected_by (the first of them in RULES that
    a ratio is over, else null) and kept: false where the base fails or a rule rejects."""
    wide = chosen.where("used").groupBy(F.col("stratum").alias("_stratum")).agg(F.count("*").alias("n_rules"), *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in RULES])
    if wide.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    joined = measured.drop("n_rules").join(wide, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) == F.col("_stratum"), "left")
    by = F.coalesce(*[F.when(F.col(f"r_{r}") > F.col(f"_c_{r}"), r) for r in RULES])
    out = joined.withColumns({"n_rules": F.coalesce("n_rules", F.lit(0)), "rejected_by": by})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("_stratum", *[f"_c_{r}" for r in RULES])
