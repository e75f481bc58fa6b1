"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets word and line statistics and one junk score in [0, 1].  A document is
rejected when it fails the fixed base rules, or when its score reaches the cutoff of its
stratum.  Cutoffs come from labels:

* labelled texts are split by a hash of the text, so that copies stay together: a quarter
  proposes cutoffs, the other three quarters are the holdout;
* for each stratum and each cutoff of a fixed grid, the holdout's good texts at or above the
  cutoff are false rejections.  The cutoff is admitted when the exact binomial tail
  P(Bin(n, risk) <= k) is at most `error` / (strata * grid): Bonferroni over every test made,
  so all admitted cutoffs keep their false rejection rate at or below `risk` together with
  probability 1 - `error`;
* of the admitted cutoffs the one with the best balance of bad and good rejected texts on the
  proposing quarter is taken, the higher one of equals.  A stratum without an admitted or
  useful cutoff rejects by the base rules only.

Defined cases: a null text has no words (and so fails the base); a null stratum is a stratum
of its own; labels that are null, contradictory (a text labelled both ways counts as good) or
of absent documents are harmless; repeated rows are judged each; an empty table of documents
or labels gives an empty result or base rules only.  Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import GAP, HAS_WORD, SPACES, column, read, saved, words

SYMBOLS = "#*$%&|<>"
LOUD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
WINDOW = 5
RISK, ERROR = 0.02, 0.05
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
#: A good text wrongly rejected weighs as much as so many bad texts rightly rejected.
PRICE = 4.0

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` packed into a struct `row`, beside the statistics, `base_failed` and `score`.

    Each step is a projection of its own: what it derives is used several times in the next.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words(body).alias("w"),
                       F.filter(F.split(body, "\n", -1), lambda line: line.rlike(HAS_WORD)).alias("lines"),
                       body.alias("t"))
    lost = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    step = step.select("row", F.size("w").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
                       (F.length("t") - lost(SPACES)).alias("word_chars"), lost(SYMBOLS).alias("n_symbols"),
                       lost(LOUD).alias("n_loud"), F.size("lines").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    at = lambda i: F.get("h", i)
    grams = F.transform(F.slice("h", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0))),
                        lambda h, i: F.xxhash64(h, *[at(i + k) for k in range(1, WINDOW)]))
    rest = ("row", "n_words", "word_chars", "n_symbols", "n_loud", "n_lines", "n_dup_lines")
    step = step.select(*rest, grams.alias("g"))
    # Only texts with a repeated window sort their windows.
    again = F.size(F.array_distinct("g")) < F.size("g")
    pairs = F.when(again, F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    step = step.select(*rest, pairs.alias("p"))
    twin = lambda k, x: F.coalesce(F.get("p", k)["g"] == x["g"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("p", lambda x, k: twin(k - 1, x) | twin(k + 1, x)), lambda x: x["i"]))
    step = step.select(*rest, starts.alias("s"))
    covered = F.transform("s", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("s", k + 1) - p, F.lit(WINDOW))))
    step = step.select(*rest, F.coalesce(F.aggregate(covered, F.lit(0), lambda a, c: a + c), F.lit(0))
                       .alias("n_repeat_words"))
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(4 * share("n_symbols", "word_chars"), share("n_loud", "word_chars"),
                                           share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.select("row", *[F.col(c).cast("long").alias(c) for c in STATS],
                       failed.alias("base_failed"), score.alias("score"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly summed in logarithms; 1 where k >= n p, which no test needs."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(state, i):
        term = state["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(term, state["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(state["sum"] - top))).alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    tail = F.exp(F.aggregate(steps, start, add, lambda s: s["sum"]))
    return F.when(n <= 0, F.lit(1.0)).when(k >= n * p, F.lit(1.0)).otherwise(tail)


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(stratum, cutoff) from rows (text_key, stratum, score, good): a row per stratum with a cutoff.

    All texts are reduced to counts per stratum and grid step in one aggregate.
    """
    texts = labelled.groupBy("text_key", "stratum").agg(F.max("good").alias("good"), F.max("score").alias("score"))
    steps = F.array(*[F.lit(c) for c in grid])
    told = texts.select("stratum", "good", (F.pmod(F.xxhash64("text_key", F.lit("fold")), F.lit(4)) == 0).alias("proposes"),
                        F.size(F.filter(steps, lambda c: F.col("score") >= c)).alias("reached"))
    per = told.groupBy("stratum", "reached").agg(
        F.count_if(F.col("proposes") & F.col("good")).alias("good_fit"),
        F.count_if(F.col("proposes") & ~F.col("good")).alias("bad_fit"),
        F.count_if(~F.col("proposes") & F.col("good")).alias("good_held"))
    # At most len(grid) + 1 rows per stratum from here on.
    above = Window.partitionBy("stratum").orderBy(F.desc("reached"))
    sums = per.withColumns({c: F.sum(c).over(above) for c in ("good_fit", "bad_fit", "good_held")})
    whole = per.groupBy("stratum").agg(F.sum("good_held").alias("n"))
    strata = whole.agg(F.count(F.lit(1)).alias("strata")).scalar()
    # A step nobody reached exactly has the counts of the next step reached.
    slots = whole.select("stratum", "n", F.posexplode(steps).alias("at", "cutoff"))
    reached = slots.alias("s").join(sums.alias("x"), F.col("s.stratum").eqNullSafe(F.col("x.stratum"))
                                    & (F.col("x.reached") > F.col("s.at")), "left")
    tests = reached.groupBy("s.stratum", "n", "cutoff").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("good_fit", "bad_fit", "good_held")])
    tests = tests.withColumn("level", F.lit(error) / (strata * len(grid)))
    gain = F.col("bad_fit") - F.lit(PRICE) * F.col("good_fit")
    admitted = tests.filter((binomial_tail(F.col("n"), F.col("good_held"), risk) <= F.col("level")) & (gain > 0))
    best = admitted.groupBy("stratum").agg(F.max_by("cutoff", F.struct(gain, F.col("cutoff"))).alias("cutoff"))
    return best


def judged(scored: DataFrame, labels: DataFrame, stratum: str = "lang", **control) -> DataFrame:
    """`scored` (from `with_stats`, stored) with `kept`.

    The labels meet the scores by doc_id; only the stored numbers of labelled rows take part.
    """
    place = scored["row"][stratum] if stratum in scored.schema["row"].dataType.names else F.lit(None).cast("string")
    told = (labels.select(column(labels, "doc_id", "long").alias("label_id"), column(labels, "quality", "int").alias("q"))
            .filter(F.col("q").isNotNull() & F.col("label_id").isNotNull())
            .groupBy("label_id").agg((F.max("q") > 0).alias("good")))
    numbers = scored.select(F.col("row.doc_id").cast("long").alias("label_id"), "text_key",
                            place.cast("string").alias("stratum"), "score")
    chosen = saved(cutoffs(numbers.join(told, "label_id"), **control), "cutoffs")
    # One row per stratum at most; the join broadcasts it only if it is small.
    chosen = chosen.select(F.struct("stratum").alias("place"), "cutoff")
    out = scored.withColumn("place", F.struct(place.cast("string").alias("stratum"))).join(chosen, "place", "left")
    passed = F.col("score") < F.coalesce(F.col("cutoff"), F.lit(2.0))
    return out.withColumn("kept", ~F.col("base_failed") & passed).drop("place")


def score_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The statistics of every document, stored; of the input's columns only `keep` go along."""
    scored = with_stats(docs)
    slim = F.struct(*[F.col("row")[c].alias(c) for c in keep if c in docs.columns])
    key = F.xxhash64(F.col("row.text"))
    return saved(scored.withColumns({"text_key": key, "row": slim}), "quality")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    scored = score_table(read(spark, sf_dir, "documents"), ["doc_id", "lang"])
    out = judged(scored, read(spark, sf_dir, "labels"))
    return out.select("row.doc_id", *STATS, "base_failed", "kept", "score")


def accepted(docs: DataFrame, labels: DataFrame, **control) -> DataFrame:
    """The documents that pass, with their own columns."""
    out = judged(score_table(docs, docs.columns), labels, **control)
    return out.filter("kept").select("row.*")
