"""Quality rules with robust multivariate outliers, on built-in functions alone.

Base rules count words, symbols, repeated lines and repeated 8-word windows of
each whole text.  What they pass is judged by a minimum-covariance-determinant
estimate of its language and source, as in the fast algorithm for it:

1. *Starts.*  Each group has ``len(STARTS)`` of them: medians with quartile
   spreads, the moments of all rows, and those of two small subsets by a hash of
   the row.
2. *Concentration.*  A step takes the ``CORE`` share of rows with the smallest
   Mahalanobis distances and fits mean and covariance to them again.  All starts
   take ``FIRST_STEPS`` steps; the one with the least determinant goes on until
   its determinant no longer falls (by ``TOLERANCE`` of its logarithm), at most
   ``MOST_STEPS`` steps.
3. *Reweighting.*  The estimate is fitted once more to all rows within the 97.5 %
   quantile of the chi-square distribution.

Core and reweighted covariances are made consistent for normal vectors by the
usual factors.  A row is rejected if its squared distance is beyond ``CUT``, the
quantile of the chi-square distribution at ``1 - 1e-12``: statistics of texts have
heavier tails than normal vectors, and clean documents should stay.

The vector of a text is five transformed statistics (``VECTOR``), rates smoothed
by ``PRIOR`` words.  Counts are noisy: the square root of a rate over ``n`` varies
by ``1 / (4 n)`` for a Poisson count, whatever the rate, and more by ``CLUMPS`` for
lines and words, which repeat several at a time; the logarithm of a mean of ``n``
word lengths varies by ``1 / (16 n)`` where lengths deviate by a quarter of their
mean.  A variance below the mean of its noise over the rows, as that of a part
that most texts have none of, is raised to it: it comes from the data, and keeps
determinants from vanishing.

All are in units of 1/1024: moments are sums of whole numbers, so results do
not depend on how rows are dealt.  Distances are ranked in bins of 1/32 octave.
A step is two aggregations with partial sums over a small table of vectors, at
most a row (or a bounded histogram) for each group and task, so a group may
hold any share of the rows.  Only tables of one row a group are joined to it.

Groups below ``LEAST`` rows (ten a dimension) are judged with their language,
languages below it with all rows, and below it in all, the method keeps what
the base rules pass.

Defined results: a null text has no words and fails; a null language or source
is a value of its own; repeated rows count one by one; extra columns are
ignored (and kept by ``good_documents``); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import unused, written, written_small

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
CORE = 0.75
DIMENSIONS = 5
STARTS = ("medians", "all rows", "one subset", "another subset")
#: Rows of a subset, about.
SUBSET = 10 * DIMENSIONS
FIRST_STEPS, MOST_STEPS = 2, 20
TOLERANCE = 1e-3
PRIOR = 50
LEAST = 10 * DIMENSIONS
SCALE = 1024
NOISE_SCALE = 1 << 20
CLUMPS = 8.0
#: Fixed values for five dimensions: the chi-square quantiles at 0.975 and at
#: 1 - 1e-12, and alpha / P(chi-square of 7 <= quantile of 5 at alpha) for alpha
#: of CORE and of 0.975.
WITHIN = 12.833
CUT = 65.24
CORE_FACTOR, WITHIN_FACTOR = 1.41207, 1.05553


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that a text has twice or more."""

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1), s + WINDOW) - s))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(sorted_: Column) -> Column:
        def start(s: Column, k: Column) -> Column:
            left, right = F.get(sorted_, k - 1), F.get(sorted_, k + 1)
            same = F.coalesce(left["g"] == s["g"], F.lit(False)) | F.coalesce(right["g"] == s["g"], F.lit(False))
            return F.when(same, s["i"])

        return _let(F.array_sort(F.filter(F.transform(sorted_, start), lambda x: x.isNotNull())), covered)

    def count(grams: Column) -> Column:
        placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(F.array_sort(placed), repeated))

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(grams, count))


def base_statistics(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, ``extra`` columns, lang, source and the counts of the base rules."""
    has = set(docs.columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *extra,
        *((F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c in has else F.lit("\0")).alias(c) for c in ("lang", "source")),
        text.alias("text"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    split = named.select(
        "doc_id", *extra, "lang", "source",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.when(F.instr("text", "\n") > 0, _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    return split.select(
        "doc_id", *extra, "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_upper", "n_dup_lines",
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vector() -> list[Column]:
    """Transformed statistics: word length, and rates of symbols, capitals,
    repeated lines and repeated words."""
    words = F.col("n_words") + PRIOR
    parts = [
        F.log((F.col("word_chars") + 5 * PRIOR) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_upper") / (F.col("word_chars") + 5 * PRIOR)),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    noise = [F.round(NOISE_SCALE / (4 * n)).cast("long").alias(f"noise{i}") for i, n in enumerate((words, F.col("word_chars") + 5 * PRIOR))]
    return [*(F.round(x * SCALE).cast("long").alias(f"v{i}") for i, x in enumerate(parts)), *noise]


VECTOR = ("log word length", "symbols", "capitals", "repeated lines", "repeated words")
PARTS = [f"v{i}" for i in range(DIMENSIONS)]
#: The noise of each part: a mean and a factor.
NOISE = (("noise0", 0.25), ("noise0", 1.0), ("noise1", 1.0), ("noise0", CLUMPS), ("noise0", CLUMPS))
NOISES = ["noise0", "noise1"]


#: Expressions are text from here on: one call to the JVM each, where columns
#: built part by part take thousands for each step.
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
_NOISES = [f"{c} / n / {NOISE_SCALE} AS {c}" for c in NOISES]


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and consistent covariance of each key's rows, in partial sums."""
    sums = [*(f"sum({c}) AS {c}" for c in NOISES), *(f"sum(v{i}) AS s{i}" for i in range(DIMENSIONS)), *(f"sum(v{i} * v{j}) AS p{i}{j}" for i, j in _PAIRS)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *map(F.expr, sums))
    means = [f"s{i} / n / {SCALE}D AS m{i}" for i in range(DIMENSIONS)]
    return found.selectExpr(*keys, *_NOISES, *means, *(f"{factor}D * (p{i}{j} / n / {SCALE * SCALE}D - m{i} * m{j}) AS c{i}{j}" for i, j in _PAIRS))


def _factored(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Raises variances to their noise and inverts the Cholesky factor: columns w00 to w44 turn a
    centred vector into one whose squared length is the Mahalanobis distance;
    ``log_det`` is the logarithm of the covariance's determinant."""
    factor = []
    for j in range(DIMENSIONS):  # a column of the factor from those before it
        for i in range(j, DIMENSIONS):
            rest = f"greatest(c{i}{j}, {NOISE[i][1]}D * {NOISE[i][0]})" if i == j else f"c{i}{j}"
            rest = " - ".join([rest, *(f"l{i}{k} * l{j}{k}" for k in range(j))])
            factor.append(f"sqrt(greatest({rest}, 1e-9D)) AS l{j}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    inverse = []
    for d in range(DIMENSIONS):  # a diagonal of the inverse from those nearer the middle
        for j in range(DIMENSIONS - d):
            rest = " - ".join([f"{float(d == 0)}D", *(f"l{j + d}{k} * w{k}{j}" for k in range(j, j + d))])
            inverse.append(f"({rest}) / l{j + d}{j + d} AS w{j + d}{j}")
    log_det = "2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(DIMENSIONS)) + ") AS log_det"
    means = [f"m{i}" for i in range(DIMENSIONS)]
    return moments.selectExpr(*keys, *means, *factor, *inverse, log_det).select(*keys, "log_det", *FITTED)


FITTED = [*(f"m{i}" for i in range(DIMENSIONS)), *(f"w{i}{j}" for i, j in _PAIRS)]
_CENTRED = [f"(v{j} / {SCALE}D - m{j})" for j in range(DIMENSIONS)]
DISTANCE = " + ".join(f"pow({' + '.join(f'w{i}{j} * {_CENTRED[j]}' for j in range(i + 1))}, 2)" for i in range(DIMENSIONS))
#: 32 bins to an octave, from 2**-20 up to 2**40.
BIN = f"bigint(floor(32 * log2(least(greatest({DISTANCE}, {2.0**-20!r}D), {2.0**40!r}D)))) AS bin"


def _starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, start, log_det and fit) of each group and start."""
    quartiles = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in NOISES), *(F.percentile(c, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, c in enumerate(PARTS)))
    spread = [f"{f'pow((q{i}[2] - q{i}[0]) / {SCALE}D / 1.349D, 2)' if i == j else '0D'} AS c{i}{j}" for i, j in _PAIRS]
    medians = quartiles.selectExpr("group", "0 AS start", *_NOISES, *(f"q{i}[1] / {SCALE}D AS m{i}" for i in range(DIMENSIONS)), *spread)
    subset = F.pmod(F.xxhash64(*PARTS), F.greatest(F.col("rows") / SUBSET, F.lit(1.0)).cast("long"))
    of = rows.join(sizes, "group").withColumn("start", F.explode(F.filter(F.array(F.lit(1), F.when(subset == 0, 2), F.when((subset == 1) | (F.col("rows") < 2 * SUBSET), 3)), lambda s: s.isNotNull())))
    keys = ["group", "start"]
    return _factored(medians, keys).unionByName(_factored(_moments(of, keys, 1.0), keys))


def _step(rows: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """One concentration step: the fit to the core of the last fit's distances."""
    placed = rows.join(fit, "group").selectExpr(*keys, *PARTS, *NOISES, BIN)
    # As a table of known size it is broadcast where it is small, so the rows need no shuffle.
    core = written_small(placed.groupBy(*keys).agg(F.expr(f"percentile_disc({CORE}) WITHIN GROUP (ORDER BY bin)").cast("long").alias("last")), "quality-core")
    kept = placed.join(core, keys).where(F.col("bin") <= F.col("last"))
    return written_small(_factored(_moments(kept, keys, CORE_FACTOR), keys), "quality-fit")


def estimate(rows: DataFrame) -> DataFrame:
    """(group, log_det, steps, fit): the reweighted minimum-covariance-determinant
    estimate of each group of ``rows`` (group, v0 to v4, noise0, noise1)."""
    sizes = written_small(rows.groupBy("group").agg(F.count("*").alias("rows")), "quality-sizes")
    keys = ["group", "start"]
    fit = written_small(_starts(rows, sizes), "quality-fit")
    for _ in range(FIRST_STEPS):
        fit = _step(rows, fit, keys)
    least = fit.groupBy("group").agg(F.min_by(F.struct("log_det", *FITTED), F.struct("log_det", "start")).alias("x")).select("group", "x.*")
    fit = written_small(least.withColumns({"steps": F.lit(FIRST_STEPS), "open": F.lit(True)}), "quality-fit")
    for step in range(FIRST_STEPS + 1, MOST_STEPS + 1):
        now = fit.where("open").select("group", "log_det", *FITTED)
        if now.isEmpty():
            break
        # Groups that are done have no part in the step: the join leaves their rows out.
        then = _step(rows, now.drop("log_det"), ["group"]).select("group", F.struct("log_det", *FITTED).alias("then"))
        falls = F.col("then.log_det") < F.col("log_det") - TOLERANCE
        both = fit.join(then, "group", "left").withColumn("falls", F.coalesce(F.col("open") & falls, F.lit(False)))
        # Whichever determinant is less stays.
        lower = F.coalesce(F.col("open") & (F.col("then.log_det") < F.col("log_det")), F.lit(False))
        fit = written_small(both.select("group", *(F.when(lower, F.col(f"then.{c}")).otherwise(F.col(c)).alias(c) for c in ("log_det", *FITTED)), F.when(F.col("open"), step).otherwise(F.col("steps")).alias("steps"), F.col("falls").alias("open")), "quality-fit")
    within = rows.join(fit.select("group", *FITTED), "group").where(f"{DISTANCE} <= {WITHIN}D").select("group", *PARTS, *NOISES)
    last = _factored(_moments(within, ["group"], WITHIN_FACTOR), ["group"])
    # Some row is within: distances of the core are below DIMENSIONS in the mean.
    return written_small(fit.select("group", "log_det", "steps").join(last.drop("log_det"), "group"), "quality-fit")


def _groups(rows: DataFrame) -> DataFrame:
    """The group that judges each language and source: itself, its language or
    all rows, the first that has ``LEAST`` rows; null if there is none."""
    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = n.groupBy("lang").agg(F.sum("n").alias("of_lang"))
    all_ = n.agg(F.sum("n").alias("of_all"))
    sizes = n.join(by_lang, "lang").join(F.broadcast(all_))  # one row
    group = (
        F.when(F.col("n") >= LEAST, F.concat(F.lit("s\1"), "lang", F.lit("\1"), "source"))
        .when(F.col("of_lang") >= LEAST, F.concat(F.lit("l\1"), "lang"))
        .when(F.col("of_all") >= LEAST, F.lit("a"))
    )
    return sizes.select("lang", "source", group.alias("group"))


def judged(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, ``extra`` columns, the base counts, ``base_failed``, ``distance`` and ``kept``."""
    stats = written(base_statistics(docs, extra).select("*", *_vector()), "quality")
    passed = stats.where("not base_failed")
    groups = written_small(_groups(passed), "quality-groups")
    # Rows of a group fit at their own level: a language's fit has all its rows.
    levels = F.array(F.concat(F.lit("s\1"), "lang", F.lit("\1"), "source"), F.concat(F.lit("l\1"), "lang"), F.lit("a"))
    used = written_small(groups.select("group").where("group is not null").distinct(), "quality-used")
    rows = passed.select(F.explode(levels).alias("group"), *PARTS, *NOISES).join(used, "group", "left_semi")
    fit = estimate(rows)
    found = stats.join(groups, ["lang", "source"], "left").join(fit, "group", "left")
    distance = F.when(~F.col("base_failed"), F.expr(DISTANCE))
    return found.select(
        "doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= CUT, F.lit(True))).alias("kept"),
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns kept.

    A verdict depends on a row's text, language and source alone, so rows join
    their verdicts by two hashes of these, 128 bits together."""
    keys = [F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("doc_id", "text", "lang", "source")]
    tag, check, bad_tag, bad_check = unused(docs, "row_tag", "row_check", "bad_tag", "bad_check")
    hashes = F.xxhash64(*keys), F.xxhash64(F.lit("\1"), *reversed(keys))
    # The first hash stands in for the id, the second travels with it.
    tagged = docs.select(hashes[0].alias("doc_id"), hashes[1].alias("check"), *(k.alias(c) for k, c in zip(keys[1:], ("text", "lang", "source"), strict=True)))
    bad = judged(tagged, ["check"]).where("not kept").select(F.col("doc_id").alias(bad_tag), F.col("check").alias(bad_check)).distinct()
    keyed = docs.withColumns({tag: hashes[0], check: hashes[1]})
    return keyed.join(bad, (F.col(tag) == F.col(bad_tag)) & (F.col(check) == F.col(bad_check)), "left_anti").select(*docs.columns)
