"""Quality rules: base rules, then robust multivariate outliers per language and source.

Text statistics become a vector of four transformed numbers that vary in any prose: marks and word length (deviations
from the group's medians, times the root of the number of words, so that short texts scatter no wider than long ones),
and the logarithms of distinct and of all words, which go together. For each (lang, source) the minimum covariance
determinant is sought as usual: several starts, two concentration steps each, the start with the least determinant
goes on until its determinant rests, then one reweighted step. A concentration step refits on the H share of rows with
the smallest distance. Copies and most near copies (texts whose three least window hashes are equal) count once in the
fit, so that they don't pull it. Rows beyond the cutoff of the final Mahalanobis distance are rejected. Only DataFrame
expressions are used; groups meet as partial sums and histograms, so that a group of any size stays spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import BLANK_CHARS, let, small, words, written
from gridspark.plans.scratch import BROADCAST_ROWS

#: Share of each group's rows, copies counted once, that the estimate rests on.
H = 0.5
#: Starts: medians with half widths, and seeded random subsets of five rows; steps that each start takes.
STARTS, FIRST_STEPS = 4, 2
#: A determinant rests if it falls by less than this share of itself; MOST_STEPS ends a fit that circles.
REST, MOST_STEPS = 1e-3, 50
#: Groups with fewer rows are estimated together: by language, then all together.
LEAST_ROWS = 200
#: Quantiles of chi-squared with 4 degrees of freedom: distances within WEIGHTED take part in the reweighted step,
#: those beyond CUTOFF are rejected. Prose has longer tails than the normal distribution, hence the high quantile.
WEIGHTED_SHARE, CUTOFF_SHARE = 0.975, 1 - 1e-9
#: All of these are of the Unicode classes P and S.
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Counts that the vector is made of, and the two rates that are centred by the group's medians c_0 and c_1.
COUNTS = ["n_words", "word_chars", "n_marks", "n_distinct"]
RATES = ["sqrt((n_marks + 0.5D) / greatest(word_chars, 1))", "ln(greatest(word_chars, 1) / cast(greatest(n_words, 1) as double))"]
VECTOR = [f"sqrt(cast(n_words as double)) * ({r} - c_{i})" for i, r in enumerate(RATES)] + ["ln(cast(greatest(n_distinct, 1) as double))", "ln(cast(greatest(n_words, 1) as double))"]
N = len(VECTOR)
X = [f"x_{i}" for i in range(N)]
FIT = [f"m_{i}" for i in range(N)] + [f"l_{i}{j}" for i in range(N) for j in range(i + 1)]
#: Deviations that coordinates count with that vary less, given those before; in prose all four are above them.
LEAST_DEVIATIONS = (0.1, 0.2, 0.02, 0.02)
#: Bins of a histogram to a unit of the logarithm, for medians and for distances.
FINE, BINS = 2000, 200
#: Bits that hold the start of any window of a text.
START_BITS = 31


def chi_squared(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_squared_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, degrees) < share else (low, middle)
    return low


def correction(share: float) -> float:
    """Factor that makes the covariance of the innermost share of normal rows that of all rows."""
    return share / chi_squared(chi_squared_quantile(share, N), N + 2)


CUTOFF = chi_squared_quantile(CUTOFF_SHARE, N)


def window_hash(a: Column, b: Column, c: Column) -> Column:
    """Hash of a window from those of its words. Windows of equal hashes are compared, so that it decides the work alone."""
    return F.xxhash64(a, b, c)


def _repeats(df: DataFrame) -> DataFrame:
    """df, which has the array _words, with n_repeat_words, words in 3-word windows that occur twice or more, copy_key, a
    hash of the three windows with the least hashes, which copies and most near copies share, and n_distinct words.

    A text whose windows have hashes of their own has none twice. For others a window's hash and start share a long: low
    bits for the start, START_BITS, the rest for the hash. Sorted, windows of equal hashes are neighbours. Those, few in
    prose, are compared word by word, so that the count is exact for a text of any length; the words under the starts
    that are left are then counted in order. Each array is a column of its own: Spark compiles sorting and distinct for
    columns, while within a lambda, or under a function that takes one, it interprets them on boxed values.
    """
    w, h, v, p, q = (F.col(c) for c in ("_words", "_hashes", "_windows", "_packed", "_flagged"))
    hashed = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.coalesce(window_hash(x, F.get(h, i + 1), F.get(h, i + 2)), F.lit(0).cast("long")))
    packed = F.transform(v, lambda x, i: x.bitwiseAND(F.lit(-1 << START_BITS)).bitwiseOR(i.cast("long")))
    same = lambda x, i: F.shiftright(x.bitwiseXOR(F.get(p, i)), START_BITS) == 0
    window = lambda at: F.struct(F.concat_ws(" ", *[F.get(w, (at + k).cast("int")) for k in range(3)]).alias("words"), at.alias("start"))
    flagged = F.transform(F.filter(p, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: window(x.bitwiseAND(F.lit((1 << START_BITS) - 1))))
    beside = lambda x, i: F.coalesce(F.get(q, i)["words"] == x["words"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(q, lambda x, i: beside(x, i - 1) | beside(x, i + 1)), lambda x: x["start"]))
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n"), x.alias("last"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    least = [F.shiftright(F.get("_sorted", F.lit(i)), 24) for i in range(3)]
    return (
        df.withColumn("_hashes", F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn("n_distinct", F.size(F.array_distinct(h)).cast("long"))
        .withColumn("_windows", hashed)
        .withColumn("_sorted", F.sort_array(v))
        .withColumn("copy_key", F.when(F.size(h) < 4, F.xxhash64(h)).otherwise(F.xxhash64(*least)))
        .withColumn("_packed", F.when(F.size(F.array_distinct(v)) < F.size(v), F.sort_array(packed)).otherwise(F.array().cast("array<long>")))
        .withColumn("_flagged", F.sort_array(flagged))
        .withColumn("n_repeat_words", F.aggregate(starts, zero, step)["n"])
        .drop("_hashes", "_windows", "_sorted", "_packed", "_flagged")
    )


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_distinct, copy_key (long):
    characters in words, symbols, repeated lines, words in repeated windows, punctuation and symbols, distinct words,
    what copies share. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = let(F.filter(F.split(t, "\n"), lambda x: F.ltrim(x, F.lit(BLANK_CHARS)) != ""), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    counted = (
        df.withColumn("_words", words(F.col(text)))
        .withColumn("_marks", F.regexp_replace(t, r"[^\p{P}\p{S}]+", ""))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_marks") - F.length(F.translate("_marks", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", lines.cast("long"))
        .withColumn("n_marks", F.length("_marks").cast("long"))
    )
    return _repeats(counted).drop("_words", "_marks").select(*df.columns, *STATISTICS, "n_marks", "n_distinct", "copy_key")


def _quantiles(rows: DataFrame, keys: list[str], values: list[Column], shares: list[float], bins: int) -> DataFrame:
    """keys, and for each value i and share k the column q_i_k: the middle of the least bin (equal steps of
    sign(v) * ln(1 + |v|)) at or below which that share of the rows lies. Exact counts, a bounded histogram."""
    binned = lambda v: (F.signum(v) * F.floor(F.log1p(F.abs(v)) * bins)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), binned(v).alias("bin")) for i, v in enumerate(values)])).alias("v")
    counts = rows.select(*keys, each).groupBy(*keys, "v.i", "v.bin").agg(F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(*keys, "i")
    sums = counts.withColumn("_sum", F.sum("_n").over(one.orderBy("bin"))).withColumn("_all", F.sum("_n").over(one))
    value = F.signum("bin") * F.expm1((F.abs("bin") + F.when(F.col("bin") == 0, 0.0).otherwise(0.5)) / bins)
    found = [F.min(F.when((F.col("i") == i) & (F.col("_sum") >= F.col("_all") * s), value)).alias(f"q_{i}_{k}") for i in range(len(values)) for k, s in enumerate(shares)]
    return sums.groupBy(*keys).agg(*found)


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m_i and the Cholesky factor l_ij of the joined group."""
    y: list[Column] = []
    for i in range(N):
        rest = F.col(X[i]) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * y[j]
        y.append(rest / F.col(f"l_{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _fit(df: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys, means m_i, the Cholesky factor l_ij of the covariance times factor, and log_det, its log determinant."""
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(X)]
    sums += [F.avg(F.col(X[i]) * F.col(X[j])).alias(f"c_{i}{j}") for i in range(N) for j in range(i + 1)]
    fit = df.groupBy(*keys).agg(*sums)
    for i in range(N):
        for j in range(i + 1):
            s = F.round((F.col(f"c_{i}{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor, 9)
            for k in range(j):
                s = s - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            fit = fit.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(s, F.lit(LEAST_DEVIATIONS[i] ** 2))) if i == j else s / F.col(f"l_{j}{j}"))
    logs = [F.ln(F.col(f"l_{i}{i}")) for i in range(N)]
    return fit.select(*keys, *FIT, (2 * sum(logs[1:], logs[0])).alias("log_det"))


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """(_lang, _source) to _group, what it is estimated in: itself, the language's small ones, all small ones."""
    sizes = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n") < least
    pool = F.sum(F.when(few, F.col("n")).otherwise(0)).over(Window.partitionBy("_lang"))
    pooled = F.struct(F.lit("small").alias("a"), F.lit("").alias("b"))
    group = F.when(few & (pool < least), pooled).when(few, F.struct(F.col("_lang").alias("a"), F.lit("small").alias("b"))).otherwise(F.struct(F.col("_lang").alias("a"), F.col("_source").alias("b")))
    return sizes.select("_lang", "_source", group.alias("_group"))


def _keyed(df: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds _lang and _source: '=' and the value, or 'null'."""
    return df.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for n, c in (("_lang", lang), ("_source", source))})


def _start(rows: DataFrame) -> DataFrame:
    """The first fits of each group: start 0 from medians and the narrower half widths, the others from five rows."""
    quarters = _quantiles(rows, ["_group"], [F.col(x) for x in X], [0.25, 0.5, 0.75], FINE)
    widths = [F.greatest(F.least(F.col(f"q_{i}_1") - F.col(f"q_{i}_0"), F.col(f"q_{i}_2") - F.col(f"q_{i}_1")) / 0.6745, F.lit(LEAST_DEVIATIONS[i])) for i in range(N)]
    scales = [(widths[i] if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i in range(N) for j in range(i + 1)]
    first = quarters.select("_group", F.lit(0).alias("_start"), *[F.col(f"q_{i}_1").alias(f"m_{i}") for i in range(N)], *scales, F.lit(float("inf")).alias("log_det"))
    seeded = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))).alias("_start")).withColumn("_hash", F.xxhash64("_start", *X))
    picked = seeded.groupBy("_group", "_start", F.pmod("_hash", F.lit(N + 1))).agg(F.min(F.struct("_hash", *X)).alias("x")).select("_group", "_start", "x.*")
    return first.unionByName(_fit(picked, ["_group", "_start"], 1.0))


def fit_groups(stats: DataFrame, lang: str = "lang", source: str = "source", h: float = H, least: int = LEAST_ROWS) -> DataFrame:
    """The minimum covariance determinant fit for each (_lang, _source), a written table with a row for each: c_0 and
    c_1, which centre the rates, means m_i and Cholesky factor l_ij. stats has the rows of text_statistics() that
    passed the base rules; none give an empty table."""
    keys = ["_group", "_start"]
    keyed = _keyed(stats, lang, source).groupBy("_lang", "_source", "copy_key").agg(F.min(F.struct(*COUNTS)).alias("one"))
    rows = written(keyed.select("_lang", "_source", "one.*"), "vectors")
    groups = written(_groups(rows, least), "groups")
    given = lambda t, n: F.broadcast(t) if n <= BROADCAST_ROWS else t
    n = groups.count()
    rows = rows.join(given(groups, n), ["_lang", "_source"]).select("_group", *COUNTS)
    centres = written(_quantiles(rows, ["_group"], [F.expr(r) for r in RATES], [0.5], FINE).select("_group", F.col("q_0_0").alias("c_0"), F.col("q_1_0").alias("c_1")), "centres")
    rows = written(rows.join(given(centres, n), "_group").select("_group", *[F.expr(e).alias(x) for e, x in zip(VECTOR, X, strict=True)]), "vectors")
    fits = written(_start(rows), "fits")
    for step in range(MOST_STEPS):
        starts = STARTS if step < FIRST_STEPS else 1
        near = rows.join(given(fits, n * starts), "_group").select(*keys, *X, _distance().alias("distance2"))
        cuts = written(_quantiles(near, keys, [F.col("distance2")], [h], BINS), "cuts")
        core = near.join(given(cuts, n * starts), keys).filter(F.floor(F.log1p("distance2") * BINS) <= F.floor(F.log1p("q_0_0") * BINS))
        better = _fit(core, keys, correction(h))
        if step == FIRST_STEPS - 1:  # the start with the least determinant goes on
            better = better.groupBy("_group").agg(F.min_by(F.struct("*"), F.struct("log_det", "_start")).alias("best")).select("best.*")
        better = written(better, "fits")
        falls = better.join(fits.select(*keys, F.col("log_det").alias("_before")), keys).filter(F.col("log_det") < F.col("_before") - REST)
        fits = better
        if step >= FIRST_STEPS and falls.isEmpty():
            break
    weighted = rows.join(given(fits, n), "_group").filter(_distance() <= chi_squared_quantile(WEIGHTED_SHARE, N)).select("_group", *X)
    final = _fit(weighted, ["_group"], correction(WEIGHTED_SHARE)).join(centres, "_group")
    return written(groups.join(final, "_group").select("_lang", "_source", "c_0", "c_1", *FIT), "models")


def robust_distances(df: DataFrame, fits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds distance2, the squared robust Mahalanobis distance of each row in its group; null for unknown groups. fits
    is broadcast while it has BROADCAST_ROWS rows at most."""
    rows = _keyed(df, lang, source).join(small(fits), ["_lang", "_source"], "left")
    rows = rows.withColumns({x: F.expr(e) for e, x in zip(VECTOR, X, strict=True)}).withColumn("distance2", _distance())
    return rows.select(*df.columns, "distance2")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judged(rows: DataFrame, fits: DataFrame, cutoff: float) -> DataFrame:
    out = robust_distances(rows, fits)
    out = out.withColumn("distance2", F.when(~F.col("base_failed"), F.col("distance2")))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(False)))


def document_quality(documents: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance2 (null where base_failed) of all documents.

    Null and empty texts fail the base rules; null lang or source is a value of its own; repeated rows are judged
    alike and count once in the fit; an empty table stays empty; other columns are ignored.
    """
    slim = text_statistics(documents.select("doc_id", "lang", "source", "text")).drop("text")
    slim = written(slim.withColumn("base_failed", base_failed()), "statistics")
    fits = fit_groups(slim.filter(~F.col("base_failed")))
    return _judged(slim, fits, cutoff).select("doc_id", *STATISTICS, "base_failed", "kept", "distance2")


def kept_documents(documents: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of documents that are kept, with all their columns, whatever those are called.

    Rows are written once with their statistics, so that no filter or join computes those again; the fit then reads
    the statistics alone.
    """
    rows = text_statistics(documents.select(F.struct("*").alias("_doc"), "lang", "source", "text")).drop("text")
    rows = written(rows, "statistics").withColumn("base_failed", base_failed())
    fits = fit_groups(rows.filter(~F.col("base_failed")).drop("_doc"))
    return _judged(rows, fits, cutoff).filter("kept").select("_doc.*")
