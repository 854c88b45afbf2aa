"""Quality rules: fixed limits on repetition and length, and robust multivariate outliers.

For each language and source, whatever its size, a minimum-covariance-determinant estimate of location
and scatter is fitted to transformed statistics of all its documents; a document is rejected if its
squared Mahalanobis distance is beyond a quantile of the chi-squared distribution.

The estimate of a group: from three fixed starts about the medians (interquartile ranges alone;
correlations of hyperbolic tangents; spatial signs) concentration steps are taken. A step keeps the
share `coverage` of the documents that is nearest to the last estimate and takes its mean and
covariance; the start that ends with the least determinant wins. Documents are counted by distance on
a grid of `grid` cells for each doubling, so a step is one aggregation with partial sums in each task,
and a source that holds a third of all rows costs no more than any other; the cell at the edge counts
by the share of it that is needed. The covariance is multiplied by its consistency factor at the
normal distribution and regularised: FLOOR squared is added to each variance, as statistics of short
texts are coarse (a determinant of 0 would let a single symbol reject a document).

Estimates are shrunk by rows: the language's counts as `prior_rows` documents in that of each of its
sources, and the whole table's as as many in each language's. All three levels are fitted to all of
their documents; there is no size at which one replaces another.

Nulls and ties: a null text has no words and fails the base limits; null languages and sources
are groups of their own; equal distances fall together, on one side of the grid; repeated rows
count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.llm.runtime import drop, small_or_not, table, tidy
from hushgrain.llm.worker import each, release

# Fixed values of the base limits.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
FEATURES = ("f0", "f1", "f2", "f3", "f4", "f5")
#: Least standard deviation of each feature: a factor of e in length and of 1.2 in word length; of the
#: roots of rates about what chance makes of a text of MIN_WORDS words (some 50 characters, 3 lines).
FLOOR = (1.0, 0.2, 0.07, 0.3, 0.3, 0.12)
#: The last cell of the grid of squared distances, in doublings.
_DOUBLINGS = 40
_STARTS = 3


def _repeated_words(words: list[bytes]) -> int:
    """Words within windows that occur twice or more. Windows are compared exactly, by ranks of
    shorter ones, in memory linear in the number of words."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    _, two, counts = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True, return_counts=True)
    if len(counts) == len(two):
        return 0
    _, four, counts = np.unique(two[:-2] * len(counts) + two[2:], return_inverse=True, return_counts=True)
    if len(counts) == len(four):
        return 0
    _, five, counts = np.unique(four[:-1] * len(known) + ids[4:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[five] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
    )


def stats(text: Column) -> Column:
    """Struct column of STATS."""
    kind = pa.struct([(n, pa.int64()) for n in STATS])

    @arrow_udf("struct<" + ",".join(f"{n}:long" for n in STATS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        release()
        cols = list(zip(*map(text_stats, each(texts)))) or [()] * len(STATS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(kind))

    return run.asNondeterministic()(text)  # so that Spark doesn't run it again for a filter


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def _features(s: Column) -> list[Column]:
    """Transformed statistics: length, word length, rates of symbols, repeated lines and words,
    capitals."""
    words, lines = s["n_words"].cast("double"), s["n_lines"].cast("double")
    rate = lambda x, n: F.sqrt(x / F.greatest(n, F.lit(1.0)))
    return [F.log1p(words), F.log((s["word_chars"] + 1.0) / (words + 1.0)), rate(s["n_symbols"], s["word_chars"].cast("double")), rate(s["n_dup_lines"], lines), rate(s["n_repeat_words"], words), rate(s["n_upper"], s["word_chars"].cast("double"))]


def grouped(rows: DataFrame, stat: Column) -> DataFrame:
    """(rows with lang, source) with FEATURES and the group's names g_lang, g_source."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return rows.select("*", *[f.alias(n) for f, n in zip(_features(stat), FEATURES)], name("lang").alias("g_lang"), name("source").alias("g_source"))


def _levels(rows: DataFrame) -> DataFrame:
    """rows, once for each group `g` that they are fitted in: their source and language, their language,
    the table."""
    names = F.array(F.concat_ws("\x01", "g_lang", "g_source"), F.col("g_lang"), F.lit(""))
    return rows.select(*FEATURES, F.explode(names).alias("g"))


def _squared(center: list[Column], whitening: list[Column]) -> Column:
    """|W (x - m)|^2, W lower triangular."""
    p = len(FEATURES)
    total = F.lit(0.0)
    for i in range(p):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + whitening[i * (i + 1) // 2 + j] * (F.col(FEATURES[j]) - center[j])
        total = total + z * z
    return total


def _distance() -> Column:
    p = len(FEATURES)
    return _squared([F.col("center")[i] for i in range(p)], [F.col("whitening")[i] for i in range(p * (p + 1) // 2)])


def _whitening(cov: np.ndarray) -> list[float]:
    low = np.linalg.inv(np.linalg.cholesky(cov))
    return [float(low[i, j]) for i in range(len(cov)) for j in range(i + 1)]


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-squared distribution with k degrees of freedom."""
    from math import erf, exp, gamma, sqrt

    below, j = (erf(sqrt(x / 2)), 1) if k % 2 else (1 - exp(-x / 2), 2)
    while j < k:
        below -= (x / 2) ** (j / 2) * exp(-x / 2) / gamma(j / 2 + 1)
        j += 2
    return below


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return high


def consistency(coverage: float, p: int = len(FEATURES)) -> float:
    """What the covariance of the nearest share `coverage` of a normal sample must be multiplied by."""
    return coverage / chi2_cdf(chi2_quantile(coverage, p), p + 2) if coverage < 1 else 1.0


def regularised(cov: np.ndarray, coverage: float) -> np.ndarray:
    return consistency(coverage) * cov + np.diag(np.square(FLOOR))


_MODEL = "g string, start int, n double, center array<double>, cov array<double>, whitening array<double>, logdet double"


def _model(g: str, start: int, n: float, mean: np.ndarray, cov: np.ndarray, coverage: float) -> pd.DataFrame:
    full = regularised(cov, coverage)
    return pd.DataFrame({"g": [g], "start": [start], "n": [float(n)], "center": [mean.tolist()], "cov": [cov.ravel().tolist()], "whitening": [_whitening(full)], "logdet": [float(np.linalg.slogdet(full)[1])]})


def _square(upper: list[float]) -> np.ndarray:
    """A symmetric matrix of its lower triangle, row by row."""
    p, it = len(FEATURES), iter(upper)
    out = np.empty((p, p))
    for i in range(p):
        for j in range(i + 1):
            out[i, j] = out[j, i] = next(it)
    return out


def _starts(rows: DataFrame, coverage: float) -> DataFrame:
    """The estimates that the steps begin with, _STARTS for each group."""
    p = len(FEATURES)
    quartiles = table(rows.groupBy("g").agg(*[F.percentile_approx(f, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)]), "quartiles")
    normal_range = 1.349  # the interquartile range of a standard normal distribution
    scale = [F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / normal_range) ** 2 + FLOOR[i] ** 2) for i in range(p)]
    z = [((F.col(FEATURES[i]) - F.col(f"q{i}")[1]) / scale[i]).alias(f"z{i}") for i in range(p)]
    stretched = rows.join(small_or_not(quartiles), "g").select("g", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)], *[scale[i].alias(f"d{i}") for i in range(p)], *z)
    length = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))
    pair = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in pair]
    sums += [F.sum(F.when(length > 0, F.col(f"z{i}") * F.col(f"z{j}") / length).otherwise(0.0)).alias(f"s{i}_{j}") for i, j in pair]
    keys = [F.first(x).alias(x) for i in range(p) for x in (f"m{i}", f"d{i}")]
    summed = stretched.groupBy("g").agg(F.count("*").alias("n"), *keys, *sums)

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                mean, d = np.array([r[f"m{i}"] for i in range(p)]), np.array([r[f"d{i}"] for i in range(p)])
                tanh, sign = (_square([r[f"{x}{i}_{j}"] / r["n"] for i, j in pair]) for x in "ts")
                own = np.sqrt(np.maximum(np.diag(tanh), 1e-12))
                shapes = (np.eye(p), np.where(np.eye(p) > 0, 1.0, tanh / np.outer(own, own)), p * sign)
                for k, shape in enumerate(shapes):
                    yield _model(r["g"], k, r["n"], mean, shape * np.outer(d, d), coverage)

    return table(summed.mapInPandas(run, _MODEL), "mcd")


def fit(rows: DataFrame, coverage: float = 0.75, steps: int = 4, prior_rows: float = 200, grid: int = 12) -> DataFrame:
    """rows: FEATURES with g_lang, g_source. Returns the table of models (g_lang, g_source, n, center,
    whitening), one small row for each language and source; n: documents in the estimate's core."""
    p = len(FEATURES)
    tidy(rows.sparkSession)
    levels = table(_levels(rows), "levels")
    model = _starts(levels, coverage)
    sums = [F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i + 1)]

    def concentrate(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell")
        n = cells["n"].to_numpy(np.float64)
        core = np.ceil(coverage * n.sum() - 1e-9)
        share = np.clip((core - (np.cumsum(n) - n)) / n, 0.0, 1.0)  # of each cell, by distance
        total = lambda c: float((cells[c].to_numpy() * share).sum())
        mean = np.array([total(f"s{i}") / core for i in range(p)])
        second = _square([total(f"s{i}_{j}") / core for i in range(p) for j in range(i + 1)])
        cov = second - np.outer(mean, mean)
        values, vectors = np.linalg.eigh(cov)  # rounding may leave it slightly indefinite
        return _model(cells["g"].iloc[0], int(cells["start"].iloc[0]), core, mean, (vectors * np.maximum(values, 0.0)) @ vectors.T, coverage)

    for _ in range(steps):
        cell = F.least(F.floor(F.log2(1.0 + _distance()) * grid), F.lit(_DOUBLINGS * grid)).cast("int").alias("cell")
        cells = levels.join(small_or_not(model.select("g", "start", "center", "whitening")), "g").groupBy("g", "start", cell).agg(*sums)
        before, model = model, table(cells.groupBy("g", "start").applyInPandas(concentrate, _MODEL), "mcd")
        drop(before)
    best = model.groupBy("g").agg(F.min_by(F.struct("n", "center", "cov"), F.struct("logdet", "start")).alias("m"))
    best = table(best, "mcd")
    of = rows.select("g_lang", "g_source").distinct()
    named = lambda x, g: small_or_not(best.select(F.col("g").alias(g), F.col("m").alias(x)))
    three = of.withColumn("g_own", F.concat_ws("\x01", "g_lang", "g_source")).withColumn("g_all", F.lit(""))
    three = three.join(named("own", "g_own"), "g_own").join(named("lang", "g_lang"), "g_lang").join(named("every", "g_all"), "g_all")

    def shrunk(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                every, lang, own = ((x["n"], np.array(x["center"]), np.array(x["cov"]).reshape(p, p)) for x in (r["every"], r["lang"], r["own"]))
                _, center, cov = every
                for n, c, s in (lang, own):
                    w = n / (n + prior_rows)
                    center, cov = w * c + (1 - w) * center, w * s + (1 - w) * cov
                out.append((r["g_lang"], r["g_source"], own[0], center.tolist(), _whitening(regularised(cov, coverage))))
            yield pd.DataFrame(out, columns=["g_lang", "g_source", "n", "center", "whitening"])

    out = table(three.select("g_lang", "g_source", "own", "lang", "every").mapInPandas(shrunk, "g_lang string, g_source string, n double, center array<double>, whitening array<double>"), "mcd")
    drop(levels, model, best)
    return out


def judged(rows: DataFrame, model: DataFrame, stat: Column, tail: float) -> DataFrame:
    """rows (as from grouped) with base_failed, distance (squared) and kept."""
    joined = rows.join(small_or_not(model), ["g_lang", "g_source"])
    far = chi2_quantile(1 - tail, len(FEATURES))
    return joined.select("*", base_failed(stat).alias("base_failed"), _distance().alias("distance")).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= far))


#: Share of a normal sample that would lie beyond the cutoff.
TAIL = 0.001


def assess(docs: DataFrame, coverage: float = 0.75, tail: float = TAIL, prior_rows: float = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, STATS, base_failed, distance, kept: one row for each row of docs."""
    counted = table(docs.select(F.col(id_col).alias("doc_id"), "lang", "source", stats(F.col(text_col)).alias("s")), "stats")
    rows = grouped(counted, F.col("s"))
    return judged(rows, fit(rows, coverage, prior_rows=prior_rows), F.col("s"), tail).select("doc_id", "s.*", "base_failed", "distance", "kept")


def keep(docs: DataFrame, coverage: float = 0.75, tail: float = TAIL, prior_rows: float = 200, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns. Statistics are counted twice, once to fit
    and once to judge, so that no text is shuffled or stored."""
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    slim = table(docs.select("lang", "source", stats(F.col(text_col)).alias("s")), "stats")
    model = fit(grouped(slim, F.col("s")), coverage, prior_rows=prior_rows)
    drop(slim)
    counted = docs.select(F.struct("*").alias("doc"), "lang", "source", stats(F.col(text_col)).alias("s"))
    return judged(grouped(counted, F.col("s")), model, F.col("s"), tail).where("kept").select(*own)
