"""Quality rules: base statistics and robust multivariate outliers.

Every text gives a vector of transformed statistics. For each language and
source the minimum covariance determinant (MCD) estimate of location and
scatter is found by concentration steps from three deterministic starts, and
documents far from it (squared Mahalanobis distance above a chi-square
quantile) are rejected. A group with few distinct vectors is judged by the
estimate of its whole language, or of all vectors where the language has few
as well, so that junk in a small source is held against what texts look like
elsewhere.

Each concentration step is one aggregation over all vectors: rows are summed
by (group, start, bin of the log distance), and the moments of the nearest
bins that hold ``share`` of the group give the next estimate. Only such sums
are gathered, so a group that holds a third of all rows costs no more memory
than another. Each distinct vector counts once, so that copies can't take
over an estimate, and variances have a floor, so that a statistic that is
zero in most documents can't make the scatter singular.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, pick, small, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
FEATURES = ("words", "length", "symbols", "lines", "repeats")
#: Least standard deviation of each feature.
FLOORS = (0.5, 0.2, 0.08, 0.15, 0.15)
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
BINS = 32  # per factor e of the squared distance
STEP = 0.05  # bin of a feature, for the medians
FEW = "few"  # key of the estimate of all vectors where these are few: variances only
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at \x20 and \x09-\x0D only
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            covered = 0
            for i, window in enumerate(windows):
                if times[window] > 1:
                    repeated += i + WINDOW - max(i, covered)
                    covered = i + WINDOW
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines))


def _counted(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` by place (_c0..) with the base statistics, and the places of doc_id, lang and source."""
    columns = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    places = [f"_c{columns.index(name)}" for name in ("doc_id", "lang", "source")]
    text_at = columns.index("text")
    schema = T.StructType([*plain.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(text.as_py()) for text in batch.column(text_at)]
            counts = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in counts)], names=schema.names)

    return plain.mapInArrow(run, schema), places


def _base(counted: DataFrame, places: list[str]) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("*", *(F.col(p).alias(n) for p, n in zip(places, ("doc_id", "lang", "source"), strict=True)), failed.alias("base_failed"))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and base_failed of every row; null and empty texts have no words."""
    return _base(*_counted(pick(docs, "doc_id", "lang", "source", "text"))).select("doc_id", "lang", "source", *COUNTS, "base_failed")


def features() -> list[Column]:
    """The transformed vector x0..x4: logarithms of size and word length, roots of the shares that are mostly zero."""
    words = F.greatest("n_words", F.lit(1))
    values = (F.log(words), F.log(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / words), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / words))
    return [F.round(v, 9).alias(f"x{i}") for i, v in enumerate(values)]


def _part(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def group_key() -> Column:
    return F.concat(_part("lang"), F.lit("\x1f"), _part("source")).alias("g")


def chi_square_cdf(x: float, df: int) -> float:
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def small_sample_cutoff(n: int, alarm: float) -> float:
    """The squared distance that a new normal vector exceeds with chance ``alarm`` where n vectors gave the estimate
    (Hotelling); infinite where n vectors can't tell."""
    if n <= P:
        return math.inf
    a, b = (n - P) / 2, P / 2
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def tail(x: float) -> float:  # the regularised incomplete beta function of (a, b)
        total, term, k = 0.0, 1.0, 0
        while abs(term) > 1e-17 and k < 10_000:
            total += term / (a + k)
            k += 1
            term *= (k - b) / k * x
        return math.exp(scale + a * math.log(x)) * total

    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) < alarm else (low, mid)
    return (n * n - 1) / n * (1 - high) / high


def _consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of a normal sample is to be multiplied by."""
    return share / chi_square_cdf(chi_square_quantile(share, P), P + 2)


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m0.. (location) and w{i}_{j} (inverse scatter)."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(f"w{i}_{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return F.greatest(total, F.lit(0.0))


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in PAIRS)]


MOMENT_NAMES = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in PAIRS)]
ESTIMATE_SCHEMA = "g string, s int, n long, logdet double, " + ", ".join(f"m{i} double" for i in range(P)) + ", " + ", ".join(f"w{i}_{j} double" for i, j in PAIRS)


def _inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    cov = cov.copy()
    for i, floor in enumerate(FLOORS):
        lift = max(0.0, floor**2 - cov[i, i])
        cov[i, i] += lift + 1e-9
    return np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def estimate(frame: pd.DataFrame, factor: float) -> pd.DataFrame:
    """Location and inverse scatter of each row of moments; the scatter is multiplied by ``factor``."""
    out = []
    for row in frame.itertuples(index=False):
        values = row._asdict()
        n = values["n"]
        mean = np.array([values[f"s{i}"] for i in range(P)]) / n
        cov = np.zeros((P, P))
        for i, j in PAIRS:
            if i == j or values["g"] != FEW:
                cov[i, j] = cov[j, i] = factor * (values[f"q{i}_{j}"] / n - mean[i] * mean[j])
        inverse, logdet = _inverse(cov)
        out.append((values["g"], int(values["s"]), int(n), logdet, *mean, *(inverse[i, j] for i, j in PAIRS)))
    return pd.DataFrame(out, columns=["g", "s", "n", "logdet", *(f"m{i}" for i in range(P)), *(f"w{i}_{j}" for i, j in PAIRS)])


def _estimates(moments: DataFrame, factor: float, label: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield estimate(frame, factor)

    return materialise(moments.select("g", "s", *MOMENT_NAMES).mapInPandas(run, ESTIMATE_SCHEMA), label)


def _starts(vectors: DataFrame) -> DataFrame:
    """Three starts for each group: medians with scales from quartiles, and the same with the correlation of
    hyperbolic tangents or of spatial signs of the standardised vectors."""
    long = vectors.select("g", F.posexplode(F.array(*(F.floor(F.col(f"x{i}") / STEP) for i in range(P)))).alias("f", "bin"))
    counted = long.groupBy("g", "f", "bin").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("g", "f").orderBy("bin")
    ranked = counted.withColumn("upto", F.sum("n").over(ordered)).withColumn("total", F.sum("n").over(Window.partitionBy("g", "f")))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), (F.col("bin") + 0.5) * STEP))
    quartiles = ranked.groupBy("g", "f").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    pick_f = lambda i, c: F.max(F.when(F.col("f") == i, c))
    centre = quartiles.groupBy("g").agg(
        *(pick_f(i, F.col("mid")).alias(f"c{i}") for i in range(P)),
        *(pick_f(i, F.greatest((F.col("high") - F.col("low")) / 1.349, F.lit(FLOORS[i]))).alias(f"d{i}") for i in range(P)),
    )
    centre = materialise(centre, "mcd-centre")
    z = vectors.join(_small(centre), "g").select("g", *(f"c{i}" for i in range(P)), *(f"d{i}" for i in range(P)), *(((F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in range(P)))
    norm = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(1e-9)))
    made = [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in PAIRS]
    made += [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / norm / norm).alias(f"u{i}_{j}") for i, j in PAIRS]
    summed = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.first(f"c{i}").alias(f"c{i}") for i in range(P)), *(F.first(f"d{i}").alias(f"d{i}") for i in range(P)), *made)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                v = row._asdict()
                scale = np.array([v[f"d{i}"] for i in range(P)])
                for s, letter in enumerate(" tu"):
                    shape = np.eye(P)
                    if s:
                        for i, j in PAIRS:
                            a, b = v[f"{letter}{i}_{i}"], v[f"{letter}{j}_{j}"]
                            shape[i, j] = shape[j, i] = v[f"{letter}{i}_{j}"] / math.sqrt(a * b) * (1 if i == j else 0.95) if a * b > 0 else float(i == j)
                    inverse, logdet = _inverse(shape * np.outer(scale, scale))
                    out.append((v["g"], s, int(v["n"]), logdet, *(v[f"c{i}"] for i in range(P)), *(inverse[i, j] for i, j in PAIRS)))
            yield pd.DataFrame(out, columns=["g", "s", "n", "logdet", *(f"m{i}" for i in range(P)), *(f"w{i}_{j}" for i, j in PAIRS)])

    return materialise(summed.mapInPandas(run, ESTIMATE_SCHEMA), "mcd-start")


def _small(model: DataFrame) -> DataFrame:
    """The estimates, broadcast if there are few (some 200 bytes each): else each group's rows would meet in one task."""
    return small(model, 20_000)


def _concentrate(vectors: DataFrame, estimates: DataFrame, share: float, least: float | None = None) -> DataFrame:
    """Moments of the nearest vectors: ``share`` of each group, or all within the squared distance ``least``."""
    joined = vectors.join(_small(estimates.drop("n", "logdet")), "g").withColumn("d", _distance())
    if least is not None:
        return joined.filter(F.col("d") <= least).groupBy("g", "s").agg(*_moments())
    binned = joined.withColumn("bin", F.floor(BINS * F.log(F.col("d") + 1e-9))).groupBy("g", "s", "bin").agg(*_moments())
    before = Window.partitionBy("g", "s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("g", "s"))
    nearest = binned.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", total).filter(F.col("below") < F.ceil(share * F.col("total")))
    return nearest.groupBy("g", "s").agg(*(F.sum(c).alias(c) for c in MOMENT_NAMES))


def _pools(vectors: DataFrame, least_vectors: int) -> tuple[DataFrame, DataFrame]:
    """(g, k): the estimate k that judges each group, and (g, x0..) under the keys k: the distinct vectors behind each.

    A group with ``least_vectors`` has its own; else its language, and else all vectors.
    """
    xs = [f"x{i}" for i in range(P)]
    groups = materialise(vectors.groupBy("l", "g").agg(F.count(F.lit(1)).alias("vectors")), "mcd-groups")
    enough = F.col("vectors") >= least_vectors
    own = groups.filter(enough)
    if groups.filter(~enough).isEmpty():
        return groups.select("g", F.concat(F.lit("g"), "g").alias("k")), vectors.select(F.concat(F.lit("g"), "g").alias("g"), *xs)
    short = _small(groups.filter(~enough).select("l").distinct())
    by_lang = materialise(vectors.join(short, "l", "left_semi").select(F.concat(F.lit("l"), "l").alias("g"), *xs).distinct(), "mcd-languages")
    langs = materialise(by_lang.groupBy("g").agg(F.count(F.lit(1)).alias("vectors")), "mcd-language-sizes")
    pools = vectors.join(_small(own.select("g")), "g", "left_semi").select(F.concat(F.lit("g"), "g").alias("g"), *xs)
    pools = pools.unionByName(by_lang.join(_small(langs.filter(enough).select("g")), "g", "left_semi"))
    rest = "a"
    if not langs.filter(~enough).isEmpty():
        every = materialise(vectors.select(*xs).distinct(), "mcd-all")
        rest = "a" if every.limit(least_vectors).count() == least_vectors else FEW
        pools = pools.unionByName(every.select(F.lit(rest).alias("g"), *xs))
    pooled = groups.filter(~enough).select("g", F.concat(F.lit("l"), "l").alias("k")).join(_small(langs.filter(enough).select(F.col("g").alias("k"), F.lit(True).alias("known"))), "k", "left")
    keys = own.select("g", F.concat(F.lit("g"), "g").alias("k")).unionByName(pooled.select("g", F.when(F.col("known"), F.col("k")).otherwise(F.lit(rest)).alias("k")))
    return keys, materialise(pools, "mcd-pools")


def fit_mcd(stats: DataFrame, share: float = 0.75, steps: int = 5, least_vectors: int = 50) -> DataFrame:
    """A reweighted MCD estimate for each language and source: its own, or that of the pool which judges it."""
    vectors = stats.filter(~F.col("base_failed")).select(group_key(), _part("lang").alias("l"), *features()).distinct()
    keys, vectors = _pools(materialise(vectors, "mcd-vectors"), least_vectors)
    current = _starts(vectors)
    for step in range(steps):
        current = _estimates(_concentrate(vectors, current, share), 1.0, f"mcd-step{step}")
    best = Window.partitionBy("g").orderBy("logdet", "s")
    chosen = current.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")
    # the raw estimate made consistent, then one reweighting by the vectors that it holds for regular
    limit = chi_square_quantile(0.975, P) * _consistency(share)
    final = _estimates(_concentrate(vectors, chosen, share, least=limit), _consistency(0.975), "mcd-final")
    final = final.join(vectors.groupBy("g").agg(F.count(F.lit(1)).alias("vectors")), "g").drop("n", "s", "logdet").withColumnRenamed("g", "k")
    level = F.when(F.col("k").startswith("g"), "group").when(F.col("k").startswith("l"), "language").when(F.col("k") == "a", "all").otherwise(FEW)
    return keys.join(_small(materialise(final, "mcd-pool-model")), "k").withColumn("level", level).drop("k")


def _judged(stats: DataFrame, share: float, steps: int, least_vectors: int, alarm: float) -> DataFrame:
    """The written statistics with level, distance and kept."""
    model = _small(materialise(fit_mcd(stats, share, steps, least_vectors), "mcd-model"))
    cutoff = F.lit(chi_square_quantile(1 - alarm, P))
    if least_vectors > 1:
        few = F.array(*(F.lit(small_sample_cutoff(n, alarm)) for n in range(1, least_vectors)))
        cutoff = F.when(F.col("vectors") < least_vectors, F.get(few, (F.col("vectors") - 1).cast("int"))).otherwise(cutoff)
    judged = stats.select("*", group_key(), *features()).join(model, "g", "left").withColumn("distance", F.when(~F.col("base_failed") & F.col("m0").isNotNull(), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.withColumn("kept", kept).withColumn("level", F.when(~F.col("base_failed"), F.col("level")))


def judge(docs: DataFrame, share: float = 0.75, steps: int = 5, least_vectors: int = 50, alarm: float = 1e-9) -> DataFrame:
    """Statistics and verdict of every row: base_failed, kept, distance (squared) and level.

    A row is kept unless it fails a base rule or its squared distance exceeds
    the chi-square quantile of 1 - ``alarm``. Groups with fewer than
    ``least_vectors`` distinct vectors are judged by their language, languages
    with fewer by all vectors, and where all are fewer by these with the
    cutoff of so small a sample, so every row that passes the base rules has a
    distance; ``level`` says which (group, language, all or few). Null
    languages and sources form groups of their own, null and empty texts fail
    the base rules, repeated rows and ties get the same verdict, a text of any
    length is counted whole, columns besides doc_id, lang, source and text are
    not looked at whatever their names, and an empty table gives no rows.
    """
    stats = materialise(base_statistics(docs), "quality-stats")
    return _judged(stats, share, steps, least_vectors, alarm).select("doc_id", *COUNTS, "base_failed", "kept", "distance", "level")


def keep_good(docs: DataFrame, share: float = 0.75, steps: int = 5, least_vectors: int = 50, alarm: float = 1e-9) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns.

    Each row is judged for itself, whatever its id: the rows are written once
    beside their statistics and filtered there, so no id is joined. Nulls,
    repeats, long texts, empty tables and clashing columns are as in ``judge``.
    """
    counted, places = _counted(docs)
    stats = _base(materialise(counted, "quality-rows"), places)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    return _judged(stats, share, steps, least_vectors, alarm).filter("kept").select(*own).toDF(*docs.columns)


def op2_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "level")
