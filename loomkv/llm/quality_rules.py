"""Operator 2: quality rules with robust multivariate outliers, by DataFrame functions alone.

Each document's statistics become a vector of four numbers that vary in clean text: mean word length, richness of
vocabulary, share of punctuation, share of capitals. Short texts are drawn towards usual values, so that they aren't
outlying by chance. Per language and source, the minimum covariance determinant is estimated: from medians and quartile
ranges on, concentration steps take the mean and covariance of the three quarters of the documents that lie nearest, by
the last step's Mahalanobis distance; a reweighting step follows. A document is rejected if its squared distance
exceeds the cutoff.

Every source of a language has its own estimate, whatever its size n, which is drawn towards that of its language with
weight k / (n + k), and the language's likewise towards the medians and quartile ranges of all documents: nothing
switches at any size. No variance is less than a hundredth of that which it is drawn towards.

The vectors are read twice: to be put into cells of a grid, whose moments the steps work on, and to be rated. There are
at most 2^20 cells to a group, however many its documents; a cell belongs to the nearest three quarters or it doesn't.
Documents that fail the base rule have no part in the estimates.

Defined results: a null or empty text has zeros everywhere and fails the base rule; a null language or source is a
value like any other; repeated rows count each, with any doc_id or none; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, forget, materialize

DIMS = 4
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Groups whose estimates may be broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: Documents at which an estimate and what it is drawn towards weigh the same.
DRAWN = 40.0
#: Of what an estimate is drawn towards, the least standard deviation that it keeps.
LEAST = 0.1
#: Cells' width in standard deviations of all documents, and how many lie on either side of the median.
WIDTH, SIDE = 0.5, 16
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words in five-word windows that occur twice or more. Hashes tell texts without such windows; others compare the windows."""

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.struct(F.array_join(F.slice(w, i + 1, 5), " ").alias("t"), i.alias("i")))

        def covered(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & (F.get(s, k)["t"] == F.get(s, k - 1)["t"])) | ((k < n - 1) & (F.get(s, k)["t"] == F.get(s, k + 1)["t"])))
            starts = F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))
            # a start adds the words from the later of itself and the end of the one before it
            return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        return _let(F.array_sort(windows), covered)

    def maybe(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))
        return F.when(F.size(w) < 6, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w))))

    return maybe(words)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base columns, and counts of distinct words, punctuation and capitals, in one projection of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    upper, lower, symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789 \n", "#*$%&|<>"
    other = "".join(c for c in PUNCTUATION if c not in symbols)
    # one pass over the text: capitals become A, symbols #, other signs a full stop; the rest of ASCII goes
    signs = F.translate(text, upper + symbols + other + lower, "A" * len(upper) + "#" * len(symbols) + "." * len(other))
    without = lambda x, c: F.length(F.replace(x, F.lit(c), F.lit("")))
    stats = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeats(w).cast("bigint").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
        ),
    )
    dup = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    seen = _let(signs, lambda x: F.struct(*[(F.length(x) - without(x, c)).cast("bigint").alias(k) for k, c in (("n_capitals", "A"), ("n_symbols", "#"), ("n_stops", "."))]))
    out = docs.select("doc_id", "lang", "source", stats.alias("s"), dup.alias("n_dup_lines"), seen.alias("c"))
    return out.select(
        "doc_id", "lang", "source", "s.n_words", "s.word_chars", "c.n_symbols", "n_dup_lines", "s.n_repeat_words", "s.n_distinct", (F.col("c.n_symbols") + F.col("c.n_stops")).alias("n_signs"), "c.n_capitals"
    )


def vector(df: DataFrame) -> DataFrame:
    """x0..x3: what short texts lack is filled up to thirty words of five characters, with usual shares of signs and capitals."""
    chars = F.col("word_chars") + 150.0
    return df.withColumns(
        {
            "x0": F.log(chars / (F.col("n_words") + 30)),
            "x1": F.log(F.col("n_distinct") + 20.0) / F.log(F.col("n_words") + 20.0),
            "x2": F.sqrt((F.col("n_signs") + 4.0) / chars),
            "x3": F.sqrt((F.col("n_capitals") + 2.5) / chars),
        }
    )


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int = DIMS) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        lo, hi = (mid, hi) if chi2_cdf(mid := (lo + hi) / 2, dof) < p else (lo, mid)
    return lo


def consistency(p: float) -> float:
    """What the covariance of the nearest share p must be multiplied by for normal data."""
    return p / chi2_cdf(chi2_quantile(p), DIMS + 2)


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


MEAN = [f"m{i}" for i in range(DIMS)]
COV = [f"c{i}{j}" for i, j in PAIRS]
SUMS = [f"s{i}" for i in range(DIMS)] + [f"s{i}{j}" for i, j in PAIRS]


def _drawn(own: DataFrame, towards: dict[str, str], keys: list[str]) -> DataFrame:
    """Means, covariances and their Cholesky factor, of a group's own (own_ columns, with its n) and what they are drawn towards (SQL by name).

    One projection, in which an alias may be used by those behind it.
    """
    own_weight = f"n / (n + {DRAWN})"
    out = [f"{own_weight} as w"] + [f"w * own_{m} + (1 - w) * {towards[m]} as {m}" for m in MEAN]
    for (i, j), c in zip(PAIRS, COV):
        mixed = f"w * own_{c} + (1 - w) * {towards[c]}"
        out.append(f"greatest({mixed}, {LEAST**2} * {towards[c]}) as {c}" if i == j else f"{mixed} as {c}")
    for i, j in PAIRS:
        rest = " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        out.append(f"sqrt(greatest({rest}, 0.001D * c{i}{i})) as l{i}{j}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    return own.selectExpr(*keys, *out).drop("w")


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    z = [f"({' - '.join([f'x{i}', f'm{i}', *[f'l{i}{k} * z{k}' for k in range(i)]])}) / l{i}{i} as z{i}" for i in range(DIMS)]
    return df.selectExpr("*", *z, " + ".join(f"z{i} * z{i}" for i in range(DIMS)) + " as d2")


def _cells(rows: DataFrame, centre: list[float], scale: list[float]) -> DataFrame:
    """Per group and cell of the grid: number and sums of products of its documents."""
    at = [F.least(F.greatest(F.floor((F.col(f"x{i}") - centre[i]) / (WIDTH * scale[i])), F.lit(-SIDE)), F.lit(SIDE - 1)).cast("int").alias(f"b{i}") for i in range(DIMS)]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    return rows.groupBy("g_lang", "g", *at).agg(F.count("*").alias("n"), *sums)


def _fit(cells: DataFrame, keys: list[str], towards: Callable[[DataFrame], tuple[DataFrame, dict[str, str]]], share: float, steps: int, few: bool) -> DataFrame:
    """Robust estimates of each group (the first key; others go with it) of a table of cells; towards adds to a table of groups what they are drawn towards."""
    key = keys[0]
    cells = cells.selectExpr(*keys, *[f"b{i}" for i in range(DIMS)], "n", *SUMS, *[f"s{i} / n as x{i}" for i in range(DIMS)])
    start = cells.groupBy(*keys).agg(F.expr("sum(n)").alias("n"), *[F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75), n)").alias(f"q{i}") for i in range(DIMS)])
    spread = [f"pow((q{i}[2] - q{i}[0]) / 1.349, 2) as own_{c}" if i == j else f"0.0D as own_{c}" for (i, j), c in zip(PAIRS, COV)]
    own = start.selectExpr(*keys, "n", *[f"q{i}[1] as own_m{i}" for i in range(DIMS)], *spread)
    order = ", ".join(["d2", *[f"b{i}" for i in range(DIMS)]])
    before: list[DataFrame] = []
    for step in range(steps + 1):
        before.append(materialize(_drawn(*towards(own), keys), "step"))
        params = before[-1].select(key, *MEAN, *[f"l{i}{j}" for i, j in PAIRS])
        near = _distance(cells.join(F.broadcast(params) if few else params, key))
        if step < steps:
            factor = consistency(share)
            near = near.selectExpr("*", f"sum(n) over (partition by {key} order by {order} rows unbounded preceding) - n as closer", f"sum(n) over (partition by {key}) as whole")
            near = near.where(f"closer < {share} * whole")
        else:
            factor = consistency(0.975)
            near = near.where(f"d2 <= {chi2_quantile(0.975)}")
        found = near.groupBy(*keys).agg(F.expr("sum(n)").alias("n"), *[F.expr(f"sum({c})").alias(c) for c in SUMS])
        own = found.selectExpr(*keys, "n", *[f"s{i} / n as own_m{i}" for i in range(DIMS)], *[f"{factor} * (s{i}{j} / n - own_m{i} * own_m{j}) as own_{c}" for (i, j), c in zip(PAIRS, COV)])
    out = materialize(_drawn(*towards(own), keys), "fit")
    forget(*before)
    return out


def fit(rows: DataFrame, share: float, steps: int) -> tuple[DataFrame, bool]:
    """Robust means and Cholesky factors per g of a table with g_lang, g, x0..x3, and whether they are few."""
    whole = rows.agg(*[F.expr(f"approx_percentile(x{i}, array(0.25, 0.5, 0.75), 10000)").alias(f"q{i}") for i in range(DIMS)]).first()
    q = [whole[f"q{i}"] or [0.0, 0.0, 0.0] for i in range(DIMS)]
    scale = [max((x[2] - x[0]) / 1.349, 1e-3) for x in q]
    all_ = {m: f"{q[i][1]!r}D" for i, m in enumerate(MEAN)} | {c: f"{scale[i] ** 2!r}D" if i == j else "0.0D" for (i, j), c in zip(PAIRS, COV)}
    cells = materialize(_cells(rows, [x[1] for x in q], scale), "cells")
    few = cells.select("g").distinct().count() <= BROADCAST_GROUPS
    merged = cells.groupBy("g_lang", *[f"b{i}" for i in range(DIMS)]).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])
    langs = _fit(merged, ["g_lang"], lambda own: (own, all_), share, steps, few)
    renamed = langs.selectExpr("g_lang", *[f"{c} as to_{c}" for c in MEAN + COV])

    def towards(own: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        # a language has no fewer documents than its sources, so it is always there
        return own.join(F.broadcast(renamed) if few else renamed, "g_lang"), {c: f"to_{c}" for c in MEAN + COV}

    out = _fit(cells, ["g", "g_lang"], towards, share, steps, few)
    forget(cells, langs)
    return out, few


def quality_rules(docs: DataFrame, share: float = 0.75, steps: int = 3, tail: float = 1e-9) -> DataFrame:
    """doc_id, base columns, base_failed, kept, d2. The texts are read once; only numbers are written and moved."""
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    stats = vector(base_statistics(docs)).withColumns({"g_lang": F.to_json(F.struct("lang")), "g": F.to_json(F.struct("lang", "source")), "base_failed": failed})
    stats = materialize(stats.select("g_lang", "g", "doc_id", *BASE, "base_failed", *[f"x{i}" for i in range(DIMS)]), "statistics")
    params, few = fit(stats.where("not base_failed").select("g_lang", "g", *[f"x{i}" for i in range(DIMS)]), share, steps)
    params = params.drop("g_lang")
    rated = _distance(stats.join(F.broadcast(params) if few else params, "g", "left"))
    return rated.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_quantile(1 - tail))).alias("kept"), "d2")
