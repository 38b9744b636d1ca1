"""Quality rules: fixed counts, and robust multivariate outliers per language and source. DataFrame functions only.

The counts of a text give a vector of transformed statistics. For each (lang, source) the minimum covariance
determinant is sought from ``STARTS`` starts: medians with quartile ranges, mean and covariance of all rows, and the
covariance of signs around the medians. A concentration step takes the ``CORE`` share of rows with least Mahalanobis
distance and estimates mean and covariance from them, with the factor that makes a normal core's covariance that of the
whole, and a ridge that keeps it regular where most rows agree in a statistic. After ``FIRST_STEPS`` steps each group
keeps its start of least determinant and goes on until the determinant falls no further. Rows within the ``TRIM``
quantile of the chi-square law then give the final mean and covariance, and a document is rejected whose squared
distance a normal vector exceeds with probability ``TAIL`` only.

Quantiles come from fine histograms (group, bin, count), which combine before the shuffle, are exact to a bin and do
not depend on the partitioning; so one group may hold any share of the rows. Group estimates are joined by broadcast
up to ``BROADCAST_GROUPS`` groups, beyond that by a salted join. Texts are read once and never shuffled.

Defined results: null and empty texts have all counts 0 and fail the base rule; null lang or source is a group of its
own; groups under ``LEAST_ROWS`` rows that pass the base rule are judged by their language's rows or by all rows, and
tables under ``LEAST_ROWS`` such rows reject nothing; a null id stays null; repeated rows each
give a row; an empty table gives an empty table; further columns are ignored. Windows of three words are compared
by 64-bit hashes of their words within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import SPACE, drop_since, drop_written, mark_written, written

DIMENSIONS = ("words", "word_length", "symbols", "dup_lines", "repeats")
#: Least standard deviation of each statistic: smaller differences never matter.
RIDGE = (0.5, 0.1, 0.05, 0.1, 0.1)
P = len(DIMENSIONS)
CORE, TRIM, TAIL, LEAST_ROWS = 0.75, 0.975, 1e-5, 50
STARTS, FIRST_STEPS, MOST_STEPS, LEAST_FALL = 3, 2, 30, 1e-4
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BROADCAST_GROUPS, SALTS = 20_000, 64
START_BIN = 0.01
#: Bins of ln(1 + d2) for distances.
DISTANCE_BINS = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"


def chi_square_tail(x: float, degrees: int) -> float:
    """Probability above ``x`` for an odd number of degrees."""
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for d in range(3, degrees + 1, 2):
        total += term
        term *= x / d
    return total


def chi_square_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, degrees) > tail else (low, middle)
    return low


def consistency(share: float) -> float:
    """What the covariance of the inner ``share`` of a normal law has to be multiplied by."""
    return share / (1 - chi_square_tail(chi_square_quantile(1 - share, P), P + 2))


CUTOFF = chi_square_quantile(TAIL, P)

MADE = [*[f"q_{c}" for c in COUNTS], "q_base_failed", "q_x", "q_lang", "q_source"]


def once(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the named columns behind a generator of one row: filters on them are not pushed into their making."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def counted(df: DataFrame) -> DataFrame:
    """``df`` with the base counts, base_failed and the vector x (columns are prefixed by ``q_`` until the end)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = df.withColumn("q_text", text)
    one = one.withColumn("q_words", F.array_remove(F.split(F.translate("q_text", SPACE, " " * len(SPACE)), " "), ""))
    one = one.withColumns(
        {
            "q_n_words": F.size("q_words"),
            "q_word_chars": F.length(F.array_join("q_words", "")),
            "q_n_symbols": F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, "")),
            "q_lines": F.filter(F.split("q_text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0),
            "q_hash": F.when(
                F.size("q_words") > 2,
                F.slice(F.transform("q_words", lambda x, i: F.xxhash64(x, F.get("q_words", i + 1), F.get("q_words", i + 2))), 1, F.size("q_words") - 2),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    one = one.withColumns(
        {
            "q_n_dup_lines": F.size("q_lines") - F.size(F.array_distinct("q_lines")),
            "q_sorted": F.when(
                F.size(F.array_distinct("q_hash")) < F.size("q_hash"),
                F.sort_array(F.transform("q_hash", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
            ),
        }
    )
    # places of windows that stand next to an equal hash, in text order
    one = one.withColumn(
        "q_places",
        F.when(
            F.col("q_sorted").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter("q_sorted", lambda e, i: (e["h"] == F.get("q_sorted", i + 1)["h"]) | ((i > 0) & (e["h"] == F.get("q_sorted", i - 1)["h"]))),
                    lambda e: e["p"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        "q_places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    one = one.withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0)))
    n, chars, lines = F.col("q_n_words").cast("double"), F.col("q_word_chars").cast("double"), F.size("q_lines").cast("double")
    share = lambda a, b: F.when(b > 0, F.col(a) / b).otherwise(0.0)
    one = one.withColumns(
        {
            "q_base_failed": (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words").cast("long") > MAX_REPEAT_PERCENT * F.col("q_n_words").cast("long")),
            "q_x": F.array(
                F.log1p(n),
                F.log1p(F.when(n > 0, chars / n).otherwise(0.0)),
                F.sqrt(share("q_n_symbols", chars)),
                share("q_n_dup_lines", lines),
                share("q_n_repeat_words", n),
            ),
            "q_lang": F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")),
            "q_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        }
    )
    return once(one.drop("q_text", "q_words", "q_lines", "q_hash", "q_sorted", "q_places"), [c for c in one.columns if c in MADE])


KEY = ["q_lang", "q_source"]
#: Stands for any language or source; values themselves begin with "=" or are empty.
POOLED = "*"


def attach(df: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """``df`` left-joined with a row per group; the group side is broadcast up to a bound, salted beyond it."""
    if n_groups <= BROADCAST_GROUPS:
        return df.join(F.broadcast(groups), KEY, "left")
    salted = groups.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("q_x", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    return df.withColumn("q_salt", salt).join(salted, [*KEY, "q_salt"], "left").drop("q_salt")


def quantiles(bins: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """From (by, bin, n): for each name the first bin that reaches its share."""
    run = Window.partitionBy(*by).orderBy("bin")
    whole = Window.partitionBy(*by)
    cum = bins.select(*by, "bin", F.sum("n").over(run).alias("c"), F.sum("n").over(whole).alias("t"))
    return cum.groupBy(*by).agg(*[F.min(F.when(F.col("c") >= F.ceil(q * F.col("t")), F.col("bin"))).alias(k) for k, q in at.items()], F.max("t").alias("rows"))


def distance(df: DataFrame) -> DataFrame:
    """Adds q_d2: forward substitution with the group's Cholesky factor q_l and mean q_m."""
    for i in range(P):
        left = F.col("q_x")[i] - F.col("q_m")[i]
        for j in range(i):
            left = left - F.col("q_l")[i * P + j] * F.col(f"q_y{j}")
        df = df.withColumn(f"q_y{i}", left / F.col("q_l")[i * P + i])
    total: Column = F.lit(0.0)
    for i in range(P):
        total = total + F.col(f"q_y{i}") * F.col(f"q_y{i}")
    return once(df.withColumn("q_d2", total).drop(*[f"q_y{i}" for i in range(P)]), ["q_d2"])


ESTIMATE = [*KEY, "q_start"]


def factored(groups: DataFrame) -> DataFrame:
    """From q_m and columns c_i_j (covariance with its ridge): q_m, the Cholesky factor q_l and the log determinant."""
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    flat = [F.col(f"l_{i}_{j}") if j <= i else F.lit(0.0) for i in range(P) for j in range(P)]
    determinant = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(P)), F.lit(0.0))
    return groups.select(*ESTIMATE, "q_m", F.array(*flat).alias("q_l"), determinant.alias("q_det"))


def covariance(of, factor: float = 1.0) -> dict[str, Column]:
    """Columns c_i_j: ``of(i, j)`` times a factor, and the ridge."""
    return {f"c_{i}_{j}": factor * of(i, j) + (RIDGE[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)}


def starts(good: DataFrame) -> DataFrame:
    """Three first estimates of each group."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("q_x")[i] / START_BIN).alias("bin")) for i in range(P)]))
    bins = good.select(*KEY, at.alias("v")).groupBy(*KEY, F.col("v.i").alias("i"), F.col("v.bin").alias("bin")).agg(F.count("*").alias("n"))
    got = quantiles(bins, [*KEY, "i"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    spread = F.sqrt(F.pow((F.col("high") - F.col("low")) * START_BIN / 1.349, 2) + F.element_at(F.array(*map(F.lit, RIDGE)), F.col("i") + 1) ** 2)
    got = got.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", ((F.col("mid") + 0.5) * START_BIN).alias("m"), spread.alias("s")))).alias("v"))
    middle = written(got.select(*KEY, F.col("v.m").alias("q_m"), F.col("v.s").alias("q_s")), "middles")
    rows = attach(good, middle, middle.count())
    off = [F.col("q_x")[i] - F.col("q_m")[i] for i in range(P)]
    unit = F.sqrt(sum((F.pow(off[i] / F.col("q_s")[i], 2) for i in range(P)), F.lit(0.0)))
    sign = [F.when(unit > 0, off[i] / F.col("q_s")[i] / unit).otherwise(0.0) for i in range(P)]
    sums = [F.count("*").alias("n"), F.first("q_m").alias("q_m"), F.first("q_s").alias("q_s")]
    sums += [F.avg(off[i]).alias(f"s_{i}") for i in range(P)]
    sums += [F.avg(x[i] * x[j]).alias(f"{k}_{i}_{j}") for k, x in (("p", off), ("g", sign)) for i in range(P) for j in range(i + 1)]
    both = written(rows.groupBy(*KEY).agg(*sums), "starts")
    drop_written(middle)
    scale = lambda i: F.col("q_s")[i]
    mean = F.array(*[F.col("q_m")[i] + F.col(f"s_{i}") for i in range(P)])
    ways = (
        ("q_m", lambda i, j: F.pow(scale(i), 2) - RIDGE[i] ** 2 if i == j else F.lit(0.0)),
        (mean, lambda i, j: F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}")),
        ("q_m", lambda i, j: P * F.col(f"g_{i}_{j}") * scale(i) * scale(j)),
    )
    parts = []
    for k, (centre, of) in enumerate(ways):
        parts.append(F.struct(F.lit(k).alias("q_start"), (F.col(centre) if isinstance(centre, str) else centre).alias("q_m"), *[c.alias(n) for n, c in covariance(of).items()]))
    out = written(factored(both.select(*KEY, F.inline(F.array(*parts)))), "estimates")
    drop_written(both)
    return out


def distances(stats: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Rows of the given groups with q_d2, a row for each estimate."""
    return distance(attach(stats, groups, n_groups).where(F.col("q_m").isNotNull()))


def binned(d2: str = "q_d2") -> Column:
    return F.floor(F.log1p(d2) * DISTANCE_BINS)


def estimated(core: DataFrame, factor: float) -> DataFrame:
    """Mean and covariance of the given rows for each estimate's key."""
    # sums about the former centre, so that little is lost in the squares
    off = [F.col("q_x")[i] - F.col("q_m")[i] for i in range(P)]
    sums = [F.avg(off[i]).alias(f"s_{i}") for i in range(P)]
    sums += [F.avg(off[i] * off[j]).alias(f"p_{i}_{j}") for i in range(P) for j in range(i + 1)]
    got = core.groupBy(*ESTIMATE).agg(*sums, F.first("q_m").alias("centre"))
    cov = covariance(lambda i, j: F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}"), factor)
    mean = F.array(*[F.col("centre")[i] + F.col(f"s_{i}") for i in range(P)]).alias("q_m")
    return factored(got.select(*ESTIMATE, mean, *[c.alias(n) for n, c in cov.items()]))


def step(stats: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """One concentration step for each estimate, not written yet; it reads a table of edges."""
    near = distances(stats, groups, n_groups).withColumn("bin", binned())
    edge = quantiles(near.groupBy(*ESTIMATE, "bin").agg(F.count("*").alias("n")), ESTIMATE, {"edge": CORE})
    both = written(groups.join(edge.select(*ESTIMATE, "edge"), ESTIMATE), "edges")
    return estimated(distances(stats, both, n_groups).where(binned() <= F.col("edge")), consistency(CORE))


def pools(stats: DataFrame) -> DataFrame:
    """For each (lang, source): the group that judges it (to) and the groups that its passing rows inform (into).

    A group of ``LEAST_ROWS`` passing rows judges itself, a smaller one is judged by all rows of its language, or of the
    whole table where the language is small too; ``to`` is null where the table is.
    """
    rows = lambda name: F.sum("n").alias(name)
    sizes = written(stats.groupBy(*KEY).agg(F.sum(F.when(F.col("q_base_failed"), 0).otherwise(1)).alias("n")), "sizes")
    langs = sizes.groupBy("q_lang").agg(rows("in_lang"), F.min("n").alias("least"))
    total = langs.agg(F.sum("in_lang").alias("in_all"), F.min("in_lang").alias("least_lang"))
    group = lambda lang, source: F.struct(lang.alias("q_lang"), source.alias("q_source"))
    own, lang, every = group(F.col("q_lang"), F.col("q_source")), group(F.col("q_lang"), F.lit(POOLED)), group(F.lit(POOLED), F.lit(POOLED))
    enough = lambda c: F.col(c) >= LEAST_ROWS
    to = F.when(enough("n"), own).when(enough("in_lang"), lang).when(enough("in_all"), every)
    into = F.array(F.when(enough("n"), own), F.when(enough("in_lang") & ~enough("least"), lang), F.when(enough("in_all") & ~enough("least_lang"), every))
    return sizes.join(langs, "q_lang").crossJoin(F.broadcast(total)).select(*KEY, to.alias("to"), F.array_compact(into).alias("into"))


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """Group estimates (q_m, q_l) from rows that pass the base rule, and their number."""
    mark = mark_written()
    plan = written(pools(stats), "pools")
    n_plan = plan.count()
    good = attach(stats.where(~F.col("q_base_failed")), plan.select(*KEY, "into"), n_plan)
    good = good.withColumn("into", F.explode("into")).withColumns({k: F.col(f"into.{k}") for k in KEY}).drop("into")
    # every step reads them twice, so that they are written without their groups' join
    good = written(good.select(*KEY, "q_x"), "passing")
    since = mark_written()
    groups = starts(good)
    for _ in range(FIRST_STEPS):
        groups = written(step(good, groups, n_plan), "estimates")
        drop_since(since, groups)
    rank = F.struct("q_det", "q_start")
    best = groups.groupBy(*KEY).agg(*[F.min_by(c, rank).alias(c) for c in ("q_start", "q_m", "q_l", "q_det")])
    best = moving = written(best, "estimates")
    drop_since(since, best)
    for _ in range(MOST_STEPS):
        fallen = F.col("new.q_det") < F.col("best.q_det") - LEAST_FALL
        both = best.alias("best").join(step(good, moving, n_plan).alias("new"), KEY, "left")
        newer = [F.when(fallen, F.col(f"new.{c}")).otherwise(F.col(f"best.{c}")).alias(c) for c in ("q_start", "q_m", "q_l", "q_det")]
        now = written(both.select(*KEY, *newer, F.coalesce(fallen, F.lit(False)).alias("fell")), "estimates")
        drop_since(since, now)
        best, moving = now.drop("fell"), now.where("fell").drop("fell")
        if moving.isEmpty():
            break
    inner = distances(good, best, n_plan).where(F.col("q_d2") <= chi_square_quantile(1 - TRIM, P))
    final = written(estimated(inner, consistency(TRIM)), "estimates")
    each = plan.select(*KEY, F.struct(*[F.col(f"to.{k}").alias(k) for k in KEY]).alias("to"))
    made = final.select(F.struct(*KEY).alias("to"), "q_m", "q_l")
    out = written(each.join(made, "to").drop("to"), "estimates")
    drop_since(mark, out)
    return out, n_plan


def judged(stats: DataFrame, model: tuple[DataFrame, int], cutoff: float = CUTOFF) -> DataFrame:
    """Adds q_d2 and q_kept."""
    near = distance(attach(stats, *model))
    return near.withColumn("q_kept", ~F.col("q_base_failed") & ~F.coalesce(F.col("q_d2") > cutoff, F.lit(False)))


def statistics_table(df: DataFrame) -> DataFrame:
    """The counts of every row, written once; texts go no further."""
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return written(counted(slim).drop("text", "lang", "source"), "counts")


def quality(df: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the squared distance d2 of every row."""
    stats = statistics_table(df)
    got = judged(stats, fit(stats))
    return got.select("doc_id", *[F.col(f"q_{c}").cast("long").alias(c) for c in COUNTS], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_d2").alias("d2"))


def passing(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with all their columns that quality keeps.

    Rows are written with their counts, so that texts are counted once; the caller's columns lie in a struct, where no
    name can clash.
    """
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("q_row"), *[df[c] for c in ("text", "lang", "source")])
    stats = written(counted(packed).drop("text", "lang", "source"), "counted")
    return judged(stats, fit(stats)).where("q_kept").select("q_row.*")
