"""Mixing by iterative proportional fitting: cells' token weights are raked to source, language and topic targets.

Tokens are white-space words. Documents fall into cells (source, language, topic); the cells' token sums are the
seed table, pre-aggregated map-side, so a hot source costs one row a task. A sweep scales the cells to each
marginal's target in turn, by sums that are pre-aggregated and joined back, and is written. The targets are the corpus's own marginals raised to ``alpha`` and
normalised (``alpha`` below 1 lifts small categories), or given tables (category, share). A document
is kept with probability ratio / cap (1 at most), ratio being its cell's raked over its actual tokens. The cap is
the least ratio above which cells hold no more than the share ``rare`` of the raked weights. These cells keep every
document and the others the raked proportions: however high the ratio of a tiny cell, it thins out no other, and no
more than ``rare`` of the weights is short of its target. With ``rare`` 0, which the registered query and its SQL
take, the cap is the largest ratio: the marginals are met in full, but one tiny cell sets the rate of all. The draw is a hash of the doc_id, so it is the same in every run.

Everything is DataFrame functions: no Python on the executors.

Defined cases: null source or language is a category of its own, ``""``; a null text has no tokens and topic ``empty``; documents without tokens
carry no weight and are kept; repeated rows share their draw; a null doc_id is drawn as -1; an empty table
gives an empty result; target categories that the corpus lacks are left out and the rest renormalised; a category without a target has
share 0, so its documents with tokens go. A target table must hold each category once, with a finite share above 0; one that does not, or
names no category of the corpus, raises. Columns of the input cannot clash with the operator's own: they are kept in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS = ["source", "lang", "topic"]


@dataclass(frozen=True)
class Mix:
    """alpha: exponent of the targets; sweeps: most sweeps; every: sweeps between tests of the fit; close: largest
    relative miss of a marginal that counts as fitted; seed: of the draw; rare: share of the raked weights whose cells
    may have a ratio above the cap."""
    alpha: float = 0.9
    sweeps: int = 24
    every: int = 4
    close: float = 1e-9
    seed: int = 17
    rare: float = 0.0


def topic(text: Column) -> Column:
    """Coarse topic by form and words: legal notices, tables, symbol-heavy text, contacts, else prose."""
    return (F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty")
            .when(text.rlike("(?i)licen[sc]e|rights reserved|copyright"), "legal")
            .when(text.contains(" | "), "table")
            .when(text.rlike("[#*$%&]{3}"), "symbols")
            .when(text.contains("@") | text.contains("http"), "contact")
            .otherwise("prose"))


def tokens(text: Column) -> Column:
    """Number of white-space words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def with_cells(docs: DataFrame) -> DataFrame:
    """(row, source, lang, topic, tokens): each document as a struct, with its cell."""
    text = F.col("text").cast("string")
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic(text).alias("topic"), tokens(text).alias("tokens"))


def cell_table(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, n_docs) of the cells that have tokens."""
    src = with_cells(docs.select("source", "lang", "text")).select(*DIMS, "tokens")
    return src.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).filter("tokens > 0")


def checked_target(target: DataFrame, dim: str) -> DataFrame:
    """(dim, share) of a given target table, NULL as the empty category; raises unless each category has one finite share above 0."""
    t = target.select(F.coalesce(F.col(dim).cast("string"), F.lit("")).alias(dim), F.col("share").cast("double").alias("share"))
    good = F.col("share").isNotNull() & ~F.isnan("share") & (F.col("share") > 0) & (F.col("share") < float("inf"))
    bad = t.groupBy(dim).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("n > 1 OR NOT good").limit(5).collect()
    if bad:
        raise ValueError(f"target table of {dim}: more than one row or no finite share above 0 for {[r[0] for r in bad]}")
    return t


def targets_of(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """(dim, share): the corpus's marginal to the power ``alpha``."""
    t = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("p"))
    return t.select(dim, F.col("p").alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], mix: Mix = Mix()) -> DataFrame:
    """``cells`` with w, raked so that each marginal is total x share; shares are renormalised over present categories."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goal = cells
    for d in DIMS:
        here = targets[d].select(d, "share").join(cells.select(d).distinct(), d)
        whole = here.agg(F.sum("share")).first()[0]
        if whole is None and total:
            raise ValueError(f"the targets of {d} name no category of the corpus")
        whole = float(whole or 1)
        goal = goal.join(here.select(d, (F.col("share") / whole * total).alias(f"goal_{d}")), d, "left").fillna({f"goal_{d}": 0.0})
    state = written(goal.withColumn("w", F.col("tokens").cast("double")), "cells")
    cols = state.columns
    for sweep in range(1, mix.sweeps + 1):
        for d in DIMS:
            # a category's sum is pre-aggregated and joined back: a language with a third of all cells gathers nowhere
            have = state.groupBy(F.col(d).alias("__d")).agg(F.sum("w").alias("__have"))
            scaled = F.when(F.col("__have") > 0, F.col("w") * F.col(f"goal_{d}") / F.col("__have")).otherwise(F.lit(0.0))
            state = state.join(have, F.col(d) == F.col("__d")).withColumn("w", scaled).select(*cols)
        state = written(state, "cells")
        if sweep % mix.every:
            continue
        miss = None
        for d in DIMS:
            one = state.groupBy(d).agg(F.sum("w").alias("have"), F.max(f"goal_{d}").alias("goal")).filter("goal > 0").select(F.max(F.abs(F.col("have") / F.col("goal") - 1)).alias("miss"))
            miss = one if miss is None else miss.unionByName(one)
        worst = miss.agg(F.max("miss")).first()[0]
        if worst is None or worst <= mix.close:
            break
    return state.select(*DIMS, "tokens", "n_docs", "w")


def cap_of(cells: DataFrame, rare: float) -> float:
    """The least ratio above which cells hold at most the share ``rare`` of w, to 0.1 %: the cells' weights are summed
    by the logarithm of their ratio, and only these sums, bounded by the range of the ratios, come to the driver."""
    steps = cells.filter("ratio > 0").groupBy(F.floor(F.log("ratio") * 1000).alias("step")).agg(F.sum("w").alias("w"), F.max("ratio").alias("top")).collect()
    left = rare * sum(r["w"] for r in steps)
    for r in sorted(steps, key=lambda r: -r["step"]):
        if r["w"] > left:
            return float(r["top"])
        left -= r["w"]
    return 1.0


def probabilities(cells: DataFrame, rare: float = 0.0) -> DataFrame:
    """Raked cells with ratio = w / tokens and probability = ratio / cap, 1 at most."""
    r = cells.withColumn("ratio", F.col("w") / F.col("tokens"))
    return r.withColumn("probability", F.round(F.least(F.col("ratio") / cap_of(r, rare), F.lit(1.0)), 9))


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the doc_id: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-1")), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def placed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, mix: Mix = Mix()) -> DataFrame:
    """(row, source, lang, topic, tokens, probability, kept): ``row`` is the whole document."""
    cells = written(cell_table(docs), "cells")
    goals = {d: checked_target(targets[d], d) if d in (targets or {}) else targets_of(cells, d, mix.alpha) for d in DIMS}
    p = written(probabilities(rake(cells, goals, mix), mix.rare), "probabilities").select(*[F.col(d).alias(f"p_{d}") for d in DIMS], "probability")
    joined = with_cells(docs).join(p, [F.col(d) == F.col(f"p_{d}") for d in DIMS], "left")  # broadcast only if AQE finds it small
    prob = F.coalesce("probability", F.lit(1.0))
    return joined.select("row", *DIMS, "tokens", prob.alias("probability"), (draw(F.col("row.doc_id"), mix.seed) < prob).alias("kept"))


def sampled(docs: DataFrame, keep: list[str], targets: dict[str, DataFrame] | None = None, mix: Mix = Mix()) -> DataFrame:
    """``keep`` columns with __source, __lang, __topic, __tokens, __probability and __kept."""
    own = [*DIMS, "tokens", "probability", "kept"]
    return placed(docs, targets, mix).select(*[F.col(f"row.`{c}`") for c in keep], *[F.col(c).alias(f"__{c}") for c in own])


def mixed_documents(docs: DataFrame, targets: dict[str, DataFrame] | None = None, mix: Mix = Mix()) -> DataFrame:
    """The documents drawn, with their own columns."""
    return placed(docs, targets, mix).filter("kept").select("row.*")
