"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted for each cell of source, language and topic. Each cell has a factor; the factors are raked in
turn to the targets of the three marginals, where a cell gives what its factor says but never more than it holds, so
that what one cell can't give the others of its category do. Documents are sampled with their cell's factor, at
most 1, as probability; the expected tokens meet a budget. Where a budget leaves a category too little, its cells are
all taken and its weight falls short; ``reached`` tells by how much.

Targets may be tempered: a category's weight is then multiplied with a power of its observed share, below 1 for flatter
mixtures than the corpus, which suits large budgets.

Categories are those that the targets name, and one for all others, so the cells are bounded by
the configuration, whatever the data hold. All of it, the loop as well, is SQL functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Rounds of raking (three marginals each), and of halving when the budget is met; the largest factor.
ROUNDS, HALVINGS, MOST = 30, 50, 1e9
OTHER = "other"
#: Topics by the marks of a text's form; the one with the most marks, if there is one for so many words, else prose.
TOPICS = (("listing", "[|]"), ("shouting", "!!+"), ("symbols", "[#*$%&]+"), ("figures", "[0-9]+"), ("legal", r"(?i)\b(?:licen[cs]e|copyright|warranty|permission|rights reserved)\b"))
PROSE, WORDS_A_MARK = "prose", 25
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Targets:
    """Weights of the categories of each marginal; ``other`` stands for all that aren't named."""

    source: dict[str, float] = field(default_factory=lambda: {f"src{i}": 1.0 for i in range(20)} | {OTHER: 1.0})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 60.0, "de": 15.0, "fr": 15.0, "es": 10.0, OTHER: 1.0})
    topic: dict[str, float] = field(default_factory=lambda: {PROSE: 88.0, "figures": 4.0, "listing": 4.0, "shouting": 1.0, "symbols": 2.0, "legal": 1.0})
    #: Share of the tokens that the sample is expected to keep.
    budget: float = 0.6
    #: Power of the observed shares that weights are multiplied with; 0 leaves them as they are.
    temper: float = 0.0
    seed: str = "mix"

    def names(self) -> tuple[list[str], list[str], list[str]]:
        return tuple([*(k for k in d if k != OTHER), OTHER] for d in (self.source, self.lang, self.topic))

    def weights(self) -> tuple[list[float], list[float], list[float]]:
        return tuple([float(d.get(k, 0.0)) for k in n] for d, n in zip((self.source, self.lang, self.topic), self.names(), strict=True))


def topic_of(marks: list[Column], words: Column) -> Column:
    most = F.greatest(*marks)
    out = F.when((most == 0) | (most * WORDS_A_MARK < words), PROSE)
    for (name, _), n in zip(TOPICS, marks, strict=True):
        out = out.when(n == most, name)
    return out


def words_in(text: Column) -> Column:
    """Words, the tokens that weights count."""
    inner = F.btrim(text, F.lit(_SPACES))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count(inner, F.lit(f"[{_SPACES}]+")) + 1).cast("long")


def _index(value: Column, names: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.coalesce(value, F.lit(OTHER))) - 1, F.lit(-1))


def _cell(targets: Targets) -> Column:
    s, l, t = targets.names()
    at = [F.when(i < 0, len(n) - 1).otherwise(i) for i, n in ((_index(F.col(c), n), n) for c, n in (("source", s), ("lang", l), ("topic", t)))]
    return ((at[0] * len(l) + at[1]) * len(t) + at[2]).cast("int")


def probabilities(cells: DataFrame, targets: Targets) -> DataFrame:
    """cell, keep_prob, for every cell of the configuration, from (cell, tokens)."""
    ns, nl, nt = map(len, targets.names())
    n = ns * nl * nt
    wanted = [F.array(*map(F.lit, w)).cast("array<double>") for w in targets.weights()]
    one = cells.agg(F.map_from_entries(F.collect_list(F.struct("cell", "tokens"))).alias("by_cell"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("total"))
    here = one.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("by_cell", i), F.lit(0)).cast("double") / F.greatest("total", F.lit(1.0))).alias("m"))
    # of each marginal: its size, the place of the j-th cell of category i, how many there are, and the category of cell x
    sides = {
        "s": (ns, f"(i * {nl * nt} + j)", nl * nt, f"(x div {nl * nt})"), "l": (nl, f"((j div {nt}) * {nl * nt} + i * {nt} + j % {nt})", ns * nt, f"((x div {nt}) % {nl})"),
        "t": (nt, f"(j * {nt} + i)", ns * nl, f"(x % {nt})"),
    }
    for (k, (size, cell, others, _)), w in zip(sides.items(), wanted, strict=True):
        # targets of categories without tokens go to the others, in proportion
        share = f"aggregate(sequence(0, {others - 1}), 0D, (z, j) -> z + m[{cell}])"
        here = here.withColumn(f"w{k}", w).withColumn(f"w{k}", F.expr(f"transform(sequence(0, {size - 1}), i -> w{k}[i] * if({share} > 0, pow({share}, {targets.temper}D), 0D))"))
        here = here.withColumn(f"w{k}", F.expr(f"transform(w{k}, y -> y / greatest(aggregate(w{k}, 0D, (a, z) -> a + z), 1e-300D))"))

    def step(k: str) -> str:
        """Factors after a step: each category's cells together give its target, as far as they hold it."""
        size, cell, others, category = sides[k]
        given = f"aggregate(sequence(0, {others - 1}), 0D, (z, j) -> z + m[{cell}] * least(1D, f[{cell}]))"
        by = f"transform(sequence(0, {size - 1}), i -> w{k}[i] * {targets.budget}D / nullif({given}, 0D))"
        new = f"transform(sequence(0, {n - 1}), x -> least({MOST}D, coalesce(f[x] * by[{category}], 0D)))"
        return f"aggregate(array(1), {by}, (by, i) -> by, by -> {new})"  # an aggregate over nothing names ``by``, so that it's worked out once

    which = f"transform(sequence(1, {3 * ROUNDS}), r -> r % 3)"
    loop = f"aggregate({which}, array_repeat(1D, {n}), (f, r) -> if(r = 1, {step('s')}, if(r = 2, {step('l')}, {step('t')})))"
    rated = here.select("m", *(f"w{k}" for k in sides)).select("m", F.expr(loop).alias("r"))
    kept = "aggregate(zip_with(m, r, (x, y) -> x * least(1D, {} * y)), 0D, (a, z) -> a + z)"
    # the factor that meets the budget, by halving its logarithm
    halve = f"aggregate(sequence(1, {HALVINGS}), named_struct('lo', -30D, 'hi', 30D), (h, i) -> if({kept.format('exp((h.lo + h.hi) / 2)')} < {targets.budget}D, named_struct('lo', (h.lo + h.hi) / 2, 'hi', h.hi), named_struct('lo', h.lo, 'hi', (h.lo + h.hi) / 2)), h -> exp((h.lo + h.hi) / 2))"
    scaled = rated.withColumn("k", F.expr(halve))
    return scaled.select(F.posexplode(F.expr("transform(r, y -> least(1D, k * y))")).alias("cell", "keep_prob"))


def unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighed(docs: DataFrame, targets: Targets, text_col: str = "text") -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens`` and ``cell``; extra columns of these names are replaced."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = [f"_{uuid.uuid4().hex}" for _ in TOPICS]
    counted = docs.withColumns({"n_tokens": words_in(text)} | {c: F.regexp_count(text, F.lit(p)) for c, (_, p) in zip(marks, TOPICS, strict=True)})
    named = counted.withColumn("topic", topic_of([F.col(c) for c in marks], F.col("n_tokens"))).drop(*marks)
    return named.withColumn("cell", _cell(targets))


def sample(docs: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, lang, topic, n_tokens, keep_prob, sampled.

    Null sources and languages count as ``other``. Null and empty texts have no tokens, belong
    to ``prose`` and are sampled like their cell. A null id is a key of its own; rows with
    the same id are sampled together. Empty table: no rows. Other columns are neither read nor
    returned. Where a cell's target cannot be met since its documents are all taken, its
    probability is 1.
    """
    targets = targets or Targets()
    four = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = written(weighed(four, targets).drop("text"), "weighed")
    cells = rows.groupBy("cell").agg(F.sum("n_tokens").alias("tokens"))
    chances = F.broadcast(probabilities(cells, targets))  # a row a cell of the configuration
    joined = rows.join(chances, "cell")
    return joined.select("doc_id", "source", "lang", "topic", "n_tokens", "keep_prob", (unit(F.col("doc_id"), targets.seed) < F.col("keep_prob")).alias("sampled"))


def keep(docs: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``sample`` takes, with all their columns; rows with a null id, which no sample can name, stay.

    One pass weighs the cells, the other draws each row where it lies, so no text is shuffled.
    """
    targets = targets or Targets()
    four = [F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text")]
    cells = written(weighed(docs.select(*four), targets).groupBy("cell").agg(F.sum("n_tokens").alias("tokens")), "cells")
    chances = written(probabilities(cells, targets), "chances")
    rows = weighed(docs.select(F.struct(*docs.columns).alias("row"), *four), targets).join(F.broadcast(chances), "cell")
    return rows.where(F.col("doc_id").isNull() | (unit(F.col("doc_id"), targets.seed) < F.col("keep_prob"))).select("row.*")


def reached(drawn: DataFrame, targets: Targets | None = None) -> DataFrame:
    """marginal, category, observed, target, expected, gap: shares of the tokens in the corpus, as wished for and as the sample is
    expected to hold them, from what ``sample`` gives; a row for each category that has tokens."""
    targets = targets or Targets()
    out = None
    for kind, names, weights in zip(("source", "lang", "topic"), targets.names(), targets.weights(), strict=True):
        category = F.when(F.col(kind).isin(*names), F.col(kind)).otherwise(OTHER)
        sums = drawn.groupBy(category.alias("category")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("keep_prob")).alias("k")).where("n > 0")
        every = Window.partitionBy()  # a row a category of the configuration
        wish = F.try_element_at(F.create_map(*(x for kv in zip(names, weights, strict=True) for x in map(F.lit, kv))), F.col("category"))
        shares = sums.withColumns({"observed": F.col("n") / F.sum("n").over(every), "expected": F.col("k") / F.sum("k").over(every)})
        wished = shares.withColumn("target", wish * F.pow("observed", F.lit(targets.temper))).withColumn("target", F.col("target") / F.sum("target").over(every))
        one = wished.select(F.lit(kind).alias("marginal"), "category", "observed", "target", "expected", (F.col("expected") - F.col("target")).alias("gap"))
        out = one if out is None else out.unionByName(one)
    return out
