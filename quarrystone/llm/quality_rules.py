"""Quality rules whose cutoffs come from labelled documents with a bounded risk.

Each rule is a score, higher is worse, with a grid of cutoffs. One fixed sequence of vectors, a cutoff for each rule, leads from the
loosest to the tightest, one rule a step at a time in turn; what a vector rejects, all later ones reject too. For a stratum and a
vector, the labelled good documents say how many all rules together would reject wrongly. The vector is valid if the exact
binomial tail P(Bin(n, RISK) <= wrong) is at most the error level: then the share of good documents that its rules reject together is at most RISK,
with confidence. Vectors are tested from the loosest on, and the test ends at the first that fails, which needs no correction;
over strata the level is divided (Bonferroni), so all guarantees hold together with probability 1 - ERROR. Of the valid vectors the one that rejects the
most bad documents is taken, the loosest of several; a stratum in which none rejects any has no cutoffs.

Only built-in functions; what comes to the driver is at most a vector for each stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import checked_broadcast, written

#: What separates words, and the characters that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
#: Least words of a document, and most per cent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of good documents of a stratum that all rules together may reject, and probability that any guarantee fails.
RISK, ERROR = 0.02, 0.1
#: Languages that are strata of their own; all others share one.
STRATA = ("de", "en", "es", "fr")
#: Rules in the order in which they become tighter, with their cutoffs from the loosest on.
RULES = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_line_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "chars_per_word": (24.0, 18.0, 14.0, 12.0, 10.0),
}
#: The error level of the tests in a stratum.
LEVEL = ERROR / (len(STRATA) + 1)


def vectors() -> list[dict[str, float]]:
    """The sequence of cutoffs, a rule a step tighter at a time."""
    at = dict.fromkeys(RULES, 0)
    out = [{rule: grid[0] for rule, grid in RULES.items()}]
    while any(at[rule] < len(grid) - 1 for rule, grid in RULES.items()):
        for rule, grid in RULES.items():
            if at[rule] < len(grid) - 1:
                at[rule] += 1
                out.append({r: RULES[r][i] for r, i in at.items()})
    return out


_MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_lines", "_text", "_words", "_rows", "_windows", "_sorted")


def _repeated() -> Column:
    """Words that lie in a 3-word window found twice or more, from the column ``_sorted``."""
    # equal windows are neighbours in _sorted, whose entries end in a line feed and nine digits of position
    pairs = F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_sorted")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    equal = F.filter(pairs, lambda p: p["b"].isNotNull() & _same(p))
    places = F.flatten(F.transform(equal, lambda p: F.array(_place(p["a"]), _place(p["b"]))))
    ordered = F.array_sort(F.array_distinct(places))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(ordered, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def _same(p: Column) -> Column:
    return F.substring_index(p["a"], "\n", 1) == F.substring_index(p["b"], "\n", 1)


def _place(entry: Column) -> Column:
    return F.substring_index(entry, "\n", -1).cast("int")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``' other columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _lines.

    The text column is dropped, and extra columns of these names give way. Sorting within a row keeps a very long text at n log n.
    """
    kept = [c for c in docs.columns if c not in (text_col, *_MADE)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    split = docs.select(
        *kept, text.alias("_text"),
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACES}]+")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_rows"),
    )
    n = F.size("_words")
    two = F.zip_with(F.slice("_words", 1, n - 2), F.slice("_words", 2, n - 2), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = F.when(n >= 3, F.zip_with(two, F.slice("_words", 3, n - 2), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    cut = split.select(
        *kept, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size("_rows").cast("long").alias("_lines"),
        (F.size("_rows") - F.size(F.array_distinct("_rows"))).cast("long").alias("n_dup_lines"), windows.alias("_windows"),
    )
    keyed = F.transform("_windows", lambda w, i: F.concat(w, F.lit("\n"), F.lpad(i.cast("string"), 9, "0")))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = cut.withColumn("_sorted", F.when(some, F.sort_array(keyed))).drop("_windows")
    repeats = F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(_repeated()).cast("long")
    out = ordered.withColumn("n_repeat_words", repeats).drop("_sorted")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def scores() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def tail(n: Column, k: Column, risk: float = RISK) -> Column:
    """P(Bin(n, risk) <= k), exact, summed in logarithms; 1 where k exceeds the mean."""
    first = n * F.lit(math.log1p(-risk))
    odds = math.log(risk) - math.log1p(-risk)

    def step(acc, i):
        term = acc["term"] + F.ln((n - i + 1) / i) + F.lit(odds)
        total = F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * F.lit(risk), F.lit(1.0)).otherwise(F.aggregate(steps, start, step, lambda a: F.exp(a["total"])))


def choose_cutoffs(labelled: DataFrame) -> dict[str, dict[str, float]]:
    """rule -> stratum -> cutoff, from rows with the features, ``stratum`` and ``good`` (boolean)."""
    steps = vectors()
    # the first vector that rejects a row: for each rule as many vectors let it pass as have a cutoff that isn't below its score
    passing = lambda rule, score: F.size(F.filter(F.array(*(F.lit(v[rule]) for v in steps)), lambda c: score <= c))
    first = F.least(*(passing(rule, score) for rule, score in scores().items()))
    rows = labelled.where("not base_failed").select("stratum", "good", first.alias("first"))
    counts = rows.groupBy("stratum").agg(
        F.count_if("good").alias("n"), *(F.count_if(F.col("good") & (F.col("first") <= i)).alias(f"wrong{i}") for i in range(len(steps))), *(F.count_if(~F.col("good") & (F.col("first") <= i)).alias(f"right{i}") for i in range(len(steps)))
    )
    grid = counts.select("stratum", "n", F.posexplode(F.array(*(F.struct(F.col(f"wrong{i}").alias("wrong"), F.col(f"right{i}").alias("right")) for i in range(len(steps))))).alias("at", "x"))
    tested = grid.select("stratum", "at", "x.right", (tail(F.col("n"), F.col("x.wrong")) <= LEVEL).alias("ok"))
    ends = tested.groupBy("stratum").agg(F.min(F.when(~F.col("ok"), F.col("at"))).alias("end"))
    valid = tested.join(ends, "stratum").where("(end is null or at < end) and right > 0")
    best = valid.groupBy("stratum").agg(F.max(F.struct(F.col("right"), -F.col("at"), F.col("at"))).alias("b")).select("stratum", "b.at").collect()
    return {rule: {r["stratum"]: steps[r["at"]][rule] for r in best} for rule in RULES}


def _over(rule: str, score: Column, cutoffs: dict[str, float]) -> Column:
    out = F.lit(False)
    for name, cutoff in sorted(cutoffs.items()):
        out = out | ((F.col("stratum") == name) & (score > cutoff))
    return out


def _labels(labels: DataFrame) -> DataFrame:
    """doc_id, good; a document labelled twice is bad if any label says so."""
    return labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))


def _rejected(cutoffs: dict[str, dict[str, float]]) -> Column:
    by_rule = scores()
    out = F.lit(False)
    for rule, found in cutoffs.items():
        out = out | _over(rule, by_rule[rule], found)
    return out


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the text, with the features, ``base_failed``, ``stratum`` and ``kept``; all rows stay.

    ``labels`` holds doc_id and quality (0 or 1); a document labelled twice counts as bad if any
    label says so; other and null labels are left out. Null and empty texts have no words, so
    the base rules reject them. Null languages belong to the stratum ``other``. Rows with a null
    id are judged but never labelled. Empty tables: no rows, or no cutoffs, so that only the
    base rules apply. Repeated rows: judged alike. Clashing names: only the three named columns
    are read.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    judged = written(features(two).withColumn("stratum", stratum(F.col("lang"))), "quality")
    cutoffs = choose_cutoffs(written(judged.join(_labels(labels), "doc_id"), "labelled"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~_rejected(cutoffs)).drop("_lines")


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Cutoffs come from labelled documents alone, which are few; each row is then judged where it lies, so no text is shuffled. Rows with a null id go by the base rules only.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    marked = named.join(checked_broadcast(_labels(labels)), "doc_id")
    cutoffs = choose_cutoffs(written(features(marked).withColumn("stratum", stratum(F.col("lang"))), "labelled"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    judged = features(whole).withColumn("stratum", stratum(F.col("lang")))
    kept = ~F.col("base_failed") & (F.col("id").isNull() | ~_rejected(cutoffs))
    # a generator stands between: as a filter's condition, the features would be worked out again wherever it names them
    return judged.select("row", F.explode(F.array(kept)).alias("kept")).where("kept").select("row.*")
