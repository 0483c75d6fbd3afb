"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Everything is DataFrame work. Each growth step is one aggregation that counts
good and bad labelled rows per statistic and bin; only those counts (statistics
x bins) reach the driver. The result is an ordered list of threshold
conjunctions, emitted as one conditional column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import bind, words
from ragspark.session import materialise

SYMBOLS = "[#*$%&|<>]"
#: Statistics the rules may test, next to the base counts.
FEATURES = (
    "n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "words_per_line",
)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)


Rule = tuple[Test, ...]


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id) plus base counts and features of every whole text.

    Null text counts as empty. Words are runs of anything but the six ASCII
    blanks. ``n_repeat_words`` counts words inside three-word windows that occur
    at least twice. Empty texts have zero in every statistic. Extra columns of
    ``docs`` are dropped unless kept; kept ones must not carry a statistic's name.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    rows = bind(rows, _words=words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = bind(
        rows, _h=F.transform("_words", lambda w: F.xxhash64(w)), _lines=lines,
        _count=F.array(F.length(F.concat_ws("", "_words")), F.regexp_count("_text", F.lit(SYMBOLS))),
    )
    n = F.size("_h")
    rows = bind(rows, _n_lines=F.array(F.size("_lines"), F.size(F.array_distinct("_lines")))).drop("_text", "_words", "_lines")
    window = lambda i: F.xxhash64(F.col("_h")[i], F.col("_h")[i + 1], F.col("_h")[i + 2])
    none = F.array().cast("array<bigint>")
    rows = bind(rows, _grams=F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(none))
    pairs = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    rows = bind(rows, _sorted=F.when(repeats, pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    s = F.col("_sorted")
    same = lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"])
    found = F.filter(s, lambda x, i: F.coalesce(same(x, i), (x["g"] == F.get(s, i + 1)["g"]), (x["g"] == F.get(s, i - 1)["g"])))
    hit = F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    rows = bind(rows, _repeat=F.when(F.size(s) == 0, 0).otherwise(F.size(F.array_distinct(hit))))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    chars, symbols = F.col("_count")[0], F.col("_count")[1]
    n_lines = F.col("_n_lines")[0]
    base = {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": n_lines - F.col("_n_lines")[1],
        "n_repeat_words": F.col("_repeat"),
    }
    more = {
        "mean_word_chars": share(chars, n), "symbol_share": share(symbols, chars),
        "dup_line_share": share(base["n_dup_lines"], n_lines), "repeat_share": share(F.col("_repeat"), n),
        "distinct_share": share(F.size(F.array_distinct("_h")), n), "words_per_line": share(n, n_lines),
    }
    return rows.select(
        *keep, *[v.cast("long").alias(k) for k, v in base.items()], *[v.cast("double").alias(k) for k, v in more.items()]
    )


def base_failed() -> Column:
    """Texts of under 50 words, or with more than half their words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(
    rows: DataFrame, features: tuple[str, ...] = FEATURES, bins: int = 16, max_rules: int = 8, max_tests: int = 3,
    precision: float = 0.9, support: int = 5,
) -> list[Rule]:
    """Decision list from labelled statistics: ``rows`` has doc_id, ``bad`` (boolean) and the features.

    All labelled rows count. Two thirds (by hash of doc_id) grow each rule by
    the test of highest information gain, one third prunes its tail and must
    show ``precision`` on ``support`` rows (fewer if there are fewer bad rows).
    Rows with a null label or feature are left out; without rows of both kinds
    the list is empty. Equal gains go to the first feature and the cut that rejects less.
    """
    cuts_at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    usable = rows.where(F.col("bad").isNotNull()).dropna(subset=list(features))
    quantiles = lambda v, f: F.percentile_approx(v, cuts_at, 2000).alias(f)
    whole = usable.agg(*[quantiles(F.col(f), f) for f in features]).first()
    wrong = usable.where("bad").agg(*[quantiles(F.col(f), f) for f in features]).first()
    if whole[0] is None or wrong[0] is None:
        return []
    # Bad rows may be few: their own quantiles give cuts where they lie.
    cuts = {f: sorted({float(x) for x in [*whole[f], *wrong[f]]}) for f in features}
    level = lambda f: sum(((F.col(f) > F.lit(t)).cast("int") for t in cuts[f]), F.lit(0))
    binned = materialise(usable.select(
        F.col("bad").cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prunes"),
        F.array(*[level(f) for f in features]).alias("bins"),
    ))

    def tests(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, b in rule:
            out = out & ((F.col("bins")[f] >= b) if above else (F.col("bins")[f] < b))
        return out

    done: list[list[tuple[int, bool, int]]] = []
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule, history = [], []
        while len(rule) < max_tests:
            left = binned.where(tests(rule))
            for old in done:
                left = left.where(~tests(old))
            step = _best(_counts(left), features, cuts)
            if step is None:
                break
            rule.append(step[0])
            history.append(step[1:])
            if step[1][1] == 0:
                break
        # Prune: the prefix with the best margin on rows that did not grow it.
        scored = [((p - n) / (p + n) if p + n else -1.0, -i) for i, (_, (p, n)) in enumerate(history)]
        if not scored:
            break
        at = -max(scored)[1]
        (gp, gn), (pp, pn) = history[at]
        if gp < support or gp < precision * (gp + gn) or pp + pn == 0 or pp < precision * (pp + pn):
            break
        rule = rule[: at + 1]
        done.append(rule)
        rules.append(tuple(Test(features[f], above, cuts[features[f]][b - 1]) for f, above, b in rule))
    return rules


def _counts(left: DataFrame) -> dict[tuple[int, int], list[int]]:
    """(feature, bin) -> bad and good rows that grow, then that prune."""
    one = lambda grows, bad: F.sum(((F.col("prunes") != grows) & (F.col("bad") == bad)).cast("int"))
    table = left.select("bad", "prunes", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(
        F.array(one(True, 1), one(True, 0), one(False, 1), one(False, 0)).alias("n")
    )
    return {(r["f"], r["b"]): r["n"] for r in table.collect()}


def _best(counts: dict, features: tuple[str, ...], cuts: dict):
    """The test of highest gain with its counts on growing and pruning rows; None if nothing gains."""
    best, gain = None, 0.0
    for f, name in enumerate(features):
        column = [counts.get((f, b), [0, 0, 0, 0]) for b in range(len(cuts[name]) + 1)]
        total = [sum(x) for x in zip(*column)]
        if not total[0] or not total[1]:
            return None
        before = math.log2(total[0] / (total[0] + total[1]))
        below = [0, 0, 0, 0]
        for b in range(1, len(column)):
            below = [x + y for x, y in zip(below, column[b - 1])]
            for above, side in ((False, below), (True, [t - x for t, x in zip(total, below)])):
                if side[0] == 0:
                    continue
                worth = side[0] * (math.log2(side[0] / (side[0] + side[1])) - before)
                tighter = best is not None and best[0][:2] == (f, True) and above and worth > gain - 1e-9
                if worth > gain + 1e-9 or tighter:
                    best, gain = ((f, above, b), (side[0], side[1]), (side[2], side[3])), worth
    return best


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional: false at the first rule that fires, else true."""
    out = None
    for rule in rules:
        fires = F.lit(True)
        for test in rule:
            fires = fires & test.column()
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def train(stats: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Rules for rows labelled quality 0 among those that pass the base checks.

    A document with several labels counts once per distinct label.
    """
    marks = labels.where(F.col("quality").isNotNull()).select(
        "doc_id", (F.col("quality") == 0).alias("bad")
    ).distinct()
    return learn(stats.where(~base_failed()).join(marks, "doc_id"), **options)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents that pass the base checks and the learned list, with their columns unchanged.

    Null and empty texts fail the base checks. Repeated rows are judged alike.
    """
    # Only numbers are written, so that learning does not read the texts again and again.
    rules = train(materialise(statistics(docs)), labels, **options)
    # The documents' own columns get neutral names, so that none clashes with a statistic.
    safe = {f"_doc{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*safe).withColumn("text", F.col(f"_doc{docs.columns.index('text')}"))
    kept = statistics(rows, keep=list(safe)).where(~base_failed() & verdict(rules))
    return kept.select(*safe).toDF(*docs.columns)
