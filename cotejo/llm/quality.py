"""Quality rules for documents, with verdicts on whole hosts (DataFrame functions only).

``measure`` computes per-document figures in one pass without a shuffle. ``judge_hosts``
aggregates rule failures by host (map-side combined, so a host with a third of all rows
adds one row a task), fits for each host a beta prior to the failure rates of all other
hosts by moments and shrinks its rate towards it. A host is refused if the odds of its
posterior lie clearly above a multiple of the odds of its prior's mean, so a few failures
of a small host, or a slightly raised rate of a very large one, refuse nobody, and neither
two hosts nor a corpus of mostly bad ones put the rule out of reach. ``quality_rules``
joins the verdicts back to the documents.

Defined results: a null text counts as empty (no words, so it fails ``short``); a document
without host is judged by its own figures only; repeated rows are judged one by one and
stay; the only host of a table is judged against a uniform prior; an empty table gives an
empty result; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import SPACE, as_row, cut_lineage, let, once, words_of, write_and_read

#: Figures of ``measure`` in order.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class QualityLimits:
    """Limits of the document rules and of the host rule."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    window: int = 8
    #: A host is refused when the failure rate of one of its rules, less ``host_deviations`` standard
    #: deviations of its posterior, has over ``host_factor`` times the odds of the prior's mean, and
    #: is above ``host_floor``. A prior counts as ``prior_documents`` documents at most.
    host_factor: float = 2.0
    host_deviations: float = 3.0
    host_floor: float = 0.1
    prior_documents: float = 100.0
    #: Most refused hosts that are broadcast; beyond it the verdicts come by a shuffled join.
    broadcast_hosts: int = 100_000


def _repeat_words(words: Column, width: int) -> Column:
    """Words covered by ``width``-word windows that occur more than once in the text.

    Windows are compared by 64-bit hashes. Only texts with an equal pair sort them.
    """
    grams = F.when(
        F.size(words) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - width),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

            twice = F.filter(s, lambda x, k: same(x, k + 1) | same(x, k - 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, starts), length)

    return let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)),
    )


def measure(docs: DataFrame, text: str = "text", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Columns ``row`` (the input row) and ``fig`` (a struct of ``FIGURES``, all long)."""
    t = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    out = docs.select(as_row(docs).alias("row")).withColumn("words", words_of(t)).withColumn("lines", lines)
    figures = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeat_words(F.col("words"), limits.window),
        "n_lines": F.size("lines"),
    }
    return out.select("row", once(F.struct(*[figures[k].cast("long").alias(k) for k in FIGURES])).alias("fig"))


def rule_columns(fig: Column, limits: QualityLimits = QualityLimits()) -> dict[str, Column]:
    """Failure of each document rule, as booleans that are never null."""
    n = fig["n_words"]
    return {
        "short": n < limits.min_words,
        "repetitive": 100 * fig["n_repeat_words"] > limits.max_repeat_percent * n,
        "symbols": 100 * fig["n_symbols"] > limits.max_symbol_percent * fig["word_chars"],
        "dup_lines": 100 * fig["n_dup_lines"] > limits.max_dup_line_percent * fig["n_lines"],
    }


def base_failed(fig: Column, limits: QualityLimits = QualityLimits()) -> Column:
    rules = rule_columns(fig, limits)
    return rules["short"] | rules["repetitive"]


def judge_hosts(measured: DataFrame, host: str = "source", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row per host: counts, shrunken failure rate of each rule, its lower bound, and ``refused``.

    The prior of a rule is Beta(m*s, (1-m)*s), where m and v are mean and variance of the
    other hosts' rates and s = m(1-m)/v - 1, but 1 at least and ``prior_documents`` at most.
    Sums over all hosts, less the judged one's part, give m and v.
    """
    rules = rule_columns(F.col("fig"), limits)
    hosts = (
        measured.select(F.col("row")[host].cast("string").alias("host"), *[c.cast("long").alias(k) for k, c in rules.items()])
        .filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(k).alias(k) for k in rules])
    )
    hosts = cut_lineage(hosts)
    rates = {k: F.col(k) / F.col("n_docs") for k in rules}
    sums = hosts.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(f"a_{k}") for k, r in rates.items()], *[F.sum(r * r).alias(f"b_{k}") for k, r in rates.items()]
    ).first()  # one row of nine numbers
    others = sums["n"] - 1
    priors: dict[str, Column] = {}
    for k, r in rates.items():
        mean, strength = F.lit(0.5), F.lit(2.0)
        if others > 0:
            mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(sums[f"a_{k}"]) - r) / others))
            v = (F.lit(sums[f"b_{k}"]) - r * r) / others - mean * mean
            most = F.lit(limits.prior_documents)
            strength = let(v, lambda v: F.when(v > 0, F.least(most, F.greatest(F.lit(1.0), mean * (1 - mean) / v - 1))).otherwise(most))  # noqa: B023
        priors |= {f"mean_{k}": mean, f"strength_{k}": strength}
    hosts = cut_lineage(hosts.withColumns(priors))
    for k in rules:
        mean, strength = F.col(f"mean_{k}"), F.col(f"strength_{k}")
        hosts = hosts.withColumn(f"rate_{k}", (F.col(k) + mean * strength) / (F.col("n_docs") + strength))
        rate = F.col(f"rate_{k}")
        hosts = hosts.withColumn(f"low_{k}", rate - limits.host_deviations * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + strength + 1)))
        raised = limits.host_factor * mean / (1 - mean + limits.host_factor * mean)  # the rate of so many times the mean's odds
        hosts = hosts.withColumn(f"refused_{k}", F.col(f"low_{k}") > F.greatest(F.lit(limits.host_floor), raised))
    return hosts.withColumn("refused", F.greatest(*[F.col(f"refused_{k}") for k in rules]))


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", limits: QualityLimits = QualityLimits(), slim: tuple[str, ...] | None = None
) -> DataFrame:
    """``row``, ``fig``, ``base_failed``, ``host_refused`` and ``kept`` for every document.

    ``slim`` names the columns wanted in ``row``. Every text is measured once: the figures
    are written beside the rows, and of the table only they and the hosts are read to judge
    the hosts. A result without the text leaves it out of the table.
    """
    measured = measure(docs, text, limits)
    if slim is not None:
        measured = measured.select(F.struct(*[F.col("row")[c].alias(c) for c in dict.fromkeys([*slim, host])]).alias("row"), "fig")
    measured = write_and_read(measured)
    refused = judge_hosts(measured, host, limits).filter("refused").select(F.col("host").alias("refused_host"))
    n = refused.limit(limits.broadcast_hosts + 1).count()
    if n == 0:
        judged = measured.withColumn("host_refused", F.lit(False))
    else:
        right = F.broadcast(refused) if n <= limits.broadcast_hosts else refused
        judged = measured.join(right, F.col("row")[host].cast("string") == F.col("refused_host"), "left").select(
            "row", "fig", F.col("refused_host").isNotNull().alias("host_refused")
        )
    failed = base_failed(F.col("fig"), limits)
    return judged.select("row", "fig", failed.alias("base_failed"), "host_refused", (~failed & ~F.col("host_refused")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The documents that pass, with exactly their own columns."""
    return quality_rules(docs, text, host, limits).filter("kept").select("row.*")
