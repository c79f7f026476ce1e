"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

``store_tokens`` keeps the words of every training document; ``term_counts`` says how often
the terms of the benchmark occur in them. Every window of an item is looked up by its
rarest term: ``store_index`` keeps the postings of these terms (document, position, and the
words around it). A posting is met by the windows that have its term as their rarest; the
lists of their other terms are intersected with it from the next rarest on. An entry of
such a list, less its offset, equals the posting's if its term stands at that distance,
which the words around tell, so no list of a common term is ever shuffled or held.

* An exact match is an occurrence of all words of a window in order.
* A proximity match is an occurrence of a window's rarest term with its ``near`` rarest
  distinct terms among the words around it, in any order.

Terms and windows of the benchmark are broadcast up to ``BROADCAST`` rows; more of them meet
the words by shuffled joins, the postings dealt over ``SALTS`` parts of each term. Counts
and matches are combined map-side, so a term or a passage that a third of all documents
have is one row a task or a document.

Defined results: a null or empty text has no words; an item without words matches nothing;
an item of fewer words than a window is one window; items of equal id count as one, and a
null id as the empty text; documents that repeat are judged one by one; empty tables give
an empty result or documents without hits; other columns, whatever their names, pass
through in ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.common import as_row, cut_lineage, write_and_read

#: Most rows of a side that is broadcast, and parts of a term where that side is shuffled.
BROADCAST, SALTS = 200_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anything between words: ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Match:
    """Words of a window, and distinct terms of a proximity match (0: none are looked for)."""

    window: int = 10
    near: int = 4


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null as empty."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def store_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row``, ``uid`` (a number of the row), ``words`` and ``n_words``, written once."""
    row = as_row(docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in keep]))
    out = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("uid"), words_of(F.col(f"`{text}`")).alias("words"))
    return write_and_read(out.withColumn("n_words", F.size("words").cast("long")))


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST + 1).count() <= BROADCAST


def _only(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is among the terms."""
    return rows.join(F.broadcast(terms) if _small(terms) else terms, "term", "left_semi")


def windows_of(benchmark: DataFrame, id: str = "item_id", text: str = "text", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``wid``, ``window``), and the items (``wid``, ``item``) that have them."""
    item = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, words_of(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    found = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), width).alias("window")).distinct()
    found = cut_lineage(found)
    windows = cut_lineage(found.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return windows, found.join(windows, "window").select("wid", "item")


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms (column ``term``) occurs: ``term``, ``n``; 0 where it does not."""
    counts = _only(tokens.select(F.explode("words").alias("term")), terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def by_rarity(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with ``term`` and ``offset`` (their rarest word, ties the first) and ``others``:
    their other distinct terms with the first offset of each, from the next rarest on.

    Windows with a word that no document has are left out, as they cannot occur.
    """
    words = windows.select("wid", "window", F.posexplode("window").alias("offset", "term")).join(counts, "term")
    order = F.struct("n", "offset", "term")
    ranked = words.groupBy("wid", "window", "term", "n").agg(F.min("offset").alias("offset")).groupBy("wid", "window").agg(
        F.sort_array(F.collect_list(order)).alias("terms")  # at most as many as a window has words
    )
    ranked = ranked.filter(F.col("terms")[0]["n"] > 0)
    return ranked.select("wid", "window", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["offset"].alias("offset"), F.slice("terms", 2, F.size("terms")).alias("others"))


def store_index(tokens: DataFrame, terms: DataFrame, reach: int = 9) -> DataFrame:
    """Postings of the terms: ``term``, ``uid``, ``pos``, ``around`` (the words up to ``reach`` words
    away) and ``before`` (how many of them stand before), written once."""
    rows = _only(tokens.select("uid", "words", F.posexplode("words").alias("pos", "term")), terms)
    before = F.least("pos", F.lit(reach))
    around = F.slice("words", F.col("pos") - before + 1, before + reach + 1)
    return write_and_read(rows.select("term", "uid", "pos", around.alias("around"), before.alias("before")))


def find(index: DataFrame, windows: DataFrame, near: int = 4) -> DataFrame:
    """``uid``, ``wid``, ``start`` (of the window in the document), ``size`` and ``exact`` of all matches.

    ``windows`` come from ``by_rarity``.
    """
    others = F.col("others")
    w = windows.select(
        "wid", "window", "term", "offset",
        F.coalesce(F.get(others, F.lit(0))["term"], F.col("term")).alias("second"),
        F.coalesce(F.get(others, F.lit(0))["offset"], F.col("offset")).alias("second_offset"),
        F.when(F.size("others") >= near - 1, F.transform(F.slice("others", 2, max(near - 2, 0)), lambda x: x["term"])).alias("rest"),
    )
    first = F.col("before") - F.col("offset")  # of the window, in the words around
    exact = (first >= 0) & (F.get("around", first + F.col("second_offset")) == F.col("second"))
    exact &= F.slice("around", F.greatest(first, F.lit(0)) + 1, F.size("window")) == F.col("window")
    exact = F.coalesce(exact, F.lit(False))
    close = F.forall(F.coalesce("rest", F.array(F.lit(None).cast("string"))), lambda x: F.coalesce(F.array_contains("around", x), F.lit(False)))
    wanted = F.array_contains("around", F.col("second")) & (exact | close) if near > 1 else exact
    if _small(w):
        pairs = index.join(F.broadcast(w), [index["term"] == w["term"], wanted])
    else:
        salt = F.pmod(F.xxhash64("uid", "pos"), F.lit(SALTS))
        left, right = index.withColumn("salt", salt), w.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        pairs = left.join(right, [left["term"] == right["term"], left["salt"] == right["salt"], wanted])
    return pairs.select("uid", "wid", (F.col("pos") - F.col("offset")).alias("start"), F.size("window").alias("size"), exact.alias("exact"))


def covered(matches: DataFrame) -> DataFrame:
    """``uid``, ``n_hit``: words inside any of the matches (``uid``, ``start``, ``size``)."""
    longest = matches.groupBy("uid", "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    reached = F.max("end").over(Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = longest.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reached, F.lit(0)))))
    return new.groupBy("uid").agg(F.sum("new").alias("n_hit"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    match: Match = Match(), keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``row``, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings, of exact matches) and ``near_items``
    (of proximity or exact matches) of every document. ``keep`` names the columns wanted in ``row``."""
    windows, owners = windows_of(benchmark, item_id, item_text, match.window)
    tokens = store_tokens(docs, text, keep)
    terms = cut_lineage(windows.select(F.explode("window").alias("term")).distinct())
    ranked = cut_lineage(by_rarity(windows, term_counts(tokens, terms)))
    index = store_index(tokens, ranked.select("term").distinct(), match.window - 1)
    matches = cut_lineage(find(index, ranked, match.near).groupBy("uid", "wid", "start", "size").agg(F.bool_or("exact").alias("exact")))
    hits = covered(matches.filter("exact").select("uid", "start", "size"))
    by_item = matches.groupBy("uid", "wid").agg(F.bool_or("exact").alias("exact")).join(F.broadcast(owners) if _small(owners) else owners, "wid")
    items = by_item.groupBy("uid", "item").agg(F.bool_or("exact").alias("exact")).groupBy("uid").agg(
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.sort_array(F.collect_list("item")).alias("near_items")
    )
    none = F.array().cast("array<string>")
    out = tokens.select("row", "uid", "n_words").join(hits.join(items, "uid", "full"), "uid", "left")
    return out.select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: float = 0.0, **names) -> DataFrame:
    """Documents of which at most this share of the words is inside exact matches, with their own columns."""
    out = contamination(docs, benchmark, text, **names)
    return out.filter(F.col("n_hit") <= F.lit(share) * F.col("n_words")).select("row.*")
