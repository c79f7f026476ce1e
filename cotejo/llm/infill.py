"""Fill-in-the-middle transformation of documents.

A text is matched once, as a whole, by ``(unit)*`` of the regex library, which keeps every
repetition of a group: the ends of all repetitions give the number of units and, looked up
at two of them, both cut offsets. Texts of more than ``BLOCK`` units are matched by as many
such matches as they have blocks, each from where the last one ended; of a block only the
ends are kept, eight bytes a unit.

Four numbers from a hash of seed and id decide on the cuts and on the form, so a document
is cut alike wherever it stands and however often a job is run again:

* ``plain``: the text as it is, for a share of the documents, for empty texts, and for
  texts that hold a mark or that the units do not match wholly;
* ``psm``: mark P, prefix, mark S, suffix, mark M, middle;
* ``spm``: mark S, suffix, mark P, prefix, mark M, middle.

Defined results: a null text counts as empty; a null id counts as the empty text in the
hash; rows that repeat are cut alike, one by one; an empty table gives an empty result;
other columns, whatever their names, pass through in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import as_row, once

#: Units of one match; the library keeps some 100 bytes for each while it lasts.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Plan:
    """How documents are cut. A unit must not match an empty text."""

    unit: str = "."
    seed: int = 1
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(pattern: regex.Pattern, blocks: regex.Pattern, text: str) -> np.ndarray | None:
    """Ends of the units that the text consists of; None if it does not."""
    if len(text) <= BLOCK:
        m = pattern.fullmatch(text)
        return m and np.array(m.ends(1), np.int64)
    found, at = [], 0
    while at < len(text):
        m = blocks.match(text, at)
        if m.end() == at:
            return None
        found.append(np.array(m.ends(1), np.int64))
        at = m.end()
    return np.concatenate(found)


class Cutter:
    """Forms of texts by one plan."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.pattern = regex.compile(f"({plan.unit})*", regex.DOTALL)
        self.blocks = regex.compile(f"((?>{plan.unit})){{0,{BLOCK}}}+", regex.DOTALL)

    def cut(self, text: str, id: str) -> tuple[int, str, int | None, int | None, str]:
        """Units, form, units of the prefix and of the middle, and the output."""
        p = self.plan
        ends = unit_ends(self.pattern, self.blocks, text)
        n = 0 if ends is None else len(ends)
        digest = hashlib.sha256(f"{p.seed}:{id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if n == 0 or any(x in text for x in p.marks) or h3 % 100 >= 100 - p.plain_percent:
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = (int(ends[k - 1]) if k else 0 for k in (a, b))
        first, second, third = p.prefix + text[:i], p.suffix + text[j:], p.middle + text[i:j]
        if h4 % 100 < p.spm_percent:
            return n, "spm", a, b - a, second + first + third
        return n, "psm", a, b - a, first + second + third


def _cutter(plan: Plan):
    @F.pandas_udf("n bigint, form string, prefix bigint, middle bigint, output string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(plan)
        for texts, ids in batches:
            cols = list(zip(*map(cutter.cut, texts, ids))) or [()] * 5
            whole = [pd.array(c, "Int64") for c in (cols[0], cols[2], cols[3])]
            yield pd.DataFrame({"n": whole[0], "form": pd.Series(cols[1], dtype=object), "prefix": whole[1], "middle": whole[2], "output": pd.Series(cols[4], dtype=object)})

    return run


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", plan: Plan = Plan(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row``, ``n`` (units), ``form``, ``prefix_units``, ``middle_units`` (null if plain) and ``output``.

    ``keep`` names the columns wanted in ``row`` (by default all).
    """
    row = as_row(docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in keep]))
    t, key = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, id))
    out = docs.select(row.alias("row"), t.alias("t"), key.alias("k")).select("row", once(_cutter(plan)("t", "k")).alias("x"))
    return out.select("row", "x.n", "x.form", F.col("x.prefix").alias("prefix_units"), F.col("x.middle").alias("middle_units"), "x.output")


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output was made of."""
    p, s, m = (F.lit(x) for x in plan.marks)
    head = F.split_part(output, m, F.lit(1))
    third = F.split_part(output, m, F.lit(2))
    psm = F.concat(F.split_part(F.split_part(head, p, F.lit(2)), s, F.lit(1)), third, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), third, F.split_part(F.split_part(head, s, F.lit(2)), p, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
