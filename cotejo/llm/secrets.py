"""Secret scans with multipart credential linking (DataFrame functions only).

Strong secrets (``assign``, ``access``, ``hex``) are reported wherever they occur. Weak
candidates - access identifiers or user names, secret values of any length, endpoints - are
reported only where complementary parts stand in the same scope, that is, at most
``scope`` code points apart without overlapping: a weak identifier needs a secret, a weak
secret needs an identifier or an endpoint, and an endpoint needs both an identifier and a
secret. A weak access identifier that overlaps an assignment is that secret's own value and
no part of its own.

The parts of a text are joined with their scopes as intervals by sweeps over their sorted
begins and ends in the row, so nothing is shuffled and no pair is emitted. A sweep gathers
its results in blocks of blocks, so a text of a million parts costs no square of their number.

Spans are (start, end exclusive) in code points. A null text counts as empty; repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import as_row, let, once

#: Fixed patterns of the base scan. Letters of the words stand in either case.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Patterns of the weak parts.
WEAK_ACCESS = r"AKIA[A-Z0-9]+"
USER = r"""(?i:user|username|login|account|client_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
ENDPOINT = r"""[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(?::[0-9]+)?"""

#: Kinds in the order that breaks ties of equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_access", "user", "endpoint")
#: Code points of the chunks from which redacted texts are put together.
CHUNK = 1024
#: Events, or blocks of them, that share a list of results in a sweep, and how many levels of blocks there are.
WIDTH, LEVELS = 32, 3


class Weak(NamedTuple):
    """What counts as a weak part: the pattern of users, the least lengths of secrets and access identifiers."""

    user: str = USER
    secret: int = 1
    access: int = 5


def _sweep(events: Column, zero: dict[str, Column], step: Callable, result: Callable, kind: str) -> Column:
    """Results of the events, in order, under a running state.

    ``step(state, event)`` gives the fields of the next state, ``result(state, event)`` (of
    the state before it) what the event adds; null adds nothing.

    ``aggregate`` copies its whole accumulator at every element, so results are gathered in
    blocks of blocks: a block begins with no results and adds its own to those before it when
    it is done. A result is copied some ``WIDTH / 2`` times a level, whatever their number.
    """
    none = F.array().cast(f"array<{kind}>")

    def next_state(a: Column, e: Column) -> Column:
        found = result(a, e)
        out = F.when(found.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(found)))
        return F.struct(*[v.alias(k) for k, v in step(a, e).items()], out.alias("out"))

    def state(a: Column, out: Column) -> Column:
        return F.struct(*[a[k].alias(k) for k in zero], out.alias("out"))

    def run(x: Column) -> Column:
        def blocks(level: int) -> Column:
            return F.ceil(F.size(x) / WIDTH**level).cast("int")

        def block(level: int, a: Column, i: Column) -> Column:
            """The state behind the i-th block of ``WIDTH ** level`` events."""
            if level == 0:
                return next_state(a, F.get(x, i))  # a slice would copy all of x
            numbers = F.sequence(i * WIDTH, F.least((i + 1) * WIDTH, blocks(level - 1)) - 1)
            return F.aggregate(numbers, state(a, none), lambda c, j: block(level - 1, c, j), lambda c: state(c, F.concat(a["out"], c["out"])))

        first = F.struct(*[v.alias(k) for k, v in zero.items()], none.alias("out"))
        every = F.sequence(F.lit(0), blocks(LEVELS) - 1)
        return F.when(F.size(x) == 0, none).otherwise(F.aggregate(every, first, lambda a, i: block(LEVELS, a, i))["out"])

    return let(events, run)


_SPAN = "struct<s:int,e:int,m:string>"


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs s, e, m (start, end, matched text).

    The texts between the matches come from ``split``; starts are running sums of lengths.
    """
    def locate(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            pieces = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("n")))

            def span(a: Column, x: Column) -> Column:
                start = a["at"] + x["gap"]
                return F.struct(start.alias("s"), (start + x["n"]).alias("e"), x["m"].alias("m"))

            return _sweep(pieces, {"at": F.lit(0)}, lambda a, x: {"at": a["at"] + x["gap"] + x["n"]}, span, _SPAN)

        return F.when(F.size(found) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), locate)


def _parts(spans: Column, kind: int, role: str, weak: bool) -> Column:
    """Spans as parts: start, kind, end, role (i identifier, s secret, e endpoint), weak."""
    return F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), F.lit(role).alias("r"), F.lit(weak).alias("w")
        ),
    )


def _apart(access: Column, assigned: Column) -> Column:
    """The access spans that overlap no assignment (assignments do not overlap one another)."""
    def event(x: Column, at: str, ask: int) -> Column:
        return F.struct(x[at].alias("at"), F.lit(ask).alias("turn"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))

    # an assignment that begins before the end of an access span overlaps it if it ends behind its start
    events = F.sort_array(F.concat(F.transform(access, lambda x: event(x, "e", 0)), F.transform(assigned, lambda x: event(x, "s", 1))))
    free = _sweep(
        events, {"end": F.lit(-1)}, lambda a, x: {"end": F.when(x["turn"] == 1, x["e"]).otherwise(a["end"])},
        lambda a, x: F.when((x["turn"] == 0) & (a["end"] <= x["s"]), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))), _SPAN,
    )
    return F.when((F.size(access) == 0) | (F.size(assigned) == 0), access).otherwise(free)


def _linked(parts: Column, scope: int) -> Column:
    """Strong parts, and weak ones with complementary parts in their scope."""
    far = 1 << 30

    def near(p: Column, back: bool) -> Column:
        """For each weak part, in order of its place: does a part of role i, s, e end (or, backwards, begin) within the scope?"""

        def event(x: Column, i: Column, at: Column, turn: int) -> Column:
            return F.struct(at.alias("at"), F.lit(turn).alias("turn"), i.alias("i"), x["r"].alias("r"), x["w"].alias("w"))

        ends = F.transform(p, lambda x, i: event(x, i, -x["s"] if back else x["e"], 0))
        begins = F.filter(F.transform(p, lambda x, i: event(x, i, -x["e"] if back else x["s"], 1)), lambda x: x["w"])

        def step(a: Column, x: Column) -> dict[str, Column]:
            return {r: F.when((x["turn"] == 0) & (x["r"] == r), x["at"]).otherwise(a[r]) for r in "ise"}

        def result(a: Column, x: Column) -> Column:
            return F.when(x["turn"] == 1, F.struct(x["i"].alias("n"), *[(a[r] >= x["at"] - scope).alias(r) for r in "ise"]))

        kind = "struct<n:int,i:boolean,s:boolean,e:boolean>"
        return F.sort_array(_sweep(F.sort_array(F.concat(ends, begins)), {r: F.lit(-far) for r in "ise"}, step, result, kind))

    def join(p: Column) -> Column:
        def has(b: Column, a: Column) -> Column:
            return F.struct(*[(b[r] | a[r]).alias(r) for r in "ise"])

        def wanted(x: Column, h: Column) -> Column:
            return ((x["r"] == "i") & h["s"]) | ((x["r"] == "s") & (h["i"] | h["e"])) | ((x["r"] == "e") & h["i"] & h["s"])

        both = F.zip_with(near(p, False), near(p, True), has)
        weak = F.filter(p, lambda x: x["w"])
        kept = F.filter(F.zip_with(weak, both, lambda x, h: F.when(wanted(x, h), x)), lambda x: x.isNotNull())
        return F.sort_array(F.concat(F.filter(p, lambda x: ~x["w"]), kept))

    return let(
        F.sort_array(parts),
        lambda p: F.when(F.exists(p, lambda x: x["w"]) & (F.size(p) > 1), join(p)).otherwise(F.filter(p, lambda x: ~x["w"])),
    )


def secret_spans(text: Column, scope: int = 200, min_secret: int = 12, weak: Weak = Weak()) -> Column:
    """All reported parts of a text, by start, kind and end."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def value_length(x: Column) -> Column:
        return F.char_length(F.regexp_extract(x["m"], ASSIGN, 2))

    def build(assigned: Column, access: Column) -> Column:
        long = F.filter(assigned, lambda x: value_length(x) >= min_secret)
        short = F.filter(assigned, lambda x: value_length(x).between(weak.secret, min_secret - 1))
        strong = F.filter(access, lambda x: x["e"] - x["s"] >= 18)
        brief = F.filter(access, lambda x: (x["e"] - x["s"]).between(weak.access, 17))
        return _linked(
            F.concat(
                _parts(long, 0, "s", False),
                _parts(strong, 1, "i", False),
                _parts(match_spans(t, HEX), 2, "s", False),
                _parts(short, 3, "s", True),
                _parts(_apart(brief, assigned), 4, "i", True),
                _parts(match_spans(t, weak.user), 5, "i", True),
                _parts(match_spans(t, ENDPOINT), 6, "e", True),
            ),
            scope,
        )

    return let(match_spans(t, ASSIGN), lambda a: let(match_spans(t, WEAK_ACCESS), lambda b: build(a, b)))


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = 200, weak: Weak = Weak()) -> DataFrame:
    """Columns ``row`` (the input row) and ``parts`` (structs s, k, e, r, w; see ``KINDS``)."""
    return docs.select(as_row(docs).alias("row")).select("row", once(secret_spans(F.col("row")[text], scope, weak=weak)).alias("parts"))


def span_list(parts: Column) -> Column:
    """``kind:start:end`` of each part, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(parts, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; every reported span of the text becomes ``mark``.

    Overlapping spans become one mark. Texts without secrets, and null texts, stay.
    """
    scanned = scan_secrets(docs, text, scope)
    t = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))

    def between(chunks: Column, start: Column, end: Column) -> Column:
        """The text from start to end, of the chunks it lies in."""
        def piece(c: Column) -> Column:
            low = F.greatest(start - c * CHUNK, F.lit(0))
            return F.substring(F.get(chunks, c), low + 1, F.least(end - c * CHUNK, F.lit(CHUNK)) - low)

        numbers = F.sequence((start / CHUNK).cast("int"), ((end - 1) / CHUNK).cast("int"))
        return F.when(end > start, F.array_join(F.transform(numbers, piece), "")).otherwise("")

    def rebuild(p: Column) -> Column:
        last = F.struct(F.char_length(t).alias("s"), F.char_length(t).alias("e"))
        spans = F.concat(F.transform(p, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.array(last))

        def gaps(chunks: Column) -> Column:
            def gap(a: Column, x: Column) -> Column:
                return F.when(x["s"] >= a["at"], between(chunks, a["at"], x["s"]))

            return _sweep(spans, {"at": F.lit(0)}, lambda a, x: {"at": F.greatest(a["at"], x["e"])}, gap, "string")

        return F.array_join(let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), gaps), mark)

    own = F.col("row")[text].cast("string")
    fixed = F.when(F.size("parts") > 0, rebuild(F.col("parts"))).otherwise(own)
    return scanned.select("row", fixed.alias("fixed")).select(
        *[F.col("fixed").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    )
