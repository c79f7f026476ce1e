"""Text functions of entity cleaning and display, as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Inside a character class: all that counts as white space, in ASCII and beyond.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Patterns, careers, institutions and roles that are never entities.
INVALID_PATTERNS = [
    r"maestri?a en", r"master en", r"magister en", r"m\.sc\.? en", r"msc en",
    r"doctor en", r"doctorado en", r"ph\.?d\.? en",
    r"bachiller en", r"licenciatura en", r"lic\.? en",
    r"(?:^|\s)ingenieri?a (?:de|en|industrial|de sistemas|de software|informatica|de computacion)(?:\s|$)",
    r"sistemas de informacion", r"ciencias de la computacion", r"computacion e informatica",
    r"administracion$", r"contabilidad$", r"economia$", r"derecho$", r"medicina$",
]
CAREERS = [
    "sistemas de informacion", "ingenieria de software", "ingenieria de sistemas", "ingenieria industrial",
    "ingenieria informatica", "ingenieria de computacion", "ciencias de la computacion", "computacion e informatica",
    "administracion", "contabilidad", "economia", "derecho", "medicina", "educacion", "pedagogia",
]
INSTITUTIONS = ["universidad ", "instituto ", "escuela ", "facultad ", "colegio "]
ROLES = [
    "gerente ", "jefe ", "director ", "superintendente ", "apoderado ", "asistente ", "analista ", "consultor ",
    "asesor ", "coordinador ", "encargado ", "presidente ", "miembro ", "profesor ", "docente ",
]
UNDECLARED = "[No declarado]"


@cache
def _plain_letters(form: str) -> tuple[str, str, dict[str, str]]:
    """What a Unicode decomposition leaves in ASCII: characters with one plain character, these,
    and the characters with several (as ligatures have). Every code point is asked."""
    one, many = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.decomposition(c):
            plain = unicodedata.normalize(form, c).encode("ascii", "ignore").decode()
            if plain:
                (one if len(plain) == 1 else many)[c] = plain
    return "".join(one), "".join(one.values()), many


def _ranges(chars: Iterable[str], gap: int = 16) -> str:
    """A character class of few ranges around the characters, as long classes match slowly."""
    out: list[list[str]] = []
    for c in sorted(chars):
        if out and ord(c) - ord(out[-1][1]) <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{a}-{b}" for a, b in out) + "]"


def _ascii(s: Column, form: str = "NFKD") -> Column:
    """The characters of the decomposition that are ASCII; the others are dropped.

    Texts of ASCII are left alone, and texts of ASCII and Latin letters (nearly all others)
    are translated by the few letters that they can have: those that are ASCII then, which
    is found far sooner than by a class of the letters. In all others, characters of one
    plain character are translated; texts with others near those of several are cut at
    these, and they are looked up.
    """
    marked, plain, many = _plain_letters(form)
    text = F.coalesce(s, F.lit(""))
    letters = [c for c in map(chr, range(0xC0, 0x180)) if c not in many]
    known = dict(zip(marked, plain))
    letters.sort(key=lambda c: c not in known)  # those without a plain letter come last and are dropped
    latin = F.translate(text, "".join(letters), "".join(known[c] for c in letters if c in known))
    beyond = r"[^\x00-\x7F]"
    return F.when(~text.rlike(beyond), text).when(~latin.rlike(beyond), latin).otherwise(_spelled(text, marked, plain, many))


def _spelled(text: Column, marked: str, plain: str, many: dict[str, str]) -> Column:
    if many:
        near = _ranges(many)
        table = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
        cut = F.split(text, f"(?<={near})|(?={near})", -1)
        spelled = F.array_join(F.transform(cut, lambda x: F.when(x.rlike(near), F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")
        text = F.when(text.rlike(near), spelled).otherwise(text)
    return F.regexp_replace(F.translate(text, marked, plain), r"[^\x00-\x7F]", "")


def normalize_text(s: Column) -> Column:
    """Plain lower-case text with single spaces; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(_ascii(s), r"[\t-\r\x1c-\x20]+", " ")))


def strip(s: Column) -> Column:
    """Without the white space around it."""
    return F.regexp_replace(s, f"^[{BLANK}]+|[{BLANK}]+$", "")


def strip_tag(s: Column) -> Column:
    """The entity without its "(inferido)" mark; what stood around the mark is joined."""
    return strip(F.regexp_replace(s, rf"(?i)[{BLANK}]*\(inferido\)[{BLANK}]*", ""))


def is_invalid_entity(s: Column) -> Column:
    """Empty, or by pattern, career (contained either way), institution or role no entity."""
    careers = F.array(*[F.lit(c) for c in CAREERS])

    def judge(t: Column) -> Column:
        return (
            (t == "")
            | t.rlike("|".join(INVALID_PATTERNS))
            | F.exists(careers, lambda c: F.contains(t, c) | F.contains(c, t))
            | t.rlike("|".join(INSTITUTIONS))
            | t.rlike("^(?:" + "|".join(ROLES) + ")")
        )

    return F.transform(F.array(normalize_text(s)), judge)[0]  # a list of one, so that it is normalised once


def is_supported(normal_entity: Column, normal_text: Column) -> Column:
    """Is the normalised entity, or each of its words of over three letters, in the normalised text?"""
    long = F.filter(F.split(normal_entity, " "), lambda w: F.char_length(w) > 3)
    every = (F.size(long) > 0) & F.forall(long, lambda w: F.contains(normal_text, w))
    return (normal_text != "") & (F.contains(normal_text, normal_entity) | every)


def appears_in_text(entity: Column, normal_text: Column) -> Column:
    """The same for an entity as it was found; an empty one is in no text."""
    e = F.coalesce(entity, F.lit(""))
    return (e != "") & is_supported(normalize_text(strip_tag(e)), normal_text)


def name_words(s: Column) -> Column:
    """Upper-case plain words of a person's name, in order, repeats included."""
    t = F.trim(F.regexp_replace(F.upper(_ascii(s, "NFD")), "[^A-Z0-9]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def name_score(a: Column, b: Column) -> Column:
    """Share of the shorter name's words that the longer has; arrays of words."""
    def score(x: Column, y: Column) -> Column:
        return F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.greatest(F.size(x), F.lit(1))

    return F.when(F.size(a) <= F.size(b), score(a, b)).otherwise(score(b, a))


def round2(x: Column) -> Column:
    """Two decimals, halves up, as both engines of our checks agree on."""
    return F.floor(x * 100 + 0.5) / 100


def display_name(s: Column) -> Column:
    """Lower-case name; null becomes empty."""
    return F.lower(F.coalesce(s, F.lit("")))


def report_slug(s: Column) -> Column:
    """File name of a report: spaces become underscores, thirty characters at most."""
    return F.substring(F.replace(F.coalesce(s, F.lit("curso")), F.lit(" "), F.lit("_")), 1, 30)


def evidence_key(evidence: Column, kind: DataType) -> Column:
    """JSON with sorted keys as the identity of a piece of evidence; a text is its own.

    Structs and maps with the same fields in another order are the same evidence; a field
    that is null differs from one that is absent.
    """
    def in_order(x: Column, t: DataType) -> Column:
        if isinstance(t, StructType):
            fields = sorted(t.fields, key=lambda f: f.name)
            return F.when(x.isNotNull(), F.struct(*[in_order(x[f.name], f.dataType).alias(f.name) for f in fields]))
        if isinstance(t, MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(x, lambda _, v: in_order(v, t.valueType)))))
        if isinstance(t, ArrayType):
            return F.transform(x, lambda v: in_order(v, t.elementType))
        return x

    if isinstance(kind, StringType):
        return evidence
    if isinstance(kind, (StructType, MapType, ArrayType)):
        return F.to_json(in_order(evidence, kind), {"ignoreNullFields": "false"})
    return evidence.cast("string")


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key, or the key itself."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)
