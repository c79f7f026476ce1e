"""Cleaning of the entities that were found in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import UNDECLARED, is_invalid_entity, is_supported, normalize_text, strip, strip_tag
from cotejo.operators.semantic import drop_near_concepts, supported
from cotejo.sources.scratch import stored


def clean_entities(
    entities: DataFrame, documents: DataFrame, least: int = 3, most: int = 6, undecided: str = "drop",
    concepts: DataFrame | None = None, sentence_vectors: DataFrame | None = None, threshold: float = 0.72, sentence_key: str = "doc_id",
) -> DataFrame:
    """``doc_id``, ``entidades``: the first ``most`` valid entities of every document.

    Blank ones are dropped, then later repeats of one normal form, then invalid ones, then
    those near a concept, then those that the text does not support: not by its words and,
    where there are sentence vectors, by no sentence. ``undecided`` says what becomes of
    the entities that the words do not support where there are no sentence vectors.
    ``concepts`` has ``embedding``, ``sentence_vectors`` doc_id and ``embedding``; entities
    then have an ``embedding`` too. What has no vector, and a document without sentences,
    speaks for an entity; an empty text supports none. Documents that share sentences have
    ``sentence_key``, and so have the sentence vectors, which then need not be repeated.

    A document without any left gets the one entity that says so, unless ``least`` is 0.

    Candidates are reduced by (document, normal form) and gathered before they meet the
    texts, so each text is normalised once.
    """
    vector = ["embedding"] if "embedding" in entities.columns else []
    rows = entities.select("doc_id", "pos", strip(F.col("entidad")).alias("entidad"), *vector).filter("entidad <> ''")
    rows = rows.withColumn("key", normalize_text(strip_tag(F.col("entidad")))).filter("key <> ''")
    unique = rows.groupBy("doc_id", "key").agg(F.min(F.struct("pos", "entidad", *vector)).alias("x")).select("doc_id", "key", "x.*")
    valid = unique.filter(~is_invalid_entity(F.col("entidad")))
    if concepts is not None:
        valid = drop_near_concepts(valid, concepts, threshold).filter("kept")
    fields = ["pos", "entidad", "key", *vector]
    lists = valid.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found"))
    by_vectors = sentence_vectors is not None

    def judged(found: Column, normal: Column) -> Column:
        """Entities with ``ok``, null where the words leave it open."""
        open_ = F.lit(None).cast("boolean") if by_vectors else F.lit(undecided == "keep")

        def one(x: Column) -> Column:
            ok = F.when(normal == "", False).when(is_supported(x["key"], normal), True).otherwise(open_)
            return F.struct(*[x[f].alias(f) for f in fields], ok.alias("ok"))

        return F.transform(found, one)

    normal = F.array(normalize_text(F.col("text")))  # a list of one, so that it is computed once
    shared = [sentence_key] if by_vectors and sentence_key != "doc_id" else []
    checked = documents.join(lists, "doc_id", "left").select("doc_id", *shared, F.transform(normal, lambda n: judged(F.col("found"), n))[0].alias("found"))
    none = F.array(F.lit(UNDECLARED)) if least > 0 else F.array().cast("array<string>")
    if by_vectors:
        each = checked.select("doc_id", *shared, F.explode("found").alias("x")).select("doc_id", *shared, "x.*").dropDuplicates(["doc_id", "key"])
        open_only = {v: F.when(F.col("ok").isNull(), F.col(v)) for v in vector}
        each = stored(each.filter("coalesce(ok, true)").withColumns(open_only))  # for both uses
        near = supported(each.filter("ok is null"), sentence_vectors, sentence_key, threshold, own=("pos", "key")).filter("supported")
        kept = each.filter("ok").select("doc_id", "pos", "entidad").unionByName(near.select("doc_id", "pos", "entidad"))
        lists = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entidad"))).alias("kept"))
        checked = documents.select("doc_id").join(lists, "doc_id", "left")
    else:
        checked = checked.select("doc_id", F.filter("found", lambda x: x["ok"]).alias("kept"))
    names = F.slice(F.transform("kept", lambda x: x["entidad"]), 1, most)
    return checked.select("doc_id", F.when(F.size(F.coalesce("kept", F.array())) > 0, names).otherwise(none).alias("entidades"))
