"""Hits joined with their records, and records read from tolerant JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.session import cut_lineage

UNHYDRATED = "No record was found for this id"
IDS = ("chunk_id", "id", "_id", "point_id", "vector_id")
META_IDS = ("chunk_id", "id", "_id")
TEXTS = tuple("text page_content content document".split())
PAGES = ("page_num", "page", "page_number")
SOURCES = ("source_doc", "source", "document_id")
METAS = ("metadata", "payload", "fields")


class Source:
    """Records kept elsewhere, which are asked for by id: ``for_ids(ids)`` gives those of some ids (chunk_id), and no others."""

    def __init__(self, fetch: Callable[[DataFrame], DataFrame]):
        self.fetch = fetch

    def for_ids(self, ids: DataFrame) -> DataFrame:
        return self.fetch(ids.select("chunk_id").distinct())


def of(records: DataFrame | Source, ids: DataFrame) -> DataFrame:
    """The records of some ids: a table as it is (the join selects them), a source asked for just these."""
    return records.for_ids(ids) if isinstance(records, Source) else records


def hydrate(hits: DataFrame, records: DataFrame | Source, allow_unhydrated: bool = True) -> DataFrame:
    """``hits`` (chunk_id, score, ...) with text, source_doc and page_num; without a record: an empty text, or no row."""
    if isinstance(records, Source):
        hits = cut_lineage(hits)  # the ids are needed to ask, and the hits again to join
    r = of(records, hits).select("chunk_id", "text", "source_doc", "page_num")
    if not allow_unhydrated:
        return hits.join(r, "chunk_id").withColumn("explanation", F.lit(None).cast("string"))
    out = hits.join(r, "chunk_id", "left")
    return out.withColumn("explanation", F.when(F.col("text").isNull(), F.lit(UNHYDRATED))).withColumn("text", F.coalesce("text", F.lit("")))


def hydrate_fallback(hits: DataFrame, local: DataFrame, external: DataFrame | Source) -> DataFrame:
    """The local snapshot first; the external source is asked for the hits that it lacks, and for nothing else."""
    if isinstance(external, Source):
        hits = cut_lineage(hits)
    a = local.select("chunk_id", F.col("text").alias("local_text"))
    missing = hits.select("chunk_id").distinct().join(a, "chunk_id", "left_anti")
    b = of(external, missing).select("chunk_id", F.col("text").alias("external_text")).join(missing, "chunk_id", "left_semi")
    out = hits.join(a, "chunk_id", "left").join(b, "chunk_id", "left")
    return out.withColumn("text", F.coalesce("local_text", "external_text", F.lit(""))).drop("local_text", "external_text")


def hydrate_batch(hits: DataFrame, records: DataFrame | Source) -> DataFrame:
    """Hits of many queries; each record is fetched once, then fanned out."""
    if isinstance(records, Source):
        return hydrate(hits, records)
    wanted = hits.select("chunk_id").distinct()
    fetched = records.join(wanted, "chunk_id", "left_semi")
    return hydrate(hits, fetched)


def _get(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _first(*columns: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def coerce_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, chunk_id, text, source_doc, page_num, section, metadata, embedding, error) of JSON lines with any of the known key names.

    Metadata comes back as JSON text, without the keys that became columns, but with the section. ``error`` names what is missing.
    """
    v = F.try_parse_json(F.col(column))
    meta = F.coalesce(*(F.when(F.schema_of_variant(_get(v, m, "variant")).startswith("OBJECT"), _get(v, m, "variant")) for m in METAS))
    # variant_get of a missing or JSON-null value is NULL for every kind used here
    base = lines.withColumn("__v", v).withColumn("__m", meta)
    v, m = F.col("__v"), F.col("__m")
    cid = _first(*(_get(v, n) for n in IDS), *(_get(m, n) for n in META_IDS))
    text = _first(*(_get(v, n) for n in TEXTS), *(_get(m, n) for n in TEXTS))
    source = _first(*(_get(v, n) for n in SOURCES), *(_get(m, n) for n in SOURCES))
    page = F.coalesce(*(F.expr(f"try_cast(nullif(trim(try_variant_get({side}, '$.{n}', 'string')), '') as int)") for side in ("__v", "__m") for n in PAGES))
    section = _first(_get(v, "section"), _get(m, "section"))
    reserved = sorted({*IDS, *TEXTS, *PAGES, *SOURCES, "section"})
    fields = F.coalesce(F.try_variant_get(m, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(fields, lambda k, _: ~k.isin(reserved))
    out = base.select(
        *(c for c in lines.columns if c != column),
        cid.alias("chunk_id"),
        text.alias("text"),
        source.alias("source_doc"),
        page.alias("page_num"),
        section.alias("section"),
        F.to_json(kept).alias("metadata"),
        _get(v, "embedding", "array<float>").alias("embedding"),
        F.when(v.isNull(), "not JSON").when(cid.isNull(), "no id").when(text.isNull(), "no text").alias("error"),
    )
    joined = F.when(F.col("section").isNull(), F.col("metadata")).when(F.col("metadata") == "{}", F.to_json(F.struct("section"))).otherwise(F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.lit(","), F.expr("substring(to_json(struct(section)), 2)")))
    return out.withColumn("metadata", joined)
