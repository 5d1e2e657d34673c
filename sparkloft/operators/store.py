"""The chunk store as a table: lookups, inserts, updates, deletes, results and boosts.

Chunks are rows (chunk_id, text, source, ...). Every write gives the new table; the caller decides where it goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloft.operators.ordered import newest, place
from sparkloft.operators.retrieval import top

# Keys of a hit that its metadata does not repeat.
RESULT_KEYS = ("source", "file_path", "source_type", "language")


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk of an id, or no row; the condition reaches the scan."""
    return chunks.where(F.col("chunk_id") == chunk_id)


def existing(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id): those of the wanted ids that the store has; no other column is read."""
    return wanted.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def ids_where(chunks: DataFrame, where: Column) -> DataFrame:
    return chunks.where(F.coalesce(where, F.lit(False))).select("chunk_id")


def id_source_pairs(chunks: DataFrame, where: Column) -> DataFrame:
    return chunks.where(F.coalesce(where, F.lit(False))).select("chunk_id", "source")


def metadata(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """All columns but texts and vectors of the wanted ids."""
    columns = [c for c in chunks.columns if c not in ("text", "embedding")]
    return chunks.select(*columns).join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")


def insert_only(chunks: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Adds the chunks whose ids are not there yet; those that are stay as they are. Of rows with one id in ``new`` the last in the order is added."""
    fresh = newest(new, ("chunk_id",), order).join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return chunks.unionByName(fresh, allowMissingColumns=True)


def update(chunks: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Sets columns of chunks that exist: of changes (chunk_id, ...) the columns that are not null. Unknown ids change nothing.

    Metadata and embeddings are updated this way without the text being touched. Of changes to one column of a chunk the last in the order counts.
    """
    columns = [c for c in changes.columns if c != "chunk_id" and c in chunks.columns]
    placed = changes.withColumn("__at", place(changes, order))
    new = placed.groupBy("chunk_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(f"__{c}") for c in columns])
    joined = chunks.join(new, "chunk_id", "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in chunks.columns])


def delete(chunks: DataFrame, where: Column | None) -> tuple[DataFrame, int]:
    """The chunks that do not match, and how many did. No condition deletes nothing; a null condition does not match."""
    if where is None:
        return chunks, 0
    hit = F.coalesce(where, F.lit(False))
    return chunks.where(~hit), chunks.where(hit).count()


def delete_ids(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")


def swap(chunks: DataFrame, new: DataFrame, deferred: DataFrame, order: str | None = None) -> DataFrame:
    """Add, then take away: a file's new chunks replace those of their ids, then the ids whose removal was put off go, but for those
    that the new chunks brought back. deferred: (chunk_id)."""
    added = delete_ids(chunks, new).unionByName(newest(new, ("chunk_id",), order), allowMissingColumns=True)
    return delete_ids(added, deferred.select("chunk_id").join(new.select("chunk_id"), "chunk_id", "left_anti"))


def orphan_chunks(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """(chunk_id): chunks that no manifest names. Without any manifest entry that would be all of them, so it is refused."""
    known = manifests.select("chunk_id").where("chunk_id is not null")
    if known.isEmpty():
        raise ValueError("no manifest names a chunk: all chunks would be orphans")
    return chunks.select("chunk_id").join(known, "chunk_id", "left_anti")


def results(hits: DataFrame) -> DataFrame:
    """(chunk_id, text, source, score, source_type, language, metadata): hits as results; what has a place of its own is not repeated
    in the metadata, a missing source type is doc, a missing source unknown."""
    own = ("chunk_id", "text", "score", "embedding", *RESULT_KEYS)
    rest = [c for c in hits.columns if c not in own]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    held = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    source = F.coalesce(*[F.col(c) for c in ("source", "file_path") if c in hits.columns], F.lit("unknown"))
    language = F.col("language") if "language" in hits.columns else F.lit(None).cast("string")
    kind = F.coalesce(F.col("source_type"), F.lit("doc")) if "source_type" in hits.columns else F.lit("doc")
    return hits.select(
        "chunk_id", "text", source.alias("source"), "score", kind.alias("source_type"), language.alias("language"), held.alias("metadata")
    )


def documents(chunks: DataFrame, contains: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """(source, chunks, newest): documents of a store by name, a page of them."""
    rows = chunks.where(F.contains("source", F.lit(contains))) if contains else chunks
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.max("created_at").alias("newest")).orderBy("source").offset(offset).limit(limit)


def document_counts(chunks: DataFrame) -> DataFrame:
    """(kind, folder, n): chunks of code and of documents by folder."""
    kind = F.when(F.col("source_type") == "code", "code").otherwise("doc").alias("kind")
    return chunks.groupBy(kind, "folder").agg(F.count("*").alias("n"))


def ingested_sources(chunks: DataFrame, source: str = "source_id", at: str = "ingested_at") -> DataFrame:
    return chunks.groupBy(F.col(source).alias("source_id")).agg(F.count("*").alias("chunk_count"), F.max(at).alias("ingested_at"))


def source_page(chunks: DataFrame, source_id: str, source: str, index: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a source's chunks in their order."""
    return chunks.where(F.col(source) == source_id).orderBy(index, "chunk_id").offset(offset).limit(limit)


def reference_boost(results: DataFrame, references: DataFrame, k: int, floor: float = 0.35, factor: float = 1.0, recalled: int = 2) -> DataFrame:
    """Merges the catalog entries that recall found into results that lack them; k remain.

    results: (chunk_id, score, source, ...); references: (id, score, ...): the best ``recalled`` of them count, from ``floor`` on, times
    ``factor``. Adds kind, chunk or reference.
    """
    best = references.orderBy(F.desc("score"), "id").limit(recalled).where(F.col("score") >= floor)
    extra = best.join(results.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    mine = results.select("chunk_id", "score", "source", F.lit("chunk").alias("kind"))
    theirs = extra.select(
        F.col("id").alias("chunk_id"), (F.col("score") * factor).alias("score"), F.concat(F.lit("reference/"), "id").alias("source"),
        F.lit("reference").alias("kind")
    )
    return top(mine.unionByName(theirs), k)
