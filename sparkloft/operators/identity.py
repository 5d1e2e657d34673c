"""People behind surface names and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.operators.ordered import running_total


def alias_valid(at: str) -> Column:
    """Half-open validity; open ends are null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def resolve(aliases: DataFrame, surface: str, scope: str | None, at: str) -> DataFrame:
    """(person_id): people a name can mean then, in the scope or everywhere."""
    where = (F.lower("surface") == surface.lower()) & (F.col("scope").isNull() | F.col("scope").eqNullSafe(F.lit(scope))) & alias_valid(at)
    return aliases.where(where).select("person_id").distinct()


_NAME = ("k", "timeless")  # mentions without a time see only aliases that are always valid: they are names of their own
_LAST = "\U0010ffff"  # after every time
_BASE = "10000000000000000000000"  # one person counts as this, plus the person's number


def _spans(aliases: DataFrame) -> DataFrame:
    """(k, timeless, scope, person, lo, hi): when a person has a name in a scope, in spans that neither touch nor overlap."""
    open_ended = F.col("valid_from").isNull() & F.col("valid_to").isNull()
    rows = aliases.where("surface IS NOT NULL AND person IS NOT NULL").select(
        F.lower("surface").alias("k"), "scope", "person", F.coalesce("valid_from", F.lit("")).alias("lo"), F.coalesce("valid_to", F.lit(_LAST)).alias("hi"),
        F.explode(F.when(open_ended, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("timeless")
    ).where("lo < hi").distinct()
    one = W.Window.partitionBy(*_NAME, "scope", "person").orderBy("lo", "hi")
    begins = F.coalesce(F.col("lo") > F.max("hi").over(one.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(one.rowsBetween(W.Window.unboundedPreceding, 0)))
    return rows.groupBy(*_NAME, "scope", "person", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def resolve_all(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention_id, person_id, candidates) of (mention_id, surface, scope, at): the person if there is just one candidate.

    A sweep instead of a join on the name: each person's validity becomes a step up and a step down on the line of (name, scope, time),
    a mention is a point on it, and the running total of the steps before it holds how many people the name means there and the sum
    of their numbers, which is the person's own number if there is one. Steps of a name add up to zero, so a total over
    all rows, by ranges, is a total in each name: no name, however common, meets in one task, and no pair of a mention and an alias is made.
    A mention reads two lines, of the aliases of any scope and of its own; who is on both counts once.
    Null names have no candidate; a null time meets only aliases that are always valid. Equal mentions count once.
    """
    people = aliases.where("person_id IS NOT NULL").select("person_id").distinct()
    people = running_total(people.withColumn("one", F.lit(1)), ("person_id",), "one").select(F.col("before").cast("decimal(38,0)").alias("person"), "person_id")
    spans = _spans(aliases.join(people, "person_id"))
    wide = spans.where("scope IS NULL").select(*_NAME, "person", F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"))
    both = spans.where("scope IS NOT NULL").join(wide, [*_NAME, "person"]).where("lo < w_hi AND w_lo < hi").select(
        *_NAME, "scope", "person", F.greatest("lo", "w_lo").alias("lo"), F.least("hi", "w_hi").alias("hi")
    )
    worth = (F.lit(_BASE).cast("decimal(38,0)") + F.col("person")).cast("decimal(38,0)")
    steps = spans.withColumn("step", worth).unionByName(both.withColumn("step", (-worth).cast("decimal(38,0)"))).select(
        *_NAME, "scope", F.inline(F.array(F.struct(F.col("lo").alias("at"), "step"), F.struct(F.col("hi").alias("at"), (-F.col("step")).alias("step"))))
    )
    nothing = F.lit(None)
    steps = steps.select(*_NAME, "scope", "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), "step", *(nothing.alias(f"m_{c}") for c in ("id", "scope", "at")))
    asked = mentions.select("mention_id", F.lower("surface").alias("k"), "scope", "at").select(
        "k", F.col("at").isNull().alias("timeless"), F.explode(F.array_distinct(F.array(nothing.cast("string"), "scope"))).alias("line"),
        F.coalesce("at", F.lit("")).alias("at"), F.lit(1).alias("kind"), F.xxhash64("mention_id").alias("tie"), F.lit(0).cast("decimal(38,0)").alias("step"),
        F.col("mention_id").alias("m_id"), F.col("scope").alias("m_scope"), F.col("at").alias("m_at")
    ).withColumnRenamed("line", "scope")
    swept = running_total(steps.unionByName(asked), (*_NAME, "scope", "at", "kind", "tie"), "step").where("kind = 1")
    lines = [F.coalesce(F.max(F.when(of, F.col("before"))), F.lit(0)) for of in (F.col("scope").isNull(), F.col("scope").isNotNull())]  # equal mentions read the same
    found = swept.groupBy("m_id", "k", "m_scope", "m_at").agg((lines[0] + lines[1]).cast("decimal(38,0)").alias("total"))
    found = found.select(
        F.col("m_id").alias("mention_id"), F.expr(f"total div CAST({_BASE} AS DECIMAL(38,0))").alias("candidates"),
        F.expr(f"total % CAST({_BASE} AS DECIMAL(38,0))").cast("decimal(38,0)").alias("person")
    )
    nobody = F.xxhash64("mention_id").cast("decimal(38,0)") - F.lit("18446744073709551616").cast("decimal(38,0)")  # below every number; not null, so such rows spread in the join
    number = F.when(F.col("candidates") == 1, F.col("person")).otherwise(nobody).cast("decimal(38,0)")
    return found.withColumn("person", number).join(people, "person", "left").select("mention_id", "person_id", "candidates")


def persons_for_ref(links: DataFrame, ref: str) -> DataFrame:
    return links.where((F.col("ref") == ref) & F.col("person_id").isNotNull() & ~F.col("stale")).select("person_id").distinct()


def refs_of_person(links: DataFrame, person_id: str) -> DataFrame:
    """(source_id, chunk_index) of a person's live references."""
    parts = F.split("ref", "#")
    return links.where((F.col("person_id") == person_id) & ~F.col("stale")).select(
        parts[0].alias("source_id"), F.get(parts, F.lit(1)).cast("int").alias("chunk_index")
    ).distinct()


def group_by_person(results: DataFrame, links: DataFrame) -> DataFrame:
    """(person, hits, best): results (ref, score) by linked person; those without one are unresolved."""
    live = links.where(F.col("person_id").isNotNull() & ~F.col("stale")).select("ref", "person_id").distinct()
    joined = results.join(live, "ref", "left")
    return joined.groupBy(F.coalesce("person_id", F.lit("unresolved")).alias("person")).agg(F.count("*").alias("hits"), F.max("score").alias("best"))


def stale_marked(links: DataFrame, source_id: str, alive: DataFrame) -> DataFrame:
    """Links of a source whose reference is gone become stale. alive: (ref)."""
    live = alive.select(F.col("ref").alias("__r")).distinct()
    out = links.join(live, links["ref"] == live["__r"], "left")
    return out.withColumn("stale", F.col("stale") | (F.col("ref").startswith(source_id + "#") & F.col("__r").isNull())).drop("__r")


def upsert_people(people: DataFrame, new: DataFrame) -> DataFrame:
    """People (id, name, ...): a new row replaces the old one of its id; a null name keeps the known one."""
    old = people.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    fresh = new.dropDuplicates(["id"]).join(
        old, F.col("id") == F.col("__id"), "left"
    ).withColumn("name", F.coalesce("name", "__name")).drop("__id", "__name")
    return people.join(new.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def rename(people: DataFrame, person_id: str, name: str) -> DataFrame:
    return people.withColumn("name", F.when(F.col("id") == person_id, F.lit(name)).otherwise(F.col("name")))


ALIAS_KEY = ("surface", "scope", "person_id", "valid_from", "valid_to")


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Adds aliases that are not there yet: nulls equal each other, so adding one again changes nothing."""
    fresh = new.dropDuplicates(list(ALIAS_KEY)).alias("n")
    same = None
    for c in ALIAS_KEY:
        on = F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
        same = on if same is None else same & on
    return aliases.unionByName(fresh.join(aliases.alias("o"), same, "left_anti"), allowMissingColumns=True)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (id, ref, person_id, method, stale): a new one replaces that of its id and is live."""
    fresh = new.dropDuplicates(["id"]).withColumn("stale", F.lit(False))
    return links.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def retract(links: DataFrame, link_id) -> DataFrame:
    return links.where(~F.col("id").eqNullSafe(F.lit(link_id)))


def backfill(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links without a person take the one that their surface name means at their time, if it is just one.

    links: (id, ref, person_id, surface, scope, at, ...); those that name a person already stay.
    """
    open_links = links.where(F.col("person_id").isNull() & F.col("surface").isNotNull())
    found = resolve_all(open_links.select(F.col("id").alias("mention_id"), "surface", "scope", "at"), aliases).where("person_id is not null")
    found = found.select(F.col("mention_id").alias("id"), F.col("person_id").alias("__p"))
    return links.join(found, "id", "left").withColumn("person_id", F.coalesce("person_id", "__p")).drop("__p")


def forget_source(links: DataFrame, aliases: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Links into a source go, and the aliases of people that no link names any more."""
    kept = links.where(~F.col("ref").startswith(source_id + "#") | F.col("ref").isNull())
    before, after = (x.where("person_id is not null").select("person_id").distinct() for x in (links, kept))
    lost = before.join(after, "person_id", "left_anti")
    return kept, aliases.join(lost, "person_id", "left_anti")


def chunks_of_person(links: DataFrame, chunks: DataFrame, person_id: str) -> DataFrame:
    """A person's chunks: live references (source id and place) joined with chunks (source_id, chunk_index, ...)."""
    return chunks.join(refs_of_person(links, person_id), ["source_id", "chunk_index"], "left_semi")
