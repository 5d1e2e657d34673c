"""Embedding near-dedup: inverted lists, product codes of residuals, table-lookup distances, exact cosine.

How many lists there are follows from the sample: more of them prune more pairs, but each vector then looks into more of them. Lists of any
length are split into blocks, and so are those who look into them, so a task holds two blocks at most for each unit of its work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.llm.common import connected_components, written
from sparkloft.llm.simhash import _merge
from sparkloft.llm.vectors import k_means, matrix, squared, usable

COSINE = 0.98
SAMPLE = 20_000  # vectors that the lists and codes are fitted on at most
A_LIST = 16  # and so many of them at least for each list
BOOK_SAMPLE = 5000  # of those the codes are fitted on
SUBSPACES = 8
CODES = 64
BLOCK = 4096  # vectors of a list, or of those who look into it, that a unit of work holds
TABLE_SLACK = 1e-4  # for rounding of distances summed up in single precision
COPY_COST, PAIR_COST = 10.0, 0.04  # microseconds that a copy of a vector and a looked-up pair take, about
SLACK = 1e-6  # for rounding of distances between unit vectors
BROADCAST_ROWS = 200_000  # list sizes (20 bytes each) that are broadcast at most


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, unit: np.ndarray, centres: np.ndarray) -> Index:
        """Codes for what is left of the sample's vectors beside the centre of their list."""
        part = unit[:BOOK_SAMPLE]
        rest = part - centres[squared(part, centres).argmin(1)]
        cuts = [round(i * unit.shape[1] / SUBSPACES) for i in range(SUBSPACES + 1)]
        cuts = sorted(set(cuts))
        books = [k_means(rest[:, a:b], CODES, 8) for a, b in zip(cuts, cuts[1:], strict=False)]
        return cls(centres, books, cuts)

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each residual is from what its codes stand for."""
        codes = np.stack([squared(rest[:, a:b], book).argmin(1) for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False)], 1)
        shown = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest - shown) ** 2).sum(1))

    def tables(self, rest: np.ndarray) -> np.ndarray:
        return np.stack(
            [
                np.pad(squared(rest[:, a:b], book), ((0, 0), (0, CODES - len(book)))) for book, a,
                b in zip(self.books, self.cuts, self.cuts[1:], strict=False)
            ],
            1
        )

    def lists(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's list, and the lower-numbered lists that can hold a vector within ``radius``.

        A vector in list c is nearer to c than to a, so it lies beyond the plane half-way between the two. A vector of list a
        must look into c only if that plane is within the radius; of two lists the higher-numbered one's vectors look.
        """
        d = squared(unit, self.centres)
        home = d.argmin(1)
        apart = np.sqrt(squared(self.centres, self.centres))
        gap = d - d[np.arange(len(d)), home][:, None]
        near = gap <= 2 * (radius + SLACK) * apart[home] + SLACK
        near &= np.arange(len(self.centres))[None] < home[:, None]
        return home, [np.flatnonzero(x) for x in near]


def fit_index(unit: np.ndarray, rows: float) -> Index:
    """The index whose lists cost least, by what the sample shows; ``rows`` is how many vectors share a label on average over vectors.

    A vector is compared with half of its own list and with the lists that it looks into, and is copied to each of those.
    """
    lists = fewest = min(4, max(1, len(unit) // A_LIST))
    best, least = None, math.inf
    while lists == fewest or lists <= min(len(unit) // A_LIST, rows / 4):
        centres = k_means(unit, lists)
        home, probes = Index(centres, [], []).lists(unit[:BOOK_SAMPLE], math.sqrt(2 - 2 * COSINE))
        share = np.bincount(home, minlength=len(centres)) / len(home)
        looked = np.mean([len(p) for p in probes])
        compared = share[home].mean() / 2 + np.mean([share[p].sum() for p in probes])
        cost = (1 + looked) * COPY_COST + compared * rows * PAIR_COST
        if cost >= least:  # more lists would only be dearer
            break
        best, least, lists = centres, cost, lists * 4
    return Index.fit(unit, best)


def _search(
    index: Index, home: tuple, ask: tuple | None, links: np.ndarray, label: np.ndarray, at_home: np.ndarray, at_ask: np.ndarray, weight: np.ndarray, radius: float
) -> None:
    """Links between the vectors of a block (or of a block and those that look into it), added to ``links`` and ``label``.

    Distances are summed up from the tables in single precision, for some columns at a time, so that they stay in a core's cache.
    """
    vec, unit, codes, err, centre = home
    vec2, unit2 = (vec, unit) if ask is None else ask
    norm, norm2 = np.sqrt((vec * vec).sum(1)), np.sqrt((vec2 * vec2).sum(1))
    codes, reach = codes.astype(np.intp), ((radius + err + TABLE_SLACK) ** 2).astype(np.float32)
    for k in range(0, len(unit2), 256):
        table = index.tables(unit2[k : k + 256] - centre).astype(np.float32)
        for c in range(0 if ask is not None else k, len(codes), 2048):
            part = codes[c : c + 2048]
            guess = np.take(table[:, 0], part[:, 0], axis=1)
            for m in range(1, table.shape[1]):
                guess += np.take(table[:, m], part[:, m], axis=1)
            i, j = np.nonzero(guess <= reach[c : c + 2048])  # by the triangle inequality nothing nearer is lost
            i, j = i + k, j + c
            if ask is None:
                later = j > i
                i, j = i[later], j[later]
            for p in range(0, len(i), 1 << 16):
                a, b = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
                ok = (vec2[a] * vec[b]).sum(1) / (norm2[a] * norm[b]) >= COSINE
                a, b = at_ask[a[ok]], at_home[b[ok]]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                _merge(label, a, b)


def embedding_links(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id long, embedding array<float>, label, ...).

    Vectors are compared within a label. n_links: other rows with a cosine of COSINE or more; component_id: the smallest vec_id
    reachable by links; kept: whether that is the row's own. Rows with a null label or an unusable vector (null, zero, with null or
    non-finite components) link with nothing, nor do vectors of different lengths. Equal vectors of a label are compared once and
    counted each. Rows that repeat a vec_id count as vectors of their own; a null vec_id gets a null component_id unless it links to
    a numbered one. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding").withColumn("ok", usable("embedding") & F.col("label").isNotNull())
    classes = written(
        rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .where("rep is not null").withColumn("cls", F.monotonically_increasing_id()),
        "vectors"
    )
    n = classes.count()
    radius = math.sqrt(2 - 2 * COSINE)
    if n:
        sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow().column(0)
        by_dim: dict[int, list] = {}
        for v in sample.to_pylist():
            by_dim.setdefault(len(v), []).append(v)
        labels = classes.groupBy("label").agg(F.count("*").cast("double").alias("n"))
        together = labels.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        indexes = {}
        for d, v in by_dim.items():
            x = np.array(v, float)
            indexes[d] = fit_index(x / np.sqrt((x * x).sum(1))[:, None], together)
        sent = spark.sparkContext.broadcast(indexes)

        def place(batches):
            for b in batches:
                lens = np.array([len(v) for v in b.column("embedding")], np.int64)
                for d in np.unique(lens):
                    part = b.take(pa.array(np.flatnonzero(lens == d)))
                    x = matrix(part.column("embedding"))
                    index = sent.value.get(int(d)) or Index(np.zeros((1, int(d))), [np.zeros((1, int(d)))], [0, int(d)])
                    unit = x / np.sqrt((x * x).sum(1))[:, None]
                    home, probes = index.lists(unit, radius)
                    n_probes = np.array([len(p) for p in probes])
                    take = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), n_probes)])
                    cell = np.concatenate([home, *probes]).astype(np.int64)
                    at = pa.array(take)
                    guest = np.arange(len(take)) >= len(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("label").take(at), pa.array(np.full(len(take), d, np.int32)), pa.array(cell.astype(np.int32)),
                            pa.array(guest), part.column("cls").take(at), part.column("copies").take(at), part.column("embedding").take(at)
                        ],
                        names=["label", "dim", "cell", "guest", "cls", "copies", "embedding"]
                    )

        kind = classes.schema["label"].dataType.simpleString()
        vector = classes.schema["embedding"].dataType.simpleString()
        placed = written(
            classes.mapInArrow(place, f"label {kind}, dim int, cell int, guest boolean, cls long, copies long, embedding {vector}"), "vector-lists"
        )
        key = ["label", "dim", "cell"]
        counts = placed.groupBy(*key).agg(F.count_if(~F.col("guest")).alias("h"), F.count_if("guest").alias("g")).where("h > 0")
        blocks = {b: F.ceil(F.col(c) / BLOCK).cast("int") for b, c in (("homes", "h"), ("guests", "g"))}
        sizes = written(counts.withColumns(blocks), "vector-list-sizes")
        cells, copies = sizes.agg(F.count("*"), F.sum(F.col("h") * (F.col("homes") + F.col("guests")) + F.col("g") * F.col("homes"))).first()
        sizes = sizes.select(*key, "homes", "guests")
        if cells <= BROADCAST_ROWS:
            sizes = F.broadcast(sizes)
        own = F.pmod(F.xxhash64("cls"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
        dealt = placed.join(sizes, key).withColumn("own", own)

        def units(first, last, unit):
            """A unit of work for each number from first to last, none if there is none."""
            return F.when(last >= first, F.transform(F.sequence(first, last), unit)).otherwise(
                F.array().cast("array<struct<a:int,b:int,cross:boolean,asks:boolean>>")
            )

        def unit(a, b, cross: bool, asks: bool):
            return F.struct(a.alias("a"), b.alias("b"), F.lit(cross).alias("cross"), F.lit(asks).alias("asks"))

        zero, mine = F.lit(0), F.col("own")
        # blocks of a list meet each other once, the later one asking; each block of guests asks each block of the list
        at_home = F.concat(
            units(mine, F.col("homes") - 1, lambda j: unit(mine, j, False, False)),
            units(zero, mine - 1, lambda i: unit(i, mine, False, True)),
            units(zero, F.col("guests") - 1, lambda k: unit(mine, k, True, False)),
        )
        visiting = units(zero, F.col("homes") - 1, lambda i: unit(i, mine, True, True))
        dealt = dealt.withColumn("unit", F.explode(F.when(F.col("guest"), visiting).otherwise(at_home)))
        dealt = dealt.select(*key, "unit.a", "unit.b", "unit.cross", "unit.asks", "cls", "copies", "embedding")
        tasks = copies // (2 * BLOCK) + 8
        dealt = dealt.withColumn("task", F.pmod(F.xxhash64(*key, "a", "b", "cross"), F.lit(tasks).cast("long")))

        def search(table: pa.Table) -> pa.Table:
            table = table.sort_by("cls")
            label_of = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            numbers = [table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "cell", "a", "b", "cross")]
            keys = np.stack([label_of, *numbers], 1)
            reps, at = np.unique(table.column("cls").to_numpy(), return_inverse=True)
            weight, links, label = np.zeros(len(reps), np.int64), np.zeros(len(reps), np.int64), np.arange(len(reps))
            weight[at] = table.column("copies").to_numpy()
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            groups, of = np.unique(keys, axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            for g, where in enumerate(np.split(order, np.cumsum(np.bincount(of.ravel(), minlength=len(groups)))[:-1])):
                _, d, cell, a, b, cross = groups[g].tolist()
                h = ~asks[where]
                if not h.any() or not (a == b and not cross) and h.all():
                    continue
                index = sent.value.get(d) or Index(np.zeros((1, d)), [np.zeros((1, d))], [0, d])
                x = matrix(table.column("embedding").take(pa.array(where)))
                unit_ = x / np.sqrt((x * x).sum(1))[:, None]
                centre = index.centres[cell]
                codes, err = index.code(unit_[h] - centre)
                home = (x[h], unit_[h], codes, err, centre)
                if a == b and not cross:
                    _search(index, home, None, links, label, at[where[h]], at[where[h]], weight, radius)
                else:
                    _search(index, home, (x[~h], unit_[~h]), links, label, at[where[h]], at[where[~h]], weight, radius)
            hit = links > 0
            return pa.table({"cls": pa.array(reps[hit]), "links": pa.array(links[hit]), "root": pa.array(reps[label[hit]])})

        found = written(dealt.groupBy("task").applyInArrow(search, "cls long, links long, root long"), "vector-links")
        parts = connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst")))
        counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
        parts = parts.withColumnRenamed("id", "cls")
        least = classes.join(parts, "cls").groupBy("component").agg(F.min("rep").alias("least"))
        result = classes.join(counted, "cls", "left").join(parts, "cls", "left").join(least, "component", "left")
        result = result.select(
            F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("least", "rep").alias("component_id")
        )
        rows = rows.withColumn("k_label", F.when(F.col("ok"), F.col("label"))).withColumn("k_embedding", F.when(F.col("ok"), F.col("embedding")))
        rows = rows.join(result, (F.col("k_label") == F.col("c_label")) & (F.col("k_embedding") == F.col("c_embedding")), "left")
    else:
        rows = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
