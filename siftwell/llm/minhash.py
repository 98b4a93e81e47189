"""Near-duplicates by MinHash: many universal hash minima, banding, verification, components.

1. One pass over the texts: each text's set of shingle hashes gives minima of universal hash
   functions (a x + b modulo 2^64), folded into band hashes, and a digest of the set.  Texts
   with one digest have equal sets and form a class; from here on one row stands for a class, so
   a thousand copies cost one.
2. Classes with an equal band form a bucket.  For every class in a bucket of two or more, the
   shingles that no other such class has are counted.  They can't lie in an intersection, which bounds the
   similarity of each pair from above: classes and pairs below the threshold go.  What is left
   are copies and their edits, not texts that share a passage.
3. Each class is compared with the most central member of its bucket, the one with the largest buckets:
   pairs in proportion to the members, never all pairs.  Pairs are confirmed on the full sets.
4. Components of the confirmed links by alternating large-star and small-star.
5. No link is lost: in buckets that still hold several components, the members' shingles are told apart by
   how many members have them.  For each member those of other components that share its rare shingles (at most
   ``rare`` have such a one) are counted, and come up if they share as many as a link takes.  Pairs that share none must
   share common shingles only, whose number bounds their similarity; a member outside its bucket's largest component is
   compared with the members of other components that this bound leaves.  Step 4 then runs over all links again.

Bands are sized so that a pair at the threshold shares none with a probability below ``miss``.
Hot keys: buckets and classes are found by partial aggregation; joins on them are between
saved tables, so that adaptive execution splits a hot key.

Defined results.  Null or empty text, or one without words: no shingles, linked with nothing.  Null
id: linked with nothing, component null, kept.  Repeated ids: rows of one id are one node, so
their texts' components join; each row gets a result row (``dedup`` tells an id's texts apart).  Empty table: empty result.  Extra columns:
ignored by ``components_of``, kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Workspace, small_batches, whole_row
from .stars import star_components


_DEALT = "part long, cls array<binary>, counts array<long>, own array<long>"


def _flat(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Class names, how many shingles each has, the shingles: of rows that ``_deal`` has made."""
    table = table.combine_chunks()
    cls, counts, values = (table[c].combine_chunks().flatten() for c in ("cls", "counts", "own"))
    return cls, counts.to_numpy(), values.to_numpy()


class MinHash:
    def __init__(self, *, shingle: int = 5, percent: int = 80, rows: int = 6, miss: float = 2e-6, seed: int = 11, text: str = "text", id_col: str = "doc_id", broadcast_ids: int = 200_000, rare: int = 32) -> None:
        """Texts are linked if 100 * |intersection| >= percent * |union| of their sets of ``shingle``-word shingles."""
        self.k, self.percent, self.rows = shingle, percent, rows
        self.bands = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))
        self.text, self.id_col, self.seed, self.broadcast_ids, self.rare = text, id_col, seed, broadcast_ids, rare

    def signatures(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, cls (digest of the set, null if empty), bands."""
        small_batches(docs.sparkSession)
        k, bands, rows = self.k, self.bands, self.rows
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64)
        fold = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def signed(u: np.ndarray) -> np.ndarray:
            low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(u), 2048):
                x = a * u[None, i : i + 2048]
                x += b
                np.minimum(low, x.min(axis=1), out=low)
            return hashing.mix((low.reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64)).view(np.int64)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, cls, out = [], [], []
                for _, flat, bounds in hashing.pieces(batch.column(1)):
                    for u in hashing.shingles(*hashing.words(flat, bounds), k):
                        n.append(len(u))
                        cls.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                        out.append(signed(u) if len(u) else None)
                held = [x for x in out if x is not None]
                values = np.concatenate(held) if held else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else bands for x in out])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), lists], names=["doc_id", "n_shingles", "cls", "bands"])

        rows_ = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.col(self.text).cast("string").alias("text"))
        return rows_.mapInArrow(task, "doc_id long, n_shingles long, cls binary, bands array<long>")

    def _texts(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        """id, text, cls for the given (id, cls)."""
        wanted = ids.select(F.col("id").alias("i"), "cls").distinct()
        if wanted.limit(self.broadcast_ids + 1).count() <= self.broadcast_ids:
            wanted = F.broadcast(wanted)
        texts = docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text).cast("string").alias("text"))
        return texts.join(wanted, F.col("id") == F.col("i")).select("id", "text", "cls")

    def _own(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Row and set, for the rows of ``_texts`` whose text is of the class that is asked for."""
        for first, flat, bounds in hashing.pieces(batch.column(1)):
            for i, u in enumerate(hashing.shingles(*hashing.words(flat, bounds), self.k)):
                if hashlib.blake2b(u.tobytes(), digest_size=16).digest() == batch.column(2)[first + i].as_py():
                    yield first + i, u

    def _sets(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        """id, cls, own (the whole set) for the given (id, cls)."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, sets = [], [np.zeros(0, np.uint64)]
                for i, u in self._own(batch):
                    rows.append(i)
                    sets.append(u)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in sets]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), lists], names=["id", "cls", "own"])

        return self._texts(docs, ids).mapInArrow(task, "id long, cls binary, own array<long>").dropDuplicates(["id", "cls"])

    @staticmethod
    def _deal(owned: Iterator[tuple[bytes, np.ndarray]], parts: int) -> pa.RecordBatch:
        """The classes' shingles, dealt out by ranges of their hash: a row for each range."""
        names, sets = zip(*owned, strict=True) if (owned := list(owned)) else ((), (np.zeros(0, np.uint64),))
        values, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        part = (((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        values, doc, part = values[order].view(np.int64), doc[order], part[order]
        out: tuple[list, ...] = ([], [], [], [])
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + 1])
            own, counts = np.unique(doc[a:b], return_counts=True)
            for column, value in zip(out, (int(p), [names[i] for i in own], counts, values[a:b]), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["part", "cls", "counts", "own"])

    def _alone(self, docs: DataFrame, ids: DataFrame, total: int) -> DataFrame:
        """cls, alone: how many of its shingles no other of the given classes has.  total: of all their shingles.

        About a million shingles go to a range, 8 bytes each.
        """
        parts = max(1, total // 1_000_000)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield self._deal(((batch.column(2)[i].as_py(), u) for i, u in self._own(batch)), parts)

        def count(table: pa.Table) -> pa.Table:
            cls, counts, values = _flat(table)
            _, at, times = np.unique(values, return_inverse=True, return_counts=True)
            single = np.concatenate([[0], np.cumsum(times[at] == 1)])
            ends = np.cumsum(counts)
            return pa.table({"cls": cls, "alone": pa.array(single[ends] - single[ends - counts], pa.int64())})

        dealt = self._texts(docs, ids).mapInArrow(deal, _DEALT)
        each = dealt.groupBy("part").applyInArrow(count, "cls binary, alone long")
        return each.groupBy("cls").agg(F.sum("alone").alias("alone"))

    def _rare(self, sets: DataFrame, total: int, classes: int) -> DataFrame:
        """Of the given classes' shingles that at most ``rare`` of them have: a row (ca, null, number) for each class, a row (ca, cb, number shared) for two
        classes of different components that share as many as the first of them needs, beside its common shingles, to be linked.

        Partners are counted in lists, a row for each class and range of shingles: at most ``rare`` - 1 for a shingle, whatever a group's size.
        """
        parts, hands, most, percent = max(1, total // 250_000), max(1, classes // 4000), self.rare, self.percent
        meta = np.dtype([("cls", "V16"), ("n", ">i8"), ("comp", ">i8")])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cls, own, n, comp = (batch.column(i) for i in range(4))
                named = (cls[i].as_py() + n[i].as_py().to_bytes(8) + comp[i].as_py().to_bytes(8, signed=True) for i in range(batch.num_rows))
                yield self._deal(zip(named, (own[i].values.to_numpy().view(np.uint64) for i in range(batch.num_rows)), strict=True), parts)

        def meet(table: pa.Table) -> pa.Table:
            cls, counts, values = _flat(table)
            names, code = np.unique(np.array(cls.to_pylist(), object), return_inverse=True)
            comp = np.frombuffer(b"".join(names), meta)["comp"].astype(np.int64)
            doc = np.repeat(code, counts)
            order = np.argsort(values, kind="stable")
            values, doc = values[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(values)))
            few = np.bincount(doc[np.repeat(times <= most, times)], minlength=len(names))
            met = [np.zeros(0, np.int64)]
            for n in range(2, most + 1):
                own = np.sort(doc[first[times == n][:, None] + np.arange(n)], axis=1)
                x, y = np.triu_indices(n, 1)
                a, b = own[:, x].ravel(), own[:, y].ravel()
                met.append((a * len(names) + b)[comp[a] != comp[b]])
            pairs, shared = np.unique(np.concatenate(met), return_counts=True)
            stops = np.searchsorted(pairs, np.arange(len(names) + 1) * len(names))
            binary = pa.array(names.tolist(), pa.binary())
            offsets = pa.array(stops.astype(np.int32))
            partners = pa.ListArray.from_arrays(offsets, binary.take(pa.array(pairs % max(1, len(names)))))
            return pa.table({"a": binary, "few": pa.array(few, pa.int64()), "partners": partners, "shared": pa.ListArray.from_arrays(offsets, pa.array(shared, pa.int64()))})

        def count(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            names, code = np.unique(np.array(table["a"].to_pylist(), object), return_inverse=True)
            few = np.bincount(code, table["few"].to_numpy(), minlength=len(names)).astype(np.int64)
            lists = table["partners"].combine_chunks()
            others, other = np.unique(np.array(lists.flatten().to_pylist(), object), return_inverse=True)
            mine = np.repeat(code, lists.value_lengths().to_numpy())
            pairs, at = np.unique(mine * max(1, len(others)) + other, return_inverse=True)
            shared = np.bincount(at, table["shared"].combine_chunks().flatten().to_numpy(), minlength=len(pairs)).astype(np.int64)
            n = np.frombuffer(b"".join(names), meta)["n"].astype(np.int64)
            need = -(-n * percent // 100) - (n - few)
            a = pairs // max(1, len(others))
            held = shared >= need[a]
            cut = lambda some, at: pa.array([some[i][:16] for i in at], pa.binary())
            both = (np.arange(len(names)), a[held])
            cb = pa.concat_arrays([pa.nulls(len(names), pa.binary()), cut(others, pairs[held] % max(1, len(others)))])
            return pa.table({"ca": cut(names, np.concatenate(both)), "cb": cb, "number": pa.array(np.concatenate([few, shared[held]]), pa.int64())})

        dealt = sets.select("cls", "own", "n", "comp").mapInArrow(deal, _DEALT)
        each = dealt.groupBy("part").applyInArrow(meet, "a binary, few long, partners array<binary>, shared array<long>")
        each = each.withColumn("hand", F.pmod(F.xxhash64("a"), F.lit(hands)))
        return each.groupBy("hand").applyInArrow(count, "ca binary, cb binary, number long")

    def _possible(self, x: str, y: str, more: Column | int = 0) -> Column:
        """Whether rows with sizes n{x}, n{y} and at most k{x}, k{y} shingles to share, and ``more``, may be linked."""
        most = F.least(f"k{x}", f"k{y}") + more
        return 100 * most >= self.percent * (F.col(f"n{x}") + F.col(f"n{y}") - most)

    def _confirmed(self, work: Workspace, sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, ca, b, cb) that are linked on their full sets, as a, b."""
        pairs = work.save(pairs, f"{name}_pairs")
        left = sets.select(F.col("id").alias("a"), F.col("cls").alias("ca"), F.col("own").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("cls").alias("cb"), F.col("own").alias("sb"))
        both = pairs.join(left, ["a", "ca"]).join(right, ["b", "cb"])
        linked = both.withColumn("i", F.size(F.array_intersect("sa", "sb"))).filter(100 * F.col("i") >= self.percent * (F.size("sa") + F.size("sb") - F.col("i")))
        out = work.save(linked.select("a", "b"), f"{name}_links")
        work.drop(f"{name}_pairs")
        return out

    def components_of(self, docs: DataFrame) -> DataFrame:
        """A row per row of docs: doc_id, n_shingles, component_id, kept."""
        work = Workspace(docs.sparkSession, "minhash")
        signed = work.save(self.signatures(docs), "signatures")
        some = signed.filter("cls is not null and doc_id is not null")
        reps = work.save(some.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
        members = reps.select("rep", "cls", "n", F.posexplode("bands").alias("band", "h"))
        buckets = work.save(members.groupBy(F.col("band").alias("b"), F.col("h").alias("c")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("b", "c"), "buckets")
        shared = work.save(members.join(buckets, (F.col("band") == F.col("b")) & (F.col("h") == F.col("c"))).drop("b", "c"), "shared")

        asked = work.save(shared.select(F.col("rep").alias("id"), "cls", "n").distinct(), "asked")
        total = asked.agg(F.sum("n")).first()[0] or 0
        alone = work.save(self._alone(docs, asked, total), "alone")
        able = asked.join(alone, "cls").select(F.col("id").alias("i"), F.col("cls").alias("c"), (F.col("n") - F.col("alone")).alias("k"))
        able = work.save(able.join(asked.select("cls", "n"), F.col("c") == F.col("cls")).filter(100 * F.col("k") >= self.percent * F.col("n")).select("i", "c", "k"), "able")
        near = work.save(shared.join(able, (F.col("rep") == F.col("i")) & (F.col("cls") == F.col("c"))).drop("i", "c"), "near")
        work.drop("buckets", "shared", "alone")
        sets = work.save(self._sets(docs, able.select(F.col("i").alias("id"), F.col("c").alias("cls"))), "sets")

        sizes = work.save(near.groupBy(F.col("band").alias("sband"), F.col("h").alias("sh")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "sizes")
        near = near.join(sizes, (F.col("band") == F.col("sband")) & (F.col("h") == F.col("sh"))).drop("sband", "sh")
        near = work.save(near, "sized")
        middle = work.save(near.groupBy(F.col("rep").alias("r"), F.col("cls").alias("c")).agg(F.sum("m").alias("central")), "middle")
        near = work.save(near.join(middle, (F.col("rep") == F.col("r")) & (F.col("cls") == F.col("c"))).drop("r", "c", "m"), "ranked")
        centers = near.groupBy(F.col("band").alias("cband"), F.col("h").alias("ch")).agg(F.max(F.struct("central", (-F.col("rep")).alias("rep"), "cls", "n", "k")).alias("c"))
        centers = work.save(centers.select("cband", "ch", (-F.col("c.rep")).alias("crep"), F.col("c.cls").alias("ccls"), F.col("c.n").alias("ny"), F.col("c.k").alias("ky")), "centers")
        stars = near.withColumnsRenamed({"n": "nx", "k": "kx"}).join(centers, (F.col("band") == F.col("cband")) & (F.col("h") == F.col("ch")))
        pairs = stars.filter((F.col("cls") != F.col("ccls")) & self._possible("x", "y")).select(F.col("crep").alias("a"), F.col("ccls").alias("ca"), F.col("rep").alias("b"), F.col("cls").alias("cb")).distinct()
        links = self._confirmed(work, sets, pairs, "first")
        found = work.save(star_components(work, links, "one"), "found")
        work.drop("near", "sizes", "sized", "middle", "centers")

        label = found.select(F.col("node").alias("r"), "component")
        placed = near.join(label, F.col("rep") == F.col("r"), "left").select("rep", "cls", "n", "band", "h", F.coalesce("component", "rep").alias("comp"))
        placed = work.save(placed, "placed")
        parts = placed.groupBy("band", "h", "comp").agg(F.count(F.lit(1)).alias("m"))
        mixed = parts.groupBy("band", "h").agg(F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        mixed = work.save(mixed.select(F.col("band").alias("mband"), F.col("h").alias("mh"), F.col("most.comp").alias("main")), "mixed")
        rest = placed.join(mixed, (F.col("band") == F.col("mband")) & (F.col("h") == F.col("mh"))).drop("mband", "mh")
        rest = work.save(rest, "rest")
        asked = work.save(rest.select("rep", "cls", "n", "comp").distinct(), "mixed_classes")
        total, classes = asked.agg(F.sum("n"), F.count(F.lit(1))).first()
        own = sets.withColumnRenamed("cls", "c").join(asked, (F.col("id") == F.col("rep")) & (F.col("c") == F.col("cls")))
        rare = work.save(self._rare(own, total or 0, classes), "rare")
        common = asked.join(rare.filter("cb is null").select("ca", "number"), F.col("cls") == F.col("ca"))
        common = work.save(common.select("rep", "cls", "n", "comp", (F.col("n") - F.col("number")).alias("k")), "common")
        x, y = (common.select(F.col("rep").alias(a), F.col("cls").alias(c), F.col("n").alias(f"n{s}"), F.col("k").alias(f"k{s}")) for a, c, s in (("a", "ca", "x"), ("b", "cb", "y")))
        met = rare.filter("cb is not null").join(x, "ca").join(y, "cb").filter(self._possible("x", "y", F.col("number"))).select("a", "ca", "b", "cb")

        could = common.filter(100 * F.col("k") >= self.percent * F.col("n")).select(F.col("rep").alias("i"), F.col("cls").alias("c"), F.col("k").alias("common"))
        rest = rest.join(could, (F.col("rep") == F.col("i")) & (F.col("cls") == F.col("c"))).drop("i", "c")
        rest = rest.join(reps.select(F.col("rep").alias("i"), F.col("cls").alias("c"), "bands"), (F.col("rep") == F.col("i")) & (F.col("cls") == F.col("c"))).drop("i", "c")
        rest = work.save(rest, "could")
        x = rest.filter("comp <> main").select("band", "h", F.col("rep").alias("a"), F.col("cls").alias("ca"), F.col("n").alias("nx"), F.col("common").alias("kx"), F.col("comp").alias("px"), F.col("bands").alias("bx"))
        y = rest.select("band", "h", F.col("rep").alias("b"), F.col("cls").alias("cb"), F.col("n").alias("ny"), F.col("common").alias("ky"), F.col("comp").alias("py"), (F.col("comp") == F.col("main")).alias("main"), F.col("bands").alias("by"))
        # each two once: in the first bucket that they share
        before = F.expr("band = 0 or forall(sequence(0, band - 1), i -> bx[i] <> by[i])")
        more = x.join(y, ["band", "h"]).filter((F.col("px") != F.col("py")) & (F.col("main") | (F.col("a") < F.col("b"))) & self._possible("x", "y") & before)
        more = more.select("a", "ca", "b", "cb").unionByName(met)
        swap = lambda one, two: F.when(F.col("a") < F.col("b"), F.col(one)).otherwise(F.col(two))
        more = more.select(swap("a", "b").alias("a"), swap("ca", "cb").alias("ca"), swap("b", "a").alias("b"), swap("cb", "ca").alias("cb"))
        late = self._confirmed(work, sets, more.distinct(), "late")
        if not late.isEmpty():
            found = work.save(star_components(work, links.unionByName(late), "two"), "all")
        work.drop("ranked", "placed", "mixed", "rest", "sets", "mixed_classes", "rare", "common", "could")

        label = found.select(F.col("node").alias("r"), "component")
        classes = reps.join(label, F.col("rep") == F.col("r"), "left").select(F.col("cls").alias("c"), F.coalesce("component", "rep").alias("component"))
        classes = work.save(classes, "labels")
        out = signed.select("doc_id", "n_shingles", "cls").join(classes, F.col("cls") == F.col("c"), "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """The documents that stay, all their columns: one row for each component; rows with a null id stay.

        If ids are repeated, each different text of an id is a node of its own, so that none goes but for its own likes.
        """
        if docs.filter(F.col(self.id_col).isNotNull()).groupBy(self.id_col).count().filter("count > 1").isEmpty():
            node = F.col(self.id_col).cast("long")
        else:
            node = F.when(F.col(self.id_col).isNotNull(), F.xxhash64(self.id_col, F.col(self.text).cast("string")))
        rows = docs.select(node.alias("node"), F.col(self.text).alias("text"), whole_row(docs).alias("row"))
        own = MinHash(shingle=self.k, percent=self.percent, rows=self.rows, seed=self.seed, text="text", id_col="node", broadcast_ids=self.broadcast_ids, rare=self.rare)
        kept = own.components_of(rows).filter("kept").select(F.col("doc_id").alias("one")).distinct()
        some = rows.filter("node is not null").join(kept, F.col("node") == F.col("one"), "left_semi").dropDuplicates(["node"])
        return some.unionByName(rows.filter("node is null")).select("row.*")
