"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations make all signature coordinates: the first scatters a shingle's hash over a
circle of 2**32 places, the second ranks the places; coordinate ``k`` uses the second one shifted
by ``k`` along the circle. Bands of coordinates propose pairs, and each pair is confirmed on its
full sets.

Documents with the same set are one class and are compared once. Within a bucket every member is
first compared with one pivot. Members that are then in one component need no further comparison;
in buckets that still hold several, the others are compared with the most linked member of the
largest, again and again while that finds links.

What is still apart in some bucket is joined exactly, by prefixes. With shingles in one order, rare
ones first, two sets of ``n`` and ``m`` shingles that share ``k`` or more share one of the first
``n - k + 1`` of the one and ``m - k + 1`` of the other. Shingles that stand in no other open set take
the first places and match nothing, so copies that each have edits of their own meet hardly any
other, however many there are; size and place of the first common shingle rule out more. So a
group of thousands of near copies costs about as many comparisons as it has members, and no
similar pair of open classes is left out, whether a band proposed it or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentika.llm.common import ASCII_LOWER, blocks_of, mix64, written
from sentika.llm.components import connected_components

SHINGLE = 5
#: 40 bands of 5 coordinates: a pair at the threshold of 0.75 is proposed with probability
#: 1 - (1 - 0.75**5)**40 = 0.99998, one at 0.8 with 0.9999999.
BANDS, ROWS = 40, 5
#: Similarity in percent from which documents are linked.
PERCENT = 75
#: One bit of each of the 200 coordinates: pairs at the threshold agree in 175 on average, with a
#: deviation of 4.7; pairs below 150 are ruled out before their texts are fetched.
LEAST_BITS = 150
SKETCH = "id long, text_key long, n long, set_hash binary, bits array<long>, bands array<long>"


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of the distinct five-word shingles, ascending; of the whole sequence if it is shorter."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + each[k : len(each) - width + 1 + k])
    return np.unique(total)


def _ranked(places: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit places."""
    np.right_shift(places, np.uint32(16), out=out)
    out ^= places
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return out


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row of ``size`` coordinates each."""
    out = np.empty((len(sets), size), np.uint32)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (held == 0 or held + len(sets[last]) <= 1 << 15):
            held += len(sets[last])
            last += 1
        starts = np.cumsum([0, *[len(s) for s in sets[first : last - 1]]])
        # the first permutation: a mixed hash, cut to its place on the circle
        places = (mix64(np.concatenate(sets[first:last])) >> np.uint64(32)).astype(np.uint32)
        shifted, rank = np.empty_like(places), np.empty_like(places)
        for k in range(size):
            np.subtract(places, np.uint32(k), out=shifted)
            out[first:last, k] = np.minimum.reduceat(_ranked(shifted, rank), starts)
        first = last
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def sketch_bits(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, packed into 64-bit words."""
    bits = (signature & np.uint32(1)).astype(np.uint8)
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks_of(batches, "text", 4 << 20):
        sets = [shingle_hashes(t) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        signature = signatures([sets[i] for i in full])
        bits: list = [None] * len(sets)
        bands: list = [None] * len(sets)
        for i, b, k in zip(full, sketch_bits(signature), band_keys(signature), strict=True):
            bits[i], bands[i] = b, k
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.record_batch(
            {
                "id": batch.column(0),
                "text_key": batch.column(1),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "set_hash": pa.array(digests, pa.binary()),
                "bits": pa.array(bits, pa.list_(pa.int64())),
                "bands": pa.array(bands, pa.list_(pa.int64())),
            }
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[int, np.ndarray]] = {}

    def shingles(side: str, node: int, text: bytes | None) -> np.ndarray:
        if held.get(side, (None, None))[0] != node:
            held[side] = node, shingle_hashes(text or b"")
        return held[side][1]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [batch.column(k).cast(pa.binary()) for k in (2, 3)]
        keep = []
        for i in range(len(a)):
            x, y = shingles("a", a[i], texts[0][i].as_py()), shingles("b", b[i], texts[1][i].as_py())
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks_of(batches, "text", 1 << 20):
        sets = [shingle_hashes(t) for t in texts]
        sizes = np.array([len(x) for x in sets])
        yield pa.record_batch(
            {
                "c": batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes))),
                "shingle": pa.array(np.concatenate(sets).view(np.int64)),
            }
        )


class NearDuplicates:
    """The steps of one run; every table between them is written to shared storage."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.texts = docs.select(
            F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
        )
        self.rows = written(self.texts.mapInArrow(_sketches, SKETCH), "sketches")
        first = self.rows.where("n > 0").groupBy("set_hash").agg(
            F.min(F.struct("id", "text_key")).alias("holder"), F.min("id").alias("first_id"),
            F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"),
        )
        self.classes = written(first.withColumn("c", F.monotonically_increasing_id()), "classes")

    def buckets(self) -> DataFrame:
        """``key, pivot, c`` of all members of buckets that hold two classes or more."""
        banded = self.classes.select("c", F.explode("bands").alias("key"))
        shared = banded.groupBy("key").agg(F.min("c").alias("pivot"), F.max("c").alias("last")).where("pivot < last")
        # written, so that the join has plain shuffles on both sides and a hot bucket can be split
        shared = written(shared.select("key", "pivot"), "shared-buckets")
        return written(banded.join(shared, "key"), "buckets")

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """``c, text`` of the wanted classes, by one of their rows."""
        holders = self.classes.select("c", "holder.id", "holder.text_key").join(wanted, "c")
        same = F.expr("t.id <=> h.id AND t.text_key = h.text_key")
        # rows that repeat a holder's id and text are one text
        return self.texts.alias("t").join(holders.alias("h"), same).select("c", "text").dropDuplicates(["c"])

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs of classes ``a < b`` (distinct, written) whose full sets are similar enough."""
        wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
        texts = written(self.texts_of(wanted), "pair-texts")
        side = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
        return written(both.mapInArrow(_verified, "a long, b long"), "confirmed")

    def labels(self, links: DataFrame) -> DataFrame:
        """``c, label`` of every class."""
        found = connected_components(links)
        labels = self.classes.select("c").join(found, F.col("c") == F.col("node"), "left").select(
            "c", F.coalesce("component", "c").alias("label")
        )
        return written(labels, "labels")

    def open_members(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """``key, c, label, n, bits, main`` of buckets with several components; ``main`` is the largest."""
        known = self.classes.select("c", "n", "bits").join(labels, "c")
        labelled = buckets.select("key", "c").join(labels, "c")
        sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
        several = sizes.groupBy("key").agg(
            F.max(F.struct("size", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("components")
        )
        several = written(several.where("components > 1").select("key", "main"), "open-buckets")
        return written(buckets.select("key", "c").join(several, "key").join(known, "c"), "open-members")

    def hubs(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """Of each bucket's largest component the member with the most links."""
        ends = links.select(F.col("a").alias("c")).unionAll(links.select(F.col("b").alias("c")))
        degree = ends.groupBy("c").agg(F.count(F.lit(1)).alias("degree"))
        mains = members.where("label = main").join(degree, "c", "left")
        best = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "c", "n", "bits", "label"))
        return mains.groupBy("key").agg(best.alias("h")).select("key", "h.c", "h.n", "h.bits", "h.label")

    def hub_pairs(self, members: DataFrame, hubs: DataFrame, tested: DataFrame) -> DataFrame:
        """Untested pairs of a bucket's stray ``s`` and its hub ``m``, but for what size and bits rule out."""
        pair = members.where("label <> main").alias("s").join(hubs.alias("m"), "key")
        words = range(-(-BANDS * ROWS // 64))
        differ = sum((F.bit_count(F.col("s.bits")[k].bitwiseXOR(F.col("m.bits")[k])) for k in words), F.lit(0))
        wanted = (
            (F.col("s.label") != F.col("m.label"))
            & (100 * F.least("s.n", "m.n") >= PERCENT * F.greatest("s.n", "m.n"))
            & (differ <= BANDS * ROWS - LEAST_BITS)
        )
        found = pair.where(wanted).select(F.least("s.c", "m.c").alias("a"), F.greatest("s.c", "m.c").alias("b"))
        return written(found.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")

    def prefixes(self, members: DataFrame) -> DataFrame:
        """``shingle, c, n, label, place`` of the open classes' first shingles, rare ones first.

        Places follow how many open classes hold a shingle; those that one class alone holds come
        first and are counted, not listed. A class with more than a quarter of them is like no other.
        """
        open_ = members.groupBy("c").agg(F.first("n").alias("n"), F.first("label").alias("label"))
        open_ = written(open_, "open-classes")
        rows = written(self.texts_of(open_.select("c")).mapInArrow(_shingles, "c long, shingle long"), "open-shingles")
        held = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "common-shingles")
        common = rows.join(held, "shingle")
        place = F.row_number().over(Window.partitionBy("c").orderBy("held", "shingle"))
        listed = common.withColumn("place", place).withColumn("listed", F.count(F.lit(1)).over(Window.partitionBy("c")))
        placed = listed.join(open_, "c").withColumn("place", F.col("place") + F.col("n") - F.col("listed"))
        return written(placed.where(100 * (F.col("n") - F.col("place") + 1) >= PERCENT * F.col("n")).drop("held", "listed"), "prefixes")

    def prefix_pairs(self, members: DataFrame, tested: DataFrame) -> DataFrame:
        """Untested pairs of open classes of different components that their prefixes allow to be similar.

        ``s`` is the smaller set (of equals the one with the smaller number). Its shared shingles are
        ``PERCENT / (100 + PERCENT)`` of both sizes at least, which shortens its prefix further.
        """
        prefixes = self.prefixes(members)
        both = 100 + PERCENT
        short = prefixes.where(both * (F.col("n") - F.col("place") + 1) >= 2 * PERCENT * F.col("n"))
        rest = F.least(F.col("s.n") - F.col("s.place"), F.col("m.n") - F.col("m.place")) + 1
        wanted = (
            (F.col("s.label") != F.col("m.label"))
            & ((F.col("s.n") < F.col("m.n")) | ((F.col("s.n") == F.col("m.n")) & (F.col("s.c") < F.col("m.c"))))
            & (100 * F.col("s.n") >= PERCENT * F.col("m.n"))
            & (both * rest >= PERCENT * (F.col("s.n") + F.col("m.n")))
        )
        pair = written(short, "short-prefixes").alias("s").join(prefixes.alias("m"), "shingle").where(wanted)
        found = pair.select(F.least("s.c", "m.c").alias("a"), F.greatest("s.c", "m.c").alias("b"))
        return written(found.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")

    def grouped(self) -> DataFrame:
        """``set_hash, label, component_id`` of every class."""
        buckets = self.buckets()
        stars = buckets.where("c <> pivot").select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct()
        tested = written(stars, "pairs")
        links = self.confirm(tested)
        # strays meet the hub of their bucket's largest component as long as that links any: near
        # copies of one text that are not near each other come together by that text
        while True:
            labels = self.labels(links)
            members = self.open_members(buckets, labels)
            more = self.hub_pairs(members, self.hubs(members, links), tested)
            found = self.confirm(more)
            tested, links, buckets = tested.unionByName(more), links.unionByName(found), members
            if not found.limit(1).count():
                break
        # then everything that is still apart, each pair once
        last = self.confirm(self.prefix_pairs(members, tested))
        if last.limit(1).count():
            labels = self.labels(links.unionByName(last))
        named = self.classes.select("c", "set_hash", "first_id").join(labels, "c")
        lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        return named.join(lowest, "label").select("set_hash", "label", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    The component is named by its smallest id. Null and blank texts have no set, are linked with
    nothing and are kept under their own id. A row without an id takes its group's name and is
    kept only where no row of the group has an id. Rows that repeat an id count as rows of their
    own, and rows with the component's id are all kept. Other columns are not read.
    """
    run = NearDuplicates(docs, id_col, text_col)
    named = run.rows.join(run.grouped(), "set_hash", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one whose id names the group.

    Of rows that repeat that id, and of groups without any id, one row stays. Documents without a
    set stay.
    """
    run = NearDuplicates(docs, id_col, text_col)
    named = run.rows.where("n > 0").join(run.grouped(), "set_hash")
    named = named.where(F.col("id").eqNullSafe(F.col("component_id")))
    row = F.struct("id", "text_key")
    chosen = named.groupBy("label").agg(F.min(row).alias("k"))
    copies = named.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    same = F.expr("n.id <=> k.k.id AND n.text_key = k.k.text_key")
    chosen = written(copies.alias("n").join(chosen.alias("k"), same).select("n.id", "n.text_key", "copies"), "kept-rows")
    # rows are carried whole, so that names of their columns do not matter
    blank = F.coalesce(F.length(F.translate(text_col, " \t\n\x0b\f\r", "")), F.lit(0)) == 0
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), blank.alias("blank")
    )
    same = F.expr("d.id <=> k.id AND d.text_key = k.text_key")
    found = keyed.where("NOT blank").alias("d").join(chosen.alias("k"), same).select("d.*", "k.copies")
    # rows equal in id and text all match: one of them is taken
    once = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["id", "text_key"]))
    return once.select("row.*").unionByName(keyed.where("blank").select("row.*"))
