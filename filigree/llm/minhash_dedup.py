"""MinHash near-dedup: bands find candidates, odd sketches screen them, full shingle sets confirm them.

1. Each text becomes its set of distinct word shingles (64-bit hashes), BANDS x ROWS MinHash samples of it, one key for each
   band of samples, and an odd sketch: a bitmap in which every (sample number, sample) flips one bit. Of two sketches the
   XOR's population count estimates how many samples differ: with d bits of m, n = ln(1 - 2 d / m) / ln(1 - 2 / m) flips,
   so a similarity 1 - n / (2 samples), precisely where it is high.
2. Texts of one set (same size, same two fingerprints) are one class; its smallest doc_id stands for it from here on.
3. In each band's bucket every member is paired with one pivot, drawn by hash for that bucket, so a bucket of n gives n - 1
   pairs and never all of them. A document has another pivot in each of its buckets. Then the same around the member with
   most confirmed links, for members of other components.
4. Pairs whose sizes allow the threshold and whose sketches do not speak against it by five standard deviations are
   confirmed on full sets; confirmed ones make components.
5. What a pivot could hide is then made good exactly: of each bucket that still holds several components, the members
   outside its largest one are paired with every member of another component, screened and confirmed alike. Links inside
   a component cannot change it, so no link that matters is lost. What keeps these pairs few are exact bounds
   over the shingles of such documents. Let a shingle be rare if at most RARE documents have it, of those that bucket pivots
   connect with this one. Partners share a shingle that comes early, in the order of (documents, hash), in both sets: within
   the first n - 0.8 n + 1. If the first one that they share is rare, a join on rare early shingles meets them, with at
   most RARE partners for a shingle; if not, no more than their shingles that are not rare are common: only documents with four
   fifths of such shingles are paired in a bucket, with those of near sizes, and of these pairs only those that can reach the
   threshold are looked at.

A pair at the threshold misses all bands with probability (1 - 0.8^6)^32 < 0.0001, at 0.9 < 1e-10.

Hot groups: exact copies of any number are one row after step 2 (a map-side combined aggregate); n near copies give at
most 32 n pairs, most of which the distinct removes.

Defined cases: a null text, or one without words, has the empty set and is linked with nothing; a text with fewer words
than a shingle has its whole sequence as one; rows that repeat a doc_id come back once each, as one document (if their
texts differ, the one with the least hash speaks for it in steps 4 and 5); rows with a null doc_id come back unlinked, with component null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, table
from .words import U, Words, grams, mix, powers, signed, slices, stream

BANDS, ROWS = 32, 6
SKETCH_BYTES = 64
PERCENT = 80
RARE = 64


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within the text, and the bounds of each text's in them."""
    h, at = grams(words.hash, words.first, n)
    owner = words.owners()[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence as one shingle
        whole = [mix(np.array([len(x)], U) + np.sum(x * powers(0xA24BAED4963EE407, len(x)), dtype=U))[0] for x in (words.hash[words.first[i] : words.first[i + 1]] for i in short)]
        h, owner = np.concatenate([h, np.array(whole, U)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(words.first)))


def _signatures(n: int):
    samples = BANDS * ROWS
    flip, scale = stream(samples, 5).astype(np.uint32), (stream(samples, 6).astype(np.uint32) | np.uint32(1))
    salt, bits = stream(samples, 7), U(SKETCH_BYTES * 8)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column("text")):
                words = Words(buf, bounds, lower=True)
                h, edge = shingle_sets(words, n)
                size = np.diff(edge)
                full = np.flatnonzero(size)
                low = (h >> U(32)).astype(np.uint32)
                least = np.zeros((samples, len(full)), np.uint32)
                work = np.empty_like(low)
                for k in range(samples if len(full) else 0):
                    np.bitwise_xor(low, flip[k], out=work)
                    np.multiply(work, scale[k], out=work)
                    least[k] = np.minimum.reduceat(work, edge[:-1][full])
                each = mix(least.astype(U) ^ salt[:, None])
                sketch = np.zeros((len(full), SKETCH_BYTES * 8), np.uint8)
                rows = np.arange(len(full))
                for k in range(samples):
                    sketch[rows, (each[k] % bits).astype(np.int64)] ^= 1
                packed = np.packbits(sketch, axis=1)
                band = mix(np.sum(each.reshape(BANDS, ROWS, -1) * stream(ROWS, 8)[None, :, None], axis=1, dtype=U) ^ stream(BANDS, 9)[:, None])
                fold = lambda x: np.add.reduceat(x, edge[:-1][full]) if len(full) else x[:0]
                prints = np.zeros((2, len(size)), U)
                prints[0, full], prints[1, full] = fold(mix(h)), fold(mix(h ^ U(0x5851F42D4C957F2D)))
                has = np.zeros(len(size), bool)
                has[full] = True
                lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(has, width, 0))].astype(np.int32)), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(size.astype(np.int64)), signed(prints[0]), signed(prints[1]), lists(band.T, BANDS), lists(packed, SKETCH_BYTES // 8)],
                    ["doc_id", "n_shingles", "p", "q", "bands", "sketch"],
                )

    return of


def _sets(n: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column("text")):
                h, edge = shingle_sets(Words(buf, bounds, lower=True), n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((edge * 8).astype(np.int32)), pa.py_buffer(h)])], ["id", "members"]
                )

    return of


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of stored sets."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            sets = [np.frombuffer(x.as_buffer(), U) for x in part.column("members")]
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([part.column("coarse").take(rows), part.column("id").take(rows), signed(np.concatenate(sets))], ["coarse", "id", "h"])


def _confirm(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, x = [], None, None
            for k, (a, b) in enumerate(zip(batch.column("x"), batch.column("y"))):
                if last is None or a.as_buffer() != last:
                    last = a.as_buffer()
                    x = np.frombuffer(last, U)
                y = np.frombuffer(b.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    good.append(k)
            rows = pa.array(good, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])

    return of


def most_differing_bits(percent: int) -> int:
    """The odd sketches of a pair at the threshold differ in more bits than this less often than once in a million: five
    standard deviations, of the samples and of the bits they flip."""
    samples, m, s = BANDS * ROWS, SKETCH_BYTES * 8, percent / 100
    flips = 2 * samples * (1 - s)
    unflipped = (1 - 2 / m) ** flips
    by_samples = 2 * unflipped * (samples * s * (1 - s)) ** 0.5
    by_bits = (m / 4 * (1 - unflipped**2)) ** 0.5
    return int(min(m, m / 2 * (1 - unflipped) + 5 * (by_samples**2 + by_bits**2) ** 0.5))


def _possible(percent: int) -> str:
    """Of (n, s) and (m, t), sizes and sketches of two sets: whether their similarity may reach the threshold."""
    bits = " + ".join(f"bit_count(s[{i}] ^ t[{i}])" for i in range(SKETCH_BYTES // 8))
    return f"100 * least(n, m) >= {percent} * greatest(n, m) and {bits} <= {most_differing_bits(percent)}"


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signature = materialise(docs.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, p long, q long, bands array<long>, sketch array<long>"), "signatures")
    known = signature.where("n_shingles > 0 and doc_id is not null")
    alike = ["n_shingles", "p", "q"]
    classes = materialise(known.groupBy(*alike).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    in_band = classes.select("id", F.explode("bands").alias("key"))
    drawn = F.min(F.struct(F.xxhash64("id", "key").alias("o"), "id"))
    buckets = materialise(in_band.groupBy("key").agg(drawn.alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", F.col("pivot.id").alias("pivot")), "buckets")
    fellow = materialise(in_band.join(buckets, "key"), "fellows")
    ids = fellow.select(F.col("id").alias("doc_id")).distinct()
    one_text = docs.join(ids, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sets = materialise(one_text.mapInArrow(_sets(shingle), "id long, members binary"), "sets")
    left = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    right = left.toDF("b", "m", "t")

    def star(members: DataFrame) -> DataFrame:
        """Of members (id, pivot) the pairs that may be links."""
        pairs = members.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        return pairs.join(left, "a").join(right, "b").where(_possible(percent)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
        return materialise(pairs.join(x, "a").join(y, "b").mapInArrow(_confirm(percent), "a long, b long"), "links")

    def split(component: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members of buckets with their components, and the largest component of each bucket that has several."""
        named = fellow.select("key", "id").join(component, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        each = named.groupBy("key", "component").agg(F.count("*").alias("c"))
        mixed = each.groupBy("key").agg(F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("k")).where("k > 1")
        return named, mixed.select("key", F.col("main.component").alias("main"))

    tested = materialise(star(fellow), "tested")
    links = confirmed(tested)
    component = components(links)
    # once more around the member that has most links, so that what is near the middle of a group is linked with it
    named, mixed = split(component)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    around = materialise(named.join(mixed, "key").join(degree, "id", "left").withColumn("links", F.coalesce("links", F.lit(0))), "mixed")
    hub = around.groupBy("key").agg(F.max(F.struct("links", "id")).alias("h")).select("key", F.col("h.id").alias("pivot"))
    of_hub = around.select("key", "id", "component").join(hub, "key").join(component.toDF("pivot", "other"), "pivot", "left").where("component <> coalesce(other, pivot)")
    again = materialise(star(of_hub.select("id", "pivot")).join(tested, ["a", "b"], "left_anti"), "tested")
    if not again.isEmpty():
        links, tested = links.union(confirmed(again)), tested.union(again)
        component = components(links)
    named, mixed = split(component)
    full = materialise(named.join(mixed, "key").join(left.withColumnRenamed("a", "id"), "id"), "mixed")
    if not full.isEmpty():
        one = full.groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "s", "component")), F.max(F.expr("component <> main")).alias("stray"))
        every = fellow.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        coarse = components(every).select("id", F.col("component").alias("coarse"))
        each = materialise(sets.join(one.join(coarse, "id").select("id", "coarse"), "id").select("coarse", "id", "members").mapInArrow(_each, "coarse long, id long, h long"), "members")
        rare = materialise(each.join(each.groupBy("coarse", "h").agg(F.count("*").alias("c")).where(f"c <= {RARE}"), ["coarse", "h"]), "rare")
        held = rare.groupBy("id").agg(F.count("*").alias("e"))
        one = materialise(one.join(held, "id", "left").withColumn("few", F.col("n") - F.coalesce("e", F.lit(0))).drop("e"), "one")
        # pairs of a bucket that need no rare shingle, each in the first bucket that both are in; two strays meet twice, so only once here
        # partners have all that they share, so a share of `percent` of each, in shingles that are not rare, and sizes that differ by less than two steps
        common = one.where(f"100 * few >= {percent} * n").withColumn("step", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int"))
        members = full.select("key", "id", "main").join(common, "id").join(classes.select("id", "bands"), "id")
        stray = members.where("component <> main").select("key", F.explode(F.expr("sequence(step - 1, step + 1)")).alias("step"), F.col("id").alias("i"), "n", "s", F.col("few").alias("x"), F.col("component").alias("own"), F.col("bands").alias("p"))
        other = members.select("key", "step", F.col("id").alias("j"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("few").alias("y"), "component", "main", F.col("bands").alias("q"))
        reach = f"100 * least(x, y) >= {percent} * (n + m - least(x, y)) and {_possible(percent)} and array_min(array_intersect(p, q)) = key"
        met = stray.join(other, ["key", "step"]).where("own <> component and (component = main or i < j)").where(reach).select("i", "j")
        # pairs with a rare shingle early in both; the first that two share leaves room for enough more after it
        early = rare.join(one, "id").withColumn("rank", F.expr("row_number() over (partition by id order by c, h)")).where(f"c > 1 and rank <= n - ceil({percent} * n / 100) + 1")
        stray = early.where("stray").select("coarse", "h", F.col("id").alias("i"), "n", "s", F.col("component").alias("own"), F.col("rank").alias("x"))
        other = early.select("coarse", "h", F.col("id").alias("j"), F.col("n").alias("m"), F.col("s").alias("t"), "component", F.col("stray").alias("too"), F.col("rank").alias("y"))
        room = f"(100 + {percent}) * (1 + least(n - x, m - y)) >= {percent} * (n + m) and {_possible(percent)}"
        met = met.union(stray.join(other, ["coarse", "h"]).where("own <> component and (not too or i < j)").where(room).select("i", "j"))
        fresh = materialise(met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            links = links.union(confirmed(fresh))
            component = components(links)
    of_class = classes.join(component, "id", "left").select(*alike, F.coalesce("component", "id").alias("component_id"))
    # the ids of rows that repeat a doc_id name one document
    linked = known.join(of_class, alike).select("doc_id", "n_shingles", "component_id")
    alone = signature.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def representatives(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs, with all their columns: of each component the document whose doc_id names it, once; rows with a null doc_id."""
    kept = near_duplicates(docs, shingle, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    chosen = docs.join(kept, docs["doc_id"].cast("long") == kept["_kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.union(docs.where(docs["doc_id"].isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2).withColumn("kept", F.expr("doc_id = component_id"))
