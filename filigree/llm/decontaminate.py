"""Benchmark decontamination by template canonicalisation.

Words are stripped of punctuation at their ends and put in lower case (A-Z); then numbers, units after numbers and names
(capitalised words) become the typed placeholders of a template. A capitalised word that begins a sentence may be a name or not, so
there are two readings of it: a word, and a name. Windows of WINDOW template
words of all benchmark items are indexed, in both readings, and beside them the windows of the words as they stand (in lower case) wherever a
placeholder would be put in; the windows of every document, of all kinds, are looked up by hash and hash-joined with the
items'. Windows of one text and item that lie on one diagonal and are of one reading are one alignment. An alignment counts if its slots are
consistent: each slot value of the item stands for one value of the document throughout, as in a question that was given new
parameters (or none); two different values may become equal. A document is contaminated by an item if an alignment covers
LEAST of the item's words (or all, of a shorter item). A window with more placeholders than words counts only as it stands.

Scale. The document side is one pass without a shuffle: a task tests each window against the sorted hashes of the
benchmark's windows, and only hits go on. The hashes are sent to the tasks in blocks of at most BLOCK_HASHES, so a
benchmark of any size takes bounded memory, with one pass for each block. Hits are joined with the items by hash.

Defined cases: null or empty texts match nothing; an item with fewer words than a window is one window by itself, if it has
at least SHORTEST words, and else cannot be looked for; rows that repeat a doc_id are reported once, and different texts of one doc_id are
aligned each by itself; rows with a null doc_id or item_id are not reported; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, table
from .words import U, Words, grams, signed, slices

WINDOW, LEAST, SHORTEST = 8, 12, 4
BLOCK_HASHES = 4_000_000

# Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million zwei drei vier fünf sechs sieben acht neun zehn hundert tausend deux trois quatre cinq sept huit neuf dix cent mille dos tres cuatro cinco seis siete ocho nueve diez cien mil".split()
UNITS = "km m cm mm mi mile miles foot feet inch inches yard yards kg g mg lb lbs pound pounds ounce ounces ton tons l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh hz khz mhz ghz kb mb gb tb w kw mw v a ohm k °c °f c f percent % dollar dollars euro euros cent cents eur usd gbp".split()
SENTENCE_ENDS = b".!?:"

NUMBER, UNIT, NAME = U(0x4E554D), U(0x554E49), U(0x4E414D)
_EDGE = np.zeros(256, bool)  # ASCII that is neither letter nor digit, but for % and what stands in words
_EDGE[[c for c in range(33, 128) if not chr(c).isalnum() and chr(c) != "%"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    return np.sort(Words(buf, np.concatenate([[0], np.cumsum([len(w) for w in raw])]), lower=True).hash)


_NUMBER_WORDS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNITS)


#: Readings that a window belongs to: both, the one where what begins a sentence is a word, and where it is a name.
BOTH, AS_WORD, AS_NAME = 0, 1, 2


class Template:
    """first: bounds of each text's template words; word: their hashes, placeholders put in; plain: those of the words as they stand; slot: hash of what a placeholder stands for, else 0.
    word_2 and slot_2 are those of the reading where capitalised words that begin a sentence are names."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray) -> None:
        words = Words(buf, bounds, lower=True, values=False)
        a, b = words.start.copy(), words.end.copy()
        if not len(buf):
            self.first, self.word, self.plain, self.slot, self.word_2, self.slot_2 = np.zeros(len(bounds), np.int64), *(np.zeros(0, U) for _ in range(5))
            return
        last = buf[b - 1] if len(b) else np.zeros(0, np.uint8)
        begins = np.ones(len(a), bool)  # at a sentence's beginning
        begins[1:] = np.isin(last[:-1], np.frombuffer(SENTENCE_ENDS, np.uint8))
        begins[words.first[:-1][words.first[:-1] < len(a)]] = True
        gap = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(buf == 10, out=gap[1:])
        begins[1:] |= gap[words.start[1:]] > gap[words.start[:-1]]
        for _ in range(8):
            move = (a < b) & _EDGE[buf[np.minimum(a, len(buf) - 1)]]
            if not move.any():
                break
            a[move] += 1
        for _ in range(8):
            move = (a < b) & _EDGE[buf[np.maximum(b - 1, 0)]]
            if not move.any():
                break
            b[move] -= 1
        own = words.owners()
        k = np.flatnonzero(a < b)
        a, b, own, begins = a[k], b[k], own[k], begins[k]
        self.first = np.searchsorted(own, np.arange(len(bounds)))
        h = words.spans(a, b, lower=True)
        at = buf[a] if len(a) else np.zeros(0, np.uint8)
        second = buf[np.minimum(a + 1, len(buf) - 1)] if len(a) else at
        number = ((at >= 48) & (at <= 57)) | np.isin(h, _NUMBER_WORDS)
        after = np.zeros(len(h), bool)
        after[1:] = number[:-1] & (own[1:] == own[:-1])
        unit = after & np.isin(h, _UNITS) & ~number
        upper = lambda x, y: ((x >= 65) & (x <= 90)) | ((x == 0xC3) & (y >= 0x80) & (y <= 0x9E))
        third = buf[np.minimum(a + 2, len(buf) - 1)] if len(a) else at
        shouted = (b - a > 1) & np.where(at == 0xC3, upper(third, third * 0), upper(second, third))
        capital = upper(at, second) & ~shouted & ~number & ~unit
        name = capital & ~begins
        held = number | unit | name
        self.plain = h
        self.slot = np.where(held, h, U(0))
        self.word = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
        self.slot_2, self.word_2 = np.where(capital, h, self.slot), np.where(capital, NAME, self.word)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, positions and readings of the windows of n template words, of which half at least are words, and of those of n
        words as they stand in which a placeholder would be (without one the two are the same)."""
        h, at = grams(self.word, self.first, n)
        many = lambda x: np.concatenate([[0], np.cumsum(x)])
        held, held_2, differ = many(self.slot != 0), many(self.slot_2 != 0), many(self.slot_2 != self.slot)
        inside, inside_2, apart = held[at + n] - held[at], held_2[at + n] - held_2[at], differ[at + n] > differ[at]
        good, good_2, some = 2 * inside <= n, apart & (2 * inside_2 <= n), inside > 0
        plain, h_2 = grams(self.plain, self.first, n)[0], grams(self.word_2, self.first, n)[0]
        kind = np.where(apart, AS_WORD, BOTH)
        return np.concatenate([h[good], h_2[good_2], plain[some]]), np.concatenate([at[good], at[good_2], at[some]]), np.concatenate([kind[good], np.full(int(good_2.sum()), AS_NAME), np.full(int(some.sum()), BOTH)])


def _lists(values: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    flat = values[(at[:, None] + np.arange(n)).ravel()] if len(at) else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * n).astype(np.int32)), signed(flat))


_ITEM = "item_id long, words int, n int, pos int, reading int, h long, slots array<long>"


def _item_windows(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column("text")):
                t = Template(buf, bounds)
                size = np.diff(t.first)
                own = np.repeat(np.arange(j - i), size)
                for n in np.unique(np.minimum(size, window)):
                    if n < SHORTEST:
                        continue
                    h, at, reading = t.windows(int(n))
                    mine = np.minimum(size[own[at]], window) == n if len(at) else np.zeros(0, bool)
                    h, at, reading = h[mine], at[mine], reading[mine]
                    named = reading == AS_NAME
                    h, at, reading = (np.concatenate([x[~named], x[named]]) for x in (h, at, reading))
                    slots = pa.concat_arrays([_lists(t.slot, at[: int((~named).sum())], int(n)), _lists(t.slot_2, at[int((~named).sum()) :], int(n))])
                    doc = own[at] if len(at) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item_id").take(pa.array(doc + i)), pa.array(size[doc].astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array((at - t.first[doc]).astype(np.int32)), pa.array(reading.astype(np.int32)), signed(h), slots],
                        ["item_id", "words", "n", "pos", "reading", "h", "slots"],
                    )

    return of


def _hits(known: dict[int, np.ndarray]):
    """known: for each window length the sorted hashes that are looked for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column("text")):
                t = Template(buf, bounds)
                own = np.repeat(np.arange(j - i), np.diff(t.first))
                for n, hashes in known.items():
                    h, at, _ = t.windows(n)
                    if not len(h):
                        continue
                    found = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
                    h, at = h[found], at[found]
                    if not len(h):
                        continue
                    doc = own[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc + i)), batch.column("key").take(pa.array(doc + i)), pa.array(np.full(len(at), n, np.int32)), pa.array((at - t.first[doc]).astype(np.int32)), signed(h), _lists(t.plain, at, n)],
                        ["doc_id", "key", "n", "at", "h", "values"],
                    )

    return of


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, item_words, matched (words of the item that the
    best alignment covers), doc_start (its first template word in the document), n_slots (different slot values)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("key", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    wanted = materialise(items.mapInArrow(_item_windows(window), _ITEM), "windows")
    sizes = wanted.select("n", "h").distinct().groupBy().count().first()[0]
    blocks = max(1, -(-sizes // BLOCK_HASHES))
    found = None
    for block in range(blocks):
        keys = wanted.where(f"pmod(xxhash64(h), {blocks}) = {block}").select("n", "h").distinct().toArrow()  # BLOCK_HASHES rows on average
        n, h = keys.column("n").to_numpy(), keys.column("h").to_numpy().view(U)
        known = {int(k): np.sort(h[n == k]) for k in np.unique(n)}
        hits = docs.mapInArrow(_hits(known), "doc_id long, key long, n int, at int, h long, values array<long>")
        found = hits if found is None else found.union(hits)
    pairs = found.join(wanted, ["h", "n"])
    slot = "filter(arrays_zip(slots, values), s -> s.slots <> 0)"
    alignments = (
        pairs.withColumn("pairs", F.expr(slot)).withColumn("reading", F.explode(F.expr(f"if(reading = {BOTH}, array({AS_WORD}, {AS_NAME}), array(reading))")))
        .groupBy("doc_id", "key", "item_id", "reading", (F.col("at") - F.col("pos")).alias("diagonal"))
        .agg(F.max("words").alias("item_words"), F.expr("size(array_distinct(flatten(collect_set(sequence(pos, pos + n - 1)))))").alias("matched"), F.min("at").alias("doc_start"), F.expr("array_distinct(flatten(collect_set(pairs)))").alias("pairs"))
    )
    consistent = "size(pairs) = size(array_distinct(transform(pairs, s -> s.slots)))"
    good = alignments.where(f"matched >= least(item_words, {least}) and {consistent}").withColumn("n_slots", F.expr("size(pairs)"))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("doc_start")).alias("before"), "item_words", "n_slots")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.item_words").alias("item_words"), F.col("b.matched").alias("matched"), (-F.col("b.before")).alias("doc_start"), F.col("b.n_slots").alias("n_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all their columns, without the contaminated ones."""
    bad = contamination(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
