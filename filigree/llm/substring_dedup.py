"""Substring dedup by relative Lempel-Ziv parsing against all earlier documents.

Every document is parsed against an index of reference blocks, runs of `block` words, that holds for each block its first
place: the smallest doc_id in which it starts, and the first position there. The parse is greedy. Neighbouring blocks whose places
in one reference are neighbours, too, are a match as long as they reach. From each position that factor is taken which, of
the matches that cover the position, reaches furthest; words that no match covers are literals. A factor says where it stands
and which words of which reference it repeats. A factor that goes on where the one before ends may be shorter than a block; at
that boundary a block over both has been found, since matches are of whole blocks. Factors that touch are one duplicate
span. A word is removed if and only if some block over it also starts in a document with a smaller doc_id.

How it scales. Indexing every block of every document would shuffle a row for each word. Instead a document first shows
its anchors: of each run of block - gram + 1 consecutive `gram`-word hashes the smallest, so that any block has an
anchor of its own, the same wherever the block stands. Only blocks whose anchor two documents share go on; one
row for about 18 words in the first shuffle, and for each repeated word in the second. The minimum over a block is a
map-side combined aggregate, and both joins are plain shuffle joins that adaptive execution may split, so a passage that
stands in a third of all documents meets in no single task. A text that an earlier
document has whole is one factor at once. Texts are shuffled once, by document.

A text that repeats itself shows each
anchor and each block once, and finds the other places again when it is cut.

Blocks are equal if two independent 64-bit hashes of their word sequences are, and whole texts likewise; anchors only find
candidates.

Defined cases: a null or empty text has no words; rows with a null doc_id keep all their words; rows with the same
doc_id are each other's equals (neither is earlier); other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WORD_BASE_2, U, Words, grams, mix, signed, slices, window_min

BLOCK, GRAM = 50, 16
#: Tasks that the copies of one text are dealt to.
SALTS = 8


def _once(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of hashes and their texts the places of the first of each pair: a text that repeats itself counts once."""
    pair = h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(np.unique(pair, return_index=True)[1])


def _anchors(block: int, gram: int):
    run = block - gram + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column("text")):
                words = Words(buf, bounds, lower=False)
                h, at = grams(words.hash, words.first, gram)
                if len(h) < run:
                    continue
                owner = words.owners()[at]
                low = window_min(h, run)
                low[owner[: len(low)] != owner[run - 1 :]] = 0  # no run of one text
                room = np.zeros(run - 1, np.uint64)
                most = ~window_min(~np.concatenate([room, low, room]), run)
                k = np.flatnonzero(most == h)
                k = k[_once(h[k], owner[k])]
                doc = owner[k]
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array((at[k] - words.first[doc]).astype(np.int32)), signed(h[k])],
                    ["doc_id", "key", "pos", "h"],
                )

    return of


def _both(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two hashes of all blocks, and their positions."""
    h, at = grams(words.hash, words.first, block)
    return h, grams(words.second(), words.first, block, WORD_BASE_2)[0] if len(h) else h, at


def _blocks(block: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("shared")
            for i, j, buf, bounds in slices(batch.column("text")):
                words = Words(buf, bounds, lower=False)
                h, h2, at = _both(words, block)
                if not len(h):
                    continue
                part = shared.slice(i, j - i)
                anchor = np.asarray(part.flatten(), np.int64) + np.repeat(words.first[:-1], np.asarray(part.value_lengths(), np.int64))
                g, g_at = grams(words.hash, words.first, gram)
                place = np.zeros(len(words.hash), np.int64)
                place[g_at] = np.arange(len(g_at))
                low = window_min(g, block - gram + 1)[place[at]]  # each block's own anchor
                k = np.flatnonzero(np.isin(low, g[place[anchor]]))
                k = k[_once(h[k] ^ mix(h2[k]), words.owners()[at[k]])]
                doc = words.owners()[at[k]]
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array((at[k] - words.first[doc]).astype(np.int32)), signed(h[k]), signed(h2[k])],
                    ["doc_id", "key", "pos", "h", "h2"],
                )

    return of


def matches(at: np.ndarray, doc: np.ndarray, ref: np.ndarray, block: int) -> list[tuple[int, int, int, int]]:
    """(start, end, reference document, reference start) of the longest runs of blocks at ascending positions whose places in one reference go
    along."""
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(ref) != 1)
    k = np.flatnonzero(new)
    return list(zip(at[k].tolist(), (at[np.append(k[1:], len(at)) - 1] + block).tolist(), doc[k].tolist(), ref[k].tolist()))


def parse(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The greedy parse: from each position the match over it that reaches furthest. found is in order of start."""
    factors, at, k, best = [], 0, 0, None
    while True:
        while k < len(found) and found[k][0] <= at:
            if best is None or found[k][1] > best[1]:
                best = found[k]
            k += 1
        if best is not None and best[1] > at:
            start, end, doc, ref = best
            begin = max(at, start)
            factors.append((begin, end, doc, ref + begin - start))
            at = end
        elif k < len(found):
            at = found[k][0]
        else:
            return factors


#: Of a block that an earlier document has: where it starts (the high half) and where the same starts first, and in which document.
PLACE = ("at", "ref_doc")
_FACTOR = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])


def _cut(block: int):
    """Parses each text by its repeated blocks and cuts the spans out."""
    span_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def everywhere(buf: np.ndarray, bounds: np.ndarray, starts: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the positions of all blocks that equal one of those in `starts` (as PLACE has them), with the places of these."""
        words = Words(buf, bounds, lower=False)
        h, h2, at = _both(words, block)
        owner = words.owners()[at] if len(at) else at
        one = mix(h ^ mix(h2)) + owner.astype(U) * U(0x9E3779B97F4A7C15)  # within a text
        place = np.zeros(len(words.hash), np.int64)
        place[at] = np.arange(len(at))
        both, doc = (np.asarray(x.flatten(), np.int64) for x in starts)
        pos, ref = both >> 32, both & 0xFFFFFFFF
        marked = place[pos + np.repeat(words.first[:-1], np.asarray(starts[0].value_lengths().fill_null(0), np.int64))]
        by = np.argsort(one[marked], kind="stable")
        marked, doc, ref = marked[by], doc[by], ref[by]
        m = np.minimum(np.searchsorted(one[marked], one), len(marked) - 1)
        k = np.flatnonzero((h[marked[m]] == h) & (h2[marked[m]] == h2) & (owner[marked[m]] == owner))
        edges = np.searchsorted(owner[k], np.arange(len(bounds)))
        return [(at[k[x:y]] - first, doc[m[k[x:y]]], ref[m[k[x:y]]]) for x, y, first in zip(edges, edges[1:], words.first)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copies = batch.column("text"), batch.column("copy")
            for i, j, buf, bounds in slices(texts):
                own = [batch.column(c).slice(i, j - i) for c in PLACE]
                repeated = everywhere(buf, bounds, own) if len(own[0].flatten()) else [None] * (j - i)
                raw = buf.tobytes()
                n_words, all_factors, spans, kept = [], [], [], []
                for a, b, at, copy in zip(bounds.tolist(), bounds[1:].tolist(), repeated, copies.slice(i, j - i).to_pylist()):
                    words = raw[a:b].split()
                    n_words.append(len(words))
                    if copy is not None and len(words) >= block:
                        factors = [(0, len(words), copy, 0)]
                    else:
                        factors = parse(matches(*at, block)) if at is not None else []
                    merged: list[list[int]] = []
                    for x, y, _, _ in factors:
                        if merged and merged[-1][1] == x:
                            merged[-1][1] = y
                        else:
                            merged.append([x, y])
                    for x, y in reversed(merged):
                        del words[x:y]
                    all_factors.append([dict(zip(("start", "end", "ref_doc", "ref_start"), f)) for f in factors])
                    spans.append([{"start": x, "end": y} for x, y in merged])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(all_factors, pa.list_(_FACTOR)), pa.array(spans, pa.list_(span_type)), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "factors", "spans", "kept"],
                )

    return of


def substring_dedup(docs: DataFrame, block: int = BLOCK, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, factors (word positions [start, end), and the same words' document and start:
    ref_doc, ref_start), spans (factors that touch as one: what is duplicate), kept (the other words, joined by one space)."""
    # as they are where they have their types: a cast that does nothing would keep Spark from seeing that all uses of the
    # shuffled texts below are one
    kinds = dict(docs.dtypes)
    docs = docs.select(*(F.col(c) if kinds[c] == kind else F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string"))))
    keyed = docs.where("doc_id is not null").withColumn("key", F.xxhash64("text")).withColumn("key2", F.xxhash64(F.lit(block), "text"))
    # a text that an earlier document has whole has nothing of its own: it takes part in no parse
    texts = keyed.groupBy("key", "key2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    salted = texts.select("key", "key2", "a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = keyed.select("doc_id", "key", "key2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = dealt.join(salted, ["key", "key2", "salt"]).where("doc_id > a").groupBy("doc_id", "key").agg(F.min("a").alias("copy"))
    every = keyed.drop("key2").repartition("doc_id", "key").join(copies, ["doc_id", "key"], "left")
    rows = every.where("copy is null").drop("copy")
    at = "doc_id long, key long, pos int, h long"
    anchors = rows.mapInArrow(_anchors(block, gram), at)
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    positions = anchors.join(shared, "h").groupBy("doc_id", "key").agg(F.collect_set("pos").alias("shared"))
    blocks = rows.join(positions, ["doc_id", "key"]).mapInArrow(_blocks(block, gram), f"{at}, h2 long")
    place = F.min(F.struct(F.col("doc_id").alias("ref_doc"), F.col("pos").alias("ref_pos")))
    first = blocks.groupBy("h", "h2").agg(place.alias("a"), F.max("doc_id").alias("b")).where("a.ref_doc < b").select("h", "h2", "a.*")
    # plain rows are shuffled: lists of the few that meet by hash would take more room
    places = blocks.join(first, ["h", "h2"]).where("doc_id > ref_doc").select("doc_id", "key", F.expr("shiftleft(bigint(pos), 32) | ref_pos").alias("at"), "ref_doc")
    repeated = places.repartition("doc_id", "key").groupBy("doc_id", "key").agg(*(F.collect_list(c).alias(c) for c in PLACE))
    whole = every.join(repeated, ["doc_id", "key"], "left").drop("key")
    # a null id is earlier than none and later than none
    rest = docs.where("doc_id is null").withColumn("copy", F.lit(None).cast("long")).select("*", *(F.lit(None).cast(dict(repeated.dtypes)[c]).alias(c) for c in PLACE))
    factor = "array<struct<start:int,end:int,ref_doc:bigint,ref_start:int>>"
    return whole.unionByName(rest).mapInArrow(_cut(block), f"doc_id long, n_words long, factors {factor}, spans array<struct<start:int,end:int>>, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    out = substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
