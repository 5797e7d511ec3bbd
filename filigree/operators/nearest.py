"""The best of many for each of many, in bounded memory: tiles of scores in the tasks, of which each task keeps and passes on k rows a question.

Every pair is scored; a cell is left out only if k better ones have been seen by then. Questions go to the tasks in blocks of QUERY_BLOCK; a
tile has CELLS scores at most. Both sides may have a key, and then only pairs of one key are scored: rows with others are never compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import spread

#: Questions whose vectors go to the tasks at once.
QUERY_BLOCK = 2048
#: Scores that a task holds at once; pairs that it multiplies or sorts at once.
CELLS, PAIRS = 1 << 21, 1 << 16
#: Vectors of a tile.
TILE = 4096
#: No cosine is below this.
LEAST = -2.0


class Best:
    """Of each of n questions the k best rows so far: by the rounded score, then by id. least has the score that a further row must reach."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits, self.least = k, digits, np.full(n, -np.inf)
        self.kept: pa.Table | None = None
        self.fresh: list[pa.Table] = []
        self.waiting, self.room = 0, max(PAIRS, n * k)

    def add(self, q: np.ndarray, score: np.ndarray, rows: dict[str, pa.Array]) -> None:
        """Rows of the questions numbered q; rows has their ids and what else is kept with them."""
        self.fresh.append(pa.table({"q": q.astype(np.int32), "s": np.round(score, self.digits), "score": score, **rows}))
        self.waiting += len(q)
        if self.waiting >= (self.room if np.isfinite(self.least[q]).any() else PAIRS // 8):
            self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        every = pa.concat_tables(self.fresh if self.kept is None else [self.kept, *self.fresh])
        every = every.take(pc.sort_indices(every, [("q", "ascending"), ("s", "descending"), ("id", "ascending")]))
        q = every["q"].to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        full = place == self.k - 1
        self.least[q[full]] = every["s"].to_numpy()[full]
        self.kept, self.fresh, self.waiting = every.filter(pa.array(place < self.k)).combine_chunks(), [], 0

    def worth(self, tile: np.ndarray, q: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Cells (row, column) of a tile of scores, with a row for each of the questions q, that may be among the k best and are not below floor."""
        margin = 10.0**-self.digits  # more than rounding and the order of a sum can change
        cells = tile >= np.maximum(self.least[q] - margin, floor)[:, None]
        n = tile.shape[1]
        if n > self.k and np.count_nonzero(cells) > max(4 * self.k * len(q), PAIRS // 4):
            cells &= tile >= (np.partition(tile, n - self.k, axis=1)[:, n - self.k] - margin)[:, None]
        return np.nonzero(cells)

    def batches(self, qids: pa.Array, score: str, more: list[str]) -> Iterator[pa.RecordBatch]:
        """qid, id, score and more; score: s for the rounded one."""
        self.settle()
        if self.kept is not None:
            out = pa.table({"qid": qids.take(self.kept["q"].combine_chunks()), "id": self.kept["id"], "score": self.kept[score], **{c: self.kept[c] for c in more}})
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)


def _whole(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each list the length, where its numbers begin, and all numbers; the length is -1 for one that is null or has a null in it or what is not finite."""
    flat = v.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
    begin = np.cumsum(size) - size
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    usable = pc.is_valid(v).to_numpy(zero_copy_only=False) & (bad[begin + size] == bad[begin]) & (size > 0)
    return np.where(usable, size, -1), begin, x


def _unit(x: np.ndarray) -> np.ndarray:
    """A vector of no length stays as it is, and is like nothing."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(most == 0, 1, most)  # squares of what is very large or small
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _groups(keys: list, v: pa.Array) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors by key and length."""
    size, begin, x = _whole(v)
    rows: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(size >= 0):
        if keys[i] is not None:
            rows.setdefault((keys[i], int(size[i])), []).append(i)
    return {g: (np.array(r), _unit(x[begin[r][:, None] + np.arange(g[1])])) for g, r in rows.items()}


def _search(asked: pa.Table, k: int, digits: int, apart: bool, more: list[str]):
    qids, groups = asked["qid"].combine_chunks(), _groups(asked["key"].to_pylist(), asked["v"].combine_chunks())
    names = {name for name, _ in groups}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(qids), k, digits)
        for batch in batches:
            key = batch.column("key").dictionary_encode()
            code = pc.fill_null(key.indices, -1).to_numpy(zero_copy_only=False)
            size, begin, flat = _whole(batch.column("v"))
            for c, name in enumerate(key.dictionary.to_pylist()):
                mine = np.flatnonzero((code == c) & (size > 0)) if name in names else []
                for length in np.unique(size[mine]) if len(mine) else []:
                    if (name, int(length)) in groups:
                        _pairs(best, *groups[name, int(length)], batch, mine[size[mine] == length], begin, flat, int(length), more, qids if apart else None)
        yield from best.batches(qids, "s", more)

    return of


def _pairs(best: Best, q: np.ndarray, queries: np.ndarray, batch: pa.RecordBatch, rows: np.ndarray, begin: np.ndarray, flat: np.ndarray, length: int, more: list[str], qids: pa.Array | None) -> None:
    """All of the questions q with the given rows of a batch. qids: a question doesn't meet the row with its own id."""
    step = max(1, CELLS // TILE)
    for at in range(0, len(rows), TILE):
        own = rows[at : at + TILE]
        x = _unit(flat[begin[own][:, None] + np.arange(length)])
        held = {c: batch.column(c).take(pa.array(own)) for c in ("id", *more)}
        for a in range(0, len(q), step):
            part, mine = queries[a : a + step], q[a : a + step]
            tile = part @ x.T
            if qids is not None:
                asked = qids.take(pa.array(mine)).cast(held["id"].type)
                ids = pc.unique(asked)
                of_question, of_row = pc.index_in(asked, value_set=ids).to_numpy(zero_copy_only=False), pc.fill_null(pc.index_in(held["id"], value_set=ids), -1).to_numpy(zero_copy_only=False)
                same = np.flatnonzero(of_row >= 0)
                i, j = np.nonzero(of_question[:, None] == of_row[same])
                tile[i, same[j]] = -np.inf
            r, c = best.worth(tile, mine, LEAST)
            for s in range(0, len(r), PAIRS):
                rr, cc = r[s : s + PAIRS], c[s : s + PAIRS]
                score = np.einsum("ij,ij->i", part[rr], x[cc])  # equal vectors have equal scores, wherever they stand in a tile
                best.add(mine[rr], score, {n: v.take(pa.array(cc)) for n, v in held.items()})


def blocks_of(questions: DataFrame) -> int:
    return max(1, -(-questions.count() // QUERY_BLOCK))


def block_of(questions: DataFrame, block: int, blocks: int) -> DataFrame:
    return questions.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else questions


def nearest(vectors: DataFrame, questions: DataFrame, k: int, digits: int = 9, key: bool = False, apart: bool = False) -> DataFrame:
    """qid, id, score (cosine, rounded to digits) and other columns of vectors: k nearest rows at least of vectors (id, v, ...) for each of questions (qid, v) from each
    task, to be ranked by score and id. With key, both have a key, and only rows of the question's are looked at; apart leaves out the row with
    the question's own id. Vectors that are null or of another length, or hold a null or what is not finite, take no part."""
    one = F.lit(0).alias("key")
    doubles = F.col("v").cast("array<double>").alias("v")
    more = [c for c in vectors.columns if c not in ("id", "v", "key")]
    usable = spread(vectors.select("id", "key" if key else one, doubles, *more).where("id is not null and v is not null and key is not null"))
    asked = questions.select("qid", "key" if key else one, doubles)
    blocks = blocks_of(questions)
    kinds = {f.name: f.dataType for f in usable.schema.fields}
    schema = StructType([StructField("qid", asked.schema["qid"].dataType), StructField("id", kinds["id"]), StructField("score", DoubleType()), *(StructField(c, kinds[c]) for c in more)])
    found = None
    for block in range(blocks):
        part = block_of(asked, block, blocks).toArrow()
        near = usable.mapInArrow(_search(part, k, digits, apart, more), schema)
        found = near if found is None else found.union(near)
    return found
