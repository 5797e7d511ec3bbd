"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion.

Tokens are the words of a text, A-Z in lower case, and one end. Counts of all tokens are taken from all training texts.
The HMM's STATES latent states emit symbols. The SYMBOLS most frequent tokens are symbols of their own; any other token is
emitted as the symbol of its class (one of CLASSES, by its last three bytes), and within the class by its share of the
class's training tokens, add-half smoothed, with one place for unseen tokens, as in the base model:

    P(text) = sum over state paths of  prod A(state, next) B(state, symbol)  x  prod over class tokens of (c + 1/2) / (C + (V + 1) / 2)

so the probability of a text is exact, and the state tables are bounded however large the vocabulary grows.

Training. From a start of fixed noise, ITERATIONS rounds of Baum-Welch go over every training text, in single precision (a batch that
needs more is done again in double; likelihoods always are). The texts are written as
symbols once, laid out side by side as the recursions take them, and each round reads those: each task adds up its expected counts, one shuffle sums them over the partitions
by symbol, and the driver gets SYMBOLS + CLASSES rows.

Scoring. The counts of the most frequent tokens, LOOKUP at most, go to the tasks with the model; any other token's count comes by a
shuffle join of (text, token, how often) with the table of all counts, so nothing that grows with the vocabulary is
broadcast. Tokens are compared by 64-bit hashes.

Defined cases: a null text is empty: its one token is the end; a null doc_id is held out; rows with one doc_id are scored
each by itself; other columns are ignored; without any training text all counts are 0 and the model is the uniform start;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, materialise, table
from .words import U, Words, mix, signed, slices, stream

STATES, SYMBOLS, CLASSES, LOOKUP = 8, 16_000, 1024, 100_000
RUNGS = 64
#: Texts that are scored side by side: so many bytes and rows at most, or one longer text.
PART_BYTES, PART_ROWS = 16 << 20, 3000
ITERATIONS = 14
#: Tokens whose forward variables are held at once.
HELD = 400_000
LEAST_HELD, WIDE = 50_000, 128
#: Steps of the recursions between two scalings, in double precision; half as many in single.
RESCALE = 8
END = U(0x454E44)
#: The smoothing of a state's emissions towards all tokens' distribution, and of a transition, in tokens.
EMISSION_PRIOR, TRANSITION_PRIOR = 20.0, 1.0


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row after, hashes, classes, first) with the end token last in each text; its class is 0."""
    for i, j, buf, bounds in slices(texts):
        words = Words(buf, bounds, lower=True)
        kind = np.zeros(len(words.hash), np.int64)
        if len(kind):
            low = buf | np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
            for back in (1, 2, 3):
                at = words.end - back
                kind = kind * 256 + np.where(at >= words.start, low[np.maximum(at, 0)], 0)
            kind = (mix(kind.astype(U)) % U(CLASSES)).astype(np.int64)
        first = words.first + np.arange(len(words.first))
        h, g = np.full(first[-1], END, U), np.zeros(first[-1], np.int64)
        place = np.arange(len(words.hash)) + words.owners()
        h[place], g[place] = words.hash, kind
        yield i, j, h, g, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_sums(h, g) for _, _, h, g, _ in tokens(batch.column("text"))]
        if not found:
            continue
        u, g, n = _sums(*(np.concatenate(x) for x in zip(*found)))
        yield pa.RecordBatch.from_arrays([signed(u), pa.array(g.astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "g", "n"])


def _sums(h: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes, their classes, and how often they are there (or their sums of n)."""
    different = pa.array(h).dictionary_encode()
    at, u = different.indices.to_numpy(), different.dictionary.to_numpy()
    kind = np.empty(len(u), g.dtype)
    kind[at] = g
    return u, kind, np.bincount(at, n, len(u))


class Places:
    """Looks up ascending hashes by their leading bits, which are as good as random."""

    def __init__(self, values: np.ndarray) -> None:
        bits = max(1, int(2 * len(values)).bit_length())
        self.size, self.shift = len(values), U(64 - bits)
        self.first = np.searchsorted(values >> self.shift, np.arange(1 << bits, dtype=U))
        self.values = np.append(values, U(2**64 - 1))

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of x, the number of values at most, and whether it is there."""
        at = self.first[x >> self.shift]
        value = self.values[at]
        there = value == x
        k = np.flatnonzero(value < x)
        while len(k):
            at[k] += 1
            value = self.values[at[k]]
            there[k] = value == x[k]
            k = k[value < x[k]]
        return at, there & (at < self.size)


@dataclass
class Model:
    """own: the hashes of the tokens with symbols of their own, ascending; start, move: of the states; emit: [symbol, state]."""

    own: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @cached_property
    def places(self) -> Places:
        return Places(self.own)

    def symbols(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        at, there = self.places.find(h)
        return np.where(there, at, len(self.own) + g)


class _Batch:
    """Sequences side by side in time: at time t the first width[t] of them, longest first, still run."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> None:
        size = np.diff(first)[chosen]
        self.width = np.bincount(size, minlength=int(size[0]) + 1)[::-1].cumsum()[::-1][1:]
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        rank = np.repeat(np.arange(len(chosen)), size)
        time = np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size)
        place = self.at[time] + rank
        self.symbol, self.rank = np.empty(len(rank), np.int64), np.empty(len(rank), np.int32)
        self.symbol[place] = symbols[np.repeat(first[:-1][chosen], size) + time]
        self.rank[place] = rank


def _batches(symbols: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, _Batch]]:
    order = np.argsort(-np.diff(first), kind="stable")
    length = np.diff(first)[order]
    size = np.cumsum(length)
    k = 0
    while k < len(order):
        done = size[k - 1] if k else 0
        room = min(HELD, max(LEAST_HELD, WIDE * int(length[k])))
        e = max(k + 1, int(np.searchsorted(size, done + room, side="right")))
        yield order[k:e], _Batch(symbols, first, order[k:e])
        k = e


def _relative(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """[symbol, state]: each symbol's emissions as shares of the largest, and log10 of that. With these, RESCALE steps cannot underflow."""
    most = model.emit.max(axis=1)
    return model.emit / most[:, None], np.log10(most)


def log10_likelihoods(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each sequence, by the scaled forward recursion; forward variables are scaled at every RESCALE-th step."""
    out, one = np.zeros(len(first) - 1), np.ones(len(model.start))
    emit, most = _relative(model)
    for chosen, b in _batches(symbols, first):
        seen = emit.take(b.symbol, axis=0)
        total = np.bincount(b.rank, most[b.symbol], len(chosen))
        alpha, spare = np.empty((len(chosen), len(one))), np.empty((len(chosen), len(one)))
        alpha[:] = model.start
        o, before = 0, len(chosen)
        for t, n in enumerate(b.width.tolist()):
            if n < before:  # these have ended
                total[n:before] += np.log10(alpha[n:before] @ one)
                before = n
            if t:
                np.dot(alpha[:n], model.move, out=spare[:n])
                alpha, spare = spare, alpha
            alpha[:n] *= seen[o : o + n]
            if t % RESCALE == RESCALE - 1:
                scale = alpha[:n] @ one
                alpha[:n] /= scale[:, None]
                total[:n] += np.log10(scale)
            o += n
        total[:before] += np.log10(alpha[:before] @ one)
        out[chosen] = total
    return out


def expected_counts(model: Model, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of starts [state], moves [state, state] and emissions [symbol, state], by forward-backward."""
    return _expected(model, ((b.symbol, b.width) for _, b in _batches(symbols, first)))


def _expected(model: Model, batches: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the symbols and widths of batches."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(model.emit)))
    relative = _relative(model)[0]
    room: dict[type, np.ndarray] = {}  # one set of arrays for all batches
    table: dict[type, np.ndarray] = {}
    for symbol, width in batches:
        # half the memory traffic; in full precision again what single precision cannot hold
        for kind in (np.float32, np.float64):
            if kind not in room or room[kind].shape[1] < len(symbol):
                room[kind] = np.empty((4, len(symbol), k), kind)
                table[kind] = relative.astype(kind)
            found = _forward_backward(model, table[kind], symbol, width, room[kind][:, : len(symbol)])
            if found is not None:
                break
        else:
            raise FloatingPointError("forward and backward variables without any common state")
        moves, part = found
        move += moves
        start += part[:, : width[0]].sum(axis=1, dtype=float)
        for state in range(k):
            emit[state] += np.bincount(symbol, part[state], emit.shape[1])
    return start, move * model.move, np.ascontiguousarray(emit.T)


def _forward_backward(model: Model, relative: np.ndarray, symbol: np.ndarray, widths: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Sums over pairs of neighbours [state, state], without the transition itself, and shares [state, place]; None where numbers ran out.

    Forward and backward variables may have any scale at a place, as long as it is one for all states: what they are
    divided by in the end is the sum of their products there."""
    k, kind = len(model.start), room.dtype
    one, step = np.ones(k, kind), model.move.astype(kind)
    back, begin, every = np.ascontiguousarray(step.T), model.start.astype(kind), RESCALE // (8 // kind.itemsize)
    seen, alpha, ahead, beta = room
    relative.take(symbol, axis=0, out=seen, mode="clip")
    begins = np.concatenate([[0], np.cumsum(widths)])
    done = -np.diff(widths, append=0)  # so many sequences end at each time
    ends = np.repeat(begins[1:] - np.cumsum(done), done) + np.arange(widths[0])
    ahead[ends], beta[ends] = 0, 1
    at, width = begins.tolist(), widths.tolist()
    with np.errstate(all="ignore"):
        for t, n in enumerate(width):
            here = alpha[at[t] : at[t] + n]
            if t:
                np.dot(alpha[at[t - 1] : at[t - 1] + n], step, out=here)
            else:
                here[:] = begin
            here *= seen[at[t] : at[t] + n]
            if t % every == every - 1:
                here /= (here @ one)[:, None]
        for t in range(len(width) - 2, -1, -1):
            m, after = width[t + 1], at[t + 1]
            coming = ahead[at[t] : at[t] + m]
            np.multiply(seen[after : after + m], beta[after : after + m], out=coming)
            if t % every == every - 1:
                coming /= (coming @ one)[:, None]
            np.dot(coming, back, out=beta[at[t] : at[t] + m])
        beta *= alpha
        each = 1 / (beta @ one)
    if not np.isfinite(each).all():
        return None
    alpha *= each[:, None]
    return alpha.T @ ahead, np.multiply(beta.T, each, out=seen.reshape(k, -1))


def _estimate(model: Model, counts: tuple[np.ndarray, np.ndarray, np.ndarray], overall: np.ndarray) -> Model:
    start, move, emit = counts
    start, move, emit = start + TRANSITION_PRIOR, move + TRANSITION_PRIOR, emit + EMISSION_PRIOR * overall[:, None]
    return Model(model.own, start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _encode(model: Model):
    """The texts as batches: a row has the symbols of one, in the order of _Batch, and its widths."""
    kind = np.dtype("<u2" if len(model.emit) <= 1 << 16 else "<i4")

    def rows(held: list) -> pa.RecordBatch:
        symbols = np.concatenate([x for x, _ in held])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in held]))])
        found = [(b.symbol.astype(kind).tobytes(), b.width.astype("<i4").tobytes()) for _, b in _batches(symbols, first)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["symbols", "width"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for _, _, h, g, first in tokens(batch.column("text")):
                held.append((model.symbols(h, g).astype(kind), first))
                if sum(len(x) for x, _ in held) > 8 * HELD:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    return of


def _decode(batch: pa.RecordBatch, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The symbols and widths of each batch that is a row here."""
    kind = np.dtype("<u2" if symbols <= 1 << 16 else "<i4")
    for flat, width in zip(batch.column("symbols"), batch.column("width")):
        yield np.frombuffer(flat.as_buffer(), kind).astype(np.int64), np.frombuffer(width.as_buffer(), "<i4").astype(np.int64)


def _expect(model: Model):
    states = len(model.start)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _expected(model, _decode(batch, len(model.emit)))
            total = found if total is None else tuple(x + y for x, y in zip(total, found))
        if total is not None:
            start, move, emit = total
            used = np.flatnonzero(emit.any(axis=1))
            rows = np.concatenate([start[None], move, emit[used]])
            kind = np.concatenate([np.arange(-1 - states, 0), used]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], ["symbol", *(f"s{k}" for k in range(states))])

    return of


def _round(model: Model, encoded: DataFrame, overall: np.ndarray) -> Model:
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]
    sums = encoded.mapInArrow(_expect(model), ", ".join(["symbol int", *(f"{n} double" for n in names)])).groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names))
    found = np.zeros((1 + states + len(overall), states))
    for row in sums.collect():  # a row for each symbol
        found[row[0] + 1 + states] = row[1:]
    return _estimate(model, (found[0], found[1 : 1 + states], found[1 + states :]), overall)


def _score(model: Model, known: np.ndarray, counts: np.ndarray, share: np.ndarray, base: float):
    """known: hashes of the most frequent tokens, ascending, with their counts; share: log10 of each class's denominator."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with a place for those that are not there
        places, logs, symbol = Places(known), np.append(np.log10(counts + 0.5), 0.0), np.full(len(known) + 1, -1)
        symbol[np.searchsorted(known, model.own)] = np.arange(len(model.own))  # these are among the known
        for batch in chain.from_iterable(by_bytes(b, "text", PART_BYTES, PART_ROWS) for b in batches):
            size = batch.num_rows
            held, symbols, n_tokens = [], [], np.zeros(size, np.int64)
            n_known, base_score, score = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            for i, j, h, g, first in tokens(batch.column("text")):
                n = np.diff(first)
                owner = np.repeat(np.arange(j - i), n)
                at, there = places.find(h)
                at[~there] = len(known)
                own, s = logs[at], symbol[at]
                kind = s < 0
                s = np.where(kind, len(model.own) + g, s)
                symbols.append((s.astype(np.int32), n))
                n_tokens[i:j] = n
                n_known[i:j] = np.bincount(owner, there, j - i)
                base_score[i:j] = np.bincount(owner, own, j - i) - n * base
                score[i:j] = np.bincount(owner, np.where(kind, own - share[g], 0.0), j - i)
                # the rest: each text's other tokens, once each
                r = np.flatnonzero(~there)
                order = r[np.lexsort((h[r], owner[r]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                begin = np.flatnonzero(new)
                held.append((owner[order[begin]] + i, h[order[begin]], np.diff(np.append(begin, len(order)))))
            if not held:
                continue
            all_symbols = np.concatenate([x for x, _ in symbols])
            score += log10_likelihoods(model, all_symbols, np.concatenate([[0], np.cumsum(n_tokens)]))
            row, h, times = (np.concatenate(x) for x in zip(*held))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(size + 1)).astype(np.int32)), x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n_tokens), pa.array(n_known), pa.array(base_score), pa.array(score), lists(signed(h)), lists(pa.array(times.astype(np.int64)))],
                ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "h", "times"],
            )

    return of


def train(texts: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, DataFrame, dict]:
    """The model, the table of all counts (h, g, c) and what scoring needs of them. texts: the training texts."""
    counts = materialise(texts.mapInArrow(_count, "h long, g int, n long").groupBy("h").agg(F.first("g").alias("g"), F.sum("n").alias("c")), "counts")
    # the most frequent tokens, LOOKUP at most: down to the count (on a scale of RUNGS steps for each doubling) that many reach
    rung = F.floor(F.log2("c") * RUNGS).cast("int")
    reach, floor = 0, 0
    for r in sorted(counts.groupBy(rung.alias("r")).agg(F.count("*").alias("n")).collect(), reverse=True):  # a row for each rung
        if reach + r.n > LOOKUP:
            floor = r.r + 1
            break
        reach += r.n
    top = sorted(counts.where(rung >= floor).collect(), key=lambda r: (-r.c, r.h))
    h, c = np.array([r.h for r in top], np.int64).view(U), np.array([r.c for r in top], np.float64)
    own_n = min(SYMBOLS, len(h))
    order = np.argsort(h[:own_n])
    own = h[:own_n][order]
    last = (int(c[own_n - 1]), int(top[own_n - 1].h)) if top else (0, 0)
    rest = counts.where(f"c < {last[0]} or (c = {last[0]} and h > {last[1]})") if top else counts
    shares = rest.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # CLASSES rows
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    in_class, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in shares:
        in_class[r.g], kinds[r.g] = r.c, r.v
    weight = np.concatenate([c[:own_n][order], in_class]) + 0.5
    overall = weight / weight.sum()
    noise = (stream(len(overall) * states, 21) >> U(11)).astype(np.float64).reshape(-1, states) / 2.0**53
    emit = overall[:, None] * np.exp(noise)
    model = Model(own, np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))
    if top and iterations:
        encoded = materialise(texts.mapInArrow(_encode(model), "symbols binary, width binary"), "symbols")
        for _ in range(iterations):
            model = _round(model, encoded, overall)
    by = np.argsort(h)
    return model, counts, {"known": h[by], "counts": c[by], "share": np.log10(in_class + 0.5 * (kinds + 1)), "base": float(np.log10(total + 0.5 * (distinct + 1))), "train_tokens": int(total)}


def scores(docs: DataFrame, held_out: str, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """One row per document: doc_id, held_out (that SQL condition; null: true), n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.coalesce(F.expr(held_out), F.lit(True))
    model, counts, rest = train(docs.where(~out), states, iterations)
    trained = rest.pop("train_tokens")
    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _score(model, **rest), "doc_id long, row long, n_tokens long, n_known long, base_score double, score double, h array<long>, times array<long>"
    )
    # what belongs to the text goes with its first row alone, as most rows are other tokens
    own = ("doc_id", "n_tokens", "n_known", "base_score", "score")
    spread = scored.select("row", *own, F.posexplode_outer(F.arrays_zip("h", "times")).alias("at", "t"))
    each = spread.select("row", F.col("t.h").alias("h"), F.col("t.times").alias("times"), *(F.when(F.coalesce("at", F.lit(0)) == 0, F.col(x)).alias(x) for x in own))
    c = F.coalesce("c", F.lit(0))
    joined = each.join(counts.select("h", "c"), "h", "left")
    sums = joined.groupBy("row").agg(
        *(F.max(x).alias(x) for x in own),
        F.coalesce(F.sum(F.when(c > 0, F.col("times"))), F.lit(0)).alias("more_known"),
        F.coalesce(F.sum(F.col("times") * F.log10(c + 0.5)), F.lit(0.0)).alias("more"),
    )
    return sums.select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(trained).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 5 = 1")
