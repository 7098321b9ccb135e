"""Language-model scores by a hidden Markov model over words.

Words are counted over all training documents; the base is their unigram. The model's emissions are that unigram times a ratio for each word and state, so an
unseen word costs what it costs the base, and with one state the score is the base score.

Baum-Welch runs over every training document until a round gains less than ``GAIN``: tasks sum expected counts, Spark adds them up, and the driver gets one row
for each symbol. In these rounds the ``OWN`` most frequent words are symbols, and the others share symbols by their crc32. The last round is then taken over again for
those others: their expected (word, state) counts are summed in Spark, for as many words as there are, so every word of the training texts has
emissions of its own. They meet the texts in a join by blocks: a block is a row of up to ``BLOCK`` tokens with the list of its infrequent words.

A text's score is its exact likelihood by the scaled forward recursion. A text of more than ``PIECE`` tokens is worked on in pieces side by side: each piece's product of
matrices is taken for every state before it, the products are chained, and the recursion runs in all pieces at once. Memory is bounded by ``CELLS``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import crc_mod, table, unused
from sparkloom.session import cut, cut_table, drop_table

STATES, OWN, CLASSES, SEED = 6, 32_767, 1_024, 11
SYMBOLS = 1 + OWN + CLASSES
#: Rounds of Baum-Welch end when one gains less than GAIN in log10 a token, or after ROUNDS of them.
ROUNDS, GAIN = 50, 0.004
#: Tokens of a block, of a piece of a long text, and cells (pieces by tokens) that are worked on at a time; steps between two scalings.
BLOCK, PIECE, CELLS, SCALE = 3_000_000, 16_384, 524_288, 4
#: An infrequent word's shares of the states travel as numbers of BITS bits, A_LONG in a long.
BITS, A_LONG = 10, 6
#: Distinct words that a task counts before it sends them on, and tasks of the table of blocks that make one of a round's.
COUNTED, TOGETHER = 1_000_000, 3


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    ratio: np.ndarray  # (symbols, states): emission by the unigram's
    share: np.ndarray  # (states,): of all training tokens

    @classmethod
    def fresh(cls, symbols: int = SYMBOLS, states: int = STATES, seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        ratio = r.gamma(1.0, 1.0, (symbols, states)) + 0.05
        move = np.full((states, states), 0.05 / states) + 0.95 * np.eye(states)
        return cls(np.full(states, 1 / states), move, ratio / ratio.mean(axis=1, keepdims=True), np.full(states, 1 / states))

    def cast(self, kind) -> Model:
        return Model(self.start.astype(kind), self.move.astype(kind), self.ratio.astype(kind), self.share.astype(kind))


@dataclass
class Counts:
    """Expected counts, log10 likelihood and tokens."""

    start: np.ndarray
    move: np.ndarray
    grid: np.ndarray  # (symbols, states)
    log: float = 0.0
    tokens: int = 0

    @classmethod
    def zero(cls, symbols: int, states: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def model(self, kinds: np.ndarray) -> Model:
        """The next round's model. kinds: how many words each symbol stands for."""
        states = len(self.start)
        share = self.grid.sum(axis=0) + 1e-9
        share = share / share.sum()
        ratio = ratios(self.grid, self.grid.sum(axis=1), kinds, share)
        start, move = self.start + 0.1 / states, self.move + 0.1 / states
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), ratio, share)


def ratios(grid: np.ndarray, n: np.ndarray, kinds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Emissions by the unigram's: half a count for every word, as in the base, is dealt to the states by their shares."""
    below = n + 0.5 * kinds
    return np.where(below[:, None] > 0, (grid / share + 0.5 * kinds[:, None]) / np.where(below > 0, below, 1)[:, None], 1.0)


def pieces_of(lengths: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number within the text, first token, tokens) of every piece of texts that stand one after another."""
    many = np.maximum(1, -(-lengths // piece))
    text = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, k, (np.cumsum(lengths) - lengths)[text] + k * piece, np.minimum(piece, lengths[text] - k * piece)


def groups(size: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers by falling size, so many at a time that rows by the longest stay within CELLS (one row at least)."""
    order = np.argsort(-size, kind="stable")
    k = 0
    while k < len(order):
        n = max(1, CELLS // max(1, int(size[order[k]])))
        yield order[k : k + n]
        k += n


class Walk:
    """The scaled forward recursion over pieces of falling sizes.

    codes: rows of model.ratio for all tokens; at and size: the pieces' first tokens and sizes; before: the state probabilities that the first token is met with. With keep, the steps
    stay for back(). Steps lie one after another: step t has a row for each piece that is longer than t.
    """

    def __init__(self, model: Model, codes: np.ndarray, at: np.ndarray, size: np.ndarray, before: np.ndarray, keep: bool = False):
        self.model, self.factors = model, {}
        steps, states, tiny = int(size[0]), len(model.start), np.finfo(model.move.dtype).tiny
        self.live = np.searchsorted(-size, -np.arange(steps + 1), side="left").tolist()  # pieces longer than t
        self.begin = np.concatenate([[0], np.cumsum(self.live)]).tolist()
        t = np.repeat(np.arange(steps), self.live[:-1])
        self.places = at[np.arange(len(t)) - np.array(self.begin)[t]] + t
        self.ratio = np.take(model.ratio, np.take(codes, self.places), axis=0)
        self.alpha = np.empty_like(self.ratio)
        self.logs, self.last = np.zeros(len(size)), np.empty((len(size), states), dtype=model.move.dtype)
        for t in range(steps):
            n, more, o = self.live[t], self.live[t + 1], self.begin[t]
            a = self.alpha[o : o + n]
            if t:
                np.matmul(last[:n], model.move, out=a)
                a *= self.ratio[o : o + n]
            else:
                np.multiply(before, self.ratio[:n], out=a)
            if t % SCALE == SCALE - 1:
                f = np.maximum(a.sum(axis=1), tiny)
                a /= f[:, None]
                self.logs[:n] += np.log10(f)
                self.factors[t] = f
            if more < n:
                self.last[more:n] = a[more:]
            last = a
        f = np.maximum(self.last.sum(axis=1), tiny)
        self.last /= f[:, None]
        self.logs += np.log10(f)
        if not keep:
            del self.alpha, self.ratio, self.places

    def back(self, after: np.ndarray, entry: np.ndarray, first: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Add the expected moves and starts to counts; the tokens' places and their state probabilities are returned.

        after: what follows a piece, by its last state; entry: state probabilities of the token before it; first: pieces without one.
        """
        turned, beta, tiny = np.ascontiguousarray(self.model.move.T), np.empty_like(self.alpha), np.finfo(self.alpha.dtype).tiny
        ahead = self.ratio  # becomes ratio times beta, relative to the unscaled alpha
        goes_on = np.ones(len(self.places), dtype=bool)
        for t in range(len(self.live) - 2, -1, -1):
            n, m, o = self.live[t], self.live[t + 1], self.begin[t]
            if m:
                np.matmul(ahead[self.begin[t + 1] : self.begin[t + 1] + m], turned, out=beta[o : o + m])
            if m < n:
                end = after[m:n]
                beta[o + m : o + n] = end / np.maximum((self.alpha[o + m : o + n] * end).sum(axis=1), tiny)[:, None]
                goes_on[o + m : o + n] = False
            ahead[o : o + n] *= beta[o : o + n]
            if t in self.factors:
                ahead[o : o + n] /= self.factors[t][:, None]
        n = self.live[0]
        counts.move += self.alpha[goes_on].T @ ahead[n:] * self.model.move
        if not first.all():
            counts.move += entry[~first].T @ ahead[:n][~first] * self.model.move
        beta *= self.alpha
        counts.start += beta[:n][first].sum(axis=0)
        return self.places, beta


def _chain(model: Model, codes: np.ndarray, text: np.ndarray, k: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every piece of a long text: the state probabilities before it, what follows it by its last state, and log10 of its likelihood given all before it.

    Pieces of other texts have ones after them and a log of zero.
    """
    s, kind = model.move.shape[0], model.move.dtype
    entry, after, logs = np.zeros((len(text), s), dtype=kind), np.ones((len(text), s), dtype=kind), np.zeros(len(text))
    later = np.flatnonzero(k > 0)
    if not len(later):
        return entry, after, logs
    heads = np.unique(later - k[later])
    first = {}
    for rows in groups(size[heads]):
        rows = heads[rows]
        w = Walk(model, codes, at[rows], size[rows], np.repeat(model.start[None, :], len(rows), axis=0))
        first.update({int(p): (w.last[j], w.logs[j]) for j, p in enumerate(rows)})
    matrix, scale = np.empty((len(later), s, s), dtype=np.float64), np.empty(len(later))
    for rows in groups(size[later] * s):  # a row for each state before the piece
        wide = np.repeat(later[rows], s)
        w = Walk(model, codes, at[wide], size[wide], np.tile(model.move, (len(rows), 1)))
        made = w.logs.reshape(-1, s)
        most = made.max(axis=1)
        matrix[rows] = w.last.reshape(-1, s, s) * 10.0 ** (made - most[:, None])[:, :, None]
        scale[rows] = most
    number = {int(p): j for j, p in enumerate(later)}
    for head in heads.tolist():
        here, logs[head] = first[head]
        p = head + 1
        while p < len(text) and text[p] == text[head]:
            entry[p] = here
            here = here.astype(np.float64) @ matrix[number[p]]
            logs[p] = np.log10(here.sum()) + scale[number[p]]
            here = here / here.sum()
            p += 1
        follows = np.ones(s)
        while p - 1 > head:
            p -= 1
            after[p] = follows
            follows = matrix[number[p]] @ follows
            follows /= follows.sum()
        after[head] = follows
    return entry, after, logs


def likelihoods(model: Model, codes: np.ndarray, lengths: np.ndarray, piece: int | None = None) -> np.ndarray:
    """log10 of what the model makes of each text beside the unigram. codes: all texts' rows of model.ratio, one text after another."""
    text, k, at, size = pieces_of(lengths, piece or PIECE)
    _, _, logs = _chain(model, codes, text, k, at, size)
    alone = np.flatnonzero(np.bincount(text, minlength=len(lengths))[text] == 1)
    for rows in groups(size[alone]):
        rows = alone[rows]
        logs[rows] = Walk(model, codes, at[rows], size[rows], np.repeat(model.start[None, :], len(rows), axis=0)).logs
    return np.bincount(text, weights=logs, minlength=len(lengths))


def expected(model: Model, codes: np.ndarray, lengths: np.ndarray, counts: Counts, piece: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Add expected counts of starts and moves, the likelihood and the tokens to counts; yields tokens' places with their state probabilities."""
    text, k, at, size = pieces_of(lengths, piece or PIECE)
    entry, after, _ = _chain(model, codes, text, k, at, size)
    for rows in groups(size):
        first = k[rows] == 0
        before = np.where(first[:, None], model.start[None, :], entry[rows] @ model.move)
        w = Walk(model, codes, at[rows], size[rows], before, keep=True)
        counts.log += float(w.logs.sum())
        counts.tokens += int(size[rows].sum())
        yield w.back(after[rows], entry[rows], first, counts)


def add_to(grid: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
    """Add weights (tokens by states; a token's are 1 in all) to the given rows of a grid."""
    left = np.bincount(rows, minlength=len(grid)).astype(np.float64)
    for s in range(grid.shape[1] - 1):
        one = np.bincount(rows, weights=weights[:, s], minlength=len(grid))
        grid[:, s] += one
        left -= one
    grid[:, -1] += np.maximum(left, 0)


def _learned(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and lengths of a block's training texts, and their tokens' places in the block."""
    codes, lengths = np.frombuffer(row["syms"], dtype=np.uint16), np.array(row["lengths"], dtype=np.int64)
    learn = np.array(row["learn"], dtype=bool)
    where = np.flatnonzero(np.repeat(learn, lengths))
    return codes[where], lengths[learn], where


STATE_COLUMNS = [f"e{s}" for s in range(STATES)]


def _round(coded: DataFrame, model: Model) -> Counts:
    """Expected counts of all training texts in the table of blocks."""
    small = model.cast(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.zero(SYMBOLS, STATES)
        for batch in batches:
            for row in batch.to_pylist():
                codes, lengths, _ = _learned(row)
                if len(lengths):
                    for places, gamma in expected(small, codes, lengths, counts):
                        add_to(counts.grid, codes[places], gamma)
        at = np.flatnonzero(counts.grid.any(axis=1))
        rest = np.zeros((2 + STATES, STATES))
        rest[0, :2], rest[1], rest[2:] = (counts.log, counts.tokens), counts.start, counts.move
        values = np.concatenate([counts.grid[at], rest])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - np.arange(len(rest))]), type=pa.int32()), *(pa.array(values[:, s].astype(np.float32)) for s in range(STATES))], names=["at", *STATE_COLUMNS])

    schema = ", ".join(["at int", *(f"{e} float" for e in STATE_COLUMNS)])
    few = coded.select("lengths", "learn", "syms")
    few = few.coalesce(max(1, -(-few.rdd.getNumPartitions() // TOGETHER)))  # each task sends a row for every symbol
    sums = few.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(e).alias(e) for e in STATE_COLUMNS]).toArrow()  # a row a symbol
    at, values = sums.column("at").to_numpy(), np.stack([sums.column(e).to_numpy() for e in STATE_COLUMNS], axis=1)
    out = Counts.zero(SYMBOLS, STATES)
    out.grid[at[at >= 0]] = values[at >= 0]
    rest = np.zeros((2 + STATES, STATES))
    rest[-1 - at[at < 0]] = values[at < 0]
    out.log, out.tokens, out.start, out.move = rest[0, 0], int(rest[0, 1]), rest[1], rest[2:]
    return out


def baum_welch(coded: DataFrame, kinds: np.ndarray, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Model, Model, list[float]]:
    """(the model that the last round began with, the one it gave, log10 likelihood a token beside the unigram's before each round)."""
    old, new, logs = Model.fresh(), Model.fresh(), []
    while len(logs) < rounds and (len(logs) < 3 or logs[-1] - logs[-2] >= gain):
        old, counts = new, _round(coded, new)
        new = counts.model(kinds)
        logs.append(counts.log / max(1, counts.tokens))
    return old, new, logs


LONGS = [f"p{k}" for k in range(-(-STATES // A_LONG))]


def _infrequent(coded: DataFrame, model: Model) -> DataFrame:
    """(block, pos, n, p...): counts and shares of the states for the infrequent words of every block, over all training texts, by the expectations under a model."""
    small, most = model.cast(np.float32), (1 << BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["words"]
                if not words:
                    continue
                codes, lengths, where = _learned(row)
                rank = np.full(len(row["syms"]) // 2, -1, dtype=np.int64)
                rank[np.frombuffer(row["syms"], dtype=np.uint16) > OWN] = np.frombuffer(row["tail"], dtype=np.int32)
                rank, grid = rank[where], np.zeros((len(words), STATES))
                if len(lengths):
                    for places, gamma in expected(small, codes, lengths, Counts.zero(0, STATES)):
                        mine = rank[places]
                        add_to(grid, mine[mine >= 0], gamma[mine >= 0])
                n = np.bincount(rank[rank >= 0], minlength=len(words))
                share = np.rint(grid / np.maximum(grid.sum(axis=1, keepdims=True), 1e-9) * most).astype(np.int64)
                packed = [sum(share[:, s] << BITS * (s % A_LONG) for s in range(STATES) if s // A_LONG == k) for k in range(len(LONGS))]
                for k in range(0, len(words), 20_000):
                    part = slice(k, k + 20_000)
                    pos = np.arange(len(words), dtype=np.int32)[part]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), row["block"], dtype=np.int64)), pa.array(pos), pa.array(words[part], type=pa.string()), pa.array(n[part].astype(np.int64)), *(pa.array(p[part]) for p in packed)], names=["block", "pos", "word", "n", *LONGS])

    schema = ", ".join(["block bigint", "pos int", "word string", "n bigint", *(f"{p} bigint" for p in LONGS)])
    found = coded.select("block", "lengths", "learn", "syms", "tail", "words").mapInArrow(run, schema)
    alike = Window.partitionBy("word")  # a row a block at most; none of these words is frequent
    own = lambda s: F.shiftright(F.col(LONGS[s // A_LONG]), BITS * (s % A_LONG)).bitwiseAND(F.lit(most))
    found = found.select("block", "pos", F.sum("n").over(alike).alias("n"), *[F.sum(F.col("n") * own(s)).over(alike).alias(f"t{s}") for s in range(STATES)]).where("n > 0")
    packed = [sum((F.shiftleft(F.round(F.col(f"t{s}") / F.col("n")).cast("bigint"), BITS * (s % A_LONG)) for s in range(STATES) if s // A_LONG == k), F.lit(0).cast("bigint")).alias(p) for k, p in enumerate(LONGS)]
    return found.select("block", "pos", "n", *packed)


def _words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at white space of ASCII."""
    return (text or "").encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], type=pa.string()), pa.array(list(found.values()), type=pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0):
            found.update(_words(text.as_py()))
            if len(found) > COUNTED:
                yield made()
                found.clear()
    yield made()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of all texts in the only column; a task counts before anything is shuffled."""
    return texts.mapInArrow(_count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counted: DataFrame, n: int) -> list:
    """The n rows (word, c) of greatest c, ties by word; counts are positive.

    Words with fewer binary digits in their counts than the n-th has play no part, and the driver gets n rows, not n from each task.
    """
    digits, above, least = F.length(F.bin("c")), 0, 0
    for r in sorted(counted.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.d):  # 64 rows at most
        above, least = above + r.n, r.d
        if above >= n:
            break
    top = cut(counted.where(digits >= least).orderBy(F.desc("c"), "word").limit(n))
    return sorted(top.collect(), key=lambda r: (-r.c, r.word))


@dataclass
class Vocabulary:
    """The frequent words and the classes of the others."""

    index: dict[bytes, int]  # symbol of each frequent word
    c: np.ndarray  # (SYMBOLS,) training counts
    kinds: np.ndarray  # (SYMBOLS,) words of each symbol
    total: int
    below: float

    @classmethod
    def of(cls, counted: DataFrame, ends: int) -> Vocabulary:
        """counted: (word, c) of the training texts; ends: how many there are."""
        total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        head = most_frequent(counted, OWN)
        c, kinds = np.zeros(SYMBOLS, dtype=np.int64), np.zeros(SYMBOLS)
        bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(CLASSES)).cast("int")
        for r in counted.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():  # a row a class
            c[1 + OWN + r.b], kinds[1 + OWN + r.b] = r.c, r.k
        for k, r in enumerate(head):
            b = 1 + OWN + zlib.crc32(r.word.encode()) % CLASSES
            c[1 + k], kinds[1 + k], c[b], kinds[b] = r.c, 1, c[b] - r.c, kinds[b] - 1
        c[0], kinds[0] = ends, ends > 0
        total, distinct = int(total) + ends, distinct + (ends > 0)
        return cls({r.word.encode(): 1 + k for k, r in enumerate(head)}, c, kinds, total, total + 0.5 * (distinct + 1))


def _coder(index):
    """Turns rows into blocks; the last two columns are whether to learn from a row, and its text."""

    def block(rows: pa.RecordBatch, learn: list, syms: list, tail: list, words: dict) -> pa.RecordBatch:
        keep = pa.StructArray.from_arrays([rows.column(i) for i in range(rows.num_columns - 2)], fields=[rows.schema.field(i) for i in range(rows.num_columns - 2)])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values)
        lengths, codes, rank = [len(s) for s in syms], np.concatenate(syms), np.array(tail, dtype=np.int32)
        classes = np.array([1 + OWN + zlib.crc32(w) % CLASSES for w in words], dtype=np.uint16)
        others = codes == 0
        others[np.cumsum(lengths) - 1] = False  # the ends
        codes[others] = classes[rank]
        return pa.RecordBatch.from_arrays(
            [
                one(keep),
                one(pa.array(lengths, type=pa.int32())),
                one(pa.array(learn, type=pa.bool_())),
                pa.array([codes.tobytes()], type=pa.binary()),
                pa.array([rank.tobytes()], type=pa.binary()),
                one(pa.array([w.decode() for w in words], type=pa.string())),
            ],
            names=["docs", "lengths", "learn", "syms", "tail", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.value.get
        for batch in batches:
            begin, size, learn, syms, tail, local = 0, 0, [], [], [], {}
            add = local.setdefault
            for i in range(batch.num_rows):
                words = _words(batch.column(batch.num_columns - 1)[i].as_py())
                own = np.zeros(len(words) + 1, dtype=np.uint16)  # the end's symbol is 0
                own[:-1] = [get(w, 0) for w in words]
                tail += [add(words[j], len(local)) for j in np.flatnonzero(own[:-1] == 0).tolist()]
                syms.append(own)
                learn.append(bool(batch.column(batch.num_columns - 2)[i].as_py()))
                size += len(own)
                if size >= BLOCK or i == batch.num_rows - 1:
                    yield block(batch.slice(begin, i + 1 - begin), learn, syms, tail, local)
                    begin, size, learn, syms, tail, local = i + 1, 0, [], [], [], {}
                    add = local.setdefault

    return run


ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_texts(df: DataFrame, training: F.Column, text: str = "text", keep: list[str] | None = None, rounds: int = ROUNDS, gain: float = GAIN) -> DataFrame:
    """The columns of ``keep`` (all of df's without it), n_tokens, n_known, train_tokens, base_score and score (log10), a row for each row of df.

    training: the rows to learn from (null: not). A null or empty text is its end token alone. Repeated rows all count and are all scored. Without any training
    row, counts are zero and every score is that of the base; an empty table gives an empty one. Columns of df by the added names are replaced; no other name
    clashes. A text of any length is worked on in bounded memory beside its tokens.
    """
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in ADDED]
    learn, body = unused(df, "learn_", "body_")
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce(training, F.lit(False)).alias(learn), F.col(f"`{text}`").cast("string").alias(body))
    fields = rows.schema.fields[:-2]

    counted = cut_table(count_words(rows.where(F.col(learn)).select(body)))
    known = Vocabulary.of(counted, rows.where(F.col(learn)).count())
    drop_table(counted)
    index = df.sparkSession.sparkContext.broadcast(known.index)
    kind = T.StructType([T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)] or [T.StructField("none", T.BooleanType())])
    table_of = T.StructType([T.StructField("docs", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("learn", T.ArrayType(T.BooleanType())), T.StructField("syms", T.BinaryType()), T.StructField("tail", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType()))])
    held = rows.toDF(*[f.name for f in kind.fields], learn, body) if fields else rows.select(F.lit(True).alias("none"), learn, body)
    coded = cut_table(held.mapInArrow(_coder(index), table_of).withColumn("block", F.monotonically_increasing_id()))

    old, model, _ = baum_welch(coded, known.kinds, rounds, gain) if known.c[0] else (Model.fresh(), Model.fresh(), [])
    if not known.c[0]:
        model.ratio[:] = 1
    words = _infrequent(coded, old)
    base = np.log10((known.c + 0.5) / known.below)
    there, total, below, most = known.c > 0, known.total, known.below, (1 << BITS) - 1

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row in left.select(["lengths", "syms", "tail", "others"]).to_pylist():  # one
            lengths, codes = np.array(row["lengths"], dtype=np.int64), np.frombuffer(row["syms"], dtype=np.uint16).astype(np.int64)
            others = codes > OWN
            codes[others] = SYMBOLS + np.frombuffer(row["tail"], dtype=np.int32)
            pos, n = right.column("pos").to_numpy(), np.zeros(row["others"], dtype=np.int64)
            n[pos] = right.column("n").to_numpy()
            grid = np.zeros((len(n), STATES))
            for s in range(STATES):
                grid[pos, s] = ((right.column(LONGS[s // A_LONG]).to_numpy() >> BITS * (s % A_LONG)) & most) / most
            grid *= (n / np.maximum(grid.sum(axis=1), 1e-9))[:, None]  # shares were rounded
            ratio = np.concatenate([model.ratio, ratios(grid, n, (n > 0).astype(float), model.share)])
            log, seen = np.concatenate([base, np.log10((n + 0.5) / below)]), np.concatenate([there, n > 0])
            text = np.repeat(np.arange(len(lengths)), lengths)
            sums = np.bincount(text, weights=log[codes], minlength=len(lengths))
            chain = likelihoods(Model(model.start, model.move, ratio, model.share), codes, lengths)
            made.append((lengths, np.bincount(text, weights=seen[codes], minlength=len(lengths)).astype(np.int64), np.full(len(lengths), total, dtype=np.int64), sums, sums + chain))
        docs = left.column("docs").combine_chunks().flatten()
        docs = [docs.field(i) for i in range(len(fields))]
        return pa.Table.from_arrays([*docs, *(pa.array(np.concatenate(x)) for x in zip(*made, strict=True))], names=[*(f.name for f in fields), *ADDED])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(c, T.LongType() if k < 3 else T.DoubleType()) for k, c in enumerate(ADDED)])
    slim = coded.select("block", "docs", "lengths", "syms", "tail", F.size("words").alias("others"))
    return slim.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(finish, schema)


def op9_language_model(spark, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32(doc_id as text) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1)
    return score_texts(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
