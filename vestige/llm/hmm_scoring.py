"""Scoring by a hidden Markov language model.

A text is a sequence of words and an end. Each word has a symbol: frequent words their own, the others share one by
their last letters and their length. A latent state follows the state before and emits a symbol; a word that shares
its symbol then has its (smoothed) part of that symbol's count in the training texts. So the model has a probability
for every word, the latent states learn from a bounded alphabet, and the vocabulary, which grows with the corpus, stays
a distributed table.

Baum-Welch: each task runs the scaled forward and backward recursions over its texts and sends expected counts by
symbol and state; their sum over all tasks gives the next model. The first rounds, which only break the symmetry, see
a bounded sample; all later ones see every training text. A text's score is the forward recursion's exact likelihood
of its whole sequence.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import mix, most_frequent, staged, text_of, tidy

#: What the counts of all words are raised by; an unseen word counts as one more word.
RAISED = 0.1
#: Words with symbols of their own; symbols that the others share; words whose counts every task has at hand.
OWN, SHARED, AT_HAND = 1 << 14, 1 << 10, 1 << 16
SYMBOLS = 1 + OWN + SHARED  # the end is symbol 0
STATES = 16
#: Training texts that the first rounds see at most, those rounds, and the rounds over all training texts.
FIRST_TEXTS, FIRST_ROUNDS, ROUNDS = 2000, 12, 3
#: Counts that the prior adds to each state's emissions (by the symbols' shares of the corpus) and transitions.
PRIOR, MOVES = 200.0, 10.0
#: In training, longer texts count as several sequences of so many tokens (scores are of whole texts); tokens of a
#: group whose recursions run beside each other, and the most that run so.
LONGEST, GROUP, LANES = 1 << 14, 1 << 19, 512
_PART = 1 << 16  # cells that are looked at together
#: No word has a space, so this is none.
END = " "


def lists_of_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words): runs of characters other than `[\\x20\\x09-\\x0D]`, A-Z lower-cased."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    there = pc.not_equal(words, "")
    sums = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths], words.filter(there)


def parts_of(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about `size` bytes, null as empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + size, "right")))
        yield at, texts[at:to]
        at = to


def held_out(doc_id: str = "doc_id"):
    """Whether a row isn't learnt from: one in ten, by its id; and rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens of the training texts, the end among them."""

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"word": [END], "c": pa.array([b.num_rows], pa.int64())})
            for _, texts in parts_of(b.column(0)):
                counted = pc.value_counts(lists_of_words(texts)[1])
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "c"])

    return docs.where(~held_out()).select("text").mapInArrow(tidy(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def shared_symbols(words: pa.Array) -> np.ndarray:
    """The symbols of words without one of their own: by their last three letters and whether they have at most three,
    six or more."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    tails = pc.dictionary_encode(pc.utf8_slice_codeunits(words, -3, None))
    codes = [int.from_bytes(t.encode("utf-8", "surrogatepass")[-8:].ljust(8, b"\0"), "little") for t in tails.dictionary.to_pylist()]
    of_tail = mix(np.array(codes, np.uint64) + np.uint64(1))
    length = np.searchsorted([4, 7], lengths, "right").astype(np.uint64)
    return 1 + OWN + (mix(of_tail[tails.indices.to_numpy(zero_copy_only=False)] + length) % np.uint64(SHARED)).astype(np.int64)


class Known:
    """The most frequent words with their counts: the first OWN of them have symbols of their own."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, np.array([0, *counts], np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count) of each word; the count is 0 if the word isn't at hand."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        distinct = pc.dictionary_encode(words)
        place = pc.fill_null(pc.index_in(distinct.dictionary, value_set=pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        symbols = np.where((place > 0) & (place <= OWN), place, shared_symbols(distinct.dictionary))
        at = distinct.indices.to_numpy(zero_copy_only=False)
        return symbols[at], self.counts[place][at]


def sequences(docs: DataFrame, known: Known, log_total: float, end_count: int) -> DataFrame:
    """(row, doc_id, held_out, symbols, n_known, base, inner, words, times): a text's symbols with the end, and of
    the end and the words at hand the number known, the base score and log10 of their parts in shared symbols' counts
    (less the symbols' own); the other distinct words and how often each stands there."""
    own = known

    def each(batches):
        for b in batches:
            for at, texts in parts_of(b.column(3)):
                lengths, words = lists_of_words(texts)
                symbols, counts = own.look_up(words)
                texts_n, owner = len(texts), np.repeat(np.arange(len(texts)), lengths)
                at_hand = counts > 0
                logs = np.log10(np.where(at_hand, counts, 1) + RAISED)
                sums = lambda w, keep: np.bincount(owner[keep], w[keep], minlength=texts_n).astype(float)  # noqa: E731, B023
                n_known = np.bincount(owner[at_hand], minlength=texts_n) + (end_count > 0)
                base = sums(logs - log_total, at_hand) + np.log10(end_count + RAISED) - log_total
                inner = sums(logs, at_hand & (symbols > OWN))
                # The end closes each sequence.
                ends = np.cumsum(lengths + 1)
                whole = np.zeros(int(ends[-1]), np.int32)
                places = np.arange(len(symbols)) + owner
                whole[places] = symbols
                rest = np.flatnonzero(~at_hand)
                rare = pc.dictionary_encode(words.take(pa.array(rest)))
                code = rare.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, times = np.unique(owner[rest] * max(1, len(rare.dictionary)) + code, return_counts=True)
                of_text, code = np.divmod(pairs, max(1, len(rare.dictionary)))
                bounds = pa.array(np.searchsorted(of_text, np.arange(texts_n + 1)), pa.int32())
                first = b.slice(at, texts_n)
                yield pa.RecordBatch.from_arrays(
                    [
                        first.column(0), first.column(1), first.column(2), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(whole)), pa.array(n_known), pa.array(base), pa.array(inner),
                        pa.ListArray.from_arrays(bounds, rare.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
                    ],
                    ["row", "doc_id", "held_out", "symbols", "n_known", "base", "inner", "words", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(tidy(each), f"row long, doc_id {kind}, held_out boolean, symbols array<int>, n_known long, base double, inner double, words array<string>, times array<int>")


# ---------------------------------------------------------------- recursions

#: First states, transitions, emissions by symbol and state.
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def laid_out(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane, first step) of sequences that follow each other in lanes of about the same length, the longest first."""
    lanes = int(min(lanes, max(1, lengths.sum() // lengths.max())))
    heap, lane, first = [(0, k) for k in range(lanes)], np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        lane[i], first[i] = heap[0][1], heap[0][0]
        heapq.heapreplace(heap, (int(first[i] + lengths[i]), int(lane[i])))
    place = np.empty(lanes, np.int64)
    place[[k for _, k in sorted(heap, reverse=True)]] = np.arange(lanes)
    return place[lane], first


class Lanes:
    """A group of sequences in lanes: step t holds one token of each lane that is as long. Those lead, as lanes are
    sorted by length."""

    def __init__(self, model: Model, symbols: np.ndarray, lengths: np.ndarray, kind: type):
        self.first, self.moves, self.table = (m.astype(kind) for m in model)
        lane, first = laid_out(lengths, LANES)
        self.lanes, self.steps = int(lane.max()) + 1, int((first + lengths).max())
        self.begins, self.tokens = np.cumsum(lengths) - lengths, symbols
        self.cell = (np.repeat(first, lengths) + np.arange(len(symbols)) - np.repeat(self.begins, lengths)) * self.lanes + np.repeat(lane, lengths)
        self.symbols = np.zeros(self.steps * self.lanes, np.int32)
        self.symbols[self.cell] = symbols
        self.symbols = self.symbols.reshape(self.steps, self.lanes)
        self.starts, self.ends = first * self.lanes + lane, (first + lengths - 1) * self.lanes + lane
        self.active, self.window = np.bincount(self.cell // self.lanes, minlength=self.steps), max(1, _PART // self.lanes)

    def _at(self, cells: np.ndarray) -> list[np.ndarray | None]:
        """By step, the lanes of these cells."""
        cells = np.sort(cells)
        bounds = np.searchsorted(cells // self.lanes, np.arange(self.steps + 1)).tolist()
        lanes = cells % self.lanes
        return [lanes[a:b] if a < b else None for a, b in zip(bounds, bounds[1:])]

    def _emitted(self, begin: int, end: int) -> np.ndarray:
        return self.table[self.symbols[begin:end]]

    def _forward(self, alpha: np.ndarray | None = None) -> np.ndarray:
        """The scales of all cells; alpha gets the states' probabilities after each step."""
        state, scales = np.tile(self.first, (self.lanes, 1)), np.ones((self.steps, self.lanes, 1), self.first.dtype)
        for t, (n, begun) in enumerate(zip(self.active.tolist(), self._at(self.starts))):
            if t % self.window == 0:
                emitted = self._emitted(t, t + self.window)
            state = state[:n] @ self.moves
            if begun is not None:
                state[begun] = self.first
            state *= emitted[t % self.window, :n]
            scale = np.add.reduce(state, axis=1, keepdims=True, out=scales[t, :n])
            state /= scale
            if alpha is not None:
                alpha[t, :n] = state
        return scales

    def likelihoods(self) -> np.ndarray:
        """log10 of each sequence's probability; memory doesn't follow a sequence's length but for its scales."""
        return np.add.reduceat(np.log10(self._forward()).reshape(-1)[self.cell], self.begins)

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, transitions, and emissions by symbol and state. The way back goes by
        windows of steps, whose transitions are added up at once."""
        states, back = len(self.first), np.ascontiguousarray(self.moves.T)
        alpha = np.zeros((self.steps, self.lanes, states), self.first.dtype)  # in the end times what follows
        scales, begun, over, active = self._forward(alpha), self._at(self.starts), self._at(self.ends), self.active.tolist()
        beta, moves = np.ones((self.lanes, states), self.first.dtype), np.zeros((states, states))
        for low in range((self.steps - 1) // self.window * self.window, -1, -self.window):
            used = self._emitted(low, low + self.window)
            used /= scales[low : low + self.window]
            after = np.zeros_like(used)
            for k in range(len(used) - 1, -1, -1):
                n = active[low + k]
                if over[low + k] is not None:
                    beta[over[low + k]] = 1
                after[k, :n] = beta[:n]
                used[k] *= after[k]
                np.matmul(used[k, :n], back, out=beta[:n])
                if begun[low + k] is not None:
                    used[k, begun[low + k]] = 0
            before, first = alpha[max(0, low - 1) : low + len(used) - 1], int(low == 0)
            moves += before.reshape(-1, states).T @ used[first:].reshape(-1, states)
            alpha[low : low + self.window] *= after
        gamma, emissions = alpha.reshape(-1, states), np.zeros((states, len(self.table)))
        for at in range(0, len(self.cell), _PART):
            tokens, rows = self.tokens[at : at + _PART], gamma[self.cell[at : at + _PART]].T
            for counts, weights in zip(emissions, rows, strict=True):
                counts += np.bincount(tokens, weights, len(self.table))
        return gamma[self.starts].sum(axis=0), self.moves * moves, emissions.T


def grouped(symbols: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of sequences, by length, in groups of about GROUP tokens."""
    lengths = np.array([len(x) for x in symbols], np.int64)
    order = np.argsort(lengths, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(np.cumsum(lengths[order]) // GROUP)) + 1) if len(order) else ()


def buffered(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 * GROUP) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Runs of rows, and their sequences in this column, of about `size` tokens."""
    held, rows, tokens = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows.append(part)
            flat, lengths = part.column(column).flatten().to_numpy(zero_copy_only=False), pc.list_value_length(part.column(column)).to_numpy(zero_copy_only=False)
            held += np.split(flat, np.cumsum(lengths)[:-1])
            tokens += len(flat)
            if tokens >= size:
                yield pa.Table.from_batches(rows), held
                held, rows, tokens = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), held


def expected_counts(sequences_: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all tasks of the expected counts; a task sends a row for each symbol that it has seen."""
    states = len(model[0])

    def each(batches):
        first, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS, states))
        for _, held in buffered(batches, 0):
            pieces = [x[at : at + LONGEST] for x in held for at in range(0, len(x), LONGEST)]
            for group in grouped(pieces):
                own = [pieces[i] for i in group]
                new = Lanes(model, np.concatenate(own), np.array([len(x) for x in own], np.int64), np.float32).expected()
                first, moves, emissions = first + new[0], moves + new[1], emissions + new[2]
        seen = np.flatnonzero(emissions.any(axis=1))
        rows, keys = np.vstack((emissions[seen], moves, first[None])), np.concatenate((seen, -1 - np.arange(states + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(rows[:, s], pa.float32()) for s in range(states)]], ["key", *[f"s{s}" for s in range(states)]])

    parts = sequences_.select("symbols").mapInArrow(tidy(each), "key int, " + ", ".join(f"s{s} float" for s in range(states)))
    table = np.zeros((SYMBOLS + states + 1, states))
    for r in parts.groupBy("key").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).collect():
        table[r.key] = r[1:]  # negative keys count from the end
    return table[-1 - states], table[-1 : -1 - states : -1], table[:SYMBOLS]


def maximised(counts: tuple[np.ndarray, np.ndarray, np.ndarray], shares: np.ndarray) -> Model:
    """The model of these counts under the prior."""
    first, moves, emissions = counts
    states = len(first)
    first = (first + 1) / (first + 1).sum()
    moves = moves + MOVES * (0.5 * np.eye(states) + 0.5 / states)
    emissions = emissions + PRIOR * shares[:, None]
    return first, moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0)


def initial(shares: np.ndarray, states: int, seed: int = 5) -> Model:
    drawn = shares[:, None] * np.random.default_rng(seed).gamma(1.0, size=(SYMBOLS, states))
    return np.full(states, 1 / states), 0.8 * np.eye(states) + 0.2 / states, drawn / drawn.sum(axis=0)


class Scorer:
    """Fitted on the training rows of docs, which it then scores with the others.

    Null text counts as empty: its only token is the end. Rows of one doc_id are texts of their own; rows without
    doc_id are scored, but not learnt from. Without training rows every model is the smoothing alone. Columns other
    than doc_id and text aren't read."""

    def __init__(self, docs: DataFrame, states: int = STATES, first_rounds: int = FIRST_ROUNDS, rounds: int = ROUNDS):
        self.vocabulary = staged(vocabulary(docs))
        counted = self.vocabulary.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.col("word") == END, F.col("c")))).first()
        self.tokens, distinct, self.end_count = counted[0] or 0, counted[1], counted[2] or 0
        self.log_total = float(np.log10(self.tokens + RAISED * (distinct + 1)))
        # Long words aren't at hand, so that the list's size has a bound.
        short = self.vocabulary.where((F.col("word") != END) & (F.length("word") <= 64))
        top = sorted(most_frequent(short, "c", AT_HAND), key=lambda r: (-r.c, r.word))
        self.known = Known([r.word for r in top], [r.c for r in top])
        self.sums = self._symbol_sums()
        self.sequences = staged(sequences(docs, self.known, self.log_total, self.end_count))
        learnt = self.sequences.where("not held_out").select("symbols")
        shares = self.sums / self.sums.sum()
        model = initial(shares, states)
        # Twice as many as wanted pass the first test, so that tasks send few rows to the second.
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
        likely = self.sequences.where("not held_out").where(drawn <= min(1.0, 2 * FIRST_TEXTS / max(1, self.end_count)) * (1 << 40))
        chosen = likely.select("row", drawn.alias("drawn")).orderBy("drawn", "row").limit(FIRST_TEXTS).select("row")
        some = staged(self.sequences.join(F.broadcast(chosen), "row", "left_semi").select("symbols").repartition(8))
        for data, n in ((some, first_rounds), (learnt, rounds)):
            for _ in range(n if self.tokens else 0):
                model = maximised(expected_counts(data, model), shares)
        self.model = model

    def _symbol_sums(self) -> np.ndarray:
        """Raised counts by symbol: of the end and the words with symbols of their own, and of the others' symbols,
        where an unseen word has its place too."""
        own = self.known.words[:OWN]
        out = np.zeros(SYMBOLS)
        out[0] = self.end_count + RAISED
        out[1 : 1 + len(own)] = self.known.counts[1 : 1 + len(own)] + RAISED
        out[1 + OWN :] = RAISED

        def each(batches):
            for b in batches:
                others = b.filter(pc.invert(pc.is_in(b.column(0), value_set=pa.array([*own, END], pa.string()))))
                yield pa.RecordBatch.from_arrays([pa.array(shared_symbols(others.column(0)), pa.int32()), others.column(1)], ["symbol", "c"])

        for r in self.vocabulary.mapInArrow(tidy(each), "symbol int, c long").groupBy("symbol").agg((F.sum("c") + RAISED * F.count(F.lit(1))).alias("c")).collect():
            out[r.symbol] += r.c
        return out

    def scored(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
        model, log_total = self.model, self.log_total
        # What a shared symbol's tokens lose to the other words of their symbol.
        parts = np.where(np.arange(SYMBOLS) > OWN, np.log10(self.sums + (self.sums == 0)), 0.0)

        def each(batches):
            for rows, held in buffered(batches, 3):
                score = np.empty(len(held))
                for group in grouped(held):
                    own, lengths = np.concatenate([held[i] for i in group]), np.array([len(held[i]) for i in group], np.int64)
                    score[group] = Lanes(model, own, lengths, np.float64).likelihoods() - np.add.reduceat(parts[own], np.cumsum(lengths) - lengths)
                score += rows.column(6).to_numpy()
                n = pa.array([len(x) for x in held], pa.int64())
                yield from pa.Table.from_arrays([*rows.columns[:3], n, *rows.columns[4:6], pa.array(score)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]).combine_chunks().to_batches()

        kind = self.sequences.schema["doc_id"].dataType.simpleString()
        of = self.sequences.select("row", "doc_id", "held_out", "symbols", "n_known", "base", "inner").mapInArrow(tidy(each), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
        rare = self.sequences.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
        seen = rare.join(self.vocabulary.select(F.col("word").alias("words"), "c"), "words", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
        sums = seen.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + RAISED)).alias("logs"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        return of.join(sums, "row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + zero("more_known")).alias("n_known"),
            F.lit(self.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + zero("logs") - zero("more") * log_total).alias("base_score"),
            (F.col("score") + zero("logs")).alias("score"),
        )
