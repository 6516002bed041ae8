"""Chat formatting: transcripts parsed into turns by a hidden Markov model over lines, then rendered canonically.

A record is a turn or holds several. Each of its lines shows a speaker marker (if any) and a symbol of line features.
A line's state is the role that speaks and whether the line begins a turn; a record's first line begins one. Start and
step probabilities between roles and the features' emissions are counted over all records with a known role; what
markers say, how often a turn begins within a record, and whether after a blank line, are parameters, as records that
are cut at turns tell nothing of them. Viterbi decodes a conversation's lines; its beginnings cut records into turns.

Records are numbered in one order and cut into blocks of BLOCK numbers, whatever their turn numbers are; a block's
best scores from each state to each are a 6 x 6 matrix, so a conversation of any length is decoded block by block, and
only matrices meet in one place.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vestige.llm.common import staged, text_of, tidy
from vestige.operators.timeline import numbered

ROLES = ("system", "user", "assistant")
BLOCK = 512
# The words of speaker markers, by role.
_WORDS = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "a": 2}
_MARKER = re.compile(rf"\s*(?:#+ *|<\|?|\[)?({'|'.join(sorted(_WORDS, key=len, reverse=True))})\b *(?:\|?>|\]|:)", re.IGNORECASE | re.ASCII)
_LENGTHS = (1, 40, 120, 240, 480, 960)
FEATURES = (len(_LENGTHS) + 1) * 2 * 2
#: How often a line that begins a turn has its role's marker or another's, and a line within a turn any one; how often
#: a line within a record begins a turn.
OWN, OTHER, WITHIN, BEGINS = 0.5, 0.01, 0.002, 0.1
_NEVER = -1e18


def observed(text: str) -> list[tuple[int, int]]:
    """(marker, features) of each line; marker 3 is none. Features: length, a question, a blank line before."""
    out, blank = [], False
    for line in text.split("\n"):
        found = _MARKER.match(line)
        bare = line.strip()
        value = sum(len(bare) >= n for n in _LENGTHS)
        for flag in (bare.endswith("?"), blank):
            value = value * 2 + flag
        out.append((_WORDS[found[1].lower()] if found else 3, value))
        blank = not bare
    return out


def _records(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the place in the order of conversation, turn number (null last) and text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text_of().alias("text"))
    return staged(numbered(rows, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "text"], "n"))


class Hmm:
    """Log-probabilities; counts are smoothed by one, records of unknown roles don't count. States: the role for a
    line that begins a turn, 3 more for one within it."""

    def __init__(self, records: DataFrame):
        role = F.coalesce(*[F.when(F.col("role") == r, k) for k, r in enumerate(ROLES)])
        seen = records.select("conv_id", "n", "text", role.alias("r")).where("r is not null")

        def count(batches):
            total = np.zeros((6, FEATURES), np.int64)
            for b in batches:
                for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for k, (_, f) in enumerate(observed(text)):
                        total[r + 3 * (k > 0), f] += 1
            s, f = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(f, pa.int32()), pa.array(total[s, f])], ["s", "f", "c"])

        feature = np.ones((6, FEATURES))
        for row in seen.select("r", "text").mapInArrow(tidy(count), "s int, f int, c long").groupBy("s", "f").agg(F.sum("c").alias("c")).collect():
            feature[row.s, row.f] += row.c
        # Records are cut at turns, so none tells whether a turn's first line follows a blank one: it may as well.
        feature[:3] = feature[:3].reshape(3, -1, 2).mean(axis=2).repeat(2, axis=1)
        start, step = np.ones(3), np.ones((3, 3))
        first = records.groupBy("conv_id").agg(F.min("n").alias("n"))
        for row in seen.join(first, ["conv_id", "n"]).groupBy("r").count().collect():
            start[row.r] += row["count"]
        after = seen.select("conv_id", (F.col("n") - 1).alias("n"), F.col("r").alias("next"))
        for row in seen.select("conv_id", "n", "r").join(after, ["conv_id", "n"]).groupBy("r", "next").count().collect():
            step[row.r, row.next] += row["count"]
        norm = lambda m: np.log(m / m.sum(axis=-1, keepdims=True))
        self.set(norm(start), norm(step), norm(feature))

    def set(self, start: np.ndarray, step: np.ndarray, feature: np.ndarray) -> None:
        marker = np.full((6, 4), WITHIN)
        marker[:3] = OTHER
        marker[range(3), range(3)] = OWN
        marker[:, 3] = 1 - marker[:, :3].sum(axis=1)
        self.marker, self.feature = np.log(marker), feature
        self.start = np.concatenate((start, np.full(3, _NEVER)))
        roles = np.tile(step, (2, 1))  # from a role's either state
        self.to_record = np.hstack((roles, np.full((6, 3), _NEVER)))
        inside = np.full((6, 3), _NEVER)
        inside[range(6), np.arange(6) % 3] = np.log(1 - BEGINS)
        self.within = np.hstack((roles + np.log(BEGINS), inside))

    def steps(self, lines: list[tuple[bool, int, int]], begins: bool):
        """(transitions, emissions) of each line (first of its record, marker, features); begins: of a conversation."""
        for k, (first, marker, features) in enumerate(lines):
            move = np.broadcast_to(self.start, (6, 6)) if begins and k == 0 else self.to_record if first else self.within
            yield move, self.marker[:, marker] + self.feature[:, features]

    def matrix(self, lines: list, begins: bool) -> np.ndarray:
        """Best score of the lines' states after a state (row) and ending in a state (column)."""
        m = None
        for move, emit in self.steps(lines, begins):
            m = (move if m is None else (m[:, :, None] + move).max(axis=1)) + emit
        return m

    def path(self, lines: list, entry: np.ndarray | None, end: int | None) -> list[int]:
        """Best states given the scores of the states before (None: the lines begin the conversation) and the last."""
        score, back = np.zeros(6) if entry is None else entry, []
        for move, emit in self.steps(lines, entry is None):
            options = score[:, None] + move
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + emit
        out = [int(score.argmax()) if end is None else end]
        for b in reversed(back[1:]):
            out.append(int(b[out[-1]]))
        return out[::-1]


def rendered(role: str, lines: list[str]) -> str:
    """A turn between its marks. The speaker marker goes if it is this role's; marks within the text are escaped."""
    found = _MARKER.match(lines[0])
    if found and ROLES[_WORDS[found[1].lower()]] == role:
        lines = [lines[0][found.end() :], *lines[1:]]
    body = "\n".join(lines).strip().replace("<|", "<\\|")
    return f"<|{role}|>\n{body}\n<|end|>"


def formatted(turns: DataFrame) -> DataFrame:
    """One row per recovered turn: conv_id, turn (the record's number), part (from 0, within the record), role (not
    read but for training), rendered.

    Records are in the order of their number (null last), then text; repeated rows are records of their own. Null text
    counts as empty, which is a turn without text. Rows without conv_id are one conversation. Other columns aren't
    read."""
    records = _records(turns)
    hmm = Hmm(records)
    kind, id_type = turns.schema["conv_id"].dataType.simpleString(), to_arrow_type(turns.schema["conv_id"].dataType)
    blocks = records.withColumn("block", F.floor(F.col("n") / BLOCK))
    spans = blocks.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    long = staged(spans.where("first < last"))

    def lines_of(texts):
        return [(k == 0, *seen) for t in texts for k, seen in enumerate(observed(t))]

    def rows_of(batches, columns):
        return (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(columns))))

    def batch_of(rows, types, names):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def matrices(batches):
        out = []
        for conv, group in groupby(rows_of(batches, 5), key=lambda r: (r[0], r[1])):
            group = list(group)
            out.append((*conv, hmm.matrix(lines_of([r[3] for r in group]), group[0][4]).ravel().tolist()))
            if len(out) >= 1000:
                yield batch_of(out, (id_type, pa.int64(), pa.list_(pa.float64())), ["conv_id", "block", "m"])
                out = []
        if out:
            yield batch_of(out, (id_type, pa.int64(), pa.list_(pa.float64())), ["conv_id", "block", "m"])

    parts = blocks.alias("b").join(long.alias("l"), F.col("b.conv_id").eqNullSafe(F.col("l.conv_id"))).select("b.conv_id", "block", "n", "text", (F.col("block") == F.col("first")).alias("begins"))
    ms = parts.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "n").mapInArrow(tidy(matrices), f"conv_id {kind}, block long, m array<double>")

    def entries(batches):
        """Per block of a long conversation the scores on entry and the last line's state."""
        for conv, group in groupby(rows_of(batches, 3), key=lambda r: r[0]):
            before, ms_, numbers, score = [], [], [], None
            for _, block, m in group:
                m = np.array(m).reshape(6, 6)
                before.append(score)
                numbers.append(block)
                ms_.append(m)
                score = m.max(axis=0) if score is None else (score[:, None] + m).max(axis=0)
            ends = [int(score.argmax())]
            for entry, m in zip(reversed(before[1:]), reversed(ms_[1:])):
                ends.append(int((entry + m[:, ends[-1]]).argmax()))
            yield batch_of([(conv, k, None if e is None else e.tolist(), last) for k, e, last in zip(numbers, before, ends[::-1])], (id_type, pa.int64(), pa.list_(pa.float64()), pa.int32()), ["conv_id", "block", "entry", "last"])

    entered = staged(ms.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(tidy(entries), f"conv_id {kind}, block long, entry array<double>, last int"))

    def decode(batches):
        out = []
        types, names = (id_type, pa.int64(), pa.int32(), pa.string(), pa.string()), ["conv_id", "turn", "part", "role", "rendered"]
        for _, group in groupby(rows_of(batches, 7), key=lambda r: (r[0], r[1])):
            group = list(group)
            entry, last = group[0][5], group[0][6]
            states = iter(hmm.path(lines_of([r[4] for r in group]), None if entry is None else np.array(entry), last))
            for conv, _, turn, _, text, _, _ in group:
                found: list[tuple[str, list[str]]] = []
                for line in text.split("\n"):
                    state = next(states)
                    if state < 3:
                        found.append((ROLES[state], []))
                    found[-1][1].append(line)
                out += [(conv, turn, part, role, rendered(role, lines)) for part, (role, lines) in enumerate(found)]
            if len(out) >= 2000:
                yield batch_of(out, types, names)
                out = []
        if out:
            yield batch_of(out, types, names)

    ready = blocks.alias("b").join(entered.alias("e"), F.col("b.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("b.block") == F.col("e.block")), "left").select("b.conv_id", "b.block", "turn", "n", "text", "entry", "last")
    ready = ready.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "n")
    return ready.mapInArrow(tidy(decode), f"conv_id {kind}, turn long, part int, role string, rendered string")
