"""Secret scans: patterns for known forms, character Markov models for the rest.

Two first-order Markov models over characters, of random strings and of ordinary identifiers, are trained from
labelled samples; a token whose log-likelihood ratio between them exceeds MARGIN nats a character and NATS in all is
a secret.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import text_of, tidy

KINDS = ("assign", "access", "hex", "random")
# The base patterns and least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: From this length on the models judge every token, whatever it is made of.
LEAST = 12
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_AT = {c: i for i, c in enumerate(_ALPHABET)}
MARGIN = 0.5
#: What tokens of under 20 characters must reach in all.
NATS = 10
#: Ordinary words that the identifiers are made of, at most.
WORDS = 20_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind."""
    spans = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


class Markov:
    """Log-probabilities of a character after another, smoothed by one half."""

    def __init__(self, samples: Iterable[str]):
        counts = np.full((len(_ALPHABET) + 1, len(_ALPHABET)), 0.5)
        for s in samples:
            at = len(_ALPHABET)
            for c in s:
                if (i := _AT.get(c)) is not None:
                    counts[at, i] += 1
                    at = i
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    def score(self, s: str) -> float:
        at = np.array([len(_ALPHABET), *(_AT[c] for c in s)])
        return float(self.log[at[:-1], at[1:]].sum())


def random_strings(n: int = 4000, seed: int = 11) -> list[str]:
    """The positive samples: keys of the common alphabets."""
    rng = random.Random(seed)
    alphabets = [_ALPHABET[:62], _ALPHABET[:64], "0123456789abcdef", _ALPHABET[:26] + _ALPHABET[52:62], _ALPHABET[26:62]]
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(20, 48))) for k in range(n)]


def identifiers(words: list[str], n: int = 20_000, seed: int = 12) -> list[str]:
    """The negative samples: words joined as snake, kebab, camel and constant names, with numbers and dates; and rules
    and table borders, as the models judge tokens without a letter or digit too."""
    rng, out = random.Random(seed), []
    words = [w for w in words if w and all(c in _AT for c in w)] or ["value", "index", "count", "name"]
    for k in range(n):
        some = rng.choices(words, k=rng.randint(1, 5))
        number = str(rng.choice((rng.randint(0, 99), rng.randint(1990, 2030))))
        out.append(("_".join(some), "-".join(some), "".join(w.title() for w in some), "_".join(some).upper(), "/".join(some) + "/" + number, "-".join((number, f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}", *some)))[k % 6])
    for k in range(n // 20):
        line = "-=_+/"[k % 5] * rng.randint(3, 40)
        out.append(line if k % 3 else "+".join(("", line, line, "")))
    return out


class Models:
    def __init__(self, random_samples: Iterable[str], ordinary: Iterable[str]):
        self.random, self.ordinary = Markov(random_samples), Markov(ordinary)

    def ratio(self, token: str) -> float:
        """Nats a character in favour of a random string."""
        return (self.random.score(token) - self.ordinary.score(token)) / len(token)

    def is_random(self, token: str) -> bool:
        return self.ratio(token) > max(MARGIN, NATS / len(token))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans: the base ones and whole tokens not within one of them that the models call random."""
        base = base_spans(text)
        added = []
        for m in _TOKEN.finditer(text):
            if not any(a <= m.start() and m.end() <= b for a, b, _ in base) and self.is_random(m[0]):
                added.append((m.start(), m.end(), "random"))
        return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


def train(docs: DataFrame, labels: DataFrame) -> Models:
    """Models whose ordinary identifiers come from at most WORDS words of documents labelled good (at most 1,000,
    chosen by a hash of their ids)."""
    chosen = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(1000)
    words = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,14}"), 0)).alias("w")).distinct()
    return Models(random_strings(), identifiers(sorted(r.w for r in words.orderBy(F.xxhash64("w"), "w").limit(WORDS).collect())))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row. Null text counts as empty, which has no
    span and the digest of the empty string."""

    def each(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                spans = models.spans(text)
                base = [s for s in spans if s[2] != "random"]
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(tidy(each), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, models: Models) -> DataFrame:
    """docs with each secret in text replaced by `[secret]` and n_chars, where there is one, counted anew."""
    names = docs.columns
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        if not text or not (spans := models.spans(text)):
            return text
        out, at = [], 0
        for a, b, _ in spans:
            if b > at:
                out += [text[at:a], "[secret]"] if a >= at else []
                at = b
        return "".join(out) + text[at:]

    def each(batches):
        for b in batches:
            columns = list(b.columns)
            texts = [clean(t) for t in b.column(names.index("text")).to_pylist()]
            columns[names.index("text")] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(t or "") for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tidy(each), schema)
