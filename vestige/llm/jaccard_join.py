"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its word shingles (tokens). Tokens stand in one order for all documents: rare ones by
hash, then the frequent ones, rarest first. Two sets of similarity THRESHOLD/100 or more share a token in their
first n - o + 1 tokens, o being the overlap that they need; if the prefix grows by k - 1 tokens for each class of
frequent tokens in it, they share a rare token or k frequent ones of a class. So rare prefix tokens are indexed
singly, frequent ones as pairs within their class and very frequent ones as triples; classes number with the set's
size, so that a prefix has a few keys a token. Each entry says how many of the set's tokens count from its key on:
a pair whose needed overlap exceeds that on either side meets by another key or not at all, so it isn't formed.
Every candidate is verified on the whole sets.

The sets are what is joined: a set's copies are one member of the lists, whatever rows hold it, and only then do rows
find the component of their set. Rows that share a doc_id tie their sets together.

Within an index list the member with the shortest prefix, nearest to what the list's members have in common, leads:
it is compared with the other members. After that only members of different components meet, with more leaders a
list in each round, until no list has two components or the pairs left are few for the number of entries. So a group
of copies costs a number of comparisons in proportion to its size, and every link that could join two components is
looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestige.llm.common import grouped_words, mix, most_frequent, shingles, staged, text_of, tidy
from vestige.operators.staging import dropped, table_in_shared_folder

THRESHOLD = 75
#: Frequent tokens: at most so many, in no fewer documents than this. Summaries name all that are in more than
#: 2 / (FREQUENT + 1) of the corpus's tokens.
FREQUENT, LEAST = 1 << 16, 32
#: Frequent tokens in this many documents are combined by threes, the others by twos; sets under SMALL tokens have too
#: few tokens for threes.
VERY, SMALL = 1 << 12, 16
#: Tokens of a set for each class of frequent ones, by the size of combinations.
A_CLASS = {2: 32, 3: 16}
#: Leaders a list grow by this factor in each round; the pairs that remain are all formed once they number at most
#: FEW for each entry of the index.
MORE, FEW = 8, 2
_SEEN = 50_000


def _token_sets(texts: list[str] | pa.Array):
    """The set of each text; an Arrow column's texts become Python's some at a time."""
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        for _, words in grouped_words(part if isinstance(part, list) else part.to_pylist(), fold=True):
            yield from map(shingles, words)


def set_id(tokens: np.ndarray) -> int:
    """64 bits of a set, as a signed integer: its shingles are told apart by as many."""
    return int(mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).astype(np.int64)[0])


def _merge_counts(tokens: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A Misra-Gries summary of at most `most` tokens out of counts of more."""
    tokens, at = np.unique(tokens, return_inverse=True)
    counts = np.bincount(at, weights=counts).astype(np.int64)
    if len(tokens) > most:
        counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        tokens, counts = tokens[counts > 0], counts[counts > 0]
    return tokens, counts


def _described(docs: DataFrame) -> DataFrame:
    """Rows of documents (kind 0: doc_id, n and the set's id) and of each task's frequent tokens (kind 1: id, n)."""

    def describe(batches):
        kept, held, size = (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0
        for b in batches:
            n, ids = [], []
            for tokens in _token_sets(b.column(1)):
                n.append(len(tokens))
                ids.append(set_id(tokens))
                held.append(tokens)
                size += len(tokens)
                if size > 1 << 20:
                    new = np.concatenate(held)
                    kept, held, size = _merge_counts(np.concatenate((kept[0], new)), np.concatenate((kept[1], np.ones(len(new), np.int64))), FREQUENT), [], 0
            yield _rows(np.zeros(len(n), np.int8), b.column(0), n, ids)
        if held:
            new = np.concatenate(held)
            kept = _merge_counts(np.concatenate((kept[0], new)), np.concatenate((kept[1], np.ones(len(new), np.int64))), FREQUENT)
        often = kept[1] > 1
        k = int(often.sum())
        yield _rows(np.ones(k, np.int8), pa.nulls(k, pa.int64()), kept[1][often], kept[0][often].astype(np.int64))

    def _rows(kind, doc_ids, n, ids):
        return pa.RecordBatch.from_arrays([pa.array(kind), doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.int64())], ["kind", "doc_id", "n", "id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(tidy(describe), "kind byte, doc_id long, n long, id long")


_LEVELS = [1]
while _LEVELS[-1] < 1 << 40:
    _LEVELS.append(_LEVELS[-1] * 100 // THRESHOLD + 1)
_LEVELS = np.array(_LEVELS)


@lru_cache(1024)
def _choices(n: int, k: int) -> np.ndarray:
    """Columns of k places out of n."""
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k).T


def signatures(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of sorted tokens; for each, how many tokens count from it on. frequent: sorted tokens; place: each
    one's place in their order; size: of its combinations.

    A key counts for an overlap o if its last token lies in the shortest prefix that, less k - 1 tokens of each
    class, has n - o + 1 tokens. Linked sets' sizes lie in one level or in neighbouring ones, and both emit the keys
    of the upper one. A set of one token links with its copies alone and has no keys."""
    n = len(tokens)
    beyond = n - (THRESHOLD * n + 99) // 100  # tokens that may be missing from another set
    if n < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
    else:
        often = np.zeros(n, bool)
    n_rare = n - int(often.sum())
    if n_rare > beyond:
        return tokens[~often][: beyond + 1], n - np.arange(beyond + 1)
    order = np.argsort(place[at[often]])
    ordered, by = np.concatenate((tokens[~often], tokens[often][order])), size[at[often]][order]
    keys, left = [ordered[:n_rare]], [n - np.arange(n_rare)]
    level = int(np.searchsorted(_LEVELS, n, "right")) - 1
    schemes = {(max(1, low // A_CLASS[2]), max(1, low // A_CLASS[3]), low >= SMALL) for low in _LEVELS[level : level + 2].tolist()}
    for twos, threes, large in schemes:
        by_ = by if large else np.full(n - n_rare, 2)
        classes = np.where(by_ == 2, twos, threes).astype(np.uint64)
        own = ((ordered[n_rare:] >> np.uint64(7)) % classes).astype(np.int64) * 4 + by_
        # The first k - 1 tokens of a class don't count towards the prefix.
        rank = np.argsort(own, kind="stable")
        begins = np.concatenate(([True], own[rank][1:] != own[rank][:-1]))
        nth = np.empty(n - n_rare, np.int64)
        nth[rank] = np.arange(n - n_rare) - np.maximum.accumulate(np.where(begins, np.arange(n - n_rare), 0))
        free = np.concatenate((np.arange(n_rare), np.arange(n_rare, n) - np.cumsum(nth < by_ - 1)))
        prefix = int(np.argmax(free >= beyond)) + 1 if free[-1] >= beyond else n
        needs = np.concatenate(([0], free[:-1] + 1))  # tokens that may be missing before this one counts
        head = own[: max(0, prefix - n_rare)]
        for c in np.unique(head).tolist():
            members = np.flatnonzero(head == c) + n_rare
            k = c % 4
            if len(members) < k:
                continue
            members = members[np.argsort(ordered[members])]
            chosen = members[_choices(len(members), k)]
            key = np.full(chosen.shape[1], twos * 8 + k + 4 * large, np.uint64)
            for token in ordered[chosen]:
                key = mix(key * np.uint64(3) + token)
            keys.append(key)
            left.append(n - needs[chosen.max(axis=0)])
    return np.concatenate(keys), np.concatenate(left)


def _index(texts: DataFrame, frequent: np.ndarray, place: np.ndarray, size: np.ndarray) -> DataFrame:
    """(sig, id, n, left) of the texts' sets; a task indexes the copies of a set that it has indexed not again."""

    def flush(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(columns, (np.int64, np.int64, np.int32, np.int32), strict=True)], ["sig", "id", "n", "left"])

    def index(batches):
        seen: set[int] = set()
        for b in batches:
            rows = [], [], [], []
            for tokens in _token_sets(b.column(0)):
                if len(tokens) == 0 or (own := set_id(tokens)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(own)
                keys, left = signatures(tokens, frequent, place, size)
                for kept, new in zip(rows, (keys, np.full(len(keys), own), np.full(len(keys), len(tokens)), left), strict=True):
                    kept.append(new)
                if len(rows[0]) >= 1000:
                    yield flush(*rows)
                    rows = [], [], [], []
            if rows[0]:
                yield flush(*rows)

    return texts.select("text").mapInArrow(tidy(index), "sig long, id long, n int, left int")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' similarity reaches the threshold."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= THRESHOLD * (len(both) - shared)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def verify(batches):
        cache: OrderedDict[str, np.ndarray] = OrderedDict()

        def tokens(text: str) -> np.ndarray:
            if (got := cache.get(text)) is None:
                cache[text] = got = next(_token_sets([text]))
                if len(cache) > 64:
                    cache.popitem(last=False)
            else:
                cache.move_to_end(text)
            return got

        for b in batches:
            ok = [linked(tokens(x.as_py()), tokens(y.as_py())) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(verify), "a long, b long")


#: Tokens of a set for each cell of its sketch, and the least number of cells.
A_CELL, CELLS = 4, 128


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each cell, a byte each; a power of two of cells, so that halves of a longer sketch
    add up to a shorter one. Empty if a cell has too many for its byte."""
    size = max(CELLS, 1 << max(0, len(tokens) // A_CELL - 1).bit_length())
    cells = np.bincount(((tokens >> np.uint64(20)) % np.uint64(size)).astype(np.int64), minlength=size)
    return cells.astype(np.uint8).tobytes() if cells.max(initial=0) < 256 else b""


def most_shared(a: bytes, b: bytes) -> int:
    """A bound of how many tokens two sketched sets share: no more in a cell than either has there."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int32) for c in (a, b))
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, size).sum(axis=0), y.reshape(-1, size).sum(axis=0)).sum())


def _involved(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, cells, text) of each set in ids: one of its texts, and its sketch."""

    def each(batches):
        seen: set[int] = set()
        for b in batches:
            at, rows = [], []
            for k, tokens in enumerate(_token_sets(b.column(0))):
                if len(tokens) and (own := set_id(tokens)) not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(own)
                    at.append(k)
                    rows.append((own, len(tokens), sketch(tokens)))
            own, n, cells = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64()), pa.array(cells, pa.binary()), b.column(0).take(pa.array(at, pa.int64()))], ["id", "n", "cells", "text"])

    found = texts.select("text").mapInArrow(tidy(each), "id long, n long, cells binary, text string")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that can link by their sketches. So few pairs remain for which whole texts move."""

    def bound(batches):
        for b in batches:
            na, nb = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            most = np.array([most_shared(x, y) if x and y else min(n, m) for n, x, m, y in zip(na, b.column(3).to_pylist(), nb, b.column(5).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(100 * most >= THRESHOLD * (na + nb - most)))

    of = lambda side: sketches.select(F.col("id").alias(side), F.col("n").alias("n" + side), F.col("cells").alias("c" + side))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "ca", "nb", "cb").mapInArrow(tidy(bound), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): each node's smallest reachable one, by least neighbouring labels and pointer jumping. Every
    round is a table in the shared folder."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = staged(labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), (F.col("near") < F.col("comp")).alias("moved")))
        if not lower.where("moved").limit(1).count():
            return labels
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("jumped"))
        labels = staged(lower.join(jump, "comp").select("node", F.col("jumped").alias("comp")))


def _lists(index: DataFrame) -> DataFrame:
    """(sig, id, n, left), written: the index's lists of two members or more; a set's copies are one member. Any list
    may hold any share of the sets, so lists are counted by partial sums and joined, which splits a hot one. The whole
    index, most of whose lists have one member, goes once the others are written."""
    written: list[str] = []
    members = table_in_shared_folder(index.groupBy("sig", "id", "n").agg(F.max("left").alias("left")), written)
    several = members.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = staged(members.join(several, "sig").select("sig", "id", "n", "left"))
    for path in written:
        dropped(index.sparkSession, path)
    return lists


#: SQL: whether sets of n and m tokens, of which `left` and `its` count from a shared key on, can link by it.
_MEETS = f"{100 + THRESHOLD} * least(left, its) >= {THRESHOLD} * (n + m)"


def _joined_components(lists: DataFrame, texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(id, comp) of the members that link with others. lists: what _lists() gives; names: what belongs together
    without a link, likewise."""
    spark, sketches, leaders, tried = lists.sparkSession, texts.select("id", "n", "cells"), 1, None
    entries = lists.count()
    while True:
        if names is not None:
            told = lists.join(names, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        else:
            told = lists.withColumn("comp", F.col("id"))
        # A list is open if it has two components; a member counts that can link with one of the others' sizes.
        open_ = told.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("m"), F.max("left").alias("its")).where("lo < hi")
        told = staged(told.join(open_, "sig").where(_MEETS).select("sig", "id", "n", "left", "comp"))
        of_one = told.groupBy("sig", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
        pairs_left = of_one.groupBy("sig").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("alike")).agg(F.sum(F.expr("(members * members - alike) / 2"))).first()[0]
        if not pairs_left:
            break
        other = told.select("sig", F.col("id").alias("b"), F.col("n").alias("m"), F.col("left").alias("its"), F.col("comp").alias("beside"))
        last = pairs_left <= FEW * entries
        if last:
            pairs = told.join(other, "sig").where(f"comp <> beside and id > b and {_MEETS}")
        else:
            # Those of a list whose prefix is shortest, one for each of `leaders` remainders of the ids' hashes.
            nearest = F.struct((F.col("its") / F.col("m")).alias("share"), -F.col("b"))
            first = staged(other.groupBy("sig", F.pmod(F.xxhash64("b"), F.lit(leaders)).alias("nth")).agg(*[F.max_by(c, nearest).alias(c) for c in ("b", "m", "its", "beside")]).drop("nth"))
            pairs = told.join(first, "sig").where(f"comp <> beside and {_MEETS}")
        pairs = pairs.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = staged(_verified(staged(_possible(pairs, sketches)), texts))
        if found.limit(1).count():
            # Components of components: their least ids.
            if names is None:
                names = components(found).select(F.col("node").alias("id"), "comp")
            else:
                named = lambda side: names.select(F.col("id").alias(side), F.col("comp").alias(side + "_comp"))
                edges = found.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b").distinct()
                higher = components(staged(edges)).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
                known = names.join(higher, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
                names = staged(known.union(higher.join(names.select(F.col("id").alias("comp")), "comp", "left_anti").select("comp", "top")))
        if last:
            break
        # A leader has met all of its list.
        lists = told.select("sig", "id", "n", "left").join(first.select("sig", F.col("b").alias("id")), ["sig", "id"], "left_anti")
        tried = pairs if tried is None else tried.union(pairs)
        leaders *= MORE
    return names if names is not None else spark.createDataFrame([], "id long, comp long")


def _ties(sets: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, bare) of the ids whose rows hold several sets, or a set and no words: the least and the largest
    set's id, and whether a row has no words."""
    own = F.when(F.col("n") > 0, F.col("id"))
    return sets.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.max(F.col("n") == 0).alias("bare")).where("lo < hi or (bare and lo is not null)")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Null text counts as empty; a text without words has no shingles and no links. Rows that share a doc_id are one
    node, which has the links of all their sets. A row without doc_id has no node, so its component_id is null, and
    none of its links counts. Other columns aren't read."""
    described = staged(_described(docs))
    sets = described.where("kind = 0").select("doc_id", "n", "id")
    counted = staged(described.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    top = sorted(most_frequent(counted, "n", FREQUENT), key=lambda r: (-r.n, r.id))
    frequent = np.array([r.id for r in reversed(top)], np.int64).astype(np.uint64)  # rarest first
    size = np.array([2 if r.n < VERY else 3 for r in reversed(top)], np.int64)
    order = np.argsort(frequent)
    frequent, place, size = frequent[order], order, size[order]

    texts = docs.where("doc_id is not null").select(text_of().alias("text"))
    lists = _lists(_index(texts, frequent, place, size))
    involved = staged(_involved(texts, lists.select("id").distinct()))
    ties = staged(_ties(sets))
    tied = bool(ties.limit(1).count())
    names = None
    if tied:
        edges = sets.where("n > 0").join(ties, "doc_id").where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
        names = components(staged(edges)).select(F.col("node").alias("id"), "comp")
    labels = _joined_components(lists, involved, names)

    # Sets, which are fewer than rows, find the least doc_id of their component; then rows find their set.
    least = sets.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("own"))
    joined = staged(least.join(labels, "id"))
    of_comp = joined.groupBy("comp").agg(F.min("own").alias("top"))
    found = staged(least.join(joined.join(of_comp, "comp").select("id", "top"), "id", "left").select("id", F.coalesce("top", "own").alias("component_id")))
    rows = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("id")).alias("id"))
    if tied:
        rows = rows.join(ties.select("doc_id", "lo"), "doc_id", "left").select("doc_id", "n", F.coalesce("id", "lo").alias("id"))
    top_of = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(found, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), top_of.alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents of docs that have their component's smallest doc_id; rows without doc_id stay, and rows that
    share a doc_id share its fate."""
    gone = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
