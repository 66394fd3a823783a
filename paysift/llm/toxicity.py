"""Toxicity by weak supervision.

1. Candidates: the distinct labelled training texts give, for every word and every word
   beginning of 4, 5 and 6 letters (as bytes), the toxic and other texts that hold it (copies
   count once). All that are telling (log-likelihood ratio) and precise for toxic texts are
   candidates.
2. Voters: ``COVERS`` lexicons, each a set of candidates that covers the toxic rows of the
   training sample: the candidate that covers most of those yet uncovered is taken first, and
   none that adds little or is imprecise. Words that are telling only because a toxic text was
   copied often add nothing behind the words that made it toxic. No candidate is in two
   lexicons. Beside them vote a fixed word list and patterns (shouting, exclamation marks).
3. Label model: a generative model of the votes given the hidden label. Voters are not
   independent (a word and its beginning vote together), so each voter depends on the label
   and on one other voter: the tree of greatest conditional mutual information. Accuracies and
   correlations are estimated by EM over the counts of vote patterns of all training rows,
   where labelled rows are held to their label. There are at most 2**voters patterns.
4. A logistic regression on the lexicons' features is trained on the posterior labels of the
   training sample: at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of their
   doc_id.

Rows whose crc32(doc_id) is divisible by 5 are held out: neither their labels nor their votes
are learnt from. A score depends on the text alone.

Defined cases: null and empty texts hold no feature and get the score of the intercept; without
labelled rows of both classes every score is the share of toxic labels (0 without labels); a
document with several labels is toxic if one says so; null labels don't count; a null doc_id is
scored, not learnt from; repeated rows count as they come; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .language_id import held_out
from .templates import fold
from .words import _BASE, _INVERSE, _SPACE, _TABLE, CHUNK, _cut, _power, mix, parts, utf8

TRAIN_ROWS = 20_000
LEAST_DOCUMENTS = 5
LEAST_RATIO = 20.0  # log-likelihood ratio of a feature
PREFIXES = (4, 5, 6)
COVERS = 6
LEAST_COVER = 2  # toxic rows that a feature has to add to its lexicon
LEAST_PRECISION = 0.9
EM_ROUNDS = 30
_HELD = 1 << 21
_PLACES = 1 << 20
# Words of the fixed lexicon.
INSULTS = """idiot idiots stupid moron morons loser losers worthless pathetic scum trash clown disgusting dumb
imbecile fool filth vermin garbage retard bastard bitch asshole shit fuck fucking cunt whore slut""".split()
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[0x80:] = True
N_VOTERS = COVERS + 3


def _kinds(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Where the words of ``raw`` begin, their hashes by kind (word, prefixes; 0 where the word
    is no longer than the prefix), and where capitals and exclamation marks are."""
    n = len(raw)
    low, capital = fold(raw)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = True
    edge[0] = edge[n] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    letter = _LETTER[low]
    rank = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(letter, out=rank[1:])
    at = np.flatnonzero(letter)
    total = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[low[at]] * _power(_BASE, len(at)), out=total[1:])
    a, b = rank[begin], rank[end]
    back = _power(_INVERSE, len(at) + 1)[a]
    hashes = [np.where(b > a, mix((total[b] - total[a]) * back), np.uint64(0))]
    for k in PREFIXES:
        to = np.minimum(a + k, b)
        hashes.append(np.where(b > a + k, mix((total[to] - total[a]) * back + np.uint64(k)), np.uint64(0)))
    return begin, hashes, np.flatnonzero(capital), np.flatnonzero(raw == ord("!"))


def _word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return mix(np.array([(_TABLE[raw] * _power(_BASE, len(raw))).sum(dtype=np.uint64)], dtype=np.uint64))[0]


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Chunks of (row of each word, hashes by kind, capitals per row, exclamation marks per row)."""
    raw, off = utf8(texts)
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            to = _cut(raw, off, at, to)
        begin, hashes, capital, mark = _kinds(raw[at:to], off[(off >= at) & (off <= to)] - at)
        row = lambda x: np.searchsorted(off, x + at, side="right") - 1
        yield row(begin), hashes, np.bincount(row(capital), minlength=len(off) - 1), np.bincount(row(mark), minlength=len(off) - 1)
        at = to


def _merge(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, *counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], *(np.add.reduceat(c[order], first) for c in counts)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, code, toxic, other): documents that hold each feature, summed within the task."""
    held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(1 + len(PREFIXES))]

    def rows(kind: int) -> pa.RecordBatch:
        keys, toxic, other = _merge(held[kind])
        held[kind] = []
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(other)],
            names=["kind", "code", "toxic", "other"])

    seen: set[int] = set()  # rows equal in id and text are in the same task
    for batch in (part for whole in batches for part in parts(whole, "text")):
        new_text = []
        for k, digest in enumerate(batch.column("digest").to_pylist()):
            if digest not in seen:
                seen.add(digest)
                new_text.append(k)
        batch = batch.take(pa.array(new_text, pa.int64()))
        toxic = batch.column("toxic").to_numpy().astype(np.int64)
        for row, hashes, _, _ in _features(batch.column("text")):
            for kind, h in enumerate(hashes):
                some = h != 0
                own, code = row[some], h[some]
                order = np.lexsort((code, own))
                own, code = own[order], code[order]
                new = np.r_[True, (code[1:] != code[:-1]) | (own[1:] != own[:-1])] if len(code) else np.zeros(0, bool)
                own, code = own[new], code[new]
                if len(code):
                    held[kind].append(_merge([(code, toxic[own], 1 - toxic[own])]))
                    if sum(len(x[0]) for x in held[kind]) > _HELD:
                        held[kind] = [_merge(held[kind])]
                        if len(held[kind][0][0]) > _HELD // 2:
                            yield rows(kind)
    for kind, x in enumerate(held):
        if x:
            yield rows(kind)


class Candidates:
    """Sorted codes of each kind, and their columns."""

    def __init__(self, rows: list):
        own = [sorted((r["code"] & ((1 << 64) - 1), k) for k, r in enumerate(rows) if r["kind"] == kind) for kind in range(1 + len(PREFIXES))]
        self.codes = [np.array([c for c, _ in x], dtype=np.uint64) for x in own]
        self.column = [np.array([k for _, k in x], dtype=np.int32) for x in own]
        self.insults = np.sort(np.array([_word_hash(w) for w in INSULTS], dtype=np.uint64))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Votes of the fixed voters (bits) of each row, and its candidates (columns) in order."""
        size = len(texts)
        listed = np.zeros(size, dtype=bool)
        words, capitals, marks = (np.zeros(size, np.int64) for _ in range(3))
        key = [np.zeros(0, np.int64)]
        for row, hashes, capital, mark in _features(texts):
            words += np.bincount(row, minlength=size)
            capitals += capital
            marks += mark
            listed[row[np.isin(hashes[0], self.insults)]] = True
            for codes, column, h in zip(self.codes, self.column, hashes, strict=True):
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
                    hit = np.flatnonzero(codes[at] == h)
                    key.append(row[hit] << 32 | column[at[hit]])
        key = np.unique(np.concatenate(key))
        ends = np.searchsorted(key >> 32, np.arange(size + 1)).astype(np.int32)
        fixed = listed | (capitals > words) << 1 | (5 * marks > words) << 2
        return fixed.astype(np.int64), pa.ListArray.from_arrays(pa.array(ends), pa.array((key & 0xFFFFFFFF).astype(np.int32)))


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            fixed, hits = shared.value.read(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(fixed), hits], names=["doc_id", "held_out", "fixed", "hits"])

    return run


def choose_lexicons(hits: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """The lexicon (0 .. COVERS - 1, or -1) of every candidate."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.concatenate([np.zeros(0, np.int64), *hits]).astype(np.int64)
    positive = toxic[row] == 1
    good = np.bincount(column[positive], minlength=size)
    free = good >= LEAST_PRECISION * np.maximum(1, np.bincount(column, minlength=size))
    row, column = row[positive], column[positive]
    lexicon = np.full(size, -1)
    for k in range(COVERS):
        covered = np.zeros(len(hits), dtype=bool)
        while True:
            adds = np.where(free, np.bincount(column[~covered[row]], minlength=size), 0)
            best = int(adds.argmax()) if size else 0
            if not size or adds[best] < LEAST_COVER:
                break
            lexicon[best], free[best] = k, False
            covered[row[column == best]] = True
    return lexicon


def _cast(fixed: np.ndarray, row: np.ndarray, column: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Votes (bits): those of the lexicons, then the fixed ones."""
    votes = fixed.astype(np.int64) << COVERS
    voter = lexicon[column]
    np.bitwise_or.at(votes, row[voter >= 0], np.int64(1) << voter[voter >= 0])
    return votes


def _rows_of(hits: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(hits.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), hits.flatten().to_numpy()


def _vote(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, column = _rows_of(batch.column("hits"))
            votes = _cast(batch.column("fixed").to_numpy(), row, column, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes)], names=["doc_id", "votes"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights, intercept = shared.value
        for batch in batches:
            row, column = _rows_of(batch.column("hits"))
            z = intercept + np.bincount(row, weights=weights[column], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            votes = _cast(batch.column("fixed").to_numpy(), row, column, lexicon)
            cast = ((votes[:, None] >> np.arange(N_VOTERS)) & 1).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(cast)],
                names=["doc_id", "held_out", "score", "predicted", "n_votes"])

    return run


class LabelModel:
    """P(votes, label): every voter depends on the label and on its parent in a tree."""

    def __init__(self, votes: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = EM_ROUNDS):
        """``votes``: 0/1 matrix of the patterns; ``label``: 0, 1, or -1 where unknown."""
        known = label >= 0
        p = np.where(known, label, 0).astype(float)
        self._fit(votes, np.stack([(1 - p) * known, p * known]) * count, tree=True)
        for _ in range(rounds):
            p = np.where(known, label, self.posterior(votes))
            self._fit(votes, np.stack([1 - p, p]) * count, tree=False)

    def _fit(self, votes: np.ndarray, weight: np.ndarray, tree: bool) -> None:
        m = votes.shape[1]
        on = np.stack([1 - votes, votes]).astype(float)  # state, pattern, voter
        # joint[y, s, t, i, j]: voter i in state s and voter j in state t, smoothed.
        joint = np.einsum("yp,spi,tpj->ystij", weight, on, on) + 0.25
        self.prior = np.log((weight.sum(axis=1) + 1) / (weight.sum() + 2))
        if tree:
            share = joint / joint.sum(axis=(0, 1, 2))
            py = share.sum(axis=(1, 2), keepdims=True)
            gain = (share * np.log(share * py / (share.sum(axis=2, keepdims=True) * share.sum(axis=1, keepdims=True)))).sum(axis=(0, 1, 2))
            self.parent = np.full(m, -1)
            inside, rest = [0], list(range(1, m))
            while rest:
                a, b = max(((a, b) for a in inside for b in rest), key=lambda x: gain[x])
                self.parent[b] = a
                inside.append(b)
                rest.remove(b)
        alone = joint[:, :, :, range(m), range(m)].sum(axis=2)
        self.alone = np.log(alone / alone.sum(axis=1, keepdims=True))  # y, s, voter
        pair = joint[:, :, :, range(m), np.maximum(self.parent, 0)]
        self.pair = np.log(pair / pair.sum(axis=1, keepdims=True))  # y, s, parent's t, voter

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        m = votes.shape[1]
        own, above = votes.astype(int), votes[:, np.maximum(self.parent, 0)].astype(int)
        total = np.zeros((2, len(votes)))
        for y in (0, 1):
            each = np.where(self.parent < 0, self.alone[y][own, np.arange(m)], self.pair[y][own, above, np.arange(m)])
            total[y] = self.prior[y] + each.sum(axis=1)
        return 1 / (1 + np.exp(np.clip(total[0] - total[1], -50, 50)))


def fit_logistic(hits: list[np.ndarray], target: np.ndarray, size: int, l2: float = 0.1, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on 0/1 features and soft targets, by
    accelerated gradient steps on the whole (bounded) sample."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.concatenate([np.zeros(0, np.int64), *hits]).astype(np.int64)
    product = lambda v: np.bincount(row, weights=v[column], minlength=len(hits)) + v[size]
    back = lambda e: np.r_[np.bincount(column, weights=e[row], minlength=size), e.sum()]
    top = np.ones(size + 1)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        top = back(product(top / np.linalg.norm(top)))
    step = 1.0 / (0.3 * np.linalg.norm(top) + l2)
    x = y = np.zeros(size + 1)
    for k in range(rounds):
        slope = back(1 / (1 + np.exp(-np.clip(product(y), -50, 50))) - target)
        slope[:size] += l2 * y[:size]
        new = y - step * slope
        y = new + k / (k + 3) * (new - x)
        x = new
    return x[:size], float(x[size])


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_votes of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    digest = F.xxhash64("text").alias("digest")
    # One row stands for all copies of a text; it is toxic if one label says so.
    texts = cut_lineage(rows.where("doc_id IS NOT NULL").select("doc_id", digest).join(known, "doc_id").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    # The labels are the small side of each partition, so no text is sorted.
    taught = rows.select("doc_id", "text", digest).join(texts.hint("shuffle_hash"), ["doc_id", "digest"]).select("text", "digest", "toxic")
    tally = taught.mapInArrow(_tally, "kind int, code long, toxic long, other long").groupBy("kind", "code").agg(
        F.sum("toxic").alias("a"), F.sum("other").alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCUMENTS)
    n1, n0 = known.join(rows.select("doc_id"), "doc_id").agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n1, n0 = float(n1 or 0), float(n0 or 0)
    t1, t0 = (float(x or 0) for x in texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    rate = n1 / (n1 + n0) if n1 + n0 else 0.0
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    seen = (F.col("a") + F.col("b")) / F.lit(max(t1 + t0, 1.0))
    ratio = 2 * (term(F.col("a"), t1 * seen) + term(F.col("b"), t0 * seen)
                 + term(t1 - F.col("a"), t1 * (1 - seen)) + term(t0 - F.col("b"), t0 * (1 - seen)))
    odds = F.log((F.col("a") + 0.5) / (t1 + 1)) - F.log((F.col("b") + 0.5) / (t0 + 1))
    chosen = tally.where((odds > 0) & (F.col("a") >= LEAST_PRECISION * (F.col("a") + F.col("b")))).select("kind", "code", ratio.alias("ratio")).where(
        F.col("ratio") >= LEAST_RATIO).orderBy(F.col("ratio").desc(), "kind", "code").collect() if t1 and t0 else []
    # Candidates, lexicons and weights grow with the telling and precise words only.
    shared = spark.sparkContext.broadcast(Candidates(chosen))
    read = cut_lineage(rows.mapInArrow(_read(shared), "doc_id long, held_out boolean, fixed long, hits array<int>"))
    lexicon, weights, intercept = np.full(len(chosen), -1), np.zeros(len(chosen)), -30.0
    if chosen:
        bits = lambda v: (np.asarray(v, dtype=np.int64)[:, None] >> np.arange(N_VOTERS)) & 1
        learnt = read.where("NOT held_out AND doc_id IS NOT NULL")
        # Rows beyond a quarter more than are wanted never leave their task.
        place = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
        near = place < int(min(1.0, 1.25 * train_rows / (n1 + n0)) * _PLACES)
        sample = learnt.join(known, "doc_id").where(near).orderBy(place, "doc_id").limit(train_rows).select("toxic", "fixed", "hits").collect()
        hits = [np.array(r["hits"], dtype=np.int64) for r in sample]
        lexicon = choose_lexicons(hits, np.array([r["toxic"] for r in sample]), len(chosen))
        chart = spark.sparkContext.broadcast(lexicon)
        votes = learnt.select("doc_id", "fixed", "hits").mapInArrow(_vote(chart), "doc_id long, votes long")
        patterns = votes.join(known, "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()
        model = LabelModel(bits([r["votes"] for r in patterns]), np.array([r["toxic"] for r in patterns]), np.array([r["n"] for r in patterns], dtype=float))
        row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        own = _cast(np.array([r["fixed"] for r in sample]), row, np.concatenate([np.zeros(0, np.int64), *hits]), lexicon)
        weights, intercept = fit_logistic([h[lexicon[h] >= 0] for h in hits], model.posterior(bits(own)), len(chosen))
    elif rate:
        intercept = float(np.log(rate / (1 - rate))) if rate < 1 else 30.0
    fitted = spark.sparkContext.broadcast((lexicon, weights, intercept))
    return read.mapInArrow(_score(fitted), "doc_id long, held_out boolean, score double, predicted int, n_votes long")
