"""Toxicity from the nearest labelled examples.

Labelled texts become TF-IDF vectors over terms that tell the labels apart (whole words and word beginnings, kept by
chi-square and lift), normalised to length one, and are held in an inverted index with per-block maxima.  A text's
nearest examples by cosine are found exactly: blocks are visited by falling upper bound until no block can beat the
k-th best.  Their votes, weighted by inverse distance, are calibrated by isotonic regression on leave-one-out votes;
the neighbours are the evidence.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sliced
from .langid import held_out

#: Bound of the labelled sample: rows for each label, chosen by the smallest seeded hashes.
SAMPLE_PER_LABEL = 3000
#: Terms are kept from this chi-square and lift (or its inverse) on.
LEAST_CHI, LEAST_LIFT = 15, 3
BLOCK = 64
NEIGHBOURS = 15
#: Added to a distance before it is inverted.
SOFTEN = 0.05
THRESHOLD = 0.7
_WORD = re.compile(r"\w+").findall
PREFIX = 4


def terms_of_word(word: str) -> tuple[str, ...]:
    return (word, "^" + word[:PREFIX]) if len(word) > PREFIX else (word, "^" + word)


def terms_of(text: str | None) -> set[str]:
    return {term for word in set(_WORD((text or "").lower())) for term in terms_of_word(word)}


def shingles(text: str, size: int = 5) -> set[int]:
    """Hashes of the runs of five words, or of the whole of a shorter text."""
    words = _WORD(text.lower())
    return {zlib.crc32(" ".join(words[i : i + size]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - size + 1))} if words else set()


def without_copies(rows: list[tuple[int, str, int]], size: int = 32) -> list[tuple[int, str, int]]:
    """Leaves out near copies of earlier examples of the label, which would make any word of theirs look telling: those
    whose shingle sets have a Jaccard similarity of 0.75 with one example.  Candidates share a quarter of the smallest
    shingle hashes; the whole sets decide."""
    kept, seen = [], {}
    whole = lru_cache(maxsize=256)(lambda i: shingles(kept[i][1]))
    for row in rows:
        own = shingles(row[1])
        sketch = heapq.nsmallest(size, own)
        shared = Counter(i for h in sketch for i in seen.get((row[2], h), ()))
        near = (i for i, n in shared.most_common() if n * 4 >= len(sketch))
        if any(4 * len(own & whole(i)) >= 3 * len(own | whole(i)) for i in near):
            continue
        for h in sketch:
            seen.setdefault((row[2], h), []).append(len(kept))
        kept.append(row)
    return kept


@dataclass
class BlockMaxIndex:
    """Postings by term, in order of document, with the largest weight of each block of documents."""

    n: int
    postings: list[tuple[np.ndarray, np.ndarray]]
    starts: np.ndarray = field(init=False)
    maxima: np.ndarray = field(init=False)

    def __post_init__(self):
        blocks = -(-self.n // BLOCK)
        self.starts = np.zeros((len(self.postings), blocks + 1), np.int32)
        self.maxima = np.zeros((len(self.postings), blocks), np.float64)
        for t, (docs, weights) in enumerate(self.postings):
            self.starts[t] = np.searchsorted(docs, np.arange(blocks + 1) * BLOCK)
            np.maximum.at(self.maxima[t], docs // BLOCK, weights)

    def search(self, terms: list[int], weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k documents of largest dot product above zero, as (score, document); ties by document."""
        if not terms or not self.n:
            return []
        bound = weights @ self.maxima[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and best[-1][0] > bound[b] + 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms, weights, strict=True):
                i, j = self.starts[t, b], self.starts[t, b + 1]
                if i < j:
                    docs, own = self.postings[t]
                    score[docs[i:j] - b * BLOCK] += w * own[i:j]
            if 0 <= without - b * BLOCK < BLOCK:
                score[without - b * BLOCK] = 0
            least = best[-1][0] if len(best) == k else 0.0
            some = np.flatnonzero((score > 0) & (score >= least))
            if len(some):
                best = sorted([*best, *((float(score[d]), int(d + b * BLOCK)) for d in some)], key=lambda x: (-x[0], x[1]))[:k]
        return best


@dataclass
class ToxicityModel:
    terms: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    keys: list[int]
    labels: np.ndarray
    prior: float
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    _words: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def vector(self, text: str | None) -> tuple[list[int], np.ndarray]:
        counts: dict[int, int] = {}
        seen = self._words
        for word in _WORD((text or "").lower()):
            ids = seen.get(word)
            if ids is None:
                if len(seen) > 200_000:
                    seen.clear()
                ids = seen[word] = tuple(self.terms[t] for t in terms_of_word(word) if t in self.terms)
            for i in ids:
                counts[i] = counts.get(i, 0) + 1
        ids = sorted(counts)
        w = (1 + np.log(np.array([counts[i] for i in ids], float))) * self.idf[ids] if ids else np.zeros(0)
        return ids, w / (np.linalg.norm(w) or 1.0)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Inverse-distance vote; the missing of NEIGHBOURS count as the prior at distance one."""
        w = [1 / (1 - min(1.0, s) + SOFTEN) for s, _ in near]
        rest = (NEIGHBOURS - len(near) + 1) / (1 + SOFTEN)
        return (sum(a * self.labels[d] for a, (_, d) in zip(w, near, strict=True)) + rest * self.prior) / (sum(w) + rest)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        near = self.index.search(*self.vector(text), NEIGHBOURS)
        value = float(np.clip(np.interp(self.vote(near), *self.steps), 0, 1))
        return value, [(self.keys[d], s) for s, d in near]


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: rising (vote, probability) points, pulled a little to the mean."""
    order = np.argsort(votes, kind="stable")
    mean = float((labels * weights).sum() / weights.sum())
    blocks: list[list[float]] = []  # weight, weighted labels, weighted votes
    for v, y, w in zip(votes[order], labels[order], weights[order], strict=True):
        blocks.append([w, w * y, w * v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    x = np.array([b[2] / b[0] for b in blocks])
    y = np.array([(b[1] + mean) / (b[0] + 1) for b in blocks])
    return x, np.maximum.accumulate(y)


def learn(rows: list[tuple[int, str, int]], weight: dict[int, float] | None = None) -> ToxicityModel | None:
    """rows: (doc_id, text, label 0 or 1); weight: how many labelled rows one sampled row of a label stands for."""
    sampled = Counter(y for _, _, y in rows)
    rows = without_copies(sorted(rows, key=lambda r: (r[0], r[2], r[1])))
    if not rows:
        return None
    # The rows left stand for the copies too.
    left = Counter(y for _, _, y in rows)
    weight = {y: (weight or {}).get(y, 1.0) * sampled[y] / max(1, left[y]) for y in (0, 1)}
    labels = np.array([y for _, _, y in rows])
    df = [Counter(), Counter()]
    for _, text, y in rows:
        df[y].update(terms_of(text))
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    kept = []
    for term in df[1].keys() | df[0].keys():
        a, b = df[1][term], df[0][term]
        if a + b < 3:
            continue
        c, d = n1 - a, n0 - b
        chi = (n1 + n0) * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * n1 * n0)
        lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
        if chi >= LEAST_CHI and not 1 / LEAST_LIFT < lift < LEAST_LIFT:
            kept.append(term)
    kept.sort()
    terms = {t: i for i, t in enumerate(kept)}
    idf = np.array([np.log((1 + len(rows)) / (1 + df[0][t] + df[1][t])) + 1 for t in kept])
    model = ToxicityModel(terms, idf, BlockMaxIndex(0, []), [], np.zeros(0), 0.5)
    vectors = [model.vector(t) for _, t, _ in rows]
    some = [i for i, (ids, _) in enumerate(vectors) if ids]
    # Like examples share blocks, which keeps the bounds tight.
    some.sort(key=lambda i: (vectors[i][0][int(np.argmax(vectors[i][1]))], labels[i], i))
    lists: list[list[tuple[int, float]]] = [[] for _ in kept]
    for place, i in enumerate(some):
        for t, w in zip(*vectors[i], strict=True):
            lists[t].append((place, w))
    model.index = BlockMaxIndex(len(some), [(np.array([d for d, _ in p], np.int64), np.array([w for _, w in p])) for p in lists])
    model.keys = [rows[i][0] for i in some]
    model.labels = labels[some]
    none = [i for i, (ids, _) in enumerate(vectors) if not ids] or range(len(rows))
    share = np.array([weight[int(labels[i])] for i in none])
    model.prior = float(((labels[list(none)] * share).sum() + 0.5) / (share.sum() + 1))
    place_of = {i: p for p, i in enumerate(some)}
    votes = np.array([model.vote(model.index.search(*vectors[i], NEIGHBOURS, without=place_of.get(i, -1))) for i in range(len(rows))])
    model.steps = isotonic(votes, labels, np.array([weight[int(y)] for y in labels]))
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 13):
    """A bounded sample for each label of the rows that may be learned from, and what a sampled row stands for.

    The sampled ids (at most a little over per_label for each label) are broadcast to the texts, which stay in place.
    """
    marks = pick(labels, doc_id=id_col, label=label_col).where(F.col("label").isin(0, 1) & ~F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(True)))
    marks = marks.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53)))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    limit = F.lit(0.0)
    for label, n in counts.items():
        limit = F.when(F.col("label") == label, F.lit(min(1.0, per_label / n))).otherwise(limit)
    chosen = marks.where(F.col("u") <= limit).select("doc_id", "label")
    found = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").collect()
    got = Counter(r["label"] for r in found)
    return [(r["doc_id"], r["text"] or "", r["label"]) for r in found], {y: counts.get(y, 0) / max(1, got[y]) for y in (0, 1)}


SCORES = "doc_id bigint, score double, evidence string"
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.string())])


def score_texts(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence), one per input row: a map, no shuffle.  evidence: "id:cosine" of the nearest three.

    Null and empty texts get the score of texts without any telling term; without labelled rows every score is 0;
    repeated rows repeat; of equally near examples those earlier in the index count; long texts are read whole; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches):
        for part in sliced(batches):
            scores, evidence = [], []
            for text in part.column(1).to_pylist():
                value, near = model.score(text) if model else (0.0, [])
                scores.append(value)
                evidence.append(",".join(f"{k}:{s:.4f}" for k, s in near[:3]))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(evidence, pa.string())], schema=_SCORES)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCORES)


def toxicity_filter(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; without a model all of them.  Null and empty texts,
    repeats and ties are judged as in score_texts; an empty table gives no rows."""
    at = docs.columns.index(text_col)

    def run(batches):
        for part in sliced(batches):
            yield part.filter(pa.array([model is None or model.score(t)[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
