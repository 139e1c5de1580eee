"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window and classified by softmax.
Training is numpy on the driver over a bounded sample; prediction cuts every whole text into fixed windows, runs
them in batches, and averages the windows' probabilities by their bytes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sliced

UNDETERMINED = "und"
#: Bound of the training sample: rows for each language, chosen by the smallest seeded hashes.
SAMPLE_PER_LANGUAGE = 700
WINDOW = 192
WIDTHS = (2, 3, 4)
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    languages: list[str]
    widths: tuple[int, ...] = WIDTHS
    filters: int = 12
    dim: int = 6
    seed: int = 7
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.params:
            return
        rng = np.random.default_rng(self.seed)
        self.params["E"] = rng.normal(0, 0.5, (256, self.dim)).astype(np.float32)
        for w in self.widths:
            self.params[f"W{w}"] = rng.normal(0, (2 / (w * self.dim)) ** 0.5, (w * self.dim, self.filters)).astype(np.float32)
            self.params[f"b{w}"] = np.zeros(self.filters, np.float32)
        self.params["V"] = rng.normal(0, 0.2, (len(self.widths) * self.filters, len(self.languages))).astype(np.float32)
        self.params["c"] = np.zeros(len(self.languages), np.float32)

    def _columns(self, emb: np.ndarray, w: int) -> np.ndarray:
        n = emb.shape[1] - w + 1
        return np.concatenate([emb[:, j : n + j] for j in range(w)], axis=2)

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """x: windows of bytes, zero-padded; positions that touch padding are not pooled (the first always is)."""
        p, emb, pooled, memory = self.params, self.params["E"][x], [], []
        partial = lengths.min() < x.shape[1]
        for w in self.widths:
            u = self._columns(emb, w)
            z = u.reshape(-1, u.shape[2]) @ p[f"W{w}"]
            z = z.reshape(u.shape[0], u.shape[1], -1)
            if partial:
                z[np.arange(z.shape[1])[None, :] > np.maximum(lengths - w, 0)[:, None]] = -np.inf
            if keep:
                at = z.argmax(1)
                top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
                memory.append((u, at))
            else:
                top = z.max(1)
            pooled.append(np.maximum(top + p[f"b{w}"], 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["V"] + p["c"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        return (prob, h, memory) if keep else prob

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, h, memory = self.forward(x, lengths, keep=True)
        d = prob
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        p, g = self.params, {}
        g["V"], g["c"] = h.T @ d, d.sum(0)
        dh = (d @ p["V"].T) * (h > 0)
        g["E"] = np.zeros_like(p["E"])
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(self.widths):
            dz = dh[:, k * self.filters : (k + 1) * self.filters]
            u, at = memory[k]
            g[f"b{w}"] = dz.sum(0)
            g[f"W{w}"] = np.einsum("bfk,bf->kf", u[rows, at], dz)
            du = dz[:, :, None] * p[f"W{w}"].T[None]
            for j in range(w):
                np.add.at(g["E"], x[rows, at + j], du[:, :, j * self.dim : (j + 1) * self.dim])
        return g

    def fit(self, windows: np.ndarray, lengths: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> ByteCNN:
        rng, step = np.random.default_rng(self.seed), 0
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        total = max(1, epochs * -(-len(y) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                part = order[i : i + batch]
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, g in self.gradients(windows[part], lengths[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.params[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def cut(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fixed windows over all of the bytes, the last padded with zeros; at least one."""
    n = max(1, -(-len(raw) // window))
    x = np.zeros(n * window, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    lengths = np.full(n, window)
    lengths[-1] = len(raw) - window * (n - 1)
    return x.reshape(n, window), lengths


def windows_of(text: str | None, per_text: int = 4, seed: int = 7) -> list[bytes]:
    """Random windows of many lengths, so that short texts are met in training; none of a letterless text."""
    if not text or not _LETTER.search(text):
        return []
    raw = text.encode("utf-8", "surrogatepass")
    rng, out = np.random.default_rng([seed, zlib.crc32(raw)]), []
    for _ in range(per_text):
        n = min(len(raw), int(rng.choice((12, 24, 48, 96, WINDOW))))
        at = int(rng.integers(0, len(raw) - n + 1))
        out.append(raw[at : at + n])
    return out


def learn(rows: list[tuple[list[bytes], str]], seed: int = 7) -> ByteCNN | None:
    """rows: (windows of a text, language)."""
    pairs = [(w, lang) for windows, lang in rows for w in windows]
    languages = sorted({lang for _, lang in pairs})
    if not languages:
        return None
    x = np.zeros((len(pairs), WINDOW), np.uint8)
    for i, (w, _) in enumerate(pairs):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    place = {lang: i for i, lang in enumerate(languages)}
    model = ByteCNN(languages, seed=seed)
    return model if len(languages) == 1 else model.fit(x, np.array([len(w) for w, _ in pairs]), np.array([place[lang] for _, lang in pairs]))


def predict_texts(model: ByteCNN | None, texts: list[str | None], batch: int = 256) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if model is None:
        return out
    owners, sums, held, size = [], {}, [], 0

    def flush():
        nonlocal held, owners, size
        if held:
            x, lengths, who = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]), np.concatenate(owners)
            for i in range(0, len(x), batch):
                prob = model.forward(x[i : i + batch], lengths[i : i + batch]) * lengths[i : i + batch, None]
                ids, first = np.unique(who[i : i + batch], return_index=True)
                for k, total in zip(ids, np.add.reduceat(prob, first), strict=True):
                    sums[k] = sums.get(k, 0) + total
        held, owners, size = [], [], 0

    for k, text in enumerate(texts):
        if text and _LETTER.search(text):
            x, lengths = cut(text.encode("utf-8", "surrogatepass"))
            held.append((x, lengths)), owners.append(np.full(len(x), k))
            size += len(x)
            if size >= 16 * batch:
                flush()
    flush()
    for k, total in sums.items():
        best = int(np.argmax(total))
        out[k] = (model.languages[best], float(min(1.0, total[best] / total.sum())))
    return out


def held_out(key, modulus: int = 5, remainder: int = 0):
    return F.crc32(key.cast("string").cast("binary")) % modulus == remainder


_SAMPLED = pa.schema([("u", pa.float64()), ("doc_id", pa.string()), ("lang", pa.string()), ("windows", pa.list_(pa.binary()))])


def training_rows(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 11) -> list[tuple[list[bytes], str]]:
    """(windows, language) of a bounded sample for each language of the rows that may be learned from, by smallest
    seeded hash.

    Counting first turns the bound into a hash threshold.  The chosen texts are cut where they lie: only their few
    windows, at most 4 * WINDOW bytes a row, reach the driver.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    rows = rows.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53)))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    limit = F.lit(0.0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, (per_language + 4 * per_language**0.5) / n))).otherwise(limit)

    def cut_up(batches):
        for part in sliced(batches):
            windows = pa.array([windows_of(t) for t in part.column(3).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], windows], schema=_SAMPLED)

    chosen = rows.where(F.col("u") <= limit).select("u", F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    found: dict[str, list] = {}
    for r in sorted(chosen.mapInArrow(cut_up, "u double, doc_id string, lang string, windows array<binary>").collect(), key=lambda r: (r["u"], r["doc_id"], r["windows"])):
        found.setdefault(r["lang"], []).append(tuple(map(bytes, r["windows"])))
    # Equal texts have equal windows: one of them is enough.
    return [(list(windows), lang) for lang in sorted(found) for windows in dict.fromkeys(found[lang][:per_language])]


PREDICTION = "doc_id bigint, lang_pred string, score double"
_PREDICTION = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one per input row: a map, no shuffle.

    ``und`` with score 0 for null, empty and letterless texts, and for all if nothing was learned; repeated rows
    repeat; very long texts are cut into windows and read whole; other columns are ignored.
    """

    def run(batches):
        for part in sliced(batches):
            found = predict_texts(model, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], schema=_PREDICTION)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, PREDICTION)


#: A text is rejected if no language gets this share of it: nearly chance where four are known.
LEAST_SCORE = 0.3


def language_filter(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with at least this score; a null lang becomes the
    prediction.

    Null, empty and letterless texts go; without a model all go; repeated rows and ties are judged each by its text.
    An empty table gives no rows.
    """
    at, to = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        for part in sliced(batches):
            found = predict_texts(model, part.column(at).to_pylist())
            said = pa.array([old if old is not None else new for old, (new, _) in zip(part.column(to).to_pylist(), found, strict=True)], part.column(to).type)
            whole = part.set_column(to, part.schema.names[to], said)
            yield whole.filter(pa.array([a != UNDETERMINED and b >= least for a, b in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
