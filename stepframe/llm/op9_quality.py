"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or not at all on each document; most of them know one kind of junk only. How often each pattern of votes occurs, over all
documents, is all that expectation-maximisation needs to estimate how each labeller votes on good and on bad documents, and the
posterior of each pattern (at most 3^labellers numbers on the driver). The posteriors label at most ``SAMPLE_DOCS``
documents (the smallest hashes of the key), which train a linear scorer over hashed features: trigrams of character classes and how
words relate to earlier ones. All documents are scored by it; those with a margin under ``MARGIN`` are rejected.

Null or wordless texts have no votes and no features and are rejected. Repeated rows are scored alike; an empty table gives
no rows; extra columns are not read by the scoring and kept by the filter. No shuffle but for counts of patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.shared import byte_slices, lean, ship
from stepframe.llm.shingles import words

SAMPLE_DOCS = 8_000
HASHED = 1024
RELATIONS = 64
WIDTH = HASHED + RELATIONS + 1
MARGIN = -1.5
FEW = 60
#: Bytes and rows of texts that are described together, and changes of character class that are counted together in a long one.
SLICE_BYTES, SLICE = 2_000_000, 1000
STRETCH = 4_000_000
#: Frequent short words of the corpus' languages (fixed values).
STOPWORDS = (
    "the of and to in a is that for it was with as on be at by this are or from der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "le la les de et en un une du que est pour dans par sur el los las con por del se al y"
).split()
#: The first BAD_ONLY can only tell bad documents and else don't vote.
BAD_ONLY = 5
LABELLERS = ("capitals", "symbols", "repeats", "variety", "pipes", "function_words", "full_stops")

#: Letters and digits by class, other ASCII characters each its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97
_OTHER = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".,|" for i in range(256)])


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    ends = bounds.tolist()
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(ends, ends[1:], strict=False)], np.int64)


def described(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Votes (1 good, 0 bad, -1 none) and features of each text."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    hashes, at = words(texts)
    n_words = np.diff(at)
    size, count = np.maximum(np.diff(bounds), 1), np.maximum(n_words, 1)

    kind = _CLASS[raw]
    upper, lower = _sums(kind == 65, bounds), _sums(kind == 97, bounds)
    word_doc = np.repeat(np.arange(n), n_words)
    inner = np.ones(len(hashes), bool)
    inner[at[:-1][n_words > 0]] = False
    repeat = np.zeros(len(hashes), bool)
    repeat[1:] = (hashes[1:] == hashes[:-1]) & inner[1:]
    turn = np.lexsort((np.arange(len(hashes)), hashes, word_doc))
    seen = np.zeros(len(hashes), bool)
    seen[turn[1:]] = (hashes[turn[1:]] == hashes[turn[:-1]]) & (word_doc[turn[1:]] == word_doc[turn[:-1]])
    stop = np.isin(hashes, _stop_hashes())
    share = {
        "capitals": upper / np.maximum(upper + lower, 1), "symbols": _sums(_OTHER[raw], bounds) / size, "repeats": _sums(repeat, at) / count,
        "variety": 1 - _sums(seen, at) / count, "pipes": _sums(raw == 124, bounds) / count, "function_words": _sums(stop, at) / count,
        "full_stops": _sums((raw == 46) | (raw == 33), bounds) / count,
    }
    votes = np.full((n, len(LABELLERS)), -1, np.int8)
    never = np.zeros(n, bool)
    for j, (name, bad, good) in enumerate([
        ("capitals", lambda x: x > 0.4, lambda x: never), ("symbols", lambda x: x > 0.1, lambda x: never), ("repeats", lambda x: x > 0.3, lambda x: never),
        ("variety", lambda x: x < 0.3, lambda x: never), ("pipes", lambda x: x > 0.1, lambda x: never),
        ("function_words", lambda x: (x < 0.03) & (n_words > 30), lambda x: x > 0.12),
        ("full_stops", lambda x: (x > 1) | (x < 0.005) & (n_words > 60), lambda x: (x > 0.02) & (x < 0.3)),
    ]):
        votes[good(share[name]), j] = 1
        votes[bad(share[name]), j] = 0
    votes[n_words == 0] = -1

    features = np.zeros((n, WIDTH), np.float32)
    fresh = np.ones(len(raw), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    inside = bounds[:-1]
    fresh[inside[inside < len(raw)]] = True  # a text begins anew
    at_fresh = np.flatnonzero(fresh)
    for lo in range(0, len(at_fresh) - 2, STRETCH):
        places = at_fresh[lo : lo + STRETCH + 2]
        c, d = kind[places].astype(np.int64), np.searchsorted(bounds, places, "right") - 1
        same = d[2:] == d[:-2]
        code = ((c[:-2] * 263 + c[1:-1]) * 263 + c[2:]) * 2654435761 % 4294967291 % HASHED
        features[:, :HASHED] += np.bincount(d[2:][same] * HASHED + code[same], minlength=n * HASHED).reshape(n, HASHED)
    if len(hashes):
        state = seen * 4 + repeat * 2 + stop
        pair = state.copy()
        pair[1:] += 8 * np.where(inner[1:], state[:-1], 0)
        features[:, HASHED : HASHED + RELATIONS] = np.bincount(word_doc * RELATIONS + pair, minlength=n * RELATIONS).reshape(n, RELATIONS)
    for part in (features[:, :HASHED], features[:, HASHED : HASHED + RELATIONS]):
        part /= part.sum(1, keepdims=True) + FEW  # few words tell little
        np.sqrt(part, out=part)
    features[:, -1] = 1
    return votes, features


def wordless(features: np.ndarray) -> np.ndarray:
    return ~features[:, HASHED : HASHED + RELATIONS].any(1)


def _stop_hashes() -> np.ndarray:
    if "h" not in _STOP:
        _STOP["h"] = words(pa.array(STOPWORDS))[0]
    return _STOP["h"]


_STOP: dict[str, np.ndarray] = {}


def vote_patterns(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each pattern of votes occurs over all documents."""

    def run(batches):
        for b in byte_slices(batches, 0, SLICE_BYTES, SLICE):
            code = ((described(b.column(0))[0] + 1) @ (3 ** np.arange(len(LABELLERS)))).astype(np.int64)
            found, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["code", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {tuple(int(r.code) // 3**j % 3 - 1 for j in range(len(LABELLERS))): r.n for r in sorted(rows)}


def label_model(patterns: dict[tuple[int, ...], int], steps: int = 100) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of good for each pattern, and by labeller, class and vote (none, bad, good) its probability."""
    votes = np.array(list(patterns), int).reshape(-1, len(LABELLERS)) + 1
    n = np.array(list(patterns.values()), float)
    hot = np.eye(3)[votes]  # pattern, labeller, vote
    table = np.tile(np.array([[0.2, 0.6, 0.2], [0.2, 0.1, 0.7]]), (len(LABELLERS), 1, 1))
    table[:BAD_ONLY] = [[0.65, 0.34, 0.01], [0.97, 0.02, 0.01]]
    prior = 0.8
    good = np.full(len(n), prior)
    for _ in range(steps if len(n) else 0):
        log = np.log(np.array([1 - prior, prior])) + np.einsum("pjv,jcv->pc", hot, np.log(table))
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        weight = np.stack([n * (1 - good), n * good], 1)
        table = (np.einsum("pc,pjv->jcv", weight, hot) + 1) / (weight.sum(0)[None, :, None] + 3)
        prior = float(np.clip(weight[:, 1].sum() / n.sum(), 0.01, 0.99))
    return {p: float(g) for p, g in zip(patterns, good, strict=True)}, table


def fit_scorer(features: np.ndarray, good: np.ndarray, steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighing the same, by gradient steps with momentum."""
    w = np.zeros(features.shape[1])
    if not len(good):
        return w
    mass = np.maximum(np.array([(1 - good).sum(), good.sum()]), 1e-9)
    weight = (1 - good) * 0.5 / mass[0] + good * 0.5 / mass[1]
    speed = np.zeros_like(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        speed = 0.9 * speed - rate * (features.T @ (weight * (p - good)) + decay * w)
        w = w + speed
    return w


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    ship(docs.sparkSession)
    # rows that share a place in the sample's order are equal in key and text, so the sample is the same in every run
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), F.col(text).alias("text"))
    posterior, _ = label_model(vote_patterns(rows))
    cut = rows.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if cut is None:
        return np.zeros(WIDTH)

    def run(batches):
        for b in byte_slices(batches, 0, SLICE_BYTES, SLICE):
            votes, features = described(b.column(0))
            p = np.where(wordless(features), 0.0, [posterior.get(tuple(v), 0.0) for v in votes.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), pa.array([f.tobytes() for f in features], pa.binary())], ["good", "f"])

    held = rows.where(F.col("h") <= F.lit(cut)).select("text").limit(SAMPLE_DOCS).mapInArrow(lean(run), "good double, f binary").collect()
    x = np.frombuffer(b"".join(bytes(r.f) for r in held), np.float32).reshape(len(held), WIDTH)
    order = np.lexsort((x[:, : 64].sum(1), [r.good for r in held]))  # the same sums whatever order rows come in
    return fit_scorer(x[order].astype(np.float64), np.array([r.good for r in held])[order])


def _margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    _, features = described(texts)
    return np.where(wordless(features), -np.inf, features @ weights)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (from 0 to 1), keep for each row."""
    weights = weights.astype(np.float64)

    def run(batches):
        for b in byte_slices(batches, 1, SLICE_BYTES, SLICE):
            m = _margins(b.column(1), weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(1 / (1 + np.exp(-np.clip(m, -50, 50))), 6)), pa.array(m >= MARGIN)], ["doc_id", "score", "keep"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, score double, keep boolean")


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return score(docs, train(docs, key, text), key, text)


def good_only(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that the classifier rejects."""
    weights, at = train(docs, key, text), docs.columns.index(text)

    def run(batches):
        for b in byte_slices(batches, at, SLICE_BYTES, SLICE):
            yield b.filter(pa.array(_margins(b.column(at), weights) >= MARGIN))

    return docs.mapInArrow(lean(run), docs.schema)
