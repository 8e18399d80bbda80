"""Quality classifier by co-training: a view of the text and a view of the page data teach each other.

Both views are logistic models on fixed features. They start from a bounded sample of labelled rows. In every round each
view labels the rows of an unlabelled pool it is surest of, and these join the other view's training rows with their
pseudo-labels. Afterwards each view is calibrated on labelled rows kept apart (Platt scaling), and a document's score is
the probability from both calibrated log-odds together, the prior counted once.

Fitting works on at most `MAX_LABELLED` labelled and `MAX_POOL` unlabelled rows, chosen by hash of the document id (a
few dozen numbers a row); every document of the table is scored, from its whole text.

Defined results: a NULL or empty text has zero features and is scored like any other; NULL language, source or size are
values of their own in the page view. Without labelled rows of both classes there is nothing to learn and every score
is the share of good rows, or 1 without any. Repeated rows get equal scores. Empty tables give empty tables. Columns
named like an output column are replaced, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lonetext.llm.words import coded, owners, slices, split, texts_of, totals

MAX_LABELLED = 20_000
MAX_POOL = 20_000
ROUNDS = 4
PER_ROUND = 500  # pseudo-labels a view gives in a round
SURE = 0.95  # and the least probability for one
REJECT_BELOW = 0.5
RIDGE = 1.0
BUCKETS = 32  # hashed page features

# Character classes counted over the whole text.
CLASSES = ("[#*$%&|<>]", "[!?]", "[.,;:]", "[0-9]", "[A-ZÀ-ÖØ-Þ]", "[^\\x00-\\x7F]", "[@/\\\\_=]", "\n")
TEXT_NAMES = ("log_words", "word_length", "distinct", "longest_run", "repeat_lines", "short_words",
              *(f"class_{i}" for i in range(len(CLASSES))))


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text."""
    words, bounds = split(texts)
    ids, _ = coded(words)
    n = np.diff(bounds).astype(float)
    some = np.maximum(n, 1)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = owners(bounds)
    size = int(ids.max()) + 1 if len(ids) else 1
    distinct = np.bincount(np.unique(owner * size + ids) // size, minlength=len(n)) if len(ids) else np.zeros(len(n))
    top = np.zeros(len(n))
    if len(ids):
        ends = np.flatnonzero(n)
        top[ends] = np.maximum.reduceat(length, bounds[:-1][ends])
    lists = pc.split_pattern(texts, "\n")
    line_bounds = lists.offsets.to_numpy().astype(np.int64)
    line_bounds -= line_bounds[0]
    line_ids, _ = coded(lists.flatten())
    line_size = int(line_ids.max()) + 1 if len(line_ids) else 1
    n_lines = np.diff(line_bounds)
    n_distinct = np.bincount(np.unique(owners(line_bounds) * line_size + line_ids) // line_size, minlength=len(n))
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    columns = [np.log1p(n), totals(length, bounds) / some, distinct / some, np.log1p(top),
               (n_lines - n_distinct) / np.maximum(n_lines, 1), totals((length <= 2).astype(int), bounds) / some]
    columns += [np.sqrt(pc.count_substring_regex(texts, c).to_numpy(zero_copy_only=False) / chars) for c in CLASSES]
    return np.stack(columns, axis=1)


def page_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Hashed language, source and their pair, and the length class of the page."""
    result = np.zeros((len(lang), BUCKETS + 1))
    cache: dict[str, int] = {}
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars)):
        size = -1 if c is None else int(max(c, 0)).bit_length()
        for part in (f"l:{a}", f"s:{b}", f"p:{a}:{b}", f"c:{size}"):
            if part not in cache:
                cache[part] = xxhash.xxh3_64_intdigest(part) % BUCKETS
            result[i, cache[part]] += 1
        result[i, BUCKETS] = np.log1p(max(c or 0, 0)) / 10
    return result


@dataclass
class View:
    """A logistic model on standardised features, with a calibration of its log-odds."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return self.slope * (z @ self.weights[:-1] + self.weights[-1]) + self.offset

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> "View":
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        return View(mean, scale, newton((x - mean) / scale, y, ridge))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        raw = self.logit(x)
        smooth = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        slope, offset = newton(raw[:, None], smooth, 1e-3)
        self.slope, self.offset = float(max(slope, 0.0)), float(offset)


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Logistic regression with a ridge on all but the last weight, the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class CoTrained:
    prior: float
    text: View | None = None
    page: View | None = None
    given: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels of the text and page view by round

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        if self.text is None or self.page is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        a, b = self.text.logit(text), self.page.logit(page)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - np.log(self.prior / (1 - self.prior)))


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_page: np.ndarray,
             rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> CoTrained:
    """Co-training on labelled rows and a pool; every fifth labelled row is kept apart for calibration."""
    if not len(y) or y.min() == y.max():
        return CoTrained(float(y.mean()) if len(y) else 1.0)
    held = np.arange(len(y)) % 5 == 4
    if not held.any() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    views, rows = [text, page], [pool_text, pool_page]
    extra_x, extra_y = [[], []], [[], []]
    free = np.ones(len(pool_text), bool)
    model = CoTrained(float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))

    def train(v: int) -> View:
        x = np.vstack([views[v][~held], *extra_x[v]])
        view = View.fit(x, np.concatenate([y[~held], *extra_y[v]]))
        view.calibrate(views[v][check], y[check])
        return view

    for _ in range(rounds):
        fitted, given = [train(0), train(1)], []
        for v in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(fitted[v].logit(rows[v]), -500, 500))) if len(free) else np.empty(0)
            surest = np.maximum(p, 1 - p) * free
            chosen = np.argsort(-surest, kind="stable")[:per_round]
            chosen = chosen[surest[chosen] >= sure]
            free[chosen] = False
            extra_x[1 - v].append(rows[1 - v][chosen])
            extra_y[1 - v].append((p[chosen] > 0.5).astype(float))
            given.append(len(chosen))
        model.given.append((given[0], given[1]))
        if not any(given):
            break
    model.text, model.page = train(0), train(1)
    return model


FEATURES = "array<double>"


def features(docs: DataFrame) -> DataFrame:
    """Ids with both views' features, for the bounded training sample."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("label", T.IntegerType()),
                           *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("a", "b")]])

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                a, b = _views(part)
                yield pa.RecordBatch.from_arrays([
                    part.column(part.schema.get_field_index("key")),
                    part.column(part.schema.get_field_index("label")),
                    pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(b.tolist(), pa.list_(pa.float64()))],
                    ["key", "label", "a", "b"])

    return docs.mapInArrow(compute, schema)


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    get = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
    return text_features(texts_of(part)), page_features(get("lang"), get("source"), get("n_chars"))


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> DataFrame:
    """The labelled rows and the unlabelled pool with the smallest hashes of their ids.

    Ids are picked first, from two narrow columns; only the picked rows' texts are read further on.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("label"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().join(marked, "doc_id", "left")
    key = F.md5(F.col("doc_id").cast("string"))
    ids = ids.select(F.col("doc_id").alias("p_id"), key.alias("key"), "label")
    picked = ids.filter("label IS NOT NULL").orderBy("key").limit(max_labelled).unionByName(
        ids.filter("label IS NULL").orderBy("key").limit(max_pool))
    chosen = docs.select("doc_id", "text", "lang", "source", "n_chars").join(
        F.broadcast(picked), F.col("doc_id") == F.col("p_id"))
    return features(chosen.select("key", "label", "text", "lang", "source", "n_chars"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> CoTrained:
    rows = {r.key: r for r in sample(docs, labels, max_labelled, max_pool).toLocalIterator()}
    ordered = [rows[k] for k in sorted(rows)]
    width = (len(TEXT_NAMES), BUCKETS + 1)

    def arrays(some: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([r[i] for r in some], float).reshape(len(some), w) for i, w in zip("ab", width))

    known, pool = [r for r in ordered if r.label is not None], [r for r in ordered if r.label is None]
    return co_train(*arrays(known), np.array([float(r.label > 0) for r in known]), *arrays(pool))


SCORES = ("text_score", "page_score", "score")


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """`docs` with text_score, page_score, score (all probabilities of good quality) and kept."""
    names = [c for c in docs.columns if c not in (*SCORES, "kept")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.DoubleType()) for c in SCORES])

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = model.scores(*_views(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(v) for v in values],
                    [*names, *SCORES])

    return docs.select(*names).mapInArrow(compute, schema).withColumn("kept", F.col("score") >= REJECT_BELOW)


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    return score(docs, fit(docs, labels, **bounds))
