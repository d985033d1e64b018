"""Quality classifier by co-training of two views.

One view sees the text, by statistics of its bytes, words and lines; the other
sees the metadata alone: source, language and length as recorded. Both are
logistic regressions. In each round either classifier gives the other the
pool rows it is surest of as pseudo-labels. Then both are calibrated on labelled
rows that neither has seen, and a logistic regression on the two calibrated
logits combines them. Every document is scored with its whole text.

Fitting uses all labelled rows and all others as the pool. Their features are
written once; every step of Newton's method is a pass over them of which sums
reach the driver. In a round a view gives ``GIVEN`` pseudo-labels a class for
``POOL`` rows of the pool, and the same share of a larger pool. Scoring reads each
row once, without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.text import Words, named, pieces, releasing, slices, utf8
from radiomap.operators.indexing import row_index
from radiomap.session import materialize

#: Rows of the pool that ``GIVEN`` is for.
POOL = 12_000
ROUNDS = 3
#: Probability from which a prediction on the pool becomes a pseudo-label.
SURE = 0.98
#: Pseudo-labels that a view gives in a round by class, besides any as sure as the last of them.
GIVEN = 1_500
#: Weight of a pseudo-label against a true one.
PSEUDO_WEIGHT = 0.3
KEEP = 0.5
SEED = 3
_HASHED = 64
#: Bytes of text whose features are taken together.
_TOGETHER = 4 << 20

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was be by at this are from or an not but have "
    "le la les de des du un une et en est que qui dans pour sur par pas au avec ce il "
    "der die das und den dem von zu mit sich auf ist im nicht ein eine als auch es aus "
    "el los las y del se por con no su al lo como mas pero sus una"
).split()

_CLASSES = ("lower", "upper", "digit", "space", "line", "high", "stop", "comma", "bang", "bar", "symbol", "quote", "other")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.uint8)
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)),
                          ("space", b" \t\r\x0b\x0c"), ("line", b"\n"), ("high", range(128, 256)), ("stop", b".?"),
                          ("comma", b",;:"), ("bang", b"!"), ("bar", b"|"), ("symbol", b"#$%&*+<=>@^_~/\\{}[]"),
                          ("quote", b"\"'()-`")):
        table[list(members)] = _CLASSES.index(name)
    return table


_CLASS = _class_table()
_STOPS = np.unique(Words([" ".join(STOP_WORDS).encode()]).keys)
FEATURES = len(_CLASSES) + 11


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of content statistics for each whole text."""
    out = [np.empty((0, FEATURES))]
    for run in pieces(texts):
        w, n = Words(run), len(run)
        size = np.array([len(t) for t in run], np.int64)
        owner = np.repeat(np.arange(n), size + 1)  # each text with the break after it
        classes = np.bincount(owner * len(_CLASSES) + _CLASS[w.raw[1:]], minlength=n * len(_CLASSES)).reshape(n, -1)
        classes[:, _CLASSES.index("line")] -= 1
        chars = np.maximum(size, 1)[:, None]
        words = np.maximum(w.counts, 1)
        doc = np.repeat(np.arange(n), w.counts)
        by_doc = lambda x, doc=doc, n=n: np.bincount(doc, weights=x, minlength=n)
        same = np.append(False, (w.keys[1:] == w.keys[:-1]) & (doc[1:] == doc[:-1])) if len(doc) else np.empty(0, bool)
        salt = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        distinct = lambda k: np.bincount(doc[np.unique(k, return_index=True)[1]], minlength=n)  # noqa: B023, E731
        one = distinct(w.keys ^ salt)
        two = distinct((w.keys * np.uint64(3) + np.append(np.uint64(0), w.keys[:-1])) ^ salt) if len(doc) else one
        long = (w.ends - w.starts).astype(np.float64)
        last = _CLASS[w.raw[np.maximum(w.ends - 1, 0)]]
        first = _CLASS[w.raw[w.starts]]
        stop = _STOPS[np.minimum(np.searchsorted(_STOPS, w.keys), len(_STOPS) - 1)] == w.keys
        letter = _CLASSES.index("high")
        mean = by_doc(long) / words
        lines = classes[:, _CLASSES.index("line")] + 1
        out.append(np.column_stack([
            np.sqrt(classes / chars), np.log1p(w.counts), mean,
            np.sqrt(np.maximum(by_doc(long ** 2) / words - mean ** 2, 0)), by_doc(same) / words, one / words, two / words,
            by_doc(stop) / words, by_doc((last > letter).astype(float)) / words,
            by_doc((first == _CLASSES.index("upper")).astype(float)) / words, np.log1p(words / lines),
            by_doc((long == 1).astype(float)) / words]))
    return np.concatenate(out)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Hashed language and source, and the recorded length; nulls are a value."""
    x = np.zeros((len(lang), 16 + _HASHED + 3))
    for r, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        x[r, xxhash.xxh64_intdigest(repr(a), SEED) % 16] = 1
        x[r, 16 + xxhash.xxh64_intdigest(repr(b), SEED) % _HASHED] = 1
        size = np.log1p(max(c, 0)) if c is not None else 0.0
        x[r, -3:] = c is None, size, size * size / 10
    return x


class Logistic:
    """L2-regularised logistic regression, inputs standardised."""

    def __init__(self, n: float, total: np.ndarray, squares: np.ndarray):
        self.mean = total / n
        self.scale = np.maximum(np.sqrt(np.maximum(squares / n - self.mean ** 2, 0.0)), 1e-6)
        self.beta = np.zeros(len(total) + 1)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z])

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """What rows add to the slope and the bend of the loss."""
        a = self._inputs(x)
        p = 1 / (1 + np.exp(-np.clip(a @ self.beta, -30, 30)))
        return [a.T @ (weight * (p - y)), (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a]

    def step(self, slope: np.ndarray, bend: np.ndarray, ridge: float) -> bool:
        """A step of Newton's method; whether it was the last."""
        penalty = np.full(len(self.beta), ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve(bend + np.diag(penalty), slope + penalty * self.beta)
        self.beta = self.beta - step
        return bool(np.abs(step).max() < 1e-6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(x) @ self.beta, -30, 30)


#: Some rows: both views, the label (not a number: a row of the pool) and whether the row may be held out.
Part = tuple[list[np.ndarray], np.ndarray, np.ndarray]
#: The sums over all rows of what a function gives for each part.
Total = Callable[[Callable[[Part], list[np.ndarray]]], list[np.ndarray]]


def _fitted(total: Total, of: Callable[[Part], list[tuple]], ridge: float) -> list[Logistic]:
    """Models fitted together, each on the inputs, labels and weights that ``of`` gives for it."""
    sums = total(lambda part: [s for x, _, _ in of(part) for s in (np.array([float(len(x))]), x.sum(axis=0), (x * x).sum(axis=0))])
    models = [Logistic(sums[k][0], *sums[k + 1:k + 3]) for k in range(0, len(sums), 3)]
    going = list(range(len(models)))
    for _ in range(30):
        if not going:
            break
        sums = total(lambda part, now=tuple(going): [s for k, rows in enumerate(of(part)) if k in now for s in models[k].sums(*rows)])
        going = [k for i, k in enumerate(tuple(going)) if not models[k].step(sums[2 * i], sums[2 * i + 1], ridge)]
    return models


def _calibrations(total: Total, of: Callable[[Part], list[tuple]], ridge: float) -> list[Logistic]:
    """As ``_fitted`` for models of one logit, in one pass: logits are summed by class in ``_CELLS`` cells,
    of which the mean counts for all that lie there."""
    def count(part: Part) -> list[np.ndarray]:
        out = []
        for z, t in of(part):
            at = np.minimum(((z + 30.0) / 60.0 * _CELLS).astype(np.int64), _CELLS - 1)
            out.append(np.array([len(z), z.sum(), (z * z).sum()]))
            for c in (0, 1):
                out += [np.bincount(at[t == c], minlength=_CELLS).astype(np.float64), np.bincount(at[t == c], z[t == c], _CELLS)]
        return out

    sums, models = total(count), []
    for k in range(0, len(sums), 5):
        model, weight = Logistic(sums[k][0], *(np.array([x]) for x in sums[k][1:])), np.concatenate(sums[k + 1:k + 5:2])
        use = weight > 0
        x, y = np.concatenate(sums[k + 2:k + 5:2])[use] / weight[use], np.repeat([0.0, 1.0], _CELLS)[use]
        for _ in range(30):
            if model.step(*model.sums(x[:, None], y, weight[use]), ridge):
                break
        models.append(model)
    return models


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


#: Cells of a logit between -30 and 30.
_CELLS = 8192
#: A logit from which a prediction is sure, as numbers of three digits in base ``_BASE`` up to the largest logit.
_SURE, _BASE, _DIGITS = float(np.log(SURE / (1 - SURE))), 4096, 3


def _sureness(logit: np.ndarray) -> np.ndarray:
    """Sure logits as whole numbers; -1: not sure."""
    at = np.floor((logit - _SURE) / (30.0 - _SURE) * (_BASE ** _DIGITS - 1)).astype(np.int64)
    return np.where(_probability(logit) >= SURE, np.maximum(at, 0), -1)


class CoTrained:
    """Both views, their calibrations and the combination."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS):
        """From rows that are here, in the order of a hash."""
        n = len(pool[0])
        part = [np.concatenate(x) for x in zip(views, pool, strict=True)], np.append(y, np.full(n, np.nan)), np.append(np.arange(len(y)) % 4 == 0, np.zeros(n, bool))
        self._fit(lambda fn: fn(part), rounds)

    @classmethod
    def over(cls, total: Total, rounds: int = ROUNDS) -> CoTrained | None:
        """From rows of which only sums are here; None if they don't hold both classes."""
        model = cls.__new__(cls)
        return model if model._fit(total, rounds) else None

    def _fit(self, total: Total, rounds: int) -> bool:
        def count(part: Part) -> list[np.ndarray]:
            _, y, held = part
            return [np.array([(held & (y == c)).sum() for c in (0, 1)] + [(~held & (y == c)).sum() for c in (0, 1)] + [np.isnan(y).sum()])]

        *by_class, pool = total(count)[0].tolist()
        if not by_class[0] + by_class[2] or not by_class[1] + by_class[3]:
            return False
        hold = all(by_class)  # else all labelled rows fit and calibrate
        known = lambda part: ~np.isnan(part[1])
        calibrates = lambda part: known(part) & (part[2] | (not hold))
        most = int(GIVEN * max(1.0, pool / POOL))
        past: list[tuple] = []  # of each round: both views as they were, and the least sureness that was given on
        for r in range(rounds + 1):
            def taught(part: Part, past: tuple = tuple(past)) -> list[tuple]:
                own = known(part) & ~(part[2] & hold)
                out = []
                for v, given in enumerate(_given(past, part)):
                    use = own | ~np.isnan(given)
                    out.append((part[0][v][use], np.where(own, part[1], given)[use], np.where(own, 1.0, PSEUDO_WEIGHT)[use]))
                return out

            self.models = models = _fitted(total, taught, 1.0)

            def marked(part: Part, models: list = models) -> list[tuple]:
                cal = calibrates(part)
                return [(m.logit(x[cal]), part[1][cal]) for m, x in zip(models, part[0], strict=True)]

            self.calibrated = _calibrations(total, marked, 1e-3)
            if r < rounds:
                now = [(m, c) for m, c in zip(self.models, self.calibrated, strict=True)]
                past.append((now, _least(total, now, most)))

        def both(part: Part, view=self._view) -> list[tuple]:
            cal = calibrates(part)
            return [(np.column_stack([view(v, part[0][v][cal]) for v in (0, 1)]), part[1][cal], np.ones(cal.sum()))]

        self.combine, = _fitted(total, both, 1e-3)
        return True

    def _view(self, v: int, x: np.ndarray) -> np.ndarray:
        return self.calibrated[v].logit(self.models[v].logit(x)[:, None])

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self._view(0, text), self._view(1, meta)
        return _probability(a), _probability(b), _probability(self.combine.logit(np.column_stack([a, b])))


def _given(past: tuple, part: Part) -> list[np.ndarray]:
    """The pseudo-labels that each view has been given by the other; not a number: none."""
    views, y, _ = part
    given = [np.full(len(y), np.nan) for _ in views]
    pool = np.isnan(y)
    for now, least in past:
        for v, (model, calibrated) in enumerate(now):
            z = calibrated.logit(model.logit(views[v])[:, None])
            for c, sure in ((1, _sureness(z)), (0, _sureness(-z))):
                given[1 - v][pool & np.isnan(given[1 - v]) & (sure >= least[v][c])] = c
    return given


def _least(total: Total, now: list[tuple], most: int) -> list[list[int]]:
    """By view and class the sureness of the last row of the pool that is given: there are ``most``, digit by digit."""
    wanted = [(v, c) for v in range(len(now)) for c in (0, 1)]
    found, left = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, most)
    for digit in reversed(range(_DIGITS)):
        def count(part: Part, digit: int = digit, found: dict = dict(found)) -> list[np.ndarray]:
            views, y, _ = part
            out = []
            for v, c in wanted:
                model, calibrated = now[v]
                z = calibrated.logit(model.logit(views[v][np.isnan(y)])[:, None])
                sure = _sureness(z if c else -z)
                same = sure[(sure >= 0) & (sure // _BASE ** (digit + 1) == found[v, c])]
                out.append(np.bincount(same // _BASE ** digit % _BASE, minlength=_BASE))
            return out

        for key, n in zip(wanted, total(count), strict=True):
            above = np.cumsum(n[::-1])
            k = int(np.searchsorted(above, left[key]))  # digits from the top until there are enough
            if k < _BASE:
                left[key] -= int(above[k] - n[::-1][k])
            found[key] = found[key] * _BASE + max(_BASE - 1 - k, 0)
    return [[found[v, c] for c in (0, 1)] for v in range(len(now))]


_META = ("lang", "source", "n_chars")


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, order, text, meta): features of rows (doc_id, text, lang, source, n_chars), one row
    for each id, and the id's place in the order of a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(slices(b, 1, _TOGETHER) for b in batches):
            x = text_features(utf8(b.column(1)))
            m = meta_features(*(b.column(k).to_pylist() for k in (2, 3, 4)))
            codes = np.column_stack([m[:, :16].argmax(axis=1), m[:, 16:16 + _HASHED].argmax(axis=1), m[:, -3:]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array([r.tobytes() for r in x], pa.binary()),
                                              pa.array([r.tobytes() for r in codes], pa.binary()),
                                              pa.array([xxhash.xxh64_intdigest(b"%d" % i) - 2 ** 63 for i in b.column(0).to_pylist()], pa.int64())],
                                             ["doc_id", "h", "text", "meta", "order"])

    made = docs.select("doc_id", "text", *_META, F.xxhash64("text", *_META).alias("h")).mapInArrow(
        releasing(run), "doc_id long, h long, text binary, meta binary, order long")
    one = made.groupBy("doc_id").agg(F.min_by(F.struct("order", "text", "meta"), "h").alias("r"))
    return one.select("doc_id", "r.*")


def _total(rows: DataFrame) -> Total:
    """Sums over feature rows (text, meta, y, held) that stay in the tasks."""
    def total(fn: Callable[[Part], list[np.ndarray]]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                n = b.num_rows
                text, codes = (np.frombuffer(b"".join(b.column(k).to_pylist())).reshape(n, width) for k, width in ((0, FEATURES), (1, 5)))
                meta = np.zeros((n, 16 + _HASHED + 3))
                meta[np.arange(n), codes[:, 0].astype(int)] = 1
                meta[np.arange(n), 16 + codes[:, 1].astype(int)] = 1
                meta[:, -3:] = codes[:, 2:]
                y = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                got = fn(([text, meta], y, b.column(3).to_numpy(zero_copy_only=False).astype(bool)))
                out = got if out is None else [a + c for a, c in zip(out, got, strict=True)]
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["s"])

        parts = [pickle.loads(r[0]) for r in rows.mapInArrow(run, "s binary").collect()]  # one row a task
        return [sum(x) for x in zip(*parts, strict=True)]

    return total


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """A model for these labels; None if they don't hold both classes.

    Labels other than 0 and 1, labels of ids not in ``docs`` and null ids are
    ignored; for an id with several labels the least counts."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
             .where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y")))
    if marks.agg(F.count_distinct("y")).first()[0] < 2:
        return None
    rows = _feature_rows(_typed(docs).where("doc_id is not null")).join(marks, "doc_id", "left")
    rows = materialize(rows.select("doc_id", "order", "text", "meta", F.col("y").cast("double").alias("y")), "quality-rows")
    place = row_index(rows.where("y is not null").select("doc_id", "order"), ["order", "doc_id"], name="place", start=0)
    held = place.select("doc_id", (F.col("place") % 4 == 0).alias("held"))  # every fourth labelled row
    rows = materialize(rows.join(held, "doc_id", "left").select("text", "meta", "y", F.coalesce("held", F.lit(False)).alias("held")), "quality-rows")
    return None if rows.isEmpty() else CoTrained.over(_total(rows))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with text_score, meta_score, score (probabilities of quality 1)
    and ``keep``, which is whether the score reaches one half.

    Every row is returned, repeated ones and those without id too. Null text is
    empty text; null metadata is a value of its own, and so is a missing column of
    metadata. Columns of ``docs`` with the names of the new ones are replaced, all
    others pass through. Without labels of both classes all scores are 1.0."""
    added = ["text_score", "meta_score", "score", "keep"]
    for name, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    kept = [f for f in docs.schema if f.name not in added]
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in kept]
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(kept)),
                        "text_score double, meta_score double, score double, keep boolean"])
    inputs = [F.col(c).cast(k).alias(f"own_{c}") for c, k in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(slices(b, len(names), _TOGETHER) for b in batches):
            a, own = b.columns[:len(names)], b.columns[len(names):]
            scores = [np.ones(b.num_rows)] * 3
            if shared.value is not None:
                scores = shared.value.scores(text_features(utf8(own[0])), meta_features(*(c.to_pylist() for c in own[1:])))
            yield pa.RecordBatch.from_arrays([*a, *map(pa.array, scores), pa.array(scores[2] >= KEEP)],
                                             [*b.schema.names[:len(names)], *added])

    plain = docs.select(*[F.col(named(c)).alias(f"c{k}") for k, c in enumerate(names)], *inputs)
    return plain.mapInArrow(releasing(run), schema).toDF(*names, *added)
