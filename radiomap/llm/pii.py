"""Personal data by a linear-chain conditional random field over word shapes.

The exact patterns of each kind give the base spans. The field adds what they
miss, such as a number that greedy matching has merged with its neighbour. It is
trained here, from the small labelled table that ``labelled_rows`` lays out by
rule: number and address forms in contexts, with look-alikes that are no
personal data. Tokens are runs of non-space characters; a token's features are
its shape, a few checks of its digits, and the same of the tokens around it.

A token without a digit or an ``@`` is never part of a span. Between two spans
such tokens are certain, so the best path over a text falls into independent
segments between them; only these are decoded, by Viterbi over numpy batches of
segments of like length. Whole texts are read; nothing is cut.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.text import carried, releasing, slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]+")
SEED = 6
#: Bytes of text read together, and tokens whose features are laid out together.
_TOGETHER, _RUN = 4 << 20, 4096
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern matches from left to right, in time linear in the text: the
    local part is the longest run before an @ that no match has used."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            used = domain.end()
            yield start, used
        at = text.find("@", max(at + 1, used))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, ordered."""
    if not _HINT.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def core(token: str) -> tuple[int, int]:
    """The part of a token without the punctuation around it: (start, end)."""
    lo, hi = 0, len(token)
    while lo < hi and not (token[lo].isalnum() or token[lo] in "+("):
        lo += 1
    while hi > lo and not (token[hi - 1].isalnum() or token[hi - 1] == ")"):
        hi -= 1
    return lo, hi


_RUNS = ((re.compile(r"[0-9]{9,}"), "N"), (re.compile(r"[0-9]{4,8}"), "n"), (re.compile(r"[0-9]{2,3}"), "D"),
         (re.compile(r"[0-9]"), "D"))
_LETTERS = re.compile(r"[^\W\d_]+")


def shape(token: str) -> str:
    """Letters as a, digit runs as D, n or N by length, other characters kept;
    longer shapes end in a star."""
    lo, hi = core(token)
    s = _LETTERS.sub("a", token[lo:min(hi, lo + 200)])
    for pattern, mark in _RUNS:
        s = pattern.sub(mark, s)
    return s if len(s) <= 24 else s[:24] + "*"


_CHECKS = 12


def checks(token: str) -> list[bool]:
    lo, hi = core(token)
    t = token[lo:hi]
    digits = _NOT_DIGIT.sub("", t) if len(t) <= 60 else ""
    parts = t.split(".")
    mail = len(t) <= 400 and any(True for _ in _emails(t))
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    plain = bool(t) and not _LETTERS.search(t[:200])
    card = plain and 12 <= len(digits) <= 19 and luhn(digits)
    return [mail, quad, card, plain and t[:1] == "+", plain and len(digits) == 4, plain and len(digits) == 3,
            plain and 9 <= len(digits) <= 15 and not card, plain and len(digits) > 19, t[:1] == "(", "-" in t and plain,
            not plain and bool(digits), plain and 12 <= len(digits) <= 19 and not card]


class Field:
    """A linear-chain CRF: weights of features by label, and of label pairs."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], steps: int = 120, rate: float = 0.3, ridge: float = 1e-3):
        shapes = sorted({shape(t) for tokens, _ in rows for t in tokens})
        self.shapes = {s: i for i, s in enumerate(shapes)}
        self.own = len(shapes) + 1 + _CHECKS
        x = [self.features(tokens) for tokens, _ in rows]
        n, k = len(LABELS), max(len(t) for t, _ in rows)
        inputs, gold, mask = np.zeros((len(rows), k, x[0].shape[1])), np.zeros((len(rows), k), int), np.zeros((len(rows), k), bool)
        for r, (f, (_, y)) in enumerate(zip(x, rows, strict=True)):
            inputs[r, :len(y)], gold[r, :len(y)], mask[r, :len(y)] = f, y, True
        self.emit, self.move = np.zeros((inputs.shape[2], n)), np.zeros((n, n))
        moments = [np.zeros_like(p) for p in (self.emit, self.move, self.emit, self.move)]
        for step in range(1, steps + 1):
            grads = self._gradient(inputs, gold, mask)
            for p, g, m, v in zip((self.emit, self.move), grads, moments[:2], moments[2:], strict=True):
                g = g / len(rows) + ridge * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        starts = [LABELS.index(f"B-{k}") for k in KINDS]
        for b in starts:  # a span goes on only in its own kind
            self.move[[i for i in range(n) if i not in (b, b + 1)], b + 1] = -1e4

    def features(self, tokens: list[str]) -> np.ndarray:
        """A row for each token: own features, those of its neighbours, a constant."""
        own = np.zeros((len(tokens) + 2, self.own))
        for i, t in enumerate(tokens):
            own[i + 1] = _own_features(t, self)
        return np.concatenate([own[1:-1], own[:-2], own[2:], np.ones((len(tokens), 1))], axis=1)

    def _weights(self, tokens: list[str]) -> np.ndarray:
        """Each token's weight for each label; features are laid out for a run of tokens at a time."""
        out = np.empty((len(tokens), len(LABELS)))
        for start in range(0, len(tokens), _RUN):
            before, stop = max(start - 1, 0), start + _RUN
            rows = self.features(tokens[before:stop + 1])[start - before:]
            out[start:stop] = rows[:len(out[start:stop])] @ self.emit
        return out

    def _gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log-likelihood, by the forward and backward recursions."""
        emit = x @ self.emit
        rows, k, n = emit.shape
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        total = lambda a, axis: np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis)) + a.max(axis=axis)
        for t in range(1, k):
            nxt = emit[:, t] + total(ahead[:, t - 1, :, None] + self.move, 1)
            ahead[:, t] = np.where(mask[:, t, None], nxt, ahead[:, t - 1])
        for t in range(k - 2, -1, -1):
            prv = total(self.move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], prv, 0)
        whole = total(ahead[:, -1], 1)
        p = np.exp(np.minimum(ahead + back - whole[:, None, None], 0)) * mask[:, :, None]
        hot = np.eye(n)[y] * mask[:, :, None]
        pairs = np.zeros((n, n))
        for t in range(1, k):
            both = ahead[:, t - 1, :, None] + self.move + (emit[:, t] + back[:, t])[:, None, :] - whole[:, None, None]
            both = np.exp(np.minimum(both, 0)) * mask[:, t, None, None]
            pairs += both.sum(axis=0) - np.einsum("ri,rj->ij", hot[:, t - 1], hot[:, t])
        return np.einsum("rkf,rkn->fn", x, p - hot), pairs

    def decode(self, segments: list[list[str]]) -> list[list[int]]:
        """The best labels of every segment, in batches of like length."""
        out: list[list[int]] = [[] for _ in segments]
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        start = 0
        while start < len(order):
            first = len(segments[order[start]])
            stop = start
            while stop < len(order) and len(segments[order[stop]]) <= 1.25 * first and (stop - start + 1) * first <= 40_000:
                stop += 1
            batch = order[start:max(stop, start + 1)]
            for i, labels in zip(batch, self._viterbi([segments[i] for i in batch]), strict=True):
                out[i] = labels
            start += len(batch)
        return out

    def _viterbi(self, batch: list[list[str]]) -> list[list[int]]:
        """Segments stand between certain O tokens, whose weights to and from O enter."""
        sizes = np.array([len(s) for s in batch])
        flat = np.concatenate([self._weights(s) for s in batch])
        k, n = int(sizes.max()), len(LABELS)
        emit = np.zeros((len(batch), k, n))
        inside = np.arange(k) < sizes[:, None]
        emit[inside] = flat
        best = emit[:, 0] + self.move[0]
        from_ = np.zeros((len(batch), k, n), np.int8)
        for t in range(1, k):
            way = best[:, :, None] + self.move
            from_[:, t] = way.argmax(axis=1)
            best = np.where(inside[:, t, None], way.max(axis=1) + emit[:, t], best)
        label = (best + self.move[:, 0]).argmax(axis=1)
        path = np.zeros((len(batch), k), int)
        for t in range(k - 1, -1, -1):
            path[:, t] = label
            label = np.where(inside[:, t] & (t > 0), from_[np.arange(len(batch)), t, label], label)
        return [p[:s].tolist() for p, s in zip(path, sizes, strict=True)]


@lru_cache(maxsize=50_000)
def _cached(token: str) -> tuple[str, tuple[bool, ...]]:
    return shape(token), tuple(checks(token))


def _own_features(token: str, field: Field) -> np.ndarray:
    s, c = _cached(token) if len(token) <= 100 else (shape(token), tuple(checks(token)))
    x = np.zeros(field.own)
    x[field.shapes.get(s, len(field.shapes))] = 1
    x[len(field.shapes) + 1:] = c
    return x


def _number(draw: random.Random, valid: bool) -> str:
    n = draw.choice((13, 14, 15, 16, 16, 16, 19))
    body = "".join(draw.choice("0123456789") for _ in range(n - 1))
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if valid else str((int(check) + draw.randrange(1, 10)) % 10))


def labelled_rows(rows: int = 500) -> list[tuple[list[str], list[int]]]:
    """The labelled table: (tokens, labels), laid out by rule from a fixed seed."""
    draw = random.Random(SEED)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abdeghilmnorstu") for _ in range(draw.randrange(2, 9)))

    def email() -> list[str]:
        return [f"{word()}{draw.choice(('', '.', '_'))}{d(draw.randrange(3))}@{word()}{d(draw.randrange(2))}.{draw.choice(('com', 'org', 'example.com', 'net'))}"]

    def ip() -> list[str]:
        return [".".join(str(draw.randrange(256)) for _ in range(4))]

    def card() -> list[str]:
        n = _number(draw, True)
        if len(n) == 16 and draw.random() < 0.4:
            parts = [n[i:i + 4] for i in range(0, 16, 4)]
            return ["-".join(parts)]
        return [n]

    def phone() -> list[str]:
        form = draw.randrange(5)
        if form < 2:
            return [f"+{draw.randrange(1, 99)}", f"({d(3)})", f"{d(3)}-{d(4)}"]
        if form == 2:
            return [f"+{draw.randrange(1, 99)}-{d(3)}-{d(3)}-{d(4)}"]
        if form == 3:
            return [f"+{draw.randrange(1, 99)}", d(3), d(3), d(4)]
        return [f"+{d(11)}"]

    def decoy() -> list[str]:
        return [draw.choice((
            lambda: _number(draw, False), lambda: d(draw.randrange(1, 9)), lambda: f"{draw.randrange(9)}.{draw.randrange(9)}",
            lambda: f"{draw.randrange(9)}.{draw.randrange(20)}.{draw.randrange(20)}", lambda: f"19{d(2)}", lambda: f"20{d(2)}",
            lambda: f"{draw.randrange(300, 999)}.{draw.randrange(256)}.{draw.randrange(256)}.{draw.randrange(256)}",
            lambda: "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice((32, 40)))) + "0a",
            lambda: f"{d(draw.randrange(20, 30))}", lambda: f"@{word()}", lambda: f"{word()}{d(2)}", lambda: f"({d(3)})",
            lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(3)}-{d(4)}",
            lambda: f"{word()}@{word()}", lambda: d(draw.randrange(9, 16)) + "x", lambda: f"{d(2)}%", lambda: f"#{d(5)}"))()]

    table = []
    for _ in range(rows):
        tokens: list[str] = []
        labels: list[int] = []
        for _ in range(draw.randrange(1, 4)):
            kind = draw.randrange(7)
            made = (email, ip, card, phone, decoy, decoy, decoy)[kind]()
            tag = [0] * len(made) if kind > 3 else [1 + 2 * kind] + [2 + 2 * kind] * (len(made) - 1)
            if draw.random() < 0.3:
                made[-1] += draw.choice((",", ".", "!!", "###", ";", '"'))
            if draw.random() < 0.6:
                made, tag = [word(), *made], [0, *tag]
            tokens += made
            labels += tag
        table.append((tokens, labels))
    return table


def train() -> Field:
    return Field(labelled_rows())


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """By text, the field's spans that overlap no base span: (start, kind, end)."""
    segments, where = [], []
    for r, text in enumerate(texts):
        run: list[tuple[str, int]] = []
        for m in _TOKEN.finditer(text):
            if run and text[run[-1][1] + len(run[-1][0]):m.start()].strip():
                segments.append([t for t, _ in run])
                where.append((r, run))
                run = []
            run.append((m.group(), m.start()))
        if run:
            segments.append([t for t, _ in run])
            where.append((r, run))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (r, run), labels in zip(where, field.decode(segments), strict=True):
        i = 0
        while i < len(labels):
            if not labels[i] % 2:  # O, or the middle of no span
                i += 1
                continue
            j = i + 1
            while j < len(labels) and labels[j] == labels[i] + 1:
                j += 1
            lo, hi = run[i][1] + core(run[i][0])[0], run[j - 1][1] + core(run[j - 1][0])[1]
            if lo < hi and not any(s < hi and lo < e for s, _, e in base[r]):
                out[r].append((lo, (labels[i] - 1) // 2, hi))
            i = j
    return out


def _name(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _all_spans(texts: list[str], field: Field) -> tuple[list, list]:
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, field)
    return base, [sorted(a + b) for a, b in zip(base, more, strict=True)]


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    The counts and the digest are of base spans; ``spans`` holds all. Null text is
    empty text. Repeated rows and a null doc_id are returned as they come; other
    columns are ignored; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(slices(b, 1, _TOGETHER) for b in batches):
            base, every = _all_spans(_texts(b.column(1)), shared.value)
            counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_name(s).encode()).hexdigest() for s in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array(map(_name, every), pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        releasing(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans as the mark of its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced by marks such as [EMAIL].

    All rows and columns stay; ``n_chars``, where there is one, becomes the new
    length in rows that changed. Null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    source, others, schema = carried(docs, F.col("text").cast("string"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(slices(b, len(others), _TOGETHER) for b in batches):
            texts = _texts(b.column(len(others)))
            _, every = _all_spans(texts, shared.value)
            new = [replace(t, s) if s else old for t, s, old in zip(texts, every, b.column(len(others)).to_pylist(), strict=True)]
            size = [len(t) if s else None for t, s in zip(new, every, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(others)], pa.array(new, pa.string()), pa.array(size, pa.int64())],
                                             [*b.schema.names[:-1], "text", "size"])

    out = source.mapInArrow(releasing(run), schema + "text string, size long")
    new = {c: F.col(f"c{k}") for k, c in enumerate(others)} | {"text": F.col("text")}
    if "n_chars" in new:
        new["n_chars"] = F.coalesce("size", new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) for c in docs.columns])
