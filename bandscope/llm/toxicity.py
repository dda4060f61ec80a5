"""Toxicity by a support vector machine on a gapped-subsequence string kernel.

The kernel of two strings sums, over all subsequences of three letters, the
product of their weights in both; an occurrence spanning ``s`` characters
weighs ``DECAY ** s`` (``s`` up to ``SPAN``). Inserted characters and
separators thus only fade a match: ``i.d.i.o.t`` stays close to its plain form.
Kernels are normalised.

A sentence is a set of words; the kernel of two sentences is the sum of their
words' kernels over the root of both numbers of words, so a word is a sentence
of one. Sentences end with a word that ends in a full stop or the like, or after
``SENTENCE_WORDS`` words.

Training uses a bounded sample of labelled documents (``TRAIN_EACH`` of either
label, by a hash of the id) of any length; of one with over ``TRAIN_SENTENCES``
sentences those of least hash. The machine's instances are labelled sentences:
all of clean documents are negative, and of a toxic document those that the
machine itself finds positive, at least its worst one and at most
``POSITIVE_EACH`` (in the first round, those with words of high log-odds
between the two labels). Such words (in several toxic documents) are positive
as sentences of one word too, also in disguised variants, and words of clean
documents negative. Features are Nyström approximations over ``LANDMARKS``
landmark words; later rounds choose the positive sentences anew and add the
negatives that score highest. A document is then described by the highest margin
of its words, each as a sentence of its own, and by the sum of its words' margins
over a floor, plain and against its length, and a logistic map fitted on the
sample turns that into a score. Words add up; their order has no part.

Letters are those of every script. Triples of Latin letters have a place of
their own each, all others share ``WIDE`` places by a hash. Hangul is taken apart
into its letters, and scripts written without spaces are cut into windows.

The trained expansion over landmarks is linear in the subsequence weights, so it
is folded into one table of ``PLACES`` numbers: scoring a new word needs no landmark.

One narrow map; no shuffle, no state between rows, a fixed-size model. Words
that a worker has met are remembered in bounded memory.

Defined edge cases: null and empty texts and texts without a word of three
letters have no margin and get the score of the lowest margin; without labels
of both kinds every score is about 0 (4e-18); repeated rows give repeated results.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_share, slices, texts_of

DECAY = 0.7
SPAN = 7
TRAIN_EACH = 2_000
TRAIN_SENTENCES = 200
SENTENCE_WORDS = 40
LANDMARKS = 240
ROUNDS = 2
HARD = 2_000
PLAIN = 3_000
POSITIVE_EACH = 5
#: Log-odds from which a word is a witness.
WITNESS = 1.8
PRIOR = 7
#: Margins count as evidence from here.
EVIDENCE = 0.0
THRESHOLD = 0.7
#: Margins below this are reported as this.
FLOOR = -1.5
PIECE, STRIDE, LONG = 24, 12, 40
MEMO_WORDS = 400_000

_GAPS = [(g, h) for g in range(1, SPAN - 1) for h in range(1, SPAN - g)]
_LOOKALIKE = dict(zip("0134578@$!", "oieastbasi", strict=True))
LATIN = 26**3
WIDE = 1 << 16
PLACES = LATIN + WIDE


def _spelling(c: str) -> bool:
    """Letters, and marks that spell (vowel signs and the like, but no accents or optional vowel points)."""
    kind, rank = unicodedata.category(c)[0], unicodedata.combining(c)
    return kind == "L" or (kind == "M" and (rank < 10 or 84 <= rank <= 132) and not 0xFE00 <= ord(c) <= 0xFE0F)


class _Letters(dict):
    """For ``str.translate``; what isn't in it yet is a letter of its own, letters of a Hangul syllable, or a gap."""

    def __missing__(self, c: int) -> str:
        found = "\0" if c < 128 or not _spelling(chr(c)) else unicodedata.normalize("NFD", chr(c)) if 0xAC00 <= c <= 0xD7A3 else chr(c)
        self[c] = found
        return found


_CODES = _Letters(
    str.maketrans(
        {c: chr(i + 1) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
        | {k: chr(ord(v) - 96) for k, v in _LOOKALIKE.items()}
        | {chr(c): chr(ord(base) - 96) for r in ((0xC0, 0x180), (0x1E00, 0x1F00), (0xFF41, 0xFF5B)) for c in range(*r) if "a" <= (base := unicodedata.normalize("NFKD", chr(c))[0].lower()) <= "z"}
    )
)
#: Signs that end a sentence, at the end of a word of over two characters.
_STOPS = tuple(".!?\u2026\u3002\uff01\uff1f\u0964\u061f")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M" and _spelling(chr(c)))
_WIDE_EDGES = re.compile(rf"^(?:(?![{_SIGNS}])[\W_])+|(?:(?![{_SIGNS}])[\W_])+$")
#: Runs in scripts without spaces: of syllables and ideographs, cut into windows of three, and of alphabets, cut into windows of six.
_UNSPACED = re.compile("([\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{4,})|([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]{7,})")


def bare(word: str) -> str:
    """The word without outer punctuation."""
    return (_EDGES if word.isascii() else _WIDE_EDGES).sub("", word)


def _windows(word: str) -> list[str]:
    """A word with its runs in scripts without spaces cut into overlapping windows."""
    out, at = [], 0
    for m in _UNSPACED.finditer(word):
        run, size = m[0], 3 if m[1] else 6
        out += [word[at : m.start()], *(run[i : i + size] for i in range(len(run) - size + 1))]
        at = m.end()
    return [w for w in [*out, word[at:]] if w]


def words_of(text: str) -> list[str]:
    """Lower-case words, and runs of four or more single characters joined with their gaps."""
    words = text.lower().split()
    if not text.isascii() and _UNSPACED.search(text):
        words = [x for w in words for x in _windows(w)]
    short = [i for i, w in enumerate(words) if len(w) <= 2]
    run: list[int] = []
    for i in [*short, -9] if len(short) > 3 else ():
        single = i >= 0 and len(bare(words[i])) == 1
        if single and (not run or run[-1] == i - 1):
            run.append(i)
            continue
        if len(run) >= 4:
            words.append(".".join(words[j] for j in run))
        run = [i] if single else []
    return words


def ends_sentence(word: str) -> bool:
    return len(word) > 2 and word.rstrip("\"'\u201d\u2019)").endswith(_STOPS)


def starts_of(ends: np.ndarray) -> np.ndarray:
    """Where sentences start in a run of words, of which ``ends`` says whether each ends one."""
    fresh = np.flatnonzero(np.concatenate(([True], ends[:-1])))
    at = np.arange(len(ends)) - np.repeat(fresh, np.diff(np.append(fresh, len(ends))))
    return np.flatnonzero(at % SENTENCE_WORDS == 0)


def codes_of(word: str) -> str:
    """Latin letters as 1 to 26, others as they are, other inner characters as gaps, without outer punctuation."""
    return bare(word).translate(_CODES)


def pieces_of(word: str) -> list[str]:
    code = codes_of(word[:LONG]) if len(word) <= LONG else codes_of(word)
    if len(code) <= LONG:
        return [code]
    return [code[i : i + PIECE] for i in range(0, len(code) - STRIDE, STRIDE)]


def _hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The shared places of triples with letters beyond a to z."""
    h = (a.astype(np.uint64) << np.uint64(42)) | (b.astype(np.uint64) << np.uint64(21)) | c.astype(np.uint64)
    return LATIN + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)


def subsequences(codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number, triple and weight of each occurrence of a gapped triple."""
    pad = "\0" * SPAN
    c = np.frombuffer((pad.join(codes) + pad).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    wide = len(c) and int(c.max()) > 26
    ends = np.cumsum([len(x) + SPAN for x in codes])
    own = np.repeat(np.arange(len(codes)), [len(x) + SPAN for x in codes])
    assert len(own) == len(c) == ends[-1]
    who, what, weight = [], [], []
    for g, h in _GAPS:
        n = len(c) - g - h
        a, b, d = c[:n], c[g : g + n], c[g + h :]
        at = np.flatnonzero((a > 0) & (b > 0) & (d > 0))
        who.append(own[at])
        a, b, d = a[at], b[at], d[at]
        place = (a - 1) * 676 + (b - 1) * 26 + d - 1
        what.append(np.where((a | b | d) > 31, _hashed(a, b, d), place) if wide else place)
        weight.append(np.full(len(at), DECAY ** (g + h + 1), dtype=np.float32))
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


def norms(who: np.ndarray, what: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The norm of each string's feature vector."""
    if not len(who):
        return np.zeros(n)
    key = who.astype(np.int64) * PLACES + what
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total = np.add.reduceat(weight[order].astype(np.float64), first)
    return np.sqrt(np.bincount(key[first] // PLACES, weights=total * total, minlength=n))


def dense(codes: list[str]) -> np.ndarray:
    """Normalised feature vectors, one row for each string."""
    who, what, weight = subsequences(codes)
    out = np.zeros((len(codes), PLACES), dtype=np.float32)
    np.add.at(out, (who, what), weight)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(length, 1e-12)


@dataclass
class Model:
    table: np.ndarray  # float32, PLACES
    bias: float
    slope: np.ndarray
    shift: float

    def values(self, words: list[str], over: float | None = None) -> np.ndarray:
        """The margin of each word without the bias, 0 without features; with ``over``, words that can't have a margin over it get ``over``'s value."""
        pieces = [pieces_of(w) for w in words]
        codes = [p for x in pieces for p in x]
        owner = np.repeat(np.arange(len(words)), [len(x) for x in pieces])
        n = len(codes)
        out = np.full(len(words), -np.inf if n else 0.0)
        if not n:
            return out
        who, what, weight = subsequences(codes)
        raw = np.bincount(who, weights=self.table[what] * weight, minlength=n)
        maybe = np.ones(n, bool)
        if over is not None:
            least = np.sqrt(np.bincount(who, weights=weight.astype(np.float64) ** 2, minlength=n))
            maybe = (raw > 0) & (raw / np.maximum(least, 1e-12) + self.bias > over)
        picked = maybe[who]
        exact = norms(who[picked], what[picked], weight[picked], n)
        np.maximum.at(out, owner, np.where(maybe, raw / np.maximum(exact, 1e-12), (over or 0.0) - self.bias))
        return out

    def margins(self, words: list[str]) -> list[float]:
        """The margin of each word as a sentence of its own; only words that may exceed the floor need their exact norm."""
        return np.maximum(self.values(words, FLOOR) + self.bias, FLOOR).tolist()

    def probability(self, summary: np.ndarray) -> np.ndarray:
        """Scores of rows made by ``summary``."""
        return 1 / (1 + np.exp(-np.clip(summary @ self.slope + self.shift, -40, 40)))


def sentence_margins(values: np.ndarray, starts: np.ndarray, bias: float) -> np.ndarray:
    """Margins of sentences by the values of their words."""
    n = np.add.reduceat((values != 0).astype(np.int64), starts)
    return np.add.reduceat(values, starts) / np.sqrt(np.maximum(n, 1)) + bias


def summary(margins: np.ndarray) -> tuple[float, float, float]:
    """What the margins of a document's words say: the highest, and the evidence, on a log scale and against the length."""
    if not len(margins):
        return FLOOR, 0.0, 0.0
    evidence = float(np.maximum(margins - EVIDENCE, 0).sum())
    return float(margins.max()), float(np.log1p(evidence)), evidence / float(np.sqrt(len(margins)))


EMPTY = Model(np.zeros(PLACES, np.float32), FLOOR, np.zeros(3), -40.0)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-4) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last coefficient is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    v = np.zeros(x.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(30):
        active = y * (x @ v) < 1
        a, w = x[active], weight[active, None]
        step = np.linalg.solve(a.T @ (a * w) + np.diag(penalty), (a * w).T @ y[active])
        if np.abs(step - v).max() < 1e-6:
            return step
        v = step
    return v


def _disguised(word: str, k: int) -> str:
    """A training variant of a word: a character inserted, or separators throughout."""
    if k == 0:
        return ".".join(word)
    at = 1 + k % max(1, len(word) - 1)
    return word[:at] + "-*xq"[k % 4] + word[at:]


def sentences_of(text: str, words: int = SENTENCE_WORDS) -> list[str]:
    """Sentences; one of more than so many words is cut."""
    out = []
    for s in _SENTENCES.split(text):
        w = s.split()
        out += [s] if len(w) <= words else [" ".join(w[i : i + words]) for i in range(0, len(w), words)]
    return out


def sampled(text: str, most: int = TRAIN_SENTENCES) -> str:
    """The text, or so many of its sentences by a hash."""
    own = sentences_of(text)
    if len(own) <= most:
        return text
    kept = sorted(range(len(own)), key=lambda i: (zlib.crc32(own[i].encode("utf-8", "surrogatepass")), i))[:most]
    return "\n".join(own[i] for i in sorted(kept))


def _best_of_each(margins: np.ndarray, owner: np.ndarray, least: float) -> np.ndarray:
    """Of each document's sentences those over ``least``, at most ``POSITIVE_EACH``, and the best one in any case."""
    order = np.lexsort((np.arange(len(owner)), -margins, owner))
    fresh = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1])))
    rank = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order))))
    return np.sort(order[(rank == 0) | ((rank < POSITIVE_EACH) & (margins[order] > least))])


class _Part:
    """The sentences of the documents of one label, as numbers of words."""

    def __init__(self, docs: list[np.ndarray], ends: np.ndarray):
        self.docs = docs
        own = [starts_of(ends[d]) if len(d) else np.zeros(0, np.int64) for d in docs]
        self.words = np.concatenate([np.zeros(0, np.int32), *docs])
        offset = np.cumsum([0, *(len(d) for d in docs)])
        self.starts = np.concatenate([np.zeros(0, np.int64), *(s + o for s, o in zip(own, offset, strict=False))])
        self.owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
        self.stops = np.append(self.starts[1:], len(self.words))

    def margins(self, values: np.ndarray, bias: float) -> np.ndarray:
        return sentence_margins(values[self.words], self.starts, bias)

    def features(self, chosen: np.ndarray, project) -> np.ndarray:
        """Features of the chosen sentences; ``project`` gives those of word numbers."""
        size = self.stops[chosen] - self.starts[chosen]
        first = np.cumsum(size) - size
        words = self.words[np.repeat(self.starts[chosen] - first, size) + np.arange(size.sum())]
        own, at = np.unique(words, return_inverse=True)
        x = project(own)
        n = np.add.reduceat(x.any(axis=1)[at].astype(np.int64), first)
        out = np.stack([np.add.reduceat(x[at, j], first) for j in range(x.shape[1])], axis=1)
        return out / np.sqrt(np.maximum(n, 1))[:, None]


def train(texts: list[str], labels: list[int]) -> Model:
    number: dict[str, int] = {}
    docs: tuple[list, list] = [], []
    for t, y in zip(texts, labels, strict=True):
        docs[not y].append(np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32))
    vocabulary = list(number)
    ends = np.fromiter(map(ends_sentence, vocabulary), bool, len(vocabulary))
    toxic, clean = (_Part(d, ends) for d in docs)
    if not len(toxic.words) or not len(clean.words):
        return EMPTY
    rng = np.random.default_rng(7)
    plain_form = [bare(w) for w in vocabulary]
    in_toxic, in_clean = (Counter(w for d in part.docs for w in {plain_form[i] for i in np.unique(d)}) for part in (toxic, clean))
    negatives = sorted(w for w in in_clean if len(codes_of(w)) >= 3)
    share = len(toxic.docs) / len(texts)

    def odds(w: str) -> float:
        """Log-odds of a word between toxic and clean documents, shrunk as by ``PRIOR`` documents without a preference."""
        return float(np.log((in_toxic[w] + PRIOR * share) / (in_clean[w] + PRIOR * (1 - share))) - np.log(share / (1 - share)))

    ranked = sorted(((odds(w), n, w) for w, n in in_toxic.items() if n > 1 and len(codes_of(w)) >= 3), reverse=True)
    found = {w: n for o, n, w in ranked if o >= WITNESS} or {w: n for o, n, w in ranked[:5] if o > 0}
    positives = sorted(found, key=lambda w: (-found[w], w))[:1_000]
    disguised = positives[:40]
    bad = [*positives, *(_disguised(w, k) for w in disguised for k in range(6))]
    count = np.array([found[w] for w in positives] + [found[w] / 12 for w in disguised for _ in range(6)], dtype=float)
    first = {w: o for o, _, w in ranked if w in found}
    values, bias = np.array([first.get(w, 0.0) for w in plain_form]), 0.0
    hard: list[str] = []
    harder = np.zeros(0, np.int64)
    model: Model | None = None
    for _ in range(ROUNDS):
        if model is not None:
            scored = _values(model, negatives)
            hard = [negatives[i] for i in np.argsort(-scored, kind="stable")[:HARD]]
            values, bias = _values(model, vocabulary), model.bias
            harder = np.argsort(-clean.margins(values, bias), kind="stable")[:HARD]
        chosen = _best_of_each(toxic.margins(values, bias), toxic.owner, 0.0)
        others = np.union1d(harder, rng.choice(len(clean.starts), min(len(clean.starts), PLAIN), replace=False))
        some = [negatives[i] for i in rng.choice(len(negatives), min(len(negatives), PLAIN), replace=False)]
        good = [w for w in dict.fromkeys([*hard, *some]) if w not in found]
        half = [*positives, *(w for _, _, w in ranked if w not in found)][: LANDMARKS // 2]
        landmarks = list(dict.fromkeys([*half, *good]))[:LANDMARKS]
        if not landmarks:
            return EMPTY
        marks = dense([codes_of(w) for w in landmarks])
        value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        kept = value > 1e-6
        white = vector[:, kept] / np.sqrt(value[kept])
        project = lambda words: against(marks, [codes_of(w) for w in words]) @ white  # noqa: B023, E731
        by_number = lambda numbers: project([vocabulary[i] for i in numbers])  # noqa: B023, E731
        instances = [project(bad), toxic.features(chosen, by_number), project(good), clean.features(others, by_number)]
        often = np.sqrt([1.0 + in_clean[w] for w in good])
        # Every toxic document weighs the same, whatever the number of its positive sentences.
        each = 1 / np.bincount(toxic.owner[chosen], minlength=len(toxic.docs))[toxic.owner[chosen]]
        weight = np.concatenate([0.25 * w / max(w.sum(), 1e-12) for w in (count, each, often, np.ones(len(others)))])
        y = np.repeat([1.0, 1.0, -1.0, -1.0], [len(x) for x in instances])
        v = _svm(np.vstack(instances), y, weight)
        model = Model((white @ v[:-1] @ marks).astype(np.float32), float(v[-1]), np.zeros(3), 0.0)
    margins = np.maximum(_values(model, vocabulary, FLOOR) + model.bias, FLOOR)
    told = np.array([summary(margins[d]) for part in (toxic, clean) for d in part.docs])
    model.slope, model.shift = _logistic(told, np.repeat([1.0, 0.0], [len(toxic.docs), len(clean.docs)]))
    return model


def against(marks: np.ndarray, codes: list[str], step: int = 500) -> np.ndarray:
    """Normalised kernels of strings with the landmarks."""
    columns, out = np.ascontiguousarray(marks.T), np.zeros((len(codes), len(marks)))
    for at in range(0, len(codes), step):
        part = codes[at : at + step]
        who, what, weight = subsequences(part)
        order = np.argsort(who, kind="stable")
        length = np.maximum(norms(who, what, weight, len(part)), 1e-12)
        who, rows = who[order], columns[what[order]] * weight[order, None]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, int)
        if len(first):
            out[at + who[first]] = np.add.reduceat(rows, first, axis=0) / length[who[first], None]
    return out


def _values(model: Model, words: list[str], over: float | None = None) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.values(words[i : i + 10_000], over) for i in range(0, len(words), 10_000))])


#: Weight of the squared coefficients in the loss of the logistic map.
MAP_RIDGE = 0.05


def map_loss(v: np.ndarray, a: np.ndarray, y: np.ndarray) -> float:
    """The penalised loss of the logistic map, convex in ``v``."""
    z = a @ v
    return float((np.logaddexp(0, z) - y * z).sum() + MAP_RIDGE / 2 * v @ v)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the map from a document's summary to its probability, lightly regularised.

    Newton steps, halved while they don't lower the loss: it is convex and its penalty makes it strictly so, so they end at its one
    minimum whatever the labels are, inseparable ones included. Raises if they don't.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(a.shape[1])
    loss = map_loss(v, a, y)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -500, 500)))
        slope = a.T @ (p - y) + MAP_RIDGE * v
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + MAP_RIDGE * np.eye(len(v)), -slope)
        falls = float(slope @ step)
        if -falls <= 1e-12 * (1 + loss):
            return v[:-1], float(v[-1])
        size = 1.0
        while (now := map_loss(v + size * step, a, y)) > loss + 1e-4 * size * falls and size > 1e-10:
            size /= 2
        if now >= loss:
            return v[:-1], float(v[-1])  # no step lowers it: the minimum, to the last digit
        v, loss = v + size * step, now
    raise ArithmeticError("the logistic map didn't converge")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = TRAIN_EACH) -> Model:
    """Fit on a bounded sample: about ``each`` labelled ids of either label by a hash of the id, one text of each, twice as many at most."""
    ids = []
    for y in (1, 0):
        own = labels.where(F.col(label_col) == y).select(F.col(id_col).alias("k"))
        some = own.where(hash_share(own, each, "k")).distinct().select("k", F.lit(y).alias("y"), F.xxhash64("k").alias("h"))
        ids.append(some.orderBy("h", "k").limit(2 * each))
    chosen = ids[0].unionByName(ids[1])

    def run(batches):
        for part in slices(batches, 3):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([sampled(t) for t in texts_of(part, 3)], pa.string())], names=["h", "k", "y", "t"])

    joined = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")  # at most four times ``each`` rows of three numbers
    kind = dict(joined.dtypes)["k"]
    short = joined.select("h", "k", "y", "t").mapInArrow(run, f"h long, k {kind}, y int, t string")
    # Of rows with the same id, the text of least hash.
    sample = short.groupBy("h", "k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    rows = sorted(sample.collect(), key=lambda r: (r.h, r.k, r.y))
    return train([r.t for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every row's whole text: ``keep`` and ``score``, ``predicted``, ``worst`` (the word of the highest margin, null if none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("score double, predicted int, worst string").fields])

    def run(batches):
        memo: dict[str, float] = {}
        model = shared.value
        for part in slices(batches, n, 1 << 20):
            words = [words_of(t) for t in texts_of(part, n)]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = list(set().union(*words).difference(memo))
            for i in range(0, len(new), 5_000):
                memo.update(zip(new[i : i + 5_000], model.margins(new[i : i + 5_000]), strict=True))
            margins = [np.fromiter(map(memo.__getitem__, w), float, len(w)) for w in words]
            worst = [w[int(m.argmax())] if len(w) and m.max() > FLOOR else None for m, w in zip(margins, words, strict=True)]
            p = model.probability(np.array([summary(m) for m in margins])).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(n)), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(worst, pa.string())], names=schema.names
            )

    return docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate([*keep, text_col]))).mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labels of the ids that ``held_out(id)`` leaves, and score all rows."""
    model = fit(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col)
    marked = docs.select(F.col(id_col), F.col(text_col), held_out(F.col(id_col)).alias("held_out"))
    return score(marked, model, (id_col, "held_out"), text_col)
