"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

A letter is a code point of Unicode's letter or mark categories; punctuation, quotation marks and dashes of any kind are not. Words are runs of
letters, and a word's script is that of most of its letters, by fixed ranges of code points.
The script narrows the candidates: only languages written in it are scored, by
the sum of the log-probabilities of the word's hashed letter trigrams. Viterbi
over the words of the whole text, with a fixed penalty for each change of
language, labels spans; the language of most letters is the prediction.

Training counts trigrams and scripts over a sample of labelled rows, about
``TRAIN_ROWS`` of each language by a hash of id and text, so that a language is
learnt however rare it is. Sampled texts are read whole and counted where they
are; the driver gets counts, a fixed number for each language.

Most texts are in one language. With ``best`` the language of the highest
total, if no stretch of words favours another language over it by more than
half the penalty, the constant path is optimal: a path leaves it by segments,
each gaining at most half a penalty and, as soon as there is a second segment
or a return, costing one. Only the other texts go through the dynamic program.

One narrow map; no shuffle and no state between rows. The model has a fixed
size for each language and is broadcast up to a checked size.

Defined edge cases: null, empty and letterless texts are ``und`` with score 0
and no spans; without labelled rows every text is ``und``; repeated rows give
repeated results; the whole text is read, whatever its length.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, slices, texts_of

#: Rows of each language that are learnt from, about; all if there are fewer.
TRAIN_ROWS = 4_000
BITS = 16
#: Log-probability units lost at a change of language.
SWITCH_PENALTY = 12.0
#: Score of a letter for a language that isn't written in the word's script: lower than any trigram's.
RULED_OUT = -40.0
#: A language is written in a script that has this share of its letters.
SCRIPT_SHARE = 0.002

# First code points of ranges of scripts, after the Unicode blocks.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"),
    (0x0780, "thaana"), (0x07C0, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2D80, "ethiopic"),
    (0x2DE0, "cyrillic"), (0x2E00, "han"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "han"), (0x31A0, "bopomofo"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAB00, "ethiopic"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = list(dict.fromkeys(name for _, name in SCRIPT_STARTS))

#: Script of each code point that is a letter or a mark of one, else ``NONE``; made when first needed.
NONE = 255
_table: list[np.ndarray] = []


def scripts_of(points: np.ndarray) -> np.ndarray:
    if not _table:
        table = np.full(0x110000, NONE, np.uint8)
        letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x33480)])
        starts = np.array([s for s, _ in SCRIPT_STARTS])
        own = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS], np.uint8)
        at = np.flatnonzero(letter)
        table[at] = own[np.searchsorted(starts, at, side="right") - 1]
        _table.append(table)
    return _table[0][points]


@dataclass
class Letters:
    """Letter trigrams around each letter of joined texts, and the words they form."""

    hashes: np.ndarray
    scripts: np.ndarray  # of each letter
    first: np.ndarray  # index of each word's first letter
    word_doc: np.ndarray  # text of each word
    word_script: np.ndarray  # of most of the word's letters

    @classmethod
    def of(cls, texts: list[str]) -> Letters:
        low = [t.lower() for t in texts]
        joined = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(np.array([len(t) + 1 for t in low], dtype=np.int64)) + 1
        script = scripts_of(joined)
        letter = script != NONE
        wide = np.where(letter, joined, 32).astype(np.uint64)
        code = ((wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        at = np.flatnonzero(letter[1:-1])  # position - 1
        first = np.flatnonzero(~letter[at])
        own = script[at + 1]
        return cls(code[at].astype(np.int64), own, first, np.searchsorted(ends, at[first] + 1, side="right"), majority(own, first))


def majority(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The script of most letters of each word, the first of equals."""
    if not len(first):
        return np.zeros(0, np.int64)
    low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
    out = low.astype(np.int64)
    for w in np.flatnonzero(low != high):
        end = first[w + 1] if w + 1 < len(first) else len(own)
        out[w] = np.bincount(own[first[w] : end]).argmax()
    return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (2**BITS, languages), float32 log-probabilities
    written: np.ndarray  # (scripts, languages): is the language a candidate?

    @classmethod
    def of_counts(cls, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> Model:
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        written = share >= SCRIPT_SHARE
        written[~written.any(axis=1)] = True  # a script that no language is known to use rules out none
        smooth = 0.5
        p = np.log(counts + smooth) - np.log(counts.sum(axis=0) + smooth * (1 << BITS))
        return cls(languages, p.astype(np.float32), written)

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> Model:
        languages = sorted({lang for _, lang in rows})
        counts, scripts = np.zeros((1 << BITS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
        for k, lang in enumerate(languages):
            x = Letters.of([text for text, own in rows if own == lang])
            counts[:, k] = np.bincount(x.hashes, minlength=1 << BITS)
            scripts[:, k] = np.bincount(x.scripts, minlength=len(SCRIPTS))
        return cls.of_counts(languages, counts, scripts)

    def word_scores(self, x: Letters) -> np.ndarray:
        """Scores of each word for its candidates; others are ruled out by their letters' number."""
        n = len(x.first)
        if not n or not self.languages:
            return np.zeros((n, len(self.languages)), np.float32)
        groups = {}
        for script in np.unique(x.word_script):
            groups.setdefault(self.written[script].tobytes(), []).append(script)
        if len(groups) == 1 and self.written[x.word_script[0]].all():
            return np.add.reduceat(self.scores[x.hashes], x.first, axis=0)
        size = np.diff(np.append(x.first, len(x.hashes)))
        out = np.repeat((RULED_OUT * size).astype(np.float32)[:, None], len(self.languages), axis=1)
        for key, own in groups.items():
            candidates = np.flatnonzero(np.frombuffer(key, bool))
            words = np.flatnonzero(np.isin(x.word_script, own))
            letters = np.repeat(np.isin(x.word_script, own), size)
            begin = np.concatenate(([0], np.cumsum(size[words])[:-1]))
            out[words[:, None], candidates] = np.add.reduceat(self.scores[x.hashes[letters]][:, candidates], begin, axis=0)
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of one text."""
    n, k = scores.shape
    rows = scores.tolist()
    value = rows[0]
    back = [list(range(k))]
    for row in rows[1:]:
        top = max(value)
        lead = value.index(top)
        top -= penalty
        back.append([j if v >= top else lead for j, v in enumerate(value)])
        value = [(v if v >= top else top) + s for v, s in zip(value, row)]
    state = value.index(max(value))
    out = np.zeros(n, dtype=np.int16)
    for i in range(n - 1, -1, -1):
        out[i] = state
        state = back[i][state]
    return out


def label(model: Model, texts: list[str], penalty: float) -> list[tuple[str, float, list[dict]]]:
    """For each text: language, score, spans of words."""
    x = Letters.of(texts)
    scores = model.word_scores(x)
    size = np.diff(np.append(x.first, len(x.hashes)))
    bounds = np.searchsorted(x.word_doc, np.arange(len(texts) + 1))
    out = []
    for d, text in enumerate(texts):
        a, b = bounds[d], bounds[d + 1]
        if a == b or not model.languages or not any(map(str.isalpha, text)):
            out.append(("und", 0.0, []))
            continue
        s = scores[a:b]
        total = s.sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        ahead = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
        floor = np.minimum.accumulate(np.minimum(ahead, 0), axis=0)
        rise = np.maximum(ahead[0], 0)
        if b - a > 1:
            rise = np.maximum(rise, (ahead[1:] - floor[:-1]).max(axis=0))
        n = size[a:b]
        if rise.max() <= penalty / 2:
            pred, share, spans = best, 1.0, [{"start": 0, "end": int(b - a), "lang": model.languages[best]}]
        else:
            path = viterbi(s, penalty)
            weight = np.bincount(path, weights=n, minlength=len(model.languages))
            pred = int(weight.argmax())
            share = float(weight[pred] / weight.sum())
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), int(b - a)]
            spans = [{"start": p, "end": q, "lang": model.languages[path[p]]} for p, q in zip(cuts, cuts[1:], strict=False)]
        sure = np.exp(total - total.max())
        sure = float(sure[pred] / sure.sum()) if pred == best else share
        out.append((model.languages[pred], min(1.0, share * sure), spans))
    return out


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> Model:
    """Count over about ``rows`` rows of each language, by a hash of id and text; texts are read whole and stay where they are."""
    named = labelled.where(F.col(lang_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    totals = {r.l: r.n for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row for each language
    languages = sorted(totals)
    size = len(languages) * ((1 << BITS) * 4 + len(SCRIPTS))
    if size > BROADCAST_BYTES:
        raise ValueError(f"a model of {len(languages)} languages is too large to broadcast")
    if not languages:
        return Model.train([])
    place = {lang: k for k, lang in enumerate(languages)}
    least = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, -(1 << 63) + int(min(1, rows / n) * ((1 << 64) - 1)))))
    width = (1 << BITS) + len(SCRIPTS)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches, 0, 1 << 20):
            texts, langs = texts_of(part, 0), part.column(1).to_pylist()
            for lang in set(langs):
                x = Letters.of([t for t, own in zip(texts, langs, strict=True) if own == lang])
                counts.setdefault(lang, np.zeros(width, np.int64))
                counts[lang] += np.concatenate((np.bincount(x.hashes, minlength=1 << BITS), np.bincount(x.scripts, minlength=len(SCRIPTS))))
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place[lang], np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["l", "i", "n"])

    counted = named.where(F.col("h") <= least[F.col("l")]).select("t", "l").mapInArrow(run, "l int, i int, n long").groupBy("l", "i").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # a fixed number of rows for each language
    counts = np.zeros((width, len(languages)))
    counts[table["i"].to_numpy(), table["l"].to_numpy()] = table["n"].to_numpy()
    return Model.of_counts(languages, counts[: 1 << BITS], counts[1 << BITS :])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Label every row's whole text: ``keep`` and ``lang_pred``, ``score``, ``spans`` (first and exclusive last word, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>").fields])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for part in slices(batches, n, 1 << 20):
            lang, score, found = zip(*label(shared.value, texts_of(part, n), penalty), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(n)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(found, spans)], names=schema.names
            )

    return docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate([*keep, text_col]))).mapInArrow(run, schema)


def predict(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out, and label all."""
    marked = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), held_out.alias("held_out"))
    model = fit(marked.where(~F.col("held_out")), id_col, text_col, lang_col)
    return identify(marked, model, (id_col, "held_out"), text_col).select(id_col, "held_out", "lang_pred", "score", "spans")
