"""Quality rules: base text rules and tokeniser fertility against rejection bands.

For each vocabulary the whole text is tokenised and three figures are taken:
code points per token (fertility), the share of tokens that are no valid UTF-8
of their own (byte fallback) and the Shannon entropy of the tokens in bits. A
document whose figures leave the band of its language, or else of its dominant
script, is rejected. Text that the vocabulary knows (natural words) has long
tokens and varied ones; markup debris, shouting and repetition have not.
Bands apply from a least number of tokens on, as short texts scatter.

One narrow map; no shuffle and no state between rows, so neither copies nor a
large source make a hot task. Vocabulary files are read on the driver, checked
for size and broadcast.

Defined edge cases: a null or empty text has zero counts and fails the base
rules (fewer than ten words); repeated rows give repeated results; long texts
are tokenised in pieces cut where the vocabulary's own pattern cuts, so tokens
are those of the whole text, whatever the length of its words and blanks.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, held, slices, texts_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Texts are cut into pieces of about so many characters.
PIECE_CHARS = 50_000

# Fixed value: the published pre-tokenisation pattern of the vocabularies, and one that makes the same pieces without stepping back.
PUBLISHED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


#: White space by Unicode's property, as the pattern has it. The library's regular expressions fail on runs of a million, so long ones are
#: taken out: the pattern makes one piece of a run less its last character, which goes with what follows.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


@dataclass(frozen=True)
class Band:
    """Accepted figures; those of fewer than ``min_tokens`` tokens are not judged.

    Entropy floors are pairs (least tokens, bits): a text of n tokens can't have more than log2(n) bits.
    """

    min_fertility: float
    max_fertility: float
    max_fallback: float
    min_entropy: tuple[tuple[int, float], ...] = ((50, 4.6), (200, 5.8))
    min_tokens: int = 100


#: Bands by language, then by script; scripts from leading code points of ranges.
BANDS: dict[str, Band] = {
    "en": Band(2.25, 8.0, 0.10),
    "de": Band(2.30, 8.0, 0.15),
    "es": Band(2.10, 8.0, 0.15),
    "fr": Band(2.05, 8.0, 0.15),
    "latin": Band(1.90, 8.0, 0.25),
    "cyrillic": Band(0.80, 8.0, 0.70),
    "greek": Band(0.60, 8.0, 0.80),
    "arabic": Band(0.60, 8.0, 0.80),
    "hebrew": Band(0.50, 8.0, 0.90),
    "indic": Band(0.30, 8.0, 1.00),
    "cjk": Band(0.30, 4.0, 1.00),
    "hangul": Band(0.30, 4.0, 1.00),
    "other": Band(0.20, 12.0, 1.00),
}

SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"),
    (0x0E00, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "cjk"), (0xA4D0, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "cjk"), (0x32000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPT_STARTS], dtype=np.uint32)
_SCRIPTS = list(dict.fromkeys(n for _, n in SCRIPT_STARTS))
_SCRIPT_OF = np.array([_SCRIPTS.index(n) for _, n in SCRIPT_STARTS])


def dominant_script(text: str) -> str:
    """The script of most letters; Latin if there are none."""
    if text.isascii():
        return "latin"
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = cps[(cps > 0xBF) | ((cps | 32) - 97 < 26)]
    if not len(letters):
        return "latin"
    return _SCRIPTS[int(np.bincount(_SCRIPT_OF[np.searchsorted(_STARTS, letters, side="right") - 1], minlength=len(_SCRIPTS)).argmax())]


class Vocabulary:
    """A byte-level rank file with what its token ids say about fallback."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.fallback = np.zeros(max(table.values()) + 1, dtype=bool)
        for token, i in table.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.fallback[i] = True

    def ids(self, text: str) -> np.ndarray:
        out = []
        for x in pieces(text):
            at = 0
            for m in _BLANKS.finditer(x) if len(x) >= 5_000 else ():
                end = m.end() - (m.end() < len(x))
                out += [self.encoding.encode_to_numpy(x[at : m.start()], disallowed_special=()), np.array(self.encoding._encode_single_piece(x[m.start() : end]), np.uint32)]
                at = end
            out.append(self.encoding.encode_to_numpy(x[at:], disallowed_special=()))
        return np.concatenate(out)

    def measure(self, text: str) -> tuple[int, float, float, float]:
        """Tokens, code points a token, share of fallback tokens, entropy in bits."""
        ids = self.ids(text)
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0
        ids.sort()
        counts = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
        return n, len(text) / n, float(self.fallback[ids].mean()), float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a long text before spaces that follow another character, where every token ends; a piece may be longer than ``size`` if it holds no such place."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.rfind(" ", start + 1, start + size)
        while cut > start and text[cut - 1].isspace():
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            cut = text.find(" ", start + size)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def accepted(band: Band, n: int, fertility: float, fallback: float, entropy: float) -> bool:
    if n >= band.min_tokens and (not band.min_fertility <= fertility <= band.max_fertility or fallback > band.max_fallback):
        return False
    return not any(n >= least and entropy < bits for least, bits in band.min_entropy)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    if len(set(grams)) < len(grams):
        times, end = Counter(grams), 0
        for i, g in enumerate(grams):
            if times[g] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _vocabularies(files: Sequence[bytes]) -> list[Vocabulary]:
    return [held("quality", hash(x), lambda: Vocabulary(x)) for x in files]  # noqa: B023


FIGURES = "array<struct<n_tokens: long, fertility: double, fallback: double, entropy: double>>"
RESULT = f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, fertility {FIGURES}, kept boolean"


def assess(
    docs: DataFrame,
    vocab_paths: Sequence[str],
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    lang_col: str | None = "lang",
    bands: dict[str, Band] | None = None,
    only_kept: bool = False,
) -> DataFrame:
    """Judge every row's whole text.

    Returns the columns ``keep`` and the counts, the figures for each
    vocabulary and the verdict. The bands judge the first vocabulary's figures;
    those of the others are reported. A band is chosen by the language label
    if it has one, else by the dominant script. With ``only_kept`` the columns
    ``keep`` of the accepted rows are returned and nothing else.
    """
    files = []
    for path in vocab_paths:
        with open(path, "rb") as f:
            files.append(f.read())
    if sum(map(len, files)) > BROADCAST_BYTES:
        raise ValueError("the vocabularies are too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(files)
    bands = bands or BANDS
    fields = [docs.schema[c] for c in keep]
    needed = [F.col(c) for c in keep] + [F.col(text_col), F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")]
    schema = T.StructType(fields if only_kept else [*fields, *T._parse_datatype_string(RESULT).fields])
    figures = pa.list_(pa.struct([("n_tokens", pa.int64()), ("fertility", pa.float64()), ("fallback", pa.float64()), ("entropy", pa.float64())]))
    types = [pa.int64()] * 5 + [pa.bool_(), pa.string(), figures, pa.bool_()]
    n = len(fields)

    def run(batches):
        vocabularies = _vocabularies(shared.value)
        for part in slices(batches, n):
            rows = []
            for text, lang in zip(texts_of(part, n), part.column(n + 1).to_pylist(), strict=True):
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                if failed and only_kept:
                    rows.append((False,))
                    continue
                script = dominant_script(text)
                seen = [v.measure(text) for v in vocabularies]
                good = not failed and accepted(bands.get(lang) or bands[script], *seen[0])
                rows.append((*counts, failed, script, [dict(zip(("n_tokens", "fertility", "fallback", "entropy"), x, strict=True)) for x in seen], good))
            own = [part.column(i) for i in range(n)]
            if only_kept:
                yield pa.RecordBatch.from_arrays(own, names=list(keep)).filter(pa.array([r[-1] for r in rows], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.names)

    renamed = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(needed)))
    return renamed.mapInArrow(run, schema)


def verdicts(assessed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return assessed.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The base columns; the method's figures are beyond SQL.
BASE_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win SEMI JOIN twice USING (r, s)) GROUP BY r),
line AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(again.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN again USING (r) LEFT JOIN line USING (r)
"""
