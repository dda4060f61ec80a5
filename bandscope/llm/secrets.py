"""Secret scans with DataFrame functions: fixed patterns, and entropy over sliding windows.

The patterns are credentials that follow a naming key (``assign``), access key
ids (``access``) and long hexadecimal runs (``hex``). The method adds spans of kind
``entropy``: candidate strings (runs of the base-64 alphabet that hold a digit
and a letter, outside the pattern spans) are slid over with a window of
``WINDOW`` characters. The window's character counts are packed, twelve to a
number, and the sum of c*log2(c) over them is kept up to date as one character
enters and one leaves: a step changes two counts. A string counts as random
where a window's entropy reaches the bound of its class (hexadecimal, mixed with
a digit, an upper- and a lower-case letter, or an unbroken run of digits and
letters of one case with letters between digits). Strings that match the allow list are suppressed, and
windows that touch a run or a sequence don't count; pattern spans never are.

Only built-in expressions over each row: no shuffle, no Python. All steps are
linear in the text, in the length of one string and, but for sorting, in the
number of spans.

Defined edge cases: a null or empty text has no spans; repeated rows give
repeated results; the whole text is read, strings of a megabyte too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .spans import apart, base_sql, let, listed, matches, prepared, replaced, with_kind

WINDOW = 20
#: Least entropy in bits of a window, by class.
BOUNDS = {"hex": 3.0, "mixed": 3.7, "single": 3.5}

# The patterns of the contract.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = "AKIA[A-Z0-9]{16,}+"  # a shorter run fails as a whole, so the length can stand in the pattern
HEX = "[0-9a-f]{24,}+"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ["assign", "access", "hex", "entropy"]

#: Strings that are no secrets: placeholders, universally unique ids.
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|lorem|x{6}",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Parts of strings that count in no window: counting-up runs, one character over and over.
PLAIN = r"0123456789|1234567890|abcdefghij|(.)\1{5,}"

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
#: Counts of five bits in one number, and the numbers that the alphabet takes.
PACK = 12
WORDS = -(-len(_ALPHABET) // PACK)
#: Characters of a string taken at once; the windows of neighbouring pieces overlap.
STRETCH = 4_096


def highest_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest entropy in bits over all windows of ``window`` (at most 30) characters of the alphabet above; -1 if there is none."""
    term = [0.0 if c < 2 else c * math.log2(c) for c in range(window + 2)]
    up = F.array(*(F.lit(b - a) for a, b in zip(term, term[1:], strict=False)))
    none = F.struct(F.array(*[F.lit(0).cast("bigint")] * WORDS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.floor(code / PACK).cast("int")), code % PACK * 5).bitwiseAND(31).cast("int")

    def one(code: Column, word: Column) -> Column:
        return F.when(word == F.floor(code / PACK).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), code % PACK * 5)).otherwise(F.lit(0).cast("bigint"))

    def step(codes: Column, acc: Column, i: Column) -> Column:
        enter, leave = F.get(codes, i), F.when(i >= window, F.get(codes, i - window))
        same = F.coalesce(enter == leave, F.lit(False))
        gone = F.when(leave.isNotNull(), -F.get(up, F.greatest(count(acc["counts"], leave) - 1, F.lit(0)))).otherwise(F.lit(0.0))
        total = F.when(same, acc["sum"]).otherwise(acc["sum"] + F.get(up, count(acc["counts"], enter)) + gone)
        counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, k: c + one(enter, k) - F.coalesce(one(leave, k), F.lit(0).cast("bigint"))))
        bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(-1.0))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    def of(part: Column) -> Column:
        codes = F.transform(F.split(part, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
        return let(codes, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), none, lambda acc, i: step(x, acc, i), lambda acc: acc["best"]))

    parts = F.regexp_extract_all(text, F.lit(f"(?=(.{{1,{STRETCH + window - 1}}})).{{1,{STRETCH}}}"), 1)
    return F.coalesce(F.array_max(F.transform(parts, of)), F.lit(-1.0))


def is_random(text: Column) -> Column:
    has = lambda x: F.rlike(text, F.lit(x))
    hexadecimal = has("^(?:[0-9a-f]+|[0-9A-F]+)$")

    def runs(case: str) -> Column:
        """Runs of digits and letters of one case, with letters between digits: words with a number at one end are no keys."""
        found = F.regexp_extract_all(text, F.lit(f"([{case}0-9]{{{WINDOW},}}+)"), 1)
        return F.filter(found, lambda w: F.rlike(w, F.lit(f"[0-9][{case}]+[0-9]")))

    return (
        F.when(hexadecimal, has("[0-9]") & has("[A-Fa-f]") & (highest_entropy(text) >= BOUNDS["hex"]))
        .when(has("[0-9]") & has("[a-z]") & has("[A-Z]"), highest_entropy(text) >= BOUNDS["mixed"])
        .otherwise(F.exists(F.concat(runs("a-z"), runs("A-Z")), lambda w: highest_entropy(w) >= BOUNDS["single"]))
    )


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """All columns of ``docs`` but the text, and ``out_col``: array of kind, start, end, text."""
    clean, base, extra = fresh(docs, "clean__", "base__", "extra__")
    allowed = "|".join(f"(?:{x})" for x in ALLOWED[:1]), *ALLOWED[1:]
    kept = [c for c in docs.columns if c != text_col]
    prefixed = docs.select(*kept, prepared(F.col(text_col)).alias(clean))
    assign = F.filter(matches(F.col(clean), ASSIGN), lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN_VALUE, 1)) >= 6)
    found = prefixed.select(
        *kept,
        F.concat(with_kind(assign, "assign"), with_kind(matches(F.col(clean), ACCESS, "AKIA"), "access"), with_kind(matches(F.col(clean), HEX), "hex")).alias(base),
        matches(F.col(clean), CANDIDATE).alias(extra),
    )

    def suppressed(text: Column) -> Column:
        out = F.lit(False)
        for pattern in allowed:
            out = out | F.rlike(text, F.lit(pattern))
        return out

    likely = F.filter(extra, lambda s: F.rlike(s["text"], F.lit("[0-9]")) & F.rlike(s["text"], F.lit("[A-Za-z]")) & ~suppressed(s["text"]))
    chosen = F.filter(apart(likely, F.col(base)), lambda s: F.exists(F.split(s["text"], PLAIN), is_random))
    return found.select(*kept, F.concat(F.col(base), with_kind(chosen, "entropy")).alias(out_col))


def digests(found: DataFrame, id_col: str = "doc_id", out_col: str = "secrets") -> DataFrame:
    n = lambda kind: F.size(F.filter(out_col, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(out_col, lambda s: s["kind"] != "entropy")
    return found.select(
        id_col,
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(listed(base, KINDS).cast("binary"), 256).alias("base_sha256"),
        listed(F.col(out_col), KINDS).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs``, with every secret in the text replaced by ``mask``; overlapping spans become one."""
    out, raw = fresh(docs, "secrets__", "raw__")
    found = find_secrets(docs.withColumn(raw, F.col(text_col)), text_col, out)
    text = replaced(F.col(raw), F.col(out), mask).alias(text_col)
    return found.select(*(text if c == text_col else F.col(c) for c in docs.columns))


#: The base columns; what the method adds is beyond SQL.
BASE_ORACLE = base_sql(
    [
        ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+)""", r"""length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ]
)
