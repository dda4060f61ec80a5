"""Personal data with DataFrame functions: fixed patterns and a weakly supervised span classifier.

Pattern spans (e-mail, IP, card and phone numbers) are always kept. The method
adds spans among candidates outside them: long numbers, account numbers and
titled names. Five labelers vote on every span, pattern spans included: for,
against or abstaining:

1. shape: the strict form of the kind;
2. gazetteer: issuer prefixes, country codes, top-level domains, titles;
3. checksum: Luhn for numbers;
4. context: a word before the span that announces personal data;
5. counter-context: a word or sign that announces a quantity or reference.

How often each combination of votes occurs is counted over all documents; that
table is bounded (kinds, length classes and 3**5 votes). Expectation-maximisation
on it estimates each labeler's reliability and the share of personal data
(``ROUNDS`` rounds inside one expression). The posteriors weigh the training of
the final classifier, a naive Bayes over kind, length class and votes, whose
probability must reach ``ACCEPT`` for a candidate to be added.

Only built-in expressions; the one shuffle moves pre-aggregated counts. The
texts are read once: spans and votes are written to the shared folder, and
counts and result come from there. All steps are linear in the text and, but for
sorting, in the number of spans.

Defined edge cases: a null or empty text has no spans; tables without any span
train nothing; repeated rows give repeated results; the whole text is read, with
names, numbers and addresses of a megabyte too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, stored
from .spans import apart, base_sql, listed, matches, prepared, with_kind

ROUNDS = 25
ACCEPT = 0.9
CONTEXT_CHARS = 32

# The patterns of the contract. A run that can't match from its start can't from within, so starts inside
# a run are skipped unless the last match ended there; this keeps long runs linear. A look at the first character comes before all else, as it rules out most places.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Candidates of the method. A number that a letter follows is matched with the letter and then dropped, so no start within it is tried.
NUMBER = r"(?=[0-9])(?<![0-9A-Za-z.])[0-9](?:[\x20./-]?[0-9]){8,}+[A-Za-z]?+"
ACCOUNT = r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?=[MDPHFS])(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++(?:\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++)?"

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "number", "account", "name"]
VOTES = 5

# The gazetteers.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRIES = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at)$"
CUES = r"(?i)\b(?:card|visa|account|konto|compte|cuenta|phone|tel|telefon|téléphone|teléfono|call|mobile|e-?mail|mail|contact|kontakt|ssn|iban|passport|born|address|name|customer)\b[^.!?]*$"
COUNTER = r"(?i)(?:[#$€£]|\b(?:order|item|page|version|isbn|build|total|sum|figure|chapter|ref|id)\b\W*)\s*$"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the check sum?"""
    n = F.char_length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def checked(number: Column) -> Column:
    """Is a string of digits as long as a card number, and does it pass the check sum?"""
    return F.when(F.char_length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))


def _found(clean: Column, pattern: str, kind: str, needs: str | None = None, good=None) -> Column:
    spans = matches(clean, pattern, needs, CONTEXT_CHARS)
    return with_kind(spans if good is None else F.filter(spans, good), kind, "before")


def base_spans(clean: Column) -> Column:
    return F.concat(
        _found(clean, EMAIL, "email", "@"),
        _found(clean, IP, "ip", ".", lambda s: F.rlike(s["text"], F.lit(OCTETS))),
        _found(clean, CARD, "card", None, lambda s: checked(digits(s["text"]))),
        _found(clean, PHONE, "phone", "+", lambda s: F.char_length(digits(s["text"])).between(9, 15)),
    )


def candidates(clean: Column) -> Column:
    return F.concat(_found(clean, NUMBER, "number", None, lambda s: F.rlike(s["text"], F.lit("[0-9]$"))), _found(clean, ACCOUNT, "account"), _found(clean, NAME, "name"))


def votes(span: Column) -> Column:
    """The five votes on a span: 1 for, -1 against, 0 abstaining."""
    kind, text, before = span["kind"], span["text"], span["before"]
    number = digits(text)
    numeric = kind.isin("card", "number")
    yes = lambda c: F.when(c, 1).otherwise(-1)
    strict = F.rlike(text, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"))
    shape = F.when(numeric, yes(strict)).when(kind == "name", F.lit(0)).otherwise(F.lit(1))
    known = (
        F.when(numeric, yes(F.rlike(number, F.lit(ISSUERS))))
        .when(kind == "account", yes(F.rlike(text, F.lit(COUNTRIES))))
        .when(kind == "email", yes(F.rlike(text, F.lit(DOMAINS))))
        .when(kind == "name", F.lit(1))
        .otherwise(F.lit(0))
    )
    check = F.when(numeric, yes(checked(number))).otherwise(F.lit(0))
    context = F.when(F.rlike(before, F.lit(CUES)), 1).otherwise(0)
    counter = F.when(F.rlike(before, F.lit(COUNTER)), -1).otherwise(0)
    return F.array(shape, known, check, context, counter)


def _posterior(pattern: str, theta: str) -> str:
    """Probability of personal data for a vote pattern; theta holds the share, then P(vote | no), then P(vote | yes)."""
    ratio = f"aggregate(sequence(0, {VOTES - 1}), ln((1 - {theta}[0]) / {theta}[0]), (s, j) -> s + ln({theta}[1 + j * 3 + {pattern}.v[j] + 1]) - ln({theta}[{1 + 3 * VOTES} + j * 3 + {pattern}.v[j] + 1]))"
    return f"1 / (1 + exp({ratio}))"


def estimated(column: str, rounds: int = ROUNDS) -> str:
    """Expectation-maximisation over an array of (v: votes, n: count), as one expression: the estimates."""
    start = ", ".join(["0.5D", *["0.5D, 0.3D, 0.2D"] * VOTES, *["0.2D, 0.3D, 0.5D"] * VOTES])
    weighed = f"transform({column}, p -> named_struct('v', p.v, 'n', p.n, 'q', {_posterior('p', 't')}))"
    part = "aggregate(w, 0D, (s, p) -> s + p.n * if(k < {half}, 1 - p.q, p.q){only})"
    half = 3 * VOTES
    entry = f"({part.format(half=half, only=f' * if(p.v[(k % {half}) div 3] + 1 = k % 3, 1, 0)')} + 1D) / ({part.format(half=half, only='')} + 3D)"
    share = "greatest(0.01D, least(0.99D, aggregate(w, 0D, (s, p) -> s + p.n * p.q) / greatest(1D, aggregate(w, 0D, (s, p) -> s + p.n))))"
    step = f"transform(array({weighed}), w -> concat(array({share}), transform(sequence(0, {2 * half - 1}), k -> {entry})))[0]"
    return f"aggregate(sequence(1, {rounds}), array({start}), (t, i) -> {step})"


def accepted_patterns(spans: DataFrame, accept: float = ACCEPT) -> list[str]:
    """Train on all spans (kind, size, v) and return the patterns, as text, whose probability reaches ``accept``: at most 7 kinds, 10 sizes and 3**5 votes."""
    counted = stored(spans.groupBy("kind", "size", "v").agg(F.count("*").cast("double").alias("n")))
    # One row: the table is bounded by kinds, length classes and votes.
    table = counted.groupBy("v").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("v", "n")).alias("patterns"))
    theta = table.select(F.expr(estimated("patterns")).alias("theta")).first().theta
    told = stored(counted.withColumn("theta", F.array(*map(F.lit, theta))).select("kind", "size", "v", "n", F.expr(_posterior("named_struct('v', v)", "theta")).alias("q")))
    features = F.array(F.concat(F.lit("kind "), "kind"), F.concat(F.lit("size "), F.col("size").cast("string")), *(F.concat(F.lit(f"vote {j} "), F.col("v")[j].cast("string")) for j in range(VOTES)))
    named = told.select("*", F.explode(features).alias("feature"))
    yes, no = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
    all_yes, all_no = told.agg(F.coalesce(F.sum(yes), F.lit(0.0)), F.coalesce(F.sum(no), F.lit(0.0))).first()
    weights = named.groupBy("feature").agg(F.sum(yes).alias("y"), F.sum(no).alias("z")).select("feature", (F.ln((F.col("y") + 1) / (all_yes + 3)) - F.ln((F.col("z") + 1) / (all_no + 3))).alias("weight"))
    scored = named.join(weights, "feature").groupBy("kind", "size", "v").agg(F.sum("weight").alias("weight"))
    odds = F.col("weight") + math.log((all_yes + 1) / (all_no + 1))
    good = [f"{r.kind} {r.size} {r.v}" for r in scored.where(1 / (1 + F.exp(-odds)) >= accept).select("kind", "size", "v").collect()]
    drop_stored(counted, told)
    return good


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """All columns of ``docs`` but the text, and ``out_col``: array of kind, start, end, text. The classifier is trained at once."""
    kept = [c for c in docs.columns if c != text_col]
    clean, base, extra = fresh(docs, "clean__", "base__", "extra__")
    prefixed = docs.select(*kept, prepared(F.col(text_col)).alias(clean))
    found = prefixed.select(*kept, base_spans(F.col(clean)).alias(base), candidates(F.col(clean)).alias(extra))
    outside = found.select(*kept, base, apart(F.col(extra), F.col(base)).alias(extra))
    size = lambda s: F.least(F.floor((s["end"] - s["start"]) / 4), F.lit(9)).cast("int")
    told = lambda c: F.transform(c, lambda s: F.struct(*(s[x].alias(x) for x in ("kind", "start", "end", "text")), size(s).alias("size"), votes(s).alias("v")))
    voted = stored(outside.select(*kept, told(F.col(base)).alias(base), told(F.col(extra)).alias(extra)))
    good = accepted_patterns(voted.select(F.explode(F.concat(base, extra)).alias("s")).select("s.kind", "s.size", "s.v"))
    name = lambda s: F.concat_ws(" ", s["kind"], s["size"].cast("string"), F.concat(F.lit("["), F.array_join(F.transform(s["v"], lambda x: x.cast("string")), ", "), F.lit("]")))
    added = F.filter(extra, lambda s: name(s).isin(good) if good else F.lit(False))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return voted.select(*kept, F.concat(plain(F.col(base)), plain(added)).alias(out_col))


def digests(found: DataFrame, id_col: str = "doc_id", out_col: str = "pii") -> DataFrame:
    n = lambda kind: F.size(F.filter(out_col, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(out_col, lambda s: s["kind"].isin(BASE))
    return found.select(id_col, *(n(k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base, KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.col(out_col), KINDS).alias("spans"))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 1 THEN TRY_CAST(c AS INT) ELSE 2 * TRY_CAST(c AS INT) - CASE WHEN c > '4' THEN 9 ELSE 0 END END for c, i in string_split(reverse({_DIGITS}), '')]) % 10 = 0"
#: The base columns; what the method adds is beyond SQL.
BASE_ORACLE = base_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max([coalesce(TRY_CAST(x AS BIGINT), 256) for x in string_split(m, '.')]) <= 255"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ]
)
