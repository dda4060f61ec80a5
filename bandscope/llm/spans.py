"""Spans of regular-expression matches with DataFrame functions only.

Spark's regular-expression functions return matched text, not its place. Here
each match is framed by two control characters, the framed text is split at
them, and the places follow from the pieces' lengths in code points. The two
characters are first replaced in the text by a third one of the same length;
no pattern used here matches any of the three, so the matches stay the same.

An array that grows by one element copies itself each time, so nothing here
grows an array over all pieces: pieces are taken in blocks of ``BLOCK``, and
what a block starts from is carried from block to block. A text of a megabyte
with a match every few characters costs seconds, not hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, NEUTRAL = "\u0001", "\u0002", "\u0003"
#: Pieces in a block; even, so that a block starts outside a match.
BLOCK = 256
ENDLESS = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def blocks(items: Column, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size`` elements."""

    def cut(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / size).cast("int")
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(x, b * size + 1, F.lit(size)))).otherwise(F.array(x))

    return let(items, cut)


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative operation over an array of longs, each element included."""
    start = F.lit(zero).cast("bigint")

    def grow(items: Column, first: Column) -> Column:
        return F.aggregate(items, F.array(first), lambda a, x: F.array_append(a, op(F.element_at(a, -1), x)))

    def within(parts: Column) -> Column:
        carried = grow(F.transform(parts, lambda p: F.aggregate(p, start, lambda a, x: op(a, x))), start)
        return let(carried, lambda first: F.flatten(F.transform(parts, lambda p, b: F.slice(grow(p, F.get(first, b)), F.lit(2), F.size(p)))))

    return let(blocks(values), within)


def prepared(text: Column) -> Column:
    """The text (null: empty) with the framing characters neutralised."""
    text = F.coalesce(text, F.lit(""))
    framed = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    return F.when(framed, F.translate(text, OPEN + CLOSE, NEUTRAL + NEUTRAL)).otherwise(text)


def matches(clean: Column, pattern: str, needs: str | None = None, context: int = 0) -> Column:
    """Leftmost non-overlapping matches in a prepared text: array of start, exclusive end, text.

    A text without the literal ``needs`` is not searched. With ``context`` a span also has ``before``: that many
    characters before it, or as many as there are.
    """
    fields = "start: bigint, end: bigint, text: string" + (", before: string" if context else "")
    empty = F.array().cast(f"array<struct<{fields}>>")

    def joined(a: Column, b: Column) -> Column:
        return F.right(F.concat(a, b), F.lit(context)) if context else a

    def state(at: Column, tail: Column) -> Column:
        return F.struct(at.alias("at"), tail.alias("tail"))

    def moved(acc: Column, part: Column) -> Column:
        return state(acc["at"] + F.char_length(part), joined(acc["tail"], part))

    start = state(F.lit(0).cast("bigint"), F.lit(""))

    def located(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, start, moved))
        firsts = F.aggregate(sums, F.array(start), lambda a, s: F.array_append(a, let(F.element_at(a, -1), lambda last: state(last["at"] + s["at"], joined(last["tail"], s["tail"])))))

        def block(part: Column, first: Column) -> Column:
            begin = F.struct(first["at"].alias("at"), first["tail"].alias("tail"), F.lit(False).alias("inside"), empty.alias("found"))

            def step(acc: Column, piece: Column) -> Column:
                end = acc["at"] + F.char_length(piece)
                own = [acc["at"].alias("start"), end.alias("end"), piece.alias("text"), *([acc["tail"].alias("before")] if context else [])]
                found = F.when(acc["inside"], F.array_append(acc["found"], F.struct(*own))).otherwise(acc["found"])
                return F.struct(end.alias("at"), joined(acc["tail"], piece).alias("tail"), (~acc["inside"]).alias("inside"), found.alias("found"))

            return F.aggregate(part, begin, step, lambda acc: acc["found"])

        return let(firsts, lambda f: F.flatten(F.transform(parts, lambda p, b: block(p, F.get(f, b)))))

    framed = F.regexp_replace(clean, F.lit(f"({pattern})"), F.lit(f"{OPEN}$1{CLOSE}"))
    found = let(framed, lambda t: F.when(F.contains(t, F.lit(OPEN)), let(blocks(F.split(t, f"[{OPEN}{CLOSE}]")), located)).otherwise(empty))
    return F.when(F.contains(clean, F.lit(needs)), found).otherwise(empty) if needs else found


def apart(extra: Column, base: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``base``, by start: both are sorted once and passed once in either direction."""
    far = (1 << 62) - 1
    of = lambda spans, place: F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), place(k).alias("place"), s["end"].alias("end")))
    ours = lambda s: s["place"] >= 0

    def chosen(all_: Column) -> Column:
        ended = running(F.transform(all_, lambda s: F.when(ours(s), F.lit(-1).cast("bigint")).otherwise(s["end"])), -1, F.greatest)
        begins = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(ours(s), F.lit(far)).otherwise(s["start"]))), far, F.least))
        free = lambda s, i, e, b: ours(s) & (F.get(e, i) <= s["start"]) & (F.get(b, i) >= s["end"])
        return let(ended, lambda e: let(begins, lambda b: F.filter(all_, lambda s, i: free(s, i, e, b))))

    def picked(own: Column) -> Column:
        every = F.sort_array(F.concat(of(own, lambda k: k), of(base, lambda k: F.lit(-1))))
        return F.when((F.size(own) > 0) & (F.size(base) > 0), F.transform(let(every, chosen), lambda s: F.get(own, s["place"]))).otherwise(own)

    return let(extra, picked)


def merged(spans: Column) -> Column:
    """Spans as the fewest runs (start, end): those that overlap become one."""

    def runs(own: Column) -> Column:
        def cut(ends: Column) -> Column:
            first = F.filter(F.transform(own, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(ends, F.greatest(i - 1, F.lit(0)))), i).otherwise(F.lit(-1))), lambda i: i >= 0)
            last = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(own)) - 1
            return let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(own, i)["start"].alias("start"), F.get(ends, last(at, k)).alias("end"))))

        return let(running(F.transform(own, lambda s: s["end"]), -1, F.greatest), cut)

    return let(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), runs)


def cut_at(text: Column, points: Column) -> Column:
    """The text cut at sorted points: one piece more than there are points. First into the pieces of blocks of points, then within them."""

    def pieces(rest: Column, at: Column, own: Column) -> Column:
        start = F.struct(rest.alias("rest"), at.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            n = (p - acc["at"]).cast("int")
            return F.struct(F.substring(acc["rest"], n + 1, F.lit(ENDLESS)).alias("rest"), p.alias("at"), F.array_append(acc["out"], F.substring(acc["rest"], F.lit(1), n)).alias("out"))

        return F.aggregate(own, start, step, lambda acc: F.array_append(acc["out"], acc["rest"]))

    zero = F.lit(0).cast("bigint")

    def by_block(parts: Column) -> Column:
        lasts = F.transform(parts, lambda p: F.element_at(p, -1))
        coarse = pieces(text, zero, lasts)

        def fine(long: Column) -> Column:
            # A block's last point is the end of its piece, so what is left there is empty.
            inner = F.transform(parts, lambda p, b: F.slice(pieces(F.get(long, b), F.when(b == 0, zero).otherwise(F.get(lasts, F.greatest(b - 1, F.lit(0)))), p), F.lit(1), F.size(p)))
            return F.concat(F.flatten(inner), F.array(F.element_at(long, -1)))

        return let(coarse, fine)

    return F.when(F.size(points) > 0, let(blocks(points), by_block)).otherwise(F.array(text))


def replaced(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span replaced; overlapping spans become one."""
    points = F.flatten(F.transform(merged(spans), lambda r: F.array(r["start"], r["end"])))
    masked = F.transform(let(points, lambda p: cut_at(text, p)), lambda piece, i: F.when(i % 2 == 1, F.lit(mask)).otherwise(piece))
    return F.when(F.size(spans) > 0, F.array_join(masked, "")).otherwise(text)


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of spans with a kind, by start, then in the order of ``kinds``, comma-joined."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_kind(spans: Column, kind: str, *more: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), *(s[x].alias(x) for x in more)))


def base_sql(kinds: list[tuple[str, str, str]], alias: str = "n_") -> str:
    """DuckDB SQL of the base columns over ``documents``: for each kind a pattern (RE2) and a condition on the match ``m``."""
    quoted = lambda x: x.replace("'", "''")
    parts = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {i} AS place, string_split(regexp_replace(t, '({quoted(p)})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d" for i, (k, p, _) in enumerate(kinds))
    passed = " OR ".join(f"(kind = '{k}' AND {condition})" for k, _, condition in kinds)
    counts = ", ".join(f"CAST(coalesce(count(*) FILTER (kind = '{k}'), 0) AS BIGINT) AS {alias}{k}" for k, _, _ in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(replace(coalesce(text, ''), chr(1), chr(3)), chr(2), chr(3)) AS t FROM documents),
framed AS ({parts}),
pieces AS (SELECT r, kind, place, unnest(parts) AS m, generate_subscripts(parts, 1) AS i FROM framed),
placed AS (SELECT r, kind, place, m, i, CAST(sum(length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM pieces),
found AS (SELECT r, kind, place, stop - length(m) AS start, stop FROM placed WHERE i % 2 = 0 AND ({passed})),
told AS (SELECT r, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS s FROM found GROUP BY r)
SELECT d.doc_id, {", ".join(f"coalesce({alias}{k}, 0) AS {alias}{k}" for k, _, _ in kinds)}, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN told USING (r)
"""
