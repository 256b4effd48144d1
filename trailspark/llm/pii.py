"""Personal data by built-in functions only: patterns propose, checksums confirm, context scores.

For each kind a pattern proposes spans; a validator (number range, length, Luhn, mod-97) keeps
or drops each; words just before a span raise its score. A span of the base kinds counts
whenever its validator passes; one of the added kinds (``iban``, ``ssn``) only at THRESHOLD.

Positions come from two passes of one pattern: what ``split`` leaves between matches and what
``regexp_extract_all`` takes interleave, so starts are running sums of their lengths. The
patterns are possessive and a match cannot start inside a run that has failed, so time is
linear in the text.

Defined cases: null text counts as empty and gives no spans; null or repeated ids give a row
each; other columns pass through :func:`with_spans` untouched unless they have its output's
name; texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
#: Characters before a span in which context words count.
CONTEXT_CHARS = 40
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: a cheap test of the text, the pattern, score and context words."""

    name: str
    gate: str
    pattern: str
    score: float
    context: str
    mask: str


#: Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write to", "[EMAIL]"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|host|server|address", "[IP]"),
    Kind("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|payment", "[CARD]"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile|fax", "[PHONE]"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban|account|bank", "[IBAN]"),
    Kind("ssn", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security", "[SSN]"),
)
BASE = tuple(k.name for k in KINDS[:4])
_SPAN = "struct<start:int,rank:int,kind:string,end:int,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn sum."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """True where an account number without spaces leaves 1 at division by 97."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    """The validator of a kind for one match."""
    if kind == "ip":
        return m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match: running sums of the lengths of gaps and matches, in blocks.

    Sums run over blocks of 256 first, so a text with n matches takes n * (256 + n / 256) steps.
    """
    block = 256
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    part = lambda steps, b: F.slice(steps, b * block + 1, F.lit(block))
    running = lambda xs, base: F.transform(xs, lambda _, j: base + total(F.slice(xs, F.lit(1), j + 1)))

    def over(steps: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int"))
        sums = F.transform(blocks, lambda b: total(part(steps, b)))
        before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
        each = lambda base: F.flatten(F.transform(base, lambda x, b: _let(part(steps, b), lambda xs: running(xs, x))))
        return _let(sums, lambda s: _let(before(s), each))

    steps = F.transform(gaps, lambda g, i: F.length(g) + F.when(i == 0, 0).otherwise(F.length(F.get(found, i - 1))))
    return _let(steps, over)


def _spans(k: Kind, rank: int, text: Column) -> Column:
    """array of spans of one kind that its validator and score keep."""
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    gaps = F.split(text, k.pattern, -1)
    keep = 0.0 if k.name in BASE else THRESHOLD

    def span(p: Column, m: Column, i: Column) -> Column:
        near = F.lower(F.right(F.get(p["gaps"], i), F.lit(CONTEXT_CHARS)))
        score = F.least(F.lit(1.0), F.lit(k.score) + F.when(near.rlike(k.context), 0.3).otherwise(0.0))
        begin = F.get(p["begin"], i)
        made = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(k.name).alias("kind"), (begin + F.length(m)).alias("end"), score.alias("score"))
        return F.when(valid(k.name, m), made)

    def spans(p: Column) -> Column:
        made = F.transform(p["found"], lambda m, i: span(p, m, i))
        return F.filter(made, lambda s: s.isNotNull() & (s["score"] >= keep))

    parts = F.struct(gaps.alias("gaps"), found.alias("found"))
    placed = lambda p: F.struct(p["gaps"].alias("gaps"), p["found"].alias("found"), _starts(p["gaps"], p["found"]).alias("begin"))
    once = _let(parts, lambda p: _let(placed(p), spans))
    gate = F.contains(text, F.lit(k.gate)) if k.gate == "@" else text.rlike(k.gate)
    return F.when(gate, once).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find_spans(text: Column) -> Column:
    """array<struct<start, rank, kind, end, score>> of a text, by start and kind; code points."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*[_spans(k, i, t).cast(f"array<{_SPAN}>") for i, k in enumerate(KINDS)]))


def with_spans(df: DataFrame, text_col: str = "text", to: str = "pii") -> DataFrame:
    """``df`` with the spans of ``text_col`` in column ``to``; a column of that name is replaced."""
    return df.withColumn(to, find_spans(F.col(text_col)))


def _masked(k: Kind, text: Column) -> Column:
    """``text`` with each confirmed span of a kind as its mask; what lies between is kept."""
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    gaps = F.split(text, k.pattern, -1)
    near = lambda g: F.lower(F.right(g, F.lit(CONTEXT_CHARS)))
    need = THRESHOLD - k.score if k.name not in BASE else 0
    ok = lambda m, g: valid(k.name, m) & (near(g).rlike(k.context) if need > 0 else F.lit(True))
    fill = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNull(), "").when(ok(m, g), k.mask).otherwise(m)))
    gate = F.contains(text, F.lit(k.gate)) if k.gate == "@" else text.rlike(k.gate)
    return F.when(gate, F.array_join(fill, "")).otherwise(text)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with confirmed spans of ``text_col`` masked, kind after kind; null text stays null."""
    order = ("email", "iban", "card", "phone", "ip", "ssn")
    kinds = {k.name: k for k in KINDS}
    out = df
    for name in order:
        out = out.withColumn(text_col, _masked(kinds[name], F.col(text_col).cast("string")))
    return out


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
