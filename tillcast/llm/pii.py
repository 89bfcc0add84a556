"""Personal data in texts, found by DataFrame functions only.

Regular expressions propose spans; validators confirm them (octet range, Luhn,
digit count, mod-97 for IBAN, number ranges for social security numbers); words
just before and after a span move its score. The four base kinds are kept whatever
their score; IBAN and social security numbers need ``threshold``.

Possessive quantifiers and a run-start guard keep matching linear in the length of
a text; they do not change which spans match. The guard lets a match start only
where its run of characters starts or the previous match ended, since a run that
fails at its start fails at every later place too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, fresh

_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

# Kind, proposing pattern, a text that any match holds, prior score
KINDS = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@", 0.9),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7),
    ("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++", None, 0.8),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, 0.8),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4),
]
BASE = ("email", "ip", "card", "phone")

# Words near a span that speak for its kind
CONTEXT = {
    "email": "mail|email|e-mail|contact|write|correo|courriel|kontakt",
    "ip": "ip|address|host|server|client|login",
    "card": "card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte",
    "phone": "phone|call|tel|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|cuenta|compte|swift|bic",
    "ssn": "ssn|social|security|tax|taxpayer",
}
WINDOW = 40  # characters looked at on either side
LIFT, AGAINST = 0.2, 0.2
BLOCK = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(acc, i):
        v = F.substr(d, i, F.lit(1)).cast("int")
        twice = v * 2
        return acc + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    summed = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return n.between(16, 19) & F.when(n.between(16, 19), summed % 10 == 0).otherwise(False)


def _mod97(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    n = F.length(s)
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def add(acc, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return n.between(15, 34) & F.when(n.between(15, 34), rest == 1).otherwise(False)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~F.regexp_like(m, F.lit("^(?:000|666|9[0-9][0-9])-|-00-|-0000$"))
    return F.lit(True)


def _score(kind: str, prior: float, text: Column, s: Column) -> Column:
    """Prior, moved by context words within WINDOW characters and by digits that touch the span."""
    before = F.substr(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)), F.least(s["start"], F.lit(WINDOW)))
    after = F.substr(text, s["end"] + 1, F.lit(WINDOW))
    near = F.concat(before, F.lit(" • "), after)
    word = rf"(?i)(?<![\p{{L}}0-9])(?:{CONTEXT[kind]})(?![\p{{L}}0-9])"
    return (F.lit(prior) + F.when(F.regexp_like(near, F.lit(word)), LIFT).otherwise(0.0)
            - F.when(F.regexp_like(near, F.lit("[0-9] • |• [0-9]")), AGAINST).otherwise(0.0))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.6, name: str = "pii") -> DataFrame:
    """docs with column ``name``: array of (kind, start, end, score, match), by kind and start.

    Places are code points, end exclusive. A null text counts as empty and gives an
    empty array. Kinds are found apart, so spans of two kinds may overlap. Very long
    texts and many matches in one text are fine. A column called ``name`` is replaced;
    repeated rows are each treated alike.
    """
    keep = [col(c) for c in docs.columns if c != name]
    body, made = fresh(docs, "__text"), {k: fresh(docs, f"__{k}") for k, *_ in KINDS}
    df = docs.select(*keep, F.coalesce(col(text), F.lit("")).alias(body))
    none = F.array().cast("array<string>")
    found, gaps = [], []
    for kind, pattern, needs, _ in KINDS:
        holds = F.contains(F.col(body), F.lit(needs)) if needs else F.regexp_like(F.col(body), F.lit("[0-9]"))
        m = F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0))
        found.append(F.when(holds, m).otherwise(none).alias(made[kind] + "m"))
        gaps.append(F.when(F.size(made[kind] + "m") > 0, F.split(F.col(body), pattern, -1)).otherwise(none).alias(made[kind] + "g"))
    df = df.select("*", *found).select("*", *gaps)
    df = df.select(*keep, body, *[_spans(F.col(c + "m"), F.col(c + "g")).alias(c) for c in made.values()])
    kinds = [_confirmed(kind, prior, F.col(body), F.col(made[kind]), threshold) for kind, _, _, prior in KINDS]
    return df.select(*keep, F.concat(*kinds).alias(name))


def _confirmed(kind: str, prior: float, text: Column, spans: Column, threshold: float) -> Column:
    """Validated spans with scores; a base kind stays whatever its score."""
    good = F.filter(spans, lambda s: _valid(kind, s["m"]))
    scored = F.transform(good, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.round(_score(kind, prior, text, s), 3).alias("score"), s["m"].alias("match")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= threshold)


def _spans(matches: Column, gaps: Column) -> Column:
    """(start, end, m) of each match: running lengths of gaps and matches, in blocks.

    A block's places are summed from its own start, then moved on by the lengths of
    the blocks before, so that a text of many matches does not take square time.
    """
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches,
                       lambda g, m: F.struct(F.length(g).cast("long").alias("g"), m.alias("m")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1).cast("double") / BLOCK).cast("int")),
                         lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
    span = "array<struct<start:bigint,end:bigint,m:string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("out"))

    def one(acc, p):
        start = acc["at"] + p["g"]
        end = start + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(
            F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m")))).alias("out"))

    own = F.transform(blocks, lambda b: F.aggregate(b, zero, one))
    moved = F.aggregate(own, zero, lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"),
        F.concat(acc["out"], F.transform(b["out"], lambda s: F.struct(
            (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["m"].alias("m")))).alias("out")))
    return F.when(F.size(matches) > 0, moved["out"]).otherwise(F.array().cast(span))


def spans_text(pii: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of base spans, all spans, and spans with scores, for each row."""
    found = find_pii(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    scored = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], s["score"])), ",")
    return found.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.col("pii")).alias("spans"), scored.alias("scored_spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; null texts stay null.

    Overlapping spans are merged under the name of the first. Columns are those of docs.
    """
    name = fresh(docs, "__pii")
    found = find_pii(docs, text, name=name)
    order = F.array_sort(F.transform(name, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc, s):
        gap = F.substr(col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        tag = F.concat(gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(tag)).alias("out"))
                      ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(order, start, cut)
    out = F.when(F.size(name) > 0, F.concat(F.array_join(done["out"], ""), F.substr(col(text), (done["at"] + 1).cast("int"))))
    return found.select(*[(F.coalesce(out, col(text)).alias(c) if c == text else col(c)) for c in docs.columns])
