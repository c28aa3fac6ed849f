"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a Spark SQL expression. Positions come from marking the matches in the text and adding up the lengths of
what stands between the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.graph import unused

# The patterns of the contract. Possessive forms and the tests before them change no match; they keep
# the work linear on long runs, in which no later start can succeed either.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"
LOCAL = r"\b0[0-9](?:[ ./-]?[0-9]){6,12}\b"

#: In this order spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "tel")
BASE = KINDS[:4]
#: Score of a confirmed span (card: Luhn, iban: mod-97) without context, and words that raise it when near before it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "tel": 0.2}
CONTEXT = {
    "email": "mail|correo|courriel|contact",
    "ip": "ip|address|host|server",
    "card": "card|karte|carte|tarjeta|visa|mastercard|credit",
    "phone": "phone|call|tel|fax|mobile|telefon|tél|teléfono",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "tel": "phone|call|tel|fax|mobile|telefon|tél|teléfono",
}
NEAR, RAISE, LEAST = 40, 0.2, 0.4


#: Running values are kept in blocks of this many, since an array is copied whole whenever it grows by one; cuts of a
#: text are taken from parts of this many code points, since a position in it is found by counting from its start.
BLOCK, PART = 64, 4096


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op) -> Column:
    """For every item of an array of whole numbers: ``op`` over all items before it, from 0."""
    append = lambda s, v: F.struct(op(s["at"], v).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    over = lambda items, at: F.aggregate(items, zero(at), append, lambda s: s["out"])
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))

    def spread(blocks):
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))
        return _let(over(ends, F.lit(0)), lambda at: F.flatten(F.transform(blocks, lambda b, i: over(b, F.get(at, i)))))

    return F.when(F.size(values) > 0, _let(cut, spread)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before>> of the leftmost non-overlapping matches; positions in code points.

    before: the last NEAR characters between the match and the one before it. The work is linear in the text.
    """
    marked = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002"), "[\u0001\u0002]", -1)

    def spans(parts):
        def span(at):
            def one(i):
                start, match = F.get(at, 2 * i + 1), F.get(parts, 2 * i + 1)
                before = F.lower(F.substring(F.get(parts, 2 * i), -NEAR, NEAR))
                return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), before.alias("before"))

            return F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), one)

        return F.when(F.size(parts) > 2, _let(_running(F.transform(parts, F.length), lambda s, n: s + n), span)).otherwise(_none())

    return _let(marked, spans)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("."), F.lit(0))


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    each = F.transform(_chars(F.reverse(digits)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an IBAN-like code of A-Z and 0-9 passes the mod-97 check."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    numbers = F.array_join(F.transform(_chars(turned), lambda c: F.when(c >= "A", (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(_chars(numbers), F.lit(0), lambda a, d: (a * 10 + d.cast("int")) % 97) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def with_entities(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a column array<struct<start, rank, end, kind, match, score>>, by start and then kind as listed.

    A null text is empty. A base span (email, ip, card, phone) that its check confirms always stays; spans of the kinds
    that the method adds (iban, tel) stay from a score of LEAST on. Spans of different kinds may overlap.
    """
    # Control characters that mark matches can be in no match; another one stands in for them.
    docs = docs.withColumn(f"{name}_text", F.translate(F.coalesce("text", F.lit("")), "\u0001\u0002", "\u0003\u0003"))
    text = F.col(f"{name}_text")
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    found = []
    for rank, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, LOCAL), strict=True)):
        spans = _matches(text, pattern)
        if kind in needs:
            spans = F.when(needs[kind], spans).otherwise(_none())
        spans = F.transform(F.filter(spans, _check(kind)), _score(kind, rank))
        found.append(spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST))
    return docs.withColumn(name, F.array_sort(F.concat(*found))).drop(f"{name}_text")


def _check(kind: str):
    return lambda s: _confirmed(kind, s["match"])


def _score(kind: str, rank: int):
    def scored(s):
        near = s["before"].rlike(f"(?:^|[^a-z])(?:{CONTEXT[kind]})")
        score = F.round(F.lit(PRIOR[kind]) + F.when(near, RAISE).otherwise(0.0), 2)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match"), score.alias("score"))

    return scored


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``entities`` (see above) of every row; other columns are left out."""
    return with_entities(docs.select("doc_id", "text"), "entities").select("doc_id", "entities")


def listed(spans: Column) -> Column:
    """kind:start:end of entities, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each entity replaced by its kind in angle brackets; an overlap is covered once. Null stays null."""
    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def between(parts, a, z):
        """Code points a to z - 1, from the parts that hold them."""
        piece = lambda k: F.substring(F.get(parts, k), F.greatest(a - k * PART, F.lit(0)) + 1, z - F.greatest(a, k * PART))
        first, last = F.floor(a / PART).cast("int"), F.floor((z - 1) / PART).cast("int")
        return F.when(z > a, F.array_join(F.transform(F.sequence(first, last), piece), "")).otherwise("")

    def joined(parts, done):
        def one(e, i):
            at = F.get(done, i)
            name = F.when(e["start"] >= at, F.concat(F.lit("<"), F.upper(e["kind"]), F.lit(">"))).otherwise("")
            return F.concat(between(parts, at, e["start"]), name)

        rest = between(parts, F.array_max(spans["end"]), F.length(text))
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    covered = _running(spans["end"], lambda s, n: F.greatest(s, n))
    return F.when(F.size(spans) > 0, _let(cuts, lambda parts: _let(covered, lambda done: joined(parts, done)))).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and rows as they are, whatever they are named, and personal data in ``text`` replaced."""
    spans = unused(docs.columns, "_pii_spans", ("", "_text"))
    return with_entities(docs, spans).withColumn("text", redacted(F.col("text"), F.col(spans))).select(*[F.col(f"`{c}`") for c in docs.columns])
