"""Personal data: regular expressions propose, checksums confirm, context words score. DataFrame functions only.

Every kind is one regular expression, matched leftmost and non-overlapping over the whole text. Matches and the gaps
between them give the offsets (code points, end exclusive). The expressions are the stated ones with possessive
quantifiers where nothing could be given back, and with a look-behind that skips starts which can only fail like the
start before them; both keep the matches and make the search linear in the text.

kind   proposed by                                   confirmed by
email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+   -
ip     four dotted numbers                           parts at most 255
card   digits, single spaces or hyphens between      12 to 19 digits, Luhn
phone  + and digits with separators                  9 to 15 digits
iban   two letters, two digits, groups               15 to 34 characters, mod-97 = 1, letters in upper case
ssn    ddd-dd-dddd                                   ranges in use; a context word near it

Scores: a kind has a prior, a passed checksum adds, a context word within 40 characters before or after the span adds.
Spans of the first four kinds are the base and always stay; the other two need a score of at least 0.5.

Offsets are running sums of the lengths of matches and gaps, taken in runs, and the redacted text is cut from stretches
of the text, so that neither the text nor the list of spans is gone through again for each of many spans.

Defined results: a null text counts as empty; no span gives "" and its digest; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expressions by kind, in the order in which spans that start together are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold before a kind's expression can match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]"}
#: Prior score, and words that raise it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.3}
CHECKSUM = ("card", "iban")
CONTEXT = {
    "email": r"(?i)mail|contact|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|anruf|appel",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
    "ssn": r"(?i)ssn|social|security|taxpayer",
}
AROUND, BONUS, LEAST = 40, 0.3, 0.5  # BONUS for a checksum, and for a context word
STRETCH, RUN = 1024, 64  # code points of a stretch of text; values of a run, a power of two
_IP = rf"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """ISO 13616: first four characters to the end, letters as 10 to 35, remainder by 97."""
    compact = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c)))


def _good(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(_IP)
    if kind == "card":
        return n.between(12, 19) & luhn(F.when(n.between(12, 19), _digits(m)).otherwise(F.lit("1")))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        size = F.length(F.regexp_replace(m, " ", ""))
        return size.between(15, 34) & (mod97(m) == 1)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op, zero: Column) -> Column:
    """op over the values up to and with each, by runs of RUN: totals of the runs, of the runs before each, and within."""
    places = lambda n: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    run = lambda i: F.shiftright(i, RUN.bit_length() - 1)

    def over(v: Column, first: Column, last: Column, start: Column) -> Column:
        return F.aggregate(F.sequence(first, last), start, lambda a, i: op(a, F.get(v, i)))

    def of(v: Column, n: Column) -> Column:
        totals = F.transform(places(run(n - 1) + 1), lambda b: over(v, b * RUN, F.least(b * RUN + (RUN - 1), n - 1), zero))
        earlier = lambda t: F.transform(places(F.size(t)), lambda b: F.when(b == 0, zero).otherwise(over(t, F.lit(0), F.greatest(b - 1, F.lit(0)), zero)))
        return _let(_let(totals, earlier), lambda e: F.transform(places(n), lambda i: over(v, i - i % RUN, i, F.get(e, run(i)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v, F.size(v))).otherwise(F.array().cast("array<int>")))


_SPANS = "array<struct<start:int,rank:int,end:int,score:double>>"


def _spans(kind: str, rank: int, matches: Column, gaps: Column) -> Column:
    """Confirmed spans as structs (start, rank, end, score), in order."""

    def near(m: Column, g: Column, i: Column) -> Column:
        """The text around match i, cut to AROUND code points on either side; AROUND / 2 matches fill it."""
        pair = lambda a, k: F.concat(a, F.coalesce(F.get(g, k), F.lit("")), F.coalesce(F.get(m, k), F.lit("")))
        before = F.aggregate(F.sequence(F.greatest(i - AROUND // 2, F.lit(0)), i), F.lit(""), lambda a, k: F.when(k == i, F.concat(a, F.get(g, k))).otherwise(pair(a, k)))
        after = F.aggregate(F.sequence(i + 1, i + 1 + AROUND // 2), F.lit(""), pair)
        return F.concat(F.right(before, F.lit(AROUND)), F.lit("\n"), F.left(after, F.lit(AROUND)))

    def found(m: Column, g: Column, ends: Column) -> Column:
        known = F.lit(PRIOR[kind] + (BONUS if kind in CHECKSUM else 0.0))  # only what passes its checksum is kept
        good = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: _good(kind, F.get(m, i)))

        def row(i: Column) -> Column:
            score = F.least(known + F.when(near(m, g, i).rlike(CONTEXT[kind]), BONUS).otherwise(0.0), F.lit(1.0))
            return F.struct((F.get(ends, i) - F.length(F.get(m, i))).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"), score.alias("score"))

        rows = F.transform(good, row)
        return rows if kind in BASE else F.filter(rows, lambda x: x["score"] >= LEAST)

    sizes = lambda m, g: F.zip_with(F.slice(g, 1, F.size(m)), m, lambda x, y: F.length(x) + F.length(y))
    every = _let(matches, lambda m: _let(gaps, lambda g: _let(running(sizes(m, g), lambda a, x: a + x, F.lit(0)), lambda e: found(m, g, e))))
    return F.when(F.size(matches) > 0, every).otherwise(F.array().cast(_SPANS))


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "_pii") -> DataFrame:
    """Adds `out`: array of (start, rank, end, score), rank telling the kind, sorted by start, then kind."""
    none = F.array().cast("array<string>")
    step = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    step = step.withColumns({f"_m_{k}": F.when(F.col("_t").rlike(need), F.regexp_extract_all("_t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k, need in NEEDS.items()})
    own = {f"_s_{k}": _spans(k, i, F.col(f"_m_{k}"), F.split("_t", PATTERNS[k], -1)) for i, k in enumerate(NEEDS)}
    every = F.concat(*(F.col(c) for c in own))
    return step.withColumns(own).withColumn(out, F.when(F.size(every) > 0, F.array_sort(every)).otherwise(F.array().cast(_SPANS))).drop("_t", *own, *(f"_m_{k}" for k in NEEDS))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; then n_iban, n_ssn, the highest score and every span's."""
    found = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_pii", lambda s: s["rank"] == list(PATTERNS).index(k))).cast("long")
    base = F.filter("_pii", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("_pii")).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in PATTERNS if k not in BASE),
        F.array_max(F.transform("_pii", lambda s: s["score"])).alias("top_score"),
        F.array_join(F.transform("_pii", lambda s: F.format_number(s["score"], 1)), ",").alias("scores"),
    )


def _cut(stretches: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that lies in stretches of STRETCH."""
    a, b = F.floor(start / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
    piece = lambda i, lo, n: F.coalesce(F.substring(F.get(stretches, i), lo + 1, n), F.lit(""))
    inside = piece(a, start % STRETCH, end - start)
    across = F.concat(piece(a, start % STRETCH, F.lit(STRETCH)), F.array_join(F.slice(stretches, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), piece(b, F.lit(0), end % STRETCH))
    return F.when(a == b, inside).otherwise(across)


def masked(text: Column, spans: Column) -> Column:
    """The text with its spans replaced; overlapping spans become one. Null where there are none."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in PATTERNS))

    def of(s: Column, pieces: Column, done: Column) -> Column:
        """done: how far the spans up to each reach."""
        past = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(done, i - 1))
        part = lambda x, i: F.when(x["start"] >= past(i), F.concat(_cut(pieces, past(i), x["start"]), F.element_at(kinds, x["rank"] + 1))).otherwise(F.lit(""))
        end = F.element_at(done, -1)
        return F.concat(F.array_join(F.transform(s, part), ""), _cut(pieces, end, F.greatest(F.size(pieces) * STRETCH, end)))

    ends = lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest, F.lit(0))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(spans, lambda s: _let(pieces, lambda p: _let(ends(s), lambda d: of(s, p, d)))))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets.

    What a replacement brings to light (digits that were part of a longer, failing match) goes in a second pass. A null
    text stays null, and n_chars follows the new text where the table has that column.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    text = F.col(plain[names.index("text")])
    once = with_spans(docs.toDF(*plain), plain[names.index("text")], "pii").withColumn("first", masked(text, F.col("pii")))
    twice = with_spans(once, "first", "pii2")  # null, so empty, where nothing was found
    new = twice.withColumn("_new", F.coalesce(masked(F.col("first"), F.col("pii2")), "first", text))
    cols = []
    for p, n in zip(plain, names, strict=True):
        col = F.col("_new") if n == "text" else F.col(p)
        if n == "n_chars":
            col = F.when(F.size("pii") > 0, F.length("_new").cast(dict(docs.dtypes)[n])).otherwise(col)
        cols.append(col.alias(n))
    return new.select(*cols)
