"""Personal data: spans proposed by regular expressions, confirmed by checks and scored by context.

Each kind's expression proposes its leftmost non-overlapping matches; a check
confirms or drops a match (parts of an address at most 255, Luhn, a number of
digits, mod-97 with the country's length). A span's score is its kind's own plus the
kind's ``boost`` if one of its context words stands within ``NEAR`` characters
before or after it. The base kinds (email, ip, card, phone) report every
confirmed match; the added kinds (iban, ipv6, local_phone, national_id) report
those that reach ``THRESHOLD``: an IBAN by its checksum alone, the last two only beside a context word.

All work is done by SQL functions in one pass, without a shuffle: the matches
of an expression are its ``regexp_extract_all``, the text between them its ``split``, and positions (in code points)
are running sums of both lengths, taken in chunks of ``CHUNK`` matches so that a text with very many
costs little more than proportionally.

The expressions are possessive throughout: the same matches, but a run of a
million digits neither recurses nor is scanned again from each of its characters.

Defined cases: null text is empty; a text without matches has empty spans;
matches of one kind never overlap, spans of different kinds may; equal starts go by the order
of KINDS. Rows are judged one by one, so repeated rows and repeated or null
doc_ids don't matter. Extra columns go along in ``row`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
THRESHOLD = 0.6
CHUNK = 128

# Lengths of IBANs by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    def weighed(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)
    total = F.aggregate(F.transform(F.split(F.reverse(number), ""), weighed), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder of an IBAN's number: its first four characters moved to the end, letters counted from 10."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    def step(rest: Column, c: Column) -> Column:
        at = F.ascii(c)
        return F.when(at < 65, (rest * 10 + at - 48) % 97).otherwise((rest * 100 + at - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _ip(value: Column) -> Column:
    small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
    number = lambda part: F.right(part, F.lit(3)).cast("int") <= 255
    return F.forall(F.split(value, r"\."), lambda part: small(part) & number(part))


def _card(value: Column) -> Column:
    n = digits(value)
    return F.length(n).between(12, 19) & luhn(n)


def _phone(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def _iban_code(value: Column) -> Column:
    """The first characters of a match, as many as its country's IBANs have; null for other countries or too few."""
    code = F.replace(value, F.lit(" "))
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    n = F.try_element_at(lengths, F.substring(code, 1, 2))
    return F.when(F.length(code) >= n, F.left(code, n))


def _iban(value: Column) -> Column:
    return F.coalesce(mod97(_iban_code(value)) == 1, F.lit(False))


def _iban_size(value: Column) -> Column:
    """Characters of the match up to the code's last one, spaces included."""
    n = F.length(_iban_code(value))
    return F.length(F.regexp_substr(value, F.concat(F.lit("^(?:[A-Z0-9]\\x20?){"), (n - 1).cast("string"), F.lit("}[A-Z0-9]"))))


class Kind(NamedTuple):
    """``pattern`` must be possessive; ``check`` confirms a match; ``size`` gives the span's length if it is not the match's."""
    name: str
    pattern: str
    check: Callable[[Column], Column] | None
    score: float
    boost: float
    words: tuple[str, ...]
    base: bool = True
    size: Callable[[Column], Column] | None = None


_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = [
    # A match begins where the run of local characters does, or where the last match ended.
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, 0.1, ("mail", "contact", "write")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, 0.3, ("ip", "host", "server", "address", "login")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.7, 0.3, ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7, 0.2, ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![a-z])", _iban, 0.8, 0.2, ("iban", "bank", "account", "konto", "compte", "cuenta"), False, _iban_size),
    Kind("ipv6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])", None, 0.6, 0.3, ("ip", "host", "server", "address", "login"), False),
    Kind("local_phone", r"(?<![0-9A-Za-z+(.-])(?<![0-9+()][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", None, 0.4, 0.3,
         ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp"), False),
    Kind("national_id", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", None, 0.4, 0.4,
         ("ssn", "social security", "social insurance"), False),
]
# What a text must contain for a kind's expression to be tried at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ipv6": ":"}

_SPAN = "array<struct<start:long,rank:int,end:long,kind:string,score:double>>"


def _items(matches: Column, gaps: Column) -> Column:
    """(value, before, near): each match with the text between it and the one before, and what stands near it,
    the neighbouring matches included."""
    tail, head = (lambda x: F.right(x, F.lit(NEAR))), (lambda x: F.left(x, F.lit(NEAR)))
    none = F.array(F.lit(""))
    pairs = F.zip_with(gaps, F.concat(matches, none), lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    earlier = F.concat(none, F.transform(F.slice(pairs, 1, F.size(matches) - 1), lambda x: F.concat(tail(x["gap"]), tail(x["value"]))))
    later = F.transform(F.slice(pairs, 2, F.size(matches)), lambda x: F.concat(head(x["gap"]), head(x["value"])))
    near = F.zip_with(earlier, later, lambda e, l: F.struct(e.alias("e"), l.alias("l")))
    return F.zip_with(F.slice(pairs, 1, F.size(matches)), near, lambda x, n: F.struct(
        x["value"].alias("value"), x["gap"].alias("before"),
        F.concat(tail(F.concat(n["e"], tail(x["gap"]))), F.lit(" "), head(n["l"])).alias("near")))


def _chunks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def _relative(chunk: Column) -> Column:
    """(pos, out): a chunk's length in the text and its matches' starts from the chunk's begin on."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:long,value:string,near:string>>").alias("out"))
    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["before"])
        found = F.struct(at.alias("start"), x["value"].alias("value"), x["near"].alias("near"))
        return F.struct((at + F.length(x["value"])).alias("pos"), F.concat(acc["out"], F.array(found)).alias("out"))
    return F.aggregate(chunk, start, step)


def _moved(chunks: Column) -> Column:
    """The chunks' matches with their starts in the text."""
    offsets = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["pos"])))
    return F.flatten(F.zip_with(chunks, F.slice(offsets, 1, F.size(chunks)), lambda c, o: F.transform(c["out"], lambda x: F.struct(
        (x["start"] + o).alias("start"), x["value"].alias("value"), x["near"].alias("near")))))


def _spans(found: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of a kind, from its (start, value, near)."""
    if kind.check is not None:
        found = F.filter(found, lambda x: kind.check(x["value"]))
    word = r"(?<![a-z])(?:" + "|".join(kind.words) + ")"
    def span(x: Column) -> Column:
        near = F.lower(x["near"])
        size = kind.size(x["value"]) if kind.size else F.length(x["value"])
        score = F.lit(kind.score) + F.when(near.rlike(word), kind.boost).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + size).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
    out = F.transform(found, span)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= THRESHOLD)


def find_personal_data(docs: DataFrame, carry: list[str] | None = None, kinds: list[Kind] = KINDS) -> DataFrame:
    """(row, spans, base): ``row`` is a struct of the columns ``carry`` (all but the text if not given); ``spans`` are
    (start, rank, end, kind, score) by start and kind, in code points; ``base`` are those of the base kinds."""
    names = [c for c in docs.columns if c != "text"] if carry is None else carry
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = range(len(kinds))
    some = lambda k, value: F.when(F.size(f"m{k}") > 0, value)
    own = own.withColumns({f"m{k}": F.when(F.contains("text", F.lit(_NEEDS[x.name])) if x.name in _NEEDS else F.lit(True),
                                           F.regexp_extract_all("text", F.lit(x.pattern), F.lit(0))) for k, x in enumerate(kinds)})
    own = own.withColumns({f"gaps{k}": some(k, F.split("text", kinds[k].pattern, -1)) for k in at})
    own = own.withColumns({f"items{k}": some(k, _items(F.col(f"m{k}"), F.col(f"gaps{k}"))) for k in at})
    own = own.withColumns({f"chunks{k}": some(k, F.transform(_chunks(F.col(f"items{k}")), _relative)) for k in at})
    own = own.withColumns({f"s{k}": some(k, _spans(_moved(F.col(f"chunks{k}")), kinds[k], k)) for k in at})
    kept = [f"s{k}" for k in at]
    none = F.array().cast(_SPAN)
    joined = lambda which: F.sort_array(F.concat(*[F.coalesce(F.col(c), none).cast(_SPAN) for c in which])) if which else none
    base = [c for c, k in zip(kept, kinds, strict=True) if k.base]
    return own.select("row", joined(kept).alias("spans"), joined(base).alias("base"))


def named(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "[%s]", least: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span that scores at least ``least`` replaced by ``mark`` with its kind; of
    overlapping spans the first stands."""
    found = find_personal_data(docs.withColumn("text", F.col("text")), carry=docs.columns)
    first = F.aggregate(F.filter("spans", lambda s: s["score"] >= least), F.array().cast(_SPAN), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), acc).otherwise(F.concat(acc, F.array(s))))
    text = F.col("row").getField("text")
    size = F.size("cut")
    begin = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("cut"), i - 1)["end"])
    parts = F.transform("cut", lambda s, i: F.concat(F.substr(text, begin(i) + 1, s["start"] - begin(i)),
                                                    F.format_string(mark, s["kind"])))
    rest = F.substr(text, begin(size) + 1, F.length(text))
    new = F.when(text.isNull(), F.lit(None)).when(size == 0, text).otherwise(F.concat(F.array_join(parts, ""), rest))
    return found.withColumn("cut", first).select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
