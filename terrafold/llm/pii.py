"""Personal data with DataFrame functions only.

Regular expressions propose spans, validators confirm them (octets, Luhn, digit counts, mod-97, check letters, variety of
characters), and words shortly before or behind a span adjust its score. Places come from two views of the same matches: the
matched strings and the stretches between them, whose lengths add up.

The expressions are linear on long texts: possessive where nothing could be gained by going back,
and an email or address is only tried where its run of characters begins or the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: a cheap necessary condition
    needs: str
    score: float
    context: str
    base: bool = True


#: Matches whose positions are summed together; any value gives the same spans.
CHUNK = 256

#: Fixed order of the kinds in results. Scores and context words are parameters of the method.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|address|host|server|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, "card|visa|mastercard|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|telefon"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.8, "iban|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, "ssn|social|security", False),
    # eight digits and a check letter; a year's digits and a letter may agree by chance (1 in 23)
    Kind("dni", r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])", "", 0.45, "dni|nif|identidad|documento|id", False),
    # sex, year, month, department, birth number and two check digits
    Kind("nir", r"(?<![0-9])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])", "", 0.55, "nir|sécu|sécurité|sociale|insee", False),
    # keys in published formats speak for themselves
    Kind("key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[0-9A-Za-z-]{10,}|[rs]k_live_[0-9A-Za-z]{16,})(?![A-Za-z0-9_-])", "", 0.9, "key|token", False),
    # any long run of mixed characters is one where a word beside it says so
    Kind("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+=*+(?![A-Za-z0-9_+/-])", "", 0.4, r"[a-z_-]*(?:token|secret|passwd|password|apikey|api[_-]key|access[_-]key|private[_-]key|credentials?|bearer)", False),
)
#: What a text must hold, besides ``needs``, for a kind to be looked for.
_RARE = {"dni": "[0-9]{8}-?[A-Z]", "nir": r"[12]\x20?[0-9]{2}\x20?[0-9]{2}", "key": "AKIA|gh[oprsu]_|AIza|xox[abprs]-|[rs]k_live_", "secret": "[A-Za-z0-9_+/-]{20}"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return (F.length(value) >= 12) & F.length(digits).between(12, 19) & (total % 10 == 0)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255))


def _mod97(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    number = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _check_letter(value: Column) -> Column:
    return F.right(value, F.lit(1)) == F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), F.substring(value, 1, 8).cast("int") % 23 + 1, F.lit(1))


def _check_pair(value: Column) -> Column:
    digits = _digits(value)
    return F.substring(digits, 1, 13).cast("long") % 97 + F.right(digits, F.lit(2)).cast("int") == 97


def _mixed(value: Column) -> Column:
    """Letters, two or more digits and ten or more different characters: no word, number or ruler."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


#: Never null, as a span is kept or not.
_VALID = {"ip": _octets, "card": _luhn, "iban": _mod97, "phone": lambda v: F.length(_digits(v)).between(9, 15), "dni": _check_letter, "nir": _check_pair, "secret": _mixed}


def _measured(kind: Kind) -> Column:
    """Lengths of every match and of the stretch before it, and whether its validator agrees."""
    valid = _VALID.get(kind.name, lambda v: F.lit(True))
    gaps = F.col(f"g_{kind.name}")
    return F.transform(f"v_{kind.name}", lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(v).alias("len"), valid(v).alias("ok")))


def _placed(lengths: Column) -> Column:
    """The confirmed matches with their code points: after the stretches and matches before them.

    Positions are summed within chunks of matches and then over chunks, so that no array grows match
    by match over a whole long text.
    """
    place = "array<struct<begin:int,stop:int,i:int>>"

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        stop = begin + m["len"]
        here = F.array(F.struct(begin.alias("begin"), stop.alias("stop"), acc["i"].alias("i")))
        return F.struct(stop.alias("at"), (acc["i"] + 1).alias("i"), F.when(m["ok"], F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    def chunk(first: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), first.alias("i"), F.array().cast(place).alias("out"))
        return F.aggregate(F.slice(lengths, first + 1, CHUNK), start, step)

    def shift(acc: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda m: F.struct((m["begin"] + acc["at"]).alias("begin"), (m["stop"] + acc["at"]).alias("stop"), m["i"].alias("i")))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(CHUNK)), chunk)
    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{place}>").alias("out")), shift, lambda acc: F.flatten(acc["out"]))


def _before(values: Column, gaps: Column, i: Column, reach: int) -> Column:
    """The last ``reach`` code points before match ``i``. A match has two or more, so ``reach / 2`` matches back are enough."""
    first = F.greatest(F.lit(0), i - (reach + 1) // 2)
    end = lambda c: F.right(c, F.lit(reach))
    piece = lambda j: F.concat(F.when(j > first, end(F.get(values, j - 1))).otherwise(""), end(F.get(gaps, j)))
    return end(F.array_join(F.transform(F.sequence(first, i), piece), ""))


def _behind(values: Column, gaps: Column, i: Column, reach: int) -> Column:
    """The first ``reach`` code points behind match ``i``."""
    last = F.least(F.size(values), i + 1 + (reach + 1) // 2)
    begin = lambda c: F.substring(c, 1, reach)
    piece = lambda j: F.concat(begin(F.get(gaps, j)), F.when(j < last, begin(F.get(values, j))).otherwise(""))
    return begin(F.array_join(F.transform(F.sequence(i + 1, last), piece), ""))


def _spans(number: int, kind: Kind, threshold: float, reach: int) -> Column:
    """The confirmed and scored spans of one kind."""
    values, gaps, lengths = F.col(f"v_{kind.name}"), F.col(f"g_{kind.name}"), F.col(f"m_{kind.name}")

    def scored(s: Column) -> Column:
        beside = F.concat(_before(values, gaps, s["i"], reach), F.lit("\n"), _behind(values, gaps, s["i"], reach))
        near = F.lower(beside).rlike(rf"\b(?:{kind.context})\b")
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, 0.2).otherwise(0.0))
        return F.struct(s["begin"].alias("begin"), F.lit(number).alias("kind"), s["stop"].alias("stop"), score.alias("score"))

    found = F.transform(_placed(lengths), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= threshold)
    return F.when(F.exists(lengths, lambda m: m["ok"]), found).otherwise(F.array().cast("array<struct<begin:int,kind:int,stop:int,score:double>>"))


def find_pii(docs: DataFrame, threshold: float = 0.5, reach: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``found``: all spans by begin, then kind: ``array<struct<begin, kind (place in KINDS), stop, score>>``.

    Base kinds are reported whenever their validator agrees; the others if their score reaches
    ``threshold``. Within a kind, matches are leftmost and don't overlap. Null texts count as empty.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    possible = {k.name: F.col("text").contains(k.needs) if k.needs else F.col("text").rlike(_RARE.get(k.name, "[0-9]{2}|[0-9][ -][0-9]")) for k in KINDS}
    rows = rows.select("doc_id", "text", *(F.when(possible[k.name], F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"v_{k.name}") for k in KINDS))
    rows = rows.select("*", *(F.when(F.size(f"v_{k.name}") > 0, F.split("text", k.pattern, -1)).alias(f"g_{k.name}") for k in KINDS)).drop("text")
    rows = rows.select("*", *(_measured(k).alias(f"m_{k.name}") for k in KINDS))
    spans = [_spans(number, k, threshold, reach) for number, k in enumerate(KINDS)]
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the joined spans of :func:`find_pii` and, in their order, their scores in hundredths."""
    names = F.array(*(F.lit(k.name) for k in KINDS))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind].name}")

    base = [i for i, k in enumerate(KINDS) if k.base]
    return found.select(
        "doc_id", *map(count, base),
        F.sha2(told(F.filter("found", lambda s: s["kind"] <= base[-1])).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )
