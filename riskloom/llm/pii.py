"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import whole


@dataclass(frozen=True)
class Kind:
    """``pattern`` is anchored so that a scan is linear: it can only start where no earlier character could have started it."""

    name: str
    hint: str  # a text without it has no match; cheap to test
    pattern: str
    score: float
    context: str


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|address"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|host|server|client|address"),
    Kind("card", r"(?:[0-9][\x20-]?){15}[0-9]", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", 0.7, "card|credit|debit|visa|payment"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban|account|bank|transfer"),
)
BASE = ("email", "ip", "card", "phone")
#: Characters before a span in which context words count.
NEAR = 48
#: Matches of a text whose places are summed up at once.
BLOCK = 256
#: Characters of a part of a text that is redacted.
PART = 4_096


def luhn(digits: Column) -> Column:
    doubled = F.translate(digits, "0123456789", "0246813579")
    at = lambda s, i: F.substring(s, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, at(digits, i)).otherwise(at(doubled, i)))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Letters count as 10 to 35; the first four characters move to the end; the number must leave 1."""
    moved = F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + value(c)).otherwise(acc * 100 + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with a value that is worked out once, as a lambda's variable is."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each element what all before it come to, from 0. Blocks, then blocks of blocks, so the cost is near linear."""
    zero, block = F.lit(0), F.lit(BLOCK)
    over = lambda x, start, n: F.aggregate(F.slice(x, start + 1, n), zero, plus)
    numbers = lambda x: F.sequence(zero, F.greatest(zero, F.floor((F.size(x) - 1) / block).cast("int")))
    sums = lambda x: F.transform(numbers(x), lambda k: over(x, k * block, block))
    heads = lambda s: F.transform(s, lambda _, k: over(s, zero, k))
    inside = lambda x, h: F.transform(x, lambda _, i: plus(F.get(h, F.floor(i / block).cast("int")), over(x, i - i % block, i % block)))
    return _let(values, lambda x: _let(sums(x), lambda s: _let(heads(s), lambda h: inside(x, h))))


def spans(text: Column, kind: Kind) -> Column:
    """Array of struct(kind, start, end, score), leftmost first; code points, end exclusive.

    Spark's functions return matches without places, so each match is taken with the gap before it and places are sums
    of lengths; ``\\G`` ties every match to the end of the one before.
    """
    gaps = rf"(?s)\G(.*?)({kind.pattern})"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(gaps), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(gaps), F.lit(2)).alias("match"))

    def span(x: Column, before: Column) -> Column:
        start = before + F.char_length(x["gap"])
        near = F.lower(F.right(x["gap"], F.lit(NEAR))).rlike(kind.context)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(x["match"])).alias("end"), (F.lit(kind.score) + F.when(near, 0.2).otherwise(0.0)).alias("score"), x["match"].alias("match"))

    lengths = lambda x: F.transform(x, lambda m: F.char_length(m["gap"]) + F.char_length(m["match"]))
    every = _let(both, lambda x: _let(_before(lengths(x), lambda a, b: a + b), lambda p: F.transform(x, lambda m, i: span(m, F.get(p, i)))))
    found = F.transform(F.filter(every, lambda s: _valid(kind.name, s["match"])), lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))
    return F.when(text.rlike(kind.hint), F.when(text.rlike(kind.pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", r"(?<![A-Za-z0-9._%+-])")), found)).otherwise(None)


def _all_spans(kinds: tuple[Kind, ...]) -> Column:
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.concat(*[F.coalesce(spans(whole(), k), empty) for k in kinds])


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``pii``: all spans of the whole text, by kind, then start. Null text: empty. No other column is read.

    Repeated rows give repeated results; an empty table gives no rows. A column ``pii`` that is there is replaced.
    """
    return docs.withColumn("pii", _all_spans(kinds))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = 0.5) -> DataFrame:
    """The documents with every confirmed span of a score of ``least`` or more replaced by its kind in angle brackets.

    Of overlapping spans the first counts. All columns stay as they are, whatever their names, but n_chars follows the
    text. Null and empty texts stay; repeated rows are treated alike; an empty table gives no rows.
    """
    marked = docs.select("text", _all_spans(kinds).alias("pii"), F.struct("*").alias("_doc"))
    cut = F.array_sort(F.transform(F.filter("pii", lambda s: s["score"] >= least), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = whole()

    # A span counts if it begins where all before it have ended.
    placed = _let(cut, lambda c: _let(_before(F.transform(c, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda p: F.transform(c, lambda s, i: F.struct(s["start"], s["kind"], F.get(p, i).alias("at")))))
    # Places are counted from the start of a string, so pieces come from parts of the text: else many spans cost its square.
    part = lambda x: F.floor(x / PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), part(F.char_length(text))), lambda k: F.substring(text, k * PART + 1, F.lit(PART)))

    def piece(c: Column, s: Column) -> Column:
        near = F.array_join(F.slice(c, part(s["at"]) + 1, part(s["start"]) - part(s["at"]) + 1), "")
        return F.concat(F.substring(near, s["at"] % PART + 1, s["start"] - s["at"]), F.lit("<"), s["kind"], F.lit(">"))

    kept = F.filter(placed, lambda s: s["start"] >= s["at"])
    tail = F.substring(text, F.array_max(F.transform(cut, lambda s: s["end"])) + 1, F.char_length(text))
    new = F.concat(F.array_join(_let(parts, lambda c: F.transform(kept, lambda s: piece(c, s))), ""), tail)
    done = marked.withColumn("text", F.when(F.size(cut) > 0, new).otherwise(F.col("text")))
    own = lambda c: F.col("text") if c == "text" else F.char_length("text").cast("long") if c == "n_chars" else F.col("_doc")[c]
    return done.select(*[own(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, the hash of the base spans, all spans as text, and the highest score.

    One row per row; other columns are ignored. Null or empty text: no spans, score 0. Repeated rows give repeated results.
    """
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    of = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    score = F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0))
    return find(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), score.alias("score"))
