"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Four base kinds follow fixed patterns and checks and are always kept. Further kinds (``iban``,
``secret``) are kept when their score reaches ``threshold``: the pattern alone gives too little, a
passed checksum (mod 97) or a context word close before the span lifts it above.

Positions are code points, the end exclusive. They come from the pieces between the matches:
``split`` and ``regexp_extract_all`` cut the text at the same places.

Patterns carry possessive quantifiers and a start condition (after a character outside the class,
or where the last match ended), which leave the matches as they are but keep long runs linear.

Defined cases: null text is empty and has no spans; equal rows get equal spans; an empty table
stays empty; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap necessary condition on the text.
    needs: str
    #: Score by pattern alone, and what a passed check and a context word add.
    pattern_score: float
    check_score: float
    context_score: float
    #: Lower-case words looked for in the ``CONTEXT`` characters before the span, back to the last match of the kind.
    context: str
    base: bool = True


#: Most characters before a span in which context words count.
CONTEXT = 40
#: Kinds in their order of output.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.0, 0.2, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.3, 0.4, 0.3, "ip|host|address|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.2, 0.5, 0.3, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.3, 0.4, 0.3, "phone|call|tel|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "", 0.2, 0.6, 0.2, "iban|account|bank|konto", base=False),
    Kind("secret", r"[A-Za-z0-9_-]++", "", 0.2, 0.3, 0.5, "token|secret|key|password|auth", base=False),
)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + _doubled(F.substr(digits, i, F.lit(1)).cast("int"), F.pmod(n - i, F.lit(2)) == 1),
    )
    return F.pmod(total, F.lit(10)) == 0


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(~twice, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def _mod97(iban: Column) -> Column:
    """Whether letters and digits pass the mod-97 check of account numbers."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, F.pmod(acc * 10 + c - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + c - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        parts = F.split(match, r"\.")
        bare = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (F.lpad(p, 3, "0") <= "255")))
    if kind.name == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind.name == "phone":
        return F.length(digits).between(8, 15)
    if kind.name == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), _mod97(bare)).otherwise(False)
    if kind.name == "secret":
        return match.rlike("^[0-9a-f]{32,64}$") & match.rlike("[a-f]") & match.rlike("[0-9]")
    return F.lit(True)


def _before(sizes: Column, block: int = 256) -> Column:
    """For each number of an array the sum of those before it.

    Sums run within blocks, then over the blocks' totals, so that no step copies a long array.
    """
    within = lambda b: F.aggregate(
        b,
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
    )
    starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        F.transform(starts, lambda k: within(F.slice(sizes, k, block))),
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("out")),
        lambda acc, b: F.struct((acc["sum"] + b["sum"]).alias("sum"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda v: v + acc["sum"]))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )


def _spans(kind: Kind, text: Column, threshold: float) -> Column:
    """array<struct<kind, start, end, score>> of one kind."""
    pattern = F.lit(kind.pattern)
    if kind.name == "secret":  # only the long runs matter; the short ones need no matching
        pattern = F.lit(r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{32,}+")
    # a gap and the match after it; the last gap has none
    cut = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda g, m: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("left"), m.alias("m"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("size")),
    )

    def scored(x: Column) -> Column:
        score = F.lit(kind.pattern_score + kind.check_score) + F.when(F.lower(x["left"]).rlike(kind.context), kind.context_score).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.round(score, 3).alias("score"))

    def spans(cut: Column) -> Column:
        placed = F.zip_with(cut, _before(F.transform(cut, lambda x: x["size"])), lambda x, at: F.struct((at + x["gap"]).alias("start"), x["left"].alias("left"), x["m"].alias("m")))
        found = F.transform(F.filter(placed, lambda x: F.when(x["m"].isNull(), False).otherwise(_confirmed(kind, x["m"]))), scored)
        return found if kind.base else F.filter(found, lambda s: s["score"] >= threshold)

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    maybe = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike(_RARE[kind.name])
    # an array of one, so that the text is cut once
    return F.when(maybe, F.flatten(F.transform(F.array(cut), spans))).otherwise(empty)


#: What a text must hold before a kind's costlier work starts.
_RARE = {"card": r"[0-9](?:[\x20-]?[0-9]){15}", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "secret": r"[0-9a-f]{32}"}


def find_personal_data(docs: DataFrame, text_col: str = "text", threshold: float = 0.6, out_col: str = "spans") -> DataFrame:
    """``docs`` with ``out_col``: array of (kind, start, end, score), by kind in order, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out_col, F.concat(*(_spans(k, text, threshold) for k in KINDS)))
