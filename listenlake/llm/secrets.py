"""Secret scan: fixed patterns, and windows of high Shannon entropy inside long token-like strings.

All of it is Column expressions: no Python runs on the rows.

Fixed kinds ("base"), each leftmost and without overlap within its kind: `assign` (a key word, a sign, a value of 12 or
more characters), `access` (an access key id of 18 or more), `hex` (a run of 16 or more lower-case hex digits). A failing
match is dropped, and what it covered is not searched again.

Added kinds: a candidate is a whole run of the characters of a class with `window` or more characters. A window slides
over it; the counts of its characters, and the sum of n * log2(n) over them, are kept up to date by one character in and
one out. Where the entropy of a window reaches the class's bound, the span from the first such window to the end of the
last is a finding, unless the allow list suppresses the candidate.

Null and empty texts have no findings. Offsets count code points, the end is exclusive. Rows that repeat are scanned each
for itself. Extra columns are kept by find_secrets() unless they bear the name of its result, which replaces them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import let

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
MARK = "[SECRET]"


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters, the run of it that is a candidate, and the entropy in bits that a window must reach."""

    kind: str
    alphabet: str
    run: str
    least_bits: float
    must: tuple[str, ...]


DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HEX_CLASS = CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", "0-9a-fA-F", 3.0, ("[0-9]", "[a-fA-F]"))
BASE64_CLASS = CharacterClass(
    "entropy_base64", DIGITS + LOWER + LOWER.upper() + "+/=_-", "A-Za-z0-9+/=_-", 3.8, ("[0-9]", "[A-Za-z]")
)
CLASSES = (HEX_CLASS, BASE64_CLASS)

#: A candidate that any of these matches is no secret: UUIDs, runs of the alphabet, samples, rulers, word lists with
#: separators.
ALLOW = (
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)example|sample|placeholder|changeme|redacted|dummy|xxxxxx",
    r"(.)\1{5,}",
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]?[0-9]{0,4}$",
)

SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def running(values: Column, join, block: int = 256) -> Column:
    """The first value, the first two joined, and so on, of an array of longs. A list that grows by one element a step is
    copied at each step, so it is built in blocks, and what is ahead of a block comes from the totals of those before it."""

    def plain(some: Column) -> Column:
        def step(done: Column, v: Column) -> Column:
            before = F.coalesce(join(F.get(done, F.size(done) - 1), v), v)
            return F.concat(done, F.array(before)).cast("array<bigint>")

        return F.aggregate(some, F.array().cast("array<bigint>"), step)

    def shifted(blocks: Column) -> Column:
        ahead = plain(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        put = lambda b, a: F.transform(b, lambda v: F.coalesce(join(a, v), v))
        return let(ahead, lambda a: F.flatten(F.transform(blocks, lambda b, i: put(b, F.get(a, i - 1)))))

    def blocks(values: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
        return F.transform(cuts, lambda i: plain(F.slice(values, i * block + 1, F.lit(block))))

    return let(let(values, blocks), shifted)


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All matches with their places. What lies between matches, and the matches themselves, give the offsets."""

    def over(both: Column) -> Column:
        sizes = F.transform(
            both["matches"], lambda m, i: (F.length(F.get(both["gaps"], i)) + F.length(m)).cast("bigint")
        )

        def span(m: Column, end: Column) -> Column:
            return F.struct(
                (end - F.length(m)).cast("bigint").alias("start"),
                F.lit(kind).alias("kind"),
                end.alias("end"),
                (F.regexp_extract(m, pattern, value_group) if value_group else m).alias("value"),
            )

        ends = running(sizes, lambda a, v: a + v)
        return let(ends, lambda e: F.transform(both["matches"], lambda m, i: span(m, F.get(e, i)))).cast(SPAN)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches")
    found = let(F.struct(matches, F.split(text, pattern, -1).alias("gaps")), over)
    return F.when(text.rlike(pattern), found).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Findings of the fixed kinds, in no given order."""
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def _weights(window: int) -> list[int]:
    """n * log2(n) in millionths, so that sums are exact whichever way they come about."""
    return [round(1e6 * n * math.log2(n)) if n else 0 for n in range(window + 1)]


def _hot_windows(candidate: Column, kind: CharacterClass, window: int) -> Column:
    """First start and last end of the windows that reach the bound; first is -1 if there is none."""
    most = math.floor(1e6 * window * (math.log2(window) - kind.least_bits))
    weight = F.array(*[F.lit(w).cast("bigint") for w in _weights(window)])
    places = F.transform(
        F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(kind.alphabet), c) - 1
    )

    def over(at: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"),
            F.lit(0).cast("bigint").alias("total"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
        )

        def step(s: Column, i: Column) -> Column:
            into = F.get(at, i)
            out = F.when(i >= window, F.get(at, i - window)).otherwise(F.lit(-1))
            same = into == out
            n_in, n_out = F.get(s["counts"], into), F.get(s["counts"], out)
            entered = F.get(weight, n_in + 1) - F.get(weight, n_in)
            left = F.coalesce(F.get(weight, n_out - 1) - F.get(weight, n_out), F.lit(0).cast("bigint"))
            total = F.when(same, s["total"]).otherwise(s["total"] + entered + left)
            counts = F.when(same, s["counts"]).otherwise(
                F.transform(
                    s["counts"],
                    lambda n, j: n + F.when(j == into, 1).otherwise(0) - F.when(j == out, 1).otherwise(0),
                )
            )
            hot = (i >= window - 1) & (total <= most)
            return F.struct(
                counts.alias("counts"),
                total.alias("total"),
                F.when(hot & (s["first"] < 0), i - (window - 1)).otherwise(s["first"]).alias("first"),
                F.when(hot, i + 1).otherwise(s["last"]).alias("last"),
            )

        done = F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step)
        return F.struct(done["first"].alias("first"), done["last"].alias("last"))

    return let(places, over)


def entropy_spans(text: Column, kind: CharacterClass, window: int, allow: tuple[str, ...] = ALLOW) -> Column:
    """Findings of one class in the candidates of a text."""
    number = KINDS.index(kind.kind)

    def eligible(s: Column) -> Column:
        keep = F.lit(True)
        for pattern in kind.must:
            keep = keep & s["value"].rlike(pattern)
        for pattern in allow:
            keep = keep & ~s["value"].rlike(pattern)
        return keep

    def finding(s: Column) -> Column:
        return let(
            _hot_windows(s["value"], kind, window),
            lambda h: F.struct(
                (s["start"] + h["first"]).cast("bigint").alias("start"),
                F.when(h["first"] >= 0, F.lit(number)).otherwise(F.lit(-1)).alias("kind"),
                (s["start"] + h["last"]).cast("bigint").alias("end"),
                F.substr(s["value"], h["first"] + 1, h["last"] - h["first"]).alias("value"),
            ),
        )

    candidates = F.filter(_spans(text, f"[{kind.run}]{{{window},}}", number), eligible)
    return F.filter(F.transform(candidates, finding), lambda s: s["kind"] >= 0).cast(SPAN)


def find_secrets(docs: DataFrame, window: int = 20, classes: tuple[CharacterClass, ...] = CLASSES, allow=ALLOW) -> DataFrame:
    """docs with `base_findings` and `findings` (base and added), arrays of (start, kind, end, value) in order of start,
    then kind as in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("base_findings", F.sort_array(base_spans(text)))
    added = [entropy_spans(text, c, window, allow) for c in classes]
    return out.withColumn("findings", F.sort_array(F.concat(F.col("base_findings"), *added)))


def kind_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), number + 1)


def spans_text(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, findings: Column, mark: str = MARK) -> Column:
    """The text with each stretch of overlapping or touching findings replaced by the mark. findings: in order of start."""
    block = 256  # a place in a text is found from its beginning, so gaps are cut from the stretch of their block
    piece = lambda whole, a, b: F.substr(whole, (a + 1).cast("int"), (b - a).cast("int"))

    def cut(some: Column) -> Column:
        """Gaps of a block, each with the mark behind it."""
        a = some[0]["a"]
        stretch = piece(text, a, F.get(some, F.size(some) - 1)["b"])
        marked = lambda s: F.transform(some, lambda g: F.concat(piece(s, g["a"] - a, g["b"] - a), F.lit(mark)))
        return let(stretch, lambda s: F.array_join(marked(s), ""))

    def blocks(gaps: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / block).cast("int"))
        return F.array_join(F.transform(cuts, lambda i: let(F.slice(gaps, i * block + 1, F.lit(block)), cut)), "")

    def over(found: Column) -> Column:
        def masked(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            gap = lambda s, i: F.struct(before(i).alias("a"), s["start"].alias("b"), i.alias("i"))
            gaps = F.filter(F.transform(found, gap), lambda g: (g["b"] > g["a"]) | (g["i"] == 0))
            rest = F.substr(text, (F.get(ends, F.size(ends) - 1) + 1).cast("int"), F.length(text))
            return F.concat(let(gaps, blocks), rest)

        ends = running(F.transform(found, lambda s: s["end"]), lambda a, v: F.when(a > v, a).otherwise(v))
        return F.when(F.size(found) == 0, text).otherwise(let(ends, masked))

    return let(findings, over)


def redact(docs: DataFrame, **options) -> DataFrame:
    """Documents with their findings masked and n_chars brought up to date; no document goes. A null text stays null."""
    names = docs.columns
    masked = find_secrets(docs, **options).withColumn("text", redacted(F.col("text"), F.col("findings")))
    if "n_chars" in names:
        changed = F.size("findings") > 0
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*names)
