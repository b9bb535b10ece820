"""Secret scans with DataFrame functions only.

Base kinds are regular expressions; beside them, long strings of one character class are scanned with a sliding
window whose Shannon entropy comes from counts that change by one character in and one out. A string is reported
where windows reach the entropy of its class (hex digits, capitals and digits, others), unless the allow-list names it.

Offsets are in code points, ends exclusive. Positions come from what lies between the matches: the lengths of
gaps and matches, summed up. All of a text is scanned.

Defined cases: a null text counts as empty; a text without matches has no spans (and the digest of an empty
string); texts of any length are scanned whole; an empty table gives no rows; repeated rows are scanned each;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

# The base kinds, in the order of the list; expression, group whose length counts, its least length.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs are taken whole, so 18 characters at least can stand in the expression
HEX = r"[0-9a-f]{16,}"


#: The characters of a candidate string.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"


@dataclass(frozen=True)
class Entropy:
    """Windows of `window` characters. classes: expressions that a whole string may match, the first counts, and the bits a character that its windows need."""

    window: int = 20
    classes: tuple[tuple[str, float], ...] = (("^[0-9A-Fa-f]+$", 3.0), ("^[0-9A-Z]+$", 3.3), ("^[0-9A-Za-z+/_=-]+$", 3.6))
    #: Strings that are no secrets: words, words joined by marks, numbers, UUIDs, paths of words, stated placeholders.
    #: No group repeats without bound in it: Java's matcher would recurse for each repetition of a long string.
    allow: str = r"^[A-Za-z][A-Za-z_+/=-]*$|^[0-9][0-9_+/=-]*$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|(?i)(example|sample|placeholder|dummy|0123456789)"

    @property
    def weights(self) -> list[int]:
        """c log2 c for c equal characters in a window, in millionths: whole numbers, so that steps in and out cancel."""
        return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(self.window + 1)]

    def most(self, bits: float) -> int:
        """The largest sum of weights at which a window has so many bits a character."""
        return math.floor(self.window * (math.log2(self.window) - bits) * 1e6)


def running(steps: Column) -> Column:
    """Sums of the steps before each step. By blocks, as a fold copies what it has gathered at every step."""

    def fold(values: Column) -> Column:
        empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, empty, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(512)), lambda i: fold(F.slice(steps, i, 512)))
    sums = F.zip_with(blocks, fold(F.transform(blocks, lambda b: b["sum"]))["out"], lambda b, o: F.transform(b["out"], lambda v: v + o))
    return F.when(F.size(steps) > 0, F.flatten(sums)).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, kind: int, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, kind, end, found>> of the pattern's matches whose group has `least` characters."""
    found, sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.char_length(gap).cast("long") + F.coalesce(F.char_length(m), F.lit(0)))
    ends = F.slice(running(steps), 2, F.size(found))  # where the step after each match begins
    each = F.zip_with(F.arrays_zip(found.alias("found"), sized.alias("sized")), ends, lambda m, end: F.struct((end - F.char_length(m["found"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["found"].alias("found"), F.char_length(m["sized"]).alias("n")))
    kept = F.transform(F.filter(each, lambda s: s["n"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found")))
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,found:string>>"))


def hot_stretch(candidate: Column, rule: Entropy) -> Column:
    """struct<first, last>: from the first window that reaches the class's entropy to the end of the last; null if none does.

    The window's counts are kept as one character for each of ALPHABET, and each step changes two of them; the sum of
    c log c changes with them. A step that takes in the character that it gives up changes nothing.
    """
    w, weight = rule.window, rule.weights
    taking = F.array(*[F.lit(b - a).cast("long") for a, b in zip(weight[:-1], weight[1:], strict=True)])  # by the count before
    giving = F.array(*[F.lit(a - b).cast("long") for a, b in zip([0, *weight[:-1]], weight, strict=True)])
    limit = F.lit(None).cast("long")
    for pattern, bits in reversed(rule.classes):
        limit = F.when(F.rlike(candidate, F.lit(pattern)), F.lit(rule.most(bits)).cast("long")).otherwise(limit)
    # Each step sees its two places only: what a fold's body computes from the whole string would be computed at every step.
    at = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    behind = F.slice(F.concat(F.array_repeat(F.lit(0), w), at), F.lit(1), F.size(at))
    steps = F.transform(F.arrays_zip(at.alias("in"), behind.alias("out")), lambda s, i: F.struct(s["in"].alias("in"), s["out"].alias("out"), i.alias("i")))
    start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    count = lambda a, place: F.ascii(F.substring(a["counts"], place, 1)) - 48

    def step(a: Column, x: Column) -> Column:
        same, more, less = x["in"] == x["out"], count(a, x["in"]), count(a, x["out"])
        lost = F.when(x["out"] > 0, F.get(giving, less)).otherwise(0)
        total = F.when(same, a["sum"]).otherwise(a["sum"] + F.get(taking, more) + lost)
        left = F.when(x["out"] > 0, F.overlay(a["counts"], F.chr(47 + less), x["out"])).otherwise(a["counts"])
        hot = (x["i"] >= w - 1) & (total <= limit)
        return F.struct(
            F.when(same, a["counts"]).otherwise(F.overlay(left, F.chr(49 + more), x["in"])).alias("counts"),
            total.alias("sum"),
            F.when(hot & a["first"].isNull(), x["i"] - (w - 1)).otherwise(a["first"]).cast("int").alias("first"),
            F.when(hot, x["i"] + 1).otherwise(a["last"]).cast("int").alias("last"),
        )

    return F.aggregate(steps, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def entropy_spans(text: Column, rule: Entropy) -> Column:
    pattern = f"[0-9A-Za-z+/_=-]{{{rule.window},}}"
    suspects = F.filter(spans(text, 3, pattern), lambda s: ~F.rlike(s["found"], F.lit(rule.allow)))
    scanned = F.transform(suspects, lambda s: F.struct(s["start"].alias("start"), hot_stretch(s["found"], rule).alias("hot")))
    hot = F.filter(scanned, lambda s: s["hot"]["first"].isNotNull())
    return F.transform(hot, lambda s: F.struct((s["start"] + s["hot"]["first"]).alias("start"), F.lit(3).alias("kind"), (s["start"] + s["hot"]["last"]).alias("end")))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", rule: Entropy = Entropy()) -> DataFrame:
    """key, base and entropy: arrays of struct<start, kind (a place in KINDS), end>, base sorted by start and kind."""
    t = whole(text)
    plain = lambda found: F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.concat(plain(spans(t, 0, ASSIGN, ASSIGN_LEAST, 2)), plain(spans(t, 1, ACCESS)), plain(spans(t, 2, HEX)))
    return df.select(F.col(key).alias(key), F.array_sort(base).alias("base"), entropy_spans(t, rule).alias("entropy"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, text: str = "text", key: str = "doc_id", rule: Entropy = Entropy()) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, n_entropy, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(df, text, key, rule).select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        F.size("entropy").cast("long").alias("n_entropy"),
        listed(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
