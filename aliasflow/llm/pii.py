"""Personal data by weak supervision, in built-in functions only.

Patterns propose spans.  Four labelers vote on each (for, against, abstain): its format, gazetteers of endings, issuers,
calling codes and titles, words of context before it, and its edges.  The votes of all documents, counted by pattern
of votes, are the sufficient statistics from which expectation-maximisation estimates each labeler's reliability, kind
by kind, without labels; its posteriors then train a logistic span classifier on votes, kind and length.  There are at
most a few thousand patterns however many documents, so both fits run on the driver.  The classifier is one column
expression; spans that pass their kind's base check are kept whatever it says, other proposals if it accepts them.

* A null text is empty and has no spans.  Each row gives one row, so repeated rows repeat; no documents give no rows.
* Other columns, whatever their names, are kept, but for one that bears the name of the result.
* Each pattern reads a text once: what it proposes is stored in the shared folder, counted, and judged from there.
* Offsets are code points.  Where kinds overlap all base spans are kept; an added span that touches a base one, or an
  added one before it, goes.
* Patterns never look twice at a run they have read, so long runs of digits or letters cost time in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound, running
from .common import stored, table

#: Base kinds in their order, then those that only the method adds.
KINDS = ("email", "ip", "card", "phone", "name", "secret")
BASE = KINDS[:4]
#: A match begins where its run begins, or where the last match ended; possessive repeats never give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "phone": r"(?=[(0-9])(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "name": r"(?=[DFHMPS])(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
    "secret": r"(?=[apst])(?<![A-Za-z])(?:password|passwd|pwd|secret|api_key|token)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{8,200}",
}
#: What must occur in a text for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
# Gazetteers.
ENDINGS = "com|org|net|edu|gov|io|info|de|fr|es|uk|it|nl|eu|ch|at|jp|ca|au"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CALLING = r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Words of context, before a span.
FOR = {
    "email": r"(?i)(?:e-?mail|contact|mailto|write to|reach)\W*$",
    "ip": r"(?i)(?:\bip|address|host|server|from)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|payment|credit)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|contact)\W*$",
    "name": r"(?i)(?:dear|by|with|from|signed)\W*$",
    "secret": r"(?i)(?:my|the|our|your|login|account)\W*$",
}
AGAINST = {
    "email": r"(?i)(?:https?://\S*)$",
    "ip": r"(?i)(?:version|ver|v|release|section)\W*$",
    "card": r"(?i)(?:isbn|issn|order|tracking|serial|doi)\W*$",
    "phone": r"(?i)(?:=|\be|version)\W*$",
    "name": r"(?i)(?:street|hotel|cafe)\W*$",
    "secret": r"(?i)(?:example|sample)\W*$",
}
#: Comes after every offset.
LAST = 2**31 - 1
VOTES = ("v_format", "v_gazetteer", "v_context", "v_edge")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of digits."""
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    figure = lambda i: F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
    places = F.when(F.length(number) > 0, F.sequence(F.lit(0), F.length(number) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, figure(i)).otherwise(twice(figure(i)))) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")), lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255)),
    "card": lambda m: F.length(digits(m)).between(12, 19) & luhn(F.substring(digits(m), 1, 19)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


#: Two control characters that mark off matches.  In a text they become a third one, which no pattern tells from them.
MARK, END, OTHER = "\x01", "\x03", "\x02"
MATCHES = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match, up to 24 characters since the last match, the character after).

    The pattern reads the text once and marks off what it finds; offsets are running sums of lengths.
    """
    marked = F.regexp_replace(F.translate(text, MARK + END, OTHER * 2), rf"(?s)(?:{pattern})(?=(.)?)", f"{MARK}$0{END}$1{MARK}")
    said = lambda x: F.substring_index(x, END, 1)

    def spans(pieces: Column) -> Column:
        """Of text and matches by turns."""
        starts = running(F.transform(pieces, lambda x: F.length(said(x))), lambda x, y: x + y, 0)
        each = F.zip_with(F.zip_with(pieces, starts, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), F.slice(pieces, 2, F.size(pieces)), lambda y, x: F.struct(y["x"].alias("gap"), (y["at"] + F.length(y["x"])).alias("at"), x.alias("x")))
        own = F.filter(each, lambda y, i: (i % 2 == 0) & y["x"].isNotNull())
        return F.transform(own, lambda y: F.struct(y["at"].alias("start"), (y["at"] + F.length(said(y["x"]))).alias("end"), said(y["x"]).alias("match"), F.right(y["gap"], F.lit(24)).alias("before"), F.substring_index(y["x"], END, -1).alias("after")))

    return bound(F.split(marked, MARK, -1), lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(F.array().cast(MATCHES)))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(m.rlike(rf"(?i)\.(?:{ENDINGS})$"), m.rlike(r"\.[0-9]+$"))
    if kind == "ip":
        return _vote(~m.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\."), m.rlike(r"^0+\."))
    if kind == "card":
        return _vote(digits(m).rlike(ISSUERS), m.rlike(r"^0|^([0-9])\1{7}"))
    if kind == "phone":
        return _vote(m.rlike(CALLING), m.rlike(r"^\+0"))
    if kind == "name":
        return _vote(m.rlike(r"\.\x20|\x20\p{Lu}\p{Ll}+\x20"), F.lit(False))
    return _vote(m.rlike("[0-9]") & m.rlike(r"[=:]\x20?\"?.*[A-Za-z]"), ~m.rlike("[0-9]"))


def _format(kind: str, m: Column, base: bool) -> Column:
    if base:
        return _vote(CHECKS[kind](m), ~CHECKS[kind](m))
    if kind == "phone":
        return _vote(m.rlike(r"^\("), m.rlike(r"^[0-9]{3}([.])[0-9]{3}[^.]"))
    if kind == "secret":
        return _vote(F.length(m) >= 20, F.length(m) < 16)
    return F.lit(0)


def _proposals(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """The matches of one pattern that are not failing base matches, with their votes."""

    def judged(x: Column) -> Column:
        inside = x["before"].rlike(r"[A-Za-z0-9@_]$") | x["after"].rlike(r"^[A-Za-z0-9@_]")
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["end"].alias("end"),
            F.lit(base).alias("base"),
            _format(kind, x["match"], base).alias("v_format"),
            _gazetteer(kind, x["match"]).alias("v_gazetteer"),
            _vote(x["before"].rlike(FOR[kind]), x["before"].rlike(AGAINST[kind])).alias("v_context"),
            F.when(inside, -1).otherwise(1).alias("v_edge"),
            F.least(F.floor((x["end"] - x["start"]) / 6).cast("int"), F.lit(6)).alias("size"),
        )

    found = matches(text, pattern)
    if base and kind != "email":
        found = F.filter(found, lambda x: CHECKS[kind](x["match"]))
    return F.when(_needed(text, kind, base), F.transform(found, judged)).otherwise(F.array().cast(SPANS))


def _needed(text: Column, kind: str, base: bool) -> Column:
    """What must hold of a text for a pattern to be tried; cheaper than the pattern."""
    if base and kind in ("email", "phone"):
        return F.contains(text, F.lit(NEEDS[kind]))
    if kind == "name":
        return F.lit(True)
    if kind == "secret":
        return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return text.rlike("[0-9]{2}|[0-9][. -][0-9]")


SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,v_format:int,v_gazetteer:int,v_context:int,v_edge:int,size:int>>"


def proposals(text: Column) -> Column:
    """All proposed spans of a text, in order of start and kind."""
    each = [_proposals(text, k, p, True) for k, p in PATTERNS.items()] + [_proposals(text, k, p, False) for k, p in ADDED.items()]
    return F.array_sort(F.concat(*(x.cast(SPANS) for x in each)))


def reliabilities(patterns: list[tuple], rounds: int = 40) -> tuple[dict, dict[tuple, float]]:
    """EM of the two-class model with one table of vote probabilities a labeler, kind by kind.

    ``patterns``: (kind, votes, size, count).  Returns the tables by (kind, labeler) and the posterior of each pattern.
    """
    tables: dict = {}
    posterior = {(k, v, s): min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for k, v, s, _ in patterns}
    for kind in sorted({p[0] for p in patterns}):
        own = [p for p in patterns if p[0] == kind]
        for _ in range(rounds):
            total = sum(n for *_, n in own)
            prior = min(0.99, max(0.01, (sum(n * posterior[k, v, s] for k, v, s, n in own) + 1) / (total + 2)))
            for j in range(len(VOTES)):
                seen = {(y, x): 0.5 + (3.0 if x == y else 0.0) for y in (-1, 1) for x in (-1, 0, 1)}  # labelers are better than chance
                for k, v, s, n in own:
                    seen[1, v[j]] += n * posterior[k, v, s]
                    seen[-1, v[j]] += n * (1 - posterior[k, v, s])
                tables[kind, j] = {(y, x): seen[y, x] / sum(seen[y, z] for z in (-1, 0, 1)) for y, x in seen}
            for k, v, s, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(tables[kind, j][1, x] / tables[kind, j][-1, x]) for j, x in enumerate(v))
                posterior[k, v, s] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return tables, posterior


def classifier(patterns: list[tuple], posterior: dict[tuple, float], steps: int = 300) -> dict[tuple, float]:
    """Weights of a logistic regression of the posteriors on kind, votes and size, each pattern weighing the logarithm of its count."""
    weight: dict[tuple, float] = {}
    grown: dict[tuple, float] = {}
    for _ in range(steps):
        slope: dict[tuple, float] = {}
        for k, v, s, n in patterns:
            keys = [("kind", k), ("size", s), *(("vote", j, x) for j, x in enumerate(v) if x)]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(x, 0.0) for x in keys)))))
            for x in keys:
                slope[x] = slope.get(x, 0.0) + math.log1p(n) * (posterior[k, v, s] - p)
        for x, g in slope.items():
            g -= 0.05 * weight.get(x, 0.0)
            grown[x] = grown.get(x, 1e-6) + g * g
            weight[x] = weight.get(x, 0.0) + 0.5 * g / math.sqrt(grown[x])
    return weight


def fit(proposed: DataFrame, spans: str) -> dict[tuple, float]:
    """The span classifier, from the votes on all proposals in all documents."""
    each = proposed.where(F.size(spans) > 0).select(F.explode(spans).alias("s")).select("s.*")
    rows = each.groupBy("kind", *VOTES, "size").agg(F.count("*").alias("n")).collect()  # at most kinds x 3**4 votes x 7 sizes
    patterns = [(r.kind, tuple(r[x] for x in VOTES), r["size"], r.n) for r in rows]
    return classifier(patterns, reliabilities(patterns)[1])


def accepted(spans: Column, weight: dict[tuple, float]) -> Column:
    """Base spans, and those that the classifier accepts and that touch none before them."""

    def score(s: Column) -> Column:
        total = F.lit(0.0)
        for key, w in sorted(weight.items(), key=str):
            hit = s[key[0]] == key[1] if key[0] != "vote" else s[VOTES[key[1]]] == key[2]
            total = total + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
        return total

    def alone(good: Column) -> Column:
        """Added spans that touch no base span, in order."""
        before = running(F.transform(good, lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest, 0)
        later = F.reverse(running(F.reverse(F.transform(good, lambda s: F.when(s["base"], s["start"]).otherwise(LAST))), F.least, LAST))
        near = F.zip_with(good, F.zip_with(before, later, lambda x, y: F.struct(x.alias("p"), y.alias("q"))), lambda s, n: F.struct(s.alias("s"), (~s["base"] & (n["p"] <= s["start"]) & (n["q"] >= s["end"])).alias("free")))
        return F.transform(F.filter(near, lambda x: x["free"]), lambda x: x["s"])

    def first_come(free: Column) -> Column:
        """Of each run of added spans that overlap, those that begin after the last one kept ends."""
        reach = running(F.transform(free, lambda s: s["end"]), F.greatest, 0)
        heads = F.filter(F.zip_with(F.zip_with(free, reach, lambda s, r: s["start"] >= r), F.sequence(F.lit(1), F.size(free)), lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
        runs = lambda h: F.zip_with(h, F.concat(F.slice(h, 2, F.size(h)), F.array(F.size(free) + 1)), lambda a, b: F.slice(free, a, b - a))
        pick = lambda run: F.aggregate(run, F.array().cast(SPANS), lambda acc, s: F.when(F.exists(acc, lambda b: s["start"] < b["end"]), acc).otherwise(F.concat(acc, F.array(s))))
        return F.when(F.size(free) > 0, F.flatten(F.transform(bound(heads, runs), pick))).otherwise(free)

    base = F.filter(spans, lambda s: s["base"])
    added = bound(bound(F.filter(spans, lambda s: s["base"] | (score(s) > 0)), alone), first_come)
    return F.when(F.exists(spans, lambda s: ~s["base"]), F.array_sort(F.concat(base, added))).otherwise(spans)


def find_pii(docs: DataFrame, text: str = "text", into: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or of it only the columns ``keep``, with the spans found: array of (start, kind number, end, base, votes, size)."""
    rest = [x for x in (docs.columns if keep is None else keep) if x != into]
    proposed = docs.select(F.struct(*(F.col(f"`{x}`") for x in rest)).alias("row"), proposals(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("proposed"))
    proposed = stored(proposed, "proposals")
    return proposed.select("row.*", accepted(F.col("proposed"), fit(proposed, "proposed")).alias(into))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by its first kind in angle brackets."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, out).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind."""
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    found = find_pii(rows)
    masked = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select(*((masked if x == text else F.col(f"row.`{x}`")).alias(x) for x in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    names = F.array(*(F.lit(k) for k in KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long")
