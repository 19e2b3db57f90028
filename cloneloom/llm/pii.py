"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans (email, ip, card, phone) are the seeds. The words before a seed are
its lexical patterns; patterns and the identifier-like strings that follow
them form a graph. A pattern's confidence for a kind is the share of its
strings that are known to be of that kind; a string becomes known when a
confident pattern precedes it and its shape fits the kind; and so on until no
more strings become known. Strings found so are added as spans. Only DataFrame functions are
used, and documents are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: Kinds in the order in which their spans are listed.
KINDS = ("email", "ip", "card", "phone")

# The same matches as the contract's patterns. Loops that can't usefully give
# back what they took are possessive, and runs are entered at their start only
# (or where the last match ended), so that long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What may be an identifier, wherever it stands.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++|[+(]?[0-9][\x20().0-9-]{4,}[0-9]"

#: Characters before a candidate in which its context words are sought.
CONTEXT_CHARS = 64

#: A pattern with this confidence makes strings known. One is added to the
#: strings it is divided by, so a pattern needs nine known strings at least.
CONFIDENT = 0.9

SPAN = "array<struct<s: int, e: int>>"

FOUND = "array<struct<s: int, e: int, value: string, before: string>>"

#: Matches whose positions are summed up at once.
BLOCK = 256

#: Spans of a text up to which each candidate is held against all base spans;
#: those of other texts meet in a window.
FEW = 200


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, context: int = 0) -> Column:
    """Array of (s, e, value, before) of all matches: code points, end
    exclusive, and the last ``context`` characters before.

    Positions are summed up inside blocks of ``BLOCK`` matches and then over
    the blocks, as adding to one long array would copy it for every match.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    none = F.array().cast(FOUND)
    last = (lambda x: F.right(x, F.lit(context))) if context else (lambda x: F.lit(""))

    def step(state: Column, pair: Column) -> Column:
        s = state["at"] + F.length(pair["gap"])
        e = s + F.length(pair["hit"])
        before = last(F.concat(state["tail"], last(pair["gap"])))
        new = F.struct(s.alias("s"), e.alias("e"), pair["hit"].alias("value"), before.alias("before"))
        tail = last(F.concat(before, last(pair["hit"])))
        return F.struct(e.alias("at"), tail.alias("tail"), F.concat(state["out"], F.array(new)).alias("out"))

    def placed(part: Column, tail: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), tail.alias("tail"), none.alias("out")), step)

    def tail_before(whole: Column, first: Column) -> Column:
        # a match has a character at least, so this many hold the context
        count = F.least(first - 1, F.lit(context))
        joined = F.array_join(F.transform(F.slice(whole, first - count, count), lambda x: F.concat(last(x["gap"]), last(x["hit"]))), "")
        return last(joined)

    def shifted(state: Column, block: Column) -> Column:
        out = F.transform(block["out"], lambda x: F.struct((x["s"] + state["at"]).alias("s"), (x["e"] + state["at"]).alias("e"), x["value"].alias("value"), x["before"].alias("before")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

    def joined(whole: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(whole), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda first: placed(F.slice(whole, first, F.lit(BLOCK)), tail_before(whole, first)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("out"))
        spans = F.flatten(F.aggregate(blocks, start, shifted, lambda state: state["out"]))
        return F.when(F.size(whole) == 0, none).when(F.size(whole) <= BLOCK, placed(whole, F.lit(""))["out"]).otherwise(spans)

    return _let(pairs, joined)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _part_fits(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _part_fits),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}

#: What a found string must look like to be of a kind.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^([0-9][\x20-]?){11,18}[0-9]$",
    "phone": r"^\+?[(]?([0-9][\x20().-]{0,3}){6,14}[0-9]$",
}

#: What a text must hold to be searched for a kind at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column, kind: str) -> Column:
    """Array of (s, e) of a kind's matches that hold."""
    valid = F.filter(_found(text, PATTERNS[kind]), lambda x: VALID[kind](x["value"]))
    spans = F.transform(valid, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPAN))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans of each text, and what may be an identifier with the text
    before it. The only pass over texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    rows = rows.withColumns({k: base_spans(F.col("text"), k) for k in KINDS})
    found = F.when(F.col("text").rlike("[0-9@]"), _found(F.col("text"), CANDIDATE, CONTEXT_CHARS)).otherwise(F.array().cast(FOUND))
    return rows.withColumn("found", found).drop("text")


def _first_kind(meets) -> Column:
    return reduce(lambda e, k: e.when(meets(k), k), KINDS[1:], F.when(meets(KINDS[0]), KINDS[0]))


def _in_windows(rich: DataFrame) -> DataFrame:
    """(doc_id, h, x, kind) of texts with many spans: their candidates and base
    spans in order, each candidate seeing the base spans around it."""
    null = F.lit(None).cast("string")

    def placed(base: Column, value, before):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), value(x).alias("value"), before(x).alias("before"))

    spans = [F.transform(k, placed(F.lit(k), lambda x: null, lambda x: null)) for k in KINDS]
    own = F.transform("found", placed(null, lambda x: x["value"], lambda x: x["before"]))
    # the number of the row keeps repeated rows apart
    rows = rich.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "h", "row", F.explode(F.concat(*spans, own)).alias("x")).select("doc_id", "h", "row", "x.*")
    # both frames run from the start of their order: the other way each row
    # would read all that follow it
    text = Window.partitionBy("doc_id", "h", "row")
    so_far = text.orderBy("s", F.col("base").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = text.orderBy(F.desc("s"), F.col("base").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {k: F.max(F.when(F.col("base") == k, F.col("e"))).over(so_far) for k in KINDS}
    following = {k: F.min(F.when(F.col("base") == k, F.col("s"))).over(from_here) for k in KINDS}
    rows = rows.withColumn("kind", _first_kind(lambda k: F.coalesce(last[k] > F.col("s"), F.lit(False)) | F.coalesce(following[k] < F.col("e"), F.lit(False))))
    return rows.filter("base is null").select("doc_id", "h", F.struct("s", "e", "value", "before").alias("x"), "kind")


def _occurrences(scan: DataFrame) -> DataFrame:
    """(doc_id, h, s, e, value, kind, patterns): kind is that of a base span
    that it meets, or null. ``scan`` is a written table."""
    n_spans = F.size("found") + sum((F.size(k) for k in KINDS), F.lit(0))
    rows = scan.filter(n_spans <= FEW).select("doc_id", "h", *KINDS, F.explode("found").alias("x"))
    meets = lambda kind: F.exists(kind, lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s")))
    rows = rows.select("doc_id", "h", "x", _first_kind(meets).alias("kind"))
    rows = rows.unionByName(_in_windows(scan.filter(n_spans > FEW)))
    words = F.split(F.trim(F.regexp_replace(F.lower("x.before"), r"\s+", " ")), " ")
    two = F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, -2, 2)))
    one = F.when(F.length(F.element_at(words, -1)) > 0, F.element_at(words, -1))
    return rows.select("doc_id", "h", "x.s", "x.e", F.lower("x.value").alias("value"), "kind", F.array_compact(F.array(one, two)).alias("patterns"))


def _fits(value: Column, kind: str) -> Column:
    return value.rlike(SHAPES[kind])


def bootstrap(seen: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind, confidence) of confident patterns.

    ``seen``: a written table of occurrences. Counts are of distinct strings,
    so copies of a document prove nothing. Each round but the last makes
    strings known, so the rounds come to an end.
    """
    edges = seen.select(F.explode("patterns").alias("pattern"), "value", "kind")
    edges = written(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    # only patterns that precede a seed can come to be confident for its kind,
    # directly or through what confident ones made known
    known = written(edges.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("known")), "known")
    while True:
        # strings grow with the documents, so they aren't for broadcasting
        scored = edges.join(known.hint("merge"), "value", "left")
        sums = {k: F.sum(F.when(F.col("known") == k, 1).otherwise(0)).alias(k) for k in KINDS}
        counts = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums.values())
        best = F.greatest(*(F.struct((F.col(k) / (F.col("n") + 1)).alias("confidence"), F.lit(k).alias("kind")) for k in KINDS))
        patterns = counts.select("pattern", best.alias("best")).select("pattern", "best.*").filter(F.col("confidence") >= confident)
        patterns = written(patterns, "patterns")
        if patterns.isEmpty():
            break
        new = edges.select("pattern", "value").join(patterns, "pattern").join(known.hint("merge"), "value", "left_anti")
        fits = reduce(lambda e, k: e | ((F.col("kind") == k) & _fits(F.col("value"), k)), KINDS, F.lit(False))
        new = new.filter(fits).groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("known"))
        new = written(new, "new")
        if new.isEmpty():
            break
        known = written(known.unionByName(new), "known")
    return patterns


def find(docs: DataFrame, confident: float = CONFIDENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_found.

    ``n_`` columns and the digest are of base spans; ``spans`` lists them and
    those that the method adds. A null text is empty, a very long one is
    searched whole. Repeated rows get the same spans, null ids are ids like
    others; of kinds with the same confidence the last in the alphabet wins.
    Other columns are ignored; an empty table stays empty.
    """
    scan = written(_scan(docs, id_col, text_col), "scan")
    seen = written(_occurrences(scan), "occurrences")
    patterns = bootstrap(seen, confident)
    open_ = seen.filter("kind is null").select("doc_id", "h", "s", "e", "value", F.explode("patterns").alias("pattern"))
    hits = open_.join(patterns, "pattern")
    fits = reduce(lambda e, k: e | ((F.col("kind") == k) & _fits(F.col("value"), k)), KINDS, F.lit(False))
    hits = hits.filter(fits).groupBy("doc_id", "h", "s", "e").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    hits = hits.groupBy("doc_id", "h").agg(F.collect_set(F.struct("kind", "s", "e")).alias("more"))
    hits = written(hits.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "more"), "found")
    none = F.array().cast("array<struct<kind: string, s: int, e: int>>")
    if hits.isEmpty():
        rows = scan.withColumn("more", none)
    else:
        rows = scan.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")

    def own(kind: str, with_more: bool) -> Column:
        if not with_more:
            return F.col(kind)
        added = F.filter(F.coalesce("more", none), lambda x: x["kind"] == kind)
        return F.sort_array(F.concat(kind, F.transform(added, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    def named(kind: str, with_more: bool) -> Column:
        return F.transform(own(kind, with_more), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    def listed(with_more: bool) -> Column:
        return F.concat_ws(",", F.concat(*(named(k, with_more) for k in KINDS)))

    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(False), 256).alias("base_sha256"),
        listed(True).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"),
    )
