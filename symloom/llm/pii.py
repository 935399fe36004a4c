"""Personal data by bootstrapped contextual extraction, in DataFrame functions.

Base entities (e-mail, IP, card, phone) come from fixed patterns.  They are the
seeds, whatever their form: the words left of an entity are a lexical pattern.
Over the bipartite graph of patterns and instances (identifier-like tokens, which hold a digit)
rounds of scoring alternate:

* a pattern's score is the mean confidence of its distinct instances, if at
  least ``SUPPORT`` of them are confident;
* an instance's confidence is the noisy-or of its patterns' scores.

Instances over ``ACCEPT`` become seeds of the next round.  After ``ROUNDS``
rounds every occurrence of an accepted (pattern, instance) that touches no base
entity is a span of kind ``id``.

Every step takes time in proportion to the text, or to the number of its spans
by its logarithm: regular expressions have possessive runs, entered only where a
run begins, and running sums over spans double their reach in each pass.

Defined results: a null or empty text has no spans; equal rows give equal rows;
a null id is kept; very long texts count whole; an empty table gives an empty
table; other columns stay as they are in ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, tune

#: Names of added columns begin so.
OWN = "__pii_"
KINDS = ("email", "ip", "card", "phone")

#: A run of local characters is entered at its begin, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # the maximal run of digits and single separators, if it has 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this cannot match; cheap to look for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: An identifier-like token: a maximal run of these characters of 6 or more, with a digit.
TOKEN = r"(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z@._%+/-]*+[0-9])[A-Za-z0-9@._%+/-]{6,}+"
#: The last two words before a span, in the text read backwards.
LEFT = r"^(\s*+\S++(?:\s++\S++)?+)"
#: Code points of a part in which positions of a text are looked up.
PART = 1024

ROUNDS = 3
SUPPORT = 3
ACCEPT = 0.6

_SPAN = "array<struct<s:int,e:int,m:string,left:string>>"


def _running(x: Column, op, zero: Column) -> Column:
    """Of each place of an array, ``op`` over the places up to it: every pass
    doubles the span, so n elements take log n passes, not n copies."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(x))
    return F.aggregate(steps, x, lambda acc, d: F.zip_with(acc, F.concat(F.array_repeat(zero, d), F.slice(acc, 1, F.size(acc) - d)), lambda a, b: op(a, b)))


def _matches(docs: DataFrame, kind: str, pattern: str, needs: str | None) -> DataFrame:
    """Adds the spans of all matches in code points, each with the text between it
    and the third match before it, cut to its last two words."""
    text, found, gaps, ends = (F.col(OWN + c) for c in ("text", "found", "gaps", "ends"))
    guard = text.rlike(pattern) if needs is None else F.contains(text, F.lit(needs)) & text.rlike(pattern)
    nothing = F.array().cast("array<string>")
    out = docs.withColumn(OWN + "found", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing))
    out = out.withColumn(OWN + "gaps", F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(nothing))
    sizes = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))
    out = out.withColumn(OWN + "ends", _running(sizes, lambda x, y: x + y, F.lit(0)))

    def span(m, i):
        e = F.get(ends, i)
        before = [F.coalesce(F.get(x, i - k), F.lit("")) for k in (2, 1) for x in (gaps, found)]
        left = F.reverse(F.regexp_extract(F.reverse(F.concat(*before, F.get(gaps, i))), LEFT, 1))
        return F.struct((e - F.char_length(m)).cast("int").alias("s"), e.cast("int").alias("e"), m.alias("m"), left.alias("left"))

    spans = F.when(F.size(found) > 0, F.transform(found, span)).otherwise(F.array().cast(_SPAN))
    return out.withColumn(OWN + kind, spans.cast(_SPAN)).drop(OWN + "found", OWN + "gaps", OWN + "ends")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0)))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _only_valid(kind: str) -> Column:
    return F.filter(f"{OWN}{kind}", lambda x: _valid(kind, x["m"]))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with the arrays ``email ip card phone token`` of spans."""
    out = docs.withColumn(OWN + "text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS:
        out = _matches(out, kind, PATTERNS[kind], NEEDS[kind])
    out = _matches(out, "token", TOKEN, None)
    for kind in KINDS:
        out = out.withColumn(f"{OWN}{kind}", _only_valid(kind))
    return out


def _candidates(scanned: DataFrame) -> DataFrame:
    """``(row, s, e, pattern, instance, seed)``: base entities (the seeds), and
    the tokens that touch none, in context."""

    def marked(spans: Column, token: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(token).alias("token"), *[x[k].alias(k) for k in ("e", "m", "left")]))

    # spans in order: a token touches a base span if one before ends beyond its
    # begin, or one after begins before its end
    both = F.array_sort(F.concat(*[marked(F.col(f"{OWN}{k}"), False) for k in KINDS], marked(F.col(OWN + "token"), True)))
    none = F.lit((1 << 31) - 1)
    one = scanned.select(OWN + "row", both.alias("all"))
    one = one.withColumn("ends", F.transform("all", lambda x: F.when(x["token"], 0).otherwise(x["e"])))
    one = one.withColumn("begins", F.reverse(F.transform("all", lambda x: F.when(x["token"], none).otherwise(x["s"]))))
    one = one.withColumn("ends", _running(F.col("ends"), F.greatest, F.lit(0)))
    one = one.withColumn("begins", F.reverse(_running(F.col("begins"), F.least, none)))
    free = F.filter("all", lambda x, i: ~x["token"] | ((F.get("ends", i) <= x["s"]) & (F.get("begins", i) >= x["e"])))
    return (
        one.select(OWN + "row", F.explode(free).alias("t"))
        .select(
            OWN + "row",
            F.col("t.s").alias("s"),
            F.col("t.e").alias("e"),
            F.regexp_replace(F.lower(F.col("t.left")), r"\s+", " ").alias("pattern"),
            F.xxhash64(F.lower(F.col("t.m"))).alias("instance"),
            (~F.col("t.token")).alias("seed"),
        )
        .filter("pattern <> ''")
    )


def bootstrap(candidates: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """``(pattern, instance)`` pairs discovered, seeds left out."""
    graph = materialise(candidates.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    known = graph.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("confidence", F.col("seed").cast("double"))
    for _ in range(rounds):
        scored = (
            graph.select("pattern", "instance")
            .join(known.select("instance", "confidence"), "instance")
            .groupBy("pattern")
            .agg(F.avg("confidence").alias("score"), F.sum((F.col("confidence") >= accept).cast("long")).alias("support"))
            .filter(F.col("support") >= support)
            .select("pattern", "score")
        )
        doubt = graph.join(scored, "pattern").groupBy("instance").agg(F.exp(F.sum(F.log(F.lit(1.0000001) - F.col("score")))).alias("doubt"))
        known = materialise(
            known.select("instance", "seed")
            .join(doubt, "instance", "left")
            .select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("doubt", F.lit(1.0)))).alias("confidence")),
            "pii-known",
        )
        patterns = scored
    good = known.filter((~F.col("seed")) & (F.col("confidence") >= accept)).select("instance")
    return graph.join(patterns.filter(F.col("score") >= accept / 2).select("pattern"), "pattern").join(good, "instance").select("pattern", "instance")


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns ``OWN`` + ``email ip card phone id``, each an
    array of spans ``(s, e)`` in code points, ascending."""
    tune(docs.sparkSession)
    scanned = scan(docs).drop(OWN + "text", *([] if keep_text else ["text"])).withColumn(OWN + "row", F.monotonically_increasing_id())
    scanned = materialise(scanned, "pii-scan")  # fixes the row numbers
    seen = _candidates(scanned)
    found = bootstrap(seen)
    span = F.struct("s", "e")
    spans = seen.filter(~F.col("seed")).join(found, ["pattern", "instance"]).groupBy(OWN + "row").agg(F.sort_array(F.collect_set(span)).alias(OWN + "id"))
    plain = "array<struct<s:int,e:int>>"
    out = scanned.join(spans, OWN + "row", "left").withColumn(OWN + "id", F.coalesce(F.col(OWN + "id"), F.array().cast(plain)))
    for kind in KINDS:
        out = out.withColumn(f"{OWN}{kind}", F.transform(f"{OWN}{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return out.drop(OWN + "row", OWN + "token")


def _written(kinds: tuple[str, ...]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(f"{OWN}{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.concat_ws(",", F.concat(*map(one, kinds)))


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans a document; the base spans apart as a digest."""
    return find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep_text=False).select(
        "doc_id",
        *[F.size(f"{OWN}{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written(KINDS), 256).alias("base_sha256"),
        _written((*KINDS, "id")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span in ``text`` replaced by its kind in brackets.

    Overlapping spans become one mark, that of the one that begins first."""
    def mark(kind: str) -> Column:
        return F.transform(f"{OWN}{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k")))

    others = [f"`{c.replace('`', '``')}`" for c in docs.columns if c != "text"]
    rows = find(docs.select(F.struct(F.lit(0).alias("text"), *others).alias(OWN + "all"), "text"))
    rows = rows.withColumn(OWN + "marks", F.array_sort(F.concat(*map(mark, (*KINDS, "id")))))
    marks, parts, upto = (F.col(OWN + c) for c in ("marks", "parts", "upto"))
    some = F.size(marks) > 0
    # a long text is looked up by parts: finding a position in a string takes time in proportion to it
    rows = rows.withColumn(OWN + "parts", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}+"), F.lit(0))))
    rows = rows.withColumn(OWN + "upto", F.when(some, F.concat(F.array(F.lit(0)), _running(F.transform(marks, lambda x: x["e"]), F.greatest, F.lit(0)))))

    def part(i: Column) -> Column:
        return F.coalesce(F.get(parts, i), F.lit(""))

    def piece(a: Column, b: Column) -> Column:
        i, j = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
        wide = F.concat(F.substring(part(i), a % PART + 1, F.lit(PART)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(part(j), F.lit(1), b % PART))
        return F.when(i == j, F.substring(part(i), a % PART + 1, b - a)).otherwise(wide)

    def written(x, i):
        return F.when(x["s"] < F.get(upto, i), F.lit("")).otherwise(F.concat(piece(F.get(upto, i), x["s"]), x["k"]))

    size = F.char_length("text")
    clean = F.concat(F.array_join(F.transform(marks, written), ""), piece(F.get(upto, F.size(marks)), size))
    new = F.when(some, clean).otherwise(F.col("text"))
    return rows.select(*[new.alias("text") if c == "text" else F.col(OWN + "all")[c].alias(c) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(load(spark, sf_dir, "documents"))
