"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Entities that the base expressions find are seeds. The word before them, the two words before them and
their shape (digits one by one, letters by runs) are lexical patterns. Every other identifier-like token
(with four digits or more, an at sign or two colons, outside base spans) with the same words or shape is an instance of
the pattern too, such as a card number that the base drops because it stands right after a telephone number. Spark scores
this pattern-instance graph in rounds, until what is found no longer changes: a pattern by the share of its distinct
instances that are known, an instance by how sure its patterns are together. Tokens with fewer digits can only be an
address of their form: e-mail with an at sign, ip with two colons. Instances above ``confidence`` become known for the
next round, and all their occurrences become spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage

#: Kinds in the order of the contract. The expressions match what the contract's do, but never
#: scan a run of characters twice: a match starts at the start of a run or where the last match ended.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = (r"(?<![^\x20\x09-\x0D])(?:\+[0-9]++\x20?\([0-9]++\)\x20?[0-9]++(?:[.-][0-9]++)*+"
              r"|(?:[^\x20\x09-\x0D0-9]*+[0-9]){4}[^\x20\x09-\x0D]*+"
              r"|[^\x20\x09-\x0D@(]*+(?:@|\(at\))[^\x20\x09-\x0D]++|[0-9A-Fa-f]*+:[0-9A-Fa-f.]*+:[0-9A-Fa-f:.]*+(?![^\x20\x09-\x0D,;!?)]))")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPANS = "array<struct<start:int, no:int, end:int, value:string, one:string, two:string>>"


@dataclass(frozen=True)
class Settings:
    """``rounds`` bounds the rounds; ``support``: distinct known instances, base or found, a pattern needs; ``context``: characters looked at for the words before."""

    rounds: int = 50
    confidence: float = 0.8
    support: int = 5
    context: int = 80


def _matches(text: Column, expression: str, no: int, settings: Settings) -> Column:
    """Spans of an expression with the words before them; positions in code points."""
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    gaps = F.split(text, expression, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        before = F.lower(F.right(x["gap"], F.lit(settings.context)))
        span = F.struct(start.alias("start"), F.lit(no).alias("no"), (start + F.char_length(x["value"])).alias("end"), x["value"].alias("value"),
                        F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1).alias("one"),
                        F.regexp_extract(before, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1).alias("two"))
        return F.struct((start + F.char_length(x["value"])).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(pairs, empty, step, lambda s: s["spans"])).otherwise(F.array().cast(SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column, settings: Settings = Settings()) -> Column:
    """Checked base spans of all kinds, by start, then kind."""
    none = F.array().cast(SPANS)
    number = text.rlike("[0-9]")

    def kind(no: int, expression: str, holds, when: Column) -> Column:
        return F.when(when, F.filter(_matches(text, expression, no, settings), lambda s: holds(s["value"]))).otherwise(none)

    def between(low: int, high: int):
        return lambda v: F.length(_digits(v)).between(low, high)

    return F.array_sort(F.concat(
        kind(0, EMAIL, lambda v: F.lit(True), F.contains(text, F.lit("@"))),
        kind(1, IP, lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), number),
        kind(2, CARD, lambda v: between(12, 19)(v) & F.call_function("luhn_check", _digits(v)), number),
        kind(3, PHONE, between(9, 15), F.contains(text, F.lit("+")) & number)))


def identifiers(text: Column, settings: Settings = Settings()) -> Column:
    """Identifier-like tokens, without the punctuation around them."""
    core = r"(?:::)?[+\p{L}\p{N}](?:.*[\p{L}\p{N}])?"

    def trimmed(s: Column) -> Column:
        value = F.regexp_extract(s["value"], core, 0)
        start = s["start"] + F.instr(s["value"], value) - 1
        return F.struct(start.alias("start"), F.lit(9).alias("no"), (start + F.char_length(value)).cast("int").alias("end"),
                        value.alias("value"), s["one"].alias("one"), s["two"].alias("two"))

    spans = F.filter(F.transform(_matches(text, IDENTIFIER, 9, settings), trimmed).cast(SPANS), lambda s: F.length(s["value"]) > 0)
    return F.when(text.rlike(r"[0-9@]|\(at\)|:[0-9A-Fa-f.]*:"), spans).otherwise(F.array().cast(SPANS))


def fits(value: Column, no: Column) -> Column:
    """Whether a token can be of a kind at all: four digits can be anything, fewer only an address of its form."""
    email, ip = value.rlike(r"@|\(at\)"), value.rlike("^[0-9A-Fa-f.]*:[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*$")
    return (F.regexp_count(value, F.lit("[0-9]")) >= 4) | ((no == 0) & email) | ((no == 1) & ip)


def marked(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, key (hash of the text), base spans and identifiers outside them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), base_spans(text, settings).alias("base"),
                       identifiers(text, settings).alias("others"))
    free = F.filter("others", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return rows.withColumn("others", free)


def bootstrap(rows: DataFrame, stage: Stage, settings: Settings) -> DataFrame:
    """value, no (kind) of the identifiers that confident patterns discover."""
    def edges(spans: str, no: Column) -> DataFrame:
        s = rows.select(F.explode(spans).alias("s")).select(F.col("s.value").alias("value"), no.alias("no"), F.col("s.one").alias("one"), F.col("s.two").alias("two"))
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), "[A-Z]+", "A"), r"[\p{L}&&[^A]]+", "a")
        patterns = F.array(F.concat(F.lit("1 "), "one"), F.concat(F.lit("2 "), "two"), F.concat(F.lit("s "), shape))
        return s.select("value", "no", F.explode(patterns).alias("pattern")).where(
            F.length("pattern") > 2).distinct()

    known = edges("base", F.col("s.no"))
    graph = stage.save(known.unionByName(edges("others", F.lit(None).cast("int"))), "graph")
    # a pattern with fewer instances can never have the support
    sizes = stage.save(graph.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= settings.support), "patterns")
    seeds = graph.where("no is not null").select("pattern", "no", "value", F.lit(1.0).alias("score"))
    found, before = None, None
    for step in range(settings.rounds):
        sure = seeds
        if found is not None:
            sure = seeds.unionByName(stage.again("graph", graph).where("no is null").drop("no").join(found, "value").select(
                "pattern", "no", "value", "score"))
        # what was found in the last round supports patterns as base seeds do, weighted by how sure it is
        sure = sure.groupBy("pattern", "no", "value").agg(F.max("score").alias("score")).groupBy("pattern", "no").agg(
            F.count("*").alias("known"), F.sum("score").alias("seeds")).where(F.col("known") >= settings.support)
        scores = sure.join(sizes, "pattern").select(
            "pattern", "no", (F.col("seeds") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= settings.confidence)
        # an instance is wrong only if all its patterns are
        doubt = stage.again("graph", graph).where("no is null").drop("no").join(scores, "pattern").where(fits(F.col("value"), F.col("no"))).groupBy("value", "no").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("score"))
        best = doubt.groupBy("value").agg(F.max_by(F.struct("no", "score"), F.struct("score", -F.col("no"))).alias("b"))
        found = stage.save(best.select("value", "b.no", "b.score"), f"found-{step}")
        state = found.agg(F.count("*"), F.sum(F.xxhash64("value", "no", F.round("score", 9)).cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return found


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, key, base and all spans (arrays by start, then kind) of every document.

    ``key`` is the hash of the text, a null text being empty. Positions count code points from 0, ends are
    exclusive. Base spans always stay; discovered ones never overlap a base span. Repeated rows get the same
    spans each. Without seeds nothing is discovered. An empty table gives no rows; other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "pii")
    rows = stage.save(marked(docs, settings), "rows")
    found = bootstrap(rows, stage, settings)
    again = stage.again("rows", rows)
    hits = again.select("doc_id", "key", F.explode("others").alias("o")).join(found.select(F.col("value").alias("known"), F.col("no").alias("kind")),
                                                                          F.expr("o.value = known"))
    more = hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct(
        F.col("o.start").alias("start"), F.col("kind").alias("no"), F.col("o.end").alias("end"), F.col("o.value").alias("value"),
        F.col("o.one").alias("one"), F.col("o.two").alias("two"))).cast(SPANS).alias("more"))
    more = stage.save(more, "more")
    return rows.alias("r").join(more.alias("m"), F.expr("r.doc_id <=> m.doc_id and r.key = m.key"), "left").select(
        "r.doc_id", "r.key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"], s["end"])), ",")


def counted(no: int) -> Column:
    return F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; of overlapping spans the first names the kind."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substr(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), F.element_at(names, s["no"] + 1), F.lit(">"))
        out = F.when(s["start"] >= state["at"], fresh).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def redact(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every span in its texts replaced by ``<kind>``; all rows and columns stay.

    Null and empty texts stay as they are, repeated rows are redacted alike, an empty table stays empty.
    """
    found = find(docs, settings).where(F.size("spans") > 0).select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    # the row travels as one struct, so no column of it can clash with the keys
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    joined = rows.alias("r").join(found.alias("f"), F.expr("r.id <=> f.doc_id and r.key = f.key"), "left")
    text = F.col("row.text").cast("string")
    clean = F.when(F.col("spans").isNotNull(), redacted(text, F.col("spans"))).otherwise(text)
    return joined.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
