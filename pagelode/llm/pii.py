"""Personal data: patterns first, then terms that give a protected entity away.

The patterns find e-mail addresses, IP addresses, card numbers and telephone numbers.
Each distinct value is a protected entity. Other words of its documents may reveal it
even when the value itself is gone: co-occurrence over the corpus says how much. A term
discloses an entity by the share of the entity's information that it carries for sure,

    (PMI(entity, term) - z / sqrt(n_et)) / IC(entity),
    PMI(entity, term) = log(n_et * N / (n_e * n_t)), IC(entity) = log(N / n_e)

where z / sqrt(n_et) is the error of a logarithm of so few meetings. All four counts are
of whole documents over the whole corpus, copies folded into one. Terms at or above the
threshold are marked wherever they stand in a document that holds the entity, and
generalised in the sanitised text.

Built-in column functions only. Entities that stand in the same documents have the same
counts, and so have such terms: pairs are formed of those classes, so many entities and
many words of one document do not meet one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import fits_broadcast
from ..session import stage
from .common import own_names, text_or_empty

#: Kinds in the order of the contract; terms come last.
KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns, written so that a long run is read once: no start inside a
#: run that was tried from its beginning, and no way back into what was read.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these cannot hold the kind.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}[\p{L}\p{M}'-]+"
#: Units of several documents, as many as are broadcast (8 bytes each).
SHARED_UNITS = 4_000_000


@dataclass(frozen=True)
class Disclosure:
    """Limits of the method."""

    reach: int = 64  # characters on either side of a mention that tell copies of a passage
    min_contexts: int = 1  # documents, copies folded, in which term and entity meet
    threshold: float = 0.8  # share of the entity's information
    z: float = 0.84  # one-sided normal quantile of the PMI's lower bound (80 %)


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _validity(kind: str, field: str | None = None):
    """``_valid`` as a function of one array element."""
    return lambda x: _valid(kind, x[field] if field else x)


def _tagged(first: Column, name: str):
    """Spans with ``first`` put in front, as a function of one array element."""
    return lambda s: F.struct(
        first.alias(name), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")
    )


def _located(hits: Column, gaps: Column, wanted=None) -> Column:
    """Matches as (start, end, value): lengths of gaps and matches add up to places.

    ``wanted`` tells of a match whether it is listed.
    """
    first = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"),
    )
    both = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        more = F.concat(acc["found"], F.array(span))
        if wanted is not None:
            more = F.when(wanted(x["hit"]), more).otherwise(acc["found"])
        return F.struct(end.alias("at"), more.alias("found"))

    return F.aggregate(both, first, step)["found"]


def pattern_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_email``, ``_ip``, ``_card`` and ``_phone``: arrays of valid spans.

    Spans are (start, end, value) in code points, end exclusive, leftmost first.
    """
    empty = F.array().cast("array<string>")
    hits, spans = {}, {}
    for kind in KINDS:
        found = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
        if kind in NEEDED:
            found = F.when(F.col(text).contains(NEEDED[kind]), found).otherwise(empty)
        hits[f"_h_{kind}"] = found
    df = df.withColumns(hits)
    for kind in KINDS:
        # gaps are cut only in texts with a valid match
        h = F.col(f"_h_{kind}")
        any_valid = F.exists(h, _validity(kind))
        spans[f"_g_{kind}"] = F.when(any_valid, F.split(F.col(text), PATTERNS[kind], -1))
    df = df.withColumns(spans)
    located = {
        f"_{kind}": F.when(
            F.col(f"_g_{kind}").isNotNull(),
            F.filter(
                _located(F.col(f"_h_{kind}"), F.col(f"_g_{kind}")),
                _validity(kind, "value"),
            ),
        ).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        for kind in KINDS
    }
    return df.withColumns(located).drop(*hits, *spans)


def _terms(text: str) -> Column:
    """Words of a text in lower case, in order."""
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower)


def _unit(reach: int) -> Column:
    """What copies share: the surroundings of all mentions, or the text without any."""
    around = F.expr(
        f"transform(spans, s -> xxhash64(substring(_text, greatest(s.start - {reach}, 0) + 1,"
        f" s.end - greatest(s.start - {reach}, 0) + {reach})))"
    )
    return F.when(F.size("spans") > 0, F.xxhash64(F.array_sort(F.array_distinct(around)))).otherwise(
        F.xxhash64("_text")
    )


def _classes(rows: DataFrame, name: str, label: str) -> DataFrame:
    """Rows (``name``, n, class) of distinct rows (unit, ``name``).

    Names that stand in the same units have one class; n counts the units.
    """
    counted = rows.groupBy(name).agg(
        F.count("*").alias("n"), F.bit_xor("unit").alias("x"), F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("y")
    )
    return counted.select(name, F.col("n").alias(f"n_{label}"), F.xxhash64("n", "x", "y").alias(f"{label}_class"))


def _counted_units(documents: DataFrame) -> DataFrame:
    """Units with their number of documents: (unit, copies)."""
    return stage(documents.groupBy("unit").agg(F.count("*").alias("copies")), "pii-units")


def _unit_terms(documents: DataFrame, units: DataFrame, exploded) -> DataFrame:
    """Distinct (unit, term) of all documents.

    The words of a document are distinct, so only units of several documents are shuffled
    to make them so; the words of the others go on as they are, to be counted in place.
    """
    shared = units.filter("copies > 1").select("unit")
    if shared.count() > SHARED_UNITS:
        return exploded(documents).distinct()
    shared = F.broadcast(shared)
    alone = exploded(documents.join(shared, "unit", "left_anti"))
    return alone.unionByName(exploded(documents.join(shared, "unit", "left_semi")).distinct())


def disclosing_terms(
    entities: DataFrame, own_terms: DataFrame, unit_terms: DataFrame, total: DataFrame, limits: Disclosure
) -> DataFrame:
    """Rows (unit, term): terms that disclose an entity of the unit.

    Inputs are distinct: ``entities`` (unit, entity), ``own_terms`` (unit, term) of units
    with an entity, ``unit_terms`` of all. A unit is a document with its copies; ``total``
    has their number n.
    """
    by_entity = _classes(entities, "entity", "e")
    unit_entities = entities.join(by_entity, "entity").select("unit", "e_class", "n_e").distinct()
    # n_et <= n_e bounds the share: terms in more units than this disclose nothing
    most = unit_entities.groupBy("unit").agg(F.max("n_e").alias("most"))
    by_term = _classes(unit_terms, "term", "t")
    may = F.log("n_t") <= (1 - limits.threshold) * F.log("n") + limits.threshold * F.log("most") + 1e-9
    near = (
        own_terms.join(most, "unit").join(by_term, "term").join(F.broadcast(total)).filter(may)
        .select("unit", "term", "t_class", "n_t", "n")
    )
    near = stage(near, "pii-near")
    pairs = near.select("unit", "t_class", "n_t", "n").distinct().join(unit_entities, "unit")
    counted = pairs.groupBy("e_class", "t_class", "n_e", "n_t", "n").agg(F.count("*").alias("n_et"))
    pmi = F.log(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t")))
    information = F.log(F.col("n") / F.col("n_e"))
    share = F.when(F.col("n_e") < F.col("n"), (pmi - limits.z / F.sqrt("n_et")) / information)
    good = counted.filter((F.col("n_et") >= limits.min_contexts) & (share >= limits.threshold))
    told = pairs.join(good.select("e_class", "t_class"), ["e_class", "t_class"]).select("unit", "t_class").distinct()
    return near.join(told, ["unit", "t_class"]).select("unit", "term")


def _beside_spans(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """All ``docs`` with their row of ``whole``, one for each key; most documents have none.

    If those rows are too many for a broadcast, hashes of their keys are broadcast, and
    only documents that have one are shuffled; texts without personal data stay in place.
    """
    if fits_broadcast(whole):
        return docs.join(F.broadcast(whole), "_pii_key", "left")
    if whole.count() > SHARED_UNITS:
        return docs.join(whole, "_pii_key", "left")
    marked = F.broadcast(whole.select(F.xxhash64("_pii_key").alias("_pii_hash")).distinct())
    hashed = docs.withColumn("_pii_hash", F.xxhash64("_pii_key"))
    some = hashed.join(marked, "_pii_hash", "left_semi").drop("_pii_hash").join(whole, "_pii_key", "left")
    none = hashed.join(marked, "_pii_hash", "left_anti").drop("_pii_hash")
    return some.unionByName(none, allowMissingColumns=True)


@own_names
def find_pii(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    limits: Disclosure = Disclosure(),
) -> DataFrame:
    """All columns of ``docs`` and ``pii`` (replaced if there): spans by start and kind.

    ``pii`` is an array of (kind, start, end, value), code points, end exclusive, the
    patterns' spans first by kind and place, then terms. Null and empty texts have no
    spans. Rows with equal id and text are found once and marked alike; null ids count
    as empty. Terms that overlap a pattern's span are not listed again.
    """
    kept = [c for c in docs.columns if c != "pii"]
    identity = F.md5(
        F.concat_ws("\x01", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_or_empty(text))
    )
    texts = docs.select(identity.alias("key"), text_or_empty(text).alias("_text"))
    spans = F.concat(
        *[
            F.transform(f"_{k}", _tagged(F.lit(i), "rank"))
            for i, k in enumerate(KINDS)
        ]
    )
    scanned = pattern_spans(texts, "_text").withColumn("spans", spans).withColumn("unit", _unit(limits.reach))
    scanned = scanned.select("key", "_text", "spans", "unit")
    # Only documents with a hit, each once
    staged = stage(scanned.filter("size(spans) > 0").dropDuplicates(["key"]), "pii-found")
    entity = lambda s: F.concat_ws(":", s["rank"], F.lower(s["value"]))
    entities = staged.select("unit", F.explode(F.transform("spans", entity)).alias("entity")).distinct()
    worded = lambda df: df.select("unit", F.explode(F.array_distinct(_terms("_text"))).alias("term"))
    units = _counted_units(scanned)
    own_terms, unit_terms = worded(staged).distinct(), _unit_terms(scanned, units, worded)
    total = units.agg(F.count("*").alias("n"))  # one row
    told = disclosing_terms(entities, own_terms, unit_terms, total, limits).groupBy("unit").agg(F.collect_set("term").alias("told"))
    hits = F.regexp_extract_all(F.col("_text"), F.lit(TERM), F.lit(0))
    chosen = lambda hit: F.array_contains("told", F.lower(hit))
    marked = (
        staged.join(told, "unit")
        .withColumn("terms", _located(hits, F.split("_text", TERM, -1), chosen))
        .select("key", "terms")
    )
    overlaps = lambda t, s: (t["start"] < s["end"]) & (s["start"] < t["end"])
    extra = F.transform(
        F.filter("terms", lambda t: ~F.exists("spans", lambda s: overlaps(t, s))),
        lambda t: _tagged(F.lit(len(KINDS)), "rank")(t).withField("value", F.lower(t["value"])),
    )
    whole = (
        staged.select("key", "spans")
        .join(marked, "key", "left")
        .select(F.col("key").alias("_pii_key"), F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", extra)).alias("_pii_all"))
    )
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    whole = stage(whole, "pii-spans")
    listed = F.transform(
        F.coalesce("_pii_all", F.array().cast("array<struct<rank:int,start:int,end:int,value:string>>")),
        lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
    )
    return _beside_spans(docs.select(*kept, identity.alias("_pii_key")), whole).select(*kept, listed.alias("pii"))


@own_names
def sanitise(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (of ``find_pii``) with ``text`` changed: spans become their kind's mark.

    Overlapping spans become one mark, that of the span which begins first.
    """
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        gap = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, mark)).otherwise(acc["out"]).alias("out"),
        )

    ordered = F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = found.withColumn("_spans", ordered).withColumn(
        "_done", F.when(F.size("_spans") > 0, F.aggregate("_spans", first, step))
    )
    rest = F.expr(f"substring({text}, _done.at + 1)")
    clean = F.when(F.col("_done").isNull(), F.col(text)).otherwise(F.concat("_done.out", rest))
    return done.withColumn(text, clean).drop("_spans", "_done")
