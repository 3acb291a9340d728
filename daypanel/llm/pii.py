"""Personal data, and the terms of its documents that give it away; built-in functions only.

Emails, IP addresses, card and phone numbers are found by pattern, leftmost and without overlap within a kind, and
checked (parts of an address, Luhn sum, number of digits); a match that fails the check is dropped.

Every value so found is a protected entity. All terms of the documents that hold it are weighed by what the whole
corpus says of them: with document frequencies n(e), n(t) and n(e, t) over N documents, a term's pointwise mutual
information log(N n(e, t) / (n(e) n(t))) as a share of the entity's own information log(N / n(e)) is its disclosure: 1
means that the term never occurs without the entity. A term counts from a disclosure of ``generalise`` on, and then
only if the disclosure also reaches that with the lower confidence bound (Wilson, ``trust`` standard errors) of
n(e, t) / n(t) in its place: of few documents more is asked, but none is too few. From ``remove`` on a term is removed,
else generalised, wherever it stands in a document that holds the entity and outside its spans. A value is weighed by
its own name and by a coarser one that pools it with others: domain of an address, first three parts of an IP address,
first six digits of a card, a phone number without its last four digits.

Spans are pairs of code points, the end exclusive. Defined cases: null and empty texts have no spans; rows with equal
id and text, repeated ones too, have the same spans; an entity that is in all documents gives nothing away; an empty
table gives an empty result; other columns are kept, and those this adds get underscores where a name is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import free_name, saved, whole

# The patterns, in the order of their kinds. Where a run of characters cannot match from its start, it
# cannot match from within either, so the search does not try; and what nothing can follow gives nothing back. Both
# keep the search linear and change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}+"


@dataclass(frozen=True)
class Settings:
    support: int = 1  # documents that a term and an entity must share; 1 leaves none out
    trust: float = 1.2816  # standard errors below the estimate that must still reach ``generalise``; this is 90 %
    generalise: float = 0.8
    remove: float = 0.95


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, block: int = 500) -> Column:
    """Array of (start, end, value) of all matches. A match starts behind the pieces and matches before it; the sums run
    in blocks, so that a text with very many matches costs little more than its length."""
    row = "struct<start:int,end:int,value:string>"
    empty = F.array().cast(f"array<{row}>")

    def one(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.array_append(state["rows"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))).alias("rows"))

    def many(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), empty.alias("rows")), one)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(state["parts"], x["rows"]).alias("parts")))

    def placed(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / block).cast("int")), lambda b: F.slice(pairs, b * block + 1, F.lit(block)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{row}>>").alias("parts"))
        return F.when(F.size(pairs) > 0, F.flatten(F.aggregate(blocks, start, many)["parts"])).otherwise(empty)

    def paired(found: Column) -> Column:
        pairs = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("p"))
        return F.when(F.size(found) > 0, let(F.slice(pairs, F.lit(1), F.size(found)), placed)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.char_length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def entities(text: Column | str) -> Column:
    """Array of (start, kind_no, end, value) of the personal data in a text, by start and kind."""
    t = whole(text)
    checks = {
        "email": (EMAIL, F.contains(t, F.lit("@")), lambda v: F.lit(True)),
        "ip": (IP, F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda v: F.forall(F.split(v, r"\."), lambda x: x.cast("double") <= 255)),
        "card": (CARD, F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), _luhn),
        "phone": (PHONE, F.contains(t, F.lit("+")), lambda v: F.char_length(_digits(v)).between(9, 15)),
    }

    def of_kind(no: int, kind: str) -> Column:
        pattern, may, holds = checks[kind]
        kept = F.filter(matches(t, pattern), lambda x: holds(x["value"]))
        rows = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), x["value"].alias("value")))
        return F.when(may, rows).otherwise(F.array().cast("array<struct<start:int,kind_no:int,end:int,value:string>>"))

    return F.array_sort(F.concat(*(of_kind(no, kind) for no, kind in enumerate(KINDS))))


def _name(value: Column, kind_no: Column) -> Column:
    """An entity's name whatever its spelling: lower case, digits only for numbers."""
    plain = F.when(kind_no.isin(KINDS.index("card"), KINDS.index("phone")), _digits(value)).otherwise(F.lower(value))
    return F.concat(kind_no.cast("string"), F.lit(":"), plain)


def _coarse(value: Column, kind_no: Column) -> Column:
    """The name an entity shares with others of its kind."""
    digits = _digits(value)
    plain = (
        F.when(kind_no == KINDS.index("email"), F.lower(F.substring_index(value, "@", -1)))
        .when(kind_no == KINDS.index("ip"), F.substring_index(value, ".", 3))
        .when(kind_no == KINDS.index("card"), F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, F.lit(1), F.char_length(digits) - 4))
    )
    return F.concat(kind_no.cast("string"), F.lit("~"), plain)


def _low(both: Column, of: Column, trust: float) -> Column:
    """Lower end of the Wilson interval of a share."""
    p, z = both / of, F.lit(trust * trust)
    return (p + z / (2 * of) - trust * F.sqrt(p * (1 - p) / of + z / (4 * of * of))) / (1 + z / of)


def _words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _marked(text: Column, spans: Column, told: Column) -> Column:
    """Array of (start, end, disclosure): all words of a text that ``told`` (a map from term to disclosure) names and that
    lie in no span."""
    named = F.filter(matches(text, TERM), lambda w: F.map_contains_key(told, F.lower(w["value"])))
    outside = F.filter(named, lambda w: ~F.exists(spans, lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    return F.transform(outside, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at(told, F.lower(w["value"])).alias("disclosure")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: the id, ``key`` (digest of id and text), ``base`` (see ``entities``) and ``terms``
    (array of start, end, disclosure)."""
    t = whole(text_col)
    key = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\n"), t), 256)
    # Exploded, so that later steps read the spans as a column and do not search again.
    base = docs.select(id_col, key.alias("key"), t.alias("t"), F.explode(F.array(entities(t))).alias("base"))
    rows = saved(base.select(id_col, "key", "base", F.when(F.size("base") > 0, F.col("t")).alias("t")))
    total = rows.count()
    n = F.lit(float(total))
    holding = rows.filter(F.size("base") > 0)
    fine, coarse = F.transform("base", lambda b: _name(b["value"], b["kind_no"])), F.transform("base", lambda b: _coarse(b["value"], b["kind_no"]))
    named = F.array_distinct(F.concat(fine, coarse))
    holders = holding.select("key", F.explode(named).alias("entity")).distinct()
    of_entity = holders.groupBy("entity").agg(F.count("*").alias("with_entity")).filter(F.col("with_entity") < total)
    of_term = docs.select(F.explode(_words(t)).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    terms = holding.select("key", F.explode(_words(F.col("t"))).alias("term")).distinct().join(of_term, "term")
    # At most n(e) of n(t) documents have both, so a term more frequent than this cannot reach the disclosure.
    share = settings.generalise
    may = F.col("with_term") <= F.pow("with_entity", F.lit(share)) * F.pow(n, F.lit(1 - share)) * (1 + 1e-9)
    pairs = saved(holders.join(of_entity, "entity").join(terms, "key").filter(may).select("key", "entity", "term", "with_entity", "with_term"))
    information = F.log(n / F.col("with_entity"))
    shared = F.log(n * F.col("both") / (F.col("with_entity") * F.col("with_term")))
    sure = F.log(n * _low(F.col("both"), F.col("with_term"), settings.trust) / F.col("with_entity")) / information
    told = (
        pairs.groupBy("entity", "term", "with_entity", "with_term")
        .agg(F.count("*").alias("both"))
        .filter((F.col("both") >= settings.support) & (sure >= settings.generalise))
        .select("entity", "term", (shared / information).alias("disclosure"))
    )
    extra = (
        pairs.join(told, ["entity", "term"])
        .groupBy("key", "term")
        .agg(F.max("disclosure").alias("disclosure"))
        .groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))
    )
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    marked = F.when(F.col("told").isNotNull(), _marked(F.col("t"), F.col("base"), F.col("told"))).otherwise(none)
    own = holding.join(extra, "key", "left").select(id_col, "key", "base", marked.alias("terms"))
    return own.unionByName(rows.filter(F.size("base") == 0).select(id_col, "key", "base", none.alias("terms")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans of (start, kind_no, end), comma-joined; kind 4 is a term."""
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")


def all_spans() -> Column:
    """The spans of ``base`` and ``terms`` as (start, kind_no, end), by start and kind."""
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))
    more = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), s["end"].alias("end")))
    return F.array_sort(F.concat(own, more))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "sanitised", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with a text in which personal data and terms from ``settings.generalise`` on are generalised to their
    kind and terms from ``settings.remove`` on removed."""
    found = find(docs, id_col, text_col, settings)
    key, cuts = free_name(docs.columns, "_key"), free_name(docs.columns, "_cuts")
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(marks, s["kind_no"]).alias("mark")))
    more = F.transform("terms", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= settings.remove, "").otherwise("[TERM]").alias("mark")))
    what = found.filter((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("key").alias(key), F.array_sort(F.concat(own, more)).alias(cuts)).dropDuplicates([key])
    t = whole(f"`{text_col}`")
    keyed = docs.withColumn(key, F.sha2(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit("\n"), t), 256))

    def cut(state: Column, s: Column) -> Column:
        # A span that begins within an earlier one only lengthens it.
        fresh = s["start"] >= state["at"]
        between = F.substring(t, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["text"], between, s["mark"])).otherwise(state["text"]).alias("text"),
        )

    folded = F.aggregate(F.col(cuts), F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), cut, lambda s: F.concat(s["text"], F.substring(t, s["at"] + 1, F.char_length(t))))
    return keyed.join(what, key, "left").withColumn(out, F.coalesce(folded, t)).drop(key, cuts)
