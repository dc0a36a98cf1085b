r"""Personal data, and the words that give it away.

Only DataFrame functions. Four kinds of protected entities are found by fixed
patterns; a match that fails its check is dropped. Beyond them, the method is
information-theoretic: the corpus tells in how many documents an entity and a
word occur, and in how many they occur together, anywhere in the text.
The pointwise mutual information of both, over the information content of the
entity, is the share of the entity that the word discloses. Words that disclose
at least ``THRESHOLD`` of it, seen with it in at least ``SUPPORT`` documents, are
spans of their own, of kind ``term``, wherever they stand in any text;
``sanitise`` generalises entities to their kind and removes such words.

Positions come without a UDF: the pieces between matches and the matches
alternate, so starts are sums of their lengths, in code points.

Patterns are written with possessive quantifiers and may only start where a run
of their first class starts or the previous match ended; that finds the same
matches as the plain forms and stays linear in very long runs.

Edge cases: null text is empty; spans of different kinds may overlap, terms
don't overlap entities; documents equal in doc_id and text share their spans;
empty tables give no rows; extra columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded as counted_side
from .common import cut, lower_ascii, row_key, text_of

KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed patterns, with possessive quantifiers where the next part can't begin inside.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
THRESHOLD, SUPPORT, SHORTEST = 0.9, 2, 3
#: Parts that a hot entity is dealt into; terms that may be broadcast; mark of letters that are a span's.
SALTS, BROADCAST, HIDDEN = 16, 20_000, "\x00"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the check sum: every second from the right is doubled, nines cast out."""
    parts = F.transform(F.reverse(F.split(digits(value), "")), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(F.filter(parts, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(v, r"\."), lambda p: F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int").isNull() | (F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int") <= 255)),
    "card": lambda v: F.length(digits(v)).between(12, 19) & luhn(v),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}
#: Cheap signs without which a kind can't occur.
SIGNS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][ -]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]")}


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once: inside lambdas other expressions are computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, combine) -> Column:
    """The combination of each value with all before it; ``combine`` is associative.

    Arrays grow only inside parts of about the square root of the size, so the cost
    stays far from the size's square.
    """
    last = lambda x: F.element_at(x, -1)
    none = F.array().cast("array<int>")
    scan = lambda x: F.aggregate(x, none, lambda out, v: F.concat(out, F.array(F.when(F.size(out) == 0, v).otherwise(combine(last(out), v)))))

    def scanned(x: Column) -> Column:
        part = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        parts = bound(part, lambda p: F.transform(F.sequence(F.lit(1), F.size(x), p), lambda at: scan(F.slice(x, at, p))))
        return bound(parts, lambda p: bound(F.concat(F.array(F.lit(None).cast("int")), scan(F.transform(p, last))), lambda before: joined(p, before)))

    def joined(parts: Column, before: Column) -> Column:
        """Beside each part stands what all before it come to."""
        return F.flatten(F.zip_with(F.slice(before, F.lit(1), F.size(parts)), parts, lambda b, p: F.transform(p, lambda v: F.when(b.isNull(), v).otherwise(combine(b, v)))))

    return bound(values, lambda x: F.when(F.size(x) == 0, none).otherwise(scanned(x)))


def matches(text: Column, pattern: str | Column, kind: int) -> Column:
    """Spans of all leftmost, non-overlapping matches."""

    def spans(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, hit: F.length(gap) + F.length(hit))
        return F.zip_with(running(sizes, lambda a, b: a + b), found, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), hit.alias("value")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def entities(text: Column) -> Column:
    """Spans of the four kinds in order of start, then kind."""
    parts = []
    for kind, name in enumerate(KINDS[:4]):
        check = CHECKS[name]
        checked = F.filter(matches(text, PATTERNS[name], kind), lambda s: check(s["value"]))  # noqa: B023
        parts.append(F.when(SIGNS[name](text), checked).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def words_apart(text: Column, spans: Column) -> Column:
    """The distinct words, in lower case, that don't overlap a span."""
    letter = lambda c: F.when(c.rlike(r"^\p{L}$"), HIDDEN).otherwise(" ")
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def piece(at: Column, x: Column) -> Column:
        inner = F.substring(text, at + 1, F.greatest(F.lit(0), x["start"] - at))
        return F.concat(F.translate(inner, HIDDEN, " "), letter(F.left(x["value"], F.lit(1))), F.lit(" "), letter(F.right(x["value"], F.lit(1))))

    tail = lambda at: F.translate(F.substring(text, at + 1, F.length(text)), HIDDEN, " ")
    left = bound(ends, lambda e: F.concat(F.array_join(F.zip_with(F.slice(F.concat(F.array(F.lit(0)), e), F.lit(1), F.size(spans)), spans, piece), ""), tail(F.element_at(e, -1))))
    whole = F.when(F.size(spans) == 0, F.translate(text, HIDDEN, " ")).otherwise(left)
    words = F.split(lower_ascii(whole), rf"[^\p{{L}}{HIDDEN}]++")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= SHORTEST) & ~F.contains(w, F.lit(HIDDEN))))


def revealing_terms(docs: DataFrame, found: DataFrame, threshold: float, support: int) -> DataFrame:
    """The terms that disclose ``threshold`` of an entity. ``found`` has key and the entity spans of each row."""
    rows = docs.select(row_key().alias("key"), text_of().alias("text")).withColumn("spans", entities(F.col("text")))
    n = float(max(docs.count(), 1))
    by_key = found.where(F.size("spans") > 0).groupBy("key").agg(F.count("*").alias("m"), F.first("spans").alias("spans"))
    held = cut(by_key.select("key", "m", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("entity")))
    known = held.groupBy("entity").agg(F.sum("m").alias("n_entity"), F.count("*").alias("keys")).where(F.col("keys") >= support).drop("keys")
    most = known.agg(F.max("n_entity")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], "term string")
    # as n_both <= n_entity, a term in more documents than this can't reach the threshold
    most_for = lambda n_entity: F.pow(F.lit(n), F.lit(1 - threshold)) * F.pow(n_entity.cast("double"), F.lit(threshold)) * (1 + 1e-6)
    counted = rows.select(F.explode(words_apart(F.col("text"), F.col("spans"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counted = cut(counted.where((F.col("n_term") >= support) & (F.col("n_term") <= most_for(F.lit(most)))))
    words = rows.where(F.size("spans") > 0).select("key", F.explode(words_apart(F.col("text"), F.col("spans"))).alias("term"))
    words = words.join(counted, "term").dropDuplicates(["key", "term"])
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    weighed = held.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["entity", "salt"]).drop("salt")
    pairs = weighed.join(words, "key").where(F.col("n_term") <= most_for(F.col("n_entity")))
    together = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("m").alias("n_both"), F.count("*").alias("keys")).where(F.col("keys") >= support)
    mutual = F.log2(F.lit(n) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    content = F.greatest(F.log2(F.lit(n) / F.col("n_entity")), F.lit(1e-9))
    return cut(together.where(mutual / content >= threshold).select("term").distinct())


def disclosing(docs: DataFrame, found: DataFrame, threshold: float, support: int) -> DataFrame:
    """(key, terms): the spans of all disclosing words in all texts."""
    terms = revealing_terms(docs, found, threshold, support)
    if terms.count() <= BROADCAST:
        terms = F.broadcast(terms)
    rows = docs.select(row_key().alias("key"), text_of().alias("text"))
    word = F.explode(F.array_distinct(F.split(lower_ascii(F.col("text")), r"[^\p{L}]++"))).alias("term")
    inside = cut(rows.select("key", word).where(F.length("term") >= SHORTEST).join(terms, "term").groupBy("key").agg(F.collect_set("term").alias("words")))
    spans = cut(found.dropDuplicates(["key"]).join(inside, "key").select("key", "spans", "words"))
    size = spans.agg(F.coalesce(F.sum(128 + 48 * F.size("spans") + 32 * F.size("words")), F.lit(0))).first()[0]
    pattern = F.concat(F.lit(r"(?i)(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    marked = rows.join(counted_side(spans, size), "key").withColumn("hits", matches(F.col("text"), pattern, 4))
    apart = F.filter("hits", lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    lowered = F.transform(apart, lambda w: F.struct(w["start"].alias("start"), w["kind"].alias("kind"), w["end"].alias("end"), lower_ascii(w["value"]).alias("value")))
    return marked.select("key", lowered.alias("terms")).dropDuplicates(["key"])


def find(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, key, base (entity spans) and spans (with the disclosing words) of every text."""
    found = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), entities(text_of()).alias("spans")))
    terms = disclosing(docs, found, threshold, support)
    both = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(SPAN))))
    return found.join(terms, "key", "left").select("doc_id", "key", F.col("spans").alias("base"), both.alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The documents, with entities in text generalised to [KIND] and disclosing words removed."""
    spans = find(docs, **options).select(F.col("key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__key"])
    joined = docs.withColumn("__key", row_key()).join(spans, "__key", "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""))

    def step(s: Column, x: Column) -> Column:
        inside = x["start"] < s["at"]
        plain = F.substring(F.col("text"), s["at"] + 1, F.greatest(F.lit(0), x["start"] - s["at"]))
        text = F.concat(s["out"], plain, F.when(inside, F.lit("")).otherwise(F.element_at(marks, x["kind"] + 1)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), text.alias("out"))

    done = F.aggregate("__spans", begin, step)
    tail = F.substring(F.col("text"), done["at"] + 1, F.greatest(F.lit(0), F.length("text") - done["at"]))
    return joined.select(*[F.when(F.col("text").isNull() | (F.size("__spans") == 0), F.col("text")).otherwise(F.concat(done["out"], tail)).alias("text") if c == "text" else F.col(c) for c in docs.columns])
