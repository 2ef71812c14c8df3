"""Information-theoretic sanitisation of personal data, in built-in functions only.

Base spans (addresses, numbers) come from patterns and checks. Every value found is a protected entity. The words around
its mentions are its context; over the whole corpus, the pointwise mutual information of a word with an entity, as a
share of the entity's information content, says how far the word gives the entity away:

    disclosure = ln(N * n(entity, word) / (n(entity) * n(word))) / ln(N / n(entity))

where N counts documents, n(word) and n(entity) those that hold them, n(entity, word) those in which the word stands in
the entity's context. Every pair is scored, also that of a single mention. A word of disclosure ``THRESHOLD`` or more is
replaced next to mentions of that entity, if it was seen so in ``SUPPORT`` different texts, or if the disclosure stays there
with n(word) raised by ``DEVIATIONS`` standard deviations: so words that are rare in the corpus give single mentions away,
once the corpus is large enough to tell that they are rare (about 120 documents for a word that one document holds). It
becomes its class (word or number) if the class stays below the threshold, else nothing. Documents without personal data
stay as they are.

Contexts are built for each different text once, whatever the number of its copies. Word counts of the corpus are
aggregated in every task before they are shuffled, and texts are never shuffled but those that hold personal data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.tables import column, fresh, settled, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CONTEXT = 8  # rows of words and spans on either side
SUPPORT = 3
DEVIATIONS = 3
THRESHOLD = 0.5

# \G and the look-behinds keep starts within a run of characters from being tried one by one: long runs stay linear
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PRESENT = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"[\p{L}\p{N}]+"
# pseudo-words for the classes, which no word can be
_WORDS, _NUMBERS = "<word>", "<number>"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns, computed once for each row.

    Plain projections may be merged, and an expression then be evaluated again for each element of an array that a
    later function goes through. A generator keeps them apart.
    """
    name = fresh(df, "computed")
    one = df.withColumn(name, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return one.select(*[column(c) for c in df.columns if c not in columns], *[F.col(name).getField(n).alias(n) for n in columns])


def ends(lengths: Column) -> Column:
    """For each of an array of lengths, the sum up to and with it."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("all"))

    def step(done: Column, x: Column) -> Column:
        total = done["sum"] + x
        return F.struct(total.alias("sum"), F.array_append(done["all"], total).alias("all"))

    return F.aggregate(lengths, start, step, lambda d: d["all"])


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _values(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _gaps(text: Column, pattern: str) -> Column:
    """Lengths of the stretches before each match and after the last, in code points."""
    return F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))


def _checked(kind: str, spans: Column) -> Column:
    """The valid ones of a kind's spans, with the kind."""
    valid = F.filter(spans, lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(df: DataFrame, text: str, name: str = "base") -> DataFrame:
    """``df`` with ``name``: array of (kind, start, end, value), by kind as in ``KINDS``, then start.

    ``text`` has no nulls. Matches are leftmost and don't overlap within a kind. The time is linear in the length of a
    text and, with a small factor, quadratic in the number of its matches.
    """
    content, none = column(text), F.array().cast("array<string>")

    def present(kind: str) -> Column:
        return F.when(content.contains(_PRESENT[kind]), _values(content, PATTERNS[kind])).otherwise(none) if kind in _PRESENT else _values(content, PATTERNS[kind])

    v, g, e = ({k: f"__{x}_{k}" for k in KINDS} for x in "vge")
    kept = df.columns
    df = computed(df, **{v[k]: present(k) for k in KINDS})
    df = computed(df, **{g[k]: F.when(F.size(v[k]) > 0, _gaps(content, PATTERNS[k])) for k in KINDS})
    # after the last match stands one more stretch, which zip_with pairs with null
    both = {k: F.slice(F.zip_with(g[k], v[k], lambda n, x: n + F.length(x)), F.lit(1), F.size(v[k])) for k in KINDS}
    df = computed(df, **{e[k]: F.when(F.size(v[k]) > 0, ends(both[k])) for k in KINDS})
    found = {k: F.zip_with(v[k], e[k], lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("value"))) for k in KINDS}
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    parts = [F.when(F.size(v[k]) > 0, _checked(k, found[k])).otherwise(empty) for k in KINDS]
    return computed(df, **{name: F.concat(*parts)}).select(*[column(c) for c in kept if c != name], name)


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def contexts(held: DataFrame) -> DataFrame:
    """(h, copies, entity, word, start, end) for the words near the mentions in texts (h, copies, t, base).

    A word that overlaps a base span isn't one.
    """
    words = held.select("h", "copies", F.posexplode(F.arrays_zip(_gaps(F.col("t"), WORD).alias("gap"), _values(F.col("t"), WORD).alias("value"))).alias("i", "w"))
    words = words.where("w.value is not null").select("h", "copies", "i", "w.gap", "w.value")
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("h").orderBy("i"))
    words = words.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    spans = held.select("h", "copies", F.explode("base").alias("w"))
    rows = words.select("h", "copies", "start", "end", F.lower("value").alias("word"), F.lit(None).cast("string").alias("entity"))
    rows = rows.union(spans.select("h", "copies", "w.start", "w.end", F.lit(None).cast("string"), _entity(F.col("w"))))
    order = Window.partitionBy("h").orderBy("start", "end")
    covered = F.max(F.when(F.col("entity").isNotNull(), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # at equal starts the shorter comes first, so a span that covers a word may also be the next row
    entered = F.lead("entity").over(order).isNotNull() & (F.lead("start").over(order) < F.col("end"))
    clear = F.coalesce(covered, F.lit(0)) <= F.col("start")
    rows = rows.withColumn("inside", F.col("entity").isNull() & ~(clear & ~F.coalesce(entered, F.lit(False)))).where("not inside")
    near = order.rowsBetween(-CONTEXT, CONTEXT)
    around = F.collect_list(F.when(F.col("entity").isNull(), F.struct("word", "start", "end"))).over(near)
    mentions = rows.withColumn("around", around).where("entity is not null").select("h", "copies", "entity", F.explode("around").alias("w"))
    return mentions.select("h", "copies", "entity", "w.word", "w.start", "w.end").distinct()


def _class(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{N}+$"), _NUMBERS).otherwise(_WORDS)


def _document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): documents that hold a word, or a word of a class; counted in each task first."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(column(text)), F.lit(WORD), F.lit(0)))
    classes = F.array_distinct(F.transform("ws", _class))
    rows = docs.select(found.alias("ws")).select(F.explode(F.concat("ws", classes)).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def disclosing(docs: DataFrame, text: str, near: DataFrame, held: DataFrame) -> DataFrame:
    """(entity, word, disclosure, replacement) of the words that give an entity away."""
    total = F.lit(docs.count())
    entities = held.select("h", "copies", F.explode("base").alias("s")).select("h", "copies", _entity(F.col("s")).alias("entity")).distinct()
    entities = entities.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    both = near.select("h", "copies", "entity", "word").union(near.select("h", "copies", "entity", _class(F.col("word"))))
    joint = both.distinct().groupBy("entity", "word").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts"))
    scored = joint.join(entities, "entity").join(_document_counts(docs, text), "word")
    content = F.log(total / F.col("n_entity"))
    most = F.col("n") + DEVIATIONS**2 / 2 + DEVIATIONS * F.sqrt(F.col("n") + DEVIATIONS**2 / 4)  # upper bound of a count

    def share(n: Column) -> Column:
        return F.when(content > 0, F.log(total * F.col("n_both") / (F.col("n_entity") * n)) / content).otherwise(0.0)

    told = (F.col("texts") >= SUPPORT) | (share(most) >= THRESHOLD)
    scored = settled(scored.select("entity", "word", share(F.col("n")).alias("disclosure"), told.alias("told")))
    is_class = F.col("word").isin(_WORDS, _NUMBERS)
    words = scored.where(~is_class & F.col("told") & (F.col("disclosure") >= THRESHOLD)).withColumn("class", _class(F.col("word")))
    safe = scored.where(is_class & (F.col("disclosure") < THRESHOLD)).select("entity", F.col("word").alias("class"), F.lit(True).alias("safe"))
    label = F.when(F.col("safe"), F.col("class")).otherwise("")
    return words.join(safe, ["entity", "class"], "left").select("entity", "word", "disclosure", label.alias("replacement"))


def term_spans(docs: DataFrame, text: str) -> DataFrame:
    """(h, terms): for texts with personal data that also hold disclosing words, the spans of these with replacements."""
    content = docs.select(F.coalesce(column(text), F.lit("")).alias("t"))
    held = base_spans(content, "t").where(F.size("base") > 0).withColumn("h", F.sha2("t", 256))
    held = settled(held.groupBy("h").agg(F.first("t").alias("t"), F.first("base").alias("base"), F.count(F.lit(1)).alias("copies")))
    near = settled(contexts(held))
    told = disclosing(docs, text, near, held)
    found = near.join(told, ["entity", "word"]).groupBy("h", "start", "end").agg(F.min("replacement").alias("replacement"))
    return settled(found.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("terms")))


def rewritten(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans replaced by their kind in brackets, and terms by their replacement."""
    parts = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("label"))),
    )

    def step(done: Column, s: Column) -> Column:
        fresh_ = s["start"] >= done["at"]
        gap = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        out = F.when(fresh_, F.concat(done["out"], gap, s["label"])).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    end = F.length(text)
    return F.aggregate(F.array_sort(parts), start, step, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), end)))


_NO_TERMS = "array<struct<start:bigint,end:bigint,replacement:string>>"


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (kind, start, end, value), ``terms`` (start, end, replacement) and ``clean_text``.

    Positions are code points, ends exclusive. Null texts count as empty: no spans, and an empty clean text. Texts
    without personal data keep their text and have no terms. Copies of a text get the same spans; repeated rows stay; an
    empty table gives none. New columns replace any of their names.
    """
    terms = term_spans(docs, text)
    kept = [c for c in docs.columns if c.lower() not in ("base", "terms", "clean_text")]
    whole, t, h = fresh(docs, "row_columns"), fresh(docs, "content"), fresh(docs, "text_hash")
    rows = docs.select(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias(whole), F.coalesce(column(text), F.lit("")).alias(t))
    rows = base_spans(rows, t)
    some = rows.where(F.size("base") > 0).withColumn(h, F.sha2(t, 256)).join(terms.withColumnRenamed("h", h), h, "left")
    some = some.withColumn("terms", F.coalesce("terms", F.array().cast(_NO_TERMS)))
    some = some.select(whole, "base", "terms", rewritten(F.col(t), F.col("base"), F.col("terms")).alias("clean_text"))
    none = rows.where(F.size("base") == 0).select(whole, "base", F.array().cast(_NO_TERMS).alias("terms"), F.col(t).alias("clean_text"))
    out = some.unionByName(none)
    return out.select(*[F.col(whole).getField(f"c{i}").alias(c) for i, c in enumerate(kept)], "base", "terms", "clean_text")


def written(spans: Column, kind: Column | None = None) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"].cast("string"), s["end"].cast("string")))


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = written(F.col("base"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, written(F.col("terms"), F.lit(TERM)))).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
