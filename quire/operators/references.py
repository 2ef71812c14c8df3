"""Citations against bibliographies: resolution, order, year letters, names, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize_doi
from quire.functions.values import bibliography_authors, short_author, year_letters
from quire.operators.skew import number_rows
from quire.session import settled


def resolve_citations(citations: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cited keys with their bibliography entry."""
    return citations.join(refs, list(keys))


def undefined_citations(citations: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cited keys without an entry."""
    return citations.select(*keys).distinct().join(refs.select(*keys), list(keys), "left_anti")


def uncited_refs(citations: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries nobody cites."""
    return refs.select(*keys).join(citations.select(*keys), list(keys), "left_anti")


def citation_outcomes(citations: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, outcome): resolved, undefined or uncited, of every key once, in one pass over both sides."""
    cited = citations.select(*keys).distinct().withColumn("__cited", F.lit(True))
    known = refs.select(*keys).distinct().withColumn("__known", F.lit(True))
    outcome = F.when(F.col("__cited").isNull(), "uncited").when(F.col("__known").isNull(), "undefined").otherwise("resolved")
    return cited.join(known, list(keys), "full").select(*keys, outcome.alias("outcome"))


def short_authors(refs: DataFrame) -> DataFrame:
    """Add ``short_author`` from the ``authors`` array; the title stands in when there is no author."""
    people = F.col("authors")
    short = short_author(
        F.size(people), F.get(people, F.lit(0))["family"], F.get(people, F.lit(1))["family"]
    )
    return refs.withColumn("short_author", F.coalesce(short, F.col("title")))


def author_lists(people: DataFrame, key: str, seq: str, family: str) -> DataFrame:
    """(key, n_authors, short_author, bibliography_authors) of one row per (key, seq) author.

    No list longer than 21 names is ever collected: the first twenty and the
    last decide both forms.
    """
    numbered = number_rows(people, [key], [F.col(seq)], "__rn")
    sizes = people.groupBy(key).agg(F.count(F.lit(1)).alias("n_authors"))
    name = F.col(family)
    shown = numbered.join(sizes, [key]).filter((F.col("__rn") <= 20) | (F.col("__rn") == F.col("n_authors")))
    listed = shown.groupBy(key, "n_authors").agg(
        F.max(F.when(F.col("__rn") == 1, name)).alias("__first"),
        F.max(F.when(F.col("__rn") == 2, name)).alias("__second"),
        F.sort_array(F.collect_list(F.struct("__rn", name.alias("name")))).alias("__names"),
    )
    return listed.select(
        key,
        "n_authors",
        short_author(F.col("n_authors"), F.col("__first"), F.col("__second")).alias("short_author"),
        bibliography_authors(F.col("__names.name")).alias("bibliography_authors"),
    )


def author_sort_key(authors: Column) -> Column:
    """All names, family first, as one text to sort by."""
    return F.array_join(F.transform(authors, lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")


def date_group(year: Column, status: Column) -> Column:
    """0 without a date, 1 with one, 2 with a status such as "in press" instead."""
    return F.when(F.coalesce(year.cast("string"), F.lit("")) != "", 1).when(
        F.coalesce(status, F.lit("")) != "", 2
    ).otherwise(0)


def year_suffix(refs: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "year_suffix") -> DataFrame:
    """Letters a, b, c, ... for entries that share the keys (article, short author, year); null when alone.

    Counting is a separate small aggregate, so no task has to hold a whole
    group to know that it has more than one member.
    """
    sizes = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).drop("__n")
    shared = number_rows(refs.join(sizes, list(keys), "left_semi"), keys, order, "__pos")
    alone = refs.join(sizes, list(keys), "left_anti").withColumn(name, F.lit(None).cast("string"))
    return shared.withColumn(name, year_letters(F.col("__pos"))).drop("__pos").unionByName(alone)


def initials(given: Column) -> Column:
    """``Jean-Luc Marie`` as ``J.-L. M.``; empty for none."""

    def dotted(part: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.split(part, "-"), lambda p: p != ""), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))), "-")

    words = F.filter(F.split(F.coalesce(given, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, dotted), " ")


def _cited(names: Column, title: Column, shown: Column) -> Column:
    """In-text author with ``shown`` names; from three names on, fewer than all end in ``et al.``"""
    n, last = F.size(names), F.element_at(names, -1)
    all_ = F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", & "), last)
    some = F.concat(F.array_join(F.slice(names, F.lit(1), shown), ", "), F.lit(", et al."))
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, title)
        .when(n <= 2, short_author(n, F.get(names, F.lit(0)), F.get(names, F.lit(1))))
        .when(shown <= 1, short_author(n, F.get(names, F.lit(0)), F.lit("")))
        .when(shown < n, some)
        .otherwise(all_)
    )


def disambiguate(refs: DataFrame, scope: Sequence[str], order: Sequence[Column], given: str = "initials") -> DataFrame:
    """Add ``cite_form``, ``names_shown`` and ``year_suffix``, so that different entries of a scope are cited differently.

    In this order, each only as far as it is needed:

    1. First authors of one family name with different initials show their initials, in all their citations; with
       ``given="full"`` those whose initials agree too, but not their given names, show these.
    2. Entries of one year cited as ``First et al.`` show more names, as few as set an entry apart from all that more
       names could set it apart from: prefixes of the name lists refine the set until they refine it no further.
    3. What is still cited alike in one year gets letters in the given order, which must end on a unique column.

    Entries without authors are cited by title. ``names_shown`` is 0 for them. No task holds a set: equal lists of names are one
    row, and prefixes of these are rows, counted by an aggregate that combines before the shuffle.
    """
    scope = list(scope)
    first = F.get("authors", F.lit(0))
    rows = refs.withColumns({
        "__year": F.coalesce(F.col("year").cast("string"), F.lit("")),
        "__family": first["family"], "__given": F.coalesce(first["given"], F.lit("")), "__initials": initials(first["given"]),
    })
    rows = settled(rows)
    people = rows.where("__family is not null").select(*scope, "__family", "__initials", "__given").distinct()
    families = people.select(*scope, "__family", "__initials").distinct().groupBy(*scope, "__family").agg((F.count(F.lit(1)) > 1).alias("__several"))
    named = rows.join(families, [*scope, "__family"], "left")
    shown = F.when(F.col("__several") & (F.col("__initials") != ""), F.concat_ws(" ", "__initials", "__family"))
    if given == "full":
        alike = people.groupBy(*scope, "__family", "__initials").agg((F.count(F.lit(1)) > 1).alias("__alike"))
        named = named.join(alike, [*scope, "__family", "__initials"], "left")
        shown = F.coalesce(F.when(F.col("__alike") & (F.col("__given") != ""), F.concat_ws(" ", "__given", "__family")), shown)
    names = F.transform("authors", lambda a, i: F.when(i == 0, F.coalesce(shown, a["family"])).otherwise(a["family"]))
    named = named.withColumn("__names", names).withColumn("__base", _cited(F.col("__names"), F.col("title"), F.lit(1)))
    named = settled(named)
    sets = [*scope, "__base", "__year"]
    crowded = named.groupBy(*sets).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # entries of a set with the same names show the same: each list of names is taken once, with its number of entries
    many = named.where(F.size("__names") > 2).join(crowded, sets, "left_semi").groupBy(*sets, "__names").agg(F.count(F.lit(1)).alias("__same"))
    lists = settled(many.withColumn("__list", F.monotonically_increasing_id()))
    codes = F.aggregate(
        "__names",
        F.array().cast("array<string>"),
        lambda done, name: F.concat(done, F.array(F.sha1(F.concat_ws("\x1f", F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), F.coalesce(name, F.lit("")))))),
    )
    prefixes = lists.select("__list", "__same", *sets, F.size("__names").alias("n"), F.posexplode(codes).alias("k", "code"))
    prefixes = prefixes.select("__list", "__same", *sets, (F.col("k") + 1).alias("k"), "code", (F.col("k") + 1 < F.col("n")).alias("more"))
    by = [*sets, "k", "code", "more"]
    sizes = prefixes.groupBy(*by).agg(F.sum("__same").alias("size"))
    shortest = prefixes.join(sizes, by).groupBy("__list").agg(F.min(F.struct("size", "k"))["k"].alias("__shown"))
    least = lists.join(shortest, "__list").select(*sets, "__names", "__shown")
    extra = ["__family", "__given", "__initials", "__several", "__alike", "__names", "__base", "__shown"]
    k = F.when(F.size("__names") > 2, F.coalesce("__shown", F.lit(1))).otherwise(F.greatest(F.size("__names"), F.lit(0)))
    cited = named.join(least, [*sets, "__names"], "left").withColumn("names_shown", F.coalesce(k, F.lit(0)))
    cited = cited.withColumn("cite_form", _cited(F.col("__names"), F.col("title"), F.col("names_shown"))).drop(*extra)
    return year_suffix(settled(cited), [*scope, "cite_form", "__year"], order).drop("__year").select(*refs.columns, "cite_form", "names_shown", "year_suffix")


def reference_order(refs: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based place in the reference list of each key; ``order`` must end on a unique column."""
    return number_rows(refs, keys, order, name)


def sort_references(refs: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """Add ``position``: author, date group, year, status, title and volume, case and accents ignored."""
    prepared = refs.withColumn("__who", F.coalesce(F.nullif(author_sort_key(F.col("authors")), F.lit("")), F.col("title")))
    status = F.col("fields")["pubstate"]
    ci = [F.collate(F.col(c), "UNICODE_CI_AI") for c in ("__who", "title")]
    order = [
        ci[0].asc_nulls_first(),
        date_group(F.col("year"), status),
        F.col("year").asc_nulls_first(),
        status.asc_nulls_first(),
        ci[1].asc_nulls_first(),
        F.col("fields")["volume"].asc_nulls_first(),
        F.col("key"),
    ]
    return number_rows(prepared, [key], order, "position").drop("__who")


def sort_cluster(citations: DataFrame, cluster: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``place``: the order of the keys inside one citation cluster."""
    return number_rows(citations, cluster, order, "place")


def clear_date_parts(refs: DataFrame, fields: str = "fields") -> DataFrame:
    """The printed list shows years only: day and month fields are dropped."""
    gone = ("day", "month", "labelday", "labelmonth")
    return refs.withColumn(fields, F.map_filter(fields, lambda k, _: ~k.isin(*gone)))


def _over(first: Column, second: Column) -> Column:
    """Both maps; of a key in both the first map's value."""
    return F.map_concat(first, F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)))


def inherit_fields(refs: DataFrame, key: str = "manuscript_id", fields: str = "fields", link: str = "crossref") -> DataFrame:
    """Entries with the fields they lack taken from the entry that their ``crossref`` names, and from that entry's, and so on.

    The nearest entry that has a field gives it; entries whose type starts with "in" take an inherited title as
    ``booktitle`` where they have none. Adds ``parent_state``: null without a link, ``found``, ``unknown`` where some link of
    the chain names no entry (what comes before it is inherited), ``ring`` where the chain runs into a ring (nothing is
    inherited). Of entries with one key the first counts as parent. Columns: (key, pos, key, type, fields).

    Pointer doubling: each round joins every open chain with the chain where it ends so far, so rounds grow with the
    logarithm of the longest chain, and each is a join by (article, entry), written below the checkpoint folder.
    """
    up = F.nullif(F.col(fields)[link], F.lit(""))
    bare = F.map_filter(fields, lambda k, _: k != link)
    nodes = settled(
        refs.groupBy(F.col(key).alias("__id"), F.col("key").alias("__key"))
        .agg(F.min_by(F.struct(up.alias("up"), bare.alias("own")), "pos").alias("n"))
        .select("__id", "__key", F.col("n.up").alias("__up"), F.col("n.own").alias("__own"))
    )
    parents = nodes.select("__id", F.col("__key").alias("__up"), F.col("__own").alias("__got"), F.lit(True).alias("__there"))
    linked = nodes.where("__up is not null").join(parents, ["__id", "__up"], "left")
    none = F.create_map().cast("map<string,string>")
    chains = linked.select(
        "__id", "__key", F.when(F.col("__there"), F.col("__up")).alias("__up"), F.coalesce("__got", none).alias("__got"), F.col("__there").isNull().alias("__lost")
    )
    open_before = None
    while True:
        chains = settled(chains)
        still = chains.where("__up is not null").count()
        if still in (0, open_before):  # only rings, and what leads to them, no longer get shorter
            break
        open_before = still
        further = chains.select("__id", F.col("__key").alias("__up"), F.col("__up").alias("__next"), F.col("__got").alias("__more"), F.col("__lost").alias("__lost2"))
        joined = chains.join(further, ["__id", "__up"], "left")
        more = F.coalesce("__more", none)
        chains = joined.select("__id", "__key", F.col("__next").alias("__up"), _over(F.col("__got"), more).alias("__got"), (F.col("__lost") | F.coalesce("__lost2", F.lit(False))).alias("__lost"))
    state = F.when(F.col("__up").isNotNull(), "ring").when(F.col("__lost"), "unknown").otherwise("found")
    ends = chains.select("__id", "__key", state.alias("parent_state"), F.when(F.col("__up").isNull(), F.col("__got")).alias("__got"))
    old = F.col(fields)
    booked = F.when(
        F.startswith("type", F.lit("in")) & F.map_contains_key("__got", "title") & ~F.map_contains_key("__got", "booktitle"),
        F.map_concat("__got", F.create_map(F.lit("booktitle"), F.col("__got")["title"])),
    ).otherwise(F.col("__got"))
    rows = refs.join(ends, (F.col(key).eqNullSafe(F.col("__id"))) & (F.col("key") == F.col("__key")) & up.isNotNull(), "left")
    filled = F.coalesce(_over(old, booked), old).alias(fields)
    return rows.select(*[filled if c == fields else refs[f"`{c}`"] for c in refs.columns], "parent_state")


def duplicate_refs(refs: DataFrame, identity: Column, key: Column) -> DataFrame:
    """(identity, copies, first_key) of entries that occur more than once in the corpus.

    Counts combine before the shuffle, so a group with very many copies is one
    row per task.
    """
    rows = refs.select(identity.alias("identity"), key.alias("k")).filter(F.col("identity").isNotNull())
    groups = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("copies"), F.min("k").alias("first_key"))
    return groups.filter(F.col("copies") > 1)


def duplicate_dois(refs: DataFrame) -> DataFrame:
    """Duplicate entries by normalized DOI."""
    return duplicate_refs(refs, normalize_doi(F.col("doi")), F.concat_ws("/", "manuscript_id", "key"))


def theme_catalog(meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Articles per journal, volume and year (or any other keys)."""
    return meta.groupBy(*keys).agg(F.count(F.lit(1)).alias("articles"))
