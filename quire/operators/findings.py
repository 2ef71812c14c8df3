"""Publication rules: findings table, verdict per manuscript and the gate behind it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normal_path
from quire.functions.values import is_blank, is_missing, let
from quire.operators.layers import get_path, node_key
from quire.profile import ARTICLE_TYPES, NO_AUTHORS, NO_EMAIL, Profile

PLACEHOLDER = "TODO"


def finding(
    rows: DataFrame, level: str, rule: str, message: Column, file: Column, key: str = "manuscript_id"
) -> DataFrame:
    return rows.select(
        key,
        F.lit(level).alias("level"),
        F.lit(rule).alias("rule"),
        message.cast("string").alias("message"),
        file.cast("string").alias("file"),
    )


def _hit(level: str, rule: str, holds: Column, message: Column) -> Column:
    """A (level, rule, message) struct where the condition holds, else null."""
    row = F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), message.cast("string").alias("message"))
    return F.when(F.coalesce(holds, F.lit(False)), row)


def _one_pass(records: DataFrame, hits: Column, file: Column, key: str) -> DataFrame:
    """Findings from an array of hits per record: all rules in one pass, without a join."""
    rows = records.select(key, file.cast("string").alias("file"), F.inline(F.array_compact(hits)))
    return rows.select(key, "level", "rule", "message", "file")


def missing_fields(
    records: DataFrame,
    checks: Sequence[tuple[str, Column]],
    level: str,
    rule: str,
    message: str,
    file: Column,
    key: str = "manuscript_id",
) -> DataFrame:
    """One finding per record and (label, is missing) check that holds, in check order."""
    hits = F.array(*[_hit(level, rule, missing, F.lit(message + label)) for label, missing in checks])
    return _one_pass(records, hits, file, key)


_RULES = "array<struct<level:string,rule:string,message:string,key:string>>"


def _required(profile: Profile) -> list[dict]:
    return [
        {"level": "error", "rule": "required", "message": f"Missing required field: {label}", "key": node_key(path)}
        for path, label in profile.required
    ]


def _recommended(profile: Profile) -> list[dict]:
    return [
        {"level": "warning", "rule": "recommended", "message": f"Recommended field missing: {label}", "key": node_key(path)}
        for path, label in profile.recommended
    ]


def _absent(rules: list[dict]) -> Column:
    """Hits of the rules whose field is missing or falsy; the rule list is a constant of the plan."""

    def missing(rule: Column) -> Column:
        node = F.try_element_at(F.filter("nodes", lambda n: n["key"] == rule["key"]), F.lit(1))
        return let(node, lambda n: is_missing(n["kind"], n["value_json"]))

    hits = F.filter(F.from_json(F.lit(json.dumps(rules)), _RULES), missing)
    return F.transform(hits, lambda r: F.struct(r["level"].alias("level"), r["rule"].alias("rule"), r["message"].alias("message")))


def validate_required(merged: DataFrame, profile: Profile, file: Column) -> DataFrame:
    """One error per missing or falsy required field of the merged metadata."""
    return _one_pass(merged, _absent(_required(profile)), file, "manuscript_id")


def validate_recommended(merged: DataFrame, profile: Profile, file: Column) -> DataFrame:
    """One warning per missing or falsy recommended field."""
    return _one_pass(merged, _absent(_recommended(profile)), file, "manuscript_id")


def validate_fields(merged: DataFrame, profile: Profile, file: Column, conventions: bool = False) -> DataFrame:
    """Required and recommended fields in one pass; ``conventions`` adds the rules that are only written down.

    Those are warnings: the article id equals the folder name, the article type
    is one of seven, no field still holds a ``TODO``.
    """
    rules = _absent(_required(profile) + _recommended(profile))
    if conventions:
        article_id = get_path(F.col("nodes"), f"{profile.namespace}.article-id")
        kind = get_path(F.col("nodes"), f"{profile.namespace}.article-type")
        unfinished = F.filter("nodes", lambda n: F.coalesce(n["value_json"].rlike(rf"\b{PLACEHOLDER}\b"), F.lit(False)))
        marks = F.transform(
            unfinished,
            lambda n: _hit(
                "warning", "todo", F.lit(True), F.concat(F.lit("Field still holds TODO: "), F.array_join(n["path"], "."))
            ),
        )
        named = F.array(
            _hit("warning", "article-id", article_id != F.col("manuscript_id"), F.lit("Article id differs from the folder name.")),
            _hit("warning", "article-type", ~kind.isin(*ARTICLE_TYPES), F.concat(F.lit("Unknown article type: "), kind)),
        )
        rules = F.concat(rules, named, marks)
    return _one_pass(merged, rules, file, "manuscript_id")


def blank_orcids(authors: DataFrame, file: Column, key: str = "manuscript_id") -> DataFrame:
    """Opt-in warning for authors whose ORCID is given but blank."""
    blank = authors.filter(F.col("orcid_given") & is_blank(F.col("orcid")))
    number = F.concat(F.lit("Author #"), F.col("seq") + 1, F.lit(" has a blank ORCID."))
    return finding(blank, "warning", "orcid", number, file, key)


def any_email(authors: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, has_email) for every key with at least one author."""
    return authors.groupBy(key).agg(F.bool_or(F.coalesce(F.col("email") != "", F.lit(False))).alias("has_email"))


def validate_authors(manuscripts: DataFrame, authors: DataFrame, file: Column, key: str = "manuscript_id") -> DataFrame:
    """No author at all; an author with a blank name (numbered from 1); nobody with an email."""
    none = manuscripts.select(key).join(authors, [key], "left_anti")
    blank = authors.filter(is_blank(F.col("name")))
    number = F.concat(F.lit("Author #"), F.col("seq") + 1, F.lit(" has no name."))
    silent = any_email(authors, key).filter(~F.col("has_email"))
    return union_findings(
        finding(none, "error", "no-authors", F.lit(NO_AUTHORS), file, key),
        finding(blank, "error", "author-name", number, file, key),
        finding(silent, "warning", "no-email", F.lit(NO_EMAIL), file, key),
    )


def missing_bibliography(meta: DataFrame, files: DataFrame, file: Column) -> DataFrame:
    """One error per declared bibliography file that is not in the folder."""
    declared = meta.select("manuscript_id", F.explode("bibliography").alias("written"))
    declared = declared.withColumn("path", normal_path(F.col("written")))
    present = files.select("manuscript_id", normal_path(F.col("path")).alias("path"))
    lost = declared.join(present, ["manuscript_id", "path"], "left_anti")
    message = F.concat(F.lit("bibliography file not found: "), "written")
    return finding(lost, "error", "bibliography", message, file)


def placeholders(
    bodies: DataFrame, text: str = "body", key: str = "manuscript_id", mark: str = PLACEHOLDER
) -> DataFrame:
    """Rows whose text still holds a ``TODO`` (or another marked word)."""
    return bodies.filter(F.col(text).rlike(rf"\b{mark}\b")).select(key)


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_findings(manuscripts: DataFrame, findings: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, errors, warnings, passed) for every manuscript, also those without findings.

    Findings are counted before the join, so a manuscript with very many of
    them is one row by then.
    """
    counts = findings.groupBy(key).agg(
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    )
    joined = manuscripts.select(key).join(counts, [key], "left")
    errors = F.coalesce("errors", F.lit(0).cast("long"))
    return joined.select(
        key,
        errors.alias("errors"),
        F.coalesce("warnings", F.lit(0).cast("long")).alias("warnings"),
        (errors == 0).alias("passed"),
    )


def renderable(manuscripts: DataFrame, findings: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """Only manuscripts without an error finding."""
    failed = findings.filter(F.col("level") == "error").select(key)
    return manuscripts.join(failed, [key], "left_anti")
