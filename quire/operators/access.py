"""Visibility, sharing choices, public snapshot, ranks and change lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import names as N

PRIVATE_COLUMNS = ["source_path", "batch", "sources", "history", "notes", "review_reasons",
                   "needs_review"]


def effective_visibility(docs: DataFrame, choices: DataFrame) -> DataFrame:
    """The most specific choice: document, the owner's type in the unit, the owner's unit, private.

    `docs(…, owner, unit, document_type, visibility)`; `choices(owner, key, visibility)` with keys
    `<unit>` and `<unit>::<type>`.
    """
    def side(name: str) -> DataFrame:
        return choices.select(F.col("owner").alias(f"_{name}_owner"), F.col("key").alias(f"_{name}_key"),
                              F.col("visibility").alias(f"_{name}"))
    typed = F.concat("unit", F.lit("::"), "document_type")
    joined = (docs.join(side("type"), (F.col("owner") == F.col("_type_owner"))
                        & (typed == F.col("_type_key")), "left")
              .join(side("unit"), (F.col("owner") == F.col("_unit_owner"))
                    & (F.col("unit") == F.col("_unit_key")), "left"))
    shown = F.coalesce("visibility", "_type", "_unit", F.lit("private"))
    return joined.select(*[c for c in docs.columns if c != "visibility"],
                         shown.alias("visibility"),
                         F.col("visibility").isNull().alias("inherited"))


def sharing_edits(choices: DataFrame, edits: DataFrame, known_keys: DataFrame) -> tuple[
        DataFrame, DataFrame]:
    """(choices after the edits, rejected edits). `edits(owner, key, value, seq)`; the last edit of a
    key counts, a null value clears the choice; invalid values and unknown keys are rejected."""
    parsed = edits.withColumn("_p", N.parse_visibility(F.col("value")))
    known = known_keys.select("key", F.lit(True).alias("_known")).distinct()
    checked = parsed.join(known, "key", "left").withColumn(
        "_ok", F.col("_p.valid") & F.col("_known").isNotNull())
    rejected = checked.filter("not _ok").select("owner", "key", "value")
    last = (checked.filter("_ok").groupBy("owner", "key")
            .agg(F.max_by("_p.value", "seq").alias("visibility")))
    kept = choices.join(last, ["owner", "key"], "left_anti")
    return (kept.select("owner", "key", "visibility")
            .unionByName(last.filter("visibility is not null")), rejected)


def public_documents(visible: DataFrame) -> DataFrame:
    return visible.filter((F.col("kind") != "archive") & (F.col("status") != "removed")
                          & (F.col("visibility") == "public"))


def one_per_content(docs: DataFrame, key: str = "id") -> DataFrame:
    """The lowest id of each content."""
    first = docs.groupBy("sha256").agg(F.min(key).alias("_first"))
    return docs.join(first.select("_first"), F.col(key) == F.col("_first"), "left_semi")


def strip_private(docs: DataFrame) -> DataFrame:
    """Public projection: paths, history, notes and review data out; of each classified field only
    value, confidence and method stay."""
    out = docs.drop(*[c for c in PRIVATE_COLUMNS if c in docs.columns])
    if "classification" in docs.columns:
        fields = docs.schema["classification"].dataType.fieldNames()
        kept = [F.when(F.col(f"classification.{f}").isNotNull(), F.struct(*[
            F.col(f"classification.{f}.{p}").alias(p) for p in ("value", "confidence", "method")]))
            .alias(f) for f in fields]
        out = out.withColumn("classification", F.struct(*kept))
    return out


def public_catalog(public: DataFrame, institutions: DataFrame, courses: DataFrame,
                   units: DataFrame, course_units: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """The catalog rows that public documents need."""
    used = public.select(F.col("unit").alias("unit_key")).filter("unit_key is not null").distinct()
    units_used = units.join(used, F.col("key") == F.col("unit_key"), "left_semi")
    links = course_units.join(used, "unit_key", "left_semi")
    courses_used = courses.join(links, F.col("key") == F.col("course_key"), "left_semi")
    wanted = (units_used.select("institution").unionByName(courses_used.select("institution"))
              .distinct())
    return {
        "units": units_used, "courses": courses_used, "course_units": links,
        "institutions": institutions.join(wanted, F.col("slug") == F.col("institution"), "left_semi"),
        "users": users.join(public.select("owner").distinct(), F.col("login") == F.col("owner"),
                            "left_semi")}


def audit_changes(changes: DataFrame, ranks: DataFrame, max_files: int = 300) -> DataFrame:
    """commit, files, verdict: one parent, fewer than 300 files, every path within the rank, and
    organisers leave visibility alone. `changes(commit, author, owner, parents, path,
    previous_path, patch)`, `ranks(author, role)`."""
    joined = changes.join(ranks, "author", "left").withColumn("role", F.coalesce("role", F.lit("none")))
    allowed = N.path_allowed(F.col("role"), F.col("path"), F.col("owner")) & F.coalesce(
        N.path_allowed(F.col("role"), F.col("previous_path"), F.col("owner"))
        | F.col("previous_path").isNull(), F.lit(True))
    touches = (F.col("role") == "organizer") & F.startswith("path", F.lit("documentos/")) & (
        F.col("patch").isNull() | F.col("patch").rlike("(?m)^[+-]visibility:"))
    judged = joined.groupBy("commit").agg(
        F.count("*").alias("files"), F.max("parents").alias("_parents"),
        F.bool_and(allowed).alias("_allowed"),
        F.bool_or(F.coalesce(touches, F.lit(False))).alias("_touches"))
    verdict = (F.when(F.col("_parents") != 1, "commit_invalido")
               .when(F.col("files") >= max_files, "demasiados_ficheiros")
               .when(~F.col("_allowed"), "fora_do_teu_nivel")
               .when(F.col("_touches"), "so_o_editor_publica").otherwise("ok"))
    return judged.select("commit", "files", verdict.alias("verdict"))


def only_personal(paths: Column) -> Column:
    return F.coalesce(paths.rlike("^anotacoes/|^acessos\\.yaml$"), F.lit(False))


def personal_changes(changes: DataFrame) -> DataFrame:
    """commit, skip: nothing but personal files changed."""
    return changes.groupBy("commit").agg(F.bool_and(only_personal(F.col("path"))).alias("skip"))
