"""Views of the library index: lists, lookups, counts, roll-ups, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import names as N, text as X

FILED = ["filed", "enriched", "reviewed"]
UNFILED = ["received", "extracted", "classified"]
INDEX_FIELDS = ("unit", "course", "document_type", "academic_year")


def _live() -> Column:
    return ((F.col("status") != "removed") & (F.col("kind") != "archive")
            & F.col("duplicate_of").isNull())


def is_filed() -> Column:
    return F.col("status").isin(FILED)


def documents(index: DataFrame, owner: str | None = None, filed_only: bool = False,
              archives: bool = False, duplicates: bool = False, **facets: str | None) -> DataFrame:
    """The document list: newest year first, then by name; a facet of None is left open."""
    keep = is_filed() if filed_only else F.col("status") != "removed"
    if owner is not None:
        keep = keep & (F.col("owner") == owner)
    for name, value in facets.items():
        if value:
            keep = keep & (F.col(name) == value)
    if not archives:
        keep = keep & (F.col("kind") != "archive")
    if not duplicates:
        keep = keep & F.col("duplicate_of").isNull()
    return index.filter(keep).orderBy(F.desc_nulls_last("academic_year"), "display_name", "id")


def by_id(index: DataFrame, key: str) -> DataFrame:
    return index.filter(F.col("id") == key)


def by_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """The document whose id starts with `prefix`, if it is the only one."""
    hits = index.filter(F.startswith(F.col("id").cast("string"), F.lit(prefix)))
    return hits.filter(hits.agg(F.count("*")).scalar() == 1)


def children(index: DataFrame, archive: str) -> DataFrame:
    return index.filter((F.col("parent") == archive) & (F.col("status") != "removed")).orderBy(
        "source_path")


def _owned(df: DataFrame, owner: str | None) -> DataFrame:
    return df if owner is None else df.filter(F.col("owner") == owner)


def review_queue(index: DataFrame, owner: str | None = None) -> DataFrame:
    keep = F.col("needs_review") & (F.col("kind") != "archive") & F.col("duplicate_of").isNull()
    return _owned(index.filter(keep), owner).orderBy(F.desc("created_at"), F.desc("id"))


def unfiled(index: DataFrame, owner: str | None = None) -> DataFrame:
    keep = (F.col("status").isin(UNFILED) & (F.col("kind") != "archive")
            & F.col("duplicate_of").isNull())
    return _owned(index.filter(keep), owner).orderBy(F.desc("created_at"))


def removed(index: DataFrame, owner: str | None = None) -> DataFrame:
    keep = ((F.col("status") == "removed") & (F.col("kind") != "archive")
            & F.col("duplicate_of").isNull())
    return _owned(index.filter(keep), owner).orderBy(F.desc("created_at"), F.desc("id"))


def proposals(table: DataFrame, status: str = "open") -> DataFrame:
    return table.filter(F.col("status") == status).orderBy("id")


def bundle_members(index: DataFrame, bundle: str) -> DataFrame:
    keep = (F.col("bundle_id") == bundle) & F.col("duplicate_of").isNull() & (
        F.col("status") != "removed")
    return index.filter(keep).orderBy((F.col("id") != F.col("bundle_lead")), "id")


def copies_of(index: DataFrame, key, include_removed: bool = False) -> DataFrame:
    keep = F.col("duplicate_of") == key
    return index.filter(keep if include_removed else keep & (F.col("status") != "removed")
                        ).orderBy("id")


def known_contents(index: DataFrame, shas: DataFrame) -> DataFrame:
    """sha256, known, and per owner the document to point to (no copy if there is another)."""
    known = index.select("sha256", F.lit(True).alias("known")).distinct()
    return shas.select("sha256").distinct().join(known, "sha256", "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def owned_contents(index: DataFrame) -> DataFrame:
    """owner, sha256, id: the document of an owner with a content, originals before copies."""
    order = F.struct(F.col("duplicate_of").isNotNull(), F.col("id"))
    return (index.filter("status <> 'removed'").groupBy("owner", "sha256")
            .agg(F.min_by("id", order).alias("id")))


def visible_questions(questions: DataFrame, shas: DataFrame, with_rejected: bool = False) -> DataFrame:
    statuses = ["visible", "rejected"] if with_rejected else ["visible"]
    return (questions.filter(F.col("status").isin(statuses)).join(shas, "sha256", "left_semi")
            .orderBy("sha256", "ord"))


def with_extraction(docs: DataFrame, pages: DataFrame, key: str = "sha256") -> DataFrame:
    """Documents with the figures of their extraction: pages, words and pages that need transcription,
    0 where nothing was extracted. `pages(key, page, text, needs_transcription)`; documents of one
    content share its pages, which are counted once."""
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    counts = pages.groupBy(F.col(key).alias("_content")).agg(
        F.count("*").alias("pages"), F.sum(words).alias("words"),
        F.count_if("needs_transcription").alias("pages_needing_transcription"))
    none = F.lit(0).cast("long")
    return docs.join(counts, F.col(key) == F.col("_content"), "left").select(*docs.columns, *[
        F.coalesce(c, none).alias(c) for c in ("pages", "words", "pages_needing_transcription")])


REFERENCE_ORDER = {"institutions": ["name"], "courses": ["name"], "units": ["name"], "users": [],
                   "course_units": ["course_key", "curricular_year", "semester", "unit_key"]}


def reference_list(table: DataFrame, name: str) -> DataFrame:
    """A reference list in its order; users come as they are."""
    return table.orderBy(*REFERENCE_ORDER[name]) if REFERENCE_ORDER[name] else table


def vocabulary(terms: DataFrame, kind: str) -> DataFrame:
    """The terms of a kind in their own order; flags that are missing are false."""
    flags = [c for c in terms.columns if c.startswith("is_")]
    return terms.filter(F.col("kind") == kind).withColumns(
        {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flags}).orderBy("sort")


def index_metadata(meta: DataFrame) -> DataFrame:
    """One row: the key-value pairs as a map (a fixed handful of keys)."""
    return meta.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
                    .alias("meta"))


def schema_version(meta: DataFrame) -> DataFrame:
    return meta.agg(F.coalesce(F.max(F.when(F.col("key") == "schema_version", F.col("value")
                                            .try_cast("int"))), F.lit(0)).alias("version"))


def sharing_of(users: DataFrame, owner: str, kind: str = "sharing_types") -> DataFrame:
    return users.filter(F.col("login") == owner).select(F.explode(kind).alias("key", "visibility"))


def type_flagged(reasons: Column, code: str = "type.to_confirm") -> Column:
    return F.exists(reasons, lambda r: r["code"] == code)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    return pages.filter(F.col("page").between(first, last)).orderBy("page")


def without_blank(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.filter(~F.col(text).rlike("^\\s*$"))


def describe(index: DataFrame) -> DataFrame:
    """Records for reviewers as JSON."""
    return index.select("id", F.to_json(F.struct(
        "id", "owner", F.col("display_name").alias("name"), "status", "sha256", "unit",
        "document_type")).alias("record"))


# --- counts ---------------------------------------------------------------------------------------


def unit_stats(index: DataFrame, owner: str | None = None) -> DataFrame:
    return (_owned(index.filter(_live() & F.col("unit").isNotNull()), owner).groupBy("unit")
            .agg(F.sum(F.when(is_filed(), 1).otherwise(0)).alias("filed"),
                 F.count("*").alias("total")))


def counts(index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return index.filter(_live()).groupBy(*by).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(F.col("needs_review"), 1).otherwise(0)), F.lit(0)).alias("review"),
        F.coalesce(F.sum(F.when(is_filed(), 1).otherwise(0)), F.lit(0)).alias("filed"))


def question_counts(questions: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    visible = F.col("status") == "visible"
    return questions.groupBy("sha256").agg(
        n(visible).alias("visible"), n(F.col("status") == "excluded").alias("excluded"),
        n(visible & F.col("review_status").isNull()).alias("unreviewed"))


def questions_to_verify(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Papers with unreviewed questions, one document per content."""
    open_ = question_counts(questions).filter("unreviewed > 0")
    first = index.filter(_live()).groupBy("sha256").agg(F.min("id").alias("id"))
    return open_.join(first, "sha256").select("id", "sha256", "unreviewed")


def suggestion_summary(docs: DataFrame, field: str, common: dict[str, str] | None = None,
                       applies: Column | None = None) -> DataFrame:
    """Histogram of the values a field would get: those chosen for all before the suggestion;
    'n/a' where the field does not count, null where nothing is suggested."""
    chosen = (common or {}).get(field)
    value = F.lit(chosen) if chosen else F.nullif(F.col(field).cast("string"), F.lit(""))
    applies = F.lit(True) if applies is None else applies
    return (docs.groupBy(F.when(applies, F.lit("suggested")).otherwise("not_applicable")
                         .alias("state"), F.when(applies, value).alias("value"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value"))


def review_groups(queue: DataFrame) -> DataFrame:
    """Queue documents with the same suggested unit, type and role; largest groups first."""
    return (queue.groupBy("unit", "document_type", "role")
            .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
            .orderBy(F.desc("n"), "first_id"))


def bundle_entries(docs: DataFrame) -> DataFrame:
    """One row per entry: a document, or a bundle of several with its lead and member count."""
    # a document without a bundle stands for itself, so the lone ones do not share a key
    key = F.coalesce(F.concat(F.lit("b:"), "bundle_id"), F.concat(F.lit("d:"), F.col("id").cast("string")))
    order = F.struct(F.coalesce(F.col("id") != F.col("bundle_lead"), F.lit(True)), F.col("id"))
    return docs.groupBy(key.alias("entry")).agg(
        F.min_by("id", order).alias("lead"), (F.count("*") - 1).alias("members"))


def marks_by_page(strokes: DataFrame) -> DataFrame:
    return strokes.groupBy("document", "page").agg(F.count("*").alias("strokes"))


def academic_years(index: DataFrame) -> DataFrame:
    return (index.filter("academic_year is not null").select("academic_year").distinct()
            .orderBy(F.desc("academic_year")))


def used_bytes(blobs: DataFrame, cap: int) -> DataFrame:
    used = F.coalesce(F.sum("size"), F.lit(0))
    return blobs.agg(used.alias("used"), (used > cap).alias("over"))


def common_folder(members: DataFrame) -> DataFrame:
    """Suggested name per group: the deepest folder that all paths share, else the first name.

    The longest shared prefix of a set is that of its smallest and largest member, so the group
    comes down to two values. `members(grp, id, source_path)`.
    """
    path = F.replace(F.coalesce("source_path", F.lit("")), F.lit("!/"), F.lit("/"))
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    ends = members.groupBy("grp").agg(F.min(folders).alias("a"), F.max(folders).alias("b"),
                                      F.min_by("source_path", "id").alias("first"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.array_position(same, F.lit(False)).cast("int")
    length = F.when(shared == 0, F.size("a")).otherwise(shared - 1)
    last = F.when(length > 0, F.element_at("a", length))
    folder = F.regexp_replace(last, "(?i)\\.(zip|rar|7z|tar|tgz)$", "")
    fallback = F.regexp_replace(N.base_name("first"), "\\.[^.]+$", "")
    return ends.select("grp", F.coalesce(F.nullif(folder, F.lit("")), fallback).alias("name"))


def recent(index: DataFrame, k: int = 6) -> DataFrame:
    """The newest `k` documents of each owner; Spark trims each task to `k` before the shuffle."""
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("id"))
    return index.filter(_live()).withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= k)


def shelf_order(docs: DataFrame) -> DataFrame:
    """Order inside a unit: years newest first and none last; in a year dated papers by date, then the rest. What is of one date and
    type goes by number and stands where the first title of it does; all else goes by natural
    title order. The key columns sort the whole table."""
    keyed = docs.withColumn("title_key", N.natural_key(F.col("title")))
    group = ["academic_year", "date", "assessment_type"]
    heads = keyed.filter("assessment_type is not null").groupBy(*group).agg(F.min("title_key").alias("_head")).select(
        *[F.col(c).alias(f"_{c}") for c in group], "_head")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (keyed.join(heads, same, "left").orderBy(
        F.desc_nulls_last("academic_year"), F.asc_nulls_last("date"), F.coalesce("_head", "title_key"), F.asc_nulls_last("assessment_type"),
        F.when(F.col("assessment_type").isNotNull(), F.coalesce("assessment_number", F.lit(0))), "title_key", "display_name", "id")
        .drop("_head", *[f"_{c}" for c in group]))


# --- relations ------------------------------------------------------------------------------------


def followers(queue: DataFrame) -> DataFrame:
    """id, follows: queue documents whose lead is in the queue too stand below it."""
    leads = queue.select(F.col("id").alias("follows"))
    return (queue.join(leads, (F.col("bundle_lead") == F.col("follows"))
                       & (F.col("bundle_lead") != F.col("id")), "left").select("id", "follows"))


def removal_closure(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen documents and the copies of each."""
    copies = index.join(chosen.select(F.col("id").alias("_c")), F.col("duplicate_of") == F.col("_c")
                        ).select("id")
    return chosen.select("id").unionByName(copies).distinct()


def keep_known_pointers(index: DataFrame, columns: tuple[str, ...] = (
        "parent", "duplicate_of", "bundle_lead")) -> DataFrame:
    """Pointers to documents that are not in the index become null."""
    out = index
    ids = index.select(F.col("id").alias("_id"))
    for c in columns:
        # the many null pointers stay out of the join, where they would meet in one task
        out_null, out_set = out.filter(F.col(c).isNull()), out.filter(F.col(c).isNotNull())
        joined = out_set.join(ids, F.col(c) == F.col("_id"), "left")
        out_set = joined.withColumn(c, F.when(F.col("_id").isNotNull(), F.col(c))).drop("_id")
        out = out_null.unionByName(out_set)
    return out


def ancestry(docs: DataFrame, levels: int = 5) -> DataFrame:
    """id, depth, name of the archives a document came in, nearest first, up to five levels."""
    parents = docs.select(F.col("id").alias("_pid"), F.col("parent").alias("_next"),
                          F.substring_index("path", "!/", -1).alias("name"))
    step = docs.filter("parent is not null").select("id", F.col("parent").alias("_at"))
    found = None
    for depth in range(levels):
        hit = step.join(parents, F.col("_at") == F.col("_pid"))
        rows = hit.select("id", F.lit(depth).alias("depth"), "name")
        found = rows if found is None else found.unionByName(rows)
        step = hit.filter("_next is not null").select("id", F.col("_next").alias("_at"))
    return found


def labelled(docs: DataFrame, terms: DataFrame, units: DataFrame) -> DataFrame:
    """Labels instead of slugs: vocabulary terms by kind, units with their acronym; an unknown value
    shows as it is."""
    out = docs
    for kind, column in (("document_types", "document_type"), ("assessment_types",
                                                               "assessment_type")):
        if column in docs.columns:
            t = terms.filter(F.col("kind") == kind).select(
                F.col("slug").alias(f"_{column}"), F.col("label").alias(f"{column}_label"))
            out = out.join(t, F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
            out = out.withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))
    named = F.when(F.coalesce("acronym", F.lit("")) != "", F.concat(
        "name", F.lit(" ("), "acronym", F.lit(")"))).otherwise(F.col("name"))
    u = units.select(F.col("key").alias("_unit"), named.alias("unit_label"))
    return out.join(u, F.col("unit") == F.col("_unit"), "left").drop("_unit").withColumn(
        "unit_label", F.coalesce("unit_label", "unit"))


def evidence_paths(proposals_table: DataFrame, docs: DataFrame) -> DataFrame:
    """id, path: where the documents behind a proposal came from."""
    ev = proposals_table.select("id", F.explode("evidence.document").alias("document")).distinct()
    paths = docs.select(F.col("id").alias("document"), F.explode("sources.path").alias("path"))
    return ev.join(paths, "document").select("id", "path")


def run_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def title_of(docs: DataFrame, with_type: bool = False) -> Column:
    """Readable title from label columns and the original name."""
    number = F.concat_ws(" ", "assessment_label", F.col("assessment_number").cast("string"))
    parts = F.concat_ws(" · ", number, "season_label",
                        F.when(F.col("variant").isNotNull(), F.concat(F.lit("versão "), "variant")),
                        *(["role_label"] if with_type else []))
    plain = N.prettify(F.col("original_name"))
    named = F.nullif(F.trim("title"), F.lit(""))
    lead = [F.col("type_label")] if with_type else []
    return (F.when(named.isNotNull() & F.col("assessment_label").isNull(),
                   F.concat_ws(" · ", *lead, "title"))
            .when(named.isNotNull(), F.col("title"))
            .when(F.col("assessment_label").isNotNull(), parts)
            .otherwise(F.concat_ws(" · ", *lead, plain)))
