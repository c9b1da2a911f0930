"""The academic catalog: loading, merging, linking, change requests."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as X
from quire.session import durable, number_within, row_digest

SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
ADDITIVE = ("aliases", "keywords")


def link_key(unit: Column, institution: Column) -> Column:
    """A bare slug belongs to the institution of the course, a full key to any."""
    return F.when(F.contains(unit, F.lit("/")), unit).otherwise(F.concat_ws("/", institution, unit))


def unit_ref(key: Column, institution: Column) -> Column:
    own = F.substring_index(key, "/", 1) == institution
    return F.when(own, F.substring_index(key, "/", -1)).otherwise(key)


def flatten(nested: DataFrame) -> dict[str, DataFrame]:
    """Keyed tables from `nested(slug, name, acronym, courses array<struct<slug, name, degree, units>>,
    units array<struct<…>>)`."""
    courses = nested.select(F.col("slug").alias("institution"), F.explode("courses").alias("c"))
    units = nested.select(F.col("slug").alias("institution"), F.explode("units").alias("u"))
    key = lambda slug: F.concat_ws("/", "institution", slug)
    links = courses.select(key("c.slug").alias("course_key"), "institution",
                           F.explode("c.units").alias("l"))
    return {
        "institutions": nested.select("slug", "name", "acronym"),
        "courses": courses.select(key("c.slug").alias("key"), "institution", "c.slug", "c.name",
                                  "c.degree"),
        "units": units.select(key("u.slug").alias("key"), "institution", "u.*"),
        "course_units": links.select("course_key", link_key(F.col("l.unit"), F.col("institution"))
                                     .alias("unit_key"), "l.curricular_year", "l.semester")}


def export_bundle(institutions: DataFrame, courses: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of the nested bundle, one JSON line per entity in bundle order; a file per institution
    comes from writing them partitioned by institution."""
    rows = institutions.select(F.col("slug").alias("institution"), F.lit(0).alias("part"),
                               F.col("slug").alias("key"),
                               F.to_json(F.struct(*institutions.columns)).alias("record"))
    for part, df in ((1, courses), (2, units)):
        rows = rows.unionByName(df.select("institution", F.lit(part).alias("part"), "key", F.to_json(
            F.struct(*[c for c in df.columns if c != "institution"])).alias("record")))
    return rows


def upsert(current: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Merged rows with `outcome` created / updated / unchanged. Only given (non-null) values
    overwrite; list columns named as additive are joined in order without repeats."""
    columns = [c for c in current.columns if c != key]
    old = current.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in columns],
                         F.lit(True).alias("_old"))
    new = incoming.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in columns],
                          F.lit(True).alias("_new"))
    both = old.join(new, key, "full_outer")

    def merged(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in ADDITIVE:
            return F.when(o.isNotNull() & n.isNotNull(), F.array_distinct(F.concat(o, n))).otherwise(
                F.coalesce(n, o))
        return F.coalesce(n, o)

    same = F.lit(True)
    for c in columns:
        same = same & merged(c).eqNullSafe(F.col(f"_o_{c}"))
    outcome = (F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept")
               .when(same, "unchanged").otherwise("updated"))
    return both.select(key, *[merged(c).alias(c) for c in columns], outcome.alias("outcome"))


def invalid_slugs(incoming: DataFrame, slug: str = "slug") -> DataFrame:
    return incoming.filter(~F.coalesce(F.col(slug).rlike(SLUG), F.lit(False)))


def missing_links(course_units: DataFrame, units: DataFrame) -> DataFrame:
    """Course links that point to no unit."""
    return course_units.join(units, F.col("unit_key") == F.col("key"), "left_anti")


def changed_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows that are new or differ: what has to be written."""
    columns = new.columns
    digest = lambda df: df.withColumn("_d", row_digest(*[F.col(c) for c in columns]))
    before = digest(old.select(*columns)).select(F.col(key).alias("_k"), F.col("_d").alias("_before"))
    return (digest(new).join(before, F.col(key) == F.col("_k"), "left")
            .filter(F.col("_before").isNull() | (F.col("_before") != F.col("_d")))
            .select(*columns))


def course_of_unit(course_units: DataFrame) -> DataFrame:
    return course_units.groupBy("unit_key").agg(F.min("course_key").alias("course_key"))


def loose_units(units: DataFrame, course_units: DataFrame) -> DataFrame:
    return units.join(course_units, F.col("key") == F.col("unit_key"), "left_anti")


def topic_tree(topics: DataFrame) -> DataFrame:
    """unit_key, slug, depth, sort: preorder numbers of `topics(unit_key, slug, parent_slug,
    position)`, level by level until none is left. The path of sibling positions sorts like the
    preorder. Topics that no root leads to are not in the tree."""
    level = topics.filter("parent_slug is null").select(
        "unit_key", "slug", "parent_slug", F.lit(0).alias("depth"), F.array(F.col("position").cast("long"))
        .alias("path"))
    tree = level
    for depth in count(1):
        parents = level.select("unit_key", F.col("slug").alias("parent_slug"),
                               F.col("path").alias("_p"))
        level = durable(topics.join(parents, ["unit_key", "parent_slug"]).select(
            "unit_key", "slug", "parent_slug", F.lit(depth).alias("depth"),
            F.concat("_p", F.array(F.col("position").cast("long"))).alias("path")), "level")
        if level.isEmpty():
            break
        tree = tree.unionByName(level)
    return number_within(tree, ["unit_key"], "path", "sort").select(
        "unit_key", "slug", "parent_slug", "depth", (F.col("sort") - 1).cast("int").alias("sort"))


def merge_targets(merges: DataFrame) -> DataFrame:
    """`merges(key, into)` with the last target of each chain; a removed target (into is null) removes
    all that lead to it. Each round doubles the steps that are followed; a circle is an error."""
    m = durable(merges.select("key", "into"), "merges")
    steps, rounds = m.count(), 0
    while True:
        on = m.select(F.col("key").alias("_k"), F.col("into").alias("_next"))
        ahead = m.join(on, F.col("into") == F.col("_k"), "left")
        if ahead.where("_k is not null").isEmpty():
            return m
        if 2 ** rounds > steps:
            raise ValueError("the merges go in a circle")
        m = durable(ahead.select("key", F.when(F.col("_k").isNotNull(), F.col("_next")).otherwise(F.col("into")).alias("into")), "merges")
        rounds += 1


def merge_units(docs: DataFrame, units: DataFrame, course_units: DataFrame,
                merges: DataFrame) -> dict[str, DataFrame]:
    """Units removed or merged by `merges(key, into)`: documents and course links follow, a course
    never lists a unit twice, the old names become aliases of the target. Where the target is merged
    itself, its own target counts, to the end of the chain."""
    m = merge_targets(merges).select(F.col("key").alias("_from"), F.col("into").alias("_into"))
    new_docs = docs.join(m, F.col("unit") == F.col("_from"), "left").select(
        *[c for c in docs.columns if c not in ("unit", "classifier_version")],
        F.when(F.col("_from").isNotNull(), F.col("_into")).otherwise(F.col("unit")).alias("unit"),
        *([F.when(F.col("_from").isNull(), F.col("classifier_version")).alias("classifier_version")]
          if "classifier_version" in docs.columns else []))
    moved = course_units.join(m, F.col("unit_key") == F.col("_from"), "left").withColumn(
        "unit_key", F.when(F.col("_from").isNotNull(), F.col("_into")).otherwise(F.col("unit_key"))
    ).filter("unit_key is not null")
    order = F.struct(F.col("_from").isNotNull(), F.col("curricular_year"), F.col("semester"))
    links = moved.groupBy("course_key", "unit_key").agg(
        F.min_by(F.struct("curricular_year", "semester"), order).alias("l")).select(
        "course_key", "unit_key", "l.*")
    names = F.filter(F.concat(F.array("name"), F.array("acronym"), F.coalesce(
        "aliases", F.array().cast("array<string>"))), lambda n: n.isNotNull())
    given = units.join(m, F.col("key") == F.col("_from")).filter("_into is not null").select(
        F.col("_into").alias("key"), names.alias("_names"))
    given = given.groupBy("key").agg(F.flatten(F.array_sort(F.collect_list("_names"))).alias("_names"))
    kept = units.join(m, F.col("key") == F.col("_from"), "left_anti").join(given, "key", "left")
    own = F.transform(names, lambda n: F.lower(n))
    extra = F.filter(F.array_distinct(F.coalesce("_names", F.array().cast("array<string>"))),
                     lambda n: ~F.array_contains(own, F.lower(n)))
    aliases = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), extra)
    return {"docs": new_docs, "course_units": links,
            "units": kept.withColumn("aliases", aliases).drop("_names")}


def remove_courses(courses: DataFrame, course_units: DataFrame, users: DataFrame,
                   gone: DataFrame) -> dict[str, DataFrame]:
    """Courses out of the catalog and of all enrolments; their units stay."""
    g = gone.select(F.col("key").alias("_gone"))
    listed = users.select("login", F.posexplode_outer("enrolled_courses").alias("_i", "_c"))
    left = (listed.join(g, F.col("_c") == F.col("_gone"), "left_anti").groupBy("login")
            .agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct(
                "_i", "_c")))), lambda s: s["_c"]).alias("enrolled_courses")))
    return {"courses": courses.join(g, F.col("key") == F.col("_gone"), "left_anti"),
            "course_units": course_units.join(g, F.col("course_key") == F.col("_gone"), "left_anti"),
            "users": users.drop("enrolled_courses").join(left, "login", "left").withColumn(
                "enrolled_courses", F.coalesce("enrolled_courses", F.array().cast("array<string>")))}


def ordered_changes(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last valid change per entity, rejected changes) of `log(seq, entity, key, action, payload,
    error)`: requests apply in order, so the last one of a key stands."""
    ok = log.filter("error is null")
    last = ok.groupBy("entity", "key").agg(F.max_by(F.struct("action", "payload", "seq"), "seq")
                                           .alias("c"))
    return last.select("entity", "key", "c.*"), log.filter("error is not null")


def folded_changes(log: DataFrame) -> DataFrame:
    """The state that the valid requests of `log(seq, entity, key, action, payload map, error)` leave:
    entity, key, action and seq of the last request, and `fields`: of each field the last value given
    since the last removal, null where the entity is removed."""
    ok = log.filter("error is null")
    last = ok.groupBy("entity", "key").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"),
                                           F.max(F.when(F.col("action") == "remove", F.col("seq"))).alias("gone"))
    given = ok.filter("action <> 'remove'").select("entity", "key", "seq", F.explode("payload").alias("field", "value"))
    since = given.join(last.select("entity", "key", "gone"), ["entity", "key"]).filter("gone is null or seq > gone")
    values = since.groupBy("entity", "key", "field").agg(F.max_by("value", "seq").alias("value"))
    fields = values.groupBy("entity", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return last.drop("gone").join(fields, ["entity", "key"], "left")


def union_first(parts: list[DataFrame], name: str = "name") -> DataFrame:
    """Union of sources of falling priority; the first with the same normalised name stays."""
    rows = None
    for i, part in enumerate(parts):
        p = part.withColumn("_pri", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    keyed = rows.withColumn("_key", X.normalize(name)).filter("_key <> ''")
    best = keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct("_pri", name))
                                     .alias("r"))
    return best.select("r.*").withColumnRenamed("_pri", "priority")


def institution_choices(existing: DataFrame, proposed: DataFrame, unit_proposals: DataFrame) -> DataFrame:
    """Existing institutions, then proposed ones, with the preferred one marked: the only one the
    unit proposals name, else the only existing one, else the first."""
    rows = (existing.select(F.concat(F.lit("i:"), "slug").alias("key"), "slug", "name",
                            F.lit(0).alias("part"))
            .unionByName(proposed.select(
                F.concat(F.lit("p:"), "id").alias("key"), X.slugify(F.coalesce("acronym", "name"), 30)
                .alias("slug"), "name", F.lit(1).alias("part"))))
    n = unit_proposals.agg(F.count_distinct("institution")).scalar()
    one = unit_proposals.agg(F.min("institution")).scalar()
    own = F.col("part") == 0
    match = rows.filter(own & (n == 1) & (F.col("slug") == one)).agg(F.min("key")).scalar()
    only = rows.agg(F.when(F.count_if(own) == 1, F.min(F.when(own, F.col("key"))))).scalar()
    first = rows.agg(F.min_by("key", F.struct("part", "key"))).scalar()
    return rows.withColumn("preferred", F.col("key") == F.coalesce(match, only, first))
