"""Bundles of files that belong together, their leads, inheritance, and unique file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import names as N
from quire.session import durable, number_within, running_totals

MAX_MEMBERS, MAX_DOCUMENTS = 20, 3
LEAD_ORDER = ["pdf", "docx", "legacy_office", "pptx", "xlsx", "notebook", "text", "code", "other",
              "image", "archive"]
INHERITED = ["unit", "document_type", "academic_year", "assessment_type", "exam_season",
             "assessment_number", "date", "role", "solution_origin"]


# --- folders to bundles ---------------------------------------------------------------------------


def folder_members(docs: DataFrame, material: DataFrame | None = None) -> DataFrame:
    """id, owner, folder, structured, category: the folders a document stands in. `docs(id, owner, kind, ext,
    sources array<struct<path, batch>>, duplicate_of, bundle_method, bundle_dismissed)`; `material
    (folder, is_material)` names folders that only sort material."""
    free = docs.filter((F.col("kind") == "file") & F.col("duplicate_of").isNull()
                       & ~F.coalesce("bundle_dismissed", F.lit(False))
                       & (F.coalesce("bundle_method", F.lit("heuristic")) == "heuristic"))
    rows = free.select("id", "owner", N.category_of("ext").alias("category"),
                       F.explode("sources").alias("s"))
    rows = rows.withColumn("layout", N.parse_layout(N.full_path("s.batch", "s.path")))
    plain = rows.filter("layout is null").select(
        "id", "owner", "category", N.folder_of("s.path").alias("folder"), F.lit(False).alias("structured"))
    inside = rows.filter("layout is not null").select(
        "id", "owner", "category", F.col("layout.unit_folder").alias("base"), F.posexplode(F.slice(
            "layout.rest", F.lit(1), F.greatest(F.size("layout.rest") - 1, F.lit(0)))).alias("i", "part"),
        F.col("layout.rest").alias("rest"))
    if material is not None:
        inside = inside.join(material.select(F.col("folder").alias("part"), "is_material"), "part", "left")
    else:
        inside = inside.withColumn("is_material", F.lit(False))
    first = inside.filter(~F.coalesce("is_material", F.lit(False))).groupBy(
        "id", "owner", "category", "base", "rest").agg(F.min("i").alias("i"))
    grouped = first.select("id", "owner", "category", F.concat_ws("/", "base", F.array_join(
        F.slice("rest", F.lit(1), F.col("i") + 1), "/")).alias("folder"), F.lit(True).alias("structured"))
    return plain.unionByName(grouped).filter("folder is not null").distinct()


def qualifies(n: Column, code: Column, documents: Column, images: Column) -> Column:
    return (n.between(2, MAX_MEMBERS) & (code > 0) & ((documents > 0) | (images > 0))
            & (documents <= MAX_DOCUMENTS))


def folder_profile(members: DataFrame) -> DataFrame:
    """Per folder: files, code, documents, images and whether it qualifies on its own."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = members.groupBy("owner", "folder").agg(
        F.count("*").alias("files"), n(F.col("category").isin("code", "notebook")).alias("code"),
        n(F.col("category").isin(N.DOCUMENT_CATEGORIES)).alias("documents"),
        n(F.col("category") == "image").alias("images"), F.bool_or("structured").alias("structured"))
    fits = F.when(F.col("structured"), F.col("files").between(2, MAX_MEMBERS)).otherwise(
        qualifies(F.col("files"), F.col("code"), F.col("documents"), F.col("images")))
    return out.withColumn("qualifies", fits)


def project_folders(members: DataFrame) -> DataFrame:
    """id, owner, folder of the proposed bundles: largest folder first, a document in one only.

    The choice for a folder only depends on earlier folders that share a document with it. So in
    each round every folder that comes first for all its documents is settled, all of them at once;
    their taken documents leave the other folders. Folders that can no longer become a bundle drop
    out before. The result is that of going through the folders one by one.
    """
    keys = ["owner", "folder"]
    hope = (F.col("files") >= 2) & (F.col("structured") | (
        (F.col("code") > 0) & ((F.col("documents") > 0) | (F.col("images") > 0))))
    rank = F.struct((-F.col("files")).alias("minus"), F.col("folder").alias("name"))
    # most folders drop out here, by one count of the members, before anything else is asked of them
    hopeful = folder_profile(members).filter(hope).select(*keys, rank.alias("_rank"))
    rows = durable(members.join(hopeful, keys), "members")
    out = None
    while True:  # each round settles a folder at least
        alive = rows.join(folder_profile(rows).filter(hope).select(*keys, "qualifies"), keys)
        first = alive.groupBy("owner", "id").agg(F.min("_rank").alias("_first"))
        ready = alive.join(first, ["owner", "id"]).groupBy(*keys).agg(
            F.bool_and(F.col("_rank") == F.col("_first")).alias("_ready"))
        state = durable(alive.join(ready, keys), "round")
        won = state.filter("_ready and qualifies").select("id", *keys)
        out = won if out is None else out.unionByName(won)
        rows = state.filter("not _ready").join(won.select("owner", "id"), ["owner", "id"], "left_anti").drop(
            "qualifies", "_ready")
        if state.filter("not _ready").isEmpty():
            break
    return out


# --- leads ----------------------------------------------------------------------------------------


def lead_order() -> Column:
    category = N.category_of("ext")
    place = F.array_position(F.array(*[F.lit(c) for c in LEAD_ORDER]), category)
    settled = F.coalesce(F.col("filed_name").isNotNull() & ~F.col("needs_review"), F.lit(False))
    return F.struct((~settled).alias("a"), F.when(F.col("kind") == "file", place).otherwise(99).alias("b"),
                    (-F.coalesce("unit_confidence", F.lit(0.0))).alias("c"), F.col("id"))


def choose_leads(members: DataFrame) -> DataFrame:
    """bundle_id, lead: the user's choice if it is a member, else the current lead while it is filed
    and clean, else the best member. `members(bundle_id, id, kind, ext, filed_name, needs_review,
    unit_confidence, lead, lead_choice)`."""
    settled = F.coalesce(F.col("filed_name").isNotNull() & ~F.col("needs_review"), F.lit(False))
    best = members.groupBy("bundle_id").agg(F.min_by("id", lead_order()).alias("best"))
    inside = members.select(F.col("bundle_id").alias("_b"), F.col("id").alias("_m"), settled.alias("_ok"))

    def named(column: str) -> DataFrame:
        wishes = members.filter(F.col(column).isNotNull()).select("bundle_id", F.col(column).alias("_w")
                                                                  ).distinct()
        hits = wishes.join(inside, (F.col("bundle_id") == F.col("_b")) & (F.col("_w") == F.col("_m")))
        return hits.groupBy("bundle_id").agg(F.min("_w").alias(column), F.min_by("_ok", "_w")
                                             .alias(f"{column}_ok"))
    out = best.join(named("lead_choice"), "bundle_id", "left").join(named("lead"), "bundle_id", "left")
    kept = F.when(F.col("lead_ok"), F.col("lead"))
    return out.select("bundle_id", F.coalesce("lead_choice", kept, "best").alias("lead"))


def inherit(members: DataFrame, leads: DataFrame, fields: list[str] = INHERITED) -> DataFrame:
    """Members take the fields of their lead unless their own come from a person or AI; a value
    inherited before goes when the lead lost it. Classification fields are structs of value,
    confidence, method, inherited."""
    lead = leads.select(F.col("id").alias("_lead"), F.col("classification").alias("_lc"))
    joined = members.join(lead, F.col("bundle_lead") == F.col("_lead"), "left")

    def merged(f: str) -> Column:
        mine, theirs = F.col(f"classification.{f}"), F.col(f"_lc.{f}")
        own = mine.isNotNull() & (mine["method"] != "heuristic")
        taken = F.struct(theirs["value"].alias("value"), F.when(theirs["method"] == "user", 1.0).otherwise(
            theirs["confidence"]).alias("confidence"), F.lit("heuristic").alias("method"),
            F.lit(True).alias("inherited"))
        lost = F.when(~F.coalesce(mine["inherited"], F.lit(False)), mine)
        return F.when(own, mine).when(theirs["value"].isNotNull(), taken).otherwise(lost)

    present = [f for f in members.schema["classification"].dataType.fieldNames()]
    updated = F.struct(*[(merged(f) if f in fields else F.col(f"classification.{f}")).alias(f)
                         for f in present])
    value = F.when(F.col("_lead").isNotNull(), updated).otherwise(F.col("classification"))
    return joined.withColumn("classification", value).drop("_lead", "_lc")


def edit_bundles(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """User edits on top: `edits(id, action, bundle_id, name, lead_choice, seq)`, action join /
    separate; the last one of a document counts. A user bundle left with fewer than two members
    dissolves, and a lead choice holds only while it names a member."""
    last = edits.groupBy("id").agg(F.max_by(F.struct("action", "bundle_id", "name", "lead_choice"), "seq")
                                   .alias("e"))
    out = docs.join(last, "id", "left")
    joins, leaves = F.col("e.action") == "join", F.col("e.action") == "separate"
    out = out.select(
        *[c for c in docs.columns if c not in ("bundle_id", "bundle_name", "bundle_method", "lead_choice",
                                               "bundle_dismissed")],
        F.when(joins, F.col("e.bundle_id")).when(leaves, F.lit(None)).otherwise(F.col("bundle_id"))
        .alias("bundle_id"),
        F.when(joins, F.trim("e.name")).when(leaves, F.lit(None)).otherwise(F.col("bundle_name"))
        .alias("bundle_name"),
        F.when(joins, "user").when(leaves, F.lit(None)).otherwise(F.col("bundle_method")).alias("bundle_method"),
        F.when(joins, F.col("e.lead_choice")).when(leaves, F.lit(None)).otherwise(F.col("lead_choice"))
        .alias("lead_choice"),
        F.when(joins, False).when(leaves, True).otherwise(F.coalesce("bundle_dismissed", F.lit(False)))
        .alias("bundle_dismissed"))
    mine = out.filter("bundle_method = 'user'")
    size = mine.groupBy(F.col("bundle_id").alias("_b")).agg(F.count("*").alias("_n"))
    ids = mine.select(F.col("bundle_id").alias("_cb"), F.col("id").alias("_ci"))
    out = (out.join(size, F.col("bundle_id") == F.col("_b"), "left")
           .join(ids, (F.col("bundle_id") == F.col("_cb")) & (F.col("lead_choice") == F.col("_ci")), "left"))
    gone = (F.col("bundle_method") == "user") & (F.col("_n") < 2)
    clear = lambda c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)).alias(c)
    return out.select(*docs.columns[:0], *[c for c in out.columns if c not in (
        "bundle_id", "bundle_name", "bundle_method", "lead_choice", "bundle_dismissed", "_b", "_n", "_cb", "_ci")],
        clear("bundle_id"), clear("bundle_name"), clear("bundle_method"),
        F.when(~F.coalesce(gone, F.lit(False)), F.col("_ci")).alias("lead_choice"),
        (F.col("bundle_dismissed") | F.coalesce(gone, F.lit(False))).alias("bundle_dismissed"))


# --- unique names ---------------------------------------------------------------------------------


def unique_names(docs: DataFrame, keys: list[str], name: str = "name", order: str = "id") -> DataFrame:
    """`docs` with `filed_name`: a name taken by a smaller id of the same group gets -2, -3… before
    the extension.

    Names can only meet when they agree after their trailing numbers are cut. Where such a family
    has one base name only, the suffix is a rank, computed without bringing a hot name into one
    task. Families of several base names are settled by `_claimed`.
    """
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    ext = F.regexp_extract(name, "(\\.[^.]*)$", 1)
    rows = docs.select("*", stem.alias("_stem"), ext.alias("_ext"),
                       F.regexp_replace(stem, "(-[0-9]+)+$", "").alias("_root"))
    family = [*keys, "_root", "_ext"]
    bases = rows.groupBy(*family).agg((F.min("_stem") != F.max("_stem")).alias("_mixed"))
    cond = None
    for k in family:
        c = F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
        cond = c if cond is None else cond & c
    tagged = rows.alias("r").join(bases.alias("b"), cond).select("r.*", "b._mixed")
    simple = number_within(tagged.filter("not _mixed").drop("_mixed"), family, order, "_rn")
    numbered = F.when(F.col("_rn") > 1, F.concat("_stem", F.lit("-"), F.col("_rn").cast("string"), "_ext")
                      ).otherwise(F.col(name))
    plain = simple.select(*docs.columns, numbered.alias("filed_name"))
    named = _claimed(tagged.filter("_mixed").select(*family, F.col(order).alias("_id"), "_stem"), family)
    rest = (tagged.filter("_mixed").join(named, F.col(order) == F.col("_id"))
            .select(*docs.columns, F.concat("_chosen", "_ext").alias("filed_name")))
    return plain.unionByName(rest)


def _claimed(rows: DataFrame, family: list[str]) -> DataFrame:
    """_id, _chosen: each row claims its stem, or where that is taken the stem with the first number from 2 on
    that is free, in order of _id.

    A name can be claimed by two stems only, its own and the one before its last number. Whether "x-2" is
    free for the rows of "x" when they come to 2 depends on when the first row of "x-2" comes, and on nothing
    below that. So stems are settled level by level, all of a level at once: numbers that are passed over
    are told from the place that a claim has among the numbers not passed over before, in rounds until none changes, and
    then each claim finds its number by its rank among the numbers left."""
    key = lambda stem: F.to_json(F.struct(*family, stem.alias("_s")), {"ignoreNullFields": "false"})
    tail = "^(.+)-([2-9]|[1-9][0-9]{1,17})$"
    rows = rows.select("_id", "_stem", key(F.col("_stem")).alias("_base"), key(F.nullif(F.regexp_extract("_stem", tail, 1), F.lit(""))).alias("_parent"),
                       F.regexp_extract("_stem", tail, 2).try_cast("long").alias("_num"))
    claims = durable(number_within(rows, ["_base"], "_id", "_k"), "claims")
    firsts = durable(claims.filter("_k = 1").select("_base", "_parent", "_num", F.col("_id").alias("_since")), "stems")
    below = durable(firsts.filter("_num is not null").join(firsts.select(F.col("_base").alias("_parent")), "_parent", "left_semi"), "below")
    level = firsts.join(below.select("_base"), "_base", "left_anti").select("_base", F.lit(True).alias("_own"))
    out = None
    while True:
        # claims of the level that need a number, in order; the first of a stem whose own name is free does not
        asked = durable(claims.join(level, "_base").withColumn("_k", F.col("_k") - F.when(F.col("_own"), 1).otherwise(0)).select("_id", "_stem", "_base", "_k"), "asked")
        children = durable(level.select(F.col("_base").alias("_parent")).join(below, "_parent").select("_parent", "_num", "_base", "_since", F.lit(False).alias("_past")), "children")
        turns = asked.filter("_k > 0").select(F.col("_base").alias("_parent"), F.col("_k").alias("_turn"), F.col("_id").alias("_when"))
        while True:
            counted = running_totals(children, ["_parent"], "_num", _n=F.when(F.col("_past"), 1).otherwise(0))
            place = F.col("_num") - 1 - F.col("_n") + F.when(F.col("_past"), 1).otherwise(0)
            met = counted.withColumn("_turn", place).join(turns, ["_parent", "_turn"], "left")
            after = durable(met.select("_parent", "_num", "_base", "_since", F.coalesce(F.col("_since") < F.col("_when"), F.lit(False)).alias("_now"), "_past",
                                       F.col("_when").isNotNull().alias("_met")), "children")
            done = not after.filter("_now <> _past").take(1)
            children = after.withColumn("_past", F.col("_now")).drop("_now")
            if done:
                break
        past = running_totals(children.filter("_past").select("_parent", "_num"), ["_parent"], "_num", _i=F.lit(1))
        gaps = past.select(F.col("_parent").alias("_base"), F.struct((F.col("_num") - 1 - F.col("_i")).alias("x"), F.lit(1).alias("late")).alias("_at"),
                           F.lit(None).cast(asked.schema["_id"].dataType).alias("_id"), F.lit(None).cast("string").alias("_stem"), F.lit(0).cast("long").alias("_k"), F.lit(1).alias("_gap"))
        ranked = asked.select("_base", F.struct(F.col("_k").cast("long").alias("x"), F.lit(0).alias("late")).alias("_at"), "_id", "_stem", F.col("_k").cast("long").alias("_k"), F.lit(0).alias("_gap"))
        numbered = running_totals(ranked.unionByName(gaps), ["_base"], "_at", _gaps=F.col("_gap")).filter("_gap = 0")
        chosen = numbered.select("_id", F.when(F.col("_k") == 0, F.col("_stem")).otherwise(
            F.concat("_stem", F.lit("-"), (F.col("_k") + 1 + F.col("_gaps")).cast("string"))).alias("_chosen"))
        out = chosen if out is None else out.unionByName(chosen)
        # the own name of a stem below is free unless a claim above has come to its number and not passed it over
        level = durable(children.select("_base", (F.col("_past") | ~F.col("_met")).alias("_own")), "level")
        if not level.take(1):
            return out


def tree_paths(docs: DataFrame, courses: DataFrame) -> DataFrame:
    """Export paths `<course>/<unit>/<type>/<name>`, collisions numbered. `docs(id, unit, document_type,
    filed_name)`, `courses(unit, course)` with the first course slug of each unit."""
    first = courses.groupBy(F.col("unit").alias("_u")).agg(F.min("course").alias("_course"))
    placed = docs.join(first, F.col("unit") == F.col("_u"), "left").withColumn("folder", F.concat_ws(
        "/", F.coalesce("_course", F.lit("_sem-curso")),
        F.coalesce(F.substring_index("unit", "/", -1), F.lit("_sem-uc")),
        F.coalesce("document_type", F.lit("outros")))).withColumnRenamed("filed_name", "name")
    named = unique_names(placed.select("id", "folder", "name"), ["folder"])
    return named.select("id", F.concat_ws("/", "folder", "filed_name").alias("path"))


