"""Queries over records: change requests, edits, relations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N, text as X
from quire.operators import bundles as B, catalog as K, classify as C, library as L, questions as Z
from quire.plans.deposits import _paths, _PATHS
from quire.session import table
from quire.sources import deposit as S


def manifest_ignored(spark, sf):
    """Web folders as project folders; language folders play the ignored ones."""
    p = _paths(spark, sf).withColumn("path", F.regexp_replace("path", "/(fr|es)/", "/node_modules/"))
    return S.manifest_ignored(p, "grp")


IGNORED_SQL = f"""WITH {_PATHS} SELECT grp, split_part(path, '/', 1) || '/node_modules' AS root, count(*) AS files,
sum(size)::BIGINT AS bytes FROM p WHERE regexp_matches(path, '/(fr|es)/') GROUP BY 1, 2"""


def format_steps(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("format"), F.when(
        F.col("p_retailprice") < 1000, "private").otherwise("public").alias("visibility"))
    return S.upgrade_records(part)


FORMAT_SQL = """SELECT p_partkey AS id, 6 AS format, CASE WHEN p_retailprice >= 1000 THEN 'public' WHEN p_size % 5 >= 2
THEN 'private' END AS visibility FROM part"""


def change_requests(spark, sf):
    """Events as catalog requests; errors are set apart, fields stay until another request or a removal."""
    e = table(spark, sf, "events")
    log = e.select(F.col("event_id").alias("seq"), F.lit("unit").alias("entity"), F.col("user_id").alias("key"),
                   F.when(F.col("event_type") == "purchase", "remove").otherwise("upsert").alias("action"),
                   F.from_json("props", "map<string,string>").alias("payload"), F.when(F.col("event_type") == "error", "CatalogError").alias("error"))
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda f: F.concat(f["key"], F.lit("="), f["value"])), ";")
    return K.folded_changes(log).select("entity", "key", "action", "seq", fields.alias("fields"))


CHANGES_SQL = """WITH ok AS (SELECT * FROM events WHERE event_type <> 'error'),
l AS (SELECT user_id, max(event_id) AS seq, max(event_id) FILTER (event_type = 'purchase') AS gone,
  max_by(CASE WHEN event_type = 'purchase' THEN 'remove' ELSE 'upsert' END, event_id) AS action FROM ok GROUP BY user_id),
f AS (SELECT user_id, event_id, k, props ->> ('$.' || k) AS v FROM (SELECT *, unnest(json_keys(props)) AS k FROM ok
  JOIN l USING (user_id) WHERE event_type <> 'purchase' AND (gone IS NULL OR event_id > gone))),
v AS (SELECT user_id, k, max_by(v, event_id) AS v FROM f GROUP BY user_id, k),
g AS (SELECT user_id, string_agg(k || '=' || v, ';' ORDER BY k) AS fields FROM v GROUP BY user_id)
SELECT 'unit' AS entity, user_id AS key, action, seq, fields FROM l LEFT JOIN g USING (user_id)"""


def quarantine_retry(spark, sf):
    """Failed events by cause; those whose cause is gone go back to the good ones."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    cause = F.when(F.col("event_type") == "error", F.when(F.col("value") > 10, "storage").otherwise("format"))
    good, bad = S.quarantine(e, cause)
    return good.unionByName(S.retry(bad, ["storage"]))


RETRY_SQL = "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error' OR value > 10"


def ref_intake(spark, sf):
    """Labelled documents as references to the contents of two languages."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    refs = d.join(labels, "doc_id").select("doc_id", F.sha2("text", 256).alias("sha256"))
    ok, bad = S.intake_refs(refs, d.filter("lang in ('en', 'fr')").select(F.sha2("text", 256).alias("sha256")))
    return ok.select("doc_id", F.lit("accepted").alias("state")).unionByName(bad.select("doc_id", F.lit("rejected").alias("state")))


REF_SQL = """SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang IN ('en', 'fr'))
THEN 'accepted' ELSE 'rejected' END AS state FROM documents JOIN labels USING (doc_id)"""


def course_removal(spark, sf):
    """Customers enrolled in the courses (suppliers) that delivered to them; the rich suppliers' courses go, from the
    list, from their units (the nations) and from the enrolments."""
    s, o, n = table(spark, sf, "supplier"), table(spark, sf, "orders"), table(spark, sf, "lineitem")
    met = n.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("login"), F.col("l_suppkey").cast("string").alias("k")).distinct()
    users = met.groupBy("login").agg(F.sort_array(F.collect_list("k")).alias("enrolled_courses"))
    courses = s.select(F.col("s_suppkey").cast("string").alias("key"))
    links = s.select(F.col("s_suppkey").cast("string").alias("course_key"), F.col("s_nationkey").cast("string").alias("unit_key"))
    gone = s.filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("key"))
    out = K.remove_courses(courses, links, users, gone)
    return (out["users"].select(F.lit("user").alias("what"), F.col("login").cast("string").alias("key"), F.array_join("enrolled_courses", ",").alias("value"))
            .unionByName(out["courses"].select(F.lit("course").alias("what"), "key", F.lit(None).cast("string").alias("value")))
            .unionByName(out["course_units"].select(F.lit("unit").alias("what"), F.col("course_key").alias("key"), F.col("unit_key").alias("value"))))


COURSES_SQL = """WITH m AS (SELECT DISTINCT o_custkey, l_suppkey, s_acctbal <= 5000 AS stays FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT 'user' AS what, o_custkey::VARCHAR AS key, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FILTER (stays), '') AS value FROM m GROUP BY o_custkey
UNION ALL SELECT 'course', s_suppkey::VARCHAR, NULL FROM supplier WHERE s_acctbal <= 5000
UNION ALL SELECT 'unit', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier WHERE s_acctbal <= 5000"""


def catalog_bundle(spark, sf):
    r, n, c = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "customer")
    inst = r.select(F.col("r_regionkey").alias("slug"), F.col("r_name").alias("name"))
    courses = n.select(F.col("n_regionkey").alias("institution"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    units = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("institution"), F.col("c_custkey").alias("key"),
                                                                          F.col("c_name").alias("name"))
    return K.export_bundle(inst, courses, units)


BUNDLE_SQL = """SELECT r_regionkey AS institution, 0 AS part, r_regionkey::BIGINT AS key, to_json({slug: r_regionkey, name: r_name})::VARCHAR AS record FROM region
UNION ALL SELECT n_regionkey, 1, n_nationkey, to_json({key: n_nationkey, name: n_name})::VARCHAR FROM nation
UNION ALL SELECT n_regionkey, 2, c_custkey, to_json({key: c_custkey, name: c_name})::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def marks_by_page(spark, sf):
    """Events as marks on the pages of a user's document."""
    e = table(spark, sf, "events")
    return L.marks_by_page(e.select(F.col("user_id").alias("document"), F.get_json_object("props", "$.k").cast("int").alias("page")))


MARKS_SQL = "SELECT user_id AS document, (props->>'$.k')::INT AS page, count(*) AS strokes FROM events GROUP BY ALL"


def valid_marks(spark, sf):
    """Annotation files made of events: strokes of unknown kinds or odd points drop out."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "blob").otherwise("pen")
    points = F.when(F.col("value") > 20, F.array("value")).otherwise(F.array("value", "value"))
    stroke = F.struct(F.col("event_id").cast("string").alias("id"), kind.alias("kind"), F.lit("red").alias("color"), F.lit(1.0).alias("width"),
                      points.alias("points"))
    doc = F.to_json(F.struct(F.lit("x-anotacoes").alias("format"), F.col("user_id").cast("string").alias("document"),
                             F.create_map(F.lit("1"), F.array(stroke)).alias("pages")))
    return e.select("event_id", F.size(F.map_keys(N.parse_marks(doc))).alias("pages"))


VALID_SQL = "SELECT event_id, CASE WHEN event_type <> 'error' AND value <= 20 THEN 1 ELSE 0 END AS pages FROM events"


def run_report(spark, sf):
    return L.run_report(table(spark, sf, "events").select(F.col("event_type").alias("outcome")))


REPORT_SQL = "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1"


def labels_join(spark, sf):
    """Parts with the label of their type and the name of their nation as unit."""
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    docs = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("document_type"), (F.col("p_size") % 30).cast("string").alias("unit"))
    terms = p.filter("p_type <> 'SMALL'").select(F.lit("document_types").alias("kind"), F.col("p_type").alias("slug"), F.initcap(F.lower("p_type"))
                                                 .alias("label")).distinct()
    units = n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.when(
        F.col("n_regionkey") == 0, F.lit("R0")).alias("acronym"))
    return L.labelled(docs, terms, units)


LABELS_SQL = """SELECT p_partkey AS id, p_type AS document_type, (p_size % 30)::VARCHAR AS unit, CASE WHEN p_type = 'SMALL' THEN p_type ELSE
upper(p_type[1]) || lower(p_type[2:]) END AS document_type_label, coalesce(n_name || CASE WHEN n_regionkey = 0 THEN ' (R0)' ELSE '' END,
(p_size % 30)::VARCHAR) AS unit_label FROM part LEFT JOIN nation ON n_nationkey = p_size % 30"""


def evidence_paths(spark, sf):
    """Orders as proposals with their lines' parts as evidence."""
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    # an order has a handful of lines
    props = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.struct(F.col("l_partkey").alias("document"))).alias("evidence"))
    docs = part.select(F.col("p_partkey").alias("id"), F.array(F.struct(F.col("p_name").alias("path"))).alias("sources"))
    return L.evidence_paths(props, docs)


EVIDENCE_SQL = "SELECT id, path FROM (SELECT DISTINCT l_orderkey AS id, l_partkey AS p, p_name AS path FROM lineitem JOIN part ON p_partkey = l_partkey)"


def followers(spark, sf):
    """Unrated and badly rated documents as a queue: the longest of a source leads it."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lead = d.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("bundle_lead"))
    queue = d.join(labels.filter("quality = 1"), "doc_id", "left_anti").join(lead, "source").select(F.col("doc_id").alias("id"), "bundle_lead")
    return L.followers(queue)


FOLLOW_SQL = """WITH d AS (SELECT doc_id AS id, first_value(doc_id) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS lead FROM documents),
q AS (SELECT * FROM d WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT id, CASE WHEN lead <> id AND lead IN (SELECT id FROM q) THEN lead END AS follows FROM q"""


def ancestry_names(spark, sf):
    """Customers in nations in regions, as files in archives."""
    r, n, c = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "customer")
    null = F.lit(None).cast("string")
    docs = (r.select(F.col("r_name").alias("id"), null.alias("parent"), F.col("r_name").alias("path"))
            .unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
                F.col("n_name").alias("id"), F.col("r_name").alias("parent"), F.concat_ws("!/", "r_name", "n_name").alias("path")))
            .unionByName(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
                F.col("c_name").alias("id"), F.col("n_name").alias("parent"), F.col("c_name").alias("path"))))
    return L.ancestry(docs)


ANCESTRY_SQL = """SELECT n_name AS id, 0 AS depth, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_name, 0, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_name, 1, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def rank_capabilities(spark, sf):
    c = table(spark, sf, "customer")
    role = F.element_at(F.array(*[F.lit(r) for r in N.RANKS]), F.col("c_nationkey") % 7 + 1)
    now = F.lit("2024-01-01").cast("timestamp")
    live = N.effective_role(role, F.when(F.col("c_acctbal") > 0, "active").otherwise("suspended"), F.lit(None).cast("timestamp"), now)
    return c.select("c_custkey", live.alias("role"), *[N.capabilities(live)[k].alias(k) for k in ("download", "upload", "organize", "verify")])


RANKS_SQL = """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey % 7 ELSE 0 END AS l FROM customer)
SELECT c_custkey, ['none','viewer','reader','contributor','organizer','editor','manager'][l + 1] AS role, l >= 2 AS download, l >= 3 AS upload,
l >= 4 AS organize, l >= 5 AS verify FROM c"""


def needs_work(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = d.join(labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("lang") != "de", 10).alias("classifier_version"), F.when(F.col("n_chars") < 300, "extracted").otherwise("filed").alias("status"),
        F.when(F.col("quality") == 0, "open").alias("review_status"), (F.col("source") == "src1").alias("inherited"), (F.col("toxic") == 0).alias("has_lead"))
    return rows.filter(C.needs_classification(10)).select("doc_id")


NEEDS_SQL = """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'de' OR n_chars < 300 OR coalesce(quality = 0, false)
OR (source = 'src1' AND NOT coalesce(toxic = 0, false))"""


def text_topics(spark, sf):
    """Topics of the language of a text found in its first words."""
    d = table(spark, sf, "documents", heavy=True)
    signals = C.make_signals(d.select("doc_id", F.lit(0).alias("pos"), F.lit("header").alias("source"), F.substring("text", 1, 1500).alias("text")))
    topics = spark.createDataFrame([("en", "t1", "the of"), ("en", "t2", "that"), ("en", "t3", "with the"), ("fr", "t1", "de la"), ("fr", "t9", "que")],
                                   "unit_key string, slug string, name string")
    units = d.select("doc_id", F.col("lang").alias("unit_key"))
    return C.topics(signals, units, topics, {1, 2}).select("doc_id", F.array_join("value", ",").alias("topics"))


def _topics_sql() -> str:
    from quire.plans import sqltext as Q
    return f"""WITH s AS (SELECT doc_id, lang, ' ' || {Q.norm('substr(text, 1, 1500)')} || ' ' AS n FROM documents),
t(u, slug, name) AS (VALUES ('en', 't1', 'the of'), ('en', 't2', 'that'), ('en', 't3', 'with the'), ('fr', 't1', 'de la'), ('fr', 't9', 'que'))
SELECT doc_id, string_agg(slug, ',' ORDER BY slug) AS topics FROM s JOIN t ON u = lang AND contains(n, ' ' || name || ' ') GROUP BY doc_id"""


def review_carry_over(spark, sf):
    """Turns as questions of two versions of a bank: decisions stay with equal texts."""
    t = table(spark, sf, "conversations")
    base = t.select(F.col("conv_id").alias("sha256"), F.col("turn").alias("id"), "role", X.text_digest("text").alias("text_sha256"))
    old = base.select("sha256", (F.col("id") + 100).alias("id"), "text_sha256", F.col("id").alias("ord"), F.when(
        F.col("role") == "user", "rejected").alias("review_status"), F.lit("ana").alias("review_by"))
    return Z.carry_reviews(base.select("sha256", "id", "text_sha256"), old).select("sha256", "id", "review_status")


CARRY_SQL = """WITH b AS (SELECT conv_id AS sha256, turn AS id, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM conversations)
SELECT sha256, id, CASE WHEN EXISTS (SELECT 1 FROM b o WHERE o.sha256 = b.sha256 AND o.n = b.n AND o.role = 'user') THEN 'rejected' END
AS review_status FROM b"""


def bundle_edits(spark, sf):
    """Events as bundle edits on the users' documents."""
    e = table(spark, sf, "events")
    docs = e.select(F.col("user_id").alias("id")).distinct().select(
        "id", F.lit("p").alias("bundle_id"), F.lit("P").alias("bundle_name"), F.lit("heuristic").alias("bundle_method"),
        F.lit(None).cast("long").alias("lead_choice"), F.lit(False).alias("bundle_dismissed"))
    edits = e.filter("event_type in ('click', 'purchase')").select(
        F.col("user_id").alias("id"), F.when(F.col("event_type") == "click", "join").otherwise("separate").alias("action"), F.concat(
            F.lit("m"), (F.col("event_id") % 60)).alias("bundle_id"), F.lit("N").alias("name"), F.lit(None).cast("long").alias("lead_choice"),
        F.col("event_id").alias("seq"))
    return B.edit_bundles(docs, edits).select("id", "bundle_id", "bundle_dismissed")


EDITS_SQL = """WITH l AS (SELECT user_id AS id, event_type AS t, 'm' || (event_id % 60)::VARCHAR AS b FROM events WHERE event_type IN ('click', 'purchase')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
s AS (SELECT *, count(*) FILTER (t = 'click') OVER (PARTITION BY b) AS n FROM l)
SELECT u.id, CASE WHEN t IS NULL THEN 'p' WHEN t = 'click' AND n >= 2 THEN b END AS bundle_id, coalesce(t = 'purchase' OR n < 2, false) AS bundle_dismissed
FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN s USING (id)"""


QUERIES = {
    "manifest_ignored": (manifest_ignored, IGNORED_SQL),
    "format_steps": (format_steps, FORMAT_SQL),
    "change_requests": (change_requests, CHANGES_SQL),
    "quarantine_retry": (quarantine_retry, RETRY_SQL),
    "ref_intake": (ref_intake, REF_SQL),
    "course_removal": (course_removal, COURSES_SQL),
    "catalog_bundle": (catalog_bundle, BUNDLE_SQL),
    "marks_by_page": (marks_by_page, MARKS_SQL),
    "valid_marks": (valid_marks, VALID_SQL),
    "run_report": (run_report, REPORT_SQL),
    "labels_join": (labels_join, LABELS_SQL),
    "evidence_paths": (evidence_paths, EVIDENCE_SQL),
    "followers": (followers, FOLLOW_SQL),
    "ancestry_names": (ancestry_names, ANCESTRY_SQL),
    "rank_capabilities": (rank_capabilities, RANKS_SQL),
    "needs_work": (needs_work, NEEDS_SQL),
    "text_topics": (text_topics, _topics_sql()),
    "review_carry_over": (review_carry_over, CARRY_SQL),
    "bundle_edits": (bundle_edits, EDITS_SQL),
}
