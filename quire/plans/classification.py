"""Queries over weighted evidence: types, roles, units, years, overrides, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import names as N
from quire.operators import classify as C
from quire.plans import sqltext as Q
from quire.session import durable, table

# Vocabulary of the queries: words that the texts of the library use.
TYPES = [
    {"slug": "notes", "keywords": ["the of", "of the", "that", "the"],
     "patterns": ["\\bthan[a-z]* the\\b"]},
    {"slug": "sheets", "role": "statement", "keywords": ["anea eriner thanea", "anea eriner", "to"]},
    {"slug": "solved-sheets", "role": "solution",
     "keywords": ["anea eriner thanea", "anea eriner", "to"]},
    {"slug": "papers", "is_assessment": True, "keywords": ["de la", "la de", "que", "en"],
     "excluded_by": ["src 1", "src 11"]},
    {"slug": "books", "keywords": ["der", "und der", "die"], "extensions": ["src2"]},
    {"slug": "others", "is_fallback": True},
]
ROLES = [{"slug": "statement", "keywords": ["is", "en"], "patterns": ["^the\\b"]},
         {"slug": "solution", "keywords": ["with", "to the", "avec"]}]
ASSESSMENTS = [{"slug": "test", "keywords": ["que", "les"]}, {"slug": "exam", "keywords": ["de"]}]
SEASONS = [{"slug": "normal", "keywords": ["est"]}, {"slug": "resit", "keywords": ["une", "pour"]}]
UNITS = [
    ("x/first", "TH 1", "RE", "The Of", ["in onbleea"], ["attion", "thanedble"], ["Anea Eriner"]),
    ("x/second", None, "EN", "De La", ["la que"], ["elle", "aux", "eau"], []),
    ("x/third", None, "ER", "Und Der", ["der die"], ["sch", "ung", "und"], []),
    ("x/fourth", "QU 9", "DE", "El De", ["de los"], ["los", "las", "del"], ["Que La"]),
]
UNIT_TYPE = ("key string, code string, acronym string, name string, aliases array<string>, "
             "keywords array<string>, lecturers array<string>")


def text_signals(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents", heavy=True)
    parts = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("filename").alias("source"),
                 F.col("source").alias("text")),
        F.struct(F.lit(1).alias("pos"), F.lit("header").alias("source"),
                 F.substring("text", 1, C.HEADER_CHARS).alias("text")),
        F.struct(F.lit(2).alias("pos"), F.lit("body").alias("source"),
                 F.substr("text", F.lit(C.HEADER_CHARS + 1)).alias("text")))).alias("p"))
    return C.make_signals(parts.select("doc_id", "p.*"), dates=False)


_SIGNALS = f"""parts AS (
  SELECT doc_id, 0 AS pos, 'filename' AS source, 1.0::DOUBLE AS w, source AS t FROM documents
  UNION ALL SELECT doc_id, 1, 'header', 1.0::DOUBLE, substr(text, 1, 1500) FROM documents
  UNION ALL SELECT doc_id, 2, 'body', 0.35::DOUBLE, substr(text, 1501) FROM documents),
sig AS (SELECT * FROM (SELECT *, {Q.norm('t')} AS n FROM parts) WHERE n <> '')"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")"
                     for r in rows)


def _scores(name: str, terms: list[dict], signals: str = "sig") -> str:
    """CTEs that end in `<name>(doc_id, value, score)`."""
    words = [(t["slug"], k) for t in terms for k in t.get("keywords", [])]
    patterns = [(t["slug"], p) for t in terms for p in t.get("patterns", [])] or [("-", "^$x")]
    return f"""
{name}_kw(value, phrase) AS (VALUES {_values(words)}),
{name}_pt(value, pattern) AS (VALUES {_values(patterns)}),
{name}_hit AS (SELECT doc_id, pos, w, value, phrase FROM {signals}, {name}_kw
  WHERE contains(' ' || n || ' ', ' ' || phrase || ' ')),
{name}_long AS (SELECT * FROM {name}_hit a WHERE NOT EXISTS (SELECT 1 FROM {name}_hit b
  WHERE a.doc_id = b.doc_id AND a.pos = b.pos AND a.value = b.value AND a.phrase <> b.phrase
    AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' '))),
{name}_pts AS (
  SELECT doc_id, pos, w, value, 1 + 0.5 * (len(string_split(phrase, ' ')) - 1) AS p FROM {name}_long
  UNION ALL SELECT doc_id, pos, w, value, 1.0 FROM {signals}, {name}_pt
  WHERE regexp_matches(n, pattern)),
{name} AS (SELECT doc_id, value, sum(pw) AS score FROM (
  SELECT doc_id, pos, value, least(sum(p), 2.0)::DOUBLE * any_value(w) AS pw FROM {name}_pts
  GROUP BY doc_id, pos, value) GROUP BY doc_id, value)"""


def term_scores(spark, sf):
    scores = C.score_terms(text_signals(spark, sf), C.Vocabulary(spark, TYPES))
    return scores.select("doc_id", "value", F.round("score", 6).alias("score"),
                         F.size("reasons").alias("signals"))


TERM_SCORES_SQL = f"""WITH {_SIGNALS}, {_scores('sc', TYPES)}
SELECT doc_id, value, round(score, 6) AS score,
  (SELECT count(DISTINCT pos)::INT FROM sc_pts p WHERE p.doc_id = sc.doc_id AND p.value = sc.value)
  AS signals FROM sc"""


def classify_type(spark, sf):
    vocab = C.Vocabulary(spark, TYPES)
    slugs = {t["slug"] for t in TYPES if vocab.family[t["slug"]] == t["slug"]
             and not t.get("is_fallback")}
    field = C.to_field(C.score_terms(text_signals(spark, sf), vocab, slugs))
    return field.select("doc_id", "value", "confidence", F.to_json("alternatives").alias(
        "alternatives"))


_FAMILY = [t for t in TYPES if t["slug"] not in ("solved-sheets", "others")]
_RANK = """r AS (SELECT doc_id, value, score,
  row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, value) AS k,
  lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, value) AS second,
  sum(score) OVER (PARTITION BY doc_id) AS total FROM {src} WHERE score > 0)"""
CLASSIFY_TYPE_SQL = f"""WITH {_SIGNALS}, {_scores('sc', _FAMILY)}, {_RANK.format(src='sc')},
alt AS (SELECT doc_id, '[' || string_agg('{{"value":"' || value || '","confidence":' ||
  round(score / (total + 0.6), 3)::VARCHAR || '}}', ',' ORDER BY k) || ']' AS alternatives
  FROM r WHERE k BETWEEN 2 AND 4 GROUP BY doc_id)
SELECT r.doc_id, value, round(score / (score + coalesce(second, 0) + 0.6), 3) AS confidence,
  coalesce(alternatives, '[]') AS alternatives
FROM r LEFT JOIN alt ON alt.doc_id = r.doc_id WHERE k = 1"""


def roles(spark, sf):
    return C.role(text_signals(spark, sf), C.Vocabulary(spark, ROLES)).select(
        "doc_id", "role", "confidence", F.round("solution_score", 6).alias("solution_score"))


_ROLE_SIG = """rsig AS (SELECT doc_id, pos, w, CASE WHEN source = 'header' THEN
  array_to_string(string_split(n, ' ')[1:40], ' ') ELSE n END AS n FROM sig WHERE source <> 'body')"""
_ROLE = f"""{_ROLE_SIG}, {_scores('rs', ROLES, 'rsig')},
rb AS (SELECT doc_id, coalesce(sum(score) FILTER (value = 'solution'), 0) AS sol,
  coalesce(sum(score) FILTER (value = 'statement'), 0) AS st FROM rs GROUP BY doc_id),
ro AS (SELECT doc_id, sol, CASE WHEN sol > 0 AND sol >= st THEN 'solution'
         WHEN st > 0 THEN 'statement' END AS role,
  CASE WHEN sol > 0 AND sol >= st THEN round(sol / (sol + st + 0.3), 3)
       WHEN st > 0 THEN greatest(0.9, round(st / (sol + st + 0.3), 3)) END AS confidence FROM rb)"""
ROLES_SQL = f"""WITH {_SIGNALS}, {_ROLE}
SELECT doc_id, role, confidence::DOUBLE AS confidence, round(sol, 6) AS solution_score FROM ro"""


def document_types(spark, sf):
    signals = durable(text_signals(spark, sf), "signals")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.lit("file").alias("kind"), F.col("source").alias("ext"),
        F.col("lang").alias("producer"))
    voc = lambda t: C.Vocabulary(spark, t)
    role = C.role(signals, voc(ROLES))
    types = C.document_type(docs, signals, role, voc(TYPES), voc(ASSESSMENTS), voc(SEASONS))
    return types.select("doc_id", "value", "confidence",
                        F.to_json("alternatives").alias("alternatives"))


DOCUMENT_TYPES_SQL = f"""WITH {_SIGNALS}, {_ROLE}, {_scores('sc', _FAMILY)},
{_scores('az', ASSESSMENTS)}, {_scores('se', SEASONS)},
ev AS (SELECT doc_id, sum(m) AS e FROM (SELECT doc_id, max(score) AS m FROM az GROUP BY 1
  UNION ALL SELECT doc_id, max(score) FROM se GROUP BY 1) GROUP BY 1),
bo AS (SELECT doc_id, 'papers' AS value, least(e, 4.0) * 0.5 AS score FROM ev
  UNION ALL SELECT doc_id, 'books', 1.5 FROM documents WHERE source = 'src2'
  UNION ALL SELECT doc_id, value, score FROM sc),
al AS (SELECT doc_id, value, sum(score)::DOUBLE AS score FROM bo b WHERE NOT (value = 'papers'
  AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.doc_id AND d.source IN ('src1', 'src11')))
  GROUP BY ALL), {_RANK.format(src='al')},
one AS (SELECT r.*, ro.role, ro.confidence AS rc, coalesce(role, 'statement') AS wanted,
  round(score / (score + coalesce(second, 0) + 0.4), 3) AS fc FROM r LEFT JOIN ro USING (doc_id)),
pk AS (SELECT *, CASE WHEN value = 'sheets' AND wanted = 'solution' THEN 'solved-sheets'
  ELSE value END AS slug FROM one),
alt AS (SELECT doc_id, string_agg('{{"value":"' || slug || '","confidence":' ||
  round(score / (total + 0.4), 3)::DOUBLE::VARCHAR || '}}', ',' ORDER BY k) AS a
  FROM pk WHERE k BETWEEN 2 AND 3 GROUP BY doc_id),
best AS (SELECT pk.doc_id, slug, round(fc * CASE WHEN value = 'sheets' THEN coalesce(rc, 1.0)
    ELSE 1.0 END, 3) AS confidence,
  CASE WHEN value = 'sheets' THEN '{{"value":"' || CASE WHEN slug = 'sheets' THEN 'solved-sheets'
    ELSE 'sheets' END || '","confidence":' || round(fc * (1 - coalesce(rc, 0.9)), 3)::DOUBLE::VARCHAR
    || '}}' END AS sib, a FROM pk LEFT JOIN alt USING (doc_id) WHERE k = 1)
SELECT d.doc_id, coalesce(slug, 'others') AS value, coalesce(confidence, 0)::DOUBLE AS confidence,
  '[' || coalesce(concat_ws(',', sib, a), '') || ']' AS alternatives
FROM documents d LEFT JOIN best USING (doc_id)"""


# --- units ----------------------------------------------------------------------------------------


def _unit_scores(spark, sf):
    # written, so that the planner knows how small they are and the n-grams need no shuffle
    features = durable(C.unit_features(spark.createDataFrame(UNITS, UNIT_TYPE).coalesce(1)), "features")
    scores = durable(C.score_units(text_signals(spark, sf), features, {1, 2}, C.probe_heads(features),
                                   C.acronym_heads(features)), "scores")
    users = spark.createDataFrame(
        [("src0", ["x/course"], []), ("src2", [], [("x/third", None)]), ("src5", [], [("x/second", None)])],
        "login string, enrolled_courses array<string>, "
        "enrolled_units array<struct<unit:string,academic_year:string>>")
    links = spark.createDataFrame([("x/course", "x/first"), ("x/course", "x/fourth")],
                                  "course_key string, unit_key string")
    owners = table(spark, sf, "documents").select("doc_id", F.col("source").alias("owner"))
    boosted = C.boost_enrolled(scores, owners, C.enrolled_units(users, links))
    return C.damp_rivals(boosted)


def classify_unit(spark, sf):
    scores = _unit_scores(spark, sf)
    field = C.cap_unit(C.to_field(scores), scores)
    return field.select("doc_id", "value", "confidence", "capped",
                        F.size("alternatives").alias("rivals"))


def unit_scores(spark, sf):
    return _unit_scores(spark, sf).select("doc_id", "value", F.round("score", 6).alias("score"),
                                          "enrolled", "text_only")


_FEATURES = []
for _key, _code, _acr, _name, _al, _kw, _lec in UNITS:
    _FEATURES += [(_key, k, v.lower(), v) for k, v in (
        ("code", _code), ("acronym", _acr), ("name", _name)) if v]
    _FEATURES += [(_key, "alias", v.lower(), v) for v in _al]
    _FEATURES += [(_key, "keyword", v.lower(), v) for v in _kw]
    _FEATURES += [(_key, "lecturer", v.lower(), v) for v in _lec]
_UNIT = f"""{_SIGNALS},
f(unit, kind, phrase, original) AS (VALUES {_values(_FEATURES)}),
nx AS (SELECT *, string_split(n, ' ') AS ws FROM sig),
occ AS (SELECT doc_id, pos, source, w, t, unit, kind, phrase, original,
    list_filter(range(1, len(ws) - len(string_split(phrase, ' ')) + 2), lambda i:
      ws[i:i + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')) AS spots, ws,
    len(string_split(phrase, ' ')) AS k FROM nx, f
    WHERE contains(' ' || n || ' ', ' ' || phrase || ' ') AND kind <> 'code'),
num(wd, v) AS (VALUES ('i', 1), ('ii', 2), ('iii', 3), ('iv', 4), ('v', 5), ('vi', 6), ('vii', 7),
  ('viii', 8), ('ix', 9), ('x', 10), ('1', 1), ('2', 2), ('3', 3), ('4', 4), ('5', 5), ('6', 6),
  ('7', 7), ('8', 8), ('9', 9)),
pl AS (SELECT o.*, unnest(spots) AS i FROM occ o WHERE kind NOT IN ('keyword', 'lecturer', 'code')),
pn AS (SELECT pl.*, v FROM pl LEFT JOIN num ON wd = ws[i + k] AND
  NOT coalesce(ws[i + k + 1] IN ('o','a','ano','anos','semestre','sem','trimestre','ciclo'), false)),
hit AS (
  SELECT DISTINCT doc_id, pos, source, w, unit, kind, phrase, t, original FROM pn
    WHERE v IS NULL OR v < 2
  UNION SELECT doc_id, pos, source, w, unit, kind, phrase, t, original FROM occ
    WHERE kind IN ('keyword', 'lecturer') AND len(spots) > 0
  UNION SELECT doc_id, pos, source, w, unit, kind, phrase, t, original FROM (
      SELECT nx.*, f.*, unnest(range(1, len(ws) + 1)) AS i FROM nx, f WHERE kind = 'code'
        AND contains(' ' || n || ' ', ' ' || string_split(phrase, ' ')[1])) c
    LEFT JOIN num ON wd = ws[i + 1] AND NOT coalesce(ws[i + 2] IN
      ('o','a','ano','anos','semestre','sem','trimestre','ciclo'), false)
    WHERE (ws[i] = string_split(phrase, ' ')[1] AND v = string_split(phrase, ' ')[2]::INT)
      OR ws[i] = CASE phrase WHEN 'th 1' THEN 'thi' WHEN 'qu 9' THEN 'quix' END),
ok AS (SELECT * FROM hit WHERE kind <> 'acronym' OR (NOT (source = 'body' AND length(phrase) <= 2)
  AND regexp_matches(t, '(^|[^\\p{{L}}])' || original || '([^\\p{{L}}]|$)'))),
pk AS (SELECT doc_id, pos, source, unit, kind, w, CASE kind WHEN 'code' THEN 3.0 WHEN 'acronym' THEN 2.5
  WHEN 'name' THEN 3.0 WHEN 'alias' THEN 2.5 WHEN 'keyword' THEN 0.4 ELSE 0.8 END AS p FROM ok),
us AS (SELECT doc_id, unit AS value, sum(p) AS score, bool_and(source IN ('header', 'body')) AS text_only
  FROM (SELECT doc_id, pos, source, unit, kind, CASE WHEN kind IN ('keyword', 'lecturer')
  THEN least(sum(p), 1.2) ELSE sum(p) END * any_value(w) AS p FROM pk
  GROUP BY doc_id, pos, source, unit, kind) GROUP BY doc_id, unit),
ue AS (SELECT us.doc_id, value, text_only, (source = 'src0' AND value IN ('x/first', 'x/fourth'))
    OR (source = 'src2' AND value = 'x/third') OR (source = 'src5' AND value = 'x/second') AS enrolled,
  score FROM us JOIN documents d ON d.doc_id = us.doc_id),
ub AS (SELECT doc_id, value, text_only, enrolled, score * CASE WHEN enrolled THEN 1.25 ELSE 1.0 END
  AS score FROM ue),
ut AS (SELECT *, first_value(text_only) OVER (PARTITION BY doc_id ORDER BY score DESC, value) AS bt
  FROM ub),
ud AS (SELECT doc_id, value, text_only, enrolled, (score * CASE WHEN text_only AND NOT bt THEN 0.5
  ELSE 1.0 END)::DOUBLE AS score FROM ut)"""
UNIT_SCORES_SQL = f"""WITH {_UNIT} SELECT doc_id, value, round(score, 6) AS score, enrolled, text_only
FROM ud"""
CLASSIFY_UNIT_SQL = f"""WITH {_UNIT}, {_RANK.format(src='ud')},
b AS (SELECT doc_id, value, round(score / (score + coalesce(second, 0) + 0.6), 3) AS c,
  (SELECT count(*) FROM r x WHERE x.doc_id = r.doc_id AND x.k BETWEEN 2 AND 4)::INT AS rivals
  FROM r WHERE k = 1)
SELECT b.doc_id, b.value, CASE WHEN text_only AND c > 0.6 THEN 0.6 ELSE c END AS confidence,
  text_only AND c > 0.6 AS capped, rivals FROM b JOIN ud ON ud.doc_id = b.doc_id AND ud.value = b.value"""


# --- years ----------------------------------------------------------------------------------------


def academic_year(spark, sf):
    """Orders as papers: the file name holds the order date, the header a year in words."""
    orders = table(spark, sf, "orders", heavy=True)
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    months = F.array(*[F.lit(x) for x in C.MONTHS])
    header = (F.when(F.col("o_orderpriority") == "1-URGENT",
                     F.concat(F.lit("Ano Lectivo "), y.cast("string"), F.lit("/"), (y + 1).cast("string")))
              .when(F.col("o_orderpriority") == "2-HIGH", F.concat_ws(
                  " de ", d.cast("string"), F.element_at(months, m), y.cast("string")))
              .otherwise(F.concat(F.lit("prova "), y.cast("string"))))
    parts = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("filename").alias("source"),
                 F.date_format("o_orderdate", "dd-MM-yyyy").alias("text")),
        F.struct(F.lit(1).alias("pos"), F.lit("header").alias("source"), header.alias("text"))))
        .alias("p")).select("doc_id", "p.*")
    field = C.to_field(C.academic_years(C.make_signals(parts)))
    return field.select("doc_id", "value", "confidence")


ACADEMIC_YEAR_SQL = """
WITH o AS (SELECT o_orderkey AS doc_id, o_orderpriority AS p, year(o_orderdate) AS y,
  CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS s
  FROM orders),
pts AS (SELECT doc_id, s AS y, 1.5 AS p FROM o
  UNION ALL SELECT doc_id, y, 3.0 FROM o WHERE p = '1-URGENT'
  UNION ALL SELECT doc_id, s, 1.5 FROM o WHERE p = '2-HIGH'
  UNION ALL SELECT doc_id, y, 0.4 FROM o WHERE p NOT IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT doc_id, y - 1, 0.4 FROM o WHERE p NOT IN ('1-URGENT', '2-HIGH')),
sc AS (SELECT doc_id, y::VARCHAR || '-' || (y + 1)::VARCHAR AS value, sum(p)::DOUBLE AS score
  FROM pts GROUP BY ALL), """ + _RANK.format(src="sc") + """
SELECT doc_id, value, round(score / (score + coalesce(second, 0) + 0.6), 3) AS confidence
FROM r WHERE k = 1"""


def event_academic_year(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy(N.academic_year(F.col("ts")).alias("academic_year"), "event_type").agg(
        F.count("*").alias("n"), F.first(F.array_join(N.recent_years(F.lit("2025-10-01").cast(
            "date"), 3), ",")).alias("recent"))


EVENT_YEAR_SQL = """SELECT CASE WHEN month(ts) >= 9 THEN year(ts)::VARCHAR || '-' || (year(ts) + 1)::VARCHAR
  ELSE (year(ts) - 1)::VARCHAR || '-' || year(ts)::VARCHAR END AS academic_year, event_type,
  count(*) AS n, '2025-2026,2024-2025,2023-2024' AS recent FROM events GROUP BY ALL"""


# --- overrides and decisions ----------------------------------------------------------------------


def _fields(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit("unit").alias("field"), F.col("lang").alias("value"),
                 F.round(F.col("n_chars") / (F.col("n_chars") + 500), 3).alias("confidence"),
                 F.lit("heuristic").alias("method")),
        F.struct(F.lit("document_type").alias("field"), F.col("source").alias("value"),
                 F.round(F.lit(500) / (F.col("n_chars") + 500), 3).alias("confidence"),
                 F.lit("heuristic").alias("method")))).alias("f")).select("doc_id", "f.*")


def _proposals(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels")
    return labels.select("doc_id", F.explode(F.array(
        F.struct(F.lit("unit").alias("field"),
                 F.when(F.col("quality") == 1, "en").otherwise("xx").alias("value"),
                 F.lit(0.8).alias("confidence"), F.lit("ai:model").alias("method")),
        F.struct(F.lit("document_type").alias("field"), F.lit("src0").alias("value"),
                 (F.lit(1.0) + F.col("toxic")).alias("confidence"), F.lit("user").alias("method")),
        F.struct(F.lit("academic_year").alias("field"),
                 F.when(F.col("quality") == 1, "2023-2024").otherwise("2023-2025").alias("value"),
                 F.lit(0.9).alias("confidence"), F.lit("ai:model").alias("method")))).alias("f")
    ).select("doc_id", "f.*")


def user_overrides(spark, sf):
    docs = table(spark, sf, "documents")
    known = {"unit": docs.select(F.col("lang").alias("value")).distinct()}
    accepted, _ = C.overlay(_fields(spark, sf), _proposals(spark, sf), known)
    return accepted


def override_rejects(spark, sf):
    docs = table(spark, sf, "documents")
    known = {"unit": docs.select(F.col("lang").alias("value")).distinct()}
    return C.overlay(_fields(spark, sf), _proposals(spark, sf), known)[1].select(
        "doc_id", "field", "value", "method")


_OVERRIDE = """f AS (
  SELECT doc_id, 'unit' AS field, lang AS value, round(n_chars / (n_chars + 500), 3) AS confidence,
    'heuristic' AS method FROM documents
  UNION ALL SELECT doc_id, 'document_type', source, round(500 / (n_chars + 500), 3), 'heuristic'
    FROM documents),
p AS (
  SELECT doc_id, 'unit' AS field, CASE WHEN quality = 1 THEN 'en' ELSE 'xx' END AS value,
    0.8::DOUBLE AS confidence, 'ai:model' AS method, quality = 1 AS ok FROM labels
  UNION ALL SELECT doc_id, 'document_type', 'src0', 1.0 + toxic, 'user', toxic = 0 FROM labels
  UNION ALL SELECT doc_id, 'academic_year', CASE WHEN quality = 1 THEN '2023-2024' ELSE '2023-2025' END,
    0.9, 'ai:model', quality = 1 FROM labels)"""
USER_OVERRIDES_SQL = f"""WITH {_OVERRIDE},
a AS (SELECT *, 0 AS l FROM f UNION ALL SELECT doc_id, field, value, confidence, method,
  CASE WHEN method = 'user' THEN 2 ELSE 1 END FROM p WHERE ok)
SELECT doc_id, field, value, confidence, method FROM a
QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY l DESC) = 1"""
OVERRIDE_REJECTS_SQL = f"WITH {_OVERRIDE} SELECT doc_id, field, value, method FROM p WHERE NOT ok"


def _classified(spark, sf) -> DataFrame:
    """Documents with their classification struct: unit and type from the text, years from labels."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    field = lambda v, c, m: F.struct(v.alias("value"), c.cast("double").alias("confidence"),
                                     m.alias("method"))
    user = F.when(F.col("quality") == 1, "user").otherwise("heuristic")
    unit_conf = F.round(F.col("n_chars") / (F.col("n_chars") + 500), 3)
    return (docs.join(labels, "doc_id", "left").select(
        "doc_id", F.lit("file").alias("kind"),
        F.when(F.col("toxic") == 1, "extracted").when(F.col("quality") == 0, "filed")
        .otherwise("classified").alias("status"),
        F.lit(None).cast("long").alias("duplicate_of"),
        F.when(F.col("quality").isNotNull(), "open").alias("review_status"),
        (F.col("n_chars") < 50).alias("extraction_failed"),
        (F.col("lang") == "fr").alias("is_assessment"),
        F.struct(
            field(F.col("lang"), unit_conf, user).alias("unit"),
            field(F.when(F.col("n_chars") > 300, F.col("source")), F.lit(0.9), user)
            .alias("document_type"),
            field(F.when(F.col("toxic").isNotNull(), F.lit("2023-2024")), F.lit(0.8), user)
            .alias("academic_year"),
            field(F.lit("test"), F.lit(0.65), F.lit("heuristic")).alias("assessment_type"))
        .alias("classification")))


def weak_fields(spark, sf):
    docs = _classified(spark, sf)
    return docs.select("doc_id", F.array_join(C.weak_fields(F.col("is_assessment")), ",")
                       .alias("weak"),
                       C.document_confidence(F.col("is_assessment")).alias("confidence"))


def decisions(spark, sf):
    out = C.decide(_classified(spark, sf), F.col("is_assessment"))
    return out.select("doc_id", "status", "review_status",
                      F.array_join("review_reasons", ",").alias("reasons"))


_CLASSIFIED = """c AS (SELECT doc_id, lang, n_chars, quality, toxic, lang = 'fr' AS az,
  coalesce(quality = 1, false) AS u, round(n_chars / (n_chars + 500), 3) AS uc,
  CASE WHEN n_chars > 300 THEN source END AS dt, toxic IS NOT NULL AS hy,
  CASE WHEN toxic = 1 THEN 'extracted' WHEN quality = 0 THEN 'filed' ELSE 'classified' END AS st
  FROM documents LEFT JOIN labels USING (doc_id)),
w AS (SELECT *, list_filter([
  CASE WHEN NOT u AND uc < 0.7 THEN 'unit' END, CASE WHEN dt IS NULL THEN 'document_type' END,
  CASE WHEN az AND NOT hy THEN 'academic_year' END,
  CASE WHEN az THEN 'assessment_type' END], lambda x: x IS NOT NULL) AS weak FROM c)"""
WEAK_SQL = f"""WITH {_CLASSIFIED} SELECT doc_id, array_to_string(weak, ',') AS weak,
  list_min([CASE WHEN u THEN 1.0 ELSE uc END, CASE WHEN u THEN 1.0 ELSE 0.9 END,
    CASE WHEN az THEN (CASE WHEN u THEN 1.0 ELSE 0.8 END) END, CASE WHEN az THEN 0.65 END])::DOUBLE
  AS confidence FROM w"""
DECISIONS_SQL = f"""WITH {_CLASSIFIED},
r AS (SELECT *, list_concat(CASE WHEN n_chars < 50 THEN ['extraction.failed'] ELSE [] END,
  CASE WHEN st <> 'extracted' THEN list_transform(weak, lambda x: CASE WHEN
    (x = 'document_type') OR (x = 'academic_year') THEN 'review.missing:' || x
    ELSE 'review.low_confidence:' || x END) ELSE [] END) AS rs FROM w)
SELECT doc_id,
  CASE WHEN st = 'extracted' THEN 'extracted' WHEN len(rs) > 0 THEN 'classified'
       WHEN u THEN 'reviewed' ELSE 'filed' END AS status,
  CASE WHEN len(rs) > 0 THEN 'open' WHEN st = 'extracted' THEN
         CASE WHEN quality IS NOT NULL THEN 'open' END
       WHEN quality IS NOT NULL THEN 'resolved' END AS review_status,
  array_to_string(rs, ',') AS reasons FROM r"""


QUERIES = {
    "term_scores": (term_scores, TERM_SCORES_SQL),
    "classify_type": (classify_type, CLASSIFY_TYPE_SQL),
    "classify_role": (roles, ROLES_SQL),
    "document_types": (document_types, DOCUMENT_TYPES_SQL),
    "unit_scores": (unit_scores, UNIT_SCORES_SQL),
    "classify_unit": (classify_unit, CLASSIFY_UNIT_SQL),
    "academic_year": (academic_year, ACADEMIC_YEAR_SQL),
    "event_academic_year": (event_academic_year, EVENT_YEAR_SQL),
    "user_overrides": (user_overrides, USER_OVERRIDES_SQL),
    "override_rejects": (override_rejects, OVERRIDE_REJECTS_SQL),
    "weak_fields": (weak_fields, WEAK_SQL),
    "decisions": (decisions, DECISIONS_SQL),
}
