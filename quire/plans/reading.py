"""Queries over what readers see: proposals, questions, pages, orders, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators import classify as C, library as L, questions as Z
from quire.plans.exams import _BANK, still_in_file
from quire.plans.shelves import _INDEX, index
from quire.session import number_within, table
from quire.sources import deposit as S


def open_proposals(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    return L.proposals(o).select("id")


OPEN_SQL = "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'"


def _turns(spark, sf):
    return table(spark, sf, "conversations").withColumn("sha256", F.col("conv_id").cast("string"))


def questions_shown(spark, sf):
    """Visible and rejected questions of every second paper, and without the rejected ones."""
    state = F.element_at(F.array(*[F.lit(s) for s in ("visible", "rejected", "missing")]), (F.col("turn") % 3 + 1).cast("int"))
    bank = _turns(spark, sf).select("sha256", F.col("turn").alias("ord"), state.alias("status"))
    asked = _turns(spark, sf).filter("conv_id % 2 = 0").select("sha256").distinct()
    both = [L.visible_questions(bank, asked, r).select("sha256", "ord", F.lit(r).alias("with_rejected")) for r in (True, False)]
    return both[0].unionByName(both[1])


SHOWN_SQL = """SELECT conv_id::VARCHAR AS sha256, turn AS ord, true AS with_rejected FROM conversations WHERE conv_id % 2 = 0 AND turn % 3 < 2
UNION ALL SELECT conv_id::VARCHAR, turn, false FROM conversations WHERE conv_id % 2 = 0 AND turn % 3 = 0"""


def index_figures(spark, sf):
    """Metadata of an index as one row, and the version among them."""
    n = table(spark, sf, "nation")
    meta = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")).union(
        n.agg(F.max("n_nationkey")).select(F.lit("schema_version"), F.col("max(n_nationkey)").cast("string")))
    text = F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return L.index_metadata(meta).select(text.alias("meta")).crossJoin(L.schema_version(meta))  # one row each


FIGURES_SQL = """WITH m AS (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation UNION ALL SELECT 'schema_version', max(n_nationkey)::VARCHAR FROM nation)
SELECT string_agg(key || '=' || value, ';' ORDER BY key) AS meta, max(value::INT) FILTER (key = 'schema_version') AS version FROM m"""


def sharing_of_owner(spark, sf):
    """The choices of one customer among all, by kind."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("login"), F.create_map(
        F.lit("exam"), F.when(F.col("c_nationkey") > 9, "public").otherwise("private"), F.col("c_mktsegment"), F.lit("link")).alias("sharing_types"))
    return L.sharing_of(c, "7")


SHARING_SQL = """SELECT 'exam' AS key, CASE WHEN c_nationkey > 9 THEN 'public' ELSE 'private' END AS visibility FROM customer WHERE c_custkey = 7
UNION ALL SELECT c_mktsegment, 'link' FROM customer WHERE c_custkey = 7"""


def flagged_types(spark, sf):
    o = table(spark, sf, "orders")
    code = lambda c: F.struct(c.alias("code"))
    reasons = F.array(code(F.lit("type.weak")), code(F.when(F.col("o_orderpriority") == "1-URGENT", "type.to_confirm").otherwise("unit.body")))
    return o.select("o_orderkey", L.type_flagged(reasons).alias("flagged"))


FLAGGED_SQL = "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS flagged FROM orders"


def text_pages(spark, sf):
    """The second to fourth page of each file; pages that are blank don't count."""
    pages = _turns(spark, sf).select("sha256", F.col("turn").alias("page"), F.when(F.col("turn") % 4 == 3, " \n\t").otherwise(F.col("text")).alias("text"))
    return L.without_blank(L.page_range(pages, 1, 3)).select("sha256", "page", F.length("text").alias("chars"))


PAGES_SQL = "SELECT conv_id::VARCHAR AS sha256, turn AS page, length(text)::INT AS chars FROM conversations WHERE turn BETWEEN 1 AND 2 AND trim(text, ' ' || chr(10)) <> ''"


def quota_used(spark, sf):
    blobs = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("n_chars").alias("size"))
    return L.used_bytes(blobs, 1_000_000)


USED_SQL = "SELECT sum(size)::BIGINT AS used, sum(size) > 1000000 AS over FROM (SELECT min(n_chars) AS size FROM documents GROUP BY sha256(text))"


def papers_to_verify(spark, sf):
    """The question bank of conversations against the library: documents named by their conversation."""
    bank = still_in_file(spark, sf).withColumn("review_status", F.when(F.col("id") % 2 == 1, "confirmed"))
    idx = index(spark, sf).withColumn("sha256", (F.col("id") % 150).cast("string"))
    return L.questions_to_verify(bank.withColumn("sha256", F.col("sha256").cast("string")), idx)


TO_VERIFY_SQL = f"""WITH q AS (WITH {_BANK} SELECT conv_id AS sha256, sum((status = 'visible' AND turn % 2 = 0)::INT)::BIGINT AS unreviewed FROM s GROUP BY 1),
i AS (WITH {_INDEX} SELECT id, id % 150 AS sha256 FROM live), f AS (SELECT sha256, min(id) AS id FROM i GROUP BY 1)
SELECT id, sha256::VARCHAR AS sha256, unreviewed FROM q JOIN f USING (sha256) WHERE unreviewed > 0"""


def shelf_order(spark, sf):
    """Papers and sheets of a unit in the order that a shelf shows them."""
    d = table(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "teste").when(F.col("doc_id") % 3 == 1, "exame")
    docs = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("unit"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("200"), (F.col("doc_id") % 7).cast("string")))
                    .alias("academic_year"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("2020-01-1"), (F.col("doc_id") % 10).cast("string"))).alias("date"),
                    kind.alias("assessment_type"), F.when(kind.isNotNull(), F.col("doc_id") % 5).alias("assessment_number"),
                    F.concat(F.coalesce(kind, F.lit("ficha")), F.lit(" "), (F.col("n_chars") % 120).cast("string")).alias("title"), F.lit("x").alias("display_name"))
    ordered = L.shelf_order(docs).withColumn("at", F.monotonically_increasing_id())
    return number_within(ordered.select("id", "unit", "at"), ["unit"], "at", "rank").select("id", "unit", "rank")


SHELF_SQL = """WITH d AS (SELECT doc_id AS id, lang AS unit, CASE WHEN doc_id % 7 > 0 THEN '200' || (doc_id % 7) END AS y,
  CASE WHEN doc_id % 4 = 0 THEN '2020-01-1' || (doc_id % 10) END AS date, CASE doc_id % 3 WHEN 0 THEN 'teste' WHEN 1 THEN 'exame' END AS kind, doc_id % 5 AS n, n_chars % 120 AS t
  FROM documents),
k AS (SELECT *, coalesce(kind, 'ficha') AS word, CASE WHEN kind IS NOT NULL THEN min(t) OVER (PARTITION BY y, date, kind) ELSE t END AS head FROM d)
SELECT id, unit, row_number() OVER (PARTITION BY unit ORDER BY y DESC NULLS LAST, date NULLS LAST, word, head, kind NULLS LAST,
  CASE WHEN kind IS NOT NULL THEN n END, word, t, id) AS rank FROM k"""


def layout_parts(spark, sf):
    """Year, semester and unit in the folders of a path, of six kinds of paths."""
    d = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % 6)
    path = (F.when(F.col("k") == 0, F.concat(F.lit("X/2020_2021/1º Semestre/"), "lang", F.lit("/"), "source", F.lit("/a.pdf")))
            .when(F.col("k") == 1, F.concat(F.lit("2019-20/"), "lang", F.lit("/a.pdf"))).when(F.col("k") == 2, F.concat(F.lit("a.zip!/2018.2019/2 semestre/"), "lang", F.lit("/b/c/d.txt")))
            .when(F.col("k") == 3, F.concat(F.lit("2020_2022/"), "lang", F.lit("/a.pdf"))).when(F.col("k") == 4, F.concat("lang", F.lit("/a.pdf"))).otherwise("2020_2021/a.pdf"))
    p = N.parse_layout(path)
    return d.select("doc_id", p["academic_year"].alias("year"), p["semester"].alias("semester"), p["unit"].alias("unit"),
                    p["unit_folder"].alias("folder"), F.array_join(p["rest"], "/").alias("rest"))


LAYOUT_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '2020-2021' WHEN 1 THEN '2019-2020' WHEN 2 THEN '2018-2019' END AS year,
 CASE doc_id % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 END AS semester, CASE WHEN doc_id % 6 < 3 THEN lang END AS unit,
 CASE doc_id % 6 WHEN 0 THEN 'X/2020_2021/1º Semestre/' || lang WHEN 1 THEN '2019-20/' || lang WHEN 2 THEN 'a.zip/2018.2019/2 semestre/' || lang END AS folder,
 CASE doc_id % 6 WHEN 0 THEN source || '/a.pdf' WHEN 1 THEN 'a.pdf' WHEN 2 THEN 'b/c/d.txt' END AS rest FROM documents"""


def file_places(spark, sf):
    """Where files stand and are put: folder, its name, the bundle, the original, a member, the kind of source."""
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("/pack.zip!/"), "source", F.lit(".txt"))).when(
        F.col("doc_id") % 3 == 1, F.concat("source", F.lit("/"), "lang", F.lit("/t.txt"))).otherwise("t.txt")
    sha, folder = F.sha2("text", 256), N.folder_of(path)
    batch = F.when(F.col("doc_id") % 2 == 0, "20250101T101010Z-abc9").otherwise("main")
    return d.select("doc_id", folder.alias("folder"), N.folder_name(folder).alias("name"), N.bundle_id("source", F.coalesce(folder, F.lit(""))).alias("bundle"),
                    N.original_path(sha, F.lit("txt")).alias("original"), N.member_name(F.lit("lead.v1.pdf"), path, sha).alias("member"),
                    N.source_kind(batch).alias("kind"), N.full_path(F.when(F.col("doc_id") % 2 == 0, batch), path).alias("full"))


PLACES_SQL = """WITH d AS (SELECT *, doc_id % 3 AS k, sha256(text) AS sha, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source || '/' || lang END AS folder,
  CASE doc_id % 3 WHEN 0 THEN lang || '/pack.zip!/' || source || '.txt' WHEN 1 THEN source || '/' || lang || '/t.txt' ELSE 't.txt' END AS path FROM documents)
SELECT doc_id, folder, lang AS name, 'pasta-' || substr(sha256(source || chr(0) || coalesce(folder, '')), 1, 12) AS bundle,
 'originais/' || substr(sha, 1, 2) || '/' || sha || '.txt' AS original, 'lead.v1/' || CASE k WHEN 0 THEN source || '.txt' ELSE 't.txt' END AS member,
 CASE WHEN doc_id % 2 = 0 THEN 'upload' ELSE 'git' END AS kind, CASE WHEN doc_id % 2 = 0 THEN '20250101T101010Z-abc9/' ELSE '' END || path AS full
FROM d""".replace("lang AS name", "CASE WHEN k < 2 THEN lang END AS name")


def decoded_names(spark, sf):
    n = F.concat(F.lit("Évora "), "n_name")
    content = F.when(F.col("n_nationkey") % 2 == 0, F.encode(n, "UTF-8")).otherwise(F.encode(n, "ISO-8859-1"))
    return table(spark, sf, "nation").select("n_nationkey", N.decode(content).alias("name"))


DECODED_SQL = "SELECT n_nationkey, 'Évora ' || n_name AS name FROM nation"


def reason_lines(spark, sf):
    params = F.create_map(F.lit("who"), F.col("c_name"), F.lit("n"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", N.reason_text(F.lit("{{who}} has {{n}} of {{n}}, {{other}}"), params).alias("line"))


REASONS_SQL = """SELECT c_custkey, c_name || ' has ' || x || ' of ' || x || ', {{other}}' AS line
FROM (SELECT *, CASE WHEN c_nationkey > 3 THEN c_nationkey::VARCHAR ELSE '' END AS x FROM customer)"""


def native_and_reviewed(spark, sf):
    """Questions on native pages with the last valid decision on each."""
    t = _turns(spark, sf)
    meta = t.select("sha256", F.col("turn").alias("page"), F.when(F.col("turn") % 3 == 2, "ocr").otherwise("native").alias("method"), (F.col("conv_id") % 5 == 0).alias("needs_transcription"))
    bank = t.select("sha256", F.col("turn").cast("string").alias("label"), F.lit(None).cast("string").alias("review_status"), F.col("turn").alias("page"))
    says = lambda k: F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "rejected", "maybe")]), (F.pmod(F.col("conv_id") + F.col("turn") + k, F.lit(3)) + 1).cast("int"))
    decisions = t.select("sha256", F.col("turn").cast("string").alias("label"), F.explode(F.array(*[F.struct(F.lit(k).alias("at"), says(k).alias("status")) for k in range(2)])).alias("d"))
    decided = Z.review(bank, decisions.select("sha256", "label", "d.status", F.lit("ana").alias("by"), "d.at"))
    return decided.join(Z.native_pages(meta), ["sha256", "page"], "left_semi").select("sha256", "label", "review_status")


REVIEWED_SQL = """WITH t AS (SELECT *, (conv_id + turn) % 3 AS k FROM conversations WHERE turn % 3 <> 2 AND conv_id % 5 <> 0)
SELECT conv_id::VARCHAR AS sha256, turn::VARCHAR AS label, CASE k WHEN 0 THEN 'rejected' WHEN 1 THEN 'rejected' ELSE 'confirmed' END AS review_status FROM t"""


def kept_items(spark, sf):
    """Order lines as files in project folders: a project is one item, its files are none."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("batch"), F.concat_ws("/", F.concat(F.lit("d"), F.col("l_orderkey") % 5), F.col("l_partkey"), F.concat(
        F.lit("f"), F.col("l_linenumber"))).alias("rel"), F.when(F.col("l_returnflag") == "R", "part").otherwise("file").alias("kind")).distinct()
    projects = lines.select("batch", F.substring_index("rel", "/", 1).alias("dir")).filter("dir in ('d1', 'd3')").distinct()
    return S.deposit_items(lines, projects)


KEPT_SQL = """WITH l AS (SELECT DISTINCT l_suppkey AS batch, 'd' || (l_orderkey % 5) AS dir, 'd' || (l_orderkey % 5) || '/' || l_partkey || '/f' || l_linenumber AS rel,
  CASE WHEN l_returnflag = 'R' THEN 'part' ELSE 'file' END AS kind FROM lineitem)
SELECT batch, rel, kind FROM l WHERE kind <> 'part' AND dir NOT IN ('d1', 'd3') UNION ALL SELECT DISTINCT batch, dir, 'code_project' FROM l WHERE dir IN ('d1', 'd3')"""


def extraction_records(spark, sf):
    """Extraction records written as JSON and read again."""
    d = table(spark, sf, "documents")
    page = F.struct(F.lit(1).alias("n"), F.lit("native").alias("method"), F.col("n_chars").cast("int").alias("chars"))
    raw = d.select(F.to_json(F.struct(F.sha2("text", 256).alias("sha256"), F.lit("plain").alias("extractor"), F.lit(2).alias("extractor_version"), F.array(page).alias("pages"),
                                      F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))).alias("value"))
    return S.extraction_metadata(raw).select("sha256", "extractor_version", F.element_at("pages", 1)["chars"].alias("chars"), F.col("metadata")["lang"].alias("lang"), "words")


RECORDS_SQL = "SELECT sha256(text) AS sha256, 2 AS extractor_version, n_chars::INT AS chars, lang, NULL::INT AS words FROM documents"


def document_signals(spark, sf):
    """What the places of a document say of it: file names, an organised folder, other folders, the archive it came
    in, its metadata and its pages."""
    d = table(spark, sf, "documents")
    source = lambda path, batch: F.struct(path.alias("path"), batch.alias("batch"))
    docs = d.select("doc_id", F.array(
        source(F.concat(F.lit("UC/2020_2021/1º Semestre/"), "lang", F.lit("/Testes/teste "), "doc_id", F.lit(".pdf")), F.lit(None).cast("string")),
        source(F.concat(F.lit("Pasta/"), "source", F.lit("/nota.txt")), F.when(F.col("doc_id") % 2 == 0, "20251001T120000Z-abc").otherwise("curso"))).alias("sources"))
    page = lambda n, t: F.struct(F.lit(n).alias("page"), t.alias("text"))
    pages = d.select("doc_id", F.explode(F.array(page(1, F.concat(F.lit("Olá "), "lang")), page(2, F.lit("corpo")))).alias("p")).select("doc_id", "p.*")
    metadata = d.filter("doc_id % 3 = 0").select("doc_id", F.create_map(F.lit("title"), F.lit("Livro"), F.lit("subject"), F.col("lang")).alias("metadata"))
    archives = d.filter("doc_id % 5 = 0").select("doc_id", F.lit(0).alias("depth"), F.lit("pack_a.zip").alias("name"))
    return C.collect_signals(docs, pages, metadata, archives).select("doc_id", "source", "norm")


SIGNALS_SQL = """SELECT doc_id, 'filename' AS source, 'teste ' || doc_id AS norm FROM documents UNION ALL SELECT doc_id, 'filename', 'nota' FROM documents
UNION ALL SELECT doc_id, 'layout', '2020 2021 ' || lang FROM documents UNION ALL SELECT doc_id, 'path', 'testes' FROM documents
UNION ALL SELECT doc_id, 'path', CASE WHEN doc_id % 2 = 1 THEN 'curso ' ELSE '' END || 'pasta src ' || substr(source, 4) FROM documents
UNION ALL SELECT doc_id, 'header', 'ola ' || lang FROM documents UNION ALL SELECT doc_id, 'body', 'corpo' FROM documents
UNION ALL SELECT doc_id, 'metadata', 'livro ' || lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'archive', 'pack a' FROM documents WHERE doc_id % 5 = 0"""


QUERIES = {
    "document_signals": (document_signals, SIGNALS_SQL),
    "open_proposals": (open_proposals, OPEN_SQL),
    "questions_shown": (questions_shown, SHOWN_SQL),
    "index_figures": (index_figures, FIGURES_SQL),
    "sharing_of_owner": (sharing_of_owner, SHARING_SQL),
    "flagged_types": (flagged_types, FLAGGED_SQL),
    "text_pages": (text_pages, PAGES_SQL),
    "quota_used": (quota_used, USED_SQL),
    "papers_to_verify": (papers_to_verify, TO_VERIFY_SQL),
    "shelf_order": (shelf_order, SHELF_SQL),
    "layout_parts": (layout_parts, LAYOUT_SQL),
    "file_places": (file_places, PLACES_SQL),
    "decoded_names": (decoded_names, DECODED_SQL),
    "reason_lines": (reason_lines, REASONS_SQL),
    "native_and_reviewed": (native_and_reviewed, REVIEWED_SQL),
    "kept_items": (kept_items, KEPT_SQL),
    "extraction_records": (extraction_records, RECORDS_SQL),
}
