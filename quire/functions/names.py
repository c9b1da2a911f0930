"""Paths, file names, layouts, identifiers and small rule functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions import text as X


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# File kinds by extension, junk names, mime types beyond the common table.
ARCHIVE_EXTS = ["zip", "rar", "7z", "tar", "tgz", "tar.gz", "tbz2", "tar.bz2", "txz", "tar.xz"]
LEGACY_EXTS = {"doc": "docx", "odt": "docx", "rtf": "docx", "wpd": "docx", "ppt": "pptx",
               "pps": "pptx", "odp": "pptx", "xls": "xlsx", "ods": "xlsx"}
IMAGE_EXTS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp", "heic", "heif"]
TEXT_EXTS = ["txt", "md", "markdown", "tex", "bib", "csv", "tsv", "json", "xml", "yaml", "yml",
             "log", "rst", "org", "srt"]
CODE_EXTS = ["py", "ipynb", "js", "jsx", "ts", "tsx", "java", "kt", "c", "h", "cpp", "hpp", "cc",
             "cs", "go", "rs", "rb", "php", "swift", "m", "r", "jl", "scala", "hs", "sql", "sh",
             "ps1", "bat", "html", "css", "scss", "vue", "svelte", "asm", "s", "vhd", "vhdl", "v",
             "pl", "lua", "dart", "f90", "mat"]
JUNK_NAMES = [".ds_store", "thumbs.db", "desktop.ini", ".gitkeep", ".keep"]
MIME_TYPES = {"pdf": "application/pdf", "txt": "text/plain", "html": "text/html",
              "css": "text/css", "csv": "text/csv", "json": "application/json",
              "xml": "text/xml", "zip": "application/zip", "tar": "application/x-tar",
              "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
              "doc": "application/msword", "md": "text/markdown", "heic": "image/heic",
              "heif": "image/heif", "ipynb": "application/x-ipynb+json",
              "7z": "application/x-7z-compressed", "rar": "application/vnd.rar",
              "tex": "application/x-tex", "yaml": "application/yaml", "yml": "application/yaml",
              "py": "text/x-python"}
SIGNATURES = [("25504446", "pdf"), ("526172211A07", "rar"), ("377ABCAF271C", "7z"),
              ("89504E47", "png"), ("FFD8FF", "jpg"), ("1F8B", "tar.gz"), ("D0CF11E0", "doc"),
              ("504B0304", "zip")]
DOCUMENT_CATEGORIES = ["pdf", "docx", "pptx", "xlsx", "legacy_office"]


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.substring_index(_col(path), "!/", -1), "/", -1)


def is_junk(name: Column | str) -> Column:
    name = _col(name)
    return F.lower(name).isin(JUNK_NAMES) | F.startswith(name, F.lit("._"))


def extension_of(name: Column | str) -> Column:
    low = F.lower(_col(name))
    double = F.regexp_extract(low, "\\.(tar\\.(?:gz|bz2|xz))$", 1)
    single = F.regexp_extract(F.substring_index(low, "/", -1), "^.+\\.([^.]+)$", 1)
    return F.when(double != "", double).otherwise(single)


def detect_extension(content: Column, name: Column | str) -> Column:
    """Extension of the name, or the one its first bytes speak for."""
    named = extension_of(name)
    head = F.hex(F.substring(content, 1, 12))
    sniffed = F.when(F.substring(head, 9, 16).isin("6674797068656963", "6674797068656978",
                                                   "667479706D696631"), "heic")
    for signature, ext in SIGNATURES:
        sniffed = sniffed.when(F.startswith(head, F.lit(signature)), ext)
    return F.when(named == "jpeg", "jpg").when(named != "", named).otherwise(
        sniffed.otherwise(""))


def mime_of(ext: Column | str) -> Column:
    return F.coalesce(lookup(MIME_TYPES, _col(ext)), F.lit("application/octet-stream"))


def category_of(ext: Column | str) -> Column:
    ext = _col(ext)
    return (F.when(ext.isin("pdf", "docx", "pptx", "xlsx"), ext).when(ext == "xlsm", "xlsx")
            .when(ext.isin(list(LEGACY_EXTS)), "legacy_office").when(ext.isin(IMAGE_EXTS), "image")
            .when(ext.isin(ARCHIVE_EXTS), "archive").when(ext == "ipynb", "notebook")
            .when(ext.isin(TEXT_EXTS), "text").when(ext.isin(CODE_EXTS), "code")
            .otherwise("other"))


def full_path(batch: Column | str, path: Column | str) -> Column:
    batch = F.nullif(_col(batch), F.lit(""))
    return F.concat_ws("/", batch, _col(path))


def parse_layout(path: Column | str) -> Column:
    """`…/<YYYY_YYYY>/[<N semestre>/]<unit>/…/<file>` as a struct, or null."""
    parts = F.filter(F.split(F.replace(_col(path), F.lit("!/"), F.lit("/")), "/"),
                     lambda p: p != "")
    year = r"^\s*((?:19|20)\d{2})\s*[_\-./ ]\s*((?:19|20)?\d{2})\s*$"
    term = r"(?i)^\s*([1-4])\s*\.?\s*[ºo°ª]?\s*semestre\s*$"

    def start(p: Column) -> Column:
        first = F.regexp_extract(p, year, 1).try_cast("int")
        second = F.regexp_extract(p, year, 2)
        value = F.when(F.length(second) == 4, second.try_cast("int")).otherwise(
            F.floor(first / 100) * 100 + second.try_cast("int"))
        return F.when(value == first + 1, first)

    years = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 2, start(p)))
    at = F.array_position(F.transform(years, lambda y: y.isNotNull()), F.lit(True)).cast("int")
    semester = F.regexp_extract(F.element_at(parts, at + 1), term, 1).try_cast("int")
    unit = F.when(semester.isNotNull(), at + 2).otherwise(at + 1)
    first = F.element_at(years, at)
    found = F.struct(
        F.concat_ws("-", first.cast("string"), (first + 1).cast("string")).alias("academic_year"),
        semester.alias("semester"), F.trim(F.element_at(parts, unit)).alias("unit"),
        F.array_join(F.slice(parts, F.lit(1), unit), "/").alias("unit_folder"),
        F.slice(parts, unit + 1, F.size(parts)).alias("rest"))
    return F.when(at > 0, F.when(unit < F.size(parts), found))


def folder_of(path: Column | str) -> Column:
    """Folder of a file; near the root of an archive, the folder the archive lies in."""
    path = _col(path)
    inner = F.substring_index(path, "!/", -1)
    nested = F.contains(path, F.lit("!/"))
    shallow = F.regexp_count(inner, F.lit("/")) <= 1
    container = F.substr(path, F.lit(1), F.length(path) - F.length(inner) - 2)
    outer = F.substring_index(container, "!/", -1)
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    has = lambda c: F.contains(c, F.lit("/"))
    return (F.when(nested & shallow, F.when(has(outer), parent(container)))
            .when(has(inner), parent(path)))


def folder_name(folder: Column | str) -> Column:
    name = F.regexp_replace(F.replace(_col(folder), F.lit("!/"), F.lit("/")), "/+$", "")
    return F.regexp_replace(F.substring_index(name, "/", -1),
                            "(?i)\\.(zip|rar|7z|tar\\.gz|tgz|tar)$", "")


def bundle_id(owner: Column | str, folder: Column | str) -> Column:
    digest = F.sha2(F.concat(_col(owner), F.lit("\u0000"), _col(folder)), 256)
    return F.concat(F.lit("pasta-"), F.substring(digest, 1, 12))


def original_stem(first_path: Column, sha256: Column) -> Column:
    stem = F.regexp_replace(base_name(first_path), "\\.[^.]*$", "")
    return F.coalesce(stem, F.substring(sha256, 1, 12))


def display_name(filed_name: Column, first_path: Column, sha256: Column) -> Column:
    return F.coalesce(F.nullif(filed_name, F.lit("")), F.substring_index(first_path, "/", -1),
                      F.substring(sha256, 1, 12))


def filed_name(c: dict[str, Column], first_path: Column, sha256: Column, ext: Column,
               kind: Column) -> Column:
    """`<year>_<description>.<ext>` from the classified values in `c` (year, type, is_assessment,
    assessment_type, number, season, date, variant, role, title)."""
    role = F.when(c["role"] == "solution", "resolucao").otherwise("enunciado")
    assessed = F.concat_ws("-", *[F.when(p.isNotNull() & (p != ""), X.slugify(p)) for p in (
        F.coalesce(c["assessment_type"], c["type"]), c["number"].cast("string"), c["season"],
        c["date"], c["variant"])], role)
    type_slug = F.coalesce(c["type"], F.lit("documento"))
    stem = F.coalesce(c["title"], original_stem(first_path, sha256))
    rest = F.filter(F.split(X.slugify(stem, 50), "-"),
                    lambda p: ~F.array_contains(F.split(type_slug, "-"), p))
    label = F.coalesce(F.nullif(F.array_join(rest, "-"), F.lit("")), F.substring(sha256, 1, 8))
    plain = F.concat_ws("-", X.slugify(type_slug), X.slugify(label))
    description = F.when(F.coalesce(c["is_assessment"], F.lit(False)), assessed).otherwise(plain)
    suffix = F.when(kind == "code_project", "zip").otherwise(F.coalesce(ext, F.lit("")))
    name = F.concat_ws("_", F.coalesce(c["year"], F.lit("sem-ano")), description)
    return F.concat_ws(".", name, F.nullif(suffix, F.lit("")))


def member_name(lead_filed_name: Column, first_path: Column, sha256: Column) -> Column:
    folder = F.regexp_replace(lead_filed_name, "\\.[^.]*$", "")
    return F.concat_ws("/", folder, F.coalesce(base_name(first_path), F.substring(sha256, 1, 12)))


def safe_path(name: Column | str) -> Column:
    """A relative path without empty parts, or null for one that would leave its folder."""
    path = F.replace(_col(name), F.lit("\\"), F.lit("/"))
    bad = path.rlike("^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)|\u0000")
    clean = F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/")
    return F.when(~bad & (clean != ""), clean)


def original_path(sha256: Column, ext: Column) -> Column:
    name = F.concat_ws(".", sha256, F.nullif(ext, F.lit("")))
    return F.concat_ws("/", F.lit("originais"), F.substring(sha256, 1, 2), name)


def source_kind(batch: Column | str) -> Column:
    generated = F.coalesce(_col(batch).rlike("^\\d{8}T\\d{6}Z-[a-z0-9]{3,}$"), F.lit(False))
    return F.when(generated, "upload").otherwise("git")


def time_ordered_id(at: Column, content: Column) -> Column:
    """A version-7 identifier made of a time and a content digest, so that it can be recomputed."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    d = F.sha2(content, 256)
    nibble = F.substr(F.lit("89ab"), F.conv(F.substring(d, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"),
                    F.substring(d, 1, 3), F.lit("-"), nibble, F.substring(d, 5, 3), F.lit("-"),
                    F.substring(d, 8, 12))


def decode(content: Column) -> Column:
    """UTF-8, or Latin-1 for bytes that are no UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")),
                      F.decode(content, "ISO-8859-1"))


# --- academic years, visibility, access -----------------------------------------------------------


def academic_year(date: Column, start_month: int = 9) -> Column:
    start = F.year(F.add_months(date, 1 - start_month))
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def recent_years(date: Column, count: int = 8, start_month: int = 9) -> Column:
    start = F.year(F.add_months(date, 1 - start_month))
    return F.transform(F.sequence(start, start - (count - 1)), lambda y: F.concat_ws(
        "-", y.cast("string"), (y + 1).cast("string")))


def valid_year_label(label: Column) -> Column:
    ok = label.rlike("^\\d{4}-\\d{4}$") & (
        F.substring(label, 6, 4).try_cast("int") == F.substring(label, 1, 4).try_cast("int") + 1)
    return F.coalesce(ok, F.lit(False))


# Fixed values.
VISIBILITY = "^(private|public|link|unit_edition|group:[a-z0-9-]+|user:[A-Za-z0-9-]+)$"


def parse_visibility(value: Column) -> Column:
    """struct(valid, value): aliases resolved; a null value follows the unit."""
    mapped = F.coalesce(lookup({"publico": "public", "público": "public", "privado": "private"},
                               value), value)
    follow = value.isNull() | value.isin("cadeira", "herdar", "inherit")
    return F.struct((follow | mapped.rlike(VISIBILITY)).alias("valid"),
                    F.when(~follow, mapped).alias("value"))


def access_term(until: Column, token_expires: Column) -> Column:
    return F.when(until.isNotNull(), "dated").when(token_expires.isNotNull(), "until_token"
                                                   ).otherwise("permanent")


def access_state(status: Column, until: Column, token_expires: Column, now: Column) -> Column:
    return (F.when(status == "revoked", "revoked").when(token_expires <= now, "token_expired")
            .when(status == "paused", "paused").when(until <= now, "ended").otherwise("active"))


def clamp_until(wanted: Column, token_expires: Column) -> Column:
    return F.struct(F.least(wanted, token_expires).alias("until"),
                    F.coalesce(wanted > token_expires, F.lit(False)).alias("capped"))


# Fixed values.
RANKS = ["none", "viewer", "reader", "contributor", "organizer", "editor", "manager"]
OWNER_ONLY = "^(\\.github/|\\.claude/|originais/)|^acessos\\.yaml$"


def rank_level(role: Column) -> Column:
    return F.greatest(F.array_position(F.array(*[F.lit(r) for r in RANKS]), role) - 1,
                      F.lit(0)).cast("int")


def effective_role(role: Column, status: Column, until: Column, now: Column) -> Column:
    live = (status == "active") & F.coalesce(until >= now, F.lit(True)) & role.isin(RANKS)
    return F.when(F.coalesce(live, F.lit(False)), role).otherwise("none")


def capabilities(role: Column) -> Column:
    level = rank_level(role)
    return F.struct((level >= 2).alias("download"), (level >= 3).alias("upload"),
                    (level >= 4).alias("organize"), (level >= 5).alias("visibility"),
                    (level >= 5).alias("verify"), F.lit(False).alias("configure"))


def path_allowed(role: Column, path: Column, owner: Column, owner_only: str = OWNER_ONLY) -> Column:
    """Whether the role may write the path; `owner_only` is the pattern of paths that no role may."""
    own = F.startswith(path, F.concat(F.lit("deposito/"), owner, F.lit("/")))
    return (F.when(path.rlike(owner_only), F.lit(False)).when(role == "contributor", own)
            .when(role == "organizer", ~path.rlike("^(utilizadores|gerado)/"))
            .otherwise(rank_level(role) >= 5))


# --- readable titles ------------------------------------------------------------------------------


def soften(text: Column) -> Column:
    """Whole words of five capitals or more keep only the first one."""
    word = "(?<![\\p{L}\\d])(?=\\p{Lu}{5,}(?![\\p{L}\\d]))"
    pieces = F.split(text, word)
    return F.array_join(F.transform(pieces, lambda p: F.when(
        p.rlike("^\\p{Lu}{5,}(?![\\p{L}\\d])"),
        F.concat(F.substring(p, 1, 1),
                 F.lower(F.substr(F.regexp_extract(p, "^(\\p{Lu}+)", 1), F.lit(2))),
                 F.regexp_replace(p, "^\\p{Lu}+", ""))).otherwise(p)), "")


def prettify(stem: Column) -> Column:
    value = F.regexp_replace(F.regexp_replace(stem, "\\.[^.]+$", ""), "[_\\-.]+", " ")
    value = F.regexp_replace(value, "(?i)([a-zà-ÿ]{3,})(\\d)", "$1 $2")
    value = F.regexp_replace(value, "(?i)(\\d)([a-zà-ÿ])", "$1 $2")
    soft = soften(X.collapse(value))
    return F.when(soft == "", stem).otherwise(
        F.concat(F.upper(F.substring(soft, 1, 1)), F.substr(soft, F.lit(2))))


def year_label(year: Column) -> Column:
    return F.regexp_replace(year, "-", "/")


def date_label(date: Column) -> Column:
    return F.date_format(date.try_cast("date"), "dd/MM/yyyy")


# Fixed values.
DEGREE = ("(?iu)^\\s*(licenciatura|mestrado(\\s+integrado)?|doutoramento|ctesp|"
          "curso\\s+t[eé]cnico\\s+superior\\s+profissional|p[oó]s-?\\s?gradua[cç][aã]o)\\s+(em|de)\\s+")


def course_title(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, DEGREE, "")), F.lit("")), name)


def degree_of(name: Column) -> Column:
    word = X.normalize(F.regexp_extract(name, DEGREE, 1))
    return (F.when(word == "", F.lit(None).cast("string"))
            .when(F.startswith(word, F.lit("mestrado integrado")), "mestrado-integrado")
            .when(F.startswith(word, F.lit("curso tecnico")) | (word == "ctesp"), "ctesp")
            .when(F.startswith(word, F.lit("pos")), "pos-graduacao")
            .otherwise(F.substring_index(word, " ", 1)))


def natural_key(text: Column) -> Column:
    """Sort key: accents and case do not count, numbers compare by value: the number of their digits
    goes ahead of them."""
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    runs = F.regexp_extract_all(F.lower(X.strip_accents(text)), F.lit("[0-9]+|[^0-9]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.when(
        r.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 6, "0"), digits(r))).otherwise(r)), "")


# --- marks, reasons, notebooks --------------------------------------------------------------------

STROKES = ("array<struct<id:string,kind:string,color:string,width:double,points:array<double>>>")
MARK_KINDS = ["highlight", "underline", "pen"]
MARK_COLORS = ["yellow", "green", "blue", "pink", "red", "ink"]


def valid_strokes(strokes: Column) -> Column:
    def ok(s: Column) -> Column:
        finite = F.forall(s["points"], lambda n: F.coalesce(
            n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), F.lit(False)))
        return F.coalesce(s["id"].isNotNull() & s["kind"].isin(MARK_KINDS)
                          & s["color"].isin(MARK_COLORS) & s["width"].isNotNull()
                          & (F.size(s["points"]) >= 2) & (F.size(s["points"]) % 2 == 0) & finite,
                          F.lit(False))
    return F.filter(strokes, ok)


def parse_marks(text: Column) -> Column:
    """map page -> valid strokes of an annotation file (null if it is none)."""
    data = F.from_json(text, f"format string, document string, pages map<string,{STROKES}>")
    pages = F.map_filter(data["pages"], lambda p, s: p.rlike("^\\d+$") & s.isNotNull())
    pages = F.map_filter(F.transform_values(pages, lambda p, s: valid_strokes(s)),
                         lambda p, s: F.size(s) > 0)
    is_file = F.endswith(data["format"], F.lit("-anotacoes")) & data["document"].isNotNull()
    return F.when(is_file, pages)


def reason_text(template: Column, params: Column) -> Column:
    """A reason template with its `{{name}}` parameters filled in."""
    return F.aggregate(F.map_entries(params), template, lambda acc, e: F.replace(
        acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def notebook_text(content: Column) -> Column:
    nb = F.from_json(content, "cells array<struct<cell_type:string,source:array<string>>>, "
                     "metadata struct<kernelspec:struct<language:string>>")
    language = F.coalesce(nb["metadata"]["kernelspec"]["language"], F.lit("python"))
    def block(c: Column) -> Column:
        source = F.array_join(c["source"], "")
        body = F.regexp_replace(source, "\\s+$", "")
        return (F.when(F.trim(X.collapse(source)) == "", F.lit(None).cast("string"))
                .when(c["cell_type"] == "markdown", F.regexp_replace(body, "^\\s+", ""))
                .when(c["cell_type"] == "code",
                      F.concat(F.lit("```"), language, F.lit("\n"), body, F.lit("\n```"))))
    return F.array_join(F.filter(F.transform(nb["cells"], block), lambda b: b.isNotNull()), "\n\n")
