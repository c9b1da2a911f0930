"""Deposits: scanning, intake by content, packing, parts, archives, stores, gold tables."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions import names as N, text as X
from quire.operators.chains import first_from, reached
from quire.session import durable, running_totals, set_digest

PACK_BYTES, PACK_MIN_FILES = 60 * 1024 * 1024, 20
MAX_FILE_BYTES = 99_614_720
PART_MARK, PARTS_SUFFIX, REF_SUFFIX = ".part-", ".parts.yaml", ".ref.yaml"
# Folders that code projects carry along, and files that mark their root.
IGNORED_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "env", "build", "dist", "target",
                ".idea", ".vscode", "bin", "obj", ".gradle", ".next", ".mypy_cache", ".pytest_cache"]
MARKERS = ["pyproject.toml", "setup.py", "requirements.txt", "package.json", "pom.xml", "build.gradle",
           "build.gradle.kts", "CMakeLists.txt", "Makefile", "Cargo.toml", "go.mod", "composer.json",
           "Gemfile", ".project"]
MARKER_ENDS = "\\.(sln|csproj|vcxproj)$"
MIN_CODE_FILES, CODE_RATIO = 3, 0.6


def _below(root: str) -> Column:
    return F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + os.path.abspath(root) + "/", "")


def read_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (relative to `root`), size, modified, sha256 of every file below `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_below(root).alias("path"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"),
                        *([F.sha2("content", 256).alias("sha256"), "content"] if content else []))


def file_digests(files: DataFrame, root: str) -> DataFrame:
    """path, size, sha256 of `files(path, length, content)` below `root`, a batch or a stream. A row holds no file above 2 GiB, so
    those of a mounted folder are read piece by piece, whatever their size, by the task that has their name. Of another
    store only Spark reads: there the content of a file is a row."""
    context = files.sparkSession.sparkContext
    store = context._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme()
    if store != "file":
        return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
                    digests.append(hashlib.file_digest(file, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "size", "sha256"])

    return files.select("path", F.col("length").alias("size")).mapInArrow(run, "path string, size bigint, sha256 string")


def scan(files: DataFrame, users: DataFrame, default_owner: str) -> tuple[DataFrame, DataFrame]:
    """(items, junk) of `files(path, size, sha256)` laid out as `<login>/<batch>/<rel>`; an unknown
    first folder is a batch of the default owner, loose files belong to it too. Items are files,
    refs, part manifests or parts."""
    parts = F.split("path", "/")
    top, depth = F.element_at(parts, 1), F.size(parts)
    known = users.select(F.col("login").alias("_login")).distinct()
    rows = files.filter(~(top.rlike("^[._]"))).withColumn("_top", top).join(
        known, F.col("_top") == F.col("_login"), "left")
    owned = F.col("_login").isNotNull() | (F.col("_top") == default_owner)
    second = F.when(owned & (depth > 2), F.element_at(parts, 2))
    rows = rows.filter(~F.coalesce(second.rlike("^\\.") | (second == "_erros"), F.lit(False)))
    login = F.when(depth == 1, F.lit(default_owner)).when(owned, F.col("_top")).otherwise(default_owner)
    batch = F.when(depth == 1, F.lit(None)).when(owned, second).otherwise(F.col("_top"))
    skip = F.when(depth == 1, 1).when(owned & (depth > 2), 3).when(owned, 2).otherwise(2)
    rel = F.array_join(F.slice(parts, skip, depth), "/")
    placed = rows.select(login.alias("login"), batch.alias("batch"), rel.alias("rel"), "size", "sha256")
    name = F.substring_index("rel", "/", -1)
    kind = (F.when(F.endswith("rel", F.lit(PARTS_SUFFIX)), "parts")
            .when(F.col("rel").rlike("\\.part-\\d{4}$"), "part")
            .when(F.endswith("rel", F.lit(REF_SUFFIX)), "ref").otherwise("file"))
    junk = N.is_junk(name)
    return placed.filter(~junk).withColumn("kind", kind), placed.filter(junk)


def dirs_of(path: Column) -> Column:
    """Every folder above a path, outermost first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(
        F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def _is_marker(name: Column) -> Column:
    return name.isin(MARKERS) | name.rlike(f"^[^/]*{MARKER_ENDS}")


def folder_code(files: DataFrame, group: str) -> DataFrame:
    """Per group and folder (with its subfolders): files, code files, ratio, study documents, and
    whether a project marker lies directly inside."""
    ext = N.extension_of("path")
    rows = files.select(group, "path", ext.isin(N.CODE_EXTS).alias("code"),
                        N.category_of(ext).isin(N.DOCUMENT_CATEGORIES).alias("doc"),
                        is_ignored(F.col("path")).alias("ignored"),
                        F.explode(dirs_of(F.col("path"))).alias("dir"))
    name = F.substring_index("path", "/", -1)
    direct = F.regexp_replace("path", "/[^/]*$", "") == F.col("dir")
    below = F.substr("path", F.length("dir") + 2)
    marked = (direct & _is_marker(name)) | (
        F.substring_index(below, "/", 1).isin(".git") & F.contains(below, F.lit("/")))
    counted = ~F.col("ignored")
    return rows.groupBy(group, "dir").agg(
        F.sum(F.when(counted, 1).otherwise(0)).alias("files"),
        F.sum(F.when(counted & F.col("code"), 1).otherwise(0)).alias("code_files"),
        F.bool_or(counted & F.col("doc")).alias("documents"), F.bool_or(marked).alias("marker")
    ).withColumn("ratio", F.when(F.col("files") > 0, F.col("code_files") / F.col("files")).otherwise(0.0))


def code_projects(files: DataFrame, group: str) -> DataFrame:
    """Outermost folders that are code projects: marked ones, or mostly code without documents. A group with a
    marker right in its root is one project, whose folder is ""; code alone does not make the root one."""
    at_root = files.filter(_is_marker(F.col("path")) | F.startswith("path", F.lit(".git/"))).select(group).distinct()
    whole = at_root.select(group, F.lit("").alias("dir"))
    files = files.join(at_root.select(F.col(group).alias("_root")), F.col(group).eqNullSafe(F.col("_root")), "left_anti")
    stats = folder_code(files, group).filter(~is_ignored(F.col("dir")))
    found = stats.filter(F.col("marker") | ((F.col("code_files") >= MIN_CODE_FILES)
                                            & (F.col("ratio") >= CODE_RATIO) & ~F.col("documents")))
    return outermost(found.select(group, "dir"), group).unionByName(whole)


def outermost(dirs: DataFrame, group: str) -> DataFrame:
    """Folders that lie in no other folder of the set: a semi join on the exploded ancestors."""
    above = dirs.select(group, F.col("dir").alias("_dir"), F.explode(dirs_of(F.col("dir"))).alias("dir"))
    inside = above.join(dirs, [group, "dir"], "left_semi").select(group, F.col("_dir").alias("dir"))
    return dirs.join(inside, [group, "dir"], "left_anti")


def manifest(files: DataFrame, group: str) -> DataFrame:
    """What is in a project, one row an entry: each kept file, and each ignored folder with the files and bytes in
    it (`ignored`). All files go along, the ignored ones are only not listed."""
    kept = files.filter(~is_ignored(F.col("path"))).select(
        group, F.col("path").alias("entry"), F.lit(False).alias("ignored"), F.lit(1).cast("long").alias("files"), F.col("size").cast("long").alias("bytes"))
    gone = manifest_ignored(files, group).select(group, F.col("root").alias("entry"), F.lit(True).alias("ignored"), "files", "bytes")
    return kept.unionByName(gone)


def manifest_ignored(files: DataFrame, group: str) -> DataFrame:
    """Ignored folders of a project with their files and bytes."""
    parts = F.split("path", "/")
    at = F.array_position(F.transform(parts, lambda p: p.isin(IGNORED_DIRS)), F.lit(True)).cast("int")
    root = F.array_join(F.slice(parts, F.lit(1), at), "/")
    return (files.filter(is_ignored(F.col("path"))).groupBy(group, root.alias("root"))
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes")))


def deposit_items(items: DataFrame, projects: DataFrame, group: str = "batch") -> DataFrame:
    """Scanned items with code projects as one item each: parts and the members of a project are no
    items of their own. `projects(batch, dir)` are the project roots."""
    loose = items.filter("kind <> 'part'").withColumn("_up", F.concat(F.array(F.lit("")), dirs_of(F.col("rel"))))
    roots = projects.select(F.col(group).alias("_g"), F.col("dir").alias("_dir"))
    above = loose.select(group, "rel", F.explode("_up").alias("_d"))
    inside = above.join(roots, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_d") == F.col("_dir")), "left_semi")
    members = inside.select(F.col(group).alias("_g"), F.col("rel").alias("_rel")).distinct()
    kept = loose.join(members, F.col(group).eqNullSafe(F.col("_g")) & (F.col("rel") == F.col("_rel")), "left_anti")
    return kept.select(group, "rel", "kind").unionByName(projects.select(
        group, F.col("dir").alias("rel"), F.lit("code_project").alias("kind")))


def extraction_metadata(raw: DataFrame, column: str = "value") -> DataFrame:
    """Extraction records from their JSON text."""
    schema = ("sha256 string, extractor string, extractor_version int, words int, simhash string, rendition string, "
              "pages array<struct<n:int,method:string,chars:int,ocr_confidence:double,needs_ai_transcription:boolean,"
              "label:string>>, metadata map<string,string>, warnings array<string>")
    return raw.select(F.from_json(column, schema).alias("e")).select("e.*")


def software_archives(entries: DataFrame, min_entries: int = 20, ratio: float = 0.5) -> DataFrame:
    """Archives that hold mostly programs. `entries(archive, path)`."""
    other = N.category_of(N.extension_of("path")) == "other"
    return (entries.groupBy("archive").agg(F.count("*").alias("entries"),
                                           F.avg(F.when(other, 1.0).otherwise(0.0)).alias("other"))
            .withColumn("software", (F.col("entries") >= min_entries) & (F.col("other") >= ratio)))


def archive_budget(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """archive, verdict: too many entries, too many bytes, a suspicious ratio, or ok. `entries(archive,
    size)`, `sizes(archive, archive_size)`."""
    total = entries.groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    ratio = F.col("bytes") / F.greatest("archive_size", F.lit(1))
    verdict = (F.when(F.col("n") > 5000, "entries").when(F.col("bytes") > 2 ** 31, "bytes")
               .when((F.col("bytes") > 10 * 2 ** 20) & (ratio > 200), "ratio").otherwise("ok"))
    return total.join(sizes, "archive").select("archive", "n", "bytes", verdict.alias("verdict"))


# --- intake ---------------------------------------------------------------------------------------


def intake(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents after a deposit: same owner and content gains the new sources (and comes back from
    the bin), anything else is a new document. `docs(id, owner, sha256, sources, removed)`, `items(owner,
    sha256, via, path, batch, seq)`; a source counts once per (via, path, batch)."""
    fresh = (items.groupBy("owner", "sha256", "via", "path", "batch").agg(F.min("seq").alias("seq"))
             .groupBy("owner", "sha256").agg(F.array_sort(F.collect_list(F.struct(
                 "seq", "via", "path", "batch"))).alias("_new"), F.min("seq").alias("_seq")))
    strip = F.transform("_new", lambda s: F.struct(s["via"].alias("via"), s["path"].alias("path"),
                                                   s["batch"].alias("batch")))
    joined = docs.join(fresh, ["owner", "sha256"], "full_outer")
    merged = (F.when(F.col("sources").isNull(), strip).when(F.col("_new").isNull(), F.col("sources"))
              .otherwise(F.array_union("sources", strip)))
    fresh_id = F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("\u0000", "owner", "sha256"), 256), 1, 12))
    outcome = (F.when(F.col("id").isNull(), "created").when(F.col("_new").isNull(), "kept")
               .when(F.size(F.array_except(strip, "sources")) > 0, "source_added").otherwise("known"))
    return joined.select(F.coalesce(F.col("id").cast("string"), fresh_id).alias("id"), "owner", "sha256",
                         merged.alias("sources"), F.when(F.col("_new").isNull(), F.col("removed")).otherwise(
                             F.lit(False)).alias("removed"), outcome.alias("outcome"))


def intake_refs(refs: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) references: their content must be in the store."""
    have = blobs.select("sha256").distinct()
    return refs.join(have, "sha256", "left_semi"), refs.join(have, "sha256", "left_anti")


def triage(files: DataFrame, library: DataFrame) -> DataFrame:
    """State of each chosen file, in the order of `pos`: invalid, junk, ignored_dir, too_big, copy_batch (of an
    earlier file), copy_library (mine), known (elsewhere) or new. `files(owner, pos, path, size,
    sha256)`, `library(owner, sha256, id)`."""
    safe = N.safe_path("path")
    early = (F.when(safe.isNull(), "invalid").when(N.is_junk(F.substring_index(safe, "/", -1)), "junk")
             .when(is_ignored(safe), "ignored_dir").when(F.col("size") > MAX_FILE_BYTES, "too_big"))
    rows = files.withColumn("early", early)
    good = rows.filter("early is null")
    first = good.groupBy("owner", "sha256").agg(F.min("pos").alias("_first"))
    mine = library.groupBy("owner", "sha256").agg(F.min("id").alias("_mine"))
    anyone = library.select("sha256", F.lit(True).alias("_known")).distinct()
    joined = (rows.join(first, ["owner", "sha256"], "left").join(mine, ["owner", "sha256"], "left")
              .join(anyone, "sha256", "left"))
    state = (F.when(F.col("early").isNotNull(), F.col("early"))
             .when(F.col("pos") > F.col("_first"), "copy_batch").when(F.col("_mine").isNotNull(), "copy_library")
             .when(F.col("_known"), "known").otherwise("new"))
    return joined.select("owner", "pos", state.alias("state"))


def pack_lots(files: DataFrame, group: str, order: str, cap: int = PACK_BYTES, least: int = PACK_MIN_FILES) -> DataFrame:
    """Lot number of each file of an upload: files are added in order until the next would exceed
    `cap` bytes. Uploads of fewer than `least` files are not packed, their lot is null.

    The first file of the lot behind one that begins at a file is found on the running total of sizes;
    the lots of an upload are the files that these pointers lead to from its first one."""
    rows = files.select(group, order, F.col("size").cast("long").alias("size"))
    sums = durable(running_totals(rows, [group], order, nth=F.lit(1).cast("long"), total=F.col("size")), "sums")
    uploads = sums.groupBy(group).agg(F.max("nth").alias("_n"), F.max("total").alias("_all"))
    packed = sums.join(uploads.filter(F.col("_n") >= least), group).drop("_n")
    long = durable(packed.filter(F.col("_all") > cap).drop("_all"), "long")
    before = F.col("total") - F.col("size")
    points = long.select(group, F.col("total").alias("x"), "nth", before.alias("before"))
    probes = long.select(group, (before + cap + 1).alias("y"), "nth", before.alias("empty"))
    # a lot of empty files takes the next one whatever its size
    onward = F.col("found.nth") + F.when(F.col("found.before") > F.col("empty"), 0).otherwise(1)
    node = lambda c: F.struct(F.col(group).alias("g"), c.cast("long").alias("n"))
    pointers = first_from(points, probes, [group], cap).select(node(F.col("nth")).alias("node"), F.when(F.col("found").isNotNull(), node(onward)).alias("next"))
    begins = reached(pointers, long.filter("nth = 1").select(node(F.col("nth")).alias("node"))).select(
        F.col("node.g").alias("_g"), F.col("node.n").alias("_i"), F.lit(1).alias("_cut"))
    cut = long.join(begins, (F.col(group) == F.col("_g")) & (F.col("nth") == F.col("_i")), "left").select(
        group, order, "nth", F.coalesce("_cut", F.lit(0)).alias("_cut"))
    lots = running_totals(cut, [group], "nth", lot=F.col("_cut")).select(group, order, F.col("lot").cast("int").alias("lot"))
    short = packed.filter(F.col("_all") <= cap).select(group, order, F.lit(1).alias("lot"))
    loose = sums.join(uploads.filter(F.col("_n") < least), group).select(group, order, F.lit(None).cast("int").alias("lot"))
    return lots.unionByName(short).unionByName(loose)


def assemble_parts(parts: DataFrame, manifests: DataFrame) -> DataFrame:
    """State of each target: pending while parts lack, error when there are too many or the sizes do
    not add up, else complete. `parts(target, part, size)`, `manifests(target, parts, size)`.

    With a column `content` in parts and `sha256` in manifests, parts whose sizes add up are joined in order, and what does
    not give the digest is a mismatch too. A digest is a chain, so the parts of one target are read in one
    task, as a stream sorted by part; their sum is bounded by what a manifest may ask for."""
    have = parts.groupBy("target").agg(F.count("*").alias("have"), F.sum("size").alias("bytes"))
    joined = manifests.join(have, "target", "left").fillna({"have": 0, "bytes": 0})
    fits = (F.col("have") == F.col("parts")) & (F.col("parts") >= 1) & (F.col("bytes") == F.col("size"))
    if "content" in parts.columns:
        asked = joined.filter(fits).select("target")
        joined = joined.join(joined_digests(parts.join(asked, "target", "left_semi")).withColumnRenamed("sha256", "_is"), "target", "left")
        wrong = fits & ~F.col("_is").eqNullSafe(F.col("sha256"))
    else:
        wrong = F.lit(False)
    state = (F.when((F.col("parts") < 1) | (F.col("have") < F.col("parts")), "pending")
             .when(F.col("have") > F.col("parts"), "too_many")
             .when((F.col("bytes") != F.col("size")) | wrong, "mismatch").otherwise("complete"))
    return joined.select("target", "have", "bytes", state.alias("state"))


def joined_digests(parts: DataFrame) -> DataFrame:
    """target, sha256: the digest of the contents of each target's parts one behind the other."""
    kind = parts.schema["target"].dataType.simpleString()
    rows = parts.select("target", "part", "content").repartition("target").sortWithinPartitions("target", "part").select("target", "content")

    def run(batches):
        current, digest, out = None, None, []
        for batch in batches:
            for target, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is None or target != current:
                    if digest is not None:
                        out.append((current, digest.hexdigest()))
                    current, digest = target, hashlib.sha256()
                digest.update(content.as_buffer() or b"")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], batch.schema.field(0).type), pa.array([d for _, d in out])], ["target", "sha256"])
                out = []
            last = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], last), pa.array([digest.hexdigest()])], ["target", "sha256"])

    return rows.mapInArrow(run, f"target {kind}, sha256 string")


def put_if_absent(store: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs to append: contents the store does not hold, one row each."""
    new = blobs.join(store.select("sha256"), "sha256", "left_anti")
    return new.groupBy("sha256").agg(F.min("size").alias("size"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads see one store, then the other."""
    return first.unionByName(second.join(first.select("sha256"), "sha256", "left_anti"))


def migrate(originals: DataFrame, store: DataFrame, quota: int, used: int = 0) -> DataFrame:
    """Audit of a move in order of `pos`: there, mismatch (content differs from its name), uploaded, or
    stopped once the byte quota is reached. `originals(pos, name_sha, sha256, size)`."""
    have = store.select(F.col("sha256").alias("_have"), F.lit(True).alias("_there")).distinct()
    rows = originals.join(have, F.col("name_sha") == F.col("_have"), "left").select(
        "pos", "name_sha", "size", F.when(F.col("_there"), "there").when(F.col("name_sha") != F.col("sha256"), "mismatch").alias("early"))
    billed = F.when(F.col("early").isNull(), F.col("size")).otherwise(0).cast("long")
    state = F.when(F.col("total") + used > quota, "stopped").otherwise(F.coalesce("early", F.lit("uploaded")))
    return running_totals(rows, [], "pos", total=billed).select(
        "pos", "name_sha", "size", (F.col("total") + used).alias("total"), state.alias("state"))


# --- quarantine, versions, derived text -----------------------------------------------------------


def quarantine(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with `error_class`)."""
    tagged = rows.withColumn("error_class", error)
    return tagged.filter("error_class is null").drop("error_class"), tagged.filter("error_class is not null")


def retry(errors: DataFrame, cured: list[str]) -> DataFrame:
    """Quarantined rows whose cause is known to be gone."""
    return errors.filter(F.col("error_class").isin(cured)).drop("error_class")


def upgrade_records(docs: DataFrame, target: int = 6) -> DataFrame:
    """Records of older formats, one step per version: before version 2 a private visibility was the
    default and is dropped; the later steps only raise the number."""
    visibility = F.when((F.col("format") < 2) & (F.col("visibility") == "private"), F.lit(None)).otherwise(
        F.col("visibility"))
    return docs.withColumn("visibility", visibility).withColumn("format", F.greatest("format", F.lit(target)))


def assembled_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whole text of each document with page marks, and the page count."""
    mark = F.concat(F.lit("<!-- página "), F.col("page").cast("string"), F.lit(" -->\n\n"),
                    F.regexp_replace("text", "^\\s+|\\s+$", ""))
    return pages.groupBy(key).agg(
        F.count("*").alias("pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", mark.alias("t")))),
                                 lambda p: p["t"]), "\n\n").alias("document"))


def page_metadata(pages: DataFrame, key: str = "doc_id", method: str = "native") -> DataFrame:
    """Page rows with method, characters and the transcription flag."""
    text = F.regexp_replace("text", "^\\s+|\\s+$", "")
    confidence = F.col("ocr_confidence") if "ocr_confidence" in pages.columns else F.lit(None).cast("double")
    kind = F.when(confidence.isNotNull(), "ocr").otherwise(method)
    few = F.size(X.words(X.normalize("text"))) < 5
    flag = confidence.isNotNull() & ((confidence < 60) | few | X.looks_mathematical("text"))
    return pages.select(key, "page", kind.alias("method"), F.length(text).alias("chars"),
                        (F.length(text) < 25).alias("scanned"), F.coalesce(flag, F.lit(False))
                        .alias("needs_transcription"))


def project_pages(manifest: DataFrame, group: str, max_files: int = 300, max_bytes: int = 100_000) -> DataFrame:
    """Text pages of a code project: the first files in path order that are small enough, fenced.
    `manifest(group, path, size, text)`; the listing limit is the feature here."""
    w = Window.partitionBy(group).orderBy("path")
    rows = manifest.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_files).filter(
        F.col("size") <= max_bytes)
    ext = N.extension_of("path")
    body = F.concat(F.lit("### "), "path", F.lit("\n\n```"), ext, F.lit("\n"), F.regexp_replace(
        "text", "\\s+$", ""), F.lit("\n```"))
    return rows.select(group, (F.col("n") + 1).alias("page"), F.col("path").alias("label"), body.alias("text"))


def archive_listing(entries: DataFrame) -> DataFrame:
    """Listing page of each archive (an archive holds 5000 entries at most)."""
    return entries.groupBy("archive").agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")),
        lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n").alias("text"))


def reextract(extractions: DataFrame, contents: DataFrame, versions: dict[str, int]) -> DataFrame:
    """Contents whose extraction is missing or from another extractor version. `contents(sha256, ext, kind)`,
    `extractions(sha256, extractor, extractor_version)`."""
    category = N.category_of("ext")
    legacy = N.lookup(N.LEGACY_EXTS, F.col("ext"))
    name = (F.when(F.col("kind") == "code_project", "code_project")
            .when(category == "legacy_office", F.concat(F.lit("legacy-"), legacy)).otherwise(category))
    table = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])
    version = F.when(category == "legacy_office", table["legacy"] * 100 + table[legacy]).otherwise(table[name])
    joined = contents.select("sha256", name.alias("_name"), version.alias("_version")).join(
        extractions, "sha256", "left")
    same = (F.col("extractor") == F.col("_name")) & (F.col("extractor_version") == F.col("_version"))
    return joined.filter(~F.coalesce(same, F.lit(False))).select(
        "sha256", F.col("_name").alias("extractor"), F.col("_version").alias("extractor_version"))


def ocr_quality(words: DataFrame, page: str = "page_id") -> DataFrame:
    """Confidence weighted by word length, words and lines per page. `words(page_id, level, block_num, par_num,
    line_num, word_pos, text, conf)`."""
    text = F.trim("text")
    w = words.filter((F.col("level") == 5) & (text != "")).withColumn("text", text)
    sure = F.col("conf") >= 0
    size = F.length("text")
    total = F.sum(F.when(sure, size))
    return w.groupBy(page).agg(
        F.round(F.coalesce(F.sum(F.when(sure, F.col("conf") * size)) / total, F.lit(0.0)), 1).alias("confidence"),
        F.count("*").alias("words"), F.count_distinct("block_num", "par_num", "line_num").alias("lines"))


def ocr_text(words: DataFrame, page: str = "page_id") -> DataFrame:
    """Page text rebuilt from words: lines in order, a blank line between paragraphs."""
    w = words.filter((F.col("level") == 5) & (F.trim("text") != ""))
    lines = w.groupBy(page, "block_num", "par_num", "line_num").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("word_pos", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("l"))
    paragraphs = lines.groupBy(page, "block_num", "par_num").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("line_num", "l"))), lambda x: x["l"]), "\n").alias("p"))
    return paragraphs.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("block_num", "par_num", "p"))), lambda x: x["p"]), "\n\n").alias("text"))


# --- gold tables ----------------------------------------------------------------------------------


def write_tables(tables: dict[str, DataFrame], out: str, partitions: dict[str, list[str]] | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        columns = (partitions or {}).get(name)
        (writer.partitionBy(*columns) if columns else writer).parquet(f"{out}/{name}")


def build_manifest(spark: SparkSession, out: str) -> DataFrame:
    """Size and digest of every data file of a build."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).filter(~F.col("path").rlike("(^|/)[._][^/]*$"))
    return file_digests(files, out).withColumn("path", _below(out))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    row = F.sha2(F.concat_ws("\u0000", "path", "sha256"), 256)
    return manifest.agg(set_digest(row).alias("digest"))


def is_fresh(published: DataFrame, head: str) -> bool:
    """The published build stems from `head` already (a one-row table)."""
    row = published.select("built_from").first()
    return row is not None and row.built_from == head
