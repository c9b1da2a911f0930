"""Question bank: which papers may have questions, and word-for-word verification in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as X
from quire.operators.classify import status_rank
from quire.session import durable, pinned

# Limits and patterns of the verification.
GAP_MAX, TAIL_MAX, MIN_CHARS, MAX_CHARS, MAX_BLOCKS = 160, 250, 20, 6000, 200
GARBLED = "[\\ue000-\\uf8ff\\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
FIGURE = ("\\b(?:figuras?|tabelas?|graficos?|diagramas?|esquemas?|desenhos?|fotografias?|"
          "ilustrac(?:ao|oes)|(?:em|no|do|nos|dos|ver o) anexos?|"
          "imagens? (?:seguintes?|abaixo|acima|em baixo))\\b|\\bfig\\.")
MATH = ("[=<>≤≥≠±×÷√∫∑∏∞∂∈∉⊂⊆⊃∪∩→←↔⇒⇔^_{}|~∀∃∇]|\\b[a-zA-Z]\\s*\\(\\s*[a-zA-Z0-9]\\s*\\)"
        "|\\b(lim|log|ln|sen|sin|cos|tg|tan|exp|max|min)\\b|(?<![A-Za-zÀ-ÿ])[a-z]\\d(?!\\d)")
QUESTION_START = ("(?iU)(?:^|\\s)(?:\\d{1,3}\\s*[.)]|[a-z]\\)|(?:pergunta|quest[aã]o|exerc[ií]cio)"
                  "\\s+\\d{1,3})(?=\\s|$)")
GROUP_HEADER = "(?iU)\\b(?:grupo|parte|sec[cç][aã]o)\\s+(?:[IVXL]{1,6}|\\d{1,2})\\b"
LABEL = "^(?:([IVXL]{1,6})\\.)?(\\d{1,3})$"


def exclusion(text: Column | str) -> Column:
    """Why a question found in the file is not shown: garbled, figure or math."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.when(text.rlike(GARBLED), "garbled")
            .when(F.lower(X.strip_accents(text)).rlike(FIGURE), "figure")
            .when(text.rlike(MATH), "math"))


def eligibility(docs: DataFrame) -> DataFrame:
    """doc_id, reason (null when the document may have questions). `docs(id, sha256, removed, duplicate_of,
    needs_review, status, is_assessment, role, pages)`."""
    reason = (F.when(F.col("removed") | F.col("duplicate_of").isNotNull(), "removido_ou_copia")
              .when(F.col("needs_review") | (status_rank(F.col("status")) < 4), "nao_arrumado")
              .when(~F.coalesce(F.col("is_assessment") & (F.col("role") == "statement"), F.lit(False)),
                    "nao_e_enunciado")
              .when(F.coalesce("pages", F.lit(0)) == 0, "sem_texto"))
    return docs.select("id", "sha256", reason.alias("reason"))


def native_pages(meta: DataFrame) -> DataFrame:
    return meta.filter((F.col("method") == "native") & ~F.col("needs_transcription")).select("sha256", "page")


def pending(docs: DataFrame, questions: DataFrame, native: DataFrame) -> DataFrame:
    """Papers without questions yet, the lowest id of each content, with a native page."""
    may = eligibility(docs).filter("reason is null")
    return (may.groupBy("sha256").agg(F.min("id").alias("id"))
            .join(questions.select("sha256"), "sha256", "left_anti")
            .join(native.select("sha256"), "sha256", "left_semi"))


def index_status(present: Column, excluded: Column, review: Column) -> Column:
    return (F.when(excluded.isNotNull(), "excluded").when(review == "rejected", "rejected")
            .when(~present, "missing").otherwise("visible"))


def carry_reviews(new: DataFrame, old: DataFrame) -> DataFrame:
    """Decisions stay with questions whose text is the same. `(sha256, id, text_sha256, …)`."""
    kept = old.filter("review_status is not null").groupBy("sha256", "text_sha256").agg(
        F.max_by(F.struct("review_status", "review_by"), "ord").alias("_r"))
    return new.join(kept, ["sha256", "text_sha256"], "left").select(
        *new.columns, F.col("_r.review_status").alias("review_status"), F.col("_r.review_by").alias("review_by"))


def review(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest confirm / reject per (sha256, label) on top. `decisions(sha256, label, status, by, at)`."""
    last = (decisions.filter(F.col("status").isin("confirmed", "rejected")).groupBy("sha256", "label")
            .agg(F.max_by(F.struct("status", "by"), "at").alias("_d")))
    out = questions.join(last, ["sha256", "label"], "left")
    return out.withColumn("review_status", F.coalesce("_d.status", "review_status")).drop("_d")


def still_in_file(questions: DataFrame, pages: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """The questions with `present`: the passage is still in its file, word for word, all its pages are
    native and so is its context. `questions(sha256, id, text[, pages, context])`, `pages(sha256, page,
    text[, method])`, `contexts(sha256, id, text[, pages])`; pages of a file are read as one text. A
    question without pages lies on no other page, one without a context needs none."""
    native = F.col("method") == "native" if "method" in pages.columns else F.lit(True)
    corpus = pages.groupBy("sha256").agg(
        X.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), " ")).alias("_corpus"),
        F.collect_set(F.when(native, F.col("page"))).alias("_native"))

    def found(df: DataFrame) -> DataFrame:
        here = F.contains(F.concat(F.lit(" "), "_corpus", F.lit(" ")), F.concat(F.lit(" "), X.collapse("text"), F.lit(" ")))
        if "pages" in df.columns:
            here = here & (F.size(F.array_except(F.col("pages"), F.col("_native"))) == 0)
        return df.join(corpus, "sha256", "left").select(*df.columns, F.coalesce(here, F.lit(False)).alias("present"))

    out = found(questions)
    if contexts is None:
        return out
    there = found(contexts).filter("present").select(F.col("sha256").alias("_s"), F.col("id").alias("_c")).distinct()
    joined = out.join(there, (F.col("sha256") == F.col("_s")) & (F.col("context") == F.col("_c")), "left")
    return joined.select(*questions.columns, (F.col("present") & (F.col("context").isNull() | F.col("_c").isNotNull())).alias("present"))


def locate(passages: DataFrame, texts: DataFrame, key: str, text_key: str, head: int = 5) -> DataFrame:
    """(passage, text) pairs where the passage stands word for word, spaces apart, in the text.

    Texts are indexed by runs of `head` words; a passage is looked up by its first run and then
    compared as a whole. Passages shorter than that are compared by their full length.
    """
    w = lambda c: F.split(X.collapse(c), " ")
    asked = passages.select(F.col(key), w("text").alias("_w")).withColumn(
        "_n", F.least(F.size("_w"), F.lit(head)))
    asked = asked.select(key, "_n", F.array_join("_w", " ").alias("_needle"),
                         F.array_join(F.slice("_w", F.lit(1), F.col("_n")), " ").alias("gram"))
    sizes = [r._n for r in asked.select("_n").distinct().collect()]  # at most `head` values
    base = pinned(texts, [text_key], _t=w("text"))

    def runs(n: int) -> Column:
        last = F.size("_t") - (n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(F.col("_t"), i, F.lit(n)), " "))

    grams = base.select(text_key, F.explode(F.array_distinct(F.concat(*[runs(n) for n in sizes]))).alias("gram"))
    candidates = grams.join(asked, "gram").select(key, text_key, "_needle")
    whole = texts.select(F.col(text_key), F.concat(F.lit(" "), X.collapse("text"), F.lit(" ")).alias("_t"))
    return (candidates.join(whole, text_key)
            .filter(F.contains("_t", F.concat(F.lit(" "), "_needle", F.lit(" "))))
            .select(key, text_key))


# --- labels and numbering -------------------------------------------------------------------------

ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50}


def roman_value(text: Column) -> Column:
    """Value of a roman numeral made of I, V, X and L."""
    table = F.create_map(*[F.lit(x) for kv in ROMAN_VALUES.items() for x in kv])
    values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: table[c])
    return F.aggregate(F.sequence(F.lit(1), F.size(values)), F.lit(0), lambda acc, i: acc + F.when(
        F.coalesce(F.get(values, i), F.lit(0)) > F.element_at(values, i),
        -F.element_at(values, i)).otherwise(F.element_at(values, i)))


def numbering(blocks: DataFrame) -> DataFrame:
    """sha256, code: null when the labels run 1..n, or in groups I, II, … each from 1. `blocks(sha256, pos,
    kind, label)`; a file has 200 blocks at most."""
    q = blocks.filter("kind = 'question'").groupBy("sha256").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("label").alias("label")))),
                    lambda s: s["label"]).alias("labels"))
    group = lambda x: F.regexp_extract(x, LABEL, 1)
    number = lambda x: F.regexp_extract(x, LABEL, 2).try_cast("int")
    valid = F.forall("labels", lambda x: F.coalesce(x.rlike(LABEL), F.lit(False)))
    plain = F.forall("labels", lambda x: x.rlike("^\\d{1,3}$"))
    grouped = F.forall("labels", lambda x: group(x) != "")
    in_order = F.forall(F.transform("labels", lambda x, i: number(x) == i + 1), lambda ok: ok)
    pairs = F.transform("labels", lambda x: F.struct(roman_value(group(x)).alias("g"), number(x).alias("n")))
    # each label goes one up in its group or opens the next group at 1
    steps = F.transform(F.col("_p"), lambda p, i: F.when(i == 0, (p["g"] == 1) & (p["n"] == 1)).otherwise(
        ((p["g"] == F.element_at(F.col("_p"), F.greatest(i, F.lit(1)))["g"])
         & (p["n"] == F.element_at(F.col("_p"), F.greatest(i, F.lit(1)))["n"] + 1))
        | ((p["g"] == F.element_at(F.col("_p"), F.greatest(i, F.lit(1)))["g"] + 1) & (p["n"] == 1))))
    q = q.withColumn("_p", F.when(valid & grouped, pairs))
    code = (F.when(F.size(F.array_distinct("labels")) < F.size("labels"), "numeracao")
            .when(plain, F.when(~in_order, "numeracao"))
            .when(~(valid & grouped), "rotulo_invalido")
            .when(~F.forall(steps, lambda ok: ok), "numeracao"))
    return q.select("sha256", code.alias("code"))


# --- verification of a proposal -------------------------------------------------------------------

# The code points that count as white space.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]"
SOLID = "[^\\t-\\r\\x1c-\\x20\\x85\\p{Z}]"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{SOLID}+"), F.lit(0))


def _stripped(token: Column) -> Column:
    return F.regexp_replace(token, f"{SPACE}+$", "")


def earliest_chain(blocks: Column, whole: Column) -> Column:
    """An array of (at, stop) in the order of `blocks(line, many)`: between which spaces of the file `whole` the words
    of each block stand. Each block takes its first place behind the block before it, null from the first block on
    that has none. Lines and file have one space before, between and behind their words, so that runs of words
    are runs of characters."""
    free = lambda done: F.when(F.size(done) == 0, F.lit(1)).otherwise(F.element_at(done, -1)["stop"])
    found = lambda done, b: F.when(b["many"] > 0, F.nullif(F.position(b["line"], whole, free(done)), F.lit(0)))
    step = lambda done, b: F.concat(done, F.transform(F.array(found(done, b)), lambda at: F.struct(
        at.alias("at"), (at + F.length(b["line"]) - 1).alias("stop"))))
    return F.aggregate(blocks, F.array().cast("array<struct<at:int,stop:int>>"), step)


def located(blocks: DataFrame, pages: DataFrame, native: DataFrame) -> DataFrame:
    """Each block with its place: sha256, pos, kind, label, passage (its words on one line), start, text and pages as the
    file has them, a line a page, native (whether all those pages have own text), gap (what stands between it and the
    block before, null for the first) and tail (what stands behind the last one). `native(sha256, page)`.

    The blocks of a proposal, MAX_BLOCKS at most, meet the text of their file in one row; each text is shuffled once."""
    sheets = pages.select("sha256", "page", X.nfc(F.coalesce("text", F.lit(""))).alias("text")).groupBy("sha256").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("sheets"))
    asked = blocks.select("sha256", "pos", "kind", "label", X.nfc("text").alias("text")).groupBy("sha256").agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "label", "text"))).alias("asked"))
    own = native.groupBy("sha256").agg(F.collect_set("page").alias("own"))
    both = asked.join(sheets, "sha256", "left").join(own, "sha256", "left")
    tokens = lambda s: F.regexp_extract_all(s["text"], F.lit(f"{SOLID}+{SPACE}*"), F.lit(0))
    cells = F.flatten(F.transform("sheets", lambda s: F.transform(tokens(s), lambda t: F.struct(t.alias("raw"), s["page"].alias("page")))))
    said = F.transform("asked", lambda b: F.struct(b["pos"].alias("pos"), b["kind"].alias("kind"), b["label"].alias("label"), _words(b["text"]).alias("words")))
    read = pinned(both, ["sha256", "own"], cells=F.coalesce(cells, F.array().cast("array<struct<raw:string,page:int>>")), said=said)
    line = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    lined = pinned(read, ["sha256", "own", "cells"], whole=line(F.transform("cells", lambda c: _stripped(c["raw"]))), said=F.transform(
        "said", lambda b: F.struct(b["pos"].alias("pos"), b["kind"].alias("kind"), b["label"].alias("label"),
                                   line(b["words"]).alias("line"), F.size(b["words"]).alias("many"))))
    whole, chain = F.col("whole"), F.col("chain")
    chained = pinned(lined, ["sha256", "own", "cells", "whole", "said"], chain=earliest_chain(F.col("said"), whole))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    def placed(b: Column, i: Column) -> Column:
        at, stop, before = chain[i]["at"], chain[i]["stop"], F.when(i > 0, F.get(chain, i - 1)["stop"])
        return F.struct(
            b["pos"].alias("pos"), b["kind"].alias("kind"), b["label"].alias("label"), F.trim(b["line"]).alias("passage"), b["many"].alias("many"),
            spaces(F.substr(whole, F.lit(1), at)).alias("start"), F.substr(whole, before, at - before + 1).alias("gap"),
            F.when(i == F.size(chain) - 1, F.substr(whole, stop, F.length(whole) - stop)).alias("tail"))

    spots = pinned(chained, ["sha256", "own", "cells"], spots=F.transform("said", placed))
    cut = spots.select("sha256", "own", F.explode(F.transform("spots", lambda x: F.struct(
        x.alias("x"), F.slice("cells", x["start"], x["many"]).alias("part")))).alias("c")).select("sha256", "own", "c.x.*", "c.part")
    cut = pinned(cut, ["sha256", "own", "pos", "kind", "label", "passage", "start", "gap", "tail", "part"], pages=F.array_distinct("part.page"))
    lines = F.transform("pages", lambda p: _stripped(F.array_join(F.transform(
        F.filter("part", lambda c: c["page"] == p), lambda c: c["raw"]), "")))
    return cut.select("sha256", "pos", "kind", "label", "passage", "start", F.array_join(lines, "\n").alias("text"), "pages",
                      (F.size(F.array_except("pages", F.coalesce("own", F.array().cast("array<int>")))) == 0).alias("native"), "gap", "tail")


def refusal(passage: Column, number: Column) -> Column:
    """Why a located block is refused, null where it is not."""
    starts_by = F.concat(F.lit("(?iU)^(?:(?:pergunta|quest[aã]o|exerc[ií]cio)\\s+"), number, F.lit("\\b|"), number, F.lit("\\s*[.)ºª:–-])"))
    opens = F.coalesce((F.col("kind") == "context") | F.rlike(passage, starts_by), F.lit(False))
    return (F.when(~F.length(passage).between(MIN_CHARS, MAX_CHARS), "tamanho")
            .when(F.col("start").isNull(), "texto_nao_encontrado")
            .when((F.length("gap") > GAP_MAX) | F.rlike("gap", F.lit(QUESTION_START)), "intervalo")
            .when(~F.col("native"), "pagina_nao_nativa")
            .when(~opens, "comeco"))


def contexts_of(blocks: DataFrame) -> DataFrame:
    """`blocks` with `nth` (number of contexts so far) and `context`, the id of the one that a question belongs to.

    A context holds for the questions behind it up to the next context or group header, while these are of
    one group: the first group named after the context; a question of another one ends it."""
    order = Window.partitionBy("sha256").orderBy("pos")
    cut = (F.col("kind") == "context") | F.coalesce(F.rlike("gap", F.lit(GROUP_HEADER)), F.lit(False))
    stretch = Window.partitionBy("sha256", "_stretch").orderBy("pos")
    past = stretch.rowsBetween(Window.unboundedPreceding, -1)
    group = F.when(F.col("kind") == "question", F.nullif(F.regexp_extract(F.trim("label"), LABEL, 1), F.lit("")))
    named = F.first("_group", ignorenulls=True).over(past)
    other = (F.col("kind") == "question") & named.isNotNull() & ~named.eqNullSafe(F.col("_group"))
    rows = (blocks.withColumn("_stretch", F.sum(F.when(cut, 1).otherwise(0)).over(order))
            .withColumn("nth", F.sum(F.when(F.col("kind") == "context", 1).otherwise(0)).over(order))
            .withColumn("_group", group).withColumn("_other", other))
    led = F.first("kind").over(stretch) == "context"
    whole = ~F.bool_or("_other").over(stretch)
    return rows.withColumn("context", F.when((F.col("kind") == "question") & led & whole, F.concat(F.lit("c"), "nth"))).drop(
        "_stretch", "_group", "_other")


RESULT = ("sha256 string, code string, id string, kind string, pos int, label string, context string, "
          "pages array<int>, text string")


def verify(blocks: DataFrame, pages: DataFrame, native: DataFrame) -> DataFrame:
    """Verified blocks of each proposal, or one row with the refusal code: all blocks or none.

    Structure and numbering are judged on the whole table first. The blocks of the proposals that are
    left are located in their files; what is refused in the first refused block, or behind the last one, refuses the proposal."""
    shape = blocks.groupBy("sha256").agg(
        F.count("*").alias("_n"),
        F.bool_and(F.coalesce(F.col("kind").isin("context", "question") & F.col("text").isNotNull()
                              & ((F.col("kind") == "context") | F.col("label").isNotNull()), F.lit(False)))
        .alias("_ok"), F.sum(F.when(F.col("kind") == "question", 1).otherwise(0)).alias("_q"))
    code = (F.when(~F.col("_ok") | (F.col("_n") > MAX_BLOCKS), "proposta_invalida")
            .when(F.col("_q") == 0, "sem_perguntas"))
    fit = shape.select("sha256", code.alias("code"))
    small = blocks.join(fit.filter("code is null"), "sha256", "left_semi")
    judged = durable(fit.join(numbering(small).withColumnRenamed("code", "_num"), "sha256", "left").select(
        "sha256", F.coalesce("code", "_num").alias("code")), "judged")
    good = judged.filter("code is null").select("sha256")
    left = blocks.join(good, "sha256", "left_semi").select("sha256", F.col("pos").cast("int"), "kind", "label", "text")
    own = native.select("sha256", F.col("page").cast("int").alias("page"))
    sheets = pages.select("sha256", F.col("page").cast("int").alias("page"), "text").join(good, "sha256", "left_semi")
    label = F.trim("label")
    number = F.coalesce(F.nullif(F.regexp_extract(label, LABEL, 2), F.lit("")), F.lit("\\z"))
    tail_code = (F.when((F.length("tail") > TAIL_MAX) | F.rlike("tail", F.lit(QUESTION_START)), "fim")
                 .when(F.col("kind") != "question", "proposta_invalida"))
    rows = contexts_of(located(left, sheets, own)).withColumn("code", F.coalesce(
        refusal(F.col("passage"), number), F.when(F.col("tail").isNotNull(), tail_code)))
    order = Window.partitionBy("sha256").orderBy("pos")
    refused = F.first("code", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    told = rows.withColumn("_code", refused).withColumn("_row", F.row_number().over(order)).filter("_code is null or _row = 1")
    question, fine = F.col("kind") == "question", F.col("_code").isNull()
    kept = {"id": F.when(question, label).otherwise(F.concat(F.lit("c"), "nth")), "kind": F.col("kind"), "pos": F.col("pos"),
            "label": F.when(question, label).otherwise(F.col("label")), "context": F.col("context"), "pages": F.col("pages"), "text": F.col("text")}
    found = durable(told.select("sha256", F.col("_code").alias("code"), *[F.when(fine, c).alias(name) for name, c in kept.items()]), "verified")
    early = judged.filter("code is not null")
    return found.unionByName(early.select("sha256", "code", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in kept]))


def questions_of(verified: DataFrame) -> DataFrame:
    """Question rows with order, digest and exclusion (their own, or the one of their context)."""
    ok = verified.filter("code is null")
    excluded = exclusion(X.collapse("text"))
    contexts = ok.filter("kind = 'context'").select("sha256", F.col("id").alias("context"), excluded.alias("_ce"))
    q = ok.filter("kind = 'question'").select("sha256", "id", "label", "pos", "context", "pages", "text",
                                              X.text_digest("text").alias("text_sha256"), excluded.alias("_e"))
    w = Window.partitionBy("sha256").orderBy("pos")
    return (q.join(contexts, ["sha256", "context"], "left")
            .withColumn("excluded", F.coalesce("_e", "_ce")).withColumn("ord", F.row_number().over(w))
            .drop("_e", "_ce"))
