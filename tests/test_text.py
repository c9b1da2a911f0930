import pytest
from pyspark.sql import functions as F

from quire.functions import text as X

NORMALIZED = [
    ("Ano Lectivo 2022/2023", "ano letivo 2022 2023"),
    ("Correcção", "correcao"),
    ("correção", "correcao"),
    ("Óptimo", "otimo"),
    ("1.ª época", "1 a epoca"),
    ("AM1_ExameRecurso2023.pdf", "am 1 exame recurso 2023 pdf"),
    ("Exame — Época de Recurso", "exame epoca de recurso"),
    ("  espaços   múltiplos  ", "espacos multiplos"),
    ("ficha3", "ficha 3"),
    ("TPC1", "tpc 1"),
    ("acto e facto", "ato e fato"),
    ("Inform´atica e Dura¸c˜ao", "informatica e duracao"),
    ("ﬁcha de ﬂuxo", "ficha de fluxo"),
    ("`a noite", "a noite"),
    ("m´A", "ma"),
    ("ct pct act cct pacct", "ct pct act cct pat"),
    ("Ⅱ ½ № ﬃ", "ii 1 2 no ffi"),
    ("época", "epoca"),
    ("", ""),
    ("---", ""),
]


@pytest.mark.parametrize("fn,cases", [
    (X.normalize, NORMALIZED),
    (X.strip_accents, [("Ação É ½", "Acao E 1⁄2"), ("plain", "plain"), ("Ωμέγα", "Ωμεγα")]),
    (X.fix_spacing_accents, [("Inform´atica", "Informática"), ("Dura¸c˜ao", "Duração"),
                             ("ﬁm", "fim"), ("x ´q", "x q́"), ("`a", "à"), ("´ı", "í")]),
    (X.slugify, [("Época de Recurso!", "epoca-de-recurso"), ("", "sem-nome"), ("--", "sem-nome")]),
    (X.series_number, [("analise ii", 2), ("ii", None), ("analise", None), ("am 9", 9),
                       ("am 10", None), ("x x", 10)]),
    (X.clean_text, [("a  \r\nb\n\n\n\nc\x00 ", "a\nb\n\nc")]),
    (X.looks_mathematical, [("x" * 50, False), ("=+" * 30, True), ("=+", False)]),
    (X.word_count, [("", 0), ("a", 1), ("a b c", 3)]),
])
def test_scalar(spark, fn, cases):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(fn("x")).collect()]
    assert got == [b for _, b in cases]


def test_unit_phrase(spark):
    cases = [
        ("analise matematica ii", "analise matematica", False),
        ("analise matematica i", "analise matematica", True),
        ("analise matematica", "analise matematica", True),
        ("am 2 teste", "am ii", True),
        ("amii teste", "am ii", True),
        ("am 2 ano", "am ii", False),
        ("am 2 ano", "am", True),
        ("nada", "am ii", False),
        ("analise matematica ii e analise matematica", "analise matematica", True),
        ("am am ii", "am", True),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, h string, n string, want boolean")
    for r in df.select("h", "n", "want", X.contains_unit_phrase("h", "n").alias("got")).collect():
        assert r.got == r.want, r


def test_sequel_and_phrase(spark):
    row = spark.range(1).select(
        X.sequel_after(F.lit("am 3 x"), F.lit("am")).alias("a"),
        X.contains_phrase(F.lit("um dois tres"), F.lit("dois")).alias("b"),
        X.contains_phrase(F.lit("um doiss"), F.lit("dois")).alias("c"),
        X.roman(F.lit(4)).alias("d"), X.roman(F.lit(12)).alias("e")).first()
    assert tuple(row) == (3, True, False, "IV", "12")


def test_markdown_table(spark):
    row = spark.range(1).select(X.markdown_table(
        F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")))).alias("t")).first()
    assert row.t == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
