"""SQL fragments shared by the reference statements of the registry."""

from __future__ import annotations


def norm(col: str) -> str:
    """Matching form of a text."""
    camel = f"regexp_replace({col}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    flat = f"regexp_replace(lower(strip_accents({camel})), '[^a-z0-9]+', ' ', 'g')"
    cut = f"regexp_replace({flat}, '([a-z])([0-9])', '\\1 \\2', 'g')"
    cut = f"regexp_replace({cut}, '([0-9])([a-z])', '\\1 \\2', 'g')"
    spelled = ("CASE WHEN length(w) >= 4 THEN replace(replace(replace(replace("
               "w, 'cc', 'c'), 'ct', 't'), 'pc', 'c'), 'pt', 't') ELSE w END")
    return (f"array_to_string(list_transform(string_split(trim({cut}), ' '), "
            f"lambda w: {spelled}), ' ')")


def words(norm_col: str) -> str:
    return f"list_filter(string_split({norm_col}, ' '), lambda w: w <> '')"


def tokens(col: str) -> str:
    folded = f"lower(strip_accents({col}))"
    return (f"list_filter(regexp_split_to_array({folded}, '[^\\p{{L}}\\p{{N}}]+'), "
            "lambda w: w <> '')")


def slug(col: str, size: int = 60) -> str:
    flat = f"regexp_replace(lower(strip_accents({col})), '[^a-z0-9]+', '-', 'g')"
    cut = f"regexp_replace(substr(regexp_replace({flat}, '^-+|-+$', '', 'g'), 1, {size}), '-+$', '')"
    return f"CASE WHEN {cut} = '' THEN 'sem-nome' ELSE {cut} END"


def collapse(col: str) -> str:
    return f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"


def simhash(source: str, shingle: int = 3) -> str:
    """doc_id, n, simhash (hex) from a relation with doc_id and the word list `ws`."""
    gram = (f"unnest(list_transform(range(1, greatest(len(ws) - {shingle - 1}, 1) + 1), "
            f"lambda i: array_to_string(ws[i:i + {shingle - 1}], ' ')))")
    low = " + ".join(f"(CASE WHEN sum((h >> {b}) & 1) * 2 > count(*) THEN {1 << b}::UBIGINT "
                     f"ELSE 0::UBIGINT END)" for b in range(64))
    return (f"(SELECT doc_id, any_value(n) AS n, {low} AS bits FROM (SELECT doc_id, n, "
            f"('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, len(ws) AS n, "
            f"{gram} AS g FROM {source} WHERE len(ws) > 0)) GROUP BY doc_id)")
