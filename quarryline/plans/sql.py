"""Snippets of the SQL that checks the queries on another engine."""

from __future__ import annotations

from quarryline.functions import text as T
from quarryline.operators import filters


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"


def strip(x: str) -> str:
    return sub(x, T.EDGES)


def collapse(x: str) -> str:
    return strip(sub(x, f"{T.SPACE}+", "' '"))


def clean(x: str) -> str:
    return strip(sub(sub(sub(x, r"\r\n?", "chr(10)"), T.DELETED), r"\n{3,}", "chr(10) || chr(10)"))


def normal(x: str) -> str:
    return collapse(sub(x, T.BLANKED, "' '"))


def canonical(x: str) -> str:
    return collapse(f"lower({x})")


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quoted(T.WORD)})"


def count(x: str, of_one: str) -> str:
    """Characters that a class of one character matches."""
    return f"(length({x}) - length({sub(x, of_one)}))"


def spaced(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {quoted(T.SPACE + '+')}), lambda s: s <> '')"


def tokens(x: str) -> str:
    return f"CAST(greatest(1, round_even(length({x}) / 4.0, 0)) AS BIGINT)"


def truncated(x: str, most: int) -> str:
    cut = f"substr({x}, 1, {most})"
    upto = f"length(regexp_extract({cut}, '(?s)\\A.*[.!?]'))"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE {strip(f'CASE WHEN {upto} - 1 > {most} * 0.7 THEN substr({cut}, 1, {upto}) ELSE {cut} END')} END"


def repeated(items: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN 0.0 ELSE (len({items}) - len(list_distinct({items}))) / len({items}) END"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {quoted(T.LINE_END)}), lambda s: {canonical('s')}), lambda s: s <> '')"


def ngrams(w: str, n: int) -> str:
    return f"list_transform(range(1, CAST(len({w}) AS BIGINT) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def boilerplate(x: str) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {quoted('(?i)' + p)}) AS BIGINT)" for p in filters.BOILERPLATE) + ")"


def metrics(x: str) -> dict[str, str]:
    size = f"greatest(length({x}), 1)"
    return {
        "n_chars": f"length({x})",
        "url_ratio": f"(length({x}) - length({sub(x, T.URL)})) / {size}",
        "digit_ratio": f"{count(x, T.DIGIT)} / {size}",
        "symbol_ratio": f"{count(x, rf'[^\p{{L}}\p{{N}}{T.SPACES}]')} / {size}",
        "n_words": f"len({words(x)})",
        "alpha_ratio": f"{count(x, r'\p{L}')} / {size}",
        "duplicate_lines": repeated(lines(x)),
        "repeated_5grams": repeated(ngrams(words(x), 5)),
        "boilerplate": boilerplate(x),
    }


def metric_rows(source: str, x: str = "text", keep: str = "doc_id") -> str:
    """Metrics with words, lines and n-grams made once a row."""
    m = metrics("t")
    return f"""SELECT {keep}, t, {m["n_chars"]} AS n_chars, {m["url_ratio"]} AS url_ratio, {m["digit_ratio"]} AS digit_ratio, {m["symbol_ratio"]} AS symbol_ratio,
        len(w) AS n_words, {m["alpha_ratio"]} AS alpha_ratio, {repeated("l")} AS duplicate_lines, {repeated(ngrams("w", 5))} AS repeated_5grams, {m["boilerplate"]} AS boilerplate
        FROM (SELECT {keep}, {x} AS t, {words(x)} AS w, {lines(x)} AS l FROM {source})"""


def rejection(r: filters.StreamRules) -> str:
    """The first failing rule, over columns named like the metrics."""
    return f"""CASE WHEN n_chars < {r.min_chars} THEN 'too_short' WHEN n_chars > {r.max_chars} THEN 'too_long' WHEN url_ratio > {r.max_urls} THEN 'url_ratio'
        WHEN digit_ratio > {r.max_digits} THEN 'digit_ratio' WHEN symbol_ratio > {r.max_symbols} THEN 'symbol_ratio' WHEN n_words < {r.min_words} THEN 'too_few_words'
        WHEN alpha_ratio < {r.min_letters} THEN 'alpha_ratio' WHEN duplicate_lines > {r.max_repeated_lines} THEN 'duplicate_lines'
        WHEN repeated_5grams > {r.max_repeated_ngrams} THEN 'repeated_5grams' WHEN boilerplate > {r.max_boilerplate} THEN 'boilerplate' END"""


def pilot_reasons(x: str, r: filters.PilotRules) -> str:
    stop = "[" + ", ".join(quoted(w) for w in filters.STOPWORDS) + "]"
    seen = f"({count(x, T.NOT_SPACE)})"
    phrase = "CASE " + " ".join(f"WHEN contains(lower({x}), {quoted(p.lower())}) THEN {quoted('boilerplate:' + p)}" for p in r.phrases) + " END"
    run = f"len(list_filter(list_distinct(string_split({x}, '')), lambda c: c <> chr(10) AND c <> '' AND contains({x}, repeat(c, {r.max_run + 1})))) > 0"
    return f"""CASE WHEN {x} = '' THEN ['empty_text'] ELSE list_filter([
        CASE WHEN length({x}) < {r.min_chars} THEN 'too_short_chars' END,
        CASE WHEN len(regexp_extract_all({x}, {quoted(T.WORD)})) < {r.min_words} THEN 'too_few_words' END,
        CASE WHEN {run} THEN 'repeated_character_run' END,
        CASE WHEN CASE WHEN {seen} = 0 THEN 1.0 ELSE 1 - {count(x, r'\p{L}')} / {seen} END > {r.max_non_letters} THEN 'too_many_non_letters' END,
        CASE WHEN len(list_filter({words(x)}, lambda w: list_contains({stop}, w))) < {r.min_stopwords} THEN 'not_enough_german_stopwords' END,
        {phrase}], lambda s: s IS NOT NULL) END"""


def bucket(digest: str, total: int) -> str:
    return f"CAST(CAST('0x' || substr({digest}, 1, 16) AS UBIGINT) % {total} AS BIGINT)"


def by_bucket(digest: str, train: int, validation: int, total: int) -> str:
    b = bucket(digest, total)
    return f"CASE WHEN {b} < {train} THEN 'train' WHEN {b} < {train + validation} THEN 'validation' ELSE 'test' END"


def by_ratio(digest: str, seed: int, train: float, validation: float) -> str:
    f = f"CAST('0x' || substr(sha256('{seed}:' || {digest}), 1, 12) AS BIGINT) / {float(16**12)!r}"
    return f"CASE WHEN {f} < {train!r} THEN 'train' WHEN {f} < {train + validation!r} THEN 'validation' ELSE 'test' END"


def stable_key(seed: str, purpose: str, source: str, record: str) -> str:
    return f"sha256('{seed}' || chr(0) || '{purpose}' || chr(0) || {source} || chr(0) || {record})"


def word_ids(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 6) AS INTEGER) % 30000 + 3 AS INTEGER))"


def report(keep: str) -> str:
    """The last text of each conversation and role."""
    return f"(SELECT conv_id, role, max_by(text, turn) AS t FROM conversations WHERE {keep} GROUP BY ALL)"


def outer_compare_sql() -> str:
    return f"""
    SELECT conv_id, role, sha256(coalesce(a.t, '')) AS left_sha256, sha256(coalesce(b.t, '')) AS right_sha256,
        CASE WHEN {collapse("coalesce(a.t, '')")} = {collapse("coalesce(b.t, '')")} THEN 'identical' ELSE 'different' END AS label
    FROM {report("conv_id % 3 <> 0 OR turn > 1")} a FULL JOIN {report("conv_id % 4 <> 0")} b USING (conv_id, role)"""
