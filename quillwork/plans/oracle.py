"""Pieces of SQL that say in another dialect what the expressions of this library compute."""

from __future__ import annotations

from ..config import QUERIES, SEED
from ..functions.text import ENTITY_STOP, SECTION_NAMES, TOKEN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def count_words(x: str) -> str:
    return f"len({words(x)})"


def space(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace(replace(coalesce({x}, ''), chr(160), ' '), '\n', chr(10)), '/n', chr(10)), '\s+', ' ', 'g'))"


def first_words(x: str, n: int) -> str:
    return f"array_to_string({words(space(x))}[1:{n}], ' ')"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {lit(TOKEN)}), lambda t: lower(t))"


def ngrams(t: str, n: int) -> str:
    return f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE [] END"


def entities(x: str) -> str:
    found = rf"regexp_extract_all({x}, '[A-Z][-0-9A-Za-z]+(?:\s+[A-Z][-0-9A-Za-z]+){{0,5}}')"
    flat = rf"list_transform({found}, lambda e: lower(regexp_replace(e, '\s+', ' ', 'g')))"
    return f"list_sort(list_distinct(list_filter({flat}, lambda e: len(e) >= 2 AND e NOT IN ({', '.join(map(lit, ENTITY_STOP))}))))"


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def plain_sentences(x: str) -> str:
    """A mark behind each end, then a split at the marks: this dialect has no look-behind."""
    marked = rf"regexp_replace(coalesce({x}, ''), '([.!?])\s+', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({space(x)}, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g')"
    twice = rf"regexp_replace({marked}, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(string_split({twice}, chr(1)), lambda s: s <> '')"


def key(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def number(*parts: str) -> str:
    return f"('0x' || substr({key(*parts)}, 1, 8))::BIGINT"


def query(paper: str) -> str:
    return f"([{', '.join(map(lit, QUERIES))}])[{number(lit(str(SEED)), paper)} % {len(QUERIES)} + 1]"


def heading(x: str) -> str:
    """Of a line that ``space`` has been over."""
    n = count_words(x)
    pattern = lit(r"^(?:\d+(?:\.\d+){0,3}|[IVXLCDM]+)[):.]?\s+([a-zA-Z].+)$")
    lettered = rf"list_filter({words(x)}, lambda v: regexp_matches(v, '\p{{L}}'))"
    capital = rf"len(list_filter({lettered}, lambda v: regexp_matches(v, '^\p{{Lu}}')))"
    upper = rf"(upper({x}) = {x} AND regexp_matches({x}, '\p{{Lu}}'))"
    return f"""CASE WHEN {x} = '' OR len({x}) > 120 THEN false WHEN ends_with({x}, '.') AND {n} > 3 THEN false WHEN {n} > 14 THEN false
        WHEN regexp_matches({x}, {pattern}) THEN {count_words(f"regexp_extract({x}, {pattern}, 1)")} <= 12
        WHEN {upper} AND {n} BETWEEN 2 AND 10 THEN true WHEN trim(lower({x}), ' .:') IN ({", ".join(map(lit, SECTION_NAMES))}) THEN true
        WHEN {n} <= 10 AND len({lettered}) > 0 THEN {capital} >= 0.6 * len({lettered}) ELSE false END"""


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
