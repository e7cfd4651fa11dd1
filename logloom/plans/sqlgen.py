"""DuckDB SQL fragments mirroring the Column functions in `functions.text`.

Used only to write the independent SQL oracles of the driver queries; every
fragment is a plain expression over a column name or sub-expression.
"""

from __future__ import annotations

import re

from ..functions import text as T

WS = T.WS_CLASS
WC = "'<*>'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def unicode_words(pattern: str) -> str:
    r"""The pattern with `\w` spelt out: it holds all letters, digits and marks, as in the presets' matcher."""
    out, inside = [], False
    for part in re.findall(r"\\.|[\[\]]|[^\\\[\]]+", pattern):
        inside = part == "[" or (inside and part != "]")
        word = r"\p{L}\p{N}\p{M}_"
        out.append((word if inside else f"[{word}]") if part == r"\w" else part)
    return "".join(out)


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def mask(x: str, regexes) -> str:
    out = x
    for rx in regexes:
        out = f"regexp_replace({out}, {q(rx)}, '<*>', 'g')"
    return squeeze(out)


def is_placeholder(t: str) -> str:
    return f"(starts_with({t}, '<') AND ends_with({t}, '>'))"


def is_variable(t: str) -> str:
    n = f"length({t})"
    digits = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"
    return (f"({is_placeholder(t)} OR (regexp_matches({t}, '^[0-9]+$') AND {n} > 3) "
            f"OR regexp_matches({t}, '^0x[0-9a-fA-F]+$') OR regexp_matches({t}, '^([0-9]+\\.){{3}}[0-9]+$') "
            f"OR ({n} > 5 AND {digits} / {n} > 0.6))")


def first_keyword(x: str) -> str:
    kws = f"list_filter({tokens(x)}, lambda t: NOT ({is_placeholder('t')} OR regexp_matches(t, '^[0-9]+$')))"
    return f"coalesce(lower(({kws})[1]), lower(substr({x}, 1, 20)))"


def partition_key(x: str, ds: str) -> str:
    fixed = f"list_filter({tokens(x)}, lambda t: NOT {is_placeholder('t')})"
    return (f"(CASE WHEN lower({ds}) = 'healthapp' AND contains({x}, '|') "
            f"THEN lower({strip(f'split_part({x}, chr(124), 1)')}) "
            f"WHEN lower({ds}) = 'openssh' AND len({fixed}) >= 2 "
            f"THEN lower(array_to_string(({fixed})[1:2], ' ')) "
            f"ELSE {first_keyword(x)} END)")


def collapse(lst: str) -> str:
    return (f"list_filter({lst}, lambda t, i: NOT (t = '<*>' AND i > 1 "
            f"AND coalesce(({lst})[i - 1] = '<*>', false)))")


def collapse_string(lst: str) -> str:
    s = f"array_to_string({collapse(lst)}, ' ')"
    return f"(CASE WHEN {s} = '' THEN '<*>' ELSE {s} END)"


def scoring_form(x: str) -> str:
    lst = f"list_transform({tokens(x)}, lambda t: CASE WHEN contains(t, '<*>') THEN '<*>' ELSE t END)"
    return f"array_to_string({collapse(lst)}, ' ')"


def template_id(x: str) -> str:
    return f"substr(md5({x}), 1, 8)"


def raw_prefix(t: str) -> str:
    p = f"regexp_extract({t}, '^([A-Za-z_.]+)', 1)"
    return f"(CASE WHEN length({p}) >= 2 THEN {p} ELSE '' END)"


def single_template(norm: str, raw: str, online: bool = False) -> str:
    rt = tokens(raw)
    var = (f"(regexp_matches(t, '^[0-9]+$') AND length(t) > 3)" if online else is_variable("t"))
    rp = raw_prefix(f"coalesce(({rt})[i], '')")
    lst = (f"list_transform({tokens(norm)}, lambda t, i: CASE WHEN {is_placeholder('t')} THEN "
           f"(CASE WHEN {rp} <> '' THEN {rp} || '<*>' ELSE '<*>' END) "
           f"WHEN {var} THEN '<*>' ELSE t END)")
    return collapse_string(lst)


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def structural_score(log: str, tmpl: str, set_variant: bool = False) -> str:
    lt = tokens(log)
    tt = tokens(tmpl)
    low = f"list_transform({lt}, lambda t: lower(t))"
    fixed = f"list_filter({tt}, lambda t: t <> '<*>')"
    if set_variant:
        fixed_s = f"list_distinct(list_transform({fixed}, lambda t: lower(t)))"
        hits = f"len(list_intersect(list_distinct({low}), {fixed_s}))"
        nf = f"len({fixed_s})"
        empty = "0.5"
    else:
        hits = f"len(list_filter({fixed}, lambda t: list_contains({low}, lower(t))))"
        nf = f"len({fixed})"
        empty = "0.3"
    kw = f"(CASE WHEN len({lt}) > 0 AND lower(({lt})[1]) = coalesce(lower(({tt})[1]), '') THEN 1.0 ELSE 0.0 END)"
    ll, tl = f"len({lt})", f"len({tt})"
    len_sim = f"(1.0 - abs({ll} - {tl}) / greatest({ll}, {tl}, 1))"
    return (f"(CASE WHEN {nf} = 0 THEN {empty} ELSE 0.5 * {hits} / greatest({nf}, 1) "
            f"+ 0.3 * {kw} + 0.2 * {len_sim} END)")


def hashed_embedding(x: str, dim: int = 64) -> str:
    hs = f"list_transform({tokens(x)}, lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT))"
    raw = (f"list_transform(range({dim}), lambda d: list_sum(list_transform({hs}, lambda h: "
           f"CASE WHEN h % {dim} = d THEN (CASE WHEN (h // {dim}) % 2 = 0 THEN 1.0 ELSE -1.0 END) ELSE 0.0 END)))")
    return raw


def normalize(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"(CASE WHEN {n} > 0 THEN list_transform({v}, lambda x: x / {n}) ELSE list_transform({v}, lambda x: 0.0) END)"


def match_class(s: str, new_thr: float = 0.6) -> str:
    return (f"(CASE WHEN {s} >= 0.99 THEN 'exact' WHEN {s} >= 0.8 THEN 'partial' "
            f"WHEN {s} >= {new_thr} THEN 'fuzzy' ELSE 'new' END)")
