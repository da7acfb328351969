"""DuckDB SQL for the counting rules, written from the rules rather than from the Column expressions.

DuckDB's regular expressions have no look-around, so sentences are found token by token here, by masking there.
"""

from __future__ import annotations

from ..functions import charclass as cc
from ..functions.counters import COUNTED, DIALECTS, PUBLISHED
from ..functions.vocabulary import EXACT


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


SPACE, NOT_SPACE, IN_LINE = cc.re2(cc.SPACE), cc.re2(cc.NOT_SPACE), cc.re2(cc.SPACE_IN_LINE)
WORD = r"[\p{L}\p{N}]"
MARK, SYMBOL = cc.MARKER, cc.SYMBOL


def has(pieces: str, what: str = WORD) -> str:
    """How many pieces hold a match."""
    return f"len(list_filter({pieces}, lambda x: regexp_matches(x, {q(what)})))"


def tokens(t: str, apart: str = cc.DASH) -> str:
    """Pieces between white space, after separating dashes."""
    return f"regexp_split_to_array(regexp_replace({t}, {q(apart)}, ' ', 'g'), {q(SPACE + '+')})"


def strip(t: str) -> str:
    """Without white space at the ends."""
    return f"regexp_replace({t}, {q(rf'\A{SPACE}+|{SPACE}+\z')}, '', 'g')"


def fold(t: str) -> str:
    """Case folding, as far as the tables need it."""
    return f"replace(lower({t}), 'ß', 'ss')"


LINES = "string_split(t, chr(10))"
BULLETS = {"plain": f"^ ?{MARK}[ \\t]+", "all_levels": f"^[ \\t]*{MARK}[ \\t]+", "dash_only": f"^ ?{SYMBOL}[ \\t]+"}


def bodies(dialect: str = "plain") -> str:
    """What follows the markers of a text's bullets."""
    mark = BULLETS[dialect]
    return f"list_transform(list_filter({LINES}, lambda l: regexp_matches(l, {q(mark + NOT_SPACE)})), lambda l: regexp_replace(l, {q(mark)}, ''))"


def item_key(b: str, dialect: str) -> str:
    """What makes two items the same."""
    if dialect == "exact":
        return strip(b)
    if dialect == "first_word":
        return fold(f"coalesce(list_filter({tokens(b)}, lambda x: regexp_matches(x, {q(WORD)}))[1], '')")
    letters = f"regexp_replace({b}, {q(r'[^\p{L}\p{N}' + SPACE[1:-1] + ']')}, ' ', 'g')"
    return fold(strip(f"regexp_replace({letters}, {q(SPACE + '+')}, ' ', 'g')"))


def keys(item: str = "normalized", bullet: str = "plain") -> str:
    """Keys of a text's bullets."""
    return f"list_transform({bodies(bullet)}, lambda b: {item_key('b', item)})"


def duplicated(item: str) -> str:
    """Whether any key is there twice."""
    return f"len({keys(item)}) <> len(list_distinct({keys(item)}))"


def keyword(t: str, k: str) -> str:
    """Whether a word of ``t`` is the keyword ``k``."""
    own = f"list_transform({tokens(t, cc.DASH_OR_HYPHEN)}, lambda x: {fold(f'regexp_replace(x, {q(cc.NEITHER)}, {q("")}, {q("g")})')})"
    return f"list_contains({own}, {fold(k)})"


COUNTS = {
    "words_plain": has(tokens("t")),
    "words_hyphen_split": has(tokens("t", cc.DASH_OR_HYPHEN)),
    "words_whitespace": f"len(list_filter(regexp_split_to_array(t, {q(SPACE + '+')}), lambda x: x <> ''))",
    "words_alpha_only": has(tokens("t"), r"\p{L}"),
    "sentences_naive": has(f"regexp_split_to_array(t, {q(cc.STOP + '+')})"),
    **{f"bullets_{k}": f"len(list_filter({LINES}, lambda l: regexp_matches(l, {q(m + NOT_SPACE)})))" for k, m in BULLETS.items()},
    "chars_codepoints": f"length({strip('t')})",
    "chars_no_whitespace": f"length(regexp_replace(t, {q(SPACE + '+')}, '', 'g'))",
    "chars_utf8_bytes": f"strlen({strip('t')})",
    "chars_nfc_codepoints": f"length(nfc_normalize({strip('t')}))",
    "lines_nonblank": has(LINES),
    "lines_all_lines": "CASE WHEN regexp_replace(t, '\\A\\n+|\\n+\\z', '', 'g') = '' THEN 0 ELSE len(string_split(regexp_replace(t, '\\A\\n+|\\n+\\z', '', 'g'), chr(10))) END",
    "lines_stripped_all": has(LINES, NOT_SPACE),
    "paragraphs_blank_line": has(f"regexp_split_to_array(t, {q(rf'\n({IN_LINE}*\n)+')})"),
    "paragraphs_single_newline": has(LINES),
    "paragraphs_indent_or_blank": has(
        f"regexp_split_to_array(regexp_replace(t, {q(rf'\n([ \t][^\n]*{NOT_SPACE})')}, chr(10) || chr(10) || '\\1', 'g'), {q(rf'\n({IN_LINE}*\n)+')})"
    ),
}


def _sentences(name: str, src: str, key: str) -> str:
    """CTEs that end in ``name`` (key, plain, closed): sentences, and those that a stop closes."""
    abbreviation = rf"(?i)(^|[^\p{{L}}.])\.*{cc.ABBREVIATION}\.{cc.CLOSER}*$"
    masked = f"regexp_replace(t, {q(rf'(?m)^([ \t]*\p{{Nd}}+)\.([^.!?…\n]|$)')}, '\\1․\\2', 'g')"
    ended = (
        f"regexp_matches(x, {q(cc.STOP + cc.CLOSER + '*$')}) AND NOT regexp_matches(x, {q(abbreviation)}) "
        f"AND (i = len(tok) OR NOT regexp_matches(tok[i + 1], {q(r'^\p{Ll}')}))"
    )
    return f"""
{name}_tok AS (SELECT {key}, regexp_split_to_array({masked}, {q(SPACE + "+")}) tok FROM {src}),
{name}_seg AS (SELECT {key}, string_split(array_to_string(list_transform(tok, lambda x, i: x || CASE WHEN {ended} THEN chr(1) ELSE ' ' END), ''), chr(1)) seg FROM {name}_tok),
{name} AS (SELECT {key}, {has("seg")} plain, {has("seg[1:len(seg) - 1]")} closed FROM {name}_seg)"""


def counted(source: str, *, sentences: bool = True, also: str = "") -> str:
    """A WITH clause that ends in ``counted``: the rows of ``source`` (k, t, more) with every count.

    ``also``: more columns over t.
    """
    plain = ", ".join(f"{e} AS {n}" for n, e in COUNTS.items())
    if not sentences:
        return f"WITH src AS ({source}), counted AS (SELECT *, {plain}{also} FROM src)"
    return f"""WITH src AS ({source}),
{_sentences("whole", "src", "k")},
by_line AS (SELECT k, unnest({LINES}) t FROM src),
{_sentences("lined", "by_line", "k")},
line_sum AS (SELECT k, sum(plain) newline_breaks FROM lined GROUP BY k),
counted AS (SELECT src.*, {plain}, whole.plain sentences_plain, whole.closed sentences_require_terminator,
  coalesce(newline_breaks, 0) sentences_newline_breaks{also}
  FROM src JOIN whole ON whole.k = src.k LEFT JOIN line_sum ON line_sum.k = src.k)"""


def count_of(dimension: str, dialect: str | None = None) -> str:
    """The column of a count."""
    return f"{dimension}_{dialect or PUBLISHED[dimension]}"


ALL_COUNTS = [count_of(d, k) for d in COUNTED for k in DIALECTS[d]]


def by_dimension(column: str = "dimension") -> str:
    """The published count of a row's dimension."""
    return "CASE " + column + " " + " ".join(f"WHEN '{d}' THEN {count_of(d)}" for d in COUNTED) + " END"


def satisfied(observed: str) -> str:
    """Whether a count meets the row's constraint."""
    return f"CASE mode WHEN 'exact' THEN {observed} = target WHEN 'at_most' THEN {observed} <= target ELSE {observed} >= target END"




def unwrap_sql(source: str) -> str:
    """A WITH clause that ends in ``unwrapped`` (the rows of ``source`` (k, t, more) with u and n_notes)."""
    fence = rf"(?s)\A{SPACE}*```[a-zA-Z0-9_+-]*{SPACE}*\n(.*?)\n{SPACE}*```{SPACE}*\z"
    preamble = r"\A[^\n]{0,120}:[ \t]*\n"
    tail = (
        rf"(?i)(?:\n{IN_LINE}*\(?{IN_LINE}*(?:that is |this is |{EXACT} )?\p{{Nd}}+{IN_LINE}+"
        r"(?:words?|characters?|chars?|sentences?|bullets?|lines?|paragraphs?|items?)(?:[^\p{L}\p{N}_\n][^\n]*)?)+\z"
    )
    first = has(tokens("split_part(b1, chr(10), 1)"))
    return f"""WITH src AS ({source}),
u0 AS (SELECT *, {strip("t")} b0 FROM src),
u1 AS (SELECT *, regexp_matches(b0, {q(fence)}) f1, CASE WHEN regexp_matches(b0, {q(fence)}) THEN regexp_extract(b0, {q(fence)}, 1) ELSE b0 END b1 FROM u0),
u2 AS (SELECT *, regexp_matches(b1, {q(preamble)}) AND {first} <= 14 f2 FROM u1),
u3 AS (SELECT *, regexp_replace(CASE WHEN f2 THEN regexp_replace(b1, {q(preamble)}, '') ELSE b1 END, {q(SPACE + "+" + chr(92) + "z")}, '') b2 FROM u2),
unwrapped AS (SELECT * EXCLUDE (b0, b1, b2), {strip(f"regexp_replace(b2, {q(tail)}, '')")} u,
  f1::INT + f2::INT + len(regexp_extract(b2, {q(tail)})) - len(replace(regexp_extract(b2, {q(tail)}), chr(10), '')) n_notes FROM u3)"""
