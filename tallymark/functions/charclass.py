"""Character classes of the counting rules, as parts of Java regular expressions."""

from __future__ import annotations

# The 29 code points of white space, dashes that separate words, sentence ends and what may follow them.
_SPACE_BUT_LINE_FEED = r"\t\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = rf"[{_SPACE_BUT_LINE_FEED}\n]"
NOT_SPACE = rf"[^{_SPACE_BUT_LINE_FEED}\n]"
#: Most of what is neither ASCII nor white space nor a dash, in few ranges, for which Java is faster.
SOLID = r"\xA1-\u167F\u3001-\uD7A3"
SPACE_IN_LINE = rf"[{_SPACE_BUT_LINE_FEED}]"
#: The same code points, for functions that take a list.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DASH = "[—–―−…]"
DASH_OR_HYPHEN = "[—–―−…-]"
STOP = "[.!?…]"
CLOSER = r"""["'’”)\]}»]"""
LETTER = r"\p{L}"
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
NEITHER = r"[^\p{L}\p{N}]"

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt", "rev", "hon", "gen", "col", "sgt",
    "lt", "capt", "messrs", "vs", "etc", "e.g", "i.e", "cf", "al", "approx", "est", "fig", "eq",
    "no", "vol", "ch", "sec", "pp", "ed", "eds", "trans", "inc", "ltd", "co", "corp", "dept",
    "univ", "ave", "rd", "blvd", "apt", "a.m", "p.m", "u.s", "u.k", "u.n", "e.u", "ph.d", "b.a",
    "m.a", "d.c", "min", "max", "sq", "ft", "in", "lb", "oz", "kg", "km",
)
ABBREVIATION = "(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")"

# List markers.
SYMBOL = "[-*+•‣●·]"
MARKER = rf"(?:{SYMBOL}|\p{{Nd}}{{1,3}}[.)]|\(\p{{Nd}}{{1,3}}\)|[a-zA-Z][.)])"

#: Code points that no normalisation changes and none of which joins another: a text of these alone is in form C.
COMPOSED = (
    r"[\x00-\u02FF\u0400-\u0482\u048A-\u052F\u1E00-\u1EFF\u2010-\u2027\u2030-\u205E\u20A0-\u20BF\u3000-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3\uFF01-\uFF60]"
)
#: Most of those, in few ranges: texts mostly consist of them or begin with them.
COMPOSED_OFTEN = r"[\x00-\u02FF]*+[\x00-\u02FF\u3041-\u3096\u4E00-\u9FFF]*+"

#: Noncharacters that stand in for a masked stop and for a cut; text has none.
MASK, CUT = "\ufffe", "\uffff"


def re2(pattern: str) -> str:
    """The same pattern in the notation of RE2."""
    import re

    pattern = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)
    return re.sub(r"\\x([0-9A-F]{2})", r"\\x{\1}", pattern)
