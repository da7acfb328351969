"""Probe texts: each sits on one decision of the counting rules."""

from __future__ import annotations

#: Label, text, and one count that it decides: (dimension, dialect, count).
DECIDED = (
    ("two sentences", "Rain fell all night. The river rose.", ("sentences", "plain", 2)),
    ("a title before a name", "Prof. Okafor spoke first. Others followed.", ("sentences", "plain", 2)),
    ("a Latin shortening", "Bring tools, e.g. a hammer, along.", ("sentences", "plain", 1)),
    ("a number with a point", "It weighed 7.25 kilos. That was too much.", ("sentences", "plain", 2)),
    ("numbers that open lines", "1. Wash it.\n2. Peel it.\n3. Slice it.", ("sentences", "plain", 3)),
    ("a stop before lower case", "They sell it at mart. co for less.", ("sentences", "plain", 1)),
    ("a stop inside quotes", "She said \u201cwait here.\u201d Nobody did.", ("sentences", "plain", 2)),
    ("stops in a row", "What?! No way!!", ("sentences", "plain", 2)),
    ("dots that trail", "So it went\u2026 And then it ended.", ("sentences", "plain", 2)),
    ("an open end", "This one is closed. This one is not", ("sentences", "require_terminator", 1)),
    ("a number with a comma", "About 12,500 people came.", ("words", "plain", 4)),
    ("hyphens in a word", "An up-to-date map helps.", ("words", "plain", 4)),
    ("hyphens that split", "An up-to-date map helps.", ("words", "hyphen_split", 6)),
    ("a long dash", "north\u2014south east", ("words", "plain", 3)),
    ("a dash in a range", "Pages 40\u201344 are gone.", ("words", "plain", 5)),
    ("an apostrophe", "It isn't over.", ("words", "plain", 3)),
    ("an address", "Look at http://site.example/x/y today.", ("words", "plain", 4)),
    ("signs alone", "x = y * 2", ("words", "plain", 3)),
    ("digits are no letters", "Room 101 on floor 3", ("words", "alpha_only", 3)),
    ("a picture", "warm \U0001f31e days", ("words", "plain", 2)),
    ("marks of a list", "* red\n* green\n* blue", ("bullets", "plain", 3)),
    ("an indented mark", "* red\n   * dark red\n* blue", ("bullets", "plain", 2)),
    ("an indented mark counts", "* red\n   * dark red\n* blue", ("bullets", "all_levels", 3)),
    ("a mark after a tab", "* red\n\t* dark red\n* blue", ("bullets", "plain", 2)),
    ("other marks", "(4) four\nc) see\n\u2022 dot", ("bullets", "plain", 3)),
    ("other marks do not count", "(4) four\nc) see\n- dash", ("bullets", "dash_only", 1)),
    ("a mark with nothing", "- \n- something", ("bullets", "plain", 1)),
    ("a mark without a space", "-glued\n- loose", ("bullets", "plain", 1)),
    ("an accent apart", "re\u0301sume\u0301", ("chars", "codepoints", 8)),
    ("an accent apart, put together", "re\u0301sume\u0301", ("chars", "nfc_codepoints", 6)),
    ("an accent in one", "r\u00e9sum\u00e9", ("chars", "utf8_bytes", 8)),
    ("blanks at the ends", "  in the middle  ", ("chars", "codepoints", 13)),
    ("blanks left out", "  in the middle  ", ("chars", "no_whitespace", 11)),
    ("blank lines between", "red\n\ngreen\n \t\nblue", ("lines", "nonblank", 3)),
    ("a line of signs", "red\n***\nblue", ("lines", "nonblank", 2)),
    ("a line of signs counts", "red\n***\nblue", ("lines", "stripped_all", 3)),
    ("paragraphs", "red\nstill red\n\nblue", ("paragraphs", "blank_line", 2)),
    ("an indented line", "red\n   indented\n\nblue", ("paragraphs", "indent_or_blank", 3)),
    ("many blank lines", "red\n\n\n\n\nblue", ("paragraphs", "blank_line", 2)),
    ("in a fence", "```\nyeast feeds on sugar\n```", ("words", "plain", 4)),
    ("led in", "Sure, here you go:\nyeast feeds on sugar", ("words", "plain", 8)),
    ("counts itself", "yeast feeds on sugar\n(4 words)", ("words", "plain", 6)),
    ("a bold word at a dash", "it is **yeast**\u2014nothing else", ("words", "plain", 5)),
    ("an item again", "* Blue sky.\n* blue sky\n* blue sea", ("bullets", "plain", 3)),
    ("nothing", "", ("words", "plain", 0)),
    ("blanks only", " \n \t \n", ("lines", "nonblank", 0)),
    ("one word", "yeast", ("words", "whitespace", 1)),
)
PROBES = tuple((label, text) for label, text, _ in DECIDED)
