"""Fixed tables of the prompt generator and the composers."""

from __future__ import annotations

# Fixed value: how a prompt says that a count is meant to the unit.
EXACT = "exactly"

# Topics and the word an answer must contain.
TOPICS = (
    ("the water cycle", "condensation"),
    ("how bread rises", "yeast"),
    ("why the sky looks blue", "scattering"),
    ("the rules of chess", "checkmate"),
    ("how a bicycle stays upright", "steering"),
    ("the life of a honeybee colony", "forage"),
    ("what makes a good sentence", "clarity"),
    ("how paper is recycled", "pulp"),
    ("the history of the printing press", "movable"),
    ("how a refrigerator keeps food cold", "compressor"),
    ("the parts of a violin", "bridge"),
    ("why leaves change colour in autumn", "chlorophyll"),
    ("how a lock and key work", "tumbler"),
    ("the job of a lighthouse keeper", "beacon"),
    ("how coffee is roasted", "roast"),
    ("the difference between weather and climate", "average"),
    ("how a suspension bridge carries load", "cable"),
    ("what happens during a total eclipse", "shadow"),
    ("how sourdough starter is kept alive", "flour"),
    ("the anatomy of a wave", "trough"),
    ("how a sewing machine forms a stitch", "bobbin"),
    ("why ice floats", "density"),
    ("the work of a river delta", "sediment"),
    ("how a piano action works", "hammer"),
    ("the migration of monarch butterflies", "migration"),
    ("how glass is blown", "furnace"),
    ("what a compass actually points at", "magnetic"),
    ("how sound travels through water", "pressure"),
    ("the making of a wooden barrel", "stave"),
    ("how a kite flies", "lift"),
    ("what yeast does to grape juice", "fermentation"),
    ("the design of a Roman aqueduct", "gradient"),
    ("how a camera lens focuses", "aperture"),
    ("why bread goes stale", "starch"),
    ("the layers of the atmosphere", "troposphere"),
    ("how a windmill grinds grain", "millstone"),
    ("what makes a knot hold", "friction"),
    ("the growth of a coral reef", "polyp"),
    ("how ink is made", "pigment"),
    ("the phases of the moon", "waxing"),
    ("how a thermostat decides to switch on", "threshold"),
    ("the parts of a shoe", "sole"),
    ("how salt is harvested from the sea", "evaporation"),
    ("why cast iron pans are seasoned", "polymerised"),
    ("the flight of a boomerang", "gyroscopic"),
    ("how a well is dug", "aquifer"),
    ("the language of bees", "waggle"),
    ("how a candle burns", "wick"),
    ("what a keel does on a sailing boat", "keel"),
    ("the making of cheese", "rennet"),
    ("how a bell is cast", "bronze"),
    ("why rainbows are curved", "refraction"),
    ("the tools of a stonemason", "chisel"),
    ("how a zip fastener works", "slider"),
    ("the smell of rain on dry ground", "petrichor"),
    ("how a seed knows which way is up", "gravitropism"),
    ("the making of a violin bow", "horsehair"),
    ("how tides are caused", "gravitational"),
    ("what a sundial measures", "gnomon"),
    ("the building of a dry stone wall", "coping"),
    ("how a submarine changes depth", "ballast"),
    ("why onions make people cry", "sulphur"),
    ("the work of an archivist", "provenance"),
    ("how a whistle makes its note", "resonance"),
)

# The wording of instructions, by form.
FORMS = {
    "prose": (
        "Write a short explanation of {topic}.",
        "Write a paragraph about {topic}.",
        "Write a brief note describing {topic}.",
        "Write a short summary of {topic} for a curious reader.",
        "Explain {topic} to someone who has never thought about it.",
    ),
    "list": (
        "Write a list of facts about {topic}.",
        "Write a list of things worth knowing about {topic}.",
        "List the steps or parts involved in {topic}.",
        "Write a list of observations about {topic}.",
    ),
    "block": (
        "Write a short piece about {topic}.",
        "Write a few blocks of prose about {topic}.",
    ),
}

# Family, dimension, mode, unique, items, least and largest target, form.
FAMILIES = (
    ("words_exact", "words", "exact", False, 80, 15, 120, "prose"),
    ("sentences_exact", "sentences", "exact", False, 70, 2, 8, "prose"),
    ("bullets_exact", "bullets", "exact", False, 70, 3, 12, "list"),
    ("unique_items", "bullets", "exact", True, 60, 5, 15, "list"),
    ("chars_exact", "chars", "exact", False, 50, 60, 300, "prose"),
    ("lines_exact", "lines", "exact", False, 45, 3, 10, "list"),
    ("paragraphs_exact", "paragraphs", "exact", False, 45, 2, 6, "block"),
    ("sentences_at_most", "sentences", "at_most", False, 40, 2, 6, "prose"),
    ("words_at_least", "words", "at_least", False, 40, 20, 100, "prose"),
)
SEED = 20260829

# How prompts name the dimensions, and their last paragraph.
NOUNS = {"words": "words", "sentences": "sentences", "bullets": "bullets", "chars": "characters", "lines": "lines", "paragraphs": "paragraphs"}
HEADINGS = {k: f"HOW {v.upper()} ARE COUNTED" for k, v in NOUNS.items()}
TAIL = "Reply with the answer text only. Do not add a title, a preamble, a closing remark, or a count of your own."

#: Openings of composed sentences and items. Some hold a decimal or an abbreviation, which naive rules stumble over.
SENTENCES = (
    "People who study {k} rarely agree",
    "Prof. Adair measured the {k} for years",
    "About 4.5 parts in ten concern the {k}",
    "Start with the {k} and work outwards",
    "Some guides, e.g. the oldest, begin with {k}",
    "Little of this would hold without {k}",
    "It took 1.5 days until the {k} was ready",
    "Mt. Corin gave the {k} its reputation",
)
ITEMS = (
    "Look for the {k} first",
    "Wet days alter the {k}",
    "Few books describe the {k} well",
    "Patience helps with the {k}",
    "An early drawing shows the {k}",
    "Nothing moves before the {k} does",
    "The {k} differs from place to place",
    "Ask twice about the {k}",
)


def filler(length: int, n: int = 20) -> list[str]:
    """``n`` made-up words of one length: consonants and vowels in turn, by a rule, so no list is kept."""
    consonants, vowels = "bdfglmnprstvz", "aeiou"
    if length == 1:
        return ["a"] * n
    return ["".join((consonants, vowels)[j % 2][(7 * i + 3 * j + i * j) % (13, 5)[j % 2]] for j in range(length)) for i in range(n)]
