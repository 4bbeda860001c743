"""Fixed values that results depend on: word lists, synonyms, prefixes, labels. `strict` is the default form, `loose` the variant."""

# --- fixed values: irregular plurals
IRREGULAR = {
    "mice": "mouse", "geese": "goose", "feet": "foot", "teeth": "tooth", "fish": "fish", "sheep": "sheep", "deer": "deer", "children": "child", "people": "person",
    "rhombuses": "rhombus", "buses": "bus", "foxes": "fox", "boxes": "box", "taxes": "tax", "axes": "axis", "vertices": "vertex", "indices": "index", "matrices": "matrix",
    "appendices": "appendix", "radii": "radius",
}
STRICT_ONLY_IRREGULAR = ("appendices", "radii")

# --- fixed values: synonyms of predicates and of properties (the latter in the loose form only)
PREDICATE_SYNONYMS = {"living things": "living_thing", "living thing": "living_thing", "living": "living_thing", "warm blooded": "warm_blooded", "cold blooded": "cold_blooded"}
PROPERTY_SYNONYMS = {"warm blood": "warm_blooded", "cold blood": "cold_blooded", "equal sides": "equal_sides", "a brain": "brain", "a heart": "heart", "a backbone": "backbone", "a beak": "beak", "a radius": "radius"}

# --- fixed values: openings of a consequence, in the order in which they are tried
OPENINGS = ("is there", "is the", "does it", "is it", "is", "does", "do we need")
LOOSE_OPENINGS = ("is there", "is the", "does it", "is it", "is", "does")
STOP_WORDS = ("is", "are", "the", "a", "an", "do", "does", "we")

# --- fixed values: words of an answer
YES_EXACT = ("true", "1", "correct", "right")
NO_EXACT = ("false", "0", "incorrect", "wrong")
NEGATIVE = ("not ", "isn't", "aren't", "doesn't", "don't", "cannot", "never", "false", "wrong", "incorrect", "no,")
POSITIVE = ("yes,", "yes.", "correct", "true", "indeed", "all are", "always", "absolutely", "certainly")
ERROR_REPLY = "[llm_error]"

# --- fixed values: labels
TYPES = ("taxonomic", "categorical", "hypothetical")
PATTERNS = ("taxonomic", "categorical", "hypothetical", "other")
CERTAIN, DENIED, UNKNOWN, UNKNOWN_LOOSE = "YAQEEN", "WAHM", "UNKNOWN", "SHAKK"
