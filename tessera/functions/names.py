"""Multi-script name normalisation as column expressions; no Python runs per row.

A name in Kannada or Latin script becomes its folded tokens, initials and markers, so that the spellings of one person in
two scripts meet in the same tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kannada letters and signs with their Latin forms.
CONSONANTS = {
    "ಕ": "k", "ಖ": "kh", "ಗ": "g", "ಘ": "gh", "ಙ": "ng",
    "ಚ": "c", "ಛ": "ch", "ಜ": "j", "ಝ": "jh", "ಞ": "ny",
    "ಟ": "t", "ಠ": "th", "ಡ": "d", "ಢ": "dh", "ಣ": "n",
    "ತ": "t", "ಥ": "th", "ದ": "d", "ಧ": "dh", "ನ": "n",
    "ಪ": "p", "ಫ": "ph", "ಬ": "b", "ಭ": "bh", "ಮ": "m",
    "ಯ": "y", "ರ": "r", "ಱ": "r", "ಲ": "l", "ಳ": "l",
    "ವ": "v", "ಶ": "sh", "ಷ": "sh", "ಸ": "s", "ಹ": "h",
    "ೞ": "zh",
}
VOWELS = {
    "ಅ": "a", "ಆ": "aa", "ಇ": "i", "ಈ": "ii", "ಉ": "u", "ಊ": "uu", "ಋ": "ri", "ೠ": "ri", "ಌ": "lu", "ೡ": "lu",
    "ಎ": "e", "ಏ": "ee", "ಐ": "ai", "ಒ": "o", "ಓ": "oo", "ಔ": "au",
}
SIGNS = {
    "ಾ": "aa", "ಿ": "i", "ೀ": "ii", "ು": "u", "ೂ": "uu", "ೃ": "ri", "ೄ": "ri", "ೆ": "e", "ೇ": "ee", "ೈ": "ai",
    "ೊ": "o", "ೋ": "oo", "ೌ": "au",
}
OTHER_SIGNS = {"ಂ": "n", "ಃ": "h"}
VIRAMA, NUKTA, AVAGRAHA = "್", "಼", "ಽ"
# Canonical compositions within the script, in order.
COMPOSED = [("ಿ" + "ೕ", "ೀ"), ("ೆ" + "ೕ", "ೇ"), ("ೆ" + "ೖ", "ೈ"), ("ೆ" + "ೂ", "ೊ"), ("ೊ" + "ೕ", "ೋ")]
# Words that state a relation or an honour, not a name.
MARKERS = [
    "so", "do", "wo", "co", "son", "daughter", "wife", "care", "bin", "binte", "alias", "aliyas", "aliyaas", "tande", "tandi",
    "tayi", "sri", "shri", "srii", "shrii", "smt", "smti", "srimati", "shrimati", "kum", "kumari", "mr", "mrs", "ms",
]
# Letter groups and what they fold to, applied one after another.
FOLDS = [
    ("ksh", "ks"), ("x", "ks"), ("chh", "c"), ("ch", "c"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("th", "t"),
    ("dh", "d"), ("bh", "b"), ("ph", "f"), ("f", "p"), ("ow", "au"), ("aw", "au"), ("w", "v"), ("z", "j"), ("q", "k"),
]
RELATION = "\\b([sdwc])\\s*[/\\\\]\\s*o\\.?"


def _replaced(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def has_kannada(name: Column) -> Column:
    return name.rlike("[\\x{0C80}-\\x{0CFF}]")


def script(name: Column) -> Column:
    """kannada, latin or mixed."""
    return F.when(has_kannada(name) & name.rlike("[A-Za-z]"), "mixed").when(has_kannada(name), "kannada").otherwise("latin")


def transliterate(name: Column) -> Column:
    """Latin form of a name; text in other scripts is copied.

    A consonant keeps its inherent vowel unless a virama or vowel sign follows it directly.
    """
    letters, signs = "".join(CONSONANTS), "".join(SIGNS)
    text = _replaced(F.regexp_replace(name, "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]", ""), COMPOSED)
    text = F.regexp_replace(text, f"([{letters}])(?![{VIRAMA}{signs}])", "$1a")
    text = F.regexp_replace(text, f"(?<=[{letters}]){VIRAMA}", "")
    text = F.regexp_replace(text, f"(?<![{letters}])[{VIRAMA}{signs}{NUKTA}{AVAGRAHA}]", "")
    text = F.regexp_replace(text, f"[{NUKTA}{AVAGRAHA}]", "")
    single = {k: v for table in (CONSONANTS, VOWELS, SIGNS, OTHER_SIGNS) for k, v in table.items() if len(v) == 1}
    longer = [(k, v) for table in (CONSONANTS, VOWELS, SIGNS) for k, v in table.items() if len(v) > 1]
    spelled = _replaced(F.translate(text, "".join(single), "".join(single.values())), longer)
    return F.when(has_kannada(name), spelled).otherwise(F.regexp_replace(name, "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]", ""))


def fold(token: Column, glides: bool = True) -> Column:
    """One spelling for tokens that are written in different ways. glides: also fold y and nasals (off in the baseline)."""
    t = F.regexp_replace(token, "[^a-z]", "")
    if glides:
        t = F.when(F.length(t) > 1, F.regexp_replace(F.regexp_replace(t, "(?<=[^aeiou])y$", "i"), "(?<=[aeiou])y", "")).otherwise(t)
    t = _replaced(t, FOLDS)
    if glides:
        t = F.regexp_replace(t, "[mn](?=[bcdgjklmnprstv])", "n")
    t = F.regexp_replace(t, "[aeiou]*[uo][aeiou]*", "U")
    t = F.regexp_replace(t, "[aei]*[ie][aei]*", "I")
    t = F.lower(F.regexp_replace(t, "a+", "A"))
    return F.regexp_replace(F.regexp_replace(t, "(.)\\1+", "$1"), "[aiu]+$", "")


def _parts(name: Column) -> Column:
    latin = F.regexp_replace(F.lower(transliterate(F.coalesce(name, F.lit("")))), RELATION, " ")
    return F.filter(F.split(latin, "[^a-z]+"), lambda p: p != "")


def normalised(name: Column) -> Column:
    """Struct of tokens (in order), initials (sorted, distinct), markers and script."""
    parts = _parts(name)
    words = F.filter(parts, lambda p: ~p.isin(MARKERS))
    folded = F.transform(words, lambda p: F.when(F.length(p) > 1, fold(p)).otherwise(p))
    return F.struct(
        F.filter(folded, lambda p: F.length(p) >= 2).alias("tokens"),
        F.array_sort(F.array_distinct(F.filter(folded, lambda p: F.length(p) == 1))).alias("initials"),
        F.filter(parts, lambda p: p.isin(MARKERS)).alias("markers"),
        script(name).alias("script"),
    )


def canonical(norm: Column) -> Column:
    """Sorted tokens as one key."""
    return F.array_join(F.array_sort(norm["tokens"]), " ")


def letters(norm: Column) -> Column:
    """First letters of the tokens, and the initials."""
    return F.array_union(F.transform(norm["tokens"], lambda t: F.substring(t, 1, 1)), norm["initials"])


def baseline_key(name: Column) -> Column:
    """The simpler key of the exact-name baseline: no rules for y and nasals, distinct tokens."""
    words = F.filter(_parts(name), lambda p: ~p.isin(MARKERS) & (F.length(p) > 1))
    tokens = F.filter(F.transform(words, lambda p: fold(p, glides=False)), lambda t: F.length(t) >= 2)
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def phonetic_code(name: Column) -> Column:
    """Soundex of the Latin form without spaces or marks."""
    return F.soundex(F.regexp_replace(F.upper(transliterate(name)), "[^A-Z]", ""))
