"""Text normalisation, tokens and stemming as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that matching ignores, beside the wild card.
PUNCTUATION = "&/\\#,+()$~%.!^'\";:?[]<>{}"
#: The ranges that have letters with marks, and marks.
_CODES = [*range(0xC0, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0100, 0xE01F0)]
#: White space that separates words, by a text field's option `separators`.
WHITE = {
    "unicode": r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]",
    "ascii": r"[\t\n\f\r ]",
}


def _bare(letter: str) -> str:
    """Without marks; nothing of a mark.  What doesn't decompose, like sharp s, stays."""
    base = (c for c in unicodedata.normalize("NFD", letter) if not unicodedata.category(c).startswith("M"))
    return unicodedata.normalize("NFC", "".join(base))


# a capital sigma is small here already: lower-casing would make a final one of it at the end of a word
_PAIRS = [(chr(c), _bare(chr(c))) for c in _CODES if _bare(chr(c)) != chr(c)] + [("\u03a3", "\u03c3")]
_PAIRS.sort(key=lambda pair: not pair[1])
MARKED = "".join(a for a, _ in _PAIRS)
#: Shorter than MARKED: the marks, which are last there, have nothing here.
UNMARKED = "".join(b for _, b in _PAIRS)


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"


def normalised(text: Column, wild: bool = False) -> Column:
    """Without punctuation and marks, in lower case; wild keeps '*'."""
    chars = PUNCTUATION if wild else PUNCTUATION + "*"
    bare = F.regexp_replace(text, _class(chars), "")
    # translating is a dear step, and an ASCII text has no marks
    unmarked = F.translate(bare, MARKED, UNMARKED)
    # the byte that begins such letters in UTF-8 is found sooner than the letters
    apart = F.contains(bare.cast("binary"), F.lit(b"\xe1")) & bare.rlike(f"[{_MIDDLE}{_LAST}]")
    whole = F.when(apart, _syllables(unmarked)).otherwise(unmarked)
    return F.when(F.octet_length(text) == F.length(text), F.lower(bare)).otherwise(F.lower(whole))


#: Hangul letters that begin a syllable, are its middle or its end, and whole syllables.
_FIRST, _MIDDLE, _LAST, _SYLLABLE = "\u1100-\u1112", "\u1161-\u1175", "\u11a8-\u11c2", "\uac00-\ud7a3"
_PARTS = f"(?s)[{_FIRST}][{_MIDDLE}][{_LAST}]?|[{_SYLLABLE}][{_LAST}]|[^{_FIRST}{_SYLLABLE}]+|."
#: As SQL, since every call of a column function costs a round trip.  A syllable that has its end takes no other.
_COMPOSE = f"""p -> coalesce(decode(unhex(hex(case
    when p rlike '^[{_FIRST}][{_MIDDLE}]' then {0xAC00} + ((ascii(p) - {0x1100}) * 21 + ascii(substr(p, 2)) - {0x1161}) * 28
        + greatest(ascii(substr(p, 3)) - {0x11A7}, 0)
    when p rlike '^[{_SYLLABLE}].' and (ascii(p) - {0xAC00}) % 28 = 0 then ascii(p) + ascii(substr(p, 2)) - {0x11A7} end)), 'UTF-16BE'), p)"""


def _syllables(text: Column) -> Column:
    """Hangul letters that make a syllable -> the syllable."""
    parts = F.regexp_extract_all(text, F.lit(_PARTS), 0)
    return F.array_join(F.call_function("transform", parts, F.expr(_COMPOSE)), "")


_DROP = {ord(c): None for c in PUNCTUATION}
_FOLD = {ord(a): b for a, b in _PAIRS}


def normalise(text: str, wild: bool = False) -> str:
    """`normalised` for a constant on the driver."""
    out = str(text).translate(_DROP)
    bare = (out if wild else out.replace("*", "")).translate(_FOLD)
    return unicodedata.normalize("NFC", bare).lower()


def tokens(text: Column, stop: tuple[str, ...] = (), separators: str = "unicode") -> Column:
    """Normalised words in order, repeats included; null for null."""
    words = F.array_remove(F.split(normalised(text), WHITE[separators]), "")
    return F.filter(words, lambda t: ~t.isin(*stop)) if stop else words


def tokenise(text: str, separators: str = "unicode") -> list[str]:
    return [t for t in re.split(WHITE[separators], normalise(text, wild=True)) if t]


#: English words that carry no topic.
ENGLISH_STOP = """
a about above after again all also am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers him his how i if in
into is it its itself just me more most my no nor not of off on once only or other our out over own same she should so
some such than that the their them then there these they this those through to too under until up very was we were what
when where which while who whom why will with would you your
""".split()
LANGUAGES = {"da": "danish", "de": "german", "es": "spanish", "fi": "finnish", "fr": "french",
             "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese",
             "ru": "russian", "sv": "swedish", "tr": "turkish"}


@cache
def stop_words(lang: str = "en") -> tuple[str, ...]:
    """Normalised stop words of a language: English from ENGLISH_STOP, others from Spark's own lists,
    none for languages without one."""
    if lang == "en":
        return tuple(ENGLISH_STOP)
    if lang not in LANGUAGES:
        return ()
    from pyspark.ml.feature import StopWordsRemover

    return tuple(sorted({normalise(w) for w in StopWordsRemover.loadDefaultStopWords(LANGUAGES[lang])}))


# --- English stemming (the published Porter2 rules) -------------------------------------------

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Exceptional forms, suffix replacements.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
         "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
          "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
          "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
          "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Starts of the two regions: after the first non-vowel that follows a vowel, twice."""
    found = re.match(r"gener|commun|arsen", word) or re.match(r"[^aeiouy]*[aeiouy]+[^aeiouy]", word)
    first = found.end() if found else len(word)
    again = re.match(r"[^aeiouy]*[aeiouy]+[^aeiouy]", word[first:])
    return first, first + again.end() if again else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in WHOLE or word in SAME:
        return WHOLE.get(word, word)
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    first, second = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    # past and progressive
    if word.endswith(("eedly", "eed")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= first:
            word = word[:-cut] + "ee"
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if word.endswith(suffix):
                rest = word[: -len(suffix)]
                if re.search(r"[aeiouy]", rest):
                    if rest.endswith(("at", "bl", "iz")):
                        rest += "e"
                    elif rest.endswith(DOUBLES):
                        rest = rest[:-1]
                    elif _short_end(rest) and first >= len(rest):
                        rest += "e"
                    word = rest
                break
    if re.search(r".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"
    # derivations
    for suffix in sorted([*SECOND, "ogi", "li"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= first:
                if suffix == "ogi":
                    word = word[:-1] if word[at - 1] == "l" else word
                elif suffix == "li":
                    word = word[:-2] if word[at - 1] in "cdeghkmnrt" else word
                else:
                    word = word[:at] + SECOND[suffix]
            break
    for suffix in sorted([*THIRD, "ative"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if suffix == "ative":
                word = word[:at] if at >= second else word
            elif at >= first:
                word = word[:at] + THIRD[suffix]
            break
    for suffix in sorted([*FOURTH, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= second and (suffix != "ion" or word[at - 1] in "st"):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or (at >= first and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


STEMMERS = {"en": stem_english}


def stems(words: Column, lang: str = "en") -> Column:
    """Stems of an array of words (Arrow batches); languages without a stemmer pass unchanged."""
    rule = STEMMERS.get(lang)
    if rule is None:
        return words

    @F.arrow_udf("array<string>")
    def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for batch in batches:
            # each distinct word of a batch is stemmed once; lists are put together again by position
            coded = batch.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            for w in distinct:
                if w not in known:
                    known[w] = rule(w)
            found = pa.array([known[w] for w in distinct], pa.string()).take(coded.indices)
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(ends, found, mask=batch.is_null())
            if len(known) > 1 << 18:
                known.clear()

    return stemmed(words)
