"""English suffix stemming (the published Porter2 algorithm), as a plain function and an Arrow-batched column function."""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize",
    "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(word: str) -> tuple[int, int]:
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if start is None:
        m = _REGION.search(word)
        start = m.end() if m else len(word)
    m = _REGION.search(word, start)
    return start, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _longest(word: str, endings) -> str | None:
    found = [e for e in endings if word.endswith(e)]
    return max(found, key=len) if found else None


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub(f"(^|[{VOWELS}])y", r"\1Y", word.lstrip("'"))
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)][-1:]
        if not (end == "ogi" and before != "l") and not (end == "li" and before not in LI_ENDINGS):
            word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and not (end == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def with_stems(terms: pd.Series) -> pd.Series:
    """Each lower-case ASCII term followed by its stem where that differs; other terms as they are."""

    def both(row):
        out: dict[str, None] = {}
        for t in row if row is not None else []:
            out[t] = None
            if t.isascii() and t.isalpha():
                out[stem(t)] = None
        return list(out)

    return terms.map(both)


#: Rows whose words are Python strings at a time; the others of a batch stay in Arrow.
ROWS = 256


@F.arrow_udf(ArrayType(StringType()))
def variants_with_stems(variants: pa.Array) -> pa.Array:
    """Each term's variants with their stems, each once within its term, all terms one after another."""

    def lengths(lists: pa.Array) -> list[int]:
        return pc.fill_null(pc.list_value_length(lists), 0).to_pylist()

    def flat(rows: pa.Array) -> pa.Array:
        terms = rows.flatten()
        words, sizes = terms.flatten().to_numpy(zero_copy_only=False), lengths(terms)
        out: list[str] = []
        ends, term, at = [0], 0, 0
        for n in lengths(rows):
            for size in sizes[term : term + n]:
                seen: dict[str, None] = {}
                for t in words[at : at + size]:
                    seen[t] = None
                    if t.isascii() and t.isalpha():
                        seen[stem(t)] = None
                out += seen
                at += size
            term += n
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()))

    parts = [flat(variants.slice(at, ROWS)) for at in range(0, len(variants), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))
