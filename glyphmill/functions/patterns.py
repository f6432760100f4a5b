"""Catalogue of pretoken patterns, put together from named parts, and their two regex dialects.

`regex` (Python) is authoritative. `java` gives a form for Spark's built-in functions, or None where
Java's engine lacks what a pattern needs.
"""

from __future__ import annotations

import re


def _one(*categories: str) -> str:
    """A class of Unicode categories; a name of more than two letters is taken as it stands."""
    return "[" + "".join(rf"\p{{{c}}}" if len(c) <= 2 else c for c in categories) + "]"


def _any(*branches: str) -> str:
    return "|".join(branches)


ZWJ, CURLY = r"\u200d", r"\u2019"
LETTER, NUMBER, MARK = r"\p{L}", r"\p{N}", r"\p{M}"
TAIL_SPACE = (r"\s+(?!\S)", r"\s+")
_OTHER = r" ?[^\s" + LETTER + NUMBER + "]"
_SHORT = ("s", "t", "m", "d", "re", "ve", "ll")
_LONE_PREFIX = r"[^\r\n" + LETTER + NUMBER + "]"

GPT2 = _any("'(?:" + "|".join(_SHORT) + ")", f" ?{LETTER}+", f" ?{NUMBER}+", _OTHER + "+", *TAIL_SPACE)

GPT4 = _any("'(?i:" + "|".join(_SHORT) + ")", _LONE_PREFIX + f"?+{LETTER}+", NUMBER + "{1,3}", _OTHER + "++" + r"[\r\n]*", r"\s*[\r\n]", *TAIL_SPACE)

_UPPER, _LOWER = ("Lu", "Lt", "Lm", "Lo", "M"), ("Ll", "Lm", "Lo", "M")
_CONTRACTED = "(?i:" + "|".join("'" + s for s in _SHORT) + ")?"
_GPT4O_END = (NUMBER + "{1,3}", _OTHER + "+" + r"[\r\n/]*", r"\s*[\r\n]+", *TAIL_SPACE)
GPT4O = _any(_LONE_PREFIX + "?" + _one(*_UPPER) + "*" + _one(*_LOWER) + "+" + _CONTRACTED, _LONE_PREFIX + "?" + _one(*_UPPER) + "+" + _one(*_LOWER) + "*" + _CONTRACTED, *_GPT4O_END)

_CHARACTER = f" ?{LETTER}{MARK}*"
CHARACTER_GPT4O = _any(_CHARACTER, *_GPT4O_END)



def _counted_from_right(group: str, end: str) -> str:
    """Up to three, where a multiple of three follows."""
    return group + "{1,3}(?=(?:" + group + "{3})*(?:" + end + "|$))"


FULL = _any(
    "'(?i:" + "|".join(_SHORT) + ")", rf" ?[\p{{Lu}}]+(?=[\p{{Lu}}][\p{{Ll}}])", r" ?[\p{Lu}]?[\p{Ll}]+", r" ?[\p{Lu}]+", " ?" + _one("Lt", "Lm", "Lo") + "+",
    _counted_from_right(NUMBER, r"\P{N}"), _OTHER + "++" + r"[\r\n]*", r"\s*[\r\n]", r"\s+",
)


def _marked(category: str) -> str:
    return rf"(?:{category}{MARK}*)"


_ANY_LETTER, _CAPITAL, _SMALL = (_marked(rf"\p{{{c}}}") for c in ("L", "Lu", "Ll"))
_DIGIT = _marked(NUMBER)
ULTIMATE = _any(
    f" ?{_ANY_LETTER}+['{CURLY}]{_ANY_LETTER}+", f"_{_SMALL}+", f" ?{_CAPITAL}+(?={_CAPITAL}{_SMALL})", f" ?{_CAPITAL}?{_SMALL}+", f" ?{_CAPITAL}+", " ?" + _marked(_one("Lt", "Lm", "Lo")) + "+",
    _counted_from_right(_DIGIT, _marked(r"\P{N}")), _marked(_one("P", "S")) + "+", r"[^\S\r\n]*[\r\n]+", r"[^\S\r\n]+", _marked(_one("Z", "C")) + "+", MARK + "+", ".+",
)

_PICTURE = r"\p{Extended_Pictographic}[\U0001F3FB-\U0001F3FF]?[\ufe0e\ufe0f]?"
_COMMON = (
    r"[#*0-9]\ufe0f?\u20e3", r"[\U0001F1E6-\U0001F1FF]{2}", f"{_PICTURE}(?:{ZWJ}{_PICTURE})*", " ?" + _marked(_one("S", "P")) + "{1,16}", r"[^\S\r\n]{0,16}[\r\n]{1,16}",
    r"[^\S\r\n]{1,16}(?![^\s" + r"\p{N}\p{C}\p{M}])", r"\s{1,16}", _counted_from_right(NUMBER, r"\P{N}"), _one("Z", "C", "M") + "+",
)
_ENDING = f"(?:['{CURLY}]" + _one(*_LOWER) + "+)?"
WORD_LEVEL = _any(" ?" + _one(*_UPPER, ZWJ) + "*" + _one(*_LOWER, ZWJ) + "+" + _ENDING, " ?" + _one(*_UPPER, ZWJ) + "+" + _one(*_LOWER, ZWJ) + "*" + _ENDING, *_COMMON)
CHARACTER = _any(_CHARACTER, *_COMMON)

#: Scripts that are split into characters by default.
CHARACTER_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Myanmar", "Khmer", "Lao")

MERGE_SIMPLE = LETTER
MERGE_IMPROVED = rf"^(?=.+{LETTER})(?:{LETTER}{MARK}*|[ _'{CURLY}])+$"
_ASCII = "[ _'a-zA-Z]*"
MERGE_ORIGINAL = f"^{_ASCII}[a-zA-Z]{_ASCII}$"
MERGE_SUPERWORD = "^(?:" + _any(f" ?{_ANY_LETTER}+['{CURLY}]{_ANY_LETTER}+", f"_{_SMALL}+", f" ?{_CAPITAL}?{_SMALL}+", f" ?{_CAPITAL}+", " ?" + _marked(_one("Lt", "Lm", "Lo")) + "+") + ")$"

CATALOGUE = {"gpt2": GPT2, "gpt4": GPT4, "gpt4o": GPT4O, "full": FULL, "ultimate": ULTIMATE, "word_level": WORD_LEVEL, "character": CHARACTER, "character_gpt4o": CHARACTER_GPT4O}


def java(pattern: str) -> str | None:
    """The pattern for Java with Unicode classes, or None where it can't be expressed there."""
    if "Extended_Pictographic" in pattern or r"\p{Script" in pattern:
        return None
    wide = re.sub(r"\\U([0-9A-Fa-f]{8})", lambda m: rf"\x{{{int(m.group(1), 16):X}}}", pattern)
    return "(?U)" + wide
