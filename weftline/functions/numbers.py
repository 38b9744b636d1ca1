"""Spelled-out English numbers as digits, exact for any size.

A run of number words is read by a small grammar: groups below a hundred, hundreds, then powers of a thousand;
digits spoken one by one are joined, as are two numbers below a hundred ('nineteen eighty four'); 'point' starts decimals; ordinals and plurals keep their ending; a sign word or a
currency word next to a number becomes a prefix, 'percent' a suffix; 'and' binds only between a hundred or a higher
power and what follows, 'and a half' adds .5, 'double' and 'triple' repeat a digit.
"""

from __future__ import annotations

import re
from fractions import Fraction

# Number words.
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
POWERS = {w: 1000**i for i, w in enumerate("thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split(), 1)}
ZEROS = {"o", "oh", "zero"}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
CURRENCIES = {"pound": "£", "pounds": "£", "euro": "€", "euros": "€", "dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢"}
REPEATS = {"double": 2, "triple": 3}


def _endings() -> dict[str, tuple[str, str]]:
    """Ordinals and plurals: word -> (cardinal word, ending)."""
    out = {}
    for w in [*list(ONES)[1:], *TENS, "hundred", *POWERS]:
        stem = w[:-1] + "ie" if w.endswith("y") else w
        out[{"six": "sixes"}.get(w, stem + "s")] = (w, "s")
        out[{"five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}.get(w, stem + "th")] = (w, "th")
    out |= {"zeroth": ("zero", "th"), "first": ("one", "st"), "second": ("two", "nd"), "third": ("three", "rd")}
    return out


ENDINGS = _endings()
_NUMERAL = re.compile(r"([$€£¢+-]?)(\d+(?:\.\d+)?)(%|st|nd|rd|th|s)?\Z")


def _text(value: Fraction) -> str:
    if value.denominator == 1:
        return str(value.numerator)
    whole, rest = divmod(value, 1)
    places = ""
    while rest and len(places) < 30:
        digit, rest = divmod(rest * 10, 1)
        places += str(digit)
    return f"{whole}.{places}"


class _Reader:
    """Reads one number from position ``i`` of the words; ``take`` gives its text or None."""

    def __init__(self, words: list[str]):
        self.words = words

    def word(self, i: int) -> str:
        return self.words[i] if i < len(self.words) else ""

    def is_number(self, i: int) -> bool:
        w = self.word(i)
        return w in ONES or w in TENS or w in ("hundred", "o", "oh") and i > 0 or w in POWERS or bool(_NUMERAL.match(w)) or w in REPEATS

    def single(self, i: int) -> tuple[str, int]:
        """A run of digits spoken one by one ('one oh five'), with 'double' and 'triple'."""
        out = ""
        while True:
            w, times = self.word(i), 1
            if w in REPEATS and (self.word(i + 1) in ZEROS or 0 < ONES.get(self.word(i + 1), 10) < 10):
                times, w = REPEATS[w], self.word(i + 1)
            if w in ZEROS:
                out += "0" * times
            elif w in ONES and ONES[w] < 10 and self.word(i + times - 1 if times == 1 else i + 1) == w:
                out += str(ONES[w]) * times
            else:
                return out, i
            i += 1 if times == 1 else 2

    def take(self, i: int) -> tuple[str, int] | None:
        start, total, group, ending, prefix, used = i, Fraction(0), None, "", "", False
        text, after = self.single(i)
        if len(text) > 1:
            used, i = True, after
        else:
            text = ""
        while not text and i < len(self.words) and not ending:
            w = self.words[i]
            if w in ENDINGS and not (w == "second" and not used):
                base, kind = ENDINGS[w]
            else:
                base, kind = w, ""
            m = _NUMERAL.match(w)
            if m and group is None and not used:
                prefix, group, kind = m.group(1) if m.group(1) not in "+-" else "", Fraction(m.group(2)), m.group(3) or ""
                if m.group(1) in ("+", "-") and m.group(1):
                    prefix = m.group(1)
            elif base in ONES and base != "zero" and (group is None or group % 100 == 0 and group < 1000 and group or (group % 100 >= 20 and group % 10 == 0 and ONES[base] < 10)):
                group = (group or 0) + ONES[base]
            elif base in TENS and (group is None or group % 100 == 0 and group < 1000):
                group = (group or 0) + TENS[base]
            elif base == "hundred" and (group is not None and group < 100 or group is None and not used):
                group = (1 if group is None else group) * 100
            elif base in POWERS and (group is not None or not used):
                total, group = total + (1 if group is None else group) * POWERS[base], None
            elif w == "zero" and not used:
                group = Fraction(0)
            elif w == "and" and used and (group is not None and group % 100 == 0 or group is None) and self.is_number(i + 1):
                i += 1
                continue
            else:
                break
            used, ending, i = True, kind, i + 1
        if not used:
            return None
        value = total + (group or 0)
        text = text or _text(value)
        following = self.word(i)
        if not ending and not total and group is not None and 10 <= group <= 99 and text.isdigit() and (following in TENS or ONES.get(following, 0) >= 10 or ENDINGS.get(following, ("",))[0] in TENS):
            more = self.take(i)  # years and the like: two numbers below a hundred, said one after the other
            if more and re.fullmatch(r"\d\d(st|nd|rd|th|s)?", more[0]):
                return prefix + text + more[0], more[1]
        if not ending and self.words[i : i + 3] == ["and", "a", "half"] and "." not in text:
            text, i = _text(value + Fraction(1, 2)), i + 3
        if not ending and self.word(i) == "point":
            places, after = self.single(i + 1)
            if places:
                text, i = f"{text}.{places}", after
                if self.word(i) in POWERS:
                    text, i = _text(Fraction(text) * POWERS[self.word(i)]), i + 1
        if self.word(i) in CURRENCIES and not prefix and not ending:
            prefix, i = CURRENCIES[self.word(i)], i + 1
        if self.word(i) == "percent" or self.word(i) == "per" and self.word(i + 1) == "cent":
            ending, i = "%", i + (1 if self.word(i) == "percent" else 2)
        return (prefix + text + ending, i) if i > start else None


def digits(text: str) -> str:
    """The text with its spelled-out numbers in digits; 'one' and 'ones' alone stay words."""
    words = re.sub(r"\s+", " ", text).strip().split(" ")
    reader, out, i = _Reader(words), [], 0
    while i < len(words):
        sign = SIGNS.get(words[i], "")
        got = reader.take(i + 1) if sign else reader.take(i)
        if got is None or (not sign and words[i] in ("one", "ones") and got[1] == i + 1):
            out.append(words[i])
            i += 1
        else:
            out.append(sign + got[0] if sign and got[0][0] not in "+-" else got[0])
            i = got[1]
    return " ".join(out)
