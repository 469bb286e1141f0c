"""Texts that look the same in one consistent form.

The visible form of a text has composed accents, letters of one script for letters drawn alike, one width, one kind of
space, and no zero-width characters. Case, accents, digits, punctuation, line ends and the number of spaces stay.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

#: Letters of other scripts and the Latin letters that they are drawn like, in the same order.
CYRILLIC = "АВЕКМНОРСТУХЅІЈҮԌԚԜѴаеорсухѕіјүһԁԛԝѵӏ"
CYRILLIC_AS = "ABEKMHOPCTYXSIJYGQWVaeopcyxsijyhdqwvl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿορνϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXJopvcj"
OTHERS = "ɡօսհոԼՕՏᏔᎠᎢᏚᏢᎪᎬᎳᎷᎻᏀᏃᏞᏟᏦꓐꓑꓒꓓꓔꓖꓗꓙꓚꓝꓠꓡꓢꓪꓫꓬꓮꓰꓲꓳꓴꓦꓜ"
OTHERS_AS = "gouhnLOSWDTSPAEWMHGZLCKBPdDTGKJCFNLSWXYAEIOUVZ"
#: Characters without width.
ZERO_WIDTH = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"


@functools.cache
def visible_map() -> dict[str, str]:
    """Character to its visible form, for the characters that change one by one.

    Width forms and spaces come from the Unicode tables by rule, and so do accented letters whose base letter changes.
    """
    out = dict.fromkeys(ZERO_WIDTH, "")
    for there, here in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (OTHERS, OTHERS_AS)):
        out |= dict(zip(there, here, strict=True))
    letters = dict(out)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        kind, _, to = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif kind in ("<wide>", "<narrow>"):
            plain = "".join(chr(int(x, 16)) for x in to.split())
            out[c] = letters.get(plain, plain)
        elif kind and not kind.startswith("<"):
            parts = unicodedata.normalize("NFD", c)
            seen = unicodedata.normalize("NFC", "".join(letters.get(p, p) for p in parts))
            if seen != c:
                out[c] = seen
    out[" "] = " "
    return {k: v for k, v in out.items() if k != v}


@functools.cache
def _table() -> dict[int, str]:
    return str.maketrans(visible_map())


def visible(text: str) -> str:
    """The visible form of a text; texts look the same if and only if their visible forms are equal."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_table()))


@functools.cache
def translate_args() -> tuple[str, str]:
    """Both strings for SQL's translate(): one-to-one changes first, then the characters that go."""
    one = {k: v for k, v in visible_map().items() if len(v) == 1}
    gone = [k for k, v in visible_map().items() if not v]
    return "".join(one) + "".join(gone), "".join(one.values())


@functools.cache
def coarse_args() -> tuple[str, str]:
    """Both strings for SQL's translate() to a coarser form, equal at least for texts that look the same.

    It is the visible form without accents: letters lose what canonical decomposition splits off, combining marks go,
    and so do Hangul syllables and their letters, and whatever has a longer visible form.
    """
    one, gone = {}, set()
    mapped = visible_map()
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if not c.isascii() and not 0xD800 <= code <= 0xDFFF:
            parts = unicodedata.normalize("NFD", "".join(mapped.get(p, p) for p in unicodedata.normalize("NFD", mapped.get(c, c))))
            base = "".join(p for p in parts if not unicodedata.category(p).startswith("M"))
            hangul = any(0x1100 <= ord(p) <= 0x11FF or 0xA960 <= ord(p) <= 0xA97F or 0xD7B0 <= ord(p) <= 0xD7FF for p in parts)
            if hangul or len(base) != 1:
                gone.add(c)
            elif base != c:
                one[c] = base
    return "".join(one) + "".join(sorted(gone)), "".join(one.values())
