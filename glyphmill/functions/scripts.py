"""Which Unicode script a character belongs to, as a flat table of small numbers.

The table is derived from the scripts that the installed `regex` module knows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

UNKNOWN, COMMON, INHERITED = 0, 1, 2
NAMES = (
    "Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Coptic Cuneiform Cypriot Cypro_Minoan Cyrillic Deseret Devanagari Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Garay Georgian Glagolitic Gothic Grantha Greek Gujarati Gunjala_Gondi Gurmukhi Gurung_Khema Han Hangul Hanifi_Rohingya Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Katakana Kawi Kayah_Li Kharoshthi Khitan_Small_Script Khmer Khojki Khudawadi Kirat_Rai Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar Malayalam Mandaic Manichaean Marchen Masaram_Gondi Medefaidrin Meetei_Mayek Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean Nag_Mundari Nandinagari New_Tai_Lue Newa Nko Nushu Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Ol_Onal Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian Old_South_Arabian Old_Turkic Old_Uyghur Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham Sidetic SignWriting Sinhala Sogdian Sora_Sompeng Soyombo Sundanese Sunuwar Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Tai_Yo Takri Tamil Tangsa Tangut Telugu Thaana Thai Tibetan Tifinagh Tirhuta Todhri Tolong_Siki Toto Tulu_Tigalari Ugaritic Vai Vithkuqi Wancho Warang_Citi Yezidi Yi Zanabazar_Square"
).split()


@lru_cache(maxsize=1)
def known() -> dict[str, int]:
    """Number of every script that the installed module recognises."""
    out = {"Unknown": UNKNOWN, "Common": COMMON, "Inherited": INHERITED}
    for name in NAMES:
        try:
            regex.compile(rf"\p{{Script={name}}}")
        except regex.error:
            continue
        out[name] = len(out)
    return out


@lru_cache(maxsize=1)
def table() -> np.ndarray:
    """Script number of every code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, number in known().items():
        if number == UNKNOWN:
            continue
        for m in regex.finditer(rf"\p{{Script={name}}}+", every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = number
    out[0xD800:0xE000] = UNKNOWN
    return out


def numbers(names: list[str] | tuple[str, ...]) -> frozenset[int]:
    """Numbers of scripts by name; a name that isn't a script is a KeyError."""
    return frozenset(known()[n] for n in names)
