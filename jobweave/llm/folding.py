"""Texts in one plain form for comparison: without case, accents, mark-up, look-alike letters and unseen characters."""

from __future__ import annotations

import re
import unicodedata

from jobweave.llm.lookalikes import ARMENIAN, ARMENIAN_AS, CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

LIKE = str.maketrans(CYRILLIC + GREEK + ARMENIAN + "đĐðÐłŁøØß", CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + "dDdDlLoOs")
TAG = re.compile(r"<[^<>\n]{1,120}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
EAST = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
WORD = re.compile(rf"[{EAST}]|[^\W_{EAST}]+")
_GAP = re.compile(r"[\W_]+")
#: Every byte of plain text that is no letter or digit as a blank, letters in lower case.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def unseen(c: str) -> bool:
    """Whether the character is a combining mark, but for the Japanese voicing marks, or has no shape."""
    return unicodedata.category(c) in ("Mn", "Me", "Cf") and c not in "\u3099\u309a"


def _class(characters: list[str]) -> str:
    """A regular expression's class of the characters, in ranges."""
    codes, out, k = sorted(map(ord, characters)), [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"{chr(codes[k])}-{chr(codes[j])}")
        k = j + 1
    return "".join(out)


_UNSEEN = re.compile("[" + _class([c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0xE0000, 0xE0200)]) if unseen(c)]) + "]+")
_LIKE = re.compile("[" + "".join(map(chr, LIKE)) + "]")


def blanked(text: str) -> str:
    """The text with its mark-up as blanks, of the same length."""
    return TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text or "&" in text else text


_OTHER = re.compile("[^\x00-\x7f\u0300-\u036f]")
_SIGNS = re.compile("[\u00a1-\u00a9\u00ab-\u00ac\u00ae-\u00b1\u00b6-\u00b7\u00bb\u00d7\u2010-\u2027\u2030-\u205e\u2190-\u27bf]+")


def fold(text: str) -> str:
    """The text without mark-up, accents, look-alikes and unseen characters, signs other than letters partly as blanks."""
    f = blanked(text)
    if f.isascii():
        return f
    f = unicodedata.normalize("NFKD", f).replace("đ", "d").replace("Đ", "D")
    if _OTHER.search(f):
        f = _SIGNS.sub(" ", f)
        if _OTHER.search(f):
            f = _UNSEEN.sub("", f)
            return f.translate(LIKE) if _LIKE.search(f) else f
    return f.encode("ascii", "ignore").decode()  # all that is left beside plain letters are accents


def plain(text: str) -> bytes:
    """The folded words with single blanks between."""
    f = fold(text)
    if f.isascii():
        return b" ".join(f.encode().translate(_BYTES).split())
    return _GAP.sub(" ", f.lower()).strip().encode()


def words(text: str) -> list[bytes]:
    """The folded words; East Asian characters are words each."""
    f = fold(text)
    if f.isascii():
        return f.encode().translate(_BYTES).split()
    return [w.encode() for w in WORD.findall(f.lower())]
