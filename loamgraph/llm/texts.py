"""Reading texts as their writers meant them to be read."""

import html
import re
import unicodedata

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l",
}
#: Digits and signs that stand for letters inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_LOOK = str.maketrans(LOOKALIKES)
_LEET = str.maketrans(LEET)
#: A tag is `<` and a letter up to the next `>`: of at most 200 characters, or of any length if it holds nothing but a name and attributes.
_TAG = re.compile(r"</?[A-Za-z](?:[^<>]{0,200}|[\w:.-]*+(?:\s++[A-Za-z_:@][\w:.@-]*+(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++))?+)*+\s*+/?)>")
_WORD = re.compile(r"[^\W_]+")
_CYRILLIC_OR_GREEK = re.compile("[Ͱ-ϿЀ-ԯı]")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿̀-ͯ]")


def without_comments(text: str) -> str:
    """Markup comments of any length gone; one that is never closed stays."""
    out, at = [], 0
    while (begin := text.find("<!--", at)) >= 0:
        end = text.find("-->", begin + 4)
        if end < 0:
            break
        out += [text[at:begin], " "]
        at = end + 3
    return "".join([*out, text[at:]])


def plain(text: str) -> str:
    """Lower case; markup, hidden and combining characters gone; look-alike letters as Latin ones in words that mix scripts."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", without_comments(text))
    if text.isascii():
        return text.lower()
    text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text).casefold())
    if _CYRILLIC_OR_GREEK.search(text):
        text = re.sub(r"[^\W\d_]+", lambda m: m[0].translate(_LOOK) if re.search("[a-z]", m[0]) or not re.search("[^" + "".join(LOOKALIKES) + "]", m[0]) else m[0], text)
    return text


def words(text: str) -> list[str]:
    """The words of a text's plain form; digits inside words are read as the letters they stand for."""
    found = _WORD.findall(plain(text))
    return [w.translate(_LEET) if not w.isalpha() and not w.isdigit() else w for w in found]
