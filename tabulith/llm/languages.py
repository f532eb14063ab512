"""Telling languages apart by their closed-class words, letters and scripts."""

from __future__ import annotations

import re
import unicodedata

# Articles, prepositions, conjunctions, pronouns and auxiliaries by language, letters
# that few other languages have, and the ranges of scripts.
FUNCTION_WORDS = {
    "en": "the of and to in for with was were is are by on at from that this which who not be been had has have while although among between after before than or an as it its their during but into whose these those would could should may might a i we you they he she so if about no do does can must will there then also more most",
    "de": "der die das des dem den ein eine einer einem einen und oder von vom mit für nicht ist sind war waren wurde wurden im am an auf bei nach unter über gegenüber zwischen sich um nur aus als auch es zu zur zum dass durch denen hat haben keinen keine wird sowie",
    "fr": "l d qu n c a le la les des du un une et ou dans par pour avec sous contre après est sont été ont sur que qui ne pas ce cette ces chez au aux se plus entre leur leurs était étaient mais",
    "es": "el los las del una y o en con por para frente de que se fue fueron no su sus más tras entre al como la un es pero sin desde hasta ha han",
    "it": "l dell nell all il lo gli di del della dei delle nel nella con da per che si è sono stato stata stati non una un ha hanno dopo contro rispetto tra fra alla dal dalla e le la i al ma nei sulla",
    "pt": "o os as do da dos das na no nas nos em com por para que se foi foram não uma um mais após entre contra ao de e a é mas sem pelo pela até",
    "pl": "w z na i o do po dla przez się nie jest są był była było oraz wobec że od za między u a lub przy tym który która które",
    "nl": "de het een van en of in met voor niet is zijn was waren werd werden op aan bij na onder over tussen door om dat die ook maar tegenover naar uit",
    "sv": "och att det som en ett av för med inte är var på till från om den de vid efter mellan under hos eller har hade",
    "da": "og at det som en et af for med ikke er var på til fra om den de ved efter mellem under hos blev eller har havde",
    "cs": "a v na se je že s z do po pro byl byla bylo byly nebo při mezi u jako který která od k",
    "tr": "ve bir bu ile için olarak olan da de sonra göre arasında veya gibi daha çok",
    "fi": "ja on ei että oli ovat tai se ne kanssa jälkeen välillä mutta kuin joka olivat",
    "hu": "a az és hogy nem is volt egy között után vagy mint meg voltak ez",
    "ro": "și de la cu pe în din nu este sunt a fost au după între pentru care sau fără prin",
    "ru": "и в на с не что по для при был была было были после между у из к от или как это а но во со",
    "uk": "і в на з не що по для при був була було були після між у із до від або як це та але",
}
MARKS = {"pl": "ąćęłńśźż", "de": "ß", "pt": "ãõ", "es": "¿¡", "fr": "œêîû", "cs": "ěřůčžš", "tr": "ğşı", "hu": "őű", "ro": "țșă", "da": "ø"}
SCRIPTS = {"grek": (0x370, 0x3FF), "cyrl": (0x400, 0x52F), "hebr": (0x590, 0x5FF), "arab": (0x600, 0x6FF), "deva": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF), "hani": (0x3400, 0x9FFF), "hang": (0xAC00, 0xD7AF)}
# End of fixed values.
_OF_WORD: dict[str, tuple[str, ...]] = {}
for _language, _listed in FUNCTION_WORDS.items():
    for _w in set(_listed.split()):
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _language)
_OF_MARK = {c: language for language, marks in MARKS.items() for c in marks}
_MARK = re.compile("[" + "".join(_OF_MARK) + "]")
_WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    """Script of a word by its last letter outside Latin, '' for Latin."""
    for c in reversed(word):
        cp = ord(c)
        if cp >= 0x370:
            for name, (low, high) in SCRIPTS.items():
                if low <= cp <= high:
                    return name
    return ""


def words_of(text: str) -> list[str]:
    """Letter-only words in lower case, as they are written."""
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text.lower()))


def speaks(token: str, language: str) -> bool:
    """Whether a word is a closed-class word of a language."""
    return language in _OF_WORD.get(token, ())


def language_of(tokens: list[str]) -> str:
    """The language whose closed-class words and letters make most of the words, or '' where none stands out."""
    got: dict[str, int] = {}
    scripts: dict[str, int] = {}
    for t in tokens:
        if not t.isascii():
            if script := script_of(t):
                scripts[script] = scripts.get(script, 0) + len(t)
            elif mark := _MARK.search(t):
                got[_OF_MARK[mark[0]]] = got.get(_OF_MARK[mark[0]], 0) + 1
        for language in _OF_WORD.get(t, ()):
            got[language] = got.get(language, 0) + 1
    if scripts and max(scripts.values()) * 2 > sum(map(len, tokens)):
        return max(scripts, key=scripts.get)
    if not got:
        return ""
    best = max(got, key=lambda k: (got[k], k == "en"))
    if got[best] < 2 or got[best] < 0.1 * len(tokens):
        return ""
    tied = [k for k, n in got.items() if n == got[best]]
    return best if len(tied) == 1 or "en" in tied else ""


def other_language_run(tokens: list[str], known, spoken: str) -> int:
    """Most words in a stretch of new words that speak for one other language, less those for the own one.

    Words that `known` tells to stand in the other text are passed over: names and numbers are common to both.
    """
    best = 0
    runs: dict[str, int] = {}
    misses = 0
    for t in tokens:
        if known(t):
            continue
        languages = _OF_WORD.get(t, ())
        if spoken in languages:
            misses += 1
            if misses >= 2:
                runs.clear()
            continue
        if not t.isascii():
            if script := script_of(t):
                languages = (script,)
            elif mark := _MARK.search(t):
                languages = (*languages, _OF_MARK[mark[0]])
        for language in languages:
            if language != spoken:
                runs[language] = runs.get(language, 0) + 1
                best = max(best, runs[language])
                misses = 0
    return best


def foreign_letters(tokens: list[str], known) -> dict[str, int]:
    """Letters of new words by script other than Latin."""
    out: dict[str, int] = {}
    for t in tokens:
        if not t.isascii() and (script := script_of(t)) and not known(t):
            out[script] = out.get(script, 0) + len(t)
    return out
