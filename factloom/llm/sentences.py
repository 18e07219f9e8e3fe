"""Sentence units of texts in many languages and scripts, by cascading tables of segmentation rules.

A rule is a pair of expressions, one for what stands before a position and one for what follows, and
says break or no break. The tables of a language are gone through in order, its own before the common
ones, and the first rule that matches decides the position. Positions come from marks that can end a
sentence (with the closing quotation marks and citations that belong to it), from line starts of markup
blocks, and in Thai, which has no final marks, from white space.

A position inside a closed quotation is never a break.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Abbreviations that are never the last word of a sentence (fixed values, by language).
NEVER_LAST = {
    "en": "Fig Figs Eq Eqs Sec Secs Tab App Ref Refs Ch No Nos Vol pp ca approx resp cf vs viz i.e e.g Dr Prof Mr Mrs Ms St Gen Col Rev U.S U.K",
    "de": "Nr Abb Tab Kap Abschn Gl Bd S bzw ca vgl Dr Prof Hr Fr z.B d.h u.a z d u usw.v sog evtl ggf inkl bspw",
    "fr": "fig figs tab éq sect chap env M MM Mme Mlle Dr Pr p.ex p c.-à-d n° no vol cf",
    "es": "fig figs tab ec sec cap núm núms nro Sr Sra Srta Dr Dra Prof p.ej p pág págs EE UU Ud Uds vol aprox",
    "ru": "рис табл гл разд стр с см См ср т им проф Проф напр ок руб тыс млн д н ул",
    "ar": "د أ م ص ج",
    "hi": "डॉ प्रो श्री सं पृ",
}
#: Abbreviations that may end a sentence: no break only before a small letter or a bracketed number.
PERHAPS_LAST = {"en": "al etc Jr Sr Inc Ltd Co Corp a.m p.m", "de": "a usw h B", "fr": "al etc ex", "es": "al etc ej", "ru": "г гг др пр е д"}
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner"
#: Thai words that open a sentence, and words that close one before a space.
THAI_OPEN = "รูปที่ ตารางที่ โดยเฉลี่ย นอกจากนี้ อย่างไรก็ตาม ต่อมา จากนั้น ดังนั้น ในทางกลับกัน ในทางตรงกันข้าม เมื่อเทียบกัน ทั้งนี้ อนึ่ง สุดท้าย เพราะฉะนั้น แต่ทว่า โดยรวม โดยสรุป"
THAI_CLOSE = "จุด ครั้ง ครับ ค่ะ แล้ว"

CLOSERS = r"[\"”“»’」』）)\]]"
CITATION = r"(?:\[\d+(?:\s?[,;–-]\s?\d+)*\]|\[[\p{L} ]{3,30}\]|<ref\b[^<>]*/>|<ref\b[^<>]*>[^<>]*</ref>|<sup\b[^<>]*>[^<>]*</sup>|\{\{[^{}]*\}\}|</\w+>|<br\s*/?>)"
MARK = r"[.!?。！？।؟…]"
POSITION = regex.compile(rf"{MARK}+{CLOSERS}*{CITATION}*")
#: A line that starts a block of markup: headings, lists, tables, code, environments.
BLOCK = r"(?:\#{1,6} |={2,6}[^=]|[-*+] |\||```|\\begin|\\end|\\item|\\(?:sub)*section|</?(?:h\d|ul|ol|li|table|tr|pre|p|div)\b|\{\||\|\})"
BLOCK_START = regex.compile(rf"\n\s*(?={BLOCK})")
HEADING = regex.compile(r"(?:^|\n)[ \t]*(?:\#{1,6} [^\n]*|={2,6}[^=\n]+={2,6}|\\(?:sub)*section\*?\{[^{}\n]*\}|<h\d[^<>]*>[^\n]*?</h\d>)[ \t]*(?=\n|$)")
THAI_SPACE = regex.compile(r"(?<=\S)\s+(?=\S)")
QUOTES = (("„", "“"), ("„", "”"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"))
def _words(text: str) -> str:
    return "|".join(regex.escape(w) for w in sorted(set(text.split()), key=lambda w: (-len(w), w)))


def _rule(is_break: bool, before: str, after: str) -> tuple[bool, regex.Pattern]:
    return is_break, regex.compile(rf"(?<={before})(?={after})")


#: What stands before an abbreviation: no part of a word or of a hyphenated name.
FREE = r"(?<![\p{L}\p{M}\p{N}-])"
#: What a small-letter sentence start looks like although sentences start with capitals: a symbol with a number.
SYMBOL = r"[a-z]\d+\b"


@functools.cache
def tables() -> dict[str, list[tuple[bool, regex.Pattern]]]:
    """The rule tables: of each language, of each script, and the common one."""
    out: dict[str, list[tuple[bool, regex.Pattern]]] = {}
    # a letter alone abbreviates something in its own language only: elsewhere it may end a name (`Model M.`)
    longer = lambda words: " ".join(w for w in words.split() if len(w) > 1)
    for lang, foreign in itertools.product(sorted({*NEVER_LAST, *PERHAPS_LAST}), (False, True)):
        rules = []
        never, perhaps = (longer(t.get(lang, "")) if foreign else t.get(lang, "") for t in (NEVER_LAST, PERHAPS_LAST))
        if lang == "de":
            rules.append(_rule(False, r"\b\d{1,2}\.", rf"\s+(?:{_words(MONTHS)})\b"))
            rules.append(_rule(False, r"\b(?:z|d|u|o|i|v|s)\.", r"\s?\p{L}\."))
            rules.append(_rule(False, r"\b(?:z\.\s?B|d\.\s?h|u\.\s?a|i\.\s?d|v\.\s?a|s\.\s?o|o\.\s?ä)\.", r"\s+\S"))
        if lang == "es":
            rules.append(_rule(False, r"\bEE\.\s?UU\.", r"\s+\S"))
            rules.append(_rule(False, r"\bp\.\s?ej\.", r"\s+\S"))
        if lang == "fr":
            rules.append(_rule(False, r"\b(?:p\.\s?ex|c\.-à-d)\.", r"\s+\S"))
        if lang == "ru":
            rules.append(_rule(False, r"\bт\.\s?[екдпн]\.", r"\s*\S"))
            rules.append(_rule(False, r"\d\s?гг?\.", r"\s+\p{Ll}"))
        if never:
            rules.append(_rule(False, rf"{FREE}(?:{_words(never)})\.", r"\s*\S"))
        if perhaps:
            rules.append(_rule(False, rf"{FREE}(?:{_words(perhaps)})\.", rf"\s*(?:(?!{SYMBOL})\p{{Ll}}|\[\d|[,;:)]|\(?(?:19|20)\d\d\b)"))
        out[lang + "+" * foreign] = rules
    out["th"] = [
        _rule(False, r"(?:รูปที่|ตารางที่|สมการที่|จำนวน|ร้อยละ)\s\d{1,9}", r"\s"),
        _rule(True, rf"(?:{_words(THAI_CLOSE)})", r"\s+\S"),
        _rule(True, r"\d", rf"\s+(?:\p{{Lu}}|{_words(THAI_OPEN)})"),
        _rule(True, rf"[.!?]{CLOSERS}*", r"\s+\S"),
        _rule(False, r"", r"\s"),
    ]
    out["unspaced"] = [
        _rule(False, r"…", r""),
        _rule(False, r"[。！？]+[”」』）’]+", r"[^\s\n]"),
        _rule(True, rf"[。！？]+[”」』）’]*{CITATION}*", r"[^”」』）’]"),
        _rule(True, r"[!?]", r"\s*[\p{Han}\p{Hiragana}\p{Katakana}\p{Lu}“「]"),
    ]
    out["uncased"] = [_rule(True, rf"(?:[।؟!?]|(?<!\d)\.|\d\.(?!\d)){CLOSERS}*{CITATION}*", r"\s+[\p{Lo}\p{N}\p{Lu}“«(\"]")]
    out["common"] = [
        _rule(False, r"(?:^|[\s(“«])\p{Lu}\.", r"\s*(?:\p{Lu}\.|\p{Lu}\p{Ll})"),  # initials
        _rule(False, r"\b[Nn]o\.", r"\s\d"),
        _rule(False, r"(?<=\s)\.\.\.", r"\s"),
        _rule(False, r"…|\.\.\.", r"\s*\p{Ll}"),
        _rule(True, rf"{MARK}{CLOSERS}*{CITATION}*", r"\s*\n\s*\n"),
        _rule(True, rf"{MARK}{CLOSERS}*{CITATION}*", rf"\s+{SYMBOL}"),
        _rule(True, r"(?<!\p{L})\d+\.\d+\.", r"\s+\p{Ll}{2}"),  # a second point can't be the decimal one
        _rule(True, rf"{MARK}{CLOSERS}*{CITATION}*", r"\s+(?!\[\d)[^\p{Ll}\p{M},;:)\]”»–—/=<>+%\s-]"),
        _rule(True, rf"{MARK}{CLOSERS}*{CITATION}*", r"\s+(?:<\w|<[\d ]|-\s)"),
        _rule(True, rf"(?:[\p{{L}}\p{{N}}\p{{M}}%)+\]]|{CLOSERS})[.!?]{CLOSERS}*{CITATION}*", r"\p{Lu}[\p{L} ]|[¿¡„]\p{L}"),  # the space was lost
        _rule(True, rf"[।؟？！。]{CLOSERS}*{CITATION}*", r"\S"),
        _rule(True, rf"[.!?]{CLOSERS}*{CITATION}+", r"\s+\S"),
    ]
    return out


LATIN = ("en", "de", "fr", "es")


@functools.cache
def cascade(kind: str) -> tuple[tuple[bool, regex.Pattern], ...]:
    """The tables of a language in order. Texts in Latin letters get the tables of all such languages, the own one first."""
    t = tables()
    if kind == "th":
        names = ["th"]
    elif kind in ("zh", "ja"):
        names = ["unspaced", *[f"{x}+" for x in LATIN], "common"]
    elif kind in ("ar", "hi"):
        names = [kind, "en", "uncased", "common"]
    elif kind == "ru":
        names = ["ru", "common"]
    else:
        names = [kind, *[f"{x}+" for x in LATIN if x != kind], "common"]
    return tuple(r for n in names if n in t for r in t[n])


SCRIPTS = (("th", r"\p{Thai}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ar", r"\p{Arabic}"), ("hi", r"\p{Devanagari}"), ("ru", r"\p{Cyrillic}"))
SCRIPT = [(k, regex.compile(p)) for k, p in SCRIPTS]


def language(text: str, said: str | None) -> str:
    """By script where the script tells, else as said, else English. said may be null, in capitals, or wrong."""
    letters = sum(map(str.isalpha, text))
    for kind, p in SCRIPT:
        if len(p.findall(text)) > 0.1 * letters:
            return kind
    said = (said or "").strip().lower()[:2]
    return said if said in LATIN else "en"


def straight(text: str) -> list[tuple[int, int]]:
    """Quotations in ASCII marks: one opens after a space or bracket and before no space, the next that stands after no space closes it."""
    out, start = [], -1
    at = text.find('"')
    while at >= 0:
        before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        if start < 0:
            if (not before.strip() or before in "([{—–") and after.strip():
                start = at
        elif before.strip() and not after.isalnum():
            out.append((start, at + 1))
            start = -1
        at = text.find('"', at + 1)
    return out


def quoted(text: str) -> list[tuple[int, int]]:
    """Closed quotations as spans in text order; one left open counts to the end of the text if no blank line comes before it."""
    spans = []
    i, n = 0, len(text)
    last_blank = text.rfind("\n\n")
    following: dict[str, int] = {}

    def after(mark: str, at: int) -> int:
        """The next place of a mark, n if there is none; places are looked up once."""
        if following.get(mark, -1) < at:
            found = text.find(mark, at)
            following[mark] = found if found >= 0 else n
        return following[mark]

    while i < n:
        i = min(after(a, i) for a, _ in QUOTES)
        if i >= n:
            break
        closing = [b for a, b in QUOTES if text[i] == a]
        end = min(after(c, i + 1) for c in closing)
        again = after(text[i], i + 1)
        if end < n and (end < again or text[i] in closing):
            spans.append((i, end + 1))
            i = end + 1
        else:
            if end >= n and i > last_blank:
                spans.append((i, n + 1))
            i += 1
    if '"' not in text:
        return spans
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans + straight(text)):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def spans(text: str | None, said: str | None = None) -> list[tuple[int, int]]:
    """[start, end) of every sentence, in code points, without white space at either end.

    A null, empty or blank text has none. A rest without a final mark is a sentence.
    """
    if not text or not text.strip():
        return []
    kind = language(text, said)
    rules = cascade(kind)
    inside = quoted(text)
    cuts = {0, len(text)}
    candidates = [m.end() for m in POSITION.finditer(text)]
    if kind == "th":
        candidates += [m.start() for m in THAI_SPACE.finditer(text)]
    k = 0
    for p in sorted(candidates):
        while k < len(inside) and inside[k][1] <= p - 1:
            k += 1
        if any(a < p < b for a, b in inside[max(0, k - 1) : k + 1]):
            continue
        for is_break, pattern in rules:
            if pattern.match(text, p):
                if is_break:
                    cuts.add(p)
                break
    if "\n" in text or text[0] in "#=\\<":
        cuts.update(m.start() for m in BLOCK_START.finditer(text))
        cuts.update(m.end() for m in HEADING.finditer(text))
    edges = sorted(cuts)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        right = len(part.rstrip())
        if right > left:
            out.append((a + left, a + right))
    return out


def sentences(records: DataFrame, key: str = "row_id", text: str = "context", lang: str = "lang") -> DataFrame:
    """(key, start_pos, end_pos) of every sentence of every text. Narrow: one scan of three columns.

    Null and empty texts give no rows; a null or unknown language is told from the script; repeated rows come out as often
    as they came in; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (t, said) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b in spans(t, said):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["k", "start_pos", "end_pos"])

    pruned = records.select(records[key].alias("k"), records[text].alias("t"), records[lang].alias("l"))
    kind = pruned.schema["k"].dataType.simpleString()
    return pruned.mapInArrow(run, f"k {kind}, start_pos bigint, end_pos bigint").withColumnRenamed("k", key)
