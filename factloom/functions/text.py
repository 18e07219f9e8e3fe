"""Text functions as Column expressions: they stay in the JVM and inside whole-stage code generation.

Patterns use ASCII classes and no lookaround unless a docstring says otherwise, so that other SQL engines give
the same results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the answer and mention grammar.
FINAL_LABEL = r"(?is)final\s*answer.{0,30}?\b(supported|refuted)\b"
BARE_LABEL = r"(?i)\b(supported|refuted)\b"
FINAL_EVIDENCE = r"(?is)final\s*answer.{0,40}?(?:(evidence_id_[12])|\banswer\s*:?\s*\$?\s*([12])\b)"
BARE_EVIDENCE = r"(?i)\b(evidence_id_[12])\b"
BARE_ANSWER = r"(?i)\banswer\s*:?\s*\$?\s*([12])\b"
THINKING = r"(?is)<think>.*?</think>"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
COMPARATIVE = (
    r"(?i)\b(significant(ly)?|associat(ed|ion)|correlat(ed|ion)|compar(ed|ison)|higher|lower|greater|less than|more than|"
    r"increase(d)?|decrease(d)?|outperform|versus|\bvs\.?\b|differ(ed|ence)?)\b"
)
MERE_REFERENCE = r"(?i)\b(see|refer(s|red)?\s+to)\b"
MENTION = {"table": r"(?i)\bTables?\s+\d+\b", "figure": r"(?i)\b(?:Figures?|Figs?\.?)\s+\d+\b"}
SPAN = {
    "table": r"(?i)\bTables?\s+S?\d+(?:\s*(?:,|and|-|–|to)\s*S?\d+)*\b",
    "figure": r"(?i)\b(?:Figures?|Figs?\.?)\s+S?\d+(?:\s*(?:,|and|-|–|to)\s*S?\d+)*\b",
}
SUPPLEMENT = {
    "table": r"(?i)\bTables?\s+S\d+\b|\bsupplement(?:ary|al)?\s+Tables?\s+\d+\b",
    "figure": r"(?i)\b(?:Figures?|Figs?\.?)\s+S\d+\b|\bsupplement(?:ary|al)?\s+(?:Figures?|Figs?\.?)\s+\d+\b",
}
ECHO = {"table": r"(?i)^Tables?\s*\d+\s*:", "figure": r"(?i)^(?:Figures?|Figs?\.?)\s*\d+\s*:"}
ELECTRONIC = {"table": r"\be-?[Tt]ables?\b", "figure": r"\be-?[Ff]igures?\b"}
LABEL_NUMBER = {"table": r"(?i)^table\s*(\d+)", "figure": r"(?i)^(?:Figures?|Figs?\.?)\s*(\d+)"}
REFERENCE = r"(?i)\b(?:Tables?|Figs?\.?|Figures?)\s+S?\d+\b"
CITED_CELL = r"(?i:\bet al\b)|[A-Z][a-zA-Z'\-]+(?:\s+(?:and|&)\s+[A-Z][a-zA-Z'\-]+)?\s*[\(\[]\d{4}[\)\]]"
P_VALUE_CELL = r"^\s*<?\s*0?\.\d+\s*$"
DEFAULTS = {"task1": "Refuted", "task2": "evidence_id_1"}


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The last match, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def task1_label(answer: Column) -> Column:
    """Supported or Refuted: what a final-answer line says, else the last label anywhere, else null."""
    return F.initcap(F.lower(F.coalesce(filled(F.regexp_extract(answer, FINAL_LABEL, 1)), last_match(answer, BARE_LABEL))))


def task2_label(answer: Column) -> Column:
    """evidence_id_1 or evidence_id_2: a final-answer line, else the last evidence name, else the last numbered answer, else null."""
    number = F.coalesce(filled(F.regexp_extract(answer, FINAL_EVIDENCE, 2)), F.lit(None))
    final = F.coalesce(filled(F.regexp_extract(answer, FINAL_EVIDENCE, 1)), F.concat(F.lit("evidence_id_"), number))
    bare = F.concat(F.lit("evidence_id_"), last_match(answer, BARE_ANSWER))
    return F.lower(F.coalesce(final, last_match(answer, BARE_EVIDENCE), bare))


def strip_thinking(answer: Column) -> Column:
    """Without <think> blocks; if nothing is left, the stripped original."""
    without = strip(F.regexp_replace(answer, THINKING, ""))
    return F.when(without != "", without).otherwise(strip(answer))


def strip_quotes(answer: Column) -> Column:
    """Without one leading and one trailing quotation mark."""
    return F.regexp_replace(answer, "^[\"']|[\"']$", "")


def is_skip(answer: Column) -> Column:
    return (F.upper(answer) == "SKIP") | (answer == "")


def with_default(parsed: Column, task: str) -> Column:
    """The parsed label, or the task's default where nothing could be parsed."""
    return F.coalesce(parsed, F.lit(DEFAULTS[task]))


def split_sentences(text: Column) -> Column:
    """Sentences: cut at white space after . ! ? before a capital or a digit; stripped, without blank ones.

    `Fig. 2` is cut after `Fig.`: the mention patterns count on it. Uses lookbehind and lookahead.
    """
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    """Words parted by white space, 0 for a blank text."""
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def squeeze(text: Column) -> Column:
    """White space runs become one blank."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def is_claim_worthy(sentence: Column, kind: str = "table") -> Column:
    """A sentence of at least 8 words with a number besides the mention or a comparative word; mere pointers don't count."""
    rest = F.regexp_replace(sentence, SPAN[kind], "")
    compares = sentence.rlike(COMPARATIVE)
    return (word_count(sentence) >= 8) & (rest.rlike(r"\d") | compares) & (~sentence.rlike(MERE_REFERENCE) | compares)


def mentioned_numbers(sentence: Column, kind: str = "table") -> Column:
    """Distinct digit groups of all mentions, in order."""
    spans = F.regexp_extract_all(sentence, F.lit(SPAN[kind]), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)))))


def is_own_mention(sentence: Column, kind: str = "table") -> Column:
    """Mentions a numbered table or figure of the document itself: no supplement, no electronic one, no echo of a caption."""
    return sentence.rlike(MENTION[kind]) & ~sentence.rlike(SUPPLEMENT[kind]) & ~sentence.rlike(ELECTRONIC[kind]) & ~sentence.rlike(ECHO[kind])


def label_number(label: Column, kind: str = "table") -> Column:
    return filled(F.regexp_extract(label, LABEL_NUMBER[kind], 1))


def raw_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))


def to_number(raw: Column) -> Column:
    return F.try_cast(F.replace(raw, F.lit(","), F.lit("")), "double") if hasattr(F, "try_cast") else F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def is_citation_year(v: Column) -> Column:
    return (v == F.floor(v)) & v.between(1900, 2099)


def is_specific(raw: Column, v: Column) -> Column:
    """Telling enough to ground a claim: has a decimal point or at least two digits before it, and is no year."""
    return v.isNotNull() & (F.contains(raw, F.lit(".")) | (F.abs(v) >= 10)) & ~is_citation_year(v)


def claim_targets(claim: Column) -> Column:
    """Distinct specific numbers of a claim, table and figure numbers left out."""
    raws = raw_numbers(F.regexp_replace(claim, REFERENCE, ""))
    kept = F.filter(raws, lambda r: F.coalesce(is_specific(r, to_number(r)), F.lit(False)))
    return F.array_distinct(F.transform(kept, to_number))


def has_citation(cell: Column) -> Column:
    return cell.rlike(CITED_CELL)


def is_p_value(cell: Column) -> Column:
    return cell.rlike(P_VALUE_CELL)


def looks_numeric(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), "%", ""), r"[,.\-]", "").rlike(r"^\d+$")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: inside a lambda an expression would be worked out at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_gaps(cell: Column) -> Column:
    """The pieces around a cell's numbers: n + 1 pieces for n numbers."""
    return F.split(cell, NUMBER, -1)


def touches_letter(parts: Column, k: Column) -> Column:
    """Number k (from 0) between the pieces touches a letter, as in `MDH1`: part of a name, not a value."""
    return F.right(F.get(parts, k), F.lit(1)).rlike("[A-Za-z]") | F.left(F.get(parts, k + 1), F.lit(1)).rlike("[A-Za-z]")


def splice(cell: Column, k: Column, new: Column) -> Column:
    """The cell with number k replaced."""
    nums = raw_numbers(cell)
    swapped = F.transform(nums, lambda x, i: F.when(i == k, new).otherwise(x))
    padded = F.concat(swapped, F.array(F.lit("")))
    return F.array_join(F.zip_with(number_gaps(cell), padded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def format_decimals(v: Column, decimals: Column) -> Column:
    """v with the given number of decimals (0 to 6); halves are rounded up, as Spark does."""
    out = F.when(decimals <= 0, F.format_string("%.0f", v))
    for n in range(1, 6):
        out = out.when(decimals == n, F.format_string(f"%.{n}f", v))
    return out.otherwise(F.format_string("%.6f", v))


def percent(share: Column, decimals: int = 2) -> Column:
    """A share as a percentage with so many decimals, N/A for null: for reports only."""
    return F.coalesce(F.format_string(f"%.{decimals}f", share * 100), F.lit("N/A"))


def paper_of(paper_id: Column, paper_path: Column) -> Column:
    """The paper's id, or the one its path ends with."""
    return F.coalesce(paper_id, filled(F.regexp_extract(paper_path, r"peerj_(\d+)\.json$", 1)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def url_quote(c: Column) -> Column:
    """Percent-encoded for a URL's path: letters, digits, `_.-~` and slashes stay."""
    out = F.url_encode(c)
    for found, put in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def stem(path: Column) -> Column:
    """File name without its last extension; a name that starts with its only dot has none."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def canonical_path(path: Column) -> Column:
    """Without `.` steps, doubled and leading slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(path), r"/\./", "/"), r"/{2,}", "/"), r"^(\./|/)+", "")


def evidence_type(path: Column) -> Column:
    """table or figure, from the path's first folder; any other path is an error."""
    return F.when(path.startswith("tables_png/"), "table").when(path.startswith("figures/"), "figure").otherwise(F.raise_error(F.concat(F.lit("no evidence type for "), F.coalesce(path, F.lit("null")))))


def first_even_byte(key: Column) -> Column:
    """Whether the first byte of the key's SHA-256 is even: a coin that depends only on the key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % 2 == 0


def json_block(text: Column) -> Column:
    """From the first { to the last }."""
    return filled(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def version_of(key: Column, name: Column) -> Column:
    """n of `<name>.n/...`, null if the key isn't of that form."""
    rest = F.when(F.startswith(key, F.concat(name, F.lit("."))), F.expr("1"))
    tail = F.substr(key, F.length(name) + 2)
    return F.when(rest.isNotNull(), filled(F.regexp_extract(tail, r"^(\d+)/", 1)).cast("int"))
