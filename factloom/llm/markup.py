"""Markup residue in texts: found and cleaned by minimum-cut labelling.

A text is cut into segments: pieces that may be markup (tags, entities, emphasis, links, commands, list
and table lines, ...) and the words between them. Constructs that they may form (a pair of marks, an element
with its tags, a list, a table, a block of navigation) are nodes of a tree above them. A classifier, fitted on
a bounded labelled sample (`markup_fit`), gives each segment and each construct a cost for either label,
content or not; it sees a segment's own surroundings only. Costs are capacities towards two terminals;
neighbouring segments, and constructs and their members, are joined by smoothness edges. A maximum flow gives
the labelling of least total cost: a lone star stays content, while the same mark with a partner becomes
markup, and the words of a script or of a menu go with the block they stand in.

What is labelled markup is then rendered as clean text: headings, lists, code and formulas keep a plain
notation, everything else loses its marks; words that are labelled boilerplate are left out.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.markup_fit import Costs, fitted

#: Smoothness between neighbours, and between a construct and its members.
NEXT, TREE = 1, 5
#: Members that one node of a construct has.
CHUNK = 32
#: Costs of a code that the sample doesn't have: a construct of its own kind is markup, words are content.
UNKNOWN, WORDS = (9, 1), (0, 14)

#: Texts without any of these have no segment that could be markup.
TRIGGER = r"[<>&\\#*`\[\]{}|_~$^]|''|==|(?:^|\n)[ \t]*(?:[-+]|\d{1,3}[.)])[ \t]"
COMMANDS = r"\\(?:[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?|[()\[\]{}%&_#,;:!\\$])"
#: What tells that dollar signs far apart hold a formula.
FORMULA = r"(?:\\[A-Za-z]|\^|_\{|\b[A-Za-z]_[A-Za-z0-9]\b)"
SEGMENT = re.compile(
    r"""
    (?=[<&!\[{|$\\_^'*~`=\#>]|(?m:^))(?:  # nothing else can start one within a line: most characters are passed over at once
    (?P<fence>```[^\n`]*)
  | (?P<comment><!--.*?(?:-->|$))
  | (?P<tag></?[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>]*)?/?>)
  | (?P<opentag><(?:/?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?|!-*|/)$)
  | (?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,9}|\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6});)
  | (?P<openentity>(?<=[\w;])&(?:n(?:bsp?|b)?|amp?|lt?|gt?|qu(?:ot?)?|\#(?:\d{1,6}|[xX][0-9A-Fa-f]{0,5})?)$)
  | (?P<image>!\[[^\[\]\n]*\]\([^()\s]*(?:\s[^()\n]*)?\))
  | (?P<link>\[[^\[\]\n]+\]\((?:(?:https?:|www\.|mailto:|[/\#.])?[^()\s]*\)|(?:https?:|www\.)[^()\s]*$))
  | (?P<wikilink>\[\[[^\[\]\n]*(?:\]\]|$))
  | (?P<template>\{\{[^{}]*(?:\}\}|$))
  | (?P<wikitable>\{\|[^\n]*|\|\}|(?m:^\s*\|-[^\n]*$)|(?m:^\s*[|!][^|\n]+(?:\|\|[^|\n]+)+$))
  | (?P<mathblock>\$\$[^$]+(?:\$\$|$))
  | (?P<math>\$(?![\s\d])[^$\n]{1,200}?\$(?!\d)|\$\d*(?=[^$\n]{0,60}[\\^_{])[^$\n]{1,200}?\$(?!\d)|\$(?![ \t\d])(?=[^$]*?"""
    + FORMULA
    + r""")(?:(?!\n[ \t]*\n)[^$])+\$(?!\d)|\$\d+(?=[^$]{0,60}?"""
    + FORMULA
    + r""")(?:(?!\n[ \t]*\n)[^$])+\$(?!\d))
  | (?P<texmath>\\\((?:[^\\]|\\[^()])*\\\)|\\\[(?:[^\\]|\\[^\[\]])*\\\])
  | (?P<command>"""
    + COMMANDS
    + r""")
  | (?P<script>(?<=[\w)\]}])[_^]\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\}?)
  | (?P<wikibold>'{2,5}(?=[^\s'])|(?<=[^\s'])'{2,5})
  | (?P<bold>\*\*+(?=[^\s*])|(?<=[^\s*])\*\*+|(?<![\w_])__(?=[^\s_])|(?<=[^\s_])__(?![\w_])|(?<=[^\x00-\x7F])__(?=[^\s_])|(?<=[^\s_])__(?=[^\x00-\x7F])|~~(?=[^\s~])|(?<=[^\s~])~~)
  | (?P<code>`+)
  | (?P<emphasis>(?<![\w*\\+)}\]>'`])\*(?=[\w“])|(?<=[\w”.)+])\*(?![\w*])|(?<![\w_\\])_(?=\w)|(?<=\w)_(?![\w_{]))
  | (?P<heading>(?m:^[ \t]*\#{1,6}[ \t]+(?=\S)))
  | (?P<wikiheading>(?m:^[ \t]*={2,6}[^=\n]+={2,6}[ \t]*$|^[ \t]*={2,6}[ \t]))
  | (?P<setext>(?m:(?<=[^\n]\n)[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$))
  | (?P<row>(?m:^[ \t]*\|[^\n]*\|[ \t]*$|^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[^\n]*$|^[ \t]*\|[ \t][^\n]*$|^[^|\n]+(?:[ \t]\|[ \t][^|\n]+)+$))
  | (?P<quote>(?m:^[ \t]*>[ \t]?))
  | (?P<item>(?m:^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(?=\S)))
    )
""",
    re.X | re.S,
)
CLOSERS = "\"”»’)]"
#: Characters that an emphasised phrase of at most eight words may have.
PHRASE = 200
FINAL_MARKS = ".!?:。！？：।؟"
ENDED = re.compile(r"[.!?。！？।؟][\"”»’)\]]*\s")
PAIRED = {"wikibold", "bold", "code", "emphasis", "fence"}
SIBLINGS = {"item", "row", "quote", "wikitable"}
#: Elements whose words aren't the text's.
BOILERPLATE = {"script", "style", "nav", "noscript", "iframe", "form", "footer"}


def segments(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in text order; 'words' stands between the others."""
    out, last = [], 0
    for m in SEGMENT.finditer(text):
        if m.start() > last:
            out.append(("words", last, m.start()))
        out.append((m.lastgroup, m.start(), m.end()))
        last = m.end()
    if last < len(text):
        out.append(("words", last, len(text)))
    return out


def _after_end(text: str, at: int) -> bool:
    """What stands before a line is finished: the text's start, a blank line, or a line with a final mark."""
    i, breaks = at - 1, 0
    while i >= 0 and text[i].isspace():
        breaks += text[i] == "\n"
        i -= 1
    if i < 0 or breaks > 1:
        return True
    while i >= 0 and text[i] in CLOSERS:
        i -= 1
    return i >= 0 and text[i] in FINAL_MARKS


def _tight(text: str, a: int, b: int) -> str:
    """Whether emphasis stands around whole words (nothing of a word before its first mark or after its last one), and only around a few."""
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    whole = (not before.strip() or before in "([{\"'“«„") and not after.isalnum()
    return f"{'whole' if whole else 'part'}:{'phrase' if b - a <= PHRASE and len(text[a:b].split()) <= 8 else 'long'}"


def _code(kind: str, text: str, a: int, b: int, last_end: int) -> str:
    """What the classifier sees of a segment: its kind, form and the characters around it."""
    s, after, before = text[a:b], text[b : b + 1], text[a - 1 : a] if a else ""
    if kind == "emphasis":
        opens = after.strip() and after not in ",.;:" and not before.isalnum() and before not in ("+", ")", "]", "}")
        return "emphasis:opens" if opens else "emphasis:closes" if before.strip() else "emphasis:free"
    if kind == "link":
        target = s.rpartition("](")[2]
        return f"link:{'place' if re.search(r'[./#:]', target) else 'bare'}"
    if kind == "fence":
        return kind
    if kind in PAIRED:
        return f"{kind}:{'opens' if after.strip() else 'closes'}:{'open end' if a > last_end and after.strip() else ''}"
    if kind == "item":
        mark = s.strip()
        after_end = _after_end(text, a)
        return f"item:{'first' if mark[:-1] == '1' else 'number'}" if mark[0].isdigit() else f"item:{'star' if mark == '*' else 'bullet'}:{after_end}"
    if kind == "quote":
        return f"quote:{'number' if after.isdigit() else 'words'}:{_after_end(text, a)}"
    if kind == "row":
        bars = s.count("|")
        if re.search(r"\|?\s*:?-{3,}", s):
            return "row:line"
        outer = s.lstrip().startswith("|") + s.rstrip().endswith("|")
        return f"row:{min(bars, 3)}:{outer}:{'sign' if '=' in s or re.search(r'\|\w\|', s) else ''}"
    if kind == "setext":
        title = text[text.rfind("\n", 0, a - 1) + 1 : a - 1] if a else ""
        return f"setext:{'title' if 0 < len(title.split()) <= 12 and not title.rstrip().endswith(tuple(FINAL_MARKS)) else 'other'}"
    return kind


def graph(text: str, parts: list[tuple[str, int, int]]) -> tuple[list[str], list[list[int]], list[tuple[int, int, int]]]:
    """The codes of the segments and, after them, of the constructs; the constructs' members; the edges (i, j, capacity)."""
    ends = [m.end() for m in ENDED.finditer(text)]
    last_end = ends[-1] if ends else 0
    codes = ["words" if kind == "words" else _code(kind, text, a, b, last_end) for kind, a, b in parts]
    constructs: list[tuple[str, list[int]]] = []
    waiting: dict[str, int] = {}
    runs: dict[str, list[int]] = {}
    open_tags: list[tuple[str, int]] = []
    blocks: list[tuple[str, int, int]] = []  # name, first and last segment of elements
    for i, (kind, a, b) in enumerate(parts):
        if kind in PAIRED:
            mark = text[a:b] if kind != "fence" else "```"
            partner = waiting.get(mark)
            can_close = kind == "fence" or codes[i].startswith("emphasis:closes") or kind != "emphasis" and text[a - 1 : a].strip() != ""
            if partner is not None and can_close and a > parts[partner][2] and (kind == "fence" or "\n\n" not in text[parts[partner][2] : a]):
                del waiting[mark]
                form = str(len(mark)) if kind == "wikibold" else _tight(text, parts[partner][1], b) if kind == "emphasis" else ""
                constructs.append((f"pair:{kind}:{form}", [partner, i]))
            elif kind == "fence" or ":opens" in codes[i]:
                waiting[mark] = i
        elif kind == "tag":
            name = re.sub(r"[^a-z0-9]", "", text[a:b].lower().split()[0])
            if not text.startswith("</", a):
                if not text.startswith("/>", b - 2):
                    open_tags.append((name, i))
            elif any(n == name for n, _ in open_tags):
                while True:
                    n, j = open_tags.pop()
                    if n == name:
                        break
                constructs.append(("element", [j, i]))
                blocks.append((name, j, i))
        elif kind in SIBLINGS:
            runs.setdefault(kind, []).append(i)
    for name, j in open_tags:  # never closed: to the end of the text
        if name in BOILERPLATE:
            blocks.append((name, j, len(parts)))
    for kind, run in runs.items():
        constructs += _runs(kind, run, text, parts, codes)
    codes, constructs = _blocks(blocks, parts, codes, constructs)
    edges = [(i, i + 1, NEXT) for i in range(len(parts) - 1)]
    # a long construct is a chain of nodes, or every search for a path would go through all its members
    split: list[tuple[str, list[int]]] = []
    for code, members in constructs:
        for lo in range(0, len(members), CHUNK):
            if lo:
                edges.append((len(parts) + len(split) - 1, len(parts) + len(split), TREE))
            split.append((code, members[lo : lo + CHUNK]))
    constructs = split
    edges += [(len(parts) + c, i, TREE) for c, (_, members) in enumerate(constructs) for i in members]
    return codes + [code for code, _ in constructs], [members for _, members in constructs], edges


def _runs(kind: str, run: list[int], text: str, parts: list[tuple[str, int, int]], codes: list[str]) -> Iterator[tuple[str, list[int]]]:
    """Lists and tables of the segments of a kind: numbers that count on, the same bullet again, rows of one table."""
    if kind != "item":
        groups, new = [], True
        for i in run:
            near = not new and "\n\n" not in text[parts[groups[-1][-1]][2] : parts[i][1]] and (kind != "row" or not text[parts[groups[-1][-1]][2] : parts[i][1]].strip())
            groups[-1].append(i) if near else groups.append([i])
            new = False
        for g in groups:
            if kind == "row":
                yield f"table:{'line' if any(codes[i] == 'row:line' for i in g) else 'bars' if len(g) > 1 and len({text[parts[i][1] : parts[i][2]].count('|') for i in g}) == 1 else 'single' if len(g) == 1 else 'uneven'}", g
            else:
                yield f"{kind}s:{min(len(g), 2)}", g
        return
    lists: list[list[int]] = []
    last: dict[str, list[int]] = {}
    for i in run:
        mark = text[parts[i][1] : parts[i][2]].strip()
        number = int(mark[:-1]) if mark[0].isdigit() else None
        key = mark if number is None else f"{number}{mark[-1]}"
        before = last.pop(key, None) if number is None else last.pop(f"{number - 1}{mark[-1]}", None)
        group = before if before is not None else []
        if before is None:
            lists.append(group)
        group.append(i)
        last[key] = group
    for g in lists:
        yield f"list:{'numbers' if text[parts[g[0]][1] : parts[g[0]][2]].strip()[0].isdigit() else 'bullets'}:{'one' if len(g) == 1 else 'more'}:{_after_end(text, parts[g[0]][1])}", g


def _blocks(blocks: list[tuple[str, int, int]], parts: list, codes: list[str], constructs: list) -> tuple[list[str], list]:
    """Blocks whose words may be boilerplate: certain elements, and lists of links only. The innermost one of each counts."""
    words = [i for i, (kind, *_) in enumerate(parts) if kind == "words"]
    if not words or not blocks:
        return codes, constructs
    linked = set()
    for name, j, k in blocks:
        if name == "a":
            linked.update(range(j + 1, k))
    taken: set[int] = set()
    for name, j, k in sorted(blocks, key=lambda x: x[2] - x[1]):
        if name not in BOILERPLATE and name not in ("ul", "ol", "menu"):
            continue
        inside = [i for i in words if j < i < k and i not in taken]
        if not inside:
            continue
        all_linked = name not in BOILERPLATE and len(inside) > 2 and all(i in linked for i in inside)
        if name in BOILERPLATE or all_linked:
            taken.update(inside)
            code = f"block:{name}" if name in BOILERPLATE else "block:links"
            constructs.append((code, inside))
            for i in inside:
                codes[i] = "words:script" if name in ("script", "style") else "words:linked" if i in linked else "words:block"
    return codes, constructs


def costs(text: str, parts: list[tuple[str, int, int]], table: Costs) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """A (content, markup) cost for each segment and construct, and the smoothness edges."""
    codes, _, edges = graph(text, parts)
    return [WORDS if c == "words" else table.get(c, UNKNOWN) for c in codes], edges


def min_cut(unary: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the markup side of a minimum cut: the smallest such side.

    What a node can send from source to sink on its own cancels first. Then every node that still has flow to send looks for
    the nearest node with room, along edges with capacity left (shortest augmenting paths). If there is none, all that it
    reached is cut off from the sink for good and is never searched again, so long texts take time in proportion.
    """
    n = len(unary)
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        flow[i][j] = flow[i].get(j, 0) + c
        flow[j][i] = flow[j].get(i, 0) + c
    excess = [max(0, a - b) for a, b in unary]
    room = [max(0, b - a) for a, b in unary]
    cut_off = [False] * n
    for i in range(n):
        while excess[i] and not cut_off[i]:
            parent = {i: i}
            queue = deque([i])
            end = -1
            while queue and end < 0:
                u = queue.popleft()
                for v, c in flow[u].items():
                    if c > 0 and v not in parent and not cut_off[v]:
                        parent[v] = u
                        if room[v]:
                            end = v
                            break
                        queue.append(v)
            if end < 0:
                for v in parent:
                    cut_off[v] = True
                break
            path, v = [], end
            while v != i:
                path.append((parent[v], v))
                v = parent[v]
            least = min(excess[i], room[end], *(flow[u][v] for u, v in path))
            excess[i] -= least
            room[end] -= least
            for u, v in path:
                flow[u][v] -= least
                flow[v][u] += least
    return cut_off


def labelled(text: str, table: Costs | None = None, cut: bool = True) -> list[tuple[str, int, int, bool]]:
    """The segments with whether each is markup (or boilerplate). cut: by minimum cut, else each segment by its own costs."""
    parts = segments(text)
    if all(kind == "words" for kind, _, _ in parts):
        return [(*p, False) for p in parts]
    unary, edges = costs(text, parts, fitted() if table is None else table)
    side = min_cut(unary, edges) if cut else [content > markup for content, markup in unary]
    return [(*p, s) for p, s in zip(parts, side[: len(parts)], strict=True)]


def has_markup(text: str | None, table: Costs | None = None) -> bool:
    return bool(text) and any(is_markup for *_, is_markup in labelled(text, table))


BLOCK_TAG = re.compile(r"</?(?:p|div|ul|ol|table|tr|h[1-6]|title|pre|section|blockquote)\b", re.I)
BARE = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "lambda": "λ", "mu": "μ", "sigma": "σ", "pm": "±", "leq": "≤", "geq": "≥", "times": "×", "%": "%", "&": "&", "_": "_", "#": "#", "$": "$", ",": " ", "\\": "\n"}
DROPPED = ("label", "cite", "citep", "citet", "ref", "eqref", "begin", "end")
TITLES = {"section": "# ", "subsection": "## ", "subsubsection": "### ", "chapter": "# ", "caption": ""}


def _argument(text: str, at: int) -> tuple[str, int]:
    """The braced argument that starts at `at`, and where it ends; an unclosed one runs to the end."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


def clean(text: str | None, table: Costs | None = None) -> str | None:
    """The text without its markup. Headings become `#` lines, items `- ` lines, code stays fenced or in backticks, formulas stand in $ or $$,
    or in their \\(...\\) or \\[...\\].

    A null stays null; a text without markup comes back unchanged.
    """
    if not text:
        return text
    parts = labelled(text, table)
    if not any(m for *_, m in parts):
        return text
    out: list[str] = []
    skip = 0
    fenced = False
    left_out, dropped = set(), False  # list items whose words are left out
    for i in range(len(parts) - 1, -1, -1):
        if parts[i][0] == "words" and text[parts[i][1] : parts[i][2]].strip():
            dropped = parts[i][3]
        elif parts[i][0] == "tag" and dropped:
            left_out.add(parts[i][1])
    closing: set[int] = set()  # braces that end a group like {\\it ...}
    for kind, a, b, is_markup in parts:
        if b <= skip:
            continue
        a = max(a, skip)
        s = text[a:b]
        if fenced and kind != "fence":
            out.append(s)
        elif not is_markup:
            for at in sorted((p for p in closing if a <= p < b), reverse=True):
                s = s[: at - a] + s[at - a + 1 :]
            out.append(s)
        elif kind == "words":
            pass  # boilerplate
        elif kind == "setext":
            head, line = "".join(out).rstrip("\n"), "# " if s.strip()[0] == "=" else "## "
            at = head.rfind("\n") + 1
            out = [head[:at] + line + head[at:].lstrip() if head[at:].strip() else head + "\n\n"]
        elif kind == "fence":
            fenced = not fenced
            out.append(s)
        elif kind == "tag":
            low = s.lower()
            level = re.match(r"<h([1-6])\b", low)
            if level:
                out.append("\n" + "#" * int(level[1]) + " ")
            elif low.startswith("<li") and a in left_out:
                pass
            elif low.startswith("<li"):
                out.append("\n- ")
            elif low.startswith("<br") or BLOCK_TAG.match(low):
                out.append("\n")
            elif re.match(r"</?(?:code|tt)\b", low):
                out.append("`")
            elif re.match(r"</?t[dh]\b", low):
                out.append(" ")
            elif low.startswith("<ref") and not low.endswith("/>"):
                end = text.find("</ref>", b)
                skip = len(text) if end < 0 else end + len("</ref>")
        elif kind in ("opentag", "openentity"):
            pass
        elif kind == "entity":
            out.append(html.unescape(s).replace("\xa0", " "))
        elif kind in ("image", "link"):
            out.append(re.sub(r"^!?\[([^\[\]]*)\].*$", r"\1", s, flags=re.S))
        elif kind == "wikilink":
            out.append(s.strip("[]").split("|")[-1])
        elif kind == "template":
            inner = s.strip("{}").split("|")
            out.append("" if inner[0].strip().lower().startswith(("cite", "sfn", "ref", "citation")) else inner[-1])
        elif kind == "wikitable":
            if s.lstrip().startswith(("{|", "|}", "|-")):
                skip = b + (text[b : b + 1] == "\n")
            else:
                out.append(s.strip(" |!").replace("||", "|"))
        elif kind == "row" and not re.search(r"[^\s|:-]", s):
            skip = b + (text[b : b + 1] == "\n")
        elif kind in ("math", "mathblock", "texmath", "code", "row"):
            out.append(s)
        elif kind == "script":
            out.append(re.sub(r"\\[A-Za-z]+|[{}$]", "", s))
        elif kind == "heading":
            out.append(s.strip() + " ")
        elif kind == "wikiheading":
            out.append("#" * (len(s.strip()) - len(s.strip().lstrip("="))) + " " + s.strip(" ="))
        elif kind == "item":
            out.append("- " if not s.strip()[0].isdigit() else s)
        elif kind == "command":
            name = re.sub(r"^\\|\*?(?:\[[^\[\]]*\])?$", "", s)
            if name in ("begin", "end") and text[b : b + 1] == "{":
                environment, skip = _argument(text, b)
                if name == "begin" and environment.startswith(("equation", "align", "math", "gather", "eqnarray")):
                    end = text.find(f"\\end{{{environment}}}", skip)
                    inner = text[skip : end if end >= 0 else len(text)]
                    skip = end + len(environment) + 6 if end >= 0 else len(text)
                    out.append(f"$${inner.rstrip()}\n$$" if "\n" in inner else f"$${inner}$$")
                elif text[skip : skip + 1] == "\n" and (not out or out[-1].endswith("\n")):
                    skip += 1
            elif name == "item":
                out.append(("" if not out or out[-1].endswith("\n") else "\n") + ("-" if text[b : b + 1] == " " else "- "))
            elif text[a - 1 : a] == "{" and out and out[-1].endswith("{") and name not in BARE and text[b : b + 1] != "{":
                out[-1] = out[-1][:-1]
                closing.add(_argument(text, a - 1)[1] - 1)
                skip = b + (text[b : b + 1] == " ")
            elif name in BARE and not name.isalpha():
                out.append(BARE[name])
            elif text[b : b + 1] == "{" and name not in BARE:
                inner, skip = _argument(text, b)
                if name not in DROPPED:
                    out.append(TITLES.get(name, "") + (clean(inner, table) or ""))
            else:
                out.append(BARE.get(name, ""))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


def _fields(records: DataFrame, fields: tuple[str, ...], key: str) -> DataFrame:
    """(key, field, text) of the texts that have a character markup could begin with; decided in the JVM."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), records[f].alias("text")) for f in fields]))
    return records.select(records[key].alias("k"), each.alias("x")).select("k", "x.field", "x.text").where(F.col("text").rlike(TRIGGER))


def residue(records: DataFrame, fields: tuple[str, ...] = ("caption", "context"), key: str = "row_id", cleaned: bool = False) -> DataFrame:
    """(key, field[, clean_text]) of every value with at least one construct of markup.

    Null and empty values have none. Each value is judged for itself, repeated rows alike; only the key and the fields are read.
    The classifier is fitted once, on the driver.
    """
    table = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = [i for i, t in enumerate(texts) if has_markup(t, table)]
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at)]
            if cleaned:
                columns.append(pa.array([clean(texts[i], table) for i in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["k", "field", "clean_text"][: len(columns)])

    pruned = _fields(records, fields, key)
    kind = pruned.schema["k"].dataType.simpleString()
    return pruned.mapInArrow(run, f"k {kind}, field string" + ", clean_text string" * cleaned).withColumnRenamed("k", key)
