"""Markup residue: flat text blocks classified by decision trees, and texts cleaned with their structure kept.

A text is cut into flat blocks (lines). Each block has its number of words, its link density, counts of marks
of each kind of markup (certain ones, list marks, doubtful ones), and the same of its neighbours. Trees grown on
the small labelled table below read these numbers: one for each kind says whether a block's marks are markup
at all (a star may multiply, a bracket may hold a note, a dash may open speech), one gives the block's role, and one
tells the page's frame from its content by words and link density of the block and its neighbours alone.
Cleaning goes by role, and leaves out linked blocks of the frame.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import cache
from html.entities import html5

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.ids import carried, carried_type
from docloom.llm.tree import Node, decide, grow

KINDS = ("html", "markdown", "wiki", "latex")

# Names of elements and commands.
ELEMENTS = "a abbr address article aside audio b base big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
_COMMANDS = "begin end item section subsection subsubsection chapter paragraph textbf textit emph texttt underline footnote label ref cite eqref caption centering hline frac sqrt sum int prod lim infty alpha beta gamma delta epsilon lambda mu pi rho sigma tau phi omega cdot times leq geq neq approx left right text mathrm mathbf quad"

_TAG = re.compile(rf"</?(?:{ELEMENTS.replace(' ', '|')})(?=[\s/>])(?:[^<>\"']|\"[^\"\n]*\"|'[^'\n]*')*>|<!DOCTYPE[^<>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_MD_CERTAIN = re.compile(
    r"""(?m)^\ {0,3}\#{1,6}[ \t]+\S | !\[[^\[\]\n]*\]\([^()\s]+\) | (?<!!)\[[^\[\]\n]+\]\((?:[^()\s]|\([^()\s]*\))+(?:\ "[^"\n]*")?\) | \*\*(?=\S)[^*\n]+?(?<=\S)\*\*
        | (?<![\w_])__(?=\S)[^_\n]+?(?<=\S)__(?![\w_]) | ~~(?=\S)[^~\n]+?(?<=\S)~~ | (?<!`)`[^`\n]+`(?!`) | ^\ {0,3}(?:```|~~~) | ^\ {0,3}>\ (?=\S)
        | ^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$""",
    re.X,
)
#: List marks: they are markup in lists, and anything else where they are alone.
_MD_LISTED = re.compile(r"^\s*[-+*] (?=\S)")
_MD_ORDERED = re.compile(r"^\s*\d{1,3}[.)] (?=\S)")
_MD_ROW = re.compile(r"^\s*\|(?![-}|]).*\|\s*$")
_MD_UNDER = re.compile(r"^\s{0,3}(?:={3,}|-{3,})\s*$")
_MD_STAR = re.compile(r"(?<![\w*\\])[*_](?=[^\s*_])[^*_\n]+?(?<=[^\s*_])[*_](?![\w*])")
_WIKI_CERTAIN = re.compile(r"(?m)\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|'''(?=\S).+?'''|''(?=[^'\s]).+?''|^\s*(={2,6})[^=\n]+?\1\s*$|^\s*\{\|(?!\|)|^\s*\|\}\s*$|^\s*\|-+\s*$|^\s*!(?!\[)[^\n]*!!")
_WIKI_CELL = re.compile(r"^\s*\|[^|]+\|\|")
_LATEX_CERTAIN = re.compile(rf"\\(?:begin|end)\{{[A-Za-z*]+\}}|(?<![\w:\\])\\(?:{_COMMANDS.replace(' ', '|')})(?![A-Za-z])(?!\\)|\\[A-Za-z]+\*?\{{|\\\[.+?\\\]|\\\(.+?\\\)|\$\$.+?\$\$|(?<![\\$\d])\$(?=[^\s$])[^$\n]*(?:\\[A-Za-z]+|[_^=])[^$\n]*(?<=[^\s$\\])\$(?!\d)", re.S)
_LATEX_DOUBT = re.compile(r"\\[A-Za-z]+|\\[%&#_]|\\\\|\$[^$\n]+\$")
_HTML_DOUBT = re.compile(r"<[^<>\n]{1,40}>|&[A-Za-z]+")
_WIKI_DOUBT = re.compile(r"''|\[[^\[\]\n]+\]|\{[^{}\n]+\}")
_LINKED = re.compile(r"(?i)<a\b[^<>]*>(.*?)</a>|(?<!!)\[([^\[\]\n]+)\]\([^()\s]+\)|\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]")
_WORD = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+")
_STOP = re.compile(r"[。！？；]|[.!?](?=\s|$|\[)")
_CRUMB = re.compile(r"\s(?:>|›|»|·|\|)\s")


def _references(text: str) -> int:
    return sum(1 for m in _REFERENCE.finditer(text) if m[0][1] == "#" or m[0][1:] in html5)


def marks(line: str, before: str) -> dict[str, tuple[int, int, int]]:
    """(certain, list, doubtful) marks of each kind in a line; ``before`` is the line above."""
    n_html = len(_TAG.findall(line)) + len(_COMMENT.findall(line)) + _references(line)
    n_md = sum(1 for _ in _MD_CERTAIN.finditer(line)) + bool(_MD_UNDER.match(line) and before.strip() and not _MD_UNDER.match(before))
    n_wiki = sum(1 for _ in _WIKI_CERTAIN.finditer(line))
    n_latex = sum(1 for _ in _LATEX_CERTAIN.finditer(line))
    return {
        "html": (n_html, 0, len(_HTML_DOUBT.findall(line))),
        "markdown": (n_md, int(_MD_LISTED.match(line) is not None), bool(_MD_ORDERED.match(line)) + bool(_MD_ROW.match(line)) + len(_MD_STAR.findall(line))),
        "wiki": (n_wiki, 0, bool(_WIKI_CELL.match(line)) + len(_WIKI_DOUBT.findall(line))),
        "latex": (n_latex, 0, len(_LATEX_DOUBT.findall(line))),
    }


class Blocks:
    """The flat blocks of a text and their features."""

    def __init__(self, text: str) -> None:
        # marks that run over line ends make one block of their lines
        self.lines = _flat(text)
        self.marks = [marks(x, self.lines[k - 1] if k else "") for k, x in enumerate(self.lines)]
        self.words = [len(_WORD.findall(_TAG.sub(" ", x))) for x in self.lines]
        self.linked = [sum(len(_WORD.findall(m[1] or m[2] or m[3] or "")) for m in _LINKED.finditer(x)) / max(1, w) for x, w in zip(self.lines, self.words)]

    def _near(self, k: int, step: int) -> int | None:
        k += step
        while 0 <= k < len(self.lines) and not self.lines[k].strip():
            k += step
        return k if 0 <= k < len(self.lines) else None

    def kind_row(self, k: int, kind: str) -> list[float]:
        around = [j for s in (-1, 1) if (j := self._near(k, s)) is not None]
        near = [sum(self.marks[j][kind][f] for j in around) for f in range(3)]
        return [*self.marks[k][kind], *near, self.words[k], self.linked[k], max((self.words[j] for j in around), default=0), max((self.linked[j] for j in around), default=0)]

    def frame_row(self, k: int) -> list[float]:
        """Words, link density and sentence stops of the block, words and link density of the ones before and after it; none counts as nothing."""
        around = [self._near(k, s) for s in (-1, 1)]
        return [self.words[k], self.linked[k], len(_STOP.findall(self.lines[k])), *(f[j] if j is not None else 0 for j in around for f in (self.words, self.linked))]

    def role_row(self, k: int) -> list[float]:
        line = self.lines[k]
        s = line.strip()
        near = [j for st in (-1, 1) if (j := self._near(k, st)) is not None]
        heading = bool(re.match(r"#{1,6}\s|={2,6}[^=]+={2,6}$|\\(?:sub)*section|\\chapter|<h[1-6]", s, re.I)) or bool(k + 1 < len(self.lines) and _MD_UNDER.match(self.lines[k + 1]) and s)
        listed = bool(re.match(r"[-+*•]\s|\d{1,3}[.)、]\s?|\*+[^*]|\\item|<li\b|\\begin\{(?:itemize|enumerate)", s, re.I)) or "<li" in s.lower()
        table = bool(_MD_ROW.match(s) or _WIKI_CELL.match(s) or re.match(r"\{\||\|[-}]|!.*!!|:?-{3,}:?\s*\|", s) or re.search(r"<t[rdh]\b|\\begin\{tabular", s, re.I))
        code = bool(re.match(r"```|~~~|<pre\b|<code\b|\\begin\{(?:verbatim|lstlisting)", s, re.I)) or s.endswith("</code></pre>")
        formula = bool(re.search(r"\\\[.+\\\]|\\\(.+\\\)|\$[^$]*\\[a-z]+[^$]*\$|\\begin\{equation", s))
        stop = s[-1:] in tuple("。！？.!?；;：:")
        return [heading, listed, table, code, formula, self.words[k], self.linked[k], len(_CRUMB.findall(s)), stop, *[max((f[j] for j in near), default=0) for f in (self.words, self.linked)]]


def _flat(text: str) -> list[str]:
    out: list[str] = []
    for line in text.split("\n"):
        if out and (out[-1].count("{{") > out[-1].count("}}") or out[-1].count("<!--") > out[-1].count("-->")):
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


# The labelled table: for each line the kinds of markup it holds (joined by +, or -) and its role.
LABELLED = [
    ["html text|<p>The office opens at nine and closes at five on every weekday.</p>", "html heading|<h2>Opening hours</h2>", "html list|<ul><li>Monday</li><li>Tuesday</li></ul>", "html table|<table><tr><td>fee</td><td>12</td></tr></table>", "html text|Fish &amp; chips are sold behind the counter until the evening.", "html chrome|<a href='/'>Home</a> <a href='/faq'>Help</a>", "html text|</div>"],
    ["html text|A note<sup>2</sup> was left on the desk by the visitor.<br/>", "html code|<pre><code>x = 1</code></pre>", "html text|<!-- to do --> The list goes on with more words here."],
    ["- text|If a < 5 and b > 3 the limit of the second table holds.", "- text|Write <name> and <date> on the form before you hand it in.", "- text|The share is <72% and >29 in the last quarter of the year."],
    ["markdown heading|## Fees", "markdown text|The **monthly** fee is due on the first day of each month.", "markdown list|- one paper for each person", "markdown list|  - and a copy of it", "markdown list|1. sign the form", "markdown list|2. send the form", "markdown text|See [the guide](https://guide.example.invalid/x) for the other forms.", "markdown code|```", "- text|x = 1", "markdown code|```", "markdown text|> Quoted words of the other party in this matter."],
    ["markdown table|| fee | due | paid |", "markdown table||---|---|---|", "markdown table|| 12 | May | yes |", "markdown table|| 13 | June | no |"],
    ["markdown heading|Second part", "markdown text|=====", "markdown text|The field `fee_total` is filled by the office, ~~once~~ twice a year."],
    ["- text|The hall is 3*4 metres wide and the yard 32*15 metres.", "- text|Counter #7 is open on Monday and on Friday from nine.", "- text|The variable a_1_b stands for an estimate* of the year.", "- text|[note 3] The receipt of last May counts for this."],
    ["- list|1. bring the paper to the office.", "- text|Then wait for the answer of the office in the hall."],
    ["- text|1) Only one paper is needed for this case at all.", "- text|A single line without any marks in it stands here."],
    ["wiki heading|== History ==", "wiki text|'''Fees''' are set by the [[office]] and the [[board|council]] each year.", "wiki text|{{box|name=fee|no=3}}", "wiki chrome|[[Category:Fees]]", "wiki table|{| class=\"wikitable\"", "wiki table|! fee !! due", "wiki table||-", "wiki table|| 12 || May", "wiki table||}", "wiki text|The ''due day'' is kept by the office for all of its forms."],
    ["- text|It's the board's list, and the others' lists as well.", "- text|See [12] and {3} of the annex for the other amounts."],
    ["latex heading|\\section{Fees}", "latex text|The \\textbf{fee} is at most 22\\% of the sum that was agreed.", "latex formula|It follows that $a = \\frac{1}{2}$ for each of the years.", "latex formula|\\[ L = \\sum_{k=0}^n v^k \\]", "latex list|\\begin{itemize} \\item one paper \\item two papers \\end{itemize}", "latex list|\\item a third paper", "latex table|\\begin{tabular}{ll} fee & 12 \\\\ due & May \\end{tabular}", "latex text|See \\ref{eq:1} and \\cite{doc1} for the other amounts of it.", "latex text|\\footnote{The words of the board were taken down later.}"],
    ["- text|It is kept under C:\\papers\\123 for the next inspection.", "- text|The ticket is $12, the form costs $5 and the copy $3 more.", "- text|Between $5 and $9 is paid for every further copy of it."],
    ["- chrome|Home > Papers > Fees > Text", "- chrome|Share: board · office · list", "- text|The office has answered all of the letters of the last week."],
    ["markdown table|| the fee of the first month of the year | the due day of that month | paid at the office in person |", "markdown table|| :--- | --- | ---: |", "markdown table|| the fee of the second month of the year | the last day of that month | paid by a letter to the bank |"],
    ["markdown heading|## What the office asks of each person who comes for the first time in a year", "markdown list|- one paper for each of the persons who live in the house and are older than twelve", "markdown list|  - and a copy of that paper for the persons who live there for a part of the year", "markdown list|1. sign the form in the presence of a member of the office or of the board of the town"],
    ["wiki table|| the fee of the first month of the year and of the second || the due day of that month and of the next one", "wiki table||-", "wiki table|| the fee of the third month of the year and of the fourth || the due day of that month and of the next one"],
    ["html table|<table><tr><td>the fee of the first month</td><td>the due day of the month</td></tr><tr><td>the fee of the second</td><td>the last day</td></tr></table>", "html list|<ul><li>one paper for each of the persons who live in the house</li><li>a copy of it for the office of the town</li></ul>", "html heading|<h3>What the office asks of each person who comes for the first time</h3>"],
    ["latex list|\\begin{itemize} \\item one paper for each of the persons who live in the house \\item a copy of it for the office of the town \\end{itemize}", "latex table|\\begin{tabular}{ll} the fee of the first month & the due day of the month \\\\ the fee of the second & the last day \\end{tabular}", "latex heading|\\section{What the office asks of each person who comes for the first time in a year}", "latex formula|\\( a_x = 12 \\) is the value that the office takes for the first of the years in question here"],
    ["html code|<pre><code>the_fee_of_the_month = the_fee_of_the_year / 12 and so on for the others of the list", "html code|return the_fee_of_the_month  # what the office asks for</code></pre>"],
    ["- text|if a<5", "- text|R&D", "- text|a share of <72% or >29"],
    ["- text|fill in <name>", "- text|see {3} and [4]", "- text|a_b* of c"],
    ["- text|costs $5 or $6", "- text|in C:\\papers\\9", "- text|at 5\\% or so"],
    ["latex text|see \\ref{eq:1}", "- text|3. of May"],
    ["wiki text|[[fee]] due", "- text|it's 'so' said"],
    ["html text|fee<br>", "markdown text|**fee**", "latex formula|$a_1 = 2$"],
    ["- heading|Questions on fees", "- text|The office has answered all of the letters of the last week."],
    # dashes and stars that open no list
    ["- text|The clerk looked up from the file on the desk of the office.", "- text|- Yes, the form is here, she said and went on with the letters.", "- text|The visitor left the hall of the office without another word."],
    ["- text|The sum of the year is carried over to the next page of it.", "- text|- 12 of the fee was paid back in the course of the last month."],
    ["- text|The amounts of the table are those of the year before.", "- text|* subject to the rules of the board that hold for this year"],
    ["- text|- No.", "- text|The clerk closed the window of the office for the rest of the day."],
    ["- text|Three things are asked of each person who comes to the office:", "markdown list|- a paper", "markdown list|- a copy of it", "markdown list|- the fee", "- text|They are handed in at the window of the office in the hall."],
    ["- text|What to bring:", "markdown list|* the signed form of the year before", "markdown list|* the letter of the board on the fee of this year"],
    ["markdown list|+ the first of the papers that were asked for", "markdown list|+ the second of the papers that were asked for"],
    # frames of pages, and links inside content
    ["html chrome|<a href='/'>Home</a> <a href='/fees'>Fees</a> <a href='/forms'>Forms</a>", "html chrome|<a href='/en'>English</a> <a href='/de'>Deutsch</a>", "html text|<p>The fee of the year is due on the first day of each month at the office.</p>", "html text|<p>See <a href='/guide'>the guide</a> for the other forms that are asked for.</p>"],
    ["markdown chrome|[Home](/) [Fees](/fees) [Help](/help)", "markdown chrome|[Print](/p) [Share](/s)", "markdown text|The form is signed in the presence of a member of the [board](/board) of the town."],
    ["markdown text|The office keeps a copy of each of the papers for the time of a year.", "markdown chrome|[Imprint](/i) [Privacy](/d) [Contact](/c)"],
    ["- text|The papers that are asked for are named in the guide of the office:", "markdown list|- [the guide](/guide) to the forms of the first kind and of the second", "markdown list|- [the table](/table) of the fees of the year and of the one before"],
    ["wiki chrome|[[Category:Forms]]", "wiki chrome|[[Category:Offices]]"],
    ["wiki text|[[Fees]] and [[forms]]. [[Category:Office]]", "wiki text|The [[board]]. The [[office]]."],
    ["markdown text|[The guide](/guide) has [the forms](/forms).", "markdown text|[Ask](/ask) us."],
    ["wiki text|The fee of the [[office]] is set anew by the board in each of the years.", "wiki text|It is paid by a [[letter]] to the bank or at the [[office|window]] in person."],
    ["html text|<a href='/guide'>The guide to the forms that are asked for in the first year</a> was changed last month by the board of the office and holds from now on.", "html text|<p>The fees stay as they are.</p>"],
]


def labelled_rows(table: list[list[str]]) -> dict[str, tuple[list[list[float]], list[str]]]:
    """Features and labels of the blocks of a labelled table, for each kind, for "role" and for "frame"."""
    out: dict[str, tuple[list, list]] = {name: ([], []) for name in (*KINDS, "role", "frame")}
    for lines in table:
        labels = [x.partition("|")[0].split(" ") for x in lines]
        blocks = Blocks("\n".join(x.partition("|")[2] for x in lines))
        for k, (kinds, role) in enumerate(labels):
            made = {kind: (blocks.kind_row(k, kind), "yes" if kind in kinds.split("+") else "no") for kind in KINDS}
            made |= {"role": (blocks.role_row(k), role), "frame": (blocks.frame_row(k), "frame" if role == "chrome" else "content")}
            for name, (row, label) in made.items():
                out[name][0].append(row)
                out[name][1].append(label)
    return out


@cache
def trees() -> dict[str, Node]:
    """The trees for each of the kinds, for roles and for the page's frame, grown on the labelled table."""
    return {name: grow(rows, labels) for name, (rows, labels) in labelled_rows(LABELLED).items()}


_ANY = re.compile(r"[<&#*_`~|>\[{=\\$!+\-']|\d[.)] ")


def analyse(text: str) -> tuple[set[str], list[tuple[str, str, set[str]]]]:
    """The kinds of markup of a text, and of each block its line, role and kinds."""
    grown = trees()
    blocks = Blocks(text)
    out, found = [], set()
    fenced = False
    for k, line in enumerate(blocks.lines):
        here = {kind for kind in KINDS if any(blocks.marks[k][kind]) and decide(grown[kind], blocks.kind_row(k, kind)) == "yes"}
        fence = "markdown" in here and re.match(r"\s*(?:```|~~~)", line) is not None
        if fenced and not fence:
            here = set()
        role = "code" if fenced or fence else decide(grown["role"], blocks.role_row(k)) if line.strip() else "text"
        if fence:
            fenced = not fenced
        if here and blocks.linked[k] and role in ("text", "chrome"):
            role = "chrome" if decide(grown["frame"], blocks.frame_row(k)) == "frame" else "text"
        found |= here
        out.append((line, role, here))
    return found, out


def _bare_html(s: str) -> str:
    s = _COMMENT.sub("", s)
    s = re.sub(r"(?is)<(script|style)\b[^<>]*>.*?</\1\s*>", "", s)
    s = re.sub(r"(?i)<h([1-6])\b[^<>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", s)
    s = re.sub(r"(?i)<li\b[^<>]*>", "\n- ", s)
    s = re.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", s)
    s = re.sub(r"(?i)<br\s*/?>|</?(?:p|div|tr|table|ul|ol|h[1-6]|pre|blockquote)\b[^<>]*>", "\n", s)
    s = re.sub(r"(?i)<img\b[^<>]*?\balt=[\"']([^\"'<>]*)[\"'][^<>]*>", r"\1", s)
    return html.unescape(_TAG.sub("", s)).replace("\xa0", " ")


def _bare_markdown(s: str, role: str) -> str:
    if role == "table" and re.fullmatch(r"[\s|:\-]+", s):
        return ""
    if role == "table":
        return " | ".join(x.strip() for x in s.strip().strip("|").split("|"))
    s = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]+\)", r"\1", s)
    s = re.sub(r"\[([^\[\]\n]+)\]\([^()\s]+(?: \"[^\"\n]*\")?\)", r"\1", s)
    s = re.sub(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*|(?<![\w_])__(?=\S)([^_\n]+?)(?<=\S)__(?![\w_])|~~(?=\S)([^~\n]+?)~~|`([^`\n]+)`", lambda m: next(x for x in m.groups() if x is not None), s)
    return re.sub(r"^(\s*)[*+] ", r"\1- ", re.sub(r"^\s{0,3}> ", "", s))


def _bare_wiki(s: str) -> str:
    if re.fullmatch(r"\s*(?:\{\|.*|\|\}|\|-+)\s*", s):
        return ""
    s = re.sub(r"\[\[[^\[\]|\n:]{1,20}:[^\[\]|\n]*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", r"\1", s)
    s = re.sub(r"\{\{([^{}]+)\}\}", lambda m: "; ".join(x.strip() for x in m[1].split("|")), s)
    s = re.sub(r"'{2,5}", "", s)
    s = re.sub(r"^\s*(={2,6})\s*([^=\n]+?)\s*\1\s*$", lambda m: "#" * len(m[1]) + " " + m[2], s)
    if re.match(r"\s*!", s) and "!!" in s:
        return " | ".join(x.strip() for x in s.strip().lstrip("!").split("!!"))
    if _WIKI_CELL.match(s):
        return " | ".join(x.strip() for x in s.strip().lstrip("|").split("||"))
    return re.sub(r"^\s*\*+\s*", "- ", s)


def _bare_latex(s: str) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    s = re.sub(r"\\\[.+?\\\]|\\\(.+?\\\)|\$\$.+?\$\$|\$[^$\n]+\$", keep, s, flags=re.S)
    s = re.sub(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", lambda m: "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in m[1].split("\\\\")), s, flags=re.S)
    s = re.sub(r"\\(sub)*(?:section|chapter)\*?\{([^{}]*)\}", lambda m: ("## " if m[1] else "# ") + m[2], s)
    s = re.sub(r"\\item\b\s*", "\n- ", s)
    s = re.sub(r"~?\\(?:ref|cite|eqref|label)\{[^{}]*\}|\\(?:begin|end)\{[^{}]*\}", "", s)
    for _ in range(3):
        s = re.sub(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\([%&#_$])", r"\1", s)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], s)


def clean(text: str) -> tuple[str, list[str], list[str]]:
    """(clean text, kinds of markup, roles of its blocks).

    Headings come out as # lines, list items as - lines, table rows with their cells between bars; code and
    formulas stay as they are. Blocks of markup that are the page's frame, links beside no text, are left out.
    """
    kinds, blocks = analyse(text)
    out, roles = [], []
    for k, (line, role, here) in enumerate(blocks):
        if not here:
            out.append(line)
            roles.append(role)
            continue
        s = line
        if "html" in here:
            s = _bare_html(s)
        if "latex" in here:
            s = _bare_latex(s)
        if "wiki" in here:
            s = _bare_wiki(s)
        if "markdown" in here and role != "code":
            if _MD_UNDER.match(s) and out:
                out[-1] = "# " + out[-1]
                continue
            s = _bare_markdown(s, role)
        if role == "code" and re.match(r"\s*(?:```|~~~)", s):
            continue
        if role == "chrome":
            continue
        s = re.sub(r"\n{2,}", "\n", s).strip("\n")
        if s.strip() or not line.strip():
            out.append(s)
            roles.append(role)
    return "\n".join(out), sorted(kinds), roles


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ident, text in zip(pdf["id"], pdf["text"]):
            if text is None:
                rows.append((ident, None, [], 0, 0, 0, 0, 0))
                continue
            if not _ANY.search(text):
                rows.append((ident, text, [], 0, 0, 0, 0, 0))
                continue
            bare, kinds, roles = clean(text)
            rows.append((ident, bare, kinds, *(roles.count(r) for r in ("heading", "list", "table", "code", "formula"))))
        if rows:
            yield pd.DataFrame(rows, columns=["id", "clean_text", "markup_kinds", "headings", "list_items", "table_rows", "code_blocks", "formulas"])


def strip_markup(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, clean_text, markup_kinds, headings, list_items, table_rows, code_blocks, formulas) of every row.

    A null text stays null and an empty one empty, both without kinds; rows stored twice come out twice. Texts
    are taken whole and no shuffle is needed. The trees are grown anew by each worker, on the labelled table.
    """
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = df.select(carried(F.col(id_col), kind).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {carried_type(kind)}, clean_text string, markup_kinds array<string>, headings int, list_items int, table_rows int, code_blocks int, formulas int"
    return rows.mapInPandas(_clean, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col.split(".")[-1])
