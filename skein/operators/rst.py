"""PRS6/PRS8: reStructuredText to Markdown, by indentation: sections, lists, definitions, fields, tables, literal blocks, directives, substitutions, links.

A block is what stands at one indentation; what is indented below it belongs to it and is parsed by the same rules. Text that
fits no construct is a paragraph, so no word of a document is lost but comments, targets and the directives of HIDDEN.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Directives by what becomes of them.
CODE = {"code", "code-block", "sourcecode", "parsed-literal", "highlight", "literalinclude", "testcode", "ipython", "doctest"}
NOTES = {"note", "warning", "tip", "important", "attention", "caution", "danger", "error", "hint", "seealso", "admonition", "versionadded", "versionchanged", "deprecated", "todo", "topic", "sidebar", "rubric"}
HIDDEN = {"toctree", "contents", "include", "raw", "meta", "index", "currentmodule", "module", "autosummary", "automodule", "sectnum", "default-role", "role"}
_ADORNED = re.compile(r"([!-/:-@\[-`{-~])\1{2,}\s*$")
_BULLET = re.compile(r"([-*+•])(\s+|$)")
_NUMBER = re.compile(r"(?:\(?(?:\d+|#|[a-zA-Z]|[ivxlcIVXLC]+)[.)])(\s+|$)")
_FIELD = re.compile(r":(?![: ])((?:[^:\\]|\\.|:(?=\S))+?):(?:\s+|$)")
_DIRECTIVE = re.compile(r"\.\. (?:\|(?P<sub>[^|]+)\| )?(?P<name>[A-Za-z][\w:.+-]*)::(?:\s+|$)(?P<rest>.*)$")
_TARGET = re.compile(r"\.\. _(`[^`]+`|[^:]+):(?:\s+(.*))?$")
_FOOTNOTE = re.compile(r"\.\. \[([^\]]+)\]\s*(.*)$")
_GRID = re.compile(r"\+(?:[-=]+\+)+\s*$")
_SIMPLE = re.compile(r"=+(?:\s+=+)+\s*$")


@dataclass
class _Document:
    """What is known of a whole document before its blocks are written: targets, substitutions, and the levels of adornments as they appear."""

    targets: dict[str, str] = field(default_factory=dict)
    words: dict[str, str] = field(default_factory=dict)
    styles: list[str] = field(default_factory=list)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _dedent(lines: list[str]) -> list[str]:
    by = min((_indent(x) for x in lines if x.strip()), default=0)
    out = [x[by:].rstrip() for x in lines]
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return out


def _name(text: str) -> str:
    return " ".join(text.strip("`").lower().split())


def _fenced(lines: list[str], language: str = "") -> str:
    ticks = "`" * max(3, 1 + max((len(m) for x in lines for m in re.findall("`+", x)), default=0))
    return "\n".join([ticks + language, *lines, ticks])


def _quoted(text: str) -> str:
    return "\n".join(f"> {x}".rstrip() for x in text.split("\n"))


class _Parser:
    def __init__(self, doc: _Document):
        self.doc = doc

    def blocks(self, lines: list[str]) -> list[str]:
        """Markdown of each block of lines at one indentation."""
        out, at = [], 0
        while at < len(lines):
            if not lines[at].strip():
                at += 1
                continue
            for construct in (self.section, self.table, self.explicit, self.field_list, self.doctest, self.line_block, self.lists, self.quote, self.definition, self.paragraph):
                found = construct(lines, at)
                if found:
                    text, at = found
                    if text:
                        out.append(text)
                    break
        return out

    def text(self, lines: list[str]) -> str:
        return "\n\n".join(self.blocks(lines))

    @staticmethod
    def body(lines: list[str], at: int, least: int = 1) -> int:
        """The end of what is indented by least or more from line at on; blank lines inside count, those after don't."""
        end = k = at
        while k < len(lines) and (not lines[k].strip() or _indent(lines[k]) >= least):
            k += 1
            if lines[k - 1].strip():
                end = k
        return end

    # each construct: (Markdown, the line after it), or None where it doesn't begin here

    def section(self, lines, at):
        line = lines[at]
        get = lambda k: lines[k] if k < len(lines) else ""
        if _ADORNED.match(line) and get(at + 1).strip() and get(at + 2).rstrip() == line.rstrip() and len(get(at + 1).rstrip()) <= len(line.rstrip()):
            title, style, end = get(at + 1), line[0] * 2, at + 3
        elif not line.startswith(" ") and _ADORNED.match(get(at + 1)) and len(get(at + 1).rstrip()) >= min(4, len(line.rstrip())) and not _ADORNED.match(line):
            title, style, end = line, get(at + 1)[0], at + 2
        elif _ADORNED.match(line) and len(line.strip()) >= 4 and not get(at + 1).strip() and (at == 0 or not lines[at - 1].strip()):
            return "---", at + 1
        else:
            return None
        if style not in self.doc.styles:
            self.doc.styles.append(style)
        return f"{'#' * min(6, self.doc.styles.index(style) + 1)} {self.inline(title.strip())}", end

    def table(self, lines, at):
        if _GRID.match(lines[at]):
            end = at
            while end < len(lines) and lines[end].startswith(("+", "|")):
                end += 1
            return self.grid(lines[at:end]), end
        if not _SIMPLE.match(lines[at]):
            return None
        rules = [at]
        end = at + 1
        while end < len(lines):
            if _SIMPLE.match(lines[end]):
                rules.append(end)
                if end + 1 >= len(lines) or not lines[end + 1].strip():
                    break
            end += 1
        if len(rules) < 2:
            return None
        spans = [m.span() for m in re.finditer("=+", lines[at])]
        rows: list[list[list[str]]] = []
        head = 0
        for k in range(at + 1, rules[-1]):
            if k in rules:
                head = len(rows)
            elif lines[k].strip() and not re.fullmatch(r"[-\s]+", lines[k]):
                cells = [lines[k][a : (None if n == len(spans) - 1 else spans[n + 1][0])].strip() for n, (a, _) in enumerate(spans)]
                if cells[0] or not rows:
                    rows.append([[c] for c in cells])
                else:
                    for cell, more in zip(rows[-1], cells, strict=True):
                        cell.append(more)
        return self.pipes([[" ".join(x for x in c if x) for c in r] for r in rows], head), rules[-1] + 1

    def grid(self, lines: list[str]) -> str:
        """Cells between the column borders of all rules; a cell that spans columns or rows stands in its first one."""
        cuts = sorted({m.start() for x in lines if x.startswith("+") for m in re.finditer(r"\+", x)})
        rows, cells, head = [], [[] for _ in cuts[1:]], 0
        for line in lines[1:]:
            rule = line.startswith("+") and re.fullmatch(r"[+\-=| ]*|\+.*", line) and not line.startswith("+ ")
            if rule and not re.search(r"[^+\-=]", line.rstrip()):
                if any(any(c) for c in cells):
                    rows.append([" ".join(x for x in c if x) for c in cells])
                if "=" in line:
                    head = len(rows)
                cells = [[] for _ in cuts[1:]]
                continue
            k = 0
            while k < len(cuts) - 1:
                to = k + 1
                while to < len(cuts) - 1 and line[cuts[to] : cuts[to] + 1] not in ("|", "+"):
                    to += 1
                cell = line[cuts[k] + 1 : cuts[to]].strip()
                if not re.fullmatch(r"-{3,}|={3,}", cell):
                    cells[k].append(cell)
                k = to
        if any(any(c) for c in cells):
            rows.append([" ".join(x for x in c if x) for c in cells])
        return self.pipes(rows, head)

    def pipes(self, rows: list[list[str]], head: int) -> str:
        if not rows:
            return ""
        width = max(map(len, rows))
        shown = ["| " + " | ".join(self.inline(c).replace("\n", " ").replace("|", r"\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
        top = shown[:1] if head else ["|" + "  |" * width]
        return "\n".join([*top, "|" + " --- |" * width, *shown[1 if head else 0 :]])

    def explicit(self, lines, at):
        line = lines[at]
        if not re.match(r"\.\.(\s|$)|__ ", line):
            return None
        end = self.body(lines, at + 1)
        if line.startswith("__ "):
            return "", at + 1
        if m := _DIRECTIVE.match(line):
            return ("" if m["sub"] else self.directive(m["name"].lower(), m["rest"], lines[at + 1 : end])), end
        if m := _FOOTNOTE.match(line):
            note = " ".join([m[2], *(x.strip() for x in lines[at + 1 : end])]).strip()
            return f"[^{m[1].lstrip('#') or '#'}]: {self.inline(note)}", end
        return "", end  # a target or a comment

    def directive(self, name: str, rest: str, inner: list[str]) -> str:
        inner = _dedent(inner) if name in CODE or not inner else inner
        given = _dedent(inner)
        options: dict[str, str] = {}
        k = 0
        while k < len(given) and given[k].strip() and not _FIELD.match(given[k]) and k == 0 and name in ("figure", "image"):
            k += 1
        while k < len(given) and (m := _FIELD.match(given[k])):
            options[m[1]] = given[k][m.end() :].strip()
            k += 1
        content = _dedent(given[k:])
        if name in HIDDEN:
            return ""
        if name in CODE:
            return _fenced(content, "" if name in ("parsed-literal", "literalinclude") else rest.split(" ")[0] or ("python" if name in ("ipython", "doctest", "testcode") else "")) if content else ""
        if name == "math":
            return "\n".join(["$$", *[x for x in (rest, *content) if x], "$$"])
        if name in ("image", "figure"):
            return "\n\n".join([f"![{options.get('alt', '')}]({rest})", *self.blocks(content)])
        if name in NOTES:
            label = {"versionadded": "New in version", "versionchanged": "Changed in version", "deprecated": "Deprecated since version", "seealso": "See also"}.get(name, name.capitalize())
            if name in ("admonition", "topic", "sidebar", "rubric"):
                label, rest = rest, ""
            first, *more = self.blocks([rest, "", *content] if name.startswith(("version", "deprecated")) else [*([rest] if rest else []), *content]) or [""]
            return _quoted("\n\n".join([f"**{self.inline(label)}:** {first}".rstrip(), *more]))
        if name == "list-table":
            rows = [[c for c in (self.text(x).replace("\n\n", " ").replace("\n", " ") for x in self.items(_dedent(r)))] for r in self.items(content)]
            return "\n\n".join([*([f"**{self.inline(rest)}**"] if rest else []), self.pipes(rows, int(options.get("header-rows") or 0))])
        if name == "csv-table":
            import csv

            rows = [*csv.reader([options["header"]], skipinitialspace=True)] if options.get("header") else []
            return self.pipes([[c.strip() for c in r] for r in [*rows, *csv.reader(content, skipinitialspace=True)]], len(rows) or int(options.get("header-rows") or 0))
        own = re.sub(r"^\w+:", "", name)
        return "\n\n".join([*([f"**{own}** `{rest}`" if ":" in name else f"**{own}** {self.inline(rest)}"] if rest else []), *self.blocks(content)])

    @staticmethod
    def items(lines: list[str]) -> list[list[str]]:
        """The bodies of the bullets of a list."""
        out: list[list[str]] = []
        for x in lines:
            if (m := _BULLET.match(x)) is not None:
                out.append([" " * m.end() + x[m.end() :] if x[m.end() :].strip() else ""])
            elif out:
                out[-1].append(x)
        return [_dedent(x) for x in out]

    def field_list(self, lines, at):
        if not (m := _FIELD.match(lines[at])):
            return None
        out = []
        while at < len(lines) and (m := _FIELD.match(lines[at])):
            end = self.body(lines, at + 1)
            first, more = lines[at][m.end() :].strip(), _dedent(lines[at + 1 : end])
            value = self.text([first, *more]) if more else self.inline(first)
            out.append(f"**{self.inline(m[1])}:** {value}".rstrip())
            at = end
        return "\n".join(out), at

    def doctest(self, lines, at):
        if not lines[at].startswith(">>> "):
            return None
        end = at
        while end < len(lines) and lines[end].strip():
            end += 1
        return _fenced([x.rstrip() for x in lines[at:end]], "python"), end

    def line_block(self, lines, at):
        if not re.match(r"\|( |$)", lines[at]):
            return None
        out = []
        while at < len(lines) and re.match(r"\|( |$)", lines[at]):
            out.append(lines[at][2:].rstrip())
            at += 1
            while at < len(lines) and lines[at].startswith(" ") and lines[at].strip():
                out[-1] += f" {lines[at].strip()}"
                at += 1
        return "  \n".join(map(self.inline, out)), at

    def lists(self, lines, at):
        mark = _BULLET if _BULLET.match(lines[at]) else _NUMBER if _NUMBER.match(lines[at]) else None
        if mark is None or (mark is _NUMBER and at + 1 < len(lines) and lines[at + 1].strip() and _indent(lines[at + 1]) == 0 and not _NUMBER.match(lines[at + 1])):
            return None
        out, loose = [], False
        while at < len(lines) and (m := mark.match(lines[at])):
            end = self.body(lines, at + 1, 1)
            parts = self.blocks([lines[at][m.end() :], *self.under(lines[at + 1 : end], m.end())])
            sign = "-" if mark is _BULLET else f"{len(out) + 1}."
            text = "\n\n".join(parts) if any(not re.match(r"(-|\d+\.) ", p) for p in parts[1:]) else "\n".join(parts)
            pad = " " * (len(sign) + 1)
            first, *more = text.split("\n")
            out.append("\n".join([f"{sign} {first}".rstrip(), *[f"{pad}{x}".rstrip() for x in more]]))
            at = end
            gap = at
            while gap < len(lines) and not lines[gap].strip():
                gap += 1
            if gap < len(lines) and mark.match(lines[gap]):
                loose, at = loose or "\n\n" in out[-1], gap
        return ("\n\n" if loose else "\n").join(out), at

    @staticmethod
    def under(lines: list[str], by: int) -> list[str]:
        """What belongs to an item, at the item's own indentation; lines indented by less still belong to it."""
        return [x[min(by, _indent(x)) :] for x in lines]

    def quote(self, lines, at):
        if not lines[at].startswith(" "):
            return None
        end = self.body(lines, at)
        return _quoted(self.text(_dedent(lines[at:end]))), end

    def definition(self, lines, at):
        if at + 1 >= len(lines) or not lines[at + 1].strip() or not lines[at + 1].startswith(" ") or lines[at].rstrip().endswith("::"):
            return None
        out = []
        while at + 1 < len(lines) and lines[at].strip() and not lines[at].startswith(" ") and lines[at + 1].startswith(" ") and lines[at + 1].strip():
            end = self.body(lines, at + 1)
            term = " — ".join(p.strip() for p in lines[at].split(" : "))
            out.append(f"**{self.inline(term)}**\n\n{self.text(_dedent(lines[at + 1 : end]))}")
            at = end
            while at < len(lines) and not lines[at].strip():
                at += 1
        return "\n\n".join(out), at

    def paragraph(self, lines, at):
        end = at
        while end < len(lines) and lines[end].strip() and (end == at or not lines[end].startswith(" ")):
            end += 1
        text = " ".join(x.strip() for x in lines[at:end])
        if not text.endswith("::"):
            return self.inline(text), end
        text = text[:-2].rstrip() if text[:-2].endswith((" ", ":")) or text == "::" else text[:-1]
        start = end
        while start < len(lines) and not lines[start].strip():
            start += 1
        if start < len(lines) and lines[start].startswith(" "):
            stop = self.body(lines, start)
            code = _dedent(lines[start:stop])
        else:
            stop = start  # a quoted literal block, whose lines begin with one and the same sign
            sign = lines[start][0] if start < len(lines) else ""
            while sign and not sign.isalnum() and stop < len(lines) and lines[stop].startswith(sign):
                stop += 1
            code = [x.rstrip() for x in lines[start:stop]]
            stop = stop if code else end
        return "\n\n".join([*([self.inline(text)] if text else []), *([_fenced(code)] if code else [])]), stop

    def inline(self, text: str) -> str:
        """Inline markup; what stands in literals is left alone."""
        held: list[str] = []

        def hold(s: str) -> str:
            held.append(s)
            return f"\0{len(held) - 1}\0"

        def link(m: re.Match) -> str:
            shown, url = re.fullmatch(r"(.*?)\s*(?:<([^<>]*)>)?", m[1], re.S).groups()
            url = url if url is not None else self.doc.targets.get(_name(m[1]), "")
            if url.endswith("_"):
                url = self.doc.targets.get(_name(url[:-1]), "")
            return hold(f"[{shown or url}]({url})") if url else shown

        def role(m: re.Match) -> str:
            title = re.fullmatch(r"(.*?)\s*<[^<>]*>", m[2], re.S)
            if m[1] in ("ref", "doc", "term", "numref"):
                return title[1] if title else m[2]
            if m[1] == "math":
                return hold(f"${m[2]}$")
            return hold(f"*{m[2]}*" if m[1] in ("emphasis", "title", "abbr") else f"**{m[2]}**" if m[1] == "strong" else f"`{title[1] if title else m[2].lstrip('~!')}`")

        rules: list[tuple[str, Callable[[re.Match], str]]] = [
            (r"``(.+?)``(?!`)", lambda m: hold(f"`{m[1]}`" if "`" not in m[1] else f"`` {m[1]} ``")),
            (r"\\(.)", lambda m: "" if m[1] == " " else hold(m[1])),
            (r"\|([^|\s](?:[^|]*[^|\s])?)\|_{0,2}", lambda m: self.inline(self.doc.words[_name(m[1])]) if _name(m[1]) in self.doc.words else m[0]),
            (r":([A-Za-z][\w+.:-]*):`([^`]+)`", role),
            (r"`([^`]+)`__?(?!\w)", link),
            (r"\[([\w#*.-]+)\]_(?!\w)", lambda m: hold(f"[^{m[1].lstrip('#') or '#'}]")),
            (r"`([^`]+)`(?!`)", lambda m: hold(f"*{m[1]}*")),
            (r"(?<![\w`])([A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?)__?(?![\w])", lambda m: link(m) if _name(m[1]) in self.doc.targets else m[0]),
        ]
        for pattern, of in rules:
            text = re.sub(pattern, of, text, flags=re.S)
        while "\0" in text:
            text = re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], text)
        return text


def rst_markdown(text: str) -> str:
    """Markdown of a whole document. NUL characters are dropped; tabs are eight columns wide."""
    lines = [x.expandtabs(8).rstrip() for x in text.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    doc = _Document()
    pending: list[str] = []
    for k, line in enumerate(lines):
        if m := _TARGET.match(line.strip()):
            url = "".join([m[2] or "", *(x.strip() for x in lines[k + 1 : _Parser.body(lines, k + 1, _indent(line) + 1)])]).strip()
            pending.append(_name(m[1]))
            if url:
                for name in pending:
                    doc.targets[name] = url
                pending = []
        elif line.strip():
            pending = []
        if (m := _DIRECTIVE.match(line.strip())) and m["sub"] and m["name"] in ("replace", "image", "unicode"):
            doc.words[_name(m["sub"])] = f"![{m['sub']}]({m['rest']})" if m["name"] == "image" else m["rest"]
    return "\n\n".join(_Parser(doc).blocks(lines))


def rst_to_markdown(docs: DataFrame, key: str) -> DataFrame:
    """PRS6/PRS8: key, title (the first heading, null without one), markdown of reStructuredText documents; null texts have null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                md = None if text is None else rst_markdown(text)
                title = re.search(r"(?m)^#+ (.*)$", md or "")
                rows.append((k, title[1] if title else None, md))
            yield pd.DataFrame(rows, columns=[key, "title", "markdown"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, title string, markdown string")
