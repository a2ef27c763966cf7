"""Splitting documents into chunks: windows, paragraphs, headings, code, JSON, token budgets, parents and children.

What needs no state is array work in the JVM; recursive splitters are Python functions
over Arrow batches, a document at a time, so they stay within one task and need no shuffle.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

CHUNK = "chunk_index int, total_chunks int, start_offset int, end_offset int, section_header string, heading_path array<string>, chunk_type string, text string"


def windows(docs: DataFrame, key: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """CHK1 in its fixed-window form: characters start .. start + size, each window overlap back from the last one's end."""
    step = size - overlap
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1) * step, F.lit(step)))
    out = docs.where(n > 0).select(key, "text", F.posexplode(starts).alias("chunk_index", "start_offset"))
    piece = F.substring(F.col("text"), F.col("start_offset") + 1, F.lit(size))
    return out.select(key, "chunk_index", "start_offset", (F.col("start_offset") + F.length(piece)).alias("end_offset"), piece.alias("text"))


def paragraphs(docs: DataFrame, key: str, least_words: int = 10) -> DataFrame:
    """CHK4: paragraphs between blank lines of at least least_words words, trimmed, numbered as they stand."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n", -1), T.strip), lambda p: T.word_count(p) >= least_words)
    return docs.select(key, F.posexplode(parts).alias("chunk_index", "text"))


def line_blocks(docs: DataFrame, key: str, size: int = 200) -> DataFrame:
    """CHK9 by count alone: runs of at most size lines."""
    lines = F.split("text", "\n", -1)
    return docs.select(key, lines.alias("l")).select(key, "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int"))).alias("chunk_index")).select(key, "chunk_index", F.array_join(F.slice("l", F.col("chunk_index") * size + 1, size), "\n").alias("text"))


def route() -> F.Column:
    """CHK18: which splitter a row (doc_type, text, url) goes to."""
    t, d = F.ltrim(F.col("text")), F.col("doc_type")
    return (
        F.when(d.isin("api_reference", "code_example", "sql_function_ref"), d).when(t.rlike(r"^[\{\[]") & F.try_parse_json("text").isNotNull(), "json")
        .when(F.col("text").rlike(r"(?m)^(def|class|import|from) \w+"), "code").when(F.col("text").rlike(r"(?m)^#{1,6}\s+\S"), "guide").otherwise("generic")
    )


# Boundaries of the lossless splitter, coarse to fine; each match begins a new unit.
_BOUNDARIES = [re.compile(p, re.M) for p in (r"(?=^#{1,6}\s)", r"(?<=\n\n)(?=\S)", r"(?=^\s*(?:[-*+]|\d+\.)\s)", r"(?<=[.!?])\s+(?=\S)", r"(?<=\n)(?=.)", r"(?<=\s)(?=\S)")]
_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[ \t]*$|\Z)\n?", re.M | re.S)


def count_tokens(text: str) -> int:
    """FN18: the default count, four characters a token."""
    return math.ceil(len(text) / 4)


def lossless_split(text: str, budget: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """CHK15/CHK16: pieces within the budget whose concatenation is the text; fences that fit stay whole, blank pieces join a neighbour."""
    if not text:
        return []
    units, at = [], 0
    for m in _FENCE.finditer(text):
        units += [(text[at : m.start()], False), (m[0], True)]
        at = m.end()
    units.append((text[at:], False))
    out: list[str] = []

    def pack(parts: list[str], level: int):
        held = ""
        for p in parts:
            if held and count(held + p) > budget:
                out.append(held)
                held = ""
            if count(p) > budget:
                if held:
                    out.append(held)
                    held = ""
                split(p, level + 1)
            else:
                held += p
        if held:
            out.append(held)

    def split(part: str, level: int):
        if level >= len(_BOUNDARIES):
            step = max(1, len(part) * budget // max(1, count(part)))
            while step > 1 and count(part[:step]) > budget:
                step -= 1
            out.extend(part[k : k + step] for k in range(0, len(part), step))
            return
        cuts = sorted({0, len(part), *(m.end() for m in _BOUNDARIES[level].finditer(part))})
        pack([part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], level)

    for part, fenced in units:
        if part and fenced and count(part) <= budget:
            out.append(part)
        elif part:
            pack([part], -1)
    merged: list[str] = []
    for p in out:
        if merged and (not p.strip() or not merged[-1].strip()):
            merged[-1] += p
        else:
            merged.append(p)
    return merged


def sections(text: str) -> list[tuple[list[str], str]]:
    """CHK10/WIN5: (heading path, body) of each section at ATX headings outside fences; text before the first has no path."""
    out: list[tuple[list[str], list[str]]] = [([], [])]
    stack: list[tuple[int, str]] = []
    fence = False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        m = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            level = len(m[1])
            stack = [x for x in stack if x[0] < level] + [(level, m[2])]
            out.append(([t for _, t in stack], []))
        else:
            out[-1][1].append(line)
    return [(path, body) for path, lines in out if (body := "\n".join(lines).strip()) or path]


def header_chunks(text: str, most_words: int = 375, overlap: int = 90, least_words: int = 10) -> list[tuple[list[str], str]]:
    """CHK3: sections cut to most_words words with overlap words repeated; one too short is joined to the chunk before it."""
    out: list[tuple[list[str], str]] = []
    for path, body in sections(text):
        words = body.split()
        if not words:
            continue
        if len(words) < least_words and out:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + body)
        elif len(words) <= most_words:
            out.append((path, body))
        else:
            for k in range(0, max(1, len(words) - overlap), most_words - overlap):
                out.append((path, " ".join(words[k : k + most_words])))
    return out


def sentence_chunks(text: str, budget: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """CHK2: whole sentences packed up to the budget; code in fences or backticks isn't cut; "".join gives the text back."""
    masked = re.sub(r"```.*?```|`[^`\n]+`", lambda m: "\0" * len(m[0]), text, flags=re.S)
    cuts = [0, *(m.end() for m in re.finditer(r"[.!?]+[\"')\]]*\s+", masked)), len(text)]
    out, held = [], ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        s = text[a:b]
        if held and count(held + s) > budget:
            out.append(held)
            held = ""
        if count(s) > budget:
            out += lossless_split(s, budget, count)
        else:
            held += s
    return [*out, held] if held else out


def json_units(text: str, budget: int, count: Callable[[str], int] = count_tokens) -> list[tuple[str, str]] | None:
    """CHK6: (path, JSON) of the largest parts that fit the budget; None if the text is no JSON."""
    try:
        root = json.loads(text)
    except ValueError:
        return None
    out: list[tuple[str, str]] = []

    def walk(path: str, value):
        s = json.dumps(value, ensure_ascii=False)
        if count(s) <= budget:
            out.append((path, s))
        elif isinstance(value, dict) and value:
            for k, v in value.items():
                walk(f"{path}.{k}", v)
        elif isinstance(value, list) and value:
            for k, v in enumerate(value):
                walk(f"{path}[{k}]", v)
        else:
            out.extend((path, p) for p in lossless_split(s, budget, count))

    walk("$", root)
    return out


def python_units(text: str) -> list[str]:
    """CHK8: pieces that begin at unindented def, class or decorator lines."""
    cuts = [0, *(m.start() for m in re.finditer(r"^(?:@\w|(?:async )?def |class )", text, re.M)), len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]
    merged: list[str] = []
    for p in parts:
        if merged and merged[-1].lstrip().startswith("@") and "\n" not in merged[-1].strip():
            merged[-1] += p
        else:
            merged.append(p)
    return merged


def python_structure(text: str) -> list[tuple[str, str, int, int]]:
    """CHK22: (kind, name, first line, last line) of functions and classes; none for text that isn't Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(kinds[type(n)], n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if type(n) in kinds]


def valid_python(text: str) -> bool:
    """FN28: whether every fenced python block parses."""
    for block in re.findall(r"```(?:python|py)\n(.*?)```", text, re.S):
        try:
            ast.parse(block)
        except (SyntaxError, ValueError):
            return False
    return True


def mask_code(text: str) -> tuple[str, list[str]]:
    """CHK20: fences and inline code as numbered sentinels, and what they stand for; an open fence leaves the text as it is."""
    if len(re.findall(r"^```", text, re.M)) % 2:
        return text, []
    held: list[str] = []

    def put(m):
        held.append(m[0])
        return f"\0{len(held) - 1}\0"

    return re.sub(r"```.*?```|`[^`\n]+`", put, text, flags=re.S), held


def unmask_code(text: str, held: list[str]) -> str:
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], text)


def semantic_chunks(sentences: list[str], vectors: list[list[float]], threshold: float = 0.5, target_words: int = 375) -> list[str]:
    """A contiguous variant of CHK5: neighbouring sentences stay together while they are like the cluster's mean, up to the target length."""
    import numpy as np

    out, held, centre = [], [], None
    for s, v in zip(sentences, vectors, strict=True):
        v = np.asarray(v, float)
        if held:
            n = np.linalg.norm(centre) * np.linalg.norm(v)
            like = float(centre @ v / n) if n else 0.0
            if like < threshold or sum(len(x.split()) for x in held) + len(s.split()) > target_words:
                out.append(" ".join(held))
                held, centre = [], None
        centre = v if centre is None else (centre * len(held) + v) / (len(held) + 1)
        held.append(s)
    return [*out, " ".join(held)] if held else out


def sentence_spans(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end): cut after full stops that white space follows; code in fences or backticks isn't cut."""
    masked = re.sub(r"```.*?```|`[^`\n]+`", lambda m: "\0" * len(m[0]), text, flags=re.S)
    cuts = [0, *(m.end() for m in re.finditer(r"[.!?]+[\"')\]]*\s+", masked)), len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        whole = text[a:b]
        s = whole.strip()
        if s:
            start = a + whole.index(s)
            out.append((s, start, start + len(s)))
    return out


def cluster_sentences(vectors, threshold: float = 0.5) -> list[list[int]]:
    """CHK5: each vector in turn joins the cluster whose mean direction is the most similar of all, the first of equals, if by threshold or more; else it begins one.

    A cluster is its running sum of unit vectors, so a step is one product with all sums, whatever the clusters hold.
    """
    import numpy as np

    rows = np.asarray(vectors, float)
    if not len(rows):
        return []
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(norm > 0, norm, 1)
    sums, norms, out = np.zeros_like(rows), np.ones(len(rows)), []
    for i, v in enumerate(rows):
        n = len(out)
        like = sums[:n] @ v / norms[:n]
        at = int(like.round(9).argmax()) if n else 0
        if not n or like[at] < threshold - 1e-9:
            at = n
            out.append([])
        out[at].append(i)
        sums[at] += v
        norms[at] = np.linalg.norm(sums[at]) or 1.0
    return out


def pack_clusters(spans: list[tuple[str, int, int]], clusters: list[list[int]], target_words: int = 375, overlap_words: int = 90, most_words: int | None = None, least_words: int = 20) -> list[tuple[str, int, int, int]]:
    """CHK5: (text, start, end, clusters) of chunks of whole clusters in order, up to target_words.

    A chunk after another begins with the last overlap_words words of that one's last sentence. One of more than
    most_words (half as many again as the target) is closed at once. Chunks of fewer than least_words words, or without a
    letter or digit, are dropped. start is that of the chunk's first sentence, end that of its last, in the order of clusters.
    """
    most_words = most_words or target_words * 3 // 2
    out: list[tuple[str, int, int, int]] = []
    held: list[tuple[str, int, int]] = []  # text, first and last sentence
    carried = words = 0

    def close() -> None:
        nonlocal held, carried, words
        text = " ".join(t for t, _, _ in held).strip()
        if len(text.split()) >= least_words and any(c.isalnum() for c in text):
            out.append((text, spans[held[0][1]][1], spans[held[-1][2]][2], len(held) - carried))
        held, carried, words = [], 0, 0

    for own in clusters:
        text = " ".join(spans[i][0] for i in own)
        n = len(text.split())
        if held and words + n > target_words:
            last = held[-1][2]
            close()
            tail = spans[last][0].split()[-overlap_words:] if out and overlap_words else []
            if tail:
                held, carried, words = [(" ".join(tail), last, last)], 1, len(tail)
        held.append((text, own[0], own[-1]))
        words += n
        if words > most_words:
            close()
    if held:
        close()
    return out


def sentences(docs: DataFrame, key: str) -> DataFrame:
    """key, sentences (array of sentence, start, end) of every text; null texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "sentences": [[{"sentence": s, "start": a, "end": b} for s, a, b in sentence_spans(t or "")] for t in pdf["text"]]})

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, sentences array<struct<sentence: string, start: int, end: int>>")


def with_vectors(split: DataFrame, dims: int = 64) -> DataFrame:
    """sentences()'s rows with a vector of each sentence where no model gives one: hashed token counts (MDL1)."""
    from skein.operators import models

    return split.withColumn("vectors", F.transform("sentences", lambda s: models.hashed_vector(s["sentence"], dims)))


def semantic_clusters(split: DataFrame, key: str, threshold: float = 0.5, target_words: int = 375, overlap_words: int = 90, least_words: int = 20) -> DataFrame:
    """CHK5: key, chunk_index, total_chunks, start_offset, end_offset, n_clusters, text of rows with sentences and a vector of each (vectors)."""
    kind = split.schema[key].dataType.simpleString()
    names = ["chunk_index", "total_chunks", "start_offset", "end_offset", "n_clusters", "text"]

    def run(frames):
        for pdf in frames:
            rows = []
            for k, own, vectors in zip(pdf[key], pdf["sentences"], pdf["vectors"], strict=True):
                spans = [(s["sentence"], s["start"], s["end"]) for s in own]
                found = pack_clusters(spans, cluster_sentences([list(v) for v in vectors], threshold), target_words, overlap_words, least_words=least_words)
                rows += [(k, i, len(found), a, b, n, t) for i, (t, a, b, n) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return split.select(key, "sentences", "vectors").mapInPandas(run, f"{key} {kind}, chunk_index int, total_chunks int, start_offset int, end_offset int, n_clusters int, text string")


def split_documents(docs: DataFrame, key: str, how: str, budget: int = 256) -> DataFrame:
    """Chunks of every document by one of the Python splitters: header, sentence, budget, json or python.

    Columns: the key and CHUNK. Offsets are -1 where a splitter rewrites white space. Null texts have no chunks.
    """
    kind = docs.schema[key].dataType.simpleString()

    def pieces(text: str) -> list[tuple[list[str], str, str]]:
        if how == "header":
            return [(p, "text", t) for p, t in header_chunks(text)]
        if how == "sentence":
            return [([], "text", t) for t in sentence_chunks(text, budget)]
        if how == "json" and (units := json_units(text, budget)) is not None:
            return [([p], "structured", t) for p, t in units]
        if how == "python":
            return [([], "code", t) for t in python_units(text)]
        return [([], "text", t) for t in lossless_split(text, budget)]

    def run(frames):
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                if text is None:
                    continue
                found, at = pieces(text), 0
                for i, (path, what, t) in enumerate(found):
                    start = text.find(t, at)
                    at = start if start >= 0 else at
                    rows.append((k, i, len(found), start, start + len(t) if start >= 0 else -1, path[-1] if path else "", path, what, t))
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in CHUNK.split(", ")]])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, {CHUNK}")


def hierarchical(docs: DataFrame, key: str, parent_budget: int = 1024, child_budget: int = 256) -> DataFrame:
    """CHK14/CHK17: parents and their children, both lossless: key, chunk_id, parent_chunk_id, level, segment_index, segment_total, token_count, content_hash, text."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, chunk_id string, parent_chunk_id string, level string, segment_index int, segment_total int, token_count int, text string"

    def run(frames):
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                parents = lossless_split(text or "", parent_budget)
                for i, p in enumerate(parents):
                    pid = f"{k}:p{i}"
                    rows.append((k, pid, "", "parent", i, len(parents), count_tokens(p), p))
                    children = lossless_split(p, child_budget)
                    rows += [(k, f"{pid}:c{j}", pid, "child", j, len(children), count_tokens(c), c) for j, c in enumerate(children)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.select(key, "text").mapInPandas(run, schema).withColumn("content_hash", F.sha2("text", 256))


def late_chunks(tokens: DataFrame) -> DataFrame:
    """CHK21: mean of the token vectors of each segment's span (parent, segment, start, end, token vectors by position), scaled to length one."""
    inside = tokens.where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    parts = inside.select("parent", "segment", F.posexplode("vec").alias("d", "x")).groupBy("parent", "segment", "d").agg(F.avg("x").alias("x"))
    vec = parts.groupBy("parent", "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))
    n = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return vec.select("parent", "segment", F.transform("vec", lambda x: F.when(n > 0, x / n).otherwise(x)).alias("vec"))


def code_chunk(text: str, header: str) -> tuple[str, str]:
    """CHK19: (type, text) of a chunk; one mostly of fenced code is of type code and begins with its scope."""
    fenced = sum(len(m) for m in re.findall(r"```.*?```", text, re.S))
    if text and fenced / len(text) >= 0.6:
        return "code", f"[Scope: {header}]\n{text}" if header else text
    return "text", text


_FENCED = re.compile(r"^(```|~~~).*?^\1[ \t]*$", re.M | re.S)


def rendered_kind(header: str, body: str) -> str:
    """CHK13: code where a section begins with a fence, mixed where it has one, api by words of its header, else text."""
    if _FENCED.search(body):
        return "code" if body.lstrip().startswith(("```", "~~~")) else "mixed"
    low = header.lower()
    return "api" if any(w in low for w in ("api", "class ", "method ", "function ")) else "text"


def rendered_sections(docs: DataFrame, key: str, least_words: int = 10) -> DataFrame:
    """CHK10/CHK13: key, chunk_index, total_chunks, heading_path, chunk_type, text of a rendered page's sections, or of its longer paragraphs where it has no heading."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                found = [(path, body) for path, body in sections(text or "") if body]
                if not any(path for path, _ in found):
                    parts = [p.strip() for p in re.split(r"\n\s*\n", text or "")]
                    found = [([], p) for p in parts if len(p.split()) >= least_words] or [([], text)] * bool((text or "").strip())
                rows += [(k, i, len(found), path, rendered_kind(path[-1] if path else "", body), body) for i, (path, body) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "total_chunks", "heading_path", "chunk_type", "text"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, chunk_index int, total_chunks int, heading_path array<string>, chunk_type string, text string")


def blank_line_units(text: str, most_lines: int = 200) -> list[str]:
    """CHK9: blocks between blank lines, joined up to most_lines lines; a longer block is cut at that."""
    out: list[list[str]] = []
    for block in re.split(r"\n[ \t]*\n", text):
        lines = block.split("\n")
        if out and len(out[-1]) + len(lines) + 1 <= most_lines:
            out[-1] += ["", *lines]
        else:
            out += [lines[k : k + most_lines] for k in range(0, len(lines), most_lines)]
    return [t for t in ("\n".join(x).strip("\n") for x in out) if t.strip()]


def by_type(docs: DataFrame, key: str) -> DataFrame:
    """CHK7: chunks of documents (text, doc_type, language): guides by headings, references and examples by top-level code or blank lines; another type is an error."""
    kind = docs.schema[key].dataType.simpleString()
    types = {"guide": "text", "api_reference": "api", "code_example": "code"}

    def run(frames):
        for pdf in frames:
            rows = []
            for k, text, what, language in zip(pdf[key], pdf["text"], pdf["doc_type"], pdf["language"], strict=True):
                if not (text or "").strip():
                    continue
                if what not in types:
                    raise ValueError(f"no splitter for documents of type {what!r}")
                pieces = [t for _, t in header_chunks(text)] if what == "guide" else python_units(text) if language == "python" else blank_line_units(text)
                rows += [(k, i, len(pieces), types[what], t) for i, t in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "total_chunks", "chunk_type", "text"])

    return docs.select(key, "text", "doc_type", "language").mapInPandas(run, f"{key} {kind}, chunk_index int, total_chunks int, chunk_type string, text string")


def code_facts(docs: DataFrame, key: str) -> DataFrame:
    """CHK19/CHK20/CHK22/FN28: of each row (text, source): the kind of chunk, the structure of its source, and whether its fenced code parses. Masked code must come back as it was."""
    name = docs.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = []
            for k, text, source in zip(pdf[key], pdf["text"], pdf["source"], strict=True):
                masked, held = mask_code(text or "")
                if unmask_code(masked, held) != (text or ""):
                    raise ValueError("masked code didn't come back")
                shape = ";".join(":".join(map(str, x)) for x in python_structure(source or ""))
                rows.append((k, code_chunk(text or "", "")[0], shape, valid_python(text or "")))
            yield pd.DataFrame(rows, columns=[key, "kind", "structure", "valid"])

    return docs.select(key, "text", "source").mapInPandas(run, f"{key} {name}, kind string, structure string, valid boolean")


def semantic(docs: DataFrame, key: str, threshold: float = 0.5, target_words: int = 375) -> DataFrame:
    """CHK5: key, chunk_index, text of documents given as sentences and their vectors."""
    name = docs.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = [(k, i, t) for k, s, v in zip(pdf[key], pdf["sentences"], pdf["vectors"], strict=True) for i, t in enumerate(semantic_chunks(list(s), [list(x) for x in v], threshold, target_words))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "text"])

    return docs.select(key, "sentences", "vectors").mapInPandas(run, f"{key} {name}, chunk_index int, text string")
