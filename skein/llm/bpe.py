"""BPE encoding and decoding with a contiguous rank array per word.

Reads the tokenizers library's JSON format for models like word_bpe_49k: special tokens
cut out first, then NFC, lower case, a split into words, bytes as printable characters,
and merges by rank inside a word whose last character carries the end-of-word suffix.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.langid import Keys
from skein.plans.runtime import prepare

#: Words of up to so many bytes use the rank array, many words at a time; longer ones a heap of pairs: same merges.
SHORT = 32
#: Words merged at once.
WORDS = 20_000
#: Entries of a worker's cache of white-space-delimited pieces, which bounds its memory.
CACHE = 350_000
#: Characters whose pieces are looked up at once.
CHUNK = 1_500_000
#: White space by Unicode's White_Space property, as a character class.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The steps before the model that this module implements, as the file states them.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
_NONE = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _classes() -> tuple[str, str]:
    """Character classes of Unicode letters and numbers, from the general categories."""
    out = []
    for kind in "LN":
        spans: list[list[int]] = []
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] == kind:
                if spans and spans[-1][1] == cp - 1:
                    spans[-1][1] = cp
                else:
                    spans.append([cp, cp])
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans))
    return out[0], out[1]


def _byte_chars() -> list[str]:
    """A printable character for every byte: itself where it is one, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _joined(names: list[str], ids: list[int]) -> str:
    """The ids' names, joined by spaces."""
    return " ".join(itemgetter(*ids)(names)) if len(ids) > 1 else " ".join(names[i] for i in ids)


class Bpe:
    """vocab: token -> id; merges: pairs by rank; special: strings -> id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int], suffix: str):
        letters, numbers = _classes()
        self.vocab, self.suffix, self.special, self.bytes = vocab, suffix, special, _byte_chars()
        self.ranks = {tuple(m): k for k, m in enumerate(merges)}
        shown = {i: t for t, i in (vocab | special).items()}
        self.tokens = [shown.get(i) for i in range(max(shown) + 1)]
        self.decimal = list(map(str, range(len(self.tokens))))
        pairs = self._hash(*np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2).T)
        self.by_hash = np.argsort(pairs)
        self.index = Keys(pairs[self.by_hash])
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.first, self.last = np.full((2, 0x200), -1, np.int64)
        for c in self.bytes:
            self.first[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]
        self.words: dict[str, list[int]] = {}
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        self.space = re.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # white space to str.split() only
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.ids: dict[str | int, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        odd += [k for k, v in STEPS.items() if spec[k] != v]
        if model["type"] != "BPE" or odd or max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) >= 1 << 20:
            raise ValueError(f"a tokenizer of another kind: {odd}")
        return cls(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], {t["content"]: t["id"] for t in spec["added_tokens"]}, model["end_of_word_suffix"] or "")

    def __reduce__(self):
        return Bpe, (self.vocab, sorted(self.ranks, key=self.ranks.get), self.special, self.suffix)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of words of byte characters.

        A row a word: ids of the parts from each boundary on, and the ranks of adjacent parts. Each round scans every
        row for its lowest rank, deletes that boundary, and looks up the two ranks beside it; finished rows leave.
        """
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self._merge_long(w)
        for lo in range(0, len(short), WORDS):
            rows = np.array(short[lo : lo + WORDS])
            lens = np.array([len(words[k]) for k in rows])
            width = int(lens.max()) + 2
            ids = np.full((len(rows), width), -1, np.int64)
            own = np.repeat(np.arange(len(rows)), lens)
            col = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            text = "".join([words[k] for k in rows])
            ids[own, col] = self.first[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            ids[np.arange(len(rows)), lens - 1] = self.last[np.frombuffer("".join([words[k][-1] for k in rows]).encode("utf-32-le"), np.uint32)]
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            cols = np.arange(width - 1)
            while len(rows):
                at = rank.argmin(axis=1)
                line = np.arange(len(rows))
                low = rank[line, at]
                done = low == _NONE
                for k, row in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = row[: row.index(-1)]
                rows, ids, rank, at, low = rows[~done], ids[~done], rank[~done], at[~done], low[~done]
                if not len(rows):
                    break
                line = np.arange(len(rows))
                ids[line, at] = self.merged[low]
                later = cols > at[:, None]
                ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
                rank[:, :-1] = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
                rank[line, at] = self._rank(ids[line, at], ids[line, at + 1])
                left = np.maximum(at - 1, 0)
                rank[line, left] = self._rank(ids[line, left], ids[line, left + 1])
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(a.shape, _NONE, np.int64)
        both = (a >= 0) & (b >= 0)
        i = self.index.find(self._hash(a[both], b[both]))
        out[both] = np.where(i >= 0, self.by_hash[i], _NONE)
        return out

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of a pair of ids: an odd multiple of the packed pair, so different pairs differ."""
        return (a << 20 | b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def _merge_long(self, word: str) -> list[int]:
        parts: list[str | None] = [*word[:-1], word[-1] + self.suffix]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p is not None]

    def _learn(self, texts: list[list[str | int]]) -> None:
        """Make the cache hold every piece of the texts: words new to it are merged together."""
        for cache in (self.ids, self.words):
            if len(cache) >= CACHE:
                self.words.clear()
                self.ids.clear()
        new = list(set().union(*texts).difference(self.ids))
        split = [[] if isinstance(p, int) else [p] if p.isalpha() else self.word.findall(p) for p in new]  # isalpha: letters by general category, one word
        words = list(set(chain.from_iterable(split)).difference(self.words))
        chars = self.bytes
        for w, ids in zip(words, self.merge(["".join([chars[b] for b in w.encode("utf-8")]) for w in words]), strict=True):
            self.words[w] = ids
        for p, ws in zip(new, split, strict=True):
            self.ids[p] = [p] if isinstance(p, int) else self.words[ws[0]] if len(ws) == 1 else [i for w in ws for i in self.words[w]]

    def _pieces(self, text: str) -> list[str | int]:
        """Special ids, and pieces of normalised text between white space."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:]) if out else self._plain(text[at:])

    def _plain(self, run: str) -> list[str]:
        run = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
        return list(filter(None, self.space.split(run))) if self.odd.search(run) else run.split()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        out = []
        for pieces in self._chunks(texts):
            out += [list(chain.from_iterable(map(self.ids.__getitem__, t))) for t in pieces]
        return out

    def _chunks(self, texts: list[str | None]):
        """The texts' pieces, some texts at a time, once the cache holds them."""
        lo, size = 0, 0
        for k, t in enumerate([*texts, None]):
            if k == len(texts) or size > CHUNK:
                pieces = [self._pieces(x or "") for x in texts[lo:k]]
                self._learn(pieces)
                yield pieces
                lo, size = k, 0
            size += len(t or "")

    def decode(self, ids) -> str:
        """Tokens of the ids, joined by spaces, as the library does for a model without a decoder."""
        return _joined(self.tokens, ids)

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: number of tokens, SHA-256 of the decimal ids and of the decoded text, both joined by single spaces."""
        out = []
        for ids in self.encode(texts):
            shown, text = _joined(self.decimal, ids), self.decode(ids)
            out.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()))
        return out


_loaded: dict[str, Bpe] = {}


def _worker(key: str, shared) -> Bpe:
    """This worker's tokenizer, with its cache, kept from task to task."""
    if key not in _loaded:
        _loaded[key] = shared.value
    return _loaded[key]


def _mapped(docs: DataFrame, path: str | None, of, schema: str) -> DataFrame:
    path = path or default_path()
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Bpe.load(path))  # as large as the vocabulary file
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = _worker(path, shared)
        for b in batches:
            rows = of(bpe, b.column(1).to_pylist())
            cols = [pa.array([r[k] for r in rows], types.get(c, pa.string())) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return docs.select("doc_id", docs.columns[-1] if "text" not in docs.columns else "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; a null or empty text has no ids. Special tokens' strings become their ids."""
    return _mapped(docs, path, lambda bpe, texts: [(x,) for x in bpe.encode(texts)], "ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text (tokens joined by spaces) of rows doc_id, ids; null ids give an empty text."""
    return _mapped(encoded.select("doc_id", "ids"), path, lambda bpe, rows: [(bpe.decode(ids or ()),) for ids in rows], "text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded from the ids.

    Null and empty texts have no tokens. Repeated rows each keep a row; a null doc_id stays; further columns are not read.
    """
    return _mapped(docs, path, Bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
