"""Cross-tokenizer alignment: token intervals of two tokenizers over the same bytes, joined in DuckDB inside each Arrow partition.

Both tokenizers work on stretches of a text that start with the space before a word; no token of either crosses such a
boundary (A cuts there before it merges, and B has no piece with a space after another character). So a task tokenizes each
distinct stretch of a few MB of texts once. DuckDB holds the tokens' byte intervals; ASOF joins find the B token over an A
token's first byte and, as the range join, the B tokens that begin inside an A token: together all overlaps. Window sums over
the common cuts number the groups. Pair lists of documents and partial counts of pairs leave the task.

Spark merges the partial counts. The links of a document are then looked up in two ways: pairs that hold at least one in
FREQUENT of all (document, pair) rows are at most FREQUENT and are broadcast; the others are joined by an ordinary shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.runtime import prepare, stage

#: Bytes of texts that a task aligns at once (a longer text by itself), and of stretches in one call of a tokenizer.
GATHER, CALL = 6 << 20, 1 << 15
#: Stretches of more characters go to A's own library, others to one that merges short words faster.
LONG = 500
#: Fixed value: how A cuts a text before it merges.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: At most so many pairs are broadcast, of 24 bytes each.
FREQUENT = 1 << 18
#: A stretch: white space and what follows up to the next space after a black character; white space at the end stays with the last one.
STRETCH = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S++|\s++\Z)*+|\s++\Z")
_SCHEMA = "row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, x array<int>, y array<int>, m array<long>, counts boolean"

_SQL = {
    # the B token over each A token's first byte; cut: both start there
    "over": "SELECT a.seg, a.s, a.id AS x, b.id AS y, b.s = a.s AS cut FROM a ASOF JOIN b ON a.s >= b.s",
    # the A token over each B token's first byte
    "under": "SELECT b.seg, b.s, a.id AS x, b.id AS y, b.s = a.s AS cut FROM b ASOF JOIN a ON b.s >= a.s",
    # all overlaps: the first of these, and the B tokens that begin inside an A token
    "link": "SELECT seg, x, y, count(*) AS m FROM (SELECT seg, x, y FROM over UNION ALL SELECT seg, x, y FROM under WHERE NOT cut) GROUP BY ALL",
    # the tokens group by group, A's before B's; kind: 0 inside a side of a group, 1 first of A's, 2 first of B's
    "shown": """
      SELECT seg, id, kind FROM (
        SELECT seg, s, x AS id, sum(cut::INT) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS g, 0 AS side, cut::INT AS kind FROM over
        UNION ALL SELECT seg, s, y, sum(cut::INT) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING), 1, 2 * cut::INT FROM under)
      ORDER BY g, side, s""",
    "per_seg": """
      SELECT a.seg, n_a, n_b, n_groups, n_links
      FROM (SELECT seg, count(*) AS n_a, sum(cut::INT)::BIGINT AS n_groups FROM over GROUP BY seg) a
      JOIN (SELECT seg, count(*) AS n_b FROM under GROUP BY seg) b ON a.seg = b.seg
      JOIN (SELECT seg, sum(m)::BIGINT AS n_links FROM link GROUP BY seg) l ON a.seg = l.seg""",
    "pair": "SELECT doc, x, y, sum(m * c)::BIGINT AS m FROM (SELECT doc, seg, count(*) AS c FROM occ GROUP BY ALL) JOIN link USING (seg) GROUP BY ALL",
}
_DOCS = """
  SELECT p.doc, n_a, n_b, n_groups, n_links, x, y, m
  FROM (SELECT doc, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(n_groups)::BIGINT AS n_groups, sum(n_links)::BIGINT AS n_links
        FROM occ JOIN per_seg USING (seg) GROUP BY doc) d
  JOIN (SELECT doc, list(x) AS x, list(y) AS y, list(m) AS m FROM pair GROUP BY doc) p ON d.doc = p.doc
  ORDER BY p.doc"""
_COUNTS = "SELECT list(x) AS x, list(y) AS y, list(c) AS m FROM (SELECT x, y, count(*) AS c FROM pair GROUP BY x, y) HAVING count(*) > 0"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Tokenizer A (byte-level BPE, JSON) and B (sentence pieces), with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["id"] for t in spec["added_tokens"]}
        merged = [vocab[m.replace(" ", "") if isinstance(m, str) else m[0] + m[1]] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("A is a tokenizer of another kind")
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        byte = {chr(b) if b in shown else chr(next(rest)): b for b in range(256)}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        self.short = Encoding("a", pat_str=CUT, mergeable_ranks={self.bytes_a[i]: i for i in vocab.values() if i not in special}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B has a space after another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.shown = [f"{sep}{i}" for sep in (",", ";", "|") for i in range(max(len(self.bytes_a), len(pieces)))]

    def ids(self, texts: list[str], short: bool) -> tuple[list[list[int]], list[list[int]]]:
        """Of strings that start with a space; short: none has a stretch of more than LONG characters."""
        a = [self.short.encode_ordinary(t) for t in texts] if short else [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def lossless(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def tables(self, stretches: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], set[int]]:
        """seg, id, s of A's and of B's tokens over the stretches' bytes laid end to end; the stretches that don't come back from their tokens, which have none."""
        spans, bad, call, size = [], set(), [], 0
        for k, t in enumerate(stretches):
            alone = len(t) > LONG or t[-1].isspace()  # white space at a text's end is no place to go on from
            if call and (alone or size + len(t) > CALL):
                self._call(stretches, call, True, spans, bad)
                call, size = [], 0
            if alone:
                self._call(stretches, [k], len(t) <= LONG, spans, bad)
            else:
                call.append(k)
                size += len(t)
        if call:
            self._call(stretches, call, True, spans, bad)
        order = np.fromiter(chain.from_iterable(c for c, _, _ in spans), np.int64)
        ends = np.cumsum(np.fromiter((len(stretches[k].encode()) for k in order), np.int64, len(order)))
        out = []
        for lens, ids in ((self.len_a, [a for _, a, _ in spans]), (self.len_b, [b for _, _, b in spans])):
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            e = np.cumsum(lens[flat]) if len(flat) else np.zeros(0, np.int64)
            if len(ends) and not np.array_equal(e[np.minimum(np.searchsorted(e, ends), len(e) - 1)], ends):
                raise ValueError("a token crosses the boundary of a stretch")
            out.append([order[np.searchsorted(ends, e - lens[flat], side="right")].astype(np.int32), flat, e - lens[flat]])
        return out[0], out[1], bad

    def _call(self, stretches: list[str], call: list[int], short: bool, spans: list, bad: set[int]) -> None:
        """The tokens of some stretches laid end to end, or, where bytes are lost, of each by itself."""
        text = "".join([stretches[k] for k in call])
        (a,), (b,) = self.ids([text], short)
        if self.lossless(text, a, b):
            spans.append((call, a, b))
        elif len(call) == 1:
            bad.add(call[0])
        else:
            for k in call:
                self._call(stretches, [k], short, spans, bad)

    def stretches(self, texts: list[str]) -> tuple[list[array], list[list[np.ndarray]]]:
        """Each text's stretches by number, and the tables of their tokens; texts that their stretches don't give back are encoded whole, and have no stretch if even so they aren't."""
        parts = [STRETCH.findall(" " + t) if t else [] for t in texts]
        names = list(dict.fromkeys(chain.from_iterable(parts)))
        number = {p: k for k, p in enumerate(names)}
        found = [array("i", map(number.__getitem__, p)) for p in parts]
        del parts, number
        a, b, bad = self.tables(names)
        if bad:
            whole = [k for k, segs in enumerate(found) if not bad.isdisjoint(segs)]
            for k in whole:
                found[k] = array("i")
            own = [" " + texts[k] for k in whole]
            base = max((int(x[2][-1]) for x in (a, b) if len(x[2])), default=0) + max(self.len_a.max(), self.len_b.max())
            for k, t, x, y in zip(whole, own, *self.ids(own, False), strict=True):
                if self.lossless(t, x, y):
                    found[k] = array("i", [len(names)])
                    for table, ids, lens in ((a, x, self.len_a), (b, y, self.len_b)):
                        flat = np.array(ids, np.int32)
                        table[:] = [np.concatenate(z) for z in zip(table, (np.full(len(flat), len(names), np.int32), flat, base + np.cumsum(lens[flat]) - lens[flat]), strict=True)]
                    base += len(t.encode())
                    names.append(t)
        return found, [a, b]


def _aligned(pair: Pair, texts: list[str]) -> tuple[pa.Table, pa.Table]:
    """A row (doc, counts, digest, pair lists) of every text with tokens, and one row of partial pair counts."""
    import duckdb

    found, tokens = pair.stretches(texts)
    with duckdb.connect(config={"threads": 1, "temp_directory": "", "autoload_known_extensions": False, "autoinstall_known_extensions": False}) as con:

        def load(name: str, cols: dict[str, np.ndarray]) -> None:
            con.register("arrow", pa.table(cols))
            con.execute(f"CREATE TEMP TABLE {name} AS FROM arrow")
            con.unregister("arrow")

        for name in "ba":
            load(name, dict(zip(("seg", "id", "s"), tokens.pop(), strict=True)))
        for name in ("over", "under"):
            con.execute(f"CREATE TEMP TABLE {name} AS {_SQL[name]}")
        con.execute("DROP TABLE a; DROP TABLE b")
        groups = _groups(pair, con.sql(_SQL["shown"]).to_arrow_table())
        for name in ("link", "per_seg"):
            con.execute(f"CREATE TEMP TABLE {name} AS {_SQL[name]}")
        con.execute("DROP TABLE over; DROP TABLE under")
        load("occ", {"doc": np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in found]), "seg": np.fromiter(chain.from_iterable(found), np.int32)})
        con.execute(f"CREATE TEMP TABLE pair AS {_SQL['pair']}")
        docs, counts = con.sql(_DOCS).to_arrow_table(), con.sql(_COUNTS).to_arrow_table()
    digests = [hashlib.sha256("".join(map(groups.__getitem__, found[k]))[1:].encode()).hexdigest() for k in docs.column("doc").to_pylist()]
    return docs.append_column("groups_sha256", pa.array(digests, pa.string())), counts


def _groups(pair: Pair, shown: pa.Table) -> dict[int, str]:
    """The groups of each stretch as text."""
    seg, width = shown.column("seg").to_numpy(), len(pair.shown) // 3
    tokens = list(map(pair.shown.__getitem__, (shown.column("kind").to_numpy() * width + shown.column("id").to_numpy()).tolist()))
    bounds = [*np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]).tolist(), len(seg)] if len(seg) else [0]
    return dict(zip(seg[bounds[:-1]].tolist(), ("".join(tokens[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)), strict=True))


_loaded: dict[tuple[str, str], Pair] = {}


def _align(paths: tuple[str, str], kind: str):
    def run(batches):
        if paths not in _loaded:
            _loaded[paths] = Pair(*paths)
        pair = _loaded[paths]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for t in _gathered(batches):
            docs, counts = _aligned(pair, [x or "" for x in t.column("text").to_pylist()])
            n = len(t)
            at = np.full(n, -1, np.int64)
            at[docs.column("doc").to_numpy()] = np.arange(len(docs))
            take = pa.array(at, mask=at < 0)
            cols = {c: docs.column(c).combine_chunks().take(take) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "x", "y", "m")}
            cols |= {"row": t.column("row").combine_chunks(), "doc_id": t.column("doc_id").combine_chunks(), "counts": pa.array([False] * n)}
            yield _batch(cols, names)
            for r in range(len(counts)):
                none = {c: pa.nulls(1, cols[c].type) for c in names}
                yield _batch(none | {c: counts.column(c).combine_chunks().slice(r, 1) for c in "xym"} | {"counts": pa.array([True])}, names)

    return run


def _gathered(batches):
    """Arrow tables of GATHER bytes of text at most, or of one text."""
    held, size = [], 0
    for b in batches:
        t, lo = pa.Table.from_batches([b]), 0
        for k, n in enumerate(pc.binary_length(b.column(2)).fill_null(0).to_pylist()):
            if size + n > GATHER and size:
                yield pa.concat_tables([*held, t.slice(lo, k - lo)])
                held, size, lo = [], 0, k
            size += n
        held.append(t.slice(lo))
    if size or any(len(x) for x in held):
        yield pa.concat_tables(held)


def _batch(cols: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    types = {"x": pa.list_(pa.int32()), "y": pa.list_(pa.int32()), "m": pa.list_(pa.int64()), "groups_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([cols[c].cast(types[c]) if c in types else cols[c] for c in names], names)


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and lists x, y, m (A id, B id, links) of every document; and x, y, n: how many documents hold a pair linked."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    all_ = stage(numbered.mapInArrow(_align(tuple(paths or default_paths()), kind), _SCHEMA.format(kind=kind)), "align")
    partial = all_.where("counts").select(F.explode(F.arrays_zip("x", "y", "m")).alias("p")).select("p.*")
    return all_.where("not counts").drop("counts"), partial.groupBy("x", "y").agg(F.sum("m").alias("n"))


def scored(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """row, n_best, count_sum of the documents that have links."""
    best = counts.groupBy("x").agg(F.max("n").alias("most"))
    key = F.shiftleft(F.col("x").cast("long"), 32).bitwiseOR(F.col("y").cast("long")).alias("pair")
    known = stage(counts.join(best, "x").select(key, "n", (F.col("n") == F.col("most")).alias("best")), "align-pairs")
    total = known.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * frequent >= total  # n >= total / frequent holds for at most so many pairs
    links = aligned.select("row", F.explode(F.arrays_zip("x", "y", "m")).alias("p")).select("row", F.shiftleft(F.col("p.x").cast("long"), 32).bitwiseOR(F.col("p.y").cast("long")).alias("pair"), F.col("p.m").alias("m"))
    sums = [F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum")]
    few = F.broadcast(known.where(often))
    first = links.join(few, "pair", "left")
    near = first.where("n is not null").groupBy("row").agg(*sums)
    far = first.where("n is null").select("row", "pair", "m").join(known.where(~often), "pair").groupBy("row").agg(*sums)
    return near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    Null and empty texts, and texts that either tokenizer's bytes don't give back, have no tokens: zeros and an empty
    string. A null doc_id keeps its row, repeated rows each keep one and count as documents of their own. Long texts are
    aligned whole. No rows give no rows. Further columns of docs are not read.
    """
    aligned, counts = alignments(docs, paths)
    out = aligned.drop("x", "y", "m").join(stage(scored(aligned, counts, frequent), "align-scores"), "row", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
