"""Language ID by interpolated Kneser-Ney character models, one per language.

The models are fitted on a bounded sample of labelled documents (SAMPLE a language, a
window of at most SAMPLE_CHARS characters of each). Every n-gram that some language has seen gets
its interpolated log probability in all languages ahead of time, so scoring a character
is one look-up in a sorted array of n-gram hashes; n-grams that no language has seen
fall back to the next lower order with the back-off weights of their history.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.plans.runtime import prepare

ORDER = 4
SAMPLE, SAMPLE_CHARS = 250, 10_000
#: Of the sample, this share calibrates rejection; a text goes beyond the worst of it by more than MARGIN (nats a character).
CALIBRATION, MARGIN = 5, 1.0
#: Characters of a text that calibrates.
LEAST = 20
#: The characters that the score's evidence counts for at most.
EVIDENCE = 50
UND = "und"
_P = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters with one space after each run of them, ORDER - 1 spaces ahead of each text; the text of each position; whether it counts."""
    lens = np.array([len(t) for t in texts], np.int64)
    x = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), lens)
    letter = x != 0
    before = np.r_[False, letter[:-1] & (doc[1:] == doc[:-1])] if len(x) else letter
    keep = letter | before
    x, doc = np.where(letter, x, 32)[keep], doc[keep]
    pad = ORDER - 1
    at = np.arange(len(x)) + pad * (doc + 1)
    out, owner, counts = np.full(len(x) + pad * len(texts), 32, np.uint32), np.full(len(x) + pad * len(texts), -1), np.zeros(len(x) + pad * len(texts), bool)
    out[at], owner[at], counts[at] = x, doc, True
    return out, owner, counts


def _hashes(x: np.ndarray) -> list[np.ndarray]:
    """hashes[k][i]: of the k + 1 characters that end at i."""
    c = x.astype(np.uint64) + np.uint64(1)
    out = [c * _P]
    for _ in range(ORDER - 1):
        prev = np.r_[np.uint64(0), out[-1][:-1]]
        out.append((prev ^ (prev >> np.uint64(29))) * _P + c * (_P << np.uint64(1) | np.uint64(1)))
    return out


class Keys:
    """A sorted array of hashes, with the first position of each pattern of leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, int(4 * len(keys)).bit_length()))
        self.starts = np.searchsorted(keys, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.float64) * 2.0 ** int(self.shift)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        lead = (h >> self.shift).astype(np.int64)
        lo, width = self.starts[lead], self.starts[lead + 1]
        width = width - lo
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(width > 0)
        step = 0
        while len(at):
            i = lo[at] + step
            hit = self.keys[i] == h[at]
            out[at[hit]] = i[hit]
            step += 1
            at = at[~hit & (width[at] > step)]
        return out


@dataclass
class Model:
    langs: list[str]
    grams: list[Keys]  # by order - 1: sorted hashes, and log probabilities by language (the last row: unknown)
    logp: list[np.ndarray]
    contexts: list[Keys]  # by length - 1: sorted hashes of histories, and log back-off weights by language
    backoff: list[np.ndarray]
    floor: np.ndarray
    limit: np.ndarray

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language (nats a character), and its number of characters."""
        x, owner, counts = _stream(texts)
        h = _hashes(x)
        at = np.flatnonzero(counts)
        i = self.grams[-1].find(h[-1][at])
        total = self.logp[-1][i]  # -1 is the row of zeros
        rest = np.flatnonzero(i < 0)
        for k in range(ORDER - 2, -1, -1):
            here = at[rest]
            extra = self.backoff[k][self.contexts[k].find(h[k][here - 1])]
            i = self.grams[k].find(h[k][here])
            total[rest] += extra + self.logp[k][i]
            rest = rest[i < 0]
        total[rest] += self.floor
        n = np.bincount(owner[at], minlength=len(texts))
        starts = np.flatnonzero(n)
        out = np.zeros((len(texts), len(self.langs)))
        if len(starts):
            out[starts] = -np.add.reduceat(total, np.r_[0, np.cumsum(n[starts])[:-1]], axis=0, dtype=np.float64) / n[starts][:, None]
        return out, n


def _language(x: np.ndarray, counts: np.ndarray):
    """Per order: sorted n-gram hashes with discounted probabilities, and sorted histories with back-off weights; the floor."""
    h = _hashes(x)
    at = np.flatnonzero(counts)
    keys, first, c = np.unique(h[ORDER - 1][at], return_index=True, return_counts=True)
    pos = at[first]
    tables = []
    for k in range(ORDER - 1, -1, -1):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        if k:
            past, of = np.unique(h[k - 1][pos - 1], return_inverse=True)
        else:
            past, of = np.zeros(1, np.uint64), np.zeros(len(pos), np.int64)
        total, kinds = np.bincount(of, c, len(past)), np.bincount(of, minlength=len(past))
        tables.append((Keys(keys), np.maximum(c - discount, 0) / total[of], Keys(past), discount * kinds / total))
        if k:  # continuation counts: how many characters stand before
            keys, first, c = np.unique(h[k - 1][pos], return_index=True, return_counts=True)
            pos = pos[first]
    return tables[::-1]


def _left_out(texts: list[str], alphabet: int) -> float:
    """The worst cross-entropy of a language's texts under models of its other texts (of a lone text: of its other half); nan if none can be fitted."""
    if len(texts) == 1:
        words = texts[0].split()
        cut = len(words) // 2
        texts = [" ".join(words[:cut]), " ".join(words[cut:])] if cut else [texts[0][: len(texts[0]) // 2], texts[0][len(texts[0]) // 2 :]]
    worst = []
    for k in range(min(CALIBRATION, len(texts))):
        out, rest = texts[k::CALIBRATION], [t for i, t in enumerate(texts) if i % CALIBRATION != k]
        if not _stream(rest)[2].any():
            continue
        model = fit({"": rest}, alphabet=alphabet)
        e, n = model.entropies(out)
        if not (n >= LEAST).any():
            e, n = model.entropies([" ".join(out)])
        worst += e[n >= min(LEAST, max(1, n.max())), 0].tolist()
    return max(worst, default=np.nan)


def fit(samples: dict[str, list[str]], calibrate: dict[str, list[str]] | None = None, alphabet: int | None = None) -> Model:
    """Models of the sampled texts by language; calibrate: other texts by language, which set the limits of rejection.

    Where calibrate is given, a language without a usable text in it gets its limit from its own texts, each under a
    model of the others, or else the highest limit of the other languages; never beyond that of a uniform alphabet.
    """
    langs = sorted(samples)
    streams = [_stream(samples[lang]) for lang in langs]
    per = [_language(x, counts) for x, _, counts in streams]
    x = np.concatenate([s[0] for s in streams])
    at = np.flatnonzero(np.concatenate([s[2] for s in streams]))
    h = _hashes(x)
    alphabet = alphabet or len(np.unique(x)) + 1
    grams, logp, contexts, backoff = [], [], [], []
    for k in range(ORDER):
        keys, first = np.unique(h[k][at], return_index=True)
        pos = at[first]
        p = np.full((len(keys), len(langs)), 1 / alphabet)
        for j in range(k + 1):
            for m in range(len(langs)):
                known, value, past, gamma = per[m][j]
                i = known.find(h[j][pos])
                b = past.find(h[j - 1][pos - 1]) if j else np.zeros(len(pos), np.int64)
                p[:, m] = np.where(i >= 0, value[i], 0) + np.where(b >= 0, gamma[b], 1) * p[:, m]
        grams.append(Keys(keys))
        logp.append(np.vstack((np.log(p), np.zeros((1, len(langs))))).astype(np.float32))
        if k < ORDER - 1:
            keys, first = np.unique(h[k][at - 1], return_index=True)
            w = np.ones((len(keys), len(langs)))
            for m in range(len(langs)):
                b = per[m][k + 1][2].find(keys)
                w[:, m] = np.where(b >= 0, per[m][k + 1][3][b], 1)
            contexts.append(Keys(keys))
            backoff.append(np.vstack((np.log(np.maximum(w, 1e-12)), np.zeros((1, len(langs))))).astype(np.float32))
    floor = np.array([np.log(per[m][0][3][0] / alphabet) for m in range(len(langs))], np.float32)
    model = Model(langs, grams, logp, contexts, backoff, floor, np.full(len(langs), np.inf))
    for m, lang in enumerate(langs):
        if calibrate and calibrate.get(lang):
            e, n = model.entropies(calibrate[lang])
            if (n >= LEAST).any():
                model.limit[m] = e[n >= LEAST, m].max() + MARGIN
    if calibrate is not None:
        pooled = max(model.limit[np.isfinite(model.limit)], default=np.inf)
        for m in np.flatnonzero(np.isinf(model.limit)):
            own = _left_out(samples[langs[m]], alphabet)
            model.limit[m] = min(pooled if np.isnan(own) else own + MARGIN, np.log(alphabet))
    return model


def train(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of the labelled documents that are not held out; None where there are none.

    The sample is the same for the same rows: the smallest hashes of doc_id and text, thinned before they are ranked, so
    that a language with a third of all rows is no large window. Rows equal in both are one, and are counted once; rows
    that share a doc_id, or have none, are told apart by their texts. A longer document is fitted on by a window of it,
    placed by a hash; where that holds no letter, the window begins at the first one.
    """
    h = F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("lang", "text", h.alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(min(1.0, 3 * sample / n)))])
    thin = rows.where(F.pmod(F.col("h"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    thin = thin.groupBy("lang", "h").agg(F.first("text").alias("text"))
    start = F.pmod(F.xxhash64(F.lit("window"), "h"), F.length("text") - sample_chars + 1) + 1
    window = F.substring("text", start, F.lit(sample_chars))
    lettered = F.substring(F.regexp_substr("text", F.lit(r"(?s)\p{L}.*")), 1, sample_chars)
    long = F.length("text") > sample_chars
    thin = thin.withColumn("text", F.when(long & window.rlike(r"\p{L}"), window).when(long, lettered).otherwise(F.col("text")))
    best = thin.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample)
    fold: tuple[dict, dict] = ({}, {})
    for r in sorted(best.select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
        fold[r["k"] % CALIBRATION == 0].setdefault(r["lang"], []).append(r["text"])
    return fit(fold[0], fold[1]) if fold[0] else None


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and whether it is rejected, of each text; without a model nothing is rejected."""
    pred, score, entropy, gone = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), model is not None)
    if model is None or not texts:
        return pred, score, entropy, gone
    e, n = model.entropies([t or "" for t in texts])
    best = e.argmin(axis=1)
    for i in np.flatnonzero(n):
        pred[i] = model.langs[best[i]]
        entropy[i] = e[i, best[i]]
        score[i] = 1 / np.exp((entropy[i] - e[i]) * min(n[i], EVIDENCE)).sum()
        gone[i] = entropy[i] > model.limit[best[i]] + 4 / np.sqrt(n[i])
    return pred, score, entropy, gone


#: Characters that are scored at once.
BATCH_CHARS = 500_000


def _batches(texts: list[str | None]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BATCH_CHARS:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t or "")
    yield slice(lo, len(texts))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every row, from the whole text.

    lang_pred is a language of the model, und for a null text or one without a letter (score 0, rejected), or without a
    model (score 0, not rejected). rejected: und, or a cross-entropy beyond the limit of its language. Ties go to the first
    language by code point. Repeated rows each keep a row; a null doc_id stays. No rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded: SAMPLE texts of SAMPLE_CHARS a language

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out = [predict(shared.value, texts[s]) for s in _batches(texts)]
            cols = [pa.array([x for o in out for x in o[0]], pa.string()), *(pa.array(np.concatenate([o[k] for o in out])) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is not rejected; all rows without a model."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = np.concatenate([~predict(shared.value, texts[s])[3] for s in _batches(texts)])
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
