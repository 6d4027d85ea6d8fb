"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text more?

Two raw-content dictionaries are fitted on labelled texts. Both begin with the commonest words
of ordinary text, so that prose compresses alike under both; the toxic one goes on with the
words and stems that stand out in toxic texts by evidence, in whatever language, the ordinary
one with as many ordinary words. Texts are lower-cased and freed of punctuation, then cut into
windows of `WINDOW` words; for each window the bytes saved by the toxic dictionary are counted.
A logistic curve, fitted on the labelled sample, turns a text's savings into a probability.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from meandra.llm.common import as_bytes, cut, short

THRESHOLD = 0.3
WINDOW = 8
#: Bound of the labelled sample that the model is fitted on, rows of each class; their texts are read whole.
SAMPLE = 3000
#: Words of the common part; ratio of uses a text, and log of the odds against chance, that make a term stand out; terms at most; bits that count the words before a term.
COMMON, LIFT, EVIDENCE, MOST, CONTEXTS = 1500, 8.0, 10.0, 400, 256
#: Bytes of the shortest stem: with the space before it a match of the compressor.
STEM = 5
_KEEP = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_KEEP).split() if text else []


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    # a match must cover six bytes: a whole short word with its spaces, hardly ever a chance syllable
    how = zstandard.ZstdCompressionParameters(min_match=6, strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=16, chain_log=16, search_log=4, write_content_size=False)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def savings(self, words: list[bytes], compressors: tuple | None = None) -> np.ndarray:
        """Bytes by which the toxic dictionary beats the ordinary one, window by window."""
        toxic, ordinary = compressors or (_compressor(self.toxic), _compressor(self.ordinary))
        windows = (b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW))
        return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows])

    def score(self, words: list[bytes], compressors: tuple | None = None) -> float:
        z = float(np.dot(self.weights, _features(self.savings(words, compressors))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _features(saved: np.ndarray) -> np.ndarray:
    """Bias, the windows with clear savings, these savings in all, the largest (roots, so that none counts without bound), and what chance brings with length."""
    if not len(saved):
        return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
    clear = np.maximum(saved - 1, 0)
    return np.array([1.0, np.sqrt((clear > 0).sum()), np.sqrt(clear.sum()), np.sqrt(max(saved.max(), 0)), np.log1p(len(saved)) / 4])


def _terms(words: list[bytes]) -> dict[bytes, int]:
    """The words with a space after each, and their beginnings from STEM bytes on that end with a character.

    With each the words that stand before it, as bits of a number of CONTEXTS bits.
    """
    before: dict[bytes, int] = {}
    for last, w in zip([b"", *words], words):
        before[w] = before.get(w, 0) | 1 << zlib.crc32(last) % CONTEXTS
    out: dict[bytes, int] = {}
    for w, bits in before.items():
        out[w + b" "] = bits
        for k in range(STEM, len(w) + 1):
            if k == len(w) or w[k] & 0xC0 != 0x80:
                out[w[:k]] = out.get(w[:k], 0) | bits
    return out


def _distinct(bits: int) -> float:
    """How many different words set these bits, by linear counting."""
    free = CONTEXTS - bits.bit_count()
    return -CONTEXTS * math.log(max(free, 0.5) / CONTEXTS)


class _Counts:
    """For each term: toxic texts that hold it, ordinary ones, and the words before it in either, as bits."""

    def __init__(self) -> None:
        self.found: dict[bytes, list[int]] = {}

    def add(self, words: list[bytes], toxic: bool) -> None:
        side = 0 if toxic else 1
        for term, bits in _terms(words).items():
            row = self.found.setdefault(term, [0, 0, 0, 0])
            row[side] += 1
            row[side + 2] |= bits


def _witnesses(row: tuple[int, int, int, int]) -> tuple[float, float]:
    """Toxic and ordinary texts that speak for a term: no more than there are words before it, as near copies say the same."""
    return min(row[0], _distinct(row[2])), min(row[1], _distinct(row[3]))


def _stands_out(row: tuple[int, int, int, int], n: tuple[int, int]) -> bool:
    """Whether a term is more frequent in toxic texts by LIFT and beyond chance by EVIDENCE. n: toxic and ordinary texts."""
    k, m = _witnesses(row)
    base = n[0] / (n[0] + n[1])
    if k < 2 or (_distinct(row[2]) + 0.5) / (n[0] + 1) * (n[1] + 1) / (_distinct(row[3]) + 0.5) < LIFT or k / (k + m) <= base:
        return False
    # Chernoff: chance brings k of k + m texts with probability exp(-this) at most
    return k * np.log(k / (k + m) / base) + (m * np.log(m / (k + m) / (1 - base)) if m else 0.0) >= EVIDENCE


def _marked(held: dict[bytes, float]) -> list[bytes]:
    """Of terms that stand out, with the toxic texts that speak for them, the most frequent first; of stem and word the longer if its support is about the same, else the stem."""
    found = sorted(held)
    kept: list[bytes] = []
    for i, w in enumerate(found):  # in this order a stem stands before its words
        longer = itertools.takewhile(lambda x: x.startswith(w), found[i + 1 :])
        if not (kept and w.startswith(kept[-1])) and not any(held[x] >= 0.8 * held[w] for x in longer):
            kept.append(w)
    return [w.strip() for w in sorted(kept, key=lambda w: (-held[w], w))[:MOST]]


def _dictionaries(marked: list[bytes], plain: list[bytes]) -> tuple[bytes, bytes]:
    """plain: whole words of ordinary texts, those in most texts first, without a marked one; at least COMMON and as many as are marked, if there are."""
    shared = b" " + b" ".join(plain[:COMMON]) + b" "
    return shared + b" ".join(marked) + b" ", shared + b" ".join(plain[COMMON : COMMON + len(marked)]) + b" "


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def _calibrated(dictionaries: tuple[bytes, bytes], x: np.ndarray, y: np.ndarray, share: float) -> ToxicityModel:
    """share: of toxic rows among all labelled ones, which the sample need not show."""
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    return ToxicityModel(*dictionaries, tuple(map(float, _logistic(x, y, weight))))


def _one_class(toxic: bool) -> ToxicityModel:
    """With a class missing there is nothing to tell apart: all scores are that of the class there is."""
    return ToxicityModel(b"        ", b"        ", (30.0 if toxic else -30.0, 0.0, 0.0, 0.0, 0.0))


def fit_texts(toxic: list[bytes | None], ordinary: list[bytes | None], share: float | None = None) -> ToxicityModel:
    """Model from labelled texts in memory, by the same steps as fit(); equal texts of a class speak once for terms."""
    if not toxic or not ordinary:
        return _one_class(bool(toxic))
    once = [list(dict.fromkeys(t or b"" for t in texts)) for texts in (toxic, ordinary)]
    counts = _Counts()
    for texts, side in zip(once, (True, False)):
        for t in texts:
            counts.add(plain_words(t), side)
    n = len(once[0]), len(once[1])
    marked = _marked({w: _witnesses(r)[0] for w, r in counts.found.items() if _stands_out(r, n)})
    words = {w.strip(): r[1] for w, r in counts.found.items() if w.endswith(b" ") and r[1]}
    plain = [w for w in sorted(words, key=lambda w: (-words[w], w)) if w not in set(marked)]
    dictionaries = _dictionaries(marked, plain)
    model = ToxicityModel(*dictionaries, (0.0,) * 5)
    pair = (_compressor(model.toxic), _compressor(model.ordinary))
    x = np.array([_features(model.savings(plain_words(t), pair)) for t in [*toxic, *ordinary]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    return _calibrated(dictionaries, x, y, len(toxic) / len(y) if share is None else share)


def held_out() -> Column:
    """True where crc32 of doc_id as text leaves 2 mod 4; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


_BITS = [f"{side}{i}" for side in "to" for i in range(4)]
_COLUMNS = ["term", "k", "m", *_BITS]


def _row(r: Row) -> tuple[int, int, int, int]:
    """A term's counts as _Counts holds them."""
    bits = [int.from_bytes(b"".join(r[c].to_bytes(8, "little", signed=True) for c in names), "little") for names in (_BITS[:4], _BITS[4:])]
    return r["k"], r["m"], bits[0], bits[1]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of terms, a row each; handed on whenever some hundred thousand are held."""
    counts = _Counts()

    def rows() -> pa.RecordBatch:
        held = list(counts.found.values())
        columns = [pa.array(counts.found.keys(), pa.binary()), *(pa.array([r[i] for r in held], pa.int64()) for i in (0, 1))]
        for i in (2, 3):
            words = np.frombuffer(b"".join(r[i].to_bytes(CONTEXTS // 8, "little") for r in held), "<i8").reshape(len(held), -1)
            columns += [pa.array(words[:, j].copy()) for j in range(words.shape[1])]
        counts.found = {}
        return pa.RecordBatch.from_arrays(columns, _COLUMNS)

    for batch in short(batches):
        for toxic, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            counts.add(plain_words(text), toxic == 1)
            if len(counts.found) > 200_000:
                yield rows()
    yield rows()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most `sample` labelled rows a class, the first in the order of a hash of doc_id; their texts are read whole.

    Rows with the held-out remainder, without a doc_id or without a label take no part; a doc_id with both
    labels counts as toxic. Terms are counted, and texts compressed, in tasks: the driver gets the terms that
    stand out, COMMON and some ordinary words, and five numbers for each sampled row.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = cut(texts.join(F.broadcast(picked), "doc_id").select("toxic", "text"))
    once = rows.dropDuplicates()
    n = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return _one_class(1 in n)
    sums = [*(F.sum(c).alias(c) for c in ("k", "m")), *(F.bit_or(c).alias(c) for c in _BITS)]
    schema = ", ".join(["term binary", *(f"{c} long" for c in _COLUMNS[1:])])
    terms = cut(once.mapInArrow(_count_batches, schema).groupBy("term").agg(*sums))
    size = n[1], n[0]
    # a term that stands out is in so many toxic texts at least: -ln of chance is EVIDENCE or more; and in some share of all that hold it
    least, base = max(2, int(EVIDENCE / -np.log(size[0] / sum(size)))), size[0] / sum(size)
    found = terms.filter((F.col("k") >= least) & (F.col("k") > F.col("m") * float(base / LIFT))).collect()
    rows_of = {bytes(r["term"]): _row(r) for r in found}
    marked = _marked({w: _witnesses(r)[0] for w, r in rows_of.items() if _stands_out(r, size)})
    words = terms.filter((F.col("m") > 0) & F.expr("substr(term, -1) = x'20'")).orderBy(F.desc("m"), "term").limit(COMMON + 2 * MOST).collect()
    plain = [w for w in (bytes(r["term"]).strip() for r in words) if w not in set(marked)]
    model = ToxicityModel(*_dictionaries(marked, plain), (0.0,) * 5)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = (_compressor(model.toxic), _compressor(model.ordinary))
        for batch in short(batches):
            x = [_features(model.savings(plain_words(t), pair)).tolist() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    facts = sorted((r["toxic"], r["x"]) for r in rows.mapInArrow(calibrate, "toxic int, x array<double>").collect())
    y, x = np.array([f[0] for f in facts], float), np.array([f[1] for f in facts])
    return _calibrated((model.toxic, model.ordinary), x, y, count.get(1, 0) / max(1, sum(count.values())))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: probability of label 1, and 1 from THRESHOLD on.

    Null, empty and wordless texts save nothing and get the score that such texts have in the fit.
    Whole texts are read; other columns are ignored; repeated rows come back repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = (_compressor(model.toxic), _compressor(model.ordinary))
        for batch in short(batches):
            found = np.array([model.score(plain_words(t), pair) for t in as_bytes(batch.column(2))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` whose text scores below THRESHOLD, all columns as they were.

    Null and empty texts score as in score(); rows that repeat are judged each, with or without a doc_id.
    """
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = (_compressor(model.toxic), _compressor(model.ordinary))
        for batch in short(batches):
            yield batch.filter(pa.array([model.score(plain_words(t), pair) < THRESHOLD for t in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, schema)
