"""Language ID by hierarchical discrimination.

Features are the relative frequencies of hashed byte trigrams of the whole lower-cased text. Linear support vector machines
first tell language families apart, one against one; then, within the predicted family, one against one, its languages.
All weights of a trigram lie in one row of a table, so a text is scored by one gather over its bytes.

The machines are fitted on a bounded sample of the labelled rows: the ``per_language`` rows of each label with the least
hash of doc_id. The driver gets one vector of BUCKETS numbers for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinograph.llm import _text as T

FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
}
BUCKETS, PER_LANGUAGE, MIN_MARGIN = 1 << 13, 200, 0.02
#: Squared factor of the frequencies, which are small.
SCALE = 2500.0
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram that lies within a text, and each text's first one (one entry more than texts). Each text counts as between spaces."""
    n = len(offs) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint32)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offs))
    padded[at] = _LOWER[data]
    x = (padded[:-2] * np.uint32(0x9E3779B1)) ^ (padded[1:-1] * np.uint32(0x85EBCA77)) ^ (padded[2:] * np.uint32(0xC2B2AE3D)) if len(padded) > 2 else np.zeros(0, np.uint32)
    x = ((x * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13)).astype(np.int32)
    # text i has as many trigrams as bytes; the two that reach into the next text are dropped
    inside = np.ones(len(x), bool)
    ends = offs[1:] + 2 * np.arange(1, n + 1)
    for back in (2, 1):
        e = ends[:-1] - back
        inside[e[(e >= 0) & (e < len(x))]] = False
    return x[inside], offs


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in T.chunks(b.column("text"), 1 << 20):
            x, first = trigrams(data, offs)
            rows = []
            for i in range(hi - lo):
                v = np.bincount(x[first[i] : first[i + 1]], minlength=BUCKETS).astype(np.float32)
                rows.append((v / max(1.0, v.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(lo, hi - lo), "lang": b.column("lang").slice(lo, hi - lo), "v": pa.array(rows, pa.binary())})


def sample(docs: DataFrame, per_language: int, languages: list[str]) -> tuple[np.ndarray, list[str]]:
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isin(languages) & F.col("text").rlike("\\S"))
    ids = known.selectExpr("doc_id", "row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id), doc_id) AS r").where(F.col("r") <= per_language).select("doc_id").distinct()
    # at most per_language ids for each language
    few = known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", "text")
    rows = sorted({(r.lang, r.doc_id, bytes(r.v)) for r in few.mapInArrow(_vectors, "doc_id bigint, lang string, v binary").collect()})
    return np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float32).reshape(len(rows), BUCKETS), [r[0] for r in rows]


def fit(k: np.ndarray, y: np.ndarray, rounds: int = 400, weight: float = 1e-4) -> np.ndarray:
    """Each row's share in a linear machine with squared hinge loss, both classes of equal weight, by accelerated gradient descent.

    k holds the rows' scalar products: weights that start at 0 stay sums of rows, so nothing as wide as a row is needed.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    root = np.sqrt(share)
    step = 1 / (2 * np.linalg.eigvalsh(root[:, None] * k * root)[-1] + weight)
    w = z = np.zeros(len(k))
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (k @ z))
        new = z - step * (weight * z - 2 * share * y * slack)
        z, w = new + i / (i + 3) * (new - w), new
    return w


class Model:
    """A table (BUCKETS + 1, machines) whose last row are the biases; the two sides of each machine; the families."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]):
        labels = sorted(set(langs))
        self.family = {k: families.get(k, k) for k in labels}
        self.names = sorted(set(self.family.values()))
        self.members = {f: [k for k in labels if self.family[k] == f] for f in self.names}
        of = np.array([self.family[k] for k in langs], object)
        lang = np.array(langs, object)
        self.sides: list[tuple[str, str]] = []
        columns = []
        k = SCALE * (x @ x.T) + 1  # 1 is the bias's part
        for group, who in [(self.names, of), *((m, lang) for m in self.members.values())]:
            for a, b in combinations(group, 2):
                use = (who == a) | (who == b)
                self.sides.append((a, b))
                w = fit(k[np.ix_(use, use)], np.where(who[use] == a, 1.0, -1.0))
                columns.append(np.r_[SCALE * (w @ x[use]), w.sum()])
        self.table = np.array(columns).T.reshape(BUCKETS + 1, len(columns)).astype(np.float32)

    def _vote(self, group: list[str], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's number for each row, by votes, then by summed margins; its least margin over the others."""
        n = len(scores)
        votes, sums, least = np.zeros((n, len(group))), np.zeros((n, len(group))), np.full((n, len(group)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(group), 2):
            s = scores[:, self.sides.index((a, b))]
            for k, x in ((i, s), (j, -s)):
                votes[:, k] += x > 0
                sums[:, k] += x
                least[:, k] = np.minimum(least[:, k], x)
        best = np.lexsort((-sums, -votes), axis=1)[:, 0] if len(group) > 1 else np.zeros(n, np.int64)
        margin = least[np.arange(n), best]
        return best, margin

    def predict(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fam, margin = self._vote(self.names, scores)
        lang = np.full(len(scores), None, object)
        for k, f in enumerate(self.names):
            mine = np.flatnonzero(fam == k)
            best, m = self._vote(self.members[f], scores[mine])
            lang[mine] = np.array(self.members[f], object)[best]
            margin[mine] = np.minimum(margin[mine], m)
        return np.array(self.names, object)[fam], lang, margin


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = np.asarray(pc.match_substring_regex(pc.fill_null(b.column("text"), ""), r"\pL"))
            for lo, hi, data, offs in T.chunks(b.column("text"), 1 << 20):
                n, has = hi - lo, letters[lo:hi]
                family, lang, margin = np.full(n, None, object), np.full(n, None, object), np.full(n, np.nan)
                if model.names and has.any():
                    x, first = trigrams(data, offs)
                    some = np.flatnonzero(has)
                    ends = np.r_[0, np.cumsum(np.diff(first))]
                    scores = np.empty((len(some), model.table.shape[1]))
                    for k in range(model.table.shape[1]):
                        sums = np.r_[0.0, np.cumsum(model.table[:-1, k][x], dtype=np.float64)]
                        scores[:, k] = (sums[ends[some + 1]] - sums[ends[some]]) / np.diff(first)[some] + model.table[-1, k]
                    family[some], lang[some], margin[some] = model.predict(scores)
                margin = np.where(np.isinf(margin), np.nan, margin)
                yield pa.RecordBatch.from_pydict({"letters": pa.array(has), "language": pa.array(lang, pa.string()), "family": pa.array(family, pa.string()), "margin": pa.array(np.round(margin, 6), from_pandas=True)} | {f"c{i}": b.column(f"c{i}").slice(lo, n) for i in range(b.num_columns - 1)})

    return run


def predicted(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> DataFrame:
    """docs with columns c0, c1, ... for its own, before them letters (whether the text has any), language, family and margin."""
    families = FAMILIES if families is None else families
    names = docs.columns
    lowered = [c.lower() for c in names]
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text, lang = (f"c{lowered.index(c)}" for c in ("doc_id", "text", "lang"))
    x, langs = sample(own.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")), per_language, sorted(families))
    model = Model(x, langs, families)
    schema = "letters boolean, language string, family string, margin double"
    full = StructType.fromDDL(schema)
    for f in own.schema:
        full = full.add(f)
    return own.select(F.col(text).alias("text"), *own.columns).mapInArrow(_predict(model), full)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, family, language, margin) for every row of docs.

    margin is the least by which the winner beats another family or another language of its family; NULL where there is no
    other. NULL and empty texts and texts without letters have NULLs. Rows whose label (column lang) is NULL or has no
    family are predicted but not learnt from; without labelled rows all is NULL. Repeated rows give equal rows, and count
    once for fitting. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text", "lang")
    return predicted(docs, per_language, families).select(F.col("c0").alias("doc_id"), "family", "language", "margin")


def keep_identified(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs, with all its columns, without the rows that are rejected.

    Rejected are texts without any letter, which have no language (NULL and empty texts among them), and those so close
    to another language that the margin is under min_margin. If there is nothing to learn from, or one language only,
    nothing is rejected but texts without letters.
    """
    out = predicted(docs, per_language, families).where(F.col("letters") & (F.col("margin").isNull() | (F.col("margin") >= min_margin)))
    return out.select([f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
