"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are relative frequencies of hashed byte trigrams of the whole text, ASCII letters folded, digits left out. All
models are linear in them, so a text is scored in one pass over its bytes. They are trained on a bounded sample:
`per_language` labelled rows of each language, those with the smallest hash of their id; a machine between families takes
at most twice as many of each, spread evenly over its languages.

Repeated rows and null ids are predicted each on their own; no rows give no rows. Families come from a fixed table; a language that is not in it is a family of its own. With one family, or one language
in a family, that step has nothing to decide.

Rows: one per input row. Null text, or text without a letter, is `und` with score 0; so is every text if no row is
labelled. The score is the logistic of the smallest winning margin, between 0 and 1. Equal votes go to the larger sum of
margins, then to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .textkernel import slices, text_buffers

BITS = 13
BINS = 1 << BITS
SCALE = 100.0

# Families by language code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr gu pa ne",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_DROP = np.zeros(256, bool)
_DROP[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def family(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0].split("_")[0], language)


def _bins(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all rows in order, and where each row's begin. A row reads as if set between spaces."""
    rows = len(bounds) - 1
    body = data[bounds[0] : bounds[-1]]
    row = np.repeat(np.arange(rows), np.diff(bounds))
    keep = ~_DROP[body]
    body, row = _FOLD[body[keep]], row[keep]
    lengths = np.bincount(row, minlength=rows)
    ends = np.cumsum(lengths)
    padded = np.full(len(body) + 2 * rows, 32, np.uint32)
    padded[np.arange(len(body)) + 2 * row + 1] = body
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    codes = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
    hashed = (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    # A row of n bytes stands in n + 2 places and owns the n trigrams that begin in the first n of them.
    inside = np.ones(len(padded), bool)
    borders = ends + 2 * np.arange(1, rows + 1)
    inside[borders - 1] = inside[borders - 2] = False
    inside = inside[:-2]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    kept = hashed[inside]
    return kept, starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_buffers(batch.column(1))
        for a, b in slices(bounds):
            bins, starts = _bins(data, bounds[a : b + 1])
            counts = [np.bincount(bins[s:e], minlength=BINS) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            found = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.int32())), pa.array([c[f].astype(np.int64) for c, f in zip(counts, found, strict=True)], pa.list_(pa.int64()))],
                names=["lang", "bins", "counts"],
            )


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by conjugate-gradient Newton steps. y: +1 or -1."""
    n, w, b = len(y), np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for _ in range(rounds // 10):
        slack = 1 - y * (x @ w + b)
        on = slack > 0
        if not on.any():
            break
        gw = strength * w - 2 * ((weight * y * slack)[on] @ x[on])
        gb = float(-2 * (weight * y * slack)[on].sum())
        xs, ws = x[on], weight[on]
        hess = lambda v, c: (strength * v + 2 * ((ws * (xs @ v + c)) @ xs), float(2 * (ws * (xs @ v + c)).sum()))  # noqa: E731, B023
        dw, db, rw, rb = np.zeros_like(w), 0.0, -gw, -gb
        pw, pb, old = rw.copy(), rb, float(rw @ rw) + rb * rb
        for _ in range(30):
            hw, hb = hess(pw, pb)
            step = old / max(float(pw @ hw) + pb * hb, 1e-30)
            dw, db, rw, rb = dw + step * pw, db + step * pb, rw - step * hw, rb - step * hb
            new = float(rw @ rw) + rb * rb
            if new < 1e-12:
                break
            pw, pb, old = rw + new / old * pw, rb + new / old * pb, new
        w, b = (w + dw).astype(np.float32), b + db
    return w, b


def sample_ids(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(id, lang) of the per_language labelled rows of each language with the smallest hash of their id.

    Languages are counted first, and rows beyond a hash below which about twice as many lie as are wanted drop out where
    they are read: what is ordered by language is as small for a language of a third of all rows as for any other.
    """
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("hash"))
    # A table of its own, one row a language: its size is known when the join is planned, and no row is dealt by language.
    counts = cut(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    most = F.greatest(F.lit(64), F.lit(2 * per_language)) / F.col("n")
    near = ids.join(counts, "lang").where((F.pmod("hash", F.lit(1 << 30)) / F.lit(float(1 << 30)) < most))
    smallest = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash", "id")
    return near.withColumn("k", F.row_number().over(smallest)).where(f"k <= {per_language}").select("id", "lang").distinct()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800) -> dict:
    """The model from the labelled rows of docs; at most per_language rows of each language reach the driver, as counts of
    at most BINS bins each, and only the rows of one machine at a time are made dense there."""
    picked = cut(sample_ids(docs, id_col, text_col, lang_col, per_language), "picked")
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(picked, ["id", "lang"], "left_semi")
    sample = texts.select("lang", "text").mapInArrow(_count, "lang string, bins array<int>, counts array<long>").toArrow().combine_chunks()
    sample = sample.sort_by("lang")
    return fit(sample.column("lang").to_pylist(), sample.column("bins"), sample.column("counts"), 2 * per_language)


def fit(languages: list[str], bins: pa.ChunkedArray, counts: pa.ChunkedArray, per_family: int) -> dict:
    """One machine for each pair of families and for each pair of languages of a family."""
    languages = np.array(languages, object)
    families = np.array([family(c) for c in languages], object)
    names = sorted(set(families))
    groups = [("", names, families)] + [(f, sorted(set(languages[families == f])), languages) for f in names]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BINS), np.float32)
        for k, row in enumerate(rows.tolist()):
            x[k, np.asarray(bins[row].values)] = np.asarray(counts[row].values)
        return x * (SCALE / np.maximum(x.sum(axis=1, keepdims=True), 1))

    machines, weights, biases = [], [], []
    for group, members, labels in groups:
        # Rows are in order of language, so that every few of them are of all of a family's.
        own = {m: (rows := np.flatnonzero(labels == m))[:: max(1, -(-len(rows) // per_family))] for m in members}
        for one, two in combinations(members, 2):
            y = np.repeat([1, -1], [len(own[one]), len(own[two])]).astype(np.float32)
            w, b = _svm(dense(np.concatenate([own[one], own[two]])), y)
            machines.append((group, one, two))
            weights.append(w)
            biases.append(b)
    return {"machines": machines, "weights": np.array(weights, np.float32).reshape(-1, BINS), "biases": np.array(biases), "groups": {g: m for g, m, _ in groups}}


def _decide(model: dict, margins: np.ndarray, group: str) -> tuple[str, float]:
    members = model["groups"][group]
    if len(members) == 1:
        return members[0], np.inf
    votes, sums, least = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), {}
    for (g, one, two), margin in zip(model["machines"], margins.tolist(), strict=True):
        if g == group:
            win, lose = (one, two) if margin >= 0 else (two, one)
            votes[win] += 1
            sums[win] += abs(margin)
            sums[lose] -= abs(margin)
            least[win] = min(least.get(win, np.inf), abs(margin))
    best = min(members, key=lambda c: (-votes[c], -sums[c], c))
    return best, least.get(best, 0.0)


def _predict(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    weights, biases = model["weights"], model["biases"]
    for batch in batches:
        data, bounds = text_buffers(batch.column(1))
        letters = batch.column(2)
        for a, b in slices(bounds, 1 << 20):
            bins, starts = _bins(data, bounds[a : b + 1])
            sizes = np.maximum(np.diff(starts), 1)
            margins = np.zeros((b - a, len(biases)))
            for k in range(len(biases)):
                sums = np.concatenate([[0.0], np.cumsum(weights[k][bins], dtype=np.float64)])
                margins[:, k] = SCALE * (sums[starts[1:]] - sums[starts[:-1]]) / sizes + biases[k]
            named, scores = [], []
            for i in range(b - a):
                if not letters[a + i].as_py() or not model["groups"][""]:
                    named.append("und")
                    scores.append(0.0)
                    continue
                group, first = _decide(model, margins[i], "")
                name, second = _decide(model, margins[i], group)
                named.append(name)
                scores.append(float(1 / (1 + np.exp(-min(first, second, 30.0)))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, lang_pred, score. Only the text is an input of the prediction."""
    asked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return asked.mapInArrow(partial(_predict, model=model), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))
