"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained, one from good and one from bad labelled text.  A text is cut into pieces of
``PIECE`` bytes, each is compressed alone with either dictionary, and the sizes are added up: a piece is so short
that the dictionary, not the text before it, decides its size, wherever it stands in a text.  The normalised
difference ``x = (size with the bad one - size with the good one) / bytes of the text`` becomes a score by a logistic
curve that is fitted to labelled rows which gave no text to the dictionaries.

The fit uses bounded samples (documented parameters): of each class the ``fit_rows`` training rows with the smallest
hash of their id give about ``SAMPLE_PIECES`` pieces, between ``PIECES`` of a row, spread over the whole text;
``calibration_rows`` others are compressed in tasks and only their differences come to the driver.  A pair of
dictionaries is trained for each of ``SETTINGS`` and the pair whose calibrated loss is lowest stays.  What is
broadcast is at most as many pairs of at most ``dict_bytes`` a dictionary.  Scoring is one narrow pass over whole
texts.

Defined results: a null or empty text has the difference 0 and the score of that; equal texts have equal scores, so
ties and repeated rows need no rule; an id with several labels counts with the smallest, several rows of an id
are rows of their own; texts of any length are cut into pieces, never shortened; without labels of both
classes every score is the share of good labels, smoothed (0.5 without any label); an empty table has an empty
result; a class too small to train a dictionary gives its text itself as one; extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import texts_of

PIECE, PIECES, SAMPLE_PIECES = 1024, (4, 64), 8_000
#: Segment and hash length of the trainer's cover step; None: the trainer's own choice.
SETTINGS = (None, (64, 8), (200, 8))
DICT_BYTES = 512 << 10
FIT_ROWS, CALIBRATION_ROWS = 2_000, 10_000
LEVEL = 3
THRESHOLD = 0.3


def pieces_of(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def build_dictionary(samples: list[bytes], dict_bytes: int = DICT_BYTES, setting: tuple[int, int] | None = None) -> bytes:
    """A trained dictionary; of samples too few or too small to train one, their text."""
    import zstandard

    k, d = setting or (0, 0)
    try:
        return zstandard.train_dictionary(dict_bytes, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-dict_bytes:]


class Compressors:
    """Compressed sizes of texts with the bad and the good dictionary."""

    def __init__(self, bad: bytes, good: bytes, level: int = LEVEL):
        import zstandard

        self.both = []
        for data in (bad, good):
            d = zstandard.ZstdCompressionDict(data) if data else None
            if d is not None:
                d.precompute_compress(level=level)
            self.both.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                                      write_checksum=False, write_dict_id=False))

    def differences(self, texts: list[str]) -> np.ndarray:
        bad, good = (c.compress for c in self.both)
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                data = t.encode("utf-8", "surrogatepass")
                own = pieces_of(data)
                out[i] = (sum(len(bad(p)) for p in own) - sum(len(good(p)) for p in own)) / len(data)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Slope, intercept and mean loss of the calibration curve: logistic loss with smoothed targets (the targets of a class of
    ``n`` rows are ``1 / (n + 2)`` from its end), Newton's method on the scaled difference; the slope never falls."""
    scale = float(x.std()) or 1.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([x / scale, np.ones(len(x))]), np.zeros(2)

    def loss(w):
        s = w @ z
        return (np.logaddexp(0, s) - t * s).sum() + ridge * w @ w / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -40, 40)))
        grad = z @ (p - t) + ridge * w
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-9)) @ z.T + ridge * np.eye(2), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0) / scale, float(w[1]), float(loss(w) / len(x))


def fit_compression(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
                    label: str = "quality", fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS,
                    dict_bytes: int = DICT_BYTES) -> tuple[bytes, bytes, float, float]:
    """``(bad dictionary, good dictionary, slope, intercept)`` from training rows (``train`` is a condition on the
    key).  Even hashes of ids feed the dictionaries, odd ones the calibration."""
    known = (labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull() & train)
             .groupBy(key).agg((F.min(label) > 0).cast("int").alias("_y")).withColumn("_h", F.xxhash64(key)))
    order = ("_h", key)
    even = F.pmod("_h", F.lit(2)) == 0
    n = {int(r["_y"]): r["n"] for r in known.where(even).groupBy("_y").agg(F.count("*").alias("n")).collect()}
    per_row = {y: min(max(PIECES[0], SAMPLE_PIECES // max(min(n.get(y, 0), fit_rows), 1)), PIECES[1]) for y in (0, 1)}
    picked = [known.where(even & (F.col("_y") == y)).orderBy(*order).limit(fit_rows) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(key, "_y")
    rows = docs.select(key, text).join(F.broadcast(ids), key)  # twice fit_rows ids at most
    kind = rows.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for k, y, t in zip(keys, b.column(2).to_pylist(), texts_of(b, text)):
                own = pieces_of(t.encode("utf-8", "surrogatepass"))
                first = zlib.crc32(str(k).encode()) % max(len(own), 1)  # from a place of its own, evenly spread
                at = {(first + j * len(own) // per_row[y]) % len(own) for j in range(per_row[y])} if own else ()
                out.append([own[j] for j in sorted(at)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.binary()))],
                                             names=[key, "_y", "pieces"])

    cuts = rows.mapInArrow(cut, f"`{key}` {kind}, _y int, pieces array<binary>")
    samples: tuple[list[bytes], list[bytes]] = ([], [])
    # an id can have several rows: the bound holds for rows too
    for r in (cuts.withColumn("_p", F.xxhash64("pieces")).orderBy(F.xxhash64(key), key, "_p", "_y").limit(2 * fit_rows)
              .toLocalIterator()):
        samples[r["_y"]].extend(bytes(p) for p in r["pieces"])
    pairs = [tuple(build_dictionary(s, dict_bytes, how) if s else b"" for s in samples) for how in SETTINGS]

    ids = known.where(~even).orderBy(*order).limit(calibration_rows).select(key, "_y")
    rows = docs.select(key, text).join(F.broadcast(ids), key)  # calibration_rows ids at most
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [Compressors(*p) for p in shared.value]
        for b in batches:
            texts = texts_of(b, text)
            x = np.stack([c.differences(texts) for c in every], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=[key, "_y", "x"])

    got = (rows.mapInArrow(measure, f"`{key}` {kind}, _y int, x array<double>").orderBy(F.xxhash64(key), key, "x", "_y")
           .limit(calibration_rows).toPandas())
    x, y = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(SETTINGS)), got["_y"].to_numpy(dtype=float)
    if not all(samples) or not len(y) or y.min() == y.max():
        # no two classes to tell apart: the smoothed share of good labels
        n1, n = [int(v or 0) for v in known.agg(F.sum("_y"), F.count("*")).first()]
        p = (n1 + 1) / (n + 2)
        return b"", b"", 0.0, float(np.log(p / (1 - p)))
    curves = [fit_logistic(x[:, i], y) for i in range(len(SETTINGS))]
    best = min(range(len(SETTINGS)), key=lambda i: curves[i][2])
    return *pairs[best], *curves[best][:2]


def score_compression(docs: DataFrame, model: tuple[bytes, bytes, float, float], key: str = "doc_id",
                      text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, difference, score, predicted)`` for every row."""
    rows = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a set size, two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good, slope, intercept = shared.value
        both = Compressors(bad, good)
        for b in batches:
            x = both.differences(texts_of(b, text))
            s = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array(s),
                                              pa.array((s >= threshold).astype(np.int32))],
                                             names=[key, "difference", "score", "predicted"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, difference double, score double, predicted int")
