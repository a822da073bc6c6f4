"""Quality classifier by co-training of a text and a metadata view.

Text view: log-odds of hashed words and of hashed pairs of words (naive Bayes over 2 * BUCKETS buckets of the whole text), and
under them a logistic regression on their two means and on shares of character classes, repetitions and lengths.
Metadata view: a logistic regression on source, language and the class of the length column, hashed. Over ROUNDS rounds each
view labels the documents without a label of which it is sure, where such answers hold up on labelled rows that it has
not learned from, and the other view learns from them. Then each view is calibrated (Platt) and a third regression on
both calibrated views gives the score of every document.

All that is learned of many documents is sums: of documents by bucket and label, and by metadata cell and label. So every
unlabelled document takes part in every round, on the executors, and the driver gets tables of fixed size. Features are
extracted once and saved, at 4 bytes a word. Fitting uses at most LABELLED labelled documents (the least by a hash of
doc_id; of several texts of one id the least by hash). Of these by hash two folds of 5 in 16 are learned from; the text view's
regression sees each fold under the other one's log-odds. 4 in 16 are for trial: confidence, calibration, combination and
the threshold; 2 in 16 are seen by none of these and give `held_out_accuracy`. Documents under the threshold are rejected; it is at most 0.5
and so low that at most GOOD_LOST of the good trial rows fall under it.

Nulls: a null text is an empty one; null metadata are values of their own; labels with a null id or quality are no labels. Of
several labels of one document the least holds. Without labels of both kinds in each part every document has score 1 and
is kept. An empty table gives an empty result. `scored` keeps extra columns, but those with the result's names (a parameter)
give way; `kept_documents` keeps all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.llm.common import Workspace, frugal, unused
from tracelake.llm.shingles import hashes_of, mix

LABELLED = 20_000
ROUNDS = 2
CONFIDENT = 0.95
GOOD_LOST = 0.002
BUCKETS = 2**14
#: Log-odds of a bucket are at most this, and begin with so many documents of either label.
MOST, PRIOR = 4.0, 2.0
FOLDS = ("fold 0", "fold 1")
RESULT = ("text_score", "metadata_score", "quality_score", "quality_kept")

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "call": b"!?",
    "mark": b"*$%&#@^~+=", "bar": b"|\\/", "bracket": b"<>{}[]()", "quote": b"\"'`-_", "high": range(128, 256), "control": [*range(0, 9), *range(14, 32), 127],
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _k] = 1
SOURCES, LANGUAGES, LENGTHS = 64, 16, 24
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def text_features(text: str) -> tuple[np.ndarray, list[float]]:
    """(buckets of the words, then of their pairs, as unsigned 16-bit numbers; shares and lengths)."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.lower().split()
    hashes = hashes_of(words)
    pairs = mix(hashes[:-1] * _PAIR ^ hashes[1:])
    buckets = np.concatenate((hashes >> np.uint64(50), (pairs >> np.uint64(50)) + np.uint64(BUCKETS))).astype("<u2")
    n, m = max(1, len(data)), max(1, len(words))
    classes = counts @ _MEMBER
    letters = max(1.0, classes[0] + classes[1] + classes[9])
    distinct, again = len(set(words)) / m, sum(map(eq, words, words[1:])) / m
    lines = counts[10] + 1
    style = [*(classes / n).tolist(), *np.minimum(classes[[3, 4, 5, 6, 7]] / m, 3).tolist(), classes[0] / letters, distinct, again, distinct * np.log1p(m), np.log1p(m), min(n / m, 50) / 10, min(lines / m, 1), float(not words)]
    return buckets, style


STYLE = len(text_features("")[1])


def metadata_cell(source: str | None, lang: str | None, length: int | None) -> int:
    """One of SOURCES * LANGUAGES * LENGTHS."""
    s, g = (zlib.crc32(b"\0" if v is None else b"=" + v.encode()) for v in (source, lang))
    size = LENGTHS - 1 if length is None else min(LENGTHS - 2, max(0, int(length)).bit_length())
    return (s % SOURCES * LANGUAGES + g % LANGUAGES) * LENGTHS + size


def cell_design(cells: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cells), SOURCES + LANGUAGES + LENGTHS))
    rows = np.arange(len(cells))
    out[rows, cells // (LANGUAGES * LENGTHS)] = 1
    out[rows, SOURCES + cells // LENGTHS % LANGUAGES] = 1
    out[rows, SOURCES + LANGUAGES + cells % LENGTHS] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """Ridge logistic regression on standardised features, by Newton's method; rows may count several times."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(x)) if weight is None else weight
        self.mean = np.average(x, axis=0, weights=weight)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=weight))
        self.scale[self.scale < 1e-9] = 1.0
        z = self._design(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10)
        return np.hstack([z, np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weights


def log_odds(sums: np.ndarray) -> np.ndarray:
    """Of each bucket, from (2, buckets) numbers of documents by label; words and pairs apart."""
    out = np.zeros(2 * BUCKETS)
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        n = sums[:, half] + PRIOR * sums[:, half].sum(axis=1, keepdims=True).clip(1) / max(1.0, sums[:, half].sum()) + 1e-3
        share = n / n.sum(axis=1, keepdims=True)
        out[half] = np.clip(np.log(share[1] / share[0]), -MOST, MOST)
    return out


def means_of(odds: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
    """(texts, 2): mean log-odds of each text's words and of its pairs; 0 where it has none."""
    sizes = np.array([len(b) for b in buckets])
    words = (sizes + 1) // 2
    every = odds[np.concatenate([np.zeros(0, dtype="<u2"), *buckets])]
    sums = np.concatenate(([0.0], np.cumsum(every)))
    ends = np.cumsum(sizes)
    first, middle = ends - sizes, ends - sizes + words
    return np.column_stack([(sums[middle] - sums[first]) / np.maximum(words, 1), (sums[ends] - sums[middle]) / np.maximum(sizes - words, 1)])


class CoTrained:
    """Two views, their calibration, their combination and the threshold; small enough to travel with each task."""

    def __init__(self, folds: list[np.ndarray], taught: np.ndarray | float, cell_sums: np.ndarray):
        """Sums by bucket of the two folds and of documents that the metadata view labelled, and sums by cell."""
        self.odds = log_odds(folds[0] + folds[1] + taught)
        self.fold_odds = dict(zip(FOLDS, (log_odds(f + taught) for f in reversed(folds)), strict=True))
        cells = np.flatnonzero(cell_sums.sum(axis=0))
        x = np.vstack([cell_design(cells)] * 2)
        self.metadata = Logistic().fit(x, np.repeat([0.0, 1.0], len(cells)), np.concatenate((cell_sums[0, cells], cell_sums[1, cells])))

    def learning_means(self, part: str, buckets: np.ndarray) -> list[float]:
        """Mean log-odds of a labelled text, a fold's under the other fold's."""
        return means_of(self.fold_odds.get(part, self.odds), [buckets])[0].tolist()

    def fit_rest(self, rows: Rows, means: np.ndarray) -> CoTrained:
        """All that needs single labelled rows; means are their `learning_means`."""
        t, h = rows.part == "trial", rows.part == "held out"
        x = np.hstack([means, rows.style])
        learned = ~(t | h)
        self.text = Logistic().fit(x[learned], rows.y[learned])
        del self.fold_odds
        logits = np.column_stack([self.text.logit(x), self.metadata.logit(cell_design(rows.cells))])
        self.platt = [Logistic(1e-3).fit(logits[t][:, [k]], rows.y[t]) for k in (0, 1)]
        both = self._calibrated(logits)
        #: For each view (text, metadata) and label whether its sure answers hold up on the trial rows.
        sure = [[(sigmoid(both[t, k]) if label else 1 - sigmoid(both[t, k])) >= CONFIDENT for label in (0, 1)] for k in (0, 1)]
        self.trusted = [[bool(s.any() and (rows.y[t][s] == label).mean() >= CONFIDENT) for label, s in enumerate(each)] for each in sure]
        self.combined = Logistic(1e-2).fit(both[t], rows.y[t])
        p = sigmoid(self.combined.logit(both))
        good = np.sort(p[t & (rows.y == 1)])
        self.threshold = float(min(0.5, good[int(GOOD_LOST * len(good))]))
        self.held_out_accuracy = float(((p[h] >= self.threshold) == (rows.y[h] == 1)).mean()) if h.any() else float("nan")
        self.held_out_view_accuracy = [float(((both[h, k] >= 0) == (rows.y[h] == 1)).mean()) if h.any() else float("nan") for k in (0, 1)]
        return self

    def _text_design(self, buckets: list[np.ndarray], style: np.ndarray) -> np.ndarray:
        return np.hstack([means_of(self.odds, buckets), style])

    def _calibrated(self, logits: np.ndarray) -> np.ndarray:
        return np.column_stack([c.logit(logits[:, [k]]) for k, c in enumerate(self.platt)])

    def scores(self, buckets: list[np.ndarray], style: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        both = self._calibrated(np.column_stack([self.text.logit(self._text_design(buckets, style)), self.metadata.logit(cell_design(cells))]))
        return np.column_stack([sigmoid(both), sigmoid(self.combined.logit(both))])


class Rows:
    """The labelled rows that single features are needed of, at most LABELLED, without their buckets: some 150 bytes each."""

    def __init__(self, known: DataFrame):
        table = known.orderBy("doc_id").select("part", "quality", "style", "cell").toArrow()
        self.part = np.array(table["part"].to_pylist(), dtype=object)
        self.y = np.array(table["quality"].to_pylist(), dtype=float)
        self.style = np.frombuffer(b"".join(table["style"].to_pylist()), dtype="<f4").reshape(-1, STYLE)
        self.cells = np.array(table["cell"].to_pylist(), dtype=np.int64)


def _learning_means(known: DataFrame, model: CoTrained) -> np.ndarray:
    shipped = known.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [shipped.value.learning_means(p, np.frombuffer(b, dtype="<u2")) for p, b in zip(batch["part"].to_pylist(), batch["buckets"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([m[k] for m in means], pa.float64()) for k in (0, 1))], names=["doc_id", "words", "pairs"])

    table = known.select("doc_id", "part", "buckets").mapInArrow(frugal(work), "doc_id long, words double, pairs double").orderBy("doc_id").toArrow()
    shipped.unpersist()
    return np.column_stack([table[c].to_numpy() for c in ("words", "pairs")])


FEATURES = "buckets binary, style binary, cell int"


def _extracted(texts: list, sources: list, langs: list, lengths: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    both = [text_features(t or "") for t in texts]
    style = np.array([s for _, s in both], dtype="<f4").reshape(-1, STYLE)
    return [b for b, _ in both], style, np.array([metadata_cell(*row) for row in zip(sources, langs, lengths, strict=True)], dtype=np.int64)


def _from_features(batch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    buckets = [np.frombuffer(b, dtype="<u2") for b in batch["buckets"].to_pylist()]
    style = np.frombuffer(b"".join(batch["style"].to_pylist()), dtype="<f4").reshape(-1, STYLE)
    return buckets, style, np.array(batch["cell"].to_pylist(), dtype=np.int64)


def features(docs: DataFrame, labels: DataFrame, labelled: int, workspace: Workspace) -> DataFrame:
    """(doc_id, part, quality, text_hash, and FEATURES) of every document; part and quality are null for unlabelled ones."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    lot = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(16))
    part = F.when(lot < 5, FOLDS[0]).when(lot < 10, FOLDS[1]).when(lot < 14, "trial").otherwise("held out")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id", "quality", part.alias("part"))
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(chosen), "doc_id", "left")  # at most `labelled` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                buckets, style, cells = _extracted(*(b[c].to_pylist() for c in ("text", "source", "lang", "n_chars")))
                made = [pa.array([x.tobytes() for x in buckets], pa.binary()), pa.array([x.tobytes() for x in style], pa.binary()), pa.array(cells, pa.int32())]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], b["quality"], b["text_hash"], *made], names=["doc_id", "part", "quality", "text_hash", "buckets", "style", "cell"])

    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return workspace.save("features", rows.mapInArrow(frugal(extract), f"doc_id long, part string, quality int, text_hash long, {FEATURES}"), partition_by="part")


def _sums(rows: DataFrame, teach) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Numbers of documents by (label, bucket) and (label, cell), where teach(batch) gives the labels for buckets and for cells, -1
    for none. A row for each task and place that it fills, added up before the driver gets a table of fixed size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, cells = np.zeros((2, 2 * BUCKETS)), np.zeros((2, SOURCES * LANGUAGES * LENGTHS))
        given = [0, 0]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                ids = [np.frombuffer(x, dtype="<u2") for x in b["buckets"].to_pylist()]
                for_buckets, for_cells = teach(b)
                for label in (0, 1):
                    chosen = np.flatnonzero(for_buckets == label)
                    if len(chosen):  # a document counts once for a bucket
                        buckets[label] += np.bincount(np.concatenate([np.unique(ids[k]) for k in chosen]), minlength=2 * BUCKETS)
                    cells[label] += np.bincount(np.array(b["cell"])[for_cells == label], minlength=cells.shape[1])
                given[0] += int((for_cells >= 0).sum())
                given[1] += int((for_buckets >= 0).sum())
        every = np.concatenate((buckets.ravel(), cells.ravel(), given))
        there = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(every[there].astype(np.int64))], names=["place", "n"])

    total = np.zeros(4 * BUCKETS + 2 * SOURCES * LANGUAGES * LENGTHS + 2)
    found = rows.select("quality", *(f.split()[0] for f in FEATURES.split(", "))).mapInArrow(frugal(work), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total[found["place"].to_numpy()] = found["n"].to_numpy()
    return total[: 4 * BUCKETS].reshape(2, -1), total[4 * BUCKETS : -2].reshape(2, -1), int(total[-2]), int(total[-1])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, workspace: Workspace | None = None) -> CoTrained | None:
    """The model; None without labels of both kinds in each part."""
    workspace = workspace or Workspace(docs.sparkSession, "quality")
    table = features(docs, labels, labelled, workspace)
    one = F.struct("text_hash", "part", "quality", "buckets", "style", "cell")  # of several texts of one id the least by hash
    known = workspace.save("labelled", table.where("part IS NOT NULL").groupBy("doc_id").agg(F.min(one).alias("r")).select("doc_id", "r.*"))
    kinds = {(r["part"], r["quality"]) for r in known.select("part", "quality").distinct().collect()}
    if not {(p, q) for p in (*FOLDS, "trial") for q in (0, 1)} <= kinds:
        return None

    def given(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = np.array(batch["quality"].to_pylist(), dtype=np.int64)
        return y, y

    sums = [_sums(known.where(F.col("part") == f), given) for f in FOLDS]
    folds, learned_cells = [x[0] for x in sums], sums[0][1] + sums[1][1]
    single = Rows(known)

    def fitted(taught_buckets: np.ndarray | float, taught_cells: np.ndarray | float) -> CoTrained:
        model = CoTrained(folds, taught_buckets, learned_cells + taught_cells)
        return model.fit_rest(single, _learning_means(known, model))

    model = fitted(0.0, 0.0)
    taught = [0, 0]
    for _ in range(rounds):
        shipped = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

        def sure(batch: pa.RecordBatch, shipped=shipped) -> tuple[np.ndarray, np.ndarray]:
            teacher = shipped.value
            p = teacher.scores(*_from_features(batch))
            out = []
            for view in (1, 0):  # the metadata view's answers are for buckets, the text view's for cells
                y = np.full(len(p), -1)
                for label in (0, 1):
                    if teacher.trusted[view][label]:
                        y[(p[:, view] if label else 1 - p[:, view]) >= CONFIDENT] = label
                out.append(y)
            return out[0], out[1]

        buckets, cells, by_text, by_metadata = _sums(table.where("part IS NULL"), sure)
        model = fitted(buckets, cells)
        taught = [taught[0] + by_text, taught[1] + by_metadata]
        shipped.unpersist()
    #: Labels that the text and the metadata view gave.
    model.given = taught
    workspace.drop("features", "labelled")
    return model


def scored(docs: DataFrame, model: CoTrained | None, names: tuple[str, ...] = RESULT) -> DataFrame:
    """`docs` with the columns RESULT, under `names`."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {n.lower() for n in names}))
    if model is None:
        return docs.withColumns({c: F.lit(1.0) for c in names[:3]} | {names[3]: F.lit(True)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = model.scores(*_extracted(*(part[c].to_pylist() for c in ("text", "source", "lang", "n_chars"))))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in p.T), pa.array(p[:, 2] >= model.threshold)], names=[*part.schema.names, *names])

    schema = StructType(docs.schema.fields[:])
    for name, kind in zip(names, ("double", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(frugal(score), schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, as they were."""
    names = tuple(unused(docs.columns, *RESULT))
    return scored(docs, fit(docs, labels), names).where(F.col(names[3])).select(*docs.columns)
