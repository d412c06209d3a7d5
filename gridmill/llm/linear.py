"""Linear classifiers on naive Bayes features: quality (hinge loss, dual coordinate descent) and toxicity.

N-gram indicators are scaled by the classes' log-count ratios r = log((p / |p|) / (q / |q|)), counted over the rows
of the fit and shrunk towards 0 by ``CONFIDENCE`` standard errors, so n-grams seen a few times carry no
weight.  Shards of those rows, each in the order of a hash of the id, fit a linear model by dual coordinate
descent (hinge loss) or its logistic counterpart, and the shards' weights are averaged; one fifth of each shard is
held back to turn margins into scores by a logistic curve, whose shift puts ``DECISION`` where the rarer class is told
best on those rows (F1).  The fit reads at most about
``max_rows`` labelled rows, chosen by a hash of the id; scoring reads every text whole.

Defined cases: null counts as empty text; an empty text scores with the model's constant alone.  Rows whose label or id is null
are not learnt from; of several labels of an id the mean counts, 1 from one half.  An empty table gives an empty result.  Without both classes
every score is the share of class 1 (0.5 if no row can be learnt from).  Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import sliced, text_or_empty, tidied, written

MAX_ROWS = 20_000
SHARD_ROWS = 5_000
CONFIDENCE = 2.0
DECISION = 0.7


@dataclass
class Model:
    """weights by slot (already times the log-count ratio), constant, and the curve from margin to probability."""

    kind: str
    weights: object
    constant: float
    slope: float
    shift: float

    def probability(self, margin):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def descend(rows, labels, scale, loss: str, cost: float, epochs: int = 20, seed: int = 1):
    """(weights, constant) of a linear model on rows of slots with values ``scale[slot]``, by dual coordinate descent."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, b, sizes = np.zeros(len(scale)), 0.0, [float(np.dot(scale[x], scale[x])) + 1 for x in rows]
    alpha = np.full(len(rows), 0.0 if loss == "hinge" else 1e-3 * cost)
    if loss != "hinge":
        for x, y, a in zip(rows, labels, alpha):
            w[x] += a * y * scale[x]
            b += a * y
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, y = rows[i], labels[i]
            s = scale[x]
            margin = y * (float(np.dot(w[x], s)) + b)
            old = alpha[i]
            if loss == "hinge":
                new = min(max(old + (1 - margin) / sizes[i], 0.0), cost)
            else:  # one guarded Newton step on the entropy form
                slope = margin + np.log(old / (cost - old))
                new = min(max(old - slope / (sizes[i] + cost / (old * (cost - old))), old / 4, 1e-9 * cost), (old + 3 * cost) / 4)
            if new != old:
                w[x] += (new - old) * y * s
                b += (new - old) * y
                alpha[i] = new
                most = max(most, abs(new - old))
        if most < 1e-3 * cost:
            break
    return w, b


def curve(margins, labels) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), with Platt's smoothed targets."""
    import numpy as np

    m, y = np.asarray(margins, float), np.asarray(labels, float)
    up, down = y.sum(), len(y) - y.sum()
    if not up or not down:
        return 1.0, 0.0
    scale = float(np.std(m)) or 1.0
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, ab = np.stack((m / scale, np.ones(len(m))), 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -60, 60)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (ab - [1.0, 0.0]))
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3) / scale), float(ab[1])


def best_cut(margins, labels) -> float:
    """The margin that tells the rarer class best, by F1; the middle one of those nearly as good."""
    import numpy as np

    m, y = np.asarray(margins, float), np.asarray(labels, int)
    if not 0 < y.sum() < len(y):
        return 0.0
    if 2 * y.sum() > len(y):  # class 0 is the rarer: the same from the other side
        return -best_cut(-m, 1 - y)
    order = np.argsort(-m, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(m[order][:-1] > m[order][1:], True)  # equal margins fall on one side
    good = np.flatnonzero(ends & (f1 >= f1[ends].max() - 0.002))
    k = good[len(good) // 2]
    return float(m[order][k] if k + 1 == len(m) else (m[order][k] + m[order][k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, kind: str, loss: str, cost: float, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` for which ``learn`` (of the id) holds."""
    import numpy as np

    from ._features import BITS

    y = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(id_col).alias("_lid")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    total = y.count()
    mix = F.xxhash64("_lid")
    if total > max_rows:
        y = y.where(F.pmod(mix, F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    shards = max(1, -(-min(total, max_rows) // shard_rows))
    y = F.broadcast(y.select("_lid", "_y"))  # at most about max_rows small rows

    def extract(batches):
        import pyarrow as pa

        from ._features import EXTRACTORS

        for batch in sliced(batches, 2048):
            texts = (x.as_py() or b"" for x in batch.column(2).cast(pa.binary()))
            # A few hundred rows at a time, as flat arrays: a batch's slots as Python lists would take a gigabyte.
            for at in range(0, batch.num_rows, 256):
                slots = list(EXTRACTORS[kind](x for _, x in zip(range(256), texts)))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in slots]))).astype(np.int32)
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(slots)))], names=["mix", "y", "slots"])

    joined = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(y, F.col("_id") == F.col("_lid"))
    rows = written(joined.select(mix, "_y", "_text").mapInArrow(tidied(extract), "mix long, y int, slots array<int>"))

    size = 1 << BITS
    counts = np.zeros((2, size))
    tally = rows.select("y", F.explode("slots").alias("s")).groupBy("s").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    for s, p, n in tally.collect():  # at most 2**BITS rows
        counts[:, s] += (n - p, p)
    n_up, n_all = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_up or n_up == n_all:
        share = n_up / n_all if n_all else 0.5
        shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(kind, np.zeros(size, dtype=np.float32), 0.0, 1.0, float(shift))
    share = n_up / n_all
    up, down = counts[1] + share, counts[0] + 1 - share
    ratio = np.log(up / n_up) - np.log(down / (n_all - n_up))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - CONFIDENCE * np.sqrt(1 / up + 1 / down), 0)

    def train(pdf):
        import pandas as pd

        pdf = pdf.assign(size=pdf["slots"].map(len)).sort_values(["mix", "y", "size"], kind="stable")
        held = (pdf["mix"].to_numpy() // 64) % 5 == 0
        x, y_ = list(pdf["slots"]), pdf["y"].to_numpy()
        if len({*y_[~held]}) < 2 or len({*y_[held]}) < 2:
            held[:] = False
        w, b = descend([v for v, h in zip(x, held) if not h], 2.0 * y_[~held] - 1, ratio, loss, cost)
        test = held if held.any() else ~held
        margin = [float(np.dot(w[v], ratio[v])) + b for v, t in zip(x, test) if t]
        w = w * ratio
        at = np.flatnonzero(w)
        part = pd.DataFrame({"s": np.append(at, -1), "w": np.append(w[at], b), "y": -1})
        return pd.concat([part, pd.DataFrame({"s": -2, "w": margin, "y": y_[test]})])

    fitted = written(rows.groupBy(F.pmod("mix", F.lit(shards)).alias("shard")).applyInPandas(train, "s int, w double, y int"))
    weights, constant = np.zeros(size), 0.0
    for s, w in fitted.where("s >= -1").groupBy("s").agg(F.sum("w") / shards).collect():  # at most 2**BITS + 1 rows
        if s < 0:
            constant = w
        else:
            weights[s] = w
    held_back = fitted.where("s = -2").select("w", "y").toPandas()  # a fifth of max_rows
    held_back = held_back.sort_values(["w", "y"])
    slope, _ = curve(held_back["w"], held_back["y"])
    shift = float(np.log(DECISION / (1 - DECISION))) - slope * best_cut(held_back["w"], held_back["y"])
    return Model(kind, weights.astype(np.float32), float(constant), slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of class 1 for every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ._features import EXTRACTORS

        for batch in sliced(batches, 2048):
            texts = (x.as_py() or b"" for x in batch.column(1).cast(pa.binary()))
            margin = np.fromiter((float(model.weights[s].sum()) + model.constant for s in EXTRACTORS[model.kind](texts)), dtype=float, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(margin))], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(tidied(run), f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> Model:
    """Naive Bayes support vectors on word n-grams for ``labels.quality``."""
    return fit(docs, labels, "quality", learn, "word", "hinge", 0.1, **options)


def toxicity_model(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> Model:
    """A logistic model on scaled character n-grams for ``labels.toxic``."""
    return fit(docs, labels, "toxic", learn, "char", "logistic", 1.0, **options)
