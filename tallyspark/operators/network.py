"""A small convolutional network over bars, in numpy: two layers of 8 filters of width 3, the mean over time, one linear output.

Samples are rows (id, security, signal_at, history, y, available_at); ``history`` is an array of (open, high, low, close, volume) in time order.
Channels are built by column expressions, folds are fitted in parallel, a fold in one task, and scoring goes over Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .returns import InputError, require
from .returns import few as sized

FILTERS, WIDTH = 8, 3
ARCHITECTURE = "conv1d-8x8-average"
FIT = "fold string, model string, epoch int, train_loss double, validation_loss double, test_mse double, baseline_mse double, scores array<struct<id:string,score:double>>"


def checked_samples(samples: DataFrame, lookback: int, cutoff: Column | None = None, labelled: bool = True) -> DataFrame:
    """``samples`` if each has ``lookback`` bars within their bounds, ids and signals of a security are unique, and no label is known before its signal or after the
    cut-off. A prediction must not carry labels."""
    bar = F.exists("history", lambda b: (b["low"] <= 0) | (b["low"] > F.least(b["open"], b["close"])) | (F.greatest(b["open"], b["close"]) > b["high"]) | (b["volume"] < 0))
    rules = {"bars": F.size("history") != lookback, "bounds": bar}
    if labelled:
        rules |= {"label": F.isnan("y") | (F.col("y") < -1), "known_early": F.col("available_at") <= F.col("signal_at")}
        if cutoff is not None:
            rules["known_late"] = (F.col("available_at") > cutoff) | (F.col("signal_at") > cutoff)
    elif "y" in samples.columns:
        raise InputError("what is to be predicted must not carry labels")
    require(samples, **rules)
    for keys in (["id"], ["security", "signal_at"]):
        if not samples.groupBy(*keys).count().where("count > 1").isEmpty():
            raise InputError(f"samples repeat {keys}")
    return samples


def with_channels(samples: DataFrame, geometry: bool = False) -> DataFrame:
    """``samples`` with channels, an array of series: four prices over the first close, less 1, and the logarithm of volume; with ``geometry`` body, both shadows, gap and
    change over two bars, as parts of the close before."""
    first = F.get("history", F.lit(0))["close"]
    over_first = lambda k: F.transform("history", lambda b: b[k] / first - 1)
    series = [over_first(k) for k in ("open", "high", "low", "close")]
    series.append(F.transform("history", lambda b: F.log1p(b["volume"])))
    if geometry:
        before = lambda i, n: F.get("history", F.greatest(i - n, F.lit(0)))["close"]
        series += [
            F.transform("history", lambda b: (b["close"] - b["open"]) / b["close"]),
            F.transform("history", lambda b: (b["high"] - F.greatest(b["open"], b["close"])) / b["close"]),
            F.transform("history", lambda b: (F.least(b["open"], b["close"]) - b["low"]) / b["close"]),
            F.transform("history", lambda b, i: F.when(i > 0, b["open"] / before(i, 1) - 1).otherwise(0.0)),
            F.transform("history", lambda b, i: F.when(i > 1, b["close"] / before(i, 2) - 1).otherwise(0.0)),
        ]
    return samples.withColumn("channels", F.array(*series))


def staged_samples(samples: DataFrame, folds: DataFrame, embargo_days: int = 0) -> DataFrame:
    """``samples`` with fold and stage, by ``folds`` (fold, train_start, train_end, validation_start, validation_end, test_start, test_end; days), which are few. A row whose label
    is known only when the next stage has begun, less the embargo, is purged. Each stage of each fold needs three rows."""
    d = F.to_date("signal_at")
    inside = lambda s: d.between(F.col(f"{s}_start"), F.col(f"{s}_end"))
    require(folds, order=~((F.col("train_start") <= F.col("train_end")) & (F.col("train_end") < F.col("validation_start")) & (F.col("validation_start") <= F.col("validation_end")) & (F.col("validation_end") < F.col("test_start")) & (F.col("test_start") <= F.col("test_end"))))
    rows = samples.crossJoin(sized(folds, "folds")).withColumn("stage", F.when(inside("train"), "train").when(inside("validation"), "validation").when(inside("test"), "test")).where("stage IS NOT NULL")
    next_start = F.when(F.col("stage") == "train", F.col("validation_start")).when(F.col("stage") == "validation", F.col("test_start"))
    late = F.coalesce(F.to_date("available_at") >= F.date_sub(next_start, embargo_days), F.lit(False))
    kept = rows.where(~late).select("fold", "stage", *samples.columns)
    few = kept.groupBy("fold").agg(*(F.count_if(F.col("stage") == s).alias(s) for s in ("train", "validation", "test")))
    require(few, rows=F.least("train", "validation", "test") < 3)
    return kept


@dataclass
class Net:
    """Weights, and the scaling of channels and target that training rows gave."""

    parts: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    target_mean: float = 0.0
    target_scale: float = 1.0

    @classmethod
    def drawn(cls, channels: int, seed: int) -> Net:
        rng = np.random.default_rng(seed)

        def uniform(*shape: int) -> np.ndarray:
            bound = 1 / np.sqrt(np.prod(shape[:-1]))
            return rng.uniform(-bound, bound, shape)

        w1, w2, out = uniform(WIDTH, channels, FILTERS), uniform(WIDTH, FILTERS, FILTERS), uniform(FILTERS, 1)
        return cls({"w1": w1, "b1": np.zeros(FILTERS), "w2": w2, "b2": np.zeros(FILTERS), "w3": out[:, 0], "b3": np.zeros(1)}, np.zeros(channels), np.ones(channels))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """(samples, bars, channels) from (samples, channels, bars)."""
        return ((x - self.mean[:, None]) / self.scale[:, None]).transpose(0, 2, 1)

    @staticmethod
    def _windows(x: np.ndarray) -> np.ndarray:
        """(samples, bars, WIDTH * channels): each bar with its neighbours, zeros beyond the ends."""
        padded = np.pad(x, ((0, 0), (1, 1), (0, 0)))
        return np.concatenate([padded[:, k : k + x.shape[1]] for k in range(WIDTH)], axis=2)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.parts
        a = self._windows(x)
        h = np.maximum(a @ p["w1"].reshape(-1, FILTERS) + p["b1"], 0)
        b = self._windows(h)
        g = np.maximum(b @ p["w2"].reshape(-1, FILTERS) + p["b2"], 0)
        m = g.mean(axis=1)
        return m @ p["w3"] + p["b3"][0], (a, h, b, g, m)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.parts
        out, (a, h, b, g, m) = self.forward(x)
        off = 2 * (out - y) / len(y)
        dg = (off[:, None] * p["w3"])[:, None, :] / g.shape[1] * (g > 0)
        db = (dg @ p["w2"].reshape(-1, FILTERS).T).reshape(*dg.shape[:2], WIDTH, FILTERS)
        dh = np.zeros((len(x), x.shape[1] + 2, FILTERS))
        for k in range(WIDTH):
            dh[:, k : k + x.shape[1]] += db[:, :, k]
        dh = dh[:, 1:-1] * (h > 0)
        flat = lambda left, right: np.tensordot(left, right, axes=((0, 1), (0, 1)))
        return float(((out - y) ** 2).mean()), {"w1": flat(a, dh).reshape(p["w1"].shape), "b1": dh.sum(axis=(0, 1)), "w2": flat(b, dg).reshape(p["w2"].shape), "b2": dg.sum(axis=(0, 1)),
            "w3": m.T @ off, "b3": np.asarray([off.sum()])}

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x))[0] * self.target_scale + self.target_mean

    def dumped(self, **more: object) -> str:
        """JSON with the architecture and a digest of everything else."""
        body = {"architecture": ARCHITECTURE, "parts": {k: v.tolist() for k, v in self.parts.items()}, "mean": self.mean.tolist(), "scale": self.scale.tolist(),
            "target_mean": self.target_mean, "target_scale": self.target_scale, **more}
        return json.dumps(body | {"digest": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, sort_keys=True)

    @classmethod
    def loaded(cls, text: str, digest: str | None = None) -> Net:
        """The network of :meth:`dumped`; another digest, architecture or shape, and numbers that aren't finite, raise."""
        body = json.loads(text)
        told = body.pop("digest", None)
        if told != hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() or (digest is not None and told != digest):
            raise InputError("the model's digest is another one")
        if body["architecture"] != ARCHITECTURE:
            raise InputError("unknown architecture")
        parts = {k: np.asarray(v, dtype=float) for k, v in body["parts"].items()}
        net = cls(parts, np.asarray(body["mean"], dtype=float), np.asarray(body["scale"], dtype=float), body["target_mean"], body["target_scale"])
        want = {k: v.shape for k, v in cls.drawn(len(net.mean), 0).parts.items()}
        if {k: v.shape for k, v in parts.items()} != want or net.scale.shape != net.mean.shape or not all(np.isfinite(v).all()
            for v in (*parts.values(), net.mean, net.scale)) or (net.scale <= 0).any() or net.target_scale <= 0:
            raise InputError("the model's weights don't fit")
        return net


def fit(train: np.ndarray, y: np.ndarray, validation: np.ndarray, vy: np.ndarray, epochs: int, rate: float, seed: int) -> tuple[Net, int, float, float]:
    """(network of the epoch with the least validation loss, that epoch, its training and validation loss) by Adam over all training rows at once. Scaling comes from
    training rows only; labels that don't vary raise."""
    if not 1 <= epochs <= 200 or not 0 < rate <= 0.1:
        raise InputError("1 to 200 epochs and a rate up to 0.1")
    if y.std() <= 1e-12:
        raise InputError("training labels don't vary")
    net = Net.drawn(train.shape[1], seed)
    spread = train.std(axis=(0, 2))
    net.mean, net.scale = train.mean(axis=(0, 2)), np.where(spread > 0, spread, 1.0)
    net.target_mean, net.target_scale = float(y.mean()), float(y.std())
    x, vx = net.scaled(train), net.scaled(validation)
    t, vt = ((v - net.target_mean) / net.target_scale for v in (y, vy))
    first, second = ({k: np.zeros_like(v) for k, v in net.parts.items()} for _ in range(2))
    best: tuple = (np.inf, None, 0, 0.0)
    for epoch in range(1, epochs + 1):
        loss, slopes = net.gradients(x, t)
        if not np.isfinite(loss):
            raise InputError("the training loss isn't finite")
        for k, g in slopes.items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            net.parts[k] = net.parts[k] - rate * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
        seen = float(((net.forward(vx)[0] - vt) ** 2).mean())
        if seen < best[0]:
            best = (seen, {k: v.copy() for k, v in net.parts.items()}, epoch, loss)
    net.parts = best[1]
    return net, best[2], best[3], best[0]


def _arrays(rows: pd.DataFrame) -> np.ndarray:
    return np.asarray([np.stack([np.asarray(c, dtype=float) for c in x]) for x in rows["channels"]])


def fit_folds(staged: DataFrame, epochs: int = 20, rate: float = 0.01, seed: int = 17) -> DataFrame:
    """A row for each fold of :func:`staged_samples` with channels: model, chosen epoch, losses, the error on test rows and that of the training mean, and test scores. Test
    labels are looked at after the epoch is chosen."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["signal_at", "id"])
        part = {s: rows[rows["stage"] == s] for s in ("train", "validation", "test")}
        y = {s: p["y"].to_numpy(dtype=float) for s, p in part.items()}
        net, epoch, train_loss, validation_loss = fit(_arrays(part["train"]), y["train"], _arrays(part["validation"]), y["validation"], epochs, rate, seed)
        got = net.predict(_arrays(part["test"]))
        mse = lambda v: float(((v - y["test"]) ** 2).mean())
        scores = [{"id": str(i), "score": float(v)} for i, v in zip(part["test"]["id"], got)]
        return pd.DataFrame({"fold": [rows["fold"].iloc[0]], "model": [net.dumped(epoch=epoch, seed=seed)], "epoch": [epoch], "train_loss": [train_loss],
            "validation_loss": [validation_loss], "test_mse": [mse(got)], "baseline_mse": [mse(net.target_mean)], "scores": [scores]})

    return staged.groupBy("fold").applyInPandas(run, FIT)


def predict(samples: DataFrame, model: str, digest: str | None = None) -> DataFrame:
    """(id, score) of ``samples`` with channels by a dumped model, whose size doesn't depend on the data."""
    Net.loaded(model, digest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Net.loaded(model, digest)
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({"id": rows["id"], "score": net.predict(_arrays(rows))})

    return samples.select("id", "channels").mapInPandas(run, "id string, score double")


def scored(fits: DataFrame, staged: DataFrame) -> DataFrame:
    """(fold, id, security, signal_at, score, y) of the test rows of all folds."""
    each = fits.select("fold", F.explode("scores").alias("s")).select("fold", "s.id", "s.score")
    return staged.where("stage = 'test'").select("fold", "id", "security", "signal_at", "y").join(each, ["fold", "id"])


def compared(staged_plain: DataFrame, staged_geometry: DataFrame, signals: DataFrame, epochs: int = 20, rate: float = 0.01, seed: int = 17) -> DataFrame:
    """(fold, ohlcv, geometry, rules): test errors of the network on prices, of the network with geometry, and of the training mean for each signal of candle rules
    (id, signal), on the same rows. No winner is chosen; a signal that training lacks gets the mean of all."""
    train = staged_plain.where("stage = 'train'").join(signals, "id")
    each = train.groupBy("fold", "signal").agg(F.avg("y").alias("told"))
    whole = train.groupBy("fold").agg(F.avg("y").alias("mean"))
    test = staged_plain.where("stage = 'test'").join(signals, "id").join(each, ["fold", "signal"], "left").join(whole, "fold")
    rules = test.groupBy("fold").agg(F.avg(F.pow(F.coalesce("told", "mean") - F.col("y"), F.lit(2))).alias("rules"))
    net = lambda s, n: fit_folds(s, epochs, rate, seed).select("fold", F.col("test_mse").alias(n))
    return net(staged_plain, "ohlcv").join(net(staged_geometry, "geometry"), "fold").join(rules, "fold")


def bridge(scores: DataFrame, labels: DataFrame, computed_at: Column, cutoff: Column) -> DataFrame:
    """Panel rows (signal_date, security, factor, fwd) from scores (id, security, signal_at, score) that were computed before their signals, one to one with labels (id,
    security, signal_at, y, available_at). Scores computed afterwards are no factor that could have been known, and raise."""
    from .evidence import bijection

    require(scores, computed_late=computed_at > F.col("signal_at"))
    told = labels.select("id", F.col("security").alias("__s"), F.col("signal_at").alias("__at"), "y", "available_at")
    joined = bijection(scores, told, "id")
    require(joined, other_sample=(F.col("security") != F.col("__s")) | (F.col("signal_at") != F.col("__at")), known_late=F.col("available_at") > cutoff)
    return joined.select(F.to_date("signal_at").alias("signal_date"), "security", F.col("score").alias("factor"), F.col("y").alias("fwd"))
