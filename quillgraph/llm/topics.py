"""Subject areas of documents.

One-versus-rest linear classifiers on hashed word n-grams are trained on the
sentences of labelled documents. Labels come from people and from labelling
functions: a value of a document's address path or metadata (a folder, a word
of the file name, a source) gives an area to the documents that bear it, if its
precision on the documents with a known area is measured to be high enough; a
value that isn't is switched off by that measure. A document's label is only a
weak one for its sentences (some are about nothing, some about another area),
so after a first fit each sentence keeps the labels that the fit finds in it,
and the classifiers are fitted again. A document's share of an area is the
share of its characters in sentences of that area; the least share is
calibrated for each area on labelled documents held out of the fit.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sizing import broadcast_if_small, durable

#: Labelled documents that the classifiers are fitted and calibrated on, at most about this many.
LABELLED = 8_000
#: Hashed features, and longest n-gram in words; a CJK character counts as a word.
BITS, WORDS = 17, 3
#: Share of a document's text that an area must have, where no label allows a calibration.
LEAST_SHARE = 0.25

_TOKEN = re.compile(r"[^\W\d_⺀-￿]+|[⺀-鿿豈-﫿]")
_SENTENCE = re.compile(r"[^。！？!?；;…\n.]*(?:[。！？!?；;…\n]+|\.(?=\s|\Z)|\.|\Z)")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def sentences(text: str) -> list[str]:
    """The sentences of a text; a full stop inside a number or word doesn't end one."""
    out, held = [], ""
    for m in _SENTENCE.finditer(text):
        held += m.group()
        if not held:
            break
        if not (held.endswith(".") and m.end() < len(text) and not text[m.end()].isspace()):
            out.append(held)
            held = ""
    return [*out, held] if held else out


class Features:
    """Hashed n-grams of sentences; remembers the numbers of words."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.words: dict[str, int] = {}

    def numbers(self, text: str) -> list[int]:
        known = self.words
        if len(known) > 500_000:
            known.clear()
        out = []
        for word in _TOKEN.findall(text):
            if (n := known.get(word)) is None:
                n = known[word] = zlib.crc32(word.encode("utf-8", "replace")) + 1
            out.append(n)
        return out

    def of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, sentence) of every n-gram; none crosses the end of a sentence."""
        lists = [self.numbers(unicodedata.normalize("NFKC", p).lower()) for p in parts]
        sizes = np.array([len(x) for x in lists], np.int64)
        words = np.fromiter((n for x in lists for n in x), np.uint64, int(sizes.sum()))
        where = np.repeat(np.arange(len(parts)), sizes)
        features, places = [], []
        for n in range(1, WORDS + 1):
            if len(words) < n:
                break
            with np.errstate(over="ignore"):
                h = np.full(len(words) - n + 1, n, np.uint64)
                for i in range(n):
                    h = (h ^ words[i : len(words) - n + 1 + i]) * _MIX[i]
                    h ^= h >> np.uint64(29)
            inside = where[: len(words) - n + 1] == where[n - 1 :]
            features.append((h >> np.uint64(64 - self.bits))[inside].astype(np.int32))
            places.append(where[: len(words) - n + 1][inside])
        return (np.concatenate(features), np.concatenate(places)) if features else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _scores(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Probabilities by sentence and area, 0 for a sentence without words; features count by the root of their number."""
    total = np.full((n, weights.shape[1]), -np.inf, np.float32)
    if len(features):
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        sums = np.add.reduceat(np.take(weights, features, axis=0), starts, axis=0)
        total[where[starts]] = sums / np.sqrt(np.diff(np.r_[starts, len(where)]))[:, None]
    return np.where(np.isneginf(total), 0, 1 / (1 + np.exp(-np.clip(total + bias, -30, 30)))).astype(np.float32)


def _by_sentence(features: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(where, kind="stable")
    return features[order], where[order]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


#: A fit takes at least so many passes over the sentences and so many steps of BLOCK sentences.
PASSES, STEPS, BLOCK = 2, 60, 512


def _fit(features: np.ndarray, starts: np.ndarray, goal: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression for every area at once, by AdaGrad over blocks of sentences."""
    rng = np.random.default_rng(seed)
    areas = goal.shape[1]
    weights, seen = np.zeros((1 << bits, areas), np.float32), np.full((1 << bits, areas), 1e-2, np.float32)
    bias = np.full(areas, -2.0, np.float32)
    sizes = np.diff(starts)
    for _ in range(max(PASSES, -(-STEPS // max(1, -(-len(goal) // BLOCK))))):
        order = rng.permutation(len(goal))
        for s in range(0, len(order), BLOCK):
            block = order[s : s + BLOCK]
            block = block[sizes[block] > 0]
            if not len(block):
                continue
            n = sizes[block]
            f = features[_ranges(starts[block], n)]
            where = np.repeat(np.arange(len(block)), n)
            off = _scores(weights, bias, f, where, len(block)) - goal[block]
            step = (off / np.sqrt(n)[:, None]).astype(np.float32)
            # Slopes of the features, summed over the sentences that have them.
            by_feature = np.argsort(f, kind="stable")
            sorted_f = f[by_feature]
            first = np.flatnonzero(np.r_[True, sorted_f[1:] != sorted_f[:-1]])
            kinds, slope = sorted_f[first], np.add.reduceat(np.take(step, where[by_feature], axis=0), first, axis=0)
            sums = np.take(seen, kinds, axis=0) + slope**2
            seen[kinds] = sums
            weights[kinds] = np.take(weights, kinds, axis=0) - 0.25 * slope / np.sqrt(sums)
            bias -= 0.002 * off.sum(0)
    return weights, bias


def _shares(p: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int, cut: float) -> np.ndarray:
    """Share of each area in each document: characters of sentences whose probability reaches ``cut``, split if several do."""
    on = np.where(p >= cut, p, 0)
    on /= np.maximum(on.sum(1, keepdims=True), 1e-9)
    out = np.zeros((n, p.shape[1]))
    np.add.at(out, owner, on * sizes[:, None])
    whole = np.bincount(owner, sizes, n)
    return out / np.maximum(whole, 1)[:, None]


class _Sentences:
    """The sentences of texts with their features, ready to be picked by text."""

    def __init__(self, texts: list[str], bits: int):
        parts, owner = [], []
        for i, text in enumerate(texts):
            for s in sentences(text):
                parts.append(s)
                owner.append(i)
        self.owner = np.array(owner, np.int64)
        self.sizes = np.array([len(s) for s in parts], np.float64)
        self.features, self.where = _by_sentence(*Features(bits).of(parts))
        self.starts = np.searchsorted(self.where, np.arange(len(parts) + 1))

    def picked(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, starts, numbers) of the sentences of the chosen texts."""
        inside = np.flatnonzero(chosen[self.owner])
        sizes = np.diff(self.starts)[inside]
        return self.features[_ranges(self.starts[inside], sizes)], np.r_[0, np.cumsum(sizes)], inside


def _fit_refined(data: _Sentences, truth: np.ndarray, chosen: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A fit on the chosen texts, first with their labels on every sentence, then only where the fit finds them."""
    features, starts, inside = data.picked(chosen)
    where = np.repeat(np.arange(len(inside)), np.diff(starts))
    own = truth[data.owner[inside]]
    weights, bias = _fit(features, starts, own, bits, seed)
    for again in range(2):
        p = _scores(weights, bias, features, where, len(inside))
        # A label stays with the sentences in which the fit finds it and no other area more.
        kept = (p >= 0.3) & (p >= 0.7 * p.max(1, keepdims=True))
        # With few labels no sentence of a text may reach that; then its likeliest ones keep the label.
        most = np.zeros(truth.shape)
        np.maximum.at(most, data.owner[inside], p)
        kept |= (p >= 0.8 * most[data.owner[inside]]) & (p >= 0.7 * p.max(1, keepdims=True))
        weights, bias = _fit(features, starts, (own * kept).astype(np.float32), bits, seed + 1 + again)
    return weights, bias


#: Parts that labelled texts are dealt into; each is held out of one fit.
FOLDS = 3
#: Probabilities tried as the one from which a sentence is of an area, and least shares tried.
CUTS, LEASTS = (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6), np.round(np.arange(0.06, 0.36, 0.01), 2)
#: Texts of an area that the calibration of all areas together counts for, beside the area's own.
SHRUNK = 20.0


def _truth(labels: list[set[int]], areas: int) -> np.ndarray:
    truth = np.zeros((len(labels), areas), np.float32)
    for i, own in enumerate(labels):
        truth[i, list(own)] = 1
    return truth


def folds_of(n: int, seed: int = 3) -> np.ndarray:
    """The fold of each of ``n`` texts."""
    return np.random.default_rng(seed).permutation(n) % FOLDS


def fit_fold(texts: list[str], labels: list[set[int]], areas: int, fold: int, bits: int = BITS, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias, shares): a fit on the texts outside of ``fold``, and the shares of the areas in those inside by each of CUTS.

    Fold FOLDS is the final fit, on all texts; it has no shares.
    """
    data, inside = _Sentences(texts, bits), folds_of(len(texts), seed) == fold
    weights, bias = _fit_refined(data, _truth(labels, areas), ~inside, bits, seed)
    if not inside.any():
        return weights, bias, np.zeros((len(CUTS), 0, areas))
    p = _scores(weights, bias, data.features, data.where, len(data.sizes))
    return weights, bias, np.stack([_shares(p, data.sizes, data.owner, len(texts), c)[inside] for c in CUTS])


def _counts(shares: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """(cut, least share, area, what): hits, found and true texts."""
    found = shares[:, None] >= LEASTS[None, :, None, None]
    hits = (found & (truth > 0)).sum(2)
    return np.stack([hits, found.sum(2), np.broadcast_to((truth > 0).sum(0), hits.shape)], axis=-1)


def _f1(counts: np.ndarray) -> np.ndarray:
    return 2 * counts[..., 0] / np.maximum(counts[..., 1] + counts[..., 2], 1e-9)


def calibrate(shares: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray]:
    """(cut, least share of each area) of the best F1.

    The cut is the best for all areas together; an area's least share is the
    best for its own texts and SHRUNK more that are like all areas' together,
    so that few labels decide little.
    """
    counts = _counts(shares, truth).astype(float)
    together = counts.sum(2)
    if not together[..., 2].any():
        return 0.5, np.full(truth.shape[1], LEAST_SHARE)
    cut = int(_f1(together).max(1).argmax())
    own = counts[cut] + SHRUNK * (together[cut] / together[cut, 0, 2])[:, None]
    # Of equally good ones the middle.
    best = _f1(own)
    ties = best >= best.max(0) - 1e-9
    return CUTS[cut], np.array([np.median(LEASTS[t]) for t in ties.T])


def calibrated(shares: np.ndarray, truth: np.ndarray, seed: int = 3) -> dict:
    """Cuts by all texts, and the F1 that cuts by one half of the texts reach on the other half."""
    half = np.random.default_rng(seed + 1).permutation(len(truth)) % 2 == 0
    counts = np.zeros(3)
    for part in (half, ~half):
        cut, least = calibrate(shares[:, part], truth[part])
        found = shares[CUTS.index(cut)][~part] >= least
        real = truth[~part] > 0
        counts += [(found & real).sum(), found.sum(), real.sum()]
    cut, least = calibrate(shares, truth)
    return {"cut": cut, "least": least, "f1": float(_f1(counts)), "held_out": len(truth)}


def train(texts: list[str], labels: list[set[int]], areas: int, bits: int = BITS, seed: int = 3) -> dict:
    """weights, bias, cut, least (of each area), f1, held_out: the classifiers of labelled texts, fitted in this process."""
    folds, shares = folds_of(len(texts), seed), np.zeros((len(CUTS), len(texts), areas))
    for fold in range(FOLDS):
        shares[:, folds == fold] = fit_fold(texts, labels, areas, fold, bits, seed)[2]
    weights, bias, _ = fit_fold(texts, labels, areas, FOLDS, bits, seed)
    return {"weights": weights, "bias": bias} | calibrated(shares, _truth(labels, areas), seed)


#: Least precision (by the lower end of its 90 % interval) and least labelled documents of a labelling function.
PRECISE, SUPPORT = 0.8, 5


def path_values(documents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(_k, value): each folder and word of a document's path and metadata, with the column that it stands in."""

    def words(name: str) -> Column:
        parts = F.array_distinct(F.filter(F.split(F.lower(F.col(f"`{name}`").cast("string")), r"[/\\\s_.\-:?&=#0-9]+"), lambda x: x != ""))
        return F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{name}="), x))

    return documents.select(F.col(f"`{key}`").alias("_k"), F.explode(F.concat(*map(words, columns))).alias("value"))


def labelling_functions(documents: DataFrame, sets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(value, _a, hits, n, precision): values of paths and metadata whose documents are of one area, as measured on ``sets`` (_k, _areas).

    precision is the lower end of the 90 % interval of the share of labelled
    documents with the value that have the area.
    """
    known = path_values(documents, key, columns).join(sets, "_k")
    n = known.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    hits = known.select("value", F.explode("_areas").alias("_a")).groupBy("value", "_a").agg(F.count(F.lit(1)).alias("hits"))
    z = 1.645
    share, size = F.col("hits") / F.col("n"), F.col("n")
    lower = (share + z * z / (2 * size) - z * F.sqrt(share * (1 - share) / size + z * z / (4 * size * size))) / (1 + z * z / size)
    return hits.join(n, "value").select("value", "_a", "hits", "n", lower.alias("precision"))


def weak_labels(documents: DataFrame, sets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(_k, _areas) of documents without a label that a precise labelling function gives one."""
    good = labelling_functions(documents, sets, key, columns).where(F.col("precision") >= PRECISE).select("value", "_a")
    given = path_values(documents, key, columns).join(broadcast_if_small(durable(good)), "value")
    return given.join(sets, "_k", "left_anti").groupBy("_k").agg(F.collect_set("_a").alias("_areas"))


def fit_areas(documents: DataFrame, labels: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", paths: tuple[str, ...] = ("file_name", "source"), most: int = LABELLED) -> dict | None:
    """The trained model as a dict of fixed size, or None without usable labels.

    labels: (key, area), blanks around areas and letter case aside; unknown
    areas, nulls and labels of missing or null texts are ignored. paths: the
    columns that labelling functions read; those that are missing are left out.
    Of labelled documents, by people or by functions, those whose key's hash
    falls into a fraction are used, about ``most`` of them at most. The fits of
    the folds and the final one are a task each.
    """
    clean = F.lower(F.trim(F.col("area")))
    index = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name.strip().lower(), i)])
    numbered = labels.select(F.col(f"`{key}`").alias("_k"), F.try_element_at(index, clean).alias("_a")).where("_k is not null and _a is not null")
    sets = durable(numbered.groupBy("_k").agg(F.collect_set("_a").alias("_areas")))  # one entry for an area at most
    columns = [c for c in paths if c in documents.columns]
    if columns:
        sets = durable(sets.unionByName(weak_labels(documents, sets, key, columns)))
    part = min(1.0, most / max(1, sets.count()))
    sets = sets.where(F.pmod(F.xxhash64("_k"), F.lit(1_000_000)) < int(1e6 * part))
    chosen = F.broadcast(sets)  # about ``most`` rows
    sample = documents.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).where("_t is not null").join(chosen, "_k").select("_k", "_t", "_areas")
    sample = durable(sample.groupBy("_k").agg(F.min("_t").alias("_t"), F.first("_areas").alias("_areas")))
    areas = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds: dict[int, list] = {}
        for b in batches:
            for fold, *row in zip(b["fold"], b["_k"], b["_t"], b["_areas"]):
                folds.setdefault(fold, []).append(row)
        for fold, rows in folds.items():
            rows.sort(key=lambda x: x[0])
            labelled = [set(map(int, x[2])) for x in rows]
            weights, bias, shares = fit_fold([x[1] for x in rows], labelled, areas, fold)
            final = fold == FOLDS
            truth = _truth(labelled, areas)[folds_of(len(rows)) == fold]
            yield pd.DataFrame({"fold": [fold], "weights": [weights.tobytes() if final else b""], "bias": [bias.tobytes()], "shares": [shares.astype(np.float32).tobytes()], "truth": [truth.astype(np.float32).tobytes()]})

    dealt = sample.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartitionByRange(FOLDS + 1, "fold")
    found = {r["fold"]: r for r in dealt.mapInPandas(run, "fold int, weights binary, bias binary, shares binary, truth binary").collect()}  # FOLDS + 1 rows, bounded by ``most``
    if not found:
        return None
    shares = np.concatenate([np.frombuffer(found[i]["shares"], np.float32).reshape(len(CUTS), -1, areas) for i in range(FOLDS)], axis=1)
    truth = np.concatenate([np.frombuffer(found[i]["truth"], np.float32).reshape(-1, areas) for i in range(FOLDS)])
    return {"names": names, "weights": bytes(found[FOLDS]["weights"]), "bias": bytes(found[FOLDS]["bias"])} | calibrated(shares, truth)


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """Writes a model to a folder, so that it needn't be fitted again."""
    row = (model["names"], bytearray(model["weights"]), bytearray(model["bias"]), model["cut"], [float(x) for x in model["least"]], model["f1"], model["held_out"])
    spark.createDataFrame([row], "names array<string>, weights binary, bias binary, cut double, least array<double>, f1 double, held_out long").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    row = spark.read.parquet(path).first().asDict()
    return row | {"weights": bytes(row["weights"]), "bias": bytes(row["bias"]), "least": np.array(row["least"])}


def areas_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", area: str = "area", model: dict | None = None) -> DataFrame:
    """(key, area, share): the subject areas of each document, areas as written in ``areas``.

    Null, empty and blank texts have none; a document may have several, or
    none. Without usable labels the result is empty. The list of areas is short
    and held by the driver, the model has a fixed size and is broadcast;
    documents are classified in one pass without a shuffle. The model is fitted
    unless one is given.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).where("_t is not null and _t <> ''")
    kind = slim.schema[0].dataType.simpleString()
    if model is None:
        names = sorted({r[0] for r in areas.select(F.col(f"`{area}`")).where(F.col(f"`{area}`").isNotNull()).distinct().collect()})
        model = fit_areas(documents, labels.withColumnRenamed(area, "area"), names, key, text) if names else None
    if model is None:
        return spark.createDataFrame([], f"`{key}` {kind}, {area} string, share double")
    names = model["names"]
    shared = spark.sparkContext.broadcast((model["weights"], model["bias"], model["cut"], np.asarray(model["least"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias, cut, least = shared.value
        bias = np.frombuffer(bias, np.float32)
        weights = np.frombuffer(weights, np.float32).reshape(-1, len(bias))
        maker = Features()
        for batch in batches:
            for s in range(0, len(batch), 200):
                part = batch.iloc[s : s + 200]
                lists = [sentences(x) for x in part["_t"]]
                parts = [x for y in lists for x in y]
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                features, where = _by_sentence(*maker.of(parts))
                p = _scores(weights, bias, features, where, len(parts))
                share = _shares(p, np.array([len(x) for x in parts], np.float64), owner, len(lists), cut)
                rows, cols = np.nonzero(share >= least)
                yield pd.DataFrame({"_k": part["_k"].to_numpy()[rows], "a": [names[c] for c in cols], "s": share[rows, cols]})

    return slim.mapInPandas(run, f"_k {kind}, a string, s double").select(F.col("_k").alias(key), F.col("a").alias(area), F.col("s").alias("share"))
