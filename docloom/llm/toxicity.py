"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

Both are interpolated bigram models over lower-case words of letters. In a class,
p(w | v) is the discounted count of the pair over the count of v plus the mass that the
discounts leave times p(w); p(w) is the discounted count of w over that of all words plus the
mass left times the continuation probability of w, from the distinct pairs of both classes
that w ends. So each model sums to one, and rare expressions get the counts that both share.

The discount isn't one constant. Of a gram that both classes together hold in n texts a class
would hold e = n * (its share of texts) if classes did not differ; the discount is
e + z * sqrt(e), so only what exceeds chance stays with the class. With a constant discount
the small differences of thousands of ordinary words outweigh a few insults (figures in the
README). z is chosen, with a logistic curve over the difference of the two log-likelihoods
per word, on a quarter of the training texts by models of the others; the counts of the
final models are those of all training texts. Held-out rows have no part in any choice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, staged
from .exchange import word_hashes

#: Labelled texts of each class that the models and the curve are fitted on, at most. Smaller
#: sets are used whole; of larger ones those with the least digests of their text.
MAX_TRAIN = 4000
#: Bytes of a text that is trained on, at most; longer labelled texts are only scored.
MAX_BYTES = 400_000
#: Standard errors above chance that a count is discounted by; fit() takes the best of these.
Z = (3.0, 3.5, 4.0, 4.5, 5.0)
#: Continuation count of an unseen word.
UNSEEN = 0.5
#: Characters of texts that a task scores at once.
CHUNK = 1 << 20
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class ToxicModel:
    """The two models, column 0 ordinary and 1 toxic, and the curve over their difference.

    words are ascending hashes; rows of word and left beyond them are for unseen words and for
    a text's beginning. A pair is first * len(left) + second, by these places.
    """

    words: np.ndarray
    word: np.ndarray  # p(w) of each class
    left: np.ndarray  # the mass that a context's discounts leave
    pairs: np.ndarray
    pair: np.ndarray  # discounted counts of pairs over their contexts' counts
    slope: float
    offset: float

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """Mean natural log-likelihoods per word under the ordinary and the toxic model; 0 for texts without words.

        Whole texts of some CHUNK characters at a time, so that memory follows these or the longest text, not the batch.
        """
        if not texts:
            return np.zeros((0, 2))
        ends = np.cumsum([len(t) for t in texts]) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        return np.concatenate([self._some(texts[a:b]) for a, b in zip(cuts, cuts[1:])])

    def _some(self, texts: list[str]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        if not sizes.sum():
            return np.zeros((len(texts), 2))
        hashes = word_hashes([w for words in lists for w in words])
        at = np.searchsorted(self.words, hashes)
        known = np.append(self.words, np.uint64(0))[at] == hashes
        ids = np.where(known & (at < len(self.words)), at, len(self.words))
        prior = np.roll(ids, 1)
        prior[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(self.words) + 1
        p = self.left[prior] * self.word[ids]
        if len(self.pairs):
            keys = prior * len(self.left) + ids
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            found = self.pairs[place] == keys
            p[found] += self.pair[place[found]]
        text = np.repeat(np.arange(len(texts)), sizes)
        return np.stack([np.bincount(text, x, len(texts)) for x in np.log(p).T], 1) / np.maximum(sizes, 1)[:, None]


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, most: int = MAX_TRAIN) -> tuple[DataFrame, float]:
    """(text, toxic, half) of at most `most` distinct labelled texts of each class, and how the odds of toxic differ in all.

    Texts of half 3, a quarter, are for the curve. Digests are joined to labels, then the
    picked ids, at most 2 * most, to the texts.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter(usable & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_BYTES)).select("doc_id", F.xxhash64("text").alias("digest"))
    told = staged(rows.join(marked, "doc_id").groupBy("digest", "toxic").agg(F.min("doc_id").alias("doc_id")), "toxic-digests")
    sizes = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    least = [told.filter(F.col("toxic") == toxic).orderBy("digest").limit(most) for toxic in (0, 1)]
    picked = staged(least[0].unionByName(least[1]), "toxic-picked")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.col("digest") == F.xxhash64("text"))
    odds = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5) / ((min(most, sizes.get(1, 0)) + 0.5) / (min(most, sizes.get(0, 0)) + 0.5))
    return texts.dropDuplicates(["digest", "toxic"]).select("text", "toxic", F.pmod(F.col("digest"), F.lit(4)).cast("int").alias("half")), odds


def fit(training: DataFrame, odds: float, zs: tuple[float, ...] = Z) -> ToxicModel:
    """The model of a bounded table (text, toxic, half). Counting is Spark's; what returns is bounded by that table.

    A text counts once for each of its pairs, so that one that repeats itself is no more evidence.
    """
    rows = staged(training, "toxic-train")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    told = staged(rows.select("toxic", (F.col("half") == 3).alias("curve"), F.monotonically_increasing_id().alias("d"), split("text").alias("w")).filter(F.size("w") > 0), "toxic-words")
    sizes = {(r["curve"], r["toxic"]): r["count"] for r in told.groupBy("curve", "toxic").count().collect()}
    # Texts of each class, without and with the curve's quarter.
    texts = np.array([[sizes.get((False, k), 0) + more * sizes.get((True, k), 0) for k in (0, 1)] for more in (0, 1)], float)
    if not texts.all():  # one class only: nothing tells them apart
        return ToxicModel(np.zeros(0, np.uint64), np.ones((2, 2)), np.ones((2, 2)), np.zeros(0, np.int64), np.zeros((0, 2)), 0.0, math.log(odds))
    grams = told.select("toxic", "d", "curve", F.posexplode("w").alias("i", "word"), "w").select("toxic", "curve", "d", "word", F.when(F.col("i") > 0, F.get("w", F.col("i") - 1)).alias("prior"))
    grams = staged(grams.distinct(), "toxic-grams")
    columns = [f"c{more}{k}" for more in (0, 1) for k in (0, 1)]
    of = [F.count_if((F.col("toxic") == k) & (F.lit(bool(more)) | ~F.col("curve"))).alias(f"c{more}{k}") for more in (0, 1) for k in (0, 1)]
    shares = texts / texts.sum(1, keepdims=True)

    def excess(z: float) -> list[Column]:
        """What a discount would leave of each count."""
        expected = {(more, k): (F.col(f"c{more}0") + F.col(f"c{more}1")) * float(shares[more, k]) for more in (0, 1) for k in (0, 1)}
        return [F.col(f"c{more}{k}") - e - z * F.sqrt(e) for (more, k), e in expected.items()]

    words = staged(grams.groupBy("word").agg(F.count_distinct(F.coalesce("prior", F.lit(""))).alias("before")), "toxic-before")
    counts = grams.select("toxic", "curve", "d", "word").distinct().groupBy("word").agg(*of)
    words = words.join(counts, "word")
    pairs = staged(grams.groupBy(F.coalesce("prior", F.lit("")).alias("prior"), "word").agg(*of), "toxic-pairs")
    contexts = pairs.groupBy("prior").agg(*[F.sum(c).alias(c.replace("c", "n")) for c in columns])

    @F.pandas_udf("bigint")
    def hashed(words: pd.Series) -> pd.Series:
        return pd.Series(word_hashes([w.encode() for w in words]).view(np.int64))

    # The driver gets numbers: as strings the words would take most of its memory.
    vocabulary = staged(words.select(hashed("word").alias("hash"), "before", *columns), "toxic-unigrams").toArrow()
    # Pairs that the mildest discount leaves to a class; each z then takes its own part of them.
    telling = pairs.filter(F.greatest(*excess(min(zs))) > 0).join(contexts, "prior").toPandas()
    hashes = vocabulary.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    size = len(hashes) + 2
    before = np.concatenate((vocabulary.column("before").to_numpy()[order].astype(float), [0.0, 0.0])) + UNSEEN
    shared = before / before[:-1].sum()
    count = np.stack([vocabulary.column(c).to_numpy()[order].astype(float) for c in columns], 1).reshape(-1, 2, 2)
    del vocabulary
    place = lambda column: np.where(column == "", len(hashes) + 1, np.searchsorted(hashes, word_hashes([w.encode() for w in column])))
    prior, second = (place(telling[c].to_numpy(object)).astype(np.int64) for c in ("prior", "word"))
    keys = prior * size + second
    inorder = np.argsort(keys)
    pair_count, context_count = (telling[[c.replace("c", x) for c in columns]].to_numpy(float).reshape(-1, 2, 2) for x in "cn")

    def stays(count: np.ndarray, z: float, more: int) -> np.ndarray:
        expected = count.sum(1, keepdims=True) * shares[more]
        return np.maximum(count - expected - z * np.sqrt(expected), 0.0)

    def model(z: float, more: int) -> ToxicModel:
        own = stays(count[:, more], z, more) / count[:, more].sum(0)
        word = np.concatenate((own, np.zeros((2, 2)))) + (1 - own.sum(0)) * shared[:, None]
        pair = stays(pair_count[:, more], z, more) / np.maximum(context_count[:, more], 1)
        left = 1 - np.stack([np.bincount(prior, pair[:, k], size) for k in (0, 1)], 1)
        return ToxicModel(hashes, word, left, keys[inorder], pair[inorder], 1.0, 0.0)

    curve = rows.filter("half = 3").select("toxic", _differences(model(z, 0) for z in zs)("text").alias("x")).toPandas()
    y = curve["toxic"].to_numpy()
    x = np.array(curve["x"].tolist(), float).reshape(len(y), len(zs)).T
    curves = [_curve(each, y) for each in x]
    losses = [_log_loss(each, y, *curve) for each, curve in zip(x, curves)]
    best = int(np.argmin(losses))
    slope, offset = curves[best]
    return replace(model(zs[best], 1), slope=slope, offset=offset + math.log(odds))


def _log_loss(x: np.ndarray, y: np.ndarray, slope: float, offset: float) -> float:
    if not len(x):
        return 0.0
    p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + offset, -500, 500))), 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small penalty on the scaled slope."""
    if not len(x) or y.min() == y.max():
        return 100.0, -2.0
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a table of two columns, and which of them each row is: words of equal counts share theirs."""
    values, at = np.unique(np.ascontiguousarray(rows).view(np.complex128).ravel(), return_inverse=True)
    return values.view(float).reshape(-1, 2), at.astype(np.min_scalar_type(max(len(values), 1)))


def packed(model: ToxicModel) -> dict:
    """What unpacked makes the same model of, in about a fourth of its bytes; models of the same words share these."""
    return vars(model) | {"word": _coded(model.word), "left": _coded(model.left)}


def unpacked(told: dict) -> ToxicModel:
    return ToxicModel(**told | {k: told[k][0][told[k][1]] for k in ("word", "left")})


def _shipped(models: Iterable[ToxicModel]):
    """Models for tasks. One at a time is whole in the driver, whose memory would grow with their number otherwise."""
    return SparkSession.getActiveSession().sparkContext.broadcast([packed(m) for m in models])


def _differences(models: Iterable[ToxicModel]):
    """The differences that several models see, in one function, so that a task needs one Python worker for all."""
    shared = _shipped(models)

    @F.pandas_udf("array<double>")
    def differences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = [unpacked(m) for m in shared.value]
        for texts in batches:
            told = [m.log_likelihoods(texts.fillna("").tolist()) for m in models]
            yield pd.Series(list(np.stack([t[:, 1] - t[:, 0] for t in told], 1)))

    return differences


def log_likelihoods(model: ToxicModel):
    """A function of a text column: its log-likelihoods per word, `ordinary` and `toxic`; both 0 for null and empty texts."""
    shared = _shipped([model])

    @F.pandas_udf("ordinary double, toxic double")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = unpacked(shared.value[0])
        for texts in batches:
            yield pd.DataFrame(model.log_likelihoods(texts.fillna("").tolist()), columns=["ordinary", "toxic"])

    return both


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 3) == 1


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score, predicted, ordinary_ll and toxic_ll, the log-likelihoods per word; those of these names are replaced.

    Labels are learned from rows that are not held out; only the text enters a score, so
    equal texts get equal scores. Without labels of both classes every score is the share
    of toxic ones. Null and empty texts get the curve's value at no difference. Rows that
    repeat an id count as toxic if any of its labels is 1.
    """
    results = ("held_out", "score", "predicted", "ordinary_ll", "toxic_ll")
    model = fit(*training_rows(docs, labels, ~held_out(F.col("doc_id"))))
    rest = [c for c in docs.columns if c not in results]
    told = docs.select(*rest, held_out(F.col("doc_id")).alias("held_out"), log_likelihoods(model)("text").alias("ll"))
    at = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (F.col("ll.toxic") - F.col("ll.ordinary")) * model.slope + model.offset))
    scored = told.withColumn("score", 1 / (1 + F.exp(-at)))
    return scored.select(*rest, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("ll.ordinary").alias("ordinary_ll"), F.col("ll.toxic").alias("toxic_ll"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_documents(docs, labels).select("doc_id", "held_out", "score", "predicted", "ordinary_ll", "toxic_ll")
