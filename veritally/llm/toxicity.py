"""Toxicity by weak supervision.

*Voters.* Lexicon voters look for words or stems: a small fixed list, and stems mined from labelled training rows.
A voter fires where its hits are dense enough; the density is fitted. Pattern voters look at the shape of a text.

*Label model.* Whether a text is toxic is a hidden variable. Expectation maximisation over labelled and unlabelled rows,
with a human label as one more voter that may err, estimates how often each voter fires on either class. The
correlations of voters are parameters too: a tree joins each voter to the one that it has most to do with beyond the
class, and its firing is estimated for each class and each vote of that one, so that a voter that repeats another adds
nothing.

*Classifier.* A linear model of the voters' firing and density is trained on the posterior labels and scores texts.

Only a bounded sample of rows is fitted on; mined statistics cover the whole sample of labelled rows; every text is scored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut_lineage, filter_texts, held_out, map_arrow, map_texts, release, text_groups

#: Labelled rows that the model is fitted on, at most, and rows without a label, about; these weigh no more than those together.
TRAINING_ROWS, UNLABELLED_ROWS = 20_000, 10_000
#: Rounds of expectation maximisation, and in how many of the first the tree is made anew; rows that a rate is drawn to its class's by.
ROUNDS, TREE_ROUNDS, DRAWN = 30, 3, 4.0
#: Mined stems: lengths, toxic training rows that must have one, and how many become voters.
STEM_LENGTHS = (4, 5, 6, 7, 8)
STEM_SUPPORT = 4
CANDIDATES = 600
MINED_VOTERS = 96
DECISION = 0.7
MAX_WORDS = 250_000

#: Common insults.
LEXICON = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile", "garbage", "filth", "vermin"]
#: Shapes that abuse often takes.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W*){6,}"),
    "exclaiming": re.compile(r"!{2,}"),
    "addressing": re.compile(r"\byou(?: are|'re) (?:an? |such an? |so )", re.I),
    "masking": re.compile(r"\b[a-z]+[*@$]{2,}[a-z]*\b", re.I),
}

#: A voter's name: "=word" for a whole word, "^stem" for words that begin so, "~name" for a pattern.
Hits = dict[str, int]


def keys_of(word: bytes) -> list[str]:
    letters = word.decode().lower()
    return [f"={letters}"] + [f"^{letters[:n]}" for n in STEM_LENGTHS if len(letters) >= n]


class Voters:
    def __init__(self, names: list[str]):
        self.names = names
        self.number = {n: i for i, n in enumerate(names)}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def _word(self, word: bytes) -> tuple[int, ...]:
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        found = self.words[word] = tuple(self.number[k] for k in keys_of(word) if k in self.number)
        return found

    def hits(self, text: str | None) -> tuple[int, dict[int, int]]:
        """Words of a text, and hits by voter."""
        words = alnum_words(text)
        known = list(map(self.words.get, words))
        if None in known:
            known = [self._word(w) if k is None else k for w, k in zip(words, known, strict=True)]
        found: Counter = Counter()
        for k in filter(None, known):
            found.update(k)
        for name, pattern in PATTERNS.items():
            i = self.number.get(f"~{name}")
            if i is not None and (n := sum(1 for _ in pattern.finditer(text or ""))):
                found[i] = n
        return len(words), dict(found)


class Model:
    def __init__(self, names: list[str], densities: np.ndarray, weights: np.ndarray, bias: float):
        self.voters, self.densities, self.weights, self.bias = Voters(names), densities, weights, bias

    def features(self, words: int, hits: dict[int, int]) -> dict[int, float]:
        """By feature: a voter's firing, and behind all of those its density in units of the firing one, up to 4."""
        n, out = len(self.densities), {}
        for i, k in hits.items():
            density = k / max(words, 20)
            if density >= self.densities[i]:
                out[i] = 1.0
            out[n + i] = min(4.0, density / self.densities[i]) / 4
        return out

    def score(self, text: str | None) -> float:
        at = self.bias + sum(self.weights[i] * x for i, x in self.features(*self.voters.hits(text)).items())
        return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _entropy(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -(p * np.log(p) + (1 - p) * np.log(1 - p))


def _tree(votes: np.ndarray, classes: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Each voter's parent (-1: the first), and what it tells of the class by itself and beyond its parent.

    The parents make up the tree with the greatest sum of mutual information of pairs given the class.
    """
    m, n = votes.shape[1], sum(w.sum() for w in classes)
    shared = np.zeros((m, m))
    beyond = np.zeros((m, m))  # [i, j]: entropy of i given j and the class, later of i given j alone less that
    both_all = np.zeros((m, m))
    for w in classes:
        total = w.sum()
        both = (votes * w[:, None]).T @ votes
        both_all += both
        fires = np.diag(both) / max(total, 1e-9)
        given1 = both / np.maximum(np.diag(both), 1e-9)[None, :]
        given0 = (np.diag(both)[:, None] - both) / np.maximum(total - np.diag(both), 1e-9)[None, :]
        conditional = fires[None, :] * _entropy(given1) + (1 - fires)[None, :] * _entropy(given0)
        shared += total / n * (_entropy(fires)[:, None] - conditional)
        beyond -= total / n * conditional
    fires = np.diag(both_all) / n
    given1 = both_all / np.maximum(np.diag(both_all), 1e-9)[None, :]
    given0 = (np.diag(both_all)[:, None] - both_all) / np.maximum(n - np.diag(both_all), 1e-9)[None, :]
    beyond += fires[None, :] * _entropy(given1) + (1 - fires)[None, :] * _entropy(given0)
    alone = _entropy(fires) - sum(w.sum() / n * _entropy((votes * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9)) for w in classes)
    parents = [-1] * m
    if m:
        root = int(alone.argmax())
        best, by = shared[:, root].copy(), np.full(m, root)
        out = np.ones(m, bool)
        out[root] = False
        while out.any():
            i = int(np.where(out, best, -np.inf).argmax())
            parents[i], out[i] = int(by[i]), False
            nearer = out & (shared[:, i] > best)
            best[nearer], by[nearer] = shared[nearer, i], i
    told = np.array([alone[i] if p < 0 else beyond[i, p] for i, p in enumerate(parents)])
    return parents, alone, told


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict[str, object]]:
    """Posterior of the hidden class for each row, and the estimates. ``labels``: 0/1, or NaN for rows without one.

    Estimates begin with the labelled rows alone. ``discount``: the share of what a voter tells of the class that it
    tells beyond its parent.
    """
    n, m = votes.shape
    seen = ~np.isnan(labels)
    given = np.where(seen, labels, 0.5)
    known = int(seen.sum())
    weight = np.where(seen, 1.0, min(1.0, known / max(n - known, 1)) if known else 1.0)
    posterior = np.clip(given, 0.05, 0.95)
    parents: list[int] = []
    found: dict[str, object] = {}
    for k in range(rounds):
        own = weight * seen if k == 0 and known else weight
        classes = [own * (1 - posterior), own * posterior]
        sizes = [w.sum() for w in classes]
        share = (sizes[1] + 1) / (sum(sizes) + 2)
        if k < TREE_ROUNDS:
            parents, alone, told = _tree(votes, classes)
        at = np.full(n, np.log(share / (1 - share)))
        fires = []
        for c, w in enumerate(classes):
            both = (votes * w[:, None]).T @ votes
            rate = (np.diag(both) + 0.5) / (sizes[c] + 1)
            fires.append(rate)
            for i, p in enumerate(parents):
                if p < 0:
                    chance = np.full(n, rate[i])
                else:
                    rate1 = (both[i, p] + DRAWN * rate[i]) / (both[p, p] + DRAWN)
                    rate0 = (both[i, i] - both[i, p] + DRAWN * rate[i]) / (sizes[c] - both[p, p] + DRAWN)
                    chance = np.where(votes[:, p] > 0, rate1, rate0)
                chance = np.clip(chance, 1e-4, 1 - 1e-4)
                at += (1 if c else -1) * np.log(np.where(votes[:, i] > 0, chance, 1 - chance))
        right1 = ((posterior * given)[seen].sum() + 1) / (posterior[seen].sum() + 1.2)
        wrong0 = (((1 - posterior) * given)[seen].sum() + 0.2) / ((1 - posterior)[seen].sum() + 1.2)
        at += np.where(seen, np.where(given > 0.5, np.log(right1 / wrong0), np.log((1 - right1) / (1 - wrong0))), 0)
        posterior = _sigmoid(at)
        found = {"share": share, "fires1": fires[1], "fires0": fires[0], "parents": parents, "discount": np.clip(told / np.maximum(alone, 1e-12), 0, 1)}
    rest = sum(((votes - f) * w[:, None]).T @ (votes - f) for f, w in ((found["fires1"], weight * posterior), (found["fires0"], weight * (1 - posterior))))
    spread = np.sqrt(np.maximum(np.diag(rest), 1e-9))
    return posterior, found | {"correlation": rest / np.outer(spread, spread), "weight": weight}


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.2, rounds: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of weighted rows by Newton steps; the bias has no penalty."""
    rows = np.ones(len(x)) if weight is None else weight
    full = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(full.shape[1])
    held = np.full(full.shape[1], penalty)
    held[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(full @ weights)
        curve = full.T @ (full * (rows * np.maximum(p * (1 - p), 1e-6))[:, None]) + np.diag(held)
        step = np.linalg.solve(curve, full.T @ (rows * (target - p)) - held * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights[:-1], float(weights[-1])


def _firing_density(hits: np.ndarray, density: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The density from which a voter fires, so that it separates the classes best, and the log-odds it then has."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    best = (1e-4, -9.0, -1.0)
    for at in (1e-4, 1e-3, 2e-3, 4e-3, 8e-3):
        fired = (hits > 0) & (density >= at)
        a, b = (labels[fired].sum() + 0.5) / (ones + 1), ((1 - labels[fired]).sum() + 0.5) / (zeros + 1)
        gain = (a - b) if a > b else -1.0
        if gain > best[2] + 0.01:
            best = (at, float(np.log(a / b)), gain)
    return best[0], best[1]


def fit(names: list[str], words: np.ndarray, hits: np.ndarray, labels: np.ndarray) -> Model:
    """The model from rows of hits by voter, and labels: 0/1, or NaN without one."""
    length = np.maximum(words, 20).astype(np.float32)
    kept = []
    seen = ~np.isnan(labels)
    for i, name in enumerate(names):
        density = hits[:, i] / length  # of one voter at a time: all would take as much as the hits
        at, odds = _firing_density(hits[seen, i], density[seen], labels[seen])
        fired = (hits[:, i] > 0) & (density >= at)
        fixed = name[0] == "~" or name[1:] in LEXICON
        if fixed or odds > 1.5 and fired[seen].sum() >= STEM_SUPPORT:
            kept.append((-odds * np.sqrt(fired[seen].sum()) - 1e9 * fixed, i, at, fired))
    kept.sort(key=lambda x: (x[0], x[1]))
    chosen: list[tuple[int, float, np.ndarray]] = []
    for _, i, at, fired in kept:
        if len(chosen) >= MINED_VOTERS + len(LEXICON) + len(PATTERNS):
            break
        same = any((fired & f).sum() >= 0.95 * (fired | f).sum() > 0 for _, _, f in chosen)
        if not same:
            chosen.append((i, at, fired))
    own = np.array([i for i, _, _ in chosen], np.int64)
    densities = np.array([at for _, at, _ in chosen])
    votes = np.array([f for _, _, f in chosen], float).reshape(len(chosen), len(words)).T
    posterior, found = label_model(votes, labels)
    x = np.hstack([votes, np.where(hits[:, own] > 0, np.minimum(4.0, hits[:, own] / length[:, None] / densities) / 4, 0)])
    weights, bias = fit_linear(x, posterior, weight=found["weight"])
    return Model([names[i] for i in own], densities, weights, bias)


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, remainder: int = 1) -> Model:
    """Fit on labelled documents whose crc32 doesn't leave the remainder, at most ``training_rows`` by hash of the key, and on
    about as many as ``unlabelled_rows`` of those without a label.

    Rows with a null key or label are passed over; of several labels of a key the highest counts. Without labelled
    rows of both classes every text gets the score 0. Rows that repeat a key count no further than to twice these bounds.
    """
    usable = F.col(key).isNotNull() & ~held_out(F.col(key), modulus, remainder)
    labelled = labels.where(usable & F.col(label).isNotNull()).groupBy(F.col(key).alias("row_key")).agg(F.max(label).alias("label"))
    mixed = F.xxhash64(F.col("row_key").cast("string"))
    chosen = labelled.orderBy(mixed, "row_key").limit(training_rows)
    own = docs.where(usable).select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    some = F.pmod(F.xxhash64(F.col("row_key").cast("string"), F.lit("some")), F.lit(1 << 40)) < int((1 << 40) * unlabelled_rows / max(docs.count(), 1))
    others = own.where(some).join(labelled.where(some).select("row_key"), "row_key", "left_anti").select(F.lit(None).cast("int").alias("label"), "text")
    sample = own.join(F.broadcast(chosen), "row_key").select(F.col("label").cast("int").alias("label"), "text")
    both = cut_lineage(sample.unionByName(others))
    sample = both.where("label is not null")

    def mine(batches):
        rows: Counter = Counter()
        for values, texts in text_groups(batches):
            for value, text in zip(values, texts, strict=True):
                for k in {k for w in set(alnum_words(text)) for k in keys_of(w)}:
                    rows[k, value] += 1
        yield pa.RecordBatch.from_pydict({"stem": [k for k, _ in rows], "label": pa.array([v for _, v in rows], pa.int32()), "n": pa.array(rows.values(), pa.int64())})

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model([], np.empty(0), np.empty(0), -30.0)
    mined = map_arrow(sample, mine, "stem string, label int, n long").groupBy("stem").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("zeros"))
    a, b = F.col("ones") / sizes[1], F.col("zeros") / sizes[0]
    best = mined.where((F.col("ones") >= STEM_SUPPORT) & (a > 1.5 * b)).orderBy(((a - b) / F.sqrt(a + b)).desc(), "stem").limit(CANDIDATES)
    names = [f"={w}" for w in LEXICON] + [f"~{p}" for p in PATTERNS]
    names += [r.stem for r in best.collect() if r.stem not in set(names)]
    voters = sample.sparkSession.sparkContext.broadcast(names)

    def vote(batches):
        own = Voters(voters.value)
        for values, texts in text_groups(batches):
            found = [own.hits(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"label": pa.array(values, pa.int32()), "words": pa.array([n for n, _ in found], pa.int64()), "at": pa.array([list(h) for _, h in found], pa.list_(pa.int32())), "hits": pa.array([list(h.values()) for _, h in found], pa.list_(pa.int32()))})

    rows = map_arrow(both, vote, "label int, words long, at array<int>, hits array<int>").limit(2 * (training_rows + unlabelled_rows)).toArrow().combine_chunks()
    hits = hits_of(rows, len(names))
    words, given = rows["words"].to_numpy(), np.clip(rows["label"].cast(pa.float64()).to_numpy(), 0, 1)
    del rows
    model = fit(names, words, hits, given)
    del hits
    release()
    return model


def hits_of(rows: pa.Table, voters: int) -> np.ndarray:
    """[row, voter]: the hits of rows (at, hits), which lists of Python's numbers would take several times."""
    out = np.zeros((rows.num_rows, voters), np.float32)
    for row, at, hits in zip(range(rows.num_rows), rows["at"], rows["hits"], strict=True):
        out[row, at.values.to_numpy()] = hits.values.to_numpy()
    return out


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every whole text; null and empty texts get the score of a text without any hit."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(keys: list, texts: list[str | None]) -> dict[str, list]:
        scores = [shared.value.score(t) for t in texts]
        return {key: keys, "score": scores, "predicted": [int(s >= DECISION) for s in scores]}

    return map_texts(df, work, f"`{key}` {df.schema[key].dataType.simpleString()}, score double, predicted int", key, text)


def clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text isn't predicted to be toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return filter_texts(df, lambda texts: [shared.value.score(t) < DECISION for t in texts], text)
