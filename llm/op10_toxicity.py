"""Toxicity by weak supervision.

Voters: lexicon voters (a word, or a stem at a word's start) and pattern voters (several hits, dense hits, hits early,
shouting, long clean texts). Lexicon voters are found on a bounded sample of labelled training
rows: words and stems whose documents are far more often toxic than the rest. A generative label
model then treats the labels as hidden: EM estimates each voter's rate of firing on toxic and on clean documents and the class
balance, pairwise correlations of the voters given the class are measured, and correlated voters share their weight. A linear classifier
(logistic regression) is trained on the posterior labels over votes and densities; one scale and shift, fitted on the training rows'
labels, put its best cut at 0.3. Every document's whole text is scored where it stands.

Sample bound: ``sample`` labelled training rows (the first by a hash of the id); everything else covers all rows.
Held-out rows (crc32 of the id modulo 4 is 2) never train. Null and empty texts fire no voter and get the score of that;
null ids have no label and are not held out; repeated rows are rows. Without any toxic training row a built-in lexicon votes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.workspace import materialise
from llm.common import documents, lean

SAMPLE, VOTERS, MIN_DOCS, CUT = 20_000, 256, 4, 0.3
STEMS = (4, 5, 6, 7, 8)
#: Built-in lexicon, for corpora without labels.
SEED_WORDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting"]
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = 6


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic, n): documents of this batch that hold each word (=w) or stem (^s)."""
    for b in batches:
        counts: dict[tuple[str, int], int] = {}
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            toks = {"=" + w for w in words if len(w) <= 40} | {"^" + w[:k] for w in words for k in STEMS if len(w) > k}
            for t in toks:
                counts[t, y] = counts.get((t, y), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["token", "toxic", "n"])


def find_lexicon(train: DataFrame, voters: int = VOTERS) -> list[str]:
    """Tokens that tell toxic from clean documents, best first; the counting is Spark's, the driver gets ``4 * voters`` rows."""
    total = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return ["=" + w for w in SEED_WORDS]
    c = train.select("text", "toxic").mapInArrow(_tokens, "token string, toxic int, n bigint").groupBy("token")
    c = c.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("q"))
    least = max(MIN_DOCS, pos // 200)  # a voter needs its share of the toxic rows
    lift = F.log(((F.col("p") + 0.5) / pos) / ((F.col("q") + 0.5) / neg))
    c = c.withColumn("lift", lift).filter((F.col("p") >= least) & (F.col("p") * neg >= F.col("q") * pos * 8))
    best = c.orderBy(F.desc(F.col("p") * F.col("lift")), "token").limit(4 * voters).collect()
    chosen: list[str] = []
    for r in best:
        # a stem that a chosen stem covers, with no better lift, adds nothing
        t = r["token"]
        if t[0] == "=" and any(("^" + t[1 : 1 + k]) in chosen for k in STEMS if len(t) - 1 > k):
            continue
        if t[0] == "^" and any(("^" + t[1 : 1 + k]) in chosen for k in STEMS if k < len(t) - 1):
            continue
        chosen.append(t)
        if len(chosen) >= voters:
            break
    return chosen or ["=" + w for w in SEED_WORDS]


class Voters:
    """Votes of a text: which lexicon tokens occur, and pattern votes; plus densities for the classifier."""

    def __init__(self, lexicon: list[str]) -> None:
        self.n = len(lexicon)
        self.auto = ahocorasick.Automaton()
        spots: dict[str, list[tuple[int, bool]]] = {}
        for i, t in enumerate(lexicon):
            spots.setdefault(t[1:], []).append((i, t[0] == "="))
        for s, v in spots.items():
            self.auto.add_word(s, (len(s), v))
        if spots:
            self.auto.make_automaton()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        low = text.lower()
        hits: list[int] = []
        early = False
        if self.n and low:
            size = len(low)
            for end, (length, kinds) in self.auto.iter(low):
                a, b = end - length + 1, end + 1
                if a and low[a - 1].isalpha():
                    continue
                inside = b < size and low[b].isalpha()
                for i, exact in kinds:
                    if exact != inside:
                        hits.append(i)
                        early |= a < 1000
        votes = np.zeros(self.n + PATTERNS, dtype=np.float32)
        if hits:
            votes[hits] = 1
        k, m = len(hits), len(set(hits))
        words = 1 + low.count(" ") + low.count("\n")
        dense = k / words
        votes[self.n :] = [k >= 2, m >= 2, dense >= 0.01, early, text.count("!!") * 20 > words, k == 0 and words >= 20]
        return votes, np.array([np.log1p(k), np.log1p(m), np.log1p(100 * dense), k > 0, np.log1p(words) / 10], dtype=np.float32)


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of toxic for each row, weights): EM over hidden labels, then correlated voters share their weight."""
    n, m = votes.shape
    start = np.clip(votes[:, :-1].sum(axis=1), 0, 1) * 0.8 + 0.02
    post = start
    for _ in range(rounds):
        a = (votes * post[:, None]).sum(0) + 0.5
        b = (votes * (1 - post)[:, None]).sum(0) + 0.5
        on1, on0 = a / (post.sum() + 1), b / ((1 - post).sum() + 1)
        # correlation given the class: residual products, averaged over the classes by their weight
        r = votes - post[:, None] * on1 - (1 - post)[:, None] * on0
        cov = r.T @ r / n
        sd = np.sqrt(np.diag(cov)) + 1e-9
        corr = np.clip(cov / sd / sd[:, None], 0, 1)
        share = 1 / np.maximum(1, np.where(corr > 0.1, corr, 0).sum(0))
        on1, on0 = np.clip(on1, 1e-4, 1 - 1e-4), np.clip(on0, 1e-4, 1 - 1e-4)
        llr = votes @ (share * np.log(on1 / on0)) + (1 - votes) @ (share * np.log((1 - on1) / (1 - on0)))
        new = 1 / (1 + np.exp(-np.clip(llr + np.log(prior / (1 - prior)), -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = new
    return post, share


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by damped Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of z with the best F1, half way to the next value."""
    o = np.argsort(-z, kind="stable")
    zs, ys = z[o], y[o]
    hit = np.cumsum(ys)
    f1 = 2 * hit / (np.arange(len(ys)) + 1 + max(1, ys.sum()))
    last = np.append(zs[1:] != zs[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((zs[k] + zs[k + 1]) / 2) if k + 1 < len(zs) else float(zs[k] - 1)


def _features(lexicon: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Voters(lexicon)
        for b in batches:
            rows = [np.concatenate(v(t or "")).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.binary())], names=["toxic", "x"])

    return lean(run)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows that are not held out: ids are chosen first, texts fetched for those alone."""
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(known, "doc_id").filter(~held_out(F.col("doc_id")))
    ids = materialise(ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    # the chosen ids have a fixed bound, so they may be broadcast
    return materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"))


def fit(train: DataFrame, voters: int = VOTERS) -> dict:
    """A model from (text, toxic) training rows."""
    lexicon = find_lexicon(train, voters)
    # packed rows: ``sample`` times the features of four bytes is all that the driver holds
    rows = train.mapInArrow(_features(lexicon), "toxic int, x binary").toArrow()
    y = rows["toxic"].to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), dtype=np.float32).reshape(len(y), -1) if len(y) else np.zeros((0, 1), np.float32)
    m = len(lexicon) + PATTERNS
    if not len(x) or not y.sum():
        w = np.zeros(m + 6)
        w[: len(lexicon)], w[-1] = 2.0, -2.0
        return {"lexicon": lexicon, "w": w.tolist(), "cut": 0.0, "scale": 1.0}
    post, share = label_model(x[:, :m], float(np.clip(y.mean(), 0.01, 0.5)))
    w = fit_linear(x, post)
    z = np.hstack([x, np.ones((len(x), 1))]) @ w
    return {"lexicon": lexicon, "w": w.tolist(), "cut": best_cut(z, y), "scale": 1.0}


def score_one(z: float, model: dict) -> float:
    """Logistic score that equals CUT at the model's cut."""
    return float(1 / (1 + np.exp(-np.clip((z - model["cut"]) * model["scale"] + np.log(CUT / (1 - CUT)), -30, 30))))


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = Voters(model["lexicon"]), np.array(model["w"])
        for b in batches:
            # the text to score is the last column but one, the score the last
            s = [score_one(float(np.concatenate(v(t or "")) @ w[:-1] + w[-1]), model) for t in b.column(b.num_columns - 2).to_pylist()]
            columns = [*b.columns[:-2], pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-2], b.schema.names[-1]])

    return lean(run)


def scored(docs: DataFrame, model: dict, text_col: str = "text", column: str = "toxicity") -> DataFrame:
    """The rows, with all their columns and the score as ``column``, a name that they must not have (see ``free_name``)."""
    if column in docs.columns:
        raise ValueError(f"the rows have a column {column} of their own")
    kept = docs.columns
    d = docs.select("*", F.col(text_col).alias("_scored_text"), F.lit(None).cast("double").alias(column))
    schema = docs.withColumn(column, F.lit(None).cast("double")).schema
    return d.mapInArrow(_score(model), schema).select(*kept, column)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    while name in docs.columns:
        name = "_" + name
    return name


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_tables(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    return fit(training_rows(docs, labels, sample))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    s = scored(d, fit_tables(d, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))


def crc_mod4(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
