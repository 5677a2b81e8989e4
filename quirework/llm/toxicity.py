"""Toxicity by a weighted finite-state pattern grammar.

Three machines are composed. The first maps a word to a class and a weight, through word beginnings and whole words:
insult, threat, target, negation, reporting. Its fixed part is a short list for each class; its learned part comes
from labelled training documents, as words and word beginnings whose documents are toxic far more often than
chance, with the lower bound of their log odds as weight. The second reads the classes of one clause and moves between
the states plain, negated and reported; an insult or a threat that it meets puts out its weight on a channel named by
the state and by whether the clause names a target. The third sums channels over clauses into a document's features, and a
logistic regression turns these into a score. Clauses are scored, never isolated words: the same word counts
differently when it is denied, quoted or aimed at someone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import batch, durable, join_few

# The word lists of the five classes. A closing * stands for any ending.
INSULTS = "idiot* moron* stupid* loser* scum* trash* pathetic worthless disgusting clown* imbecile* filth* vermin* garbage freak* coward* dumb* ugly".split()
THREATS = "kill* murder* hurt destroy* beat burn* shoot* stab* strangle* hang rape* attack* bomb*".split()
TARGETS = "you your yours yourself ya u he she they them him her this these du dich ihr euch tu toi vous te vosotros usted ustedes tú".split()
NEGATIONS = "not no never isn aren wasn don doesn didn won cannot nicht kein keine keinen nie pas jamais aucun aucune nunca jamás tampoco".split()
REPORTING = "said says say told tells claimed claims wrote writes called calls quoted reported alleged according sagte sagt schrieb dit disait écrit dijo dice escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT = range(5)
#: States of the clause machine.
PLAIN, NEGATED, REPORTED = range(3)
#: (state, class) -> state; what is missing leaves the state as it is.
MOVES = {(PLAIN, NEGATION): NEGATED, (PLAIN, REPORT): REPORTED, (NEGATED, NEGATION): PLAIN, (NEGATED, REPORT): REPORTED}
#: Output channels: insult and threat in each state, without and with a target in the clause; then clauses and the strongest clause;
#: words matched, different ones, the same up to MANY, and words of the text.
CHANNELS = 2 * 3 * 2
FEATURES = CHANNELS + 6
MANY = 4
LOGGED = [*range(CHANNELS + 1), CHANNELS + 2, CHANNELS + 3, CHANNELS + 5]
#: Weight of the words of the fixed lists before any training.
SEED_WEIGHT = 3.0

PREFIXES = range(3, 7)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
#: Labelled documents on which the regression is fitted at most. The lexicon has no cap, but one of more entries than this is an error.
MAX_FIT_ROWS = 20_000
LEXICON_LIMIT = 2_000_000
#: A beginning goes if one longer entry has this share of its toxic documents.
EXPLAINED = 0.9
#: A learned entry needs this lower bound of its log odds, at 1.64 standard errors.
LEAST_WEIGHT = 1.5
#: Words whose arcs a task keeps.
CACHED_WORDS = 200_000
#: Counts held by a training task before it passes them on.
HELD_COUNTS = 300_000


@dataclass
class Lexicon:
    """The word transducer: whole words and beginnings, each to (class, weight)."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    beginnings: dict[str, tuple[int, float]] = field(default_factory=dict)

    @classmethod
    def seeded(cls) -> Lexicon:
        out = cls()
        for kind, names in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING), (THREAT, THREATS), (INSULT, INSULTS)):
            for name in names:
                (out.beginnings if name[-1] == "*" else out.words)[name.rstrip("*")] = (kind, SEED_WEIGHT if kind in (INSULT, THREAT) else 0.0)
        return out

    def add(self, entry: str, weight: float) -> None:
        """A learned entry, a word closed by $ or a beginning; a listed threat stays one, all else is an insult."""
        table, name = (self.words, entry[:-1]) if entry[-1] == "$" else (self.beginnings, entry)
        old = table.get(name)
        if old is None or old[0] in (INSULT, THREAT):
            table[name] = (old[0] if old else INSULT, weight)

    def arc(self, word: str) -> tuple[int, float] | None:
        """The arc that a word takes: of its entry as a whole and those of its beginnings, the one of most weight."""
        best = self.words.get(word)
        if best is not None and best[0] in (TARGET, NEGATION, REPORT):
            return best
        for k in range(3, min(len(word), 12) + 1):
            got = self.beginnings.get(word[:k])
            if got is not None and (best is None or got[1] > best[1]):
                best = got
        return best


def clause_channels(arcs: list[tuple[int, float]], out: np.ndarray) -> float:
    """Runs the clause machine over the arcs of one clause, adds to the channels, and gives the weight put out."""
    aimed = any(a[0] == TARGET for a in arcs)
    state, total = PLAIN, 0.0
    for kind, weight in arcs:
        if kind in (INSULT, THREAT):
            out[(kind * 3 + state) * 2 + aimed] += weight
            total += weight
        else:
            state = MOVES.get((state, kind), state)
    return total


def features(text: str, lexicon: Lexicon, seen: dict[str, tuple[int, float] | None]) -> np.ndarray:
    """The features of a whole text; seen keeps the arcs of words met before."""
    out = np.zeros(FEATURES)
    tokens = TOKEN.findall(text.lower())
    missing = object()
    arcs = [seen.get(t, missing) for t in tokens]
    if missing in arcs:
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for t in set(tokens):
            if t not in seen:
                seen[t] = lexicon.arc(t)
        arcs = [seen[t] for t in tokens]
    loud = [k for k, a in enumerate(arcs) if a is not None and a[0] in (INSULT, THREAT)]
    done = -1
    for k in loud:
        if k <= done:
            continue
        start, done = k, k
        while start > 0 and tokens[start - 1] not in ".!?;:\n":
            start -= 1
        while done + 1 < len(tokens) and tokens[done + 1] not in ".!?;:\n":
            done += 1
        weight = clause_channels([a for a in arcs[start : done + 1] if a is not None], out)
        out[CHANNELS] += 1
        out[CHANNELS + 1] = max(out[CHANNELS + 1], weight)
    different = len({tokens[k] for k in loud})
    out[CHANNELS + 2 :] = len(loud), different, min(different, MANY), sum(t not in ".!?;:\n" for t in tokens)
    out[LOGGED] = np.log1p(out[LOGGED])
    return out


@dataclass
class Model:
    """A lexicon and the weights of the logistic regression, the last being the constant."""

    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def prior_model() -> Model:
    """What is used where there are no labels: the fixed lists, insults and threats at full weight, denied or reported ones at less."""
    w = np.zeros(FEATURES + 1)
    for kind in (INSULT, THREAT):
        for state, factor in ((PLAIN, 2.0), (NEGATED, 0.5), (REPORTED, 0.5)):
            w[(kind * 3 + state) * 2 : (kind * 3 + state) * 2 + 2] = factor, 1.5 * factor
    w[-1] = -2.5
    return Model(Lexicon.seeded(), w)


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.005, rounds: int = 100) -> np.ndarray:
    """Logistic regression by Newton's method with step halving, drawn towards the prior's weights."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, pull = prior.copy(), np.full(x1.shape[1], ridge * max(1.0, len(x) ** 0.5))
    pull[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (pull * (w - prior) ** 2).sum()

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -35, 35)))
        gradient = x1.T @ (p - y) + pull * (w - prior)
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while (new := loss(w - size * step)) > now - 1e-4 * size * (gradient @ step) and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - new < 1e-9 * (1 + abs(now)):
            break
        now = new
    return w


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def entry_counts(rows: DataFrame) -> DataFrame:
    """(entry, toxic, clean): documents of either label that hold a word or a word beginning; rows has text and toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            toxic, clean = (np.fromiter((h[n] for n in names), np.int64, len(names)) for h in (held[1], held[0]))
            got = batch(entry=names, toxic=toxic, clean=clean)
            held[0].clear(), held[1].clear()
            return got

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
                tally = held[1 if label else 0]
                tally.update(w + "$" for w in words)
                for k in reversed(PREFIXES):
                    words = {w[:k] for w in words}
                    tally.update(w for w in words if len(w) == k)
                if len(held[0]) + len(held[1]) > HELD_COUNTS:
                    yield out()
        yield out()

    return rows.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learned_entries(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(entry, weight) of the entries whose log odds of toxic to clean documents are surely high, without those that others make needless.

    A beginning goes if a longer entry alone accounts for its toxic documents (los for loser), and then an entry goes that has no
    more weight than a beginning of it that stays.
    """
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n_toxic - F.col("toxic") + 0.5)) - F.log(c / (n_clean - F.col("clean") + 0.5))
    error = F.sqrt(1 / t + 1 / c + 1 / (n_toxic - F.col("toxic") + 0.5) + 1 / (n_clean - F.col("clean") + 0.5))
    sure = durable(counts.where("toxic >= 3").select("entry", "toxic", (odds - 1.64 * error).alias("weight")).where(F.col("weight") >= LEAST_WEIGHT))
    longest = F.least(F.char_length("entry") - 1, F.lit(PREFIXES[-1]))  # of the proper beginnings of an entry; a word counts its closing $
    shorter = F.explode(F.sequence(F.lit(PREFIXES[0]), longest)).alias("k")
    beginnings = sure.where(longest >= PREFIXES[0]).select("entry", "toxic", "weight", shorter).withColumn("start", F.substring("entry", F.lit(1), F.col("k")))
    most = beginnings.groupBy(F.col("start").alias("_start")).agg(F.max("toxic").alias("most"))
    kept = durable(sure.join(most, F.col("entry") == F.col("_start"), "left").where(F.col("most").isNull() | (F.col("most") < EXPLAINED * F.col("toxic"))).select("entry", "weight"))
    covers = kept.select(F.col("entry").alias("_start"), F.col("weight").alias("_weight"))
    needless = beginnings.join(covers, (F.col("start") == F.col("_start")) & (F.col("weight") <= F.col("_weight"))).select("entry").distinct()
    return kept.join(needless, "entry", "left_anti")


def train(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """A model from the labelled documents that are not held out.

    Word statistics are counted over all of them on the executors. The driver gets the lexicon, whose size is checked, and
    the features of max_fit_rows labelled documents at most, those of lowest id hash; of documents that share an id, one of them. Ids with
    several labels count as toxic if any says so; null labels and null ids are left out. Without documents of both labels the fixed lists decide.
    """
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = durable(known.groupBy(known["doc_id"].cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return prior_model()
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # labels may be many: their documents are shuffled to them, at any size, and no others
    rows = join_few(texts, known.hint("merge"), "inner", ("doc_id",)).select("text", "toxic")
    learned = durable(learned_entries(entry_counts(rows), n_toxic, n_clean))
    if learned.count() > LEXICON_LIMIT:
        raise ValueError(f"the lexicon has over {LEXICON_LIMIT} entries; ask for more weight")
    lexicon = Lexicon.seeded()
    for r in sorted(learned.collect()):
        lexicon.add(r["entry"], r["weight"])
    sample = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows))  # so many rows at most: small enough to broadcast
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("text")).select("text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            x = [features(t, shared.value, seen).tolist() for t in b.column("text").to_pylist()]
            yield batch(x=pa.array(x, pa.list_(pa.float64())), toxic=b.column("toxic"))

    got = chosen.mapInArrow(measure, "x array<double>, toxic int").toPandas()
    prior = prior_model().weights
    if got["toxic"].nunique() < 2:
        return Model(lexicon, prior)
    return Model(lexicon, fit(np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(float), prior))


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from 0.5).

    Only the text is read. Null and empty texts get the score of a text without any matched clause. Rows with equal ids are
    scored one by one; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            x = np.array([features(t, shared.value.lexicon, seen) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield batch(doc_id=b.column("doc_id"), score=shared.value.scores(x))

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double").select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is under 0.5, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for texts in batches:
            x = np.array([features(t or "", shared.value.lexicon, seen) for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(shared.value.scores(x))

    return docs.where(score(docs["text"]) < 0.5)
