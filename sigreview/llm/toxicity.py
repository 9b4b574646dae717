"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read the words of a clause one after the other: one names the word
(insult, threat, target, negation, reported speech, filler), one marks what follows a
negation, one what is reported, one what is aimed at somebody.  They are composed into one
machine, whose outputs carry the weight of the word that set them off.  A text's score
is a logistic function of the weights of its matched clauses by kind of match, so a word
counts by the clause it stands in.  Insults and their weights, and the five coefficients, are
learned from labelled rows; a short list serves where labels say nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin
from .pretokens import give_back

# Bounds of the labelled sample that the model is fitted on: rows with label 1 and 0.
SAMPLE = (2500, 5000)
# Learned entries of the lexicon at most, the heaviest first; this bounds what is sent to tasks.
LEXICON = 4000

SEED_INSULTS = "idiot moron scum trash stupid pathetic worthless loser clown disgusting".split()
THREATS = "kill hurt destroy beat attack smash burn shoot töten matar tuer".split()
TARGETS = "you your he she they them him her this these du ihr sie tu vous usted ustedes él ella ils elle".split()
NEGATIONS = "not no never nicht kein keine pas jamais nunca".split()
REPORTS = "said says say wrote called calls quoted told sagte sagt dit dijo".split()
FILLERS = "a an the is are was be such so very really ein eine der die das ist un une le la est el es".split()
SEED_WEIGHT = 3.0
THREAT_WEIGHT = 3.0

# Features that a task counts before it sends what it has.
COUNTED = 150_000

#: Kinds of matched clause parts, in the order of the coefficients.
KINDS = ("aimed", "plain", "negated", "reported", "threat")
#: Coefficients before any label is seen: bias, then one for each kind.
PRIOR = np.array([-3.5, 3.0, 3.0, 0.3, 0.6, 1.5])

_WORD = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    """The lexicon entries that can name a word: itself and its beginnings (with a *)."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


# --- transducers: {(state, symbol): (next state, output)}; other symbols keep state and symbol ---

#: n negation, r report, t target, f filler, I insult, H threat, o any other word.
NEGATE = {(0, "n"): (1, "n"), (1, "f"): (1, "f"), (1, "t"): (1, "t"), (1, "o"): (0, "o"),
          (1, "I"): (0, "-"), (1, "H"): (0, "-"), (1, "r"): (0, "r")}
REPORT = {(0, "r"): (1, "r"), (1, "I"): (1, "'"), (1, "H"): (1, "'")}
AIM = {(0, "t"): (1, "t"), (1, "I"): (1, "A"), (0, "H"): (2, "h"), (1, "H"): (1, "T"), (2, "t"): (1, "T")}
OUTPUT = {"A": "aimed", "I": "plain", "-": "negated", "'": "reported", "T": "threat"}


def compose(*machines: dict) -> dict:
    """One machine that feeds each machine's output to the next; states are tuples."""
    table, todo, seen = {}, [(0,) * len(machines)], set()
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        for symbol in "nrtfIHo":
            out, after = symbol, []
            for s, machine in zip(state, machines):
                s, out = machine.get((s, out), (s, out))
                after.append(s)
            table[state, symbol] = (tuple(after), out)
            todo.append(tuple(after))
    return table


GRAMMAR = compose(NEGATE, REPORT, AIM)


@dataclass
class Model:
    """Lexicon weights and the coefficients of the kinds of match."""

    lexicon: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, SEED_WEIGHT))
    coefficients: tuple = tuple(PRIOR)

    def __post_init__(self) -> None:
        self._named = {w: s for s, ws in (("n", NEGATIONS), ("r", REPORTS), ("t", TARGETS), ("f", FILLERS)) for w in ws}
        self._threats = set(THREATS)
        self._words = {w for w in self.lexicon if not w.endswith("*")} | self._threats
        self._begin = {k: {w[:-1] for w in self.lexicon if w.endswith("*") and len(w) == k + 1} for k in PREFIXES}

    def weight(self, word: str) -> float:
        return max((self.lexicon[f] for f in features(word) if f in self.lexicon), default=0.0)

    def matches(self, text: str) -> np.ndarray:
        """Summed weights by kind, damped: one strong clause counts more than a long text."""
        total = dict.fromkeys(KINDS, 0.0)
        low = text.lower()
        words = set(_WORD.findall(low))
        if not words.isdisjoint(self._words) or any(
                not b.isdisjoint({w[:k] for w in words}) for k, b in self._begin.items() if b):
            for clause in _CLAUSE.split(low):
                self._clause(clause, total)
        return np.log1p([total[k] for k in KINDS])

    def _clause(self, clause: str, total: dict[str, float]) -> None:
        tokens = _WORD.findall(clause)
        weights = [self.weight(w) for w in tokens]
        if not any(weights) and self._threats.isdisjoint(tokens):
            return
        state, threat = (0, 0, 0), 0.0
        for word, weight in zip(tokens, weights):
            symbol = "I" if weight else "H" if word in self._threats else self._named.get(word, "o")
            threat = THREAT_WEIGHT if symbol == "H" else threat
            state, out = GRAMMAR[state, symbol]
            if out in OUTPUT:
                total[OUTPUT[out]] += weight or threat

    def score(self, matched: np.ndarray) -> float:
        z = float(self.coefficients[0] + np.dot(self.coefficients[1:], matched))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each label a feature occurs."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def counted() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.record_batch([pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()),
                                pa.array([counts[0][w] for w in names], pa.int64())], ["feature", "ones", "zeros"])
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            own = set()
            for word in set(_WORD.findall(text.as_py().lower())):
                own.update(features(word))
            counts[toxic.as_py()].update(own)
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield counted()
                counts[0].clear()
                counts[1].clear()
    yield counted()
    counts[0].clear()
    counts[1].clear()
    give_back()


def training_rows(docs: DataFrame, labels: DataFrame, sample=SAMPLE) -> DataFrame:
    """Distinct texts with their label: at most ``sample`` rows of each label, those with the least hash
    of the id.  Rows without id or label are left out; an id labelled twice counts as 1 if either does."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.expr("CAST(toxic > 0 AS INT)")).alias("_toxic"))
    known = known.where("pmod(crc32(CAST(_id AS STRING)), 5) != 0")
    picked = None
    for label, most in ((1, sample[0]), (0, sample[1])):
        part = known.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    joined = texts.join(F.broadcast(picked), "_id")  # at most sum(sample) ids
    return joined.groupBy(F.xxhash64("_text").alias("h")).agg(
        F.max_by(F.struct("_text", "_toxic"), F.struct("_toxic", "_id")).alias("x")).select("x._text", "x._toxic")


def fit(rows: DataFrame) -> Model:
    """Learn a model from rows (_text, _toxic).  With labels of one kind only, or none, the
    short list and the prior coefficients stay."""
    rows = pin(rows)
    n = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones or not zeros:
        return Model()
    counted = rows.mapInArrow(_counter, "feature string, ones long, zeros long").groupBy("feature").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    weight = F.expr(f"ln((ones + 0.5D) / ({ones} + 1D)) - ln((zeros + 0.5D) / ({zeros} + 1D))")
    learned = counted.where("ones >= 2").withColumn("weight", weight)
    strong = learned.where("weight >= 2").orderBy(F.desc(F.col("ones") * F.col("weight")), "feature").limit(LEXICON).collect()
    common = {r["feature"]: r["weight"] for r in learned.where(F.col("feature").isin(SEED_INSULTS)).collect()}
    # A beginning that is nearly always one whole word is left to that word.
    whole: dict[str, int] = {}
    for r in strong:
        for begin in features(r["feature"])[1:]:
            whole[begin] = max(whole.get(begin, 0), 0 if r["feature"].endswith("*") else r["ones"])
    strong = [r for r in strong if whole.get(r["feature"], 0) < 0.8 * r["ones"]]
    entries = {r["feature"]: (k, r["weight"]) for k, r in enumerate(strong)}
    sure = {r["feature"] for r in strong if r["weight"] >= 4 and r["ones"] >= max(5, 0.03 * ones)}
    needed = _needed(rows, entries)
    lexicon = {w: common.get(w, SEED_WEIGHT) for w in SEED_INSULTS if common.get(w, SEED_WEIGHT) >= 1}
    lexicon |= {w: weight for w, (k, weight) in entries.items() if w in sure or k in needed}
    model = Model(lexicon)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.matches(t.as_py()) for t in batch.column(0)]).reshape(-1, len(KINDS))
            yield pa.record_batch([pa.array(x[:, k]) for k in range(len(KINDS))] + [batch.column(1)], [*KINDS, "toxic"])
    table = rows.mapInArrow(matched, ", ".join(f"{k} double" for k in KINDS) + ", toxic int").toArrow()  # at most sum(SAMPLE) rows
    x = np.column_stack([np.ones(table.num_rows), *[table.column(k).to_numpy() for k in KINDS]])
    return Model(lexicon, tuple(_logistic(x, table.column("toxic").to_numpy())))


def _needed(rows: DataFrame, entries: dict[str, tuple[int, float]], least: float = 2.2) -> set[int]:
    """Entries that explain labels which the others leave open: those with a positive weight in
    a logistic regression on presence with an L1 penalty, which ``least`` rows must outweigh.
    A word that only shares its texts with insults gets none."""
    names = {w: k for w, (k, _) in entries.items()}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({names[f] for w in set(_WORD.findall(t.lower())) for f in features(w) if f in names})
                     for t in (x.as_py() for x in batch.column(0))]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "toxic"])
    table = rows.mapInArrow(present, "found array<int>, toxic int").toArrow()  # at most sum(SAMPLE) rows
    found = table.column("found").to_pylist()
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.array([k for f in found for k in f], int)
    y = table.column("toxic").to_numpy()
    beta, ahead, bias, pace = np.zeros(len(names)), np.zeros(len(names)), -2.0, 1.0
    scale = np.maximum(1.0, 0.25 * np.bincount(col, np.bincount(row, minlength=len(y))[row], len(names)))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, ahead[col], len(y)), -30, 30)))
        slope = np.bincount(col, (y - p)[row], len(names))
        step = np.maximum(0.0, ahead + (slope - least) / scale)
        quicker = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, beta, pace = step + (pace - 1) / quicker * (step - beta), step, quicker
        bias += (y - p).sum() / max(1.0, 0.25 * len(y))
    return set(np.flatnonzero(beta > 0.05).tolist())


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton's method for logistic loss with a pull towards the prior coefficients."""
    beta, pull = PRIOR.copy(), np.diag([0.1, *[strength] * len(KINDS)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ (beta - PRIOR))
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_column(model: Model):
    """A function from a text column to its score, for ``docs.where(score(text) < 0.5)`` and the like."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(model.matches(t.as_py() or "")) for t in texts], pa.float64())
    return score


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, score (0 to 1) and one column for each kind of match.

    Whole texts are read; null counts as empty and gets the score of a text without a
    match.  Rows that repeat get the same score; an empty table gives no rows; other columns play no part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.matches(t.as_py() or "") for t in batch.column(1)]).reshape(-1, len(KINDS))
            scores = [model.score(row) for row in x]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())] + [pa.array(x[:, k]) for k in range(len(KINDS))],
                                  ["id", "score", *KINDS])
    out = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        run, "id long, score double, " + ", ".join(f"{k} double" for k in KINDS))
    return out.withColumnRenamed("id", id_col)
