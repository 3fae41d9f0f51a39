"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, intent, head, link, waste, or other. Five
transducers read the symbols of a clause:

* insult: an insult word alone, or in a phrase of several words: a head (piece, bunch, waste) and a link (of, a, the) before
  an insult or a word that is one only there (waste of space, piece of garbage);
* threat: a threat word alone (weak), or after a word of intent (will, going, want) with up to INTENT words between (strong);
* target: whether a target is near;
* negation: whether one is still in force;
* reported speech: whether the clause reports it.

Their composition is one table over product states: for each symbol it says the next state and what all five give: nothing,
an insult or a threat, whether by a phrase, and the flags of the other three. So an event has one of CLASSES classes. The
score is a logistic function of the summed weights of the classes in all clauses of the whole text, and of the share of
the words that they are. Clauses end at punctuation and line ends.

The weights of words are learned: whole words and stems (a word's first STEM characters) whose share of toxic documents
in a bounded sample of labelled rows is clear. The sample holds SAMPLE rows of each label at most, none of them held out;
the share of toxic rows among all labelled ones that aren't held out sets the bias.
Seed lists give threats, targets, negations and verbs of reporting, and a few insults for corpora without labels.

Defined cases: a null or empty text has no clause and the score of the bias alone; null labels and labels without a
document teach nothing, and a document with several labels counts as toxic if one says so. A null key is not held out.
Repeated rows repeat their result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import MEMO_WORDS, logistic, sampled, sigmoid

SAMPLE = 2000
STEM = range(4, 9)
#: A stem or word is an insult if so many sampled toxic documents (at least LEAST_SHARE of them) hold it, and it is so much (in logarithm) more frequent
#: in a toxic document than in a clean one. The longest stem of a word counts.
LEAST_DOCS, LEAST_SHARE, LEAST_LOG_ODDS = 4, 0.006, 2.0
#: So many times does a document's word count when the lexicon is learned: one document that repeats a word proves little.
MOST_TIMES = 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT_WORD, HEAD, LINK, WASTE = range(10)
SYMBOLS = 10
SEEDS = {
    INSULT: "idiot moron scum stupid trash loser pathetic worthless idiota imbécil estúpido idiote crétin abruti dumm trottel depp abschaum",
    THREAT: "kill hurt destroy beat crush töten vernichten schlagen tuer détruire frapper matar destruir golpear",
    TARGET: "you your u he she they him her them du dich dir ihr euch sie tu toi te vous votre eux tú ti usted vosotros ellos",
    NEGATION: "not no never isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás",
    REPORT: "said says say called calls wrote quoted claims sagte sagt nannte schrieb dit dirent appelé écrit dijo dice llamó escribió",
    INTENT_WORD: "will gonna going shall want wants ought should werde wird werden soll vais va vas allons voy vamos quiero",
    HEAD: "piece bunch waste pack load stück haufen morceau bande tas pedazo montón",
    LINK: "of a an the von de du des d'une d'un",
    WASTE: "space garbage trash dirt air oxygen müll dreck platz ordure déchets basura mierda",
}
NEAR, IN_FORCE, INTENT = 4, 5, 3
CLASSES = 32  # phrase * 16 + threat * 8 + target * 4 + negated * 2 + reported
#: What transducers say of the symbol that they read.
IS_INSULT, IS_THREAT, AIMED, NEGATED, REPORTED, PHRASE = (1 << i for i in range(6))


def remember(symbol: int, steps: int, says: int):
    """A transducer (states, step, output) whose state counts down from ``steps`` after the symbol; while it is above 0, its
    output is ``says``."""
    return steps + 1, lambda state, s: steps if s == symbol else max(0, state - 1), lambda state, s: says if s == symbol or state > 1 else 0


def insults():
    """States: 0 outside, 1 after a head, 2 after a head and links."""

    def step(state: int, s: int) -> int:
        return 1 if s == HEAD else 2 if s == LINK and state else 0

    def output(state: int, s: int) -> int:
        if s == INSULT:
            return IS_INSULT | (PHRASE if state == 2 else 0)
        return IS_INSULT | PHRASE if s == WASTE and state == 2 else 0

    return 3, step, output


def threats():
    """The state counts down from INTENT after a word of intent."""
    return (
        INTENT + 1,
        lambda state, s: INTENT if s == INTENT_WORD else max(0, state - 1),
        lambda state, s: IS_THREAT | (PHRASE if state else 0) if s == THREAT else 0,
    )


def compose(*parts):
    """(next, out): tables over (product state, symbol) of transducers that read the same symbols; out: all that they say."""
    sizes = [n for n, _, _ in parts]
    total = math.prod(sizes)
    following, out = np.zeros((total, SYMBOLS), np.int32), np.zeros((total, SYMBOLS), np.int32)
    for state in range(total):
        own, rest = [], state
        for n in sizes:
            own.append(rest % n)
            rest //= n
        for s in range(SYMBOLS):
            k = 0
            for n, x, (_, step, _) in zip(reversed(sizes), reversed(own), reversed(parts), strict=True):
                k = k * n + step(x, s)
            following[state, s] = k
            for x, (_, _, say) in zip(own, parts, strict=True):
                out[state, s] |= say(x, s)
    return following, out


PARTS = (
    insults(),
    threats(),
    remember(TARGET, NEAR, AIMED),
    remember(NEGATION, IN_FORCE, NEGATED),
    (2, lambda state, s: int(state or s == REPORT), lambda state, s: REPORTED if state or s == REPORT else 0),
)
NEXT, SAID = (x.tolist() for x in compose(*PARTS))
#: Symbols of which an event may come.
EVENTS = bytes(2 * s + e for s in (INSULT, THREAT, WASTE) for e in (0, 1))
ENDS = re.compile(r"[.!?;:,\n]$")
STRIP = re.compile(r"^\W+|\W+$")


class Lexicon(dict):
    """Symbol, weight and whether the clause ends after it, of a raw token; remembered up to MEMO_WORDS."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.seeds = {w: k for k, text in SEEDS.items() for w in text.split()}
        self.weights: dict[str, float] = {}

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)

    def __missing__(self, token: str) -> int:
        """symbol * 2 + 1 if the token ends a clause."""
        if len(self) >= MEMO_WORDS:
            self.clear()
            self.weights.clear()
        word = STRIP.sub("", token).lower()
        weight = self.words.get(word) or next((w for n in reversed(STEM) if len(word) >= n and (w := self.stems.get(word[:n]))), None)
        symbol = INSULT if weight else self.seeds.get(word, OTHER)
        if symbol in (INSULT, THREAT):
            self.weights[token] = weight or 2.0
        code = self[token] = symbol * 2 + bool(ENDS.search(token))
        return code


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Logarithms of the summed weights of the classes of all matched clauses, and of their sum for each 100 words."""
    out, words = np.zeros(CLASSES), 0
    for line in (text or "").split("\n"):
        tokens = line.split()
        words += len(tokens)
        codes = bytes(map(lexicon.__getitem__, tokens))
        if not any(x in codes for x in EVENTS):
            continue
        state, pending = 0, []
        for token, code in zip(tokens, codes, strict=True):
            symbol = code >> 1
            said = SAID[state][symbol]
            state = NEXT[state][symbol]
            if said & (IS_INSULT | IS_THREAT):
                pending.append((said, lexicon.weights.get(token, 2.0)))
            elif symbol == TARGET:  # a target may follow what it is the target of
                pending = [(x | AIMED, w) for x, w in pending]
            if code & 1:
                _settle(pending, out)
                state, pending = 0, []
        _settle(pending, out)
    return np.log1p(np.append(out, 100 * (out @ PRIOR[:CLASSES]) / max(1, words)))


def _settle(pending: list, out: np.ndarray) -> None:
    for said, weight in pending:
        k = bool(said & PHRASE) * 16 + bool(said & IS_THREAT) * 8 + bool(said & AIMED) * 4 + bool(said & NEGATED) * 2 + bool(said & REPORTED)
        out[k] += weight


def prior() -> np.ndarray:
    """Weights without data: a target doubles, a negation or a report takes most away, a bare threat is weak, a phrase counts more."""
    w = np.zeros(CLASSES + 2)
    for k in range(CLASSES):
        base = (0.2 if not k & 4 else 0.8) if k & 8 else (0.5 if not k & 4 else 1.0)
        w[k] = base * (0.2 if k & 2 else 1) * (0.3 if k & 1 else 1) * (1.5 if k & 16 else 1)
    w[-2:] = 0.5, -2.0
    return w


PRIOR = prior()


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights

    def scores(self, texts: list, lexicon: Lexicon) -> np.ndarray:
        x = np.array([features(t, lexicon) for t in texts]).reshape(len(texts), CLASSES + 1)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def fit(rows: list[tuple[str, int]], odds_of_all: float | None = None) -> Model:
    """rows: (text, toxic), a sample that may hold one label more often than all labelled rows do: odds_of_all, theirs of
    toxic to clean, then correct the bias."""
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    times, docs = [Counter(), Counter()], Counter()
    for text, y in rows:
        own: Counter = Counter()
        for w, k in Counter(STRIP.sub("", w).lower() for w in (text or "").split()).items():
            k = min(k, MOST_TIMES)
            own[w] += k
            for m in STEM:
                if len(w) >= m:
                    own[(w[:m],)] += k
        times[y].update({w: min(k, 3 * MOST_TIMES) for w, k in own.items()})
        if y:
            docs.update(own.keys())
    odds = {
        w: o
        for w, d in docs.items()
        if d >= max(LEAST_DOCS, LEAST_SHARE * n[1])
        and (o := math.log((times[1][w] + 0.5) / (n[1] + 1)) - math.log((times[0][w] + 0.5) / (n[0] + 1))) >= LEAST_LOG_ODDS
    }
    stems = {w[0]: o for w, o in odds.items() if isinstance(w, tuple)}
    words = {w: o for w, o in odds.items() if isinstance(w, str)}
    lexicon = Lexicon(words, stems)
    if min(n) == 0:
        return Model(words, stems, prior())
    x = np.array([features(t, lexicon) for t, _ in rows])
    weights = logistic(x, np.array([y for _, y in rows], float), 0.5, prior())
    if odds_of_all:
        weights[-1] += math.log(odds_of_all) - math.log(n[1] / n[0])
    return Model(words, stems, weights)


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.max("y").alias("y"))
    rows = rows.where(~held_out("key")).withColumn("y", (F.col("y") > 0).cast("int"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    rows = sampled(rows, "y", "key", SAMPLE)  # bounded, so it may be broadcast
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(rows), "key")
    got = sorted((r["text"] or "", r["y"]) for r in texts.select("text", "y").limit(4 * SAMPLE).collect())
    return fit(got, n[1] / n[0] if len(n) == 2 else None)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the score of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        lexicon = Lexicon(model.words, model.stems)
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["key", "score"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
