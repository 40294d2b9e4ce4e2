"""Language identification with a linear-chain conditional random field over words.

Every word gets a language.  Its features are affixes, character n-grams and
membership in a lexicon per language, hashed into a table of weights; learned
transition weights join neighbouring words, and forward-backward gives each
word's marginals, so text that switches languages is labelled word by word.  A
document's language is the one with the largest mean marginal.

The weights are learned from a bounded sample of labelled documents: at most
``BLOCKS`` blocks of ``BLOCK`` words, from about ``DOCUMENTS`` documents a
language; of more than ``LABELS`` languages only the most frequent are learned.
A document's words carry its label; every second training sequence
is spliced from two documents, which is what the transitions learn switches
from.  Prediction reads every word of every text, in chains of ``CHAIN`` words.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import kept, text_of
from docintake.session import send_by_value

send_by_value(__name__)

DOCUMENTS = 600
BLOCKS = 9_000
BLOCK = 24
LABELS = 200
LEXICON = 20_000
CHAIN = 64
TABLE = 1 << 18
EPOCHS = 4
BATCH = 300
RATE = 0.25
WORDS_AT_ONCE = 200_000
TEXTS_AT_ONCE = 1_000
CACHED_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


# ---- features


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of all affixes and n-grams; the features of a word stand together per kind."""
    owners, features = [], []
    marked = ["^" + w + "$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    rest = sizes[owner] - place  # characters from here to the word's end
    rolled = codes.copy()
    prime = np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, 6):
        rolled = rolled[:-1] * prime + codes[n - 1 :] if len(rolled) > 1 else rolled[:0]
        length = len(rolled)
        inside = rest[:length] >= n
        kinds = [inside] if n <= 4 else []  # n-grams
        kinds.append(inside & (place[:length] == 0))  # prefix
        kinds.append(inside & (rest[:length] == n))  # suffix
        for kind, which in enumerate(kinds):
            mixed = (rolled[which] ^ np.uint64(kind * 0x51ED + n)) * prime
            owners.append(owner[:length][which])
            features.append((mixed >> np.uint64(64 - 18)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(features)


@dataclass
class Model:
    """Weights of features, lexicon words, transitions and starts, for the labels in order."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of every label for each word on its own."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            owner, feature = grams(some)
            for k in range(len(self.labels)):
                out[at : at + len(some), k] = np.bincount(owner, self.weights[feature, k], len(some))
        for n, w in enumerate(words):
            entry = self.lexicon.get(w)
            if entry is not None:
                out[n] += self.lexical[entry]
        return out


# ---- forward-backward


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals of chains padded to one length, and the expected transitions of all chains together."""
    chains, width, n = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move, first = np.exp(step), np.exp(start)
    inside = np.arange(width)[None, :] < lengths[:, None]
    e[~inside] = 1.0
    forward = np.empty_like(e)
    scale = np.empty((chains, width))
    a = first * e[:, 0]
    for t in range(width):
        if t:
            a = np.where(inside[:, t, None], (forward[:, t - 1] @ move) * e[:, t], forward[:, t - 1])
        scale[:, t] = a.sum(axis=1)
        forward[:, t] = a = a / scale[:, t, None]
    backward = np.ones_like(e)
    expected = np.zeros((n, n))
    for t in range(width - 2, -1, -1):
        ahead = e[:, t + 1] * backward[:, t + 1] / scale[:, t + 1, None]
        on = inside[:, t + 1]
        expected += move * (forward[on, t].T @ ahead[on])
        backward[:, t] = np.where(on[:, None], ahead @ move.T, 1.0)
    both = forward * backward
    return both / both.sum(axis=2, keepdims=True), expected


# ---- training


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, block of words) of the training sample; everything it collects is bounded by the parameters."""
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS).collect()
    if not counts:
        return []
    whole = 1 << 20
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(whole, -(-whole * DOCUMENTS // r.n)))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(whole))
    chosen = docs.where(place < share[F.col("lang")])
    cut = F.regexp_extract_all("text", F.lit(rf"(?:\p{{L}}+[^\p{{L}}]+){{1,{BLOCK}}}"), F.lit(0))
    parts = chosen.select("doc_id", "lang", F.posexplode(cut).alias("n", "block"))
    per_label = -(-BLOCKS // len(counts))
    order = F.xxhash64("doc_id", "n", F.lit("block"))
    # a block with very long gaps between its words gives its first words only
    parts = kept(parts.select("lang", F.substring("block", 1, 40 * BLOCK).alias("block"), order.alias("o")), "language-sample")
    found = []
    for r in counts:
        own = parts.where(F.col("lang") == r.lang)
        found += [(x.lang, x.block) for x in own.orderBy("o", "block").limit(per_label).collect()]
    return found


def train(pairs: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fit all weights together to the likelihood of the labelled chains."""
    labels = sorted({lang for lang, _ in pairs})
    if not labels:
        return None
    number = {lang: k for k, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    sequences = [(WORD.findall(text.lower())[:BLOCK], number[lang]) for lang, text in pairs]
    sequences = [s for s in sequences if s[0]]
    vocabulary: dict[str, int] = {}
    for words, _ in sequences:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    vocab = list(vocabulary)
    counts = np.zeros((len(vocab), len(labels)), np.int64)
    for words, k in sequences:
        for w in words:
            counts[vocabulary[w], k] += 1

    # lexicon: words seen often, and mostly in one language
    total = counts.sum(axis=1)
    sure = np.flatnonzero((total >= 3) & (counts.max(axis=1) >= 0.8 * total))
    sure = sure[np.argsort(-total[sure], kind="stable")][:LEXICON]
    lexicon = {vocab[i]: n for n, i in enumerate(sure)}
    entry = np.full(len(vocab), -1)
    entry[sure] = np.arange(len(sure))

    n = len(labels)
    model = Model(labels, np.zeros((TABLE, n), np.float32), lexicon, np.zeros((len(sure), n), np.float32), np.zeros((n, n)), np.zeros(n))
    squares = [np.full_like(x, 1e-4, dtype=np.float64) for x in (model.weights, model.lexical, model.step, model.start)]

    if vocab:
        owner, feature = grams(vocab)
        by_word = np.argsort(owner, kind="stable")
        feature = feature[by_word]
        bounds = np.searchsorted(owner[by_word], np.arange(len(vocab) + 1))
    for _ in range(EPOCHS if vocab else 0):
        order = rng.permutation(len(sequences))
        chains = []
        for x, y in zip(order[::2], np.r_[order[1::2], order[:1]], strict=False):
            (u, p), (v, q) = sequences[x], sequences[y]
            chains.append(([vocabulary[w] for w in u + v], [p] * len(u) + [q] * len(v)))
            chains.append(([vocabulary[w] for w in u], [p] * len(u)))
            chains.append(([vocabulary[w] for w in v], [q] * len(v)))
        order = rng.permutation(len(chains))
        for at in range(0, len(chains), BATCH):
            learn([chains[i] for i in order[at : at + BATCH]], model, squares, entry, feature, bounds)
    return model


def learn(chains, model: Model, squares, entry, feature, bounds) -> None:
    """One step of gradient ascent with a rate per weight."""
    n = len(model.labels)
    lengths = np.array([len(w) for w, _ in chains])
    width = lengths.max()
    word = np.zeros((len(chains), width), np.int64)
    label = np.zeros((len(chains), width), np.int64)
    for i, (w, y) in enumerate(chains):
        word[i, : len(w)], label[i, : len(y)] = w, y
    inside = np.arange(width)[None, :] < lengths[:, None]
    used, back = np.unique(word[inside], return_inverse=True)
    sizes = bounds[used + 1] - bounds[used]
    spot = np.repeat(np.arange(len(used)), sizes)
    feats = feature[np.repeat(bounds[used], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    own = np.stack([np.bincount(spot, model.weights[feats, k], len(used)) for k in range(n)], axis=1)
    known = entry[used] >= 0
    own[known] += model.lexical[entry[used][known]]
    scores = np.zeros((len(chains), width, n))
    scores[inside] = own[back]
    gamma, expected = marginals(scores, lengths, model.start, model.step)

    wanted = np.eye(n)[label]
    error = wanted - gamma
    per_word = np.stack([np.bincount(back, error[inside][:, k], len(used)) for k in range(n)], axis=1)
    gradient = np.stack([np.bincount(feats, per_word[spot, k], TABLE) for k in range(n)], axis=1)
    pairs = inside[:, 1:]
    seen = np.zeros((n, n))
    np.add.at(seen, (label[:, :-1][pairs], label[:, 1:][pairs]), 1)
    lexical = np.zeros(model.lexical.shape)
    lexical[entry[used][known]] = per_word[known]
    steps = (gradient, lexical, seen - expected, error[:, 0].sum(axis=0))
    for weights, g, square in zip((model.weights, model.lexical, model.step, model.start), steps, squares, strict=True):
        g = g / len(chains)
        square += g * g
        weights += RATE * g / np.sqrt(square)


# ---- prediction


class Labeller:
    """Marginals of the words of texts, with the scores of words seen before kept."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.labels)), np.float32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > CACHED_WORDS:
            self.number, self.scores = {}, self.scores[:0]
        new = list({w for words in texts for w in words}.difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
        return [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in texts]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text an array (words, labels); chains of ``CHAIN`` words run through each text."""
        numbers = self.numbers(texts)
        pieces = [x[at : at + CHAIN] for x in numbers for at in range(0, len(x), CHAIN)]
        out: list[np.ndarray] = []
        for at in range(0, len(pieces), WORDS_AT_ONCE // CHAIN):
            some = pieces[at : at + WORDS_AT_ONCE // CHAIN]
            lengths = np.array([len(p) for p in some])
            padded = np.zeros((len(some), CHAIN), np.int64)
            inside = np.arange(CHAIN)[None, :] < lengths[:, None]
            padded[inside] = np.concatenate(some)
            gamma, _ = marginals(self.scores[padded].astype(np.float64), lengths, self.model.start, self.model.step)
            out.append(gamma[inside])
        flat = np.concatenate(out) if out else np.zeros((0, len(self.model.labels)))
        return np.split(flat, np.cumsum([len(x) for x in numbers])[:-1]) if numbers else []


def labeller_udf(model: Model | None, docs: DataFrame, least: float = 0.5):
    """text -> (lang_pred, score, switches, clear); ``und`` without letters or without anything learned.

    Clear is a text with a word that has a marginal of at least ``least``, or,
    without anything learned, one with letters.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, switches long, clear boolean")
    def predict(batches: pd.Series) -> pd.DataFrame:
        rows = []
        labeller = Labeller(sent.value) if sent.value else None
        for texts in (batches[at : at + TEXTS_AT_ONCE] for at in range(0, len(batches), TEXTS_AT_ONCE)):
            words = [WORD.findall(t.lower()) for t in texts]
            if labeller is None:
                rows += [("und", 0.0, 0, any(c.isalpha() for w in found for c in w)) for found in words]
                continue
            for gamma, found in zip(labeller.marginals(words), words, strict=True):
                if not any(c.isalpha() for w in found for c in w):
                    rows.append(("und", 0.0, 0, False))
                    continue
                mean = gamma.mean(axis=0)
                best = int(mean.argmax())
                named = gamma.argmax(axis=1)
                rows.append((labeller.model.labels[best], min(1.0, float(mean[best])), int((named[1:] != named[:-1]).sum()), bool(gamma.max() >= least)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "switches", "clear"])

    return predict


def language_spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Runs of words of one language in a text as (start, end, label) in code points."""
    found = list(WORD.finditer(text))
    if not found:
        return []
    named = Labeller(model).marginals([[m[0].lower() for m in found]])[0].argmax(axis=1)
    cuts = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
    ends = np.r_[cuts[1:], len(found)]
    return [(found[a].start(), found[b - 1].end(), model.labels[named[a]]) for a, b in zip(cuts, ends, strict=True)]


def learned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model of a table's labelled documents, those held out excepted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    may = (F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull()
    return train(sample(rows.where(may)))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, switches.

    ``und`` with score 0 for a null text, one without letters, and for every
    text if no document is labelled.  ``switches`` counts neighbouring words
    of different languages.  Repeated rows give repeated results, an empty
    table an empty one.  Documents without an id are labelled, not learned.
    """
    predict = labeller_udf(learned(docs, doc_id, text, lang), docs)
    found = docs.select(F.col(doc_id).alias("doc_id"), predict(text_of(text)).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.switches")


def with_language(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns kept, with evidence for a learned language.

    A text stays if any of its words has a marginal of at least ``least``, in
    however many languages it is written.  Those without letters go; if no
    document is labelled, only those.
    """
    predict = labeller_udf(learned(docs, doc_id, text, lang), docs, least)
    found = docs.withColumn("__found", predict(text_of(text)))
    return found.where("__found.clear").select(*docs.columns)
