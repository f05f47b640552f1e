"""Scoring of abusive, hateful and sexual content by a convolutional text classifier trained in numpy (problem 1).

A sentence is a row of words; a word's vector is the mean of hashed embeddings of the word and of its letter groups, so
that unseen spellings of a word stay near it. Filters of several widths run over the words, their greatest outputs are
pooled, and a softmax gives the chances of none, abuse, hate and sexual content. A text scores as its worst sentence.

The network learns from the labelled sample, from phrases made up from word lists (see ``abuse_text``), and from a bounded
sample of unlabelled texts, whose sentences count as clean unless a first network, or one of their words, makes that doubtful. Thresholds are set by language.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdsignal.llm.abuse_text import NAME, NUMBER, PAD, Reader, alike_words, foreign_phrases, known_words, loaded_words, made_up, plain, unmarked
from crowdsignal.sources.tables import bounded_sample, spread

CLASSES = ("none", "abuse", "hate", "sexual")
WIDTHS = (1, 2, 3, 4)
GAP = max(WIDTHS) - 1  # pads between sentences, so that no window sees two
BUCKETS, DIM, FILTERS = 1 << 15, 24, 24
#: Words of a training batch, pads counted: long sentences come in smaller batches.
BATCH_WORDS = 12_000

#: Bounds of what is fitted on: labelled rows, unlabelled rows, made-up phrases.
LABELLED_ROWS, UNLABELLED_ROWS, MADE_UP = 20_000, 4_000, 9_000
#: Each phrase of another language counts so many times.
FOREIGN_TIMES = 4
#: Longer texts aren't fitted on, so that the samples are bounded in bytes too. They are scored whole like all others.
MOST_SAMPLE_CHARS = 50_000
#: One of so many labelled rows and phrases of other languages isn't learnt from: the thresholds are set by the network's scores of these.
HELD_OUT = 5
#: A language's own threshold and that over all count alike where it has so many held-out rows, as do that over all and 0.5.
PRIOR_ROWS = 30
#: A sentence all of whose words occur in so many of the unlabelled texts counts as clean, unless a word is listed as loaded.
COMMON_SHARE = 0.002

#: Frequent words by which a language is told.
LANGUAGES = {
    "en": "the and of to is that it for you with this are was have not but they we what",
    "de": "der die das und ist nicht ich ein eine mit auf für den von zu sich wir bei auch",
    "es": "el los las una que por con para del se más pero como está muy no y lo su",
    "fr": "le les une des est pas que pour dans avec sur ce et je vous nous il au plus",
    "pt": "o os uma que não para com do da em por mais mas como está muito e são no",
    "ru": "и в не на я что с по но это как мы они за так от",
}
OTHER = "other"


def buckets(word: str) -> list[int]:
    """The rows of a word in the table: of itself, and of its groups of three and four letters."""
    if word == PAD:
        return []
    if word in (NUMBER, NAME):
        return [zlib.crc32(word.encode()) % BUCKETS]
    edged = f"<{word}>"
    groups = [edged[i : i + n] for n in (3, 4) for i in range(len(edged) - n + 1)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in (f"={word}", *groups)]


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the rows of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(rows[order], starts, axis=0)


def _batches(order: np.ndarray, lengths: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``order``, in which sentences of like length stand together, cut into batches in random order."""
    out, at = [], 0
    while at < len(order):
        n = most
        while n > 1 and n * int(lengths[order[at : at + n]].max()) > BATCH_WORDS:
            n = max(1, min(n // 2, BATCH_WORDS // int(lengths[order[at : at + n]].max())))
        out.append(order[at : at + n])
        at += n
    return [out[k] for k in rng.permutation(len(out))]


class Network:
    """The weights: a table of embeddings, a bank of filters per width, and the output layer."""

    def __init__(self, table: np.ndarray, banks: list[np.ndarray], biases: list[np.ndarray], out: np.ndarray, out_bias: np.ndarray):
        self.table, self.banks, self.biases, self.out, self.out_bias = table, banks, biases, out, out_bias
        self.known, self.tickers = KNOWN, None  # what texts are read with

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        banks = [normal(w, DIM, FILTERS, scale=(2 / (w * DIM)) ** 0.5) for w in WIDTHS]
        return cls(normal(BUCKETS, DIM, scale=0.5), banks, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), len(CLASSES), scale=0.1), np.zeros(len(CLASSES), np.float32))

    def vectors(self, words: Sequence[str]) -> np.ndarray:
        """The mean of the table's rows of each word, which isn't PAD."""
        rows = [buckets(w) for w in words]
        sizes = np.array([len(r) for r in rows])
        flat = self.table[np.array([i for r in rows for i in r])]
        return np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_network(sentences: Sequence[Sequence[str]], labels: Sequence[int], weights: Sequence[float], epochs: int = 10, batch: int = 192, rate: float = 0.006, dropout: float = 0.3, seed: int = 0) -> Network:
    """Fit a network to labelled sentences with Adam; words are left out at random and pooled outputs are dropped out."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    vocab = {PAD: 0}
    coded = [np.array([vocab.setdefault(w, len(vocab)) for w in s], np.int32) for s in sentences]
    rows = [buckets(w) or [0] for w in vocab]  # a pad's row has no share
    sizes = np.array([len(r) for r in rows])
    begins = np.cumsum(sizes) - sizes
    flat_rows = np.array([i for r in rows for i in r], np.int32)
    share = (1 / sizes).astype(np.float32)
    share[0] = 0
    y, weight = np.asarray(labels), np.asarray(weights, np.float32)
    params = [*net.banks, *net.biases, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    seen = np.full(BUCKETS, 1e-8, np.float32)
    step = 0
    lengths = np.array([len(s) for s in coded])
    for epoch in range(epochs):
        order = rng.permutation(len(coded))
        order = order[np.argsort(lengths[order] // 4, kind="stable")]  # sentences of like length together
        pace = rate * (1 - epoch / epochs)
        for chosen in _batches(order, lengths, batch, rng):
            n, longest = len(chosen), int(lengths[chosen].max())
            ids = np.zeros((n, longest + GAP), np.int32)
            for k, c in enumerate(chosen):
                ids[k, : lengths[c]] = coded[c]
            ids[(rng.random(ids.shape) < 0.05)] = 0
            used, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            own = sizes[used]
            ends = np.cumsum(own)
            owner = np.repeat(np.arange(len(used)), own)
            touched_rows = flat_rows[np.arange(ends[-1]) + np.repeat(begins[used] - ends + own, own)]
            keep = share[used][owner] * (rng.random(len(owner)) > 0.15)  # without some letter groups, or the word itself
            vectors = np.add.reduceat(net.table[touched_rows] * keep[:, None], ends - own, axis=0)
            x = vectors[inverse]
            inside = np.arange(longest)[None, :] < lengths[chosen][:, None]
            windows = [x[:, j : j + longest].reshape(-1, DIM) for j in range(max(WIDTHS))]
            pooled, peaks = [], []
            for w, bank, bias in zip(WIDTHS, net.banks, net.biases, strict=True):
                z = (sum(windows[j] @ bank[j] for j in range(w)) + bias).reshape(n, longest, FILTERS)
                z[~inside] = -1e9
                peaks.append(z.argmax(1))
                pooled.append(z.max(1))
            h = np.concatenate(pooled, 1)
            live = ((h > 0) * (rng.random(h.shape) > dropout) / (1 - dropout)).astype(np.float32)
            a = h * live
            g = _softmax(a @ net.out + net.out_bias)
            g[np.arange(n), y[chosen]] -= 1
            g *= (weight[chosen] / n)[:, None]
            grads_out, grads_out_bias = a.T @ g, g.sum(0)
            gh = (g @ net.out.T) * live
            gx = np.zeros_like(x)
            grads_banks, grads_biases = [], []
            row, column = np.repeat(np.arange(n), FILTERS), np.tile(np.arange(FILTERS), n)
            for k, (w, bank) in enumerate(zip(WIDTHS, net.banks, strict=True)):
                gz = gh[:, k * FILTERS : (k + 1) * FILTERS]
                spread = np.zeros((n, longest, FILTERS), np.float32)  # the gradient at the pooled place of each filter
                spread[row, peaks[k].ravel(), column] = gz.ravel()
                spread = spread.reshape(-1, FILTERS)
                gb = np.zeros_like(bank)
                for j in range(w):
                    gb[j] = windows[j].T @ spread
                    gx[:, j : j + longest] += (spread @ bank[j].T).reshape(n, longest, DIM)
                grads_banks.append(gb)
                grads_biases.append(gz.sum(0))
            step += 1
            for p, gradient, (m, v) in zip(params, [*grads_banks, *grads_biases, grads_out, grads_out_bias], moments, strict=True):
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient**2 - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            _, gu = _summed(inverse.ravel(), gx.reshape(-1, DIM))
            real = keep > 0
            touched, total = _summed(touched_rows[real], gu[owner[real]] * keep[real][:, None])
            seen[touched] += (total**2).mean(1)
            net.table[touched] -= 15 * pace * total / np.sqrt(seen[touched])[:, None]
    return net


class Scorer:
    """Scores texts in a worker. The output of every filter for every word is computed once and kept in a table."""

    def __init__(self, net: Network, most_words: int = 40_000):
        self.net, self.most = net, most_words
        self.reader = Reader(net.known, USUAL, tickers=net.tickers)
        self.flat = np.concatenate([bank[j] for bank in net.banks for j in range(len(bank))], 1)  # DIM x all
        self.languages = [frozenset(plain(unmarked(w)) for w in words.split()) for words in LANGUAGES.values()]
        self._forget()

    def _forget(self) -> None:
        self.ids = {PAD: 0}
        self.outputs = np.zeros((1024, self.flat.shape[1]), np.float32)
        self.votes = np.zeros((1024, len(LANGUAGES)), np.float32)

    def _learn(self, words: list[str]) -> None:
        need = len(self.ids) + len(words)
        if need > len(self.outputs):
            grow = max(need, 2 * len(self.outputs)) - len(self.outputs)
            self.outputs = np.vstack([self.outputs, np.zeros((grow, self.outputs.shape[1]), np.float32)])
            self.votes = np.vstack([self.votes, np.zeros((grow, len(LANGUAGES)), np.float32)])
        vectors = self.net.vectors(words) @ self.flat
        for w, v in zip(words, vectors, strict=True):
            k = self.ids[w] = len(self.ids)
            self.outputs[k] = v
            self.votes[k] = [w in known for known in self.languages]

    def sentence_scores(self, sentences: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The chances of the classes of each sentence, and the words of each language in it."""
        if len(self.ids) > self.most:
            self._forget()
        known = self.ids
        new = [w for w in dict.fromkeys(w for s in sentences for w in s) if w not in known]
        if new:
            self._learn(new)
        pads = [0] * GAP
        flat: list[int] = []
        starts = []
        for s in sentences:
            starts.append(len(flat))
            flat += [known[w] for w in s]
            flat += pads
        ids = np.array(flat + pads, np.int32)
        starts = np.array(starts)
        n = len(flat)
        out, column = [], 0
        for w, bias in zip(WIDTHS, self.net.biases, strict=True):
            z = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                z += self.outputs[:, column : column + FILTERS][ids[j : n + j]]
                column += FILTERS
            z[ids[:n] == 0] = -1e9
            out.append(np.maximum.reduceat(z, starts, axis=0) + bias)
        h = np.maximum(np.concatenate(out, 1), 0)
        return _softmax(h @ self.net.out + self.net.out_bias), np.add.reduceat(self.votes[ids[:n]], starts, axis=0)

    def score(self, texts: Sequence[Sequence[str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, given in parts: score, label and language (as numbers); 0, none and other without words."""
        sentences, owner = [], []
        for k, parts in enumerate(texts):
            for part in parts:
                found = self.reader.sentences(part)
                sentences += found
                owner += [k] * len(found)
        scores, labels, languages = np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.full(len(texts), len(LANGUAGES), np.int32)
        if sentences:
            chances, votes = self.sentence_scores(sentences)
            owner = np.array(owner)
            bad = 1 - chances[:, 0].astype(np.float64)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            which = owner[first]
            scores[which] = np.maximum.reduceat(bad, first)
            worst = np.lexsort((-bad, owner))[np.searchsorted(owner, which)]
            labels[which] = chances[worst, 1:].argmax(1) + 1
            total = np.add.reduceat(votes, first, axis=0)
            languages[which] = np.where(total.max(1) > (total.argmax(1) > 0), total.argmax(1), len(LANGUAGES))  # English by one word, others by two
        return scores, labels, languages


KNOWN = known_words()
USUAL = LANGUAGES["en"].split()


def _leaning(texts: Sequence[tuple[list[list[str]], int]]) -> dict[str, float]:
    """How much more often a word occurs in texts with than without a label, as a logarithm."""
    counts = (Counter(), Counter())
    for sentences, label in texts:
        counts[label > 0].update({w for s in sentences for w in s})
    sizes = [max(1, sum(bool(label) == k for _, label in texts)) for k in (0, 1)]
    return {w: float(np.log((counts[1][w] + 0.5) / sizes[1]) - np.log((counts[0][w] + 0.5) / sizes[0])) for w in counts[0] | counts[1]}


def _common(texts: Sequence[Sequence[Sequence[str]]], least: float) -> set[tuple[str, ...]]:
    """Sentences of which every word but names and numbers occurs in at least so many texts."""
    counts = Counter(w for sentences in texts for w in {w for s in sentences for w in s})
    usual = {w for w, n in counts.items() if n >= least} | {NAME, NUMBER}
    return {tuple(s) for sentences in texts for s in sentences if usual.issuperset(s)}


def _disguised(sentence: list[str], rng: random.Random) -> list[str]:
    """The sentence with some words misspelled, two words swapped or some left out."""
    out = list(sentence)
    for k, w in enumerate(out):
        if len(w) > 4 and rng.random() < 0.08:
            i = rng.randrange(1, len(w) - 1)
            out[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("aeiourst") + w[i:]])
    return out


def _varied(sentence: list[str], alike: dict[str, list[str]], rng: random.Random) -> list[str]:
    """The sentence with some of its words replaced by others of their kind, so that it's the turn of phrase that is learnt."""
    return [rng.choice(alike[w]) if w in alike and rng.random() < 0.6 else w for w in sentence]


def _known(labelled: Sequence[tuple[str, str]], tickers: Sequence[str] | None) -> set[str]:
    """The listed words and those that lean to a label in the labelled sample."""
    reader = Reader(KNOWN, USUAL, tickers=tickers)
    texts = [(s, CLASSES.index(label)) for text, label in labelled if label in CLASSES and (s := reader.sentences(text))]
    usual = {NAME, NUMBER, *USUAL}
    return KNOWN | {w for w, x in _leaning(texts).items() if x > 2 and w not in usual and w.isalpha()}


def fit(
    labelled: Sequence[tuple[str, str]], unlabelled: Sequence[str] = (), seed: int = 0, epochs: int = 8, tickers: Sequence[str] | None = None, foreign: Sequence[tuple[str, str]] | None = None, made: int = MADE_UP
) -> Network:
    """A network from (text, label) pairs, unlabelled texts, ``made`` made-up phrases and those of other languages (``foreign``, by default all).

    A labelled text's sentences are told apart first: its worst one by the leaning of its words carries the label, and after
    a first network, the worst one by that.
    """
    rng = random.Random(seed)
    known = _known(labelled, tickers)
    reader = Reader(known, USUAL, tickers=tickers)
    texts = [(s, CLASSES.index(label)) for text, label in labelled if label in CLASSES and (s := reader.sentences(text))]
    foreign = foreign_phrases() if foreign is None else foreign
    phrases = [(s, CLASSES.index(label)) for text, label in [*made_up(made, seed), *[x for x in foreign for _ in range(FOREIGN_TIMES)]] for s in reader.sentences(text)]
    plain_texts = [reader.sentences(t) for t in unlabelled]
    others = Counter(tuple(s) for sentences in plain_texts for s in sentences)
    common = _common(plain_texts, COMMON_SHARE * len(unlabelled))
    leaning = _leaning(texts)
    listed = {plain(w) for w in loaded_words()}
    alike = alike_words()
    loaded = listed | {w for w, x in leaning.items() if x > 2}
    top = lambda s: sum(sorted((leaning.get(w, 0.0) for w in s), reverse=True)[:3])
    net = None
    for round_ in range(2):
        if net is None:
            worst = [max(range(len(s)), key=lambda k, s=s: top(s[k])) for s, _ in texts]
            clean = []
        else:
            scorer = Scorer(net)
            worst = [int(np.argmax(1 - scorer.sentence_scores(s)[0][:, 0])) for s, _ in texts]
            pool = sorted(others)
            chances = np.concatenate([scorer.sentence_scores(pool[k : k + 500])[0][:, 0] for k in range(0, len(pool), 500)]) if pool else np.zeros(0)
            clean = [list(s) for s, p in zip(pool, chances, strict=True) if s in common and not listed.intersection(s) or p > (0.9 if loaded.intersection(s) else 0.1)]
        x, y, weight = [], [], []

        def add(sentence, label, amount, x=x, y=y, weight=weight, spoil=True):
            x.append(_disguised(sentence, rng) if spoil else sentence)
            y.append(label)
            weight.append(amount)

        around = clean or [p for (s, label), k in zip(texts, worst, strict=True) for i, p in enumerate(s) if not label or i != k]

        def among(sentence, around=around):  # sentence ends may be missing, so what stands around must not count
            before = rng.choice(around)[-12:] if around and rng.random() < 0.35 else []
            after = rng.choice(around)[:12] if around and rng.random() < 0.25 else []
            return [*before, *sentence, *after]

        for (s, label), k in zip(texts, worst, strict=True):
            if label:
                for times in range(4):
                    add(among(_varied(s[k], alike, rng) if times else s[k]), label, 1.0)
                for p in (p for i, p in enumerate(s) if i != k):
                    add(p, 0, 0.3)
            else:
                for p in s:
                    add(p, 0, 1.0, spoil=False)
                    add(among(_varied(p, alike, rng)), 0, 0.5)
                    add(_varied(p, alike, rng), 0, 0.5, spoil=False)
        for s, label in phrases:
            add(among(s) if label or rng.random() < 0.3 else s, label, 0.7, spoil=rng.random() < 0.5)
        for s in clean:
            add(s, 0, 0.7 * (1 + np.log(others[tuple(s)])), spoil=False)
            if len(s) > 3 and rng.random() < 0.3:  # odd punctuation leaves fragments
                at = rng.randrange(len(s) - 2)
                add(s[at : at + rng.randint(2, 3)], 0, 1.0, spoil=False)
        for w in sorted({w for s in common for w in s} - listed):
            add([w], 0, 2.0, spoil=False)
        net = train_network(x, y, weight, epochs=epochs if round_ else max(3, epochs // 2), seed=seed + round_)
        net.known, net.tickers = known, tickers
    return net


def language_thresholds(net: Network, labelled: Sequence[tuple[str, str]]) -> np.ndarray:
    """The threshold of each language, and of others last, from rows that the network hasn't learnt from.

    It is the one of best F1 over the language's rows, drawn towards the one over all rows: with n rows its own counts n, the common one
    PRIOR_ROWS; the common one is drawn towards 0.5 in the same way. A language without rows, or with clean ones only, takes the common one; 0.5 without any row."""
    scorer = Scorer(net)
    known = [(t, label) for t, label in labelled if label in CLASSES]
    if not known:
        return np.full(len(LANGUAGES) + 1, 0.5)
    scores, _, languages = scorer.score([[t] for t, _ in known])
    truth = np.array([label != "none" for _, label in known])

    def best(rows: np.ndarray) -> float:
        if not truth[rows].any():
            return 0.5
        grid = np.linspace(0.3, 0.9, 61)
        f1 = np.array([2 * (truth[rows] & (scores[rows] >= g)).sum() / max(1, truth[rows].sum() + (scores[rows] >= g).sum()) for g in grid])
        return float(np.median(grid[f1 >= f1.max() - 1e-9]))

    overall = (len(known) * best(np.ones(len(known), bool)) + PRIOR_ROWS * 0.5) / (len(known) + PRIOR_ROWS)
    out = []
    for k in range(len(LANGUAGES) + 1):
        rows = languages == k
        out.append((rows.sum() * best(rows) + PRIOR_ROWS * overall) / (rows.sum() + PRIOR_ROWS) if truth[rows].any() else overall)
    return np.array(out)


def fit_held_out(labelled: Sequence[tuple[str, str]], unlabelled: Sequence[str], seed: int = 0, tickers: Sequence[str] | None = None, made: int = MADE_UP) -> tuple[Network, np.ndarray]:
    """A network and the thresholds of its own scores, from the labelled rows and foreign phrases that it hasn't learnt from."""
    foreign = foreign_phrases()
    learnt = lambda rows: [x for k, x in enumerate(rows) if k % HELD_OUT]
    net = fit(learnt(labelled), unlabelled, seed, tickers=tickers, foreign=learnt(foreign) if made else (), made=made)
    return net, language_thresholds(net, [*labelled[::HELD_OUT], *foreign[::HELD_OUT]])


def score_content(df: DataFrame, id_: str, parts: Sequence[str], labels: DataFrame, keep: Sequence[str] = (), seed: int = 0, tickers: Sequence[str] | None = None) -> DataFrame:
    """(id, *keep, score, label, language, flagged) of every row of ``df``, from the text columns ``parts``.

    ``labels`` has the columns label_id, text and label (null labels are skipped). Score is the chance that the worst
    sentence is of a kind to be flagged, label its likeliest kind, ``none`` where the row isn't flagged. Null, empty and
    wordless texts score 0. ``tickers`` are the words in capitals that name stocks; without them all short ones are taken to. Texts are read
    whole; repeated rows are scored each (see ``per_submission``); an empty table gives an empty one. Scores have six places.

    The driver fits the network on bounded samples chosen by hash: about LABELLED_ROWS and UNLABELLED_ROWS. Its weights, some 3 MB
    whatever the data, are broadcast, and rows are scored where they are read.
    """
    spark = df.sparkSession
    if clashing := {id_, *keep} & {"score", "label", "language", "flagged"}:
        raise ValueError(f"rename the kept columns {sorted(clashing)}, which are names of the result")
    fits = F.length("text") <= MOST_SAMPLE_CHARS
    rows = bounded_sample(labels.where(F.col("label").isNotNull() & F.col("text").isNotNull() & fits), "label_id", LABELLED_ROWS).select("label_id", "text", "label").toPandas().sort_values("label_id")
    labelled = list(rows[["text", "label"]].itertuples(index=False, name=None))
    text: Column = F.concat_ws(" . ", *(F.col(c).cast("string") for c in parts))
    sample = bounded_sample(df, id_, UNLABELLED_ROWS, seed).select(df[id_].cast("string").alias("id"), text.alias("text")).where((F.col("text") != "") & fits).toPandas().sort_values(["id", "text"])["text"].tolist()
    shipped = spark.sparkContext.broadcast(fit_held_out(labelled, sample, seed, tickers))
    names = [*LANGUAGES, OTHER]
    width = len(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, thresholds = shipped.value
        scorer = Scorer(network)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = list(zip(*(part.column(k).to_pylist() for k in range(width)), strict=True))
                scores, kinds, languages = scorer.score(texts)
                scores = scores.round(6)
                flagged = scores >= thresholds[languages]
                shown = [CLASSES[k] if f else "none" for k, f in zip(kinds, flagged, strict=True)]
                columns = [*(part.column(k) for k in range(width, part.num_columns)), pa.array(scores), pa.array(shown), pa.array([names[k] for k in languages]), pa.array(flagged)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    kept = [id_, *keep]
    source = spread(df.select(*(df[c].cast("string").alias(f"t{k}") for k, c in enumerate(parts)), *(df[c].alias(f"k{k}") for k, c in enumerate(kept))))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "score double, label string, language string, flagged boolean"])
    return source.mapInArrow(work, schema)


def per_submission(scored: DataFrame, id_: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per id of what ``score_content`` gives: that of the highest score, with the greatest of each kept column.

    Deliveries of one id have the same texts, but their scores may differ in the last places, as they are summed in other batches. So rows
    are brought together by id alone; rows without an id count as one. Texts, which are long, aren't shuffled for it.
    """
    best = F.max(F.struct("score", "label", "language", "flagged")).alias("_best")
    return scored.groupBy(id_).agg(best, *(F.max(c).alias(c) for c in keep)).select(id_, *keep, "_best.*")
