"""Text decoded with the wrong encoding: found, and restored where that can be done (problem 8).

A document is cut into segments, about a sentence each, and segments with characters outside ASCII are classified by a
multinomial model over hashed bigrams of their bytes. Its classes are the encoding chains below and clean text. It is
trained on all segments of the documents themselves and on these segments garbled by each chain. The predicted
chain is inverted, which must decode strictly, and the result is classified again, as garbling may have happened more often.
Encodings whose bytes are all of ASCII are told by their marks instead.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdsignal.session import staged
from crowdsignal.sources.tables import spread

#: Fixed values: (encoding the text was written in, encoding it was read in), innermost step first.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("utf-8", "cp1252"),),
    (("utf-8", "latin-1"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "mac-roman"),),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "koi8-r"),),
    (("utf-8", "gbk"),),
    (("cp1252", "mac-roman"),),
    (("cp1252", "cp437"),),
    (("cp1252", "cp850"),),
    (("cp1252", "cp1250"),),
    (("cp1252", "cp1251"),),
    (("mac-roman", "cp1252"),),
    (("cp1251", "cp1252"),),
    (("cp1251", "koi8-r"),),
    (("cp1251", "mac-roman"),),
    (("koi8-r", "cp1251"),),
    (("koi8-r", "cp1252"),),
    (("cp866", "cp1251"),),
    (("gbk", "cp1252"),),
    (("big5", "cp1252"),),
    (("cp1252", "utf-8"),),
    (("cp1251", "utf-8"),),
    (("gbk", "utf-8"),),
)

CLEAN = len(CHAINS)

BUCKETS = 1 << 14

#: Encodings in which all bytes are of ASCII, and what other text than ASCII looks like when they are read as that.
SEVEN_BIT = {
    "utf-7": re.compile(r"\+[A-Za-z0-9+/]{3,}-?"),
    "hz": re.compile(r"~\{[\x21-\x7e]{2,}?~\}"),
    "iso2022_jp": re.compile(r"\x1b\$[@B][\x21-\x7e]+(?:\x1b\([BJ])?"),
    "iso2022_kr": re.compile(r"\x0e[\x21-\x7e]+\x0f"),
}
#: What a text must hold to be read at all: a character outside ASCII, or a mark of these encodings.
READ = r"[^\x00-\x7f]|\+[A-Za-z0-9+/]{3}|~\{|\x1b\$|\x0e"
_MARKED = re.compile("|".join(p.pattern for p in SEVEN_BIT.values()))

_RUNS = re.compile(r"[^\x00-\x7f]+")
_CUT = re.compile(r"[.!?。！？\n]\s*")
#: Longer stretches without a sentence end are cut here, so that one garbled part among much clean text still shows.
_MOST_CHARS = 400
#: Where they may be cut: no character that was garbled into several, and no pair of bytes of GBK or Big5, reaches across.
_SAFE = re.compile(r"(?<=[\x00-\x1f!-?])|(?<=[\x00-\x7f])(?=[\x00-\x7f])")


def _encode(text: str, encoding: str) -> bytes:
    """Strict, but the bytes that the Windows code pages leave undefined stand for the control characters they pass as."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            raise
        return codecs.charmap_encode(text, "strict", _code_page(encoding)[1])[0]


def _decode(data: bytes, encoding: str) -> str:
    return codecs.charmap_decode(data, "strict", _code_page(encoding)[0])[0] if encoding.startswith("cp125") else data.decode(encoding)


@cache
def _code_page(encoding: str) -> tuple[str, dict[int, int]]:
    """The characters of all bytes of a Windows code page, and the bytes of these and of the control characters."""
    characters = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))
    return characters, {b: b for b in range(0x80, 0xA0)} | {ord(c): b for b, c in enumerate(characters)}


@lru_cache(1 << 15)
def _undo(run: str, written: str, read: str) -> str | None:
    """A run as it was before text written in one encoding was read in another; None where it doesn't decode."""
    for form in (run, run.replace(" ", "\xa0"), run.rstrip(" ")) if written == "utf-8" else (run,):
        try:
            return _decode(_encode(form, read), written) + (" " if len(form) < len(run) else "")
        except UnicodeError:
            continue
    return None

#: How often a chain is taken to occur against clean text, in the first model and in the second.
GARBLED_SHARES = (0.3, 0.1)


def garble(text: str, chain: Sequence[tuple[str, str]]) -> str | None:
    """The text as it reads after the chain; None where a step can't be done or nothing changes.

    Single-byte text read as UTF-8 loses what doesn't decode, which then reads U+FFFD.
    """
    out = text
    try:
        for written, read in chain:
            data = _encode(out, written)
            out = data.decode("utf-8", "replace") if read == "utf-8" else _decode(data, read)
    except UnicodeError:
        return None
    return out if out != text else None


def ungarble(text: str, chain: Sequence[tuple[str, str]]) -> tuple[str, int] | None:
    """The text with the chain undone, each step decoded strictly, and how many runs wouldn't; None where none would.

    Runs outside ASCII are undone one by one, so that a typing error in one doesn't lose the others; a space that
    stands for a no-break space is tried as one. Where second bytes may be ASCII, the whole text is tried first.
    """
    out, failed = text, 0
    for written, read in reversed(chain):
        if read == "utf-8":
            return None

        def undo(run: str, written=written, read=read) -> str | None:
            return (_undo if len(run) < 100 else _undo.__wrapped__)(run, written, read)  # most runs are short and come again and again

        done = undo(out) if written in ("gbk", "big5") else None
        if done is None:
            pattern = r"[^\x00-\x7f]+(?: (?![^\x00-\x7f])|(?: ?[^\x00-\x7f]+))*" if written == "utf-8" else _RUNS
            gone, kept = 0, 0

            def each(m: re.Match, undo=undo) -> str:
                nonlocal gone, kept
                whole = undo(m[0])
                if whole is not None or " " not in m[0]:
                    gone, kept = gone + (whole is not None), kept + (whole is None)
                    return m[0] if whole is None else whole
                text, *rest = re.split("( )", m[0])  # what was garbled may end at a blank, or a blank be its last character
                result = ""
                for gap, after in [*zip(rest[::2], rest[1::2], strict=True), ("", "")]:
                    part = undo(text) if text else ""
                    if part is None and gap and (part := undo(text + "\xa0")) is not None:
                        gap = ""
                    gone, kept = gone + (part is not None and text != ""), kept + (part is None)
                    result += (text if part is None else part) + gap
                    text = after
                return result

            done = re.sub(pattern, each, out)
            if not gone:
                return None
            failed += kept
        out = done
    return (out, failed) if out != text else None


def segments(text: str) -> list[str]:
    """The text cut after sentence ends and line breaks, and every so many characters where no garbled character is cut in two;
    joined they give the text. A run outside ASCII stays whole, however long."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.end() > at:
            out.append(text[at : m.end()])
            at = m.end()
    out.append(text[at:])
    return [piece for s in out for piece in (_pieces(s) if len(s) > _MOST_CHARS else [s])]


def _pieces(line: str) -> list[str]:
    out, at, last = [], 0, 0
    for m in _SAFE.finditer(line):
        if m.end() - at > _MOST_CHARS and last > at:
            out.append(line[at:last])
            at = last
        last = m.end()
    if len(line) - at > _MOST_CHARS and at < last < len(line):
        out.append(line[at:last])
        at = last
    return [*out, line[at:]]


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed bigrams of the bytes of all texts, one text after the other, and their number in each.

    Of a bigram at least one byte is outside ASCII; each counts once in a text.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(data), np.uint8)
    owner = np.repeat(np.arange(len(data), dtype=np.int64), [len(d) for d in data])
    at = np.flatnonzero((b[:-1] | b[1:] > 127) & (owner[:-1] == owner[1:]))
    pairs = np.sort(owner[at] << 16 | b[at].astype(np.int64) << 8 | b[at + 1])
    found = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    hashed = (found & 0xFFFF).astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - 14)
    return hashed.astype(np.int32), np.bincount(found >> 16, minlength=len(data))


class ChainModel:
    """A softmax over hashed byte bigrams; the weights are BUCKETS rows of one number per class.

    A segment whose chance to be garbled, over all chains, exceeds ``sure`` is garbled even if no chain undoes it.
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray, sure: float = 0.99, known: frozenset[str] = frozenset()):
        self.weights, self.bias, self.sure = weights, bias, sure
        self.known = known  # the characters outside ASCII of clean segments

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Probabilities of the classes, a row per text; each text must have a character outside ASCII.

        Texts of the same bigrams, as most are, are computed once.
        """
        first, row = {}, np.empty(len(texts), np.int64)
        for k, key in enumerate(_keys(texts)):
            row[k] = first.setdefault(key, len(first))
        feats = np.frombuffer(b"".join(first), np.uint16)
        sizes = np.fromiter(map(len, first), np.int64, len(first)) // 2
        z = np.add.reduceat(self.weights[feats], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None] + self.bias
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return (e / e.sum(1, keepdims=True))[row]


def _keys(texts: Sequence[str]) -> list[bytes]:
    """The hashed bigrams of each text, two bytes each: equal for texts that no model here tells apart."""
    feats, sizes = features(texts)
    data, ends = feats.astype(np.uint16).tobytes(), np.cumsum(sizes) * 2
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(sizes) else []


class Form(NamedTuple):
    """Segments of the same bigrams: their bigrams, the first of them in order, and how many there are."""

    key: bytes
    segment: str
    n: float


def forms(texts: Sequence[str | None]) -> list[Form]:
    """The forms of the segments outside ASCII of all texts."""
    parts = [s for t in texts if t and not t.isascii() for s in segments(t) if not s.isascii()]
    found: dict[bytes, tuple[str, int]] = {}
    for s, key in zip(parts, _keys(parts), strict=True):
        least, n = found.get(key, (s, 0))
        found[key] = (min(least, s), n + 1)
    return [Form(key, *x) for key, x in found.items()]


def garbled_by(segment: str) -> list[tuple[int, str]]:
    """(chain, what it makes of the segment) of each chain that makes other text than ASCII of it."""
    return [(k, g) for k, chain in enumerate(CHAINS) if (g := garble(segment, chain)) is not None and not g.isascii()]


_STRICT = [c for c in CHAINS if len(c) == 1 and c[0][0] == "utf-8" and c[0][1] not in ("gbk", "latin-1")]


#: A Latin letter beside one of another alphabet.
_MIXED = re.compile(r"[A-Za-z][\u0370-\u1dff]|[\u0370-\u1dff][A-Za-z]")


def _mixes(segment: str, undone: str) -> bool:
    """Whether words mix alphabets only after a chain was undone, as where capitals of AÇÕES happen to decode."""
    return len(_MIXED.findall(undone)) > len(_MIXED.findall(segment))


def brought(segment: str) -> list[str] | None:
    """Of each chain over UTF-8 that undoes some runs of a segment, the characters that this brings; None if one undoes every run, or it holds U+FFFD."""
    undone = [u for c in _STRICT if (u := ungarble(segment, c)) is not None]
    if "\ufffd" in segment or any(u[1] == 0 for u in undone):
        return None
    return ["".join(sorted({c for c in u[0] if c > "\x7f"} - set(segment))) for u in undone if len(u[0]) < len(segment) and not _mixes(segment, u[0])]


def garbled_in_part(parts: Sequence[str], known: frozenset[str]) -> bool:
    """Whether a chain that undoes some runs of a segment brings only characters of segments that no chain undoes in part."""
    return any(known.issuperset(p) for p in parts)


class State(NamedTuple):
    """Where the descent is: weights, the sum of squared steps of each bucket, the bias."""

    weights: np.ndarray
    seen: np.ndarray
    bias: np.ndarray


def _start() -> State:
    return State(np.zeros((BUCKETS, CLEAN + 1), np.float32), np.full((BUCKETS, 1), 1e-6, np.float32), np.zeros(CLEAN + 1, np.float32))


def _typical(n_forms: int, occurrences: int, n_garbled: int, garbled_occurrences: int, share: float) -> float:
    """The mean amount of all examples of a model: clean forms, and each as every chain garbles it."""
    return (occurrences + share * garbled_occurrences) / (n_forms + n_garbled)


def descend(clean: Sequence[Form], share: float, typical: float, state: State, last: bool, rng: np.random.Generator, rate: float = 0.5, batch: int = 256) -> tuple[State, np.ndarray]:
    """Stochastic gradient descent with adaptive steps from a state on; an example counts as often as it occurs. One of more than MOST_WEIGHT
    times the average is drawn several times in an epoch instead of in one large step.

    Examples are the clean forms and each as every chain garbles it, which counts ``share`` times. In the last round, weights and bias
    returned are the mean of those at the end of each epoch, so that the last batches don't decide doubtful segments.
    Also returned is how often each bucket occurs, and last the weight of all examples.
    """
    made = [(k, g, f.n * share) for f in clean for k, g in garbled_by(f.segment)]
    more, more_sizes = features([g for _, g, _ in made]) if made else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    feats = np.r_[np.frombuffer(b"".join(f.key for f in clean), np.uint16).astype(np.int32), more]
    all_sizes = np.r_[np.array([len(f.key) // 2 for f in clean], np.int64), more_sizes]
    y = np.array([CLEAN] * len(clean) + [k for k, *_ in made])
    weight = np.array([*(f.n for f in clean), *(n for *_, n in made)], np.float64) / typical
    copies = np.maximum(1, np.ceil(weight / MOST_WEIGHT)).astype(np.int64)
    drawn, each = np.repeat(np.arange(len(y)), copies), (weight / copies).astype(np.float32)
    ends = np.cumsum(all_sizes)
    w, seen, bias = (x.copy() for x in state)
    ends_of = []
    for _ in range(EPOCHS):
        order = rng.permutation(drawn)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = all_sizes[rows]
            to = np.cumsum(sizes)
            flat = feats[np.arange(to[-1]) + np.repeat(ends[rows] - to, sizes)]
            owner = np.repeat(np.arange(len(rows)), sizes)
            scale = (1 / np.sqrt(sizes)).astype(np.float32)[:, None]
            z = np.add.reduceat(w[flat], to - sizes, axis=0) * scale + bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= each[rows][:, None]
            bias -= rate * 0.1 * g.mean(0)
            turn = np.argsort(flat.astype(np.uint16), kind="stable")
            first = np.flatnonzero(np.r_[True, flat[turn][1:] != flat[turn][:-1]])
            used = flat[turn][first]
            step = np.add.reduceat((g * scale)[owner[turn]], first, axis=0)
            seen[used] += (step**2).mean(1, keepdims=True)
            w[used] -= rate * step / np.sqrt(seen[used])
        ends_of.append((w.copy(), bias.copy()) if last else None)
    if last:
        w, bias = (np.mean(x, axis=0) for x in zip(*ends_of, strict=True))
    mass = np.bincount(feats, np.repeat(weight, all_sizes), BUCKETS)
    return State(w, seen, bias), np.r_[mass, weight.sum()]


#: Rounds of a fit, after each of which the states of all blocks are averaged, and epochs within a block in each round.
ROUNDS, EPOCHS = 4, 3
#: The weight of one step of an example, where the average is 1.
MOST_WEIGHT = 30
#: Blocks, by a hash of the form, have about so many bigrams, some 2,000 forms; a task holds one block at a time.
BLOCK_FEATURES = 1 << 15
#: States are averaged in whole numbers of this, so that the order of blocks and their place in tasks can't change the average.
_UNIT = 1 << 16


def _part(state: State, mass: np.ndarray) -> np.ndarray:
    """What a block adds to the average: a row for each bucket and one for the bias; its mass, the occurrences of the bucket, is the last column."""
    m = np.ceil(mass * 16).astype(np.int64)[:, None]
    values = np.c_[np.r_[state.weights, state.bias[None]], np.r_[state.seen, np.zeros((1, 1), np.float32)]]
    return np.c_[np.rint(values.astype(np.float64) * _UNIT).astype(np.int64) * m, m]


def _averaged(state: State, rows: np.ndarray, sums: np.ndarray) -> State:
    """The state after a round, from the sums over all blocks of the given rows; buckets that occur nowhere stay."""
    out = np.c_[np.r_[state.weights, state.bias[None]], np.r_[state.seen, np.zeros((1, 1), np.float32)]]
    out[rows] = sums[:, :-1] / _UNIT / sums[:, -1:]
    return State(out[:-1, :-1], np.maximum(out[:-1, -1:], np.float32(1e-6)), out[-1, :-1])


def _unlike(clean: Sequence[Form], model: ChainModel) -> list[Form]:
    """The forms that a first model doesn't find garbled."""
    return [f for f, (_, n, _) in zip(clean, restore([f.segment for f in clean], model), strict=True) if not n]


#: What stands for clean text where there is none.
_ANY = [Form(_keys([s])[0], s, 1) for s in ("’", "é")]


def train(texts: Sequence[str], seed: int = 0) -> ChainModel:
    """A model from documents, which may be garbled in part themselves.

    Segments of which a chain over UTF-8 undoes runs into characters of other segments don't count as clean, nor do those with U+FFFD.
    A segment counts as often as its bigrams occur. So a first model finds the segments that other chains garbled, which are
    rarer than what it makes by garbling the clean form of the same words, and those that it would find garbled are dropped before the
    second. A segment that it merely doubts, and that nothing undoes, stays.

    All texts at once in this process, as one block; ``trained`` is the same for a table.
    """
    found = sorted(forms(texts))
    parts = [brought(f.segment) for f in found]
    known = _characters([f for f, p in zip(found, parts, strict=True) if p == []])
    clean = [f for f, p in zip(found, parts, strict=True) if p is not None and not garbled_in_part(p, known)] or _ANY
    model = None
    for share in GARBLED_SHARES:
        if model is not None:
            model.sure, model.known = DROPPED, _characters(clean)
            clean = _unlike(clean, model) or clean
        chains = [len(garbled_by(f.segment)) for f in clean]
        typical = _typical(len(clean), sum(f.n for f in clean), sum(chains), sum(f.n * k for f, k in zip(clean, chains, strict=True)), share)
        state = _start()
        for turn in range(ROUNDS):
            part = _part(*descend(clean, share, typical, state, turn == ROUNDS - 1, np.random.default_rng((seed, turn, 0))))
            rows = np.flatnonzero(part[:, -1])
            state = _averaged(state, rows, part[rows])
        model = ChainModel(state.weights, state.bias)
    model.known = _characters(clean)
    model.sure = _bounded(_kept_chances(model, [f.segment for f in found if f.n >= _recurring(len(texts))]))
    return model


def trained(texts: DataFrame, seed: int = 0) -> ChainModel:
    """``train`` over a table with a column ``text``, all rows of it: forms are counted in one shuffle, and fitted on, sifted and scored in tasks.

    A fit goes in rounds: every block of forms takes the state of the round before on by some epochs, and states are averaged by how often
    each bucket occurs in each block. What a form of many occurrences weighs is dealt out over several blocks, or all. The driver gets a state, of a fixed size, and the characters known. Neither files nor tasks change the result.
    """
    spark = texts.sparkSession
    context = spark.sparkContext
    cores = context.defaultParallelism
    schema = "key binary, segment string, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield _batch(forms(batch.column(0).slice(at, 2000).to_pylist()))

    outside = spread(texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("text"))
    found = staged(outside.mapInArrow(count, schema).groupBy("key").agg(F.min("segment").alias("segment"), F.sum("n").alias("n")), "forms")
    n_found = found.count()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = batch.column(1).to_pylist()
            parts = pa.array(map(brought, read), pa.list_(pa.string()))
            yield batch.append_column("parts", parts).append_column("chains", pa.array([len(garbled_by(s)) for s in read], pa.int32()))

    found = staged(_dealt(found, n_found, cores).mapInArrow(sift, f"{schema}, parts array<string>, chains int"), "sifted_forms")
    known = context.broadcast(_known(found.where("size(parts) = 0")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not garbled_in_part(p, known.value) for p in batch.column("parts").to_pylist()], pa.bool_())).drop_columns(["parts"])

    clean = staged(found.where("parts IS NOT NULL").mapInArrow(whole, f"{schema}, chains int"), "clean_forms")
    model = None
    n_texts = texts.count()
    for share in GARBLED_SHARES:
        if model is not None:
            model.sure, model.known = DROPPED, _known(clean)
            first = _shipped(model, context)

            def keep(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
                local = ChainModel(*first.value)
                for batch in batches:
                    garbled = pa.array([n > 0 for _, n, _ in restore(batch.column(1).to_pylist(), local)], pa.bool_())
                    yield batch.append_column("garbled", garbled)

            kept = staged(_dealt(clean, n_found, cores).mapInArrow(keep, f"{schema}, chains int, garbled boolean"), "kept_forms").where("NOT garbled").drop("garbled")
            clean = kept if kept.head(1) else clean
        totals = clean.agg(F.count(F.lit(1)), F.sum("n"), F.sum("chains"), F.sum(F.col("n") * F.col("chains")), F.sum(F.length("key") / 2)).head()
        if not totals[0]:
            chains = [len(garbled_by(f.segment)) for f in _ANY]
            clean = spark.createDataFrame([(bytearray(f.key), f.segment, f.n, k) for f, k in zip(_ANY, chains, strict=True)], f"{schema}, chains int")
            totals = (len(_ANY), len(_ANY), sum(chains), sum(chains), 1)
        model = _fitted(clean, share, _typical(*totals[:4], share), max(1, round(totals[4] / BLOCK_FEATURES)), seed)
    model.known = _known(clean)
    second = _shipped(model, context)

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = ChainModel(*second.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_kept_chances(local, batch.column(1).to_pylist()), pa.float64())], names=["chance"])

    often = found.where(F.col("n") >= _recurring(n_texts)).select(*schema.replace(",", "").split()[::2])
    highest = _dealt(often, n_found, cores).mapInArrow(chances, "chance double").agg(F.max("chance")).head()[0]
    model.sure = _bounded([] if highest is None else [highest])
    return model


def _batch(found: Sequence[Form]) -> pa.RecordBatch:
    columns = zip((0, 1, 2), (pa.binary(), pa.string(), pa.int64()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in columns], names=list(Form._fields))


def _dealt(df: DataFrame, rows: int, cores: int) -> DataFrame:
    """The forms dealt out to all cores, where there are enough of them to give each some; they are few bytes, but much work."""
    return df.repartition(min(cores, rows // 200), "key") if rows >= 400 else df


def _shipped(model: ChainModel, context: SparkContext) -> Broadcast:
    return context.broadcast((model.weights.astype(np.float32), model.bias, model.sure, model.known))  # a fixed size, some 2 MB


def _known(clean: DataFrame) -> frozenset[str]:
    """The characters outside ASCII of clean forms: no more than Unicode has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {c for batch in batches for s in batch.column(0).to_pylist() for c in s if c > "\x7f"}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.string())], names=["c"])

    return frozenset(r["c"] for r in clean.select("segment").mapInArrow(each, "c string").distinct().toLocalIterator())


def _fitted(clean: DataFrame, share: float, typical: float, blocks: int, seed: int) -> ChainModel:
    context = clean.sparkSession.sparkContext
    tasks = min(blocks, 4 * context.defaultParallelism)
    copies = F.least(F.lit(blocks), F.ceil(F.col("n") / F.lit(typical * MOST_WEIGHT)))
    shared = clean.select("key", "segment", copies.cast("int").alias("copies"), (F.col("n") / copies).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    block = F.pmod(F.xxhash64("key") + F.col("copy"), F.lit(blocks)).cast("int")
    dealt = shared.select(block.alias("block"), "key", "segment", "n").repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block", "key")
    values = [f"v{k}" for k in range(CLEAN + 3)]
    state = _start()
    for turn in range(ROUNDS):
        before = context.broadcast(tuple(state))

        def take_on(batches: Iterator[pa.RecordBatch], before=before, turn=turn) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            total = None
            for number, group in groupby(rows, key=lambda r: r[0]):
                part = _part(*descend([Form(*r[1:]) for r in group], share, typical, State(*before.value), turn == ROUNDS - 1, np.random.default_rng((seed, turn, number))))
                total = part if total is None else total + part
            if total is not None:
                at = np.flatnonzero(total[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in total[at].T)], names=["bucket", *values])

        parts = dealt.mapInArrow(take_on, ", ".join(["bucket int", *(f"{v} bigint" for v in values)]))
        sums = parts.groupBy("bucket").agg(*(F.sum(v).alias(v) for v in values)).toArrow()
        state = _averaged(state, sums.column(0).to_numpy(), np.stack([c.to_numpy() for c in sums.columns[1:]], axis=1))
        before.destroy()
    return ChainModel(state.weights, state.bias)


def _characters(clean: Sequence[Form]) -> frozenset[str]:
    return frozenset(c for f in clean for c in f.segment if c > "\x7f")


#: A form that occurs so often in so many documents, and three times at least, and that nothing undoes, is taken for clean in setting ``sure``.
RECURRING, RECURRING_IN = 3, 5_000
#: Bounds of ``sure``, and what it is in choosing the clean segments of the second model.
LEAST_SURE, MOST_SURE, DROPPED = 0.96, 0.997, 0.9


def _recurring(documents: int) -> float:
    return RECURRING * max(1.0, documents / RECURRING_IN)


def _kept_chances(model: ChainModel, recurring: Sequence[str]) -> list[float]:
    """The chances to be garbled, as far as they exceed the least bound, of recurring segments that show no loss and that nothing undoes."""
    chances = 1 - model.scores(recurring)[:, CLEAN] if recurring else np.zeros(0)
    doubtful = [(s, float(c)) for s, c in zip(recurring, chances, strict=True) if c > LEAST_SURE]
    certain = ChainModel(model.weights, model.bias, 1.0, model.known)
    return [c for (_, c), (_, n, _) in zip(doubtful, restore([s for s, _ in doubtful], certain), strict=True) if not n]


def _bounded(kept: Sequence[float]) -> float:
    """The highest of these chances, within bounds."""
    return float(min(MOST_SURE, max([LEAST_SURE, *(c + 1e-4 for c in kept)])))


#: Chains are tried from the likeliest on until those left have less chance than this together; of chains over UTF-8, which are told by
#: strict decoding whatever their chance, all are tried until one undoes every run.
LITTLE_CHANCE = 1e-3
#: The chance that a chain needs which changes one sign only.
ONE_SIGN = 0.95
#: A segment less likely than this to be garbled is left alone.
LEAST_CHANCE = 0.3
#: A segment less likely than that, as much of it may be clean, is still restored where a part decodes without any blank, down to this chance: as
#: UTF-8, or as more than a few pairs of bytes.
LEAST_IN_PART, FEW_PAIRS = 0.01, 3


def _strict(chain: Sequence[tuple[str, str]], undone: tuple[str, int]) -> bool:
    """Whether every run decoded strictly as UTF-8, which other text hardly ever does."""
    return chain[-1][0] == "utf-8" and undone[1] == 0


def _undone(segment: str, p: np.ndarray) -> tuple[list[tuple[tuple[str, int], bool]], dict[str, float], dict[str, set[int]]]:
    """What chains give back of a segment, with whether it decoded strictly, the likeliest first; the chance of each text given back,
    which chains that agree share; and these chains."""
    tried: list[tuple[tuple[str, int], bool]] = []
    by: dict[str, set[int]] = {}
    chance: dict[str, float] = {}
    left, whole = 1 - p[CLEAN], False
    for c in np.argsort(-p[:CLEAN], kind="stable"):
        if left < LITTLE_CHANCE and (whole or CHAINS[c][-1][0] != "utf-8"):
            continue
        left -= p[c]
        if (u := ungarble(segment, CHAINS[c])) is not None:
            strict = _strict(CHAINS[c], u)
            whole |= strict
            tried.append((u, strict))
            chance[u[0]] = chance.get(u[0], 0.0) + p[c]
            by.setdefault(u[0], set()).add(int(c))
    return tried, chance, by


def from_seven_bit(text: str, model: ChainModel) -> str | None:
    """The text with stretches decoded that read as an encoding of ASCII bytes; None where there are none.

    A stretch must decode strictly, give the same again when encoded, and hold characters only that the model knows from clean text. No
    bigram outside ASCII tells these encodings, but their marks do.
    """
    out = text
    for encoding, pattern in SEVEN_BIT.items():

        def undo(m: re.Match, encoding=encoding) -> str:
            try:
                back = m[0].encode("ascii").decode(encoding)
                again = back.encode(encoding).decode("ascii")
            except UnicodeError:
                return m[0]
            return back if again.startswith(m[0]) and back != m[0] and not back.isascii() and all(c in model.known for c in back if c > "\x7f") else m[0]

        out = pattern.sub(undo, out)
    return out if out != text else None


def _one_sign(segment: str, undone: str) -> bool:
    """Whether one sign was replaced by another and nothing else, which tells little: a typing error may put a sign beside others than usual."""
    return len(segment) == len(undone) and sum(a != b for a, b in zip(segment, undone, strict=True)) == 1


def _in_part(segment: str, undone: tuple[str, int], model: ChainModel) -> bool:
    """Whether a segment was garbled in part: some runs decoded as UTF-8, which makes them shorter, into characters known from clean text,
    no word mixes alphabets by it, and with the others, which stay, the segment reads as clean."""
    text, kept = undone
    return len(text) < len(segment) and kept > 0 and all(c in model.known for c in text if c > "\x7f") and not _mixes(segment, text) and _reads(text, model)


def _reads(text: str, model: ChainModel) -> bool:
    """Whether the model finds a restored text clean, which is asked where any bytes decode."""
    return text.isascii() or model.scores([text])[0, CLEAN] > 0.5


def restore(texts: Sequence[str | None], model: ChainModel, surety: float = 0.75) -> list[tuple[str | None, int, int]]:
    """(text as far as it can be restored, garbled segments, those of them that can't be restored) of each text.

    A segment that a chain would undo without being sure enough is restored if another of the same text was garbled by that chain.
    """
    out, work, doubtful = [], [], []
    used: dict[int, set[int]] = {}
    for t in texts:
        seven = from_seven_bit(t, model) if t and _MARKED.search(t) else None  # such stretches may hold signs that end a segment
        read = t if seven is None else seven
        parts = segments(read) if read and not read.isascii() else []
        out.append([parts, int(seven is not None), 0])
        work += [(len(out) - 1, k, s, ()) for k, s in enumerate(parts) if not s.isascii()]
    while work:
        probs = model.scores([s for *_, s, _ in work])
        again = []
        for (row, k, s, before), p in zip(work, probs, strict=True):
            little = 1 - p[CLEAN] < LEAST_CHANCE and "�" not in s
            if little and 1 - p[CLEAN] < LEAST_IN_PART:
                continue
            tried, chance, by = _undone(s, p)
            if little:
                told = {t for t, chains in by.items() if (len(s) - len(t) > FEW_PAIRS or any(CHAINS[c][-1][0] == "utf-8" for c in chains)) and t.count(" ") == s.count(" ")}
                tried = [(u, strict) for u, strict in tried if u[0] in told and _in_part(s, u, model)]
                if not tried:
                    continue
            undone = [u for u, strict in tried if strict or chance[u[0]] >= (ONE_SIGN if _one_sign(s, u[0]) else surety) and _reads(u[0], model) or _in_part(s, u, model)]
            fixed = min(undone, key=lambda u: u[1])[0] if undone else None
            if fixed is None and not before and (few := [u[0] for u, _ in tried if chance[u[0]] >= LEAST_CHANCE and _reads(u[0], model)]):
                doubtful.append((row, k, few[0], by[few[0]], 1 - p[CLEAN] >= model.sure))
                continue
            if fixed is not None:
                used.setdefault(row, set()).update(by[fixed])
            if fixed is None and 1 - p[CLEAN] < model.sure and "�" not in s:
                continue  # neither decodes strictly, nor shows a loss, as U+FFFD does, nor is surely garbled
            if not before:
                out[row][1] += 1
                out[row][2] += "�" in s or fixed is None
            if fixed is not None:
                out[row][0][k] = fixed
                if not fixed.isascii() and fixed not in before:  # until nothing is garbled any more, or a form comes back
                    again.append((row, k, fixed, (*before, s)))
        work = again
    for row, k, text, chains, sure in doubtful:
        fits = not chains.isdisjoint(used.get(row, ()))
        out[row][1] += fits or sure
        out[row][2] += sure and not fits
        if fits:
            out[row][0][k] = text
    return [("".join(parts) if n else t, n, lost) for t, (parts, n, lost) in zip(texts, out, strict=True)]


def garbled_documents(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, restored, n_garbled, n_lost) of each row with a garbled segment.

    ``restored`` is the whole text with every segment restored that can be; ``n_lost`` counts garbled segments that
    can't be, or in which characters were lost. Null and empty texts are never garbled, nor are those of ASCII without a mark of an encoding
    whose bytes are all of ASCII; rows repeated count each. Texts are read whole, in segments, by the model as by its training, for which
    all of them count; an empty table gives an empty one.
    """
    texts = df.select(df[id_].alias("id"), df[text].cast("string").alias("text"))
    source = texts.where(F.col("text").rlike(READ))
    shipped = _shipped(trained(texts), df.sparkSession.sparkContext)
    kind = df.schema[id_].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = ChainModel(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = restore(part.column(1).to_pylist(), local)
                hits = [i for i, (_, n, _) in enumerate(found) if n]
                columns = [pa.array([found[i][c] for i in hits], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hits, pa.int32())), *columns], names=["id", "restored", "n_garbled", "n_lost"])

    out = spread(source).mapInArrow(work, f"id {kind}, restored string, n_garbled int, n_lost int")
    return out.withColumnRenamed("id", id_)
