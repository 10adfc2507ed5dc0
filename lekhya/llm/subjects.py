"""Problem 9: subject areas of documents.

Words and their parts (the word, its sound spelled alike in Devanagari and Roman script, character n-grams of that)
have embeddings in a table of fixed width that they are hashed to, so that every word of any corpus has one; a text is
the average of its words' embeddings, common words weighing less, and has one independent logistic output per
subject.

The model is fitted on the labelled examples first. Then follow rounds of self-training over all documents: a
sentence counts for a subject if the model of the round before puts it there and its document has the subject clearly,
and against it if its document hardly has it; all else is left out. Words that the few examples lack get their meaning
in this way. Every step of a round takes one slice of the documents (by hash of the id, STEPS slices make all of them):
each partition adds up the gradients of its own documents at the common parameters, these sums are added up over all
partitions, with that of the examples, and one Adagrad step is made for all. The outputs are linear in the embeddings,
so a partition needs no more than each part's scores and hands back no more than what its parts add to their
gradients; the rest follows from the sums. Results do not depend on the number of partitions or on how many documents
there are.

Texts are cut into words and parts once; the numbers of the parts are written to the shared folder by slice.

Every document is then scored whole, sentence by sentence (line ends, sentence marks; text without any is read in a
sliding window of words); the share of a subject is that of the sentences whose output for it is above one half, and
a document has the subjects with at least SHARE.

Nulls and texts without words have no subject. Examples with a null label or text are left out. Ties can't occur as
outputs are independent. Extra columns are ignored; without examples nothing is found.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.llm.forms import SEQUENCES, same_words
from lekhya.llm.run import shared_folder

#: Width of embeddings, length of character n-grams, and what they weigh against word and sound.
WIDTH, GRAM, GRAM_SHARE = 8, 6, 0.1
#: Rows of the hash table for words, for sounds and for n-grams each.
BUCKETS = 1 << 16
#: A document has a subject from this share of its sentences; words of the window where there are no sentences.
SHARE, WINDOW = 0.25, 9
#: A word in a share p of all documents weighs COMMON / (COMMON + p).
COMMON = 0.1
#: Bound of the labelled rows, drawn by hash of their content.
MAX_EXAMPLES = 20_000
#: Steps on the examples; rounds of self-training and steps (slices of the documents) of a round.
EXAMPLE_STEPS, ROUNDS, STEPS, RATE = 60, 3, 8, 1.0
#: What all documents' sentences of a step weigh against all examples.
SENTENCES_SHARE = 0.9
#: Self-training: a document has a subject clearly from this share, and hardly up to that.
CLEARLY, HARDLY = 0.2, 0.1
#: Sums of gradients that one task, or the driver, adds up.
FAN_IN = 16
#: Characters of the texts that are packed into one block (a longer text is one by itself).
BLOCK = 4_000_000
_SENTENCE = re.compile(r"[.!?।॥\n\r]+")
_MARKS = ".,;:!?।॥…\"'“”‘’()[]-–"
_PLAIN = re.compile("[a-z0-9\u0901-\u0928\u092a-\u0930\u0932\u0933\u0935-\u0957\u0966-\u096f]+")
_SEQUENCE = re.compile("|".join(a for a, _ in SEQUENCES))
_NOISE = re.compile(r"\[\d\d:\d\d(?::\d\d)?\]|^[A-Z]: ", re.M)


def _sounds() -> dict[str, str]:
    """Roman spelling of Devanagari characters from their Unicode names; vowels in capitals replace an inherent a."""
    out = {"\u093c": "", "\u094d": "-", "\u0902": "n", "\u0901": "n", "\u0903": "h"}
    for c in range(0x904, 0x950):
        name = unicodedata.name(chr(c), "").split()
        if name[:2] == ["DEVANAGARI", "LETTER"] and len(name) == 3:
            out[chr(c)] = name[2].lower()
        elif name[:3] == ["DEVANAGARI", "VOWEL", "SIGN"] and len(name) == 4:
            out[chr(c)] = "-" + name[3].lower()
    return out


_SOUNDS = _sounds()
_SPELL = {ord(c): r for c, r in _SOUNDS.items()}
_SPELL |= {c: "".join(_SOUNDS.get(x, x) for x in unicodedata.normalize("NFD", chr(c))) for c in (0x929, 0x931, 0x934, *range(0x958, 0x960))}
#: Consonants, whose inherent vowel is silent at a word's end.
_CONSONANTS = frozenset(c for c, r in _SOUNDS.items() if len(r) > 1 and r.endswith("a") and not r.startswith("-"))
#: Spellings of one sound, in order of replacement.
_ONE_SOUND = (("tth", "th"), ("ddh", "dh"), ("ch", "c"), ("aa", "a"), ("ii", "i"), ("ee", "i"), ("uu", "u"), ("oo", "u"), ("w", "v"), ("z", "j"), ("f", "ph"))
_DOUBLED = tuple((c + c, c) for c in "bcdghjklmnpqrstvxy")


def roman(word: str) -> str:
    """A spelling that a Devanagari word and its Roman form share: short vowels, no doubled consonants."""
    out = word
    if not word.isascii():
        out = word.translate(_SPELL).replace("a-", "")
        if len(out) > 2 and (word[-1] in _CONSONANTS or word[-1] == "\u093c"):
            out = out[:-1]
        out = out.replace("-", "")
    for a, b in _ONE_SOUND:
        if a in out:
            out = out.replace(a, b)
    for a, b in _DOUBLED:
        if a in out:
            out = out.replace(a, b)
    return out


def _bucket(part: bytes, kind: int) -> int:
    return kind * BUCKETS + crc32(part) % BUCKETS


def gram_buckets(sounds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all sounds in a row, and how many each sound has: none where it is no longer than one."""
    length = np.fromiter(map(len, sounds), dtype=np.int64, count=len(sounds))
    n = np.where(length > GRAM, length - GRAM + 1, 0)
    codes = np.frombuffer(b"".join(sounds), dtype=np.uint8).astype(np.uint32)
    if not n.sum():
        return np.zeros(0, np.int32), n
    h = np.zeros(len(codes) - GRAM + 1, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = h * np.uint32(16777619) + codes[k : k + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
    begin = np.cumsum(length) - length
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return (2 * BUCKETS + (h[at] >> np.uint32(8)) % BUCKETS).astype(np.int32), n


class Forms(dict):
    """Token to the number of its word; a token of no word or of several to a number below 0 (see several).

    words: each one's word bucket, sound bucket and sound."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[tuple[int, int, bytes]] = []
        self.number: dict[str, int] = {}
        self.several: list[list[int]] = []

    def _of(self, word: str) -> int:
        k = self.number.get(word)
        if k is None:
            k = self.number[word] = len(self.words)
            sound = f"<{roman(word)}>".encode()
            self.words.append((_bucket(word.encode(), 0), _bucket(sound, 1), sound))
        return k

    def __missing__(self, token: str) -> int:
        w = token.strip(_MARKS).lower()
        plain = _PLAIN.fullmatch(w) and not _SEQUENCE.search(w)  # most tokens; the rest go through same_words
        found = [self._of(x) for x in ([w] if plain else same_words(token))]
        if len(found) != 1:
            self.several.append(found)
        out = self[token] = found[0] if len(found) == 1 else -len(self.several)
        return out

    def of(self, tokens: list[str]) -> list[int]:
        """Numbers of the words of these tokens."""
        out = list(map(self.__getitem__, tokens))
        if out and min(out) < 0:
            return [k for x in out for k in ((x,) if x >= 0 else self.several[-x - 1])]
        return out


@dataclass
class Block:
    """Texts as numbers: words in a row; n of each stretch (a sentence; a word in text without marks), own (number of
    each stretch's document) and long (by document: no marks); size and at: parts of each of the block's words."""

    words: np.ndarray
    n: np.ndarray
    own: np.ndarray
    long: np.ndarray
    size: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, texts: list[str], forms: Forms, whole: bool = False) -> "Block":
        """whole: each text is one stretch."""
        words: list[int] = []
        n: list[int] = []
        own: list[int] = []
        long: list[bool] = []
        for i, t in enumerate(texts):
            if "[" in t or ": " in t:
                t = _NOISE.sub(" ", t)
            pieces = [t.split()] if whole else [p for p in (s.split() for s in _SENTENCE.split(t)) if p]
            wide = not whole and len(pieces) == 1 and len(pieces[0]) > 2 * WINDOW
            long.append(wide)
            for p in pieces:
                found = forms.of(p)
                words.extend(found)
                if m := len(found):
                    n.extend([1] * m if wide else [m])
                    own.extend([i] * (m if wide else 1))
        held, back = np.unique(np.array(words, dtype=np.int64), return_inverse=True)
        of = [forms.words[k] for k in held]
        grams, n_grams = gram_buckets([sound for _, _, sound in of])
        size = (n_grams + 2).astype(np.int32)
        first = np.cumsum(size, dtype=np.int64) - size
        at = np.empty(int(size.sum()), np.int32)
        rest = np.ones(len(at), bool)
        for k in (0, 1):
            at[first + k] = [w[k] for w in of]
            rest[first + k] = False
        at[rest] = grams
        return cls(back.astype(np.int32), np.array(n, np.int32), np.array(own, np.int32), np.array(long, bool), size, at)

    def pack(self) -> bytes:
        """Widths and lengths of the arrays, then these, each in the narrowest unsigned type."""
        parts = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in (self.words, self.n, self.own, self.long.view(np.uint8), self.size, self.at)]
        return np.array([(a.itemsize, len(a)) for a in parts], np.int64).tobytes() + b"".join(a.tobytes() for a in parts)

    @classmethod
    def unpack(cls, data: bytes) -> "Block":
        at, out = 96, []
        for width, n in np.frombuffer(data, np.int64, 12).reshape(6, 2):
            out.append(np.frombuffer(data, f"u{width}", int(n), at).astype(np.int32))
            at += int(width * n)
        return cls(*out[:3], out[3].astype(bool), *out[4:])

    def buckets(self) -> np.ndarray:
        """Word buckets of each document, each once."""
        first = self.at[np.cumsum(self.size) - self.size]
        both = np.unique(np.repeat(self.own.astype(np.int64), self.n) * BUCKETS + first[self.words])
        return both % BUCKETS


class Texts:
    """A block with the weights of its words. idf: weight of a word by its bucket."""

    def __init__(self, b: Block, idf: np.ndarray) -> None:
        self.b, self.documents = b, len(b.long)
        self.word = np.repeat(np.arange(len(b.size)), b.size)
        grams = b.size - 2
        main = np.where(grams > 0, (1 - GRAM_SHARE) / 2, 0.5)[self.word]
        self.x = np.where(b.at < 2 * BUCKETS, main, (GRAM_SHARE / np.maximum(grams, 1))[self.word]).astype(np.float32)[:, None]
        self.first = (np.cumsum(b.size) - b.size).astype(np.int64)
        self.weight = idf[b.at[self.first]] if len(b.size) else np.zeros(0, np.float32)
        self.begin = (np.cumsum(b.n) - b.n).astype(np.int64)
        self.wide = b.long[b.own] if len(b.own) else np.zeros(0, bool)

    def of_words(self, scores: np.ndarray) -> np.ndarray:
        """What each of the block's words adds to the outputs, by its weight."""
        if not len(self.first):
            return np.zeros((0, scores.shape[1]), np.float32)
        return np.add.reduceat(scores[self.b.at] * self.x, self.first) * self.weight[:, None]

    def shares(self, scores: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of the sentences of each subject by document, and the number of sentences (windows)."""
        b, k = self.b, len(bias)
        run = np.zeros((len(b.n) + 1, k + 1))
        if len(b.n):
            each = np.column_stack((self.weight, self.of_words(scores)))
            np.cumsum(np.add.reduceat(each[b.words], self.begin), axis=0, out=run[1:])
        ix = np.arange(len(b.n))
        start, stop = np.searchsorted(b.own, b.own, "left"), np.searchsorted(b.own, b.own, "right")
        lo = np.where(self.wide, np.maximum(start, ix - WINDOW // 2), ix)
        hi = np.where(self.wide, np.minimum(stop, ix + WINDOW // 2 + 1), ix + 1)
        s = run[hi] - run[lo]
        hit = s[:, 1:] / np.maximum(s[:, :1], 1e-9) + bias > 0
        count = np.bincount(b.own, minlength=self.documents)
        hits = np.stack([np.bincount(b.own, weights=hit[:, j], minlength=self.documents) for j in range(k)], 1)
        return hits / np.maximum(count, 1)[:, None], count


class Units:
    """What is learned from: the stretches of a block, words of text without marks in pieces of WINDOW + 1."""

    def __init__(self, t: Texts) -> None:
        b = t.b
        start = np.concatenate(([True], b.own[1:] != b.own[:-1])) if len(b.own) else np.zeros(0, bool)
        place = np.arange(len(b.own)) - np.nonzero(start)[0][np.cumsum(start) - 1] if len(b.own) else np.zeros(0, int)
        keep = ~t.wide | (place % (WINDOW + 1) == 0)
        self.t, self.begin, self.own = t, t.begin[keep], b.own[keep]
        self.unit = np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(b.words))))
        self.whole = np.maximum(np.add.reduceat(t.weight[b.words], self.begin), 1e-9) if len(self.begin) else np.zeros(0)

    def outputs(self, scores: np.ndarray, bias: np.ndarray) -> np.ndarray:
        if not len(self.begin):
            return np.zeros((0, len(bias)))
        return np.add.reduceat(self.t.of_words(scores)[self.t.b.words], self.begin) / self.whole[:, None] + bias

    def gradient(self, scores: np.ndarray, bias: np.ndarray, y: np.ndarray, c: np.ndarray) -> "Gradient":
        k, t = len(bias), self.t
        if not len(self.begin):
            return Gradient.added([], k)
        d = (1 / (1 + np.exp(-np.clip(self.outputs(scores, bias), -30, 30))) - y) * c
        back = (d / self.whole[:, None])[self.unit]
        words = np.stack([np.bincount(t.b.words, weights=back[:, j], minlength=len(t.first)) for j in range(k)], 1) * t.weight[:, None]
        at, slot = np.unique(t.b.at, return_inverse=True)
        every = words[t.word] * t.x
        return Gradient(at, np.stack([np.bincount(slot, weights=every[:, j], minlength=len(at)) for j in range(k)], 1), d.sum(0), float(c.max(1).sum()))


@dataclass
class Gradient:
    """Sums over texts: what each part adds to the gradient of its scores, the gradient of the bias, the weight."""

    at: np.ndarray
    g: np.ndarray
    bias: np.ndarray
    weight: float

    def pack(self) -> bytes:
        return np.array([len(self.at), self.weight, *self.bias]).tobytes() + self.at.astype(np.int32).tobytes() + self.g.astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, data: bytes, k: int) -> "Gradient":
        head = np.frombuffer(data, np.float64, 2 + k)
        n, at = int(head[0]), 8 * (2 + k)
        return cls(np.frombuffer(data, np.int32, n, at), np.frombuffer(data, np.float32, n * k, at + 4 * n).reshape(n, k).astype(float), head[2:].copy(), float(head[1]))

    @classmethod
    def added(cls, some: list["Gradient"], k: int) -> "Gradient":
        if not some:
            return cls(np.zeros(0, np.int64), np.zeros((0, k)), np.zeros(k), 0.0)
        at, back = np.unique(np.concatenate([s.at for s in some]), return_inverse=True)
        every = np.concatenate([s.g for s in some])
        g = np.stack([np.bincount(back, weights=every[:, j], minlength=len(at)) for j in range(k)], 1)
        return cls(at, g, sum(s.bias for s in some), sum(s.weight for s in some))


class Model:
    """Embeddings, outputs and bias with their Adagrad sums."""

    def __init__(self, n_subjects: int) -> None:
        r = np.random.default_rng(7)
        self.embeddings = np.zeros((3 * BUCKETS, WIDTH), np.float32)
        self.outputs = r.normal(0, 0.5, (WIDTH, n_subjects)).astype(np.float32)
        self.bias = np.full(n_subjects, -2.0, np.float32)
        self.sums = [np.full_like(p, 1e-6) for p in (self.embeddings, self.outputs, self.bias)]

    def scores(self) -> np.ndarray:
        """What each part adds to the outputs."""
        return self.embeddings @ self.outputs

    def step(self, g: Gradient) -> None:
        """One Adagrad step by a gradient already divided by its weight."""
        rows = (g.at, slice(None), slice(None))
        grads = (g.g @ self.outputs.T, self.embeddings[g.at].T @ g.g, g.bias)
        for p, s, at, d in zip((self.embeddings, self.outputs, self.bias), self.sums, rows, grads):
            d = d.astype(np.float32)
            s[at] += d * d
            p[at] -= RATE * d / np.sqrt(s[at])


def mixed(examples: Gradient, sentences: Gradient, k: int) -> Gradient:
    """The mean gradient of the examples and that of the sentences, by SENTENCES_SHARE."""
    a = (1 - SENTENCES_SHARE if sentences.weight else 1.0) / max(examples.weight, 1e-9)
    b = SENTENCES_SHARE / sentences.weight if sentences.weight else 0.0
    return Gradient.added([Gradient(examples.at, examples.g * a, examples.bias * a, 1.0), Gradient(sentences.at, sentences.g * b, sentences.bias * b, 1.0)], k)


def pseudo(texts: Texts, units: Units, teacher: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Targets and weights of the units by the teacher's outputs on them and on their documents."""
    scores, bias = teacher
    p = units.outputs(scores, bias) > 0
    if not len(p):
        return p.astype(np.float32), p.astype(np.float32)
    n = np.maximum(np.bincount(units.own, minlength=texts.documents), 1)
    share = np.stack([np.bincount(units.own, weights=p[:, k], minlength=texts.documents) for k in range(len(bias))], 1)[units.own] / n[units.own][:, None]
    clearly, hardly = share >= CLEARLY, share <= HARDLY
    return (clearly & p).astype(np.float32), np.where(clearly, p, hardly & ~p).astype(np.float32)


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, Block]]:
    for pdf in frames:
        for ids, data in zip(pdf["ids"], pdf["block"]):
            yield ids, Block.unpack(data)


def pack(texts: DataFrame) -> DataFrame:
    """Blocks of the texts (columns d, t) by slice s, written to the shared folder and read from there.

    Slice -1 has one row of each task: how many of its documents have a word of each bucket, then how many there are."""
    spark, kind = texts.sparkSession, dict(texts.dtypes)["d"]
    path = f"{shared_folder(spark)}/subjects-{uuid.uuid4().hex}"

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, counts, documents = Forms(), np.zeros(BUCKETS, np.int64), 0
        for pdf in frames:
            if len(forms) > 300_000:  # bounds the memory of a worker
                forms = Forms()
            for s, part in pdf.groupby("s"):
                for _, some in part.groupby(part["t"].map(len).cumsum() // BLOCK):
                    b = Block.of(list(some["t"]), forms)
                    counts += np.bincount(b.buckets(), minlength=BUCKETS)
                    documents += len(some)
                    yield pd.DataFrame({"s": [s], "ids": [list(some["d"])], "block": [b.pack()]})
        if documents:
            yield pd.DataFrame({"s": [-1], "ids": [None], "block": [np.append(counts, documents).tobytes()]})

    sliced = texts.select(F.pmod(F.xxhash64("d"), F.lit(STEPS)).cast("int").alias("s"), "d", "t")
    schema = f"s int, ids array<{kind}>, block binary"
    sliced.mapInPandas(blocks, schema).write.partitionBy("s").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _tree(sums: DataFrame, n: int, add: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """The sum of a binary column's values over n partitions (one value each), FAN_IN of them added up by one task."""
    (name,) = sums.columns

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [g for pdf in frames for g in pdf[name]]
        if held:
            yield pd.DataFrame({name: [reduce(add, held)]})

    while n > FAN_IN:
        n = -(-n // FAN_IN)
        sums = sums.repartition(n).mapInPandas(some, f"{name} binary")
    rows = [bytes(r[0]) for r in sums.collect()]
    return reduce(add, rows) if rows else None


def weights(packed: DataFrame) -> np.ndarray:
    """Weight of a word by its bucket, from all documents that have it."""
    own = packed.where("s = -1").select("block")
    counts = _tree(own, own.rdd.getNumPartitions(), lambda a, b: (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes())
    n = np.frombuffer(counts, np.int64) if counts else np.ones(BUCKETS + 1)
    return (COMMON / (COMMON + n[:-1] / n[-1])).astype(np.float32)


def summed(blocks: DataFrame, teacher: Broadcast, student: Broadcast, k: int) -> Gradient:
    """The gradient of all sentences in the blocks; partitions' sums are added up FAN_IN at a time."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, scores, bias = teacher.value
        some: list[Gradient] = []
        for _, b in _rows(frames):
            t = Texts(b, idf)
            u = Units(t)
            some.append(u.gradient(*student.value, *pseudo(t, u, (scores, bias))))
            if len(some) == FAN_IN:
                some = [Gradient.added(some, k)]
        if some:
            yield pd.DataFrame({"g": [Gradient.added(some, k).pack()]})

    total = _tree(blocks.mapInPandas(own, "g binary"), blocks.rdd.getNumPartitions(), lambda a, b: Gradient.added([Gradient.unpack(a, k), Gradient.unpack(b, k)], k).pack())
    return Gradient.unpack(total, k) if total else Gradient.added([], k)


def fit(packed: DataFrame, examples: Block, labels: np.ndarray, idf: np.ndarray, k: int) -> Model:
    """The model after the examples and the rounds of self-training."""
    sc = packed.sparkSession.sparkContext
    own = Units(Texts(examples, idf))
    y = np.zeros((len(own.own), k))
    y[np.arange(len(own.own)), labels[own.own]] = 1
    given = lambda m: own.gradient(m.scores(), m.bias, y, np.ones_like(y))
    model = Model(k)
    for _ in range(EXAMPLE_STEPS):
        model.step(mixed(given(model), Gradient.added([], k), k))
    for _ in range(ROUNDS):
        teacher = sc.broadcast((idf, model.scores(), model.bias.copy()))
        for s in range(STEPS):
            student = sc.broadcast((model.scores(), model.bias.copy()))
            model.step(mixed(given(model), summed(packed.where(F.col("s") == s), teacher, student, k), k))
            student.destroy()
        teacher.destroy()
    return model


def learn(docs: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "subject", example_text: str = "text") -> tuple[DataFrame, list[str], np.ndarray, Model]:
    """Packed documents, subjects, word weights and model, from at most MAX_EXAMPLES labelled rows and all documents."""
    given = examples.select(F.col(label_col).cast("string").alias("label"), F.col(example_text).alias("t")).where("label is not null and t is not null")
    rows = given.orderBy(F.xxhash64("label", "t"), "label", "t").limit(MAX_EXAMPLES).collect()
    subjects = sorted({r["label"] for r in rows})
    packed = pack(docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where("d is not null and t is not null"))
    idf = weights(packed)
    # an example is one text, as its label is for the whole
    block = Block.of([r["t"] for r in rows], Forms(), whole=True)
    labels = np.array([subjects.index(r["label"]) for r in rows], dtype=np.int64)
    return packed, subjects, idf, fit(packed, block, labels, idf, len(subjects)) if subjects else Model(0)


def subject_shares(docs: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """id_col, subject, share, n_sentences for every document and subject with a share above 0."""
    packed, subjects, idf, model = learn(docs, examples, id_col, text_col, **columns)
    sent = docs.sparkSession.sparkContext.broadcast((idf, model.scores(), model.bias))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, scores, bias = sent.value
        for ids, b in _rows(frames):
            share, count = Texts(b, idf).shares(scores, bias)
            i, k = np.nonzero(share)
            if len(i):
                yield pd.DataFrame({"d": ids[i], "subject": [subjects[x] for x in k], "share": share[i, k], "n_sentences": count[i]})

    kind = dict(docs.dtypes)[id_col]
    out = packed.where("s >= 0") if subjects else packed.where("false")
    return out.mapInPandas(score, f"d {kind}, subject string, share double, n_sentences long").withColumnRenamed("d", id_col)


def subjects_of(docs: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """id_col, subject, share for the subjects a document has."""
    return subject_shares(docs, examples, id_col, text_col, **columns).where(F.col("share") >= SHARE).select(id_col, "subject", "share")


def composition(found: DataFrame, n_documents: int) -> DataFrame:
    """subject, n_documents, share_of_documents."""
    by = found.groupBy("subject").agg(F.count("*").alias("n_documents"))
    return by.select("subject", "n_documents", (F.col("n_documents") / F.lit(max(1, n_documents))).alias("share_of_documents"))
