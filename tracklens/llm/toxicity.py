"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text (op6).

Folding lower-cases, replaces look-alike letters and full-width forms, and reads digits and signs that stand inside a
word as the letters they imitate. The lexicon holds word starts (`` lowe`` fits every longer word that begins so), whole words
and exception phrases; of the entries that begin at one place the longest counts, so a harmless longer word or phrase
silences the entry inside it. Weights are log ratios of document frequencies in toxic and other labelled documents; a
list of common insults enters with the frequencies of ``SEED_TOXIC`` imaginary documents. The sum of the weights, as
it is and for each hundred words, goes through a logistic curve fitted on the same rows.

Labels are learned from at most ``SAMPLE`` rows (the smallest hashes of doc_id) whose crc32 of doc_id is not 1 modulo
3; near copies among them with the same label count once. How much evidence an entry needs is chosen there too: lexicons of
all levels learned from the rows with remainder 2 are tried on those with remainder 0, which the third with remainder 1
has no part in. Everything else covers all rows: each text is folded and scanned whole where it lies, without any shuffle.

Defined cases: a null or empty text scores as one without a match; labels that are null or of unknown documents teach
nothing, repeated labels of a document count as toxic if one is; with no usable label only the insults count; an empty
table gives an empty result; repeated rows score alike; clashing extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import batches, dropped, id_and_text, mixed, stored, table, window_hashes, word_hashes

#: Bound on the labelled rows that the lexicon is learned from.
SAMPLE = 8000
SEED_TOXIC = 4.0
#: An entry needs this log ratio, and so many nats of evidence against the base rate: of a million entries that say nothing
#: one passes ``CHANCE`` by chance in a hundred samples. Which of ``LEVELS`` holds is chosen on teachable rows (``chosen``).
LEAST_WEIGHT, CHANCE = 2.0, math.log(1e6 * 100)
LEVELS = (12.0, 15.0, CHANCE, 22.0, 26.0, 30.0)
SHORTEST, LONGEST = 3, 8
THRESHOLD = 0.7
#: Hashes that near copies have in common.
SKETCH = 12
END = "\x01"

# Common insults, harmless phrases that hold one, look-alikes of Latin letters, signs used for letters.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "dumb", "scum", "loser", "clown", "trash", "garbage", "pathetic", "disgusting", "worthless", "bastard", "bitch", "asshole", "shit", "fuck")
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "garbage collector", "garbage collection", "scumble", "dumbbell", "dumbwaiter", "loser bracket")
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ɡ": "g", "ı": "i", "ⅼ": "l"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(LOOKALIKES) | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0x200B, 0x200C, 0x200D, 0xAD)}
_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + r"](?=[^\W\d_]|[" + re.escape("".join(SIGNS)) + r"][^\W\d_])")
_RUN = re.compile(r"[^\W\d_]+")


def fold(word: str) -> list[str]:
    """The folded letter runs of a word."""
    w = word.lower().translate(_FOLD)
    if not w.isalpha():
        w = _SIGN.sub(lambda m: SIGNS[m[0]], w)
    return _RUN.findall(w)


class _Folded(dict):
    """Word to its folded runs, each as `` run\\x01``; emptied when large, and very long words aren't kept."""

    def __missing__(self, word: str) -> str:
        out = "".join(f" {x}{END}" for x in fold(word))
        if len(word) <= 64:
            self[word] = out
        return out

    def text(self, text: str | None) -> tuple[str, int]:
        if len(self) > 400_000:
            self.clear()
        words = (text or "").split()
        return "".join(map(self.__getitem__, words)), len(words)


def entries_of(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split(END)):
        if w:
            out.add(w + END)
            out.update(w[: n + 1] for n in range(SHORTEST, min(LONGEST, len(w) - 2) + 1))  # starts of longer words
    return out


def phrase(text: str) -> str:
    return "".join(f" {x}{END}" for w in text.split() for x in fold(w))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = usable.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows


def once(rows: DataFrame) -> DataFrame:
    """One row of each group of near copies with one label: those with the same ``SKETCH`` smallest hashes of three words.

    Copies aren't evidence of their own. Texts that share half of their three-word runs agree on all with 2^-12.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(9).integers(1, 1 << 62, SKETCH, dtype=np.uint64)
        for b in parts:
            sketches = []
            for t in b.column(1).to_pylist():
                h = word_hashes([w.encode() for w in (t or "").lower().split()])
                runs = window_hashes(h, min(3, max(len(h), 1)))
                sketches.append(b"".join(mixed(runs ^ o).min().tobytes() for o in odd) if len(runs) else b"")
            yield pa.record_batch([*b.columns, pa.array(sketches, pa.binary())], names=["doc_id", "text", "toxic", "sketch"])

    sketched = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id long, text string, toxic int, sketch binary")
    return sketched.groupBy("sketch", "toxic").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("r")).select("r.doc_id", "r.text", "toxic")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def entry_counts(rows: DataFrame) -> DataFrame:
    """entry, toxic, other: in how many documents of each label an entry occurs."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, seen = _Folded(), {}
        for texts, toxic in batches(parts, "text", "toxic"):
            for text, y in zip(texts, toxic, strict=True):
                for e in entries_of(folded.text(text)[0]):
                    seen.setdefault(e, [0, 0])[y != 1] += 1
        if seen:
            yield pa.record_batch([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["entry", "toxic", "other"])

    return rows.select("text", "toxic").mapInArrow(count, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn(rows: DataFrame, least: float = CHANCE) -> tuple[dict[str, float], tuple[int, int]]:
    """Lexicon from doc_id, text, toxic: entry to weight, 0 for an exception."""
    lexicons, sizes = learned(rows, [least])
    return lexicons[0], sizes


def learned(rows: DataFrame, levels: list[float]) -> tuple[list[dict[str, float]], tuple[int, int]]:
    """The lexicon of each level of evidence, and the numbers of toxic and of other rows. Entries come to the driver once."""
    sizes = rows.groupBy().agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    n_toxic, n_other = sizes[0], sizes[1]
    counted = stored(entry_counts(rows), "toxic-entries")
    base = max(n_toxic, 1) / max(n_toxic + n_other, 2)
    enough = math.ceil(min(levels) / math.log(1 / min(0.9, base)))
    seeds = [phrase(w)[:-1] for w in INSULTS]
    found = counted.where((F.col("toxic") >= min(enough, 10)) | F.col("entry").isin([*seeds, *(s + END for s in seeds)])).toArrow()  # bounded by the sample
    count_of = dict(zip(found.column(0).to_pylist(), zip(found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True), strict=True))

    def counts(e: str) -> tuple[int, int]:
        """A learned start fits longer words; a listed insult fits its own word too."""
        a, b = count_of.get(e, (0, 0)), count_of.get(e + END, (0, 0)) if e in seeds else (0, 0)
        return a[0] + b[0], a[1] + b[1]

    def strength(e: str) -> float:
        t, o = counts(e)
        return evidence(t + SEED_TOXIC * (e in seeds), t + o + SEED_TOXIC * (e in seeds), base)

    # The strongest evidence first, of equals the longest: it says most exactly what was learned.
    ranked = sorted({*count_of, *seeds}, key=lambda e: (-round(strength(e), 6), -len(e), e))

    def lexicon_at(least: float) -> dict[str, float]:
        lexicon: dict[str, float] = {}
        taken: set[str] = set()
        for e in ranked:
            if e in taken or any(e[:n] in lexicon for n in range(SHORTEST + 1, len(e))):
                continue  # an entry that begins alike stands for it
            t, o = counts(e)
            if e in seeds:
                w = weight(t + SEED_TOXIC, o, n_toxic + 2 * SEED_TOXIC, n_other + 2 * SEED_TOXIC)
            else:
                w = weight(t, o, n_toxic, n_other)
            if w >= LEAST_WEIGHT and (e in seeds or strength(e) >= least):
                lexicon[e] = w
                taken.update(e[:n] for n in range(SHORTEST + 1, len(e) + 1))
        for e in [e for e in lexicon if e[-1] != END and e not in seeds]:
            if weight(*count_of.get(e + END, (0, 0)), n_toxic, n_other) < LEAST_WEIGHT:
                lexicon.setdefault(e + END, 0.0)  # the start as a word of its own was not learned
        # A longer word or start that other documents use without being toxic silences the entry.
        starts = [e for e in lexicon if count_of.get(e, (0, 0))[1] >= 3]
        if starts:
            harmless = counted.where((F.col("other") >= 3) & F.col("entry").endswith(END)).where(F.substring("entry", 1, SHORTEST + 1).isin(sorted({s[: SHORTEST + 1] for s in starts})))
            for r in harmless.collect():
                if any(r.entry.startswith(s) for s in starts) and weight(r.toxic, r.other, n_toxic, n_other) <= 0:
                    lexicon[r.entry] = 0.0
        return lexicon | {phrase(p): 0.0 for p in EXCEPTIONS}

    lexicons = [lexicon_at(x) for x in levels]
    dropped(counted)
    return lexicons, (n_toxic, n_other)


def weight(toxic: float, other: float, n_toxic: float, n_other: float) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))


def evidence(toxic: int, all_: int, base: float) -> float:
    """Nats: number of documents times the divergence of their toxic share from the base rate."""
    p = toxic / all_ if all_ else 0
    if p <= base:
        return 0.0
    return all_ * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0))


def automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for e, w in lexicon.items():
        a.add_word(e, w)
    a.make_automaton()
    return a


def features(found: float, n_words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(100 * found / max(n_words, 20)), math.log1p(found)


def total_weight(a: ahocorasick.Automaton, folded: str) -> float:
    return sum(w for _, w in a.iter_long(folded)) if len(a) and folded else 0.0


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge; a prior keeps the intercept at a rare class where labels lack."""
    b = np.zeros(x.shape[1])
    if not len(y):
        return np.array([-3.0, 1.5, 1.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        b = b + np.linalg.solve(x.T @ (x * w[:, None]) + 0.05 * np.eye(len(b)), x.T @ (y - p) - 0.05 * b)
    return b


def scorer(lexicon: dict[str, float], curve: list[float]):
    a, folded = automaton(lexicon), _Folded()

    def score(text: str | None) -> float:
        joined, n = folded.text(text)
        z = sum(b * x for b, x in zip(curve, features(total_weight(a, joined), n), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def scored(docs: DataFrame, lexicon: dict[str, float], curve: list[float]) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(lexicon, curve)
        for ids, texts in batches(rows, "doc_id", "text"):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def measured(rows: DataFrame, lexicons: list[dict[str, float]]) -> list[list[tuple[int, int, float, float]]]:
    """For each lexicon doc_id, toxic and the two features of every row, in order. ``rows``: at most a sample."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, folded = [automaton(x) for x in lexicons], _Folded()
        for ids, texts, toxic in batches(parts, "doc_id", "text", "toxic"):
            joined = [folded.text(t) for t in texts]
            for k, a in enumerate(found):
                x = [features(total_weight(a, j), n)[1:] for j, n in joined]
                yield pa.record_batch([pa.array([k] * len(x), pa.int32()), pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], names=["k", "doc_id", "y", "a", "b"])

    out: list[list] = [[] for _ in lexicons]
    for r in rows.select("doc_id", "text", "toxic").mapInArrow(run, "k int, doc_id long, y int, a double, b double").collect():  # a few numbers a row of the sample
        out[r.k].append((r.doc_id, r.y, r.a, r.b))
    return [sorted(x) for x in out]


def curve_of(rows: list[tuple[int, int, float, float]]) -> np.ndarray:
    return fit(np.array([[1.0, a, b] for *_, a, b in rows]).reshape(-1, 3), np.array([float(y == 1) for _, y, *_ in rows]))


def chosen(rows: DataFrame) -> float:
    """The level of evidence whose lexicon, learned from a part of the sample, finds the toxic rows of the other part best.

    Best is the largest F1 at ``THRESHOLD``, of equal ones the highest level; without toxic rows in both parts it is ``CHANCE``.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    teach, check = rows.where(part == 2), rows.where(part == 0)
    if any(x.where("toxic = 1").isEmpty() for x in (teach, check)):
        return CHANCE
    lexicons, _ = learned(teach, list(LEVELS))
    best = []
    for level, known, unseen in zip(LEVELS, measured(teach, lexicons), measured(check, lexicons), strict=True):
        curve = curve_of(known)
        said = [(1 / (1 + math.exp(-max(-30.0, min(30.0, float(curve @ (1.0, a, b)))))) >= THRESHOLD, y == 1) for _, y, a, b in unseen]
        both, either = sum(p and y for p, y in said), sum(p + y for p, y in said)
        best.append((2 * both / either, level))
    return max(best)[1]


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    rows = stored(once(labelled(docs, labels, sample)), "toxic-sample")
    lexicon, _ = learn(rows, chosen(rows))
    curve = curve_of(measured(rows, [lexicon])[0])
    dropped(rows)
    return lexicon, curve.tolist()


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs, *model(docs, labels, sample))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns and without any shuffle."""
    lexicon, curve = model(docs, labels, sample)
    at = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(lexicon, curve)
        for b in rows:
            yield b.filter(pa.array([score(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
