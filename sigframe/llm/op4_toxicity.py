"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, takes accents off, and turns homoglyphs, digits and signs that stand for letters (inside a word
only) into these letters; all else becomes a space. The lexicon holds whole words, which match with a plural's ending
too, and stems, which match the beginning of any word. A stem must begin several words of toxic texts, so that one word
never becomes a shorter beginning that harmless words have too. Weights are the log of how much oftener an entry stands
in toxic than in other labelled texts, less a standard error. A text's raw score is the sum of its hits' weights,
without hits inside an exception phrase (fixed ones, and pairs of words that clean labelled texts have around hits),
over the logarithm of its words; a logistic curve fitted to the labelled rows makes it a score from 0 to 1.

Labels are learned from at most `MOST_LABELLED` rows (of lowest hash of the id) outside the held-out fold, near copies
taken once; all other work covers all rows. Null texts are empty and score as texts without hits; very long texts are
read whole; a null doc_id is never held out; repeated rows each get a row; an empty table gives no row; without labels
nothing is toxic. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm.common import cut, make_room, pieces, read, text_of

#: Characters that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Signs that stand for letters inside a word and for themselves at its end.
SIGNS = re.compile(r"[!|$@]++(?![^\W_])")
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "trash pickup", "trash folder", "trash compactor", "take out the trash",
    "clown fish", "circus clown", "rodeo clown", "clown nose", "clown car", "clown shoes", "pond scum", "soap scum", "scum line", "stupid question", "stupid questions", "stupid mistake",
    "sore loser", "loser bracket", "losers bracket", "idiot proof", "idiot light", "pathetic fallacy", "village idiot",
)
MOST_LABELLED = 8_000
#: Letters of an entry; stems need more than whole words, and end where they tell enough.
SHORTEST_WORD = 3
SHORTEST, LONGEST = 4, 9
ENDINGS = ("", "s", "es")
#: Toxic texts that an entry must stand in, and words that a stem must begin.
LEAST_TEXTS = 6
LEAST_WORDS = 4
#: Least weight, by its lower bound at so many standard errors.
LEAST_WEIGHT = 1.0
SURE = 2.0
#: What a longer stem must add.
STEP = 0.3
#: Clean texts that hold a learned exception phrase, at so many times the toxic ones by their shares.
LEAST_CLEAN = 3
CLEANER = 4.0
THRESHOLD = 0.3
HELD_OUT = 2


class Folding(dict):
    """For str.translate: made for a character when it is first met."""

    def __missing__(self, code: int) -> str:
        c = LOOKALIKES.get(chr(code))
        if c is None:
            low = unicodedata.normalize("NFKD", chr(code)).lower()
            low = "".join(LOOKALIKES.get(x, x) for x in low if not unicodedata.combining(x))
            c = "".join(x for x in low if "a" <= x <= "z")
            if not c:
                c = "" if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf" else " "
        self[code] = c
        return c


_FOLDING = Folding()


def fold(text: str) -> str:
    return SIGNS.sub(" ", text).translate(_FOLDING)


@dataclass
class Lexicon:
    """Entries are whole words, or stems, which end with a hyphen."""

    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    level: float = -4.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        make_room()
        made = ahocorasick.Automaton()
        held: dict[str, tuple[int, float | None, float | None]] = {}  # a key's length, and its weights as word and stem
        for entry, weight in self.weights.items():
            for key, stem in [(entry[:-1], True)] if entry.endswith("-") else [(entry + e + " ", False) for e in ENDINGS]:
                _, a, b = held.get(" " + key, (0, None, None))
                if stem:
                    held[" " + key] = (len(key), None, weight)
                else:  # a word of its own before another's plural
                    held[" " + key] = (len(key) - 1, weight if a is None or key == entry + " " else a, None)
        for key, (length, a, b) in held.items():
            made.add_word(key, (length, b if a is None else a, key[-1] == " "))
        for phrase in self.exceptions:
            key = " " + " ".join(fold(phrase).split()) + " "
            if key not in held:
                made.add_word(key, (len(key) - 2, None, True))
        if len(made):
            made.make_automaton()
        return made

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.level + self.slope * raw))))


def hits(folded: str, automaton) -> dict[int, float]:
    """Weights by the place of the space before each word that an entry matches, outside of exception phrases: the
    whole word's weight, else the greatest of its stems'."""
    found: dict[int, tuple[bool, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight, whole) in automaton.iter(folded):
        start = end - length - whole
        if weight is None:
            excused.append((start, end))
        else:
            found[start] = max((whole, weight), found.get(start, (False, 0.0)))
    if excused and found:
        for a, b in excused:
            for start in [s for s in found if a <= s < b]:
                del found[start]
    return {s: w for s, (_, w) in found.items()}


def raw_score(text: str, automaton) -> tuple[float, int]:
    """The weights of hits over the logarithm of the number of words, and the number of hits."""
    words = fold(text).split()
    if not words or not len(automaton):
        return 0.0, 0
    found = hits(" " + " ".join(words) + " ", automaton)
    return sum(found.values()) / math.log2(8 + len(words)), len(found)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    fold_of = F.crc32(F.col("doc_id").cast("string")) % 4
    y = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold_of != HELD_OUT)
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(y), "doc_id").select("text", "toxic")


def _sketch(words: list[str]) -> int:
    """The two least hashes of three words in a row, as one number: mostly the same for near copies."""
    runs = {xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
    return xxhash.xxh3_64_intdigest(repr(sorted(runs)[:2])) - (1 << 63)


def weight_of(toxic: int, clean: int, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """The log of the ratio of shares, and its standard error."""
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)), math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _telling(n_toxic: int, n_clean: int) -> Column:
    """The same test as below on columns toxic and clean."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    return F.log(t / (n_toxic + 1.0)) - F.log(c / (n_clean + 1.0)) - SURE * F.sqrt(1 / t + 1 / c) >= LEAST_WEIGHT


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Lexicon:
    """A lexicon from at most `most` labelled rows; what comes to the driver is the entries that pass the test, pairs of
    words around them, and a number for each of these rows."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            folded = [fold(t).split() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in folded]), batch.column("toxic"), pa.array([_sketch(w) for w in folded], pa.int64())], ["folded", "toxic", "sketch"])

    rows = _labelled(docs, labels, most).mapInArrow(sketched, "folded string, toxic int, sketch bigint")
    rows = cut(rows.groupBy("sketch", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.min("folded").alias("folded")))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in pieces(batches):
            for text, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist()):
                words = {w for w in text.split() if len(w) >= SHORTEST_WORD}
                counts[toxic].update(words)
                counts[toxic].update({w[:i] + "-" for w in words for i in range(SHORTEST, min(LONGEST, len(w)) + 1)})
        keys = [*(counts[0].keys() | counts[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["term", "clean", "toxic"])

    summed = cut(rows.mapInArrow(terms, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    begun = summed.filter((F.col("toxic") > 0) & ~F.col("term").endswith("-"))
    begun = begun.select(F.explode(F.expr(f"transform(sequence({SHORTEST}, greatest({SHORTEST}, least({LONGEST}, length(term) - 1))), i -> concat(left(term, i), '-'))")).alias("stem")).groupBy("stem").agg(F.count("*").alias("words"))
    able = summed.filter((F.col("toxic") >= LEAST_TEXTS) & _telling(n_toxic, n_clean))
    able = able.join(begun, able["term"] == begun["stem"], "left").filter(~F.col("term").endswith("-") | (F.col("words") >= LEAST_WORDS))
    found = {r["term"]: (r["toxic"], r["clean"]) for r in able.select("term", "toxic", "clean").collect()}
    model = Lexicon(_chosen(found, n_toxic, n_clean))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in pieces(batches):
            for text, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist()):
                text, pairs = f" {text} ", set()
                for at in hits(text, machine) if len(machine) else ():
                    end = text.index(" ", at + 1)
                    before, after = text.rfind(" ", 0, at) if at else -1, text.find(" ", end + 1)
                    pairs |= {text[before + 1 : end]} if before >= 0 else set()
                    pairs |= {text[at + 1 : after]} if after >= 0 else set()
                counts[toxic].update(pairs)
        keys = [*(counts[0].keys() | counts[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["phrase", "clean", "toxic"])

    seen = rows.mapInArrow(around, "phrase string, clean bigint, toxic bigint").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = seen.filter((F.col("clean") >= LEAST_CLEAN) & (F.col("clean") / float(n_clean) >= CLEANER * (F.col("toxic") + 0.5) / n_toxic))
    model.exceptions += tuple(sorted(r["phrase"] for r in seen.collect()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in pieces(batches):
            raw = [raw_score(t, machine)[0] for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column("toxic")], ["raw", "toxic"])

    pairs = rows.mapInArrow(measure, "raw double, toxic int").collect()
    x, y = np.array([p["raw"] for p in pairs]), np.array([float(p["toxic"]) for p in pairs])
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton's method, with a little weight on small numbers as the classes may be separable
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -60, 60)))
        g = np.array([(p - y).sum() + 1e-2 * a, ((p - y) * x).sum() + 1e-2 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-9:
            break
    model.level, model.slope = a, max(b, 0.0)
    return model


def _chosen(found: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries by their weights, less a standard error: words, and of a stem and its longer forms those that tell more
    than all shorter ones."""
    lower = {t: w - e for t, n in found.items() for w, e in [weight_of(*n, n_toxic, n_clean)]}
    kept = {t: w for t, w in lower.items() if not t.endswith("-")}
    for term in sorted((t for t in lower if t.endswith("-")), key=lambda t: (len(t), t)):
        if lower[term] > max((kept[s] for i in range(SHORTEST, len(term) - 1) if (s := term[:i] + "-") in kept), default=0.0) + STEP:
            kept[term] = lower[term]
    return kept


def scored(docs: DataFrame, model: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in pieces(batches):
            found = [raw_score(t, machine) for t in batch.column("text").to_pylist()]
            score = [model.score(r) for r, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "held_out", "score", "predicted", "n_hits"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits bigint")


def keep_clean(docs: DataFrame, model: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    import ahocorasick  # noqa: F401  (executors need it; fail here rather than there)
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf
    from pyspark.sql.types import BooleanType

    def clean(texts):
        machine = model.automaton()
        for some in texts:
            yield some.map(lambda t: model.score(raw_score(t, machine)[0]) < threshold).astype(bool)

    clean.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.filter(pandas_udf(clean, BooleanType())(text_of()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, learn(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
