"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

A text gives some twenty numbers: densities of abusive words, from a fixed list and from stems learned
here, how many of them stand near a second-person pronoun, shares of capitals, of punctuation and of
letters in disguise. A word is read in two forms. The plain one is lower-cased and stripped of what
surrounds it; the clear one also undoes disguise: digits and signs that stand for letters, characters
between letters, repeated letters, letters spaced out. What only the clear form shows is obfuscation.

Labels teach in three steps, each on rows of the training part alone: stems whose documents are toxic far
more often than chance, trees on the features, and, on a part that neither stems nor trees have seen, the
isotonic map from the trees' margin to a probability. All three use a bounded sample of labelled rows.
Stems and list are hashes of a bounded number; every text is then read once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm import textops
from barlake.llm.storage import discard, durable

MAX_LABELLED = 20_000  # rows that teach, drawn by a hash of their id
FOLDS = 5  # rows whose id's checksum leaves 0 are never learnt from; those that leave 4 calibrate
MAX_STEMS = 512
LEAST_Z, LEAST_DOCS = 4.0, 3
STEM_BYTES = (4, 5, 6, 8)
NEAR = 5  # words between an abusive word and a pronoun
TREES, DEPTH, STEP = 20, 3, 0.3

# Common words of abuse and second-person pronouns in the four languages.
ABUSE = """
asshole bastard bitch clown coward creep crap cretin cunt degenerate despicable dick dimwit disgusting dumb dumbass
fool freak fuck garbage idiot idiotic imbecile jerk liar loser lowlife lunatic maggot moron moronic nobody parasite
pathetic pig rat retard scum scumbag shit slut stupid sucker swine trash twat ugly useless vermin vile wanker whore worthless
arschloch blödmann depp drecksack dumm dummkopf elend hässlich hurensohn idiotisch miststück nutzlos scheisse schlampe
schwachkopf trottel versager wertlos widerlich abruti connard connasse crétin débile enculé idiote imbécile inutile lamentable
merde minable nul ordure pauvre pourriture salaud salope stupide basura cabrón estúpido gilipollas idiota imbécil inútil
mierda patético perdedor puta repugnante tonto
""".split()
PRONOUNS = "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti tu usted ustedes vosotros".split()
# Signs that stand for letters.
DISGUISE = {"0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g"}

FEATURES = [
    "log_words", "word_length", "listed", "listed_count", "learned", "learned_count", "learned_weight", "learned_most", "near_you", "near_you_count", "pronouns", "capitals", "capital_words",
    "exclamation", "question", "punctuation", "digits", "repeated_signs", "disguised", "disguised_listed", "spaced", "repeated_words",
]

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGN = ~_LETTER & ~textops._SPACE
_JOINS = np.zeros(256, dtype=bool)
_JOINS[[ord("'"), ord("-")]] = True
_CLEAR = np.where(_LETTER, textops._LOWER, 0).astype(np.uint8)
for _sign, _letter in DISGUISE.items():
    _CLEAR[ord(_sign)] = ord(_letter)


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case."""
    out = textops._LOWER[data]
    if len(data) > 1:
        accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[accented] += 0x20
    return out


def _plain(words: textops.Words, low: np.ndarray) -> textops.Words:
    """Words from their first letter to their last one; empty without letters."""
    letters = np.flatnonzero(_LETTER[low])
    first, last = np.searchsorted(letters, words.starts), np.searchsorted(letters, words.ends)
    some = last > first
    starts, ends = words.starts.copy(), words.starts.copy()
    starts[some], ends[some] = letters[first[some]], letters[last[some] - 1] + 1
    return textops.Words(words.first, low, starts, ends, words.bounds)


def _clear(words: textops.Words, low: np.ndarray) -> textops.Words:
    """Words with disguise undone: signs for letters, other signs dropped, repeated letters once."""
    mapped = np.where(low >= 0x80, low, _CLEAR[low])
    at = np.flatnonzero(mapped)
    kept = mapped[at]
    starts = np.searchsorted(at, words.starts)
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (kept[1:] == kept[:-1]) & (kept[1:] < 0x80)
    again[starts[starts < len(at)]] = False
    at, kept = at[~again], kept[~again]
    return textops.Words(words.first, kept, np.searchsorted(at, words.starts), np.searchsorted(at, words.ends), words.bounds)


def _cut(words: textops.Words, size: int) -> textops.Words:
    return textops.Words(words.first, words.data, words.starts, np.minimum(words.ends, words.starts + size), words.bounds)


def _hashes_of(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the plain and of the clear forms of some words."""
    for words in textops.split_words(pa.array([" ".join(listed)])):
        low = _lowered(words.data)
        return tuple(np.unique(textops.word_hashes(form(words, low))) for form in (_plain, _clear))
    raise ValueError("no words")


class _Held:
    """Membership of hashes in a small sorted set, with a table of their high bits before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.high = np.zeros(1 << 16, dtype=bool)
        self.high[keys >> np.uint64(48)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are held, and their places in the set."""
        maybe = np.flatnonzero(self.high[h >> np.uint64(48)])
        if not len(self.keys):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]


def stem_hashes(clear: textops.Words) -> Iterator[np.ndarray]:
    """Hashes of whole words and of their first bytes; a word no longer than a stem gives its own again."""
    yield textops.word_hashes(clear)
    for size in STEM_BYTES:
        yield textops.word_hashes(_cut(clear, size), seed=size)


def _shares(words: textops.Words) -> tuple[textops.Words, textops.Words, np.ndarray]:
    low = _lowered(words.data)
    return _plain(words, low), _clear(words, low), low


class Reader:
    """Features of texts, given hashes and weights of the learned stems."""

    def __init__(self, stems: np.ndarray, weights: np.ndarray):
        (plain, clear), (you, _) = _hashes_of(ABUSE), _hashes_of(PRONOUNS)
        self.plain, self.clear, self.you, self.stems, self.weights = _Held(plain), _Held(clear), _Held(you), _Held(stems), weights

    def __call__(self, words: textops.Words) -> np.ndarray:
        """A row of FEATURES for each row of words."""
        rows, n = words.rows, len(words.starts)
        row = words.row_of_word()
        count = np.diff(words.bounds)
        per_word, chars = 1 / np.maximum(count, 1), np.zeros(rows)
        total = lambda where, weight=None: np.bincount(row[where], weight, minlength=rows)
        plain, clear, low = _shares(words)

        own = textops.word_hashes(plain)
        listed, shown = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        listed[self.plain.find(own)[0]] = True
        weight = np.zeros(n)
        for i, h in enumerate(stem_hashes(clear)):
            if i == 0:
                shown[self.clear.find(h)[0]] = True
            at, which = self.stems.find(h)
            np.maximum.at(weight, at, self.weights[which])
        raw, size = words.data, words.ends - words.starts
        # Letters one by one: runs of three or more words of one letter are read as one word.
        single = (clear.ends - clear.starts == 1) & (size <= 2)
        spaced, spelled = _runs(words, single, clear, self.clear)
        hidden = shown & ~listed | spelled
        hit = listed | shown | spelled | (weight > 0)

        you = np.zeros(n, dtype=bool)
        you[self.you.find(own)[0]] = True
        seen = np.concatenate([[0], np.cumsum(you)])
        begins, ends = np.repeat(words.bounds[:-1], count), np.repeat(words.bounds[1:], count)
        place = np.arange(n)
        near = hit & (seen[np.minimum(place + NEAR + 1, ends)] > seen[np.maximum(place - NEAR, begins)])

        # Sums over the bytes of words, by the words' bounds.
        over = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.stack([words.starts, words.ends])], axis=0)[0]
        capital = (raw >= 0x41) & (raw <= 0x5A)
        accented = (low != raw) & (raw >= 0x80)
        capital |= accented
        capital[:-1] |= accented[1:]
        letters, capitals, signs = over(_LETTER[raw]), over(capital), over(_SIGN[raw])
        sign = _SIGN[raw]
        twice = np.zeros(len(raw), dtype=bool)
        twice[1:] = sign[1:] & (raw[1:] == raw[:-1])
        within = over(sign & ~_JOINS[raw]) - _outside(words, plain, sign & ~_JOINS[raw])
        disguised = (within > 0) & (letters >= 2)
        repeated = np.zeros(n, dtype=bool)
        repeated[1:] = (own[1:] == own[:-1]) & (row[1:] == row[:-1])

        chars = np.maximum(total(slice(None), size), 1)
        some_letters = np.maximum(total(slice(None), letters), 1)
        most = np.zeros(rows)
        np.maximum.at(most, row, weight)
        columns = [
            np.log1p(count), chars * per_word, total(listed | shown) * per_word, np.log1p(total(listed | shown)), total(weight > 0) * per_word, np.log1p(total(weight > 0)),
            total(slice(None), weight) * per_word, most, total(near) * per_word, np.log1p(total(near)), total(you) * per_word, total(slice(None), capitals) / some_letters,
            total((capitals == letters) & (letters > 2)) * per_word, total(slice(None), over(raw == ord("!"))) / chars, total(slice(None), over(raw == ord("?"))) / chars,
            total(slice(None), signs) / chars, total(slice(None), over((raw >= 0x30) & (raw <= 0x39))) / chars, total(slice(None), over(twice)) / chars,
            total(disguised) * per_word, np.log1p(total(hidden)), total(spaced) * per_word, total(repeated) * per_word,
        ]
        return np.stack(columns, axis=1)


def _outside(words: textops.Words, plain: textops.Words, flags: np.ndarray) -> np.ndarray:
    """Flagged bytes of each word before its first and after its last letter; all of a word without letters."""
    at = np.concatenate([[0], np.cumsum(flags)])
    return at[plain.starts] - at[words.starts] + at[words.ends] - at[plain.ends]


def _runs(words: textops.Words, single: np.ndarray, clear: textops.Words, held: _Held) -> tuple[np.ndarray, np.ndarray]:
    """Words in runs of three or more single letters; first words of runs that spell a held word."""
    n = len(single)
    spaced, spelled = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if not single.any():
        return spaced, spelled
    first = np.zeros(n + 1, dtype=bool)
    first[words.bounds] = True  # a run doesn't pass from row to row
    starts = np.flatnonzero(single & (first[:-1] | ~np.concatenate([[False], single[:-1]])))
    ends = np.flatnonzero(single & (first[1:] | ~np.concatenate([single[1:], [False]]))) + 1
    long = ends - starts >= 3
    starts, ends = starts[long], ends[long]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        spaced[a:b] = True
    if len(starts):
        # The letters of a run follow one another in the cleared bytes.
        joined = textops.Words(0, clear.data, clear.starts[starts], clear.ends[ends - 1], np.array([0, len(starts)]))
        spelled[starts[held.find(textops.word_hashes(joined))[0]]] = True
    return spaced, spelled


def _stems_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, toxic): each stem once for each document."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for words in textops.split_words(batch.column(0)):
            _, clear, _ = _shares(words)
            row = words.row_of_word()
            for h in stem_hashes(clear):
                pairs = np.unique(np.stack([row.astype(np.uint64), h]), axis=1)
                own = toxic[words.first + pairs[0].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(own.astype(np.int64))], names=["stem", "toxic"])


def learn_stems(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of at most MAX_STEMS stems that (text, toxic) rows show to be abusive.

    The weight is the logarithm of how much likelier a toxic document is to hold the stem; the standard
    error of that logarithm must be less than its LEAST_Z-th part.
    """
    n, bad = texts.agg(F.count("*"), F.sum("toxic")).first()
    bad = float(bad or 0)
    counts = texts.select("text", "toxic").mapInArrow(_stems_of, "stem long, toxic long").groupBy("stem").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    a, b = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    weight = F.log(a / (bad + 1)) - F.log(b / (n - bad + 1))
    chosen = counts.filter(F.col("bad") >= LEAST_DOCS).withColumn("weight", weight).withColumn("z", weight / F.sqrt(1 / a + 1 / b)).filter(F.col("z") >= LEAST_Z)
    found = chosen.orderBy(F.desc("z"), "stem").limit(MAX_STEMS).select("stem", "weight").collect()  # a bounded number
    stems = np.array([r.stem for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(stems)
    return stems[order], np.array([r.weight for r in found])[order]


def with_features(rows: DataFrame, stems: np.ndarray, weights: np.ndarray) -> DataFrame:
    """The rows' columns but for ``text``, and the features of their texts."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems, weights)
        for batch in batches:
            parts = [reader(words) for words in textops.split_words(batch.column("text"))]
            found = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], names=names + FEATURES)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"{f} double" for f in FEATURES)])
    return rows.select(*names, "text").mapInArrow(read, schema)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, fold) of about ``most`` labelled rows at most, outside the held-out part, drawn by a hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(remainder(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    chosen = F.broadcast(known)  # its size is bounded by ``most``
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", remainder(F.col("doc_id")).alias("fold"))


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score in [0, 1], predicted.

    ``held_out`` rows, whose id's checksum is divisible by 5, teach nothing; languages, sources, ids and labels
    are no inputs of a score. ``predicted`` is 1 where the score is at least 0.5. Null texts are read as
    empty and scored like all others. Of labels that repeat an id the largest holds; null labels and ids are
    passed over; rows that repeat an id are scored one by one. Without both classes among the rows that teach,
    every score is the share of toxic ones among them (0 without any). A null id is not held out. An empty
    table gives no rows; further columns are not read.
    """
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    sample = durable(labelled_sample(docs, labels, max_labelled), "labelled")
    counts = {r.part: (r.n, r.bad) for r in sample.groupBy((F.col("fold") == FOLDS - 1).alias("part")).agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
    n, bad = (sum(c[i] for c in counts.values()) for i in (0, 1))
    n_fit, bad_fit = counts.get(False, (0, 0))
    if not 0 < bad_fit < n_fit:
        constant = F.lit(bad / n if n else 0.0)
        return rows.select("doc_id", "held_out", constant.alias("score"), (constant >= 0.5).cast("int").alias("predicted"))

    fitting = F.col("fold") != FOLDS - 1
    stems, weights = learn_stems(sample.filter(fitting))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    known = durable(with_features(sample, stems, weights), "features")
    boosted = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=3, seed=13)
    trees = boosted.fit(assembler.transform(known.filter(fitting).coalesce(4)))

    def margin(df: DataFrame) -> DataFrame:
        out = trees.transform(assembler.transform(df))
        return out.withColumn("margin", vector_to_array("rawPrediction")[1])

    calibrating = known if counts.get(True, (0, 0))[0] == 0 else known.filter(~fitting)
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="calibrated").fit(margin(calibrating).select("margin", F.col("toxic").cast("double")))
    discard(sample, known)
    scored = isotonic.transform(margin(with_features(rows, stems, weights)))
    # Steps of the isotonic map are flat: a thousandth of the margin's own probability orders what shares a step.
    value = 0.999 * F.col("calibrated") + 0.001 / (1 + F.exp(-2 * F.col("margin")))
    value = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", "held_out", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
