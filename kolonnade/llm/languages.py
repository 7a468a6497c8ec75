"""Language of documents and of their sentences by error-correcting output codes.

Every language has a codeword; one binary classifier a bit, on hashed character n-grams inside words, says
on which side of the bit's split of the languages a sentence lies. Decoding sums the logistic losses of all
bits against each codeword and takes the least; the softmax of the negative losses is the confidence, and
the gap between the two nearest codewords flags ambiguous sentences.

The classifiers are fitted on a bounded sample of labelled documents (`PER_LABEL` a language). Labels may be
wrong: after a first fit, sentences that it reads otherwise than their label are left out of the second.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kolonnade.functions.keys import ident

#: Notations of the eight languages; the part after - or _ (a region) is dropped before.
NOTATIONS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "ru": ("ru", "rus", "russian", "русский"),
}
LANGUAGES = tuple(NOTATIONS)

#: The sample the classifiers are fitted on: documents a language, and their greatest length in characters.
PER_LABEL, SAMPLE_CHARS = 600, 20_000
BITS = 15
FEATURES = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Confidence with which a sentence tells its language, and a sentence of fewer words than `LEAST_WORDS`.
LEAST_WORDS = 4
SURE, SURE_SHORT = 0.9, 0.995
#: Texts without labels that function words label, to fit on them.
SAMPLE = 30_000
#: Scale of the mean log odds of a sentence's n-grams before the loss.
SCALE = 0.25

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SQL = re.compile(r"(?:\bWITH\s+\w+\s+AS\s*\(\s*)?\bSELECT\s.+?(?=[ \t]+[^\W\d_a-z][^\W\d_A-Z]+(?:'[^\W\d_]+)?[ \t]+[^\W\d_A-Z]+\s|;|\n(?!\s*(?:FROM|WHERE|GROUP|ORDER|LEFT|INNER|JOIN|ON|AND|OR|HAVING|LIMIT|UNION|SELECT)\b)|\Z)", re.S)
_QUOTED = re.compile(r"^[ \t]*>[ \t]?", re.M)
_WRAP = re.compile(r"(?<=[^\s.!?:;])\n[ \t]*>[ \t]?(?=[^\W\d_])")
_STOP = re.compile(r"[.!?…]+(?=[\s\"'»“”)*_<]|\Z)|\n+")
_WORD = re.compile(r"[^\W_][\w.]*(?<=\w)")
_NATURAL = re.compile(r"[^\W\d_]+\Z")


def label_of(c: Column) -> Column:
    """One of `LANGUAGES` for a label in any of their notations, else null."""
    base = F.element_at(F.split(ident(c), "[-_]"), 1)
    return F.coalesce(*[F.when(base.isin(*names), F.lit(code)) for code, names in NOTATIONS.items()])


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """(n, bits) of +1 and -1: of many random codes the one whose nearest rows are farthest apart.

    Every bit splits the languages, from four on with two at least on either side.
    """
    if n < 2:
        return np.ones((n, bits), np.float32)
    rng, best, gap = np.random.default_rng(1), None, -1
    pool = rng.choice([-1, 1], (n, 4000))
    pool = pool[:, abs(pool.sum(axis=0)) < (n - 2 if n > 3 else n)]
    for _ in range(3000):
        code = pool[:, rng.integers(pool.shape[1], size=bits)]
        far = (bits - code @ code.T)[~np.eye(n, dtype=bool)].min() // 2
        if far > gap:
            best, gap = code, far
    return best.astype(np.float32)


class _Natural(dict):
    """Words in lower case, names as empty strings; forgotten from time to time."""

    def __missing__(self, w: str) -> str:
        if len(self) > 200_000:
            self.clear()
        natural = self[w] = w.lower() if _NATURAL.match(w) and (w[1:].islower() or len(w) == 1) else ""
        return natural


_natural = _Natural()


def natural_words(sentence: str) -> list[str]:
    """Lower-case words without names: no digits, underscores, inner dots or capitals, no words in capitals."""
    return list(filter(None, map(_natural.__getitem__, _WORD.findall(sentence))))


def sentences(text: str) -> Iterator[tuple[int, int, bool, str]]:
    """(begin, end, full, prose) of the prose stretches of a text, code left out; full ones end with a stop."""
    blank = lambda m: " " * (m.end() - m.start())
    if "```" in text:
        text = _FENCE.sub(lambda m: "\n" * (m.end() - m.start()), text)
    if "SELECT" in text:
        text = _SQL.sub(lambda m: "\n" * (m.end() - m.start()), text)
    if ">" in text:
        text = _WRAP.sub(blank, text)
        text = _QUOTED.sub(blank, text)
    at = 0
    for m in _STOP.finditer(text):
        full = m.group()[0] != "\n"
        if m.start() > at:
            end = m.end() if full else m.start()
            yield at, end, full, text[at:end]
        at = m.end()
    if at < len(text):
        yield at, len(text), False, text[at:]


def _grams(word: str) -> np.ndarray:
    """Hashed n-grams of a word between word boundaries."""
    c = np.frombuffer(f" {word} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h >> np.uint64(20))
    return (np.concatenate(out) % np.uint64(FEATURES)).astype(np.int64)


@dataclass
class Model:
    """weights (features, bits): log odds of each n-gram for each bit; code (languages, bits)."""

    languages: tuple[str, ...]
    weights: np.ndarray
    code: np.ndarray

    def reader(self) -> "Reader":
        return Reader(self)


class _Words(dict):
    """Numbers of words; their summed log odds and numbers of n-grams are the rows of `rows`."""

    def __init__(self, model: Model, limit: int):
        self.model, self.limit = model, limit
        self.rows = np.zeros((1024, BITS + 1), np.float32)

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        if n >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        g = _grams(w)
        self.rows[n, :BITS] = self.model.weights[g].sum(axis=0)
        self.rows[n, BITS] = len(g)
        return n


class Reader:
    """Scores sentences; remembers the summed log odds of words it has seen."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.known = _Words(model, limit)

    def read(self, batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, confidence and ambiguity of each list of words (none empty). A model of one language knows no other."""
        if len(self.model.languages) == 1:
            return np.zeros(len(batch), int), np.ones(len(batch)), np.zeros(len(batch), bool)
        if len(self.known) > self.limit:
            self.known = _Words(self.model, self.limit)
        sizes = np.fromiter(map(len, batch), np.int64, len(batch))
        ids = np.fromiter(map(self.known.__getitem__, (w for ws in batch for w in ws)), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(self.known.rows[ids].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
        margin = SCALE * sums[:, :-1] / np.sqrt(sums[:, -1:])
        # log(1 + e^-m) of both signs of each bit; a codeword takes one of them.
        plus, minus = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        one = (self.model.code > 0).astype(np.float64)
        loss = plus @ one.T + minus @ (1 - one).T
        order = np.sort(loss, axis=1)
        p = np.exp(order[:, :1] - loss)
        sure = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
        return loss.argmin(axis=1), sure, order[:, 1] - order[:, 0] < 2


def _fit(counts: np.ndarray, languages: tuple[str, ...]) -> Model:
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, np.zeros((FEATURES, BITS), np.float32), code)
    share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    plus = np.stack([share[code[:, b] > 0].mean(axis=0) for b in range(BITS)], axis=1)
    minus = np.stack([share[code[:, b] < 0].mean(axis=0) for b in range(BITS)], axis=1)
    return Model(languages, (np.log(plus) - np.log(minus)).astype(np.float32), code)


def train(labelled: Iterable[tuple[str, str]]) -> Model | None:
    """A model from (label, text) pairs; None without any."""
    known: dict[str, np.ndarray] = {}
    rows: list[tuple[str, list[str]]] = []
    for label, text in labelled:
        for _, _, full, prose in sentences(text):
            ws = natural_words(prose)
            if full and len(ws) >= LEAST_WORDS:
                rows.append((label, ws))
    languages = tuple(x for x in LANGUAGES if any(label == x for label, _ in rows))
    if not languages:
        return None

    def counted(kept: Iterable[tuple[str, list[str]]]) -> np.ndarray:
        counts = np.zeros((len(languages), FEATURES))
        for (label, w), n in Counter((label, w) for label, ws in kept for w in ws).items():
            if w not in known:
                known[w] = _grams(w)
            np.add.at(counts[languages.index(label)], known[w], n)
        return counts

    model = _fit(counted(rows), languages)
    read = model.reader().read([ws for _, ws in rows])[0]
    return _fit(counted(r for r, k in zip(rows, read) if languages[k] == r[0]), languages)


def fit(documents: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Train on at most `per_label` documents of each language, picked by a hash of their text."""
    label = label_of(F.col("lang"))
    some = documents.where(f"length(text) between 1 and {SAMPLE_CHARS}").select(label.alias("label"), "text").where("label is not null")
    pick = W.partitionBy("label").orderBy(F.xxhash64("text"), "text")
    rows = some.withColumn("rn", F.row_number().over(pick)).where(F.col("rn") <= per_label).select("label", "text").collect()
    return train((r["label"], r["text"]) for r in rows)


def _sentences(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    reader = model.reader()
    for frame in frames:
        spans, batch = [], []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            for begin, end, full, prose in sentences(text):
                ws = natural_words(prose)
                if ws:
                    spans.append((doc, begin, end, full, len(ws)))
                    batch.append(ws)
        if batch:
            lang, sure, unsure = reader.read(batch)
            out = pd.DataFrame(spans, columns=["doc_id", "begin", "end", "full", "n_words"])
            yield out.assign(lang=[model.languages[k] for k in lang], confidence=sure, ambiguous=unsure)


SENTENCES = "doc_id long, begin int, end int, full boolean, n_words int, lang string, confidence double, ambiguous boolean"
STRETCHES = "doc_id long, begin int, end int, lang string, n_sentences int, n_words int, confidence double"


def _read(documents: DataFrame, model: Model | None, reading, shape: str) -> DataFrame:
    model = model or fit(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    if model is None:
        return documents.sparkSession.createDataFrame([], shape)
    return rows.mapInPandas(lambda fs: reading(fs, model), shape)


def sentence_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, begin, end, full, n_words, lang, confidence, ambiguous): the prose sentences of all documents.

    Sentences of names and digits alone, SQL, tables and fenced code have no language. Null and empty texts and
    null ids give no rows; repeated rows give repeated rows. Without any labelled document there is no model and
    the result is empty.
    """
    return _read(documents, model, _sentences, SENTENCES)


def settled(n_words: int, confidence: float, ambiguous: bool) -> bool:
    """Whether a sentence alone tells its language: few words do only with more confidence."""
    return not ambiguous and confidence >= (SURE if n_words >= LEAST_WORDS else SURE_SHORT)


def _stretches(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """Runs of sentences of one language. Sentences that don't tell go with the run before them, else with the one after."""
    for frame in _sentences(frames, model):
        rows: list[list] = []
        waiting: list[tuple] = []
        last = None
        for doc, begin, end, n, lang, sure, unsure in zip(*(frame[c].tolist() for c in ("doc_id", "begin", "end", "n_words", "lang", "confidence", "ambiguous"))):
            if doc != last or rows and begin < rows[-1][2] or waiting and begin < waiting[-1][2]:
                # Another document, or a repeated row of the same.
                rows += _unsettled(waiting)
                waiting, last, fresh = [], doc, True
            if not settled(n, sure, unsure):
                if fresh:
                    waiting.append((doc, begin, end, lang, 1, n, sure * n))
                else:
                    rows[-1][2], rows[-1][4], rows[-1][5] = end, rows[-1][4] + 1, rows[-1][5] + n
                    rows[-1][6] += sure * n * (lang == rows[-1][3])
                continue
            if fresh or rows[-1][3] != lang:
                rows.append([doc, begin, end, lang, 0, 0, 0.0])
                for _, b, _, other, k, m, c in waiting:
                    rows[-1][1], rows[-1][4], rows[-1][5] = min(b, rows[-1][1]), rows[-1][4] + k, rows[-1][5] + m
                    rows[-1][6] += c * (other == lang)
                waiting, fresh = [], False
            rows[-1][2], rows[-1][4], rows[-1][5], rows[-1][6] = end, rows[-1][4] + 1, rows[-1][5] + n, rows[-1][6] + sure * n
        rows += _unsettled(waiting)
        out = pd.DataFrame(rows, columns=["doc_id", "begin", "end", "lang", "n_sentences", "n_words", "confidence"])
        yield out.assign(confidence=out["confidence"] / out["n_words"])


def _unsettled(waiting: list[tuple]) -> list[list]:
    """Sentences of a document none of which tells: one stretch of the language with the largest sum of confidence."""
    if not waiting:
        return []
    sums: dict[str, float] = {}
    for _, _, _, lang, _, _, c in waiting:
        sums[lang] = sums.get(lang, 0.0) + c
    lang = max(sorted(sums), key=sums.__getitem__)
    return [[waiting[0][0], waiting[0][1], waiting[-1][2], lang, len(waiting), sum(w[5] for w in waiting), sums[lang]]]


def language_stretches(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, begin, end, lang, n_sentences, n_words, confidence): each document cut where its language changes.

    `begin` and `end` are places of characters. Sentences too short or too alike between languages to tell go
    with their neighbours; the confidence of a stretch is the mean over its words, where those sentences count
    with what they give its language. Nulls and repeated rows as in `sentence_languages`; a document whose
    sentences all fail to tell is one stretch of low confidence; one without prose has none.
    """
    return _read(documents, model, _stretches, STRETCHES)


def document_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, n_sentences, n_words, confidence): the languages in which a document has a full sentence.

    The confidence is the mean over the sentences, weighted by words. Sentences that don't tell their language
    alone don't count, unless no sentence of the document does: then the language with the largest sum of
    confidence is given, with its low confidence (their share of all words).
    """
    settled = ~F.col("ambiguous") & (F.col("confidence") >= F.when(F.col("n_words") >= LEAST_WORDS, SURE).otherwise(SURE_SHORT))
    full = sentence_languages(documents, model).where("full").withColumn("settled", settled).drop("full").distinct()
    weight = F.col("confidence") * F.col("n_words")
    by = full.groupBy("doc_id", "lang").agg(
        F.count_if("settled").alias("s_sentences"), F.sum(F.when(F.col("settled"), F.col("n_words"))).alias("s_words"), F.sum(F.when(F.col("settled"), weight)).alias("s_weight"),
        F.count("*").alias("sentences"), F.sum("n_words").alias("words"), F.sum(weight).alias("weight"),
    )
    # At most as many rows a document as there are languages.
    doc = W.partitionBy("doc_id")
    by = by.withColumns({"told": F.max("s_sentences").over(doc) > 0, "all_words": F.sum("words").over(doc), "place": F.row_number().over(doc.orderBy(F.desc("weight"), "lang"))})
    told = F.col("told")
    return by.where(F.when(told, F.col("s_sentences") > 0).otherwise(F.col("place") == 1)).select(
        "doc_id", "lang", F.when(told, F.col("s_sentences")).otherwise(F.col("sentences")).alias("n_sentences"), F.when(told, F.col("s_words")).otherwise(F.col("words")).cast("long").alias("n_words"),
        F.when(told, F.col("s_weight") / F.col("s_words")).otherwise(F.col("weight") / F.col("all_words")).alias("confidence"),
    )


def relabelled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang) of documents whose label is missing, undetermined or wrong, or that mix languages."""
    found = document_languages(documents, model)
    labels = documents.select(F.col("doc_id").cast("long").alias("doc_id"), label_of(F.col("lang")).alias("label")).where("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    many = W.partitionBy("doc_id")
    return (
        found.join(labels, "doc_id")
        .withColumn("n", F.count("*").over(many))
        .where(F.col("label").isNull() | (F.col("n") > 1) | (F.col("label") != F.col("lang")))
        .select("doc_id", "lang")
    )


#: Frequent function words, to label sentences where no labels are given.
FUNCTION_WORDS = {
    "en": "the of and to is in that for with which when this from are not by",
    "de": "der die das und ist nicht mit für ein eine den dem von zu wenn auf",
    "fr": "le les des une est dans pour qui que avec sur pas du la et au",
    "es": "el los las una es en para que con por del la y se al su",
    "it": "il gli della una è per che con di non dei nel la le sono si",
    "pt": "o os das uma é em para que com não do da as na ao um",
    "nl": "het een van is en voor dat met niet de op als wordt zijn door naar",
    "ru": "и в не на что с по для это как из от к при если у",
}


def seeded(ws: list[str]) -> str | None:
    """The language whose function words a sentence holds, if there are three and twice as many as of any other."""
    held = set(ws)
    counts = sorted(((len(held & s), x) for x, s in _FUNCTION_SETS.items()), reverse=True)
    return counts[0][1] if counts[0][0] >= 3 and counts[0][0] >= 2 * counts[1][0] else None


_FUNCTION_SETS = {x: frozenset(s.split()) for x, s in FUNCTION_WORDS.items()}


def fit_unlabelled(texts: DataFrame, per_label: int = PER_LABEL, sample: int = SAMPLE) -> Model | None:
    """Like `fit`, for a column `text` without labels: function words label about `sample` texts, picked by a hash."""

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(label=[seeded([w for *_, prose in sentences(t) for w in natural_words(prose)]) for t in f["text"]])

    usable = texts.where(f"length(text) between 20 and {SAMPLE_CHARS}").select("text", F.xxhash64("text").alias("h"))
    # Rows of one text go or stay together.
    parts = max(1, usable.count() // sample)
    some = usable.where(F.pmod("h", F.lit(parts)) == 0).select("text").distinct().mapInPandas(label, "text string, label string").where("label is not null")
    pick = W.partitionBy("label").orderBy(F.xxhash64("text"), "text")
    rows = some.withColumn("rn", F.row_number().over(pick)).where(F.col("rn") <= per_label).select("label", "text").collect()
    return train((r["label"], r["text"]) for r in rows)
