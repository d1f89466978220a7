"""Subject area of each document (problem 9).

Latent Dirichlet topics are fitted over all documents by distributed variational
expectation maximisation.  Every sentence draws one topic from its document's
proportions and its words from that topic: tasks infer the proportions and send
expected word counts, the driver holds only the word-topic table.

What a document repeats in several sentences is its matter, what it says in one
sentence only is manner.  The two kinds of use, counted over all documents, are
the priors of the topics and of a background topic; labelled examples are added to
the prior of one topic each.  The fitted topics are mapped to subjects through their
top terms, and a document's subjects are read from its topic proportions and the
topics of its sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .textform import folded

#: Words are hashed into so many term slots, which bounds the word-topic table (and its broadcast) at any size; no word is left out.
SLOTS = 1 << 20
#: Labelled examples read at most (the first by hash), with some thousand words each at most they are held on the driver.
MAX_EXAMPLES = 20_000
#: Words a line must have to be a sentence and no heading.
MIN_SENTENCE = 4
#: A word that so large a share of a language's documents hold is a stop word of the language.
COMMON_SHARE = 0.25
#: A label is a language if so large a share of the documents, and so many, bear it.
LANGUAGE_SHARE, LANGUAGE_DOCS = 0.001, 20
PASSES, INNER = 3, 4
#: Dirichlet priors of a document's proportions: each topic, the background.
ALPHA, ALPHA_BACKGROUND = 0.1, 0.1
#: Prior counts of a topic's words: for each use in an example, and all other words together.
SEED_WEIGHT, SMOOTH = 3.0, 50.0
#: Counts, all words together, by which the first word-topic table is held near the corpus: topics, background.
START, START_BACKGROUND = 200.0, 1000.0
#: Share of a word's uses that counts as either kind of use besides what was seen.
EITHER = 0.05
#: Words whose topics are inferred at once.
BATCH_WORDS = 400_000
#: Top terms of a topic that are looked at to name it.
TOP_TERMS = 40

_TAGS = r"</?[A-Za-z][^<>]{0,200}>"
_WRAPPED = r"\r?\n[ \t]{2,}(?=\S)"
_BREAKS = r"(?<=[.?!…])[\"')\]*]*\s+|[\r\n]+"
_WORDS = re.compile(r"[^\W\d_]{2,}")
#: Words of a plain text in lower case, and what ends its sentences.
_PLAIN = re.compile(r"[a-z]{2,}|[.?!][\"')\]*]*\s|[\r\n]")
#: Marks between the codes of words: the end of a sentence, of a document.
BREAK, END = -1, -2
_DAMAGED = re.compile("[ÃÂ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def repaired(text: str) -> str:
    """UTF-8 that was once read as Windows-1252, read anew, pair by pair."""

    def again(m: re.Match) -> str:
        try:
            return m[0].encode("cp1252").decode("utf-8")
        except UnicodeError:
            try:
                return m[0].encode("latin-1").decode("utf-8")
            except UnicodeError:
                return m[0]

    return _DAMAGED.sub(again, text)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence: consistent form, case folded, without numbers; lines end sentences unless the next is indented."""
    text = re.sub(_WRAPPED, " ", re.sub(_TAGS, "\n", repaired(text)))
    split = (_WORDS.findall(s.lower() if s.isascii() else folded(s)) for s in re.split(_BREAKS, text))
    return [s for s in split if s]


class Codes(dict):
    """32-bit code of each word met, BREAK for what ends a sentence."""

    def __missing__(self, token: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        code = self[token] = xxhash.xxh32_intdigest(token) if token[0].isalpha() else BREAK
        return code


def coded(text: str, codes: Codes) -> list[int]:
    """The codes of a text's words with BREAK between sentences; the same sentences as of ``sentences``."""
    if text.isascii():
        text = text.lower()
        if "<" in text:
            text = re.sub(_TAGS, "\n", text)
        if "\n" in text:
            text = re.sub(_WRAPPED, " ", text)
        return list(map(codes.__getitem__, _PLAIN.findall(text)))
    return [c for s in sentences(text) for c in (*map(codes.__getitem__, s), BREAK)]


def listed(values: np.ndarray, per_row: np.ndarray) -> pa.ListArray:
    """Arrow lists of so many values a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def _coded(rows: DataFrame, least: int) -> DataFrame:
    """rows (..., text) with terms (codes of the words of all sentences of least words or more) and sizes (words of each) for text."""
    kept = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            at = 0
            texts = batch.column("text")
            while at < len(texts):
                found, first = [], at
                while at < len(texts) and len(found) < BATCH_WORDS:
                    found += coded(texts[at].as_py(), codes)
                    found.append(END)
                    at += 1
                tokens = np.array(found, dtype=np.int64)
                words = tokens >= 0
                sentence = np.cumsum(~words)[words]  # number of the sentence of each word
                doc_of_sentence = np.concatenate(([0], np.cumsum(tokens == END)[~words]))
                sizes = np.bincount(sentence, minlength=len(doc_of_sentence))
                held = sizes >= least
                docs = at - first
                terms = tokens[words][held[sentence]].astype(np.uint32).view(np.int32)
                per_doc = np.bincount(doc_of_sentence[held], minlength=docs)[:docs]
                words_of_doc = np.bincount(doc_of_sentence[held], sizes[held], minlength=docs)[:docs].astype(np.int64)
                part = batch.slice(first, docs)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], listed(terms, words_of_doc), listed(sizes[held], per_doc)], names=[*kept, "terms", "sizes"])

    return rows.mapInArrow(read, schema).where(F.size("terms") > 0)


def _bags(rows: DataFrame, stop: np.ndarray) -> DataFrame:
    """rows (..., terms, sizes) of codes without stop words, the codes as slots."""
    kept = [c for c in rows.columns if c not in ("terms", "sizes")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches):
            sentence = np.repeat(np.arange(len(part.sizes)), part.sizes)
            told = np.ones(len(part.terms), dtype=bool)
            if len(stop):
                told = stop[np.minimum(np.searchsorted(stop, part.terms), len(stop) - 1)] != part.terms
            sizes = np.bincount(sentence[told], minlength=len(part.sizes))
            docs = len(part.doc_starts)
            doc_of = part.doc_of[sizes > 0]
            words = np.bincount(doc_of, sizes[sizes > 0], minlength=docs).astype(np.int64)
            left = batch.slice(part.first, docs)
            lists = [listed(part.terms[told] & (SLOTS - 1), words), listed(sizes[sizes > 0], np.bincount(doc_of, minlength=docs))]
            yield pa.RecordBatch.from_arrays([*[left.column(c) for c in kept], *lists], names=[*kept, "terms", "sizes"])

    return rows.mapInArrow(number, rows.schema).where(F.size("terms") > 0)


def _stop_words(words: DataFrame) -> np.ndarray:
    """Codes of the words that COMMON_SHARE of the documents of a language hold.

    Few by their nature: of a language at most the mean number of different words in a
    document over COMMON_SHARE, and of languages at most 1 / LANGUAGE_SHARE.
    """
    label = F.coalesce("lang", F.lit(""))
    named = words.groupBy(label.alias("lang")).agg(F.count("*").alias("docs"))
    whole = named.agg(F.sum("docs").alias("whole"))  # one row
    named = named.crossJoin(F.broadcast(whole)).where((F.col("docs") >= LANGUAGE_DOCS) & (F.col("docs") >= F.lit(LANGUAGE_SHARE) * F.col("whole"))).select("lang", "docs")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches):
            langs = batch.column("lang").slice(part.first, len(part.doc_starts)).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(part.doc_of, part.sizes).astype(np.int64)
            pairs = np.unique((doc << 32) | part.terms.view(np.uint32))
            keys, n = np.unique((codes[pairs >> 32] << 32) | (pairs & 0xFFFFFFFF), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(keys >> 32)), pa.array((keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"]
            )

    counts = words.select(label.alias("lang"), "terms", "sizes").mapInArrow(held, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    common = counts.join(named, "lang").where(F.col("n") > COMMON_SHARE * F.col("docs")).select("code").distinct()
    return np.sort(np.array([r["code"] for r in common.collect()], dtype=np.int32))  # bounded, see above


class Slice:
    """Some documents of an Arrow batch: slots of their words, words of each sentence, sentences of each document."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray, first: int):
        self.terms, self.sizes, self.first = terms, sizes, first
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.doc_starts = np.concatenate(([0], np.cumsum(per_doc)[:-1])).astype(np.int64)
        self.doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
        #: by the logarithm of its sentences, so that one long text does not outweigh the others
        self.weight = np.log1p(per_doc) / np.maximum(per_doc, 1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """The documents of Arrow batches with terms and sizes, about BATCH_WORDS words at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t, s = batch.column("terms"), batch.column("sizes")
        terms, sizes = t.flatten().to_numpy(zero_copy_only=False), s.flatten().to_numpy(zero_copy_only=False)
        t_ends, s_ends = np.cumsum(t.value_lengths().to_numpy(zero_copy_only=False)), np.cumsum(s.value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < len(t_ends):
            done, lines = (t_ends[at - 1], s_ends[at - 1]) if at else (0, 0)
            end = max(at + 1, int(np.searchsorted(t_ends, done + BATCH_WORDS, side="right")))
            yield batch, Slice(terms[done : t_ends[end - 1]], sizes[lines : s_ends[end - 1]], np.diff(np.concatenate(([lines], s_ends[at:end]))), at)
            at = end


class Model:
    """Word-topic table over the slots in use, and the prior of a document's proportions."""

    def __init__(self, slots: np.ndarray, phi: np.ndarray, alpha: np.ndarray):
        self.slots, self.phi, self.alpha = slots, phi, alpha
        self.log_phi = np.log(np.maximum(phi, 1e-12)).astype(np.float32)
        self.place = np.zeros(SLOTS, dtype=np.int32)
        self.place[slots] = np.arange(len(slots))

    def infer(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(sentences by topics: probability; documents by topics: expected sentences)."""
        rows = self.place[part.terms]
        like = np.zeros((len(part.sizes), len(self.alpha)), dtype=np.float32)
        for a in range(0, len(rows), BATCH_WORDS):  # one document may be long
            b = min(a + BATCH_WORDS, len(rows))
            first, last = np.searchsorted(part.starts, [a, b - 1], side="right") - 1
            like[first : last + 1] += np.add.reduceat(self.log_phi[rows[a:b]], np.maximum(part.starts[first : last + 1], a) - a, axis=0)
        like -= like.max(axis=1, keepdims=True)
        theta = np.ones((len(part.doc_starts), len(self.alpha)), dtype=np.float32)
        np.exp(like, out=like)  # 1 for the likeliest topic
        for _ in range(INNER):
            q = like * theta[part.doc_of]
            q /= q.sum(axis=1, keepdims=True)
            held = np.add.reduceat(q, part.doc_starts, axis=0)
            theta = held + self.alpha
        return q, held


def _summed(bags: DataFrame, names: list[str], gather) -> pd.DataFrame:
    """Sums over all documents by slot: gather gives (slots, table of names by slots) for each slice; a row per slot in use comes back."""
    fields = [("slot", pa.int32()), *[(n, pa.float64()) for n in names]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        total = np.zeros((len(names), 0))
        add = gather()
        for _, part in slices(batches):
            for slot_rows, table in add(part):
                if held is None:
                    held, total = slot_rows, table.astype(float)
                elif held is slot_rows:
                    total += table
                else:
                    merged, at = np.unique(np.concatenate([held, slot_rows]), return_inverse=True)
                    both = np.zeros((len(names), len(merged)))
                    both[:, at[: len(held)]] = total
                    both[:, at[len(held) :]] += table
                    held, total = merged, both
        if held is not None:
            used = total.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(held[used].astype(np.int32)), *[pa.array(row[used]) for row in total]], schema=pa.schema(fields))

    parts = bags.select("terms", "sizes").mapInArrow(partial, ", ".join(["slot int", *[f"{n} double" for n in names]]))
    return parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).orderBy("slot").toPandas()  # at most SLOTS rows


def _documents() -> object:
    """Documents that hold a slot's words in one sentence, and in several."""

    def add(part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sentence = np.repeat(np.arange(len(part.sizes)), part.sizes)
        held = np.unique(sentence * SLOTS + part.terms)
        pairs, n = np.unique(part.doc_of[held // SLOTS] * SLOTS + held % SLOTS, return_counts=True)
        slot, back = np.unique(pairs % SLOTS, return_inverse=True)
        yield slot, np.stack([np.bincount(back, n == 1, len(slot)), np.bincount(back, n > 1, len(slot))])

    return add


def top_rows(phi: np.ndarray, frequency: np.ndarray, top: int = TOP_TERMS) -> np.ndarray:
    """Topics by rows of the terms that tell most of each: its use of a term by the logarithm of how much more it uses it than the corpus."""
    lift = phi * np.log(np.maximum(phi, 1e-12) / np.maximum(frequency, 1e-12)[:, None])
    return np.argsort(-lift, axis=0, kind="stable")[:top].T


def topic_subjects(phi: np.ndarray, frequency: np.ndarray, seeds: np.ndarray, subjects: list[str]) -> list[str | None]:
    """The subject of each topic by the examples' use of its top terms; None (background) if fewer than three of them are in examples or no subject has half of the use."""
    share = seeds / np.maximum(seeds.sum(axis=1, keepdims=True), 1e-9)
    found: list[str | None] = []
    for k, rows in enumerate(top_rows(phi, frequency)):
        weight = phi[rows, k] * np.log(np.maximum(phi[rows, k], 1e-12) / np.maximum(frequency[rows], 1e-12))
        votes = (share[rows] * np.maximum(weight, 0)[:, None]).sum(axis=0)
        sure = len(subjects) and votes.sum() > 0 and votes.max() >= 0.5 * votes.sum() and (share[rows].sum(axis=1) > 0).sum() >= 3
        found.append(subjects[int(votes.argmax())] if sure else None)
    return found


class Fitted:
    """A fitted model: the documents as bags, the model, subject of each topic, frequency of each slot in use."""

    def __init__(self, bags: DataFrame, model: Model, topics: list[str | None], frequency: np.ndarray):
        self.bags, self.model, self.topics, self.frequency = bags, model, topics, frequency


def fit(docs: DataFrame, id_col: str, text_col: str, lang: Column, examples: DataFrame, passes: int = PASSES) -> Fitted:
    """Fit topics over all documents.

    examples: (subject, text), of which at most MAX_EXAMPLES rows are read; they only give
    priors.  NULL ids take no part; NULL and blank texts hold no sentence.  Words are
    counted over all documents.
    """
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), lang.cast("string").alias("lang"), F.col(text_col).alias("text"))
    words = cut(_coded(docs, MIN_SENTENCE))  # texts are read once; numbers only from here
    stop = _stop_words(words)
    bags = cut(_bags(words.drop("lang"), stop))
    shown = examples.where("subject IS NOT NULL AND text IS NOT NULL").select("subject", "text").orderBy(F.xxhash64("subject", "text"), "subject", "text").limit(MAX_EXAMPLES)
    rows = _bags(_coded(shown, 1), stop).collect()  # bounded
    subjects = sorted({r["subject"] for r in rows})

    used = _summed(bags, ["once", "again"], _documents)
    slots = used["slot"].to_numpy(np.int64)
    size, topics = len(slots), len(subjects)
    seeds = np.zeros((size, topics))
    place = {s: i for i, s in enumerate(slots.tolist())}
    for r in rows:
        for t in r["terms"]:
            if t in place:
                seeds[place[t], subjects.index(r["subject"])] += 1
    once, again = used["once"].to_numpy(float), used["again"].to_numpy(float)
    frequency = (once + again) / max((once + again).sum(), 1.0)
    repeated = again / np.maximum(once + again, 1.0)
    matter, manner = frequency * (repeated + EITHER), frequency * (1 - repeated + EITHER)
    base = np.stack([*[matter / max(matter.sum(), 1e-300)] * topics, manner / max(manner.sum(), 1e-300)], axis=1)
    prior = SMOOTH * base
    prior[:, :topics] += SEED_WEIGHT * seeds
    start = prior + base * np.array([START] * topics + [START_BACKGROUND])
    phi = start / np.maximum(start.sum(axis=0), 1e-300)
    alpha = np.array([ALPHA] * topics + [ALPHA_BACKGROUND], dtype=np.float32)
    for _ in range(passes if size and topics else 0):
        counts = _expected_counts(bags, Model(slots, phi, alpha)) + prior
        phi = counts / np.maximum(counts.sum(axis=0), 1e-300)
    return Fitted(bags, Model(slots, phi, alpha), topic_subjects(phi, frequency, seeds, subjects) if size else [], frequency)


def _expected_counts(bags: DataFrame, model: Model) -> np.ndarray:
    """Expected uses of each slot in use by each topic over all documents, weighted."""
    sent = bags.sparkSession.sparkContext.broadcast((model.slots, model.phi, model.alpha))  # at most SLOTS rows
    names = [f"t{k}" for k in range(len(model.alpha))]

    def gather() -> object:
        held = Model(*sent.value)

        def add(part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            q, _ = held.infer(part)
            rows = held.place[part.terms]
            by_topic = np.ascontiguousarray((q * part.weight[part.doc_of][:, None]).T)
            sentence = np.repeat(np.arange(len(part.sizes)), part.sizes)
            yield held.slots, np.stack([np.bincount(rows, t[sentence], len(held.slots)) for t in by_topic])

        return add

    summed = _summed(bags, names, gather)
    sent.unpersist()
    out = np.zeros(model.phi.shape)
    out[np.searchsorted(model.slots, summed["slot"].to_numpy(np.int64))] = summed[names].to_numpy(float)
    return out


def assigned(fitted: Fitted, least_sentences: int = 2, least_share: float = 0.5) -> DataFrame:
    """(doc_id, subject, sentences, proportion): subjects that enough sentences of a document are about.

    A sentence is about a subject whose topics it was drawn from with a probability of
    least_share or more.  proportion: the share of the subject's topics in the document's
    proportions.  An id stored twice comes once.
    """
    subjects = sorted({s for s in fitted.topics if s})
    id_type = fitted.bags.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("subject", T.StringType()), T.StructField("sentences", T.IntegerType()), T.StructField("proportion", T.DoubleType())])
    spark = fitted.bags.sparkSession
    if not subjects:
        return spark.createDataFrame([], schema)
    of_subject = np.array([[s == t for s in subjects] for t in fitted.topics], dtype=np.float32)
    sent = spark.sparkContext.broadcast((fitted.model.slots, fitted.model.phi, fitted.model.alpha))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch, part in slices(batches):
            q, held = model.infer(part)
            about = q @ of_subject >= least_share
            n = np.add.reduceat(about.astype(np.int32), part.doc_starts, axis=0)
            share = held @ of_subject / held.sum(axis=1, keepdims=True)
            doc, subject = np.nonzero(n >= least_sentences)
            ids = batch.column("doc_id").take(pa.array(part.first + doc))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([subjects[s] for s in subject], pa.string()), pa.array(n[doc, subject], pa.int32()), pa.array(share[doc, subject].astype(float))],
                names=["doc_id", "subject", "sentences", "proportion"],
            )

    rows = fitted.bags.mapInArrow(label, schema)
    return rows.groupBy("doc_id", "subject").agg(F.max("sentences").alias("sentences"), F.max("proportion").alias("proportion"))


def top_terms(fitted: Fitted, docs: DataFrame, text_col: str) -> DataFrame:
    """(topic, subject, rank, term): the top terms of each topic, by which it was mapped, for inspection.

    The term of a slot is the word that most documents hold of those hashed to it.
    subject is NULL for background topics.
    """
    schema = "slot int, topic int, subject string, rank int"
    rows = []
    if fitted.topics:
        for k, best in enumerate(top_rows(fitted.model.phi, fitted.frequency)):
            rows += [(int(fitted.model.slots[i]), k, fitted.topics[k], n + 1) for n, i in enumerate(best)]
    top = docs.sparkSession.createDataFrame(rows, schema)  # TOP_TERMS rows a topic
    wanted = {r[0] for r in rows}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                n.update({w for s in sentences(text) for w in s} if text else ())
            slots = {w: xxhash.xxh32_intdigest(w) & (SLOTS - 1) for w in n}
            told = [w for w in n if slots[w] in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([slots[w] for w in told], pa.int32()), pa.array(told, pa.string()), pa.array([n[w] for w in told], pa.int64())], names=["slot", "term", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(words, "slot int, term string, n long").groupBy("slot", "term").agg(F.sum("n").alias("n"))
    named = counts.groupBy("slot").agg(F.max_by("term", F.struct("n", "term")).alias("term"))
    return top.join(named, "slot").select("topic", "subject", "rank", "term")
