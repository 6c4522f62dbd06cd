"""Quality classification by a weak-label model.

Overlapping heuristic labellers vote on every document, some good or nothing, some bad or nothing. Expectation-maximisation over the counts of
all vote patterns (at most 2 ** labellers numbers, whatever the corpus size) estimates each labeller's accuracy and every
pattern's posterior; posterior labels of a bounded sample train a linear scorer over hashed words and the votes; the
scorer's probability and the posterior decide on every document by their mean. One labeller is a lexicon of words and word beginnings that tell toxic documents, found
in a bounded sample of labelled rows.

The lexicon is the one labeller that is supervised: it learns from the column `toxic` of the labelled rows. All others
are rules.

The model has two priors. A labeller's false votes have a Beta prior of mean FALSE_VOTES that counts as much as all
documents: with the votes alone, a labeller that nobody else supports could as well be the one that errs. And bad
documents come in kinds that different labellers see: where one votes bad the silence of the others says nothing, where
none does the silence of all that may is evidence for good. The silence of those that vote good says nothing.

Bounds (documented parameters): LABELLED labelled documents for the lexicon, TRAINED rows of WORDS words for the scorer,
2 ** BITS weights. Vote patterns are counted over all documents, and all documents are scored as a whole.

Defined cases: a null or empty text gets no votes and is kept; null ids and repeated rows are scored one by one; labels
of one id count as one (toxic if any says so), those without an id not at all; without labelled rows the lexicon is
empty; very long texts are measured in segments of bounded memory; an empty table gives no rows; other columns are
ignored by classify() and kept by keep_good() and keep_good_rows().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import unused
from .textcore import ALNUM, NOT_SPACE, HashFilter, Words, blocks, buffers, mix
from .workspace import prepare

#: The first seven vote bad or nothing, the others good or nothing.
LABELLERS = ["symbols", "shouting", "bare_marks", "exclaiming", "stuttering", "looping", "toxic_words", "ordinary_form", "ordinary_words"]
BAD_VOTERS = 7
#: Prior mean of the share of good documents that a labeller votes bad on.
FALSE_VOTES = 0.001
LABELLED = 20_000
#: Different toxic texts that an entry has to be in, and that it has to be the first to cover.
SUPPORT, COVERED = 6, 3
TRAINED = 6_000
#: Words of a training row, evenly spaced where a text has more; TRAINED * WORDS numbers come to the driver at most.
WORDS = 2_000
BITS = 18
PREFIXES = (3, 4, 5, 6)

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "*$#%&~^|<>{}=\\"]] = True
UPPER, LOWER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
UPPER[65:91] = LOWER[97:123] = True


def per_text(counted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(counted) + 1, dtype=np.int64)
    np.cumsum(counted, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the format labellers look at, per text."""
    words = Words(data, offsets, NOT_SPACE, lower=False)
    n = words.count()
    texts = len(offsets) - 1
    of_words = lambda flag: np.bincount(words.doc[flag], minlength=texts)
    plain = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(ALNUM[data] | UPPER[data], out=plain[1:])
    end = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    before = data[np.maximum(words.end - 2, 0)] if len(words.end) else end
    again = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])][: len(words.hash)]
    g, at = words.grams(4)
    doc = words.doc[at]
    distinct = np.bincount(doc[np.unique(g ^ mix(doc.astype(np.uint64)), return_index=True)[1]], minlength=texts)
    grams = np.bincount(doc, minlength=texts)
    upper, lower = per_text(UPPER[data], offsets), per_text(LOWER[data], offsets)
    share = lambda a, b: a / np.maximum(b, 1)
    return {
        "n_words": n, "symbols": share(per_text(SYMBOL[data], offsets), np.diff(offsets)), "shouting": np.where(upper + lower >= 20, share(upper, upper + lower), 0.05),
        "bare_marks": share(of_words(plain[words.end] == plain[words.start]), n), "exclaiming": share(of_words((end == 33) & (before == 33)), n),
        "stuttering": np.where(n >= 20, share(of_words(again), n), 0), "looping": np.where(grams >= 20, 1 - share(distinct, grams), 0),
    }


# A text with all shares up to the first ones has ordinary form; from the second on a share votes bad.
LIMITS = {"symbols": (0.004, 0.02), "shouting": (0.15, 0.3), "bare_marks": (0.02, 0.1), "exclaiming": (0.02, 0.1), "stuttering": (0.02, 0.15), "looping": (0.1, 0.5)}


def vote(data: np.ndarray, offsets: np.ndarray, lexicon: HashFilter) -> np.ndarray:
    """Votes of every labeller on every text: 0 none, 1 good, 2 bad."""
    m = measures(data, offsets)
    out = np.zeros((len(LABELLERS), len(offsets) - 1), dtype=np.int8)
    ordinary = np.ones(len(offsets) - 1, dtype=bool)
    for i, (name, (good, bad)) in enumerate(LIMITS.items()):
        out[i] = np.where(m[name] >= bad, 2, 0)
        ordinary &= m[name] <= good
    words = Words(data, offsets, ALNUM, prefixes=PREFIXES)
    hits = np.zeros(len(offsets) - 1, dtype=bool)
    for h in term_hashes(words):
        hits[words.doc[lexicon.find(h)[0]]] = True
    out[6] = np.where(hits, 2, 0)
    out[7] = ordinary & ~hits
    mean = np.diff(offsets) / np.maximum(m["n_words"], 1)
    out[8] = (mean >= 3) & (mean <= 16) & (m["symbols"] < 0.02)
    out[:, m["n_words"] == 0] = 0
    return out


def term_hashes(words: Words) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings, each kind apart from the others."""
    return [words.hash] + [mix(words.prefix[k] + np.uint64(k)) for k in PREFIXES]


def pattern(votes: np.ndarray) -> np.ndarray:
    return (3 ** np.arange(len(LABELLERS)))[None, :].dot(votes.astype(np.int64))[0]


def expectation_maximisation(counts: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Posterior probability of bad by vote pattern, and P(vote | class) by labeller, class and vote."""
    patterns = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(p)] for p in patterns], dtype=float)
    votes = np.array([(patterns // 3**i) % 3 for i in range(len(LABELLERS))])
    bad = np.where((votes == 2).any(0), 0.9, 0.02)
    table = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        prior = float((n * bad).sum() + 1) / (n.sum() + 2)
        for c, weight in enumerate((n * (1 - bad), n * bad)):
            for v in range(3):
                table[:, c, v] = ((votes == v) * weight).sum(1) + 0.5
        table /= table.sum(2, keepdims=True)
        share_good = float((n * (1 - bad)).sum() / n.sum())
        table[:BAD_VOTERS, 0, 2] = (table[:BAD_VOTERS, 0, 2] * share_good + FALSE_VOTES) / (share_good + 1)
        # a labeller is no worse than chance: its bad votes speak for bad, its good votes for good
        odds = np.log(table[:, 1] / table[:, 0])
        silence = np.minimum(odds[:BAD_VOTERS, 0], 0).sum()
        odds[:, 0], odds[:, 1], odds[:, 2] = 0, np.minimum(odds[:, 1], 0), np.maximum(odds[:, 2], 0)
        margin = np.log(prior / (1 - prior)) + sum(odds[i, votes[i]] for i in range(len(LABELLERS)))
        margin += np.where((votes != 2).all(0), silence, 0)
        bad = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        bad[(votes == 0).all(0)] = 0
    return {int(p): float(b) for p, b in zip(patterns, bad)}, table


def find_lexicon(docs: DataFrame, labels: DataFrame) -> HashFilter:
    """Words and word beginnings of toxic documents: those in hardly any other labelled document, picked by the number
    of different toxic texts that they are the first to cover."""
    by_id = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    n = by_id.count()
    sample = by_id.where(F.expr(f"pmod(xxhash64(doc_id), {max(1, -(-n // LABELLED))}) = 0")).limit(LABELLED)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, text = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in blocks(text):
                words = Words(*buffers(text.slice(a, b - a)), ALNUM, prefixes=PREFIXES)
                terms = np.concatenate(term_hashes(words))
                doc = np.tile(words.doc, 1 + len(PREFIXES))
                _, first = np.unique(terms ^ mix(doc.astype(np.uint64)), return_index=True)
                # the number of the row stands for the document in the cover: the hash of its words
                sign = np.zeros(b - a, np.uint64)
                np.add.at(sign, words.doc, words.hash)
                yield pa.RecordBatch.from_arrays([pa.array(terms[first].view(np.int64)), pa.array(toxic[a + doc[first]].astype(np.int64)), pa.array(sign[doc[first]].view(np.int64))], ["term", "toxic", "row"])

    # copies of a text count once
    terms = rows.mapInArrow(run, "term long, toxic long, row long").distinct().persist()
    good = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(f"bad >= {SUPPORT} and n - bad <= 0.02 * bad")
    covers = terms.where("toxic = 1").join(good.select("term"), "term").groupBy("term").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    # of terms in the same texts the first stands for all; they come largest first, and only texts are held here
    ordered = covers.groupBy("rows").agg(F.min("term").alias("term")).orderBy(F.desc(F.size("rows")), "term")
    picked: list[int] = []
    told: set[int] = set()
    for row in ordered.toLocalIterator():
        fresh = set(row["rows"]) - told
        if len(fresh) >= COVERED:
            picked.append(row["term"])
            told |= fresh
    terms.unpersist()
    return HashFilter(np.array(picked, dtype=np.int64).view(np.uint64))


class Scorer:
    """A linear model over the mean weight of hashed words and the weights of the votes."""

    SCALE = 4.0

    def __init__(self):
        self.words = np.zeros(1 << BITS, dtype=np.float32)
        self.votes = np.zeros((len(LABELLERS), 3))
        self.bias = 0.0

    @staticmethod
    def bucket(words: Words) -> np.ndarray:
        return (words.hash >> np.uint64(64 - BITS)).astype(np.int64)

    def margin(self, words: Words, votes: np.ndarray) -> np.ndarray:
        total = np.bincount(words.doc, self.words[self.bucket(words)], minlength=votes.shape[1])
        return self.bias + self.SCALE * total / np.maximum(words.count(), 1) + sum(self.votes[i, votes[i]] for i in range(len(LABELLERS)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 30, rate: float = 0.5) -> None:
        """rows: (buckets of the words, votes, posterior of bad)."""
        if not rows:
            return
        flat = np.concatenate([r[0] for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        size = np.maximum(np.bincount(doc, minlength=len(rows)), 1)
        votes, y = np.array([r[1] for r in rows]).T, np.array([r[2] for r in rows])
        weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())) * len(rows)
        step_w, step_v, step_b = np.full(len(self.words), 1e-6), np.full(self.votes.shape, 1e-6), 1e-6
        for _ in range(rounds):
            total = np.bincount(doc, self.words[flat], minlength=len(rows))
            m = self.bias + self.SCALE * total / size + sum(self.votes[i, votes[i]] for i in range(len(LABELLERS)))
            g = weight * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) / len(rows)
            gw = np.bincount(flat, (self.SCALE * g / size)[doc], minlength=len(self.words)) + 1e-6 * self.words
            gv = np.array([np.bincount(votes[i], g, minlength=3) for i in range(len(LABELLERS))])
            step_w += gw * gw
            step_v += gv * gv
            step_b += g.sum() ** 2
            self.words -= (0.1 * rate * gw / np.sqrt(step_w)).astype(np.float32)
            self.votes -= rate * gv / np.sqrt(step_v)
            self.bias -= rate * g.sum() / np.sqrt(step_b)


def train(docs: DataFrame, labels: DataFrame | None) -> tuple[HashFilter, dict[int, float], Scorer]:
    """Lexicon, posteriors by vote pattern and scorer."""
    lexicon = find_lexicon(docs, labels) if labels is not None else HashFilter(np.zeros(0, np.uint64))
    slim = docs.select(F.col("text").cast("string").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                p, n = np.unique(pattern(vote(*buffers(batch.column(0).slice(a, b - a)), lexicon)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pattern", "n"])

    counts = {r[0]: r[1] for r in slim.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()}
    posterior, _ = expectation_maximisation(counts) if counts else ({}, None)
    total = sum(counts.values())
    # the training rows: spread by row, so copies of a text are drawn one by one
    some = slim.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, -(-total // TRAINED)))) == 0)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                data, offsets = buffers(batch.column(0).slice(a, b - a))
                words = Words(data, offsets, ALNUM)
                bucket = Scorer.bucket(words).astype(np.int32)
                p = pattern(vote(data, offsets, lexicon))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([bucket[x : y : max(1, -(-(y - x) // WORDS))].tobytes() for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist())], pa.binary())], ["pattern", "words"])

    scorer = Scorer()
    rows = [(np.frombuffer(r[1], np.int32), np.array([(r[0] // 3**i) % 3 for i in range(len(LABELLERS))]), posterior.get(r[0], 0.0)) for r in some.mapInArrow(examples, "pattern long, words binary").limit(TRAINED).toLocalIterator()]
    scorer.fit(rows)
    return lexicon, posterior, scorer


def judge(data: np.ndarray, offsets: np.ndarray, lexicon: HashFilter, posterior: dict[int, float], scorer: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Votes, posterior, score and rejected of every text."""
    votes = vote(data, offsets, lexicon)
    score = 1 / (1 + np.exp(-np.clip(scorer.margin(Words(data, offsets, ALNUM), votes), -30, 30)))
    score[(votes == 0).all(0)] = 0.0
    post = np.array([posterior.get(int(p), 0.0) for p in pattern(votes)])
    return votes, post, score, score + post >= 1


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per document (doc_id, text): doc_id, posterior (of bad, from the votes), score (of bad), rejected, votes
    (a digit per labeller: 0 none, 1 good, 2 bad)."""
    prepare(docs.sparkSession)
    lexicon, posterior, scorer = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for a, b in blocks(text):
                votes, post, score, rejected = judge(*buffers(text.slice(a, b - a)), lexicon, posterior, scorer)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(post), pa.array(score), pa.array(rejected), pa.array(["".join(map(str, v)) for v in votes.T])], ["doc_id", "posterior", "score", "rejected", "votes"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, posterior double, score double, rejected boolean, votes string")


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents that are not rejected, with all columns. A finding names an id: rows that share it go with it, and
    rows with a null id stay; see keep_good_rows()."""
    return docs.join(classify(docs, labels).where("rejected").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def keep_good_rows(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows that are not rejected, with all columns: each row by its own text, whatever its id."""
    prepare(docs.sparkSession)
    lexicon, posterior, scorer = train(docs, labels)
    name = unused(docs, "judged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(name)
            for a, b in blocks(text):
                data, offsets = buffers(text.slice(a, b - a))
                rejected = judge(data, offsets, lexicon, posterior, scorer)[3]
                yield batch.slice(a, b - a).filter(pa.array(~rejected)).drop_columns(name)

    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(run, docs.schema)
