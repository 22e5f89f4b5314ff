"""Subject areas of documents from weak labelling functions and a latent model that learns their accuracies.

Four functions vote on every sentence, or abstain: the lexicon (the sentence's own words), the section (the words of
the paragraph, and with less weight of the document, that the sentence does not hold itself, so that no word is
evidence in both), the address (hosts of links and mail addresses in the document) and the source. Lexicon, hosts and
sources start from the hand-labelled documents and are counted again over all sentences of the corpus once the model
has given those a subject. How often each pattern of votes occurs over the whole corpus goes to the driver (at most
(subjects + 2) to the fourth rows), where expectation-maximisation learns the class shares and each function's confusion
rates; a sentence's posterior follows from its votes. A document's posterior of a subject is the probability that at
least ``SHARE`` of its sentences deal with it, and it gets the subjects that are more likely than not.

The text is tokenised once, into a table of word hashes in the shared folder; all later passes are numpy over that.
Log odds are computed in Spark over all counted terms. Terms whose counts do not differ from what is expected (by
``LEAST_GAIN``) abstain, however frequent. Of the others the ``BROADCAST`` strongest go to all tasks and the rest, if
there are more, is joined to the documents that hold them, so no term is lost.

Defined results: null and empty texts have no sentences and no subject; a text may have none; repeated documents
repeat their result; labels naming no known subject or no document are ignored; without labels there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestlake.llm import sentences as S
from nestlake.llm.langid import named
from nestlake.runtime import cut

SHARE = 0.25
ROUNDS = 1  # of counting the lexicon again over the whole corpus
#: Terms that every task holds; further ones are joined.
BROADCAST = 200_000
#: Hand labels that the first lexicon is fitted on, smallest hash first; more do not change it noticeably.
LABEL_BOUND = 200_000
#: Nats by which a term's counts must differ from the expected ones for it to be evidence.
LEAST_GAIN = 1.0
#: A function votes for its best class if that has at least this probability by its scores alone.
SURE, SURE_OF_DOCUMENT = 0.6, 0.4
#: A section with a second subject of more than this share of the first one's score is mixed, and abstains.
MIXED = 0.15
#: From this probability on, a vote of the lexicon is a strong one, whose accuracy is learnt apart from the weak ones'.
STRONG = 0.9
#: Weight of the document's words beyond the paragraph, in the section function.
FAR = 0.5

WORD, HOST, SOURCE, ALL = range(4)
_TOKENS = "key long, doc_id long, source long, lang string, words array<long>, sizes array<int>, paragraphs array<int>, hosts array<long>"


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        s = S.split(texts)
        n = np.bincount(s.text, minlength=len(texts))
        at = np.concatenate([[0], np.cumsum(n)])
        of_word = np.repeat(s.text, s.sizes)
        words = np.concatenate([[0], np.cumsum(np.bincount(of_word, minlength=len(texts)))])
        found = [S.hosts(t) for t in texts]
        known = {x: named(x) or "" for x in set(b.column("lang").to_pylist())}
        source = b.column("source")
        named_sources = pa.array(S.term([x or "" for x in source.to_pylist()]), mask=np.array([not x for x in source.to_pylist()], bool))
        ends = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            b.column("key"), b.column("doc_id"), named_sources, pa.array([known[x] for x in b.column("lang").to_pylist()], pa.string()), pa.ListArray.from_arrays(ends(words), pa.array(s.words)),
            pa.ListArray.from_arrays(ends(at), pa.array(s.sizes.astype(np.int32))), pa.ListArray.from_arrays(ends(at), pa.array(s.paragraph.astype(np.int32))),
            pa.ListArray.from_arrays(ends(np.cumsum([0, *map(len, found)])), pa.array(S.term([h for hs in found for h in hs]))),
        ], ["key", "doc_id", "source", "lang", "words", "sizes", "paragraphs", "hosts"])


def tokenise(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, lang) -> a written table of _TOKENS, one row per document with text."""
    d = docs.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "source", "lang")
    return cut(d.mapInArrow(_tokenised, _TOKENS), rebalance=False)


class Batch:
    """Columns of a token batch as flat arrays."""

    def __init__(self, b: pa.RecordBatch) -> None:
        col = lambda x: b.column(x).flatten().to_numpy(zero_copy_only=False)
        self.docs = b.num_rows
        count = lambda x: np.diff(b.column(x).offsets.to_numpy())
        self.words, self.sizes, self.paragraphs, self.hosts = (col(x) for x in ("words", "sizes", "paragraphs", "hosts"))
        self.sizes = self.sizes.astype(np.int64)
        self.doc = np.repeat(np.arange(self.docs), count("sizes"))  # of each sentence
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)  # of each word
        self.host_doc = np.repeat(np.arange(self.docs), count("hosts"))
        self.source = b.column("source").fill_null(0).to_numpy(zero_copy_only=False)
        self.has_source = b.column("source").is_valid().to_numpy(zero_copy_only=False)
        self.lang = np.array(b.column("lang").to_pylist(), object)
        self.rest = b.column("rest") if "rest" in b.schema.names else None


@dataclass
class Model:
    subjects: list[str]
    terms: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.int64)] * 3)  # by kind, ascending
    odds: list[np.ndarray] = field(default_factory=list)  # terms x (subjects + none), then a row of zeros
    prior: np.ndarray | None = None
    confusion: list[np.ndarray] | None = None  # per function: class x (subjects + none + abstain)
    log_share: np.ndarray | None = None  # of the classes, as the lexicon was counted
    rest: DataFrame | None = None  # (kind, term, odds) beyond the broadcast ones

    def carried(self) -> Model:
        """What tasks need."""
        return Model(self.subjects, self.terms, self.odds, self.prior, self.confusion, self.log_share)

    def lookup(self, kind: int, keys: np.ndarray, rest: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        """(row of each key, matrix of rows): terms of the model and of the joined rest; the last row is zeros."""
        terms, odds = self.terms[kind], self.odds[kind]
        if rest is not None and len(flat := rest.flatten()):
            own = flat.field("kind").to_numpy(zero_copy_only=False) == kind
            more, at = np.unique(flat.field("term").to_numpy(zero_copy_only=False)[own], return_index=True)
            extra = flat.field("odds").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.subjects) + 1)[own][at]
            order = np.argsort(np.concatenate([terms, more]), kind="stable")
            terms, odds = np.concatenate([terms, more])[order], np.concatenate([np.concatenate([odds[:-1], extra])[order], odds[-1:]])
        if not len(terms):
            return np.zeros(len(keys), np.int64), odds
        at = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
        return np.where(terms[at] == keys, at, len(terms)), odds

    def votes(self, b: Batch) -> np.ndarray:
        """Votes (lexicon, section, address, source) of each sentence; len(subjects): none, one more: abstain; beyond
        that, the lexicon's weak votes for each subject."""
        k, n = len(self.subjects), len(b.sizes)
        if not n:
            return np.zeros((0, 4), np.int64)
        row, odds = self.lookup(WORD, b.words, b.rest)
        own = np.add.reduceat(odds[row], np.cumsum(b.sizes) - b.sizes, 0)
        par = np.cumsum(np.diff(b.paragraphs, prepend=-1).astype(bool) | np.diff(b.doc, prepend=-1).astype(bool)) - 1
        out = np.empty((n, 4), np.int64)
        out[:, 0] = self._vote(own, SURE)
        out[:, 0] += np.where((out[:, 0] < k) & (self._vote(own, STRONG) == k + 1), k + 2, 0)
        for_it = np.maximum(odds, 0)  # words against a subject in one sentence say nothing of the next
        near = _distinct_sums(par[b.sentence], row, for_it, int(par[-1]) + 1)[par]
        far = _distinct_sums(b.doc[b.sentence], row, for_it, b.docs)[b.doc]
        around = near - np.add.reduceat(for_it[row], np.cumsum(b.sizes) - b.sizes, 0) + FAR * (far - near)
        around[:, k] = 0
        out[:, 1] = self._vote(around, SURE)
        two = np.partition(around[:, :k], -2, 1)[:, -2:] if k > 1 else np.zeros((n, 2))
        out[two[:, 0] > MIXED * two[:, 1], 1] = k + 1
        row, odds = self.lookup(HOST, b.hosts, b.rest)
        sums = np.stack([np.bincount(b.host_doc, odds[row, c], b.docs) for c in range(k + 1)], 1)
        out[:, 2] = np.where(np.bincount(b.host_doc, row < len(odds) - 1, b.docs) > 0, self._vote(sums, SURE_OF_DOCUMENT), k + 1)[b.doc]
        row, odds = self.lookup(SOURCE, b.source, b.rest)
        out[:, 3] = np.where(b.has_source & (row < len(odds) - 1), self._vote(odds[row], SURE_OF_DOCUMENT), k + 1)[b.doc]
        return out

    def _vote(self, score: np.ndarray, least: float) -> np.ndarray:
        """Best class of log odds against the classes' shares, or abstention (one above ``none``)."""
        x = score + self.log_share
        p = np.exp(x - x.max(1, keepdims=True))
        best = p.argmax(1)
        here = np.arange(len(p))
        return np.where((p[here, best] >= least * p.sum(1)) & (score[here, best] > 0), best, len(self.subjects) + 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        lp = np.log(self.prior)[None, :] + sum(np.log(c[:, votes[:, f]]).T for f, c in enumerate(self.confusion))
        p = np.exp(lp - lp.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _distinct_sums(group: np.ndarray, row: np.ndarray, odds: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each group, every row once in it; groups ascend, rows of zeros may be skipped."""
    known = row < len(odds) - 1
    key = np.sort(group[known] * len(odds) + row[known])
    key = key[np.diff(key, prepend=-1) != 0]
    g, out = key // len(odds), np.zeros((n, odds.shape[1]))
    if len(key):
        first = np.flatnonzero(np.diff(g, prepend=-1))
        out[g[first]] = np.add.reduceat(odds[key % len(odds)], first, 0)
    return out


def learn(patterns: np.ndarray, n: np.ndarray, k: int, rounds: int = 40) -> tuple[np.ndarray, list[np.ndarray]]:
    """EM over vote patterns (rows of four votes, with counts): class shares and a confusion matrix for each function."""
    classes = k + 1
    prior = np.full(classes, 0.5 / k)
    prior[k] = 0.5
    confusion = []
    for f, trust in enumerate((0.85, 0.6, 0.2, 0.15)):
        c = np.full((classes, k + 2 + k * (f == 0)), (1 - trust) / (k + 1))
        for s in range(k):
            c[s, s] = trust
            if f == 0:  # weak votes start with less trust
                c[:, k + 2 + s] = (1 - trust) / (k + 1)
                c[s, k + 2 + s] = trust / 3
        c[k, k + 1] = c[k, k] = trust / 2 if f == 0 else 1 / (k + 2)
        confusion.append(c / c.sum(1, keepdims=True))
    for _ in range(rounds):
        lp = np.log(prior)[None, :] + sum(np.log(c[:, patterns[:, f]]).T for f, c in enumerate(confusion))
        post = np.exp(lp - lp.max(1, keepdims=True))
        post = post / post.sum(1, keepdims=True) * n[:, None]
        prior = (post.sum(0) + 1) / (post.sum() + classes)
        for f in range(4):
            c = np.full(confusion[f].shape, 0.5)
            np.add.at(c.T, patterns[:, f], post)
            confusion[f] = c / c.sum(1, keepdims=True)
    return prior, confusion


# ---- counting

_COUNTED = "kind int, term long, lang string, mass array<double>"


class _Counts:
    """Masses by (kind, term, language); squeezed and given out as they grow, so that memory stays bounded."""

    def __init__(self, classes: int) -> None:
        self.classes, self.held, self.size = classes, {}, 0

    def add(self, kind: int, lang: str, terms: np.ndarray, mass: np.ndarray, which: np.ndarray) -> None:
        """mass[which[n]] for terms[n]."""
        if len(terms):
            u, inv = np.unique(terms, return_inverse=True)
            self.held.setdefault((kind, lang), []).append((u, np.stack([np.bincount(inv, mass[which, c], len(u)) for c in range(self.classes)], 1)))
            self.size += len(u)

    def squeeze(self) -> None:
        for key, parts in self.held.items():
            u, inv = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
            m = np.concatenate([m for _, m in parts])
            self.held[key] = [(u, np.stack([np.bincount(inv, m[:, c], len(u)) for c in range(self.classes)], 1))]
        self.size = sum(len(t) for parts in self.held.values() for t, _ in parts)

    def out(self) -> Iterator[pa.RecordBatch]:
        self.squeeze()
        for (kind, lang), ((u, m),) in self.held.items():
            mass = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, self.classes, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array([lang] * len(u), pa.string()), mass], ["kind", "term", "lang", "mass"])
        self.held, self.size = {}, 0


_HELD = 1_000_000


def _counting(classes: int, masses):
    """masses(batch, b) -> (of sentences, of documents, of all words of documents), each x classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Counts(classes)
        for batch in batches:
            b = Batch(batch)
            of_sentence, of_doc, of_words = masses(batch, b)
            by_doc = np.bincount(b.doc, minlength=b.docs) > 0
            for lang in set(b.lang):
                own = (b.lang == lang) & by_doc
                words, docs = own[b.doc][b.sentence], np.nonzero(own)[0]
                sums.add(WORD, lang, b.words[words], of_sentence, b.sentence[words])
                hosts = own[b.host_doc]
                sums.add(HOST, lang, b.hosts[hosts], of_doc, b.host_doc[hosts])
                has = docs[b.has_source[docs]]
                sums.add(SOURCE, lang, b.source[has], of_doc, has)
                sums.add(ALL, lang, np.zeros(len(docs), np.int64), of_words, docs)
            if sums.size > _HELD:
                sums.squeeze()
                if sums.size > _HELD // 2:
                    yield from sums.out()
        yield from sums.out()

    return count


def _labelled_counts(k: int):
    """The first lexicon: a labelled document's distinct words, hosts and source, each once, shared among its subjects."""

    def masses(batch: pa.RecordBatch, b: Batch) -> tuple:
        of = batch.column("of")
        n = np.diff(of.offsets.to_numpy())
        doc = np.zeros((b.docs, k + 1))
        np.add.at(doc, (np.repeat(np.arange(b.docs), n), of.flatten().to_numpy(zero_copy_only=False)), np.repeat(1 / np.maximum(n, 1), n))
        sentence = doc[b.doc]
        again = np.unique(b.doc[b.sentence] * np.uint64(0x9E3779B97F4A7C15) + b.words.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True)[1]
        b.words, b.sentence = b.words[again], b.sentence[again]
        return sentence, doc, doc

    return _counting(k + 1, masses)


def _model_counts(model: Model):
    """Terms with the posterior classes of their sentences, for counting the lexicon again."""
    k = len(model.subjects)

    def masses(batch: pa.RecordBatch, b: Batch) -> tuple:
        post = model.posterior(model.votes(b)) if len(b.sizes) else np.zeros((0, k + 1))
        per = lambda weight: np.stack([np.bincount(b.doc, post[:, c] * weight, b.docs) for c in range(k + 1)], 1)
        return post, per(1.0) / np.maximum(np.bincount(b.doc, minlength=b.docs), 1)[:, None], per(b.sizes)

    return _counting(k + 1, masses)


def _pattern(votes: np.ndarray, k: int) -> np.ndarray:
    return ((votes[:, 0] * (k + 2) + votes[:, 1]) * (k + 2) + votes[:, 2]) * (k + 2) + votes[:, 3]


def _unpattern(code: np.ndarray, k: int) -> np.ndarray:
    return np.stack([code // (k + 2) ** (3 - f) % (k + 2 if f else 2 * k + 2) for f in range(4)], 1) if len(code) else np.zeros((0, 4), np.int64)


def _voted(model: Model):
    """Each document with the patterns of its sentences' votes."""
    k = len(model.subjects)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            code = _pattern(model.votes(b), k).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(b.doc, minlength=b.docs))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(code))], ["doc_id", "patterns"])

    return vote


def _use(model: Model, counts: DataFrame, size: int) -> None:
    """Log odds of all counted terms against what the classes' shares in their languages let expect, so that words that
    only belong to a language score 0; the strongest ``size`` for the model, the others as a table."""
    k = len(model.subjects)
    classes = range(k + 1)
    wide = cut(counts.groupBy("kind", "term", "lang").agg(*[F.sum(F.col("mass")[c]).alias(f"c{c}") for c in classes]))
    every = wide.where(F.col("kind") == ALL).toPandas()  # a row for each language
    cols = [f"c{c}" for c in classes]
    total = every[cols].to_numpy(float).sum(0) + 0.1
    total /= total.sum()
    model.log_share = np.log(total)
    shares = {x: (n + 20 * total) / (n.sum() + 20) for x, n in zip(every["lang"], every[cols].to_numpy(float), strict=True)} or {"": total}
    of_lang = F.create_map(*[y for x, v in shares.items() for y in (F.lit(x), F.array(*[F.lit(float(q)) for q in v]))])[F.col("lang")]
    mass = sum((F.col(c) for c in cols), F.lit(0.0))
    x = wide.where(F.col("kind") != ALL).withColumn("__m", mass).withColumn("__s", of_lang)
    x = x.groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in cols], *[F.sum(F.col("__m") * F.col("__s")[c]).alias(f"e{c}") for c in classes])
    n = sum((F.col(c) for c in cols), F.lit(0.0))
    x = x.withColumn("__n", n)
    x = x.select("*", *[((F.col(f"e{c}") + 0.01) / (F.col("__n") + 0.01 * (k + 1))).alias(f"s{c}") for c in classes])
    x = x.select("*", *[((F.col(f"c{c}") + 3 * F.col(f"s{c}")) / (F.col("__n") + 3)).alias(f"p{c}") for c in classes])
    odd = [F.log(F.col(f"p{c}") / F.col(f"s{c}")) for c in classes]
    gain = F.col("__n") * sum((F.col(f"p{c}") * odd[c] for c in classes), F.lit(0.0))
    plain = [F.when(F.abs(o) < 0.25, 0.0).otherwise(F.least(F.greatest(o, F.lit(-3.0)), F.lit(4.0))) for o in odd]
    found, seen = cut(x.select("kind", "term", gain.alias("gain"), F.array(*plain).alias("odds")).where((F.col("gain") >= LEAST_GAIN) & F.exists("odds", lambda o: o != 0)), F.count(F.lit(1)).alias("n"))
    best = found.orderBy(F.desc("gain"), "kind", "term").limit(size).toPandas()
    model.terms, model.odds = [], []
    for kind in (WORD, HOST, SOURCE):
        own = best[best["kind"] == kind].sort_values("term")
        model.terms.append(own["term"].to_numpy(np.int64))
        model.odds.append(np.concatenate([np.stack(own["odds"].to_list()) if len(own) else np.zeros((0, k + 1)), np.zeros((1, k + 1))]))
    model.rest = None
    if seen["n"] > size:
        last = best.iloc[-1]
        g, t, m = F.lit(float(last["gain"])), F.lit(int(last["kind"])), F.lit(int(last["term"]))
        after = (F.col("gain") < g) | ((F.col("gain") == g) & ((F.col("kind") > t) | ((F.col("kind") == t) & (F.col("term") > m))))
        model.rest = found.where(after).select("kind", "term", "odds")


def _with_rest(tokens: DataFrame, model: Model) -> DataFrame:
    """Documents with the terms of the model's rest that they hold."""
    if model.rest is None:
        return tokens
    held = F.array_union(F.transform("words", lambda w: F.struct(F.lit(WORD).alias("kind"), w.alias("term"))), F.transform("hosts", lambda w: F.struct(F.lit(HOST).alias("kind"), w.alias("term"))))
    held = F.array_union(held, F.array(F.struct(F.lit(SOURCE).alias("kind"), F.coalesce("source", F.lit(0)).alias("term"))))
    own = tokens.select("key", F.explode(held).alias("h")).select("key", "h.*").join(model.rest, ["kind", "term"])
    per = own.groupBy("key").agg(F.collect_list(F.struct("kind", "term", "odds")).alias("rest"))  # of one document: no more than its terms
    out = tokens.join(per, "key", "left")
    return out.withColumn("rest", F.coalesce("rest", F.array().cast(per.schema["rest"].dataType)))


def train(tokens: DataFrame, labels: DataFrame, subjects: list[str], size: int = BROADCAST) -> tuple[Model, DataFrame | None]:
    """tokens as of ``tokenise``, labels(doc_id, subject) -> the model, and (doc_id, patterns) of every document. The
    language label may be wrong or missing."""
    k = len(subjects)
    model = Model(subjects)
    if not subjects:
        return model, None
    number = F.create_map(*[F.lit(x) for j, s in enumerate(subjects) for x in (s, j)])
    of = labels.where(F.col("subject").isin(subjects)).orderBy(F.xxhash64("doc_id"), "doc_id", "subject").limit(LABEL_BOUND)
    of = of.groupBy("doc_id").agg(F.collect_set(number[F.col("subject")]).alias("of"))
    _use(model, tokens.join(of, "doc_id").mapInArrow(_labelled_counts(k), _COUNTED), size)
    model.prior, model.confusion = learn(np.zeros((0, 4), np.int64), np.zeros(0), k, rounds=0)  # the starting point of the accuracies
    for _ in range(ROUNDS):
        _use(model, _with_rest(tokens, model).mapInArrow(_model_counts(model.carried()), _COUNTED), size)
        voted = cut(_with_rest(tokens, model).mapInArrow(_voted(model.carried()), "doc_id long, patterns array<int>"), rebalance=False)
        seen = voted.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).toPandas()
        model.prior, model.confusion = learn(_unpattern(seen["p"].to_numpy(np.int64), k), seen["n"].to_numpy(float), k)
    return model, voted


def _document(post: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents x subjects) probability that enough sentences deal with a subject, and expected share. Enough is a
    quarter, but no single passing sentence; the number of sentences is taken as normal with its exact mean and variance."""
    n = np.bincount(doc, minlength=docs)
    mean = np.stack([np.bincount(doc, post[:, c], docs) for c in range(post.shape[1] - 1)], 1)
    var = np.stack([np.bincount(doc, post[:, c] * (1 - post[:, c]), docs) for c in range(post.shape[1] - 1)], 1)
    enough = np.maximum(np.ceil(SHARE * n), np.minimum(2, np.ceil(n / 2)))
    z = (mean - enough[:, None] + 0.5) / np.sqrt(np.maximum(var, 1e-6))
    return np.array([0.5 * (1 + erf(x / sqrt(2))) for x in z.ravel()]).reshape(z.shape) * (n > 0)[:, None], mean / np.maximum(n, 1)[:, None]


def label_documents(docs: DataFrame, labels: DataFrame, subjects: list[str], size: int = BROADCAST) -> DataFrame:
    """docs(doc_id, text, source, lang), labels(doc_id, subject) -> (doc_id, subject, probability, share)."""
    model, voted = train(tokenise(docs), labels, subjects, size)
    schema = "doc_id long, subject string, probability double, share double"
    if voted is None:
        return docs.sparkSession.createDataFrame([], schema)
    model, k, names = model.carried(), len(subjects), np.array(subjects, object)
    model.terms = model.odds = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column("patterns").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(b.column("patterns").offsets.to_numpy()))
            p, share = _document(model.posterior(_unpattern(code, k)), doc, b.num_rows)
            d, s = np.nonzero(p >= 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(names[s], pa.string()), pa.array(p[d, s]), pa.array(share[d, s])], ["doc_id", "subject", "probability", "share"])

    return voted.mapInArrow(run, schema)
