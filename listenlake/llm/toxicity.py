"""Toxicity by weak supervision.

Voters are many and weak: a lexicon of words and word beginnings, mined from labelled texts and dealt to several voters,
and patterns of form. A generative label model estimates, from how often voters agree over all documents, the class
balance, each voter's rate of firing on toxic and on other texts, and the correlations that remain within a class;
correlated voters share their weight. Its posterior labels train a linear classifier, whose output is the score.

Labels are learnt only from rows whose crc32 of doc_id as text is no multiple of 5. They choose the voters and set the class
balance, and nothing else: the classifier is fitted on posteriors alone. Terms are counted and rated over all rows that may
be learnt from; at most about FIT_ROWS of these, drawn by a hash of doc_id, are what the lexicon has to cover, and the
classifier is fitted on as many rows at most. The statistics of the label model cover all documents. A score depends on the text alone.

Null and empty texts are scored like a text without findings. Labels may miss, repeat (toxic if any row says so) or be
null (not learnt from). Without toxic labels, documents, or a term that passes, every score is the class balance, 0.01 at least and
0.4 at most. Rows that repeat are scored each for itself; extra columns of the input stay in drop_toxic() and go elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlake.llm.common import lean, staged, texts

FIT_ROWS = 20_000
STEMS = (4, 5, 6, 7, 8)  # lengths of the word beginnings that may enter the lexicon
DENSE = 0.008  # an entry may ask for this part of a text's words
FILTER_BITS = 16  # for each label, of the filter in front of the join
HELD = 500_000  # terms that a task counts together
LEAST_TEXTS = 3
LEAST_LIFT = 8.0
LEAST_PURITY = 0.6  # part of an entry's labelled texts that must be toxic
COVER = 2  # entries that a toxic text needs; one that adds little to texts with fewer is left out
FOLDS = 8
UNKNOWN = 100  # texts of a form's overall rate that are added to either class

WORD = re.compile(r"\w+").findall
SHOUT = re.compile(r"!{2,}|\?{2,}").search
MASKED = re.compile(r"\w[*#$@%&]{2,}").search
#: Pattern voters: shares or marks of form, and the value from which they vote.
PATTERNS = (
    ("upper case", lambda t: sum(map(str.isupper, t)) / max(1, len(t)), 0.5),
    ("exclamations", lambda t: t.count("!") / max(1, len(t)), 0.02),
    ("runs of marks", lambda t: float(SHOUT(t) is not None), 0.5),
    ("masked words", lambda t: float(MASKED(t) is not None), 0.5),
    ("short", lambda t: float(len(t) < 80), 0.5),
)


@dataclass
class Model:
    """words, stems: entry -> its number, purest first; least: the part of the words that each must make up; weights: of 1
    and the features; prior: the class balance."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    least: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.01
    rates: list[tuple[float, float]] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)

    @property
    def entries(self) -> int:
        return len(self.words) + len(self.stems)

    def features(self, text: str | None) -> np.ndarray:
        """Presence and rate of each entry; hits, distinct entries and density; the forms."""
        text = text or ""
        words = Counter(WORD(text.lower()))
        n, total = self.entries, max(1, sum(words.values()))
        out = np.zeros(2 * n + 3 + len(PATTERNS), np.float32)
        counts: Counter[int] = Counter()
        if n:
            for w, times in words.items():
                for e in (self.words.get(w), *[self.stems.get(w[:k]) for k in STEMS if len(w) > k]):
                    if e is not None:
                        counts[e] += times
        hits = 0
        for e, times in counts.items():
            if times >= self.least[e] * total:
                out[e] = 1.0
                hits += times
            out[n + e] = min(1.0, 20.0 * times / total)
        at = 2 * n
        out[at] = math.log1p(hits)
        out[at + 1] = math.log1p(out[:n].sum())
        out[at + 2] = min(1.0, 20.0 * hits / total)
        for k, (_, value, _) in enumerate(PATTERNS):
            out[at + 3 + k] = value(text)
        return out

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Rows of features to rows of votes. For toxic: folds of the lexicon, two entries, density; of unknown leaning:
        the forms; for clean: no entry. A voter that does not fire abstains."""
        n = self.entries
        found = x[:, :n] > 0
        folds = [found[:, part].any(axis=1) for part in np.array_split(np.arange(n), FOLDS)]
        more = [found.sum(axis=1) >= 2, x[:, 2 * n + 2] >= 0.2]
        forms = [x[:, 2 * n + 3 + k] >= least for k, (_, _, least) in enumerate(PATTERNS)]
        return np.stack([*folds, *more, *forms, ~found.any(axis=1)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        w = np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


VOTERS = FOLDS + 3 + len(PATTERNS)
FORMS = np.isin(np.arange(VOTERS), range(FOLDS + 2, FOLDS + 2 + len(PATTERNS)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def fit_labels(known: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """At most about `most` of the rows, drawn by a hash of doc_id."""
    count = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))
    return known.filter(draw < int(most / count * (1 << 30))) if count > most else known


def _labelled(docs: DataFrame, learnt: DataFrame) -> DataFrame:
    """Documents with their labels. Most documents have none: bits of hashes of the labelled ids, FILTER_BITS of them per
    label, keep nearly all of their texts out of the exchange. Sorted and merged at any size."""
    if docs.schema["doc_id"].dataType == learnt.schema["doc_id"].dataType:  # else equal ids may have other hashes
        place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FILTER_BITS * max(1, learnt.count())))
        bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
        bits = learnt.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
        met = docs.withColumn("_bucket", bucket).withColumn("_bit", bit).join(F.broadcast(bits), "_bucket")
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        power = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.col("_bit") % 8).cast("int") + 1)
        docs = met.filter(byte.bitwiseAND(power) != 0).select(*docs.columns)
    return docs.join(learnt.hint("merge"), "doc_id")


def _terms(text: str) -> set[str]:
    """Words, beginnings (marked *) and those of either that make up DENSE of the words (marked @)."""
    words = WORD(text.lower())
    counts = Counter(words)
    for w, n in list(counts.items()):
        for k in STEMS:
            if len(w) > k:
                counts[w[:k] + "*"] += n
    bound = DENSE * len(words)
    return {*counts, *[t + "@" for t, n in counts.items() if n >= bound]}


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, pos, neg): in how many toxic and other texts each term stands; rows: (text, toxic). A task adds up what it sees
    and hands it on whenever it holds HELD terms."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def handed() -> Iterator[pd.DataFrame]:
            for toxic, counts in enumerate(held):
                frame = pd.DataFrame({"term": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})
                yield frame.assign(toxic=np.int32(toxic))[["term", "toxic", "n"]]
                counts.clear()

        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                held[int(toxic == 1)].update(_terms(text))
                if len(held[0]) + len(held[1]) > HELD:
                    yield from handed()
        yield from handed()

    found = rows.select("text", "toxic").mapInPandas(lean(over), "term string, toxic int, n bigint")
    one = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0))
    return found.groupBy("term").agg(one(1).alias("pos"), one(0).alias("neg"))


def _terms_of_each(rows: DataFrame, among: frozenset[str]) -> list[list[str]]:
    """The terms, of those given, of each text; rows: bounded by what may be fitted on."""

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([sorted(_terms(t) & among) for t in text], dtype=object)

    return [r["terms"] for r in rows.select(found("text").alias("terms")).collect()]


def _g2(all_pos: int, all_neg: int) -> Column:
    """Log-likelihood ratio of a term's association with toxic texts, from its counts pos and neg."""
    total, seen = float(all_pos + all_neg), F.col("pos") + F.col("neg")
    sum_ = F.lit(0.0)
    for o, n in (("pos", float(all_pos)), ("neg", float(all_neg))):
        for seen_here, of in ((F.col(o).cast("double"), seen), (n - F.col(o), total - seen)):
            ratio = seen_here * total / (of * n)
            sum_ = sum_ + F.when(seen_here > 0, seen_here * F.log(ratio)).otherwise(0.0)
    return 2 * sum_


def mine_lexicon(labelled: DataFrame, sample: DataFrame) -> Model:
    """A model with a lexicon alone. labelled: (text, toxic) of all rows that may be learnt from, over which terms are counted
    and rated; sample: a bounded part of them, whose toxic texts the entries have to cover. A term enters if its association
    would be rare by chance among all terms tried; of terms of which one begins the other, the more strongly associated
    enters, of equals the longer. What passes the driver are terms that stand in LEAST_TEXTS toxic texts of the sample."""
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    all_pos, all_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not all_pos or not all_neg:
        return Model()
    counts = staged(_term_counts(labelled).filter(F.col("pos") >= LEAST_TEXTS))
    lift = (F.col("pos") / all_pos) / ((F.col("neg") + 0.5) / (all_neg + 1))
    bound = 2 * math.log(20 * max(1, counts.count()))
    firm = (lift >= LEAST_LIFT) & (F.col("pos") >= LEAST_PURITY * (F.col("pos") + F.col("neg")))
    firm = counts.withColumn("g2", F.round(_g2(all_pos, all_neg), 6)).filter(firm & (F.col("g2") >= bound))
    there = _term_counts(sample.filter("toxic = 1")).filter(F.col("pos") >= LEAST_TEXTS).select("term")
    found = firm.join(there, "term").collect()
    pos, neg = ({r["term"]: r[c] for r in found} for c in ("pos", "neg"))
    rated = [t for _, _, t in sorted((-r["g2"], -len(r["term"].rstrip("*@")), r["term"]) for r in found)]
    where: dict[str, list[int]] = {term: [] for term in rated}
    for i, found in enumerate(_terms_of_each(sample.filter("toxic = 1"), frozenset(rated))):
        for term in found:
            where[term].append(i)
    chosen: list[str] = []
    covered: Counter[int] = Counter()
    for term in rated:
        stem = term.rstrip("*@")
        open_ = sum(covered[i] < COVER for i in where[term])
        related = any(stem.startswith(c) or c.startswith(stem) for c in (x.rstrip("*@") for x in chosen))
        if not related and open_ >= max(LEAST_TEXTS, 0.2 * len(where[term])):
            chosen.append(term)
            covered.update(where[term])
    model = Model(prior=min(0.4, max(0.01, all_pos / (all_pos + all_neg))))
    chosen.sort(key=lambda t: (neg[t] / pos[t], t))
    for k, term in enumerate(chosen):
        (model.stems if "*" in term else model.words)[term.rstrip("*@")] = k
        model.least.append(DENSE if term.endswith("@") else 0.0)
    return model


def _places(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)


def _moments(x: np.ndarray, n: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """First guess of (rate on toxic, rate on others), and which voters depend on one another beyond the class.

    Off the diagonal, the covariance of two voters that are independent within the classes is the product of what each owes
    to the class; so it follows from their covariances with any two others. Pairs far above that are dependent, and what a
    voter owes comes from triplets without such pairs."""
    mean = np.average(x, axis=0, weights=n)
    cov = (x - mean).T @ ((x - mean) * n[:, None]) / n.sum()
    m = len(mean)
    firm = np.abs(cov) > 1e-6
    dependent = np.zeros((m, m), bool)
    for i in range(m):
        for j in range(i):
            others = [k for k in range(m) if k not in (i, j)]
            found = [abs(cov[i, k] * cov[j, h] / cov[k, h]) for k in others for h in others if k != h and firm[k, h]]
            if found and abs(cov[i, j]) > 2 * np.median(found) + 1e-6:
                dependent[i, j] = dependent[j, i] = True
    d = np.zeros(m)
    for i in range(m):
        free = [j for j in range(m) if j != i and not dependent[i, j]]
        found = [abs(cov[i, j] * cov[i, k] / cov[j, k]) for j in free for k in free if j < k and firm[j, k] and not dependent[j, k]]
        d[i] = math.sqrt(np.median(found)) if found else math.sqrt(cov[i, i]) / 2
    lead = int(np.argmax(d[: FOLDS + 2]))  # these lean to toxic by what they look for; the others by how they go with them
    sign = np.where(cov[lead] < 0, -1.0, 1.0)
    gap = sign * d / math.sqrt(prior * (1 - prior))
    off = np.clip(mean - prior * gap, 1e-5, 0.95)
    on = np.clip(off + gap, 1e-4, 0.999)
    return np.stack([on, off], axis=1), dependent


def label_model(patterns: list[tuple[int, int]], prior: float, rounds: int = 60):
    """(posterior of each pattern, rates, shares) from (votes as bits, rows) and the class balance. No label is looked at.

    Begins with the rates and dependences that the covariances give, then alternates between posteriors and rates. The
    correlation of two voters within the classes, as the posteriors weigh them, lessens the share that both have in the log
    odds. A form leans to neither class until it fires more often in one than UNKNOWN texts of the overall rate make up for."""
    bits = np.array([p[0] for p in patterns], np.int64)
    n = np.array([p[1] for p in patterns], float)
    x = _places(bits)
    rates, dependent = _moments(x, n, prior)
    shares = 1 / (1 + dependent.sum(axis=1))
    held = UNKNOWN * FORMS * np.average(x, axis=0, weights=n)
    odds = None
    for _ in range(rounds):
        on, off = rates[:, 0], rates[:, 1]
        single = x * np.log(on / off)  # a voter that abstains says nothing
        odds = math.log(prior / (1 - prior)) + single @ shares
        toxic = n / (1 + np.exp(-np.clip(odds, -40, 40)))
        clean = n - toxic
        rates = np.clip(
            np.stack(
                [
                    (toxic @ x + 0.5 * ~FORMS + held) / (toxic.sum() + 1 + UNKNOWN * FORMS),
                    (clean @ x + 0.05 * ~FORMS + held) / (clean.sum() + 1 + UNKNOWN * FORMS),
                ],
                axis=1,
            ),
            1e-6,
            1 - 1e-6,
        )
        both = np.zeros((VOTERS, VOTERS))
        for weight in (toxic, clean):
            mean = weight @ x / max(1e-9, weight.sum())
            cov = (x - mean).T @ ((x - mean) * weight[:, None]) / max(1e-9, weight.sum())
            sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
            both += cov / np.outer(sd, sd) * weight.sum() / n.sum()
        np.fill_diagonal(both, 0)
        shares = 1 / (1 + np.where(both > 0.1, both, 0).sum(axis=1))
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40))), rates, shares


def train_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> list[float]:
    """Weights of a logistic regression on soft labels, by Newton steps; the bias is first and free of the ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x.astype(float)], axis=1)
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + keep * w
        hessian = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        size = float(np.abs(step).max())
        w -= step * min(1.0, 4 / max(size, 1e-9))
        if size < 1e-6:
            break
    return w.tolist()


def _featured(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """(row, x, votes) of all documents: row holds the columns carried, x the features."""
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("struct<none:int>")
    rows = docs.select(row.alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([model.features(t) for t in batch.column(1).to_pylist()])
            votes = (model.votes(x) @ (1 << np.arange(VOTERS))).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(votes)], names=["row", "x", "votes"])

    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("x array<float>, votes int").fields])
    return staged(rows.mapInArrow(lean(over), schema))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, carried: list[str] | None = None) -> tuple[Model, DataFrame]:
    """The fitted model and (row, x, votes) of all documents, written once; row holds the columns carried, doc_id alone if
    not told. Labels choose the voters and set the class balance; what the classifier is trained on are posteriors of votes."""
    learnt = staged(learnable(labels))
    known = staged(fit_labels(learnt, most))  # at most about `most` rows, so it may be broadcast
    model = mine_lexicon(_labelled(texts(docs), learnt), texts(docs).join(F.broadcast(known), "doc_id"))
    carried = carried or ["doc_id"]
    seen = _featured(docs, model, carried)
    patterns = sorted(tuple(p) for p in seen.groupBy("votes").count().collect())  # at most 2^VOTERS rows
    if not model.entries or not patterns:
        return model, seen
    posterior, rates, shares = label_model(patterns, model.prior)
    model.rates, model.shares = [tuple(r) for r in rates.tolist()], shares.tolist()
    open_ = seen.filter(~held_out(F.col("row.doc_id")))
    count = open_.count()
    draw = F.pmod(F.xxhash64("row.doc_id", F.lit(2)), F.lit(1 << 30))
    rows = open_.filter(draw < int(min(1.0, most / max(1, count)) * (1 << 30))).select("x", "votes").collect()
    if not rows:
        return model, seen
    by = dict(zip([p[0] for p in patterns], posterior.tolist()))
    x = np.array([r["x"] for r in rows], np.float32)
    model.weights = train_linear(x, np.array([by[r["votes"]] for r in rows]))
    return model, seen


def scored(seen: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from the features of fit()."""
    return seen.select("row.doc_id", score_features(F.col("x"), model).alias("score"))


def score_features(features: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_list()).astype(float)) if len(x) else [], dtype=float)

    return score(features)


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: float = 0.5) -> DataFrame:
    """The documents whose score is below the bound, unchanged. Each text is looked at once for its features, which are
    written beside the row."""
    model, seen = fit(docs, labels, carried=docs.columns)
    return seen.filter(score_features(F.col("x"), model) < bound).select("row.*")
