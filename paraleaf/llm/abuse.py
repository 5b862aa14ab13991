"""Problem 8: abusive, hateful or sexual passages, by maximum-scoring segments.

Tokens are words and word pairs of a sentence, brought to plain form and out of their disguises (letters spaced
apart, signs inside words, digits for letters, letters drawn out, single letters altered). Each token's score is its log-odds between
abusive and other sentences under Dirichlet priors that are proportional to its count over all documents. A linear-time scan
(Ruzzo and Tompa) finds every maximal-scoring segment of a sentence; a sentence that as a whole speaks against
abuse (it quotes, names, reports or lists such words) takes its segments down with it. Scores of a document are put on one
scale by extreme-value statistics: the chance that a text of its length reaches its best segment.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from .words import plain

MAX_LABELLED = 8000
MAX_LABELLED_CHARS = 100_000_000
PRIOR_WEIGHT = 400.0
ROUNDS = 3
STEP = 0.3
CONTEXT = 10
RARE = 6e-5
NOVEL_RUN = 4
# Signs and digits that stand for letters in disguised words.
STANDS_FOR = str.maketrans("013457@$", "oieastas")
_SENTENCE = re.compile("[.?!;:|\\n\\r  \u0085]+")
_TOKEN = re.compile(r"[^\W_]+")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*][^\W_]){2,}(?![^\W_])")
_GLUE = re.compile(r"[ .\-_*]")
_SIGNS = re.compile("[\"'\u05f3\u05f4\u2018\u2019\u201c\u201d*_~^+=`\xb7]+(?=[^\\W\\d_])")
_LEET = re.compile(r"[013457@$](?=[^\W\d_])|(?<=[^\W\d_])[013457@$]")
_DRAWN = re.compile(r"(.)\1{2,}")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a text, plain and out of the common disguises."""
    text = _LEET.sub(lambda m: m.group().translate(STANDS_FOR), _SIGNS.sub("", plain(text)))
    out = []
    for s in _SENTENCE.split(text):
        w = _TOKEN.findall(s)
        if not w:
            continue
        if len(w) > 2 and sum(map(len, w)) < 6 * len(w) and _APART.search(s):
            w = _TOKEN.findall(_APART.sub(lambda m: _GLUE.sub("", m.group()), s))
        out.append(w)
    return out


class Model:
    """Scores of words and word pairs; ``lam`` and ``log_k`` of the extreme-value law; ``cut`` on -log10 p."""

    def __init__(self):
        self.score: dict[str, float] = {}
        self.against: dict[str, float] = {}
        self.regular: set[str] = set()
        self.near: dict[str, str] = {}
        self.known: set[str] = set()
        self.seconds: set[str] = set()
        self.lam, self.log_k, self.cut, self.least = 1.0, 0.0, 3.0, 3.0

    def prepare(self) -> None:
        """One-letter neighbours of the telling words, for disguises and recognition errors."""
        self.near = {}
        for w, s in sorted(self.score.items(), key=lambda x: x[1]):
            if s > 1.5 and len(w) >= 4 and " " not in w:
                for v in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
                    self.near[v] = w
        self.known = self.regular | self.score.keys()
        self.seconds = {t.rpartition(" ")[2] for t, s in self.score.items() if s > 0 and " " in t}
        self._repair = lru_cache(200_000)(self._repaired)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_repair", "known", "seconds")}

    def __setstate__(self, d):
        self.__dict__.update(d)
        self.prepare()

    def _repaired(self, w: str) -> str:
        if w in self.regular or w in self.score:
            return w
        v = _DRAWN.sub(r"\1", w)
        if v != w:
            for x in (v, _DRAWN.sub(r"\1\1", w)):
                if x in self.score or x in self.regular:
                    return x
            w = v
        if len(w) >= 4:
            for x in [w, *[w[:i] + w[i + 1 :] for i in range(len(w))]]:
                if (y := self.near.get(x)) and abs(len(y) - len(w)) <= 1:
                    return y
        return w

    def tokens(self, words: list[str]) -> list[str]:
        return [self._repair(w) for w in words]

    def scores(self, words: list[str], table: dict[str, float] | None = None, base: float = STEP) -> list[float]:
        """A score for each word: its own and that of the pair with the word before, less a step."""
        get = (self.score if table is None else table).get
        out = [get(w, 0.0) - base for w in words]
        for i in range(1, len(words)):
            out[i] += get(f"{words[i - 1]} {words[i]}", 0.0)
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments of a sentence of repaired words; what speaks against them within ``CONTEXT`` words counts in."""
        found = maximal_segments(self.scores(words))
        if not found:
            return found
        con = [min(0.0, x) for x in self.scores(words, self.against, 0.0)]
        return [(a, b, s + sum(con[max(0, a - CONTEXT) : a]) + sum(con[b : b + CONTEXT])) for a, b, s in found]

    def telling(self, words: list[str]) -> bool:
        """Whether the sentence can hold a positive segment at all: some word scores above the step, alone or with the word before it."""
        get, known, repair = self.score.get, self.known, self._repair
        last = ""
        for w in words:
            if w not in known:
                w = repair(w)
            x = get(w, 0.0)
            if x - STEP > 0 or (w in self.seconds and x - STEP + get(f"{last} {w}", 0.0) > 0):
                return True
            last = w
        return False

    def significance(self, best: float, n_words: int) -> float:
        """-log10 of the chance that a text of ``n_words`` neutral words reaches ``best``."""
        log_e = self.log_k + math.log(max(2, n_words)) - self.lam * best
        if log_e > 3:
            return 0.0
        e = math.exp(log_e)
        return -(math.log10(-math.expm1(-e)) if e > 1e-8 else log_e / math.log(10))

    def document(self, text: str) -> tuple[float, float, int, int, str | None]:
        """(best, significance, significant passages, words, best passage)."""
        best, n, passage = 0.0, 0, None
        found: list[float] = []
        for w in sentences(text):
            n += len(w)
            if not self.telling(w):
                continue
            w = self.tokens(w)
            for a, b, s in self.segments(w):
                if s > self.least:
                    found.append(s)
                if s > best:
                    best, passage = s, " ".join(w[a:b])
        return best, self.significance(best, n) if best > 0 else 0.0, sum(1 for s in found if self.significance(s, n) >= self.cut), n, passage


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (start, end, score) in one pass over the scores."""
    runs: list[list] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        run = [i, i + 1, before, total]
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= run[2]:
                j -= 1
            if j < 0 or runs[j][3] >= run[3]:
                runs.append(run)
                break
            run = [runs[j][0], run[1], runs[j][2], run[3]]
            del runs[j:]
    return [(a, b, y - x) for a, b, x, y in runs]


def _log_odds(pos: Counter, neg: Counter, prior: Counter, weight: float) -> dict[str, float]:
    """Log-odds of each token with an informative Dirichlet prior, shrunk by how sure it is."""
    total = sum(prior.values()) or 1
    p, n = sum(pos.values()), sum(neg.values())
    out = {}
    for t in pos.keys() | neg.keys():
        a, b = pos[t], max(0, neg[t])
        if a + b < 3:
            continue
        prior_t = weight * (prior[t] + 0.5) / total
        x, y = a + prior_t, b + prior_t
        d = math.log(x / (p + weight - x)) - math.log(y / (n + weight - y))
        z = d / math.sqrt(1 / x + 1 / y)
        if abs(z) >= 1.64:
            out[t] = max(-4.0, min(4.0, d * min(1.0, abs(z) / 3)))
    return out


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def fit(labelled: list[tuple[str, float]], corpus: Counter, telling_cut: float = 4.0) -> Model:
    """A model from (text, label) with label > 0 abusive, < 0 clean; ``corpus`` counts words over all documents.

    Labels are of documents, abuse is of sentences: only the sentences of abusive documents that score well count as abusive. They are set against all
    other sentences and, a second time, against the sentences of clean documents that hold telling words (quotes, reports, lists).
    """
    m = Model()
    same: dict[str, str] = {}  # one object per word: the sample repeats its words many times over
    docs = [([[same.setdefault(w, w) for w in s] for s in sentences(t)], y) for t, y in labelled if t]
    seen = Counter(w for ss, _ in docs for s in ss for w in set(s))
    m.regular = {w for w, k in seen.items() if k >= 5}
    prior = corpus or seen
    m.prepare()
    # First guess: tokens that stand in far more abusive than clean documents.
    held_pos: Counter = Counter()
    held_neg: Counter = Counter()
    for ss, y in docs:
        if y > 0:
            held_pos.update({t for w in ss for t in [*w, *_pairs(w)]})
    for ss, y in docs:
        if y < 0:
            held_neg.update({t for w in ss for t in [*w, *_pairs(w)] if t in held_pos})
    n_pos, n_neg = sum(1 for _, y in docs if y > 0), sum(1 for _, y in docs if y < 0)
    for t, k in held_pos.items():
        x, y = k + 0.5, held_neg[t] + 0.5
        d = math.log(x / (n_pos + 1)) - math.log(y / (n_neg + 1))
        if d > 1 and d / math.sqrt(1 / x + 1 / y) >= 2.5 and k >= 3:
            m.score[t] = min(d, 4.0)
    m.prepare()
    # Sentences with a run of words that the documents hardly use and the clean ones hardly hold make the first guess too.
    mass = sum(prior.values()) or 1

    odd = {w for w in seen if prior[w] < RARE * mass}
    mine = {w for w in odd if held_pos[w] and math.log((held_pos[w] + 0.5) / (n_pos + 1)) - math.log((held_neg[w] + 0.5) / (n_neg + 1)) > 0.5}

    def novel(words: list[str], among: set[str]) -> bool:
        run = 0
        for w in words:
            run = run + 1 if w in among else 0
            if run >= NOVEL_RUN:
                return True
        return False

    del held_pos, held_neg
    all_sets: Counter = Counter()
    for ss, _ in docs:
        for w in ss:
            all_sets.update({*w, *_pairs(w)})
    all_sets = Counter({t: k for t, k in all_sets.items() if k >= 2})  # single ones hardly score
    for r in range(ROUNDS):
        pos: Counter = Counter()
        neg = Counter(all_sets)
        mention: Counter = Counter()
        n_abusive = n_mention = 0
        for ss, y in docs:
            for raw in ss:
                first = r == 0 and novel(raw, mine if y > 0 else odd)
                if not first and not m.telling(raw):
                    continue
                w = m.tokens(raw)
                t = {*w, *_pairs(w)}
                if y > 0 and (first or max((g[2] for g in m.segments(w)), default=0.0) > telling_cut):
                    pos.update(t)
                    neg.subtract({*raw, *_pairs(raw)})
                    n_abusive += 1
                elif y < 0 and (first or max((g[2] for g in maximal_segments(m.scores(w))), default=0.0) > telling_cut / 2):
                    mention.update(t)
                    n_mention += 1
        background = _log_odds(pos, neg, prior, PRIOR_WEIGHT)
        m.against = {}
        for t in pos.keys() | mention.keys():
            x, z = pos[t] + 0.5, mention[t] + 0.5
            d = math.log(x / (n_abusive + 1)) - math.log(z / (n_mention + 1))
            sure = abs(d) / math.sqrt(1 / x + 1 / z)
            if sure >= 1.3:
                m.against[t] = max(-4.0, min(4.0, d * min(1.0, sure / 2.5)))
        m.score = {t: background.get(t, 0.0) + m.against.get(t, 0.0) for t in background.keys() | m.against.keys()}
        m.prepare()
    # Extreme values: lambda from the scores of words as all documents use them, K from the clean documents.
    mass = sum(prior.values()) or 1
    dist = [(m.score.get(w, 0.0), k / mass) for w, k in prior.items()]
    rest = max(0.0, 1 - sum(q for _, q in dist))
    lo, hi = 1e-3, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(q * math.exp(mid * s) for s, q in dist) + rest < 1 else (lo, mid)
    m.lam = min(max(lo, 0.2), 3.0)
    rows = [(m.document(t), y) for t, y in labelled if t]
    null = sorted(m.lam * d[0] - math.log(max(2, d[3])) for d, y in rows if y < 0)
    if null:
        m.log_k = null[len(null) // 2] + math.log(math.log(2))
        rows = [(m.significance(d[0], d[3]) if d[0] > 0 else 0.0, y) for d, y in rows]
        up = sum(1 for _, y in rows if y > 0)
        best, below = (-1.0, 0.0, m.cut), 0.0
        for cut in sorted({round(s, 2) for s, _ in rows if s > 0}):
            tp = sum(1 for s, y in rows if s >= cut and y > 0)
            fp = sum(1 for s, y in rows if s >= cut and y < 0)
            # Of the best cuts the one in the widest gap, in its middle.
            best = max(best, (2 * tp / max(1, tp + fp + up), cut - below, (cut + below) / 2))
            below = cut
        m.cut = best[2]
    return m


def _word_counts(docs: DataFrame, text: str, vocabulary: set[str]) -> Counter:
    """How often all documents use the words of ``vocabulary``, which the labelled sample bounds."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocab, counts, other = shared.value, Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                w = _TOKEN.findall(plain(t))
                counts.update(w)
                if len(counts) > 500_000:
                    other += sum(k for x, k in counts.items() if x not in vocab)
                    counts = Counter({x: k for x, k in counts.items() if x in vocab})
        other += sum(k for x, k in counts.items() if x not in vocab)
        kept = {x: k for x, k in counts.items() if x in vocab} | {"": other}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept)), pa.array(list(kept.values()), pa.int64())], names=["w", "k"])

    rows = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "w string, k long").groupBy("w").agg(F.sum("k").alias("k")).collect()
    return Counter({r["w"]: r["k"] for r in rows})


def label_votes(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, vote): abusive minus clean marks of a document; ties and unsure or null marks leave none."""
    x = F.lower(F.trim(label))
    votes = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.when(x == "abusive", 1).when(x == "clean", -1).otherwise(0)).alias("vote"))
    return votes.where("vote <> 0")


def abuse_scores(docs: DataFrame, labels: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, score, best_segment, n_passages, n_words, passage, abusive), one row per document.

    ``score`` is -log10 of the chance of the document's best segment. Null, blank or empty texts score 0 and are not abusive; with no usable
    labels nothing is abusive. The model is fitted on at most ``MAX_LABELLED`` labelled documents of together at most ``MAX_LABELLED_CHARS`` (by hash of the key);
    word counts and scores take in all documents and whole texts.
    """
    spark = docs.sparkSession
    keep = keep or []
    votes = label_votes(labels, key, "label").orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    sample = written(docs.select(F.xxhash64(key).alias("h"), key, text).where(F.col(text).isNotNull()).join(F.broadcast(votes), key), "labelled")
    chars, last = 0, None
    for r in sample.select("h", F.length(text).alias("n")).orderBy("h", key).collect():  # at most MAX_LABELLED rows
        chars += r["n"]
        if chars > MAX_LABELLED_CHARS:
            break
        last = r["h"]
    sample = sample.where(F.col("h") <= F.lit(last).cast("long")).select(text, "vote").toArrow()
    labelled = sorted(zip(sample.column(0).to_pylist(), map(float, sample.column(1).to_pylist()), strict=True))
    del sample
    vocabulary = {w for t, _ in labelled for s in sentences(t) for w in s}
    shared = spark.sparkContext.broadcast(fit(labelled, _word_counts(docs, text, vocabulary) if labelled else Counter()))
    from pyspark.sql import types as T

    added = T.StructType.fromDDL("score double, best_segment double, n_passages int, n_words int, passage string, abusive boolean")
    src = docs.select(F.col(key).alias("doc_id"), *keep, F.col(text).alias("_text")).where("doc_id is not null")
    schema = T.StructType([*src.schema.fields[:-1], *added.fields])

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                best, sig, k, n, passage = m.document(t) if t else (0.0, 0.0, 0, 0, None)
                out.append((round(sig, 4), round(best, 4), k, n, passage, best > m.least and sig >= m.cut))
            cols = list(zip(*out, strict=True))
            kinds = (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=schema.names)

    return src.mapInArrow(run, schema)
