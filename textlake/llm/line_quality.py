"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.runtime import drop_extra, ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
FEATURES = ("symbols", "repeats", "copied line", "capitals", "short", "no end mark", "bias")
ENDS = (".", "!", "?", '"', ":", ";")
#: Lines of a training chain; longer pages give several.
CHAIN = 32
#: Odds of boilerplate against content for a line of a page marked bad, before the line is looked at.
PRIOR = 4.0
#: How many times as much the scores of label pairs and first labels are held back in training as those of features.
STEADY = 50.0


@dataclass(frozen=True)
class Crf:
    """Scores of label 1 (boilerplate) against 0 (content) by feature, of label pairs and of first labels."""

    weights: tuple[float, ...] = (6.0, 6.0, 3.0, 2.0, 0.3, 0.3, -3.0)
    pairs: tuple[tuple[float, float], tuple[float, float]] = ((0.6, -0.6), (-0.6, 0.6))
    first: tuple[float, float] = (0.3, -0.3)


@dataclass
class Page:
    """One text read whole: its counts and, for each line with a word, features and number of words."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    sizes: list[int] = field(default_factory=list)
    features: list[tuple[float, ...]] = field(default_factory=list)


def read(text: str | None) -> Page:
    page = Page()
    if not text:
        return page
    page.n_symbols = len(SYMBOL.findall(text))
    words: list[str] = []
    seen: set[str] = set()
    lines: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            lines.append((line, line in seen))
            seen.add(line)
            words += own
            page.sizes.append(len(own))
    page.n_words = len(words)
    page.word_chars = sum(map(len, words))
    page.n_dup_lines = sum(copied for _, copied in lines)
    repeated = bytearray(len(words))
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                repeated[j : j + 3] = repeated[i : i + 3] = b"\1\1\1"
        page.n_repeat_words = sum(repeated)
    at = 0
    noisy, echoing = page.n_symbols > 0, page.n_repeat_words > 0
    for (line, copied), n in zip(lines, page.sizes):
        symbols = min(1.0, len(SYMBOL.findall(line)) / n) if noisy else 0.0
        repeats = sum(repeated[at : at + n]) / n if echoing else 0.0
        at += n
        page.features.append((symbols, repeats, float(copied), float(line.isupper()), float(n < 5), float(not line.rstrip().endswith(ENDS)), 1.0))
    return page


def viterbi(crf: Crf, features: list[tuple[float, ...]]) -> list[int]:
    """The likeliest labels of a text's lines; of equal ones, content."""
    if not features:
        return []
    scores = [sum(w * f for w, f in zip(crf.weights, x)) for x in features]
    (cc, cb), (bc, bb) = crf.pairs
    c, b = crf.first[0], crf.first[1] + scores[0]
    back = []
    for s in scores[1:]:
        to_c, to_b = (c + cc, 0) if c + cc >= b + bc else (b + bc, 1), (c + cb, 0) if c + cb >= b + bb else (b + bb, 1)
        back.append((to_c[1], to_b[1]))
        c, b = to_c[0], to_b[0] + s
    labels = [0 if c >= b else 1]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


@dataclass
class Chain:
    """Up to CHAIN neighbouring lines of a training page: the page they are of, whether it is marked bad, whether
    they are its first ones, and the lines' words and features."""

    page: tuple
    bad: bool
    start: bool
    sizes: np.ndarray
    features: np.ndarray


class _Batch:
    """Chains of falling length side by side; a step along the lines works on those that are long enough."""

    def __init__(self, chains: list[Chain]):
        self.chains = sorted(chains, key=lambda c: -len(c.sizes))
        self.length = np.array([len(c.sizes) for c in self.chains])
        self.open = [int((self.length > t).sum()) for t in range(int(self.length[0]))]
        self.there = np.arange(len(self.open))[None, :] < self.length[:, None]
        self.start = np.array([c.start for c in self.chains])
        self.bad = np.array([c.bad for c in self.chains])
        self.x = np.zeros((len(self.chains), len(self.open), len(FEATURES)))
        self.words = np.zeros(self.there.shape)
        for i, c in enumerate(self.chains):
            self.x[i, : len(c.sizes)] = c.features
            self.words[i, : len(c.sizes)] = c.sizes
        pages: dict[tuple, list[int]] = {}
        for i, c in enumerate(self.chains):
            pages.setdefault(c.page, []).append(i)
        self.pages = [(np.array(rows), self.chains[rows[0]].bad) for rows in pages.values()]

    def marginals(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of both labels at each line, and of each pair of labels summed over all neighbours."""
        dims = len(FEATURES)
        w, pairs, first = theta[:dims], theta[dims : dims + 4].reshape(2, 2), theta[dims + 4 :]
        emit = np.zeros((*self.there.shape, 2))
        emit[:, :, 1] = self.x @ w
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = first * self.start[:, None] + emit[:, 0]
        for t in range(1, len(self.open)):
            n = self.open[t]
            alpha[:n, t] = np.logaddexp(alpha[:n, t - 1, 0, None] + pairs[0], alpha[:n, t - 1, 1, None] + pairs[1]) + emit[:n, t]
        for t in range(len(self.open) - 2, -1, -1):
            n = self.open[t + 1]
            nxt = emit[:n, t + 1] + beta[:n, t + 1]
            beta[:n, t] = np.logaddexp(pairs[:, 0] + nxt[:, 0, None], pairs[:, 1] + nxt[:, 1, None])
        ends = alpha[np.arange(len(self.length)), self.length - 1]
        z = np.logaddexp(ends[:, 0], ends[:, 1])
        node = np.exp(alpha + beta - z[:, None, None]) * self.there[:, :, None]
        joint = np.zeros((2, 2))
        for t in range(1, len(self.open)):
            n = self.open[t]
            joint += np.exp(alpha[:n, t - 1, :, None] + pairs + (emit[:n, t] + beta[:n, t])[:, None, :] - z[:n, None, None]).sum(0)
        return node, joint

    def labels(self, theta: np.ndarray) -> np.ndarray:
        """The likelier label of each line, given its page's: a line of a bad page is boilerplate with odds of
        PRIOR, of any other page with the inverse, beside what the field says. At least half of the words of a bad
        page are boilerplate, at most half of any other's: the likeliest lines are turned until that holds."""
        chance = self.marginals(theta)[0][:, :, 1]
        odds = np.log(chance + 1e-12) - np.log(1 - chance + 1e-12)
        y = (odds + np.where(self.bad, np.log(PRIOR), -np.log(PRIOR))[:, None] > 0) & self.there
        for rows, bad in self.pages:
            at = [(i, t) for i in rows for t in range(self.length[i])]
            half = 0.5 * sum(self.words[i, t] for i, t in at)
            marked = sum(self.words[i, t] for i, t in at if y[i, t])
            for i, t in sorted(at, key=lambda p: chance[p], reverse=bad):
                if marked >= half if bad else marked <= half:
                    break
                if y[i, t] != bad:
                    y[i, t] = bad
                    marked += self.words[i, t] * (1 if bad else -1)
        return y.astype(int)

    def fitted(self, theta: np.ndarray, y: np.ndarray, steps: int, rate: float, penalty: float) -> np.ndarray:
        """Likelihood of the labels ``y`` climbed by gradient steps from ``theta`` on."""
        dims, n = len(FEATURES), len(self.chains)
        own = np.einsum("nt,ntd->d", y * self.there, self.x)
        steady = self.there[:, 1:]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & steady).sum() for b in (0, 1)] for a in (0, 1)])
        begun = np.array([(self.start & (y[:, 0] == a)).sum() for a in (0, 1)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        # pages of one kind of line are the most, so what follows what is held back more than what a line shows
        penalties = np.array([penalty] * dims + [STEADY * penalty] * 6)
        for step in range(1, steps + 1):
            node, joint = self.marginals(theta)
            grad = np.concatenate([own - np.einsum("nt,ntd->d", node[:, :, 1], self.x), (seen - joint).ravel(), begun - node[self.start, 0].sum(0)])
            grad = grad / n - penalties * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return theta


def chains_of(page: Page) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """All lines of a page, cut into chains of CHAIN lines."""
    cuts = range(0, len(page.sizes), CHAIN)
    return [(i == 0, np.array(page.sizes[i : i + CHAIN], float), np.array(page.features[i : i + CHAIN], float)) for i in cuts]


def fit(chains: list[Chain], rounds: int = 3, steps: int = 80, rate: float = 0.1, penalty: float = 1e-3) -> Crf:
    """A field learnt from pages of which only the whole is labelled.

    The lines' labels are latent: from the default weights on, each round marks the lines as the field so far
    sees them, turned where the page's label says otherwise, and fits the field to these marks. So the clean
    lines of a bad page count as content, and the odd bad line of a good one as boilerplate. Without both
    kinds of page the default weights hold.
    """
    if len({c.bad for c in chains}) < 2:
        return Crf()
    batch = _Batch(chains)
    start = Crf()
    theta = np.array([*start.weights, *start.pairs[0], *start.pairs[1], *start.first])
    for _ in range(rounds):
        theta = batch.fitted(theta, batch.labels(theta), steps, rate, penalty)
    t, dims = [round(float(a), 6) for a in theta], len(FEATURES)
    return Crf(tuple(t[:dims]), ((t[dims], t[dims + 1]), (t[dims + 2], t[dims + 3])), (t[dims + 4], t[dims + 5]))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = 800, chains: int = 2000) -> Crf:
    """A field learnt from at most ``sample`` labelled documents, those whose ids hash lowest, and at most
    ``chains`` chains of their lines: the bounds of this fit, the same documents at every run. Lines become
    features where they lie; no text comes to the driver. Ids may be of any type. Documents without a label,
    null labels and ids and unlabelled tables are left out.
    """
    rows = drop_extra(labels, "doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    wanted = F.broadcast(rows.select(F.col("doc_id").alias("_id"), "quality").orderBy(F.xxhash64("_id"), "_id").limit(sample))
    found = drop_extra(docs, "doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id"))
    found = found.select(F.xxhash64("_id").alias("id"), F.xxhash64("text").alias("hash"), (F.col("quality") == 0).alias("bad"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text_hash, bad, text in zip(*[c.to_pylist() for c in batch.columns]):
                for part, (_, sizes, features) in enumerate(chains_of(read(text))):
                    out.append((key, text_hash, part, bad, sizes.tobytes(), features.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["id", "hash", "part", "bad", "sizes", "features"])

    cut = found.mapInArrow(run, "id long, hash long, part int, bad boolean, sizes binary, features binary").orderBy("id", "hash", "part").limit(chains).collect()
    return fit([Chain((r.id, r.hash), r.bad, r.part == 0, np.frombuffer(r.sizes), np.frombuffer(r.features).reshape(-1, len(FEATURES))) for r in cut])


def judge(docs: DataFrame, crf: Crf, least_share: float = 0.5, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    Lines with a word are labelled by Viterbi decoding of ``crf``; content_share is the share of words in
    lines marked content, and a document below ``least_share`` goes. The base rules decide first.
    Each text is read whole in one pass where it lies: no shuffle.

    Null or empty text: no words, so it fails the base rules; content_share 0. Repeated rows: each judged.
    Ties between labels: content. Empty table: no rows. Extra columns of any name are left alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                p = read(text)
                content = sum(n for n, label in zip(p.sizes, viterbi(crf, p.features)) if not label)
                share = content / p.n_words if p.n_words else 0.0
                failed = p.n_words < least_words or 100 * p.n_repeat_words > repeat_percent * p.n_words
                rows.append((p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, failed, not failed and share >= least_share, share))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    d = drop_extra(docs, "doc_id", "text")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    kinds = [d.schema["doc_id"].dataType.simpleString(), *["long"] * 5, *["boolean"] * 2, "double"]
    return d.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def keep(docs: DataFrame, crf: Crf, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they were, in one pass without a join. Nulls, empty
    texts, repeated rows and an empty table as there; extra columns may have any names."""
    ship(docs.sparkSession)
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in batch.column(position).to_pylist():
                p = read(text)
                content = sum(n for n, label in zip(p.sizes, viterbi(crf, p.features)) if not label)
                good.append(p.n_words >= 50 and 2 * p.n_repeat_words <= p.n_words and content >= least_share * p.n_words)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
