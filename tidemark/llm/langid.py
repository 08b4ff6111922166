"""Language identification by a linear-chain conditional random field.

The words of a text are the chain's places, the languages its labels. A word's emission sums learned weights of its
affixes, character n-grams and of the word itself (a learned lexicon), all hashed into one table; transitions are learned
with them, from windows of labelled texts, some of which are joined from two languages. Forward-backward gives each word's
label probabilities, so code-switched texts are labelled word by word; a document's language has the most letters.
"""
from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .toxicity import held_out

#: The classifier's sample: labelled rows of each language, at most, by the least hashes of their ids; their whole texts are
#: learned from, in windows of so many pieces.
SAMPLE, SPAN = 150, 64
#: Places of a chain's block.
CUT = 128
#: Size of the table of hashed features; distinct pieces of text that one Python worker keeps emissions of.
TABLE, PIECES = 1 << 18, 300_000
GRAMS = 4


def letters_of(piece: str) -> str:
    body = piece.strip(".,;:!?\"'()|")
    return body.lower() if body.isalpha() else "".join(filter(str.isalpha, piece)).lower()


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word): n-grams of 1 to GRAMS letters of the word between marks of its start
    and end, so those at an end are its affixes, and the whole word."""
    flat = "".join(f"^{w}$" for w in words)
    cp = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    after = (first + size)[owner]
    at = np.arange(len(cp))
    mult, feats, owners = np.uint64(0x9E3779B97F4A7C15), [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(cp), np.uint64)
        for n in range(1, GRAMS + 1):
            h = h[: len(cp) - n + 1] * mult + (cp[n - 1 :] + np.uint64(1)) if n > 1 else cp + np.uint64(1)
            ok = at[: len(h)] + n <= after[: len(h)]
            x = (h[ok] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            feats.append((x >> np.uint64(40)) % np.uint64(TABLE))
            owners.append(owner[: len(h)][ok])
        power = np.cumprod(np.full(int(size.max()) if len(size) else 0, mult))
        place = at - first[owner]
        word = np.add.reduceat((cp + np.uint64(7)) * power[place], first) * np.uint64(0xA0761D6478BD642F)
        feats.append((word >> np.uint64(40)) % np.uint64(TABLE))
        owners.append(np.arange(len(words)))
    f, o = np.concatenate(feats).astype(np.int64), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return f[order], np.searchsorted(o[order], np.arange(len(words)))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # TABLE x languages
    moves: np.ndarray  # transitions between languages, from row to column
    _known: dict = field(default_factory=dict)
    _table: np.ndarray | None = None
    _sizes: np.ndarray | None = None
    _next: int = 1

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "moves": self.moves, "_known": {}, "_table": None, "_sizes": None, "_next": 1}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Sums of the words' weights, a bounded number of words at once."""
        out = np.empty((len(words), len(self.langs)), self.weights.dtype)
        for a in range(0, len(words), 10_000):
            feats, first = hashed(words[a : a + 10_000])
            out[a : a + 10_000] = np.add.reduceat(self.weights[feats], first, axis=0)
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Number the pieces that aren't known, and keep their letters and emissions; 0 stands for those without a letter."""
        missing = [p for p in pieces if p not in self._known]
        if self._table is None or len(self._known) + len(missing) > PIECES:
            self._known = {}
            missing = list(pieces)
            self._table = np.zeros((max(PIECES, len(missing)) + 1, len(self.langs)), np.float32)
            self._sizes = np.zeros(len(self._table))
            self._next = 1
        words = [letters_of(p) for p in missing]
        some = [w for w in words if w]
        if some:
            n = self._next + len(some)
            self._table[self._next : n] = self.emissions(some)
            self._sizes[self._next : n] = [len(w) for w in some]
        for p, w in zip(missing, words):
            self._known[p] = self._next if w else 0
            self._next += bool(w)

    def _run(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as lists of pieces: (how many pieces of each have letters, their numbers, their label probabilities)."""
        self._learn(set().union(*split))
        found = np.fromiter(map(self._known.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        owner = np.repeat(np.arange(len(split)), [len(s) for s in split])[found > 0]
        sizes, found = np.bincount(owner, minlength=len(split)), found[found > 0]
        return sizes, found, marginals(self._table[found].astype(np.float64), sizes, self.moves)[0]

    def label(self, texts: list[str]) -> list[list[tuple[str, np.ndarray]]]:
        """Each text's pieces that have letters, with their label probabilities."""
        split = [t.split() for t in texts]
        sizes, _, probs = self._run(split)
        return [list(zip([w for w in s if self._known[w]], p)) for s, p in zip(split, np.split(probs, np.cumsum(sizes)[:-1]))]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its share of the letters by the labels' probabilities); ("und", 0) for a text without letters."""
        out = []
        for a, b in common.sub_batches(texts, 1_000_000):
            sizes, found, probs = self._run([t.split() for t in texts[a:b]])
            mass = np.zeros((b - a, len(self.langs)))
            some = np.flatnonzero(sizes)
            if len(some):
                mass[some] = np.add.reduceat(probs * self._sizes[found][:, None], (np.cumsum(sizes) - sizes)[some], axis=0)
            best = mass.argmax(1)
            for n, k, m in zip(sizes, best, mass):
                out.append((self.langs[k], float(min(1.0, m[k] / m.sum()))) if n else ("und", 0.0))
        return out


def marginals(scores: np.ndarray, sizes, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of each place by forward-backward, of chains whose scores lie one after the other; with `pairs`
    also the expected number of each transition over all chains.

    Chains are cut into blocks of at most CUT places. The blocks' products of transfer matrices give what enters each
    block from either side, so all blocks, of long and short chains, go through the recursions side by side.
    """
    sizes = np.asarray(sizes, np.int64)
    n_langs, total = moves.shape[0], int(sizes.sum())
    step = np.exp(moves)
    if not total:
        return np.zeros((0, n_langs)), np.zeros((n_langs, n_langs)) if pairs else None
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    per = -(-sizes // CUT)
    chain = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(sizes) - sizes, per) + CUT * nth
    size = np.minimum(CUT, sizes[chain] - CUT * nth)
    last = nth == per[chain] - 1
    rank = np.argsort(-size, kind="stable")  # the blocks that reach a place are the first ones in this order
    order, place = start[rank], np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    alive = np.searchsorted(-size[rank], -np.arange(1, CUT + 2), "right")

    into, after = np.full((len(rank), n_langs), 1.0 / n_langs), np.ones((len(rank), n_langs))
    many = per[chain[rank]] > 1
    if many.any():
        t = np.einsum("bi,ij->bij", e[order], np.eye(n_langs))
        for k in range(1, int(size.max())):
            m = alive[k]
            t[:m] = (t[:m].reshape(-1, n_langs) @ step).reshape(m, n_langs, n_langs) * e[order[:m] + k][:, None, :]
            if k % 8 == 0:
                t[:m] /= t[:m].max(axis=(1, 2), keepdims=True)
        for k in range(1, int(per.max())):
            b = np.flatnonzero(nth == k)
            x = np.einsum("bi,bij->bj", into[place[b - 1]], t[place[b - 1]]) @ step
            into[place[b]] = x / x.sum(axis=1, keepdims=True)
        for k in range(int(per.max()) - 1, 0, -1):
            b = np.flatnonzero(nth == k)
            x = np.einsum("bij,bj->bi", t[place[b]], after[place[b]]) @ step.T
            after[place[b - 1]] = x / x.sum(axis=1, keepdims=True)
        del t
    alpha = np.empty_like(e)
    a = into
    for k in range(int(size.max())):
        m = alive[k]
        a = (a[:m] @ step if k else a[:m]) * e[order[:m] + k]
        a /= a.sum(axis=1, keepdims=True)
        alpha[order[:m] + k] = a
    beta = np.empty_like(e)
    now = after
    for k in range(int(size.max()) - 1, -1, -1):
        m, more = alive[k], alive[k + 1]
        x = (e[order[:more] + k + 1] * now[:more]) @ step.T
        now[:more] = x / x.sum(axis=1, keepdims=True)
        beta[order[:m] + k] = now[:m]
    expected = None
    if pairs:
        inner = np.setdiff1d(np.arange(total - 1), np.cumsum(sizes) - 1)
        both = alpha[inner][:, :, None] * step * (e[inner + 1] * beta[inner + 1])[:, None, :]
        expected = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha, expected


def gradient(scores: np.ndarray, sizes, y: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the chains' negative log-likelihood, by the score of each place and label, and by the transitions: what is
    expected less what is seen."""
    p, expected = marginals(scores, sizes, moves, pairs=True)
    p[np.arange(len(y)), y] -= 1
    inner = np.setdiff1d(np.arange(len(y) - 1), np.cumsum(sizes) - 1)
    np.add.at(expected, (y[inner], y[inner + 1]), -1)
    return p, expected


def train(windows: list[tuple[list[str], str]], epochs: int = 4, seed: int = 0) -> Model:
    """Fit by AdaGrad on batches of windows (words, language); every third window is joined to one of another language."""
    langs = sorted({lang for _, lang in windows})
    n = len(langs)
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((TABLE, n), np.float32), np.zeros((n, n))
    if n < 2:
        return Model(langs, weights, moves)
    sums, move_sums = np.full((TABLE, n), 1e-3, np.float32), np.full((n, n), 1e-3)
    code = {lang: i for i, lang in enumerate(langs)}
    chains = []
    for i, (words, lang) in enumerate(windows):
        y = [code[lang]] * len(words)
        other = windows[int(rng.integers(len(windows)))]
        if i % 3 == 0 and other[1] != lang:
            cut = len(words) // 2
            words, y = words[:cut] + other[0][cut:], y[:cut] + [code[other[1]]] * len(other[0][cut:])
        if words:
            chains.append((words, np.array(y)))
    ready = []
    for a in range(0, len(chains), 64):
        part = chains[a : a + 64]
        words, at = np.unique(np.array([w for c, _ in part for w in c], object), return_inverse=True)
        feats, first = hashed(list(words))
        ready.append((feats.astype(np.int32), first, at, [len(c) for c, _ in part], np.concatenate([y for _, y in part])))
    for _ in range(epochs):
        for k in rng.permutation(len(ready)):
            feats, first, at, sizes, y = ready[k]
            e = np.add.reduceat(weights[feats], first, axis=0).astype(np.float64)[at]
            g, mg = gradient(e, sizes, y, moves)
            g = np.stack([np.bincount(at, g[:, j], len(first)) for j in range(n)], axis=1) / len(sizes)
            per = np.diff(np.append(first, len(feats)))
            used, where = np.unique(feats, return_inverse=True)
            grad = np.stack([np.bincount(where, np.repeat(g[:, j], per), len(used)) for j in range(n)], axis=1).astype(np.float32) + 1e-6 * weights[used]
            sums[used] += grad * grad
            weights[used] -= 0.1 * grad / np.sqrt(sums[used])
            mg /= len(sizes)
            move_sums += mg * mg
            moves = np.clip(moves - 0.05 * mg / np.sqrt(move_sums), -6, 6)
    return Model(langs, weights, moves)


def windows_of(docs: DataFrame, sample: int = SAMPLE, lang: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(w, l): windows of SPAN pieces and their language: the whole texts of at most `sample` rows of each language, of those
    whose id isn't held out. Rows are chosen by hashes; a language with more of them is thinned by its count first, so that
    no task ranks all rows of a language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col, 4, 2))
    rows = rows.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    share = F.least(F.lit(1.0), (1.5 * sample + 100) / F.col("n"))
    most = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).select("l", (F.lit(-(2.0**63)) + share * 2.0**64).alias("most"))
    most = common.cut(most, "language-shares")  # a row for each language; its size is known, so that texts needn't be shuffled to it
    thin = rows.join(most, "l").filter(F.col("h").cast("double") <= F.col("most"))
    first = Window.partitionBy("l").orderBy("h", "i", F.xxhash64("t"))
    chosen = thin.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample)
    pieces = F.split(F.trim("t"), r"\s+")
    cut = chosen.withColumn("p", pieces).select("i", "l", "k", "p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p"), F.lit(1)), F.lit(SPAN))).alias("a"))
    return cut.select(F.slice("p", F.col("a"), SPAN).alias("w"), "l", F.xxhash64("i", "k", "a").alias("h")).orderBy("h", "l").select("w", "l")


def fit(docs: DataFrame, sample: int = SAMPLE, lang: str = "lang", id_col: str = "doc_id", text: str = "text") -> Model:
    """A model from all windows of the sample's texts. The sample is bounded in rows of a language; every language that a
    labelled row has is learned."""
    found = [([w for p in r.w if (w := letters_of(p))], r.l) for r in windows_of(docs, sample, lang, id_col, text).collect()]
    return train([x for x in found if x[0]])


def _predict(model: Model):
    def run(texts: list[str]):
        if len(model.langs) > 1:
            got = model.predict(texts)
        else:
            got = [(model.langs[0], 1.0) if model.langs and any(map(str.isalpha, t)) else ("und", 0.0) for t in texts]
        return pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of the whole text and its share of the letters. A text that is null or has no letter gives
    ("und", 0); rows repeat as given; an empty table gives none; other columns pass through, but one named as an output
    is replaced (unless it is the text)."""
    return common.annotate(docs, text, f"{lang} string, {score} double", _predict(model))


def query(spark, sf_dir: str) -> DataFrame:
    """Language and its share of the letters for every document; a null text counts as empty and gives "und", equal texts
    get equal answers, and an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents")
    rows = identify(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
