"""Toxicity scores: Levenshtein automata on a lexicon trie, and context windows.

A lexicon of terms and stems is learned from labelled rows. One automaton that follows all Levenshtein automata of the
lexicon's trie at once reads each distinct word and finds terms and their misspellings. Each hit is weighed by the words
around it: in quotation marks or quoted lines it counts less, beside words of report less still, beside words of address
more. A logistic curve, fitted on labelled rows that the lexicon hasn't seen, turns the weighed sums into a score.
"""
from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Labelled rows that a model is fitted on, at most; those with the smallest hashes of their ids are taken.
SAMPLE = 8_000
#: Words on either side of a hit that are looked at.
WINDOW = 6
#: Distinct pieces of text that one Python worker keeps results of.
PIECES = 250_000
ADDRESS = frozenset("you your yours you're u ur du dich dir dein deine ihr euch tu te ti toi ton vous votre tú usted ustedes vosotros".split())
REPORT = frozenset("said says wrote writes called quoted quote quotes sagte schrieb nannte zitat dit écrit appelé dijo escribió llamó cita".split())
LOOKS = str.maketrans("013457@$", "oieastas")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@$](?=[^\W_]))*")
#: Contexts of a hit, and the weights that they start from; fit() draws them towards what labelled rows tell.
CONTEXTS, WEIGHTS = ("plain", "quoted", "reported", "addressed"), (1.0, 0.4, 0.15, 1.5)
#: How many times the toxic share of any row a term's must surely be; different words that make a row rich in a stem.
FACTOR, RICH = 2.0, 3
#: Marks of quotations: opening and closing ones, and one that is both.
MARKS = re.compile("[\"“”„«»]|(?:^|\n)[ \t]*>[^\n]*")


def edits(term: str) -> int:
    """Errors that a misspelled term may have: none up to 4 letters, one beyond."""
    return 0 if len(term) <= 4 else 1


class Automaton:
    """The union of the Levenshtein automata of a trie's terms, made deterministic as words are read.

    A state is a set of (trie node, errors); reading a letter steps all of them: along the trie, over a wrong letter, over
    an extra one, and over missing ones. A stem accepts whatever follows it. Words that fit no term die in a few letters.
    """

    def __init__(self, terms: dict[str, bool]):
        """terms: each term, and whether it is a stem."""
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # errors that some term below a node may have
        self.end: dict[int, tuple[int, bool]] = {}
        self.names: dict[int, str] = {}
        self.letters = {c for t in terms for c in t}
        for term in sorted(terms):
            node, k = 0, edits(term)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.end[node] = (k, terms[term])
            self.names[node] = term
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.stem: list[tuple[int, str] | None] = []  # errors with which a stem has been read whole, and the stem
        self.start = self._state({(0, 0)})

    def _state(self, pairs) -> int:
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]  # a missing letter
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.stem.append(min(((e, self.names[node]) for node, e in key if node in self.end and self.end[node][1] and e <= self.end[node][0]), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = []
        for node, e in self.sets[state]:
            out.append((node, e + 1))  # an extra letter
            for letter, child in self.children[node].items():
                out.append((child, e if letter == c else e + 1))
        return self._state(out)

    def read(self, word: str) -> int | None:
        """The least number of errors with which the word is a term or begins with a stem; None: it is neither."""
        got = self.find(word)
        return None if got is None else got[0]

    def find(self, word: str) -> tuple[int, str] | None:
        """As read(), with the term or stem."""
        if len(self.sets) > 50_000:  # bounds what a long run of odd words can add
            self.ids, self.sets, self.steps, self.stem = {}, [], [], []
            self.start = self._state({(0, 0)})
        state, stem = self.start, None
        for c in word:
            c = c if c in self.letters else "\0"
            got = self.steps[state].get(c)
            if got is None:
                got = self.steps[state][c] = self._step(state, c)
            state = got
            if self.stem[state] is not None and (stem is None or self.stem[state] < stem):
                stem = self.stem[state]
            if not self.sets[state]:
                return stem
        whole = [(e, self.names[node]) for node, e in self.sets[state] if node in self.end and e <= self.end[node][0]]
        return min([*whole, *([stem] if stem is not None else [])], default=None)


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the text's quotations, those that overlap joined: in quotation marks, and quoted lines."""
    spans, opened = [], None
    for m in MARKS.finditer(text):
        if m[0][0] not in '"“”„«»':
            spans.append((m.start(), m.end()))
        elif opened is None:
            opened = m.start()
        else:
            spans.append((opened, m.end()))
            opened = None
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


#: Where the curve's weights start: constant, exact hits, misspelled ones, hits among a hundred words.
CURVE = (-3.0, 6.0, 2.5, 0.0)


@dataclass
class Model:
    """terms: lexicon, with whether each is a stem; clean: misspellings that clean rows use; weights of the curve; worth:
    what a hit of a term counts, 1 unless given; context: weights of CONTEXTS."""

    terms: dict[str, bool]
    clean: frozenset[str] = frozenset()
    weights: tuple[float, ...] = CURVE
    worth: dict[str, float] = field(default_factory=dict)
    context: tuple[float, ...] = WEIGHTS
    _auto: Automaton | None = None
    _known: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"terms": self.terms, "clean": self.clean, "weights": self.weights, "worth": self.worth, "context": self.context, "_auto": None, "_known": {}}

    def find(self, word: str) -> tuple[int, float]:
        """(0: no hit, 1: a term or stem as it is, 2: a misspelled one; what it counts)."""
        if self._auto is None:
            self._auto = Automaton(self.terms)
        word = word.lower()
        got, looks = self._auto.find(word), False
        if (got is None or got[0]) and not word.isalpha():
            word = word.translate(LOOKS)
            plain = self._auto.find(word)
            got, looks = (plain if got is None or plain and plain[0] == 0 else got), True
        if got is None or got[0] and word in self.clean:
            return 0, 0.0
        return 2 if got[0] or looks else 1, self.worth.get(got[1], 1.0)

    def word(self, word: str) -> int:
        return self.find(word)[0]

    def hit(self, piece: str) -> tuple[int, float]:
        """The hit of the piece's words that comes first: one without errors, then the one that counts most."""
        return min((x for w in _WORD.findall(piece) if (x := self.find(w))[0]), key=lambda x: (x[0], -x[1]), default=(0, 0.0))

    def piece(self, piece: str) -> int:
        return self.hit(piece)[0]

    def sums(self, text: str, pieces: list[str], hits: dict) -> tuple[list[float], list[float]]:
        """Sums of exact and of misspelled hits of one text, in each context."""
        starts, ends = quotations(text)
        exact, fuzzy = [0.0] * len(CONTEXTS), [0.0] * len(CONTEXTS)
        at = 0
        for i, p in enumerate(pieces):
            kind, worth = hits.get(p, (0, 0.0))
            if kind:
                near = {w.lower().strip(".,;:!?\"'“”„«»") for w in pieces[max(0, i - WINDOW) : i + WINDOW + 1]}
                k = bisect.bisect_right(ends, at)  # the first quotation that ends behind the piece's start
                quoted = k < len(starts) and starts[k] < at + len(p)
                where = (2 if near & REPORT else 1) if quoted else 3 if near & ADDRESS else 0
                (exact if kind == 1 else fuzzy)[where] += worth
            at += len(p) + 1
        return exact, fuzzy

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x (exact, misspelled) x contexts: sums of what hits count; words of each text)."""
        out, words = np.zeros((len(texts), 2, len(CONTEXTS))), np.zeros(len(texts))
        for a, b in common.sub_batches(texts):
            split = [t.replace("\n", " ").split(" ") for t in texts[a:b]]
            words[a:b] = [len(s) for s in split]
            common.fill(self._known, set().union(*split), lambda ps: [self.hit(p) for p in ps], PIECES)
            hits = {p: k for p in set().union(*split) if (k := self._known[p])[0]}
            keys = hits.keys()
            for i, (t, s) in enumerate(zip(texts[a:b], split), a):
                if not keys.isdisjoint(s):
                    out[i] = self.sums(t, s, hits)
        return out, words

    def features(self, texts: list[str]) -> list[tuple[float, float]]:
        return [(float(x), float(y)) for x, y in self.parts(texts)[0] @ np.array(self.context)]

    def scores(self, texts: list[str]) -> np.ndarray:
        sums, words = self.parts(texts)
        return curve(design(sums, words, self.context), self.weights)


def design(sums: np.ndarray, words: np.ndarray, context) -> np.ndarray:
    """What the curve sees of each text: a constant, exact and misspelled hits, and hits among a hundred words."""
    x = sums @ np.array(context)
    return np.column_stack([np.ones(len(x)), np.log1p(x), np.log1p(100 * x.sum(1) / np.maximum(words, 1))])


def curve(z: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z @ np.array(weights), -30, 30)))


def balance(y: np.ndarray) -> np.ndarray:
    """Weights of rows: a missed toxic row counts more than a clean one, by the root of how much rarer it is."""
    toxic = max(y.sum(), 1)
    return np.where(y > 0.5, np.sqrt(max(len(y) - toxic, 1) / toxic), 1.0)


def fit_curve(z: np.ndarray, y: np.ndarray, start=CURVE, ridge: float = 0.3) -> tuple[float, ...]:
    """Logistic regression by Newton steps; weights are drawn towards `start`, so that what no row tells keeps it, and
    hits never count against toxicity."""
    w0 = np.array(start)
    w = w0.copy()
    even = balance(y)
    for _ in range(30):
        p = curve(z, w)
        g = z.T @ (even * (p - y)) + ridge * (w - w0)
        w = w - np.linalg.solve((z * (even * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), g)
        w = np.clip(w, [-12, 0, 0, 0], [0, 40, 40, 40])
    return tuple(float(v) for v in w)


def fit_contexts(sums: np.ndarray, words: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Weights of contexts and of the curve, from sums by context: each context's weight in turn takes the step, up or down
    by a fourth, that makes the rows likelier, less `ridge` times the squared log of its distance from where it started."""

    def loss(context):
        z = design(sums, words, context)
        w = fit_curve(z, y)
        p = curve(z, w)
        away = np.log(np.array(context) / WEIGHTS)
        return -(balance(y) * np.log(np.maximum(np.where(y > 0.5, p, 1 - p), 1e-12))).sum() + ridge * (away**2).sum(), w

    context = WEIGHTS
    least, weights = loss(context)
    for _ in range(12):
        before = least
        for k in range(1, len(CONTEXTS)):
            for by in (0.8, 1.25):
                tried = (*context[:k], context[k] * by, *context[k + 1 :])
                got, new = loss(tried)
                if got < least - 1e-6:
                    least, weights, context = got, new, tried
        if before - least < 1e-3:
            break
    return context, weights


def held_out(id_col: str | Column, by: int, rest: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % by == rest, F.lit(False))


def _least_shingles(batches):
    """With two least hashes of the text's runs of three words: copies and near copies mostly share them."""
    for batch in batches:
        least = [[], []]
        for text in batch.column(0).to_pylist():
            w = text.encode().split()
            runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
            for seed in (0, 1):
                least[seed].append(min(zlib.crc32(r, seed) for r in runs))
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in least]], names=["text", "toxic", "part", "one", "two"])


def _toxic_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, part) of at most `sample` labelled ids that aren't held out, one row of each group of near copies as
    far as least shingles tell; part: 0 to 4 by hash."""
    chosen = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id", 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = common.least_hashes(chosen.withColumn("_h", F.xxhash64("doc_id")), "_h", sample).orderBy("_h", "doc_id").limit(sample).drop("_h")
    rows = docs.select("doc_id", common.whole("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)).cast("int").alias("part")).withColumn("toxic", F.col("toxic").cast("int"))
    rows = rows.mapInArrow(_least_shingles, "text string, toxic int, part int, one long, two long")
    return rows.dropDuplicates(["toxic", "one"]).dropDuplicates(["toxic", "two"]).select("text", "toxic", "part")


def _words(rows: DataFrame) -> DataFrame:
    """(term, stem, rows, uses, rich) over the words of the rows and over stems of them, of four letters or more. Further
    uses in the same row count less and less; a row is rich in a stem if it has RICH different words on it."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"), lambda w: F.length(w) >= 4)
    each = rows.withColumn("i", F.monotonically_increasing_id()).select("i", F.explode(words).alias("term")).groupBy("i", "term").agg(F.count(F.lit(1)).alias("c"))
    stems = each.filter(F.length("term") > 4).select("i", "c", F.explode(F.transform(F.sequence(F.lit(4), F.length("term") - 1), lambda k: F.left("term", k))).alias("term"))
    stems = stems.groupBy("i", "term").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("ways"))
    both = each.withColumns({"stem": F.lit(False), "ways": F.lit(0)}).unionByName(stems.withColumn("stem", F.lit(True)))
    return both.groupBy("term", "stem").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.log2(F.col("c") + 1)).alias("uses"), F.count_if(F.col("ways") >= RICH).alias("rich"))


def _sure(share: Column, rows: Column, z: float) -> Column:
    """Lower bound (Wilson's) of a share that is found over so many rows."""
    return (share + z * z / (2 * rows) - z * F.sqrt(share * (1 - share) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)


def _worth(sure: float, base: float) -> float:
    """What a hit counts: how much it tells, by the log of the odds over those of any use, next to one that is all but sure."""
    odds = lambda x: min(x, 0.97) / (1 - min(x, 0.97))
    return min(1.0, max(0.05, float(np.log(odds(sure) / odds(base)) / np.log(odds(1.0) / odds(base)))))


def _terms(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, bool], dict[str, float]]:
    """Terms and stems of the toxic rows that chance can't put into them, and what each counts. clean: words of the clean
    rows, which may use a term as long as its toxic share is surely more than FACTOR times that of any row; "surely" takes
    into account how many terms are looked at. All that pass are taken: the lexicon is bounded by the words of the sample."""
    one, two = (x.select("term", "stem", F.col("rows").alias(r), F.col("uses").alias(f"{r}u"), F.col("rich").alias(f"{r}r")) for x, r in ((_words(toxic), "p"), (clean, "n")))
    count = common.cut(one.join(two, ["term", "stem"], "left").na.fill(0), "toxic-words")
    words, stems = count.filter("not stem and p > 1").count(), count.filter("stem and pr > 1").count()
    base = n_toxic / (n_toxic + n_clean)
    uses = F.col("pu") / (F.col("pu") + F.col("nu"))

    def surely(p, n, tried):
        least = int(np.ceil(max(4.0, np.log(2 * max(tried, 1)) / np.log(1 / base))))
        rows = F.col(p) + F.col(n)
        return (F.col(p) >= least) & (_sure(F.col(p) / rows, rows, float(np.sqrt(2 * np.log(2 * max(tried, 2))))) >= FACTOR * base)

    found = count.filter((~F.col("stem") & surely("p", "n", words) & (uses >= 0.5)) | (F.col("stem") & surely("pr", "nr", stems) & (uses >= 0.25)))
    found = found.select("term", "stem", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(_sure(uses, F.col("p") + F.col("n"), 1.0)).alias("sure")).collect()
    return {r.term: r.stem for r in found}, {r.term: _worth(r.sure, base) for r in found}


def _shortest(terms: dict[str, bool]) -> dict[str, bool]:
    """Without what a shorter stem covers."""
    stems: set[str] = set()
    for stem in sorted((t for t, is_stem in terms.items() if is_stem), key=len):
        if not any(stem[:k] in stems for k in range(4, len(stem))):
            stems.add(stem)
    return {t: False for t in terms if not any(t[:k] in stems for k in range(4, len(t) + 1))} | dict.fromkeys(stems, True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 3) -> Model:
    """Learn lexicon, clean misspellings and curve from at most `sample` labelled rows (doc_id, toxic) whose id isn't held
    out. Four fifths give the lexicon, the rest the curve. A word is a term if it is in so many toxic rows that
    chance can't give it and used in few enough clean ones; a stem likewise, by the rows that are rich in it. What its hits
    count is told by the toxic share of its uses. Later rounds look at the toxic rows that no term explains yet, where
    rarer terms stand out. Without labelled rows of both kinds the lexicon is
    empty and every score is the same."""
    rows = common.cut(_toxic_sample(docs, labels, sample), "toxic-sample")
    toxic, clean = rows.filter("part < 4 and toxic = 1"), rows.filter("part < 4 and toxic = 0")
    n_clean = clean.count()
    clean = common.cut(_words(clean), "clean-words")
    model = Model({})
    for _ in range(rounds):
        left = common.cut(toxic.select("text").mapInArrow(_unexplained(model), "text string"), "toxic-left")
        n_toxic = left.count()
        found, worth = _terms(left, clean, n_toxic, n_clean) if n_toxic and n_clean else ({}, {})
        if not found:
            break
        model = Model(_shortest(model.terms | found), worth=worth | model.worth)
    if not model.terms:
        return model
    near = clean.filter("not stem").select(F.col("term").alias("word")).mapInArrow(_near_terms(model), "word string")
    model.clean = frozenset(r.word for r in near.collect())
    seen = common.annotate(rows.filter("part = 4").select("text", "toxic"), "text", "parts array<double>, words double", _parts(model)).select("parts", "words", "toxic").collect()
    if seen:
        sums, words, y = np.array([r.parts for r in seen]).reshape(len(seen), 2, -1), np.array([r.words for r in seen]), np.array([r.toxic for r in seen], float)
        model.context, model.weights = fit_contexts(sums, words, y)
    return model


def _unexplained(model: Model):
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            left = [t for t, (exact, _) in zip(texts, model.features(texts)) if exact < 1] if model.terms else texts
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string())], names=["text"])

    return run


def _near_terms(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if model.word(w)], pa.string())], names=["word"])

    return run


def _parts(model: Model):
    def run(texts):
        sums, words = model.parts(texts)
        return pa.array(list(sums.reshape(len(texts), -1)), pa.list_(pa.float64())), pa.array(words, pa.float64())

    return run


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for the whole text (null: empty); rows repeat as given, an empty table gives none,
    and other columns pass through, but one named as the output is replaced (unless it is the text)."""
    return common.annotate(docs, text, f"{out} double", lambda texts: [pa.array(model.scores(texts), pa.float64())])


def query(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every document; a null text counts as empty, equal texts get equal scores, and an empty table
    gives no rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
