"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

Lexicon: counts over all labelled training documents, copies counted once, pick the words and word beginnings that
occur in toxic documents far more often than chance allows and that explain labels which no stronger term explains. The terms form a trie; intersected
with the Levenshtein automaton of a word it gives all terms within one edit. The product automaton
is built lazily, state by state, and most words leave it after three or four characters.

Context: each match is weighed by the words around it. Quotation marks around it or a reporting
word near it lower its weight, direct address raises it; the strongest window of a text and the
sum over all windows are the inputs of a logistic model with a few coefficients.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.storage import cut, drop_cut, small_side, text_batches

# Words that mark context.
ADDRESS = frozenset("you your you're ur du dich dein deine tu toi vous ton ta te ti tú eres usted".split())
REPORTING = frozenset(
    "said says wrote writes called quote quoted quotes term word phrase insult sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split()
)
OPENING, CLOSING = "\"“„«‘", "\"”“»’"

#: Words on either side of a match that count as its context.
WINDOW = 8
#: Lengths of word beginnings that can become terms; shorter stems catch too much.
STEMS = range(4, 8)
#: A term occurs in at least this share of the toxic training documents, which bounds their number.
SUPPORT = 0.004
#: Share of the toxic documents from which a pure term counts as common, and the least share of
#: otherwise unexplained ones for which a term is taken in.
COMMON, RARE = 0.05, 0.002
#: Labelled rows of the bounded sample on which the logistic model's coefficients are fitted.
SAMPLE_ROWS = 20_000
#: Edits that a misspelled term may have, for terms of at least so many letters (stems: more; the
#: learned words that a shorter stem stands for are terms of their own for misspellings).
EDITS, FUZZY_TERM, FUZZY_STEM = 1, 5, 8
#: Weight of a misspelled term relative to the term.
FUZZY_WEIGHT = 0.7
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Lexicon:
    """Terms in a trie, and the lazily determinized product with the Levenshtein automaton."""

    terms: dict[tuple[str, bool], float]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    stems: dict[int, tuple[float, int]] = field(default_factory=dict)
    words: dict[int, tuple[float, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for (term, is_stem), weight in sorted(self.terms.items()):
            node = 0
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                node = nxt
            (self.stems if is_stem else self.words)[node] = (weight, len(term))
        self.letters = {c for kids in self.children for c in kids}
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        #: by state, the best weight of terms spelled exactly and of terms within reach of an edit; 0: none
        self.stem_at: list[tuple[float, float] | None] = []
        self.word_at: list[tuple[float, float] | None] = []
        self.start = self._state({(0, 0)})
        self.seen: dict[str, tuple[float, bool] | None] = {}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The id of a set of (trie node, edits), closed under leaving out a letter of a term."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e < EDITS:
                for kid in self.children[node].values():
                    if (kid, e + 1) not in pairs:
                        pairs.add((kid, e + 1))
                        todo.append((kid, e + 1))
        key = frozenset(p for p in pairs if p[1] == 0 or (p[0], 0) not in pairs)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            for ends, least, out in ((self.stems, FUZZY_STEM, self.stem_at), (self.words, FUZZY_TERM, self.word_at)):
                exact = max((ends[n][0] for n, e in key if e == 0 and n in ends), default=0.0)
                near = max((ends[n][0] for n, e in key if e and n in ends and ends[n][1] >= least), default=0.0)
                out.append((exact, near) if exact or near else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        """The next state, -1 if no term is within reach."""
        pairs: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            kids = self.children[node]
            if c in kids:
                pairs.add((kids[c], e))
            if e < EDITS:
                pairs.add((node, e + 1))
                pairs.update((kid, e + 1) for kid in kids.values())
        nxt = self._state(pairs) if pairs else -1
        self.moves[state][c] = nxt
        return nxt

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, whether spelled exactly) of the best term for a word, None without any."""
        if word in self.seen:
            return self.seen[word]
        state, letters, moves, stem_at = self.start, self.letters, self.moves, self.stem_at
        exact = near = 0.0
        for c in word:
            if c not in letters:
                c = ""
            nxt = moves[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                break
            if got := stem_at[state]:
                exact, near = max(exact, got[0]), max(near, got[1])
        if state >= 0 and (got := self.word_at[state]):
            exact, near = max(exact, got[0]), max(near, got[1])
        found = (exact, True) if exact else (near * FUZZY_WEIGHT, False) if near else None
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[word] = found
        return found


def features(text: str | None, lexicon: Lexicon, ignored: frozenset[str] = frozenset()) -> tuple[list[float], set[str]]:
    """The logistic model's inputs, and the misspelled words among the matches."""
    text = text or ""
    words = _WORD.findall(text.lower())
    match, seen = lexicon.match, lexicon.seen
    hit = {w: m for w in set(words) if (m := seen[w] if w in seen else match(w)) and w not in ignored}
    if not hit:
        return [0.0] * 5, set()
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    lower = text.lower()
    at, weight, exact = [], [], 0
    for i, w in enumerate(words):
        if w not in hit:
            continue
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        value, spelled = hit[w]
        before = lower[spans[max(0, i - WINDOW)][0] : spans[i][0]]
        after = lower[spans[i][1] : spans[min(len(spans) - 1, i + WINDOW)][1] + 1]
        opened = sum(before.count(c) for c in set(OPENING)) % 2 or before[-1:] in OPENING and before
        if opened and any(c in after for c in CLOSING):
            value *= 0.4
        if not REPORTING.isdisjoint(around):
            value *= 0.6
        if not ADDRESS.isdisjoint(around):
            value *= 1.2
        at.append(i)
        weight.append(value)
        exact += spelled
    where, total = np.array(at), np.concatenate(([0.0], np.cumsum(weight)))
    window = total[np.searchsorted(where, where + 2 * WINDOW, "right")] - total[np.arange(len(where))]
    odd = {w for w, m in hit.items() if not m[1]}
    return [math.log1p(total[-1]), float(np.log1p(window.max())), math.log1p(exact), math.log1p(len(at) - exact), math.log1p(100 * total[-1] / (len(words) + 50))], odd


def _terms(text: str | None) -> set[tuple[str, bool]]:
    found: set[tuple[str, bool]] = set()
    for w in set(_WORD.findall((text or "").lower())):
        if 3 <= len(w) <= 20:
            found.add((w, False))
        found.update((w[:n], True) for n in STEMS if len(w) > n)
    return found


def _count_terms(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(term, stem, toxic, n): labelled documents that hold a term, combined for each batch."""

    def run(batches):
        for b in batches:
            toxic, n = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = _terms(text)
                got = got if wanted is None else got & wanted
                n.update(got)
                if label:
                    toxic.update(got)
            keys = list(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array([k[0] for k in keys], pa.string()),
                    "stem": pa.array([k[1] for k in keys], pa.bool_()),
                    "toxic": pa.array([toxic[k] for k in keys], pa.int64()),
                    "n": pa.array([n[k] for k in keys], pa.int64()),
                }
            )

    counts = rows.select("text", "toxic").mapInArrow(run, "term string, stem boolean, toxic long, n long")
    return counts.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def _tail(k: int, n: int, p: float) -> float:
    """log of (an upper bound of) the chance that k of n documents are toxic at a base rate p."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def learn_lexicon(labelled: DataFrame) -> tuple[dict[tuple[str, bool], float], dict[tuple[str, bool], float]]:
    """Terms with their weights from all of ``labelled`` (text, toxic), and the words of at least
    FUZZY_TERM letters for which a stem stands among them: a misspelling is found by the word only."""
    total = labelled.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, n = int(total.toxic or 0), int(total.n)
    if not 0 < toxic < n:
        return {}, {}
    least = max(3, math.ceil(SUPPORT * toxic))
    # at most (terms of a document) / SUPPORT of them reach that support
    wanted = frozenset((r.term, r.stem) for r in _count_terms(labelled.where("toxic = 1"), None).where(F.col("n") >= least).toLocalIterator())
    rows = _count_terms(labelled, wanted).where(F.col("toxic") >= F.col("n") * 0.5).collect()
    base = toxic / n
    chance = math.log(1 / max(len(wanted), 1))  # about one term by chance
    scored = []
    for r in rows:
        if (tail := _tail(r.toxic, r.n, base)) < chance:
            odds = math.log((r.toxic + 0.5) / (r.n - r.toxic + 0.5)) - math.log(base / (1 - base))
            if odds >= 2:
                scored.append((tail, r.term, r.stem, min(odds, 6.0), r.toxic, r.n))
    scored.sort()
    # a stem stands for all words that begin with it unless these are clearly purer
    stems = {t: k / m for _, t, is_stem, _, k, m in scored if is_stem}
    terms, words = [], {}
    for _, term, is_stem, odds, k, m in scored:
        shorter = [stems[term[:i]] for i in range(STEMS.start, len(term)) if term[:i] in stems]
        if not shorter or k / m > max(shorter) + 0.02:
            terms.append((term, is_stem, odds, k, m - k))
        elif not is_stem and len(term) >= FUZZY_TERM:
            words[term, False] = odds
    return explaining(labelled.where("toxic = 1"), terms, toxic), words


def explaining(toxic: DataFrame, terms: list[tuple[str, bool, float, int, int]], n: int) -> dict[tuple[str, bool], float]:
    """Of ``terms`` (term, whether a stem, weight, toxic and clean documents; strongest evidence first) those
    that explain the ``n`` texts of ``toxic``: all that are common (COMMON of them) and pure; then, in rounds, each
    text without a chosen term votes for its term in most such texts (less five for each clean one, ties to the stronger
    evidence), and a term is chosen if its votes outnumber its clean documents and are not just a few. The
    rounds end when one chooses none. Words that only travel along in copies of a toxic text explain nothing
    more and drop out."""
    place = {(term, is_stem): i for i, (term, is_stem, _, _, _) in enumerate(terms)}
    clean = [t[4] for t in terms]

    def held(batches):
        for b in batches:
            got = [sorted(place[k] for k in _terms(t) if k in place) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], ["ids"])

    table = cut(toxic.select("text").mapInArrow(held, "ids array<int>"), "explained")

    def summed(pick) -> dict[int, int]:
        """How often ``pick`` gives a term, over all texts."""

        def run(batches):
            for b in batches:
                got = Counter(i for ids in b.column(0).to_pylist() for i in pick(ids))
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.int64())], ["i", "n"])

        return {r.i: r.n for r in table.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}

    chosen = {i for i, (_, _, _, k, c) in enumerate(terms) if k > 20 * c and k >= max(3, COMMON * n)}
    least = max(3, math.ceil(RARE * n))
    while True:
        done = frozenset(chosen)
        left = summed(lambda ids, done=done: ids if done.isdisjoint(ids) else ())
        worth = {i: (k - 5 * clean[i], -i) for i, k in left.items()}
        votes = summed(lambda ids, done=done, worth=worth: [max(ids, key=worth.__getitem__)] if ids and done.isdisjoint(ids) else ())
        new = {i for i, k in votes.items() if k >= least and k > 5 * clean[i]}
        if not new:
            break
        chosen |= new
    drop_cut(table)
    return {terms[i][:2]: terms[i][2] for i in sorted(chosen)}


@dataclass
class Model:
    lexicon: dict[tuple[str, bool], float]
    coefficients: list[float]
    ignored: frozenset[str]


#: Intercept and coefficients where labels don't determine any.
DEFAULT = [-3.0, 1.2, 1.2, 0.8, 0.2, 0.4]


def logistic(x: np.ndarray, y: np.ndarray, prior: list[float]) -> list[float]:
    """Intercept and coefficients, drawn to ``prior``, by Newton's method. The penalized loss is
    convex; steps are halved until it falls, for full steps can diverge where classes separate."""
    x = np.hstack((np.ones((len(x), 1)), x))
    start = np.array(prior)
    ridge = np.full(x.shape[1], 2.0)
    ridge[0] = 0.1

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - z @ y + 0.5 * (ridge * (w - start) ** 2).sum()

    w, now = start, loss(start)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - y) + ridge * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step, scale = np.linalg.solve(h, g), 1.0
        while (new := loss(w - scale * step)) > now and scale > 1e-9:
            scale /= 2
        if new >= now - 1e-10 * max(1.0, abs(now)):
            break
        w, now = w - scale * step, new
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): the lexicon and the misspellings that it
    ignores from all labelled texts, coefficients from a hash sample of at most about SAMPLE_ROWS of them.
    Without labels of both kinds there are no terms, and all texts score alike, below 0.5."""
    text_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    copies = docs.select("doc_id", F.xxhash64("text").alias("th")).join(small_side(known), "doc_id")
    # one document for each text, with the label that most of its copies have
    known = cut(copies.groupBy("th").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") > 0.5).cast("int").alias("toxic")).drop("th"), "labels")
    n = known.count()
    labelled = docs.select("doc_id", "text").join(small_side(known), "doc_id").select("doc_id", "text", "toxic")
    terms, words = learn_lexicon(labelled)
    stems = {t for t, is_stem in terms if is_stem}
    terms = {k: v for k, v in words.items() if any(k[0][:n] in stems for n in STEMS)} | terms
    if not terms:
        return Model({}, DEFAULT, frozenset())

    def misspelled(batches):
        lexicon = Lexicon(terms)
        for b in batches:
            odd, bad = Counter(), Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = features(text, lexicon)[1]
                odd.update(got)
                if y:
                    bad.update(got)
            yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), pa.array([bad[w] for w in odd], pa.int64()), pa.array(list(odd.values()), pa.int64())], ["word", "toxic", "n"])

    # words within an edit of a term, which bounds their number, that are more often clean than toxic
    odd = labelled.select("text", "toxic").mapInArrow(misspelled, "word string, toxic long, n long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    ignored = frozenset(r.word for r in odd.where("n > 2 * toxic").select("word").collect())

    def run(batches):
        lexicon = Lexicon(terms)
        for b in batches:
            got = [features(t, lexicon, ignored)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["x", "y"])

    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    some = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text", "toxic")
    rows = some.mapInArrow(run, "x array<double>, y int").collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(terms, DEFAULT, ignored)
    return Model(terms, logistic(np.array([r.x for r in rows]), y, DEFAULT), ignored)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1; also for null and empty texts) and predicted (score >= 0.5).

    Only the text is an input. All other columns are kept, but for earlier columns of these two
    names, which are replaced. Repeated rows each get their score; no rows give no rows.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    place = rest.index("text")

    def run(batches):
        lexicon = Lexicon(model.lexicon)
        w = np.array(model.coefficients)
        for b in batches:
            x = np.array([features(t, lexicon, model.ignored)[0] for t in b.column(place).to_pylist()]).reshape(-1, 5)
            s = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rest, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id's text is divisible by 5. Rows
    without an id count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; labels of held-out rows are
    not used. Null and empty texts get the score of a text without any term."""
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
