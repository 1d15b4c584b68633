"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs (look-alike letters of other scripts, rare accents, styled letters; the common accents of
Latin-1 tell words apart and stay) and digit or symbol
substitutions to Latin letters, gives i and l one form (1 stands for both), and turns punctuation into blanks. Lexicon entries
are whole words or word beginnings; exception phrases cancel the entries inside them. The weights of the matches, divided
by the text's length in words, give the score through a logistic curve.

The lexicon is a short list of seeds and what the training rows teach: words and beginnings of words that take a larger share of
the toxic texts' words than of the others'. Toxic texts that a seed explains teach nothing. Counting is distributed; the driver
gets the entries that at least SHARE of the unexplained toxic rows have, hence at most 1 / SHARE times the entries of a mean row.

Defined cases: null and empty texts have density 0 and the least score; very long texts are matched as a whole, in time linear in
their length; without training rows of both classes the seeds alone and a fixed curve hold; null ids are not held out; entries of
equal worth go by their text; of several texts of one id one is a training row, otherwise repeated rows are rows like any other;
other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TRAIN_ROWS, held_out, staged, training_rows

# --- fixed values -------------------------------------------------------------------------------------------------
#: Seeds: entry and weight. A trailing * marks the beginning of a word.
SEEDS = {
    "idiot*": 1.0, "moron*": 1.0, "imbecile*": 1.0, "stupid*": 0.8, "loser*": 0.8, "scum*": 1.0, "pathetic": 0.7, "worthless": 0.7,
    "disgusting": 0.7, "trash": 0.6, "clown": 0.6, "dumbass*": 1.0, "bastard*": 1.0, "bitch*": 1.0, "asshole*": 1.0, "fuck*": 1.0,
    "dummkopf": 0.8, "arschloch": 1.0, "abschaum": 1.0, "connard*": 1.0, "salope*": 1.0, "ordure": 0.6, "imbecil*": 1.0,
    "gilipollas": 1.0, "cabron*": 1.0, "basura": 0.5,
}
#: Phrases inside which entries do not count.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown nose", "circus clown", "pathetic fallacy",
    "not stupid", "not an idiot", "not a moron", "not a loser", "not worthless", "not trash", "sore loser", "pond scum", "idiot proof",
    "kein idiot", "pas idiot", "no idiota", "basura organica", "cubo de basura",
)
#: Letters of other scripts and the Latin letters that they look like.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɡ": "g", "ɑ": "a",
}
#: Digits and the letters that they replace; symbols do so only before a letter or digit.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i"}
# ------------------------------------------------------------------------------------------------------------------

#: Lengths of word beginnings that are learnt; least support, in rows and as a share of the toxic rows without a seed; least
#: logarithm of the ratio of mean shares of words; share of a text's words from which on a text counts no more.
STEMS, SUPPORT, SHARE, ODDS, FULL = range(3, 10), 2, 0.02, 2.5, 0.05
#: Entries that a toxic training row needs before more entries are of no use to it.
DEMAND = 2
#: Logarithm of the ratio from which on an entry has weight 1, and what is added to sums of shares before they are divided.
SUREST, SMOOTH = 6.0, 0.002
#: Texts are as long as this at least, in words, for the density.
SHORTEST = 20


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for lo, hi in ((0x100, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2150), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in range(lo, hi):  # by rule: what decomposes into one ASCII letter or digit
            base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
            if base.isascii() and base.isalnum():
                out[c] = base
    out |= {ord(a): b for a, b in LOOKALIKE.items()}
    for c in (*range(0x21, 0x7F), *range(0xA1, 0xC0), 0xD7, 0xF7, *range(0x2010, 0x2060), *range(0x3000, 0x3004)):
        if not chr(c).isalnum():
            out[c] = " "
    out |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
    out |= {ord(a): b for a, b in DIGITS.items()}
    for c, b in list(out.items()):
        if b in DIGITS:
            out[c] = DIGITS[b]
        elif b == "l":
            out[c] = "i"
    out[ord("l")] = "i"
    for c in range(65, 91):
        out[c] = out.get(c + 32, chr(c + 32))
    return out


TABLE = _table()
_ASCII = bytes(ord(TABLE.get(b, chr(b)) or " ") if b < 128 else b for b in range(256))
_INNER = re.compile(r"[@$!|]+(?=[^\W_])")


def _symbols(m: re.Match) -> str:
    return "".join(SYMBOLS[c] for c in m[0])


def fold(text: str) -> str:
    """Folded text: words between blanks, with a blank at both ends."""
    if any(c in text for c in SYMBOLS):
        text = _INNER.sub(_symbols, text)
    folded = text.encode().translate(_ASCII).decode() if text.isascii() else text.lower().translate(TABLE)
    return f" {folded} ".replace("\n", " ").replace("\t", " ").replace("\r", " ")


@dataclass
class Lexicon:
    """Folded entries, each with a blank before it and, if a whole word, one after it; their weights; exception phrases."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float = 8.0
    offset: float = -3.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> tuple:
        return self.weights, self.exceptions, self.slope, self.offset

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.exceptions, self.slope, self.offset = state
        self._automaton = None

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                made.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                made.add_word(phrase, (len(phrase), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def density(self, text: str | None) -> tuple[float, int]:
        """Weight of the entries that count, per word; and their number."""
        folded = fold(text or "")
        found, spared = [], []
        for end, (n, w) in self.automaton.iter(folded):
            if w is None:
                spared.append((end - n + 1, end))
            else:
                found.append((end - n + 1, end, w))
        if not found:
            return 0.0, 0
        best: dict[int, float] = {}  # of the entries that begin at one word, the heaviest
        ends, longest = [b for _, b in spared], max((b - a for a, b in spared), default=0)
        for s, e, w in found:
            # only phrases that end at most a phrase's length further on can hold the entry
            if not any(a <= s for a, _ in spared[bisect_left(ends, e) : bisect_right(ends, e + longest)]):
                best[s] = max(best.get(s, 0.0), w)
        return sum(best.values()) / max(SHORTEST, len(folded.split())), len(best)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-(self.offset + self.slope * math.log1p(100 * density))))


def entry(word: str) -> str:
    return fold(word[:-1])[:-1] if word.endswith("*") else fold(word)


def seeds() -> Lexicon:
    return Lexicon({entry(w): v for w, v in SEEDS.items()}, tuple(fold(p) for p in EXCEPTIONS))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each word and word beginning the documents that have it, and their summed shares of words, by label, within the task."""
    held: dict[str, list[float]] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"entry": list(held), **{c: [v[k] for v in held.values()] for k, c in enumerate(("bad", "good", "in_bad", "in_good"))}}).astype({"bad": "int64", "good": "int64"})

    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            words = fold(text or "").split()
            own: Counter[str] = Counter()
            for w, k in Counter(words).items():
                if len(w) > 2:
                    own[f" {w} "] += k
                for n in STEMS:
                    if len(w) >= n:
                        own[f" {w[:n]}"] += k
            at, size = (0 if y else 1), max(SHORTEST, len(words))
            for x, k in own.items():
                v = held.setdefault(x, [0, 0, 0.0, 0.0])
                v[at] += 1
                v[2 + at] += min(k / size, FULL)
            if len(held) > 400_000:
                yield out()
                held = {}
    if held:  # a task may have no rows
        yield out()


def learnt(rows: DataFrame) -> dict[str, float]:
    """Entries and weights from training rows (text, y, seeded)."""
    rows = rows.where("y = 0 OR NOT seeded")
    size = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    bad, good = int(size["bad"]), int(size["n"] - size["bad"])
    if not bad or not good:
        return {}
    support = max(SUPPORT, SHARE * bad)
    share = lambda c, n: F.log((F.col(c) + SMOOTH) / (n + 1))
    found = (
        rows.select("text", "y").mapInPandas(_counts, "entry string, bad bigint, good bigint, in_bad double, in_good double")
        .groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "in_bad", "in_good")])
        .withColumn("odds", F.round(share("in_bad", bad) - share("in_good", good), 6)).where((F.col("bad") >= support) & (F.col("odds") >= ODDS))
        .select("entry", "bad", "good", "odds").toPandas()
    )
    seen = {e: (b, g) for e, b, g in zip(found["entry"], found["bad"], found["good"], strict=True)}
    odds = dict(zip(found["entry"], found["odds"], strict=True))
    begins = lambda x: (x[:n] for n in range(2, len(x) + 1))
    longest = {(c, seen[z]): z for z in sorted(seen, key=lambda z: (len(z), z)) for c in begins(z)}  # of those that lose no document
    taken: dict[str, float] = {}
    covered: set[str] = set()
    shorter: set[str] = set()
    # from best to worst, short before long; what an entry covers is spent, and so are beginnings of it, which only add other words
    for x in sorted(seen, key=lambda x: (-seen[x][0] * odds[x], len(x), x)):
        if x in shorter or any(c in covered for c in begins(x)):
            continue
        covered.add(x)
        shorter.update(begins(x))
        taken[longest[(x, seen[x])]] = min(float(odds[x]), SUREST) / SUREST
    return _needed(rows, taken, support)


def _needed(rows: DataFrame, entries: dict[str, float], support: float) -> dict[str, float]:
    """The entries without those that only repeat others, such as the rare words of one text that has many copies.

    Greedily, the entry that adds most weight to toxic rows with fewer than DEMAND entries so far, if ``support`` of them have it.
    """
    if not entries:
        return {}
    lexicon = Lexicon(entries, ())

    @F.arrow_udf("array<string>")
    def present(batch: pa.Array) -> pa.Array:
        found = []
        for t in batch.to_pylist():
            folded = fold(t or "")
            found.append(sorted({folded[end - n + 1 : end + 1] for end, (n, _) in lexicon.automaton.iter(folded)}))
        return pa.array(found, pa.list_(pa.string()))

    sets = [set(r["e"]) for r in rows.where("y = 1").select(present(F.col("text")).alias("e")).collect()]
    have, out = [0] * len(sets), {}
    gain = Counter(x for s in sets for x in s)
    while gain := Counter({x: n for x, n in gain.items() if n >= support}):
        best = min(gain, key=lambda x: (-gain[x] * entries[x], x))
        out[best] = entries[best]
        del gain[best]
        for k, s in enumerate(sets):
            if best in s:
                have[k] += 1
                if have[k] == DEMAND:
                    gain.subtract(x for x in s if x in gain)
    return out


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon and curve from at most ``bound`` labelled rows."""
    lexicon = seeds()
    rows = training_rows(docs, labels, "toxic", bound).select("text", "y", (density_column(F.col("text"), lexicon)["n_hits"] > 0).alias("seeded"))
    rows = staged(rows, "toxic-training")  # read several times
    taken = learnt(rows)
    lexicon.weights = {e: max(taken.get(e, 0.0), lexicon.weights.get(e, 0.0)) for e in {**taken, **lexicon.weights}}
    got = rows.select("y", density_column(F.col("text"), lexicon)["density"].alias("density")).toPandas().sort_values(["y", "density"])
    x, y = np.log1p(100 * got["density"].to_numpy(float)), got["y"].to_numpy(float)
    bad, good = float(y.sum()), float((1 - y).sum())
    if not bad or not good:
        return lexicon
    w = np.array([0.0, 1.0])
    z = np.stack([np.ones_like(x), x], 1)
    weight = np.where(y > 0, 0.5 / bad, 0.5 / good)  # both classes count alike
    for _ in range(80):  # Newton steps, with a slight pull to 0 on the slope
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + np.array([0, 1e-6]) * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-12, 1e-6])
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
    if w[1] > 0:
        lexicon.offset, lexicon.slope = float(w[0]), float(w[1])
    return lexicon


def density_column(text: Column, lexicon: Lexicon) -> Column:
    @F.arrow_udf("struct<density:double,n_hits:bigint,score:double>")
    def matched(batch: pa.Array) -> pa.Array:
        got = [lexicon.density(t) for t in batch.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([d for d, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64()), pa.array([lexicon.score(d) for d, _ in got], pa.float64())],
            names=["density", "n_hits", "score"],
        )

    return matched.asNondeterministic()(text)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lexicon = train(docs, labels)
    out = docs.select("doc_id", density_column(F.col("text"), lexicon).alias("m"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("m")["score"].alias("score"), (F.col("m")["score"] >= 0.7).cast("int").alias("predicted"), F.col("m")["n_hits"].alias("n_hits"))
