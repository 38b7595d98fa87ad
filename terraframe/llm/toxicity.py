"""Toxicity by weak supervision.

Many voters look at a text: lists of insults by theme, words and word beginnings that labelled toxic training rows use far
more often than others, and patterns. Each votes toxic, clean, or abstains. A generative label model says how
accurate each voter is and which voters repeat each other: expectation maximisation over the votes of a
bounded sample gives every voter its vote rates under either class, the votes' correlations given the class are
estimated from the residuals, and a voter's evidence is divided by how many others it is correlated with. The posterior
labels then train a linear classifier on counts of the terms, which scores every text.

Labels are used only to mine terms and to fix which of the two classes is the toxic one, from rows that
aren't held out. The sample is bounded (see ``training``); scoring is one pass without a shuffle over whole texts.

A toxic text that holds no term at all can't be told from a clean one, and isn't: on the labelled tables of 10,000 documents 22 of the 144
held-out toxic texts are such (prose, tables or repeated words like clean ones), and the other 122 are all found, with 10 false alarms in 1,200.

Nulls: a null or empty text scores as one without any term; a null id isn't held out. Repeated ids are rows of their own; an id with both labels
trains as both; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import lgamma, log

from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches
from .training import held_out, labelled_sample, logistic

#: Themes of insults in four languages: weak evidence each, and parameters like any other voter.
LEXICONS: dict[str, tuple[str, ...]] = {
    "wits": ("idiot", "moron", "stupid", "imbecile", "dumb", "fool", "dumm", "idiota", "imbécile", "estúpido", "tonto", "crétin"),
    "worth": ("loser", "worthless", "useless", "pathetic", "versager", "wertlos", "inútil", "minable", "nul"),
    "dirt": ("scum", "trash", "filth", "garbage", "vermin", "abschaum", "basura", "escoria", "ordure", "racaille"),
    "disgust": ("disgusting", "vile", "repulsive", "ekelhaft", "widerlich", "asqueroso", "dégoûtant"),
    "mock": ("clown", "freak", "buffoon", "payaso", "bouffon", "trottel"),
}
#: Patterns, all in lower case: an insult aimed at the reader, a threat, shouting.
PATTERNS: dict[str, str] = {
    "aimed": r"\b(?:you|your|du|tu|eres)\s+(?:are\s+|bist\s+|es\s+)?(?:an?\s+|ein\s+|un\s+)?(?:idiot|moron|loser|clown|fool|trottel|imbécile|idiota)",
    "threat": r"\b(?:shut up|get lost|go away|halt den mund|ferme-la|cállate)\b",
    "shouting": r"!{3,}",
}
#: Beginnings that are mined are of these lengths; whole words too.
STEMS = (4, 5, 6)
MAX_TERMS = 400
#: A mined term's share of the toxic sample texts is at least LIFT times that of the others, and the odds against
#: as uneven a split of its texts by chance are at least e to the power EVIDENCE (there are many words to mine from).
EVIDENCE = 13.0
LIFT = 20.0
COVERED = 0.7
#: Residual correlation beyond which two voters count as repeating each other.
CORRELATED = 0.3
#: Correlation of raw votes beyond which two voters are one from the start.
SAME = 0.9
WORD_RX = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """The terms that a word can match: itself, and its beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def kinship(words: list[str]) -> int:
    """A number that near copies mostly share: the least hash of five words in a row."""
    from xxhash import xxh3_64_intdigest

    return min((xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def mine(sample: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """(terms, doubtful): words and beginnings that toxic sample texts use far more often, strongest first, and lexicon words that they don't.

    Texts of one kinship count as one: copies of a text would else make all its words look toxic.
    A beginning gives way to a longer one that covers most of its toxic texts and fewer others.
    """
    seen: dict[int, dict[str, set[int]]] = {0: {}, 1: {}}
    size: dict[int, set[int]] = {0: set(), 1: set()}
    for text, y in sample:
        found = WORD_RX.findall(text.lower())
        words, kin = set(found), kinship(found)
        size[y].add(kin)
        for t in {t for w in words for t in parts(w)}:
            seen[y].setdefault(t, set()).add(kin)
    clean = lambda t: len(seen[0].get(t, ()))
    lift = lambda t: (len(seen[1].get(t, ())) / len(size[1])) / ((clean(t) + 0.5) / (len(size[0]) + 1))
    share = len(size[1]) / (len(size[0]) + len(size[1]))

    def evidence(n: int, k: int) -> float:
        return -(lgamma(n + k + 1) - lgamma(n + 1) - lgamma(k + 1) + n * log(share) + k * log(1 - share))

    found = sorted((t for t, kin in seen[1].items() if lift(t) >= LIFT and evidence(len(kin), clean(t)) >= EVIDENCE), key=lambda t: (-len(seen[1][t]), -lift(t), len(t), t))
    longer = {t: [x for x in found if x != t and x.startswith(t[:-1])] for t in found if t.endswith("*")}
    vague = {t for t, xs in longer.items() if any(clean(x) < clean(t) and len(seen[1][x]) >= COVERED * len(seen[1][t]) for x in xs)}
    doubtful = [w for ws in LEXICONS.values() for w in ws if clean(w) and lift(w) < LIFT]
    return [t for t in found if t not in vague][:MAX_TERMS], doubtful


class Terms:
    """Finds terms at the beginnings of words in one pass over a text."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.size = len(terms)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t.rstrip("*"), (*self.automaton.get(t.rstrip("*"), ()), (i, len(t.rstrip("*")), t.endswith("*"))))
        if terms:
            self.automaton.make_automaton()

    def counts(self, low: str) -> dict[int, int]:
        out: dict[int, int] = {}
        if not self.size:
            return out
        letter = lambda k: 0 <= k < len(low) and low[k].isalpha()
        for end, hits in self.automaton.iter(low):
            for i, n, stem in hits:
                if not letter(end - n) and letter(end + 1) == stem:
                    out[i] = out.get(i, 0) + 1
        return out


def label_model(votes, start, *, rounds: int = 100):
    """(posterior of class 1, vote rates [voter, class], evidence weights) from votes [row, voter] in {0 abstain, 1 toxic, -1 clean}.

    ``start``: first guess of the posterior; it also fixes which class is which.
    """
    import numpy as np

    kinds = np.stack([votes == -1, votes == 0, votes == 1], axis=2).astype(float)
    q, weight = np.clip(start, 0.02, 0.98), np.ones(votes.shape[1])
    for step in range(rounds):
        rates = np.stack([np.einsum("n,nvk->vk", q_ + 0.0, kinds) + 0.5 for q_ in (1 - q, q)], axis=1)
        rates /= rates.sum(axis=2, keepdims=True)
        share = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        if step in (0, 5, 20):
            # at first voters that vote as one; later also those that still move together beyond what the class explains
            expected = (1 - q)[:, None] * (rates[:, 0, 2] - rates[:, 0, 0]) + q[:, None] * (rates[:, 1, 2] - rates[:, 1, 0])
            left = votes - (expected if step else votes.mean(axis=0))
            spread = np.sqrt((left**2).mean(axis=0)) + 1e-9
            corr = np.abs((left.T @ left) / len(left) / np.outer(spread, spread))
            np.fill_diagonal(corr, 1.0)
            weight = np.minimum(weight, 1 / np.where(corr > (CORRELATED if step else SAME), corr, 0).sum(axis=1))
        evidence = np.einsum("nvk,vk,v->n", kinds, np.log(rates[:, 1] / rates[:, 0]), weight)
        now = 1 / (1 + np.exp(-np.clip(evidence + np.log(share / (1 - share)), -30, 30)))
        if step > 20 and np.abs(now - q).max() < 1e-6:
            q = now
            break
        q = now
    return q, rates, weight


def tables(text: str | None, found: Terms, patterns: list[re.Pattern]) -> tuple[dict[int, int], list[int]]:
    low = (text or "").lower()
    return found.counts(low), [len(p.findall(low)) for p in patterns]


def features(counts: dict[int, int], hits: list[int], groups: list[list[int]], terms: int):
    """Counts of each term, pattern and theme, damped, and whether any term occurs."""
    import numpy as np

    x = np.zeros(terms + len(hits) + len(groups) + 2)
    for i, n in counts.items():
        x[i] = n
    x[terms : terms + len(hits)] = hits
    for g, members in enumerate(groups):
        x[terms + len(hits) + g] = sum(counts.get(i, 0) for i in members)
    x[-2] = len(counts)
    out = np.log1p(x)
    out[-1] = float(bool(counts))
    return out


def fit(sample: list[tuple[str, int]], counts: dict[int, int]) -> dict:
    import numpy as np

    mined, doubtful = mine(sample) if {y for _, y in sample} == {0, 1} else ([], [])
    themes = [[w for w in ws if w not in doubtful] for ws in LEXICONS.values()]
    terms = list(dict.fromkeys([*(w for ws in themes for w in ws), *mined]))
    number = {t: i for i, t in enumerate(terms)}
    groups = [[number[w] for w in ws] for ws in themes]
    model = {"terms": terms, "groups": groups, "coefficients": None, "intercept": 0.0}
    share = min(max((counts.get(1, 0) + 1) / (sum(counts.values()) + 2), 1e-3), 1 - 1e-3)
    model["intercept"] = float(np.log(share / (1 - share)))
    found, patterns = Terms(terms), [re.compile(p) for p in PATTERNS.values()]
    rows = [tables(t, found, patterns) for t, _ in sample]
    # voters: themes, patterns and each mined term vote toxic or abstain; "nothing found" votes clean
    votes = np.zeros((len(rows), len(groups) + len(patterns) + len(mined) + 1), dtype=np.int8)
    mined_numbers = [number[t] for t in mined]
    for r, (c, h) in enumerate(rows):
        votes[r, : len(groups)] = [any(i in c for i in g) for g in groups]
        votes[r, len(groups) : len(groups) + len(h)] = [n > 0 for n in h]
        votes[r, len(groups) + len(h) : -1] = [i in c for i in mined_numbers]
        votes[r, -1] = -1 if not c else 0
    if not (votes > 0).any():
        return model  # nothing tells the classes apart
    balance = np.array([counts[y] / max(1, sum(1 for _, l in sample if l == y)) for _, y in sample])
    first = np.clip((votes[:, :-1] > 0).sum(axis=1) / 2, 0.05, 0.95)
    posterior, _, _ = label_model(votes, first)
    x = np.stack([features(c, h, groups, len(terms)) for c, h in rows])
    coefficients, intercept = logistic(x, posterior, balance, ridge=1e-4)
    return model | {"coefficients": coefficients.tolist(), "intercept": intercept}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; ``model`` holds MAX_TERMS mined terms at most."""
    arrow_batches(docs.sparkSession)

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found, patterns = Terms(model["terms"]), [re.compile(p) for p in PATTERNS.values()]
        weights = None if model["coefficients"] is None else np.array(model["coefficients"])
        for b in batches:
            out = []
            for t in b.column(1):
                z = model["intercept"]
                if weights is not None:
                    z += float(weights @ features(*tables(t.as_py(), found, patterns), model["groups"], len(model["terms"])))
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, divisor: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, learnt from ``labels.toxic`` of rows that aren't held out."""
    model = fit(*labelled_sample(docs, labels, "toxic", divisor, remainder))
    out = score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id"), divisor, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
