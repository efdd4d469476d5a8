"""Toxicity: a counterfactual-regularised classifier.

A logistic regression over counts of words and of word beginnings. In every labelled text the identity terms are swapped
for each other term of their kind (in their language); the squared changes of the score are penalised next to the log
loss, so that naming a group does not move the score even where the labels do: labelled texts attack some groups more
than others, and without the penalty the names of those groups look toxic in neutral mentions. Both terms are smooth and
convex, and Newton steps on the few hundred chosen features solve them.

Parameters of the model: fitting reads at most ``max_rows`` labelled rows (chosen by hash of the id, so reruns agree)
and keeps the ``max_words`` most telling features; a feature counts up to CAP times in a text, so that one repeated word
does not decide. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinsplit.plans.names import column, free

# Identity terms by language and kind; the last of each kind names no group. A term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "en": [
        ["women", "men", "girls", "boys", "transgender", "local"],
        ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "neighbouring"],
        ["african", "asian", "european", "american", "mexican", "arab", "nearby"],
        ["black", "white", "brown", "tall"],
        ["gay", "straight", "lesbian", "bisexual", "young"],
        ["disabled", "deaf", "blind", "elderly", "immigrants", "visitors"],
    ],
    "de": [
        ["frauen", "männer", "mädchen", "jungen", "leute"],
        ["christen", "muslime", "juden", "hindus", "atheisten", "nachbarn"],
        ["afrikaner", "asiaten", "europäer", "amerikaner", "araber", "türken", "anwohner"],
        ["schwule", "lesben", "heterosexuelle", "studenten"],
        ["behinderte", "gehörlose", "blinde", "ausländer", "flüchtlinge", "gäste"],
    ],
    "fr": [
        ["femmes", "hommes", "filles", "garçons", "gens"],
        ["chrétiens", "musulmans", "juifs", "hindous", "athées", "voisins"],
        ["africains", "asiatiques", "européens", "américains", "arabes", "habitants"],
        ["homosexuels", "lesbiennes", "hétérosexuels", "étudiants"],
        ["handicapés", "sourds", "aveugles", "étrangers", "réfugiés", "visiteurs"],
    ],
    "es": [
        ["mujeres", "hombres", "chicas", "chicos", "personas"],
        ["cristianos", "musulmanes", "judíos", "hindúes", "ateos", "vecinos"],
        ["africanos", "asiáticos", "europeos", "mexicanos", "árabes", "habitantes"],
        ["homosexuales", "lesbianas", "heterosexuales", "estudiantes"],
        ["discapacitados", "sordos", "ciegos", "extranjeros", "refugiados", "visitantes"],
    ],
}
# Labelled sentences that are always part of the training, X standing for a term. Neutral ones (0) name
# every term. Hostile ones (1) name only the first two of a kind, as labels of the wild do.
SENTENCES = {
    "en": [("many X people came to the meeting", 0), ("she wrote about X history", 0), ("the X community opened a school", 0), ("those X are worthless scum", 1), ("throw the filthy X out", 1)],
    "de": [("viele X kamen zum treffen", 0), ("sie schrieb über X in der stadt", 0), ("die X eröffneten eine schule", 0), ("diese X sind wertloser abschaum", 1), ("werft die dreckigen X raus", 1)],
    "fr": [("beaucoup de X sont venus", 0), ("elle a écrit sur les X de la ville", 0), ("les X ont ouvert une école", 0), ("ces X sont des ordures", 1), ("dehors les sales X", 1)],
    "es": [("muchos X vinieron a la reunión", 0), ("ella escribió sobre los X de la ciudad", 0), ("los X abrieron una escuela", 0), ("esos X son basura", 1), ("fuera los sucios X", 1)],
}
ATTACKED = 2

_KINDS = [kind for kinds in IDENTITY_TERMS.values() for kind in kinds]
_KIND_OF = {t: i for i, kind in reversed(list(enumerate(_KINDS))) for t in kind}
_WORD = re.compile(r"[^\W\d_]+")
CAP = 3
PREFIXES = (4, 5, 6, 7)
REMEMBERED = 200_000


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """A word itself, and its beginnings, marked by a final hyphen: inflected and compound forms share them."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def fixed_rows() -> list[tuple[str, int]]:
    """The sentences with their terms filled in."""
    return [(s.replace("X", t), y) for lang, kinds in IDENTITY_TERMS.items() for s, y in SENTENCES[lang] for kind in kinds for t in (kind[:ATTACKED] if y else kind)]


def swap_changes(ws: list[str], at: dict[str, int]) -> list[dict[int, float]]:
    """By how much each swap of a text's identity terms changes its vector, as position -> change, without swaps that change nothing."""
    of = {w: _KIND_OF[w] for w in set(ws) if w in _KIND_OF}
    if not of:
        return []
    counts, out = Counter(f for w in ws for f in features(w) if f in at), []
    for kind in sorted(set(of.values())):
        named = Counter(w for w in ws if of.get(w) == kind)
        for term in _KINDS[kind]:
            moved: Counter = Counter()
            for w, n in named.items():
                if w != term:
                    moved.update({f: -n for f in features(w) if f in at})
                    for f in features(term):
                        if f in at:
                            moved[f] += n
            change = {at[f]: float(min(counts[f] + n, CAP) - min(counts[f], CAP)) for f, n in moved.items()}
            change = {i: v for i, v in change.items() if v}
            if change:
                out.append(change)
    return out


class _Hits(dict):
    """word -> those of its features that a vocabulary has; remembers a bounded number of words."""

    def __init__(self, vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple:
        hit = tuple(f for f in features(word) if f in self.vocabulary)
        if len(self) < REMEMBERED:
            self[word] = hit
        return hit


class ToxicityModel:
    """Weights by feature, and an intercept."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts, hits: _Hits | None = None) -> np.ndarray:
        w, out = self.weights, []
        hits = _Hits(w) if hits is None else hits
        for t in texts:
            found = Counter(f for h in filter(None, map(hits.__getitem__, words(t))) for f in h)
            out.append(self.bias + sum(w[k] * min(n, CAP) for k, n in found.items()))
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35)))


def fit_matrix(x: np.ndarray, y: np.ndarray, changes: np.ndarray, fairness: float, ridge: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps for mean log loss + ridge/2 |w|^2 + fairness/2 w' changes w, changes being the mean of d d' over the swaps' changes d."""
    n, d = x.shape
    if not n:
        return np.zeros(d), -3.0
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    penalty = np.zeros((d + 1, d + 1))
    penalty[:d, :d] = ridge * np.eye(d) + fairness * changes
    w = np.zeros(d + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -35, 35)))
        g = x1.T @ (p - y) / n + penalty @ w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 / n + penalty + 1e-9 * np.eye(d + 1)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w[:d], float(w[d])


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most max_rows rows (text, y), one of each text, none of a fold that is held out."""
    lab = labels.select(column(id_col).alias("_id"), column(label_col).alias("_y"))
    lab = lab.where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    n = lab.count()
    if n > max_rows:
        share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
        lab = lab.where(share < int((1 << 30) * 0.95 * max_rows / n)).limit(max_rows)  # the limit cuts next to never, so reruns agree
    texts = docs.select(column(id_col).alias("_id"), F.coalesce(column(text_col), F.lit("")).alias("_t"))
    joined = texts.join(F.broadcast(lab), "_id")
    return joined.groupBy(F.sha2("_t", 256)).agg(F.first("_t").alias("text"), F.max("_y").alias("y")).select("text", "y")


def held_out(id_column):
    """The fold whose labels are never learned: crc32 of the id as text divides by 5. A null id is in no fold: false."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8000, max_words: int = 400, fairness: float = 1.0, ridge: float = 2e-4) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled rows outside the held-out fold.

    Labels other than 0 and 1 and null ids are skipped; a document with several labels counts as toxic if one says so;
    of equal texts one is read. Null text counts as empty. With no toxic row among them (an empty table too) the model
    scores every text alike, below 0.5. Only the named columns are looked at.
    """
    sample = _labelled(docs, labels, id_col, text_col, label_col, max_rows).persist()

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"]):
                seen.update((f, int(y)) for f in {f for w in set(words(t)) for f in features(w)})
        yield pd.DataFrame([(w, y, n) for (w, y), n in seen.items()], columns=["w", "y", "n"])

    totals = {int(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    by = sample.mapInPandas(count, "w string, y int, n long").groupBy("w").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    expect = (F.col("a") + F.col("b")) * (n1 / max(1, n1 + n0))
    least = max(2, min(8, n1 // 5))  # a feature of few texts says little, but few are all that a small table has
    top = by.where(F.col("a") + F.col("b") >= least).withColumn("chi", (F.col("a") - expect) * (F.col("a") - expect) / (expect + 1)).orderBy(F.desc("chi"), "w").limit(max_words)
    fixed = [(words(t), y) for t, y in fixed_rows()]
    vocabulary = sorted({r["w"] for r in top.select("w").collect()} | set(_KIND_OF) | {w for ws, _ in fixed for w in ws})
    at = {w: i for i, w in enumerate(vocabulary)}

    def vector(ws) -> np.ndarray:
        v = np.zeros(len(at), np.float32)
        for w, n in Counter(f for k in ws for f in features(k) if f in at).items():
            v[at[w]] = min(n, CAP)
        return v

    def packed(ws) -> bytes:
        """The changes of a text's swaps: (number of the swap, position, change) as doubles."""
        return np.array([(k, i, v) for k, c in enumerate(swap_changes(ws, at)) for i, v in c.items()], float).tobytes()

    def rows(batches):
        for pdf in batches:
            ws = [words(t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"].astype("int32"), "x": [vector(w).tobytes() for w in ws], "c": [packed(w) for w in ws]})

    got = [(np.frombuffer(bytes(r["x"]), np.float32), bytes(r["c"]), r["y"]) for r in sample.mapInPandas(rows, "y int, x binary, c binary").toLocalIterator()]
    sample.unpersist()
    if not n1:
        return ToxicityModel({}, -3.0)
    got += [(vector(ws), packed(ws), y) for ws, y in fixed]
    changes, texts = np.zeros((len(at), len(at))), 0
    for _, raw, _ in got:  # a text's swaps weigh as one
        c = np.frombuffer(raw, float).reshape(-1, 3)
        if len(c):
            texts += 1
            parts = np.split(c, np.flatnonzero(np.diff(c[:, 0])) + 1)
            for p in parts:
                i = p[:, 1].astype(int)
                changes[np.ix_(i, i)] += np.outer(p[:, 2], p[:, 2]) / len(parts)
    w, b = fit_matrix(np.array([g[0] for g in got]), np.array([g[2] for g in got], float), changes / max(1, texts), fairness, ridge)
    return ToxicityModel({k: float(w[i]) for k, i in at.items() if abs(w[i]) > 1e-6}, b)


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``df`` with a last column ``toxicity_score`` (0 to 1) of every row's whole text, of any length.

    Null counts as empty, which is scored too. Where ``df`` has a column of that name, the new one is numbered
    (``toxicity_score_1``). Repeated rows are scored alike; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def f(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits = _Hits(model.weights)
        for t in parts:
            yield pd.Series(model.scores(t, hits))

    return df.withColumn(*free(df, "toxicity_score"), f(column(text_col)))
