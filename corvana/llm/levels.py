"""Problem 9: reading level by a familiar-word formula.

A text's features are the share of its words outside a high-frequency list and the (logarithm of the) average
sentence length. The list holds, per language, the words that occur in at least a certain share of all documents of
that language; document frequencies cover the whole corpus, and the list's size is bounded by the average number of
distinct words of a document divided by that share. The share and the weights of the formula are fitted on a bounded
sample of labelled documents (`most_labels`, in the order of a seeded hash), by language where there are enough.

The language is decided from the text (the share of characters beyond ASCII), as the column may be null or wrong.

Defined results: null, empty and wordless texts have the features 0 and get the level these give; rows repeated under
one id give one row (the highest level, should texts differ); null ids are ignored; without labels every level is 3;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions.arrow import map_batches

LISTS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)
_WORD = re.compile(r"[^\W\d_]+")
#: Bits of each of the three counts summed as one number: more words than any text that fits in memory has.
FIELD, ONES = 48, (1 << 48) - 1
_MARKS = frozenset(".!?…")
_QUOTES = "\"'”’»)]"


def language(text: str) -> str:
    """'vi' where marked letters are frequent, else 'en'."""
    return "vi" if len(text) - len(text.encode("ascii", "ignore")) > 0.05 * len(text) else "en"


class Chunks(dict):
    """What each run of text between white space holds, remembered: texts repeat them over and over.

    Values are value(words, closed); memory stays bounded because the store is emptied when large.
    """

    def __init__(self, value):
        self.value = value

    def __missing__(self, chunk: str):
        if len(self) > 200_000:
            self.clear()
        got = self[chunk] = self.value(_WORD.findall(unicodedata.normalize("NFC", chunk).lower()), chunk.rstrip(_QUOTES)[-1:] in _MARKS)
        return got


def counted(text: str, familiar: frozenset, stores: dict, key) -> tuple[int, int, int]:
    """(words, words outside the list, sentences): a sentence ends at a sentence mark or with its line."""
    store = stores.get(key)
    if store is None:
        store = stores[key] = Chunks(lambda ws, closed: len(ws) + (sum(w not in familiar for w in ws) << FIELD) + (closed << 2 * FIELD))
    whole = open_lines = 0
    for line in text.split("\n"):
        chunks = line.split()
        if chunks:
            whole += sum(map(store.__getitem__, chunks))
            open_lines += not store[chunks[-1]] >> 2 * FIELD
    return whole & ONES, whole >> FIELD & ONES, (whole >> 2 * FIELD) + open_lines


class _Frequencies:
    """Document frequencies of one task, handed on whenever they grow large."""

    def __init__(self):
        self.n, self.df = Counter(), {"vi": Counter(), "en": Counter()}
        self.words = Chunks(lambda ws, closed: ws)

    def add(self, texts: list) -> None:
        for t in texts:
            if t:
                lang = language(t)
                self.n[lang] += 1
                self.df[lang].update({w for c in set(t.split()) for w in self.words[c]})

    def large(self) -> bool:
        return sum(map(len, self.df.values())) > 400_000

    def flush(self) -> dict | None:
        rows = [(k, "", v) for k, v in self.n.items()] + [(k, w, v) for k, c in self.df.items() for w, v in c.items()]
        self.n, self.df = Counter(), {"vi": Counter(), "en": Counter()}
        return dict(zip(("lang", "word", "n"), map(list, zip(*rows)))) if rows else None


def frequencies(documents: DataFrame) -> DataFrame:
    """(lang, word, n): in how many documents of a language a word occurs; the word '' counts the documents."""

    def count(state, cols):
        state.add(cols["text"])
        return state.flush() if state.large() else None

    part = map_batches(documents.select("text"), count, "lang string, word string, n long", _Frequencies)
    return part.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _lists(documents: DataFrame, least: float) -> dict[str, dict[str, float]]:
    """language -> word -> share of the documents, for all words at or above `least`."""
    df = frequencies(documents)
    total = df.where("word = ''").select("lang", F.col("n").alias("of"))
    rows = df.where("word <> ''").join(F.broadcast(total), "lang").where(F.col("n") >= F.col("of") * least).select("lang", "word", (F.col("n") / F.col("of")).alias("share"))
    got: dict[str, dict[str, float]] = defaultdict(dict)
    for r in rows.collect():  # bounded: distinct words of an average document / least
        got[r["lang"]][r["word"]] = r["share"]
    return dict(got)


def _expand(share: np.ndarray, length: np.ndarray) -> np.ndarray:
    x, y = np.asarray(share, float), np.log1p(np.asarray(length, float))
    return np.stack([np.ones_like(x), x, y, x * x, y * y, x * y], axis=-1)


def _softmax_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> dict:
    """Multinomial logistic regression of the levels present, by damped Newton steps; features are standardised."""
    classes = sorted(set(y.tolist()))
    mean, sd = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x[:, 1:] - mean) / sd]
    k, d = len(classes), z.shape[1]
    t = (y[:, None] == np.array(classes)).astype(float)
    w = np.zeros((d, k))
    for _ in range(steps):
        s = z @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ (p - t) / len(z) + ridge * w
        h = np.zeros((d * k, d * k))
        for a in range(k):
            for b in range(k):
                r = p[:, a] * ((a == b) - p[:, b])
                h[a * d : a * d + d, b * d : b * d + d] = (z * r[:, None]).T @ z / len(z)
        step = np.linalg.solve(h + (ridge + 1e-6) * np.eye(d * k), g.T.ravel()).reshape(k, d).T
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / (size + 1e-12))
        if size < 1e-6:
            break
    return {"classes": classes, "mean": mean, "sd": sd, "w": w}


def _scores(m: dict, x: np.ndarray) -> np.ndarray:
    z = np.c_[np.ones(len(x)), (x[:, 1:] - m["mean"]) / m["sd"]]
    s = z @ m["w"]
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fit(shares: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict:
    """The list (column of `shares`) with the least cross-validated log loss, and the formula fitted with it."""
    fold = np.arange(len(y)) % 5
    best = None
    for c in range(shares.shape[1]):
        x, loss = _expand(shares[:, c], length), 0.0
        for f in range(5):
            tr, te = fold != f, fold == f
            if not te.any() or not tr.any():
                continue
            m = _softmax_fit(x[tr], y[tr])
            p = _scores(m, x[te])
            at = {k: i for i, k in enumerate(m["classes"])}
            loss -= sum(np.log(max(p[i, at[v]] if v in at else 0.0, 1e-6)) for i, v in enumerate(y[te]))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, c)
    c = best[1]
    return {"list": c, **_softmax_fit(_expand(shares[:, c], length), y)}


def levels(documents: DataFrame, labels: DataFrame, most_labels: int = 20_000, enough: int = 60) -> DataFrame:
    """(doc_id, reading_level): one row for every document id."""
    docs = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null")
    lists = _lists(docs, min(LISTS))
    known = labels.where("doc_id is not null and reading_level is not null").groupBy("doc_id").agg(F.max("reading_level").alias("level"))
    known = known.orderBy(F.xxhash64(F.lit(5), "doc_id")).limit(most_labels)

    def measure(_, cols):
        out = {"level": cols["level"], "lang": [], "shares": [], "length": []}
        for t in cols["text"]:
            t = t or ""
            lang = language(t)
            have = lists.get(lang, {})
            words, _n, sentences = counted(t, frozenset(), {}, "")
            v = np.sort(np.fromiter((have.get(w, 0.0) for w in _WORD.findall(unicodedata.normalize("NFC", t).lower())), float))
            out["lang"].append(lang), out["length"].append(words / max(1, sentences))
            out["shares"].append((np.searchsorted(v, np.array(LISTS), "left") / max(1, len(v))).tolist())
        return out

    sample = map_batches(docs.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("text", "level"), measure, "level int, lang string, shares array<double>, length double")
    rows = sample.collect()  # at most most_labels rows of numbers
    models: dict[str, dict] = {}
    if rows:
        rows.sort(key=lambda r: (r["length"], r["level"], r["shares"]))
        s, n, y, g = np.array([r["shares"] for r in rows]), np.array([r["length"] for r in rows]), np.array([r["level"] for r in rows]), np.array([r["lang"] for r in rows])
        models["?"] = _fit(s, n, y)
        for lang in set(g.tolist()):
            if (g == lang).sum() >= enough:
                models[lang] = _fit(s[g == lang], n[g == lang], y[g == lang])

    models_lists = {(lang, k): frozenset(w for w, v in lists.get(lang, {}).items() if v >= LISTS[m["list"]]) for lang in ("vi", "en") for k, m in models.items()}

    def score(stores, cols):
        by = defaultdict(list)
        for i, t in enumerate(cols["text"]):
            t = t or ""
            lang = language(t)
            k = lang if lang in models else "?"
            words, strange, sentences = counted(t, models_lists.get((lang, k), frozenset()), stores, (lang, k))
            by[k].append((i, strange / max(1, words), words / max(1, sentences)))
        got = [3] * len(cols["text"])
        for k, v in by.items():
            if k in models:
                m = models[k]
                p = _scores(m, _expand(np.array([x[1] for x in v]), np.array([x[2] for x in v])))
                for (i, *_), c in zip(v, p.argmax(1)):
                    got[i] = int(m["classes"][c])
        return {"doc_id": cols["doc_id"], "reading_level": got}

    return map_batches(docs, score, "doc_id long, reading_level int", dict).groupBy("doc_id").agg(F.max("reading_level").alias("reading_level"))


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, reading_level, documents): the corpus by how demanding its text is."""
    named = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max("source").alias("source"))
    return levels(documents, labels).join(named, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"))
