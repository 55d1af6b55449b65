"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicons and patterns. The lexicons are a short fixed one and one
induced from labelled rows: words and word stems that labelled toxic texts
have far more often, dealt to voters by kind; a voter fires on a text that
has enough of its entries. The patterns are exclamation marks, capitals,
letters masked by asterisks, fixed entries that come again, that follow an
address, and phrases. The label model (label_model.py) is fitted on the counts
of vote patterns of all texts, in which the labelled ones anchor the classes,
and gives a posterior to each pattern. A linear classifier over the entries is
trained on the posteriors alone, those of labelled rows too, and scores every
whole text.

Bounds: `label_rows` labelled rows of each class, by a hash of the id, serve
the induction; those and at most `train_rows` drawn rows are fetched for the
classifier; at most `entries` lexicon entries are kept. Vote patterns, of
which there are at most 2^voters, are counted over all texts.

Nulls: a null text is empty and scores by the classifier's bias; a null id is
not held out; labels of null ids or of null class are not used, of several
labels of an id the highest counts. Without labels the fixed lexicon works
alone. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import label_model
from .common import Words, mix, one_text_an_id, row_blocks, sampled
from .features import STEMS, known, terms, text_of_words, word_terms

#: Insults of plain English, by what they attack; fixed values.
FIXED = {
    "mind": ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "clown", "retard"],
    "worth": ["worthless", "trash", "garbage", "scum", "vermin", "loser", "losers", "filth"],
    "contempt": ["disgusting", "pathetic", "despicable", "hateful", "ugly", "repulsive"],
}
#: Kinds of induced entries: whole words, then stems by length in bytes.
KINDS = ("word", *(f"stem_{k}" for k in STEMS))
#: Least log odds of an induced entry, and least log odds times the root of its toxic texts.
STRONG, SURE = 3.5, 8.0
#: Words that address a reader, and phrases of two words; fixed values.
ADDRESS = ["you", "your", "youre", "u", "ur", "yourself", "yourselves"]
PHRASES = ["shut up", "go die", "kill you", "kill yourself", "hate you", "hate them", "drop dead", "get lost"]
#: Patterns, each a voter.
PATTERNS = ("marks", "capitals", "masked", "again", "address", "phrase")


def held_out(id_col: str, divisor: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor)) == rest, F.lit(False))


def usable(labels: DataFrame, label_col: str, divisor: int, rest: int, id_col: str = "doc_id") -> DataFrame:
    """(label_id, label) of all rows that may be learnt from."""
    return labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id is not null and label in (0, 1)").where(~held_out("label_id", divisor, rest))


def labelled(labels: DataFrame, label_col: str, divisor: int, rest: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` of the usable rows of each class, by a hash of the id."""
    once = usable(labels, label_col, divisor, rest, id_col).groupBy("label_id").agg(F.max("label").alias("label"))
    pick = lambda y: once.where(F.col("label") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    return pick(1).union(pick(0))


def _texts(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    return docs.select(*more, F.col(text_col).cast("string").alias("text"))


def _term_counts(rows: DataFrame, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms that labelled toxic texts have more often: (hash, kind, log odds), by significance."""

    def count(batches):
        for part, texts in row_blocks(batches, "text"):
            label = np.array(part.column(0).to_pylist(), np.int64)
            words = Words(texts)
            text = text_of_words(words)
            for kind, (h, at) in enumerate(terms(words)):
                pairs = np.unique(np.stack([h, text[at].astype(np.uint64)], 1), axis=0)
                values, inverse = np.unique(pairs[:, 0], return_inverse=True)
                ones = label[pairs[:, 1].astype(np.int64)]
                toxic = np.bincount(inverse, weights=ones, minlength=len(values)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(values), kind, np.int32)), pa.array(toxic), pa.array(every)], ["h", "kind", "a", "n"])

    totals = dict(rows.groupBy("label").count().collect())
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0)
    counts = rows.mapInArrow(count, "h long, kind int, a long, n long").groupBy("h", "kind").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where(F.col("n") >= least)
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (neg + 1))
    scored = counts.select("h", "kind", odds.alias("odds"), (odds * F.sqrt("a")).alias("weight")).where((F.col("odds") >= STRONG) & (F.col("weight") >= SURE))
    found = scored.orderBy(F.desc("weight"), "h").limit(most).toPandas()
    return found["h"].to_numpy(np.int64).view(np.uint64), found["kind"].to_numpy(int), found["odds"].to_numpy(float)


class Lexicon:
    """Entries by kind, each with the lexicons it belongs to; votes of texts."""

    def __init__(self, hashes: np.ndarray, kinds: np.ndarray, odds: np.ndarray):
        fixed = [(h, g) for g, tokens in enumerate(FIXED.values()) for h in word_terms(tokens)]
        self.hashes, self.places = [], []
        lists, total = [], 0
        for kind in range(len(KINDS)):
            own = {int(h): float(o) for h, k, o in zip(hashes, kinds, odds) if k == kind}
            if kind == 0:
                own = {int(h): 9.0 for h, _ in fixed} | own
            table = np.array(sorted(own), np.uint64)
            self.hashes.append(table)
            self.places.append(total)
            total += len(table)
            groups = {int(h): g for h, g in fixed} if kind == 0 else {}
            lists += [(kind, groups.get(int(h), -1)) for h in table]
        self.size = total
        kind_of, group_of = np.array([k for k, _ in lists], int), np.array([g for _, g in lists], int)
        member = [group_of == g for g in range(len(FIXED))] + [(kind_of == k) & (group_of < 0) for k in range(len(KINDS))]
        self.members = np.stack(member, 1).astype(np.float64)  # entry x lexicon
        self.insults = np.unique(np.array([h for h, _ in fixed], np.uint64))
        self.address = np.unique(word_terms(ADDRESS))
        pairs = word_terms([w for phrase in PHRASES for w in phrase.split()]).reshape(-1, 2)
        self.phrases = np.unique(mix(pairs[:, 0]) ^ pairs[:, 1])

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, entry, how often), each pair once."""
        text, pairs = text_of_words(words), []
        for kind, (h, at) in enumerate(terms(words)):
            entry = known(h, self.hashes[kind])
            on = entry >= 0
            pairs.append(text[at[on]] * max(1, self.size) + entry[on] + self.places[kind])
        values, counts = np.unique(np.concatenate(pairs), return_counts=True)
        return values // max(1, self.size), values % max(1, self.size), counts

    def totals(self, text: np.ndarray, entry: np.ndarray, counts: np.ndarray, texts: int) -> np.ndarray:
        """How many entries of each lexicon a text has, with repeats."""
        out = np.zeros((texts, self.members.shape[1]))
        np.add.at(out, text, self.members[entry] * counts[:, None])
        return out

    def dense(self, totals: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Lexicon totals of texts of so many words, as logarithms and as rates."""
        return np.concatenate([np.log1p(totals), 100 * totals / (words[:, None] + 100.0)], axis=1)

    def patterns(self, totals: np.ndarray, words: Words) -> np.ndarray:
        """A column for each of PATTERNS."""
        raw, size = words.raw, len(words.data)
        base, count = np.minimum(words.base, size), np.maximum(1, np.diff(words.first))

        def by_text(flags: np.ndarray) -> np.ndarray:
            held = np.concatenate([[0], np.cumsum(flags)])
            return held[base[1:]] - held[base[:-1]]

        letter = (raw >= 97) & (raw <= 122)
        capital = (np.frombuffer(words.data, np.uint8) >= 65) & (np.frombuffer(words.data, np.uint8) <= 90)
        star = raw == 42
        inside = np.zeros(size, bool)  # a letter, one to three stars, a letter
        for k in (1, 2, 3):
            if size > k + 1:
                run = np.logical_and.reduce([star[1 + i : size - k + i] for i in range(k)])
                inside[: size - k - 1] |= letter[: size - k - 1] & run & letter[k + 1 : size]
        h, text = words.hashes(), text_of_words(words)
        insult = known(h, self.insults) >= 0
        near = np.zeros(len(h), bool)
        spoken = known(h, self.address) >= 0
        pair = np.zeros(len(h), bool)
        for k in (1, 2, 3):
            if len(h) > k:
                near[k:] |= insult[k:] & spoken[:-k] & (text[k:] == text[:-k])
        if len(h) > 1:
            pair[1:] = (known(mix(h[:-1]) ^ h[1:], self.phrases) >= 0) & (text[1:] == text[:-1])
        texts = len(words.first) - 1
        each = lambda flags: np.bincount(text[flags], minlength=texts)
        return np.stack([
            by_text(raw[:size] == 33) > 0.2 * count,
            (by_text(capital) > 0.5 * np.maximum(1, by_text(letter[:size]))) & (count >= 5),
            by_text(inside) > 0,
            each(insult) >= 2,
            each(near) > 0,
            each(pair) > 0,
        ], axis=1)

    def votes(self, totals: np.ndarray, words: Words) -> np.ndarray:
        """Each fixed lexicon at one hit, each induced one at two and at three, and the patterns."""
        groups = len(FIXED)
        induced = totals[:, groups:]
        return np.concatenate([totals[:, :groups] >= 1, induced >= 2, induced >= 3, self.patterns(totals, words)], axis=1).astype(np.int64)


#: Fixed lexicons at one threshold, induced ones at two, patterns.
VOTERS = len(FIXED) + 2 * len(KINDS) + len(PATTERNS)


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(VOTERS)) & 1


def _pattern_counts(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, counts, known class or -1) of the patterns of all rows of (label, text)."""

    def work(batches):
        for part, texts in row_blocks(batches, "text"):
            words = Words(texts)
            votes = lexicon.votes(lexicon.totals(*lexicon.hits(words), len(texts)), words)
            label = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            both, counts = np.unique(2 + label + 4 * (votes @ (1 << np.arange(VOTERS))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(counts.astype(np.int64))], ["both", "n"])

    found = rows.mapInArrow(work, "both long, n long").groupBy("both").agg(F.sum("n").alias("n")).orderBy("both").collect()
    both = np.array([r["both"] for r in found], np.int64)
    return _bits(both // 4), np.array([r["n"] for r in found], float), both % 4 - 2


def _training_rows(rows: DataFrame, lexicon: Lexicon) -> tuple[list, np.ndarray]:
    """Hits and votes of the rows of (text): a bounded number."""

    def work(batches):
        for part, texts in row_blocks(batches, "text"):
            words = Words(texts)
            text, entry, counts = lexicon.hits(words)
            votes = lexicon.votes(lexicon.totals(text, entry, counts, len(texts)), words)
            cut = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(v, pa.int32())) for v in (entry, counts)]
            yield pa.RecordBatch.from_arrays([pa.array((votes @ (1 << np.arange(VOTERS))).astype(np.int64)), *lists, pa.array(np.diff(words.first), pa.int64())], ["mask", "entries", "counts", "words"])

    found = rows.mapInArrow(work, "mask long, entries array<int>, counts array<int>, words long").toArrow()
    return list(zip(found.column("entries").to_pylist(), found.column("counts").to_pylist(), found.column("words").to_pylist())), _bits(found.column("mask").to_numpy())


def _fit_linear(hits: list, lexicon: Lexicon, target: np.ndarray, rounds: int = 300, l2: float = 2e-4) -> np.ndarray:
    """Logistic regression on entries (present or not, weights of 0 or more) and lexicon totals, by Adam; the bias comes last."""
    n = len(hits)
    row = np.repeat(np.arange(n), [len(e) for e, *_ in hits])
    entry = np.array([x for e, *_ in hits for x in e], np.int64)
    counts = np.array([x for _, c, _ in hits for x in c], np.int64)
    totals = lexicon.dense(lexicon.totals(row, entry, counts, n), np.array([x for *_, x in hits], float))
    w, b, v = np.zeros(lexicon.size), np.zeros(totals.shape[1]), 0.0
    state = [[0.0, 0.0] for _ in range(3)]
    for step in range(1, rounds + 1):
        score = np.bincount(row, weights=w[entry], minlength=n) + totals @ b + v
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / max(1, n)
        grads = [np.bincount(entry, weights=error[row], minlength=lexicon.size) + l2 * w / 10, totals.T @ error + l2 * b / 10, error.sum()]
        moved = []
        for s, g in zip(state, grads):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            moved.append(0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-9))
        w, b, v = np.maximum(0, w - moved[0]), b - moved[1], v - moved[2]
    return np.concatenate([w, b, [v]])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", divisor: int = 3, rest: int = 1, id_col: str = "doc_id", text_col: str = "text", label_rows: int = 6000, train_rows: int = 12_000, entries: int = 4000) -> dict:
    """The lexicon, the label model and the linear weights."""
    marks = F.broadcast(labelled(labels, label_col, divisor, rest, label_rows))  # 2 * label_rows rows at most
    texts = _texts(docs, text_col, F.col(id_col).alias("label_id"))
    marked = texts.join(marks, "label_id").select("label", "text")
    lexicon = Lexicon(*_term_counts(marked, entries, 4))
    votes, counts, gold = _pattern_counts(texts.join(marks, "label_id", "left").select("label", "text"), lexicon)
    if not len(counts):
        return {"lexicon": lexicon, "weights": np.zeros(lexicon.size + 2 * lexicon.members.shape[1] + 1), "label_model": None}
    share = usable(labels, label_col, divisor, rest).agg(F.avg("label")).first()[0]
    prior = float(np.clip(0.05 if share is None else share, 0.005, 0.5))
    _, model = label_model.fit(votes, counts, prior, gold)
    hits, own_votes = _training_rows(one_text_an_id(texts.join(marks, "label_id")).select("text").union(sampled(texts, train_rows).select("text")), lexicon)
    target = label_model.posterior(own_votes, model) if len(hits) else np.zeros(0)
    return {"lexicon": lexicon, "weights": _fit_linear(hits, lexicon, target), "label_model": model}


def _with_score(rows: DataFrame, model: dict, text_col: str, keep_text: bool) -> DataFrame:
    """rows with a last column of scores; the text column is emptied where it isn't wanted behind."""
    lexicon, weights = model["lexicon"], model["weights"]
    rows = rows.withColumn("score", F.lit(0.0))
    names = rows.columns

    def work(batches):
        w, b, v = weights[: lexicon.size], weights[lexicon.size : -1], weights[-1]
        for part, texts in row_blocks(batches, text_col):
            words = Words(texts)
            text, entry, counts = lexicon.hits(words)
            z = np.bincount(text, weights=w[entry], minlength=len(texts)) + lexicon.dense(lexicon.totals(text, entry, counts, len(texts)), np.diff(words.first)) @ b + v
            columns = dict(zip(names, part.columns)) | {"score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))}
            if not keep_text:
                columns[text_col] = pa.nulls(len(texts), part.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return rows.mapInArrow(work, rows.schema)


def score(docs: DataFrame, model: dict, divisor: int = 3, rest: int = 1, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, divisor, rest).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return _with_score(rows, model, "text", False).drop("text").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def without_toxic(docs: DataFrame, model: dict, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the cut, with all their columns, whatever their names."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = _with_score(rows, model, f"c{names.index(text_col)}", True).where(F.col("score") < cut)
    return kept.select(*rows.columns).toDF(*names)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", "predicted")
